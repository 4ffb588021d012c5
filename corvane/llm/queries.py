"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.documented_code import documented_functions
from corvane.llm.languages import fit_on, label_code, language_segments
from corvane.llm.mixing import Mix, source_name
from corvane.llm.near_duplicates import NearDuplicates
from corvane.llm.ngram_counts import marked_terms, ngram_counts
from corvane.llm.packing import fill_report, pack
from corvane.llm.splitting import split_oversized
from corvane.llm.tokens import unicode_words
from corvane.functions.token_sizes import with_token_counts
from corvane.operators.components import connected_components
from corvane.operators.latest import latest_wide_rows
from corvane.sources.shared import materialize
from corvane.sources.tables import spread, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def _chunks(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    chunks = spread(table(spark, d, "doc_chunk").select("chunk_id", *columns, "loaded_at"))
    return latest_wide_rows(chunks, "chunk_id").drop("loaded_at")


_VALID_SQL = """
with valid as (
  select chunk_id, md_text, source_site from doc_chunk
  qualify row_number() over (partition by chunk_id order by loaded_at desc) = 1
), token as (
  select chunk_id, unnest(list_filter(regexp_extract_all(lower(md_text), '[a-z0-9_#-]+'), lambda t: length(t) > 1)) as term from valid
)"""


# ---- 1: terms


@query
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return marked_terms(_chunks(spark, d, "md_text"), "md_text").filter("mark is not null").select("term", "mark")


SQL["p1_found"] = _VALID_SQL + """
select term, case when count(distinct chunk_id) < 3 then 'rare' else 'common' end as mark from token
group by term having count(distinct chunk_id) < 3 or count(distinct chunk_id) > 0.2 * (select count(*) from valid)"""


@query
def p1_term_counts(spark: SparkSession, d: str) -> DataFrame:
    return marked_terms(_chunks(spark, d, "md_text"), "md_text").select("term", "occurrences", "records", "mark")


SQL["p1_term_counts"] = _VALID_SQL + """
select term, count(*) as occurrences, count(distinct chunk_id) as records,
  case when count(distinct chunk_id) < 3 then 'rare' when count(distinct chunk_id) > 0.2 * (select count(*) from valid) then 'common' end as mark
from token group by term"""


@query
def p1_bigram_counts(spark: SparkSession, d: str) -> DataFrame:
    return ngram_counts(_chunks(spark, d, "md_text"), "md_text", max_n=2).filter("n = 2").select("term", "occurrences", "records")


SQL["p1_bigram_counts"] = _VALID_SQL + """
, listed as (
  select chunk_id, list_filter(regexp_extract_all(lower(md_text), '[a-z0-9_#-]+'), lambda t: length(t) > 1) as t from valid
), pair as (
  select chunk_id, unnest(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])) as term from listed where len(t) > 1
)
select term, count(*) as occurrences, count(distinct chunk_id) as records from pair group by term"""


# ---- 2: near-duplicates


def _near_duplicate_chunks(spark: SparkSession, d: str) -> NearDuplicates:
    return NearDuplicates(_chunks(spark, d, "md_text"), "chunk_id", "md_text", size=3, threshold=0.6, min_tokens=20)


@query
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = _near_duplicate_chunks(spark, d).pairs()
    return pairs.select(F.col("a").alias("chunk_id_a"), F.col("b").alias("chunk_id_b"))


SQL["p2_found"] = _VALID_SQL + """
, listed as (
  select chunk_id, list_filter(regexp_extract_all(lower(md_text), '[a-z0-9_#-]+'), lambda t: length(t) > 1) as t from valid
), gram as (
  select distinct chunk_id, unnest(list_transform(range(1, len(t) - 1), lambda i: t[i] || ' ' || t[i + 1] || ' ' || t[i + 2])) as g
  from listed where len(t) >= 20
), size as (select chunk_id, count(*) as n from gram group by chunk_id),
both_have as (
  select x.chunk_id as a, y.chunk_id as b, count(*) as o from gram x join gram y on x.g = y.g and x.chunk_id < y.chunk_id group by all
)
select a as chunk_id_a, b as chunk_id_b from both_have
join size p on p.chunk_id = a join size q on q.chunk_id = b where o / (p.n + q.n - o) >= 0.6"""


@query
def p2_groups(spark: SparkSession, d: str) -> DataFrame:
    """One row a chunk that is like another one: its group, its class of equal ones, and to
    how many classes of different text that class is linked."""
    found = _near_duplicate_chunks(spark, d)
    links = materialize(found.links(), "links")
    ends = links.select(F.explode(F.array("a", "b")).alias("class_id")).groupBy("class_id").agg(F.count("*").alias("n_links"))
    groups = connected_components(links).withColumnsRenamed({"id": "class_id", "component": "group_id"})
    classes = found.copies.select("class_id").distinct().join(ends, "class_id", "full_outer").join(groups, "class_id", "left")
    members = classes.join(found.copies, "class_id", "left")
    return members.select(
        F.coalesce("id", "class_id").alias("chunk_id"), "class_id", F.coalesce("group_id", "class_id").alias("group_id"), F.coalesce("n_links", F.lit(0)).alias("n_links")
    )


SQL["p2_groups"] = SQL["p2_found"].replace("with valid as", "with recursive valid as", 1).replace("select a as chunk_id_a, b as chunk_id_b from both_have", ", pair as (select a, b, o = p.n and o = q.n as same from both_have") + """
), either as (select a, b, same from pair union all select b, a, same from pair),
class as (select a as id, least(a, coalesce(min(b) filter (same), a)) as class_id from either group by a),
link as (select distinct x.class_id as a, y.class_id as b from either join class x on x.id = either.a join class y on y.id = either.b where x.class_id <> y.class_id),
reach as (select class_id as id, class_id as r from class union select reach.id, link.b from reach join link on link.a = reach.r)
select c.id as chunk_id, c.class_id, (select min(r) from reach where reach.id = c.class_id) as group_id, (select count(*) from link where link.a = c.class_id) as n_links from class c"""


# ---- 3: functions with their documentation


@query
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    pairs = documented_functions(spread(table(spark, d, "python_source")), inherit_tags=False)
    return pairs.filter("doc_origin = 'own'").select("file_id", "symbol_name", "line_number")


@query
def p3_pairs(spark: SparkSession, d: str) -> DataFrame:
    return documented_functions(spread(table(spark, d, "python_source")))


# ---- 4: splitting oversized chunks


def _pieces(spark: SparkSession, d: str) -> DataFrame:
    return split_oversized(_chunks(spark, d, "md_text", "source_site"), "chunk_id", "md_text", "source_site", table(spark, d, "chunk_limit"))


@query
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _pieces(spark, d).filter("piece_no = 0").select(F.col("id").alias("chunk_id"))


SQL["p4_found"] = r"""
with valid as (
  select chunk_id, trim(md_text, ' ' || chr(9) || chr(10) || chr(13)) as text, source_site from doc_chunk
  qualify row_number() over (partition by chunk_id order by loaded_at desc) = 1
)
select chunk_id from valid v left join chunk_limit l on l.source_site = v.source_site
where length(text) > coalesce(l.max_chars, (select max_chars from chunk_limit where source_site = '*'))"""


@query
def p4_pieces(spark: SparkSession, d: str) -> DataFrame:
    return _pieces(spark, d).withColumnRenamed("id", "chunk_id")


@query
def p4_reassembled(spark: SparkSession, d: str) -> DataFrame:
    """The texts that were cut, put together again from their pieces, and whether all pieces
    keep to the limits."""
    limits = table(spark, d, "chunk_limit")
    sites = _chunks(spark, d, "source_site")
    other = limits.filter("source_site = '*'").select(F.struct("max_chars", "overlap_chars").alias("other"))
    of_site = limits.select("source_site", F.struct("max_chars", "overlap_chars").alias("own"))
    limited = sites.join(F.broadcast(of_site), "source_site", "left").join(F.broadcast(other)).select("chunk_id", F.coalesce("own", "other").alias("l"))  # one row for all other sites
    order = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("piece_no", F.expr(c).alias("v")))), lambda x: x["v"])
    pieces = _pieces(spark, d).groupBy(F.col("id").alias("chunk_id")).agg(
        F.concat_ws("", order("substring(piece, overlap + 1, length)")).alias("text"), F.max("length").alias("longest"), F.max("overlap").alias("widest"),
        F.min(F.when(F.col("piece_no") > 0, F.col("overlap"))).alias("narrowest"), F.max(F.abs(F.length("piece") - F.col("length"))).alias("off"),
    )
    kept = (F.col("longest") <= F.col("l.max_chars")) & (F.col("widest") <= F.col("l.overlap_chars")) & (F.col("narrowest") >= F.floor(F.col("l.overlap_chars") * 0.8)) & (F.col("off") == 0)
    return pieces.join(limited, "chunk_id").select("chunk_id", "text", kept.alias("kept"))


SQL["p4_reassembled"] = r"""
with valid as (
  select chunk_id, trim(md_text, ' ' || chr(9) || chr(10) || chr(13)) as text, source_site from doc_chunk
  qualify row_number() over (partition by chunk_id order by loaded_at desc) = 1
)
select chunk_id, text, true as kept from valid v left join chunk_limit l on l.source_site = v.source_site
where length(text) > coalesce(l.max_chars, (select max_chars from chunk_limit where source_site = '*'))"""


# ---- 6: containers


def _sized(spark: SparkSession, d: str) -> DataFrame:
    documents = spread(table(spark, d, "documents").select("doc_id", "source", "text"))
    return with_token_counts(documents, "text", ["doc_id", "source"])


#: Errata don't share a container with the notes that they correct.
APART = (("errata", "release_notes"),)


def _packed(spark: SparkSession, d: str) -> DataFrame:
    documents = spread(table(spark, d, "documents").select("doc_id", "source", "text"))
    alike = NearDuplicates(documents, "doc_id", "text", size=5, threshold=0.8, min_tokens=5, tokens_of=unicode_words, short_whole=True)
    cluster = connected_components(alike.links()).withColumnsRenamed({"id": "class_id", "component": "group_id"})
    copies = alike.copies.join(cluster, "class_id", "left").select(F.col("id").alias("doc_id"), F.coalesce("group_id", "class_id").alias("cluster"))
    alone = cluster.join(alike.copies.select("class_id").distinct(), "class_id", "left_anti").select(F.col("class_id").alias("doc_id"), F.col("group_id").alias("cluster"))
    items = materialize(_sized(spark, d).withColumn("source", source_name(F.col("source"))), "sizes")
    items = items.join(copies.unionByName(alone), "doc_id", "left")
    return pack(items, table(spark, d, "container_size"), APART)


@query
def p6_containers(spark: SparkSession, d: str) -> DataFrame:
    return _packed(spark, d)


@query
def p6_fill(spark: SparkSession, d: str) -> DataFrame:
    return fill_report(materialize(_packed(spark, d), "packed"), table(spark, d, "container_size"))


# ---- 7: mixing sources


def _mix(spark: SparkSession, d: str) -> Mix:
    return Mix(materialize(_sized(spark, d), "sizes"), table(spark, d, "mix_target"))


@query
def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d).mixed()


@query
def p7_deviations(spark: SparkSession, d: str) -> DataFrame:
    """How far each source is ahead of its share or behind it, at most, anywhere in the mix."""
    mix = _mix(spark, d)
    return mix.deviations(materialize(mix.mixed(), "mix"))


@query
def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d).shares()


# ---- 8: languages


def _segments(spark: SparkSession, d: str) -> DataFrame:
    documents = spread(table(spark, d, "documents").select("doc_id", "text", "lang"))
    model = fit_on(documents, "text", "lang", "doc_id")
    return language_segments(documents, "doc_id", "text", model)


@query
def p8_found(spark: SparkSession, d: str) -> DataFrame:
    written = _segments(spark, d).groupBy(F.col("id").alias("doc_id")).agg(F.collect_set("lang_code").alias("codes"))
    labels = table(spark, d, "documents").select("doc_id", label_code(F.col("lang")).alias("label"))
    wrong = (F.size("codes") > 1) | ~F.coalesce(F.col("codes")[0] == F.col("label"), F.lit(False))
    return written.join(labels, "doc_id").filter(wrong).select("doc_id", F.explode("codes").alias("lang_code"))


@query
def p8_segments(spark: SparkSession, d: str) -> DataFrame:
    return _segments(spark, d).withColumnRenamed("id", "doc_id")
