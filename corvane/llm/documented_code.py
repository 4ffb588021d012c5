"""Functions paired with their documentation.

Files are parsed where they lie. A function without a documentation of its own takes
that of the method it overrides: the class hierarchy is joined with itself, again and
again, each time doubling the levels that it spans, until every class has all classes
above it; then the undocumented methods are joined with the methods of these classes,
and the nearest documented one wins. All functions are joined with what was found for
them, and from both the description is chosen. Documentation tags that ask for the inherited text
(`{@inheritDoc}`, `:inherit:`, `inherited` and the like) give way to that text if there
is any.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions.pysource import SYMBOL_SCHEMA, symbol_batches
from corvane.functions.text import drop_admonitions
from corvane.operators.checked import join_measured, measured
from corvane.operators.latest import latest_wide_rows
from corvane.sources.shared import materialize

# What makes a documentation trivial.
MIN_WORDS = 4
UNFINISHED = ("todo", "fixme", "tbd", "xxx", "placeholder")
FILLERS = ("a", "an", "the", "this", "that", "of", "for", "to", "in", "is", "function", "method")
INHERIT_TAG = r"(?i)^\W*(\{?@inheritdoc\}?|:inherit(ed|doc)?:|inherited|see (the )?(base|parent|super) ?(class|method)?)\W*$"
#: Rounds of the hierarchy's closure; 2 to this power is more levels than any has.
MAX_ROUNDS = 30


def words(text: Column) -> Column:
    """Runs of letters and digits in lower case."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def name_words(name: Column) -> Column:
    """A name cut at `_`, `.` and before an upper-case letter after a lower-case one or a digit."""
    return words(F.regexp_replace(name, r"(?<=[\p{Ll}\p{Nd}])(?=\p{Lu})", " "))


def is_trivial(doc: Column, name: Column) -> Column:
    """Too few words, unfinished, or nothing but the name in other words."""
    own = F.concat(name_words(name), F.array(*[F.lit(w) for w in FILLERS]))
    told = words(doc)
    unfinished = F.lit(False)
    for mark in UNFINISHED:
        unfinished = unfinished | F.lower(doc).startswith(mark)
    return (F.size(told) < MIN_WORDS) | unfinished | F.forall(told, lambda w: F.array_contains(own, w))


def classes_above(symbols: DataFrame) -> DataFrame:
    """``low, high, depth, rank, high_class``: every class above each class, over how many
    levels, and by which base of the lower one. A base that the file imports is looked up
    in the module it comes from, by as many parts of the module's name as the import
    gives; another one by the last part of its name, in the same file, else in the lowest
    file_id of the site. Bases that aren't found count for nothing; cycles are harmless."""
    module = F.regexp_replace(F.regexp_replace(F.regexp_replace("path", r"\.py$", ""), r"(^|/)__init__$", ""), "/", ".")
    classes = symbols.filter("symbol_type = 'class'").select("site", "file_id", F.col("name").alias("class"), module.alias("module"), F.arrays_zip("bases", "base_origins").alias("bases"))
    edges = classes.select("site", "file_id", "class", F.posexplode("bases").alias("rank", "b")).select("site", "file_id", "class", "rank", "b.*")
    plain = F.regexp_replace("bases", r"\[.*$", "")
    origin = F.col("base_origins")
    edges = edges.select(
        "site", "file_id", "class", "rank", F.regexp_extract(F.coalesce(origin, plain), r"([^.]*)$", 1).alias("base"), F.regexp_extract(origin, r"^(.*)\.[^.]*$", 1).alias("from_module")
    )
    here = classes.select("site", "file_id", F.col("class").alias("base"), F.col("file_id").alias("_here")).distinct()
    lowest = classes.groupBy("site", F.col("class").alias("base")).agg(F.min("file_id").alias("_lowest"))
    parts = F.split("module", r"\.")
    ends = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, -k, k), "."))
    named = classes.select("site", F.col("class").alias("base"), F.explode(ends).alias("from_module"), "file_id").groupBy("site", "base", "from_module").agg(F.min("file_id").alias("_imported"))
    edges = edges.join(here, ["site", "file_id", "base"], "left").join(lowest, ["site", "base"], "left").join(named, ["site", "base", "from_module"], "left")
    edges = edges.withColumn("target", F.when(F.col("from_module").isNotNull(), F.col("_imported")).otherwise(F.coalesce("_here", "_lowest")))
    direct = edges.filter("target is not null").select(
        F.xxhash64("site", "file_id", "class").alias("low"), F.xxhash64("site", "target", "base").alias("high"), F.lit(1).alias("depth"), "rank", F.col("base").alias("high_class")
    )
    nearest = lambda df: df.filter("low <> high").groupBy("low", "high").agg(F.min(F.struct("depth", "rank", "high_class")).alias("n")).select("low", "high", "n.*")
    above, known = measured(nearest(direct), "classes-above")
    for _ in range(MAX_ROUNDS):
        if not known:
            break
        further = above.select(F.col("low").alias("mid"), F.col("high").alias("top"), F.col("depth").alias("more"), F.col("high_class").alias("top_class"))
        joined = above.join(further, F.col("high") == F.col("mid")).select("low", F.col("top").alias("high"), (F.col("depth") + F.col("more")).alias("depth"), "rank", F.col("top_class").alias("high_class"))
        before = known
        above, known = measured(nearest(above.unionByName(joined)), "classes-above")
        if known == before:
            break
    return above


def documented_functions(files: DataFrame, inherit_tags: bool = True) -> DataFrame:
    """Code and description of every `def` and `async def` of the valid files.

    ``files`` has file_id, source_site, source_file, source_text, loaded_at; of a
    file_id delivered again the latest row counts. Files that don't parse, null and
    empty ones yield nothing. Returns ``file_id, symbol_name, line_number, code,
    description, doc_origin, described_by``: `own` if Python itself takes the text as
    docstring, `inherited` if it comes from an overridden method, named by
    ``described_by``. Functions whose documentation is missing or trivial are dropped.
    A docstring that only asks for the inherited text is replaced by it, but where there
    is none, or a trivial one, it is judged like any other; without ``inherit_tags`` it
    always is.
    A null source_site is a site of its own, a null source_file that of an unnamed module.
    Of methods that a class defines twice the last one is inherited.
    """
    valid = latest_wide_rows(files.select("file_id", "source_site", "source_file", "source_text", "loaded_at"), "file_id")
    source = valid.select("file_id", F.col("source_file").alias("source_path"), "source_text", F.coalesce("source_site", F.lit("")).alias("site"), F.coalesce("source_file", F.lit("")).alias("path"))
    parsed = source.mapInArrow(symbol_batches(2), f"site string, path string, {SYMBOL_SCHEMA}")
    symbols = materialize(parsed.withColumn("doc", drop_admonitions(F.col("own_docstring"))), "symbols")

    functions = symbols.filter("symbol_type in ('function', 'method')")
    lacks = (F.col("doc") == "") | (F.col("doc").rlike(INHERIT_TAG) if inherit_tags else F.lit(False))
    in_class = functions.filter("parent_class is not null").withColumn("low", F.xxhash64("site", "file_id", "parent_class"))
    says = in_class.filter(~lacks).groupBy(F.col("low").alias("high"), "name").agg(F.max_by("doc", "line_number").alias("text"))
    place = ["file_id", "walk_order"]
    wanted = in_class.filter(lacks).select(*place, "name", "low").join(classes_above(symbols), "low").join(says, ["high", "name"])
    nearest = wanted.groupBy(*place).agg(F.min_by(F.struct("text", "high_class"), F.struct("depth", "rank", "high")).alias("told"))
    nearest, n_nearest = measured(nearest, "inherited")

    resolved = join_measured(functions, nearest, n_nearest, place, "left")
    takes = lacks & F.col("told").isNotNull() & ~is_trivial(F.col("told.text"), F.col("symbol_name"))
    described = resolved.select(
        "file_id", "symbol_name", "line_number", "code",
        F.when(takes, F.col("told.text")).otherwise(F.col("doc")).alias("description"),
        F.when(takes, "inherited").otherwise("own").alias("doc_origin"),
        F.when(takes, F.concat_ws(".", "told.high_class", "name")).alias("described_by"),
    )
    return described.filter(~is_trivial(F.col("description"), F.col("symbol_name")))
