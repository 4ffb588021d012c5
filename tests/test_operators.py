from __future__ import annotations

import random
from collections import Counter
from types import SimpleNamespace


import pytest
from pyspark.sql import functions as F

from corvane.operators import rank
from corvane.operators.chunking import by_words, chunk_markdown, chunk_text, slices
from corvane.operators.components import connected_components
from corvane.operators.index import build_index, scan_index
from corvane.operators.latest import latest_rows, latest_wide_rows
from corvane.operators.rank import bm25_many, bm25_top, substring_top
from corvane.operators.running import running_sum
from corvane.operators.search import clamp_k, search
from corvane.operators.sections import markdown_records, sections
from corvane.operators.snapshots import canonical_url, layout_free, snapshot_changes
from corvane.schema import Site, Sites, checked_site
from corvane.sources.shared import materialize, shared_dir

SITES = Sites((Site("alpha", "https://a.example/latest"), Site("alpha_two", "https://b.example/")))


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"t {kind}").select(f(F.col("t")).alias("x")).first()[0]


@pytest.mark.parametrize("latest", [lambda d: latest_rows(d, ["k"], "at"), lambda d: latest_wide_rows(d, "k", "at")])
def test_latest(spark, latest):
    rows = [(1, 1, "old"), (1, 2, "new"), (2, None, "only"), (3, None, "null"), (3, 0, "known"), (None, 9, "lost"), *[(4, 5, "same")] * 50, (5, 7, "x"), (5, 7, "y")]
    df = spark.createDataFrame(rows, "k int, at int, _rank string").withColumn("_tie", F.lit(1)).withColumn("_repeated", F.lit(2))
    got = sorted((r["k"], r["_rank"]) for r in latest(df).collect())
    assert got[:4] == [(1, "new"), (2, "only"), (3, "known"), (4, "same")]
    assert len(got) == 5 and got[4][0] == 5
    assert latest(df).columns == df.columns
    assert latest(df.limit(0)).count() == 0


def test_latest_ways_agree(spark):
    random.seed(1)
    rows = [(random.randint(0, 200), random.randint(0, 10**6), f"t{k}") for k in range(1000)]
    df = spark.createDataFrame(rows, "k int, at int, t string")
    assert sorted(latest_rows(df, ["k"], "at").collect()) == sorted(latest_wide_rows(df, "k", "at").collect())


def test_components(spark):
    random.seed(2)
    links = [(random.randint(0, 300), random.randint(0, 300)) for _ in range(140)] + [(k, k + 1) for k in range(1000, 1040)] + [(5000, k) for k in range(5001, 5100)] + [(7, 7), (None, 1)]
    parent: dict = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        if a is not None:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = {r["id"]: r["component"] for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for x in parent}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_running_sum(spark):
    rows = [("hot" if k % 3 else "cold", k, k % 7 if k % 11 else None) for k in range(500)]
    df = spark.createDataFrame(rows, "g string, k long, v long")
    for rows_said in (10, 10**6):
        out = running_sum(df, "g", "k", "v", rows_said).withColumn("h", F.xxhash64("k")).collect()
        for g in ("hot", "cold"):
            part = sorted((r for r in out if r["g"] == g), key=lambda r: (r["h"] % 2**64 if rows_said > 10 else r["h"], r["k"]))
            total = 0
            for r in part:
                assert r["before"] == total
                total += r["v"] or 0


def pack(paragraphs, limit):
    out, cur, n = [], [], 0
    for p in paragraphs:
        t = len(p.split())
        if n + t > limit and cur:
            out.append("\n\n".join(cur))
            cur, n = [], 0
        cur.append(p)
        n += t
    return [*out, "\n\n".join(cur)] if cur else out


def test_chunking(spark):
    random.seed(3)
    for _ in range(6):
        paragraphs = [" ".join("w" * random.randint(1, 4) for _ in range(random.randint(0, 30))) for _ in range(20)]
        text = "\n\n".join(paragraphs)
        assert one(spark, text, lambda c: chunk_text(c, 25, by_words)) == pack(paragraphs, 25)
        assert one(spark, text, lambda c: chunk_markdown(c, 25, by_words)) == [c.strip() for c in pack(paragraphs, 25) if c.strip()]
    assert one(spark, "", lambda c: chunk_text(c)) == [] and one(spark, None, lambda c: chunk_text(c)) == []
    assert one(spark, " Short ", lambda c: chunk_text(c)) == [" Short "] and one(spark, " Short ", lambda c: chunk_markdown(c)) == ["Short"]
    assert one(spark, None, lambda c: chunk_markdown(c)) == [""]
    assert one(spark, "x" * 10000, lambda c: slices(c)) == ["x" * 4800, "x" * 4800, "x" * 400]
    assert one(spark, "x" * 9000 + "\n\n" + "y", lambda c: chunk_text(c)) == ["x" * 9000, "y"]
    many = [f"{k} and" for k in range(30_000)]
    assert one(spark, "\n\n".join(many), lambda c: chunk_text(c, 25, by_words)) == ["\n\n".join(many[k : k + 12]) for k in range(0, len(many), 12)]


def test_sections(spark):
    text = "lead\n# One\nbody\n\n```\n# not code\nx\n```\n## Empty\n\n## Two (2)\nmore\n#nothing\n"
    got = [tuple(s) for s in one(spark, text, sections)]
    assert got == [(0, None, None, "lead"), (1, "One", "one", "body\n\n```"), (1, "not code", "not-code", "x\n```"), (2, "Two (2)", "two-2", "more\n#nothing")]
    files = spark.createDataFrame([("docs/indexing.md", "# A b\nx", "alpha"), ("docs/index.md", "y", "alpha"), ("n.md", None, "alpha")], "path string, text string, source_site string")
    out = {r["path"]: r for r in markdown_records(files, "https://a.example/").collect()}
    assert out["docs/indexing.md"]["page"] == "docs/ing" and out["docs/indexing.md"]["url"] == "https://a.example/docs/ing/#a-b"
    assert out["docs/index.md"]["title"] == "index" and out["docs/index.md"]["url"] == "https://a.example/docs/" and "n.md" not in out


def brute_bm25(texts, query):
    from math import log

    docs = [[t for t in __import__("re").split("[^a-z0-9_#-]+", (x or "").lower()) if len(t) > 1] for x in texts]
    n, avg = len(docs), sum(map(len, docs)) / len(docs)
    df = Counter(t for d in docs for t in set(d))
    raw = {t: log(n - f + 0.5) - log(f + 0.5) for t, f in df.items()}
    mean = sum(raw.values()) / len(raw)
    idf = {t: r if r >= 0 else 0.25 * mean for t, r in raw.items()}
    return [round(sum(idf.get(t, 0) * d.count(t) * 2.5 / (d.count(t) + 1.5 * (0.25 + 0.75 * len(d) / avg)) for t in query), 6) for d in docs]


@pytest.fixture(scope="module")
def corpus(spark):
    random.seed(4)
    words = ["cache", "model", "the", "field", "agent", "x1", "tool"]
    texts = [" ".join(random.choice(words[: random.randint(1, 7)]) for _ in range(random.randint(0, 20))) for _ in range(60)] + [None, ""]
    rows = [(k, f"T{k}", None, 0, t, "u", f"p{k % 5}.html", "alpha_two" if k % 4 == 0 else "alpha") for k, t in enumerate(texts)]
    records = spark.createDataFrame(rows, "ord long, title string, anchor string, heading_level int, md_text string, url string, page string, source_site string")
    return texts, records, build_index(records)


@pytest.mark.parametrize("query", ["cache model cache", "nothing here", "the", ""])
def test_bm25(corpus, query):
    texts, _, index = corpus
    scores = brute_bm25(texts, query.split())
    want = sorted(range(len(texts)), key=lambda k: (-scores[k], k))[:20]
    got = bm25_top(index, query, 20).orderBy(F.desc("score"), "ord").collect()
    assert [(r["ord"], r["score"]) for r in got] == [(k, pytest.approx(scores[k], abs=2e-6)) for k in want]


def test_bm25_many(spark, corpus):
    texts, _, index = corpus
    asked = spark.createDataFrame([(1, "cache model"), (2, "agent"), (3, ""), (4, None)], "query_id int, text string")
    got = bm25_many(index, asked, 3).collect()
    for q, words in ((1, ["cache", "model"]), (2, ["agent"])):
        scores = brute_bm25(texts, words)
        holds = [k for k, t in enumerate(texts) if set(words) & set((t or "").split())]
        want = sorted(holds, key=lambda k: (-scores[k], k))[:3]
        assert [r["ord"] for r in sorted((x for x in got if x["query_id"] == q), key=lambda r: r["rank"])] == want
    assert {r["query_id"] for r in got} == {1, 2}


def test_empty_index(spark, corpus):
    index = build_index(corpus[1].limit(0))
    assert bm25_top(index, "cache").count() == 0 and index.n == 0


def test_search(spark, corpus):
    texts, records, index = corpus
    hits = search(index, "cache", SITES, k=10, site="alpha_two").collect()
    best = [r["ord"] for r in bm25_top(index, "cache", 30).orderBy(F.desc("score"), "ord").collect()]
    assert [h["ord"] for h in hits] == [k for k in best if k % 4 == 0][:10]  # filtered after the cut
    assert all(h["url"].startswith("local://alpha-two/") for h in hits)
    assert len(search(index, "cache", SITES, k=10, site="unknown").collect()) == 10
    assert search(index, "cache", SITES, keywords="zzz").count() == 0
    assert all("model" in h["snippet"].lower() for h in search(index, "cache", SITES, heading="MODEL").collect())
    assert len(search(index, "", SITES, k=99).collect()) == 50
    counts = [3 * f"t{k}".count("cache") + (t or "").count("cache") for k, t in enumerate(texts)]
    want = sorted((k for k in range(len(texts)) if counts[k]), key=lambda k: (-counts[k], k))[:10]
    assert [h["ord"] for h in search(records, "Cache", SITES).collect()] == want
    assert substring_top(records, "", 5).first()["ord"] == max(range(len(texts)), key=lambda k: (len(texts[k] or "") + 3 * len(f"t{k}"), -k))
    assert [clamp_k(x) for x in (0, 7, 999, "5", None, "x")] == [1, 7, 50, 5, 10, 10]


def test_checked_site(spark):
    with pytest.raises(Exception, match="not allowed"):
        one(spark, "wrong", lambda c: checked_site(c, ["alpha"]))
    assert one(spark, "alpha", lambda c: checked_site(c, ["alpha"])) == "alpha"


URLS = [("HTTPS://Docs.Example/Aa/b//#Frag/", "https://docs.example/Aa/b#Frag/"), ("https://x.y", "https://x.y"), ("https://x.y/", "https://x.y"), ("plain/Path/", "plain/Path"), ("", ""), ("https://x.y/a/?q=/", "https://x.y/a?q=/")]


@pytest.mark.parametrize(("url", "want"), URLS)
def test_canonical_url(spark, url, want):
    assert one(spark, url, canonical_url) == want


def test_snapshots(spark):
    random.seed(5)
    rows, k = [], 0
    for snap in (1, 2, 4, 7):
        for record in range(60):
            for _ in range(random.choice([0, 1, 1, 1, 2])):
                text = random.choice(["a b", "a  b ", "a\u00a0b", "A b", None, "", "c"])
                rows.append((k, snap, f"HTTP://Host/{record}" + random.choice(["", "/"]), text, random.randint(0, 10**9)))
                k += 1
    rows += [(k + j, 2, "http://host/hot", "same", 5) for j in range(300)] + [(k + 900, None, "http://host/1", "x", 1), (k + 901, 1, None, "x", 1)]
    df = spark.createDataFrame(rows, "row_id long, snapshot_no int, url string, md_text string, loaded_at long").withColumn("record", F.lit(0)).withColumn("hash", F.lit(0))
    valid: dict = {}
    for i, snap, url, text, at in rows:
        if snap is None or url is None:
            continue
        record = "http://host" + url[11:].rstrip("/")
        if at >= valid.setdefault(snap, {}).get(record, (-1,))[0]:
            valid[snap][record] = (at, " ".join((text or "").replace("\u00a0", " ").split()))
    want = set()
    for before, after in ((1, 2), (2, 4), (4, 7)):
        for r in valid[before].keys() | valid[after].keys():
            a, b = valid[before].get(r), valid[after].get(r)
            if a is None or b is None or a[1] != b[1]:
                want.add((after, r, "added" if a is None else "removed" if b is None else "changed"))
    out = snapshot_changes(df, "snapshot_no", canonical_url(F.col("url")), layout_free(F.col("md_text")))
    got = [(r["snapshot"], r["record"], r["diff_kind"]) for r in out.collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert snapshot_changes(df.limit(0), "snapshot_no", F.col("url"), F.col("md_text")).count() == 0
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan  # buckets meet buckets


def test_shared_folder(spark):
    named = SimpleNamespace(sparkContext=None, conf=SimpleNamespace(get=lambda key, default: {"spark.checkpoint.dir": "hdfs://x/shared/"}.get(key, default)))
    assert shared_dir(named) == "hdfs://x/shared"
    kept = materialize(spark.range(5), "five")
    assert kept.count() == 5 and "/five-" in kept.inputFiles()[0]


def shuffled_rows(spark, since):
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    new = spark.sparkContext._jvm.java.util.ArrayList
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(new(), False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), new())
    found = [stages.apply(i) for i in range(stages.size())]
    return max((s.stageId() for s in found), default=-1), sum(s.shuffleWriteRecords() for s in found if s.stageId() > since)


def test_bm25_many_shuffles_no_pairs(spark):
    records = spark.range(1000).select(F.col("id").alias("ord"), F.concat(F.lit("cache model "), F.repeat(F.lit("x1 "), F.col("id").cast("int") % 7)).alias("md_text"))
    index = scan_index(records)
    asked = spark.range(300).select(F.col("id").alias("query_id"), F.lit("cache model x1").alias("text"))
    before, _ = shuffled_rows(spark, -1)
    assert bm25_many(index, asked, 5).count() == 1500
    _, rows = shuffled_rows(spark, before)
    assert 0 < rows < 20_000  # 300,000 pairs of query and record; the postings are 2,857


@pytest.mark.parametrize("sizes", [{}, {"BLOCK_POSTINGS": 20, "ENTRIES_AT_ONCE": 30, "COMMON": 5}])
@pytest.mark.parametrize("k", [1, 3])
def test_bm25_many_blocks(spark, monkeypatch, sizes, k):
    for name, value in sizes.items():
        monkeypatch.setattr(rank, name, value)
    rng = random.Random(7)
    words = [f"w{n}" for n in range(12)]
    # the first two words are in most records, so that they weigh less than nothing or little; copies tie
    texts = [" ".join([rng.choice(words[:2]) for _ in range(rng.randint(0, 3))] + [rng.choice(words[: rng.randint(1, 12)]) for _ in range(rng.randint(0, 6))]) for _ in range(150)] * 2
    keys = rng.sample(range(10_000), len(texts))
    index = scan_index(spark.createDataFrame(list(zip(keys, texts, strict=True)), "ord long, md_text string"))
    queries = [" ".join(rng.choices(words, k=rng.randint(1, 5))) for _ in range(40)] + ["w3 w4"] * 20 + ["unknown", "w5 unknown"]
    got = bm25_many(index, spark.createDataFrame(list(enumerate(queries)), "query_id int, text string"), k).collect()
    assert sorted(r["query_id"] for r in got) == sorted(q for q, text in enumerate(queries) if text != "unknown" for _ in range(k))
    for q, text in enumerate(queries):
        scores = brute_bm25(texts, text.split())
        holds = [n for n, t in enumerate(texts) if set(text.split()) & set(t.split())]
        want = sorted(holds, key=lambda n: (-scores[n], keys[n]))[:k]
        mine = sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])
        assert [(r["rank"], r["ord"]) for r in mine] == [(n + 1, keys[i]) for n, i in enumerate(want)]
        assert [r["score"] for r in mine] == pytest.approx([scores[i] for i in want], abs=2e-6)


def test_bm25_many_below_zero(spark):
    """Where every word is in most records all weights are below 0, and so are the scores."""
    texts = ["aa bb", "aa bb bb", "aa", "bb bb bb", "aa aa bb", "bb aa bb", ""]
    index = scan_index(spark.createDataFrame(list(enumerate(texts)), "ord long, md_text string"))
    assert index.avg_idf < 0
    got = bm25_many(index, spark.createDataFrame([(1, "aa bb"), (2, "bb")], "query_id int, text string"), 4).collect()
    for q, words in ((1, ["aa", "bb"]), (2, ["bb"])):
        scores = brute_bm25(texts, words)
        want = sorted((n for n, t in enumerate(texts) if set(words) & set(t.split())), key=lambda n: (-scores[n], n))[:4]
        assert [r["ord"] for r in sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])] == want


def test_scan_index(spark, corpus):
    _, records, index = corpus
    got = scan_index(records)
    assert (got.n, got.avgdl, got.avg_idf) == pytest.approx((index.n, index.avgdl, index.avg_idf))
    for table, columns in (("postings", ["term", "ord", "tf", "dl"]), ("docs", ["ord", "dl"]), ("terms", ["term", "df"])):
        assert sorted(getattr(got, table).select(columns).collect()) == sorted(getattr(index, table).select(columns).collect())


def test_bm25_many_nothing_known(spark, corpus):
    _, records, index = corpus
    asked = spark.createDataFrame([(1, "unknown"), (2, None)], "query_id int, text string")
    assert bm25_many(index, asked, 3).collect() == []
    assert bm25_many(scan_index(records.limit(0)), asked, 3).collect() == []
    assert bm25_many(index, spark.createDataFrame([(1, "cache")], "query_id int, text string"), 0).collect() == []
