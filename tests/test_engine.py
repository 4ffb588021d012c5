from __future__ import annotations

import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from corvane.__main__ import main
from corvane.functions.urls import api_address, api_url, is_denied, is_within, page_file, resolve
from corvane.operators.chunking import by_chars
from corvane.operators.index import generations
from corvane.plans.engine import Engine, Layout
from corvane.schema import RECORD_COLUMNS, Site, Sites
from corvane.sources.files import count_jsonl, delete, file_stats, python_symbols, read_html, read_jsonl, read_markdown, read_python_symbols, read_search_index, write_jsonl
from corvane.streaming.incremental import append_postings, daily_counts, run_available, stream, term_count_stream, term_counts

SITES = Sites((Site("alpha", "https://a.example/latest"), Site("alpha_two", "https://b.example")))


def html(title, body):
    return f"<nav>Menu</nav><main><h1 id='top'>{title}</h1><p>{body}</p><h2 id='more'>More {title}</h2><p>details</p></main>"


@pytest.fixture
def tree(tmp_path):
    for site, pages in {"one": {"index.html": html("Start", "welcome cache"), "api/index.html": html("Api", "cache cache model")}, "two": {"api/index.html": html("Other", "agent cache")}}.items():
        for rel, text in pages.items():
            path = tmp_path / site / rel
            path.parent.mkdir(parents=True, exist_ok=True)
            path.write_bytes(text.encode() + b"\xff")
    (tmp_path / "src" / "pkg").mkdir(parents=True)
    (tmp_path / "src" / "pkg" / "mod.py").write_text('"""Module text."""\nclass A:\n    """Class text."""\n    def f(self):\n        """Method text."""\ndef g():\n    pass\n')
    (tmp_path / "src" / "bad.py").write_text("def broken(:")
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs" / "indexing.md").write_text("lead\n# One\nbody one\n## Two\n\n## Three\nbody three")
    (tmp_path / "docs" / "latin.md").write_bytes(b"caf\xe9")
    (tmp_path / "data").mkdir()
    return tmp_path


def test_engine(spark, tree):
    engine = Engine(spark, SITES, Layout(str(tree / "data"), {"alpha": str(tree / "one"), "alpha_two": str(tree / "two")}))
    assert engine.ping() == "pong"
    assert not engine.rebuild().first()["success"] and not engine.validate().first()["valid"]
    fallback = engine.search("cache").collect()
    assert [h["url"] for h in fallback] == ["local://alpha/api/index.html", "local://alpha/index.html"] and fallback[0]["score"] == 2
    assert engine.search("cache", heading="more start").first()["heading_title"] == "More Start"
    assert [engine.ingest_html(s) for s in SITES.all] == [4, 2]
    assert engine.rebuild().first()["records"] == 6
    status = engine.status().first()
    assert status["valid"] and status["jsonl_records"] == {"alpha": 4, "alpha_two": 2} and status["html_files"] == {"alpha": 2, "alpha_two": 1} and status["index_mb"] > 0
    assert engine.mode().first()["display_bases"] == {"alpha": "local://alpha/", "alpha_two": "local://alpha-two/"}
    hits = engine.search("agent", k=3).collect()
    assert hits[0]["url"] == "local://alpha-two/api/index.html" and hits[0]["score"] > 0 == hits[1]["score"] and len(hits) == 3
    assert engine.ingest_source(SITES.first, str(tree / "docs"), str(tree / "src")) == 6
    assert engine.rebuild().first()["records"] == 8
    assert engine.search("three").first()["title"] == "Three"  # the new index, not the old one
    view = engine.get("index.html#x", max_chars=20).first()
    assert view["truncated"] and view["url"] == "local://alpha/index.html"
    assert engine.get("api/index.html").first()["url"] == "local://alpha-two/api/index.html"  # the other site's page wins
    assert engine.get("https://a.example/latest/api/index.html").first()["url"] == "local://alpha/api/index.html"
    assert engine.section("local://alpha/index.html", "more").first()["section"] == "More Start\ndetails"
    whole, part = engine.api("Anything").first(), engine.api("Anything", "more").first()
    assert "cache cache model" in whole["text"] and whole["url"] == "local://alpha/api/" and whole["section"] is None
    assert part["section"] == "More Api\ndetails" and part["url"] == "local://alpha/api/#more" and part["text"] is None
    assert engine.api("Anything", "nowhere").first()["section"] == ""
    assert engine.api("Start", aliases={"Start": "index.html"}).first()["url"] == "local://alpha/index.html"
    with pytest.raises(FileNotFoundError):
        engine.api("BaseModel")
    with pytest.raises(FileNotFoundError):
        engine.get("missing.html")
    with pytest.raises(PySparkException, match="denied"):
        engine.get("https://evil.example/x").collect()
    assert generations(spark, engine.layout.index_path) == [1, 2]
    old = engine.index
    engine.rebuild(), engine.rebuild()
    assert generations(spark, engine.layout.index_path) == [3, 4] and engine.index.n == old.n
    delete(spark, f"{engine.layout.index_path}/g00000004.current")  # a build that didn't come to its end
    assert engine.rebuild().first()["success"] and generations(spark, engine.layout.index_path) == [3, 4]
    assert engine.clean() == 0 and engine.clean(force=True) == 3 and not engine.validate().first()["valid"]


def test_prebuilt_search_index(spark, tree):
    engine = Engine(spark, SITES, Layout(str(tree / "data"), {"alpha": str(tree / "one")}))
    path = tree / "one" / "search" / "search_index.json"
    path.parent.mkdir()
    path.write_text("{ not json")
    assert engine.search("cache").count() == 2  # the pages, as the index can't be read
    path.write_text(json.dumps({"docs": [{"location": "a/#x", "title": "cache", "text": "some cache"}, {"location": "b/", "title": "b", "text": "none"}]}))
    assert [(h["url"], h["score"]) for h in engine.search("cache").collect()] == [("local://alpha/a/#x", 4.0)]


def test_build_and_check(spark, tree, monkeypatch):
    monkeypatch.setenv("CORVANE_HTML_ALPHA", str(tree / "one"))
    monkeypatch.setenv("CORVANE_API_ALIASES", '{"Start": "index.html"}')
    (tree / "docs_raw").mkdir()
    (tree / "two").rename(tree / "docs_raw" / "alpha_two")
    below = tree / "docs"
    monkeypatch.chdir(below)
    layout = Layout.from_conf(spark, SITES)
    assert layout.data_dir == str(tree / "data") and layout.html_roots == {"alpha": str(tree / "one"), "alpha_two": str(tree / "docs_raw" / "alpha_two")}
    assert layout.aliases["Start"] == "index.html" and layout.aliases["BaseModel"]
    engine = Engine(spark, SITES, layout)
    assert engine.check().first()["advice"] == "build"
    built = engine.build().first()
    assert built["success"] and built["records"] == 6 and built["written"] == {"alpha": 4, "alpha_two": 2}
    assert engine.check().first()["advice"] == "ready" and engine.api("Start").first()["url"] == "local://alpha/index.html"


def test_chunks_are_sized_in_tokens(spark, tree):
    """The engine counts tokens of the tokenizer, not characters."""
    text = "\n\n".join("internationalization " * 60 for _ in range(40))
    (tree / "docs" / "long.md").write_text(text)
    sizes = {}
    for name, counter in (("tokens", None), ("chars", by_chars)):
        engine = Engine(spark, SITES, Layout(str(tree / "data")), counter)
        engine.ingest_source(SITES.first, str(tree / "docs"))
        rows = read_jsonl(spark, [engine.layout.jsonl(SITES.first)]).filter(F.col("page") == "long").select("md_text").collect()
        sizes[name] = len(rows)
        if name == "tokens":
            counts = [r[0] for r in spark.createDataFrame([(r["md_text"],) for r in rows], "t string").select(engine.counter.one(F.col("t"))).collect()]
            assert engine.counter is not by_chars and max(counts) <= 1200 + 40
    assert sizes["tokens"] != sizes["chars"]


@pytest.mark.parametrize("address", ["http:x", "HTTP:/x", "ht\ttp://x", "https://evil.example", " https://b.exampl"])
def test_denied(spark, address):
    assert spark.createDataFrame([(address,)], "u string").select(is_denied(F.col("u"), SITES)).first()[0]


@pytest.mark.parametrize("address", ["https://b.example/x", "httpx", "api/http:", "local://alpha/x", "ftp://x", ""])
def test_allowed(spark, address):
    assert not spark.createDataFrame([(address,)], "u string").select(is_denied(F.col("u"), SITES)).first()[0]


@pytest.mark.parametrize(
    ("address", "want"),
    [
        ("api/base_model.html#some-anchor", ("alpha", "api/base_model.html")), ("api/../../etc/passwd", ("alpha", "api///etc/passwd")), ("/api/x.html", ("alpha", "api/x.html")),
        (" https://b.example/c/d.html ", ("alpha_two", "c/d.html")), ("local://alpha-two/e.html", ("alpha_two", "e.html")), ("https://a.example/latest/f#g", ("alpha", "f")),
    ],
)
def test_resolve(spark, address, want):
    r = spark.createDataFrame([(address,)], "u string").select(resolve(F.col("u"), SITES).alias("r")).first()["r"]
    assert tuple(r) == want


def test_denied(spark):
    with pytest.raises(PySparkException, match="denied"):
        spark.createDataFrame([("http://x.example/",)], "u string").select(resolve(F.col("u"), SITES)["rel"]).collect()


def test_api_addresses(spark):
    df = spark.createDataFrame([("pkg.base_model",), ("Plain",), ("A.b.C",)], "s string")
    assert [r[0] for r in df.select(api_url(F.col("s"), "https://x/")).collect()] == ["https://x/api/base-model/", "https://x/api/", "https://x/api/b/"]
    address = api_address(F.col("s"), {"Plain": "p/q.html"})
    assert [tuple(r) for r in df.select(address, page_file(address)).collect()] == [("api/", "api/index.html"), ("p/q.html", "p/q.html"), ("api/", "api/index.html")]


def test_jsonl(spark, tmp_path):
    lines = [{"title": f"t{k}", "anchor": None, "heading_level": 1, "md_text": f"é {k}", "url": "u", "page": "p", "source_site": "alpha"} for k in range(30)]
    (tmp_path / "a.jsonl").write_text("\n".join(json.dumps(x) for x in lines[:10]) + "\n\n  \n")
    (tmp_path / "b.jsonl").write_text("\n".join(json.dumps(x, ensure_ascii=False) for x in lines[10:]))
    paths = [str(tmp_path / n) for n in ("a.jsonl", "missing.jsonl", "b.jsonl")]
    got = read_jsonl(spark, paths)
    assert [r["title"] for r in got.orderBy("ord").collect() if r["title"]] == [x["title"] for x in lines]
    out = str(tmp_path / "out")
    assert write_jsonl(got.filter("title is not null"), out, single_file=True) == 30 == count_jsonl(spark, out)
    text = spark.read.text(out).first()[0]
    assert '"anchor":null' in text and list(json.loads(text)) == RECORD_COLUMNS
    (tmp_path / "bad.jsonl").write_text('{"title": ')
    with pytest.raises(Exception, match="Malformed"):
        read_jsonl(spark, [str(tmp_path / "bad.jsonl")]).collect()
    assert read_jsonl(spark, [paths[1]]).count() == 0 == count_jsonl(spark, paths[1])


def test_files(spark, tree):
    assert sorted(r["path"] for r in read_html(spark, str(tree / "one")).collect()) == ["api/index.html", "index.html"]
    assert [r["path"] for r in read_markdown(spark, str(tree / "docs")).collect()] == ["indexing.md"]
    found = {r["symbol_name"]: r for r in read_python_symbols(spark, str(tree / "src")).collect()}
    assert set(found) == {"mod", "A", "A.f"} and found["A.f"]["symbol_type"] == "method" and found["A.f"]["parent_class"] == "A" and found["A.f"]["line_number"] == 4
    assert file_stats(spark, str(tree / "one"), "*.html").first()["files"] == 2 and file_stats(spark, str(tree / "none"), "*").first()["bytes"] == 0
    (tree / "search_index.json").write_text(json.dumps({"docs": [{"location": "a", "title": "b", "text": "c"}]}))
    assert read_search_index(spark, str(tree / "search_index.json")).first()["text"] == "c"
    nothing = spark.createDataFrame([(1, None, None), (2, "x.py", "def f(:")], "file_id long, path string, text string")
    assert python_symbols(nothing).count() == 0


def test_streams(spark, tmp_path):
    schema = "ord long, md_text string, loaded_at timestamp"
    for k in range(3):
        spark.createDataFrame([(k, f"cache item{k} cache", None)], schema).withColumn("loaded_at", F.expr(f"timestamp'2025-01-0{k + 1} 10:00:00'")).write.parquet(str(tmp_path / "in" / f"f{k}"))
    source = lambda: stream(spark, str(tmp_path / "in" / "*"), spark.read.parquet(str(tmp_path / "in" / "f0")).schema, files_per_batch=1)
    target = str(tmp_path / "counts")
    assert term_counts(spark, target).count() == 0
    for _ in range(2):  # the second time nothing is new
        term_count_stream(source(), target, str(tmp_path / "count-offsets")).awaitTermination()
        counts = {r["term"]: r["occurrences"] for r in term_counts(spark, target).collect()}
        assert counts == {"cache": 6, "item0": 1, "item1": 1, "item2": 1}
    assert [r["n"] for r in run_available(daily_counts(source())).collect()] == [1, 1, 1]
    append_postings(source(), str(tmp_path / "index"), str(tmp_path / "offsets")).awaitTermination()
    append_postings(source(), str(tmp_path / "index"), str(tmp_path / "offsets")).awaitTermination()  # nothing new
    assert spark.read.parquet(str(tmp_path / "index" / "postings")).filter("term = 'cache'").agg(F.sum("tf")).first()[0] == 6


def test_command_line(spark, tree, capsys):
    options = ["--data-dir", str(tree / "cli"), "--site", "alpha=https://a.example/latest", "--html", f"alpha={tree / 'one'}"]
    assert main([*options, "ingest", "alpha"]) == 0
    assert main([*options, "rebuild"]) == 0
    assert main([*options, "search", "model", "-k", "1"]) == 0
    assert main([*options, "status"]) == 0
    lines = capsys.readouterr().out.strip().split("\n")
    assert lines[0] == "4" and json.loads(lines[1])["records"] == 4
    assert json.loads(lines[2])["url"] == "local://alpha/api/index.html" and json.loads(lines[3])["valid"]
    with pytest.raises(SystemExit):
        main([*options, "ingest", "beta"])


def test_is_within():
    assert is_within("/a/b", "c/d") and is_within("/a/b", "") and is_within("/a/b", "c/../d")
    assert not is_within("/a/b", "../c") and not is_within("/a/b", "/etc") and not is_within("/a/b", "../bc")
