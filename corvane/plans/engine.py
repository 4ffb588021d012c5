"""The engine: documentation in, ranked answers and pages out, every result a DataFrame."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions.html import headings, text_by_blank
from corvane.functions.token_sizes import TOKENIZER, tokenizer
from corvane.functions.urls import API_ALIASES, is_within, resolve
from corvane.operators.chunking import Counter, by_chars
from corvane.operators.index import Index, build_index, generations, load_index
from corvane.operators.records import html_records
from corvane.operators.search import search
from corvane.operators.sections import docstring_records, markdown_records, union_records
from corvane.plans.pages import api_views, page_views, section_views
from corvane.schema import Site, Sites
from corvane.sources.files import count_jsonl, delete, exists, file_stats, read_html, read_jsonl, read_markdown, read_python_symbols, read_search_index, write_jsonl

MB = 1048576
#: Where a site's HTML keeps the search index it was published with.
SEARCH_INDEX = "search/search_index.json"


@dataclass
class Layout:
    """Where things are: a folder of raw HTML a site, JSON-lines files, and the index."""

    data_dir: str
    html_roots: dict[str, str] = field(default_factory=dict)
    #: Pages of symbols that have one of their own; None: the built-in ones.
    aliases: dict[str, str] | None = None

    @classmethod
    def from_conf(cls, spark: SparkSession, sites: Sites) -> Layout:
        """From the session's ``corvane.data.dir``, ``corvane.html.<site>`` and
        ``corvane.api.aliases`` (JSON, added to the built-in aliases), else from the
        environment's ``CORVANE_DATA_DIR``, ``CORVANE_HTML_<SITE>`` and
        ``CORVANE_API_ALIASES``. Folders that are named nowhere are looked for as
        ``data`` and ``docs_raw/<site>`` in the working folder and those above it.
        """

        def setting(name: str) -> str:
            return spark.conf.get(f"corvane.{name}", None) or os.environ.get("CORVANE_" + name.replace(".", "_").replace("-", "_").upper(), "")

        root = find_root(spark, os.getcwd())
        roots = {s.name: setting(f"html.{s.name}") or f"{root}/docs_raw/{s.name}" for s in sites.all}
        named = setting("api.aliases")
        return cls(setting("data.dir") or f"{root}/data", {k: v for k, v in roots.items() if exists(spark, v)}, API_ALIASES | json.loads(named) if named else None)

    @property
    def index_path(self) -> str:
        return f"{self.data_dir}/index"

    def jsonl(self, site: Site) -> str:
        return f"{self.data_dir}/{site.name}.jsonl"


def find_root(spark: SparkSession, folder: str) -> str:
    """The nearest folder, from ``folder`` upwards, that holds ``data`` or ``docs_raw``, else
    ``folder`` itself."""
    at = folder.rstrip("/")
    while at:
        if exists(spark, f"{at}/data") or exists(spark, f"{at}/docs_raw"):
            return at
        at = at.rpartition("/")[0]
    return folder


class Engine:
    """``counter`` sizes the chunks of what is ingested: by default tokens of the public
    tokenizer, or four characters a token where its rank file isn't there."""

    def __init__(self, spark: SparkSession, sites: Sites, layout: Layout, counter: Counter | None = None):
        self.spark, self.sites, self.layout = spark, sites, layout
        self.counter = counter or (tokenizer() if os.path.exists(TOKENIZER) else by_chars)
        self._index: Index | None = None

    # ---- ingestion

    def ingest_html(self, site: Site) -> int:
        """HTML files of a site to its JSON lines; no files, nothing written."""
        root = self.layout.html_roots.get(site.name)
        if not root or not exists(self.spark, root):
            return 0
        pages = read_html(self.spark, root).withColumn("source_site", F.lit(site.name))
        records = html_records(pages, site.base_url, counter=self.counter).orderBy("path", "pos", "part")
        return write_jsonl(records, self.layout.jsonl(site))

    def ingest_source(self, site: Site, docs: str | None = None, source: str | None = None) -> int:
        """Markdown below ``docs`` and docstrings below ``source`` to the site's JSON lines."""
        branches = []
        if docs:
            branches.append(markdown_records(read_markdown(self.spark, docs).withColumn("source_site", F.lit(site.name)), site.base_url, counter=self.counter))
        if source:
            branches.append(docstring_records(read_python_symbols(self.spark, source).withColumn("source_site", F.lit(site.name)), site.base_url, counter=self.counter))
        if not branches:
            return 0
        return write_jsonl(union_records(branches).orderBy("branch", "path", "pos", "part"), self.layout.jsonl(site))

    def rebuild(self) -> DataFrame:
        """Index all JSON lines anew and use the new index from now on."""
        paths = [self.layout.jsonl(s) for s in self.sites.all]
        if not any(exists(self.spark, p) for p in paths):
            return self._row(success=False, message="no JSON lines found", records=0)
        self._index = build_index(read_jsonl(self.spark, paths), self.layout.index_path)
        return self._row(success=True, message="index rebuilt", records=self._index.n)

    @property
    def index(self) -> Index:
        if self._index is None:
            self._index = load_index(self.spark, self.layout.index_path)
        return self._index

    def build(self) -> DataFrame:
        """Ingest the HTML of every site and index it: one row a site, and whether the index is
        new."""
        written = {s.name: self.ingest_html(s) for s in self.sites.all}
        done = self.rebuild().first()
        return self._row(success=done["success"], message=done["message"], records=done["records"], written=written)

    def check(self) -> DataFrame:
        """What is missing before the first query: one row with all of it, and what to do."""
        index = bool(self.validate().first()["valid"])
        lines = {s.name: exists(self.spark, self.layout.jsonl(s)) for s in self.sites.all}
        html = {s.name: s.name in self.layout.html_roots and exists(self.spark, self.layout.html_roots[s.name]) for s in self.sites.all}
        advice = "ready" if index else "rebuild" if any(lines.values()) else "build" if any(html.values()) else "no documentation found"
        return self._row(index=index, jsonl=lines, html=html, advice=advice)

    # ---- queries

    def search(self, query: str, k: object = 10, site: str | None = None, heading: str | None = None, keywords: str | None = None) -> DataFrame:
        """BM25 over the index; without one, substring counts over the first site's prebuilt
        search index, and without that over its pages."""
        if self._index is not None or generations(self.spark, self.layout.index_path):
            return search(self.index, query, self.sites, k, site, heading, keywords)
        prebuilt = self._prebuilt()
        if prebuilt is not None:
            return search(prebuilt, query, self.sites, k, site, heading, keywords)
        pages = self.pages().filter(F.col("site") == self.sites.first.name)
        stem = F.regexp_extract("rel", r"([^/]*?)(\.[^./]*)?$", 1)
        records = pages.select(F.xxhash64("rel").alias("ord"), stem.alias("title"), text_by_blank("html").alias("md_text"), F.col("rel").alias("page"), F.col("site").alias("source_site"))
        titles = pages.select(F.col("rel").alias("page"), F.posexplode(headings("html")).alias("pos", "h")).select("page", "pos", "h.title")
        return search(records, query, self.sites, k, site, heading, keywords, titles)

    def _prebuilt(self) -> DataFrame | None:
        """Records of the search index that came with the first site's HTML, if it can be read."""
        first = self.sites.first.name
        path = f"{self.layout.html_roots.get(first, '')}/{SEARCH_INDEX}"
        if not exists(self.spark, path):
            return None
        docs = read_search_index(self.spark, path)
        if docs.limit(1).count() == 0:
            return None
        return docs.select(F.xxhash64("location").alias("ord"), "title", F.col("text").alias("md_text"), F.col("location").alias("page"), F.lit(first).alias("source_site"))

    def pages(self) -> DataFrame:
        found = None
        for site in self.sites.all:
            root = self.layout.html_roots.get(site.name)
            if root and exists(self.spark, root):
                part = read_html(self.spark, root).select(F.lit(site.name).alias("site"), F.col("path").alias("rel"), F.col("text").alias("html"))
                found = part if found is None else found.unionByName(part)
        return found if found is not None else self.spark.createDataFrame([], "site string, rel string, html string")

    def _page(self, path_or_url: str) -> DataFrame:
        pages = self.pages()
        others = [s.name for s in self.sites.all[1:]]
        plain = self.spark.range(1).select(resolve(F.lit(path_or_url), self.sites).alias("r")).first()["r"]
        site, rel = plain["site"], plain["rel"]
        if site == self.sites.first.name and "://" not in path_or_url:
            elsewhere = pages.filter((F.col("rel") == rel) & F.col("site").isin(others)).select("site").first() if others else None
            site = elsewhere["site"] if elsewhere else site
        page = pages.filter((F.col("site") == site) & (F.col("rel") == rel))
        if not is_within(self.layout.html_roots.get(site, ""), rel):
            raise FileNotFoundError(rel)
        if page.limit(1).count() == 0:
            raise FileNotFoundError(rel)
        return page

    def get(self, path_or_url: str, max_chars: int | None = None) -> DataFrame:
        return page_views(self._page(path_or_url), self.sites, max_chars)

    def section(self, path_or_url: str, anchor: str) -> DataFrame:
        return section_views(self._page(path_or_url), self.sites, F.lit(anchor))

    def api(self, symbol: str, anchor: str | None = None, aliases: dict[str, str] | None = None) -> DataFrame:
        symbols = self.spark.range(1).select(F.lit(symbol).alias("symbol"))
        found = api_views(self.pages(), self.sites, symbols, F.lit(anchor) if anchor else None, aliases or self.layout.aliases)
        if found.filter(F.coalesce("text", "section").isNotNull()).limit(1).count() == 0:
            raise FileNotFoundError(symbol)
        return found

    # ---- administration

    def ping(self) -> str:
        return "pong"

    def validate(self) -> DataFrame:
        """Whether the index is there and can be read, and its size."""
        path = self.layout.index_path
        present = bool(generations(self.spark, path))
        size = file_stats(self.spark, path, "*.parquet").first()["bytes"] / MB
        try:
            records = load_index(self.spark, path).n if present else 0
            valid, message = present, "index is valid" if present else "index is missing"
        except Exception as e:  # an index that can't be read is what this reports
            records, valid, message = 0, False, f"index can't be read: {type(e).__name__}"
        return self._row(valid=valid, message=message, index_present=present, index_mb=size, records=records)

    def mode(self) -> DataFrame:
        counts = {s.name: file_stats(self.spark, self.layout.html_roots.get(s.name, "/nonexistent"), "*.html").first()["files"] for s in self.sites.all}
        return self._row(
            offline_only=True, data_dir=self.layout.data_dir, index_present=bool(generations(self.spark, self.layout.index_path)), html_files=counts, display_bases={s.name: s.local_base for s in self.sites.all}
        )

    def status(self) -> DataFrame:
        counts = self.mode().first()
        lines = {s.name: count_jsonl(self.spark, self.layout.jsonl(s)) for s in self.sites.all}
        valid = self.validate().first()
        return self._row(html_files=counts["html_files"], jsonl_records=lines, index_present=valid["index_present"], index_mb=valid["index_mb"], valid=valid["valid"], offline_mode=True)

    def clean(self, force: bool = False) -> int:
        """Delete JSON lines and the index; only if ``force``."""
        if not force:
            return 0
        self._index = None
        return sum(delete(self.spark, p) for p in [*(self.layout.jsonl(s) for s in self.sites.all), self.layout.index_path])

    def _row(self, **values) -> DataFrame:
        def literal(v):
            return F.create_map(*[F.lit(x) for item in v.items() for x in item]) if isinstance(v, dict) else F.lit(v)

        return self.spark.range(1).select(*[literal(v).alias(k) for k, v in values.items()])
