"""Schemas and settings of the search side."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

RECORD = T.StructType(
    [
        T.StructField("title", T.StringType()),
        T.StructField("anchor", T.StringType()),
        T.StructField("heading_level", T.IntegerType()),
        T.StructField("md_text", T.StringType()),
        T.StructField("url", T.StringType()),
        T.StructField("page", T.StringType()),
        T.StructField("source_site", T.StringType()),
    ]
)
RECORD_COLUMNS = RECORD.fieldNames()
MAX_SITES = 1_000


@dataclass(frozen=True)
class Site:
    """A documentation site: its name in records, its public base and its local base."""

    name: str
    base_url: str

    @property
    def local_base(self) -> str:
        return f"local://{self.name.replace('_', '-')}/"

    @property
    def remote_base(self) -> str:
        return self.base_url.rstrip("/") + "/"


@dataclass(frozen=True)
class Sites:
    """All sites; what belongs to no other one belongs to the first."""

    all: tuple[Site, ...]

    @classmethod
    def from_config(cls, config: DataFrame) -> Sites:
        """From rows with repo_name and base_url, one a repository, ordered by name; an error
        beyond ``MAX_SITES``, as each site is a branch of the expressions made of them."""
        rows = config.select("repo_name", "base_url").filter("repo_name is not null and base_url is not null").distinct().limit(MAX_SITES + 1).collect()
        if len(rows) > MAX_SITES:
            raise ValueError(f"more than {MAX_SITES} sites")
        return cls(tuple(Site(r["repo_name"], r["base_url"]) for r in sorted(rows)))

    @property
    def first(self) -> Site:
        return self.all[0]

    def named(self, name: str) -> Site | None:
        return next((s for s in self.all if s.name == name), None)

    def display_url(self, site: Column, page: Column) -> Column:
        base = F.lit(self.first.local_base)
        for s in self.all[1:]:
            base = F.when(site == s.name, s.local_base).otherwise(base)
        return F.concat(base, page)


def checked_site(site: Column, allowed: list[str]) -> Column:
    """The site, or an error for one that isn't allowed (null included)."""
    return F.when(site.isin(*allowed), site).otherwise(F.raise_error(F.concat(F.lit("source_site not allowed: "), F.coalesce(site, F.lit("null")))))
