"""URL and path functions as column expressions."""

from __future__ import annotations

import posixpath

from pyspark.sql import Column
from pyspark.sql import functions as F

from corvane.functions.text import strip
from corvane.schema import Sites

# Pages of symbols that have one of their own; a parameter of
# ``api_address``, and of the engine's settings.
API_ALIASES = {"BaseModel": "api/base_model/", "TypeAdapter": "api/type_adapter/", "ValidationError": "api/errors/"}
API_DEFAULT = "api/"


def is_denied(s: Column, sites: Sites) -> Column:
    """True for addresses of the scheme http or https, whatever follows it, outside the known
    bases. Tabs and line ends don't hide a scheme."""
    allowed = F.lit(False)
    for site in sites.all:
        allowed = allowed | s.startswith(site.remote_base)
    return F.translate(s, "\t\r\n", "").rlike(r"^(?i)[\x00-\x20]*https?:") & ~allowed


def resolve(path_or_url: Column, sites: Sites, exists_elsewhere: Column | None = None) -> Column:
    """struct(site, rel) of an address or a relative path; an error for denied addresses.

    ``exists_elsewhere`` names, for relative paths, a site other than the first that has
    the page (null: the first).
    """
    s = strip(path_or_url)
    site, rest = F.coalesce(exists_elsewhere, F.lit(sites.first.name)) if exists_elsewhere is not None else F.lit(sites.first.name), s
    for known in sites.all:
        for base in (known.remote_base, known.local_base):
            site = F.when(s.startswith(base), known.name).otherwise(site)
            rest = F.when(s.startswith(base), F.substring(s, len(base) + 1, 2**31 - 1)).otherwise(rest)
    rel = F.replace(F.ltrim(F.substring_index(rest, "#", 1), F.lit("/")), F.lit(".."), F.lit(""))
    rel = F.when(is_denied(s, sites), F.raise_error(F.concat(F.lit("remote address denied: "), s))).otherwise(rel)
    return F.struct(site.alias("site"), rel.alias("rel"))


def is_within(root: str, path: str) -> bool:
    """Whether a path, once its `.` and `..` are resolved, lies below the root."""
    top, full = (posixpath.normpath(p) for p in (root, posixpath.join(root, path)))
    return full == top or full.startswith(top.rstrip("/") + "/")


def api_url(symbol: Column, base: Column | str) -> Column:
    """``base/api/x/`` with the second dotted part of the symbol, else ``base/api/``."""
    base = F.rtrim(F.lit(base) if isinstance(base, str) else base, F.lit("/"))
    parts = F.split(symbol, r"\.")
    part = F.translate(F.lower(F.get(parts, F.lit(1))), "_", "-")
    return F.when(F.size(parts) < 2, F.concat(base, F.lit("/api/"))).otherwise(F.concat(base, F.lit("/api/"), part, F.lit("/")))


def markdown_page(path: Column) -> Column:
    """The path without `.md` and `index`, wherever they stand in it."""
    return F.replace(F.replace(path, F.lit(".md"), F.lit("")), F.lit("index"), F.lit(""))


def markdown_url(page: Column, base: Column | str) -> Column:
    base = F.rtrim(F.lit(base) if isinstance(base, str) else base, F.lit("/"))
    page = F.rtrim(page, F.lit("/"))
    return F.when(page == "", F.concat(base, F.lit("/"))).otherwise(F.concat(base, F.lit("/"), page, F.lit("/")))


def docstring_page(path: Column) -> Column:
    return F.replace(path, F.lit(".py"), F.lit(""))


def with_anchor(url: Column, anchor: Column) -> Column:
    return F.when(F.coalesce(anchor, F.lit("")) != "", F.concat(url, F.lit("#"), anchor)).otherwise(url)


def api_address(symbol: Column, aliases: dict[str, str] | None = None) -> Column:
    """The address of a symbol's page: its alias or the default."""
    page = F.lit(API_DEFAULT)
    for name, target in (API_ALIASES if aliases is None else aliases).items():
        page = F.when(symbol == name, target).otherwise(page)
    return page


def page_file(address: Column) -> Column:
    """The file behind an address: itself, or ``index.html`` in the folder."""
    return F.when(address.endswith(".html"), address).otherwise(F.concat(F.rtrim(address, F.lit("/")), F.lit("/index.html")))
