"""Urls of one site: what belongs to it, canonical forms, categories."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Page categories with their path patterns; the first category that matches wins.
CATEGORIES = {
    "features": ["/features", "/capabilities", "/what-we-do", "/product"],
    "documentation": ["/docs", "/documentation", "/guide", "/manual", "/help", "/support"],
    "pricing": ["/pricing", "/plans", "/packages", "/cost"],
    "solutions": ["/solutions", "/use-cases", "/industries", "/for-"],
    "integrations": ["/integrations", "/connect", "/apps", "/marketplace"],
    "about": ["/about", "/company", "/team", "/story"],
    "blog": ["/blog", "/news", "/articles", "/posts"],
    "legal": ["/privacy", "/terms", "/legal", "/gdpr", "/cookie"],
    "careers": ["/careers", "/jobs", "/join", "/work-with-us"],
}
# Paths that hold no page, and endings of file-based base paths.
NO_PAGE = r"(?i)\.(js|css|ico|png|jpg|jpeg|gif|svg|woff|woff2|ttf|eot)$|^/api/|^/static/|^/assets/|^/_next/|^/__"
FILE_ENDINGS = r"(?i)\.(aspx|html|htm|php|jsp|do|action)$"


def netloc(url: Column) -> Column:
    """The part between scheme and path, as written; empty for relative urls."""
    return F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1)


def path(url: Column) -> Column:
    """Path without query and fragment."""
    return F.regexp_replace(F.regexp_replace(url, r"^([A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*", ""), r"[?#].*$", "")


def is_child_path(child: Column, base: Column) -> Column:
    """Whether a path is the base path or below it; below the stem too if the base is a file."""
    own, top = F.rtrim(child, F.lit("/")), F.rtrim(base, F.lit("/"))
    stem = F.regexp_replace(top, FILE_ENDINGS, "")
    below = F.startswith(own, F.concat(top, F.lit("/"))) | ((stem != top) & F.startswith(own, F.concat(stem, F.lit("/"))))
    return (top == "") | (own == top) | below


def is_internal(url: Column, base_netloc: Column, base_path: Column) -> Column:
    """Same host or relative, and below the base path; false for null and empty urls."""
    here = netloc(url)
    own = F.rtrim(path(url), F.lit("/"))
    own = F.when(own == "", "/").otherwise(own)
    return F.coalesce((url != "") & ((here == "") | (here == base_netloc)) & is_child_path(own, base_path), F.lit(False))


def normalized(url: Column, base_url: Column) -> Column:
    """base_url with the url's path, without query, fragment and trailing slash; null for paths that hold no page."""
    own = F.rtrim(path(url), F.lit("/"))
    return F.when(~own.rlike(NO_PAGE), F.concat(base_url, own))


def category(url: Column) -> Column:
    """First category whose pattern is in the path, else null."""
    low = F.lower(path(url))
    out: Column | None = None
    for name, patterns in CATEGORIES.items():
        hit = low.rlike("|".join(patterns))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out


def site_confidence(main: Column, navigation: Column, pages: Column, feature_pages: Column, framework: Column) -> Column:
    """0.5 and a tenth for each of: main selector, navigation selector, over 5 pages, a feature page, a known framework; at most 1."""
    tenths = [main.isNotNull(), navigation.isNotNull(), pages > 5, feature_pages > 0, framework.isNotNull() & (framework != "unknown")]
    return F.least(F.lit(1.0), sum((F.coalesce(t, F.lit(False)).cast("int") for t in tenths), F.lit(0)) / 10 + 0.5)
