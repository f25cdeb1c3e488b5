"""Canonical forms of urls and content hashes, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Hex digits kept of a content hash.
HASH_DIGITS = 32


def collapsed(text: Column) -> Column:
    """Lower case, each run of white space one blank, trimmed."""
    return F.trim(F.regexp_replace(F.lower(text), r"(?U)\s+", " "))


def content_digest(text: Column, digits: int = HASH_DIGITS) -> Column:
    """First hex digits of the SHA-256 of the collapsed text; null text hashes as empty."""
    return F.substring(F.sha2(collapsed(F.coalesce(text, F.lit(""))), 256), 1, digits)


def hash_key(given: Column, text: Column) -> Column:
    """A delivered hash in plain lower-case hex; a missing or unreadable one follows from the text.

    Accepts any letter case, surrounding blanks and an algorithm prefix such as "sha256:".
    """
    bare = F.regexp_replace(F.lower(given), r"^\s*(sha-?256|0x)[\s:=-]*", "")
    digits = F.regexp_extract(bare, rf"^\s*([0-9a-f]{{{HASH_DIGITS}}})", 1)
    return F.when(F.length(digits) == HASH_DIGITS, digits).otherwise(content_digest(text))


def url_key(url: Column) -> Column:
    """url without fragment and trailing slash, scheme and host in lower case; null stays null."""
    bare = F.regexp_replace(F.trim(url), r"#.*$", "")
    bare = F.regexp_replace(bare, r"/+$", "")
    head = F.regexp_extract(bare, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?]*)", 1)
    return F.concat(F.lower(head), F.substr(bare, F.length(head) + F.lit(1)))


def host(url: Column) -> Column:
    """Host of an absolute url in lower case; null without one."""
    found = F.lower(F.regexp_extract(F.trim(url), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.when(found != "", found)
