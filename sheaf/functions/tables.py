"""Tables as structs (headers, rows, caption): shape, kind and Markdown."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sheaf.functions import rules

_NONE = F.array


def headers_of(t: Column) -> Column:
    return F.coalesce(t["headers"], F.array().cast("array<string>"))


def rows_of(t: Column) -> Column:
    """Rows without null rows; null cells are empty."""
    rows = F.filter(F.coalesce(t["rows"], F.array().cast("array<array<string>>")), lambda r: r.isNotNull())
    return F.transform(rows, lambda r: F.transform(r, lambda c: F.coalesce(c, F.lit(""))))


def _fitted(row: Column, n: Column) -> Column:
    return F.slice(F.concat(row, F.array_repeat(F.lit(""), F.greatest(n - F.size(row), F.lit(0)))), F.lit(1), n)


def normalized_rows(t: Column) -> Column:
    """Rows of equal width: the headers' number where there are headers, else the longest row's."""
    widest = F.aggregate(rows_of(t), F.lit(0), lambda a, r: F.greatest(a, F.size(r)))
    n = F.when(F.size(headers_of(t)) > 0, F.size(headers_of(t))).otherwise(widest)
    return F.when(n > 0, F.transform(rows_of(t), lambda r: _fitted(r, n))).otherwise(rows_of(t))


def meaningful(t: Column) -> Column:
    """At least two columns, a row, and 20 characters in the body."""
    columns = F.when(F.size(headers_of(t)) > 0, F.size(headers_of(t))).otherwise(F.coalesce(F.size(F.get(rows_of(t), F.lit(0))), F.lit(0)))
    chars = F.aggregate(F.flatten(rows_of(t)), F.lit(0), lambda a, c: a + F.length(F.trim(c)))
    return (columns >= 2) & (F.size(rows_of(t)) >= 1) & (chars >= 20)


def _words(t: Column) -> Column:
    return F.lower(F.concat(F.coalesce(t["caption"], F.lit("")), F.lit("\n"), F.array_join(headers_of(t), " ", "")))


def is_comparison(t: Column) -> Column:
    """Words of comparison in caption or headers, or over 30 % mark cells in the first five rows."""
    cells = F.flatten(F.slice(rows_of(t), 1, 5))
    marks = F.size(F.filter(cells, lambda c: F.lower(F.trim(c)).isin(rules.COMPARISON_CELLS)))
    return rules.has_any(_words(t), rules.COMPARISON_WORDS) | ((F.size(cells) > 0) & (marks * 10 > F.size(cells) * 3))


def is_offer(t: Column) -> Column:
    """The wider notion of a comparison: words of offers in caption or headers, or marks anywhere in the body."""
    body = F.lower(F.array_join(F.flatten(rows_of(t)), " "))
    return rules.has_any(_words(t), rules.OFFER_WORDS) | rules.has_any(body, rules.OFFER_MARKS)


def is_price_table(t: Column) -> Column:
    """Price words in caption or headers, or two kinds of price marks in the body."""
    body = F.lower(F.array_join(F.flatten(rows_of(t)), " "))
    marks = sum((body.rlike(p).cast("int") for p in rules.PRICE_MARKS), F.lit(0))
    return rules.has_any(_words(t), rules.PRICE_WORDS) | (marks >= 2)


def kept(t: Column) -> Column:
    """Whether a table is worth an inventory entry: rows, and headers or two rows."""
    return (F.size(rows_of(t)) > 0) & ((F.size(headers_of(t)) > 0) | (F.size(rows_of(t)) >= 2))


def _line(cells: Column) -> Column:
    return F.concat(F.lit("| "), F.array_join(cells, " | ", ""), F.lit(" |"))


def _rule(n: Column) -> Column:
    return _line(F.array_repeat(F.lit("---"), n))


def markdown(t: Column) -> Column:
    """Headers, rule and rows."""
    head = F.when(F.size(headers_of(t)) > 0, F.array(_line(headers_of(t)), _rule(F.size(headers_of(t))))).otherwise(F.array().cast("array<string>"))
    return F.array_join(F.concat(head, F.transform(rows_of(t), _line)), "\n")


def escaped_markdown(t: Column) -> Column:
    """With a bold caption and escaped bars; a bare rule where there are no headers."""
    none = F.array().cast("array<string>")
    top = F.when(F.length(t["caption"]) > 0, F.array(F.concat(F.lit("**"), t["caption"], F.lit("**")), F.lit(""))).otherwise(none)
    first = F.coalesce(F.size(F.get(rows_of(t), F.lit(0))), F.lit(0))
    head = F.when(F.size(headers_of(t)) > 0, F.array(_line(headers_of(t)), _rule(F.size(headers_of(t))))).when(F.size(rows_of(t)) > 0, F.array(_rule(first))).otherwise(none)
    body = F.transform(rows_of(t), lambda r: _line(F.transform(r, lambda c: F.replace(c, F.lit("|"), F.lit("\\|")))))
    return F.array_join(F.concat(top, head, body), "\n")


def padded_markdown(t: Column) -> Column:
    """The first row is the head where there are no headers; rows are fitted to the headers."""
    named = F.size(headers_of(t)) > 0
    head = F.when(named, headers_of(t)).otherwise(F.get(rows_of(t), F.lit(0)))
    body = F.when(named, F.transform(rows_of(t), lambda r: _fitted(r, F.size(headers_of(t))))).otherwise(F.slice(rows_of(t), F.lit(2), F.greatest(F.size(rows_of(t)), F.lit(1))))
    return F.when(~named & (F.size(rows_of(t)) == 0), "").otherwise(F.array_join(F.concat(F.array(_line(head), _rule(F.size(head))), F.transform(body, _line)), "\n"))
