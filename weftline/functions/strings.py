"""String and regular expression functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftline.functions.plumbing import column, const

lower, upper, initcap = F.lower, F.upper, F.initcap
trim, ltrim, rtrim = F.trim, F.ltrim, F.rtrim
length, reverse, ascii_, chr_ = F.length, F.reverse, F.ascii, F.chr
levenshtein, translate, substring_index = F.levenshtein, F.translate, F.substring_index
format_string = F.format_string


def concat(left, right) -> Column:
    return F.concat(column(left), column(right))


def concat_ws(separator: str, *cs) -> Column:
    return F.concat_ws(separator, *map(column, cs))


def like(c, pattern: str) -> Column:
    return column(c).like(pattern)


def rlike(c, pattern: str) -> Column:
    return column(c).rlike(pattern)


def substring(c, position: int, n: int) -> Column:
    """From a 1-based position; a negative one counts from the end."""
    return F.substring(column(c), position, n)


def left(c, n) -> Column:
    return F.left(column(c), const(n))


def right(c, n) -> Column:
    return F.right(column(c), const(n))


def repeat(c, n) -> Column:
    return F.repeat(column(c), const(n))


def lpad(c, n: int, pad: str) -> Column:
    return F.lpad(column(c), n, pad)


def rpad(c, n: int, pad: str) -> Column:
    return F.rpad(column(c), n, pad)


def replace(c, search: str, replacement: str) -> Column:
    """Of literal text."""
    return F.replace(column(c), F.lit(search), F.lit(replacement))


def regexp_replace(c, pattern: str, replacement: str) -> Column:
    return F.regexp_replace(column(c), pattern, replacement)


def regexp_extract(c, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract(column(c), pattern, group)


def regexp_extract_all(c, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(column(c), F.lit(pattern), F.lit(group))


def split(c, pattern: str) -> Column:
    """By a regular expression; empty strings at the end stay."""
    return F.split(column(c), pattern)


def split_part(c, delimiter: str, part) -> Column:
    return F.split_part(column(c), F.lit(delimiter), const(part))


def starts_with(c, prefix) -> Column:
    return column(c).startswith(const(prefix))


def ends_with(c, suffix) -> Column:
    return column(c).endswith(const(suffix))


def contains(c, part) -> Column:
    return column(c).contains(const(part))


def instr(c, part) -> Column:
    """1-based, 0 if absent."""
    return F.instr(column(c), part)


def number_to_char(c, form: str) -> Column:
    return F.to_char(column(c), F.lit(form))


def parse_url(c, part: str) -> Column:
    return F.parse_url(column(c), F.lit(part))
