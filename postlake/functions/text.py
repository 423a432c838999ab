"""Column helpers with the string semantics the operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The characters a Unicode-aware strip removes.
SPACE_CHARS = (
    " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004"
    "\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACE_CHARS))


def filled(c: Column) -> Column:
    """The stripped string, or null when nothing is left."""
    return F.nullif(strip(c), F.lit(""))


def or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once and use it many times inside ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def first_by(items: Column, key: Callable[[Column], Column]) -> Column:
    """The first item of each key, in the order of the array: keys are sorted once, inside the row."""

    def kept(sorted_keys: Column) -> Column:
        firsts = F.filter(sorted_keys, lambda x, i: (i == 0) | ~x.k.eqNullSafe(F.get(sorted_keys, i - 1).k))
        return F.transform(F.sort_array(F.transform(firsts, lambda x: x.i)), lambda i: F.get(items, i))

    return let(F.sort_array(F.transform(items, lambda x, i: F.struct(key(x).alias("k"), i.alias("i")))), kept)


def lit_array(values: Iterable[str]) -> Column:
    values = list(values)
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def any_contains(c: Column, terms: Sequence[str]) -> Column:
    """True when ``c`` holds any term; one scan instead of one per term."""
    return c.rlike("|".join(quote(t) for t in terms))


def count_contains(c: Column, terms: Sequence[str]) -> Column:
    """How many of the terms occur in ``c``; every term counts once."""
    total = F.lit(0)
    for term in terms:
        total = total + F.when(c.contains(term), 1).otherwise(0)
    return total


def quote(term: str) -> str:
    """Regex text matching ``term`` literally, valid for Java and RE2."""
    return "".join("\\" + ch if ch in r"\.[]{}()*+-?^$|#&~" else ch for ch in term)


def first_match(c: Column, patterns: Sequence[tuple[str, int]]) -> Column:
    """Stripped group of the first pattern that matches, else null.

    Later patterns run only where earlier ones fail, and none runs twice.
    """

    def stripped(pattern: str, group: int) -> Column:
        return let(strip(F.regexp_extract(c, pattern, group)), lambda s: F.when(s != "", s))

    return F.coalesce(*[stripped(p, g) for p, g in patterns])


def join_filled(sep: str, *cols: Column) -> Column:
    """Non-empty parts joined by ``sep``; null when there is none."""
    return F.nullif(F.concat_ws(sep, *[filled(c) for c in cols]), F.lit(""))


def cut_at_last_line(c: Column, cap: int, keep: float = 0.8) -> Column:
    """First ``cap`` characters, back to the last newline if it lies past ``keep``."""
    head = F.left(c, F.lit(cap))
    last_newline = F.length(head) - F.locate("\n", F.reverse(head))
    has_newline = F.locate("\n", head) > 0
    back = F.when(has_newline & (last_newline > cap * keep), F.left(head, last_newline)).otherwise(head)
    return F.when(F.length(c) > cap, back).otherwise(c)


def explode_rows(df: DataFrame, keys: Sequence[str], column: str, name: str, pos: str = "pos") -> DataFrame:
    """One row per element of a computed array column, with its position.

    A plain explode of a column makes Spark infer a filter on its size, push it below the
    projection and compute the array again for it; the outer form does not.
    """
    return df.select(*keys, F.posexplode_outer(column).alias(pos, name)).where(F.col(pos).isNotNull())
