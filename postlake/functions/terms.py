"""Many terms looked for at once.

An automaton over all terms reads a text once, whatever their number. It runs in an Arrow UDF, so
these columns can't stand inside a lambda; texts that lie in an array are passed as the array.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache
from typing import Any

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Rows of an Arrow batch that are Python objects at a time.
PIECE = 128


def in_pieces(column: pa.Array, work: Callable[[Any], Any], kind: pa.DataType) -> pa.Array:
    """``work`` for each value. Only a piece of the batch and of its results is held as Python objects."""
    spans = range(0, len(column), PIECE)
    made = [pa.array([work(v) for v in column.slice(at, PIECE).to_pylist()], kind) for at in spans]
    return pa.concat_arrays(made) if made else pa.array([], kind)


@lru_cache(maxsize=16)
def _machine(terms: tuple[str, ...]) -> tuple[ahocorasick.Automaton, frozenset[int]]:
    """Automaton whose matches give the places of a term in ``terms``, and the places of empty terms."""
    places: dict[str, list[int]] = {}
    for i, term in enumerate(terms):
        places.setdefault(term, []).append(i)
    machine = ahocorasick.Automaton()
    for term, where in places.items():
        if term:
            machine.add_word(term, (len(term), tuple(where)))
    machine.make_automaton()
    return machine, frozenset(places.get("", ()))


def _is_word(char: str) -> bool:
    return char.isalnum() or char == "_"


def _stands_alone(text: str, start: int, end: int) -> bool:
    """Whether text[start:end] lies between word boundaries: word and other characters meet at both of its ends."""
    before = start > 0 and _is_word(text[start - 1])
    after = end < len(text) and _is_word(text[end])
    return before != _is_word(text[start]) and after != _is_word(text[end - 1])


def occurring(text: str, terms: tuple[str, ...], bounded: bool) -> set[int]:
    """Places of the terms that occur in a text, or that occur as whole words."""
    machine, empty = _machine(terms)
    found = set() if bounded else set(empty)
    if not len(machine):
        return found
    for last, (size, where) in machine.iter(text):
        if where[0] not in found and (not bounded or _stands_alone(text, last + 1 - size, last + 1)):
            found.update(where)
    return found


def terms_in(text: Column, terms: Sequence[str], labels: Sequence[str] | None = None) -> Column:
    """Sorted labels (the terms by default) of the terms that occur in a text as whole words.

    Text and terms are compared as they are. A null text has none.
    """
    wanted, names = tuple(terms), tuple(labels or terms)

    def find(texts: pa.Array) -> pa.Array:
        each = lambda t: sorted(names[i] for i in occurring(t or "", wanted, True))
        return in_pieces(texts, each, pa.list_(pa.string()))

    return F.arrow_udf(find, "array<string>")(text)


def _counts(text: str | None, terms: tuple[str, ...], group_of: tuple[int, ...], groups: int) -> list[int]:
    counts = [0] * groups
    if text is not None:
        for i in occurring(text, terms, False):
            counts[group_of[i]] += 1
    return counts


def _flat(groups: Sequence[Sequence[str]]) -> tuple[tuple[str, ...], tuple[int, ...]]:
    pairs: Iterator[tuple[str, int]] = ((t, g) for g, terms in enumerate(groups) for t in terms)
    terms, group_of = zip(*pairs) if any(groups) else ((), ())
    return tuple(terms), tuple(group_of)


def counts_in(text: Column, groups: Sequence[Sequence[str]]) -> Column:
    """How many terms of each group occur anywhere in a text, as an array of int; every term counts once."""
    (terms, group_of), n = _flat(groups), len(groups)

    def count(texts: pa.Array) -> pa.Array:
        return in_pieces(texts, lambda t: _counts(t, terms, group_of, n), pa.list_(pa.int32()))

    return F.arrow_udf(count, "array<int>")(text)


def counts_in_each(texts: Column, groups: Sequence[Sequence[str]]) -> Column:
    """`counts_in` for every text of an array."""
    (terms, group_of), n = _flat(groups), len(groups)

    def count(lists: pa.Array) -> pa.Array:
        each = lambda ts: None if ts is None else [_counts(t, terms, group_of, n) for t in ts]
        return in_pieces(lists, each, pa.list_(pa.list_(pa.int32())))

    return F.arrow_udf(count, "array<array<int>>")(texts)
