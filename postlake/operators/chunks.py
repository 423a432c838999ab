"""Cutting document text into chunks, scoring them and keeping the best within a budget.

A document is one row and its chunks stay an array in that row, so the whole chain runs
without a shuffle. `explode_chunks` gives the long table.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlake.functions import lexicons as lex
from postlake.functions.text import (
    any_contains,
    explode_rows,
    let,
    lit_array,
    or_empty,
    strip,
)
from postlake.functions.terms import counts_in_each, in_pieces

BLANK_LINE = r"\n\s*\n"
SENTENCE_END = r"(?<=[.!?])\s+"
_SENTENCE_END = re.compile(SENTENCE_END, re.ASCII)
_BUDGET = "struct<kept:array<string>,total:int,full:boolean>"


def paragraph_array(text: Column, sep: str = BLANK_LINE) -> Column:
    return F.filter(F.transform(F.split(or_empty(text), sep), strip), lambda p: p != "")


def _sentences(paragraph: str, size: int) -> list[str]:
    """Sentences packed up to ``size`` characters; longer sentences are sliced."""
    if len(paragraph) <= size:
        return [paragraph]
    done: list[str] = []
    held: list[str] = []
    length = 0  # of what is held, with its joiners
    for s in _SENTENCE_END.split(paragraph):
        if length + len(s) <= size:
            length += len(s) + (1 if length else 0)
            held += [s] if s or length else []
            continue
        if length:
            done.append(" ".join(held))
        held, length = [], 0
        if len(s) > size:
            done += [s[at : at + size] for at in range(0, len(s), size)]
        else:
            held, length = [s], len(s)
    return done + ([" ".join(held)] if length else [])


def _packed(paragraphs: list[str], size: int) -> list[str]:
    """Paragraphs packed greedily; the joiner does not count towards the size."""
    done: list[str] = []
    held: list[str] = []
    length = 0
    for p in paragraphs:
        if length + len(p) <= size:
            length += len(p) + (2 if length else 0)
            held.append(p)
            continue
        if length:
            done.append("\n\n".join(held))
        *whole, last = _sentences(p, size)
        done += whole
        held, length = [last], len(last)
    return done + (["\n\n".join(held)] if length else [])


def _each(values: Column, work: Callable[[Any, int], list[str]], size: int) -> Column:
    """``work`` for each value, in one Arrow pass; null stays null. Not for use inside a lambda."""

    def run(column: pa.Array) -> pa.Array:
        return in_pieces(column, lambda v: None if v is None else work(v, size), pa.list_(pa.string()))

    return F.arrow_udf(run, "array<string>")(values)


def sentence_chunks(par: Column, size: int) -> Column:
    """Sentences packed up to ``size`` characters; longer sentences are sliced."""
    return _each(par, _sentences, size)


def chunk_array(text: Column, size: int = 800, sep: str = BLANK_LINE) -> Column:
    """Paragraphs packed greedily; the joiner does not count towards the size.

    Lengths are added up and each chunk is joined once, so the work grows with the text; a fold of
    Spark's would copy its list at every step.
    """
    return _each(paragraph_array(text, sep), _packed, size)


def scored_array(
    chunks: Column,
    relevant: Sequence[str] = lex.RELEVANT_TERMS,
    irrelevant: Sequence[str] = lex.IRRELEVANT_TERMS,
) -> Column:
    """Chunks with their score: relevant terms that occur, less twice the irrelevant ones."""
    lows = F.transform(chunks, F.lower)

    def joined(counts: Column) -> Column:
        return F.transform(
            chunks,
            lambda c, i: let(
                F.get(counts, i),
                lambda n: F.struct((n[0] - F.lit(2) * n[1]).alias("score"), i.alias("pos"), c.alias("chunk")),
            ),
        )

    return let(counts_in_each(lows, (relevant, irrelevant)), joined)


def best_chunks(scored: Column, text: Column, k: int = 5, fallback: int = 1500) -> Column:
    """Chunks with a positive score, best first, earlier first on ties."""
    ranked = F.array_sort(
        F.transform(
            F.filter(scored, lambda s: s.score > 0),
            lambda s: F.struct((-s.score).alias("down"), s.pos.alias("pos"), s.chunk.alias("chunk")),
        )
    )
    picked = F.transform(F.slice(ranked, 1, k), lambda s: s.chunk)
    return F.when(F.size(picked) > 0, picked).otherwise(F.array(F.left(text, F.lit(fallback))))


def budget_array(chunks: Column, cap: int = 4500, each: int = 1500, rest: int = 100) -> Column:
    """Trimmed distinct chunks within ``cap`` characters; the one that overflows is cut."""
    unique = F.array_distinct(F.filter(F.transform(chunks, strip), lambda c: c != ""))
    cut = F.transform(unique, lambda c: F.left(c, F.lit(each)))

    def state(kept: Column, total: Column, full: Column) -> Column:
        return F.struct(kept.alias("kept"), total.alias("total"), full.alias("full")).cast(_BUDGET)

    def step(acc: Column, c: Column) -> Column:
        left = F.lit(cap) - acc.total
        return (
            F.when(acc.full, acc)
            .when(
                F.length(c) <= left,
                state(F.array_append(acc.kept, c), acc.total + F.length(c), F.lit(False)),
            )
            .when(
                left > rest,
                state(F.array_append(acc.kept, F.left(c, left)), F.lit(cap), F.lit(True)),
            )
            .otherwise(state(acc.kept, acc.total, F.lit(True)))
        )

    return F.aggregate(cut, state(lit_array([]), F.lit(0), F.lit(False)), step, lambda acc: acc.kept)


# Character classes of letters with a case.
_UNCASED = r"[^\p{Lu}\p{Ll}\p{Lt}]"
ALL_CAPS = r"^[^\p{Ll}\p{Lt}]*\p{Lu}[^\p{Ll}\p{Lt}]*$"
TITLE_CASE = rf"^{_UNCASED}*[\p{{Lu}}\p{{Lt}}]\p{{Ll}}*(?:{_UNCASED}+[\p{{Lu}}\p{{Lt}}]\p{{Ll}}*)*{_UNCASED}*$"


def heading_position(text: Column, blocked: Sequence[str] = lex.IRRELEVANT_TERMS) -> Column:
    """Offset of the first heading-like line, -1 when there is none."""

    def is_heading(line: Column) -> Column:
        return let(
            strip(line),
            lambda s: (F.length(s) > 3)
            & (F.length(s) < 60)
            & (s.rlike(ALL_CAPS) | s.rlike(TITLE_CASE))
            & ~any_contains(F.lower(s), blocked),
        )

    def offset(lines: Column) -> Column:
        at = F.array_position(F.transform(lines, is_heading), True).cast("int")
        return F.when(
            at > 0,
            F.aggregate(F.slice(lines, 1, at - 1), F.lit(0), lambda acc, s: acc + F.length(s) + 1),
        ).otherwise(F.lit(-1))

    return let(F.split(text, "\n"), offset)


def summary_of(
    text: Column,
    headings: Sequence[str] = lex.SUMMARY_HEADINGS,
    cap: int = 1500,
    fallback: int = 1000,
    blocked: Sequence[str] = lex.IRRELEVANT_TERMS,
) -> Column:
    """Text under the first heading phrase that has any, else the head of the document."""

    def under(phrase: str) -> Column:
        at = F.instr(F.lower(text), phrase)
        start = at + len(phrase)
        newline = F.call_function("locate", F.lit("\n"), text, start)
        begin = F.when(newline > 0, newline + 1).otherwise(start)
        section = strip(F.substring(text, begin, F.lit(cap)))
        body = let(
            section,
            lambda s: let(
                heading_position(s, blocked),
                lambda h: F.when(h >= 0, strip(F.left(s, h))).otherwise(s),
            ),
        )
        return F.when(at > 0, F.nullif(body, F.lit("")))

    return F.coalesce(*[under(h) for h in headings], strip(F.left(text, F.lit(fallback))))


# --- DataFrame operators ----------------------------------------------------


def explode_chunks(df: DataFrame, *keys: str, column: str = "chunks", name: str = "chunk") -> DataFrame:
    return explode_rows(df, keys, column, name)


def paragraphs(docs: DataFrame, sep: str = BLANK_LINE, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    rows = docs.select(doc_id, paragraph_array(F.col(text), sep).alias("_p"))
    return explode_chunks(rows, doc_id, column="_p", name="paragraph")


def pack_sentences(pars: DataFrame, size: int = 800, paragraph: str = "paragraph") -> DataFrame:
    return pars.withColumn("pieces", sentence_chunks(F.col(paragraph), size))


def pack_chunks(docs: DataFrame, size: int = 800, sep: str = BLANK_LINE, text: str = "text") -> DataFrame:
    return docs.withColumn("chunks", chunk_array(F.col(text), size, sep))


def score_chunks(
    chunked: DataFrame,
    relevant: Sequence[str] = lex.RELEVANT_TERMS,
    irrelevant: Sequence[str] = lex.IRRELEVANT_TERMS,
) -> DataFrame:
    return chunked.withColumn("scored", scored_array(F.col("chunks"), relevant, irrelevant))


def top_chunks(scored: DataFrame, k: int = 5, text: str = "text") -> DataFrame:
    return scored.withColumn("chunks", best_chunks(F.col("scored"), F.col(text), k))


def within_budget(chunked: DataFrame, cap: int = 4500, each: int = 1500) -> DataFrame:
    return chunked.withColumn("chunks", budget_array(F.col("chunks"), cap, each))


def summary_section(docs: DataFrame, text: str = "text", **options: object) -> DataFrame:
    return docs.withColumn("summary", summary_of(F.col(text), **options))


def next_heading(docs: DataFrame, text: str = "text") -> DataFrame:
    return docs.withColumn("heading_at", heading_position(F.col(text)))


def chunk_stats(
    docs: DataFrame,
    size: int = 800,
    k: int = 5,
    cap: int = 4500,
    sep: str = BLANK_LINE,
    relevant: Sequence[str] = lex.RELEVANT_TERMS,
    irrelevant: Sequence[str] = lex.IRRELEVANT_TERMS,
    text: str = "text",
    each: int = 1500,
) -> DataFrame:
    """Summary, kept chunks and their statistics per document."""
    blank = strip(or_empty(F.col(text))) == ""
    ranked = top_chunks(score_chunks(pack_chunks(docs, size, sep, text), relevant, irrelevant), k, text)
    kept = within_budget(ranked, cap, each).withColumn(
        "chunks", F.when(blank, lit_array([])).otherwise(F.col("chunks"))
    )
    lengths = F.transform("chunks", lambda c: F.length(c))
    return kept.drop("scored").withColumns(
        {
            "summary": F.when(blank, F.lit("")).otherwise(summary_of(F.col(text))),
            "original_text_length": F.when(blank, F.lit(0)).otherwise(F.length(text)),
            "filtered_text_length": F.aggregate(lengths, F.lit(0), lambda a, n: a + n),
            "number_of_chunks_selected": F.size("chunks"),
        }
    )
