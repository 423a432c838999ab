"""Passages that repeat across a corpus, by sparse suffix arrays.

A text's suffixes are retained where they start with a minimiser: the least hash of ``GRAM`` words
among ``SPAN`` positions in a row. Each window of ``GRAM + SPAN - 1`` words (50) so picks one
retained suffix by its own words alone; equal windows pick equal suffixes, at the same distance from
their start. Retained suffixes that begin alike meet. For each reach to the left they are sorted by
the 50 words from there on, and neighbours that agree match; a match goes on to the left and to the
right as long as the reaches next to it match too. A passage is a longest run of windows that each
occur more than once, within a document or across documents.

Words are compared by hashes: a suffix carries, for every reach that it was picked from, 48 bits of
those 50 words' hash, so that its context need not travel. Two different windows are taken for one
only if their 20 words at the suffix agree in 64 bits, and all 50 in those 48.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlake.llm.common import ROWS, by_group, stored, text_of, texts_in

GRAM, SPAN = 20, 31
WORDS = GRAM + SPAN - 1
#: Suffixes with one beginning that one task compares; more are compared in parts.
PART = 2048
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BYTES = 6  # kept of a window's hash


def _rolled(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` words, by joining runs of powers of two."""
    total, done, run, power, width = None, 0, words, _BASE, 1
    scale = np.uint64(1)
    n = len(words) - size + 1
    while width <= size:
        if size & width:
            part = run[done : done + n] * scale
            total = part if total is None else total + part
            done += width
            scale = scale * power
        run = run[: len(run) - width] + run[width:] * power if len(run) > width else run[:0]
        power, width = power * power, width * 2
    x = total
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def anchors(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(key, position, first window, windows) of each retained suffix, and all windows' hashes in order."""
    digest = xxhash.xxh3_64_intdigest
    words = np.array([digest(w) for w in text.encode("utf-8", "surrogatepass").split()], np.uint64)
    if len(words) < WORDS:
        none = np.empty(0, np.int64)
        return none, none, none, none, np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        grams, windows = _rolled(words, GRAM), _rolled(words, WORDS)
    at = np.lib.stride_tricks.sliding_window_view(grams, SPAN).argmin(1) + np.arange(len(windows))
    first = np.concatenate([[0], np.flatnonzero(np.diff(at)) + 1])
    count = np.diff(np.append(first, len(at)))
    return grams[at[first]].view(np.int64), at[first], first, count, windows


def _suffixes(docs: DataFrame, full: bool) -> DataFrame:
    """Rows of retained suffixes: key alone, or with document, position, first window and window hashes.

    A task takes each of its documents (doc, text) once, so that repeated rows make no more rows than tasks.
    """
    schema = "key long, doc long, at int, first int, windows binary" if full else "key long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for whole in batches:
            for start in range(0, whole.num_rows, ROWS):
                batch = whole.slice(start, ROWS)
                ids = batch.column(batch.schema.get_field_index("doc")).to_pylist()
                new = [i for i, doc in enumerate(ids) if doc not in seen and not seen.add(doc)]
                batch = batch.take(pa.array(new, pa.int64()))
                if not new:
                    continue
                found = [anchors(t) for t in texts_in(batch, "text")]
                key = np.concatenate([f[0] for f in found])
                if not full:
                    yield pa.RecordBatch.from_arrays([pa.array(key)], names=["key"])
                    continue
                docs_ = batch.column(batch.schema.get_field_index("doc")).to_numpy(zero_copy_only=False)
                doc = np.repeat(docs_, [len(f[0]) for f in found]).astype(np.int64)
                at, first, count = (np.concatenate([f[i] for f in found]).astype(np.int32) for i in (1, 2, 3))
                data = np.concatenate([f[4] for f in found]).astype("<u8").view("u1").reshape(-1, 8)[:, :_BYTES].tobytes()
                ends = np.concatenate([[0], np.cumsum(count)]).astype(np.int32) * _BYTES
                windows = pa.BinaryArray.from_buffers(
                    pa.binary(), len(key), [None, pa.py_buffer(ends.astype("<i4").tobytes()), pa.py_buffer(data)]
                )
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key), pa.array(doc), pa.array(at), pa.array(first), windows],
                    names=["key", "doc", "at", "first", "windows"],
                )

    return docs.mapInArrow(run, schema)


_FOUND = "doc long, start int, end int, key long, window long, once boolean"


def _compare(group: dict[str, np.ndarray]) -> tuple[np.ndarray, ...] | None:
    """Runs of windows that occur twice among suffixes that begin alike.

    Where the suffixes are one part of several, one row for each distinct window goes along, to be
    compared with the other parts; ``once`` says that it occurs once in this part.
    """
    doc, at = group["doc"], group["at"]
    _, unique = np.unique(np.stack([doc, at.astype(np.int64)], 1), axis=0, return_index=True)
    if len(unique) < 2 and group["parts"][0] < 2:
        return None
    doc, at, first = doc[unique], at[unique].astype(np.int64), group["first"][unique].astype(np.int64)
    held = [group["windows"][i] for i in unique]
    count = np.array([len(b) // _BYTES for b in held])
    raw = np.zeros((count.sum(), 8), "u1")
    raw[:, :_BYTES] = np.frombuffer(b"".join(held), "u1").reshape(-1, _BYTES)
    row = np.repeat(np.arange(len(doc)), count)
    start = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + first[row]
    reach = at[row] - start  # words between the window's start and the suffix's
    words = raw.view("<u8").ravel()
    # Suffixes sorted by reach, then by the words from there on; neighbours are compared.
    order = np.lexsort((words, reach))
    like_last = np.zeros(len(order) + 1, bool)
    like_last[1:-1] = (words[order][1:] == words[order][:-1]) & (reach[order][1:] == reach[order][:-1])
    matched = np.zeros(len(order), bool)
    matched[order] = like_last[:-1] | like_last[1:]
    # A match goes on while the windows next to it, to the left and to the right, match too.
    again = np.flatnonzero(matched)
    fresh = np.ones(len(again), bool)
    fresh[1:] = (np.diff(row[again]) != 0) | (np.diff(start[again]) != 1)
    begin = again[fresh]
    end = again[np.append(np.flatnonzero(fresh)[1:], len(again)) - 1] if len(again) else again
    n = len(begin)
    out = [doc[row[begin]], start[begin], start[end] + WORDS, np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, bool)]
    if group["parts"][0] > 1:
        lead = order[~like_last[:-1]]
        window = (words[lead] << np.uint64(16)) | reach[lead].astype(np.uint64)
        more = [doc[row[lead]], start[lead], start[lead] + WORDS, np.full(len(lead), group["key"][0]), window.view(np.int64), ~matched[lead]]
        out = [np.concatenate([a, b]) for a, b in zip(out, more)]
    return tuple(out)


def _union(group: dict[str, np.ndarray]) -> tuple[np.ndarray, ...]:
    """Overlapping and adjoining runs of a document as one passage each."""
    start, end = group["start"], np.maximum.accumulate(group["end"])
    cut = np.ones(len(start), bool)
    cut[1:] = start[1:] > end[:-1]
    first = np.flatnonzero(cut)
    return group["doc"][first], start[first], end[np.append(first[1:], len(start)) - 1]


def passages(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, start_word, end_word (exclusive), n_words of every passage of 50 or more words that repeats.

    A word belongs to a passage when some window of 50 words around it occurs again anywhere. Words
    stand between ASCII white space and are compared exactly. Runs of a passage that overlap or
    adjoin are one. Null, empty and short texts have none. Repeated rows (equal id and text) are one
    document. Copies of a text under other ids are repeats in all their words.
    """
    keyed = df.select(F.col(doc_id).alias("doc_id"), text_of(df[text]).alias("text"))
    keyed = keyed.withColumn("doc", F.xxhash64(F.col("doc_id").cast("string"), "text"))
    often = _suffixes(keyed.select("doc", "text"), full=False).groupBy("key").count().where(F.col("count") > PART)
    often = stored(often.select("key", F.ceil(F.col("count") / (PART // 2)).cast("int").alias("parts")), "frequent")
    rows = _suffixes(keyed.select("doc", "text"), full=True).join(often, "key", "left")
    rows = rows.withColumn("parts", F.coalesce("parts", F.lit(1)))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("doc", "at"), F.col("parts")).cast("int"))
    found = stored(by_group(rows, ["key", "part"], _FOUND, _compare, least=2), "repeats")
    parts = found.where("key <> 0 OR window <> 0")
    # Each part gives a window once, so one that occurs once in its part repeats if another part has it.
    met = parts.groupBy("key", "window").agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    across = parts.where("once").join(met, ["key", "window"], "left_semi").select("doc", "start", "end")
    runs = found.where("key = 0 AND window = 0").select("doc", "start", "end").unionByName(across)
    whole = by_group(runs, ["doc"], "doc long, start_word int, end_word int", _union, order=["start"])
    ids = keyed.select("doc", "doc_id").distinct()
    return whole.join(ids, "doc").select(
        "doc_id",
        F.col("start_word").cast("long").alias("start_word"),
        F.col("end_word").cast("long").alias("end_word"),
        (F.col("end_word") - F.col("start_word")).cast("long").alias("n_words"),
    )
