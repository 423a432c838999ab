"""Personal data: exact base spans, and further spans chosen among candidates by boosted trees.

Generators propose every stretch that might be an e-mail address, an IP address, a card or a phone
number, also spelled out or spaced unusually. Trees over format and context judge them. They learn
from base spans, from base spans rewritten in the ways the generators look for, and from candidates
that fail the base rules, in a bounded sample of documents.
"""

from __future__ import annotations

import pickle
import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postlake.llm.boosting import BoostedTrees, threshold_for
from postlake.llm.common import sample_rows, texts_in, with_columns

KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = range(4)

# Fixed patterns of the base rules. Each starts where no earlier start can match, and takes digits
# without giving any back, so that a failing stretch is read once.
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")

Span = tuple[int, int, int]  # kind, start, end


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(_DIGIT.findall(text))


def _emails(text: str) -> Iterator[Span]:
    floor, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        after = at + 1
        if start < at and (m := _DOMAIN.match(text, after)):
            yield EMAIL, start, m.end()
            floor = after = m.end()
        at = text.find("@", after)


def base_spans(text: str) -> list[Span]:
    """Spans of the base rules: leftmost, not overlapping within a kind, failing matches dropped."""
    found = list(_emails(text))
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m.group().split(".")):
            found.append((IP, m.start(), m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := _digits(m.group())) <= 19 and luhn(d):
            found.append((CARD, m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= len(_digits(m.group())) <= 15:
                found.append((PHONE, m.start(), m.end()))
    return found


_SPELLED_AT = re.compile(r"[(\[{]\s?(?:at|AT)\s?[)\]}]|＠| at | AT ")
_LOOSE_LOCAL = re.compile(r"[A-Za-z0-9._%+-]{1,64}\s?\Z")
_LOOSE_DOMAIN = re.compile(
    r"\s?[A-Za-z0-9-]{1,63}(?:(?:\.|\s?[(\[{]\s?(?:dot|DOT)\s?[)\]}]\s?| dot | DOT )[A-Za-z0-9-]{1,63}){1,8}"
)
_LOOSE_IP = re.compile(
    r"(?<![0-9])[0-9]{1,4}(?:(?:\s?[(\[{]\s?(?:\.|dot)\s?[)\]}]\s?|\s?\.\s?| dot )[0-9]{1,4}){3}(?![0-9])"
)
_LOOSE_NUMBER = re.compile(r"(?<![0-9])(?:\(|00|\+)?[0-9](?:[ ()./_-]{0,3}[0-9])++")


def candidates(text: str) -> list[Span]:
    """Everything that might be personal data; proposals may overlap."""
    found = []
    for m in _SPELLED_AT.finditer(text):
        left = _LOOSE_LOCAL.search(text, max(0, m.start() - 66), m.start())
        right = _LOOSE_DOMAIN.match(text, m.end())
        if left and right:
            found.append((EMAIL, left.start(), right.end()))
    for m in _LOOSE_IP.finditer(text):
        found.append((IP, m.start(), m.end()))
    for m in _LOOSE_NUMBER.finditer(text):
        if m.end() - m.start() < 7:
            continue
        n = len(_digits(m.group()))
        if 13 <= n <= 19:
            found.append((CARD, m.start(), m.end()))
        if 7 <= n <= 15:
            found.append((PHONE, m.start(), m.end()))
    return found


_CUES = (
    re.compile(r"(?i)mail|contact|write|reach"),
    re.compile(r"(?i)\bip\b|host|addr|server|node"),
    re.compile(r"(?i)card|visa|pay|credit|account"),
    re.compile(r"(?i)phone|tel|call|mobile|fax|dial"),
)


def _class(c: str) -> int:
    return 0 if not c or c.isspace() else 1 if c.isalpha() else 2 if c.isdigit() else 3


def features(text: str, span: Span, near: int) -> list[float]:
    """Format and context of a candidate; ``near`` is the number of candidates in its text around it."""
    kind, start, end = span
    body = text[start:end]
    digits = _digits(body)
    groups = [len(g) for g in re.findall(r"[0-9]+", body)] or [0]
    left, right = text[max(0, start - 32) : start], text[end : end + 16]
    tail = re.split(r"[^A-Za-z0-9]+", body)[-1]
    parts = [int(p[:6]) for p in re.findall(r"[0-9]+", body)[:4]]
    return [
        float(kind == EMAIL), float(kind == IP), float(kind == CARD), float(kind == PHONE),
        len(body), len(digits), sum(c.isalpha() for c in body), len(digits) / max(1, len(body)),
        len(groups), max(groups), min(groups), sum(not c.isalnum() for c in body),
        float(body[:1] == "+"), float(body[:1] == "("), float("@" in body or "＠" in body),
        float(" at " in body.lower()), float(any(c in body for c in "[({")), len(tail), float(tail.isalpha()),
        float(len(digits) >= 12 and luhn(digits)), float(len(parts) == 4 and max(parts) <= 255),
        _class(left[-1:]), _class(right[:1]), float(left.rstrip()[-1:] in (":", "=")),
        float(bool(_CUES[kind].search(left))), float(any(c.search(left + " " + right) for c in _CUES)), min(near, 20),
    ]


N_FEATURES = 27


def _apart(spans: list[Span], taken: list[Span]) -> list[bool]:
    """For each span whether it overlaps none of ``taken``."""
    if not taken:
        return [True] * len(spans)
    ends = sorted((s, e) for _, s, e in taken)
    starts = np.array([s for s, _ in ends])
    reach = np.maximum.accumulate(np.array([e for _, e in ends]))
    at = np.searchsorted(starts, [e for _, _, e in spans], side="left")
    return [bool(i == 0 or reach[i - 1] <= s) for i, (_, s, _) in zip(at, spans)]


def _described(text: str, spans: list[Span]) -> list[list[float]]:
    starts = np.array(sorted(s for _, s, _ in spans))
    near = [int(np.searchsorted(starts, s + 200) - np.searchsorted(starts, s - 200)) - 1 for _, s, _ in spans]
    return [features(text, span, n) for span, n in zip(spans, near)]


def _rewritten(kind: int, body: str, way: int) -> str:
    """A base span as people write it to hide or to format it."""
    if kind == EMAIL:
        at, dot = ((" at ", " dot "), (" (at) ", " (dot) "), ("[at]", "."), ("(at)", "."))[way % 4]
        local, _, domain = body.partition("@")
        return local + at + domain.replace(".", dot)
    if kind == IP:
        return body.replace(".", ("[.]", "(.)", " . ", "[dot]")[way % 4])
    digits = _digits(body)
    if kind == CARD:
        sep = (".", "/", " - ", "_")[way % 4]
        return sep.join(digits[i : i + 4] for i in range(0, len(digits), 4))
    sep = ("-", ".", " ", "/")[way % 4]
    tail = sep.join((digits[-7:-4], digits[-4:]))
    return f"({digits[:-7]}) {tail}" if way % 2 and digits[:-7] else f"{digits[:-7]}{sep}{tail}"


def _spoiled(kind: int, body: str, way: int) -> str:
    """A stretch that looks like a rewritten span but fails what defines the kind."""
    digits = _digits(body)
    if kind == CARD:
        spoiled = digits[:-1] + str((int(digits[-1]) + 1 + way % 8) % 10)
        return _rewritten(CARD, spoiled, way)
    if kind == IP:
        return _rewritten(IP, ".".join(str(int(p) + 300) for p in body.split(".")), way)
    if kind == EMAIL:
        return f"{body.partition('@')[0]} at {body.partition('@')[2].replace('.', ' ')}"
    return ".".join(digits[i : i + 1] for i in range(len(digits)))


def examples(text: str, bound: int = 64) -> tuple[list[list[float]], list[int], list[int]]:
    """(features, labels, kinds) of at most ``bound`` training candidates of one text."""
    base = base_spans(text)
    proposed = candidates(text)
    free = [s for s, ok in zip(proposed, _apart(proposed, base)) if ok][:bound]
    rows, labels, kinds = _described(text, free), [0] * len(free), [k for k, _, _ in free]
    for i, (kind, start, end) in enumerate(base[: bound // 8]):
        for way in range(4):
            for label, make in ((1, _rewritten), (0, _spoiled)):
                body = make(kind, text[start:end], way + i)
                left, right = text[max(0, start - 300) : start], text[end : end + 300]
                around = left + body + right
                spans = [s for s in candidates(around) if s[1] < len(left) + len(body) and s[2] > len(left)]
                same = [s for s in spans if s[0] == kind]
                rows += _described(around, same)
                labels += [label] * len(same)
                kinds += [kind] * len(same)
    return rows, labels, kinds


class SpanModel:
    """Trees and one cut per kind; without training rows no candidate is chosen."""

    def __init__(self, rows: np.ndarray, labels: np.ndarray, kinds: np.ndarray, precision: float = 0.97) -> None:
        part = np.arange(len(labels)) % 4
        fit, hold = part != 3, part == 3
        self.trees = BoostedTrees().fit(rows[fit], labels[fit]).calibrate(rows[hold], labels[hold])
        p = self.trees.probability(rows[hold]) if hold.any() else np.empty(0)
        self.cuts = []
        for kind in range(len(KINDS)):
            on = kinds[hold] == kind
            enough = on.any() and labels[hold][on].sum() >= 5
            self.cuts.append(max(0.5, threshold_for(p[on], labels[hold][on], precision)) if enough else 2.0)

    def chosen(self, texts: list[str], base: list[list[Span]]) -> list[list[Span]]:
        """Candidates to add to each text's base spans: above their kind's cut, likeliest first, none overlapping."""
        rows, owners, spans = [], [], []
        for i, (text, taken) in enumerate(zip(texts, base)):
            proposed = candidates(text)
            if proposed:
                free = [s for s, ok in zip(proposed, _apart(proposed, taken)) if ok]
                rows += _described(text, free)
                owners += [i] * len(free)
                spans += free
        added: list[list[Span]] = [[] for _ in texts]
        if not rows:
            return added
        p = self.trees.probability(np.array(rows, float))
        taken: list[list[tuple[int, int]]] = [[] for _ in texts]  # (start, end) of what is added, in order
        for j in np.argsort(-p, kind="stable"):
            kind, start, end = spans[j]
            held = taken[owners[j]]
            at = bisect_left(held, (start, end))
            free = (at == 0 or held[at - 1][1] <= start) and (at == len(held) or end <= held[at][0])
            if p[j] >= self.cuts[kind] and free:
                held.insert(at, (start, end))
                added[owners[j]].append(spans[j])
        return added


def fit(
    df: DataFrame, doc_id: str = "doc_id", text: str = "text", sample: int = 20_000, most: int = 300_000
) -> SpanModel:
    """Fit on the candidates of at most ``sample`` distinct documents, and on at most ``most`` of those.

    Both are chosen by hashes, of id and text and of the candidate's features. Documents without an id
    are left out of it; repeated rows teach once; without any candidate none is ever chosen.
    """

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out: list[tuple[bytes, int, int]] = []
            for value in batch["t"]:
                out += [(np.array(x, "<f8").tobytes(), y, kind) for x, y, kind in zip(*examples(value or ""))]
            yield pd.DataFrame(out, columns=["x", "y", "kind"])

    texts = sample_rows(df, doc_id, text, sample).select(F.col(text).cast("string").alias("t"))
    found = texts.mapInPandas(rows, "x binary, y int, kind int")
    got = found.orderBy(F.xxhash64("x", "y", "kind"), "x", "y", "kind").limit(most).toPandas()
    x = np.frombuffer(b"".join(got["x"]), "<f8").reshape(-1, N_FEATURES)
    return SpanModel(x, got["y"].to_numpy(int), got["kind"].to_numpy(int))


_SPAN = T.ArrayType(
    T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
)


def _spans_of(batch: pa.RecordBatch, text: str, model: SpanModel) -> tuple[list[str], list[list[Span]], list[list[Span]]]:
    texts = texts_in(batch, text)
    base = [base_spans(t) for t in texts]
    return texts, base, model.chosen(texts, base)


def find(df: DataFrame, model: SpanModel, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add ``base`` and ``added``: arrays of (kind, start, end) in code points, end exclusive.

    Null and empty texts have none. Rows are independent of each other; columns of those names are
    replaced.
    """
    shipped = df.sparkSession.sparkContext.broadcast(pickle.dumps(model))

    def make(batch: pa.RecordBatch) -> list[pa.Array]:
        _, base, added = _spans_of(batch, text, pickle.loads(shipped.value))
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        as_rows = lambda found: [[{"kind": KINDS[k], "start": s, "end": e} for k, s, e in sorted(x)] for x in found]
        return [pa.array(as_rows(base), kind), pa.array(as_rows(added), kind)]

    return with_columns(df, [T.StructField("base", _SPAN), T.StructField("added", _SPAN)], make, keep)


def _redacted(text: str, spans: list[Span]) -> str:
    out, at = [], 0
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= at:
            out += [text[at:start], f"[{KINDS[kind].upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact(df: DataFrame, model: SpanModel, text: str = "text", n_chars: str | None = "n_chars") -> DataFrame:
    """Replace every span, base or added, by its kind in brackets; overlapping spans become one.

    A null text stays null. ``n_chars``, where the table has it, becomes the new length.
    """
    shipped = df.sparkSession.sparkContext.broadcast(pickle.dumps(model))
    fields = [T.StructField("_llm_text", T.StringType())]

    def make(batch: pa.RecordBatch) -> list[pa.Array]:
        texts, base, added = _spans_of(batch, text, pickle.loads(shipped.value))
        null = batch.column(batch.schema.get_field_index(text)).is_null().to_pylist()
        return [pa.array([None if n else _redacted(t, b + a) for t, b, a, n in zip(texts, base, added, null)], pa.string())]

    done = with_columns(df, fields, make, [c for c in df.columns if c != text])
    cleaned = {text: F.col("_llm_text")}
    if n_chars and n_chars in df.columns:
        cleaned[n_chars] = F.length("_llm_text").cast(df.schema[n_chars].dataType)
    return done.select(*[cleaned.get(c, F.col(c)).alias(c) for c in df.columns])


def listed(*spans: str) -> Column:
    """All spans of the given columns as ``kind:start:end``, by kind as in ``KINDS``, then start, comma-joined."""
    order = F.array(*[F.lit(k) for k in KINDS])
    every = F.concat(*[F.col(c) for c in spans])
    keyed = F.transform(every, lambda s: F.struct(F.array_position(order, s.kind).alias("k"), s.start, s.end, s.kind))
    return F.array_join(F.transform(F.array_sort(keyed), lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")


def count_of(kind: str, spans: str = "base") -> Column:
    return F.size(F.filter(spans, lambda s: s.kind == kind)).cast("long")
