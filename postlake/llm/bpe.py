"""Byte-level BPE by prefix dynamic programming.

For every prefix of a byte string exactly one token can end its encoding: the one that forms a
valid pair with the last token of what lies before it. A pair of tokens is valid when encoding
their joined bytes gives the pair back. ``PrefixTable`` stores that last token for each prefix, so
that bytes can be appended without looking back and an edit costs only the bytes near it.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterable, Iterator, Sequence
from functools import lru_cache
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postlake.llm.common import texts_in, with_columns

#: Bytes that a worker spends on encoded pieces, about, and pairs it keeps judged. A full store starts anew.
STORE, PAIRS = 120_000_000, 150_000
#: Pieces that are looked up together, and code points of a text above which it is cut in several steps.
GROUP, LONG = 200_000, 1_000_000


def read_ranks(data: bytes) -> dict[bytes, int]:
    """Token bytes to rank, from the text of a rank file."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line)}


class Vocabulary:
    """Ranks, the pattern that cuts a text into pieces, and the encoding of a piece."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks = ranks
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.sizes = {rank: len(token) for token, rank in ranks.items()}
        self.split = regex.compile(pattern)
        self.longest = max(map(len, ranks), default=1)
        self._pairs: dict[int, bool] = {}
        self._formed: dict[int, bool] = {}
        self._halves: dict[int, tuple[int, int] | None] = {}
        self._empty()

    def _empty(self) -> None:
        """Forget all pieces."""
        self._place: dict[str, int] = {}  # piece to its place in the store
        self._ids, self._ends, self._held = array("i"), array("q", [0]), 0

    def merged(self, data: bytes, until: int = 1) -> list[int]:
        """Encoding by merging the pair of lowest rank first, down to ``until`` tokens."""
        none = len(self.ranks) + 1
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > until:
            rank, at = min((self.ranks.get(a + b, none), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
            if rank == none:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def formed(self, token: int) -> bool:
        """Whether merging can produce the token; if not, only a whole piece can be it."""
        known = self._formed.get(token)
        if known is None:
            known = self._formed[token] = self.merged(self.bytes_of[token]) == [token]
        return known

    def halves(self, token: int) -> tuple[int, int] | None:
        """The two tokens whose merge gives the token; None for a byte."""
        if token not in self._halves:
            data = self.bytes_of[token]
            self._halves[token] = tuple(self.merged(data, 2)) if len(data) > 1 else None
        return self._halves[token]

    def valid(self, left: int, right: int) -> bool:
        """Whether encoding the joined bytes of two tokens gives the two back.

        Their merges are undone at the border, the latest first. The pair is invalid when tokens
        that meet at the border would have merged before the merge just undone.
        """
        key = left << 32 | right
        known = self._pairs.get(key)
        if known is None:
            if len(self._pairs) >= PAIRS:
                self._pairs.clear()
            known = self._pairs[key] = self.formed(right) and self._stay_apart(left, right)
        return known

    def _stay_apart(self, left: int, right: int) -> bool:
        before = len(self.ranks) + 1  # a merge across the border counts if its rank is below this
        while True:
            joined = self.ranks.get(self.bytes_of[left] + self.bytes_of[right])
            if joined is not None and joined < before:
                return False
            a, b = self.halves(left), self.halves(right)
            if a is None and b is None:
                return True
            if b is None or (a is not None and left > right):
                before, left = left, a[1]
            else:
                before, right = right + 1, b[0]

    def extend(self, data: bytes, last: list[int], until: int | None = None) -> None:
        """Append to ``last`` the last token of each further prefix of ``data``, up to ``until`` bytes.

        Exactly one token can end a prefix, so the first that fits is it.
        """
        get, pair, longest, sizes = self.ranks.get, self._pairs.get, self.longest, self.sizes
        for end in range(len(last) + 1, (len(data) if until is None else until) + 1):
            # Mostly the byte lengthens the token before it or stands alone; then come all other starts.
            likely = (end - 1 - sizes[last[-1]], end - 1) if last else ()
            for start in chain(likely, range(end - longest if end > longest else 0, end)):
                token = get(data[start:end])
                if token is None:
                    continue
                if start:
                    before = last[start - 1]
                    fits = pair(before << 32 | token)
                    if fits is None:
                        fits = self.valid(before, token)
                else:
                    fits = self.formed(token)
                if fits:
                    last.append(token)
                    break
            else:
                raise ValueError(f"byte {data[end - 1]} has no token")

    def _learn(self, pieces: Iterable[str]) -> None:
        """Store the ids of new pieces. In byte order each starts from the prefixes it shares with the one before."""
        table = PrefixTable(self)
        for data, text in sorted((p.encode("utf-8", "surrogatepass"), p) for p in pieces):
            whole = self.ranks.get(data)
            if whole is not None:  # a piece that is a token is that token
                self._ids.append(whole)
            else:
                table.become(data)
                self._ids.extend(table.ids())
            self._place[text] = len(self._ends) - 1
            self._ends.append(len(self._ids))
            self._held += 200 + 6 * len(data)

    def _cut(self, texts: Sequence[str]) -> Iterator[tuple[int, list[str]]]:
        """Number of a text and some of its pieces, in order; a very long text comes in several steps."""
        for n, text in enumerate(texts):
            if len(text) <= LONG:
                yield n, self.split.findall(text)
            else:
                found = (m.group() for m in self.split.finditer(text))
                while some := list(islice(found, GROUP)):
                    yield n, some

    def _groups(self, texts: Sequence[str]) -> Iterator[list[tuple[int, list[str]]]]:
        group, size = [], 0
        for n, pieces in self._cut(texts):
            group.append((n, pieces))
            size += len(pieces)
            if size >= GROUP:
                yield group
                group, size = [], 0
        if group:
            yield group

    def encode_all(self, texts: Sequence[str]) -> list[np.ndarray]:
        """Ids of each text. Pieces are encoded once and their ids gathered."""
        found: list[list[np.ndarray]] = [[] for _ in texts]
        for group in self._groups(texts):
            if self._held > STORE:
                self._empty()
            self._learn(set(chain.from_iterable(p for _, p in group)).difference(self._place))
            many = sum(len(p) for _, p in group)
            place = np.fromiter(map(self._place.__getitem__, chain.from_iterable(p for _, p in group)), np.int64, many)
            ends = np.array(self._ends)
            ids, stops = gathered(np.array(self._ids), ends[:-1], np.diff(ends), place)
            last = stops[np.cumsum([len(p) for _, p in group])]
            for (n, _), part in zip(group, np.split(ids, last[:-1])):
                found[n].append(part)
        return [np.concatenate(parts) if len(parts) > 1 else parts[0] for parts in found]

    def piece(self, text: str) -> list[int]:
        """Ids of one piece."""
        if text not in self._place:
            if self._held > STORE:
                self._empty()
            self._learn([text])
        at = self._place[text]
        return self._ids[self._ends[at] : self._ends[at + 1]].tolist()

    def encode(self, text: str) -> list[int]:
        return self.encode_all([text])[0].tolist()

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


def gathered(table: np.ndarray, starts: np.ndarray, sizes: np.ndarray, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of ``table`` that ``pick`` names, one behind the other, and where each begins (and the end)."""
    size = sizes[pick]
    stops = np.concatenate([[0], np.cumsum(size)])
    return table[np.arange(stops[-1]) + np.repeat(starts[pick] - stops[:-1], size)], stops


class Runs:
    """A byte string for each id, to be put together for many ids at once."""

    def __init__(self, of: dict[int, bytes]) -> None:
        self.sizes = np.zeros(max(of, default=0) + 1, np.int64)
        for i, data in of.items():
            self.sizes[i] = len(data)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.table = np.frombuffer(b"".join(of[i] for i in sorted(of)), np.uint8)

    def joined(self, ids: np.ndarray) -> bytes:
        """The strings of the ids, in steps that bound the memory of a very long list."""
        steps = (ids[at : at + GROUP] for at in range(0, len(ids), GROUP))
        return b"".join(gathered(self.table, self.starts, self.sizes, step)[0].tobytes() for step in steps)


class PrefixTable:
    """The last token of every prefix of a byte string."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b"") -> None:
        self.vocabulary = vocabulary
        self.data = b""
        self.last: list[int] = []  # last[i]: token that ends the encoding of data[: i + 1]
        self.append(data)

    def append(self, more: bytes) -> None:
        """Extend the string; the tokens of earlier prefixes stay."""
        self.data += more
        self.vocabulary.extend(self.data, self.last)

    def become(self, data: bytes) -> None:
        """Hold ``data`` instead; the prefixes that it shares with the old string stay."""
        old, same, most = self.data, 0, min(len(self.data), len(data))
        while same < most and old[same] == data[same]:
            same += 1
        del self.last[same:]
        self.data = data
        self.vocabulary.extend(data, self.last)

    def replace(self, start: int, end: int, new: bytes) -> int:
        """Put ``new`` in place of bytes [start, end); returns how many prefixes were judged anew.

        Behind the edit a prefix's token depends on the tokens at most ``longest`` bytes before it.
        Once that many in a row are as before, so is everything after them.
        """
        data = self.data[:start] + new + self.data[end:]
        last, shift, same, done = self.last[:start], len(new) - (end - start), 0, 0
        reach = self.vocabulary.longest
        for stop in range(start + 1, len(data) + 1):
            self.vocabulary.extend(data, last, stop)
            token = last[-1]
            done += 1
            old = stop - 1 - shift
            same = same + 1 if stop > start + len(new) and token == self.last[old] else 0
            if same >= reach:
                last += self.last[old + 1 :]
                break
        self.data, self.last = data, last
        return done

    def ids(self) -> list[int]:
        """The encoding, read from the end."""
        found, at, last, sizes = [], len(self.data), self.last, self.vocabulary.sizes
        while at:
            token = last[at - 1]
            found.append(token)
            at -= sizes[token]
        found.reverse()
        return found


class EncodedText:
    """A text with the ids of its pieces, to which exact appends and edits can be made."""

    def __init__(self, vocabulary: Vocabulary, text: str = "") -> None:
        self.vocabulary = vocabulary
        self.text = text
        self.spans = [m.span() for m in vocabulary.split.finditer(text)]
        self.tokens = [vocabulary.piece(text[a:b]) for a, b in self.spans]

    def append(self, more: str) -> int:
        return self.replace(len(self.text), len(self.text), more)

    def replace(self, start: int, end: int, new: str) -> int:
        """Put ``new`` in place of code points [start, end); returns how many pieces were cut anew.

        A piece is settled by the text up to two code points behind it; cutting goes on behind the
        edit until it meets an old boundary, after which the old pieces hold.
        """
        text = self.text[:start] + new + self.text[end:]
        shift = len(new) - (end - start)
        head = len(self.spans)
        while head and self.spans[head - 1][1] + 2 > start:
            head -= 1
        begin = self.spans[head - 1][1] if head else 0
        old = {a + shift: i for i, (a, _) in enumerate(self.spans) if a >= end}
        spans, tokens, done = self.spans[:head], self.tokens[:head], 0
        for m in self.vocabulary.split.finditer(text, begin):
            if m.start() >= start + len(new) and m.start() in old:
                rest = old[m.start()]
                spans += [(a + shift, b + shift) for a, b in self.spans[rest:]]
                tokens += self.tokens[rest:]
                break
            spans.append(m.span())
            tokens.append(self.vocabulary.piece(m.group()))
            done += 1
        self.text, self.spans, self.tokens = text, spans, tokens
        return done

    def ids(self) -> list[int]:
        return [i for ids in self.tokens for i in ids]


@lru_cache(maxsize=1)
def _vocabulary(data: bytes, pattern: str) -> Vocabulary:
    return Vocabulary(read_ranks(data), pattern)


@lru_cache(maxsize=1)
def _token_bytes(data: bytes) -> Runs:
    return Runs({rank: token for token, rank in read_ranks(data).items()})


@lru_cache(maxsize=1)
def _decimals(data: bytes) -> Runs:
    """Each id in decimal, with a space behind it."""
    return Runs({rank: b"%d " % rank for rank in read_ranks(data).values()})


def _shipped(spark: SparkSession, ranks_path: str) -> Broadcast:
    """The rank file, sent to every executor; a vocabulary has a fixed size (about 1 MB)."""
    with open(ranks_path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def encode(df: DataFrame, ranks_path: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Add the column ``ids`` (array of int) with the encoding of the whole text of each row.

    Null and empty texts give an empty array. Other columns stay; one named ``ids`` is replaced.
    Rows are independent: repeated rows give equal arrays, an empty table gives an empty table.
    """
    shipped = _shipped(df.sparkSession, ranks_path)

    def make(batch: pa.RecordBatch) -> list[pa.Array]:
        arrays = _vocabulary(shipped.value, pattern).encode_all(texts_in(batch, text))
        offsets = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
        values = np.concatenate([np.empty(0, np.int32), *arrays])
        return [pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))]

    return with_columns(df, [T.StructField(ids, T.ArrayType(T.IntegerType()))], make)


def decode(df: DataFrame, ranks_path: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Add the column ``decoded`` (binary) with the bytes of the tokens in ``ids``; null ids give no bytes."""
    shipped = _shipped(df.sparkSession, ranks_path)

    def make(batch: pa.RecordBatch) -> list[pa.Array]:
        tokens = _token_bytes(shipped.value)
        column = batch.column(batch.schema.get_field_index(ids))
        flat, ends = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
        valid = column.is_valid().to_numpy(zero_copy_only=False)
        texts = [tokens.joined(flat[a:b]) if ok else b"" for a, b, ok in zip(ends[:-1], ends[1:], valid)]
        return [pa.array(texts, pa.binary())]

    return with_columns(df, [T.StructField(decoded, T.BinaryType())], make)


def digests(df: DataFrame, ranks_path: str, pattern: str, text: str = "text", keep: Sequence[str] | None = None) -> DataFrame:
    """Add n_tokens, ids_sha256 and decoded_sha256: what encoding each whole text gives, and decoding that again.

    Digests are lowercase hex: of the decimal ids joined by one space, and of the decoded bytes. Both
    ways are one pass, so a task has one worker with one vocabulary, and no ids leave it. A null text is
    the empty one. Rows are independent; columns of those names are replaced; an empty table gives an
    empty one.
    """
    shipped = _shipped(df.sparkSession, ranks_path)

    def make(batch: pa.RecordBatch) -> list[pa.Array]:
        coder = _vocabulary(shipped.value, pattern)
        tokens, decimals = _token_bytes(shipped.value), _decimals(shipped.value)
        counts, of_ids, of_bytes = [], [], []
        for ids in coder.encode_all(texts_in(batch, text)):
            counts.append(len(ids))
            of_ids.append(hashlib.sha256(memoryview(decimals.joined(ids))[:-1]).hexdigest())
            of_bytes.append(hashlib.sha256(tokens.joined(ids)).hexdigest())
        return [pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_bytes, pa.string())]

    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    return with_columns(df, fields, make, keep)


def ids_digest(ids: str | Column) -> Column:
    """SHA-256 of the decimal ids joined by one space."""
    column = F.col(ids) if isinstance(ids, str) else ids
    return F.sha2(F.array_join(column.cast("array<string>"), " "), 256)
