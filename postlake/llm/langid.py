"""Language identification by Bayesian fusion of text, declared language, address suffix and host.

The text's likelihood under each language comes from hashed character trigrams. How often a host
serves each language is counted over the whole corpus by grouped aggregation and smoothed towards
its suffix, and that towards all. What a declared language is worth is counted in the same way.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postlake.llm.common import stored, texts_in, with_columns

UNKNOWN = "und"
#: What a label must look like to name a language.
CODE = r"^[a-z]{2,3}([-_][a-z0-9]+)*$"
_BITS = 15
_NO_WORD = re.compile(r"\S*[0-9]\S*|[\W_]+")
_PART = 1 << 18  # code points scored at a time
#: Trigrams overlap, so their likelihoods are divided by this much before they meet other evidence.
TEMPER = 4.0


def _trigrams(text: str) -> Iterator[np.ndarray]:
    """Hashed character trigrams of the lower-cased words, in parts; words that hold a digit say nothing."""
    text = f" {_NO_WORD.sub(' ', text.lower()).strip()} "
    for at in range(0, max(1, len(text) - 2), _PART):
        c = np.frombuffer(text[at : at + _PART + 2].encode("utf-32-le", "surrogatepass"), "<u4")
        h = c[:-2] * np.uint32(0x9E3779B1) + c[1:-1] * np.uint32(0x85EBCA6B) + c[2:] * np.uint32(0xC2B2AE35)
        yield (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(32 - _BITS)


class TextModel:
    """Log-likelihood tables: one per language and a flat one for text of no known language."""

    def __init__(self, counts: dict[str, np.ndarray]) -> None:
        self.languages = sorted(counts)
        rows = [np.log((counts[x] + 0.1) / (counts[x].sum() + 0.1 * (1 << _BITS))) for x in self.languages]
        flat = np.full(1 << _BITS, -_BITS * np.log(2.0))
        self.table = np.stack([*rows, flat], 1).astype(np.float32)

    @property
    def names(self) -> list[str]:
        return [*self.languages, UNKNOWN]

    def scores(self, text: str) -> np.ndarray:
        """Tempered log-likelihoods. A text without a letter is of no known language."""
        total = np.zeros(len(self.names))
        if not any(map(str.isalpha, text)):
            total[:-1] = -1e3
            return total
        for idx in _trigrams(text):
            total += self.table[idx].sum(0, dtype=np.float64)
        return (total - total.max()) / TEMPER


def sample_by_language(labelled: DataFrame, bound: int) -> DataFrame:
    """Of rows (l, h, ...) at most ``bound`` distinct ones of each l, those of the smallest hash h (up to 2**52).

    Hashes are uniform, so about twice ``bound`` of a language lie below a limit that follows from its
    count; only those meet in one task, however common the language is. Every l has a row.
    """
    keys = stored(labelled.select("l", "h"), "labels")
    limit = F.lit(2.0 * bound * (1 << 52)) / F.approx_count_distinct("h")
    near = keys.join(F.broadcast(keys.groupBy("l").agg(limit.alias("_limit"))), "l").where("h <= _limit")
    rank = F.row_number().over(Window.partitionBy("l").orderBy("h"))
    ranked = near.select("l", "h").distinct().withColumn("_n", rank).where(F.col("_n") <= bound)
    cuts = stored(ranked.groupBy("l").agg(F.max("h").alias("_cut")), "cuts")
    return labelled.join(F.broadcast(cuts), "l").where("h <= _cut").drop("_cut").dropDuplicates(["l", "h"])


def fit(df: DataFrame, key: str, text: str, lang: str, sample: int = 3000, least: int = 1) -> TextModel:
    """Trigram counts of at most ``sample`` labelled rows of each language, chosen by the hash of ``key`` and text.

    Languages are counted over the whole table. Those with fewer than ``least`` distinct rows are left out;
    by default every declared language is in the model, which takes 128 KB for each. Repeated rows teach once.
    Labels that are no language code (two or three letters, with or without further parts) teach nothing, so
    junk in that column makes no languages.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        rows: dict[str, int] = {}
        for batch in batches:
            for value, name in zip(batch["t"], batch["l"]):
                table = sums.setdefault(name, np.zeros(1 << _BITS))
                rows[name] = rows.get(name, 0) + 1
                for idx in _trigrams(value or ""):
                    table += np.bincount(idx, minlength=1 << _BITS)
        yield pd.DataFrame({"l": list(sums), "n": [rows[x] for x in sums], "c": [sums[x].astype("<f4").tobytes() for x in sums]}, dtype=object)

    name = F.lower(F.col(lang).cast("string"))
    hashed = F.xxhash64(F.col(key).cast("string"), F.col(text).cast("string"))
    labelled = df.select(F.col(text).cast("string").alias("t"), name.alias("l"), F.pmod(hashed, F.lit(1 << 52)).alias("h"))
    labelled = labelled.where(F.rlike("l", F.lit(CODE)) & (F.col("l") != UNKNOWN))
    found = sample_by_language(labelled, sample).select("t", "l").coalesce(8).mapInPandas(count, "l string, n long, c binary").collect()
    counts: dict[str, np.ndarray] = {}
    rows: dict[str, int] = {}
    for r in found:
        counts[r.l] = counts.get(r.l, 0) + np.frombuffer(r.c, "<f4").astype(float)
        rows[r.l] = rows.get(r.l, 0) + r.n
    return TextModel({x: c for x, c in counts.items() if rows[x] >= least})


def scored(df: DataFrame, model: TextModel, text: str, keep: list[str] | None = None) -> DataFrame:
    """Add _ll, the tempered log-likelihoods in the order of ``model.names``."""
    shipped = df.sparkSession.sparkContext.broadcast(pickle.dumps(model))

    def make(batch: pa.RecordBatch) -> list[pa.Array]:
        held = pickle.loads(shipped.value)
        return [pa.array([held.scores(t) for t in texts_in(batch, text)], pa.list_(pa.float64()))]

    return with_columns(df, [T.StructField("_ll", T.ArrayType(T.DoubleType()))], make, keep)


def _softmax(logs: Column) -> Column:
    top = F.array_max(logs)
    powers = F.transform(logs, lambda x: F.exp(x - top))
    total = F.aggregate(powers, F.lit(0.0), lambda s, x: s + x)
    return F.transform(powers, lambda x: x / total)


def _summed(df: DataFrame, keys: list[str], column: str, n: int) -> DataFrame:
    return df.groupBy(*keys).agg(F.array(*[F.sum(F.col(column)[i]) for i in range(n)]).alias("n"))


def _smoothed(counts: Column, prior: Column, weight: float) -> Column:
    """(counts + weight * prior) / their sum."""
    total = F.aggregate(counts, F.lit(weight), lambda s, x: s + x)
    return F.zip_with(counts, prior, lambda c, p: (c + F.lit(weight) * p) / total)


def _floats(values: list[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


class Evidence:
    """Corpus-wide priors: of hosts, of declared languages, of all. Hosts stay a table of their own."""

    def __init__(self, hosts: DataFrame, suffixes: DataFrame, declared: DataFrame, overall: list[float]) -> None:
        self.hosts, self.suffixes, self.declared, self.overall = hosts, suffixes, declared, overall


def gather(scores: DataFrame, model: TextModel, weight: float = 20.0) -> Evidence:
    """Count soft decisions of the texts alone by host, suffix and declared language, and smooth them.

    ``scores`` has _host, _suffix, _declared and _ll. Sums are combined on the map side, so a host
    with a third of all rows costs no single task.
    """
    n = len(model.names)
    rows = scores.select("_host", "_suffix", "_declared", _softmax(F.col("_ll")).alias("p"))
    cells = stored(_summed(rows, ["_host", "_suffix", "_declared"], "p", n), "languages")
    total = cells.agg(*[F.sum(F.col("n")[i]) for i in range(n)]).first()
    known = [x or 0.0 for x in total]
    overall = [(x + 1.0 / n) / (sum(known) + 1.0) for x in known]
    suffixes = _summed(cells, ["_suffix"], "n", n).select(
        "_suffix", _smoothed(F.col("n"), _floats(overall), weight).alias("_by_suffix")
    )
    hosts = _summed(cells, ["_host", "_suffix"], "n", n).join(suffixes, "_suffix")
    hosts = hosts.select("_host", "_suffix", _smoothed(F.col("n"), F.col("_by_suffix"), weight).alias("_by_host"))
    declared = _summed(cells, ["_declared"], "n", n).select(
        "_declared", _smoothed(F.col("n"), _floats(overall), weight).alias("_by_declared")
    )
    return Evidence(stored(hosts, "hosts"), stored(suffixes, "suffixes"), stored(declared, "declared"), overall)


def fused(scores: DataFrame, model: TextModel, evidence: Evidence) -> DataFrame:
    """Add _language and _confidence: the likeliest language given all evidence, ties to the first name.

    Which side of the joins is broadcast is left to Spark's size check.
    """
    joined = scores.join(evidence.hosts, ["_host", "_suffix"], "left").join(evidence.declared, "_declared", "left")
    overall = _floats(evidence.overall)
    parts = F.arrays_zip(
        F.col("_ll").alias("ll"),
        F.coalesce("_by_host", overall).alias("h"),
        F.coalesce("_by_declared", overall).alias("d"),
        overall.alias("o"),
    )
    logs = F.transform(parts, lambda x: x["ll"] + F.log(x["h"]) + F.log(x["d"]) - F.log(x["o"]))
    best = F.array_max("_post")
    names = F.array(*[F.lit(x) for x in model.names])
    return (
        joined.withColumn("_post", _softmax(logs))
        .withColumns({"_confidence": best, "_language": F.element_at(names, F.array_position("_post", best).cast("int"))})
        .drop("_post", "_by_host", "_by_declared")
    )


def _named(column: Column | None) -> Column:
    return F.lit("") if column is None else F.lower(F.coalesce(column.cast("string"), F.lit("")))


def identify(
    df: DataFrame,
    model: TextModel,
    text: str = "text",
    declared: Column | None = None,
    suffix: Column | None = None,
    host: Column | None = None,
    keep: list[str] | None = None,
) -> DataFrame:
    """Add _language and _confidence to each row, and keep the columns named (default: all).

    Null evidence counts as the evidence "". Texts without a letter, empty and null ones too, are
    ``und``. Repeated rows get equal answers and count as often as they occur. An empty table gives
    an empty table. Texts are scored twice: for the counts, and with them.
    """
    primary = F.regexp_extract(_named(declared), r"^([a-z]{2,3})(?:[-_].*)?$", 1)
    keep = df.columns if keep is None else keep
    marked = df.select(
        *dict.fromkeys([*keep, text]), primary.alias("_declared"), _named(suffix).alias("_suffix"), _named(host).alias("_host")
    )
    evidence_columns = ["_declared", "_suffix", "_host"]
    evidence = gather(scored(marked.select(text, *evidence_columns), model, text, evidence_columns), model)
    rows = scored(marked, model, text, [*keep, *evidence_columns])
    return fused(rows, model, evidence).select(*keep, "_language", "_confidence")


def page_parts(pages: DataFrame) -> DataFrame:
    """page_id, text, declared language, suffix and host of web pages (markup removed, white space single)."""
    html = F.coalesce("html", F.lit(""))
    text = F.regexp_replace(html, r"(?is)<(script|style)\b[^>]*>.*?</\1\s*>|<!--.*?-->|<[^>]*>", " ")
    host = F.coalesce(F.regexp_extract(F.lower("url"), r"^[a-z][a-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1), F.lit(""))
    return pages.select(
        "page_id",
        F.trim(F.regexp_replace(text, r"\s+", " ")).alias("text"),
        F.regexp_extract(html, r"(?is)<html\b[^>]*\slang\s*=\s*[\"']?([A-Za-z-]+)", 1).alias("declared"),
        F.regexp_extract(host, r"\.([a-z0-9-]+)$", 1).alias("suffix"),
        host.alias("host"),
    )


def accepted(languages: list[str] | None = None, confidence: float = 0.5) -> Column:
    """Whether a row's language is known, wanted and likely enough."""
    ok = (F.col("_language") != UNKNOWN) & (F.col("_confidence") >= confidence)
    return ok & F.col("_language").isin(languages) if languages else ok


