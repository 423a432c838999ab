"""Mixing sources to target weights by iterative proportional fitting, in DataFrame operations only.

Token counts are gathered per source, language and topic. Languages and topics are short lists
given as parameters, so a source's counts are one row of languages x topics numbers; sources may be
as many as they like and stay distributed. A sweep is one aggregate over the source rows: each
source's factor follows from the factors of languages and topics within its row, and the summed
table (languages x topics numbers, whatever the corpus) updates those.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlake.llm.common import stored, text_of

OTHER = "other"

#: Default topic rules: the first whose pattern a text holds names its topic; ``prose`` otherwise.
TOPICS = {"legal": r"[Ll]icen[sc]e", "table": r" \| ", "loud": r"!! ", "marks": r"[#$%&*]{3}"}


@dataclass(frozen=True)
class Targets:
    """Wanted shares of tokens. Shares of what the corpus lacks go to the rest in proportion.

    ``source_power``: a source's share is its tokens to this power (1 keeps the corpus, 0 evens out).
    Languages and topics that are not listed count as ``other``.
    """

    languages: dict[str, float] = field(
        default_factory=lambda: {"en": 0.5, "de": 0.15, "fr": 0.15, "es": 0.15, OTHER: 0.05}
    )
    topics: dict[str, float] = field(
        default_factory=lambda: {"prose": 0.7, "legal": 0.05, "table": 0.1, "loud": 0.05, "marks": 0.1}
    )
    source_power: float = 0.5
    #: Tokens to sample, as a share of all.
    budget: float = 0.5


def topic_of(text: Column, rules: dict[str, str] | None = None) -> Column:
    topic = F.lit("prose")
    for name, pattern in reversed((rules or TOPICS).items()):
        topic = F.when(text.rlike(pattern), name).otherwise(topic)
    return topic


def n_tokens(text: Column) -> Column:
    """Parts of the text between single spaces; 0 for an empty text."""
    return F.when(text == "", F.lit(0)).otherwise(F.size(F.split(text, " "))).cast("long")


def described(df: DataFrame, targets: Targets, topics: dict[str, str] | None = None) -> DataFrame:
    """Add _source, _lang, _topic and _tokens. A null source is the source named by the empty text."""
    text = text_of("text")
    lang = F.lower(F.coalesce("lang", F.lit("")))
    listed = [x for x in targets.languages if x != OTHER]
    topic = topic_of(text, topics)
    return df.withColumns(
        {
            "_source": F.coalesce("source", F.lit("")),
            "_lang": F.when(lang.isin(listed), lang).otherwise(OTHER) if listed else F.lit(OTHER),
            "_topic": F.when(topic.isin(list(targets.topics)), topic).otherwise(OTHER),
            "_tokens": n_tokens(text),
        }
    )


def _cells(targets: Targets) -> list[tuple[str, str]]:
    langs = list(dict.fromkeys([*targets.languages, OTHER]))
    topics = list(dict.fromkeys([*targets.topics, OTHER]))
    return [(lang, topic) for lang in langs for topic in topics]


def _dot(counts: str, weights: list[float]) -> Column:
    """Sum of the counts of a row weighted by these numbers."""
    return F.aggregate(
        F.zip_with(counts, F.array(*[F.lit(float(w)) for w in weights]), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x
    )


def _shares(wanted: dict[str, float], present: set[str]) -> dict[str, float]:
    """Targets over what is there; what has no target keeps no share. Without any, all present alike."""
    kept = {k: float(v) for k, v in wanted.items() if k in present and v > 0}
    total = sum(kept.values())
    return {k: v / total for k, v in kept.items()} if total else {k: 1 / len(present) for k in present}


def fit(described_docs: DataFrame, targets: Targets, sweeps: int = 50, tolerance: float = 1e-6) -> DataFrame:
    """(_source, _factors): each source's weight per token for every cell of ``_cells(targets)``.

    Weights are shares of the wanted total divided by the cell's tokens' share, so that weight times
    tokens sums to the targets. Sweeps end when no margin is off by more than ``tolerance``; targets
    that contradict each other end after ``sweeps`` with sources and topics met as far as possible.
    """
    cells = _cells(targets)
    sums = described_docs.groupBy("_source", "_lang", "_topic").agg(F.sum("_tokens").cast("double").alias("n"))
    by_source = stored(
        sums.groupBy("_source")
        .agg(
            F.array(
                *[
                    F.coalesce(F.sum(F.when((F.col("_lang") == a) & (F.col("_topic") == b), F.col("n"))), F.lit(0.0))
                    for a, b in cells
                ]
            ).alias("counts"),
            F.sum("n").alias("total"),
        )
        .where("total > 0"),
        "mixture",
    )
    cell_sums = [F.sum(F.col("counts")[i]).alias(f"c{i}") for i in range(len(cells))]
    first = by_source.agg(
        F.sum(F.pow("total", F.lit(targets.source_power))).alias("power"), *cell_sums
    ).first()
    if first["power"] is None:
        return by_source.select("_source", F.col("counts").alias("_factors"))
    have = {c: first[f"c{i}"] for i, c in enumerate(cells)}
    langs = _shares(targets.languages, {a for (a, _), n in have.items() if n})
    topics = _shares(targets.topics, {b for (_, b), n in have.items() if n})
    by_lang = {a: 1.0 if a in langs else 0.0 for a, _ in cells}
    by_topic = {b: 1.0 if b in topics else 0.0 for _, b in cells}
    share = F.pow("total", F.lit(targets.source_power)) / F.lit(first["power"])
    for _ in range(sweeps):
        weights = [by_lang[a] * by_topic[b] for a, b in cells]
        inner = _dot("counts", weights)
        factor = F.when(inner > 0, share / inner).otherwise(F.lit(0.0))
        row = by_source.select("counts", factor.alias("a")).agg(
            *[F.sum(F.col("a") * F.col("counts")[i]).alias(f"c{i}") for i in range(len(cells))]
        ).first()
        now = {c: (row[f"c{i}"] or 0.0) * 1.0 for i, c in enumerate(cells)}
        now = {c: n * weights[i] for i, (c, n) in enumerate(now.items())}
        total = sum(now.values()) or 1.0
        off = max(
            [abs(sum(n for (a, _), n in now.items() if a == x) / total - t) for x, t in langs.items()]
            + [abs(sum(n for (_, b), n in now.items() if b == x) / total - t) for x, t in topics.items()]
        )
        if off <= tolerance:
            break
        for x, t in langs.items():
            got = sum(n for (a, _), n in now.items() if a == x)
            by_lang[x] *= t / got if got else 0.0
            now = {(a, b): n * (t / got if got else 0.0) if a == x else n for (a, b), n in now.items()}
        for x, t in topics.items():
            got = sum(n for (_, b), n in now.items() if b == x)
            by_topic[x] *= t / got if got else 0.0
            now = {(a, b): n * (t / got if got else 0.0) if b == x else n for (a, b), n in now.items()}
    weights = [by_lang[a] * by_topic[b] for a, b in cells]
    inner = _dot("counts", weights)
    factor = F.when(inner > 0, share / inner).otherwise(F.lit(0.0))
    factors = F.transform(F.array(*[F.lit(float(w)) for w in weights]), lambda w: w * factor)
    return _calibrated(stored(by_source.select("_source", "counts", factors.alias("_factors")), "factors"), targets.budget)


def _calibrated(factors: DataFrame, budget: float, tolerance: float = 1e-6, grid: int = 24) -> DataFrame:
    """Scale the factors to sampling probabilities, at most 1, whose expected tokens meet the budget.

    Each round tries a grid of scales in one aggregate and goes on between the two that enclose it,
    until the expected tokens are over the budget by at most ``tolerance`` of it. Scales and factors
    are logarithms: contradicting targets leave factors dozens of powers of ten apart. Expected
    tokens grow no faster than the scale, so the rounds are about as many as the logarithm, to the
    base ``grid``, of that span over the tolerance.
    """
    flat = factors.select(F.explode(F.arrays_zip("counts", "_factors")).alias("c")).where(
        "c.counts > 0 AND c._factors > 0"
    )
    flat = flat.select(F.col("c.counts").alias("n"), F.log("c._factors").alias("w"))
    ends = flat.agg(F.sum("n").alias("n"), F.min("w").alias("lo"), F.max("w").alias("hi")).first()
    total = factors.agg(F.sum(F.aggregate("counts", F.lit(0.0), lambda s, x: s + x))).first()[0]
    if ends["n"] is None:
        return factors.select("_source", "_factors")
    wanted = min(budget * total, ends["n"])
    if wanted <= 0:
        return factors.select("_source", F.transform("_factors", lambda w: F.lit(0.0)).alias("_factors"))
    low, high = math.log(wanted / ends["n"]) - ends["hi"], -ends["lo"]
    while wanted < ends["n"] and high - low > 1e-12:
        scales = [low + (high - low) * i / grid for i in range(1, grid + 1)]
        row = flat.agg(
            *[F.sum(F.col("n") * F.least(F.lit(1.0), F.exp(F.col("w") + F.lit(s)))).alias(f"s{i}") for i, s in enumerate(scales)]
        ).first()
        at = next((i for i in range(grid) if row[f"s{i}"] >= wanted), grid - 1)
        low, high = (scales[at - 1] if at else low), scales[at]
        if row[f"s{at}"] <= wanted * (1 + tolerance):
            break
    scaled = F.transform(
        "_factors", lambda w: F.when(w > 0, F.least(F.lit(1.0), F.exp(F.log(w) + F.lit(high)))).otherwise(F.lit(0.0))
    )
    return factors.select("_source", scaled.alias("_factors"))


def weighted(df: DataFrame, targets: Targets | None = None, topics: dict[str, str] | None = None) -> DataFrame:
    """Add _source, _lang, _topic, _tokens, _probability and _drawn (whether the document is sampled).

    The draw compares the probability with the hash of doc_id and text, so it is the same at every
    run, and repeated rows share it. Null lang, source and text count as empty. Empty texts weigh
    nothing in the fit and are drawn with their cell's probability. Sources without any token have
    probability 0. An empty table gives an empty table.
    """
    targets = targets or Targets()
    rows = described(df, targets, topics)
    factors = fit(rows, targets)
    cells = _cells(targets)
    index = F.lit(0)
    for i, (a, b) in enumerate(cells):
        index = F.when((F.col("_lang") == a) & (F.col("_topic") == b), i + 1).otherwise(index)
    hashed = F.xxhash64(F.col("doc_id").cast("string"), text_of("text"))
    uniform = F.pmod(hashed, F.lit(1 << 52)) / F.lit(float(1 << 52))
    return (
        rows.join(factors, "_source", "left")
        .withColumn("_probability", F.coalesce(F.element_at("_factors", index), F.lit(0.0)))
        .withColumn("_drawn", uniform < F.col("_probability"))
        .drop("_factors")
    )


def sample(df: DataFrame, targets: Targets | None = None) -> DataFrame:
    """The drawn documents, with the columns of ``df``."""
    return weighted(df, targets).where("_drawn").select(*df.columns)
