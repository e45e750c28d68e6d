"""Counting and truncating plain Python texts.

For lists at hand; tables go through `functions.columns`. With a session the texts are
spread over its executors, and results keep the order of the texts. The encoding
`estimate` counts and cuts by the upper-bound estimate; `reference` is then the
encoding whose tokens some of its classes are charged by.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, functions as F

from lexloom.functions.columns import Columns
from lexloom.operators import estimate
from lexloom.operators.registry import ESTIMATE, Encoding, load


def _loaded(encoding: str | Encoding, path: str) -> Encoding:
    return encoding if isinstance(encoding, Encoding) else load(encoding, path)


def _counters(reference: Encoding | None) -> estimate.Counters:
    if reference is None:
        raise KeyError(f"{ESTIMATE!r} needs the encoding it charges tokens by, as reference")
    return estimate.Counters(reference)


def _spread(spark: SparkSession, texts: list[str]) -> DataFrame:
    return spark.createDataFrame(list(enumerate(texts)), "place long, text string")


def batch_count(
    texts: Iterable[str],
    encoding: str | Encoding,
    path: str = "",
    with_special: bool = False,
    spark: SparkSession | None = None,
    reference: Encoding | None = None,
) -> list[int]:
    """Tokens of each text; NFC first where the encoding asks for it."""
    texts = list(texts)
    if encoding == ESTIMATE:
        counters = _counters(reference)
        if spark is None:
            return [counters.count(t) for t in texts]
        features = estimate.features(Columns(spark, reference), F.col("text"))
        counted = _spread(spark, texts).select("place", features.alias("f")).select("place", estimate.estimate(F.col("f")).alias("n"))
        return [r.n for r in sorted(counted.collect())]
    e = _loaded(encoding, path)
    if spark is None:
        count = (lambda t: len(e.encode_with_special(t))) if with_special else e.count
        return [count(e.prepare(t)) for t in texts]
    counted = _spread(spark, texts).select("place", Columns(spark, e).count(F.col("text"), with_special).alias("n"))
    return [r.n for r in sorted(counted.collect())]


def truncate(
    text: str, max_tokens: int, encoding: str | Encoding, path: str = "", reference: Encoding | None = None
) -> tuple[str, int]:
    """The text cut to so many tokens, and how many it had; an uncut text is returned as it is."""
    if encoding == ESTIMATE:
        cut = _counters(reference).truncate(text, max_tokens)
        return (text if cut["text"] == text else cut["text"]), cut["total"]
    e = _loaded(encoding, path)
    normal = e.prepare(text) if e.nfc else text
    cut = e.truncate(normal, max_tokens)
    return (text if cut.kept_tokens == cut.total_tokens else cut.text), cut.total_tokens


def batch_truncate(
    texts: Iterable[str],
    max_tokens: int,
    encoding: str | Encoding,
    path: str = "",
    spark: SparkSession | None = None,
    reference: Encoding | None = None,
) -> list[tuple[str, int]]:
    """truncate() of each text, in order."""
    texts = list(texts)
    if encoding == ESTIMATE:
        if spark is None:
            return [truncate(t, max_tokens, ESTIMATE, reference=reference) for t in texts]
        _counters(reference)
        cut = estimate.truncated(Columns(spark, reference), F.col("text"), max_tokens)
        rows = sorted(_spread(spark, texts).select("place", cut.alias("t")).collect(), key=lambda r: r.place)
        return [(r.t.text, r.t.total) for r in rows]
    e = _loaded(encoding, path)
    if spark is None:
        return [truncate(t, max_tokens, e) for t in texts]
    cut = _spread(spark, texts).select("place", Columns(spark, e).truncate(F.col("text"), max_tokens).alias("t"))
    rows = sorted(cut.collect(), key=lambda r: r.place)
    whole = lambda r: r.t.kept_tokens == r.t.total_tokens
    return [(texts[r.place] if whole(r) else r.t.text, r.t.total_tokens) for r in rows]
