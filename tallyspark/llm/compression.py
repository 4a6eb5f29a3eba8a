"""Compression classifier: texts that compress better with a dictionary of good texts than with one of bad texts are good.

Two zstandard dictionaries are trained from labelled texts. A text is cut into blocks that are compressed one by one with
either dictionary (all of the text counts, and the last block weighs as the first); the difference of the two sizes by the
text's size is the only feature. A logistic curve, fitted on labelled texts that the dictionaries have not seen, turns it
into a score.

Texts that are null or empty have a difference of 0. Without both labels in training, every score is 0.5. An id, or a text,
that has both labels teaches nothing. Repeated rows each have their score, an empty table has none. Columns of the input
that have the output's name are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .flattext import text_bytes
from .langid import stretch
from .shared import small_batches, tidied

BLOCK = 2048


@dataclass(frozen=True)
class Limits:
    """The bounded sample of labelled rows that the classifier is fitted on: per label as many ids as are expected from a
    rate by a hash of the id, and never more than four times as many different texts. Of a longer text, one stretch of so
    many characters, from a place that a hash gives."""

    texts: int = 1500
    text_chars: int = 32 << 10
    dictionary: int = 64 << 10
    level: int = 3


@dataclass(frozen=True)
class Classifier:
    good: bytes
    bad: bytes
    slope: float
    intercept: float
    level: int = 3

    def difference(self, texts: Iterator[bytes] | Sequence[bytes]) -> np.ndarray:
        if not self.good or not self.bad:
            return np.array([0.0 for _ in texts])
        good, bad = (
            zstandard.ZstdCompressor(level=self.level, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_dict_id=False)
            for d in (self.good, self.bad)
        )
        out = []
        for text in texts:
            blocks = [text[i : i + BLOCK] for i in range(0, len(text), BLOCK)]
            total = sum(len(bad.compress(b)) - len(good.compress(b)) for b in blocks)
            out.append(total / max(len(text), 1))
        return np.array(out, np.float64)

    def score(self, difference: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * difference + self.intercept, -30, 30)))


def fit_curve(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> tuple[float, float]:
    """Logistic regression of one feature by Newton's method; both labels weigh the same."""
    scale = float(np.std(x)) or 1.0
    a = np.stack([x / scale, np.ones(len(x))], axis=1)
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        gradient = a.T @ (weight * (p - y)) + ridge * np.array([w[0], 0])
        hessian = (a * (weight * p * (1 - p))[:, None]).T @ a + np.diag([ridge, 1e-9])
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0] / scale), float(w[1])


def fit(texts: Sequence[bytes], labels: Sequence[int], limits: Limits = Limits()) -> Classifier:  # noqa: B008
    """Of each label, the even texts make its dictionary and the odd ones the curve."""
    sides = {y: [t for t, own in zip(texts, labels, strict=True) if own == y and t] for y in (0, 1)}
    if min(map(len, sides.values())) < 2:
        return Classifier(b"", b"", 0.0, 0.0, limits.level)
    dictionaries = {}
    for y, own in sides.items():
        blocks = [t[i : i + BLOCK] for t in own[::2] for i in range(0, len(t), BLOCK)]
        try:
            dictionaries[y] = zstandard.train_dictionary(limits.dictionary, blocks).as_bytes()
        except zstandard.ZstdError:  # too few texts to train on: their bytes are the dictionary
            dictionaries[y] = b"".join(blocks)[: limits.dictionary].ljust(8, b" ")
    plain = Classifier(dictionaries[1], dictionaries[0], 1.0, 0.0, limits.level)
    held = [(t, y) for y, own in sides.items() for t in own[1::2]]
    slope, intercept = fit_curve(plain.difference([t for t, _ in held]), np.array([y for _, y in held]))
    return Classifier(dictionaries[1], dictionaries[0], slope, intercept, limits.level)


def train(docs: DataFrame, labels: DataFrame, limits: Limits = Limits(), label: str = "quality") -> Classifier:  # noqa: B008
    """docs: doc_id, text; labels: doc_id and a column of 0 and 1, both of the training rows only. The sample goes to the
    driver: its size is bounded by limits, not by the input. Repeated texts count once."""
    ys = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.min(label).cast("int").alias("y"), F.max(label).cast("int").alias("other"))
    labels = ys.where("y = other").select("doc_id", "y")
    sizes = {r["y"]: r["n"] for r in labels.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}  # two rows
    draw = F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    wanted = F.lit(False)
    for y, n in sizes.items():
        wanted = wanted | ((F.col("y") == y) & (draw < limits.texts / n))
    chosen = labels.where(wanted)  # about 2 * limits.texts rows
    hashed = F.xxhash64("text", F.lit(9))
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").where(F.length("text") > 0)
    rows = rows.groupBy(hashed.alias("h"), stretch("text", hashed, limits.text_chars).alias("text")).agg(F.min("y").alias("y"), F.max("y").alias("other"))
    found = rows.where("y = other").orderBy("h").limit(8 * limits.texts).select(F.col("text").cast("binary").alias("text"), "y").toArrow()
    return fit(found["text"].to_pylist(), found["y"].to_pylist(), limits)


def score(df: DataFrame, model: Classifier, text: str = "text", out: str = "score", keep: Sequence[str] | None = None) -> DataFrame:
    """df with a column of scores from 0 to 1. One pass, no shuffle; the model is at most two dictionaries."""
    kept = [c for c in (df.columns if keep is None else keep) if c != out]
    small_batches(df.sparkSession)
    schema = T.StructType([*(df.schema[c] for c in kept), T.StructField(out, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, places = text_bytes(batch.column(0))
            data = memoryview(buf)
            texts = (data[a:b] for a, b in zip(places[:-1], places[1:], strict=True))
            scores = model.score(model.difference(texts)) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(scores, pa.float64())], schema.names)

    return df.select(F.col(f"`{text}`"), *(F.col(f"`{c}`").alias(f"kept{i}") for i, c in enumerate(kept))).mapInArrow(tidied(run), schema)
