"""A factorisation machine that scores the quality of texts."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, quoted, text_bytes, word_hashes
from .text_features import STATS, bounded_sample, logistic, statistics


@dataclass
class FactorisationMachine:
    """Bias, weights and factors over 2^bits hashed words followed by STATS and metadata, which are standardised by mean and deviation."""

    bits: int
    bias: float
    weights: np.ndarray
    factors: np.ndarray
    mean: np.ndarray
    deviation: np.ndarray
    metadata: tuple[str, ...] = ()

    def scores(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        return logistic(self.margins(rows))

    def margins(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """bias + sum w x + 1/2 sum over factors of ((sum v x)^2 - sum v^2 x^2): linear in the features of a row."""
        out, lo = [np.zeros(0)], 0
        while lo < len(rows):  # rows of some 2^16 features at a time; each row has its statistics, so none is empty
            hi, n = lo, 0
            while hi < len(rows) and (hi == lo or n < 1 << 16):
                n += len(rows[hi][0])
                hi += 1
            at, x = (np.concatenate([r[k] for r in rows[lo:hi]]) for k in (0, 1))
            starts = np.cumsum([0, *(len(r[0]) for r in rows[lo : hi - 1])])
            out.append(self._sums(at, x, starts)[0])
            lo = hi
        return np.concatenate(out)

    def _sums(self, at: np.ndarray, x: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(margins, sums of v x by row, v): features at with values x, rows beginning at starts."""
        v = self.factors[at]
        scaled = v * x[:, None]
        vx = np.add.reduceat(scaled, starts)
        pairs = (vx * vx).sum(1) - np.add.reduceat((scaled * scaled).sum(1), starts)
        return self.bias + np.add.reduceat(self.weights[at] * x, starts) + 0.5 * pairs, vx, v


def hashed_row(text: bytes, bits: int, metadata: tuple = ()) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(buckets, values, statistics) of a whole text: values are log counts of the distinct hashed words, of length 1 together.

    Metadata are numbers, appended to the statistics as logarithms; null, negative and not finite count as 0.
    """
    words, lengths = word_hashes(text)
    own, times = np.unique(words, return_counts=True)
    bucket = (own >> np.uint64(64 - bits)).astype(np.int64)  # in order, as the words are
    starts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else np.zeros(0, np.int64)
    x = np.log1p(np.add.reduceat(times, starts)).astype(np.float32) if len(starts) else np.zeros(0, np.float32)
    more = [np.log1p(m) if m is not None and np.isfinite(m) and m > 0 else 0.0 for m in metadata]
    return bucket[starts], x / max(1e-9, float(np.sqrt((x * x).sum()))), np.concatenate([statistics(text, words, lengths, times), np.array(more, np.float32)])


def _whole(at, x, stats, bits, mean, deviation):
    z = np.clip((stats - mean) / deviation, -5, 5).astype(np.float32) / np.float32(len(stats) ** 0.5)
    return np.concatenate([at, (1 << bits) + np.arange(len(stats))]), np.concatenate([x, z])


def fit(rows: list, labels: np.ndarray, bits: int, metadata: tuple[str, ...] = (), rank: int = 8, epochs: int = 12, rate: float = 0.1, decay: float = 1e-4, seed: int = 1) -> FactorisationMachine:
    """Logistic loss, AdaGrad over mini-batches of 64. With one label only, or none, the score is that share everywhere (0.5)."""
    rng = np.random.default_rng(seed)
    width = len(STATS) + len(metadata)
    size = (1 << bits) + width
    stats = np.array([r[2] for r in rows]).reshape(-1, width)
    mean = stats.mean(0) if len(rows) else np.zeros(width)
    deviation = stats.std(0) + 1e-6 if len(rows) else np.ones(width)
    share = float(np.clip(labels.mean(), 1e-3, 1 - 1e-3)) if len(rows) else 0.5
    fm = FactorisationMachine(bits, float(np.log(share / (1 - share))), np.zeros(size), rng.normal(0, 0.02, (size, rank)), mean, deviation, tuple(metadata))
    if len(set(labels.tolist())) < 2:
        return fm
    data = [_whole(*r, bits, mean, deviation) for r in rows]
    gw, gv, gb = np.full(size, 1e-2), np.full((size, rank), 1e-2), 1e-2
    for _ in range(epochs):
        order = rng.permutation(len(data))
        for k in range(0, len(order), 64):
            part = order[k : k + 64]
            at = np.concatenate([data[i][0] for i in part])
            x = np.concatenate([data[i][1] for i in part])
            starts = np.cumsum([0, *(len(data[i][0]) for i in part[:-1])])
            row = np.repeat(np.arange(len(part)), [len(data[i][0]) for i in part])
            z, vx, v = fm._sums(at, x, starts)
            x = x[:, None]
            err = (logistic(z) - labels[part]) / len(part)
            e = err[row][:, None]
            own, back = np.unique(at, return_inverse=True)
            dw = np.bincount(back, weights=(e * x)[:, 0], minlength=len(own)) + decay * fm.weights[own]
            grad = e * x * (vx[row] - v * x)
            dv = np.stack([np.bincount(back, weights=grad[:, f], minlength=len(own)) for f in range(rank)], 1) + decay * fm.factors[own]
            gw[own] += dw * dw
            gv[own] += dv * dv
            gb += err.sum() ** 2
            fm.weights[own] -= rate * dw / np.sqrt(gw[own])
            fm.factors[own] -= rate * dv / np.sqrt(gv[own])
            fm.bias -= rate * err.sum() / gb**0.5
    return fm


def train_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", bits: int = 14, most: int = 6000, metadata: tuple[str, ...] = ("n_chars",)) -> FactorisationMachine:
    """Fits on most labelled documents at most (a bounded sample, see bounded_sample); their features come to the driver, not their texts.

    Metadata are columns of numbers beside the text; those that docs doesn't have are left out of the model.
    """
    metadata = tuple(c for c in metadata if c in docs.columns)
    sample = bounded_sample(docs, labels, id_col, text_col, [label_col], most, more=metadata).select("id", "text", F.col(label_col).cast("int").alias("y"), *[f"more{i}" for i in range(len(metadata))])

    def features(batches):
        for batch in batches:
            got = [hashed_row(t, bits, m) for t, *m in zip(text_bytes(batch.column(1)), *(c.to_pylist() for c in batch.columns[3:]), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *(pa.array([f(g) for g in got], pa.binary()) for f in (lambda g: g[0].astype("<u4").tobytes(), lambda g: g[1].astype("<f4").tobytes(), lambda g: g[2].astype("<f4").tobytes()))], ["id", "y", "at", "x", "s"])

    kind = sample.schema["id"].dataType.simpleString()
    got = sorted(((r["id"], r["y"], r["at"], r["x"], r["s"]) for r in sample.mapInArrow(features, f"id {kind}, y int, at binary, x binary, s binary").toLocalIterator()), key=lambda r: r[0])
    rows = [(np.frombuffer(r[2], "<u4").astype(np.int64), np.frombuffer(r[3], "<f4"), np.frombuffer(r[4], "<f4")) for r in got]
    return fit(rows, np.array([r[1] for r in got], float), bits, metadata)


def score_quality(docs: DataFrame, model: FactorisationMachine, text_col: str = "text") -> DataFrame:
    """docs with quality_score, 0 to 1, of the whole text; null: as empty. Only the text and the model's metadata are read (null where docs lacks one); `_` is put before a clashing name."""
    m = docs.sparkSession.sparkContext.broadcast(model)
    (name,) = fresh(docs, "quality_score")

    @F.arrow_udf("double")
    def score(texts: pa.Array, metadata: pa.Array) -> pa.Array:
        fm = m.value
        rows = [_whole(*hashed_row(t, fm.bits, d or ()), fm.bits, fm.mean, fm.deviation) for t, d in zip(text_bytes(texts), metadata.to_pylist(), strict=True)]
        return pa.array(fm.scores(rows), pa.float64())

    more = [(quoted(c) if c in docs.columns else F.lit(None)).cast("double") for c in model.metadata]
    return docs.withColumn(name, score(F.coalesce(quoted(text_col).cast("string"), F.lit("")), F.array(*more).cast("array<double>")))


def held_out(id_column: Column) -> Column:
    """Whether a row is held out of learning: crc32 of the id as text is 2 modulo 4. A null id is not."""
    return F.coalesce(F.crc32(id_column.cast("string")) % 4 == 2, F.lit(False))


def op10_quality_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all documents, learnt from labels of rows that aren't held out. Of a row only its text and n_chars are read."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "n_chars")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = train_quality(docs, labels.where(~held_out(F.col("doc_id"))))
    out = score_quality(docs, model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= 0.7).cast("int").alias("predicted"))
