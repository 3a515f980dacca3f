"""Features of texts for the linear models and factorisation machines here, from whole texts and without a Python step per word."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, distinct, ngram_hashes, quoted

#: Structure statistics of a text, in this order.
STATS = ("log_words", "log_bytes", "word_bytes", "distinct_words", "repeated_next", "distinct_triples", "top_word", "capitals", "digits", "symbols", "bars", "exclamations", "stops", "commas", "other_ascii", "non_ascii", "lines_a_word", "repeated_lines")

_CLASS = np.zeros(256, np.int64)
_CLASS[65:91] = 1
_CLASS[48:58] = 2
_CLASS[[ord(c) for c in "#*$%&<>@^~=+_\\"]] = 3
_CLASS[ord("|")] = 4
_CLASS[ord("!")] = 5
_CLASS[[ord("."), ord("?")]] = 6
_CLASS[[ord(","), ord(";"), ord(":")]] = 7
_CLASS[[ord(c) for c in "\"'()[]{}/-`"]] = 8
_CLASS[128:192] = 9  # continuation bytes: a non-ASCII character has one at least
_CLASS[10] = 10


def statistics(text: bytes, words: np.ndarray, lengths: np.ndarray, times: np.ndarray) -> np.ndarray:
    """STATS of a text, times being how often each distinct word occurs; all 0 without words but for log_bytes."""
    n = len(words)
    out = np.zeros(len(STATS), np.float32)
    out[1] = np.log1p(len(text))
    if not n:
        return out
    counts = np.bincount(_CLASS, weights=np.bincount(np.frombuffer(text, np.uint8), minlength=256), minlength=11)
    triples = ngram_hashes(words, 3)
    lines = [x for x in text.split(b"\n") if x.strip()]
    chars = int(lengths.sum())
    out[:] = (
        np.log1p(n), out[1], chars / n, len(times) / n, (words[1:] == words[:-1]).sum() / n, len(distinct(triples)) / len(triples), times.max() / n, counts[1] / chars,
        counts[2] / chars, counts[3] / n, counts[4] / n, counts[5] / n, counts[6] / n, counts[7] / n, counts[8] / n, counts[9] / chars, len(lines) / n, 1 - len(set(lines)) / max(1, len(lines)),
    )
    return out


def bounded_sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_cols: list[str], most: int, seed: int = 7, more: tuple[str, ...] = ()) -> DataFrame:
    """(id, text, label columns, more0...): most labelled documents at most, those with the least hash of seed and id.

    labels has id_col and label_cols, of which null ids and null labels don't count; of several rows of an id the largest
    labels hold, of several texts the largest. more are numbers that docs has of each text. The ids are cut to most before they meet the documents, so what is broadcast
    is bounded by most.
    """
    bounded_batches(docs.sparkSession)
    own = labels.select(quoted(id_col).alias("lab_id"), *[quoted(c).alias(f"lab{i}") for i, c in enumerate(label_cols)]).dropna()
    own = own.groupBy("lab_id").agg(*[F.max(f"lab{i}").alias(f"lab{i}") for i in range(len(label_cols))])
    own = own.orderBy(F.xxhash64(F.lit(seed), "lab_id"), "lab_id").limit(most)
    texts = docs.select(quoted(id_col).alias("id"), F.coalesce(quoted(text_col).cast("string"), F.lit("")).alias("text"), *[quoted(c).cast("double").alias(f"more{i}") for i, c in enumerate(more)])
    hit = texts.join(F.broadcast(own), F.col("id") == F.col("lab_id"))
    best = F.max(F.struct("text", *[f"more{i}" for i in range(len(more))])).alias("best")
    return hit.groupBy("id").agg(best, *[F.first(f"lab{i}").alias(c) for i, c in enumerate(label_cols)]).select("id", "best.*", *[quoted(c) for c in label_cols])


def logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))
