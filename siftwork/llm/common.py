"""What several operators of this subpackage share."""

from __future__ import annotations

import re
import tempfile
import uuid
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space and words, as everywhere in this subpackage.
SPACES = " \t\n\x0b\x0c\r"
WORD_RE = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir); where it is unset, as in tests, a temporary one of a local session."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        sc = spark.sparkContext
        if sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = sc.getCheckpointDir()
        if not path:
            path = "file://" + tempfile.mkdtemp(prefix="siftwork-")
            sc.setCheckpointDir(path)
    return path.rstrip("/")


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of texts are held to 500 rows, where the session says nothing else: texts can be very long, and an executor's Python workers hold several batches at once."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/siftwork-{label}-{uuid.uuid4().hex}"


def saved(df: DataFrame, label: str) -> DataFrame:
    """df written to the shared folder and read back: lineage is cut and a lost executor loses nothing."""
    path = new_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names made from these that df doesn't have yet, in any case."""
    have = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in have:
            name = f"_{name}"
        have.add(name.lower())
        out.append(name)
    return out


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def spread_join(left: DataFrame, right: DataFrame, on: str, by: str, how: str = "inner", salts: int = 8) -> DataFrame:
    """left joined to right, which has one row for each value of on, where a value may hold a third of left's rows.

    left's rows of a value are dealt by a hash of their column by, and right's rows are repeated for each salt. As right is
    then shuffled by itself, adaptive execution can also split what is still large.
    """
    (salt,) = fresh(left, "salt")
    l = left.withColumn(salt, F.pmod(F.xxhash64(quoted(by)), F.lit(salts)).cast("int"))
    r = right.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return l.join(r, [on, salt], how).drop(salt)


def merged_by_steps(parts: DataFrame, combine, fan: int = 64) -> DataFrame:
    """Rows (shard int, pid int, data binary) merged to one for each shard.

    combine joins a list of data. Tasks number below 2^18: groups of fan tasks are merged, then groups of fan of those, then
    all that are left, so no merge holds more than fan parts of a shard.
    """
    import pandas as pd

    def merge(pdf):
        return pd.DataFrame({"shard": pdf["shard"].iloc[:1].to_numpy(), "pid": [int(pdf["pid"].iloc[0]) // fan], "data": [combine(list(pdf["data"]))]})

    for _ in range(3):
        parts = parts.groupBy("shard", F.expr(f"pid div {int(fan)}")).applyInPandas(merge, "shard int, pid int, data binary")
    return parts.select("shard", "data")


def texts_of(column) -> list[str]:
    """An Arrow string column as texts; null: empty. Spark's strings can hold bytes that aren't UTF-8: those count as U+FFFD."""
    return [x.decode("utf-8", "replace") for x in text_bytes(column)]


def text_bytes(column) -> list[bytes]:
    """An Arrow string column as UTF-8 bytes; null: empty."""
    import pyarrow as pa

    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


#: A run of white space, as Unicode has it, that the tokenizer's pattern isn't given: from some 700,000 on its matcher overflows its stack.
_LONG_RUN = 100_000
_RUN = re.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{%d,}" % _LONG_RUN)


@lru_cache(maxsize=4)
def ordinary_encoder(name: str):
    """A function from a text to its ids, for the tiktoken file of that name; special tokens' strings are ordinary text.

    A very long run of white space is merged as the one piece that the pattern would make of it (without its last character
    if words follow, which that character goes with), so the ids are the same.
    """
    import base64

    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path(f"{name}.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    made = lru_cache(lambda pattern: tiktoken.Encoding(name, pat_str=pattern, mergeable_ranks=ranks, special_tokens={}))  # each once, where it is needed
    e = made(public_tokenizers.PATTERN)

    def encode(text: str) -> list[int]:
        if len(text) < _LONG_RUN:
            return e.encode_ordinary(text)
        out, at = [], 0
        for run in _RUN.finditer(text):
            end = run.end() - (run.end() < len(text))
            out += e.encode_ordinary(text[at : run.start()])
            out += made(r"(?s:.+)").encode_ordinary(text[run.start() : end])
            at = end
        return out + e.encode_ordinary(text[at:])

    return encode


_MULT = np.uint64(0x9E3779B97F4A7C15 | 1)
_INV = np.uint64(pow(int(_MULT), -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}
_BLOCK = 1 << 18


def _power(base: np.uint64, name: str, n: int) -> np.ndarray:
    have = _powers.get(name)
    if have is None or len(have) < n:
        have = np.full(max(n, _BLOCK), base, np.uint64)
        have[0] = 1
        np.multiply.accumulate(have, out=have)
        if n <= 4 * _BLOCK:  # longer ones are used once and dropped
            _powers[name] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of uint64."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[32, 9, 10, 11, 12, 13]] = True


def distinct(x: np.ndarray) -> np.ndarray:
    """The sorted distinct values of an array; a sort is several times as fast here as the hashing of np.unique."""
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def _block_hashes(a: np.ndarray, prefix: int = 0) -> tuple[np.ndarray, np.ndarray]:
    space = np.ones(len(a) + 2, bool)
    space[1:-1] = _IS_SPACE[a]
    edge = np.flatnonzero(space[1:] != space[:-1])
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    sums = np.zeros(len(a) + 1, np.uint64)
    np.cumsum((a.astype(np.uint64) + np.uint64(1)) * _power(_MULT, "mult", len(a)), out=sums[1:])
    last = np.minimum(end, start + prefix) if prefix else end
    return mix((sums[last] - sums[start]) * _power(_INV, "inv", len(a))[start]), end - start


def word_hashes(text: bytes, prefix: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash and the length in bytes of each word of a text, in order; a polynomial hash from prefix sums, without a Python step per word.

    With prefix the hashes are of the words' first so many bytes.
    """
    a = np.frombuffer(text, np.uint8)
    if len(a) <= _BLOCK:
        return _block_hashes(a, prefix)
    parts, at = [], 0
    while at < len(a):
        end = at + _BLOCK
        while end < len(a):  # a block ends at white space, however far that is
            if len(gap := np.flatnonzero(_IS_SPACE[a[end : end + _BLOCK]])):
                end += int(gap[0])
                break
            end += _BLOCK
        parts.append(_block_hashes(a[at:end], prefix))
        at = end
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def ngram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the windows of n words; a shorter text with words has one window."""
    if not len(words):
        return words
    n = min(n, len(words))
    h = words[: len(words) - n + 1].copy()
    for i in range(1, n):
        h *= _MULT
        h += words[i : len(words) - n + 1 + i]
    return mix(h)
