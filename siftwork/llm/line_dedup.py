"""Lines that repeat across documents, found with two Bloom filters."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACES, bounded_batches, fresh, merged_by_steps, quoted, saved, spread_join, texts_of

_SHARD = 1 << 16  # bytes of a filter that travel and are merged together


def line_keys(text: str | None, least_chars: int) -> list[bytes | None]:
    """The 128-bit key of each line of a text, None where the stripped line is shorter than least_chars."""
    import xxhash

    strip, digest = SPACES, xxhash.xxh3_128_digest
    return [digest(key.encode().lower()) if len(key := line.strip(strip)) >= least_chars else None for line in (text or "").split("\n")]


def _positions(keys: np.ndarray, bits: int, k: int) -> np.ndarray:
    """k bit positions for each key, a row of two uint64; bits is a power of two."""
    a, b = keys[:, 0], keys[:, 1] | np.uint64(1)
    return np.stack([(a + np.uint64(i) * b) & np.uint64(bits - 1) for i in range(k)])


def _as_rows(keys: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(keys), np.uint64).reshape(-1, 2)


def _packed(once: np.ndarray, twice: np.ndarray) -> bytes:
    return zlib.compress(once.tobytes() + twice.tobytes(), 1)


def _pair(data: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data), np.uint8).reshape(2, -1)


def _merged(pairs) -> tuple[np.ndarray, np.ndarray]:
    """The once-seen and twice-seen bits of a union: what two parts have both seen once has been seen twice."""
    once = twice = None
    for o, t in pairs:
        once, twice = (o, t) if once is None else (once | o, twice | t | (once & o))
    return once, twice


def _bit(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes that hold these bits, and the bits in them (as np.packbits and np.unpackbits have them)."""
    return (at >> np.uint64(3)).astype(np.int64), np.uint8(128) >> (at & np.uint64(7)).astype(np.uint8)


def _has(filled: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which keys have all their bits in a filter."""
    byte, bit = _bit(at)
    return ((filled[byte] & bit) != 0).all(0)


def _put(filled: np.ndarray, at: np.ndarray) -> None:
    byte, bit = _bit(at)
    np.bitwise_or.at(filled, byte.ravel(), bit.ravel())


def filter_bits(docs: DataFrame, text_col: str, least_chars: int, per_line: int = 8, most: int = 1 << 29) -> int:
    """A power of two of at least per_line bits for each line of least_chars or more, between 2^20 and most.

    One count over all texts. most bounds what a task holds (a quarter of a byte for each bit) and what is broadcast (an eighth):
    64 MB. A corpus with more lines gets that, and more of its keys shuffle; the result stays the same.
    """
    lines = F.regexp_count(quoted(text_col).cast("string"), F.lit(r"[^\n]{%d,}+" % max(1, least_chars)))
    n = docs.agg(F.coalesce(F.sum(lines), F.lit(0)).alias("n")).first()["n"]
    return min(most, max(1 << 20, 1 << max(0, int(n) * per_line - 1).bit_length()))


def repeated_filter(docs: DataFrame, text_col: str, least_chars: int, bits: int, hashes: int) -> np.ndarray:
    """The twice-seen filter over the line keys of all documents, bits // 8 bytes however many lines there are.

    Each task fills a once-seen and a twice-seen filter; their shards are merged in two steps of bounded groups. A key that
    occurs twice anywhere is always in it; others get in by chance, the more the fuller the filter is.
    """
    size = bits // 8
    n_shards = max(1, size // _SHARD)

    def filled(batches):
        from pyspark import TaskContext

        once, twice = np.zeros(size, np.uint8), np.zeros(size, np.uint8)
        for batch in batches:
            for text in texts_of(batch.column(0)):
                keys = [x for x in line_keys(text, least_chars) if x]
                if not keys:
                    continue
                rows = _as_rows(keys)
                own, n = np.unique(rows, axis=0, return_counts=True)
                at = _positions(own, bits, hashes)
                _put(twice, at[:, _has(once, at) | (n > 1)])
                _put(once, at)
        o, t = (x.reshape(n_shards, -1) for x in (once, twice))
        has = np.flatnonzero(o.any(1))
        pid = TaskContext.get().partitionId() % (1 << 18)
        yield pa.RecordBatch.from_arrays([pa.array(has, pa.int32()), pa.array([pid] * len(has), pa.int32()), pa.array([_packed(o[i], t[i]) for i in has], pa.binary())], ["shard", "pid", "data"])

    def merge(parts):
        o, t = _merged(_pair(x) for x in parts)
        return _packed(o, t)

    parts = docs.select(quoted(text_col).cast("string").alias("t")).mapInArrow(filled, "shard int, pid int, data binary")
    out = np.zeros((n_shards, size // n_shards), np.uint8)
    for r in merged_by_steps(parts, merge).toLocalIterator():
        out[r["shard"]] = _pair(bytes(r["data"]))[1]
    return out.reshape(-1)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = 20, least_docs: int = 3, bits: int | None = None, hashes: int = 4, broadcast_up_to: int = 2_000_000) -> DataFrame:
    """docs with the columns line_n, line_dropped (long) and line_kept (the text that stays); `_` is put before clashing names.

    A text is split at newlines (null or empty: one empty line). A line's key is the line without white space at its ends and
    with A-Z in lower case. Keys of at least least_chars code points found in at least least_docs documents lose all their
    lines except in the largest id that holds them. Rows that share an id are one document and treated alike; null ids are one
    document below all others. Other columns stay as they are. An empty table gives an empty one.

    Two Bloom filters of bits bits (a power of two; None: filter_bits') find keys seen twice; only those keys shuffle, as (key, id), to be counted exactly, so
    the result is the same for any size of filter. A key that a third of the documents hold is counted with partial sums.
    Up to broadcast_up_to repeated keys are broadcast as a table (24 bytes a key and the last id), and texts are cut where they
    are read; beyond that (key, id) meet the repeated keys in a join, spread by id, and texts shuffle to meet their keys.
    Bytes that aren't UTF-8 count as U+FFFD.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    if least_docs < 2:
        raise ValueError("least_docs is 2 at least")
    n_col, d_col, k_col, list_col = fresh(docs, "line_n", "line_dropped", "line_kept", "line_keys")
    if bits is None:
        bits = filter_bits(docs, text_col, least_chars)
    twice = spark.sparkContext.broadcast(repeated_filter(docs, text_col, least_chars, bits, hashes))
    id_type = docs.schema[id_col].dataType.simpleString()

    def suspects(batches):
        have = twice.value
        for batch in batches:
            rows, out = [], []
            for i, text in enumerate(texts_of(batch.column(1))):
                if keys := list({x for x in line_keys(text, least_chars) if x}):
                    hit = _has(have, _positions(_as_rows(keys), bits, hashes))
                    out += (found := [x for x, y in zip(keys, hit, strict=True) if y])
                    rows += [i] * len(found)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int32())), pa.array(out, pa.binary())], ["id", "key"])

    found = docs.select(quoted(id_col).alias("id"), quoted(text_col).cast("string").alias("t")).mapInArrow(suspects, f"id {id_type}, key binary")
    found = saved(found.distinct(), "suspects")
    sure = found.groupBy("key").agg(F.count("*").alias("n"), F.max("id").alias("last")).where(F.col("n") >= least_docs)
    sure = saved(sure, "repeated")
    (x,) = fresh(docs, "line_cut")
    out = None
    if sure.count() <= broadcast_up_to:
        table = sure.select("key", "last").toArrow().combine_chunks()
        rows = _as_rows(table["key"].to_pylist()) if len(table) else np.zeros((0, 2), np.uint64)
        order = np.lexsort((rows[:, 1], rows[:, 0]))
        if len(np.unique(rows[:, 0])) == len(rows):  # else, as good as never, two keys have the same half
            last = table["last"].take(pa.array(order)).combine_chunks()
            out = docs.withColumn(x, _cut_by_table(spark.sparkContext.broadcast((rows[order], last)), least_chars)(quoted(id_col), quoted(text_col).cast("string")))
    if out is None:
        drops = spread_join(found, sure, "key", "id").where(~F.col("id").eqNullSafe(F.col("last"))).groupBy(F.col("id").alias("drop_id")).agg(F.collect_list("key").alias(list_col))
        out = docs.join(drops, quoted(id_col).eqNullSafe(F.col("drop_id")), "left").withColumn(x, _cut_by_list(least_chars)(quoted(text_col).cast("string"), F.col(list_col)))
    return out.select(*[quoted(c) for c in docs.columns], F.col(f"{x}.n").alias(n_col), F.col(f"{x}.dropped").alias(d_col), F.col(f"{x}.kept").alias(k_col))


_CUT = "n long, dropped long, kept string"


def _cut_rows(texts: list[str], gone: list):
    """A struct (n, dropped, kept) for each text; gone has for each the places of the lines that go."""
    kept, n, dropped = [], [], []
    for text, away in zip(texts, gone, strict=True):
        n.append(text.count("\n") + 1)
        dropped.append(len(away))
        if len(away):
            away = set(away)
            text = "\n".join(x for i, x in enumerate(text.split("\n")) if i not in away)
        kept.append(text)
    return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(dropped, pa.int64()), pa.array(kept, pa.string())], ["n", "dropped", "kept"])


def _cut_by_table(table, least_chars: int):
    """A function of (id, text) that cuts lines by a broadcast table of all repeated keys, sorted, and the last id of each."""

    @F.arrow_udf(_CUT)
    def cut(ids: pa.Array, texts: pa.Array) -> pa.Array:
        import pyarrow.compute as pc

        keys, last = table.value
        own = texts_of(texts)
        doc, place, found = [], [], []
        for i, text in enumerate(own):
            for j, key in enumerate(line_keys(text, least_chars)):
                if key is not None:
                    doc.append(i), place.append(j), found.append(key)
        gone: list = [[] for _ in own]
        if found and len(keys):
            rows = _as_rows(found)
            at = np.minimum(np.searchsorted(keys[:, 0], rows[:, 0]), len(keys) - 1)
            hit = np.flatnonzero((keys[at] == rows).all(1))
            if len(hit):
                a, b = ids.take(pa.array([doc[i] for i in hit])), last.take(pa.array(at[hit]))
                here = pc.or_(pc.fill_null(pc.equal(a, b), False), pc.and_(pc.is_null(a), pc.is_null(b)))
                for i in hit[~here.to_numpy(zero_copy_only=False)]:
                    gone[doc[i]].append(place[i])
        return _cut_rows(own, gone)

    return cut.asNondeterministic()  # so that a filter on its result doesn't run it a second time


def _cut_by_list(least_chars: int):
    """A function of (text, keys) that cuts the lines with these keys."""

    @F.arrow_udf(_CUT)
    def cut(texts: pa.Array, keys: pa.Array) -> pa.Array:
        own, gone = texts_of(texts), []
        for text, away in zip(own, keys.to_pylist(), strict=True):
            away = set(away or ())
            gone.append([j for j, k in enumerate(line_keys(text, least_chars)) if k is not None and k in away] if away else [])
        return _cut_rows(own, gone)

    return cut.asNondeterministic()


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """dedup_lines of all documents: lines before, lines dropped and the SHA-256 of what stays."""
    out = dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select("doc_id", F.col("line_n").alias("n_lines"), F.col("line_dropped").alias("n_dropped"), F.sha2("line_kept", 256).alias("kept_sha256"))


OP6_SQL = r"""
with d as (select doc_id, string_split(coalesce(text, ''), chr(10)) as ls from documents),
l as (select doc_id, unnest(ls) as line, unnest(range(1, len(ls) + 1)) as pos from d),
k as (select *, translate(trim(line, E' \t\n\x0b\x0c\r'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from l),
r as (select key, max(doc_id) as last from k where length(key) >= 20 group by key having count(distinct doc_id) >= 3),
m as (select k.doc_id, k.pos, k.line, coalesce(k.doc_id <> r.last, false) as gone from k left join r on k.key = r.key)
select doc_id, count(*)::bigint as n_lines, count(*) filter (gone)::bigint as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by pos) filter (not gone), '')) as kept_sha256 from m group by doc_id
"""
