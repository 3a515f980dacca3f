"""Packing documents into windows: length combinations repeated as non-negative least squares says."""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, ordinary_encoder, quoted, saved, texts_of


@lru_cache(maxsize=4)
def encoder(name: str = "byte_bpe_50k"):
    """A function from a list of texts to lists of ids, as tokenizers gives for name.json with add_special_tokens=False.

    Texts go through tiktoken with the same vocabulary as ranks, which gives the same ids several times faster; a text that
    holds a special token's string goes through tokenizers itself.
    """
    import json

    import public_tokenizers

    fast = ordinary_encoder(name)
    with open(public_tokenizers.path(f"{name}.json"), encoding="utf-8") as f:
        marks = [t["content"] for t in json.load(f)["added_tokens"]]

    def encode(texts: list[str]) -> list[list[int]]:
        return [slow_encoder(name).encode(t, add_special_tokens=False).ids if any(m in t for m in marks) else fast(t) for t in texts]

    return encode


@lru_cache(maxsize=4)
def slow_encoder(name: str):
    """tokenizers' own; loaded only where a text needs it, as it takes much memory."""
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(f"{name}.json"))


def token_pieces(docs: DataFrame, id_col: str, text_col: str, window: int, end_id: int, tokenizer: str) -> DataFrame:
    """(doc, doc_tokens, start, length, ids, task, place): each document's ids with end_id, cut at window.

    ids are little-endian uint32. task and place number the pieces of a length: they are written with the pieces, so they stay
    as they are however often a later stage runs. Null text: empty, which leaves end_id alone.
    """
    import pyarrow as pa

    kind = docs.schema[id_col].dataType.simpleString()

    def cut(batches):
        from pyspark import TaskContext

        task, counts, encode = TaskContext.get().partitionId(), np.zeros(window + 1, np.int64), encoder(tokenizer)
        for batch in batches:
            at, size = 0, 0
            texts = texts_of(batch.column(1))
            while at < len(texts):
                end, size = at, 0
                while end < len(texts) and (end == at or size < 1 << 20):
                    size += len(texts[end])
                    end += 1
                which, total, start, length, ids, place = [], [], [], [], [], []
                for i, got in enumerate(encode(texts[at:end]), at):
                    raw = np.array([*got, end_id], "<u4")
                    for s in range(0, len(raw), window):
                        part = raw[s : s + window]
                        which.append(i)
                        total.append(len(raw))
                        start.append(s)
                        length.append(len(part))
                        ids.append(part.tobytes())
                        place.append(int(counts[len(part)]))
                        counts[len(part)] += 1
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(which, pa.int64())), pa.array(total, pa.int64()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(ids, pa.binary()), pa.array([task] * len(which), pa.int64()), pa.array(place, pa.int64())], ["doc", "doc_tokens", "start", "length", "ids", "task", "place"])
                at = end

    return docs.select(quoted(id_col), quoted(text_col).cast("string")).mapInArrow(cut, f"doc {kind}, doc_tokens long, start long, length long, ids binary, task long, place long")


def combinations(lengths: list[int], window: int, depth: int = 3, breadth: int = 96) -> list[tuple[int, ...]]:
    """Combinations of 1 to depth of the lengths that fill a window, or alone a power of two, without padding.

    All of one and two lengths; of three and more, each length with the breadth commonest others (lengths are in order of
    falling count). Each combination is in falling order and occurs once.
    """
    have, common = set(lengths), lengths[:breadth]
    out = {(n,) for n in lengths if n == window or n & (n - 1) == 0}
    ends = {(n,) for n in lengths}
    for k in range(2, depth + 1):
        for head in ends:
            if (rest := window - sum(head)) in have:
                out.add(tuple(sorted((*head, rest), reverse=True)))
        if k < depth:
            ends = {tuple(sorted((*head, n), reverse=True)) for head in ends for n in common if sum(head) + n < window}
    return sorted(out)


def nonnegative_least_squares(combos: list[tuple[int, ...]], counts: np.ndarray, sweeps: int = 30) -> np.ndarray:
    """x >= 0 that brings the lengths used by x[j] repeats of combos[j] near counts, by accelerated projected gradient steps.

    A step moves every column by its share of the residual and cuts it off at 0; its length is divided by how many columns use
    each of the column's lengths, so that it never overshoots, and steps carry momentum from the one before.
    """
    if not combos:
        return np.zeros(0)
    at = np.concatenate([np.array(c) for c in combos])
    col = np.repeat(np.arange(len(combos)), [len(c) for c in combos])
    uses = np.bincount(at, minlength=len(counts)).astype(float)
    # diagonal majoriser of A'A: row sums of |A'A|, so that a step never overshoots
    bound = np.bincount(col, weights=uses[at], minlength=len(combos))
    x = np.zeros(len(combos))
    y, t = x, 1.0
    for _ in range(sweeps * 10):  # accelerated projected steps
        left = counts - np.bincount(at, weights=y[col], minlength=len(counts))
        new = np.maximum(0, y + np.bincount(col, weights=left[at], minlength=len(combos)) / bound)
        s = (1 + (1 + 4 * t * t) ** 0.5) / 2
        x, y, t = new, new + (t - 1) / s * (new - x), s
    return x


def plan_windows(histogram: dict[int, int], window: int, depth: int = 3) -> list[tuple[tuple[int, ...], int]]:
    """(lengths, repeats) that use every piece of the histogram exactly once, each filling at most a window.

    Repeat counts of the enumerated combinations come from non-negative least squares, rounded down and held to what is
    there; first come those, largest first. The residual is packed greedily: the longest piece left, then two that fill
    the rest exactly if there are such, else the longest that still fits, repeated as often as counts allow. Both work on counts, so the cost doesn't grow with the documents.
    """
    left = np.zeros(window + 1, np.int64)
    for n, c in histogram.items():
        left[n] = c
    out = [((window,), int(left[window]))] if left[window] else []
    left[window] = 0
    lengths = sorted((int(n) for n in np.flatnonzero(left)), key=lambda n: (-left[n], n))
    combos = combinations(lengths, window, depth)
    x = np.floor(nonnegative_least_squares(combos, left.astype(float)) + 1e-6).astype(np.int64)
    for j in np.argsort(-x, kind="stable"):
        use = dict.fromkeys(combos[j], 0)
        for n in combos[j]:
            use[n] += 1
        if (r := int(min(x[j], *(left[n] // k for n, k in use.items())))) > 0:
            out.append((combos[j], r))
            for n, k in use.items():
                left[n] -= r * k
    while left.any():
        room, pick = window, []
        free = left.copy()
        while (fit := np.flatnonzero(free[: room + 1])).size:
            n = int(fit[-1])
            if pick and n != room:
                two = np.minimum(free[:room], free[room:0:-1])  # lengths a with a partner room - a
                if not room % 2 and free[room // 2] < 2:
                    two[room // 2] = 0
                if two.any():
                    n = int(np.flatnonzero(two)[-1])
            k = 1 if pick else int(min(free[n], room // n))
            pick += [n] * k
            free[n] -= k
            room -= n * k
        use = {n: pick.count(n) for n in pick}
        r = int(min(left[n] // k for n, k in use.items()))
        out.append((tuple(pick), r))
        for n, k in use.items():
            left[n] -= r * k
    return out


def _slots(plan: list[tuple[tuple[int, ...], int]]) -> dict[int, np.ndarray]:
    """For each length, rows (first rank, first sequence, offset): the rank-th piece of that length goes to sequence first + rank - first rank."""
    rows: dict[int, list] = {}
    used: dict[int, int] = {}
    first = 0
    for lengths, repeats in plan:
        offset = 0
        for n in lengths:
            rows.setdefault(n, []).append((used.get(n, 0), first, offset))
            used[n] = used.get(n, 0) + repeats
            offset += n
        first += repeats
    return {n: np.array(r, np.int64) for n, r in rows.items()}


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 1024, end_id: int = 0, tokenizer: str = "byte_bpe_50k", depth: int = 3, most_tasks: int = 16_384) -> DataFrame:
    """(doc, start, length, ids, doc_tokens, sequence_id, offset): the pieces of all documents and where each goes.

    A document is its ids and end_id (null text: end_id alone), cut at window; every id is in one piece. Sequences hold window
    ids at most and have no gap before their padding. Rows are documents of their own, also where ids repeat or are null.
    Bytes that aren't UTF-8 count as U+FFFD. Pieces are written to the shared folder. Only counts go to the driver, and the plan
    made from them. A piece's rank within its length is how many the tasks before its own have made, and its place among its
    own task's, so no length gathers in one task however common it is. For up to most_tasks tasks the former are broadcast,
    compressed, as a row of window numbers a task, and pieces don't shuffle; beyond that they are joined on task and length. An
    empty table gives no pieces.
    """
    import pyarrow as pa

    spark = docs.sparkSession
    bounded_batches(spark)
    pieces = saved(token_pieces(docs, id_col, text_col, window, end_id, tokenizer), "pieces")
    per_task = saved(pieces.groupBy("length", "task").agg(F.count("*").alias("n")), "lengths")
    counts = {r["length"]: r["n"] for r in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots = spark.sparkContext.broadcast(_slots(plan_windows(counts, window, depth)))
    kind = pieces.schema["doc"].dataType.simpleString()
    columns = ["doc", "start", "length", "ids", "doc_tokens"]

    def place(length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        seq, off = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
        for n in np.unique(length):
            at = np.flatnonzero(length == n)
            t = slots.value[int(n)]
            i = np.searchsorted(t[:, 0], rank[at], "right") - 1
            seq[at], off[at] = t[i, 1] + rank[at] - t[i, 0], t[i, 2]
        return seq, off

    def placed(batches):
        for batch in batches:
            length, at, task = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "place", "task"))
            base = batch.column("base").to_numpy(zero_copy_only=False) if bases is None else np.zeros(len(task), np.int64)
            if bases is not None:
                for t in np.unique(task):
                    mine = np.flatnonzero(task == t)
                    base[mine] = np.frombuffer(zlib.decompress(bases.value[int(t)]), "<i8")[length[mine]]
            seq, off = place(length, base + at)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(seq), pa.array(off)], [*columns, "sequence_id", "offset"])

    if per_task.select("task").distinct().count() <= most_tasks:

        def row(key, pdf):
            import pandas as pd

            n = np.zeros(window + 1, "<u4")
            n[pdf["length"]] = pdf["n"]
            return pd.DataFrame({"task": [key[0]], "data": [zlib.compress(n.tobytes(), 1)]})

        got = sorted((r["task"], bytes(r["data"])) for r in per_task.groupBy("task").applyInPandas(row, "task long, data binary").toLocalIterator())
        before, table = np.zeros(window + 1, "<i8"), {}
        for t, data in got:
            table[t] = zlib.compress(before.tobytes(), 1)
            before += np.frombuffer(zlib.decompress(data), "<u4")
        bases = spark.sparkContext.broadcast(table)
        ranked = pieces.select(*columns, "task", "place")
    else:

        def sums(key, pdf):
            import pandas as pd

            pdf = pdf.sort_values("task")
            return pd.DataFrame({"length": pdf["length"], "task": pdf["task"], "base": pdf["n"].cumsum() - pdf["n"]})

        bases = None
        ranked = pieces.join(per_task.groupBy("length").applyInPandas(sums, "length long, task long, base long"), ["length", "task"]).select(*columns, "task", "place", "base")
    return ranked.mapInArrow(placed, f"doc {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pack of all documents into windows of 1,024 tokens; the ids are given by their CRC-32. Null text is the end token alone."""
    out = pack(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select(F.col("doc").alias("doc_id"), "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
