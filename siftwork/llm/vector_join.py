"""Exact range join of embeddings by cosine: pivots, boundary replication by the triangle inequality, cells joined on their own."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import quoted, saved, spread_join
from .graph import connected_components


def unit_vector(v) -> bytes | None:
    """The float64 unit vector as bytes; None if v is null, empty, zero, or has a null or non-finite component."""
    if v is None or not len(v) or any(x is None for x in v):
        return None
    a = np.asarray(v, np.float64)
    if not np.isfinite(a).all() or not (top := np.abs(a).max()):
        return None
    a = a / top  # so that neither very large nor very small components overflow
    return (a / np.sqrt(a @ a) + 0.0).tobytes()


def linked(a: np.ndarray, b: np.ndarray, least: float) -> np.ndarray:
    """The matrix of a's links to b, decided in double precision: single precision only settles what lies further from least than its error."""
    slack = a.shape[1] * 1.3e-7 + 1e-6
    s = a.astype(np.float32) @ b.astype(np.float32).T
    m = s >= least - slack  # all that may be linked: in most places nothing is
    at = np.flatnonzero(m)
    at = at[s.ravel()[at] < least + slack]
    for k in range(0, len(at), 65536):
        x, y = np.divmod(at[k : k + 65536], len(b))
        m[x, y] = np.einsum("ij,ij->i", a[x], b[y]) >= least
    return m


def join_block(a: np.ndarray, b: np.ndarray, a_at: np.ndarray, b_at: np.ndarray, weights: np.ndarray, least: float, same: bool, strip: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """(links, label) of each node: how much weight it links to, and the least node reachable by links.

    a and b are the sides' unit vectors, a_at and b_at their nodes, which number weights. Links are found a strip of rows at a
    time and kept as bits of the rows and columns that have any. Labels fall until nothing changes; a node whose label falls
    takes its old label's node along, so long chains settle in few rounds. Pairs aren't listed.
    """
    n = len(weights)
    links, lab, strips = np.zeros(n, np.int64), np.arange(n), []
    for at in range(0, len(a), strip):
        m = linked(a[at : at + strip], b, least)
        if same:
            m[np.arange(len(m)), at + np.arange(len(m))] = False
        rows, cols = np.flatnonzero(m.any(1)), np.flatnonzero(m.any(0))
        if not len(rows):
            continue
        m = m[np.ix_(rows, cols)]
        i, j = a_at[at + rows], b_at[cols]
        links[i] += np.where(m, weights[j], 0).sum(1)
        if not same:
            links[j] += np.where(m, weights[i][:, None], 0).sum(0)
        strips.append((i, j, np.packbits(m, axis=1)))

    def lower(at, low):
        old = lab[at]
        low = np.minimum(low, old)
        np.minimum.at(lab, old, low)
        lab[at] = np.minimum(lab[at], low)

    while strips:
        before = lab.copy()
        for i, j, bits in strips:
            m = np.unpackbits(bits, axis=1, count=len(j)).view(bool)
            lower(j, np.where(m, lab[i][:, None], n).min(0))
            lower(i, np.where(m, lab[j], n).min(1))
        lab = lab[lab[lab]]
        if (lab == before).all():
            break
    return links, lab


def range_join(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", least: float = 0.9, cell: int = 8192, max_pivots: int = 2048, block: int = 8192) -> DataFrame:
    """(id, n_links, component_id, kept) for each row: other rows linked with it, and the least id reachable by links.

    Rows link if the cosine of their vectors is least at least (0 < least <= 1). Vectors that unit_vector rejects link with
    nothing, nor do vectors of different lengths. Rows that share an id are rows of their own; null ids never become a
    component's id unless all its ids are null. Other columns aren't read. An empty table gives none.

    Equal vectors are one, with a count, so that copies aren't expanded. On unit vectors the chord is a metric: each vector
    lives in the cell of its nearest pivot and is also sent to a cell of lower number if its partners there can't be excluded:
    neither by the distance to the bisector of both pivots nor by the cell's radius. All distances are taken at the end of
    their rounding error that excludes less, so no pair is lost, however near the vectors or the pivots are. A pair meets in one
    cell exactly. A cell of more than block vectors is joined in tiles of block rows a side, so no task gets more, however
    common a vector is. Vectors travel in the column's own precision and are made unit vectors where they are compared.
    On data without structure the bounds exclude little and the work is that of comparing all with all, in tiles.
    Pivots number max_pivots at most: they and two numbers a cell are all that the driver sees.
    """
    import pandas as pd
    import pyarrow as pa
    from pyspark.sql.types import ArrayType, FloatType

    spark = vectors.sparkSession
    kind = vectors.schema[id_col].dataType.simpleString()
    v_type = vectors.schema[vector_col].dataType
    item = np.dtype(np.float32 if isinstance(v_type, ArrayType) and isinstance(v_type.elementType, FloatType) else np.float64)

    def units(batches):
        for batch in batches:
            vs = batch.column(1).to_pylist()
            us = [unit_vector(v) for v in vs]
            raw = [None if u is None else np.asarray(v, item).tobytes() for u, v in zip(us, vs, strict=True)]
            keys = [None if u is None else hashlib.md5(u).digest() for u in us]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary()), pa.array(raw, pa.binary())], ["id", "key", "raw"])

    rows = saved(vectors.select(quoted(id_col), quoted(vector_col)).mapInArrow(units, f"id {kind}, key binary, raw binary"), "units")
    own = saved(rows.where("key is not null").groupBy("key").agg(F.min("raw").alias("raw"), F.count("*").alias("n"), F.min("id").alias("least_id")), "vectors")

    def as_units(raws: list[bytes]) -> np.ndarray:
        x = np.frombuffer(b"".join(raws), item).reshape(len(raws), -1).astype(np.float64)
        x /= np.abs(x).max(1)[:, None]
        return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]

    total = own.count()
    wanted = int(min(max_pivots, max(1, -(-total // cell))))
    pivots: dict[int, np.ndarray] = {}
    for r in own.orderBy(F.xxhash64("key"), "key").limit(wanted).select("raw").collect():
        v = as_units([bytes(r["raw"])])
        pivots[v.shape[1]] = np.vstack([pivots.get(v.shape[1], np.zeros((0, v.shape[1]))), v])
    shared = spark.sparkContext.broadcast(pivots)

    def chord(s, d: int, side: int):
        """The distance of unit vectors with product s, at the upper (1) or lower (-1) end of its error."""
        return np.sqrt(np.maximum(0.0, 2 - 2 * s + side * (4 * d + 16) * 2.3e-16)) * (1 + side * 1e-15)

    def dots(raws: list[bytes]):
        """(length, places, products with the pivots, pivots) for each length of vector."""
        by: dict[int, list[int]] = {}
        for i, u in enumerate(raws):
            by.setdefault(len(u) // item.itemsize, []).append(i)
        for d, at in by.items():
            p = shared.value.get(d)
            p = np.eye(1, d) if p is None else p
            yield d, np.array(at), as_units([raws[i] for i in at]) @ p.T, p

    def homes(batches):
        for batch in batches:
            raws = batch.column("raw").to_pylist()
            dim, home, dot = np.zeros(len(raws), np.int32), np.zeros(len(raws), np.int32), np.zeros(len(raws))
            for d, at, s, _ in dots(raws):
                dim[at], home[at], dot[at] = d, s.argmax(1), s.max(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(dim), pa.array(home), pa.array(dot)], ["key", "raw", "n", "dim", "home", "dot"])

    # homes are written: products can differ in their last bit from one batch to another, and a vector has one home
    homed = saved(own.select("key", "raw", "n").mapInArrow(homes, "key binary, raw binary, n long, dim int, home int, dot double"), "homes")
    cells = {(r["dim"], r["home"]): (r["n"], r["dot"]) for r in homed.groupBy("dim", "home").agg(F.count("*").alias("n"), F.min("dot").alias("dot")).collect()}

    def guests(d: int, s: np.ndarray, p: np.ndarray, home: np.ndarray) -> np.ndarray:
        """Which cells below its own each row must visit."""
        reach = chord(least, d, 1)
        radius = np.array([chord(cells[d, q][1], d, 1) if (d, q) in cells else -9.0 for q in range(len(p))])
        near = s[np.arange(len(s)), home][:, None] - s <= (reach * chord(p @ p.T, d, 1))[home] + (4 * d + 16) * 2.3e-16  # the bisector
        near &= chord(s, d, -1) <= radius[None, :] + reach  # the cell's ball
        return near & (np.arange(len(p))[None, :] < home[:, None])

    def visits(batches):
        for batch in batches:
            home = batch.column("home").to_numpy()
            for d, at, s, p in dots(batch.column("raw").to_pylist()):
                n = guests(d, s, p, home[at]).sum(0)
                q = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(q), d, np.int32)), pa.array(q.astype(np.int32)), pa.array(n[q].astype(np.int64))], ["dim", "cell", "n"])

    visitors = {(r["dim"], r["cell"]): r["n"] for r in homed.select("raw", "home").mapInArrow(visits, "dim int, cell int, n long").groupBy("dim", "cell").agg(F.sum("n").alias("n")).collect()}
    blocks = {c: -(-n // block) for c, (n, _) in cells.items()}
    guest_blocks = {c: -(-n // block) for c, n in visitors.items()}

    def dealt(batches):
        """A row for each tile that a vector takes part in: side 0 is the tile's left, 1 its right; in a tile of equal sides there is one row."""
        for batch in batches:
            home = batch.column("home").to_numpy()
            z = np.array([int.from_bytes(k[:7], "little") for k in batch.column("key").to_pylist()], np.int64)
            for d, at, s, p in dots(batch.column("raw").to_pylist()):
                nb, gb = (np.array([b.get((d, q), 0) for q in range(len(p))], np.int64) for b in (blocks, guest_blocks))
                i, q = np.nonzero(guests(d, s, p, home[at]))
                # each vector at home, then its visits; a row of copies has a number t in each
                who = np.concatenate([np.arange(len(at)), i])
                where = np.concatenate([home[at], q])
                guest = np.arange(len(who)) >= len(at)
                copies = np.where(guest, nb[where], nb[where] + gb[where])
                ends = np.cumsum(copies)
                lo = 0
                while lo < len(who):
                    hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + 32768, "right")))
                    k = np.repeat(np.arange(lo, hi), copies[lo:hi])
                    t = np.arange(len(k)) - np.repeat(ends[lo:hi] - copies[lo:hi] - (ends[lo - 1] if lo else 0), copies[lo:hi])
                    c, row, g = where[k], at[who[k]], guest[k]
                    b = z[row] % nb[c]
                    left = np.where(g, t, np.where(t < nb[c], np.minimum(b, t), b))
                    right = np.where(g, nb[c] + z[row] % np.maximum(gb[c], 1), np.where(t < nb[c], np.maximum(b, t), t))
                    cols = [np.full(len(k), d), c, left, right, g | (t < b)]
                    yield pa.RecordBatch.from_arrays([*(pa.array(x.astype(np.int32)) for x in cols), *(batch.column(x).take(pa.array(row)) for x in ("key", "raw", "n"))], ["dim", "cell", "i", "k", "side", "key", "raw", "n"])
                    lo = hi

    def join_tile(pdf: pd.DataFrame) -> pd.DataFrame:
        same = int(pdf["i"].iloc[0]) == int(pdf["k"].iloc[0])
        pdf = pdf.sort_values("key", ignore_index=True)  # a key is in a tile once: nodes are places in the order of keys
        vectors, side = as_units(list(pdf["raw"])), pdf["side"].to_numpy()
        at = [np.arange(len(pdf))] * 2 if same else [np.flatnonzero(side == x) for x in (0, 1)]
        links, lab = join_block(vectors[at[0]], vectors[at[1]], *at, pdf["n"].to_numpy(np.int64), least, same)
        return pd.DataFrame({"key": pdf["key"], "links": links, "root": pdf["key"].to_numpy()[lab]})[links > 0]

    tiles = homed.select("key", "raw", "n", "home").mapInArrow(dealt, "dim int, cell int, i int, k int, side int, key binary, raw binary, n long")
    found = saved(tiles.groupBy("dim", "cell", "i", "k").applyInPandas(join_tile, "key binary, links long, root binary"), "links")
    links = found.groupBy("key").agg(F.sum("links").alias("links"))
    comps = connected_components(found, "key", "root")
    whole = own.select("key", "n", "least_id").join(links, "key", "left").join(comps.withColumnRenamed("node", "key"), "key", "left").withColumn("component", F.coalesce("component", "key"))
    whole = saved(whole, "groups")
    least_ids = whole.groupBy("component").agg(F.min("least_id").alias("component_id"))
    info = spread_join(whole, least_ids, "component", "key").select("key", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).cast("long").alias("n_links"), "component_id")
    out = spread_join(rows.select("id", "key"), info, "key", "id", "left")
    cid = F.when(F.col("key").isNull(), F.col("id")).otherwise(F.col("component_id"))
    out = out.select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), cid.alias("component_id"))
    return out.withColumn("kept", F.col("id").eqNullSafe(F.col("component_id")))


def op4_vector_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """range_join of all embeddings at a cosine of 0.9; vectors that are null, zero or not finite link with nothing."""
    out = range_join(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
    return out.select(F.col("id").alias("vec_id"), "n_links", "component_id", "kept")


OP4_SQL = """
with recursive v as (select vec_id, embedding::double[] as e from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and list_dot_product(embedding::double[], embedding::double[]) > 0),
l as (select a.vec_id as a, b.vec_id as b from v a join v b on a.vec_id <> b.vec_id and list_cosine_similarity(a.e, b.e) >= 0.9),
r as (select vec_id as node, vec_id as seen from embeddings union select r.node, l.b from r join l on r.seen = l.a),
c as (select node, min(seen) as component_id from r group by node),
n as (select a, count(*) as n_links from l group by a)
select c.node as vec_id, coalesce(n.n_links, 0)::bigint as n_links, c.component_id, c.node = c.component_id as kept from c left join n on n.a = c.node
"""
