"""Near-duplicate texts: improved consistent weighted sampling over TF-IDF shingles, banded, verified by weighted Jaccard similarity."""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, distinct, fresh, merged_by_steps, mix, ngram_hashes, quoted, saved, spread_join, text_bytes, word_hashes
from .graph import connected_components

_IDF_BITS = 20
_SHARDS = 32
#: A document in the counters, so that each of up to 2^30 equal ones can be a part of it.
_ONE = 1 << 30
_PLAIN_BANDS, _PARTS = 20, 120
#: For each part of the hash range, the parts in the order in which it takes their minimum: itself, then the others.
_BORROW = np.array([[i, *np.random.default_rng(i).permutation(np.delete(np.arange(_PARTS), i))] for i in range(_PARTS)])


def plain_bands(own: np.ndarray) -> np.ndarray:
    """20 hashes of 6 minima each over a text's sorted distinct shingles, unweighted: one for each 120th of the hash range; an empty part borrows from another."""
    parts, first = np.unique(((own >> np.uint64(32)) * np.uint64(_PARTS)) >> np.uint64(32), return_index=True)
    low, has = np.zeros(_PARTS, np.uint64), np.zeros(_PARTS, bool)
    low[parts.astype(np.int64)], has[parts.astype(np.int64)] = own[first], True
    gaps = np.flatnonzero(~has)
    low[gaps] = low[_BORROW[gaps, has[_BORROW[gaps]].argmax(1)]]
    low = low.reshape(_PLAIN_BANDS, -1)
    h = mix(np.arange(1, _PLAIN_BANDS + 1, dtype=np.uint64))
    for j in range(low.shape[1]):
        h = mix(h ^ low[:, j])
    return h.view(np.int64)


def _counter_columns(counters: np.ndarray, n: int) -> list:
    """(shard, pid, data) of a task's counters and, as the last shard, its n."""
    import pyarrow as pa
    from pyspark import TaskContext

    pid = TaskContext.get().partitionId() % (1 << 18)
    data = [*(zlib.compress(x.tobytes(), 1) for x in counters.reshape(_SHARDS, -1)), zlib.compress(np.array([n], "<i8").tobytes())]
    return [pa.array(range(_SHARDS + 1), pa.int32()), pa.array([pid] * (_SHARDS + 1), pa.int32()), pa.array(data, pa.binary())]


def _summed_counters(parts: DataFrame) -> tuple[np.ndarray, int]:
    """The sums of the tasks' counters, added up in steps of bounded groups, and of n."""

    def added(parts):
        return zlib.compress(sum(np.frombuffer(zlib.decompress(x), "<i8") for x in parts).tobytes(), 1)

    out, n = np.zeros((_SHARDS, (1 << _IDF_BITS) // _SHARDS), np.int64), 0
    for r in merged_by_steps(parts, added).toLocalIterator():
        got = np.frombuffer(zlib.decompress(bytes(r["data"])), "<i8")
        if r["shard"] == _SHARDS:
            n = int(got[0])
        else:
            out[r["shard"]] = got
    return out.reshape(-1), n


def hot_buckets(keyed: DataFrame, shingle: int) -> dict[int, tuple[bytes, int]]:
    """The plain bands that more than one in 2,000 texts (key, t) share, 2,000 for each of 20 bands at most: the least key among those texts, and its rows.

    Bands are first counted in 2^20 hashed counters, where chance gives a counter N / 50,000; only bands of counters that
    have as many are shuffled, to be counted exactly.
    """
    import pyarrow as pa

    def banded(batches):
        counters, n = np.zeros(1 << _IDF_BITS, "<i8"), 0
        for batch in batches:
            own = [distinct(ngram_hashes(word_hashes(t)[0], shingle)) for t in text_bytes(batch.column(1))]
            bands = [plain_bands(x) if len(x) else None for x in own]
            if some := [x for x in bands if x is not None]:
                np.add.at(counters, np.concatenate(some).view(np.uint64) >> np.uint64(64 - _IDF_BITS), 1)
                n += len(some)
            blank = [pa.nulls(len(bands), t) for t in (pa.int32(), pa.int32(), pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bands, pa.list_(pa.int64())), *blank], names)
        yield pa.RecordBatch.from_arrays([pa.nulls(_SHARDS + 1, pa.binary()), pa.nulls(_SHARDS + 1, pa.list_(pa.int64())), *_counter_columns(counters, n)], names)

    names = ["key", "bands", "shard", "pid", "data"]
    rows = saved(keyed.mapInArrow(banded, "key binary, bands array<long>, shard int, pid int, data binary"), "plain")
    counters, n = _summed_counters(rows.where("shard is not null").select("shard", "pid", "data"))
    most = max(1, n / 2000)
    often = keyed.sparkSession.sparkContext.broadcast(np.packbits(counters > most))

    def frequent(batches):
        bits = np.unpackbits(often.value).view(bool)
        for batch in batches:
            b = batch.column(1).flatten().to_numpy()
            hit = bits[b.view(np.uint64) >> np.uint64(64 - _IDF_BITS)]
            row = np.repeat(np.arange(batch.num_rows), _PLAIN_BANDS)[hit]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(b[hit])], ["key", "b"])

    each = rows.where("bands is not null").select("key", "bands").mapInArrow(frequent, "key binary, b long")
    each = saved(each.groupBy("b", "key").count(), "frequent")
    hot = each.groupBy("b").agg(F.sum("count").alias("n"), F.min(F.struct("key", "count")).alias("x")).where(F.col("n") > most)
    return {r["b"]: (bytes(r["x"]["key"]), r["x"]["count"]) for r in hot.toLocalIterator()}


def shingle_idf(docs: DataFrame, text_col: str, shingle: int) -> np.ndarray:
    """The inverse document frequency of each of 2^20 hashed shingles, from all documents: ln(1 + N / df), df at least N / 500 and 1.

    Copies count as one document, or a large group's copies would make what they share weigh little and each edit much: a text
    that shares a hot bucket with a lesser text isn't counted, and equal texts share one count. Smaller groups are below the
    floor in any case. What many texts share that are otherwise unlike stays counted. Texts without words don't count.

    A counter has the texts with a shingle in it. Shingles that few texts have share counters, N / 2,000 texts for a counter
    at 500 shingles a text; as that is below the floor at any size of corpus, they all weigh the same, and those that many
    texts have stand out. Each task sends its counters in compressed shards, which are summed in steps of bounded groups.
    """
    import pyarrow as pa

    keyed = docs.select(F.unhex(F.md5(F.coalesce(quoted(text_col).cast("string"), F.lit("")))).alias("key"), quoted(text_col).cast("string").alias("t"))
    hot = docs.sparkSession.sparkContext.broadcast(hot_buckets(keyed, shingle))

    def counted(batches):
        df, n = np.zeros(1 << _IDF_BITS, "<i8"), 0
        for batch in batches:
            for key, t in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1)), strict=True):
                own = distinct(ngram_hashes(word_hashes(t)[0], shingle))
                met = [hot.value[b] for b in plain_bands(own).tolist() if b in hot.value] if len(own) and hot.value else []
                if not len(own) or any(least != key for least, _ in met):
                    continue
                part = _ONE // met[0][1] if met else _ONE
                df[distinct(own >> np.uint64(64 - _IDF_BITS)).astype(np.int64)] += part
                n += part
        yield pa.RecordBatch.from_arrays(_counter_columns(df, n), ["shard", "pid", "data"])

    df, n = _summed_counters(keyed.mapInArrow(counted, "shard int, pid int, data binary"))
    df, n = df / _ONE, n / _ONE
    return np.log1p(max(n, 1) / np.maximum(df, max(n / 500, 1))).astype(np.float32)


def weighted_shingles(text: bytes, idf: np.ndarray, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(sorted 64-bit hashes, weights) of a whole text's windows of n words; a shorter text with words is one window.

    A weight is the window's count in the text times its inverse document frequency.
    """
    own, times = np.unique(ngram_hashes(word_hashes(text)[0], n), return_counts=True)
    return own, times.astype(np.float32) * idf[(own >> np.uint64(64 - _IDF_BITS)).astype(np.int64)]


class ConsistentSampler:
    """Improved consistent weighted sampling: k samples (element, level) that two weighted sets share with their weighted Jaccard similarity as probability.

    For each element and sample r and c are Gamma(2, 1) and b uniform, all from a hash of both, by tables of quantiles; the
    level is floor(ln w / r + b) and the element with the least c / (y e^r), y = e^(r (level - b)), is taken.
    """

    def __init__(self, k: int, seed: int = 11):
        x = np.linspace(0, 40, 400_001)[1:]
        gamma = np.interp((np.arange(65536) + 0.5) / 65536, 1 - (1 + x) * np.exp(-x), x)
        self.r, self.log_c = gamma.astype(np.float32), np.log(gamma).astype(np.float32)
        self.k, self.seeds = k, np.random.default_rng(seed).integers(0, 1 << 63, k, dtype=np.uint64)

    def sample(self, elements: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """k hashes of (element, level); ties go to the least element, as elements are sorted."""
        best, own, level = np.full(self.k, np.inf, np.float32), np.zeros(self.k, np.uint64), np.zeros(self.k, np.float32)
        cols, logs = np.arange(self.k), np.log(weights.astype(np.float64)).astype(np.float32)
        for at in range(0, len(elements), 1024):
            e = elements[at : at + 1024]
            x = e[:, None] ^ self.seeds
            x *= np.uint64(0xD6E8FEB86659FD93)
            x ^= x >> np.uint64(32)
            x *= np.uint64(0xD6E8FEB86659FD93)
            u = x.view("<u2").reshape(len(e), self.k, 4)
            r, b = self.r.take(u[:, :, 3]), u[:, :, 1] * np.float32(1 / 65536)
            t = logs[at : at + 1024, None] / r
            t += b
            np.floor(t, out=t)
            a = t - b
            a += 1
            a *= r
            np.subtract(self.log_c.take(u[:, :, 2]), a, out=a)
            i = a.argmin(0)
            low = a[i, cols]
            less = low < best
            best[less], own[less], level[less] = low[less], e[i[less]], t[i, cols][less]
        return mix(own ^ mix(level.astype(np.int64).astype(np.uint64)))


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity; 0 without shingles."""
    if not len(a[0]) or not len(b[0]):
        return 0.0
    at = np.minimum(np.searchsorted(b[0], a[0]), len(b[0]) - 1)
    hit = b[0][at] == a[0]
    common = float(np.minimum(a[1][hit], b[1][at[hit]]).sum(dtype=np.float64))
    return common / (float(a[1].sum(dtype=np.float64)) + float(b[1].sum(dtype=np.float64)) - common)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.8, shingle: int = 5, bands: int = 22, rows: int = 5, list_up_to: int = 24) -> tuple[DataFrame, DataFrame]:
    """(members, classes): members has (id, key) of each row, key identifying its text; classes (key, class_key) of the texts that are alike with another.

    Two texts link if the weighted Jaccard similarity of their TF-IDF shingles is least at least and they agree in a band of
    rows samples (at 0.8 all of 22 bands of 5 miss a pair once in 6,200, at 0.9 once in 300 million; sets of more than two usually link another way).
    A class is a component of links. Equal texts share a key and are compared as one. Texts without words, null among them,
    have a null key: they are alike with nothing. Other columns aren't read. An empty table gives empty ones.

    Each text is first held against the least text among all its buckets, and classes are formed. Then only pairs of one bucket
    in different classes matter: those of buckets of list_up_to texts at most are listed, each once; larger buckets are worked
    on in tiles of bounded size, within which pairs are compared in memory and only links leave. So no link found by the bands
    is lost, and no pairs of a large group are listed. Before texts are compared, two texts must agree in as many samples as
    six and a half standard deviations below the mean (linked ones fail that once in 10^9). A text that many documents hold is one.
    """
    import pandas as pd
    import pyarrow as pa

    spark = docs.sparkSession
    bounded_batches(spark)
    idf = spark.sparkContext.broadcast(shingle_idf(docs, text_col, shingle))
    k = bands * rows
    kind = docs.schema[id_col].dataType.simpleString()

    def sketched(batches):
        sampler = ConsistentSampler(k)
        salt = mix(np.arange(1, bands + 1, dtype=np.uint64))
        for batch in batches:
            sizes, band, slot = [], [], []
            for t in text_bytes(batch.column(2)):
                own, w = weighted_shingles(t, idf.value, shingle)
                if not len(own):
                    sizes.append(None), band.append(None), slot.append(None)
                    continue
                s = sampler.sample(own, w)
                g = s.reshape(bands, rows)
                h = salt.copy()
                for j in range(rows):
                    h = mix(h ^ g[:, j])
                sizes.append(float(w.sum(dtype=np.float64))), band.append(h.view(np.int64)), slot.append((s >> np.uint64(48)).astype("<u2").tobytes())
            keys = [x if n is not None else None for x, n in zip(batch.column(1).to_pylist(), sizes, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary()), pa.array(sizes, pa.float64()), pa.array(band, pa.list_(pa.int64())), pa.array(slot, pa.binary())], ["id", "key", "size", "bands", "slots"])

    texts = docs.select(quoted(id_col).alias("id"), F.unhex(F.md5(F.coalesce(quoted(text_col).cast("string"), F.lit("")))).alias("key"), quoted(text_col).cast("string").alias("t"))
    all_rows = saved(texts.mapInArrow(sketched, f"id {kind}, key binary, size double, bands array<long>, slots binary"), "sketches")
    own = all_rows.where("key is not null").groupBy("key").agg(F.first("size").alias("size"), F.first("bands").alias("bands"), F.first("slots").alias("slots"))
    own = saved(own, "texts")
    each = own.select("key", F.explode("bands").alias("b"))
    several = each.groupBy("b").agg(F.count("*").alias("n"), F.min("key").alias("low")).where("n > 1").drop("n")
    members = saved(spread_join(each, several, "b", "key", salts=1), "buckets")
    facts = saved(own.select("key", "size", "slots").join(members.select("key").distinct(), "key", "left_semi"), "facts")
    least_agree = int(least * k - 6.5 * (k * least * (1 - least)) ** 0.5)

    def agree(pairs: DataFrame) -> DataFrame:
        """Pairs (a, b) that may be linked by their sizes and samples; each once."""
        def kept(batches):
            for batch in batches:
                x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u2").reshape(-1, k) for c in ("a_slots", "b_slots"))
                yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array((x == y).sum(1) >= least_agree))

        once = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        met = once.join(facts.select(F.col("key").alias("a"), F.col("size").alias("a_size"), F.col("slots").alias("a_slots")), "a").join(facts.select(F.col("key").alias("b"), F.col("size").alias("b_size"), F.col("slots").alias("b_slots")), "b")
        fits = met.where(F.least("a_size", "b_size") >= (least - 1e-6) * F.greatest("a_size", "b_size")).select("a", "a_slots", "b", "b_slots")
        return fits.mapInArrow(kept, "a binary, b binary")

    # one text for each key that shares a bucket, so that the documents are read for them once. The keys filter them as a set
    # of known size or, beyond that, by a shuffle
    keys = facts.select("key")
    met = texts.select("key", "t").join(F.broadcast(keys) if keys.count() <= 500_000 else keys, "key", "left_semi")
    fetched = saved(met.dropDuplicates(["key"]), "fetched")

    def verified(pairs: DataFrame) -> DataFrame:
        """The pairs whose texts are alike. Pairs are dealt to tiles by both keys, so that a text in many pairs travels to few."""
        pairs = saved(pairs, "pairs")
        n = pairs.count()
        h = int(np.ceil(max(n / 1000, min(n / 20, 256)) ** 0.5)) or 1
        tile = (F.pmod(F.xxhash64("a"), F.lit(h)) * h + F.pmod(F.xxhash64("b"), F.lit(h))).cast("int").alias("tile")
        dealt = pairs.select("a", "b", tile)
        need = dealt.select("tile", F.col("a").alias("key")).unionByName(dealt.select("tile", F.col("b").alias("key"))).distinct()
        sent = saved(need.join(fetched, "key"), "sent")  # saved: its columns are then its own

        def alike(pdf, sent):
            t = dict(zip(sent["key"], sent["t"], strict=True))
            own: dict = {}

            def vector(key):
                if key not in own:
                    own[key] = weighted_shingles((t[key] or "").encode(), idf.value, shingle)
                return own[key]

            yes = [similarity(vector(x), vector(y)) >= least - 1e-6 for x, y in zip(pdf["a"], pdf["b"], strict=True)]
            return pdf[["a", "b"]][np.array(yes, bool)]

        return saved(dealt.groupBy("tile").cogroup(sent.groupBy("tile")).applyInPandas(alike, "a binary, b binary"), "links")

    def tiled(members: DataFrame, side: int = 512) -> DataFrame:
        """Links between members (b, key, c, top, n, n_small) of large buckets in different classes.

        Those outside a bucket's largest class are held against all of it, in tiles of side rows a side, each with its texts;
        a pair is held in its first common band only, and only links leave a tile. No task gets more, however large a bucket is.
        """
        whole = members.join(fetched, "key").join(own.select("key", "size", "bands", "slots"), "key")
        deal = F.pmod(F.xxhash64(F.lit(5), "key"), F.lit(1 << 30))
        nb, ns = F.ceil(F.col("n") / side).cast("int"), F.ceil(F.col("n_small") / side).cast("int")
        cols = ["b", "key", "c", "small", "size", "bands", "slots", "t"]
        whole = whole.withColumn("small", F.col("c") != F.col("top"))
        left = whole.where("small").select(*cols, F.lit(0).alias("side"), (deal % ns).cast("int").alias("i"), F.explode(F.sequence(F.lit(0), nb - 1)).alias("j"))
        right = whole.select(*cols, F.lit(1).alias("side"), F.explode(F.sequence(F.lit(0), ns - 1)).alias("i"), (deal % nb).cast("int").alias("j")).select(*left.columns)

        def held(pdf):
            l, r = pdf[pdf["side"] == 0].reset_index(drop=True), pdf[pdf["side"] == 1].reset_index(drop=True)
            out: list = []
            if len(l) and len(r):
                lb, rb = np.stack(l["bands"]), np.stack(r["bands"])
                ls, rs = (np.frombuffer(b"".join(x["slots"]), "<u2").reshape(-1, k) for x in (l, r))
                lz, rz = l["size"].to_numpy()[:, None], r["size"].to_numpy()[None, :]
                keys = {x: i for i, x in enumerate(sorted({*l["key"], *r["key"]}))}
                lk, rk = np.array([keys[x] for x in l["key"]]), np.array([keys[x] for x in r["key"]])
                classes = {x: i for i, x in enumerate(sorted({*l["c"], *r["c"]}))}
                lc, rc = np.array([classes[x] for x in l["c"]]), np.array([classes[x] for x in r["c"]])
                ok = (lc[:, None] != rc[None, :]) & (np.minimum(lz, rz) >= (least - 1e-6) * np.maximum(lz, rz))
                ok &= (lk[:, None] < rk[None, :]) | ~r["small"].to_numpy()[None, :]
                for band in range(int(np.flatnonzero(lb[0] == pdf["b"].iloc[0])[0])):
                    ok &= lb[:, band][:, None] != rb[:, band][None, :]
                same = np.zeros(ok.shape, np.uint16)
                for x in range(k):
                    same += ls[:, x][:, None] == rs[:, x][None, :]
                own: dict = {}
                root = list(range(len(classes)))

                def vector(x, i):
                    if (key := x["key"][i]) not in own:
                        own[key] = weighted_shingles((x["t"][i] or "").encode(), idf.value, shingle)
                    return own[key]

                def find(i):
                    while root[i] != i:
                        root[i] = root[root[i]]
                        i = root[i]
                    return i

                for i, j in zip(*np.nonzero(ok & (same >= least_agree)), strict=True):
                    x, y = find(lc[i]), find(rc[j])
                    if x != y and similarity(vector(l, i), vector(r, j)) >= least - 1e-6:
                        root[y] = x
                        out.append((l["key"][i], r["key"][j]))
            return pd.DataFrame(out, columns=["a", "b"])

        return saved(left.unionByName(right).groupBy("b", "i", "j").applyInPandas(held, "a binary, b binary"), "links")

    # each text against the least text among all its buckets
    tested = saved(agree(members.groupBy(F.col("key").alias("a")).agg(F.min("low").alias("b")).where("a <> b")), "tested")
    links = verified(tested)
    comps = saved(connected_components(links), "classes")
    placed = spread_join(members.drop("low"), comps.withColumnRenamed("node", "key"), "key", "b", "left", salts=1).withColumn("c", F.coalesce("component", "key")).drop("component")
    mixed = placed.groupBy("b", "c").agg(F.count("*").alias("n")).groupBy("b").agg(F.sum("n").alias("n"), F.count("*").alias("classes"), F.max(F.struct("n", "c")).alias("top")).where("classes > 1")
    open_ = saved(spread_join(placed, mixed.select("b", "n", F.col("top.c").alias("top"), (F.col("n") - F.col("top.n")).alias("n_small")), "b", "key", salts=1), "open")
    few = open_.where(F.col("n") <= list_up_to)
    met = few.where("c <> top").select("b", F.col("key").alias("x"), F.col("c").alias("x_c")).join(few.select("b", F.col("key").alias("y"), F.col("c").alias("y_c")), "b").where("x_c <> y_c")
    more = met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct().join(tested, ["a", "b"], "left_anti")
    found = verified(agree(more))
    many = open_.where(F.col("n") > list_up_to)
    if not many.isEmpty():
        found = found.unionByName(tiled(many))
    if not found.isEmpty():  # classes are components: the first ones stand for their links
        comps = saved(connected_components(comps.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(found)), "classes")
    return all_rows.select("id", "key"), comps.select(F.col("node").alias("key"), F.col("component").alias("class_key"))


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(id, class_id, class_size, kept) for each row: the least id of its class, its rows, and whether the row has that id.

    A row whose text has no words is a class of its own, with its own id. Rows that share the least id are all kept here.
    """
    members, classes = near_duplicates(docs, id_col, text_col, **options)
    named = spread_join(members, classes, "key", "id", "left").withColumn("class_key", F.coalesce("class_key", "key"))
    each = named.where("key is not null").groupBy("class_key").agg(F.min("id").alias("class_id"), F.count("*").alias("class_size"))
    out = spread_join(named, each, "class_key", "id", "left")
    alone = F.col("key").isNull()
    out = out.select("id", F.when(alone, F.col("id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"))
    return out.withColumn("kept", F.col("id").eqNullSafe(F.col("class_id")))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs with one row of each class: that with the least id, or one of its equals. Rows without words all stay."""
    members, classes = near_duplicates(docs, id_col, text_col, **options)
    named = spread_join(members.where("key is not null"), classes, "key", "id", "left").withColumn("class_key", F.coalesce("class_key", "key"))
    least = named.groupBy("class_key").agg(F.min("id").alias("class_id"), F.count("*").alias("n")).where("n > 1")
    key, class_key, class_id, k2 = fresh(docs, "near_key", "near_class", "near_id", "near_hit")
    hit = named.select("key", "class_key").distinct().join(least, "class_key").select(F.col("key").alias(key), F.lit(True).alias(k2), F.col("class_key").alias(class_key), F.col("class_id").alias(class_id))
    keyed = docs.withColumn(key, F.unhex(F.md5(F.coalesce(quoted(text_col).cast("string"), F.lit("")))))
    hit = saved(hit, "hits")
    joined = keyed.join(F.broadcast(hit), key, "left") if hit.count() <= 500_000 else spread_join(keyed, hit, key, id_col, "left")
    kept = joined.where(F.col(k2).isNull() | quoted(id_col).eqNullSafe(F.col(class_id)))
    # rows that share the least id of their class, if there are any
    tied = named.join(least, "class_key").where(F.col("id").eqNullSafe(F.col("class_id"))).groupBy("class_key").agg(F.count("*").alias("m")).where("m > 1")
    if not tied.isEmpty():
        tied = tied.select(F.col("class_key").alias(class_key))
        one = kept.join(tied, class_key, "left_semi").dropDuplicates([class_key])
        kept = kept.join(tied, class_key, "left_anti").select(*kept.columns).unionByName(one.select(*kept.columns))
    return kept.select(*[quoted(c) for c in docs.columns])


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """near_classes of all documents: each row's class, its size, and whether the row is the one that stays. Texts without words stay."""
    out = near_classes(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select(F.col("id").alias("doc_id"), "class_id", "class_size", "kept")


#: The classes by all pairs that share a shingle. Frequencies are exact here and count texts, where the operator's are of hashed
#: counters and count copies once; up to the floor, where nearly all shingles are, both weigh alike (the classes are the same on
#: 1,000 and 10,000 documents). Under some 1,000 texts the floor is one text: pairs that only just reach 0.8 can then differ.
OP3_SQL = r"""
with recursive d as (select doc_id, md5(coalesce(text, '')) as key, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents),
u as materialized (select key, any_value(ws) as ws, min(doc_id) as low, count(*) as n from d where len(ws) > 0 group by key),
g as (select key, unnest(case when len(ws) <= 5 then [array_to_string(ws, ' ')] else list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) end) as s from u),
c as materialized (select key, s, count(*) as tf from g group by key, s),
i as (select s, count(*) as df, ln(1 + (select count(*) from u) / greatest(count(*), (select count(*) from u) / 500.0, 1)) as w from c group by s),
v as materialized (select key, s, df, tf * w as x from c join i using (s)),
t as (select key, sum(x) as total from v group by key),
o as (select a.key as a, b.key as b, sum(least(a.x, b.x)) as m from v a join v b on a.s = b.s and a.key < b.key and a.df > 1 and b.df > 1 group by a.key, b.key),
l as materialized (select a, b from o join t x on a = x.key join t y on b = y.key where m >= 0.8 * (x.total + y.total - m)),
e as (select a, b from l union all select b, a from l),
r as (select key as node, key as seen from u union select r.node, e.b from r join e on r.seen = e.a),
k as (select node as key, min(low) as class_id, sum(n)::bigint as class_size from r join u on r.seen = u.key group by node)
select d.doc_id, coalesce(class_id, d.doc_id) as class_id, coalesce(class_size, 1) as class_size, coalesce(class_id, d.doc_id) = d.doc_id as kept from d left join k using (key)
"""
