"""Token totals kept by signed deltas, with idempotent batch commits."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, fresh, new_path, ordinary_encoder, quoted, texts_of

_KEYS = ("source", "lang", "tokenizer")
_ROWS = "doc_id long, source string, lang string, tokenizer string, docs long, tokens long"
_BUCKETS = 64


def _bucket():
    return F.pmod(F.xxhash64("doc_id", "tokenizer"), F.lit(_BUCKETS)).cast("int")


def count_tokens(docs: DataFrame, tokenizers: list[str], text_col: str = "text") -> DataFrame:
    """docs without text_col, a row for each tokenizer, with tokenizer and n_tokens of the whole text (null: 0; bytes that aren't UTF-8 count as U+FFFD); `_` is put before clashing names."""
    import pyarrow as pa

    bounded_batches(docs.sparkSession)

    kept = [f for f in docs.schema.fields if f.name != text_col]
    name, number = fresh(docs.drop(text_col), "tokenizer", "n_tokens")

    def counted(batches):
        counters = [ordinary_encoder(t) for t in tokenizers]
        for batch in batches:
            texts = texts_of(batch.column(0))
            for t, count in zip(tokenizers, counters, strict=True):
                yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array([t] * len(texts), pa.string()), pa.array([len(count(x)) for x in texts], pa.int64())], [*(f.name for f in kept), name, number])

    from pyspark.sql.types import LongType, StringType, StructType

    schema = StructType(list(kept)).add(name, StringType()).add(number, LongType())
    return docs.select(quoted(text_col).cast("string"), *[quoted(f.name) for f in kept]).mapInArrow(counted, schema)


class TokenRollups:
    """Totals of documents and tokens by source, language and tokenizer, under path in a store that Spark writes to.

    A batch is a table of changes: op (insert, delete or revise), doc_id, source, lang, tokenizer, n_tokens. It becomes signed
    rows: an insert adds its row; a delete takes away whatever the document has under that tokenizer; a revision takes that
    away and adds its own row, under the old source and language where its own are null, and nothing if there was none.
    Each row of an insert counts, so repeated rows add up; of several deletes and revisions of a document and tokenizer in one
    batch one holds: a deletion, else the revision of most tokens. They refer to the state before the batch. A null tokenizer is a version of its own, as are a null source and language; null ids are one document.

    Signed rows and their totals are written aside and committed by one rename to the batch's name, which the store must do at
    once or not at all (as HDFS and local disks do; object stores without that need another commit). A batch name that is
    there is not applied again; an attempt that died leaves nothing that is read, and one that lost is deleted. Totals are sums
    over the committed batches' small tables, so readers don't work through documents. The signed rows, of some numbers a
    document and no text, lie in 64 buckets by a hash of document and tokenizer: a commit with deletes or revisions reads those
    buckets alone that its changes fall in, and one with inserts only reads none.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark._jvm
        self._of = jvm.org.apache.hadoop.fs.Path
        self._fs = self._of(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._of(f"{self.path}/batches"))

    def _batches(self) -> list[str]:
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._of(f"{self.path}/batches")))

    def _read(self, what: str, schema: str) -> DataFrame:
        paths = [f"{self.path}/batches/{b}/{what}" for b in self._batches()]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def ledger(self, buckets: list[int] | None = None) -> DataFrame:
        """The signed rows of all committed batches, or of some of their buckets."""
        some = "*" if buckets is None else "{" + ",".join(map(str, buckets)) + "}"
        found = self._fs.globStatus(self._of(f"{self.path}/batches/*/rows/bucket={some}"))
        paths = [s.getPath().toString() for s in found]
        return self.spark.read.schema(_ROWS).parquet(*paths) if paths else self.spark.createDataFrame([], _ROWS)

    def totals(self) -> DataFrame:
        """(source, lang, tokenizer, n_docs, n_tokens) of what is left; groups that have come to nothing are absent."""
        t = self._read("totals", "source string, lang string, tokenizer string, docs long, tokens long").groupBy(*_KEYS)
        return t.agg(F.sum("docs").alias("n_docs"), F.sum("tokens").alias("n_tokens")).where("n_docs <> 0 or n_tokens <> 0")

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Applies a batch; False if one of that name has been applied. Names are letters, digits, - and _."""
        if not batch or batch.strip("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789-_"):
            raise ValueError("bad batch name")
        target = self._of(f"{self.path}/batches/{batch}")
        if self._fs.exists(target):
            return False
        aside = f"{self.path}/aside/{uuid.uuid4().hex}"
        c = changes.select("op", F.col("doc_id").cast("long").alias("doc_id"), *[F.col(k).cast("string").alias(k) for k in _KEYS], F.coalesce("n_tokens", F.lit(0)).cast("long").alias("n"))
        c.write.option("compression", "zstd").parquet(f"{aside}/changes")  # so that they are worked out once
        c = self.spark.read.schema(c.schema).parquet(f"{aside}/changes")
        new = c.where("op = 'insert'").select("doc_id", *_KEYS, F.lit(1).cast("long").alias("docs"), F.col("n").alias("tokens"))
        if self._batches():
            late = c.where("op in ('delete', 'revise')").groupBy("doc_id", "tokenizer").agg(F.max(F.struct((F.col("op") == "delete").alias("gone"), "n", F.col("source").alias("s"), F.col("lang").alias("l"))).alias("x"))
            touched = [r[0] for r in late.select(_bucket().alias("b")).distinct().collect()]
            late = late.select(F.col("doc_id").alias("id2"), F.col("tokenizer").alias("tok2"), "x")
            led = self.ledger(touched)
            state = led.join(late, led.doc_id.eqNullSafe(late.id2) & led.tokenizer.eqNullSafe(late.tok2)).groupBy("doc_id", *_KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"), F.max("x").alias("x")).where("docs <> 0 or tokens <> 0")
            minus = state.select("doc_id", *_KEYS, (-F.col("docs")).alias("docs"), (-F.col("tokens")).alias("tokens"))
            plus = state.where("not x.gone").groupBy("doc_id", "tokenizer").agg(F.max("source").alias("source"), F.max("lang").alias("lang"), F.max("x").alias("x"))
            plus = plus.select("doc_id", F.coalesce("x.s", "source").alias("source"), F.coalesce("x.l", "lang").alias("lang"), "tokenizer", F.lit(1).cast("long").alias("docs"), F.col("x.n").alias("tokens"))
            new = new.unionByName(minus).unionByName(plus)
        # rows of a bucket lie together; a bucket that is much larger than others is split
        new.withColumn("bucket", _bucket()).hint("rebalance", "bucket").write.partitionBy("bucket").option("compression", "zstd").parquet(f"{aside}/rows")
        rows = self.spark.read.schema(_ROWS + ", bucket int").parquet(f"{aside}/rows")
        rows.groupBy(*_KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens")).write.parquet(f"{aside}/totals")
        inside = self._of(f"{target}/{aside.rpartition('/')[2]}")
        if self._fs.rename(self._of(aside), target) and not self._fs.exists(inside):
            return True
        # another writer was first: a rename to a folder that is there fails or puts this attempt inside it
        for path in (self._of(aside), inside):
            self._fs.delete(path, True)
        return False


def op8_token_rollups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents under two tokenizer versions; the same batch again, which changes nothing; documents labelled toxic are
    withdrawn; counts of those of bad quality are revised to their texts with each run of white space as one space."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source", "lang")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").groupBy(F.col("doc_id").alias("lab_id")).agg(F.max("toxic").alias("toxic"), F.min("quality").alias("quality"))
    versions = ["byte_bpe_50k", "byte_bpe_multi_50k"]
    rollups = TokenRollups(spark, new_path(spark, "rollups"))
    load = count_tokens(docs, versions).withColumn("op", F.lit("insert"))
    rollups.commit("load", load)
    rollups.commit("load", load)
    gone = docs.drop("text").join(labels.where("toxic = 1"), F.col("doc_id") == F.col("lab_id")).select("doc_id", "source", "lang", F.lit(0).alias("n_tokens"), F.lit("delete").alias("op"), F.explode(F.array(*map(F.lit, versions))).alias("tokenizer"))
    rollups.commit("takedown", gone)
    poor = labels.where("quality = 0 and lab_id is not null").select("lab_id")
    if poor.count() <= 1_000_000:  # else texts are shuffled to meet them
        poor = F.broadcast(poor)
    bad = docs.join(poor, F.col("doc_id") == F.col("lab_id")).select("doc_id", "source", "lang", F.trim(F.regexp_replace("text", r"[\x20\x09-\x0D]+", " ")).alias("text"))
    rollups.commit("respaced", count_tokens(bad, versions).withColumn("op", F.lit("revise")))
    return rollups.totals()
