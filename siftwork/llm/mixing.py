"""Mixing sources to target weights; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD_RE, fresh, quoted, saved


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_RE)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), most: float = 3.0) -> DataFrame:
    """(source, source_size, target) from sizes (source, source_size).

    Sources in order of code points, null last, weigh weights, repeating. They share the sum of all sizes; a target stops at
    most times its source's size and the excess is shared again by weight until none is above. That is one water level:
    in order of size by weight, the first n sources are full and the others get level x weight. A source of size 0 gets 0.
    The table has a row a source, so its two windows sort that and nothing larger.
    """
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), F.pmod(rank - 1, F.lit(len(weights))) + 1)
    t = sizes.select("source", "source_size", w.alias("w"), rank.alias("rank")).withColumn("room", F.col("source_size") * F.lit(float(most)))
    order = Window.orderBy(F.col("room") / F.col("w"), "rank")
    full = order.rowsBetween(Window.unboundedPreceding, -1)
    rest = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # the level if all sources before this one are full, and this one and those after it are not
    level = (F.sum("source_size").over(whole) - F.coalesce(F.sum("room").over(full), F.lit(0.0))) / F.sum("w").over(rest)
    t = t.withColumn("level", level).withColumn("fits", F.col("level") * F.col("w") <= F.col("room"))
    t = t.withColumn("water", F.first(F.when(F.col("fits"), F.col("level")), ignorenulls=True).over(whole))
    return t.select("source", "source_size", F.when(F.col("water").isNull(), F.col("room")).otherwise(F.least(F.col("room"), F.col("water") * F.col("w"))).alias("target"))


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (5.0, 2.0, 1.0), most: float = 3.0, seed: int = 42, size_col: str | None = None) -> DataFrame:
    """docs with the columns mix_size, mix_source_size, mix_target and mix_copies; `_` is put before clashing names.

    mix_size: words of the text (null: 0), or what size_col says, if that is given. A source's rate is its target by its size (0 for an empty source). A document gets
    floor(rate) copies and one more with the probability of the fraction, decided by a hash of the seed and the id: rows that
    share an id decide alike, rows without one by their text, and reruns agree. A source that holds a third of all rows is summed with partial
    sums and joined to a written table of one row a source, which Spark broadcasts only if that is small, else splits the sources' rows. An empty table gives one.
    """
    size, source, total, target, copies = fresh(docs, "mix_size", "mix_source", "mix_source_size", "mix_target", "mix_copies")
    own = docs.withColumn(size, F.coalesce(quoted(size_col).cast("long"), F.lit(0)) if size_col else word_count(quoted(text_col)))
    sizes = own.select(quoted(source_col).alias("source"), F.col(size).alias("n")).groupBy("source").agg(F.sum("n").alias("source_size"))
    goals = source_targets(sizes, weights, most).select(F.col("source").alias(source), F.col("source_size").alias(total), F.col("target").alias(target))
    goals = saved(goals, "targets")  # its size is then known when the join is planned: texts aren't shuffled to meet a small table
    rate = F.when(F.col(total) > 0, F.col(target) / F.col(total)).otherwise(F.lit(0.0))
    blank = F.concat(F.lit("null:"), F.md5(F.coalesce(quoted(text_col).cast("string"), F.lit("")))) if text_col in docs.columns else F.lit("null")
    draw = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(quoted(id_col).cast("string"), blank))), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))
    out = own.join(goals, quoted(source_col).eqNullSafe(F.col(source)), "left").withColumn(copies, (F.floor(rate) + F.when(draw < rate - F.floor(rate), 1).otherwise(0)).cast("int"))
    return out.drop(source)


def emit_copies(mixed: DataFrame, copies_col: str = "mix_copies") -> DataFrame:
    """Each row as often as copies_col says."""
    (x,) = fresh(mixed, "copy")
    return mixed.where(quoted(copies_col) > 0).withColumn(x, F.explode(F.sequence(F.lit(1), quoted(copies_col)))).drop(x)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents; null text has size 0. Only sizes are asked for, so words are counted once, into a table of ids, sources and sizes."""
    sizes = saved(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", word_count(F.col("text")).alias("size"), F.when(F.col("doc_id").isNull(), F.col("text")).alias("text")), "sizes")
    out = mix_sources(sizes, size_col="size")
    return out.select("doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), (F.col("mix_size") * F.col("mix_copies")).alias("taken"))


OP5_SQL = r"""
with d as (select doc_id, source, text, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size from documents),
s as (select source, sum(size)::bigint as source_size from d group by source),
w as (select *, row_number() over (order by source nulls last) as rank from s),
t as (select *, [5.0::double, 2.0::double, 1.0::double][(rank - 1) % 3 + 1] as w, source_size * 3.0::double as room from w),
l as (select *, (sum(source_size) over ()::double - coalesce(sum(room) over (order by room / w, rank rows between unbounded preceding and 1 preceding), 0.0))
  / sum(w) over (order by room / w, rank rows between current row and unbounded following) as level from t),
g as (select *, (select level from l as x where x.level * x.w <= x.room order by x.room / x.w, x.rank limit 1) as water from l),
m as (select source, source_size, case when water is null then room else least(room, water * w) end as target from g)
select d.doc_id, d.size, m.source_size, m.target, d.size * (floor(r)::bigint + case when u < r - floor(r) then 1 else 0 end) as taken
from (select d.*, ('0x' || substr(md5('42:' || coalesce(doc_id::varchar, 'null:' || md5(coalesce(text, '')))), 1, 13))::bigint::double / 4503599627370496.0::double as u from d) d
join m on d.source is not distinct from m.source, lateral (select case when m.source_size > 0 then m.target / m.source_size else 0.0::double end as r)
"""
