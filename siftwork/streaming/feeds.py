"""Growing JSON-lines folders as streams, flushed in micro-batches, and the loop that fills categories up to a target."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def stream_jsonl(spark: SparkSession, folder: str, schema: str, files_a_batch: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).json(folder)


def flush(stream: DataFrame, path: str, checkpoint: str):
    """What has come so far, appended as Parquet once and for all: a batch that is run again isn't written again."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def flush_each(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str):
    """write(batch, batch id) for each micro-batch."""
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def first_seen(stream: DataFrame, keys: list[str], time_col: str, delay: str) -> DataFrame:
    """The first row of each key within delay of the latest time seen; state older than that goes."""
    return stream.withWatermark(time_col, delay).dropDuplicatesWithinWatermark(keys)


def first_k(stream: DataFrame, key: str, order: str, k: int) -> DataFrame:
    """The first k rows of each key as they arrive, those of one batch by order; at least one. State is a count for each key. Null keys go.

    Written in append mode; the columns are the stream's.
    """
    most = max(1, k)

    def run(keys, frames, state):
        import pandas as pd

        seen = state.get[0] if state.exists else 0
        rows = pd.concat(list(frames), ignore_index=True).sort_values(order).head(max(0, most - seen))
        state.update((seen + len(rows),))
        yield rows

    return stream.where(F.col(key).isNotNull()).groupBy(key).applyInPandasWithState(run, stream.schema, "n long", "append", "NoTimeout")


def smallest_group(counts: DataFrame, group: str, names: list[str]) -> DataFrame:
    """(group, n): the group with the fewest rows, of names; ties go to the first in that order, and names without rows have none."""
    table = F.array(*map(F.lit, names))
    base = counts.sparkSession.createDataFrame([(x,) for x in names], "name string")
    t = base.join(counts.select(F.col(group).alias("name"), "n"), "name", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return t.agg(F.min_by(F.struct("name", "n"), F.struct("n", F.array_position(table, F.col("name")))).alias("x")).select(F.col("x.name").alias(group), "x.n")


def collect_until(target: int, max_rounds: int, counts: Callable[[], DataFrame], run: Callable[[str], object], names: list[str], group: str = "category") -> list[str]:
    """Runs the smallest group again and again until there are target rows, or max_rounds; gives the groups it ran."""
    ran = []
    for _ in range(max_rounds):
        now = counts()
        if (now.agg(F.sum("n")).first()[0] or 0) >= target:
            break
        ran.append(smallest_group(now, group, names).first()[group])
        run(ran[-1])
    return ran
