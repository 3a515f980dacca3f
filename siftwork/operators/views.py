"""Training views of records, unions, splits and samples."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import contracts as K
from ..functions.jsonx import pretty


def labelled_input() -> Column:
    return F.concat_ws("\n", *[F.concat(F.lit(label), F.coalesce(f"input.{k}", F.lit(""))) for k, label in K.INPUT_LABELS])


def training_view(df: DataFrame, system: str = K.VIEW_SYSTEM, instruction: str = K.VIEW_INSTRUCTION) -> DataFrame:
    """Four texts: instruction, input (labelled lines), output (JSON with an indent of two) and system."""
    return df.select(F.lit(instruction).alias("instruction"), labelled_input().alias("input"), pretty(F.col("output"), df.schema["output"].dataType).alias("output"), F.lit(system).alias("system"))


def override_prompt(df: DataFrame, system: str = K.STRICT_SYSTEM, instruction: str = K.STRICT_INSTRUCTION) -> DataFrame:
    """The same rows under another instruction and system; all other columns stay."""
    return df.withColumns({"instruction": F.lit(instruction), "system": F.lit(system)})


def keep_fields(df: DataFrame, fields: tuple[str, ...] = K.RECORD_FIELDS) -> DataFrame:
    """A record's own fields alone, without lineage or scores."""
    return df.select(*fields)


def drop_internal(df: DataFrame, prefix: str = "_") -> DataFrame:
    """df without the columns whose names begin with prefix."""
    return df.select(*[c for c in df.columns if not c.startswith(prefix)])


def union_ordered(*frames: DataFrame) -> DataFrame:
    """All rows, with union_idx, the place of their frame."""
    out = None
    for i, f in enumerate(frames):
        f = f.withColumn("union_idx", F.lit(i))
        out = f if out is None else out.unionByName(f, allowMissingColumns=True)
    return out


def pick_by_position(df: DataFrame, ordinal: str, positions=K.KEPT_SEEDS) -> DataFrame:
    """The rows at 1-based positions, with pick, their place in that list."""
    spark = df.sparkSession
    picks = spark.createDataFrame([(i, int(p)) for i, p in enumerate(positions)], "pick long, pick_pos long")
    return df.join(F.broadcast(picks), F.col(ordinal) == F.col("pick_pos")).drop("pick_pos")


def hash_split(df: DataFrame, key: Column, eval_share: int, parts: int = 1000, seed: int = 42) -> DataFrame:
    """df with split, eval or train, by an arithmetic hash of an integer key: rows of a key stay together, and no sort is needed."""
    h = F.pmod((key.cast("long") + seed) * F.lit(2654435761), F.lit(1000003)) % parts
    return df.withColumn("split", F.when(h < eval_share, "eval").otherwise("train"))


def exact_split(df: DataFrame, ordinal: str, n: int, eval_count: int, smoke_count: int, seed: int = 42) -> DataFrame:
    """df with split and smoke as a seeded shuffle of n 0-based ordinals gives them: eval first, the rest train, smoke the first of train.

    For sets of up to 1,000,000 rows, as the permutation is made on the driver; hash_split serves larger ones. Counts must leave rows for train.
    """
    if not (0 < eval_count < n and 0 < smoke_count <= n - eval_count):
        raise ValueError("bad counts")
    if n > 1_000_000:
        raise ValueError("too many rows for a shuffle on the driver; hash_split serves them")
    order = list(range(n))
    random.Random(seed).shuffle(order)
    table = df.sparkSession.createDataFrame([(o, i) for i, o in enumerate(order)], "split_ord long, rank long")
    out = df.join(F.broadcast(table), F.col(ordinal) == F.col("split_ord")).drop("split_ord")
    return out.withColumns({"split": F.when(F.col("rank") < eval_count, "eval").otherwise("train"), "smoke": F.col("rank").between(eval_count, eval_count + smoke_count - 1)})


def sample_rows(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows by the least hash of seed and key, in order of key; all if n <= 0."""
    if n <= 0:
        return df.orderBy(key)
    return df.orderBy(F.xxhash64(F.lit(seed), key), key).limit(n).orderBy(key)


def exact_sample(df: DataFrame, ordinal: str, n: int, most: int, key: str = "sample_id", seed: int = 42) -> DataFrame:
    """most of n rows with 0-based ordinals as a seeded sample without replacement draws them, in order of key; all, as they come, if most <= 0 or n <= most.

    The draw is made on the driver, so most is 1,000,000 at most; sample_rows serves larger ones.
    """
    if most <= 0 or n <= most:
        return df
    if most > 1_000_000:
        raise ValueError("too many rows for a draw on the driver; sample_rows serves them")
    drawn = df.sparkSession.createDataFrame([(i,) for i in random.Random(seed).sample(range(n), most)], "drawn_ord long")
    return df.join(F.broadcast(drawn), F.col(ordinal) == F.col("drawn_ord")).drop("drawn_ord").orderBy(key)


def turns_to_pairs(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, turn, instruction, output, system): each user turn with the assistant turn right after it, and the conversation's first system text."""
    from pyspark.sql import Window

    w = Window.partitionBy(conv).orderBy(turn)
    t = turns.withColumns({"next_role": F.lead(role).over(w), "output": F.lead(text).over(w), "system": F.first(F.when(F.col(role) == "system", F.col(text)), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))})
    return t.where((F.col(role) == "user") & (F.col("next_role") == "assistant")).select(conv, turn, F.col(text).alias("instruction"), "output", F.coalesce("system", F.lit("")).alias("system"))


def catalog_entry(name: str, file_name: str, preference: bool = False) -> dict:
    """A dataset's entry: its file and which columns hold what."""
    columns = {"prompt": "instruction", "query": "input", "response": "output", "system": "system"}
    if preference:
        columns = {"prompt": "instruction", "query": "input", "chosen": "chosen", "rejected": "rejected", "system": "system"}
    return {name: {"file_name": file_name, **({"ranking": True} if preference else {}), "columns": columns}}
