"""Validation, routing, de-duplication, scoring, quotas and selection of records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import contracts as K
from ..contracts import DIAGNOSIS, RecordContract
from ..functions.text import contains_any, count_found, flatten, is_blank, strip


def reasons_array(*pairs: tuple[Column, str | Column]) -> Column:
    """The codes whose condition holds, in order; a null condition doesn't."""
    return F.array_compact(F.array(*[F.when(c, code if isinstance(code, Column) else F.lit(code)) for c, code in pairs]))


def _bad_list(c: Column) -> Column:
    return c.isNull() | (F.size(c) == 0) | ~F.coalesce(F.forall(c, lambda x: ~is_blank(x)), F.lit(False))


def schema_reasons(contract: RecordContract = DIAGNOSIS, expected: Column | None = None, codes: dict[str, str] | None = None, both_missing: bool = False) -> Column:
    """Reason codes of a record with columns instruction, input and output; expected: the category its file should hold.

    With no input or no output struct only that is reported beside the instruction (with neither, input; both, if both_missing).
    codes renames reasons.
    """
    named = lambda code: (codes or {}).get(code, code)
    has_in, has_out = F.col("input").isNotNull(), F.col("output").isNotNull()
    both = has_in & has_out
    pairs = [(~F.coalesce(F.col("instruction") == contract.instruction, F.lit(False)), "schema.instruction"), (~has_in, "schema.input"), (~has_out if both_missing else has_in & ~has_out, "schema.output")]
    pairs += [(both & is_blank(F.col(f"input.{k}")), f"schema.input.{k}") for k in contract.inputs]
    pairs += [(both & ~F.coalesce(F.col(f"output.{k}").isin(*v), F.lit(False)), f"schema.output.{k}") for k, v in contract.enums.items()]
    pairs += [(both & is_blank(F.col(f"output.{k}")), f"schema.output.{k}") for k in contract.texts]
    pairs += [(both & _bad_list(F.col(f"output.{k}")), f"schema.output.{k}") for k in contract.lists]
    if expected is not None:
        pairs.append((both & ~F.col("output.category").eqNullSafe(expected), "category_mismatch"))
    return reasons_array(*[(c, named(code)) for c, code in pairs])


def sample_reasons(contract: RecordContract = DIAGNOSIS) -> Column:
    """schema_reasons in the words used for samples that a model has made."""
    return schema_reasons(contract, codes=K.SAMPLE_CODES, both_missing=True)


def deny_reasons(text: Column, rules=K.DENY_LIST) -> Column:
    return reasons_array(*[(contains_any(text, needles), code) for code, needles in rules])


def record_text(contract: RecordContract = DIAGNOSIS) -> Column:
    return flatten(F.col("instruction"), *[F.col(f"input.{k}") for k in contract.inputs], *[F.col(f"output.{k}") for k in contract.outputs])


def first_by(df: DataFrame, keys: list[Column], order: list[Column], name: str = "nth") -> DataFrame:
    """df with the rank of each row among those of its key; nulls are a key like others."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def validate_and_dedup(df: DataFrame, order: list[str], contract: RecordContract = DIAGNOSIS, expected: Column | None = None) -> DataFrame:
    """df with reasons: of schema, deny list, and duplicate.question_log for all but the first valid row of (category, question, log), stripped."""
    df = df.withColumn("reasons", F.array_sort(F.array_distinct(F.concat(schema_reasons(contract, expected), deny_reasons(record_text(contract), contract.deny)))))
    ok = F.size("reasons") == 0
    keys = [ok, *[F.when(ok, strip(F.col(c))) for c in ("output.category", "input.user_question", "input.log")], F.when(~ok, F.struct(*order))]
    df = first_by(df, keys, [F.col(c) for c in order])
    again = F.when(ok & (F.col("nth") > 1), F.array(F.lit("duplicate.question_log"))).otherwise(F.col("reasons"))
    return df.withColumn("reasons", again).drop("nth")


def route(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, rejected) by whether there are reasons. Keep df in a table if both are used."""
    return df.where(F.size("reasons") == 0).drop("reasons"), df.where(F.size("reasons") > 0)


def reason_counts(df: DataFrame, top: int | None = None) -> DataFrame:
    """(reason, n) over distinct reasons of each row; the top commonest, ties by name, if top is given."""
    out = df.select(F.explode(F.array_distinct("reasons")).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))
    return out if top is None else out.orderBy(F.desc("n"), "reason").limit(top)


def field_counts(df: DataFrame, *keys: str) -> DataFrame:
    """Rows for each combination of keys and for each leading part of them, all rows last; all_<key> is 1 where a key is summed over."""
    return df.rollup(*keys).agg(F.count("*").alias("n"), *[F.grouping(k).cast("int").alias(f"all_{k}") for k in keys])


def histogram(df: DataFrame, key: str = "score") -> DataFrame:
    """(key, n), in falling order of key."""
    return df.groupBy(key).agg(F.count("*").alias("n")).orderBy(F.desc(key))


def keep_counts(df: DataFrame, by: Column) -> DataFrame:
    """(grp, n_kept, n_rejected, n_rows) for each group, and one row of totals with grp null and is_total."""
    bad = F.size("reasons") > 0
    t = df.select(by.alias("grp"), bad.alias("bad")).rollup("grp")
    return t.agg(F.count_if(~F.col("bad")).alias("n_kept"), F.count_if("bad").alias("n_rejected"), F.count("*").alias("n_rows"), F.grouping("grp").cast("int").alias("is_total"))


def keep_k(df: DataFrame, keys: list[str], order: list[str], k: int, last: bool = False) -> DataFrame:
    """The first, or last, k rows of each key in that order; at least one. Rows whose key is null or empty go."""
    for key in keys:
        df = df.where(F.col(key).isNotNull() & (F.col(key).cast("string") != ""))
    w = [F.col(c).desc() if last else F.col(c) for c in order]
    return first_by(df, [F.col(c) for c in keys], w).where(F.col("nth") <= max(1, k)).drop("nth")


def quality_score() -> tuple[Column, Column]:
    """(score, reasons) of a diagnosis record, from text without lineage fields."""
    root, steps, log = F.coalesce(F.col("output.root_cause"), F.lit("")), F.col("output.next_steps"), F.coalesce(F.col("input.log"), F.lit(""))
    text = F.to_json(F.struct("instruction", "input", "output"))
    n = lambda c: F.greatest(F.lit(0), F.coalesce(F.size(c), F.lit(0)))
    weak = count_found(F.array_join(F.coalesce(steps, F.array().cast("array<string>")), "\n"), K.WEAK_STEPS)
    bad, good, generic = count_found(text, K.BAD_ADVICE), contains_any(text, K.GOOD_SIGNALS), contains_any(root, K.GENERIC_ROOTS)
    low, oom, concrete = F.col("output.severity") == "low", contains_any(log, ("OOM", "out of memory")), contains_any(log, ("404", "403", "No such file or directory"))
    one = lambda c, w: F.when(c, w).otherwise(0)
    score = one(F.length(root) >= 28, 1) + one(n(steps) >= 2, 1) + one(n(F.col("output.missing_info")) >= 2, 1) + one(good, 2) - one(generic, 2) - weak - 3 * bad - one(low, 1) + one(oom, 1) + one(concrete, 1) + one(contains_any(log, ("Traceback", "RuntimeError", "ValueError")), 1)
    why = reasons_array((good, "specific_signal"), (generic, "generic_root"), (weak > 0, "weak_steps"), (bad > 0, "questionable_advice"), (low, "low_severity"), (oom, "clear_log_signal"), (concrete, "concrete_error"))
    return score.cast("int"), F.array_sort(why)


def hamilton_quota(counts: DataFrame, group: str, target: int, order: list[Column] | None = None) -> DataFrame:
    """(group, n, quota): target, or all rows if fewer, shared in proportion to n by largest remainders; ties go by order (the group's name).

    counts has a row a group; groups of no rows get none, and no groups get no rows.
    """
    every = Window.partitionBy(F.lit(0))
    total = F.sum("n").over(every)
    t = counts.withColumn("goal", F.least(F.lit(target).cast("long"), total)).withColumn("exact", F.when(total > 0, (F.col("goal") * F.col("n")).cast("double") / total).otherwise(0.0))
    t = t.withColumn("base", F.floor("exact")).withColumn("spare", F.col("goal") - F.sum("base").over(every))
    rank = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy((F.col("exact") - F.col("base")).desc(), *(order or [F.col(group).asc()])))
    return t.withColumn("quota", (F.col("base") + F.when(rank <= F.col("spare"), 1).otherwise(0)).cast("long")).select(group, "n", "quota")


def top_by_quota(df: DataFrame, group: str, quotas: DataFrame, order: list[Column]) -> DataFrame:
    """df with nth, its rank in its group, and selected: whether that is within the group's quota. Groups without a quota select nothing."""
    ranked = first_by(df, [F.col(group)], order)
    q = quotas.select(F.col(group).alias("quota_group"), "quota")
    return ranked.join(q, ranked[group].eqNullSafe(q["quota_group"]), "left").withColumn("selected", F.coalesce(F.col("nth") <= F.col("quota"), F.lit(False))).drop("quota_group", "quota")


def select_records(df: DataFrame, target: int, order: list[str], categories=K.CATEGORIES) -> DataFrame:
    """Scored records with selected and, for the rest, reject_reasons: their own, or lower_ranked, or unknown_category."""
    score, why = quality_score()
    known = F.col("output.category").isin(*categories)
    s = df.withColumns({"score": score, "score_reasons": why, "grp": F.when(known, F.col("output.category"))})
    counts = s.where("grp is not null").groupBy("grp").agg(F.count("*").alias("n"))
    place = F.array_position(F.array(*map(F.lit, categories)), F.col("grp"))
    by = [F.desc("score"), F.size("output.next_steps").desc(), F.size("output.missing_info").desc(), F.length("output.root_cause").desc(), *[F.col(c) for c in order]]
    out = top_by_quota(s, "grp", hamilton_quota(counts, "grp", target, [place]), by)
    rest = F.when(F.col("grp").isNull(), F.array(F.lit("unknown_category"))).when(F.size("score_reasons") == 0, F.array(F.lit("lower_ranked"))).otherwise(F.col("score_reasons"))
    return out.withColumn("reject_reasons", F.when(~F.col("selected"), rest)).drop("nth", "grp")


def value_counts(df: DataFrame, key: Column, default: str | None = None) -> DataFrame:
    k = key if default is None else F.coalesce(F.nullif(key, F.lit("")), F.lit(default))
    return df.groupBy(k.alias("value")).agg(F.count("*").alias("n"))


def duplicate_keys(df: DataFrame, keys: list[str], k: int = 1) -> DataFrame:
    """Keys with more than k rows."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > k)


def numbered(df: DataFrame, order: list, name: str = "ordinal", start: int = 0) -> DataFrame:
    """df with name, each row's place in that order from start on, without all rows in one task: rows are sorted by ranges and
    written, and a place is the rows of the ranges before it (a row a range) and the place within its own."""
    from ..sources.sinks import scratch

    spark, path = df.sparkSession, scratch(df.sparkSession, "sorted")
    df.orderBy(*order).withColumns({"_range": F.spark_partition_id(), "_place": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))}).write.option("compression", "zstd").parquet(path)
    rows = spark.read.parquet(path)
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    bases = rows.groupBy("_range").agg(F.count("*").alias("_n")).select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    return rows.join(F.broadcast(bases), "_range").withColumn(name, F.col("_base") + F.col("_place") + start).drop("_range", "_place", "_base")


def chunked(df: DataFrame, order: list[str], size: int, by: list[str] | None = None) -> DataFrame:
    """df with chunk, the 0-based number of its chunk of size rows in that order: of all rows, or of those of each key by."""
    if by:
        return df.withColumn("chunk", F.floor((F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1) / size))
    return numbered(df, order, "_ordinal").withColumn("chunk", F.floor(F.col("_ordinal") / size)).drop("_ordinal")


def shared_keys(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """a's rows whose key b has too."""
    return a.join(b.select(key).distinct(), key, "left_semi")


def manifest(df: DataFrame, distinct: list[str], sums: list[str]) -> DataFrame:
    """One row: n_rows, how many values each of distinct has, and the sum of each of sums."""
    return df.agg(F.count("*").alias("n_rows"), *[F.countDistinct(c).alias(f"n_{c}s") for c in distinct], *[F.sum(c).alias(c) for c in sums])
