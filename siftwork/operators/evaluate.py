"""Rule metrics of model outputs, pairwise judging, preference pairs and their statistics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import contracts as K
from ..contracts import DIAGNOSIS, RecordContract
from ..functions.jsonx import strict_json
from ..functions.text import strip
from .curate import first_by

FLAGS = ("json_parse_success", "required_fields_present", "no_extra_top_level_fields", "category_enum_valid", "severity_enum_valid", "summary_nonempty", "root_cause_nonempty", "missing_info_is_nonempty_list", "next_steps_is_nonempty_list", "schema_valid")


def rule_metrics(df: DataFrame, output: str = "raw_output", reference: str | None = None, contract: RecordContract = DIAGNOSIS) -> DataFrame:
    """df with metrics: FLAGS, parse_error and, where the reference parses, <enum>_matches_reference, in which none equals none."""
    df = df.withColumn("_o", strict_json(F.col(output)))
    if reference:
        df = df.withColumn("_r", strict_json(F.col(reference)))
    o = F.col("_o")
    ok, want = o["ok"], F.array(*map(F.lit, contract.outputs))
    value = lambda s, k: F.try_element_at(s["scalars"], F.lit(k))
    flag = lambda c: F.coalesce(ok & c, F.lit(False))
    present = F.size(F.array_except(want, o["keys"])) == 0
    out = {"json_parse_success": ok, "required_fields_present": flag(present), "no_extra_top_level_fields": flag(present & (F.size(F.array_except(o["keys"], want)) == 0))}
    out |= {f"{k}_enum_valid": flag(value(o, k).isin(*v)) for k, v in contract.enums.items()}
    out |= {f"{k}_nonempty": flag(strip(value(o, k)) != "") for k in contract.texts}
    out |= {f"{k}_is_nonempty_list": flag(F.try_element_at(o["sizes"], F.lit(k)) > 0) for k in contract.lists}
    out["schema_valid"] = reduce(lambda a, b: a & b, [v for k, v in out.items() if k != "json_parse_success"])
    fields = [v.alias(k) for k, v in out.items()] + [o["error"].alias("parse_error")]
    for k in contract.enums:
        match = F.when(ok & F.col("_r")["ok"], value(o, k).eqNullSafe(value(F.col("_r"), k))) if reference else F.lit(None).cast("boolean")
        fields.append(match.alias(f"{k}_matches_reference"))
    return df.withColumn("metrics", F.struct(*fields)).drop("_o", "_r")


def metric_summary(df: DataFrame, by: str = "variant", flags=FLAGS, optional=("category_matches_reference", "severity_matches_reference")) -> DataFrame:
    """A row for each variant and metric: passed, of (rows; for optional ones those that aren't null) and rate to four places (ties to the even digit)."""
    items = [F.struct(F.lit(k).alias("metric"), F.coalesce(F.col(f"metrics.{k}"), F.lit(False)).alias("v")) for k in flags] + [F.struct(F.lit(k).alias("metric"), F.col(f"metrics.{k}").alias("v")) for k in optional]
    t = df.select(by, F.explode(F.array(*items)).alias("x")).groupBy(by, "x.metric").agg(F.count_if("x.v").alias("passed"), F.count("x.v").alias("of"))
    return t.withColumn("rate", F.when(F.col("of") > 0, F.bround(F.col("passed") / F.col("of"), 4)))


def number_stats(df: DataFrame, by: list[str], column: str) -> DataFrame:
    """Mean, least and largest, and how many there are, of what isn't null."""
    return df.where(F.col(column).isNotNull()).groupBy(*by).agg(F.avg(column).alias("mean"), F.min(column).alias("least"), F.max(column).alias("most"), F.count(column).alias("n"))


def failing_ids(df: DataFrame, flag: Column, key: str, by: str) -> DataFrame:
    """(by, ids): the ids for which flag isn't true, in order, a comma between."""
    return df.where(~F.coalesce(flag, F.lit(False))).groupBy(by).agg(F.array_join(F.array_sort(F.collect_list(key)).cast("array<string>"), ",").alias("ids"))


def last_by_key(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """One row for each key: the last."""
    return first_by(df, [F.col(key)], [F.col(c).desc() for c in order]).where("nth = 1").drop("nth")


def pair_results(a: DataFrame, b: DataFrame, key: str = "sample_id", required: bool = False) -> DataFrame:
    """Rows of both by key, as structs a and b. required: a left row without a right one is an error instead of being left out."""
    left, right = (x.select(F.col(key), F.struct(*[c for c in x.columns if c != key]).alias(n)) for x, n in ((a, "a"), (b, "b")))
    out = left.join(right, key, "left" if required else "inner")
    if required:
        out = out.where(F.when(F.col("b").isNull(), F.raise_error(F.concat(F.lit("no right row for "), F.col(key).cast("string")))).otherwise(F.lit(True)))
    return out


def schema_gate(a_valid: Column, b_valid: Column) -> tuple[Column, Column, Column]:
    """(winner, confidence, source): the valid side of one valid and one not, a tie of none valid; null where a judge must decide."""
    a, b = F.coalesce(a_valid, F.lit(False)), F.coalesce(b_valid, F.lit(False))
    winner = F.when(a & ~b, "A").when(b & ~a, "B").when(~a & ~b, "tie")
    return winner, F.when(winner.isNotNull(), "high"), F.when(winner.isNotNull(), "schema_gate")


def swap_sides(df: DataFrame, swapped: Column, winner: str = "winner", winners: str = "dimension_winners", scores: str = "dimension_scores", overall: str = "overall_scores", legacy_scores: bool = False) -> DataFrame:
    """Judgements of swapped pairs turned back: winners and, unless legacy_scores, both sides' scores."""
    other = lambda c: F.when(c == "A", "B").when(c == "B", "A").otherwise(c)
    turn = lambda s: F.struct(s["B_score"].alias("A_score"), s["A_score"].alias("B_score"))
    new = {winner: F.when(swapped, other(F.col(winner))).otherwise(F.col(winner)), winners: F.when(swapped, F.transform_values(winners, lambda k, v: other(v))).otherwise(F.col(winners))}
    if not legacy_scores:
        new |= {scores: F.when(swapped, F.transform_values(scores, lambda k, v: turn(v))).otherwise(F.col(scores)), overall: F.when(swapped, turn(F.col(overall))).otherwise(F.col(overall))}
    return df.withColumns(new)


def coin(key: Column, seed: int = 42) -> Column:
    """A seeded toss for each key, the same in any order of rows."""
    return F.pmod(F.xxhash64(F.lit(seed), key), F.lit(2)) == 1


def judge_summary(df: DataFrame) -> DataFrame:
    """One row: counts by winner, usable and highly confident pairs, and win shares without ties (null if there are none)."""
    t = df.agg(F.count("*").alias("n"), *[F.count_if(F.col("winner") == w).alias(f"n_{w.lower()}") for w in ("A", "B", "tie")], F.count_if(F.col("winner").isin("A", "B")).alias("n_usable"), F.count_if(F.col("winner").isin("A", "B") & (F.col("winner_confidence") == "high")).alias("n_high"))
    return t.withColumns({"a_rate": F.when(F.col("n_usable") > 0, F.col("n_a") / F.col("n_usable")), "b_rate": F.when(F.col("n_usable") > 0, F.col("n_b") / F.col("n_usable"))})


def judge_counts(df: DataFrame, label_a: str, label_b: str) -> DataFrame:
    """(kind, value, n): rows by judge_source (source), by winner, and wins under the sides' labels (wins; ties under tie), also those of none."""
    label = F.when(F.col("winner") == "A", label_a).when(F.col("winner") == "B", label_b).when(F.col("winner") == "tie", "tie")
    each = df.select(F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), c.alias("value")) for k, c in (("source", F.col("judge_source")), ("winner", F.col("winner")), ("wins", label))])).alias("x")).select("x.*")
    known = df.sparkSession.createDataFrame([("wins", label_a, 0), ("wins", label_b, 0), ("wins", "tie", 0)], "kind string, value string, one int")
    return each.where("value is not null").withColumn("one", F.lit(1)).unionByName(known).groupBy("kind", "value").agg(F.sum("one").alias("n"))


def judged_flags(df: DataFrame) -> DataFrame:
    """df with usable_for_dpo (a side has won) and high_confidence_for_dpo; false where there is no winner."""
    usable = F.coalesce(F.col("winner").isin("A", "B"), F.lit(False))
    return df.withColumns({"usable_for_dpo": usable, "high_confidence_for_dpo": usable & F.coalesce(F.col("winner_confidence") == "high", F.lit(False))})


#: A judged row's fields, in order.
JUDGED = ("sample_id", "judge_source", "winner", "winner_confidence", "dimension_winners", "dimension_scores", "overall_scores", "reason", "used_reference", "candidate_a_label", "candidate_b_label", "candidate_a_output", "candidate_b_output", "reference_output", "raw_response_id", "usable_for_dpo", "high_confidence_for_dpo")


def judged_rows(df: DataFrame, use_reference: bool = False) -> DataFrame:
    """What judge_pairs gives in the fixed shape of JUDGED; reference_output is null unless the judge was shown it, raw_response_id if the client gave none."""
    named = df.withColumnsRenamed({"source": "judge_source", **{f"{s}_{c}": f"candidate_{s}_{c}" for s in "ab" for c in ("label", "output")}})
    own = F.col("raw_response_id") if "raw_response_id" in df.columns else F.lit(None).cast("string")
    reference = F.col("reference_output") if use_reference else F.lit(None).cast("string")
    return judged_flags(named).withColumns({"used_reference": F.lit(use_reference), "reference_output": reference, "raw_response_id": own}).select(*JUDGED)


def dimension_stats(df: DataFrame, winners: str = "dimension_winners", scores: str = "dimension_scores") -> DataFrame:
    """For each dimension: wins of each side, ties, and mean scores and their difference where both are there."""
    t = df.select(F.explode(F.map_entries(winners)).alias("w"), F.col(scores).alias("s")).select(F.col("w.key").alias("dimension"), F.col("w.value").alias("won"), F.try_element_at("s", F.col("w.key")).alias("s"))
    both = F.col("s.A_score").isNotNull() & F.col("s.B_score").isNotNull()
    a, b = F.when(both, F.col("s.A_score")), F.when(both, F.col("s.B_score"))
    return t.groupBy("dimension").agg(*[F.count_if(F.col("won") == w).alias(f"n_{w.lower()}") for w in ("A", "B", "tie")], F.sum(a).alias("a_sum"), F.sum(b).alias("b_sum"), F.count(a).alias("n_scored"), F.avg(b - a).alias("delta"))


def overall_stats(df: DataFrame, overall: str = "overall_scores") -> DataFrame:
    """One row: mean overall scores of each side and their difference, over the n_scored pairs where both are there (null if there are none)."""
    a, b = F.col(f"{overall}.A_score"), F.col(f"{overall}.B_score")
    both = df.where(a.isNotNull() & b.isNotNull())
    return both.agg(F.avg(a).alias("a_mean"), F.avg(b).alias("b_mean"), F.avg(b - a).alias("delta"), F.count("*").alias("n_scored"))


def compare_backends(pairs: DataFrame, flags: list[str], elapsed: str = "elapsed", length: str = "length") -> DataFrame:
    """One row over pairs of structs a and b: how many agree on each flag, mean seconds, their difference, and mean lengths with none as 0."""
    agree = [F.count_if(F.col(f"a.{f}").eqNullSafe(F.col(f"b.{f}"))).alias(f"same_{f}") for f in flags]
    return pairs.agg(F.count("*").alias("n"), *agree, F.avg(f"a.{elapsed}").alias("a_elapsed"), F.avg(f"b.{elapsed}").alias("b_elapsed"), F.avg(F.col(f"b.{elapsed}") - F.col(f"a.{elapsed}")).alias("elapsed_delta"), F.avg(F.coalesce(f"a.{length}", F.lit(0))).alias("a_length"), F.avg(F.coalesce(f"b.{length}", F.lit(0))).alias("b_length"))


def preference_rows(df: DataFrame, a: str = "candidate_a", b: str = "candidate_b") -> DataFrame:
    """Judged rows with a winner, with chosen, rejected and score_delta (winner's overall score above the other's; 0 if there are none); ties and others go."""
    won = F.col("winner") == "A"
    gap = F.coalesce((F.col("overall_scores.A_score") - F.col("overall_scores.B_score")).cast("double"), F.lit(0.0))
    return df.where(F.col("winner").isin("A", "B")).withColumns({"chosen": F.when(won, F.col(a)).otherwise(F.col(b)), "rejected": F.when(won, F.col(b)).otherwise(F.col(a)), "score_delta": F.when(won, gap).otherwise(-gap)})


def top_pairs(df: DataFrame, k: int, confidences: list[str], order: list[str], key: str = "sample_id") -> DataFrame:
    """The k best pairs of each prompt among those confident enough, by confidence and score_delta, then order. k >= 1."""
    if k < 1:
        raise ValueError("k is 1 at least")
    rank = F.when(F.col("winner_confidence") == "high", 2).when(F.col("winner_confidence") == "medium", 1).otherwise(0)
    return first_by(df.where(F.col("winner_confidence").isin(*confidences)), [F.col(key)], [rank.desc(), F.desc("score_delta"), *[F.col(c) for c in order]]).where(F.col("nth") <= k).drop("nth")


def restore_prompts(judged: DataFrame, prompts: DataFrame, key: str = "sample_id", fields=("system", "instruction", "input")) -> DataFrame:
    """Judged rows with the prompts' fields, '' where there is none."""
    p = prompts.select(F.col(key), *[F.col(f).alias(f"_{f}") for f in fields])
    return judged.drop(*fields).join(p, key, "left").select(*[c for c in judged.columns if c not in fields], *[F.coalesce(f"_{f}", F.lit("")).alias(f) for f in fields])


def judge_prompt(use_reference: bool = False) -> Column:
    """The text shown to a judge, from columns sample_id, system, prompt, a_label, a_output, b_label, b_output and reference_output."""
    system = F.coalesce(F.nullif(F.col("system"), F.lit("")), F.lit(K.JUDGE_NO_SYSTEM))
    side = lambda s: F.concat(F.lit(f"{K.JUDGE_CANDIDATE} {s.upper()} ("), F.col(f"{s}_label"), F.lit("):"))
    parts = [F.concat(F.lit(K.JUDGE_SAMPLE), F.col("sample_id")), F.concat(F.lit(K.JUDGE_SYSTEM), system), F.lit(K.JUDGE_TASK), F.col("prompt"), F.lit(""), side("a"), F.col("a_output"), F.lit(""), side("b"), F.col("b_output")]
    text = F.concat_ws("\n", *[F.coalesce(p, F.lit("")) for p in parts])
    if use_reference:
        text = F.concat_ws("\n\n", text, F.concat(F.lit(K.JUDGE_REFERENCE + "\n"), F.nullif(F.col("reference_output"), F.lit(""))))
    return text

