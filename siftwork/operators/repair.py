"""Repair of malformed seed blocks and filling of missing fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import contracts as K
from ..functions.jsonx import array_literal
from ..functions.text import field_line, mapped, one_of, strip, tidy, tidy_list, unquote


def by_category(table: dict, category: Column, oom: Column, no_version: Column | None = None) -> Column:
    """The table's value for a category, with its special cases; deployment's for any other."""
    val = lambda x: F.array(*map(F.lit, x)) if isinstance(x, tuple) else F.lit(x)
    case = F.when((category == "training") & oom, val(table.get("training/oom", table["training"])))
    if no_version is not None:
        case = case.when((category == "dependency") & no_version, val(table["dependency/no version"]))
    for name in K.CATEGORIES[:-1]:
        case = case.when(category == name, val(table[name]))
    return case.otherwise(val(table[K.CATEGORIES[-1]]))


def clean_record(df: DataFrame) -> DataFrame:
    """Records with strings tidied, category and severity mapped, and empty fields filled from their category; other columns stay."""
    log, env = F.lower(F.coalesce(F.col("input.log"), F.lit(""))), F.lower(F.coalesce(F.col("input.environment"), F.lit("")))
    oom = log.contains("out of memory") | log.contains("oom")
    category = mapped(strip(F.col("output.category")), K.CATEGORY_MAP, "training")
    missing, steps = tidy_list(F.col("output.missing_info")), tidy_list(F.col("output.next_steps"))
    summary, root = tidy(F.col("output.summary")), tidy(F.col("output.root_cause"))
    return df.withColumns({
        "instruction": F.lit(K.INSTRUCTION),
        "input": F.struct(F.rtrim(strip(F.coalesce("input.user_question", F.lit(""))), F.lit("。")).alias("user_question"), *[strip(F.coalesce(f"input.{k}", F.lit(""))).alias(k) for k in ("environment", "command", "log")]),
        "output": F.struct(
            category.alias("category"), one_of(F.col("output.severity"), K.SEVERITIES, "medium").alias("severity"),
            F.when(summary == "", by_category(K.SUMMARIES, category, oom)).otherwise(summary).alias("summary"),
            F.when(root == "", by_category(K.ROOT_CAUSES, category, oom)).otherwise(root).alias("root_cause"),
            F.when(F.size(missing) == 0, by_category(K.MISSING_INFO, category, oom, ~env.contains("version"))).otherwise(missing).alias("missing_info"),
            F.when(F.size(steps) == 0, by_category(K.NEXT_STEPS, category, oom)).otherwise(steps).alias("next_steps"),
        ),
    })


def parse_blocks(blocks: DataFrame, text: str = "value") -> DataFrame:
    """Records from malformed blocks, a key a line; what isn't there is empty."""
    t = F.col(text)
    scalar = lambda k: unquote(field_line(t, k)).alias(k)
    return blocks.withColumns({
        "instruction": unquote(field_line(t, "instruction")),
        "input": F.struct(*[scalar(k) for k in K.DIAGNOSIS.inputs]),
        "output": F.struct(*[scalar(k) for k in ("category", "severity", "summary", "root_cause")], *[array_literal(field_line(t, k)).alias(k) for k in K.DIAGNOSIS.lists]),
    })
