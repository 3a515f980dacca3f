"""Readers that give every row its place: src_idx, the file's number, and src_line."""

from __future__ import annotations

import os
import re
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import contracts as K
from ..functions.text import is_blank, ordinal_id, strip
from ..operators.curate import numbered


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_lines(spark: SparkSession, paths: list[str], missing_ok: bool = False) -> DataFrame:
    """(value, src_idx, src_file, src_line): non-blank lines of files; lines count from 1 and blank ones are counted.

    A file is read whole, as a line's number depends on all lines before it; use read_jsonl for files too large for that.
    """
    if missing_ok:
        paths = [p for p in paths if exists(spark, p)]
    out = None
    for i, p in enumerate(paths):
        t = spark.read.text(p, wholetext=True).select(F.posexplode(F.split("value", "\r\n|\r|\n")).alias("pos", "value"), F.lit(i).alias("src_idx"), F.lit(p).alias("src_file"))
        t = t.select("value", "src_idx", "src_file", (F.col("pos") + 1).cast("long").alias("src_line")).where(~is_blank(F.col("value")))
        out = t if out is None else out.unionByName(t)
    return spark.createDataFrame([], "value string, src_idx int, src_file string, src_line long") if out is None else out


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON object a line, in parallel; rows that don't parse are nulls."""
    return spark.read.schema(schema).json(path)


def read_records(spark: SparkSession, paths: list[str], schema: str, missing_ok: bool = False) -> DataFrame:
    """Lines parsed with a declared schema, with the raw text and their place."""
    lines = read_lines(spark, paths, missing_ok)
    return lines.select("src_idx", "src_file", "src_line", F.col("value").alias("raw"), F.from_json("value", schema).alias("r")).select("src_idx", "src_file", "src_line", "raw", "r.*")


def read_json_array(spark: SparkSession, path: str, schema: str, allow_empty: bool = True) -> DataFrame:
    """Items of a file that is one JSON array, with src_line from 1. ValueError if it isn't an array, or has no items unless they may lack."""
    text = spark.read.text(path, wholetext=True).select(strip(F.col("value")).alias("v"))
    if text.where(~F.col("v").startswith("[") | F.try_parse_json("v").isNull()).limit(1).count():
        raise ValueError(f"{path} isn't a JSON array")
    out = text.select(F.posexplode(F.from_json("v", f"array<struct<{schema}>>")).alias("pos", "r")).select((F.col("pos") + 1).cast("long").alias("src_line"), "r.*")
    if not allow_empty and out.isEmpty():
        raise ValueError(f"{path} has no items")
    return out


def read_dataset(spark: SparkSession, path: str, schema: str, most: int = 0) -> DataFrame:
    """JSON lines or a JSON array by the file's suffix; the first most rows, or all if most <= 0."""
    df = read_records(spark, [path], schema).drop("src_idx", "src_file", "raw") if path.endswith(".jsonl") else read_json_array(spark, path, schema)
    return df.orderBy("src_line").limit(most) if most > 0 else df


def read_keyed(spark: SparkSession, path: str, schema: str, key: str = "sample_id") -> DataFrame:
    """Records by key; of several with a key the last line holds."""
    from ..operators.evaluate import last_by_key

    return last_by_key(read_records(spark, [path], schema), key, ["src_line"])


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    """(value, src_line): blocks of a malformed array of objects, split where one object ends and the next begins, without outer braces."""
    t = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", r"\n  \},\n  \{\n")).alias("pos", "value"))
    return t.select(F.regexp_replace("value", r"^\s*\[?\s*\{\n?|\n?\s*\}\s*\]?\s*$", "").alias("value"), (F.col("pos") + 1).cast("long").alias("src_line"))


def read_seeds(records: DataFrame, order: list[str], category: str | None = None, most: int = 0) -> DataFrame:
    """Records of a category, the first most of them, then numbered from 0 as seed_id."""
    if category:
        records = records.where(F.col("output.category") == category)
    return numbered(records.orderBy(*order).limit(most) if most > 0 else records, order, "seed_id")


def with_sample_ids(df: DataFrame, ordinal: str, prefix: str = "train") -> DataFrame:
    """sample_id, or <prefix>_<1-based ordinal, three digits> where it is null, empty or no column."""
    own = F.nullif(F.col("sample_id"), F.lit("")) if "sample_id" in df.columns else F.lit(None).cast("string")
    return df.withColumn("sample_id", F.coalesce(own, ordinal_id(prefix, F.col(ordinal))))


def count_lines(spark: SparkSession, path: str) -> int:
    """Non-blank lines; 0 for a file that isn't there."""
    return spark.read.text(path).where(~is_blank(F.col("value"))).count() if exists(spark, path) else 0


def scalar(text: str):
    """A flat configuration's value: null, true or false, quoted, integer, decimal, else text."""
    text = text.strip()
    if text.lower() in ("null", "~", ""):
        return None
    if text.lower() in ("true", "false"):
        return text.lower() == "true"
    if len(text) >= 2 and text[0] == text[-1] and text[0] in "\"'":
        return text[1:-1]
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            continue
    return text


def read_flat_yaml(path: str) -> dict:
    """`key: value` lines; blank lines and comments are skipped, a line without a colon is an error."""
    out = {}
    for n, line in enumerate(Path(path).read_text(encoding="utf-8").splitlines(), 1):
        if not line.strip() or line.lstrip().startswith("#"):
            continue
        k, colon, v = line.partition(":")
        if not colon:
            raise ValueError(f"line {n}: no colon")
        out[k.strip()] = scalar(v)
    return out


def read_env(path: str, paired_quotes: bool = True, into=os.environ) -> None:
    """KEY=value lines into the environment, where a key isn't set yet. Quotes go if they are a pair, or any if not paired_quotes."""
    if not Path(path).exists():
        return
    for line in Path(path).read_text(encoding="utf-8").splitlines():
        k, eq, v = line.strip().removeprefix("export ").partition("=")
        if not eq or k.startswith("#"):
            continue
        v = v.strip()
        if not paired_quotes:
            v = v.strip("\"'")
        elif len(v) >= 2 and v[0] == v[-1] and v[0] in "\"'":
            v = v[1:-1]
        into.setdefault(k.strip(), v)


def env_first(*names: str, default: str | None = None, env=os.environ) -> str | None:
    """The first of these variables that isn't empty."""
    return next((env[n] for n in names if env.get(n)), default)


def variant_spec(spec: str, root: str = ".") -> dict:
    """name=config[@eval data], paths from root."""
    m = re.fullmatch(r"([^=@]+)=([^@]+)(?:@(.+))?", spec)
    if not m:
        raise ValueError(f"bad variant: {spec}")
    at = lambda p: p if p is None or os.path.isabs(p) else os.path.join(root, p)
    return {"name": m[1].strip(), "config": at(m[2].strip()), "eval_data": at(m[3] and m[3].strip())}


def runtime_overrides(config: dict) -> dict:
    """A flat configuration whose device_map names one device, as the map that a model's loader takes for it; others stay as they are."""
    name = config.get("device_map")
    name = name.strip().lower() if isinstance(name, str) else None
    return {**config, "device_map": {"": K.DEVICES[name]}} if name in K.DEVICES else dict(config)


def label_of(path: str) -> str:
    """A result file's label: its name without _results.jsonl, or without its suffix."""
    name = path.rstrip("/").rpartition("/")[2]
    return name.removesuffix("_results.jsonl") if name.endswith("_results.jsonl") else name.rpartition(".")[0] or name
