"""Writers: JSON lines, small ordered JSON files, quarantines, manifests and the dataset catalog."""

from __future__ import annotations

import json
import tempfile
import time
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the folder that driver and executors share (spark.checkpoint.dir); where that is unset, in a temporary one of a local session."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        shared = "file://" + tempfile.mkdtemp()
    return f"{shared.rstrip('/')}/siftwork-{label}-{uuid.uuid4().hex}"


def write_jsonl(df: DataFrame, path: str, append: bool = False) -> None:
    """A folder of JSON lines, nulls written."""
    df.write.mode("append" if append else "overwrite").option("ignoreNullFields", "false").json(path)


def write_lines_file(lines: DataFrame, path: str, order: str, value: str = "value") -> str:
    """One text file at path, in any store, of a small frame's values in order; gives path."""
    spark, stage = lines.sparkSession, f"{path}__staged"
    lines.repartition(1).sortWithinPartitions(order).select(value).write.mode("overwrite").text(stage)
    of = spark._jvm.org.apache.hadoop.fs.Path
    fs = of(stage).getFileSystem(spark._jsc.hadoopConfiguration())
    (part,) = [s.getPath() for s in fs.listStatus(of(stage)) if s.getPath().getName().startswith("part-")]
    fs.mkdirs(of(path).getParent())
    fs.delete(of(path), False)
    if not fs.rename(part, of(path)):
        raise OSError(f"{path} couldn't be written")
    fs.delete(of(stage), True)
    return path


def write_routed(df: DataFrame, kept_path: str, rejected_path: str) -> None:
    """Kept and rejected rows of a frame with reasons, from one table written first."""
    from ..operators.curate import route

    stage = f"{kept_path.rstrip('/')}__staged"
    df.write.mode("overwrite").parquet(stage)
    kept, rejected = route(df.sparkSession.read.schema(df.schema).parquet(stage))
    write_jsonl(kept, kept_path)
    write_jsonl(rejected, rejected_path)


def write_json_array(df: DataFrame, path: str, order: list[str]) -> int:
    """One JSON array in one local file, in order, a row at a time; for small outputs."""
    n = 0
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        f.write("[")
        for row in df.orderBy(*order).toLocalIterator():
            f.write((",\n" if n else "\n") + json.dumps(row.asDict(recursive=True), ensure_ascii=False, indent=2))
            n += 1
        f.write("\n]\n")
    return n


def write_both(df: DataFrame, jsonl_path: str, array_path: str, order: list[str]) -> int:
    """The same rows, read once, as JSON lines and as one JSON array in order; gives their number. The array is for small outputs."""
    stage = f"{jsonl_path.rstrip('/')}__staged"
    df.write.mode("overwrite").parquet(stage)
    rows = df.sparkSession.read.schema(df.schema).parquet(stage)
    write_jsonl(rows, jsonl_path)
    return write_json_array(rows, array_path, order)


def write_log(df: DataFrame, path: str, error: str = "error") -> None:
    """Rows whose error isn't null, appended to a folder of JSON lines."""
    write_jsonl(df.where(df[error].isNotNull()), path, append=True)


def backed_up_text(path: str, backup: str) -> str:
    """A small local file's text as it was first seen: of its backup, which is made if it isn't there and never written again."""
    p, b = Path(path), Path(backup)
    if not b.exists():
        if not p.exists():
            raise FileNotFoundError(path)
        b.parent.mkdir(parents=True, exist_ok=True)
        b.write_bytes(p.read_bytes())
    return b.read_text(encoding="utf-8")


def write_manifest(report: DataFrame | dict, path: str, **parameters) -> dict:
    """A one-row report, or a dict, and the parameters it was made with."""
    got = report if isinstance(report, dict) else report.first().asDict(recursive=True)
    out = {**got, **parameters}
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(out, ensure_ascii=False, indent=2, default=str) + "\n", encoding="utf-8")
    return out


def update_catalog(path: str, entries: dict) -> dict:
    """The catalog with these entries added or replaced; others stay."""
    p = Path(path)
    have = json.loads(p.read_text(encoding="utf-8")) if p.exists() else {}
    return write_manifest({**have, **entries}, path)


def run_folder(root: str, label: str) -> str:
    path = Path(root) / f"{label}_{time.strftime('%Y%m%d_%H%M%S')}"
    path.mkdir(parents=True, exist_ok=True)
    return str(path)


def archive(paths: list[str], to: str) -> list[str]:
    """Moves files that are there into a folder, over what has their name; gives what was moved."""
    Path(to).mkdir(parents=True, exist_ok=True)
    moved = []
    for p in map(Path, paths):
        if p.exists():
            p.replace(Path(to) / p.name)
            moved.append(str(p))
    return moved
