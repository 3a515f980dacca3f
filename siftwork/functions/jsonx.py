"""JSON functions: strict parsing, for which no built-in is strict enough, and printing."""

from __future__ import annotations

import json
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType

STRICT = "struct<ok:boolean, error:string, keys:array<string>, scalars:map<string,string>, kinds:map<string,string>, sizes:map<string,int>>"
_NAMES = {dict: "dict", list: "list", str: "str", int: "int", float: "float", bool: "bool", type(None): "NoneType"}


def parse_strict(text: str | None) -> tuple:
    """(ok, error, keys, text values, kinds, list sizes) of a text that must be one JSON object and nothing else."""
    try:
        got = json.loads((text or "").strip())
    except json.JSONDecodeError as e:
        return False, f"{e.msg} at line {e.lineno} column {e.colno}", [], {}, {}, {}
    except (RecursionError, ValueError) as e:
        return False, f"{type(e).__name__}", [], {}, {}, {}
    if not isinstance(got, dict):
        return False, f"Top-level JSON is {_NAMES[type(got)]}, expected object", [], {}, {}, {}
    got = {_whole(k): _whole(v) if isinstance(v, str) else v for k, v in got.items()}
    return True, None, list(got), {k: v for k, v in got.items() if isinstance(v, str)}, {k: _NAMES[type(v)] for k, v in got.items()}, {k: len(v) for k, v in got.items() if isinstance(v, list)}


def _whole(text: str) -> str:
    r"""A text that can be stored: JSON may hold lone surrogates ("\ud800"), which have no UTF-8; each becomes a question mark."""
    return text.encode("utf-8", "replace").decode()


def strict_json(c: Column) -> Column:
    """parse_strict of a text column, an Arrow batch at a time; bytes that aren't UTF-8 count as U+FFFD. A text met again in a batch isn't parsed again."""
    kind = pa.struct([("ok", pa.bool_()), ("error", pa.string()), ("keys", pa.list_(pa.string())), ("scalars", pa.map_(pa.string(), pa.string())), ("kinds", pa.map_(pa.string(), pa.string())), ("sizes", pa.map_(pa.string(), pa.int32()))])

    @F.arrow_udf(STRICT)
    def parse(texts: pa.Array) -> pa.Array:
        known = lru_cache(1024)(parse_strict)
        rows = [known(None if x is None else x.decode("utf-8", "replace")) for x in texts.cast(pa.large_binary()).to_pylist()]
        return pa.array([{"ok": ok, "error": e, "keys": keys, "scalars": list(s.items()), "kinds": list(k.items()), "sizes": list(n.items())} for ok, e, keys, s, k, n in rows], kind)

    return parse(c)


def quoted(c: Column) -> Column:
    """A JSON string."""
    return F.regexp_replace(F.regexp_replace(F.to_json(F.struct(c.alias("x"))), r'^\{"x":', ""), r"\}$", "")


def pretty(c: Column, kind, depth: int = 0) -> Column:
    """c printed with an indent of two spaces, `"k": v`, an item a line and non-ASCII text as it is; nulls are written."""
    pad, end = "  " * (depth + 1), "  " * depth
    if isinstance(kind, StructType):
        fields = [F.concat(F.lit(f'{pad}{json.dumps(f.name, ensure_ascii=False)}: '), pretty(c.getField(f.name), f.dataType, depth + 1)) for f in kind.fields]
        body = F.concat(F.lit("{\n"), F.concat_ws(",\n", *fields), F.lit(f"\n{end}}}")) if fields else F.lit("{}")
    elif isinstance(kind, ArrayType):
        items = F.transform(c, lambda x: F.concat(F.lit(pad), pretty(x, kind.elementType, depth + 1)))
        body = F.when(F.size(c) == 0, "[]").otherwise(F.concat(F.lit("[\n"), F.array_join(items, ",\n"), F.lit(f"\n{end}]")))
    elif isinstance(kind, MapType):
        entries = F.transform(F.map_entries(c), lambda e: F.concat(F.lit(pad), quoted(e["key"]), F.lit(": "), pretty(e["value"], kind.valueType, depth + 1)))
        body = F.when(F.size(c) == 0, "{}").otherwise(F.concat(F.lit("{\n"), F.array_join(entries, ",\n"), F.lit(f"\n{end}}}")))
    elif kind.simpleString() == "string":
        body = quoted(c)
    else:
        body = c.cast("string")
    return F.when(c.isNull(), "null").otherwise(body)


def array_literal(c: Column) -> Column:
    """The non-blank items, stripped, of an array literal; an empty array if it can't be parsed."""
    from .text import strip

    items = F.coalesce(F.from_json(c, "array<string>"), F.array().cast("array<string>"))
    return F.filter(F.transform(items, strip), lambda x: x != "")
