"""Text functions as Column builders."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..contracts import BOILERPLATE, PHRASES

#: White space as Python's strip() and split() see it.
_SPACE = r"[\s\x1c-\x1f]"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, rf"(?U)^{_SPACE}+|{_SPACE}+$", "")


def is_blank(c: Column) -> Column:
    """True for null and for white space only."""
    return F.coalesce(strip(c) == "", F.lit(True))


def collapse(c: Column) -> Column:
    """Runs of white space, line ends among them, as one space; none at the ends."""
    return strip(F.regexp_replace(c, rf"(?U){_SPACE}+", " "))


def rewrite(c: Column, phrases=PHRASES) -> Column:
    """Literal replacements one after the other: a later phrase sees what an earlier one has left."""
    return reduce(lambda x, p: F.replace(x, F.lit(p[0]), F.lit(p[1])), phrases, c)


def tidy(c: Column, phrases=PHRASES) -> Column:
    """A cleaned sentence: white space collapsed, phrases rewritten, doubled commas joined, ends trimmed, a full stop at the end. Null and empty: ''."""
    x = rewrite(collapse(F.coalesce(c, F.lit(""))), phrases)
    x = F.regexp_replace(F.regexp_replace(x, "，+", "，"), "、+", "、")
    x = F.regexp_replace(x, "^[ ，。]+|[ ，。]+$", "")
    return F.when(x == "", "").when(F.right(x, F.lit(1)).isin("。", ".", "!", "?"), x).otherwise(F.concat(x, F.lit("。")))


def tidy_list(c: Column, boilerplate=BOILERPLATE) -> Column:
    """Tidied items without blanks, boilerplate and repeats, in order of first occurrence; null: an empty array."""
    done = F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: tidy(x))
    return F.array_distinct(F.filter(done, lambda x: (x != "") & ~x.isin(*boilerplate)))


def contains_any(c: Column, needles) -> Column:
    return F.coalesce(reduce(lambda a, b: a | b, [F.contains(c, F.lit(n)) for n in needles]), F.lit(False))


def count_found(c: Column, needles) -> Column:
    """How many of the needles occur."""
    return sum((F.coalesce(F.contains(c, F.lit(n)), F.lit(False)).cast("int") for n in needles), F.lit(0))


def flatten(*columns: Column) -> Column:
    """Scalars and arrays of text in one text, a line each; nulls are left out."""
    return F.concat_ws("\n", *columns)


def field_line(block: Column, key: str) -> Column:
    r"""The value on the first line `"key": value` of a malformed block, without a trailing comma; '' if there is none."""
    return F.regexp_extract(block, rf'(?m)^\s*"{key}":\s*(.*?)\s*,?\s*$', 1)


def unquote(c: Column) -> Column:
    r"""A value without its quotes, \" and then \\ unescaped."""
    x = F.regexp_replace(c, '^"|"$', "")
    return F.replace(F.replace(x, F.lit('\\"'), F.lit('"')), F.lit("\\\\"), F.lit("\\"))


def ordinal_id(prefix: str, ordinal: Column) -> Column:
    return F.format_string(f"{prefix}_%03d", ordinal)


def mapped(c: Column, table: dict[str, str], default: str) -> Column:
    pairs = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(F.try_element_at(pairs, c), F.lit(default))


def one_of(c: Column, allowed, default: str) -> Column:
    x = F.lower(strip(c))
    return F.when(x.isin(*allowed), x).otherwise(F.lit(default))


def prompt(instruction: Column, text: Column) -> Column:
    """Instruction and input on lines of their own, or the one that isn't blank."""
    return F.concat_ws("\n", F.nullif(strip(instruction), F.lit("")), F.nullif(strip(text), F.lit("")))
