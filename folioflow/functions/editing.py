"""Small edits and views of a text, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import WS, trim_ws


def preview(c: Column) -> Column:
    """The text on one line: runs of white space as one blank."""
    return trim_ws(F.regexp_replace(c, f"[{WS}]+", " "))


def locate_reference(text: Column, label: Column) -> Column:
    """Where "[label]" first stands in a text, from 0; -1 if nowhere."""
    return F.instr(text, F.concat(F.lit("["), label, F.lit("]"))) - 1


def fix_reference(text: Column, label: Column, url: Column) -> Column:
    """The text with a definition of the label at its end; null for an empty address or one of several lines."""
    target = trim_ws(url)
    ok = (target != "") & ~target.rlike(r"[\r\n]")
    return F.when(ok, F.concat(F.regexp_replace(text, f"[{WS}]+\\z", ""), F.lit("\n\n["), label, F.lit("]: <"), target, F.lit(">")))


def truncated(c: Column, size: int) -> Column:
    """(value, truncated): the first characters, and whether there were more."""
    return F.struct(F.substring(c, 1, size).alias("value"), (F.length(c) > size).alias("truncated"))
