"""Column functions on text that fix one dialect: ASCII words, browser white space, code-point offsets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed value: the characters a browser takes for white space, for use inside a class.
WS = r"\t\n\x0B\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
PY_WS = "\t\n\x0b\f\r \u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
#: From how many characters on a text is small, medium and large.
SIZE_BUCKETS = ((1_000, "tiny"), (10_000, "small"), (100_000, "medium"))


def trim_ws(c: Column) -> Column:
    return F.regexp_replace(c, f"^[{WS}]+|[{WS}]+\\z", "")


def newline(c: Column) -> Column:
    """Line ends as "\\n" and no NUL."""
    return F.translate(F.regexp_replace(c, "\r\n?", "\n"), "\0", "")


def word_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(f"[^{WS}]+")).cast("bigint")


def line_count(c: Column) -> Column:
    return F.when(F.length(c) > 0, F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit(""))) + 1).otherwise(0).cast("bigint")


def line_of(text: Column, start: Column) -> Column:
    """The line, from 1, of an offset: the last line start at or before it."""
    head = F.substring(text, F.lit(1), start.cast("int"))
    return (F.length(head) - F.length(F.replace(head, F.lit("\n"), F.lit(""))) + 1).cast("int")


def utf16_length(c: Column) -> Column:
    """Length in UTF-16 units: characters beyond the basic plane count twice."""
    return (F.length(c) + F.regexp_count(c, F.lit(r"[\x{10000}-\x{10FFFF}]"))).cast("int")


def size_bucket(length: Column) -> Column:
    out = None
    for limit, name in SIZE_BUCKETS:
        out = F.when(length < limit, name) if out is None else out.when(length < limit, name)
    return out.otherwise("large")


def matches(text: Column, pattern: str) -> Column:
    """Array of (start_pos, value) of the matches of a pattern; one pass over each text, as a running offset in columns would copy the list for each match."""
    import re

    @F.udf(T.ArrayType(T.StructType([T.StructField("start_pos", T.IntegerType()), T.StructField("value", T.StringType())])), useArrow=True)
    def run(t):
        return None if t is None else [(m.start(), m[0]) for m in re.finditer(pattern, t)]

    return run(text)


def fingerprint_batch(texts: list[str | None]) -> list[str | None]:
    """length:base36:base36 of each text: two 32-bit lanes over its UTF-16 units.

    Lanes depend on all units before, but not on other texts: the texts of a
    batch advance together, one unit at a time, longest first, as numpy rows.
    The last few long ones are finished alone.
    """
    import numpy as np

    # Seeds and multipliers of the lanes.
    seed_a, seed_b, times_a, times_b = 0x811C9DC5, 0x9E3779B9, 0x01000193, 0x85EBCA6B
    units = [None if t is None else np.frombuffer(t.encode("utf-16-le", "surrogatepass"), np.uint16) for t in texts]
    order = sorted((i for i, u in enumerate(units) if u is not None), key=lambda i: -len(units[i]))
    lengths = np.array([len(units[i]) for i in order], np.int64)
    a, b = np.full(len(order), seed_a, np.uint32), np.full(len(order), seed_b, np.uint32)
    ma, mb = np.uint32(times_a), np.uint32(times_b)
    step, block, few = 0, 512, 4
    while len(order) and step < lengths[0]:
        live = int(np.searchsorted(-lengths, -step, side="left"))
        if live <= few:
            break
        width = min(block, int(lengths[0]) - step)
        rows = np.zeros((width, live), np.uint32)
        for k in range(live):
            part = units[order[k]][step : step + width]
            rows[: len(part), k] = part
        for j in range(width):
            n = live if lengths[live - 1] > step + j else int(np.searchsorted(-lengths[:live], -(step + j), side="left"))
            if not n:
                break
            x, p, q = rows[j, :n], a[:n], b[:n]
            p ^= x
            p *= ma
            q ^= x + np.uint32((step + j) & 0xFFFFFFFF)
            q *= mb
        step += width
    for k in range(len(order)):
        if lengths[k] <= step:
            break
        p, q = int(a[k]), int(b[k])
        for i, x in enumerate(units[order[k]][step:].tolist(), step):
            p = (p ^ x) * times_a & 0xFFFFFFFF
            q = (q ^ (x + i & 0xFFFFFFFF)) * times_b & 0xFFFFFFFF
        a[k], b[k] = p, q
    out: list[str | None] = [None] * len(texts)
    for k, i in enumerate(order):
        out[i] = f"{lengths[k]}:{np.base_repr(int(a[k]), 36).lower()}:{np.base_repr(int(b[k]), 36).lower()}"
    return out


def fingerprint(c: Column) -> Column:
    """The fingerprint of a text column; Arrow batches of whole texts, as the lanes are faster in step than in a JVM fold."""

    @F.pandas_udf("string")
    def of(texts):
        import pandas as pd

        return pd.Series(fingerprint_batch([None if t is None else t for t in texts]), index=texts.index, dtype=object)

    return of(c)
