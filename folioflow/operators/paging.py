"""Bounded pages of texts and of lists."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .batches import map_batches

# Bounds of what one call returns.
PAGE_CHARACTERS, PAGE_JSON, PAGE_ITEMS, CURSOR_MAX = 1000, 1400, 2, 500_000


def text_cursors(df: DataFrame, id_col: str, text_col: str, characters: int = PAGE_CHARACTERS) -> DataFrame:
    """Pages of a fixed number of characters: (doc_id, page_no, cursor, next_cursor, total, text); an empty text is one empty page."""
    src = df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    # All pages of a text by one pass over it; a substring for each would begin at the text's start each time.
    pages = F.posexplode_outer(F.regexp_extract_all("t", F.lit(f"(?s).{{1,{characters}}}"), F.lit(0))).alias("page_no", "text")
    pages = src.select("doc_id", F.length("t").alias("total"), pages).na.fill({"page_no": 0, "text": ""})
    pages = pages.withColumn("cursor", F.col("page_no") * characters)
    end = F.col("cursor") + characters
    return pages.select("doc_id", "page_no", "cursor", F.when(end < F.col("total"), end).alias("next_cursor"), "total", "text")


def _json_length(value) -> int:
    """Length in UTF-16 units of what a browser writes for a value."""
    s = json.dumps(value, ensure_ascii=False, separators=(",", ":"))
    return len(s) + sum(ord(c) > 0xFFFF for c in s)


def page_at(text: str, cursor: int, mode: str, characters: int = PAGE_CHARACTERS, budget: int = PAGE_JSON) -> dict:
    """The page from a cursor: the longest whose JSON is within the budget, and one character at least."""

    def page(end: int) -> dict:
        return {"text": text[cursor:end], "cursor": cursor, "nextCursor": end if end < len(text) else None, "totalCharacters": len(text), "mode": mode}

    lo, hi = cursor, min(cursor + characters, len(text))
    if _json_length(page(hi)) <= budget:
        return page(hi)
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if _json_length(page(mid)) <= budget else (lo, mid - 1)
    return page(max(lo, min(cursor + 1, len(text))))


def text_pages(df: DataFrame, id_col: str, text_col: str, mode: str = "ai") -> DataFrame:
    """All pages of each text within the character and the JSON bound, in order."""
    src = df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))

    def pages(r) -> Iterator[tuple]:
        cursor, n = 0, 0
        while cursor is not None:
            p = page_at(r["t"], cursor, mode)
            yield r["doc_id"], n, cursor, p["nextCursor"], p["totalCharacters"], p["text"]
            cursor, n = p["nextCursor"], n + 1

    ints = [T.StructField(x, T.IntegerType()) for x in ("page_no", "cursor", "next_cursor", "total")]
    return map_batches(src, pages, T.StructType([src.schema["doc_id"], *ints, T.StructField("text", T.StringType())]))


def truncate_json(value: str, characters: int, budget: int) -> tuple[str, bool]:
    """A value cut to a number of characters and to the length of its JSON string; and whether it was cut."""
    lo, hi = 0, min(len(value), characters)
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if _json_length(value[:mid]) <= budget else (lo, mid - 1)
    return value[:lo], lo < len(value)


def item_pages(items: DataFrame, key: str, order: list, size: int = PAGE_ITEMS) -> DataFrame:
    """Adds item_no, page_no, next_cursor (null on the last page) and total to the items of each document."""
    w = Window.partitionBy(key)
    numbered = items.withColumn("item_no", F.row_number().over(w.orderBy(*order)) - 1).withColumn("total", F.count("*").over(w).cast("int"))
    end = (F.floor(F.col("item_no") / size) + 1) * size
    return numbered.withColumn("page_no", F.floor(F.col("item_no") / size).cast("int")).withColumn("next_cursor", F.when(end < F.col("total"), end).cast("int"))


def finding_projection(findings: DataFrame) -> DataFrame:
    """What may be shown of findings: neither value nor place."""
    return findings.select(
        "handoff_id", "id", F.col("finding_type").alias("type"), "severity", F.substring("title", 1, 100).alias("title"), F.substring("detail", 1, 180).alias("detail"),
        "line", F.substring("placeholder", 1, 60).alias("placeholder"), F.col("origin").alias("source"), "confidence",
    )
