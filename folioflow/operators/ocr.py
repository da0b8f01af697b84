"""Recognised words of pages: running text with offsets, boxes, suggestions for redaction, and checks of the result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .spans import alias_key

# Padding of a box, least side of a drawn box, greatest raster side, and the confidence that warns.
PAD, LEAST_SIDE, RASTER_MAX, LOW_CONFIDENCE = 0.004, 0.004, 1800, 55


def mapped_words(words: DataFrame) -> DataFrame:
    """Visible words with their offsets in the text of their page: blanks between words, a line end between lines."""
    visible = words.withColumn("text", F.trim("text")).filter("text <> ''").dropDuplicates(["doc_id", "page", "line", "pos"])
    order = Window.partitionBy("doc_id", "page").orderBy("line", "pos")
    upto = F.sum(F.length("text") + 1).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return visible.withColumn("end_pos", (upto - 1).cast("int")).withColumn("start_pos", (F.col("end_pos") - F.length("text")).cast("int"))


def page_text(words: DataFrame) -> DataFrame:
    """(doc_id, page, text) of recognised pages."""
    visible = words.withColumn("text", F.trim("text")).filter("text <> ''").dropDuplicates(["doc_id", "page", "line", "pos"])
    lines = visible.groupBy("doc_id", "page", "line").agg(F.array_join(F.sort_array(F.collect_list(F.struct("pos", "text"))).getField("text"), " ").alias("t"))
    return lines.groupBy("doc_id", "page").agg(F.array_join(F.sort_array(F.collect_list(F.struct("line", "t"))).getField("t"), "\n").alias("text"))


def _unit(c: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))


def unit_boxes(words: DataFrame) -> DataFrame:
    """Adds x, y, width and height in shares of the image; words without area or image are left out."""
    ok = words.filter("image_width > 0 AND image_height > 0")
    x0, x1 = (_unit(F.col(c) / F.col("image_width")) for c in ("x0", "x1"))
    y0, y1 = (_unit(F.col(c) / F.col("image_height")) for c in ("y0", "y1"))
    zero = F.lit(0.0)
    return ok.withColumns({"x": x0, "y": y0, "width": F.greatest(zero, x1 - x0), "height": F.greatest(zero, y1 - y0)}).filter("width > 0 AND height > 0")


def upright(x: Column, y: Column, width: Column, height: Column) -> Column:
    """A box with positive sides within the image, whichever way it was drawn."""
    left, right = _unit(F.least(x, x + width)), _unit(F.greatest(x, x + width))
    top, bottom = _unit(F.least(y, y + height)), _unit(F.greatest(y, y + height))
    return F.struct(left.alias("x"), top.alias("y"), (right - left).alias("width"), (bottom - top).alias("height"))


def line_boxes(words: DataFrame, keys: list[str]) -> DataFrame:
    """The padded union of the boxes of each group; words need x, y, width and height."""
    box = words.groupBy(*keys).agg(F.min("x").alias("l"), F.min("y").alias("t"), F.max(F.col("x") + F.col("width")).alias("r"), F.max(F.col("y") + F.col("height")).alias("b"))
    u = upright(F.col("l") - PAD, F.col("t") - PAD, F.col("r") - F.col("l") + 2 * PAD, F.col("b") - F.col("t") + 2 * PAD)
    return box.select(*keys, u.alias("u")).select(*keys, "u.*")


def suggestions(findings: DataFrame, words: DataFrame) -> DataFrame:
    """(doc_id, page, id, line, x, y, width, height): a box per line for each finding on a recognised page.

    Findings and words meet by page and overlapping spans; words come from ``mapped_words``.
    """
    boxed = unit_boxes(words)
    on = (F.col("f.doc_id") == F.col("w.doc_id")) & (F.col("f.page") == F.col("w.page")) & (F.col("w.start_pos") < F.col("f.end_pos")) & (F.col("f.start_pos") < F.col("w.end_pos"))
    met = findings.alias("f").join(boxed.alias("w"), on).select("f.doc_id", "f.page", "f.id", "w.line", "w.x", "w.y", "w.width", "w.height")
    return line_boxes(met, ["doc_id", "page", "id", "line"])


def redaction_boxes(suggested: DataFrame, selected: DataFrame, drawn: DataFrame) -> DataFrame:
    """Boxes of the selected suggestions and the drawn ones with sides of at least LEAST_SIDE."""
    chosen = suggested.join(selected.select("doc_id", "id").distinct(), ["doc_id", "id"], "left_semi").select("doc_id", "x", "y", "width", "height")
    u = drawn.filter((F.abs("width") >= LEAST_SIDE) & (F.abs("height") >= LEAST_SIDE)).select("doc_id", upright(*(F.col(c) for c in ("x", "y", "width", "height"))).alias("u"))
    return chosen.unionByName(u.select("doc_id", "u.*")).filter("width > 0 AND height > 0")


def pixel_boxes(boxes: DataFrame, width: Column, height: Column) -> DataFrame:
    """Whole pixels that cover each box, one at least."""
    left, top = F.floor(F.col("x") * width), F.floor(F.col("y") * height)
    right, bottom = F.ceil((F.col("x") + F.col("width")) * width), F.ceil((F.col("y") + F.col("height")) * height)
    one = F.lit(1).cast("bigint")
    return boxes.withColumns({"left": left, "top": top, "px_width": F.greatest(one, right - left), "px_height": F.greatest(one, bottom - top)})


def raster_scale(width: Column, height: Column, least: float = 0.0, most: float = 1.0) -> Column:
    """How an image is scaled for recognition: never beyond ``most``, its longest side within RASTER_MAX."""
    return F.greatest(F.lit(least), F.least(F.lit(most), F.lit(RASTER_MAX) / F.greatest(width, height)))


def comparable(c: Column) -> Column:
    """Letters and digits only, in compatibility form and small letters."""
    return F.regexp_replace(alias_key(c), r"[^\p{L}\p{N}]+", "")


def verification(pages: DataFrame, findings: DataFrame, values: DataFrame) -> DataFrame:
    """(doc_id, remaining, titles, still_visible, has_text, passed) after a redacted image was read again.

    ``pages``: doc_id, text. ``findings``: doc_id, title, start_pos of what was found now. ``values``: doc_id, value of what was selected.
    """
    text = pages.select("doc_id", comparable(F.col("text")).alias("body"), F.coalesce(F.trim("text") != "", F.lit(False)).alias("has_text"))
    seen = values.select("doc_id", comparable(F.col("value")).alias("v")).filter("length(v) >= 3").join(text, "doc_id").filter("contains(body, v)")
    seen = seen.groupBy("doc_id").agg(F.count("*").alias("still_visible"))
    first = findings.groupBy("doc_id", "title").agg(F.min("start_pos").alias("at"), F.count("*").alias("n"))
    left = first.groupBy("doc_id").agg(F.sum("n").alias("remaining"), F.slice(F.sort_array(F.collect_list(F.struct("at", "title"))).getField("title"), 1, 5).alias("titles"))
    out = text.join(left, "doc_id", "left").join(seen, "doc_id", "left").na.fill(0, ["remaining", "still_visible"])
    return out.select("doc_id", "remaining", F.coalesce("titles", F.array().cast("array<string>")).alias("titles"), "still_visible", "has_text", ((F.col("remaining") == 0) & (F.col("still_visible") == 0)).alias("passed"))


def low_confidence_warnings(results: DataFrame, below: float = LOW_CONFIDENCE) -> DataFrame:
    """(doc_id, page, warning) of pages recognised with less confidence than a bound."""
    pct = F.floor(F.col("confidence") + 0.5).cast("bigint")
    return results.filter(F.col("confidence") < below).select("doc_id", "page", F.concat(F.lit("Page "), F.col("page").cast("string"), F.lit(" OCR confidence was "), pct.cast("string"), F.lit("%")).alias("warning"))


def merge_pages(page_texts: DataFrame, recognised: DataFrame) -> DataFrame:
    """(doc_id, text): recognised text in place of a page's own where it isn't empty; pages in order, empty ones left out.

    Both have doc_id, page, text.
    """
    r = recognised.select("doc_id", "page", F.nullif("text", F.lit("")).alias("r"))
    both = page_texts.select("doc_id", "page", F.nullif("text", F.lit("")).alias("own")).join(r, ["doc_id", "page"], "full_outer")
    both = both.select("doc_id", "page", F.coalesce("r", "own").alias("text")).filter("text IS NOT NULL")
    return both.groupBy("doc_id").agg(F.trim(F.array_join(F.sort_array(F.collect_list(F.struct("page", "text"))).getField("text"), "\n\n")).alias("text"))


def layout_rows(items: DataFrame) -> DataFrame:
    """(doc_id, page, text): positioned items of pages as rows from top to bottom, items from left to right.

    ``items`` has doc_id, page, text, x, y with y growing upwards. Items within three units of height share a row.
    """
    row = F.floor(F.col("y") / 3 + 0.5) * 3
    rows = items.withColumn("row_key", row).groupBy("doc_id", "page", "row_key").agg(F.sort_array(F.collect_list(F.struct("x", "text"))).getField("text").alias("ts"))
    rows = rows.withColumn("t", F.trim(F.regexp_replace(F.array_join("ts", " "), r"\s+", " "))).filter("t <> ''")
    return rows.groupBy("doc_id", "page").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct((-F.col("row_key")).alias("k"), "t"))), lambda s: s["t"]), "\n").alias("text"))


def redacted_file_name(name: Column) -> Column:
    base = F.trim(F.regexp_replace(F.coalesce(name, F.lit("")), r"\.[^.]+\z", ""))
    return F.concat(F.coalesce(F.nullif(base, F.lit("")), F.lit("image")), F.lit("-redacted.png"))


def pages_to_read(page_numbers: Column) -> Column:
    """The pages to recognise: those given, else the first."""
    return F.when(F.size(page_numbers) > 0, page_numbers).otherwise(F.array(F.lit(1)))


def with_current_boxes(docs: DataFrame, recognised: DataFrame) -> DataFrame:
    """(doc_id) of documents whose text is still what was recognised, so that offsets belong to boxes; nulls are equal."""
    a, b = docs.select("doc_id", "text"), recognised.select("doc_id", F.col("text").alias("read"))
    return a.join(b, "doc_id").filter(F.col("text").eqNullSafe(F.col("read"))).select("doc_id")
