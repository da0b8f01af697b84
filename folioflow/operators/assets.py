"""Links, images and addresses of documents."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import PY_WS, matches
from .convert import references

# What a bare address and a mail address look like, with white space as a browser has it.
URL = rf"""(?<!["'(])https?://[^{re.escape(PY_WS)})>]+(?![^<]*>)"""
MAIL = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"


def bare_urls(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(doc_id, start_pos, value) of addresses in the text, the first place of each."""
    each = docs.select("doc_id", F.explode(matches(F.col(text_col), URL)).alias("m")).select("doc_id", "m.*")
    return each.groupBy("doc_id", "value").agg(F.min("start_pos").alias("start_pos"))


def mail_addresses(docs: DataFrame, text_col: str = "text") -> DataFrame:
    return docs.select("doc_id", F.explode(matches(F.col(text_col), MAIL)).alias("m")).select("doc_id", "m.start_pos", "m.value")


def assets(docs: DataFrame, converted: DataFrame) -> DataFrame:
    """(doc_id, pos, type, value, label): references, addresses that are none of them, mail addresses with repeats.

    ``docs`` has doc_id and text; ``converted`` is the result of ``convert``.
    """
    refs = references(converted)
    a = refs.select("doc_id", F.lit(0).alias("part"), F.col("pos").alias("at"), F.when(F.col("kind") == "image", "image").otherwise("link").alias("type"), F.col("url").alias("value"), "label")
    # What a reference already names is no asset of its own.
    b = bare_urls(docs).join(refs.select("doc_id", F.col("url").alias("value")), ["doc_id", "value"], "left_anti")
    b = b.select("doc_id", F.lit(1).alias("part"), F.col("start_pos").alias("at"), F.lit("link").alias("type"), "value", F.lit(None).cast("string").alias("label"))
    c = mail_addresses(docs).select("doc_id", F.lit(2).alias("part"), F.col("start_pos").alias("at"), F.lit("email").alias("type"), "value", F.lit(None).cast("string").alias("label"))
    both = a.unionByName(b).unionByName(c)
    return both.withColumn("pos", F.row_number().over(Window.partitionBy("doc_id").orderBy("part", "at", "value")) - 1).drop("part", "at")


def asset_items(found: DataFrame, converted: DataFrame) -> DataFrame:
    """Assets, references and broken references as one list by category, with bounded values and labels."""
    refs = references(converted).select("doc_id", F.lit("reference").alias("category"), "pos", F.col("kind").alias("type"), F.col("url").alias("value"), "label")
    broken = converted.select("doc_id", F.posexplode("broken").alias("pos", "value")).select(
        "doc_id", F.lit("broken-reference").alias("category"), "pos", F.lit("reference").alias("type"), "value", F.lit(None).cast("string").alias("label")
    )
    items = found.withColumn("category", F.lit("asset")).unionByName(refs).unionByName(broken)
    rank = F.when(F.col("category") == "asset", 0).when(F.col("category") == "reference", 1).otherwise(2)
    items = items.withColumn("item_no", F.row_number().over(Window.partitionBy("doc_id").orderBy(rank, "pos")) - 1)
    return items.select(
        "doc_id", "item_no", "category", "type",
        F.substring("value", 1, 180).alias("value"), (F.length("value") > 180).alias("value_truncated"),
        F.substring("label", 1, 80).alias("label"), F.coalesce(F.length("label") > 80, F.lit(False)).alias("label_truncated"),
    )
