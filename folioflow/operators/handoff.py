"""Readiness of documents for an agent: counts, checks, and what is left to do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import WS, utf16_length, word_count


def _filled(c: Column) -> Column:
    return F.coalesce(c.rlike(f"[^{WS}]"), F.lit(False))


def _count(items: Column) -> Column:
    return F.when(items.isNull(), 0).otherwise(F.size(items)).cast("bigint")


def _severity(name: str) -> Column:
    return F.when(F.col("findings").isNull(), 0).otherwise(F.size(F.filter("findings", lambda f: f["severity"] == name))).cast("bigint")


def summarise(inputs: DataFrame, *keep: str) -> DataFrame:
    """A summary row for each input row.

    Inputs have handoff_id, markdown, plain_text, conversion_mode,
    append_references, reference_count, broken, findings, deep_scan_status,
    import_warnings and human_approved; nulls count as empty, not done, not approved.
    ``keep`` names columns of the input that go along.
    """
    yes = lambda c: F.coalesce(c, F.lit(False))
    n_findings, n_broken, n_warnings = _count(F.col("findings")), _count(F.col("broken")), _count(F.col("import_warnings"))
    has_doc, has_out = _filled(F.col("markdown")), _filled(F.col("plain_text"))
    s = inputs.select(
        "handoff_id",
        *keep,
        has_doc.alias("has_document"),
        has_out.alias("has_converted_output"),
        yes(F.col("conversion_mode") == "ai").alias("ai_ready_mode"),
        yes(F.col("deep_scan_status") == "complete").alias("deep_scan_complete"),
        yes(F.col("human_approved")).alias("human_approved"),
        utf16_length(F.coalesce("markdown", F.lit(""))).cast("bigint").alias("input_characters"),
        utf16_length(F.coalesce("plain_text", F.lit(""))).cast("bigint").alias("output_characters"),
        F.when(has_doc, word_count(F.col("markdown"))).otherwise(0).cast("bigint").alias("word_count"),
        F.coalesce("reference_count", F.lit(0)).cast("bigint").alias("reference_count"),
        yes(F.col("append_references")).alias("references_appended"),
        n_broken.alias("broken_count"),
        n_warnings.alias("warning_count"),
        n_findings.alias("finding_count"),
        *[_severity(x).alias(f"{x}_count") for x in ("high", "medium", "low")],
        F.col("deep_scan_status"),
    )
    checks = F.col("has_document") & F.col("has_converted_output") & F.col("ai_ready_mode") & F.col("deep_scan_complete") & (F.col("finding_count") == 0) & (F.col("broken_count") == 0)
    s = s.withColumn("content_checks_pass", checks)
    ready = F.col("content_checks_pass") & F.col("human_approved")
    s = s.withColumn("readiness", F.when(~F.col("has_document"), "empty").when(ready, "ready").otherwise("review"))
    # The headlines and the steps, in order.
    s = s.withColumn(
        "headline",
        F.when(F.col("readiness") == "empty", "Waiting for a document")
        .when(F.col("readiness") == "ready", "Approved for an agent-assisted handoff")
        .when(F.col("human_approved"), "Approved with unresolved checks")
        .when(F.col("content_checks_pass"), "Human approval is the last step")
        .otherwise("Human review is still needed"),
    )
    many = lambda n, one: F.concat(F.lit("Review "), F.col(n).cast("string"), F.lit(f" {one}"), F.when(F.col(n) == 1, "").otherwise("s"))
    doc = F.col("has_document")
    steps = (
        (~doc, F.lit("Paste or import a document.")),
        (doc & ~F.col("has_converted_output"), F.lit("Check the converted output before handing it to an agent.")),
        (doc & ~F.col("ai_ready_mode"), F.lit("Set AI-ready mode for structured, clearly delimited context.")),
        (doc & ~F.col("deep_scan_complete"), F.lit("Run the deep local privacy scan and review its findings.")),
        (F.col("finding_count") > 0, F.concat(many("finding_count", "local safety finding"), F.lit(" before sharing."))),
        (F.col("broken_count") > 0, F.concat(many("broken_count", "broken reference"), F.lit("."))),
        (F.col("warning_count") > 0, F.lit("Review import warnings for reading-order or OCR limitations.")),
        (F.col("content_checks_pass") & ~F.col("human_approved"), F.lit("Review the visible output, then approve the handoff in Insights before an agent can read content, copy, or export.")),
        (F.col("human_approved") & ~F.col("content_checks_pass"), F.lit("Human approval was granted with unresolved checks; the agent may access this exact version, but readiness remains in review.")),
        (ready, F.lit("The visible document is approved for agent-assisted access and export.")),
    )
    return s.withColumn("next_steps", F.array_compact(F.array(*[F.when(c, t) for c, t in steps])))


def approval_snapshot(inputs: DataFrame) -> DataFrame:
    """(handoff_id, snapshot): the text that an approval holds for; of findings only the ids are in it."""
    ids = F.transform(F.coalesce("findings", F.expr("array()").cast(inputs.schema["findings"].dataType)), lambda f: f["id"])
    return inputs.select(
        "handoff_id",
        F.to_json(
            F.struct("markdown", "plain_text", "conversion_mode", "append_references", "broken", ids.alias("finding_ids"), "deep_scan_status", "import_warnings")
        ).alias("snapshot"),
    )
