"""Usage events: admission, allowed values, data points and counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Allowed values of the dimensions, and the greatest body.
EVENTS = "page_view button_click convert_markdown copy_text export_file document_import ocr_complete privacy_scan_complete redact_findings".split()
FEATURES = "live_editor clipboard download import ocr privacy_scan redaction".split()
VARIANTS = "plain readable ai txt docx markdown text html pdf image".split()
SIZES = "tiny small medium large".split()
OUTCOMES = "success error".split()
BUTTONS = (
    "sample_presets_desktop import_desktop insights_toggle mobile_menu_toggle sample_presets_mobile_menu import_mobile_menu clear_mobile_menu "
    "conversion_plain conversion_readable conversion_ai references_toggle ocr_cancel ocr_run image_draw_toggle image_preview_toggle image_deep_scan "
    "image_clear_manual image_export image_verify mobile_input_tab mobile_output_tab mobile_both_tab sample_presets_mobile import_mobile clear_mobile "
    "clear_editor dismiss_error export_txt export_docx copy_output insights_close deep_scan_cancel deep_scan_repeat deep_scan_retry deep_scan_run "
    "select_all_findings copy_finding_ids redact_findings faq_toggle"
).split()
MAX_BODY = 1024
PATH = "/api/usage"
BODY = "event string, feature string, variant string, sizeBucket string, outcome string, button string, _bad string"


def allowed(event: Column, feature: Column, variant: Column, size: Column, outcome: Column, button: Column) -> Column:
    """Whether an event and its dimensions are known; a click needs a known button, other dimensions may be missing."""
    ok = F.coalesce(event.isin(EVENTS), F.lit(False)) & F.when(event == "button_click", F.coalesce(button.isin(BUTTONS), F.lit(False))).otherwise(button.isNull() | button.isin(BUTTONS))
    for c, values in ((feature, FEATURES), (variant, VARIANTS), (size, SIZES), (outcome, OUTCOMES)):
        ok = ok & (c.isNull() | c.isin(values))
    return ok


def admit(requests: DataFrame) -> DataFrame:
    """Adds ``status`` and the event's columns to requests of method, url, origin, content_type, body.

    The checks in order: path 404, method 405, origin 403, content type 415, body 400, else 204. A body is one JSON
    object of at most MAX_BODY bytes; a key that is there with null counts as a wrong value, an absent one doesn't.
    """
    # Scheme with host, and path, of an address; parsing it as a whole for each part costs more than all other checks.
    part = lambda n: F.regexp_extract("url", r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]+)([^?#]*)", n)
    host, path = part(1), part(2)
    body = F.when(F.octet_length("body") <= MAX_BODY, F.col("body"))
    parsed = F.struct(F.from_json(body, BODY, {"columnNameOfCorruptRecord": "_bad"}).alias("v"), F.json_object_keys(body).alias("keys"))
    # A row of its own keeps the parsed body from being written into each condition, and parsed again for each, when a filter on the status is pushed down.
    r = requests.select("*", F.explode(F.array(parsed)).alias("__p")).withColumns({"__v": F.col("__p.v"), "__keys": F.col("__p.keys")}).drop("__p")
    names = {"event": "event", "feature": "feature", "variant": "variant", "size_bucket": "sizeBucket", "outcome": "outcome", "button": "button"}
    good = F.col("__keys").isNotNull() & F.col("__v._bad").isNull()
    for key in names.values():
        good = good & ~(F.array_contains("__keys", key) & F.col(f"__v.{key}").isNull())
    r = r.withColumns({n: F.col(f"__v.{key}") for n, key in names.items()} | {"__good": good})
    ok = F.coalesce("__good", F.lit(False)) & allowed(*[F.col(n) for n in names])
    status = (
        F.when(F.coalesce(path, F.lit("")) != PATH, 404)
        .when(~F.coalesce(F.col("method") == "POST", F.lit(False)), 405)
        .when(~F.coalesce(F.col("origin") == host, F.lit(False)), 403)
        .when(~F.coalesce(F.col("content_type").startswith("application/json"), F.lit(False)), 415)
        .when(~ok, 400)
        .otherwise(204)
    )
    return r.withColumn("status", status).drop("__v", "__keys", "__good")


def data_points(admitted: DataFrame) -> DataFrame:
    """(index, blobs, doubles) of admitted events, with 'none' for what is missing."""
    cols = [F.col("event"), *[F.coalesce(c, F.lit("none")) for c in ("feature", "variant", "size_bucket", "outcome", "button")]]
    return admitted.filter("status = 204").select(F.col("event").alias("index"), F.array(*cols).alias("blobs"), F.array(F.lit(1.0)).alias("doubles"))


def counts(events: DataFrame, *dims: str) -> DataFrame:
    return events.groupBy(*dims).agg(F.count("*").alias("n"))
