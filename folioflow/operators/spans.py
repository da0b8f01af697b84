"""Spans against spans: consolidation, merging, islands and redaction, as joins and windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .rules import SEVERITY_RANK, TYPE_RANK

#: Shares of a span that must overlap for one finding to stand for another.
SAME_RULE, SAME_MODEL = 0.8, 0.6


def _case(column: str, ranks: dict[str, int]) -> Column:
    pairs = [x for k, v in ranks.items() for x in (F.lit(k), F.lit(v))]
    return F.coalesce(F.create_map(*pairs)[F.col(column)], F.lit(0))


def priority() -> Column:
    """The weight of a finding: its type, its severity, and a little for a rule."""
    return _case("type", TYPE_RANK) + _case("severity", SEVERITY_RANK) + F.coalesce(F.col("source") == "rule", F.lit(False)).cast("int")


def weight(finding: dict) -> int:
    """As ``priority``, of one finding."""
    return TYPE_RANK.get(finding["type"], 0) + SEVERITY_RANK.get(finding["severity"], 0) + (finding["source"] == "rule")


def _overlap(a: str, b: str) -> Column:
    return F.greatest(F.lit(0), F.least(F.col(f"{a}.end_pos"), F.col(f"{b}.end_pos")) - F.greatest(F.col(f"{a}.start_pos"), F.col(f"{b}.start_pos")))


def _length(a: str) -> Column:
    return F.col(f"{a}.end_pos") - F.col(f"{a}.start_pos")


#: What stands for a finding without a placeholder.
UNNAMED = "REDACTED"
#: Characters of a stretch of text; spans meet by the stretches they lie in.
STRETCH = 64


def _stretches(a: str = "start_pos", b: str = "end_pos") -> Column:
    """The stretches that a span lies in: a short span has one or two."""
    return F.explode(F.sequence(F.floor(F.col(a) / STRETCH), F.floor(F.greatest(F.col(a), F.col(b) - 1) / STRETCH)))


def _middle() -> Column:
    """The stretch that the middle of a span lies in. What covers more than half of a span covers its middle."""
    return F.floor((F.col("start_pos") + F.col("end_pos")) / 2 / STRETCH)


def _on(keys: list[str], condition: Column) -> Column:
    for k in (*keys, "__at"):
        condition = (F.col(f"a.{k}") == F.col(f"b.{k}")) & condition
    return condition


def _without(left: DataFrame, right: DataFrame, keys: list[str], condition: Column, shorter: bool) -> DataFrame:
    """Rows of left for which no row of right with the same keys meets a condition of which an overlap by more than half of left's span is part (with ``shorter`` of the shorter span).

    An equi-join on the keys and a stretch of text, so a document with many
    findings is no hot key and far spans are never compared.
    """
    wide, narrow = right.withColumn("__at", _stretches()), left.withColumn("__at", _middle())
    rest = narrow.alias("a").join(wide.alias("b"), _on(keys, condition), "left_anti").drop("__at")
    if not shorter:
        return rest
    # A span that is longer than the other holds the other's middle.
    names = [*keys, "__row"]
    rest = rest.withColumn("__row", F.struct("start_pos", "end_pos", "id", *(c for c in ("rnk",) if c in rest.columns)))
    met = rest.withColumn("__at", _stretches()).alias("a").join(right.withColumn("__at", _middle()).alias("b"), _on(keys, condition), "left_semi").select(*names).distinct()
    return rest.join(met, names, "left_anti").drop("__row")


def consolidate(findings: DataFrame, key: str = "doc_id") -> DataFrame:
    """Findings without those that a higher-ranked finding covers by 80 % or more.

    Each is compared with all that rank above it, kept or not, so this is one
    anti-join within a document. Empty spans cover nothing and are kept.
    """
    by = Window.partitionBy(key).orderBy(F.desc("prio"), F.desc(F.col("end_pos") - F.col("start_pos")), "start_pos", "id")
    ranked = findings.withColumn("prio", priority()).withColumn("rnk", F.row_number().over(by))
    shared = _overlap("a", "b")
    covered = (F.col("b.rnk") < F.col("a.rnk")) & (shared > 0) & (shared / F.greatest(_length("a"), F.lit(1)) >= SAME_RULE)
    return _without(ranked, ranked.select(key, "rnk", "start_pos", "end_pos"), [key], covered, False).drop("prio", "rnk")


def dedupe_model(findings: DataFrame, key: str = "doc_id") -> DataFrame:
    """Model findings without those that overlap a surer one by 60 % of the shorter. Ids are unique within a document and span."""
    by = Window.partitionBy(key).orderBy(F.desc("confidence"), "start_pos", "end_pos", "id")
    ranked = findings.withColumn("rnk", F.row_number().over(by))
    shared = _overlap("a", "b")
    same = (F.col("b.rnk") < F.col("a.rnk")) & (shared > 0) & (shared / F.greatest(F.least(_length("a"), _length("b")), F.lit(1)) >= SAME_MODEL)
    return _without(ranked, ranked.select(key, "rnk", "start_pos", "end_pos"), [key], same, True).drop("rnk")


def merge_findings(rules: DataFrame, model: DataFrame, key: str = "doc_id", current: DataFrame | None = None) -> DataFrame:
    """Rule findings with the model's that no rule finding overlaps by 60 % of the shorter.

    ``current`` has ``key`` and the fingerprint of each document now; model findings of older texts are left out.
    """
    if current is not None:
        model = model.join(current.select(key, "doc_fingerprint").distinct(), [key, "doc_fingerprint"], "left_semi")
    shared = _overlap("a", "b")
    same = (shared > 0) & (shared / F.greatest(F.least(_length("a"), _length("b")), F.lit(1)) >= SAME_MODEL)
    rest = _without(model, rules.select(key, "start_pos", "end_pos"), [key], same, True)
    return rules.unionByName(rest, allowMissingColumns=True)


def unknown_ids(wanted: DataFrame, findings: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, id): the wanted ids that no finding of the document has."""
    return wanted.select(key, "id").distinct().join(findings.select(key, "id"), [key, "id"], "left_anti")


def stale_findings(docs: DataFrame, findings: DataFrame, key: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(key, id): findings of another version of their document, or whose span doesn't hold their value."""
    return _marked(docs, findings, None, key, text_col).select(key, F.explode("stale_ids").alias("id"))


def islands(findings: DataFrame, key: str = "doc_id") -> DataFrame:
    """Adds ``island``: the number, from 1, of the run of overlapping spans that a finding is in."""
    by = Window.partitionBy(key).orderBy("start_pos", F.desc("end_pos"), "id")
    reach = F.max("end_pos").over(by.rowsBetween(Window.unboundedPreceding, -1))
    starts = F.when(reach.isNull() | (F.col("start_pos") >= reach), 1).otherwise(0)
    return findings.withColumn("__new", starts).withColumn("island", F.sum("__new").over(by).cast("int")).withColumn("pos_in_island", F.row_number().over(Window.partitionBy(key, "island").orderBy("start_pos", F.desc("end_pos"), "id"))).drop("__new")


def redaction_groups(findings: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row per island: its span, the placeholder and type of its weightiest finding, and the ids in it.
    """
    weight = F.struct(priority().alias("p"), (F.col("end_pos") - F.col("start_pos")).alias("l"), (-F.col("start_pos")).alias("s"), F.col("id"))
    return (
        islands(findings, key)
        .groupBy(key, "island")
        .agg(
            F.min("start_pos").alias("start_pos"),
            F.max("end_pos").alias("end_pos"),
            F.max_by("placeholder", weight).alias("placeholder"),
            F.max_by("type", weight).alias("type"),
            F.max_by("id", weight).alias("top_id"),
            F.sort_array(F.collect_list(F.struct("pos_in_island", "id"))).getField("id").alias("ids"),
        )
    )


def alias_key(value: Column) -> Column:
    """How two values are told to be the same: compatibility form and small letters."""

    @F.udf("string", useArrow=True)
    def fold(v):
        import unicodedata

        return None if v is None else unicodedata.normalize("NFKC", v).lower()

    # Plain letters need no Python.
    return F.when(value.rlike(r"^[\x00-\x7f]*\z"), F.lower(value)).otherwise(fold(value))


def put_together(text: str, spans: list[dict], normalise: bool) -> tuple[str, list[str], list[str]]:
    """The text with each island of spans replaced, and the ids of all spans and of those that were merged into others."""
    import unicodedata

    spans = sorted(spans, key=lambda s: (s["start_pos"], -s["end_pos"], s["id"]))
    groups: list[list[dict]] = []
    reach = -1
    for s in spans:
        if groups and s["start_pos"] < reach:
            groups[-1].append(s)
            reach = max(reach, s["end_pos"])
        else:
            groups.append([s])
            reach = s["end_pos"]
    numbers: dict[tuple[str, str], int] = {}
    last: dict[str, int] = {}
    out, at = [], 0
    for g in groups:
        top = max(g, key=lambda s: (s["prio"], s["end_pos"] - s["start_pos"], -s["start_pos"], s["id"]))
        a, b = g[0]["start_pos"], max(s["end_pos"] for s in g)
        out.append(text[at:a])
        at = b
        if top["type"] != "invisible-text":
            value = text[a:b]
            alias = (top["placeholder"] or UNNAMED, (unicodedata.normalize("NFKC", value) if normalise else value).lower())
            if alias not in numbers:
                last[alias[0]] = numbers[alias] = last.get(alias[0], 0) + 1
            out.append(f"[{alias[0]}_{numbers[alias]}]")
    return "".join([*out, text[at:]]), [s["id"] for g in groups for s in g], [s["id"] for g in groups for s in g[1:]]


def _marked(docs: DataFrame, findings: DataFrame, unknown: DataFrame | None, key: str, text_col: str, normalise: bool = True) -> DataFrame:
    """(key, text, redacted_ids, overlap_merged_ids, stale_ids): spans are gathered by document, texts are read once and never shuffled with each span."""
    from ..functions.text import fingerprint_batch
    from .batches import map_batches

    of = F.struct("id", "doc_fingerprint", "value", "start_pos", "end_pos", "placeholder", "type", priority().alias("prio"))
    # Copies of a finding are dropped where they lie, so what is gathered is bounded by the document.
    rows = findings.filter(F.col(key).isNotNull()).groupBy(key).agg(F.collect_set(of).alias("spans"))
    joined = docs.select(key, F.col(text_col).alias("text")).join(rows, key, "left")
    if unknown is not None:
        joined = joined.join(unknown.groupBy(key).agg(F.collect_set("id").alias("unknown")), key, "left")
    else:
        joined = joined.withColumn("unknown", F.lit(None).cast("array<string>"))
    ids = T.ArrayType(T.StringType())
    schema = T.StructType([joined.schema[key], T.StructField("text", T.StringType()), *[T.StructField(n, ids) for n in ("redacted_ids", "overlap_merged_ids", "stale_ids")]])

    def before(rows: list[dict]) -> None:
        some = [r for r in rows if r["spans"] and r["text"] is not None]
        for r, f in zip(some, fingerprint_batch([r["text"] for r in some])):
            r["fp"] = f

    def one(r: dict):
        text, spans = r["text"], r["spans"] or []
        fits = lambda s: text is not None and s["doc_fingerprint"] == r["fp"] and None not in (s["start_pos"], s["end_pos"], s["value"]) and 0 <= s["start_pos"] and s["end_pos"] <= len(text) and text[s["start_pos"] : s["end_pos"]] == s["value"]
        stale = sorted([s["id"] for s in spans if not fits(s)] + (r["unknown"] or []))
        if stale or not spans:
            yield r[key], text, [], [], stale
        else:
            yield r[key], *put_together(text, spans, normalise), []

    return map_batches(joined, one, schema, before=before)


def redact(docs: DataFrame, findings: DataFrame, selected: DataFrame | None = None, key: str = "doc_id", text_col: str = "text", normalise: bool = True) -> DataFrame:
    """(key, text, redacted_ids, overlap_merged_ids, stale_ids) of each document.

    ``selected`` has ``key`` and ``id``; without it all findings are taken. A
    document with an unknown id, or a finding that doesn't fit its text, stays
    as it is, with those ids as stale. Equal values of a placeholder get equal
    numbers, in the order of their first places; unseen characters are removed.
    """
    if selected is None:
        return _marked(docs, findings, None, key, text_col, normalise)
    wanted = selected.select(key, "id").distinct()
    return _marked(docs, findings.join(wanted, [key, "id"], "left_semi"), unknown_ids(wanted, findings, key), key, text_col, normalise)
