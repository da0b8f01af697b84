"""Queries of the engine's own operators over the test tables, with SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import fixtures, oracles
from .functions import checks, editing, language, text
from .operators import assets, entities, handoff, ocr, paging, spans, usage
from .operators.convert import convert, references
from .operators.scan import scan
from .sources import files, html, sinks
from .sources.shared import drained
from .sources.tables import read_table as table
from .sources.tables import stream_table
from .streaming import pipelines

MAIL_RE2 = r"(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b"
IP_BODY = r"(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
WS_RE2 = r"\t\n\x0B\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"


def latest_handoffs(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """Each handoff as it was received last, with the columns named; older deliveries are dropped before the shuffle."""
    t = table(spark, d, "handoff_inputs")
    names = [c for c in t.columns if c != "handoff_id" and (not columns or c in columns)]
    last = t.groupBy("handoff_id").agg(F.max_by(F.struct(*names), F.struct("received_at", "markdown")).alias("h"))
    return last.select("handoff_id", "h.*")


LATEST = "h AS (SELECT * FROM handoff_inputs QUALIFY row_number() OVER (PARTITION BY handoff_id ORDER BY received_at DESC NULLS LAST, markdown DESC NULLS LAST) = 1)"


def findings(spark: SparkSession, d: str) -> DataFrame:
    """Valid spans of the stored findings, each id of a handoff once."""
    f = table(spark, d, "safety_findings").filter("handoff_id IS NOT NULL AND id IS NOT NULL AND start_pos >= 0 AND end_pos > start_pos")
    f = f.groupBy("handoff_id", "id").agg(F.min_by(F.struct("finding_no", "doc_fingerprint", "finding_type", "severity", "title", "finding_value", "start_pos", "end_pos", "placeholder", "origin", "confidence"), "finding_no").alias("f"))
    f = f.select("handoff_id", "id", "f.*")
    return f.withColumnRenamed("finding_type", "type").withColumnRenamed("origin", "source").withColumnRenamed("finding_value", "value")


VALID = "f AS (SELECT handoff_id, id, finding_no, doc_fingerprint, finding_type, severity, title, finding_value, start_pos, end_pos, placeholder, origin, confidence FROM safety_findings WHERE handoff_id IS NOT NULL AND id IS NOT NULL AND start_pos >= 0 AND end_pos > start_pos QUALIFY row_number() OVER (PARTITION BY handoff_id, id ORDER BY finding_no) = 1)"
PRIO = (
    "coalesce(CASE finding_type WHEN 'secret' THEN 700 WHEN 'financial-data' THEN 600 WHEN 'personal-data' THEN 500 WHEN 'prompt-injection' THEN 400 WHEN 'hidden-content' THEN 300 WHEN 'encoded-content' THEN 200 WHEN 'invisible-text' THEN 100 END, 0)"
    " + coalesce(CASE severity WHEN 'high' THEN 30 WHEN 'medium' THEN 20 WHEN 'low' THEN 10 END, 0) + CASE WHEN origin = 'rule' THEN 1 ELSE 0 END"
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return keep


# ---- statistics and projections ----------------------------------------------------


@query(
    rf"""SELECT doc_id, CAST(length(t) AS BIGINT) AS n_chars, CAST(len(regexp_extract_all(t, '[^{WS_RE2}]+')) AS BIGINT) AS n_words,
    CAST(CASE WHEN length(t) > 0 THEN length(t) - length(replace(t, chr(10), '')) + 1 ELSE 0 END AS BIGINT) AS n_lines,
    CASE WHEN length(t) < 1000 THEN 'tiny' WHEN length(t) < 10000 THEN 'small' WHEN length(t) < 100000 THEN 'medium' ELSE 'large' END AS size_bucket
    FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '\r\n?', chr(10), 'g') AS t FROM documents)"""
)
def doc_stats(spark, d):
    t = text.newline(F.coalesce("text", F.lit("")))
    return table(spark, d, "documents").select("doc_id", t.alias("t")).select(
        "doc_id", F.length("t").cast("bigint").alias("n_chars"), text.word_count(F.col("t")).alias("n_words"), text.line_count(F.col("t")).alias("n_lines"), text.size_bucket(F.length("t")).alias("size_bucket")
    )


@query(
    """SELECT lang, CASE WHEN length(text) < 1000 THEN 'tiny' WHEN length(text) < 10000 THEN 'small' WHEN length(text) < 100000 THEN 'medium' ELSE 'large' END AS size_bucket,
    CAST(count(*) AS BIGINT) AS n_docs, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM documents WHERE text IS NOT NULL GROUP BY ALL"""
)
def size_bucket_by_lang(spark, d):
    t = table(spark, d, "documents").filter("text IS NOT NULL").select("lang", text.size_bucket(F.length("text")).alias("size_bucket"), F.length("text").alias("n"))
    return t.groupBy("lang", "size_bucket").agg(F.count("*").alias("n_docs"), F.sum("n").cast("bigint").alias("n_chars"))


@query(
    """SELECT doc_id, string_split(lower(file_name), '.')[-1] AS extension,
    CASE WHEN string_split(lower(file_name), '.')[-1] IN ('md', 'markdown') THEN 'markdown' WHEN string_split(lower(file_name), '.')[-1] = 'txt' THEN 'text'
    WHEN string_split(lower(file_name), '.')[-1] IN ('html', 'htm') THEN 'html' WHEN string_split(lower(file_name), '.')[-1] IN ('docx', 'pdf') THEN string_split(lower(file_name), '.')[-1]
    WHEN string_split(lower(file_name), '.')[-1] IN ('png', 'jpg', 'jpeg', 'webp', 'bmp', 'gif') THEN 'image' END AS format FROM documents WHERE file_name IS NOT NULL"""
)
def import_formats(spark, d):
    t = table(spark, d, "documents").filter("file_name IS NOT NULL")
    return t.select("doc_id", files.extension(F.col("file_name")).alias("extension"), files.format_of(F.col("file_name")).alias("format"))


@query(
    """SELECT doc_id, CASE WHEN trim(regexp_replace(coalesce(file_name, ''), '\\.[^.]+$', '')) = '' THEN 'image' ELSE trim(regexp_replace(file_name, '\\.[^.]+$', '')) END || '-redacted.png' AS name FROM documents"""
)
def redacted_names(spark, d):
    return table(spark, d, "documents").select("doc_id", ocr.redacted_file_name(F.col("file_name")).alias("name"))


_FP = """SELECT handoff_id AS k, x AS t, list_reduce(list_prepend({{'a': CAST(2166136261 AS HUGEINT), 'b': CAST(2654435769 AS HUGEINT), 'i': CAST(0 AS HUGEINT)}},
    list_transform(string_split(x, ''), lambda c: {{'a': CAST(CASE WHEN c = '' THEN -1 ELSE ord(c) END AS HUGEINT), 'b': CAST(0 AS HUGEINT), 'i': CAST(0 AS HUGEINT)}})),
    lambda s, c: CASE WHEN c.a < 0 THEN s ELSE {{'a': (xor(s.a, c.a) * 16777619) % 4294967296, 'b': (xor(s.b, c.a + s.i) * 2246822507) % 4294967296, 'i': s.i + 1}} END) AS r FROM {source}"""


@query(
    f"""WITH {LATEST}, r AS ({_FP.format(source="(SELECT handoff_id, markdown AS x FROM h WHERE markdown IS NOT NULL)")})
    SELECT k AS handoff_id, CAST(length(t) AS VARCHAR) || ':' || lower(to_base(CAST(r.a AS BIGINT), 36)) || ':' || lower(to_base(CAST(r.b AS BIGINT), 36)) AS doc_fingerprint FROM r"""
)
def fingerprints(spark, d):
    return latest_handoffs(spark, d).filter("markdown IS NOT NULL").select("handoff_id", text.fingerprint(F.col("markdown")).alias("doc_fingerprint"))


@query(
    """SELECT handoff_id, id, finding_type AS type, severity, substr(title, 1, 100) AS title, substr(detail, 1, 180) AS detail, line, substr(placeholder, 1, 60) AS placeholder, origin AS source, confidence FROM safety_findings"""
)
def content_free_findings(spark, d):
    return paging.finding_projection(table(spark, d, "safety_findings"))


# ---- matches and findings ----------------------------------------------------------


def _matches_sql(pattern: str, columns: str = "") -> str:
    p = pattern.replace("'", "''")
    return f"""WITH {LATEST}, m AS (SELECT handoff_id, markdown AS t, string_split_regex(markdown, '{p}') AS g, regexp_extract_all(markdown, '{p}') AS v FROM h WHERE markdown IS NOT NULL),
    x AS (SELECT *, unnest(range(1, len(v) + 1)) AS i FROM m),
    y AS (SELECT handoff_id, t, v[i] AS value, CAST(list_sum(list_transform(g[1:i], lambda s: length(s))) + coalesce(list_sum(list_transform(v[1:i - 1], lambda s: length(s))), 0) AS INTEGER) AS start_pos FROM x)
    {columns or "SELECT handoff_id, value, start_pos, CAST(start_pos + length(value) AS INTEGER) AS end_pos, CAST(length(t[1:start_pos]) - length(replace(t[1:start_pos], chr(10), '')) + 1 AS INTEGER) AS line FROM y"}"""


def _scanned(spark, d):
    """All findings of the notes, by handoff_id."""
    return scan(latest_handoffs(spark, d, "markdown"), "handoff_id", "markdown").withColumnRenamed("doc_id", "handoff_id")


def _of_rule(spark, d, rule: str) -> DataFrame:
    return _scanned(spark, d).filter(F.col("id").startswith(f"rule-{rule}-")).select("handoff_id", "value", "start_pos", "end_pos", "line")


@query(oracles.rule_findings("email"))
def email_findings(spark, d):
    return _of_rule(spark, d, "email")


@query(oracles.rule_findings("ipv4"))
def ipv4_findings(spark, d):
    return _of_rule(spark, d, "ipv4")


@query(
    f"""WITH {LATEST}, m AS (SELECT handoff_id, regexp_extract_all(markdown, '[0-9](?:[ -]?[0-9])+') AS v FROM h WHERE markdown IS NOT NULL),
    x AS (SELECT handoff_id, unnest(v) AS value FROM m), y AS (SELECT handoff_id, value, regexp_replace(value, '[^0-9]', '', 'g') AS n FROM x),
    z AS (SELECT *, list_sum(list_transform(range(1, length(n) + 1), lambda i: CASE WHEN (length(n) - i) % 2 = 1 THEN CASE WHEN CAST(n[i] AS INTEGER) * 2 > 9 THEN CAST(n[i] AS INTEGER) * 2 - 9 ELSE CAST(n[i] AS INTEGER) * 2 END ELSE CAST(n[i] AS INTEGER) END)) AS s FROM y)
    SELECT handoff_id, value, length(n) BETWEEN 13 AND 19 AND NOT n = repeat(n[1], length(n)) AND s % 10 = 0 AS valid FROM z"""
)
def digit_runs_luhn(spark, d):
    v = F.explode(F.regexp_extract_all("markdown", F.lit("[0-9](?:[ -]?[0-9])+"), F.lit(0))).alias("value")
    return latest_handoffs(spark, d, "markdown").filter("markdown IS NOT NULL").select("handoff_id", v).select("handoff_id", "value", checks.luhn_valid(F.col("value")).alias("valid"))


@query(oracles.all_findings("h", "handoff_id", "markdown", fingerprint=True))
def scan_all_rules(spark, d):
    return _scanned(spark, d).drop("rule_ord")


@query(oracles.consolidated("h", "handoff_id", "markdown"))
def scan_consolidated(spark, d):
    return spans.consolidate(_scanned(spark, d), "handoff_id").select("handoff_id", "id", "type", "severity", "start_pos", "end_pos", "line", "placeholder")


@query(oracles.consolidated("documents", "doc_id", "text"))
def scan_documents(spark, d):
    return spans.consolidate(scan(table(spark, d, "documents", spread=True), "doc_id", "text")).select("doc_id", "id", "type", "severity", "start_pos", "end_pos", "line", "placeholder")


@query(
    """SELECT handoff_id, CAST(count(*) FILTER (severity = 'high') AS BIGINT) AS high, CAST(count(*) FILTER (severity = 'medium') AS BIGINT) AS medium, CAST(count(*) FILTER (severity = 'low') AS BIGINT) AS low,
    CAST(count(*) FILTER (origin = 'local-ai') AS BIGINT) AS by_model, CAST(count(*) AS BIGINT) AS total FROM safety_findings GROUP BY handoff_id"""
)
def severity_counts(spark, d):
    n = [F.count_if(F.col("severity") == s).alias(s) for s in ("high", "medium", "low")]
    return table(spark, d, "safety_findings").groupBy("handoff_id").agg(*n, F.count_if(F.col("origin") == "local-ai").alias("by_model"), F.count("*").alias("total"))


# ---- spans against spans -----------------------------------------------------------


@query(
    f"""WITH {VALID}, r AS (SELECT *, row_number() OVER (PARTITION BY handoff_id ORDER BY {PRIO} DESC, end_pos - start_pos DESC, start_pos, id) AS rnk FROM f)
    SELECT handoff_id, id, start_pos, end_pos FROM r a WHERE NOT EXISTS (SELECT 1 FROM r b WHERE a.handoff_id = b.handoff_id AND b.rnk < a.rnk
    AND least(a.end_pos, b.end_pos) > greatest(a.start_pos, b.start_pos) AND (least(a.end_pos, b.end_pos) - greatest(a.start_pos, b.start_pos)) / (a.end_pos - a.start_pos) >= 0.8)"""
)
def consolidation(spark, d):
    return spans.consolidate(findings(spark, d), "handoff_id").select("handoff_id", "id", "start_pos", "end_pos")


@query(
    f"""WITH {VALID}, r AS (SELECT *, row_number() OVER (PARTITION BY handoff_id ORDER BY confidence DESC NULLS LAST, start_pos, end_pos, id) AS rnk FROM f WHERE origin = 'local-ai')
    SELECT handoff_id, id, start_pos, end_pos FROM r a WHERE NOT EXISTS (SELECT 1 FROM r b WHERE a.handoff_id = b.handoff_id AND b.rnk < a.rnk
    AND least(a.end_pos, b.end_pos) > greatest(a.start_pos, b.start_pos)
    AND (least(a.end_pos, b.end_pos) - greatest(a.start_pos, b.start_pos)) / least(a.end_pos - a.start_pos, b.end_pos - b.start_pos) >= 0.6)"""
)
def model_dedupe(spark, d):
    return spans.dedupe_model(findings(spark, d).filter("source = 'local-ai'"), "handoff_id").select("handoff_id", "id", "start_pos", "end_pos")


@query(
    f"""WITH {VALID}, a AS (SELECT * FROM f WHERE origin = 'local-ai'), b AS (SELECT * FROM f WHERE origin = 'rule')
    SELECT handoff_id, id, origin AS source FROM b UNION ALL SELECT handoff_id, id, origin FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE a.handoff_id = b.handoff_id
    AND least(a.end_pos, b.end_pos) > greatest(a.start_pos, b.start_pos)
    AND (least(a.end_pos, b.end_pos) - greatest(a.start_pos, b.start_pos)) / least(a.end_pos - a.start_pos, b.end_pos - b.start_pos) >= 0.6)"""
)
def rules_over_model(spark, d):
    f = findings(spark, d)
    return spans.merge_findings(f.filter("source = 'rule'"), f.filter("source = 'local-ai'"), "handoff_id").select("handoff_id", "id", "source")


_ISLANDS = f"""{VALID}, o AS (SELECT *, max(end_pos) OVER (PARTITION BY handoff_id ORDER BY start_pos, end_pos DESC, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM f),
    i AS (SELECT *, sum(CASE WHEN reach IS NULL OR start_pos >= reach THEN 1 ELSE 0 END) OVER (PARTITION BY handoff_id ORDER BY start_pos, end_pos DESC, id) AS island FROM o)"""


@query(
    f"""WITH {_ISLANDS} SELECT handoff_id, CAST(island AS INTEGER) AS island, min(start_pos) AS start_pos, max(end_pos) AS end_pos, CAST(count(*) AS BIGINT) AS n,
    arg_max(id, {{'p': {PRIO}, 'l': end_pos - start_pos, 's': -start_pos, 'i': id}}) AS top_id FROM i GROUP BY handoff_id, island"""
)
def finding_islands(spark, d):
    g = spans.redaction_groups(findings(spark, d), "handoff_id")
    return g.select("handoff_id", "island", "start_pos", "end_pos", F.size("ids").cast("bigint").alias("n"), "top_id")


@query(
    f"""WITH {_ISLANDS}, n AS (SELECT *, row_number() OVER (PARTITION BY handoff_id, island ORDER BY start_pos, end_pos DESC, id) AS k FROM i)
    SELECT handoff_id, id FROM n WHERE k > 1"""
)
def overlap_merged_ids(spark, d):
    return spans.islands(findings(spark, d), "handoff_id").filter("pos_in_island > 1").select("handoff_id", "id")


@query(oracles.redacted("email"))
def email_redaction(spark, d):
    """The addresses of each note replaced by numbered placeholders."""
    docs = latest_handoffs(spark, d, "markdown").filter("markdown IS NOT NULL").select("handoff_id", F.col("markdown").alias("text"))
    found = scan(docs, "handoff_id", "text").withColumnRenamed("doc_id", "handoff_id").filter("id LIKE 'rule-email-%'")
    return spans.redact(docs, found, key="handoff_id").filter("size(redacted_ids) > 0").select("handoff_id", "text")


@query(
    f"""WITH {LATEST}, {VALID}, r AS ({_FP.format(source="(SELECT handoff_id, markdown AS x FROM h WHERE markdown IS NOT NULL)")}),
    c AS (SELECT k, CAST(length(t) AS VARCHAR) || ':' || lower(to_base(CAST(r.a AS BIGINT), 36)) || ':' || lower(to_base(CAST(r.b AS BIGINT), 36)) AS fp, t FROM r)
    SELECT f.handoff_id, f.id FROM f JOIN c ON f.handoff_id = c.k WHERE coalesce(NOT (f.doc_fingerprint = c.fp AND f.end_pos <= length(c.t) AND c.t[f.start_pos + 1:f.end_pos] = f.finding_value), true)"""
)
def stale_findings(spark, d):
    docs = latest_handoffs(spark, d, "markdown").filter("markdown IS NOT NULL").select("handoff_id", F.col("markdown").alias("text"))
    return spans.stale_findings(docs, findings(spark, d), "handoff_id")


@query(oracles.redact_stored())
def redact_findings(spark, d):
    """The stored findings of each note put into effect; notes with a stale finding stay as they are."""
    docs = latest_handoffs(spark, d, "markdown").filter("markdown IS NOT NULL").select("handoff_id", F.col("markdown").alias("text"))
    out = spans.redact(docs, findings(spark, d), key="handoff_id")
    return out.select("handoff_id", "text", *[F.array_join(c, " ").alias(c) for c in ("redacted_ids", "overlap_merged_ids", "stale_ids")])


@query(oracles.redact_stored(selected=True))
def redact_selected(spark, d):
    """Only the findings that a note's own list names; notes whose list has an unknown id stay as they are."""
    docs = latest_handoffs(spark, d, "markdown").filter("markdown IS NOT NULL").select("handoff_id", F.col("markdown").alias("text"))
    wanted = table(spark, d, "handoff_inputs").select("handoff_id", F.explode("findings").alias("f")).select("handoff_id", "f.id").filter("handoff_id IS NOT NULL AND id IS NOT NULL")
    out = spans.redact(docs, findings(spark, d), selected=wanted, key="handoff_id")
    return out.select("handoff_id", "text", *[F.array_join(c, " ").alias(c) for c in ("redacted_ids", "overlap_merged_ids", "stale_ids")])


@query(oracles.redacted())
def scan_and_redact(spark, d):
    """Scan, consolidate and redact in one plan."""
    h = latest_handoffs(spark, d, "markdown").filter("markdown IS NOT NULL").select("handoff_id", F.col("markdown").alias("text"))
    found = spans.consolidate(scan(h, "handoff_id", "text")).withColumnRenamed("doc_id", "handoff_id")
    return spans.redact(h, found, key="handoff_id").filter("size(redacted_ids) > 0").select("handoff_id", "text")


@query(
    f"""WITH {VALID} SELECT handoff_id, '[' || string_agg(id, ', ' ORDER BY start_pos, end_pos DESC, id) || ']' AS ids FROM f WHERE severity = 'high' GROUP BY handoff_id"""
)
def selected_id_lists(spark, d):
    f = findings(spark, d)
    chosen = f.filter("severity = 'high'").select("handoff_id", "id")
    return sinks.id_list(f.join(chosen, ["handoff_id", "id"], "left_semi"), "handoff_id")


@query(
    f"""WITH {VALID}, s AS (SELECT DISTINCT handoff_id, id FROM safety_findings WHERE handoff_id IS NOT NULL AND id IS NOT NULL)
    SELECT handoff_id, id FROM s WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.handoff_id = s.handoff_id AND f.id = s.id AND f.origin = 'rule')"""
)
def unknown_ids(spark, d):
    """Ids of all stored findings that aren't those of a valid rule finding."""
    wanted = table(spark, d, "safety_findings").filter("handoff_id IS NOT NULL AND id IS NOT NULL")
    return spans.unknown_ids(wanted, findings(spark, d).filter("source = 'rule'"), "handoff_id")


@query(
    f"""WITH {VALID}, n AS (SELECT handoff_id, id, row_number() OVER (PARTITION BY handoff_id ORDER BY start_pos, end_pos DESC, id) - 1 AS item_no, count(*) OVER (PARTITION BY handoff_id) AS total FROM f)
    SELECT handoff_id, id, CAST(item_no AS INTEGER) AS item_no, CAST(total AS INTEGER) AS total, CAST(item_no // 2 AS INTEGER) AS page_no,
    CAST(CASE WHEN (item_no // 2 + 1) * 2 < total THEN (item_no // 2 + 1) * 2 END AS INTEGER) AS next_cursor FROM n"""
)
def finding_pages(spark, d):
    f = findings(spark, d).select("handoff_id", "id", "start_pos", "end_pos")
    return paging.item_pages(f, "handoff_id", ["start_pos", F.desc("end_pos"), "id"]).select("handoff_id", "id", F.col("item_no").cast("int").alias("item_no"), "total", "page_no", "next_cursor")


@query(
    """SELECT finding_no, CASE WHEN k IS NULL THEN NULL WHEN regexp_matches(k, '^(?:O|ORG|ORGANIZATION|MISC|PRODUCT|EVENT|WORK_OF_ART|LAW|LANGUAGE)$') THEN NULL
    WHEN regexp_matches(k, 'CREDIT|CARD|CVV|CVC|BANK|ACCOUNT|IBAN|SWIFT|BIC|CRYPTO|BITCOIN|ETHEREUM|SALARY') THEN 'FINANCIAL_DATA'
    WHEN regexp_matches(k, 'PASSPORT|LICENSE|LICENCE|SOCIAL|SSN|TAX|IDCARD|ID_CARD|IDENTITY|NATIONAL|PIN|PASSWORD|USERNAME') THEN 'IDENTITY_DATA'
    WHEN regexp_matches(k, 'HEALTH|MEDICAL|MEDICATION|CONDITION|BLOOD|INSURANCE') THEN 'HEALTH_DATA'
    WHEN regexp_matches(k, 'ADDRESS|STREET|CITY|ZIP|POSTAL|BUILDING|LOCATION|COUNTY|STATE') THEN 'LOCATION'
    WHEN regexp_matches(k, 'EMAIL|PHONE|TELEPHONE|MOBILE|FAX|IP_ADDRESS|IPV4|IPV6|MAC') THEN 'CONTACT'
    WHEN regexp_matches(k, 'PERSON|NAME|SURNAME|GIVENNAME|FIRSTNAME|LASTNAME|AGE|DOB|DATE_OF_BIRTH|GENDER|SEX') THEN 'PERSON' ELSE 'PERSONAL_DATA' END AS family
    FROM (SELECT finding_no, upper(regexp_replace(regexp_replace(model_label, '^(?i)[BIES]-', ''), '[\\s-]+', '_', 'g')) AS k FROM safety_findings WHERE model_label IS NOT NULL)"""
)
def label_families(spark, d):
    f = table(spark, d, "safety_findings").filter("model_label IS NOT NULL")
    return f.select("finding_no", entities.family(entities.label_key(F.col("model_label")))["placeholder"].alias("family"))


# ---- conversion, assets, paging ----------------------------------------------------


def _converted(mode):
    def run(spark, d):
        return convert(table(spark, d, "documents", spread=True), "doc_id", "text", mode).select("doc_id", "text", F.size("references").alias("n_references"), "broken")

    run.__name__ = f"convert_{mode}"
    return query()(run)


for _mode in ("plain", "readable", "ai"):
    _converted(_mode)


_LINK_RE2 = r"""(!?)\[([^\]]*)\](?:\(\s*(?:<([^>]+)>|([^)\s]+))(?:\s+(?:"[^"]*"|''[^'']*''|\([^)]*\)))?\s*\)|\[([^\]]*)\])"""
_DEFINED = r"""^\s{0,3}\[([^\]]+)\]:\s*(?:<([^>]+)>|(\S+))(?:\s+(?:"[^"]*"|''[^'']*''|\([^)]*\)))?\s*$"""
_LABEL = lambda c: f"lower(regexp_replace(trim({c}, E' \\t\\n\\r'), '\\s+', ' ', 'g'))"
#: Links of documents without fenced code: u has the place, kind and address of each use, bad the labels that lead nowhere.
_LINKS = f"""ln AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line, unnest(range(1, len(string_split(t, chr(10))) + 1)) AS n FROM (SELECT doc_id, regexp_replace(text, '\\r\\n?', chr(10), 'g') AS t FROM documents WHERE text <> '')),
    df AS (SELECT doc_id, {_LABEL(f"regexp_extract(line, '{_DEFINED}', 1)")} AS label, arg_max(regexp_extract(line, '{_DEFINED}', 2) || regexp_extract(line, '{_DEFINED}', 3), n) AS url FROM ln WHERE regexp_matches(line, '{_DEFINED}') GROUP BY ALL),
    tx AS (SELECT * FROM ln WHERE NOT regexp_matches(line, '{_DEFINED}')),
    mt AS (SELECT doc_id, n, i, ms[i] AS m FROM (SELECT doc_id, n, ms, unnest(range(1, len(ms) + 1)) AS i FROM (SELECT doc_id, n, regexp_extract_all(line, '{_LINK_RE2}') AS ms FROM tx))),
    pt AS (SELECT doc_id, n, i, CASE WHEN regexp_extract(m, '{_LINK_RE2}', 1) = '!' THEN 'image' ELSE 'link' END AS kind, regexp_extract(m, '{_LINK_RE2}', 2) AS label, regexp_extract(m, '{_LINK_RE2}', 3) || regexp_extract(m, '{_LINK_RE2}', 4) AS url, regexp_extract(m, '{_LINK_RE2}', 5) AS ref FROM mt),
    wt AS (SELECT *, CASE WHEN ref <> '' THEN ref WHEN label <> '' THEN label WHEN kind = 'image' THEN 'Image' ELSE 'Link' END AS wanted FROM pt),
    rs AS (SELECT wt.*, df.url AS found FROM wt LEFT JOIN df ON df.doc_id = wt.doc_id AND df.label = {_LABEL("wanted")}),
    sc AS (SELECT doc_id, 'link' AS kind, df.url FROM (SELECT doc_id, unnest(regexp_extract_all(regexp_replace(line, '{_LINK_RE2}', ' ', 'g'), '\\[([^\\]]+)\\]', 1)) AS l FROM tx) x JOIN df USING (doc_id) WHERE df.label = {_LABEL("x.l")}),
    u AS (SELECT doc_id, kind, trim(coalesce(nullif(rs.url, ''), found)) AS url FROM rs WHERE rs.url <> '' OR found IS NOT NULL UNION SELECT doc_id, kind, trim(url) FROM sc),
    bad AS (SELECT DISTINCT doc_id, wanted FROM rs WHERE url = '' AND found IS NULL)"""


@query(
    f"""WITH {_LINKS} SELECT doc_id, CAST(coalesce((SELECT count(*) FROM u WHERE u.doc_id = d.doc_id), 0) AS INTEGER) AS n_references, coalesce((SELECT string_agg(wanted, '|' ORDER BY wanted) FROM bad WHERE bad.doc_id = d.doc_id), '') AS broken,
    coalesce(text <> '', false) AS wrapped FROM documents d"""
)
def document_links(spark, d):
    """How many targets each document has, its labels that lead nowhere, and whether its agent form is wrapped."""
    c = convert(table(spark, d, "documents", spread=True), "doc_id", "text", "ai")
    wrapped = F.col("text").startswith("<untrusted_document>\n") & F.col("text").endswith("\n</untrusted_document>")
    return c.select("doc_id", F.size("references").alias("n_references"), F.array_join(F.sort_array("broken"), "|").alias("broken"), wrapped.alias("wrapped"))


def _inline(x: str) -> str:
    """Inline marks off a line, in their order, for text without code marks and entities. Marks of emphasis in runs begin and end nothing; other signs stand for them meanwhile."""
    steps = [("(?i)<br\\s*/?>", "\n"), ("<!--.*?-->", ""), ("<[^>]+>", ""), ("~~([^~]+)~~", "\\1"), ("\\*\\*([^*]+)\\*\\*", "\\1"), ("__([^_]+)__", "\\1")]
    for mark, sign in (("\\*", "\x01"), ("_", "\x02")):
        steps += [(mark + mark, sign * 2), (sign + mark, sign * 2), (f"{mark}([^{mark}\\n{sign}]+){mark}", "\\1"), (sign, mark[-1])]
    for pattern, to in (*steps, ("\\\\([\\\\`*{}\\[\\]()#+.!_>-])", "\\1")):
        x = f"regexp_replace({x}, '{pattern}', '{to}', 'g')"
    return x


_STRIP = lambda x: f"regexp_replace({x}, '^[{WS_RE2}]+|[{WS_RE2}]+$', '', 'g')"
_RTRIM = lambda x: f"rtrim({x}, E' \\t')"
_PLAIN_LINE = f"regexp_replace(q, '^(\\s*)[-+*]\\s+\\[[ xX]\\]\\s+', '\\1')"
_MARKED = f"regexp_replace(regexp_replace(q, '^(\\s*)[-+*]\\s+\\[[xX]\\]\\s+', '\\1☑ '), '^(\\s*)[-+*]\\s+\\[ \\]\\s+', '\\1☐ ')"
_TITLE = f"{_inline("regexp_replace(rtrim(regexp_extract(r, '^\\s{0,3}#{1,6}\\s+(.*)$', 1)), '\\s+#+$', '')")}"
_CELLS = f"""array_to_string(list_transform(string_split(regexp_replace(regexp_replace({_STRIP('r')}, '^\\|', ''), '\\|$', ''), '|'), lambda c: {_inline(_STRIP('c'))}), chr(9))"""


@query(
    f"""WITH {_LINKS}, k AS (SELECT doc_id, n, line, regexp_replace(line, '{_LINK_RE2}', '\\2', 'g') AS r, regexp_matches(line, '^\\s*(?:\\|\\s*)?:?-{{3,}}:?\\s*(?:\\|\\s*:?-{{3,}}:?\\s*)+\\|?\\s*$') AS divider,
        regexp_matches(line, '^\\s{{0,3}}(?:(?:\\*\\s*){{3,}}|(?:-\\s*){{3,}}|(?:_\\s*){{3,}})$') AS hr FROM tx),
    q AS (SELECT *, regexp_matches(r, '^\\s{{0,3}}#{{1,6}}\\s+') AS heading, regexp_matches(r, '^\\s*\\|.*\\|\\s*$') AS cells, regexp_replace(r, '^\\s{{0,3}}>\\s?', '') AS q0, regexp_replace(r, '^\\s{{0,3}}>\\s?', '│ ') AS q1 FROM k),
    o AS (SELECT doc_id, n, CASE WHEN divider OR hr THEN NULL WHEN heading THEN chr(10) || {_TITLE} || chr(10) WHEN cells THEN {_CELLS}
            WHEN regexp_matches(q0, '^\\s*[-+*]\\s+\\[[ xX]\\]\\s+') THEN {_RTRIM(_inline(_PLAIN_LINE.replace("(q,", "(q0,")))} ELSE {_RTRIM(_inline("regexp_replace(regexp_replace(q0, '^\\s*[-+*]\\s+', ''), '^\\s*[0-9]+[.)]\\s+', '')"))} END AS plain,
        CASE WHEN divider OR hr THEN NULL WHEN heading THEN chr(10) || {_TITLE} || chr(10) || repeat('─', least(greatest(length({_TITLE}), 3), 48)) || chr(10) WHEN cells THEN {_CELLS} ELSE {_RTRIM(_inline(_MARKED.replace("(q,", "(q1,")))} END AS readable,
        CASE WHEN divider THEN regexp_replace(line, '[{WS_RE2}]+$', '') ELSE regexp_replace(regexp_replace(r, '[{WS_RE2}]+$', ''), '^\\s{{0,3}}(#{{1,6}})\\s+', '\\1 ') END AS ai FROM q),
    j AS (SELECT doc_id, string_agg(plain, chr(10) ORDER BY n) FILTER (plain IS NOT NULL) AS plain, string_agg(readable, chr(10) ORDER BY n) FILTER (readable IS NOT NULL) AS readable, string_agg(ai, chr(10) ORDER BY n) AS ai FROM o GROUP BY doc_id),
    f AS (SELECT doc_id, {", ".join(f"{_STRIP(f"regexp_replace(coalesce({c}, ''), '\\n{{3,}}', chr(10) || chr(10), 'g')")} AS {c}" for c in ("plain", "readable", "ai"))} FROM j)
    SELECT d.doc_id, coalesce(plain, '') AS plain, coalesce(readable, '') AS readable, CASE WHEN coalesce(ai, '') = '' THEN '' ELSE '<untrusted_document>' || chr(10) || ai || chr(10) || '</untrusted_document>' END AS ai FROM documents d LEFT JOIN f USING (doc_id)"""
)
def convert_bodies(spark, d):
    """Each document in the three forms, without lists of references."""
    docs = table(spark, d, "documents", spread=True).select("doc_id", "text")
    modes = F.explode(F.array(*map(F.lit, ("plain", "readable", "ai")))).alias("mode")
    each = docs.select("doc_id", "text", modes).withColumn("key", F.struct("doc_id", "mode"))
    c = convert(each, "key", "text", mode_col="mode", append_references=False)
    forms = c.groupBy(F.col("doc_id.doc_id").alias("doc_id")).agg(*[F.max(F.when(F.col("doc_id.mode") == m, F.col("text"))).alias(m) for m in ("plain", "readable", "ai")])
    return forms


@query(f"WITH {_LINKS} SELECT doc_id, kind, url FROM u")
def document_targets(spark, d):
    return references(convert(table(spark, d, "documents", spread=True), "doc_id", "text")).select("doc_id", "kind", "url")


@query()
def document_references(spark, d):
    return references(convert(table(spark, d, "documents", spread=True), "doc_id", "text"))


@query()
def document_assets(spark, d):
    docs = table(spark, d, "documents", spread=True).select("doc_id", "text")
    return assets.assets(docs, convert(docs, "doc_id", "text"))


@query(
    """SELECT doc_id, value, min(start_pos) AS first_pos FROM (SELECT doc_id, v[i] AS value, CAST(list_sum(list_transform(g[1:i], lambda s: length(s))) + coalesce(list_sum(list_transform(v[1:i - 1], lambda s: length(s))), 0) AS INTEGER) AS start_pos
    FROM (SELECT *, unnest(range(1, len(v) + 1)) AS i FROM (SELECT doc_id, string_split_regex(text, 'https?://[^ \\t\\r\\n)>]+') AS g, regexp_extract_all(text, 'https?://[^ \\t\\r\\n)>]+') AS v FROM documents WHERE text IS NOT NULL))) GROUP BY ALL"""
)
def linked_addresses(spark, d):
    m = F.explode(text.matches(F.col("text"), r"https?://[^ \t\r\n)>]+")).alias("m")
    return table(spark, d, "documents").filter("text IS NOT NULL").select("doc_id", m).groupBy("doc_id", "m.value").agg(F.min("m.start_pos").alias("first_pos"))


#: Pages of a thousand characters; no page of the test tables reaches the bound of its JSON before (a stated case does).
_CURSORS = """SELECT doc_id, CAST(c // 1000 AS INTEGER) AS page_no, CAST(c AS INTEGER) AS cursor, CAST(CASE WHEN c + 1000 < total THEN c + 1000 END AS INTEGER) AS next_cursor, CAST(total AS INTEGER) AS total, substr(t, CAST(c + 1 AS BIGINT), 1000) AS text
    FROM (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS total, unnest(range(0, greatest(1, length(coalesce(text, ''))), 1000)) AS c FROM documents)"""


@query(_CURSORS)
def text_cursors(spark, d):
    return paging.text_cursors(table(spark, d, "documents"), "doc_id", "text")


@query(_CURSORS)
def text_pages(spark, d):
    return paging.text_pages(table(spark, d, "documents", spread=True), "doc_id", "text")


@query(
    rf"""WITH p AS (SELECT doc_id, list_transform(string_split_regex(regexp_replace(text, '\r\n?', chr(10), 'g'), '\n\n+'), lambda x: regexp_replace(x, '^[{WS_RE2}]+|[{WS_RE2}]+$', '', 'g')) AS ps FROM documents)
    SELECT doc_id, CASE WHEN ps IS NULL THEN '' ELSE regexp_replace(regexp_replace(regexp_replace(array_to_string(ps, chr(10) || chr(10)), '[ \t]+\n', chr(10), 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '^[{WS_RE2}]+|[{WS_RE2}]+$', '', 'g') END AS text FROM p"""
)
def html_pages(spark, d):
    """Documents in the form of a page, back to Markdown."""
    t = F.regexp_replace(F.regexp_replace(F.regexp_replace("text", "&", "&amp;"), "<", "&lt;"), "\n\n+", "</p><p>")
    src = table(spark, d, "documents", spread=True).select("doc_id", F.concat(F.lit("<html><body><p>"), t, F.lit("</p></body></html>")).alias("html"))
    return html.pages_to_markdown(src, "doc_id", "html")


@query()
def budget_chunks(spark, d):
    return entities.chunk_documents(table(spark, d, "documents", spread=True), "doc_id", "text", budget=128, overlap=16)


@query(
    "SELECT doc_id, true AS within_budget, true AS text_right, true AS overlaps, true AS covered FROM documents WHERE text <> ''"
)
def chunk_invariants(spark, d):
    """Whether the chunks of each document keep the budget, carry the text at their offsets, overlap and cover it."""
    c = entities.chunk_documents(table(spark, d, "documents", spread=True).filter("text <> ''"), "doc_id", "text", budget=128, overlap=16)
    own = Window.partitionBy("doc_id").orderBy("text_offset")
    c = c.withColumn("before", F.lag(F.col("text_offset") + F.length("text")).over(own)).withColumnRenamed("text", "chunk").join(table(spark, d, "documents").select("doc_id", "text"), "doc_id")
    return c.groupBy("doc_id").agg(
        F.bool_and(F.col("token_count") <= 128).alias("within_budget"), F.bool_and(F.expr("substring(text, text_offset + 1, length(chunk)) = chunk")).alias("text_right"),
        F.bool_and(F.col("before").isNull() | (F.col("text_offset") <= F.col("before"))).alias("overlaps"), ((F.min("text_offset") == 0) & (F.max(F.col("text_offset") + F.length("chunk")) == F.first(F.length("text")))).alias("covered"),
    )


@query()
def language_guess(spark, d):
    return language.detect(table(spark, d, "documents", spread=True), "doc_id", "text")


@query(
    """SELECT d.doc_id, CASE lower(s.default_lang) WHEN 'eng' THEN 'English' WHEN 'fra' THEN 'French' WHEN 'deu' THEN 'German' WHEN 'spa' THEN 'Spanish' WHEN 'ita' THEN 'Italian' WHEN 'nld' THEN 'Dutch' WHEN 'por' THEN 'Portuguese' END AS label
    FROM documents d LEFT JOIN sources s ON d.source = s.source"""
)
def source_language(spark, d):
    names = F.create_map(*[F.lit(x) for kv in language.LANGUAGES.items() for x in kv])
    s = table(spark, d, "sources").select("source", names[F.lower("default_lang")].alias("label"))
    return table(spark, d, "documents").select("doc_id", "source").join(s, "source", "left").select("doc_id", "label")


@query(
    rf"""WITH {LATEST}, b AS (SELECT DISTINCT handoff_id, markdown, unnest(broken) AS label FROM h WHERE markdown IS NOT NULL)
    SELECT handoff_id, label, CAST(instr(markdown, '[' || label || ']') - 1 AS INTEGER) AS start_pos,
    CAST(length(regexp_replace(markdown, '[{WS_RE2}]+$', '')) + length(label) + length('https://docs.example/') + 8 AS BIGINT) AS fixed_length FROM b WHERE label IS NOT NULL"""
)
def broken_references(spark, d):
    """Where the stored broken labels stand, and the length of the note once each is defined."""
    b = latest_handoffs(spark, d).filter("markdown IS NOT NULL").select("handoff_id", "markdown", F.explode("broken").alias("label")).filter("label IS NOT NULL").distinct()
    fixed = editing.fix_reference(F.col("markdown"), F.col("label"), F.lit(" https://docs.example/ "))
    return b.select("handoff_id", "label", editing.locate_reference(F.col("markdown"), F.col("label")).alias("start_pos"), F.length(fixed).cast("bigint").alias("fixed_length"))


@query(
    rf"""WITH {LATEST}, p AS (SELECT handoff_id, regexp_replace(regexp_replace(markdown, '[{WS_RE2}]+', ' ', 'g'), '^ | $', '', 'g') AS t FROM h WHERE markdown IS NOT NULL)
    SELECT handoff_id, substr(t, 1, 120) AS preview, length(t) > 120 AS truncated FROM p"""
)
def note_previews(spark, d):
    v = editing.truncated(editing.preview(F.col("markdown")), 120)
    return latest_handoffs(spark, d).filter("markdown IS NOT NULL").select("handoff_id", v["value"].alias("preview"), v["truncated"].alias("truncated"))


@query(
    rf"""WITH {LATEST}, n AS (SELECT handoff_id, count(*) AS n, count(*) FILTER (origin = 'local-ai') AS m FROM safety_findings WHERE handoff_id IS NOT NULL GROUP BY handoff_id)
    SELECT h.handoff_id, CAST(length(coalesce(markdown, '')) AS BIGINT) AS markdown_length, CAST(len(regexp_extract_all(coalesce(markdown, ''), '[^{WS_RE2}]+')) AS BIGINT) AS word_count,
    CAST(length(coalesce(plain_text, '')) AS BIGINT) AS output_length, conversion_mode, coalesce(append_references, false) AS append_references, CAST(coalesce(len(import_warnings), 0) AS BIGINT) AS warning_count,
    CAST(coalesce(len(broken), 0) AS BIGINT) AS broken_count, CAST(coalesce(n.n, 0) AS BIGINT) AS finding_count, CAST(coalesce(n.m, 0) AS BIGINT) AS model_finding_count, deep_scan_status,
    coalesce(human_approved, false) AS human_approved FROM h LEFT JOIN n USING (handoff_id)"""
)
def document_state(spark, d):
    """Counts and settings of each note, never its text."""
    s = handoff.summarise(latest_handoffs(spark, d), "conversion_mode")
    f = table(spark, d, "safety_findings").filter("handoff_id IS NOT NULL").groupBy("handoff_id").agg(F.count("*").alias("n"), F.count_if(F.col("origin") == "local-ai").alias("m"))
    return s.join(f, "handoff_id", "left").select(
        "handoff_id", F.col("input_characters").alias("markdown_length"), "word_count", F.col("output_characters").alias("output_length"), "conversion_mode", F.col("references_appended").alias("append_references"),
        "warning_count", "broken_count", F.coalesce("n", F.lit(0)).alias("finding_count"), F.coalesce("m", F.lit(0)).alias("model_finding_count"), "deep_scan_status", "human_approved",
    )


# ---- readiness -----------------------------------------------------------------------

_FILLED = lambda c: f"coalesce(regexp_matches({c}, '[^{WS_RE2}]'), false)"


@query(
    f"""WITH {LATEST}, s AS (SELECT handoff_id, {_FILLED("markdown")} AS has_document, {_FILLED("plain_text")} AS has_converted_output, coalesce(conversion_mode = 'ai', false) AS ai_ready_mode,
    coalesce(deep_scan_status = 'complete', false) AS deep_scan_complete, coalesce(human_approved, false) AS human_approved, CAST(length(coalesce(markdown, '')) AS BIGINT) AS input_characters,
    CAST(len(regexp_extract_all(coalesce(markdown, ''), '[^{WS_RE2}]+')) AS BIGINT) AS word_count, CAST(coalesce(reference_count, 0) AS BIGINT) AS reference_count,
    CAST(coalesce(len(broken), 0) AS BIGINT) AS broken_count, CAST(coalesce(len(import_warnings), 0) AS BIGINT) AS warning_count, CAST(coalesce(len(findings), 0) AS BIGINT) AS finding_count,
    CAST(coalesce(len(list_filter(findings, lambda f: f.severity = 'high')), 0) AS BIGINT) AS high_count FROM h),
    c AS (SELECT *, has_document AND has_converted_output AND ai_ready_mode AND deep_scan_complete AND finding_count = 0 AND broken_count = 0 AS content_checks_pass FROM s)
    SELECT *, CASE WHEN NOT has_document THEN 'empty' WHEN content_checks_pass AND human_approved THEN 'ready' ELSE 'review' END AS readiness,
    CASE WHEN NOT has_document THEN 'Waiting for a document' WHEN content_checks_pass AND human_approved THEN 'Approved for an agent-assisted handoff' WHEN human_approved THEN 'Approved with unresolved checks'
    WHEN content_checks_pass THEN 'Human approval is the last step' ELSE 'Human review is still needed' END AS headline FROM c"""
)
def handoff_summary(spark, d):
    s = handoff.summarise(latest_handoffs(spark, d))
    return s.select(
        "handoff_id", "has_document", "has_converted_output", "ai_ready_mode", "deep_scan_complete", "human_approved", "input_characters", "word_count", "reference_count",
        "broken_count", "warning_count", "finding_count", "high_count", "content_checks_pass", "readiness", "headline",
    )


@query(
    f"""WITH {LATEST}, s AS (SELECT handoff_id, {_FILLED("markdown")} AS doc, {_FILLED("plain_text")} AS outp, coalesce(conversion_mode = 'ai', false) AS ai, coalesce(deep_scan_status = 'complete', false) AS deep,
    coalesce(human_approved, false) AS ok, coalesce(len(broken), 0) AS b, coalesce(len(import_warnings), 0) AS w, coalesce(len(findings), 0) AS f FROM h), c AS (SELECT *, doc AND outp AND ai AND deep AND f = 0 AND b = 0 AS pass FROM s)
    SELECT handoff_id, CAST(CASE WHEN NOT doc THEN 1 ELSE 0 END + CASE WHEN doc AND NOT outp THEN 1 ELSE 0 END + CASE WHEN doc AND NOT ai THEN 1 ELSE 0 END + CASE WHEN doc AND NOT deep THEN 1 ELSE 0 END + CASE WHEN f > 0 THEN 1 ELSE 0 END
    + CASE WHEN b > 0 THEN 1 ELSE 0 END + CASE WHEN w > 0 THEN 1 ELSE 0 END + CASE WHEN pass AND NOT ok THEN 1 ELSE 0 END + CASE WHEN ok AND NOT pass THEN 1 ELSE 0 END + CASE WHEN pass AND ok THEN 1 ELSE 0 END AS BIGINT) AS n_steps FROM c"""
)
def handoff_steps(spark, d):
    return handoff.summarise(latest_handoffs(spark, d)).select("handoff_id", F.size("next_steps").cast("bigint").alias("n_steps"))


_MANY = lambda n, one: f"'Review ' || {n} || ' {one}' || CASE WHEN {n} = 1 THEN '' ELSE 's' END"


@query(
    f"""WITH {LATEST}, s AS (SELECT handoff_id, {_FILLED("markdown")} AS doc, {_FILLED("plain_text")} AS outp, coalesce(conversion_mode = 'ai', false) AS ai, coalesce(deep_scan_status = 'complete', false) AS deep,
    coalesce(human_approved, false) AS ok, coalesce(len(broken), 0) AS b, coalesce(len(import_warnings), 0) AS w, coalesce(len(findings), 0) AS f FROM h), c AS (SELECT *, doc AND outp AND ai AND deep AND f = 0 AND b = 0 AS pass FROM s)
    SELECT handoff_id, array_to_string(list_filter([CASE WHEN NOT doc THEN 'Paste or import a document.' END, CASE WHEN doc AND NOT outp THEN 'Check the converted output before handing it to an agent.' END,
    CASE WHEN doc AND NOT ai THEN 'Set AI-ready mode for structured, clearly delimited context.' END, CASE WHEN doc AND NOT deep THEN 'Run the deep local privacy scan and review its findings.' END,
    CASE WHEN f > 0 THEN {_MANY("f", "local safety finding")} || ' before sharing.' END, CASE WHEN b > 0 THEN {_MANY("b", "broken reference")} || '.' END, CASE WHEN w > 0 THEN 'Review import warnings for reading-order or OCR limitations.' END,
    CASE WHEN pass AND NOT ok THEN 'Review the visible output, then approve the handoff in Insights before an agent can read content, copy, or export.' END,
    CASE WHEN ok AND NOT pass THEN 'Human approval was granted with unresolved checks; the agent may access this exact version, but readiness remains in review.' END,
    CASE WHEN pass AND ok THEN 'The visible document is approved for agent-assisted access and export.' END], lambda x: x IS NOT NULL), chr(10)) AS steps FROM c"""
)
def handoff_step_texts(spark, d):
    return handoff.summarise(latest_handoffs(spark, d)).select("handoff_id", F.array_join("next_steps", "\n").alias("steps"))


_FIELD = lambda c, value: f"""CASE WHEN {c} IS NOT NULL THEN '"{c}":' || {value} END"""


@query(
    f"""WITH {LATEST} SELECT handoff_id, '{{' || array_to_string(list_filter([{", ".join([*(_FIELD(c, f"CAST(to_json({c}) AS VARCHAR)") for c in ("markdown", "plain_text", "conversion_mode", "append_references", "broken")),
    """'"finding_ids":' || CAST(to_json(list_transform(coalesce(findings, []), lambda f: f.id)) AS VARCHAR)""", *(_FIELD(c, f"CAST(to_json({c}) AS VARCHAR)") for c in ("deep_scan_status", "import_warnings"))])}], lambda x: x IS NOT NULL), ',') || '}}' AS snapshot FROM h"""
)
def handoff_snapshots(spark, d):
    return handoff.approval_snapshot(latest_handoffs(spark, d))


# ---- recognised pages ----------------------------------------------------------------

_VISIBLE = "v AS (SELECT DISTINCT ON (doc_id, page, line, pos) doc_id, page, line, pos, trim(text) AS text, x0, y0, x1, y1, image_width, image_height FROM ocr_words WHERE trim(text) <> '')"


@query(
    f"""WITH {_VISIBLE}, u AS (SELECT *, sum(length(text) + 1) OVER (PARTITION BY doc_id, page ORDER BY line, pos) AS upto FROM v)
    SELECT doc_id, page, line, pos, text, CAST(upto - 1 - length(text) AS INTEGER) AS start_pos, CAST(upto - 1 AS INTEGER) AS end_pos FROM u"""
)
def ocr_offsets(spark, d):
    return ocr.mapped_words(table(spark, d, "ocr_words")).select("doc_id", "page", "line", "pos", "text", "start_pos", "end_pos")


@query(
    f"""WITH {_VISIBLE}, l AS (SELECT doc_id, page, line, string_agg(text, ' ' ORDER BY pos) AS t FROM v GROUP BY ALL) SELECT doc_id, page, string_agg(t, chr(10) ORDER BY line) AS text FROM l GROUP BY ALL"""
)
def ocr_page_text(spark, d):
    return ocr.page_text(table(spark, d, "ocr_words"))


@query(
    f"""WITH {_VISIBLE}, b AS (SELECT doc_id, page, line, least(1, greatest(0, x0 / image_width)) AS l, least(1, greatest(0, y0 / image_height)) AS t, least(1, greatest(0, x1 / image_width)) AS r, least(1, greatest(0, y1 / image_height)) AS b FROM v WHERE image_width > 0 AND image_height > 0),
    g AS (SELECT doc_id, page, line, min(l) AS l, min(t) AS t, max(r) AS r, max(b) AS b FROM b WHERE r > l AND b > t GROUP BY ALL)
    SELECT doc_id, page, line, round(greatest(0, l - 0.004), 6) AS x, round(greatest(0, t - 0.004), 6) AS y, round(least(1, r + 0.004) - greatest(0, l - 0.004), 6) AS width, round(least(1, b + 0.004) - greatest(0, t - 0.004), 6) AS height FROM g"""
)
def ocr_line_boxes(spark, d):
    boxes = ocr.line_boxes(ocr.unit_boxes(ocr.mapped_words(table(spark, d, "ocr_words"))), ["doc_id", "page", "line"])
    return boxes.select("doc_id", "page", "line", *[F.round(c, 6).alias(c) for c in ("x", "y", "width", "height")])


_PAGES = f"(WITH {_VISIBLE}, l AS (SELECT doc_id, page, line, string_agg(text, ' ' ORDER BY pos) AS t FROM v GROUP BY ALL) SELECT doc_id || ':' || page AS key, string_agg(t, chr(10) ORDER BY line) AS text FROM l GROUP BY doc_id, page)"


@query(
    f"""WITH {oracles._found(_PAGES, "key", "text")}, {_VISIBLE}, u AS (SELECT *, sum(length(text) + 1) OVER (PARTITION BY doc_id, page ORDER BY line, pos) - 1 AS z FROM v),
    x AS (SELECT u.doc_id, u.page, fd.id, u.line, least(1, greatest(0, x0 / image_width)) AS l, least(1, greatest(0, y0 / image_height)) AS t, least(1, greatest(0, x1 / image_width)) AS r, least(1, greatest(0, y1 / image_height)) AS b
        FROM fd JOIN u ON fd.k = u.doc_id || ':' || u.page AND u.z - length(u.text) < fd.end_pos AND fd.start_pos < u.z WHERE image_width > 0 AND image_height > 0),
    g AS (SELECT doc_id, page, id, line, min(l) AS l, min(t) AS t, max(r) AS r, max(b) AS b FROM x WHERE r > l AND b > t GROUP BY ALL)
    SELECT doc_id, page, id, line, round(greatest(0, l - 0.004), 6) AS x, round(greatest(0, t - 0.004), 6) AS y, round(least(1, r + 0.004) - greatest(0, l - 0.004), 6) AS width, round(least(1, b + 0.004) - greatest(0, t - 0.004), 6) AS height FROM g"""
)
def ocr_suggestions(spark, d):
    """Boxes for what the scanner finds on recognised pages."""
    words = ocr.mapped_words(table(spark, d, "ocr_words"))
    pages = ocr.page_text(table(spark, d, "ocr_words")).withColumn("key", F.struct("doc_id", "page"))
    found = scan(pages, "key", "text").select("doc_id.doc_id", "doc_id.page", "id", "start_pos", "end_pos")
    return ocr.suggestions(found, words).select("doc_id", "page", "id", "line", *[F.round(c, 6).alias(c) for c in ("x", "y", "width", "height")])


@query(
    """SELECT DISTINCT doc_id, page, 'Page ' || page || ' OCR confidence was ' || CAST(floor(confidence + 0.5) AS BIGINT) || '%' AS warning FROM ocr_results WHERE confidence < 88"""
)
def ocr_warnings(spark, d):
    """Pages below 88: the test pages have none below the usual bound."""
    return ocr.low_confidence_warnings(table(spark, d, "ocr_results"), 88).distinct()


@query(
    """WITH i AS (SELECT DISTINCT ON (doc_id, page, line, pos) doc_id, page, pos, text AS t, x0 AS x, -y0 AS y FROM ocr_words WHERE trim(text) <> ''),
    r AS (SELECT doc_id, page, floor(y / 3 + 0.5) * 3 AS k, trim(regexp_replace(string_agg(t, ' ' ORDER BY x, t), '\\s+', ' ', 'g')) AS t FROM i GROUP BY ALL)
    SELECT doc_id, page, string_agg(t, chr(10) ORDER BY k DESC, t) AS text FROM r WHERE t <> '' GROUP BY ALL"""
)
def layout_rows(spark, d):
    items = table(spark, d, "ocr_words").filter("trim(text) <> ''").dropDuplicates(["doc_id", "page", "line", "pos"])
    return ocr.layout_rows(items.select("doc_id", "page", "text", F.col("x0").alias("x"), (-F.col("y0")).alias("y")))


# ---- usage ---------------------------------------------------------------------------


def _requests(spark, d) -> DataFrame:
    return _as_requests(table(spark, d, "events"))


def _as_requests(events: DataFrame) -> DataFrame:
    """The events table as usage requests: each event type stands for a usage event, some for none; some come the wrong way."""
    names = {"view": "page_view", "click": "button_click", "purchase": "export_file", "signup": "document_import"}
    event = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])[F.col("event_type")]
    body = F.to_json(F.struct(F.coalesce(event, F.col("event_type")).alias("event"), F.when(F.col("event_type") == "click", F.lit("export_docx")).alias("button"), F.when(F.col("user_id") % 2 == 0, "import").alias("feature")))
    wrong = lambda n, bad, good: F.when(F.col("event_id") % n == 1, bad).otherwise(good)
    return events.select(
        "event_id", "ts", wrong(11, "GET", "POST").alias("method"), F.concat(F.lit("https://app.example"), wrong(13, "/api/other", "/api/usage")).alias("url"),
        wrong(17, "https://other.example", "https://app.example").alias("origin"), wrong(19, "text/plain", "application/json").alias("content_type"), body.alias("body"),
    )


_STATUS = "CASE WHEN event_id % 13 = 1 THEN 404 WHEN event_id % 11 = 1 THEN 405 WHEN event_id % 17 = 1 THEN 403 WHEN event_id % 19 = 1 THEN 415 WHEN event_type = 'error' THEN 400 ELSE 204 END"


@query(f"SELECT event_id, {_STATUS} AS status FROM events")
def usage_admission(spark, d):
    return usage.admit(_requests(spark, d)).select("event_id", "status")


@query(
    f"""SELECT CAST(ts AS DATE) AS day, CASE event_type WHEN 'view' THEN 'page_view' WHEN 'click' THEN 'button_click' WHEN 'purchase' THEN 'export_file' ELSE 'document_import' END AS event,
    CASE WHEN user_id % 2 = 0 THEN 'import' ELSE 'none' END AS feature, CAST(count(*) AS BIGINT) AS n FROM events WHERE {_STATUS} = 204 GROUP BY ALL"""
)
def usage_daily(spark, d):
    ok = usage.admit(_requests(spark, d)).filter("status = 204")
    return usage.counts(ok.select(F.to_date("ts").alias("day"), "event", F.coalesce("feature", F.lit("none")).alias("feature")), "day", "event", "feature")


@query(
    f"""SELECT event AS index, event || ',' || feature || ',none,none,none,' || CASE WHEN event = 'button_click' THEN 'export_docx' ELSE 'none' END AS blobs, CAST(1.0 AS DOUBLE) AS double
    FROM (SELECT CASE event_type WHEN 'view' THEN 'page_view' WHEN 'click' THEN 'button_click' WHEN 'purchase' THEN 'export_file' ELSE 'document_import' END AS event, CASE WHEN user_id % 2 = 0 THEN 'import' ELSE 'none' END AS feature FROM events WHERE {_STATUS} = 204)"""
)
def usage_points(spark, d):
    return usage.data_points(usage.admit(_requests(spark, d))).select("index", F.array_join("blobs", ",").alias("blobs"), F.col("doubles")[0].alias("double"))


# ---- streams -------------------------------------------------------------------------
#
# Each reads a table as a stream to its end; what a watermark still holds back is not given, and SQL leaves it out too.



def _events_stream(spark, d) -> DataFrame:
    return stream_table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


_END = "(SELECT max(ts) - INTERVAL 10 MINUTE FROM events)"
_USAGE_EVENT = "CASE event_type WHEN 'view' THEN 'page_view' WHEN 'click' THEN 'button_click' WHEN 'purchase' THEN 'export_file' ELSE 'document_import' END"


@query(
    f"""WITH u AS (SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS window_start, {_USAGE_EVENT} AS event, CASE WHEN user_id % 2 = 0 THEN 'import' ELSE 'none' END AS feature, CASE WHEN event_type = 'click' THEN 'export_docx' ELSE 'none' END AS button FROM events WHERE {_STATUS} = 204)
    SELECT strftime(window_start, '%Y-%m-%d %H:%M:%S') AS window_start, event, feature, button, CAST(count(*) AS BIGINT) AS n FROM u WHERE window_start + INTERVAL 5 MINUTE <= {_END} GROUP BY u.window_start, event, feature, button"""
)
def stream_usage_counts(spark, d):
    got = drained(pipelines.usage_counts(_as_requests(_events_stream(spark, d))))
    return got.select(F.date_format("window.start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "event", "feature", "button", "n")


@query("SELECT DISTINCT user_id AS session, event_type AS event FROM events")
def stream_first_events(spark, d):
    """Each event of a session once."""
    e = _events_stream(spark, d).select(F.col("user_id").alias("session"), F.col("event_type").alias("event"), "ts")
    return drained(pipelines.once_per_session(e, late="4000 days")).select("session", "event")


@query(
    f"""WITH e AS (SELECT user_id AS doc_id, ts, event_type || ' edit ' || event_id AS text FROM events), s AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY doc_id ORDER BY ts) <= INTERVAL 1200 MILLISECOND THEN 0 ELSE 1 END AS new FROM e),
    b AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY ts) AS burst FROM s) SELECT doc_id, arg_max(text, ts) AS text FROM b GROUP BY doc_id, burst HAVING max(ts) + INTERVAL 1200 MILLISECOND <= {_END}"""
)
def stream_settled_edits(spark, d):
    """The last text of each burst of edits; each user's events stand for edits of a document."""
    e = _events_stream(spark, d).select(F.col("user_id").alias("doc_id"), F.concat_ws(" ", "event_type", F.lit("edit"), "event_id").alias("text"), "ts")
    return drained(pipelines.settled_edits(e)).select("doc_id", "text")


@query(
    rf"""SELECT doc_id, CAST(length(coalesce(text, '')) AS INTEGER) AS n_chars, CAST(len(regexp_extract_all(coalesce(text, ''), '[^{WS_RE2}]+')) AS BIGINT) AS n_words,
    CASE WHEN length(coalesce(text, '')) < 1000 THEN 'tiny' WHEN length(text) < 10000 THEN 'small' WHEN length(text) < 100000 THEN 'medium' ELSE 'large' END AS size_bucket FROM documents"""
)
def stream_document_statistics(spark, d):
    return drained(pipelines.document_statistics(stream_table(spark, d, "documents"))).drop("doc_fingerprint")


@query(oracles.all_findings("documents", "doc_id", "text"))
def stream_document_findings(spark, d):
    return drained(pipelines.document_findings(stream_table(spark, d, "documents"))).select("doc_id", "id", "type", "severity", "value", "start_pos", "end_pos", "line", "placeholder")


@query(
    f"""WITH {LATEST}, {oracles.FINGERPRINT.format(source="(SELECT handoff_id AS k, markdown AS x FROM h WHERE markdown IS NOT NULL)")}
    SELECT finding_no, handoff_id FROM safety_findings s WHERE EXISTS (SELECT 1 FROM fps WHERE fps.k = s.handoff_id AND fps.fp = s.doc_fingerprint)"""
)
def stream_current_results(spark, d):
    """Stored findings, arriving late, that belong to the present text of their note."""
    now = latest_handoffs(spark, d, "markdown").filter("markdown IS NOT NULL").select(F.col("handoff_id").alias("doc_id"), text.fingerprint(F.col("markdown")).alias("doc_fingerprint"))
    late = stream_table(spark, d, "safety_findings").select("finding_no", F.col("handoff_id").alias("doc_id"), "doc_fingerprint")
    return drained(pipelines.current_results(late, now)).select("finding_no", F.col("doc_id").alias("handoff_id"))


@query(
    """WITH c AS (SELECT user_id AS doc_id, event_id, event_type = 'purchase' AS approve, CAST(event_id % 3 AS VARCHAR) AS snapshot FROM events),
    l AS (SELECT doc_id, coalesce(arg_max(snapshot, event_id) FILTER (NOT approve), '') AS snapshot, coalesce(arg_max(snapshot, event_id) FILTER (approve), '') AS given FROM c GROUP BY doc_id)
    SELECT doc_id, snapshot <> '' AND snapshot = given AS approved, snapshot FROM l"""
)
def stream_approvals(spark, d):
    """Whether the present version of each document is approved; each user's events stand for edits and approvals."""
    c = stream_table(spark, d, "events").select(
        F.col("user_id").alias("doc_id"), F.col("event_id").alias("seq"), F.when(F.col("event_type") == "purchase", "approve").otherwise("edit").alias("kind"), (F.col("event_id") % 3).cast("string").alias("snapshot")
    )
    got = drained(pipelines.approvals(c), "update")
    return got.groupBy("doc_id").agg(F.max_by("approved", "batch").alias("approved"), F.max_by("snapshot", "batch").alias("snapshot"))


QUERIES |= fixtures.QUERIES
SQL |= fixtures.SQL
