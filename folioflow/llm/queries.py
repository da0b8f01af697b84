"""Queries of the training-text operators, by problem, and their SQL where SQL can say it."""

from __future__ import annotations

import secrets
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut_lineage, table
from .language import detect_languages
from .leakage import find_leaks
from .packing import fill_report, pack
from .personal_data import find_personal_data, redact_personal_data
from .scan_repair import Repair
from .splitting import split_oversized
from .text_quality import COMMON, text_statistics
from .visible_form import UNSEEN, default_tables, find_phrases, visible_form


def p1_pieces(spark: SparkSession, d: str) -> DataFrame:
    return split_oversized(table(spark, d, "pii_chunks", spread=True), once=True)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return split_oversized(table(spark, d, "pii_chunks", spread=True)).filter("oversized AND piece_no = 0").select("chunk_id").distinct()


def p1_invariants(spark: SparkSession, d: str) -> DataFrame:
    """For each chunk: whether its pieces keep the budget, carry the text at their offsets, cover it, and overlap as they should."""
    src = table(spark, d, "pii_chunks", spread=True).select("chunk_id", "text", "text_offset", "token_budget", "overlap_tokens").distinct()
    pieces = split_oversized(src).select("chunk_id", "piece_no", "n_pieces", F.col("text").alias("piece"), (F.col("piece_offset")).alias("at"), "token_count")
    rule = F.size(F.regexp_extract_all("piece", F.lit(r"[\p{L}\p{N}]{1,8}"), F.lit(0))) + F.size(F.regexp_extract_all("piece", F.lit(r"[^\p{L}\p{N} \t\r\n\u00A0]"), F.lit(0)))
    one = src.groupBy("chunk_id").agg(F.count("*").alias("n"), F.first("text").alias("text"), F.first(F.coalesce("text_offset", F.lit(0))).alias("base"), F.first("token_budget").alias("budget"), F.first("overlap_tokens").alias("over"))
    own = Window.partitionBy("chunk_id").orderBy("piece_no")
    met = pieces.withColumn("rule", rule).join(one.filter("n = 1"), "chunk_id")
    end = F.col("at") + F.length("piece")
    met = met.withColumns({"before_end": F.lag(end).over(own), "same": F.col("piece") == F.expr("substring(text, at - base + 1, length(piece))")})
    shared = F.expr("substring(text, at - base + 1, before_end - at)")
    tokens = F.size(F.regexp_extract_all(shared, F.lit(r"[\p{L}\p{N}]{1,8}"), F.lit(0))) + F.size(F.regexp_extract_all(shared, F.lit(r"[^\p{L}\p{N} \t\r\n\u00A0]"), F.lit(0)))
    met = met.withColumn("overlap_ok", F.col("before_end").isNull() | ((F.col("at") <= F.col("before_end")) & (tokens <= F.greatest("over", F.lit(0)))))
    return met.groupBy("chunk_id").agg(
        F.bool_and((F.col("rule") <= F.greatest("budget", F.lit(1))) | (F.col("n_pieces") == 1)).alias("within_budget"), F.bool_and(F.col("rule") == F.col("token_count")).alias("counts_right"),
        F.bool_and("same").alias("text_right"), F.bool_and("overlap_ok").alias("overlap_right"), ((F.min("at") == F.first("base")) & (F.max(end) == F.first("base") + F.length(F.first("text")))).alias("covered"),
    )


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    rules = table(spark, d, "scanner_rules").filter("NOT raw_only")
    handoff = find_phrases(table(spark, d, "handoff_inputs", spread=True), ["handoff_id"], "markdown", rules)
    source = find_phrases(table(spark, d, "normalized_sources", spread=True), ["source_id"], "text", rules)
    parts = [
        x.select(F.lit(o).alias("origin"), F.col(i).cast("bigint").alias("row_id"), F.col("rule_no").cast("int"))
        for x, o, i in ((handoff, "handoff", "handoff_id"), (source, "source", "source_id"))
    ]
    return parts[0].unionByName(parts[1]).distinct()


def p2_normalised_sources(spark: SparkSession, d: str) -> DataFrame:
    return visible_form(table(spark, d, "normalized_sources", spread=True).select("source_id", "text"), "text").select("source_id", "visible_text")


def p3_segments(spark: SparkSession, d: str) -> DataFrame:
    return detect_languages(table(spark, d, "documents", spread=True), "doc_id", "text", "lang")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return p3_segments(spark, d).filter("is_case AND counts").select("doc_id", "code").distinct()


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return Repair(table(spark, d, "ocr_words"), cut_lineage).defects()


def p4_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    return Repair(table(spark, d, "ocr_words"), cut_lineage).paragraphs()


#: Where the key of the pseudonyms comes from.
KEY_SETTING = "spark.folioflow.pseudonymKey"


def _key(spark: SparkSession) -> bytes:
    """The configured key; without one a new random key, so that pseudonyms link values within the query only and nobody can turn them back."""
    return spark.conf.get(KEY_SETTING, "").encode() or secrets.token_bytes(32)


def p5_findings(spark: SparkSession, d: str) -> DataFrame:
    return find_personal_data(table(spark, d, "handoff_inputs", spread=True), "handoff_id", "markdown", _key(spark))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """The findings of the five stated types; a date of birth is none of them."""
    return p5_findings(spark, d).filter("placeholder <> 'BIRTH_DATE'").select("handoff_id", "placeholder", "start_pos").distinct()


def p5_emails(spark: SparkSession, d: str) -> DataFrame:
    """The addresses of each note in their visible form, with how often each stands there."""
    found = p5_findings(spark, d).filter("placeholder = 'EMAIL'")
    shown = visible_form(found, "value", "email").select("handoff_id", "start_pos", "email").distinct()
    return shown.groupBy("handoff_id", F.regexp_replace("email", r"\s+", " ").alias("email")).agg(F.count("*").alias("places"))


def p5_redacted(spark: SparkSession, d: str) -> DataFrame:
    return redact_personal_data(table(spark, d, "handoff_inputs", spread=True), "handoff_id", "markdown", _key(spark))


def p6_pack(spark: SparkSession, d: str) -> DataFrame:
    return pack(table(spark, d, "documents", spread=True), table(spark, d, "pack_windows"))


def p6_fill(spark: SparkSession, d: str) -> DataFrame:
    return fill_report(p6_pack(spark, d))


def p6_invariants(spark: SparkSession, d: str) -> DataFrame:
    """For each window: its texts, and the containers over capacity and the texts cut though they fit (there are none of either)."""
    places = p6_pack(spark, d)
    over = places.groupBy("window_id", "capacity", "container").agg(F.sum("n_tokens").alias("n")).groupBy("window_id", "capacity").agg(F.count_if(F.col("n") > F.col("capacity")).alias("too_full"))
    texts = places.groupBy("window_id", "capacity", "doc_id").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("parts"))
    texts = texts.groupBy("window_id", "capacity").agg(F.count("*").alias("texts"), F.count_if((F.col("parts") > 1) & (F.col("n") <= F.col("capacity"))).alias("cut_though_fitting"))
    return texts.join(over, ["window_id", "capacity"])


def p7_leaks(spark: SparkSession, d: str) -> DataFrame:
    return find_leaks(table(spark, d, "documents", spread=True), table(spark, d, "heldout_items"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return p7_leaks(spark, d).select("doc_id", "item_id")


def p7_items(spark: SparkSession, d: str) -> DataFrame:
    """Each leaked item with the number of documents that leak it and the longest run."""
    return p7_leaks(spark, d).groupBy("item_id").agg(F.count("*").alias("n_docs"), F.max("longest_run").alias("longest_run"))


def p8_statistics(spark: SparkSession, d: str) -> DataFrame:
    return text_statistics(table(spark, d, "documents", spread=True), "doc_id", "text")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return p8_statistics(spark, d).filter("text_kind IN ('list', 'table', 'junk')").select("doc_id", "text_kind")


def p8_chunk_counts(spark: SparkSession, d: str) -> DataFrame:
    """The counts by small chunks and pieces, so that most documents go up the distributed tree."""
    src = table(spark, d, "documents", spread=True)
    return text_statistics(src, "doc_id", "text", chunk_chars=200, spread_chars=500).select("doc_id", "n_chars", "n_words", "n_word_chars", "n_common", "n_lines")


def p8_counts(spark: SparkSession, d: str) -> DataFrame:
    """The additive counts alone, which SQL can say too."""
    return p8_statistics(spark, d).select("doc_id", "n_chars", "n_words", "n_word_chars", "n_common", "n_lines")


_NO_UNSEEN = r"regexp_replace(text, '[\x{00AD}\x{034F}\x{061C}\x{180E}\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{2064}\x{FEFF}]', '', 'g')"
_MARKUP = r"'\]\([^()\s]*\)|\]\[[^\]\n]*\]|</?[A-Za-z][^<>\n]*>'"


def _grams(key: str, name: str) -> str:
    """The runs of ten words of a table's texts."""
    words = rf"regexp_extract_all(lower(regexp_replace({_NO_UNSEEN}, {_MARKUP}, ' ', 'g')), '[\p{{L}}\p{{N}}]+')"
    return f"SELECT {key}, array_to_string(w[i:i + 9], ' ') AS g, i, len(w) AS n FROM (SELECT {key}, w, unnest(range(1, len(w) - 8)) AS i FROM (SELECT {key}, {words} AS w FROM {name} WHERE text IS NOT NULL))"


def _visible_sql(column: str) -> str:
    """The consistent form in SQL, which replaces look-alikes in every word."""
    singles = {a: b for name, t in default_tables().items() if name != "unseen" for a, b in t.items() if len(b) == 1 and b != "'"}
    unseen = "".join(c if c == "-" else f"\\x{{{ord(c):04X}}}" for c in UNSEEN)
    plain = f"translate(regexp_replace({column}, '[{unseen}]', '', 'g'), '{''.join(singles)}', '{''.join(singles.values())}')"
    return f"regexp_replace(nfc_normalize({plain}), '\\s+', ' ', 'g')"


_P2 = f"""WITH t AS (SELECT 'handoff' AS origin, handoff_id AS row_id, markdown AS t FROM handoff_inputs UNION ALL SELECT 'source', source_id, text FROM normalized_sources),
    v AS (SELECT origin, row_id, t, {_visible_sql("t")} AS f FROM t WHERE t IS NOT NULL), r AS (SELECT rule_no, phrase, {_visible_sql("phrase")} AS p FROM scanner_rules WHERE NOT raw_only AND trim(phrase) <> '')
    SELECT DISTINCT origin, CAST(row_id AS BIGINT) AS row_id, CAST(rule_no AS INTEGER) AS rule_no FROM v JOIN r ON contains(f, p) AND NOT contains(t, phrase)"""

#: Lines that hold more than three marks, a word, dots that lead or cells; quote marks before them do not count.
_P8 = f"""SELECT doc_id, CAST(length(t) AS BIGINT) AS n_chars, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS n_word_chars,
    CAST(len(list_filter(w, lambda x: x IN ({", ".join("'" + x + "'" for x in sorted(COMMON))}))) AS BIGINT) AS n_common,
    CAST(len(list_filter(list_transform(string_split(t, chr(10)), lambda l: trim(regexp_replace(trim(l, E' \\t\u00a0'), '^(?:>\\s*)+', ''), E' \\t\u00a0')), lambda s: length(s) > 3 OR regexp_matches(s, '[\\p{{L}}\\p{{N}}]') OR regexp_matches(s, '…{{2,}}|^\\|.*\\|'))) AS BIGINT) AS n_lines
    FROM (SELECT doc_id, t, regexp_extract_all(lower(t), '[\\p{{L}}\\p{{N}}]+') AS w FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '\\r\\n?', chr(10), 'g') AS t FROM documents))"""

_LABEL = r"[\p{L}\p{N}](?:[\p{L}\p{N}_-]*[\p{L}\p{N}])?"
_DOT = r"(?:\.| ?[(\[{]dot[)\]}] ?| dot )"
_MAIL = rf"(?i)[\p{{L}}\p{{N}}](?:[\p{{L}}\p{{N}}_.%+-]*[\p{{L}}\p{{N}}_])?(?:@ ?| ?\(at\) ?| ?\[at\] ?| ?\{{at\}} ?){_LABEL}(?:{_DOT}{_LABEL})*{_DOT}[A-Za-z]{{2,24}}"
#: Each delivery of a note counts, but whole copies of its text once.
_P5_MAILS = f"""WITH t AS (SELECT DISTINCT handoff_id, markdown FROM handoff_inputs WHERE markdown IS NOT NULL), m AS (SELECT handoff_id, markdown, unnest(regexp_extract_all({_visible_sql("markdown")}, '{_MAIL}')) AS email FROM t)
    SELECT handoff_id, email, CAST(max(n) AS BIGINT) AS places FROM (SELECT handoff_id, markdown, email, count(*) AS n FROM m GROUP BY ALL) GROUP BY handoff_id, email"""

#: Runs of shared words: places that follow each other in both texts are one run.
_LEAKS = f"""d AS ({_grams('doc_id', 'documents')}), t AS ({_grams('item_id', 'heldout_items')}), m AS (SELECT DISTINCT doc_id, item_id, d.i AS p, d.i - t.i AS shift, t.n FROM d JOIN t USING (g)),
    r AS (SELECT *, p - row_number() OVER (PARTITION BY doc_id, item_id, shift ORDER BY p) AS run FROM m), w AS (SELECT doc_id, item_id, n, shift, run, count(*) + 9 AS words FROM r GROUP BY ALL),
    lk AS (SELECT doc_id, item_id, CAST(max(words) AS INTEGER) AS longest_run, CAST(max(n) AS INTEGER) AS item_words, CAST(count(*) AS INTEGER) AS places FROM w GROUP BY doc_id, item_id)"""

SQL = {
    "p7_leaks": f"WITH {_LEAKS} SELECT * FROM lk",
    "p7_items": f"WITH {_LEAKS} SELECT item_id, count(*) AS n_docs, max(longest_run) AS longest_run FROM lk GROUP BY item_id",
    "p5_emails": _P5_MAILS,
    "p2_found": _P2,
    "p1_found": "SELECT DISTINCT chunk_id FROM pii_chunks WHERE len(regexp_extract_all(text, '[\\p{L}\\p{N}]{1,8}')) + len(regexp_extract_all(text, '[^\\p{L}\\p{N} \\t\\r\\n\\x{00A0}]')) > token_budget",
    "p7_found": f"WITH d AS ({_grams('doc_id', 'documents')}), i AS ({_grams('item_id', 'heldout_items')}) SELECT DISTINCT doc_id, item_id FROM d JOIN i USING (g)",
    "p6_invariants": "SELECT window_id, capacity, CAST((SELECT count(DISTINCT doc_id) FROM documents WHERE text <> '') AS BIGINT) AS texts, CAST(0 AS BIGINT) AS cut_though_fitting, CAST(0 AS BIGINT) AS too_full FROM pack_windows WHERE capacity > 0",
    "p8_counts": _P8,
    "p8_chunk_counts": _P8,
    "p1_invariants": "SELECT chunk_id, true AS within_budget, true AS counts_right, true AS text_right, true AS overlap_right, true AS covered FROM (SELECT DISTINCT chunk_id, text, text_offset, token_budget, overlap_tokens FROM pii_chunks) GROUP BY chunk_id HAVING count(*) = 1",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "p1_found": p1_found,
        "p1_pieces": p1_pieces,
        "p1_invariants": p1_invariants,
        "p2_found": p2_found,
        "p2_normalised_sources": p2_normalised_sources,
        "p3_found": p3_found,
        "p3_segments": p3_segments,
        "p4_found": p4_found,
        "p4_paragraphs": p4_paragraphs,
        "p5_found": p5_found,
        "p5_findings": p5_findings,
        "p5_redacted": p5_redacted,
        "p5_emails": p5_emails,
        "p6_pack": p6_pack,
        "p6_fill": p6_fill,
        "p6_invariants": p6_invariants,
        "p7_found": p7_found,
        "p7_leaks": p7_leaks,
        "p7_items": p7_items,
        "p8_found": p8_found,
        "p8_statistics": p8_statistics,
        "p8_counts": p8_counts,
        "p8_chunk_counts": p8_chunk_counts,
    }


def oracle_sql() -> dict[str, str]:
    return SQL
