"""SQL that says what the scanner and redaction should give, for DuckDB over the same tables.

The folded form of a text and the rules are written again here in terms that SQL
has: no looking around, so a neighbour is matched along and taken off again.
"""

from __future__ import annotations

import unicodedata
from functools import cache

from .operators.rules import INVISIBLE, RULES, SEVERITY_RANK, TYPE_RANK

_W = r"\t\n\x0B\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
LATEST = "h AS (SELECT * FROM handoff_inputs QUALIFY row_number() OVER (PARTITION BY handoff_id ORDER BY received_at DESC NULLS LAST, markdown DESC NULLS LAST) = 1)"
VALID = "f AS (SELECT handoff_id, id, finding_no, doc_fingerprint, finding_type, severity, title, finding_value, start_pos, end_pos, placeholder, origin, confidence FROM safety_findings WHERE handoff_id IS NOT NULL AND id IS NOT NULL AND start_pos >= 0 AND end_pos > start_pos QUALIFY row_number() OVER (PARTITION BY handoff_id, id ORDER BY finding_no) = 1)"

#: Rule, pattern, which part is the value: all of it, a group inside, or a group that ends it; and what must hold for the value v.
_DIGITS = "regexp_replace(v, '[^0-9]', '', 'g')"
_LUHN = f"""length({_DIGITS}) BETWEEN 13 AND 19 AND NOT {_DIGITS} = repeat({_DIGITS}[1], length({_DIGITS})) AND list_sum(list_transform(range(1, length({_DIGITS}) + 1), lambda i:
    CASE WHEN (length({_DIGITS}) - i) % 2 = 0 THEN CAST({_DIGITS}[i] AS INTEGER) WHEN CAST({_DIGITS}[i] AS INTEGER) > 4 THEN CAST({_DIGITS}[i] AS INTEGER) * 2 - 9 ELSE CAST({_DIGITS}[i] AS INTEGER) * 2 END)) % 10 = 0"""
_COMPACT = "upper(regexp_replace(v, '[ -]', '', 'g'))"
_IBAN = f"""regexp_full_match({_COMPACT}, '[A-Z]{{2}}[0-9]{{2}}[A-Z0-9]{{11,30}}') AND list_reduce(list_prepend(0, list_transform(string_split({_COMPACT}[5:] || {_COMPACT}[1:4], ''), lambda c: CAST(CASE WHEN c = '' THEN -1 WHEN c BETWEEN '0' AND '9' THEN CAST(c AS INTEGER) ELSE ord(c) - 55 END AS INTEGER))),
    lambda r, c: CASE WHEN c < 0 THEN r WHEN c < 10 THEN (r * 10 + c) % 97 ELSE (r * 100 + c) % 97 END) = 1"""
_IPV6 = """(regexp_full_match(lower(v), '(?:[0-9a-f]{1,4}:){7}[0-9a-f]{1,4}') OR (regexp_full_match(lower(v), '(?:[0-9a-f]{1,4}(?::[0-9a-f]{1,4})*)?::(?:[0-9a-f]{1,4}(?::[0-9a-f]{1,4})*)?') AND len(list_filter(string_split(v, ':'), lambda g: g <> '')) < 8))"""
_SSN = f"NOT regexp_matches({_DIGITS}, '^(?:000|666|9)|^...00|0000$')"
_ALL, _INSIDE, _END = "all", "inside", "end"
_SQL_RULES = {
    "private-key": ("-----BEGIN (?:(?:RSA|EC|OPENSSH|DSA|ENCRYPTED) )?PRIVATE KEY-----(?s:.*?)-----END (?:(?:RSA|EC|OPENSSH|DSA|ENCRYPTED) )?PRIVATE KEY-----", _ALL, ""),
    "pgp-private-key": ("-----BEGIN PGP PRIVATE KEY BLOCK-----(?s:.*?)-----END PGP PRIVATE KEY BLOCK-----", _ALL, ""),
    "provider-token": (
        r"(?:^|[^\w-])(AIza[\w-]{30,}|AKIA[A-Z0-9]{16}|ASIA[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9_]{30,}|github_pat_[A-Za-z0-9_]{40,}|glpat-[A-Za-z0-9_-]{20,}|(?:sk|rk)_(?:live|test)_[A-Za-z0-9]{16,}|sk-(?:proj-)?[A-Za-z0-9_-]{20,}|npm_[A-Za-z0-9]{30,}|xox[baprs]-[A-Za-z0-9-]{10,}|SG\.[A-Za-z0-9_-]{16,}\.[A-Za-z0-9_-]{16,})(?:$|[^\w-])",
        _INSIDE, "",
    ),
    "jwt": (r"(?:^|[^\w-])(eyJ[A-Za-z0-9_-]{5,}\.[A-Za-z0-9_-]{5,}\.[A-Za-z0-9_-]{5,})(?:$|[^\w-])", _INSIDE, ""),
    "bearer-token": (rf"(?i)\bBearer[{_W}]+([A-Za-z0-9._~+/=-]{{12,}})", _END, ""),
    "assigned-secret": (rf"(?i)\b(?:api[_-]?key|access[_-]?token|auth[_-]?token|client[_-]?secret|password|passwd|pwd)\b[{_W}]*[=:][{_W}]*[\"']?([A-Za-z0-9_./+=:@-]{{8,}})", _END, ""),
    "connection-string": (rf"(?i)\b(?:postgres(?:ql)?|mysql|mongodb(?:\+srv)?|redis|amqps?)://[^{_W}:/?#]+:[^{_W}@/]+@[^{_W}<>'\"]+", _ALL, ""),
    "email": (r"(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b", _ALL, ""),
    "phone-e164": (r"(?:^|\W)(\+[1-9][0-9]{9,14})\b", _END, ""),
    "phone-formatted": (rf"(?:^|\W)((?:\+?[0-9]{{1,3}}[{_W}.-])?(?:\(?[0-9]{{2,4}}\)?[{_W}.-])[0-9]{{3,4}}[{_W}.-][0-9]{{3,4}})\b", _END, ""),
    "us-ssn": (r"\b[0-9]{3}[- ]?[0-9]{2}[- ]?[0-9]{4}\b", _ALL, _SSN),
    "payment-card": (r"(?:^|[^0-9])([0-9](?:[ -]?[0-9]){12,18})(?:$|[^0-9])", _INSIDE, _LUHN),
    "iban": (r"(?i)\b[A-Z]{2}[0-9]{2}(?:[ -]?[A-Z0-9]){11,30}\b", _ALL, _IBAN),
    "ipv4": (r"\b(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\b", _ALL, ""),
    "ipv6": (r"(?i)(?:^|[^\w:])((?:[A-F0-9]{0,4}:){2,7}[A-F0-9]{0,4})(?:$|[^\w:])", _INSIDE, _IPV6),
    "mac-address": (r"(?i)\b(?:[A-F0-9]{2}[:-]){5}[A-F0-9]{2}\b", _ALL, ""),
    "invisible-unicode": (f"[{INVISIBLE}]", _ALL, ""),
    "html-comment": ("<!--(?s:.*?)-->", _ALL, ""),
    "prompt-override": (rf"(?i)\b(?:ignore|disregard|forget|override|bypass)[{_W}]+(?:all[{_W}]+)?(?:previous|prior|above|system|developer|safety)[{_W}]+(?:instructions?|prompts?|messages?|rules?)\b[^\n]*", _ALL, ""),
    "model-control": (rf"(?i)\b(?:reveal|print|repeat|expose|send|leak|extract)[{_W}]+(?:the[{_W}]+)?(?:system prompt|developer message|api key|secret|conversation history|hidden instructions?|credentials?)\b[^\n]*", _ALL, ""),
    "encoded-base64": (r"(?:^|[^\w+/=])([A-Za-z0-9+/]{80,}={0,2})(?:$|[^\w+/=])", _INSIDE, ""),
    "encoded-hex": (r"(?i)(?:^|[^A-F0-9])((?:[A-F0-9]{2}){40,})(?:$|[^A-F0-9])", _INSIDE, ""),
}


def _text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


@cache
def _fold(drop: bool) -> str:
    """VALUES of the characters whose compatibility form is another, and with ``drop`` of those that aren't seen."""
    import re

    unseen = re.compile(f"[{INVISIBLE}]")
    rows = []
    for c in map(chr, (*range(0x80, 0xD800), *range(0xE000, 0x10000))):
        to = "" if drop and unseen.match(c) else unicodedata.normalize("NFKC", c)
        if to != c and not (0xAC00 <= ord(c) < 0xD7A4 or 0xF900 <= ord(c) < 0xFB00 or 0xFB50 <= ord(c) < 0xFE00 or 0x3200 <= ord(c) < 0x3400):
            rows.append(f"({_text(c)}, {_text(to)})")
    return ", ".join(rows)


def _folded(source: str, key: str, column: str) -> str:
    """b: key, t, the folded text f, and for each of its characters where it was, pl."""
    return f"""fold AS (SELECT * FROM (VALUES {_fold(True)}) AS v(c, m)), src AS (SELECT {key} AS k, {column} AS t FROM {source} WHERE {column} <> ''),
    ch AS (SELECT k, t, i, coalesce(m, c) AS m FROM (SELECT k, t, i, t[i] AS c FROM (SELECT k, t, unnest(range(1, length(t) + 1)) AS i FROM src)) x LEFT JOIN fold USING (c)),
    b AS (SELECT k, any_value(t) AS t, string_agg(m, '' ORDER BY i) AS f, flatten(list(list_transform(range(length(m)), lambda x: i) ORDER BY i)) AS pl FROM ch GROUP BY k)"""


def _matches(rules: list[str]) -> str:
    """One SELECT a rule: k, rule_ord, and start and end in the text as stored."""
    parts = []
    for r in RULES:
        if r.id not in rules:
            continue
        pattern, part, check = _SQL_RULES[r.id]
        p, body = _text(pattern), "t" if r.raw else "f"
        value = "m" if part == _ALL else f"regexp_extract(m, {p}, 1)"
        skip = {"all": "0", "end": f"length(m) - length({value})", "inside": f"strpos(m, {value}) - 1"}[part]
        a, z = ("s + 1", "s + length(v)") if r.raw else ("pl[s + 1]", "pl[s + length(v)]")
        parts.append(
            f"""SELECT k, t, {r.order} AS rule_ord, CAST({a} - 1 AS INTEGER) AS start_pos, CAST({z} AS INTEGER) AS end_pos FROM (SELECT k, t, pl, v, CAST(s0 + skip AS BIGINT) AS s FROM (
            SELECT k, t, pl, {value} AS v, {skip} AS skip, list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) AS s0
            FROM (SELECT k, t, pl, g, ms, i, ms[i] AS m FROM (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM (SELECT k, t, pl, string_split_regex({body}, {p}) AS g, regexp_extract_all({body}, {p}) AS ms FROM b)))) WHERE v <> ''{" AND " + check if check else ""})"""
        )
    return " UNION ALL ".join(parts)


def _rules_table() -> str:
    rows = ", ".join(f"({r.order}, {', '.join(_text(getattr(r, n)) for n in ('id', 'type', 'severity', 'title', 'detail', 'placeholder'))}, {TYPE_RANK[r.type] + SEVERITY_RANK[r.severity] + 1})" for r in RULES)
    return f"rules AS (SELECT * FROM (VALUES {rows}) AS v(rule_ord, rule, type, severity, title, detail, placeholder, prio))"


def _found(source: str, key: str, column: str, rules: list[str] | None = None) -> str:
    """fd: the findings before consolidation."""
    latest = f"{LATEST}, " if source == "h" else ""
    return f"""{latest}{_folded(source, key, column)}, {_rules_table()}, ms AS ({_matches(rules or list(_SQL_RULES))}),
    fd AS (SELECT k, t, 'rule-' || rule || '-' || start_pos || '-' || end_pos AS id, r.*, start_pos, end_pos, t[start_pos + 1:end_pos] AS value, CAST(length(t[1:start_pos]) - length(replace(t[1:start_pos], chr(10), '')) + 1 AS INTEGER) AS line
        FROM ms JOIN rules r USING (rule_ord) QUALIFY row_number() OVER (PARTITION BY k, start_pos, end_pos, type ORDER BY rule_ord) = 1)"""


FINGERPRINT = """r AS (SELECT k, x AS t, list_reduce(list_prepend({{'a': CAST(2166136261 AS HUGEINT), 'b': CAST(2654435769 AS HUGEINT), 'i': CAST(0 AS HUGEINT)}},
    list_transform(string_split(x, ''), lambda c: {{'a': CAST(CASE WHEN c = '' THEN -1 ELSE ord(c) END AS HUGEINT), 'b': CAST(0 AS HUGEINT), 'i': CAST(0 AS HUGEINT)}})),
    lambda s, c: CASE WHEN c.a < 0 THEN s ELSE {{'a': (xor(s.a, c.a) * 16777619) % 4294967296, 'b': (xor(s.b, c.a + s.i) * 2246822507) % 4294967296, 'i': s.i + 1}} END) AS r FROM {source}),
    fps AS (SELECT k, t, CAST(length(t) AS VARCHAR) || ':' || lower(to_base(CAST(r.a AS BIGINT), 36)) || ':' || lower(to_base(CAST(r.b AS BIGINT), 36)) AS fp FROM r)"""
_NOTES = "(SELECT handoff_id AS k, markdown AS x FROM h WHERE markdown IS NOT NULL)"


def rule_findings(rule: str) -> str:
    return f"WITH {_found('h', 'handoff_id', 'markdown', [rule])} SELECT k AS handoff_id, value, start_pos, end_pos, line FROM fd"


def all_findings(source: str, key: str, column: str, fingerprint: bool = False) -> str:
    if not fingerprint:
        return f"WITH {_found(source, key, column)} SELECT k AS {key}, id, type, severity, value, start_pos, end_pos, line, placeholder FROM fd"
    return f"""WITH {_found(source, key, column)}, {FINGERPRINT.format(source=_NOTES)}
    SELECT k AS {key}, id, fp AS doc_fingerprint, type, severity, title, detail, value, start_pos, end_pos, line, placeholder, 'rule' AS source, CAST(NULL AS DOUBLE) AS confidence, CAST(NULL AS VARCHAR) AS model_label FROM fd JOIN fps USING (k)"""


_CONSOLIDATED = """rk AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY prio DESC, end_pos - start_pos DESC, start_pos, id) AS rnk FROM fd),
    cs AS (SELECT * FROM rk a WHERE NOT EXISTS (SELECT 1 FROM rk b WHERE a.k = b.k AND b.rnk < a.rnk AND least(a.end_pos, b.end_pos) > greatest(a.start_pos, b.start_pos) AND (least(a.end_pos, b.end_pos) - greatest(a.start_pos, b.start_pos)) / (a.end_pos - a.start_pos) >= 0.8))"""


def consolidated(source: str, key: str, column: str) -> str:
    return f"WITH {_found(source, key, column)}, {_CONSOLIDATED} SELECT k AS {key}, id, type, severity, start_pos, end_pos, line, placeholder FROM cs"


#: From spans sp (k, t, id, start_pos, end_pos, placeholder, type, prio): islands, their numbers, and the texts put together.
_PUT = f"""same AS (SELECT * FROM (VALUES {_fold(False)}) AS v(c, m)),
    o AS (SELECT *, max(end_pos) OVER (PARTITION BY k ORDER BY start_pos, end_pos DESC, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM sp),
    il AS (SELECT *, sum(CASE WHEN reach IS NULL OR start_pos >= reach THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY start_pos, end_pos DESC, id) AS island FROM o),
    gr AS (SELECT k, island, any_value(t) AS t, min(start_pos) AS a, max(end_pos) AS z, arg_max(coalesce(placeholder, 'REDACTED'), {{'p': prio, 'l': end_pos - start_pos, 's': -start_pos, 'i': id}}) AS ph, arg_max(coalesce(type, ''), {{'p': prio, 'l': end_pos - start_pos, 's': -start_pos, 'i': id}}) AS ty FROM il GROUP BY k, island),
    al AS (SELECT g.k, g.island, lower(string_agg(coalesce(m, c), '' ORDER BY i)) AS alias FROM (SELECT k, island, i, t[i] AS c FROM (SELECT k, island, t, unnest(range(a + 1, z + 1)) AS i FROM gr)) g LEFT JOIN same USING (c) GROUP BY g.k, g.island),
    nb AS (SELECT gr.*, alias, ty = 'invisible-text' AS hidden, min(a) OVER (PARTITION BY gr.k, ph, alias, ty = 'invisible-text') AS first FROM gr JOIN al ON gr.k = al.k AND gr.island = al.island),
    pt AS (SELECT *, CASE WHEN hidden THEN '' ELSE '[' || ph || '_' || dense_rank() OVER (PARTITION BY k, ph, hidden ORDER BY first) || ']' END AS put, coalesce(lag(z) OVER (PARTITION BY k ORDER BY a), 0) AS before FROM nb),
    done AS (SELECT k, string_agg(t[before + 1:a] || put, '' ORDER BY a) || any_value(t)[max(z) + 1:] AS text FROM pt GROUP BY k)"""


def redacted(rule: str | None = None) -> str:
    """The notes with findings (those of one rule, or of all after consolidation), each replaced."""
    found = _found("h", "handoff_id", "markdown", [rule] if rule else None)
    return f"WITH {found}, {_CONSOLIDATED}, sp AS (SELECT * FROM {'fd' if rule else 'cs'}), {_PUT} SELECT k AS handoff_id, text FROM done"


def redact_stored(selected: bool = False) -> str:
    """The stored findings of each note put into effect, or those its list names; a note with a stale or unknown id stays."""
    prio = "coalesce(CASE finding_type " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in TYPE_RANK.items()) + " END, 0) + coalesce(CASE severity " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in SEVERITY_RANK.items()) + " END, 0) + CASE WHEN origin = 'rule' THEN 1 ELSE 0 END"
    wanted = "SELECT DISTINCT handoff_id, id FROM (SELECT handoff_id, unnest(findings).id AS id FROM handoff_inputs) WHERE handoff_id IS NOT NULL AND id IS NOT NULL" if selected else "SELECT handoff_id, id FROM f"
    return f"""WITH {LATEST}, {VALID}, {FINGERPRINT.format(source=_NOTES)}, wanted AS ({wanted}),
    ch AS (SELECT f.*, fps.t, fps.k FROM f JOIN wanted USING (handoff_id, id) JOIN fps ON f.handoff_id = fps.k),
    bad AS (SELECT k, id FROM ch JOIN fps USING (k) WHERE coalesce(NOT (ch.doc_fingerprint = fps.fp AND end_pos <= length(fps.t) AND fps.t[start_pos + 1:end_pos] = finding_value), true)
        UNION ALL SELECT w.handoff_id, w.id FROM wanted w JOIN fps ON w.handoff_id = fps.k WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.handoff_id = w.handoff_id AND f.id = w.id)),
    sp AS (SELECT k, t, id, start_pos, end_pos, placeholder, finding_type AS type, {prio} AS prio FROM ch WHERE k NOT IN (SELECT k FROM bad)), {_PUT},
    ids AS (SELECT k, string_agg(id, ' ' ORDER BY start_pos, end_pos DESC, id) AS redacted_ids, coalesce(string_agg(id, ' ' ORDER BY start_pos, end_pos DESC, id) FILTER (n > 1), '') AS overlap_merged_ids FROM (SELECT *, row_number() OVER (PARTITION BY k, island ORDER BY start_pos, end_pos DESC, id) AS n FROM il) GROUP BY k)
    SELECT fps.k AS handoff_id, coalesce(done.text, fps.t) AS text, coalesce(redacted_ids, '') AS redacted_ids, coalesce(overlap_merged_ids, '') AS overlap_merged_ids, coalesce((SELECT string_agg(id, ' ' ORDER BY id) FROM bad WHERE bad.k = fps.k), '') AS stale_ids
    FROM fps LEFT JOIN done USING (k) LEFT JOIN ids USING (k)"""
