"""Problem 8: text statistics of each document, and what kind of text it is.

A document is cut into fixed-size chunks. Each chunk yields a *partial*: counts
that add up, plus the state at its two ends (the open first and last line, the
words that touch the ends). ``merge`` joins the partials of two neighbouring
chunks and corrects what the cut distorted: a word or a line that runs across
it is counted once, however many chunks it fills. ``merge`` is associative, so
partials are merged up a tree, and ratios and the verdict are derived from the
root only. The chunk size changes no result.

Chunks of a document are read and merged in one task. A document of more than
SPREAD_CHARS is first cut into pieces of that size, which are dealt out to all
tasks; the partials of the pieces are then merged up a distributed tree. So the
texts of huge documents are shuffled once, and of other documents nothing is.
An open line is part of the state, so a merge holds at most one line more than
the partials have: no more than the document's own row.

Defined cases: a null or blank text gives zero counts, null ratios and a null
kind; a null id is kept as it is; each row is a document, repeated or not.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_rows

CHUNK_CHARS = 4096
#: The size of the pieces of documents that are dealt out to several tasks.
SPREAD_CHARS = 1 << 20
#: Pieces merged by one task of a level of the tree.
FAN_IN = 64
#: Letters kept of a word at the end of a chunk; no common word is longer.
WORD_STATE = 24

# Frequent function words of the seven languages.
COMMON_WORDS = {
    "eng": "the of and to in a is that it was for on are with as be at by this have from or had not but which has been were their our no an before after because while until although without into more than",
    "fra": "le la les de des du un une et à en est que qui dans pour par sur au aux avec ne pas plus ce cette ces son sa ses a été être ou mais sans sous se si leur dont avant après parce pendant selon chaque encore",
    "deu": "der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war nur vor zur bis ohne weil durch oder aber gemäß jede keinem einer",
    "spa": "el la los las de del un una y a en es que se no por con su para como más pero sus le ya o este sí porque esta entre cuando muy sin sobre también me hasta hay donde quien desde todo nos durante todos uno ni contra según antes después al ha",
    "ita": "il lo la i gli le di del della dei un una e a in è che non per con si da su come più ma anche o al alla nel nella sono ha questo questa perché quando senza prima dopo secondo ogni ancora tra mentre ogni dal degli ed",
    "nld": "de het een en van in is dat op te zijn met voor niet aan er om ook als dan maar bij uit door naar nog wel heeft werd wordt deze dit die of tot zonder omdat terwijl volgens elk geen onder over worden hij ze",
    "por": "o a os as de do da dos das um uma e em no na nos nas é que se não por com para como mais mas ao à foi são ou seu sua este esta também já até sem antes depois porque enquanto segundo cada ainda pelo pela tem ser nunca",
}
COMMON = frozenset(w for words in COMMON_WORDS.values() for w in words.split())

_WORD = re.compile(r"[^\W_]+")
_DIGITS = re.compile(r"\d+")
_FIRST, _LAST = re.compile(r"[^\W_]*"), re.compile(r"[^\W_]*\Z")
_BULLET = re.compile(r"\s*(?:[-*+•‣▪◦–]\s+(?:\[[ xX]\]\s*)?|\(?\d{1,4}[.)]\s+|\(?[a-zA-Z][.)]\s+)")
_LEADER = re.compile(r"(?:(?<!\.)\.{4,}+|(?<!…)…{2,}+|(?<!\. )(?:\. ){4,}+)\s*\d*\s*$")
_PAIR = re.compile(r"[^:;.!?]{2,70}:\s+\S+(?:\s+\S+){0,2}$")
_GAPS = re.compile(r"(?<=\S) {2,}(?=\S)")
_SENTENCE = re.compile(r"(?<![.!?…])[.!?…]++[\"'»”’)\]*_]*+(?=\s|$)")
_END = re.compile(r"(?<![.!?…:;])[.!?…:;]++[\"'»”’)\]*_]*+\s*$")
#: Characters that show a text decoded wrongly, or not text.
_ODD = re.compile("[¢-©¬±-¶¼-¾ÂÃ�€™\u0080-\u009f]")
_VOWEL = re.compile(r"[aeiouyáàâãäåæéèêëíìîïóòôõöøúùûüœ]", re.I)

#: The counts of a partial, all of which add up.
COUNTS = (
    "n_chars", "n_letters", "n_digits", "n_spaces", "n_symbols", "n_words", "n_word_chars", "n_common",
    "n_lines", "n_lines_end", "n_list_lines", "n_table_lines", "n_junk_lines", "n_prose_lines",
    "c_list", "c_table", "c_junk", "c_prose", "c_bare", "n_marks", "n_sentences", "n_repeats", "c_repeats",
)
_AT = {n: i for i, n in enumerate(COUNTS)}


def line_kind(line: str, s: str | None = None) -> str:
    """One of blank, head, list, bare, table, junk, prose.

    'bare' is a short line without an end mark: an entry of a list without
    bullets, or the last line of a wrapped paragraph; the document decides.
    """
    s = line.strip() if s is None else s
    if not s:
        return "blank"
    c0 = s[0]
    if c0 == "#" and s.lstrip("#")[:1] == " ":
        return "head"
    if c0 == ">":
        while s[:1] == ">" and s[:2] != ">>":
            s = s[1:].lstrip()
        if not s:
            return "blank"
        c0 = s[0]
    n = len(s)
    words = _WORD.findall(s.lower())
    if (".." in s or "…" in s or ". ." in s) and _LEADER.search(s):
        return "list"
    pipes = s.count("|")
    count = len(words)
    # Few different words; most lines have more among their first.
    if count >= 8 and n > 30 and len(set(words[:8])) <= 4 and len(set(words)) <= 4:
        return "junk"
    if c0 == "|" and pipes >= 2:
        return "table"
    if not words:
        return "junk" if n > 3 else "blank"
    chars = sum(map(len, words))
    symbols = n - chars - s.count(" ") - s.count("\t")
    if n > 20 and not s.isascii() and len(_ODD.findall(s)) > 0.04 * n:
        return "junk"
    if symbols > 0.2 * n and s.count("{") > 2 and s.count("}") > 2:
        return "junk"
    common = -1
    semis, tabs = s.count(";"), s.count("\t")
    if semis or tabs:
        cells, sep = (semis, ";") if semis >= tabs else (tabs, "\t")
        parts = s.split(sep)
        longest = max(map(len, parts))
        if (cells >= 2 or sep == "\t") and longest <= 45 and not (sep == ";" and len(_SENTENCE.findall(s)) > 1):
            return "table"
        if sep == ";" and cells == 1 and longest <= 40 and c0 != ";" and s[-1] != ";" and parts[1][:1] != " " and sum(map(COMMON.__contains__, words)) < 4:
            return "table"
    if "  " in s:
        gaps = _GAPS.findall(s)
        # Cells padded to a width: a wide gap, or gaps of two among single blanks. Text spaced out evenly is neither.
        if gaps:
            common = sum(map(COMMON.__contains__, words))
            if max(map(len, gaps)) >= 3 or (s.count(" ") > 2 * len(gaps) and common < 0.3 * count):
                return "table"
    if _BULLET.match(line):
        return "list"
    if chars > 60 and count < n / 12 and max(map(len, words)) > 45:
        return "junk"
    if n > 20 and symbols > 0.25 * n and pipes < 2:
        return "junk"
    if n >= 40:
        if COMMON.isdisjoint(words):
            if sum(not _VOWEL.search(w) for w in words if len(w) > 1) > 0.5 * count:
                return "junk"
            if count >= 10 and len(set(words)) <= 5:
                return "junk"
        few = max(4, count // 12)
        if count >= 10 and len(set(words[: 2 * few])) <= few and len(set(words)) <= few and sum(map(COMMON.__contains__, words)) < 0.2 * count:
            return "junk"
    if n <= 90 and ": " in s and _PAIR.match(s):
        return "list"
    if n <= 64 and not _END.search(s):
        return "bare"
    return "prose"


class Partial:
    """Counts of a stretch of text, with its open ends.

    ``head`` is the text before the first line end and ``tail`` the text after
    the last; a stretch without a line end is ``open`` and has its text in
    ``head``. ``w_first`` and ``w_last`` are the words that touch the ends, and
    ``l_first`` and ``l_last`` the keys of the first and last complete line.
    """

    FIELDS = ("head", "tail", "open", "w_first", "w_last", "l_first", "l_last")
    __slots__ = ("c", *FIELDS)

    def __init__(self, c: list[int], *state):
        self.c = c
        for name, value in zip(self.FIELDS, state):
            setattr(self, name, value)

    def row(self) -> list:
        return [*self.c, *(getattr(self, n) for n in self.FIELDS)]


def _key(line: str) -> str:
    """What tells two lines apart; short lines may repeat."""
    s = line.strip()
    return f"{len(s)}:{hashlib.md5(s.encode('utf-8', 'replace')).hexdigest()}" if len(s) > 20 else "-" if s else ""


def _repeat(c: list[int], a: str, b: str) -> None:
    if a == b and len(a) > 1:
        c[_AT["n_repeats"]] += 1
        c[_AT["c_repeats"]] += int(a.split(":")[0])


def _add_line(c: list[int], line: str) -> None:
    s = line.strip()
    kind = line_kind(line, s)
    if kind == "blank":
        return
    n = len(s)
    c[_AT["n_lines"]] += 1
    if _END.search(s):
        c[_AT["n_lines_end"]] += 1
    if kind == "prose":
        c[_AT["n_prose_lines"]] += 1
        c[_AT["c_prose"]] += n
        if n > 100:
            parts = [p.strip() for p in _SENTENCE.split(s)]
            c[_AT["n_sentences"]] += sum(bool(p) for p in parts[:-1]) or 1
            for a, b in zip(parts, parts[1:]):
                if a and a == b:
                    c[_AT["n_repeats"]] += 1
                    c[_AT["c_repeats"]] += len(b)
        else:
            c[_AT["n_sentences"]] += len(_SENTENCE.findall(s)) or 1
    elif kind == "bare":
        c[_AT["c_bare"]] += n
        c[_AT["n_marks"]] += len(_SENTENCE.findall(s))
    elif kind != "head":
        c[_AT[f"n_{kind}_lines"]] += 1
        c[_AT[f"c_{kind}"]] += n


def partial(text: str) -> Partial:
    """The partial of one chunk."""
    c = [0] * len(COUNTS)
    words = _WORD.findall(text)
    dense = "".join(text.split())
    c[_AT["n_chars"]] = len(text)
    c[_AT["n_words"]] = len(words)
    c[_AT["n_word_chars"]] = chars = sum(map(len, words))
    c[_AT["n_spaces"]] = len(text) - len(dense)
    c[_AT["n_digits"]] = digits = sum(map(len, _DIGITS.findall(text)))
    c[_AT["n_letters"]] = chars - digits
    c[_AT["n_symbols"]] = len(dense) - chars
    # The lower case of all letters but one is one letter.
    c[_AT["n_common"]] = sum(map(COMMON.__contains__, _WORD.findall(text.lower()) if "İ" not in text else map(str.lower, words)))
    w_first, w_last = _FIRST.match(text)[0][:WORD_STATE], _LAST.search(text[-WORD_STATE:])[0]
    lines = text.split("\n")
    if len(lines) == 1:
        return Partial(c, text, "", True, w_first, w_last, "", "")
    first = last = ""
    for line in lines[1:-1]:
        if key := _key(line):
            _add_line(c, line)
            _repeat(c, last, key)
            first, last = first or key, key
    return Partial(c, lines[0], lines[-1], False, w_first, w_last, first, last)


def merge(a: Partial, b: Partial) -> Partial:
    """The partial of a's text followed by b's; associative for the chunks of one text."""
    c = [x + y for x, y in zip(a.c, b.c)]
    if a.w_last and b.w_first:
        c[_AT["n_words"]] -= 1
        c[_AT["n_common"]] += ((a.w_last + b.w_first).lower() in COMMON) - (a.w_last.lower() in COMMON) - (b.w_first.lower() in COMMON)
    # A stretch that is one word hands the word at its other side on.
    one_a, one_b = (p.c[_AT["n_word_chars"]] == p.c[_AT["n_chars"]] for p in (a, b))
    w_first = (a.w_first + b.w_first)[:WORD_STATE] if one_a else a.w_first
    w_last = (a.w_last + b.w_last)[-WORD_STATE:] if one_b else b.w_last
    if a.open:
        return Partial(c, a.head + b.head, b.tail, b.open, w_first, w_last, b.l_first, b.l_last)
    if b.open:
        return Partial(c, a.head, a.tail + b.head, False, w_first, w_last, a.l_first, a.l_last)
    # The line at the cut is complete now.
    line = a.tail + b.head
    _add_line(c, line)
    keys = [k for k in (a.l_last, _key(line), b.l_first) if k]
    for x, y in zip(keys, keys[1:]):
        _repeat(c, x, y)
    return Partial(c, a.head, b.tail, False, w_first, w_last, a.l_first or (keys[0] if keys else ""), b.l_last or (keys[-1] if keys else ""))


def finish(p: Partial) -> list[int]:
    """The counts with the open ends closed."""
    c = list(p.c)
    if p.open:
        _add_line(c, p.head)
        return c
    head, tail = _key(p.head), _key(p.tail)
    _add_line(c, p.head)
    _add_line(c, p.tail)
    for x, y in ((head, p.l_first), (p.l_last, tail)) if p.l_first else ((head, tail),):
        _repeat(c, x, y)
    return c


def verdict(c: list[int]) -> str | None:
    """prose, list, table or junk; null for a text without a line that counts."""
    g = lambda n: c[_AT[n]]
    total = g("c_list") + g("c_table") + g("c_junk") + g("c_prose") + g("c_bare")
    if not total:
        return None if not g("n_symbols") else "junk"
    # Repeated sentences beyond half of the prose are no prose.
    prose, junk = g("c_prose"), g("c_junk")
    if g("c_repeats") > 0.5 * total:
        return "junk"
    bare = g("c_bare")
    # Short open lines are wrapped prose where enough of them hold or meet the end of a sentence.
    bare_lines = g("n_lines") - g("n_list_lines") - g("n_table_lines") - g("n_junk_lines") - g("n_prose_lines")
    if bare and (prose >= bare or g("n_marks") + g("n_prose_lines") > 0.15 * bare_lines):
        prose, bare = prose + bare, 0
    shares = {"prose": prose, "list": g("c_list") + bare, "table": g("c_table"), "junk": junk}
    return max(shares, key=lambda k: shares[k])


_STATE_DDL = "head string, tail string, open boolean, w_first string, w_last string, l_first string, l_last string"
_PARTIAL_DDL = ", ".join([*(f"{n} bigint" for n in COUNTS), _STATE_DDL])
STATS_DDL = ", ".join(
    [*(f"{n} bigint" for n in COUNTS), "mean_word_length double, symbol_ratio double, line_end_share double, common_share double, text_kind string"]
)


def _derive(c: list[int]) -> list:
    g = lambda n: c[_AT[n]]
    ratio = lambda x, y: x / y if y else None
    return [
        *c,
        ratio(g("n_word_chars"), g("n_words")),
        ratio(g("n_symbols"), g("n_chars") - g("n_spaces")),
        ratio(g("n_lines_end"), g("n_lines")),
        ratio(g("n_common"), g("n_words")),
        verdict(c),
    ]


def clean_newlines(text: str) -> str:
    return text.replace("\r\n", "\n").replace("\r", "\n")


def tree(parts: list[Partial]) -> Partial:
    """Merges neighbours pairwise until one is left."""
    while len(parts) > 1:
        parts = [merge(*parts[i : i + 2]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    return parts[0]


def partial_in_chunks(text: str, chunk_chars: int = CHUNK_CHARS) -> Partial:
    """The partial of a text, made of its chunks."""
    return tree([partial(text[i : i + chunk_chars]) for i in range(0, len(text), chunk_chars)] or [partial("")])


def text_kind(text: str) -> str | None:
    """The kind of a whole text with clean line ends."""
    return verdict(finish(partial_in_chunks(text)))


def text_statistics(df: DataFrame, id_col: str, text_col: str, chunk_chars: int = CHUNK_CHARS, spread_chars: int = SPREAD_CHARS) -> DataFrame:
    """One row for each row: ``id_col`` and the columns of STATS_DDL."""
    src = df.select(F.col(id_col).cast("bigint").alias("key"), F.col(text_col).cast("string").alias("body"))
    huge = F.coalesce(F.length("body") > spread_chars, F.lit(False))
    names = [x.split()[0] for x in STATS_DDL.split(", ")]
    pnames = [x.split()[0] for x in _PARTIAL_DDL.split(", ")]

    def whole():
        def fn(cols):
            rows = [_derive(finish(partial_in_chunks(clean_newlines(t or ""), chunk_chars))) for t in cols["body"]]
            return {"key": cols["key"], **{n: [r[i] for r in rows] for i, n in enumerate(names)}}

        return fn

    here = map_rows(src.filter(~huge), whole, f"key bigint, {STATS_DDL}")

    def cut():
        def fn(cols):
            rows = []
            for row, key, body in zip(cols["row"], cols["key"], cols["body"]):
                body = clean_newlines(body)
                rows += [(row, key, no, body[at : at + spread_chars]) for no, at in enumerate(range(0, len(body), spread_chars))]
            return dict(zip(("row", "key", "no", "body"), zip(*rows))) if rows else {}

        return fn

    def parts():
        def fn(cols):
            rows = [partial_in_chunks(t, chunk_chars).row() for t in cols["body"]]
            return {**{n: cols[n] for n in ("row", "key", "no")}, **{n: [r[i] for r in rows] for i, n in enumerate(pnames)}}

        return fn

    # A row's own number keeps the pieces of repeated rows apart.
    pieces = map_rows(src.filter(huge).withColumn("row", F.monotonically_increasing_id()), cut, "row bigint, key bigint, no int, body string", batch_rows=1)
    level = map_rows(pieces.repartition("row", "no"), parts, f"row bigint, key bigint, no int, {_PARTIAL_DDL}", batch_rows=1)

    def combine(last: bool):
        def make():
            def fn(cols):
                rows = []
                for row, key, no, parts in zip(cols["row"], cols["key"], cols["no"], cols["parts"]):
                    parts.sort(key=lambda p: p["no"])
                    root = tree([Partial([p[n] for n in COUNTS], *(p[n] for n in Partial.FIELDS)) for p in parts])
                    rows.append((key, *_derive(finish(root))) if last else (row, key, no, *root.row()))
                return dict(zip(("key", *names) if last else ("row", "key", "no", *pnames), zip(*rows)))

            return fn

        return make

    def gathered(level: DataFrame, no: Column) -> DataFrame:
        return level.groupBy("row", no.cast("int").alias("no")).agg(F.first("key").alias("key"), F.collect_list(F.struct(F.col("no"), *pnames)).alias("parts"))

    # One level of the tree in tasks of FAN_IN pieces, then the root of each document.
    level = map_rows(gathered(level, F.floor(F.col("no") / FAN_IN)), combine(False), f"row bigint, key bigint, no int, {_PARTIAL_DDL}", batch_rows=64)
    spread = map_rows(gathered(level, F.lit(0)), combine(True), f"key bigint, {STATS_DDL}", batch_rows=64)
    return here.unionByName(spread).withColumnRenamed("key", id_col)
