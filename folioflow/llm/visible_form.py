"""Problem 2: one consistent form for text that looks the same.

A transducer is compiled from tables: widths (full and half), spaces, hyphens,
characters that are not seen, ligatures and numerals, the canonical forms of
single characters, and look-alike letters of other scripts. It reads grapheme
clusters, the longest at each place: a base character with all its combining
marks and the unseen characters between them, however many. Each cluster has
two outputs, its plain form and, for look-alikes, its Latin form. One pass over
a word writes both; at the end of the word the Latin form is taken if every
letter of another script has one, else the plain form. The offset in the source
of each character written is kept. Outputs of clusters and words are worked out
once and kept.

Compiling checks for conflicts: no source may have two targets, and no target
may itself be changed by the tables, so that a second pass changes nothing.

Letter case, accents and word order are kept, and so are superscripts, quotes
and wide dashes.

Defined cases: null stays null, an empty text stays empty.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Sequence
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_rows

#: Letters of other scripts that look like a Latin letter, as pairs: Cyrillic, Greek, Armenian, Cherokee, phonetic.
LOOK_ALIKES = (
    "аa еe оo рp сc уy хx іi ѕs јj һh ԁd ԛq ԝw ѵv кk АA ВB ЕE КK МM НH ОO РP СC ТT УY ХX ІI ЅS ЈJ ԌG ԚQ ԜW ѴV "
    "αa οo νv ρp υu ιi κk τt ΑA ΒB ΕE ΖZ ΗH ΙI ΚK ΜM ΝN ΟO ΡP ΤT ΥY ΧX ϲc ϳj ϹC ͿJ "
    "օo սu հh ոn ցg զq ՕO ՍU ՏS "
    "ᎪA ᏴB ᏟC ᎠD ᎬE ᏀG ᎻH ᎥI ᎫJ ᏦK ᏞL ᎷM ᏢP ᏒR ᏚS ᎢT ᏙV ᎳW ᏃZ "
    "ıi ɡg ɑa ӏl ӀI"
)
#: Dashes as wide as a hyphen, and where characters are not seen.
HYPHENS = "\u2010\u2011\u2043\u2212\ufe63\uff0d\u02d7"
UNSEEN = "\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180b-\u180e\u200b-\u200f\u202a-\u202e\u2060-\u206f\u3164\ufe00-\ufe0f\ufeff\uffa0"
_SPACES = "\t\u00a0\u1680\u2000-\u200a\u202f\u205f\u3000"


#: Words whose forms a process keeps.
KEPT_WORDS = 200_000


class Conflict(ValueError):
    """Two tables disagree on a character."""


def _members(spec: str) -> list[str]:
    """The characters of a class such as 'a-cx'."""
    out = []
    for m in re.finditer(r"(.)-(.)|(.)", spec, re.S):
        out += [chr(c) for c in range(ord(m[1]), ord(m[2]) + 1)] if m[1] else [m[3]]
    return out


def default_tables() -> dict[str, dict[str, str]]:
    """The tables by name; those that follow a rule are made by it."""
    widths = {}
    for c in (*range(0xFF01, 0xFF5F), *range(0xFF61, 0xFFEF)):  # full and half widths
        to = unicodedata.normalize("NFKC", chr(c))
        if to != chr(c) and chr(c) not in HYPHENS and chr(c) not in "ﾠ":
            widths[chr(c)] = to
    compatible = {chr(c): unicodedata.normalize("NFKC", chr(c)) for c in (*range(0x2160, 0x2180), *range(0xFB00, 0xFB07))}
    other = {c for t in (widths, compatible) for c in t} | set(UNSEEN) | set(HYPHENS) | set(_members(_SPACES))
    canonical = {c: n for c in map(chr, (*range(0x80, 0xD800), *range(0xE000, 0x10000))) if (n := unicodedata.normalize("NFC", c)) != c and c not in other}
    return {
        "widths": widths,
        "spaces": {c: " " for c in _members(_SPACES)},
        "hyphens": {c: "-" for c in HYPHENS},
        "unseen": {c: "" for c in _members(UNSEEN)},
        "ligatures and numerals": {c: n for c, n in compatible.items() if n != c},
        "canonical": canonical,
        "look-alikes": {p[0]: p[1] for p in LOOK_ALIKES.split()},
    }


def _class_of(chars: Iterable[str]) -> str:
    """The inside of a character class."""
    codes, spans = sorted({ord(c) for c in chars}), []
    for c in codes:
        if spans and spans[-1][1] == c - 1:
            spans[-1][1] = c
        else:
            spans.append([c, c])
    return "".join(f"{re.escape(chr(a))}-{re.escape(chr(b))}" if b > a else re.escape(chr(a)) for a, b in spans)


#: Characters that go with the one before: combining marks, and the vowels and last consonants of Korean syllables, wide or half as wide.
_MARKS = frozenset(c for c in map(chr, range(0x300, 0xFFDD)) if unicodedata.combining(c) or unicodedata.category(c)[0] == "M" or "\u1161" <= c <= "\u11ff" or c in "\uff9e\uff9f" or "\uffc2" <= c <= "\uffdc" and unicodedata.category(c) == "Lo")
#: Scripts whose letters count as of another script beside Latin.
_FOREIGN = "\u0370-\u03ff\u0400-\u058f\u13a0-\u13ff\u1f00-\u1fff\uab70-\uabbf"


class Transducer:
    """The compiled mapping; ``apply`` gives the text, ``with_offsets`` also the offset of each character."""

    def __init__(self, tables: dict[str, dict[str, str]] | None = None):
        tables = tables or default_tables()
        self.plain: dict[str, str] = {}
        self.alike = dict(tables.get("look-alikes", {}))
        for name, t in tables.items():
            for a, b in t.items():
                if len(a) != 1:
                    raise Conflict(f"{name}: {a!r} is not one character; clusters are made by the accents")
                if name != "look-alikes":
                    if self.plain.setdefault(a, b) != b or a in self.alike and self.alike[a] != b:
                        raise Conflict(f"{name}: {a!r} has two targets")
        # A plain form may be a look-alike: its Latin form is an output of the same cluster.
        for a, b in (*self.plain.items(), *self.alike.items()):
            for c in b:
                if c in self.plain and self.plain[c] != c or a in self.alike and c in self.alike:
                    raise Conflict(f"{a!r} gives {c!r}, which changes again")
        self.unseen = frozenset(c for c, to in self.plain.items() if not to)
        marks, unseen = _class_of(_MARKS), _class_of(self.unseen) or "\uffff"
        alike = _class_of(c for c in self.alike if not re.match(f"[{_FOREIGN}]", c))
        #: What makes a word worth reading; all other text is copied.
        self.special = re.compile(f"[{_class_of(self.plain)}{marks}{_FOREIGN}{alike}]")
        self.foreign = re.compile(f"[{_FOREIGN}{alike}]")
        self.inside = re.compile(f"(?:[^\\W\\d_]|[{marks}{unseen}])*+")
        self.tail = re.compile(f"(?:[{unseen}]*+[{marks}])*+")
        self.cluster = re.compile(f"[^\\s{marks}{unseen}](?:[{unseen}]*+[{marks}])*|.", re.S)
        self.outputs: dict[str, tuple[str, str | None, bool]] = {}
        self.words: dict[str, tuple[str, list[int]]] = {}

    def _output(self, cluster: str) -> tuple[str, str | None, bool]:
        """(plain form, Latin form, whether it is a letter of another script) of a cluster."""
        got = self.outputs.get(cluster)
        if got is None:
            plain = unicodedata.normalize("NFC", "".join(self.plain.get(c, c) for c in cluster))
            latin, foreign = plain, False
            if plain and self.foreign.match(plain):
                base, *rest = unicodedata.normalize("NFD", plain)
                foreign = True
                latin = unicodedata.normalize("NFC", self.alike[base] + "".join(rest)) if base in self.alike else None
            got = self.outputs[cluster] = (plain, latin, foreign)
        return got

    def _word(self, word: str) -> tuple[str, list[int]]:
        """The form of a word and the places in it that its characters come from."""
        got = self.words.get(word)
        if got is None:
            tapes: tuple[list[str], list[str]] = ([], [])
            places: tuple[list[int], list[int]] = ([], [])
            other, whole = False, True
            for m in self.cluster.finditer(word):
                plain, latin, foreign = self._output(m[0])
                other, whole = other or foreign, whole and latin is not None
                for tape, at, to in zip(tapes, places, (plain, latin or "")):
                    tape.append(to)
                    at.extend([m.start()] * len(to))
            k = int(other and whole)
            if len(self.words) >= KEPT_WORDS:
                self.words.clear()
            got = self.words[word] = ("".join(tapes[k]), places[k])
        return got

    def with_offsets(self, text: str) -> tuple[str, Sequence[int]]:
        if text.isascii() and "\t" not in text:
            return text, range(len(text))
        out: list[str] = []
        offsets: list[int] = []
        at = 0
        m = self.special.search(text)
        while m:
            # The word around the character, back to what is copied already; a mark goes with the character before it.
            i = a = m.start()
            while a > at and (text[a - 1].isalpha() or text[a - 1] in _MARKS or text[a - 1] in self.unseen):
                a -= 1
            if a > at and a == i and text[i] in _MARKS and not text[a - 1].isspace():
                a -= 1
            elif a == i and not (text[i].isalpha() or text[i] in _MARKS or text[i] in self.unseen):
                i += 1
            b = (self.inside if i == m.start() else self.tail).match(text, i).end()
            out.append(text[at:a])
            offsets.extend(range(at, a))
            form, places = self._word(text[a:b])
            out.append(form)
            offsets.extend([a + p for p in places])
            at = b
            m = self.special.search(text, b)
        out.append(text[at:])
        offsets.extend(range(at, len(text)))
        return "".join(out), offsets

    def apply(self, text: str) -> str:
        """As ``with_offsets``, with runs of blanks as one."""
        return re.sub(r"[ \t]+", " ", self.with_offsets(text)[0])


@lru_cache(maxsize=1)
def default_transducer() -> Transducer:
    """The transducer of the default tables, compiled once in each process."""
    return Transducer()


def visible_form(df: DataFrame, text_col: str, out_col: str = "visible_text") -> DataFrame:
    """Adds the consistent form of a text column as ``out_col`` (replacing a column of that name)."""

    @F.pandas_udf(T.StringType())
    def form(texts):
        t = default_transducer()
        return texts.map(lambda x: None if x is None else t.apply(x))

    return df.withColumn(out_col, form(F.col(text_col).cast("string")))


#: Watched phrases looked for at once; more are looked for in blocks of so many, each against all rows.
PHRASE_BLOCK = 50_000


def find_phrases(
    df: DataFrame, id_cols: list[str], text_col: str, rules: DataFrame, hidden_only: bool = True, block: int = PHRASE_BLOCK
) -> DataFrame:
    """(id_cols, rule_no) for each text in which a reader sees the phrase of a rule.

    ``rules`` has rule_no, phrase and raw_only. A raw_only phrase is looked for
    as it is stored; the others in the consistent form of text and phrase. With
    ``hidden_only`` rows are left out whose text holds the stored characters as
    they are. Null or blank phrases match nothing. Rules are read in blocks of
    ``block``, so what a task holds has a bound.
    """
    import ahocorasick

    small = rules.select(F.col("rule_no").cast("int"), F.col("phrase").cast("string"), F.coalesce(F.col("raw_only"), F.lit(False)).alias("raw_only"))
    small = small.filter("rule_no IS NOT NULL AND trim(phrase) <> ''").orderBy("rule_no", "phrase")
    blocks: list[list] = [[]]
    for r in small.toLocalIterator():
        if len(blocks[-1]) == block:
            blocks.append([])
        blocks[-1].append((r.rule_no, r.phrase, r.raw_only))
    src = df.select(*[F.col(c).cast("bigint" if t == "bigint" else "string").alias(c) for c, t in ((c, dict(df.dtypes)[c]) for c in id_cols)], F.col(text_col).cast("string").alias("__text")).filter("__text IS NOT NULL")
    ddl = ", ".join(f"{c} {'bigint' if dict(df.dtypes)[c] == 'bigint' else 'string'}" for c in id_cols) + ", rule_no int"

    def one(part: list):
        def make():
            t = default_transducer()
            seen, stored = ahocorasick.Automaton(), ahocorasick.Automaton()
            by_seen: dict[str, list] = {}
            by_stored: dict[str, list] = {}
            for no, phrase, raw in part:
                (by_stored if raw else by_seen).setdefault(phrase if raw else t.apply(phrase), []).append((no, phrase))
            for auto, by in ((seen, by_seen), (stored, by_stored)):
                for k, v in by.items():
                    auto.add_word(k, v)
                auto.make_automaton()

            def fn(cols):
                out: dict[str, list] = {c: [] for c in (*id_cols, "rule_no")}
                for i, text in enumerate(cols["__text"]):
                    hits = set()
                    if len(seen):
                        form = re.sub(r"\s+", " ", t.apply(text))
                        for _, found in seen.iter(form):
                            hits.update(no for no, phrase in found if not (hidden_only and phrase in text))
                    if len(stored) and not hidden_only:
                        for _, found in stored.iter(text):
                            hits.update(no for no, _ in found)
                    for no in sorted(hits):
                        for c in id_cols:
                            out[c].append(cols[c][i])
                        out["rule_no"].append(no)
                return out

            return fn

        return map_rows(src, make, ddl)

    result = one(blocks[0])
    for part in blocks[1:]:
        result = result.unionByName(one(part))
    return result.distinct()
