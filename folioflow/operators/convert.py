"""Markdown to plain, readable or delimited text, with the references it uses.

A document is read once into *blocks* (one per line, with what kind of line it
is), which settles fences and definitions. Blocks are then written in one of
three styles; links are resolved on the way, and collected by target.

Defined cases: a null or empty text converts to an empty text without
references.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import PY_WS
from .batches import map_batches

MODES = ("plain", "readable", "ai")

# The forms of Markdown that are recognised. S stands for white space as a browser has it.
S = "[" + re.escape(PY_WS) + "]"
NS = "[^" + re.escape(PY_WS) + "]"
_DEFINITION = re.compile(rf"""^{S}{{0,3}}\[([^\]]+)\]:{S}*(?:<([^>]+)>|({NS}+))(?:{S}+(?:"([^"]*)"|'([^']*)'|\(([^)]*)\)))?{S}*\Z""")
_DIVIDER = re.compile(rf"^{S}*(?:\|{S}*)?:?-{{3,}}:?{S}*(?:\|{S}*:?-{{3,}}:?{S}*)+\|?{S}*\Z")
_RULE = re.compile(rf"^{S}{{0,3}}(?:(?:\*{S}*){{3,}}|(?:-{S}*){{3,}}|(?:_{S}*){{3,}})\Z")
_FENCE = re.compile(rf"^{S}{{0,3}}(?:(`)`{{2,}}|(~)~{{2,}})")
_LINK = re.compile(rf"""(?P<image>!?)\[(?P<label>[^\]]*)\](?:\({S}*(?:<(?P<angled>[^>]+)>|(?P<url>[^)\s]+))(?:{S}+(?:"(?P<t1>[^"]*)"|'(?P<t2>[^']*)'|\((?P<t3>[^)]*)\)))?{S}*\)|\[(?P<ref>[^\]]*)\])""")
_SHORTCUT = re.compile(r"(?<!!)\[([^\]]+)\]")
_HEADING = re.compile(rf"^{S}{{0,3}}#{{1,6}}{S}+(.*)\Z")
_AI_HEADING = re.compile(rf"^{S}{{0,3}}(#{{1,6}}){S}+")
_ROW = re.compile(rf"^{S}*\|.*\|{S}*\Z")
_QUOTE = re.compile(rf"^{S}{{0,3}}>{S}?")
_TASK = re.compile(rf"^({S}*)[-+*]{S}+\[([ xX])\]{S}+(.*)\Z")
_BULLET, _ORDINAL = re.compile(rf"^{S}*[-+*]{S}+"), re.compile(rf"^{S}*[0-9]+[.)]{S}+")
_ENTITY = re.compile(r"&(#x?[0-9a-f]+|[a-z]+);", re.I)
_ENTITIES = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " "}
#: Inline marks, in the order in which they are taken off.
_INLINE = [
    # What a match of a tag ends in: no text after the last of them is looked at, which keeps unclosed tags cheap.
    (re.compile(p, f), to, {"<!": "-->", "<[": ">", "<b": ">"}.get(p[:2], ""))
    for p, f, to in (
        (rf"<br{S}*/?>", re.I, "\n"),
        (r"<!--[\s\S]*?-->", 0, ""),
        (r"<[^>]+>", 0, ""),
        (r"(`+)([^\n\r]*?)\1", 0, r"\2"),
        (r"~~([^~]+)~~", 0, r"\1"),
        (r"\*\*([^*]+)\*\*", 0, r"\1"),
        (r"__([^_]+)__", 0, r"\1"),
        (r"(?<!\*)\*([^*\n]+)\*(?!\*)", 0, r"\1"),
        (r"(?<!_)_([^_\n]+)_(?!_)", 0, r"\1"),
        (r"\\([\\`*{}\[\]()#+\-.!_>])", 0, r"\1"),
    )
]


def decode_entities(text: str) -> str:
    """Six named entities and numeric ones; others, and numbers beyond Unicode, stay."""

    def put(m: re.Match) -> str:
        name = m[1].lower()
        if name[0] != "#":
            return _ENTITIES.get(name, m[0])
        digits, base = (name[2:], 16) if name[1] == "x" else (name[1:], 10)
        try:
            return chr(int(digits, base))
        except (ValueError, OverflowError):
            return m[0]

    return _ENTITY.sub(put, text) if "&" in text else text


def strip_inline(text: str) -> str:
    text = decode_entities(text)
    for pattern, to, closer in _INLINE:
        if closer:
            end = text.rfind(closer) + len(closer)
            if end >= len(closer):
                text = pattern.sub(to, text[:end]) + text[end:]
        else:
            text = pattern.sub(to, text)
    return text


def _heading_text(rest: str) -> str:
    """What a heading says: without the blanks and the closing marks at its end."""
    rest = rest.rstrip(PY_WS)
    bare = rest.rstrip("#")
    return bare.rstrip(PY_WS) if bare != rest and bare and bare[-1] in PY_WS else rest


def label_key(label: str) -> str:
    """A label without regard to case and spacing."""
    return re.sub(rf"{S}+", " ", label.strip(PY_WS)).lower()


def _bare(url: str) -> str:
    url = url[1:] if url.startswith("<") else url
    return (url[:-1] if url.endswith(">") else url).strip(PY_WS)


@dataclass
class Reference:
    """A target that a document uses; ``first`` orders targets by their first place."""

    id: str
    label: str
    url: str
    title: str | None
    kind: str
    first: int
    line: int
    defined: bool


@dataclass
class Links:
    """The targets of a document by kind and address, its definitions, and the labels that lead nowhere."""

    definitions: dict[str, tuple[str, str | None]] = field(default_factory=dict)
    found: dict[tuple[str, str], Reference] = field(default_factory=dict)
    broken: dict[str, None] = field(default_factory=dict)

    def use(self, kind: str, label: str, url: str, title: str | None, line: int, place: int, defined: bool) -> None:
        url = _bare(url)
        known = self.found.get((kind, url))
        if known is None:
            self.found[kind, url] = Reference(f"ref-{len(self.found) + 1}", strip_inline(label) or url, url, title, kind, place, line, defined)
        else:
            known.first = min(known.first, place)
            known.title = known.title or title

    def resolve(self, text: str, line: int) -> str:
        """A line with its links replaced by their labels."""
        seen = 0

        def link(m: re.Match) -> str:
            nonlocal seen
            image = bool(m["image"])
            label = m["label"] or ("Image" if image else "Link")
            url, title, defined = m["angled"] or m["url"], m["t1"] or m["t2"] or m["t3"] or None, False
            if not url:
                wanted = m["ref"] or label
                if label_key(wanted) not in self.definitions:
                    self.broken.setdefault(wanted)
                    return label
                url, named = self.definitions[label_key(wanted)]
                title, defined = title or named, True
            self.use("image" if image else "link", label, url, title, line, line * 10_000 + seen, defined)
            seen += 1
            return label

        def shortcut(m: re.Match) -> str:
            target = self.definitions.get(label_key(m[1]))
            if target is None:
                return m[0]
            self.use("link", m[1], target[0], target[1], line, line * 10_000 + m.start(), True)
            return m[1]

        if "[" not in text:
            return text
        # Without a place where an address or a second label begins and ends, no link is looked for.
        inline, second = text.find("]("), text.find("][")
        if 0 <= inline < text.rfind(")") or 0 <= second < text.rfind("]") - 1:
            end = max(text.rfind("]"), text.rfind(")")) + 1
            text = _LINK.sub(link, text[:end]) + text[end:]
        end = text.rfind("]") + 1
        return _SHORTCUT.sub(shortcut, text[:end]) + text[end:]

    def ordered(self) -> list[Reference]:
        return sorted(self.found.values(), key=lambda r: r.first)


def blocks(lines: list[str], links: Links) -> Iterator[tuple[str, int, str]]:
    """(kind, line number, line): 'fence', 'code', 'divider', 'rule' or 'text'; definitions are taken out into ``links``.

    A fence is closed by its own character only; fence marks of the other kind inside are code.
    """
    fence = ""
    rows = []
    for n, line in enumerate(lines, 1):
        mark = _FENCE.match(line)
        if mark:
            char = mark[1] or mark[2]
            if fence and char != fence:
                rows.append(("code", n, line))
            else:
                fence = "" if fence else char
                rows.append(("fence", n, line))
        elif fence:
            rows.append(("code", n, line))
        elif d := _DEFINITION.match(line):
            links.definitions[label_key(d[1])] = (_bare(d[2] or d[3]), d[4] or d[5] or d[6] or None)
        elif _DIVIDER.match(line):
            rows.append(("divider", n, line))
        elif _RULE.match(line):
            rows.append(("rule", n, line))
        else:
            rows.append(("text", n, line))
    return iter(rows)


def _cells(row: str) -> str:
    row = row.strip(PY_WS)
    row = row[1:] if row.startswith("|") else row
    row = row[:-1] if row.endswith("|") else row
    return "\t".join(strip_inline(c.strip(PY_WS)) for c in re.split(r"(?<!\\)\|", row))


def _plain_line(line: str, readable: bool) -> str:
    line = _QUOTE.sub("│ " if readable else "", line, count=1)
    task = _TASK.match(line)
    if task:
        box = ("☑ " if task[2] in "xX" else "☐ ") if readable else ""
        line = task[1] + box + task[3]
    elif not readable:
        line = _ORDINAL.sub("", _BULLET.sub("", line, count=1), count=1)
    return strip_inline(line).rstrip(" \t")


def reference_list(references: list[Reference]) -> str:
    """The sections that list links and images."""
    parts = []
    for title, rows in (("References", [r for r in references if r.kind != "image"]), ("Media", [r for r in references if r.kind == "image"])):
        if rows:
            parts.append("\n".join([title, *(f"{n}. {r.label} — {r.url}" + (f" — {r.title}" if r.title else "") for n, r in enumerate(rows, 1))]))
    return "\n\n".join(parts)


def convert_text(source: str | None, mode: str = "readable", append_references: bool = True) -> tuple[str, list[Reference], list[str]]:
    """The converted text, the references in the order of their first use, and the broken labels."""
    if mode not in MODES:
        raise ValueError(f"mode must be one of {', '.join(MODES)}")
    if not source:
        return "", [], []
    links = Links()
    out: list[str] = []
    for kind, n, line in blocks(re.sub("\r\n?", "\n", source).split("\n"), links):
        if kind == "code":
            out.append(line)
        elif kind in ("fence", "divider"):
            if mode == "ai":
                out.append(line.rstrip(PY_WS))
        elif kind == "rule" and mode != "ai":
            continue
        else:
            line = links.resolve(line, n)
            if mode == "ai":
                out.append(_AI_HEADING.sub(r"\1 ", line.rstrip(PY_WS)))
            elif heading := _HEADING.match(line):
                text = strip_inline(_heading_text(heading[1]))
                if out and out[-1]:
                    out.append("")
                out.append(text)
                if mode == "readable":
                    out.append("─" * min(max(len(text), 3), 48))
                out.append("")
            elif _ROW.match(line):
                out.append(_cells(line))
            else:
                out.append(_plain_line(line, mode == "readable"))
    text = re.sub("\n{3,}", "\n\n", "\n".join(out)).strip(PY_WS)
    references = links.ordered()
    if append_references and references:
        text = f"{text.rstrip(PY_WS)}\n\n{reference_list(references)}"
    if mode == "ai" and text:
        text = f"<untrusted_document>\n{text}\n</untrusted_document>"
    return text, references, list(links.broken)


REFERENCE = T.StructType(
    [
        *[T.StructField(n, T.StringType()) for n in ("id", "label", "url", "title", "kind")],
        T.StructField("first_seen", T.LongType()),
        T.StructField("source_line", T.IntegerType()),
        T.StructField("defined", T.BooleanType()),
    ]
)


def convert(df: DataFrame, id_col: str, text_col: str, mode: str = "readable", append_references: bool = True, mode_col: str | None = None, append_col: str | None = None) -> DataFrame:
    """(doc_id, text, references, broken) of each document; options may come from columns."""
    src = df.select(
        F.col(id_col).alias("doc_id"),
        F.col(text_col).alias("text"),
        (F.coalesce(F.col(mode_col), F.lit(mode)) if mode_col else F.lit(mode)).alias("mode"),
        (F.coalesce(F.col(append_col), F.lit(append_references)) if append_col else F.lit(append_references)).alias("append"),
    )
    schema = T.StructType(
        [src.schema["doc_id"], T.StructField("text", T.StringType()), T.StructField("references", T.ArrayType(REFERENCE)), T.StructField("broken", T.ArrayType(T.StringType()))]
    )

    def one(r):
        mode = r["mode"] if r["mode"] in MODES else "readable"
        text, refs, broken = convert_text(r["text"], mode, r["append"])
        yield r["doc_id"], text, [{"id": x.id, "label": x.label, "url": x.url, "title": x.title, "kind": x.kind, "first_seen": x.first, "source_line": x.line, "defined": x.defined} for x in refs], broken

    return map_batches(src, one, schema)


def references(converted: DataFrame) -> DataFrame:
    """One row for each reference of converted documents."""
    return converted.select("doc_id", F.posexplode("references").alias("pos", "r")).select("doc_id", "pos", "r.*")
