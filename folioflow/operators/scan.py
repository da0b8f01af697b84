"""The scanner: findings of all rules with their offsets in the text as stored."""

from __future__ import annotations

import bisect
import re
import unicodedata
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.checks import iban, ipv6, luhn
from ..functions.text import fingerprint_batch
from .batches import map_batches
from .rules import INVISIBLE, RULES


_HIDDEN = re.compile(f"[{INVISIBLE}]")


_CHECKS = {"": lambda v: True, "luhn": luhn, "iban": iban, "ipv6": ipv6}


def folded(text: str) -> tuple[str, list[int] | None]:
    """The text with each character in its compatibility form and without unseen ones, and where each character was.

    None instead of offsets: nothing changed.
    """
    if text.isascii():
        return text, None
    out, at = [], []
    for i, c in enumerate(text):
        if c > "\x7f":
            if _HIDDEN.match(c):
                continue
            c = unicodedata.normalize("NFKC", c)
        out.append(c)
        at.extend([i] * len(c))
    return "".join(out), at


def spans(text: str) -> Iterator[tuple[int, int, int]]:
    """(rule order, start, end) of each match; of equal spans of one type only the first rule's."""
    form, at = folded(text)
    low = form.lower()
    seen = set()
    for rule in RULES:
        if rule.needs and not any(x in low for x in rule.needs):
            continue
        body = text if rule.raw else form
        for m in rule.regex.finditer(body):
            value = m[rule.group]
            if not value or not _CHECKS[rule.check](value):
                continue
            a = m.start() + (m[0].rindex(value) if rule.group else 0)
            b = a + len(value)
            if at is not None and not rule.raw:
                a, b = at[a], at[b - 1] + 1
            if (a, b, rule.type) not in seen:
                seen.add((a, b, rule.type))
                yield rule.order, a, b


class Lines:
    """The line, from 1, of each offset of a text."""

    def __init__(self, text: str):
        self.starts = [0, *(m.end() for m in re.finditer("\n", text))]

    def of(self, offset: int) -> int:
        return bisect.bisect_right(self.starts, offset)


def scan(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """All findings of a text column before consolidation; null and empty texts have none.

    A map without a shuffle: texts go into Python and spans, values and lines
    come back, never the text. What the rule says is joined from literals.
    """
    src = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).filter("text <> ''")
    text, number = T.StringType(), T.IntegerType()
    schema = T.StructType(
        [src.schema["doc_id"], *[T.StructField(n, t) for n, t in (("doc_fingerprint", text), ("rule_ord", number), ("start_pos", number), ("end_pos", number), ("value", text), ("line", number))]]
    )

    def finish(rows: list[dict]) -> None:
        # Found first, so that only texts with findings get a fingerprint.
        for r in rows:
            r["spans"] = list(spans(r["text"]))
        hit = [r for r in rows if r["spans"]]
        for r, f in zip(hit, fingerprint_batch([r["text"] for r in hit])):
            r["fp"] = f

    def one(r: dict) -> Iterator[tuple]:
        if r["spans"]:
            lines = Lines(r["text"])
            for order, a, b in r["spans"]:
                yield r["doc_id"], r["fp"], order, a, b, r["text"][a:b], lines.of(a)

    found = map_batches(src, one, schema, before=finish)
    table = F.array(*[F.struct(*[F.lit(getattr(r, n)).alias(n) for n in ("id", "type", "severity", "title", "detail", "placeholder")]) for r in RULES])
    rule = F.element_at(table, F.col("rule_ord"))
    return found.select(
        "doc_id",
        F.concat_ws("-", F.lit("rule"), rule["id"], "start_pos", "end_pos").alias("id"),
        "doc_fingerprint",
        *[rule[n].alias(n) for n in ("type", "severity", "title", "detail")],
        "value",
        "start_pos",
        "end_pos",
        "line",
        rule["placeholder"].alias("placeholder"),
        F.lit("rule").alias("source"),
        F.lit(None).cast("double").alias("confidence"),
        F.lit(None).cast("string").alias("model_label"),
        "rule_ord",
    )
