"""Functions for SQL: scalar functions by name, and table functions for lateral joins."""

from __future__ import annotations

import unicodedata

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..operators.convert import convert_text
from ..operators.entities import token_chunks
from ..operators.paging import page_at
from ..operators.rules import RULES
from ..operators.scan import spans
from ..sources.html import html_to_markdown
from .language import guess
from .text import fingerprint_batch


def register(spark: SparkSession) -> list[str]:
    """Registers doc_fingerprint, convert_markdown, html_to_markdown, nfkc and language_code, and the table functions
    scan_findings(text), chunk_text(text, budget, overlap) and text_pages(text); returns the names.

    Nulls give nulls, or no rows.
    """

    def convert_markdown(text: str, mode: str) -> str:
        return None if text is None else convert_text(text, mode or "readable")[0]

    def markdown(html: str) -> str:
        return None if html is None else html_to_markdown(html)

    def nfkc(text: str) -> str:
        return None if text is None else unicodedata.normalize("NFKC", text)

    def language_code(text: str) -> str:
        return None if text is None else guess(" ".join("".join(c if c.isalpha() else " " for c in text).split()))[0]

    def doc_fingerprint(text: str) -> str:
        return fingerprint_batch([text])[0]

    scalars = {"doc_fingerprint": doc_fingerprint, "convert_markdown": convert_markdown, "html_to_markdown": markdown, "nfkc": nfkc, "language_code": language_code}
    for name, fn in scalars.items():
        spark.udf.register(name, F.udf(fn, "string", useArrow=True))

    @F.udtf(returnType="rule string, type string, severity string, placeholder string, start_pos int, end_pos int, value string")
    class ScanFindings:
        def eval(self, text: str):
            for order, a, b in spans(text) if text else ():
                r = RULES[order - 1]
                yield r.id, r.type, r.severity, r.placeholder, a, b, text[a:b]

    @F.udtf(returnType="chunk_idx int, text string, text_offset int, token_count int")
    class ChunkText:
        def eval(self, text: str, budget: int, overlap: int):
            for i, c in enumerate(token_chunks(text, budget, overlap, lambda s: len(s.split()))):
                yield i, *c

    @F.udtf(returnType="page_no int, cursor int, next_cursor int, text string")
    class TextPages:
        def eval(self, text: str):
            cursor, n = 0, 0
            while text is not None and cursor is not None:
                p = page_at(text, cursor, "ai")
                yield n, cursor, p["nextCursor"], p["text"]
                cursor, n = p["nextCursor"], n + 1

    tables = {"scan_findings": ScanFindings, "chunk_text": ChunkText, "text_pages": TextPages}
    for name, fn in tables.items():
        spark.udtf.register(name, fn)
    return [*scalars, *tables]
