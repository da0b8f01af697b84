"""Files to documents: by extension, with a size limit; Markdown, text, HTML, word-processor and image files."""

from __future__ import annotations

import io
import re
import zipfile
from html import escape
from xml.etree import ElementTree

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.batches import map_batches
from .html import html_to_markdown

# The greatest file, and the extensions of each format.
MAX_BYTES = 30 * 1024 * 1024
FORMATS = {"markdown": ("md", "markdown"), "text": ("txt",), "html": ("html", "htm"), "docx": ("docx",), "pdf": ("pdf",), "image": ("png", "jpg", "jpeg", "webp", "bmp", "gif")}
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def extension(name: Column) -> Column:
    """What follows the last dot of a name in small letters; the whole name without a dot."""
    return F.element_at(F.split(F.lower(name), r"\."), -1)


def format_of(name: Column) -> Column:
    """The format of a file by its extension; null for others."""
    e, out = extension(name), None
    for kind, ends in FORMATS.items():
        out = (F.when if out is None else out.when)(e.isin(*ends), kind)
    return out


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """path, length and content of files within the size limit; the limit is pushed down to the scan."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).filter(F.col("length") <= MAX_BYTES)


def docx_to_html(data: bytes) -> str:
    """Headings, paragraphs, emphasis, links, lists and tables of a word-processor file."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
        links = {}
        if "word/_rels/document.xml.rels" in z.namelist():
            links = {e.get("Id"): e.get("Target") for e in ElementTree.fromstring(z.read("word/_rels/document.xml.rels"))}

    def run(r) -> str:
        text = "".join(escape(t.text or "") if t.tag == f"{_W}t" else "<br>" if t.tag == f"{_W}br" else "\t" if t.tag == f"{_W}tab" else "" for t in r)
        props = r.find(f"{_W}rPr")
        for tag, html in (("b", "strong"), ("i", "em"), ("strike", "s")):
            mark = props.find(f"{_W}{tag}") if props is not None else None
            if text and mark is not None and mark.get(f"{_W}val") not in ("0", "false"):
                text = f"<{html}>{text}</{html}>"
        return text

    def inline(p) -> str:
        out = []
        for c in p:
            if c.tag == f"{_W}r":
                out.append(run(c))
            elif c.tag == f"{_W}hyperlink":
                out.append(f'<a href="{escape(links.get(c.get(f"{_R}id")) or "")}">{inline(c)}</a>')
        return "".join(out)

    def paragraph(p) -> str:
        props = p.find(f"{_W}pPr")
        style = props.find(f"{_W}pStyle").get(f"{_W}val", "") if props is not None and props.find(f"{_W}pStyle") is not None else ""
        level = re.fullmatch(r"[Hh]eading\s?([1-6])", style)
        text = inline(p)
        if level:
            return f"<h{level[1]}>{text}</h{level[1]}>"
        if props is not None and props.find(f"{_W}numPr") is not None:
            return f"<ul><li>{text}</li></ul>"
        return f"<p>{text}</p>" if text else ""

    def table(t) -> str:
        rows = ("".join(f"<td>{' '.join(inline(p) for p in c.iter(f'{_W}p'))}</td>" for c in r.iter(f"{_W}tc")) for r in t.iter(f"{_W}tr"))
        return "<table>" + "".join(f"<tr>{r}</tr>" for r in rows) + "</table>"

    html = "".join(paragraph(c) if c.tag == f"{_W}p" else table(c) if c.tag == f"{_W}tbl" else "" for c in body)
    return html.replace("</ul><ul>", "")


# What is said about reading order, images, sizes and types.
_PDF = "PDF columns and complex tables may not retain their original reading order."
_IMAGE = "This image is ready for local OCR and redaction. No image data leaves your device."
_GIF = "Animated GIFs are handled as a single still frame and export as PNG."
_TOO_LARGE = "This file is larger than the 30 MB local import limit."
_UNKNOWN = "Unsupported file type. Use Markdown, TXT, HTML, DOCX, PDF, PNG, JPG, or WEBP."
IMPORTED = T.StructType(
    [
        *[T.StructField(n, T.StringType()) for n in ("path", "file_name", "format", "text")],
        T.StructField("warnings", T.ArrayType(T.StringType())),
        T.StructField("needs_ocr", T.BooleanType()),
        T.StructField("error", T.StringType()),
    ]
)


def import_files(files: DataFrame) -> DataFrame:
    """Rows of IMPORTED for path, length and content; what can't be read has an error instead of a text."""
    named = files.withColumn("file_name", F.element_at(F.split("path", "/"), -1))
    src = named.select("path", "file_name", format_of(F.col("file_name")).alias("format"), F.col("length").alias("size"), F.when(F.col("length") <= MAX_BYTES, F.col("content")).alias("content"))

    def one(r):
        kind, data, text, warnings, error = r["format"], r["content"], "", [], None
        try:
            if r["size"] > MAX_BYTES:
                error = _TOO_LARGE
            elif kind in ("markdown", "text"):
                text = re.sub("\r\n?", "\n", data.decode("utf-8-sig", "replace")).replace("\0", "")
            elif kind == "html":
                text = html_to_markdown(data.decode("utf-8-sig", "replace"))
            elif kind == "docx":
                text = html_to_markdown(docx_to_html(data))
            elif kind == "pdf":
                warnings = [_PDF]
            elif kind == "image":
                warnings = [_IMAGE, _GIF] if r["file_name"].lower().endswith(".gif") else [_IMAGE]
            else:
                error = _UNKNOWN
        except Exception as e:  # noqa: BLE001 - a broken file is a row, not the end of the job
            error = f"The file could not be read: {type(e).__name__}"
        yield r["path"], r["file_name"], kind, None if error else text, warnings, kind in ("pdf", "image"), error

    return map_batches(src, one, IMPORTED, rows=16)


def pdf_document(page_rows: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc_id, text, warnings): laid-out pages of each file in order; pages without items are told.

    ``page_rows``: doc_id, page, text from ``layout_rows``; ``pages``: doc_id, n_pages.
    """
    texts = page_rows.filter("text <> ''").groupBy("doc_id").agg(F.array_join(F.sort_array(F.collect_list(F.struct("page", "text"))).getField("text"), "\n\n").alias("text"), F.count("*").alias("full"))
    empty = F.col("n_pages") - F.coalesce("full", F.lit(0))
    told = F.when(empty > 0, F.concat(empty.cast("string"), F.when(empty == 1, " page").otherwise(" pages"), F.lit(" contained no selectable text. Scanned PDFs need OCR.")))
    return pages.join(texts, "doc_id", "left").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.array_compact(F.array(told, F.lit(_PDF))).alias("warnings"))


def text_from_url(url: Column) -> Column:
    """The text that an address carries in its ``text`` parameter, else the sample that its ``sample`` parameter names; null without either."""
    from ..plans.samples import SAMPLES

    text = F.nullif(F.url_decode(F.try_parse_url(url, F.lit("QUERY"), F.lit("text"))), F.lit(""))
    samples = F.create_map(*[F.lit(x) for kv in SAMPLES.items() for x in kv])
    return F.coalesce(text, F.try_element_at(samples, F.lower(F.url_decode(F.try_parse_url(url, F.lit("QUERY"), F.lit("sample"))))))
