"""What leaves the engine: text and word-processor files, lists of ids, data points."""

from __future__ import annotations

import io
import zipfile
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.batches import map_batches

_TYPES = '<?xml version="1.0" encoding="UTF-8"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>'
_RELS = '<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/></Relationships>'
_OPEN = '<?xml version="1.0" encoding="UTF-8"?><w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>'


def docx_bytes(text: str) -> bytes:
    """A word-processor file with a paragraph for each line."""
    lines = (f'<w:p><w:r><w:t xml:space="preserve">{escape("".join(c for c in line if c == chr(9) or c >= " "))}</w:t></w:r></w:p>' for line in text.split("\n"))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", _TYPES)
        z.writestr("_rels/.rels", _RELS)
        z.writestr("word/document.xml", _OPEN + "".join(lines) + "</w:body></w:document>")
    return out.getvalue()


def docx_files(converted: DataFrame) -> DataFrame:
    """(doc_id, content) of each converted document with a text."""
    src = converted.select("doc_id", "text").filter("text <> ''")
    return map_batches(src, lambda r: iter([(r["doc_id"], docx_bytes(r["text"]))]), T.StructType([src.schema["doc_id"], T.StructField("content", T.BinaryType())]), rows=64)


def write_text(converted: DataFrame, path: str) -> None:
    """One folder for each document with its text; empty texts are left out."""
    converted.select("doc_id", "text").filter("text <> ''").write.mode("overwrite").partitionBy("doc_id").text(path)


def write_docx(converted: DataFrame, path: str) -> None:
    """Word-processor files as rows of a binary column, which keeps many small files out of the store."""
    docx_files(converted).write.mode("overwrite").parquet(path)


def id_list(findings: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, ids): the ids of each document's findings in order, as "[a, b]"."""
    ids = F.sort_array(F.collect_list(F.struct("start_pos", (-F.col("end_pos")).alias("e"), "id"))).getField("id")
    return findings.groupBy(key).agg(F.concat(F.lit("["), F.array_join(ids, ", "), F.lit("]")).alias("ids"))


def write_points(points: DataFrame, path: str) -> None:
    points.write.mode("append").parquet(path)
