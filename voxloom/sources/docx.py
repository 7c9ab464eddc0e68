"""Word documents as rows: bytes to blocks in document order, and minutes or translations to bytes.

A document is a zip file around an XML body, so the standard library is enough. Layout beyond headings and bold is not written.
"""

from __future__ import annotations

import io
import zipfile
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from voxloom.plans import inputs
from voxloom.plans.registry import query

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
#: The parts a reader asks for besides the body.
_TYPES = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>'
_RELS = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/></Relationships>'


def _text(node) -> str:
    return "".join(t.text or "" if t.tag == f"{_W}t" else "\t" if t.tag == f"{_W}tab" else "\n" if t.tag == f"{_W}br" else "" for t in node.iter())


def blocks(raw: bytes) -> list[str]:
    """Paragraphs and table rows (cells joined by a bar) in document order; empty ones are left out."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    out = []
    for child in body if body is not None else ():
        if child.tag == f"{_W}tbl":
            out += [" | ".join(_text(c).strip() for c in row.findall(f"{_W}tc")) for row in child.findall(f"{_W}tr")]
        elif child.tag == f"{_W}p":
            out.append(_text(child))
    return [x for x in (b.strip() for b in out) if x.strip(" |")]


def document(title: str, paragraphs: list[str], rows: list[list[str]] = ()) -> bytes:
    """A document with a bold title, paragraphs and a table; equal input gives equal bytes."""
    p = lambda t, bold=False: f'<w:p><w:r>{"<w:rPr><w:b/></w:rPr>" if bold else ""}<w:t xml:space="preserve">{escape(t)}</w:t></w:r></w:p>'
    table = "".join("<w:tr>" + "".join(f"<w:tc>{p(c)}</w:tc>" for c in r) + "</w:tr>" for r in rows)
    body = p(title, True) + "".join(map(p, paragraphs)) + (f"<w:tbl>{table}</w:tbl>" if table else "")
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in (("[Content_Types].xml", _TYPES), ("_rels/.rels", _RELS), ("word/document.xml", f'<?xml version="1.0" encoding="UTF-8"?><w:document xmlns:w="{_W[1:-1]}"><w:body>{body}</w:body></w:document>')):
            z.writestr(zipfile.ZipInfo(name), text)
    return out.getvalue()


def document_column(title: Column, paragraphs: Column) -> Column:
    @F.pandas_udf("binary")
    def run(t: pd.Series, p: pd.Series) -> pd.Series:
        return pd.Series([document(a or "", [x for x in b if x]) for a, b in zip(t, p)])

    return run(title, paragraphs)


def blocks_column(content: Column) -> Column:
    @F.pandas_udf("array<string>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda raw: blocks(bytes(raw)))

    return run(content)


def _minutes(spark, sf_dir):
    said = F.transform(F.array_sort(F.collect_list(F.struct("turn", F.regexp_replace(F.trim("text"), r"\s+", " ").alias("t")))), lambda s: s.t)
    return inputs.load(spark, sf_dir, "conversations").groupBy("conv_id").agg(said.alias("p"))


@query("snk_docx_mom", "SELECT conv_id, 1 + count(*) FILTER (trim(text) <> '') AS blocks FROM conversations GROUP BY conv_id")
def snk_docx_mom(spark, sf_dir):
    """Minutes as documents; the blocks read back from the bytes are counted."""
    m = _minutes(spark, sf_dir).select("conv_id", document_column(F.lit("Minutes"), F.col("p")).alias("content"))
    return m.select("conv_id", F.size(blocks_column(F.col("content"))).cast("long").alias("blocks"))


@query("snk_docx_translation", "SELECT doc_id, md5(trim(regexp_replace(left(text, 300), '\\s+', ' ', 'g'))) AS y FROM documents")
def snk_docx_translation(spark, sf_dir):
    text = F.trim(F.regexp_replace(F.substring("text", 1, 300), r"\s+", " "))
    d = inputs.load(spark, sf_dir, "documents").select("doc_id", document_column(F.lit("Translation"), F.array(text)).alias("content"))
    return d.select("doc_id", F.md5(F.get(blocks_column(F.col("content")), F.lit(1))).alias("y"))


@query("src_docx", "SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS block_no, trim(regexp_replace(trim(text), '\\s+', ' ', 'g')) AS text FROM conversations WHERE trim(text) <> '' UNION ALL SELECT DISTINCT conv_id, 0, 'Minutes' FROM conversations")
def src_docx(spark, sf_dir):
    m = _minutes(spark, sf_dir).select("conv_id", document_column(F.lit("Minutes"), F.col("p")).alias("content"))
    return m.select("conv_id", F.posexplode(blocks_column(F.col("content"))).alias("block_no", "text"))
