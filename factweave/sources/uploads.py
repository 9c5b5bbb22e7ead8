"""Uploaded files as texts, whatever store they are in: text formats and the text inside DOCX.

Spark lists the files and reads their bytes, one row a file, so a store that only Spark reaches
will do; tasks only turn bytes into text.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TEXT = (".txt", ".md", ".json", ".csv")
WORDS = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_PART = "word/document.xml"


def docx_text(content: bytes) -> str:
    """The paragraphs of a document, one a line; breaks inside a paragraph are line breaks, tabs are tabs."""
    with zipfile.ZipFile(io.BytesIO(content)) as packed:
        root = ElementTree.fromstring(packed.read(_PART))
    lines = []
    for paragraph in root.iter(f"{WORDS}p"):
        made = []
        for x in paragraph.iter():
            if x.tag == f"{WORDS}t":
                made.append(x.text or "")
            elif x.tag == f"{WORDS}tab":
                made.append("\t")
            elif x.tag in (f"{WORDS}br", f"{WORDS}cr"):
                made.append("\n")
        lines.append("".join(made))
    return "\n".join(lines)


def docx_bytes(text: str) -> bytes:
    """A document with a paragraph for each line of a text, as small as readers accept."""
    body = "".join(f'<w:p><w:r><w:t xml:space="preserve">{escape(line)}</w:t></w:r></w:p>' for line in text.split("\n"))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as packed:
        packed.writestr(_PART, f'<?xml version="1.0" encoding="UTF-8"?><w:document xmlns:w="{WORDS[1:-1]}"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def file_text(name: str, content: bytes) -> tuple[str | None, str | None]:
    """(text, error) of a file by the ending of its name; bytes that are no UTF-8 become replacement characters."""
    low = name.lower()
    if low.endswith(TEXT):
        return content.decode("utf-8", "replace"), None
    if low.endswith(".docx"):
        try:
            return docx_text(content), None
        except (zipfile.BadZipFile, KeyError, ElementTree.ParseError) as e:
            return None, f"not a document: {e}"
    return None, f"unsupported ending: {low.rpartition('.')[2] if '.' in low else ''}"


def texts_of(files: DataFrame) -> DataFrame:
    """(path, text, error) of files (path, content)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = [file_text(p, bytes(c)) for p, c in zip(frame["path"], frame["content"], strict=True)]
            yield pd.DataFrame([(p, *x) for p, x in zip(frame["path"], found, strict=True)], columns=["path", "text", "error"])

    return files.select("path", "content").mapInPandas(run, "path string, text string, error string")


def uploaded(spark: SparkSession, path: str) -> DataFrame:
    """(path, text, error) of the files of a folder or a glob; an unreadable file is a row with an error, an empty one is no row."""
    return texts_of(spark.read.format("binaryFile").load(path))


def packed(texts: DataFrame, name: str, text: str) -> DataFrame:
    """(path, content): texts as the files their names ask for; what is no DOCX is UTF-8."""
    as_docx = F.pandas_udf(lambda s: s.map(docx_bytes), "binary")
    return texts.select(F.col(name).alias("path"), F.when(F.lower(name).endswith(".docx"), as_docx(F.col(text))).otherwise(F.encode(text, "UTF-8")).alias("content"))
