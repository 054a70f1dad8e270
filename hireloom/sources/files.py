"""Document files: what they are, whether they may come in, and their text."""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_BYTES = 15 << 20
#: Endings that are taken.
ENDINGS = ["pdf", "docx", "doc", "txt", "md", "rtf"]
#: First bytes of a kind of file, in hexadecimal.
MAGIC = {"pdf": "25504446", "zip": "504B0304", "doc": "D0CF11E0"}
_WORDS = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def ending(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))


def kind_of(content: Column, name: Column) -> Column:
    """pdf, docx, doc or text: by the first bytes, then by the ending."""
    head = F.hex(F.substring(content, 1, 4))
    by_bytes = F.when(head == MAGIC["pdf"], "pdf").when(head == MAGIC["zip"], "docx").when(head == MAGIC["doc"], "doc")
    by_name = F.when(ending(name).isin("txt", "md"), "text").when(ending(name).isin("pdf", "docx", "doc"), ending(name))
    return F.coalesce(by_bytes, by_name, F.lit("text"))


def safe_name(name: Column) -> Column:
    """The last part of a path, other characters than letters, digits, . _ - as _, at most 150 of them."""
    last = F.regexp_replace(F.regexp_extract(name, r"([^/\\]*)$", 1), "[^A-Za-z0-9._-]+", "_")
    return F.coalesce(F.nullif(F.substring(F.btrim(last, F.lit("._")), 1, 150), F.lit("")), F.lit("file"))


def refused(content: Column, length: Column, name: Column) -> Column:
    """Why an upload is refused; null if it isn't."""
    head = F.hex(F.substring(content, 1, 4))
    wrong = lambda end, magic: (ending(name) == end) & (head != magic)
    return (
        F.when(~ending(name).isin(ENDINGS), "ending").when(length == 0, "empty").when(length > MAX_BYTES, "too large")
        .when(wrong("pdf", MAGIC["pdf"]) | wrong("docx", MAGIC["zip"]) | wrong("doc", MAGIC["doc"]), "signature")
    )


def docx_text(content: bytes) -> str | None:
    """Paragraphs of a word file, table cells included; null for what isn't one."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            root = ElementTree.fromstring(z.read("word/document.xml"))
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
        return None
    piece = {f"{_WORDS}t": lambda e: e.text or "", f"{_WORDS}tab": lambda e: " ", f"{_WORDS}br": lambda e: "\n"}
    return "\n".join("".join(piece[e.tag](e) for e in p.iter() if e.tag in piece) for p in root.iter(f"{_WORDS}p"))


def plain_text(content: bytes) -> str:
    return re.sub("^\ufeff", "", content.decode("utf-8", "ignore"))


@F.pandas_udf(T.StringType())
def text_of(content: pd.Series, kind: pd.Series) -> pd.Series:
    readers = {"text": plain_text, "docx": docx_text}
    return pd.Series([readers[k](bytes(c)) if k in readers else None for c, k in zip(content, kind)], dtype=object)


def read(spark: SparkSession, path: str) -> DataFrame:
    """(name, kind, checksum, refused, text, pages, warning) of the files under a path, duplicates included.

    Text comes from plain and word files; other kinds, for which there is no reader here, have a warning.
    Files of no bytes are not listed.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.regexp_extract("path", "([^/]*)$", 1)
    rows = files.select(safe_name(name).alias("name"), kind_of(F.col("content"), name).alias("kind"), F.sha2("content", 256).alias("checksum"), refused(F.col("content"), F.col("length"), name).alias("refused"), "content")
    rows = rows.withColumn("text", F.when(F.col("refused").isNull(), text_of("content", "kind"))).drop("content")
    words = F.size(F.filter(F.split("text", r"\s+"), lambda w: w != ""))
    warning = F.when(F.col("text").isNull() & F.col("refused").isNull(), F.concat(F.lit("no reader for "), "kind"))
    return rows.withColumns({"pages": F.when(F.col("text").isNotNull(), F.greatest(F.lit(1), F.bround(words / 500).cast("int"))), "warning": warning})
