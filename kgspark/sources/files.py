"""File sources: scans, extension and glob rules, text, PDF and DOCX readers."""

from __future__ import annotations

import io
import os
import re
import zipfile
import zlib
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ids
from ..functions.text import document_text, matches_any

TEXT = (".md", ".markdown", ".txt", ".log", ".rst")
BINARY = (".pdf", ".docx", ".doc")


def contained(root: str, path: str) -> bool:
    """Whether a path, with links resolved, stays under the root."""
    top = os.path.realpath(root)
    return os.path.commonpath([top, os.path.realpath(os.path.join(top, path))]) == top


def escaping_links(root: str) -> list[str]:
    """Links below a local root that lead out of it, as paths from the root; none where the root is not local.

    Only links are looked at one by one; the list is as long as there are such links.
    """
    top = os.path.realpath(root)
    if not os.path.isdir(top):
        return []
    found = []
    for folder, folders, names in os.walk(top, followlinks=False):
        for name in (*folders, *names):
            full = os.path.join(folder, name)
            if os.path.islink(full) and not contained(top, full):
                found.append(os.path.relpath(full, top))
    return sorted(found)


def _below(links: list[str]) -> Column:
    """Whether ``source_path`` is one of the links or below one."""
    out = F.lit(False)
    for path in links:
        out = out | (F.col("source_path") == path) | F.col("source_path").startswith(path + "/")
    return out


def scan(spark: SparkSession, root: str, exclude: list[str] | None = None, include: list[str] | None = None) -> DataFrame:
    """source_path, path, length, modificationTime and content of the files below a root.

    ``include`` names files or folders below the root, without links out of it;
    globs are left out. Links that escape the root are never read: they are the
    rows of ``refusals``.
    """
    tops = [root]
    if include:
        for path in include:
            if not contained(root, path):
                raise ValueError(f"{path} is not below {root}")
        tops = [os.path.join(root, path) for path in include]
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(tops)
    relative = F.regexp_replace("path", "^[a-z]+:/*", "/")
    prefixes = sorted({os.path.abspath(root).strip("/"), os.path.realpath(root).strip("/")}, key=len, reverse=True)
    relative = F.regexp_replace(relative, f"^/*(?:{'|'.join(map(re.escape, prefixes))})/", "")
    rows = files.withColumn("source_path", relative)
    links = escaping_links(root)
    if links:
        rows = rows.where(~_below(links))
    return rows.where(~matches_any(F.col("source_path"), exclude or [])) if exclude else rows


def refusals(spark: SparkSession, root: str) -> DataFrame:
    """(source_path, parse_status, status_reason, skip_reason) of the links that escape a root."""
    rows = [(path, "skipped", "symlink_refused", "symlink_refused") for path in escaping_links(root)]
    return spark.createDataFrame(rows, "source_path string, parse_status string, status_reason string, skip_reason string")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def with_parse_status(files: DataFrame, allowed: tuple[str, ...] = TEXT + BINARY) -> DataFrame:
    """ok or skipped by extension; an old .doc is taken in and fails with a reason."""
    ext = extension(F.col("source_path"))
    status = F.when(ext == ".doc", F.lit("failed")).when(ext.isin(*allowed), F.lit("ok")).otherwise(F.lit("skipped"))
    return files.withColumn("parse_status", status).withColumn("status_reason", F.when(ext == ".doc", F.lit("unsupported_doc_format"))).withColumn("skip_reason", F.when(status == "skipped", F.lit("unsupported_extension")))


def texts(files: DataFrame) -> DataFrame:
    """source_path, source_hash and normalised text of text files; bad bytes are replaced."""
    rows = files.where(extension(F.col("source_path")).isin(*TEXT))
    raw = F.make_valid_utf8(F.col("content").cast("string"))
    out = rows.select("source_path", F.sha2("content", 256).alias("source_hash"), F.col("length").alias("size"), document_text(raw).alias("text"))
    return out.withColumn("document_id", ids.document_id(F.col("source_path")))


_SHOWN = re.compile(rb"\(((?:\\.|[^\\()])*)\)\s*(?:Tj|')|\[((?:\((?:\\.|[^\\()])*\)|[^\]()])*)\]\s*TJ", re.S)
_STRING = re.compile(rb"\(((?:\\.|[^\\()])*)\)", re.S)
_STREAM = re.compile(rb"(<<(?:(?!endobj).)*?>>)?\s*stream\r?\n(.*?)\r?\n?endstream", re.S)
MAX_STREAM = 64 << 20


def _plain(raw: bytes) -> str:
    return re.sub(rb"\\(.)", rb"\1", raw).decode("utf-8", "replace")


def pdf_pages(content: bytes) -> list[str]:
    """Text shown by content streams, plain or deflated, one entry for each stream with any."""
    pages = []
    streams = [(m[1] or b"", m[2]) for m in _STREAM.finditer(content)] or [(b"", content)]
    for head, stream in streams:
        if b"FlateDecode" in head:
            tool = zlib.decompressobj()
            try:
                stream = tool.decompress(stream, MAX_STREAM)
            except zlib.error:
                continue
        shown = []
        for m in _SHOWN.finditer(stream):
            shown.append(_plain(m[1]) if m[1] is not None else "".join(map(_plain, _STRING.findall(m[2]))))
        if any(s.strip() for s in shown):
            pages.append(" ".join(shown))
    return pages


def docx_paragraphs(content: bytes) -> list[str]:
    """Non-empty paragraphs of the main part."""
    name = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        tree = ElementTree.fromstring(z.read("word/document.xml"))
    found = ("".join(t.text or "" for t in p.iter(f"{name}t")) for p in tree.iter(f"{name}p"))
    return [p for p in found if p.strip()]


READERS: dict[str, tuple[str, Callable[[bytes], list[str]]]] = {".pdf": ("page", pdf_pages), ".docx": ("paragraph", docx_paragraphs)}


def parts(files: DataFrame, readers: dict[str, tuple[str, Callable[[bytes], list[str]]]] = READERS, max_bytes: int = 200 << 20) -> DataFrame:
    """(source_path, order, type, text, status_reason) of PDF and DOCX files.

    A file without parts has one row with a reason: oversized, encrypted,
    corrupt, or ocr_required.
    """
    rows = files.withColumn("ext_", extension(F.col("source_path"))).where(F.col("ext_").isin(*readers))
    rows = rows.select("source_path", "ext_", F.when(F.col("length") <= max_bytes, F.col("content")).alias("content"))

    def read(ext: str, content: bytes | None) -> list[tuple]:
        kind, reader = readers[ext]
        if content is None:
            return [(0, kind, None, "oversized")]
        if ext == ".pdf" and b"/Encrypt" in content:
            return [(0, kind, None, "encrypted")]
        try:
            found = reader(content)
        except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, ValueError):
            return [(0, kind, None, "corrupt")]
        if ext == ".pdf" and not content.startswith(b"%PDF"):
            return [(0, kind, None, "corrupt")]
        return [(k, kind, t, None) for k, t in enumerate(found)] or [(0, kind, None, "ocr_required")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = [(path, *part) for path, ext, content in frame.itertuples(index=False) for part in read(ext, content)]
            yield pd.DataFrame(out, columns=["source_path", "order", "type", "text", "status_reason"])

    return rows.mapInPandas(run, "source_path string, order long, type string, text string, status_reason string")


def parsed(files: DataFrame, readers: dict[str, tuple[str, Callable[[bytes], list[str]]]] = READERS, max_bytes: int = 200 << 20) -> tuple[DataFrame, DataFrame]:
    """Documents and parts of all readable files.

    Documents have source_path, source_hash, size, text, document_id and
    status_reason (null where the text could be read); the text of a PDF or DOCX
    file is its parts, joined by blank lines. Parts have document_id, order, type
    and text.
    """
    pieces = parts(files, readers, max_bytes).withColumn("document_id", ids.document_id(F.col("source_path")))
    joined = pieces.groupBy("source_path").agg(F.array_sort(F.collect_list(F.struct("order", "text"))).alias("p"), F.max("status_reason").alias("status_reason"))
    body = document_text(F.array_join(F.transform("p", lambda x: x["text"]), "\n\n"))
    binary = files.select("source_path", F.sha2("content", 256).alias("source_hash"), F.col("length").alias("size")).join(joined, "source_path")
    binary = binary.select("source_path", "source_hash", "size", body.alias("text"), ids.document_id(F.col("source_path")).alias("document_id"), "status_reason")
    plain = texts(files).withColumn("status_reason", F.lit(None).cast("string"))
    return plain.unionByName(binary), pieces.where("text is not null").select("document_id", "order", "type", "text")
