"""Scans (SRC1-SRC13): files to texts and to relations. One ``binaryFile`` scan feeds every decoder; errors are a column."""

from __future__ import annotations

import csv
import io
from collections.abc import Callable, Iterator
from pathlib import PurePosixPath

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillframe.session import broadcast_if_small
from quillframe.functions import text as T
from quillframe.functions import values as V
from quillframe.sources import ooxml

CELL = "doc_id string, t int, r int, c_unique int, c_expanded array<int>, tc_ord int, grid_start int, grid_span int, vmerge_raw string, origin_r int, text string, shd_fill string, font_pt double, align string"
PARAGRAPH = "doc_id string, p int, text string, align string"
RUN = "doc_id string, scope string, p int, t int, r int, tc_ord int, run int, text string, is_underline boolean, rpr string, rpr_tags array<string>"
NODE = "doc_id string, node_id long, parent_id long, ord int, tag string, parent_tag string"

#: Decoders by extension; a PDF decoder may be added where a library is at hand (SRC7).
DECODERS: dict[str, Callable[[bytes], str]] = {}


def plain_text(content: bytes) -> str:
    """SRC2: UTF-8, else GBK, else GB18030, else Latin-1."""
    for encoding in ("utf-8", "gbk", "gb18030"):
        try:
            return content.decode(encoding)
        except UnicodeDecodeError:
            continue
    return content.decode("latin-1")


def csv_text(content: bytes) -> str:
    """SRC3: rows joined by a comma and a space."""
    return "\n".join(", ".join(row) for row in csv.reader(io.StringIO(content.decode("utf-8", "replace"))))


DECODERS |= {".txt": plain_text, ".md": plain_text, ".csv": csv_text, ".docx": ooxml.docx_text, ".doc": ooxml.docx_text, ".xlsx": ooxml.xlsx_text, ".xls": ooxml.xlsx_text}


def scan(spark: SparkSession, *paths: str) -> DataFrame:
    """path, ext, length, content of the files below the paths."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(list(paths))
    return found.select("path", T.extension(F.col("path")).alias("ext"), "length", "content")


def accepted(files: DataFrame, extensions: list[str], most: int = V.UPLOAD_BYTES) -> tuple[DataFrame, DataFrame]:
    """SRC9, SRC10: files of the allowed kinds and size, and the others with their reason."""
    reason = F.when(~F.col("ext").isin(extensions), "type").when(F.col("length") > most, "size")
    marked = files.withColumn("reason", reason)
    return marked.filter("reason IS NULL").drop("reason"), marked.filter("reason IS NOT NULL").drop("content")


def texts(files: DataFrame, decoders: dict[str, Callable[[bytes], str]] | None = None) -> DataFrame:
    """SRC1, SRC8: path, success, text, error; a file that cannot be read is a row with its error (D10)."""
    table = {**DECODERS, **(decoders or {})}

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for path, ext, content in zip(frame["path"], frame["ext"], frame["content"]):
                decode = table.get(ext)
                try:
                    out.append((path, True, decode(bytes(content)), None) if decode else (path, False, None, f"unsupported: {ext}"))
                except Exception as e:  # noqa: BLE001  one broken file is a row, not a failed job
                    out.append((path, False, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["path", "success", "text", "error"])

    return files.select("path", "ext", "content").mapInPandas(run, "path string, success boolean, text string, error string")


def _relation(files: DataFrame, rows, schema: str) -> DataFrame:
    names = [f.split()[0] for f in schema.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, content in zip(frame["path"], frame["content"]):
                try:
                    found = list(rows(path, ooxml.Docx(bytes(content))))
                except Exception:  # noqa: BLE001  see unreadable()
                    continue
                out = pd.DataFrame(found, columns=names, dtype=object)
                yield out

    return files.filter(F.col("ext").isin(".docx", ".doc")).select("path", "content").mapInPandas(run, schema)


def cells(files: DataFrame) -> DataFrame:
    """SRC13: the ``cell`` relation."""
    return _relation(files, ooxml.cell_rows, CELL)


def paragraphs(files: DataFrame) -> DataFrame:
    return _relation(files, ooxml.paragraph_rows, PARAGRAPH)


def runs(files: DataFrame) -> DataFrame:
    return _relation(files, ooxml.run_rows, RUN)


def nodes(files: DataFrame) -> DataFrame:
    return _relation(files, ooxml.node_rows, NODE)


def resolved_templates(names: DataFrame, registry: DataFrame, assets: str) -> DataFrame:
    """SRC11: (name) to path: the registry's, else the name if it is a path, else a file of that name among the assets."""
    given = F.when(F.contains("name", F.lit("/")), F.col("name"))
    return names.join(broadcast_if_small(registry.select("name", F.col("path").alias("registered"))), "name", "left").select("name", F.coalesce("registered", given, F.concat(F.lit(assets.rstrip("/") + "/"), "name")).alias("path"))


def safe_path(path: str, roots: list[str]) -> str:
    """SRC12: the path, if it lies below one of the roots after its dots are resolved (whole components, D15)."""
    parts: list[str] = []
    for part in PurePosixPath(path).parts:
        if part == "..":
            parts = parts[:-1] if len(parts) > 1 else parts
        elif part != ".":
            parts.append(part)
    clean = PurePosixPath(*parts)
    if not any(clean.is_relative_to(r) for r in roots):
        raise ValueError(f"outside the allowed folders: {path}")
    return str(clean)


def unreadable(files: DataFrame) -> DataFrame:
    """D10: path and error of the documents that the relations leave out, as they can not be opened."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for path, content in zip(frame["path"], frame["content"]):
                try:
                    ooxml.Docx(bytes(content))
                except Exception as e:  # noqa: BLE001  any failure is a row
                    out.append((path, type(e).__name__, str(e)))
            yield pd.DataFrame(out, columns=["path", "error", "detail"])

    return files.filter(F.col("ext").isin(".docx", ".doc")).select("path", "content").mapInPandas(run, "path string, error string, detail string")
