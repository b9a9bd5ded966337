"""What the operators of this subpackage share: shipping, batches, checkpoints, digests."""

from __future__ import annotations

import functools
import hashlib
import os
import tempfile
import zipfile
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillframe.session import checkpointed, delete_at_end, discard, shared_folder, stored

__all__ = ["checkpointed", "delete_at_end", "discard", "shared_folder", "stored"]

#: Rows an Arrow batch carries to a Python worker. Texts are long, so batches are short.
BATCH_ROWS = 512
BATCH_BYTES = 16 << 20

ASCII_SPACE = " \t\n\x0b\x0c\r"


def prepare(spark: SparkSession) -> None:
    """Ship this package to the executors once per context and keep Arrow batches small (where the session's are smaller, they stay)."""
    context = spark.sparkContext
    if not getattr(context, "_quillframe_shipped", False):
        root = Path(__file__).resolve().parents[2]
        path = os.path.join(tempfile.mkdtemp(), "quillframe.zip")
        with zipfile.ZipFile(path, "w") as out:
            for p in sorted((root / "quillframe").rglob("*.py")):
                out.write(p, p.relative_to(root))
        context.addPyFile(path)
        context._quillframe_shipped = True
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(key).lower().rstrip("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, most)


def read_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def boxed(docs: DataFrame, null_key: int = 2**63 - 1) -> DataFrame:
    """key (doc_id; nulls are ``null_key``: last), digest (of the text), row (all columns as a struct): names of docs can not clash with an operator's own."""
    row = F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in docs.columns])
    return docs.select(F.coalesce("doc_id", F.lit(null_key)).alias("key"), F.xxhash64("text").alias("digest"), row.alias("row"))


def unboxed(df: DataFrame, names: list[str]) -> DataFrame:
    """The columns of ``row`` again."""
    return df.select(*[F.col("row.`" + c.replace("`", "``") + "`").alias(c) for c in names])


def sha256(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def ordered_key(doc_id: str = "doc_id"):
    """Null ids sort and compare as the smallest id."""
    return F.coalesce(F.col(doc_id), F.lit(-(2**63)))


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply), element by element."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def window_hashes(codes: np.ndarray, width: int, base: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """A 64-bit hash of each window of ``width`` codes, by doubling: two half windows make one."""
    seeded = mix64(codes.astype(np.uint64) + np.uint64(base & 0xFFFFFFFF))
    if width > len(seeded):
        return seeded[:0]
    out, at, done, span, power = None, 0, seeded, 1, base
    # done[i] covers codes[i : i + span]; out[i] covers codes[i : i + at]
    while True:
        if width & span:
            if out is None:
                out, at = done, span
            else:
                n = len(seeded) - at - span + 1
                out = out[:n] * np.uint64(pow(base, span, 2**64)) + done[at : at + n]
                at += span
        if at == width:
            return mix64(out)
        n = len(done) - span
        done = done[:n] * np.uint64(pow(power, span, 2**64)) + done[span : span + n]
        span *= 2


@functools.lru_cache(maxsize=8)
def tokenizer_path(name: str, path: str | None = None) -> str:
    """Where a public vocabulary lies; ``path`` overrides the installed one."""
    if path:
        return path
    import public_tokenizers

    return public_tokenizers.path(name)
