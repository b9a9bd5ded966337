"""Document fingerprints (operator 2): Order MinHash.

The k-mers of a text (k code points, each window) are numbered by occurrence, so that repeats are
elements of their own. A slot of the signature takes the ``ELL`` = 2 elements with the smallest hash
values, puts them back into the order of the text and hashes that tuple: two texts agree in a slot if they
share both k-mers in the same order, which makes the likeness follow edit distance rather than mere content.

The slots' minima come from the rounds of fast similarity sketching: in round i < SLOTS every element falls
into one random slot with a value in [i, i+1), in round SLOTS + j into slot j. The sketch is that of all
2 * SLOTS rounds; as earlier rounds beat later ones, those past the first in which every slot has its
elements cannot change it and are left out. So a text of any length, one k-mer included, fills each slot.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillframe.llm.common import mix64, prepare, sha256, window_hashes

K = 8
SLOTS = 64
ELL = 2
_SLOT_BITS, _ROUND_BITS = 6, 7
_VALUE_BITS = 64 - _SLOT_BITS - _ROUND_BITS
_SEEDS = mix64(np.arange(1, 2 * SLOTS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def elements(codes: np.ndarray, k: int = K) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each occurrence-numbered k-mer: its hash, its k-mer's hash, its position."""
    n = len(codes)
    if n == 0:
        return (np.zeros(0, np.uint64),) * 2 + (np.zeros(0, np.int64),)
    h = window_hashes(codes, min(k, n))
    bits = np.uint64(max(1, len(h).bit_length()))
    key = (h >> bits << bits) | np.arange(len(h), dtype=np.uint64)
    key.sort()
    at = (key & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    group = key >> bits
    first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    occurrence = np.arange(len(h)) - np.repeat(first, np.diff(np.append(first, len(h))))
    kmer = h[at]
    return mix64(kmer + occurrence.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03)), kmer, at


def _slots(e: np.ndarray, rounds: int, few: bool) -> tuple[np.ndarray, np.ndarray] | None:
    """Index of the first and second element of each slot after ``rounds`` rounds; None if they are not all filled."""
    keys, owner = [], []
    value = np.uint64(_SLOT_BITS + _ROUND_BITS)
    for i in range(rounds):
        r = mix64(e ^ _SEEDS[i])
        slot = r >> np.uint64(64 - _SLOT_BITS) if i < SLOTS else np.uint64(i - SLOTS)
        low = (r << np.uint64(_SLOT_BITS)) >> value
        who = None
        if few:  # far more elements than slots: only small values can win
            who = np.flatnonzero(low < np.uint64((1 << _VALUE_BITS) * 16 * SLOTS // len(e)))
            slot, low = slot[who], low[who]
        keys.append((slot << np.uint64(64 - _SLOT_BITS)) | np.uint64(i << _VALUE_BITS) | low)
        owner.append(np.arange(len(e)) if who is None else who)
    key, own = np.concatenate(keys), np.concatenate(owner)
    order = np.argsort(key)
    key, own = key[order], own[order]
    start = np.searchsorted(key, np.arange(SLOTS, dtype=np.uint64) << np.uint64(64 - _SLOT_BITS))
    end = np.append(start[1:], len(key))
    if (end <= start).any():
        return None
    one, two = own[start], start + 1
    if len(e) == 1:
        return one, one
    while True:
        if (two >= end).any():
            return None
        same = own[two] == one
        if not same.any():
            return one, own[two]
        two = two + same


def signature(text: str | None, k: int = K) -> np.ndarray:
    """SLOTS 16-bit values; all zero for an empty text."""
    codes = np.frombuffer((text or "").encode("utf-32-le"), "<u4")
    e, kmer, at = elements(codes, k)
    n = len(e)
    if n == 0:
        return np.zeros(SLOTS, np.uint16)
    found = _slots(e, 1, True) if n >= 2048 else _slots(e, min(SLOTS, -(-1024 // n)), False) if n >= 16 else None
    if found is None:
        found = _slots(e, 2 * SLOTS, False)
    one, two = found
    swap = at[one] > at[two]
    first, second = np.where(swap, kmer[two], kmer[one]), np.where(swap, kmer[one], kmer[two])
    return (mix64(first * np.uint64(0x9E3779B97F4A7C15) + mix64(second)) >> np.uint64(48)).astype(np.uint16)


def as_text(sig: np.ndarray) -> str:
    return sig.astype(">u2").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def edited(text: str, following: str) -> str:
    """The last quarter of the code points replaced by as many first ones of the next text."""
    cut = len(text) // 4
    return text[: len(text) - cut] + following[:cut]


FIELDS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def fingerprint_successions(batches, k: int = K):
    """Rows (part, own, doc_id, text) in order; each own row is paired with the row after it in its part."""
    part = held = None
    out: list[tuple] = []

    def emit(row, text, sig):
        doc_id, old, old_sig = row
        new = edited(old, text)
        new_sig = old_sig if new == old else signature(new, k)
        out.append((doc_id, len(old), sha256(new.encode()), as_text(old_sig), as_text(new_sig), likeness(old_sig, new_sig), likeness(old_sig, sig)))

    for batch in batches:
        for at, own, doc_id, text in zip(*(c.to_pylist() for c in batch.columns)):
            if at != part:
                part = at
                held = None
            text = text or ""
            if held is None and not own:
                continue
            sig = held[2] if held is not None and held[1] == text else signature(text, k)
            if held is not None:
                emit(held, text, sig)
            held = (doc_id, text, sig) if own else None
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=[f.split()[0] for f in FIELDS.split(", ")])
            out = []


def fingerprints_and_edits(spark: SparkSession, docs: DataFrame, k: int = K) -> DataFrame:
    """Operator 2: each document's Order MinHash, its edited text's, and their likeness; one row a row.

    "Next" is the next row by (doc_id, text), nulls first, and for the last row the first. Null text is empty; an
    empty text has the zero fingerprint. A single row is its own next. An empty table gives no rows.

    The rows are dealt out by ranges of doc_id, whose bounds come from a bounded sketch; the first row of a range
    goes to the range before it as well. Only bounds and the ranges' least ids come to the driver.
    """
    prepare(spark)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    low = -(2**63)
    keyed = docs.select("doc_id", "text", F.coalesce(F.col("doc_id"), F.lit(low)).alias("key"))
    asked = [i / n for i in range(1, n)]
    bounds = sorted(set(keyed.agg(F.percentile_approx("key", asked, min(10**5, 100 * n))).first()[0] or [])) if asked else []
    cuts = F.lit(bounds) if bounds else None
    part = F.size(F.filter(cuts, lambda b: b < F.col("key"))) if bounds else F.lit(0)
    least = sorted((r["part"], r["least"]) for r in keyed.select(part.alias("part"), "key").groupBy("part").agg(F.min("key").alias("least")).collect())
    if not least:
        return spark.createDataFrame([], FIELDS)
    # the rows with a part's least key are also the successors of the part before, the first part's of the last
    found = F.array_position(F.lit([key for _, key in least]), F.col("key")).cast("int")
    ahead = F.when(found > 0, F.element_at(F.lit([least[i - 1][0] for i in range(len(least))]), found))
    copies = F.filter(
        F.array(
            F.struct(part.alias("part"), F.lit(True).alias("own"), F.lit(False).alias("late")),
            F.struct(ahead.alias("part"), F.lit(False).alias("own"), F.lit(True).alias("late")),
        ),
        lambda c: c["part"].isNotNull(),
    )
    dealt = keyed.withColumn("copy", F.explode(copies)).select("copy.*", "key", "doc_id", "text")
    dealt = dealt.repartitionById(n, F.col("part")).sortWithinPartitions("part", "late", "key", "text")
    return dealt.select("part", "own", "doc_id", "text").mapInArrow(lambda b: fingerprint_successions(b, k), FIELDS)
