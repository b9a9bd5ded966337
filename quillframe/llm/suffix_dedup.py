"""Suffix-array dedup (operator 1): common-prefix interval trees over an enhanced suffix array, in buckets.

Texts are UTF-8 bytes. Two equal strings of ``length`` = 100 bytes have the same least 32-gram (by hash) at the same
offset. So each run of window starts that share their least 32-gram, an *anchor*, is a segment of at most 168 bytes, and
all occurrences of a window lie in segments of one anchor hash: the suffix array falls into buckets by anchor.

1. Anchor hashes are counted (pre-aggregated by batch); segments whose anchor occurs once are dropped.
2. Equal segments of a bucket are one class. Its first occurrence stands for it; the others are repeats as a whole.
3. Classes of a bucket with several classes get a suffix array of their window starts, the common-prefix lengths of
   neighbours, and the bytes to the left. A scan with a stack gives the intervals of the tree from depth 100 on, and an
   interval whose occurrences are preceded by different bytes (or touch the bucket's edge) is a maximal repeat group
   with all its occurrences: class members stand for class members.
4. All but the first occurrence of a group, for the group's whole length, is removed.

A window that occurs earlier is in an interval; if that is not left-diverse, the interval one byte to the left holds the
same occurrences and is in the same bucket, up to the edge, which counts as diverse. So step 4 removes exactly the bytes
covered by a 100-byte string that starts earlier.

A bucket of over HOT classes (a line in very many texts, with different neighbours) is not sorted in one task. Its
windows are dealt out by their own digests and pre-aggregated to the first occurrence, which is the tree cut at depth 100
and removes the same bytes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillframe.llm.common import boxed, mix64, prepare, sha256, stored, unboxed, window_hashes

LENGTH = 100
GRAM = 32
HOT = 4096
CHUNK = 1 << 19
SUFFIXES = 400_000
_BASE = 0xA24BAED4963EE407
_INVERSE = pow(_BASE, -1, 2**64)
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, CHUNK + 4096)
        _POWERS[:] = [np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size, b, np.uint64)]), dtype=np.uint64) for b in (_BASE, _INVERSE)]
    return _POWERS[0], _POWERS[1]


def sliding_min(key: np.ndarray, width: int) -> np.ndarray:
    out, span = key, 1
    while span * 2 <= width:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    return np.minimum(out[: len(out) - (width - span)], out[width - span :]) if span < width else out


def anchors(data: bytes, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Of each segment: anchor hash, class digest, first window start, number of window starts, anchor's offset."""
    parts = []
    for base in range(0, max(0, len(data) - length + 1), CHUNK):
        codes = np.frombuffer(data[base : base + CHUNK + length - 1], np.uint8)
        h = window_hashes(codes, gram)
        least = sliding_min((h >> np.uint64(20) << np.uint64(20)) | np.arange(len(h), dtype=np.uint64), length - gram + 1)
        at = (least & np.uint64((1 << 20) - 1)).astype(np.int64)
        start = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        n = np.diff(np.append(start, len(at)))
        power, inverse = _powers(len(codes) + 1)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix64(codes.astype(np.uint64) + np.uint64(977)) * power[: len(codes)], dtype=np.uint64)])
        text = (total[start + n + length - 1] - total[start]) * inverse[start]
        offset = at[start] - start
        digest = mix64(text ^ mix64((n << 8 | offset).astype(np.uint64)))
        parts.append((h[at[start]].view(np.int64), digest.view(np.int64), start + base, n, offset))
    if not parts:
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    return tuple(np.concatenate(c) for c in zip(*parts))


def _documents(docs: DataFrame) -> DataFrame:
    """doc, digest (the key of a row; nulls come first), text."""
    return docs.select(F.coalesce("doc_id", F.lit(-(2**63))).alias("doc"), F.xxhash64("text").alias("digest"), F.col("text").alias("text"))


def anchor_counts(docs: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            found = [anchors((t or "").encode())[0] for t in batch.column(2).to_pylist()]
            h, n = np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, np.int64),) * 2
            yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(n.astype(np.int64))], names=["h", "n"])

    return _documents(docs).mapInArrow(run, "h long, n long")


def segments(docs: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            doc, digest = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            found = [anchors((t or "").encode()) for t in batch.column(2).to_pylist()]
            if not found:
                continue
            sizes = [len(f[0]) for f in found]
            h, s, lo, n, o = (np.concatenate(c) for c in zip(*found))
            arrays = [h, s, np.repeat(doc, sizes), np.repeat(digest, sizes), lo, (n << 8 | o).astype(np.int32)]
            names = ["h", "s", "doc", "digest", "lo", "shape"]
            whole = pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], names=names)
            for i in range(0, whole.num_rows, 20_000):
                yield whole.slice(i, 20_000)

    return _documents(docs).mapInArrow(run, "h long, s long, doc long, digest long, lo long, shape int")


def interval_groups(lcp: list[int], left: list[int], least: int):
    """Stack scan: (common length, first rank, last rank) of each left-diverse interval of at least ``least``.

    lcp[i] is that of ranks i - 1 and i (lcp[0] is not looked at). left holds what precedes each suffix; values below -1 differ from all others.
    """
    stack: list[list[int]] = []
    m = len(left)
    for i in range(1, m + 1):
        now = lcp[i] if i < m else 0
        before, first = left[i - 1], i - 1
        while stack and stack[-1][0] > now:
            depth, first, seen = stack.pop()
            before = seen if seen == before else -1
            if before == -1:
                yield depth, first, i - 1
        if now >= least:
            if stack and stack[-1][0] == now:
                if stack[-1][2] != before:
                    stack[-1][2] = -1
            else:
                stack.append([now, first, before])


class Bucket:
    """The enhanced suffix array of the window starts of many segments (rows in order of occurrence)."""

    def __init__(self, texts: list[bytes], n: np.ndarray, length: int = LENGTH):
        """texts: each segment's bytes, with one byte before its first window start. n: its window starts."""
        self.length = length
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        base = np.cumsum(size) - size + 1
        buffer = np.frombuffer(b"".join(texts), np.uint8)
        self.segment = np.repeat(np.arange(len(texts)), n)
        self.place = np.arange(len(self.segment)) - np.repeat(np.cumsum(n) - n, n)
        start = base[self.segment] + self.place
        end = (base + size - 1)[self.segment]
        key = window_hashes(buffer, length)[start]
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        several = np.zeros(len(key), bool)
        several[order[1:][same]] = several[order[:-1][same]] = True
        self.picked = np.flatnonzero(several)
        a, z = start[self.picked], end[self.picked]
        most = int((z - a).max(initial=length))
        width = -(-most // 8) * 8
        bytes_ = np.concatenate([buffer, np.zeros(width, np.uint8)])[a[:, None] + np.arange(width)]
        bytes_[np.arange(width) >= (z - a)[:, None]] = 0
        tail = bytes_[:, length // 8 * 8 :].copy().view(">u8").astype(np.uint64)
        rank = np.lexsort([*(tail[:, i] for i in range(tail.shape[1] - 1, -1, -1)), key[self.picked]])
        self.rank = self.picked[rank]
        bytes_, room = bytes_[rank], (z - a)[rank]
        differ = bytes_[1:] != bytes_[:-1]
        common = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
        self.lcp = np.concatenate([[0], np.minimum(common, np.minimum(room[1:], room[:-1]))]) if len(rank) else np.zeros(0, np.int64)
        before = buffer[np.maximum(start[self.rank] - 1, 0)].astype(np.int64)
        self.left = np.where(self.place[self.rank] == 0, -2 - np.arange(len(self.rank)), before)

    def groups(self):
        """(length, occurrences as indices of window starts, in order of occurrence) of each maximal repeat group."""
        for depth, first, last in interval_groups(self.lcp.tolist(), self.left.tolist(), self.length):
            yield depth, np.sort(self.rank[first : last + 1])

    def repeats(self) -> np.ndarray:
        """Of each window start the length of the longest group in which it is not the first occurrence, else 0."""
        best = np.zeros(len(self.segment), np.int64)
        rank, at, depths = self.rank, [], []
        for depth, first, last in interval_groups(self.lcp.tolist(), self.left.tolist(), self.length):
            members = rank[first : last + 1]
            if last - first < 8:
                members = sorted(members.tolist())[1:]
                at += members
                depths += [depth] * len(members)
            else:
                members = np.delete(members, members.argmin())
                best[members] = np.maximum(best[members], depth)
        if at:
            np.maximum.at(best, np.array(at), np.array(depths))
        return best


def merged(owner: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unions of spans, by owner; touching spans are one."""
    order = np.lexsort([start, owner])
    owner, start, end = owner[order], start[order], end[order]
    if not len(owner):
        return owner, start, end
    shift = owner * (int(end.max()) + 2)
    reach = np.maximum.accumulate(end + shift)
    new = np.concatenate([[True], start[1:] + shift[1:] > reach[:-1]])
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(owner)) - 1
    return owner[head], start[head], reach[tail] - shift[tail]


def _grouped(batches, column: int, suffixes: int):
    """Runs of whole key groups from batches sorted by the key, of about ``suffixes`` window starts."""
    held, count = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        key, n = batch.column(column).to_numpy(), batch.column(5).to_numpy() >> 8
        if count + int(n.sum()) > suffixes and held:
            last = held[-1].column(column)[-1].as_py()
            change = np.flatnonzero(key != last)
            if len(change):
                if change[0]:
                    held.append(batch.slice(0, int(change[0])))
                yield pa.Table.from_batches(held)
                held, count, batch = [], 0, batch.slice(int(change[0]))
                n = n[int(change[0]) :]
        held.append(batch)
        count += int(n.sum())
    if held:
        yield pa.Table.from_batches(held)


def _columns(table):
    return [table.column(i).to_numpy() for i in range(6)] + [table.column(6).to_pylist()]


def bucket_spans(batches):
    """(doc, digest, start, end) of what the groups of each bucket remove."""
    for table in _grouped(batches, 0, SUFFIXES):
        _, _, doc, digest, lo, shape, texts = _columns(table)
        bucket = Bucket(texts, shape >> 8)
        best = bucket.repeats()
        hit = np.flatnonzero(best)
        owner, start, end = merged(bucket.segment[hit], bucket.place[hit], bucket.place[hit] + best[hit])
        arrays = [doc[owner], digest[owner], lo[owner] + start, lo[owner] + end]
        yield pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], names=["doc", "digest", "start", "end"])


def bucket_groups(batches):
    """(h, s, group, length, place) of each occurrence of each maximal repeat group, by class."""
    for table in _grouped(batches, 0, SUFFIXES):
        h, s, _, _, _, shape, texts = _columns(table)
        bucket = Bucket(texts, shape >> 8)
        rows: list[np.ndarray] = []
        for depth, members in bucket.groups():
            one = bucket.segment[members[0]]
            at = int(bucket.place[members[0]]) + 1
            group = np.full(len(members), int.from_bytes(bytes.fromhex(sha256(texts[one][at : at + depth]))[:8], "little", signed=True))
            rows.append(np.stack([h[bucket.segment[members]], s[bucket.segment[members]], group, np.full(len(members), depth), bucket.place[members]]))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in np.concatenate(rows, axis=1)], names=["h", "s", "group", "length", "place"])


def window_rows(batches):
    """Hot buckets: (w1, w2, doc, digest, pos, lost) by window; within a batch only the first of equal windows is not lost."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, _, doc, digest, lo, shape, texts = _columns(batch)
        n = shape >> 8
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        base = np.cumsum(size) - size + 1
        buffer = np.frombuffer(b"".join(texts), np.uint8)
        owner = np.repeat(np.arange(len(texts)), n)
        place = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
        start = base[owner] + place
        w1, w2 = (window_hashes(buffer, LENGTH, b)[start].view(np.int64) for b in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93))
        pos = lo[owner] + place
        order = np.lexsort([pos, digest[owner], doc[owner], w2, w1])
        lost = np.zeros(len(owner), bool)
        lost[1:] = (w1[order][1:] == w1[order][:-1]) & (w2[order][1:] == w2[order][:-1])
        owner, pos, w1, w2 = owner[order], pos[order], w1[order], w2[order]
        whole = pa.RecordBatch.from_arrays([pa.array(a) for a in (w1, w2, doc[owner], digest[owner], pos, lost)], names=["w1", "w2", "doc", "digest", "pos", "lost"])
        for i in range(0, whole.num_rows, 20_000):
            yield whole.slice(i, 20_000)


PLACE = ("doc", "digest", "lo")


def repeated_segments(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The segments whose anchor occurs twice or more: h, s, doc, digest, lo, shape, first (the class's first place), classes (in the bucket)."""
    counts = anchor_counts(docs).groupBy("h").agg(F.sum("n").alias("n")).filter("n > 1").select("h")
    held = stored(spark, segments(docs).join(stored(spark, counts), "h"))
    classes = held.groupBy("h", "s").agg(F.min(F.struct(*PLACE)).alias("first"))
    sizes = classes.groupBy("h").agg(F.count("*").alias("classes"))
    return held.join(classes.join(sizes, "h"), ["h", "s"])


def class_texts(docs: DataFrame, found: DataFrame) -> DataFrame:
    """h, s, doc, digest, lo, shape, text (with the byte before it, or a zero byte), classes of classes in buckets with several."""
    firsts = found.filter((F.col("classes") > 1) & (F.struct(*PLACE) == F.col("first"))).select("h", "s", *PLACE, "shape", "classes")
    wanted = firsts.groupBy("doc", "digest").agg(F.collect_set(F.struct("h", "s", "lo", "shape", "classes")).alias("wanted"))
    joined = _documents(docs).join(wanted.hint("shuffle_hash"), ["doc", "digest"]).withColumn("data", F.col("text").cast("binary"))
    one = joined.select("doc", "digest", "data", F.explode("wanted").alias("w")).select("doc", "digest", "data", "w.*")
    size = F.shiftright("shape", 8) + (LENGTH - 1)
    inner = F.substring("data", F.col("lo").cast("int"), size + 1)
    text = F.when(F.col("lo") > 0, inner).otherwise(F.concat(F.lit(b"\0"), F.substring("data", F.lit(1), size)))
    return one.select("h", "s", "doc", "digest", "lo", "shape", text.alias("text"), "classes")


def removed_spans(spark: SparkSession, docs: DataFrame, hot: int = HOT) -> DataFrame:
    """doc, digest, spans (start, end) of the bytes to remove; only documents that lose any."""
    prepare(spark)
    found = stored(spark, repeated_segments(spark, docs))
    end = F.col("lo") + F.shiftright("shape", 8) + (LENGTH - 1)
    copies = found.filter(F.struct(*PLACE) != F.col("first")).select("doc", "digest", F.col("lo").alias("start"), end.alias("end"))
    texts = stored(spark, class_texts(docs, found))
    usual = texts.filter(F.col("classes") <= hot).drop("classes").repartition("h").sortWithinPartitions("h", *PLACE)
    spans = copies.unionByName(usual.mapInArrow(bucket_spans, "doc long, digest long, start long, end long"))
    crowded = texts.filter(F.col("classes") > hot).drop("classes")
    if crowded.limit(1).count():
        windows = stored(spark, crowded.mapInArrow(window_rows, "w1 long, w2 long, doc long, digest long, pos long, lost boolean"))
        place = F.struct("doc", "digest", "pos")
        alive = windows.filter(~F.col("lost"))
        first = alive.groupBy("w1", "w2").agg(F.min(place).alias("first"), F.count("*").alias("n")).filter("n > 1")
        lost = windows.filter("lost").select(*place_names()).unionByName(alive.join(first, ["w1", "w2"]).filter(place != F.col("first")).select(*place_names()))
        spans = spans.unionByName(lost.select("doc", "digest", F.col("pos").alias("start"), (F.col("pos") + LENGTH).alias("end")))
    return spans.groupBy("doc", "digest").agg(F.collect_set(F.struct("start", "end")).alias("spans"))


def place_names() -> tuple[str, ...]:
    return "doc", "digest", "pos"


def cut(data: bytes, spans: list[dict] | None) -> tuple[bytes, int, int]:
    """What is left of data, the bytes taken out and the number of maximal runs taken out."""
    if not spans:
        return data, 0, 0
    start = np.array([s["start"] for s in spans], np.int64)
    end = np.array([s["end"] for s in spans], np.int64)
    _, start, end = merged(np.zeros(len(start), np.int64), start, end)
    kept, at = [], 0
    for a, z in zip(start.tolist(), end.tolist()):
        kept.append(data[at:a])
        at = z
    kept.append(data[at:])
    return b"".join(kept), int((end - start).sum()), len(start)


def with_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """row (the columns of docs as a struct), spans."""
    named = spans.select(F.col("doc").alias("key"), "digest", "spans")
    return boxed(docs, -(2**63)).join(named.hint("shuffle_hash"), ["key", "digest"], "left").select("row", "spans")


def dedup_bytes(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Operator 1: doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (bytes).

    Null text is empty. Null doc_ids come first in the order; rows of one doc_id are ordered by a digest of their text,
    and rows equal in both are one document, so they get equal results. An empty table gives no rows. Other columns are not read.
    """
    spans = removed_spans(spark, docs)

    def run(batches):
        for batch in batches:
            out = []
            for doc_id, text, found in zip(*(batch.column(i).to_pylist() for i in range(3))):
                data = (text or "").encode()
                kept, n, runs = cut(data, found)
                out.append((doc_id, len(data), n, runs, sha256(kept), kept))
            types = [pa.int64()] * 4 + [pa.string(), pa.binary()]
            columns = zip(*out) if out else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    return with_spans(docs.select("doc_id", "text"), spans).select("row.doc_id", "row.text", "spans").mapInArrow(run, schema)


def clean(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The columns of ``docs``, whatever their names, with the repeated bytes taken out of text; bytes of a letter cut in two go as well.

    A document of which nothing but white space is left goes. Null texts stay; rows equal in doc_id and text are one document and change
    alike; an empty table gives no rows. Very long texts are hashed in chunks, one text in memory at a time.
    """
    spans = removed_spans(spark, docs)
    schema = with_spans(docs, spans).select("row").schema

    def run(batches):
        for batch in batches:
            row, found = batch.column(0), batch.column(1).to_pylist()
            names = [f.name for f in row.type]
            texts = row.field(names.index("text")).to_pylist()
            texts = [cut(t.encode(), f)[0].decode(errors="ignore") if f else t for t, f in zip(texts, found)]
            gone = pa.array([bool(f) and not (t or "").strip() for t, f in zip(texts, found)], pa.bool_())
            fields = [pa.array(texts, pa.string()) if n == "text" else row.field(i) for i, n in enumerate(names)]
            yield pa.RecordBatch.from_arrays([pa.StructArray.from_arrays(fields, fields=list(row.type))], names=["row"]).filter(pa.compute.invert(gone))

    return unboxed(with_spans(docs, spans).mapInArrow(run, schema), docs.columns)


def maximal_repeats(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """group, length, doc_id, start: the maximal repeat groups of at least LENGTH bytes with all their occurrences.

    A group is maximal within its anchor's context of 168 bytes; a longer repeat is a chain of overlapping groups. Buckets are
    sorted whole, so this view is for corpora without buckets beyond HOT classes.
    """
    prepare(spark)
    found = stored(spark, repeated_segments(spark, docs))
    texts = class_texts(docs, found).drop("classes").repartition("h").sortWithinPartitions("h", *PLACE)
    groups = texts.mapInArrow(bucket_groups, "h long, s long, group long, length long, place long")
    alone = found.filter("classes = 1").select("h", "s", F.col("s").alias("group"), (F.shiftright("shape", 8) + (LENGTH - 1)).cast("long").alias("length"), F.lit(0).cast("long").alias("place")).distinct()
    members = found.select("h", "s", *PLACE)
    out = groups.unionByName(alone).join(members, ["h", "s"])
    return out.select("group", "length", F.when(F.col("doc") != -(2**63), F.col("doc")).alias("doc_id"), (F.col("lo") + F.col("place")).alias("start"))
