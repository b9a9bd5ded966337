"""SimHash near-duplicates (operator 4) with pigeonring filtering.

The 64 bits stand on a ring of SEGMENTS = 7 segments. If two fingerprints differ in at most 2 bits, then from
some segment on, every chain of l consecutive segments around the ring differs in at most l * 2 / 7 bits. So the
chain's first three segments are equal - they are the join key - its first six differ in at most one bit, and all
seven in at most two: the chain test prunes candidates, the last step of it is the full Hamming check.

Equal fingerprints are collapsed before anything is joined. A key that more than HOT distinct fingerprints share is
not expanded into pairs: two fingerprints within 2 bits have a common neighbour at one bit or less, so each hot
fingerprint goes to its 65 such neighbours, and each neighbour (which at most 65 fingerprints can have) links
those it got to the least of them. That finds the same components without a pair.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillframe.llm.common import boxed, checkpointed, discard, mix64, prepare, unboxed
from quillframe.llm.components import connected_components, cross_pairs

SEED = 42
WORDS = 3
DISTANCE = 2
SEGMENTS = 7
HOT = 64
#: Near duplicates by shingles: words a shingle; least similarity, as SimHash estimates it: the cosine of the angle between the texts'
#: shingle sets. At a cosine of 0.8 sets have a Jaccard similarity s of 0.64 to 0.67 (by how their sizes differ), and the MinHash bands
#: that find candidates miss (1 - s**ROWS)**BANDS of such pairs: 0.8 to 0.3 %.
SHINGLE_WORDS = 5
SIMILARITY = 0.8
BANDS = 16
ROWS = 3
#: Candidates are compared whole only if this share of their least hashes agrees: three and a half standard errors under 0.64.
LEAST_AGREED = 0.4


def hashes(text: str | None, words: int = WORDS) -> list[int]:
    found = (text or "").encode().lower().split()
    if not found:
        return []
    if len(found) <= words:
        return [xxhash.xxh64_intdigest(b" ".join(found), SEED)]
    whole = b" ".join(found)
    sizes = np.fromiter(map(len, found), np.int64, len(found))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[: len(found) - words + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return [digest(whole[a:b], SEED) for a, b in zip(starts, ends[words - 1 :].tolist())]


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """A bit is set if it is set in over half of the shingles' hashes; no words: zero. As a signed 64-bit integer."""
    found = hashes(text, words)
    if not found:
        return 0
    h = np.array(found, dtype="<u8")
    total = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 16):
        part = h[at : at + (1 << 16)]
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * total > len(h), bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprints(spark: SparkSession, docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, digest (of the text) and fp of every row."""
    prepare(spark)

    def run(batches):
        for batch in batches:
            fps = pa.array([fingerprint(t, words) for t in batch.column(2).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), fps], names=["doc_id", "digest", "fp"])

    return docs.select("doc_id", F.xxhash64("text").alias("digest"), "text").mapInArrow(run, "doc_id long, digest long, fp long")


def ring(segments: int = SEGMENTS, distance: int = DISTANCE) -> tuple[list[int], list[list[tuple[int, int]]]]:
    """Of each start: the mask of the segments that must be equal, and (mask, most bits) of the longer chains."""
    edge = [64 * i // segments for i in range(segments + 1)]
    mask = [sum(1 << b for b in range(edge[i], edge[i + 1])) for i in range(segments)]
    keys, chains = [], []
    for start in range(segments):
        total, key, tests = 0, 0, []
        for size in range(1, segments + 1):
            total |= mask[(start + size - 1) % segments]
            most = size * distance // segments
            if most == 0:
                key = total
            elif size == segments or (size + 1) * distance // segments > most:
                tests.append((_signed(total), most))
        keys.append(_signed(key))
        chains.append(tests)
    return keys, chains


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def links(nodes: DataFrame, hot: int = HOT) -> DataFrame:
    """(tab, a, b): links between distinct fingerprints (tab, fp) of one table that give the same components as all pairs within DISTANCE."""
    keys, chains = ring()
    keyed = nodes.select("tab", "fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(k)) for k in keys])).alias("start", "key"))
    at = ["tab", "start", "key"]
    sizes = keyed.groupBy(*at).agg(F.count("*").alias("n")).filter("n > 1")
    held = keyed.join(sizes, at)
    cold = held.filter(F.col("n") <= hot)
    one, two = cold.select(*at, F.col("fp").alias("a")), cold.select(*at, F.col("fp").alias("b"))
    differ = F.col("a").bitwiseXOR(F.col("b"))
    within = F.lit(False)
    for start, tests in enumerate(chains):
        chain = F.col("start") == start
        for mask, most in tests:
            chain = chain & (F.bit_count(differ.bitwiseAND(F.lit(mask))) <= most)
        within = within | chain
    pairs = one.join(two, at).filter((F.col("a") < F.col("b")) & within).select("tab", "a", "b")
    near = [F.col("fp")] + [F.col("fp").bitwiseXOR(F.lit(_signed(1 << i))) for i in range(64)]
    spread = held.filter(F.col("n") > hot).select("tab", "fp").distinct().select("tab", "fp", F.explode(F.array(*near)).alias("near"))
    stars = spread.groupBy("tab", "near").agg(F.collect_set("fp").alias("fps")).filter(F.size("fps") > 1)
    stars = stars.select("tab", F.array_min("fps").alias("a"), F.explode("fps").alias("b")).filter("a <> b")
    return pairs.unionByName(stars).distinct()


def near_groups(spark: SparkSession, found: DataFrame) -> DataFrame:
    """fp, component (the label fingerprint) of the distinct fingerprints in ``found`` (checkpointed)."""
    nodes = found.select("fp").distinct()
    labels = connected_components(spark, links(nodes.select(F.lit(0).alias("tab"), "fp")))
    return nodes.join(labels.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("label", "fp").alias("component"))


def near_duplicates(spark: SparkSession, docs: DataFrame, words: int = WORDS) -> DataFrame:
    """Operator 4: doc_id, fingerprint (16 hex digits), component_id (the least doc_id of the component).

    Null and empty texts have fingerprint zero and link as such. Null doc_ids take part but name no component; a
    component of nulls alone has a null id. Repeated rows get equal results. Very long texts are hashed whole, one at a time. An empty table gives no rows. Other
    columns are not read. Only counts come to the driver.
    """
    found = checkpointed(spark, fingerprints(spark, docs, words))
    groups = checkpointed(spark, near_groups(spark, found))
    least = found.groupBy("fp").agg(F.min("doc_id").alias("least")).join(groups, "fp")
    ids = least.groupBy("component").agg(F.min("least").alias("component_id"))
    named = groups.join(ids, "component").select("fp", "component_id")
    shown = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return found.join(named, "fp").select("doc_id", shown.alias("fingerprint"), "component_id")


def shingle_set(text: str | None, words: int = SHINGLE_WORDS) -> np.ndarray:
    """Sorted distinct hashes of the word shingles; fewer words: the whole sequence; none: the empty sequence."""
    return np.unique(np.array(hashes(text, words) or [0], dtype=np.uint64))


_FACTORS = mix64(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def least_hashes(shingles: np.ndarray) -> np.ndarray:
    """The least of the shingles in each of BANDS * ROWS orders."""
    least = np.full(BANDS * ROWS, 2**64 - 1, np.uint64)
    mixed = mix64(shingles)
    for at in range(0, len(mixed), 1 << 13):
        least = np.minimum(least, (mixed[at : at + (1 << 13), None] * _FACTORS[None, :]).min(axis=0))
    return least


def band_keys(least: np.ndarray) -> list[int]:
    """A key a band: a digest of its number and of the least hashes of its ROWS orders."""
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for row in least.reshape(BANDS, ROWS).T:
        key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + row)
    return key.view("<i8").tolist()


def sketches(spark: SparkSession, docs: DataFrame, words: int = SHINGLE_WORDS) -> DataFrame:
    """key, digest, keys (one a band) and mins (a byte of each least hash) of every row."""
    prepare(spark)

    def run(batches):
        for batch in batches:
            least = [least_hashes(shingle_set(t, words)) for t in batch.column(2).to_pylist()]
            arrays = [pa.array([band_keys(x) for x in least], pa.list_(pa.int64())), pa.array([(x >> np.uint64(56)).astype(np.uint8).tobytes() for x in map(mix64, least)], pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *arrays], names=["key", "digest", "keys", "mins"])

    return boxed(docs.select("doc_id", "text")).select("key", "digest", "row.text").mapInArrow(run, "key long, digest long, keys array<long>, mins binary")


def may_be_similar(pairs: DataFrame) -> DataFrame:
    """The pairs (a, b, ma, mb) whose least hashes agree in LEAST_AGREED of their orders or more."""

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            if n:
                one, two = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(n, -1) for i in (2, 3))
                yield batch.select([0, 1]).filter(pa.array((one == two).mean(axis=1) >= LEAST_AGREED))

    return pairs.select("a", "b", "ma", "mb").mapInArrow(run, "a long, b long")


def verified(docs: DataFrame, pairs: DataFrame, similarity: float, words: int) -> DataFrame:
    """The pairs (a, b) of text digests whose shingle sets have at least ``similarity`` (cosine)."""
    wanted = pairs.select(F.col("a").alias("digest")).unionByName(pairs.select(F.col("b").alias("digest"))).distinct()

    def run(batches):
        for batch in batches:
            sets = [shingle_set(t, words).view(np.int64) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["digest", "shingles"])

    texts = docs.select(F.xxhash64("text").alias("digest"), "text").join(wanted, "digest", "left_semi").dropDuplicates(["digest"])
    sets = texts.select("digest", "text").mapInArrow(run, "digest long, shingles array<long>")
    both = pairs.join(sets.select(F.col("digest").alias("a"), F.col("shingles").alias("sa")), "a").join(sets.select(F.col("digest").alias("b"), F.col("shingles").alias("sb")), "b")
    common = F.size(F.array_intersect("sa", "sb"))
    return both.filter(common >= similarity * F.sqrt(F.size("sa").cast("double") * F.size("sb")) - 1e-9).select("a", "b")


def similar_groups(spark: SparkSession, docs: DataFrame, nodes: DataFrame, similarity: float = SIMILARITY, words: int = SHINGLE_WORDS) -> DataFrame:
    """node, label: the components of digests of texts whose shingle sets have a cosine similarity of at least ``similarity``.

    nodes: digest, keys, mins of distinct texts. Every key is treated alike, however many texts share it: each of its texts is compared with
    one of them, then those with each other that the links found do not connect. So every pair of a key is either tested or connected.
    """
    keyed = nodes.select(F.col("digest").alias("id"), "mins", F.explode("keys").alias("key"))
    hubs = keyed.groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("hub")).filter("n > 1").select("key", "hub")
    held = checkpointed(spark, keyed.join(hubs, "key").select("key", "id", F.col("mins").alias("mark"), "hub"))
    mins = nodes.select(F.col("digest").alias("hub"), F.col("mins").alias("hub_mins"))
    spokes = held.filter("id <> hub").select("id", "mark", "hub").distinct().join(mins, "hub")
    spokes = checkpointed(spark, may_be_similar(spokes.select(F.col("hub").alias("a"), F.col("id").alias("b"), F.col("hub_mins").alias("ma"), F.col("mark").alias("mb"))))
    edges = checkpointed(spark, verified(docs, spokes, similarity, words))
    crowd = held.select("key", "id", "mark")
    rest = may_be_similar(cross_pairs(crowd, connected_components(spark, edges), marks=True))
    rest = checkpointed(spark, rest.distinct())
    more = checkpointed(spark, verified(docs, rest, similarity, words))
    discard(held, spokes, rest)
    return connected_components(spark, edges.unionByName(more))


def keep_one(spark: SparkSession, docs: DataFrame, similarity: float = SIMILARITY, words: int = SHINGLE_WORDS) -> DataFrame:
    """The columns of ``docs``, whatever their names; of each group of equal or similar texts the row with the least (doc_id, digest), nulls last.

    Rows equal in doc_id and text are one. Null texts are equal to one another, and so are empty ones and those without a word. Very long
    texts are hashed whole, one at a time. An empty table gives no rows.
    """
    found = checkpointed(spark, sketches(spark, docs, words))
    labels = similar_groups(spark, docs, found.select("digest", "keys", "mins").dropDuplicates(["digest"]), similarity, words)
    first = found.groupBy("digest").agg(F.min("key").alias("key"))
    named = first.join(labels.withColumnRenamed("node", "digest"), "digest", "left").withColumn("label", F.coalesce("label", "digest"))
    kept = checkpointed(spark, named.groupBy("label").agg(F.min(F.struct("key", "digest")).alias("k")).select("k.*"))
    discard(found)
    return unboxed(boxed(docs).join(kept, ["key", "digest"], "left_semi").dropDuplicates(["key", "digest"]), docs.columns)
