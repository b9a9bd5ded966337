"""Language identification (operator 8).

Features: character n-grams of 1 to 3 code points of the lower-cased text in which each run of
non-letters is one space, hashed into 2**BITS columns, as TF-IDF of unit length. Model: multinomial
logistic regression with a sparse weight vector per language, trained by follow-the-regularised-leader
(proximal, per-coordinate rates) with L1 and L2 penalties. Its scores are calibrated by one temperature,
fitted on labelled rows that training did not see.

Training takes at most ``per_language`` labelled rows a language and ``MAX_ROWS`` rows in all, chosen by a
hash of doc_id and text; rows whose crc32(doc_id) mod 3 is 1 are held out and never trained on or calibrated with. Only the
sample's counts come to the driver. Prediction is one pass over whole texts with no shuffle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from quillframe.llm.common import boxed, mix64, prepare, unboxed

BITS = 15
ORDERS = (1, 2, 3)
PER_LANGUAGE = 400
MAX_ROWS = 4000
#: Largest model that is broadcast: 2**15 columns of 1,000 languages.
MOST_BYTES = 1 << 28
_KIND: np.ndarray | None = None


def letter_table() -> np.ndarray:
    global _KIND
    if _KIND is None:
        _KIND = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _KIND


def letters_only(text: str) -> np.ndarray:
    """Code points of the lower-cased text, runs of non-letters as one space, a space at either end; empty if no letter."""
    codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), "<u4")
    letter = letter_table()[codes]
    if not letter.any():
        return codes[:0]
    keep = letter.copy()
    keep[0] = True
    keep[1:] |= letter[:-1]
    return np.where(letter, codes, np.uint32(32))[keep]


def columns_of(text: str | None, bits: int = BITS) -> np.ndarray:
    """The column of each n-gram occurrence."""
    codes = letters_only(text or "").astype(np.uint64)
    found = []
    key = np.zeros(len(codes), np.uint64)
    for n in range(1, max(ORDERS) + 1):
        m = len(codes) - n + 1
        if m <= 0:
            break
        key = mix64(key[:m] * np.uint64(0x9E3779B97F4A7C15) + codes[n - 1 : n - 1 + m] + np.uint64(n))
        if n in ORDERS:
            found.append((key >> np.uint64(64 - bits)).astype(np.int64))
    return np.concatenate(found) if found else np.zeros(0, np.int64)


def counts_of(text: str | None, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    count = np.bincount(columns_of(text, bits), minlength=1 << bits)
    at = np.flatnonzero(count)
    return at, count[at]


class Model:
    def __init__(self, labels: list[str], weights: np.ndarray, bias: np.ndarray, idf: np.ndarray, temperature: float):
        self.labels, self.weights, self.bias, self.idf, self.temperature = labels, weights, bias, idf, temperature

    def logits(self, at: np.ndarray, count: np.ndarray) -> np.ndarray:
        x = count * self.idf[at]
        return (x / np.sqrt((x * x).sum())) @ self.weights[at] + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.labels:
            return "und", 0.0
        at, count = counts_of(text)
        if not len(at):
            return "und", 0.0
        p = softmax(self.logits(at, count) / self.temperature)
        best = int(p.argmax())
        return self.labels[best], float(p[best])


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train(rows: list[tuple[str, np.ndarray, np.ndarray]], epochs: int = 4, alpha: float = 1.0, beta: float = 1.0, l1: float = 1e-3, l2: float = 1e-4, bits: int = BITS) -> Model:
    """Every fifth row calibrates, the others train. Rows in the given order; the order is part of the model."""
    labels = sorted({r[0] for r in rows})
    if not labels:
        return Model([], np.zeros((0, 0)), np.zeros(0), np.zeros(0), 1.0)
    k, size = len(labels), 1 << bits
    code = {x: i for i, x in enumerate(labels)}
    held = [r for i, r in enumerate(rows) if i % 5 == 4]
    fit = [r for i, r in enumerate(rows) if i % 5 != 4]
    df = np.zeros(size)
    for _, at, _ in fit:
        df[at] += 1
    idf = np.log((1 + len(fit)) / (1 + df)) + 1
    z, n = np.zeros((size + 1, k)), np.zeros((size + 1, k))

    def weights(at):
        zs = z[at]
        return np.where(np.abs(zs) <= l1, 0.0, -(zs - np.sign(zs) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2))

    for _ in range(epochs):
        for label, at, count in fit:
            x = count * idf[at]
            x = np.append(x / np.sqrt((x * x).sum()), 1.0)
            where = np.append(at, size)
            w = weights(where)
            p = softmax(x @ w)
            p[code[label]] -= 1
            g = x[:, None] * p
            sigma = (np.sqrt(n[where] + g * g) - np.sqrt(n[where])) / alpha
            z[where] += g - sigma * w
            n[where] += g * g
    w = weights(np.arange(size + 1))
    model = Model(labels, w[:-1].astype(np.float64), w[-1], idf, 1.0)
    if held:
        scores = np.stack([model.logits(at, c) for _, at, c in held])
        truth = np.array([code[r[0]] for r in held])
        grid = np.exp(np.linspace(np.log(0.02), np.log(20), 121))
        # a share of doubt keeps separable samples from driving the temperature to nothing
        target = np.full(scores.shape, 1 / ((len(held) + k) * k))
        target[np.arange(len(truth)), truth] += 1 - 1 / (len(held) + k)
        loss = [-(target * np.log(softmax(scores / t) + 1e-300)).sum(axis=1).mean() for t in grid]
        model.temperature = float(grid[int(np.argmin(loss))])
    return model


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def sample(docs: DataFrame, per_language: int = PER_LANGUAGE, max_rows: int = MAX_ROWS) -> list[tuple[str, np.ndarray, np.ndarray]]:
    """Labelled, not held-out rows as counts, at most ``max_rows``, whatever the number of rows and of languages.

    Of each language the first rows by a hash of doc_id and text digest, at most ``per_language`` and an equal share of ``max_rows``
    (at least one a language; of more than ``max_rows`` languages those with most rows, ties by name). Rows are thinned by the language's
    share before they are ranked, so no language meets in one task. The choice does not depend on partitions.
    """
    usable = docs.filter(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    sizes = usable.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(max_rows)
    n_languages = sizes.count()
    if not n_languages:
        return []
    each = max(1, min(per_language, max_rows // n_languages))
    place = F.shiftrightunsigned(F.xxhash64("doc_id", F.xxhash64("text"), F.lit("sample")), 1)
    # twice the share and some more: a binomial count that falls short of ``each`` is as good as impossible
    share = F.least(F.lit(1.0), (2.0 * each + 30) / F.col("n"))
    chosen = usable.select("lang", "doc_id", "text", place.alias("place")).join(F.broadcast(sizes), "lang").filter(F.col("place") / F.lit(float(2**63)) < share)
    first = Window.partitionBy("lang").orderBy("place", "doc_id", F.xxhash64("text"))
    picked = chosen.withColumn("rank", F.row_number().over(first)).filter(F.col("rank") <= each).select("lang", "doc_id", "text")

    def run(batches):
        for batch in batches:
            rows = [counts_of(t) for t in batch.column(2).to_pylist()]
            arrays = [pa.array([r[i].astype(np.int32) for r in rows], pa.list_(pa.int32())) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *arrays], names=["lang", "doc_id", "at", "count"])

    found = picked.mapInArrow(run, "lang string, doc_id long, at array<int>, count array<int>").toArrow()
    rows = [(lang, i, np.array(a, np.int64), np.array(c, np.int64)) for lang, i, a, c in zip(*(found.column(n).to_pylist() for n in ("lang", "doc_id", "at", "count")))]
    rows = [r for r in rows if len(r[2])]
    rows.sort(key=lambda r: (int(mix64(np.array([r[1]], np.int64).view(np.uint64))[0]), r[1], r[0], r[2].tobytes(), r[3].tobytes()))
    return [(lang, a, c) for lang, _, a, c in rows]


def fit(spark: SparkSession, docs: DataFrame, per_language: int = PER_LANGUAGE) -> Model:
    prepare(spark)
    return train(sample(docs, per_language))


def predictions(spark: SparkSession, docs: DataFrame, model: Model) -> DataFrame:
    """row (the columns of docs as a struct), lang_pred, score."""
    prepare(spark)
    if model.weights.nbytes > MOST_BYTES:
        raise ValueError(f"a model of {model.weights.nbytes} bytes is too large to broadcast; lower bits or the number of languages")
    shared = spark.sparkContext.broadcast(model)
    chosen = boxed(docs).select("row", "row.text")
    schema = chosen.select("row").schema.add("lang_pred", "string").add("score", "double")

    def run(batches):
        model = shared.value
        for batch in batches:
            got = [model.predict(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], names=schema.names)

    return chosen.mapInArrow(run, schema)


def identify(spark: SparkSession, docs: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """Operator 8: doc_id, held_out, lang_pred, score of every row.

    Null text, and text without a letter, is ``und`` with score 0. A null doc_id is not held out and never trains.
    Rows without lang are predicted like others; if no row is labelled, all are ``und``. Repeated rows get equal
    results. An empty table gives no rows. Other columns are not read. Very long texts are read whole, one at a time. Equal scores go to
    the least label. A model over MOST_BYTES is refused.
    """
    out = predictions(spark, docs.select("doc_id", "text"), fit(spark, docs, per_language))
    return out.select("row.doc_id", "lang_pred", "score").select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


#: A document goes whose calibrated score is under this.
LEAST_SCORE = 0.5


def keep_identified(spark: SparkSession, docs: DataFrame, least: float = LEAST_SCORE) -> DataFrame:
    """The columns, whatever their names, and rows of ``docs``, but for those predicted ``und`` or with a score under ``least``.

    Null and empty texts have no letter and go. Repeated rows are judged alike; an empty table gives no rows; very long texts are read whole.
    If no row can be learnt from (no lang at all, or only on held-out rows), languages are unknown, and all documents with a letter stay.
    """
    model = fit(spark, docs)
    if not model.labels:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    out = predictions(spark, docs, model)
    return unboxed(out.filter((F.col("lang_pred") != "und") & (F.col("score") >= least)), docs.columns)
