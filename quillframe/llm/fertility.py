"""Quality rules (operator 10): tokeniser fertility.

Two public vocabularies encode every whole text: a word-piece vocabulary with byte fallback, which gives the characters a token, the share
of tokens that are single fallback bytes and the entropy of the text's tokens relative to the most that so many tokens could have; and
a byte-level vocabulary, which gives its own characters a token. A text whose measures leave the band of its language, or else of its
main script, is rejected.

Bands are fitted on all documents that pass the base rules: a band is the median of its group and WIDTH robust standard deviations
(of the quartiles) to either side; a share of junk under a quarter does not move it. The spread of each measure shrinks with a
text's length, so groups are a language and a class of length (doublings of the token count); where a group has under MIN_GROUP texts
the language alone, the script and class, or the script alone serve, and where those are small as well the fixed bands BANDS, which only
take out what a vocabulary cannot read. Characters a token may leave on either side, the byte share above, the entropy below.

The base rules of the contract (word count, repeated five-word windows, symbols, repeated lines) are measured in the same pass over the
texts. The measures, some numbers a document, are written to a table; the quantiles are pre-aggregated over it.
"""

from __future__ import annotations

import base64
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from quillframe.llm.common import ASCII_SPACE, mix64, prepare, stored, tokenizer_path

SYMBOLS = "#*$%&|<>"
WINDOW = 5
#: A fitted band: robust standard deviations to either side of the median; texts that a group needs; least deviations taken.
WIDTH = 4.0
MIN_GROUP = 30
FLOORS = {"chars_per_token": 0.01, "byte_chars_per_token": 0.01, "byte_share": 0.003, "token_entropy": 0.005}
#: Bands beyond this number are joined by shuffle instead of broadcast.
BROADCAST_ROWS = 100_000
#: Fixed bands. Script or language: least and most code points a token, most byte share, least relative entropy
BANDS = {
    "latin": (1.2, 12.0, 0.30, 0.25),
    "greek": (0.8, 8.0, 0.50, 0.25),
    "cyrillic": (0.8, 8.0, 0.50, 0.25),
    "arabic": (0.5, 8.0, 0.60, 0.25),
    "hebrew": (0.5, 8.0, 0.60, 0.25),
    "devanagari": (0.3, 8.0, 0.80, 0.25),
    "cjk": (0.25, 4.0, 0.95, 0.25),
    "other": (0.2, 12.0, 1.0, 0.20),
}
# first code points of Unicode blocks and the script of the letters from there on
STARTS = [0x0, 0x370, 0x400, 0x530, 0x590, 0x600, 0x700, 0x750, 0x780, 0x8A0, 0x900, 0x980, 0x1E00, 0x1F00, 0x2000, 0x3040, 0xA000, 0xAC00, 0xD7B0, 0xF900, 0xFB00, 0x20000, 0x32000]
SCRIPTS = ["latin", "greek", "cyrillic", "other", "hebrew", "arabic", "other", "arabic", "other", "arabic", "devanagari", "other", "latin", "greek", "other", "cjk", "other", "cjk", "other", "cjk", "other", "cjk", "other"]
_LOADED: dict = {}


class Vocabularies:
    """The worker's copies of the two vocabularies."""

    def __init__(self, piece_path: str | None = None, byte_path: str | None = None):
        import public_tokenizers
        import sentencepiece
        import tiktoken

        self.pieces = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model", piece_path))
        self.is_byte = np.array([self.pieces.is_byte(i) for i in range(self.pieces.get_piece_size())])
        with open(tokenizer_path("byte_bpe_multi_50k.tiktoken", byte_path), "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.bytes = tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def vocabularies(piece_path: str | None = None, byte_path: str | None = None) -> Vocabularies:
    if (piece_path, byte_path) not in _LOADED:
        _LOADED[piece_path, byte_path] = Vocabularies(piece_path, byte_path)
    return _LOADED[piece_path, byte_path]


def numbered(text: str) -> np.ndarray:
    """The text's words, equal ones by equal numbers."""
    seen: dict[bytes, int] = {}
    return np.array([seen.setdefault(w, len(seen)) for w in text.encode().split()], dtype=np.int64)


def repeated_words(rows: np.ndarray, window: int = WINDOW) -> int:
    """Words that stand in a window of ``window`` words found twice or more in the text."""
    n = len(rows) - window + 1
    if n < 2:
        return 0
    many = int(rows.max()) + 1
    key = np.zeros(n, np.uint64)
    if many**window < 2**64:  # the window as one number in base ``many``
        for i in range(window):
            key *= np.uint64(many)
            key += rows[i : i + n].view(np.uint64)
    else:
        for i in range(window):
            key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + rows[i : i + n].view(np.uint64) + np.uint64(1))
    order = np.sort(key)
    again = order[1:][order[1:] == order[:-1]]
    if not len(again):
        return 0
    hit = np.isin(key, again)
    change = np.zeros(len(rows) + 1, np.int64)
    change[:n] += hit
    change[window:] -= hit
    return int((np.cumsum(change[:-1]) > 0).sum())


def main_script(text: str) -> str:
    if text.isascii():
        return "latin"
    codes = np.frombuffer(text.encode("utf-32-le"), "<u4")
    letters = codes[((codes | 32) >= 97) & ((codes | 32) <= 122) | (codes >= 0xC0)]
    if not len(letters):
        return "latin"
    block = np.searchsorted(STARTS, letters, side="right") - 1
    count: dict[str, int] = {}
    for script, n in zip(SCRIPTS, np.bincount(block, minlength=len(STARTS)).tolist()):
        count[script] = count.get(script, 0) + n
    return max(count, key=lambda s: (count[s], s))


def relative_entropy(tokens: np.ndarray, vocabulary: int) -> float:
    """Entropy of the tokens over the most that as many tokens can have; 1 for a single token."""
    n = len(tokens)
    if n < 2:
        return 1.0
    order = np.sort(tokens)
    p = np.diff(np.flatnonzero(np.concatenate(([True], order[1:] != order[:-1], [True])))) / n
    return float(-(p * np.log2(p)).sum() / math.log2(min(n, vocabulary)))


def measure(text: str | None, known: Vocabularies) -> dict:
    text = text or ""
    rows = numbered(text)
    tokens = np.array(known.pieces.encode(text, num_threads=1), dtype=np.int64)
    n_bytes = len(known.bytes.encode_to_numpy(text, disallowed_special=()))
    lines = [x for x in text.split("\n") if x.strip(ASCII_SPACE)]
    repeated = repeated_words(rows)
    return {
        "n_words": len(rows),
        "word_chars": len(text) - sum(map(text.count, ASCII_SPACE)),
        "n_symbols": sum(map(text.count, SYMBOLS)),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": repeated,
        "base_failed": len(rows) < 10 or 100 * repeated > 20 * len(rows),
        "n_tokens": len(tokens),
        "chars_per_token": len(text) / len(tokens) if len(tokens) else 0.0,
        "byte_chars_per_token": len(text) / n_bytes if n_bytes else 0.0,
        "byte_share": float(known.is_byte[tokens].mean()) if len(tokens) else 0.0,
        "token_entropy": relative_entropy(tokens, len(known.is_byte)) if len(tokens) else 0.0,
        "script": main_script(text),
    }


FIELDS = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
    "n_tokens long, chars_per_token double, byte_chars_per_token double, byte_share double, token_entropy double, script string, lang string"
)


def measures(spark: SparkSession, docs: DataFrame, piece_path: str | None = None, byte_path: str | None = None) -> DataFrame:
    """The base counts and fertility measures of every row."""
    prepare(spark)
    names = [f.split()[0] for f in FIELDS.split(", ")]
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")

    def run(batches):
        known = vocabularies(piece_path, byte_path)
        for batch in batches:
            out = []
            for doc_id, text, lang in zip(*(batch.column(i).to_pylist() for i in range(3))):
                m = measure(text, known) | {"doc_id": doc_id, "lang": lang}
                out.append([m[n] for n in names])
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) if n in ("script", "lang") else pa.array(c, pa.int64()) if n == "doc_id" else pa.array(c) for n, c in zip(names, zip(*out))], names=names)

    return docs.select("doc_id", "text", lang.alias("lang")).mapInArrow(run, FIELDS)


#: Groups from the narrowest on: name, and the columns that make them. ``size`` is the class of length.
GROUPS = (("language, length", ("lang", "size")), ("language", ("lang",)), ("script, length", ("script", "size")), ("script", ("script",)))


def sized(measured: DataFrame) -> DataFrame:
    return measured.withColumn("size", F.floor(F.log2(F.greatest("n_tokens", F.lit(1)))))


def fitted(measured: DataFrame, columns: tuple[str, ...], width: float = WIDTH, min_group: int = MIN_GROUP) -> DataFrame:
    """Of each group of ``columns`` with enough texts that pass the base rules: a struct ``band`` of (low, high) by measure."""
    good = sized(measured).filter(~F.col("base_failed")).dropna(subset=list(columns))
    quartiles = [F.percentile_approx(m, [0.25, 0.5, 0.75], 10_000).alias(m) for m in FLOORS]
    found = good.groupBy(*columns).agg(F.count("*").alias("texts"), *quartiles).filter(F.col("texts") >= min_group)
    spread = {m: F.greatest((F.col(m)[2] - F.col(m)[0]) / 1.349, F.lit(floor)) * width for m, floor in FLOORS.items()}
    return found.select(*columns, F.struct(*[F.struct((F.col(m)[1] - spread[m]).alias("low"), (F.col(m)[1] + spread[m]).alias("high")).alias(m) for m in FLOORS]).alias("band"))


def quality(spark: SparkSession, docs: DataFrame, bands: dict | None = None, piece_path: str | None = None, byte_path: str | None = None, width: float = WIDTH, min_group: int = MIN_GROUP) -> DataFrame:
    """Operator 10: a row a row with the base counts, the fertility measures, the group whose band was taken and the verdict.

    ``bands`` maps a language (where ``docs`` has a lang column) or a script to a fixed band in place of the fitted ones: (least code points
    a token, most, most byte share, least relative entropy). Null and empty texts have no words: base_failed, not kept. Repeated rows are
    measured each and count each in the fit; an empty table gives no rows; a null lang falls back on the script; other columns, whatever
    their names, are not read. A very long text is encoded whole.
    """
    measured = sized(stored(spark, measures(spark, docs, piece_path, byte_path), "fertility"))
    out = measured
    for i, (_, columns) in enumerate(GROUPS):
        table = stored(spark, fitted(measured, columns, width, min_group).withColumnRenamed("band", f"band{i}"), "bands")
        out = out.join(F.broadcast(table) if table.count() <= BROADCAST_ROWS else table, list(columns), "left")
    band = F.coalesce(*[F.col(f"band{i}") for i in range(len(GROUPS))])
    group = F.coalesce(*[F.when(F.col(f"band{i}").isNotNull(), F.lit(name)) for i, (name, _) in enumerate(GROUPS)], F.lit("fixed"))
    inside = F.col("chars_per_token").between(band["chars_per_token"]["low"], band["chars_per_token"]["high"])
    inside &= F.col("byte_chars_per_token").between(band["byte_chars_per_token"]["low"], band["byte_chars_per_token"]["high"])
    inside &= (F.col("byte_share") <= band["byte_share"]["high"]) & (F.col("token_entropy") >= band["token_entropy"]["low"])

    def within(fixed: tuple):
        low, high, share, entropy = fixed
        return F.col("chars_per_token").between(low, high) & (F.col("byte_share") <= share) & (F.col("token_entropy") >= entropy)

    verdict = F.when(band.isNotNull(), inside)
    for script, fixed in BANDS.items():
        verdict = verdict.when(F.col("script") == script, within(fixed))
    if bands:
        named = F.when(F.lit(False), F.lit(True))
        for column in ("lang", "script"):
            for name, fixed in bands.items():
                named = named.when(F.col(column) == name, within(fixed))
        own = F.col("lang").isin(list(bands)) | F.col("script").isin(list(bands))
        verdict, group = F.when(F.coalesce(own, F.lit(False)), named).otherwise(verdict), F.when(F.coalesce(own, F.lit(False)), F.lit("given")).otherwise(group)
    kept = F.when(F.col("base_failed"), F.lit(False)).otherwise(F.coalesce(verdict, F.lit(True)))
    base = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    return out.select(*base, kept.alias("kept"), "n_tokens", *FLOORS, "script", group.alias("band"))
