"""BPE encoding and decoding (operator 3): speculate and verify.

Speculate: a greedy longest match over the vocabulary proposes the tokens of each distinct word.
Verify: a sequence of tokens is what the merges give exactly if each pair of neighbours is compatible,
that is, if merging the two tokens' joined letters gives these two tokens back. All neighbours of a batch
of words are looked up at once in a sorted table of pairs; a pair not seen before is decided once by exact
merging and remembered. Only words with an incompatible pair are merged exactly, letter by letter.

Normalisation (canonical composition, lower case) and the split into words follow the vocabulary file's own
description. Texts with letters outside the blocks on which Python's character tables agree with the
tokenizers library's (tests/llm/test_tokens.py) are normalised and split by that library.
"""

from __future__ import annotations

import json
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from quillframe.llm.byte_tokens import byte_letters
from quillframe.llm.common import prepare, sha256, tokenizer_path

#: Words kept in a worker's memory; the table is emptied when it is full.
CACHE_WORDS = 400_000
# letters for which both character tables agree, Latin to Cyrillic without Greek, kana, han, hangul
_UNSURE = regex.compile(r"[^\u0000-ɏЀ-ԯ -⁯₠-₿℀-⅏　-ヿ一-鿿가-힣]")
_LOADED: dict = {}


class WordBpe:
    def __init__(self, path: str | None = None):
        from tokenizers import Tokenizer

        at = tokenizer_path("word_bpe_49k.json", path)
        spec = json.load(open(at, encoding="utf-8"))
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.end: str = model["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token = {i: t for t, i in self.vocab.items()} | {i: t for t, i in self.special.items()}
        self.library = Tokenizer.from_file(at)
        # the split is the vocabulary file's; Removed and inverted: its matches are the words
        self.split = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")
        self.letter = {b: c for c, b in byte_letters().items()}
        self.table = str.maketrans({b: c for b, c in self.letter.items()})
        self.longest = max(map(len, self.vocab))
        self.words: dict[str, tuple[int, str, str]] = {}
        self.base = max(self.token) + 2
        self.never = len(model["merges"])
        self.ranks = {self.vocab[a] * self.base + self.vocab[b]: i for i, (a, b) in enumerate(model["merges"])}
        self.made = [self.vocab[a + b] for a, b in model["merges"]]
        self.known, self.good = np.zeros(0, np.int64), np.zeros(0, bool)
        self.n_words = self.n_exact = 0

    # exact merging
    def merge(self, ids: list[int]) -> list[int]:
        """Merges the pair of least rank, leftmost first, until no pair has a rank."""
        if len(ids) > 512:
            return self.merge_long(ids)
        ranks, made, base, never = self.ranks, self.made, self.base, self.never
        found = [ranks.get(a * base + b, never) for a, b in zip(ids, ids[1:])]
        while found and (least := min(found)) != never:
            i = found.index(least)
            ids[i : i + 2] = [one] = [made[least]]
            del found[i]
            if i < len(found):
                found[i] = ranks.get(one * base + ids[i + 1], never)
            if i:
                found[i - 1] = ranks.get(ids[i - 1] * base + one, never)
        return ids

    def merge_long(self, ids: list[int]) -> list[int]:
        """The same merges in the order of (rank, place), from a heap over a linked list."""
        import heapq

        n, ranks, base = len(ids), self.ranks, self.base
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := ranks.get(ids[i] * base + ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, one, two = heapq.heappop(heap)
            j = after[i] if ids[i] >= 0 else n
            if j >= n or ids[i] != one or ids[j] != two:
                continue
            ids[i], ids[j] = self.made[rank], -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < n and (r := ranks.get(ids[a] * base + ids[b])) is not None:
                    heapq.heappush(heap, (r, a, ids[a], ids[b]))
        return [i for i in ids if i >= 0]

    def symbols(self, letters: str, final: bool = True) -> list[int]:
        """The ids of the letters; the last letter of a word has a token of its own."""
        ids = [self.vocab[c] for c in letters]
        if final:
            ids[-1] = self.vocab[letters[-1] + self.end]
        return ids

    # speculation and verification
    def guess(self, letters: str) -> list[int]:
        vocab, n, at, out = self.vocab, len(letters), 0, []
        while at < n:
            rest = n - at
            if rest < self.longest and (t := vocab.get(letters[at:] + self.end)) is not None:
                out.append(t)
                break
            for size in range(min(rest - 1, self.longest), 0, -1):
                if (t := vocab.get(letters[at : at + size])) is not None:
                    out.append(t)
                    at += size
                    break
        return out

    def spelled(self, token: int) -> list[int]:
        text = self.token[token]
        final = text.endswith(self.end) and len(text) > len(self.end)
        return self.symbols(text[: -len(self.end)] if final else text, final)

    def compatible(self, pair: int) -> bool:
        a, b = divmod(pair, self.base)
        if b == self.base - 1:  # a token alone
            return self.merge(self.spelled(a)) == [a]
        return self.merge(self.spelled(a) + self.spelled(b)) == [a, b]

    def verify(self, pairs: np.ndarray) -> np.ndarray:
        """Whether each pair of neighbours is compatible, for all pairs at once."""
        distinct, back = np.unique(pairs, return_inverse=True)
        at = np.searchsorted(self.known, distinct)
        seen = (at < len(self.known)) & (self.known[np.minimum(at, len(self.known) - 1)] == distinct) if len(self.known) else np.zeros(len(distinct), bool)
        if not seen.all():
            new = distinct[~seen]
            verdict = np.fromiter((self.compatible(int(p)) for p in new), bool, len(new))
            known = np.concatenate([self.known, new])
            order = np.argsort(known)
            self.known, self.good = known[order], np.concatenate([self.good, verdict])[order]
            at = np.searchsorted(self.known, distinct)
        return self.good[at][back]

    def learn(self, words: list[str]) -> None:
        """Encodes distinct new words and remembers count, ids and tokens of each."""
        letters = [w.encode().decode("latin-1").translate(self.table) for w in words]
        guesses = [self.guess(x) for x in letters]
        sizes = np.array([len(g) for g in guesses])
        flat = np.fromiter((t for g in guesses for t in g), np.int64, int(sizes.sum()))
        alone = np.full(len(flat), self.base - 1, dtype=np.int64)
        owner = np.repeat(np.arange(len(words)), sizes)
        inner = owner[1:] == owner[:-1]
        pairs = np.concatenate([flat[:-1][inner] * self.base + flat[1:][inner], flat * self.base + alone])
        holder = np.concatenate([owner[:-1][inner], owner])
        wrong = set(np.unique(holder[~self.verify(pairs)]).tolist())
        self.n_words += len(words)
        self.n_exact += len(wrong)
        if len(self.known) > 1_000_000:
            self.known, self.good = self.known[:0], self.good[:0]
        for i, (word, ids) in enumerate(zip(words, guesses)):
            if i in wrong:
                ids = self.merge(self.symbols(letters[i]))
            self.words[word] = (len(ids), " ".join(map(str, ids)), " ".join([self.token[t] for t in ids]))

    def pieces(self, text: str) -> list[str]:
        """The words of a text without special tokens."""
        if text.isascii():
            return self.split.findall(text.lower())
        if _UNSURE.search(text):
            normal = self.library.normalizer.normalize_str(text)
            return [normal[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(normal)]
        return self.split.findall(unicodedata.normalize("NFC", text).lower())

    def parts(self, text: str) -> list[str]:
        """The words and special tokens of a text, in order."""
        if "<|" not in text:
            return self.pieces(text)
        return [w for part in self.cut.split(text) for w in ([part] if part in self.special else self.pieces(part))]

    def encode_all(self, texts: list[str]) -> list[list[tuple[int, str, str]]]:
        """Of each text an entry a word: number of tokens, ids and tokens joined by spaces."""
        split = [self.parts(t) for t in texts]
        if len(self.words) > CACHE_WORDS:
            self.words.clear()
        fresh = {w for words in split for w in words if w not in self.words}
        for w in fresh & self.special.keys():  # no split gives a word that reads like a special token
            self.words[w] = (1, str(self.special[w]), w)
        fresh -= self.special.keys()
        if fresh:
            self.learn(list(fresh))
        return [[self.words[w] for w in words] for words in split]


def word_bpe(path: str | None = None) -> WordBpe:
    if path not in _LOADED:
        _LOADED[path] = WordBpe(path)
    return _LOADED[path]


def encode(text: str | None, path: str | None = None) -> list[int]:
    return [int(t) for _, ids, _ in word_bpe(path).encode_all([text or ""])[0] for t in ids.split()]


def decode(ids: list[int], path: str | None = None) -> str:
    """The vocabulary names no decoder: tokens are joined by spaces, special ones kept."""
    return " ".join([word_bpe(path).token[i] for i in ids if i in word_bpe(path).token])


FIELDS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def encode_documents(spark: SparkSession, docs: DataFrame, path: str | None = None) -> DataFrame:
    """Operator 3: a row a row: doc_id, n_tokens, digests of the ids and of the decoded text.

    Null and empty texts have no tokens; a null doc_id stays null; repeated rows are encoded each; an empty table gives no rows. A very long
    text is encoded whole, one at a time. One pass, no shuffle; a worker keeps at most CACHE_WORDS words and
    those of one batch of texts. Other columns are not read.
    """
    prepare(spark)

    def run(batches):
        bpe = word_bpe(path)
        for batch in batches:
            rows = []
            for found in bpe.encode_all([t or "" for t in batch.column(1).to_pylist()]):
                ids, shown = " ".join([x[1] for x in found]), " ".join([x[2] for x in found])
                rows.append((sum([x[0] for x in found]), sha256(ids.encode()), sha256(shown.encode())))
            columns = [pa.array(c) for c in zip(*rows)] if rows else []
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, FIELDS)
