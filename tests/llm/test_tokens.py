"""Token operators: byte-level ids, packing, token files, word BPE."""

import io
import random
import zlib

import numpy as np
import pytest
import zstandard

from quillframe.llm import packing, token_files, word_bpe
from quillframe.llm.byte_tokens import byte_tokens

TEXTS = ["", None, "a", "Hello  world\n\n it's 12३ fine", "<|endoftext|> and <|startoftext|>", "é中文😀́\x1c\x85", "word " * 4000, "z" * 30_000, "İΣΑΣ ẞ"]


def sample_texts(spark, small):
    return [r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()]


def test_byte_ids_equal_the_library(spark, small):
    t = byte_tokens()
    for x in [x or "" for x in TEXTS] + sample_texts(spark, small):
        assert t.encode(x).tolist() == t.exact.encode(x, add_special_tokens=False).ids


def test_byte_ids_on_all_code_points():
    t = byte_tokens()
    texts = ["a" + "".join(f"{chr(c)}1 {chr(c)}b\n" for c in range(at, at + 512) if not 0xD800 <= c < 0xE000) for at in range(0, 0x110000, 512)]
    for x, e in zip(texts, t.exact.encode_batch(texts, add_special_tokens=False)):
        assert t.encode(x).tolist() == e.ids


def pieces_of(rows, ids, length=2048, end=1):
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    for doc, found in by_doc.items():
        at = 0
        for r in sorted(found, key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids[doc])
            piece = np.array(ids[doc][at : at + r["length"]], "<u4")
            assert r["ids_crc32"] == zlib.crc32(piece.tobytes()) and len(piece) == r["length"]
            at += r["length"]
        assert at == len(ids[doc])
    padding = 0
    for found in by_sequence.values():
        at = 0
        for r in sorted(found, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= length
        padding += length - at if at & (at - 1) else 0
    return padding


def test_packing(spark, small):
    texts = TEXTS + sample_texts(spark, small)
    docs = spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)], "doc_id long, text string, offset long").repartition(3)
    ids = {i: byte_tokens().exact.encode(t or "", add_special_tokens=False).ids + [1] for i, t in enumerate(texts)}
    rows = packing.pack(spark, docs).collect()
    assert pieces_of(rows, ids) == 0 and {r["doc_id"] for r in rows} == set(ids)
    assert packing.pack(spark, docs.limit(0)).count() == 0


def test_sum_of_squares_places_where_the_squares_are_least():
    rng = random.Random(1)
    p = packing.SumOfSquares(16)
    for i in range(300):
        size = rng.randint(1, 15)
        level = p.level.copy()

        def squares(at):
            after = level.copy()
            after[at] -= at > 0
            after[at + size] += 1
            return int((after[1:16] ** 2).sum())

        fits = [at for at in range(17 - size) if at == 0 or level[at]]
        assert p.best_level(size) == max(fits, key=lambda at: (-squares(at), at))
        list(p.place((i, 0, size)))


@pytest.mark.parametrize("most", [4, 10_000])
def test_settled_windows_need_no_padding(most):
    p = packing.SumOfSquares(64, most)
    rng = random.Random(2)
    sizes = [rng.randint(1, 63) for _ in range(500)]
    windows = [w for i, s in enumerate(sizes) for w in p.place((i, 0, s))] + list(p.settle())
    fills = [sum(x[2] for x in w) for w in windows]
    assert sum(fills) == sum(sizes) and all(f == 64 or f & (f - 1) == 0 for f in fills)


def test_token_files(spark, small):
    texts = TEXTS + sample_texts(spark, small)
    docs = spark.createDataFrame([(i * 3, t, 1) for i, t in enumerate(texts)] + [(None, "null id", 1)], "doc_id long, text string, start long")
    files = token_files.write(spark, docs)
    rows = sorted(token_files.read(files).collect(), key=lambda r: r["start"])
    exact, at = byte_tokens().exact, 0
    for (doc, text), r in zip([(None, "null id"), *((i * 3, t) for i, t in enumerate(texts))], rows):
        ids = np.array([*exact.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        assert tuple(r) == (doc, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert token_files.write_and_read(spark, docs.limit(0)).count() == 0
    # random access decompresses only the frames asked for
    for f in files.collect():
        system, path = token_files.open_sink(f["file"])
        reader = token_files.Reader(system.open_input_file(path))
        for doc in [int(x) for x in reader.index["doc_id"][reader.index["null"] == 0]][:3]:
            reader.decompressed = 0
            ((_, _, ids),) = reader.find([doc])
            assert ids.tolist() == [*exact.encode(texts[doc // 3] or "", add_special_tokens=False).ids, 2] and reader.decompressed == 1


class Memory(io.BytesIO):
    def size(self):
        return len(self.getvalue())

    def close(self):
        pass


@pytest.mark.parametrize("piece", [1 << 30, 44])
def test_file_format_and_checksum(piece):
    """Documents longer than a piece go on in further frames."""
    sink = Memory()
    w = token_files.Writer(sink, frame_bytes=64, piece_bytes=piece)
    docs = {i: np.arange(i, i + 10 * (i % 4), dtype=np.uint32) for i in range(9)}
    for i, ids in docs.items():
        w.add(i, ids)
    w.close()
    plain = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(sink.getvalue()), read_across_frames=True).read()
    assert plain == b"".join(x.astype("<u4").tobytes() for x in docs.values())
    reader = token_files.Reader(sink)
    assert {d: ids.tolist() for d, _, ids in reader.documents()} == {d: x.tolist() for d, x in docs.items()}
    assert [ids.tolist() for _, _, ids in reader.find([7, 3])] == [docs[3].tolist(), docs[7].tolist()]
    reader.frames = reader.frames.copy()
    reader.frames[0, 2] ^= 1
    with pytest.raises(ValueError, match="checksum"):
        reader.frame(0)


def test_word_bpe_equals_the_library(spark, small):
    bpe = word_bpe.word_bpe()
    rng = random.Random(1)
    alphabet = "abcdefgehiont  \n'sS1२éÉİßΣσ中文😀🇩🇪\x1c\x85​<|endoftext|>ԱᲉÀé"
    texts = [t or "" for t in TEXTS] + sample_texts(spark, small) + ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    for text, e in zip(texts, bpe.library.encode_batch(texts, add_special_tokens=False)):
        ids = word_bpe.encode(text)
        assert ids == e.ids and word_bpe.decode(ids) == bpe.library.decode(e.ids, skip_special_tokens=False)


def test_sure_letters_agree_with_the_library():
    bpe = word_bpe.word_bpe()
    for at in range(0, 0x110000, 256):
        cs = [chr(c) for c in range(at, at + 256) if not 0xD800 <= c < 0xE000 and not word_bpe._UNSURE.search(chr(c))]
        text = "".join(f"a{c}1 {c}b\n" for c in cs)
        if cs:
            assert word_bpe.encode(text) == bpe.library.encode(text, add_special_tokens=False).ids


def test_both_exact_mergers_agree_and_some_guesses_fail():
    bpe = word_bpe.word_bpe()
    rng = random.Random(4)
    for _ in range(200):
        letters = "".join(rng.choice("etaoinsrh") for _ in range(rng.randint(1, 60)))
        assert bpe.merge(bpe.symbols(letters)) == bpe.merge_long(bpe.symbols(letters))
    assert 0 < bpe.n_exact < bpe.n_words


def test_bpe_rows(spark):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, n_tokens string")
    rows = {r["doc_id"]: r for r in word_bpe.encode_documents(spark, docs).collect()}
    assert all(rows[i]["n_tokens"] == len(word_bpe.encode(t)) for i, t in enumerate(TEXTS))
    assert word_bpe.encode_documents(spark, docs.limit(0)).count() == 0


def test_ties_null_ids_and_repeated_rows(spark):
    """Rows of one doc_id stand in a fixed order, whatever the partitions; repeated rows count each."""
    rows = [(1, "b"), (1, "a"), (None, "x y"), (1, "a"), (None, None), (2, "")]
    schema = "doc_id long, text string, start long, __key string"
    one, two = (spark.createDataFrame([(*r, 0, "") for r in x], schema).repartition(n) for x, n in ((rows, 1), (rows[::-1], 3)))
    got = [sorted(map(tuple, token_files.write_and_read(spark, d).collect()), key=repr) for d in (one, two)]
    assert got[0] == got[1] and len(got[0]) == 6 and sorted(g[1] for g in got[0])[0] == 0
    starts = lambda df: sorted(repr(r["doc_id"]) for r in df.collect())
    for d in (one, two):
        assert starts(packing.pack(spark, d).filter("start = 0")) == starts(word_bpe.encode_documents(spark, d)) == sorted(repr(r[0]) for r in rows)
