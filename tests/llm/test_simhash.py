import random
import re

import numpy as np
import pytest
import xxhash

from quillframe.llm import components, simhash as S


def brute_fingerprint(text, size=3):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(n, linked):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(n):
        for b in range(a):
            if linked(a, b):
                parent[find(a)] = find(b)
    return [find(i) for i in range(n)]


TEXTS = ["", None, "A", "a b", "Ab CD ef gh", "ab cd ef gh", "ÉA é", "x\x1fy\x85z w", "\t\x0b", "a b c " * 5000]


def test_fingerprints():
    for t in TEXTS:
        assert S.fingerprint(t) % 2**64 == brute_fingerprint(t)


def test_pigeonring_finds_all_pairs_and_hot_keys_find_all_components(spark):
    rng = random.Random(7)
    fps = set()
    for _ in range(30):
        base = rng.getrandbits(64)
        for _ in range(8):
            x = base
            for _ in range(rng.randint(0, 4)):
                x ^= 1 << rng.randrange(64)
            fps.add(x)
    fps = sorted(fps)
    signed = [S._signed(x) for x in fps]
    nodes = spark.createDataFrame([(0, x) for x in signed], "tab int, fp long")
    want = {tuple(sorted((S._signed(a), S._signed(b)))) for i, a in enumerate(fps) for b in fps[:i] if bin(a ^ b).count("1") <= 2}
    assert {(r["a"], r["b"]) for r in S.links(nodes).collect()} == want
    expect = groups(len(fps), lambda a, b: bin(fps[a] ^ fps[b]).count("1") <= 2)
    for hot in (64, 1):
        label = {r["node"]: r["label"] for r in components.connected_components(spark, S.links(nodes, hot)).collect()}
        got = [label.get(x, x) for x in signed]
        assert len(set(zip(got, expect))) == len(set(got)) == len(set(expect))


def test_query_rows(spark):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)] + [(None, "", "y"), (0, "", "z")], "doc_id long, text string, fp string")
    got = [(r["doc_id"], r["fingerprint"], r["component_id"]) for r in S.near_duplicates(spark, docs).collect()]
    fps = [brute_fingerprint(t) for t in TEXTS]
    root = groups(len(fps), lambda a, b: bin(fps[a] ^ fps[b]).count("1") <= 2)
    want = [(i, f"{f:016x}", min(j for j in range(len(fps)) if root[j] == root[i])) for i, f in enumerate(fps)]
    assert sorted(got, key=str) == sorted([*want, (None, "0" * 16, 0), (0, "0" * 16, 0)], key=str)
    assert S.near_duplicates(spark, spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_keep_one(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    base = [word() for _ in range(400)]
    near = list(base)
    near[200] = "changed"
    far = base[:200] + [word() for _ in range(200)]
    rows = [(3, " ".join(base)), (1, " ".join(near)), (2, " ".join(far)), (4, " ".join(base)), (4, " ".join(base)), (None, " ".join(near)), (5, ""), (6, None), (7, "one two"), (8, "ONE two")]
    docs = spark.createDataFrame([(*r, "k") for r in rows], "doc_id long, text string, key string")
    out = S.keep_one(spark, docs)
    assert out.columns == docs.columns
    assert sorted(r["doc_id"] for r in out.collect()) == [1, 2, 5, 7]
    assert S.keep_one(spark, docs.limit(0)).count() == 0


def test_shingle_sets():
    a = S.shingle_set("a b c d e f")
    assert len(a) == 2 and len(S.shingle_set("")) == 1 and np.array_equal(S.shingle_set("A b"), S.shingle_set("a B"))


@pytest.mark.parametrize("edges", [[(1, 2), (3, 2), (4, 3), (9, 8)], [(i, i + 1) for i in range(60)], [(0, i) for i in range(1, 50)], []])
def test_components(spark, edges):
    frame = spark.createDataFrame([(a, b) for a, b in edges] + [(5, 5)], "a long, b long")
    got = {r["node"]: r["label"] for r in components.connected_components(spark, frame).collect()}
    nodes = sorted({x for e in edges for x in e})
    root = groups(len(nodes), lambda a, b: (nodes[a], nodes[b]) in edges or (nodes[b], nodes[a]) in edges)
    assert got == {n: min(m for j, m in enumerate(nodes) if root[j] == root[i]) for i, n in enumerate(nodes)}


def similar_by_definition(texts):
    sets = [set(S.shingle_set(t).tolist()) for t in texts]
    root = groups(len(texts), lambda a, b: len(sets[a] & sets[b]) >= 0.8 * (len(sets[a]) * len(sets[b])) ** 0.5 - 1e-9)
    return {frozenset(i for i, r in enumerate(root) if r == x) for x in root}


def found_similar(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    nodes = S.checkpointed(spark, S.sketches(spark, docs))
    at = {r["digest"]: r["key"] for r in nodes.collect()}
    label = {at[r["node"]]: r["label"] for r in S.similar_groups(spark, docs, nodes).collect()}
    out = {}
    for i in range(len(texts)):
        out.setdefault(label.get(i, ("alone", i)), set()).add(i)
    return {frozenset(g) for g in out.values()}


def test_block_append_and_scattered_edits_are_found(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    texts = []
    for i in range(12):
        base = [word() for _ in range(300)]
        block = base[:100] + [word() for _ in range(15 + i)] + base[115 + i :]
        more = base + [word() for _ in range(30 + 2 * i)]
        spread = [word() if j % 75 == 30 else w for j, w in enumerate(base)]
        texts += [" ".join(x) for x in (base, block, more, spread)]
    want = similar_by_definition(texts)
    assert len(want) == 12 and found_similar(spark, texts) == want


def test_hub_that_fails_loses_no_link(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    base = [word() for _ in range(200)]
    texts = [" ".join(base), " ".join(base[:100] + ["new"] + base[101:])]
    texts += [" ".join(base[:k] + rng.sample(base[k:], 200 - k)) for k in (0, 40, 120, 150, 160, 165)]
    texts += [" ".join(base[30 * i :] + [word() for _ in range(30 * i)]) for i in range(1, 5)]
    assert found_similar(spark, texts) == similar_by_definition(texts)


def test_recall_by_similarity(spark):
    """Pairs with scattered edits, from far under the bound to far over it: what is linked is similar, and of what is similar 0.97 is linked."""
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    texts = []
    for i in range(120):
        base = [word() for _ in range(rng.choice((60, 200, 600)))]
        every = rng.choice((12, 20, 25, 30, 40, 60, 100))
        texts += [" ".join(base), " ".join(word() if j % every == 3 else w for j, w in enumerate(base))]
    want = {g for g in similar_by_definition(texts) if len(g) > 1}
    got = {g for g in found_similar(spark, texts) if len(g) > 1}
    assert 40 < len(want) < 100 and got <= want and len(got) >= 0.97 * len(want)


def test_keep_one_with_clashing_names(spark):
    names = ["doc_id", "text", "key", "digest", "row", "__key", "keys"]
    rows = [(i, "one two three", *"abcde") for i in (2, 1, 1, None)]
    docs = spark.createDataFrame(rows, ", ".join(f"`{n}` {'long' if n == 'doc_id' else 'string'}" for n in names))
    out = S.keep_one(spark, docs)
    assert out.columns == names and [tuple(r) for r in out.collect()] == [rows[1]]
