import hashlib
import random

import numpy as np
import pytest

from quillframe.llm import suffix_dedup as S


def brute(rows, size=100):
    seen, out = set(), []
    for doc, text in rows:
        data = (text or "").encode()
        hit = bytearray(len(data))
        for p in range(len(data) - size + 1):
            if data[p : p + size] in seen:
                hit[p : p + size] = b"\1" * size
            seen.add(data[p : p + size])
        kept = bytes(x for x, h in zip(data, hit) if not h)
        runs = sum(1 for i, h in enumerate(hit) if h and (i == 0 or not hit[i - 1]))
        out.append((doc, len(data), sum(hit), runs, hashlib.sha256(kept).hexdigest()))
    return out


def texts():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randint(1, 5)))
    passage = " ".join(word() for _ in range(60))
    line = " ".join(word() for _ in range(30))
    rows = []
    for i in range(40):
        own = " ".join(word() for _ in range(rng.randint(0, 80)))
        kind = i % 5
        rows.append((i, {0: own, 1: own + passage + own[:50], 2: f"{line}\n{own}", 3: rows[i - 3][1] if i > 3 else own, 4: passage[: rng.randint(50, 200)] + own + own}[kind]))
    near = rows[1][1]
    rows += [(100 + i, near[: 37 * i % 200] + "X" + near[37 * i % 200 :]) for i in range(20)]
    rows += [(200, None), (201, ""), (202, "a" * 99), (203, "a" * 100), (204, "a" * 1000), (205, "ab" * 400), (206, "x" + "a" * 150 + "y")]
    return rows


@pytest.mark.parametrize("hot", [4096, 1])
def test_whole_against_brute_force(spark, hot):
    rows = texts()
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, spans string")
    spans = S.removed_spans(spark, docs, hot)
    got = []
    for r in S.with_spans(docs, spans).collect():
        data = (r["row"]["text"] or "").encode()
        kept, n, runs = S.cut(data, r["spans"])
        got.append((r["row"]["doc_id"], len(data), n, runs, hashlib.sha256(kept).hexdigest()))
    assert sorted(got) == brute(rows)


def test_rows(spark):
    rows = texts()[:12]
    docs = spark.createDataFrame([*rows, (None, rows[1][1]), rows[1]], "doc_id long, text string")
    out = S.dedup_bytes(spark, docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    want = brute([(None, rows[1][1]), *rows])
    by_id = {}
    for r in out:
        by_id.setdefault(r["doc_id"], set()).add(tuple(r))
    assert by_id == {w[0]: {w} for w in want} and len(out) == 14
    assert S.dedup_bytes(spark, docs.limit(0)).count() == 0


def test_clean(spark):
    rng = random.Random(1)
    a = "".join(rng.choice("éàü") for _ in range(60))
    docs = spark.createDataFrame([(1, f"{a} first", "u"), (2, f"second {a}", None), (3, a, "v"), (4, None, "w")], "doc_id long, text string, kept string")
    out = S.clean(spark, docs)
    assert out.columns == docs.columns
    assert {r["doc_id"]: r["text"] for r in out.collect()} == {1: f"{a} first", 2: "second ", 4: None}


def test_groups_are_maximal_with_all_occurrences(spark):
    rng = random.Random(1)
    shared = "".join(rng.choice("abcdefgh") for _ in range(120))
    docs = spark.createDataFrame([(1, "p" + shared + "q"), (2, "r" + shared + "s"), (3, "t" + shared + "u"), (4, shared[:110] + "#")], "doc_id long, text string")
    groups = {}
    for r in S.maximal_repeats(spark, docs).collect():
        groups.setdefault((r["group"], r["length"]), set()).add((r["doc_id"], r["start"]))
    assert any(len(g) == 4 and n <= 110 for (_, n), g in groups.items())
    # a repeat longer than its anchors' contexts is a chain of groups
    covered = {x for (_, n), g in groups.items() if {d for d, _ in g} >= {1, 2, 3} for d, s in g if d == 2 for x in range(s, s + n)}
    assert covered == set(range(1, 121))


def test_interval_scan_against_definition():
    rng = random.Random(2)
    text = "".join(rng.choice("ab") for _ in range(60))
    order = sorted(range(60), key=lambda i: text[i:])
    lcp = [0] + [next((k for k in range(61) if text[a + k : a + k + 1] != text[b + k : b + k + 1] or not text[a + k : a + k + 1]), 0) for a, b in zip(order, order[1:])]
    left = [ord(text[i - 1]) if i else -2 for i in order]
    got = {(text[order[i] : order[i] + d], frozenset(order[i : j + 1])) for d, i, j in S.interval_groups(lcp, left, 3)}
    want = set()
    for n in range(3, 60):
        for s in {text[i : i + n] for i in range(60 - n + 1)}:
            at = frozenset(i for i in range(60 - n + 1) if text.startswith(s, i))
            lefts, rights = {text[i - 1] if i else "^" for i in at}, {text[i + n : i + n + 1] or "$" for i in at}
            if len(at) > 1 and len(lefts) > 1 and len(rights) > 1:
                want.add((s, at))
    assert got == want


def test_anchors_tile_the_windows():
    for data in (b"a" * 300, bytes(np.random.default_rng(1).integers(0, 256, 1_200_000, dtype=np.uint8)), b"x" * 99):
        _, _, lo, n, o = S.anchors(data)
        windows = max(0, len(data) - 99)
        assert n.sum() == windows and (np.diff(lo) == n[:-1]).all() and (n <= 69).all() and (o <= 68).all()
