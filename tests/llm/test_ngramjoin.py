import random

import brute
import numpy as np
from chunkloom.llm import ngramjoin


def result(spark, rows, schema="doc_id long, text string", **how):
    return sorted((tuple(r) for r in ngramjoin.linked(spark.createDataFrame(rows, schema), **how).collect()), key=repr)


def edited(rng, base, edits):
    w = list(base)
    for i in rng.sample(range(len(w)), edits):
        w[i] = f"x{rng.randrange(60)}"
    return " ".join(w)


def corpus(seed):
    """Groups of near copies, chains of edits, long shared passages, and texts made of frequent words only."""
    rng = random.Random(seed)
    bases = [[f"w{rng.randrange(900)}" for _ in range(n)] for n in (160, 60, 240, 25)]
    shared = " ".join(f"common{i}" for i in range(50))
    rows = []
    for i in range(140):
        base = bases[i % 4]
        text = edited(rng, base, rng.randrange(0, max(2, len(base) // 25)))
        rows.append((i, text if i % 5 else f"{text} {shared}"))
    rows += [(300 + i, f"{' '.join(f'u{i}_{j}' for j in range(i % 6))} {shared}") for i in range(40)]
    chain = list(bases[2])
    for i in range(30):
        chain[rng.randrange(len(chain))] = f"c{i}"
        rows.append((400 + i, " ".join(chain)))
    rows += [(500 + i, " ".join(rng.choices("abc", k=rng.randrange(1, 30)))) for i in range(40)]
    return rows


def check(spark, rows, size=3, share=90):
    sets = [(i, brute.shingles(t, size)) for i, t in rows]
    want = brute.components(rows, size, share)
    got = result(spark, rows, size=size, share=share)
    assert {r[0]: r[2] for r in got} == want
    assert sorted((r[0], r[1]) for r in got) == sorted((i, len(s)) for i, s in sets)
    return want


def test_equals_brute_force(spark, monkeypatch):
    for seed in (1, 2):
        want = check(spark, corpus(seed))
        assert 3 < len(set(want.values())) < 250
    # Blocks of a few texts, many buckets and small cells give the same.
    for name, value in (("BLOCK_TOKENS", 300), ("BUCKET_GRAMS", 64), ("LIST_PART", 3)):
        monkeypatch.setattr(ngramjoin, name, value)
    check(spark, corpus(2))


def test_other_sizes_and_shares(spark):
    check(spark, corpus(3), 2, 80)
    check(spark, corpus(3), 5, 75)
    check(spark, corpus(3), 1, 100)


def test_edge_cases(spark):
    long = " ".join(f"l{i}" for i in range(30_000))
    rows = [
        (7, "a b c d e f"), (3, "A B\tC d\ne f"), (3, "A B\tC d\ne f"), (9, None), (4, ""), (8, " \n"), (None, "a b c d e f"), (5, "a b"),
        (6, "b a"), (11, "a  b"), (20, long), (21, long + " tail"), (1, "same id"), (1, "same id other text altogether here"), (2, "same id other text altogether here"),
    ]
    got = result(spark, [(*r, "x", 5) for r in rows], "doc_id long, text string, component_id string, n_shingles int")
    parts = [(r[0], r[2]) for r in got]
    assert parts.count((3, 3)) == 2 and parts.count((1, 1)) == 2
    assert {(7, 3), (9, 9), (4, 4), (8, 8), (None, None), (5, 5), (6, 6), (11, 5), (20, 20), (21, 20), (2, 1)} <= set(parts)
    assert {r[1] for r in got if r[0] in (4, 8, 9)} == {0} and [r[1] for r in got if r[0] is None] == [4]
    assert result(spark, []) == []


def test_boundary_is_exact(spark):
    # 18 shingles against 18 + 2 others, then 18 + 3.
    w = [f"t{i}" for i in range(30)]
    inner = " ".join(w[:20])
    assert [r[2] for r in result(spark, [(1, " ".join(w[:22])), (2, inner)])] == [1, 1]
    assert [r[2] for r in result(spark, [(1, " ".join(w[:23])), (2, inner)])] == [1, 2]


def test_requests_round_trip():
    rng = np.random.default_rng(0)
    for n, most in ((1, 2), (5, 300), (1000, 70_000), (3, 1)):
        low = np.sort(rng.integers(0, 1 << 32, n, dtype=np.uint64))
        times = rng.integers(1, most + 1, n)
        got = ngramjoin._unpacked(ngramjoin._packed(low, times))
        assert (got[0] == low).all() and (got[1] == times).all()


def test_blocks_hold_whole_documents_across_pieces(spark, monkeypatch):
    """Words wait as columns; a block ends where it is full, not where a batch or a piece of one ends."""
    monkeypatch.setattr(ngramjoin, "BLOCK_TOKENS", 40)
    monkeypatch.setattr(ngramjoin, "PACK_ROWS", 3)
    texts = [None if i % 7 == 0 else "" if i % 11 == 0 else " ".join(f"w{(i + j) % 13}" for j in range(i % 17)) for i in range(50)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    got = {r.doc_id: r.n_shingles for r in ngramjoin.profiles(docs).select("doc_id", "n_shingles").collect()}
    words = [(t or "").split() for t in texts]
    assert got == {i: len({tuple(w[j: j + 3]) for j in range(max(len(w) - 2, 1))}) if w else 0 for i, w in enumerate(words)}
