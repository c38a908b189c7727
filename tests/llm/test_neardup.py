import random

import brute
from chunkloom.llm import neardup


def result(spark, rows, schema="doc_id long, text string"):
    return sorted((tuple(r) for r in neardup.near_duplicates(spark.createDataFrame(rows, schema)).collect()), key=repr)


def edited(rng, base, edits):
    w = list(base)
    for i in rng.sample(range(len(w)), edits):
        w[i] = f"x{rng.random()}"
    return " ".join(w)


def test_groups_of_copies_equal_brute_force(spark):
    rng = random.Random(5)
    bases = [[f"w{rng.randrange(400)}" for _ in range(n)] for n in (146, 40, 90, 7)]
    shared = " ".join(f"common{i}" for i in range(30))
    rows = []
    for i in range(170):
        base = bases[i % 4]
        text = edited(rng, base, rng.randrange(0, min(12, len(base) // 3)))
        rows.append((i, text if i % 3 else f"{text} {shared}"))
    rows += [(500 + i, f"{' '.join(f'u{i}_{j}' for j in range(8))} {shared}") for i in range(12)]
    want = brute.components(rows)
    got = result(spark, rows)
    assert len(got) == len(rows)
    assert {r[0]: r[2] for r in got} == want
    assert {r[0]: r[1] for r in got} == {i: len(brute.shingles(t)) for i, t in rows}
    assert all(r[3] == (r[0] == r[2]) for r in got)


def test_edge_cases(spark):
    long = " ".join(f"l{i}" for i in range(30_000))
    rows = [
        (7, "a b c d e f"), (3, "A B\tC d\ne f"), (3, "A B\tC d\ne f"), (9, None), (4, ""), (8, " \n"), (None, "a b c d e f"), (5, "a b"),
        (6, "b a"), (11, "a  b"), (20, long), (21, long + " tail"), (1, "same id"), (1, "same id other text altogether here"),
    ]
    got = result(spark, [(*r, "x", True) for r in rows], "doc_id long, text string, component_id string, kept boolean")
    parts = [(r[0], r[2], r[3]) for r in got]
    assert parts.count((3, 3, True)) == 2 and (7, 3, False) in parts
    assert {(9, 9, True), (4, 4, True), (8, 8, True), (None, None, True), (5, 5, True), (6, 6, True), (11, 5, False), (20, 20, True), (21, 20, False)} <= set(parts)
    assert parts.count((1, 1, True)) == 2
    assert {r[1] for r in got if r[0] in (4, 8, 9)} == {0}
    assert result(spark, []) == []


def test_boundary_is_exact(spark):
    # 7 shingles against 7 + 2 others with 6 and 7 in common.
    w = [f"t{i}" for i in range(16)]
    nine, inner = " ".join(w[:13]), " ".join(w[:11])
    assert 100 * 7 >= 75 * 9 and [r[2] for r in result(spark, [(1, nine), (2, inner)])] == [1, 1]
    assert [r[2] for r in result(spark, [(1, " ".join(w[:14])), (2, inner)])] == [1, 2]
