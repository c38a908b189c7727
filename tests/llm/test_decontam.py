import random

import brute
from chunkloom.llm import decontam


def frames(spark, docs, items):
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item string, text string")


def run(spark, docs, items):
    found = decontam.contamination(*frames(spark, docs, items)).collect()
    assert all(r["contaminated"] == (r["n_hit"] > 0) and r["n_items"] == len(r["items"]) for r in found)
    return sorted(((r["doc_id"], r["n_words"], r["n_hit"], list(r["items"])) for r in found), key=repr)


def corpus():
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(12)]
    items = [(str(i), " ".join(rng.choices(vocabulary, k=rng.randrange(1, 16)))) for i in range(15)]
    docs = []
    for i in range(60):
        w = rng.choices(vocabulary, k=rng.randrange(0, 60))
        w[5:5] = [] if i % 3 else rng.choice(items)[1].upper().split()
        docs.append((i, "-".join(w) if i % 2 else " ".join(w)))
    return docs, items


def test_equals_brute_force(spark, monkeypatch):
    docs, items = corpus()
    want = sorted(brute.contamination(docs, items), key=repr)
    assert run(spark, docs, items) == want
    # Many small segments and many passes over the items give the same.
    for name, value in (("SEGMENT_WORDS", 64), ("BLOCK_BYTES", 40)):
        monkeypatch.setattr(decontam, name, value)
    monkeypatch.setattr(decontam.blocks, "__defaults__", (40,))
    assert run(spark, docs, items) == want


def test_edge_cases(spark):
    passage = "one two three four five six seven eight nine ten eleven"
    docs = [(1, None), (1, passage), (1, passage), (None, "ONE two three four five six seven eight nine ten"), (2, ""), (3, "ten eleven"),
            (4, "x " * 40_000 + passage), (5, "élan ÉLAN")]
    items = [("a", passage), ("a", passage), (None, "x x"), ("b", None), ("c", ""), ("d", "élan")]
    want = sorted([(1, 0, 0, []), (1, 11, 11, ["a"]), (1, 11, 11, ["a"]), (None, 10, 10, ["a"]), (2, 0, 0, []), (3, 2, 0, []),
                   (4, 40_011, 11, ["a"]), (5, 2, 1, ["d"])], key=repr)
    assert run(spark, docs, items) == want
    assert run(spark, [], items) == [] and run(spark, docs[:2], []) == [(1, 0, 0, []), (1, 11, 0, [])]


def test_postings_round_trip():
    import numpy as np

    rng = np.random.default_rng(0)
    lists = [np.unique(rng.integers(0, top, n)) for top, n in ((10, 5), (300, 50), (20_000, 9), (3_000_000, 400), (1, 1))]
    gaps = np.concatenate([np.diff(x, prepend=0) for x in lists])
    packed = decontam.pack(gaps, np.cumsum([len(x) for x in lists])).to_pylist()
    assert all((decontam.unpack(p) == x).all() for p, x in zip(packed, lists))


def test_proximity(spark):
    rng = random.Random(8)
    docs = [(i, " ".join(rng.choices("abcdefgh", k=rng.randrange(0, 40)))) for i in range(40)]
    items = [("x", "a b c"), ("y", "h h g"), ("z", "a q")]
    d, i = frames(spark, docs, items)
    index = decontam.build_index(d)
    got = {
        (r["doc_id"], r["item"], r["start"], r["stop"])
        for r in decontam.proximity_matches(index, i, 5).join(decontam.indexed_documents(index), ["segment", "ordinal"]).collect()
    }
    want = set()
    for doc, text in docs:
        w = text.split()
        for item, terms in items:
            need = set(terms.split())
            full = {(a, b) for a in range(len(w)) for b in range(a + 1, min(a + 5, len(w)) + 1) if need <= set(w[a:b])}
            want |= {(doc, item, a, b) for a, b in full if not any((c, d) != (a, b) and a <= c and d <= b for c, d in full)}
    assert got == want and want
