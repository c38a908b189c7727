import random
import re
from itertools import permutations

import brute
from chunkloom.llm import filteraudit
from pyspark.sql import functions as F


def failed(rows):
    out = {}
    for i, (doc, text, _) in enumerate(rows):
        w = brute.words(text, lower=False)
        t = text or ""
        f = {
            "A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t),
            "D": bool(re.search(r"[#$%&*|]", t)), "E": doc is not None and any(d is not None and d < doc and (u or "") == t for d, u, _ in rows),
        }
        out[i] = {k for k, bad in f.items() if bad}
    return out


def expected(rows, labels):
    fails = failed(rows)
    # A label without doc_id belongs to nobody, not to the rows without doc_id.
    good = {d for d, q, _ in labels if q == 1} - {None}
    toxic = {d for d, _, t in labels if t == 1} - {None}
    out = {}
    for part in {r[2] or "" for r in rows}:
        mine = [i for i, r in enumerate(rows) if (r[2] or "") == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in map("".join, permutations("ABCDE")):
            gone = set()
            for step, name in enumerate(order, 1):
                hit = [i for i in mine if name in fails[i]]
                removed = [i for i in hit if i not in gone]
                before = len(hit) - len(removed)
                gone |= set(removed)
                shapley[name] += len(removed)
                out[part, order, step] = [
                    len(mine) - len(gone), len(removed), before, sum(fails[i] == {name} for i in mine),
                    sum(rows[i][0] in good for i in removed), sum(rows[i][0] in toxic for i in removed),
                ]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(shapley[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


def run(spark, rows, labels):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("failed", F.lit("x")).withColumn("part", F.lit(1)).withColumn("key", F.lit(2))
    told = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("text", F.lit("y"))
    found = filteraudit.audit(docs, told).collect()
    out = {(r["part"], r["filter_order"], r["step"]): tuple(r)[3:] for r in found}
    assert len(out) == len(found)
    return out


def corpus():
    rng = random.Random(2)
    rows = []
    for i in range(120):
        w = [f"{'W' if rng.random() < 0.3 else 'w'}{rng.randrange(rng.choice([30, 300]))}" for _ in range(rng.choice([0, 3, 99, 100, 101, 220]))]
        text = " ".join(w) + rng.choice(["", "", " # ", "\tÉé\x0b"])
        rows.append((i, text, rng.choice(["en", "de", None, ""])))
    rows += [(200 + i, rows[rng.randrange(120)][1], "en") for i in range(40)]
    labels = [(i, rng.randrange(2), rng.randrange(2)) for i in range(0, 300, 2)]
    return rows, labels


def test_equals_brute_force(spark, monkeypatch):
    rows, labels = corpus()
    want = expected(rows, labels)
    assert run(spark, rows, labels) == want
    # Blocks of a few documents and many buckets give the same.
    for name, value in (("BLOCK_BYTES", 600), ("BUCKET_WORDS", 16)):
        monkeypatch.setattr(filteraudit, name, value)
    assert run(spark, rows, labels) == want


def test_edge_cases(spark):
    long = " ".join(f"l{i}" for i in range(60_000))
    rows = [(1, None, "en"), (2, "", None), (2, "", None), (None, "", "en"), (3, long, "en"), (4, long, "en"), (4, long, "en"), (None, long, "x"), (5, "ÄÖ| A", "x")]
    labels = [(2, 1, 0), (2, 0, 1), (None, 1, 1), (77, 1, 1), (4, None, 1)]
    assert run(spark, rows, labels) == expected(rows, labels)
    assert run(spark, [], labels) == {} and run(spark, rows, []) == expected(rows, [])


def test_matrix_is_the_count_of_every_word(spark, monkeypatch):
    monkeypatch.setattr(filteraudit, "BLOCK_BYTES", 500)
    rows, _ = corpus()
    packed = filteraudit.blocks(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    words = filteraudit.dictionary(packed)
    names = {r["id"]: bytes(r["word"]).decode() for r in filteraudit.words(words).collect()}
    every = {w for _, t, _ in rows for w in brute.words(t, lower=False)}
    assert sorted(names) == list(range(len(every))) and set(names.values()) == every
    got = {}
    for shard in filteraudit.matrix(packed, words).collect():
        indptr, indices, data = (filteraudit.W.widen(bytes(shard[c])) for c in ("indptr", "indices", "data"))
        for i, doc in enumerate(shard["ids"]):
            cells = range(indptr[i], indptr[i + 1])
            assert list(indices[indptr[i]:indptr[i + 1]]) == sorted(indices[indptr[i]:indptr[i + 1]])
            got[doc] = {names[indices[k]]: data[k] for k in cells}
    assert got == {d: dict(brute.Counter(brute.words(t, lower=False))) for d, t, _ in rows}
