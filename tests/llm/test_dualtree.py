import math
import random
import re
from collections import Counter

import numpy as np
from chunkloom.llm import dualtree
from pyspark.sql import functions as F

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return [t.translate(LOWER) for t in TERM.findall(text or "")]


def expected(docs, items, top):
    vectors = [(i, Counter(terms(t))) for i, t in docs]
    vectors = [(i, c) for i, c in vectors if c]
    n_docs, length = len(vectors), sum(sum(c.values()) for _, c in vectors)
    df = Counter(t for _, c in vectors for t in c)
    weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1))) for t, n in df.items()}
    wanted = {}
    for item, text in items:
        if item is not None and terms(text):
            wanted.setdefault(item, set()).update(terms(text))
    out = []
    for item, need in wanted.items():
        scored = []
        for i, c in vectors:
            m = 100 - 50 + (50 * sum(c.values()) * n_docs) // length
            score = sum(weight[t] * ((1000000000 * c[t]) // (1000 * c[t] + 20 * m)) for t in need if t in c)
            if score > 0 and i is not None:
                scored.append((-score, i))
        out += [(item, k, i, -s) for k, (s, i) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out)


def run(spark, docs, items, top, **how):
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("score", F.lit("x")).withColumn("n", F.lit(1)).withColumn("head", F.lit(1))
    i = spark.createDataFrame(items, "item_id long, text string").withColumn("rank", F.lit(0)).withColumn("item", F.lit("x"))
    return sorted(tuple(r) for r in dualtree.search(d, i, top, **how).collect())


def corpus():
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(400)]
    weights = [1 / (i + 1) for i in range(400)]
    docs = [(i, " ".join(rng.choices(vocabulary, weights, k=rng.randrange(0, 60)))) for i in range(700)]
    docs += [(1000 + i, docs[rng.randrange(50)][1].upper()) for i in range(60)]
    items = [(i, "-".join(rng.choices(vocabulary, weights, k=rng.randrange(1, 20)))) for i in range(45)]
    return docs, items


def test_equals_brute_force(spark, monkeypatch):
    docs, items = corpus()
    want = expected(docs, items, 7)
    assert run(spark, docs, items, 7) == want
    # Many shards, and many passes over the items, give the same.
    monkeypatch.setattr(dualtree, "SHARD_DOCS", 37)
    assert run(spark, docs, items, 7, batch_bytes=200) == want


def test_edge_cases(spark):
    long = "deep " * 30_000 + "sea"
    docs = [(3, "Sea sea"), (3, "Sea sea"), (1, "sea SEA"), (None, "sea sea"), (2, None), (4, ""), (5, "--- ///"), (6, long), (7, "élan ÉLAN")]
    items = [(1, "SEA"), (1, "sea"), (2, "sea deep"), (None, "sea"), (3, None), (4, " . "), (5, "élan"), (6, "nothing")]
    assert run(spark, docs, items, 3) == expected(docs, items, 3)
    assert run(spark, [], items, 3) == [] and run(spark, docs, [], 3) == []


def test_more_wanted_than_there_are(spark):
    docs, items = corpus()
    assert run(spark, docs[:20], items, 50) == expected(docs[:20], items, 50)


def test_pairs_are_pruned():
    """Groups of documents on one subject each: an item's search reads few of the others."""
    rng = np.random.default_rng(1)
    subjects, size = 64, 64
    documents = np.zeros((subjects * size, subjects * 4))
    for s in range(subjects):
        documents[s * size: (s + 1) * size, s * 4: s * 4 + 4] = rng.integers(1, 1000, (size, 4))
    shard = dualtree.Shard(np.arange(len(documents)), documents, np.arange(subjects * 4))
    weights = np.ones(subjects * 4)
    tree = dualtree.ItemTree([np.arange(s * 4, s * 4 + 4) for s in range(subjects)], weights)
    search = dualtree.Search(tree, shard, np.zeros(subjects), 5)
    scored = []
    plain = search.scored
    search.scored = lambda node, rows: (scored.append(len(rows) * len(tree.members[node])), plain(node, rows))
    search.whole()
    assert sum(scored) < 0.25 * len(documents) * subjects
    for s in range(subjects):
        total = documents[:, s * 4: s * 4 + 4].sum(axis=1)
        want = np.lexsort((np.arange(len(total)), -total))[:5]
        assert list(search.best[s][1]) == list(want) and list(search.best[s][0]) == list(total[want])
