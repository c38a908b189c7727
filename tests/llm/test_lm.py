import math
import random
from collections import Counter

import brute
import pytest
from chunkloom.llm import lm


def expected(docs, order, strength):
    """Scores by dictionaries, with the recursion of the model instead of an automaton."""
    counts = [Counter() for _ in range(order)]
    for i, text in docs:
        if not lm.held_out(i):
            seq = ["<s>", *brute.words(text), "</s>"]
            for k in range(1, order + 1):
                counts[k - 1].update(tuple(seq[j - k + 1: j + 1]) for j in range(max(k - 1, 1), len(seq)))
    total, distinct = sum(counts[0].values()), len(counts[0])

    def p(history, w):
        if not history:
            return (counts[0][(w,)] + 0.1) / (total + 0.1 * (distinct + 1))
        mass = counts[0][("</s>",)] if history == ("<s>",) else counts[len(history) - 1][history]
        return (counts[len(history)][(*history, w)] + strength * p(history[1:], w)) / (mass + strength)

    out = []
    for i, text in docs:
        seq = ["<s>", *brute.words(text), "</s>"]
        base = sum(math.log10(p((), w)) for w in seq[1:])
        score = sum(math.log10(p(tuple(seq[max(0, j - order + 1): j]), seq[j])) for j in range(1, len(seq)))
        out.append((i, lm.held_out(i), len(seq) - 1, sum(counts[0][(w,)] > 0 for w in seq[1:]), total, round(base, 6), round(score, 6)))
    return sorted(out, key=repr)


def scored(spark, docs, **kw):
    df = spark.createDataFrame([(*d, 1.0) for d in docs], "doc_id long, text string, score double")
    return sorted(((*tuple(r)[:5], round(r[5], 6), round(r[6], 6)) for r in lm.score(df, **kw).collect()), key=repr)


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_equals_brute_force(spark, monkeypatch, order):
    rng = random.Random(order)
    docs = [(i, " ".join(rng.choices([f"w{j}" for j in range(6)] + [f"r{i}"], k=rng.randrange(0, 25)))) for i in range(60)]
    docs += [(3, docs[3][1]), (None, "w1 w2 new"), (None, None), (400, "\t\n"), (401, "W1 W2\x0bW3 É")]
    want = expected(docs, order, 2.5)
    assert scored(spark, docs, order=order, strength=2.5) == want
    monkeypatch.setattr(lm, "BLOCK_TOKENS", 40)
    monkeypatch.setattr(lm, "BUCKET_ENTRIES", 20)
    assert scored(spark, docs, order=order, strength=2.5) == want


def test_edge_cases(spark):
    assert scored(spark, []) == []
    nobody = [(None, "a b"), (None, None)]
    assert scored(spark, nobody) == expected(nobody, 2, lm.STRENGTH)
    long = [(1, " ".join(f"w{i % 50}" for i in range(30_000))), (2, "w1")]
    assert scored(spark, long) == expected(long, 2, lm.STRENGTH)


def test_distribution_sums_to_one(spark):
    docs = [(i, "a b a c a b") for i in range(30)]
    words = ["a", "b", "c"]
    texts = [(1000 + 20 * k, f"a {w}") for k, w in enumerate([*words, ""])]
    scores = {r[0]: r for r in scored(spark, docs + [(i, t) for i, t in texts if lm.held_out(i)])}
    assert all(r[6] <= 0 for r in scores.values())
    # Given "a": every word, the end, and one class of unknown words.
    table = Counter()
    for i, t in docs:
        if not lm.held_out(i):
            seq = [*t.split(), "</s>"]
            table.update(zip(seq, seq[1:]))
    uni = Counter(w for i, t in docs if not lm.held_out(i) for w in [*t.split(), "</s>"])
    n, v = sum(uni.values()), len(uni)
    p = [(table[("a", w)] + lm.STRENGTH * (uni[w] + 0.1) / (n + 0.1 * (v + 1))) / (uni["a"] + lm.STRENGTH) for w in [*uni, "unknown"]]
    assert abs(sum(p) - 1) < 1e-12


def test_held_out_texts_are_more_likely_than_by_words_alone(spark):
    rows = lm.score(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).filter("held_out AND n_tokens > 20").collect()
    assert sum(r["score"] for r in rows) > sum(r["base_score"] for r in rows)
    assert {r["held_out"] for r in rows} == {True}
