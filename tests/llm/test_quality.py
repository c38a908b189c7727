import math
import random
from collections import Counter

import brute
from chunkloom.llm import quality, words

TEXTS = [
    "plain words here " * 30, " ".join(f"w{i}" for i in range(80)), "a\nb\na\n \n \na\r\n" * 5, None, "", "#*$%&|<> é çà 日本", "x " * 60, "one",
    " ".join(f"long{i}" for i in range(20_000)),
]


def measured(spark, docs, labels):
    d = spark.createDataFrame(docs, "doc_id long, text string, score string, kept int")
    trusted = quality.trusted_ids(spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    return quality.measure(d, quality.fit(d, trusted), trusted, ["doc_id"]).collect()


def test_base_measures_and_edge_cases(spark):
    docs = [(i, t, "x", 1) for i, t in enumerate(TEXTS)] + [(1, TEXTS[1], None, None), (None, TEXTS[1], None, None)]
    got = measured(spark, docs, [(1, 1, 0), (1, 1, None), (2, 1, 1), (None, 1, 0), (77, None, None)])
    rows = sorted(((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in got), key=repr)
    assert rows == sorted([(i, *brute.quality(t)) for i, t, *_ in docs], key=repr)
    assert all(not (r["base_failed"] and r["kept"]) for r in got)
    assert measured(spark, [], []) == []
    assert {r["score"] for r in measured(spark, docs, [])} == {0.0}


def test_score_equals_brute_force(spark):
    rng = random.Random(1)
    docs = [(i, " ".join(rng.choices([f"v{j}" for j in range(30 if i % 2 else 60)], k=70)), "", 0) for i in range(40)]
    labels = [(i, 1, 0) for i in range(1, 20, 2)] + [(i, 0, 0) for i in range(0, 20, 2)] + [(21, 1, 1)]
    good = {i for i, q, t in labels if q and not t}

    def cells(text):
        w = [words.hashes([x.encode()]) for x in text.split()]
        import numpy as np

        f = [int(words.finish(h)[0] >> np.uint64(64 - quality.BITS)) for h in w]
        m = [words.finish(h) for h in w]
        return Counter(f + [int(words.finish(a * words.MIX[0] + b)[0] >> np.uint64(64 - quality.BITS)) for a, b in zip(m, m[1:])])

    own = {i: cells(t) for i, t, *_ in docs}
    raw, trusted = sum(own.values(), Counter()), sum((own[i] for i in good), Counter())
    size_raw, size_trusted = sum(raw.values()), sum(trusted.values())
    for r in measured(spark, docs, labels):
        mine, flag = own[r["doc_id"]], r["doc_id"] in good
        n = sum(mine.values())
        share = (size_trusted - n * flag) / (size_raw - n)
        want = sum(
            c * math.log((trusted[k] - c * flag + quality.SMOOTHING) / ((raw[k] - c) * share + quality.SMOOTHING)) for k, c in mine.items()
        ) / n
        assert abs(r["score"] - want) < 1e-9
        assert r["kept"] == (not r["base_failed"] and want >= quality.THRESHOLD)


def test_labelled_junk_is_told_apart(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    trusted = quality.trusted_ids(labels)
    kept = quality.measure(docs, quality.fit(docs, trusted), trusted, ["doc_id"]).filter("NOT base_failed").join(labels, "doc_id")
    share = {r["quality"]: r["k"] for r in kept.groupBy("quality").agg({"kept": "max"}).withColumnRenamed("max(kept)", "k").collect()}
    assert share[1]
    rows = kept.select("quality", "toxic", "kept").collect()
    clean = [r["kept"] for r in rows if r["quality"] == 1 and r["toxic"] == 0]
    junk = [r["kept"] for r in rows if r["quality"] == 0]
    assert sum(clean) == len(clean) and sum(junk) < 0.6 * len(junk)


def keep_rates(spark, folder):
    """(kept, all) of labelled documents that pass the base rules, by clean, toxic with an insult, and junk."""
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    trusted = quality.trusted_ids(labels)
    rows = quality.measure(docs, quality.fit(docs, trusted), trusted, ["doc_id", "text"]).filter("NOT base_failed").join(labels, "doc_id").collect()
    insults = {"trash", "pathetic", "idiot", "disgusting", "worthless", "clown", "loser", "scum", "stupid", "moron"}
    groups = {
        "clean": [r["kept"] for r in rows if r["quality"] == 1 and r["toxic"] == 0],
        "toxic": [r["kept"] for r in rows if r["toxic"] == 1 and insults & {w.strip(".,") for w in r["text"].lower().split()}],
        "toxic label only": [r["kept"] for r in rows if r["toxic"] == 1 and not insults & {w.strip(".,") for w in r["text"].lower().split()}],
        "junk": [r["kept"] for r in rows if r["quality"] == 0 and r["toxic"] == 0],
    }
    return {k: (sum(v), len(v)) for k, v in groups.items()}


def test_toxic_documents_are_rejected_and_clean_ones_kept(spark):
    rates = keep_rates(spark, "/root/testdata/sf0.01")
    assert rates["clean"][0] == rates["clean"][1] > 0
    assert rates["toxic"][0] == 0 < rates["toxic"][1]


def test_worst_window_rejects_few_insults_in_a_long_text(spark):
    rng = random.Random(2)
    plain = lambda n: rng.choices([f"v{j}" for j in range(40)], k=n)
    docs = [(i, " ".join(plain(400)), "", 0) for i in range(200)]
    # Two insults close together among 600 words.
    for i in range(200, 260):
        w = plain(600)
        w[100], w[110] = "Idiot,", "scum."
        docs.append((i, " ".join(w), "", 0))
    rows = measured(spark, docs, [(i, 1, 0) for i in range(0, 200, 2)] + [(i, 1, 1) for i in range(200, 230)])
    assert all(r["kept"] and r["worst"] == 0 for r in rows if r["doc_id"] < 200)
    assert all(not r["kept"] and r["score"] < quality.THRESHOLD and r["worst"] < quality.WORST for r in rows if r["doc_id"] >= 200)
