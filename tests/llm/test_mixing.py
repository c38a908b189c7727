import random

import brute
from chunkloom.llm import mixing
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, source string, size string, target int"


def mixed(spark, rows, **kw):
    return mixing.mix(spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA), **kw).collect()


def test_targets_and_takes(spark):
    rng = random.Random(4)
    rows = []
    for i in range(900):
        source = rng.choice(["s0"] * 6 + ["s1", "s2", "é", "Z", None])
        n = int(rng.paretovariate(1)) + rng.randrange(40)
        rows.append((i, " ".join(["w"] * min(n, 2500)), source))
    rows += [(5, rows[5][1], rows[5][2]), (None, "a b\tc", "s1"), (None, None, None), (991, "", "empty")]
    got = mixed(spark, rows)
    assert len(got) == len(rows)
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(brute.words(t))
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None]
    want = brute.water_level(sizes, {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}, 1.5, 2.0)
    taken = {}
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - want[r["source"]]) < 1e-6
        assert r["taken"] == r["copies"] * r["size"] and 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    for s, total in taken.items():
        assert abs(total - want[s]) <= 0.01 * want[s] + 5, (s, total, want[s])
    again = mixed(spark, rows[::-1])
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted(map(key, got)) == sorted(map(key, again))


def test_edge_cases(spark):
    assert mixed(spark, []) == []
    assert [r["taken"] for r in mixed(spark, [(1, None, "a"), (2, "", None)])] == [0, 0]
    one = mixed(spark, [(i, "a b c d", "only") for i in range(10)])
    assert {r["target"] for r in one} == {60.0} and sum(r["taken"] for r in one) == 60
    assert sum(r["taken"] for r in mixed(spark, [(1, "w " * 30_000, "a")])) in (30_000, 60_000)


def test_balance_meets_overlapping_constraints(spark):
    rows = [(s, l, 10.0 * (i + 1)) for i, (s, l) in enumerate((s, l) for s in "abc" for l in "xy")]
    cells = spark.createDataFrame(rows, "source string, lang string, mass double")
    targets = {
        "source": spark.createDataFrame([("a", 60.0), ("b", 50.0), ("c", 100.0)], "source string, target double"),
        "lang": spark.createDataFrame([("x", 140.0), ("y", 70.0)], "lang string, target double"),
    }
    lambdas = mixing.balance(cells, targets)
    tilted = cells
    for c, v in lambdas.items():
        tilted = tilted.join(v.withColumnRenamed("lambda", f"l_{c}"), c)
    tilted = tilted.withColumn("w", F.col("mass") * F.exp(F.col("l_source") + F.col("l_lang")))
    for c, t in targets.items():
        for r in tilted.groupBy(c).agg(F.sum("w").alias("w")).join(t, c).collect():
            assert abs(r["w"] - r["target"]) < 1e-5
