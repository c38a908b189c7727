import brute
import corpus_pipeline
from chunkloom.llm import pii, quality
from pyspark.sql import functions as F

FOLDER = "/root/testdata/sf0.01"


def test_stages_equal_brute_force(spark):
    """Every stage against a plain version of its decision, on the rows its predecessor kept."""
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "MinHash near-dedup", "benchmark decontamination", "PII", "mixing sources to target weights"]
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, stages = docs.columns, dict(corpus_pipeline.STAGES)
    kept = stages["quality rules"](spark, docs, FOLDER).cache()
    trusted = quality.trusted_ids(spark.read.parquet(f"{FOLDER}/labels.parquet"))
    score = {r["doc_id"]: r["score"] for r in quality.measure(docs, quality.fit(docs, trusted), trusted, ["doc_id"]).collect()}
    want = [r for r in docs.collect() if not brute.quality(r["text"])[-1] and score[r["doc_id"]] >= quality.THRESHOLD]
    assert kept.columns == columns and sorted(kept.collect()) == sorted(want)

    unique = stages["MinHash near-dedup"](spark, kept, FOLDER).cache()
    groups = brute.components([(r["doc_id"], r["text"]) for r in want])
    want = [r for r in want if groups[r["doc_id"]] == r["doc_id"]]
    assert unique.columns == columns and sorted(unique.collect()) == sorted(want)

    clean = stages["benchmark decontamination"](spark, unique, FOLDER).cache()
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    hit = {d for d, _, n, _ in brute.contamination([(r["doc_id"], r["text"]) for r in want], items) if n}
    assert hit
    want = [r for r in want if r["doc_id"] not in hit]
    assert clean.columns == columns and sorted(clean.collect()) == sorted(want)

    private = stages["PII"](spark, clean, FOLDER).cache()
    assert private.columns == columns and private.count() == len(want)
    left = {r["doc_id"]: r for r in private.collect()}
    entities = {r["doc_id"]: r["m"] for r in clean.select("doc_id", pii.matches(F.col("text")).alias("m")).collect()}
    for r in want:
        new = left[r["doc_id"]]
        assert (new["text"] == r["text"]) == (not entities[r["doc_id"]]) and new["n_chars"] == len(new["text"])
        assert not any(m in new["text"] for m in entities[r["doc_id"]])

    mix = stages["mixing sources to target weights"](spark, private, FOLDER).collect()
    sizes = {}
    for r in left.values():
        sizes[r["source"]] = sizes.get(r["source"], 0) + len(brute.words(r["text"]))
    level = brute.water_level(sizes, {s: (3, 1, 2)[k % 3] for k, s in enumerate(sorted(sizes))}, 1.5, 2.0)
    taken = dict.fromkeys(sizes, 0)
    for r in mix:
        assert r["size"] == len(brute.words(left[r["doc_id"]]["text"])) and abs(r["target"] - level[r["source"]]) < 1e-6 and r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - level[s]) <= 0.02 * level[s] + 20 for s in sizes)
    assert sorted(map(tuple, corpus_pipeline.run(spark, FOLDER).collect())) == sorted(map(tuple, mix))


def test_empty_and_odd_rows(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (7, None, "en", "s", 0), (7, "w " * 60, None, None, None)], docs.schema).withColumn("kept", F.lit("x"))
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), FOLDER).count() == 0
        out = stage(spark, odd, FOLDER)
        rows = out.count()
        assert rows == 0 if name == "quality rules" else rows == 3
        assert name.startswith("mixing") or out.columns == odd.columns
