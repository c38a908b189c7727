from pyspark.sql import functions as F

from chunkloom.operators import embed, snapshot
from chunkloom.operators.incremental import decide, merge_chunks
from chunkloom.plans.index import Corpus, apply_decisions, diff_of, empty_corpus, full_index, incremental_index
from chunkloom.session import cut
from chunkloom.sources.diffs import read_name_status

A = {
    "brew.py": "def boil(cups, heat):\n    return cups * heat\n\n\ndef cool(cups, heat):\n    return cups - heat\n",
    "spilled.py": "def spill():\n    pass\n",
    "label.ts": "export function label(cups) {\n  return cups;\n}\n",
}
B = {
    "brew.py": "def boil(cups, heat):\n    return cups * heat\n\n\ndef steep(cups, heat):\n    return cups + heat\n",
    "tray.py": "def carry():\n    return 6\n",
    "moved_label.ts": A["label.ts"],
}


def files(spark, tree):
    rows = [("r", "c", p, len(t.encode()), bytearray(t.encode())) for p, t in tree.items()]
    return spark.createDataFrame(rows, "repository_id string, commit string, path string, length long, content binary")


def settle(corpus):
    return Corpus(cut(corpus.files), cut(corpus.chunks), cut(corpus.vectors) if corpus.vectors is not None else None)


def chunk_set(corpus):
    return sorted((r.file_path, r.symbol, r.start_line, r.content_hash) for r in corpus.chunks.collect())


def test_incremental_equals_full(spark):
    fn = embed.deterministic(8)
    first = settle(full_index(files(spark, A), empty_corpus(spark), fn).corpus)
    assert first.chunks.count() == 4 and first.vectors.count() == 4
    diff = diff_of(first.files, files(spark, B))
    result = incremental_index(diff, files(spark, B), first, fn)
    stats = result.stats.collect()[0].asDict()
    assert {k: stats[k] for k in ("files_discovered", "files_added", "files_modified", "files_deleted", "files_renamed")} == {
        "files_discovered": 4, "files_added": 1, "files_modified": 1, "files_deleted": 1, "files_renamed": 1}
    assert stats["chunks_created"] == 2 and stats["chunks_deleted"] == 2
    second = settle(result.corpus)
    direct = full_index(files(spark, B), empty_corpus(spark), fn).corpus
    assert chunk_set(second) == chunk_set(direct)
    before = {r.symbol: (r.file_id, r.chunk_id) for r in first.chunks.collect()}
    after = {r.symbol: (r.file_id, r.chunk_id, r.file_path) for r in second.chunks.collect()}
    assert after["label"][:2] == before["label"] and after["label"][2] == "moved_label.ts"
    assert after["boil"][:2] == before["boil"]
    assert {r.chunk_id for r in second.vectors.collect()} == {r.chunk_id for r in second.chunks.collect()}
    assert diff_of(second.files, files(spark, B)).count() == 0


def test_decision_table(spark):
    indexed = spark.createDataFrame(
        [("r", "i1", "a.py", "h"), ("r", "i2", "b.py", "h"), ("r", "i3", "c.py", "h")],
        "repository_id string, file_id string, path string, content_hash string")
    diff = spark.createDataFrame(
        [("r", "added", "../x.py", None), ("r", "deleted", "a.py", None), ("r", "deleted", "zz.py", None),
         ("r", "renamed", "n.py", "none.py"), ("r", "renamed", "b.bin", "b.py"), ("r", "added", "b.py", None),
         ("r", "added", "img.png", None), ("r", "modified", "c.py", None)],
        "repository_id string, status string, path string, old_path string")
    tree = {"n.py": "x", "b.py": "y", "c.py": "\0bin", "b.bin": "q"}
    got = {(r.status, r.path): r.action for r in decide(diff, indexed, files(spark, tree)).collect()}
    assert got == {
        ("added", "../x.py"): "skip", ("deleted", "a.py"): "delete", ("deleted", "zz.py"): "nothing",
        ("renamed", "n.py"): "index", ("renamed", "b.bin"): "delete", ("added", "b.py"): "index",
        ("added", "img.png"): "skip", ("modified", "c.py"): "delete"}


def test_reused_chunk_moves_lines_and_path(spark):
    first = settle(full_index(files(spark, {"a.py": "def f():\n    pass\n"}), empty_corpus(spark)).corpus)
    new = {"b.py": "x = 1\n\ndef f():\n    pass\n"}
    diff = spark.createDataFrame([("r", "renamed", "b.py", "a.py")], "repository_id string, status string, path string, old_path string")
    got = incremental_index(diff, files(spark, new), first)
    row = got.corpus.chunks.collect()[0]
    assert (row.file_path, row.start_line) == ("b.py", 3)
    assert got.chunk_ops.collect()[0].op == "reuse"
    assert got.corpus.chunks.select("file_id").first() == first.chunks.select("file_id").first()


def test_name_status_and_similar_renames(spark):
    lines = ["A\tnew.py", "M\tchanged.py", "D\tremoved.py", "R100\told/path.py\tnew/path.py", "C075\tsource.py\tcopy.py", "", "T\tx"]
    got = [tuple(r) for r in read_name_status(spark.createDataFrame([(l,) for l in lines], "value string")).collect()]
    assert got == [("added", "new.py", None), ("modified", "changed.py", None), ("deleted", "removed.py", None),
                   ("renamed", "new/path.py", "old/path.py"), ("copied", "copy.py", "source.py")]
    schema = "repository_id string, path string, text string"
    old = spark.createDataFrame([("r", "o1", "a\nb\nc\nd"), ("r", "o2", "x\ny\nz"), ("r", "o3", "a\nb\nc\nd")], schema)
    new = spark.createDataFrame([("r", "n1", "a\nb\nc\ne"), ("r", "n2", "x\nq\nw")], schema)
    pairs = [(r.old_path, r.path, round(r.ratio, 3)) for r in snapshot.pair_similar_renames(old, new).collect()]
    assert pairs == [("o1", "n1", 0.6)]


def test_rename_pairs_split_hot_group(spark):
    changes = spark.range(600).select(
        F.lit("r").alias("repository_id"), F.concat(F.lit("p"), "id").alias("path"),
        F.when(F.col("id") < 400, F.lit("h")).alias("old_hash"), F.when(F.col("id") >= 400, F.lit("h")).alias("new_hash"),
        F.when(F.col("id") < 400, "deleted").otherwise("new").alias("status"))
    pairs = snapshot.pair_renames(changes).collect()
    assert len(pairs) == 200 and len({p.old_path for p in pairs}) == 200 and len({p.path for p in pairs}) == 200


def test_vector_equals_standard_generator():
    import hashlib
    import random

    text = "def f(): pass"
    rng = random.Random(int.from_bytes(hashlib.sha256(text.encode()).digest()[:8], "big"))
    raw = [rng.uniform(-1.0, 1.0) for _ in range(32)]
    norm = sum(v * v for v in raw) ** 0.5
    got = embed.hash_seeded_vector(text, 32)
    assert max(abs(g - v / norm) for g, v in zip(got, raw)) < 1e-12


def greedy(old, new, least=0.5):
    """Pairs by falling ratio, ties by the MD5 of the classes' smallest paths, then by bucketed path; each file once."""
    import hashlib

    sets = lambda side: {p: frozenset(x for x in t.split("\n") if x.strip()) for p, t in side.items()}
    a, b = sets(old), sets(new)
    name = lambda side, p: min(q for q in side if side[q] == side[p])
    place = lambda p: (hashlib.sha256(p.encode()).hexdigest()[:2], p)
    edges = []
    for o in a:
        for n in b:
            if a[o] and b[n] and len(a[o] & b[n]) >= least * len(a[o] | b[n]):
                tie = hashlib.md5(f"{name(a, o)}\x1f{name(b, n)}".encode()).hexdigest()
                edges.append((-len(a[o] & b[n]) / len(a[o] | b[n]), tie, place(o), place(n), o, n))
    used, out = set(), set()
    for *_, o, n in sorted(edges):
        if ("o", o) not in used and ("n", n) not in used:
            used |= {("o", o), ("n", n)}
            out.add((o, n))
    return out


def test_similar_renames_until_none_is_left(spark):
    import random

    rng = random.Random(5)
    tree = lambda name, k: {f"{name}{i}": "\n".join(rng.sample("uvwxyz", rng.randint(3, 5)) if i % 3 else "uvwx") for i in range(k)}
    old, new = tree("o", 14) | {"blank": " \n\n"}, tree("n", 12) | {"empty": ""}
    frame = lambda side: spark.createDataFrame([("r", p, t) for p, t in side.items()], "repository_id string, path string, text string")
    got = [(r.old_path, r.path) for r in snapshot.match_similar_renames(frame(old), frame(new)).collect()]
    assert len(got) == len(set(got)) and set(got) == greedy(old, new)
    assert len(got) > snapshot.pair_similar_renames(frame(old), frame(new)).count()
    assert snapshot.match_similar_renames(frame({}), frame(new)).count() == 0


def test_edited_move_keeps_its_file_id_and_chunks(spark):
    fn = embed.deterministic(8)
    old = {"oven.py": "def preheat():\n    return 180\n\n\ndef bake(dough):\n    return dough\n", "same.py": "x = 1\n", "gone.py": "del y\n"}
    new = {"bakery/oven.py": old["oven.py"] + "\n\ndef rest():\n    return 5\n", "same.py": "x = 1\n", "fresh.py": "z = 3\n"}
    first = settle(full_index(files(spark, old), empty_corpus(spark), fn).corpus)
    diff = cut(diff_of(first.files, files(spark, new), files(spark, old)))
    assert {tuple(r)[1:] for r in diff.collect()} == {
        ("renamed", "bakery/oven.py", "oven.py"), ("deleted", "gone.py", None), ("added", "fresh.py", None)}
    result = incremental_index(diff, files(spark, new), first, fn)
    before = {r.symbol: (r.file_id, r.chunk_id) for r in first.chunks.filter("file_path = 'oven.py'").collect()}
    after = {r.symbol: (r.file_id, r.chunk_id) for r in result.corpus.chunks.filter("file_path = 'bakery/oven.py'").collect()}
    assert before and before.items() <= after.items() and "rest" in after
    assert {r.op for r in result.chunk_ops.filter("file_path = 'bakery/oven.py'").collect()} == {"reuse", "embed"}
    assert chunk_set(result.corpus) == chunk_set(full_index(files(spark, new), empty_corpus(spark), fn).corpus)


def read_columns(df):
    """Columns of the stored tables that a query reads."""
    import re

    return {c.split("#")[0].strip() for scan in re.findall(r"FileScan parquet \[([^\]]*)\]", df._jdf.queryExecution().executedPlan().toString()) for c in scan.split(",")}


def test_counts_read_no_texts_and_decisions_run_once(spark):
    first = settle(full_index(files(spark, A), empty_corpus(spark)).corpus)
    blobs = cut(files(spark, B))
    result = incremental_index(cut(diff_of(first.files, blobs)), blobs, first)
    # Chunking reads the stored decisions; the tables they were made from are not joined again, with texts in the rows.
    assert not set(first.files.inputFiles()) & set(result.chunk_ops.inputFiles())
    existing, produced = cut(result.corpus.chunks), cut(first.chunks)
    read = read_columns(merge_chunks(existing, produced).groupBy("repository_id").agg(F.count_if(F.col("op") == "embed")))
    assert "content_hash" in read and "content" not in read


def test_texts_joined_late_are_those_of_the_decisions(spark):
    """Paths that occur twice, with equal and with other texts, and rows without a repository."""
    first = settle(full_index(files(spark, A | {"twice.md": "# a\nb\n"}), empty_corpus(spark)).corpus)
    more = {"twice.md": "# a\nc\n", "brew.py": A["brew.py"] + "\n\ndef pour():\n    pass\n"}
    nobody = files(spark, {"free.md": "# free\n"}).withColumn("repository_id", F.lit(None).cast("string"))
    new = cut(files(spark, B).unionByName(files(spark, more)).unionByName(files(spark, {"tray.py": B["tray.py"]})).unionByName(nobody))
    decisions = cut(decide(cut(diff_of(first.files, new)), first.files, new))
    rows = lambda df: sorted(map(repr, df.collect()))
    early, late = apply_decisions(decisions, first, None), apply_decisions(decisions, first, None, blobs=new)
    assert rows(early.chunk_ops) == rows(late.chunk_ops) and rows(early.stats) == rows(late.stats)
    assert len(rows(late.chunk_ops.filter("file_path = 'tray.py'"))) > 1 and late.chunk_ops.filter("file_path = 'brew.py' AND symbol = 'pour'").count() > 0


def test_merged_chunk_without_symbol_is_the_new_one(spark):
    schema = "chunk_id string, repository_id string, file_id string, file_path string, language string, symbol string, kind string, start_line int, end_line int, content string, content_hash string, occurrence_no int"
    row = lambda symbol, line: ("c", "r", "f", "a.md", "markdown", symbol, "section", line, line, "x", "h", 0)
    got = merge_chunks(spark.createDataFrame([row("old", 1)], schema), spark.createDataFrame([row(None, 2)], schema).drop("chunk_id")).collect()
    assert [(r.op, r.chunk_id, r.symbol, r.start_line) for r in got] == [("reuse", "c", None, 2)]
