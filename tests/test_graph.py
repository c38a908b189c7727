import re

import duckdb
from pyspark.sql import functions as F

from chunkloom.catalog import ORACLES, QUERIES
from chunkloom.functions import import_tokens, module_stem
from chunkloom.operators import graph
from chunkloom.operators.skew import grid_join

CHUNK = "chunk_id string, repository_id string, file_id string, symbol string, kind string, content string"


def brute(rows, cap=25):
    """The definition on one repository, by regular expression."""
    targets = {}
    for r in rows:
        if r[3] and len(r[3]) >= 3:
            targets.setdefault(r[3], []).append(r[0])
    pattern = re.compile(r"\b(" + "|".join(re.escape(n) for n in sorted(targets, key=len, reverse=True)) + r")\b")
    out = set()
    for r in rows:
        near = set()
        for m in pattern.finditer(r[5]):
            if m.group(1) == r[3]:
                continue
            near |= {t for t in targets[m.group(1)] if t != r[0]}
            if len(near) >= cap:
                break
        out |= {(r[0], t) for t in near}
    return out


def edges(spark, rows):
    got = graph.reference_edges(spark.createDataFrame(rows, CHUNK)).collect()
    pairs = [(e.from_chunk_id, e.to_chunk_id) for e in got]
    assert len(pairs) == len(set(pairs))
    return set(pairs)


def test_phrases_overlap_and_caps(spark):
    rows = [
        ("a", "r", "f", "user model", "section", "the user model of user is user model-based, see model"),
        ("b", "r", "f", "user", "function", "user model and user, then user  model"),
        ("c", "r", "f", "model", "function", "a model for user model design: foo() bar and foo()x"),
        ("d", "r", "f", "foo()", "section", "user model design notes model user"),
        ("e", "r", "f", "user model design", "section", "plain words; user_model is one word, élan x"),
        ("g", "r", "f", "élan", "function", "model,user;model design"),
        ("h", "r", "f", "de", "function", "de is too short"),
        ("i", "r", "f", None, "block", "model user élan user model user model design foo()x"),
    ]
    assert edges(spark, rows) == brute(rows)
    many = [(f"t{i}", "r", "f", "alpha" if i < 30 else "beta" if i < 40 else "gamma", "function", "x") for i in range(45)]
    many += [("m1", "r", "f", None, "block", "beta gamma alpha"), ("m2", "r", "f", None, "block", "alpha beta gamma")]
    got = edges(spark, many)
    assert got == brute(many)
    assert len([p for p in got if p[0] == "m2"]) == 30 and len([p for p in got if p[0] == "m1"]) == 45


def test_imports_and_neighbours(spark):
    rows = [
        ("imp", "r", "f1", None, "import", "from service import service_call"),
        ("handle", "r", "f1", "handle_request", "function", "def handle_request(req):\n    return service_call(req)\n"),
        ("call", "r", "f2", "service_call", "function", "def service_call(req):\n    return {'ok': True}\n"),
    ]
    chunks = spark.createDataFrame(rows, CHUNK)
    files = spark.createDataFrame([("r", "f1", "controller.py"), ("r", "f2", "service.py")], "repository_id string, file_id string, path string")
    made = graph.build(chunks, files)
    got = {(e.from_chunk_id, e.to_chunk_id, e.edge_type) for e in made.collect()}
    assert got == {("imp", "call", "references"), ("handle", "call", "references"), ("imp", "call", "imports")}
    again = graph.build(chunks, files, made)
    assert {(e.from_chunk_id, e.to_chunk_id, e.edge_type) for e in again.collect()} == got
    seeds = spark.createDataFrame([("s", "r", "call")], "set_id string, repository_id string, chunk_id string")
    near = [(n.neighbour_id, n["rank"]) for n in graph.expand(seeds, made).orderBy("rank").collect()]
    assert near == [("imp", 1), ("handle", 2)]
    row = graph.stats(chunks, made).first()
    assert (row.chunks_scanned, row.references_created, row.imports_created, row.total_created) == (3, 2, 1, 3)


def test_edges_near_seeds_and_repeated_files(spark):
    rows = [(f"c{i}", "r", f"f{i}", "alpha" if i % 3 else "beta", "import", "import alpha import beta, 'x/alpha//'" if i % 2 else 'from\t pkg.beta import "a b"') for i in range(12)]
    chunks = spark.createDataFrame(rows + rows[:2], CHUNK)
    files = spark.createDataFrame([("r", r[2], f"src/{r[3]}.md") for r in rows], "repository_id string, file_id string, path string")
    seeds = spark.createDataFrame([("s", "r", "c1"), ("s", "r", "c6")], "set_id string, repository_id string, chunk_id string")
    near = graph.references_near(chunks)(seeds)
    every = graph.reference_edges(chunks).collect()
    assert {tuple(e) for e in near.collect()} == {tuple(e) for e in every if {e.from_chunk_id, e.to_chunk_id} & {"c1", "c6"}}
    take = lambda edges: sorted(map(tuple, graph.expand(seeds, edges, None).select("neighbour_id", "rank").collect()))
    assert take(near) == take(graph.reference_edges(chunks)) != []
    imports = {(e.from_chunk_id, e.to_chunk_id) for e in graph.import_edges(chunks, files).collect()}
    named = {"alpha": [r[0] for r in rows if r[3] == "alpha"], "beta": [r[0] for r in rows if r[3] == "beta"]}
    wanted = {(r[0], t) for i, r in enumerate(rows) for n in (("alpha", "beta") if i % 2 else ("beta",)) for t in named[n] if t != r[0]}
    assert imports == wanted


def pairs_by_rule(rows, files):
    """Capped reference and import edges (cap 5) of rows that may share an id, by chunk id: names in order of their first position."""
    def kept(tokens_of, targets, own):
        first = {}
        for r in rows:
            for pos, name in enumerate(tokens_of(r[5])):
                if name in targets and name not in own(r[0]):
                    first[r[0], name] = min(pos, first.get((r[0], name), pos))
        out, taken = [], {}
        for (chunk, name), _ in sorted(first.items(), key=lambda x: x[1]):
            if taken.get(chunk, 0) < 5:
                out += [(chunk, t) for t in targets[name]]
            taken[chunk] = taken.get(chunk, 0) + sizes[name]
        return out

    symbols, stems = {}, {}
    for r in rows:
        symbols.setdefault(r[3], []).append(r[0])
    sizes = {n: len(t) for n, t in symbols.items()}
    owned = lambda c: {r[3] for r in rows if r[0] == c} if c is not None else ()
    references = kept(lambda t: re.findall(r"\w+|\W+", t), symbols, owned)
    for file, stem in files:
        stems.setdefault(stem, []).extend(r[0] for r in rows if r[2] == file)
    sizes = {n: sum(s == n for _, s in files) for n in stems}
    imports = kept(lambda t: re.findall(r"import (\w+)", t), stems, lambda c: ())
    return references, [(a, b) for a, b in imports if a is not None and b is not None and a != b]


def test_counted_edges_are_the_edges_of_texts_begun_and_read_whole(spark, monkeypatch):
    names = ["alpha", "beta", "gamma", "delta", "omega", "sigma"]
    # No two rows of one id have names at one position.
    word = lambda i, k: names[(i + k * k) % 6] if (i + k) % 7 == 0 else f"w{(i * 31 + k) % 17}x"
    rows = [
        (None if i % 13 == 5 else f"c{i - i % 9 if i % 11 == 3 else i}", "r", f"f{i % 20}", names[i % 6] if i < 15 else f"name{i}", "import",
         " ".join(f"import {word(i, k)}" for k in range(1 + i * 7 % 40)))
        for i in range(60)
    ]
    files = sorted({(r[2], r[3]) for r in rows[::2]})
    chunks = spark.createDataFrame(rows, CHUNK)
    table = spark.createDataFrame([("r", f, f"src/{s}.py") for f, s in files], "repository_id string, file_id string, path string")
    references, imports = pairs_by_rule(rows, files)
    pairs = lambda edges: sorted((str(e.from_chunk_id), str(e.to_chunk_id)) for e in edges.collect())
    small = graph.is_small
    ways = [small, lambda df: "name" not in df.columns and small(df), lambda df: False]  # names, only their hashes, or nothing is broadcast
    for tokens, is_small in [(1000, ways[0]), (4, ways[1]), (4, ways[2]), (4, ways[0])]:
        monkeypatch.setattr(graph, "FIRST_TOKENS", tokens)
        monkeypatch.setattr(graph, "is_small", is_small)
        counted = graph.reference_edges(chunks, 5, counted=True).unionByName(graph.import_edges(chunks, table, 5, counted=True))
        row = graph.stats(chunks, counted).first()
        assert (row.chunks_scanned, row.references_created, row.imports_created) == (60, len(references), len(imports))
    assert pairs(graph.reference_edges(chunks, 5)) == sorted((str(a), str(b)) for a, b in references)
    assert pairs(graph.import_edges(chunks, table, 5)) == sorted((str(a), str(b)) for a, b in imports)


def test_import_edges_query_keeps_every_partner(spark, tmp_path, monkeypatch):
    texts = [f"alpha beta w{i}" for i in range(30)] + [f"beta alpha 'x' alpha w{i}" for i in range(10)] + ["gamma beta alpha", "__init__ alpha", None]
    rows = [(i, t, "s", "en", 0) for i, t in enumerate(texts)] + [(50, "alpha", None, "en", 0), (51, "alpha", "other", "en", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    columns = "repository_id, from_chunk_id, to_chunk_id, edge_type"
    want = sorted(con.execute(f"SELECT {columns} FROM ({ORACLES['import_edges']})").fetchall())
    assert len([t for _, f, t, _ in want if f == 0]) == 39 and "taken" not in ORACLES["import_edges"]  # alpha alone meets a cap of 25
    small = graph.is_small
    for is_small in (small, lambda df: "to_chunk_id" not in df.columns and small(df)):
        monkeypatch.setattr(graph, "is_small", is_small)
        assert sorted(map(tuple, QUERIES["import_edges"](spark, str(tmp_path)).select(*columns.split(", ")).collect())) == want


def test_grid_join_gives_the_pairs_of_hot_keys_once(spark, tmp_path):
    table = lambda n, name: spark.range(n).select((F.col("id") % 7 % 3 % 2).alias("k"), F.col("id").alias(name))
    left, right = table(200, "a"), table(90, "b")
    got = grid_join(left, right, ["k"], "a", "b", rows=10).select("k", "a", "b")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, left.join(right, "k").select("k", "a", "b").collect()))


def test_import_tokens_and_stems(spark):
    text = "from\t\n a.b.c import x.y 'q r/s//' \"t.u/\n\" import .. from é_1 'v"
    row = spark.createDataFrame([(text,)], "t string").select(import_tokens("t").alias("k")).select("k", F.transform("k", module_stem).alias("s")).first()
    assert row.k == ["a.b.c", "x.y", "q r/s//", "t.u/\n", "..", "é_1"]
    assert row.s == ["c", "y", "s", "u", "", "é_1"]
