import numpy as np
import pytest

from chunkloom.operators import bm25, dense, graph, ivf

VECTOR = "repository_id string, chunk_id long, embedding array<float>"
QUERY = "repository_id string, query_id long, embedding array<float>"


@pytest.fixture(scope="module")
def clustered(spark):
    """3000 vectors around 40 directions, two thirds of them in one repository, and 60 queries near some of them."""
    rng = np.random.default_rng(3)
    middle = rng.normal(size=(40, 24))
    rows = [("hot" if i % 3 else "cold", i, [float(x) for x in middle[rng.integers(40)] + 0.35 * rng.normal(size=24)]) for i in range(3000)]
    asked = [("hot" if i % 2 else "cold", i, [float(x) for x in np.array(rows[i * 7][2]) + 0.1 * rng.normal(size=24)]) for i in range(60)]
    return spark.createDataFrame(rows, VECTOR).repartition(5), spark.createDataFrame(asked, QUERY)


def found(df):
    return {(r.repository_id, r.query_id, r.chunk_id): r.dense_score for r in df.collect()}


def test_few_pairs_are_scored_and_most_neighbours_found(spark, clustered, monkeypatch):
    vectors, queries = clustered
    index = ivf.build(vectors, queries)
    exact, near = found(dense.knn(queries, vectors, 20)), found(ivf.search(queries, index, 20))
    both = exact.keys() & near.keys()
    assert len(both) >= 0.9 * len(exact) and all(exact[h] == near[h] for h in both)
    scored = ivf.scored_pairs(queries, index).groupBy().sum("scored", "pairs").first()
    assert 0 < scored[0] < 0.2 * scored[1] and scored[1] == 30 * 3000
    # Cells of a few rows give the same hits.
    monkeypatch.setattr(dense, "VECTORS_PER_CELL", 15)
    monkeypatch.setattr(dense, "QUERIES_PER_CELL", 4)
    assert found(ivf.search(queries, index, 20)) == near


def test_all_lists_are_the_exact_search(spark, clustered):
    vectors, queries = clustered
    index = ivf.build(vectors, lists=9, probes=9)
    assert index.lists.count() == 3000 and index.lists.select("list").distinct().count() <= 9
    assert found(ivf.search(queries, index, 7)) == found(dense.knn(queries, vectors, 7))
    more = [ivf.scored_pairs(queries, index, p).groupBy().sum("scored").first()[0] for p in (1, 3, 9)]
    assert more[0] < more[1] < more[2] == 30 * 3000


def test_probes_are_the_least_that_reach_the_target(spark, clustered):
    vectors, queries = clustered
    index = ivf.build(vectors, queries, lists=30, target=0.9)
    exact = set(found(dense.knn(queries, vectors, 20)))

    def recall(probes):
        return len(exact & set(found(ivf.search(queries, index, 20, probes)))) / len(exact)

    assert recall(index.probes) >= 0.9 and (index.probes == 1 or recall(index.probes - 1) < 0.9)


def test_edge_cases(spark):
    rows = [("r", 1, [1.0, 0.0]), ("r", 1, [1.0, 0.0]), ("r", 2, [0.0, 0.0]), ("r", 3, None), ("r", 4, []), ("s", 5, [0.0, 1.0]), (None, 6, [1.0, 1.0])]
    vectors = spark.createDataFrame(rows, VECTOR)
    queries = spark.createDataFrame([("r", 1, [2.0, 0.0]), ("none", 2, [1.0, 0.0]), ("r", 3, None), ("s", 4, [0.0, 0.0])], QUERY)
    index = ivf.build(vectors, lists=2, probes=2)
    assert sorted((r.query_id, r.chunk_id, r["rank"], r.dense_score) for r in ivf.search(queries, index, None).collect()) == [
        (1, 1, 1, 1.0), (1, 1, 2, 1.0), (1, 2, 3, 0.0), (4, 5, 1, 0.0)]
    assert ivf.search(queries, ivf.build(vectors.limit(0)), 5).collect() == []
    assert ivf.search(queries.limit(0), index, 5).collect() == []
    with pytest.raises(ValueError):
        ivf.build(vectors.unionByName(spark.createDataFrame([("r", 9, [1.0])], VECTOR)))


def test_training_fills_every_list():
    sample = np.repeat(np.eye(3), [50, 3, 1], axis=0)
    lists = ivf.train(sample, 3)
    assert sorted(map(tuple, lists.round(9).tolist())) == sorted(map(tuple, np.eye(3).tolist()))
    assert ivf.list_count(10**12, 768) * 768 * 8 <= ivf.BROADCAST_BYTES and ivf.list_count(1, 8) == 1


def test_none_cuts_nothing(spark, clustered):
    vectors, queries = clustered
    assert dense.knn(queries, vectors, None).count() == 30 * 3000 == dense.knn(queries, vectors, 3000).count()
    chunks = spark.createDataFrame([("r", str(i), f"alpha w{i} " + "beta " * (i % 3)) for i in range(60)] + [("r", f"z{i}", "filler") for i in range(200)], "repository_id string, chunk_id string, content string")
    asked = spark.createDataFrame([("r", "q", "alpha")], "repository_id string, query_id string, query string")
    assert bm25.search(asked, chunks, None).count() == 60
    edges = spark.createDataFrame([("r", "a", f"n{i}", "imports") for i in range(40)], "repository_id string, from_chunk_id string, to_chunk_id string, edge_type string")
    seeds = spark.createDataFrame([("s", "r", "a")], "set_id string, repository_id string, chunk_id string")
    assert graph.expand(seeds, edges, None).count() == 40 and graph.expand(seeds, edges).count() == 20
