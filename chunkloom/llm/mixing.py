"""Mixing sources to target weights by entropy balancing.

The base measure is the words of every document. Document rates ``exp(sum of lambda)``, one lambda for each value of
each constrained column, are the exponential tilt that is closest to it and meets the word targets. The lambdas
minimise the convex dual ``sum(mass * exp(sum of lambda)) - sum(lambda * target)``. Its gradient and (per column)
diagonal Hessian are the same sums, so a Newton step for all values of a column is one aggregation and one join.
Sums run over cells, the distinct combinations of constrained values, which are aggregated from the documents once;
steps are damped at one and go on until every target is met.

Rates are rounded into whole copies: every document gets ``floor(rate)``; one more copy goes to as many documents of
each size class as bring the source's running total nearest to its target, from large documents to small ones, so
what rounding leaves over is about half of the smallest document. Inside a class a keyed hash decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from chunkloom.operators.skew import group_rank
from chunkloom.session import cut

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
MOST = 2.0
TOLERANCE = 1e-9
STEPS = 200
FINE = 1024      # sizes up to this are classes of their own; above, a class spans a thousandth


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_key(source: Column) -> Column:
    """A key that is never null and keeps null apart from every string."""
    return F.coalesce(F.concat(F.lit("="), source), F.lit("-"))


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(key, source_size, target) of each source of ``sizes`` (key, source, size).

    Weights repeat over the sources in code point order, null last. Targets share ``share`` of all words by weight
    and stop at ``most`` times their source; the excess goes to the others by weight. That is a water level: sources
    in order of capacity per weight are full up to the first at which the level of the rest is below its capacity.
    The window runs over one narrow row a source.
    """
    by_source = sizes.groupBy("key").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"))
    cycle = F.array(*[F.lit(w) for w in weights])
    named = Window.orderBy(F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    ordered = by_source.withColumn("weight", F.get(cycle, (F.row_number().over(named) - 1) % len(weights))).withColumn("cap", most * F.col("source_size"))
    filling = Window.orderBy(F.col("cap") / F.col("weight"), "key")
    leveled = (
        ordered.withColumn("wanted", share * F.sum("source_size").over(everything))
        .withColumn("full", F.sum("cap").over(filling) - F.col("cap"))
        .withColumn("open", F.sum("weight").over(everything) - F.sum("weight").over(filling) + F.col("weight"))
        .withColumn("level", (F.col("wanted") - F.col("full")) / F.col("open"))
    )
    # Levels after the first reached one treat a source as full that isn't, and are lower.
    reached = F.max(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))).over(everything)
    return leveled.withColumn("target", F.least("cap", F.col("weight") * reached).cast("double")).select("key", "source_size", "target")


def balance(cells: DataFrame, targets: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Lambdas (value column, lambda) of each constrained column of ``cells`` (the columns, mass).

    ``targets``: for each column a frame (the column, target). Values without mass are left out; a target of zero
    gives a lambda of minus infinity (rate zero).
    """
    cells = cut(cells.filter("mass > 0"))
    lambdas = {
        c: cut(t.join(cells.select(c).distinct(), c, "left_semi").select(
            c, "target", F.when(F.col("target") > 0, F.lit(0.0)).otherwise(F.lit(float("-inf"))).alias("lambda")))
        for c, t in targets.items()
    }
    for _ in range(STEPS):
        worst = 0.0
        for column in targets:
            tilted = cells
            for other, values in lambdas.items():
                tilted = tilted.join(values.select(other, F.col("lambda").alias(f"_l_{other}")), other)
            mass = F.col("mass")
            for other in lambdas:
                mass = mass * F.exp(F.col(f"_l_{other}"))
            sums = tilted.groupBy(column).agg(F.sum(mass).alias("g"))
            off = F.col("target") / F.col("g") - 1
            stepped = lambdas[column].join(sums, column).select(
                column, "target", F.when(F.col("g") > 0, F.col("lambda") + F.least(off, F.lit(1.0))).otherwise(F.col("lambda")).alias("lambda"),
                F.when(F.col("g") > 0, F.abs(off)).otherwise(F.lit(0.0)).alias("off"),
            )
            lambdas[column] = cut(stepped)
            worst = max(worst, lambdas[column].agg(F.max("off")).first()[0] or 0.0)
        if worst < TOLERANCE:
            break
    return {c: t.select(c, "lambda") for c, t in lambdas.items()}


def size_class(size: Column) -> Column:
    return F.when(size <= FINE, size).otherwise(FINE + F.floor(1000 * F.log(size / FINE))).cast("long")


def extra_copies(classes: DataFrame) -> DataFrame:
    """(key, class, extra): how many documents of each size class get one more copy.

    ``classes``: (key, class, n, words, part), ``part`` the fraction of the rate. The fold over the classes of a source
    runs from large to small and sees at most some thousand rows, whatever the number of documents.
    """
    gathered = classes.groupBy("key").agg(
        F.sort_array(F.collect_list(F.struct(F.col("class"), "n", "words", "part")), asc=False).alias("c")
    )

    def step(s, c):
        mean = c["words"] / c["n"]
        want = s["want"] + c["words"] * c["part"]
        extra = F.when(mean > 0, F.greatest(F.lit(0), F.least(c["n"], F.round((want - s["got"]) / mean)))).otherwise(F.lit(0)).cast("long")
        return F.struct(want.alias("want"), (s["got"] + extra * mean).alias("got"), F.concat(s["extra"], F.array(extra)).alias("extra"))

    start = F.struct(F.lit(0.0).alias("want"), F.lit(0.0).alias("got"), F.array().cast("array<bigint>").alias("extra"))
    return (
        gathered.withColumn("extra", F.aggregate("c", start, step, lambda s: s["extra"]))
        .select("key", F.explode(F.arrays_zip(F.col("c")["class"].alias("class"), "extra")).alias("x"))
        .select("key", "x.class", "x.extra")
    )


def mix(docs: DataFrame, seed: str = "mix", weights: tuple = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken) for every row of ``docs`` (doc_id, source, text).

    A null or empty text has size 0 and takes nothing. A null source is a source, the last one. Rows are taken each
    on its own, repeated ones too; which of equal rows gets the further copy changes nothing. Reruns agree: the
    order inside a size class is that of a hash of seed and doc_id.
    """
    sizes = cut(docs.select(
        docs["doc_id"], docs["source"], word_count(docs["text"]).alias("size"),
    ).withColumn("key", source_key(F.col("source"))).withColumn("class", size_class(F.col("size"))))
    targets = cut(source_targets(sizes, weights, share, most))
    mass = targets.select("key", F.col("source_size").cast("double").alias("mass"))
    rates = balance(mass, {"key": targets.select("key", "target")})["key"]
    rated = targets.join(rates, "key", "left").withColumn("rate", F.least(F.coalesce(F.exp("lambda"), F.lit(0.0)), F.lit(most))).drop("lambda")
    # A rate within the tolerance of a whole number is that number.
    whole = F.floor(F.col("rate") + 10 * TOLERANCE)
    rated = cut(rated.withColumn("whole", whole).withColumn("part", F.greatest(F.col("rate") - whole, F.lit(0.0))))
    classes = (
        sizes.groupBy("key", "class").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("words"))
        .join(rated.select("key", "part"), "key")
    )
    plan = cut(extra_copies(classes).join(rated.select("key", "source_size", "target", "whole"), "key"))
    hashed = sizes.withColumn("_u", F.sha2(F.concat_ws("\x1f", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256))
    ranked = group_rank(hashed, ["key", "class"], "_u", "_place")
    copies = F.col("whole") + F.when(F.col("_place") <= F.col("extra"), 1).otherwise(0)
    return (
        ranked.join(plan, ["key", "class"]).withColumn("copies", copies.cast("long"))
        .select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))
    )
