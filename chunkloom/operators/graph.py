"""Reference graph over chunks: symbol mentions, imports and one-hop neighbours.

A mention is a symbol name between word boundaries, longest name first, matches not overlapping.
Text and symbols are cut into alternating word and separator pieces; a name matches exactly where
its pieces equal a run of the text's pieces, so matching is equi-joins on pieces instead of one
alternation over every symbol of a repository.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from chunkloom.functions import import_tokens, module_stem, path_stem
from chunkloom.operators.skew import grid_join
from chunkloom.schemas import EDGE_CAP, MIN_SYMBOL_LENGTH, NEIGHBOUR_CAP
from chunkloom.session import cut, is_small, spread

# Word and separator pieces, in a form Java and RE2 read alike.
WORD = r"[\p{L}\p{N}_]+"
PIECES = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_]+"
# Tokens of a text that are looked up first; most texts meet the edge cap within them, the others are looked up whole.
FIRST_TOKENS = 256


def pieces(text: Column | str) -> Column:
    return F.regexp_extract_all(F.col(text) if isinstance(text, str) else text, F.lit(PIECES), F.lit(0))


def _names(chunks: DataFrame) -> DataFrame:
    """Distinct names per repository with the number of chunks that define each."""
    return (
        chunks.filter(F.length("symbol") >= MIN_SYMBOL_LENGTH)
        .groupBy("repository_id", F.col("symbol").alias("name")).agg(F.count(F.lit(1)).alias("n_targets"))
        .withColumn("_pieces", pieces("name")).withColumn("n_pieces", F.size("_pieces"))
    )


def _known(words: DataFrame, names: DataFrame, keys: list[str]) -> DataFrame:
    """Words that are names, with the columns of the stored table of names; others are dropped before a shuffle.

    Names that measure small are broadcast. Of more names only hashes are, and the words that have one are joined by a
    shuffle; where the hashes measure large too (two million names), all words are shuffled.
    """
    if is_small(names):
        return words.join(F.broadcast(names), keys)
    marks = names.select(F.xxhash64(*keys).alias("_mark"))
    if is_small(marks):
        words = words.withColumn("_mark", F.xxhash64(*keys)).join(F.broadcast(marks), "_mark", "left_semi").drop("_mark")
    return words.join(names, keys)


def _words(texts: DataFrame, width: int | None = None) -> DataFrame:
    """Pieces of texts that are long enough for a name, with their position (only the first ``width`` of a text).

    The outer form keeps the optimizer from cutting texts again to test for empty arrays.
    """
    cut_up = pieces("content") if width is None else F.slice(pieces("content"), 1, width)
    return spread(texts.select("repository_id", "chunk_id", "content")).select(
        "repository_id", "chunk_id", F.posexplode_outer(cut_up).alias("pos", "name")
    ).filter(F.length("name") >= MIN_SYMBOL_LENGTH)


def _word_mentions(chunks: DataFrame, names: DataFrame) -> DataFrame:
    """Mentions of one-word names: positions per (chunk, name), collected within one chunk's text."""
    single = names.filter("n_pieces = 1").select("repository_id", "name", "n_targets")
    kept = ["repository_id", "chunk_id", "name"]
    positions = [F.min("pos").alias("first"), F.collect_list("pos").alias("positions")]
    return _known(_words(chunks), single, ["repository_id", "name"]).groupBy(*kept, "n_targets").agg(*positions)


def _phrase_mentions(chunks: DataFrame, names: DataFrame) -> DataFrame:
    """Mentions of names of several pieces, leftmost and longest first, without overlap.

    Text positions are first joined to the distinct three-piece (or two-piece) openings of names,
    which carry only the lengths that occur; then the runs of those lengths are joined to names.
    """
    several = names.filter("n_pieces > 1")
    opening = lambda p, i: F.array_join(F.slice(p, i, 3), "")
    openings = (several.groupBy("repository_id", opening(F.col("_pieces"), 1).alias("opening")).agg(
        F.collect_set("n_pieces").alias("lengths")
    ))
    two = (several.filter("n_pieces = 2").select("repository_id", F.col("name").alias("pair")))
    starts = spread(chunks.select("repository_id", "chunk_id", "content")).select("repository_id", "chunk_id", pieces("content").alias("_p")).select(
        "repository_id", "chunk_id",
        F.explode(
            F.transform("_p", lambda p, i: F.struct(
                (i + 1).alias("pos"),
                opening(F.col("_p"), i + 1).alias("opening"),
                F.array_join(F.slice(F.col("_p"), i + 1, 2), "").alias("pair"),
            ))
        ).alias("s"),
    ).select("repository_id", "chunk_id", "s.*")
    hit3 = starts.join(openings, ["repository_id", "opening"]).select("repository_id", "chunk_id", "pos", "lengths")
    hit2 = starts.join(two, ["repository_id", "pair"]).select(
        "repository_id", "chunk_id", "pos", F.array(F.lit(2)).alias("lengths")
    )
    runs = hit3.unionByName(hit2).select("repository_id", "chunk_id", "pos", F.explode("lengths").alias("n")).distinct()
    per_chunk = runs.groupBy("repository_id", "chunk_id").agg(F.collect_list(F.struct("pos", "n")).alias("_runs"))
    texts = chunks.select("repository_id", "chunk_id", pieces("content").alias("_p")).join(
        per_chunk, ["repository_id", "chunk_id"]
    )
    found = texts.select(
        "repository_id", "chunk_id",
        F.explode(F.transform("_runs", lambda r: F.struct(
            r["pos"].alias("pos"), r["n"].alias("n"), F.array_join(F.slice(F.col("_p"), r["pos"], r["n"]), "").alias("name"),
        ))).alias("m"),
    ).select("repository_id", "chunk_id", "m.*")
    known = several.select("repository_id", "name", F.col("n_pieces").alias("n"), "n_targets")
    matches = found.join(known, ["repository_id", "name", "n"])
    ordered = matches.groupBy("repository_id", "chunk_id").agg(
        F.array_sort(F.collect_list(F.struct("pos", (-F.col("n")).alias("minus_n"), "name", "n_targets"))).alias("_m")
    )
    entry = "struct<pos:int,n:int,name:string,n_targets:bigint>"
    zero = F.struct(F.lit(0).alias("free"), F.array().cast(f"array<{entry}>").alias("out"))

    def take(acc: Column, m: Column) -> Column:
        kept = F.struct(m["pos"].cast("int").alias("pos"), (-m["minus_n"]).cast("int").alias("n"), m["name"].alias("name"), m["n_targets"].alias("n_targets"))
        return F.when(
            m["pos"] > acc["free"],
            F.struct((m["pos"] - m["minus_n"] - 1).cast("int").alias("free"), F.concat(acc["out"], F.array(kept)).alias("out")),
        ).otherwise(acc)

    return ordered.select(
        "repository_id", "chunk_id", F.aggregate("_m", zero, take, lambda acc: acc["out"]).alias("taken")
    )


def _capped(rows: DataFrame, owner: list[str], cap: int | None) -> DataFrame:
    """Names in text order (all with None) until at least ``cap`` targets were taken *before* the next name.

    A name's targets are never split. The window runs inside one chunk.
    """
    if cap is None:
        return rows
    before = Window.partitionBy(*owner).orderBy("first").rowsBetween(Window.unboundedPreceding, -1)
    taken = F.coalesce(F.sum("n_targets").over(before), F.lit(0))
    return rows.withColumn("_taken", taken).filter(F.col("_taken") < cap).drop("_taken")


def _taken(texts: DataFrame, words: Callable[[DataFrame, int | None], DataFrame], names: DataFrame, cap: int, width: int | None) -> DataFrame:
    """Names that :func:`_capped` keeps of the first ``width`` words (all with None), and whether a text is ``open``.

    A text is open if words are left that were not looked up and the cap is not met. All rows of a chunk meet in one
    shuffle: its mentions, and a row of each text with its length and the name that is no mention there.
    """
    owner = ["repository_id", "chunk_id"]
    mentions = _known(words(texts, width), names, ["repository_id", "name"]).select(
        *owner, "name", "pos", "n_targets", F.lit(False).alias("own"), F.lit(0).alias("length")
    )
    heads = texts.select(
        *owner, F.when(F.col("chunk_id").isNotNull(), F.col("own")).alias("name"), F.lit(None).cast("int").alias("pos"),
        F.lit(None).cast("bigint").alias("n_targets"), F.lit(True).alias("own"), F.length("content").alias("length"),
    )
    rows = mentions.unionByName(heads).repartition(*owner).groupBy(*owner, "name").agg(
        F.min("pos").alias("first"), F.max("n_targets").alias("n"), F.max("own").alias("own"), F.max("length").alias("length")
    ).withColumn("n_targets", F.when(~F.col("own"), F.col("n")))
    whole = Window.partitionBy(*owner)
    before = whole.orderBy("first").rowsBetween(Window.unboundedPreceding, -1)
    nothing = lambda c: F.coalesce(c, F.lit(0))
    left = F.lit(False) if width is None else (F.max("length").over(whole) > width) & (nothing(F.sum("n_targets").over(whole)) < cap)
    return rows.select(
        *owner, "name", "first", "n_targets", left.alias("open"), nothing(F.sum("n_targets").over(before)).alias("_taken")
    ).filter(F.col("open") | F.col("n_targets").isNotNull() & (F.col("_taken") < cap)).drop("_taken")


def _first_names(texts: DataFrame, words: Callable[[DataFrame, int | None], DataFrame], names: DataFrame, cap: int) -> DataFrame:
    """Names of each chunk in text order as :func:`_capped` keeps them, without a look at all words of all texts.

    ``texts``: repository_id, chunk_id, content, own (a name that is no mention there). What precedes a name decides on
    it, so the beginning of a text is enough once the names in it meet the cap; the texts that are open then are looked up whole.
    """
    columns = ["repository_id", "chunk_id", "name", "first", "n_targets"]
    begun = cut(_taken(texts, words, names, cap, FIRST_TOKENS))
    todo = begun.filter("open").select("repository_id", "chunk_id").distinct()
    if todo.isEmpty():
        return begun.select(*columns)
    if not is_small(todo):
        return _taken(texts, words, names, cap, None).select(*columns)
    here = (texts["repository_id"] == todo["repository_id"]) & texts["chunk_id"].eqNullSafe(todo["chunk_id"])
    rest = _taken(texts.join(F.broadcast(todo), here, "left_semi"), words, names, cap, None)
    return begun.filter("NOT open").select(*columns).unionByName(rest.select(*columns))


def reference_names(chunks: DataFrame, edge_cap: int | None = EDGE_CAP) -> DataFrame:
    """Kept mentions (repository_id, chunk_id, name): the edge table before it is multiplied out.

    Names of a chunk are kept until ``edge_cap`` edges, all with None. A name with m mentions and d definitions is m
    rows here and m x d edges; jobs that only need the relation can keep this form and the definitions apart.
    """
    return _reference_names(chunks, edge_cap).select("repository_id", "chunk_id", "name")


def _reference_names(chunks: DataFrame, edge_cap: int | None) -> DataFrame:
    """:func:`reference_names` with the number of chunks that define a name."""
    names = cut(_names(chunks))
    columns = ["repository_id", "chunk_id", "name", "first", "n_targets"]
    phrases = not names.filter("n_pieces > 1").isEmpty()
    if not phrases and edge_cap is not None:
        texts = chunks.select("repository_id", "chunk_id", "content", F.col("symbol").alias("own"))
        return _first_names(texts, _words, names.select("repository_id", "name", "n_targets"), edge_cap)
    words = _word_mentions(chunks, names)
    if not phrases:
        mentions = words.select(*columns)
    else:
        taken = cut(_phrase_mentions(chunks, names))
        # A word covered by a longer match is no mention of its own. posexplode counts from 0.
        free = F.filter(
            "positions",
            lambda p: ~F.coalesce(F.exists("taken", lambda t: (p + 1 >= t["pos"]) & (p + 1 < t["pos"] + t["n"])), F.lit(False)),
        )
        single = words.join(taken, ["repository_id", "chunk_id"], "left").withColumn(
            "first", F.when(F.col("taken").isNull(), F.col("first") + 1).otherwise(F.array_min(free) + 1)
        ).filter(F.col("first").isNotNull()).select(*columns)
        phrases = taken.select("repository_id", "chunk_id", F.explode("taken").alias("t")).groupBy(
            "repository_id", "chunk_id", F.col("t.name").alias("name")
        ).agg(F.min("t.pos").alias("first"), F.max("t.n_targets").alias("n_targets"))
        mentions = single.unionByName(phrases)
    own = chunks.filter(F.col("symbol").isNotNull()).select("repository_id", "chunk_id", F.col("symbol").alias("name"))
    mentions = mentions.join(own, ["repository_id", "chunk_id", "name"], "left_anti")
    return _capped(mentions, ["repository_id", "chunk_id"], edge_cap)


def reference_edges(chunks: DataFrame, edge_cap: int | None = EDGE_CAP, counted: bool = False) -> DataFrame:
    """``references`` edges from a chunk to every chunk that defines a name it mentions.

    ``counted`` gives one row per chunk and name with ``n_edges``, the number of its edges, in place of each edge.
    """
    if counted:
        return _reference_names(chunks, edge_cap).select(
            "repository_id", F.col("chunk_id").alias("from_chunk_id"), F.lit("references").alias("edge_type"), F.col("n_targets").alias("n_edges")
        )
    return _defined(reference_names(chunks, edge_cap), _definitions(chunks))


def references_near(chunks: DataFrame, edge_cap: int | None = EDGE_CAP) -> Callable[[DataFrame], DataFrame]:
    """A function that gives the edges of :func:`reference_edges` at some chunks (repository_id, chunk_id).

    Edges grow with the square of a name's mentions and definitions. Here only the two are stored, and what a few chunks
    mention or define is multiplied out. An edge between two of the chunks is given twice.
    """
    names, definitions = cut(reference_names(chunks, edge_cap)), cut(_definitions(chunks))

    def near(seeds: DataFrame) -> DataFrame:
        seed = cut(seeds.select("repository_id", "chunk_id").distinct())
        out = names.join(seed, ["repository_id", "chunk_id"], "left_semi")
        into = definitions.join(seed.withColumnRenamed("chunk_id", "to_chunk_id"), ["repository_id", "to_chunk_id"], "left_semi")
        return _defined(out, definitions).unionByName(_defined(names, into))

    return near


def _definitions(chunks: DataFrame) -> DataFrame:
    return chunks.filter(F.length("symbol") >= MIN_SYMBOL_LENGTH).select(
        "repository_id", F.col("symbol").alias("name"), F.col("chunk_id").alias("to_chunk_id")
    )


def _defined(names: DataFrame, definitions: DataFrame) -> DataFrame:
    return names.withColumnRenamed("chunk_id", "from_chunk_id").join(definitions, ["repository_id", "name"]).select(
        "repository_id", "from_chunk_id", "to_chunk_id", F.lit("references").alias("edge_type")
    )


def _import_words(texts: DataFrame, width: int | None = None) -> DataFrame:
    """Stems of the modules that texts import, with their position (only the first ``width`` of a text)."""
    return (
        spread(texts.select("repository_id", "chunk_id", "content"))
        .select("repository_id", "chunk_id", F.posexplode_outer(import_tokens("content", width)).alias("pos", "token"))
        .filter(F.col("token").isNotNull())
        .select("repository_id", "chunk_id", "pos", module_stem("token").alias("name"))
    )


def import_edges(chunks: DataFrame, files: DataFrame, edge_cap: int | None = EDGE_CAP, counted: bool = False) -> DataFrame:
    """``imports`` edges from import chunks to every chunk of a file whose stem is imported.

    Stems of a chunk are kept until ``edge_cap`` files, all with None. Edges are the product of a stem's chunks and targets:
    few targets are broadcast, more meet the chunks in cells of bounded size, so a common stem is many tasks.
    ``counted`` gives one row per chunk and stem with ``n_edges``, the number of its edges, in place of each edge.
    """
    stems = cut(files.select("repository_id", "file_id", path_stem("path").alias("name")).filter("name <> '' AND name <> '__init__'"))
    sizes = cut(stems.groupBy("repository_id", "name").agg(F.count(F.lit(1)).alias("n_targets")))
    texts = chunks.filter((F.col("kind") == "import") & (F.length("content") > 0)).select(
        "repository_id", "chunk_id", "content", F.lit(None).cast("string").alias("own")
    )
    if edge_cap is None:
        found = _known(_import_words(texts), sizes, ["repository_id", "name"]).select("repository_id", "chunk_id", "name").distinct()
    else:
        found = _first_names(texts, _import_words, sizes, edge_cap)
    keys = ["repository_id", "name"]
    kept = found.filter(F.col("chunk_id").isNotNull()).select(*keys, F.col("chunk_id").alias("from_chunk_id"))
    # Chunks of a stem first, so that edges are multiplied out by the last join.
    targets = stems.join(chunks.select("repository_id", "file_id", F.col("chunk_id").alias("to_chunk_id")), ["repository_id", "file_id"])
    targets = cut(targets.filter(F.col("to_chunk_id").isNotNull()).select(*keys, "to_chunk_id"))
    if not counted:
        pairs = kept.join(F.broadcast(targets), keys) if is_small(targets) else grid_join(cut(kept), targets, keys, "from_chunk_id", "to_chunk_id")
        return pairs.filter(F.col("from_chunk_id") != F.col("to_chunk_id")).select(
            "repository_id", "from_chunk_id", "to_chunk_id", F.lit("imports").alias("edge_type")
        )
    # Each pair of a chunk and a target of its stem, less those of a chunk with itself.
    every = targets.groupBy("repository_id", "name").agg(F.count(F.lit(1)).alias("_every"))
    itself = targets.groupBy("repository_id", "name", F.col("to_chunk_id").alias("from_chunk_id")).agg(F.count(F.lit(1)).alias("_itself"))
    return (
        kept.join(itself, [*keys, "from_chunk_id"], "left").join(every, keys)
        .select("repository_id", "from_chunk_id", F.lit("imports").alias("edge_type"), (F.col("_every") - F.coalesce("_itself", F.lit(0))).alias("n_edges"))
    )


def stats(chunks: DataFrame, edges: DataFrame) -> DataFrame:
    """Chunks and edges of each repository; edges are rows, or counted in their column ``n_edges``."""
    scanned = chunks.groupBy("repository_id").agg(F.count(F.lit(1)).alias("chunks_scanned"))
    n_edges = F.col("n_edges") if "n_edges" in edges.columns else F.lit(1).cast("bigint")
    made = edges.groupBy("repository_id").agg(
        F.sum(F.when(F.col("edge_type") == "references", n_edges)).alias("references_created"),
        F.sum(F.when(F.col("edge_type") == "imports", n_edges)).alias("imports_created"),
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return scanned.join(made, "repository_id", "left").select(
        "repository_id", "chunks_scanned", zero("references_created").alias("references_created"),
        zero("imports_created").alias("imports_created"),
        (zero("references_created") + zero("imports_created")).alias("total_created"),
    )


def expand(seeds: DataFrame, edges: DataFrame, k: int | None = NEIGHBOUR_CAP) -> DataFrame:
    """One-hop neighbours of each seed set in either direction, at most ``k`` (all with None), seeds left out.

    ``seeds``: set_id, repository_id, chunk_id; ``edges`` is read twice, so pass a stored table.
    Neighbours are collapsed before they are ranked, and
    the order (edge type, chunk id) makes the cut deterministic.
    """
    seed = seeds.select("set_id", "repository_id", "chunk_id").distinct()
    ends = lambda a, b: edges.select(
        "repository_id", F.col(a).alias("chunk_id"), F.col(b).alias("neighbour_id"), "edge_type"
    )
    out = seed.join(ends("from_chunk_id", "to_chunk_id"), ["repository_id", "chunk_id"])
    into = seed.join(ends("to_chunk_id", "from_chunk_id"), ["repository_id", "chunk_id"])
    near = (
        out.unionByName(into).groupBy("set_id", "repository_id", "neighbour_id").agg(F.min("edge_type").alias("edge_type"))
        .join(seed.withColumnRenamed("chunk_id", "neighbour_id"), ["set_id", "repository_id", "neighbour_id"], "left_anti")
    )
    order = Window.partitionBy("set_id").orderBy("edge_type", "neighbour_id")
    ranked = near.withColumn("rank", F.row_number().over(order))
    return ranked if k is None else ranked.filter(F.col("rank") <= k)


def neighbours(seeds: DataFrame, edges: DataFrame, chunks: DataFrame, k: int | None = NEIGHBOUR_CAP) -> DataFrame:
    """Neighbour chunks as search rows with score 0."""
    near = expand(seeds, edges, k).withColumnRenamed("neighbour_id", "chunk_id")
    return chunks.join(near.select("set_id", "repository_id", "chunk_id", "rank"), ["repository_id", "chunk_id"]).withColumn(
        "score", F.lit(0.0)
    )


def build(chunks: DataFrame, files: DataFrame | None, existing: DataFrame | None = None, edge_cap: int | None = EDGE_CAP) -> DataFrame:
    """Full rebuild: the repositories of ``chunks`` lose their old edges, all others keep theirs."""
    made = reference_edges(chunks, edge_cap)
    if files is not None:
        made = made.unionByName(import_edges(chunks, files, edge_cap))
    if existing is None:
        return made
    rebuilt = chunks.select("repository_id").distinct()
    return existing.join(rebuilt, "repository_id", "left_anti").unionByName(made)

