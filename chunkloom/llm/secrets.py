"""Secret scan: base patterns, and sliding-window Shannon entropy over candidate strings.

All work is column expressions over one text in one row; nothing is shuffled. Offsets of matches are sums of the
lengths of the pieces between them, in code points.

The entropy part looks at candidate strings: runs of 20 or more letters, digits and ``+/_-``. A candidate is of the
narrowest character class that holds all of it; upper and lower case are classes of their own, and each class has its
own alphabet and threshold. A window of ``WINDOW`` characters slides over it; the counts of the alphabet are kept from
step to step, one character entering and one leaving, and with them the sum of ``c * log2(c)``, which gives the
window's entropy. Windows that reach the threshold are joined to one span.

The allow-list works on the parts of a candidate between ``/``, ``_`` and ``-``: words, camel-case words, short
numbers, placeholders, and UUIDs. A window of which more than half lies in such parts is suppressed, so a path or a
prefix hides no key beside it. No pattern repeats a group, so a match needs no stack, however long the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

WINDOW = 20
# Fixed patterns of the base kinds, in the order in which spans at one place are listed.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"       # AKIA[A-Z0-9]+ of 18 characters or more: a shorter run holds no longer match
HEX = r"[0-9a-f]{16,}"              # [0-9a-f]+ of 16 characters or more, by the same reason
ASSIGN_LEAST = 12
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}"
KINDS = ("assign", "access", "hex", "entropy")
# Character classes from narrow to wide: name, alphabet, pattern of the whole candidate, bits.
DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
CLASSES = (
    ("hex", DIGITS + "abcdef", "^[0-9a-f]+$", 3.0), ("upper hex", DIGITS + "ABCDEF", "^[0-9A-F]+$", 3.0),
    ("lower", LOWER, "^[a-z]+$", 3.8), ("upper", UPPER, "^[A-Z]+$", 3.8),
    ("lower36", DIGITS + LOWER, "^[0-9a-z]+$", 3.6), ("upper36", DIGITS + UPPER, "^[0-9A-Z]+$", 3.6),
    ("letters", LOWER + UPPER, "^[A-Za-z]+$", 3.7), ("base62", DIGITS + LOWER + UPPER, "^[0-9A-Za-z]+$", 3.7),
    ("base64", DIGITS + LOWER + UPPER + "+/_-", "^[0-9A-Za-z+/_-]+$", 3.7),
)
# Parts of candidates that are no secrets: what a hump of a camel-case part may be, numbers and versions, placeholders.
SEPARATOR = "[/_-]"
HUMP = "(?<=[a-z0-9])(?=[A-Z])"
WORD = "^[A-Z]?[a-z]{2,24}[0-9]{0,4}$|^[A-Z]{1,12}[0-9]{0,4}$|^[a-z]?[0-9]{0,4}$"
NUMBER = "^v?[0-9]+$"
PLACEHOLDER = "(?i)example|sample|dummy|placeholder|xxxx"
UUID = "[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"


def _spans(text: Column, pattern: str, kind: int, keep=None) -> Column:
    """Spans (start, kind, stop, value) of the leftmost non-overlapping matches; ``keep`` drops by group 2."""
    regex = F.lit(pattern)
    found = F.regexp_extract_all(text, regex, F.lit(0))
    pieces = F.transform(F.split(text, pattern, -1), lambda p: F.length(p))
    row = lambda at, m, ok: F.struct(
        at.alias("start"), F.lit(kind).alias("kind"), (at + F.length(m)).alias("stop"), m.alias("value"), ok.alias("ok")
    )
    ok = F.transform(F.regexp_extract_all(text, regex, F.lit(2)), keep) if keep else F.transform(found, lambda m: F.lit(True))
    zipped = F.arrays_zip(found.alias("m"), F.slice(pieces, F.lit(1), F.size(found)).alias("gap"), ok.alias("ok"))
    none = F.array().cast("array<struct<start:int,kind:int,stop:int,value:string,ok:boolean>>")
    folded = F.aggregate(
        zipped, F.struct(F.lit(0).alias("at"), none.alias("out")),
        lambda s, x: F.struct(
            (s["at"] + x["gap"] + F.length(x["m"])).alias("at"),
            F.concat(s["out"], F.array(row(s["at"] + x["gap"], x["m"], x["ok"]))).alias("out"),
        ),
        lambda s: F.filter(s["out"], lambda x: x["ok"]),
    )
    return F.when(text.rlike(pattern), folded).otherwise(none)


def _xlog(count: Column) -> Column:
    return F.when(count > 0, count * F.log2(count)).otherwise(F.lit(0.0))


def _known(value: Column) -> Column:
    """For each character of a candidate whether it is in an allowed part or between parts."""
    def allowed(part):
        words = F.forall(F.split(part, HUMP, -1), lambda hump: hump.rlike(WORD))
        return words | part.rlike(NUMBER) | part.rlike(PLACEHOLDER)

    # A UUID becomes as many separators.
    parts = F.split(F.regexp_replace(value, UUID, "-" * 36), SEPARATOR, -1)
    marked = F.transform(parts, lambda p: F.repeat(F.when(allowed(p), F.lit("1")).otherwise(F.lit("0")), F.length(p)))
    return F.array_join(marked, "1")


def _windows(value: Column, known: Column, alphabet: str, bits: float) -> Column:
    """(first, last): hull of the windows of ``value`` whose entropy reaches ``bits``; null without any."""
    size = len(alphabet)
    # Characters by position once; a substring at a position would be searched from the start each time.
    codes = F.transform(F.split(value, ""), lambda c: F.instr(F.lit(alphabet), c))
    marks = F.transform(F.split(known, ""), lambda c: (c == "1").cast("int"))
    pairs = F.arrays_zip(codes.alias("code"), marks.alias("known"))
    # What enters at a step, and what leaves WINDOW steps later.
    before = F.array_repeat(F.struct(F.lit(0).alias("code"), F.lit(0).alias("known")), WINDOW)
    steps = F.arrays_zip(pairs.alias("inn"), F.slice(F.concat(before, pairs), F.lit(1), F.size(pairs)).alias("out"))
    at = lambda counts, k: F.coalesce(F.get(counts, k - 1), F.lit(0))

    def step(s, x):
        inn, out, i = x["inn"]["code"], x["out"]["code"], s["i"] + 1
        entering = at(s["counts"], inn)
        # When the same character enters and leaves, nothing changes.
        leaving = at(s["counts"], out)
        moved = F.when(inn == out, s["sum"]).otherwise(
            s["sum"] + _xlog(entering + 1) - _xlog(entering) + F.when(out > 0, _xlog(leaving - 1) - _xlog(leaving)).otherwise(F.lit(0.0))
        )
        counts = F.when(inn == out, s["counts"]).otherwise(
            F.transform(s["counts"], lambda c, k: c + F.when(k == inn - 1, 1).when(k == out - 1, -1).otherwise(0))
        )
        calm = s["known"] + x["inn"]["known"] - x["out"]["known"]
        high = (i >= WINDOW) & (2 * calm <= WINDOW) & (F.log2(F.lit(float(WINDOW))) - moved / WINDOW >= bits - 1e-9)
        return F.struct(
            i.alias("i"), counts.alias("counts"), moved.alias("sum"), calm.alias("known"),
            F.when(high, F.coalesce(s["first"], i - WINDOW)).otherwise(s["first"]).alias("first"),
            F.when(high, i).otherwise(s["last"]).alias("last"),
        )

    start = F.struct(
        F.lit(0).alias("i"), F.array_repeat(F.lit(0), size).alias("counts"), F.lit(0.0).alias("sum"), F.lit(0).alias("known"),
        F.lit(None).cast("int").alias("first"), F.lit(None).cast("int").alias("last"),
    )
    return F.aggregate(steps, start, step, lambda s: F.struct(s["first"].alias("first"), s["last"].alias("last")))


def _entropy(text: Column) -> Column:
    """Spans of high entropy in candidates, but for windows that lie in allowed parts."""
    def measured(c):
        hull = F.lit(None).cast("struct<first:int,last:int>")
        for _, alphabet, pattern, bits in reversed(CLASSES):
            hull = F.when(c["value"].rlike(pattern), _windows(c["value"], c["known"], alphabet, bits)).otherwise(hull)
        return F.transform(F.array(hull), lambda h: F.struct(
            (c["start"] + h["first"]).alias("start"), c["kind"].alias("kind"), (c["start"] + h["last"]).alias("stop"),
            c["value"].alias("value"), c["ok"].alias("ok"),
        ))[0]

    marked = F.transform(_spans(text, CANDIDATE, len(KINDS)), lambda c: F.struct(
        *[c[f].alias(f) for f in ("start", "kind", "stop", "value", "ok")], _known(c["value"]).alias("known")
    ))
    candidates = F.filter(marked, lambda c: c["known"].contains("0"))
    return F.filter(F.transform(candidates, measured), lambda x: x["start"].isNotNull())


def _shown(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(
        F.array_sort(spans), lambda x: F.concat_ws(":", F.get(names, x["kind"] - 1), x["start"].cast("string"), x["stop"].cast("string"))
    ), ",")


def scan(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` columns of every row with n_assign, n_access, n_hex, n_entropy, base_sha256 and ``spans``.

    Spans are ``kind:start:end`` in code points, end exclusive, by start and then kind. Entropy spans that lie
    inside a base span are left out. A null or empty text has no spans; repeated rows are scanned each.
    """
    text = F.coalesce(F.col("_text"), F.lit(""))
    base = (
        docs.select(*[docs[f"`{c}`"] for c in keep], docs["text"].alias("_text"))
        .withColumn("_assign", _spans(text, ASSIGN, 1, lambda v: F.length(v) >= ASSIGN_LEAST))
        .withColumn("_access", _spans(text, ACCESS, 2)).withColumn("_hex", _spans(text, HEX, 3))
        .withColumn("_entropy", _entropy(text)).drop("_text")
        .withColumn("_base", F.concat("_assign", "_access", "_hex"))
        .withColumn("_entropy", F.filter("_entropy", lambda e: ~F.exists("_base", lambda b: (b["start"] <= e["start"]) & (e["stop"] <= b["stop"]))))
    )
    return base.select(
        *[F.col(f"`{c}`") for c in keep],
        *[F.size(f"_{k}").cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(_shown(F.col("_base")), 256).alias("base_sha256"),
        _shown(F.concat("_base", "_entropy")).alias("spans"),
    )
