"""Personal data: detected entities get keyed surrogates of the same type, format, gender and script.

Detection and replacement are column expressions over one text in one row. A surrogate is a function of a secret
key, the kind and the normalised entity, so an entity is replaced alike in every document (coreference) without any
shared state. Digits keep their layout, card numbers and IBANs their check digits, phones their country code, e-mail
addresses of one domain share a surrogate domain, names keep the gender of their title, their script and their case.

Names are found behind titles. The name words of a document are then looked for in all of its text, so ``Smith said``
is replaced as ``Mr. John Smith`` was. A word's gender is that of any title with a gender that it follows as a given
name in the document.

Collision check: over the table of distinct entities, two that would get one surrogate, or a surrogate that is
itself an entity of the corpus, are found by aggregation and join; the losers are keyed again with the next attempt,
and only they are looked at again. The check sees the strings that are shown: a phone's surrogate has its country code
in it. Names get one syllable more with each attempt. Numbers of a short form may have no free surrogates left: a phone
gives up its country code after ``TRIES`` attempts, and after as many more (other numbers at once) the form is left and
keyed characters are added, so the check ends after a bounded number of rounds. Only documents that hold such an entity
are joined with the table of attempts.
"""

from __future__ import annotations

import secrets
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from chunkloom.session import cut

# Titles by gender; syllables for made-up names by script; endings by script and gender.
TITLES = {
    "m": "Mr|Herr|Monsieur|Señor|Sr|Signor|Sir|господин|г-н|κύριος",
    "f": "Mrs|Ms|Miss|Frau|Madame|Mme|Señora|Sra|Signora|госпожа|г-жа|κυρία",
    "u": "Dr|Prof|Professor|Doctor|Doktor|доктор",
}
SYLLABLES = {
    "latin": "ba be bo da de do fa fe ga go ka ke ko la le lo ma me mo na ne no pa pe ra re ro sa se ta te".split(),
    "cyrillic": "ба бе бо да де до фа фе га го ка ке ко ла ле ло ма ме мо на не но па пе ра ре ро са се та те".split(),
    "greek": "βα βε βο δα δε δο φα φε γα γο κα κε κο λα λε λο μα με μο να νε νο πα πε ρα ρε ρο σα σε τα τε".split(),
}
# Given names of men, of women, of unknown gender (u), family names (n).
ENDINGS = {
    "latin": {"m": "n", "f": "na", "u": "l", "n": "sen"}, "cyrillic": {"m": "н", "f": "на", "u": "л", "n": "ко"},
    "greek": {"m": "ς", "f": "να", "u": "λ", "n": "ου"},
}
LETTER = {"latin": r"^\p{IsLatin}", "cyrillic": r"^\p{IsCyrillic}", "greek": r"^\p{IsGreek}"}
# Country codes by the digits after +: those of one and two digits; all others have three.
COUNTRY = r"^(?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3})"
TRIES = 20
SETTING = "spark.chunkloom.pii.key"
OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
GROUP = "[0-9A-Fa-f]{1,4}"
TITLE = rf"(?:(?:{'|'.join(TITLES.values())})\.? ){{1,3}}"
NAME_WORD = rf"(?!(?:{'|'.join(TITLES.values())})\b)\p{{Lu}}(?:'\p{{Lu}})?\p{{L}}+(?:-\p{{Lu}}\p{{L}}+)?"
KINDS = ("email", "iban", "ipv6", "ip", "card", "ssn", "phone", "name")
# Fixed forms of entities. Nothing but single characters is repeated without bound, so no match needs a stack.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-][A-Za-z0-9.-]*\.[A-Za-z]{2,}",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ipv6": rf"(?<![0-9A-Za-z:.])(?=[A-Fa-f:]*[0-9])(?:(?:{GROUP}:){{7}}{GROUP}|(?:{GROUP}:){{1,6}}(?::{GROUP}){{1,6}}|(?:{GROUP}:){{1,7}}:|:(?::{GROUP}){{1,7}})(?![0-9A-Za-z:])",
    "ip": rf"(?<![0-9.])(?:{OCTET}\.){{3}}{OCTET}(?!\.?[0-9])",
    "card": r"(?<![0-9])[0-9](?:[ -]?[0-9]){12,18}(?![0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "phone": r"\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)|[0-9]{1,4})(?:[ .-]?[0-9]{2,4}){2,4}(?![0-9])"
             r"|(?<![0-9+])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])",
    "name": rf"(?<![\p{{L}}]){TITLE}{NAME_WORD}(?: {NAME_WORD})?",
}
ANY = "|".join(PATTERNS[k] for k in KINDS)
MAYBE_NAME = rf"(?:{'|'.join(TITLES.values())})\.? \p{{Lu}}"
MAYBE = rf"[0-9@]|{MAYBE_NAME}"


def key_of(spark: SparkSession) -> str:
    """The secret key of the setting ``spark.chunkloom.pii.key``.

    Where it is unset, a key is drawn for this session and put there: surrogates then can't be computed by others, and
    aren't the same in another session.
    """
    given = spark.conf.get(SETTING, None)
    if not given:
        given = secrets.token_hex(32)
        spark.conf.set(SETTING, given)
    return given


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often ``use`` refers to it."""
    return F.transform(F.array(value), use)[0]


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _mod97(characters: Column) -> Column:
    """Remainder of the number that digits, and letters as 10 to 35, spell."""
    def step(rest, c):
        return F.when(c.rlike("^[0-9]$"), (rest * 10 + F.ascii(c) - 48) % 97).otherwise((rest * 100 + F.ascii(c) - 55) % 97)

    return F.aggregate(F.split(characters, ""), F.lit(0), step)


def _valid_iban(m: Column) -> Column:
    plain = F.replace(m, F.lit(" "), F.lit(""))
    return _mod97(F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.substring(plain, 1, 4))) == 1


def kind_of(m: Column) -> Column:
    """Kind of a matched string, by its shape in the order of the joint pattern; null for what only looks like an IBAN."""
    return (
        F.when(m.contains("@"), "email").when(m.rlike("^[A-Z]{2}[0-9]{2}[ A-Z0-9]+$"), F.when(_valid_iban(m), "iban"))
        .when(m.contains(":"), "ipv6").when(m.rlike(r"^\p{L}"), "name").when(m.rlike(rf"^(?:{OCTET}\.){{3}}{OCTET}$"), "ip")
        .when(m.rlike(r"^[0-9]") & (F.length(_digits(m)) >= 13), "card").when(m.rlike(r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), "ssn").otherwise("phone")
    )


def _words(m: Column) -> Column:
    """The name words of a name: behind a title, the last of two is the family name."""
    return F.split(F.regexp_replace(m, f"^{TITLE}", ""), " ")


def _script(word: Column) -> Column:
    return F.when(word.rlike(LETTER["cyrillic"]), "cyrillic").when(word.rlike(LETTER["greek"]), "greek").otherwise("latin")


def known_names(text: Column) -> Column:
    """(word, key) of every name word that a title introduces in ``text``, once each and in order."""
    def of(m):
        title = F.regexp_extract(m, f"^{TITLE}", 0)
        gender = F.when(title.rlike(rf"(?:^| )(?:{TITLES['f']})\.? "), "f").when(title.rlike(rf"(?:^| )(?:{TITLES['m']})\.? "), "m").otherwise("u")
        return _let(_words(m), lambda w: F.transform(w, lambda x, i: F.struct(x.alias("word"), F.when(i == F.size(w) - 1, "n").otherwise(gender).alias("role"))))

    none = F.array().cast("array<struct<word:string,role:string>>")
    named = F.regexp_extract_all(text, F.lit(PATTERNS["name"]), F.lit(0))
    listed = F.when(text.rlike(MAYBE_NAME), F.array_sort(F.flatten(F.transform(named, of)))).otherwise(none)
    # Of the roles of a word the first in order counts: f, m, family name, unknown.
    first = _let(listed, lambda all_: F.filter(all_, lambda x, i: (i == 0) | (F.get(all_, i - 1)["word"] != x["word"])))
    return F.transform(first, lambda x: F.struct(
        x["word"].alias("word"), F.concat(F.lit("name-"), x["role"], F.lit("-"), _script(x["word"]), F.lit(":"), F.lower(x["word"])).alias("key")
    ))


def pattern_of(names: Column) -> Column:
    """The joint pattern, with the known name words of the document wherever they stand alone."""
    words = F.array_join(F.transform(names, lambda x: x["word"]), "|")
    return F.when(F.size(names) > 0, F.concat(F.lit(ANY + r"|(?<![\p{L}])(?:"), words, F.lit(r")(?![\p{L}])"))).otherwise(F.lit(ANY))


def matches(text: Column, pattern: Column | None = None) -> Column:
    """Matched entities of a text in order."""
    none = F.array().cast("array<string>")
    pattern = pattern_of(known_names(text)) if pattern is None else pattern
    return F.when(text.rlike(MAYBE), F.regexp_extract_all(text, pattern, F.lit(0))).otherwise(none)


def keys_of(m: Column, names: Column) -> Column:
    """Normalised entities of a match: one, or one for each word of a name, as ``kind:value``; none without a kind.

    The kind of a phone written with + holds its country code, so it doesn't depend on how the digits are set apart.
    ``names`` are the known names of the document.
    """
    def of(kind):
        named = F.transform(_words(m), lambda w: F.filter(names, lambda x: x["word"] == w)[0]["key"])
        abroad = _let(_digits(m), lambda d: F.concat(F.lit("phone+"), F.regexp_extract(d, COUNTRY, 0), F.lit(":"), d))
        return (
            F.when(kind == "name", named).when(kind == "email", F.array(F.concat(F.lit("email:"), F.lower(m))))
            .when((kind == "phone") & m.startswith("+"), F.array(abroad)).when(kind == "ip", F.array(F.concat(F.lit("ip:"), m)))
            .when(kind == "ipv6", F.array(F.concat(F.lit("ipv6:"), F.lower(m))))
            .when(kind == "iban", F.array(F.concat(F.lit("iban:"), F.replace(m, F.lit(" "), F.lit("")))))
            .when(kind.isNotNull(), F.array(F.concat(kind, F.lit(":"), _digits(m)))).otherwise(F.array().cast("array<string>"))
        )

    return _let(kind_of(m), of)


def _seed(secret: str, what: Column, attempt: Column | None = None) -> Column:
    """64 keyed hex digits."""
    text = F.concat(F.lit(secret + "\x1f"), (F.lit(0) if attempt is None else attempt).cast("string"), F.lit("\x1f"), what)
    return F.sha2(F.concat(F.lit(secret + "\x1e"), F.sha2(text, 256)), 256)


def _decimal(seed: Column) -> Column:
    """60 digits, all equally likely but for one in a thousand: the last 15 of each 60 bits."""
    part = lambda i: F.lpad(F.conv(F.substring(seed, 15 * i + 1, 15), 16, 10), 19, "0")
    return F.concat(*[F.substring(part(i), 5, 15) for i in range(4)])


def _luhn(digits: Column) -> Column:
    """Sum of the Luhn check over ``digits``, whose last digit is the check digit."""
    n = F.length(digits)

    def worth(i):
        d = F.substring(digits, i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return F.when((n - i) % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.transform(F.sequence(F.lit(1), n), worth), F.lit(0), lambda s, x: s + x)


def _laid_out(m: Column, given: Column, replaced: str) -> Column:
    """``m`` with its characters of the class ``replaced`` taken in order from ``given``; what is left of it goes to the end."""
    spread = F.aggregate(
        F.split(m, ""), F.struct(F.lit("").alias("out"), F.lit(1).alias("k")),
        lambda s, c: F.struct(
            F.concat(s["out"], F.when(c.rlike(replaced), F.substring(given, s["k"], F.lit(1))).otherwise(c)).alias("out"),
            (s["k"] + F.when(c.rlike(replaced), 1).otherwise(0)).alias("k"),
        ),
    )
    return _let(spread, lambda s: F.concat(s["out"], F.substring(given, s["k"], F.length(given))))


def surrogate_key(secret: str, key: Column, attempt: Column) -> Column:
    """Normalised surrogate of a normalised entity, without its kind."""
    kind, value = F.substring_index(key, ":", 1), F.substring(key, F.instr(key, ":") + 1, F.length(key))
    n = F.length(value)

    def email(seed):
        domain = F.substring_index(value, "@", -1)
        return F.concat(
            F.lit("u"), F.substring(seed, 1, 14), F.lit("@d"), F.substring(_seed(secret, F.concat(F.lit("domain:"), domain)), 1, 10),
            F.lit(".example."), F.substring_index(domain, ".", -1),
        )

    def ip(seed):
        octet = lambda i: (F.conv(F.substring(seed, 4 * i + 1, 4), 16, 10).cast("int") % 254 + 1).cast("string")
        return F.concat_ws(".", *[octet(i) for i in range(4)])

    def phone(number):
        code = F.when(kind.startswith("phone+") & (attempt < TRIES), F.length(kind) - len("phone+")).otherwise(F.lit(0))
        return F.concat(F.substring(value, F.lit(1), code), F.substring(number, code + 1, n - code))

    def card(number):
        body = F.concat(F.substring(value, 1, 1), F.substring(number, F.lit(2), n - 2))
        checked = _let(body, lambda b: F.concat(b, ((10 - _luhn(F.concat(b, F.lit("0"))) % 10) % 10).cast("string")))
        return F.when(_luhn(value) % 10 == 0, checked).otherwise(F.concat(F.substring(value, 1, 1), F.substring(number, F.lit(2), n - 1)))

    def iban(seed):
        country = F.substring(value, 1, 2)
        letter = lambda i: F.char((F.conv(F.substring(seed, 2 * (i % 30) + 1, F.lit(4)), 16, 10).cast("int") % 26 + 65).cast("long"))
        body = F.array_join(F.transform(F.sequence(F.lit(5), n), lambda i: F.when(
            F.substring(value, i, F.lit(1)).rlike("^[0-9]$"), F.substring(_decimal(seed), i, F.lit(1))).otherwise(letter(i))), "")
        return _let(body, lambda b: F.concat(country, F.lpad((98 - _mod97(F.concat(b, country, F.lit("00")))).cast("string"), 2, "0"), b))

    def name(seed):
        script, role = F.substring_index(kind, "-", -1), F.substring(kind, 6, 1)
        tables = {s: F.array(*[F.lit(x) for x in syllables]) for s, syllables in SYLLABLES.items()}
        number = lambda text, at: F.conv(F.substring(text, at, 7), 16, 10).cast("int") % len(SYLLABLES["latin"])
        further = lambda t, i: F.get(t, number(F.sha2(F.concat(seed, F.lit("\x1f"), i.cast("string")), 256), 1))

        def made(t):
            longer = F.when(attempt > 0, F.array_join(F.transform(F.sequence(F.lit(1), attempt), lambda i: further(t, i)), "")).otherwise(F.lit(""))
            return F.concat(*[F.get(t, number(seed, 8 * i + 1)) for i in range(4)], longer)

        ending = lambda s: F.when(role == "m", ENDINGS[s]["m"]).when(role == "f", ENDINGS[s]["f"]).when(role == "u", ENDINGS[s]["u"]).otherwise(ENDINGS[s]["n"])
        by_script = lambda of: F.when(script == "cyrillic", of("cyrillic")).when(script == "greek", of("greek")).otherwise(of("latin"))
        return F.concat(_let(by_script(tables.__getitem__), made), by_script(ending))

    def of(seed):
        last = F.when(kind.startswith("phone"), F.lit(2 * TRIES)).otherwise(F.lit(TRIES))
        left = F.when(attempt >= last, F.concat(F.lit("x"), F.substring(seed, 1, 12))).otherwise(F.lit(""))
        return (
            F.when(kind.startswith("name"), name(seed)).when(kind == "email", email(seed)).otherwise(F.concat(
                F.when(kind == "ip", ip(seed)).when(kind == "ipv6", _laid_out(value, F.substring(seed, F.lit(1), F.length(F.regexp_replace(value, ":", ""))), "^[0-9a-f]$"))
                .when(kind == "iban", iban(seed)).when(kind == "card", _let(_decimal(seed), card)).when(kind == "ssn", F.substring(_decimal(seed), F.lit(1), n))
                .otherwise(_let(_decimal(seed), phone)),
                left,
            ))
        )

    return _let(_seed(secret, key, attempt), of)


def surrogate(secret: str, m: Column, names: Column, attempts: Column) -> Column:
    """Replacement of a match; ``attempts`` maps keys that were keyed again to their attempt."""
    def shown(found):
        def cased(s, w):
            return F.when((F.length(w) > 1) & (F.upper(w) == w), F.upper(s)).otherwise(F.initcap(s))

        named = F.concat(F.regexp_extract(m, f"^{TITLE}", 0), F.array_join(F.zip_with(found, _words(m), cased), " "))
        return _let(kind_of(m), lambda kind: (
            F.when(kind.isNull(), m).when(kind == "name", named).when(kind.isin("email", "ip", "ipv6"), found[0])
            .when(kind == "iban", _laid_out(m, found[0], "^[A-Z0-9]$")).otherwise(_laid_out(m, found[0], "^[0-9]$"))
        ))

    attempt = lambda k: F.coalesce(F.try_element_at(attempts, k), F.lit(0))
    return _let(F.transform(keys_of(m, names), lambda k: surrogate_key(secret, k, attempt(k))), shown)


def _shown(key: Column, value: Column) -> Column:
    """Entity or surrogate ``value`` of a key's kind. Phones are compared by all their digits, whatever their country code."""
    return F.concat(F.substring_index(F.substring_index(key, ":", 1), "+", 1), F.lit(":"), value)


def collisions(entities: DataFrame, secret: str) -> DataFrame:
    """(key, attempt) of entities that are keyed again, from all distinct ``entities`` (key).

    Two entities of a kind never share a surrogate, and no surrogate is an entity of the corpus. Each round looks at
    the losers of the round before only.
    """
    value = F.substring(F.col("key"), F.instr("key", ":") + 1, F.length("key"))
    all_ = cut(entities.select("key", _shown(F.col("key"), value).alias("real")))
    real = all_.select(F.col("real").alias("shown")).distinct()
    spark, settled, placed = entities.sparkSession, [], []
    open_ = all_.select("key")
    for attempt in range(2 * TRIES + 9):
        given = cut(open_.withColumn("shown", _shown(F.col("key"), surrogate_key(secret, F.col("key"), F.lit(attempt)))))
        first = given.groupBy("shown").agg(F.min("key").alias("key"))
        free = first.join(real, "shown", "left_anti")
        for earlier in settled:
            free = free.join(earlier.select("shown"), "shown", "left_anti")
        free = cut(free)
        settled.append(free)
        if attempt:
            placed.append(free.select("key", F.lit(attempt).alias("attempt")))
        open_ = cut(given.join(free.select("key"), "key", "left_anti").select("key"))
        if open_.isEmpty():
            out = spark.createDataFrame([], "key string, attempt int")
            for part in placed:
                out = out.unionByName(part)
            return out
    raise ValueError("surrogates that leave their form still collide")


def replace(docs: DataFrame, secret: str) -> DataFrame:
    """``docs`` with entities of ``text`` replaced, all other columns as they are, whatever they are called.

    A null text stays null, an empty one empty. Equal entities get equal surrogates in all rows, repeated rows
    too; rows without doc_id are treated like others.
    """
    return _replaced(docs, secret).select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(docs.columns)])


def _replaced(docs: DataFrame, secret: str) -> DataFrame:
    """Columns c0, c1, … of ``docs`` with the replaced text, and the entities that were ``found``."""
    at = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    text, doc = F.col(at["text"]), at["doc_id"]
    source = docs.select(*[docs[f"`{c}`"].alias(n) for c, n in at.items()]).withColumn("names", known_names(text))
    listed = source.withColumn("pattern", pattern_of(F.col("names"))).withColumn("found", matches(text, F.col("pattern")))
    keys = F.flatten(F.transform("found", lambda m: keys_of(m, F.col("names"))))
    held = cut(listed.select(F.col(doc).alias("doc"), F.explode(keys).alias("key")).distinct())
    again = cut(collisions(held.select("key").distinct(), secret))
    none = F.create_map().cast("map<string,int>")
    if again.isEmpty():
        listed = listed.withColumn("attempts", none)
    else:
        by_doc = held.join(again, "key").groupBy("doc").agg(F.map_from_entries(F.collect_list(F.struct("key", "attempt"))).alias("attempts"))
        listed = listed.join(by_doc, listed[doc].eqNullSafe(by_doc["doc"]), "left").withColumn("attempts", F.coalesce("attempts", none))
    pieces = F.split(text, F.col("pattern"), -1)
    given = F.transform("found", lambda m: surrogate(secret, m, F.col("names"), F.col("attempts")))
    joined = F.array_join(F.zip_with(pieces, F.concat(given, F.array(F.lit(""))), lambda p, s: F.concat(p, s)), "")
    return listed.withColumn(at["text"], F.when(F.size("found") > 0, joined).otherwise(text)).select(*at.values(), "found")


def anonymise(docs: DataFrame, keep: list[str], secret: str) -> DataFrame:
    """``keep`` columns and text of every row after replacement, with the number of entities of each kind."""
    columns = list(dict.fromkeys(["doc_id", *keep, "text"]))
    done = _replaced(docs.select(*[docs[f"`{c}`"] for c in columns]), secret).withColumn("kinds", F.transform("found", kind_of))
    count = lambda kind: F.size(F.filter("kinds", lambda k: k == kind)).cast("long")
    counted = [count(kind).alias(f"n_{kind}") for kind in KINDS]
    return done.select(
        *[F.col(f"c{i}").alias(c) for i, c in enumerate(columns) if c in keep or c == "text"],
        F.size(F.filter("kinds", lambda k: k.isNotNull())).cast("long").alias("n_entities"), *counted,
    )
