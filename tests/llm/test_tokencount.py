import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from chunkloom.llm import tokencount

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["\u00a0", "\u2003", "\u3000", "\x85", "\x1c", "'s", "'re", "12", "é", "日本語", "🙂", "<|endoftext|>", "  ", "\n\n", "\t", "\r\n", " ", "...", "Wort", "naïve", "\u200b", "\ufeff"]


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    return lambda text: len(t.encode(text or "", add_special_tokens=False).ids)


def run(spark, rows, **kw):
    return {r["doc_id"]: tuple(r)[1:] for r in tokencount.token_counts(spark.createDataFrame(rows, "doc_id long, text string, n_tokens string"), PATH, **kw).collect()}


def mixed(rng, n):
    return "".join(rng.choice(ODD) if rng.random() < 0.5 else rng.choice(["the ", " of", "tion", "Ab", " ", "x"]) for _ in range(n))


def test_short_and_long_texts_equal_the_library(spark, library):
    rng = random.Random(2)
    rows = [(i, mixed(rng, rng.randrange(0, 400)), "") for i in range(150)] + [(900, None, ""), (901, "", None)]
    got = run(spark, rows, chunk=120, overlap=30)
    assert got == {i: (len((t or "").encode()), library(t), library(t) > 1024) for i, t, _ in rows}
    assert run(spark, rows) == got


def test_overlaps_are_widened(spark, library):
    texts = ["x" * 1000, "a b " * 20 + "y" * 400 + " c d" * 50, "日" * 700 + " end " * 9, "\n" * 500, " " * 300 + "z"]
    rows = [(i, t, "") for i, t in enumerate(texts)] + [(9, texts[1], "")]
    assert run(spark, rows, chunk=100, overlap=10) == {i: (len(t.encode()), library(t), library(t) > 1024) for i, t, _ in rows}


def test_empty_table(spark):
    assert run(spark, []) == {}
