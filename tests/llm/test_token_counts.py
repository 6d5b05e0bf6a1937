"""The compiled tokenizer against the library's counts."""

import random
import sys

import pytest
from tokenizers import Tokenizer as Library

from folioline.llm import queries, token_counts

PATH = queries.WORD_TOKENIZER
SCHEMA = "doc_id long, text string, n_tokens string, n_bytes string, kind string"


@pytest.fixture(scope="module")
def library():
    return Library.from_file(PATH)


def by_library(library, texts):
    return [len(e.ids) for e in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def made_texts():
    rng = random.Random(8)
    pieces = [
        "a", "the", "ing", "e", "S", "'", "'s", "'re", "'v", "'l", "'LL", "'rex", "!", "--", "7", "42", "½", "²", " ", "\n", " ",
        " ", "é", "é", "ß", "Σ", "İ", "ǅ", "漢", "字", "が", "😀", "👩‍🚀", "́", "<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>",
        "<|endof", "text|>", "\x00", "\x1c", "\x85", "﻿", "\U0010fffd", "ﬁ", "K", "ـ", "ा", "zzzz", "qx",
    ]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randrange(60))) for _ in range(1500)]
    texts += ["".join(rng.choice("aeinorst'") for _ in range(rng.randrange(80))) for _ in range(500)]
    return [None, "", " ", "\n \t", "'", "''s", "a" * 5000, "ab" * 4000 + "'s", "漢字" * 3000, "word " * 60_000, *texts, *texts[:9]]


@pytest.mark.parametrize(("chunk", "most"), [(7, 200_000), (64, 300), (1024, 200_000)])
def test_counts_are_the_librarys(library, chunk, most):
    texts = made_texts()
    if chunk < 1024:
        texts = [t for t in texts if t is None or len(t) < 1000]
    machine = token_counts.Tokenizer(PATH, most_states=most, chunk=chunk)
    # Little by little, so that a small machine is forgotten on the way.
    got = [n for i in range(0, len(texts), 50) for n in machine.counts(texts[i : i + 50])]
    assert got == by_library(library, texts)


def test_every_character_has_the_librarys_class(library):
    points = [p for p in range(1, sys.maxunicode + 1) if not 0xD800 <= p <= 0xDFFF]
    texts = ["".join(f"a{chr(p)}b " for p in points[i : i + 64]) for i in range(0, len(points) if "--all" in sys.argv else 70_000, 64)]
    assert list(token_counts.compiled(PATH).counts(texts)) == by_library(library, texts)


def test_transitions_sum_to_the_count_of_each_prefix(library):
    machine = token_counts.compiled(PATH).machine
    for word in ["unbelievable", "aaaaaaaaa", "strengths", "sdfghjkl"]:
        state, total = machine.states[0], 0
        for i, letter in enumerate(word):
            state, emitted = machine.step(state, ord(letter))
            total += emitted
            assert total + state[2] == len(library.encode(word[: i + 1], add_special_tokens=False).ids)


def test_table_with_nulls_repeats_and_clashing_columns(spark, library):
    texts = made_texts()[:200]
    rows = [(i if i % 7 else None, t, "x", "y", "z") for i, t in enumerate(texts)]
    rows += rows[:20]
    got = token_counts.count_tokens(spark.createDataFrame(rows, SCHEMA).repartition(3), PATH).collect()
    counts = by_library(library, [r[1] for r in rows])
    want = [(r[0], len((r[1] or "").encode()), n) for r, n in zip(rows, counts, strict=True)]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert token_counts.count_tokens(spark.createDataFrame([], SCHEMA), PATH).collect() == []


def test_query_against_the_library(spark, library):
    sf = "/root/testdata/sf0.001"
    got = {r.doc_id: r for r in queries.QUERIES["op12_token_counts"](spark, sf).collect()}
    docs = queries.table(spark, sf, "documents").collect()
    for row, n in zip(docs, by_library(library, [d.text for d in docs]), strict=True):
        assert got[row.doc_id][1:] == (len((row.text or "").encode()), n, n > 2048)


def test_other_tokenizers_are_refused():
    with pytest.raises((ValueError, KeyError)):
        token_counts.Tokenizer(queries.TOKENIZER)
