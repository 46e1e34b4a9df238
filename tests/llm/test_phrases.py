"""Collocations against plain counting."""

import random
import re
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given
from hypothesis import strategies as st

from vernissage.llm import phrases


def plain_counts(rows, longest=5):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                f.update((lang, tuple(words[i : i + k])) for i in range(len(words) - k + 1))
    return f, n


def plain_collocations(rows, least, top, cover=100):
    f, n = plain_counts(rows)
    found = {key: a for key, a in f.items() if a >= least and len(key[1]) > 1}
    out = defaultdict(list)
    for (lang, w), a in found.items():
        cuts = [(1000 * a * n[lang] // (f[lang, w[:k]] * f[lang, w[k:]]), k) for k in range(1, len(w))]
        score, k = min(cuts)
        around = any(lang == other and len(v) > len(w) and any(v[i : i + len(w)] == w for i in range(len(v))) and 100 * b >= cover * a for (other, v), b in found.items())
        if not around:
            out[lang].append((-score, -a, " ".join(w).encode(), f[lang, w[:k]], f[lang, w[k:]]))
    return {
        (lang, place + 1, phrase.decode(), -a, l, r, n[lang], -score)
        for lang, items in out.items() for place, (score, a, phrase, l, r) in enumerate(sorted(items)[:top])
    }


def told(frame):
    rows = [tuple(r) for r in frame.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()]
    assert len(set(rows)) == len(rows)
    return set(rows)


def random_rows(n=150, seed=2):
    rng = random.Random(seed)
    common = [" ".join(rng.choice("abcdefghij") for _ in range(40)) for _ in range(5)]
    rows = []
    for _ in range(n):
        words = [rng.choice(["the", "of", "The", "é", "日本", "x\x00y", "New York City", "new york", rng.choice(common), f"w{rng.randrange(30)}"]) for _ in range(rng.randrange(30))]
        rows.append((rng.choice(["en", "de", None, ""]), "".join(w + rng.choice([" ", "  ", "\t", ". ", "\n", "\x0b"]) for w in words)))
    return rows + [("en", "go " * 3000), ("en", None), ("xx", ""), ("yy", "a b c. " * 20), ("de", "x" * 5000 + " y")]


TINY = {"part_bytes": 3000, "block_cells": 512, "bytes_per_cell": 3}


@pytest.mark.parametrize("settings", [{}, {"modulus": 3}, {"modulus": 1}, TINY, TINY | {"modulus": 2}])
def test_collocations(spark, settings):
    rows = random_rows()
    frame = spark.createDataFrame(rows, "lang string, text string").repartition(4)
    want = plain_collocations(rows, 8, 30)
    assert {w[0] for w in want} >= {"en", "de", "und", "", "yy"} and any(len(w[2].split()) == 5 for w in want)
    assert told(phrases.collocations(frame, least=8, top=30, **settings)) == want


def test_cover_below_all_occurrences(spark):
    rows = random_rows(seed=7)
    frame = spark.createDataFrame(rows, "lang string, text string")
    assert told(phrases.collocations(frame, least=8, top=500, cover=60)) == plain_collocations(rows, 8, 500, 60)


def test_on_edge_rows(spark, wide_docs, no_docs):
    rows = [(r.lang, r.text) for r in wide_docs.collect()]
    assert told(phrases.collocations(wide_docs, least=5)) == plain_collocations(rows, 5, 2000)
    assert phrases.collocations(no_docs).count() == 0


@given(st.lists(st.text(alphabet="aB \t.\né", max_size=40), min_size=1, max_size=8), st.integers(1, 4))
def test_chunks_hold_every_phrase_once(texts, modulus):
    table = phrases.parsed(pa.array(["en"] * len(texts)), pa.array(texts), 4, modulus)
    got = Counter()
    for r in table.to_pylist():
        words = r["chunk"].split(" ")
        for i in range(len(words) if r["tail"] else len(words) - 4):
            got.update({("en", tuple(words[i : i + k])): r["n"] for k in range(1, 6) if i + k <= len(words)})
    assert got == plain_counts([("en", t) for t in texts])[0]


def test_repeated_passages_give_the_same_chunks():
    rng = random.Random(1)
    passage = " ".join(f"p{rng.randrange(10**6)}" for _ in range(400))
    texts = [" ".join(f"q{rng.randrange(10**6)}" for _ in range(50)) + " " + passage for _ in range(10)]
    table = phrases.parsed(pa.array(["en"] * 10), pa.array(texts), 4, 16)
    shared = [r for r in table.to_pylist() if r["n"] == 10]
    assert sum(len(r["chunk"].split()) for r in shared) > 350


def test_score_is_exact_beyond_64_bits(spark):
    rows = [(10**13 + 7, 10**15 + 3, 10**13 + 9, 10**14 + 1), (100, 100, 100, 100), (123, 999_999_999_999, 124, 100_000_007)]
    frame = spark.createDataFrame(rows, "a long, n long, l long, r long")
    got = [r[0] for r in frame.select(phrases.cut_score(frame.a, frame.n, frame.l, frame.r)).collect()]
    assert got == [1000 * a * n // (l * r) for a, n, l, r in rows]


def test_cells_of_a_part_are_held_once():
    rng = np.random.default_rng(3)
    parts = [np.sort(rng.integers(0, 1 << 24, 100_000).astype(np.uint64) * np.uint64(101) + rng.integers(1, 101, 100_000).astype(np.uint64)) for _ in range(10)]
    sums = Counter()
    for part in parts:
        for x in part.tolist():
            sums[x // 101] += x % 101
    tracemalloc.start()
    got = phrases.added_cells(parts, 100)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert not parts and peak < 40 * 1_000_000, peak  # cells and weights of their own, put in order, took 71 bytes a phrase
    assert got.tolist() == [c * 101 + min(n, 100) for c, n in sorted(sums.items())]
