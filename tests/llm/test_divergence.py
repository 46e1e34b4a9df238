"""Source divergence against plain Python."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given
from hypothesis import strategies as st

from vernissage.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def plain_audit(rows, least_docs, top=50):
    """rows of (lang, source, text)."""
    docs, counts, groups = defaultdict(Counter), defaultdict(Counter), set()
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        terms = TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        groups.add((lang, source))
        counts[lang, source].update(terms)
        docs[lang].update(set(terms))
    out = set()
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in docs[lang].items() if n >= least_docs]
        own = sorted((s for g, s in groups if g == lang), key=str.encode)
        share = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (sum(c[u] for u in kept) + 5 * len(kept)) for t in kept}
        p = {s: share(counts[lang, s]) for s in own}
        q = share(sum((counts[lang, s] for s in own), Counter()))
        for s in own:
            pairs = [(o, sum(abs(p[s][t] - p[o][t]) for t in kept)) for o in own if o != s]
            above = [(t, p[s][t] - q[t]) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, items, most in (("pair", pairs, None), ("term", above, top)):
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out |= {(lang, s, part, item, value, n + 1) for n, (item, value) in enumerate(items[:most])}
    return out


def told(frame):
    rows = [tuple(r) for r in frame.select("lang", "source", "part", "item", "value", "rank").collect()]
    assert len(set(rows)) == len(rows)
    return set(rows)


WORDS = ["the", "The", "THE", "é", "straße", "exactly8", "sixteenletterswd", "seventeenlettersx", "exactly8x", "日本語", "a", "b", "ab", "a" * 40, "a" * 41, "b" * 200, "É"]


def random_rows(n=400, seed=3):
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        lang, source = rng.choice(["en", "de", None, ""]), rng.choice(["a", "b", "c", "é", None, "", "only"])
        words = [rng.choice(WORDS + [f"w{chr(97 + rng.randrange(20))}"]) for _ in range(rng.randrange(30))]
        rows.append((lang, source, rng.choice([" ", "-", "1", "@"]).join(words)))
    return rows + [("xx", "empty", ""), ("xx", "other", None), ("yy", "alone", "word " * 50)]


@pytest.mark.parametrize("cuts", [{}, {"rows_per_bucket": 7, "sources_per_stripe": 2}])
def test_audit(spark, cuts):
    rows = random_rows()
    frame = spark.createDataFrame(rows, "lang string, source string, text string").repartition(5)
    want = plain_audit(rows, 5, 4)
    assert {w[2] for w in want} == {"pair", "term"} and ("xx", "empty", "pair", "other", 0, 1) in want
    assert told(divergence.audit(frame, least_docs=5, top=4, **cuts)) == want


def test_audit_on_edge_rows(spark, wide_docs, no_docs):
    rows = [(r.lang, r.source, r.text) for r in wide_docs.collect()]
    assert told(divergence.audit(wide_docs, least_docs=2)) == plain_audit(rows, 2)
    assert divergence.audit(no_docs).count() == 0


def test_tasks_hand_on_counts_before_they_hold_too_many(monkeypatch):
    rows = [r for r in random_rows(300) if r[0] and r[1]]
    batch = pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in range(3)], names=["lang", "source", "text"])
    monkeypatch.setattr(divergence, "_SLICE_BYTES", 300)

    def counted(limit):
        monkeypatch.setattr(divergence, "_HELD_RUNS", limit)
        n, docs, parts = Counter(), Counter(), 0
        for out in divergence.count_batches(iter([batch, batch.slice(0, 0), batch])):
            parts += 1
            for r in out.to_pylist():
                n[r["lang"], r["source"], r["term"]] += r["n"]
                docs[r["lang"], r["source"], r["term"]] += r["docs"]
        return n, docs, parts

    whole, often = counted(1 << 20), counted(50)
    assert whole[:2] == often[:2] and often[2] > whole[2]
    want = Counter()
    for lang, source, text in rows * 2:
        want.update((lang, source, t) for t in TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or "")))
    assert whole[0] == want


@given(st.lists(st.tuples(st.integers(0, 2**64 - 1), st.integers(0, 3)), max_size=60))
def test_radix_order(rows):
    words = [np.array([r[k] for r in rows], dtype=np.uint64) for k in range(2)]
    assert divergence.radix_order(*words).tolist() == sorted(range(len(rows)), key=lambda i: (rows[i], i))


@given(st.lists(st.text(alphabet="abzé日", min_size=1, max_size=8), min_size=1, max_size=20))
def test_packing_keeps_terms_and_their_order(terms):
    raw = [t.encode()[:16] for t in terms]
    data = np.frombuffer(b"".join(raw), dtype=np.uint8)
    length = np.array([len(t) for t in raw])
    words = divergence.packed_words(data, np.cumsum(length) - length, length, 2)
    assert divergence.unpacked_words(words).to_pylist() == raw
    order = divergence.radix_order(*words)
    assert [raw[i] for i in order] == sorted(raw)


@given(st.lists(st.tuples(st.integers(0, 2**47), st.integers(1, 2**47)), min_size=1, max_size=20))
def test_shares_are_exact(rows):
    count = np.array([min(r) for r in rows], dtype=np.int64)
    total = np.array([max(r) for r in rows], dtype=np.int64)
    assert divergence.shares(count, total).tolist() == [1 + 10**9 * c // t for c, t in zip(count.tolist(), total.tolist())]


def test_shares_in_sql_are_exact(spark):
    rows = [(9_999_999_999_999, 10**13, 7), (0, 3, 1), (12_345_678_901, 98_765_432_109, 1000), (0, 0, 1)]
    frame = spark.createDataFrame(rows, "c long, t long, v long")
    got = [r[0] for r in frame.select(divergence.share(frame.c, frame.t, frame.v)).collect()]
    assert got == [1 + 10**9 * (c + 5) // (t + 5 * v) for c, t, v in rows]
