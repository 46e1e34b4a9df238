"""Substring, exact and SimHash deduplication against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from vernissage.llm import exact, graph, membership, simhash, substring
from vernissage.session import fresh_path

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
ALL_SPACE = re.compile(r"[\x20\x09-\x0D]")


def by_key(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))


def plain_substrings(rows, n=20):
    seen, out = set(), []
    for key, text in by_key(rows):
        words = SPACE.findall(text or "")
        gone = [False] * len(words)
        for i in range(len(words) - n + 1):
            window = tuple(words[i : i + n])
            if window in seen:
                gone[i : i + n] = [True] * n
            seen.add(window)
        out.append((key, len(words), sum(gone), " ".join(w for w, g in zip(words, gone) if not g)))
    return Counter(out)


def told(frame):
    return Counter(tuple(r) for r in frame.collect())


@pytest.mark.parametrize("settings", [{}, {"chunk_bytes": 2000, "block_cells": 1 << 10, "cells_per_window": 0.01}])
def test_substrings(wide_docs, settings):
    rows = [(r.doc_id, r.text) for r in wide_docs.collect()]
    assert told(substring.dedup_substrings(wide_docs, **settings)) == plain_substrings(rows)


def test_substrings_of_random_copies(spark):
    rng = random.Random(4)
    base = [" ".join(rng.choice("abcdefgh") for _ in range(60)) for _ in range(8)]
    rows = [(i, " ".join(rng.choice(base)[rng.randrange(30) :] for _ in range(3))) for i in range(60)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert told(substring.dedup_substrings(frame, chunk_bytes=1500, block_cells=512)) == plain_substrings(rows)


def pattern_words(n):
    """Two words of n bytes that are complements of each other in a pattern polynomials modulo 2**64 cannot tell apart."""
    bits = [i.bit_count() % 2 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


@pytest.mark.parametrize("n", [64, 1024, 4096])
def test_substrings_tell_long_words_apart(spark, n):
    one, other = pattern_words(n)
    shared = " ".join(f"w{i}" for i in range(19))
    rows = [(1, f"{shared} {one} end"), (2, f"{shared} {other} end"), (3, f"x {shared} {other}")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert told(substring.dedup_substrings(frame)) == plain_substrings(rows)


def test_substrings_of_nothing(no_docs):
    assert substring.dedup_substrings(no_docs).count() == 0


def plain_exact(rows):
    groups = {}
    for row in rows:
        groups.setdefault(ALL_SPACE.sub("", row.text or ""), []).append(row)
    out = Counter()
    for normal, members in groups.items():
        keep = min(members, key=lambda r: (-len(r.text or ""), r.doc_id is None, r.doc_id or 0))
        kept_once = False
        for r in members:
            same = (r.doc_id, r.text) == (keep.doc_id, keep.text)
            kept = same and not kept_once
            kept_once |= kept
            out[r.doc_id, keep.doc_id, len(members), kept, hashlib.sha256(normal.encode()).hexdigest()] += 1
    return out


def test_exact(spark, docs):
    assert told(exact.exact_duplicates(spark, docs.select("doc_id", "text")).drop("content")) == plain_exact(docs.collect())


def test_exact_compares_bytes_when_digests_agree(spark, docs):
    weak = lambda normal: F.concat(F.length(normal) % 3, F.lit(""))
    got = exact.exact_duplicates(spark, docs.select("doc_id", "text"), digest=weak).drop("content", "text_sha256")
    want = Counter()
    for row, n in plain_exact(docs.collect()).items():
        want[row[:4]] += n
    assert told(got) == want


def test_exact_state_goes_on_over_later_files(spark, docs):
    path, checkpoint = fresh_path(spark, "keys"), fresh_path(spark, "state")
    keys = exact.keyed_rows(docs.select("doc_id", "text"), "doc_id", "text").withColumn("row", F.monotonically_increasing_id())
    keys.filter("key % 2 = 0").write.parquet(path)
    first = exact.run_to_end(spark, path, keys.schema, checkpoint, files_per_batch=1).agg(F.sum("members")).first()[0]
    keys.filter("key % 2 = 1 or key is null").write.mode("append").parquet(path)
    state = exact.run_to_end(spark, path, keys.schema, checkpoint, files_per_batch=1)
    whole = exact.group_state(spark.read.parquet(path))
    assert first < docs.count()
    assert told(state.select("digest", "members", "best.key")) == told(whole.select("digest", "members", "best.key"))


def test_exact_stage_keeps_one_row_of_each_group(spark, wide_docs, no_docs):
    kept = exact.without_duplicates(spark, wide_docs)
    assert kept.columns == wide_docs.columns
    want = Counter(k[1] for k, n in plain_exact(wide_docs.collect()).items() if k[3] for _ in range(n))
    assert Counter(r.doc_id for r in kept.collect()) == want
    assert exact.without_duplicates(spark, no_docs).count() == 0


def plain_fingerprint(text):
    words = SPACE.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(codes, distance=3):
    root = list(range(len(codes)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(codes)):
        for j in range(i):
            if (codes[i] ^ codes[j]).bit_count() <= distance:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(codes))]


def test_simhash(wide_docs, no_docs):
    rows = wide_docs.select("doc_id", "text").collect()
    codes = [plain_fingerprint(r.text) for r in rows]
    root = plain_components(codes)
    first = {c: min((r.doc_id for r, d in zip(rows, root) if d == c and r.doc_id is not None), default=None) for c in root}
    want = Counter((r.doc_id, f"{c:016x}", first[d]) for r, c, d in zip(rows, codes, root))
    assert told(simhash.near_duplicates(wide_docs).select("doc_id", "fingerprint", "component_id")) == want
    kept = simhash.without_near_duplicates(wide_docs)
    assert kept.columns == wide_docs.columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter(first.values())
    assert simhash.near_duplicates(no_docs).count() == simhash.without_near_duplicates(no_docs).count() == 0


def dense_codes(n, seed, free):
    """Codes that agree in all but `free` bits, so that groups are large and links many."""
    rng = random.Random(seed)
    base, spots = rng.getrandbits(64), rng.sample(range(64), free)
    return list({base ^ sum(1 << s for s in spots if rng.random() < 0.5) for _ in range(n)})


@pytest.mark.parametrize(("free", "limit"), [(64, 20_000), (18, 20_000), (18, 50), (12, 20)])
def test_links_join_what_is_linked(spark, free, limit):
    codes = dense_codes(700, free, free)
    frame = spark.createDataFrame([(c - (1 << 64) if c >> 63 else c,) for c in codes], "code long")
    pairs = [(r.a & (1 << 64) - 1, r.b & (1 << 64) - 1) for r in simhash.linking_pairs(frame, limit).collect()]
    assert all(a != b and (a ^ b).bit_count() <= 3 for a, b in pairs)
    place = {c: i for i, c in enumerate(codes)}
    root = np.arange(len(codes))
    for _ in range(len(codes)):
        before = root.copy()
        for a, b in pairs:
            root[place[a]] = root[place[b]] = min(root[place[a]], root[place[b]])
        if np.array_equal(before, root):
            break
    assert root.tolist() == plain_components(codes)


def test_one_index_finds_the_links_of_many_groups():
    """Groups of all sizes in one run, small ones included, against all pairs."""
    rng = random.Random(8)
    group, codes = [], []
    for g in range(300):
        own = dense_codes(rng.choice([1, 2, 3, 20, 150]), g, rng.choice([6, 10, 64]))
        own.sort(key=lambda c: gray(c))
        group += [g] * len(own)
        codes += own
    i, j = simhash.linked_codes(np.array(codes, dtype=np.uint64), np.array(group))
    assert all(group[a] == group[b] and (codes[a] ^ codes[b]).bit_count() <= 3 for a, b in zip(i, j))
    root = list(range(len(codes)))
    for g in range(300):
        at = [n for n, h in enumerate(group) if h == g]
        for n, r in zip(at, plain_components([codes[n] for n in at])):
            root[n] = at[r]
    got = np.arange(len(codes))
    for _ in range(len(codes)):
        before = got.copy()
        np.minimum.at(got, i, got[j])
        np.minimum.at(got, j, got[i])
        if np.array_equal(before, got):
            break
    assert got.tolist() == root


def gray(code):
    for shift in (1, 2, 4, 8, 16, 32):
        code ^= code >> shift
    return code


@pytest.mark.parametrize("rows", [[(1, "a b c d")], [(1, None), (2, "")], [(7, "x y z")] * 3])
def test_simhash_of_a_single_group(spark, rows):
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("code", F.lit("own"))
    got = simhash.near_duplicates(frame.coalesce(1)).collect()
    assert [(r.component_id, r.code) for r in got] == [(rows[0][0], "own")] * len(rows)


def test_simhash_group_over_several_batches(spark):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        test_links_join_what_is_linked(spark, 12, 20_000)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_gray_neighbours_differ_in_one_bit(spark):
    ranked = spark.range(256).select("id", simhash.gray_rank(F.col("id")).alias("rank")).orderBy("rank").collect()
    assert all((a.id ^ b.id).bit_count() == 1 for a, b in zip(ranked, ranked[1:]))


def test_components_of_paths_stars_and_rings(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(200, 260)] + [(301, 300), (300, 302), (302, 301), (5, 5)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {i: 100 for i in range(100, 161)} | {i: 7 for i in [7, *range(200, 260)]} | {300: 300, 301: 300, 302: 300}
    assert got == want


def test_bitmaps_miss_no_value(spark):
    rows = spark.range(3000).select(F.when(F.col("id") % 50 > 0, F.concat(F.lit("v"), "id")).alias("v"), "id")
    held = rows.filter("id % 7 = 0")
    told = membership.with_chance(rows, F.col("v"), membership.bitmap(held, F.col("v"))).collect()
    assert {r.id for r in told if r.chance} >= {r.id for r in held.collect() if r.v is not None}
    assert sum(r.chance for r in told) < 500 and not any(r.chance for r in told if r.v is None)
    none = membership.with_chance(rows, F.col("v"), membership.bitmap(rows.limit(0), F.col("v")))
    assert none.filter("chance").count() == 0 and none.count() == 3000


def test_exact_with_one_hot_digest(spark):
    rows = spark.range(3000).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, F.lit("hot  text")).otherwise(F.concat(F.lit("text "), F.col("id") % 1500)).alias("text")
    )
    assert told(exact.exact_duplicates(spark, rows).drop("content")) == plain_exact(rows.collect())
    weak = lambda normal: F.when(normal.startswith("text1"), "one").otherwise(F.sha2(normal, 256))
    got = exact.exact_duplicates(spark, rows, digest=weak).drop("content", "text_sha256")
    want = Counter()
    for row, n in plain_exact(rows.collect()).items():
        want[row[:4]] += n
    assert told(got) == want
