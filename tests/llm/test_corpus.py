"""Mixing, packing, vectors, the registered queries and the pipeline."""

import math
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
import corpus_pipeline
from tools.check import TABLES, rows_of
from vernissage import session
from vernissage.llm import mixing, packing, queries, vectors

SF = "/root/testdata/sf0.001"


def plain_targets(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_, out = share * sum(sizes.values()), set(names), {}
    while open_:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / total >= most * sizes[s]}
        if not over:
            return out | {s: left * weight[s] / total for s in open_}
        for s in over:
            out[s] = most * sizes[s]
        left -= sum(out[s] for s in over)
        open_ -= over
    return out


def test_mixing(spark, wide_docs, no_docs):
    rows = mixing.mix(wide_docs).collect()
    sizes, taken, largest = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in rows:
        assert r["size"] == len((r.text or "").replace("\x0b", " ").split()) and r.taken in (0, r["size"], 2 * r["size"])
        sizes[r.source] += r["size"]
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r["size"])
    want = plain_targets(sizes)
    for r in rows:
        assert r.source_size == sizes[r.source] and math.isclose(r.target, want[r.source], abs_tol=1e-6)
        assert abs(taken[r.source] - r.target) <= largest[r.source] / 2 + 1e-6
    assert Counter(mixing.mix(wide_docs.repartition(5), carry=["doc_id"]).collect()) == Counter(mixing.mix(wide_docs, carry=["doc_id"]).collect())
    mixed = mixing.mixed_documents(wide_docs)
    assert mixed.columns == wide_docs.columns
    assert Counter(r.doc_id for r in mixed.collect()) == Counter(r.doc_id for r in rows for _ in range(r.copies))
    assert mixing.mix(no_docs).count() == mixing.mixed_documents(no_docs).count() == 0


def test_mixing_spreads_rows_without_a_turn(spark):
    """Sources at their cap, and one whose open share is tiny, in few and many ranges: same rows."""
    rows = [(i, "a" if i < 3000 else "b" if i < 3003 else "c", 1) for i in range(6000)]
    frame = spark.createDataFrame(rows, "doc_id long, source string, n long")
    told = [Counter(mixing.mix(frame, size=F.col("n"), buckets=b).collect()) for b in (1, 7, None)]
    assert told[0] == told[1] == told[2]
    taken = Counter()
    for r in told[0]:
        taken[r.source] += r.taken
    for r in told[0]:
        assert abs(taken[r.source] - r.target) <= 0.5


def test_mixing_prefers_documents_of_higher_propensity(spark):
    rows = [(i, "a" if i < 2000 else "b", 10, 9.0 if i % 2 else 1.0) for i in range(4000)]
    frame = spark.createDataFrame(rows, "doc_id long, source string, n long, p double")
    got = mixing.mix(frame, size=F.col("n"), weights=(1, 20), share=1.2, propensity=F.col("p")).filter("source = 'a'").collect()
    extra = Counter(r.doc_id % 2 for r in got if r.copies > r.target // r.source_size)
    assert extra[1] > 3 * extra[0] > 0


def check_bins(rows, capacity, lanes, cluster):
    used, sources, clusters = defaultdict(int), defaultdict(Counter), defaultdict(Counter)
    for r in rows:
        used[r.bin] += r.length
        sources[r.bin][r.source] += 1
        clusters[r.bin][cluster(r)] += 1
    used.pop(None, None)
    assert max(used.values()) <= capacity
    assert max(max(sources[b].values()) for b in used) <= lanes
    assert max(max(clusters[b].values()) for b in used) == 1
    return used


def test_packing(wide_docs, no_docs):
    rows = packing.pack(wide_docs, capacity=100, shard_rows=50).collect()
    pieces = defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append((r.start, r.length))
        assert (r.bin is None) == (r.length == 0)
    for r in wide_docs.select("doc_id", mixing.word_count(F.col("text")).alias("n")).distinct().collect():
        times = sum(1 for start, _ in pieces[r.doc_id] if start == 0)
        assert Counter(pieces[r.doc_id]) == Counter({(s, min(100, r.n - s)): times for s in range(0, max(r.n, 1), 100)})
    text = {r.doc_id: "".join((r.text or "").split()).lower() for r in wide_docs.collect()}
    check_bins([r for r in rows], 100, packing.LANES, lambda r: text[r.doc_id] if r.bin is not None else r)
    assert packing.pack(no_docs).count() == 0


def test_packing_spreads_repeated_rows(spark):
    rows = spark.range(3000).select(F.lit(1).alias("doc_id"), F.lit("s").alias("source"), F.lit("one two three").alias("text"))
    packed = packing.pack(rows.unionByName(spark.range(5, 205).selectExpr("int(id) doc_id", "'t' source", "concat('w ', id) text")), capacity=100, shard_rows=100)
    shards = Counter(r.bin >> 32 for r in packed.collect())
    assert sum(shards.values()) == 3200 and max(shards.values()) < 200
    assert packed.filter("doc_id = 1").select("bin").distinct().count() == 3000


def plain_best_fit(sizes, sources, clusters, capacity, lanes):
    bins, turn, out = [], Counter(), []
    for size, source, cluster in zip(sizes, sources, clusters):
        lane = (source, turn[source] % lanes)
        turn[source] += 1
        fits = [b for b in bins if b["room"] >= size and lane not in b["lanes"] and (cluster is None or cluster not in b["clusters"])]
        if fits:
            best = min(fits, key=lambda b: (b["room"], b["n"]))
        else:
            best = {"n": len(bins), "room": capacity, "lanes": set(), "clusters": set()}
            bins.append(best)
        best["room"] -= size
        best["lanes"].add(lane)
        best["clusters"].add(cluster)
        out.append(best["n"])
    return out


@pytest.mark.parametrize("seed", range(4))
def test_packing_takes_the_tightest_compatible_bin(seed):
    rng = np.random.default_rng(seed)
    sizes = sorted(rng.integers(1, 60, 300).tolist(), reverse=True)
    sources = [None if s == 0 else f"s{s}" for s in rng.integers(0, 5, 300)]
    clusters = [None if c == 0 else int(c) for c in rng.integers(0, 40, 300)]
    assert packing.pack_shard(sizes, sources, clusters, 100, 3) == plain_best_fit(sizes, sources, clusters, 100, 3)


def vector_rows():
    rng = np.random.default_rng(6)
    base = rng.normal(size=(300, 16))
    near = base[:60] + rng.normal(size=(60, 16)) * 0.25
    hot = base[0] + rng.normal(size=(250, 16)) * 0.05
    rows = [v.tolist() for v in np.concatenate([base, near, hot])] + [base[1].tolist()] * 30 + [(base[2] * 1e30).tolist(), (base[2] * 1e-30).tolist()]
    odd = [None, [], [0.0] * 16, [float("nan")] * 16, [float("inf")] * 16, [None] * 16, [1.0] * 15]
    return [(1000 - i, v) for i, v in enumerate(rows + odd)] + [(1000, rows[0]), (None, rows[1])], len(odd)


@pytest.mark.parametrize("tile", [4096, 16])
def test_vectors(spark, tile):
    rows, odd = vector_rows()
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("rep", F.lit(1)).repartition(4)
    settings = vectors.Settings(per_cell=4, tile=tile, recall=0.999)
    got = Counter((r.vec_id, r.n_links, r.component_id, r.kept) for r in vectors.near_duplicate_vectors(frame, settings=settings).collect())
    good = [i for i, (_, v) in enumerate(rows) if v and len(v) == 16 and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    u = vectors.unit(np.array([rows[i][1] for i in good], dtype=np.float32).astype(np.float64))
    near = u @ u.T >= 0.9
    np.fill_diagonal(near, False)
    assert sum(n * c for (_, n, _, _), c in got.items()) >= 0.98 * near.sum()
    root = np.arange(len(good))
    while True:
        lower = np.array([min(root[i], root[near[i]].min(initial=root[i])) for i in range(len(good))])
        if np.array_equal(lower, root):
            break
        root = lower
    first = {c: min(rows[good[i]][0] for i in np.flatnonzero(root == c) if rows[good[i]][0] is not None) for c in set(root.tolist())}
    of = {good[i]: (int(near[i].sum()), first[root[i]]) for i in range(len(good))}
    want = Counter()
    for i, (key, _) in enumerate(rows):
        n, component = of.get(i, (0, key))
        want[key, n, component, key == component] += 1
    assert sum((got - want).values()) <= 0.02 * len(rows)
    assert len(rows) - len(good) == odd


def test_vectors_of_every_length_and_size(spark):
    rng = np.random.default_rng(2)
    rows = [[1.0], [1.0], [-3.0], [1e39, 0.0], [1.0, 0.0], [0.0, 5e-300], [1e308] * 3, [1.0] * 3, [1.0, 1.0, 2.6], [1.0, 1.0, 2.5], [float("inf"), 1.0]]
    rows += rng.normal(size=(40, 5)).tolist() + [(np.ones(7) + rng.normal(size=7) * 0.45).tolist() for _ in range(60)]
    frame = spark.createDataFrame(list(enumerate(rows)), "vec_id long, embedding array<double>").repartition(3)
    got = {r.vec_id: (r.n_links, r.component_id) for r in vectors.near_duplicate_vectors(frame, settings=vectors.Settings(recall=1.0)).collect()}
    near = np.zeros((len(rows), len(rows)), dtype=bool)
    for i, a in enumerate(rows):
        for j, b in enumerate(rows):
            if i != j and len(a) == len(b) and np.isfinite(a + b).all():
                near[i, j] = vectors.unit(np.array([a]))[0] @ vectors.unit(np.array([b]))[0] >= 0.9
    root = np.arange(len(rows))
    for _ in rows:
        root = np.array([min(root[i], root[near[i]].min(initial=root[i])) for i in range(len(rows))])
    assert near[:11].any() and near[51:].sum() > 50 and got == {i: (int(near[i].sum()), int(root[i])) for i in range(len(rows))}


def test_no_link_below_the_threshold_and_empty_tables(spark):
    rows = [(i, [math.cos(a), math.sin(a)]) for i, a in enumerate(np.arange(0, 6, 0.5).tolist())]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert {r.n_links for r in vectors.near_duplicate_vectors(frame).collect()} == {0}
    assert vectors.near_duplicate_vectors(frame.limit(0)).count() == 0


def test_all_are_registered():
    names = [n.split("_")[0] for n in queries.QUERIES]
    assert sorted(names, key=lambda n: int(n[2:])) == [f"op{i}" for i in range(1, 14)]
    assert "pipeline" in contract.queries() and [n for n, _ in corpus_pipeline.STAGES][0] == "quality classifier"


@pytest.mark.parametrize("name", sorted(queries.CHECKS))
def test_check_sql_on_edge_rows(spark, docs, tmp_path, name):
    """The queries and their SQL also agree on null, empty, long and repeated rows."""
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    frame = queries.QUERIES[name](spark, str(tmp_path))
    result = con.execute(queries.CHECKS[name])
    columns = [d[0] for d in result.description]
    assert rows_of(frame.columns, frame.collect()) == rows_of(columns, result.fetchall())


def test_pipeline_stages_on_edge_rows(spark, wide_docs, no_docs):
    for start in (wide_docs, no_docs):
        docs = start
        for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
            docs = stage(spark, docs, SF)
            if n < len(corpus_pipeline.STAGES) - 1:
                assert docs.columns == start.columns
        docs.collect()


def test_pipeline_keeps_what_its_stages_keep(spark):
    """Rows of run() against the stages' definitions in plain Python, each on what the stage before left."""
    from tests.llm.test_dedup import plain_components, plain_exact, plain_fingerprint

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = corpus_pipeline.quality_stage(spark, docs, SF).cache()
    left = kept.collect()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    told = [r.doc_id for r in left if r.doc_id in labels]
    assert np.mean([labels[d] for d in told]) > 0.9
    stays = {k[0] for k in plain_exact(left) if k[3]}
    left = sorted((r for r in left if r.doc_id in stays), key=lambda r: r.doc_id)
    root = plain_components([plain_fingerprint(r.text) for r in left])
    left = [r for i, r in enumerate(left) if root[i] == i]
    after = corpus_pipeline.simhash_stage(spark, corpus_pipeline.exact_stage(spark, kept, SF), SF).cache()
    assert Counter(r.doc_id for r in after.collect()) == Counter(r.doc_id for r in left)
    mixed = corpus_pipeline.mixing_stage(spark, after, SF).cache()
    copies = Counter(r.doc_id for r in mixed.collect())
    sizes = {r.doc_id: len(r.text.split()) for r in left}
    by_source = defaultdict(int)
    for r in left:
        by_source[r.source] += sizes[r.doc_id]
    targets = plain_targets(by_source)
    for source, target in targets.items():
        own = [r.doc_id for r in left if r.source == source]
        assert abs(sum(copies[d] * sizes[d] for d in own) - target) <= max(sizes[d] for d in own) / 2 + 1e-6
    packed = corpus_pipeline.packing_stage(spark, mixed, SF).collect()
    words = Counter()
    for r in packed:
        words[r.doc_id] += r.length
    assert words == Counter({d: sizes[d] * n for d, n in copies.items() if sizes[d]})
    check_bins(packed, packing.CAPACITY, packing.LANES, lambda r: r.doc_id)


def test_pipeline_leaves_its_result_only(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "shared_dir", lambda spark: str(tmp_path))
    rows = corpus_pipeline.run(spark, SF)
    assert [p.name.split("-")[0] for p in tmp_path.iterdir()] == ["pipeline"]
    assert rows.count() > 0 and {"doc_id", "source", "piece", "start", "length", "bin"} <= set(rows.columns)


def test_tables_are_known():
    assert {"documents", "embeddings", "conversations", "labels"} <= set(TABLES)
