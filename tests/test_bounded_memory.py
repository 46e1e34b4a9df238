"""What models and text scores hold at once does not grow with the rows; evidence is assembled once for all seeds."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vernissage.functions import fixed
from vernissage.operators import models, vectors
from vernissage.operators import text_vectors as tv
from vernissage.plans import modelling
from vernissage.session import land

SF = "/root/testdata/sf0.001"


@pytest.fixture
def unkept(monkeypatch):
    """Nothing may be held in the memory of executors."""
    whole = DataFrame.persist

    def persist(df, level=StorageLevel.MEMORY_AND_DISK):
        assert not level.useMemory
        return whole(df, level)

    monkeypatch.setattr(DataFrame, "persist", persist)


def test_long_texts_are_weighed_few_rows_at_a_time():
    n, width = 2 * tv.ROWS_WEIGHED + 7, 5
    ends = pa.array(np.arange(n + 1, dtype=np.int32) * width)
    place = pa.ListArray.from_arrays(ends, pa.array(np.tile(np.arange(width, dtype=np.int32), n)))
    tf = pa.ListArray.from_arrays(ends, pa.array(np.arange(1, n * width + 1)))
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(n)), place, tf], names=["id", "idx", "tf"])
    idf = np.linspace(1, 2, width)
    out = list(tv.weighed(iter([batch]), idf, "id"))
    assert [b.num_rows for b in out] == [tv.ROWS_WEIGHED, tv.ROWS_WEIGHED, 7]
    raw = (np.log(np.arange(1, n * width + 1)) + 1).reshape(n, width) * idf
    want = raw / np.linalg.norm(raw, axis=1)[:, None]
    assert np.allclose([v for b in out for v in b.column(2).to_pylist()], want)
    assert [k for b in out for k in b.column(0).to_pylist()] == list(range(n))


def test_blocks_of_sparse_rows_from_the_middle_of_a_batch():
    idx = pa.array([[0], None, [], [2, 1]], pa.list_(pa.int32()))
    val = pa.array([[9.0], None, [], [3.0, 4.0]], pa.list_(pa.float64()))
    part = pa.RecordBatch.from_arrays([idx, val], names=["idx", "val"]).slice(1, 3)
    assert vectors._dense(part, 3).tolist() == [[0, 0, 0], [0, 0, 0], [0, 4, 3]]
    one = pa.RecordBatch.from_arrays([val], names=["vec"])
    with pytest.raises(ValueError, match="3 numbers"):
        vectors._dense(one, 3)


def test_svd_keeps_no_rows(spark, unkept):
    x = np.random.default_rng(3).normal(size=(200, 4)) * [4, 3, 2, 1]
    rows = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, vec array<double>")
    found = vectors.TruncatedSvd.fit(rows, 4, 2)
    assert np.allclose(found.singular_values, np.linalg.svd(x)[1][:2])
    scores = {r.id: (r.svd_0, r.svd_1) for r in found.scores(rows).collect()}
    assert np.allclose([scores[i] for i in range(200)], x @ found.components)


def test_boosting_keeps_its_rows_on_disk(spark, unkept):
    told = spark.range(200).select("id", (F.col("id") % 2).cast("int").alias("y"), (F.col("id") % 2 + F.rand(1)).alias("x"))
    rows = land(models.assemble(told, ["x"], ["id", "y"]), "boosted-rows")
    fit = models.BoostedOneVsRest(rounds=1, depth=2, n_classes=2, parallelism=2)
    assert fit(rows)(rows).count() == 200


def test_seeds_share_the_vectors_of_the_evidence(spark, monkeypatch):
    """The same vectors as from the whole matrix, but wide rows are assembled once for two seeds."""
    n = 120
    codes = [F.when(F.col("id") % 7 > 0, F.col("id") % 3).cast("int").alias(c) for c in modelling.CODES]
    told = land(
        spark.range(n).select(
            "id", (F.col("id") % 8).cast("int").alias("y"), F.when(F.col("id") % 5 == 4, "test").otherwise("train").alias("split"),
            F.concat(F.lit("a"), F.col("id") % 4).alias("attribution"), F.when(F.col("id") % 3 > 0, F.rand(1)).alias("size"), *codes,
            F.rand(2).alias("cap_is_ink"), F.when(F.col("id") % 2 > 0, F.rand(3)).alias("svd_0"),
        ),
        "told",
    )
    monkeypatch.setattr(modelling, "evidence", lambda spark, sf: told)
    whole, wide = models.assemble, []

    def assemble(df, columns, keep, **settings):
        wide.append("size" in columns)
        return whole(df, columns, keep, **settings)

    monkeypatch.setattr(models, "assemble", assemble)
    for seed in (42, 7):
        for kind, left, missing in (("blend", "artist_ord_", None), ("booster", "artist_enc_", None), ("linear", None, 0.0)):
            train, test, names = modelling.assembled(spark, SF, seed, kind)
            matrix = modelling.record_matrix(spark, SF, seed)
            assert names == [c for c in modelling.numeric_names(matrix) if (not c.startswith(left) if left else c in ("cap_is_ink", "svd_0"))]
            nominal = None if kind == "linear" else {c: 3 for c in modelling.CODES}
            settings = {"nominal": nominal, "missing": fixed.MISSING_NUMBER if missing is None else missing}
            want = {r.id: r for r in whole(matrix, names, modelling.KEEP, **settings).collect()}
            got = {r.id: r for r in train.unionByName(test).collect()}
            assert len(got) == n and got.keys() == want.keys()
            assert all((r.y, r.split, r.fold) == (want[i].y, want[i].split, want[i].fold) for i, r in got.items())
            assert all(np.array_equal(r.features.toArray(), want[i].features.toArray()) for i, r in got.items())
            assert kind == "linear" or modelling.bins(train) == modelling.LEAST_BINS
    assert sum(wide) == 1
