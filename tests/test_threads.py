"""Jobs that run at the same time share nothing, nor do tables of different evidence."""

import os
from threading import Barrier

from pyspark.sql import functions as F

from vernissage.operators import models
from vernissage.plans import modelling
from vernissage.session import land, land_once, shared_dir


def test_items_have_their_own_properties(spark):
    """One set of properties for all items let fits fail with 'Cannot parse null string': each cleared the execution of the others."""
    met = Barrier(4, timeout=60)

    def work(item):
        spark.sparkContext.setLocalProperty("vernissage.item", str(item))
        met.wait()
        return spark.sparkContext.getLocalProperty("vernissage.item")

    assert models.in_threads(work, range(4), 4) == ["0", "1", "2", "3"]


def test_vectors_belong_to_their_evidence(spark, monkeypatch):
    """Tables made from one evidence were given for another one of the same folder."""
    def told(n):
        codes = [F.lit(0).alias(c) for c in modelling.CODES]
        return land(spark.range(n).select("id", (F.col("id") % 8).cast("int").alias("y"), F.lit("train").alias("split"), F.lit("a").alias("attribution"), F.rand(1).alias("size"), *codes), "told")

    for n in (40, 56):
        rows = told(n)
        monkeypatch.setattr(modelling, "evidence", lambda spark, sf, rows=rows: rows)
        assert modelling.assembled(spark, "/root/testdata/sf0.001", seed=5)[0].count() == n
        assert modelling.encodings_of(spark, "/root/testdata/sf0.001", seed=5).count() == n


def test_steps_of_a_table_are_removed(spark):
    """Steps of the evidence stayed on disk as long as the session, next to what was made from them."""
    told = land(spark.range(9), "told")
    before = set(os.listdir(shared_dir(spark)))

    def build():
        inner = land_once(spark, ("inner-table", "here"), lambda: land(told.filter("id > 1"), "inner-step"), told)
        return land(inner, "step").join(land(told, "other-step"), "id")

    found = land_once(spark, ("outer-table", "here"), build, told)
    new = set(os.listdir(shared_dir(spark))) - before
    assert found.count() == 7 and {n.rsplit("-", 1)[0] for n in new} == {"inner-table", "outer-table"}
