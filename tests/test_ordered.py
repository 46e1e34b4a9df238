"""Ordered target statistics against counting row by row."""

import random

import pytest

from vernissage.operators import folds
from vernissage.operators.ranking import seeded_digest

CLASSES, SEED = 3, 11


def rows_of(n=400):
    rng = random.Random(4)
    # One value holds a third of all rows, many occur once or twice, some are null.
    value = lambda: rng.choice(["hot"] * 10 + [None] * 3 + [f"v{rng.randrange(60)}" for _ in range(17)])
    return [(i, value(), rng.choice([0, 0, 1, 2, None]), rng.randrange(4)) for i in range(n)]


@pytest.mark.parametrize(("rows_per_bucket", "weight"), [(1_000_000, 1.0), (10, 0.5)])
def test_ordered_encoding(spark, rows_per_bucket, weight):
    rows = rows_of()
    df = spark.createDataFrame(rows, "id long, attribution string, y int, fold int").repartition(3)
    digest = {r.id: r.d for r in df.select("id", seeded_digest("id", SEED).alias("d")).collect()}
    got = folds.ordered_encoding(df, SEED, weight=weight, n_classes=CLASSES, rows_per_bucket=rows_per_bucket)
    assert got.columns == ["id", "attribution", "y", "fold", *[f"artist_ord_{k}" for k in range(CLASSES)]]
    prior = [sum(y == k for _, _, y, _ in rows) / len(rows) for k in range(CLASSES)]
    found = got.collect()
    assert len(found) == len(rows)
    own = {r[0]: r for r in rows}
    for r in found:
        earlier = [o for o in rows if o[1] == r.attribution and o[3] != own[r.id][3] and (digest[o[0]], o[0]) < (digest[r.id], r.id)]
        total = len(earlier)
        want = [(sum(o[2] == k for o in earlier) + weight * prior[k]) / (total + weight) for k in range(CLASSES)]
        assert [r[f"artist_ord_{k}"] for k in range(CLASSES)] == pytest.approx(want)


def test_rows_after_all_training_rows(spark):
    train = spark.createDataFrame(rows_of(), "id long, attribution string, y int, fold int")
    test = spark.createDataFrame([(1, "hot"), (2, None), (3, "unseen")], "id long, attribution string")
    got = {r.id: [r.artist_ord_0, r.artist_ord_1, r.artist_ord_2] for r in folds.smoothed_encoding(train, test, n_classes=CLASSES).collect()}
    rows = rows_of()
    prior = [sum(y == k for _, _, y, _ in rows) / len(rows) for k in range(CLASSES)]
    for key, value in ((1, "hot"), (2, None), (3, "unseen")):
        own = [y for _, v, y, _ in rows if v == value]
        assert got[key] == pytest.approx([(own.count(k) + prior[k]) / (len(own) + 1) for k in range(CLASSES)])
