from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from vernissage.functions import fixed
from vernissage.operators import audit, blend, folds, joins, knowledge, profile, ranking
from vernissage.sources import fetch


def ids_frame(spark, ids):
    return spark.createDataFrame([(i,) for i in ids], "id long")


def test_positions_with_uneven_ids(spark):
    ids = [*range(-300, 300, 2), 10**12, 10**15, *range(5_000_000, 5_000_200)]
    df = ranking.position_within(ranking.range_buckets(ids_frame(spark, ids), "id", rows_per_bucket=40), "id")
    assert [r.position for r in df.orderBy("id").collect()] == list(range(len(ids)))


def test_positions_inside_groups(spark):
    df = spark.range(2000).select("id", (F.col("id") % 3).alias("g")).withColumn("_d", F.md5(F.col("id").cast("string")))
    got = ranking.position_within(df.withColumn("_bucket", F.substring("_d", 1, 2)), ["_d", "id"], by=["g"])
    groups = defaultdict(list)
    for r in got.collect():
        groups[r.g].append((r._d, r.id, r.position))
    for rows in groups.values():
        assert [p for _, _, p in sorted(rows)] == list(range(len(rows)))


def test_every_kth(spark):
    ids = [i * 7 for i in range(501)]
    got = ranking.every_kth(ids_frame(spark, ids), 20, rows_per_bucket=50)
    assert sorted(r.id for r in got.collect()) == ids[::20]


def test_lookup_with_hot_and_null_keys(spark):
    keys = ["hot"] * 4000 + [None] * 3000 + [f"k{i}" for i in range(5000)]
    rows = spark.createDataFrame(list(enumerate(keys)), "id long, k string")
    table = spark.createDataFrame([("hot", 1), *[(f"k{i}", i) for i in range(0, 5000, 2)]], "k string, v int")
    got = {r.id: r.v for r in joins.spread_lookup(rows, table, ["k"]).collect()}
    known = {r.k: r.v for r in table.collect()}
    assert got == {i: known.get(k) for i, k in enumerate(keys)}


def test_duplicate_side_key_fails(spark):
    base = ids_frame(spark, [1, 2, 3])
    side = spark.createDataFrame([(1, 5.0), (3, 6.0)], "id long, v double")
    assert {r.id: r.v for r in joins.attach_evidence(base, side).collect()} == {1: 5.0, 2: None, 3: 6.0}
    with pytest.raises(Exception, match="duplicate id"):
        joins.attach_evidence(base, side.union(side)).collect()


def fold_fixture(spark, n=900):
    df = spark.range(n).select(
        "id",
        (F.col("id") % 8).cast("int").alias("y"),
        F.when(F.col("id") % 3 == 0, "big").otherwise(F.concat(F.lit("a"), (F.col("id") % 50).cast("string"))).alias("attribution"),
    )
    return folds.assign_folds(df, 7)


def test_fold_sizes(spark):
    counts = defaultdict(Counter)
    for r in fold_fixture(spark, 903).collect():
        counts[r.y][r.fold] += 1
    for c in counts.values():
        assert len(c) == 5 and max(c.values()) - min(c.values()) <= 1


def brute_encoding(rows, prior):
    out = {}
    for r in rows:
        others = [o.y for o in rows if o.attribution == r.attribution and o.fold != r.fold]
        out[r.id] = [others.count(k) / len(others) for k in range(8)] if others else prior
    return out


def test_encoding_leaves_own_fold_out(spark):
    lonely = spark.createDataFrame([(5000, 3, "only", 2)], "id long, y int, attribution string, fold int")
    df = fold_fixture(spark).unionByName(lonely)
    rows = df.collect()
    prior = [sum(r.y == k for r in rows) / len(rows) for k in range(8)]
    want = brute_encoding(rows, prior)
    for r in folds.out_of_fold_encoding(df).collect():
        assert [r[f"artist_enc_{k}"] for k in range(8)] == pytest.approx(want[r.id])
    strict = {r.id: r for r in folds.out_of_fold_encoding(df, strict_prior=True).collect()}
    rest = [r.y for r in rows if r.fold != 2]
    assert strict[5000].artist_enc_3 == pytest.approx(rest.count(3) / len(rest))


def test_own_label_does_not_reach_own_encoding(spark):
    df = fold_fixture(spark)
    flipped = df.withColumn("y", F.when(F.col("id") == 30, 0).otherwise(F.col("y")))
    a, b = (
        {r.id: r for r in folds.out_of_fold_encoding(d).collect()}[30] for d in (df, flipped)
    )
    assert [a[f"artist_enc_{k}"] for k in range(8)] == [b[f"artist_enc_{k}"] for k in range(8)]


def test_full_encoding_unseen_gets_prior(spark):
    train = fold_fixture(spark)
    test = spark.createDataFrame([(1, "big"), (2, "new")], "id long, attribution string")
    got = {r.id: [r[f"artist_enc_{k}"] for k in range(8)] for r in folds.full_encoding(train, test).collect()}
    rows = train.collect()
    big = [r.y for r in rows if r.attribution == "big"]
    assert got[1] == pytest.approx([big.count(k) / len(big) for k in range(8)])
    assert got[2] == pytest.approx([sum(r.y == k for r in rows) / len(rows) for k in range(8)])


@pytest.mark.parametrize("limit", [256, 0])
def test_category_codes_every_path(spark, monkeypatch, limit):
    monkeypatch.setattr(folds, "LITERAL_VALUES", limit)
    train = spark.createDataFrame([("b",), ("a",), (None,), ("ca",), ("cb",)], "c string")
    test = spark.createDataFrame([(1, "a"), (2, "cb"), (3, "zz"), (4, None)], "id long, c string")
    got = {r.id: r.c_code for r in folds.encode_categories(test, train, ["c"]).collect()}
    assert got == {1: 0, 2: 3, 3: None, 4: None}


def test_quantiles_and_null_profile(spark):
    df = spark.createDataFrame([(0, 1.0), (0, 2.0), (0, 2.0), (0, 10.0), (1, None), (1, 4.0)], "y int, v double")
    got = {r.y: r.q for r in profile.quantiles_by_group(df, "y", "v", [0.25], ["q"]).collect()}
    assert got == {0: 1.75, 1: 4.0}
    rates = {r.column_name: r.null_pct for r in profile.null_profile(df, ["y", "v"]).collect()}
    assert rates["y"] == 0 and rates["v"] == pytest.approx(100 / 6)


def labels_of(spark, labels):
    df = spark.createDataFrame([("Q1", label) for label in labels], "item string, label string")
    return knowledge.item_categories(df).withColumn("rule", knowledge.rule_class()).first()


def test_material_substring_quirks(spark):
    pencil = labels_of(spark, [" Pencil "])
    assert (pencil.graphite, pencil.ink_mat, pencil.rule) == (1, 1, 1)
    woodcut = labels_of(spark, ["woodcut"])
    assert (woodcut.print_mat, woodcut.wood_support, woodcut.rule) == (1, 1, 5)


@pytest.mark.parametrize(
    ("labels", "rule"),
    [
        (["gouache", "ink"], 7), (["acrylic paint", "gold leaf"], 0), (["gold", "etching"], 6),
        (["etching", "oil paint"], 5), (["oil paint", "canvas", "panel"], 2), (["oil paint", "panel"], 3),
        (["oil paint", "poplar"], 4), (["oil on panel"], 3), (["linseed oil"], 2), (["quill"], 1), (["copper"], -1),
    ],
)
def test_rule_ladder(spark, labels, rule):
    assert labels_of(spark, labels).rule == rule


def test_repeated_materials_are_kept(spark):
    bindings = spark.createDataFrame([("Q1", "ink"), ("Q1", "gold"), ("Q1", "ink")], "item string, label string")
    assert knowledge.material_lists(bindings).first().materials == ["gold", "ink", "ink"]
    records = spark.createDataFrame([(1, "Q1"), (2, None), (3, "Q9")], "id long, wikidataid string")
    for unique in (False, True):
        found = knowledge.materials_of_records(records, bindings, unique=unique)
        assert {r.id: (r.wd_materials, r.n_materials) for r in found.collect()} == {1: ("gold|ink|ink", 3), 2: ("", 0), 3: ("", 0)}


@pytest.mark.parametrize("rows_per_bucket", [2, 1_000_000])
def test_rows_without_id_or_label_stay_at_any_size(spark, rows_per_bucket):
    rows = [(i if i % 7 else None, i % 3 if i % 5 else None) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, y int").repartition(3)
    ids = sorted((i for i, _ in rows if i is not None)) + [None] * sum(i is None for i, _ in rows)
    batches = fetch.batches(df, size=10, rows_per_bucket=rows_per_bucket).collect()
    assert sorted((r.position, r.batch) for r in batches) == [(p, p // 10) for p in range(200)]
    assert [r.id for r in sorted(batches, key=lambda r: r.position)] == ids
    sample = ranking.every_kth(df, 20, rows_per_bucket=rows_per_bucket).collect()
    assert Counter(r.id for r in sample) == Counter(ids[::20])
    folded = folds.assign_folds(df, 42, rows_per_bucket=rows_per_bucket).collect()
    assert Counter((r.id, r.y) for r in folded) == Counter(rows)
    for y in (None, 0, 1, 2):
        sizes = Counter(r.fold for r in folded if r.y == y)
        assert max(sizes.values()) - min(sizes.values()) <= 1


def test_dictionary_of_values_with_one_prefix(spark):
    values = [f"same beginning {i:05d}" for i in range(3000)]
    df = spark.createDataFrame([(v,) for v in values for _ in range(2)] + [(None,)], "f string")
    got = {r.value: r.code for r in folds.category_dictionary(df, "f", rows_per_bucket=100).collect()}
    assert got == {v: i for i, v in enumerate(values)}
    held = ranking.range_buckets(df.distinct(), "f", rows_per_bucket=100).groupBy("_bucket").count()
    assert held.agg(F.max("count")).first()[0] <= 4 * 100


def test_blend_first_index_on_tie(spark):
    df = spark.createDataFrame([(1, [0.2, 0.4, 0.4]), (1, [0.4, 0.3, 0.3])], "id long, probs array<double>")
    mean = blend.average_probabilities(df, n_classes=3)
    tied = spark.createDataFrame([(1, [0.25, 0.5, 0.5])], "id long, probs array<double>")
    assert blend.decide(tied).first().pred == 1
    assert mean.first().probs == pytest.approx([0.3, 0.35, 0.35])


def test_overrides_count_missing_captions(spark):
    df = spark.createDataFrame(
        [(1, None, 3, 0.9, "a"), (2, 3, 3, 0.99, "b"), (3, 2, 3, 0.5, "c"), (4, 2, 1, 0.86, "d")],
        "id long, cap_y int, pred int, conf double, t string",
    )
    got = {r.id: (r.cap_says, r.model_says) for r in audit.overrides(df).collect()}
    assert got == {1: (None, fixed.MEDIA[3]), 4: (fixed.MEDIA[2], fixed.MEDIA[1])}


def test_rule_mining(spark):
    rows = [("x", 1, 7)] * 22 + [("x", 1, 1)] * 3 + [("z", 2, 2), ("z", 2, 5)]
    df = spark.createDataFrame(rows, "attribution string, cap_y int, y int")
    got = {r.attribution: r for r in audit.attribution_rules(df, min_support=2).collect()}
    assert (got["x"].support, got["x"].rule_class, got["x"].purity) == (25, 7, 22 / 25)
    assert got["z"].rule_class == 2


def test_quantiles_of_any_column(spark):
    """One group holds most rows and many distinct values; others are tiny, null or empty."""
    points, names = (0.0, 0.1, 0.25, 0.5, 0.999, 1.0), ("a", "b", "c", "d", "e", "f")
    df = spark.range(200_000).selectExpr(
        "case when id % 50 > 3 then 'hot' when id % 50 = 1 then null when id = 2 then 'one' when id % 50 = 2 then 'none' else 'few' end as g",
        "case when id % 50 = 2 and id > 2 then null when id % 50 = 3 then double(id % 4) when id % 5 = 0 then 7.5D "
        "else (xxhash64(id) % 1000003) / 8.0 * pow(10, id % 30 - 15) end as v",
    ).cache()
    got = {r.g: tuple(r)[1:] for r in profile.quantiles_by_group(df, "g", "v", points, names, rows_per_bucket=5_000).collect()}
    at = F.percentile("v", F.array(*[F.lit(p) for p in points]))
    want = {r.g: tuple(r.q) for r in df.filter("v is not null").groupBy("g").agg(at.alias("q")).collect()}
    assert set(got) == {"hot", "few", "one", None} and got == want
    assert profile.quantiles_by_group(df.limit(0), "g", "v", points, names).count() == 0
    whole = profile.quantiles_by_group(df.selectExpr("g", "bigint(v) as v").filter("g = 'few'"), "g", "v", (0.5,), ("m",)).first()
    assert whole.m == df.filter("g = 'few'").selectExpr("percentile(bigint(v), 0.5)").first()[0]
