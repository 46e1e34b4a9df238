"""Folds, encodings and blending, checkable without a trained model."""

from __future__ import annotations

from pyspark.sql import functions as F

from vernissage.functions import fixed
from vernissage.operators import blend, folds
from vernissage.plans import views
from vernissage.plans.registry import query
from vernissage.plans.views import with_views
from vernissage.session import land

KS = range(fixed.N_CLASSES)


def folded(spark, sf, seed=42):
    return folds.assign_folds(views.train_rows(spark, sf), seed)


@query(
    "stratified_folds",
    with_views(
        "select id, y, cast((row_number() over (partition by y order by md5(concat(cast(id as string), '-42')), id) - 1) % 5 "
        "as int) as fold from (select id, case when id % 53 <> 0 then y end as y from train)",
        "train",
    ),
)
def stratified_folds(spark, sf):
    """Some rows have no label."""
    rows = views.train_rows(spark, sf).select("id", F.when(F.col("id") % 53 != 0, F.col("y")).alias("y"))
    return folds.assign_folds(rows, 42)


@query(
    "class_prior",
    with_views(
        "select cast(k as int) as y, count(t.y) / (select count(*) from train) as prior "
        "from (select unnest(range(8)) as k) left join train t on t.y = k group by k",
        "train",
    ),
)
def class_prior(spark, sf):
    return folds.class_prior(views.train_rows(spark, sf)).select(F.posexplode("prior").alias("y", "prior"))


_SHARES = ", ".join(f"count(*) filter (where y = {k}) / count(*) as share_{k}" for k in KS)


@query("class_share_by_attr", with_views(f"select attribution, count(*) as n, {_SHARES} from train group by 1", "train"))
def class_share_by_attr(spark, sf):
    return folds.group_shares(views.train_rows(spark, sf))


_FILLED = "coalesce(attribution, 'MISSING')"
_OOF = (
    f"select f.id, f.fold, "
    + ", ".join(
        f"coalesce((t.n_{k} - o.n_{k}) / nullif(t.n - o.n, 0), p.p_{k}) as artist_enc_{k}" for k in KS
    )
    + f" from (select *, {_FILLED} as a from folds) f "
    + f"join (select {_FILLED} as a, count(*) as n, "
    + ", ".join(f"count(*) filter (where y = {k}) as n_{k}" for k in KS)
    + " from folds group by 1) t using (a) "
    + f"join (select {_FILLED} as a, fold, count(*) as n, "
    + ", ".join(f"count(*) filter (where y = {k}) as n_{k}" for k in KS)
    + " from folds group by 1, 2) o on o.a = f.a and o.fold = f.fold cross join (select "
    + ", ".join(f"count(*) filter (where y = {k}) / count(*) as p_{k}" for k in KS)
    + " from train) p"
)


def _named(df):
    return df.withColumn("attribution", F.coalesce("attribution", F.lit(fixed.MISSING_CATEGORY)))


@query("oof_encode", with_views(_OOF, "folds"))
def oof_encode(spark, sf):
    # The fold table is read several times below, so it is written once.
    rows = land(_named(folded(spark, sf).select("id", "y", "attribution", "fold")), "folds")
    encoded = folds.out_of_fold_encoding(rows)
    return encoded.drop("y", "attribution")


@query(
    "test_encode",
    with_views(
        "select t.id, " + ", ".join(f"coalesce(share_{k}, p_{k}) as artist_enc_{k}" for k in KS)
        + f" from test t left join (select {_FILLED} as a, {_SHARES} from train group by 1) s "
        + f"on s.a = coalesce(t.attribution, 'MISSING') cross join (select "
        + ", ".join(f"count(*) filter (where y = {k}) / count(*) as p_{k}" for k in KS)
        + " from train) p",
        "train", "test",
    ),
)
def test_encode(spark, sf):
    train = _named(views.train_rows(spark, sf).select("id", "y", "attribution"))
    test = _named(views.test_rows(spark, sf).select("id", "attribution"))
    return folds.full_encoding(train, test).drop("attribution")


@query("seed_blend", with_views("select id, pred, round(conf, 6) as conf from decided", "decided"))
def seed_blend(spark, sf):
    chosen = blend.decide(blend.average_probabilities(views.predictions(spark, sf)))
    return chosen.withColumn("conf", F.round("conf", 6))


@query(
    "fold_average",
    with_views(
        "select id, " + ", ".join(f"round(avg(p) filter (where k = {k}), 6) as p_{k}" for k in KS)
        + " from fold_preds join test using (id) group by id",
        "fold_preds", "test",
    ),
)
def fold_average(spark, sf):
    repeats = range(1, fixed.N_FOLDS + 1)
    predicted = views.predictions(spark, sf, repeats, "fold").filter("split = 'test'")
    mean = blend.average_probabilities(predicted)
    return mean.select("id", *[F.round(F.col("probs")[k], 6).alias(f"p_{k}") for k in KS])


@query(
    "accuracy",
    with_views(
        "select count(*) filter (where pred = y) / count(*) as accuracy from decided join train using (id)",
        "decided", "train",
    ),
)
def accuracy(spark, sf):
    chosen = blend.decide(blend.average_probabilities(views.predictions(spark, sf)))
    rows = views.train_rows(spark, sf).select("id", "y").join(chosen, "id")
    return rows.agg(blend.accuracy().alias("accuracy"))
