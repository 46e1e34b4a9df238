"""Weak-label audit queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from vernissage.functions import caption, fixed, temporal
from vernissage.operators import audit, blend, profile
from vernissage.plans import views
from vernissage.plans.registry import query
from vernissage.plans.views import with_views

MEDIA_SQL = "case {} " + " ".join(f"when {k} then '{m}'" for k, m in enumerate(fixed.MEDIA)) + " end"


def labelled(spark, sf):
    return audit.with_weak_label(views.train_rows(spark, sf))


@query(
    "weak_label_accuracy",
    with_views(
        "select count(*) filter (where cap_y = y) / count(*) as accuracy, "
        "count(*) filter (where not coalesce(cap_y = y, false)) as n_disagree, count(*) as n_rows "
        "from captions where split = 'train'",
        "captions",
    ),
)
def weak_label_accuracy(spark, sf):
    return audit.weak_label_accuracy(labelled(spark, sf))


@query(
    "confusion_matrix",
    with_views(
        "select cast(k as int) as y, "
        + ", ".join(f"count(cap_y) filter (where cap_y = {k}) as cap_{k}" for k in range(8))
        + " from (select unnest(range(8)) as k) left join "
        "(select y, cap_y from captions where split = 'train') on y = k group by k",
        "captions",
    ),
)
def confusion_matrix(spark, sf):
    return audit.confusion_matrix(labelled(spark, sf))


@query(
    "confusion_pairs",
    with_views(
        f"select {MEDIA_SQL.format('cap_y')} as cap_says, {MEDIA_SQL.format('y')} as truth, count(*) as n "
        "from captions where split = 'train' and cap_y <> y group by 1, 2",
        "captions",
    ),
)
def confusion_pairs(spark, sf):
    return audit.confusion_pairs(labelled(spark, sf))


@query(
    "crosstab",
    with_views(
        f"select {MEDIA_SQL.format('cap_y')} as cap_says, "
        + ", ".join(
            f"count(*) filter (where y = {k}) as n_{m.replace(' ', '_')}" for k, m in enumerate(fixed.MEDIA)
        )
        + " from captions where split = 'train' and cap_y is not null group by 1",
        "captions",
    ),
)
def crosstab(spark, sf):
    named = labelled(spark, sf).filter(F.col("cap_y").isNotNull()).select(
        caption.label_name(F.col("cap_y")).alias("cap_says"), caption.label_name(F.col("y")).alias("truth")
    )
    return profile.cross_counts(named, "cap_says", "truth", fixed.MEDIA)


@query(
    "anachronism",
    with_views(
        "select count(*) filter (where cap_med = 'acrylic' and y0 < 1940) as n_anachronism, count(*) as n_rows "
        "from captions where split = 'train'",
        "captions",
    ),
)
def anachronism(spark, sf):
    flag = temporal.anachronism(caption.caption_medium())
    return views.train_rows(spark, sf).agg(
        F.sum(flag).alias("n_anachronism"), F.count(F.lit(1)).alias("n_rows")
    )


@query(
    "evidence_coverage",
    with_views(
        "select count(wikidataid) / count(*) as coverage, count(wikidataid) as n_covered, count(*) as n_rows "
        "from artworks",
        "artworks",
    ),
)
def evidence_coverage(spark, sf):
    return views.artworks(spark, sf).agg(
        profile.share(F.col("wikidataid").isNotNull()).alias("coverage"),
        F.count("wikidataid").alias("n_covered"),
        F.count(F.lit(1)).alias("n_rows"),
    )


def decided(spark, sf, texts=False):
    """Blended decisions with the record columns an audit reads."""
    chosen = blend.decide(blend.average_probabilities(views.predictions(spark, sf)))
    return audit.with_weak_label(views.artworks(spark, sf, texts)).join(chosen, "id")


@query(
    "slice_accuracy",
    with_views(
        "select cast(coalesce(cap_y = y, false) as int) as agrees, "
        "count(*) filter (where pred = y) / count(*) as accuracy, count(*) as n "
        "from captions join decided using (id) where split = 'train' group by 1",
        "captions", "decided",
    ),
)
def slice_accuracy(spark, sf):
    return audit.slice_accuracy(decided(spark, sf).filter("split = 'train'"))


_OVERRIDES_SQL = (
    f"select id, {MEDIA_SQL.format('cap_y')} as cap_says, {MEDIA_SQL.format('pred')} as model_says, "
    "round(conf, 6) as conf, t as title from captions join decided using (id) "
    f"where split = 'test' and cap_y is distinct from pred and conf > {fixed.OVERRIDE_CONFIDENCE}"
)


def _overrides(spark, sf):
    found = audit.overrides(decided(spark, sf, texts=True).filter("split = 'test'"))
    return found.withColumn("conf", F.round("conf", 6))


@query("overrides", with_views(_OVERRIDES_SQL, "captions", "decided"))
def overrides(spark, sf):
    return _overrides(spark, sf)


@query(
    "override_top_k",
    with_views(
        _OVERRIDES_SQL + " order by conf desc, id limit 5",
        "captions", "decided",
    ),
)
def override_top_k(spark, sf):
    return profile.top_k(_overrides(spark, sf), "conf", 5)


_RULES_SQL = (
    "select attribution, cast(cap_y as int) as cap_y, cast(sum(n) as bigint) as support, "
    "cast(arg_min(y, -n * 100 + y) as int) as rule_class, max(n) / sum(n) as purity "
    "from (select attribution, cap_y, y, count(*) as n from captions where split = 'train' "
    "and cap_y is not null and attribution is not null group by 1, 2, 3) group by 1, 2 having sum(n) >= 2"
)


@query("attribution_rules", with_views(_RULES_SQL, "captions"))
def attribution_rules(spark, sf):
    return audit.attribution_rules(labelled(spark, sf), min_support=2)


@query(
    "attribution_overrides",
    with_views(
        f"select id, d.pred as pred, cast(case when purity >= 0.95 then rule_class else pred end as int) as final "
        f"from captions c join decided d using (id) left join ({_RULES_SQL}) r "
        "on r.attribution = c.attribution and r.cap_y = c.cap_y where split = 'test'",
        "captions", "decided",
    ),
)
def attribution_overrides(spark, sf):
    rules = audit.attribution_rules(labelled(spark, sf), min_support=2)
    return audit.apply_rules(decided(spark, sf).filter("split = 'test'"), rules, min_purity=0.95)


@query("submission", with_views("select id, pred as y from decided join artworks using (id) where split = 'test'", "decided", "artworks"))
def submission(spark, sf):
    return audit.submission(decided(spark, sf).filter("split = 'test'"))


@query(
    "submission_classes",
    with_views(
        "select pred as y, count(*) as n from decided join artworks using (id) where split = 'test' group by 1",
        "decided", "artworks",
    ),
)
def submission_classes(spark, sf):
    return profile.frequency(submission(spark, sf), "y").orderBy("y")
