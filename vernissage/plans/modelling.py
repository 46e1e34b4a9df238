"""The model pipeline on the full evidence of the records. Boosted models, the stack, the refit and the comparison of blends are trained in full.

Model outputs have no SQL form. The queries give what is determined whatever a
model predicts: which rows are scored, in which fold, and that the
probabilities are sound and better than the most frequent class.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from vernissage.functions import fixed
from vernissage.functions.record import RecordFeatures, feature_columns
from vernissage.operators import audit, blend, folds, images, joins, models, vectors
from vernissage.operators import text_vectors as tv
from vernissage.plans import knowledge, views
from vernissage.plans.registry import query
from vernissage.plans.vectors import SIZE, SVD_VECTORS, unit_vectors
from vernissage.plans.views import with_views
from vernissage.session import land, land_once

KEEP = ("id", "y", "split", "fold")
SMALL_FOREST = {"trees": 8, "depth": 5}
THREADS = 5
# Of up to 300 rounds the model keeps those up to the best one; the reference's runs kept 200 to 250.
BOOST = {"rounds": 300, "depth": 9, "step": 0.015, "patience": 150}
STACK_BOOST = {"rounds": 300, "depth": 6, "step": 0.02, "feature_share": "0.8", "patience": 100}
CODES = tuple(f"{f}_code" for f in fixed.CATEGORY_FIELDS)
LEAST_BINS = 32
TEXT_SCORES = 50


def sources(spark, sf):
    return [views.table(spark, sf, n) for n in ("orders", "customer", "documents", "embeddings")]


def text_scores(features, seed=42):
    """(id, svd_*): TF-IDF and SVD learned on training rows, applied to all."""
    texts = features.select("id", "split", F.col("_concat_text").alias("text"))
    fitted, counts = tv.fit_counts(texts.filter("split = 'train'"))
    seen = land(tv.weigh(counts, fitted), "text-rows")
    svd = vectors.TruncatedSvd.fit(seen, fixed.MAX_NGRAMS, TEXT_SCORES, seed=seed)
    others = land(tv.transform(texts.filter("split = 'test'"), fitted), "text-rows")
    return joins.union_rows(svd.scores(seen), svd.scores(others))


def evidence(spark, sf):
    """All evidence of a record that does not depend on the seed; written once.

    Scalar features and category codes, graph evidence, image statistics, vector
    scores (rn_*) and text scores (svd_*), each attached by id.
    """

    def build():
        records = views.artworks(spark, sf, texts=True)
        train = records.filter("split = 'train'")
        wide = land(RecordFeatures.fit(train).apply(records), "record-features")
        seen = wide.filter("split = 'train'")
        coded = folds.encode_categories(wide, seen, fixed.CATEGORY_FIELDS)
        units = unit_vectors(spark, sf)
        sides = (
            knowledge.facts(spark, sf),
            images.image_features(views.spread(views.images(spark, sf, broken=True), "id")),
            vectors.TruncatedSvd.fit(units, SIZE, SVD_VECTORS).scores(units, prefix="rn_"),
            text_scores(wide),
        )
        for side in sides:
            coded = joins.attach_evidence(coded, side)
        return coded.drop("_concat_text")

    return land_once(spark, ("evidence", sf), build, *sources(spark, sf))


def encodings(features, seed):
    """(id, fold, artist_enc_*, artist_ord_*): out of fold for training rows, from all training rows for the others (fold -1).

    The first encoding is written, as the second one reads its rows several times.
    """
    train, test = features.filter("split = 'train'"), features.filter("split = 'test'")
    folded = land(folds.assign_folds(train.select("id", "y", "attribution"), seed), "folds")
    apart = land(folds.out_of_fold_encoding(folded), "fold-encodings")
    whole = land(folds.full_encoding(folded, test.select("id", "attribution")), "test-encodings")
    others = folds.smoothed_encoding(folded, whole)
    return joins.union_rows(
        folds.ordered_encoding(apart, seed).drop("y", "attribution"),
        others.drop("attribution").withColumn("fold", F.lit(-1)),
    )


def encodings_of(spark, sf, seed=42):
    """The encodings of a seed, written once: a narrow table, so that wide rows meet one join only."""

    features = evidence(spark, sf)
    return land_once(spark, ("encodings", sf, seed), lambda: encodings(features.select("id", "y", "split", "attribution"), seed), features)


def evidence_names(features):
    return [c for c in feature_columns(features.columns) if c not in (*fixed.CATEGORY_FIELDS, "split", "attribution")]


def record_matrix(spark, sf, seed=42):
    """Numeric feature table of all records with folds and encodings."""
    features = evidence(spark, sf)
    return features.select("id", "y", "split", *evidence_names(features)).join(encodings_of(spark, sf, seed), "id")


def numeric_names(matrix):
    return [c for c in matrix.columns if c not in KEEP]


def code_sizes(matrix, codes):
    """Categories per code column, from its largest code."""
    top = matrix.agg(*[F.max(c).alias(c) for c in codes]).first()
    return {c: int(top[c]) + 1 for c in codes if top[c] is not None}


def evidence_vectors(spark, sf, linear=False):
    """(rows with the vector `known`, its feature names): what does not depend on the seed, written once for all seeds.

    Records without an id meet no encodings and are left out.
    """
    features = evidence(spark, sf)
    names = evidence_names(features)
    if linear:
        names = [c for c in names if c.startswith(("svd_", "cap_is_"))]

    def build():
        rows = features.filter("id is not null")
        settings = {"missing": 0.0} if linear else {"nominal": code_sizes(rows, CODES)}
        return models.assemble(rows, names, ("id", "y", "split"), name="known", **settings)

    return land_once(spark, ("evidence-vectors", sf, linear), build, features), names


def assembled(spark, sf, seed=42, kind="blend"):
    """(train, test, feature names) as vectors, written once, since every fold and model reads them.

    `blend`: all evidence with encodings. `booster`: encodings replaced by ordered
    statistics, which stand for the attribution as a category of any number of
    values. `linear`: caption flags and text scores, nulls as 0.
    """
    known, names = evidence_vectors(spark, sf, kind == "linear")
    own = {"blend": "artist_enc_", "booster": "artist_ord_"}.get(kind)
    encoded = encodings_of(spark, sf, seed)
    added = [c for c in encoded.columns if own and c.startswith(own)]

    def build():
        rows = known.join(encoded.select("id", "fold", *added), "id")
        return models.assemble(rows, added, KEEP, vectors=["known"])

    rows = land_once(spark, ("vectors", sf, seed, kind), build, known, encoded)
    return rows.filter("split = 'train'"), rows.filter("split = 'test'"), names + added


def assembled_seeds(spark, sf, seeds):
    """`assembled` for each seed. Its many small jobs run at the same time, on evidence that is written before."""
    evidence_vectors(spark, sf)
    return dict(zip(seeds, models.in_threads(lambda seed: assembled(spark, sf, seed), seeds, THREADS), strict=True))


def bins(rows):
    """Bins that cover the nominal feature with the most values, as the vectors' metadata tell."""
    nominal = rows.schema["features"].metadata.get("ml_attr", {}).get("attrs", {}).get("nominal", [])
    return max([LEAST_BINS, *[a["num_vals"] for a in nominal]])


def small_forest(rows, seed=42, **more):
    return models.forest(**{**SMALL_FOREST, **more}, seed=seed, max_bins=bins(rows))


def scored(oof):
    """Each scored row with its fold and what holds for its probabilities; rows are predicted once, as two passes read them."""
    oof = land(oof.select("id", "y", "fold", "probs"), "scored")
    return oof.select("id", "y", "fold", *models.sound(), models.better_than_majority(oof).alias("better_than_majority"))


_SOUND = "cast(8 as int) as n_classes, true as in_range, true as sums_to_one"
SCORED = with_views(f"select id, y, fold, {_SOUND}, true as better_than_majority from folds", "folds")
TESTED = with_views(f"select id, {_SOUND} from test", "test")


@query(
    "training_matrix",
    with_views(
        "select a.id, a.y, a.split, coalesce(f.fold, -1) as fold, 1.0::double as encoded, "
        "e.vec_id is null or e.label = 9 as no_image, e.vec_id is null as no_vector, false as no_text, "
        "coalesce(a.wikidataid, '') = '' as no_graph_key from artworks a left join folds f on f.id = a.id "
        "left join embeddings e on e.vec_id = a.id",
        "artworks", "folds",
    ),
)
def training_matrix(spark, sf):
    """Which evidence each record has in the full matrix."""
    keys = views.artworks(spark, sf).select("id", F.col("wikidataid").isNull().alias("no_graph_key"))
    total = sum((F.col(f"artist_enc_{k}") for k in range(1, fixed.N_CLASSES)), F.col("artist_enc_0"))
    return record_matrix(spark, sf).join(keys, "id").select(
        "id", "y", "split", "fold", F.round(total, 6).alias("encoded"), F.col("img_r_mean").isNull().alias("no_image"),
        F.col("rn_0").isNull().alias("no_vector"), F.col("svd_0").isNull().alias("no_text"), "no_graph_key",
    )


@query("oof_trees", SCORED)
def oof_trees(spark, sf):
    train, _, _ = assembled(spark, sf)
    return scored(models.out_of_fold(train, models.BoostedOneVsRest(**BOOST, max_bins=bins(train)), parallelism=THREADS)[0])


@query("oof_trees_alt", SCORED)
def oof_trees_alt(spark, sf):
    """The second tree model: the attribution as a category by ordered statistics instead of its encoding."""
    train, _, _ = assembled(spark, sf, kind="booster")
    return scored(models.out_of_fold(train, small_forest(train), parallelism=THREADS)[0])


@query("oof_logreg", SCORED)
def oof_logreg(spark, sf):
    train, _, _ = assembled(spark, sf, kind="linear")
    return scored(models.out_of_fold(train, models.elastic_net(iterations=50), parallelism=THREADS)[0])


def stacked(spark, sf):
    """Blocks of three base models next to the meta features, for training rows (out of fold) and test rows (averaged)."""
    fits = {
        "boosted": (lambda rows: models.BoostedOneVsRest(**STACK_BOOST, max_bins=bins(rows)), "blend"),
        "forest": (lambda rows: models.forest(max_bins=bins(rows)), "booster"),
        "linear": (lambda rows: models.elastic_net(), "linear"),
    }
    blocks = {}
    for name, (fit, kind) in fits.items():
        train, test, _ = assembled(spark, sf, kind=kind)
        oof, averaged = models.out_of_fold(train, fit(train), test, parallelism=THREADS)
        blocks[name] = land(oof.select("id", "probs").unionByName(averaged.select("id", "probs")), "stack-block")
    matrix = record_matrix(spark, sf)
    flags = [c for c in matrix.columns if c.startswith("cap_is_")]
    return models.bind_blocks(blocks, matrix.select(*KEEP, *fixed.META_FEATURES, *flags))


def stack_table(spark, sf):
    return land_once(spark, ("stack", sf), lambda: stacked(spark, sf), *sources(spark, sf))


@query(
    "stack_inputs",
    with_views(
        "select a.id, a.y, a.split, coalesce(f.fold, -1) as fold, true as boosted, true as forest, true as linear, "
        "cast(15 as int) as n_meta from artworks a left join folds f on f.id = a.id",
        "artworks", "folds",
    ),
)
def stack_inputs(spark, sf):
    table = stack_table(spark, sf)
    whole = [
        (F.abs(sum((F.col(f"{n}_{k}") for k in range(1, fixed.N_CLASSES)), F.col(f"{n}_0")) - 1) < 1e-6).alias(n)
        for n in ("boosted", "forest", "linear")
    ]
    n_meta = len(table.columns) - len(KEEP) - 3 * fixed.N_CLASSES
    return table.select("id", "y", "split", "fold", *whole, F.lit(n_meta).alias("n_meta"))


def stack_rows(spark, sf):
    table = stack_table(spark, sf)
    rows = land(models.assemble(table, numeric_names(table), KEEP), "stack-vectors")
    return rows.filter("split = 'train'"), rows.filter("split = 'test'")


@query("stack", SCORED)
def stack(spark, sf):
    train, _ = stack_rows(spark, sf)
    return scored(models.out_of_fold(train, models.forest(feature_share="auto"), parallelism=THREADS)[0])


@query("stack_test", TESTED)
def stack_test(spark, sf):
    """Predictions of the stack for test rows, averaged over the folds."""
    train, test = stack_rows(spark, sf)
    fit = models.forest(feature_share="auto")
    return models.out_of_fold(train, fit, test, parallelism=THREADS)[1].select("id", *models.sound())


@query("refit_full", TESTED)
def refit_full(spark, sf):
    """All training rows, as many rounds as the folds' best ones say; nothing is held back."""
    train, test, _ = assembled(spark, sf)
    most = bins(train)
    fit = models.BoostedOneVsRest(**BOOST, max_bins=most)
    models.out_of_fold(train, fit, parallelism=THREADS)
    settings = {**BOOST, "rounds": models.refit_rounds(fit.rounds_used)}
    longer = models.BoostedOneVsRest(**settings, max_bins=most, stop_early=False)
    return longer(train)(test).select("id", *models.sound())


def seed_predictions(spark, sf, seeds=fixed.BLEND_SEEDS):
    """Out-of-fold and test predictions of the final model for each seed: (id, y, seed, probs); y is null for test rows."""

    def build():
        parts = []
        for seed, (train, test, _) in assembled_seeds(spark, sf, seeds).items():
            oof, averaged = models.out_of_fold(train, small_forest(train, seed, trees=5), test, parallelism=THREADS)
            parts += [
                oof.select("id", "y", F.lit(seed).alias("seed"), "probs"),
                averaged.select("id", F.lit(None).cast("int").alias("y"), F.lit(seed).alias("seed"), "probs"),
            ]
        return joins.union_rows(*parts)

    return land_once(spark, ("seed-predictions", sf, tuple(seeds)), build, *sources(spark, sf))


def blended(spark, sf):
    """(id, pred, conf, probs) from the mean over folds and seeds, for training and test rows."""
    mean = blend.average_probabilities(seed_predictions(spark, sf))
    return mean.select("id", blend.predicted_class("probs").alias("pred"), blend.confidence("probs").alias("conf"), "probs")


@query("blend_scored", with_views(f"select id, y, {_SOUND}, true as better_than_majority from train", "train"))
def blend_scored(spark, sf):
    """Out-of-fold blend of the three seeds on the full matrix."""
    rows = views.train_rows(spark, sf).select("id", "y").join(blended(spark, sf), "id")
    return rows.select("id", "y", *models.sound(), models.better_than_majority(rows).alias("better_than_majority"))


@query(
    "blend_accuracy",
    with_views(
        "select cast(coalesce(cap_y = y, false) as int) as agrees, count(*) as n, true as in_range from captions "
        "where split = 'train' group by 1",
        "captions",
    ),
)
def blend_accuracy(spark, sf):
    """Rows and accuracy range of the blend where the caption agrees with the label, and where not."""
    rows = audit.with_weak_label(views.train_rows(spark, sf)).join(blended(spark, sf), "id")
    return audit.slice_accuracy(rows).select("agrees", "n", F.col("accuracy").between(0, 1).alias("in_range"))


@query("blend_submission", with_views("select id, true as in_range from test", "test"))
def blend_submission(spark, sf):
    """One class per test row from real predictions."""
    chosen = views.test_rows(spark, sf).select("id").join(blended(spark, sf), "id")
    return audit.submission(chosen).select("id", F.col("y").between(0, fixed.N_CLASSES - 1).alias("in_range"))


@query(
    "blend_compare",
    "select * from (values ('three', cast(3 as int), true), ('five', cast(5 as int), true)) t(blend, n_seeds, in_range)",
)
def blend_compare(spark, sf):
    by_seed = {}
    for seed, (train, _, _) in assembled_seeds(spark, sf, fixed.WIDE_BLEND_SEEDS).items():
        oof = models.out_of_fold(train, models.forest(seed=seed, max_bins=bins(train)), parallelism=THREADS)[0]
        by_seed[seed] = land(oof.select("id", "y", "probs"), "oof")
    found = models.compare_blends(by_seed, {"three": fixed.BLEND_SEEDS, "five": fixed.WIDE_BLEND_SEEDS})
    return found.select("blend", "n_seeds", (F.col("accuracy").between(0, 1)).alias("in_range"))


@query(
    "model_overrides",
    with_views("select count(*) as n_rows, true as few_enough, true as contradict, true as confident from test", "test"),
)
def model_overrides(spark, sf):
    """Confident contradictions of the caption by real test predictions."""
    records = audit.with_weak_label(views.test_rows(spark, sf, texts=True)).join(blended(spark, sf).drop("probs"), "id")
    found = audit.overrides(records)
    marked = records.select("id").join(found.select("id", F.lit(True).alias("over")), "id", "left").join(
        records.select("id", "cap_y", "pred", "conf"), "id"
    )
    over = F.col("over").isNotNull()
    return marked.agg(
        F.count(F.lit(1)).alias("n_rows"), (F.count_if(over) <= F.count(F.lit(1))).alias("few_enough"),
        F.bool_and(~over | ~F.col("cap_y").eqNullSafe(F.col("pred"))).alias("contradict"),
        F.bool_and(over == (~F.col("cap_y").eqNullSafe(F.col("pred")) & (F.col("conf") > fixed.OVERRIDE_CONFIDENCE))).alias("confident"),
    )


@query("feature_importance", "select cast(15 as bigint) as n_features, true as named, true as shares, true as accurate")
def feature_importance(spark, sf):
    """Fifteen most important features for one class and what shuffling each one costs."""
    train, _, names = assembled(spark, sf)
    found = models.importance_for_class(train, names, target=7, top=15, trees=12, depth=6, max_bins=bins(train))
    return found.agg(
        F.count_distinct("feature").alias("n_features"), F.bool_and(F.col("feature").isin(names)).alias("named"),
        F.bool_and(F.col("importance").between(0, 1)).alias("shares"),
        F.bool_and(F.col("accuracy").between(0, 1) & F.col("permuted").between(0, 1)).alias("accurate"),
    )
