"""Embedding queries: inference, zero fill, normalisation, SVD."""

from __future__ import annotations

from pyspark.sql import functions as F

from vernissage.functions import fixed
from vernissage.operators import images, vectors
from vernissage.operators import text_vectors as tv
from vernissage.plans import text, views
from vernissage.plans.registry import query
from vernissage.plans.views import with_views
from vernissage.session import land

SIZE = 64
SVD_TEXT, SVD_VECTORS = 50, 32


def pooling_model():
    """Stand-in for a caller's model: mean of each run of eight inputs."""
    return lambda inputs: inputs.reshape(len(inputs), 8, 8).mean(axis=2)


@query(
    "batch_inference",
    "select vec_id as id, cast(k as int) as k, round((select avg(cast(x as double)) from "
    "(select unnest(embedding[k * 8 + 1 : k * 8 + 8]) as x)), 6) as v "
    "from embeddings cross join (select unnest(range(8)) as k)",
)
def batch_inference(spark, sf):
    model = vectors.batch_inference(pooling_model, SIZE)
    rows = views.embeddings(spark, sf).select("id", model("vec").alias("v"))
    return rows.select("id", F.posexplode("v").alias("k", "v")).withColumn("v", F.round("v", 6))


def channel_means():
    """Stand-in for a caller's model on a crop of 4x4 cells: the mean of each channel."""
    return lambda inputs: inputs.reshape(len(inputs), 16, 3).mean(axis=1)


_STANDARD = ", ".join(
    f"avg(({c} / 255.0::double - {m}::double) / {s}::double) as v{k}"
    for k, (c, m, s) in enumerate(zip("rgb", fixed.CHANNEL_MEAN, fixed.CHANNEL_STD, strict=True))
)


@query(
    "image_vectors",
    with_views(
        "select vec_id as id, cast(k as int) as k, round(coalesce(case k when 0 then v0 when 1 then v1 else v2 end "
        "/ sqrt(v0 * v0 + v1 * v1 + v2 * v2), 0), 6) as v from embeddings left join ("
        f"select id, {_STANDARD} from pixels where px between 2 and 5 and py between 2 and 5 group by id) i "
        "on i.id = vec_id and label <> 9 cross join (select unnest(range(3)) as k)",
        "pixels",
    ),
)
def image_vectors(spark, sf):
    """Image rows to model vectors: resize, crop, standardise, infer, zeros for failed images, unit length."""
    scanned = views.images(spark, sf, broken=True)
    inputs = images.model_inputs(scanned, 8, 4).filter("tensor is not null")
    model = vectors.batch_inference(channel_means, 48)
    found = inputs.select("id", model(F.col("tensor").cast("array<double>")).alias("vec"))
    filled = vectors.with_zero_vectors(scanned.select("id"), found, 3)
    unit = filled.select("id", vectors.l2_normalised().alias("v"))
    return unit.select("id", F.posexplode("v").alias("k", "v")).withColumn("v", F.round("v", 6))


@query(
    "zero_vector_fill",
    "select doc_id as id, cast(k as int) as k, coalesce(cast(embedding[k + 1] as double), 0) as v "
    "from documents left join embeddings on vec_id = doc_id cross join (select unnest(range(64)) as k)",
)
def zero_vector_fill(spark, sf):
    ids = views.table(spark, sf, "documents").select(F.col("doc_id").alias("id"))
    filled = vectors.with_zero_vectors(ids, views.embeddings(spark, sf).select("id", "vec"), SIZE)
    return filled.select("id", F.posexplode("vec").alias("k", "v"))


@query(
    "l2_normalise",
    "select vec_id as id, cast(k as int) as k, round(cast(embedding[k + 1] as double) / norm, 6) as v from "
    "(select *, sqrt((select sum(cast(x as double) * x) from (select unnest(embedding) as x))) as norm from embeddings) "
    "cross join (select unnest(range(64)) as k)",
)
def l2_normalise(spark, sf):
    unit = views.embeddings(spark, sf).select("id", vectors.l2_normalised().alias("v"))
    return unit.select("id", F.posexplode("v").alias("k", "v")).withColumn("v", F.round("v", 6))


def unit_vectors(spark, sf):
    """Unit vectors, written once: fitting and scoring both read them."""
    return land(views.embeddings(spark, sf).select("id", vectors.l2_normalised().alias("vec")), "unit-vectors")


def score_columns(fitted, prefix):
    return [F.col(f"{prefix}{i}") for i in range(fitted.components.shape[1])]


@query("embedding_svd", f"select vec_id as id, 1.0::double as energy, cast({SIZE} as int) as n_scores from embeddings")
def embedding_svd(spark, sf):
    """With as many scores as inputs the scores keep the length of every row."""
    rows = unit_vectors(spark, sf)
    fitted = vectors.TruncatedSvd.fit(rows, SIZE, SIZE)
    scores = score_columns(fitted, "rn_")
    energy = F.round(sum((c * c for c in scores[1:]), scores[0] * scores[0]), 6)
    return fitted.scores(rows, prefix="rn_").select("id", energy.alias("energy"), F.lit(len(scores)).alias("n_scores"))


@query("svd_explained", f"select count(*) as n_rows, cast({SIZE} as int) as k, 1.0::double as explained_ratio, true as less_with_fewer from embeddings")
def svd_explained(spark, sf):
    """All variance with as many scores as inputs, less with fewer."""
    rows = unit_vectors(spark, sf)
    whole, part = (vectors.TruncatedSvd.fit(rows, SIZE, k) for k in (SIZE, SVD_VECTORS))
    return rows.agg(F.count(F.lit(1)).alias("n_rows")).select(
        "n_rows", F.lit(SIZE).alias("k"), F.lit(round(whole.explained_ratio, 6)).alias("explained_ratio"),
        F.lit(0 < part.explained_ratio < whole.explained_ratio).alias("less_with_fewer"),
    )


@query("text_svd", f"select doc_id as id, cast({SVD_TEXT} as int) as n_scores, true as within_row, true as orthogonal from documents")
def text_svd(spark, sf):
    """Scores never exceed a row's length (1 here), and the score columns are orthogonal."""
    fitted, counts = tv.fit_counts(text.documents(spark, sf))
    rows = land(tv.weigh(counts, fitted), "text-rows")
    svd = vectors.TruncatedSvd.fit(rows, fixed.MAX_NGRAMS, SVD_TEXT)
    scored = land(svd.scores(rows), "text-scores")
    c = score_columns(svd, "svd_")
    products = scored.agg(*[F.sum(c[i] * c[j]).alias(f"p{i}_{j}") for i in range(4) for j in range(i + 1)]).first()
    crossed = max(abs(products[f"p{i}_{j}"]) for i in range(4) for j in range(i))
    orthogonal = crossed <= 1e-6 * max(products["p0_0"], 1.0)
    energy = sum((x * x for x in c[1:]), c[0] * c[0])
    return scored.select("id", F.lit(len(c)).alias("n_scores"), (energy <= 1 + 1e-9).alias("within_row"), F.lit(orthogonal).alias("orthogonal"))
