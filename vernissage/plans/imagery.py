"""Image statistics over the pixel stand-in."""

from __future__ import annotations

from pyspark.sql import functions as F

from vernissage.functions import fixed
from vernissage.operators import images
from vernissage.plans import views
from vernissage.plans.registry import query
from vernissage.plans.views import with_views

_N = "count(*)"


def _mean(total: str, scale: str) -> str:
    return f"cast({total} as double) / (count(*) * {scale}::double)"


def _std(value: str, scale: str) -> str:
    s, q, n = f"cast(sum({value}) as double)", f"cast(sum({value}::bigint * {value}) as double)", "cast(count(*) as double)"
    return f"round(sqrt(greatest({n} * {q} - {s} * {s}, 0.0)) / (count(*) * {scale}::double), 6)"


STATS = {}
for _c in "rgb":
    STATS[f"img_{_c}_mean"] = _mean(f"sum({_c})", "255.0")
    STATS[f"img_{_c}_std"] = _std(_c, "255.0")
CHANNELS = tuple(STATS)
_HIGH, _LOW = "greatest(r, g, b)", "least(r, g, b)"
STATS |= {
    "img_brightness": _mean(f"sum({_HIGH})", "255.0"),
    "img_saturation": f"round(avg((({_HIGH} - {_LOW}) / 255.0::double) / ({_HIGH} / 255.0::double + 1e-7)), 6)",
    "img_contrast": _std("gray", "255000.0"),
    "img_black_frac": "count(*) filter (where gray < 25500) / count(*)",
    "img_white_frac": "count(*) filter (where gray > 229500) / count(*)",
    "img_warmth": _mean("sum(r - b)", "255.0"),
}
TONES = tuple(n for n in STATS if n not in CHANNELS)
STATS |= {
    f"img_{c}_h{k}": f"count(*) filter (where {c} // 32 = {k}) / (count(*) * 32)" for c in "rgb" for k in range(8)
}
HISTOGRAMS = tuple(n for n in STATS if "_h" in n)
STATS["img_gray_mean"] = _mean("sum(gray)", "255000.0")
STATS |= {
    f"img_gray_p{p}": f"round(quantile_cont(gray, {p / 100}) / 255000.0::double, 6)" for p in fixed.GRAY_PERCENTILES
}
GRAYS = tuple(n for n in STATS if n.startswith("img_gray"))
EDGE = (
    "select id, (cast(sum(abs(down)) as double) / count(down) + cast(sum(abs(across)) as double) / count(across)) "
    "/ 2 / 255000.0::double as img_edge_mean from (select id, "
    "gray - lag(gray) over (partition by id, px order by py) as down, "
    "gray - lag(gray) over (partition by id, py order by px) as across from grays) group by id"
)


def _check(names) -> str:
    return with_views("select id, " + ", ".join(f"{STATS[n]} as {n}" for n in names) + " from grays group by id", "grays")


# Values that are not quotients of whole numbers are rounded for the comparison.
ROUNDED = {
    *(n for n in images.CHANNEL_NAMES if n.endswith("_std")), "img_saturation", "img_contrast",
    *(n for n in images.GRAY_NAMES if "_p" in n),
}


def features(spark, sf, names):
    found = images.image_features(views.images(spark, sf), side=None)
    return found.select("id", *[F.round(n, 6).alias(n) if n in ROUNDED else F.col(n) for n in names])


@query("img_channel_stats", _check(CHANNELS))
def img_channel_stats(spark, sf):
    return features(spark, sf, images.CHANNEL_NAMES)


@query("img_tone", _check(TONES))
def img_tone(spark, sf):
    return features(spark, sf, images.TONE_NAMES)


@query("img_histogram", _check(HISTOGRAMS))
def img_histogram(spark, sf):
    return features(spark, sf, images.HISTOGRAM_NAMES)


@query("img_gray_percentiles", _check(GRAYS))
def img_gray_percentiles(spark, sf):
    return features(spark, sf, images.GRAY_NAMES)


@query("img_edge", with_views(EDGE, "grays"))
def img_edge(spark, sf):
    return features(spark, sf, ("img_edge_mean",))


_ALL = (
    "select s.*, img_edge_mean from (select id, " + ", ".join(f"{e} as {n}" for n, e in STATS.items())
    + f" from grays group by id) s join ({EDGE}) using (id)"
)


@query("image_features", with_views(_ALL, "grays"))
def image_features(spark, sf):
    return features(spark, sf, images.FEATURE_NAMES)


# Enlarging 8x8 images to 64x64 repeats every pixel, so only the edges differ from the source's.
_LARGE = (
    "select id, r, g, b, 299 * r + 587 * g + 114 * b as gray, px * 8 + dx as px, py * 8 + dy as py from pixels "
    "cross join (select unnest(range(8)) as dx) cross join (select unnest(range(8)) as dy)"
)


@query(
    "image_evidence",
    with_views("select * from (with grays as (" + _LARGE + ") " + _ALL + ") where id not in (select vec_id from embeddings where label = 9)"
               + " union all by name select vec_id as id from embeddings where label = 9", "pixels"),
)
def image_evidence(spark, sf):
    """The 43 statistics as the pipeline uses them: resized to the standard side, unreadable images as nulls."""
    found = images.image_features(views.images(spark, sf, broken=True))
    return found.select("id", *[F.round(n, 6).alias(n) if n in ROUNDED else F.col(n) for n in images.FEATURE_NAMES])


def _resized_sql(side: int) -> str:
    levels = ", ".join(f"cast(floor((sum({c}) * 2 + count(*)) // (count(*) * 2)) as int) as {c}" for c in "rgb")
    return (
        f"select id, cast(px * {side} // 8 as int) as px, cast(py * {side} // 8 as int) as py, {levels} "
        f"from pixels group by 1, 2, 3"
    )


@query("img_resize", with_views(_resized_sql(4), "pixels"))
def img_resize(spark, sf):
    return images.cells(images.resized(views.images(spark, sf), 4))


def _cubic_sql(cell: str, pixel: str, shrink: float) -> str:
    """Unscaled cubic weight of a pixel for a cell of an axis that shrinks `shrink` times."""
    t = f"(abs({pixel} + 0.5 - ({cell} + 0.5) * {shrink}::double) / {shrink}::double)"
    return (
        f"case when {t} < 1 then 1.5 * {t} * {t} * {t} - 2.5 * {t} * {t} + 1 "
        f"when {t} < 2 then -0.5 * {t} * {t} * {t} + 2.5 * {t} * {t} - 4 * {t} + 2 else 0.0 end"
    )


def _kernel_sql(side: int) -> str:
    def axis(cell: str, pixel: str, weight: str) -> str:
        return (
            f"(select {cell}, {pixel}, {_cubic_sql(cell, pixel, 8 / side)} as {weight} "
            f"from (select unnest(range({side})) as {cell}) cross join (select unnest(range(8)) as {pixel}))"
        )

    level = "cast(least(255, greatest(0, floor(round(sum(wx * wy * {c}) / sum(wx * wy), 6) + 0.5))) as int) as {c}"
    return (
        f"select id, cast(x as int) as px, cast(y as int) as py, {', '.join(level.format(c=c) for c in 'rgb')} "
        f"from pixels join {axis('x', 'xp', 'wx')} on px = xp join {axis('y', 'yp', 'wy')} on py = yp group by id, x, y"
    )


@query("img_resize_kernel", with_views(_kernel_sql(3), "pixels"))
def img_resize_kernel(spark, sf):
    """Antialiased cubic resampling inside the image row."""
    return images.cells(images.resized(views.images(spark, sf), 3, method="cubic"))


@query(
    "img_enlarge",
    with_views(
        "select id, cast(x as int) as px, cast(y as int) as py, r, g, b from pixels cross join (select unnest(range(20)) as x) "
        "cross join (select unnest(range(20)) as y) where px = x * 8 // 20 and py = y * 8 // 20",
        "pixels",
    ),
)
def img_enlarge(spark, sf):
    return images.cells(images.resized(views.images(spark, sf), 20))


@query(
    "center_crop",
    with_views(
        f"select id, px - 1 as px, py - 1 as py, r, g, b from ({_resized_sql(4)}) "
        "where px between 1 and 2 and py between 1 and 2",
        "pixels",
    ),
)
def center_crop(spark, sf):
    return images.cells(images.resized(views.images(spark, sf), 4, keep_aspect=True, crop=2))


@query(
    "pixel_standardise",
    with_views(
        "select id, px, py, "
        + ", ".join(
            f"round(({c} / 255.0::double - {m}::double) / {s}::double, 6) as {c}_std"
            for c, m, s in zip("rgb", fixed.CHANNEL_MEAN, fixed.CHANNEL_STD, strict=True)
        )
        + " from pixels",
        "pixels",
    ),
)
def pixel_standardise(spark, sf):
    tensors = images.model_inputs(views.images(spark, sf), 8, 8).select("id", F.lit(8).alias("w"), F.lit(8).alias("h"), "tensor")
    found = images.cells(tensors, values="tensor")
    return found.select("id", "px", "py", *[F.round(c, 6).alias(f"{c}_std") for c in "rgb"])
