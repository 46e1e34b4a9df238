"""Scans, sinks, joins, profiles and samples over the record table."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from vernissage.functions import caption, category, fixed, numeric, physical
from vernissage.operators import audit, blend, images, joins, knowledge, profile, ranking
from vernissage.plans import views
from vernissage.plans.registry import query
from vernissage.plans.views import with_views
from vernissage.session import fresh_path
from vernissage.sources import bindings as answers
from vernissage.sources import fetch, files, records
from vernissage.sources import images as image_source

SCANNED = ("id", "y", "cap", "y0", "dim", "acc_id", "note", "t", "split")
SCAN_SCHEMA = T.StructType(
    [
        T.StructField(
            c,
            T.LongType() if c == "id" else T.IntegerType() if c == "y"
            else T.DoubleType() if c == "y0" else T.StringType(),
        )
        for c in SCANNED
    ]
)


_YEAR = "case id % 4 when 0 then '3d' when 1 then cast(id % 1900 as string) || 'f' when 2 then ' ' || cast(id % 1900 as string) || '.50' else cast(y0 as string) end"
_CLASS = "case id % 3 when 0 then cast(y as string) || '.0' when 1 then cast(y as string) else cast(y as string) || '.5' end"


@query(
    "scan_records",
    with_views(
        "select id, case id % 3 when 2 then null else y end as y, cap, "
        "case id % 4 when 2 then (id % 1900) + 0.5::double when 3 then y0 end as y0, "
        + ", ".join(c for c in SCANNED if c not in ("id", "y", "cap", "y0")) + " from artworks",
        "artworks",
    ),
)
def scan_records(spark, sf):
    """Files with different column orders, whole numbers written with a point, and text that only looks like a number."""
    path = fresh_path(spark, "records-csv")
    rows = views.artworks(spark, sf, texts=True).withColumns({"y0": F.expr(_YEAR), "y": F.expr(_CLASS)})
    records.write_csv(rows.filter("split = 'train'").select(*SCANNED), f"{path}/part=1")
    records.write_csv(rows.filter("split <> 'train'").select(*reversed(SCANNED)), f"{path}/part=2")
    return records.read_records(spark, f"{path}/*", SCAN_SCHEMA)


@query("sink_roundtrip", with_views("select id, pred as y from decided join artworks using (id) where split = 'test'", "decided", "artworks"))
def sink_roundtrip(spark, sf):
    chosen = blend.decide(blend.average_probabilities(views.predictions(spark, sf).filter("split = 'test'")))
    path = fresh_path(spark, "submission-csv")
    records.write_csv(audit.submission(chosen), path)
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("y", T.IntegerType())])
    return records.read_records(spark, path, schema)


@query("preds_roundtrip", with_views("select id, cast(k as int) as k, round(p, 6) as p from blend", "blend"))
def preds_roundtrip(spark, sf):
    path = fresh_path(spark, "predictions")
    records.write_predictions(blend.average_probabilities(views.predictions(spark, sf)), path)
    long = records.read_predictions(spark, path).select("id", F.posexplode("probs").alias("k", "p"))
    return long.withColumn("p", F.round("p", 6))


@query("preds_archive", with_views("select id, cast(k as int) as k, round(p, 6) as p from blend", "blend"))
def preds_archive(spark, sf):
    """The blended predictions through archives of numpy arrays."""
    path = fresh_path(spark, "archive")
    files.write_archive(blend.average_probabilities(views.predictions(spark, sf)), path)
    long = files.read_archive(spark, path).select("id", F.posexplode("probs").alias("k", "p"))
    return long.withColumn("p", F.round("p", 6))


_MEANS = tuple(f"img_{c}_mean" for c in "rgb")


@query(
    "image_scan_nulls",
    with_views(
        "select e.vec_id as id, sum(r) / (count(*) * 255.0::double) as img_r_mean, "
        "sum(g) / (count(*) * 255.0::double) as img_g_mean, sum(b) / (count(*) * 255.0::double) as img_b_mean "
        "from embeddings e left join pixels p on p.id = e.vec_id and e.label <> 9 group by 1",
        "pixels",
    ),
)
def image_scan_nulls(spark, sf):
    """Image files, some of them broken, are written and scanned again."""
    made, path = views.images(spark, sf, broken=True), fresh_path(spark, "images")
    image_source.write_images(made, path)
    scanned = image_source.read_written_images(spark, path)
    found = images.image_features(scanned, side=None).select(F.col("id").cast("long").alias("id"), *_MEANS)
    return image_source.with_image_features(made, found)


@query(
    "pending_fetch",
    with_views(
        "select id from artworks where id not in (select id from attempts where ok)", "artworks", "attempts"
    ),
)
def pending_fetch(spark, sf):
    return fetch.pending(views.artworks(spark, sf).select("id"), views.attempts(spark, sf))


@query(
    "fetch_summary",
    with_views("select count(*) as n_total, count(*) filter (where ok) as n_ok from attempts", "attempts"),
)
def fetch_summary(spark, sf):
    return fetch.outcome_summary(views.attempts(spark, sf))


@query(
    "batch_plan",
    with_views(
        "select id, wikidataid, position, cast(floor(position / 80) as bigint) as batch from ("
        "select id, wikidataid, row_number() over (order by id nulls last) - 1 as position from ("
        "select case when id % 211 <> 0 then id end as id, case when id % 211 <> 0 then wikidataid end as wikidataid "
        "from artworks where wikidataid is not null))",
        "artworks",
    ),
)
def batch_plan(spark, sf):
    """Some requests of the work list have lost their id."""
    wanted = views.artworks(spark, sf).filter("wikidataid is not null")
    known = F.col("id") % 211 != 0
    return fetch.batches(wanted.select(F.when(known, F.col("id")).alias("id"), F.when(known, F.col("wikidataid")).alias("wikidataid")), rows_per_bucket=2000)


@query("decode_bindings", with_views("select item, label from bindings", "bindings"))
def decode_bindings(spark, sf):
    binding = F.struct(
        F.struct(F.col("item").alias("value")).alias("item"),
        F.struct(F.col("matlabel").alias("value")).alias("matLabel"),
    )
    answer = F.to_json(F.struct(F.struct(F.array(binding).alias("bindings")).alias("results")))
    return answers.decode_answers(views.raw_bindings(spark, sf).select(answer.alias("answer")))


@query(
    "align_schema",
    with_views(
        "select id, split, y, n_dim_lines from (select id, split, y, "
        "cast(coalesce(len(regexp_extract_all(dim, '\\r\\n')), 0) + 1 as int) as n_dim_lines from train "
        "union all select id, split, 0, 0 from test)",
        "train", "test",
    ),
)
def align_schema(spark, sf):
    lines = physical.dimension_vocabulary()[-1]
    train = views.train_rows(spark, sf).select("id", "split", "y", lines)
    test = views.test_rows(spark, sf).select("split", "id")
    return joins.union_rows(train, joins.align_columns(test, train.columns))


_NUMBER = "case when regexp_matches({0}, '" + fixed.NUMBER_PATTERN + "') then try_cast({0} as double) end"


@query(
    "numeric_coerce",
    with_views(
        "select id, " + _NUMBER.format("acc_id") + " as acc_number, "
        + _NUMBER.format("split_part(visualbrowserclassification, '-', 1)") + " as rank_number, "
        + _NUMBER.format("visualbrowserclassification") + " as text_number from artworks",
        "artworks",
    ),
)
def numeric_coerce(spark, sf):
    return views.artworks(spark, sf).select(
        "id",
        numeric.to_number("acc_id").alias("acc_number"),
        numeric.to_number(F.split_part("visualbrowserclassification", F.lit("-"), F.lit(1))).alias("rank_number"),
        numeric.to_number("visualbrowserclassification").alias("text_number"),
    )


@query(
    "filter_has_evidence",
    with_views(
        "select id, wikidataid, cap_y from captions where wikidataid is not null and cap_y is not null "
        "and cap_y <> y",
        "captions",
    ),
)
def filter_has_evidence(spark, sf):
    rows = audit.with_weak_label(views.artworks(spark, sf))
    kept = rows.filter(F.col("wikidataid").isNotNull() & F.col("cap_y").isNotNull() & (F.col("cap_y") != F.col("y")))
    return kept.select("id", "wikidataid", "cap_y")


@query("union_splits", with_views("select id, wikidataid, split from train union all select id, wikidataid, split from test", "train", "test"))
def union_splits(spark, sf):
    columns = ["id", "wikidataid", "split"]
    return joins.union_rows(
        views.train_rows(spark, sf).select(*columns), views.test_rows(spark, sf).select(*columns)
    )


@query(
    "join_inner",
    with_views(
        "select t.id, y, vec_id as evidence_id, label from train t join embeddings on vec_id = t.id", "train"
    ),
)
def join_inner(spark, sf):
    side = views.embeddings(spark, sf).select("id", F.col("id").alias("evidence_id"), "label")
    return views.train_rows(spark, sf).select("id", "y").join(side, "id")


_SIDE_SQL = (
    "select id, sum(r) / (count(*) * 255.0::double) as img_r_mean, sum(g) / (count(*) * 255.0::double) as img_g_mean, "
    "sum(b) / (count(*) * 255.0::double) as img_b_mean from pixels group by id"
)


def _image_side(spark, sf):
    return images.image_features(views.images(spark, sf), side=None).select("id", *_MEANS)


@query(
    "attach_external",
    with_views(
        f"select a.id, a.split, img_r_mean, img_g_mean, img_b_mean from artworks a left join ({_SIDE_SQL}) using (id)",
        "artworks", "pixels",
    ),
)
def attach_external(spark, sf):
    """A side table from files, attached by its unique id."""
    base = views.artworks(spark, sf).select("id", "split")
    path = fresh_path(spark, "image-side")
    records.write_table(_image_side(spark, sf), path)
    return joins.attach_evidence(base, records.read_side_table(spark, path))


@query(
    "semi_filter",
    with_views(f"select s.* from ({_SIDE_SQL}) s where id in (select id from train)", "train", "pixels"),
)
def semi_filter(spark, sf):
    return joins.restrict_to(_image_side(spark, sf), views.train_rows(spark, sf))


@query(
    "label_recode",
    with_views(
        "select id, cap_med, coalesce(cap_y, -1) as cap_y_int, cap_y is not null as known from captions", "captions"
    ),
)
def label_recode(spark, sf):
    return views.artworks(spark, sf).withColumn("cap_med", caption.caption_medium()).select(
        "id",
        "cap_med",
        caption.label_code_or_minus_one(F.col("cap_med")).alias("cap_y_int"),
        caption.label_code(F.col("cap_med")).isNotNull().alias("known"),
    )


@query(
    "sample_every_k",
    with_views(
        "select id, y, cap from (select *, row_number() over (order by id) - 1 as p from train) where p % 20 = 0",
        "train",
    ),
)
def sample_every_k(spark, sf):
    rows = views.train_rows(spark, sf).select("id", "y", "cap")
    return ranking.every_kth(rows, 20, rows_per_bucket=3000)


@query("prefix_n", with_views("select id, y, cap, dim from train order by id limit 500", "train"))
def prefix_n(spark, sf):
    return profile.prefix(views.train_rows(spark, sf).select("id", "y", "cap", "dim"), 500)


@query("class_counts", with_views("select y, count(*) as n from train group by y", "train"))
def class_counts(spark, sf):
    return profile.frequency(views.train_rows(spark, sf), "y")


@query(
    "class_balance",
    with_views("select min(n) as smallest, max(n) as largest from (select count(*) as n from train group by y)", "train"),
)
def class_balance(spark, sf):
    return class_counts(spark, sf).agg(F.min("n").alias("smallest"), F.max("n").alias("largest"))


@query(
    "frame_rate_by_class",
    with_views(
        "select y, round(avg(cast(contains(lower(coalesce(dim, '')), 'framed') as int)), 3) as frame_rate "
        "from train group by y",
        "train",
    ),
)
def frame_rate_by_class(spark, sf):
    framed = views.train_rows(spark, sf).select("y", *physical.dimension_vocabulary())
    return profile.group_mean(framed, "y", "has_frame", 3, "frame_rate")


PROFILED = (
    "cap", "y0", "y1", "dim", "attribution", "classification", "viewtype", "dimensiontype", "t", "txt", "tag",
    "note", "inscription", "creditline", "assistivetext", "volume", "eff", "subclassification", "watermarks",
    "markings", "portfolio", "series", "wikidataid", "cat", "acc_id", "width", "height", "element",
)


@query(
    "null_profile",
    with_views(
        "select column_name, null_pct from ("
        + " union all ".join(
            f"select '{c}' as column_name, count(*) filter (where {c} is null) * 100.0::double / count(*) as null_pct from train"
            for c in PROFILED
        )
        + ") order by null_pct desc, column_name limit 25",
        "train",
    ),
)
def null_profile(spark, sf):
    return profile.null_profile(views.train_rows(spark, sf, texts=True), PROFILED, top=25)


MASKED = ("volume", "eff", "series", "txt", "tag", "note", "dim", "attribution")


@query(
    "null_mask_sample",
    with_views(
        "select id, " + ", ".join(f"cast({c} is null as int) as {c}_null" for c in MASKED)
        + " from (select *, row_number() over (order by id) - 1 as p from train) where p % 20 = 0",
        "train",
    ),
)
def null_mask_sample(spark, sf):
    rows = views.train_rows(spark, sf).select("id", *MASKED)
    return profile.null_mask(ranking.every_kth(rows, 20, rows_per_bucket=3000), MASKED)


@query(
    "any_null_rows",
    with_views(
        "select count(*) filter (where y0 is null or dim is null or attribution is null) as n_any_null, "
        "count(*) as n_rows from artworks",
        "artworks",
    ),
)
def any_null_rows(spark, sf):
    return profile.rows_with_any_null(views.artworks(spark, sf), ["y0", "dim", "attribution"])


@query(
    "year_quartiles",
    with_views(
        "select y, quantile_cont(y0, 0.25) as q25, quantile_cont(y0, 0.5) as q50, quantile_cont(y0, 0.75) as q75 "
        "from train group by y",
        "train",
    ),
)
def year_quartiles(spark, sf):
    return profile.quantiles_by_group(
        views.train_rows(spark, sf), "y", "y0", (0.25, 0.5, 0.75), ("q25", "q50", "q75")
    )


_TOKENS_SQL = (
    "select id, trim(token) as token from (select id, unnest(string_split(cat, '|')) as token from artworks) "
    "where trim(token) <> ''"
)


@query("category_tokens", with_views(_TOKENS_SQL, "artworks"))
def category_tokens(spark, sf):
    return category.category_tokens(views.artworks(spark, sf), keep=["id"])


@query(
    "materials_per_item",
    with_views(
        "select a.id, a.wikidataid, coalesce(string_agg(label, '|' order by label), '') as wd_materials, "
        "count(label) as n_materials from artworks a left join bindings b on b.item = a.wikidataid group by 1, 2",
        "artworks", "bindings",
    ),
)
def materials_per_item(spark, sf):
    return knowledge.materials_of_records(views.artworks(spark, sf), views.bindings(spark, sf), unique=True)


@query(
    "fill_policies",
    with_views(
        "select id, coalesce(note, '') as note, "
        + ", ".join(f"coalesce({c}, 'MISSING') as {c}" for c in (*fixed.CATEGORY_FIELDS, "attribution"))
        + ", y0 as y0_tree, cast(y0 is not null as int) as y0_present, coalesce(y0, -9999) as y0_sentinel, "
        "coalesce(y0, 0) as y0_linear from artworks",
        "artworks",
    ),
)
def fill_policies(spark, sf):
    return views.artworks(spark, sf).select(
        "id",
        numeric.fill("note", "").alias("note"),
        *category.filled_categories([*fixed.CATEGORY_FIELDS, "attribution"]),
        F.col("y0").alias("y0_tree"),
        numeric.present("y0").alias("y0_present"),
        numeric.fill("y0", fixed.MISSING_NUMBER).alias("y0_sentinel"),
        numeric.fill("y0", 0.0).alias("y0_linear"),
    )


@query(
    "table_shape",
    with_views(
        "select count(*) as n_rows, (select cast(count(*) as int) from (describe (select * from artworks))) as n_columns "
        "from artworks",
        "artworks",
    ),
)
def table_shape(spark, sf):
    return profile.shape(views.artworks(spark, sf))
