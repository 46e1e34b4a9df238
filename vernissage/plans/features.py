"""Record-feature queries, one per feature family, and the model matrix."""

from __future__ import annotations

from pyspark.sql import functions as F

from vernissage.functions import caption, category, fixed, physical, temporal, textual
from vernissage.functions.record import RecordFeatures, feature_columns
from vernissage.operators import folds
from vernissage.plans import views
from vernissage.plans.registry import query
from vernissage.plans.views import with_views

# --- SQL text of each family, reused for the matrix --------------------------------------


def _flag(predicate: str) -> str:
    return f"cast(coalesce({predicate}, false) as int)"


SQL = {
    "cap_y_int": "coalesce(cap_y, -1)",
    "y0_f": "y0",
    "y1_f": "y1",
    "year_mid": "(y0 + y1) / 2",
    "year_span": "y1 - y0",
    "century": "coalesce(cast(floor(y0 / 100) as int), -1)",
    "is_pre_1500": _flag("y0 < 1500"),
    "is_1500_1700": _flag("y0 >= 1500 and y0 < 1700"),
    "is_1700_1850": _flag("y0 >= 1700 and y0 < 1850"),
    "is_1850_1940": _flag("y0 >= 1850 and y0 < 1940"),
    "is_post_1940": _flag("y0 >= 1940"),
    "anachronism_acrylic": _flag("cap_med = 'acrylic' and y0 < 1940"),
}
SQL |= {f"cap_is_{m.replace(' ', '_')}": _flag(f"cap_med = '{m}'") for m in fixed.MEDIA}
SQL |= {n: _flag(f"contains(lower(coalesce(dim, '')), '{t}')") for n, t in fixed.DIMENSION_TERMS}
SQL["n_dim_lines"] = "cast(coalesce(len(regexp_extract_all(dim, '\\r\\n')), 0) + 1 as int)"
_DIM = "(\\d+(?:\\.\\d+)?)\\s*[x×]\\s*(\\d+(?:\\.\\d+)?)"
_W, _H = (f"try_cast(nullif(regexp_extract(dim, '{_DIM}', {g}), '') as double)" for g in (1, 2))
SQL |= {
    "dim_w_cm": _W,
    "dim_h_cm": _H,
    "dim_aspect": f"{_W} / nullif({_H}, 0)",
    "dim_area": f"{_W} * {_H}",
    "is_tiny": _flag(f"{_W} * {_H} < 100"),
    "is_huge": _flag(f"{_W} * {_H} > 10000"),
    "px_aspect": "cast(width as double) / nullif(height, 0)",
    "log_px_area": "round(ln(1 + cast(width as double) * height), 9)",
}
_NUM = "case when regexp_matches({0}, '" + fixed.NUMBER_PATTERN + "') then try_cast({0} as double) end"
SQL |= {
    "acc_year_n": _NUM.format("substring(coalesce(acc_id, ''), 1, 4)"),
    "acc_gift_num": _NUM.format("split_part(acc_id, '.', 2)"),
}
_TEXT = "lower(concat_ws(' ', " + ", ".join(f"coalesce({f}, '')" for f in fixed.TEXT_FIELDS) + "))"
SQL |= {f"has_{f}": f"cast({f} is not null as int)" for f in dict.fromkeys((*fixed.TEXT_FIELDS, *fixed.RARE_FIELDS))}
SQL |= {"kw_" + textual.column_suffix(k): _flag(f"contains(_concat_text, '{k}')") for k in fixed.KEYWORDS}
SQL["n_rare_fields_present"] = "cast(" + " + ".join(f"cast({f} is not null as int)" for f in fixed.RARE_FIELDS) + " as int)"
SQL |= {f"cls_is_{c}": _flag(f"classification = '{c}'") for c in fixed.CLASSIFICATIONS}
_AT = "lower(coalesce(assistivetext, ''))"
SQL |= {f"at_{w}": f"cast(contains({_AT}, '{w}') as int)" for w in ("painting", "drawing", "etching")}
SQL["at_ink"] = f"cast(regexp_matches({_AT}, '\\bink\\b') as int)"
SQL |= {c: f"coalesce({c}, 'MISSING')" for c in fixed.CATEGORY_FIELDS}
# The stand-in categories hold these tokens.
STAND_IN_TOKENS = (
    "AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY", "F", "O", "P",
    "1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW",
)
TOKEN_SQL = {category.token_column(t): _flag(f"contains(cat, '{t}')") for t in STAND_IN_TOKENS}


def check(names, source: str = "captions", extra: str = "") -> str:
    listed = ", ".join(["id", *[f"{SQL[n]} as {n}" for n in names]])
    inner = f"(select *, {_TEXT} as _concat_text from {source})"
    return with_views(f"select {listed}{extra} from {inner}", source)


@query("weak_label", with_views("select id, cap_med, coalesce(cap_y, -1) as cap_y_int from captions", "captions"))
def weak_label(spark, sf):
    medium = caption.caption_medium()
    return views.artworks(spark, sf).select(
        "id", medium.alias("cap_med"), caption.label_code_or_minus_one(medium).alias("cap_y_int")
    )


@query("weak_label_onehot", check([f"cap_is_{m.replace(' ', '_')}" for m in fixed.MEDIA]))
def weak_label_onehot(spark, sf):
    return views.artworks(spark, sf).select("id", *caption.label_flags(caption.caption_medium()))


@query("temporal_features", check(["y0_f", "y1_f", "year_mid", "year_span", "century"]))
def temporal_features(spark, sf):
    return views.artworks(spark, sf).select("id", *temporal.year_columns())


@query("era_buckets", check([e[0] for e in fixed.ERAS]))
def era_buckets(spark, sf):
    return views.artworks(spark, sf).select("id", *temporal.era_flags())


@query("anachronism_flag", check(["anachronism_acrylic"]))
def anachronism_flag(spark, sf):
    flag = temporal.anachronism(caption.caption_medium())
    return views.artworks(spark, sf).select("id", flag.alias("anachronism_acrylic"))


@query("dim_vocab", check([*[t[0] for t in fixed.DIMENSION_TERMS], "n_dim_lines"]))
def dim_vocab(spark, sf):
    return views.artworks(spark, sf).select("id", *physical.dimension_vocabulary())


@query("dim_parse", check(["dim_w_cm", "dim_h_cm", "dim_aspect", "dim_area", "is_tiny", "is_huge"]))
def dim_parse(spark, sf):
    return views.artworks(spark, sf).select("id", *physical.dimension_numbers())


@query("pixel_dims", check(["px_aspect", "log_px_area"], extra=", cast(width as double) * height as px_area"))
def pixel_dims(spark, sf):
    sizes = views.artworks(spark, sf).select("id", *physical.pixel_size(with_area=True))
    return sizes.withColumn("log_px_area", F.round("log_px_area", 9))


@query("accession", check(["acc_year_n", "acc_gift_num"], extra=", substring(coalesce(acc_id, ''), 1, 4) as acc_year"))
def accession(spark, sf):
    return views.artworks(spark, sf).select("id", *physical.accession_parts(with_text=True))


@query(
    "category_top30",
    with_views(
        "select token, count(*) as n from (select trim(token) as token from "
        "(select unnest(string_split(cat || '| Room ' || (id % 40), '|')) as token from train)) where token <> '' "
        "group by 1 order by n desc, token limit 30",
        "train",
    ),
)
def category_top30(spark, sf):
    """More tokens than the limit, many of them equally frequent."""
    rows = views.train_rows(spark, sf).select(F.concat("cat", F.lit("| Room "), (F.col("id") % 40).cast("string")).alias("cat"))
    return category.top_tokens(rows)


@query(
    "category_flags",
    with_views("select id, " + ", ".join(f"{e} as \"{n}\"" for n, e in TOKEN_SQL.items()) + " from test", "test"),
)
def category_flags(spark, sf):
    tokens = category.fit_tokens(views.train_rows(spark, sf))
    return views.test_rows(spark, sf).select("id", *category.token_flags(tokens))


@query("presence_flags", check([f"has_{f}" for f in fixed.TEXT_FIELDS]))
def presence_flags(spark, sf):
    return views.artworks(spark, sf, texts=True).select("id", *textual.presence_flags(fixed.TEXT_FIELDS))


@query("concat_text", check([], extra=", _concat_text as joined_text"))
def concat_text(spark, sf):
    return views.artworks(spark, sf, texts=True).select("id", textual.joined_text().alias("joined_text"))


@query("keyword_flags", check(["kw_" + textual.column_suffix(k) for k in fixed.KEYWORDS]))
def keyword_flags(spark, sf):
    joined = views.artworks(spark, sf, texts=True).select("id", textual.joined_text().alias("joined"))
    return joined.select("id", *textual.keyword_flags(F.col("joined")))


@query("rare_presence", check([*[f"has_{f}" for f in fixed.RARE_FIELDS], "n_rare_fields_present"]))
def rare_presence(spark, sf):
    return views.artworks(spark, sf).select("id", *textual.rare_presence())


@query("class_flags", check([f"cls_is_{c}" for c in fixed.CLASSIFICATIONS]))
def class_flags(spark, sf):
    return views.artworks(spark, sf).select("id", *category.class_flags())


@query("assistive_flags", check(["at_painting", "at_drawing", "at_etching", "at_ink"]))
def assistive_flags(spark, sf):
    return views.artworks(spark, sf).select("id", *textual.assistive_flags())


def _code_sql(field: str) -> str:
    return (
        f"(select {field} as v, dense_rank() over (order by {field}) - 1 as c from train "
        f"where {field} is not null group by {field}) as d_{field}"
    )


@query(
    "category_codes",
    with_views(
        "select id, " + ", ".join(f"cast(coalesce(d_{f}.c, -1) as int) as {f}_code" for f in (*fixed.CATEGORY_FIELDS, "attribution"))
        + " from test t "
        + " ".join(f"left join {_code_sql(f)} on d_{f}.v = t.{f}" for f in (*fixed.CATEGORY_FIELDS, "attribution")),
        "train", "test",
    ),
)
def category_codes(spark, sf):
    fields = [*fixed.CATEGORY_FIELDS, "attribution"]
    coded = folds.encode_categories(
        views.test_rows(spark, sf).select("id", *fields), views.train_rows(spark, sf), fields
    )
    return coded.select("id", *[F.coalesce(f"{f}_code", F.lit(-1)).alias(f"{f}_code") for f in fields])


@query(
    "feature_matrix",
    check(list(SQL), extra=", split, " + ", ".join(f"{e} as \"{n}\"" for n, e in TOKEN_SQL.items())),
)
def feature_matrix(spark, sf):
    fitted = RecordFeatures.fit(views.train_rows(spark, sf))
    wide = fitted.apply(views.artworks(spark, sf, texts=True))
    kept = feature_columns(wide.columns, keep_back=fixed.CATEGORY_FIELDS)
    return wide.select("id", *kept).withColumn("log_px_area", F.round("log_px_area", 9))
