import math

from pyspark.sql import functions as F

from vernissage.functions import caption, category, fixed, numeric, physical, temporal, textual
from vernissage.functions.record import RecordFeatures, feature_columns
from vernissage.plans import views

SF = "/root/testdata/sf0.001"


def rows(spark, values, name, *columns, kind="string"):
    df = spark.createDataFrame([(v,) for v in values], f"{name} {kind}")
    return [r.asDict() for r in df.select(*columns).collect()]


def test_caption_medium_edge_cases(spark):
    texts = [
        "A oil on canvas artwork titled 'x' by y.",
        "a WATERCOLOR artwork titled q",
        "Extra banana Ink artwork titled",
        "A Oil on  Canvas artwork titled",
        "A ink painting",
        "A print2 artwork titled",
        "A ink artwork titled",
        "A ink artwork titled A print artwork titled",
        "",
        None,
    ]
    medium = caption.caption_medium()
    got = rows(spark, texts, "cap", medium.alias("m"), caption.label_code_or_minus_one(medium).alias("c"))
    assert [r["m"] for r in got] == [
        "oil on canvas", "watercolor", "banana ink", "oil on  canvas", None, None, "ink", "ink", None, None,
    ]
    assert [r["c"] for r in got] == [2, 7, -1, -1, -1, -1, 1, 1, -1, -1]


def test_label_flags_and_names(spark):
    got = rows(spark, ["ink", None, "clay"], "m", *caption.label_flags(F.col("m")))
    assert [sum(r.values()) for r in got] == [1, 0, 0]
    names = rows(spark, [0, 7, 8, -1, None], "c", caption.label_name(F.col("c")).alias("n"), kind="int")
    assert [r["n"] for r in names] == ["acrylic", "watercolor", None, None, None]


def test_years_and_eras(spark):
    df = spark.createDataFrame(
        [(-50.0, 10.0), (1499.0, 1500.0), (1940.0, None), (None, 5.0)], "y0 double, y1 double"
    )
    got = [r.asDict() for r in df.select(*temporal.year_columns(), *temporal.era_flags()).collect()]
    assert [r["century"] for r in got] == [-1, 14, 19, -1]
    assert [r["year_mid"] for r in got] == [-20.0, 1499.5, None, None]
    assert [[r[e[0]] for e in fixed.ERAS] for r in got] == [
        [1, 0, 0, 0, 0], [1, 0, 0, 0, 0], [0, 0, 0, 0, 1], [0, 0, 0, 0, 0],
    ]


def test_dimensions(spark):
    texts = [
        "overall: 10.5 x 20 cm\r\nFramed: 30 x 40 cm",
        "no size\r\nsheet: 3 × 4",
        "12 x 3",
        "5 X 6",
        "7 x 0",
        None,
    ]
    got = rows(spark, texts, "dim", *physical.dimension_vocabulary(), *physical.dimension_numbers())
    assert [(r["dim_w_cm"], r["dim_h_cm"]) for r in got] == [
        (10.5, 20.0), (3.0, 4.0), (12.0, 3.0), (None, None), (7.0, 0.0), (None, None),
    ]
    assert [r["n_dim_lines"] for r in got] == [2, 2, 1, 1, 1, 1]
    assert [r["has_frame"] for r in got] == [1, 0, 0, 0, 0, 0]
    assert [r["is_tiny"] for r in got] == [0, 1, 1, 0, 1, 0]
    assert got[4]["dim_aspect"] is None


def test_accession_and_numbers(spark):
    got = rows(spark, ["1937.3.1", "1950", "12a4.x.2", "19.1_0", None], "acc_id", *physical.accession_parts())
    assert [r["acc_year_n"] for r in got] == [1937.0, 1950.0, None, 19.1, None]
    assert [r["acc_gift_num"] for r in got] == [3.0, None, None, None, None]
    texts = [" 3.5 ", "3d", "1e3", "nan", "inf", "1_0", ".5", "", None]
    got = rows(spark, texts, "x", numeric.to_number("x").alias("n"))
    assert [r["n"] for r in got] == [3.5, None, 1000.0, None, None, None, 0.5, None, None]


def test_nan_becomes_null(spark):
    df = numeric.nan_as_null(spark.createDataFrame([(1, math.nan), (2, 1.0)], "id int, v double"))
    assert [r.v for r in df.orderBy("id").collect()] == [None, 1.0]


def test_joined_text_keeps_separators_and_substrings_hit(spark):
    df = spark.createDataFrame([("Pink", None, "PEN")], "t string, txt string, note string")
    joined = textual.joined_text(["t", "txt", "note"])
    got = df.select(joined.alias("j"), *textual.keyword_flags(joined, ["ink", "pencil", "egg tempera"])).first()
    assert got.j == "pink  pen"
    assert (got.kw_ink, got.kw_pencil, got.kw_egg_tempera) == (1, 0, 0)


def test_assistive_word_boundary(spark):
    got = rows(spark, ["pink wash", "in Ink.", None], "assistivetext", *textual.assistive_flags())
    assert [r["at_ink"] for r in got] == [0, 1, 0]


def test_tokens_fit_and_apply(spark):
    df = spark.createDataFrame([("a| b|",), ("b|c",), (None,), ("b & d",)], "cat string")
    assert category.fit_tokens(df, limit=3) == ["b", "a", "b & d"]
    flags = df.select(*category.token_flags(["b", "b & d", "b - d"])).collect()
    # equal names: the later token wins
    assert [tuple(r) for r in flags] == [(1, 0), (1, 0), (0, 0), (1, 0)]


def test_drop_list_is_ordered_and_unique():
    assert feature_columns(["id", "a", "cap", "b", "a2"], ["b", "element"]) == ["a", "b", "a2", "element"]


def test_record_features_are_stateless(spark, tmp_path):
    records = views.artworks(spark, SF, texts=True)
    fitted = RecordFeatures.fit(records.filter("split = 'train'"))
    assert set(fitted.tokens) <= {r.token for r in category.category_tokens(records).distinct().collect()}
    plan = fitted.apply(spark.createDataFrame([], records.schema))._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and "Join" not in plan
    # the same projection runs on a stream
    path = str(tmp_path / "records")
    records.write.parquet(path)
    stream = fitted.apply(spark.readStream.schema(records.schema).parquet(path))
    query = stream.writeStream.format("memory").queryName("scored").trigger(availableNow=True).start()
    query.awaitTermination(120)
    batch = fitted.apply(records)
    assert spark.table("scored").exceptAll(batch).count() == 0
    assert spark.table("scored").count() == batch.count()


def test_tokens_that_differ_in_case_only(spark):
    df = spark.createDataFrame([("Oil|ink",), ("oil",)], "cat string")
    flags = df.select(*category.token_flags(["Oil", "ink", "oil", "OIL", "oil_2"]))
    assert flags.columns == ["catk_Oil", "catk_ink", "catk_oil_2", "catk_OIL_3", "catk_oil_2_2"]
    assert [tuple(r)[:4] for r in flags.collect()] == [(1, 1, 0, 0), (0, 0, 1, 0)]
