import csv
import random
from contextlib import contextmanager
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vernissage.session import land, land_once, landing_scope, shared_dir
from vernissage.sources import bindings, fetch, quoted, records

SCHEMA = T.StructType(
    [
        T.StructField("id", T.LongType()), T.StructField("dim", T.StringType()),
        T.StructField("y0", T.DoubleType()), T.StructField("note", T.StringType()),
    ]
)


def test_csv_with_crlf_quotes_and_null_text(spark, tmp_path):
    path = tmp_path / "train.csv"
    path.write_bytes(
        b'id,dim,y0,note\r\n1,"a\r\nb",1900,"say ""hi"""\r\n2,,NaN,last\r\n3,"x, y",bad,NA\r\n'
    )
    got = {r.id: r for r in records.read_records(spark, str(path), SCHEMA).collect()}
    assert got[1].dim == "a\r\nb" and got[1].note == 'say "hi"' and got[1].y0 == 1900.0
    assert got[2].dim is None and got[2].y0 is None and got[2].note == "last"
    assert got[3].dim == "x, y" and got[3].y0 is None and got[3].note is None
    wrong = T.StructType(SCHEMA.fields[:-1])
    with pytest.raises(ValueError, match="differ"):
        records.read_records(spark, str(path), wrong)


def test_csv_files_with_other_column_orders(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,dim,y0,"no,te"\n1,a,1.5,x\n')
    (tmp_path / "b.csv").write_text('y0,"no,te",id,dim\n2.5,y,2,b\n')
    schema = T.StructType([*SCHEMA.fields[:3], T.StructField("no,te", T.StringType())])
    got = sorted(tuple(r) for r in records.read_records(spark, str(tmp_path), schema).collect())
    assert got == [(1, "a", 1.5, "x"), (2, "b", 2.5, "y")]
    (tmp_path / "c.csv").write_text("id,dim\n3,c\n")
    with pytest.raises(ValueError, match="differ"):
        records.read_records(spark, str(tmp_path), schema)


@contextmanager
def split_size(spark, n_bytes):
    names = {"spark.sql.files.maxPartitionBytes": str(n_bytes), "spark.sql.files.openCostInBytes": "0", "spark.sql.files.minPartitionNum": "1"}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def written(path, rows, end):
    with open(path, "w", newline="") as out:
        csv.writer(out, lineterminator=end).writerows([SCHEMA.names, *rows])


@pytest.mark.parametrize(("n_bytes", "n_rows", "end"), [(9, 3, "\r\n"), (40, 15, "\n"), (333, 40, "\r\n"), (1 << 20, 40, "\n")])
def test_csv_records_do_not_depend_on_the_splits(spark, tmp_path, n_bytes, n_rows, end):
    rng = random.Random(n_bytes)
    texts = ["plain", 'say ""hi""', '"', "a\nb", "a\r\nb\n\nc", ",", '",\n"', "\n" * 30, "é, ß\n\"", '\n"\n,"', "x" * 90, 'mid"quote']
    for name in "ab":
        written(tmp_path / f"{name}.csv", [(i, rng.choice(texts), i / 2, rng.choice(texts)) for i in range(n_rows)], end)
    want = []
    for name in "ab":
        with open(tmp_path / f"{name}.csv", newline="") as told:
            want += [(int(r[0]), r[1], float(r[2]), r[3]) for r in list(csv.reader(told))[1:]]
    with split_size(spark, n_bytes):
        frame = records.read_records(spark, str(tmp_path), SCHEMA)
        got = [tuple(r) for r in frame.collect()]
    assert sorted(got) == sorted(want)


def test_a_quoted_csv_file_is_read_by_many_tasks(spark, tmp_path):
    path = tmp_path / "one.csv"
    written(path, [(i, f"line\nbreak {i}", 0.5, "x") for i in range(1500)], "\n")
    with split_size(spark, 4096):
        lines = spark.read.text(str(path), lineSep="\n")
        assert lines.rdd.getNumPartitions() >= 10
        value = quoted.read_quoted(spark, str(path))
        own = value.filter("value like '%break%'").select(F.spark_partition_id().alias("p")).distinct().count()
        assert own >= 4 and value.count() == 1500


def test_csv_with_stray_quotes_and_blank_lines(spark, tmp_path):
    path = tmp_path / "s.csv"
    path.write_text('id,dim,y0,note\n1,12" wide,1,a\n\n2,"x\ny",2,5"\n3,z,3,"open\nto the end\n')
    for n_bytes in (11, 1 << 20):
        with split_size(spark, n_bytes):
            got = {r.id: (r.dim, r.note) for r in records.read_records(spark, str(path), SCHEMA).collect()}
        assert got[1] == ('12" wide', "a") and got[2] == ("x\ny", '5"') and got[3][0] == "z" and len(got) == 3


@pytest.mark.parametrize(
    ("line", "after"),
    [("a,b", (False, None)), ('"a', (True, False)), ('a"', (False, False)), ('"a"', (False, False)), ('"a""', (True, False)), ('""', (False, True)), ('x","y', (True, True)), (',"', (True, False)), ('"a""b",c', (False, False))],
)
def test_open_quotes(line, after):
    got = quoted.open_after(line)
    assert got[0] == after[0] and after[1] in (None, got[1])


def test_csv_numbers(spark, tmp_path):
    path = tmp_path / "n.csv"
    path.write_text("id,dim,y0,note\n1.0,,3d,a\n2,,1900f,b\n 3 ,, 1e3 ,c\n4.5,,1_0,d\nx,,.5,e\n9007199254740993,,7.,f\n")
    got = {r.note: (r.id, r.y0) for r in records.read_records(spark, str(path), SCHEMA).collect()}
    assert got == {"a": (1, None), "b": (2, None), "c": (3, 1000.0), "d": (None, None), "e": (None, 0.5), "f": (9007199254740993, 7.0)}


def test_predictions_roundtrip(spark, tmp_path):
    df = spark.createDataFrame([(1, [0.1, 0.9])], "id long, probs array<double>")
    records.write_predictions(df, str(tmp_path / "p"))
    assert records.read_predictions(spark, str(tmp_path / "p")).collect() == df.collect()


def test_side_table_has_nulls_for_nan(spark, tmp_path):
    side = spark.createDataFrame([(1, 0.5, "a"), (2, float("nan"), None)], "id long, mean double, name string")
    records.write_table(side, str(tmp_path / "side"))
    got = {r.id: (r["mean"], r.name) for r in records.read_side_table(spark, str(tmp_path / "side")).collect()}
    assert got == {1: (0.5, "a"), 2: (None, None)}


def test_decode_answers(spark):
    answer = (
        '{"results":{"bindings":[{"item":{"value":"http://x/entity/Q1"},"matLabel":{"value":"ink"}},'
        '{"item":{"value":"http://x/entity/Q2"},"matLabel":{"value":"gold \\"leaf\\""}}]}}'
    )
    df = spark.createDataFrame([(answer,), ('{"results":{"bindings":[]}}',), ("not json",)], "answer string")
    assert {tuple(r) for r in bindings.decode_answers(df).collect()} == {("Q1", "ink"), ("Q2", 'gold "leaf"')}


def test_fetch_tables(spark):
    ids = spark.range(10)
    tried = spark.createDataFrame([(1, True), (2, False), (2, True), (3, False)], "id long, ok boolean")
    assert {r.id for r in fetch.pending(ids, tried).collect()} == set(range(10)) - {1, 2}
    assert tuple(fetch.outcome_summary(tried).first()) == (4, 2)
    got = {r.id: r.batch for r in fetch.batches(ids, size=4, rows_per_bucket=3).collect()}
    assert got == {i: i // 4 for i in range(10)}


def test_shared_folder_comes_from_the_session(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
    assert land(spark.range(5), "t").count() == 5
    built = []

    def build():
        built.append(1)
        return spark.range(3)

    assert land_once(spark, ("once",), build).count() == land_once(spark, ("once",), build).count() == 3
    assert built == [1]


def test_landed_tables_follow_their_inputs_and_go_with_the_scope(spark, tmp_path):
    path = str(tmp_path / "in")
    spark.range(3).write.parquet(path)
    source = lambda: spark.read.parquet(path)
    with landing_scope(spark):
        first = land_once(spark, ("followed",), lambda: source().selectExpr("id + 1 as id"), source())
        assert first.count() == 3 and land(spark.range(2), "inside").count() == 2
        spark.range(5).write.mode("overwrite").parquet(path)
        second = land_once(spark, ("followed",), lambda: source().selectExpr("id + 1 as id"), source())
        assert second.count() == 5
        held = second.inputFiles()[0]
    assert not Path(held.removeprefix("file://")).exists()
    assert land_once(spark, ("followed",), source, source()).count() == 5
