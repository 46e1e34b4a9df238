"""Raw files and prediction archives written by tasks."""

import numpy as np
import pyarrow as pa
import pytest

from vernissage.sources import files
from vernissage.sources import images as image_source


def image_rows(spark, arrays):
    rows = []
    for key, a in arrays.items():
        if a is None:
            rows.append((key, None))
            continue
        stored = a[:, :, ::-1] if a.shape[2] == 3 else a[:, :, [2, 1, 0, 3]] if a.shape[2] == 4 else a
        rows.append((key, ("mem", a.shape[0], a.shape[1], a.shape[2], 16, bytearray(stored.astype(np.uint8).tobytes()))))
    return spark.createDataFrame(rows, f"id long, image {image_source.IMAGE}")


def test_images_written_and_scanned(spark, tmp_path):
    rng = np.random.default_rng(5)
    arrays = {1: rng.integers(0, 256, (5, 7, 3)), 2: rng.integers(0, 256, (4, 3, 1)), 3: rng.integers(0, 256, (2, 2, 4)), 4: None}
    broken = spark.createDataFrame([(9, ("mem", -1, -1, -1, -1, bytearray()))], f"id long, image {image_source.IMAGE}")
    made = image_rows(spark, arrays).unionByName(broken)
    path = str(tmp_path / "images")
    image_source.write_images(made.repartition(3, "id"), path)
    got = {r.id: r.image for r in image_source.read_written_images(spark, path).collect()}
    assert sorted(got) == ["1", "2", "3", "9"] and got["9"].height == -1
    for r in made.filter("id < 4").collect():
        back = got[str(r.id)]
        assert (back.height, back.width, back.nChannels) == (r.image.height, r.image.width, r.image.nChannels)
        assert bytes(back.data) == bytes(r.image.data)
    image_source.write_images(made.limit(0), path)
    assert image_source.read_written_images(spark, path).count() == 0


def test_archives_of_bounded_size(spark, tmp_path):
    path = str(tmp_path / "preds")
    df = spark.range(1000).selectExpr("id", "array(id / 7, 0.5D, -id) as probs").repartition(3)
    files.write_archive(df, path, rows=150)
    sizes = [len(np.load(p)["ids"]) for p in sorted((tmp_path / "preds").glob("part-*/*.npz"))]
    assert max(sizes) == 150 and sum(sizes) == 1000
    back = files.read_archive(spark, path)
    assert back.rdd.getNumPartitions() == len(sizes)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    files.write_archive(df.filter("id < 10"), path, mode="append")
    assert files.read_archive(spark, path).count() == 1010
    files.write_archive(df.filter("id < 10"), path)
    assert files.read_archive(spark, path).count() == 10
    named = spark.createDataFrame([("é", [1.0]), ("b", [2.0])], "id string, probs array<double>")
    files.write_archive(named, path)
    assert sorted(map(tuple, files.read_archive(spark, path, named.schema).collect())) == [("b", [2.0]), ("é", [1.0])]
    files.write_archive(named.limit(0), path)
    assert files.read_archive(spark, path, named.schema).count() == 0


def test_only_committed_attempts_are_read(tmp_path):
    path = str(tmp_path / "out")
    writer = files.ArchiveWriter(path, overwrite=True, rows=4)
    batch = pa.RecordBatch.from_pydict({"id": [1, 2, 3, 4, 5], "probs": [[0.1, 0.9]] * 5})
    lost, kept = writer.write(iter([batch])), writer.write(iter([batch, batch]))
    assert files.committed(path) == []
    writer.commit([kept, None])
    assert files.committed_folders("file:" + path) == [f"file:{path}/{kept.folder}"]
    assert not (tmp_path / "out" / lost.folder).exists()
    reader = files.ArchiveReader(path)
    batches = [b for p in reader.partitions() for b in reader.read(p)]
    assert [b.num_rows for b in batches] == [4, 4, 2]
    assert [i for b in batches for i in b.column("id").to_pylist()] == [1, 2, 3, 4, 5] * 2
    again = files.ArchiveWriter(path, overwrite=False, rows=4)
    again.abort([again.write(iter([batch])), None])
    assert files.committed(path) == [kept.folder] and len(list((tmp_path / "out").glob("part-*"))) == 1


def test_what_cannot_be_written_is_refused(tmp_path):
    path = str(tmp_path / "out")
    archive, raw = files.ArchiveWriter(path, True, 4), files.RawFileWriter(path, True)
    for ids, probs in (([None], [[1.0]]), ([1, 2], [[1.0], [1.0, 2.0]]), ([1], [None]), ([1], [[None]])):
        columns = {"id": pa.array(ids, pa.int64()), "probs": pa.array(probs, pa.list_(pa.float64()))}
        with pytest.raises(ValueError):
            archive.write(iter([pa.RecordBatch.from_pydict(columns)]))
    for names in (["a/b"], [""], [None], ["a", "a"]):
        columns = {"name": pa.array(names, pa.string()), "content": pa.array([b"x"] * len(names))}
        with pytest.raises(ValueError):
            raw.write(iter([pa.RecordBatch.from_pydict(columns)]))
    files.RawFileWriter(path, True).commit([])
    assert files.committed(path) == []
