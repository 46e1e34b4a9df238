import math
import statistics
import struct
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vernissage.functions import fixed
from vernissage.operators import images, vectors
from vernissage.operators import text_vectors as tv
from vernissage.sources import images as image_source

TEXTS = [
    "Egg tempera on panel, egg tempera", "ink  ink\tpen wash", "", None, "a", "Ünï cödé Ünï",
    "gold ground\nand oil", "oil on canvas oil",
]


def grams_of(text):
    counts = Counter()
    for word in (text or "").lower().split():
        padded = f" {word} "
        for n in (3, 4, 5):
            counts.update(padded[i : i + n] for i in range(len(padded) - n + 1))
    return counts


def docs_frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "id long, text string")


def test_ngrams_match_brute_force(spark):
    got = {(r.id, r.ngram): r.tf for r in tv.document_ngrams(docs_frame(spark, TEXTS)).collect()}
    assert got == {(i, g): n for i, t in enumerate(TEXTS) for g, n in grams_of(t).items()}


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="ab é\t\n　", max_size=12), min_size=1, max_size=5))
def test_ngrams_of_any_text(spark, texts):
    got = {(r.id, r.ngram): r.tf for r in tv.document_ngrams(docs_frame(spark, texts)).collect()}
    assert got == {(i, g): n for i, t in enumerate(texts) for g, n in grams_of(t).items()}


def brute_tfidf(texts, limit):
    grams = [grams_of(t) for t in texts]
    total = sum(grams, Counter())
    vocabulary = [g for g, _ in sorted(total.items(), key=lambda e: (-e[1], e[0].encode()))[:limit]]
    idf = {g: math.log((1 + len(texts)) / (1 + sum(g in d for d in grams))) + 1 for g in vocabulary}
    out = {}
    for i, d in enumerate(grams):
        raw = {g: (1 + math.log(d[g])) * idf[g] for g in vocabulary if g in d}
        norm = math.sqrt(sum(w * w for w in raw.values()))
        out |= {(i, g): w / norm for g, w in raw.items()}
    return out


def test_tfidf_matches_brute_force(spark):
    docs = docs_frame(spark, TEXTS)
    fitted, counts = tv.fit_counts(docs, limit=25)
    got = {(r.id, r.ngram): r.weight for r in tv.long_form(tv.weigh(counts, fitted), fitted).collect()}
    want = brute_tfidf(TEXTS, 25)
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k]) for k in want)
    again = {(r.id, r.ngram): r.weight for r in tv.long_form(tv.transform(docs, fitted), fitted).collect()}
    assert again == got


def test_documents_without_a_vocabulary_gram_are_zero_rows(spark):
    docs = docs_frame(spark, TEXTS)
    fitted, counts = tv.fit_counts(docs, limit=25)
    rows = tv.weigh(counts, fitted)
    assert sorted(r.id for r in rows.collect()) == sorted(r.id for r in docs.collect())
    assert {r.id for r in rows.filter("size(idx) = 0").collect()} >= {2, 3}
    unseen = docs_frame(spark, ["zzzz", None, TEXTS[0]])
    assert [len(r.val) > 0 for r in tv.transform(unseen, fitted).orderBy("id").collect()] == [False, False, True]
    scores = {r.id: list(r)[1:] for r in vectors.TruncatedSvd.fit(rows, 25, 3).scores(rows).collect()}
    assert scores[2] == scores[3] == [0.0, 0.0, 0.0]


def test_svd_takes_a_missing_vector_as_zeros(spark):
    x = np.random.default_rng(4).normal(size=(20, 5))
    data = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    gap, zeros = (spark.createDataFrame([*data, (99, v)], "id long, vec array<double>") for v in (None, [0.0] * 5))
    a, b = (vectors.TruncatedSvd.fit(rows, 5, 5) for rows in (gap, zeros))
    assert a.singular_values == pytest.approx(b.singular_values) and a.explained_ratio == pytest.approx(1.0)
    assert a.scores(gap).orderBy("id").collect() == b.scores(zeros).orderBy("id").collect()


@pytest.mark.parametrize("oversample", [0, 8])
def test_svd_matches_numpy(spark, oversample):
    x = np.random.default_rng(3).normal(size=(60, 12)) * np.linspace(5, 0.5, 12)
    rows = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, vec array<double>")
    fitted = vectors.TruncatedSvd.fit(rows, 12, 4, oversample=oversample)
    u, s, _ = np.linalg.svd(x, full_matrices=False)
    assert fitted.singular_values == pytest.approx(s[:4], rel=1e-4)
    scores = np.array([list(r)[1:] for r in fitted.scores(rows).orderBy("id").collect()])
    assert np.abs(scores) == pytest.approx(np.abs(u[:, :4] * s[:4]), rel=1e-2, abs=0.3)
    assert scores.T @ scores == pytest.approx(np.diag(s[:4] ** 2), rel=1e-3, abs=1e-3)
    assert fitted.explained_ratio == pytest.approx(scores.var(axis=0).sum() / x.var(axis=0).sum())
    sparse = rows.select("id", F.expr("transform(sequence(0, 11), i -> i)").alias("idx"), F.col("vec").alias("val"))
    same = vectors.TruncatedSvd.fit(sparse, 12, 4, oversample=oversample)
    assert same.singular_values == pytest.approx(fitted.singular_values)


def test_svd_stops_by_its_residual(spark):
    """A slowly falling spectrum: fixed few passes miss it, the residual says by how much."""
    rng = np.random.default_rng(7)
    left, right = (np.linalg.qr(rng.normal(size=(n, 90)))[0] for n in (300, 90))
    s = 0.985 ** np.arange(90)
    x = left * s @ right.T
    rows = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, vec array<double>")
    short = vectors.TruncatedSvd.fit(rows, 90, 4, oversample=2, most_passes=2)
    assert short.passes == 2 and short.residual > 0.01
    fitted = vectors.TruncatedSvd.fit(rows, 90, 4, oversample=2, tolerance=1e-6, most_passes=200)
    assert 2 < fitted.passes < 100 and fitted.residual <= 1e-6
    assert fitted.singular_values == pytest.approx(s[:4], rel=1e-6)
    assert np.abs(fitted.components.T @ right[:, :4]) == pytest.approx(np.eye(4), abs=1e-3)
    gram = x.T @ x
    for f in (short, fitted):  # the bound holds: an eigenvalue lies within the residual of each value found
        misses = np.linalg.norm(gram @ f.components - f.components * f.singular_values**2, axis=0)
        assert misses.max() / f.singular_values[0] ** 2 == pytest.approx(f.residual, rel=1e-3, abs=1e-9)
        nearest = np.abs(f.singular_values[:, None] ** 2 - s**2).min(axis=1)
        assert (nearest <= misses + 1e-9).all()


def test_svd_of_few_directions(spark):
    """Fewer directions than asked for, and none at all."""
    x = np.zeros((30, 80))
    x[:, 3], x[:, 7] = 2.0, np.arange(30)
    for data, rank in ((x, 2), (np.zeros((5, 80)), 0)):
        rows = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(data)], "id long, vec array<double>")
        fitted = vectors.TruncatedSvd.fit(rows, 80, 5, oversample=5)
        want = np.linalg.svd(data, compute_uv=False)[:5]
        assert fitted.singular_values == pytest.approx(want, abs=1e-4) and (fitted.singular_values > 1e-3).sum() == rank
        assert fitted.components.T @ fitted.components == pytest.approx(np.eye(5), abs=1e-9)


def test_l2_and_zero_vectors(spark):
    ids = spark.range(3)
    known = spark.createDataFrame([(0, [3.0, 4.0])], "id long, vec array<double>")
    filled = vectors.with_zero_vectors(ids, known, 2)
    got = {r.id: r.v for r in filled.select("id", vectors.l2_normalised().alias("v")).collect()}
    assert got == {0: [0.6, 0.8], 1: [0.0, 0.0], 2: [0.0, 0.0]}


def image_rows(spark, arrays, channels=3):
    """Image source rows; bytes are B, G, R(, A)."""
    rows = []
    for i, a in arrays.items():
        stored = a[:, :, ::-1] if channels > 1 else a[:, :, :1]
        if channels == 4:
            stored = np.concatenate([stored, np.full((*a.shape[:2], 1), 77)], axis=2)
        rows.append((i, ("mem", a.shape[0], a.shape[1], channels, 16, bytearray(stored.astype(np.uint8).tobytes()))))
    return spark.createDataFrame(rows, "id long, image struct<origin:string,height:int,width:int,nChannels:int,mode:int,data:binary>")


def by_name(values):
    return dict(zip(images.FEATURE_NAMES, values, strict=True))


def test_one_colour():
    got = by_name(images.statistics(np.full((3, 5, 3), 51)))  # 51 is a fifth of full scale
    flat = {n: got[n] for n in got if n.endswith("_std") or n in ("img_contrast", "img_saturation", "img_warmth", "img_edge_mean")}
    assert set(flat.values()) == {0.0}
    level = ["img_r_mean", "img_brightness", "img_gray_mean", "img_gray_p10", "img_gray_p90"]
    assert [got[n] for n in level] == pytest.approx([0.2] * 5)
    assert [got[f"img_g_h{k}"] for k in range(8)] == [0, 1 / 32, 0, 0, 0, 0, 0, 0]
    assert (got["img_black_frac"], got["img_white_frac"]) == (0, 0)


def test_black_and_white_step():
    a = np.zeros((2, 4, 3), dtype=int)
    a[:, 2:] = 255
    got = by_name(images.statistics(a))
    assert got["img_b_mean"] == got["img_b_std"] == got["img_contrast"] == got["img_black_frac"] == got["img_white_frac"] == 0.5
    assert (got["img_r_h0"], got["img_r_h7"], got["img_r_h3"]) == (0.5 / 32, 0.5 / 32, 0)
    assert (got["img_gray_p10"], got["img_gray_p50"], got["img_gray_p90"]) == (0, 0.5, 1)
    assert got["img_edge_mean"] == pytest.approx((0 + 2 / 6) / 2)  # 2 of 6 steps to the right go from black to white


def test_red_ramp():
    a = np.zeros((1, 5, 3), dtype=int)
    a[0, :, 0] = [0, 50, 100, 150, 200]
    got = by_name(images.statistics(a))
    assert got["img_r_mean"] == got["img_brightness"] == got["img_warmth"] == pytest.approx(100 / 255)
    assert got["img_r_std"] == pytest.approx(5000**0.5 / 255)  # squares of -100, -50, 0, 50, 100 average 5000
    assert got["img_saturation"] == pytest.approx(0.8, abs=1e-5)  # black has none, the others are pure red
    assert got["img_gray_p25"] == pytest.approx(0.299 * 50 / 255)
    assert got["img_edge_mean"] is None  # one row has no step down


def test_random_image_by_definition():
    a = np.random.default_rng(1).integers(0, 256, (6, 9, 3))
    pixels = [tuple(int(v) for v in a[y, x]) for y in range(6) for x in range(9)]
    luma = [0.299 * r + 0.587 * g + 0.114 * b for r, g, b in pixels]
    got = by_name(images.statistics(a))

    def percentile(p):
        ordered, at = sorted(luma), p / 100 * 53
        low = int(at)
        return ordered[low] + (ordered[min(low + 1, 53)] - ordered[low]) * (at - low)

    steps_down = [abs(luma[i + 9] - luma[i]) for i in range(45)]
    steps_right = [abs(luma[i + 1] - luma[i]) for i in range(54) if i % 9 != 8]
    want = {
        "img_g_mean": sum(p[1] for p in pixels) / 54 / 255,
        "img_b_std": statistics.pstdev(p[2] for p in pixels) / 255,
        "img_brightness": sum(map(max, pixels)) / 54 / 255,
        "img_saturation": sum((max(p) - min(p)) / max(p) for p in pixels) / 54,
        "img_contrast": statistics.pstdev(luma) / 255,
        "img_black_frac": sum(v < 25.5 for v in luma) / 54,
        "img_white_frac": sum(v > 229.5 for v in luma) / 54,
        "img_warmth": sum(r - b for r, _, b in pixels) / 54 / 255,
        "img_r_h5": sum(160 <= p[0] < 192 for p in pixels) / 54 / 32,
        "img_gray_mean": sum(luma) / 54 / 255,
        "img_edge_mean": (sum(steps_down) / 45 + sum(steps_right) / 48) / 2 / 255,
    } | {f"img_gray_p{p}": percentile(p) / 255 for p in (10, 25, 50, 75, 90)}
    assert {n: got[n] for n in want} == pytest.approx(want, abs=1e-6)


def test_image_features_stay_in_the_row(spark):
    rng = np.random.default_rng(2)
    arrays = {i: rng.integers(0, 256, (5 + i, 9, 3)) for i in range(4)}
    frame = image_rows(spark, arrays).unionByName(image_rows(spark, {9: arrays[0]}).withColumn("image", F.lit(None).cast("struct<origin:string,height:int,width:int,nChannels:int,mode:int,data:binary>")))
    found = images.image_features(frame)
    assert found.columns == ["id", *images.FEATURE_NAMES] and len(images.FEATURE_NAMES) == 43
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Generate" not in plan
    got = {r.id: list(r)[1:] for r in found.collect()}
    assert got[9] == [None] * 43
    for i, a in arrays.items():
        assert got[i] == pytest.approx(images.statistics(images.block_average(a, 64, 64)))
    for channels in (1, 4):
        wide = {r.id: r.img_b_mean for r in images.image_features(image_rows(spark, arrays, channels), side=None).collect()}
        assert wide == pytest.approx({i: a[:, :, 2 if channels == 4 else 0].mean() / 255 for i, a in arrays.items()})


def test_resize_and_crop(spark):
    a = np.arange(4 * 6 * 3).reshape(4, 6, 3)
    blocks = a.reshape(2, 2, 3, 2, 3).mean(axis=(1, 3))
    assert np.array_equal(images.block_average(a, 3, 2), np.floor(blocks + 0.5))
    large = images.block_average(a, 10, 10)
    assert all(tuple(large[y, x]) == tuple(a[y * 4 // 10, x * 6 // 10]) for x in range(10) for y in range(10))
    assert images.shorter_side(a, 2).shape == (2, 3, 3)
    assert np.array_equal(images.center(a, 2), a[1:3, 2:4])
    frame = image_rows(spark, {1: a})
    cut = images.cells(images.resized(frame, 4, keep_aspect=True, crop=2)).collect()
    assert {(r.px, r.py): (r.r, r.g, r.b) for r in cut} == {(x, y): tuple(a[y + 1, x + 2]) for x in (0, 1) for y in (0, 1)}
    tensor = images.model_inputs(frame, 4, 4).first().tensor
    assert tensor == pytest.approx(images.standardised(a[:, 1:5]).ravel().tolist())
    assert images.model_inputs(frame, 4, 5).first().tensor is None


def png(path, a):
    h, w, _ = a.shape

    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    raw = b"".join(b"\0" + a[y].astype(np.uint8).tobytes() for y in range(h))
    header = struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)
    path.write_bytes(
        b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", header) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")
    )


def test_image_source_keeps_unreadable(spark, tmp_path):
    a = np.random.default_rng(5).integers(0, 256, (3, 5, 3))
    png(tmp_path / "7.png", a)
    (tmp_path / "8.png").write_bytes(b"junk")
    scanned = image_source.read_images(spark, str(tmp_path))
    ids = spark.createDataFrame([("7",), ("8",), ("9",)], "id string")
    got = {r.id: r.img_brightness for r in image_source.with_image_features(ids, images.image_features(scanned, side=None)).collect()}
    assert got["7"] == pytest.approx(a.max(axis=2).mean() / 255) and got["8"] is None and got["9"] is None
    assert fixed.IMAGE_SIDE == 64


def test_kernel_resize_by_hand(spark):
    """Weights are worked out by hand; a triangle over twice the distance when an axis halves."""
    halved = images.kernel_weights(4, 2, "triangle")
    assert halved == pytest.approx(np.array([[3, 3, 1, 0], [0, 1, 3, 3]]) / 7)
    assert images.kernel_weights(5, 5, "cubic") == pytest.approx(np.eye(5))
    doubled = images.kernel_weights(2, 4, "triangle")
    assert doubled == pytest.approx(np.array([[1, 0], [0.75, 0.25], [0.25, 0.75], [0, 1]]))
    # Cubic at distances 1/4, 3/4 and 5/4: 111/128, 29/128 and -9/128.
    assert images.kernel_weights(4, 2, "cubic")[0] == pytest.approx(np.array([111, 111, 29, -9]) / 242)
    row = np.repeat(np.array([[0, 70, 140, 210]]), 3, axis=0)[:, :, None].repeat(3, axis=2)
    assert images.kernel_resize(row, 2, 3, "triangle")[0, :, 0].tolist() == [50, 160]
    edge = np.repeat(np.array([[0, 0, 255, 255]]), 4, axis=0)[:, :, None].repeat(3, axis=2)
    assert images.kernel_resize(edge, 8, 4, "cubic").min() == 0 and images.kernel_resize(edge, 8, 4, "cubic").max() == 255
    flat = np.full((9, 7, 3), 200)
    assert (images.kernel_resize(flat, 4, 4) == 200).all() and (images.kernel_resize(flat, 20, 30) == 200).all()
    rng = np.random.default_rng(8)
    noisy = rng.integers(0, 256, (64, 64, 3))
    assert images.kernel_resize(noisy, 8, 8).std() < noisy[::8, ::8].std() / 3  # shrinking averages, it does not pick pixels
    frame = image_rows(spark, {1: noisy})
    assert np.array_equal(np.array(images.resized(frame, 8, method="cubic").first().levels).reshape(8, 8, 3), images.kernel_resize(noisy, 8, 8))
    assert np.array_equal(np.array(images.resized(frame, 8).first().levels).reshape(8, 8, 3), images.block_average(noisy, 8, 8))
    tensor = images.model_inputs(frame, 16, 8, method="triangle").first().tensor
    assert tensor == pytest.approx(images.standardised(images.center(images.kernel_resize(noisy, 16, 16, "triangle"), 8)).ravel().tolist())
