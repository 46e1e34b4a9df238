"""N-gram counts inside slices of documents: repeated and missing ids, many slices, what is shuffled."""

import math
from collections import Counter

import pytest

from vernissage.operators import text_vectors as tv

ROWS = [(3, "oil on canvas"), (1, "ink  INK\x1fpen"), (3, "Oil oil"), (None, "pen wash"), (2, None), (None, "pen"), (4, ""), (5, "wash " * 50), (3, None), (6, "Ünï a")]


def grams_of(texts):
    padded = [f" {w} " for t in texts for w in (t or "").lower().split()]
    return Counter(p[i : i + n] for p in padded for n in (3, 4, 5) for i in range(len(p) - n + 1))


@pytest.fixture
def docs(spark):
    return spark.createDataFrame(ROWS, "id long, text string")


@pytest.mark.parametrize("slice_words", [1, 4, 100_000])
def test_rows_of_one_id_are_one_document(docs, slice_words):
    by_id = {i: grams_of([t for j, t in ROWS if j == i]) for i, _ in ROWS}
    got = [(r.id, r.ngram, r.tf) for r in tv.document_ngrams(docs, slice_words=slice_words).collect()]
    assert len(set(got)) == len(got) and set(got) == {(i, g, n) for i, c in by_id.items() for g, n in c.items()}
    vocabulary = tv.fit_vocabulary(docs, limit=20).selectExpr("ngram", "cast(monotonically_increasing_id() as int) as position")
    places = {r.ngram: r.position for r in vocabulary.collect()}
    rows = tv.count_rows(docs, vocabulary, slice_words=slice_words).collect()
    expected = [(i, sorted((places[g], n) for g, n in by_id[i].items() if g in places and i is not None)) for i, _ in ROWS]
    assert sorted(((r.id, list(zip(r.idx, r.tf, strict=True))) for r in rows), key=str) == sorted(expected, key=str)


def test_totals_of_all_texts(docs):
    got = {r.ngram: r.total for r in tv.ngram_totals(docs).collect()}
    assert got == grams_of([t for _, t in ROWS])


def test_texts_are_shuffled_once_and_never_as_ngrams(docs, capsys):
    vocabulary = docs.sparkSession.createDataFrame([("oil", 0), (" oi", 1)], "ngram string, position int")
    for frame in (tv.document_ngrams(docs), tv.count_rows(docs, vocabulary)):
        frame.explain()
        plan = capsys.readouterr().out
        assert plan.count("Exchange") == 1 and "Generate" not in plan and "Aggregate" not in plan


@pytest.mark.parametrize("known", [None, {" ab": 7, "ab ": 3, "bcde": 0, "𝄞é ": 5, "zzz": 1}])
def test_wide_alphabets_give_the_same_ngrams(known):
    """Past about 6,200 characters the digits of five of them pass 63 bits."""
    words = ["ab", "abcde", "a𝄞é", "b", "ab"]
    wide = "".join(map(chr, range(0x4E00, 0x4E00 + 7000)))
    for more, wanted in ((words, known), ([*words, wide], known if known is None else known | {c * 3: 10 + i for i, c in enumerate(wide)})):
        numbers, ends, names = tv.Grams((3, 4, 5), wanted).cut(more)
        back = dict(enumerate(names)) if wanted is None else {n: g for g, n in wanted.items()}
        for i, w in enumerate(more):
            got = sorted(back[n] for n in numbers[ends[i] : ends[i + 1]])
            assert got == sorted(g for g in tv.word_ngrams(w) if wanted is None or g in wanted)


def test_weights_follow_the_positions(spark):
    """A vocabulary may lack positions, and a row may have no n-gram; the idf values are not copied into rows."""
    counts = spark.createDataFrame([(1, [0, 5], [1, 3]), (2, [], []), (None, [5], [2])], "id long, idx array<int>, tf array<bigint>")
    fitted = spark.createDataFrame([("a", 5, 3.0), ("b", 0, 2.0)], "ngram string, position int, idf double")
    got = {r.id: r.val for r in tv.weigh(counts, fitted).collect()}
    raw = [2.0, (1 + math.log(3)) * 3.0]
    assert got[1] == pytest.approx([x / math.hypot(*raw) for x in raw]) and got[2] == [] and got[None] == pytest.approx([1.0])
