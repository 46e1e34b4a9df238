"""Character n-gram TF-IDF in long form: (id, ngram, weight).

Everything is counted per distinct word first. Documents are partitioned by id
once; counts, weights and norms per document then need no further shuffle. Words are
cut into n-grams once per slice of documents, however many of these hold them.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Mapping, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vernissage.functions import fixed
from vernissage.session import all_partitions, land


# Distinct words of documents that are counted together, and words whose n-grams are kept.
SLICE_WORDS = 100_000
ROWS_OUT = 1024
ROWS_WEIGHED = 512


def lowered(text: str) -> Column:
    return F.lower(F.coalesce(F.col(text), F.lit(""))).alias("text")


def word_ngrams(word: str, sizes: Sequence[int] = fixed.NGRAM_SIZES) -> list[str]:
    """All n-grams of a word padded by one blank on either side, repeats kept."""
    padded = f" {word} "
    return [padded[i : i + n] for n in sizes for i in range(len(padded) - n + 1)]


class Numbers(dict):
    """Numbers 0, 1, ... for whatever is looked up, in the order it is first met."""

    def __missing__(self, key) -> int:
        self[key] = number = len(self)
        return number


# A document: its key, how many rows have this key, and its words with their counts.
Document = tuple[object, int, Counter]


def documents_in_order(batches: Iterator[pa.RecordBatch], slice_words: int) -> Iterator[list[Document]]:
    """Slices of documents from rows (key, lower-cased text) in key order; rows with equal keys are one document."""
    done, held, key, rows, found = [], 0, None, 0, Counter()
    for batch in batches:
        for value, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if rows and value != key:
                done.append((key, rows, found))
                held += len(found) + 1
                rows, found = 0, Counter()
                if held >= slice_words:
                    yield done
                    done, held = [], 0
            key, rows = value, rows + 1
            found.update(text.as_py().split())  # the characters of fixed.WORD_GAP
    if rows:
        done.append((key, rows, found))
    if done:
        yield done


class Grams:
    """N-grams of words as numbers: all n-grams, or those of a vocabulary with its numbers.

    An n-gram of a small alphabet is one whole number, a digit per character, so
    equal numbers are equal n-grams. Where the digits do not fit, n-grams are
    looked up by their text.
    """

    def __init__(self, sizes: Sequence[int], known: Mapping[str, int] | None = None):
        self.sizes, self.known = sizes, known
        self.letters = None if known is None else _codes("".join(known))

    def cut(self, words: Sequence[str]) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """(n-gram, ends, names): numbers of the n-grams of one word after another, where each word's end, and without a vocabulary the n-grams by number."""
        text = "".join(f" {w} " for w in words)
        codes = _codes(text)
        letters = np.unique(codes if self.letters is None else self.letters)
        base = len(letters) + 1
        if base ** max(self.sizes) > np.iinfo(np.int64).max:
            return self._cut_by_text(words)
        digit = np.zeros(0x110000, dtype=np.int64)
        digit[letters] = np.arange(1, base)
        digits = digit[codes]
        length = np.fromiter(map(len, words), np.int64, len(words)) + 2
        owner = np.repeat(np.arange(len(words)), length)
        left = np.repeat(np.cumsum(length), length) - np.arange(len(codes))
        found, names = [], []
        for n in self.sizes:
            at = np.flatnonzero(left >= n)
            key = _keys(digits, at, n, base)
            if self.known is None:
                _, first, number = np.unique(key, return_index=True, return_inverse=True)
                found.append((owner[at], number.reshape(-1) + len(names)))
                names += [text[i : i + n] for i in at[first].tolist()]
                continue
            own = [g for g in self.known if len(g) == n]
            if own:
                listed = _keys(digit[_codes("".join(own))], np.arange(len(own)) * n, n, base)
                order = np.argsort(listed)
                listed, numbers = listed[order], np.array([self.known[g] for g in own], dtype=np.int64)[order]
                place = np.minimum(np.searchsorted(listed, key), len(listed) - 1)
                hit = np.flatnonzero(listed[place] == key)
                found.append((owner[at[hit]], numbers[place[hit]]))
        none = np.zeros(0, dtype=np.int64)
        word, gram = (np.concatenate([none, *parts]) for parts in (zip(*found, strict=True) if found else ([], [])))
        order = np.argsort(word, kind="stable")
        return gram[order], np.searchsorted(word[order], np.arange(len(words) + 1)), names

    def _cut_by_text(self, words: Sequence[str]) -> tuple[np.ndarray, np.ndarray, list[str]]:
        numbers = Numbers()
        number = numbers.__getitem__ if self.known is None else self.known.get
        each = [[i for i in map(number, word_ngrams(w, self.sizes)) if i is not None] for w in words]
        ends = np.cumsum([0, *map(len, each)], dtype=np.int64)
        return np.fromiter(chain.from_iterable(each), np.int64, ends[-1]), ends, list(numbers)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)


def _keys(digits: np.ndarray, at: np.ndarray, n: int, base: int) -> np.ndarray:
    key = np.zeros(len(at), dtype=np.int64)
    for j in range(n):
        key = key * base + digits[at + j]
    return key


def gram_counts(documents: Sequence[Document], grams: Grams) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]:
    """(document, n-gram, count) in this order, counts of the words that hold an n-gram added up; and the n-grams by number."""
    distinct = Numbers()
    size = [len(found) for *_, found in documents]
    word = np.fromiter(map(distinct.__getitem__, chain.from_iterable(found for *_, found in documents)), np.int64, sum(size))
    n = np.fromiter(chain.from_iterable(found.values() for *_, found in documents), np.int64, sum(size))
    numbers, ends, names = grams.cut(list(distinct))
    length = (ends[1:] - ends[:-1])[word]
    before = np.cumsum(length) - length
    gram = numbers[np.arange(length.sum()) + np.repeat(ends[:-1][word] - before, length)]
    width = int(gram.max()) + 1 if len(gram) else 1
    cell = np.repeat(np.repeat(np.arange(len(documents)), size), length) * width + gram
    order = np.argsort(cell)
    cell = cell[order]
    first = np.flatnonzero(np.append(True, cell[1:] != cell[:-1])[: len(cell)])
    total = np.add.reduceat(np.repeat(n, length)[order], first) if len(first) else np.zeros(0, np.int64)
    return cell[first] // width, cell[first] % width, total, names


def in_key_order(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Keys and lower-cased texts, partitioned by key and in key order inside each partition."""
    return all_partitions(docs.select(key, lowered(text)), key).sortWithinPartitions(key)


def document_ngrams(docs: DataFrame, key: str = "id", text: str = "text", sizes: Sequence[int] = fixed.NGRAM_SIZES, slice_words: int = SLICE_WORDS) -> DataFrame:
    """(id, ngram, tf), partitioned by id."""
    kind = docs.schema[key].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for kept, documents in _with_kind(batches, slice_words):
            document, gram, n, numbers = gram_counts(documents, Grams(sizes))
            keys = pa.array([k for k, *_ in documents], kept)
            names = pa.array(numbers, pa.string())
            for a in range(0, len(n), ROWS_OUT * 64):
                part = slice(a, a + ROWS_OUT * 64)
                columns = [keys.take(pa.array(document[part])), names.take(pa.array(gram[part])), pa.array(n[part])]
                yield pa.RecordBatch.from_arrays(columns, names=[key, "ngram", "tf"])

    return in_key_order(docs, key, text).mapInArrow(count, f"`{key}` {kind}, ngram string, tf bigint")


def _with_kind(batches: Iterator[pa.RecordBatch], slice_words: int) -> Iterator[tuple[pa.DataType, list[Document]]]:
    """Slices of documents, each with the type of the keys."""
    kinds = []

    def seen() -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds[:] = [batch.schema.field(0).type]
            yield batch

    for documents in documents_in_order(seen(), slice_words):
        yield kinds[0], documents


def count_rows(docs: DataFrame, vocabulary: DataFrame, key: str = "id", text: str = "text", sizes: Sequence[int] = fixed.NGRAM_SIZES, slice_words: int = SLICE_WORDS) -> DataFrame:
    """(id, idx, tf) arrays, one row per document with at most one entry per vocabulary n-gram.

    Rows that share an id all have the counts of their texts together. A null or empty
    document, one without a vocabulary n-gram or without an id has empty arrays. The
    vocabulary is small by its limit, so every task has it whole.
    """
    places = {r["ngram"]: r["position"] for r in vocabulary.select("ngram", "position").toLocalIterator()}
    kind = docs.schema[key].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for kept, documents in _with_kind(batches, slice_words):
            known = [(k, m, Counter() if k is None else found) for k, m, found in documents]
            document, gram, n, _ = gram_counts(known, Grams(sizes, places))
            ends = np.searchsorted(document, np.arange(len(documents) + 1))
            keys = pa.array([k for k, *_ in documents], kept)
            place, tf = pa.array(gram.astype(np.int32)), pa.array(n)
            lists = [pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), x) for x in (place, tf)]
            row = np.repeat(np.arange(len(documents)), [m for _, m, _ in documents])
            for a in range(0, len(row), ROWS_OUT):
                part = pa.array(row[a : a + ROWS_OUT])
                yield pa.RecordBatch.from_arrays([x.take(part) for x in (keys, *lists)], names=[key, "idx", "tf"])

    return in_key_order(docs, key, text).mapInArrow(count, f"`{key}` {kind}, idx array<int>, tf array<bigint>")


def corpus_words(docs: DataFrame, text: str = "text", most: int = SLICE_WORDS) -> DataFrame:
    """(word, n) over all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Counter()
        for batch in batches:
            for value in batch.column(0):
                found.update(value.as_py().split())
                if len(found) >= most:
                    yield _word_batch(found)
                    found = Counter()
        yield _word_batch(found)

    return docs.select(lowered(text)).mapInArrow(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def _word_batch(found: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["word", "n"])


def ngram_totals(docs: DataFrame, text: str = "text", sizes: Sequence[int] = fixed.NGRAM_SIZES) -> DataFrame:
    """Corpus count per n-gram. Words are counted over the corpus before they are cut up."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers, ends, names = Grams(sizes).cut(batch.column(0).to_pylist())
            total = np.zeros(len(names), np.int64)
            np.add.at(total, numbers, np.repeat(batch.column(1).to_numpy(), ends[1:] - ends[:-1]))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(total)], names=["ngram", "n"])

    grams = corpus_words(docs, text).mapInArrow(cut, "ngram string, n bigint")
    return grams.groupBy("ngram").agg(F.sum("n").alias("total"))


def fit_vocabulary(docs: DataFrame, text: str = "text", sizes: Sequence[int] = fixed.NGRAM_SIZES, limit: int = fixed.MAX_NGRAMS) -> DataFrame:
    """The `limit` n-grams with the highest corpus count; ties in n-gram order."""
    return ngram_totals(docs, text, sizes).orderBy(F.desc("total"), "ngram").limit(limit)


def fit_counts(docs: DataFrame, key: str = "id", text: str = "text", sizes: Sequence[int] = fixed.NGRAM_SIZES, limit: int = fixed.MAX_NGRAMS) -> tuple[DataFrame, DataFrame]:
    """Fitted table (ngram, position, df, idf) and the counts of the documents it was fitted on.

    idf = ln((1 + n) / (1 + df)) + 1. Both are written to the shared folder:
    the texts are cut into n-grams once for fitting and weighing together.
    """
    order = Window.partitionBy(F.lit(0)).orderBy("ngram")  # at most `limit` rows
    top = fit_vocabulary(docs, text, sizes, limit)
    vocabulary = land(
        top.select("ngram", (F.row_number().over(order) - 1).alias("position")), "vocabulary"
    )
    counts = land(count_rows(docs, vocabulary, key, text, sizes), "ngram-counts")
    per_gram = counts.select(F.explode("idx").alias("position")).groupBy("position").agg(
        F.count(F.lit(1)).alias("df")
    )
    n_docs = docs.agg(F.count(F.lit(1)).alias("n")).scalar()
    idf = F.log((F.lit(1.0) + n_docs) / (F.lit(1.0) + F.col("df"))) + 1.0
    fitted = vocabulary.join(per_gram, "position").select("ngram", "position", "df", idf.alias("idf"))
    return land(fitted, "tfidf"), counts


def weigh(counts: DataFrame, fitted: DataFrame, key: str = "id") -> DataFrame:
    """(id, idx, val): (1 + ln tf) * idf with unit length per document, without a shuffle.

    Every task has the idf values, at most the vocabulary limit, and works on few rows at a
    time: a long text has an entry for most of the vocabulary.
    """
    idf = {r["position"]: r["idf"] for r in fitted.select("position", "idf").toLocalIterator()}
    table = np.full(max(idf, default=-1) + 1, np.nan)
    table[list(idf)] = list(idf.values())

    def weights(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return weighed(batches, table, key)

    kind = counts.schema[key].dataType.simpleString()
    return counts.select(key, "idx", "tf").mapInArrow(weights, f"`{key}` {kind}, idx array<int>, val array<double>")


def weighed(batches: Iterator[pa.RecordBatch], table: np.ndarray, key: str) -> Iterator[pa.RecordBatch]:
    for batch in (b.slice(a, ROWS_WEIGHED) for b in batches for a in range(0, b.num_rows, ROWS_WEIGHED)):
        place, tf = batch.column(1), batch.column(2).flatten().to_numpy()
        size = place.value_lengths().to_numpy()
        row = np.repeat(np.arange(len(size)), size)
        raw = (np.log(tf.astype(float)) + 1.0) * table[place.flatten().to_numpy()]
        length = np.sqrt(np.bincount(row, raw * raw, len(size)))
        ends = pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32))
        val = pa.ListArray.from_arrays(ends, pa.array(raw / length[row]))
        yield pa.RecordBatch.from_arrays([batch.column(0), place, val], names=[key, "idx", "val"])


def transform(docs: DataFrame, fitted: DataFrame, key: str = "id", text: str = "text", sizes: Sequence[int] = fixed.NGRAM_SIZES) -> DataFrame:
    """Weights of other documents under a fitted vocabulary."""
    return weigh(count_rows(docs, fitted, key, text, sizes), fitted, key)


def long_form(rows: DataFrame, fitted: DataFrame, key: str = "id") -> DataFrame:
    """(id, ngram, weight)."""
    entry = rows.select(key, F.explode(F.arrays_zip("idx", "val")).alias("e"))
    placed = entry.select(key, F.col("e.idx").alias("position"), F.col("e.val").alias("weight"))
    names = F.broadcast(fitted.select("position", "ngram"))
    return placed.join(names, "position").select(key, "ngram", "weight")
