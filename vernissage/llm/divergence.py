"""Source divergence audit: how differently the sources of a language use its terms.

Terms of up to 16 bytes become one or two 64-bit words, which are radix-sorted
and counted by runs; longer terms go to buckets of their length, sorted by bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vernissage.llm import bytewords as bw
from vernissage.operators.joins import spread_lookup
from vernissage.session import land

LEAST_DOCS = 30
SCALE = 1_000_000_000
PRIOR = 5
TOP = 50
# Fixed value: bytes that separate terms.
NOT_LETTER_BYTES = bw.byte_class((0x00, 0x40), (0x5B, 0x60), (0x7B, 0x7F))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SLICE_BYTES = 2 << 20
# A task keeps at most about this many counted runs before it hands them on.
_HELD_RUNS = 1 << 20
# Cells of one block of the table of shares by term and source, and rows of counts and sources of one piece of work.
_BLOCK_CELLS = 1 << 21
ROWS_PER_BUCKET = 200_000
SOURCES_PER_STRIPE = 256


def radix_order(*words: np.ndarray) -> np.ndarray:
    """Stable order by unsigned words, the first counting most: passes over 16-bit digits, last digit first."""
    order = np.arange(len(words[0]))
    for word in reversed(words):
        for shift in range(0, 8 * word.itemsize, 16):
            digit = (word >> word.dtype.type(shift)).astype(np.uint16)
            if len(digit) and (digit != digit[0]).any():
                order = order[np.argsort(digit[order], kind="stable")]
    return order


def packed_words(data: np.ndarray, start: np.ndarray, length: np.ndarray, words: int) -> list[np.ndarray]:
    """Terms of at most 8 * words bytes as big-endian words, filled up with zero bytes, which no term has."""
    padded = np.concatenate([data, np.zeros(8 * words, dtype=np.uint8)])
    windows = np.lib.stride_tricks.sliding_window_view(padded, 8)
    out = []
    for n in range(words):
        word = np.ascontiguousarray(windows[start + 8 * n]).view(">u8").ravel().astype(np.uint64)
        lost = np.clip(8 * (n + 1) - length, 0, 8)
        cut = (8 * np.minimum(lost, 7)).astype(np.uint64)
        out.append(np.where(lost == 8, np.uint64(0), (word >> cut) << cut))
    return out


def unpacked_words(words: list[np.ndarray]) -> pa.Array:
    stacked = np.stack(words, axis=1).astype(">u8") if len(words[0]) else np.zeros((0, len(words)), dtype=">u8")
    return pa.array(np.ascontiguousarray(stacked).view(f"S{8 * len(words)}").ravel(), pa.binary())


def _heads(group: np.ndarray, parts: list[np.ndarray]) -> np.ndarray:
    head = np.ones(len(group), dtype=bool)
    head[1:] = group[1:] != group[:-1]
    for part in parts:
        head[1:] |= part[1:] != part[:-1]
    return head


class Counted:
    """Counts of one length class: equal (group, term) runs of what was added."""

    def __init__(self, words: int):
        self.words, self.held = words, []

    def order(self, group: np.ndarray, parts: list[np.ndarray]) -> np.ndarray:
        if self.words <= 2:
            return radix_order(group, *parts)
        by_bytes = np.argsort(parts[0], kind="stable")
        return by_bytes[radix_order(group[by_bytes])]

    def add(self, group: np.ndarray, doc: np.ndarray, parts: list[np.ndarray]) -> None:
        """Occurrences in the order of their documents."""
        order = self.order(group, parts)
        group, doc, parts = group[order], doc[order], [p[order] for p in parts]
        head = _heads(group, parts)
        at = np.flatnonzero(head)
        new_doc = head.copy()
        new_doc[1:] |= doc[1:] != doc[:-1]
        self.held.append((group[at], np.diff(np.append(at, len(group))), np.add.reduceat(new_doc.astype(np.int64), at), [p[at] for p in parts]))

    def merge(self) -> None:
        if len(self.held) > 1:
            group, n, docs = (np.concatenate([h[k] for h in self.held]) for k in range(3))
            parts = [np.concatenate([h[3][k] for h in self.held]) for k in range(len(self.held[0][3]))]
            order = self.order(group, parts)
            group, n, docs, parts = group[order], n[order], docs[order], [p[order] for p in parts]
            at = np.flatnonzero(_heads(group, parts))
            self.held = [(group[at], np.add.reduceat(n, at), np.add.reduceat(docs, at), [p[at] for p in parts])]

    def size(self) -> int:
        return sum(len(h[0]) * max(1, self.words // 2) for h in self.held)


class TermCounts:
    """Counts of all terms of one task, in buckets of their length in 8-byte words."""

    def __init__(self):
        self.groups: dict[tuple[str, str], int] = {}
        self.classes: dict[int, Counted] = {}

    def add(self, texts: pa.Array, group: np.ndarray) -> None:
        data, offsets = bw.text_bytes(texts)
        data = _LOWER[data]
        start, end, first = bw.word_spans(data, offsets, NOT_LETTER_BYTES)
        if not len(start):
            return
        doc = np.repeat(np.arange(len(texts)), np.diff(first))
        length = end - start
        words = (length + 7) // 8
        for n in np.unique(words).tolist():
            own = np.flatnonzero(words == n)
            parts = packed_words(data, start[own], length[own], n)
            if n > 2:
                parts = [np.ascontiguousarray(np.stack(parts, axis=1).astype(">u8")).view(f"S{8 * n}").ravel()]
            self.classes.setdefault(n, Counted(n)).add(group[doc[own]], doc[own], parts)

    def merge(self) -> int:
        for counted in self.classes.values():
            counted.merge()
        return self.size()

    def size(self) -> int:
        return sum(counted.size() for counted in self.classes.values())

    def batches(self) -> Iterator[pa.RecordBatch]:
        self.merge()
        names = list(self.groups)
        langs, sources = pa.array([g[0] for g in names], pa.string()), pa.array([g[1] for g in names], pa.string())
        for n, counted in self.classes.items():
            for group, count, docs, parts in counted.held:
                for cut in range(0, len(group), 1 << 16):
                    own = slice(cut, cut + (1 << 16))
                    term = unpacked_words([p[own] for p in parts]) if n <= 2 else pa.array(parts[0][own], pa.binary())
                    place = pa.array(group[own].astype(np.int64))
                    columns = [langs.take(place), sources.take(place), term.cast(pa.string()), pa.array(count[own].astype(np.int64)), pa.array(docs[own])]
                    yield pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "n", "docs"])
        self.classes = {}


def count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts, limit = TermCounts(), _HELD_RUNS
    for batch in batches:
        pairs = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
        group = np.array([counts.groups.setdefault(pair, len(counts.groups)) for pair in pairs], dtype=np.uint32)
        texts = batch.column(2)
        for a, b in bw.slices(texts, _SLICE_BYTES):
            counts.add(texts.slice(a, b - a), group[a:b])
            if counts.size() > limit:
                if counts.merge() > limit // 2:
                    yield from counts.batches()
    yield from counts.batches()


def term_counts(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", least_docs: int = LEAST_DOCS) -> DataFrame:
    """(lang, source, term, n, lang_n, first) of the terms in at least `least_docs` rows of their language.

    `first` marks one row per language and term. Tasks hand on counted runs, so
    what is shuffled are the distinct terms of a task, dealt by language and term.
    """
    named = lambda c: F.coalesce(F.col(c), F.lit(""))
    rows = docs.select(named(lang).alias("lang"), named(source).alias("source"), F.col(text).alias("text"))
    partial = rows.mapInArrow(count_batches, "lang string, source string, term string, n bigint, docs bigint")
    sums = partial.repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    own = Window.partitionBy("lang", "term")
    told = sums.select(
        "lang", "source", "term", "n", F.sum("n").over(own).alias("lang_n"), F.sum("docs").over(own).alias("_docs"),
        (F.row_number().over(own.orderBy("source")) == 1).alias("first"),
    )
    return told.filter(F.col("_docs") >= least_docs).drop("_docs")


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (count + PRIOR) / (total + PRIOR * terms)), exact."""
    whole = lambda c: c.cast("decimal(18,0)")
    above = F.lit(SCALE).cast("decimal(10,0)") * whole(count + PRIOR)
    return F.lit(1) + F.call_function("div", above, whole(total + PRIOR * terms))


def shares(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE * count / total) for count <= total < 2**48, by two steps of long division in 64 bits."""
    high, rest = np.divmod(count * 31_250, total)
    return 1 + high * 32_000 + rest * 32_000 // total


def group_totals(docs: DataFrame, counts: DataFrame, lang: str, source: str, rows_per_bucket: int, sources_per_stripe: int) -> DataFrame:
    """One row per (lang, source) with total, terms and lang_total, its place, and how the work of its language is cut."""
    named = lambda c: F.coalesce(F.col(c), F.lit(""))
    groups = docs.select(named(lang).alias("lang"), named(source).alias("source")).distinct()
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    langs = counts.groupBy("lang").agg(F.sum("n").alias("lang_total"), F.sum(F.col("first").cast("long")).alias("terms"), F.count(F.lit(1)).alias("_rows"))
    told = groups.join(totals, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["total", "lang_total", "terms", "_rows"])
    stripes = F.ceil(F.count(F.lit(1)).over(Window.partitionBy("lang")) / sources_per_stripe)
    place = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    return told.select(
        "lang", "source", "total", "terms", "lang_total", place.alias("place"),
        F.greatest(F.lit(1), F.ceil(F.col("_rows") / rows_per_bucket)).cast("int").alias("buckets"), stripes.cast("int").alias("stripes"),
    )


def _pair_sums(sources_per_stripe: int):
    def run(key: tuple, counts: pa.Table, groups: pa.Table) -> pa.Table:
        lang, _, stripe = (k.as_py() for k in key)
        groups = groups.sort_by("_place")
        names = groups.column("_source").to_pylist()
        first = stripe * sources_per_stripe
        mine = range(first, min(first + sources_per_stripe, len(names)))
        sums = np.zeros((len(mine), len(names)), dtype=np.int64)
        if len(counts):
            total = groups.column("_total").to_numpy() + PRIOR * groups.column("_terms").to_numpy()
            unseen = shares(np.full(len(names), PRIOR, dtype=np.int64), total)
            term = counts.column("term").combine_chunks().dictionary_encode()
            term = (term.combine_chunks() if isinstance(term, pa.ChunkedArray) else term).indices.to_numpy()
            order = np.argsort(term, kind="stable")
            term, place, n = term[order], counts.column("place").to_numpy()[order], counts.column("n").to_numpy()[order]
            block = max(1, _BLOCK_CELLS // len(names))
            for low in range(0, int(term[-1]) + 1, block):
                a, b = np.searchsorted(term, [low, low + block])
                table = np.tile(unseen, (int(term[b - 1]) + 1 - low, 1))
                table[term[a:b] - low, place[a:b]] = shares(n[a:b] + PRIOR, total[place[a:b]])
                for row, i in enumerate(mine):
                    sums[row, i + 1 :] += np.abs(table[:, i + 1 :] - table[:, i : i + 1]).sum(0)
        left, right = np.nonzero(np.arange(len(names)) > np.array(mine, dtype=np.int64)[:, None])
        all_names = pa.array(names, pa.string())
        return pa.table({
            "lang": pa.array([lang] * len(left), pa.string()), "source": all_names.take(pa.array(left + first)),
            "item": all_names.take(pa.array(right)), "value": pa.array(sums[left, right]),
        })

    return run


def pair_divergence(counts: DataFrame, groups: DataFrame, sources_per_stripe: int = SOURCES_PER_STRIPE) -> DataFrame:
    """(lang, source, item, value) for every two sources of a language, both ways.

    `counts` carries place, buckets and stripes of its group. The terms of a
    language are cut into buckets and its sources into stripes; a piece of work
    adds up the differences of one bucket between one stripe and all sources.
    """
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    bucket = F.pmod(F.xxhash64("term"), F.col("buckets")).cast("int").alias("bucket")
    left = counts.select("lang", bucket, every("stripes").alias("stripe"), "term", "place", "n")
    right = groups.select("lang", "stripes", "source", "place", "total", "terms", every("buckets").alias("bucket"))
    right = right.select("lang", "bucket", every("stripes").alias("stripe"), *[F.col(c).alias(f"_{c}") for c in ("source", "place", "total", "terms")])
    keys = ("lang", "bucket", "stripe")
    parts = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_pair_sums(sources_per_stripe), "lang string, source string, item string, value bigint")
    halves = parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    turned = F.explode(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item"))))
    return halves.select("lang", turned.alias("p"), "value").select("lang", "p.source", "p.item", "value")


def audit(
    docs: DataFrame,
    lang: str = "lang",
    source: str = "source",
    text: str = "text",
    least_docs: int = LEAST_DOCS,
    top: int = TOP,
    rows_per_bucket: int = ROWS_PER_BUCKET,
    sources_per_stripe: int = SOURCES_PER_STRIPE,
) -> DataFrame:
    """(lang, source, part, item, value, rank) of how far sources of a language lie apart.

    Terms are runs of letters and of characters beyond ASCII, with A-Z in lower
    case; a language keeps those found in at least `least_docs` of its rows. A
    kept term's share in a group of rows is 1 + floor(10**9 * (count + 5) /
    (all counts + 5 * kept terms)). Part `pair` has, for each other source of
    the language, the sum of the differences of all shares; part `term` the
    `top` terms whose share in the source lies farthest above the language's.
    All arithmetic is exact. Ties go by the bytes of the item.

    Null languages, sources and texts count as empty ones; a source without
    terms still has pairs, a language without kept terms has pairs of value 0,
    one without a second source has none. Repeated rows count each. An empty
    table gives no rows; other columns are ignored.
    """
    counts = land(term_counts(docs, lang, source, text, least_docs), "term-counts")
    groups = land(group_totals(docs, counts, lang, source, rows_per_bucket, sources_per_stripe), "term-groups")
    sizes = counts.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("_n"))
    told = spread_lookup(counts, groups, ["lang", "source"], row_id="term", sizes=sizes)
    pairs = pair_divergence(told, groups, sources_per_stripe).select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    above = share(F.col("n"), F.col("total"), F.col("terms")) - share(F.col("lang_n"), F.col("lang_total"), F.col("terms"))
    terms = told.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), above.cast("long").alias("value")).filter("value > 0")
    ranked = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")).alias("rank")
    return pairs.select("*", ranked).unionByName(terms.select("*", ranked).filter(F.col("rank") <= top))
