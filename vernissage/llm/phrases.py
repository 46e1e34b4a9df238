"""Phrase collocation mining by prefix-free parsing.

Texts are cut into chunks where the content says so, so passages that repeat
give the same chunks. Chunks overlap by one word less than the longest phrase
and form a dictionary with the frequency of each; phrases are counted inside
distinct chunks, weighted, and a phrase that lies in an overlap belongs to the
chunk in which it does not start there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vernissage.llm import bytewords as bw
from vernissage.llm.substring import pack, pack_sorted, unpack, unpack_sorted
from vernissage.operators.joins import spread_lookup
from vernissage.session import land

LONGEST = 5
LEAST = 100
TOP = 2000
COVER = 100
# A chunk ends about every so many words.
MODULUS = 24
PART_BYTES = 8 << 20
BLOCK_CELLS = 1 << 22
# Phrases of all lengths come to almost one a byte of text; a cell then adds up about eight of them.
BYTES_PER_CELL = 10
_SLICE_BYTES = 2 << 20
_SALTS = 64
# Bytes between words, and bytes no phrase goes across.
GAP_BYTES = bw.byte_class((0x09, 0x09), (0x20, 0x20))
BREAK_BYTES = bw.byte_class((0x0A, 0x0D), *[(ord(c), ord(c)) for c in ".,;:!?"])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_CHUNK = pa.schema([("lang", pa.string()), ("tail", pa.bool_()), ("chunk", pa.string()), ("n", pa.int64())])
_PARTS = pa.schema([("block", pa.int32()), ("part", pa.int32()), ("payload", pa.binary())])
_LISTS = pa.schema([("shard", pa.int32()), ("lang", pa.string()), ("numbers", pa.binary()), ("texts", pa.binary())])
_PHRASES = pa.schema([("lang", pa.string()), ("words", pa.int32()), ("phrase", pa.string()), ("n", pa.int64())])


def sliced(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Array:
    """Byte ranges of one buffer, which may overlap, as strings."""
    offsets = np.concatenate([[0], np.cumsum(end - start)]).astype(np.int64)
    at = np.repeat(start - offsets[:-1], end - start) + np.arange(offsets[-1])
    buffers = [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data[at]))]
    return pa.Array.from_buffers(pa.large_string(), len(start), buffers)


def parsed(langs: pa.Array, texts: pa.Array, overlap: int, modulus: int) -> pa.Table:
    """Distinct chunks of some texts with their frequency; `tail` marks chunks at the end of a piece."""
    data, offsets = bw.text_bytes(texts)
    data = _LOWER[data]
    start, end, first = bw.word_spans(data, offsets, GAP_BYTES | BREAK_BYTES)
    if not len(start):
        return _CHUNK.empty_table()
    # The words of all texts in a row, one space between.
    length = end - start
    new_end = np.cumsum(length + 1) - 1
    new_start = new_end - length
    joined = np.full(new_end[-1] + 1, 0x20, dtype=np.uint8)
    at = np.flatnonzero(~(GAP_BYTES | BREAK_BYTES)[data])
    joined[at + np.repeat(new_start - start, length)] = data[at]
    row = np.repeat(np.arange(len(texts)), np.diff(first))
    piece = np.cumsum(BREAK_BYTES[data])[start]
    opens = np.ones(len(start), dtype=bool)
    opens[1:] = (row[1:] != row[:-1]) | (piece[1:] != piece[:-1])
    bounds = np.append(np.flatnonzero(opens), len(start))
    piece_end = np.repeat(bounds[1:], np.diff(bounds))
    cuts = opens.copy()
    windows = bw.window_hashes(bw.word_hashes(data, start, end, 5), overlap, 6)
    cuts[: len(windows)] |= (windows % np.uint64(modulus) == 0) & (np.arange(len(windows)) + overlap <= piece_end[: len(windows)])
    begin = np.flatnonzero(cuts)
    following = np.append(begin[1:], len(start))
    tail = following >= piece_end[begin]
    last = np.where(tail, piece_end[begin], following + overlap) - 1
    chunk = sliced(joined, new_start[begin], new_end[last]).cast(pa.string())
    table = pa.table({"lang": langs.take(pa.array(row[begin])), "tail": pa.array(tail), "chunk": chunk})
    counted = table.group_by(["lang", "tail", "chunk"]).aggregate([([], "count_all")])
    return counted.rename_columns({"count_all": "n"}).select(_CHUNK.names).cast(_CHUNK)


def dictionary(docs: DataFrame, lang: str, text: str, parts: int, longest: int, modulus: int) -> DataFrame:
    """(part, lang, tail, chunk, n): distinct chunks dealt into parts by their content."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            for a, b in bw.slices(texts, _SLICE_BYTES):
                yield from parsed(batch.column(0).slice(a, b - a), texts.slice(a, b - a), longest - 1, modulus).to_batches()

    rows = docs.select(F.coalesce(F.col(lang), F.lit("und")).alias("lang"), F.col(text).alias("text"))
    chunks = rows.mapInArrow(parse, "lang string, tail boolean, chunk string, n bigint")
    dealt = chunks.select(F.pmod(F.xxhash64("lang", "tail", "chunk"), F.lit(parts)).cast("int").alias("part"), "*").repartition("part")
    return dealt.groupBy("part", "lang", "tail", "chunk").agg(F.sum("n").alias("n"))


class Part:
    """Words of the chunks of one part, and where phrases of each length start."""

    def __init__(self, table: pa.Table, longest: int):
        self.table, self.longest = table.combine_chunks(), longest
        self.langs = self.table.column("lang").combine_chunks().dictionary_encode()
        if isinstance(self.langs, pa.ChunkedArray):
            self.langs = self.langs.combine_chunks()
        self.lang = self.langs.indices.to_numpy()
        self.tail = self.table.column("tail").to_numpy()
        self.weight = self.table.column("n").to_numpy()
        self.chunks = self.table.column("chunk").combine_chunks()
        if isinstance(self.chunks, pa.ChunkedArray):
            self.chunks = pa.concat_arrays(self.chunks.chunks)
        salts = [int.from_bytes(str(v).encode()[:8].ljust(8, b"\0"), "little") + 31 * len(str(v)) for v in self.langs.dictionary.to_pylist()]
        self.salt = bw.mixed(np.array(salts, dtype=np.uint64))

    def slices(self) -> Iterator[tuple]:
        """(bytes, word starts, word ends, row of each word, words left in its chunk, whether phrases may start there)."""
        for a, b in bw.slices(self.chunks, _SLICE_BYTES):
            data, offsets = bw.text_bytes(self.chunks.slice(a, b - a))
            start, end, first = bw.word_spans(data, offsets, GAP_BYTES)
            count = np.diff(first)
            row = np.repeat(np.arange(a, b), count)
            left = np.repeat(first[1:], count) - np.arange(len(start))
            yield data, start, end, row, left, self.tail[row] | (left >= self.longest)

    def phrases(self, width: int) -> Iterator[tuple]:
        """(bytes, word starts, word ends, n, first word, row, cell) of the phrases of n words, per slice and n."""
        for data, start, end, row, left, owned in self.slices():
            words = bw.word_hashes(data, start, end, 3)
            for n in range(1, self.longest + 1):
                at = np.flatnonzero(owned & (left >= n))
                hashes = bw.window_hashes(words, n, n)[at] + self.salt[self.lang[row[at]]] * np.uint64(2 * n + 1)
                yield data, start, end, n, at, row[at], bw.mixed(hashes) % np.uint64(width)


def added_cells(packed: list[np.ndarray], most: int) -> np.ndarray:
    """Cells with their sums, each as one number: cell * (most + 1) + sum, in order of cells, sums not above `most`.

    The list is emptied: a part's phrases are held once, in one number each.
    """
    every = np.concatenate([np.zeros(0, np.uint64), *packed])
    packed.clear()
    every.sort()
    cell, step = every // np.uint64(most + 1), np.uint64(most + 1)
    at = np.flatnonzero(np.append(True, cell[1:] != cell[:-1])[: len(cell)])
    every %= step
    total = np.add.reduceat(every, at) if len(at) else every
    del every
    cell = cell[at]
    del at
    cell *= step
    cell += np.minimum(total, np.uint64(most), out=total)
    return cell


def phrase_counts(
    docs: DataFrame,
    lang: str = "lang",
    text: str = "text",
    longest: int = LONGEST,
    least: int = LEAST,
    modulus: int = MODULUS,
    part_bytes: int = PART_BYTES,
    block_cells: int = BLOCK_CELLS,
    bytes_per_cell: float = BYTES_PER_CELL,
) -> DataFrame:
    """(lang, words, phrase, n) of all phrases of up to `longest` words that occur at least `least` times; words 0 has all words.

    Parts of the dictionary add up their phrases in hashed cells; blocks of
    cells add up the parts and send back which of its cells reach `least`. A
    cell never counts too little, so phrases outside such cells are not
    frequent, and those inside are counted by their words: a part sends its sums
    as packed lists, dealt into as many shards as there are parts.
    """
    size = docs.agg(F.sum(F.octet_length(F.col(text)))).first()[0] or 0
    parts = max(1, -(-size // part_bytes))
    blocks = max(1, -(-int(size / bytes_per_cell) // block_cells))
    width = blocks * block_cells
    edges = np.arange(blocks + 1, dtype=np.uint64) * np.uint64(block_cells)
    chunks = dictionary(docs, lang, text, parts, longest, modulus)

    def sketch(table: pa.Table) -> pa.Table:
        part = Part(table, longest)
        packed, step = [], np.uint64(least + 1)
        for *_, row, cell in part.phrases(width):
            packed.append(added_cells([cell * step + np.minimum(part.weight[row], least).astype(np.uint64)], least))
        packed = added_cells(packed, least)
        cell = packed // step
        total = packed - cell * step
        bounds, number, out = np.searchsorted(cell, edges), table.column("part")[0].as_py(), []
        for b in np.flatnonzero(np.diff(bounds)).tolist():
            own = slice(bounds[b], bounds[b + 1])
            out.append((b, number, pack_sorted((cell[own] - edges[b]).astype(np.uint32), total[own].astype(np.uint32))))
        return _table(out, _PARTS)

    def merge(table: pa.Table) -> pa.Table:
        held, block, out = np.zeros(block_cells, dtype=np.uint32), table.column("block")[0].as_py(), []
        for payload in table.column("payload"):
            places, sums = unpack_sorted(payload.as_py(), "u4", "u4")
            held[places] = np.minimum(held[places] + sums, least)
        for part, payload in zip(table.column("part").to_pylist(), table.column("payload"), strict=True):
            places, _ = unpack_sorted(payload.as_py(), "u4", "u4")
            places = places[held[places] >= least]
            if len(places):
                out.append((block, part, pack_sorted(places)))
        return _table(out, _PARTS)

    def frequent(table: pa.Table, flags: pa.Table) -> pa.Table:
        if not len(table):
            return _table([], _LISTS)
        part = Part(table, longest)
        told = zip(flags.column("block").to_pylist(), flags.column("payload"), strict=True)
        passing = [unpack_sorted(payload.as_py(), "u4")[0].astype(np.uint64) + edges[block] for block, payload in told]
        passing = np.sort(np.concatenate([np.zeros(0, np.uint64), *passing]))
        total, found = np.zeros(len(part.langs.dictionary), dtype=np.int64), []
        for data, start, end, n, at, row, cell in part.phrases(width):
            if n == 1:
                np.add.at(total, part.lang[row], part.weight[row])
            if len(passing):
                place = np.minimum(np.searchsorted(passing, cell), len(passing) - 1)
                own = np.flatnonzero(passing[place] == cell)
                shard = (cell[own] % np.uint64(parts)).astype(np.int32)
                phrase = sliced(data, start[at[own]], end[at[own] + n - 1])
                found.append(_summed(_rows(shard, part.lang[row[own]], np.full(len(own), n), phrase, part.weight[row[own]])))
        found.append(_rows(np.zeros(len(total)), np.arange(len(total)), np.zeros(len(total)), pa.array([""] * len(total), pa.large_string()), total))
        return _lists(_summed(pa.concat_tables(found)), part.langs.dictionary)

    def add(table: pa.Table) -> pa.Table:
        langs, rows = {}, []
        for lang, numbers, texts in zip(table.column("lang").to_pylist(), table.column("numbers"), table.column("texts"), strict=True):
            length, words, n = unpack(numbers.as_py(), "u4", "u1", "i8")
            offsets = np.concatenate([[0], np.cumsum(length, dtype=np.int64)])
            phrase = pa.Array.from_buffers(pa.large_string(), len(length), [None, pa.py_buffer(offsets), pa.py_buffer(zstandard.decompress(texts.as_py()))])
            rows.append(_rows(np.zeros(len(n)), np.full(len(n), langs.setdefault(lang, len(langs))), words, phrase, n))
        sums = _summed(pa.concat_tables(rows))
        sums = sums.filter(pc.or_(pc.equal(sums["words"], 0), pc.greater_equal(sums["n"], least)))
        names = pa.array(list(langs), pa.string()).take(sums.column("lang").combine_chunks())
        return pa.table([names, sums.column("words"), sums.column("phrase").cast(pa.string()), sums.column("n")], schema=_PHRASES)

    flags = chunks.groupBy("part").applyInArrow(sketch, "block int, part int, payload binary").groupBy("block").applyInArrow(merge, "block int, part int, payload binary")
    lists = chunks.groupBy("part").cogroup(flags.groupBy("part")).applyInArrow(frequent, "shard int, lang string, numbers binary, texts binary")
    return lists.groupBy("shard").applyInArrow(add, "lang string, words int, phrase string, n bigint")


_COUNTED = pa.schema([("shard", pa.int32()), ("lang", pa.int32()), ("words", pa.int32()), ("phrase", pa.large_string()), ("n", pa.int64())])


def _rows(shard: np.ndarray, lang: np.ndarray, words: np.ndarray, phrase: pa.Array, n: np.ndarray) -> pa.Table:
    numbers = [pa.array(x.astype(np.int32)) for x in (shard, lang, words)]
    return pa.table([*numbers, phrase, pa.array(n.astype(np.int64))], schema=_COUNTED)


def _summed(rows: pa.Table) -> pa.Table:
    keys = ["shard", "lang", "words", "phrase"]
    return rows.group_by(keys).aggregate([("n", "sum")]).rename_columns({"n_sum": "n"}).select(_COUNTED.names)


def _lists(rows: pa.Table, langs: pa.Array) -> pa.Table:
    """One row per shard and language: lengths, word counts, sums and the bytes of its phrases."""
    rows = rows.take(pa.array(np.lexsort([rows.column(c).to_numpy() for c in ("lang", "shard")])))
    shard, lang, words, n = (rows.column(c).to_numpy() for c in ("shard", "lang", "words", "n"))
    data, offsets = bw.text_bytes(rows.column("phrase").cast(pa.large_binary()))
    bounds = np.append(np.flatnonzero(np.append(True, (shard[1:] != shard[:-1]) | (lang[1:] != lang[:-1]))[: len(n)]), len(n))
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        numbers = pack(np.diff(offsets[a : b + 1]).astype(np.uint32), words[a:b].astype(np.uint8), n[a:b])
        out.append((int(shard[a]), langs[int(lang[a])].as_py(), numbers, zstandard.compress(data[offsets[a] : offsets[b]].tobytes(), 1)))
    return _table(out, _LISTS)


def _table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    columns = zip(*rows, strict=True) if rows else [[]] * len(schema)
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def cut_score(a: Column, n: Column, l: Column, r: Column) -> Column:  # noqa: E741
    """floor(1000 * a * n / (l * r)), exact; counts may have 16 digits."""
    whole = lambda c: c.cast("decimal(16,0)")
    above = F.lit(1000).cast("decimal(4,0)") * whole(a) * whole(n)
    return F.call_function("div", above, whole(l) * whole(r))


def collocations(docs: DataFrame, lang: str = "lang", text: str = "text", least: int = LEAST, top: int = TOP, cover: int = COVER, longest: int = LONGEST, **settings) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the strongest phrases of each language.

    Texts, with A-Z in lower case, are cut at `.,;:!?` and line ends; words lie
    between spaces and tabs. Phrases of 2 to `longest` words with at least
    `least` occurrences a are candidates; the weakest cut into a first part (l
    occurrences) and a rest (r) scores floor(1000 * a * n / (l * r)), n all
    words of the language. A candidate goes when a longer one around it has at
    least `cover` hundredths of its occurrences. Each language's first `top` by
    score, a (both descending) and bytes of the phrase are returned.

    A null language is `und`, null and empty texts have no words; a language
    without candidates gives no rows, an empty table none at all. Repeated rows
    count each; other columns are ignored. Texts and pieces may have any length.
    """
    counts = land(phrase_counts(docs, lang, text, longest, least, **settings), "phrase-counts")
    words = counts.filter("words = 0").select("lang", F.col("n").alias("all"))
    known = counts.filter("words > 0")
    candidates = land(spread_lookup(known.filter("words > 1").withColumnRenamed("n", "a"), words, ["lang"], row_id="phrase"), "phrase-candidates")
    cuts = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cuts = cuts.withColumn("head", F.expr("substring_index(phrase, ' ', k)")).withColumn("rest", F.expr("substring(phrase, length(head) + 2)"))
    cuts = spread_lookup(cuts, known.select("lang", F.col("phrase").alias("head"), F.col("n").alias("l")), ["lang", "head"], row_id="phrase")
    cuts = spread_lookup(cuts, known.select("lang", F.col("phrase").alias("rest"), F.col("n").alias("r")), ["lang", "rest"], row_id="phrase")
    scored = cuts.select("lang", "phrase", "a", "all", F.struct(cut_score(F.col("a"), F.col("all"), F.col("l"), F.col("r")).alias("score"), "k", "l", "r").alias("cut"))
    scored = scored.groupBy("lang", "phrase", "a", "all").agg(F.min("cut").alias("cut"))
    inner = "flatten(transform(sequence(2, words - 1), m -> transform(sequence(1, words - m + 1), i -> array_join(slice(split(phrase, ' '), i, m), ' '))))"
    around = candidates.filter("words > 2").select("lang", "a", F.explode(F.expr(inner)).alias("phrase"))
    around = around.groupBy("lang", "phrase").agg(F.max("a").alias("around"))
    left = scored.join(around, ["lang", "phrase"], "left").filter(F.col("around").isNull() | (100 * F.col("around") < cover * F.col("a")))
    rows = left.select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), F.col("all").alias("n"), F.col("cut.score").alias("score"))
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64("phrase"), F.lit(_SALTS)))
    some = salted.withColumn("_place", F.row_number().over(Window.partitionBy("lang", "_salt").orderBy(*order))).filter(F.col("_place") <= top)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
