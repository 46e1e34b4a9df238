"""Substring deduplication: a count-min prefilter, then exact groups of the windows it leaves.

Documents are dealt into chunks by key. A chunk sends, per row of the sketch,
the cells its windows fall into; blocks of cells add up the chunks' parts and
send back which of its cells hold more than one window. Windows with only such
cells are grouped exactly by shards of their hash, and each chunk learns which
of its windows start earlier elsewhere. What travels are compressed arrays in
proportion to the windows; neither the sketch nor the set of repeated windows
is ever in one place.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vernissage.llm import bytewords as bw

WINDOW = 20
ROWS = 2
CELLS_PER_WINDOW = 4
BLOCK_CELLS = 1 << 23
CHUNK_BYTES = 6 << 20
_BYTES_PER_WORD = 6
_SLICE_BYTES = 1 << 20
_PARTS = pa.schema([("block", pa.int32()), ("chunk", pa.int32()), ("payload", pa.binary())])
_FLAGS = pa.schema([("chunk", pa.int32()), ("block", pa.int32()), ("payload", pa.binary())])
_CANDIDATES = pa.schema([("shard", pa.int32()), ("chunk", pa.int32()), ("local", pa.bool_()), ("payload", pa.binary())])
_REPEATS = pa.schema([("chunk", pa.int32()), ("payload", pa.binary())])
_LAST = np.iinfo(np.int64).max


def pack(*arrays: np.ndarray) -> bytes:
    """Whole-number arrays of one length as compressed byte planes."""
    head = np.array([len(arrays[0])] + [a.itemsize for a in arrays], dtype=np.uint32).tobytes()
    planes = [np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T.tobytes() for a in arrays]
    return zstandard.compress(head + b"".join(planes), 1)


def unpack(payload: bytes, *kinds: str) -> list[np.ndarray]:
    raw = np.frombuffer(zstandard.decompress(payload), dtype=np.uint8)
    head = raw[: 4 * (1 + len(kinds))].view(np.uint32)
    n, at, out = int(head[0]), 4 * (1 + len(kinds)), []
    for kind, width in zip(kinds, head[1:].tolist(), strict=True):
        planes = raw[at : at + n * width].reshape(width, n)
        out.append(np.ascontiguousarray(planes.T).view(kind).reshape(n))
        at += n * width
    return out


def pack_sorted(values: np.ndarray, *more: np.ndarray) -> bytes:
    return pack(np.diff(values, prepend=values.dtype.type(0)), *more)


def unpack_sorted(payload: bytes, kind: str, *more: str) -> list[np.ndarray]:
    steps, *rest = unpack(payload, kind, *more)
    return [np.cumsum(steps, dtype=kind), *rest]


class Chunk:
    """Words and windows of the documents of one chunk, in the order of their keys (null last)."""

    def __init__(self, table: pa.Table):
        self.table = table.sort_by([("key", "ascending"), ("text", "ascending")])
        self.texts = self.table.column("text").combine_chunks()
        if isinstance(self.texts, pa.ChunkedArray):
            self.texts = pa.concat_arrays(self.texts.chunks) if self.texts.num_chunks else pa.array([], pa.string())

    def words(self) -> Iterable[tuple[int, np.ndarray, np.ndarray, tuple]]:
        for a, b in bw.slices(self.texts, _SLICE_BYTES):
            data, offsets = bw.text_bytes(self.texts.slice(a, b - a))
            yield a, data, offsets, bw.word_spans(data, offsets, bw.SPACE_BYTES)

    def hash_windows(self, n: int) -> None:
        """hashes, their second halves, row of the document of each window."""
        hashes, seconds, rows = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for a, data, _, (start, end, first) in self.words():
            at, row = window_starts(first, n)
            word = bw.word_hashes(data, start, end, 3)
            hashes.append(bw.window_hashes(word, n, 1)[at])
            other = bw.window_hashes(bw.word_hashes(data, start, end, 11), n, 2)[at]
            seconds.append((other >> np.uint64(32)).astype(np.uint32))
            rows.append(row + a)
        self.hashes, self.seconds, self.rows = (np.concatenate(x) for x in (hashes, seconds, rows))


def window_starts(first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(word, text) of each window start, given the first word of each text."""
    counts = np.maximum(np.diff(first) - n + 1, 0)
    row = np.repeat(np.arange(len(counts)), counts)
    before = np.cumsum(counts) - counts
    return first[row] + np.arange(len(row)) - before[row], row


def cells(hashes: np.ndarray, row: int, width: int) -> np.ndarray:
    return bw.mixed(hashes + np.uint64(row + 1) * np.uint64(0x9E3779B9)) % np.uint64(width)


def dedup_substrings(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    window: int = WINDOW,
    chunk_bytes: int = CHUNK_BYTES,
    block_cells: int = BLOCK_CELLS,
    cells_per_window: float = CELLS_PER_WINDOW,
) -> DataFrame:
    """(key, n_words, n_removed, kept) for every row of `docs`.

    A word is removed when it lies in a window of `window` words that also
    starts earlier: in a row with a smaller key, or in the same row before. The
    words kept are joined by one space in `kept`.

    The sketch never counts too little, so every repeated window reaches the
    exact pass, whatever the size of the sketch; a small sketch only lets more
    windows through. Windows are told apart there by 96 bits, from two hashes of
    the words' bytes that are independent of each other.

    Null texts have no words. A null key comes after all others; rows that share
    a key count as one after the other, in the order of their texts, so of rows
    repeated in full all but one lose what fills a window. Texts shorter than a
    window stay whole. An empty table gives no rows; other columns are ignored.
    """
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks = max(1, -(-size // chunk_bytes))
    blocks = max(1, -(-int(size * cells_per_window / _BYTES_PER_WORD) // block_cells))
    width = blocks * block_cells
    dealt = rows.withColumn("chunk", F.pmod(F.xxhash64("key"), F.lit(chunks)).cast("int"))

    def sketch(table: pa.Table) -> pa.Table:
        chunk = Chunk(table)
        chunk.hash_windows(window)
        number = table.column("chunk")[0].as_py()
        out = []
        for row in range(ROWS):
            own, counts = np.unique(cells(chunk.hashes, row, width), return_counts=True)
            bounds = np.searchsorted(own, np.arange(blocks + 1, dtype=np.uint64) * np.uint64(block_cells))
            for b in np.flatnonzero(np.diff(bounds)).tolist():
                part = slice(bounds[b], bounds[b + 1])
                places = (own[part] - np.uint64(b * block_cells)).astype(np.uint32)
                out.append((row * blocks + b, number, pack_sorted(places, (counts[part] > 1).astype(np.uint8))))
        return _table(out, _PARTS)

    def merge(table: pa.Table) -> pa.Table:
        held = np.zeros(block_cells, dtype=np.uint8)
        block, out = table.column("block")[0].as_py(), []
        for payload in table.column("payload"):
            places, more = unpack_sorted(payload.as_py(), "u4", "u1")
            held[places] = np.minimum(held[places] + 1 + more, 2)
        for chunk, payload in zip(table.column("chunk").to_pylist(), table.column("payload"), strict=True):
            places, _ = unpack_sorted(payload.as_py(), "u4", "u1")
            out.append((chunk, block, np.packbits(held[places] > 1).tobytes()))
        return _table(out, _FLAGS)

    def candidates(table: pa.Table, flags: pa.Table) -> pa.Table:
        chunk = Chunk(table)
        chunk.hash_windows(window)
        if not len(chunk.hashes):
            return _table([], _CANDIDATES)
        number = table.column("chunk")[0].as_py()
        told = dict(zip(flags.column("block").to_pylist(), flags.column("payload"), strict=True))
        repeated = np.ones(len(chunk.hashes), dtype=bool)
        for row in range(ROWS):
            own, place = np.unique(cells(chunk.hashes, row, width), return_inverse=True)
            bounds = np.searchsorted(own, np.arange(blocks + 1, dtype=np.uint64) * np.uint64(block_cells))
            more = np.zeros(len(own), dtype=bool)
            for b in np.flatnonzero(np.diff(bounds)).tolist():
                bits = np.frombuffer(told[row * blocks + b].as_py(), dtype=np.uint8)
                more[bounds[b] : bounds[b + 1]] = np.unpackbits(bits, count=bounds[b + 1] - bounds[b])
            repeated &= more[place]
        at = np.flatnonzero(repeated)
        h, s = chunk.hashes[at], chunk.seconds[at]
        order = np.lexsort((at, s, h))
        h, s, at = h[order], s[order], at[order]
        head = np.ones(len(at), dtype=bool)
        head[1:] = (h[1:] != h[:-1]) | (s[1:] != s[:-1])
        out = []
        again = np.sort(at[~head]).astype(np.uint32)
        if len(again):
            out.append((number, number, True, pack_sorted(again)))
        h, s, at = h[head], s[head], at[head]
        keys = _order_keys(chunk.table)[chunk.rows[at]]
        shard = (h % np.uint64(chunks)).astype(np.int64)
        order = np.lexsort((at, shard))
        bounds = np.searchsorted(shard[order], np.arange(chunks + 1))
        for b in np.flatnonzero(np.diff(bounds)).tolist():
            own = order[bounds[b] : bounds[b + 1]]
            out.append((b, number, False, pack_sorted(at[own].astype(np.uint32), h[own], s[own], keys[own])))
        return _table(out, _CANDIDATES)

    def exact(table: pa.Table) -> pa.Table:
        out, parts, numbers = [], [], []
        for chunk, local, payload in zip(table.column("chunk").to_pylist(), table.column("local").to_pylist(), table.column("payload"), strict=True):
            if local:
                out.append((chunk, payload.as_py()))
            else:
                parts.append(unpack_sorted(payload.as_py(), "u4", "u8", "u4", "i8"))
                numbers.append(chunk)
        if parts:
            at, h, s, keys = (np.concatenate(x) for x in zip(*parts, strict=True))
            chunk = np.repeat(numbers, [len(p[0]) for p in parts])
            order = np.lexsort((keys, s, h))
            later = np.zeros(len(at), dtype=bool)
            later[order[1:]] = (h[order[1:]] == h[order[:-1]]) & (s[order[1:]] == s[order[:-1]])
            begin = 0
            for number, part in zip(numbers, parts, strict=True):
                own = slice(begin, begin + len(part[0]))
                begin = own.stop
                found = at[own][later[own]]
                if len(found):
                    out.append((number, pack_sorted(np.sort(found))))
        return _table(out, _REPEATS)

    def remove(table: pa.Table, repeats: pa.Table) -> pa.Table:
        chunk = Chunk(table)
        gone = [unpack_sorted(p.as_py(), "u4")[0] for p in repeats.column("payload")]
        gone = np.sort(np.concatenate([np.zeros(0, np.uint32), *gone])).astype(np.int64)
        seen, words, removed, kept = 0, [], [], []
        for _, data, offsets, (start, end, first) in chunk.words():
            at, _ = window_starts(first, window)
            low, high = np.searchsorted(gone, [seen, seen + len(at)])
            starts = at[gone[low:high] - seen]
            seen += len(at)
            edges = np.zeros(len(start) + 1, dtype=np.int32)
            np.add.at(edges, starts, 1)
            np.add.at(edges, starts + window, -1)
            covered = np.cumsum(edges[:-1]) > 0
            lost = np.diff(np.concatenate([[0], np.cumsum(covered)])[first])
            words.extend(np.diff(first).tolist())
            removed.extend(lost.tolist())
            raw = data.tobytes()
            for n, any_lost in enumerate(lost.tolist()):
                if any_lost:
                    own = np.arange(first[n], first[n + 1])[~covered[first[n] : first[n + 1]]]
                    kept.append(b" ".join([raw[s:e] for s, e in zip(start[own].tolist(), end[own].tolist(), strict=True)]))
                else:
                    kept.append(b" ".join(raw[offsets[n] : offsets[n + 1]].split()))
        return pa.table({
            "key": chunk.table.column("key"), "n_words": pa.array(words, pa.int64()), "n_removed": pa.array(removed, pa.int64()),
            "kept": pa.array(kept, pa.binary()).cast(pa.string()),
        })

    def _form(schema: pa.Schema) -> str:
        names = {pa.int32(): "int", pa.binary(): "binary", pa.bool_(): "boolean"}
        return ", ".join(f"{f.name} {names[f.type]}" for f in schema)

    parts = dealt.groupBy("chunk").applyInArrow(sketch, _form(_PARTS))
    flags = parts.groupBy("block").applyInArrow(merge, _form(_FLAGS))
    found = dealt.groupBy("chunk").cogroup(flags.groupBy("chunk")).applyInArrow(candidates, _form(_CANDIDATES))
    repeats = found.groupBy("shard").applyInArrow(exact, _form(_REPEATS))
    done = dealt.groupBy("chunk").cogroup(repeats.groupBy("chunk")).applyInArrow(remove, f"key {kind}, n_words bigint, n_removed bigint, kept string")
    return done.withColumnRenamed("key", key)


def _order_keys(table: pa.Table) -> np.ndarray:
    """Keys as whole numbers in their order; texts of other key types would need a shared order."""
    column = table.column("key").cast(pa.int64())
    return column.fill_null(_LAST).to_numpy()


def _table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    columns = zip(*rows, strict=True) if rows else [[]] * len(schema)
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)
