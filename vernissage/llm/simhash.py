"""Near duplicates by SimHash fingerprints, searched in a hierarchical index in Gray order."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vernissage.llm import bytewords as bw
from vernissage.llm.exact import locator, rows_at
from vernissage.llm.graph import components
from vernissage.llm.linking import Joined
from vernissage.llm.text import fixed_partitions
from vernissage.session import land

WORDS, SEED, DISTANCE = 3, 42, 3
# Two fingerprints that differ in at most 3 bits agree in 2 of these 5 blocks of bits.
BLOCKS = (13, 13, 13, 13, 12)
# A group that agrees in its key and has more members than this is divided by further bits.
GROUP_LIMIT = 20_000
_SLICE_BYTES = 1 << 20
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_FANOUT = 16


def fingerprint_bytes(texts: pa.Array, words: int = WORDS, seed: int = SEED) -> np.ndarray:
    """(n, 8) fingerprints, most significant byte first."""
    data, offsets = bw.text_bytes(texts)
    data = _LOWER[data]
    start, end, first = bw.word_spans(data, offsets, bw.SPACE_BYTES)
    # All words in a row, one space after each.
    inside = ~bw.SPACE_BYTES[data]
    place = np.cumsum(end - start + 1)
    joined = np.full(place[-1] if len(place) else 0, 0x20, dtype=np.uint8)
    at = np.flatnonzero(inside)
    joined[at + np.repeat(np.arange(len(start)) - (start - np.concatenate([[0], np.cumsum(end - start)[:-1]]) if len(start) else start), end - start)] = data[at]
    new_end = place - 1
    new_start = new_end - (end - start)
    counts = np.diff(first)
    per_text = np.where(counts >= words, counts - words + 1, np.minimum(counts, 1))
    ends = np.cumsum(per_text)
    begin = np.repeat(first[:-1] - (ends - per_text), per_text) + np.arange(ends[-1] if len(ends) else 0)
    last = begin + np.repeat(np.minimum(words, np.maximum(counts, 1)) - 1, per_text)
    buffer, digest = joined.tobytes(), xxhash.xxh64_digest
    hashed = b"".join([digest(buffer[s:e], seed) for s, e in zip(new_start[begin].tolist(), new_end[last].tolist(), strict=True)])
    bits = np.unpackbits(np.frombuffer(hashed, dtype=np.uint8).reshape(-1, 8), axis=1)
    found = np.zeros((len(texts), 64), dtype=bool)
    filled = np.flatnonzero(per_text)
    if len(filled):
        sums = np.add.reduceat(bits, (ends - per_text)[filled], axis=0, dtype=np.int32)
        found[filled] = 2 * sums > per_text[filled, None]
    return np.packbits(found, axis=1)


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(1)
        parts = [fingerprint_bytes(texts.slice(a, b - a)) for a, b in bw.slices(texts, _SLICE_BYTES)]
        codes = np.concatenate(parts).view(">i8").ravel().astype(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(codes)], names=["doc", "code"])


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """Every row of `docs` without its text, and `code`, the fingerprint as a signed long."""
    others = [c for c in docs.columns if c != text]
    rows = docs.select(F.struct(*others).alias("doc"), F.col(text).alias("text"))
    doc = rows.schema["doc"].dataType.simpleString()
    return rows.mapInArrow(_fingerprint_batches, f"doc {doc}, code bigint").select("doc.*", "code")


def gray_rank(code: Column) -> Column:
    """Place of a code in the reflected Gray order; its leading bits depend on the code's leading bits only."""
    for shift in (1, 2, 4, 8, 16, 32):
        code = code.bitwiseXOR(F.shiftrightunsigned(code, shift))
    return code


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def block_masks(widths: tuple[int, ...], free: int = (1 << 64) - 1) -> list[int]:
    """Masks that cut the set bits of `free` into blocks of the given widths."""
    bits = [i for i in range(63, -1, -1) if free >> i & 1]
    masks, at = [], 0
    for width in widths:
        masks.append(sum(1 << i for i in bits[at : at + width]))
        at += width
    return masks


def shared_keys() -> list[int]:
    """Masks of bits of which a pair within the distance shares at least one set wholly."""
    return [a | b for a, b in combinations(block_masks(BLOCKS), len(BLOCKS) - DISTANCE)]


def finer_keys(mask: int) -> list[int]:
    """The same inside a group that shares `mask`: one of four more blocks must agree too."""
    free = ~mask & ((1 << 64) - 1)
    n = free.bit_count()
    widths = tuple(n * (i + 1) // (DISTANCE + 1) - n * i // (DISTANCE + 1) for i in range(DISTANCE + 1))
    return [mask | extra for extra in block_masks(widths, free)]


def _keyed(codes: DataFrame, masks: list[int]) -> DataFrame:
    keys = F.explode(F.array(*[F.lit(_signed(m)) for m in masks]))
    return codes.select("code", keys.alias("mask")).withColumn("key", F.col("code").bitwiseAND(F.col("mask")))


def groups_to_search(codes: DataFrame, limit: int = GROUP_LIMIT) -> DataFrame:
    """(mask, key, code): every pair within the distance is together in some group.

    Groups above the limit are replaced by groups that share a quarter of the
    bits left, again and again. A group with f bits left has at most 2**f
    members, so this ends with small groups for any data.
    """
    rows, done = land(_keyed(codes, shared_keys()), "simhash-keys"), None
    while True:
        large = rows.groupBy("mask", "key").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > limit).select("mask", "key")
        large = land(large, "simhash-large")
        masks = [r["mask"] for r in large.select("mask").distinct().collect()]  # at most 10 * 4 ** rounds
        small = rows.join(large, ["mask", "key"], "left_anti") if masks else rows
        done = small if done is None else done.unionByName(small)
        if not masks:
            return done
        inside = rows.join(large, ["mask", "key"], "left_semi")
        finer = None
        for m in masks:
            part = _keyed(inside.filter(F.col("mask") == m).select("code"), finer_keys(m & ((1 << 64) - 1)))
            finer = part if finer is None else finer.unionByName(part)
        rows = land(finer.distinct(), "simhash-keys")


def linked_codes(codes: np.ndarray, group: np.ndarray | None = None, distance: int = DISTANCE) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) that join all codes of one group within the distance, for codes sorted by group and Gray rank.

    Neighbours in Gray order share long runs of bits. Each node of the index
    covers 16 nodes below and keeps the bits they all share, as a mask and a
    pattern, and the range of groups it covers. Two nodes are followed down only
    while they have a group in common, the differences in the bits fixed on both
    sides stay within the distance and they are not yet joined.
    """
    if not len(codes):
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    group = np.zeros(len(codes), dtype=np.int64) if group is None else group
    fixed_ones, fixed_any, lowest, highest = [codes], [codes], [group], [group]
    while len(fixed_ones[-1]) > 1:
        at = np.arange(0, len(fixed_ones[-1]), _FANOUT)
        fixed_ones.append(np.bitwise_and.reduceat(fixed_ones[-1], at))
        fixed_any.append(np.bitwise_or.reduceat(fixed_any[-1], at))
        lowest.append(lowest[-1][at])
        highest.append(highest[-1][np.append(at[1:], len(highest[-1])) - 1])
    joined = Joined(len(codes))
    near = np.flatnonzero((np.bitwise_count(codes[1:] ^ codes[:-1]) <= distance) & (group[1:] == group[:-1]))
    kept = [joined.link(near, near + 1)]
    stack = [(len(fixed_ones) - 1, np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64))]
    while stack:
        level, i, j = stack.pop()
        ones, any_ = fixed_ones[level], fixed_any[level]
        same = ~(ones ^ any_)
        alive = np.bitwise_count((ones[i] ^ ones[j]) & same[i] & same[j]) <= distance
        alive &= (lowest[level][i] <= highest[level][j]) & (lowest[level][j] <= highest[level][i])
        i, j = i[alive], j[alive]
        if level == 0:
            pair = i < j
            kept.append(joined.link(i[pair], j[pair]))
            continue
        root, width = joined.settle(), _FANOUT**level
        low = np.minimum.reduceat(root, np.arange(0, len(codes), width))
        high = np.maximum.reduceat(root, np.arange(0, len(codes), width))
        apart = ~((low[i] == high[i]) & (low[j] == high[j]) & (low[i] == low[j]))
        i, j = i[apart], j[apart]
        below = len(fixed_ones[level - 1])
        for cut in range(0, len(i), 2048):
            a = (i[cut : cut + 2048, None, None] * _FANOUT + np.arange(_FANOUT)[:, None]) + np.zeros((1, 1, _FANOUT), dtype=np.int64)
            b = (j[cut : cut + 2048, None, None] * _FANOUT + np.arange(_FANOUT)) + np.zeros((1, _FANOUT, 1), dtype=np.int64)
            a, b = a.ravel(), b.ravel()
            real = (a < below) & (b < below) & (a <= b)
            stack.append((level - 1, a[real], b[real]))
    return np.concatenate([k[0] for k in kept]), np.concatenate([k[1] for k in kept])


def _links(group: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Linking pairs of all groups in a run of whole groups, from one index over the run."""
    i, j = linked_codes(codes, group)
    return codes[i], codes[j]


def _link_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by mask, key and Gray rank; the last group of a batch waits for the next batch."""
    held_group, held_code, number = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64), 0
    last = None

    def out(pairs):
        return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in pairs], names=["a", "b"])

    for batch in batches:
        mask, key, code = (np.asarray(batch.column(k)) for k in range(3))
        if not len(code):
            continue
        new = np.concatenate([[last is not None and (mask[0], key[0]) != last], (mask[1:] != mask[:-1]) | (key[1:] != key[:-1])])
        group = number + np.cumsum(new)
        last, number = (mask[-1], key[-1]), int(group[-1])
        held_group = np.concatenate([held_group, group])
        held_code = np.concatenate([held_code, code.view(np.uint64)])
        whole = np.searchsorted(held_group, number)
        yield out(_links(held_group[:whole], held_code[:whole]))
        held_group, held_code = held_group[whole:], held_code[whole:]
    yield out(_links(held_group, held_code))


def linking_pairs(codes: DataFrame, limit: int = GROUP_LIMIT) -> DataFrame:
    """(a, b): enough pairs of distinct codes within the distance to join all that are linked."""
    groups = groups_to_search(codes, limit)
    sorted_rows = fixed_partitions(groups, "mask", "key").sortWithinPartitions("mask", "key", gray_rank(F.col("code")))
    return sorted_rows.select("mask", "key", "code").mapInArrow(_link_batches, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", limit: int = GROUP_LIMIT) -> DataFrame:
    """Every row of `docs` without its text, with `fingerprint` (hex) and `component_id`.

    A fingerprint has a bit set where more than half of the hashes of the
    text's 3-word shingles have it; shorter texts count as one shingle, texts
    without words have fingerprint zero. Fingerprints that differ in at most 3
    bits are linked; a component has all rows that links reach, and its id is
    the smallest key in it (null keys only where all are null). Null texts
    count as empty. Repeated rows share fingerprint and component. An empty
    table gives no rows. Columns named like the two added ones are replaced.
    """
    added = {"fingerprint", "component_id"}
    columns = [c for c in docs.columns if c != text and c.lower() not in added]
    told = docs.select(F.struct(*columns).alias("doc") if columns else F.lit(None).alias("doc"), F.col(key).alias("key"), F.col(text).alias("text"))
    rows = land(fingerprints(told), "simhash-codes")
    codes = land(rows.groupBy("code").agg(F.min("key").alias("first")), "simhash-distinct")
    linked = land(components(linking_pairs(codes, limit)), "simhash-components")
    named = codes.join(linked, F.col("code") == F.col("node"), "left")
    group = F.coalesce("component", "code")
    firsts = named.groupBy(group.alias("group")).agg(F.min("first").alias("component_id"))
    of_code = named.select("code", group.alias("group")).join(firsts, "group").select("code", "component_id")
    hexed = F.lower(F.lpad(F.hex("code"), 16, "0")).alias("fingerprint")
    return rows.join(of_code, "code").select(*[F.col("doc")[c].alias(c) for c in columns], hexed, "component_id")


def without_near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each component stays: the smallest key, ties by content; all columns are kept."""
    told = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), locator(docs, text).alias("row"))
    found = near_duplicates(told, "key")
    order = F.struct(F.col("key").isNull().alias("n"), F.col("key").alias("k"), F.col("row").alias("r"))
    nameless = F.when(F.col("component_id").isNull(), F.col("fingerprint")).alias("f")
    stays = found.groupBy("component_id", nameless).agg(F.min(order)["r"].alias("row"))
    return rows_at(docs, stays.select("row"), text)
