"""Best-fit packing of documents into training sequences under conflicts."""

from __future__ import annotations

from bisect import bisect_left, insort

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vernissage.llm.membership import bitmap, with_chance
from vernissage.llm.text import word_count, without_spaces
from vernissage.session import land

CAPACITY = 2048
SHARD_ROWS = 8192
LANES = 4


class Bins:
    """Open bins in the order of their room; each carries bitmaps of its sources and clusters."""

    def __init__(self, capacity: int):
        self.capacity, self.order = capacity, []
        self.room: list[int] = []
        self.sources: list[int] = []
        self.clusters: list[int] = []

    def place(self, size: int, source: int, cluster: int) -> int:
        """Tightest bin with room and without the given bits, a new one if there is none."""
        at = bisect_left(self.order, (size, -1))
        while at < len(self.order):
            number = self.order[at][1]
            if not (self.sources[number] & source or self.clusters[number] & cluster):
                del self.order[at]
                break
            at += 1
        else:
            number = len(self.room)
            self.room.append(self.capacity)
            self.sources.append(0)
            self.clusters.append(0)
        self.room[number] -= size
        self.sources[number] |= source
        self.clusters[number] |= cluster
        if self.room[number]:
            insort(self.order, (self.room[number], number))
        return number


def pack_shard(sizes: list[int], sources: list, clusters: list, capacity: int = CAPACITY, lanes: int = LANES) -> list[int]:
    """Bin number of each item, for items in the order in which they are placed.

    Items of a source take its `lanes` bits in turn, so a bin holds at most
    `lanes` items of a source. A cluster has one bit, so a bin holds at most one
    of its items; a null cluster conflicts with nothing.
    """
    first, seen, own = {}, {}, {}
    shared = set()
    for c in clusters:
        if c is not None:
            shared.add(c) if c in first else first.setdefault(c, True)
    bins, out = Bins(capacity), []
    for size, source, cluster in zip(sizes, sources, clusters, strict=True):
        turn = seen.get(source, 0)
        seen[source] = turn + 1
        source_bit = 1 << own.setdefault(("source", source), len(own)) * lanes + turn % lanes
        cluster_bit = 1 << own.setdefault(("cluster", cluster), len(own)) if cluster in shared else 0
        out.append(bins.place(size, source_bit, cluster_bit))
    return out


def pack(
    docs: DataFrame,
    key: str = "doc_id",
    source: str = "source",
    size: Column | None = None,
    cluster: Column | None = None,
    capacity: int = CAPACITY,
    shard_rows: int = SHARD_ROWS,
    lanes: int = LANES,
) -> DataFrame:
    """(key, source, piece, start, length, bin), one row per piece of every row of `docs`.

    A document longer than the capacity is cut into full pieces and a rest;
    `start` and `length` count words. Bins never exceed the capacity, hold at
    most one piece of a duplicate cluster (by default: texts equal but for
    white space and case of A-Z) and at most `lanes` pieces of a source.

    Rows are dealt by hash into shards of about `shard_rows` pieces, each
    packed on its own, longest piece first: ties by key, piece and text. Rows that
    agree in key, source and text more often than an eighth of a shard are dealt by
    their place instead, so a shard stays small whatever is repeated. A shard
    leaves a few bins unfilled, so larger shards pack a little tighter.

    A document without words has one row of length 0 and a null bin. Null keys
    and sources are values like others. Repeated rows are packed each, in
    different bins. An empty table gives no rows.
    """
    text = F.coalesce(F.col("text"), F.lit("")) if "text" in docs.columns else F.lit("")
    letters = F.translate(without_spaces(text), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    items = docs.select(
        F.col(key).alias("key"), F.col(source).alias("source"),
        (size if size is not None else word_count(text)).cast("long").alias("size"),
        (cluster if cluster is not None else F.xxhash64(letters)).alias("cluster"),
        F.xxhash64(F.col(key), F.col(source), text).alias("hash"),
        F.monotonically_increasing_id().alias("row"),
    )
    count = F.greatest(F.ceil(F.col("size") / capacity).cast("int"), F.lit(1))
    pieces = items.withColumn("piece", F.explode(F.sequence(F.lit(0), count - 1))).withColumn("start", F.col("piece").cast("long") * capacity)
    pieces = land(pieces.withColumn("length", F.least(F.col("size") - F.col("start"), F.lit(capacity).cast("long"))), "packing-pieces")
    shards = max(1, -(-pieces.filter("length > 0").count() // shard_rows))
    often = pieces.filter("piece = 0").groupBy("hash").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") * 8 > shard_rows)
    dealt = with_chance(pieces, F.col("hash"), bitmap(often, F.col("hash")), "often")
    place_of = F.when(F.col("often"), F.col("row"))
    dealt = dealt.withColumn("shard", F.pmod(F.xxhash64("hash", "piece", place_of), F.lit(shards)).cast("int")).drop("row", "often")
    kind = dealt.schema["key"].dataType.simpleString()

    def place(table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), ("key", "ascending"), ("piece", "ascending"), ("hash", "ascending")])
        numbers = pack_shard(*(table.column(c).to_pylist() for c in ("length", "source", "cluster")), capacity, lanes)
        shard = table.column("shard")[0].as_py() << 32
        return table.select(["key", "source", "piece", "start", "length"]).append_column("bin", pa.array([shard + n for n in numbers], pa.int64()))

    form = f"key {kind}, source {dealt.schema['source'].dataType.simpleString()}, piece int, start bigint, length bigint, bin bigint"
    placed = dealt.filter("length > 0").groupBy("shard").applyInArrow(place, form)
    empty = dealt.filter("length = 0").select("key", "source", "piece", "start", "length", F.lit(None).cast("long").alias("bin"))
    return placed.unionByName(empty).select(F.col("key").alias(key), F.col("source").alias(source), "piece", "start", "length", "bin")
