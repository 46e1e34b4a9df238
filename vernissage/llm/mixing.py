"""Mixing sources to target weights by Pareto order sampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vernissage.llm.text import word_count
from vernissage.session import land

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2.0
# A range of random numbers of one source holds about so many rows, or all ranges together as many as there are of them.
ROWS_PER_BUCKET = 2048
LEAST_BUCKETS = 4096
# The table of sources is broadcast up to this many rows of about 100 bytes, and joined by shuffle beyond.
BROADCAST_SOURCES = 50_000
_RANDOM_BITS = 52


def random_unit(key: Column, seed: int) -> Column:
    """A number strictly between 0 and 1 that depends on the key and the seed only."""
    digest = F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("null")), F.lit(f"-{seed}")))
    whole = F.conv(F.substring(digest, 1, _RANDOM_BITS // 4), 16, 10).cast("double")
    return (whole + 0.5) / float(2**_RANDOM_BITS)


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, target) from (source, source_size), one row per source.

    Sources in code point order, null last, take the weights in turn. A target
    stops at `most` times its source; what is cut goes to the others by weight.
    In the order of cap over weight the capped sources come first, so running
    sums settle all rounds of resharing at once. The windows hold one row per
    source.
    """
    named = Window.orderBy(F.col("source").asc_nulls_last())
    by_ratio = Window.orderBy("_ratio", "_place")
    earlier = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy(F.lit(1))
    turn = F.array(*[F.lit(float(w)) for w in weights])
    rows = (
        sizes.withColumn("_place", F.row_number().over(named))
        .withColumn("_weight", turn[(F.col("_place") - 1) % len(weights)])
        .withColumn("_cap", most * F.col("source_size"))
        .withColumn("_ratio", F.col("_cap") / F.col("_weight"))
        .withColumn("_budget", share * F.sum("source_size").over(everything))
        .withColumn("_used", F.coalesce(F.sum("_cap").over(earlier), F.lit(0.0)))
        .withColumn("_level", (F.col("_budget") - F.col("_used")) / F.sum("_weight").over(onward))
        .withColumn("_capped", F.col("_ratio") <= F.col("_level"))
        .withColumn("_settled", F.min(F.when(~F.col("_capped"), F.struct("_ratio", "_place", "_level"))).over(everything))
    )
    target = F.when(F.col("_capped"), F.col("_cap")).otherwise(F.col("_weight") * F.col("_settled._level"))
    return rows.select("source", "source_size", target.alias("target"))


def mix(
    docs: DataFrame,
    key: str = "doc_id",
    source: str = "source",
    size: Column | None = None,
    weights: Sequence[float] = WEIGHTS,
    share: float = SHARE,
    most: float = MOST,
    propensity: Column | None = None,
    seed: int = 7,
    buckets: int | None = None,
    carry: Sequence[str] | None = None,
) -> DataFrame:
    """Adds size, source_size, target, copies and taken to every row of `docs`.

    `carry` names the columns that go along; all by default, so leave out texts
    where only the numbers are wanted.

    Every document of a source first gets floor(target / source_size) whole
    copies. The rest of the target is filled by one more copy of some documents
    in Pareto order: ascending (u / (1 - u)) / (p / (1 - p)), u a number drawn
    from the key and seed, p the inclusion probability, which is the open share
    of the source times the document's `propensity` (1 by default). The list is
    cut where the words taken come nearest to the target, so a source misses
    its target by less than half a document.

    The order is ranked inside `buckets` ranges of the random number per source,
    with running sums of range totals before each, so a source with most of the
    rows is spread over many tasks; by default their number grows with the rows.
    Rows that have no turn, as those of a source at its cap, are spread the same way.

    A null source is a source of its own; null and empty texts have size 0 and
    never matter to a target. A null key draws like the word "null". Repeated
    rows are counted each; equal rows are interchangeable. An empty table gives
    no rows. Columns of `docs` named like the added ones are replaced.
    """
    counted = size if size is not None else word_count(F.col("text"))
    added = {"size", "source_size", "target", "copies", "taken"}
    kept = [c for c in (docs.columns if carry is None else carry) if c.lower() not in added]
    rows = docs.select(
        F.struct(*kept).alias("_doc"),
        F.col(key).alias("_key"),
        F.col(source).alias("source"),
        counted.cast("long").alias("size"),
        (propensity if propensity is not None else F.lit(1.0)).cast("double").alias("_propensity"),
        random_unit(F.col(key), seed).alias("_u"),
    ).withColumn("_name", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("null")))
    mass = F.sum(F.col("size") * F.col("_propensity")).alias("_mass")
    sums = rows.groupBy("_name", "source").agg(F.sum("size").alias("source_size"), mass, F.count(F.lit(1)).alias("_rows"))
    totals = land(sums, "mix-sources")
    n_sources, n_rows = totals.agg(F.count(F.lit(1)), F.coalesce(F.sum("_rows"), F.lit(0))).first()
    buckets = buckets or max(LEAST_BUCKETS, -(-n_rows // ROWS_PER_BUCKET))
    targets = source_targets(totals.select("source", "source_size"), weights, share, most)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    plan = (
        targets.withColumn("_name", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("null")))
        .join(totals.select("_name", "_mass"), "_name")
        .withColumn("_whole", whole.cast("long"))
        .withColumn("_open", F.col("target") - F.col("_whole") * F.col("source_size"))
        .drop("source")
    )
    if n_sources <= BROADCAST_SOURCES:
        plan = F.broadcast(plan)
    p = F.least(F.lit(1.0), F.col("_open") * F.col("_propensity") / F.col("_mass"))
    odds = F.when(F.col("_mass") <= 0, F.lit(None)).when(p >= 1, 0.0).when(p > 0, (F.col("_u") / (1 - F.col("_u"))) / (p / (1 - p)))
    ranked = rows.join(plan, "_name").withColumn("_odds", odds)
    # With equal propensities the odds times those of the source's open share are the random number's own odds.
    open_share = F.greatest(F.lit(1e-12), F.least(F.lit(1 - 1e-12), F.col("_open") / F.col("source_size")))
    own_odds = F.col("_odds") * open_share / (1 - open_share)
    place = F.floor(buckets * own_odds / (1 + own_odds)).cast("long")
    ranked = ranked.withColumn("_bucket", F.coalesce(place, buckets + 1 + F.floor(buckets * F.col("_u")).cast("long")))
    held = ranked.groupBy("_name", "_bucket").agg(F.sum("size").alias("_held"))
    before = Window.partitionBy("_name").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = held.select("_name", "_bucket", F.coalesce(F.sum("_held").over(before), F.lit(0)).alias("_before"))
    order = Window.partitionBy("_name", "_bucket").orderBy(F.col("_odds").asc_nulls_last(), "_key", "size")
    inside = F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    chosen = ranked.withColumn("_inside", inside).join(offsets, ["_name", "_bucket"])
    extra = (F.col("_before") + F.col("_inside") + F.col("size") / 2 <= F.col("_open")) & F.col("_odds").isNotNull()
    copies = F.col("_whole") + F.when(extra, 1).otherwise(0)
    return chosen.withColumn("_copies", copies).select(
        *[F.col("_doc")[c].alias(c) for c in kept],
        "size", "source_size", "target",
        F.col("_copies").alias("copies"),
        (F.col("_copies") * F.col("size")).alias("taken"),
    )


def mixed_documents(docs: DataFrame, **settings) -> DataFrame:
    """The mix itself: each row of `docs` as often as it is taken, same columns."""
    columns = docs.columns
    keyed = docs.select(F.struct("*").alias("_whole_row"), F.col("doc_id"), F.col("source"), word_count(F.col("text")).alias("_n"))
    taken = mix(keyed, size=F.col("_n"), **settings).filter("copies > 0")
    again = taken.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return again.select(*[F.col("_whole_row")[c].alias(c) for c in columns])
