"""Exact deduplication with keyed state on disk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vernissage.llm.membership import bitmap, with_chance
from vernissage.llm.text import without_spaces
from vernissage.operators.joins import HOT_SHARE, spread_lookup
from vernissage.session import fresh_path, land

# A state row is narrow beside a document, so the state is cut into this part of the shuffle partitions.
STATE_SHARE = 4
# State on disk; all stores of an executor share one bound on native memory, and a commit writes one small file.
_STATE_SETTINGS = {
    "providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "rocksdb.changelogCheckpointing.enabled": "true",
    "rocksdb.allowFAllocate": "false",
    "rocksdb.boundedMemoryUsage": "true",
    "rocksdb.maxMemoryUsageMB": "128",
    "rocksdb.writeBufferSizeMB": "2",
    "rocksdb.maxWriteBufferNumber": "2",
}


def sha256(normal: Column) -> Column:
    return F.sha2(normal, 256)


def locator(docs: DataFrame, text: str) -> Column:
    """Finds a row's content again: digest of the whole text and of all other columns."""
    others = [F.col(c) for c in docs.columns if c != text]
    rest = F.hex(F.xxhash64(*others)) if others else F.lit("")
    return F.concat(F.md5(F.coalesce(F.col(text), F.lit(""))), F.lit("-"), rest)


def keyed_rows(docs: DataFrame, key: str, text: str, digest=sha256) -> DataFrame:
    """Per row: digest of the normalised text, length in code points, and the content locator."""
    return docs.select(
        digest(without_spaces(F.col(text))).alias("digest"),
        F.col(key).alias("key"),
        F.length(F.coalesce(F.col(text), F.lit(""))).cast("long").alias("points"),
        locator(docs, text).alias("content"),
    )


def group_state(rows: DataFrame) -> DataFrame:
    """Streaming aggregate: per digest the number of rows and the row that stays.

    `best` holds the stable identifier (key, row) and the content locator
    (key, content). Rows are combined before the shuffle, so a digest with
    most of the rows costs one row per task. There is no watermark: a digest
    stays known for as long as the state is kept.
    """
    order = F.struct(
        (-F.col("points")).alias("shorter"), F.col("key").isNull().alias("nameless"),
        F.col("key").alias("key"), F.col("content").alias("content"), F.col("row").alias("row"),
    )
    return rows.groupBy("digest").agg(F.count(F.lit(1)).alias("members"), F.min(order).alias("best"))


def run_to_end(spark: SparkSession, path: str, schema: T.StructType, checkpoint: str, files_per_batch: int | None = None) -> DataFrame:
    """Feeds every file of `path` that `checkpoint` has not seen through the state; returns the state as rows.

    The state lies in RocksDB on the executors and in `checkpoint` on the shared
    folder, so a lost executor or a restarted driver goes on from there, and
    later files added to `path` meet the digests of earlier runs.
    """
    session = spark.newSession()
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    session.conf.set("spark.sql.shuffle.partitions", max(1, partitions // STATE_SHARE))
    for name, value in _STATE_SETTINGS.items():
        session.conf.set(f"spark.sql.streaming.stateStore.{name}", value)
    source = session.readStream.schema(schema)
    if files_per_batch:
        source = source.option("maxFilesPerTrigger", files_per_batch)
    stream = (
        group_state(source.parquet(path)).writeStream.format("noop").outputMode("update")
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    stream.awaitTermination()
    state = spark.read.format("statestore").load(checkpoint)
    return state.select("key.digest", F.col("value").getField(state.schema["value"].dataType.names[0]).alias("members"), F.col("value").getField(state.schema["value"].dataType.names[1]).alias("best"))


def differing_digests(docs: DataFrame, groups: DataFrame, text: str, digest=sha256) -> DataFrame:
    """Digests in `groups` (digest, members, best) whose rows do not all have the text of the row that stays.

    Only texts of digests that are met again are shuffled: bitmaps leave out the
    others. A digest with more than a thousandth of the rows is cut into shares of
    about that size, each with a copy of the one text, so there are at most two
    thousand copies.
    """
    normal = without_spaces(F.col(text))
    full = docs.select(digest(normal).alias("digest"), locator(docs, text).alias("content"), normal.alias("normal"))
    kept = groups.select("digest", F.col("best.content").alias("content"))
    stays = with_chance(full, F.col("content"), bitmap(kept, F.col("content"))).filter("chance")
    kept_texts = stays.join(kept, ["digest", "content"]).groupBy("digest").agg(F.min("normal").alias("kept_normal"))

    total = groups.agg(F.sum("members").alias("n")).scalar()
    shares = F.ceil(F.col("members") * HOT_SHARE / total).cast("int")
    hot = F.broadcast(groups.filter(F.col("members") * HOT_SHARE > total).select("digest", shares.alias("shares")))
    members = with_chance(full, F.col("digest"), bitmap(groups, F.col("digest"))).filter("chance").join(hot, "digest", "left")
    members = members.withColumn("share", F.pmod(F.xxhash64("content"), F.coalesce("shares", F.lit(1))).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.coalesce("shares", F.lit(1)) - 1)).alias("share")
    copies = kept_texts.join(hot, "digest", "left").select("digest", "kept_normal", every)
    return members.join(copies, ["digest", "share"]).filter("normal <> kept_normal").select("digest").distinct()


def exact_duplicates(
    spark: SparkSession,
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    digest=sha256,
    files_per_batch: int | None = None,
) -> DataFrame:
    """(key, keep_id, group_size, kept, text_sha256, content) for every row of `docs`, dropped rows too.

    Texts are equal when they agree after all ASCII white space is deleted. Of
    equal texts the one with the most code points stays, then the smallest key
    (null last). Digests run through the keyed state; wherever a digest is met
    more than once, the full texts are compared, and rows that only share the
    digest form groups of their own.

    A null text counts as empty; all such rows are one group. Rows repeated in
    full are members of one group, of which one row stays; rows that agree in
    key and text are told apart by their other columns. An empty table gives
    no rows.
    """
    keys_path = fresh_path(spark, "dedup-keys")
    keyed_rows(docs, key, text, digest).withColumn("row", F.monotonically_increasing_id()).write.parquet(keys_path)
    keys = spark.read.parquet(keys_path)
    state = land(run_to_end(spark, keys_path, keys.schema, fresh_path(spark, "dedup-state"), files_per_batch), "dedup-groups")

    differing = land(differing_digests(docs, state.filter("members > 1"), text, digest), "dedup-differing")

    groups = state.select("digest", "members", "best", F.lit("").alias("variant"))
    told = keys.withColumn("variant", F.lit(""))
    if not differing.isEmpty():
        normal = without_spaces(F.col(text))
        full = docs.select(
            digest(normal).alias("digest"), locator(docs, text).alias("content"),
            F.sha2(F.concat(F.lit("other:"), normal), 512).alias("variant"),
        )
        apart = full.join(differing, "digest", "left_semi").distinct()
        split = keys.join(differing, "digest", "left_semi").join(apart, ["digest", "content"])
        told = told.join(differing, "digest", "left_anti").unionByName(split.select(*told.columns))
        regrouped = group_state(split.withColumn("digest", F.struct("digest", "variant"))).select("digest.digest", "members", "best", "digest.variant")
        groups = groups.join(differing, "digest", "left_anti").unionByName(regrouped)
    sizes = groups.select("digest", "variant", F.col("members").alias("_n"))
    return spread_lookup(told, groups, ["digest", "variant"], row_id="row", sizes=sizes).select(
        F.col("key").alias(key),
        F.col("best.key").alias("keep_id"),
        F.col("members").cast("long").alias("group_size"),
        (F.col("row") == F.col("best.row")).alias("kept"),
        F.col("digest").alias("text_sha256"),
        "content",
    )


def without_duplicates(spark: SparkSession, docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of `docs` that stay, with all their columns.

    Rows whose locators are not those of a group are passed on without a shuffle.
    """
    groups = land(exact_duplicates(spark, docs, key, text).filter("group_size > 1").select("content", "kept"), "dedup-rows")
    marked = docs.select(F.struct("*").alias("doc"), locator(docs, text).alias("row"))
    marked = with_chance(marked, F.col("row"), bitmap(groups, F.col("content"))).withColumnRenamed("chance", "grouped")
    single = marked.filter("not grouped")
    grouped = marked.filter("grouped").join(groups.groupBy(F.col("content").alias("row")).agg(F.max("kept").alias("stays")), "row", "left")
    first = grouped.filter("stays").dropDuplicates(["row"])
    return single.select("doc").unionByName(grouped.filter("stays is null").select("doc")).unionByName(first.select("doc")).select("doc.*")


def rows_at(docs: DataFrame, stays: DataFrame, text: str = "text") -> DataFrame:
    """The rows of `docs` whose locators are in `stays` (row); of rows repeated in full one."""
    marked = docs.select(F.struct("*").alias("doc"), locator(docs, text).alias("row"))
    return marked.join(stays, "row", "left_semi").dropDuplicates(["row"]).select("doc.*")
