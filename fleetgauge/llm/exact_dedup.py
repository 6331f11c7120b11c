"""Exact deduplication as a streaming aggregation over keyed state on disk.

Every text arrives as a digest, its document's id and a content locator (file and row).
The arrivals are a stream, grouped by digest in RocksDB state that never expires: a digest
keeps the number of its arrivals and the identifier and locator of the arrival that stays.
State is checkpointed in the shared folder, so that a lost executor costs the micro-batch it
worked on. Texts whose digest was hit more than once are then fetched by their locators'
digests and compared in full, so that a collision of digests cannot merge different texts.

Everything is DataFrame and SQL functions.

Defined cases: a null text is the empty text. Of equal texts the largest doc_id stays (null
is smaller than any id); if that id comes more than once, the row with the largest locator.
Repeated rows are copies of each other. Other columns, whatever their names, are kept by
``drop_copies`` and ignored by ``exact_dedup``. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetgauge.llm.shared import checked_join, keep, located, lower_ascii, restored, shared_folder

#: Arrivals that one micro-batch takes from the stream.
BATCH_BYTES = 64 << 30

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_SETTINGS = {
    _PROVIDER: "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "200",
    # Many small stores: no space is set aside for their logs.
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


def _streamed(arrivals: DataFrame, batch_bytes: int) -> tuple[DataFrame, DataFrame]:
    """State after the stream of all arrivals (digest, group_size, keep_id, keep_at); the arrivals."""
    spark = arrivals.sparkSession
    source, progress = shared_folder(spark), shared_folder(spark)
    arrivals.write.parquet(source)
    before = {name: spark.conf.get(name, None) for name in _SETTINGS}
    for name, value in _SETTINGS.items():
        spark.conf.set(name, value)
    try:
        (
            spark.readStream.schema(arrivals.schema)
            .option("maxBytesPerTrigger", batch_bytes)
            .parquet(source)
            .groupBy("digest")
            .agg(
                F.count("*").alias("group_size"),
                F.max(F.struct("doc_id", "at")).alias("stays"),
            )
            .writeStream.format("noop")
            .outputMode("update")
            .option("checkpointLocation", progress)
            .trigger(availableNow=True)
            .start()
            .awaitTermination()
        )
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)
    return _state(spark, progress, arrivals), spark.read.schema(arrivals.schema).parquet(source)


def _state(spark: SparkSession, progress: str, arrivals: DataFrame) -> DataFrame:
    if arrivals.isEmpty():
        return arrivals.select(
            "digest",
            F.lit(0).cast("long").alias("group_size"),
            F.col("doc_id").alias("keep_id"),
            F.col("at").alias("keep_at"),
        )
    state = spark.read.format("statestore").load(progress)
    fields = state.schema["value"].dataType.fields
    # The state's fields are the aggregates in their order; their names are Spark's.
    kinds = [f.dataType.simpleString() for f in fields]
    if kinds != ["bigint", arrivals.select(F.struct("doc_id", "at")).schema[0].dataType.simpleString()]:
        raise RuntimeError(f"unknown layout of the state: {kinds}")
    size, stays = (state[f"value.{f.name}"] for f in fields)
    return state.select(
        state["key.digest"].alias("digest"),
        size.alias("group_size"),
        stays["doc_id"].alias("keep_id"),
        stays["at"].alias("keep_at"),
    )


def _collided(texts: DataFrame, state: DataFrame) -> DataFrame:
    """Digests that stand for more than one text: all bytes of all hits are compared."""
    hits = keep(state.filter("group_size > 1").select("digest"))
    hit_texts = checked_join(texts, hits, "digest", "left_semi", 48)
    return (
        hit_texts.groupBy("digest", "text")
        .agg(F.lit(1).alias("one"))
        .groupBy("digest")
        .agg(F.count("*").alias("texts"))
        .filter("texts > 1")
        .select("digest")
    )


def _decided(docs: DataFrame, digest, batch_bytes: int) -> tuple[DataFrame, DataFrame]:
    rows = located(docs)
    text = lower_ascii(F.col("text"))
    texts = rows.select(digest(text).alias("digest"), "doc_id", F.col("__at").alias("at"), text.alias("text"))
    state, arrivals = _streamed(texts.drop("text"), batch_bytes)
    collided = keep(_collided(texts, state))
    joined = arrivals.join(state, "digest", "left")
    if not collided.isEmpty():
        joined = _by_text(joined, texts, collided)
    decided = joined.select(
        "doc_id",
        "at",
        "keep_id",
        "group_size",
        F.col("at").eqNullSafe(F.col("keep_at")).alias("kept"),
        "digest",
    )
    return rows, decided


def _by_text(joined: DataFrame, texts: DataFrame, collided: DataFrame) -> DataFrame:
    """Decisions with the rows of collided digests grouped by their full texts instead."""
    unlike = texts.join(collided, "digest", "left_semi")
    groups = unlike.groupBy("digest", "text").agg(
        F.count("*").alias("group_size"), F.max(F.struct("doc_id", "at")).alias("stays")
    )
    redone = unlike.join(groups, ["digest", "text"]).select(
        "digest",
        "doc_id",
        "at",
        "group_size",
        F.col("stays.doc_id").alias("keep_id"),
        F.col("stays.at").alias("keep_at"),
    )
    return joined.join(collided, "digest", "left_anti").unionByName(redone)


def _sha256(text):
    return F.unhex(F.sha2(text.cast("binary"), 256))


def exact_dedup(docs: DataFrame, *, digest=_sha256, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    ``digest`` makes the binary key of a normalised text; results don't depend on its quality.
    """
    _, decided = _decided(docs, digest, batch_bytes)
    return decided.select(
        "doc_id",
        "keep_id",
        "group_size",
        "kept",
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, *, batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """``docs`` without the rows whose text stays in another row; columns as they were."""
    rows, decided = _decided(docs, _sha256, batch_bytes)
    dropped = keep(decided.filter("NOT kept").select(F.col("at").alias("__at")))
    return restored(checked_join(rows, dropped, "__at", "left_anti", 160), docs)
