"""Exact deduplication with keyed state that a stream keeps on disk.

Arrivals (digest, identifier, locator) are a log of Parquet files in the shared
folder.  A Structured Streaming query reads the log in micro-batches and keeps,
per digest and size, the stable identifier, where its content is, and how many
rows were seen, in RocksDB state without a watermark, so nothing expires.  Digests
met more than once are hits; their texts are compared byte by byte, and a digest
that stands for two texts is split by the text itself.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import broadcast_if_small, settle, workspace
from .common import refuse_hidden, text_or_empty

#: State on disk; files of many small stores are not reserved ahead.
_STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}
#: A digest, an identifier, a count and the row's overhead.
_ROW_BYTES = 128


def deduplicate(
    df: DataFrame, key: str = "doc_id", text: str = "text", batches: int = 4, digest_bits: int = 256
) -> DataFrame:
    """One row per row of ``df``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical; null counts as empty.  The largest key of a
    group stays (null keys last); of repeated rows with that key exactly one is
    kept.  Other columns of ``df`` are not read.  An empty table gives an empty
    table.  The log is read in at most ``batches`` micro-batches.  ``digest_bits``
    exists for tests: a short digest forces different texts onto one.
    """
    spark = df.sparkSession
    arrivals = settle(
        df.select(
            F.col(f"`{key}`").cast("bigint").alias("doc_id"),
            _digest(text, digest_bits).alias("digest"),
            F.octet_length(text_or_empty(text)).alias("n_bytes"),
            F.sha2(text_or_empty(text), 256).alias("sha256") if digest_bits < 256 else F.lit(None).cast("string").alias("sha256"),
            F.input_file_name().alias("file"),
        )
    )
    state = settle(keep_state(spark, arrivals, batches))
    hits = settle(state.where("group_size > 1").select("digest", "n_bytes", "keep_id", "group_size"))
    n_hits = hits.count()
    mixed = _mixed(df, text, hits, n_hits, digest_bits)
    n_mixed = mixed.count()
    if n_mixed:
        return _with_texts(df, key, text, arrivals, hits, n_hits, mixed, n_mixed, digest_bits)
    return _rows(arrivals, hits, n_hits)


def _digest(text: str, bits: int) -> F.Column:
    return F.substring(F.sha2(text_or_empty(text), 256), 1, bits // 4)


def keep_state(spark: SparkSession, arrivals: DataFrame, batches: int) -> DataFrame:
    """(digest, n_bytes, keep_id, file, group_size) after the stream has taken the whole log."""
    files = arrivals.inputFiles()
    schema = arrivals.schema
    folder = files[0].rsplit("/", 1)[0] if files else None
    if folder is None:
        return arrivals.groupBy("digest", "n_bytes").agg(
            F.max("doc_id").alias("keep_id"), F.max("file").alias("file"), F.count(F.lit(1)).alias("group_size")
        )
    place = workspace(spark, "dedup-state")
    before = {name: spark.conf.get(name, None) for name in _STATE}
    for name, value in _STATE.items():
        spark.conf.set(name, value)
    try:
        stream = (
            spark.readStream.schema(schema)
            .option("maxFilesPerTrigger", max(1, math.ceil(len(files) / batches)))
            .parquet(folder)
            .groupBy("digest", "n_bytes")
            .agg(F.max(F.struct("doc_id", "file")).alias("last"), F.count(F.lit(1)).alias("group_size"))
            .select("digest", "n_bytes", "last.doc_id", "last.file", "group_size")
        )

        def write(batch: DataFrame, number: int) -> None:
            batch.write.mode("overwrite").parquet(f"{place}/changes/batch={number}")

        query = (
            stream.writeStream.outputMode("update")
            .option("checkpointLocation", f"{place}/checkpoint")
            .trigger(availableNow=True)
            .foreachBatch(write)
            .start()
        )
        query.awaitTermination()
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)
    changes = spark.read.option("basePath", f"{place}/changes").parquet(f"{place}/changes")
    last = F.max_by(F.struct("doc_id", "file", "group_size"), "batch").alias("s")
    return changes.groupBy("digest", "n_bytes").agg(last).select(
        "digest", "n_bytes", F.col("s.doc_id").alias("keep_id"), F.col("s.file").alias("file"), F.col("s.group_size").alias("group_size")
    )


def _mixed(df: DataFrame, text: str, hits: DataFrame, n_hits: int, bits: int) -> DataFrame:
    """Digests among the hits that stand for different texts: least and greatest text differ."""
    full = df.select(_digest(text, bits).alias("digest"), text_or_empty(text).alias("t"))
    full = full.withColumn("n_bytes", F.octet_length("t"))
    small = broadcast_if_small(hits.select("digest", "n_bytes"), n_hits, _ROW_BYTES)
    compared = full.join(small, ["digest", "n_bytes"], "left_semi").groupBy("digest", "n_bytes")
    return settle(
        compared.agg(F.min("t").alias("a"), F.max("t").alias("b")).where("a <> b").select("digest", "n_bytes")
    )


def _rows(arrivals: DataFrame, hits: DataFrame, n_hits: int) -> DataFrame:
    """Each arrival with its group; single ones are groups of themselves."""
    same = ["digest", "n_bytes", "doc_id"]
    rows = arrivals.groupBy(*same).agg(F.count(F.lit(1)).alias("copies"), F.first("sha256").alias("sha256"))
    joined = rows.join(broadcast_if_small(hits, n_hits, _ROW_BYTES), ["digest", "n_bytes"], "left")
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    each = F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")
    spread = joined.select("doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("bigint").alias("group_size"), F.coalesce("sha256", "digest").alias("text_sha256"), each)
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)
    return spread.select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256")


def _with_texts(
    df: DataFrame, key: str, text: str, arrivals: DataFrame, hits: DataFrame, n_hits: int, mixed: DataFrame, n_mixed: int, bits: int
) -> DataFrame:
    """The same where some digests hold several texts: their groups are made by the text."""
    rare = broadcast_if_small(mixed, n_mixed, _ROW_BYTES)
    clean = _rows(
        arrivals.join(rare, ["digest", "n_bytes"], "left_anti"), hits.join(rare, ["digest", "n_bytes"], "left_anti"), n_hits
    )
    full = df.select(F.col(f"`{key}`").cast("bigint").alias("doc_id"), _digest(text, bits).alias("digest"), text_or_empty(text).alias("t"))
    full = full.withColumn("n_bytes", F.octet_length("t")).join(rare, ["digest", "n_bytes"], "left_semi")
    groups = full.groupBy("t").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    named = full.groupBy("t", "doc_id").agg(F.count(F.lit(1)).alias("copies")).join(groups, "t")
    spread = named.select("doc_id", "keep_id", "group_size", F.sha2("t", 256).alias("text_sha256"), F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)
    return clean.unionByName(spread.select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256"))


def keep_one(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``df`` without the rows whose text another row has; all columns stay.

    Rows that stay are found by (key, text digest), so texts are not compared
    again.  Of rows equal in key and text one stays, whichever.
    """
    refuse_hidden(df)
    found = deduplicate(df, key, text)
    keep = settle(
        found.groupBy("doc_id", "text_sha256").agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("copies")).where("kept")
    )
    n_keep = keep.count()
    own = df.withColumn("__llm_k", F.col(f"`{key}`").cast("bigint")).withColumn("__llm_d", F.sha2(text_or_empty(text), 256))
    keep = keep.select(F.col("doc_id").alias("__llm_k2"), F.col("text_sha256").alias("__llm_d2"), F.col("copies").alias("__llm_c"))
    same = (F.col("__llm_d") == F.col("__llm_d2")) & F.col("__llm_k").eqNullSafe(F.col("__llm_k2"))
    joined = own.join(broadcast_if_small(keep, n_keep, _ROW_BYTES), same)
    columns = [F.col(f"`{c}`") for c in df.columns]
    single = joined.where("__llm_c = 1").select(*columns)
    repeated = joined.where("__llm_c > 1").dropDuplicates(["__llm_k", "__llm_d"]).select(*columns)
    return single.unionByName(repeated)
