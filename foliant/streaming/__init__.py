"""Keeping an index up to date while pages arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from foliant.operators import lexical


def latest(pages: DataFrame) -> DataFrame:
    """Of pages (doc_id, page_num, text, batch) that arrived more than once, what came last."""
    best = F.max_by(F.struct("text"), F.struct("batch", F.xxhash64("text")))
    return pages.groupBy("doc_id", "page_num").agg(best.alias("b")).select("doc_id", "page_num", "b.text")


def collected(arriving: DataFrame, base: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Append pages as they arrive below ``base``, a folder per batch; a batch that is run again
    after a failure takes its own place. Pages of a batch count once."""

    def put(batch: DataFrame, number: int) -> None:
        rows = batch.select("doc_id", "page_num", "text").dropDuplicates().withColumn("batch", F.lit(number).cast("long"))
        rows.write.mode("overwrite").parquet(f"{base}/pages/part={number}")

    return arriving.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def refreshed(spark, base: str) -> lexical.Index:
    """The index of all pages that have arrived so far, written below ``base`` and read back."""
    pages = latest(spark.read.parquet(f"{base}/pages").drop("part"))
    lexical.Index.build(pages).save(f"{base}/index", "overwrite")
    return lexical.Index.load(spark, f"{base}/index")
