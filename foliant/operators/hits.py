"""Operators on hits: fusion, ranking, neighbours, budgets and context.

hits: (query_id, doc_id, page_num, channel, score, pos); ``pos`` is a hit's place
in its query's input and breaks every tie.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions.text import smart_truncate

PAGE = ["query_id", "doc_id", "page_num"]
UNRANKED = 10_000


def accumulate(hits: DataFrame) -> DataFrame:
    """One row per page: scores summed over channels, and by channel the last one, as a map."""
    per = hits.groupBy(*PAGE, "channel").agg(F.sum("score").alias("sum"), F.max_by("score", "pos").alias("last"), F.min("pos").alias("first"))
    return per.groupBy(*PAGE).agg(F.sum("sum").alias("score"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("channel", "last")))).alias("channel_scores"), F.min("first").alias("pos"))


def best_per_page(hits: DataFrame) -> DataFrame:
    """A page's best hit, the first of equal ones."""
    best = F.max_by(F.struct("channel", "score", "pos"), F.struct("score", -F.col("pos"))).alias("best")
    return hits.groupBy(*PAGE).agg(best).select(*PAGE, "best.*")


def weighted_merge(hits: DataFrame, top_k: int = 15) -> DataFrame:
    """A query's best hits by score, ties in order of input."""
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "pos"))
    return hits.withColumn("place", place).filter(F.col("place") <= top_k)


def dedup(hits: DataFrame) -> DataFrame:
    """The first hit of each page."""
    first = F.row_number().over(Window.partitionBy(*PAGE).orderBy("pos"))
    return hits.withColumn("nth", first).filter("nth = 1").drop("nth")


def rrf(hits: DataFrame, k: int = 60, top_k: int = 15) -> DataFrame:
    """Reciprocal rank fusion: a rank is the order of first appearance in a channel.

    A page that a channel of the query lacks has rank 10,000 there.
    """
    seen = hits.groupBy(*PAGE, "channel").agg(F.min("pos").alias("pos"))
    rank = F.row_number().over(Window.partitionBy("query_id", "channel").orderBy("pos"))
    ranked = seen.withColumn("rank", rank)
    channels = hits.groupBy("query_id").agg(F.count_distinct("channel").alias("channels"))
    summed = ranked.groupBy(*PAGE).agg(F.sum(1.0 / (k + F.col("rank"))).alias("sum"), F.count("*").alias("present"), F.min("pos").alias("pos"))
    score = F.col("sum") + (F.col("channels") - F.col("present")) / F.lit(float(k + UNRANKED))
    fused = summed.join(channels, "query_id").select(*PAGE, F.round(score, 9).alias("score"), "pos")
    return weighted_merge(fused, top_k) if top_k else fused


def rrf_hits(hits: DataFrame, k: int = 60, top_k: int = 15) -> DataFrame:
    """rrf with each page's longest text, the first of equally long ones, and its score by channel."""
    longest = F.max_by("text", F.struct(F.length("text").alias("n"), (-F.col("pos")).alias("p"))).alias("text")
    per = hits.groupBy(*PAGE, "channel").agg(F.max_by("score", "pos").alias("last"), F.max_by(F.struct("text", "pos"), F.struct(F.length("text").alias("n"), (-F.col("pos")).alias("p"))).alias("best"))
    told = per.select(*PAGE, "channel", "last", "best.text", "best.pos").groupBy(*PAGE).agg(longest, F.map_from_entries(F.array_sort(F.collect_list(F.struct("channel", "last")))).alias("channel_scores"))
    return rrf(hits, k, top_k).join(told, PAGE)


def with_text(hits: DataFrame, pages: DataFrame) -> DataFrame:
    """Hits with their pages' texts, empty where there is none."""
    texts = pages.select("doc_id", "page_num", F.col("text"))
    return hits.join(texts, ["doc_id", "page_num"], "left").withColumn("text", F.coalesce("text", F.lit("")))


def within_budget(hits: DataFrame, most: int = 25_000, overhead: int = 20) -> DataFrame:
    """The first hits of each query whose texts fit; nothing after the first that doesn't."""
    used = F.sum(F.length("text") + overhead).over(Window.partitionBy("query_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    return hits.withColumn("used", used).filter(F.col("used") <= most)


def neighbours(ranked: DataFrame, pages: DataFrame, radius: int = 1, score: float = 0.1, totals: DataFrame | None = None) -> DataFrame:
    """Pages next to ranked ones that exist and aren't ranked themselves.

    With ``totals`` (doc_id, total_pages) every number from 1 to the total exists,
    and with a total of 0 every number from 1.
    """
    around = ranked.select("query_id", "doc_id", F.explode(F.sequence(F.col("page_num") - radius, F.col("page_num") + radius)).alias("page_num")).distinct()
    if totals is None:
        real = around.join(pages.select("doc_id", "page_num"), ["doc_id", "page_num"], "left_semi")
    else:
        known = around.join(totals.select("doc_id", "total_pages"), "doc_id").filter("page_num >= 1 and (total_pages = 0 or page_num <= total_pages)")
        real = known.drop("total_pages")
    return real.join(ranked.select(*PAGE), PAGE, "left_anti").select(*PAGE, F.lit(score).alias("score"))


def hybrid(hits: DataFrame, lexical: DataFrame, pages: DataFrame, merged_weight: float = 0.4, lexical_weight: float = 0.6, pool: int = 30, top_k: int = 15, radius: int = 1, limit: int | None = None, totals: DataFrame | None = None, channels: bool = False) -> DataFrame:
    """(query_id, doc_id, page_num, score, kind): fused ranking, then its neighbours.

    The best ``pool`` pages by summed channel scores are ranked again with the
    page's own lexical score; the best ``top_k`` stay, neighbours follow in the order
    of pages, ``limit`` in all. ``channels`` adds each page's scores by channel.
    """
    by_doc = Window.partitionBy("query_id", "doc_id")
    merged = accumulate(hits).withColumn("nth", F.row_number().over(by_doc.orderBy(F.desc("score"), "page_num"))).filter(F.col("nth") <= pool)
    own = lexical.select(*PAGE, F.col("score").alias("own"))
    final = F.round(merged_weight * F.col("score") + lexical_weight * F.coalesce("own", F.lit(0.0)), 6)
    told = ["channel_scores"] if channels else []
    fused = merged.join(own, PAGE, "left").select(*PAGE, final.alias("score"), *told)
    ranked = fused.withColumn("nth", F.row_number().over(by_doc.orderBy(F.desc("score"), "page_num"))).filter(F.col("nth") <= top_k).drop("nth")
    near = neighbours(ranked, pages, radius, totals=totals)
    both = ranked.withColumn("kind", F.lit("ranked")).unionByName(near.withColumn("kind", F.lit("neighbour")), allowMissingColumns=True)
    if not limit:
        return both
    order = by_doc.orderBy(F.desc("kind"), F.when(F.col("kind") == "ranked", -F.col("score")).otherwise(F.col("page_num")), "page_num")
    return both.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= limit).drop("nth")


def context(hits: DataFrame, most: int | None = None, label: str = "Page") -> DataFrame:
    """(query_id, context): the hits' texts in order under their pages, or chunks'
    names where there is no page; cut at a boundary to ``most`` signs."""
    named = F.coalesce(F.concat(F.lit(f"[{label} "), F.col("page_num").cast("string"), F.lit("]")), F.concat(F.lit("[Chunk "), F.col("chunk_id"), F.lit("]")) if "chunk_id" in hits.columns else F.lit("[Chunk]"))
    block = F.concat(named, F.lit("\n"), F.trim("text"))
    parts = F.array_sort(F.collect_list(F.struct("pos", block.alias("block"))))
    whole = hits.groupBy("query_id").agg(F.array_join(F.transform(parts, lambda p: p["block"]), "\n\n---\n\n").alias("context"))
    return whole.withColumn("context", smart_truncate(F.col("context"), most)) if most else whole


def history(turns: DataFrame, pairs: int = 8) -> DataFrame:
    """A conversation's last ``2 * pairs`` messages, of these the user's and assistant's."""
    back = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    return turns.withColumn("back", back).filter(F.col("back") <= 2 * pairs).filter(F.col("role").isin("user", "assistant")).drop("back")
