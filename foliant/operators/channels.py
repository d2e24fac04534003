"""Retrieval channels: queries and an index in, hits out.

hits: (query_id, doc_id, page_num, channel, score, pos). ``nodes`` are those of
tree.build_tree; a channel gives each page its best score once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions.text import expansions, identifiers, json_list
from foliant.operators import graph, lexical, tree

HIT = ["query_id", "doc_id", "page_num", "channel", "score", "pos"]


def as_hits(scored: DataFrame, channel: str, top_k: int | None) -> DataFrame:
    """Each page's best score of (query_id, doc_id, page_num, score), the best ``top_k`` pages in order."""
    best = scored.groupBy("query_id", "doc_id", "page_num").agg(F.round(F.max("score"), 6).alias("score"))
    pos = F.row_number().over(Window.partitionBy("query_id", "doc_id").orderBy(F.desc("score"), "page_num"))
    ranked = best.withColumn("pos", pos.cast("long")).withColumn("channel", F.lit(channel))
    return (ranked.filter(F.col("pos") <= top_k) if top_k else ranked).select(*HIT)


def _on_pages(scored: DataFrame, nodes: DataFrame) -> DataFrame:
    """Scores of nodes (query_id, doc_id, ord, score) on the pages that they cover."""
    spans = nodes.filter("page_start is not null").select("doc_id", "ord", "page_start", "page_end")
    return scored.join(spans.hint("merge"), ["doc_id", "ord"]).select("query_id", "doc_id", F.explode(F.sequence("page_start", "page_end")).alias("page_num"), "score", (F.col("page_end") - F.col("page_start") + 1).alias("span"))


def _spread(scored: DataFrame, nodes: DataFrame) -> DataFrame:
    """As _on_pages, divided by the root of how many pages a node covers."""
    return _on_pages(scored, nodes).withColumn("score", F.col("score") / F.sqrt(F.col("span").cast("double"))).drop("span")


def bmx_multiquery(index: lexical.Index | lexical.Pages, queries: DataFrame, replies: DataFrame | None = None, original: float = 2.0, expansion: float = 0.4, top_k: int | None = 60, first: int = 15, more: int = 8) -> DataFrame:
    """A query's best pages, and those of its variants: (query_id, reply) hold a model's list of them."""
    own = index.bmx(queries, first).withColumn("score", original * F.col("score"))
    if replies is not None:
        each = replies.select("query_id", F.posexplode(expansions(F.col("reply"))).alias("nth", "query"))
        asked = each.select(F.struct("query_id", "nth").alias("query_id"), "query")
        found = index.bmx(asked, more).select(F.col("query_id.query_id").alias("query_id"), "doc_id", "page_num", (expansion * F.col("score")).alias("score"))
        own = own.select(*found.columns).unionByName(found)
    summed = own.groupBy("query_id", "doc_id", "page_num").agg(F.sum("score").alias("score"))
    return as_hits(summed, "bmx_multiquery", top_k)


def tree_bm25(nodes: DataFrame, queries: DataFrame, top_nodes: int = 3, bonus: float = 0.5, top_k: int | None = 60) -> DataFrame:
    """Pages of the best sections; words of the query in a section's title raise it."""
    found = lexical.bm25(tree.section_index(nodes), queries, top_nodes).withColumnRenamed("page_num", "ord")
    titles = nodes.select("doc_id", "ord", F.lower("title").alias("t"))
    words = queries.select("query_id", F.array_distinct(F.filter(F.split(F.lower("query"), r"\s+"), lambda w: F.length(w) >= 3)).alias("ws"))
    overlap = F.size(F.filter("ws", lambda w: F.contains(F.col("t"), w)))
    raised = found.join(titles, ["doc_id", "ord"]).join(words, "query_id").withColumn("score", F.col("score") * (1.0 + bonus * overlap))
    return as_hits(_spread(raised.select("query_id", "doc_id", "ord", "score"), nodes), "tree_bm25", top_k)


def identifier_boost(nodes: DataFrame, queries: DataFrame, boost: float = 25.0, top_k: int | None = 60) -> DataFrame:
    """Pages of sections whose titles hold one of the query's identifiers.

    Two signs of an identifier narrow the join: every place in a title where it may
    begin is one of the title's pairs of signs. Pairs are bounded by the alphabet, so
    they alone are broadcast; a section's pages go with its title, without a join.
    """
    ids = queries.select("query_id", F.explode(identifiers(F.col("query"))).alias("id")).withColumn("gram", F.substring("id", 1, 2))
    starts = F.sequence(F.lit(1), F.length("title") - 1)
    grams = F.array_distinct(F.when(F.length("title") > 1, F.transform(starts, lambda k: F.substring(F.col("title"), k, F.lit(2)))))
    titles = nodes.filter("page_start is not null").select("doc_id", "title", "page_start", "page_end", F.explode(grams).alias("gram"))
    near = titles.join(F.broadcast(ids.select("gram").distinct()), "gram", "left_semi")
    found = near.join(ids.hint("merge"), "gram").filter(F.contains("title", "id"))
    span = (F.col("page_end") - F.col("page_start") + 1).cast("double")
    pages = found.select("query_id", "doc_id", F.explode(F.sequence("page_start", "page_end")).alias("page_num"), (F.lit(boost) / F.sqrt(span)).alias("score"))
    return as_hits(pages, "identifier_boost", top_k)


def entity_2hop(entities: DataFrame, relations: DataFrame, nodes: DataFrame, queries: DataFrame, hops: int = 2, most: int = 12, seed_score: float = 8.0, hop_score: float = 3.0, top_k: int | None = 60) -> DataFrame:
    """Pages of nodes whose entities a query names, and of nodes a few steps away.

    entities: (doc_id, key, description, source_node_ids); relations: (doc_id, low,
    high). The seeds come first among the ``most`` nodes, then the nearest.
    """
    seeds = graph.find_nodes(entities, queries).select("query_id", "doc_id", "node_id").distinct().withColumn("distance", F.lit(0))
    around = graph.expand(entities, relations, seeds.drop("distance"), hops)
    every = seeds.unionByName(around).groupBy("query_id", "doc_id", "node_id").agg(F.min("distance").alias("distance"))
    nth = F.row_number().over(Window.partitionBy("query_id", "doc_id").orderBy("distance", "node_id"))
    few = every.withColumn("nth", nth).filter(F.col("nth") <= most)
    scored = few.join(nodes.select("doc_id", "node_id", "ord"), ["doc_id", "node_id"]).select("query_id", "doc_id", "ord", F.when(F.col("distance") == 0, seed_score).otherwise(hop_score).alias("score"))
    return as_hits(_on_pages(scored, nodes).drop("span"), "entity_2hop", top_k)


def llm_tree_nav(replies: DataFrame, nodes: DataFrame, score: float = 20.0, top_k: int | None = 60) -> DataFrame:
    """Pages of the nodes that a model picked from the outline, in its order, at one score.

    replies: (query_id, doc_id, reply), the reply holding a JSON array of node ids.
    """
    picks = replies.select("query_id", "doc_id", F.posexplode(json_list(F.col("reply"))).alias("at", "node_id"))
    spans = picks.join(nodes.filter("page_start is not null").select("doc_id", "node_id", "page_start", "page_end").hint("merge"), ["doc_id", "node_id"])
    each = spans.select("query_id", "doc_id", "at", F.explode(F.sequence("page_start", "page_end")).alias("page_num")).groupBy("query_id", "doc_id", "page_num").agg(F.min("at").alias("at"))
    pos = F.row_number().over(Window.partitionBy("query_id", "doc_id").orderBy("at", "page_num"))
    out = each.withColumn("pos", pos.cast("long")).select("query_id", "doc_id", "page_num", F.lit("llm_tree_nav").alias("channel"), F.lit(score).alias("score"), "pos")
    return out.filter(F.col("pos") <= top_k) if top_k else out
