"""Documents as wholes: page kinds, summaries, routing and export."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions.text import ellipsis_cells


def page_kinds(pages: DataFrame, least: int = 50, ocr_below: int = 300) -> DataFrame:
    """Pages with ``char_count``, ``page_type`` (text or scan) and ``needs_ocr``."""
    n = F.length(F.trim(F.coalesce("text", F.lit(""))))
    return pages.select("doc_id", "page_num", n.alias("char_count"), F.when(n >= least, "text").otherwise("scan").alias("page_type"), (n < ocr_below).alias("needs_ocr"))


def merged_pages(pages: DataFrame, more: DataFrame) -> DataFrame:
    """pages filled up from more: only empty texts are replaced, unknown pages are added."""
    both = pages.alias("a").join(more.alias("b"), ["doc_id", "page_num"], "full_outer")
    return both.select("doc_id", "page_num", F.coalesce(F.nullif(F.col("a.text"), F.lit("")), F.col("b.text"), F.lit("")).alias("text"))


def load_summary(kinds: DataFrame) -> DataFrame:
    """(doc_id, n_text, n_scan, track): text if more than half of the pages are."""
    n_text = F.sum((F.col("page_type") == "text").cast("int"))
    return kinds.groupBy("doc_id").agg(n_text.alias("n_text"), (F.count("*") - n_text).alias("n_scan"), F.when(n_text * 2 > F.count("*"), "text").otherwise("scan").alias("track"))


def doc_meta(pages: DataFrame, most: int = 400, sections: DataFrame | None = None, entities: DataFrame | None = None, few: int = 10) -> DataFrame:
    """(doc_id, total_pages, summary): the first page's first signs; with sections (doc_id,
    node_id, title) and entities (doc_id, key) also ``headings`` and ``top_entities``, ten each."""
    out = pages.groupBy("doc_id").agg(F.count("*").alias("total_pages"), F.min_by(F.substring("text", 1, most), "page_num").alias("summary"))
    none = F.array().cast("array<string>")
    if sections is not None:
        nth = F.row_number().over(Window.partitionBy("doc_id").orderBy("node_id"))
        first = sections.withColumn("nth", nth).filter(F.col("nth") <= few).groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", "title"))), lambda x: x["title"]).alias("headings"))
        out = out.join(first, "doc_id", "left").withColumn("headings", F.coalesce("headings", none))
    if entities is not None:
        nth = F.row_number().over(Window.partitionBy("doc_id").orderBy("key"))
        first = entities.withColumn("nth", nth).filter(F.col("nth") <= few).groupBy("doc_id").agg(F.array_sort(F.collect_list("key")).alias("top_entities"))
        out = out.join(first, "doc_id", "left").withColumn("top_entities", F.coalesce("top_entities", none))
    return out


def route(meta: DataFrame, picks: DataFrame, most: int = 3) -> DataFrame:
    """(query_id, doc_id, place): a model's picks that exist, in its order, the first three.

    picks: (query_id, doc_ids). A repeated pick counts once.
    """
    each = picks.select("query_id", F.posexplode("doc_ids").alias("at", "doc_id")).groupBy("query_id", "doc_id").agg(F.min("at").alias("at"))
    known = each.join(meta.select("doc_id"), "doc_id", "left_semi")
    listed = known.groupBy("query_id").agg(F.slice(F.array_sort(F.collect_list(F.struct("at", "doc_id"))), 1, most).alias("xs"))
    return listed.select("query_id", F.posexplode("xs.doc_id").alias("place", "doc_id"))


def exported(pages: DataFrame) -> DataFrame:
    """(doc_id, json): a document's pages as one JSON text."""
    items = F.array_sort(F.collect_list(F.struct("page_num", "text")))
    return pages.groupBy("doc_id").agg(F.to_json(F.struct(F.col("doc_id"), F.count("*").alias("total_pages"), items.alias("pages"))).alias("json"))


def exported_all(pages: DataFrame, sections: DataFrame | None = None, tables: DataFrame | None = None, entities: DataFrame | None = None) -> DataFrame:
    """(doc_id, json): each document's number of pages, sections, tables, entities and pages with
    elided cells, as one JSON text."""
    n = ellipsis_cells(F.col("text"))
    out = pages.groupBy("doc_id").agg(F.count("*").alias("total_pages"), F.array_sort(F.collect_list(F.when(n > 0, F.struct("page_num", n.alias("affected_cells"))))).alias("ellipsis_pages"))
    parts = ["doc_id", "total_pages", "ellipsis_pages"]
    for name, frame, columns in (("sections", sections, ["node_id", "title", "level", "page_start", "page_end"]), ("tables", tables, ["page_num", "table_no", "n_rows", "n_cols", "headers"]), ("entities", entities, ["key", "name", "entity_type", "description"])):
        if frame is not None:
            listed = frame.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(*columns))).alias(name))
            out, parts = out.join(listed, "doc_id", "left"), [*parts, name]
    return out.select("doc_id", F.to_json(F.struct(*parts)).alias("json"))
