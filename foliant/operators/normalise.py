"""A page's way from raw markdown to what is indexed: tables, elided cells, tags."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.functions import text as fx
from foliant.operators import tables


def normalised(pages: DataFrame) -> DataFrame:
    """(doc_id, page_num, text, affected_cells, has_ellipsis, fallback_appended).

    pages: (doc_id, page_num, text, layer), the layer being the page's own text
    where it was read by OCR. Elided cells are counted before tables are rendered in
    place; where there are some, a note follows, and the layer if it has 50 signs;
    then captions and footnotes are tagged. A null text stays null.
    """
    counted = pages.withColumns({"affected_cells": F.coalesce(fx.ellipsis_cells(F.col("text")), F.lit(0)), "layer": F.trim(F.coalesce("layer", F.lit("")))})
    made = tables.replaced(counted)
    n, long = F.col("affected_cells"), F.length("layer") >= 50
    note = F.concat(F.lit("\n\n<!-- "), n.cast("string"), F.lit(" table cells were elided on page "), F.col("page_num").cast("string"), F.when(long, F.lit("; its text layer follows. -->\n\n")).otherwise(F.lit("; it has no text layer. -->\n")))
    noted = F.when(n == 0, F.col("text")).when(long, F.concat("text", note, F.col("layer"), F.lit("\n"))).otherwise(F.concat("text", note))
    return made.select("doc_id", "page_num", fx.tag_elements(noted).alias("text"), "affected_cells", (n > 0).alias("has_ellipsis"), ((n > 0) & long).alias("fallback_appended"))


def elements(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(captions, footnotes) of pages, in order: (doc_id, page_num, nth, kind, number,
    title) and (doc_id, page_num, nth, marker, note)."""
    at = pages.select("doc_id", "page_num", "text")
    captions = at.select("doc_id", "page_num", F.posexplode(fx.captions(F.col("text"))).alias("nth", "c")).select("doc_id", "page_num", "nth", "c.*")
    footnotes = at.select("doc_id", "page_num", F.posexplode(fx.footnotes(F.col("text"))).alias("nth", "f")).select("doc_id", "page_num", "nth", "f.*")
    return captions, footnotes


def native(pages: DataFrame, sections: DataFrame | None = None) -> DataFrame:
    """(doc_id, json): each document with its normalised pages, tables and elided cells.

    pages as normalised() takes them; sections: (doc_id, node_id, title, level,
    page_start, page_end).
    """
    made = normalised(pages)
    texts = made.groupBy("doc_id").agg(F.count("*").alias("total_pages"), F.array_sort(F.collect_list(F.struct("page_num", "text"))).alias("page_markdowns"), F.array_sort(F.collect_list(F.when(F.col("has_ellipsis"), F.struct("page_num", "affected_cells", "fallback_appended")))).alias("ellipsis_pages"))
    found = tables.parsed(pages).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page_num", "table_no", "n_rows", "n_cols", "headers", "rows"))).alias("tables"))
    whole = texts.join(found, "doc_id", "left").withColumn("tables", F.coalesce("tables", F.expr("array()").cast(found.schema["tables"].dataType)))
    parts = ["doc_id", "total_pages", "page_markdowns", "ellipsis_pages", "tables"]
    if sections is not None:
        listed = sections.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("node_id", "title", "level", "page_start", "page_end"))).alias("sections"))
        whole, parts = whole.join(listed, "doc_id", "left"), [*parts, "sections"]
    return whole.select("doc_id", F.to_json(F.struct(*parts)).alias("json"))
