"""Where pages come from, and where indexes and documents go."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What reads a file's bytes: page by page its text layer.
Reader = Callable[[bytes], list[str]]
#: What reads pages from a file's bytes by OCR: page numbers in, texts by number out.
Ocr = Callable[[bytes, list[int]], dict[int, str]]


def doc_id(path: F.Column) -> F.Column:
    """Twelve hexadecimal digits that name a path."""
    return F.substring(F.sha1(path.cast("binary")), 1, 12)


def files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, path, content) of files; a path without any fails."""
    found = spark.read.format("binaryFile").load(path)
    return found.select(doc_id(F.col("path")).alias("doc_id"), "path", "content")


def text_layers(found: DataFrame, reader: Reader, least: int = 50) -> DataFrame:
    """(doc_id, page_num, text, char_count, has_text_layer, page_type, total_pages): a row per page.

    ``reader`` gives the pages' texts of a file's bytes and runs in the workers. A page
    with fewer than ``least`` signs is a scan.
    """
    kinds = T.StructType([found.schema["doc_id"], T.StructField("page_num", T.LongType()), T.StructField("text", T.StringType()), T.StructField("total_pages", T.LongType())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, content in enumerate(batch.column(1).to_pylist()):
                texts = reader(content)
                take = pa.array([k] * len(texts), pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(take), pa.array(range(1, len(texts) + 1), pa.int64()), pa.array(texts, pa.string()), pa.array([len(texts)] * len(texts), pa.int64())], names=kinds.fieldNames())

    pages = found.select("doc_id", "content").mapInArrow(rows, kinds)
    n = F.length(F.trim(F.coalesce("text", F.lit(""))))
    return pages.select("doc_id", "page_num", "text", n.alias("char_count"), (n >= least).alias("has_text_layer"), F.when(n >= least, "text").otherwise("scan").alias("page_type"), "total_pages")


def read_by_ocr(pages: DataFrame, found: DataFrame, ocr: Ocr | None, below: int = 300, every: bool = False) -> DataFrame:
    """pages with ``ocr_done`` and ``skipped``: texts that OCR read take the place of short ones.

    Pages of fewer than ``below`` signs are sent, or ``every`` one. Without a reader, or
    where it fails, pages stay as they are and ``skipped`` says why.
    """
    n = F.length(F.trim(F.coalesce("text", F.lit(""))))
    if ocr is None:
        return pages.withColumns({"ocr_done": F.lit(False), "skipped": F.lit("ocr_unavailable")})
    wanted = pages.filter(F.lit(every) | (n < below)).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.col("page_num").cast("long"))).alias("wanted"))
    kinds = T.StructType([pages.schema["doc_id"], T.StructField("page_num", T.LongType()), T.StructField("read", T.StringType()), T.StructField("skipped", T.StringType())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, (content, numbers) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                try:
                    texts, why = ocr(content, numbers), "not_read"
                except Exception as e:  # noqa: BLE001  a service's failure is data here
                    texts, why = {}, str(e)[:200]
                take = pa.array([k] * len(numbers), pa.int64())
                read = [texts.get(p) for p in numbers]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(take), pa.array(numbers, pa.int64()), pa.array(read, pa.string()), pa.array([None if r is not None else why for r in read], pa.string())], names=kinds.fieldNames())

    made = found.select("doc_id", "content").join(wanted, "doc_id").mapInArrow(rows, kinds)
    joined = pages.withColumn("page_num", F.col("page_num").cast("long")).join(made, ["doc_id", "page_num"], "left")
    return joined.withColumns({"ocr_done": F.col("read").isNotNull(), "text": F.coalesce("read", "text")}).drop("read")


def ocr_cache(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, page_num, text) from JSON files that map page numbers to texts."""
    found = spark.read.text(path, wholetext=True).select(doc_id(F.input_file_name()).alias("doc_id"), F.explode(F.from_json("value", "map<string,string>")).alias("page", "text"))
    return found.select("doc_id", F.try_to_number("page", F.lit("999999999")).cast("long").alias("page_num"), "text").filter("page_num is not null")


def html_files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, html) of whole files."""
    return spark.read.text(path, wholetext=True).select(doc_id(F.input_file_name()).alias("doc_id"), F.col("value").alias("html"))


def positional_xml(found: DataFrame, tool: Callable[[bytes], str]) -> DataFrame:
    """(doc_id, xml): what a converter makes of files' bytes; its document type goes."""
    kinds = T.StructType([found.schema["doc_id"], T.StructField("xml", T.StringType())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([tool(c) for c in batch.column(1).to_pylist()], pa.string())], names=kinds.fieldNames())

    made = found.select("doc_id", "content").mapInArrow(rows, kinds)
    return made.withColumn("xml", F.regexp_replace("xml", r"<!DOCTYPE[^>]*>", ""))


def structured_texts(pages: DataFrame, html: DataFrame) -> DataFrame:
    """pages with ``text`` from layout.page_html's sections (doc_id, page_num, html), headings
    marked; pages that OCR has read stay as they are."""
    marked = F.regexp_replace(F.regexp_replace("html", r"<h2>", "\n## "), r"<h3>", "\n### ")
    plain = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(marked, r"</(h2|h3|p|tr)>", "\n"), r"<[^>]*>", " "), r"[ \t]*\n\s*", "\n"))
    read = html.select("doc_id", "page_num", plain.alias("made"))
    done = F.coalesce("ocr_done", F.lit(False)) if "ocr_done" in pages.columns else F.lit(False)
    return pages.join(read, ["doc_id", "page_num"], "left").withColumn("text", F.when(~done & (F.length("made") > 0), F.col("made")).otherwise(F.col("text"))).drop("made")


def save(base: str, **tables: DataFrame) -> None:
    """Write an index's tables below ``base``, each under its name."""
    for name, frame in tables.items():
        frame.write.mode("overwrite").parquet(f"{base}/{name}")


def load(spark: SparkSession, base: str, *names: str) -> dict[str, DataFrame]:
    """What save() wrote."""
    return {name: spark.read.parquet(f"{base}/{name}") for name in names}


def framework_documents(pages: DataFrame) -> Iterator[dict]:
    """One document per page for other frameworks, as dicts, page by page as they arrive."""
    text = F.coalesce(F.nullif(F.col("markdown"), F.lit("")), "text") if "markdown" in pages.columns else F.col("text")
    rest = [c for c in pages.columns if c not in ("text", "markdown")]
    for row in pages.select(text.alias("page_content"), F.struct(*rest).alias("metadata")).toLocalIterator():
        yield {"page_content": row["page_content"] or "", "metadata": row["metadata"].asDict()}
