"""The driver's tables in the shapes that the operators take."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each source is a document; its pages are numbered by the document's id from 1."""
    return table(spark, sf_dir, "documents").select(F.col("source").alias("doc_id"), (F.col("doc_id") + 1).alias("page_num"), "text")


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each benchmark item, whole."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def order_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An HTML table per order, a row per line; each order is a page of its customer-like group."""
    # the rows' HTML is made after the shuffle, which moves the bare numbers
    cell = lambda c: F.concat(F.lit("<td>"), c.cast("string"), F.lit("</td>"))
    lines = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")))
    rows = F.array_join(F.transform(lines, lambda x: F.concat(F.lit("<tr>"), cell(x["l_linenumber"]), cell(x["l_partkey"]), cell(x["l_returnflag"]), F.lit("</tr>"))), "")
    head = "<table><thead><tr><th>line</th><th>part</th><th>flag</th></tr></thead><tbody>"
    text = F.concat(F.lit(f"before {head}"), rows, F.lit("</tbody></table> after"))
    made = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(text.alias("text"))
    return made.select((F.col("l_orderkey") % 10).alias("doc_id"), F.col("l_orderkey").alias("page_num"), "text")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text items of a page per order: a row per line, four columns, all a little off."""
    line = table(spark, sf_dir, "lineitem").repartition("l_orderkey")  # lines are moved, not the four items of each
    at = lambda k, c: F.struct((F.col("l_linenumber") * 20 + (F.col("l_partkey") + k) % 6).alias("top"), (k * 100 + F.col("l_suppkey") % 7).alias("left"), F.col(c).cast("string").alias("text"))
    return line.select(F.col("l_orderkey").alias("page"), F.explode(F.array(*[at(k, c) for k, c in enumerate(("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag"))])).alias("i")).select("page", "i.*")


def headed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document per region: a page per nation, headed by it, its suppliers below."""
    nation, supplier = table(spark, sf_dir, "nation"), table(spark, sf_dir, "supplier")
    names = F.array_join(F.transform(F.array_sort(F.collect_list("s_name")), lambda s: F.concat(F.lit("### "), s)), "\nbody\n")
    per = supplier.groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(names.alias("names"))
    text = F.concat(F.lit("## "), F.col("n_name"), F.lit("\n"), F.coalesce("names", F.lit("nobody")))
    return nation.join(per, "n_nationkey", "left").select(F.col("n_regionkey").alias("doc_id"), (F.col("n_nationkey") + 1).alias("page_num"), text.alias("text"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """supplier - nation - region."""
    nation, region, supplier = (table(spark, sf_dir, n) for n in ("nation", "region", "supplier"))
    up = nation.join(region, nation["n_regionkey"] == region["r_regionkey"]).select(F.col("n_name").alias("src"), F.col("r_name").alias("dst"))
    down = supplier.join(nation, supplier["s_nationkey"] == nation["n_nationkey"]).select(F.col("s_name").alias("src"), F.col("n_name").alias("dst"))
    return up.union(down)


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model's reply per supplier: itself, its nation, and how they relate."""
    nation, supplier = table(spark, sf_dir, "nation"), table(spark, sf_dir, "supplier")
    joined = supplier.join(nation, supplier["s_nationkey"] == nation["n_nationkey"])
    text = F.concat(F.lit("ENTITY|"), F.col("s_name"), F.lit("|Organization|a supplier\nENTITY| "), F.lower("n_name"), F.lit(" |Place|"), F.concat_ws(" ", F.lit("home of"), "s_name"), F.lit("\nREL|"), F.col("s_name"), F.lit("|"), F.col("n_name"), F.lit("|part_of|lives there\nDONE"))
    return joined.select(F.col("n_regionkey").alias("doc_id"), F.lpad(F.col("s_suppkey").cast("string"), 9, "0").alias("node_id"), text.alias("text"))


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page per part: a caption, a footnote, and two table cells, of which one may be elided."""
    size = F.col("p_size").cast("string")
    cell = F.when(F.col("p_partkey") % 3 == 0, "...").otherwise(F.col("p_brand"))
    text = F.concat(F.lit("Intro\nTable "), size, F.lit(".1: "), F.col("p_name"), F.lit("\n("), size, F.lit(") note on "), F.col("p_name"), F.lit("\n<td>"), cell, F.lit("</td><td>...</td>"))
    return table(spark, sf_dir, "part").select(F.lit("parts").alias("doc_id"), F.col("p_partkey").alias("page_num"), text.alias("text"))


def split_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """order_tables in documents of 64 orders; every five orders the last column has another name."""
    o = F.col("page_num")
    head = F.when(F.floor(o / 5) % 2 == 0, "<th>flag</th>").otherwise("<th>status</th>")
    text = F.concat(F.substring_index("text", "<th>flag</th>", 1), head, F.substring_index("text", "<th>flag</th>", -1))
    return order_tables(spark, sf_dir).select(F.floor(o / 64).alias("doc_id"), "page_num", text.alias("text"))


def region_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page per region: one header over both columns, the region's cell beside all its nations."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    names = F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name")))
    per = nation.groupBy("n_regionkey").agg(names.alias("ns"))
    rows = F.transform("ns", lambda x, i: F.concat(F.lit("<tr>"), F.when(i == 0, F.concat(F.lit('<td rowspan="'), F.size("ns").cast("string"), F.lit('">'), F.col("r_name"), F.lit("</td>"))).otherwise(""), F.lit("<td>"), x["n_name"], F.lit("</td></tr>")))
    text = F.concat(F.lit('<table><thead><tr><th colspan="2">places</th></tr><tr><th>region</th><th>nation</th></tr><tbody>'), F.array_join(rows, ""), F.lit("</table>"))
    return region.join(per, F.col("r_regionkey") == F.col("n_regionkey")).select(F.lit("r").alias("doc_id"), F.col("r_regionkey").alias("page_num"), text.alias("text"))


def wide_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of eight columns per part, two of them without a name, one often blank."""
    cells = ["p_partkey", "p_name", "p_brand", "p_type", "p_mfgr", "p_size", "p_retailprice", "p_note"]
    part = table(spark, sf_dir, "part").withColumns({"p_mfgr": F.when(F.col("p_partkey") % 2 == 0, "x").otherwise(" "), "p_note": F.lit("long note")})
    row = F.concat(*[x for c in cells for x in (F.lit("<td>"), (F.floor(c).cast("string") if c == "p_retailprice" else F.col(c).cast("string")), F.lit("</td>"))])
    heads = "".join(f"<th>{h}</th>" for h in ("key", "name", "brand", "type", "", "size", "price", ""))
    text = F.concat(F.lit(f"<table><tr>{heads}</tr><tr>"), row, F.lit("</tr></table>"))
    return part.select(F.lit("p").alias("doc_id"), F.col("p_partkey").alias("page_num"), text.alias("text"))


def tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page per part: a caption of one of six kinds, a footnote with one of four marks, elided cells, a text layer or not."""
    k = F.col("p_partkey")
    kind = F.element_at(F.array(*[F.lit(x) for x in ("Table", "Hình", "BẢNG", "Diagram", "Biểu", "sơ đồ")]), (k % 6 + 1).cast("int"))
    mark = F.element_at(F.array(*[F.lit(x) for x in ("(7)", "(**)", "[12]", "***")]), (k % 4 + 1).cast("int"))
    text = F.concat(F.lit("Intro\n"), kind, F.lit(" "), F.col("p_size").cast("string"), F.lit(".1 - "), F.col("p_name"), F.lit("\n"), mark, F.lit(" see "), F.col("p_name"), F.lit("\n(1234) no note\n<table><tr><td>a</td><td>"), F.when(k % 3 == 0, "...").otherwise("b"), F.lit("</td></tr></table>"))
    layer = F.when(k % 2 == 0, F.repeat(F.lit("layer "), 12))
    return table(spark, sf_dir, "part").select(F.lit("parts").alias("doc_id"), k.alias("page_num"), text.alias("text"), layer.alias("layer"))


def sparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three documents of a page per part; one page of twenty has a heading, from the third on."""
    k, page = F.col("p_partkey"), (F.floor(F.col("p_partkey") / 3) + 1).alias("page_num")
    head = F.when((F.floor(k / 3) + 1) % 20 == 3, F.concat(F.lit("# Part "), k.cast("string"), F.lit("\n"))).otherwise("")
    return table(spark, sf_dir, "part").select((k % 3).alias("doc_id"), page, F.concat(head, F.col("p_name"), F.lit(" of page")).alias("text"))


def styled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text items of a page per order, a row per line: the first is bold and tall, the second bold."""
    line = table(spark, sf_dir, "lineitem").withColumn("n", F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")))
    n = F.col("n")
    item = lambda left, text: F.struct((n * 30).alias("top"), F.lit(left).alias("left"), F.lit(10).alias("width"), F.when(n == 1, 20).otherwise(12).alias("height"), text.alias("text"), (n <= 2).alias("bold"))
    both = F.array(item(10, F.col("l_partkey").cast("string")), item(60, F.col("l_returnflag")))
    return line.select(F.col("l_orderkey").alias("page"), F.explode(both).alias("i")).select("page", "i.*")


def part_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tree without levels: a node per part, over up to three pages."""
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(F.lit("d").alias("doc_id"), F.lpad(k.cast("string"), 9, "0").alias("node_id"), k.cast("int").alias("ord"), k.cast("int").alias("last"), F.lit(1).alias("depth"), F.lit(1).alias("level"), F.concat("p_brand", F.lit(" "), "p_name").alias("title"), F.concat("p_name", F.lit(" "), "p_type").alias("text"), (k * 2).alias("page_start"), (k * 2 + k % 3).alias("page_end"))
