"""The registered queries of the retrieval operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliant.functions import text as fx
from foliant.operators import answer, channels, corpus, dom, graph, hits, layout, lexical, normalise, tables, tree
from foliant.operators.shared import written
from foliant.plans import fixtures as fix

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


_TOK = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}_]+')"
_PG = "pg AS (SELECT source AS doc_id, doc_id + 1 AS page_num, text FROM documents)"
_Q = "q AS (SELECT item_id AS query_id, text AS query FROM benchmark)"
_INDEX = f"""{_PG}, {_Q},
post AS (SELECT doc_id, page_num, term, count(*) AS tf FROM (SELECT doc_id, page_num, unnest({_TOK.format('text')}) AS term FROM pg) GROUP BY ALL),
size AS (SELECT doc_id, page_num, coalesce(len({_TOK.format('text')}), 0) AS n_words FROM pg),
st AS (SELECT doc_id, count(*) AS n, avg(n_words) AS avg_len FROM size GROUP BY 1),
ts AS (SELECT doc_id, term, count(*) AS df, log2(sum(tf)::DOUBLE) - sum(tf * log2(tf::DOUBLE)) / sum(tf) AS entropy FROM post GROUP BY 1, 2),
qt AS (SELECT query_id, term, asked, count(*) AS times FROM (SELECT query_id, len(w) AS asked, unnest(w) AS term FROM (SELECT query_id, {_TOK.format('query')} AS w FROM q)) GROUP BY 1, 2, 3),
m AS (SELECT *, ln((n - df + 0.5) / (df + 0.5) + 1) AS idf FROM post JOIN qt USING (term) JOIN ts USING (doc_id, term) JOIN st USING (doc_id) JOIN size USING (doc_id, page_num)),
bm AS (SELECT query_id, doc_id, page_num, round(sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * n_words / avg_len))), 6) AS score FROM m GROUP BY 1, 2, 3),
me AS (SELECT doc_id, avg(entropy) AS mean_entropy FROM ts GROUP BY 1),
ab AS (SELECT *, least(greatest(avg_len / 100, 0.5), 1.5) AS a, 1 / ln(n + 1.0) AS b FROM m JOIN me USING (doc_id)),
bx AS (SELECT query_id, doc_id, page_num, round(sum(times * idf * tf * (a + 1) / (tf + a * n_words / avg_len + a * mean_entropy)) + sum(times)::DOUBLE / max(asked) * sum(times * entropy * b), 6) AS score FROM ab GROUP BY 1, 2, 3)"""
_TOP = "QUALIFY row_number() OVER (PARTITION BY query_id, doc_id ORDER BY score DESC, page_num) <= {}"


@query(f"SELECT doc_id, coalesce(len({_TOK.format('text')}), 0)::BIGINT AS n_tokens, coalesce(len(list_distinct({_TOK.format('text')})), 0)::BIGINT AS n_distinct FROM documents")
def t1_tokens(spark: SparkSession, d: str) -> DataFrame:
    w = fx.tokens(F.col("text"))
    return fix.table(spark, d, "documents").select("doc_id", F.coalesce(F.size(w), F.lit(0)).cast("long").alias("n_tokens"), F.coalesce(F.size(F.array_distinct(w)), F.lit(0)).cast("long").alias("n_distinct"))


@query(f"WITH {_INDEX} SELECT * FROM bm WHERE score > 0 {_TOP.format(5)}")
def a4_bm25(spark: SparkSession, d: str) -> DataFrame:
    return lexical.bm25(fix.pages(spark, d), fix.queries(spark, d))


@query(f"WITH {_INDEX} SELECT * FROM bx WHERE score > 0 {_TOP.format(5)}")
def a5_bmx(spark: SparkSession, d: str) -> DataFrame:
    return lexical.bmx(fix.pages(spark, d), fix.queries(spark, d))


@query(f"WITH {_INDEX}, b AS (SELECT doc_id, page_num, max(score) AS score FROM bx GROUP BY 1, 2) SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, page_num) <= 5")
def a7_multi_query(spark: SparkSession, d: str) -> DataFrame:
    return lexical.multi_query(lexical.bmx(fix.pages(spark, d), fix.queries(spark, d)))


@query(f"WITH {_INDEX} SELECT doc_id, term, df, round(entropy, 6) + 0.0 AS entropy, round(ln((n - df + 0.5) / (df + 0.5) + 1), 6) AS idf FROM ts JOIN st USING (doc_id)")
def a2_term_stats(spark: SparkSession, d: str) -> DataFrame:
    pages = fix.pages(spark, d)
    idf = F.round(F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1.0), 6)
    return lexical.term_stats(lexical.postings(pages)).join(lexical.corpus_stats(pages), "doc_id").select("doc_id", "term", "df", (F.round("entropy", 6) + 0.0).alias("entropy"), idf.alias("idf"))


@query(f"""WITH {_INDEX}, c AS (SELECT *, 2.0 * score AS s FROM bx WHERE score > 0 {_TOP.format(15)}),
k AS (SELECT query_id, doc_id, page_num, sum(s) AS score FROM (SELECT query_id, doc_id, page_num, s FROM c UNION ALL SELECT query_id, doc_id, page_num, score FROM bm WHERE score > 0 {_TOP.format(60)}) GROUP BY 1, 2, 3 {_TOP.format(30)}),
g AS (SELECT k.query_id, k.doc_id, k.page_num, round(0.4 * k.score + 0.6 * coalesce(bx.score, 0), 6) AS score FROM k LEFT JOIN bx USING (query_id, doc_id, page_num)), f AS (SELECT * FROM g {_TOP.format(15)}),
nb AS (SELECT DISTINCT query_id, doc_id, page_num + x.d AS page_num FROM f, (VALUES (-1), (1)) AS x(d))
SELECT *, 'ranked' AS kind FROM f UNION ALL SELECT query_id, doc_id, page_num, 0.1 AS score, 'neighbour' AS kind FROM nb SEMI JOIN pg USING (doc_id, page_num) ANTI JOIN f USING (query_id, doc_id, page_num)""")
def r1_hybrid(spark: SparkSession, d: str) -> DataFrame:
    pages, queries = fix.pages(spark, d), fix.queries(spark, d)
    scored = written(lexical.Pages(pages).best(queries, 60, 15))
    own = scored.filter("bmx > 0").select("query_id", "doc_id", "page_num", F.col("bmx").alias("score"))
    plain = scored.filter("bm25 > 0").select("query_id", "doc_id", "page_num", F.col("bm25").alias("score"))
    first = lexical.top_pages(own, 15).select("query_id", "doc_id", "page_num", F.lit("bmx_multiquery").alias("channel"), (2.0 * F.col("score")).alias("score"), "page_num")
    first = first.toDF("query_id", "doc_id", "page_num", "channel", "score", "pos")
    second = lexical.top_pages(plain, 60).select("query_id", "doc_id", "page_num", F.lit("bm25").alias("channel"), "score", F.col("page_num").alias("pos"))
    return hits.hybrid(first.unionByName(second), own, pages)


def flagship(spark: SparkSession, d: str) -> DataFrame:
    return r1_hybrid(spark, d)


_HITS = "h AS (SELECT user_id % 50 AS query_id, 'd' AS doc_id, user_id AS page_num, event_type AS channel, round(value, 2) AS score, event_id AS pos, event_type || ' ' || props AS text FROM events)"


def _hits(spark: SparkSession, d: str) -> DataFrame:
    return fix.table(spark, d, "events").select((F.col("user_id") % 50).alias("query_id"), F.lit("d").alias("doc_id"), F.col("user_id").alias("page_num"), F.col("event_type").alias("channel"), F.round("value", 2).alias("score"), F.col("event_id").alias("pos"), F.concat("event_type", F.lit(" "), "props").alias("text"))


@query(f"WITH {_HITS} SELECT query_id, page_num, channel, score, pos, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, pos)::INT AS place FROM h QUALIFY place <= 15")
def r3_weighted_merge(spark: SparkSession, d: str) -> DataFrame:
    return hits.weighted_merge(_hits(spark, d)).select("query_id", "page_num", "channel", "score", "pos", "place")


@query(f"""WITH {_HITS}, s AS (SELECT query_id, page_num, channel, min(pos) AS pos FROM h GROUP BY 1, 2, 3),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id, channel ORDER BY pos) AS rk FROM s),
c AS (SELECT query_id, count(DISTINCT channel) AS n FROM h GROUP BY 1),
f AS (SELECT query_id, page_num, round(sum(1.0::DOUBLE / (60 + rk)) + (any_value(n) - count(*)) / 10060.0::DOUBLE, 9) AS score, min(pos) AS pos FROM r JOIN c USING (query_id) GROUP BY 1, 2)
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, pos)::INT AS place FROM f QUALIFY place <= 15""")
def r4_rrf(spark: SparkSession, d: str) -> DataFrame:
    return hits.rrf(_hits(spark, d)).drop("doc_id")


@query(f"WITH {_HITS} SELECT query_id, pos, sum(length(text) + 20) OVER (PARTITION BY query_id ORDER BY pos ROWS UNBOUNDED PRECEDING)::BIGINT AS used FROM h QUALIFY used <= 2500")
def r5_budget(spark: SparkSession, d: str) -> DataFrame:
    return hits.within_budget(_hits(spark, d), 2500).select("query_id", "pos", "used")


@query(f"WITH {_HITS} SELECT query_id, page_num, min(pos) AS pos FROM h GROUP BY 1, 2")
def r6_dedup(spark: SparkSession, d: str) -> DataFrame:
    return hits.dedup(_hits(spark, d)).select("query_id", "page_num", "pos")


@query(f"WITH {_HITS} SELECT query_id, page_num, round(sum(score), 4) AS score FROM h GROUP BY 1, 2")
def a15_accumulate(spark: SparkSession, d: str) -> DataFrame:
    return hits.accumulate(_hits(spark, d)).select("query_id", "page_num", F.round("score", 4).alias("score"))


@query(f"WITH {_HITS} SELECT query_id, page_num, channel, score, pos FROM h QUALIFY row_number() OVER (PARTITION BY query_id, page_num ORDER BY score DESC, pos) = 1")
def a17_best_per_page(spark: SparkSession, d: str) -> DataFrame:
    return hits.best_per_page(_hits(spark, d)).drop("doc_id")


@query(f"WITH {_HITS} SELECT query_id, string_agg('[Page ' || page_num || ']' || chr(10) || trim(text), chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY pos) AS context FROM h GROUP BY 1")
def t34_context(spark: SparkSession, d: str) -> DataFrame:
    return hits.context(_hits(spark, d))


@query(f"""WITH {_HITS}, l AS (SELECT DISTINCT ON (query_id, page_num) query_id, page_num, text FROM h ORDER BY query_id, page_num, length(text) DESC, pos), c AS (SELECT query_id, page_num, count(DISTINCT channel)::INT AS n_channels FROM h GROUP BY 1, 2),
s AS (SELECT query_id, page_num, channel, min(pos) AS pos FROM h GROUP BY 1, 2, 3), r AS (SELECT *, row_number() OVER (PARTITION BY query_id, channel ORDER BY pos) AS rk FROM s), k AS (SELECT query_id, count(DISTINCT channel) AS n FROM h GROUP BY 1),
f AS (SELECT query_id, page_num, round(sum(1.0::DOUBLE / (60 + rk)) + (any_value(n) - count(*)) / 10060.0::DOUBLE, 9) AS score, min(pos) AS pos FROM r JOIN k USING (query_id) GROUP BY 1, 2)
SELECT f.query_id, f.page_num, score, text, n_channels FROM f JOIN l USING (query_id, page_num) JOIN c USING (query_id, page_num) QUALIFY row_number() OVER (PARTITION BY f.query_id ORDER BY score DESC, f.pos) <= 15""")
def r4_rrf_hits(spark: SparkSession, d: str) -> DataFrame:
    return hits.rrf_hits(_hits(spark, d)).select("query_id", "page_num", "score", "text", F.size("channel_scores").alias("n_channels"))


@query(f"WITH {_HITS}, m AS (SELECT query_id, page_num, channel, arg_max(score, pos) AS last FROM h GROUP BY 1, 2, 3) SELECT query_id, page_num, string_agg(channel || '=' || last, ' ' ORDER BY channel) AS channel_scores FROM m GROUP BY 1, 2")
def a15_channel_scores(spark: SparkSession, d: str) -> DataFrame:
    each = F.transform(F.array_sort(F.map_entries("channel_scores")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return hits.accumulate(_hits(spark, d)).select("query_id", "page_num", F.array_join(each, " ").alias("channel_scores"))


@query(f"""WITH {_HITS}, c AS (SELECT query_id, string_agg('[Page ' || page_num || ']' || chr(10) || trim(text), chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY pos) AS context FROM h GROUP BY 1)
SELECT query_id, '=== CONTEXT ===' || chr(10) || context || chr(10) || '=== END ===' || chr(10) || chr(10) || 'Question: what of ' || query_id || '?' || chr(10) || 'Answer:' AS prompt, length(context)::INT AS context_chars FROM c""")
def y1_prompts(spark: SparkSession, d: str) -> DataFrame:
    found = _hits(spark, d)
    asked = found.select("query_id").distinct().withColumn("query", F.concat(F.lit("what of "), F.col("query_id").cast("string"), F.lit("?")))
    return answer.prompts(found, asked, most=10_000_000).drop("query")


@query(f"""WITH {_PG}, m AS (SELECT doc_id, count(*) AS total_pages, arg_min(substr(text, 1, 400), page_num) AS summary FROM pg GROUP BY 1), l AS (SELECT *, row_number() OVER (ORDER BY doc_id) AS ord FROM m)
SELECT string_agg('- id=' || doc_id || ' title="' || doc_id || '"' || chr(10) || '  summary: ' || substr(coalesce(summary, ''), 1, 300) || chr(10) || '  entities: ' || chr(10) || '  pages: ' || total_pages, chr(10) ORDER BY ord) AS text FROM l""")
def t35_documents(spark: SparkSession, d: str) -> DataFrame:
    metas = corpus.doc_meta(fix.pages(spark, d))
    named = metas.withColumns({"ord": F.row_number().over(Window.orderBy("doc_id")), "name": F.col("doc_id"), "title": F.lit(""), "top_entities": F.lit(None).cast("array<string>")})
    return answer.document_list(named, 1_000_000)


@query("""WITH a AS (SELECT c_nationkey AS query_id, c_custkey AS doc_id, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS place, c_name AS answer FROM customer QUALIFY place < 3)
SELECT n_nationkey AS query_id, CASE WHEN count(doc_id) = 0 THEN 'No document fits the question.' WHEN count(doc_id) = 1 THEN any_value(answer) ELSE string_agg('## From document ' || doc_id || chr(10) || answer, chr(10) || chr(10) ORDER BY place) END AS answer, count(doc_id)::INT AS n_picked
FROM nation LEFT JOIN a ON n_nationkey = query_id GROUP BY 1""")
def y4_combined(spark: SparkSession, d: str) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("c_nationkey").orderBy("c_custkey")) - 1
    answers = fix.table(spark, d, "customer").withColumn("place", place).filter("place < 3").select(F.col("c_nationkey").alias("query_id"), F.col("c_custkey").alias("doc_id"), "place", F.col("c_name").alias("answer"), F.lit(None).cast("string").alias("error"))
    asked = fix.table(spark, d, "nation").select(F.col("n_nationkey").alias("query_id"))
    return answer.combined(answers, asked).select("query_id", "answer", F.size("picked").alias("n_picked"))


@query("SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations) WHERE back <= 16 AND role IN ('user', 'assistant')")
def y1_history(spark: SparkSession, d: str) -> DataFrame:
    return hits.history(fix.table(spark, d, "conversations")).select("conv_id", "turn", "role")


_KINDS = f"WITH {_PG}, k AS (SELECT doc_id, page_num, length(trim(coalesce(text, '')))::INT AS char_count FROM pg)"


@query(f"{_KINDS} SELECT *, CASE WHEN char_count >= 50 THEN 'text' ELSE 'scan' END AS page_type, char_count < 300 AS needs_ocr FROM k")
def s1_page_kinds(spark: SparkSession, d: str) -> DataFrame:
    return corpus.page_kinds(fix.pages(spark, d))


@query(f"{_KINDS} SELECT doc_id, sum((char_count >= 50)::INT)::BIGINT AS n_text, sum((char_count < 50)::INT)::BIGINT AS n_scan, CASE WHEN n_text > n_scan THEN 'text' ELSE 'scan' END AS track FROM k GROUP BY 1")
def a18_load_summary(spark: SparkSession, d: str) -> DataFrame:
    return corpus.load_summary(corpus.page_kinds(fix.pages(spark, d)))


@query(f"WITH {_PG} SELECT doc_id, count(*) AS total_pages, arg_min(substr(text, 1, 400), page_num) AS summary FROM pg GROUP BY 1")
def a19_doc_meta(spark: SparkSession, d: str) -> DataFrame:
    return corpus.doc_meta(fix.pages(spark, d))


@query("""WITH p AS (SELECT item_id AS query_id, unnest(['src' || (item_id % 30), 'ghost', 'src' || (item_id % 7), 'src' || (item_id % 30), 'src1']) AS doc_id, unnest([0, 1, 2, 3, 4]) AS pos FROM benchmark),
f AS (SELECT query_id, doc_id, min(pos) AS pos FROM p WHERE doc_id IN (SELECT source FROM documents) GROUP BY 1, 2)
SELECT query_id, doc_id, (row_number() OVER (PARTITION BY query_id ORDER BY pos) - 1)::INT AS place FROM f QUALIFY place < 3""")
def y3_route(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("item_id")
    names = F.array(*[F.concat(F.lit("src"), x.cast("string")) if x is not None else F.lit("ghost") for x in (i % 30, None, i % 7, i % 30, F.lit(1))])
    picks = fix.table(spark, d, "benchmark").select(i.alias("query_id"), fx.json_list(F.concat(F.lit("I pick "), F.to_json(names))).alias("doc_ids"))
    return corpus.route(corpus.doc_meta(fix.pages(spark, d)), picks)


@query(r"""WITH t AS (SELECT doc_id, text, substr(text, 1, 500) AS w FROM documents), a AS (SELECT *, reverse(w) AS b FROM t),
r AS (SELECT doc_id, text, CASE WHEN strpos(b, chr(10) || chr(10)) > 0 AND 500 - strpos(b, chr(10) || chr(10)) - 1 >= 425 THEN 500 - strpos(b, chr(10) || chr(10)) - 1
  WHEN strpos(b, chr(10)) > 0 AND 500 - strpos(b, chr(10)) >= 425 THEN 500 - strpos(b, chr(10)) ELSE 500 END AS cut FROM a)
SELECT doc_id, CASE WHEN length(text) <= 500 THEN text ELSE left(text, cut::BIGINT) || chr(10) || chr(10) || '[... ' || (length(text) - cut) || ' characters cut]' END AS text FROM r""")
def t23_truncate(spark: SparkSession, d: str) -> DataFrame:
    return fix.table(spark, d, "documents").select("doc_id", fx.smart_truncate(F.col("text"), 500).alias("text"))


@query("SELECT p_partkey AS page_num, 'Table' AS kind, p_size || '.1' AS number, p_name AS title FROM part")
def t4_captions(spark: SparkSession, d: str) -> DataFrame:
    return fix.notes(spark, d).select("page_num", F.inline(fx.captions(F.col("text"))))


@query("SELECT p_partkey AS page_num, '(' || p_size || ')' AS marker, 'note on ' || p_name AS note FROM part")
def t5_footnotes(spark: SparkSession, d: str) -> DataFrame:
    return fix.notes(spark, d).select("page_num", F.inline(fx.footnotes(F.col("text"))))


@query("SELECT p_partkey AS page_num, CASE WHEN p_partkey % 3 = 0 THEN 2 ELSE 1 END::INT AS elided FROM part")
def t7_ellipsis(spark: SparkSession, d: str) -> DataFrame:
    return fix.notes(spark, d).select("page_num", fx.ellipsis_cells(F.col("text")).alias("elided"))


@query(r"SELECT p_partkey, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(p_brand || ' ' || p_size || '/2025 3.2 ' || p_type, '[A-Za-z]*\p{Nd}+(?:[./\-]\p{Nd}+)*[A-Za-z]*'), lambda x: length(x) >= 2))), ',') AS ids FROM part")
def t2_identifiers(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat("p_brand", F.lit(" "), F.col("p_size").cast("string"), F.lit("/2025 3.2 "), "p_type")
    return fix.table(spark, d, "part").select("p_partkey", F.array_join(F.array_sort(fx.identifiers(text)), ",").alias("ids"))


@query("""SELECT l_orderkey, l_linenumber, (CASE WHEN l_linenumber % 2 = 0 THEN 3 ELSE 1 END) >= 2.8 AS template,
(CASE WHEN l_linenumber % 2 = 0 THEN 1 ELSE 3 END) >= 3 AND (CASE WHEN length(l_quantity::INT::VARCHAR) <= 2 THEN 3 ELSE 2 END) >= 2.4 AS refs FROM lineitem""")
def t11_row_kinds(spark: SparkSession, d: str) -> DataFrame:
    even = F.col("l_linenumber") % 2 == 0
    some = lambda c: F.when(even, F.lit("-")).otherwise(c)
    cells = F.array(F.when(even, F.lit(".")).otherwise(F.col("l_returnflag")), some(F.col("l_linestatus")), F.when(even, F.lit(" ")).otherwise(F.col("l_quantity").cast("int").cast("string")), F.when(even, F.lit("12345")).otherwise(F.lit("")))
    return fix.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", fx.template_row(cells).alias("template"), (fx.column_ref_row(cells) & ~even).alias("refs"))


_ROWS = "r AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS row_no, l_linenumber, l_partkey, l_returnflag FROM lineitem)"


@query(f"""WITH {_ROWS}, b AS (SELECT l_orderkey, row_no, unnest([0, 1, 2]) AS col_no, unnest([l_linenumber::VARCHAR, l_partkey::VARCHAR, l_returnflag]) AS text FROM r)
SELECT l_orderkey % 10 AS doc_id, l_orderkey AS page_num, 0 AS table_no, false AS is_header, row_no::INT AS row_no, col_no, text FROM b
UNION ALL SELECT DISTINCT l_orderkey % 10, l_orderkey, 0, true, 0, c.k, c.t FROM lineitem, (VALUES (0, 'line'), (1, 'part'), (2, 'flag')) AS c(k, t)""")
def t21_cells(spark: SparkSession, d: str) -> DataFrame:
    return tables.cells(fix.order_tables(spark, d))


@query(f"""WITH {_ROWS} SELECT l_orderkey AS page_num, '| line | part | flag |' || chr(10) || '| --- | --- | --- |' || string_agg(CASE WHEN l_linenumber > 9999999 THEN '' WHEN length(l_partkey::VARCHAR) <= 2 THEN '' ELSE chr(10) || '| ' || l_linenumber || ' | ' || l_partkey || ' | ' || l_returnflag || ' |' END, '' ORDER BY row_no) AS markdown FROM r GROUP BY 1""")
def t15_render(spark: SparkSession, d: str) -> DataFrame:
    return tables.markdowns(fix.order_tables(spark, d)).select("page_num", "markdown")


_SPLIT = """p AS (SELECT l_orderkey AS o, l_orderkey // 64 AS doc_id, (l_orderkey // 5) % 2 AS h, count(*) AS n FROM lineitem GROUP BY 1, 2, 3),
g AS (SELECT *, o - row_number() OVER (PARTITION BY doc_id, h ORDER BY o) AS run FROM p),
m AS (SELECT doc_id, min(o) AS page_num, max(o) AS last_page, count(*) AS n_pages, sum(n) AS n_rows, any_value(h) AS h FROM g GROUP BY doc_id, h, run)"""


@query(f"WITH {_SPLIT} SELECT doc_id, page_num, last_page, n_pages::INT AS n_pages, n_rows::INT AS n_rows, CASE WHEN h = 0 THEN 'flag' ELSE 'status' END AS last_header FROM m")
def m5_stitch(spark: SparkSession, d: str) -> DataFrame:
    merged = tables.stitched(tables.parsed(fix.split_tables(spark, d)))
    return merged.select("doc_id", "page_num", F.element_at("pages", -1).alias("last_page"), F.size("pages").alias("n_pages"), F.size("rows").alias("n_rows"), F.element_at("headers", -1).alias("last_header"))


@query(f"WITH {_SPLIT} SELECT doc_id, count(*) AS n_tables, sum((n_pages > 1)::INT)::BIGINT AS n_spans, string_agg(CASE WHEN n_pages > 1 THEN page_num || '-' || last_page || ':' || n_rows END, ' ' ORDER BY page_num) AS spans FROM m GROUP BY 1")
def m6_report(spark: SparkSession, d: str) -> DataFrame:
    told = tables.stitch_report(tables.stitched(tables.parsed(fix.split_tables(spark, d))))
    one = F.transform("spans", lambda x: F.concat(x["pages"][0].cast("string"), F.lit("-"), F.element_at(x["pages"], -1).cast("string"), F.lit(":"), x["n_rows"].cast("string")))
    return told.select("doc_id", "n_tables", "n_spans", F.when(F.size("spans") > 0, F.array_join(one, " ")).alias("spans"))


@query("SELECT n_regionkey AS page_num, (row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1)::INT AS row_no, r_name AS region, n_name AS nation, 'places > region|places > nation' AS headers FROM nation JOIN region ON n_regionkey = r_regionkey")
def t21_spans(spark: SparkSession, d: str) -> DataFrame:
    found = tables.parsed(fix.region_tables(spark, d)).select("page_num", F.array_join("headers", "|").alias("headers"), F.posexplode("rows").alias("row_no", "r"))
    return found.select("page_num", "row_no", F.col("r")[0].alias("region"), F.col("r")[1].alias("nation"), "headers")


@query("""SELECT p_partkey AS page_num, 'Columns: key, name, brand, type, col_5, size, price, col_5' || chr(10) || chr(10) || '**Row 1:**' || chr(10) || '- key: ' || p_partkey || chr(10) || '- name: ' || p_name || chr(10) || '- brand: ' || p_brand || chr(10) || '- type: ' || p_type
|| CASE WHEN p_partkey % 2 = 0 THEN chr(10) || '- col_5: x' ELSE '' END || chr(10) || '- size: ' || p_size || chr(10) || '- price: ' || floor(p_retailprice)::BIGINT || chr(10) || '- col_5: long note' AS markdown FROM part""")
def t16_wide(spark: SparkSession, d: str) -> DataFrame:
    return tables.markdowns(fix.wide_tables(spark, d)).select("page_num", "markdown")


@query(f"""WITH {_ROWS} SELECT l_orderkey AS page_num, 'before | line | part | flag |' || chr(10) || '| --- | --- | --- |' || string_agg(CASE WHEN length(l_partkey::VARCHAR) <= 2 THEN '' ELSE chr(10) || '| ' || l_linenumber || ' | ' || l_partkey || ' | ' || l_returnflag || ' |' END, '' ORDER BY row_no) || ' after' AS text FROM r GROUP BY 1""")
def t18_replaced(spark: SparkSession, d: str) -> DataFrame:
    return tables.replaced(fix.order_tables(spark, d)).select("page_num", "text")


_KIND = "['Table', 'Hình', 'BẢNG', 'Diagram', 'Biểu', 'sơ đồ'][p_partkey % 6 + 1]"
_MARK = "['(7)', '(**)', '[12]', '***'][p_partkey % 4 + 1]"


@query(f"SELECT p_partkey AS page_num, {_KIND} || ' ' || p_size || '.1' AS caption, p_name AS title, {_MARK} AS marker, 'see ' || p_name AS note FROM part")
def t6_elements(spark: SparkSession, d: str) -> DataFrame:
    captions, footnotes = normalise.elements(fix.tagged(spark, d))
    named = captions.select("page_num", F.concat("kind", F.lit(" "), "number").alias("caption"), "title")
    return named.join(footnotes.select("page_num", "marker", "note"), "page_num")


@query(f"""SELECT p_partkey AS page_num, (p_partkey % 3 = 0)::INT AS affected_cells, p_partkey % 3 = 0 AS has_ellipsis, p_partkey % 6 = 0 AS fallback_appended,
'Intro' || chr(10) || '<!-- CAPTION: ' || {_KIND} || ' ' || p_size || '.1 -->' || chr(10) || {_KIND} || ' ' || p_size || '.1 - ' || p_name || chr(10) || '<!-- FOOTNOTE: ' || {_MARK} || ' -->' || chr(10) || {_MARK} || ' see ' || p_name || chr(10) || '(1234) no note' || chr(10) || '|   |   |' || chr(10) || '| --- | --- |' || chr(10) || '| a | ' || CASE WHEN p_partkey % 3 = 0 THEN '...' ELSE 'b' END || ' |'
|| CASE WHEN p_partkey % 3 <> 0 THEN '' WHEN p_partkey % 2 = 0 THEN chr(10) || chr(10) || '<!-- 1 table cells were elided on page ' || p_partkey || '; its text layer follows. -->' || chr(10) || chr(10) || trim(repeat('layer ', 12)) || chr(10)
ELSE chr(10) || chr(10) || '<!-- 1 table cells were elided on page ' || p_partkey || '; it has no text layer. -->' || chr(10) END AS text FROM part""")
def t9_normalised(spark: SparkSession, d: str) -> DataFrame:
    return normalise.normalised(fix.tagged(spark, d)).drop("doc_id")


_CELLS = f"""{_ROWS}, c AS (SELECT l_orderkey AS doc_id, row_no, k, [l_linenumber::VARCHAR, l_partkey::VARCHAR, l_returnflag][k + 1] AS text FROM r, range(0, 3) AS x(k))"""


def _dom(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return dom.nodes(fix.order_tables(spark, d).select(F.col("page_num").alias("doc_id"), "text"), "text", columns)


@query(f"WITH {_CELLS} SELECT doc_id, 'Table > Row ' || (row_no + 2) || ' > Cell ' || (k + 1) AS breadcrumb, text FROM c")
def d3_breadcrumbs(spark: SparkSession, d: str) -> DataFrame:
    return dom.searchable(_dom(spark, d, "tag", "text", "breadcrumb")).filter("tag = 'td'").select("doc_id", "breadcrumb", "text")


@query(f"WITH {_CELLS}, t AS (SELECT doc_id, row_no, string_agg(text, ' ' ORDER BY k) AS subtree_text FROM c GROUP BY 1, 2) SELECT doc_id, 'tr' AS tag, subtree_text FROM t UNION ALL SELECT doc_id, 'table', 'line part flag ' || string_agg(subtree_text, ' ' ORDER BY row_no) FROM t GROUP BY 1 UNION ALL SELECT DISTINCT doc_id, 'tr', 'line part flag' FROM t")
def d4_subtree_texts(spark: SparkSession, d: str) -> DataFrame:
    return _dom(spark, d, "tag", "subtree_text").filter("tag in ('tr', 'table')").select("doc_id", "tag", "subtree_text")


@query(f"WITH {_CELLS} SELECT doc_id, row_no + 1 AS row_no, k::INT AS nth, k::INT AS n_before, (2 - k)::INT AS n_after FROM c")
def d5_siblings(spark: SparkSession, d: str) -> DataFrame:
    cells = dom.siblings(_dom(spark, d, "tag", "nth", "parent_nth", "preceding", "following"), 3).filter("tag = 'td'")
    return cells.select("doc_id", F.col("parent_nth").cast("long").alias("row_no"), "nth", F.size("preceding").alias("n_before"), F.size("following").alias("n_after"))


_ITEMS = "i AS (SELECT l_orderkey AS page, l_linenumber AS line, k, l_linenumber * 20 + (l_partkey + k) % 6 AS top, k * 100 + l_suppkey % 7 AS lft FROM lineitem, range(0, 4) AS c(k))"


@query(f"WITH {_ITEMS}, a AS (SELECT page, line, min(top) AS row_top FROM i GROUP BY 1, 2) SELECT page, row_top::DOUBLE AS row_top, k::BIGINT AS col_no, count(*) AS n FROM i JOIN a USING (page, line) GROUP BY 1, 2, 3")
def l1_layout(spark: SparkSession, d: str) -> DataFrame:
    return layout.cells(fix.items(spark, d))


@query(f"WITH {_ITEMS} SELECT page, k::BIGINT AS col_no, floor(avg(lft))::INT AS col_left FROM i GROUP BY 1, 2")
def l2_columns(spark: SparkSession, d: str) -> DataFrame:
    return layout.columns(fix.items(spark, d))


@query("SELECT DISTINCT l_orderkey AS page, true AS is_table FROM lineitem")
def l4_table_pages(spark: SparkSession, d: str) -> DataFrame:
    return layout.table_pages(fix.items(spark, d))


@query(f"""WITH {_ROWS}, x AS (SELECT l_orderkey AS page, l_linenumber AS n, [l_linenumber::VARCHAR, l_partkey::VARCHAR, l_suppkey::VARCHAR, l_returnflag][k + 1] AS text, k, k * 100 + l_suppkey % 7 AS lft FROM lineitem, range(0, 4) AS c(k)),
c AS (SELECT page, n, k, string_agg(text, ' ' ORDER BY lft, text) AS text FROM x GROUP BY 1, 2, 3),
t AS (SELECT page, n, '  <tr>' || chr(10) || string_agg('    <td>' || text || '</td>', chr(10) ORDER BY k) || chr(10) || '  </tr>' AS tr FROM c GROUP BY 1, 2)
SELECT page, 'table' AS page_type, '<section id="page-' || page || '" data-page="' || page || '" data-type="table">' || chr(10) || '<table>' || chr(10) || string_agg(tr, chr(10) ORDER BY n) || chr(10) || '</table>' || chr(10) || '</section>' AS html FROM t GROUP BY 1""")
def l7_page_html(spark: SparkSession, d: str) -> DataFrame:
    return layout.page_html(fix.items(spark, d).withColumns({"width": F.lit(10), "height": F.lit(12), "bold": F.lit(False)}))


@query(f"""WITH r AS (SELECT l_orderkey AS page, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS n, count(*) OVER (PARTITION BY l_orderkey) AS lines, l_partkey, l_returnflag FROM lineitem),
t AS (SELECT *, CASE WHEN n = 1 AND lines > 2 THEN 'h2' WHEN n <= 2 THEN CASE WHEN n = 1 AND lines <= 2 THEN 'h3' ELSE 'h3' END ELSE 'p' END AS tag, CASE WHEN n <= 2 THEN '<strong>' ELSE '' END AS a, CASE WHEN n <= 2 THEN '</strong>' ELSE '' END AS b FROM r)
SELECT page, string_agg('<' || tag || '>' || a || l_partkey || b || ' ' || a || l_returnflag || b || '</' || tag || '>', chr(10) ORDER BY n) AS html FROM t GROUP BY 1""")
def l6_text_html(spark: SparkSession, d: str) -> DataFrame:
    return layout.text_html(fix.styled(spark, d))


_HEADS = """h AS (SELECT n_regionkey AS doc_id, n_nationkey + 1 AS page_num, 0 AS line_no, 2 AS level, n_name AS title FROM nation
UNION ALL SELECT n_regionkey, n_nationkey + 1, 2 * row_number() OVER (PARTITION BY n_nationkey ORDER BY s_name) - 1, 3, s_name FROM supplier JOIN nation ON s_nationkey = n_nationkey),
o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page_num, line_no) AS ord FROM h)"""


@query(f"WITH {_HEADS} SELECT o.doc_id, o.ord::INT AS ord, o.level::INT AS level, o.title, (CASE WHEN o.level = 3 THEN p.ord ELSE 0 END)::INT AS parent FROM o JOIN o p ON o.doc_id = p.doc_id AND o.page_num = p.page_num AND p.level = 2")
def n2_nested(spark: SparkSession, d: str) -> DataFrame:
    return tree.nested(tree.headings(fix.headed(spark, d))).select("doc_id", "ord", "level", "title", F.coalesce("parent", F.lit(0)).alias("parent"))


def _totals(spark: SparkSession, d: str) -> DataFrame:
    return fix.table(spark, d, "nation").groupBy(F.col("n_regionkey").alias("doc_id")).agg((F.max("n_nationkey") + 1).alias("total_pages"))


_TOTALS = "t AS (SELECT n_regionkey AS doc_id, max(n_nationkey) + 1 AS total_pages FROM nation GROUP BY 1)"


@query(f"WITH {_HEADS}, {_TOTALS} SELECT doc_id, ord::INT AS ord, level::INT AS level, title, page_num AS page_start, greatest(page_num, coalesce(lead(page_num) OVER (PARTITION BY doc_id ORDER BY ord) - 1, total_pages))::INT AS page_end FROM o JOIN t USING (doc_id)")
def n3_page_ranges(spark: SparkSession, d: str) -> DataFrame:
    return tree.page_ranges(tree.headings(fix.headed(spark, d)), _totals(spark, d))


@query(f"WITH {_TOTALS} SELECT doc_id, round(count(*) / any_value(total_pages), 6) AS coverage, CASE WHEN count(*) / any_value(total_pages) >= 0.15 THEN 'headings' ELSE 'sections' END AS strategy FROM nation JOIN t ON n_regionkey = doc_id GROUP BY 1")
def a12_coverage(spark: SparkSession, d: str) -> DataFrame:
    return tree.coverage(tree.headings(fix.headed(spark, d)), _totals(spark, d))


@query(f"""WITH {_TOTALS}, b AS (SELECT doc_id, p FROM t, range(1, 1000) AS r(p) WHERE p <= total_pages AND NOT EXISTS (SELECT 1 FROM nation WHERE n_regionkey = doc_id AND n_nationkey + 1 = p)),
g AS (SELECT *, p - row_number() OVER (PARTITION BY doc_id ORDER BY p) AS run FROM b) SELECT doc_id, min(p)::INT AS page_start, max(p)::INT AS page_end FROM g GROUP BY doc_id, run""")
def n9_orphans(spark: SparkSession, d: str) -> DataFrame:
    return tree.orphan_ranges(tree.headings(fix.headed(spark, d)), _totals(spark, d))


@query(f"WITH {_HEADS} SELECT doc_id, lpad(ord::VARCHAR, 4, '0') AS node_id, title, level::INT AS level, page_num::BIGINT AS page_start, page_num::BIGINT AS page_end FROM o")
def n15_tree(spark: SparkSession, d: str) -> DataFrame:
    nodes = tree.build_tree(fix.headed(spark, d), _totals(spark, d))
    return nodes.select("doc_id", "node_id", "title", "level", "page_start", "page_end")


@query(f"WITH {_HEADS} SELECT doc_id, string_agg(CASE WHEN level = 3 THEN '  ' ELSE '' END || '- [' || lpad(ord::VARCHAR, 4, '0') || '] ' || title || ' (p.' || page_num || ')', chr(10) ORDER BY ord) AS outline FROM o GROUP BY 1")
def t31_outline(spark: SparkSession, d: str) -> DataFrame:
    return tree.outline(tree.build_tree(fix.headed(spark, d), _totals(spark, d)))


_SPARSE = """p AS (SELECT p_partkey % 3 AS doc_id, p_partkey // 3 + 1 AS page, p_partkey AS k, p_name || ' of page' AS body, (p_partkey // 3 + 1) % 20 = 3 AS head FROM part),
t AS (SELECT doc_id, max(page) AS total FROM p GROUP BY 1),
s AS (SELECT doc_id, page, 'Part ' || k AS title, lead(page) OVER (PARTITION BY doc_id ORDER BY page) AS following FROM p WHERE head),
w AS (SELECT s.doc_id, page, title, coalesce(following - 1, total) AS last FROM s JOIN t USING (doc_id))"""


@query(f"""WITH {_SPARSE} SELECT doc_id, title, 1 AS level, page AS page_start, last AS page_end FROM w
UNION ALL SELECT w.doc_id, CASE WHEN p.head THEN 'Part ' || k ELSE body END, 2, p.page, p.page FROM w JOIN p ON p.doc_id = w.doc_id AND p.page BETWEEN w.page AND w.last WHERE w.last > w.page
UNION ALL SELECT doc_id, 'Preamble', 1, 1, min(page) - 1 FROM s GROUP BY 1 HAVING min(page) > 1""")
def n3_sections(spark: SparkSession, d: str) -> DataFrame:
    pages = fix.sparse(spark, d).withColumn("page_num", F.col("page_num").cast("long"))
    totals = pages.groupBy("doc_id").agg(F.max("page_num").cast("int").alias("total_pages"))
    found = tree.sections_text(pages, remove_running=False)
    return tree.section_tree(found, pages, totals).select("doc_id", "title", F.col("level").cast("int").alias("level"), "page_start", "page_end")


@query("SELECT p_partkey % 3 AS doc_id, p_partkey // 3 + 1 AS page_start, (row_number() OVER (PARTITION BY p_partkey % 3 ORDER BY p_partkey))::INT AS ord, CASE WHEN (p_partkey // 3 + 1) % 20 = 3 THEN 'Part ' || p_partkey ELSE p_name || ' of page' END AS title FROM part")
def n5_pages(spark: SparkSession, d: str) -> DataFrame:
    pages = fix.sparse(spark, d).withColumn("page_num", F.col("page_num").cast("long"))
    return tree.page_tree(tree.sections_text(pages, remove_running=False).filter("false"), pages).select("doc_id", "page_start", "ord", "title")


_NODES = "n AS (SELECT p_partkey AS ord, p_brand || ' ' || p_name AS title, p_partkey * 2 AS a, p_partkey * 2 + p_partkey % 3 AS b FROM part)"


@query(f"""WITH {_NODES}, q AS (SELECT DISTINCT p_size AS query_id FROM part), h AS (SELECT query_id, unnest(range(a, b + 1)) AS page_num, 25.0::DOUBLE / sqrt((b - a + 1)::DOUBLE) AS s FROM n JOIN q ON contains(title, query_id::VARCHAR) AND query_id >= 10),
g AS (SELECT query_id, page_num, round(max(s), 6) AS score FROM h GROUP BY 1, 2)
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, page_num) AS pos FROM g QUALIFY pos <= 60""")
def c3_identifiers(spark: SparkSession, d: str) -> DataFrame:
    asked = fix.table(spark, d, "part").select(F.col("p_size").alias("query_id")).distinct().withColumn("query", F.concat(F.lit("What is no. "), F.col("query_id").cast("string"), F.lit("?")))
    return channels.identifier_boost(fix.part_nodes(spark, d), asked).select("query_id", "page_num", "score", "pos")


@query(f"""WITH {_NODES}, p AS (SELECT p_size AS query_id, p_partkey AS ord, row_number() OVER (PARTITION BY p_size ORDER BY p_partkey) - 1 AS nth FROM part),
h AS (SELECT query_id, nth, unnest(range(a, b + 1)) AS page_num FROM p JOIN n USING (ord)), g AS (SELECT query_id, page_num, min(nth) AS nth FROM h GROUP BY 1, 2)
SELECT query_id, page_num, 20.0::DOUBLE AS score, row_number() OVER (PARTITION BY query_id ORDER BY nth, page_num) AS pos FROM g QUALIFY pos <= 60""")
def c5_picked_nodes(spark: SparkSession, d: str) -> DataFrame:
    ids = F.transform(F.array_sort(F.collect_list("p_partkey")), lambda k: F.lpad(k.cast("string"), 9, "0"))
    replies = fix.table(spark, d, "part").groupBy(F.col("p_size").alias("query_id")).agg(F.concat(F.lit("These: "), F.to_json(ids)).alias("reply")).withColumn("doc_id", F.lit("d"))
    return channels.llm_tree_nav(replies, fix.part_nodes(spark, d)).select("query_id", "page_num", "score", "pos")


_EXPANDED = f"""{_INDEX}, e AS (SELECT query_id, doc_id, page_num, sum(s) AS score FROM (SELECT query_id, doc_id, page_num, 2.0 * score AS s FROM (SELECT * FROM bx WHERE score > 0 {_TOP.format(15)}) UNION ALL SELECT query_id, doc_id, page_num, 0.4 * score FROM (SELECT * FROM bx WHERE score > 0 {_TOP.format(8)})) GROUP BY 1, 2, 3)"""


@query(f"WITH {_EXPANDED} SELECT query_id, doc_id, page_num, round(score, 6) AS score FROM e {_TOP.format(60)}")
def c1_multiquery(spark: SparkSession, d: str) -> DataFrame:
    queries = fix.queries(spark, d)
    replies = queries.select("query_id", F.concat(F.lit('1. "'), F.regexp_replace("query", r"\s+", " "), F.lit('"')).alias("reply"))
    return channels.bmx_multiquery(lexical.Pages(fix.pages(spark, d)), queries, replies).select("query_id", "doc_id", "page_num", "score")


@query("SELECT n_regionkey AS doc_id, lower(n_name) AS key, string_agg('home of ' || s_name, '' ORDER BY s_suppkey)[1:0] || min_by('home of ' || s_name, (-length(s_name), s_suppkey)) AS description, count(*)::INT AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1, 2 UNION ALL SELECT n_regionkey, lower(s_name), 'a supplier', count(*)::INT FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1, 2")
def a13_entities(spark: SparkSession, d: str) -> DataFrame:
    found, _ = graph.parse_lines(fix.replies(spark, d))
    return graph.merge_entities(found).select("doc_id", "key", "description", F.size("source_node_ids").alias("n"))


@query("SELECT n_regionkey AS doc_id, least(lower(s_name), lower(n_name)) AS low, greatest(lower(s_name), lower(n_name)) AS high, s_name AS source, n_name AS target, 'part_of' AS keywords FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def a14_relations(spark: SparkSession, d: str) -> DataFrame:
    _, found = graph.parse_lines(fix.replies(spark, d))
    return graph.merge_relations(found).select("doc_id", "low", "high", "source", "target", "keywords")


_EDGES = """e AS (SELECT n_name AS src, r_name AS dst FROM nation JOIN region ON n_regionkey = r_regionkey UNION SELECT s_name, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey),
b AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e)"""


@query(f"""WITH RECURSIVE {_EDGES}, w AS (SELECT r_name AS seed, r_name AS node, 0 AS distance FROM region UNION SELECT seed, dst, distance + 1 FROM w JOIN b ON node = src WHERE distance < 2)
SELECT seed, node, min(distance)::INT AS distance FROM w GROUP BY 1, 2 HAVING min(distance) > 0""")
def g8_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return graph.neighbours(fix.edges(spark, d), fix.table(spark, d, "region").select(F.col("r_name").alias("node")))


@query(f"""WITH RECURSIVE {_EDGES}, w AS (SELECT n_name AS src, [n_name] AS path FROM nation UNION ALL SELECT w.src, list_append(path, b.dst) FROM w JOIN b ON path[-1] = b.src WHERE len(path) < 4 AND NOT list_contains(path, b.dst) AND NOT (len(path) > 1 AND path[-1] IN (SELECT r_name FROM region)))
SELECT src, path[-1] AS dst, array_to_string(path, '>') AS path FROM w WHERE len(path) > 1 AND path[-1] IN (SELECT r_name FROM region)""")
def g9_paths(spark: SparkSession, d: str) -> DataFrame:
    pairs = fix.table(spark, d, "nation").select(F.col("n_name").alias("src")).crossJoin(fix.table(spark, d, "region").select(F.col("r_name").alias("dst")))
    return graph.simple_paths(fix.edges(spark, d), pairs).select("src", "dst", F.array_join("path", ">").alias("path"))


def _merged(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    entities, relations = graph.parse_lines(fix.replies(spark, d))
    return graph.merge_entities(entities), graph.merge_relations(relations)


@query("""WITH j AS (SELECT n_regionkey AS doc_id, lower(n_name) AS n, lower(s_name) AS s FROM supplier JOIN nation ON s_nationkey = n_nationkey), q AS (SELECT DISTINCT doc_id, n FROM j),
w AS (SELECT q.n AS query_id, j.doc_id, j.s AS entity, 'Organization' AS entity_type, 'part_of' AS edge_keywords, 1 AS distance, q.n AS via FROM q JOIN j USING (doc_id, n))
SELECT *, row_number() OVER (PARTITION BY query_id, doc_id ORDER BY distance, entity)::INT AS place FROM w QUALIFY place <= 30""")
def g8_annotated(spark: SparkSession, d: str) -> DataFrame:
    entities, relations = _merged(spark, d)
    names = entities.filter("entity_type = 'Place'").select(F.col("key").alias("query_id"), "doc_id", F.upper("key").alias("name"))
    return graph.annotated_neighbours(entities, relations, names).drop("edge_description")


@query("""WITH e AS (SELECT DISTINCT n_regionkey AS doc_id, lower(s_name) AS key FROM supplier JOIN nation ON s_nationkey = n_nationkey UNION SELECT DISTINCT n_regionkey, lower(n_name) FROM supplier JOIN nation ON s_nationkey = n_nationkey)
SELECT key AS query_id, doc_id, key FROM e""")
def g6_fuzzy(spark: SparkSession, d: str) -> DataFrame:
    entities, _ = _merged(spark, d)
    return graph.fuzzy_match(entities, entities.select(F.col("key").alias("query_id"), "doc_id", F.concat(F.lit(" "), F.upper("key"), F.lit(" ")).alias("name")))


@query("""WITH j AS (SELECT n_regionkey AS doc_id, lower(n_name) AS n, lpad(s_suppkey::VARCHAR, 9, '0') AS node_id FROM supplier JOIN nation ON s_nationkey = n_nationkey), s AS (SELECT doc_id, n, min(node_id) AS node_id FROM j GROUP BY 1, 2)
SELECT s.node_id AS query_id, j.doc_id, j.node_id, 1 AS distance FROM s JOIN j USING (doc_id, n)""")
def g5_expand(spark: SparkSession, d: str) -> DataFrame:
    entities, relations = _merged(spark, d)
    seeds = entities.filter("entity_type = 'Place'").select(F.col("source_node_ids")[0].alias("query_id"), "doc_id", F.col("source_node_ids")[0].alias("node_id"))
    found = graph.expand(entities, relations, seeds, 1)
    return found.select("query_id", "doc_id", "node_id", "distance")


@query("""WITH e AS (SELECT DISTINCT n_regionkey AS doc_id, lower(n_name) AS key FROM nation)
SELECT doc_id, key, key AS canonical FROM e UNION ALL SELECT doc_id, key || ' inc', key FROM e UNION ALL SELECT doc_id, key || '  corp.', key FROM e""")
def g2_resolved(spark: SparkSession, d: str) -> DataFrame:
    names = fix.table(spark, d, "nation").select(F.col("n_regionkey").alias("doc_id"), F.explode(F.array(F.lower("n_name"), F.concat(F.lower("n_name"), F.lit(" inc")), F.concat(F.lower("n_name"), F.lit("  corp.")))).alias("key"))
    return graph.resolved(names, distance=0)


@query("""SELECT c_custkey AS query_id, lower(n_name) AS key FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def g7_entities(spark: SparkSession, d: str) -> DataFrame:
    nation = fix.table(spark, d, "nation").select("n_nationkey", F.col("n_regionkey").alias("doc_id"), F.lower("n_name").alias("key"), F.lit("Place").alias("entity_type"), F.lit("").alias("description"), F.length("n_name").alias("n"))
    asked = fix.table(spark, d, "customer").join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("query_id"), "doc_id", F.concat(F.lit("about "), "key", F.lit(" and more")).alias("query"), F.col("key").alias("own"))
    found = graph.find_entities(nation.select("doc_id", "key", "entity_type", "description"), asked).join(asked.select("query_id", "own"), "query_id")
    return found.filter("length(key) = length(own)").select("query_id", "key")


@query("SELECT c_custkey AS query_id, n_regionkey AS doc_id, lower(n_name) AS key FROM customer JOIN nation ON c_nationkey = n_nationkey")
def g4_seeds(spark: SparkSession, d: str) -> DataFrame:
    nation = fix.table(spark, d, "nation")
    asked = fix.table(spark, d, "customer").join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("query_id"), F.concat(F.lit("Where is "), "n_name", F.lit("?")).alias("query"))
    return graph.seeds_in_query(nation.select(F.col("n_regionkey").alias("doc_id"), fx.entity_key(F.col("n_name")).alias("key")), asked, whole_words=True)
