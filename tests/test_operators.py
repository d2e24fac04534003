"""Small cases of the operators that the driver's tables don't show."""

from foliant.functions import text as fx
from foliant.operators import corpus, graph, hits, layout, lexical, tables, tree
from pyspark.sql import functions as F


def test_spans_are_copied():
    html = '<table><tr><th colspan="2">h</th></tr><tr><td rowspan="2">a</td><td>b</td></tr><tr><td>c<br>d</td></tr></table>'
    assert tables.parse(html) == [(True, {0: "h", 1: "h"}), (False, {0: "a", 1: "b"}), (False, {0: "a", 1: "c d"})]
    assert tables.parse("<table></table>") == []


def test_blocks_do_not_overlap():
    text = "x<table>1<table>2</table>y<TABLE>3"
    assert [text[a:b] for a, b in tables.blocks(text)] == ["<table>1", "<table>2</table>", "<TABLE>3"]


def test_headers_and_wide_tables(spark):
    wide = "<table><thead><tr>" + "".join(f"<th>C{k}</th>" for k in range(9)) + "<th></th></tr></thead><tbody><tr>" + "<td>val</td>" * 10 + "</tr></tbody></table>"
    levels = '<table><tr><th colspan="2">A</th></tr><tr><th>A</th><th>B</th></tr><tr><td>...</td><td>2</td></tr></table>'
    pages = spark.createDataFrame([("d", 1, wide), ("d", 2, levels), ("d", 3, None)], "doc_id string, page_num int, text string")
    found = {r.page_num: r for r in tables.rendered(tables.tables(tables.cells(pages))).collect()}
    assert found[1].n_cols == 10 and "**Row 1:**" in found[1].markdown and "- col_10: val" in found[1].markdown
    assert found[2].headers == ["A", "A > B"] and found[2].rows == [["...", "2"]]


def test_budget_and_rrf(spark):
    kinds = "query_id int, doc_id string, page_num int, channel string, score double, pos int, text string"
    three = spark.createDataFrame([(1, "d", k, "x", 1.0, k, "a" * 1000) for k in (1, 2, 3)], kinds)
    assert [r.page_num for r in hits.within_budget(three, 1500).collect()] == [1]
    fused = spark.createDataFrame([(1, "d", p, c, 1.0, k, "") for k, (p, c) in enumerate([(1, "x"), (2, "x"), (1, "y"), (3, "y")])], kinds)
    assert hits.rrf(fused, k=1, top_k=3).orderBy("place").first().page_num == 1
    assert hits.rrf(fused.filter("false")).count() == 0


def test_neighbours_exist(spark):
    pages = spark.createDataFrame([("d", k) for k in range(1, 7)], "doc_id string, page_num int")
    ranked = spark.createDataFrame([(1, "d", 5), (1, "d", 6)], "query_id int, doc_id string, page_num int")
    assert [r.page_num for r in hits.neighbours(ranked, pages, 1).collect()] == [4]


def test_bm25_small(spark):
    pages = spark.createDataFrame([("d", 1, "alpha beta gamma"), ("d", 2, "gamma delta epsilon"), ("d", 3, "zeta eta theta"), ("d", 4, None)], "doc_id string, page_num int, text string")
    asked = spark.createDataFrame([(1, "gamma"), (2, ""), (3, None)], "query_id int, query string")
    assert {(r.query_id, r.page_num) for r in lexical.bm25(pages, asked).collect()} == {(1, 1), (1, 2)}
    assert {r.page_num for r in lexical.bmx(pages, asked).collect()} == {1, 2}


def test_running_headers_and_nesting(spark):
    text = "# A\n## B\n### C\n## D\n# E"
    pages = spark.createDataFrame([("d", k, text) for k in (1, 2)], "doc_id string, page_num int, text string")
    found = tree.headings(pages)
    parents = [r.parent for r in tree.nested(found).orderBy("ord").collect()]
    assert parents == [None, 1, 2, 1, None, None, 6, 7, 6, None]
    assert tree.running_headers(found).count() == 0
    assert tree.running_headers(found, share=0.2).count() == 5
    assert tree.distinct_titles(found).filter("label like '% — p.%'").count() == 10


def test_cross_references(spark):
    nodes = spark.createDataFrame([("d", "1", "General rules", "see Special provisions below"), ("d", "2", "Special provisions", "under the general rules"), ("d", "3", "Short", "")], "doc_id string, node_id string, title string, text string")
    assert [(r.src, r.dst) for r in graph.cross_references(nodes).collect()] == [("1", "2")]


def test_seeds_anywhere_in_the_query(spark):
    names = ["land", "regulation", "東京都", "+++", "new york", "ab", "norway"]
    asked = ["Is Finland bound by EU Regulations?", "昨日東京都に行きました", "what is +++ in New  York", "to New York", "ab", None, ""]
    entities = spark.createDataFrame([("d", n) for n in names], "doc_id string, key string")
    queries = spark.createDataFrame(list(enumerate(asked)), "query_id int, query string")
    want = {(k, n) for k, q in enumerate(asked) for n in names if q and len(n) >= 3 and n in q.lower()}
    got = [(r.query_id, r.key) for r in graph.seeds_in_query(entities, queries).collect()]
    assert set(got) == want and len(got) == len(want) == 5
    whole = graph.seeds_in_query(entities, queries, whole_words=True)
    assert {(r.query_id, r.key) for r in whole.collect()} == {(2, "+++"), (3, "new york")}


def test_cross_references_within_words(spark):
    nodes = spark.createDataFrame([("d", "1", "x", "the SUBREGULATIONS of it"), ("d", "2", "Regulation", None), ("d", "3", "東京都条例第一条の二", "規定"), ("d", "4", "y", "昨日東京都条例第一条の二に"), ("e", "5", "z", "regulation")], "doc_id string, node_id string, title string, text string")
    assert sorted((r.src, r.dst) for r in graph.cross_references(nodes).collect()) == [("1", "2"), ("4", "3")]


def test_text_functions(spark):
    row = spark.range(1).select(
        fx.page_of_chunk(F.lit("page_12")).alias("a"), fx.page_of_chunk(F.lit("row_1")).alias("b"), fx.json_list(F.lit('so ["x","y"] ["z"]')).alias("c"), fx.json_list(F.lit("no")).alias("d"),
        fx.expansions(F.lit('1. "first variant"\n\nab\n- second one')).alias("e"), fx.entity_key(F.lit("  New \t York ")).alias("f"),
        fx.page_title(F.array(F.lit("ab")), F.lit("x\n## Long line"), F.lit(3)).alias("g"), fx.tag_captions(F.lit("Figure 1.2: It")).alias("h"), fx.with_ellipsis_note(F.lit("<td>...</td>"), F.lit("short")).alias("i"),
    ).first()
    assert (row.a, row.b, row.c, row.d, row.e, row.f, row.g) == (12, None, ["x", "y"], [], ["first variant", "second one"], "new york", "Long line")
    assert row.h == "<!-- CAPTION: Figure 1.2 -->\nFigure 1.2: It" and row.i.endswith("1 table cells were elided.")


def test_pages_merge_and_export(spark):
    kinds = "doc_id string, page_num int, text string"
    merged = corpus.merged_pages(spark.createDataFrame([("d", 1, ""), ("d", 2, "own")], kinds), spark.createDataFrame([("d", 1, "ocr"), ("d", 2, "ocr"), ("d", 3, "new")], kinds))
    assert [r.text for r in merged.orderBy("page_num").collect()] == ["ocr", "own", "new"]
    assert '"total_pages":3' in corpus.exported(merged).first().json


def test_tables_are_replaced_without_a_shuffle(spark):
    """Pages, equal numbers too, keep their columns; tables are rendered beside their text."""
    html = "a<table><tr><th>h</th><th></th></tr><tr><td>val</td><td>...</td></tr></table>b<table></table>c<TABLE><tr><td colspan='2'>x &amp; y</td></tr></TABLE>"
    pages = spark.createDataFrame([("d", 1, html, 7), ("d", 1, "none", 8), ("d", 2, None, 9)], "doc_id string, page_num int, text string, more int")
    made = tables.replaced(pages)
    assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
    got = {r.more: r.text for r in made.collect()}
    assert got == {7: "a| h |   |\n| --- | --- |\n| val | ... |b<table></table>c|   |   |\n| --- | --- |\n| x & y | x & y |", 8: "none", 9: None}


def test_plain_html_needs_no_parser():
    """plain HTML gives what the parser gives."""
    for html in ("x<table><thead><tr><TH>a</th></tr><tbody><tr><td> b<br>c </td><td></td></table>", "<table><tr><td>1<td>2</tr><tr><td>3 > 2</td></tr>", "<table>", "<table><tr><td>a < b</td></tr></table>", "<table><tr><td>a&lt;b</td><td colspan=2>c</td></tr></table>"):
        grid = tables._Grid()
        grid.feed(html)
        grid.close()
        grid._end_row()
        assert tables.parse(html) == grid.rows


def test_rendering_by_row_or_by_expression(spark):
    """the same markdown either way, of fillers, references to columns, blank headers, wide tables."""
    cells = ["", ".", "a", "12", "123", "word", " x "]
    body = ["<tr>" + "".join(f"<td>{cells[(k * j + j) % 7]}</td>" for j in range(n)) + "</tr>" for n in (2, 4, 8) for k in range(7)]
    pages = spark.createDataFrame([("d", n, f"<table><tr><th></th><th>h</th></tr>{''.join(body[7 * n : 7 * n + 7])}</table>") for n in range(3)] + [("d", 9, "<table></table>")], "doc_id string, page_num int, text string")
    want = tables.rendered(tables.parsed(pages)).select("page_num", "table_no", "markdown")
    assert sorted(map(tuple, tables.markdowns(pages).select("page_num", "table_no", "markdown").collect())) == sorted(map(tuple, want.collect()))


def test_tables_are_stitched_in_one_shuffle(spark):
    """tables are parsed once and moved once, by document."""
    html = "<table><tr><th>h</th></tr><tr><td>val</td></tr></table>"
    pages = spark.createDataFrame([("d", 1, html), ("d", 2, html), ("d", 4, html), ("e", 5, html)], "doc_id string, page_num int, text string")
    made = tables.stitched(tables.parsed(pages))
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("MapInArrow") == 1
    assert sorted((r.doc_id, r.pages, r.n_rows) for r in made.collect()) == [("d", [1, 2], 2), ("d", [4], 1), ("e", [5], 1)]


def test_layout_moves_items_once(spark):
    """items meet by page in one shuffle, or none where they are together already."""
    kinds = "page int, top int, left int, width int, height int, text string, bold boolean"
    items = spark.createDataFrame([(1, 0, 0, 1, 12, "a", True)], kinds)
    for make in (layout.columns, layout.table_pages, layout.text_html, layout.table_html, layout.page_html, layout.cells, layout.placed):
        for given, times in ((items, 1), (items.repartition("page"), 1)):
            assert make(given)._jdf.queryExecution().executedPlan().toString().count("Exchange") == times


def test_layout_by_definition(spark):
    """chains of tops, rows that go on, items without a place."""
    kinds = "page string, top int, left int, width int, height int, text string, bold boolean"
    at = lambda page, top, left, text, height=12, bold=False: (page, top, left, 10, height, text, bold)
    grid = [at("t", 20 * r + k % 2, 100 * k, f"{r}{k}", bold=k == 0) for r in range(3) for k in range(4)]
    more = [at("t", 60, 205, "on"), at("t", 60, 100, None), at("t", None, 0, "lost")]
    chain = [at("c", top, 0, str(top)) for top in (0, 4, 8, 12, 16)] + [at("c", None, 31, "z"), at("c", 40, None, "b", 20, True), at(None, 1, 1, "x")]
    items = spark.createDataFrame(grid + more + chain, kinds)
    assert sorted((r.top, r.row_top) for r in layout.rows(items.filter("page = 'c' and top is not null")).collect()) == [(0, 0), (4, 0), (8, 8), (12, 8), (16, 16), (40, 40)]
    got = {(r.page, r.col_no): r.col_left for r in layout.columns(items).collect()}
    assert got == {("t", k): (0, 100, 201, 300)[k] for k in range(4)} | {("c", 0): None, ("c", 1): 0, ("c", 2): 31, (None, 0): 1}
    assert {r.col_no for r in layout.placed(items.filter("page = 'c'")).collect()} == {0}
    pages = {r.page: r for r in layout.page_html(items).collect()}
    assert set(pages) == {"t", "c"} and (pages["t"].page_type, pages["c"].page_type) == ("table", "text")
    cells = [[f"<b>{r}0</b>", f"{r}1", f"{r}2" + " on" * (r == 2), f"{r}3"] for r in range(3)]
    rows = ["  <tr>\n" + "\n".join(f"    <{t}>{c}</{t}>" for t, c in zip(("th", "td", "td", "td"), row)) + "\n  </tr>" for row in cells]
    assert pages["t"].html == '<section id="page-t" data-page="t" data-type="table">\n<table>\n' + "\n".join(rows) + "\n</table>\n</section>"
    assert pages["c"].html.split("\n")[1:-1] == ["<p>z</p>", "<p>0 4</p>", "<p>12 8</p>", "<p>16</p>", "<h2><strong>b</strong></h2>"]


def test_layout_takes_whole_pages(monkeypatch):
    """pages that batches cut are put together, whatever is held at a time."""
    import pyarrow as pa

    sizes = [1, 5, 2, 9, 1, 1, 3]
    whole = pa.table({"page": [p for p, n in enumerate(sizes) for _ in range(n)], "_nth": pa.array([k + 1 for n in sizes for k in range(n)], pa.int32())})
    for most in (1, 4, 100):
        monkeypatch.setattr(layout, "_ITEMS", most)
        for step in (1, 2, 3, 7, 22):
            got = list(layout._whole(iter(whole.to_batches(max_chunksize=step))))
            assert [p for t, _ in got for p in t["page"].to_pylist()] == whole["page"].to_pylist()
            assert [t["page"].to_pylist()[k] for t, begins in got for k in begins] == list(range(7))
            assert all(t.num_rows and begins[0] == 0 for t, begins in got) and (most == 100 or len(got) > 1 or step == 22)
    assert list(layout._whole(iter([]))) == []
