"""Sources, façade, and operators that no query of the driver's tables shows."""

import json
import re

import pytest
from foliant import facade, sources, streaming
from foliant.functions import text as fx
from foliant.operators import answer, channels, dom, graph, hits, layout, lexical, tree
from pyspark.sql import functions as F

PAGE = "doc_id string, page_num long, text string"


def test_registry_config_and_events(tmp_path):
    registry = facade.Registry()
    made = registry.register("ranker", "mine")(type("Mine", (), {}))
    assert registry.get("ranker", "mine") is made and registry.names("ranker") == ["mine"]
    with pytest.raises(KeyError):
        registry.get("ranker", "other")
    with pytest.raises(ValueError):
        registry.get("layer", "mine")
    registry.clear()
    assert registry.names("ranker") == []
    assert {"page_bm25", "tree_index", "entity_graph"} <= set(facade.REGISTRY.names("indexer"))
    assert facade.REGISTRY.names("channel") == ["bmx_multiquery", "entity_2hop", "identifier_boost", "llm_tree_nav", "tree_bm25"]
    (tmp_path / "c.yaml").write_text("pipeline:\n  parse: [a, b]\n  rank: {type: rrf, config: {k: 1}}\n  router: flat\nglobals: {ranker: {top_k: 3}}\n")
    config = facade.Config.read(str(tmp_path / "c.yaml"))
    assert [s.type for s in config.stages["parser"]] == ["a", "b"] and config.stages["ranker"][0].options == {"k": 1} and config.router.type == "flat"
    with pytest.raises(ValueError):
        facade.Stage.of({"k": 1})
    with pytest.raises(TypeError):
        facade.Stage.of(3)
    events, seen = facade.Events(), []
    events.on(lambda e: 1 / 0)
    stop = events.on(lambda e: seen.append(e.summary))
    events.emit({"type": "log", "summary": "hello"})
    stop()
    events.emit({"type": "log", "summary": "again"})
    assert seen == ["hello"]
    tries = []
    assert facade.with_retry(lambda: tries.append(1) or (1 / 0 if len(tries) < 3 else "done"), sleep=lambda s: None) == "done"
    with pytest.raises(RuntimeError):
        facade.Pipeline().load(None)


def test_pipeline_from_pages_to_answers(spark, tmp_path):
    text = lambda k: f"## Chapter {k} about rule 9{k}\n" + " ".join("says" if n == 7 else f"{'abcdefgh'[(n * k) % 8] * (k + n % 3)}{n}" for n in range(40))
    pages = spark.createDataFrame([("d", k, text(k)) for k in range(1, 5)], PAGE)
    queries = spark.createDataFrame([(1, "what says rule 92")], "query_id int, query string")
    pipe = facade.Pipeline.of({"parse": "table_normalizer", "index": [{"type": "page_bm25", "base": f"{tmp_path}/index"}, "tree_index"], "retrieve": {"type": "hybrid_chatbot", "channels": ["bmx_multiquery", "identifier_boost"]}, "rank": {"type": "weighted_merge", "top_k": 2}, "synthesize": "chatbot_llm"})
    pipe.load(pages)
    assert pipe.state.made["sections"].count() == 4
    found = pipe.hits(queries).orderBy("pos").collect()
    assert found[0].page_num == 2 and found[0].text.startswith("## Chapter 2") and len(found) == 2
    pipe.synthesizers[0].client = lambda prompt: "It says " + prompt.split("Question: ")[1].split("\n")[0]
    row = pipe.query(queries).first()
    assert row.answer == "It says what says rule 92" and row.citations[0].page_num == 2
    pipe.synthesizers[0].client = None
    assert pipe.query(queries).first().answer == answer.NO_CLIENT
    assert [d["metadata"]["page_num"] for d in facade.as_documents(pipe.hits(queries))][0] == 2


def test_sources(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"first page with more than fifty signs of text in it, surely\x0cshort")
    found = sources.files(spark, f"{tmp_path}/a.bin")
    pages = sources.text_layers(found, lambda b: b.decode().split("\x0c"))
    assert [(r.page_num, r.page_type, r.total_pages) for r in pages.orderBy("page_num").collect()] == [(1, "text", 2), (2, "scan", 2)]
    read = sources.read_by_ocr(pages, found, lambda b, numbers: {n: f"read {n}" for n in numbers if n == 2}, below=50).orderBy("page_num").collect()
    assert [(r.text[:6], r.ocr_done) for r in read] == [("first ", False), ("read 2", True)]
    assert {r.skipped for r in sources.read_by_ocr(pages, found, None).collect()} == {"ocr_unavailable"}
    (tmp_path / "c.json").write_text(json.dumps({"1": "one", "12": "twelve"}))
    assert sorted((r.page_num, r.text) for r in sources.ocr_cache(spark, f"{tmp_path}/c.json").collect()) == [(1, "one"), (12, "twelve")]
    sources.save(f"{tmp_path}/tree", nodes=pages.select("doc_id", "page_num"))
    assert sources.load(spark, f"{tmp_path}/tree", "nodes")["nodes"].count() == 2
    assert [d["page_content"] for d in sources.framework_documents(pages.select("doc_id", "page_num", "text").filter("page_num = 2"))] == ["short"]
    xml = "<pdf2xml><page number='1' width='9' height='9'><text top='10' left='5' width='3' height='20'><b>Head</b></text><text top='40' left='5' width='3'>plain</text></page></pdf2xml>"
    items = layout.text_items(spark.createDataFrame([("d", xml)], "doc_id string, xml string")).orderBy("top").collect()
    assert [(r.top, r.height, r.text, r.bold) for r in items] == [(10, 20, "Head", True), (40, 12, "plain", False)]


def test_dom_of_untidy_html(spark):
    html = '<section data-page="3" data-type="text"><h2>Head</h2><p>one<p>two</p><figure><img src="x.png"></figure></section>'
    found = dom.nodes(spark.createDataFrame([("d", html), ("e", None)], "doc_id string, html string"))
    rows = {(r.doc_id, r.node_id): r for r in found.collect()}
    assert rows["e", 0].tag == "document" and [rows["d", k].tag for k in range(6)] == ["document", "page", "h2", "p", "p", "figure"]
    assert rows["d", 4].parent_id == 3 and rows["d", 5].text == "[img: x.png]" and rows["d", 4].page_num == 3
    crumbs = {r.node_id: r.breadcrumb for r in dom.breadcrumbs(found.filter("doc_id = 'd'")).collect()}
    assert crumbs[2] == "Page 3 > Heading: Head" and crumbs[4] == "Page 3 > Paragraph > Paragraph"
    assert {r.node_id: r.subtree_text for r in dom.subtree_texts(found.filter("doc_id = 'd'")).collect()}[3] == "one two [img: x.png]"  # what isn't closed goes on


def test_tree_parts(spark):
    sizes = spark.range(1).select(tree.page_spans(F.array(F.lit(10), F.lit(30), F.lit(10)), F.lit(1).cast("long"), F.lit(5).cast("long")).alias("s")).first().s
    assert [(x.start, x.end) for x in sizes] == [(1, 1), (2, 4), (5, 5)]
    row = spark.range(1).select(tree.packed(F.lit("a b\n\nc d e\n\nf"), 3).alias("p"), tree.heading_parts(F.lit("T"), F.lit("pre\n# A\nx\n## B\ny")).alias("h"), tree.title_parts(F.array(F.lit("Beta"), F.lit("Alpha")), F.lit("alpha one beta two"), F.lit("T")).alias("t")).first()
    assert row.p == ["a b", "c d e", "f"]
    assert [(x.title, x.text) for x in row.h] == [("T", "pre"), ("A", "x"), ("B", "y")]
    assert [(x.title, x.text) for x in row.t] == [("Alpha", "alpha one"), ("Beta", "beta two")]


def test_graph_names(spark):
    entities = spark.createDataFrame([("d", "acme corp", "Org", "maker of fine tools", ["1"]), ("d", "acme", "Org", "", ["2"]), ("d", "globex international", "Org", "", ["3"])], "doc_id string, key string, entity_type string, description string, source_node_ids array<string>")
    names = spark.createDataFrame([(1, "d", "Globex"), (2, "d", "the acme corp of old"), (3, "d", "international globex trade"), (4, "d", "none")], "query_id int, doc_id string, name string")
    assert {r.query_id: r.key for r in graph.fuzzy_match(entities, names).collect()} == {1: "globex international", 2: "acme corp", 3: "globex international"}
    assert {(r.key, r.canonical) for r in graph.resolved(entities).collect()} >= {("acme corp", "acme"), ("acme", "acme")}
    asked = spark.createDataFrame([(1, "who makes fine tools"), (2, "acme")], "query_id int, query string")
    assert {(r.query_id, r.doc_id) for r in graph.gate(entities, asked).collect()} == {(1, "d"), (2, "d")}
    replies = graph.extract(spark.createDataFrame([("d", "1", "x" * 900), ("d", "2", "short")], "doc_id string, node_id string, text string"), None)
    assert [(r.node_id, r.skipped) for r in replies.collect()] == [("1", "no_llm_client")]
    row = spark.range(1).select(fx.answer_blocks(F.lit("BEGIN id=7\nENTITY|VENDOR|a|b\nEND\nBEGIN id=8\nx\nEND")).alias("b")).first()
    assert [(x.node_id, x.body.strip()) for x in row.b] == [("7", "ENTITY|VENDOR|a|b"), ("8", "x")]


def test_routing(spark):
    metas = spark.createDataFrame([("d1", 1, "a", "", "s", ["e"], 3), ("d2", 2, "b", "B", None, None, 4), ("d1", 3, "c", "C", "s", None, 3)], "doc_id string, ord int, name string, title string, summary string, top_entities array<string>, total_pages int")
    router = facade.FlatRouter(metas=answer.registered(metas))
    queries = spark.createDataFrame([(1, "q")], "query_id int, query string")
    assert [r.doc_id for r in router.route(queries).orderBy("place").collect()] == ["d1", "d2"]
    router.client = lambda prompt: 'I take ["ghost", "d2"]' if 'title="C"' in prompt else "[]"
    assert [r.doc_id for r in router.route(queries).collect()] == ["d2"]
    assert hits.neighbours(spark.createDataFrame([(1, "d", 5)], "query_id int, doc_id string, page_num int"), None, totals=spark.createDataFrame([("d", 5)], "doc_id string, total_pages int")).first().page_num == 4


def test_pages_that_arrive(spark, tmp_path):
    rows = [("d", 1, "alpha beta"), ("d", 2, "gamma")]
    spark.createDataFrame(rows, PAGE).coalesce(1).write.json(f"{tmp_path}/in")
    read = lambda: spark.readStream.schema(PAGE).json(f"{tmp_path}/in")
    streaming.collected(read(), f"{tmp_path}/base", f"{tmp_path}/check").awaitTermination()
    spark.createDataFrame([("d", 2, "delta")], PAGE).coalesce(1).write.mode("append").json(f"{tmp_path}/in")
    streaming.collected(read(), f"{tmp_path}/base", f"{tmp_path}/check").awaitTermination()
    index = streaming.refreshed(spark, f"{tmp_path}/base")
    asked = spark.createDataFrame([(1, "gamma delta")], "query_id int, query string")
    assert [(r.page_num, r.score > 0) for r in index.bm25(asked).collect()] == [(2, True)]
    assert index.docs.first().n == 2


def test_dom_told_while_read(spark):
    """what is told while a document is read is what the rows say, and no join can be broadcast."""
    html = '<section data-page="3"><h2>Head</h2><p>one<p>two &amp; three</p><figure><img src="x.png"></figure></section><table><tr><th>a</th><td></td><td>b</td></tr><tr><td>c</td></tr></table>'
    plain = "<TABLE><tr><td>1</td><td> 2 </td><td>3</td><td>4</td><td>5</td></tr></table>x < y"
    pages = spark.createDataFrame([("d", html), ("e", None), ("f", plain), ("g", plain[:-5])], "doc_id string, html string")
    rows, told = dom.nodes(pages), dom.nodes(pages, columns=(*dom.FIELDS, *dom.TOLD))
    for name in ("breadcrumb", "subtree_text"):
        made = dom.breadcrumbs(rows) if name == "breadcrumb" else dom.subtree_texts(rows)
        assert "Broadcast" not in made._jdf.queryExecution().executedPlan().toString() and "Join" not in told._jdf.queryExecution().executedPlan().toString()
        assert {tuple(r) for r in made.collect()} == {tuple(r) for r in told.select("doc_id", "node_id", name).collect()}
    for n in (1, 3, 4):
        columns = ["doc_id", "node_id", "preceding", "following"]
        assert sorted(map(tuple, dom.siblings(rows, n).select(columns).collect())) == sorted(map(tuple, dom.siblings(rows if n > dom.NEAR else told, n).select(columns).collect()))


def test_sections_are_never_broadcast(spark):
    """only pairs of signs are broadcast; a query's two identifiers count once."""
    nodes = spark.createDataFrame([("d", 1, "Rule 12/3 of A7", 1, 2), ("d", 2, "Rule 12", 4, 4), ("d", 3, "x", None, None)], "doc_id string, ord int, title string, page_start int, page_end int")
    asked = spark.createDataFrame([(1, "12 and A7"), (2, "99"), (3, None)], "query_id int, query string")
    found = channels.identifier_boost(nodes, asked)
    assert sorted((r.query_id, r.page_num, r.score, r.pos) for r in found.collect()) == [(1, 1, 17.67767, 2), (1, 2, 17.67767, 3), (1, 4, 25.0, 1)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastExchange") == 1 and "BroadcastHashJoin [gram" in plan and "LeftSemi" in plan


def test_fuzzy_names_by_definition(spark):
    """as if each name met each entity of its document, which no join does."""
    import random

    pick = random.Random(3)
    words = ["acme", "ab", "north", "c", "tools", "of", "globex", "ltd"]
    name = lambda: " ".join(pick.choice(words) for _ in range(pick.randint(1, 4)))
    keys = sorted({(d, name()) for d in "de" for _ in range(25)})
    asked = [(k, pick.choice("de"), pick.choice([name(), name().upper(), name()[: pick.randint(0, 9)]])) for k in range(150)]

    def means(doc, q):
        q, best = q.strip(" ").lower(), []
        for d, n in keys:
            both = len(set(q.split()) & set(n.split()))
            t = (0, 0) if n == q else (1, len(n)) if q in n else (2, -len(n)) if n in q and len(n) >= 3 else (3, 0) if both >= 2 and both >= 0.5 * len(set(q.split())) else None
            if d == doc and q and t:
                best.append((t, n))
        return min(best)[1] if best else None

    found = graph.fuzzy_match(spark.createDataFrame(keys, "doc_id string, key string"), spark.createDataFrame(asked, "query_id int, doc_id string, name string"))
    assert {(r.query_id, r.key) for r in found.collect()} == {(k, n) for k, d, q in asked if (n := means(d, q))}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and not re.search(r"Join \[doc_id#\d+L?\], \[", plan)


def test_branches_with_other_titles_stay(spark):
    """What stands below other titles is no copy; equal titles of one page can't be told apart by it."""
    text = lambda head, names: f"## {head}\n" + "\n".join(f"### {n}\nbody" for n in names)
    a, b = [f"a{k}" for k in range(40)], [f"b{k}" for k in range(38)] + ["twice", "twice"]
    pages = spark.createDataFrame([("d", 1, text("one", a)), ("d", 2, text("two", b)), ("d", 3, text("three", a))], "doc_id string, page_num int, text string")
    titles = [r.title for r in tree.build_tree(pages).orderBy("ord").collect()]
    assert titles == ["one", *a, "two", *b]


def test_pages_without_an_index(spark):
    """the same best pages as by an index, and nothing of each page and query is shuffled."""
    import random

    pick = random.Random(5)
    text = lambda n: " ".join(pick.choice("abcdefghijklmnop") for _ in range(n)) if n else None
    pages = spark.createDataFrame([(pick.choice("xyz"), k, text(pick.randint(0, 30))) for k in range(1500)], PAGE)
    asked = spark.createDataFrame([*((k, text(k % 6)) for k in range(12)), (99, "absent")], "query_id int, query string")
    index = lexical.Index.build(pages)
    for got, want in ((lexical.bm25(pages, asked, 7), index.bm25(asked, 7)), (lexical.bmx(pages, asked, 4), index.bmx(asked, 4)), (lexical.multi_query(lexical.bmx(pages, asked)), lexical.multi_query(index.bmx(asked, None)))):
        assert sorted(map(tuple, got.collect())) == sorted(tuple(r[c] for c in got.columns) for r in want.collect())
    plan = lexical.bm25(pages, asked, 7)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "MapInArrow" in plan
