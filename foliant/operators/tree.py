"""Heading trees: parsing, nesting, page ranges, and what they leave uncovered."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from foliant.functions.text import page_title, strip, tokens
from foliant.operators.shared import written


def _doc() -> WindowSpec:
    return Window.partitionBy("doc_id")


def headings(pages: DataFrame) -> DataFrame:
    """(doc_id, page_num, line_no, level, title) of markdown headings."""
    lines = pages.select("doc_id", "page_num", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    mark = F.regexp_extract("line", r"^(#{1,6})[ \t]+\S", 1)
    title = F.regexp_replace("line", r"^#{1,6}[ \t]+|[ \t#]+$", "")
    return lines.select("doc_id", "page_num", "line_no", F.length(mark).alias("level"), title.alias("title")).filter("level > 0")


def numbered(found: DataFrame) -> DataFrame:
    """Headings with ``ord``, their place in the document from 1."""
    return found.withColumn("ord", F.row_number().over(_doc().orderBy("page_num", "line_no")))


def nested(found: DataFrame) -> DataFrame:
    """Headings with ``parent``: the nearest one before of a smaller level, null if none."""
    before = _doc().orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    last = [F.when(F.col("level") > j, F.last(F.when(F.col("level") == j, F.col("ord")), ignorenulls=True).over(before)) for j in range(1, 6)]
    return numbered(found).withColumn("parent", F.greatest(*last))


def page_ranges(found: DataFrame, totals: DataFrame) -> DataFrame:
    """Headings with the pages they own: up to the page before the next heading's,
    their own page at least. totals: (doc_id, total_pages)."""
    following = F.lead("page_num").over(_doc().orderBy("ord"))
    end = F.greatest(F.col("page_num"), F.coalesce(following - 1, F.col("total_pages")))
    return numbered(found).join(totals, "doc_id").select("doc_id", "ord", "level", "title", F.col("page_num").alias("page_start"), end.alias("page_end"))


def running_headers(found: DataFrame, least: int = 4, share: float = 0.3) -> DataFrame:
    """(doc_id, title, times): titles that 30 % of a document's headings repeat."""
    per = found.groupBy("doc_id", "title").agg(F.count("*").alias("times"))
    total = found.groupBy("doc_id").agg(F.count("*").alias("all"))
    return per.join(total, "doc_id").filter((F.col("all") >= least) & (F.col("times") >= share * F.col("all"))).drop("all")


def coverage(found: DataFrame, totals: DataFrame) -> DataFrame:
    """(doc_id, coverage, strategy): the share of pages with a heading, and how a
    tree is built for it: by headings, by sections, or by pages without any."""
    with_one = found.groupBy("doc_id").agg(F.count_distinct("page_num").alias("covered"))
    share = F.coalesce(F.col("covered"), F.lit(0)) / F.col("total_pages")
    how = F.when(F.coalesce(F.col("covered"), F.lit(0)) == 0, "pages").when(share >= 0.15, "headings").otherwise("sections")
    return totals.join(with_one, "doc_id", "left").select("doc_id", F.round(share, 6).alias("coverage"), how.alias("strategy"))


def orphan_ranges(found: DataFrame, totals: DataFrame) -> DataFrame:
    """(doc_id, page_start, page_end): runs of pages without a heading."""
    every = totals.select("doc_id", F.explode(F.sequence(F.lit(1), F.col("total_pages").cast("int"))).alias("page_num"))
    bare = every.join(found.select("doc_id", "page_num").distinct(), ["doc_id", "page_num"], "left_anti")
    run = F.col("page_num") - F.row_number().over(_doc().orderBy("page_num"))
    return bare.withColumn("run", run).groupBy("doc_id", "run").agg(F.min("page_num").alias("page_start"), F.max("page_num").alias("page_end")).drop("run")


def distinct_titles(found: DataFrame) -> DataFrame:
    """Headings with ``node_id`` and a ``label`` that tells equal titles of a document apart by page."""
    same = F.count("*").over(Window.partitionBy("doc_id", F.lower("title")))
    label = F.when(same > 1, F.concat("title", F.lit(" — p."), F.col("page_num").cast("string"))).otherwise(F.col("title"))
    return numbered(found).select("doc_id", F.lpad(F.col("ord").cast("string"), 4, "0").alias("node_id"), label.alias("label"), "page_num", "level")


# -- trees as rows: (doc_id, ord, depth, level, title, text, page_start, page_end)
# in the order of reading, ``depth`` from 1. What is below a node follows it without
# a gap, up to its ``last``.

MOST_TOKENS, LEAST_TOKENS = 4000, 20


def _tokens(text: F.Column) -> F.Column:
    return F.coalesce(F.size(tokens(text)), F.lit(0))


def _before() -> WindowSpec:
    return _doc().orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)


def deep(flat: DataFrame) -> DataFrame:
    """Rows with ``depth``: one more than the rows that they are nested in, by level.

    A row of level j before this one encloses it if no row in between has that
    level or a smaller one.
    """
    last = [F.coalesce(F.last(F.when(F.col("level") == j, F.col("ord")), ignorenulls=True).over(_before()), F.lit(0)) for j in range(1, 7)]
    marked = flat.withColumns({f"_l{j}": c for j, c in enumerate(last, 1)})
    depth = F.lit(1)
    for j in range(1, 7):
        lower = F.greatest(F.lit(0), F.lit(0), *[F.col(f"_l{i}") for i in range(1, j)])
        depth = depth + ((F.col("level") > j) & (F.col(f"_l{j}") > lower)).cast("int")
    return marked.withColumn("depth", depth).drop(*[f"_l{j}" for j in range(1, 7)])


def with_last(nodes: DataFrame) -> DataFrame:
    """Nodes with ``last``, the ord of the last one below each, its own if none is."""
    after = _doc().orderBy("ord").rowsBetween(1, Window.unboundedFollowing)
    end = F.max("ord").over(_doc())
    depths = [F.min(F.when(F.col("depth") <= d, F.col("ord"))).over(after) for d in range(1, 9)]
    nearest = F.element_at(F.array(*depths), F.least(F.col("depth"), F.lit(8)).cast("int"))
    return nodes.withColumn("last", F.coalesce(nearest - 1, end))


def renumbered(nodes: DataFrame, *order: str) -> DataFrame:
    return nodes.withColumn("ord", F.row_number().over(_doc().orderBy(*order))).drop(*[c for c in order if c != "ord"])


def sections_text(pages: DataFrame, remove_running: bool = True) -> DataFrame:
    """Headings with ``ord`` and ``text``, what stands below each up to the next one of its
    page; titles that a document's headings repeat too often are left out."""
    found = numbered(headings(pages))
    if remove_running:
        again = running_headers(found).select("doc_id", "title")
        found = numbered(found.join(again, ["doc_id", "title"], "left_anti").drop("ord"))
    following = F.lead("line_no").over(Window.partitionBy("doc_id", "page_num").orderBy("line_no"))
    lines = pages.select("doc_id", "page_num", F.split("text", "\n").alias("lines"))
    upto = F.coalesce(F.col("next_line"), F.size("lines")) - F.col("line_no") - 1
    body = strip(F.array_join(F.slice("lines", F.col("line_no") + 2, F.greatest(upto, F.lit(0))), "\n"))
    return found.withColumn("next_line", following).join(lines, ["doc_id", "page_num"]).select("doc_id", "ord", "level", "title", "page_num", "line_no", F.when(body != "", body).alias("text"))


def _range_text(ranges: DataFrame, pages: DataFrame) -> DataFrame:
    """Rows (doc_id, ord, page_start, page_end) with ``range_text``: their pages' texts in order."""
    each = ranges.select("doc_id", "ord", F.explode(F.sequence("page_start", "page_end")).alias("page_num"))
    texts = each.join(pages.select("doc_id", F.col("page_num"), strip("text").alias("t")), ["doc_id", "page_num"]).filter("t <> ''")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_num", "t"))), lambda x: x["t"]), "\n\n")
    return ranges.join(texts.groupBy("doc_id", "ord").agg(joined.alias("range_text")), ["doc_id", "ord"], "left")


_NODE = ["doc_id", "ord", "depth", "level", "title", "text", "page_start", "page_end"]


def _titled(headings_of: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc_id, page_num, title, text) of pages with a text, titled by their first heading or line."""
    names = headings_of.groupBy("doc_id", "page_num").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "title"))), lambda x: x["title"]).alias("names"))
    some = pages.select("doc_id", "page_num", strip("text").alias("text")).filter("text <> ''").join(names, ["doc_id", "page_num"], "left")
    return some.select("doc_id", "page_num", page_title(F.coalesce("names", F.array().cast("array<string>")), F.col("text"), F.col("page_num")).alias("title"), "text")


def heading_tree(found: DataFrame) -> DataFrame:
    """A node per heading, nested by level."""
    return deep(found).select("doc_id", "ord", "depth", "level", "title", "text", F.col("page_num").alias("page_start"), F.col("page_num").alias("page_end"))


def section_tree(found: DataFrame, pages: DataFrame, totals: DataFrame) -> DataFrame:
    """A node per heading with the pages it owns; one of several pages has a node per page
    below it, which take its text. What precedes the first heading is a preamble."""
    own = deep(found).drop("line_no", "text").join(page_ranges(found.drop("ord", "text"), totals).select("doc_id", "ord", "page_start", "page_end"), ["doc_id", "ord"])
    whole = _range_text(own, pages)
    wide = F.col("page_end") > F.col("page_start")
    section = whole.select("doc_id", F.col("ord").alias("a"), F.lit(0).alias("b"), "depth", "level", "title", F.when(~wide, F.col("range_text")).alias("text"), "page_start", "page_end")
    each = own.filter(wide).select("doc_id", F.col("ord").alias("a"), (F.col("depth") + 1).alias("depth"), (F.col("level") + 1).alias("level"), F.explode(F.sequence("page_start", "page_end")).alias("page_num"))
    child = each.join(_titled(found, pages), ["doc_id", "page_num"]).select("doc_id", "a", F.col("page_num").cast("int").alias("b"), "depth", "level", "title", "text", F.col("page_num").alias("page_start"), F.col("page_num").alias("page_end"))
    first = found.groupBy("doc_id").agg(F.min("page_num").alias("first"), F.min("level").alias("level")).filter("first > 1")
    before = _range_text(first.select("doc_id", F.lit(0).alias("ord"), "level", F.lit(1).cast("long").alias("page_start"), (F.col("first") - 1).cast("long").alias("page_end")), pages).filter("range_text is not null")
    preamble = before.select("doc_id", F.lit(0).alias("a"), F.lit(0).alias("b"), F.lit(1).alias("depth"), "level", F.lit("Preamble").alias("title"), F.col("range_text").alias("text"), "page_start", "page_end")
    return renumbered(section.unionByName(child).unionByName(preamble), "a", "b").select(*_NODE)


def page_tree(found: DataFrame, pages: DataFrame) -> DataFrame:
    """A node per page with a text; its headings after the first are below it."""
    top = _titled(found, pages).select("doc_id", F.col("page_num").alias("a"), F.lit(0).alias("b"), F.lit(1).alias("depth"), F.lit(1).alias("level"), "title", "text", F.col("page_num").alias("page_start"), F.col("page_num").alias("page_end"))
    nth = F.row_number().over(Window.partitionBy("doc_id", "page_num").orderBy("ord"))
    more = found.withColumn("b", nth - 1).filter("b > 0").select("doc_id", F.col("page_num").alias("a"), "b", F.lit(2).alias("depth"), F.lit(2).alias("level"), "title", "text", F.col("page_num").alias("page_start"), F.col("page_num").alias("page_end"))
    return renumbered(top.unionByName(more), "a", "b").select(*_NODE)


def propagated(nodes: DataFrame) -> DataFrame:
    """Nodes of which the pages reach as far as those below them."""
    ends = nodes.select("doc_id", F.col("ord").alias("below"), F.col("page_end").alias("e"))
    spans = with_last(nodes).select("doc_id", "ord", F.explode(F.sequence("ord", "last")).alias("below"))
    most = spans.join(ends, ["doc_id", "below"]).groupBy("doc_id", "ord").agg(F.max("e").alias("most"))
    return nodes.join(most, ["doc_id", "ord"]).withColumn("page_end", F.greatest("page_end", "most")).select(*_NODE)


def packed(text: F.Column, most: int) -> F.Column:
    """A text's paragraphs in parts of at most ``most`` tokens, or of one paragraph."""
    none = F.lit(None).cast("string")
    start = F.struct(F.array().cast("array<string>").alias("done"), none.alias("now"), F.lit(0).alias("n"))

    def step(a: F.Column, p: F.Column) -> F.Column:
        n = _tokens(p)
        full = a["now"].isNotNull() & (a["n"] + n > most)
        return F.struct(F.when(full, F.array_append(a["done"], a["now"])).otherwise(a["done"]).alias("done"), F.when(full | a["now"].isNull(), p).otherwise(F.concat(a["now"], F.lit("\n\n"), p)).alias("now"), F.when(full, n).otherwise(a["n"] + n).alias("n"))

    return F.aggregate(F.split(text, "\n\n"), start, step, lambda a: F.array_append(a["done"], a["now"]))


def _with_parts(nodes: DataFrame, when: F.Column, parts: F.Column) -> DataFrame:
    """Nodes with a row per part (title, text) below those for which ``when`` holds; these
    hand over their text, and their pages in proportion to the parts' lengths."""
    marked = nodes.withColumn("parts", F.when(when, parts)).withColumn("split", F.coalesce(F.size("parts") > 1, F.lit(False)))
    top = marked.select("doc_id", F.col("ord").alias("a"), F.lit(-1).alias("b"), "depth", "level", "title", F.when(~F.col("split"), F.col("text")).alias("text"), "page_start", "page_end", F.lit(False).alias("part"))
    spans = page_spans(F.transform("parts", lambda p: F.length(p["text"])), F.col("page_start"), F.col("page_end"))
    below = marked.filter("split").select("doc_id", F.col("ord").alias("a"), (F.col("depth") + 1).alias("depth"), (F.col("level") + 1).alias("level"), F.posexplode(F.arrays_zip(F.col("parts"), spans.alias("span"))).alias("b", "p"))
    child = below.select("doc_id", "a", "b", "depth", "level", F.col("p.parts.title").alias("title"), F.col("p.parts.text").alias("text"), F.col("p.span.start").alias("page_start"), F.col("p.span.end").alias("page_end"), F.lit(True).alias("part"))
    return renumbered(top.unionByName(child), "a", "b")


def page_spans(sizes: F.Column, start: F.Column, end: F.Column) -> F.Column:
    """Array of (start, end): a range of pages shared out by size, in order, each one page at
    least; halves are rounded to even, and the last one gets the rest."""
    total = F.aggregate(sizes, F.lit(0), lambda a, x: a + x)
    span, kind = end - start + 1, "array<struct<start:bigint,end:bigint>>"
    first = F.struct(F.array().cast(kind).alias("done"), start.cast("bigint").alias("at"))

    def step(a: F.Column, x: F.Column) -> F.Column:
        pages = F.greatest(F.lit(1), F.bround(span * x / F.greatest(total, F.lit(1)), 0).cast("bigint"))
        last = F.least(a["at"] + pages - 1, end.cast("bigint"))
        return F.struct(F.array_append(a["done"], F.struct(a["at"].alias("start"), last.alias("end"))).alias("done"), (last + 1).alias("at"))

    every = F.aggregate(sizes, first, step, lambda a: a["done"])
    n = F.size(sizes)
    return F.transform(every, lambda s, i: F.when(i == n - 1, F.struct(s["start"].alias("start"), end.cast("bigint").alias("end"))).otherwise(s))


def _leaf() -> F.Column:
    return F.col("last") == F.col("ord")


def numbered_parts(title: F.Column, texts: F.Column) -> F.Column:
    return F.transform(texts, lambda t, i: F.struct(F.concat(title, F.lit(" (part "), (i + 1).cast("string"), F.lit(")")).alias("title"), t.alias("text")))


def split_leaves(nodes: DataFrame, most: int = MOST_TOKENS) -> DataFrame:
    """Leaves of more than ``most`` tokens get their paragraphs as parts below them."""
    return _with_parts(with_last(nodes), _leaf() & (_tokens(F.col("text")) > most), numbered_parts(F.col("title"), packed(F.col("text"), most)))


def heading_parts(title: F.Column, text: F.Column) -> F.Column:
    """Array of (title, text): a text cut at its own headings; what precedes the first keeps the title."""
    pieces = F.split(F.concat(F.lit("\n"), text), r"\n(?=#{1,6}[ \t]+\S)")
    head = strip(pieces[0])
    cut = F.transform(F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))), lambda p: F.struct(strip(F.regexp_replace(F.substring_index(p, "\n", 1), r"^#{1,6}[ \t]+", "")).alias("title"), strip(F.substring(p, F.length(F.substring_index(p, "\n", 1)) + 1, F.length(p))).alias("text")))
    whole = F.concat(F.array(F.struct(title.alias("title"), head.alias("text"))), cut)
    return F.when(F.size(pieces) > 2, F.filter(whole, lambda p: p["text"] != ""))


def title_parts(titles: F.Column, text: F.Column, title: F.Column) -> F.Column:
    """Array of (title, text): a text cut where the first 30 signs of given titles stand;
    with fewer than two found its paragraphs are shared out among them evenly."""
    low = F.lower(text)
    at = F.array_sort(F.filter(F.transform(titles, lambda t: F.struct(F.instr(low, F.substring(F.lower(t), 1, 30)).alias("at"), t.alias("title"))), lambda x: x["at"] > 0))
    cut = F.transform(at, lambda x, i: F.struct(x["title"].alias("title"), strip(F.substring(text, x["at"], F.coalesce(F.get(at, i + 1)["at"], F.length(text) + 1) - x["at"])).alias("text")))
    paragraphs = F.split(text, "\n\n")
    count = F.least(F.size(titles), F.greatest(F.lit(2), F.floor(F.size(paragraphs) / 3).cast("int")))
    step = F.greatest(F.lit(1), F.floor(F.size(paragraphs) / count).cast("int"))
    even = F.transform(F.sequence(F.lit(0), F.floor((F.size(paragraphs) - 1) / step).cast("int")), lambda k: F.struct(F.coalesce(F.get(titles, F.least(k, F.size(titles) - 1)), title).alias("title"), strip(F.array_join(F.slice(paragraphs, k * step + 1, step), "\n\n")).alias("text")))
    return F.filter(F.when(F.size(at) > 1, cut).otherwise(even), lambda p: p["text"] != "")


def refined(nodes: DataFrame, most: int = MOST_TOKENS, passes: int = 4, titles: DataFrame | None = None) -> DataFrame:
    """Leaves of more than ``most`` tokens cut until none is, ``passes`` times at the most: at
    their own headings, else at ``titles`` (doc_id, title, titles) that a model gave, else by
    paragraphs. Each pass is written."""
    for _ in range(passes):
        known = with_last(written(nodes.select(*_NODE)))
        if titles is None:
            known = known.withColumn("titles", F.lit(None).cast("array<string>"))
        else:
            known = known.join(titles.select("doc_id", "title", "titles"), ["doc_id", "title"], "left")
        own = heading_parts(F.col("title"), F.col("text"))
        given = F.when(F.size("titles") > 1, title_parts(F.col("titles"), F.col("text"), F.col("title")))
        parts = F.when(F.size(own) > 1, own).when(F.size(given) > 1, given).otherwise(numbered_parts(F.col("title"), packed(F.col("text"), most)))
        nodes = _with_parts(known.withColumn("titles", F.col("titles")), _leaf() & (_tokens(F.col("text")) > most), parts)
    return nodes.select(*_NODE)


def orphan_nodes(nodes: DataFrame, pages: DataFrame, totals: DataFrame, least: int = 20) -> DataFrame:
    """Nodes and, after them, one per run of pages that none covers, of ``least`` signs or more."""
    every = totals.select("doc_id", F.explode(F.sequence(F.lit(1), F.col("total_pages").cast("int"))).alias("page_num"))
    covered = nodes.filter("page_start is not null").select("doc_id", F.explode(F.sequence(F.col("page_start").cast("int"), F.col("page_end").cast("int"))).alias("page_num")).distinct()
    bare = every.join(covered, ["doc_id", "page_num"], "left_anti")
    run = F.col("page_num") - F.row_number().over(_doc().orderBy("page_num"))
    ranges = bare.withColumn("run", run).groupBy("doc_id", "run").agg(F.min("page_num").cast("long").alias("page_start"), F.max("page_num").cast("long").alias("page_end")).withColumn("ord", F.col("page_start").cast("int")).drop("run")
    whole = _range_text(ranges, pages).filter(F.length("range_text") >= least)
    first = whole.join(pages.select("doc_id", F.col("page_num").alias("page_start"), F.col("text").alias("first")), ["doc_id", "page_start"], "left")
    name = F.when(F.col("page_start") == F.col("page_end"), F.concat(F.lit("Page "), F.col("page_start").cast("string"))).otherwise(F.concat(F.lit("Pages "), F.col("page_start").cast("string"), F.lit("-"), F.col("page_end").cast("string")))
    lines = F.transform(F.split("first", "\n"), lambda x: F.regexp_replace(x, r"^[#*\s]+|[#*\s]+$", ""))
    titled = F.coalesce(F.substring(F.get(F.filter(lines, lambda x: F.length(x) > 3), F.lit(0)), 1, 100), name)
    added = first.select("doc_id", F.lit(1).alias("a"), F.col("ord").alias("b"), F.lit(1).alias("depth"), F.lit(1).alias("level"), titled.alias("title"), F.col("range_text").alias("text"), "page_start", "page_end")
    own = nodes.select("doc_id", F.lit(0).alias("a"), F.col("ord").alias("b"), *_NODE[2:])
    return renumbered(own.unionByName(added), "a", "b").select(*_NODE)


def page_texts(nodes: DataFrame, pages: DataFrame, mode: str = "heading") -> DataFrame:
    """Leaves with the whole text of their pages. In mode ``heading`` leaves that share a page
    keep their own, as else all of them would say the same; in mode ``full`` none does."""
    known = with_last(nodes)
    leaves = known.filter(_leaf())
    each = leaves.select("doc_id", "ord", F.explode(F.sequence("page_start", "page_end")).alias("page_num"))
    crowded = each.withColumn("n", F.count("*").over(Window.partitionBy("doc_id", "page_num"))).groupBy("doc_id", "ord").agg((F.max("n") > 1).alias("shared"))
    whole = _range_text(leaves.select("doc_id", "ord", "page_start", "page_end"), pages).select("doc_id", "ord", "range_text").join(crowded, ["doc_id", "ord"], "left")
    new = F.when((F.lit(mode) == "full") | ~F.coalesce("shared", F.lit(False)), F.coalesce("range_text", "text")).otherwise(F.col("text"))
    return known.join(whole, ["doc_id", "ord"], "left").withColumn("text", F.when(_leaf(), new).otherwise(F.col("text"))).select(*_NODE)


def without_child_text(nodes: DataFrame) -> DataFrame:
    """Parents without what their first child says: their text ends where its first 200 signs begin."""
    known = with_last(nodes).withColumn("child", F.lead("text").over(_doc().orderBy("ord")))
    at = F.instr(F.col("text"), F.substring("child", 1, 200))
    kept = strip(F.substring(F.col("text"), 1, at - 1))
    holds = ~_leaf() & (F.length("child") > 0) & (at > 0)
    return known.withColumn("text", F.when(holds, F.when(kept != "", kept)).otherwise(F.col("text"))).select(*_NODE)


def without_copies(nodes: DataFrame, share: float = 0.8, least: int = 100, sample: int = 2000) -> DataFrame:
    """Nodes without top branches that repeat an earlier one that stays.

    Two branches are compared sign by sign over the shorter one, ``sample`` signs at
    most; of branches below ``least`` signs nothing is told. Branches with other titles
    below them aren't copies, however alike what stands under these is. Only those
    signs of a document's top branches meet in a task.
    """
    known = with_last(nodes)
    tops = known.filter("depth = 1").select("doc_id", F.explode(F.sequence("ord", "last")).alias("below"), "ord")
    texts = known.select("doc_id", F.col("ord").alias("below"), F.coalesce("text", F.lit("")).alias("t"), F.coalesce("title", F.lit("")).alias("title"))
    whole = F.array_sort(F.collect_list(F.struct("below", "t", "title"))).alias("x")
    titles = F.sha2(F.to_json(F.struct(F.slice("x.title", 2, F.size("x")).alias("titles"))), 256)
    branches = tops.join(texts, ["doc_id", "below"]).groupBy("doc_id", "ord").agg(whole).select("doc_id", "ord", F.substring(F.array_join("x.t", "\n"), 1, sample).alias("b"), titles.alias("h"))
    listed = branches.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("ord", "b", "h"))).alias("bs"))

    def same(a: F.Column, b: F.Column) -> F.Column:
        n = F.least(F.length(a), F.length(b))
        equal = F.size(F.filter(F.arrays_zip(F.split(F.left(a, n), "").alias("x"), F.split(F.left(b, n), "").alias("y")), lambda z: z["x"] == z["y"]))
        return (n >= least) & (equal > n * share)

    kinds = "array<struct<ord:int,b:string,h:string>>"
    keep = F.aggregate("bs", F.array().cast(kinds), lambda a, x: F.when((strip(x["b"]) != "") & F.exists(a, lambda y: (x["h"] == y["h"]) & same(x["b"], y["b"])), a).otherwise(F.array_append(a, F.struct(x["ord"].cast("int").alias("ord"), x["b"].alias("b"), x["h"].alias("h")))))
    stay = listed.select("doc_id", F.explode(keep).alias("k")).select("doc_id", F.col("k.ord").alias("top"))
    top = F.max(F.when(F.col("depth") == 1, F.col("ord"))).over(_doc().orderBy("ord").rowsBetween(Window.unboundedPreceding, 0))
    return renumbered(known.withColumn("top", top).join(stay, ["doc_id", "top"], "left_semi").select(*_NODE), "ord").select(*_NODE)


def told_apart(nodes: DataFrame) -> DataFrame:
    """Nodes of which equal titles of a document are told apart, by their children's titles,
    else by a line of their text, else by their pages; titles stay where that is the same for all."""
    known = with_last(nodes)
    key = F.lower(strip("title"))
    # a child's parent: the last one before it of a smaller depth
    parents = [F.last(F.when(F.col("depth") == d, F.col("ord")), ignorenulls=True).over(_before()) for d in range(1, 9)]
    parent = F.when(F.col("depth") > 1, F.element_at(F.array(*parents), F.least(F.col("depth") - 1, F.lit(8)).cast("int")))
    children = known.withColumn("up", parent).filter("up is not null").select("doc_id", "up", "ord", F.col("title").alias("t"))
    listed = children.groupBy("doc_id", F.col("up").alias("ord")).agg(F.transform(F.slice(F.array_sort(F.collect_list(F.struct("ord", "t"))), 1, 3), lambda x: x["t"]).alias("below"))
    lines = F.transform(F.split("text", "\n"), lambda x: F.regexp_replace(x, r"^[#*\s]+|[#*\s]+$", ""))
    line = F.substring(F.get(F.filter(lines, lambda x: (F.length(x) > 5) & (F.lower(x) != F.col("key"))), F.lit(0)), 1, 60)
    page = F.when(F.col("page_start") == F.col("page_end"), F.concat(F.lit("p."), F.col("page_start").cast("string"))).otherwise(F.concat(F.lit("p."), F.col("page_start").cast("string"), F.lit("-"), F.col("page_end").cast("string")))
    names = F.filter("below", lambda t: t != F.col("title"))
    suffix = F.coalesce(F.when(F.size(names) > 0, F.array_join(names, "; ")), line, page)
    same = F.count("*").over(Window.partitionBy("doc_id", "key"))
    alike = Window.partitionBy("doc_id", "key")
    differ = F.count("suffix").over(alike) < F.col("same")
    differ = differ | (F.min("suffix").over(alike) != F.max("suffix").over(alike))
    marked = known.join(listed, ["doc_id", "ord"], "left").withColumn("key", key).withColumn("same", same).withColumn("suffix", suffix).withColumn("differ", differ)
    title = F.when((F.col("same") > 1) & F.col("suffix").isNotNull() & F.col("differ"), F.concat("title", F.lit(" — "), F.col("suffix"))).otherwise(F.col("title"))
    return marked.withColumn("title", title).select(*_NODE)


def build_tree(pages: DataFrame, totals: DataFrame | None = None, most: int = MOST_TOKENS, mode: str = "heading") -> DataFrame:
    """(doc_id, node_id, ord, last, depth, level, title, text, page_start, page_end).

    pages: (doc_id, page_num, text). How a document's tree is built follows from how
    many of its pages have a heading; then pages that no node covers are added, leaves
    get their pages' texts, long ones are split, and repeats go. Null texts are empty.
    """
    pages = pages.select("doc_id", F.col("page_num").cast("long").alias("page_num"), F.coalesce("text", F.lit("")).alias("text"))
    if totals is None:
        totals = pages.groupBy("doc_id").agg(F.max("page_num").cast("int").alias("total_pages"))
    # each step reads the one before several times over: it is written, not planned again
    found = written(sections_text(pages))
    how = coverage(found, totals).select("doc_id", "strategy")

    def of(name: str, rows: DataFrame) -> DataFrame:
        return rows.join(how.filter(F.col("strategy") == name), "doc_id", "left_semi")

    nodes = written(heading_tree(of("headings", found)).withColumn("up", F.lit(True)).unionByName(section_tree(of("sections", found), of("sections", pages), totals).withColumn("up", F.lit(False))).unionByName(page_tree(of("pages", found), of("pages", pages)).withColumn("up", F.lit(False))))
    nodes = propagated(nodes.filter("up").drop("up")).unionByName(nodes.filter("not up").drop("up"))
    nodes = written(orphan_nodes(written(nodes), pages, totals))
    nodes = written(without_child_text(split_leaves(page_texts(nodes, pages, mode), most).select(*_NODE)))
    nodes = told_apart(written(without_copies(nodes)))
    return written(with_last(nodes).select("doc_id", F.lpad(F.col("ord").cast("string"), 4, "0").alias("node_id"), "ord", "last", *_NODE[2:]))


def node_texts(nodes: DataFrame) -> DataFrame:
    """(doc_id, ord, content): each node's text and all below it, in order; empty if there is none."""
    each = nodes.select("doc_id", "ord", F.explode(F.sequence("ord", "last")).alias("below"))
    texts = nodes.select("doc_id", F.col("ord").alias("below"), "text").filter(F.length("text") > 0)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("below", "text"))), lambda x: x["text"]), "\n\n")
    made = each.join(texts, ["doc_id", "below"]).groupBy("doc_id", "ord").agg(joined.alias("content"))
    return nodes.select("doc_id", "ord").join(made, ["doc_id", "ord"], "left").withColumn("content", F.coalesce("content", F.lit("")))


def section_index(nodes: DataFrame, least: int = LEAST_TOKENS) -> DataFrame:
    """(doc_id, page_num, text): nodes as pages of an index, numbered by ord; those of fewer
    than ``least`` tokens are left out. A summary, where there is one, comes first."""
    content = node_texts(nodes)
    if "summary" in nodes.columns:
        content = content.join(nodes.select("doc_id", "ord", "summary"), ["doc_id", "ord"]).withColumn("content", F.concat_ws("\n\n", "summary", F.when(F.col("content") != "", F.col("content"))))
    return content.filter(_tokens(F.col("content")) >= least).select("doc_id", F.col("ord").alias("page_num"), F.col("content").alias("text"))


def pages_note() -> F.Column:
    one = F.col("page_start") == F.col("page_end")
    return F.when(F.col("page_start").isNull(), "").when(one, F.concat(F.lit(" (p."), F.col("page_start").cast("string"), F.lit(")"))).otherwise(F.concat(F.lit(" (p."), F.col("page_start").cast("string"), F.lit("-"), F.col("page_end").cast("string"), F.lit(")")))


def outline(nodes: DataFrame, max_depth: int = 3) -> DataFrame:
    """(doc_id, outline): a line per node down to a depth; the deepest say how many are below them."""
    below = F.coalesce(F.lead("depth").over(_doc().orderBy("ord")) > F.col("depth"), F.lit(False))
    known = nodes.withColumn("parent", below)
    count = nodes.filter(F.col("depth") == max_depth + 1).select("doc_id", F.col("ord").alias("child"))
    deepest = known.filter(F.col("parent") & (F.col("depth") == max_depth)).select("doc_id", "ord", F.explode(F.sequence("ord", "last")).alias("child")).join(count, ["doc_id", "child"], "left_semi").groupBy("doc_id", "ord").agg(F.count("*").alias("n"))
    line = F.concat(F.repeat(F.lit("  "), F.col("depth").cast("int") - 1), F.lit("- ["), F.col("node_id"), F.lit("] "), F.col("title"), pages_note(), F.when(F.col("n").isNotNull(), F.concat(F.lit(" ["), F.col("n").cast("string"), F.lit(" sub]"))).otherwise(""))
    shown = known.filter(F.col("depth") <= max_depth).join(deepest, ["doc_id", "ord"], "left")
    return shown.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", line.alias("l")))), lambda x: x["l"]), "\n").alias("outline"))


def section_context(nodes: DataFrame) -> DataFrame:
    """(doc_id, node_id, context): each node's content under its heading, with the titles next to it."""
    parents = [F.last(F.when(F.col("depth") == d, F.col("ord")), ignorenulls=True).over(_before()) for d in range(1, 9)]
    up = F.when(F.col("depth") > 1, F.element_at(F.array(*parents), F.least(F.col("depth") - 1, F.lit(8)).cast("int"))).otherwise(F.lit(0))
    beside = Window.partitionBy("doc_id", "up").orderBy("ord")
    name = F.concat(F.lit("["), F.col("node_id"), F.lit("] "), F.col("title"))
    known = nodes.withColumn("up", up).withColumns({"before": F.lag(name).over(beside), "after": F.lead(name).over(beside)}).join(node_texts(nodes), ["doc_id", "ord"])
    near = F.concat_ws(", ", "before", "after")
    head = F.concat(F.lit("## "), name, pages_note(), F.lit("\n"))
    text = F.concat(F.when(near != "", F.concat(F.lit("Nearby sections: "), near, F.lit("\n\n"))).otherwise(""), head, F.when(F.col("content") != "", F.concat(F.lit("\n"), F.col("content"))).otherwise(""))
    return known.select("doc_id", "node_id", text.alias("context"))


def parent_summaries(nodes: DataFrame, most: int = 200) -> DataFrame:
    """Nodes with ``summary``: their own, else their first five children's, cut; ``nodes`` has
    leaves' summaries. Levels are few; each one's pass reads the one before twice."""
    parents = [F.last(F.when(F.col("depth") == d, F.col("ord")), ignorenulls=True).over(_before()) for d in range(1, 9)]
    known = nodes.withColumn("up", F.when(F.col("depth") > 1, F.element_at(F.array(*parents), F.least(F.col("depth") - 1, F.lit(8)).cast("int"))))
    for depth in range(7, 0, -1):
        below = known.filter((F.col("depth") == depth + 1) & F.col("summary").isNotNull() & (F.col("summary") != F.col("title")))
        first = F.slice(F.array_sort(F.collect_list(F.struct("ord", "summary"))), 1, 5)
        made = below.groupBy("doc_id", F.col("up").alias("ord")).agg(F.substring(F.array_join(F.transform(first, lambda x: x["summary"]), "; "), 1, most).alias("made"))
        known = written(known.join(made, ["doc_id", "ord"], "left").withColumn("summary", F.coalesce("summary", F.when(F.col("depth") == depth, F.col("made")))).drop("made"))
    return known.drop("up")
