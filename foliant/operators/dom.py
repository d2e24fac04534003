"""Pages of HTML as rows of nodes.

nodes: (doc_id, node_id, parent_id, nth, depth, tag, text, page_num, page_type,
path); ``path`` holds the ids from the root down to the node, so an ancestor is a
member of it and no query walks the tree. What is told of a node by those around it
(``TOLD``) can be had while its document is read; from the rows it takes a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.operators.shared import feed

TRACKED = {"section", "table", "tr", "td", "th", "h2", "h3", "p", "figure"}
SEARCHABLE = ["td", "th", "p", "h2", "h3", "figure"]
_LONG, _INT, _TEXT, _IDS = (T.LongType(), pa.int64()), (T.IntegerType(), pa.int32()), (T.StringType(), pa.string()), (T.ArrayType(T.LongType()), pa.list_(pa.int64()))
FIELDS = {"node_id": _LONG, "parent_id": _LONG, "nth": _INT, "depth": _INT, "tag": _TEXT, "text": _TEXT, "page_num": _LONG, "page_type": _TEXT, "path": _IDS}
TOLD = {"breadcrumb": _TEXT, "subtree_text": _TEXT, "preceding": _IDS, "following": _IDS, "parent_nth": _INT}
#: Siblings on each side, and levels below, that are told while a document is read.
NEAR, DEEP = 3, 99
_COUNTED, _NAMED = {"td": "Cell", "th": "Header", "tr": "Row"}, {"table": "Table", "p": "Paragraph", "figure": "Figure"}


class _Walk(HTMLParser):
    """Nodes in the order of their start tags, a list per column; a text belongs to the innermost open one."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parent_id: list[int | None] = [None]
        self.nth, self.tag, self.text, self.page_num, self.page_type = [0], ["document"], [""], [0], [""]
        self.path: list[tuple[int, ...]] = [(0,)]
        self._children = [0]
        self._open = 0
        self._page = 0, ""

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        here = self._open
        if tag == "img" and self.tag[here] == "figure":
            self.text[here] = f"[img: {dict(attrs).get('src') or ''}]"
        if tag not in TRACKED:
            return
        page, kind = self._page
        if tag in ("section", "figure"):
            given = dict(attrs)
            number = given.get("data-page") or ""
            if tag == "section":
                page, kind = self._page = int(number) if number.isdecimal() else 0, given.get("data-type") or ""
                tag = "page"
            elif number.isdecimal():
                page = int(number)
        k = self._open = len(self.nth)
        self.parent_id.append(here)
        self.nth.append(self._children[here])
        self._children[here] += 1
        self._children.append(0)
        self.tag.append(tag)
        self.text.append("")
        self.page_num.append(page)
        self.page_type.append(kind)
        self.path.append((*self.path[here], k))

    def handle_endtag(self, tag: str) -> None:
        here = self._open
        if here and self.tag[here] == ("page" if tag == "section" else tag):
            self._open = self.parent_id[here]

    def handle_data(self, data: str) -> None:
        if data := data.strip():
            have = self.text[self._open]
            self.text[self._open] = f"{have} {data}" if have else data

    @property
    def node_id(self) -> range:
        return range(len(self.nth))

    @property
    def depth(self) -> list[int]:
        return [len(p) - 1 for p in self.path]

    @property
    def breadcrumb(self) -> list[str]:
        """As breadcrumbs() makes it."""
        out = [""]
        for k in range(1, len(self.nth)):
            tag, above = self.tag[k], out[self.parent_id[k]]
            if tag in _COUNTED:
                label = f"{_COUNTED[tag]} {self.nth[k] + 1}"
            elif tag in ("h2", "h3"):
                label = "Heading: " + self.text[k][:50]
            else:
                label = f"Page {self.page_num[k]}" if tag == "page" else _NAMED[tag]
            out.append(f"{above} > {label}" if above else label)
        return out

    @property
    def subtree_text(self) -> list[str]:
        parts: list[list[str]] = [[] for _ in self.nth]
        for text, path in zip(self.text, self.path):
            if text.strip(" "):
                for k in path[-DEEP - 1 :]:
                    parts[k].append(text)
        return [" ".join(p) for p in parts]

    @property
    def parent_nth(self) -> list[int | None]:
        return [None, *(self.nth[p] for p in self.parent_id[1:])]

    def _beside(self, low: int, high: int) -> list[list[int]]:
        children: list[list[int]] = [[] for _ in self.nth]
        for k, p in enumerate(self.parent_id[1:], 1):
            children[p].append(k)
        return [[], *(children[p][max(0, n + low) : max(0, n + high)] for p, n in zip(self.parent_id[1:], self.nth[1:]))]

    @property
    def preceding(self) -> list[list[int]]:
        return self._beside(-NEAR, 0)

    @property
    def following(self) -> list[list[int]]:
        return self._beside(1, NEAR + 1)


def nodes(pages: DataFrame, html_col: str = "html", columns: tuple[str, ...] = tuple(FIELDS)) -> DataFrame:
    """The nodes of each row's HTML, a document root first; a null text has the root only.
    ``columns`` are those to give, of ``FIELDS`` and ``TOLD``: what a Python function gives
    can't be pruned later."""
    known = FIELDS | TOLD
    kinds = T.StructType([pages.schema["doc_id"], *(T.StructField(n, known[n][0]) for n in columns)])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            # a document has many nodes: few documents make a batch of them
            for low in range(0, whole.num_rows, 1000):
                batch = whole.slice(low, 1000)
                at: list[int] = []
                out: list[list] = [[] for _ in columns]
                for k, html in enumerate(batch.column(1).to_pylist()):
                    walk = _Walk()
                    feed(walk, html or "")
                    at += [k] * len(walk.nth)
                    for name, values in zip(columns, out):
                        values += getattr(walk, name)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *(pa.array(v, known[n][1]) for n, v in zip(columns, out))], names=["doc_id", *columns])

    return pages.select("doc_id", html_col).mapInArrow(rows, kinds)


def searchable(found: DataFrame) -> DataFrame:
    """Nodes of which the text can be searched."""
    return found.filter(F.col("tag").isin(SEARCHABLE) & (F.trim("text") != ""))


def breadcrumbs(found: DataFrame) -> DataFrame:
    """(doc_id, node_id, breadcrumb): where each node stands, from the page down."""
    if "breadcrumb" in found.columns:
        return found.select("doc_id", "node_id", "breadcrumb")
    n = (F.col("nth") + 1).cast("string")
    tag = F.col("tag")
    label = (
        F.when(tag == "page", F.concat(F.lit("Page "), F.col("page_num").cast("string"))).when(tag == "table", "Table").when(tag == "tr", F.concat(F.lit("Row "), n))
        .when(tag == "th", F.concat(F.lit("Header "), n)).when(tag == "td", F.concat(F.lit("Cell "), n)).when(tag.isin("h2", "h3"), F.concat(F.lit("Heading: "), F.substring("text", 1, 50)))
        .when(tag == "p", "Paragraph").when(tag == "figure", "Figure")
    )
    steps = found.select("doc_id", "node_id", F.posexplode("path").alias("at", "up"))
    named = found.select("doc_id", F.col("node_id").alias("up"), label.alias("label"))
    parts = F.array_sort(F.collect_list(F.when(F.col("label").isNotNull(), F.struct("at", "label"))))
    # the size of what a Python function gives isn't known to the planner: never broadcast it
    return steps.join(named.hint("merge"), ["doc_id", "up"]).groupBy("doc_id", "node_id").agg(F.array_join(F.transform(parts, lambda p: p["label"]), " > ").alias("breadcrumb"))


def subtree_texts(found: DataFrame, max_depth: int = DEEP) -> DataFrame:
    """(doc_id, node_id, subtree_text): a node's text and those below it, in order."""
    if "subtree_text" in found.columns and max_depth == DEEP:
        return found.select("doc_id", "node_id", "subtree_text")
    up = found.select("doc_id", F.col("node_id").alias("own"), "depth", "text", F.posexplode("path").alias("at", "node_id"))
    near = (F.trim("text") != "") & (F.col("depth") - F.col("at") <= max_depth)
    # each node is in its own path, so that a text-less one has its row without a join
    parts = F.array_sort(F.collect_list(F.when(near, F.struct("own", "text"))))
    there = F.max((F.col("own") == F.col("node_id")).cast("int")).alias("there")
    texts = up.groupBy("doc_id", "node_id").agg(F.array_join(F.transform(parts, lambda p: p["text"]), " ").alias("subtree_text"), there)
    return texts.filter("there = 1").select("doc_id", "node_id", "subtree_text")


def siblings(found: DataFrame, n: int = 3) -> DataFrame:
    """Nodes with ``preceding`` and ``following``: the ids of up to n siblings on each side."""
    if {"preceding", "following"} <= set(found.columns) and n <= NEAR:
        return found.withColumns({"preceding": F.slice("preceding", F.greatest(F.size("preceding") - n, F.lit(0)) + 1, n), "following": F.slice("following", 1, n)})
    order = Window.partitionBy("doc_id", "parent_id").orderBy("nth")
    root = F.col("parent_id").isNull()
    none = F.array().cast("array<bigint>")
    before, after = F.collect_list("node_id").over(order.rowsBetween(-n, -1)), F.collect_list("node_id").over(order.rowsBetween(1, n))
    return found.withColumns({"preceding": F.when(root, none).otherwise(before), "following": F.when(root, none).otherwise(after)})
