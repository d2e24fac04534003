"""Rows and columns from the places of text items on a page, and HTML from them.

items: (page, top, left, text), more columns as they come; for HTML also height and
bold. Items are brought together by page once, where they aren't yet, and ordered by
page and left; whole pages, many at a time, are worked on as Arrow columns. A worker
holds some 65,536 items, or one page.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_ITEMS, _BYTES = 1 << 16, 64 << 20
_SHOWN = ("width", "height", "text", "bold")
_Kernel = Callable[[pa.Table, np.ndarray], pa.Table]


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """(items of whole pages, where each page begins) of batches in order of pages."""
    held: list[pa.RecordBatch] = []
    rows = size = 0

    def out() -> tuple[pa.Table, np.ndarray]:
        items = pa.Table.from_batches(held).combine_chunks()
        return items.drop_columns(["_nth"]), np.flatnonzero(items["_nth"].to_numpy() == 1)

    for batch in batches:
        rows, size = rows + batch.num_rows, size + batch.nbytes
        begins = np.flatnonzero(batch.column("_nth").to_numpy() == 1) if rows >= _ITEMS or size >= _BYTES else []
        if len(begins):
            held.append(batch.slice(0, begins[-1]))
            if rows > batch.num_rows or begins[-1]:
                yield out()
            batch = batch.slice(begins[-1])
            held, rows, size = [], batch.num_rows, batch.nbytes
        held.append(batch)
    if rows:
        yield out()


def _by_page(items: DataFrame, kernel: _Kernel, schema: str) -> DataFrame:
    """What a kernel makes of whole pages; of items it takes the columns there are."""
    # the window keeps a page in one task, and tells where it begins whatever its type
    marked = items.withColumn("_nth", F.row_number().over(Window.partitionBy("page").orderBy("_left")))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole, begins in _whole(batches):
            yield from kernel(whole, begins).to_batches()

    return marked.mapInArrow(work, schema)


def _numbers(items: DataFrame, *more: str) -> DataFrame:
    """page, ``_top`` and ``_left`` as doubles, and more columns."""
    return items.select("page", F.col("top").cast("double").alias("_top"), F.col("left").cast("double").alias("_left"), *more)


def _typed(items: DataFrame, *more: str) -> str:
    return ", ".join([f"page {items.schema['page'].dataType.simpleString()}", *more])


def _array(whole: pa.Table, name: str) -> pa.Array:
    found = whole[name]
    return found.chunk(0) if found.num_chunks else pa.array([], found.type)


def _doubles(whole: pa.Table, name: str) -> tuple[np.ndarray, np.ndarray]:
    """(numbers, which are null)."""
    found = _array(whole, name)
    return found.to_numpy(zero_copy_only=False), found.is_null().to_numpy(zero_copy_only=False)


def _edges(new: np.ndarray) -> np.ndarray:
    """Where runs begin, and the end, of marks where they do; the first is one."""
    return np.append(np.flatnonzero(new), len(new))


def _changes(*columns: np.ndarray) -> np.ndarray:
    new = np.ones(len(columns[0]), dtype=bool)
    new[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    return new


class _Places:
    """Rows and columns of the items of whole pages, which come in order of page and left."""

    def __init__(self, whole: pa.Table, begins: np.ndarray) -> None:
        self.whole, self.begins = whole, begins
        self.page = np.repeat(np.arange(len(begins)), np.diff(np.append(begins, whole.num_rows)))

    def rows(self, tolerance: float) -> tuple[np.ndarray, np.ndarray]:
        """(top of each item's row, which items have none)."""
        top, null = _doubles(self.whole, "_top")
        out, there = np.full(len(top), np.nan), np.flatnonzero(~null)
        order = there[np.lexsort((top[there], self.page[there]))]
        t, p = top[order], self.page[order]
        new = np.ones(len(t), dtype=bool)
        with np.errstate(invalid="ignore"):
            new[1:] = (p[1:] != p[:-1]) | ~((np.diff(t) <= tolerance) | (t[1:] == t[:-1]) | (np.isnan(t[1:]) & np.isnan(t[:-1])))
        edges = _edges(new)
        first = np.repeat(t[edges[:-1]], np.diff(edges))
        # runs of items, each near the one before, that reach beyond their first row
        for k in np.unique(np.searchsorted(edges, np.flatnonzero(t - first > tolerance), side="right")) - 1:
            low, high = edges[k], edges[k + 1]
            anchor, anchors = t[low], []
            for x in t[low:high].tolist():
                if x - anchor > tolerance:
                    anchor = x
                anchors.append(anchor)
            first[low:high] = anchors
        out[order] = first
        return out, null

    def columns(self, gap: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(page, number, mean left) of columns; lefts that are null are one without a mean."""
        left, null = _doubles(self.whole, "_left")
        new = np.ones(len(left), dtype=bool)
        with np.errstate(invalid="ignore"):
            new[1:] = (null[1:] != null[:-1]) | ~null[1:] & ~((np.diff(left) <= gap) | (left[1:] == left[:-1]) | (np.isnan(left[1:]) & np.isnan(left[:-1])))
        new[self.begins] = True
        edges = _edges(new)
        page = self.page[edges[:-1]]
        at = np.searchsorted(page, np.arange(len(self.begins)))
        mean = np.add.reduceat(left, edges[:-1]) / np.diff(edges) if len(left) else left
        return page, np.arange(len(page)) - at[page], mean

    def nearest(self, gap: float) -> tuple[np.ndarray, np.ndarray]:
        """(number of each item's nearest column, the first of equally near ones; columns of each page).

        A page with an item that has no left has all its items in the first column.
        """
        page, number, mean = self.columns(gap)
        mean = np.trunc(mean)
        left, null = _doubles(self.whole, "_left")
        n = len(mean)
        order = np.lexsort((np.arange(n + len(left)) >= n, np.concatenate([mean, left]), np.concatenate([page, self.page])))
        lower = np.maximum.accumulate(np.where(order < n, order, -1))[order >= n]
        item = order[order >= n] - n
        low, up = np.empty(len(left), np.int64), np.empty(len(left), np.int64)
        low[item], up[item] = lower, np.minimum(lower + 1, n - 1)
        equal = _edges(_changes(page, mean))
        low = np.repeat(equal[:-1], np.diff(equal))[np.maximum(low, 0)]
        far = np.where(page[up] == self.page, np.abs(mean[up] - left), np.inf)
        near = np.where(page[low] == self.page, np.abs(mean[low] - left), np.inf)
        out = number[np.where(near <= far, low, up)]
        out[np.isin(self.page, self.page[null])] = 0
        return out, np.bincount(page, minlength=len(self.begins))


def _join(texts: pa.Array, edges: np.ndarray, separator: str) -> pa.Array:
    """Texts between edges, joined; nulls are left out."""
    if texts.null_count:
        edges = np.concatenate([[0], np.cumsum(texts.is_valid().to_numpy(zero_copy_only=False))])[edges]
        texts = texts.drop_null()
    return pc.binary_join(pa.LargeListArray.from_arrays(pa.array(edges, pa.int64()), texts), pa.scalar(separator, texts.type))


def _around(*parts: str | pa.Array) -> pa.Array:
    kind = pa.large_string()
    return pc.binary_join_element_wise(*[pa.scalar(p, kind) if isinstance(p, str) else p for p in parts], pa.scalar("", kind))


def _sorted(whole: pa.Table, keys: list[np.ndarray], *more: str) -> np.ndarray:
    """Order of items by numbers, then left, width, height, text and more, nulls first."""
    names = ["_left", "width", "height", "text", *more]
    table = pa.table([pa.array(k) for k in keys] + [whole[n].cast(pa.int8()) if n == "bold" else whole[n] for n in names], names=[f"k{k}" for k in range(len(keys))] + names)
    return pc.sort_indices(table, sort_keys=[(n, "ascending") for n in table.column_names], null_placement="at_start").to_numpy()


def _marked(whole: pa.Table, tag: str) -> pa.Table:
    """With ``bold`` true or false, and ``mark``, the text in a tag if it is bold."""
    bold = pc.fill_null(_array(whole, "bold"), False)
    text = _array(whole, "text").cast(pa.large_string())
    return whole.set_column(whole.column_names.index("text"), "text", text).append_column("mark", pc.if_else(bold, _around(f"<{tag}>", text, f"</{tag}>"), text))


def _tables(places: _Places, tolerance: float, gap: float) -> tuple[np.ndarray, pa.Array]:
    """(pages, their rows and columns as tables)."""
    top, lost = places.rows(tolerance)
    column, width = places.nearest(gap)
    whole = _marked(places.whole, "b")
    # a row without a top counts as one that others can't go on, and isn't shown
    order = _sorted(whole, [places.page, np.where(lost, -np.inf, top), column], "mark")
    page, top, lost, column = places.page[order], top[order], lost[order], column[order]
    marks = _array(whole, "mark").take(pa.array(order))
    value = np.where(lost, -np.inf, top)
    cell = _changes(page, value, column)
    opens = _changes(page, value)
    edges = _edges(opens)
    begin = edges[:-1]
    used = np.add.reduceat(cell.astype(np.int64), begin)
    before = np.zeros(len(begin), dtype=bool)
    before[1:] = (page[begin][1:] == page[begin][:-1]) & ~lost[begin][:-1]
    goes_on = before & (column[begin] > 0) & (used <= np.maximum(2, width[page[begin]] // 2))
    row = np.repeat(np.cumsum(~goes_on), np.diff(edges))
    # cells of the joined rows: by column, the tops in their order
    order = np.lexsort((column, row))
    order = order[~lost[order]]
    page, row, column, marks = page[order], row[order], column[order], marks.take(pa.array(order))
    if not len(page):
        return np.empty(0, np.int64), pa.array([], pa.large_string())
    edges = _edges(_changes(row, column))
    begin = edges[:-1]
    bold = np.concatenate([[0], np.cumsum(pc.fill_null(pc.match_substring(marks, "<b>"), False).to_numpy(zero_copy_only=False))])
    head = pa.array((column[begin] == 0) & (bold[edges[1:]] > bold[begin]))
    tag = pc.if_else(head, pa.scalar("th", pa.large_string()), pa.scalar("td", pa.large_string()))
    lines = _around("    <", tag, ">", _join(marks, edges, " "), "</", tag, ">")
    # every row has a line per column of its page
    of = _edges(_changes(row[begin]))
    wide = width[page[begin][of[:-1]]]
    starts = np.concatenate([[0], np.cumsum(wide)])
    dense = np.full(starts[-1], len(lines))
    dense[np.repeat(starts[:-1], np.diff(of)) + column[begin]] = np.arange(len(lines))
    full = pa.concat_arrays([lines, pa.array(["    <td></td>"], pa.large_string())]).take(pa.array(dense))
    tr = _around("  <tr>\n", _join(full, starts, "\n"), "\n  </tr>")
    pages = page[begin][of[:-1]]
    edges = _edges(_changes(pages))
    return pages[edges[:-1]], _around("<table>\n", _join(tr, edges, "\n"), "\n</table>")


def _texts(places: _Places, tolerance: float) -> tuple[np.ndarray, pa.Array]:
    """(pages, their rows as paragraphs and headings)."""
    top, lost = places.rows(tolerance)
    height, none = _doubles(places.whole, "height")
    there = np.flatnonzero(~none)
    by = there[np.lexsort((height[there], places.page[there]))]
    count = np.bincount(places.page[by], minlength=len(places.begins))
    middle = np.cumsum(count) - count + count // 2
    median = np.where(count > 0, np.append(height[by], np.nan)[np.minimum(middle, len(by))], np.nan)
    whole = _marked(places.whole, "strong")
    value = np.where(lost, -np.inf, top)
    order = _sorted(whole, [places.page, value], "bold", "mark")
    page = places.page[order]
    edges = _edges(_changes(page, value[order]))
    one = order[edges[:-1]]
    bold = pc.fill_null(_array(whole, "bold"), False).to_numpy(zero_copy_only=False)[one]
    with np.errstate(invalid="ignore"):
        kind = np.where(bold, np.where(height[one] > median[page[edges[:-1]]], 1, 2), 0)
    tag = pa.array(["p", "h2", "h3"], pa.large_string()).take(pa.array(kind))
    lines = _around("<", tag, ">", _join(_array(whole, "mark").take(pa.array(order)), edges, " "), "</", tag, ">")
    pages = page[edges[:-1]]
    edges = _edges(_changes(pages))
    return pages[edges[:-1]], _join(lines, edges, "\n")


def _out(places: _Places, pages: np.ndarray, **columns: pa.Array) -> pa.Table:
    """A row per page, by its number among the pages at hand."""
    return pa.table({"page": _array(places.whole, "page").take(pa.array(places.begins[pages])), **columns})


def _are_tables(places: _Places, tolerance: float, gap: float) -> np.ndarray:
    """Which pages have four columns at least, and over 40 % of rows that use three."""
    top, lost = places.rows(tolerance)
    column, width = places.nearest(gap)
    value = np.where(lost, -np.inf, top)
    order = np.lexsort((column, value, places.page))
    page, value, column = places.page[order], value[order], column[order]
    begin = _edges(_changes(page, value))[:-1]
    used = np.add.reduceat(_changes(page, value, column).astype(np.int64), begin) if len(page) else page
    rows = np.bincount(page[begin], minlength=len(width))
    return (width >= 4) & (np.bincount(page[begin], used >= 3, len(width)) / rows > 0.4)


def rows(items: DataFrame, tolerance: int = 6) -> DataFrame:
    """Items with ``row_top``: the first top of their row.

    From the top down, an item within ``tolerance`` of its row's first top joins
    it, else it opens a row. Items without a page are left out.
    """
    return _with_places(items, tolerance, None)


def _with_places(items: DataFrame, tolerance: int, gap: int | None) -> DataFrame:
    numbered = items.filter("page is not null").withColumns({"_top": F.col("top").cast("double"), "_left": F.col("left").cast("double")})

    def kernel(whole: pa.Table, begins: np.ndarray) -> pa.Table:
        places = _Places(whole, begins)
        top, lost = places.rows(tolerance)
        out = whole.drop_columns(["_top", "_left"]).append_column("row_top", pa.array(top, mask=lost))
        return out if gap is None else out.append_column("col_no", pa.array(places.nearest(gap)[0]))

    added = ["row_top double"] + ([] if gap is None else ["col_no long"])
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema]
    return _by_page(numbered, kernel, ", ".join(kinds + added))


def columns(items: DataFrame, gap: int = 30) -> DataFrame:
    """(page, col_no, col_left): lefts no more than ``gap`` apart are a column, at their mean."""

    def kernel(whole: pa.Table, begins: np.ndarray) -> pa.Table:
        places = _Places(whole, begins)
        page, number, mean = places.columns(gap)
        null = _doubles(whole, "_left")[1][np.searchsorted(places.page, page)] & (number == 0)
        return _out(places, page, col_no=pa.array(number), mean=pa.array(mean, mask=null))

    found = _by_page(items.select("page", F.col("left").cast("double").alias("_left")), kernel, _typed(items, "col_no long", "mean double"))
    return found.select("page", "col_no", F.col("mean").cast("int").alias("col_left"))


def placed(items: DataFrame, tolerance: int = 6, gap: int = 30) -> DataFrame:
    """Items with ``row_top`` and the nearest column's ``col_no``, the first of equally near ones."""
    return _with_places(items, tolerance, gap)


def cells(items: DataFrame, tolerance: int = 6, gap: int = 30) -> DataFrame:
    """(page, row_top, col_no, n): how many items each place has."""

    def kernel(whole: pa.Table, begins: np.ndarray) -> pa.Table:
        places = _Places(whole, begins)
        top, lost = places.rows(tolerance)
        column = places.nearest(gap)[0]
        value = np.where(lost, -np.inf, top)
        order = np.lexsort((column, value, places.page))
        edges = _edges(_changes(places.page[order], value[order], column[order]))
        one = order[edges[:-1]]
        return _out(places, places.page[one], row_top=pa.array(top[one], mask=lost[one]), col_no=pa.array(column[one]), n=pa.array(np.diff(edges)))

    return _by_page(_numbers(items).filter("page is not null"), kernel, _typed(items, "row_top double", "col_no long", "n long"))


def table_pages(items: DataFrame) -> DataFrame:
    """(page, is_table): four columns at least, and over 40 % of rows use three."""

    def kernel(whole: pa.Table, begins: np.ndarray) -> pa.Table:
        places = _Places(whole, begins)
        return _out(places, np.arange(len(begins)), is_table=pa.array(_are_tables(places, 6, 30)))

    return _by_page(_numbers(items).filter("page is not null"), kernel, _typed(items, "is_table boolean"))


_XML = "struct<page:array<struct<_number:int,_width:int,_height:int,text:array<struct<_top:int,_left:int,_width:int,_height:int,_VALUE:string,b:array<string>>>>>>"


def text_items(documents: DataFrame, xml_col: str = "xml") -> DataFrame:
    """(doc_id, page, top, left, width, height, text, bold) of positional XML, a row per item with a text.

    documents: (doc_id, xml), the XML holding pages of ``text`` elements with their
    places; an item without a height has 12. Bold ones hold their text in ``b``.
    """
    read = F.from_xml(F.col(xml_col), _XML, {"rowTag": "pdf2xml", "mode": "PERMISSIVE"})
    pages = documents.select("doc_id", F.explode(read["page"]).alias("p")).select("doc_id", F.col("p._number").alias("page"), F.explode("p.text").alias("t"))
    bold = F.coalesce(F.size("t.b") > 0, F.lit(False))
    text = F.trim(F.concat(F.coalesce(F.col("t._VALUE"), F.lit("")), F.coalesce(F.array_join("t.b", ""), F.lit(""))))
    number = lambda c, d: F.coalesce(F.col(f"t.{c}"), F.lit(d))
    return pages.select("doc_id", "page", number("_top", 0).alias("top"), number("_left", 0).alias("left"), number("_width", 0).alias("width"), number("_height", 12).alias("height"), text.alias("text"), bold.alias("bold")).filter("text <> ''")


def table_html(items: DataFrame) -> DataFrame:
    """(page, html): a page's rows and columns as a table.

    A row without a first column, and with no more cells than half the columns or
    two, goes on the row before it. Bold cells of the first column are headers.
    """

    def kernel(whole: pa.Table, begins: np.ndarray) -> pa.Table:
        places = _Places(whole, begins)
        pages, html = _tables(places, 6, 30)
        return _out(places, pages, html=html.cast(pa.string()))

    return _by_page(_numbers(items, *_SHOWN).filter("page is not null"), kernel, _typed(items, "html string"))


def text_html(items: DataFrame) -> DataFrame:
    """(page, html): a page's rows as paragraphs and headings.

    A row that begins bold is a heading, of the higher kind if it is taller than the
    page's median item, the upper one of two.
    """

    def kernel(whole: pa.Table, begins: np.ndarray) -> pa.Table:
        places = _Places(whole, begins)
        pages, html = _texts(places, 6)
        return _out(places, pages, html=html.cast(pa.string()))

    return _by_page(_numbers(items, *_SHOWN).filter("page is not null"), kernel, _typed(items, "html string"))


def page_html(items: DataFrame) -> DataFrame:
    """(page, page_type, html): each page with an item as a section, a table or text."""

    def kernel(whole: pa.Table, begins: np.ndarray) -> pa.Table:
        places = _Places(whole, begins)
        table = _are_tables(places, 6, 30)
        made = []
        for kind in (True, False):
            of = np.flatnonzero(table == kind)
            if not len(of):
                continue
            mine = np.flatnonzero(table[places.page] == kind)
            part = whole if len(of) == len(table) else whole.take(pa.array(mine)).combine_chunks()
            own = _Places(part, np.searchsorted(places.page[mine], of))
            pages, html = _tables(own, 6, 30) if kind else _texts(own, 6)
            made.append(_out(own, pages, is_table=pa.array(np.full(len(pages), kind)), html=html.cast(pa.string())))
        return pa.concat_tables(made)

    both = _by_page(_numbers(items, *_SHOWN).filter("page is not null"), kernel, _typed(items, "is_table boolean", "html string"))
    kind, page = F.when(F.col("is_table"), "table").otherwise("text"), F.col("page").cast("string")
    html = F.concat(F.lit('<section id="page-'), page, F.lit('" data-page="'), page, F.lit('" data-type="'), kind, F.lit('">\n'), F.col("html"), F.lit("\n</section>"))
    return both.select("page", kind.alias("page_type"), html.alias("html"))


def crops(regions: DataFrame, dpi: int = 150) -> DataFrame:
    """Regions (page, left, top, right, bottom, in points) in pixels at a resolution; what leaves
    no area is dropped."""
    scale = lambda c, f: f(F.col(c) * F.lit(dpi / 72.0)).cast("int")
    out = regions.withColumns({"x0": scale("left", F.floor), "y0": scale("top", F.floor), "x1": scale("right", F.ceil), "y1": scale("bottom", F.ceil)})
    return out.filter("x1 > x0 and y1 > y0")


def zoom_regions(pages: DataFrame) -> DataFrame:
    """(page, region, left, top, right, bottom): the quarters and the centre of pages (page, width, height)."""
    w, h = F.col("width"), F.col("height")
    places = {"top_left": (0.0, 0.0), "top_right": (0.5, 0.0), "bottom_left": (0.0, 0.5), "bottom_right": (0.5, 0.5), "center": (0.25, 0.25)}
    parts = [F.struct(F.lit(n).alias("region"), (w * x).alias("left"), (h * y).alias("top"), (w * (x + 0.5)).alias("right"), (h * (y + 0.5)).alias("bottom")) for n, (x, y) in places.items()]
    return pages.select("page", F.explode(F.array(*parts)).alias("r")).select("page", "r.*")


def grid_places(pages: DataFrame, columns: int = 3, most: int = 10, width: int = 1000) -> DataFrame:
    """(page, row, column, x, cell_width): where the first pages stand in an overview of them."""
    nth = F.row_number().over(Window.partitionBy("doc_id").orderBy("page")) - 1
    cell = width // columns
    return pages.withColumn("nth", nth).filter(F.col("nth") < most).select("doc_id", "page", F.floor(F.col("nth") / columns).cast("int").alias("row"), (F.col("nth") % columns).alias("column"), ((F.col("nth") % columns) * cell).alias("x"), F.lit(cell).alias("cell_width"))
