"""Scalar text functions, all built-in expressions.

Null in, null out, unless said otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}_]+"
IDENTIFIER = r"[A-Za-z]*\p{Nd}+(?:[./\-]\p{Nd}+)*[A-Za-z]*"
CAPTION = r"(?imud)^(Hình|Bảng|Biểu|Sơ đồ|Figure|Table|Chart|Diagram)\s+(\p{Nd}+(?:\.\p{Nd}+)*)\s*[:.\-–—]\s*(.+)$"
FOOTNOTE = r"(?md)^(\(\p{Nd}{1,3}\)|\(\*+\)|\[\p{Nd}{1,3}\]|\*{1,3})\s+(.{5,200})$"
ELLIPSIS = r"(?i)<(t[dh])>\s*\.{3,}\s*</\1>"
RULE = "\n\n---\n\n"


def strip(text: Column | str) -> Column:
    """Without white space at either end, line breaks too."""
    return F.regexp_replace(F.col(text) if isinstance(text, str) else text, r"^\s+|\s+$", "")


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters, digits and underscores, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def identifiers(text: Column) -> Column:
    """Distinct tokens that hold a number (dates, codes, section numbers), two signs at least."""
    return F.array_distinct(F.filter(F.regexp_extract_all(text, F.lit(IDENTIFIER), F.lit(0)), lambda x: F.length(x) >= 2))


def entity_key(name: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_replace(name, r"^\s+|\s+$", "")), r"\s+", " ")


def captions(text: Column) -> Column:
    """Array of (kind, number, title) of caption lines."""
    parts = [F.regexp_extract_all(text, F.lit(CAPTION), F.lit(k)) for k in (1, 2, 3)]
    parts[2] = F.transform(parts[2], lambda x: F.trim(x))
    return F.arrays_zip(*[p.alias(n) for p, n in zip(parts, ("kind", "number", "title"))])


def tag_captions(text: Column) -> Column:
    return F.regexp_replace(text, CAPTION, "<!-- CAPTION: $1 $2 -->\n$0")


def footnotes(text: Column) -> Column:
    """Array of (marker, note) of footnote lines."""
    parts = [F.regexp_extract_all(text, F.lit(FOOTNOTE), F.lit(k)) for k in (1, 2)]
    parts[1] = F.transform(parts[1], lambda x: F.trim(x))
    return F.arrays_zip(parts[0].alias("marker"), parts[1].alias("note"))


def tag_footnotes(text: Column) -> Column:
    return F.regexp_replace(text, FOOTNOTE, "<!-- FOOTNOTE: $1 -->\n$0")


def tag_elements(text: Column) -> Column:
    """Captions, then footnotes, each under a comment that names it."""
    return tag_footnotes(tag_captions(text))


def answer_blocks(reply: Column) -> Column:
    """Array of (node_id, body) of a batched reply's ``BEGIN id=…`` to ``END`` blocks; END stands on a line of its own."""
    pattern = F.lit(r"(?msd)^\s*BEGIN id=(\S+)[^\n]*\n(.*?)^\s*END\s*$")
    return F.arrays_zip(F.regexp_extract_all(reply, pattern, F.lit(1)).alias("node_id"), F.regexp_extract_all(reply, pattern, F.lit(2)).alias("body"))


def ellipsis_cells(markdown: Column) -> Column:
    """How many table cells hold nothing but dots."""
    return F.size(F.regexp_extract_all(markdown, F.lit(ELLIPSIS), F.lit(0)))


def with_ellipsis_note(markdown: Column, raw: Column) -> Column:
    """Where cells were elided, a note, and the text layer if it has 50 signs."""
    n, layer = ellipsis_cells(markdown), F.trim(F.coalesce(raw, F.lit("")))
    note = F.concat(markdown, F.lit("\n\n> "), n.cast("string"), F.lit(" table cells were elided."))
    return F.when(n == 0, markdown).when(F.length(layer) >= 50, F.concat(note, F.lit("\n\n"), layer)).otherwise(note)


def rfind(text: Column, part: str) -> Column:
    """0-based place of the last occurrence, -1 if none."""
    back = F.instr(F.reverse(text), part[::-1])
    return F.when(back == 0, -1).otherwise(F.length(text) - back - len(part) + 1)


def smart_truncate(text: Column, most: int) -> Column:
    """At most ``most`` signs, cut at the last rule, else paragraph, else line, if
    that keeps 85 %; what was cut is said at the end."""
    window = F.substring(text, 1, most)
    least = int(most * 0.85)
    at = F.coalesce(*[F.when(rfind(window, sep) >= least, rfind(window, sep)) for sep in (RULE, "\n\n", "\n")], F.lit(most))
    kept = F.left(text, at)
    note = F.concat(F.lit("\n\n[... "), (F.length(text) - F.length(kept)).cast("string"), F.lit(" characters cut]"))
    return F.when(F.length(text) <= most, text).otherwise(F.concat(kept, note))


def page_of_chunk(chunk: Column) -> Column:
    """The page number in ``page_<n>``, null for other chunks."""
    return F.when(chunk.rlike(r"^page_[0-9]{1,9}$"), F.regexp_extract(chunk, r"^page_([0-9]+)$", 1).cast("int"))


def json_list(reply: Column) -> Column:
    """The first bracketed JSON array of strings in a model's reply; empty if bad."""
    return F.coalesce(F.from_json(F.regexp_extract(reply, r"(?s)\[.*?\]", 0), "array<string>"), F.array().cast("array<string>"))


def expansions(reply: Column) -> Column:
    """Query variants, a line each, without list numbers and quotes."""
    lines = F.filter(F.split(reply, "\n"), lambda x: F.length(F.trim(x)) > 5)
    return F.transform(lines, lambda x: F.regexp_replace(F.regexp_replace(F.trim(x), r"^[0-9.\-) ]+", ""), "^[\"']+|[\"']+$", ""))


def page_title(headings: Column, text: Column, page: Column) -> Column:
    """The first heading of more than three signs, else the first such line, else the number."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(x, r"^[#*\s]+|[#*\s]+$", ""))
    first = lambda a: F.get(F.filter(a, lambda x: F.length(x) > 3), F.lit(0))
    return F.coalesce(first(headings), F.substring(first(lines), 1, 100), F.concat(F.lit("Page "), page.cast("string")))


def template_row(cells: Column) -> Column:
    """Whether 70 % of a row's cells are blank or mere fillers; an empty row is one."""
    fill = F.filter(cells, lambda c: F.trim(F.coalesce(c, F.lit(""))).isin("", ".", "-", "_", "/"))
    return (F.size(cells) == 0) | (F.size(fill) >= 0.7 * F.size(cells))


def column_ref_row(cells: Column) -> Column:
    """Whether three cells or more are filled, 80 % of them a letter or a small number."""
    some = F.filter(F.transform(cells, lambda c: F.trim(F.coalesce(c, F.lit("")))), lambda c: c != "")
    refs = F.filter(some, lambda c: c.rlike("^([A-Za-z]|[0-9]{1,2})$"))
    return (F.size(some) >= 3) & (F.size(refs) >= 0.8 * F.size(some))
