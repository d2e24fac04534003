"""Tables in the folder that a cluster shares, where a plan's lineage ends; HTML that needs no parser."""

from __future__ import annotations

import re
import uuid
from html.parser import HTMLParser

from pyspark.sql import DataFrame


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table below the folder that spark.checkpoint.dir names.

    Where it is unset, which only a local session may leave so, a folder of the
    session's own is made and named there.
    """
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        import tempfile

        base = f"file://{tempfile.mkdtemp(prefix='foliant-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Tags that may stand without attributes in HTML that needs no parser.
_PLAIN = re.compile(r"<(/?(?:table|thead|tbody|tfoot|tr|td|th|br|p|b|i|h[1-6]|div|span|section|figure))>", re.I)


def plain_tags(html: str) -> list[str] | None:
    """Text, tag, text, tag, ... text of HTML that is nothing but a few tags without attributes,
    or None: then it takes a parser. ``html.parser`` gives the same, ten times slower."""
    if "&" in html:
        return None
    parts = _PLAIN.split(html)
    return parts if html.count("<") == len(parts) // 2 else None


def feed(parser: HTMLParser, html: str) -> None:
    """The whole of a text into a parser; plain HTML goes straight to its handlers."""
    parts = plain_tags(html)
    if parts is None:
        parser.feed(html)
        parser.close()
        return
    if parts[0]:
        parser.handle_data(parts[0])
    for k in range(1, len(parts), 2):
        tag = parts[k].lower()
        if tag[0] == "/":
            parser.handle_endtag(tag[1:])
        else:
            parser.handle_starttag(tag, [])
        if parts[k + 1]:
            parser.handle_data(parts[k + 1])
