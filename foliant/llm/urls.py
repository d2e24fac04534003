"""URL filters: a blocked Bloom filter in front of an exact hash join.

URLs are made canonical, hashed, and tested against a filter of blocks of 256
bits: the hash names a block and one bit in each of its eight words of 32. Only
rows that the filter lets pass meet the list itself, in a hash join on the
canonical URL, which removes the false positives.

The filter is a table of (block, four longs) made by one grouped ``bit_or``. It
is broadcast while it has at most ``MOST_BLOCKS`` blocks; beyond that the same
probe is a shuffled join on the block. The list is made canonical once and written;
pages are read once. Everything stays in the JVM.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.llm.frames import col, fresh, without, written

#: Listed URLs per block of 256 bits: about one false positive in a thousand.
PER_BLOCK = 16
MOST_BLOCKS = 1 << 19
#: Query parameters that name a visit, not a page.
TRACKING = r"^(utm_[^=]*|ref|fbclid|gclid|mc_cid|mc_eid)(=|$)"
HEAD = r"^[ \t]*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)(?::([0-9]*))?"
LISTED = r"(^|\.)spam-[a-z0-9-]*\."


def host(url: Column) -> Column:
    """The host in lower case, without ``www.`` and a final dot; null if none."""
    found = F.regexp_extract(url, HEAD, 1)
    return F.when(found != "", F.regexp_replace(F.lower(found), r"^www\.|\.$", ""))


def canonical(url: Column) -> Column:
    """One spelling for a page's URLs; null where there is no host.

    The scheme, user, default ports, fragment, tracking parameters, a final
    slash and an index file go; parameters are sorted; the path keeps its case.
    """
    rest = F.regexp_replace(F.regexp_replace(url, HEAD, ""), r"#[\s\S]*$|[ \t]+$", "")
    path = F.regexp_replace(F.regexp_replace(F.regexp_replace(rest, r"\?[\s\S]*$", ""), r"/index\.(html?|php)$", "/"), r"/+$", "")
    found = F.split(F.regexp_replace(rest, r"^[^?]*\??", ""), "&")
    kept = F.array_sort(F.filter(found, lambda p: (p != "") & ~p.rlike(TRACKING)))
    port = F.regexp_extract(url, HEAD, 2)
    tail = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")
    return F.concat(host(url), F.when(port.isin("", "80", "443"), "").otherwise(F.concat(F.lit(":"), port)), path, tail)


def _mask(h: Column, word: int) -> Column:
    """The bits of a hash in one of its block's longs, one in each half."""
    bits = [F.shiftrightunsigned(h, 10 * word + 5 * half).bitwiseAND(31) + 32 * half for half in (0, 1)]
    return reduce(lambda a, b: a.bitwiseOR(b), (F.call_function("shiftleft", F.lit(1).cast("long"), b.cast("int")) for b in bits))


def bloom(listed: DataFrame, key: str, blocks: int) -> DataFrame:
    """(block, w0..w3) of a column's values; ``blocks`` in all, empty ones left out."""
    h = F.xxhash64(F.lit("bits"), col(key))
    block = F.pmod(F.xxhash64(F.lit("block"), col(key)), F.lit(blocks))
    return listed.groupBy(block.alias("block")).agg(*[F.bit_or(_mask(h, w)).alias(f"w{w}") for w in range(4)])


def filter_urls(pages: DataFrame, listed: DataFrame, url_col: str = "url", listed_col: str = "url", per_block: int = PER_BLOCK, most_blocks: int = MOST_BLOCKS) -> DataFrame:
    """pages with ``canonical_url`` and ``listed``, whether the list has it.

    Both sides are made canonical. A null, empty or hostless URL has a null
    canonical URL and is not listed; neither is anything if the list is empty; no
    pages give none. Repeated rows stay, repeated list entries count once. Long URLs
    and texts are kept whole. Columns of pages with the new names give way to them.
    """
    pages = without(pages, ["canonical_url", "listed"])
    names = written(listed.select(canonical(col(listed_col)).alias("l_url")).filter("l_url is not null").distinct())
    blocks = max(1, -(-names.count() // per_block))
    made = bloom(names, "l_url", blocks)
    if blocks <= most_blocks:
        made = F.broadcast(made)
    row, block, *words = fresh(pages, "u_row", "u_block", "u_w0", "u_w1", "u_w2", "u_w3")
    made = made.select(F.col("block").alias(block), *[F.col(f"w{k}").alias(w) for k, w in enumerate(words)])
    rows = pages.withColumn("canonical_url", canonical(col(url_col)))
    h = F.xxhash64(F.lit("bits"), F.col("canonical_url"))
    place = F.when(F.col("canonical_url").isNotNull(), F.pmod(F.xxhash64(F.lit("block"), F.col("canonical_url")), F.lit(blocks)))
    probed = rows.withColumn(block, place).join(made, block, "left")
    inside = reduce(lambda a, b: a & b, (col(w).bitwiseAND(_mask(h, k)) == _mask(h, k) for k, w in enumerate(words)))
    # what the filter stops gets a key of its own that no URL is: spread, and without a match
    passed = F.when(F.coalesce(inside, F.lit(False)), F.col("canonical_url"))
    plain = [c for c, kind in pages.dtypes if c == url_col or kind in ("string", "bigint", "int", "double", "timestamp")]
    own = F.concat(F.lit("\x00"), F.xxhash64(*[col(c) for c in plain]).cast("string"))
    keyed = probed.withColumn(row, F.coalesce(passed, own)).drop(block, *words)
    exact = names.select(F.col("l_url").alias(row), F.lit(True).alias("listed"))
    return keyed.join(exact, row, "left").withColumn("listed", F.coalesce("listed", F.lit(False))).drop(row)


def spam_list(pages: DataFrame, url_col: str = "url", pattern: str = LISTED) -> DataFrame:
    """The list of the driver's query: URLs on hosts that call themselves spam."""
    return pages.filter(host(col(url_col)).rlike(pattern)).select(col(url_col).alias("url"))


_REST = rf"regexp_replace(regexp_replace(url, '{HEAD}', ''), '#[\s\S]*$|[ \t]+$', '')"
ORACLE = rf"""
WITH p AS (
  SELECT page_id, url, {_REST} AS rest, regexp_extract(url, '{HEAD}', 2) AS port,
    nullif(regexp_replace(lower(regexp_extract(url, '{HEAD}', 1)), '^www\.|\.$', '', 'g'), '') AS host
  FROM pages
), q AS (
  SELECT *, regexp_replace(regexp_replace(regexp_replace(rest, '\?[\s\S]*$', ''), '/index\.(html?|php)$', '/'), '/+$', '') AS path,
    list_sort(list_filter(string_split(regexp_replace(rest, '^[^?]*\??', ''), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '{TRACKING}'))) AS kept
  FROM p
), c AS (
  SELECT page_id, url, host, host || CASE WHEN port IN ('', '80', '443') THEN '' ELSE ':' || port END || path
    || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END AS canonical_url
  FROM q
)
SELECT page_id, url, canonical_url,
  coalesce(canonical_url IN (SELECT canonical_url FROM c WHERE canonical_url IS NOT NULL AND regexp_matches(host, '{LISTED}')), false) AS listed
FROM c
"""
