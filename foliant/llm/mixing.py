"""Mixing sources to target weights by systematic sampling.

Each source has a target share of the mixture's size, hence an expected number
of copies per document. Documents are taken in the order of a keyed hash; the
expected copies are summed up along it within the source, one random offset per
source is added, and a document is emitted once for each integer that its step
crosses. So a source's copies differ from their expectation by less than one,
and a document's from its own by less than one.

The sums are integers (2^-28 of a copy), so they come out the same however the
rows are distributed; only their fractions of a copy are summed, so they stay small
at any number of rows. A source of any size is summed in buckets of the hash,
about ``PER_BUCKET`` documents each, that start from the sum of the buckets
before: one shuffle of the documents, by bucket, and no task holds a source.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.llm.frames import col, fresh, without, written

_SHIFT = 28
UNIT = 1 << _SHIFT
#: Up to so many sources, what is known of them is broadcast.
MOST_BROADCAST = 50_000
PER_BUCKET = 2048
SEED = "foliant"
_HASH = 1 << 40


def _hash(text: Column) -> Column:
    """40 bits of MD5, which SQL engines share."""
    return F.conv(F.substring(F.md5(text), 1, 10), 16, 10).cast("long")


def per_source(steps: DataFrame) -> DataFrame:
    """One row per source: broadcast if they are few, else a table to join with."""
    few = steps.limit(MOST_BROADCAST + 1).collect()
    if len(few) <= MOST_BROADCAST:
        return F.broadcast(steps.sparkSession.createDataFrame(few, steps.schema))
    return written(steps)


def mix_sources(docs: DataFrame, weights: Mapping[str | None, int] | None = None, total: float = 1.0, seed: str = SEED, id_col: str = "doc_id", source_col: str = "source", size_col: str = "n_chars", text_col: str = "text", copy_col: str = "copy") -> DataFrame:
    """docs as the mixture, each row once per copy, with ``copy`` from 1.

    ``weights`` are whole numbers per source, in proportion to the shares of the
    mixture's size; sources that are not named get none, and without weights all
    sources get the same. ``total`` is the size of the mixture against that of
    docs. A size that is null or below 1 counts as 1. Rows without a source are a
    source of their own, None in ``weights``. Documents without an id are ordered by
    their size. Rows that are equal in id are ordered by size, then by their
    text's hash, and equal rows are drawn alike whichever comes first. Null, empty
    and very long texts are rows like others. An empty table gives none. A column of
    docs named ``copy_col`` gives way to the new one.
    """
    docs = without(docs, [copy_col])
    group, order, size, step, bucket, before, done, whole_copies, offset, buckets = fresh(docs, "m_group", "m_order", "m_size", "m_step", "m_bucket", "m_before", "m_done", "m_whole", "m_offset", "m_buckets")
    source, ident = col(source_col).cast("string"), col(id_col)
    length = F.greatest(F.coalesce(col(size_col).cast("long"), F.lit(1)), F.lit(1))
    rows = docs.withColumns({
        group: F.when(source.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), source)),
        order: _hash(F.concat(F.lit(f"{seed}|"), F.coalesce(ident.cast("string"), F.concat(F.lit("|"), length.cast("string"))))),
        size: length,
    })
    stats = rows.groupBy(group).agg(F.sum(size).alias("size"), F.count("*").alias("n"))
    if weights is None:
        share = F.lit(1)
    else:
        share = F.lit(0)
        for name, weight in weights.items():
            share = F.when(F.col(group) == ("" if name is None else f"={name}"), F.lit(int(weight))).otherwise(share)
    whole = stats.select(group, "size", "n", share.cast("long").alias("share"))
    sums = whole.agg(F.sum("size").alias("all"), F.sum("share").alias("shares"))
    # doubles: whole products of shares and sizes pass 2^63
    number = lambda c: F.col(c).cast("double")
    expected = F.floor(number("share") * number("all") * F.lit(float(total)) / (number("shares") * number("size")) * F.lit(float(UNIT))).cast("long")
    steps = whole.crossJoin(sums).filter("share > 0").select(
        group,
        F.shiftright(expected, _SHIFT).alias(whole_copies),
        expected.bitwiseAND(UNIT - 1).alias(step),
        (_hash(F.concat(F.lit(f"{seed}|offset|"), F.col(group))) % UNIT).alias(offset),
        F.greatest(F.ceil(F.col("n") / PER_BUCKET), F.lit(1)).alias(buckets),
    )
    steps = per_source(steps)
    slot = F.floor(col(order).cast("double") / F.lit(float(_HASH)) * col(buckets)).cast("long")
    placed = rows.join(steps, group).withColumn(bucket, slot)
    per = rows.select(group, order).join(steps, group).groupBy(group, slot.alias(bucket), offset).agg(F.sum(step).bitwiseAND(UNIT - 1).alias("sum"))
    ahead = Window.partitionBy(group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    starts = per.select(group, bucket, ((F.coalesce(F.sum("sum").over(ahead), F.lit(0)) + col(offset)).bitwiseAND(UNIT - 1)).alias(before))
    run = Window.partitionBy(group, bucket).orderBy(col(order), ident, col(size), F.xxhash64(col(text_col)))
    summed = placed.drop(offset, buckets).join(starts, [group, bucket]).withColumn(done, col(before) + F.sum(step).over(run.rowsBetween(Window.unboundedPreceding, 0)))
    copies = col(whole_copies) + F.shiftright(col(done), _SHIFT) - F.shiftright(col(done) - col(step), _SHIFT)
    return summed.select(*[col(c) for c in docs.columns], copies.alias(before)).filter(col(before) > 0).select(*[col(c) for c in docs.columns], F.explode(F.sequence(F.lit(1).cast("long"), col(before))).alias(copy_col))


ORACLE = f"""
WITH r AS (
  SELECT *, greatest(coalesce(n_chars, 1), 1) AS sz, CASE WHEN source IS NULL THEN '' ELSE '=' || source END AS g,
    ('0x' || substr(md5('{SEED}|' || coalesce(doc_id::VARCHAR, '|' || greatest(coalesce(n_chars, 1), 1))), 1, 10))::BIGINT AS o
  FROM documents
), s AS (
  SELECT g, sum(sz)::BIGINT AS size FROM r GROUP BY g
), t AS (
  SELECT sum(size)::BIGINT AS whole, count(*)::BIGINT AS shares FROM s
), e AS (
  SELECT g, floor(whole::DOUBLE * 1.0::DOUBLE / (shares * size)::DOUBLE * {UNIT}::DOUBLE)::BIGINT AS step,
    ('0x' || substr(md5('{SEED}|offset|' || g), 1, 10))::BIGINT % {UNIT} AS u
  FROM s, t
), p AS (
  SELECT r.*, step, u + sum(step) OVER (PARTITION BY g ORDER BY o, doc_id NULLS FIRST, sz, text ROWS UNBOUNDED PRECEDING) AS done
  FROM r JOIN e USING (g)
)
SELECT doc_id, text, lang, source, n_chars, copy::BIGINT AS copy
FROM p, range(1, (done // {UNIT} - (done - step) // {UNIT})::BIGINT + 1) AS c(copy)
"""
