"""The corpus pipeline: documents in, token ids of the mixture out.

Each stage reads what the one before it wrote and works on all of it; all but
the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from foliant.llm.bpe import encode
from foliant.llm.frames import fresh, removed, table, written
from foliant.llm.language import keep_identified
from foliant.llm.mixing import mix_sources
from foliant.llm.pseudonyms import pseudonymise
from foliant.llm.queries import KEY
from foliant.llm.simhash import drop_near_duplicates

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the labelled languages; what is in none goes.

    So do texts that are null, empty or without a letter. The language found takes
    the label's place. Repeated rows stay; of equal languages the first by name is
    taken; long texts are parsed whole; an empty table stays empty; all other
    columns stay as they are, whatever their names.
    """
    return keep_identified(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the least id.

    Of rows equal in id and text one stays, whichever. Null ids come last. A null
    text is nobody's copy; empty texts and others without a word are copies where
    they are equal; long texts count whole. An empty table stays empty; columns
    stay as they are, whatever their names.
    """
    return drop_near_duplicates(docs)


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their personal data replaced.

    Null and empty texts stay; repeated rows give equal results; long texts are
    read whole; an empty table stays empty; all other columns stay as they are. The
    key is the one of the tests and the driver's queries: pass another with real data.
    """
    return pseudonymise(docs, KEY)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture of sources in equal shares; a document appears once per copy.

    Rows without a source are a source of their own; a null size counts as 1; ties
    in the order of drawing go by id, size and text; repeated rows are drawn one by
    one; texts don't matter. An empty table stays empty; columns stay as they are,
    whatever their names.
    """
    (number,) = fresh(docs, "copy")
    return mix_sources(docs, copy_col=number).drop(number)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, exact): the token ids of every row.

    A null text has null ids, an empty one none; repeated rows give equal results;
    long texts are encoded whole; an empty table gives none; other columns go.
    """
    return encode(docs)


STAGES: list[tuple[str, Stage]] = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("pseudonyms", pseudonyms),
    ("mixture", mixture),
    ("tokens", tokens),
]

#: No SQL: language identification and SimHash have none.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. A stage's table goes when the next one is written."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        after = written(stage(spark, docs, sf_dir))
        if k:
            removed(spark, docs)
        docs = after
    return STAGES[-1][1](spark, docs, sf_dir)
