"""From ranked hits to answers: prompts, a model's replies, citations, and routing.

A model is a callable that takes a prompt and gives a reply; it runs in the
workers, over batches of prompts. Without one the prompts are made all the same.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.operators import hits as H

Client = Callable[[str], str]

SYSTEM = (
    "You know the whole document. Answer from the context alone.\n"
    "1. Use nothing that isn't in the context.\n2. Name pages, as in '(p.3)'.\n"
    "3. If the context doesn't say, say so.\n4. Keep terms, codes and names of forms as they are.\n5. Be brief and complete."
)
SMALL = "The document is short: read it as a whole before you answer."
SYNTHESIS = "Put the notes below into one answer. Keep what they cite.\n\n{notes}"
REFLECTION = "Is this answer complete and backed by the context? Name what is missing, or say 'complete'.\n\n{answer}"
COMPACTION = "Shorten the conversation below to what the next answer needs.\n\n{history}"
NOT_FOUND = "No document fits the question."
NO_CLIENT = "[no model is configured]"


def system_prompt(total_pages: int, small: int = 30) -> str:
    return f"{SYSTEM}\n\n{SMALL}" if 0 < total_pages <= small else SYSTEM


def replied(prompts: DataFrame, client: Client | None, prompt_col: str = "prompt", reply_col: str = "reply", error_col: str = "error") -> DataFrame:
    """prompts with a model's replies, trimmed, and what went wrong, where it did."""
    if client is None:
        return prompts.withColumns({reply_col: F.lit(None).cast("string"), error_col: F.lit("no_llm_client")})
    k = prompts.columns.index(prompt_col)
    kinds = T.StructType([*prompts.schema.fields, T.StructField(reply_col, T.StringType()), T.StructField(error_col, T.StringType())])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            replies, errors = [], []
            for prompt in batch.column(k).to_pylist():
                try:
                    replies.append((client(prompt) or "").strip())
                    errors.append(None)
                except Exception as e:  # noqa: BLE001  a service's failure is data here
                    replies.append(None)
                    errors.append(str(e)[:500])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(replies, pa.string()), pa.array(errors, pa.string())], names=kinds.fieldNames())

    return prompts.mapInArrow(ask, kinds)


def prompts(hits: DataFrame, queries: DataFrame, turns: DataFrame | None = None, most: int = 25_000, pairs: int = 8) -> DataFrame:
    """(query_id, query, prompt, context_chars): context, the conversation so far, the question.

    hits: (query_id, page_num, text, pos); queries: (query_id, query) and, with turns
    (conv_id, turn, role, text), conv_id. A query without hits has an empty context.
    """
    asked = queries.join(H.context(hits, most), "query_id", "left").withColumn("context", F.coalesce("context", F.lit("")))
    said = F.lit("")
    if turns is not None:
        line = F.concat("role", F.lit(": "), F.coalesce("text", F.lit("")))
        recent = H.history(turns, pairs).groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", line.alias("line")))), lambda x: x["line"]), "\n").alias("said"))
        asked = asked.join(recent, "conv_id", "left")
        said = F.when(F.length("said") > 0, F.concat(F.lit("=== CONVERSATION ===\n"), F.col("said"), F.lit("\n\n"))).otherwise("")
    prompt = F.concat(said, F.lit("=== CONTEXT ===\n"), F.col("context"), F.lit("\n=== END ===\n\nQuestion: "), F.col("query"), F.lit("\nAnswer:"))
    return asked.select("query_id", "query", prompt.alias("prompt"), F.length("context").alias("context_chars"))


def citations(hits: DataFrame) -> DataFrame:
    """(query_id, citations): page, channel and score of every hit with a page, in order."""
    one = F.struct("pos", "page_num", "channel", "score")
    listed = F.array_sort(F.collect_list(F.when(F.col("page_num").isNotNull(), one)))
    return hits.groupBy("query_id").agg(F.transform(listed, lambda c: F.struct(c["page_num"].alias("page_num"), c["channel"].alias("channel"), c["score"].alias("score"))).alias("citations"))


def synthesise(hits: DataFrame, queries: DataFrame, client: Client | None, turns: DataFrame | None = None, most: int = 25_000) -> DataFrame:
    """(query_id, answer, citations, context_chars).

    Without a model, or where it fails, the answer says so and cites nothing. A hit
    whose channel is ``agent_loop`` is an answer already and passes through.
    """
    asked = replied(prompts(hits, queries, turns, most), client)
    ready = hits.filter(F.col("channel") == "agent_loop").groupBy("query_id").agg(F.max_by("text", "score").alias("ready"))
    both = asked.join(ready, "query_id", "left").join(citations(hits), "query_id", "left")
    answer = F.coalesce("ready", F.when(F.col("error") == "no_llm_client", NO_CLIENT).when(F.col("error").isNotNull(), F.concat(F.lit("[synthesis error: "), F.col("error"), F.lit("]"))).otherwise(F.col("reply")))
    none = F.array().cast("array<struct<page_num:bigint,channel:string,score:double>>")
    kept = F.when(F.col("error").isNull() | F.col("ready").isNotNull(), F.col("citations").cast("array<struct<page_num:bigint,channel:string,score:double>>"))
    return both.select("query_id", answer.alias("answer"), F.coalesce(kept, none).alias("citations"), "context_chars")


def agent_loop(queries: DataFrame, engine: Client | None) -> DataFrame:
    """(query_id, chunk_id, channel, score, text): an outside engine's answer as the one hit of a
    query, with score 1, or its failure with score 0; no engine, no hits."""
    asked = replied(queries.withColumn("prompt", F.col("query")), engine)
    out = asked.select("query_id", F.lit("agent_answer").alias("chunk_id"), F.lit("agent_loop").alias("channel"), F.when(F.col("error").isNull(), 1.0).otherwise(0.0).alias("score"), F.coalesce("reply", F.concat(F.lit("[agent error: "), F.col("error"), F.lit("]"))).alias("text"))
    return out.filter("false") if engine is None else out


# -- several documents


def registered(metas: DataFrame, removed: DataFrame | None = None) -> DataFrame:
    """Documents (doc_id, ord, …) in the order in which they were added: of one that was added
    again the later row counts, at its first place; what was removed (doc_id) goes."""
    by = Window.partitionBy("doc_id")
    last = metas.withColumns({"first": F.min("ord").over(by), "final": F.max("ord").over(by)}).filter(F.col("ord") == F.col("final"))
    out = last.withColumn("ord", F.col("first")).drop("first", "final")
    return out if removed is None else out.join(removed.select("doc_id"), "doc_id", "left_anti")


def document_list(metas: DataFrame, most: int = 25_000) -> DataFrame:
    """(text): all documents for a router's prompt, in order, cut to ``most`` signs.

    metas: (doc_id, ord, name, title, summary, top_entities, total_pages). Only as many
    documents are gathered as fit, a line of each having 60 signs at least.
    """
    line = F.concat(F.lit("- id="), F.col("doc_id").cast("string"), F.lit(' title="'), F.coalesce(F.nullif(F.col("title"), F.lit("")), "name"), F.lit('"\n  summary: '), F.substring(F.coalesce("summary", F.lit("")), 1, 300), F.lit("\n  entities: "), F.array_join(F.slice(F.coalesce("top_entities", F.array().cast("array<string>")), 1, 8), ", "), F.lit("\n  pages: "), F.col("total_pages").cast("string"))
    few = metas.orderBy("ord").limit(most // 40 + 1).select("ord", line.alias("line"))
    whole = few.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "line"))), lambda x: x["line"]), "\n").alias("text"))
    return whole.select(F.when(F.length("text") > most, F.concat(F.substring("text", 1, most), F.lit("\n... (truncated)"))).otherwise(F.col("text")).alias("text"))


def router_prompts(queries: DataFrame, metas: DataFrame, picks: int = 3, most: int = 25_000) -> DataFrame:
    """(query_id, prompt): which documents a question is about; the list of them is one bounded row."""
    listed = F.broadcast(document_list(metas, most))
    text = F.concat(F.lit("Question: "), F.col("query"), F.lit("\n\nAvailable documents:\n"), F.col("text"), F.lit(f'\n\nPick up to {picks} most relevant ids.\nReply with a JSON array, as in ["id1", "id2"].'))
    return queries.crossJoin(listed).select("query_id", text.alias("prompt"))


def first_documents(queries: DataFrame, metas: DataFrame, picks: int = 3) -> DataFrame:
    """(query_id, doc_id, place): what is picked where no model can be asked."""
    few = metas.orderBy("ord").limit(picks)
    place = (F.row_number().over(Window.orderBy("ord")) - 1).alias("place")
    return queries.select("query_id").crossJoin(F.broadcast(few.select("doc_id", place)))


def combined(answers: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, answer, picked): one answer per query from those of the documents picked.

    answers: (query_id, doc_id, place, answer, error). One stands as it is, several
    stand under their documents' names, in order; none says that none was found.
    """
    text = F.coalesce("answer", F.concat(F.lit("[error in "), F.col("doc_id").cast("string"), F.lit(": "), F.coalesce("error", F.lit("")), F.lit("]")))
    titled = F.concat(F.lit("## From document "), F.col("doc_id").cast("string"), F.lit("\n"), text)
    parts = F.array_sort(F.collect_list(F.struct("place", text.alias("text"), titled.alias("titled"), F.col("doc_id").cast("string").alias("doc"))))
    made = answers.groupBy("query_id").agg(parts.alias("ps"))
    one = F.when(F.size("ps") == 1, F.col("ps")[0]["text"]).otherwise(F.array_join("ps.titled", "\n\n"))
    whole = queries.select("query_id").join(made.select("query_id", one.alias("answer"), F.col("ps.doc").alias("picked")), "query_id", "left")
    return whole.select("query_id", F.coalesce("answer", F.lit(NOT_FOUND)).alias("answer"), F.coalesce("picked", F.array().cast("array<string>")).alias("picked"))
