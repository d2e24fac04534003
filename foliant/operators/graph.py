"""Entity graphs: parsing replies, merging, expanding, and paths."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.functions.text import entity_key


def parse_lines(responses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entities, relations) from pipe-separated reply lines of (doc_id, node_id, text)."""
    lines = responses.select("doc_id", "node_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    part = F.transform(F.split(F.trim("line"), r"\|"), lambda x: F.trim(x))
    cut = lines.select("doc_id", "node_id", "line_no", part.alias("p"))
    get = lambda k: F.get("p", F.lit(k))
    entities = cut.filter((get(0) == "ENTITY") & (F.size("p") >= 4) & (get(1) != ""))
    relations = cut.filter((get(0) == "REL") & (F.size("p") >= 5) & (get(1) != "") & (get(2) != ""))
    at = ["doc_id", "node_id", "line_no"]
    return (
        entities.select(*at, get(1).alias("name"), get(2).alias("entity_type"), get(3).alias("description")),
        relations.select(*at, get(1).alias("source"), get(2).alias("target"), get(3).alias("keywords"), get(4).alias("description")),
    )


def _first(name: str) -> F.Column:
    return F.min_by(name, F.struct("node_id", "line_no")).alias(name)


def _longest() -> F.Column:
    """The longest description, the first of equally long ones."""
    items = F.array_sort(F.collect_list(F.struct((-F.length("description")).alias("n"), "node_id", "line_no", "description")))
    return items[0]["description"]


def merge_entities(entities: DataFrame) -> DataFrame:
    """One row per name up to case and spaces: first name and type, longest
    description, all nodes."""
    return entities.withColumn("key", entity_key(F.col("name"))).groupBy("doc_id", "key").agg(
        _first("name"), _first("entity_type"), _longest().alias("description"),
        F.array_sort(F.collect_set("node_id")).alias("source_node_ids"),
    )


def merge_relations(relations: DataFrame) -> DataFrame:
    """One row per unordered pair; the first one's direction and keywords."""
    a, b = entity_key(F.col("source")), entity_key(F.col("target"))
    return relations.withColumns({"low": F.least(a, b), "high": F.greatest(a, b)}).groupBy("doc_id", "low", "high").agg(
        _first("source"), _first("target"), _first("keywords"), _longest().alias("description"),
        F.array_sort(F.collect_set("node_id")).alias("source_node_ids"),
    )


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).filter("src <> dst").distinct()


def neighbours(edges: DataFrame, seeds: DataFrame, hops: int = 2) -> DataFrame:
    """(seed, node, distance): what is reached in at most ``hops`` steps, once each.

    hops is a small constant, so the loop only builds the plan.
    """
    return reached(edges, seeds, hops).select("seed", "node", "distance")


def reached(edges: DataFrame, seeds: DataFrame, hops: int = 2) -> DataFrame:
    """(seed, node, distance, via): as neighbours, with the least node of the step before."""
    sides = both_ways(edges)
    start = seeds.select(F.col("node").alias("seed"), "node", F.lit(0).alias("distance"), F.lit(None).cast(seeds.schema["node"].dataType).alias("via")).distinct()
    walks = [start]
    for step in range(1, max(1, min(hops, 3)) + 1):
        grown = walks[-1].select("seed", F.col("node").alias("src")).join(sides, "src")
        walks.append(grown.groupBy("seed", F.col("dst").alias("node")).agg(F.min("src").alias("via")).withColumn("distance", F.lit(step)).select("seed", "node", "distance", "via"))
    # a walk that comes back is longer than the first one: the least distance is the true one
    every = walks[0]
    for walk in walks[1:]:
        every = every.unionByName(walk)
    best = every.groupBy("seed", "node").agg(F.min(F.struct("distance", "via")).alias("b"))
    return best.select("seed", "node", "b.distance", "b.via").filter("distance > 0")


def annotated_neighbours(entities: DataFrame, relations: DataFrame, names: DataFrame, hops: int = 2, most: int = 30) -> DataFrame:
    """(query_id, doc_id, entity, entity_type, edge_keywords, edge_description, distance, via,
    place): what is around the entity that each name (query_id, doc_id, name) means."""
    start = fuzzy_match(entities, names)
    pair = lambda doc, key: F.struct(F.col(doc).alias("d"), F.col(key).alias("k"))
    edges = relations.select(pair("doc_id", "low").alias("src"), pair("doc_id", "high").alias("dst"))
    found = reached(edges, start.select(pair("doc_id", "key").alias("node")).distinct(), hops)
    flat = start.select("query_id", pair("doc_id", "key").alias("seed")).join(found, "seed").select("query_id", F.col("node.d").alias("doc_id"), F.col("node.k").alias("entity"), "distance", F.col("via.k").alias("via"))
    known = flat.join(entities.select("doc_id", F.col("key").alias("entity"), "entity_type"), ["doc_id", "entity"], "left")
    edge = relations.select("doc_id", "low", "high", F.col("keywords").alias("edge_keywords"), F.col("description").alias("edge_description"))
    told = known.withColumns({"low": F.least("entity", "via"), "high": F.greatest("entity", "via")}).join(edge, ["doc_id", "low", "high"], "left").drop("low", "high")
    place = F.row_number().over(Window.partitionBy("query_id", "doc_id").orderBy("distance", "entity"))
    return told.withColumn("place", place).filter(F.col("place") <= most)


def _words(text: str) -> F.Column:
    return F.array_distinct(F.filter(F.split(F.lower(F.trim(F.col(text))), r"\s+"), lambda w: w != ""))


def fuzzy_match(entities: DataFrame, names: DataFrame) -> DataFrame:
    """(query_id, doc_id, key): the entity that a name means, if any.

    The same name; else the shortest that holds it; else the longest of three signs or
    more that it holds; else the first that shares two words and half of its words.
    Ties go by key.

    Each of these is an equi-join, and only names without an equal one go on: by the
    rarest of the shorter name's runs of three signs, or by all shared words but the
    most common, since two are shared. Runs multiply rows unseen by the planner, hence
    no broadcasts.
    """
    asked = names.select("query_id", "doc_id", F.lower(F.trim("name")).alias("q")).filter("q <> ''")
    keys = entities.select("doc_id", "key").distinct()
    n, q, at = F.col("key"), F.col("q"), ["query_id", "doc_id", "q"]
    tier = lambda t, by: F.struct(F.lit(t).alias("t"), by.cast("int").alias("n")).alias("tier")
    same = asked.join(keys.withColumn("q", n).hint("merge"), ["doc_id", "q"]).select("query_id", "doc_id", "key", tier(0, F.lit(0)))
    rest = asked.join(same.select("query_id", "doc_id").distinct().hint("merge"), ["query_id", "doc_id"], "left_anti").distinct()
    # names of fewer than three signs are looked up whole
    key_runs = keys.select("doc_id", "key", F.explode(F.array_distinct(F.flatten(F.array(*[F.coalesce(_grams("key", k), F.array().cast("array<string>")) for k in (1, 2, 3)])))).alias("gram"))
    q_runs = rest.select(*at, F.explode(F.when(F.length("q") >= 3, _grams("q", 3)).otherwise(F.array("q"))).alias("gram"))
    rarest = lambda runs, other, by: runs.join(other.groupBy("doc_id", "gram").agg(F.count("*").alias("n")).hint("merge"), ["doc_id", "gram"]).groupBy(*by).agg(F.min(F.struct("n", "gram"))["gram"].alias("gram"))
    holding = rarest(q_runs, key_runs, at).join(key_runs.hint("merge"), ["doc_id", "gram"]).filter(F.contains(n, q)).select("query_id", "doc_id", "key", tier(1, F.length(n)))
    long = key_runs.filter((F.length("gram") == 3) & (F.length("key") >= 3))
    held = rarest(long, q_runs, ["doc_id", "key"]).join(q_runs.hint("merge"), ["doc_id", "gram"]).filter(F.contains(q, n)).select("query_id", "doc_id", "key", tier(2, -F.length(n)))
    key_words = keys.select("doc_id", "key", F.explode(_words("key")).alias("w"))
    common = F.row_number().over(Window.partitionBy(*at).orderBy(F.desc("n"), "w"))
    q_words = rest.select(*at, F.explode(_words("q")).alias("w")).join(key_words.groupBy("doc_id", "w").agg(F.count("*").alias("n")).hint("merge"), ["doc_id", "w"]).withColumn("nth", common).filter("nth > 1")
    shared = F.size(F.array_intersect(_words("q"), _words("key")))
    both = q_words.join(key_words.hint("merge"), ["doc_id", "w"]).filter((shared >= 2) & (shared >= 0.5 * F.size(_words("q")))).select("query_id", "doc_id", "key", tier(3, F.lit(0)))
    return same.unionByName(holding).unionByName(held).unionByName(both).groupBy("query_id", "doc_id").agg(F.min_by("key", F.struct("tier", "key")).alias("key"))


def find_entities(entities: DataFrame, queries: DataFrame, most: int = 20) -> DataFrame:
    """(query_id, doc_id, key, entity_type, description): entities by name or description.

    One holds the other, or query and description share two words and half of the
    query's. queries: (query_id, doc_id, query), each asked of one document.
    """
    asked = queries.select("query_id", "doc_id", F.lower(F.trim("query")).alias("q")).filter("q <> ''")
    both = asked.join(entities.select("doc_id", "key", "entity_type", "description").withColumn("d", F.lower(F.coalesce("description", F.lit("")))), "doc_id")
    holds = lambda c: (F.length(c) >= 3) & (F.contains(c, F.col("q")) | F.contains(F.col("q"), c))
    shared = F.size(F.array_intersect(_words("q"), _words("d")))
    words = (F.size(_words("q")) >= 2) & (F.length("d") >= 5) & (shared >= 2) & (shared >= 0.5 * F.size(_words("q")))
    place = F.row_number().over(Window.partitionBy("query_id", "doc_id").orderBy("key"))
    found = both.filter(holds(F.col("key")) | holds(F.col("d")) | words)
    return found.withColumn("place", place).filter(F.col("place") <= most).select("query_id", "doc_id", "key", "entity_type", "description")


def find_nodes(entities: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, doc_id, node_id, key): nodes of the entities whose names a query holds.

    Descriptions that match open the same gate as names, but only names are given
    out; so a query that holds no name has none, whatever the descriptions say.
    """
    found = seeds_in_query(entities, queries)
    nodes = entities.select("doc_id", "key", F.explode("source_node_ids").alias("node_id"))
    return found.join(nodes, ["doc_id", "key"]).groupBy("query_id", "doc_id", "node_id").agg(F.min("key").alias("key"))


def gate(entities: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, doc_id): documents of which a name or a description matches a query.

    A description matches if the query holds it, or shares two words with it and half
    of the description's.
    """
    named = seeds_in_query(entities, queries).select("query_id", "doc_id")
    words = queries.select("query_id", F.lower("query").alias("q")).withColumn("ws", _words("q"))
    told = entities.filter(F.length("description") >= 3).select("doc_id", F.lower("description").alias("d")).withColumn("ds", _words("d"))
    common = words.select("query_id", "q", F.explode("ws").alias("w")).join(told.select("doc_id", "d", F.size("ds").alias("n"), F.explode("ds").alias("w")), "w")
    shared = common.groupBy("query_id", "q", "doc_id", "d", "n").agg(F.count("*").alias("k")).filter(((F.col("k") >= 2) & (F.col("k") >= 0.5 * F.col("n"))) | F.contains("q", "d"))
    return named.unionByName(shared.select("query_id", "doc_id")).distinct()


def expand(entities: DataFrame, relations: DataFrame, seeds: DataFrame, hops: int = 1) -> DataFrame:
    """(query_id, doc_id, node_id, distance): nodes of the entities at most ``hops`` steps from
    those of the seeds (query_id, doc_id, node_id)."""
    at = entities.select("doc_id", "key", F.explode("source_node_ids").alias("node_id"))
    pair = lambda doc, key: F.struct(F.col(doc).alias("d"), F.col(key).alias("k"))
    start = seeds.join(at, ["doc_id", "node_id"]).select("query_id", pair("doc_id", "key").alias("node")).distinct()
    edges = relations.select(pair("doc_id", "low").alias("src"), pair("doc_id", "high").alias("dst"))
    found = reached(edges, start.select("node").distinct(), hops)
    near = start.select("query_id", F.col("node").alias("seed")).join(found, "seed").select("query_id", F.col("node.d").alias("doc_id"), F.col("node.k").alias("key"), "distance")
    return near.join(at, ["doc_id", "key"]).groupBy("query_id", "doc_id", "node_id").agg(F.min("distance").alias("distance"))


def resolved(entities: DataFrame, suffixes: tuple[str, ...] = (" inc", " ltd", " llc", " corp", " co", " company", " corporation"), distance: int = 1, least: int = 5) -> DataFrame:
    """(doc_id, key, canonical): names that mean the same, by a name for all of them.

    Names are the same without a company's suffix, or within ``distance`` edits of each
    other if they have ``least`` signs and begin or end alike. The shortest name of a
    group stands for it, the first of equally short ones; groups are closed over three
    rounds of pairs.
    """
    stem = F.regexp_replace("key", "(" + "|".join(s.replace(" ", r"\s+") for s in suffixes) + r")\.?$", "")
    names = entities.select("doc_id", "key", F.when(stem != "", stem).otherwise(F.col("key")).alias("stem")).distinct()
    stems = names.select("doc_id", "stem").distinct()
    half = F.floor(F.length("stem") / 2).cast("int")
    ends = F.array(F.concat(F.lit("<"), F.expr("left(stem, cast(length(stem) / 2 as int))")), F.concat(F.lit(">"), F.expr("right(stem, cast(length(stem) / 2 as int))")))
    blocks = stems.filter(F.length("stem") >= least).withColumn("h", half).select("doc_id", "stem", F.explode(ends).alias("block"))
    pairs = blocks.join(blocks.withColumnRenamed("stem", "other"), ["doc_id", "block"]).filter((F.col("stem") < F.col("other")) & (F.levenshtein("stem", "other") <= distance)).select("doc_id", "stem", "other").distinct()
    sides = pairs.unionByName(pairs.select("doc_id", F.col("other").alias("stem"), F.col("stem").alias("other")))
    best = stems.withColumn("head", F.struct(F.length("stem").alias("n"), F.col("stem").alias("s")))
    for _ in range(3):
        near = sides.join(best.select("doc_id", F.col("stem").alias("other"), "head"), ["doc_id", "other"]).select("doc_id", "stem", "head")
        best = best.unionByName(near).groupBy("doc_id", "stem").agg(F.min("head").alias("head"))
    heads = names.join(best, ["doc_id", "stem"])
    first = Window.partitionBy("doc_id", "head").orderBy(F.length("key"), "key").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return heads.withColumn("canonical", F.first("key").over(first)).select("doc_id", "key", "canonical")


def simple_paths(edges: DataFrame, pairs: DataFrame, most_hops: int = 3, most_paths: int = 5) -> DataFrame:
    """(src, dst, path): each pair's shortest simple paths, then by their nodes.

    Paths grow from a source once, whatever the number of its destinations, and stop
    a step short: the last step is a join with the destinations.
    """
    sides = both_ways(edges).select(F.col("src").alias("a"), F.col("dst").alias("b"))
    wanted = pairs.select("src", "dst").filter("src <> dst").distinct()
    open_ = wanted.select("src").distinct().select("src", F.array("src").alias("path"))
    found = None
    for _ in range(most_hops):
        grown = open_.join(sides, F.element_at("path", -1) == F.col("a")).filter(~F.array_contains("path", F.col("b")))
        done = grown.join(wanted.withColumnRenamed("dst", "b"), ["src", "b"]).select("src", F.col("b").alias("dst"), F.array_append("path", F.col("b")).alias("path"))
        found = done if found is None else found.unionByName(done)
        open_ = grown.select("src", F.array_append("path", F.col("b")).alias("path"))
    place = F.row_number().over(Window.partitionBy("src", "dst").orderBy(F.size("path"), "path"))
    return found.withColumn("place", place).filter(F.col("place") <= most_paths)


def _grams(text: str, n: int) -> F.Column:
    """The distinct runs of n signs in a text; none if it is shorter or null."""
    starts = F.sequence(F.lit(1), F.length(text) - (n - 1))
    return F.array_distinct(F.when(F.length(text) >= n, F.transform(starts, lambda k: F.substring(F.col(text), k, F.lit(n)))))


def seeds_in_query(entities: DataFrame, queries: DataFrame, least: int = 3, whole_words: bool = False) -> DataFrame:
    """(query_id, doc_id, key): names of ``least`` signs (1 or more) or longer that a
    query holds, anywhere in it; with ``whole_words`` only where no word goes on
    before or after the name.

    The first signs of a name stand in a query that holds it: an equi-join on them,
    three at most, narrows it first.
    """
    n = min(3, least)
    asked = queries.select("query_id", F.lower("query").alias("q"))
    grams = asked.select("query_id", "q", F.explode(_grams("q", n)).alias("gram"))
    names = entities.select("doc_id", "key", F.substring("key", 1, n).alias("gram")).filter(F.length("key") >= least)
    holds = F.contains("q", "key")
    if whole_words:
        quoted = F.concat(F.lit(r"(?<![\p{L}\p{N}_])\Q"), F.replace("key", F.lit("\\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E(?![\p{L}\p{N}_])"))
        holds &= F.regexp_like("q", quoted)
    return grams.join(names, "gram").filter(holds).select("query_id", "doc_id", "key").distinct()


def cross_references(nodes: DataFrame, least: int = 10, known: DataFrame | None = None) -> DataFrame:
    """(doc_id, src, dst): a node whose text names another's title; one row per pair.

    Of nodes with the same title the last one is meant. Pairs that ``known`` (doc_id,
    src, dst) has, in either direction, are left out. A title's first signs, eight at
    most, narrow the join, and only what they leave meets the texts; nodes: (doc_id,
    node_id, title, text).
    """
    n = min(8, least)
    titles = nodes.withColumn("title", F.trim("title")).filter(F.length("title") >= least).groupBy("doc_id", "title").agg(F.max("node_id").alias("dst")).select("doc_id", "dst", F.lower("title").alias("t"))
    texts = nodes.select("doc_id", F.col("node_id").alias("src"), F.lower("text").alias("x"))
    grams = texts.select("doc_id", "src", F.explode(_grams("x", n)).alias("gram"))
    near = grams.join(titles.withColumn("gram", F.substring("t", 1, n)), ["doc_id", "gram"]).filter("src <> dst").select("doc_id", "src", "dst", "t").distinct()
    hits = near.join(texts, ["doc_id", "src"]).filter(F.contains("x", "t"))
    pair = Window.partitionBy("doc_id", F.least("src", "dst"), F.greatest("src", "dst")).orderBy("src", "dst")
    found = hits.withColumn("nth", F.row_number().over(pair)).filter("nth = 1").select("doc_id", "src", "dst")
    if known is None:
        return found
    sides = known.select("doc_id", "src", "dst").union(known.select("doc_id", F.col("dst").alias("src"), F.col("src").alias("dst")))
    return found.join(sides, ["doc_id", "src", "dst"], "left_anti")


def extract(nodes: DataFrame, client: Callable[[str], str] | None, least: int = 800, most: int = 3000) -> DataFrame:
    """(doc_id, node_id, text, skipped): a model's reply for each node of ``least`` signs or more.

    ``client`` takes a prompt and gives a reply; it runs in the workers. Without one
    there are no replies, and ``skipped`` says why; a reply that fails is told there too.
    """
    some = nodes.filter(F.length("text") >= least).select("doc_id", "node_id", F.substring("text", 1, most).alias("prompt"))
    if client is None:
        return some.select("doc_id", "node_id", F.lit(None).cast("string").alias("text"), F.lit("no_llm_client").alias("skipped"))
    kinds = T.StructType([some.schema["doc_id"], some.schema["node_id"], T.StructField("text", T.StringType()), T.StructField("skipped", T.StringType())])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            replies, why = [], []
            for prompt in batch.column(2).to_pylist():
                try:
                    replies.append(client(prompt))
                    why.append(None)
                except Exception as e:  # noqa: BLE001  a service's failure is data here
                    replies.append(None)
                    why.append(str(e)[:200])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(replies, pa.string()), pa.array(why, pa.string())], names=kinds.fieldNames())

    return some.mapInArrow(ask, kinds)


def index_entities(replies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entities, relations) of extract()'s replies, merged under names that mean the same."""
    entities, relations = parse_lines(replies.filter("text is not null").select("doc_id", "node_id", "text"))
    merged = merge_entities(entities)
    same = resolved(merged)
    names = entities.withColumn("key", entity_key(F.col("name"))).join(same, ["doc_id", "key"])
    named = names.withColumn("name", F.coalesce("canonical", "name")).select(*entities.columns)
    ends = relations
    for c in ("source", "target"):
        to = same.select("doc_id", F.col("key").alias("_k"), F.col("canonical").alias("_c"))
        ends = ends.withColumn("_k", entity_key(F.col(c))).join(to, ["doc_id", "_k"], "left").withColumn(c, F.coalesce("_c", c)).drop("_k", "_c")
    return merge_entities(named), merge_relations(ends.select(*relations.columns)).filter("low <> high")
