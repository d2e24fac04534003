"""Stages by name, put together from a configuration, for documents and questions.

A stage is a callable on DataFrames. The classes here run on the driver; they
only put DataFrame operators after one another.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any, Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.functions import text as fx
from foliant.operators import answer, channels, corpus, hits, lexical, normalise, tables, tree

LAYERS = ("parser", "indexer", "retriever", "channel", "ranker", "synthesizer", "router", "backend")


class Parser(Protocol):
    def parse(self, pages: DataFrame) -> DataFrame: ...


class Indexer(Protocol):
    def build(self, state: State) -> None: ...
    def update(self, state: State) -> None: ...


class Channel(Protocol):
    def search(self, state: State, queries: DataFrame, top_k: int | None) -> DataFrame: ...


class Retriever(Protocol):
    def retrieve(self, state: State, queries: DataFrame, top_k: int) -> DataFrame: ...


class Ranker(Protocol):
    def rank(self, found: DataFrame) -> DataFrame: ...


class Synthesizer(Protocol):
    def synthesize(self, found: DataFrame, queries: DataFrame, turns: DataFrame | None) -> DataFrame: ...


class Router(Protocol):
    def route(self, queries: DataFrame) -> DataFrame: ...
    def query(self, queries: DataFrame) -> DataFrame: ...


class Registry:
    """Classes by layer and name."""

    def __init__(self) -> None:
        self._known: dict[str, dict[str, type]] = {layer: {} for layer in LAYERS}

    def add(self, layer: str, name: str, cls: type) -> type:
        self._at(layer)[name] = cls
        cls.name = name
        return cls

    def register(self, layer: str, name: str) -> Callable[[type], type]:
        return lambda cls: self.add(layer, name, cls)

    def get(self, layer: str, name: str) -> type:
        known = self._at(layer)
        if name not in known:
            raise KeyError(f"no {layer} is named {name!r}; there are {sorted(known)}")
        return known[name]

    def names(self, layer: str) -> list[str]:
        return sorted(self._at(layer))

    def make(self, layer: str, name: str, **options: Any) -> Any:
        return self.get(layer, name)(**options)

    def clear(self) -> None:
        for known in self._known.values():
            known.clear()

    def _at(self, layer: str) -> dict[str, type]:
        if layer not in self._known:
            raise ValueError(f"no such layer: {layer!r}; there are {', '.join(LAYERS)}")
        return self._known[layer]


REGISTRY = Registry()


@dataclass
class Stage:
    type: str
    options: dict[str, Any] = field(default_factory=dict)

    @classmethod
    def of(cls, spec: str | dict[str, Any]) -> Stage:
        """From a name, or a dict with ``type`` and options, beside it or under ``config``."""
        if isinstance(spec, str):
            return cls(spec)
        if not isinstance(spec, dict):
            raise TypeError(f"a stage is a name or a dict, not {type(spec).__name__}")
        if "type" not in spec:
            raise ValueError(f"a stage without a type: {spec}")
        rest = {k: v for k, v in spec.items() if k != "type"}
        nested = rest.pop("config", {})
        return cls(spec["type"], {**nested, **rest})


_LAYER_KEYS = {"parser": ("parsers", "parse"), "indexer": ("indexers", "index"), "retriever": ("retrievers", "retrieve"), "ranker": ("rankers", "rank"), "synthesizer": ("synthesizers", "synthesize")}


@dataclass
class Config:
    stages: dict[str, list[Stage]]
    router: Stage | None = None
    shared: dict[str, dict[str, Any]] = field(default_factory=dict)

    @classmethod
    def of(cls, data: dict[str, Any]) -> Config:
        """Layers under long or short names, one stage or a list; options for a layer in ``globals``."""
        inner = data.get("pipeline", data)

        def listed(keys: tuple[str, ...]) -> list[Stage]:
            raw = next((inner[k] for k in keys if inner.get(k)), [])
            return [Stage.of(x) for x in ([raw] if isinstance(raw, (str, dict)) else raw)]

        router = inner.get("router")
        return cls({layer: listed(keys) for layer, keys in _LAYER_KEYS.items()}, Stage.of(router) if router else None, data.get("globals", {}))

    @classmethod
    def read(cls, path: str) -> Config:
        import yaml

        with open(path, encoding="utf-8") as f:
            return cls.of(yaml.safe_load(f))


@dataclass
class Event:
    type: str
    step: int | None = None
    tool: str | None = None
    args: dict[str, Any] | None = None
    summary: str = ""
    data: Any = None


class Events:
    """Listeners are called one after the other; one that fails doesn't stop the next."""

    def __init__(self) -> None:
        self._listeners: list[Callable[[Event], None]] = []

    def on(self, listener: Callable[[Event], None]) -> Callable[[], None]:
        """Add a listener; what comes back takes it away again."""
        self._listeners.append(listener)
        return lambda: self._listeners.remove(listener) if listener in self._listeners else None

    def emit(self, event: Event | dict[str, Any]) -> None:
        now = event if isinstance(event, Event) else Event(**event)
        for listener in list(self._listeners):
            try:
                listener(now)
            except Exception:  # noqa: BLE001, S112  a listener is not part of the work
                continue


def with_retry(work: Callable[[], Any], retries: int = 3, backoff: float = 2.0, reraise_on: tuple[type[BaseException], ...] = (), sleep: Callable[[float], None] = time.sleep) -> Any:
    """What ``work`` gives, tried again after each failure but those named, after ever longer waits."""
    for attempt in range(1, retries + 1):
        try:
            return work()
        except reraise_on:
            raise
        except Exception:
            if attempt == retries:
                raise
            sleep(backoff * attempt)
    raise ValueError("retries is 1 or more")


@dataclass
class State:
    """What is known of the documents: pages, and what the indexers made of them."""

    pages: DataFrame
    made: dict[str, Any] = field(default_factory=dict)


# -- stages


@REGISTRY.register("parser", "table_normalizer")
class TableNormalizer:
    def parse(self, pages: DataFrame) -> DataFrame:
        return tables.replaced(pages)


@REGISTRY.register("parser", "element_classifier")
class ElementClassifier:
    def parse(self, pages: DataFrame) -> DataFrame:
        return pages.withColumn("text", fx.tag_elements(F.col("text")))


@REGISTRY.register("parser", "ellipsis_handler")
class EllipsisHandler:
    def parse(self, pages: DataFrame) -> DataFrame:
        layer = F.col("layer") if "layer" in pages.columns else F.lit("")
        return pages.withColumn("text", fx.with_ellipsis_note(F.col("text"), layer))


@REGISTRY.register("parser", "page_normalizer")
class PageNormalizer:
    """Elided cells, tables, and tags, in the order that keeps them all."""

    def parse(self, pages: DataFrame) -> DataFrame:
        layered = pages if "layer" in pages.columns else pages.withColumn("layer", F.lit(None).cast("string"))
        return normalise.normalised(layered).select("doc_id", "page_num", "text")


@REGISTRY.register("indexer", "page_bm25")
class PageIndex:
    """A lexical index of pages with a text; below ``base`` it is written and read back."""

    def __init__(self, base: str | None = None) -> None:
        self.base = base

    def build(self, state: State) -> None:
        index = lexical.Index.build(state.pages.filter(F.length(F.trim("text")) > 0))
        if self.base:
            index.save(self.base, "overwrite")
            index = lexical.Index.load(state.pages.sparkSession, self.base)
        state.made["page_bm25"] = index

    update = build


@REGISTRY.register("indexer", "tree_index")
class TreeIndex:
    def __init__(self, refine: bool = False, most: int = tree.MOST_TOKENS) -> None:
        self.refine, self.most = refine, most

    def build(self, state: State) -> None:
        nodes = tree.build_tree(state.pages, most=self.most)
        if self.refine:
            nodes = tree.with_last(tree.refined(nodes, self.most)).withColumn("node_id", F.lpad(F.col("ord").cast("string"), 4, "0"))
        state.made["tree_index"] = nodes
        state.made["sections"] = nodes.filter("page_start is not null").select("doc_id", "node_id", "title", "level", "page_start", "page_end")

    update = build


@REGISTRY.register("indexer", "entity_graph")
class EntityGraph:
    """Entities of the tree's nodes, by a model's replies; without a model or a tree there are none."""

    def __init__(self, client: answer.Client | None = None) -> None:
        self.client = client

    def build(self, state: State) -> None:
        from foliant.operators import graph

        nodes = state.made.get("tree_index")
        if nodes is None or self.client is None:
            state.made["entity_graph_skipped"] = "tree_not_built" if nodes is None else "no_llm_client"
            return
        replies = graph.extract(nodes, self.client)
        state.made["entities"], state.made["relations"] = graph.index_entities(replies)

    update = build


@REGISTRY.register("channel", "bmx_multiquery")
class BmxMultiquery:
    def search(self, state: State, queries: DataFrame, top_k: int | None = 60) -> DataFrame:
        return channels.bmx_multiquery(state.made["page_bm25"], queries, top_k=top_k)


@REGISTRY.register("channel", "tree_bm25")
class TreeBm25:
    def search(self, state: State, queries: DataFrame, top_k: int | None = 60) -> DataFrame:
        return channels.tree_bm25(state.made["tree_index"], queries, top_k=top_k)


@REGISTRY.register("channel", "identifier_boost")
class IdentifierBoost:
    def search(self, state: State, queries: DataFrame, top_k: int | None = 60) -> DataFrame:
        return channels.identifier_boost(state.made["tree_index"], queries, top_k=top_k)


@REGISTRY.register("channel", "entity_2hop")
class Entity2Hop:
    def search(self, state: State, queries: DataFrame, top_k: int | None = 60) -> DataFrame | None:
        if "entities" not in state.made:
            return None
        return channels.entity_2hop(state.made["entities"], state.made["relations"], state.made["tree_index"], queries, top_k=top_k)


@REGISTRY.register("channel", "llm_tree_nav")
class LlmTreeNav:
    def __init__(self, client: answer.Client | None = None, depth: int = 2, most: int = 30_000) -> None:
        self.client, self.depth, self.most = client, depth, most

    def search(self, state: State, queries: DataFrame, top_k: int | None = 60) -> DataFrame | None:
        if self.client is None:
            return None
        lines = tree.outline(state.made["tree_index"], self.depth).withColumn("outline", F.substring("outline", 1, self.most))
        # each question is put to each document of the corpus it is asked of
        asked = queries.join(lines, "doc_id") if "doc_id" in queries.columns else queries.crossJoin(lines)
        prompt = F.concat(F.lit("Outline:\n"), F.col("outline"), F.lit("\n\nQuestion: "), F.col("query"), F.lit("\nReply with a JSON array of node ids."))
        replies = answer.replied(asked.select("query_id", "doc_id", prompt.alias("prompt")), self.client)
        return channels.llm_tree_nav(replies, state.made["tree_index"], top_k=top_k)


@REGISTRY.register("retriever", "hybrid_chatbot")
class Hybrid:
    def __init__(self, channels: list[str | dict] | None = None, radius: int = 1, **weights: Any) -> None:
        self.channels = [REGISTRY.make("channel", s.type, **s.options) for s in map(Stage.of, channels or ["bmx_multiquery", "tree_bm25", "identifier_boost", "entity_2hop", "llm_tree_nav"])]
        self.radius, self.weights = radius, weights

    def retrieve(self, state: State, queries: DataFrame, top_k: int = 30) -> DataFrame:
        found = [h for c in self.channels if (h := c.search(state, queries, 60)) is not None]
        every = found[0]
        for more in found[1:]:
            every = every.unionByName(more)
        own = state.made["page_bm25"].bmx(queries, None)
        fused = hits.hybrid(every, own, state.pages, radius=self.radius, limit=top_k, **self.weights)
        pos = F.row_number().over(hits.Window.partitionBy("query_id").orderBy(F.desc("kind"), F.desc("score"), "doc_id", "page_num"))
        return hits.with_text(fused, state.pages).withColumns({"channel": F.lit("hybrid_chatbot"), "pos": pos.cast("long")})


@REGISTRY.register("retriever", "agent_loop")
class AgentLoop:
    def __init__(self, engine: answer.Client | None = None) -> None:
        self.engine = engine

    def retrieve(self, state: State, queries: DataFrame, top_k: int = 30) -> DataFrame:
        out = answer.agent_loop(queries, self.engine)
        return out.select("query_id", F.lit(None).cast(state.pages.schema["doc_id"].dataType).alias("doc_id"), F.lit(None).cast(state.pages.schema["page_num"].dataType).alias("page_num"), "score", F.lit("agent").alias("kind"), "text", "channel", F.lit(0).cast("long").alias("pos"))


@REGISTRY.register("ranker", "weighted_merge")
class WeightedMerge:
    def __init__(self, top_k: int = 15) -> None:
        self.top_k = top_k

    def rank(self, found: DataFrame) -> DataFrame:
        return hits.weighted_merge(found, self.top_k).withColumn("pos", F.col("place").cast("long")).drop("place")


@REGISTRY.register("ranker", "rrf")
class Rrf:
    def __init__(self, k: int = 60, top_k: int = 15) -> None:
        self.k, self.top_k = k, top_k

    def rank(self, found: DataFrame) -> DataFrame:
        return hits.rrf_hits(found, self.k, self.top_k).withColumn("channel", F.lit("rrf")).withColumn("pos", F.col("place").cast("long")).drop("place")


@REGISTRY.register("ranker", "smart_truncate")
class SmartTruncate:
    def __init__(self, max_chars: int = 25_000) -> None:
        self.max_chars = max_chars

    def rank(self, found: DataFrame) -> DataFrame:
        return hits.within_budget(found, self.max_chars).drop("used")


@REGISTRY.register("synthesizer", "chatbot_llm")
class ChatbotLlm:
    def __init__(self, client: answer.Client | None = None, max_context_chars: int = 25_000) -> None:
        self.client, self.most = client, max_context_chars

    def synthesize(self, found: DataFrame, queries: DataFrame, turns: DataFrame | None = None) -> DataFrame:
        return answer.synthesise(found, queries, self.client, turns, self.most)


@REGISTRY.register("router", "llm_flat")
class FlatRouter:
    """Picks documents for each question, and puts their answers together."""

    def __init__(self, pipeline: Pipeline | None = None, metas: DataFrame | None = None, client: answer.Client | None = None, picks: int = 3) -> None:
        self.pipeline, self.metas, self.client, self.picks = pipeline, metas, client, picks

    def add_document(self, meta: DataFrame) -> None:
        self.metas = answer.registered(meta if self.metas is None else self.metas.unionByName(meta, allowMissingColumns=True))

    def remove_document(self, gone: DataFrame) -> None:
        self.metas = answer.registered(self.metas, gone)

    def route(self, queries: DataFrame) -> DataFrame:
        first = answer.first_documents(queries, self.metas, self.picks)
        if self.client is None:
            return first
        replies = answer.replied(answer.router_prompts(queries, self.metas, self.picks), self.client)
        picked = corpus.route(self.metas, replies.filter("error is null").select("query_id", fx.json_list(F.col("reply")).alias("doc_ids")), self.picks)
        failed = replies.filter("error is not null").select("query_id")
        return picked.unionByName(first.join(failed, "query_id", "left_semi").withColumn("place", F.col("place").cast("int")))

    def query(self, queries: DataFrame) -> DataFrame:
        """One answer per question; a question goes to its documents' pages only."""
        picked = self.route(queries)
        each = picked.join(queries, "query_id").select(F.struct("query_id", "doc_id", "place").alias("query_id"), "query", "doc_id")
        answers = self.pipeline.query(each)
        flat = answers.select("query_id.query_id", "query_id.doc_id", "query_id.place", "answer", F.lit(None).cast("string").alias("error"))
        return answer.combined(flat, queries)


class Pipeline:
    """Parsers, indexers, retrievers, rankers and a synthesiser, in this order."""

    def __init__(self, parsers: list[Any] = (), indexers: list[Any] = (), retrievers: list[Any] = (), rankers: list[Any] = (), synthesizers: list[Any] = (), events: Events | None = None) -> None:
        self.parsers, self.indexers, self.retrievers, self.rankers, self.synthesizers = map(list, (parsers, indexers, retrievers, rankers, synthesizers))
        self.events = events or Events()
        self.state: State | None = None

    @classmethod
    def of(cls, config: Config | dict[str, Any] | str) -> Pipeline:
        config = Config.read(config) if isinstance(config, str) else Config.of(config) if isinstance(config, dict) else config
        made = {layer: [REGISTRY.make(layer, s.type, **{**config.shared.get(layer, {}), **s.options}) for s in stages] for layer, stages in config.stages.items()}
        out = cls(made["parser"], made["indexer"], made["retriever"], made["ranker"], made["synthesizer"])
        if config.router:
            out.router = REGISTRY.make("router", config.router.type, pipeline=out, **{**config.shared.get("router", {}), **config.router.options})
        return out

    def load(self, pages: DataFrame) -> State:
        """pages (doc_id, page_num, text) through all parsers, then every index of them."""
        if not self.parsers:
            raise RuntimeError("no parser is configured")
        for parser in self.parsers:
            pages = parser.parse(pages)
            self.events.emit({"type": "log", "summary": f"parsed via {parser.name}"})
        self.state = State(pages)
        for indexer in self.indexers:
            indexer.build(self.state)
            self.events.emit({"type": "log", "summary": f"indexed via {indexer.name}"})
        return self.state

    def hits(self, queries: DataFrame, top_k: int = 30) -> DataFrame:
        """What the retrievers find, each page once, through the rankers. Queries with a
        ``doc_id`` are asked of that document only."""
        found = None
        for k, retriever in enumerate(self.retrievers):
            own = retriever.retrieve(self.state, queries, top_k).withColumn("pos", F.col("pos") + k * 1_000_000)
            found = own if found is None else found.unionByName(own, allowMissingColumns=True)
        if "doc_id" in queries.columns:
            found = found.join(queries.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_semi")
        found = hits.dedup(found)
        for ranker in self.rankers:
            found = ranker.rank(found)
        return found

    def query(self, queries: DataFrame, turns: DataFrame | None = None, top_k: int = 30, on_event: Callable[[Event], None] | None = None) -> DataFrame:
        """(query_id, answer, citations, context_chars) for queries (query_id, query)."""
        if not self.synthesizers:
            raise RuntimeError("no synthesizer is configured")
        stop = self.events.on(on_event) if on_event else lambda: None
        try:
            self.events.emit({"type": "log", "summary": "query"})
            return self.synthesizers[0].synthesize(self.hits(queries, top_k), queries, turns)
        finally:
            stop()


class Builder:
    """A pipeline stage by stage."""

    def __init__(self) -> None:
        self._made: dict[str, list[Any]] = {layer: [] for layer in _LAYER_KEYS}

    def _add(self, layer: str, stage: Any, options: dict[str, Any]) -> Builder:
        self._made[layer].append(REGISTRY.make(layer, stage, **options) if isinstance(stage, str) else stage)
        return self

    def parser(self, stage: Any, **options: Any) -> Builder:
        return self._add("parser", stage, options)

    def indexer(self, stage: Any, **options: Any) -> Builder:
        return self._add("indexer", stage, options)

    def retriever(self, stage: Any, **options: Any) -> Builder:
        return self._add("retriever", stage, options)

    def ranker(self, stage: Any, **options: Any) -> Builder:
        return self._add("ranker", stage, options)

    def synthesizer(self, stage: Any, **options: Any) -> Builder:
        return self._add("synthesizer", stage, options)

    def build(self) -> Pipeline:
        made = self._made
        return Pipeline(made["parser"], made["indexer"], made["retriever"], made["ranker"], made["synthesizer"])


def default(client: answer.Client | None = None, base: str | None = None, top_k: int = 15) -> Pipeline:
    """Pages in raw markdown to answers: all indexes and channels, without a second merge
    that would drop neighbours."""
    builder = Builder().parser("page_normalizer").indexer("page_bm25", base=base).indexer("tree_index").indexer("entity_graph", client=client)
    return builder.retriever("hybrid_chatbot", channels=["bmx_multiquery", "tree_bm25", "identifier_boost", "entity_2hop", {"type": "llm_tree_nav", "client": client}], top_k=top_k).synthesizer("chatbot_llm", client=client).build()


class Session:
    """Load, ask, and say how far things are."""

    def __init__(self, pipeline: Pipeline) -> None:
        self.pipeline, self.took = pipeline, 0.0

    def load(self, pages: DataFrame) -> DataFrame:
        """(doc_id, n_text, n_scan, track) of what was loaded."""
        began = time.time()
        state = self.pipeline.load(pages)
        self.took = time.time() - began
        return corpus.load_summary(corpus.page_kinds(state.pages))

    @property
    def ready(self) -> dict[str, bool]:
        made = self.pipeline.state.made if self.pipeline.state else {}
        return {name: name in made for name in ("page_bm25", "tree_index", "entities")}

    def query(self, queries: DataFrame, turns: DataFrame | None = None) -> DataFrame:
        return self.pipeline.query(queries, turns)

    def export(self) -> DataFrame:
        """(doc_id, json) of all documents."""
        state = self.pipeline.state
        return corpus.exported_all(state.pages, state.made.get("sections"), tables.parsed(state.pages), state.made.get("entities"))


# -- for other frameworks


def as_documents(found: DataFrame) -> Iterator[dict[str, Any]]:
    """Hits as dicts of text and metadata."""
    rest = [c for c in found.columns if c != "text"]
    for row in found.orderBy("query_id", "pos").toLocalIterator():
        yield {"page_content": row["text"] or "", "metadata": {c: row[c] for c in rest}}


def parse_node(pipeline: Pipeline) -> Callable[[dict], dict]:
    return lambda state: {**state, "loaded": pipeline.load(state["pages"])}


def retrieve_node(pipeline: Pipeline, top_k: int = 30) -> Callable[[dict], dict]:
    return lambda state: {**state, "hits": pipeline.hits(state["queries"], top_k)}


def synthesize_node(pipeline: Pipeline) -> Callable[[dict], dict]:
    return lambda state: {**state, "answer": pipeline.synthesizers[0].synthesize(state["hits"], state["queries"], state.get("turns"))}
