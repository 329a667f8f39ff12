"""The tools: one method each, text in JSON out, errors as results."""

from __future__ import annotations

import functools
import json
import re
import threading
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.config import Config
from factloom.model import RESOLVE_LIMIT, UUID, GraphError, check_depth, check_edge_properties, check_property_key
from factloom.operators import export, facts, mermaid, mutate, neighbours, search, stats, traverse
from factloom.schema import markdown
from factloom.schema.presets import EntityType, preset
from factloom.schema.registry import Registry
from factloom.sources.graph import Graph
from factloom.sources.store import GraphStore

SECTIONS = ("entity", "connections", "facts")
#: The tools with their required and optional arguments.
TOOLS = {
    "remember_entity": (("name", "type"), ("properties", "confidence")), "remember_relationship": (("from", "to", "type"), ("properties",)),
    "supersede_fact": (("entity", "new_fact"), ("old_fact", "source", "confidence")), "forget_entity": (("identifier",), ()),
    "merge_entities": ((), ("surviving", "merged", "surviving_id", "merged_id")), "remember_knowledge": ((), ("entities", "relationships")),
    "recall_entity": (("identifier",), ("include_relationships",)), "recall_connections": (("identifier",), ("depth", "limit", "relationship_types", "include_mermaid")),
    "recall_context": (("identifier",), ("depth", "limit", "sections", "include_mermaid")), "recall_timeline": (("identifier",), ("last_n",)),
    "find_contradictions": (("identifier",), ()), "search_entities": (("query",), ("limit", "type_filter", "exact")), "list_entities": ((), ("type_filter", "limit")),
    "graph_stats": ((), ()), "export_graph": ((), ("sections",)), "get_memory_schema": ((), ("compact",)),
    "update_memory_schema": (("action", "name", "properties", "extraction_hint", "examples"), ()),
}
_ARRAYS = {"relationship_types", "sections", "examples", "entities", "relationships"}
_KINDS = {"confidence": "number", "depth": "integer", "limit": "integer", "last_n": "integer", "exact": "boolean", "compact": "boolean", "include_mermaid": "boolean", "include_relationships": "boolean"}


@dataclass
class ToolResult:
    text: str
    is_error: bool = False

    @property
    def data(self):
        return json.loads(self.text)


class Ambiguous(GraphError):
    def __init__(self, name: str, candidates: list[dict]):
        super().__init__(f'Ambiguous entity: "{name}". Candidates: ' + ", ".join(f"{c['name']} ({c['type']})" for c in candidates))
        self.candidates = candidates


def tool(verb: str):
    """A method that answers in JSON; whatever it raises becomes `Failed to <verb>: ...`."""

    def wrap(f):
        @functools.wraps(f)
        def run(self, **args):
            required, optional = TOOLS[f.__name__]
            try:
                missing = [r for r in required if args.get(r) in (None, "")]
                if missing:
                    return ToolResult(", ".join(f"'{m}'" for m in missing) + (" is required." if len(missing) == 1 else " are required."), True)
                unknown = set(args) - {*required, *optional}
                if unknown:
                    return ToolResult(f"Unknown arguments: {', '.join(sorted(unknown))}", True)
                out = f(self, **{("from_" if k == "from" else k): v for k, v in args.items()})
                return out if isinstance(out, ToolResult) else ToolResult(json.dumps(out, ensure_ascii=False))
            except Ambiguous as e:
                return ToolResult(f"Failed to {verb}: {e}", True)
            except GraphError as e:
                return ToolResult(f"Failed to {verb}: {e}", True)
            except Exception as e:
                return ToolResult(f"Failed to {verb}: {str(e).splitlines()[0] if str(e) else type(e).__name__}", True)

        return run

    return wrap


def _encoded(properties: dict | None) -> dict:
    for k in properties or {}:
        check_property_key(k)
    return {k: json.dumps(v, ensure_ascii=False) for k, v in (properties or {}).items()}


def _decoded(bag: dict | None) -> dict:
    out = {}
    for k, v in (bag or {}).items():
        try:
            out[k] = json.loads(v) if v is not None else None
        except ValueError:
            out[k] = v
    return out


def _iso(t) -> str | None:
    return t.strftime("%Y-%m-%dT%H:%M:%S.") + f"{t.microsecond // 1000:03d}Z" if t is not None else None


class GraphMemory:
    """A graph store with its types and limits. Results name things instead of ids; ids stay for entities themselves."""

    def __init__(self, store: GraphStore, config: Config | None = None, registry: Registry | None = None, schema_file: str | None = None):
        self.store, self.config, self.spark = store, config or Config(), store.spark
        store.initialize()
        self.registry = registry or Registry(preset(self.config.preset), self.config.guardrails)
        self.schema_file = schema_file
        for note in store.notes():  # types added earlier are kept in the store
            if "type" in note and note["type"]["name"] not in self.registry.types:
                self.registry.preset.entity_types.append(EntityType(**note["type"]))

    def definitions(self) -> list[dict]:
        """The tools as JSON schemas, with the types in force."""
        choice = {"type": self.registry.types, "type_filter": self.registry.types, "relationship_types": self.registry.links}
        out = []
        for name, (required, optional) in TOOLS.items():
            props = {}
            for a in (*required, *optional):
                kind = "array" if a in _ARRAYS or (a == "properties" and name == "update_memory_schema") else "object" if a == "properties" else _KINDS.get(a, "string")
                props[a] = {"type": kind}
                if a in choice and name != "update_memory_schema":
                    values = self.registry.links if name == "remember_relationship" and a == "type" else choice[a]
                    props[a] |= {"items": {"type": "string", "enum": values}} if kind == "array" else {"enum": values}
            out.append({"name": name, "inputSchema": {"type": "object", "properties": props, "required": list(required)}})
        return out

    def call(self, name: str, args: dict | None = None) -> ToolResult:
        if name not in TOOLS:
            return ToolResult(f"Unknown tool: {name}", True)
        return getattr(self, name)(**(args or {}))

    # -- helpers

    def _graph(self) -> Graph:
        return self.store.graph()

    def _row(self, df: DataFrame):
        return next(iter(df.limit(1).collect()), None)

    def _entity(self, r) -> dict:
        bag = {"name": r["name"], **{k: v for k, v in _decoded(r["properties"]).items() if not (k == "id" and v == r["id"])}}
        extra = {"created_at": _iso(r["created_at"]), "updated_at": _iso(r["updated_at"]), "confidence": r["confidence"]}
        return {"id": r["id"], "name": r["name"], "type": r["label"], "properties": bag | {k: v for k, v in extra.items() if v is not None}}

    def _get(self, g: Graph, identifier: str):
        """By id, else the best name match without disambiguation."""
        if re.match(UUID, identifier):
            return self._row(search.by_id(g.vertices, identifier.lower(), self.registry.types))
        return self._row(search.by_name(g.vertices, identifier, self.registry.types))

    def _resolve(self, g: Graph, identifier: str):
        """The vertex meant, or raises: an id; else the only hit, or the only full match."""
        if re.match(UUID, identifier):
            row = self._row(search.by_id(g.vertices, identifier.lower(), self.registry.types))
            if row is None:
                raise GraphError(f'Entity not found: "{identifier}"')
            return row["id"], row["name"], row["label"]
        hits = search.search(g.vertices, identifier, self.registry.types, limit=RESOLVE_LIMIT).collect()
        if not hits:
            raise GraphError(f'Entity not found: "{identifier}"')
        if len(hits) == 1 or (hits[0]["score"] == 1.0 and hits[1]["score"] < 1.0):
            return hits[0]["id"], hits[0]["name"], hits[0]["label"]
        raise Ambiguous(identifier, [{"id": h["id"], "name": h["name"], "type": h["label"], "score": h["score"]} for h in hits])

    def _batch(self, rows: list[tuple], schema: str) -> DataFrame:
        return self.spark.createDataFrame(rows, schema)

    def _kept(self, df: DataFrame) -> DataFrame:
        """Versions written once, so that made ids stay the same."""
        from factloom.runtime import Scratch

        return Scratch(self.spark, "batch").write(df)

    def _links(self, rows, names: dict) -> list[dict]:
        out = []
        for r in rows:
            bag = {("prop_" + k if k in ("type", "from", "to") else k): v for k, v in _decoded(r["properties"]).items() if k not in ("id", "created_at", "updated_at")}
            out.append({"type": r["label"], "from": names.get(r["start_id"], r["start_id"]), "to": names.get(r["end_id"], r["end_id"]), **bag})
        return out

    def _timed(self, run):
        """`run` under the query timeout, its Spark jobs cancelled when it is over."""
        sc, tag = self.spark.sparkContext, f"query-{threading.get_ident()}-{id(run)}"
        ms, fired = self.config.query_limits.query_timeout_ms, threading.Event()

        def stop():
            fired.set()
            sc.cancelJobsWithTag(tag)

        timer = threading.Timer(ms / 1000, stop)
        sc.addJobTag(tag)
        timer.start()
        try:
            return run()
        except Exception:
            if fired.is_set():
                raise GraphError(f"Query timeout: traversal exceeded {ms}ms limit") from None
            raise
        finally:
            timer.cancel()
            sc.removeJobTag(tag)

    def _connections(self, g: Graph, identifier: str, depth, limit, types) -> dict:
        q = self.config.query_limits
        depth = check_depth(q.max_depth if depth is None else depth)
        limit = q.default_limit if limit is None else limit
        if not 1 <= limit <= q.max_limit:
            raise GraphError(f"Limit must be between 1 and {q.max_limit}")
        anchor_id, *_ = self._resolve(g, identifier)
        for t in types or []:
            self.registry.check_link(t)

        def run():
            c = traverse.Connections(g, anchor_id, depth, types)
            total = c.entities.count()
            ents = c.entities.orderBy("dist", "label", "name", "id").limit(int(limit)).collect()
            rels = c.relationships.orderBy("label", "id").collect()
            names = {r["id"]: r["name"] for r in g.vertices.join(c.reached, "id").select("id", "name").collect()}
            return total, ents, rels, names

        total, ents, rels, names = self._timed(run)
        anchor = self._entity(self._row(search.by_id(g.vertices, anchor_id)))
        drawn = [{"from_id": r["start_id"], "type": r["label"], "to_id": r["end_id"]} for r in rels]
        return {"anchor": anchor, "entities": [self._entity(e) for e in ents], "relationships": self._links(rels, names), "total_count": total, "truncated": total > limit, "depth": depth, "_drawn": drawn}

    def _diagram(self, connections: dict) -> dict:
        text, cut = mermaid.render([connections["anchor"], *connections["entities"]], connections["_drawn"], self.config.query_limits.mermaid_max_nodes)
        return {"mermaid": text, "mermaid_truncated": cut}

    # -- writing

    def _upsert(self, rows: list[dict]) -> tuple[list[dict], list[dict]]:
        """(stored, refused) of entities given in order; names, types and confidence are checked row by row."""
        data, refused = [], []
        for k, e in enumerate(rows):
            try:
                data.append((k, e.get("type"), e.get("name"), _encoded(e.get("properties")), float(e["confidence"]) if e.get("confidence") is not None else None))
            except GraphError as x:
                refused.append({"index": k, "error": str(x)})
        g = self._graph()
        base = self.store.version * 1_000_000
        checked = mutate.vertex_errors(self._batch(data, "ord int, label string, name string, properties map<string,string>, confidence double").withColumn("ord", F.col("ord") + F.lit(base)), self.registry.types)
        refused += [{"index": r["ord"] - base, "error": r["error"]} for r in checked.filter("error is not null").collect()]
        new = self._kept(mutate.upsert_vertices(g.vertices, checked.filter("error is null").drop("error")))
        self.store.append(new)
        return [r.asDict() for r in new.select("label", "id", "name", "created").collect()], refused

    @tool("remember entity")
    def remember_entity(self, name, type, properties=None, confidence=None):
        if confidence is not None and not 0 <= confidence <= 1:
            return ToolResult("Confidence must be 0.0-1.0.", True)
        least = self.config.guardrails.min_confidence_to_store
        if confidence is not None and confidence < least:
            return ToolResult(f"Confidence {confidence} is below minimum threshold {least}.", True)
        stored, refused = self._upsert([{"name": name, "type": type, "properties": properties, "confidence": confidence}])
        if refused:
            raise GraphError(refused[0]["error"])
        return {"id": stored[0]["id"], "status": "created" if stored[0]["created"] else "updated"}

    @tool("remember relationship")
    def remember_relationship(self, from_, to, type, properties=None):
        self.registry.check_link(type)
        bag, g, ends = _encoded(check_edge_properties(properties)), self._graph(), []
        for field, name in (("from", from_), ("to", to)):
            try:
                ends.append(self._resolve(g, name)[0])
            except Ambiguous as e:
                return {"needs_disambiguation": True, "field": field, "candidates": e.candidates}
        new = self._kept(mutate.upsert_edges(g.edges, self._batch([(0, type, *ends, bag)], "ord int, label string, start_id string, end_id string, properties map<string,string>")))
        self.store.append(None, new)
        row = new.first()
        return {"id": row["id"], "status": "created" if row["created"] else "updated"}

    @tool("supersede fact")
    def supersede_fact(self, entity, new_fact, old_fact=None, source=None, confidence=None):
        if confidence is not None and not 0 <= confidence <= 1:
            return ToolResult("Confidence must be 0.0-1.0.", True)
        if not new_fact.strip():
            raise GraphError("new_fact cannot be empty")
        g = self._graph()
        id_, *_ = self._resolve(g, entity)
        rows = self._batch([(self.store.version * 1_000_000, id_, new_fact, old_fact, source, confidence)], "ord long, entity_id string, new_fact string, old_fact string, source string, confidence double")
        vertices, edges, drawn = mutate.superseding(g, rows)
        self.store.append(vertices, self._kept(edges))
        row = drawn.first()
        return {"new_fact_id": row["new_id"], "old_fact_id": row["old_id"], "status": "superseded"}

    @tool("forget entity")
    def forget_entity(self, identifier):
        g = self._graph()
        row = self._get(g, identifier)
        if row is None:
            raise GraphError(f'Entity not found: "{identifier}"')
        self.store.append(self._kept(mutate.soft_delete(g.vertices, self._batch([(row["id"],)], "id string"))))
        return {"id": row["id"], "status": "deleted"}

    @tool("merge entities")
    def merge_entities(self, surviving=None, merged=None, surviving_id=None, merged_id=None):
        names = {"surviving": surviving or surviving_id, "merged": merged or merged_id}
        if not all(names.values()):
            return ToolResult("'surviving' and 'merged' (or 'surviving_id' and 'merged_id') are both required.", True)
        g, found = self._graph(), {}
        for field, name in names.items():
            try:
                found[field] = self._resolve(g, name)
            except Ambiguous as e:
                return {"needs_disambiguation": True, "field": field, "candidates": e.candidates}
            except GraphError:
                return ToolResult(f'{field.capitalize()} entity not found: "{name}"', True)
        (a, _, kind), (b, _, other) = found["surviving"], found["merged"]
        if kind != other:
            raise GraphError(f"Cannot merge entities of different types: {kind} and {other}")
        if a == b:
            raise GraphError("Cannot merge an entity with itself")
        vertices, edges = mutate.merge_vertices(g, a, b)
        self.store.append(self._kept(vertices), self._kept(edges))
        return {"surviving_id": a, "merged_id": b, "status": "merged"}

    @tool("remember knowledge")
    def remember_knowledge(self, entities=None, relationships=None):
        entities, relationships = entities or [], relationships or []
        if not entities and not relationships:
            return ToolResult("At least one entity or relationship is required.", True)
        stored, refused = self._upsert(entities) if entities else ([], [])
        out = {"entities_created": sum(s["created"] for s in stored), "entities_updated": sum(not s["created"] for s in stored), "relationships_created": 0, "relationships_updated": 0, "relationships_failed": []}
        failed = out["relationships_failed"]
        g = self._graph()
        refs, good = [], {}
        for k, r in enumerate(relationships):
            try:
                good[k] = _encoded(check_edge_properties(r.get("properties")))
                refs += [(k, f, r[f], r.get(f"{f}_type")) for f in ("from", "to")]
            except (GraphError, KeyError) as e:
                failed.append({"index": k, "error": str(e)})
        if refs:
            batch = self._batch([(s["name"], s["label"], s["id"]) for s in stored], "name string, label string, id string")
            ends = mutate.resolve_references(self._batch(refs, "index int, field string, ref string, hint string"), batch, g.vertices)
            found = {(r["index"], r["field"]): r for r in ends.collect()}
            rows = []
            for k, bag in good.items():
                bad = [found[k, f]["error"] for f in ("from", "to") if found[k, f]["id"] is None]
                if not bad and relationships[k]["type"] not in self.registry.links:
                    bad = [f'Invalid relationship type: "{relationships[k]["type"]}"']
                if bad:
                    failed.append({"index": k, "error": bad[0]})
                else:
                    rows.append((k, relationships[k]["type"], found[k, "from"]["id"], found[k, "to"]["id"], bag))
            if rows:
                new = self._kept(mutate.upsert_edges(g.edges, self._batch(rows, "ord int, label string, start_id string, end_id string, properties map<string,string>")))
                self.store.append(None, new)
                made = [r["created"] for r in new.select("created").collect()]
                out["relationships_created"], out["relationships_updated"] = sum(made), len(made) - sum(made)
        failed.sort(key=lambda x: x["index"])
        if refused:
            out["entities_failed"] = sorted(refused, key=lambda x: x["index"])
        return out

    # -- reading

    @tool("recall entity")
    def recall_entity(self, identifier, include_relationships=False):
        g = self._graph()
        row = self._get(g, identifier)
        if row is None:
            return {"found": False, "message": f'No entity found for "{identifier}". Try search_entities for fuzzy matching.'}
        out = self._entity(row) | {"found": True}
        if include_relationships:
            rels = neighbours.relationships(g, row["id"], "both", None, self.config.query_limits.default_limit).collect()
            names = {row["id"]: row["name"]} | {(r["end_id"] if r["direction"] == "out" else r["start_id"]): r["other_name"] for r in rels}
            out |= {"relationships": self._links(rels, names), "relationship_count": len(rels)}
        return out

    @tool("recall connections")
    def recall_connections(self, identifier, depth=None, limit=None, relationship_types=None, include_mermaid=False):
        c = self._connections(self._graph(), identifier, depth, limit, relationship_types)
        drawn = self._diagram(c) if include_mermaid else {}
        c.pop("_drawn")
        return c | drawn

    @tool("recall context")
    def recall_context(self, identifier, depth=None, limit=None, sections=None, include_mermaid=False):
        sections = list(SECTIONS) if sections is None else sections
        if not sections:
            return ToolResult("At least one section required", True)
        for s in sections:
            if s not in SECTIONS:
                return ToolResult(f'Invalid section: "{s}". Valid: {", ".join(SECTIONS)}', True)
        g, out = self._graph(), {}
        c = self._connections(g, identifier, depth, limit, None)
        drawn = self._diagram(c) if include_mermaid else {}
        c.pop("_drawn")
        if "entity" in sections:
            out["entity"] = c["anchor"]
        if "connections" in sections:
            out["connections"] = c
        if "facts" in sections:
            out["facts"] = self._facts(g, c["anchor"]["id"], True)
        return out | drawn

    def _facts(self, g: Graph, id_: str, all_: bool) -> list[dict]:
        own = facts.facts_of(g, id_).select("id", "superseded")
        rows = g.vertices.join(own, "id").orderBy("created_at", "seq", "id").collect()
        out = []
        for r in rows:
            bag = _decoded(r["properties"])
            replaced = r["superseded"] or bag.get("_superseded") is True
            if all_ or not replaced:
                f = {"id": r["id"], "content": bag.get("content", r["name"]), "source": bag.get("source"), "confidence": r["confidence"], "timestamp": _iso(r["created_at"])}
                out.append({k: v for k, v in f.items() if v is not None} | ({"superseded": replaced} if all_ else {}))
        return out

    @tool("recall timeline")
    def recall_timeline(self, identifier, last_n=None):
        g = self._graph()
        id_, name, _ = self._resolve(g, identifier)
        rows = traverse.timeline(g, id_, self.config.query_limits.max_depth, None)
        total = rows.count()
        events = [{"id": r["id"], "type": r["label"], "name": r["name"], "timestamp": r["timestamp"], "properties": _decoded(r["properties"])} for r in rows.limit(max(1, int(5 if last_n is None else last_n))).collect()]
        return {"entity_id": id_, "entity_name": name, "events": events, "total_events": total, "showing": len(events)}

    @tool("find contradictions")
    def find_contradictions(self, identifier):
        g = self._graph()
        id_, name, _ = self._resolve(g, identifier)
        return {"entity_id": id_, "entity_name": name, "facts": self._facts(g, id_, False)}

    @tool("search entities")
    def search_entities(self, query, limit=None, type_filter=None, exact=False):
        limit = min(limit, self.config.query_limits.max_limit) if limit is not None else search.SEARCH_LIMIT
        rows = search.search(self._graph().vertices, query, self.registry.types, type_filter if query.strip() else None, bool(exact), int(limit)).collect()
        hits = [{"id": r["id"], "name": r["name"], "type": r["label"], "score": r["score"], "properties": {k: v for k, v in _decoded(r["properties"]).items() if not (k == "id" and v == r["id"])}} for r in rows]
        return {"results": hits, "count": len(hits)}

    @tool("list entities")
    def list_entities(self, type_filter=None, limit=None):
        most = self.config.query_limits
        limit = max(1, min(int(most.default_limit if limit is None else limit), most.max_limit))
        rows = search.listing(self._graph().vertices, self.registry.types, type_filter, limit).collect()
        return {"entities": [{"id": r["id"], "name": r["name"], "type": r["label"], "created_at": _iso(r["created_at"])} for r in rows], "count": len(rows)}

    @tool("get stats")
    def graph_stats(self):
        try:
            g = self._graph()
            v = {r["label"]: r["n"] for r in stats.vertex_counts(g, self.registry.types).collect()}
            e = {r["label"]: r["n"] for r in stats.edge_counts(g, self.registry.links).collect()}
            return {"preset": self.registry.preset.name, "entity_counts": v, "relationship_counts": e, "total_entities": sum(v.values()), "total_relationships": sum(e.values()), "entity_type_count": len(v), "relationship_type_count": len(e), "healthy": self.store.healthy()}
        except Exception as x:
            return {"healthy": False, "error": str(x).splitlines()[0]}

    @tool("export graph")
    def export_graph(self, sections=None):
        rows = export.lines(self._graph(), sections).orderBy("section_order", "id")
        return ToolResult("\n".join(r["line"] for r in rows.select("line").toLocalIterator()))

    # -- types

    @tool("get schema")
    def get_memory_schema(self, compact=False):
        g = self.registry.guardrails
        full = lambda t: {"name": t.name, "properties": t.properties} | ({} if compact else {"extraction_hint": t.extraction_hint, "examples": t.examples})
        return {"preset_name": self.registry.preset.name, "entity_types": [full(t) for t in self.registry.preset.entity_types], "relationship_types": self.registry.links, "guardrails": {"max_entity_types": g.max_entity_types} if compact else vars(g)}

    @tool("update schema")
    def update_memory_schema(self, action, name, properties, extraction_hint, examples):
        if action != "add":
            raise GraphError(f'Unknown action: "{action}". Only "add" is supported.')
        new = EntityType(name, list(properties), extraction_hint, list(examples))
        self.registry.check_addition(new)
        self.store.append(note={"type": vars(new)})  # stored first: a failed write adds nothing
        total = self.registry.add(new)
        if self.schema_file:
            markdown.write_file(self.schema_file, self.registry.preset)
        return {"added": name, "total_types": total}
