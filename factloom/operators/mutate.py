"""Changes to a graph as sets: upserts, soft deletion, merging with edge transfer, superseded facts, bulk references.

Every function takes the current state and returns the rows to append; nothing is written here. A batch may name one key many
times: its properties are folded per key and property, later rows winning, so no group is collected.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.functions.bags import merged, without
from factloom.ids import strip
from factloom.model import FACT_NAME_LENGTH, RESERVED_EDGE_KEYS, is_property_key, is_uuid, live
from factloom.operators.contain import containment
from factloom.runtime import Scratch, broadcast_if_small
from factloom.sources.graph import Graph

_BAG = "map<string,string>"


def now() -> Column:
    """The driver's clock in UTC, to the millisecond, the same for a whole batch."""
    t = dt.datetime.now(dt.timezone.utc)
    return F.lit(t.replace(tzinfo=None, microsecond=t.microsecond // 1000 * 1000)).cast("timestamp_ntz")


def json_text(c: Column) -> Column:
    """A text as a JSON string."""
    j = F.to_json(F.struct(c.alias("x")))
    return F.substr(j, F.lit(6), F.length(j) - 6)


def _folded(batch: DataFrame, keys: list[str], others: list[str]) -> DataFrame:
    """One row per key: the last value of each property, and of `others` the last that isn't null."""
    last = batch.groupBy(*keys).agg(F.max("ord").alias("ord"), *(F.max_by(F.col(o), F.when(F.col(o).isNotNull(), F.col("ord"))).alias(o) for o in others))
    each = batch.select(*keys, "ord", F.explode(F.coalesce("properties", F.create_map().cast(_BAG))).alias("k", "v"))
    values = each.groupBy(*keys, "k").agg(F.max_by("v", "ord").alias("v"))
    bags = values.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("properties"))
    return last.join(bags, keys, "left").withColumn("properties", F.coalesce("properties", F.create_map().cast(_BAG)))


def vertex_errors(batch: DataFrame, types: list[str]) -> DataFrame:
    """`batch` with `error`, null for rows that may be stored. batch: (ord, label, name, properties, confidence)."""
    name = strip(F.col("name"))
    keys = F.exists(F.map_keys(F.coalesce("properties", F.create_map().cast(_BAG))), lambda k: ~is_property_key(k))
    error = (
        F.when(name.isNull() | (name == ""), "Entity name cannot be empty")
        .when(F.col("label").isNull() | ~F.col("label").isin(types), F.concat(F.lit('Invalid entity type: "'), F.coalesce("label", F.lit("")), F.lit(f'". Valid types: {", ".join(types)}')))
        .when((F.col("confidence") < 0) | (F.col("confidence") > 1), "Confidence must be between 0.0 and 1.0")
        .when(keys, "Invalid property key")
    )
    return batch.withColumn("name", name).withColumn("error", error)


def upsert_vertices(vertices: DataFrame, batch: DataFrame, at: Column | None = None, new_id: Column | None = None) -> DataFrame:
    """Versions to append, with `created`. Key: type and exact name, among live vertices; of several the first by seq, then id.

    New properties win over stored ones, properties called id or name do not touch a new vertex's own, an id never changes, a
    name may. A confidence that isn't given stays.
    """
    at = at if at is not None else now()
    folded = _folded(batch, ["label", "name"], ["confidence"]).withColumnsRenamed({"properties": "new", "confidence": "new_confidence"})
    # only what the batch names is grouped and shuffled
    stored = live(vertices).join(broadcast_if_small(batch.select("label", "name").distinct()), ["label", "name"], "left_semi")
    seq = F.col("seq") if "seq" in vertices.columns else F.lit(0)
    first = stored.groupBy("label", "name").agg(F.min_by(F.struct("id", "properties", "confidence", "created_at", seq.alias("seq")), F.struct(seq, "id")).alias("old"))
    both = folded.join(first, ["label", "name"], "left")
    made = F.col("old").isNull()
    renamed = F.when(~made, F.get_json_object(F.concat(F.lit('{"n":'), F.col("new")["name"], F.lit("}")), "$.n"))
    return both.select(
        "label", F.coalesce("old.id", new_id if new_id is not None else F.uuid()).alias("id"), F.coalesce(renamed, "name").alias("name"), merged(F.col("old.properties"), without(F.col("new"), "id", "name")).alias("properties"),
        F.when(made, at).otherwise(F.col("old.created_at")).alias("created_at"), F.when(~made, at).alias("updated_at"), F.coalesce("new_confidence", "old.confidence").alias("confidence"), F.lit(False).alias("deleted"), F.coalesce("old.seq", F.col("ord")).cast("long").alias("seq"), made.alias("created"),
    )


def edge_errors(batch: DataFrame, types: list[str]) -> DataFrame:
    """`batch` with `error`, null for rows that may be stored. batch: (ord, label, start_id, end_id, properties)."""
    keys = F.map_keys(F.coalesce("properties", F.create_map().cast(_BAG)))
    taken = F.get(F.filter(keys, lambda k: k.isin(*RESERVED_EDGE_KEYS)), F.lit(0))
    error = (
        F.when(F.col("label").isNull() | ~F.col("label").isin(types), F.concat(F.lit('Invalid relationship type: "'), F.coalesce("label", F.lit("")), F.lit('"')))
        .when(taken.isNotNull(), F.concat(F.lit("'"), taken, F.lit("' is a reserved relationship field")))
        .when(F.exists(keys, lambda k: ~is_property_key(k)), "Invalid property key")
    )
    return batch.withColumn("error", error)


def upsert_edges(edges: DataFrame, batch: DataFrame, at: Column | None = None, new_id: Column | None = None) -> DataFrame:
    """Versions to append, with `created`: one edge per (start, type, end), given properties win over stored ones."""
    at = at if at is not None else now()
    keys = ["label", "start_id", "end_id"]
    folded = _folded(batch, keys, []).withColumnRenamed("properties", "new")
    own = edges.join(broadcast_if_small(batch.select(*keys).distinct()), keys, "left_semi")  # only what the batch names is grouped and shuffled
    first = own.groupBy(*keys).agg(F.min_by(F.struct("id", "properties", "created_at"), "id").alias("old"))
    both = folded.join(first, keys, "left")
    made = F.col("old").isNull()
    return both.select(
        "label", F.coalesce("old.id", new_id if new_id is not None else F.uuid()).alias("id"), "start_id", "end_id", merged(F.col("old.properties"), F.col("new")).alias("properties"),
        F.when(made, at).otherwise(F.col("old.created_at")).alias("created_at"), F.when(~made, at).alias("updated_at"), F.col("ord").cast("long").alias("seq"), made.alias("created"),
    )


def soft_delete(vertices: DataFrame, ids: DataFrame, at: Column | None = None) -> DataFrame:
    """Versions of the live vertices among `ids` (id), marked deleted."""
    at = at if at is not None else now()
    return live(vertices).join(broadcast_if_small(ids.select("id").distinct()), "id", "left_semi").withColumn("deleted", F.lit(True)).withColumn("deleted_at", at)


def transferred_edges(graph: Graph, pairs: DataFrame, at: Column | None = None, new_id: Column | None = None) -> DataFrame:
    """New edges of survivors, for (surviving_id, merged_id) pairs whose survivors are not merged themselves.

    Every edge of a merged vertex is pointed at its survivor, unless the survivor has one of the same type to the same other end
    in that direction, or is that other end. Of several equal ones the smallest id counts. Edges of merged vertices stay.
    """
    at = at if at is not None else now()
    to = broadcast_if_small(pairs.select("merged_id", "surviving_id").distinct())
    out = graph.edges.join(to.withColumnRenamed("merged_id", "start_id"), "start_id").select(F.col("surviving_id").alias("start_id"), "label", "end_id", "id", "properties", (F.col("end_id") == F.col("start_id")).alias("loop"), "surviving_id")
    into = graph.edges.join(to.withColumnRenamed("merged_id", "end_id"), "end_id").select("start_id", "label", F.col("surviving_id").alias("end_id"), "id", "properties", (F.col("end_id") == F.col("start_id")).alias("loop"), "surviving_id")
    moved = out.unionByName(into).filter("not loop and start_id != end_id")
    moved = moved.join(graph.edges.select("start_id", "label", "end_id"), ["start_id", "label", "end_id"], "left_anti")
    one = moved.groupBy("start_id", "label", "end_id").agg(F.min_by(F.struct("properties", "surviving_id"), "id").alias("r"))
    return one.select("label", (new_id if new_id is not None else F.uuid()).alias("id"), "start_id", "end_id", without(F.col("r.properties"), "id", "created_at", "updated_at").alias("properties"), at.alias("created_at"), F.lit(0).cast("long").alias("seq"))


def merged_vertices(vertices: DataFrame, pairs: DataFrame, at: Column | None = None) -> DataFrame:
    """Versions of survivors and merged vertices, for (surviving_id, merged_id) pairs whose survivors are not merged themselves.

    A survivor keeps its own properties and takes those it lacks, of several merged vertices from the one with the smallest id;
    merged_from names the one with the largest. Merged vertices are marked as deleted.
    """
    at = at if at is not None else now()
    pairs = pairs.select("surviving_id", "merged_id").distinct()
    ids = pairs.select(F.explode(F.array("surviving_id", "merged_id")).alias("id")).distinct()
    own = vertices.join(broadcast_if_small(ids), "id", "left_semi")
    lost = own.join(pairs.withColumnRenamed("merged_id", "id"), "id")
    each = lost.select("surviving_id", F.col("id").alias("merged_id"), F.explode("properties").alias("k", "v"))
    first = each.groupBy("surviving_id", "k").agg(F.min_by("v", "merged_id").alias("v"))
    other = first.groupBy("surviving_id").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("other"))  # one entry a property name
    last = lost.groupBy("surviving_id").agg(F.max("id").alias("last"))
    kept = own.join(last.withColumnRenamed("surviving_id", "id"), "id").join(other.withColumnRenamed("surviving_id", "id"), "id", "left")
    mark = F.create_map(F.lit("merged_from"), F.concat(F.lit('"'), "last", F.lit('"')))
    kept = kept.withColumn("properties", merged(merged(F.col("other"), F.col("properties")), mark)).withColumn("updated_at", at)
    gone = lost.withColumn("deleted", F.lit(True)).withColumn("deleted_at", at)
    columns = [*vertices.columns, *(c for c in ("updated_at", "deleted_at") if c not in vertices.columns)]
    shaped = lambda df: df.select(*(F.col(c) if c in df.columns else F.lit(None).cast("timestamp_ntz").alias(c) for c in columns))
    return shaped(kept).unionByName(shaped(gone))


def merge_vertices(graph: Graph, surviving_id: str, merged_id: str, at: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(vertex versions, new edges) of merging one vertex into another of the same type: the survivor's properties win."""
    at = at if at is not None else now()
    pair = graph.vertices.sparkSession.range(1).select(F.lit(surviving_id).alias("surviving_id"), F.lit(merged_id).alias("merged_id"))
    return merged_vertices(graph.vertices, pair, at), transferred_edges(graph, pair, at)


def superseding(graph: Graph, batch: DataFrame, at: Column | None = None, new_id: Column | None = None, made_id: Column | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(vertex versions, edges, batch with new_id and old_id) of (ord, entity_id, new_fact, old_fact, source, confidence) rows that are already resolved.

    The old fact is the first live fact of the entity with that very content, replaced already or not; where there is none one
    is made. One row per pair of an entity and a new fact is expected. new_id and made_id give the ids of new facts and of old ones that are made.
    """
    at = at if at is not None else now()
    quoted = lambda c: F.when(c.isNotNull(), json_text(c))
    bag = lambda content, source: F.map_filter(F.create_map(F.lit("content"), quoted(content), F.lit("source"), quoted(source)), lambda _, v: v.isNotNull())
    facts = live(graph.vertices).filter(F.col("label") == "Fact")
    seq = F.col("seq") if "seq" in facts.columns else F.lit(0)
    asked = broadcast_if_small(batch.select("entity_id").distinct())
    linked = graph.edges.filter(F.col("label") == "RELATES_TO").select(F.col("start_id").alias("id"), F.col("end_id").alias("entity_id")).join(asked, "entity_id", "left_semi")
    held = facts.join(linked, "id").select("entity_id", F.get_json_object(F.concat(F.lit('{"c":'), F.coalesce(F.col("properties")["content"], F.lit("null")), F.lit("}")), "$.c").alias("old_fact"), F.struct(seq.alias("s"), "id").alias("k"))
    first = held.groupBy("entity_id", "old_fact").agg(F.min("k").alias("k")).select("entity_id", "old_fact", F.col("k.id").alias("found"))
    wanted = F.col("old_fact").isNotNull() & (F.col("old_fact") != "")
    drawn = batch.join(first, ["entity_id", "old_fact"], "left").withColumn("new_id", new_id if new_id is not None else F.uuid())
    drawn = drawn.withColumn("old_id", F.when(wanted, F.coalesce("found", made_id if made_id is not None else F.uuid())))
    rows = Scratch(graph.vertices.sparkSession, "superseding").write(drawn)  # ids are drawn once, all tables are made from them
    vertex = lambda i, content, source, confidence, replaced, ord_: dict(label=F.lit("Fact"), id=i, name=F.substring(content, 1, FACT_NAME_LENGTH), properties=merged(bag(content, source), F.create_map(F.lit("_superseded"), F.lit("true")) if replaced else F.create_map().cast(_BAG)), created_at=at, confidence=confidence, deleted=F.lit(False), seq=ord_)
    shaped = lambda df, spec: df.select(*(c.alias(n) for n, c in spec.items()))
    null = F.lit(None)
    new = shaped(rows, vertex(F.col("new_id"), F.col("new_fact"), F.col("source"), F.col("confidence").cast("double"), False, F.col("ord").cast("long")))
    made = shaped(rows.filter(wanted & F.col("found").isNull()), vertex(F.col("old_id"), F.col("old_fact"), null.cast("string"), null.cast("double"), True, F.col("ord").cast("long")))
    marked = graph.vertices.join(broadcast_if_small(rows.filter("found is not null").select(F.col("found").alias("id")).distinct()), "id", "left_semi").withColumn("properties", merged(F.col("properties"), F.create_map(F.lit("_superseded"), F.lit("true")))).withColumn("seq", seq.cast("long"))
    columns = ["label", "id", "name", "properties", "created_at", "confidence", "deleted", "seq"]
    vertices = new.select(*columns).unionByName(made.select(*columns)).unionByName(marked.select(*columns))
    edge = lambda df, label, a, b, bag_: df.select(F.lit(label).alias("label"), F.uuid().alias("id"), F.col(a).alias("start_id"), F.col(b).alias("end_id"), bag_.alias("properties"), at.alias("created_at"), F.col("ord").cast("long").alias("seq"))
    empty = F.create_map().cast(_BAG)
    stamp = F.create_map(F.lit("superseded_at"), F.concat(F.lit('"'), F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), F.lit('"')))
    edges = edge(rows, "RELATES_TO", "new_id", "entity_id", empty).unionByName(edge(rows.filter(wanted & F.col("found").isNull()), "RELATES_TO", "old_id", "entity_id", empty)).unionByName(edge(rows.filter(wanted), "SUPERSEDED_BY", "old_id", "new_id", stamp))
    return vertices, edges, rows


def resolve_references(refs: DataFrame, batch: DataFrame, vertices: DataFrame) -> DataFrame:
    """(index, field, id, error) of (index, field, ref, hint) rows: ends of relationships given by name or id.

    In turn: a vertex of the batch with this name (without case) and the hinted type; the only one of the batch with this name,
    of the hinted type if there is one; a live vertex with this id; the only live vertex with this name, of the hinted type
    if several have it; the only live vertex whose name contains the reference or is contained in it. batch: (name, label, id).
    """
    own = batch.groupBy(F.lower("name").alias("n"), "label").agg(F.max("id").alias("id"))
    typed = own.select(F.col("n").alias("low"), F.col("label").alias("hint"), F.col("id").alias("typed_id"))
    single = own.groupBy("n").agg(F.count(F.lit(1)).alias("k"), F.max("id").alias("single_id")).filter("k = 1").select(F.col("n").alias("low"), "single_id")
    alive = live(vertices).select("id", "label", "name")
    rows = refs.withColumn("low", F.lower("ref")).join(broadcast_if_small(typed), ["low", "hint"], "left").join(broadcast_if_small(single), "low", "left").withColumn("single_id", F.when(F.col("hint").isNull(), F.col("single_id")))
    done = F.coalesce("typed_id", "single_id")
    key = F.lower(strip(F.col("ref")))
    known = rows.withColumn("found", done).withColumn("key", F.when(done.isNull(), key))
    by_id = alive.select(F.lower("id").alias("key"), F.col("id").alias("by_id"))
    names = alive.groupBy(F.lower("name").alias("key"), "label").agg(F.count(F.lit(1)).alias("k"), F.min("id").alias("id"))
    by_name = names.groupBy("key").agg(F.sum("k").alias("n_exact"), F.min("id").alias("exact_id"))
    by_type = names.filter("k = 1").select("key", F.col("label").alias("hint"), F.col("id").alias("hinted_id"))
    met = known.join(by_id, "key", "left").join(by_name, "key", "left").join(by_type, ["key", "hint"], "left")
    strict = F.coalesce("found", F.when(is_uuid(F.col("key")), F.col("by_id")).otherwise(F.coalesce(F.when(F.col("n_exact") == 1, F.col("exact_id")), F.when(F.col("n_exact") > 1, F.col("hinted_id")))))
    met = met.withColumn("strict", strict)
    # only names without any full match are compared by containment
    weak = met.filter(F.col("strict").isNull() & F.col("n_exact").isNull() & ~is_uuid(F.col("key")) & (F.col("key") != "")).select("key").distinct()
    stored = names.groupBy(F.col("key").alias("name")).agg(F.sum("k").alias("k"), F.min("id").alias("id"))
    inside, around = containment(weak, stored.select("name")), containment(stored.select("name"), weak)
    pairs = inside.select(F.col("needle").alias("key"), F.col("hay").alias("name")).unionByName(around.select(F.col("hay").alias("key"), F.col("needle").alias("name"))).distinct()
    near = pairs.join(stored, "name").groupBy("key").agg(F.sum("k").alias("n_near"), F.min("id").alias("near_id"))
    full = met.join(near, "key", "left")
    id_ = F.coalesce("strict", F.when(F.col("n_near") == 1, F.col("near_id")))
    many = (F.coalesce("n_exact", F.lit(0)) > 1) | (F.coalesce("n_near", F.lit(0)) > 1)
    error = F.when(id_.isNull(), F.when(many, F.concat(F.lit('Ambiguous entity: "'), "ref", F.lit('"'))).otherwise(F.concat(F.lit('Entity not found: "'), F.coalesce("ref", F.lit("")), F.lit('"'))))
    return full.select("index", "field", id_.alias("id"), error.alias("error"))
