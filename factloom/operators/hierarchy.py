"""Parent-child links to full hierarchies: Euler tours ranked by list contraction.

Every row links a child to at most one parent, so the rows form trees and, where links run in a circle, cycles.
Nodes are numbered once; from then on only numbers are shuffled.

1. Leaves are peeled: a leaf's step down and step up are one element of the tour. Every other linked node has two
   (down, up), every root one (its start).
2. The elements form linked lists. Each round, elements with coin 1 absorb a successor with coin 0 and add its
   weight, so a round removes about a quarter of the elements whatever the depth; lists that have shrunk to their head
   leave. The last `LOCAL_ELEMENTS` elements are ranked by pointer jumping in one task, a bound that no input exceeds.
3. Replaying the rounds backwards gives each element its prefix sums: the entry (rank in preorder), the depth, and the
   list it lies on. A node's entry-exit interval holds exactly its descendants.
4. Where links run in a circle, tours have no end and close on themselves. A link lies on the circle exactly when its two
   sides are on different closed tours: a link that is no part of a circle has the same tour on either side.

Peeling leaf by leaf until only circles are left needs as many rounds as the deepest tree has levels, one distributed job
each. Step 4 finds the same nodes without those rounds, so only the first peeling round is carried out.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from factloom.ids import pack_id, unpack_id
from factloom.runtime import Scratch, ship

#: At most so many list elements are ranked in one task; above it the distributed rounds go on.
LOCAL_ELEMENTS = 1 << 15
#: A parent with more children than this share of all links has its children chained in buckets.
HOT_SHARE = 1e-3
HOT_LEAST = 50_000
HOT_BUCKETS = 256
#: Replayed rounds per job; beyond it the ranks are written, so that lineage stays short.
REPLAY_ROUNDS = 6


def _coin(c: Column, seed: int) -> Column:
    return F.xxhash64(c, F.lit(seed)).bitwiseAND(1) == 1


def number_nodes(rows: DataFrame, node: str, parent: str, scratch: Scratch) -> DataFrame:
    """(num, id, parent): one row per distinct node, ids packed, numbered; the parent is the one filled value, if any.

    Rows without an id are left out: nothing can name them. Of several parents of one node the largest counts.
    """
    distinct = rows.select(pack_id(F.col(node)).alias("id"), pack_id(F.col(parent)).alias("parent")).filter("id is not null").groupBy("id").agg(F.max("parent").alias("parent"))
    return scratch.write(distinct.select(F.monotonically_increasing_id().alias("num"), "id", "parent"), "nodes")


def links(nodes: DataFrame) -> DataFrame:
    """(child, parent) as numbers, of the nodes whose parent exists. A hot parent is split by the skew join of AQE."""
    named = nodes.filter("parent is not null").select(F.col("num").alias("child"), F.col("parent").alias("id"))
    return named.join(nodes.select("id", F.col("num").alias("parent")), "id").select("child", "parent")


def _siblings(edges: DataFrame, n_edges: int) -> tuple[DataFrame, DataFrame]:
    """(child, parent, next) and (parent, first): every node's children in a chain, no chain built in one group of unbounded size."""
    most = max(HOT_LEAST, int(n_edges * HOT_SHARE))
    hot = [r[0] for r in edges.groupBy("parent").count().filter(F.col("count") > most).select("parent").collect()] if n_edges > most else []  # at most 1 / HOT_SHARE rows
    if not hot:
        w = Window.partitionBy("parent").orderBy("child")
        chain = edges.select("child", "parent", F.lead("child").over(w).alias("next"), (F.row_number().over(w) == 1).alias("is_first"))
        return chain.select("child", "parent", "next"), chain.filter("is_first").select("parent", F.col("child").alias("first"))
    bucket = F.when(F.col("parent").isin(hot), F.pmod(F.xxhash64("child"), F.lit(HOT_BUCKETS))).otherwise(0)
    w = Window.partitionBy("parent", "bucket").orderBy("child")
    chain = edges.withColumn("bucket", bucket).select("child", "parent", "bucket", F.lead("child").over(w).alias("within"), (F.row_number().over(w) == 1).alias("is_first"))
    heads = chain.filter("is_first").select("parent", "bucket", F.col("child").alias("first"))
    over = Window.partitionBy("parent").orderBy("bucket")  # of a hot parent HOT_BUCKETS rows, of any other one
    jumps = heads.filter(F.col("parent").isin(hot)).select("parent", "bucket", F.lead("first").over(over).alias("jump"))
    chain = chain.join(F.broadcast(jumps), ["parent", "bucket"], "left").select("child", "parent", F.coalesce("within", "jump").alias("next"))
    return chain, heads.groupBy("parent").agg(F.min_by("first", "bucket").alias("first"))


def _elements(edges: DataFrame, n_edges: int, ends: bool) -> DataFrame:
    """(id, next, wp, wd, head): the tour's elements. 2c: down to c (or c's only element if it is a leaf), 2c + 1: up from c.

    A root's step up, which only its own exit needs, is made if `ends`; else the rounds turn links to it into ends.
    """
    chain, firsts = _siblings(edges, n_edges)
    both = chain.join(firsts.withColumnRenamed("parent", "child").withColumn("has", F.lit(True)), "child", "full")
    linked, leaf = F.col("parent").isNotNull(), F.col("first").isNull()
    after = F.coalesce(F.col("next") * 2, F.col("parent") * 2 + 1)
    element = lambda i, n, p, d, h: F.struct(i.alias("id"), n.alias("next"), F.lit(p).cast("long").alias("wp"), F.lit(d).alias("wd"), F.lit(h).alias("head"))
    down, up = F.col("child") * 2, F.col("child") * 2 + 1
    made = F.when(linked & leaf, F.array(element(down, after, 1, 0, False))).when(linked, F.array(element(down, F.col("first") * 2, 1, 1, False), element(up, after, 0, -1, False))).otherwise(F.array(element(down, F.col("first") * 2, 1, 0, True), *([element(up, F.lit(None).cast("long"), 0, 0, False)] if ends else [])))
    return both.select(F.inline(made))


def _round(active: DataFrame, seed: int) -> DataFrame:
    """One contraction: (id, next, wp, wd, head) of what is left, with the absorbed element y and its offsets op, od."""
    takes = (F.col("head") | _coin(F.col("id"), seed)) & F.col("next").isNotNull() & ~_coin(F.col("next"), seed) & (F.col("next") != F.col("id"))
    rows = active.withColumn("takes", F.coalesce(takes, F.lit(False))).withColumn("key", F.when(F.col("takes"), F.col("next")).otherwise(F.col("id")))
    of = lambda role, c: F.max(F.when(F.col("takes") if role == "a" else ~F.col("takes"), F.col(c))).alias(f"{role}_{c}")
    met = rows.groupBy("key").agg(*(of("a", c) for c in ("id", "wp", "wd", "head")), *(of("s", c) for c in ("id", "next", "wp", "wd", "head")))
    took = F.col("a_id").isNotNull()
    plus = lambda c: F.when(took, F.col(f"a_{c}") + F.coalesce(F.col(f"s_{c}"), F.lit(0))).otherwise(F.col(f"s_{c}")).alias(c)
    gone = took & F.col("s_id").isNotNull()
    return met.select(
        F.coalesce("a_id", "s_id").alias("id"), F.col("s_next").alias("next"), plus("wp"), plus("wd"), F.coalesce("a_head", "s_head").alias("head"),
        F.when(gone, F.col("key")).alias("y"), F.when(gone, F.col("a_wp")).alias("op"), F.when(gone, F.col("a_wd")).alias("od"),
    )


def _rank_locally(batches):
    """Ranks of the last elements, all in one task: pointer jumping towards the head, closed lists cut at their smallest element."""
    pdf = pd.concat(list(batches) or [pd.DataFrame()], ignore_index=True)
    if not len(pdf):
        return
    ids, order = np.sort(pdf["id"].to_numpy(np.int64)), np.argsort(pdf["id"].to_numpy(np.int64))
    pdf = pdf.iloc[order].reset_index(drop=True)
    n, none = len(ids), pdf["next"].isna().to_numpy()
    nxt = pdf["next"].fillna(-1).to_numpy(np.int64)
    at = np.minimum(np.searchsorted(ids, nxt), n - 1)
    there = ~none & (ids[at] == nxt)
    pred = np.arange(n)
    pred[at[there]] = np.flatnonzero(there)
    wp, wd, head = pdf["wp"].to_numpy(np.int64), pdf["wd"].to_numpy(np.int64), pdf["head"].to_numpy(bool)
    rounds = max(1, int(np.ceil(np.log2(n + 1))) + 1)
    jump, least = pred.copy(), np.arange(n)
    for _ in range(rounds):
        least, jump = np.minimum(least, least[jump]), jump[jump]
    closed = pred[jump] != jump  # no start was reached
    pred[closed & (least == np.arange(n))] = np.flatnonzero(closed & (least == np.arange(n)))
    pos, dep, jump = np.where(pred == np.arange(n), 0, wp[pred]), np.where(pred == np.arange(n), 0, wd[pred]), pred.copy()
    for _ in range(rounds):
        pos, dep, jump = pos + pos[jump], dep + dep[jump], jump[jump]
    yield pd.DataFrame({"id": ids, "pos": pos, "dep": dep, "tour": ids[jump], "open": head[jump]})


def rank_tours(edges: DataFrame, scratch: Scratch, ends: bool = False) -> DataFrame:
    """(id, pos, dep, tour, open) of each tour element: sums of weights before it, its list, and whether the list has a start."""
    edges = scratch.write(edges, "links")
    seen = Observation()
    table = scratch.write(_elements(edges, edges.scratch_rows, ends).observe(seen, F.count(F.lit(1)).alias("n")), "elements")
    left, rounds, active = seen.get["n"], [], table
    done = (F.col("head") & F.col("next").isNull()) | (F.col("next") == F.col("id"))
    while left > LOCAL_ELEMENTS:
        seen = Observation()
        table = scratch.write(_round(active, len(rounds)).observe(seen, F.count_if(~F.coalesce(done, F.lit(False))).alias("n")), f"round{len(rounds)}")
        rounds.append(table)
        active, left = table.select("id", "next", "wp", "wd", "head").filter(~F.coalesce(done, F.lit(False))), seen.get["n"] or 0
    ship(edges.sparkSession)
    local = active.repartition(1).mapInPandas(_rank_locally, "id long, pos long, dep long, tour long, open boolean")
    ranks = local
    for k, table in reversed(list(enumerate(rounds))):
        started = table.filter(done).select("id", F.lit(0).cast("long").alias("pos"), F.lit(0).cast("long").alias("dep"), F.col("id").alias("tour"), F.col("head").alias("open"))
        known = ranks.unionByName(started)
        absorbed = table.filter("y is not null").select("id", "y", "op", "od")
        # an element absorbs one other a round, so every group has one rank and at most one absorbed element
        rows = known.withColumn("y", F.lit(None).cast("long")).withColumn("op", F.lit(None).cast("long")).withColumn("od", F.lit(None).cast("long")).unionByName(absorbed, allowMissingColumns=True)
        met = rows.groupBy("id").agg(*(F.max(c).alias(c) for c in ("pos", "dep", "tour", "open", "y", "op", "od")))
        it = lambda i, p, d: F.struct(i.alias("id"), p.alias("pos"), d.alias("dep"), F.col("tour"), F.col("open"))
        own = it(F.col("id"), F.col("pos"), F.col("dep"))
        ranks = met.select(F.inline(F.when(F.col("y").isNull(), F.array(own)).otherwise(F.array(own, it(F.col("y"), F.col("pos") + F.col("op"), F.col("dep") + F.col("od"))))))
        if k and (len(rounds) - k) % REPLAY_ROUNDS == 0:
            ranks = scratch.write(ranks, "ranks")
    return ranks


def _by_node(ranks: DataFrame) -> DataFrame:
    """(node, entry, exit, depth, down, up, open): both elements of a node together."""
    even = F.col("id").bitwiseAND(1) == 0
    met = ranks.groupBy(F.shiftright("id", 1).alias("node")).agg(
        F.max(F.when(even, F.col("pos"))).alias("entry"), F.max(F.when(~even, F.col("pos") - 1)).alias("exit"), F.max(F.when(even, F.col("dep"))).alias("dep"),
        F.max(F.when(even, F.col("tour"))).alias("down"), F.max(F.when(~even, F.col("tour"))).alias("up"), F.max("open").alias("open"),
    )
    return met.select("node", "entry", F.coalesce("exit", "entry").alias("exit"), (F.col("dep") + 1).alias("depth"), "down", F.coalesce("up", "down").alias("up"), "open")


def _circle_faces(by_node: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, id) of the nodes on circles; (tour, root) for both closed tours of every circle, root the number of its smallest id."""
    on = by_node.filter("not open and down != up").select("node", "down", "up")
    named = on.join(nodes.select(F.col("num").alias("node"), unpack_id(F.col("id")).alias("id")), "node")
    faces = named.select("node", "id", F.explode(F.array("down", "up")).alias("tour")).groupBy("tour").agg(F.min_by("node", "id").alias("root"))
    return on.select("node"), faces


def _with_ids(of: DataFrame, nodes: DataFrame, *columns: str) -> DataFrame:
    for number, text in columns:
        of = of.join(nodes.select(F.col("num").alias(number), F.col("id").alias(text)), number).drop(number)
    return of.select(*(unpack_id(F.col(t)).alias(t) for _, t in columns), *(c for c in of.columns if c not in dict(columns).values()))


def find_roots(rows: DataFrame, node: str = "id", parent: str = "superseded_by") -> DataFrame:
    """(fact_id, root_id): one row per distinct node whose parent exists, with the node where following the links ends.

    A node whose parent is null, blank or names no node ends a walk. Where the links run in a circle, root_id is the
    smallest id on the circle. Repeated rows count once; rows without an id are left out; ids agree without regard to
    case and outer white space. An empty table gives no rows; columns besides the two named are not read.
    """
    scratch = Scratch(rows.sparkSession, "roots")
    nodes = number_nodes(rows, node, parent, scratch)
    by_node = scratch.write(_by_node(rank_tours(links(nodes), scratch)).filter("not (open and shiftright(down, 1) = node)"), "nodes-ranked")
    _, faces = _circle_faces(by_node, nodes)
    trees = by_node.filter("open").select("node", F.shiftright("down", 1).alias("root"))
    rings = by_node.filter("not open").select("node", F.col("down").alias("tour")).join(faces, "tour").select("node", "root")
    return _with_ids(trees.unionByName(rings), nodes, ("node", "fact_id"), ("root", "root_id")).select("fact_id", "root_id")


class Hierarchy:
    """All results of the links of `rows`: circles are exposed first and cut at their smallest id, which then is a root.

    nodes: fact_id, root_id, parent_id, depth (0 for roots), entry, exit, n_descendants, in_cycle. Every distinct node has one
    row, those without links too. The descendants of v are the nodes of the same root with v.entry < entry <= v.exit.
    """

    def __init__(self, rows: DataFrame, node: str = "id", parent: str = "superseded_by"):
        self.scratch = s = Scratch(rows.sparkSession, "hierarchy")
        self.numbered = nodes = number_nodes(rows, node, parent, s)
        edges = s.write(links(nodes), "all-links")
        first = s.write(_by_node(rank_tours(edges, s, ends=True)), "first-tours")
        on, faces = _circle_faces(first, nodes)
        on, faces = s.write(on, "on-circles"), s.write(faces, "faces")
        closed = first.filter("not open").select("node")
        # only what hangs on circles is ranked a second time, each circle cut at its smallest id
        cut = edges.join(closed.withColumnRenamed("node", "child"), "child", "left_semi").join(faces.select(F.col("root").alias("child")).distinct(), "child", "left_anti")
        second = _by_node(rank_tours(cut, s, ends=True))
        spans = first.filter("open").unionByName(second).select("node", F.shiftright("down", 1).alias("root"), "entry", "exit", F.when(F.col("node") == F.shiftright("down", 1), F.lit(0)).otherwise(F.col("depth")).alias("depth"))
        self.spans = s.write(spans, "spans")
        self.tree_links = s.write(edges.join(faces.select(F.col("root").alias("child")).distinct(), "child", "left_anti"), "tree-links")
        self.on = on

    def nodes(self) -> DataFrame:
        n = self.numbered
        full = n.select(F.col("num").alias("node"), "id").join(self.spans, "node", "left").join(self.tree_links.withColumnRenamed("child", "node"), "node", "left")
        full = full.join(self.on.withColumn("in_cycle", F.lit(True)), "node", "left").withColumn("root", F.coalesce("root", "node"))
        ids = lambda number, text: n.select(F.col("num").alias(number), F.col("id").alias(text))
        full = full.join(ids("root", "root_b"), "root").join(ids("parent", "parent_b"), "parent", "left")
        zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
        return full.select(
            unpack_id(F.col("id")).alias("fact_id"), unpack_id(F.col("root_b")).alias("root_id"), unpack_id(F.col("parent_b")).alias("parent_id"),
            zero("depth"), zero("entry"), zero("exit"), (F.coalesce("exit", F.lit(0)) - F.coalesce("entry", F.lit(0))).cast("long").alias("n_descendants"), F.coalesce("in_cycle", F.lit(False)).alias("in_cycle"),
        )

    def _chains(self) -> DataFrame:
        """(node, up): the numbers of the nodes from a linked node's parent to its root.

        Segments double each round, so depth d takes log2(d) rounds. Finished chains are set aside: later rounds only read them as
        what others go on with, and no round after the first looks a root up, however many nodes hang on it.
        """
        s = self.scratch
        step, done = s.write(self.tree_links.select(F.col("child").alias("node"), F.col("parent").alias("at"), F.array("parent").alias("up")), "steps"), []
        seen = 1
        while seen:
            known = reduce(DataFrame.unionByName, [step, *done])
            more = known.select(F.col("node").alias("at"), F.col("at").alias("further"), F.col("up").alias("rest"))
            met = step.join(more, "at", "left").select("node", F.coalesce("further", "at").alias("at"), F.when(F.col("rest").isNull(), F.col("up")).otherwise(F.concat("up", "rest")).alias("up"), F.col("rest").isNull().alias("ended"))
            obs = Observation()
            new = s.write(met.observe(obs, F.count_if(~F.col("ended")).alias("n")), "paths", by=["ended"])
            seen = obs.get["n"] or 0
            s.drop(step)
            done.append(new.filter("ended").select("node", "at", "up"))
            step = new.filter("not ended").select("node", "at", "up")
        return reduce(DataFrame.unionByName, done)

    def paths(self) -> DataFrame:
        """(fact_id, path): the ids from the node to its root, both included. Nodes on cut circles follow the links up to the smallest id."""
        ids = self.numbered.select(F.col("num"), "id")
        long = self._chains().select("node", F.posexplode(F.concat(F.array("node"), "up")).alias("k", "num")).join(ids, "num")
        alone = self.numbered.join(self.tree_links.select(F.col("child").alias("num")), "num", "left_anti").select(unpack_id(F.col("id")).alias("fact_id"), F.array(unpack_id(F.col("id"))).alias("path"))
        of = long.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("k", "id"))).alias("p")).select(F.transform("p", lambda x: unpack_id(x["id"])).alias("path"))
        return of.select(F.col("path")[0].alias("fact_id"), "path").unionByName(alone)

    def descendants(self) -> DataFrame:
        """(fact_id, descendant_id): every node with all nodes below it, as many rows as there are; read the other way the ancestors of each node."""
        pairs = self._chains().select(F.explode("up").alias("above"), "node")
        return _with_ids(pairs, self.numbered, ("above", "fact_id"), ("node", "descendant_id")).select("fact_id", "descendant_id")
