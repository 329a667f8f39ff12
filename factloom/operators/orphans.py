"""References to records that do not exist: keyed state of parents, settled, waiting and blank references, kept step by step.

A step takes what arrived since the last one. New references probe the parent index; arriving parents resolve references
that wait for them, also in hindsight if they turn out to be older; deletions reopen references that had been settled. Only
references whose record or parent changed get a new version; counts per month are kept as sums, from which what a former
version said is taken back. Hot keys: the probing side is split by the skew join of AQE, the parent side has one row a key.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from factloom.ids import pack_id, unpack_id
from factloom.runtime import Files, Scratch, broadcast_if_small

#: Steps after which the versions of references are folded into one table.
FOLD_STEPS = 8

_ID = ["ref_table", "ref_id", "ref_field"]
_REFS = "ref_table string, ref_id binary, ref_field string, arrived timestamp_ntz, key_at timestamp_ntz, key binary, seen timestamp_ntz, gone timestamp_ntz, step int, status string"
_PARENTS = "key binary, seen timestamp_ntz, gone timestamp_ntz"
_MOVES = "ref_table string, month timestamp_ntz, n_arrived long, change long"


def reference_rows(df: DataFrame, table: str, fields: list[str], ref_id: str = "id", arrived: str = "ingested_at") -> DataFrame:
    """(ref_table, ref_id, keys, arrived): one row per stored row; keys holds the fields' packed ids, in the order of `fields`."""
    keys = F.array(*(F.struct(F.lit(f).alias("ref_field"), pack_id(F.col(f)).alias("key")) for f in fields))
    return df.select(F.lit(table).alias("ref_table"), pack_id(F.col(ref_id)).alias("ref_id"), keys.alias("keys"), F.col(arrived).alias("arrived"))


def parent_rows(df: DataFrame, key: str = "id", seen: str = "ingested_at", gone: str = "deleted_at") -> DataFrame:
    """(key, seen, gone) of each stored row of a parent table."""
    return df.select(pack_id(F.col(key)).alias("key"), F.col(seen).alias("seen"), F.col(gone).alias("gone"))


class OrphanTracker:
    """Feed `advance` with what arrived; ask `found` and `monthly` at any time. Results do not depend on how rows are cut into steps.

    A reference is an orphan if its parent is not live when it arrives: live from the parent's earliest row until just
    before it is deleted. Null and blank references and records without an id are no references. A record that arrives
    again keeps its earliest arrival, and of each field the earliest value that is filled (of rows at one instant the smallest).

    The state is kept under `root`, in the session's shared folder if none is given (it then ends with the driver). A step writes
    its tables beside those of the last one and is committed by one small file, so a step that fails changes nothing,
    and a batch number that was committed is not taken again. A tracker made with the root of another goes on where it ended.
    """

    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark, self.files = spark, Files(spark, root or Scratch(spark, "orphans").root)
        done = [n for n in self.files.names("steps") if n.endswith(".json")]
        self.state = json.loads(self.files.read(f"steps/{done[-1]}")) if done else {"step": 0, "batch": None, "parents": None, "refs": [], "moves": None}

    # -- tables

    def _read(self, schema: str, *folders: str) -> DataFrame:
        paths = [self.files.path(f) for f in folders if f]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(f"{schema}, version string").option("basePath", paths[0].rsplit("/", 1)[0]).parquet(*paths).drop("version")

    def _write(self, df: DataFrame, name: str, *by: str) -> tuple[str, int]:
        folder, seen = f"{name}/version={uuid.uuid4().hex}", Observation()
        writer = df.observe(seen, F.count(F.lit(1)).alias("rows")).write.option("compression", "zstd")
        (writer.partitionBy(*by) if by else writer).parquet(self.files.path(folder))
        return folder, seen.get.get("rows") or 0

    def _versions(self) -> DataFrame:
        return self._read(_REFS, *self.state["refs"])

    def _current(self, versions: DataFrame) -> DataFrame:
        """The last version of each reference."""
        if len(self.state["refs"]) < 2:
            return versions
        rest = [c for c in versions.columns if c not in _ID and c != "step"]
        return versions.groupBy(*_ID).agg(F.max(F.struct("step", *rest)).alias("v")).select(*_ID, "v.*")

    # -- steps

    def advance(self, references: DataFrame, parents: DataFrame, batch: int | None = None) -> None:
        """Takes a step; a batch that was taken before is left alone."""
        last = self.state
        if batch is not None and last["batch"] is not None and batch <= last["batch"]:
            return
        step = last["step"] + 1
        index, n_index = self._write(self._index(parents), "parents")
        changed_parents = self._read(f"{_PARENTS}, is_new boolean, is_gone boolean", index)
        parents_now = changed_parents.select("key", "seen", "gone")
        # each stored row has all fields, filled or not, so the first arrival of a field is that of its record
        rows = references.filter("ref_id is not null").select("ref_table", "ref_id", "arrived", F.inline("keys"))
        filled = F.when(F.col("key").isNotNull(), F.struct(F.col("arrived").alias("key_at"), "key"))
        new = rows.groupBy(*_ID).agg(F.min("arrived").alias("arrived"), F.min(filled).alias("filled")).select(*_ID, "arrived", "filled.key_at", "filled.key")
        folders = []
        if last["refs"]:
            folder, n_new = self._write(new, "arrivals")
            folders.append(folder)
            new = self._read("ref_table string, ref_id binary, ref_field string, arrived timestamp_ntz, key_at timestamp_ntz, key binary", folder)
            merged = self._with_former(new, n_new, changed_parents)
        else:
            merged = new.withColumn("former", F.lit(None).cast("struct<arrived:timestamp_ntz,key:binary,seen:timestamp_ntz,gone:timestamp_ntz,status:string>"))
        # new references, and those whose record or parent changed, probe the index
        probed = merged.join(parents_now if n_index else parents_now.limit(0), "key", "left")
        live = F.coalesce((F.col("seen") <= F.col("arrived")) & (F.col("gone").isNull() | (F.col("arrived") < F.col("gone"))), F.lit(False))
        status = F.when(F.col("key").isNull(), "blank").when(live, "settled").otherwise("orphan")
        judged = probed.withColumn("status", status)
        same = F.lit(True)
        for c in ("arrived", "key", "gone", "status"):
            same = same & F.col(c).eqNullSafe(F.col(f"former.{c}"))
        # when a settled reference's parent was seen makes no difference
        same = same & ((F.col("status") == "settled") | F.col("seen").eqNullSafe(F.col("former.seen")))
        changed = judged.filter(F.col("former").isNull() | ~same).select(*_ID, "arrived", "key_at", "key", "seen", "gone", F.lit(step).alias("step"), "former", "status")
        refs, n = self._write(changed, "refs", "status")
        written = self._read(_REFS.replace("step int", "step int, former struct<arrived:timestamp_ntz,key:binary,seen:timestamp_ntz,gone:timestamp_ntz,status:string>"), refs)
        was = written.filter("former is not null").select("ref_table", "former.*")
        moves = self._read(_MOVES, last["moves"]).unionByName(self._moves(written, 1)).unionByName(self._moves(was, -1))
        moves, _ = self._write(moves.groupBy("ref_table", "month").agg(F.sum("n_arrived").alias("n_arrived"), F.sum("change").alias("change")), "moves")
        self._commit({"step": step, "batch": batch if batch is not None else last["batch"], "parents": index, "refs": [*last["refs"], *([refs] if n else [])], "moves": moves}, folders)
        if len(self.state["refs"]) > FOLD_STEPS:
            self.fold()

    def fold(self) -> None:
        """Writes the versions of references as one table."""
        one, _ = self._write(self._current(self._versions()).select(*[c.split(" ")[0] for c in _REFS.split(", ")]), "refs", "status")
        self._commit(self.state | {"step": self.state["step"] + 1, "refs": [one]})

    def _commit(self, state: dict, unused: list[str] = ()) -> None:
        self.files.make("steps")
        if not self.files.put(f"steps/{state['step']:010d}.json", json.dumps(state)):
            raise RuntimeError("another tracker took this step")
        before, self.state = self.state, state
        named = lambda s: {s["parents"], s["moves"], *s["refs"]}
        for folder in (named(before) - named(state) - {None}) | set(unused):
            self.files.delete(folder)

    def _index(self, parents: DataFrame) -> DataFrame:
        """(key, seen, gone, is_new, is_gone): all parents known now; is_new if seen (earlier), is_gone if deleted (earlier) than known before."""
        came = parents.filter("key is not null").select("key", "seen", "gone", F.lit(None).cast("timestamp_ntz").alias("old_seen"), F.lit(None).cast("timestamp_ntz").alias("old_gone"))
        before = self._read(_PARENTS, self.state["parents"])
        both = came.unionByName(before.select("key", "seen", "gone", F.col("seen").alias("old_seen"), F.col("gone").alias("old_gone")))
        now = both.groupBy("key").agg(*(F.min(c).alias(c) for c in ("seen", "gone")), *(F.max(c).alias(c) for c in ("old_seen", "old_gone")))
        return now.select("key", "seen", "gone", (~F.col("seen").eqNullSafe(F.col("old_seen"))).alias("is_new"), (~F.col("gone").eqNullSafe(F.col("old_gone"))).alias("is_gone"))

    def _with_former(self, new: DataFrame, n_new: int, index: DataFrame) -> DataFrame:
        """(..., former): arrivals and what is known of the same references, and known references whose parent came or was deleted."""
        versions = self._versions()
        gone, here = index.filter("is_gone").select("key"), index.filter("is_new or is_gone").select("key")
        waits = versions.filter("status = 'orphan'").select(*_ID, "key")
        moved = versions.filter("status = 'settled'").select(*_ID, "key").join(broadcast_if_small(gone), "key", "left_semi").select(*_ID)
        moved = moved.unionByName(here.join(broadcast_if_small(waits), "key").select(*_ID))
        ids = new.select(*_ID, F.lit(True).alias("asked")).unionByName(moved.select(*_ID, F.lit(True).alias("asked")))
        known = versions.withColumn("asked", F.lit(False)).unionByName(ids, allowMissingColumns=True).unionByName(new.withColumn("asked", F.lit(False)), allowMissingColumns=True)
        # of versions the last one counts; arrivals have no step
        version = F.when(F.col("step").isNotNull(), F.struct("step", "arrived", "key_at", "key", "seen", "gone", "status"))
        came = F.when(F.col("step").isNull() & ~F.col("asked"), F.struct("key_at", "key"))
        both = known.groupBy(*_ID).agg(F.max("asked").alias("asked"), F.max(version).alias("v"), F.min(F.when(F.col("step").isNull() & ~F.col("asked"), F.col("arrived"))).alias("came"), F.min(F.when(came["key"].isNotNull(), came)).alias("filled")).filter("asked")
        old = F.when(F.col("v.key").isNotNull(), F.struct(F.col("v.key_at").alias("key_at"), F.col("v.key").alias("key")))
        merged = both.select(*_ID, F.least("came", "v.arrived").alias("arrived"), F.least(F.col("filled"), old).alias("f"), F.when(F.col("v").isNotNull(), F.struct("v.arrived", "v.key", "v.seen", "v.gone", "v.status")).alias("former"))
        return merged.select(*_ID, "arrived", "f.key_at", "f.key", "former")

    @staticmethod
    def _moves(refs: DataFrame, sign: int) -> DataFrame:
        """(ref_table, month, n_arrived, change): what references say of the months in which they are open, or take it back."""
        orphan, deleted = F.col("status") == "orphan", F.col("gone").isNotNull()
        later = orphan & (F.col("seen") > F.col("arrived"))
        move = lambda when, at, came, by: F.when(when, F.struct(F.date_trunc("month", F.col(at)).alias("month"), F.lit(came * sign).cast("long").alias("n_arrived"), F.lit(by * sign).cast("long").alias("change")))
        each = F.array(move(orphan, "arrived", 1, 1), move(later, "seen", 0, -1), move(deleted & (later | (F.col("status") == "settled")), "gone", 0, 1))
        rows = refs.filter("status = 'orphan' or (status = 'settled' and gone is not null)").select("ref_table", F.explode(F.filter(each, lambda x: x.isNotNull())).alias("m")).select("ref_table", "m.*")
        return rows.groupBy("ref_table", "month").agg(F.sum("n_arrived").alias("n_arrived"), F.sum("change").alias("change"))

    # -- results

    def found(self) -> DataFrame:
        """(ref_table, ref_id, ref_field) of every reference whose parent was not live when it arrived."""
        now = self._versions()
        orphans = now.filter("status = 'orphan'").select(*_ID, "step")
        if len(self.state["refs"]) > 1:
            # a later version, whatever it says, replaces an earlier one
            later = now.select(*_ID, "step", F.lit(False).alias("own")).join(broadcast_if_small(orphans.select(*_ID).distinct()), _ID, "left_semi")
            orphans = later.unionByName(orphans.withColumn("own", F.lit(True))).groupBy(*_ID).agg(F.max("step").alias("last"), F.max(F.when(F.col("own"), F.col("step"))).alias("step")).filter("last = step")
        return orphans.select("ref_table", unpack_id(F.col("ref_id")).alias("ref_id"), "ref_field")

    def monthly(self) -> DataFrame:
        """(ref_table, month, n_arrived, n_open): orphans that arrived in the month; references open at its end. Months without a change are left out."""
        w = Window.partitionBy("ref_table").orderBy("month")  # one row a month
        moves = self._read(_MOVES, self.state["moves"]).filter("n_arrived != 0 or change != 0")
        opened = moves.withColumn("n_open", F.sum("change").over(w))
        return opened.select("ref_table", F.date_format("month", "yyyy-MM").alias("month"), "n_arrived", "n_open")


def track(references: list[DataFrame], parents: list[DataFrame], steps: int = 3) -> OrphanTracker:
    """Replay whole tables through the tracker in `steps` slices of equal time, as they arrived.

    A deletion is known from the row that states it. Rows without an arrival come in the first slice.
    """
    spark = references[0].sparkSession
    refs, pars = reduce(DataFrame.unionByName, references), reduce(DataFrame.unionByName, parents)
    span = pars.select(F.col("seen").alias("t")).unionByName(refs.select(F.col("arrived").alias("t"))).agg(F.min("t"), F.max("t")).first()
    tracker = OrphanTracker(spark)
    if span[0] is None:
        tracker.advance(refs, pars)
        return tracker
    cuts = [F.lit(span[0] + (span[1] - span[0]) * k / steps).cast("timestamp_ntz") for k in range(1, steps)]

    def within(c: Column, k: int) -> Column:
        """A slice, in a form that reaches the scan."""
        if k == 0:
            return c.isNull() | (c < cuts[0]) if cuts else F.lit(True)
        return (c >= cuts[k - 1]) & (c < cuts[k]) if k < steps - 1 else c >= cuts[k - 1]

    for k in range(steps):
        tracker.advance(refs.filter(within(F.col("arrived"), k)), pars.filter(within(F.col("seen"), k)), k)
    return tracker
