"""History of changing attributes: type-two dimensions that hold every version with its period.

A version starts at an entity's first observation and wherever the attribute's hash, or behind an
equal hash the value, differs from the version before it; it is valid until the next version starts (``valid_to``; null while open).
``seen_until`` is the last observation that confirmed the version. ``merge_history`` merges one batch after another
into a ``Dimension``; ``history`` is the fold of sorted ranges that it uses to reduce a batch to runs.

Defined results: observations whose entity, value or time is null are disregarded; of several with
the same entity and time only the one with the highest id counts; repeated rows change nothing; an
empty input gives an empty history. Columns of the input other than the four named ones are ignored,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestream.operators.keyed import small_or_shuffled
from lodestream.operators.runs import flat, ranged, starts
from lodestream.session import materialize

COLUMNS = ["entity", "value", "attr_hash", "valid_from", "valid_to", "seen_until", "is_current"]


def attr_hash(value: str) -> Column:
    return F.xxhash64(value)


def observations(df: DataFrame, entity: str, value: Column, at: str, row_id: str) -> DataFrame:
    """(entity, value, at, row_id): one observation for each entity and time, the one with the highest id.

    The aggregation combines on the map side, so a snapshot delivered very often stays small.
    """
    seen = df.select(F.col(entity).alias("entity"), value.alias("value"), F.col(at).alias("at"), F.col(row_id).alias("row_id"))
    seen = seen.where("entity is not null and value is not null and at is not null")
    best = seen.groupBy("entity", "at").agg(F.max(F.struct("row_id", "value")).alias("b"))
    return best.select("entity", F.col("b.value").alias("value"), "at", F.col("b.row_id").alias("row_id"))


def _versions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The versions of one sorted range. The last is held back, as later rows may confirm or close it."""
    pid, ordinal, held, out_schema = TaskContext.get().partitionId(), 0, None, None

    def emit(rows: list[tuple], tail: bool) -> pa.RecordBatch:
        nonlocal ordinal
        cols = [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), out_schema, strict=False)]
        numbers = pa.array(range(ordinal, ordinal + len(rows)), pa.int64())
        ordinal += len(rows)
        return pa.record_batch([*cols, pa.array([pid] * len(rows), pa.int32()), numbers, pa.array([tail] * len(rows))], names=["entity", "attr_hash", "value", "valid_from", "seen_until", "valid_to", "pid", "ordinal", "is_tail"])

    for batch in batches:
        if not batch.num_rows:
            continue
        entity, hashed, value, at = (flat(batch.column(c)) for c in ("entity", "attr_hash", "value", "at"))
        out_schema = out_schema or [pa.field("e", entity.type), pa.field("h", hashed.type), pa.field("v", value.type), *(pa.field(n, at.type) for n in "abc")]
        new = starts([entity, hashed, value], held and held[:3])
        at_py = [*new.nonzero()[0].tolist(), batch.num_rows]
        if held is not None and at_py[0] > 0:
            held = (*held[:4], at[at_py[0] - 1].as_py())
        rows = []
        first = pa.array(at_py[:-1], pa.int64())
        last = pa.array([i - 1 for i in at_py[1:]], pa.int64())
        for e, h, v, a, s in zip(entity.take(first).to_pylist(), hashed.take(first).to_pylist(), value.take(first).to_pylist(), at.take(first).to_pylist(), at.take(last).to_pylist(), strict=True):
            if held is not None:
                rows.append((*held, a if held[0] == e else None))
            held = (e, h, v, a, s)
        if rows:
            yield emit(rows, False)
    if held is not None:
        yield emit([(*held, None)], True)


def _stitched(edges: list) -> list[tuple]:
    """(pid, drop_head, tail_to, tail_seen) from each partition's first two and last versions."""
    parts: dict[int, dict] = {}
    for r in edges:
        p = parts.setdefault(r.pid, {})
        if r.ordinal == 0:
            p["head"] = r
        if r.ordinal == 1:
            p["second"] = r
        if r.is_tail:
            p["tail"] = r
    order, out = sorted(parts), []
    same = lambda t, h: (t.entity, t.attr_hash, t.value) == (h.entity, h.attr_hash, h.value)
    drop = {p: i > 0 and same(parts[order[i - 1]]["tail"], parts[p]["head"]) for i, p in enumerate(order)}
    closes, seen = None, None  # of an open version before the partition that is looked at next
    following = None
    for p in reversed(order):
        head, second, tail = parts[p]["head"], parts[p].get("second"), parts[p]["tail"]
        if following is None or following.entity != tail.entity:
            closes = seen = None
        own = (closes, seen)
        out.append((p, drop[p], own[0], own[1]))
        if not drop[p]:
            closes, seen = head.valid_from, None
        elif second is None:  # the partition only goes on with the version before it
            closes, seen = own[0], own[1] or head.seen_until
        else:
            closes, seen = (second.valid_from if second.entity == head.entity else None), head.seen_until
        following = head
    return out


def history(seen: DataFrame, partitions: int | None = None) -> DataFrame:
    """All versions of all entities, from ``observations``; see the module for the columns.

    One shuffle by range of (entity, time): no entity's rows need to fit one task. The edges sent to
    the driver are at most three rows for each partition.
    """
    spark, kinds = seen.sparkSession, {f.name: f.dataType for f in seen.schema}
    schema = T.StructType([T.StructField(n, t) for n, t in (("entity", kinds["entity"]), ("attr_hash", T.LongType()), ("value", kinds["value"]), *((n, kinds["at"]) for n in ("valid_from", "seen_until", "valid_to")), ("pid", T.IntegerType()), ("ordinal", T.LongType()), ("is_tail", T.BooleanType()))])
    rows = materialize(ranged(seen.select("entity", attr_hash("value").alias("attr_hash"), "value", "at"), ["entity"], ["at"], partitions).mapInArrow(_versions, schema), "versions")
    fixes = _stitched(rows.where("ordinal < 2 or is_tail").collect())
    fix = spark.createDataFrame(fixes, T.StructType([T.StructField("pid", T.IntegerType()), T.StructField("drop_head", T.BooleanType()), T.StructField("tail_to", kinds["at"]), T.StructField("tail_seen", kinds["at"])]))
    whole = rows.join(F.broadcast(fix), "pid").where("not (ordinal = 0 and drop_head)")
    to = F.when(F.col("is_tail"), F.coalesce("valid_to", "tail_to")).otherwise(F.col("valid_to"))
    return whole.select(
        "entity", "value", "attr_hash", "valid_from", to.alias("valid_to"),
        F.when(F.col("is_tail"), F.coalesce("tail_seen", "seen_until")).otherwise(F.col("seen_until")).alias("seen_until"), to.isNull().alias("is_current"),
    )


@dataclass(frozen=True)
class Dimension:
    """A type-two dimension as its merges leave it: nothing that was written is ever rewritten but the open versions.

    ``current`` has the open version of each entity; ``closed`` the closed versions and ``log`` the observations
    that each merge appended; ``void`` the entities that a merge replayed, whose versions closed by earlier
    merges count no longer. Null ``current`` is a dimension before its first merge.
    """

    current: DataFrame | None = None
    closed: tuple[DataFrame, ...] = ()
    void: tuple[DataFrame, ...] = ()
    log: tuple[DataFrame, ...] = ()

    def versions(self) -> DataFrame:
        """All versions; see the module for the columns."""
        if self.current is None:
            raise ValueError("nothing has been merged yet")
        closed = reduce(DataFrame.unionByName, (df.withColumn("_no", F.lit(i)) for i, df in enumerate(self.closed)))
        if self.void:
            void = reduce(DataFrame.unionByName, self.void).groupBy("entity").agg(F.max("_void").alias("_void"))
            closed = closed.join(small_or_shuffled(void, write=False), "entity", "left").where("_void is null or _no >= _void")
        return closed.select(*COLUMNS).unionByName(self.current.select(*COLUMNS))


def _closed_and_open(fresh: DataFrame) -> tuple[DataFrame, DataFrame]:
    fresh = fresh.select(*COLUMNS[:-1], F.col("valid_to").isNull().alias("is_current"))
    return fresh.where("not is_current"), fresh.where("is_current")


def merge_history(dimension: Dimension, updates: DataFrame, partitions: int | None = None) -> Dimension:
    """The type-two merge of a batch of ``observations`` into a dimension.

    The batch is reduced to runs of equal values. An entity's first run is compared by attribute hash (and by
    value behind equal hashes) with its open version: an equal one goes on, a changed one is closed where
    the run starts, and open versions are inserted for what follows. Only the open versions are read. Entities
    with an observation that isn't later than all seen before are replayed from the log, which is read for
    those alone; where a batch has none, neither log nor closed versions are read.
    """
    no = len(dimension.log)
    updates = materialize(updates.select("entity", "value", "at", F.col("row_id").cast("long").alias("row_id")), "log")
    if dimension.current is None:
        closed, current = _closed_and_open(materialize(history(updates, partitions), "merged"))
        return Dimension(current, (closed,), (), (updates,))
    opened = dimension.current.select("entity", F.struct("value", "attr_hash", "valid_from", "seen_until").alias("opened"))
    first = updates.groupBy("entity").agg(F.min("at").alias("first_at"))
    touched = materialize(first.join(opened, "entity").withColumn("late", F.col("first_at") <= F.col("opened.seen_until")), "touched")
    events, void = updates, dimension.void
    if not touched.where("late").isEmpty():
        late = touched.where("late").select("entity")
        few = small_or_shuffled(late, write=False)
        whole = reduce(DataFrame.unionByName, (*dimension.log, updates)).join(few, "entity", "left_semi")
        events = updates.join(few, "entity", "left_anti").unionByName(observations(whole, "entity", F.col("value"), "at", "row_id"))
        void = (*void, late.withColumn("_void", F.lit(no)))
    # Joined on entity and time, so an entity with very many runs is no burden.
    ahead = touched.where("not late").select(F.col("entity").alias("_entity"), F.col("first_at").alias("_at"), "opened")
    runs = history(events, partitions)
    runs = runs.join(ahead, (runs["entity"] == ahead["_entity"]) & (runs["valid_from"] == ahead["_at"]), "left")
    same = (F.col("attr_hash") == F.col("opened.attr_hash")) & (F.col("value") == F.col("opened.value"))
    own = F.struct("entity", "value", "attr_hash", F.when(same, F.col("opened.valid_from")).otherwise(F.col("valid_from")).alias("valid_from"), "valid_to", "seen_until")
    before = F.struct("entity", F.col("opened.value").alias("value"), F.col("opened.attr_hash").alias("attr_hash"), F.col("opened.valid_from").alias("valid_from"), F.col("valid_from").alias("valid_to"), F.col("opened.seen_until").alias("seen_until"))
    rows = runs.select(F.explode(F.when(F.col("opened").isNotNull() & ~same, F.array(before, own)).otherwise(F.array(own))).alias("v")).select("v.*")
    closed, fresh = _closed_and_open(materialize(rows, "merged"))
    current = dimension.current.join(touched.select("entity"), "entity", "left_anti").unionByName(fresh)
    return Dimension(materialize(current, "current"), (*dimension.closed, closed), void, (*dimension.log, updates))
