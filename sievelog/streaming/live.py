"""Live views: log streams, fan-out to readers, repairs, presence, optimistic layers, live queries."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from enum import Enum
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievelog.functions.values import FACT, entity_column
from sievelog.operators.facts import changed_rows, difference, unpivot, without
from sievelog.operators.policy import Policy
from sievelog.operators.writes import Engine, Operation, Rejected
from sievelog.plans.query import Query
from sievelog.sources.schema import Schema


def log_stream(spark: SparkSession, path: str, schema: str, files: int = 1) -> DataFrame:
    """A log folder as a stream; ``files`` a batch bounds what a slow reader takes at once."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def fold_stream(stream: DataFrame, state: str, checkpoint: str, key: str, value: str, version: str) -> DataFrame:
    """Folds a stream of set operations into the last value of each key.

    Every micro-batch merges its own last values with the state before it and writes the state of
    its batch id, so that a batch that runs again makes the same state again.
    """
    spark = stream.sparkSession

    def merge(batch: DataFrame, batch_id: int) -> None:
        new = batch.groupBy(key).agg(F.max_by(value, version).alias(value), F.max(version).alias(version))
        if batch_id:
            new = spark.read.parquet(f"{state}/{batch_id - 1}").unionByName(new).groupBy(key).agg(F.max_by(value, version).alias(value), F.max(version).alias(version))
        new.write.mode("overwrite").parquet(f"{state}/{batch_id}")

    query = stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    last = query.lastProgress
    return spark.read.parquet(f"{state}/{last['batchId'] if isinstance(last, dict) else last.batchId}")


def fan_out(policy: Policy, schema: Schema, entity: str, before: dict[str, DataFrame], after: dict[str, DataFrame], actors: DataFrame, subjects: DataFrame | None = None) -> DataFrame:
    """(actor, op, fact) of a commit for each distinct reader of ``actors``: additions as seen after,
    removals as seen before, and the facts of subjects that came into or went out of sight.

    ``subjects`` (id) are those that the commit changed or affected; without them all are compared.
    """

    def seen(frames: dict[str, DataFrame]) -> DataFrame:
        rows = frames[entity] if subjects is None else frames[entity].join(subjects.select("id"), "id", "left_semi")
        masked = policy.mask_each(entity, rows, frames, actors)
        keyed = masked.select(F.struct("actor", "id").alias("id"), *[c for c in masked.columns if c not in ("actor", "id")])
        return unpivot(schema, entity, keyed)

    one, two = seen(before), seen(after)
    out = one.exceptAll(two).withColumn("op", F.lit("-")).unionByName(two.exceptAll(one).withColumn("op", F.lit("+")))
    return out.select("subject.actor", "op", F.col("subject.id").alias("subject"), *FACT[1:])


def envelopes(version: int, actors: list[str], visible: DataFrame, spark: SparkSession, author: str | None) -> DataFrame:
    """One row a reader; a commit with nothing to see still moves the version and names nobody."""
    counts = visible.groupBy("actor").agg(F.count("*").alias("n"))
    names = spark.createDataFrame([(a,) for a in actors], "actor string")
    n = F.coalesce("n", F.lit(0))
    return names.join(counts, "actor", "left").select("actor", F.lit(version).alias("version"), n.alias("n"), F.when(n > 0, F.lit(author)).alias("author"))


def repair(held: DataFrame, visible: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(evict, refresh) for a reader that was away: ids no longer visible, ids that are."""
    gone, _ = difference(held, visible)
    return gone, held.select("id").join(visible.select("id"), "id", "left_semi")


class Status(Enum):
    LOADING = "loading"
    READY = "ready"
    ERROR = "error"
    OUTDATED = "outdated"


class LiveQuery:
    """A query that runs again when a commit touches a predicate it reads, and tells what changed."""

    def __init__(self, run: Callable[[Query], DataFrame], query: Query, notify: Callable[[list[Any]], None] | None = None):
        self._run, self.query, self._notify = run, query, notify
        self.status, self.runs, self.rows = Status.LOADING, 0, []
        self._frame: DataFrame | None = None
        self.refresh()

    def refresh(self) -> list[str]:
        """Runs the query; the keys of rows that came, went or differ."""
        try:
            frame = self._run(self.query)
            changed = [r.id for r in (changed_rows(self._frame, frame).collect() if self._frame is not None else frame.select("id").collect())]
        except Exception:
            self.status = Status.ERROR
            raise
        self._frame, self.status, self.runs = frame, Status.READY, self.runs + 1
        if changed:
            kept = {r.id: r for r in self.rows}
            fresh = {r.id: r for r in frame.collect()}
            # rows that are equal keep their identity
            self.rows = [kept[i] if i in kept and kept[i] == r else r for i, r in fresh.items()]
            if self._notify:
                self._notify(self.rows)
        return changed

    def touched(self, predicates: set[str]) -> bool:
        """Runs again if a commit's predicates and the query's meet."""
        if self.query.predicates & predicates:
            self.refresh()
            return True
        return False


def optimistic(confirmed: DataFrame, layers: list[DataFrame], keys: list[str]) -> DataFrame:
    """Confirmed rows under pending layers (op, keys), later layers over earlier ones."""
    changes = None
    for at, layer in enumerate(layers):
        part = layer.select("op", *keys).withColumn("__at", F.lit(at))
        changes = part if changes is None else changes.unionByName(part)
    if changes is None:
        return confirmed.select(keys).distinct()
    last = changes.groupBy(*keys).agg(F.max_by("op", F.struct("__at", F.col("op") == "+")).alias("op"))
    return without(confirmed, last.where("op = '-'"), keys).unionByName(last.where("op = '+'").select(keys)).distinct()


class Outbox:
    """Transactions queued while away, drained in order; late failures are reported."""

    def __init__(self) -> None:
        self.queue: list[tuple[str | None, list[Operation]]] = []
        self.on_rejected: list[Callable[[list[Operation], str], None]] = []

    def add(self, operations: list[Operation], generation: str | None = None) -> None:
        self.queue.append((generation, operations))

    def drain(self, engine: Engine, actor: str) -> int:
        done = 0
        while self.queue:
            generation, operations = self.queue[0]
            try:
                engine.transact(operations, actor, generation)
                done += 1
            except Rejected as e:
                for told in self.on_rejected:
                    told(operations, str(e))
            self.queue.pop(0)
        return done


def subscribe(engine: Engine, actor: str, since: int | None = None) -> Iterator[dict[str, Any]]:
    """What a reader gets on connecting: hello, then its backlog or, past what is kept, a resync; then a repair."""
    version = engine.store.version
    yield {"kind": "hello", "version": version, "generation": engine.schema.generation}
    facts = engine.store.facts()
    record = engine.actor_record(actor, facts)
    planner = engine.planner(record, facts)
    visible = {e: planner.masked(e).select("id") for e in engine.schema.entities}
    entries = engine.store.entries_since(since) if since is not None else None
    if entries is None:
        yield {"kind": "resync", "facts": {e: unpivot(engine.schema, e, planner.masked(e)) for e in engine.schema.entities}}
        return
    ids = reduce(DataFrame.unionByName, visible.values())
    shown = readable_entries(engine.policy, engine.schema, entries, planner.frames, record)
    yield {"kind": "backlog", "entries": shown}
    earlier = engine.frames(engine.store.facts(since))
    held = held_subjects(engine.policy, entries, earlier, planner.frames)
    gone, fresh = repair(held, ids)
    masked = {e: planner.masked(e) for e in engine.schema.entities}
    facts = [unpivot(engine.schema, e, m.join(fresh, "id", "left_semi")) for e, m in masked.items()]
    yield {"kind": "repair", "evict": gone, "refresh": reduce(DataFrame.unionByName, facts)}


def readable_entries(policy: Policy | None, schema: Schema, entries: DataFrame, frames: Mapping[str, DataFrame], actor: dict[str, Any]) -> DataFrame:
    """Log entries whose field the reader may read now, by its own rule; subjects that are gone count as empty."""
    if policy is None:
        return entries
    pairs = []
    for entity in schema.entities:
        subjects = entries.where(entity_column(F.col("subject")) == entity).select(F.col("subject").alias("id")).distinct()
        may = policy.readable(entity, subjects, frames, actor)
        pairs.append(may.select(F.col("id").alias("subject"), F.concat(F.lit(f"{entity}/"), F.col("field")).alias("predicate")))
    return entries.join(reduce(DataFrame.unionByName, pairs), ["subject", "predicate"], "left_semi")


def held_subjects(policy: Policy | None, entries: DataFrame, before: Mapping[str, DataFrame], after: Mapping[str, DataFrame]) -> DataFrame:
    """The subjects (id) of a backlog and those whose visibility may have changed through them, by the
    references of the state before it and of the state after."""
    out = entries.select(F.col("subject").alias("id"))
    for predicate in policy.dependencies() if policy else ():
        changed = entries.where(F.col("predicate") == predicate).select(F.col("subject").alias("id")).distinct()
        for frames in (before, after):
            out = out.unionByName(policy.affected(changed, predicate, frames).select("id"))
    return out.distinct()


class Presence:
    """Connections of each actor: joined on the first, left after the last."""

    def __init__(self) -> None:
        self.counts: dict[str, int] = {}

    def connect(self, actor: str) -> str | None:
        self.counts[actor] = self.counts.get(actor, 0) + 1
        return "joined" if self.counts[actor] == 1 else None

    def disconnect(self, actor: str) -> str | None:
        self.counts[actor] -= 1
        if self.counts[actor]:
            return None
        del self.counts[actor]
        return "left"

    @property
    def roster(self) -> list[str]:
        return sorted(self.counts)


def broadcast_visible(messages: DataFrame, visible: DataFrame) -> DataFrame:
    """Unlogged messages (about, payload): those about nothing, or about what the reader sees; 16 KB at most."""
    small = messages.where(F.octet_length("payload") <= 16 * 1024)
    about = small.join(visible.select(F.col("id").alias("about")), "about", "left_semi")
    return small.where("about is null").unionByName(about)
