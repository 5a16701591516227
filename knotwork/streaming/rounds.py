"""Rounds as a stream: each micro-batch of records is a round, its delta against the previous round is sent, and the graph
is kept as versions in a folder."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from knotwork.operators import federated, graph, records
from knotwork.session import ensure_checkpoint_dir


#: A graph's whole state is written every so many rounds; in between, a round's own nodes and edges are.
WHOLE = 8
KEYS = {"nodes": ["id"], "edges": ["src", "dst"]}


def new_folder(spark: SparkSession) -> str:
    """A folder of its own in the checkpoint folder, which every executor shares."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/rounds-{uuid.uuid4().hex}"


class GraphStore:
    """Versions of a graph and of the names last sent, as parquet by round. A round writes the nodes and edges of its own
    records; the graph after a round is the last written of each key, from the last whole state on, which is written every
    ``whole`` rounds. So a round costs what it brings, not what the graph holds. Writing a round again gives the same
    files, so a batch that is replayed changes nothing."""

    def __init__(self, spark: SparkSession, folder: str, whole: int = WHOLE):
        self.spark, self.folder, self.whole = spark, folder.rstrip("/"), whole

    def _path(self, table: str, r: int) -> str:
        return f"{self.folder}/{table}/round={r}"

    def _there(self, table: str, r: int) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self._path(table, r)}/_SUCCESS")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def _read(self, table: str, r: int) -> DataFrame | None:
        return self.spark.read.parquet(self._path(table, r)) if self._there(table, r) else None

    def _state(self, table: str, r: int) -> DataFrame | None:
        """The last written row of each key up to round ``r``."""
        out, k = None, r
        while k >= 0:
            state, own = self._read(f"{table}_whole", k), self._read(table, k)
            part = state if state is not None else own
            if part is not None:
                marked = part.withColumn("_round", F.lit(k))
                out = marked if out is None else out.unionByName(marked)
            if state is not None:
                break
            k -= 1
        if out is None:
            return None
        others = [c for c in out.columns if c not in (*KEYS[table], "_round")]
        last = out.groupBy(*KEYS[table]).agg(F.max_by(F.struct(*others), "_round").alias("_x"))
        return last.select(*KEYS[table], *(F.col(f"_x.{c}").alias(c) for c in others))

    def graph(self, r: int) -> tuple[DataFrame, DataFrame] | None:
        """Nodes and edges after round ``r``, None if it isn't there."""
        if r < 0 or not self._there("edges", r):
            return None
        return self._state("nodes", r), self._state("edges", r)

    def latest(self, before: int | None = None) -> int:
        """The last whole round, -1 if there is none."""
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/edges")
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(path):
            return -1
        found = [int(s.getPath().getName().partition("=")[2]) for s in fs.listStatus(path) if s.getPath().getName().startswith("round=")]
        return max((r for r in found if (before is None or r < before) and self._there("edges", r)), default=-1)

    def advance(self, r: int, entities: DataFrame, hyperedges: DataFrame, edges: DataFrame) -> DataFrame:
        """Merge a round's records into the graph and give what changed (one row)."""
        old = self.latest(before=r)
        nodes, links = graph.build_round(None, entities, hyperedges, edges)
        nodes.write.mode("overwrite").parquet(self._path("nodes", r))
        links.write.mode("overwrite").parquet(self._path("edges", r))
        now = self.graph(r)
        if (r + 1) % self.whole == 0:
            for name, df in zip(KEYS, now):
                df.write.mode("overwrite").parquet(self._path(f"{name}_whole", r))
            now = self.graph(r)
        before = graph.bucketed_fingerprint(*(self.graph(old) or (x.limit(0) for x in now)))
        return graph.delta(before, graph.bucketed_fingerprint(*now))

    def unsent(self, r: int, entities: DataFrame) -> DataFrame:
        """Entities that their client didn't send in its previous round; the cache then holds all of the current round, so
        what is absent for a round is sent again."""
        sent = self._read("sent", r - 1)
        keys = ["client_id", "entity_name"]
        out = entities if sent is None else records.delta_records(entities, sent, keys)
        entities.select(*keys).distinct().write.mode("overwrite").parquet(self._path("sent", r))
        return out


def run_rounds(
    store: GraphStore,
    rounds: int,
    batch: Callable[..., tuple[DataFrame, DataFrame, DataFrame]],
    clients: DataFrame | None = None,
    fraction: float = 1.0,
    downlink: Callable[[int, tuple[DataFrame, DataFrame]], object] | None = None,
    validate: Callable[[int, tuple[DataFrame, DataFrame]], dict[str, float]] | None = None,
    eval_freq: int = 1,
    prebuilt: bool = False,
    seed: int = 0,
) -> list[dict]:
    """The batch loop; a record of each round comes back.

    Each round samples its clients (``clients``: ``client_id``), sends the graph down, takes ``batch(r)``, or with clients
    ``batch(r, names)``, as its records, merges them, and every ``eval_freq`` rounds validates. ``downlink(r, graph)`` is
    called, and the record's ``downlink`` is 'sent', only if the last round changed the graph; else it is 'skipped', and
    'none' before the first graph. Round 0 only builds the graph (``init``) unless there is a prebuilt one.
    """
    history, names, changed = [], None, False
    total = clients.count() if clients is not None else 0
    for r in range(rounds):
        have = store.graph(store.latest(before=r))
        state = "none" if have is None else "sent" if changed or r == 0 else "skipped"
        if state == "sent" and downlink:
            downlink(r, have)
        if clients is not None:
            names = [c.client_id for c in federated.sample_clients(clients, total, fraction, r, seed).collect()]
        change = store.advance(r, *(batch(r) if names is None else batch(r, names))).first()
        changed = change["changed"]
        values = validate(r, store.graph(r)) if validate and r % eval_freq == 0 else {}
        history.append({"round": r, "init": r == 0 and not prebuilt, "clients": names, "downlink": state, **change.asDict(), **values})
    return history


def stream_rounds(stream: DataFrame, store: GraphStore, checkpoint: str, split: Callable[[DataFrame], tuple[DataFrame, DataFrame, DataFrame]]) -> StreamingQuery:
    """The same over a stream: a micro-batch is a round, its id the round's number. A batch is read once, though its nodes
    and edges are made one after the other."""
    def each(df: DataFrame, batch_id: int) -> None:
        df.persist()
        store.advance(batch_id, *split(df)).collect()
        df.unpersist()

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def finished(stream: DataFrame) -> DataFrame:
    """The whole result of an aggregating stream over what there is now, as a table in the shared folder."""
    spark = stream.sparkSession
    folder = new_folder(spark)

    def each(df: DataFrame, _: int) -> None:
        df.write.mode("overwrite").parquet(f"{folder}/out")

    stream.writeStream.outputMode("complete").foreachBatch(each).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


def windowed_counts(events: DataFrame, size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """``window_start, event_type, events, value`` by tumbling windows with a watermark; works on streams and tables. A
    watermark needs instants, so a stream's times without a zone are taken as the session's and given back without one."""
    local = isinstance(events.schema["ts"].dataType, T.TimestampNTZType) and events.isStreaming
    by = events.withColumn("ts", F.col("ts").cast("timestamp")) if local else events
    by = by.withWatermark("ts", late) if events.isStreaming else by
    start = F.col("w.start").cast("timestamp_ntz") if local else F.col("w.start")
    return by.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count("*").alias("events"), F.sum("value").alias("value")).select(start.alias("window_start"), "event_type", "events", "value")
