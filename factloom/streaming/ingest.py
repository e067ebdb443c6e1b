"""Continuous ingestion: a micro-batch is folded on its own and merged into what is known, at the cost of its own size.

Node types whose fold has states (factloom.plans.states) are ordered by seq, not by time of arrival, so no watermark is
needed: a late row changes its identity's fold and nothing else. Types with logs of differences or newest writes are
folded in order of arrival, by (batch, seq).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.buckets import BUCKETS, BucketStore, node_store, state_store
from ..plans.lineage import names_in, put_text
from ..plans.schema import NodeType
from ..plans.states import has_states, rendered, states


class StreamingFold:
    """Buckets of states or rows in `<path>/rows` (factloom.plans.buckets), and after each batch their state in `<path>/state`.

    A batch goes on from the state of the batch before it, so that one that runs again replaces itself. It writes its own rows and,
    now and then, buckets that have outgrown their base; it reads nothing else of what is known.
    """

    def __init__(self, spark: SparkSession, path: str, spec: NodeType, buckets: int = BUCKETS) -> None:
        self.spark, self.path, self.spec, self.buckets = spark, path.rstrip("/"), spec, buckets
        self.free = has_states(spec)

    def store(self, before: int | None = None) -> BucketStore:
        """As it was after the last batch (before one)."""
        store = (state_store if self.free else node_store)(self.spark, self.spec, buckets=self.buckets, root=f"{self.path}/rows")
        numbers = [int(n.removesuffix(".json")) for n in names_in(self.spark, f"{self.path}/state") if n.endswith(".json")]
        done = [n for n in numbers if before is None or n < before]
        if done:
            store.restored("\n".join(r["value"] for r in self.spark.read.text(f"{self.path}/state/{max(done)}.json", wholetext=True).collect()))
        return store

    def apply(self, batch: DataFrame, batch_id: int) -> None:
        store = self.store(batch_id)
        if self.free:
            rows = states(batch, self.spec).withColumn("seq", F.struct(F.lit(batch_id).cast("long").alias("run")))
        else:
            rows = batch.withColumn("seq", F.struct(F.lit(batch_id).cast("long").alias("run"), F.lit(0).alias("rank"), F.col("seq").cast("long").alias("row")))
        store.add(rows, batch_id, count=False, settle=True)
        put_text(self.spark, f"{self.path}/state/{batch_id}.json", store.state())

    def start(self, stream: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        writer = stream.writeStream.foreachBatch(self.apply).option("checkpointLocation", checkpoint)
        return writer.trigger(**(trigger or {"availableNow": True})).start()

    def canonical(self) -> DataFrame | None:
        """Canonical rows after the last batch; None before the first row."""
        rows = self.store().rows()
        return rows if rows is None or not self.free else rendered(rows, self.spec)
