"""Live detection: every micro-batch evaluates the flows active by then.

The batch operators do the work. State between batches are tables in a shared folder,
one version per batch, written whole, so a batch that is run again after a failure
overwrites its own version and alerts are neither lost nor doubled:

* ``packets/batch=N`` packets of the flows still active after batch N;
* ``alerts/batch=N``  alerts raised in batch N, which later batches read back as the
  hosts' threat history.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scoutlake.operators.alerts import build_alerts
from scoutlake.operators.detect import drift_adjusted, score_by_rules
from scoutlake.operators.flows import KEY, assemble_flows, at_least, with_flow_key
from scoutlake.operators.hosts import feature_table
from scoutlake.params import DEFAULT, Params
from scoutlake.session import new_folder, small_table, stage
from scoutlake.streaming.queries import each_batch


class LiveDetector:
    def __init__(
        self, spark: SparkSession, folder: str, params: Params = DEFAULT, drift: DataFrame | None = None
    ):
        """``drift``: optional (capture, src_ip, drift_score) of the hosts."""
        self.spark, self.folder, self.params, self.drift = spark, folder, params, drift

    def _table(self, name: str, batch: int) -> str:
        return f"{self.folder}/{name}/batch={batch}"

    def __call__(self, new: DataFrame, batch: int) -> None:
        p = self.params
        packets = new
        if batch > 0:
            packets = new.unionByName(self.spark.read.schema(new.schema).parquet(self._table("packets", batch - 1)))
        packets = stage(packets, "live-packets")
        if packets.limit(1).count() == 0:
            packets.write.mode("overwrite").parquet(self._table("packets", batch))
            return
        flows = assemble_flows(packets, timeout_s=p.flow_timeout_s, chunk_rows=p.chunk_rows)
        flows = stage(flows, "live-flows")
        # Captures have clocks of their own.
        latest = flows.groupBy("capture").agg(F.max("end_s").alias("_as_of"))
        active = flows.join(small_table(latest), "capture").filter(F.col("end_s") >= F.col("_as_of") - p.flow_timeout_s)
        active = active.drop("_as_of")

        span = active.select(*KEY, F.col("start_s").alias("_from"), F.col("end_s").alias("_to"))
        still = with_flow_key(packets).join(span, KEY).filter(F.col("ts_s").between(F.col("_from"), F.col("_to")))
        still.select(*new.columns).write.mode("overwrite").parquet(self._table("packets", batch))

        scored = score_by_rules(at_least(feature_table(packets, active, params=p, segmented=True), p.min_packets_alert))
        if self.drift is None:
            scored = scored.withColumn("drift_score", F.lit(0.0))
        else:
            scored = scored.join(self.drift, ["capture", "src_ip"], "left").withColumn(
                "drift_score", F.coalesce("drift_score", F.lit(0.0))
            )
            adjusted = drift_adjusted(F.col("prediction"), F.col("confidence"), F.col("drift_score"))
            scored = scored.withColumn("confidence", adjusted)
        build_alerts(scored).write.mode("overwrite").json(self._table("alerts", batch))

    def alerts(self, schema) -> DataFrame:
        """All alerts so far, with the batch that raised them."""
        return self.spark.read.schema(schema).json(f"{self.folder}/alerts")

    def host_threat(self, schema) -> DataFrame:
        """Mean alert score per host over the batches written so far."""
        return (
            self.alerts(schema)
            .groupBy("capture", F.col("source_ip").alias("src_ip"))
            .agg(F.avg("threat_confidence").alias("value"), F.count(F.lit(1)).alias("alerts"))
        )


def run_live(packets: DataFrame, detector: LiveDetector, every: str | None = None):
    """Start the detector on a packet stream; ``every`` None drains what is there."""
    return each_batch(packets, detector, new_folder(detector.spark, "live-checkpoint"), every)
