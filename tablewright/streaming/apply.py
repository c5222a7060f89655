"""Clean a stream with a plan fitted on a static table, gating every batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.gate import run_gate
from ..plans.cleaning import FittedPlan


def clean_stream(stream: DataFrame, plan: FittedPlan, event_time: str | None = None,
                 delay: str = "1 hour") -> DataFrame:
    """All stateless steps of ``plan``; with an event-time column, duplicates
    are dropped within the watermark (bounded state) instead of globally."""
    out = stream
    if event_time is not None:
        for step in plan.steps:      # as in the plan, copies are told after missing literals are null
            if step.name == "normalize_missing":
                out = step.fn(out)
        out = out.withWatermark(event_time, delay).dropDuplicatesWithinWatermark()
    return plan.transform(out, streaming=True)


def gated_writer(plan: FittedPlan, out_path: str, gate_path: str, fmt: str = "parquet",
                 rejected_path: str | None = None):
    """A ``foreachBatch`` function: clean the micro-batch, run the gate on it and write
    the gate rows, then the cleaned batch when it passes, else the batch as it came to
    ``rejected_path`` (``<out_path>-rejected``).  Every batch id has a folder of its own
    that a replay overwrites."""
    rejected = rejected_path or out_path.rstrip("/") + "-rejected"

    def write(batch: DataFrame, batch_id: int) -> None:
        cleaned = plan.transform(batch).persist()
        try:
            report = run_gate(batch, cleaned, plan.target)
            report.write.mode("overwrite").parquet(f"{gate_path}/batch_id={batch_id}")
            passed = report.filter(~F.col("passed")).limit(1).count() == 0
            frame, folder = (cleaned, out_path) if passed else (batch, rejected)
            frame.write.mode("overwrite").format(fmt).save(f"{folder}/batch_id={batch_id}")
        finally:
            cleaned.unpersist()
    return write


def start_gated_stream(stream: DataFrame, plan: FittedPlan, out_path: str, gate_path: str,
                       checkpoint_location: str, available_now: bool = True):
    """Start the gated cleaning query (``availableNow`` processes what is
    there and stops; the checkpoint makes it restartable after failures)."""
    w = stream.writeStream.foreachBatch(gated_writer(plan, out_path, gate_path)) \
        .option("checkpointLocation", checkpoint_location)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()
