"""Scanning as a stream: new files in, findings and scores out."""

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from sieveline.plans.analysis import analyze, findings_of
from sieveline.rules import PACKS
from sieveline.sources.sinks import append_run, claim, stream_name


def without_repeats(files: DataFrame, key: str = "file_id", ts: str = "uploaded_at", delay: str = "1 hour") -> DataFrame:
    """Drop repeated uploads that arrive within the delay."""
    return files.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])


def scan_stream(files: DataFrame, findings_path: str, checkpoint: str, packs: dict = PACKS,
                trigger: dict = None) -> StreamingQuery:
    """Scan every arriving file and append its findings as a run of the table.

    The run belongs to the stream and its batch (``sinks.claim``): a batch repeated after a lost executor or driver replaces
    only itself, a stream with a new checkpoint or a second stream adds to the table, and ``sinks.read_latest`` shows each
    file as last scanned.
    """
    def put(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        run = claim(spark, findings_path, f"{stream_name(spark, checkpoint)}/{batch_id}")
        append_run(findings_of(analyze(batch, packs), packs), batch, findings_path, run)

    writer = files.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
