"""Live results: an append-only feed of finished rows, and a watch that tells changes of presence only."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType


def feed(spark: SparkSession, folder: str, schema: StructType | str, sink: str, checkpoint: str) -> StreamingQuery:
    """Append rows of new Parquet files in folder to sink, each once; stops when all present files are in."""
    rows = spark.readStream.schema(schema).parquet(folder)
    return rows.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(sink)


def _change(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The latest sighting of one path, if it says something else than the state. Only that one is held."""
    seq, present = state.get if state.exists else (-1, False)
    was = present
    for frame in frames:
        last = frame.iloc[frame["seq"].argmax()]
        if last["seq"] > seq:
            seq, present = int(last["seq"]), bool(last["present"])
    state.update((seq, present))
    if present != was:
        yield pd.DataFrame({"path": [key[0]], "seq": [seq], "present": [present]})


def presence_changes(sightings: DataFrame) -> DataFrame:
    """A stream of sightings (path, seq, present) -> a stream of changes (path, seq, present).

    The state is one row for each path, kept by key in the query's checkpoint: a batch touches the states of its own paths
    only, and a restarted query goes on where it was. A path is absent before its first sighting; of the sightings of a
    batch the one of greatest seq counts, and older ones than the state's are not looked at. Rows without path or seq are left out.
    """
    rows = sightings.where("path is not null and seq is not null").select("path", F.col("seq").cast("long").alias("seq"), F.coalesce("present", F.lit(False)).alias("present"))
    return rows.groupBy("path").applyInPandasWithState(_change, "path string, seq long, present boolean", "seq long, present boolean", "update", GroupStateTimeout.NoTimeout)


def presence(spark: SparkSession, folder: str, schema: StructType | str, checkpoint: str, tell: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """For each batch of scan files (path, seq, present), tell(what changed, batch's number); stops when all present files are in."""
    rows = presence_changes(spark.readStream.schema(schema).parquet(folder))
    return rows.writeStream.outputMode("update").foreachBatch(tell).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def batch_progress(outcomes: DataFrame, plans: DataFrame) -> DataFrame:
    """outcomes (batch, outcome, savings_bytes), a table or a stream; plans (batch, total) -> (batch, total, done, applied, failed, cancelled, savings_bytes, running).

    Sums only, so each task sends a row for each batch, and a stream keeps a row of state for each, to be written in
    update mode. Only applied items save; a batch runs until it was cancelled or all its items have an outcome.
    """
    own = lambda o: F.count_if(F.col("outcome") == o)
    sums = outcomes.groupBy("batch").agg(F.count("*").alias("done"), own("applied").alias("applied"), own("failed").alias("failed"), (own("cancelled") > 0).alias("cancelled"), F.coalesce(F.sum(F.when(F.col("outcome") == "applied", F.col("savings_bytes"))), F.lit(0).cast("long")).alias("savings_bytes"))
    both = sums.join(plans.select("batch", "total"), "batch")
    return both.select("batch", "total", "done", "applied", "failed", "cancelled", "savings_bytes", (~F.col("cancelled") & (F.col("done") < F.col("total"))).alias("running"))
