"""Incremental matching of a stream of new registrations: what arrives is matched against a fixed reference, batch by batch,
and only what earlier batches didn't accept is matched again. An addition to what batch runs can do."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..config import Config
from ..operators.incremental import diff_unmatched
from ..operators.normalize import normalize
from ..operators.stats import name_freq, token_idf
from ..plans.pipeline import NoCandidates, cascade
from ..runtime import keep


def match_stream(stream: DataFrame, reference: DataFrame, target: str, checkpoint: str, to_query: Callable[[DataFrame], DataFrame], config: Config | None = None, trigger: dict | None = None) -> StreamingQuery:
    """Starts a query that appends (id, ein, score, tier, batch) of each micro-batch to the Parquet table target.

    A batch is rewritten as a whole if it is repeated, so a restart leaves no doubles. Ids that are YES in target already
    are left out by an anti join. The reference is normalized and its statistics are counted once, for all batches."""
    r = keep(normalize(reference), "reference")
    freq, idf = keep(name_freq(r), "name-freq"), keep(token_idf(r), "token-idf")

    def one(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        fresh = to_query(batch).dropDuplicates(["id"])
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(target)
        if hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
            before = spark.read.parquet(target).where(F.col("batch") != number)
            fresh = diff_unmatched(fresh, before, "id", "id", "tier")
        if fresh.isEmpty():
            return
        try:
            found = cascade(keep(normalize(fresh), "batch"), r, config, normalized=True, freq=freq, idf=idf).tiered
        except NoCandidates:
            return
        out = found.select("id", F.col("overall_ein").alias("ein"), F.col("overall_score").alias("score"), "tier")
        out.write.mode("overwrite").parquet(f"{target}/batch={number}")

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
