"""Chunk-wise clustering of a folder that files arrive in, one file a micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.cluster import Bfr, BfrResult
from tessera.session import fresh_path
from tessera.sources.readers import folders


def bfr_stream(spark: SparkSession, folder: str, k: int, alpha: float = 10.0, state: str | None = None) -> BfrResult:
    """Feeds each file of "id,x1,..,xd" lines that lies in the folder to BFR as a chunk.

    With ``state``, a folder that all executors share, a later call goes on with the files that came
    since, from the summaries as the last chunk left them.
    """
    at = state or fresh_path(spark, "bfr")
    bfr = Bfr(k, alpha, folder=at)
    cells = F.split("value", ",")
    rest = F.slice(cells, 2, F.size(cells) - 1)
    lines = spark.readStream.schema("value string").option("maxFilesPerTrigger", 1).text(folder)
    points = lines.filter("trim(value) <> ''").select(
        cells[0].cast("double").cast("long").alias("point_id"), F.transform(rest, lambda x: F.trim(x).cast("double")).alias("features")
    )

    def chunk(batch: DataFrame, number: int) -> None:
        if len(bfr.rounds) != number:  # the first batch of a call, or one that is run again
            bfr.resume(spark, number)
        bfr.add_chunk(batch)

    query = points.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{at}/checkpoint").foreachBatch(chunk).start()
    query.awaitTermination()
    if query.exception():
        raise query.exception()
    if not bfr.rounds:  # no file is new: what was there before counts
        last = max((int(p.rsplit("/", 1)[1]) for p in folders(spark, f"{at}/state")), default=None)
        if last is not None:
            bfr.resume(spark, last)
    return bfr.finish(spark)
