"""An incremental frontier of a crawl: beyond the reference, which has no streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.urls import normalize, same_origin


def frontier(links: DataFrame, root: str, *, target: str = "target", at: str = "at", delay: str = "1 hour") -> DataFrame:
    """New targets of a stream of links: normalized, of the root's origin, each once while the watermark holds it."""
    url = normalize(F.col(target))
    rows = links.withColumn("url", url).filter(F.col("url").isNotNull() & same_origin(F.col("url"), F.lit(root)))
    return rows.withWatermark(at, delay).dropDuplicatesWithinWatermark(["url"])
