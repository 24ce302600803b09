"""Sinks: a bundle as partitioned tables."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def write_bundle(chapters: DataFrame, assets: DataFrame, toc: DataFrame, path: str, fmt: str = "parquet", parts: int | None = None) -> None:
    """chapters in spine order, assets once by file name (the first), the toc; each under its
    name. A folder for each bundle_id, or, where bundles are too many for that, `parts`
    folders `part=n` by its hash, so that a bundle is read from one of them. Tasks get whole
    bundles and write them sorted; they are as many as the rows need, not as the folders."""
    first = F.row_number().over(Window.partitionBy("bundle_id", "filename").orderBy("asset_no"))
    once = assets.withColumn("k", first).where("k = 1").drop("k")
    for name, rows, order in (("chapters", chapters, ["spine"]), ("assets", once, ["asset_no"]), ("toc", toc, [])):
        if parts is None:
            rows.repartition("bundle_id").sortWithinPartitions("bundle_id", *order).write.partitionBy("bundle_id").format(fmt).save(f"{path}/{name}")
        else:
            dealt = rows.withColumn("part", bundle_part(F.col("bundle_id"), parts)).repartition("part", "bundle_id")
            dealt.sortWithinPartitions("part", "bundle_id", *order).write.partitionBy("part").format(fmt).save(f"{path}/{name}")


def bundle_part(bundle_id: Column, parts: int) -> Column:
    """The folder that write_bundle gives a bundle."""
    return F.pmod(F.xxhash64(bundle_id), F.lit(parts)).cast("int")
