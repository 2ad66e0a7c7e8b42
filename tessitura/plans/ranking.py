"""Global ranks without a window over a whole group: range partition, count per partition, add offsets."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessitura.plans.store import shared_folder


def placed(df: DataFrame, order: list[Column], group: tuple[str, ...] = (), name: str = "place") -> DataFrame:
    """``df`` with the rank (long, from 1) of each row inside its ``group`` by ``order``, which must tell all rows of a group apart.

    Rows are dealt out in ranges of (group, order), so a large group spreads over many tasks, sorted inside and written once to the shared
    folder with their place inside the task. The driver sees one row for each group in each partition: first place and number of rows.
    """
    spark = df.sparkSession
    keys = [*(F.col(g).asc_nulls_first() for g in group), *order]
    path = f"{shared_folder(spark)}/ranked-{uuid.uuid4().hex[:12]}"
    dealt = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id())
    dealt.write.parquet(path)
    kept = spark.read.schema(dealt.schema).parquet(path).withColumn("_part", F.shiftright("_at", 33))
    edges = kept.groupBy("_part", *group).agg(F.min("_at").alias("_first"), F.count("*").alias("_rows")).orderBy("_part", "_first").collect()
    before: dict[tuple, int] = {}
    offsets = []
    for e in edges:
        g = tuple(e[x] for x in group)
        offsets.append((e["_part"], *g, before.get(g, 0) + 1 - e["_first"]))
        before[g] = before.get(g, 0) + e["_rows"]
    schema = ", ".join(["_part long", *(f"{g} {kept.schema[g].dataType.simpleString()}" for g in group), "_offset long"])
    table = spark.createDataFrame(offsets, schema).withColumnsRenamed({g: f"_g_{g}" for g in group})
    same = F.lit(True)
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"_g_{g}"))
    rows = kept.join(F.broadcast(table.withColumnRenamed("_part", "_p")), (F.col("_part") == F.col("_p")) & same)  # a row a group and partition
    return rows.withColumn(name, F.col("_at") + F.col("_offset")).select(*df.columns, name)
