"""The selection step that depends on its own order: companions of strong pages replace weak rows from elsewhere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_companions(selected: DataFrame, companions: DataFrame, chunks: DataFrame) -> DataFrame:
    """selected: query_id, chunk_id, rank; companions: query_id, chunk_id, place. Companions come in one after another: one
    that is not there yet takes the place of the last row of another page, if there is any. Then the rows of each page
    stand, in the places that the page has, in the order of the source. A query has some fifteen selected rows and a dozen
    companions, which are folded as arrays of its one row."""
    meta = chunks.select("chunk_id", "document_id", "page", "chunk_index")
    row = F.struct("document_id", "page", "chunk_index", "chunk_id")
    a = selected.select("query_id", "chunk_id", F.col("rank").cast("long").alias("place"), F.lit(0).alias("kind"))
    b = companions.select("query_id", "chunk_id", F.col("place").cast("long").alias("place"), F.lit(1).alias("kind"))
    rows = a.unionByName(b).join(meta, "chunk_id").select("query_id", "kind", F.struct(F.col("place").alias("place"), row.alias("row")).alias("r"))
    in_order = lambda kind: F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.col("r")))), lambda x: x["row"])
    folded = rows.groupBy("query_id").agg(in_order(0).alias("kept"), in_order(1).alias("extra"))
    folded = folded.select("query_id", F.posexplode(F.aggregate("extra", F.col("kept"), _replaced)).alias("at", "row")).select("query_id", "at", "row.*")
    page = Window.partitionBy("query_id", "document_id", "page")
    spots = F.array_sort(F.collect_list("at").over(page))
    rows = folded.withColumn("place", F.element_at(spots, F.row_number().over(page.orderBy("chunk_index", "chunk_id"))) + 1)
    return rows.select("query_id", "chunk_id", "document_id", F.col("page").cast("long").alias("page"), F.col("chunk_index").cast("long").alias("chunk_index"), F.col("place").cast("long").alias("place"))


def _replaced(kept: Column, extra: Column) -> Column:
    elsewhere = lambda x: ~(x["document_id"].eqNullSafe(extra["document_id"]) & x["page"].eqNullSafe(extra["page"]))
    spare = F.array_max(F.transform(kept, lambda x, i: F.when(elsewhere(x), i)))
    known = F.exists(kept, lambda x: x["chunk_id"] == extra["chunk_id"])
    return F.when(known | spare.isNull(), kept).otherwise(F.transform(kept, lambda x, i: F.when(i == spare, extra).otherwise(x)))
