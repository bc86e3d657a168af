"""Graph events: replay of an ordered list, and the same on streams.

Events are ``(seq, type, u, v, w)``; types: NODE_ADDITION, NODE_REMOVAL, NODE_RESTORATION, EDGE_ADDITION, EDGE_REMOVAL,
EDGE_WEIGHT_UPDATE, EDGE_WEIGHT_INCREMENT, TIME_STEP.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.graph import PropertyGraph


def replay(events: DataFrame, directed: bool = False) -> PropertyGraph:
    """The graph after all events.

    A node is there if its last event adds or restores it.  An edge is there if it was added after its last removal and
    after the last removal of either end; its weight is the last one set since, plus the increments after that.  No event
    is looked at in sequence: the last ones are found by aggregation."""
    n = events.where("type in ('NODE_ADDITION', 'NODE_REMOVAL', 'NODE_RESTORATION')").groupBy(F.col("u").alias("id")).agg(F.max_by("type", "seq").alias("last"), F.max(F.when(F.col("type") == "NODE_REMOVAL", F.col("seq"))).alias("removed"))
    a, b = (F.col("u"), F.col("v")) if directed else (F.least("u", "v"), F.greatest("u", "v"))
    e = events.where("type like 'EDGE%'").select("seq", "type", a.alias("src"), b.alias("dst"), F.coalesce("w", F.lit(1.0)).alias("w"))
    gone = n.where("removed is not null").select("id", "removed")
    e = e.join(gone.select(F.col("id").alias("src"), F.col("removed").alias("r1")), "src", "left").join(gone.select(F.col("id").alias("dst"), F.col("removed").alias("r2")), "dst", "left")
    e = e.where(F.col("seq") > F.coalesce(F.greatest("r1", "r2"), F.lit(-1)))
    pair = Window.partitionBy("src", "dst")
    e = e.withColumn("cut", F.coalesce(F.max(F.when(F.col("type") == "EDGE_REMOVAL", F.col("seq"))).over(pair), F.lit(-1))).where("seq > cut")
    e = e.withColumn("base", F.max(F.when(F.col("type").isin("EDGE_ADDITION", "EDGE_WEIGHT_UPDATE"), F.col("seq"))).over(pair)).where("seq >= base")
    out = e.groupBy("src", "dst").agg(F.bool_or(F.col("type") != "EDGE_WEIGHT_INCREMENT").alias("there"), F.sum("w").alias("w"))
    return PropertyGraph(n.where("last <> 'NODE_REMOVAL'").select("id"), out.where("there").select("src", "dst", "w"), directed)


def transitions(events: DataFrame, key: str, state: str, order: list[str]) -> DataFrame:
    """``(src, dst, n)``: how often one state follows another for a key."""
    w = Window.partitionBy(key).orderBy(*order)
    return events.select(F.col(state).alias("src"), F.lead(state).over(w).alias("dst")).where("dst is not null").groupBy("src", "dst").agg(F.count("*").alias("n"))


def windowed_activity(events: DataFrame, width: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """``(start, event_type, n, value)``: counts and sums in tumbling or sliding windows.  On a stream, windows are given
    out once the watermark has passed them; what comes later than that is left out.  Works on tables, too."""
    e = events.withWatermark("ts", late) if events.isStreaming else events
    w = F.window("ts", width, slide) if slide else F.window("ts", width)
    return e.groupBy(w, "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value")).select(F.col("window.start").alias("start"), "event_type", "n", "value")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """``(user_id, start, n)``: runs of a user's events that are less than the gap apart."""
    e = events.withWatermark("ts", late) if events.isStreaming else events
    return e.groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("start"), "n")


def read_events(spark, path: str, schema) -> DataFrame:
    """A stream of event files as they come."""
    return spark.readStream.schema(schema).parquet(path)


def fold_edges(stream: DataFrame, table: str, checkpoint: str):
    """Keep a table of edge weights up to date from a stream of ``(src, dst, w)``: every batch is summed and written as a
    delta under its number, so that a batch that comes again replaces itself.  Read it with folded()."""

    def add(batch: DataFrame, number: int) -> None:
        sums = batch.groupBy("src", "dst").agg(F.sum("w").alias("w"))
        sums.write.mode("overwrite").parquet(f"{table}/batch={number}")

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)


def folded(spark, table: str) -> DataFrame:
    """``(src, dst, w)``: the edges of a table kept by fold_edges()."""
    return spark.read.parquet(table).groupBy("src", "dst").agg(F.sum("w").alias("w"))
