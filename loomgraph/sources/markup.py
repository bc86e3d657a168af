"""GraphML, GEXF and GML: marked-up graphs.

Spark's XML reader finds node and edge elements wherever they are.  Writers make lines in ranges: the parts, in the order of
their names, are one document, so a part alone has no root element.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.graph import PropertyGraph, canonical, dense_ids


def write_ranges(head: str, rows: list[DataFrame], tail: str, path: str) -> None:
    """Text lines: the head, the rows (columns place, value) of one frame after the other by place, the tail."""
    spark = rows[0].sparkSession
    out = spark.createDataFrame([(0, 0, head), (len(rows) + 1, 0, tail)], "part int, place long, value string")
    for i, r in enumerate(rows, 1):
        out = out.unionByName(r.select(F.lit(i).alias("part"), "place", "value"))
    order = ["part", "place", "value"]
    out.repartitionByRange(*order).sortWithinPartitions(*order).select("value").write.text(path)


def _elements(spark: SparkSession, path: str, tag: str, schema: str) -> DataFrame:
    # The reader that is the default since Spark 4.1 takes a file for a document and stops behind its first element.
    return spark.read.format("xml").option("useLegacyXMLParser", "true").option("rowTag", tag).schema(schema).load(path)


def _says(spark: SparkSession, path: str, attribute: str) -> bool:
    """Whether the graph element's default is directed edges."""
    return not spark.read.text(path).where(F.col("value").rlike(rf"{attribute}\s*=\s*[\"']directed[\"']")).isEmpty()


def _graph(labels: DataFrame, edges: DataFrame, directed: bool) -> PropertyGraph:
    """Dense ids for labels (shorter ones first, so numbers keep their order) and for the ends s, d of the edges."""
    ends = edges.select(F.explode(F.array("s", "d")).alias("label"))
    v = dense_ids(labels.unionByName(ends).where("label is not null").distinct().withColumn("len", F.length("label")), ["len", "label"], "id").select("id", "label")
    e = edges.join(v.select(F.col("label").alias("s"), F.col("id").alias("src")), "s").join(v.select(F.col("label").alias("d"), F.col("id").alias("dst")), "d")
    return PropertyGraph(v, canonical(e.select("src", "dst", "w"), directed), directed)


def read_graphml(spark: SparkSession, path: str) -> PropertyGraph:
    """Nodes by their id (attribute ``label``), edges with the data whose key is named weight (1 without)."""
    keys = _elements(spark, path, "key", "`_id` string, `_for` string, `_attr.name` string")
    named = [r["k"] for r in keys.where("`_attr.name` = 'weight' and coalesce(_for, 'edge') in ('edge', 'all')").select(F.col("_id").alias("k")).collect()]
    e = _elements(spark, path, "edge", "_source string, _target string, data array<struct<_key: string, _VALUE: string>>")
    w = F.get(F.filter("data", lambda d: d["_key"].isin(named)), F.lit(0))["_VALUE"].cast("double") if named else F.lit(1.0)
    e = e.select(F.col("_source").alias("s"), F.col("_target").alias("d"), F.coalesce(w, F.lit(1.0)).alias("w"))
    return _graph(_elements(spark, path, "node", "_id string").select(F.col("_id").alias("label")), e, _says(spark, path, "edgedefault"))


def _line(*parts: str | Column) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts)).alias("value")


def write_graphml(g: PropertyGraph, path: str) -> None:
    head = '<?xml version="1.0" encoding="UTF-8"?>\n<graphml xmlns="http://graphml.graphdrawing.org/xmlns">\n<key id="w" for="edge" attr.name="weight" attr.type="double"/>\n'
    head += f'<graph edgedefault="{"directed" if g.directed else "undirected"}">'
    v = g.vertices.select(F.col("id").alias("place"), _line('<node id="', F.col("id"), '"/>'))
    e = g.edges.select(F.col("src").alias("place"), _line('<edge source="', F.col("src"), '" target="', F.col("dst"), '"><data key="w">', F.col("w"), "</data></edge>"))
    write_ranges(head, [v, e], "</graph>\n</graphml>", path)


def read_gexf(spark: SparkSession, path: str) -> PropertyGraph:
    """Nodes by their id (attribute ``label``), edges with their weight attribute (1 without); spells play no part here."""
    e = _elements(spark, path, "edge", "_source string, _target string, _weight double")
    e = e.select(F.col("_source").alias("s"), F.col("_target").alias("d"), F.coalesce("_weight", F.lit(1.0)).alias("w"))
    return _graph(_elements(spark, path, "node", "_id string").select(F.col("_id").alias("label")), e, _says(spark, path, "defaultedgetype"))


def read_gexf_spells(spark: SparkSession, path: str) -> DataFrame:
    """``(kind, u, v, start, end)``, a row for each time that a node or an edge is there: its spells, or else its own start
    and end (null: open).  v is null for nodes."""
    times = "_start double, _end double, spells struct<spell: array<struct<_start: double, _end: double>>>"
    own = F.array(F.struct("_start", "_end"))
    spell = F.explode(F.when(F.size("spells.spell") > 0, F.col("spells.spell")).otherwise(own)).alias("t")
    v = _elements(spark, path, "node", f"_id string, {times}").select(F.lit("node").alias("kind"), F.col("_id").alias("u"), F.lit(None).cast("string").alias("v"), spell)
    e = _elements(spark, path, "edge", f"_source string, _target string, {times}").select(F.lit("edge").alias("kind"), F.col("_source").alias("u"), F.col("_target").alias("v"), spell)
    return v.unionByName(e).select("kind", "u", "v", F.col("t._start").alias("start"), F.col("t._end").alias("end"))


def write_gexf(g: PropertyGraph, path: str) -> None:
    head = '<?xml version="1.0" encoding="UTF-8"?>\n<gexf xmlns="http://www.gexf.net/1.2draft" version="1.2">\n'
    head += f'<graph defaultedgetype="{"directed" if g.directed else "undirected"}">'
    v = g.vertices.select(F.col("id").alias("place"), _line('<node id="', F.col("id"), '"/>'))
    e = g.edges.select(F.col("src").alias("place"), _line('<edge source="', F.col("src"), '" target="', F.col("dst"), '" weight="', F.col("w"), '"/>'))
    write_ranges(head, [v, e], "</graph>\n</gexf>", path)


def write_gml(g: PropertyGraph, path: str) -> None:
    v = g.vertices.select(F.col("id").alias("place"), _line("  node [ id ", F.col("id"), " ]"))
    e = g.edges.select(F.col("src").alias("place"), _line("  edge [ source ", F.col("src"), " target ", F.col("dst"), " weight ", F.col("w"), " ]"))
    write_ranges(f"graph [\n  directed {int(g.directed)}", [v, e], "]", path)
