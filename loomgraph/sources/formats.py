"""Graph files by Spark's text reader and writer.

Formats with an edge on each line are read in any number of tasks.  Formats whose lines count need line numbers; these
come from the file's own order, a count for each partition first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.graph import PropertyGraph, canonical, dense_ids
from loomgraph.scratch import materialize
from loomgraph.sources import markup


def _lines(spark: SparkSession, path: str, comment: str | None) -> DataFrame:
    t = spark.read.text(path).select(F.trim(F.regexp_replace("value", "\r$", "")).alias("value"))
    return t.where(~F.col("value").startswith(comment)) if comment else t


def numbered_lines(spark: SparkSession, path: str, comment: str | None = None) -> DataFrame:
    """``(n, value)``: lines by their place, from 0, comments left out.  Rows are ordered by where their block begins in
    the file and their place in it."""
    t = spark.read.text(path).select(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("i"), F.trim(F.regexp_replace("value", "\r$", "")).alias("value"))
    t = t.where(~F.col("value").startswith(comment)) if comment else t
    return dense_ids(t, ["f", "b", "i"], "n").select("n", "value")


def read_edge_list(spark: SparkSession, path: str, separator: str = r"\s+", comment: str = "#", first: int = 0, directed: bool = False, labels: bool = False) -> PropertyGraph:
    """``u v [w]`` lines.  With labels, ends are any strings, which become dense ids (node attribute ``label``)."""
    p = _lines(spark, path, comment).where("value <> ''").select(F.split("value", separator).alias("p"))
    w = F.when(F.size("p") > 2, F.get("p", F.lit(2)).cast("double")).otherwise(1.0)
    if not labels:
        e = p.select((F.get("p", F.lit(0)).cast("long") - first).alias("src"), (F.get("p", F.lit(1)).cast("long") - first).alias("dst"), w.alias("w"))
        top = e.agg(F.max(F.greatest("src", "dst")).alias("top")).first()["top"]
        v = spark.range(0 if top is None else top + 1)
        return PropertyGraph(v, canonical(e, directed).dropDuplicates(["src", "dst"]), directed)
    e = p.select(F.get("p", F.lit(0)).alias("s"), F.get("p", F.lit(1)).alias("d"), w.alias("w"))
    v = dense_ids(e.select(F.explode(F.array("s", "d")).alias("label")).distinct(), ["label"], "id")
    e = e.join(v.select(F.col("label").alias("s"), F.col("id").alias("src")), "s").join(v.select(F.col("label").alias("d"), F.col("id").alias("dst")), "d")
    return PropertyGraph(v, canonical(e.select("src", "dst", "w"), directed).dropDuplicates(["src", "dst"]), directed)


def write_edge_list(g: PropertyGraph, path: str, separator: str = " ", weights: bool = False, first: int = 0) -> None:
    ends = [(F.col(c) + first).cast("string") for c in ("src", "dst")]
    g.edges.select(F.concat_ws(separator, *ends, *([F.col("w").cast("string")] if weights else [])).alias("value")).write.text(path)


def read_snap(spark: SparkSession, path: str, directed: bool = True) -> PropertyGraph:
    """A SNAP list: ``#`` comments, any ids, which become dense."""
    return read_edge_list(spark, path, comment="#", directed=directed, labels=True)


def read_konect(spark: SparkSession, path: str) -> PropertyGraph:
    """A KONECT list: the first line tells direction (asym), ids count from 1; parallel edges are summed."""
    head = spark.read.text(path).where(F.col("value").startswith("%")).limit(1).collect()
    directed = bool(head) and "asym" in head[0]["value"]
    g = read_edge_list(spark, path, comment="%", first=1, directed=directed)
    p = _lines(spark, path, "%").where("value <> ''").select(F.split("value", r"\s+").alias("p"))
    e = p.select((F.get("p", F.lit(0)).cast("long") - 1).alias("src"), (F.get("p", F.lit(1)).cast("long") - 1).alias("dst"), F.coalesce(F.get("p", F.lit(2)).cast("double"), F.lit(1.0)).alias("w"))
    return g.with_edges(canonical(e, directed).groupBy("src", "dst").agg(F.sum("w").alias("w")))


def read_metis(spark: SparkSession, path: str) -> PropertyGraph:
    """An adjacency for each line, nodes from 1; the header's third field tells of edge and vertex weights."""
    t = materialize(numbered_lines(spark, path, "%"), "metis")
    head = t.where("n = 0").first()["value"].split()
    fmt = head[2] if len(head) > 2 else "0"
    edge_weights, node_weights = fmt[-1:] == "1", len(fmt) > 1 and fmt[-2] == "1"
    skip = (int(head[3]) if len(head) > 3 else 1) if node_weights else 0
    p = t.where(f"n > 0 and n <= {int(head[0])}").select((F.col("n") - 1).alias("src"), F.filter(F.split("value", r"\s+"), lambda x: x != "").alias("p"))
    p = p.select("src", F.slice("p", skip + 1, F.greatest(F.size("p") - skip, F.lit(0))).alias("p"))
    step = 2 if edge_weights else 1
    at = p.select("src", "p", F.posexplode("p").alias("i", "x")).where(F.col("i") % step == 0)
    w = F.get("p", F.col("i") + 1).cast("double") if edge_weights else F.lit(1.0)
    e = at.select("src", (F.col("x").cast("long") - 1).alias("dst"), w.alias("w")).where("src <= dst")
    return PropertyGraph(spark.range(int(head[0])), canonical(e, False), False)


def write_metis(g: PropertyGraph, path: str) -> None:
    """Lines in the order of the ids, in ranges: the parts, in the order of their names, are one document.  Ids must be
    dense."""
    lists = g.arcs().groupBy(F.col("src").alias("id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("dst")), lambda x: (x + 1).cast("string")), " ").alias("value"))
    rows = g.vertices.select("id").join(lists, "id", "left").select("id", F.coalesce("value", F.lit("")).alias("value"))
    head = g.counts().select(F.lit(-1).cast("long").alias("id"), F.concat_ws(" ", "nodes", "edges").alias("value"))
    head.unionByName(rows).repartitionByRange("id").sortWithinPartitions("id").select("value").write.text(path)


def read_matrix_market(spark: SparkSession, path: str) -> PropertyGraph:
    """Coordinates; symmetric matrices are undirected graphs, others directed; pattern matrices have weight 1."""
    head = spark.read.text(path).where(F.col("value").startswith("%%MatrixMarket")).first()["value"].lower().split()
    symmetric, pattern = head[4] == "symmetric", head[3] == "pattern"
    t = materialize(numbered_lines(spark, path, "%").where("value <> ''"), "mtx")
    size = int(t.orderBy("n").first()["value"].split()[0])
    first = t.agg(F.min("n").alias("m"))
    p = t.join(F.broadcast(first)).where("n > m").select(F.split("value", r"\s+").alias("p"))
    w = F.lit(1.0) if pattern else F.get("p", F.lit(2)).cast("double")
    e = p.select((F.get("p", F.lit(0)).cast("long") - 1).alias("src"), (F.get("p", F.lit(1)).cast("long") - 1).alias("dst"), w.alias("w"))
    return PropertyGraph(spark.range(size), canonical(e, not symmetric), not symmetric)


def read_gml(spark: SparkSession, path: str) -> PropertyGraph:
    """``node [ id n ... ]`` and ``edge [ source s target t ... ]`` blocks, whole files split at their blocks."""
    t = spark.read.text(path, wholetext=True)
    directed = not t.where(F.col("value").rlike(r"(?i)directed\s+1")).isEmpty()
    blocks = t.select(F.explode(F.regexp_extract_all("value", F.lit(r"(?is)((?:node|edge)\s*\[[^\]]*\])"), 1)).alias("b"))
    number = lambda k: F.regexp_extract("b", rf"(?i)\b{k}\s+(-?[0-9.]+)", 1)
    v = blocks.where("b ilike 'node%'").select(number("id").cast("long").alias("id"))
    e = blocks.where("b ilike 'edge%'").select(number("source").cast("long").alias("src"), number("target").cast("long").alias("dst"), F.coalesce(F.nullif(number("(?:weight|value)"), F.lit("")).cast("double"), F.lit(1.0)).alias("w"))
    return PropertyGraph(v, canonical(e, directed), directed)


def write_dot(g: PropertyGraph, path: str) -> None:
    """GraphViz lines, in ranges."""
    arrow = " -> " if g.directed else " -- "
    e = g.edges.select(F.col("src").alias("place"), F.concat(F.lit("  "), F.col("src").cast("string"), F.lit(arrow), F.col("dst").cast("string"), F.lit(";")).alias("value"))
    markup.write_ranges(("digraph" if g.directed else "graph") + " g {", [e], "}", path)


def read_partition(spark: SparkSession, path: str) -> DataFrame:
    """``(id, label)``: line i is the part of node i."""
    return numbered_lines(spark, path, "#").where("value <> ''").select(F.col("n").alias("id"), F.col("value").cast("long").alias("label"))


def write_partition(labels: DataFrame, path: str) -> None:
    """A label for each line, by id, in ranges."""
    labels.repartitionByRange("id").sortWithinPartitions("id").select(F.col("label").cast("string").alias("value")).write.text(path)


def read_edge_list_partition(spark: SparkSession, path: str, first: int = 0) -> DataFrame:
    """``(id, label)`` from ``node label`` lines."""
    p = _lines(spark, path, "#").where("value <> ''").select(F.split("value", r"\s+").alias("p"))
    return p.select((F.get("p", F.lit(0)).cast("long") - first).alias("id"), F.get("p", F.lit(1)).cast("long").alias("label"))


def read_cover(spark: SparkSession, path: str) -> DataFrame:
    """``(id, label)``: line i has the members of set i."""
    p = numbered_lines(spark, path, "#").where("value <> ''")
    return p.select(F.explode(F.split("value", r"\s+").cast("array<long>")).alias("id"), F.col("n").alias("label"))


def write_cover(members: DataFrame, path: str) -> None:
    """Line i has the members of the ith label, by label, in ranges."""
    lists = members.groupBy("label").agg(F.array_join(F.transform(F.array_sort(F.collect_list("id")), lambda x: x.cast("string")), " ").alias("value"))
    lists.repartitionByRange("label").sortWithinPartitions("label").select("value").write.text(path)


def read_edge_list_cover(spark: SparkSession, path: str, first: int = 0) -> DataFrame:
    """``(id, label)`` from ``node label label ...`` lines."""
    p = _lines(spark, path, "#").where("value <> ''").select(F.split("value", r"\s+").alias("p"))
    return p.select((F.get("p", F.lit(0)).cast("long") - first).alias("id"), F.explode(F.slice("p", 2, F.size("p") - 1).cast("array<long>")).alias("label"))


def read_dgs(spark: SparkSession, path: str) -> DataFrame:
    """Events ``(seq, type, u, v, w)`` from ``an ae ce ie de dn rn st`` lines.  Edge keys ``u-v`` give the ends."""
    t = numbered_lines(spark, path, "#").select("n", F.split("value", r"\s+").alias("p"))
    op, x = F.get("p", F.lit(0)), F.get("p", F.lit(1))
    kinds = {"an": "NODE_ADDITION", "dn": "NODE_REMOVAL", "rn": "NODE_RESTORATION", "ae": "EDGE_ADDITION", "de": "EDGE_REMOVAL", "ce": "EDGE_WEIGHT_UPDATE", "ie": "EDGE_WEIGHT_INCREMENT", "st": "TIME_STEP"}
    name = F.create_map(*(F.lit(y) for kv in kinds.items() for y in kv))[op]
    w = F.regexp_extract(F.array_join("p", " "), r"weight=([0-9.eE+-]+)", 1)
    key = F.split(x, "-")
    u = F.when(op == "ae", F.get("p", F.lit(2))).when(op.isin("ce", "ie", "de"), F.get(key, F.lit(0))).when(op != "st", x)
    v = F.when(op == "ae", F.get("p", F.lit(3))).when(op.isin("ce", "ie", "de"), F.get(key, F.lit(1)))
    return t.where(name.isNotNull()).select(F.col("n").alias("seq"), name.alias("type"), u.cast("long").alias("u"), v.cast("long").alias("v"), F.nullif(w, F.lit("")).cast("double").alias("w"))


def write_dgs(events: DataFrame, path: str) -> None:
    """Events ``(seq, type, u, v, w)`` as DGS004 lines, by seq, in ranges."""
    key, kind, u, v = F.concat_ws("-", "u", "v"), F.col("type"), F.col("u").cast("string"), F.col("v").cast("string")
    weight = F.concat(F.lit("weight="), F.coalesce("w", F.lit(1.0)).cast("string"))
    line = (
        F.when(kind == "NODE_ADDITION", F.concat_ws(" ", F.lit("an"), u))
        .when(kind == "NODE_REMOVAL", F.concat_ws(" ", F.lit("dn"), u))
        .when(kind == "NODE_RESTORATION", F.concat_ws(" ", F.lit("rn"), u))
        .when(kind == "EDGE_ADDITION", F.concat_ws(" ", F.lit("ae"), key, u, v, weight))
        .when(kind == "EDGE_REMOVAL", F.concat_ws(" ", F.lit("de"), key))
        .when(kind == "EDGE_WEIGHT_UPDATE", F.concat_ws(" ", F.lit("ce"), key, weight))
        .when(kind == "EDGE_WEIGHT_INCREMENT", F.concat_ws(" ", F.lit("ie"), key, weight))
        .when(kind == "TIME_STEP", F.concat_ws(" ", F.lit("st"), F.col("seq").cast("string")))
    )
    markup.write_ranges("DGS004\ngraph 0 0", [events.select(F.col("seq").alias("place"), line.alias("value")).where("value is not null")], "# end", path)


def write_snapshot(g: PropertyGraph, path: str) -> None:
    """Nodes and edges as Parquet, with a checksum of the rows of each table and the direction."""
    g.vertices.write.parquet(f"{path}/nodes")
    g.edges.write.parquet(f"{path}/edges")
    sums = [df.agg(F.count("*").alias("rows"), F.bit_xor(F.xxhash64(*sorted(df.columns))).alias("checksum")).select(F.lit(n).alias("table"), "rows", "checksum", F.lit(g.directed).alias("directed")) for n, df in (("nodes", g.vertices), ("edges", g.edges))]
    sums[0].unionByName(sums[1]).coalesce(1).write.json(f"{path}/manifest")


def read_snapshot(spark: SparkSession, path: str) -> PropertyGraph:
    """A written graph; raises ValueError where rows or checksums differ from the manifest."""
    known = {r["table"]: r for r in spark.read.json(f"{path}/manifest").collect()}
    tables = {}
    for name in ("nodes", "edges"):
        df = tables[name] = spark.read.parquet(f"{path}/{name}")
        found = df.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64(*sorted(df.columns))).alias("x")).first()
        if found["n"] != known[name]["rows"] or (found["x"] or 0) != (known[name]["checksum"] if "checksum" in known[name] and known[name]["checksum"] is not None else 0):
            raise ValueError(f"{name} differs from its manifest")
    return PropertyGraph(tables["nodes"], tables["edges"], known["nodes"]["directed"])


READERS = {
    "edgelist": read_edge_list,
    "snap": read_snap,
    "konect": read_konect,
    "metis": read_metis,
    "matrixmarket": read_matrix_market,
    "gml": read_gml,
    "graphml": markup.read_graphml,
    "gexf": markup.read_gexf,
}


def guess_format(spark: SparkSession, path: str) -> str:
    """A format's name, from the first line; of XML documents, from the path."""
    rows = spark.read.text(path).limit(1).collect()
    line = rows[0]["value"] if rows else ""
    if line.startswith(("<?xml", "<graphml", "<gexf")):
        return "gexf" if path.endswith(".gexf") or line.startswith("<gexf") else "graphml"
    if line.startswith("%%MatrixMarket"):
        return "matrixmarket"
    if line.lower().startswith(("graph", "creator")):
        return "gml"
    if line.startswith(("% sym", "% asym", "% bip")):
        return "konect"
    if line.startswith("#"):
        return "edgelist"
    return "metis" if path.endswith((".graph", ".metis")) else "edgelist"


def read_graph(spark: SparkSession, path: str, kind: str | None = None, **options) -> PropertyGraph:
    return READERS[kind or guess_format(spark, path)](spark, path, **options)
