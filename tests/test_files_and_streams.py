"""File formats, and streams run to their end over files."""

from pyspark.sql import functions as F

from loomgraph.sources import formats, markup
from loomgraph.streaming import events
from tests.test_graph import KITE, make


def _write(path, text):
    path.write_text(text)
    return str(path)


def test_text_formats(spark, tmp_path):
    g = formats.read_metis(spark, _write(tmp_path / "a.graph", "% tiny\n3 2\n2 3\n1\n1\n"))
    assert sorted(map(tuple, g.edges.select("src", "dst").collect())) == [(0, 1), (0, 2)] and g.vertices.count() == 3
    g = formats.read_metis(spark, _write(tmp_path / "b.graph", "2 1 1\n2 7\n1 7\n"))
    assert g.edges.first()["w"] == 7.0
    g = formats.read_graph(spark, _write(tmp_path / "c.mtx", "%%MatrixMarket matrix coordinate real symmetric\n% x\n3 3 2\n2 1 5.0\n3 1 2.0\n"))
    assert not g.directed and sorted(r["w"] for r in g.edges.collect()) == [2.0, 5.0]
    g = formats.read_edge_list(spark, _write(tmp_path / "d.txt", "# c\na b\nb c 2.5\n"), labels=True)
    assert g.vertices.count() == 3 and g.edges.count() == 2
    g = formats.read_konect(spark, _write(tmp_path / "e.txt", "% asym posweighted\n1 2 3\n1 2 4\n"))
    assert g.directed and g.edges.first()["w"] == 7.0
    g = formats.read_gml(spark, _write(tmp_path / "f.gml", "graph [\n node [ id 1 ]\n node [ id 2 ]\n edge [ source 1 target 2 ]\n]\n"))
    assert g.vertices.count() == 2 and g.edges.count() == 1
    e = formats.read_dgs(spark, _write(tmp_path / "g.dgs", "DGS004\ngraph 0 0\nan 0\nan 1\nae 0-1 0 1 weight=3\nst 1\nce 0-1 weight=5\n"))
    assert events.replay(e).edges.first()["w"] == 5.0


def test_round_trips(spark, tmp_path):
    g = make(spark, KITE, 6)
    formats.write_metis(g, str(tmp_path / "m"))
    assert sorted(formats.read_metis(spark, str(tmp_path / "m")).edges.collect()) == sorted(g.edges.collect())
    formats.write_edge_list(g, str(tmp_path / "l"), weights=True)
    assert sorted(formats.read_edge_list(spark, str(tmp_path / "l")).edges.collect()) == sorted(g.edges.collect())
    formats.write_snapshot(g, str(tmp_path / "s"))
    assert sorted(formats.read_snapshot(spark, str(tmp_path / "s")).edges.collect()) == sorted(g.edges.collect())
    formats.write_partition(g.vertices.withColumn("label", F.col("id") % 2), str(tmp_path / "p"))
    assert [r["label"] for r in formats.read_partition(spark, str(tmp_path / "p")).orderBy("id").collect()] == [0, 1, 0, 1, 0, 1]


def test_markup(spark, tmp_path):
    g = make(spark, KITE, 6)
    for name, write, read in (("x.graphml", markup.write_graphml, markup.read_graphml), ("x.gexf", markup.write_gexf, markup.read_gexf), ("x.gml", markup.write_gml, formats.read_gml)):
        write(g, str(tmp_path / name))
        back = read(spark, str(tmp_path / name))
        assert sorted(map(tuple, back.edges.select("src", "dst", "w").collect())) == sorted(map(tuple, g.edges.select("src", "dst", "w").collect())), name
        assert back.vertices.count() == 6 and not back.directed
    text = '<graphml>\n<key id="d0" for="edge" attr.name="weight" attr.type="double"/>\n<graph edgedefault="directed">\n<node id="b"/>\n<node id="a"/><node id="lone"/>\n<edge source="b" target="a"><data key="d0">2.5</data></edge>\n<edge source="a" target="b"/>\n</graph>\n</graphml>\n'
    g = formats.read_graph(spark, _write(tmp_path / "y.graphml", text))
    assert g.directed and g.vertices.count() == 3
    assert sorted(map(tuple, g.edges.select("src", "dst", "w").collect())) == [(0, 1, 1.0), (1, 0, 2.5)]
    text = '<gexf><graph mode="dynamic">\n<nodes><node id="0" start="1" end="4"/><node id="1"><spells><spell start="0" end="1"/><spell start="2" end="3"/></spells></node></nodes>\n<edges><edge id="0" source="0" target="1" start="2"/></edges>\n</graph></gexf>\n'
    spells = markup.read_gexf_spells(spark, _write(tmp_path / "z.gexf", text)).collect()
    assert set(map(tuple, spells)) == {("node", "0", None, 1.0, 4.0), ("node", "1", None, 0.0, 1.0), ("node", "1", None, 2.0, 3.0), ("edge", "0", "1", 2.0, None)}


def test_events_covers_and_drawings(spark, tmp_path):
    rows = [(0, "NODE_ADDITION", 0, None, None), (1, "NODE_ADDITION", 1, None, None), (2, "EDGE_ADDITION", 0, 1, 3.0), (3, "TIME_STEP", None, None, None), (4, "EDGE_WEIGHT_INCREMENT", 0, 1, 2.0)]
    formats.write_dgs(spark.createDataFrame(rows, "seq long, type string, u long, v long, w double"), str(tmp_path / "d"))
    back = formats.read_dgs(spark, str(tmp_path / "d")).orderBy("seq").select("type", "u", "v", "w").collect()
    assert [tuple(r) for r in back] == [r[1:] for r in rows]
    members = [(0, 0), (1, 0), (1, 1), (2, 1)]
    formats.write_cover(spark.createDataFrame(members, "id long, label long"), str(tmp_path / "c"))
    assert sorted(map(tuple, formats.read_cover(spark, str(tmp_path / "c")).collect())) == members
    lines = _write(tmp_path / "e", "1 7 8\n2 8\n")
    assert sorted(map(tuple, formats.read_edge_list_cover(spark, lines, first=1).collect())) == [(0, 7), (0, 8), (1, 8)]
    formats.write_dot(make(spark, KITE, 6), str(tmp_path / "g"))
    lines = [r["value"] for r in formats.numbered_lines(spark, str(tmp_path / "g")).orderBy("n").collect()]
    assert lines[0] == "graph g {" and lines[-1] == "}" and len(lines) == 2 + len(KITE)


def test_folding_a_stream(spark, tmp_path):
    rows = spark.createDataFrame([(0, 1, 1.0), (0, 1, 2.0), (1, 2, 1.0)], "src long, dst long, w double")
    for i in range(2):
        rows.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = events.fold_edges(stream, str(tmp_path / "table"), str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r["src"], r["dst"]): r["w"] for r in events.folded(spark, str(tmp_path / "table")).collect()}
    assert got == {(0, 1): 6.0, (1, 2): 2.0}


def test_windows_on_a_stream(spark, tmp_path):
    e = spark.sql("select timestamp'2024-01-01 00:10:00' as ts, 1L as user_id, 'a' as event_type, 1.0D as value union all select timestamp'2024-01-01 05:00:00', 1L, 'a', 2.0D")
    e.coalesce(1).write.parquet(str(tmp_path / "in"))
    s = events.windowed_activity(events.read_events(spark, str(tmp_path / "in"), e.schema))
    q = s.writeStream.outputMode("append").format("memory").queryName("win").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert [r["n"] for r in spark.sql("select * from win").collect()] == [1]


def test_markup_in_parts(spark, tmp_path):
    """A file that is only the middle of a document has all its elements read, on one line or on several."""
    (tmp_path / "g").mkdir()
    (tmp_path / "g" / "part-0").write_text('<graphml>\n<key id="w" for="edge" attr.name="weight"/>\n<graph edgedefault="undirected">\n<node id="0"/>\n<node id="1"/>\n')
    (tmp_path / "g" / "part-1").write_text("".join(f'<node id="{i}"/>\n' for i in range(2, 6)) + '<edge source="0" target="1"><data key="w">2.0</data></edge>\n')
    (tmp_path / "g" / "part-2").write_text("".join(f'<edge source="{i}" target="{i + 1}">\n<data key="w">3.0</data>\n</edge>\n' for i in range(1, 5)))
    (tmp_path / "g" / "part-3").write_text("</graph>\n</graphml>\n")
    g = markup.read_graphml(spark, str(tmp_path / "g"))
    assert g.vertices.count() == 6 and sorted(map(tuple, g.edges.select("src", "dst", "w").collect())) == [(0, 1, 2.0)] + [(i, i + 1, 3.0) for i in range(1, 5)]
    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "part-0").write_text('<gexf>\n<graph defaultedgetype="undirected">\n<node id="0"/>\n<node id="1"/>\n')
    (tmp_path / "x" / "part-1").write_text('<node id="2"/>\n<edge source="0" target="1" weight="2.0"/>\n<edge source="1" target="2" weight="3.0"/>\n')
    (tmp_path / "x" / "part-2").write_text('<edge source="0" target="2" weight="4.0"/>\n</graph>\n</gexf>\n')
    g = markup.read_gexf(spark, str(tmp_path / "x"))
    assert g.vertices.count() == 3 and sorted(map(tuple, g.edges.select("src", "dst", "w").collect())) == [(0, 1, 2.0), (0, 2, 4.0), (1, 2, 3.0)]
