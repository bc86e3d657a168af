"""Random graphs with the degrees of a given one, or with given degrees; hashes take the place of random numbers, so reruns agree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgraph.graph import PropertyGraph, dense_ids
from loomgraph.scratch import materialize


def _uniform(seed: int, *keys: Column | str) -> Column:
    """A number in (0, 1) for each combination of keys."""
    return (F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1 << 52)) + 0.5) / float(1 << 52)


def global_curveball(g: PropertyGraph, rounds: int = 20, seed: int = 42) -> PropertyGraph:
    """An undirected simple graph with the same degrees, after rounds of trades.

    In each round the nodes are paired at random, and half of the pairs, at random, trade: what one of a pair's nodes has among
    the nodes that don't trade and the other has not is pooled, shuffled, and dealt back in the same numbers.  As the
    nodes that don't trade keep their degrees whoever they are tied to, and no two pairs can make the same edge, trades don't
    conflict.  Raises ValueError for loops or repeated edges; weights become 1.
    """
    if g.directed:
        raise ValueError("an undirected graph is asked for")
    e = g.edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))
    if not e.where("src = dst").isEmpty() or not e.groupBy("src", "dst").count().where("count > 1").isEmpty():
        raise ValueError("the graph has loops or repeated edges")
    e = materialize(e, "curveball")
    for r in range(rounds):
        salt = seed * 1_000_003 + r
        order = dense_ids(g.vertices.select("id", F.xxhash64(F.lit(salt), "id").alias("h")), ["h", "id"], "at")
        pairs = order.select("id", F.floor(F.col("at") / 2).alias("pair"), (F.col("at") % 2).alias("side"))
        pairs = materialize(pairs.withColumn("trades", F.pmod(F.xxhash64(F.lit(salt), "pair"), F.lit(2)) == 0), "curveball-pairs")
        a, b = (pairs.select(F.col("id").alias(x), F.col("pair").alias(f"p_{x}"), F.col("side").alias(f"s_{x}"), F.col("trades").alias(f"t_{x}")) for x in ("src", "dst"))
        named = materialize(e.join(a, "src").join(b, "dst"), "curveball-named")
        still = named.where("t_src = t_dst").select("src", "dst")
        first = named.where("t_src and not t_dst").select(F.col("src").alias("own"), F.col("p_src").alias("pair"), F.col("s_src").alias("side"), F.col("dst").alias("other"))
        second = named.where("t_dst and not t_src").select(F.col("dst").alias("own"), F.col("p_dst").alias("pair"), F.col("s_dst").alias("side"), F.col("src").alias("other"))
        moving = first.unionByName(second)
        shared = F.count("*").over(Window.partitionBy("pair", "other"))
        counted = materialize(moving.withColumn("shared", shared), "curveball-moving")
        common, single = counted.where("shared = 2").select("own", "other"), counted.where("shared = 1")
        firsts = single.groupBy("pair").agg(F.count(F.when(F.col("side") == 0, 1)).alias("n"))
        place = F.row_number().over(Window.partitionBy("pair").orderBy(F.xxhash64(F.lit(salt + 1), "other"), "other"))
        dealt = single.withColumn("place", place).join(firsts, "pair").select("pair", "other", F.when(F.col("place") <= F.col("n"), 0).otherwise(1).alias("side"))
        dealt = dealt.join(pairs.select("pair", "side", F.col("id").alias("own")), ["pair", "side"]).select("own", "other")
        traded = common.unionByName(dealt).select(F.least("own", "other").alias("src"), F.greatest("own", "other").alias("dst"))
        e = materialize(still.unionByName(traded), "curveball")
    return PropertyGraph(g.vertices, e.withColumn("w", F.lit(1.0)), False)


def switched(edges: DataFrame, wrong: DataFrame | None, salt: int) -> DataFrame:
    """edges (src, dst, eid) after one round of switches: edges are paired at random, a-b and c-d become a-d and c-b, where neither is a
    loop, is there already, or is made by another pair.  wrong (eid), if given: only pairs with such an edge switch."""
    flip = F.pmod(F.xxhash64(F.lit(salt), "eid"), F.lit(2)) == 0
    turned = edges.select("eid", F.when(flip, F.col("src")).otherwise(F.col("dst")).alias("a"), F.when(flip, F.col("dst")).otherwise(F.col("src")).alias("b"), F.xxhash64(F.lit(salt + 1), "eid").alias("h"))
    ranked = dense_ids(turned, ["h", "eid"], "at").select("eid", "a", "b", F.floor(F.col("at") / 2).alias("pair"), (F.col("at") % 2).alias("side"))
    ranked = materialize(ranked if wrong is None else ranked.join(wrong.withColumn("wrong", F.lit(True)), "eid", "left"), "switch-ranked")
    x, y = ranked.where("side = 0"), ranked.where("side = 1").select("pair", F.col("eid").alias("eid2"), F.col("a").alias("c"), F.col("b").alias("d"), *([F.col("wrong").alias("wrong2")] if wrong is not None else []))
    pairs = x.join(y, "pair")
    pairs = pairs if wrong is None else pairs.where("wrong or wrong2")
    new = pairs.select("pair", F.explode(F.array(F.struct(F.col("eid").alias("eid"), F.least("a", "d").alias("src"), F.greatest("a", "d").alias("dst")), F.struct(F.col("eid2").alias("eid"), F.least("c", "b").alias("src"), F.greatest("c", "b").alias("dst")))).alias("e")).select("pair", "e.*")
    new = materialize(new, "switch-new")
    made = new.groupBy("src", "dst").agg(F.count("*").alias("k"))
    there = edges.select("src", "dst", F.lit(True).alias("there")).distinct()
    bad = new.join(made, ["src", "dst"]).join(there, ["src", "dst"], "left").where("src = dst or k > 1 or there").select("pair").distinct()
    good = new.join(bad, "pair", "left_anti").select("eid", F.col("src").alias("s"), F.col("dst").alias("t"))
    return edges.join(good, "eid", "left").select(F.coalesce("s", "src").alias("src"), F.coalesce("t", "dst").alias("dst"), "eid")


def edge_switching(g: PropertyGraph, per_edge: float = 1.0, seed: int = 42) -> PropertyGraph:
    """An undirected simple graph with the same degrees, after rounds of switches until each edge has been tried ``per_edge`` times; a
    round tries each edge once.  Weights become 1."""
    e = g.edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))
    e = materialize(dense_ids(e, ["src", "dst"], "eid"), "switch")
    for r in range(max(1, round(per_edge))):
        e = materialize(switched(e, None, seed * 1_000_003 + 2 * r), "switch")
    return PropertyGraph(g.vertices, e.select("src", "dst", F.lit(1.0).alias("w")), False)


def configuration_model(degrees: DataFrame, simple: bool = True, seed: int = 42, max_rounds: int = 200) -> PropertyGraph:
    """A graph with exactly these degrees (id, degree): every node has as many stubs, and stubs are paired at random.  simple: loops
    and repeated edges are switched with others until there are none.  Raises ValueError for an odd sum, RuntimeError
    where loops remain after max_rounds (some degrees have no simple graph)."""
    if (degrees.agg(F.sum("degree")).first()[0] or 0) % 2:
        raise ValueError("the degrees have an odd sum")
    stubs = degrees.where("degree > 0").select("id", F.explode(F.sequence(F.lit(1).cast("long"), F.col("degree").cast("long"))).alias("k"))
    placed = dense_ids(stubs.withColumn("h", F.xxhash64(F.lit(seed), "id", "k")), ["h", "id", "k"], "at").select("id", F.floor(F.col("at") / 2).alias("eid"))
    e = placed.groupBy("eid").agg(F.min("id").alias("src"), F.max("id").alias("dst"))
    e = materialize(e.select("src", "dst", "eid"), "configuration")
    for r in range(max_rounds if simple else 0):
        copy = F.row_number().over(Window.partitionBy("src", "dst").orderBy("eid"))
        wrong = materialize(e.withColumn("copy", copy).where("src = dst or copy > 1").select("eid"), "configuration-wrong")
        if wrong.isEmpty():
            break
        e = materialize(switched(e, wrong, seed * 1_000_003 + 2 * r), "configuration")
    else:
        if simple:
            raise RuntimeError(f"no simple graph after {max_rounds} rounds")
    return PropertyGraph(degrees.select("id"), e.select("src", "dst", F.lit(1.0).alias("w")), False)


def powerlaw_degrees(spark: SparkSession, n: int, least: int, most: int, gamma: float, seed: int = 42, even: bool = True) -> DataFrame:
    """``(id, degree)``: n degrees from least to most, drawn in proportion to degree ** -gamma (gamma > 0).  even: the largest
    of the nodes of smallest degree below ``most`` gets one more if their sum would be odd."""
    weights = [k**-gamma for k in range(least, most + 1)]
    total, run, steps = sum(weights), 0.0, []
    for k, w in zip(range(least, most + 1), weights, strict=True):
        run += w / total
        steps.append((k, run))
    table = spark.createDataFrame([(k, low, high) for (k, high), (_, low) in zip(steps, [(0, 0.0), *steps[:-1]], strict=True)], "degree long, low double, high double")
    drawn = spark.range(n).select("id", _uniform(seed, "id").alias("u"))
    # A draw meets the hundredth of the unit interval that it lies in, then its own step.
    cut = table.select("degree", "low", "high", F.explode(F.sequence(F.floor(F.col("low") * 100), F.floor(F.least(F.col("high"), F.lit(1.0)) * 100))).alias("cell"))
    found = drawn.withColumn("cell", F.floor(F.col("u") * 100)).join(F.broadcast(cut), "cell").where("u >= low and u < high").select("id", "degree")
    found = materialize(drawn.select("id").join(found, "id", "left").select("id", F.coalesce("degree", F.lit(most)).alias("degree")), "powerlaw")
    if not even or (found.agg(F.sum("degree")).first()[0] or 0) % 2 == 0:
        return found
    one = found.where(F.col("degree") < most).agg(F.max_by("id", F.struct(-F.col("degree"), "id"))).first()[0]
    return found.select("id", (F.col("degree") + F.when(F.col("id") == one, 1).otherwise(0)).alias("degree")) if one is not None else found


def preferential_attachment(spark: SparkSession, n: int, k: int, seed: int = 42) -> PropertyGraph:
    """n nodes, each of which, but for the first k, comes with k edges to earlier nodes, chosen in proportion to their degrees at that
    time.  Repeats among a node's k choices are merged, so some nodes have fewer.

    The ends of all edges stand in one list: place 2i is the node that comes with edge i, place 2i + 1 copies a place before it, drawn
    by a hash.  References to copies are resolved for all edges at once, by pointer jumping: the rounds grow with the logarithm of
    the longest chain.
    """
    m = (n - k) * k
    i = F.col("id")
    # The first edges go to nodes 0 to k - 1; an even place is known, an odd one refers to an earlier place.
    draw = F.floor(_uniform(seed, "id") * (2 * i)).cast("long")
    odd = spark.range(max(m, 0)).select(i.alias("edge"), F.when(i < k, -1 - i).otherwise(draw).alias("at"))
    state = materialize(odd, "attachment")  # at: the place that edge's end copies; below zero: node -1 - at itself
    while True:
        refers = (F.col("at") >= 0) & (F.col("at") % 2 == 1)
        open_refs = state.where(refers)
        if open_refs.isEmpty():
            break
        to = state.select(F.floor(F.col("edge")).alias("ref"), F.col("at").alias("next"))
        jumped = open_refs.select("edge", F.floor(F.col("at") / 2).alias("ref")).join(to, "ref").select("edge", F.col("next").alias("at"))
        state = materialize(state.where(~refers).unionByName(jumped), "attachment")
    target = F.when(F.col("at") < 0, -1 - F.col("at")).otherwise(k + F.floor(F.col("at") / 2 / k))
    edges = state.select((k + F.floor(F.col("edge") / k)).alias("u"), target.cast("long").alias("v"))
    e = edges.select(F.least("u", "v").alias("src"), F.greatest("u", "v").alias("dst")).where("src <> dst").distinct()
    return PropertyGraph(spark.range(n), e.withColumn("w", F.lit(1.0)), False)


def hyperbolic_points(spark: SparkSession, n: int, gamma: float = 3.0, radius: float = 10.0, seed: int = 42) -> DataFrame:
    """``(id, r, phi)``: points of a hyperbolic disk, denser outwards by alpha = (gamma - 1) / 2."""
    alpha = (gamma - 1) / 2
    r = F.acosh(1 + (F.cosh(F.lit(alpha * radius)) - 1) * _uniform(seed, "id")) / alpha
    return spark.range(n).select("id", r.alias("r"), (_uniform(seed + 1, "id") * 6.283185307179586).alias("phi"))


def hyperbolic_graph(points: DataFrame, radius: float, bands: int = 16, cells: int = 4096) -> PropertyGraph:
    """Points (id, r, phi) joined where their hyperbolic distance is at most ``radius``.

    The disk is cut into bands by radius and each band into cells by angle, narrower outwards.  A point looks only at the cells
    of a band that its widest angle to that band's inner rim can reach, so no pair of points is tried that is far apart.
    """
    spark = points.sparkSession
    rim = [radius * i / bands for i in range(bands)]
    # A cell holds about the angle that two points on the band's inner rim can be apart.
    widths = [(b, lo, int(max(1, min(cells, 6.283185307179586 / max(2 * 2.718281828 ** (radius / 2 - lo), 1e-9))))) for b, lo in enumerate(rim)]
    band = F.least(F.floor(F.col("r") / radius * bands), F.lit(bands - 1)).cast("int")
    table = F.broadcast(spark.createDataFrame(widths, "band int, lo double, cells int"))  # a row for each band
    turn = F.lit(6.283185307179586)
    own = points.withColumn("band", band).join(table, "band").select("id", "r", "phi", "band", F.least(F.floor(F.col("phi") / turn * F.col("cells")), F.col("cells") - 1).cast("long").alias("cell"))
    own = materialize(own, "hyperbolic-points")
    # A partner lies in the same band or further out.
    q = own.select(F.col("id").alias("u"), F.col("r").alias("ru"), F.col("phi").alias("pu"), F.col("band").alias("from")).join(table, F.col("band") >= F.col("from"))
    inner = F.greatest("lo", F.lit(1e-9))
    ratio = (F.cosh("ru") * F.cosh(inner) - F.cosh(F.lit(radius))) / (F.sinh(F.greatest("ru", F.lit(1e-9))) * F.sinh(inner))
    reach = F.when((F.col("ru") + F.col("lo") <= radius) | (ratio <= -1), 3.2).when(ratio >= 1, 0.0).otherwise(F.acos(ratio) + 1e-9)
    low, high = F.floor((F.col("pu") - reach) / turn * F.col("cells")).cast("long"), F.floor((F.col("pu") + reach) / turn * F.col("cells")).cast("long")
    seen = F.when(high - low + 1 >= F.col("cells"), F.sequence(F.lit(0).cast("long"), F.col("cells").cast("long") - 1)).otherwise(F.array_distinct(F.transform(F.sequence(low, high), lambda c: F.pmod(c, F.col("cells").cast("long")))))
    asked = q.select("u", "ru", "pu", "from", "band", F.explode(seen).alias("cell"))
    pairs = asked.join(own, ["band", "cell"]).where("(`from` < band) or (u < id)")
    near = F.cosh("ru") * F.cosh("r") - F.sinh("ru") * F.sinh("r") * F.cos(F.col("pu") - F.col("phi")) <= F.cosh(F.lit(radius))
    edges = pairs.where(near).select(F.least("u", "id").alias("src"), F.greatest("u", "id").alias("dst")).distinct().withColumn("w", F.lit(1.0))
    return PropertyGraph(points.select("id"), edges, False)
