"""Force-directed layout as a loop of joins: repulsion from grid cells at several resolutions, attraction along links.

A node is pushed by others like 1 / distance, by their mass (degree + 1) and its own. Far ones push as a cell: at each
resolution a node meets the cells that lie next to its own cell's parent, but not next to its own cell, as one mass at its
centre; at the finest one it meets the nodes of near cells singly, or a near cell as one mass if it is crowded. So a node
meets at most 27 cells a resolution, however many nodes there are, and no cell gives all its pairs.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.functions.checkpoints import checkpointed
from loomgraph.operators.components import components
from loomgraph.operators.graph import both_ways
from loomgraph.operators.order import placed

#: Nodes of a cell that are met singly.
CROWD = 16


def _unit(seed: int, salt: int, *keys: str) -> Column:
    """A number from 0 to 1, by a seeded hash."""
    return F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), *keys), F.lit(1 << 30)) / float(1 << 30)


def repulsion(points: DataFrame, levels: int) -> DataFrame:
    """(id, fx, fy) of points (id, part, x, y, mass) with coordinates from 0 to 1; only points of one part push each other."""
    size = 1 << levels

    def cell(axis: str, n: int) -> Column:
        return F.least(F.floor(F.col(axis) * n), F.lit(n - 1)).cast("long")

    at = points.withColumns({"cx": cell("x", size), "cy": cell("y", size)})
    cells = None
    for level in range(levels, 0, -1):
        own = at.groupBy("part", F.lit(level).alias("level"), F.shiftright("cx", levels - level).alias("gx"), F.shiftright("cy", levels - level).alias("gy"))
        one = own.agg(F.sum("mass").alias("m"), F.sum(F.col("mass") * F.col("x")).alias("mx"), F.sum(F.col("mass") * F.col("y")).alias("my"), F.count("*").alias("n"))
        cells = one if cells is None else cells.union(one)
    cells = checkpointed(cells)
    far = None
    for level in range(2, levels + 1):
        k = at.select("id", "part", "x", "y", "mass", F.shiftright("cx", levels - level).alias("ox"), F.shiftright("cy", levels - level).alias("oy"))
        for a, o in (("gx", "ox"), ("gy", "oy")):  # the six columns (and rows) of the parent's neighbours
            k = k.withColumn(a, F.explode(F.sequence(F.shiftright(o, 1) * 2 - 2, F.shiftright(o, 1) * 2 + 3)))
        k = k.where("abs(gx - ox) > 1 or abs(gy - oy) > 1").select("id", "part", "x", "y", "mass", F.lit(level).alias("level"), "gx", "gy")
        far = k if far is None else far.union(k)
    near = at
    for a, o in (("gx", "cx"), ("gy", "cy")):
        near = near.withColumn(a, F.explode(F.sequence(F.col(o) - 1, F.col(o) + 1)))
    near = near.select("id", "part", "x", "y", "mass", F.lit(levels).alias("level"), "gx", "gy", F.col("cx"), F.col("cy"))
    key = ["part", "level", "gx", "gy"]
    crowded = near.join(cells.where(F.col("n") > CROWD), key)
    own = (F.col("gx") == F.col("cx")) & (F.col("gy") == F.col("cy"))  # of its own cell a node meets the others only
    less = {c: (F.col(c) - F.when(own, w).otherwise(0.0)).alias(c) for c, w in (("m", F.col("mass")), ("mx", F.col("mass") * F.col("x")), ("my", F.col("mass") * F.col("y")))}
    met = crowded.select("id", "x", "y", "mass", less["m"], less["mx"], less["my"])
    if far is not None:
        met = met.union(far.join(cells, key).select("id", "x", "y", "mass", "m", "mx", "my"))
    few = at.join(cells.where((F.col("n") <= CROWD) & (F.col("level") == levels)).select("part", F.col("gx").alias("cx"), F.col("gy").alias("cy")), ["part", "cx", "cy"])
    few = few.select(F.col("id").alias("other"), "part", F.col("cx").alias("gx"), F.col("cy").alias("gy"), F.col("mass").alias("m"), (F.col("mass") * F.col("x")).alias("mx"), (F.col("mass") * F.col("y")).alias("my"))
    met = met.union(near.drop("level", "cx", "cy").join(few, ["part", "gx", "gy"]).where("id <> other").select("id", "x", "y", "mass", "m", "mx", "my"))
    dx, dy = F.col("x") - F.col("mx") / F.col("m"), F.col("y") - F.col("my") / F.col("m")
    push = F.col("mass") * F.col("m") / (dx * dx + dy * dy + 1e-12)
    return met.where("m > 0").groupBy("id").agg(F.sum(push * dx).alias("fx"), F.sum(push * dy).alias("fy"))


def forces(points: DataFrame, links: DataFrame, levels: int, gravity: float = 1.0) -> DataFrame:
    """(id, fx, fy): repulsion, attraction along links (u, v) by their length, and a pull of each mass to the middle. Scaled
    so that an isolated linked pair of equal nodes rests at a distance that falls with the number of nodes."""
    n = F.col("n")
    pull = both_ways(links.select("u", "v")).join(points.select(F.col("id").alias("u"), F.col("x").alias("ux"), F.col("y").alias("uy")), "u").join(points.select(F.col("id").alias("v"), F.col("x").alias("vx"), F.col("y").alias("vy")), "v")
    pull = pull.groupBy(F.col("u").alias("id")).agg(F.sum(F.col("vx") - F.col("ux")).alias("px"), F.sum(F.col("vy") - F.col("uy")).alias("py"))
    size = points.groupBy("part").agg(F.sum("mass").alias("n"))
    x = points.join(repulsion(points, levels), "id", "left").join(pull, "id", "left").join(size, "part").na.fill(0.0, ["fx", "fy", "px", "py"])
    return x.select("id", *[(F.col(f) / (n * 16) + F.col(p) + gravity * F.col("mass") / n * (0.5 - F.col(c))).alias(f) for f, p, c in (("fx", "px", "x"), ("fy", "py", "y"))])


def force_layout(links: DataFrame, rounds: int = 40, seed: int = 42) -> DataFrame:
    """(id, part, x, y): each component of links (u, v) laid out on its own in the unit square; part is its smallest node.
    Starting places are seeded hashes, so the same seed gives the same layout. Steps are bounded and shrink."""
    links = checkpointed(links.select("u", "v").where("u <> v").distinct())
    ends = both_ways(links).groupBy(F.col("u").alias("id")).agg((F.count("*") + 1.0).alias("mass"))
    part = components(links, "u", "v").toDF("id", "part")
    points = checkpointed(ends.join(part, "id").select("id", "part", _unit(seed, 0, "id").alias("x"), _unit(seed, 1, "id").alias("y"), "mass"))
    most = points.groupBy("part").count().agg(F.coalesce(F.max("count"), F.lit(1)).alias("n")).first().n
    levels = max(2, math.ceil(math.log(max(most, 4) / 4, 4)) + 1)
    for k in range(rounds):
        step = 0.1 * (1 - k / rounds) + 0.002
        f = forces(points, links, levels)
        moved = points.join(f, "id").withColumn("_f", F.sqrt(F.col("fx") ** 2 + F.col("fy") ** 2))
        by = F.least(F.lit(step) / F.greatest("_f", F.lit(1e-12)), F.lit(0.1))
        points = checkpointed(moved.select("id", "part", *[F.least(F.greatest(F.col(c) + F.col(g) * by, F.lit(0.0)), F.lit(1.0)).alias(c) for c, g in (("x", "fx"), ("y", "fy"))], "mass"))
    return points.select("id", "part", "x", "y")


def shelf(layout: DataFrame, width: float = 1000.0) -> DataFrame:
    """(id, x, y) of (id, part, x, y): the largest part (ties to the smaller name) scaled to the width, the others below it
    on shelves, larger ones first, each in a square whose side grows with the root of its size. Squares of one size fill
    rows by arithmetic, so the driver holds one row a distinct size."""
    spark = layout.sparkSession
    span = checkpointed(layout.groupBy("part").agg(F.count("*").alias("n"), *[g(c).alias(f"{a}{c}") for c in "xy" for a, g in (("low", F.min), ("high", F.max))]))
    top = span.orderBy(F.desc("n"), "part").limit(1).collect()
    if not top:
        return layout.select("id", "x", "y")
    g = top[0]
    scale = width / (g.highx - g.lowx) if g.highx > g.lowx else 1.0
    x, y, high, rows = 0.0, (g.highy - g.lowy) * scale + 60, 0.0, []
    for r in span.where(F.col("part") != g.part).groupBy("n").agg(F.count("*").alias("c")).orderBy(F.desc("n")).collect():  # a row a size
        side = 2 * 9 * math.sqrt(r.n) + 16
        first = max(0, int((width - x) // side)) if x > 0 else max(1, int(width // side))
        rows.append((r.n, side, x, y, first, max(1, int(width // side)), high))
        left = r.c - first
        if left > 0:
            per = max(1, int(width // side))
            y += max(high, side if first else 0.0) + side * ((left - 1) // per)
            x, high = side * ((left - 1) % per + 1), side
        else:
            x, high = x + side * r.c, max(high, side)
    sizes = spark.createDataFrame(rows, "n long, side double, x0 double, y0 double, first long, per long, high double")
    order = placed(span.where(F.col("part") != g.part).select("part", "n"), F.desc("n"), "part")
    begin = order.groupBy("n").agg(F.min("place").alias("_b"))
    k = (F.col("place") - F.col("_b")).alias("k")
    box = order.join(begin, "n").join(F.broadcast(sizes), "n").select("part", "side", "x0", "y0", "first", "per", "high", k)
    later = F.col("k") - F.col("first")
    down = F.greatest(F.col("high"), F.when(F.col("first") > 0, F.col("side")).otherwise(0.0))
    box = box.select("part", "side", F.when(later < 0, F.col("x0") + F.col("k") * F.col("side")).otherwise((later % F.col("per")) * F.col("side")).alias("bx"), F.when(later < 0, F.col("y0")).otherwise(F.col("y0") + down + F.floor(later / F.col("per")) * F.col("side")).alias("by"))
    placed_ = layout.join(span, "part").join(box, "part", "left")
    inside = lambda c: 8 + (F.col("side") - 16) * F.when(F.col(f"high{c}") > F.col(f"low{c}"), (F.col(c) - F.col(f"low{c}")) / (F.col(f"high{c}") - F.col(f"low{c}"))).otherwise(0.5)
    main = F.col("part") == g.part
    return placed_.select("id", *[F.when(main, (F.col(c) - F.col(f"low{c}")) * scale).otherwise(F.col(f"b{c}") + inside(c)).alias(c) for c in "xy"])


def network_layout(nodes: DataFrame, weighted: DataFrame, backbone: DataFrame, rounds: int = 40, seed: int = 42, passes: int = 60) -> DataFrame:
    """(id, x, y, part): nodes of the backbone by force_layout and shelf; of the rest, pass by pass, each at the mean of its
    placed neighbours in the whole graph, with a seeded jitter of a few units; nodes that no pass reaches have no place."""
    done = checkpointed(shelf(force_layout(backbone, rounds, seed)).withColumn("part", F.lit("backbone")))
    near = checkpointed(both_ways(weighted.select("u", "v")))
    for k in range(passes):
        rest = nodes.select("id").join(done.select("id"), "id", "left_anti")
        mean = near.join(done.select(F.col("id").alias("v"), "x", "y"), "v").groupBy(F.col("u").alias("id")).agg(F.avg("x").alias("x"), F.avg("y").alias("y"))
        jitter = lambda salt: (_unit(seed, salt, "id") + _unit(seed, salt + 1, "id") + _unit(seed, salt + 2, "id") - 1.5) * 12  # noqa: E731  sd 6
        new = checkpointed(rest.join(mean, "id").select("id", (F.col("x") + jitter(10)).alias("x"), (F.col("y") + jitter(20)).alias("y"), F.lit("rest").alias("part")))
        if new.isEmpty():
            break
        done = checkpointed(done.union(new))
    return nodes.select("id").join(done, "id", "left")
