"""Masks as runs: components across any seams, and their outlines as polygons with holes.

A mask is a table of pixels (keys, row, col).  Runs of a row are the nodes of a graph whose edges join runs that
touch in successive rows, so that components come out of joins over the whole scene, and neither a scene nor a tile is
ever a task.  An outline needs the runs of its own component alone.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geosweep.operators import graph
from geosweep.operators.graph import settled

#: Columns of a stretch in which runs of successive rows look for each other.
STRETCH = 256


def runs(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, row, x1, x2): the stretches of successive pixels of each row, x2 left out; repeated pixels count once."""
    p = pixels.select(*keys, F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col")).distinct()
    island = F.col("col") - F.row_number().over(Window.partitionBy(*keys, "row").orderBy("col"))
    return p.withColumn("__i", island).groupBy(*keys, "row", "__i").agg(F.min("col").alias("x1"), (F.max("col") + 1).alias("x2")).drop("__i")


def components(pixels: DataFrame, keys: list[str], diagonal: bool = False) -> DataFrame:
    """Runs of a mask with component: a text that names the component's first run; pixels join by sides, or by corners too."""
    name = F.concat_ws("|", *(F.col(k).cast("string") for k in keys), F.lpad(F.col("row").cast("string"), 9, "0"), F.lpad(F.col("x1").cast("string"), 9, "0"))
    made = runs(pixels, keys).withColumn("id", name).transform(settled)
    reach = 1 if diagonal else 0
    lain = made.withColumn("__s", F.explode(F.sequence(F.floor(F.col("x1") / STRETCH), F.floor((F.col("x2") - 1 + reach) / STRETCH))))
    below = lain.select(*keys, (F.col("row") - 1).alias("row"), "__s", F.col("id").alias("dst"), F.col("x1").alias("y1"), F.col("x2").alias("y2"))
    touching = lain.join(below, [*keys, "row", "__s"]).where((F.col("x1") < F.col("y2") + reach) & (F.col("y1") < F.col("x2") + reach))
    joined = graph.components(made, touching.select(F.col("id").alias("src"), "dst"))
    return made.join(joined, "id").drop("id")


def rings_of(row: np.ndarray, x1: np.ndarray, x2: np.ndarray) -> list[list[list[int]]]:
    """Closed outlines (x, y) of one component from its runs, the outer first and then its holes, no corner on a side.

    Sides keep the mask on their right: tops lead east, bottoms west.  Where two pixels meet in a corner alone, the
    outline turns right and stays with its own.
    """
    by_row: dict[int, list[tuple[int, int]]] = {}
    for r, a, b in sorted(zip(row.tolist(), x1.tolist(), x2.tolist(), strict=True)):
        by_row.setdefault(r, []).append((a, b))
    out: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for r, spans in by_row.items():
        for a, b in spans:
            out.setdefault((b, r), []).append((b, r + 1))
            out.setdefault((a, r + 1), []).append((a, r))
    for y in {*by_row, *(r + 1 for r in by_row)}:
        tops, bottoms = by_row.get(y, []), by_row.get(y - 1, [])
        cuts = sorted({x for s in (tops, bottoms) for span in s for x in span})
        inside = lambda spans, x: any(a <= x < b for a, b in spans)
        for a, b in zip(cuts, cuts[1:], strict=False):
            top, bottom = inside(tops, a), inside(bottoms, a)
            if top and not bottom:
                out.setdefault((a, y), []).append((b, y))
            elif bottom and not top:
                out.setdefault((b, y), []).append((a, y))
    found = []
    while out:
        start = min(out)
        here, way, ring = start, None, []
        while True:
            ends = out[here]
            if len(ends) > 1 and way is not None:
                # of the ways on, the one that turns right (with y downwards)
                ends.sort(key=lambda e: way[0] * (e[1] - here[1]) - way[1] * (e[0] - here[0]))
            end = ends.pop()
            if not ends:
                del out[here]
            turn = (np.sign(end[0] - here[0]), np.sign(end[1] - here[1]))
            if turn != way:
                ring.append(list(here))
            here, way = end, turn
            if here == start and (start not in out or way == (0, -1)):
                break
        # the start itself may lie on a side
        (ax, ay), (bx, by), (cx, cy) = ring[-1], ring[0], ring[1 % len(ring)]
        if (bx - ax) * (cy - by) == (by - ay) * (cx - bx):
            ring = ring[1:]
        found.append(ring)
    area = lambda g: sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(g, [*g[1:], g[0]], strict=True))
    return sorted(found, key=lambda g: (-abs(area(g)), g))


def outlines(pixels: DataFrame, keys: list[str], min_pixels: int = 1, diagonal: bool = False) -> DataFrame:
    """(keys, component, pixels, row_min, col_min, row_max, col_max, rings) of each component, corners in pixels."""
    listed = components(pixels, keys, diagonal).groupBy(*keys, "component").agg(
        F.sum(F.col("x2") - F.col("x1")).alias("pixels"), F.min("row").alias("row_min"), F.min("x1").alias("col_min"), F.max("row").alias("row_max"), (F.max("x2") - 1).alias("col_max"),
        F.collect_list(F.struct("row", "x1", "x2")).alias("__r"),
    ).where(F.col("pixels") >= min_pixels)

    @F.pandas_udf("array<array<struct<x: long, y: long>>>")
    def trace(row: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
        made = [rings_of(*(np.asarray(v) for v in r)) for r in zip(row, a, b, strict=True)]
        return pd.Series([[[{"x": x, "y": y} for x, y in ring] for ring in rings] for rings in made])

    return listed.withColumn("rings", trace("__r.row", "__r.x1", "__r.x2")).drop("__r")


def mean_in_boxes(boxes: DataFrame, pixels: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Adds score: the mean of all pixels within row_min..row_max and col_min..col_max of each box.

    Sums along each row up to a column make a box a matter of two looks a row, however wide it is.
    """
    w = Window.partitionBy(*keys, "row").orderBy("col").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    upto = pixels.select(*keys, F.col("row").cast("long").alias("row"), F.col("col").cast("long").alias("col"), F.sum(F.col(value).cast("double")).over(w).alias("s"), F.count(value).over(w).alias("n"))
    spans = upto.withColumn("to", F.lead("col").over(Window.partitionBy(*keys, "row").orderBy("col")))
    asked = boxes.select(*keys, "component", F.explode(F.sequence("row_min", "row_max")).alias("row"), "col_min", "col_max")
    # sums stay until the next pixel of the row: the one that holds at a column is found by its own stretch
    lain = spans.withColumn("__s", F.explode(F.sequence(F.floor(F.col("col") / STRETCH), F.floor((F.coalesce(F.col("to"), F.lit(1 << 20)) - 1) / STRETCH))))
    ends = asked.select(*keys, "component", "row", F.explode(F.array(F.struct((F.col("col_min") - 1).alias("at"), F.lit(-1).alias("sign")), F.struct(F.col("col_max").alias("at"), F.lit(1).alias("sign")))).alias("e")).select(*keys, "component", "row", "e.*").withColumn("__s", F.floor(F.col("at") / STRETCH))
    met = ends.join(lain, [*keys, "row", "__s"]).where((F.col("at") >= F.col("col")) & (F.col("to").isNull() | (F.col("at") < F.col("to"))))
    total = met.groupBy(*keys, "component").agg(F.sum(F.col("sign") * F.col("s")).alias("s"), F.sum(F.col("sign") * F.col("n")).alias("n"))
    return boxes.join(total, [*keys, "component"], "left").withColumn("score", F.when(F.col("n") > 0, F.col("s") / F.col("n"))).drop("s", "n")
