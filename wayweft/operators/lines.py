"""Lines of one shape joined end to end across tasks: list ranking by pointer doubling."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import tables


def merged_lines(lines: DataFrame, name: str = "merge-lines") -> DataFrame:
    """lines(key, at, pts), at once a key: key, n and pts of each key's lines joined wherever exactly two of their ends meet.

    n numbers a key's results from 1: first those between ends and forks, by their least end, then closed ones, by their
    least corner; ends go by place, the angle at which they leave, and at. A result runs from that end, or the other way if
    most of its lines point so. Repeated points in a row count once; lines of one point, or without any, are left out.

    Each line is two darts, one for each way along it. A dart is followed by the one that leaves where it arrives, if just
    those two ends meet there. Darts learn the last one of their chain and how far it is by doubling, in rounds that grow
    with the logarithm of the longest chain and move numbers alone. Closed chains first learn their least dart in the same
    rounds and are cut there. Points move once, to the row of their result.
    """
    clean = F.filter("pts", lambda p, i: (i == 0) | (p != F.get("pts", i - 1)))
    lines = tables.materialise(lines.select("key", "at", clean.alias("pts")).where("size(pts) > 1").withColumn("line", F.monotonically_increasing_id()), name)
    angle = lambda a, b: F.pmod(F.atan2(b["lat"] - a["lat"], b["lon"] - a["lon"]), F.lit(2 * math.pi))
    leaving = lambda side, p, q: F.struct(F.lit(side).cast("long").alias("side"), p["lon"].alias("x"), p["lat"].alias("y"), angle(p, q).alias("angle"))
    pt = lambda i: F.element_at("pts", i)
    ends = lines.select("key", "at", "line", F.inline(F.array(leaving(0, pt(1), pt(2)), leaving(1, pt(-1), pt(-2)))))
    ends = ends.select("key", "x", "y", (F.col("line") * 2 + F.col("side")).alias("dart"), F.struct("x", "y", "angle", "at", (F.col("line") * 2 + F.col("side")).alias("dart")).alias("order"))
    places = ends.groupBy("key", "x", "y").agg(F.count(F.lit(1)).alias("degree"), F.min("dart").alias("one"), F.max("dart").alias("two"))
    met = F.when(F.col("degree") == 2, F.col("one") + F.col("two") - F.col("dart"))
    ends = tables.materialise(ends.join(places, ["key", "x", "y"]).select("key", "dart", "order", met.alias("met")), name + "-ends")
    arriving = ends.select(_back("dart").alias("dart"), F.col("met").alias("next"))
    darts = tables.materialise(ends.select("dart", "order").join(arriving, "dart"), name + "-darts")

    ranked = _ranked(darts, name)
    back = ranked.where("ended").select(_back("last").alias("head"), _back("dart").alias("dart"))
    # of a chain's two ways the one whose first dart is less; a chain's first dart is the last one of its way back, turned
    chains = ranked.where("ended").join(back, "dart").select("dart", "head", "last", "steps")
    chains = _lesser(chains, ends)
    rings = ranked.where("not ended").select("dart", "least")
    ways = rings.join(rings.select(_back("dart").alias("dart"), F.col("least").alias("other")), "dart").where("least < other").select("dart", F.col("least.dart").alias("head"))
    cut = tables.materialise(darts.join(ways, "dart").select("dart", "order", F.when(F.col("next") != F.col("head"), F.col("next")).alias("next"), "head"), name + "-rings")
    members = chains.withColumn("closed", F.lit(False))
    if not cut.isEmpty():
        around = _ranked(cut.select("dart", "order", "next"), name).join(cut.select("dart", "head"), "dart")
        members = members.unionByName(around.select("dart", "head", "steps", F.lit(True).alias("closed")))

    members = tables.materialise(members, name + "-members")
    heads = ends.join(members.where("dart = head").select("dart", "closed"), "dart").select("key", "closed", "order", F.col("dart").alias("head"))
    heads = heads.select("key", "head", F.row_number().over(Window.partitionBy("key").orderBy("closed", "order")).alias("n"))
    along = F.col("dart") % 2 == 0
    steps = members.select("head", "dart", F.floor(F.col("dart") / 2).alias("line"), (-F.col("steps")).alias("place")).join(lines.select("line", "pts"), "line")
    part = F.struct("place", F.when(along, F.col("pts")).otherwise(F.reverse("pts")).alias("pts"))
    whole = steps.groupBy("head").agg(F.array_sort(F.collect_list(part)).alias("parts"), F.sum(F.when(along, 1).otherwise(-1)).alias("forward"))
    run = F.concat(F.slice(F.get("parts", F.lit(0))["pts"], 1, 1), F.flatten(F.transform("parts", lambda s: F.slice(s["pts"], 2, F.size(s["pts"])))))
    return whole.join(heads, "head").select("key", "n", F.when(F.col("forward") >= 0, run).otherwise(F.reverse(run)).alias("pts"))


def _back(dart: str) -> Column:
    """The dart the other way along the same line."""
    return F.col(dart) + 1 - 2 * (F.col(dart) % 2)


def _lesser(chains: DataFrame, ends: DataFrame) -> DataFrame:
    """dart, head, steps of chains(dart, head, last, steps) whose first dart is less than the first of their way back."""
    ways = chains.where("dart = head").select("head", _back("last").alias("other"))
    orders = ends.select("dart", "order")
    kept = ways.join(orders.select(F.col("dart").alias("head"), F.col("order").alias("o1")), "head").join(orders.select(F.col("dart").alias("other"), F.col("order").alias("o2")), "other").where("o1 < o2").select("head")
    return chains.join(kept, "head", "left_semi").select("dart", "head", "steps")


def _ranked(darts: DataFrame, name: str) -> DataFrame:
    """darts(dart, order, next) with ended, last and steps: whether their chain ends, where, and after how many darts; and
    least, the least order met, which on a closed chain is that of the whole."""
    state = darts.select("dart", F.coalesce("next", "dart").alias("last"), F.when(F.col("next").isNull(), 0).otherwise(1).cast("long").alias("steps"), F.col("order").alias("least"), F.col("next").isNull().alias("ended"))
    state = tables.materialise(state, name + "-rank")
    while True:
        ahead = state.select(F.col("dart").alias("last"), F.col("last").alias("_last"), F.col("steps").alias("_steps"), F.col("least").alias("_least"), F.col("ended").alias("_ended"))
        met = state.where("not ended").join(ahead, "last")
        moved = met.select("dart", F.col("_last").alias("last"), (F.col("steps") + F.col("_steps")).alias("steps"), F.least("least", "_least").alias("least"), F.col("_ended").alias("ended"), (F.col("_ended") | (F.col("_least") < F.col("least"))).alias("new"))
        step = tables.materialise(moved, name + "-step")
        state = state.where("ended").unionByName(step.drop("new"))
        # a chain that has not met its end has darts that meet it in every round, and equal minima all around are the least
        if step.where("new").isEmpty():
            return tables.materialise(state, name + "-ranked")
        state = tables.materialise(state, name + "-rank")
