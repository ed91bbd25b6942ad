"""Best-fit packing of token pieces into sequences, by a grouping genetic algorithm on islands.

A document's ids are cut into pieces of at most the sequence length; full pieces are sequences of their own.
The other pieces are dealt evenly to problems of a bounded number of pieces. Each problem is evolved on several
islands, each a task of its own with its own population: crossover injects whole well-filled bins of one parent
into another, removes the bins that hold duplicates, lets the remaining poor bins trade pieces with the displaced ones
where that fills them better, and best-fits what is still displaced. Fitness is the number of bins, then how unevenly
they are filled, so that what room there is gathers in few bins. After each epoch every island's elite migrates to its
neighbour, and the best elite of a problem decides. Bins with room are then opened, and their pieces form the problems
of the next, smaller level, until one problem is left, no bin can be saved any more, or LEVELS are done.

A problem ends at once where the plain best fit by decreasing length is ideal: no fewer bins are possible, and all but
one are exactly full.

Every step is deterministic: random choices are seeded by level, problem, island and epoch.

Results: one row per piece. A null text counts as empty and gives one piece, of the closing id alone. Null and
repeated ids are packed as rows of their own; an empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

import math
import random
import zlib
from bisect import bisect_left, insort
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import frames, scratch, word_tokens

CAPACITY, CLOSING_ID = 4096, 1
#: Pieces of a problem, islands, epochs between migrations, generations in an epoch, solutions on an island.
PROBLEM, ISLANDS, EPOCHS, GENERATIONS, POPULATION = 1500, 2, 2, 4, 6
#: A bin with no more room than this share is left alone by later levels; levels at most.
ROOM, LEVELS = 0.001, 4

Bins = list[list[int]]


def best_fit(items: list[int], lengths: list[int], capacity: int, bins: Bins | None = None) -> Bins:
    """Each item, in turn, goes to the fullest bin that still has room."""
    bins = bins if bins is not None else []
    room = sorted((capacity - sum(lengths[i] for i in b), n) for n, b in enumerate(bins))
    for item in items:
        at = bisect_left(room, (lengths[item], -1))
        if at < len(room):
            left, n = room.pop(at)
        else:
            left, n = capacity, len(bins)
            bins.append([])
        bins[n].append(item)
        if left > lengths[item]:
            insort(room, (left - lengths[item], n))
    return bins


def fitness(bins: Bins, lengths: list[int], capacity: int) -> tuple[int, float]:
    """Fewer bins first, then the more uneven filling, which leaves room in one place."""
    return -len(bins), sum((sum(lengths[i] for i in b) / capacity) ** 2 for b in bins)


def ideal(lengths: list[int], capacity: int) -> tuple[int, float]:
    """The fitness of bins that are all full but for one."""
    full, rest = divmod(sum(lengths), capacity)
    return -(full + (rest > 0)), full + (rest / capacity) ** 2


def trade(bin_: list[int], room: int, loose: list[tuple[int, int]], lengths: list[int]) -> None:
    """One or two items of the bin, which has this room, for one loose item (length, item) that fills it better, while
    there is one."""
    while room:
        best, gain = None, 0
        single = [(lengths[i], (i,)) for i in bin_]
        double = [(a + b, x + y) for n, (a, x) in enumerate(single) for b, y in single[n + 1 :]] if len(bin_) < 8 else []
        for out, items in single + double:
            place = bisect_left(loose, (out + room + 1, -1)) - 1
            if place >= 0 and loose[place][0] - out > gain:
                best, gain = (items, place), loose[place][0] - out
                if gain == room:
                    break
        if best is None:
            return
        items, place = best
        _, item = loose.pop(place)
        for x in items:
            bin_.remove(x)
            insort(loose, (lengths[x], x))
        bin_.append(item)
        room -= gain


def crossover(mine: Bins, theirs: Bins, lengths: list[int], capacity: int, r: random.Random) -> Bins:
    """theirs' well-filled bins, whole, into mine; what they displace trades places with what fills poor bins better,
    and the rest is best-fitted, largest first."""
    fills = [sum([lengths[i] for i in b]) for b in theirs]
    good = [b for b, f in zip(theirs, fills) if f == capacity]
    if not good:
        least = sorted(fills)[len(fills) * 2 // 3]
        good = [b for b, f in zip(theirs, fills) if f >= least]
    injected = r.sample(good, max(1, len(good) // 2))
    taken = {i for b in injected for i in b}
    kept, poor, displaced = [], [], []
    for b in mine:
        if not taken.isdisjoint(b):
            displaced += [i for i in b if i not in taken]
            continue
        room = capacity - sum([lengths[i] for i in b])
        if room and r.random() < 0.3:  # a poor bin is opened, too
            displaced += b
        elif room:
            poor.append((list(b), room))
        else:
            kept.append(b)
    loose = sorted((lengths[i], i) for i in displaced)
    for b, room in poor:
        trade(b, room, loose, lengths)
    return best_fit([i for _, i in reversed(loose)], lengths, capacity, [list(b) for b in injected + kept] + [b for b, _ in poor])


@dataclass
class Island:
    """What an island found: the best packing, the plain best fit's bins, and how many children were born and stayed."""

    bins: Bins
    plain: int
    children: int = 0
    stayed: int = 0


def evolve(lengths: list[int], capacity: int, seed: int, generations: int = GENERATIONS, population: int = POPULATION, immigrants: list[Bins] = ()) -> Island:
    r = random.Random(seed)
    order = sorted(range(len(lengths)), key=lambda i: (-lengths[i], i))
    plain, goal = best_fit(order, lengths, capacity), ideal(lengths, capacity)
    found = Island(plain, len(plain))
    score = lambda x: fitness(x, lengths, capacity)
    solutions = sorted(((score(x), x) for x in (plain, *([list(b) for b in x] for x in immigrants))), key=lambda x: x[0], reverse=True)
    if solutions[0][0] >= goal:
        found.bins = solutions[0][1]
        return found
    while len(solutions) < population:
        # from nearly by length to any order
        spread = (0.1, 0.4, 1.0)[len(solutions) % 3]
        loose = sorted(order, key=lambda i: -lengths[i] * r.uniform(1 - spread, 1 + spread))
        one = best_fit(loose, lengths, capacity)
        solutions.append((score(one), one))
    solutions.sort(key=lambda x: x[0], reverse=True)
    for _ in range(generations * population):
        if solutions[0][0] >= goal:
            break
        # the better of two for each parent
        one, two = (min(r.sample(range(len(solutions)), 2)) for _ in range(2))
        if one == two:
            two = (one + 1) % len(solutions)
        child = crossover(solutions[one][1], solutions[two][1], lengths, capacity, r)
        found.children += 1
        new = score(child)
        if new > solutions[-1][0] and all(new != x for x, _ in solutions):
            found.stayed += 1
            solutions[-1] = new, child
            solutions.sort(key=lambda x: x[0], reverse=True)
    found.bins = solutions[0][1]
    return found


def _encode(shared, capacity: int):
    schema = ["doc_id", "piece", "start", "length", "ids_crc32"]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
    closing = np.array([CLOSING_ID], dtype="<u4").tobytes()

    def run(batches):
        tokens = shared.value.get()
        for batch in frames.parts(batches):
            rows = []
            names, texts = batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()
            ids, bounds = tokens.encode([t or b"" for t in texts])
            data = ids.tobytes()
            for doc_id, first, last in zip(names, bounds[:-1].tolist(), bounds[1:].tolist()):
                own = data[4 * first : 4 * last] + closing
                for piece, at in enumerate(range(0, len(own), 4 * capacity)):
                    part = own[at : at + 4 * capacity]
                    rows.append((doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part)))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)] if rows else [pa.array([], k) for k in kinds], names=schema)

    return run


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """The pieces of each document by the vocabulary in path, with the closing id at its end."""
    return frames.documents(docs).mapInArrow(_encode(frames.kept(docs.sparkSession, word_tokens.WordTokens, path), capacity), PIECES)


def _solution(table: pd.DataFrame, found: Island, capacity: int, problem: int, island: int) -> pd.DataFrame:
    where = np.empty(len(table), dtype=np.int64)
    for n, b in enumerate(found.bins):
        where[b] = n
    table["bin"], table["problem"], table["island"] = where, problem, island
    table["fewer"], table["uneven"] = fitness(found.bins, table["length"].tolist(), capacity)
    table["plain"], table["children"], table["stayed"] = found.plain, found.children, found.stayed
    return table


def _epoch(level: int, epoch: int, capacity: int):
    def run(key, table):
        """The island's own elite (home) and its neighbour's, if there are any yet, over the same pieces."""
        problem, island = key
        table = table.sort_values(["home", "doc_id", "piece", "no"], ignore_index=True)
        elites = []
        for _, part in table.groupby("home", sort=True):
            bins: dict[int, list[int]] = {}
            for i, b in enumerate(part["bin"].tolist()):
                bins.setdefault(b, []).append(i)
            elites.append(list(bins.values()))
        one = table[table["home"] == table["home"].iloc[0]].drop(columns="home").reset_index(drop=True)
        found = evolve(one["length"].tolist(), capacity, zlib.crc32(repr((level, problem, island, epoch)).encode()), immigrants=elites if epoch else ())
        return _solution(one, found, capacity, problem, island)

    return run


_SOLVED = PIECES + ", no long, problem int, island int, bin long, fewer long, uneven double, plain long, children long, stayed long"


def _solve(items: DataFrame, n: int, level: int, capacity: int, name: str) -> DataFrame:
    """items(PIECES, no) with problem and bin, best of all islands, and how that was found; n pieces."""
    problems = max(1, math.ceil(n / PROBLEM))
    dealt = items.withColumn("problem", F.pmod(F.xxhash64("no", F.lit(level)), F.lit(problems)).cast("int"))
    solved = dealt.withColumn("island", F.explode(F.array(*[F.lit(i) for i in range(ISLANDS)]))).withColumn("bin", F.lit(0).cast("long"))
    own = [*items.columns, "problem", "island", "bin"]
    for epoch in range(EPOCHS):
        arrived = solved.select(*own, F.col("island").alias("home"))
        if epoch:
            arrived = arrived.union(arrived.withColumn("island", F.pmod(F.col("island") + 1, F.lit(ISLANDS)).cast("int")))
        solved = scratch.materialise(arrived.groupBy("problem", "island").applyInPandas(_epoch(level, epoch, capacity), _SOLVED), f"{name}-epoch")
    best = solved.groupBy("problem").agg(F.max(F.struct("fewer", "uneven", (-F.col("island")).alias("island"))).alias("best"))
    return solved.join(best.select("problem", (-F.col("best.island")).alias("island")), ["problem", "island"]).select(*items.columns, "problem", "bin", "plain", "fewer", "children", "stayed")


def pack(table: DataFrame, capacity: int = CAPACITY, name: str = "pack", report: list | None = None) -> DataFrame:
    """table(PIECES) with sequence_id and offset; every length is between 1 and capacity. report, if given, receives
    for each level the pieces, problems, bins by plain best fit, bins found, and children born and kept in the last
    epoch of the islands that decided."""
    items = scratch.materialise(table.withColumn("no", F.monotonically_increasing_id()), f"{name}-pieces")
    done = [items.where(F.col("length") >= capacity).select(*items.columns, F.concat(F.lit("f-"), F.col("no")).alias("sequence"))]
    rest = items.where(F.col("length") < capacity)
    for level in range(LEVELS):
        n = rest.count()
        if not n:
            break
        solved = scratch.materialise(_solve(rest, n, level, capacity, name), f"{name}-solved")
        if report is not None:
            each = solved.groupBy("problem").agg(*[F.first(c).alias(c) for c in ("plain", "fewer", "children", "stayed")])
            report.append((n, *each.agg(F.count(F.lit(1)), F.sum("plain"), -F.sum("fewer"), F.sum("children"), F.sum("stayed")).first()))
        fills = solved.groupBy("problem", "bin").agg(F.sum("length").alias("fill"))
        poor = fills.where(F.col("fill") < (1 - ROOM) * capacity)
        bins, filled = poor.agg(F.count(F.lit(1)), F.sum("fill")).first()
        named = solved.withColumn("sequence", F.concat_ws("-", F.lit(level), "problem", "bin"))
        if n <= PROBLEM or level == LEVELS - 1 or bins <= math.ceil((filled or 0) / capacity):
            done.append(named.select(*items.columns, "sequence"))
            break
        done.append(named.join(poor.select("problem", "bin"), ["problem", "bin"], "left_anti").select(*items.columns, "sequence"))
        rest = solved.join(poor.select("problem", "bin"), ["problem", "bin"], "left_semi").select(*items.columns)
    out = done[0]
    for x in done[1:]:
        out = out.union(x)
    # a bin holds at most `capacity` pieces, so a sequence's rows are few; its smallest number names it
    before = Window.partitionBy("sequence").orderBy(F.desc("length"), "no").rowsBetween(Window.unboundedPreceding, -1)
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", F.min("no").over(Window.partitionBy("sequence")).alias("sequence_id"), F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long").alias("offset"))
