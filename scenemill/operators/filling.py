"""Two things that are one sequence by definition, worked out in many tasks: Python's own shuffle, and filling the split that lacks most.

A shuffle exchanges place i with a drawn place j <= i, for i from the last down to 1. Places above i are never touched again, so what
ends at i is what stood at j before the exchange: the first number that an earlier exchange had brought there, and so on up. Those
hops are rows that are joined with themselves until each leads to its end. Only the generator's stream is walked in order, on the
driver, which keeps its state where each block of a million draws begins and no row.

A fill is cut into blocks in its order. Each is filled from a guess of what the splits hold before it. Where the block before ends
elsewhere, the guess is mended by what it ended at and by how the difference would run on if rows were endlessly small, and the
block is filled again, until every block starts where the one before it ended. Then all is as in one sequence; one more block
is certain after each round, and mostly all are after a few. The driver holds three numbers a block.
"""

from __future__ import annotations

import random
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .ranking import checkpointed, in_order

DRAWS = 1 << 20


def _drawn(draw: np.random.RandomState, top: int, draws: int) -> np.ndarray:
    """j of the exchanges at top, top - 1, ..., from one block of that many draws; `draw` then stands after the last one used.

    Python takes as many bits as i + 1 has until they make at most i, so a block ends where the bits become fewer.
    """
    bits = (top + 1).bit_length()
    want = top + 2 - (1 << (bits - 1))
    before = draw.get_state()
    r = (draw.randint(0, 1 << 32, min(draws, 2 * want + 64), np.uint32) >> np.uint32(32 - bits)).astype(np.int64)
    keep, was = r <= top, None
    while was is None or (keep != was).any():  # whether a draw is kept depends on how many were before it
        was = keep
        keep = r <= top - (np.cumsum(was) - was)
    at = np.flatnonzero(keep)[:want]
    if len(at) == want:
        draw.set_state(before)
        draw.randint(0, 1 << 32, int(at[-1]) + 1, np.uint32)
    return r[at]


def _blocks(n: int, seed: int, draws: int) -> Iterator[tuple[int, bytes, int]]:
    """First i, state and its place, of each block."""
    *key, place = random.Random(seed).getstate()[1]
    draw = np.random.RandomState()
    draw.set_state(("MT19937", np.array(key, np.uint32), place))
    top = n - 1
    while top > 0:
        _, now, place, *_ = draw.get_state()
        yield top, now.astype("<u4").tobytes(), int(place)
        top -= len(_drawn(draw, top, draws))


def shuffled_places(spark: SparkSession, n: int, seed: int, draws: int = DRAWS) -> DataFrame:
    """place, number: which of the numbers 0 to n - 1 stands at each place once `random.Random(seed).shuffle` has been over them."""
    if n >= 1 << 32:
        raise ValueError("a place is drawn from 32 bits at most")

    def exchanges(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        draw = np.random.RandomState()
        for pdf in parts:
            for top, state, place in zip(pdf["top"], pdf["state"], pdf["place"]):
                draw.set_state(("MT19937", np.frombuffer(state, "<u4"), place))
                j = _drawn(draw, int(top), draws)
                yield pd.DataFrame({"i": top - np.arange(len(j)), "j": j})

    blocks = spark.createDataFrame(list(_blocks(n, seed, draws)), "top long, state binary, place long").repartition("top")
    first = spark.range(min(n, 1)).select(F.col("id").alias("i"), F.col("id").alias("j"))
    steps = checkpointed(
        blocks.mapInPandas(exchanges, "i long, j long").unionByName(first)
        .withColumn("before", F.lead("i").over(Window.partitionBy("j").orderBy("i")))  # the exchange that brought a number to j; few a place
    )
    brought = steps.where("i > j").groupBy("j").agg(F.min("i").alias("to"))
    hops = steps.select("i").join(brought.withColumnRenamed("j", "i"), "i", "left").select("i", F.coalesce("to", "i").alias("to"))
    while True:
        ends = hops.select(F.col("i").alias("to"), F.col("to").alias("end"))
        longer = checkpointed(hops.join(ends, "to").select("i", F.col("end").alias("to"), (F.col("end") != F.col("to")).alias("moved")))
        hops = longer.select("i", "to")
        if longer.where("moved").isEmpty():
            break
    ends = hops.withColumnRenamed("i", "before")
    return steps.join(ends, "before", "left").select(F.col("i").alias("place"), F.coalesce("to", "j").alias("number"))


def _poured(held: Sequence[int], goals: Sequence[float], much: int) -> list[int]:
    """What is held after `much` more, if it always goes to the ones that lack most, in parts as small as may be."""
    lack = [g - h for g, h in zip(goals, held)]
    order = sorted(range(len(goals)), key=lambda s: -lack[s])
    for k in range(1, len(order) + 1):
        level = (sum(lack[s] for s in order[:k]) - much) / k
        if k == len(order) or level >= lack[order[k]]:
            break
    out = [h + int(max(0.0, x - level)) for h, x in zip(held, lack)]
    out[order[0]] += sum(held) + much - sum(out)
    return out


def greedy_fill(rows: DataFrame, weight: str, order: list, goals: dict[str, float], name: str) -> DataFrame:
    """rows with `name`: in their order, each goes to the one of `goals` that lacks most of its goal then, the first named among equals.

    weight: an integer column that is not null, of any size: a row may weigh more than a goal. The order must be one of all rows.
    """
    names, wanted = list(goals), list(goals.values())
    kept = in_order(rows, [], order)
    much = {r["_part"]: r["n"] for r in kept.groupBy("_part").agg(F.sum(weight).alias("n")).collect()}  # one row a partition
    parts = sorted(much)

    def fill(weights: Sequence[int], held: list[int]) -> list[int]:
        chosen = []
        for n in weights:
            lack = [w - h for w, h in zip(wanted, held)]
            s = lack.index(max(lack))
            held[s] += n
            chosen.append(s)
        return chosen

    def ends(starts: dict[int, list[int]]):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held: dict[int, list[int]] = {}
            for pdf in batches:
                for part, group in pdf.groupby("_part", sort=False):
                    fill(group[weight].tolist(), held.setdefault(part, list(starts[part])))
            if held:
                yield pd.DataFrame({"_part": list(held), "held": list(held.values())})

        return run

    def choices(starts: dict[int, list[int]]):
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held: dict[int, list[int]] = {}
            for pdf in batches:
                for part, group in pdf.groupby("_part", sort=False):
                    chosen = fill(group[weight].tolist(), held.setdefault(part, list(starts[part])))
                    yield group.assign(**{name: [names[s] for s in chosen]})

        return run

    starts, held = {}, [0] * len(names)
    for p in parts:
        starts[p], held = held, _poured(held, wanted, much[p])
    ended: dict[int, list[int]] = {}
    changed = parts
    while changed:
        found = kept.where(F.col("_part").isin(changed)).select("_part", weight).mapInPandas(ends({p: starts[p] for p in changed}), "_part int, held array<long>")
        ended.update({r["_part"]: list(r["held"]) for r in found.collect()})  # one row a partition
        now, changed = dict(starts), []
        for before, p in zip(parts, parts[1:]):
            moved = zip(ended[before], _poured(now[before], wanted, much[before]), _poured(starts[before], wanted, much[before]))
            now[p] = [e + a - b for e, a, b in moved]
            if now[p] != starts[p]:
                changed.append(p)
        starts = now
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema) + f", `{name}` string"
    return kept.mapInPandas(choices(starts), schema).drop("_part", "_at")
