"""Sequences of varying length into containers of fixed capacity, by a grouping genetic algorithm.

A sequence longer than the capacity is cut: its full pieces are containers of
their own, only the rest is packed.  The items are spread over islands of bounded
size, each evolving a small population of packings in its own task:

* an individual is a set of bins (the group is the gene);
* crossover injects whole well-filled bins of one parent into the other, removes
  the bins that hold the same items a second time and best-fits the displaced
  items, largest first;
* mutation dissolves the emptiest bins;
* the fitness is the number of bins, then the mean squared fill.

After every epoch the well-filled bins of the best individual are kept for good;
the other bins migrate, as whole bins, to the islands of the next epoch, where
the union of what arrived is one elite individual of the first generation.  The
number of islands follows the number of items left, so no task ever holds more
than about twice ``island_items`` items, and every epoch is written to the shared
folder.

Defined results: null and empty sequences are left out; repeats of a
conversation count once; a capacity of null or below one gets no container.
"""

from __future__ import annotations

import random
from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.runtime import materialize

ISLAND_ITEMS = 1500
EPOCHS = 4
POPULATION = 6
GENERATIONS = 12
KEEP = 0.999  # a bin this full leaves the game before the last epoch

Bin = list[int]


def best_fit(items: list[int], size: list[int], capacity: int, bins: list[Bin]) -> list[Bin]:
    """Put ``items`` (given in order) into the tightest bin each, opening bins where none has room."""
    bins = [list(b) for b in bins]
    room = sorted((capacity - sum(size[i] for i in b), k) for k, b in enumerate(bins))
    for i in items:
        at = bisect_left(room, (size[i], -1))
        if at < len(room):
            left, k = room.pop(at)
            bins[k].append(i)
        else:
            left, k = capacity, len(bins)
            bins.append([i])
        if left - size[i] > 0:
            insort(room, (left - size[i], k))
    return bins


def _fill(b: Bin, size: list[int]) -> int:
    return sum(size[i] for i in b)


def _fitness(bins: list[Bin], size: list[int], capacity: int) -> tuple[int, float]:
    return len(bins), -sum((_fill(b, size) / capacity) ** 2 for b in bins) / max(len(bins), 1)


def _crossover(a: list[Bin], b: list[Bin], size: list[int], capacity: int, rng: random.Random) -> list[Bin]:
    best = sorted(b, key=lambda x: -_fill(x, size))
    gift = best[: max(1, rng.randint(len(best) // 4, max(1, 3 * len(best) // 4)))]
    taken = {i for x in gift for i in x}
    kept, displaced = [], []
    for x in a:
        if taken.isdisjoint(x):
            kept.append(x)
        else:
            displaced += [i for i in x if i not in taken]
    displaced.sort(key=lambda i: -size[i])
    return best_fit(displaced, size, capacity, gift + kept)


def _mutate(bins: list[Bin], size: list[int], capacity: int, rng: random.Random) -> list[Bin]:
    order = sorted(bins, key=lambda x: _fill(x, size))
    out = order[: max(1, min(len(order) // 10 + 1, rng.randint(1, 8)))]
    keep = order[len(out) :]
    loose = [i for x in out for i in x]
    rng.shuffle(loose)
    loose.sort(key=lambda i: -size[i] * rng.uniform(0.8, 1.0))
    return best_fit(loose, size, capacity, keep)


def evolve(size: list[int], capacity: int, elite: list[Bin] | None, seed: int, population: int = POPULATION, generations: int = GENERATIONS) -> list[Bin]:
    """The best packing one island finds; ``elite`` is a packing that migrated in."""
    rng = random.Random(seed)
    n = len(size)
    least = -(-sum(size) // capacity)
    order = sorted(range(n), key=lambda i: (-size[i], i))
    people = [best_fit(order, size, capacity, [])]
    if elite:
        people.append(elite)
    while len(people) < population:
        noisy = sorted(range(n), key=lambda i: -size[i] * rng.uniform(0.7, 1.0))
        people.append(best_fit(noisy, size, capacity, []))
    score = lambda p: _fitness(p, size, capacity)
    people.sort(key=score)
    for _ in range(generations):
        if len(people[0]) <= least:
            break
        children = []
        for _ in range(population):
            a, b = (min(rng.sample(people, 2), key=score) for _ in range(2))
            child = _crossover(a, b, size, capacity, rng)
            children.append(_mutate(child, size, capacity, rng) if rng.random() < 0.5 else child)
        people = sorted(people + children, key=score)[:population]
    return people[0]


def lengths(conversations: DataFrame) -> DataFrame:
    """``conv_id, length`` of every distinct conversation; only lengths are shuffled."""
    newest = (
        conversations.where(F.col("conv_id").isNotNull())
        .select("conv_id", F.struct("ingested_at", F.size("input_ids").alias("length")).alias("r"))
        .groupBy("conv_id").agg(F.max("r").alias("r"))
    )
    return newest.select("conv_id", F.col("r.length").alias("length")).where(F.col("length") > 0)


_ITEM = "limit_id int, capacity int, conv_id bigint, start int, length int, bin string"


def _epoch(items: DataFrame, epoch: int, last: bool, island_items: int) -> DataFrame:
    """One round of all islands: ``items`` with their (new) bin and whether it is kept."""

    def island(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["length", "conv_id", "start"], ascending=[False, True, True], ignore_index=True)
        capacity, here = int(frame["capacity"].iloc[0]), int(frame["island"].iloc[0])
        size = [int(x) for x in frame["length"]]
        elite: dict[str, Bin] = {}
        for i, b in enumerate(frame["bin"]):
            if b is not None and b == b:
                elite.setdefault(b, []).append(i)
        bins = evolve(size, capacity, list(elite.values()), seed=epoch * 1_000_003 + here)
        name, kept = [""] * len(size), [True] * len(size)
        for k, b in enumerate(bins):
            full = last or _fill(b, size) >= KEEP * capacity
            for i in b:
                name[i], kept[i] = f"{epoch}-{here}-{k}", full
        return frame.assign(bin=name, kept=kept).drop(columns=["island"])

    per = items.groupBy("limit_id").agg(F.count(F.lit(1)).alias("n")).collect()  # one row per limit
    if not per:
        return items.withColumn("kept", F.lit(True))
    count = F.element_at(F.create_map(*[x for r in per for x in (F.lit(r["limit_id"]), F.lit(-(-r["n"] // island_items)))]), F.col("limit_id"))
    # whole bins migrate together: an island is chosen by the bin, by the item where there is none yet
    mover = F.xxhash64(F.lit(epoch), F.coalesce("bin", F.concat_ws(":", "conv_id", "start")))
    spread = items.withColumn("island", F.pmod(mover, count).cast("bigint"))

    return spread.groupBy("limit_id", "island").applyInPandas(island, _ITEM + ", kept boolean")


def pack(conversations: DataFrame, limits: DataFrame, epochs: int = EPOCHS, island_items: int = ISLAND_ITEMS) -> DataFrame:
    """``limit_id, container, conv_id, start, length``."""
    each = limits.where(F.col("capacity") > 0).select("limit_id", "capacity").distinct().collect()  # the capacities asked for
    asked = F.array(*[F.struct(F.lit(r["limit_id"]).alias("limit_id"), F.lit(r["capacity"]).alias("capacity")) for r in each])
    if not each:
        return lengths(conversations).where(F.lit(False)).select(F.lit(0).alias("limit_id"), F.lit("").alias("container"), "conv_id", F.lit(0).alias("start"), "length")
    cut = lengths(conversations).select("conv_id", "length", F.inline(asked))
    pieces = cut.select(
        "limit_id", "capacity", "conv_id",
        F.explode(F.transform(F.sequence(F.lit(0), F.floor((F.col("length") - 1) / F.col("capacity")).cast("int")), lambda k: F.struct(
            (k * F.col("capacity")).alias("start"), F.least(F.col("length") - k * F.col("capacity"), F.col("capacity")).cast("int").alias("length")
        ))).alias("p"),
    ).select("limit_id", "capacity", "conv_id", "p.*", F.lit(None).cast("string").alias("bin"))
    pieces = materialize(pieces, "p3-items")
    full = pieces.where(F.col("length") == F.col("capacity")).withColumn("bin", F.concat_ws("-", F.lit("full"), "conv_id", "start"))
    done, left = [full], pieces.where(F.col("length") < F.col("capacity"))
    for e in range(epochs):
        out = materialize(_epoch(left, e, e == epochs - 1, island_items), f"p3-epoch{e}")
        done.append(out.where("kept").drop("kept"))
        left = out.where("not kept").drop("kept")
    result = done[0]
    for d in done[1:]:
        result = result.unionByName(d)
    return result.select("limit_id", F.col("bin").alias("container"), "conv_id", "start", "length")


def report(packed: DataFrame, limits: DataFrame) -> DataFrame:
    """``limit_id, n_containers, least_containers, fill``: what was used against the least possible."""
    per = packed.groupBy("limit_id").agg(F.count_distinct("container").alias("n_containers"), F.sum("length").alias("n_ids"))
    return per.join(F.broadcast(limits.select("limit_id", "capacity").distinct()), "limit_id").select(
        "limit_id", "n_containers", F.ceil(F.col("n_ids") / F.col("capacity")).alias("least_containers"),
        F.round(F.col("n_ids") / (F.col("n_containers") * F.col("capacity")), 6).alias("fill"),
    )
