"""Documents into containers of fixed capacity, of near equal cost and as few as can be.

Sizes are whole numbers up to the capacity, so the driver plans over the histogram of sizes, never over documents: it
assigns the sizes in descending order, each time to the containers of lowest cost (linear plus quadratic in the sizes
of what they hold) that have room. Their number is fixed before: as many as best fit takes. Near the end lowest cost
leaves many small rooms that nothing fits, so the sizes below a limit go where they leave the least room; the limit is
the lowest with which all documents find room (see README for the share that is assigned by cost). Containers that hold
the same sizes are one class with a count, so the plan's size goes with the number of distinct sizes. It is carried out
by ranking the documents of a size, in salted parts, and joining ranks with the plan's intervals.
"""

from __future__ import annotations

import bisect
import heapq
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spandrel.llm.tokens import TOKENIZERS, measured
from spandrel.tables import settle

#: Parts in which the documents of each size are ranked, so that no size is a task's alone.
SALTS = 64
#: Ranks of one size that are joined with the plan at once.
BLOCK = 4096
#: Weight of the quadratic part of the cost: attention over n tokens costs n + n * n / ATTENTION.
ATTENTION = 4096.0


def cost(size: int) -> float:
    return size + size * size / ATTENTION


class Plan:
    """Intervals of ranks of a size that go to an interval of containers, ``per`` in each, from ``place`` on."""

    def __init__(self) -> None:
        self.rows: list[tuple[int, int, int, int, int, int]] = []  # size, from rank, to rank, container, per, place
        self.containers = 0
        self.by_cost = 0  # tokens that were assigned by cost


#: A class of containers: (cost, first container, count, room, items so far). The first container makes it unique.
Class = tuple[float, int, int, int, int]


class _Tight:
    """Classes by room, for best fit: each item goes where the least room is left."""

    def __init__(self, classes: list[Class]) -> None:
        self.by_room: dict[int, list[Class]] = {}
        self.rooms: list[int] = []
        for x in classes:
            self.add(x)

    def add(self, x: Class) -> None:
        if x[3] not in self.by_room:
            self.by_room[x[3]] = []
            bisect.insort(self.rooms, x[3])
        self.by_room[x[3]].append(x)

    def take(self, size: int, left: int) -> Class | None:
        """The containers with the least room for ``size``, no more of them than ``left`` items fill."""
        at = bisect.bisect_left(self.rooms, size)
        if at == len(self.rooms):
            return None
        room = self.rooms[at]
        x = self.by_room[room].pop()
        if not self.by_room[room]:
            del self.by_room[room], self.rooms[at]
        now, first, count, room, items = x
        boxes = min(count, -(-left // (room // size)))
        if boxes < count:
            self.add((now, first + boxes, count - boxes, room, items))
        return now, first, boxes, room, items

    def all(self) -> list[Class]:
        return [x for xs in self.by_room.values() for x in xs]


def _assign(plan: Plan, x: Class, size: int, rank: int, left: int, back: Callable[[Class], None]) -> int:
    """One item of ``size`` to each container of the class, as far as they go; ``back`` gets what becomes of the class."""
    now, first, count, room, items = x
    take = min(count, left)
    plan.rows.append((size, rank, rank + take, first, 1, items))
    back((now + cost(size), first, take, room - size, items + 1))
    if take < count:
        back((now, first + take, count - take, room, items))
    return take


def best_fit(sizes: dict[int, int], capacity: int) -> int:
    """The number of containers that best fit in descending order takes."""
    tight, used, plan = _Tight([]), 0, Plan()
    for size in sorted((s for s in sizes if s > 0), reverse=True):
        left = sizes[size]
        while left:
            if (x := tight.take(size, left)) is None:
                new = -(-left // (capacity // size))
                x = (0.0, used, new, capacity, 0)
                used += new
            left -= _assign(plan, x, size, 0, left, tight.add)
            plan.rows.clear()
    return max(used, 1)


def balanced(sizes: dict[int, int], capacity: int, containers: int, tight_below: int) -> Plan | None:
    """A plan of ``containers`` for the histogram ``sizes``, None where descending sizes don't all find room.

    Sizes of ``tight_below`` and more go to the classes of lowest cost with room; a class without room waits until sizes
    are small enough. Smaller ones go where they leave the least room.
    """
    plan = Plan()
    plan.containers = containers
    ready: list[Class] = [(0.0, 0, containers, capacity, 0)]
    waiting: dict[int, list[Class]] = {}
    rooms: list[int] = []  # of waiting classes, as a max-heap
    tight: _Tight | None = None
    for size in sorted((s for s in sizes if s > 0), reverse=True):
        rank, left = 0, sizes[size]
        if size < tight_below:
            tight = tight or _Tight([*ready, *(x for xs in waiting.values() for x in xs)])
            while left:
                if (x := tight.take(size, left)) is None:
                    return None
                n = _assign(plan, x, size, rank, left, tight.add)
                rank, left = rank + n, left - n
            continue
        while rooms and -rooms[0] >= size:
            for kept in waiting.pop(-heapq.heappop(rooms)):
                heapq.heappush(ready, kept)
        while left:
            if not ready:
                return None
            x = heapq.heappop(ready)
            if x[3] < size:
                if x[3] not in waiting:
                    waiting[x[3]] = []
                    heapq.heappush(rooms, -x[3])
                waiting[x[3]].append(x)
                continue
            n = _assign(plan, x, size, rank, left, lambda y: heapq.heappush(ready, y))
            rank, left = rank + n, left - n
            plan.by_cost += n * size
    if n := sizes.get(0, 0):  # they take no room and cost nothing: spread evenly
        classes = sorted(tight.all() if tight else [*ready, *(x for xs in waiting.values() for x in xs)], key=lambda x: x[1])
        per, rank = -(-n // containers), 0
        for _, first, count, _, items in classes:
            take = min(n - rank, per * count)
            if take:
                plan.rows.append((0, rank, rank + take, first, per, items))
            rank += take
    return plan


def planned(sizes: dict[int, int], capacity: int, slack: float = 0.0) -> Plan:
    """The plan of as few containers as best fit takes, and ``slack`` times that more, with as many sizes assigned by
    cost as that allows: the limit below which they aren't is searched by halving."""
    containers = int(best_fit(sizes, capacity) * (1 + slack))
    limits = [0, *sorted(s for s in sizes if s > 0), capacity + 1]
    low, high = -1, len(limits) - 1
    best = balanced(sizes, capacity, containers, limits[high])  # best fit alone, which always goes
    while high - low > 1:
        middle = (low + high) // 2 if low >= 0 else 0
        if plan := balanced(sizes, capacity, containers, limits[middle]):
            best, high = plan, middle
        else:
            low = middle
    assert best is not None
    return best


def _ranked(pieces: DataFrame, salts: int) -> DataFrame:
    """``pieces`` with their ``rank`` among those of their size, from 0: by salt, then by document."""
    size = ["pack_name", "n_tokens"]
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)))
    within = F.row_number().over(W.partitionBy(*size, "salt").orderBy("doc_id", "piece")).cast("bigint") - 1
    counts = salted.groupBy(*size, "salt").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy(*size).orderBy("salt").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select(*size, "salt", before.alias("before"))
    return salted.withColumn("within", within).join(starts, [*size, "salt"]).withColumn("rank", F.col("within") + F.col("before"))


def packed(documents: DataFrame, specs: Iterable[tuple[str, str, int]], home: str = TOKENIZERS, salts: int = SALTS, slack: float = 0.0) -> DataFrame:
    """(pack_name, doc_id, piece, start, n_tokens, container, place) of every piece of every document, for each spec.

    A spec is (pack_name, tokenizer, capacity). A document larger than the capacity is split into full pieces and a rest;
    no other is. ``start`` is the piece's first token in its document, ``container`` counts from 0 in each pack, ``place``
    from 0 in each container. Null and empty texts have size 0 and a place too. doc_id is unique.
    """
    spark: SparkSession = documents.sparkSession
    specs = list(specs)
    names = tuple(sorted({t for _, t, _ in specs}))
    sizes = settle(measured(documents, names, home))
    options = F.array(*(F.struct(F.lit(p).alias("pack_name"), F.col(t).alias("tokens"), F.lit(c).cast("bigint").alias("capacity")) for p, t, c in specs))
    last = F.greatest(F.expr("tokens - 1"), F.lit(0)).cast("bigint")
    pieces = (
        sizes.select("doc_id", F.inline(options))
        .select("pack_name", "doc_id", "tokens", "capacity", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor(last / F.col("capacity")))).alias("piece"))
        .select("pack_name", "doc_id", "piece", (F.col("piece") * F.col("capacity")).alias("start"), F.expr("least(capacity, tokens - piece * capacity)").alias("n_tokens"))
    )
    # One count for each size up to the capacity.
    by_pack: dict[str, dict[int, int]] = {p: {} for p, _, _ in specs}
    for r in pieces.groupBy("pack_name", "n_tokens").count().collect():
        by_pack[r.pack_name][r.n_tokens] = r["count"]
    rows = [(pack, *row) for pack, _, capacity in specs if by_pack[pack] for row in planned(by_pack[pack], capacity, slack).rows]
    plan = spark.createDataFrame(rows, "pack_name string, n_tokens bigint, low bigint, high bigint, first bigint, per bigint, items bigint")
    blocks = plan.withColumn("block", F.explode(F.sequence(F.floor(F.col("low") / BLOCK), F.floor((F.col("high") - 1) / BLOCK))))
    ranked = _ranked(pieces, salts)
    placed = ranked.withColumn("block", F.floor(F.col("rank") / BLOCK)).join(blocks, ["pack_name", "n_tokens", "block"]).where("rank >= low and rank < high")
    return placed.select("pack_name", "doc_id", "piece", "start", "n_tokens", F.expr("first + (rank - low) div per").alias("container"), F.expr("items + (rank - low) % per").alias("place"))

