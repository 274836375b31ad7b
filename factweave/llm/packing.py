"""Problem 7: containers of fixed capacity filled with documents, by linear grouping.

The plan is made on the histogram of sizes, which has at most as many entries as the capacity, and is written down in runs: so
many documents of one size, from this rank on, go to containers of consecutive numbers. Large sizes are rounded up within groups
of equal cardinality; configurations of the few rounded sizes are optimised by a knapsack over the counts that are left; the
actual documents take the places of the rounded ones, and small ones go where they fit best.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import defaultdict

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factweave.llm.tokens import TOKENIZER, place_by_rank, with_tokens
from factweave.session import cut_lineage, small_rows

#: Share of the capacity from which on a size is planned by configurations, and the number of groups.
LARGE, GROUPS = 0.08, 400

Run = tuple[int, int, int, int]


def _best_configuration(sizes: list[int], left: list[int], capacity: int) -> list[int]:
    """How many of each size to put together: the largest that is left, and with it what leaves as little as possible free, by a bounded
    knapsack over the counts that are left. Taking the largest first keeps none of them for the end, when nothing fits beside it."""
    largest = next(i for i, n in enumerate(left) if n)
    capacity -= sizes[largest]
    reach = np.zeros(capacity + 1, dtype=bool)
    reach[0] = True
    layers = []
    for i, (size, n) in enumerate(zip(sizes, left, strict=True)):
        layers.append(reach)
        if reach[capacity]:
            continue
        for _ in range(min(n - (i == largest), capacity // size)):
            moved = np.zeros_like(reach)
            moved[size:] = reach[: capacity + 1 - size]
            grown = reach | moved
            if (grown == reach).all():
                break
            reach = grown
    at = int(np.flatnonzero(reach)[-1])
    taken = [0] * len(sizes)
    for i in range(len(sizes) - 1, -1, -1):
        while not layers[i][at]:
            at -= sizes[i]
            taken[i] += 1
    taken[largest] += 1
    return taken


def plan_containers(histogram: dict[int, int], capacity: int) -> tuple[list[Run], int]:
    """(size, first rank, end rank, first container) runs and the number of containers; every document is placed once.

    Sizes must lie in 1..capacity. Work and memory follow the number of distinct sizes, not the number of documents.
    """
    runs: list[Run] = []
    bound = max(1, int(LARGE * capacity))
    large = sorted((s for s in histogram if s > bound), reverse=True)
    total = sum(histogram[s] for s in large)
    per_group = max(1, -(-total // GROUPS))
    # groups: lists of (size, first rank within the size, count), rounded up to their largest size
    groups: list[list[list[int]]] = []
    room = 0
    for size in large:
        rank, left = 0, histogram[size]
        while left:
            if room == 0:
                groups.append([])
                room = per_group
            n = min(room, left)
            groups[-1].append([size, rank, n])
            rank, left, room = rank + n, left - n, room - n
    sizes = [g[0][0] for g in groups]
    left = [sum(n for _, _, n in g) for g in groups]
    next_container = 0
    free: dict[int, list[tuple[int, int]]] = defaultdict(list)

    def give_back(first: int, end: int, space: int) -> None:
        if end > first and space > 0:
            free[space].append((first, end))

    def take(group: int, n: int) -> list[tuple[int, int, int]]:
        """The next n documents of a group, as (size, first rank, count)."""
        out = []
        while n:
            size, rank, have = groups[group][0]
            use = min(have, n)
            out.append((size, rank, use))
            if use == have:
                groups[group].pop(0)
            else:
                groups[group][0] = [size, rank + use, have - use]
            n -= use
        return out

    while any(left):
        configuration = _best_configuration(sizes, left, capacity)
        times = min(left[i] // c for i, c in enumerate(configuration) if c)
        cuts = {0, times}
        slots = []
        for i, c in enumerate(configuration):
            for _ in range(c):
                at = 0
                slot = []
                for size, rank, n in take(i, times):
                    runs.append((size, rank, rank + n, next_container + at))
                    slot.append((at, size))
                    at += n
                    cuts.add(at)
                slots.append(slot)
            left[i] -= c * times
        marks = sorted(cuts)
        for a, b in zip(marks, marks[1:], strict=False):
            used = sum(slot[bisect_left(slot, (a + 1,)) - 1][1] for slot in slots)
            give_back(next_container + a, next_container + b, capacity - used)
        next_container += times

    spaces = sorted(free)
    for size in sorted((s for s in histogram if s <= bound), reverse=True):
        rank, count = 0, histogram[size]
        while count:
            i = bisect_left(spaces, size)
            if i == len(spaces):
                fresh = -(-count // (capacity // size))
                free[capacity].append((next_container, next_container + fresh))
                next_container += fresh
                insort(spaces, capacity)
                continue
            space = spaces[i]
            first, end = free[space].pop()
            if not free[space]:
                del free[space]
                spaces.pop(i)
            n = min(count, end - first)
            runs.append((size, rank, rank + n, first))
            for a, b, rest in ((first, first + n, space - size), (first + n, end, space)):
                if b > a and rest > 0:
                    if rest not in free:
                        insort(spaces, rest)
                    free[rest].append((a, b))
            rank, count = rank + n, count - n
    return runs, next_container


def pack_documents(documents: DataFrame, limits: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER) -> DataFrame:
    """One row per document or piece and kind of container: container_kind, container, id, piece, token_begin, token_end, tokens.

    A document is cut only if it is larger than a container: into pieces of the capacity and a rest. Documents without tokens
    (null, empty) go to no container. Repeated ids are documents of their own only if the table holds them twice; each row is
    placed once. limits: container_kind, capacity_tokens, a small fixed table; capacities below 1 give no container. The driver
    sees the histogram of sizes, at most one entry per size up to the capacity; documents meet the plan by rank, in the shuffle that
    ranks them, and the plan is not broadcast.
    """
    # texts are encoded once; what is kept for all kinds of containers is an id and a number
    sized = cut_lineage(with_tokens(documents.select(F.col(id_col).alias("id_"), F.col(text_col).alias("text_")), "text_", tokenizer).select("id_", "tokens").where("tokens > 0"))
    out = None
    for limit in sorted(small_rows(limits.where("capacity_tokens >= 1").select("container_kind", "capacity_tokens").distinct()), key=lambda r: (r.container_kind, r.capacity_tokens)):
        capacity = limit.capacity_tokens
        begins = F.sequence(F.lit(0), F.col("tokens") - 1, F.lit(capacity))
        items = sized.select("id_", "tokens", F.posexplode(begins).alias("piece", "token_begin")).select(
            "id_", "piece", "token_begin", F.least(F.col("token_begin") + capacity, F.col("tokens")).alias("token_end")
        ).withColumn("size", (F.col("token_end") - F.col("token_begin")).cast("int"))
        histogram = {r["size"]: r["n"] for r in small_rows(items.groupBy("size").agg(F.count("*").alias("n")), capacity)}
        runs, _ = plan_containers(histogram, capacity)
        plan = documents.sparkSession.createDataFrame(runs, "size int, first_rank bigint, end_rank bigint, first_container bigint")
        placed = place_by_rank(items, ["size"], ["id_", "piece"], plan).select(
            F.lit(limit.container_kind).alias("container_kind"),
            (F.col("first_container") + F.col("rank_") - F.col("first_rank")).alias("container"),
            F.col("id_").alias(id_col),
            "piece",
            "token_begin",
            "token_end",
            F.col("size").alias("tokens"),
        )
        out = placed if out is None else out.unionByName(placed)
    if out is None:
        id_type = documents.schema[id_col].dataType.simpleString()
        return documents.sparkSession.createDataFrame([], f"container_kind string, container bigint, `{id_col}` {id_type}, piece int, token_begin int, token_end int, tokens int")
    return out
