"""Filling containers of one capacity with items, as fully as possible.

Items go to groups by hash, about GROUP_ITEMS each, so that no task gets more. A group is packed by bin completion:
around the largest item left, undominated fillings are enumerated (a filling is dominated if its items fit, as whole,
into the items of another) and tried from the fullest on; a branch ends when its containers have left more empty than
the wanted number allows. The wanted number starts at the lower bound and ends at that of best fit decreasing, the
incumbent, which stands if the search finds none in NODES steps. Containers that are not yet full enough then move, with
their items, to a next round with fewer groups, until one group holds them all or a round saves nothing.

Defined results: an item above the capacity is cut into full pieces and a rest, the only items ever cut; items of size
null, zero or less are not placed; ties go by id; repeated rows are one item; an empty table gives an empty result.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from math import ceil

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from narravig.sources.tables import cut

GROUP_ITEMS = 5000
#: Steps in enumerating one container's fillings, and of one search; after the latter the incumbent, best fit, stands.
STEPS, NODES = 400, 400_000
#: Share of the capacity from which a container is closed after a round.
CLOSED = 0.995


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Best fit decreasing; containers as lists of indexes. A container's room is found by bisection."""
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    rooms: list[tuple[int, int]] = []
    out: list[list[int]] = []
    for i in order:
        at = bisect_left(rooms, (sizes[i], -1))
        if at < len(rooms):
            room, k = rooms.pop(at)
            out[k].append(i)
        else:
            room, k = capacity, len(out)
            out.append([i])
        insort(rooms, (room - sizes[i], k))
    return out


def lower_bound(sizes: list[int], capacity: int) -> int:
    """Martello and Toth's L2 on integer sizes."""
    ordered = sorted(sizes)
    total = [0]
    for s in ordered:
        total.append(total[-1] + s)
    n, best = len(ordered), ceil(total[-1] / capacity)
    for k in sorted({s for s in ordered if 2 * s <= capacity} | {0}):
        a = bisect_right(ordered, capacity - k)
        b = bisect_right(ordered, capacity // 2)
        c = bisect_left(ordered, k)
        alone, middle = n - a, max(a - b, 0)
        small = total[b] - total[min(c, b)]
        room = middle * capacity - (total[a] - total[b]) if a > b else 0
        best = max(best, alone + middle + max(0, ceil((small - room) / capacity)))
    return best


def fits_inside(small: tuple[int, ...], large: tuple[int, ...]) -> bool:
    """Whether first fit puts the items of ``small`` (descending) into those of ``large`` as if these were containers.

    If so, ``large`` dominates. First fit may miss a way, which keeps a dominated filling and costs time only.
    """
    if sum(small) > sum(large):
        return False
    rooms = list(large)
    for item in small:
        at = next((j for j, room in enumerate(rooms) if room >= item), None)
        if at is None:
            return False
        rooms[at] -= item
    return True


def fillings(sizes: list[int], counts: list[int], room: int, slack: int, steps: int = STEPS) -> tuple[list[tuple[int, ...]], int]:
    """Undominated maximal fillings of ``room`` that leave at most ``slack`` of it empty, the fullest first, and the steps taken.

    ``sizes`` are distinct and ascending, ``counts`` how many of each are left. Items are chosen from large to small,
    so each filling comes up once. The enumeration ends with the first that leaves nothing empty, or after ``steps``.
    """
    chosen: list[int] = []
    found: dict[tuple[int, ...], int] = {}
    taken = 0
    at, left = bisect_right(sizes, room) - 1, room
    while True:
        taken += 1
        while at >= 0 and not counts[at]:
            at -= 1
        if at >= 0:
            # take the largest that fits, go on below
            counts[at] -= 1
            chosen.append(at)
            left -= sizes[at]
            at = min(at, bisect_right(sizes, left) - 1)
            continue
        if left <= slack and all(not n or s > left for s, n in zip(sizes[: bisect_right(sizes, left)], counts)):
            found[tuple(sizes[i] for i in chosen)] = left
            if not left:
                break
        if not chosen or taken >= steps:
            break
        # the last one is given back, the next smaller one tried
        at = chosen.pop()
        counts[at] += 1
        left += sizes[at]
        at -= 1
    for i in chosen:
        counts[i] += 1
    kept: list[tuple[int, ...]] = []
    for f in sorted(found, key=lambda f: (found[f], len(f))):
        if not any(fits_inside(f, g) for g in kept):
            kept.append(f)
    return kept, taken


def complete(sizes: list[int], capacity: int, most: int, nodes: int = NODES) -> tuple[list[tuple[list[int], int]] | None, int]:
    """A packing into at most ``most`` containers, as (sizes, steps of its fillings), and all steps; None if ``nodes`` steps found none.

    Each container is completed around the largest item left. What the containers may leave empty together is bound by
    ``most``; a branch that has left more is cut.
    """
    distinct = sorted(set(sizes))
    counts = [0] * len(distinct)
    for s in sizes:
        counts[bisect_left(distinct, s)] += 1
    slack, remaining, spent = most * capacity - sum(sizes), len(sizes), 0
    #: (filling with its largest item, its empty room, steps, the fillings still to try)
    stack: list[tuple[tuple[int, ...], int, int, list[tuple[int, ...]]]] = []

    def put(filling: tuple[int, ...], sign: int) -> None:
        nonlocal remaining
        for s in filling:
            counts[bisect_left(distinct, s)] -= sign
        remaining -= sign * len(filling)

    if slack < 0:
        return None, 0
    while remaining:
        top = next(i for i in reversed(range(len(counts))) if counts[i])
        counts[top] -= 1
        options, steps = fillings(distinct, counts, capacity - distinct[top], slack)
        counts[top] += 1
        spent += steps
        todo = [(distinct[top], *f) for f in reversed(options)]
        while not todo or spent > nodes:
            if not stack or spent > nodes:
                return None, spent
            last, empty, _, todo = stack.pop()
            put(last, -1)
            slack += empty
        best = todo.pop()
        empty = capacity - sum(best)
        put(best, 1)
        slack -= empty
        stack.append((best, empty, steps, todo))
    return [(list(f), steps) for f, _, steps, _ in stack], spent


def pack(sizes: list[int], capacity: int) -> tuple[list[tuple[list[int], int]], int]:
    """Containers as (indexes into ``sizes``, search steps; 0 if best fit made it), and all search steps.

    Every size is between 1 and the capacity. The search is asked for the lower bound, then for one container more at a
    time, up to the incumbent's number; the incumbent, best fit, stands only where the search ends without a packing.
    """
    incumbent = best_fit(sizes, capacity)
    spent = 0
    for most in range(lower_bound(sizes, capacity), len(incumbent) + 1):
        better, steps = complete(sizes, capacity, most)
        spent += steps
        if better is not None:
            by_size: dict[int, list[int]] = {}
            for i in reversed(range(len(sizes))):
                by_size.setdefault(sizes[i], []).append(i)
            return [([by_size[s].pop() for s in b], n) for b, n in better], spent
    return [(b, 0) for b in incumbent], spent


ITEM = "id long, piece long, size long"


def _packer(level: int, capacity: int):
    """The function that packs one group of items."""

    def one(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["size", "id", "piece"], ascending=[False, True, True], ignore_index=True)
        sizes, tag = group["size"].tolist(), group["tag"].iat[0]
        bins, _ = pack(sizes, capacity)
        out = [(i, f"{level}-{tag}-{k}", sum(sizes[j] for j in b), n) for k, (b, n) in enumerate(bins) for i in b]
        return group.drop(columns="tag").join(pd.DataFrame(out, columns=["i", "container", "fill", "nodes"]).set_index("i"))

    return one


def containers(sized: DataFrame, key: str, size: str, capacity: int, group_items: int = GROUP_ITEMS) -> DataFrame:
    """id, piece, size, container (text key), nodes (search steps of the container's filling) for every item."""
    sized = sized.select(F.col(key).cast("long").alias("id"), F.col(size).cast("long").alias("size")).where("size > 0").distinct()
    count = F.ceil(F.col("size") / F.lit(capacity)).cast("long")
    items = sized.select("id", F.explode(F.sequence(F.lit(0).cast("long"), count - 1)).alias("piece"), F.col("size").alias("whole"))
    items = cut(
        items.select("id", "piece", F.least(F.lit(capacity).cast("long"), F.col("whole") - F.col("piece") * capacity).alias("size"))
    )
    full = items.where(F.col("size") == capacity).select("*", F.concat(F.lit("full-"), "id", F.lit("-"), "piece").alias("container"), F.lit(0).cast("long").alias("nodes"))
    left, done, level = items.where(F.col("size") < capacity), [full], 0
    before = None
    while (n := left.count()) > 0:
        groups = max(1, round(n / group_items))
        tag = F.pmod(F.xxhash64("id", "piece", F.lit(level)), F.lit(groups)).cast("long")

        packed = cut(
            left.withColumn("tag", tag).groupBy("tag").applyInPandas(_packer(level, capacity), f"{ITEM}, container string, fill long, nodes long")
        )
        last = groups == 1 or before is not None and groups >= before
        closed = packed if last else packed.where(F.col("fill") >= CLOSED * capacity)
        done.append(closed.select("id", "piece", "size", "container", "nodes"))
        if last:
            break
        left = packed.where(F.col("fill") < CLOSED * capacity).select("id", "piece", "size")
        before, level = groups, level + 1
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out
