"""Filling containers of fixed capacity with whole documents.

The histogram of item sizes is global and has at most ``capacity`` bins. Dynamic
programming over it chooses bucket boundaries with the least padding when a size is
rounded up to its boundary; batches with a token budget then form from the bucket sizes,
longest bucket first. Batches of one bucket alone would leave the rest of every
container empty that its next item does not fit, so the rest of an open batch is offered
to the shorter buckets, tightest room first. The plan speaks of ranks within buckets;
documents find their container by their rank, in parallel.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from captionflow.operators.running import hash_order, running_total
from captionflow.session import written

#: Largest capacity and most packs at once; they bound the histograms and plans that the driver holds.
MOST_CAPACITY = 1 << 17
MOST_PACKS = 64
#: Most cells (buckets x sizes) of the dynamic programming; more sizes get fewer buckets.
MOST_CELLS = 1 << 23


def bucket_bounds(sizes: list[int], counts: list[int], k: int) -> list[int]:
    """At most ``k`` upper bounds that minimise sum(count * (bound - size)); exact.

    ``sizes`` ascend. Up to ``k`` sizes the optimum is one bucket for each, without padding. For more,
    layer by layer, the padding of a bucket of sizes i..j is bound_j * (N_j - N_i) - (S_j - S_i). The
    best i never falls as j grows, so the places halfway between solved ones are solved together, each
    over the stretch between its neighbours' answers: log(n) vector steps a layer.
    """
    n = len(sizes)
    if n <= k:
        return list(sizes)
    x = np.concatenate([[0], sizes]).astype(np.int64)
    total = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
    mass = np.concatenate([[0], np.cumsum(np.multiply(sizes, counts, dtype=np.int64))])
    cost = x * total - mass
    back = []
    for _ in range(1, k):
        now, source = cost.copy(), np.zeros(n + 1, dtype=np.int32)
        height = cost + mass
        step = 1 << n.bit_length()
        while step >= 1:
            at = np.arange(step, n + 1, 2 * step)
            low = source[at - step]
            after = at + step
            high = np.where(after <= n, source[np.minimum(after, n)], at - 1)
            high = np.minimum(high, at - 1)
            width = high - low + 1
            start = np.cumsum(width) - width
            own = np.repeat(np.arange(len(at)), width)
            i = np.arange(int(width.sum())) - start[own] + low[own]
            value = height[i] + x[at][own] * (total[at][own] - total[i]) - mass[at][own]
            best = np.minimum.reduceat(value, start) if len(at) else value
            hit = np.flatnonzero(value == best[own])
            first = np.full(len(at), -1)
            first[own[hit][::-1]] = i[hit][::-1]
            now[at], source[at] = best, first
            step //= 2
        back.append(source)
        cost = now
    bounds, j = [], n
    for source in reversed(back):
        bounds.append(sizes[j - 1])
        j = int(source[j])
        if j == 0:
            break
    else:
        bounds.append(sizes[j - 1])
    return sorted(bounds)


def plan(bounds: list[int], counts: list[int], capacity: int) -> tuple[list[tuple[int, int, int, int]], int]:
    """Allocations (bucket, first rank, first container, items in each container) and the number of containers.

    Consecutive allocations of a bucket cover its ranks 0, 1, ... in order.
    """
    room: dict[int, list[tuple[int, int]]] = {}
    rooms: list[int] = []
    made, used = [], 0

    def add(left: int, start: int, number: int) -> None:
        if number and left:
            if not room.get(left):
                insort(rooms, left)
            room.setdefault(left, []).append((start, number))

    for bucket in range(len(bounds) - 1, -1, -1):
        size, n, rank = bounds[bucket], counts[bucket], 0
        while n:
            at = bisect_left(rooms, size)
            if at < len(rooms):
                left = rooms[at]
                start, number = room[left].pop()
                if not room[left]:
                    rooms.pop(at)
            else:
                left, start = capacity, used
                number = -(-n // (capacity // size))
                used += number
            each = left // size
            whole = min(number, n // each)
            if whole:
                made.append((bucket, rank, start, each))
                rank, n = rank + whole * each, n - whole * each
                add(left - each * size, start, whole)
                start, number = start + whole, number - whole
            if number and n:  # the last items of the bucket, fewer than fill a container
                made.append((bucket, rank, start, n))
                add(left - n * size, start, 1)
                start, number, rank, n = start + 1, number - 1, rank + n, 0
            add(left, start, number)
    return made, used


def packed(docs: DataFrame, capacities: dict[int, int], most_buckets: int = 1024, seed: int = 23) -> DataFrame:
    """(pack_id, capacity, container, doc_id, piece, first_token, n_tokens) for documents (doc_id, n_tokens).

    No document is divided unless it is longer than the capacity; such a document fills
    whole containers of its own and its rest is an item like any other. Documents without
    tokens take no place and are left out. Repeated ids are separate items.
    """
    if len(capacities) > MOST_PACKS:
        raise ValueError(f"more than {MOST_PACKS} packs at once")
    if any(not 0 < c <= MOST_CAPACITY for c in capacities.values()):
        raise ValueError(f"capacities must lie in 1..{MOST_CAPACITY}")
    spark = docs.sparkSession
    docs = written(docs.where("n_tokens > 0").select("doc_id", "n_tokens", hash_order("doc_id", seed=seed).alias("_h")), "sizes")
    choices = F.explode(F.array(*[F.struct(F.lit(p).alias("pack_id"), F.lit(c).cast("long").alias("capacity")) for p, c in sorted(capacities.items())]))
    each = docs.select("doc_id", "n_tokens", "_h", choices.alias("k")).select("k.*", "doc_id", "n_tokens", "_h", (F.col("n_tokens") % F.col("k.capacity")).alias("rest"))
    bins: dict[int, dict[int, int]] = {p: {} for p in capacities}
    for p, size, n in each.where("rest > 0").groupBy("pack_id", "rest").count().collect():
        bins[p][size] = n
    edges, moves, base, items = {}, {}, {}, 0
    for p, capacity in capacities.items():
        sizes = sorted(bins[p])
        most = max(1, min(most_buckets, MOST_CELLS // max(1, len(sizes))))
        edges[p] = bounds = bucket_bounds(sizes, [bins[p][s] for s in sizes], most)
        counts = [0] * len(bounds)
        for s in sizes:
            counts[bisect_left(bounds, s)] += bins[p][s]
        made, base[p] = plan(bounds, counts, capacity)
        own: dict[int, list[tuple]] = {}
        for bucket, *move in made:
            own.setdefault(bucket, []).append(move)
        moves[p] = {b: tuple(np.array(x) for x in zip(*m)) for b, m in own.items()}
        items += sum(counts)
    held = spark.sparkContext.broadcast((edges, moves))

    def buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pack, rest = batch.column("pack_id").to_numpy(), batch.column("rest").to_numpy()
            out = np.zeros(len(pack), dtype=np.int32)
            for p in np.unique(pack):
                out[pack == p] = np.searchsorted(held.value[0][int(p)], rest[pack == p])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], names=[*batch.schema.names, "bucket"])

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pack, bucket, rank = (batch.column(c).to_numpy() for c in ("pack_id", "bucket", "rank"))
            out = np.zeros(len(pack), dtype=np.int64)
            order = np.lexsort((bucket, pack))
            cuts = np.flatnonzero((np.diff(pack[order]) != 0) | (np.diff(bucket[order]) != 0)) + 1
            for rows in np.split(order, cuts) if len(order) else []:
                first, start, per = held.value[1][int(pack[rows[0]])][int(bucket[rows[0]])]
                at = np.searchsorted(first, rank[rows], "right") - 1
                out[rows] = start[at] + (rank[rows] - first[at]) // per[at]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("pack_id", "capacity", "doc_id", "n_tokens", "rest")], pa.array(out)], names=["pack_id", "capacity", "doc_id", "n_tokens", "rest", "container"])

    schema = "pack_id int, capacity long, doc_id long, n_tokens long, _h long, rest long"
    rests = each.where("rest > 0").select("pack_id", "capacity", "doc_id", "n_tokens", "_h", "rest").mapInArrow(buckets, schema + ", bucket int").withColumn("_one", F.lit(1).cast("long"))
    ranked = running_total(rests, ["pack_id", "bucket"], "_h", ["doc_id"], "_one", "upto", rows_hint=items).withColumn("rank", F.col("upto") - 1)
    seated = ranked.select("pack_id", "capacity", "doc_id", "n_tokens", "rest", "bucket", "rank").mapInArrow(places, "pack_id int, capacity long, doc_id long, n_tokens long, rest long, container long")
    full = (F.col("n_tokens") / F.col("capacity")).cast("long")
    whole = seated.select("pack_id", "capacity", "container", "doc_id", full.alias("piece"), (F.col("n_tokens") - F.col("rest")).alias("first_token"), F.col("rest").alias("n_tokens"))
    shift = F.coalesce(*[F.when(F.col("pack_id") == p, F.lit(n).cast("long")) for p, n in base.items()])
    long = each.where("n_tokens >= capacity").withColumn("_full", full)
    long = running_total(long, ["pack_id"], "_h", ["doc_id"], "_full", "upto", rows_hint=items)
    pieces = long.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_full") - 1)))
    pieces = pieces.select("pack_id", "capacity", (shift + F.col("upto") - F.col("_full") + F.col("piece")).alias("container"), "doc_id", "piece", (F.col("piece") * F.col("capacity")).alias("first_token"), F.col("capacity").alias("n_tokens"))
    return whole.unionByName(pieces)


def packing_report(seats: DataFrame) -> DataFrame:
    """(pack_id, capacity, n_containers, n_tokens, least_containers, unused_share): least_containers is the bound tokens / capacity."""
    boxes = seats.groupBy("pack_id", "capacity", "container").agg(F.sum("n_tokens").alias("t"))
    out = boxes.groupBy("pack_id", "capacity").agg(F.count("*").alias("n_containers"), F.sum("t").alias("n_tokens"), F.max("t").alias("fullest"))
    return out.withColumn("least_containers", F.ceil(F.col("n_tokens") / F.col("capacity"))).withColumn("unused_share", 1 - F.col("n_tokens") / (F.col("n_containers") * F.col("capacity")))
