import random
from collections import Counter, defaultdict
from itertools import combinations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from captionflow.llm import packing, tokens


def padding(sizes, counts, bounds):
    return sum(n * (min(b for b in bounds if b >= s) - s) for s, n in zip(sizes, counts))


def test_bounds_are_optimal():
    rng = random.Random(2)
    for _ in range(150):
        sizes = sorted(rng.sample(range(1, 60), rng.randint(1, 8)))
        counts = [rng.randint(1, 9) for _ in sizes]
        k = rng.randint(1, 5)
        best = min(padding(sizes, counts, [*c, sizes[-1]]) for n in range(k) for c in combinations(sizes[:-1], n))
        got = packing.bucket_bounds(sizes, counts, k)
        assert len(got) <= k and padding(sizes, counts, got) == best


def test_bounds_of_many_sizes_are_bounded_work():
    sizes = list(range(1, 40_000))
    got = packing.bucket_bounds(sizes, [1 + s % 7 for s in sizes], 8)
    assert len(got) == 8 and got[-1] == sizes[-1]
    even = [sizes[-1] * (i + 1) // 8 for i in range(8)]
    assert padding(sizes[::50], [1] * len(sizes[::50]), got) <= 1.01 * padding(sizes[::50], [1] * len(sizes[::50]), even)


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 30), max_size=12), st.integers(40, 90))
def test_plan_seats_every_item_once_within_capacity(histogram, capacity):
    sizes = sorted(histogram)
    made, used = packing.plan(sizes, [histogram[s] for s in sizes], capacity)
    load, seated = defaultdict(int), Counter()
    for bucket, s in enumerate(sizes):
        moves = [m[1:] for m in made if m[0] == bucket]
        for rank in range(histogram[s]):
            first, start, per = [m for m in moves if m[0] <= rank][-1]
            load[start + (rank - first) // per] += s
            seated[s] += 1
    assert seated == Counter(histogram) and all(v <= capacity for v in load.values()) and set(load) == set(range(used))
    total = sum(s * n for s, n in histogram.items())
    assert used * capacity < 2 * total + capacity


def test_whole_table(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice([0, 1, 5, 63, 64, 65, 200, rng.randint(1, 500)]), "clash") for i in range(700)] + [(5, 7, "clash"), (None, 3, "clash"), (800, None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, n_tokens long, pack_id string")
    got = packing.packed(df, {1: 64, 2: 256}, most_buckets=20).collect()
    for pack, capacity in ((1, 64), (2, 256)):
        own = [r for r in got if r.pack_id == pack]
        load = Counter()
        for r in own:
            load[r.container] += r.n_tokens
        assert max(load.values()) <= capacity and set(load) == set(range(len(load)))
        assert sum(r.n_tokens for r in own) == sum(n or 0 for _, n, _ in rows)
        for doc, n, _ in rows:
            if doc is not None and doc != 5 and n and n <= capacity:
                assert [r.n_tokens for r in own if r.doc_id == doc] == [n]
    report = packing.packing_report(packing.packed(df, {2: 256})).first()
    free, whole = [], sum((n or 0) // 256 for _, n, _ in rows)
    for size in sorted((n % 256 for _, n, _ in rows if n and n % 256), reverse=True):
        room = min((f for f in free if f >= size), default=None)
        if room is None:
            free.append(256 - size)
        else:
            free[free.index(room)] -= size
    assert report.least_containers <= report.n_containers <= len(free) + whole + 1  # as good as plain best fit
    assert packing.packed(df.limit(0), {1: 64}).count() == 0
    for wrong in ({1: 0}, {1: packing.MOST_CAPACITY + 1}, {i: 64 for i in range(packing.MOST_PACKS + 1)}):
        with pytest.raises(ValueError):
            packing.packed(df, wrong)


def test_tokens(spark):
    df = spark.createDataFrame([(1, "Hello world", "a"), (2, None, "b"), (3, "", "c"), (4, "<|endoftext|>", "d"), (5, "x" * 100_000, "e")], "id long, text string, n_tokens string")
    got = {r.doc_id: r.n_tokens for r in tokens.token_counts(df.select("id", "text"), "id", "text").collect()}
    assert got[1] == 2 and got[2] == got[3] == 0 and got[4] > 1 and got[5] > 1000
