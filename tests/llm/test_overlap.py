import random

import numpy as np
import pytest

from captionflow.llm import overlap

ITEMS = "item_id long, photo_id long, caption string, split string, source string, held string"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(before + (x != y), row[j] + 1, row[j - 1] + 1)
    return row[-1]


def by_hand(rows, per=5, least=8):
    out = set()
    for i, p, c, s, *_ in rows:
        for j, q, e, t, *_ in rows:
            if i is None or j is None or s is None or t is None or i >= j or (s == "train") == (t == "train"):
                continue
            a, b = overlap.words(c), overlap.words(e)
            near = min(len(a), len(b)) >= least and distance(a, b) * per <= max(len(a), len(b))
            if near or (p is not None and p > 0 and p == q):
                out.add((i, j))
    return out


def test_words():
    assert overlap.words("Crème BRÛLÉE, 2nd-floor; ﬁne ½") == ["creme", "brulee", "2nd", "floor", "fine", "1", "2"] and overlap.words(None) == []


def test_banded_distance_equals_the_full_one():
    rng = random.Random(1)
    for _ in range(300):
        a = [rng.randint(0, 3) for _ in range(rng.randint(1, 9))]
        b = [rng.randint(0, 3) for _ in range(rng.randint(1, 9))]
        k = rng.randint(0, 4)
        got = overlap.within_edits(np.array([a], dtype=np.uint64), np.array([b], dtype=np.uint64), k)[0]
        assert got == (distance(a, b) <= k)


@pytest.mark.parametrize("hot", [0, 100])
def test_pairs_equal_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(overlap, "HOT_PAIRS", hot)
    rng = random.Random(11)
    vocab = [f"w{i}" for i in range(12)]
    base = [[rng.choice(vocab) for _ in range(rng.randint(7, 22))] for _ in range(25)]
    rows = []
    for i in range(260):
        w = list(rng.choice(base))
        for _ in range(rng.randint(0, 5)):
            at, kind = rng.randrange(len(w)), rng.random()
            if kind < 0.34:
                w[at] = rng.choice(vocab)
            elif kind < 0.67:
                w.insert(at, rng.choice(vocab))
            elif len(w) > 1:
                del w[at]
        text = rng.choice([" ".join(w), " ".join(w).upper(), ", ".join(w) + "."])
        rows.append((i, rng.choice([None, 0, -1, *range(1, 40)]), rng.choice([text] * 9 + [None]), rng.choice(["train", "train", "valid", "test", None]), rng.choice(["a", None]), "clash"))
    rows += [(None, 5, "x", "train", "a", "c"), (900, 77, "", "train", "a", "c"), (901, 77, " ", "test", "a", "c"), (902, None, "frame one two three four five six seven", "train", "a", "c"), (903, None, "frame one two three four five six seven", "valid", "a", "c")]
    df = spark.createDataFrame(rows, ITEMS)
    pairs = overlap.cross_split_pairs(df, "item_id", "caption", "split", "photo_id")
    got = [(r.item_a, r.item_b) for r in pairs.collect()]
    assert set(got) == by_hand(rows) and len(got) == len(set(got))
    report = overlap.overlap_report(df, "item_id", "split", "source", pairs).collect()
    assert sum(r.n_pairs for r in report) == len(got)
    if not hot:
        return
    links = {r.item_id: r for r in overlap.item_links(df, "item_id", "caption", "split", "photo_id").collect()}
    live = [r for r in rows if r[0] is not None and r[3] is not None]
    assert set(links) == {r[0] for r in live}
    near = by_hand([(i, None, *rest) for i, _, *rest in live])
    photo = by_hand([(i, p, "", *rest) for i, p, _, *rest in live])
    for r in live:
        assert links[r[0]].n_text_links == sum(r[0] in pair for pair in near)
        assert links[r[0]].n_photo_links == sum(r[0] in pair for pair in photo)
        same = [x[0] for x in live if overlap.words(x[2]) == overlap.words(r[2])]
        assert links[r[0]].class_id == (min(same) if len(overlap.words(r[2])) >= 8 else None)


def test_empty_table(spark):
    df = spark.createDataFrame([], ITEMS)
    assert overlap.cross_split_pairs(df, "item_id", "caption", "split", "photo_id").count() == 0
    assert overlap.item_links(df, "item_id", "caption", "split", "photo_id").count() == 0
