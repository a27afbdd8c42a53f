import random

import numpy as np
import pytest

from captionflow.llm import spans

DOCS = "doc_id long, text string, h long, pos string"


def by_hand(rows, span):
    where = {}
    for i, t, *_ in rows:
        for a in range(len(t or "") - span + 1):
            where.setdefault(t[a : a + span], set()).add(i)
    pairs, covered = set(), {i: set() for i, *_ in rows}
    for ids in where.values():
        pairs |= {(a, b) for a in ids for b in ids if a is not None and b is not None and a < b}
    for i, t, *_ in rows:
        for a in range(len(t or "") - span + 1):
            if len(where[t[a : a + span]] - {None}) > 1:
                covered[i] |= set(range(a, a + span))
    return pairs, {i: len(c) for i, c in covered.items()}


def corpus(seed):
    rng = random.Random(seed)
    letters = "abcdefgh é\n世"
    text = lambda n: "".join(rng.choice(letters) for _ in range(n))
    passages = [text(rng.randint(190, 460)) for _ in range(8)] + [text(200), text(199)]
    rows = []
    for i in range(60):
        parts = [text(rng.randint(0, 300))]
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            if rng.random() < 0.4:
                cut = rng.randint(0, 60)
                p = p[cut:] if rng.random() < 0.5 else p[: len(p) - cut]
            parts += [p, text(rng.randint(0, 80))]
        rows.append((i, "".join(parts), 0, "clash"))
    rows += [(100, "a" * 3000, 0, "x"), (101, "b" + "a" * 450, 0, "x"), (102, "", 0, "x"), (103, None, 0, "x"), (104, rows[3][1], 0, "x"), (105, passages[0] + passages[0], 0, "x"), (106, "z" * 250 + "q" * 250, 0, "x")]
    return rows


@pytest.mark.parametrize("seed, block, bits, many", [(1, 400_000, None, 64), (2, 1000, None, 1), (3, 400_000, 6, 64), (4, 400_000, None, 2)])
def test_pairs_and_shares_equal_brute_force(spark, monkeypatch, seed, block, bits, many):
    monkeypatch.setattr(spans, "BLOCK", block)
    monkeypatch.setattr(spans, "MANY_CLASSES", many)
    if bits:  # a sketch far too small only lets more windows through
        monkeypatch.setattr(spans, "sketch_bits", lambda n: bits)
    rows = corpus(seed)
    df = spark.createDataFrame(rows, DOCS)
    want, covered = by_hand(rows, 200)
    got = [(r.doc_a, r.doc_b) for r in spans.sharing_pairs(spans.occurrences(df, "doc_id", "text")).collect()]
    assert set(got) == want and len(got) == len(set(got))
    assert {r.doc_id: r.shared_chars for r in spans.shared_parts(df, "doc_id", "text").collect()} == covered


def test_full_sketch_groups_by_hash_before_any_text_is_cut(spark):
    """At a sketch far too narrow for the corpus no window of one document alone is given its text."""
    rows = corpus(5)
    df = spark.createDataFrame(rows, DOCS)
    wide = spans.occurrences(df, "doc_id", "text").collect()
    narrow = spans.occurrences(df, "doc_id", "text", most_bits=6)
    got = narrow.collect()
    docs = {}
    for r in got:
        docs.setdefault(r.h, set()).add(r.doc_id)
    assert all(len(d) > 1 for d in docs.values())
    several = {}
    for r in wide:
        several.setdefault(r.h, set()).add(r.doc_id)
    assert sorted((r.h, r.doc_id, r.pos, r.lead, r.around) for r in got) == sorted((r.h, r.doc_id, r.pos, r.lead, r.around) for r in wide if len(several[r.h]) > 1)
    want, _ = by_hand(rows, 200)
    assert {(r.doc_a, r.doc_b) for r in spans.sharing_pairs(narrow).collect()} == want


def test_sketch_passes_few_windows_of_one_document():
    for n in (1, 1000, 10**6, 10**9, 10**12):
        assert (n / 2 ** spans.sketch_bits(n)) ** 2 <= 0.1  # two rows: the chance that both counters are taken


def test_sketch_never_underestimates(spark):
    rows = corpus(9)
    df = spark.createDataFrame(rows, DOCS).repartition(3)
    bits = 16
    twos = spans.sketch(df.where("text is not null").select("doc_id", "text"), 200, 100, bits)
    seen = {}
    for i, t, *_ in rows:
        for chars, ends, _ in spans.blocks([t], 200):
            for h in set(spans.Prints(chars, ends, 200, 100).hashes.tolist()):
                seen.setdefault(h, set()).add(i)
    often = np.array([h for h, ids in seen.items() if len(ids) > 1], dtype=np.uint64)
    for row, slot in enumerate(spans._slots(often, bits)):
        assert all(twos[row, int(s) >> 3] >> (7 - (int(s) & 7)) & 1 for s in slot)


def test_empty_table(spark):
    df = spark.createDataFrame([], DOCS)
    assert spans.sharing_pairs(spans.occurrences(df, "doc_id", "text")).count() == 0 and spans.shared_parts(df, "doc_id", "text").count() == 0


@pytest.mark.parametrize("seed, many", [(1, 64), (2, 1)])
def test_passages_are_the_maximal_shared_stretches(spark, monkeypatch, seed, many):
    monkeypatch.setattr(spans, "MANY_CLASSES", many)
    rows = corpus(seed)
    where = {}
    for i, t, *_ in rows:
        for a in range(len(t or "") - 199):
            where.setdefault(t[a : a + 200], set()).add(i)
    want = []
    for i, t, *_ in rows:
        held = []
        for a in range(len(t or "") - 199):
            if len(where[t[a : a + 200]]) > 1:
                if held and a <= held[-1][1]:
                    held[-1][1] = a + 200
                else:
                    held.append([a, a + 200])
        want += [(i, a, b, t[a:b]) for a, b in held]
    df = spark.createDataFrame(rows, DOCS)
    assert sorted(map(tuple, spans.passages(df, "doc_id", "text").collect())) == sorted(want)
    assert spans.passages(df.limit(0), "doc_id", "text").count() == 0
