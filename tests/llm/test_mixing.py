import random
from collections import defaultdict

import pytest

from captionflow.llm import mixing

TARGETS = [("m", "a", 0.5, 1), ("m", "b", 0.3, 4), ("m", "none", 0.2, 4), ("only", "c", 1.0, 2), ("gone", "none", 1.0, 3)]


def test_mix_reaches_shares_within_repeats(spark):
    rng = random.Random(8)
    rows = [(i, "a", rng.randint(1, 40), "x") for i in range(3000)] + [(5000 + i, "b", rng.randint(1, 40), "x") for i in range(400)] + [(9000 + i, "c", 10, "x") for i in range(20)] + [(9999, None, 50, "x"), (9998, "a", 0, "x"), (9997, "zz", 9, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, n_tokens long, copy string")
    targets = spark.createDataFrame(TARGETS, "mix_name string, source string, target_share double, max_repeats int")
    mix = mixing.mixed(docs, targets)
    report = {(r.mix_name, r.source): r for r in mixing.mix_report(mix, targets).collect()}
    assert abs(report["m", "a"].actual_share - 0.625) < 0.01 and abs(report["m", "b"].actual_share - 0.375) < 0.01
    assert report["m", "b"].most_uses <= 4 and report["m", "a"].most_uses == 1 and report["only", "c"].most_uses == 2 and report["only", "c"].n_tokens == 400
    assert report["m", "none"].n_tokens == 0 and report["gone", "none"].n_tokens == 0
    line = [(r.source, r.n_tokens) for r in mix.where("mix_name = 'm'").collect()]
    half = line[: len(line) // 2]
    assert abs(sum(n for s, n in half if s == "a") / sum(n for _, n in half) - 0.625) < 0.03
    assert mixing.mixed(docs.limit(0), targets).count() == 0 and mixing.mixed(docs, targets.limit(0)).count() == 0


def line_by_hand(own, sources, total):
    """The first documents of the line by finish time, each source's copies in the given order."""
    line = []
    for source, (share, _) in sources.items():
        at = 0
        for copy, doc, n in own[source]:
            at += n
            line.append((at / share, source, doc, copy, n))
    out, reached = [], 0
    for item in sorted(line):
        reached += item[-1]
        if reached - item[-1] / 2 <= total:
            out.append(item[1:])
    return out


@pytest.mark.parametrize("budget", [1, 3000, 20_000, 10**9])
def test_budget_cuts_the_line_that_all_sources_share(spark, budget):
    rng = random.Random(budget)
    rows = [(i, "big", rng.randint(1, 30)) for i in range(1500)] + [(3000 + i, "mid", rng.choice([5, 900])) for i in range(40)] + [(5000 + i, "small", 7) for i in range(9)] + [(6000, "none", 50)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, n_tokens long")
    targets = [("m", "big", 0.5, 1), ("m", "mid", 0.2, 2), ("m", "small", 0.3, None), ("m", "none", 0.4, 0), ("m", "gone", 0.1, 3)]
    df = spark.createDataFrame(targets, "mix_name string, source string, target_share double, max_repeats int")
    whole = mixing.mixed(docs, df, 10**12).collect()
    held = defaultdict(int)
    for _, s, n in rows:
        held[s] += n
    sources = mixing.live_sources(targets, held)["m"]
    assert set(sources) == {"big", "mid", "small"} and sum(s for s, _ in sources.values()) == pytest.approx(1)
    own = defaultdict(list)
    for r in sorted(whole, key=lambda r: (r.source, r.finish)):
        own[r.source].append((r.copy, r.doc_id, r.n_tokens))
    assert {s: len(v) for s, v in own.items()} == {"big": 1500, "mid": 80, "small": 9}
    got = [(r.source, r.doc_id, r.copy, r.n_tokens) for r in mixing.mixed(docs, df, budget).collect()]
    want = line_by_hand(own, sources, budget)
    assert sorted(got) == sorted(want)


def test_time_at():
    sources = {"a": (0.5, 100), "b": (0.25, 10), "c": (0.25, 1000)}
    assert mixing.time_at(sources, 40) == pytest.approx(40) and mixing.time_at(sources, 60) == pytest.approx(40 + 20 / 0.75)
    assert mixing.time_at(sources, 10**9) == pytest.approx(4000)
