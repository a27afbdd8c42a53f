"""Mixing sources to target shares by weighted fair queueing.

Each copy of a document gets a virtual finish time: the tokens of its source up to and including it,
in shuffled order, divided by the source's target share. The copies of all sources are one line in the
order of that time, so every prefix holds the sources in their shares while they last, and the mix is
the line cut where its running total reaches the budget. A source that has given all its copies drops
out and the others fill the rest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from captionflow.operators.running import hash_order, running_total
from captionflow.session import written

#: Most rows of a target table; it is read into the driver.
MOST_TARGETS = 10_000

Targets = list[tuple[str, str, float, int | None]]


def live_sources(targets: Targets, held: dict[str, int]) -> dict[str, dict[str, tuple[float, int]]]:
    """For each mix the sources that can give something: (share, tokens of all allowed copies).

    A share null or not above 0, a source without tokens and ``max_repeats`` of 0 or less give
    nothing; where ``max_repeats`` is null a document is used once. Shares of the others are scaled to 1.
    """
    out: dict[str, dict[str, tuple[float, int]]] = {}
    for mix in {t[0] for t in targets}:
        own = {
            source: (share, held[source] * (1 if repeats is None else repeats))
            for m, source, share, repeats in targets
            if m == mix and held.get(source, 0) > 0 and (share or 0) > 0 and (repeats is None or repeats > 0)
        }
        scale = sum(share for share, _ in own.values())
        if own:
            out[mix] = {source: (share / scale, tokens) for source, (share, tokens) in own.items()}
    return out


def time_at(sources: dict[str, tuple[float, int]], budget: float) -> float:
    """The virtual time at which the sources have given ``budget`` tokens, or all they have."""
    at, given, live = 0.0, 0.0, 1.0
    for share, tokens in sorted(sources.values(), key=lambda x: x[1] / x[0]):
        end = tokens / share
        if given + (end - at) * live >= budget:
            return at + (budget - given) / live
        given, at, live = given + (end - at) * live, end, live - share
    return at


def mixed(docs: DataFrame, targets: DataFrame, budget: int | dict[str, int] | None = None, seed: int = 29) -> DataFrame:
    """(mix_name, finish, doc_id, source, copy, n_tokens) in range order of the virtual finish time.

    ``docs`` has doc_id, source, n_tokens; ``targets`` mix_name, source, target_share, max_repeats.
    ``budget`` is the total number of tokens, of each mix or by mix name. At a budget that a source's
    copies can't keep up with, that source falls short and the others fill. Without a budget it is the
    largest at which every source keeps its share. Documents without tokens or with a null source are
    in no mix; a mix without a source that can give something is empty. The document that the cut falls
    into is taken if its middle lies before the cut. Repeated rows are documents of their own.
    """
    wanted = [tuple(r) for r in targets.select("mix_name", "source", "target_share", "max_repeats").take(MOST_TARGETS + 1)]
    if len(wanted) > MOST_TARGETS:
        raise ValueError(f"more than {MOST_TARGETS} targets")
    docs = written(docs.where("n_tokens > 0 and source is not null").select("doc_id", "source", "n_tokens"), "doc_tokens")
    named = docs.join(F.broadcast(targets.select("source").distinct()), "source", "left_semi")
    sums = named.groupBy("source").agg(F.sum("n_tokens").alias("t"), F.count("*").alias("n"), F.max("n_tokens").alias("m"))
    size = {r["source"]: (r["t"], r["n"], r["m"]) for r in sums.collect()}
    rows, most = [], 0
    for mix, sources in live_sources(wanted, {s: t for s, (t, _, _) in size.items()}).items():
        total = budget.get(mix) if isinstance(budget, dict) else budget
        if total is None:
            total = min(tokens / share for share, tokens in sources.values())
        time = time_at(sources, total)
        # whole documents lag behind the even flow by at most one of each source: the line is built so much further
        lasting = sum(share for share, tokens in sources.values() if tokens / share > time)
        end = time + (sum(size[s][2] for s in sources) / lasting if lasting else 0.0)
        slices = 1 + int(sum(-(-min(tokens, end * share) // size[s][0]) * size[s][1] for s, (share, tokens) in sources.items()) // 20_000)
        for source, (share, tokens) in sources.items():
            copies = min(tokens // size[source][0], 1 + int(end * share // size[source][0]))
            rows.append((mix, source, share, float(total), end, size[source][0], copies, slices))
            most = max(most, size[source][1])
    schema = "mix_name string, source string, share double, total double, end double, held long, copies int, slices int"
    takes = docs.sparkSession.createDataFrame(rows, schema)
    queued = docs.join(F.broadcast(takes), "source").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    queued = queued.withColumn("_h", hash_order("mix_name", "copy", "doc_id", seed=seed))
    own = running_total(queued, ["mix_name", "source", "copy"], "_h", ["doc_id"], "n_tokens", "upto", rows_hint=most)
    passed = F.col("upto") + (F.col("copy") - 1) * F.col("held")
    line = own.withColumn("finish", passed / F.col("share")).where((passed - F.col("n_tokens")) / F.col("share") <= F.col("end"))
    # finish times are even along the line, so equal stretches of time are slices of about equal size
    part = F.least(F.floor(F.col("finish") / F.col("end") * F.col("slices")), F.col("slices")).cast("int")
    line = written(line.select("mix_name", "finish", "doc_id", "source", "copy", "n_tokens", "total", part.alias("part")), "line")
    cut = running_total(line, ["mix_name"], "finish", ["source", "doc_id", "copy"], "n_tokens", "reached", rows_hint=0, slice_of=F.col("part"))
    chosen = cut.where(F.col("reached") - F.col("n_tokens") / 2 <= F.col("total"))
    return chosen.select("mix_name", "finish", "doc_id", "source", "copy", "n_tokens").orderBy("mix_name", "finish", "source", "doc_id", "copy")


def mix_report(mix: DataFrame, targets: DataFrame) -> DataFrame:
    """(mix_name, source, target_share, n_tokens, actual_share, n_documents, most_uses) for every target, 0 where a source gave nothing."""
    uses = mix.groupBy("mix_name", "source", "doc_id").agg(F.sum("n_tokens").alias("t"), F.count("*").alias("u"))
    used = uses.groupBy("mix_name", "source").agg(F.sum("t").alias("t"), F.count("*").alias("n"), F.max("u").alias("m"))
    total = used.groupBy("mix_name").agg(F.sum("t").alias("all_t"))
    joined = targets.select("mix_name", "source", "target_share").join(used, ["mix_name", "source"], "left").join(total, "mix_name", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return joined.select("mix_name", "source", "target_share", zero("t").alias("n_tokens"), F.coalesce(F.col("t") / F.col("all_t"), F.lit(0.0)).alias("actual_share"), zero("n").alias("n_documents"), zero("m").alias("most_uses"))
