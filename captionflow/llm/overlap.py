"""Same and nearly same records across splits: an edit-distance join over words.

A pair may differ by at most one edit for every ``per`` words of the longer text, so
k = longer // per edits. Evaluation texts are cut into k + 1 segments; by the pigeonhole
principle one of them stands unchanged in any training text within k edits, at a place
that the edits before and after it allow. Segments and training substrings are joined on
their hashes and each pair is verified by banded dynamic programming. A segment so common that
it would pair many texts is not paired: what stands beside it must match within the same
k edits, so one of k + 1 segments of the rest is unchanged too, and the two together are
the key; if that is still too common, the rest of the rest is cut, and so on until too
few words are left to differ. Texts carry a map of 64 bits, one for each word by its hash:
an edit changes two bits at most, so most pairs that merely share a segment go as they meet.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from captionflow.session import written

_WORD = regex.compile(r"[\p{L}\p{N}]+")
_MARK = regex.compile(r"\p{M}+")
_BASE = 0x9E3779B97F4A7C15 | 1
_CACHE: dict[str, int] = {}
#: A key that would give more pairs than this is joined together with a further segment (same result, other path).
HOT_PAIRS = 30_000


def words(text: str | None) -> list[str]:
    """Runs of letters and digits after NFKD, removal of combining marks and lower-casing; none for null."""
    if not text:
        return []
    if not text.isascii():
        text = _MARK.sub("", unicodedata.normalize("NFKD", text))
    return _WORD.findall(text.lower())


def _word_hash(word: str) -> int:
    got = _CACHE.get(word)
    if got is None:
        if len(_CACHE) > 500_000:
            _CACHE.clear()
        got = _CACHE[word] = xxhash.xxh3_64_intdigest(word)
    return got


def word_bits(norm: list[str]) -> int:
    """A map of 64 bits, as a signed number, with the bit of each word set."""
    bits = 0
    for w in norm:
        bits |= 1 << (_word_hash(w) >> 58)
    return bits - (1 << 64) if bits >> 63 else bits


def may_be_near(n: Column, m: Column, a: Column, b: Column, per: int) -> Column:
    """Whether the maps of two texts of n and m words allow few enough edits.

    Of k edits at least the difference of the lengths are insertions or removals, which change one word
    each; the others change two. A word changes its own bit at most.
    """
    k, more = F.floor(F.greatest(n, m) / per), F.abs(n - m)
    return (more <= k) & (F.bit_count(a.bitwiseXOR(b)) <= 2 * k - more)


def edits_allowed(n: int, m: int, per: int) -> int:
    return max(n, m) // per


def segments(n: int, k: int) -> list[tuple[int, int]]:
    """(start, length) of k + 1 nearly even segments of n words."""
    short, more = divmod(n, k + 1)
    out, at = [], 0
    for i in range(k + 1):
        size = short + (i >= k + 1 - more)
        out.append((at, size))
        at += size
    return out


def eval_edits(n: int, per: int) -> list[int]:
    """Every k that some partner length within reach gives a text of n words."""
    found = {edits_allowed(n, m, per) for m in range(1, 2 * n + per + 2) if abs(m - n) <= edits_allowed(n, m, per)}
    return sorted(found)


def probes(m: int, per: int, least: int) -> list[tuple[int, int, int, int, int]]:
    """(n, k, segment, start, length) of the substrings of a training text of m words that may equal a segment."""
    out = []
    for n in range(least, 2 * m + per + 2):
        k, shift = edits_allowed(n, m, per), m - n
        if abs(shift) > k:
            continue
        for i, (at, size) in enumerate(segments(n, k)):
            low = max(at - i, at + shift - (k - i), 0)
            high = min(at + i, at + shift + (k - i), m - size)
            out += [(n, k, i, p, size) for p in range(low, high + 1)]
    return out


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def _keys(texts: list[str], places) -> Iterator[tuple[np.ndarray, np.ndarray, int, int]]:
    """(rows, keys, place, spot) of the parts that ``places(n)`` names as (n, k, segment, start, length); place holds n and k, spot segment and start."""
    by_length: dict[int, list[int]] = {}
    split = [t.split(" ") for t in texts]
    for row, w in enumerate(split):
        by_length.setdefault(len(w), []).append(row)
    for m, rows in by_length.items():
        power = np.multiply.accumulate(np.array([1] + [_BASE] * m, dtype=np.uint64))
        inverse = np.multiply.accumulate(np.array([1] + [pow(_BASE, -1, 1 << 64)] * m, dtype=np.uint64))
        codes = np.array([[_word_hash(w) for w in split[r]] for r in rows], dtype=np.uint64)
        sums = np.zeros((len(rows), m + 1), dtype=np.uint64)
        np.cumsum(codes * power[:m], axis=1, out=sums[:, 1:])
        own = np.array(rows, dtype=np.int64)
        for n, k, i, p, size in places(m):
            tag = np.uint64((n * 1_000_003 + k * 10_007 + i) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
            yield own, _mix((sums[:, p + size] - sums[:, p]) * inverse[p] ^ tag), n << 32 | k, i << 32 | p


KEYED = "tid long, m int, bits long, key long, place long, spot long"


def _key_rows(places):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                made = list(_keys(part.column("norm").to_pylist(), places))
                if made:
                    rows, keys = np.concatenate([x[0] for x in made]), np.concatenate([x[1] for x in made]).astype(np.int64)
                    place, spot = (np.repeat([x[c] for x in made], [len(x[0]) for x in made]) for c in (2, 3))
                    own = [part.column(c).take(pa.array(rows)) for c in ("tid", "m", "bits")]
                    yield pa.RecordBatch.from_arrays([*own, pa.array(keys), pa.array(place), pa.array(spot)], names=["tid", "m", "bits", "key", "place", "spot"])

    return run


Block = tuple[int, int, int]


def gaps(n: int, m: int, blocks: list[Block]) -> list[tuple[int, int, int, int, int, int]]:
    """What lies between matched blocks (start, length, start in the training text): start and end in either text, and the shifts of the blocks on both sides."""
    out, at, p, shift = [], 0, 0, 0
    for start, size, q in [*blocks, (n, 0, m)]:
        out.append((at, start, p, q, shift, q - start))
        at, p, shift = start + size, q + size, q - start
    return out


def rest_segments(n: int, k: int, blocks: list[Block]) -> list[tuple[int, int, int]]:
    """(gap, start, length) of k + 1 segments of the words outside the blocks, shared out by the lengths of the gaps; none if there are fewer words."""
    spaces = [(a, b) for a, b, *_ in gaps(n, n, [(s, z, s) for s, z, _ in blocks])]
    words = sum(b - a for a, b in spaces)
    if words <= k:
        return []
    shares = [(k + 1) * (b - a) / words for a, b in spaces]
    counts = [int(x) for x in shares]
    for g in sorted(range(len(spaces)), key=lambda g: (counts[g] - shares[g], g)):
        if sum(counts) <= k and counts[g] < spaces[g][1] - spaces[g][0]:
            counts[g] += 1
    return [(g, a + s, z) for g, ((a, _), c) in enumerate(zip(spaces, counts)) if c for s, z in segments(spaces[g][1] - a, c - 1)]


def rest_places(m: int, n: int, k: int, blocks: list[Block]) -> list[tuple[int, int, int]]:
    """(start, start in the training text, length) of where those segments may stand, given where the blocks stand."""
    between = gaps(n, m, blocks)
    needed = [abs(after - before) for *_, before, after in between]
    out = []
    for g, s, z in rest_segments(n, k, blocks):
        _, _, low, high, before, after = between[g]
        spare = k - sum(needed) + needed[g]
        for shift in range(-k, k + 1):
            q = s + shift
            if abs(shift - before) + abs(after - shift) <= spare and q >= low and q + z <= high:
                out.append((s, q, z))
    return out


def _deeper(probing: bool):
    """Rows with their text to rows with one more segment in the key; ``blocks`` holds n, k and the matched blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, keys, made = [], [], []
            for row, (norm, key, place, spot, known) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("norm", "key", "place", "spot", "blocks")))):
                w = norm.split(" ")
                if known:
                    n, k, *flat = known
                    blocks = [tuple(flat[i : i + 3]) for i in range(0, len(flat), 3)]
                else:
                    n, k, i, p = place >> 32, place & 0xFFFFFFFF, spot >> 32, spot & 0xFFFFFFFF
                    at, size = segments(n, k)[i]
                    blocks = [(at, size, p)]
                spots = rest_places(len(w), n, k, blocks) if probing else [(s, s, z) for _, s, z in rest_segments(n, k, blocks)]
                for s, q, z in spots:
                    rows.append(row)
                    keys.append(xxhash.xxh3_64_intdigest(f"{key} {s} {' '.join(w[q : q + z])}") - (1 << 63))
                    made.append([n, k, *(x for b in sorted([*blocks, (s, z, q)]) for x in b)])
            own = [batch.column(c).take(pa.array(rows, pa.int64())) for c in ("tid", "m", "bits")]
            yield pa.RecordBatch.from_arrays([*own, pa.array(keys, pa.int64()), pa.array(made, pa.list_(pa.int32()))], names=["tid", "m", "bits", "key", "blocks"])

    return run


def within_edits(a: np.ndarray, b: np.ndarray, k: int) -> np.ndarray:
    """For rows of word codes a (r x n) and b (r x m): whether the edit distance is at most k. Only a band of 2k + 1 diagonals is filled."""
    (r, n), m = a.shape, b.shape[1]
    big = np.int16(k + 1)
    last = np.full((m + 1, r), big, dtype=np.int16)
    for j in range(min(m, k) + 1):
        last[j] = j
    for i in range(1, n + 1):
        now = np.full((m + 1, r), big, dtype=np.int16)
        low, high = max(0, i - k), min(m, i + k)
        for j in range(low, high + 1):
            if j == 0:
                now[0] = i
                continue
            best = last[j - 1] + (a[:, i - 1] != b[:, j - 1])
            np.minimum(best, last[j] + 1, out=best)
            np.minimum(best, now[j - 1] + 1, out=best)
            now[j] = np.minimum(best, big)
        last = now
    return last[m] <= k


def _verify(per: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = batch.column("norm_a").to_pylist(), batch.column("norm_b").to_pylist()
            groups: dict[tuple[int, int], list[int]] = {}
            sides = []
            for row, (x, y) in enumerate(zip(left, right)):
                u, v = [_word_hash(w) for w in x.split(" ")], [_word_hash(w) for w in y.split(" ")]
                sides.append((u, v))
                groups.setdefault((len(u), len(v)), []).append(row)
            keep = np.zeros(len(left), dtype=bool)
            for (n, m), rows in groups.items():
                a, b = (np.array([sides[r][s] for r in rows], dtype=np.uint64) for s in (0, 1))
                keep[rows] = within_edits(a, b, edits_allowed(n, m, per))
            yield batch.select(["tid_a", "tid_b"]).filter(pa.array(keep))

    return run


def normalised(df: DataFrame, id_col: str, text: str, least: int) -> DataFrame:
    """(item, held, norm, m, bits): the words of each text joined by blanks, their number and their map, for texts of at least ``least`` words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [words(t) for t in batch.column("text").to_pylist()]
            keep = pa.array([len(w) >= least for w in made], pa.bool_())
            norm, m = pa.array([" ".join(w) for w in made], pa.string()), pa.array([len(w) for w in made], pa.int32())
            bits = pa.array([word_bits(w) for w in made], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("item"), batch.column("held"), norm, m, bits], names=["item", "held", "norm", "m", "bits"]).filter(keep)

    return df.select(F.col(id_col).cast("long").alias("item"), "held", F.col(text).alias("text")).where("text is not null").mapInArrow(run, "item long, held boolean, norm string, m int, bits long")


def _candidates(texts: DataFrame, cut: DataFrame, probe: DataFrame, per: int, most_levels: int = 8) -> DataFrame:
    """(tid_a, tid_b) with a key in common and maps that allow it, repeats possible; keys that are too common get further segments first."""
    norms, met = texts.select("tid", "norm"), None
    none = F.lit(None).cast("array<int>")
    cut, probe = cut.withColumn("blocks", none), probe.withColumn("blocks", none)

    def pairs_on(keys: DataFrame) -> DataFrame:
        side = lambda rows, x: rows.select("key", *[F.col(c).alias(f"{c}_{x}") for c in ("tid", "m", "bits")])
        joined = side(cut.join(keys, "key"), "a").join(side(probe, "b"), "key").where("tid_a <> tid_b")
        near = may_be_near(F.col("m_a"), F.col("m_b"), F.col("bits_a"), F.col("bits_b"), per)
        return joined.where(near).select("tid_a", "tid_b")

    def hot(rows: DataFrame, keys: DataFrame) -> DataFrame:
        missing = [F.lit(None).cast("long").alias(c) for c in ("place", "spot") if c not in rows.columns]
        found = rows.join(keys, "key").join(norms, "tid")
        return found.select("tid", "norm", "m", "bits", "key", *[c for c in ("place", "spot") if c in rows.columns], *missing, "blocks")

    for level in range(most_levels):
        cut = written(cut, "segments")
        probe = written(probe.join(cut.groupBy("key").agg(F.count("*").alias("n_cut")), "key"), "probes")
        heat = F.count("*") * F.first("n_cut") > HOT_PAIRS
        if level:  # too few words outside the blocks: what they leave open are at most the allowed edits
            n, k, blocks = F.col("blocks")[0], F.col("blocks")[1], F.slice("blocks", F.lit(3), F.size("blocks"))
            matched = F.aggregate(F.transform(blocks, lambda x, i: F.when(i % 3 == 1, x).otherwise(0)), F.lit(0), lambda s, x: s + x)
            heat = heat & (F.min(n - matched - k) > 0)
        info = written(probe.groupBy("key").agg(heat.alias("hot")), "segment_pairs")
        few, many = info.where("not hot").select("key"), info.where("hot").select("key")
        pairs = pairs_on(few)
        met = pairs if met is None else met.union(pairs)
        if many.isEmpty():
            return met
        if level + 1 == most_levels:
            return met.union(pairs_on(many))
        schema = "tid long, m int, bits long, key long, blocks array<int>"
        cut, probe = hot(cut, many).mapInArrow(_deeper(False), schema), hot(probe, many).mapInArrow(_deeper(True), schema)
    return met


def text_links(rows: DataFrame, id_col: str, text: str, per: int, least: int) -> tuple[DataFrame, DataFrame]:
    """Items (item, held, norm, m, bits, tid) and links (tid_a, tid_b) from evaluation texts to training texts.

    ``rows`` has ``held``, true for evaluation rows. Equal texts are one text, linked to itself where both sides have it.
    """
    items = written(normalised(rows, id_col, text, least).withColumn("tid", F.xxhash64("norm")), "items")
    texts = written(items.groupBy("tid", "norm", "m", "bits").agg(F.max("held").alias("in_eval"), (~F.min("held")).alias("in_train")), "texts")
    sides = texts.select("tid", "norm", "m", "bits", "in_eval", "in_train")
    cut = sides.where("in_eval").mapInArrow(_key_rows(lambda n: [(n, k, i, at, size) for k in eval_edits(n, per) for i, (at, size) in enumerate(segments(n, k))]), KEYED)
    probe = sides.where("in_train").mapInArrow(_key_rows(lambda m: probes(m, per, least)), KEYED)
    met = _candidates(texts, cut, probe, per).distinct()
    sides = met.join(texts.select(F.col("tid").alias("tid_a"), F.col("norm").alias("norm_a")), "tid_a").join(texts.select(F.col("tid").alias("tid_b"), F.col("norm").alias("norm_b")), "tid_b")
    near = sides.mapInArrow(_verify(per), "tid_a long, tid_b long")
    same = texts.where("in_eval and in_train").select(F.col("tid").alias("tid_a"), F.col("tid").alias("tid_b"))
    linked = near.union(same)
    return items, linked.distinct()


def cross_split_pairs(df: DataFrame, id_col: str, text: str, split: str, photo: str, train: str = "train", per: int = 5, least: int = 8) -> DataFrame:
    """Distinct (item_a, item_b, same_photo, near_text), item_a < item_b, exactly one of them in ``train``.

    A pair has the same photo above 0, or texts of at least ``least`` words each within
    one word edit for every ``per`` words of the longer. Rows with a null id or split
    count for nothing; null texts and photos match nothing. Equal texts are compared once.
    """
    rows = df.where(F.col(id_col).isNotNull() & F.col(split).isNotNull()).withColumn("held", F.col(split) != train)
    photos = rows.where(F.col(photo) > 0).select(F.col(id_col).cast("long").alias("item"), "held", F.col(photo).alias("p"))
    by_photo = photos.where("held").select(F.col("item").alias("x"), "p").join(photos.where("not held").select(F.col("item").alias("y"), "p"), "p").select("x", "y", F.lit(True).alias("same_photo"), F.lit(False).alias("near_text"))

    items, linked = text_links(rows, id_col, text, per, least)
    evals = items.where("held").select(F.col("item").alias("x"), F.col("tid").alias("tid_a"))
    trains = items.where("not held").select(F.col("item").alias("y"), F.col("tid").alias("tid_b"))
    by_text = linked.join(evals, "tid_a").join(trains, "tid_b").select("x", "y", F.lit(False).alias("same_photo"), F.lit(True).alias("near_text"))
    both = by_photo.unionByName(by_text).where("x <> y")
    return both.groupBy(F.least("x", "y").alias("item_a"), F.greatest("x", "y").alias("item_b")).agg(F.max("same_photo").alias("same_photo"), F.max("near_text").alias("near_text"))


def overlap_report(df: DataFrame, id_col: str, split: str, source: str, pairs: DataFrame, train: str = "train") -> DataFrame:
    """(split, source, n_items, n_overlapping, n_pairs) of the evaluation items; a null source is its own group."""
    ends = pairs.select(F.explode(F.array("item_a", "item_b")).alias(id_col)).groupBy(id_col).agg(F.count("*").alias("n"))
    rows = df.where(F.col(id_col).isNotNull() & F.col(split).isNotNull() & (F.col(split) != train)).select(id_col, split, source).dropDuplicates([id_col])
    return rows.join(ends, id_col, "left").groupBy(split, source).agg(F.count("*").alias("n_items"), F.count("n").alias("n_overlapping"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_pairs"))


def item_links(df: DataFrame, id_col: str, text: str, split: str, photo: str, train: str = "train", per: int = 5, least: int = 8) -> DataFrame:
    """One row for each item: (item_id, class_id, n_text_links, n_photo_links), without listing any pair of copies.

    ``class_id`` is the smallest item with the same words in the same order, null for texts of fewer than
    ``least`` words. The links are the rows of the other side, training or evaluation, with a near text
    and with the same photo above 0; copies are counted, not paired. Repeated rows of an item are counted
    each. Rows with a null id or split are left out.
    """
    rows = df.where(F.col(id_col).isNotNull() & F.col(split).isNotNull()).withColumn("held", F.col(split) != train)
    items, linked = text_links(rows, id_col, text, per, least)
    sizes = written(items.groupBy("tid").agg(F.count_if("held").alias("e"), F.count_if(~F.col("held")).alias("t"), F.min("item").alias("class_id")), "text_sizes")
    side = lambda x, n: sizes.select(F.col("tid").alias(x), F.col(n).alias("n"))
    of_eval = linked.join(side("tid_b", "t"), "tid_b").groupBy(F.col("tid_a").alias("tid")).agg(F.sum("n").alias("eval_links"))
    of_train = linked.join(side("tid_a", "e"), "tid_a").groupBy(F.col("tid_b").alias("tid")).agg(F.sum("n").alias("train_links"))
    by_text = sizes.join(of_eval, "tid", "left").join(of_train, "tid", "left")
    photos = rows.where(F.col(photo) > 0).groupBy(F.col(photo).alias("p")).agg(F.count_if("held").alias("pe"), F.count_if(~F.col("held")).alias("pt"))
    own = items.select(F.col("item").alias("_item"), "tid").distinct()
    each = rows.select(F.col(id_col).cast("long").alias("item_id"), "held", F.col(photo).alias("p")).distinct()
    joined = each.join(own, F.col("item_id") == F.col("_item"), "left").join(by_text, "tid", "left").join(photos, "p", "left")
    pick = lambda a, b: F.coalesce(F.when(F.col("held"), F.col(a)).otherwise(F.col(b)), F.lit(0))
    return joined.select("item_id", "class_id", pick("eval_links", "train_links").alias("n_text_links"), pick("pt", "pe").alias("n_photo_links"))
