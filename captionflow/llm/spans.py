"""Long exact spans shared between documents.

Windows of ``anchor`` characters are hashed at every position and the lowest hash of
each run of ``span - anchor + 1`` windows is kept (a run of ``span`` shared characters
therefore keeps the same window in every document that holds it). A count-min sketch
over all kept windows, merged from one partial sketch for each partition, overestimates
in how many documents a window stands; only windows estimated in two or more are
grouped, and grouped exactly, so none is lost. The characters around the window then
decide whether the shared run really has ``span`` characters.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from captionflow.session import spread, written

#: A window with more classes than this is compared by whole spans, not class by class.
MANY_CLASSES = 64
#: Characters hashed at once; longer documents are cut into overlapping blocks.
BLOCK = 400_000
_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if n not in _POWERS:
        inverse = pow(_BASE, -1, 1 << 64)
        made = []
        for base in (_BASE, inverse):
            steps = np.full(n, base, dtype=np.uint64)
            steps[0] = 1
            made.append(np.multiply.accumulate(steps))
        _POWERS.clear()
        _POWERS[n] = (made[0], made[1])
    return _POWERS[n]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xA5A3564E27F88695)
    return x ^ (x >> np.uint64(32))


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def _sliding(x: np.ndarray, width: int, best: np.ufunc) -> np.ndarray:
    """best(x[i : i + width]) for each full window."""
    have = 1
    while have * 2 <= width:
        x = best(x[:-have], x[have:])
        have *= 2
    rest = width - have
    return best(x[: len(x) - rest], x[rest:]) if rest else x


class Prints:
    """Hashes of one block of characters in which several texts follow each other."""

    def __init__(self, chars: np.ndarray, ends: np.ndarray, span: int, anchor: int) -> None:
        """``ends``: for each character the end of its text within the block."""
        n = len(chars)
        power, inverse = _powers(BLOCK + 1)
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum((chars.astype(np.uint64) + np.uint64(0x51ED27)) * power[:n], out=sums[1:])
        self.sums, self.inverse = sums, inverse
        at = np.arange(n - anchor + 1)
        hashed = self.of(at, at + anchor)
        width = span - anchor + 1
        low = _sliding(hashed, width, np.minimum)
        starts = np.arange(len(low))
        whole = ends[: len(low)] >= starts + span
        low = np.where(whole, low, np.uint64(0))
        # a window is kept if it is the lowest of any whole run that it lies in
        padded = np.concatenate([np.zeros(width - 1, np.uint64), low, np.zeros(width - 1, np.uint64)])
        self.kept = np.flatnonzero((_sliding(padded, width, np.maximum) == hashed) & (hashed > 0))
        self.hashes = hashed[self.kept]

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((self.sums[end] - self.sums[start]) * self.inverse[start])


def blocks(texts: list[str], span: int) -> Iterator[tuple[np.ndarray, np.ndarray, list[tuple[int, int, int]]]]:
    """Blocks of at most BLOCK characters: (characters, end of text for each, [(text number, place in block, offset in text)])."""
    held: list[np.ndarray] = []
    parts: list[tuple[int, int, int]] = []
    size = 0

    def flush() -> tuple[np.ndarray, np.ndarray, list[tuple[int, int, int]]]:
        ends = np.repeat(np.cumsum([len(x) for x in held]), [len(x) for x in held])
        return np.concatenate(held), ends, list(parts)

    for number, text in enumerate(texts):
        if text is None or len(text) < span:
            continue
        whole = codes(text)
        for offset in range(0, max(1, len(whole) - 2 * span), BLOCK - 2 * span):
            piece = whole[offset : offset + BLOCK]
            if size and size + len(piece) > BLOCK:
                yield flush()
                held, parts, size = [], [], 0
            held.append(piece)
            parts.append((number, size, offset))
            size += len(piece)
    if size:
        yield flush()


def _windows(batch: pa.RecordBatch, span: int, anchor: int) -> Iterator[tuple[Prints, np.ndarray, np.ndarray, list[str], np.ndarray]]:
    """(hashes of a block, text number and offset in its text of each kept window, the texts, ids); each window once."""
    ids, texts = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_pylist()
    for chars, ends, parts in blocks(texts, span):
        prints = Prints(chars, ends, span, anchor)
        number, place, offset = (np.array(x) for x in zip(*parts))
        part = np.searchsorted(place, prints.kept, "right") - 1
        within = prints.kept - place[part]
        # neighbouring blocks of one text overlap by two spans; the middle of the overlap divides them
        last = np.append(number[1:] != number[:-1], True)
        own = ((within >= span) | (offset[part] == 0)) & ((within < BLOCK - span) | last[part])
        prints.hashes = prints.hashes[own]
        yield prints, number[part][own], (within + offset[part])[own], texts, ids


def _slots(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The places of a window in the two rows of the sketch."""
    mask = np.uint64((1 << bits) - 1)
    return hashes & mask, _mix(hashes) & mask


#: Widest sketch, as a power of two: it is broadcast, 4 MB for each row.
MOST_BITS = 25


def sketch_bits(n_windows: int, least: int = 16) -> int:
    """Width of the sketch as a power of two at which few other windows pass: four counters a window."""
    return max(least, (4 * max(1, n_windows)).bit_length())


def _partial_sketch(bits: int, span: int, anchor: int, cell: int = 1 << 16):
    """For each partition: which counters are at least 1 and at least 2, as compressed bit planes cut into cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes = np.zeros((2, 2, 1 << bits), dtype=bool)
        for batch in batches:
            seen: list[np.ndarray] = []
            for prints, number, _, _, _ in _windows(batch, span, anchor):
                order = np.lexsort((prints.hashes, number))
                h, d = prints.hashes[order], number[order]
                fresh = np.ones(len(h), dtype=bool)
                fresh[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
                seen.append(h[fresh])
            for hashes in seen:  # a document cut over two blocks may count twice, which only overestimates
                for row, slot in enumerate(_slots(hashes, bits)):
                    where, count = np.unique(slot, return_counts=True)
                    planes[row, 1, where] |= planes[row, 0, where] | (count > 1)
                    planes[row, 0, where] = True
        rows, cells, ones, twos = [], [], [], []
        for row in range(2):
            for start in range(0, 1 << bits, cell):
                low = planes[row, 0, start : start + cell]
                if low.any():
                    rows.append(row)
                    cells.append(start // cell)
                    ones.append(zlib.compress(np.packbits(low).tobytes(), 1))
                    twos.append(zlib.compress(np.packbits(planes[row, 1, start : start + cell]).tobytes(), 1))
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int32()), pa.array(cells, pa.int32()), pa.array(ones, pa.binary()), pa.array(twos, pa.binary())], names=["row", "cell", "ones", "twos"])

    return run


def _merge_cells(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the partial counters of one cell, saturating at 2, batch by batch."""
    low = high = None
    for batch in batches:
        for a, b in zip(batch.column("ones").to_pylist(), batch.column("twos").to_pylist()):
            one, two = (np.frombuffer(zlib.decompress(x), np.uint8) for x in (a, b))
            low, high = (one.copy(), two.copy()) if low is None else (low | one, high | two | (low & one))
    yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([key[1].as_py()], pa.int32()), pa.array([high.tobytes()], pa.binary())], names=["row", "cell", "twos"])


def sketch(docs: DataFrame, span: int, anchor: int, bits: int) -> np.ndarray:
    """The merged sketch as two rows of bits: this window may stand in two or more documents.

    What comes to the driver is the sketch, at most ``2 << 25`` bits however large the input.
    """
    cell = min(1 << 16, 1 << bits)
    parts = docs.mapInArrow(_partial_sketch(bits, span, anchor, cell), "row int, cell int, ones binary, twos binary")
    merged = parts.groupBy("row", "cell").applyInArrow(_merge_cells, "row int, cell int, twos binary")
    out = np.zeros((2, (1 << bits) // 8), dtype=np.uint8)
    for row, place, twos in merged.collect():
        out[row, place * cell // 8 : (place + 1) * cell // 8] = np.frombuffer(twos, np.uint8)
    return out


OCCURRENCE = "h long, doc_id long, pos int, lead int, around string"


def _around(text: str, at: int, room: int, span: int) -> tuple[int, str]:
    lead = min(at, room)
    return lead, text[at - lead : at + span]


def occurrences(
    docs: DataFrame, id_col: str, text: str, span: int = 200, anchor: int = 100, most_bits: int = MOST_BITS
) -> DataFrame:
    """(h, doc_id, pos, lead, around) of every kept window that may stand in two or more documents.

    ``pos`` is the place of the window, ``around`` the text from ``lead`` characters before it (at most
    span - anchor) to ``span`` characters after its start. The sketch is as wide as the number of
    windows asks for, up to ``most_bits``. A corpus too large for that fills its sketch, so many windows
    of one document pass; there the windows that pass are grouped by their hash alone first, without any
    text, and only those of two or more documents are given their text. Both ways lose none.
    """
    source = docs.where(F.col(id_col).isNotNull() & (F.length(text) >= span))
    source = spread(source.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text")), "id")
    total = source.agg(F.sum(F.length("text").cast("long"))).first()[0] or 0
    room = span - anchor
    wanted = sketch_bits(2 * total // room)
    bits = min(wanted, most_bits)
    held = docs.sparkSession.sparkContext.broadcast(sketch(source, span, anchor, bits))

    def passed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        twos = held.value

        def hit(row: int, slot: np.ndarray) -> np.ndarray:
            byte = twos[row, (slot >> np.uint64(3)).astype(np.int64)]
            return (byte >> (np.uint8(7) - (slot & np.uint64(7)).astype(np.uint8))) & 1

        for batch in batches:
            for prints, number, offset, texts, ids in _windows(batch, span, anchor):
                one, two = _slots(prints.hashes, bits)
                keep = np.flatnonzero(hit(0, one) & hit(1, two))
                yield prints.hashes[keep].astype(np.int64), ids[number[keep]].astype(np.int64), offset[keep].astype(np.int32), number[keep], texts

    def with_text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for hashes, ids, offset, number, texts in passed(batches):
            cut = [_around(texts[n], o, room, span) for n, o in zip(number.tolist(), offset.tolist())]
            columns = [pa.array(hashes), pa.array(ids), pa.array(offset), pa.array([x for x, _ in cut], pa.int32()), pa.array([x for _, x in cut], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["h", "doc_id", "pos", "lead", "around"])

    def bare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for hashes, ids, offset, _, _ in passed(batches):
            yield pa.RecordBatch.from_arrays([pa.array(hashes), pa.array(ids), pa.array(offset)], names=["h", "doc_id", "pos"])

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for id_, whole, places in zip(*(batch.column(c).to_pylist() for c in ("id", "text", "places"))):
                rows += [(p["h"], id_, p["pos"], *_around(whole, p["pos"], room, span)) for p in places]
            columns = list(zip(*rows)) or [[]] * 5
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds)], names=["h", "doc_id", "pos", "lead", "around"])

    if bits == wanted:
        found = source.mapInArrow(with_text, OCCURRENCE)
    else:
        windows = source.mapInArrow(bare, "h long, doc_id long, pos int")
        several = windows.groupBy("h").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("h")
        places = windows.join(several, "h", "left_semi").groupBy("doc_id").agg(F.collect_list(F.struct("h", "pos")).alias("places"))
        found = source.join(places, F.col("id") == F.col("doc_id")).select("id", "text", "places").mapInArrow(cut_out, OCCURRENCE)
    return written(found.withColumn("c", F.xxhash64("around", "lead")), "occurrences")


def _reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds to class pairs how far their texts agree to the left and to the right of the window."""
    for batch in batches:
        cols = {n: batch.column(n).to_pylist() for n in ("around_a", "lead_a", "around_b", "lead_b")}
        left, right = [], []
        for a, i, b, j in zip(*cols.values()):
            n, top = 0, min(i, j)
            while n < top and a[i - 1 - n] == b[j - 1 - n]:
                n += 1
            left.append(n)
            n, top = 0, min(len(a) - i, len(b) - j)
            while n < top and a[i + n] == b[j + n]:
                n += 1
            right.append(n)
        keep = [n for n in batch.schema.names if not n.startswith("around")]
        yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in keep], pa.array(left, pa.int32()), pa.array(right, pa.int32())], names=[*keep, "l", "r"])


def classes(found: DataFrame) -> DataFrame:
    """(h, c, n_docs, low, mark, alone, many): the occurrences of a window with the same text around them, grouped by c.

    Only windows in two or more documents are kept, grouped exactly. ``mark`` is equal for
    classes with the same documents; ``alone`` says that the window has no other class, ``many`` that it has very many.
    """
    one = found.select("h", "c", "doc_id").distinct()
    grouped = one.groupBy("h", "c").agg(F.count("*").alias("n_docs"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.bit_xor(F.xxhash64("doc_id")).alias("mark"))
    several = grouped.groupBy("h").agg(F.min("low").alias("_lo"), F.max("high").alias("_hi"), F.count("*").alias("_n")).where("_lo < _hi").select("h", (F.col("_n") == 1).alias("alone"), (F.col("_n") > MANY_CLASSES).alias("many"))
    return written(grouped.drop("high").join(several, "h"), "classes")


def class_texts(found: DataFrame, groups: DataFrame) -> DataFrame:
    """(h, c, n_docs, low, lead, around, many) of the windows with several classes; one occurrence speaks for its class."""
    mixed = groups.where("not alone").select("h", "c", "n_docs", "low", "many")
    texts = found.join(mixed, ["h", "c"]).where("doc_id = low").groupBy("h", "c", "n_docs", "low", "many").agg(F.min(F.struct("lead", "around")).alias("t"))
    return written(texts.select("h", "c", "n_docs", "low", "t.lead", "t.around", "many"), "texts")


def class_pairs(texts: DataFrame, span: int) -> DataFrame:
    """(h, c_a, c_b, n_a, n_b, low_a, low_b, l, r) of different classes of a window that share a run of ``span`` characters, for windows with few classes."""
    few = texts.where("not many")
    side = lambda x: few.select("h", F.col("c").alias(f"c_{x}"), F.col("lead").alias(f"lead_{x}"), F.col("around").alias(f"around_{x}"), F.col("n_docs").alias(f"n_{x}"), F.col("low").alias(f"low_{x}"))
    met = side("a").join(side("b"), "h").where("c_a < c_b")
    schema = "h long, c_a long, lead_a int, n_a long, low_a long, c_b long, lead_b int, n_b long, low_b long, l int, r int"
    return met.mapInArrow(_reach, schema).where(F.col("l") + F.col("r") >= span)


def whole_spans(texts: DataFrame, span: int) -> DataFrame:
    """(h, c, n_docs, low, o, k): every run of ``span`` characters around a window that holds it, by its offset and hash, for windows with many classes.

    A short text common to many documents gives many classes that share too little.
    Grouping whole runs finds the classes that share enough without comparing any two.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, offsets, keys = [], [], []
            for row, (text, lead) in enumerate(zip(batch.column("around").to_pylist(), batch.column("lead").to_pylist())):
                for o in range(lead + 1):
                    piece = text[lead - o : lead - o + span]
                    if len(piece) == span:
                        rows.append(row)
                        offsets.append(o)
                        keys.append(xxhash.xxh3_64_intdigest(piece.encode("utf-8", "surrogatepass")) - (1 << 63))
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([*[batch.column(c).take(at) for c in ("h", "c", "n_docs", "low")], pa.array(offsets, pa.int32()), pa.array(keys, pa.int64())], names=["h", "c", "n_docs", "low", "o", "k"])

    return texts.where("many").select("h", "c", "n_docs", "low", "lead", "around").mapInArrow(run, "h long, c long, n_docs long, low long, o int, k long")


def sharing_pairs(found: DataFrame, span: int = 200) -> DataFrame:
    """Distinct (doc_a, doc_b), doc_a < doc_b, of documents that share a run of ``span`` characters."""
    groups = classes(found)
    member = found.select("h", "c", "doc_id").distinct()
    # of classes with the same documents one is enough: a long shared passage keeps many windows
    chosen = groups.where("n_docs > 1").groupBy("mark", "n_docs", "low").agg(F.min(F.struct("h", "c")).alias("k")).select("k.h", "k.c")
    inside = member.join(chosen, ["h", "c"])
    same = inside.select("h", "c", F.col("doc_id").alias("doc_a")).join(inside.select("h", "c", F.col("doc_id").alias("doc_b")), ["h", "c"]).where("doc_a < doc_b").select("doc_a", "doc_b")
    texts = class_texts(found, groups)
    across = class_pairs(texts, span).where("n_a > 1 or n_b > 1 or low_a <> low_b").select("h", "c_a", "c_b")
    runs = written(whole_spans(texts, span), "runs")
    # of the runs shared by the same classes one is enough
    shared = runs.groupBy("h", "o", "k").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("c")).alias("mark")).where("n > 1")
    one = runs.join(shared.groupBy("h", "n", "mark").agg(F.min(F.struct("o", "k")).alias("r")).select("h", "r.o", "r.k"), ["h", "o", "k"]).select("h", "o", "k", "c")
    among = one.withColumnRenamed("c", "c_a").join(one.withColumnRenamed("c", "c_b"), ["h", "o", "k"]).where("c_a < c_b").select("h", "c_a", "c_b")
    across = written(across.union(among).distinct(), "across")
    one = across.join(member.select("h", F.col("c").alias("c_a"), F.col("doc_id").alias("x")), ["h", "c_a"])
    two = one.join(member.select("h", F.col("c").alias("c_b"), F.col("doc_id").alias("y")), ["h", "c_b"]).where("x <> y")
    return same.union(two.select(F.least("x", "y"), F.greatest("x", "y"))).distinct()


def stretches(found: DataFrame, span: int) -> DataFrame:
    """Distinct (doc_id, a, b): the places, from a up to before b, that lie in a run of ``span`` characters which another document holds too.

    They overlap; every such run lies in the stretches around the windows that it keeps.
    """
    groups = classes(found)
    texts = class_texts(found, groups)
    pairs = class_pairs(texts, span)
    ends = pairs.select("h", F.col("c_a").alias("c"), F.col("n_b").alias("n"), F.col("low_b").alias("other"), "l", "r").union(pairs.select("h", "c_b", "n_a", "low_a", "l", "r"))
    lone = groups.where("n_docs = 1").select("h", "c", "low")
    partial = ends.join(lone, ["h", "c"]).where("n > 1 or other <> low").groupBy("h", "c").agg(F.max("l").alias("l"), F.max("r").alias("r"))
    runs = written(whole_spans(texts, span), "runs")
    shared = runs.groupBy("h", "o", "k").agg(F.min("low").alias("_lo"), F.max("low").alias("_hi"), F.max("n_docs").alias("_n")).where("_lo < _hi or _n > 1").select("h", "o", "k")
    wide = runs.where("n_docs = 1").join(shared, ["h", "o", "k"]).groupBy("h", "c").agg(F.max("o").alias("l"), (F.lit(span) - F.min("o")).alias("r"))
    partial = partial.unionByName(wide)
    full = groups.where("n_docs > 1").select("h", "c", F.lit(None).cast("int").alias("l"), F.lit(None).cast("int").alias("r"))
    reach = full.unionByName(partial)
    member = found.select("h", "c", "doc_id", "pos", "lead", (F.length("around") - F.col("lead")).alias("tail"))
    return member.join(reach, ["h", "c"]).select("doc_id", (F.col("pos") - F.coalesce("l", "lead")).alias("a"), (F.col("pos") + F.coalesce("r", "tail")).alias("b")).distinct()


def passages(docs: DataFrame, id_col: str, text: str, span: int = 200, anchor: int = 100) -> DataFrame:
    """(doc_id, start, end, passage): the maximal stretches of each document that ``shared_parts`` counts, with their text.

    ``start`` is the place of the first character, from 0, ``end`` the place after the
    last. Stretches that touch or overlap are one. Each text is joined once, to all
    places of its document.
    """
    line = Window.partitionBy("doc_id").orderBy("a", "b")
    places = stretches(occurrences(docs, id_col, text, span, anchor), span)
    reached = places.withColumn("m", F.max("b").over(line.rowsBetween(Window.unboundedPreceding, -1)))
    numbered = reached.withColumn("n", F.sum((F.col("m").isNull() | (F.col("a") > F.col("m"))).cast("int")).over(line.rowsBetween(Window.unboundedPreceding, 0)))
    merged = numbered.groupBy("doc_id", "n").agg(F.min("a").alias("start"), F.max("b").alias("end"))
    held = merged.groupBy("doc_id").agg(F.collect_list(F.struct("start", "end")).alias("p"))
    texts = docs.where(F.col(id_col).isNotNull() & (F.length(text) >= span)).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text).alias("text"))
    cut = F.transform("p", lambda p: F.struct(p["start"].alias("start"), p["end"].alias("end"), F.substring("text", p["start"] + 1, p["end"] - p["start"]).alias("passage")))
    return texts.join(held, "doc_id").select("doc_id", F.inline(cut))


def shared_parts(docs: DataFrame, id_col: str, text: str, span: int = 200, anchor: int = 100) -> DataFrame:
    """One row for each document: (doc_id, n_chars, n_passages, shared_chars, shared_share).

    ``shared_chars`` counts the characters within some run of at least ``span`` characters
    that another document holds too; n_passages the maximal stretches of them. Null and
    short texts have none; an empty text has share 0.
    """
    places = stretches(occurrences(docs, id_col, text, span, anchor), span)
    line = Window.partitionBy("doc_id").orderBy("a", "b")
    reached = places.withColumn("m", F.max("b").over(line.rowsBetween(Window.unboundedPreceding, -1)))
    fresh = reached.withColumn("new", (F.col("m").isNull() | (F.col("a") > F.col("m"))).cast("int")).withColumn("gain", F.greatest(F.lit(0), F.col("b") - F.greatest("a", F.coalesce("m", F.lit(0)))))
    total = fresh.groupBy("doc_id").agg(F.sum("new").alias("n_passages"), F.sum("gain").alias("shared_chars"))
    all_docs = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.coalesce(F.length(text), F.lit(0)).cast("long").alias("n_chars"))
    return all_docs.join(total, "doc_id", "left").select("doc_id", "n_chars", F.coalesce("n_passages", F.lit(0)).alias("n_passages"), F.coalesce("shared_chars", F.lit(0)).alias("shared_chars"), F.coalesce(F.col("shared_chars") / F.col("n_chars"), F.lit(0.0)).alias("shared_share"))
