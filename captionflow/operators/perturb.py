"""Perturbed instructions as column plans: phrases replaced, switched, masked or dropped.

A sentence is brought to one blank between tokens, so no line feed is left in it, and a pattern cuts
it at the phrases of its mode: every second part is a find. A find with replacements is a slot.
Slots and replacements take the order of a seeded hash instead of a random one, so every engine makes
the same variants. All of it is array expressions on the row itself: nothing is shuffled, nothing runs
in Python, and only the variants asked for are built.

Nulls: a null sentence or an empty one has no variants; a null array of instructions stays null.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from captionflow.functions import text as T
from captionflow.operators import phrases

#: From a sentence and the greatest number wanted to an array of variants.
Variants = Callable[[Column, int], Column]
#: From a sentence of single blanks to its parts (text, options): ``options`` is null for text that stays.
Cutter = Callable[[Column], Column]

# Words of one direction, and verbs after which a direction word is one.
DIRECTIONS = (
    ("left",), ("right",), ("upstairs", "up"), ("downstairs", "down"), ("forward", "straight"), ("inside",), ("outside",),
    ("around",),
)
ACTION_VERBS = ("turn", "veer", "walk", "go", "exit", "move", "continue", "head", "stop", "enter")
# Parts of which location phrases are made, phrases of one word, and endings of a side.
PLACES = ("left", "right", "bottom", "top", "front", "middle")
PREPOSITIONS = ("into", "onto", "on", "in", "at", "to")
ARTICLES = (" your", "", " the")
FILLERS = ("", " side of", " of")
EXTRA_PLACES = {"top": ("over", "above"), "bottom": ("underneath", "below"), "behind": ("behind",)}
ENDINGS = ("most", "side")
#: ``below`` replaces others but is not itself looked for.
NOT_LOOKED_FOR = ("below",)
# Words that a noun phrase of the mode must not contain.
OBJECT_FORBIDDEN = ("turn", "room", "kitchen", "cellar", "hall", "office", "garage", "cabinet")
ROOM_FORBIDDEN = ("turn",)
# English stop words.
STOP_WORDS = tuple("""a about above after again all also am an and any are as at be because been before being below between both but by can did do
does down during each few for from further had has have he her here hers him his how i if in into is it its just me more most my no nor not now of
off on once only or other our out over own same she should so some such than that the their them then there these they this those through to too
under until up very was we were what when where which while who why will with you your""".split())
#: Words of a replacement vocabulary that are carried in the plan; more raise an error.
MOST_WORDS = 100_000


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once for a row."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def listed(words: tuple[str, ...]) -> Column:
    """An array of fixed texts as one literal."""
    return F.split(F.lit("\n".join(words)), "\n") if words else F.array().cast("array<string>")


def any_of(words: tuple[str, ...]) -> str:
    return "|".join(sorted(words, key=lambda w: (-len(w), w)))


# Cutters ----------------------------------------------------------------------------------------------

def cut(text: Column, pattern: str) -> Column:
    """Parts of a text without line feeds; those at odd places are what the pattern finds."""
    return F.split(F.regexp_replace(text, pattern, "\n$0\n"), "\n")


def cut_at(text: Column, spans: Column) -> Column:
    """The same for finds of an outside parser: an ascending array of (start, end) without overlaps."""
    ends = F.concat(F.array(F.lit(0)), F.transform(spans, lambda s: s["end"].cast("int")))
    piece = lambda a, b: F.substring(text, a + 1, b - a)
    found = F.transform(spans, lambda s, i: F.array(
        piece(F.get(ends, i), s["start"].cast("int")), piece(s["start"].cast("int"), s["end"].cast("int")),
    ))
    rest = F.array(F.substring(text, F.element_at(ends, -1) + 1, F.length(text)))
    return F.concat(F.flatten(found), rest)


def offered(parts: Column, options: Callable[[Column, Column], Column]) -> Column:
    """Parts with the replacements of the finds; ``options(find, number of the find)`` may be null."""
    return F.transform(
        parts,
        lambda p, i: F.struct(
            p.alias("text"), F.when(i % 2 == 1, options(p, ((i - 1) / 2).cast("int"))).alias("options")
        ),
    )


_DIRECTION_WORDS = tuple(w for group in DIRECTIONS for w in group)
_DIRECTION = rf"(?<=(?:^| )(?:{any_of(ACTION_VERBS)}) )(?:{any_of(_DIRECTION_WORDS)})(?!\S)"


def directions(hangs_on_verb: Callable[[Column], Column] | None = None) -> Cutter:
    """Direction words right after an action verb, replaced by the words of all other directions.

    ``hangs_on_verb(sentence)`` may give the places (from 0) of tokens whose parent in a dependency
    tree is a verb (``phrases.verb_children``); direction words there count too.
    """
    def others() -> Column:
        pairs = [(w, tuple(v for v in _DIRECTION_WORDS if v not in group)) for group in DIRECTIONS for w in group]
        return F.create_map(*[x for w, rest in pairs for x in (F.lit(w), listed(rest))])

    def parts(text: Column) -> Column:
        if hangs_on_verb is None:
            return cut(text, _DIRECTION)
        words = F.split(text, " ")

        def marked(word: Column, i: Column) -> Column:
            after = F.array_contains(listed(ACTION_VERBS), F.get(words, i - 1)) & (i > 0)
            hit = F.array_contains(listed(_DIRECTION_WORDS), word)
            hit = hit & (after | F.coalesce(F.array_contains(hangs_on_verb(text), i), F.lit(False)))
            return F.when(hit, F.concat(F.lit("\n"), word, F.lit("\n"))).otherwise(word)

        return F.split(F.array_join(F.transform(words, marked), " "), "\n")

    return lambda text: offered(parts(text), lambda p, _: others()[p])


def location_phrases() -> dict[str, tuple[str, ...]]:
    made = itertools.product(PREPOSITIONS, ARTICLES, FILLERS)
    frames = [(a + b + " ", c) for a, b, c in made]
    return {
        place: EXTRA_PLACES.get(place, ()) + tuple(a + place + b for a, b in frames if place in PLACES)
        for place in (*PLACES, "behind")
    }


_ALONE = tuple(w for ws in EXTRA_PLACES.values() for w in ws if w not in NOT_LOOKED_FOR)
_LOCATION = (
    rf"(?<!\S)(?:(?:{any_of(PREPOSITIONS)})(?: your| the)? (?:{any_of(PLACES)})(?: side of| of)?"
    rf"|{any_of(_ALONE)}|(?:left|right)(?:{any_of(ENDINGS)}))(?!\S)"
)


def locations() -> Cutter:
    """Location phrases and words like ``leftmost``, replaced by the phrases of all other places."""
    groups = location_phrases()
    others = {p: tuple(w for q, ws in groups.items() if q != p for w in ws) for p in groups}
    for name, words in EXTRA_PLACES.items():
        others |= {w: others[name] for w in words}
    for side, other in (("left", "right"), ("right", "left")):
        others |= {side + e: tuple(other + f for f in ENDINGS) for e in ENDINGS}

    def options(found: Column, _: Column) -> Column:
        place = F.regexp_extract(found, rf" ({any_of(PLACES)})(?: |$)", 1)
        name = F.when(F.contains(found, F.lit(" ")), place).otherwise(found)
        return F.create_map(*[x for n, words in others.items() for x in (F.lit(n), listed(words))])[name]

    return lambda text: offered(cut(text, _LOCATION), options)


def noun_phrases(
    replaced_by: Callable[[Column, Column, Column], Column],
    forbidden: tuple[str, ...] = ROOM_FORBIDDEN,
    low: int = 2,
    high: int = 6,
    spans: Callable[[Column], Column] | None = None,
) -> Cutter:
    """Noun phrases of ``low`` to ``high`` words without forbidden texts.

    ``replaced_by(sentence, phrase, number of the phrase)`` gives the replacements. ``spans(sentence)``
    may give the finds of a parser as (start, end); without it the phrases are ``phrases.PHRASE``.
    """

    def options(text: Column) -> Callable[[Column, Column], Column]:
        return lambda p, k: F.when(
            F.size(F.split(p, " ")).between(low, high) & T.lacks_all(p, list(forbidden)), replaced_by(text, p, k)
        )

    return lambda text: offered(cut(text, phrases.PHRASE) if spans is None else cut_at(text, spans(text)), options(text))


def from_vocabulary(words: tuple[str, ...], number: int = 10, seed: int = 0) -> Callable[[Column, Column, Column], Column]:
    """``number`` different places of a vocabulary for each phrase: a start and a stride given by hash."""
    if len(words) > MOST_WORDS:
        raise ValueError(f"the vocabulary has {len(words)} words; at most {MOST_WORDS} are carried in a plan")
    n = min(number, len(words))
    if not n:
        return lambda text, phrase, k: F.array().cast("array<string>")

    def options(text: Column, phrase: Column, k: Column) -> Column:
        mark = T.hash_rank_key(seed, text, k)
        start = F.conv(F.substring(mark, 1, 8), 16, 10).cast("long")
        step = F.conv(F.substring(mark, 9, 8), 16, 10).cast("long") % max(1, len(words) // n) + 1
        every = F.sequence(F.lit(0), F.lit(n - 1))
        return F.transform(every, lambda j: F.get(listed(tuple(w.strip() for w in words)), ((start + j * step) % len(words)).cast("int")))

    return options


def by_category(categories: dict[str, str]) -> Callable[[Column, Column, Column], Column]:
    """The first known word of the phrase replaced by the words of all other categories; null without one."""
    if not categories:
        return lambda text, phrase, k: F.lit(None).cast("array<string>")

    def options(text: Column, phrase: Column, k: Column) -> Column:
        known = F.arrays_zip(listed(tuple(categories)).alias("word"), listed(tuple(categories.values())).alias("kind"))
        first = F.get(F.filter(known, lambda x: F.contains(phrase, x["word"])), F.lit(0))
        return let(first, lambda f: F.transform(
            F.filter(known, lambda x: x["kind"] != f["kind"]), lambda x: F.replace(phrase, f["word"], x["word"])
        ))

    return options


def masked(cutter: Cutter) -> Cutter:
    """The first replacement of each slot becomes a mask."""
    return lambda text: F.transform(
        cutter(text),
        lambda p: F.struct(p["text"], F.transform(F.slice(p["options"], 1, 1), T.masked).alias("options")),
    )


def combined(*cutters: Cutter) -> Cutter:
    """Slots of several cutters, the first ones first: later ones cut only the text that is left."""

    def parts(text: Column) -> Column:
        out = cutters[0](text)
        for cutter in cutters[1:]:
            out = F.flatten(F.transform(out, divided(cutter)))
        return out

    def divided(cutter: Cutter) -> Callable[[Column], Column]:
        return lambda p: F.when(p["options"].isNull(), cutter(p["text"])).otherwise(F.array(p))

    return parts


# Variants -------------------------------------------------------------------------------------------

def _numbered(parts: Column) -> Column:
    """Parts with the number of the slot at each slot's place."""
    return F.filter(F.transform(parts, lambda p, i: F.struct(i.alias("at"), p["text"], p["options"])), lambda p: p["options"].isNotNull())


def slots(text: Column, parts: Column, seed: int) -> Column:
    """Slots (h, at, text, options) in hash order; the number of a slot among all slots names it."""
    return F.sort_array(F.transform(
        F.filter(_numbered(parts), lambda p: F.size(p["options"]) > 0),
        lambda p, k: F.struct(T.hash_rank_key(seed, text, k).alias("h"), k.alias("k"), p["at"], p["text"], p["options"]),
    ))


def _combinations(n: Column, k: int, most: int) -> Column:
    """The first ``most`` choices of ``k`` places below ``n``, by their greatest place, then the next.

    They lie within the first ``k + most - 1`` places, so no more are looked at.
    """
    empty = F.array().cast("array<array<int>>")
    top = F.least(n, F.lit(k + most - 1)).cast("int")
    places = F.sequence(F.lit(0), F.greatest(top - 1, F.lit(0)))
    made = F.transform(places, lambda i: F.array(i))
    for _ in range(k - 1):
        made = F.flatten(F.transform(made, lambda c: F.transform(F.filter(places, lambda j: j < F.element_at(c, -1)), lambda j: F.concat(c, F.array(j)))))
    return F.when(n >= k, F.slice(F.sort_array(made), 1, most)).otherwise(empty)


def _rebuilt(parts: Column, put: Callable[[Column, Column], Column]) -> Column:
    """The text of the parts with ``put(place, text)`` where that isn't null."""
    return F.array_join(F.transform(parts, lambda p, i: F.coalesce(put(i, p["text"]), p["text"])), "")


def _ranked(text: Column, slot: Column, most: int, seed: int, *more: Column) -> Column:
    """The first ``most`` options of a slot in the order of their ``hash_rank_key``.

    What all options share is joined once, and only the hashes are sorted: equal ones are of equal
    options, so the first place of a hash names its option (those that come again take the same one).
    """
    def first(options: Column, shared: Column) -> Column:
        hashes = F.transform(options, lambda w: F.sha1(F.coalesce(F.concat(shared, F.lit("|"), w), shared)))
        return let(hashes, lambda hs: F.transform(
            F.slice(F.sort_array(hs), 1, most), lambda h: F.get(options, (F.array_position(hs, h) - 1).cast("int"))
        ))

    shared = F.concat_ws("|", F.lit(str(seed)), text, *more, slot["k"].cast("string"))
    return let(F.struct(slot["options"].alias("options"), shared.alias("shared")), lambda x: first(x["options"], x["shared"]))


def replaced(cutter: Cutter, count: int = 1, seed: int = 0) -> Variants:
    """``count`` slots replaced at a time. Choices of slots take turns, each with its next replacements."""

    def variants(sentence: Column, most: int) -> Column:
        def of_slots(text: Column, parts: Column, found: Column) -> Column:
            ranked = F.transform(F.slice(found, 1, count + most - 1), lambda s: F.struct(s["at"], _ranked(text, s, most, seed).alias("w")))
            return let(ranked, lambda r: turns(parts, r, F.size(found)))

        def turns(parts: Column, r: Column, n: Column) -> Column:
            def rounds(choice: Column, rank: Column) -> Column:
                product = F.lit(1)
                for j in range(count):
                    product = product * F.size(F.get(r, F.get(choice, F.lit(j)))["w"])
                return F.transform(F.sequence(F.lit(0), F.least(product, F.lit(most)) - 1), lambda t: F.struct(t.alias("t"), rank.alias("rank"), choice.alias("c")))

            def made(x: Column) -> Column:
                def put(i: Column, _: Column) -> Column:
                    out, left = F.lit(None).cast("string"), x["t"]
                    for j in range(count):
                        slot = F.get(r, F.get(x["c"], F.lit(j)))
                        out = F.when(slot["at"] == i, F.get(slot["w"], (left % F.size(slot["w"])).cast("int"))).otherwise(out)
                        left = F.floor(left / F.size(slot["w"]))
                    return out

                return _rebuilt(parts, put)

            queue = F.flatten(F.transform(_combinations(n, count, most), rounds))
            return F.transform(F.slice(F.sort_array(queue), 1, most), made)

        return _with_slots(cutter, sentence, seed, of_slots)

    return variants


def remaining(cutter: Cutter, clues: int = 1, seed: int = 0) -> Variants:
    """All slots replaced but ``clues``; none where there are no more slots than that."""

    def variants(sentence: Column, most: int) -> Column:
        def of_slots(text: Column, parts: Column, found: Column) -> Column:
            def made(kept: Column) -> Column:
                names = F.array_join(F.transform(kept, lambda i: F.get(found, i)["k"].cast("string")), ",")
                pick = F.transform(
                    F.filter(F.transform(found, lambda s, i: F.struct(i.alias("i"), s.alias("s"))), lambda x: ~F.array_contains(kept, x["i"])),
                    lambda x: F.struct(x["s"]["at"], F.get(_ranked(text, x["s"], 1, seed, names), F.lit(0)).alias("w")),
                )
                return let(F.map_from_entries(pick), lambda m: _rebuilt(parts, lambda i, _: F.try_element_at(m, i)))

            choices = _combinations(F.size(found), clues, most)
            return F.when(F.size(found) > clues, F.transform(choices, made)).otherwise(F.array().cast("array<string>"))

        return _with_slots(cutter, sentence, seed, of_slots)

    return variants


def switched(cutter: Cutter, seed: int = 0) -> Variants:
    """Two phrases change places; equal ones are passed over.

    Of the phrases equal to the first one in hash order, and of all others, only the first ``most``
    can be in the first ``most`` pairs (each has that many pairs before its own), so no more are paired.
    """

    def variants(sentence: Column, most: int) -> Column:
        def of_slots(text: Column, parts: Column, found: Column) -> Column:
            head = F.get(found, F.lit(0))["text"]
            same = F.slice(F.filter(found, lambda s: s["text"] == head), 1, most)
            rest = F.slice(F.filter(found, lambda s: s["text"] != head), 1, most)
            return let(F.sort_array(F.concat(same, rest)), lambda few: pairs(parts, few))

        def pairs(parts: Column, few: Column) -> Column:
            def before(b: Column, j: Column) -> Column:
                earlier = F.filter(few, lambda a, i: (i < j) & (a["text"] != b["text"]))
                return F.transform(earlier, lambda a: F.struct(a.alias("a"), b.alias("b")))

            def made(x: Column) -> Column:
                put = lambda i, _: F.when(x["a"]["at"] == i, x["b"]["text"]).when(x["b"]["at"] == i, x["a"]["text"])
                return _rebuilt(parts, put)

            return F.transform(F.slice(F.flatten(F.transform(few, before)), 1, most), made)

        return _with_slots(cutter, sentence, seed, of_slots)

    return variants


def _with_slots(cutter: Cutter, sentence: Column, seed: int, use: Callable[[Column, Column, Column], Column]) -> Column:
    tidy = T.spaced(sentence)
    return let(tidy, lambda text: let(cutter(text), lambda parts: let(slots(text, parts, seed), lambda found: use(text, parts, found))))


def deaf(sentence: Column, most: int) -> Column:
    """The empty text."""
    return F.slice(F.array(F.lit("")), 1, most)


def without_stop_words(sentence: Column, most: int) -> Column:
    return F.slice(F.array(T.without_stop_words(sentence, listed(STOP_WORDS))), 1, most)


Model = Callable[[str], Iterator[str]]


@dataclass(frozen=True)
class Filled:
    """Masked variants filled by a model, ``model(sentence with masks) -> iterator of sentences``.

    A model runs in Python by its nature: rows go to it in Arrow batches, with at most ``masks``
    masked sentences an instruction, and it is asked for no more sentences than are wanted.
    """

    masked: Variants
    model: Model
    masks: int = 10

    def added(self, rows: DataFrame, column: str, most: int) -> DataFrame:
        """``rows`` with each list of masked sentences in ``column`` replaced by the first sentences made of it."""
        model, schema = self.model, rows.schema

        def one(sentences: list[str]) -> list[str]:
            return list(itertools.islice(itertools.chain.from_iterable(map(model, sentences)), most))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at = batch.schema.get_field_index(column)
                made = [None if x is None else [one(y or []) for y in x] for x in batch.column(at).to_pylist()]
                yield batch.set_column(at, column, pa.array(made, pa.list_(pa.list_(pa.string()))))

        return rows.mapInArrow(run, schema)


def perturbator(
    mode: str,
    count: int = 1,
    clues: int = 1,
    mask: bool = False,
    model: Callable[[str], Iterator[str]] | None = None,
    objects: tuple[str, ...] = (),
    rooms: dict[str, str] | None = None,
    spans: Callable[[Column], Column] | None = None,
    hangs_on_verb: Callable[[Column], Column] | None = None,
    seed: int = 0,
) -> Variants | Filled:
    """The variants of a mode by its name.

    The first of these found in the name decides: direction, location, deaf, stop, object (with
    switch: two phrases change places), room, swap (a switch of any phrases), vilbert (masked phrases
    filled by ``model``). With ``remain`` in the name all slots but ``clues`` are replaced. Several
    modes joined by ``+`` are laid over each other, the first ones first.
    """
    as_object = lambda use: noun_phrases(use, OBJECT_FORBIDDEN, spans=spans)
    as_room = lambda use: noun_phrases(use, ROOM_FORBIDDEN, spans=spans)
    itself = lambda text, phrase, k: F.array(phrase)

    def made_of(name: str) -> tuple[Cutter | None, Variants | None]:
        if "direction" in name:
            return directions(hangs_on_verb), None
        if "location" in name:
            return locations(), None
        if "deaf" in name:
            return None, deaf
        if "stop" in name:
            return None, without_stop_words
        if "object" in name and "switch" in name:
            return None, switched(as_object(itself), seed)
        if "object" in name:
            return as_object(from_vocabulary(tuple(objects), seed=seed)), None
        if "room" in name:
            return as_room(by_category(rooms or {})), None
        if "swap" in name:
            return None, switched(as_room(itself), seed)
        if name == "vilbert" and model is not None:
            return as_room(itself), None
        raise ValueError(f"unknown mode {name}, or one that needs a model")

    parts = [made_of(name) for name in mode.split("+")]
    whole = [v for _, v in parts if v is not None]
    if whole:
        if len(parts) > 1 or mask or model:
            raise ValueError(f"{mode} has no slots to combine, mask or fill")
        return whole[0]
    made = [c for c, _ in parts]
    cutter = combined(*made) if len(made) > 1 else made[0]
    if mask or model:
        if count != 1:
            raise ValueError("one slot is masked at a time")
        cutter = masked(cutter)
    out = remaining(cutter, clues, seed) if "remain" in mode else replaced(cutter, count, seed)
    return Filled(out, model) if model else out


# Drivers --------------------------------------------------------------------------------------------

def variants(rows: DataFrame, instructions: str, make: Variants | Filled, most: int = 10) -> DataFrame:
    """Adds ``perturbations``: at most ``most`` variants of each instruction of the array; null for a null array."""
    if isinstance(make, Filled):
        return make.added(rows.withColumn("perturbations", _of_each(instructions, make.masked, make.masks)), "perturbations", most)
    return rows.withColumn("perturbations", _of_each(instructions, make, most))


def _of_each(instructions: str, make: Variants, most: int) -> Column:
    none = F.array().cast("array<string>")
    return F.transform(instructions, lambda s: F.when(s.isNotNull() & (s != ""), make(s, most)).otherwise(none))


def for_training(
    rows: DataFrame, make: Variants | Filled, most: int = 10, only_perturbed: bool = False, instructions: str = "instructions"
) -> DataFrame:
    """Items with their variants; with ``only_perturbed`` without the instructions and items that have none."""
    made = variants(rows, instructions, make, most)
    if not only_perturbed:
        return made
    pairs = F.filter(F.arrays_zip(F.col(instructions).alias("i"), F.col("perturbations").alias("p")), lambda x: F.size(x["p"]) > 0)
    kept = made.withColumn("_z", pairs).where(F.size("_z") > 0)
    return kept.withColumns({instructions: F.transform("_z", lambda x: x["i"]), "perturbations": F.transform("_z", lambda x: x["p"])}).drop("_z")


def for_testing(rows: DataFrame, make: Variants | Filled, instructions: str = "instructions") -> DataFrame:
    """Each instruction replaced by its first variant, if it has one, and ``corrupted`` saying which were."""
    made = variants(rows, instructions, make, 1)
    first = F.zip_with(instructions, "perturbations", lambda s, v: F.coalesce(F.get(v, F.lit(0)), s))
    return made.withColumns({"corrupted": F.transform("perturbations", lambda v: F.size(v) > 0), instructions: first}).drop("perturbations")


def variant_rows(rows: DataFrame, make: Variants | Filled, keys: list[str], most: int = 10, instructions: str = "instructions") -> DataFrame:
    """One row for each variant: keys, number of the instruction, place and text.

    Exploded as an expression: from a column, a filter on its size is inferred, and that makes all variants twice.
    """
    if isinstance(make, Filled):
        rows, made = variants(rows, instructions, make, most), F.col("perturbations")
    else:
        made = _of_each(instructions, make, most)
    lines = rows.select(*keys, F.posexplode(made).alias("instruction", "_v"))
    return lines.select(*keys, "instruction", F.posexplode("_v").alias("place", "variant"))
