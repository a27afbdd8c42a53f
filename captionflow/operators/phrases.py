"""Noun phrases: a pluggable extractor, a rule-based chunker of our own, and the choice of the best phrase."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from captionflow.functions import text as T

FORBIDDEN = ("turn",)
# Node types that are phrases, and those whose branches are passed over.
ACCEPTED = ("NP", "NNP", "FRAG")
SKIPPED = ("ADJP", "PP")
_BREAKS = frozenset("""a an the this that these those my your our his her their its is are was were be been has have had do does did will would can could may
must and or but if then so as of to in on at by for from with without into onto over under behind near past until while when where which who what
not no nor yet than too very just also only there here it they we you he she i up down out off again please go walk turn stop enter exit move
continue head take make see find get let keep""".split())


def clean(text: str) -> str:
    return text.strip(". ,\n").lower()


def accepts(text: str, low: int = 1, high: int = 5, forbidden: tuple[str, ...] = FORBIDDEN) -> bool:
    return bool(text) and "." not in text and low <= len(text.split()) <= high and not any(w in text for w in forbidden)


def walk(tree: dict, low: int = 1, high: int = 5, forbidden: tuple[str, ...] = FORBIDDEN) -> list[str]:
    """Phrases of a parse tree of {word, nodeType, children}: an accepted node ends the descent, adjective and prepositional phrases are skipped."""
    stack, out = [tree], []
    while stack:
        node = stack.pop()
        text = clean(node.get("word", ""))
        if node.get("nodeType") in ACCEPTED and accepts(text, low, high, forbidden):
            out.append(text)
            continue
        stack += [c for c in reversed(node.get("children") or []) if c.get("nodeType") not in SKIPPED]
    return out


def spans_of(tree: dict, sentence: str, kinds: tuple[str, ...], low: int = 2, high: int = 6, forbidden: tuple[str, ...] = ()) -> list[tuple[int, int]]:
    """(start, end) in the sentence of the outermost accepted nodes of the given kinds, in order."""
    out: list[tuple[int, int]] = []

    def visit(node: dict, begin: int) -> int:
        word = node.get("word", "")
        at = sentence.find(word, begin)
        if at < 0:
            return begin
        if node.get("nodeType") in kinds and low <= len(word.split()) <= high and not any(w in word for w in forbidden):
            out.append((at, at + len(word)))
            return at + len(word)
        place = at
        for child in node.get("children") or []:
            place = visit(child, place)
        return at + len(word)

    visit(tree, 0)
    return sorted(out)


#: A phrase without a parser: words that begin with a letter, up to the next function word or sign, in
#: a text of single blanks.
_WORD = rf"(?!(?:{'|'.join(sorted(_BREAKS))})(?!\S))\p{{L}}\S*+"
PHRASE = rf"(?<!\S){_WORD}(?: {_WORD})*+"


def chunks(text: Column) -> Column:
    """Rule-based stand-in for a parser: the phrases of a text, of lower-case tokens with single blanks."""
    return F.regexp_extract_all(T.spaced(text), F.lit(f"({PHRASE})"), 1)


def tree_phrases(tree: Column, low: int = 1, high: int = 5, forbidden: tuple[str, ...] = FORBIDDEN) -> Column:
    """``walk`` over parse trees in JSON, in Arrow batches, as a tree nests without bound; null or broken text gives null."""

    @F.pandas_udf("array<string>")
    def run(items: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else walk(t, low, high, forbidden) for t in _trees(items)], dtype=object)

    return run(tree)


def tree_spans(tree: Column, sentence: Column, kinds: tuple[str, ...] = ("NP",), low: int = 2, high: int = 6, forbidden: tuple[str, ...] = ()) -> Column:
    """``spans_of`` over parse trees in JSON as array<struct<start, end>>; null or broken text gives null."""

    @F.pandas_udf("array<struct<start: int, end: int>>")
    def run(items: pd.Series, texts: pd.Series) -> pd.Series:
        found = [None if t is None or s is None else spans_of(t, s, kinds, low, high, forbidden) for t, s in zip(_trees(items), texts)]
        return pd.Series([None if f is None else [{"start": a, "end": b} for a, b in f] for f in found], dtype=object)

    return run(tree, sentence)


def _trees(items: pd.Series) -> list[dict | None]:
    import json

    out = []
    for item in items:
        try:
            tree = json.loads(item)
        except (TypeError, ValueError, RecursionError):
            tree = None
        out.append(tree if isinstance(tree, dict) else None)
    return out


def extract(
    rows: DataFrame,
    sentence: str = "sentence",
    parsed: Column | None = None,
    low: int = 1,
    high: int = 5,
    forbidden: tuple[str, ...] = FORBIDDEN,
) -> DataFrame:
    """Adds ``noun_phrases``; captionless sentences have none.

    ``parsed`` may be a column of phrases found by a parser; without it ``chunks`` stands in.
    """
    text = F.col(sentence)
    found = F.transform(chunks(text) if parsed is None else parsed, T.clean_sentence)
    fits = lambda p: (p != "") & ~F.contains(p, F.lit(".")) & F.size(F.split(p, " ")).between(low, high) & T.lacks_all(p, list(forbidden))
    none = F.array().cast("array<string>")
    return rows.withColumn("noun_phrases", F.when(T.is_captionless(text), none).otherwise(F.filter(found, fits)))


_NODE = "array<struct<start: int, end: int, parent: string>>"


def dependency_nodes(tree: Column) -> Column:
    """Nodes of a dependency tree in JSON: own (start, end) in characters and the first attribute of the parent.

    The tree has ``spans`` [{start, end}], ``attributes`` and ``children``; the root's parent is ``ROOT``.
    A tree nests without bound, so it is walked in Python, by a stack. Null or broken text gives null.
    """

    @F.pandas_udf(_NODE)
    def walk_tree(items: pd.Series) -> pd.Series:
        import json

        out = []
        for item in items:
            try:
                stack, found = [(json.loads(item), "ROOT")], []
                while stack:
                    node, parent = stack.pop()
                    if not isinstance(node, dict):
                        continue
                    for span in (node.get("spans") or [])[:1]:
                        found.append({"start": int(span["start"]), "end": int(span["end"]), "parent": parent})
                    kind = str((node.get("attributes") or [""])[0])
                    stack += [(child, kind) for child in node.get("children") or []]
                out.append(sorted(found, key=lambda n: (n["start"], n["end"])))
            except (TypeError, ValueError, KeyError, AttributeError, RecursionError):
                out.append(None)
        return pd.Series(out, dtype=object)

    return walk_tree(tree)


def verb_children(text: Column, nodes: Column, verb: str = "VERB") -> Column:
    """Places (from 0) of the tokens of a text of single blanks that a node below a verb begins at."""
    starts = F.transform(F.filter(nodes, lambda n: n["parent"] == verb), lambda n: n["start"])
    return F.transform(starts, lambda s: F.length(F.regexp_replace(F.substring(text, F.lit(1), s), "[^ ]", "")))


def best(phrases: Column, known: Column, forbidden: list[str], seed: int, *key: Column) -> Column:
    """One phrase: without forbidden words, of those with a known object if there are any, by seeded hash; empty if none is left."""
    allowed = F.filter(phrases, lambda p: T.lacks_all(p, forbidden))
    preferred = F.filter(allowed, lambda p: T.contains_any(p, known))
    pool = F.when(F.size(preferred) > 0, preferred).otherwise(allowed)
    pick = F.array_min(F.transform(pool, lambda p: F.struct(T.hash_rank_key(seed, *key, p).alias("h"), p.alias("p"))))
    return F.coalesce(pick["p"], F.lit(""))


def vocabulary(raw: Column, scenes: Column) -> Column:
    """Distinct category names of a raw category text and a scene name, sorted."""
    return F.array_sort(F.array_distinct(F.concat(T.raw_categories(raw), F.filter(F.array(T.scene_name(scenes)), lambda x: F.length(x) > 2))))


def related(pairs: DataFrame, relations: DataFrame) -> DataFrame:
    """Adds ``same``: whether a and b are equal or related either way in ``relations`` (word, related)."""
    both = relations.select("word", "related").union(relations.select("related", "word")).distinct().withColumn("_r", F.lit(True))
    return pairs.join(both, (F.col("a") == F.col("word")) & (F.col("b") == F.col("related")), "left").withColumn("same", (F.col("a") == F.col("b")) | F.coalesce("_r", F.lit(False))).drop("word", "related", "_r")


Tagger = Callable[[str], list[tuple[str, str]]]
TAGS = ("NN", "NNS", "NNP", "VB", "JJ", "RB", "CD")
NOT_HIGHLIGHTED = ("next", "then", "there", "just")


def highlighted(sentence: str, tagger: Tagger, tags: tuple[str, ...] = TAGS, forbidden: tuple[str, ...] = NOT_HIGHLIGHTED) -> list[str]:
    """The words of a sentence with one of the tags, in order. ``tagger`` gives (word, tag) pairs."""
    return [w for w, t in tagger(sentence.lower()) if t in tags and w not in forbidden]


def highlights(rows: DataFrame, column: str, tagger: Tagger, tags: tuple[str, ...] = TAGS, perturbations: str | None = None) -> DataFrame:
    """Adds ``highlights`` for each instruction of an array and, if named, ``perturbation_highlights`` for each of its perturbations."""

    def one(items: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else [highlighted(s, tagger, tags) for s in x] for x in items], dtype=object)

    def two(items: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else [[highlighted(s, tagger, tags) for s in y] for y in x] for x in items], dtype=object)

    out = rows.withColumn("highlights", F.pandas_udf(one, "array<array<string>>")(column))
    return out if perturbations is None else out.withColumn("perturbation_highlights", F.pandas_udf(two, "array<array<array<string>>>")(perturbations))


def batches_of(values: list, n: int) -> Iterator[list]:
    for i in range(0, len(values), n):
        yield values[i : i + n]
