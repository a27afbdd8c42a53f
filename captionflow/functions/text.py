"""Scalar text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Punctuation signs of the ASCII set.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_WHITE = " \t\n\r\u000b\f"


def is_empty(text: Column) -> Column:
    """True if only full stops, commas, blanks and line feeds are left out; null counts as empty."""
    return F.btrim(F.coalesce(text, F.lit("")), F.lit("., \n")) == ""


def strip(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def is_captionless(text: Column) -> Column:
    """True if only white space is there; ``"."`` is a caption here. Null counts as captionless."""
    return strip(F.coalesce(text, F.lit(""))) == ""


def is_punctuation(text: Column) -> Column:
    """True for a text of only punctuation and white space, at least one sign."""
    return (text != "") & (F.translate(text, PUNCTUATION + _WHITE, "") == "")


def photo_key(listing: Column, photo: Column) -> Column:
    """``listing-photo``; null if either is null."""
    return F.concat(listing.cast("string"), F.lit("-"), photo.cast("string"))


def photo_of_key(key: Column) -> Column:
    return F.split_part(key, F.lit("-"), F.lit(2)).try_cast("long")


def photo_of_path(path: Column) -> Column:
    """Photo id from a file named ``listing-photo.ext``."""
    return F.regexp_extract(path, r"(?:^|/)\d+[-_](\d+)\.[^./]+$", 1).try_cast("long")


def photo_path(folder: str, listing: Column, photo: Column) -> Column:
    return F.concat(F.lit(folder + "/"), photo_key(listing, photo), F.lit(".jpg"))


def caption_items(caption: Column) -> Column:
    """A caption as a one-element array; white space alone becomes the empty text."""
    return F.array(F.when(is_captionless(caption), F.lit("")).otherwise(caption))


def clean_sentence(text: Column) -> Column:
    return F.lower(F.btrim(text, F.lit(". ,\n")))


def clean_category(text: Column) -> Column:
    """Without semicolons, question marks, digits and brackets around words; one pass over double blanks."""
    bare = F.regexp_replace(F.regexp_replace(text, r"[;?0-9]", ""), r"\((.*?)\)", "$1")
    return F.trim(F.replace(bare, F.lit("  "), F.lit(" ")))


def scene_name(text: Column) -> Column:
    """``/a/bow_window/indoor 12`` to ``bow window``."""
    spaced = F.regexp_replace(F.replace(F.substring(text, 4, 1_000_000), F.lit("_"), F.lit(" ")), "[0-9]", "")
    return F.trim(F.split_part(F.trim(spaced), F.lit("/"), F.lit(1)))


def raw_categories(text: Column, least: int = 3) -> Column:
    """The cleaned names between slashes of either kind that have at least ``least`` characters."""
    parts = F.split(F.replace(text, F.lit("\\"), F.lit("/")), "/")
    return F.filter(F.transform(parts, clean_category), lambda x: F.length(x) >= least)


def slug(text: Column) -> Column:
    return F.sha1(text)


def location_slug(text: Column) -> Column:
    return F.lower(F.replace(F.replace(text, F.lit(" "), F.lit("-")), F.lit(",")))


def vocabulary_line(line: Column) -> Column:
    return F.lower(F.trim(F.split_part(line, F.lit(","), F.lit(1))))


def place_line(line: Column, first: int, second: int, unquote_to: str = "", dashes: bool = True, suffix: str = "") -> Column:
    """Two comma fields of a place list joined by a blank, quotes and slashes replaced (a plain split: quoted commas also cut)."""
    field = lambda i: F.split_part(line, F.lit(","), F.lit(i))
    bare = F.regexp_replace(field(first), "['/\"]", unquote_to)
    bare = F.replace(bare, F.lit("-"), F.lit(" ")) if dashes else bare
    other = F.regexp_replace(field(second), "['/\"]", "") if dashes else field(second)
    return F.concat(bare, F.lit(" "), other, F.lit(suffix))


def tokens(text: Column) -> Column:
    """Words and single other signs, in order."""
    return F.regexp_extract_all(text, F.lit(r"(?U)(\w+|[^\w\s])"), 1)


def spaced(text: Column) -> Column:
    """Lower-case tokens with one blank between them."""
    return F.array_join(tokens(F.lower(text)), " ")


def token_count_between(text: Column, low: int, high: int) -> Column:
    return F.size(tokens(text)).between(low, high)


def lacks_all(text: Column, words: list[str]) -> Column:
    """True if none of the words is a substring."""
    return F.forall(F.array(*[F.lit(w) for w in words]), lambda w: ~F.contains(text, w)) if words else F.lit(True)


def contains_any(text: Column, words: Column) -> Column:
    """True if any of an array of words is a substring."""
    return F.exists(words, lambda w: F.contains(text, w))


def sentence_starts(text: Column) -> Column:
    """Array of (text, start) of the parts between ``". "``."""
    parts = F.split(text, r"\. ")
    grown = F.aggregate(parts, F.array().cast("array<struct<text: string, start: int>>"), lambda acc, p: F.concat(acc, F.array(F.struct(p.alias("text"), F.coalesce(F.try_element_at(acc, F.lit(-1))["start"] + F.length(F.try_element_at(acc, F.lit(-1))["text"]) + 2, F.lit(0)).alias("start")))))
    return grown


def found_at(text: Column, pattern: str) -> Column:
    """Array of (text, start, end) of all finds of a pattern, in characters from 0; start and end as in a slice.

    The pattern must have no groups of its own numbers; a find may not be empty. Offsets come from the
    lengths of the parts between the finds.
    """
    found = F.regexp_extract_all(text, F.lit(f"({pattern})"), 1)
    between = F.split(text, pattern, -1)
    step = F.zip_with(F.slice(between, F.lit(1), F.size(found)), found, lambda b, f: F.struct(F.length(b).alias("gap"), f.alias("text")))
    none = F.array().cast("array<struct<text: string, start: int, end: int>>")

    def add(acc: Column, x: Column) -> Column:
        start = F.coalesce(F.try_element_at(acc, F.lit(-1))["end"], F.lit(0)) + x["gap"]
        return F.concat(acc, F.array(F.struct(x["text"].alias("text"), start.alias("start"), (start + F.length(x["text"])).alias("end"))))

    return F.aggregate(step, none, add)


def replace_first(text: Column, word: Column, other: Column) -> Column:
    at = F.instr(text, word)
    return F.when(at > 0, F.concat(F.substring(text, F.lit(1), at - 1), other, F.substring(text, at + F.length(word), F.length(text)))).otherwise(text)


def masked(text: Column) -> Column:
    """The words of a segment replaced by one mask; the sign next to it on either side stays."""
    return F.regexp_replace(text, r"(?U)^(\W)*.*\w+(\W)*$", "$1[MASK]$2")


def keep_outer_space(text: Column, inner: Column) -> Column:
    """``inner`` with the white-space sign that ``text`` begins and ends with."""
    return F.concat(F.regexp_extract(text, r"^\s", 0), F.trim(inner), F.regexp_extract(text, r"\s$", 0))


def without_stop_words(text: Column, stop_words: Column) -> Column:
    """The tokens that aren't stop words, each with the white space after it."""
    pieces = F.regexp_extract_all(text, F.lit(r"(?U)((?:\w+|[^\w\s])\s*)"), 1)
    return F.array_join(F.filter(pieces, lambda p: ~F.array_contains(stop_words, F.lower(strip(p)))), "")


def hash_rank_key(seed: int, *parts: Column) -> Column:
    """A text to order by in place of a random choice, equal in any engine with SHA-1."""
    return F.sha1(F.concat_ws("|", F.lit(str(seed)), *[p.cast("string") for p in parts]))
