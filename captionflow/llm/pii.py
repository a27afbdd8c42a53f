"""Personal information in free text: found, and replaced by typed placeholders.

Weak supervision. Patterns, word lists and contexts vote on candidate spans. A first pass
over all texts learns the cues beside names. A second one counts in which contexts each
word stands, which makes the gazetteers. A third pass counts the vote patterns of all
candidates; expectation-maximisation over that small table estimates how reliable each
labeler is, and a logistic span classifier is trained on the resulting soft labels. What
the driver holds is the pattern table, word filters and the cues, never texts or the
counts of all words.
"""

from __future__ import annotations

import re as plain_re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex as re
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from captionflow.session import discard, spread, written

KINDS = ("email", "phone", "idnum", "address", "name")
#: Bits of a word filter for each word it holds, places of a word in it, least size and most (256 MB).
BITS_A_WORD, PLACES, LEAST_BITS, MOST_BITS = 16, 4, 1 << 20, 1 << 31
#: Weight of the span classifier's penalty; small, as rare vote patterns must keep a say.
RIDGE = 1e-5

# Common given names (seed gazetteer), titles and cue words in the ten languages.
GIVEN = frozenset("""adam agnes ahmed aiko alan albert alex alice alina amelie amir ana andrea andrei anika anita anna anton antonio
arjun arthur astrid barbara beatriz ben bruno callum camille carla carlos carmen cecilia charles charlotte chiara chloe clara claire
dagmar daniel david diana diego dimitri elena elif elin elisa emil emma emre erik eva fatima fiona francesca frank freya gabriel
george giulia goran hana hanna hans helena henrik hugo ibrahim igor ilse ines ingrid irina isabel ivan jan jana joao johan john jonas
jose julia julian karin katja kwame lars laura leila lena leo lorenzo lucas luca lucia luis magda maeve marco maria marie marta martin mateo
maya michael miguel mirela mohamed nadia natalia nikolai nina noor olga oliver oskar paul paula paulina pedro peter pierre piotr priya
rafael robert rosa rosalie sara saskia sergei simon sofia sophie stefan susanne sven tamar thomas tomas tom ulrike vera viktor vikram
wanda ximena yuki yusuf zofia""".split())
TITLES = frozenset("mr mrs ms miss dr prof herr frau monsieur madame mme mlle señor señora senor senora sr sra signor signora senhor senhora mevrouw meneer pan pani don doña".split())
#: Seed cues: one or two words after which a person is named. Others, and those after a name, are learned (``learn_cues``).
BEFORE = frozenset("host hostess called named ask contact call praise cleaner neighbour owner best regards cheers love appelez contactez kontaktieren llamen grüße gruße grusse saludos cordialement dziękuję".split()) | frozenset(["name is", "m appelle", "ich heiße", "ich heisse", "me llamo", "mi chiamo", "chamo me", "jag heter", "ik heet", "nazywam się", "меня зовут", "thank you", "thanks to"])
#: Uses with a seed name and share of seed names among the capitalised words that a cue needs.
CUE_USES, CUE_SHARE = 8, 0.25
#: Words that make a neighbouring capitalised word a place, street, building, product or business.
PLACE_BEFORE = frozenset("café cafe hotel restaurant bar lake mount port saint st rue calle avenida plaza via rua ulica the der die das le la el".split())
#: Before these words' nouns no person is meant, however the sentence goes on.
DETERMINERS = frozenset("the a an our my this der die das unser unsere dieser diese mein meine le la les notre cette ce mon ma el los las nuestro nuestra este esta mi il lo i gli nostra nostro o os a as nosso nossa het de onze det den vår vårt".split())
PLACE_AFTER = frozenset("street st avenue ave road rd lane close terrace way tower bay house museum park beach bridge square station cafe café hotel bar hall market church hill island river lake court drive place gardens street's".split())
DIGIT_WORDS = frozenset("""zero oh one two three four five six seven eight nine null eins zwei drei vier fünf sechs sieben acht neun
zéro un deux trois quatre cinq sept huit neuf cero uno dos tres cuatro cinco seis siete ocho nueve""".split())
CUES = {
    "email": frozenset("mail email e-mail write contact contacto contact kontakt kontaktieren schreibt escriban écrivez ecrivez reply bookings under".split()),
    "phone": frozenset("call phone tel telephone mobile cell whatsapp reach reply bookings appelez joindre llamar llamen móvil movil handy unter erreichbar telefon téléphone teléfono number".split()),
    "idnum": frozenset("passport id licence license tax social security identity card ssn ausweis steuernummer personalausweis pasaporte dni passeport identité identite nif nie codice fiscale bsn personnummer pesel holder".split()),
    "address": frozenset("address at to behind bell post drove parking adresse anschrift dirección direccion zur au nos en dejó dejo déposés deposes ring taxi indirizzo".split()),
}
NOT_CUES = frozenset("order booking reference permit code room bus tram coordinates rated wifi paid payé paye zahlten pagamos licence-plate floor minutes password türcode turcode código codigo".split())
STOP_IN_STREET = frozenset("minutes minute nights night guests guest people beds bed km m2 mbit euros stars the is are was from and for in on by times min hours hour a an of to room rooms x".split())

_WORD = plain_re.compile(r"[^\W\d_]+")
#: Splits a text into what lies between its words, at even places, and its words, at odd places.
_PARTS = plain_re.compile(r"([^\W\d_]+)")
_DIGIT = plain_re.compile(r"\d")
_AT = r"(?:\s?@\s?|\s?[(\[{<]\s?at\s?[)\]}>]\s?|\s(?:at|arroba|chez)\s(?=[\w-]+\s(?:dot|punkt|punto|point)\s))"
_DOT = r"(?:\.|\s?[(\[{<]\s?dot\s?[)\]}>]\s?|\s(?:dot|punkt|punto|point)\s)"
_EMAIL = re.compile(rf"(?<![\w.+-])[\w][\w.+-]*{_AT}[\w-]+(?:{_DOT}[\w-]+)+", re.I)
_PHONE = re.compile(
    r"(?<![\w+.,-])(?:(?:\+\d{1,4}|00\d{2})[\s.()/-]{0,2}\d(?:[\s.()/-]{0,2}\d){6,11}|\(\d{3}\)\s?\d{3}[\s.-]\d{4}|\d{3}(?P<s>[ .-])\d{3}(?P=s)\d{4}|0\d(?:[\s./-]?\d){7,10})(?![\w]|-\p{L}|[.,]\d)"
)
_DIGITS = "(?:" + "|".join(sorted(DIGIT_WORDS, key=len, reverse=True)) + ")"
_SPOKEN = re.compile(rf"(?<!\w){_DIGITS}(?:[\s,-]+{_DIGITS}){{5,}}(?!\w)", re.I)
_ID = re.compile(r"(?<![\w.+-])(?:\p{L}{1,2}\d{6,9}\p{L}?|\p{L}{2}(?:\s\d{3}){3}|\d{7,9}-?\p{L}|\d{3}-\d{2}-\d{4}|\d{3}\.\d{3}\.\d{3}-\d{2})(?![\w]|[-.]\d)", re.I)
#: Bare digits: a number of a person only where the words before it say so.
_BARE = re.compile(r"(?<![\w+.,:/#-])\d{8,12}(?![\w]|[-.,:/]\d)")
_STREET = (
    r"street|st\.?|avenue|ave\.?|road|rd\.?|lane|ln\.?|close|terrace|way|drive|court|place|square|crescent|grove|boulevard|blvd\.?|row|walk|mews|gardens"
)
_ADDRESS = re.compile(
    rf"(?<![\w/.,:-])(?<!\d\s)(?:flat\s\w{{1,4}},?\s)?\d{{1,4}}\p{{L}}?,?\s(?P<w>(?:[\p{{L}}'’]+\s){{1,3}})(?:{_STREET})(?!\w)(?:,\s(?:apt|flat|unit)\.?\s\w{{1,4}})?"
    r"|(?<![\w/.,:-])\d{1,4}(?:\s?(?:bis|ter))?,?\s(?:rue|avenue|av\.|boulevard|bd|place|chemin|impasse|allée|quai|route)\s(?:d[eu]s?\s|la\s|le\s|les\s|[dl]['’])*[\p{L}'’-]+(?:\s(?-i:\p{Lu})[\p{L}'’-]+)*"
    r"|(?<!\w)\p{L}[\p{L}-]+(?:straße|strasse|str\.|weg|gasse|platz|allee|damm|ufer|straat|laan|gracht|kade|plein|gatan|vägen|gränd)\s\d{1,4}\p{L}?(?!\w)"
    r"|(?<!\w)(?:calle|c/|avenida|avda\.|plaza|paseo|via|viale|piazza|corso|rua|travessa|praça|ul\.|ulica|ул\.|улица|проспект)\s?(?:d[aeo]l?s?\s|l[ao]s?\s)*[\p{L}'’-]+(?:\s[\p{L}'’-]+)?,?\s(?:n[º°]\s?|д\.\s?)?\d{1,4}(?!\w)(?:,\s\d{1,2}[º°])?",
    re.I,
)
#: Words for a number, whose full stop ends no sentence.
_SHORT = plain_re.compile(r"\b(?:no|nr|núm|num|n[º°]|tel|id)\. ", plain_re.I)
#: Characters before a number, address or name in which its context is looked for.
CONTEXT_CHARS = 45


def _near(text: str, start: int, width: int = CONTEXT_CHARS) -> list[str]:
    """The lower-case words just before a place, within its sentence and ``width`` characters."""
    left = text[max(0, start - width) : start]
    left = _SHORT.sub(lambda m: m[0].replace(".", " "), left)
    cut = max(left.rfind(". "), left.rfind("! "), left.rfind("? "), left.rfind("\n"), left.rfind(">"))
    return [w.lower() for w in _WORD.findall(left[cut + 1 :])]


def filter_bits(n_words: int) -> int:
    """Size of a filter of ``n_words`` words as a power of two; at this load fewer than 3 of 1000 other words pass."""
    bits = LEAST_BITS
    while bits < BITS_A_WORD * n_words:
        bits *= 2
    if bits > MOST_BITS:
        raise ValueError(f"{n_words} words need a filter of {bits} bits; at most {MOST_BITS} are sent to the executors")
    return bits


def word_places(word: str, bits: int) -> list[int]:
    """The places of a word in a filter: both halves of its hash, the second one stepped; the same as in ``_filter_of``."""
    h = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"), seed=42)
    return [((h & 0xFFFFFFFF) + i * (h >> 32)) % bits for i in range(PLACES)]


def _filter_of(words: DataFrame, n_words: int) -> bytes:
    """A filter of the distinct words (word), put together in the executors from bit planes of 4 KB each."""
    bits = filter_bits(n_words)
    h = F.xxhash64("word")
    place = F.explode(F.array(*[F.pmod(h.bitwiseAND(F.lit(0xFFFFFFFF)) + F.shiftrightunsigned(h, 32) * i, F.lit(bits)) + 1 for i in range(PLACES)]))
    places = words.select(place.alias("p"))
    planes = places.groupBy(F.bitmap_bucket_number("p").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("plane"))
    out = np.zeros(bits // 8, np.uint8)
    for row in planes.toLocalIterator():
        part = np.frombuffer(row["plane"], np.uint8)
        at = (row["b"] - 1) * 4096
        out[at : at + 4096] = part[: len(out) - at]
    return out.tobytes()


class Lexicon:
    """Word filters sized by their words: words that stand mostly where persons are named, and common words."""

    def __init__(self, names: bytes = b"", common: bytes = b"", before: frozenset[str] = BEFORE, after: frozenset[str] = frozenset()) -> None:
        self.names, self.common = np.frombuffer(names, np.uint8), np.frombuffer(common, np.uint8)
        self.before, self.after = before, after
        self.before_last = frozenset(cue.split()[-1] for cue in before)
        self.after_first = frozenset(cue.split()[0] for cue in after)
        self.flags: dict[str, int] = {}

    def parts(self) -> tuple[bytes, bytes, frozenset[str], frozenset[str]]:
        return self.names.tobytes(), self.common.tobytes(), self.before, self.after

    def cue_before(self, words: list[str], i: int) -> bool:
        """Whether a cue ends before the word at place i."""
        if not i:
            return False
        one = words[i - 1].lower()
        return one in self.before or i > 1 and f"{words[i - 2].lower()} {one}" in self.before

    def cue_after(self, words: list[str], j: int) -> bool:
        """Whether a cue follows the word before place j."""
        one = words[j].lower() if j < len(words) else ""
        return one in self.after or j + 1 < len(words) and f"{one} {words[j + 1].lower()}" in self.after

    @staticmethod
    def holds(planes: np.ndarray, word: str) -> bool:
        return len(planes) > 0 and all(planes[b >> 3] >> (b & 7) & 1 for b in word_places(word, 8 * len(planes)))

    def flag(self, word: str) -> int:
        """1 gazetteer, 2 seed name, 4 common word, 8 title, 16 digit word, 32 cue before a name, 64 single initial, 128 cue after a name."""
        got = self.flags.get(word)
        if got is None:
            if len(self.flags) > 400_000:
                self.flags.clear()
            low = word.lower()
            got = (1 if self.holds(self.names, low) else 0) | (2 if low in GIVEN else 0) | (4 if self.holds(self.common, low) else 0) | (8 if low in TITLES else 0) | (16 if low in DIGIT_WORDS else 0) | (32 if low in self.before_last else 0) | (64 if len(word) == 1 and word.isupper() else 0) | (128 if low in self.after_first else 0)
            self.flags[word] = got
        return got

    def flags_of(self, words: list[str]) -> list[int]:
        get = self.flags.get
        return [f if (f := get(w)) is not None else self.flag(w) for w in words]


def one_case(text: str) -> bool:
    return text.islower() or text.isupper()


def learn_cues(texts: DataFrame) -> tuple[frozenset[str], frozenset[str]]:
    """Cues before and after a person: one or two words beside which a capitalised word is often a seed name.

    They are labelers' patterns, counted over all texts; however many reach the shares are kept.
    A seed name counts in either role however it is cued.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uses, seeds = Counter(), Counter()

        def rows() -> pa.RecordBatch:
            cols = [x[0] for x in uses], [x[1] for x in uses], list(uses.values()), [seeds[x] for x in uses]
            for c in (uses, seeds):
                c.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.bool_(), pa.string(), pa.int64(), pa.int64()))], names=["left", "cue", "n", "seeds"])

        for batch in batches:
            for text in batch.column("text").to_pylist():
                if one_case(text):
                    continue
                parts = _PARTS.split(text)
                words, n = parts[1::2], len(parts) // 2
                beside, named = [], []
                for i in [i for i, w in enumerate(words) if not w.islower()]:
                    if len(words[i]) < 2 or not words[i][0].isupper():
                        continue
                    at = len(beside)
                    if i and parts[2 * i] in (" ", ", ", ": "):
                        one = words[i - 1].lower()
                        beside.append((True, one))
                        if i > 1:
                            beside.append((True, f"{words[i - 2].lower()} {one}"))
                    k = i + 1
                    if k < n and words[k][0].isupper() and parts[2 * k] == " ":
                        k += 1
                    if k < n and parts[2 * k] in (" ", ", ", "'", "’"):
                        one = words[k].lower()
                        beside.append((False, one))
                        if k + 1 < n:
                            beside.append((False, f"{one} {words[k + 1].lower()}"))
                    if words[i].lower() in GIVEN:
                        named += beside[at:]
                uses.update(beside)
                seeds.update(named)
            if len(uses) > 200_000:
                yield rows()
        yield rows()

    made = texts.select("text").where("text is not null").mapInArrow(run, "left boolean, cue string, n long, seeds long").groupBy("left", "cue").agg(F.sum("n").alias("n"), F.sum("seeds").alias("seeds"))
    enough = (F.col("seeds") >= CUE_USES) & (F.col("seeds") >= F.col("n") * CUE_SHARE)
    first, last = F.substring_index("cue", " ", 1), F.substring_index("cue", " ", -1)
    names = sorted(GIVEN | TITLES)
    chosen = written(made.where(enough & ~first.isin(names) & ~last.isin(names)), "cues")
    pairs = chosen.where(F.col("cue").contains(" ")).withColumn("one", F.when(F.col("left"), last).otherwise(first))
    # a single word must be a cue beyond the pairs of words that are cues already
    held = pairs.groupBy("left", F.col("one").alias("cue")).agg(F.sum("n").alias("pair_n"), F.sum("seeds").alias("pair_seeds"))
    beyond = [(F.col(c) - F.coalesce(f"pair_{c}", F.lit(0))).alias(c) for c in ("n", "seeds")]
    single = chosen.where(~F.col("cue").contains(" ")).join(held, ["left", "cue"], "left").select("left", "cue", *beyond).where(enough).select("left", "cue")
    # pairs of a word that is a cue alone say nothing more and stay behind
    rest = pairs.join(single.withColumnRenamed("cue", "one"), ["left", "one"], "left_anti").select("left", "cue")
    kept = [(r["left"], r["cue"]) for r in single.unionByName(rest).collect()]
    discard(chosen)
    return BEFORE | frozenset(c for left, c in kept if left), frozenset(c for left, c in kept if not left)


def context_counts(texts: DataFrame, before: frozenset[str] = BEFORE) -> DataFrame:
    """(word, n, low, cue) over all texts: how often each word stands at all, in lower case in a mixed-case text, and where a person is named."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mixed, single, cues = Counter(), Counter(), Counter()

        def rows() -> pa.RecordBatch:
            total: dict[str, list[int]] = {}
            for w, n in mixed.items():
                at = total.setdefault(w.lower(), [0, 0, 0])
                at[0] += n
                if w.islower():
                    at[1] += n
            for w, n in single.items():
                total.setdefault(w, [0, 0, 0])[0] += n
            for w, n in cues.items():
                total.setdefault(w, [0, 0, 0])[2] += n
            cols = list(zip(*total.values())) or [(), (), ()]
            out = pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), *[pa.array(c, pa.int64()) for c in cols]], names=["word", "n", "low", "cue"])
            for c in (mixed, single, cues):
                c.clear()
            return out

        lexicon = Lexicon(before=before)
        for batch in batches:
            for text in batch.column("text").to_pylist():
                if "@" in text or "at)" in text or "at]" in text or "at}" in text:
                    text = _EMAIL.sub(" ", text)
                words = _WORD.findall(text)
                alike = one_case(text)
                if alike:
                    single.update([w.lower() for w in words])
                else:
                    mixed.update(words)
                for i, f in [(i, f) for i, f in enumerate(lexicon.flags_of(words)) if f & 42]:
                    w = words[i]
                    if f & 40 and i + 1 < len(words) and (f & 8 or lexicon.cue_before(words, i + 1)):
                        k = i + 2 if lexicon.flag(words[i + 1]) & 72 and i + 2 < len(words) else i + 1
                        if alike or words[k][0].isupper():
                            cues[words[k].lower()] += 1
                            if not alike and k + 1 < len(words) and words[k + 1][0].isupper() and words[k] + " " + words[k + 1] in text:
                                cues[words[k + 1].lower()] += 1
                    elif f & 2 and i + 1 < len(words) and not alike and w[0].isupper() and words[i + 1][0].isupper() and w + " " + words[i + 1] in text:
                        cues[words[i + 1].lower()] += 1
            if len(mixed) + len(single) > 200_000:
                yield rows()
        yield rows()

    made = texts.select("text").where("text is not null").mapInArrow(run, "word string, n long, low long, cue long")
    return made.groupBy("word").agg(F.sum("n").alias("n"), F.sum("low").alias("low"), F.sum("cue").alias("cue"))


def learn_lexicon(texts: DataFrame, least: int = 2, name_share: float = 0.25, common_share: float = 0.02) -> Lexicon:
    """Word filters from the contexts of all words: gazetteer words stand where persons are named in at least ``name_share`` of their uses.

    A word needs ``least`` uses of a kind to be held by its filter: one use says nothing about a word.
    """
    before, after = learn_cues(texts)
    counts = written(context_counts(texts, before).where(f"n >= {least}"), "contexts")
    names = (F.col("cue") >= least) & (F.col("cue") >= F.col("n") * name_share) & (F.col("low") <= F.col("n") * 0.2) & (F.length("word") > 1)
    common = (F.col("low") >= least) & (F.col("low") >= F.col("n") * 0.2) & (F.col("cue") <= F.col("n") * common_share)
    sizes = counts.agg(F.count_if(names).alias("names"), F.count_if(common).alias("common")).first()
    # what comes to the driver are the filters, never the words
    made = [_filter_of(counts.where(which).select("word"), sizes[name]) for name, which in (("names", names), ("common", common))]
    discard(counts)
    return Lexicon(*made, before, after)


def candidates(text: str | None, lexicon: Lexicon) -> list[tuple[str, int, int, tuple[int, ...]]]:
    """(kind, start, end, votes) of candidate spans; a vote is 1 for, -1 against, 0 none."""
    if not text:
        return []
    out: list[tuple[str, int, int, tuple[int, ...]]] = []
    words = _WORD.findall(text)
    flags = lexicon.flags_of(words)
    taken: list[tuple[int, int]] = []
    digits = _DIGIT.search(text)
    if digits or hides_mail(text):
        for m in _EMAIL.finditer(text) if hides_mail(text) else ():
            near = _near(text, m.start())
            plain = "@" in m[0] and " " not in m[0]
            host = m[0].rpartition("@")[2] if "@" in m[0] else m[0]
            out.append(("email", m.start(), m.end(), (1 if plain else 0, 1 if "." in host or "dot" in host.lower() else -1, 1 if CUES["email"] & set(near) else 0)))
            taken.append(m.span())
        for m in _ADDRESS.finditer(text) if digits else ():
            if any(a < m.end() and m.start() < b for a, b in taken):
                continue
            between = (m["w"] or "").split()
            if any(w.lower() in STOP_IN_STREET for w in between):
                continue
            capital = 1 if one_case(text) or any(w[0].isupper() for w in _WORD.findall(m[0])) else -1
            near = set(_near(text, m.start()))
            out.append(("address", m.start(), m.end(), (1, capital, -1 if NOT_CUES & set(list(near)[-2:]) else 1 if CUES["address"] & near else 0)))
            taken.append(m.span())
        numbers = [("idnum", m) for m in _ID.finditer(text)] + [("phone", m) for m in _PHONE.finditer(text)]
        for m in _BARE.finditer(text):
            near = _near(text, m.start())
            kinds = [k for k in ("idnum", "phone") if CUES[k] & set(near[-5:])]
            if kinds and not NOT_CUES & set(near) and not any(n.start() < m.end() and m.start() < n.end() for _, n in numbers):
                numbers.append((kinds[0], m))
        for kind, m in sorted(numbers, key=lambda x: x[1].start()):
            if any(a < m.end() and m.start() < b for a, b in taken):
                continue
            near = _near(text, m.start())
            told = {k: bool(CUES[k] & set(near)) for k in ("phone", "idnum")}
            both = len({k for k, n in numbers if n.start() < m.end() and m.start() < n.end()}) > 1
            if both:
                kind = "phone" if told["phone"] and not told["idnum"] else "idnum"
            against = bool(NOT_CUES & set(near[-4:])) and not told[kind]
            if kind == "idnum":
                mixed = bool(re.search(r"\p{L}", m[0]))
                out.append(("idnum", m.start(), m.end(), (1 if mixed or re.search(r"[-. ]", m[0]) else 0, 1 if told["idnum"] else -1 if told["phone"] else 0, -1 if against else 0)))
            else:
                strong = m[0][0] in "+(" or m[0].startswith("0")
                out.append(("phone", m.start(), m.end(), (1 if strong else 0, 1 if told["phone"] else -1 if told["idnum"] else 0, -1 if against else 0)))
            taken.append(m.span())
    if sum(1 for f in flags if f & 16) >= 6:
        for m in _SPOKEN.finditer(text):
            near = set(_near(text, m.start()))
            out.append(("phone", m.start(), m.end(), (0, 1 if CUES["phone"] & near else 0, -1 if NOT_CUES & near else 0)))
            taken.append(m.span())
    if _may_name(words, flags, text, lexicon):
        out += _names(text, lexicon, taken)
    return out


def _may_name(words: list[str], flags: list[int], text: str, lexicon: Lexicon) -> bool:
    """Whether any word starts the search for names; a cheap test before the full one."""
    marked = [i for i, f in enumerate(flags) if f & 171]
    if not marked:
        return False
    if any(flags[i] & 11 for i in marked):
        return True
    alike, n = one_case(text), len(words)
    for i in marked:
        if flags[i] & 32 and i + 1 < n and (alike or words[i + 1][0].isupper()) and lexicon.cue_before(words, i + 1):
            return True
        if flags[i] & 128 and i and (alike or words[i - 1][0].isupper()) and not flags[i - 1] & 4 and lexicon.cue_after(words, i):
            return True
    return False


def _names(text: str, lexicon: Lexicon, taken: list[tuple[int, int]]) -> list[tuple[str, int, int, tuple[int, ...]]]:
    found = list(_WORD.finditer(text))
    words = [m[0] for m in found]
    flags = lexicon.flags_of(words)
    alike = one_case(text)
    out, i, n = [], 0, len(words)
    while i < n:
        start, f, first = found[i].start(), flags[i], i
        titled = bool(i and flags[i - 1] & 8 and text[found[i - 1].end() : start] in (" ", ". "))
        if i and flags[i - 1] & 64 and text[found[i - 1].end() : start] == ". ":  # an initial before a surname
            first = i - 1
        cued = lexicon.cue_before(words, first) and first != i or lexicon.cue_before(words, i) and text[found[i - 1].end() : start] in (" ", ", ", ": ", ",\n", "\n")
        capital = words[i][0].isupper()
        if f & 8 and not f & 3 and (i + 1 >= n or not titled):
            i += 1
            continue
        follows = lambda j: j < n and text[found[j - 1].end() : found[j].start()] in (" ", ", ", "'", "’") and lexicon.cue_after(words, j)
        strong = f & 3 or titled and (capital or alike) and not f & 4
        if not strong and not ((capital or alike) and (cued and not f & 4 or not alike and not f & 4 and follows(i + 1) and not (i and words[i - 1].lower() in DETERMINERS))):
            i += 1
            continue
        if any(a < found[i].end() and start < b for a, b in taken):
            i += 1
            continue
        j = i + 1
        while j < n and j - i < 3 and text[found[j - 1].end() : found[j].start()] in (" ", ". ") and (text[found[j - 1].end()] == " " or flags[j - 1] & 64) and not flags[j] & 12 and words[j].lower() not in PLACE_AFTER and (flags[j] & 1 or not alike and words[j][0].isupper() and len(words[j]) > 1 and not flags[j] & 4):
            j += 1
        left = words[i - 1].lower() if i else ""
        joined = i and text[found[i - 1].end() : start] in (" ", "-", "’", "'")
        right = words[j].lower() if j < n and text[found[j - 1].end() : found[j].start()] in (" ", "-") else ""
        votes = (
            1 if any(flags[k] & 2 for k in range(i, j)) else 0,
            1 if flags[i] & 1 or j - i > 1 and flags[j - 1] & 1 else 0,
            1 if titled else 0,
            1 if cued else -1 if joined and left in PLACE_BEFORE or start and text[start - 1].isdigit() else 0,
            1 if follows(j) else -1 if right in PLACE_AFTER else 0,
            0 if alike else 1 if capital else -1,
            -1 if f & 4 else 0,
        )
        if titled:
            first = i - 1
        if any(a < found[first].end() and found[first].start() < b for a, b in taken):
            first = i
        out.append(("name", found[first].start(), found[j - 1].end(), votes))
        i = j
    return out


_HIDDEN = ("at)", "at]", "at}", "at>", "AT)", "AT]", "AT}", "AT>", " dot ", " DOT ", " punkt ", " punto ", " point ")


def hides_mail(text: str) -> bool:
    return "@" in text or any(sign in text for sign in _HIDDEN)


def without_addresses(text: str) -> str:
    """The text with mail and street addresses blanked, all other characters in their places."""
    if hides_mail(text):
        text = _EMAIL.sub(lambda m: " " * len(m[0]), text)
    if _DIGIT.search(text):
        text = _ADDRESS.sub(lambda m: " " * len(m[0]), text)
    return text


def pattern_counts(texts: DataFrame, lexicon: Lexicon) -> tuple[DataFrame, DataFrame]:
    """The candidates (field, id, kind, votes) of all texts, written, and how often each vote pattern occurs."""
    held = texts.sparkSession.sparkContext.broadcast(lexicon.parts())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Lexicon(*held.value)
        for batch in batches:
            rows, kinds, votes = [], [], []
            for row, text in enumerate(batch.column("text").to_pylist()):
                for kind, _, _, vote in candidates(text, words):
                    rows.append(row)
                    kinds.append(kind)
                    votes.append(",".join(map(str, vote)))
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("field").take(at), batch.column("id").take(at), pa.array(kinds, pa.string()), pa.array(votes, pa.string())], names=["field", "id", "kind", "votes"])

    spans = written(texts.select("field", "id", "text").mapInArrow(run, "field string, id long, kind string, votes string"), "candidates")
    return spans, spans.groupBy("kind", "votes").count()


def label_model(votes: np.ndarray, counts: np.ndarray, rounds: int = 40) -> np.ndarray:
    """Probability of each vote pattern to be a true span: a two-class mixture fitted by expectation-maximisation.

    Starts from the sum of the votes. Each labeler has a distribution over -1, 0, 1 in
    either class, with a weak prior that votes for are likelier in true spans and votes
    against rare in them.
    """
    p = 1 / (1 + np.exp(-1.5 * (votes.sum(1) - 0.5)))
    base = np.array([[0.2, 4.0, 3.0], [3.0, 4.0, 1.0]])  # pseudo-counts in true and false spans; a vote against is rarely wrong
    weight = max(1.0, counts.sum() * 0.002)
    for _ in range(rounds):
        score = np.zeros((2, len(votes)))
        for c, q in enumerate((p, 1 - p)):
            score[c] = np.log((counts * q).sum() + weight)
            for j in range(votes.shape[1]):
                mass = np.array([(counts * q)[votes[:, j] == v].sum() for v in (-1, 0, 1)]) + base[c] * weight
                score[c] += np.log(mass / mass.sum())[votes[:, j] + 1]
        p = 1 / (1 + np.exp(np.clip(score[1] - score[0], -50, 50)))
    return p


def train_classifier(votes: np.ndarray, counts: np.ndarray, soft: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Weights of a logistic classifier on one-hot votes, fitted to the soft labels by gradient steps; the last is the bias."""
    x = np.concatenate([(votes == v).astype(float) for v in (-1, 1)] + [np.ones((len(votes), 1))], axis=1)
    w, weight = np.zeros(x.shape[1]), counts / counts.sum()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-(x @ w)))
        slope = (weight * p * (1 - p))[:, None] * x
        w -= np.linalg.solve(x.T @ slope + RIDGE * np.eye(len(w)), x.T @ (weight * (p - soft)) + RIDGE * w)
    return w


def decisions(patterns: list[tuple[str, str, int]]) -> dict[tuple[str, str], float]:
    """Probability of each (kind, votes) pattern by the span classifier of its kind."""
    out = {}
    for kind in KINDS:
        own = [(v, n) for k, v, n in patterns if k == kind]
        if not own:
            continue
        votes = np.array([list(map(int, v.split(","))) for v, _ in own])
        counts = np.array([n for _, n in own], dtype=float)
        w = train_classifier(votes, counts, label_model(votes, counts), rounds=30)
        x = np.concatenate([(votes == v).astype(float) for v in (-1, 1)] + [np.ones((len(votes), 1))], axis=1)
        out |= {(kind, v): float(p) for (v, _), p in zip(own, 1 / (1 + np.exp(-(x @ w))))}
    return out


def fitted(texts: DataFrame) -> tuple[Lexicon, DataFrame, dict[tuple[str, str], float]]:
    """Lexicon, written candidates and decisions for texts (field, id, text); the patterns are at most 3 ** labelers for each kind."""
    lexicon = learn_lexicon(texts)
    spans, counts = pattern_counts(texts, lexicon)
    return lexicon, spans, decisions([tuple(r) for r in counts.collect()])


def found(texts: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Distinct (field, id, kind) of the texts (field, id, text) that hold a span of the kind. Null ids and texts hold none."""
    texts = spread(texts.where("id is not null and text is not null").select("field", "id", "text"), "id")
    _, spans, chance = fitted(texts)
    kept = [(k, v) for (k, v), p in chance.items() if p >= threshold]
    table = texts.sparkSession.createDataFrame(kept, "kind string, votes string")
    return spans.join(F.broadcast(table), ["kind", "votes"]).select("field", "id", "kind").distinct()


def redacted(texts: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(field, id, text, n_spans): the same texts with [EMAIL], [PHONE], [IDNUM], [ADDRESS] or [NAME] in place of each span; null stays null."""
    lexicon, _, chance = fitted(texts.where("id is not null and text is not null"))
    yes = frozenset(k for k, p in chance.items() if p >= threshold)
    held = texts.sparkSession.sparkContext.broadcast((*lexicon.parts(), yes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        *parts, accepted = held.value
        words = Lexicon(*parts)
        for batch in batches:
            out, numbers = [], []
            for text in batch.column("text").to_pylist():
                spans = sorted((a, b, k) for k, a, b, v in candidates(text, words) if (k, ",".join(map(str, v))) in accepted)
                parts, at = [], 0
                for a, b, kind in spans:
                    if a >= at:
                        parts += [text[at:a], f"[{kind.upper()}]"]
                        at = b
                out.append(None if text is None else "".join(parts) + text[at:])
                numbers.append(len(parts) // 2)
            yield pa.RecordBatch.from_arrays([batch.column("field"), batch.column("id"), pa.array(out, pa.string()), pa.array(numbers, pa.int32())], names=["field", "id", "text", "n_spans"])

    return texts.select("field", "id", "text").mapInArrow(run, "field string, id long, text string, n_spans int")
