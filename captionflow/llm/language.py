"""Languages of documents and of each stretch of mixed documents.

Every language has a unigram model over the pieces of a fixed public vocabulary. The
probability of a word is the sum over all its segmentations into pieces (forward
algorithm); piece probabilities are fitted by expectation-maximisation with the expected
counts over all segmentations (forward-backward). Sentences are scored by the sum over
their words, and a first-order chain over the sentences of a text smooths the choice.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from captionflow.llm.pii import DIGIT_WORDS, without_addresses
from captionflow.llm.tokens import TOKENIZERS
from captionflow.session import spread

#: Languages told apart (fixed by the test data).
LANGUAGES = ("en", "fr", "de", "es", "it", "pt", "nl", "sv", "pl", "ru")
#: Labelled rows for each language that the models are fitted on, about; the only sample taken.
SAMPLE_ROWS = 2500
#: Longest text that may be in that sample, in characters, so that the sample is bounded; every text is scored, and whole.
SAMPLE_CHARS = 20_000
#: Longest piece in characters.
MOST_PIECE = 12
#: A word weighs at most this many nats for or against a language, so that a name or typing error can't decide alone.
MOST_NATS = 7.0
#: What stands before a word that may be a name, and its weight.
NAME_MARK, NAME_NATS = "^", 1.0
#: Words that are no names which a sentence needs to stand for its own.
LEAST_WORDS = 2
#: Cost of changing the language between sentences, and evidence over the next language that a sentence needs to stand for its own.
SWITCH_NATS, SURE_NATS = 3.0, 3.0
#: Share of the background in each model.
SMOOTHING = 2e-3

_BREAK = re.compile("<[bB][rR] ?/?>|[\\r\\n]+| [/|–—] |[.!?…]+(?=[\\s<]|$)|[\u2600-\u27bf\U0001f300-\U0001faff]+")
_WORD = re.compile(r"[^\W\d_]+")
_TAG = re.compile(r"</?(?!br[ /]*>)[A-Za-z][^<>]*>", re.I)
_ADDRESS = re.compile(r"\S*[@＠]\S*|https?:\S+|www\.\S+")


def sentences(text: str) -> list[tuple[int, int, int]]:
    """(start, end of the words, end) of the sentences of a text: parts between sentence ends, line breaks and separating signs."""
    out, at = [], 0
    for m in _BREAK.finditer(text):
        begin, end = m.span()
        if begin > at:
            out.append((at, begin, end))
        at = end
    if at < len(text):
        out.append((at, len(text), len(text)))
    return out


def readable(text: str) -> str:
    """The text with mail, street and web addresses and tags other than line breaks blanked, all other characters in their places."""
    text = without_addresses(text)
    if "@" in text or "://" in text or "www." in text:
        text = _ADDRESS.sub(lambda m: " " * len(m[0]), text)
    if "<" in text:
        text = _TAG.sub(lambda m: " " * len(m[0]), text)
    return text


def sentence_words(part: str) -> list[str]:
    """The words of a sentence in lower case.

    A capitalised word inside a sentence that isn't all capitals may be a name, which has
    no language; it is marked with NAME_MARK and weighs little.
    """
    words = _WORD.findall(part)
    if not words:
        return words
    words[0] = words[0].lower()
    if part.lstrip()[1:].islower():
        return words
    if part.isupper():
        return [w.lower() for w in words]
    return [words[0], *[w if w.islower() else NAME_MARK + w.lower() for w in words[1:]]]


def vocabulary(folder: str = TOKENIZERS, name: str = "piece_bpe_32k.model") -> dict[str, int]:
    """Lower-cased pieces of letters of the public vocabulary; a leading mark says that the piece begins a word."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=f"{folder}/{name}")
    pieces = (model.id_to_piece(i).lower() for i in range(model.get_piece_size()))
    kept = dict.fromkeys(p for p in pieces if 0 < len(p.lstrip("▁")) <= MOST_PIECE and _WORD.fullmatch(p.lstrip("▁")) and p.rfind("▁") <= 0)
    return {p: i for i, p in enumerate(kept)}


class Models:
    """Piece probabilities of all languages: ``table`` is pieces x languages; the last row stands for unknown characters."""

    def __init__(self, vocab: dict[str, int], table: np.ndarray) -> None:
        self.vocab, self.table = vocab, table

    def edges(self, word: str) -> list[tuple[int, int, int]]:
        """(from, to, piece) of all pieces in a word; unknown single characters get the last row."""
        vocab, out = self.vocab, []
        n, unknown = len(word), len(self.table) - 1
        for i in range(n):
            mark = "▁" if i == 0 else ""
            for j in range(i + 1, min(n, i + MOST_PIECE) + 1):
                piece = vocab.get(mark + word[i:j])
                if piece is not None:
                    out.append((i, j, piece))
                elif j == i + 1:
                    out.append((i, j, vocab.get(word[i:j], unknown) if i == 0 else unknown))
        return out

    def forward(self, word: str) -> tuple[list[tuple[int, int, int]], np.ndarray]:
        edges = self.edges(word)
        alpha = np.zeros((len(word) + 1, self.table.shape[1]))
        alpha[0] = 1
        for i, j, piece in edges:
            alpha[j] += alpha[i] * self.table[piece]
        return edges, alpha

    def whole(self, word: str) -> np.ndarray:
        """Log-probability of a word of any length, up to a constant that all languages share.

        The pieces of a word come by where they begin; what lies ahead is scaled up before it gets too
        small for a float, in all languages alike.
        """
        if len(word) <= 40:
            return np.log(np.maximum(self.forward(word)[1][-1], 1e-280))
        alpha = np.zeros((len(word) + 1, self.table.shape[1]))
        alpha[0], at = 1, 0
        for i, j, piece in self.edges(word):
            if i > at:
                at, top = i, alpha[i].max()
                if 0 < top < 1e-100:
                    alpha[i : i + MOST_PIECE + 1] /= top
            alpha[j] += alpha[i] * self.table[piece]
        return np.log(np.maximum(alpha[-1], 1e-280))

    def score(self, word: str) -> np.ndarray:
        """Log-probability of a word in each language, at most MOST_NATS below the best."""
        most = MOST_NATS
        if word in DIGIT_WORDS:  # mostly spelled-out numbers
            return np.zeros(self.table.shape[1], dtype=np.float32)
        if word[:1] == NAME_MARK:
            word, most = word[1:], NAME_NATS
        got = self.whole(word)
        return np.maximum(got - got.max(), -most).astype(np.float32)


def fit(counts: list[Counter], vocab: dict[str, int], rounds: int = 3) -> Models:
    """Models from the word counts of each language by expectation-maximisation over all segmentations."""
    k, v = len(counts), len(vocab) + 1
    total = Counter()
    for c in counts:
        total.update(c)
    weights = {w: np.array([c[w] for c in counts], dtype=float) for w in total}
    table = np.ones((v, k))
    models = Models(vocab, table)
    first = np.zeros((v, k))
    for word, weight in weights.items():
        for _, _, piece in models.edges(word):
            first[piece] += weight
    models.table = _normalised(first)
    for _ in range(rounds):
        expected = np.zeros((v, k))
        for word, weight in weights.items():
            edges, alpha = models.forward(word)
            beta = np.zeros_like(alpha)
            beta[-1] = 1
            for i, j, piece in reversed(edges):
                beta[i] += beta[j] * models.table[piece]
            scale = weight / np.maximum(alpha[-1], 1e-280)
            for i, j, piece in edges:
                expected[piece] += alpha[i] * models.table[piece] * beta[j] * scale
        models.table = _normalised(expected)
    return models


def _normalised(counts: np.ndarray) -> np.ndarray:
    """Probabilities mixed with a background of all languages and a floor for every piece."""
    own = counts / np.maximum(counts.sum(0), 1)
    common = own.mean(1, keepdims=True) * 0.5 + 0.5 / len(counts)
    return (1 - SMOOTHING) * own + SMOOTHING * common


class Detector:
    """Scores texts; keeps the scores of the words it has seen, within a bound."""

    def __init__(self, models: Models, most_words: int = 400_000) -> None:
        self.models, self.most = models, most_words
        self.known: dict[str, int] = {}
        self.rows = np.zeros((1024, models.table.shape[1]), dtype=np.float32)

    def _ids(self, words: list[str]) -> list[int]:
        known, out = self.known, []
        for w in words:
            i = known.get(w)
            if i is None:
                i = known[w] = len(known)
                while i >= len(self.rows):
                    self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
                self.rows[i] = self.models.score(w)
            out.append(i)
        return out

    def arrays(self, texts: list[str | None]) -> tuple[np.ndarray, ...]:
        """(text number, start, end, language, confidence, sure) of all sentences with words, in order."""
        if len(self.known) > self.most:
            self.known.clear()
        starts, stops, owners, ids, offsets, firm = [], [], [], [], [], []
        for row, text in enumerate(texts):
            if not text:
                continue
            text = readable(text)
            for a, end, b in sentences(text):
                words = sentence_words(text[a:end])
                if words:
                    starts.append(a)
                    stops.append(b)
                    owners.append(row)
                    offsets.append(len(ids))
                    firm.append(len(words) > LEAST_WORDS + 2 or sum(w[0] != NAME_MARK for w in words) >= LEAST_WORDS)
                    ids += self._ids(words)
        owner = np.array(owners, dtype=np.int64)
        if not len(owner):
            return owner, owner, owner, owner, np.zeros(0), np.zeros(0, dtype=bool)
        sums = np.add.reduceat(self.rows[ids], offsets, axis=0).astype(float)
        lang = sums.argmax(1)
        top2 = np.partition(sums, -2, axis=1)[:, -2:]
        sure = np.array(firm) & (top2[:, 1] - top2[:, 0] >= SURE_NATS)
        soft = np.exp(sums - top2[:, 1:])
        confidence = soft.max(1) / soft.sum(1)
        cuts = np.flatnonzero(np.diff(owner)) + 1
        first = np.concatenate([[0], cuts])
        mixed = np.flatnonzero(np.minimum.reduceat(lang, first) != np.maximum.reduceat(lang, first))
        ends = np.append(cuts, len(owner))
        for g in mixed:
            part = slice(first[g], ends[g])
            path = _smooth(sums[part])
            changed = np.flatnonzero(path != lang[part]) + first[g]
            lang[part] = path
            sure[changed] = False
            confidence[changed] = soft[changed, lang[changed]] / soft[changed].sum(1)
        return owner, np.array(starts), np.array(stops), lang, confidence, sure

    def batch(self, texts: list[str | None]) -> list[list[tuple[int, int, int, float, bool]]]:
        """For each text (start, end, language, confidence, sure) of its sentences with words; an empty list where there are none."""
        out: list[list[tuple[int, int, int, float, bool]]] = [[] for _ in texts]
        for row, *found in zip(*(x.tolist() for x in self.arrays(texts))):
            out[row].append(tuple(found))
        return out


def _smooth(sums: np.ndarray) -> np.ndarray:
    """Most likely languages of a chain of sentences in which a change costs SWITCH_NATS."""
    score, back = sums[0].copy(), []
    for row in sums[1:]:
        top = score.argmax()
        change = score[top] - SWITCH_NATS
        back.append(np.where(score >= change, np.arange(len(score)), top))
        score = np.maximum(score, change) + row
    path = [int(score.argmax())]
    for step in reversed(back):
        path.append(int(step[path[-1]]))
    return np.array(path[::-1])


def label(column: Column) -> Column:
    """A stored label without outer blanks, in lower case, up to the first - or _; null if that is none of the known codes."""
    code = F.substring_index(F.substring_index(F.lower(F.btrim(column, F.lit(" \t\r\n\f\v\u00a0"))), "-", 1), "_", 1)
    return F.element_at(F.create_map(*[F.lit(x) for code in LANGUAGES for x in (code, code)]), code)


def train(df: DataFrame, id_col: str, text: str, language: str, sample_rows: int = SAMPLE_ROWS, folder: str = TOKENIZERS, rounds: int = 2) -> Models:
    """Models fitted on about ``sample_rows`` labelled rows of each language, chosen by hash among those of at most SAMPLE_CHARS characters.

    Labels may be wrong and texts mixed: the first fit takes the labels, the second takes
    the sentences that the first is sure about. A word counts once for each row, so that no
    long text outweighs the others. Languages without rows score below all others.
    """
    labelled = df.where(F.col(text).isNotNull() & F.col(id_col).isNotNull()).select(id_col, text, label(F.col(language)).alias("_l")).where(F.col("_l").isNotNull() & (F.length(text) <= SAMPLE_CHARS))
    sizes = {r["_l"]: r["count"] for r in labelled.groupBy("_l").count().collect()}
    shares = F.create_map(*[F.lit(x) for lang, n in (sizes or {"": 1}).items() for x in (lang, min(1.0, sample_rows / n))])
    chosen = labelled.where(F.shiftrightunsigned(F.xxhash64(F.lit(11), id_col), 1) / float(1 << 63) < F.element_at(shares, F.col("_l")))
    rows = chosen.select("_l", text).collect()
    vocab = vocabulary(folder)
    counts = [Counter() for _ in LANGUAGES]
    for lang, comment in rows:
        text = readable(comment)
        every = {w.lstrip(NAME_MARK) for a, end, _ in sentences(text) for w in sentence_words(text[a:end])}
        counts[LANGUAGES.index(lang)].update(every)
    models = fit(counts, vocab)
    for _ in range(rounds - 1):
        counts = [Counter() for _ in LANGUAGES]
        for (_, comment), found in zip(rows, Detector(models).batch([c for _, c in rows])):
            for lang, word in {(lang, w.lstrip(NAME_MARK)) for a, b, lang, _, sure in found if sure for w in sentence_words(_BREAK.sub(" ", readable(comment)[a:b]))}:
                counts[lang][word] += 1
        models = fit(counts, vocab)
    used = np.flatnonzero((models.table[:-1] != models.table[:-1].min(0)).any(1))
    names = list(vocab)
    return Models({names[p]: i for i, p in enumerate(used)}, np.vstack([models.table[used], models.table[-1:]]))


def detect(df: DataFrame, id_col: str, text: str, language: str, models: Models) -> DataFrame:
    """(id, label, has_words, parts) with parts the sentences: array of (start, end, lang, confidence, sure).

    Null, blank and wordless texts have no parts. Rows with a null id are left out.
    """
    held = df.sparkSession.sparkContext.broadcast((models.vocab, models.table))
    part = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string()), ("confidence", pa.float64()), ("sure", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        detector = Detector(Models(*held.value))
        for batch in batches:
            for at in range(0, batch.num_rows, 4000):
                piece = batch.slice(at, 4000)
                owner, start, end, lang, confidence, sure = detector.arrays(piece.column("text").to_pylist())
                offsets = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=piece.num_rows))]).astype(np.int32)
                names = pa.DictionaryArray.from_arrays(pa.array(lang, pa.int32()), pa.array(LANGUAGES)).cast(pa.string())
                values = pa.StructArray.from_arrays([pa.array(start, pa.int32()), pa.array(end, pa.int32()), names, pa.array(confidence, pa.float64()), pa.array(sure, pa.bool_())], fields=list(part))
                yield pa.RecordBatch.from_arrays([piece.column("id"), piece.column("label"), pa.ListArray.from_arrays(pa.array(offsets), values)], names=["id", "label", "parts"])

    rows = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), label(F.col(language)).alias("label"), F.col(text).alias("text"))
    return spread(rows, "id").mapInArrow(run, "id long, label string, parts array<struct<start: int, end: int, lang: string, confidence: double, sure: boolean>>")


def stands(parts: str = "parts") -> Column:
    """The languages in which a text has a whole sentence: those of its sure sentences, else that of its most confident one."""
    sure = F.array_distinct(F.transform(F.filter(parts, lambda p: p["sure"]), lambda p: p["lang"]))
    top = F.array_max(F.transform(parts, lambda p: F.struct(p["confidence"].alias("c"), p["lang"].alias("l"))))
    return F.when(F.size(sure) > 0, sure).when((F.size(parts) > 0) & (top["c"] >= 0.5), F.array(top["l"])).otherwise(F.array().cast("array<string>"))


def mislabelled(found: DataFrame) -> DataFrame:
    """Distinct (id, lang) of texts whose label is missing or none of their languages, or that have two or more."""
    rows = found.select("id", "label", stands().alias("langs"))
    wrong = F.col("label").isNull() | ~F.array_contains("langs", F.col("label")) | (F.size("langs") > 1)
    return rows.where(wrong).select("id", F.explode("langs").alias("lang")).distinct()


def assigned(found: DataFrame) -> DataFrame:
    """(id, label, lang, confidence, n_langs): the language with the most characters in each text; null for texts without words."""
    size = lambda p: p["end"] - p["start"]
    total = F.aggregate("parts", F.lit(0), lambda a, p: a + size(p))
    each = F.transform(F.array_distinct(F.transform("parts", lambda p: p["lang"])), lambda x: F.struct(F.aggregate(F.filter("parts", lambda p: p["lang"] == x), F.lit(0.0), lambda a, p: a + size(p) * p["confidence"]).alias("w"), x.alias("lang")))
    top = F.array_max(each)
    return found.select("id", "label", top["lang"].alias("lang"), F.round(top["w"] / total, 4).alias("confidence"), F.size(stands()).alias("n_langs"))


def stretches(found: DataFrame) -> DataFrame:
    """(id, start, end, lang, confidence): neighbouring sentences of one language joined, for every text.

    The confidence of a stretch is the mean of its sentences' by their lengths. A text without words has
    no stretches. Work is in proportion to the number of sentences.
    """
    n = F.size("parts")
    lang = lambda i: F.get("parts", i)["lang"]
    places = F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)))
    first = F.filter(places, lambda i: (i < n) & ((i == 0) | (lang(i) != lang(i - 1))))
    size = lambda p: (p["end"] - p["start"]).cast("double")
    total = lambda s, f: F.aggregate(s, F.lit(0.0), lambda a, p: a + f(p))
    cut = F.transform("_first", lambda i, j: F.slice("parts", i + 1, F.coalesce(F.get("_first", j + 1), n) - i))
    rows = found.select("id", "parts", first.alias("_first")).select("id", F.explode(cut).alias("s"))
    weighted = total("s", lambda p: size(p) * p["confidence"]) / F.greatest(total("s", size), F.lit(1.0))
    return rows.select("id", F.element_at("s", 1)["start"].alias("start"), F.element_at("s", -1)["end"].alias("end"), F.element_at("s", 1)["lang"].alias("lang"), F.round(weighted, 6).alias("confidence"))
