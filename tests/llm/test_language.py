import math
from collections import Counter

import numpy as np
import pytest

from captionflow.llm import language

SAMPLES = {
    "en": "the house was clean and the kitchen had everything that we needed. we would stay here again with the children.",
    "fr": "la maison était propre et la cuisine avait tout ce qu'il fallait. nous reviendrons ici avec les enfants.",
    "de": "das haus war sauber und die küche hatte alles, was man braucht. wir kommen gerne wieder mit den kindern.",
    "es": "la casa estaba limpia y la cocina tenía todo lo necesario. volveremos otra vez con los niños.",
    "it": "la casa era pulita e la cucina aveva tutto il necessario. torneremo ancora con i bambini.",
    "pt": "a casa estava limpa e a cozinha tinha tudo o que é preciso. voltaremos outra vez com as crianças.",
    "nl": "het huis was schoon en de keuken had alles wat we nodig hadden. we komen graag terug met de kinderen.",
    "sv": "huset var rent och köket hade allt som vi behövde. vi kommer gärna tillbaka med barnen.",
    "pl": "dom był czysty i kuchnia miała wszystko, czego potrzeba. chętnie wrócimy tu z dziećmi.",
    "ru": "дом был чистым, и на кухне было всё, что нужно. мы с удовольствием вернёмся сюда с детьми.",
}


@pytest.fixture(scope="module")
def models():
    return language.fit([Counter(language.sentence_words(SAMPLES[x]) * 5) for x in language.LANGUAGES], language.vocabulary())


def test_forward_sums_all_segmentations():
    vocab = {"▁a": 0, "a": 1, "b": 2, "ab": 3, "▁ab": 4}
    table = np.array([[0.1], [0.2], [0.3], [0.15], [0.05], [1e-9]])
    got = language.Models(vocab, table).forward("aab")[1][-1][0]
    assert math.isclose(got, 0.1 * 0.2 * 0.3 + 0.1 * 0.15)  # a|a|b and a|ab


def test_fitting_raises_the_likelihood():
    counts = [Counter({"banana": 5, "band": 3, "and": 9}), Counter({"zug": 4, "und": 9})]
    vocab = language.vocabulary()
    score = lambda m: sum(n * math.log(max(m.forward(w)[1][-1][i], 1e-300)) for i, c in enumerate(counts) for w, n in c.items())
    assert score(language.fit(counts, vocab, rounds=4)) >= score(language.fit(counts, vocab, rounds=1)) - 1e-6


def test_sentences_of_each_language(models):
    found = language.Detector(models).batch([f"{SAMPLES[x]}" for x in language.LANGUAGES])
    assert [{language.LANGUAGES[p[2]] for p in f if p[4]} for f in found] == [{x} for x in language.LANGUAGES]


def test_texts_without_words(models):
    assert language.Detector(models).batch([None, "", "  ", "10/10", "👍", "...", "12.5 <br/> 7"]) == [[]] * 7


def test_names_and_addresses_have_no_language(models):
    found = language.Detector(models).batch(["The house was clean. Ask Xaver Quendo. Mail: anna@post.example. 12 Rue Street, apt 3."])[0]
    assert {language.LANGUAGES[p[2]] for p in found if p[4]} == {"en"}


def test_labels(spark):
    raw = ["en", " EN-gb", "de_DE", "xx", "", None, "--", "und", "\tfr\n", "english"]
    got = [r.l for r in spark.createDataFrame([(x,) for x in raw], "x string").select(language.label(__import__("pyspark").sql.functions.col("x")).alias("l")).collect()]
    assert got == ["en", "en", "de", None, None, None, None, None, "fr", None]


def test_whole_table(spark):
    two = [s.split(". ") for s in SAMPLES.values()]
    rows = []
    for k, x in enumerate(language.LANGUAGES):
        rows += [(k * 100 + i, SAMPLES[x], x, "clash") for i in range(5)]
    rows += [(1000, SAMPLES["en"], "de", "clash"), (1001, SAMPLES["fr"], None, "clash"), (1002, two[0][0] + ". " + two[2][1], "en", "clash"), (1003, "10/10", None, "clash"), (1004, None, "en", "clash"), (None, SAMPLES["en"], "de", "clash"), (1000, SAMPLES["en"], "de", "clash"), (1005, "word " * 100_000, "en", "clash")]
    df = spark.createDataFrame(rows, "review_id long, comment string, language string, id string")
    m = language.train(df, "review_id", "comment", "language")
    found = language.detect(df, "review_id", "comment", "language", m)
    got = {(r.id, r.lang) for r in language.mislabelled(found).collect()}
    assert {g for g in got if g[0] < 1003} == {(1000, "en"), (1001, "fr"), (1002, "en"), (1002, "de")} and not {g for g in got if g[0] in (1003, 1004)}
    best = {r.id: (r.lang, r.confidence) for r in language.assigned(found).collect()}
    assert best[0][0] == "en" and best[0][1] > 0.9 and best[1003] == (None, None)
    parts = sorted((r.start, r.lang) for r in language.stretches(found).where("id = 1002").collect())
    assert [p[1] for p in parts] == ["en", "de"] and parts[0][0] == 0
    empty = df.limit(0)
    assert language.mislabelled(language.detect(empty, "review_id", "comment", "language", language.train(empty, "review_id", "comment", "language"))).count() == 0


def test_held_out_accuracy(spark):
    """Trained on the labels of the smallest test data, most of the clear labels of other rows are confirmed."""
    from pyspark.sql import functions as F

    rows = spark.read.parquet("/root/testdata/sf0.01/reviews.parquet")
    part = F.pmod(F.xxhash64("review_id"), F.lit(2))
    m = language.train(rows.where(part == 0), "review_id", "comment", "language")
    found = language.assigned(language.detect(rows.where(part == 1), "review_id", "comment", "language", m)).where("label is not null and lang is not null")
    right = found.agg(F.avg((F.col("label") == F.col("lang")).cast("int"))).first()[0]
    assert right > 0.9  # some labels are wrong on purpose
