import numpy as np
import pytest
from pyspark.sql import functions as F

from captionflow.llm import pii

LEX = pii.Lexicon()


def kinds(text):
    return {k for k, _, _, v in pii.candidates(text, LEX) if sum(v) > 0}


@pytest.mark.parametrize(
    "text, kind",
    [
        ("Write to anna.b@mail.example.net please", "email"), ("Mail anna (at) post dot example", "email"), ("Contact: a_b [at] rooms.invalid", "email"), ("Kontakt: anna @ post.example", "email"),
        ("Call +44 7700 900123 now", "phone"), ("call (555) 010-0168", "phone"), ("Tél. 01.99.00.29.67", "phone"), ("tel 030/23125 125", "phone"), ("reach us on five five five zero one one three", "phone"), ("call 07700900123", "phone"),
        ("My passport XY1234567 was copied", "idnum"), ("tax number 000-12-3456", "idnum"), ("ID 123.456.789-01", "idnum"), ("DNI 12345678-Z", "idnum"), ("licence no bw448960b", "idnum"), ("Ausweis AB 123 456 789", "idnum"),
        ("we drove to 12 Harrow Bend Lane", "address"), ("at 5 Damson St., apt 3", "address"), ("bell at 14 bis, rue du Vieux Lavoir", "address"), ("post it to Tannenstraße 5", "address"), ("at Calle Salinas 12, 4º", "address"), ("via Roma 8", "address"),
        ("Our host Anna met us", "name"), ("Contact Mr Quendo about it", "name"), ("Merci à Camille pour son accueil", "name"), ("ask for wanda", "name"), ("THANK YOU SO MUCH SVEN", "name"), ("Ask J. Quendo about the boat", "name"),
    ],
)
def test_found(text, kind):
    assert kind in kinds(text)


@pytest.mark.parametrize(
    "text",
    ["", "Rated 4.73 by 6870 guests.", "The code was changed to 5346 on 23/4/2020.", "Our booking RK572KM8 worked.", "Bus 577 goes there every 91 minutes.", "We watched boats in Saltmarsh Bay.", "Quince Road has a market.", "41.5754, 12.5754", "Follow @ signs", "Open from 17:00 to 17:45", "Lunch at Café Tamarind costs 72.", "Unser Zimmer hat uns gut gefallen.", "five stars from us"],
)
def test_lookalikes(text):
    assert kinds(text) == set()


def test_em_finds_the_reliable_labeler():
    rng = np.random.default_rng(0)
    truth = rng.random(4000) < 0.4
    good = np.where(truth, 1, np.where(rng.random(4000) < 0.9, 0, 1))
    noise = rng.choice([-1, 0, 1], 4000)
    also = np.where(truth == (rng.random(4000) < 0.9), 1, 0)
    votes, counts = np.unique(np.stack([good, noise, also], 1), axis=0, return_counts=True)
    p = pii.label_model(votes, counts.astype(float))
    by = {tuple(v): x for v, x in zip(votes.tolist(), p)}
    assert by[(1, -1, 1)] > 0.5 > by[(0, 1, 0)]
    w = pii.train_classifier(votes, counts.astype(float), p, rounds=30)
    assert w[3] > 0 and w[0 + 3] > abs(w[1 + 3])


def texts(spark):
    rows = [("comment", i, t, "clash") for i, t in enumerate(["Our host Anna met us. The view is nice.", "The view is nice.", "Call Bruno at +44 7700 900123.", None, "", "Mail anna@post.example", "Thanks to Anna for all.", "word " * 60_000 + "Call +44 7700 900999"] * 3)]
    return spark.createDataFrame(rows + [("description", None, "Our host Anna", "x")], "field string, id long, text string, kind string")


def test_whole_table(spark):
    df = texts(spark)
    got = {(r.id, r.kind) for r in pii.found(df).collect()}
    assert {(0, "name"), (2, "name"), (2, "phone"), (5, "email"), (7, "phone")} <= got and not {g for g in got if g[0] in (1, 3, 4)}
    assert pii.found(df.limit(0)).count() == 0


def test_redaction_keeps_the_rest(spark):
    got = {r.id: (r.text, r.n_spans) for r in pii.redacted(texts(spark)).where("id < 7").collect()}
    assert got[2] == ("Call [NAME] at [PHONE].", 2) and got[1] == ("The view is nice.", 0) and got[3] == (None, 0) and got[5][0] == "Mail [EMAIL]"


def test_word_filter_holds_its_words(spark):
    words = [f"w{i}" for i in range(60_000)] + ["żółć", "x" * 300]
    df = spark.createDataFrame([(w,) for w in words], "word string")
    planes = pii._filter_of(df, len(words))
    assert len(planes) * 8 == pii.filter_bits(len(words))
    lex = pii.Lexicon(planes)
    assert all(lex.flag(w) & 1 for w in words)
    assert sum(lex.flag(f"x{i}") & 1 for i in range(20_000)) < 0.01 * 20_000  # at the fullest load that a size is used for
    assert not pii.Lexicon().flag("w1") & 1


def test_filters_grow_with_their_words():
    for n in (0, 1, 10**5, 10**7, 10**8):
        assert pii.filter_bits(n) >= pii.BITS_A_WORD * n
        assert (1 - np.exp(-pii.PLACES * n / pii.filter_bits(n))) ** pii.PLACES < 0.01
    with pytest.raises(ValueError):
        pii.filter_bits(10**9)


# Sentences of another wording than the planted ones: (kind, templates, fillers).
OTHER = [
    ("email", ["Drop a line to {0}.", "Questions? {0}", "({0})", "her address is {0}, thanks", "e-post: {0}", "Reach the desk via {0} any time", "cc {0} too", "<{0}>"], ["jo{at}example.com", "k.lee@inn.example.org", "o_x [at] mail [dot] example", "q-1 (at) host.example.net", "UP@CASE.EXAMPLE"]),
    ("phone", ["Please call {0}.", "Tel. {0}", "my mobile is {0}, any hour", "whatsapp {0} for the gate", "Telephone: {0}", "For keys call: {0}", "reach me on {0}", "handy {0}"], ["415-555-1234", "212 555 0199", "415.555.1234", "+48 601 555 019", "0170 5550 123"]),
    ("idnum", ["Passport no. {0}", "his passport {0} expired", "identity card {0}", "driving licence {0}", "my tax number is {0}", "social security {0}", "ID: {0}", "pasaporte {0}"], ["123456789", "K1234567", "987-65-4321", "XZ 555 666 777", "12345678-K"]),
    ("address", ["We live at {0}.", "parcels go to {0}, please", "taxi to {0}", "It is {0} really", "adresse: {0}", "he moved to {0} last year", "Meet at {0}!", "the flat ({0}) is small"], ["7 Willow Tree Crescent", "18 rue de la Paix", "Lindenallee 12", "Calle Mayor 3", "221 Baker Street"]),
    ("name", ["My name is {0}.", "Hi, my name is {0} and I cook", "Thank you {0}!", "The owner {0} waved", "Ask {0} for salt", "a man called {0} came", "Dr. {0} lives upstairs", "Contact {0} first"], ["Thandiwe Nkosi", "Oyelaran", "Maria Quist", "Bjarki", "Elin"]),
]


@pytest.mark.parametrize("kind, frames, fillers", OTHER)
def test_other_wording(kind, frames, fillers):
    made = [f.replace("{0}", x) for f in frames for x in fillers]
    missed = [t for t in made if kind not in kinds(t)]
    assert len(missed) <= 0.1 * len(made), missed


def test_cues_are_learned(spark):
    names, more = sorted(pii.GIVEN)[:40], ["Velm", "Oxtor", "Quist"]
    rows = [("c", i, f"The view is nice. Later {n.capitalize()} waved hello. We saw Lake {w}.") for i, (n, w) in enumerate(zip(names * 3, (more * 40)))]
    df = spark.createDataFrame(rows, "field string, id long, text string")
    before, after = pii.learn_cues(df)
    assert {"later", "nice later"} & before and {"waved", "waved hello"} & after and "lake" not in before and "saw lake" not in before and pii.BEFORE <= before
    assert pii.learn_cues(df.limit(0)) == (pii.BEFORE, frozenset())


def test_a_vote_against_outweighs_a_shape():
    chance = pii.decisions([("idnum", "1,1,0", 9500), ("idnum", "1,0,-1", 37), ("phone", "1,1,0", 900), ("phone", "1,0,0", 170), ("phone", "0,1,0", 100), ("phone", "0,0,0", 16)])
    assert chance["idnum", "1,1,0"] > 0.9 and chance["idnum", "1,0,-1"] < 0.3 and chance["phone", "0,0,0"] > 0.5


def test_cue_after_a_name_is_a_whole_phrase():
    lex = pii.Lexicon(after=frozenset(["nous a"]))
    named = lambda t: {k for k, _, _, v in pii.candidates(t, lex) if sum(v) > 0}
    assert named("Ganz Absolut nous avons payé.") == set() and named("Quendo nous a tout montré.") == {"name"}


def test_cues_come_from_all_texts(spark):
    """Just enough uses among many texts: any that a sample leaves out would lose the cue."""
    name = F.when(F.col("id") % 62_500 == 17, "Later Anna waved hello.").otherwise("The view is nice.")
    df = spark.range(0, 500_000, 1, 4).select(F.lit("c").alias("field"), "id", name.alias("text"))
    before, after = pii.learn_cues(df)
    assert (before - pii.BEFORE, after) == ({"later"}, {"waved hello"})


def test_all_cues_are_kept(spark):
    words = ["zz" + "".join(chr(97 + int(d)) for d in str(i)) for i in range(2600)]
    df = spark.createDataFrame([("c", i, f"{w} Anna") for i, w in enumerate(words * pii.CUE_USES)], "field string, id long, text string")
    before, after = pii.learn_cues(df)
    assert before - pii.BEFORE == set(words) and not after


def test_pairs_stay_behind_only_where_their_word_is_a_cue(spark):
    # "with" is a cue beyond "stay with", "in" is none beyond "live in"; titles are no cues
    said = ["they stay with Anna"] * 9 + [f"{c}{d} with Bruno" for c in "abc" for d in "xyz"] + ["we live in Anna"] * 9 + ["out in Velm", "far in Oxtor"] * 20 + ["as mr Anna"] * 9
    df = spark.createDataFrame([("c", i, t) for i, t in enumerate(said)], "field string, id long, text string")
    before, _ = pii.learn_cues(df)
    assert before - pii.BEFORE == {"with", "live in"}
