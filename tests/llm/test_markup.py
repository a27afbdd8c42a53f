import itertools
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from captionflow.llm import markup

W = markup.train()

MARKED = [
    "a <b>bold</b> word", "line<br/>line", "line<BR>line", "<!-- note -->", "&lt;p&gt;x&lt;/p&gt;", "caf&eacute; &amp; bar", "it&#39;s", "<i>never closed", "# Title\n\ntext", "Title\n=====\n\ntext", "Title\n-----\n\ntext",
    "- one\n- two", "* one\n* two", "1. one\n2. two", "> said", "`code`", "```\ncode\n```", "**strong** text", "__strong__ text", "some _soft_ text", "~~gone~~", "[text](https://x.example)", "<https://x.example>",
    "| a | b |\n|---|---|\n| 1 | 2 |", "== Title ==\ntext", "'''bold''' text", "''soft''", "see [[Page|the page]]", "[https://x.example the page]", "{{Box|a=1}}", "** deep item", "{| class=\"x\"\n! a\n|-\n| b\n|}",
    "\\section{Title}", "\\textbf{x} and \\emph{y}", "\\begin{itemize}\n\\item x\n\\end{itemize}", "about $n \\approx 3$ long", "\\(n\\) nights", "\\[ p = 3 n \\]", "5\\% off", "Caf\\'e", "one \\\\ two", "x<sup>2</sup>",
]
PLAIN = [
    "", "Plain text.", "I <3 this town", "rooms are < 20 m2 & cool", "Arrive >3pm, leave <11am.", "Bed&breakfast; ask us.", "costs $40 to $60", "Press {OK} twice", "Towels [optional] here", "our #1 place, rated 5*", "~10 min", "2 x 90 cm | 1 x 140 cm",
    "Floor = 3, door = left.", "50% off", "Blue_Heron_2G", "Fish & chips", "24/7 from 17:00", "Suits 2-4 guests, 4 + 1", "a@b.example", "one\r\ntwo\n\nthree", "Follow @ signs", "It costs $5.", "snake_case_name and other_name", "we stay 3 > 2 nights", "AT&T rocks",
]


@pytest.mark.parametrize("text", MARKED)
def test_markup_is_found(text):
    assert markup.clean(text, W)[2]


@pytest.mark.parametrize("text", PLAIN)
def test_plain_text_is_left_alone(text):
    assert markup.clean(text, W)[0] == text and not markup.clean(text, W)[2]


@pytest.mark.parametrize(
    "text, want",
    [
        ("<h2>Wifi</h2><p>Fast &amp; free.</p><ul><li>a</li><li>b</li></ul>", "# Wifi\n\nFast & free.\n\n- a\n- b"),
        ("&lt;p&gt;One.&lt;br&gt;Two.&lt;/p&gt;", "One.\nTwo."),
        ("<pre><code>x = 1 &lt; 2\ny</code></pre>Then <b>this</b>.", "```\nx = 1 < 2\ny\n```\nThen this."),
        ("Title\n=====\n\nText with **bold** and `a*b`.", "# Title\n\nText with bold and a*b."),
        ("| a | b |\n|---|---:|\n| 1 | 2 |", "| a | b |\n\n| 1 | 2 |"),
        ("'''Wifi''': [[Page|the page]] {{Box|x=1}}\n== Next ==\n* one", "Wifi: the page Box: x=1\n\n# Next\n\n- one"),
        ("\\section{Wifi}\nCaf\\'e 5\\% off, \\(n\\) nights.", "# Wifi\n\nCafé 5% off, $ n $ nights."),
        ("See [wifi](https://x.example) <!-- no -->now", "See wifi now"),
        ("*a _b **c ~~d~~**_*", "a b c d"),
        ("&amp;amp;amp;amp;amp;lt;b&amp;gt;x", "x"),
        ("a~~gone~~b <b>c</b>", "agoneb c"),
        ("half is \\frac{a}{b} of \\alpha, see \\ref{t}", "half is a/b of α, see [t]"),
        ("~~~\nx = *1*\n~~~\nthen", "```\nx = *1*\n```\n\nthen"),
        ("Run:\n\n    x = *1*\n    y\n\nthen", "Run:\n\n```\nx = *1*\ny\n```\n\nthen"),
        ("See [the page][p].\n\n[p]: https://x.example 'T'", "See the page."),
        ("\\begin{equation}\n a_1 = \\frac{x}{2}\n\\end{equation}\nso", "$$ a_1 = \\frac{x}{2} $$\n\nso"),
        ("\\begin{verbatim}\n<b>&amp;\n\\end{verbatim}", "```\n<b>&amp;\n```"),
        ("[https://x.example/a] {{Note}}", "https://x.example/a Note"),
        ("\ue0000\ue000 `code` \ue0001\ue000", "\ue0000\ue000 code \ue0001\ue000"),
        ("\ue000 &#57345;0&#57345; `x`", "\ue000 \ue0010\ue001 x"),
    ],
)
def test_structure_stays(text, want):
    assert markup.clean(text, W)[0] == want


def test_blocks_have_kinds():
    blocks = markup.clean("# A\n\n- one\n\n```\nx\n```\n\n\\[ p \\]\n\ntext", W)[1]
    assert [k for k, _ in blocks] == ["heading", "list", "code", "formula", "paragraph"]


def cheapest(costs, links):
    best = None
    for labels in itertools.product([False, True], repeat=len(costs)):
        cost = sum(b if y else a for (a, b), y in zip(costs, labels)) + sum(w for i, j, w in links if labels[i] != labels[j])
        best = cost if best is None else min(best, cost)
    return best


def test_long_lists_cost_one_pass():
    import time

    text = "\n".join(f"- item {i} is > {i} cm" if i % 3 else f"* {i} | x" for i in range(20_000))
    began = time.perf_counter()
    assert markup.label(text, W)
    rng = random.Random(2)
    n = 20_000
    markup.minimum_cut([(rng.random() * 3, rng.random() * 3) for _ in range(n)], [(i - 1, i, 0.8) for i in range(1, n)])
    assert time.perf_counter() - began < 30


# Sentences of another wording than any generated or planted text: (text, is markup).
CLAUSES = ["The ferry leaves at noon", "Bring rubber boots in spring", "Our goats enjoy visitors", "Kettles live above the sink", "Please water the basil"]
WRAPS = [
    "<em>{0}</em>.", "{0}<br>\nthanks", "<span class='n'>{0}", "<ol><li>{0}</li></ol>", "{0} &mdash; always", "{0}&#x2026;", "### {0}\n\nok", "{0}\n======\nok", "+ {0}\n+ again", "7. {0}\n8. again", "> {0}", "``{0}``", "~~~sh\n{0}\n~~~",
    "yes **{0}**", "no __{0}__", "~~{0}~~", "![{0}](pic.png)", "[{0}][1]\n\n[1]: /map", "|x|{0}|\n|:-:|---|\n|a|b|", "=== {0} ===", "''{0}''", "[[Goats|{0}]]", "{{{{Warning|{0}}}}}", "*# {0}", "\\emph{{{0}}}", "\\begin{{center}}{0}\\end{{center}}",
    "{0} \\(x^2\\)", "$$ y = x $$ {0}", "{0}\\\\again", "\\\"a {0}", "{0}  \nagain", "line\n\n    {0}\n\nend",
]
LITERAL = [
    "{0}.", "{0} (really).", "{0} - always.", "{0}: 3 > 2, 2 < 4.", "{0} & so on.", "{0} for $15.", "{0}, 20 % more.", "{0} #2!", "{0} [maybe].", "{0} {{or not}}.", "{0} ~5 km.", "{0} * if dry.", "{0} | daily.", "x=1; {0}", "{0}, mail us: a@b.example.", "var_{0}_x".replace(" ", "_"),
]


def test_markup_of_other_wording():
    marked = [w.format(c) for w in WRAPS for c in CLAUSES]
    literal = [w.format(c) for w in LITERAL for c in CLAUSES]
    assert len(marked) + len(literal) >= 200
    assert sum(bool(markup.label(t, W)) for t in marked) >= 0.95 * len(marked)
    assert sum(not markup.label(t, W) for t in literal) >= 0.95 * len(literal)


def test_cut_is_minimal():
    rng = random.Random(1)
    for _ in range(60):
        n = rng.randint(1, 7)
        costs = [(rng.random() * 3, rng.random() * 3) for _ in range(n)]
        links = [(i, j, rng.random() * 2) for i in range(n) for j in range(i) if rng.random() < 0.5]
        labels = markup.minimum_cut(costs, links)
        cost = sum(b if y else a for (a, b), y in zip(costs, labels)) + sum(w for i, j, w in links if labels[i] != labels[j])
        assert abs(cost - cheapest(costs, links)) < 1e-6


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="<>&;/bp\"'`*_~[](){}|#=-\\$ \nx1.", max_size=60))
def test_any_text_is_cleaned(text):
    out, blocks, found = markup.clean(text, W)
    assert isinstance(out, str) and (found or out == text)


def test_whole_table(spark):
    long = "<p>" + "word " * 40_000 + "</p>" + "<b>x</b>" * 3000
    rows = [(1, "<b>x</b>", None, "clash"), (2, "plain", "", "clash"), (None, "<i>y</i>", "z", "clash"), (3, long, "a", "clash"), (1, "<b>x</b>", None, "clash")]
    df = spark.createDataFrame(rows, "listing_id long, description string, neighborhood string, id string")
    got = markup.cleaned(df, "listing_id", ("description", "neighborhood")).collect()
    assert len(got) == 10 and {(r.id, r.field) for r in got if r.has_markup} == {(1, "description"), (None, "description"), (3, "description")}
    flagged = {(r.id, r.field) for r in markup.marked(df, "listing_id", ("description", "neighborhood")).collect()}
    assert flagged == {(r.id, r.field) for r in got if r.has_markup}
    assert [r.clean for r in got if r.id == 1 and r.field == "neighborhood"] == [None, None]
    assert markup.cleaned(df.limit(0), "listing_id", ("description",)).count() == 0
