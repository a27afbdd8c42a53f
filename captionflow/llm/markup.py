"""Markup residue in text: found, and turned into clean text that keeps its structure.

Every sign that may be HTML, Markdown, wiki or LaTeX markup becomes a node. A logistic
classifier, trained here on generated markup and look-alikes, gives each node a cost of
being read as markup and of being read literally; these are the capacities to the two
terminals. Nodes that stand together (an opening and a closing sign, neighbouring items
or rows, signs of one parent element) are joined by smoothness edges. The minimum cut,
by maximum flow, labels all nodes of a text at once.
"""

from __future__ import annotations

import html
import itertools
import math
import random
import re
import unicodedata
from collections import deque
from collections.abc import Iterator
from html.entities import html5

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from captionflow.session import spread

# Element names of HTML.
TAGS = frozenset("""a abbr address area article aside audio b base bdi bdo big blockquote body br button canvas caption center cite code col colgroup
data dd del details dfn dialog div dl dt em embed fieldset figcaption figure font footer form h1 h2 h3 h4 h5 h6 head header hr html i iframe img
input ins kbd label legend li link main map mark meta meter nav noscript object ol optgroup option p param picture pre progress q rp rt ruby s
samp script section select small source span strike strong style sub summary sup table tbody td template textarea tfoot th thead time title tr
track tt u ul var video wbr""".split())
_SIGNS = [
    ("comment", r"<!--.*?-->"),
    ("autolink", r"<(?:[A-Za-z][A-Za-z0-9+.-]+:[^\s<>]+|[^\s<>@/]+@[^\s<>@]+)>"),
    ("tag", r"</?(?P<name>[A-Za-z][A-Za-z0-9-]*)(?:\s[^<>]*)?/?>"),
    ("ref", r"&(?:[A-Za-z][A-Za-z0-9]*|#\d{1,7}|#[xX][0-9A-Fa-f]{1,6});"),
    ("fence", r"^ {0,3}```[^`\n]*\n.*?(?:^ {0,3}```[ \t]*$|\Z)|^ {0,3}~~~[^\n]*\n.*?(?:^ {0,3}~~~[ \t]*$|\Z)"),
    ("indented", r"(?:(?<=\n\n)|\A)(?: {4}|\t)[ \t]*[^\s*+\d:;#-][^\n]*(?:\n(?: {4}|\t)[^\n]+)*"),
    ("definition", r"^ {0,3}\[[^\[\]\n]+\]:[ \t]*\S+(?:[ \t]+(?:\"[^\"\n]*\"|'[^'\n]*'|\([^()\n]*\)))?[ \t]*$"),
    ("code", r"(?<![`\\])(`+)(?!`)[^\n]+?(?<!`)\1(?!`)"),
    ("block", r"\\begin\{(?P<block>equation|align|gather|multline|eqnarray|displaymath|math|verbatim|lstlisting)\*?\}.*?\\end\{(?P=block)\*?\}"),
    ("display", r"\\\[.*?\\\]|\$\$.+?\$\$"),
    ("inline", r"\\\(.*?\\\)"),
    ("dollars", r"(?<![\\$\w])\$[^$\n]+?\$(?![\w$])"),
    ("wikitable", r"^\{\|.*?^\|\}"),
    ("template", r"\{\{[^{}]*\}\}"),
    ("wikilink", r"\[\[[^\[\]\n]+\]\]"),
    ("extlink", r"\[https?://[^\s\]]+(?:[ \t][^\]\n]*)?\]"),
    ("link", r"!?\[[^\[\]\n]*\]\([^()\s]*(?:\s\"[^\"\n]*\")?\)"),
    ("reference", r"!?\[[^\[\]\n]+\]\[[^\[\]\n]*\]"),
    ("environment", r"\\(?:begin|end)\{[A-Za-z]+\*?\}(?:\[[^\]\n]*\])?"),
    ("command", r"\\[A-Za-z]+\*?(?:\[[^\]\n]*\])?(?:\{[^{}\n]*\})*"),
    ("accent", r"\\[`'^\"~=.](?:\{[A-Za-z]\}|[A-Za-z])"),
    ("escape", r"\\[\\%$#&_{}*\[\]()~`<>|!+.-]"),
    ("wikiheading", r"^(={1,6})[ \t]*[^=\s][^\n]*?[ \t]*\1[ \t]*$"),
    ("quotes", r"'{2,5}[^'\n]+(?:'[^'\n]+)*?'{2,5}"),
    ("rule", r"^[ \t]*(?:=+|-+|\*{3,}|_{3,})[ \t]*$"),
    ("heading", r"^ {0,3}#{1,6}[ \t]+[^\n]+$"),
    ("tablerow", r"^[ \t]*\|[^\n]*\|[ \t]*$"),
    ("quote", r"^ {0,3}>[ \t]?"),
    ("strong", r"(?<![\w*])\*\*(?=\S)[^\n]+?(?<=\S)\*\*(?!\*)|(?<![\w_])__(?=\S)[^\n]+?(?<=\S)__(?![\w_])"),
    ("items", r"^[*#:;]{2,}[ \t]*(?=\S)"),
    ("item", r"^[ \t]*(?:[-*+]|\d{1,9}[.)])[ \t]+(?=\S)"),
    ("strike", r"~~(?=\S)[^\n~]+?(?<=\S)~~"),
    ("emphasis", r"(?<![\w*\\])\*(?=[^\s*])[^*\n]+?(?<=[^\s*])\*(?![\w*])|(?<![\w\\])_(?=[^\s_])[^_\n]+?(?<=[^\s_])_(?!\w)"),
    ("hardbreak", r"(?<=\S)(?: {2,}|\\)\n(?=[^\n]*\S)"),
    ("sign", r"[<>&$%#~|*_={}\[\]]+"),
]
KINDS = tuple(k for k, _ in _SIGNS)
_MAY_BE = re.compile(r"[<>&`\\$\[\]{}*_~#|=]|''|^[ \t]*(?:[-+]|\d{1,9}[.)])[ \t]|^-+[ \t]*$|^[:;]{2}|\S {2,}\n|(?:\n\n|\A)(?: {4}|\t)", re.M)


#: With which signs a kind begins; kinds that begin a line are looked for at line starts only.
_FIRST = {
    "comment": "<", "autolink": "<", "tag": "<", "ref": "&", "code": "`", "display": "\\$", "inline": "\\", "dollars": "$", "template": "{", "wikilink": "[", "extlink": "[", "link": "![", "reference": "![", "block": "\\", "environment": "\\", "hardbreak": " \\", "command": "\\",
    "accent": "\\", "escape": "\\", "quotes": "'", "strong": "*_", "strike": "~", "emphasis": "*_", "sign": "<>&$%#~|*_={}[]",
}
_AT_LINE = ("fence", "indented", "definition", "wikitable", "wikiheading", "rule", "heading", "tablerow", "quote", "items", "item")
_PATTERNS = {k: re.compile(p, re.S | re.M) for k, p in _SIGNS}
_BY_SIGN = {c: [(k, _PATTERNS[k]) for k in KINDS if c in _FIRST.get(k, "")] for c in "<>&$%#~|*_={}[]`\\!' "}
_LINE_KINDS = {c: [(k, _PATTERNS[k]) for k in KINDS if k in _AT_LINE] for c in "`{=-*_#|>:;+0123456789~["}
_INDENT = re.compile(r"(?: {4}|\t)[ \t]*\S")
_PLACE = re.compile(r"^[ \t]*(?=[`{=*_#|>:;+\d~\[-])|^(?: {4}|\t)(?=[ \t]*\S)|(?<=\S) {2,}(?=\n)|[<>&$%#~|*_={}\[\]`\\!]|''", re.M)


def _signs(text: str) -> Iterator[tuple[str, re.Match]]:
    """(kind, match) of the signs from left to right; at one place the kinds are tried in their order."""
    at, n = 0, len(text)
    while at < n:
        place = _PLACE.search(text, at)
        if place is None:
            return
        start = place.start()
        got = None
        # a line start is seen only where the search stands at it
        if start == 0 or text[start - 1] == "\n":
            first = place.end() if not place[0].strip() else start
            kinds = _LINE_KINDS.get(text[first : first + 1], [])
            own = _BY_SIGN.get(text[start], [])
            order = sorted({k for k, _ in [*kinds, *own]} | ({"indented"} if _INDENT.match(text, start) else set()), key=KINDS.index)
        else:
            order = [k for k, _ in _BY_SIGN.get(text[start], [])]
        for kind in order:
            got = _PATTERNS[kind].match(text, start)
            if got and got.end() > start:
                yield kind, got
                break
            got = None
        at = got.end() if got else start + 1


class Node:
    """A sign that may be markup: its kind, place and features."""

    __slots__ = ("kind", "start", "end", "text", "name", "closing", "features")

    def __init__(self, kind: str, m: re.Match) -> None:
        self.kind, self.start, self.end, self.text = kind, m.start(), m.end(), m[0]
        self.name = (m["name"] or "").lower() if kind == "tag" else ""
        self.closing = kind == "tag" and m[0].startswith("</")
        self.features: np.ndarray | None = None


def nodes(text: str) -> list[Node]:
    out = [Node(kind, m) for kind, m in _signs(text)]
    kinds = [n.kind for n in out]
    for i, n in enumerate(out):
        n.features = _features(text, n, sum(kinds[j] == n.kind for j in (i - 1, i + 1) if 0 <= j < len(out)))
    return out


EXTRA = ("unknown_name", "money", "loose", "lone_rule", "alone", "late_number", "like_neighbour", "bare_setting")


def _defined(text: str) -> set[str]:
    """The names that link definitions of a text give, in lower case."""
    return {m[0][m[0].index("[") + 1 : m[0].index("]:")].strip().lower() for m in _PATTERNS["definition"].finditer(text)}


def _features(text: str, n: Node, alike: int) -> np.ndarray:
    """One-hot kind and a few facts that tell markup from its look-alikes."""
    x = np.zeros(len(KINDS) + len(EXTRA) + 1)
    x[KINDS.index(n.kind)] = 1
    facts = dict.fromkeys(EXTRA, 0.0)
    if n.kind == "tag":
        facts["unknown_name"] = float(n.name not in TAGS)
    elif n.kind == "ref":
        facts["unknown_name"] = float(n.text[1] != "#" and n.text[1:] not in html5)
    elif n.kind == "reference":
        names = re.findall(r"\[([^\[\]\n]*)\]", n.text)
        facts["unknown_name"] = float((names[-1] or names[0]).strip().lower() not in _defined(text))
    elif n.kind == "dollars":
        inner = n.text[1:-1]
        facts["money"] = float(inner[0].isdigit() or inner[0].isspace() or inner[-1].isspace())
    elif n.kind == "rule":
        before = text[: n.start].rsplit("\n", 2)
        above = before[-2].strip() if len(before) > 1 else ""
        facts["lone_rule"] = float(not above and len(n.text.strip()) < 3)
    elif n.kind == "item":
        number = re.match(r"\s*(\d+)", n.text)
        line_before = text[: n.start].rsplit("\n", 2)
        interrupts = len(line_before) > 1 and bool(line_before[-2].strip())
        facts["late_number"] = float(bool(number) and int(number[1]) > 1 and not alike and interrupts or bool(number) and int(number[1]) > 20 and not alike)
    elif n.kind == "tablerow":
        facts["alone"] = float(not alike)
    elif n.kind == "quote":
        facts["money"] = float(text[n.end : n.end + 1].isdigit())
    elif n.kind == "sign":
        facts["loose"] = 1.0
    facts["like_neighbour"] = float(alike > 0)
    x[len(KINDS) : -1] = [facts[e] for e in EXTRA]
    x[-1] = 1
    return x


def training_texts(n: int, seed: int = 5) -> list[tuple[str, bool]]:
    """Generated texts, each with one construct, and whether it is markup. Every kind and look-alike is drawn with random words."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("aeioubdklmnrst") for _ in range(rng.randint(2, 8)))
    words = lambda k=3: " ".join(word() for _ in range(rng.randint(1, k)))
    num = lambda: str(rng.randint(1, 90))
    tags = sorted(TAGS)
    true = [
        lambda: f"<{(t := rng.choice(tags))}>{words()}</{t}>", lambda: f"{words()}<br/>{words()}", lambda: f"{words()}.<{rng.choice(tags)}>", lambda: f"<!-- {words()} -->", lambda: f"<a href=\"https://x.example/{num()}\">{words()}</a>",
        lambda: f"{word()} &{rng.choice(['amp', 'lt', 'eacute', 'nbsp', 'gt'])}; {word()}", lambda: f"{word()} &#{rng.randint(33, 9999)};", lambda: f"```\n{words()}\n```", lambda: f"{word()} `{words()}` {word()}",
        lambda: f"\\[ {word()} = {num()} \\]", lambda: f"with \\({word()[0]}\\) {word()}", lambda: f"is ${word()[0]} \\approx {num()}$ long", lambda: f"{{|\n! {word()}\n|-\n| {word()} || {num()}\n|}}", lambda: f"{{{{{word()}|{word()}={num()}}}}}",
        lambda: f"see [[{words()}|{words()}]]", lambda: f"[https://x.example/{word()} {words()}]", lambda: f"[{words()}](https://x.example/{num()})", lambda: f"\\begin{{{word()}}}\n\\item {words()}\n\\end{{{word()}}}", lambda: f"\\{rng.choice(['textbf', 'emph', 'section'])}{{{words()}}} {words()}",
        lambda: f"{word()}\\'e {word()}", lambda: f"{num()}\\% {word()}", lambda: f"== {words()} ==\n{words()}", lambda: f"''{words()}''", lambda: f"'''{words()}''': {words()}", lambda: f"{words()}\n{'-=' [rng.random() < 0.5] * rng.randint(3, 12)}\n{words()}",
        lambda: f"{'#' * rng.randint(1, 6)} {words()}\n\n{words()}", lambda: f"| {word()} | n |\n|---|---|\n| {word()} | {num()} |", lambda: f"> {words()}\n> {words()}", lambda: f"** {words()}", lambda: f"- {words()}\n- {words()}", lambda: f"* {words()}\n* {words()}", lambda: f"- {words()}",
        lambda: f"1. {words()}\n2. {words()}", lambda: f"{word()} **{words()}** {word()}", lambda: f"_{words()}_ and ~~{words()}~~", lambda: f"*{words()}* {word()}", lambda: f"<https://x.example/{num()}>", lambda: f"> {words()}",
        lambda: f"~~~\n{words()}\n~~~", lambda: f"    {word()} = {word()}\n    {words()}", lambda: f"see [{words()}][{(t := word())}]\n\n[{t}]: https://x.example/{num()}", lambda: f"{words()}  \n{words()}",
        lambda: f"\\begin{{equation}}\n{word()} = {num()}\n\\end{{equation}}", lambda: f"\\begin{{verbatim}}\n{words()}\n\\end{{verbatim}}",
    ]
    false = [
        lambda: f"cost ${num()} to ${num()} in {word()}", lambda: f"I <3 {word()}", lambda: f"is < {num()} m2 & {word()}", lambda: f"{word()} >{num()}pm, <{num()}am", lambda: f"{word()}&{word()}q; {word()}", lambda: f"<{word()}q {word()}>", lambda: f"press {{{word().upper()}}} twice", lambda: f"{word()} [{word()}] {word()}",
        lambda: f"our #{num()} {word()}, {num()}*", lambda: f"~{num()} min", lambda: f"{num()} cm | {num()} cm", lambda: f"{word()} = {num()}, {word()} = {word()}", lambda: f"{num()}% off", lambda: f"{word()}_{word()}_{num()}G", lambda: f"{words()} & {words()}", lambda: f"{words()}\n{rng.randint(21, 300)}. {words()}",
        lambda: f"paid ${num()} or ${num()}", lambda: f">{num()} nights {word()}", lambda: f"\n\n-\n\n{words()}", lambda: f"| {words()} |", lambda: f"{word()} [{words()}][{word()}] {word()}",
    ]
    out = []
    for i in range(n):
        group, is_true = (true, True) if i % 5 < 3 else (false, False)
        out.append((f"{words(6)}.\n\n{rng.choice(group)()}\n\n{words(4)}", is_true))
    return out


def train(n: int = 1500, rounds: int = 25) -> np.ndarray:
    """Weights of the node classifier: logistic regression by Newton steps over the nodes of the generated texts."""
    rows, labels = [], []
    for text, is_true in training_texts(n):
        for node in nodes(text):
            rows.append(node.features)
            # signs left over beside a construct are literal in any text
            labels.append(float(is_true and node.kind != "sign"))
    x, y = np.array(rows), np.array(labels)
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = (p * (1 - p))[:, None] * x
        w -= np.linalg.solve(x.T @ slope + 0.02 * np.eye(len(w)), x.T @ (p - y) + 0.02 * w)
    return w


#: Weights of the edges between an opening and a closing sign, like neighbours, and signs of one parent.
PAIR, NEIGHBOUR, PARENT = 3.0, 0.8, 0.3


def edges(found: list[Node], text: str) -> list[tuple[int, int, float]]:
    """Smoothness edges: adjacency of like signs, and proximity in the element tree."""
    out, open_tags = [], []
    last_of: dict[tuple[str, int], int] = {}
    for i, n in enumerate(found):
        if i and found[i - 1].kind == n.kind and n.kind != "sign" and text[found[i - 1].end : n.start].count("\n") <= 2:
            out.append((i - 1, i, NEIGHBOUR))
        if n.kind in ("tag", "environment"):
            closing = n.closing or n.text.startswith("\\end")
            if closing:
                for k in range(len(open_tags) - 1, -1, -1):
                    if found[open_tags[k]].name == n.name:
                        out.append((open_tags[k], i, PAIR))
                        del open_tags[k:]
                        break
            else:
                parent = open_tags[-1] if open_tags else -1
                if (n.kind, parent) in last_of:
                    out.append((last_of[n.kind, parent], i, PARENT))
                last_of[n.kind, parent] = i
                open_tags.append(i)
    return out


def minimum_cut(costs: list[tuple[float, float]], links: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes lie on the source side of a minimum cut; costs are (capacity from the source, capacity to the sink).

    What can flow straight through a node flows first, so only nodes that disagree with their links are
    left; then blocking flows along shortest paths, all paths of a length at once. A long list of signs
    that agree costs one pass.
    """
    n = len(costs)
    if not links:
        return [a > b for a, b in costs]
    source, sink = n, n + 1
    to: list[int] = []
    left: list[float] = []
    out: list[list[int]] = [[] for _ in range(n + 2)]

    def add(a: int, b: int, there: float, back: float) -> None:
        out[a].append(len(to))
        out[b].append(len(to) + 1)
        to.extend((b, a))
        left.extend((there, back))

    for i, (a, b) in enumerate(costs):
        if a > b:
            add(source, i, a - b, 0.0)
        elif b > a:
            add(i, sink, b - a, 0.0)
    for a, b, w in links:
        add(a, b, w, w)
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = deque([source])
        while queue:
            at = queue.popleft()
            for e in out[at]:
                if left[e] > 1e-9 and level[to[e]] < 0:
                    level[to[e]] = level[at] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return [level[i] >= 0 for i in range(n)]
        turn = [0] * (n + 2)
        path: list[int] = []
        at = source
        while True:
            if at == sink:
                flow = min(left[e] for e in path)
                full = next(k for k, e in enumerate(path) if left[e] - flow <= 1e-9)
                for e in path:
                    left[e] -= flow
                    left[e ^ 1] += flow
                at = to[path[full] ^ 1]
                del path[full:]
            elif turn[at] < len(out[at]):
                e = out[at][turn[at]]
                if left[e] > 1e-9 and level[to[e]] == level[at] + 1:
                    path.append(e)
                    at = to[e]
                else:
                    turn[at] += 1
            elif path:
                at = to[path.pop() ^ 1]
                turn[at] += 1
            else:
                break


def label(text: str, weights: np.ndarray) -> list[Node]:
    """The nodes of a text that are markup."""
    if not _MAY_BE.search(text):
        return []
    found = nodes(text)
    if not found:
        return []
    odds = np.clip(np.array([n.features for n in found]) @ weights, -12, 12)
    # minus the log-probabilities: what it costs to read a node literally, and as markup
    costs = [(math.log1p(math.exp(z)), math.log1p(math.exp(-z))) for z in odds]
    return [n for n, yes in zip(found, minimum_cut(costs, edges(found, text))) if yes]


def _inner(text: str, n: int) -> str:
    return text[n : len(text) - n]


_ACCENTS = {"`": "\u0300", "'": "\u0301", "^": "\u0302", "~": "\u0303", '"': "\u0308", "=": "\u0304", ".": "\u0307"}
_BLOCK = frozenset("p div section article ul ol table blockquote dl form header footer main nav aside figure tbody thead center address details".split())
# LaTeX commands that only set the layout, with no text of their own.
_LAYOUT = frozenset("""centering raggedright noindent indent bigskip medskip smallskip newpage clearpage pagebreak hfill vfill tiny small large Large LARGE
huge Huge normalsize bfseries itshape rmfamily sffamily ttfamily hline maketitle tableofcontents quad qquad left right limits displaystyle
label vspace hspace documentclass usepackage""".split())


def _free_mark(text: str) -> str:
    """A character that the text does not hold: it brackets finished code and formulas, which later rounds must leave alone."""
    held = set(text)
    return next(c for c in map(chr, itertools.chain(range(0xE000, 0xF900), range(0xF0000, 0x110000))) if c not in held)


def _command(t: str) -> str:
    """The text of a LaTeX command: its last argument, or what its name stands for."""
    name, args = re.match(r"\\([A-Za-z]+)", t)[1], re.findall(r"\{([^{}]*)\}", t)
    if name == "item":
        return "\n- "
    if name.endswith("section") or name in ("chapter", "paragraph"):
        return f"\n\n# {args[-1] if args else ''}\n"
    if name in ("newline", "par", "linebreak"):
        return "\n"
    if name in _LAYOUT:
        return ""
    if name in ("frac", "dfrac", "tfrac") and len(args) == 2:
        return f"{args[0]}/{args[1]}"
    if name in ("ref", "cite", "eqref"):
        return f"[{', '.join(args)}]"
    if args:
        return args[-1]
    size = "CAPITAL" if name[0].isupper() else "SMALL"
    try:
        return unicodedata.lookup(f"GREEK {size} LETTER {name.upper()}")
    except KeyError:
        return name


def _render(n: Node, held: list[str], mark: str) -> str:
    """What stands for a markup node in clean text."""
    t, kind = n.text, n.kind

    def hold(block: str) -> str:
        held.append(block)
        return f"{mark}{len(held) - 1}{mark}"

    if kind in ("comment", "definition"):
        return ""
    if kind == "template":
        name, _, rest = _inner(t, 2).partition("|")
        return f"{name.strip()}: {rest.strip()}" if rest.strip() else name.strip()
    if kind == "ref":
        made = html.unescape(t).replace("\xa0", " ")
        return hold(made) if mark in made else made
    if kind == "hardbreak":
        return "\n"
    if kind == "indented":
        return hold("```\n" + re.sub(r"^(?: {4}|\t)", "", t, flags=re.M) + "\n```")
    if kind == "reference":
        return re.match(r"!?\[([^\]]*)\]", t)[1]
    if kind == "block":
        name = re.match(r"\\begin\{(\w+)", t)[1]
        inner = re.sub(r"^\\begin\{\w+\*?\}|\\end\{\w+\*?\}$", "", t).strip("\n")
        code = name in ("verbatim", "lstlisting")
        return "\n" + hold(f"```\n{inner}\n```" if code else f"$$ {inner.strip()} $$") + "\n"
    if kind == "tag":
        if n.name == "br":
            return "\n"
        if n.name == "li":
            return "" if n.closing else "\n- "
        if re.fullmatch(r"h[1-6]", n.name):
            return "\n\n" if n.closing else "\n\n# "
        if n.name in ("td", "th"):
            return " | " if n.closing else ""
        if n.name in ("tr", "dt", "dd", "caption", "option"):
            return "\n"
        return "\n\n" if n.name in _BLOCK else "\n" if n.name == "hr" else ""
    if kind == "fence":
        return "\n" + hold("```\n" + re.sub(r"^ {0,3}(?:```|~~~)[^\n]*\n?|\n? {0,3}(?:```|~~~)[ \t]*$", "", t) + "\n```") + "\n"
    if kind == "code":
        return hold(t.strip("`").strip())
    if kind == "display":
        return "\n" + hold(f"$$ {_inner(t, 2).strip()} $$") + "\n"
    if kind in ("inline", "dollars"):
        return hold(f"$ {(_inner(t, 2) if kind == 'inline' else _inner(t, 1)).strip()} $")
    if kind == "wikitable":
        rows = [[c.strip() for c in re.split(r"\|\||!!", line.lstrip("|!"))] for line in t.split("\n")[1:-1] if line.strip() and not line.startswith(("|-", "|+"))]
        return "\n" + "\n".join("| " + " | ".join(r) + " |" for r in rows) + "\n"
    if kind == "wikilink":
        return _inner(t, 2).rpartition("|")[2]
    if kind == "extlink":
        return _inner(t, 1).split(None, 1)[-1]
    if kind == "link":
        return re.match(r"!?\[([^\]]*)\]", t)[1]
    if kind == "autolink":
        return _inner(t, 1)
    if kind == "environment":
        return "\n"
    if kind == "command":
        return _command(t)
    if kind == "accent":
        return unicodedata.normalize("NFC", re.sub(r"[\\{}]", "", t[2:]) + _ACCENTS[t[1]])
    if kind == "escape":
        return "\n" if t == "\\\\" else t[1]
    if kind == "wikiheading":
        return f"\n\n# {t.strip().strip('=').strip()}\n"
    if kind == "quotes":
        return t.strip("'")
    if kind == "rule":
        return ""
    if kind == "heading":
        return f"\n\n# {t.strip().strip('#').strip()}\n"
    if kind == "tablerow":
        return "" if re.fullmatch(r"[\s|:-]+", t) else "| " + " | ".join(c.strip() for c in t.strip().strip("|").split("|")) + " |"
    if kind == "quote":
        return ""
    if kind in ("items", "item"):
        number = re.match(r"\s*(\d+)[.)]", t)
        return f"{number[1]}. " if number else "  " * (len(t.strip()) - 1) * (kind == "items") + "- "
    if kind in ("strong", "strike"):
        return _inner(t, 2)
    return _inner(t, 1)


_PRE = re.compile(r"<pre\b[^>]*>(?:\s*<code\b[^>]*>)?(.*?)(?:</code>\s*)?</pre\s*>", re.S | re.I)
_DROP = re.compile(r"<(script|style)\b[^>]*>.*?</\1\s*>", re.S | re.I)


def clean(text: str | None, weights: np.ndarray) -> tuple[str | None, list[tuple[str, str]], bool]:
    """(clean text, [(kind of block, text)], whether there was markup).

    In clean text headings begin with "# ", list items with "- " or a number, table rows
    with "| "; code stands between fences, formulas between dollar signs. Escaped markup
    is unescaped and cleaned too, round after round until nothing more is found. What is struck out stays,
    of templates the name and what they are given, of comments nothing. Null stays null, and text without
    markup stays as it is.
    """
    if text is None:
        return None, [], False
    found = label(text, weights)
    if not found:
        return text, [("paragraph", p) for p in text.split("\n\n") if p.strip()], False
    held: list[str] = []
    out, own, mark = text, set(), _free_mark(text)
    seen: set[int] = set()

    def code(m: re.Match) -> str:
        held.append("```\n" + html.unescape(re.sub(r"<[^>]*>", "", m[1])).strip("\n") + "\n```")
        return f"\n{mark}{len(held) - 1}{mark}\n"

    for step in range(len(text) + 2):  # a round that changes anything takes a sign away
        if hash(out) in seen:  # and one that gives an earlier text again can find nothing new
            break
        seen.add(hash(out))
        out = _DROP.sub("", out)
        out = _PRE.sub(code, out)
        again = [n for n in label(out, weights) if step == 0 or n.kind not in ("item", "heading", "tablerow", "indented", "hardbreak") or n.text not in own]
        if not again:
            break
        parts, at = [], 0
        titles = _setext(out, again)
        for n in again:
            if n.start >= at:
                made = _render(n, held, mark)
                parts += [_titled(out[at : n.start]) if n in titles else out[at : n.start], made]
                own.add(made)
                at = n.end
        out = "".join(parts) + out[at:]
        if not any(k in out for k in "<&'`*_[\\{~"):
            break
    out = re.sub(r"[ \t]+\n", "\n", out)
    out = re.sub(r"(?<=\S) {2,}(?=\S)", " ", out)
    out = re.sub(r"\n{3,}", "\n\n", out).strip()
    blocks = []
    for line in re.split(r"\n", out):
        kind = "heading" if line.startswith("# ") else "list" if re.match(r"\s*(?:- |\d+\. )", line) else "table" if re.match(r"\| |.* \| $", line) else "paragraph"
        for piece in re.split(f"({mark}\\d+{mark})", line):
            if piece.startswith(mark):
                block = held[int(piece.strip(mark))]
                blocks.append(("formula" if block.startswith("$") else "code", block))
            elif piece.strip():
                blocks.append((kind, piece.strip().removeprefix("# ") if kind == "heading" else piece.strip()))
    final = re.sub(f"{mark}(\\d+){mark}", lambda m: held[int(m[1])], out)
    return final, blocks, True


def _setext(text: str, found: list[Node]) -> set[Node]:
    """Underlines that make the line above them a heading."""
    return {n for n in found if n.kind == "rule" and n.text.strip()[:1] in "=-" and text[: n.start].endswith("\n") and text[: n.start - 1].rsplit("\n", 1)[-1].strip()}


def _titled(before: str) -> str:
    head, newline, line = before[:-1].rpartition("\n")
    return f"{head}{newline}\n# {line.strip()}\n"


def _fields(df: DataFrame, id_col: str, columns: tuple[str, ...]) -> DataFrame:
    fields = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("text")) for c in columns])).alias("f")
    return spread(df.select(F.col(id_col).cast("long").alias("id"), *columns), "id").select("id", fields).select("id", "f.field", "f.text")


def marked(df: DataFrame, id_col: str, columns: tuple[str, ...]) -> DataFrame:
    """(id, field) of the texts in which the cut leaves any sign on the side of markup; repeated rows repeat."""
    weights = train()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = pa.array([bool(t) and bool(label(t, weights)) for t in batch.column("text").to_pylist()], pa.bool_())
            yield batch.select(["id", "field"]).filter(keep)

    return _fields(df, id_col, columns).where("text is not null").mapInArrow(run, "id long, field string")


def cleaned(df: DataFrame, id_col: str, columns: tuple[str, ...]) -> DataFrame:
    """(id, field, has_markup, clean, blocks) for each row and text column.

    Null texts give a null clean text; rows with a null id are kept with it. The weights
    are trained once on the driver from generated texts and are a few hundred bytes.
    """
    weights = train()
    block = pa.list_(pa.struct([("kind", pa.string()), ("text", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [clean(t, weights) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("field"), pa.array([m[2] for m in made], pa.bool_()), pa.array([m[0] for m in made], pa.string()), pa.array([[{"kind": k, "text": t} for k, t in m[1]] for m in made], block)],
                names=["id", "field", "has_markup", "clean", "blocks"],
            )

    return _fields(df, id_col, columns).mapInArrow(run, "id long, field string, has_markup boolean, clean string, blocks array<struct<kind: string, text: string>>")
