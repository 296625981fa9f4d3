"""Markup residue in text: a tree of candidate nodes, boosted trees over their features, and a decoding that
respects the tree, then clean text that keeps headings, lists, tables, code and formulas.

Every place that could be markup becomes a node: HTML tags, entities and comments, Markdown, wiki and LaTeX
constructs, and also every bare sign. An HTML element reaches from its tag to the tag that closes it; braces,
brackets and elements nest as deep as the text has them. Features are the node's kind, shape and surroundings, the
tokens of its attributes, its depth, statistics of its siblings, and the density of nodes and letters in its
subtree. The trees are trained here on texts put together from markup constructs and ordinary uses of the same
signs (:data:`TRAIN_TEXTS` of them). The decoding finds the labels with the largest sum of log-odds, from the leaves
to the roots, under which nothing inside code is markup and the parts of one whole share its label.
"""

from __future__ import annotations

import html
import html.entities
import random
import re
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitrine.llm.boost import BoostedTrees
from vitrine.scratch import spread

#: Texts that the classifier is trained on.
TRAIN_TEXTS = 6_000
#: Node features of so many fields are scored at once.
BATCH_FIELDS = 2_000

#: Element names of HTML.
TAGS = frozenset(
    "a abbr address article aside audio b blockquote body br button caption center cite code col colgroup dd del details dfn div dl dt em figcaption figure font footer form h1 h2 h3 h4 h5 h6 head header hr html i iframe img input ins kbd label li link main mark meta nav nobr nowiki object ol option p pre q ref s samp script section select small source span strike strong style sub summary sup table tbody td textarea tfoot th thead time title tr tt u ul var video wbr".split()
)
VOID = frozenset("br hr img input meta link col source wbr".split())
#: Attribute names of HTML.
ATTRIBUTES = ("class", "id", "style", "href", "src", "alt", "title", "width", "height", "align", "border", "color", "size", "face", "lang", "dir", "name", "target", "rel", "type", "value", "colspan", "rowspan", "cellpadding", "cellspacing", "bgcolor")
BLOCK = frozenset("p div section article header footer table ul ol dl tr blockquote figure address main aside nav form center caption br hr".split())
#: Common commands of LaTeX.
COMMANDS = frozenset("item section subsection subsubsection chapter paragraph emph textbf textit texttt textsc underline href url frac sqrt cdot times mathrm mathbf text label ref cite footnote caption centering hline par newline noindent today LaTeX".split())
KINDS = (
    "comment raw tag entity fence code link wikilink template wikitable wikihead head under row quote strong emph strike wikiemph env display verb command escape math tie sign bullet".split()
)
_NUM = {k: i for i, k in enumerate(KINDS)}

_NODE = re.compile(
    r"""
    (?P<comment><!--.*?(?:-->|\Z))
  | (?P<raw><(?P<rawname>script|style)\b[^<>]*>.*?</(?P=rawname)\s*>)
  | (?P<tag></?[A-Za-z][A-Za-z0-9:-]*(?:\s[^<>]*)?/?>?)
  | (?P<entity>&(?:\#\d{1,7}|\#[xX][0-9A-Fa-f]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});?)
  | (?P<fence>```[^\n`]*\n.*?(?:```|\Z))
  | (?P<code>(?<!`)`[^`\n]+`(?!`))
  | (?P<link>!?\[[^\[\]\n]*\]\()
  | (?P<wikilink>\[\[[^\[\]\n]+\]\])
  | (?P<template>\{\{)
  | (?P<wikitable>\{\|.*?(?:\n\|\}|\Z))
  | (?P<wikihead>^(?P<eq>={2,6})[ ]*[^=\n][^\n]*?(?P=eq)[ ]*$)
  | (?P<head>^\#{1,6}[ ]+\S[^\n]*$)
  | (?P<under>^(?:={3,}|-{3,})[ ]*$)
  | (?P<row>^[ ]*\|[^\n]*\|[ ]*$)
  | (?P<quote>^>[ ]+\S[^\n]*$)
  | (?P<strong>(?P<sd>\*\*|__)(?=[^\s*_])[^\n]+?(?<=[^\s*_])(?P=sd))
  | (?P<emph>(?<![\w*])(?P<ed>\*|_)(?=[^\s*_])[^*_\n]+?(?<=[^\s*_])(?P=ed)(?![\w*]))
  | (?P<strike>~~(?=\S)[^~\n]+~~)
  | (?P<wikiemph>(?P<wd>'{2,5})(?=[^\s'])[^'\n]+(?P=wd))
  | (?P<env>\\(?:begin|end)\{[A-Za-z*]+\})
  | (?P<display>\\\[.*?\\\]|\\\(.*?\\\))
  | (?P<verb>\\verb(?P<vd>[^\sA-Za-z]).*?(?P=vd))
  | (?P<command>\\[A-Za-z]+\*?(?:\[[^\]\n]*\])?)
  | (?P<escape>\\[%&$\#_{}~^,;!\\])
  | (?P<math>\$[^$\n]+\$)
  | (?P<tie>(?<=\S)~(?=\S))
  | (?P<bullet>^[ ]*(?:[-*+•‣]|\d{1,3}[.)])[ ]+)
  | (?P<sign>[<>&*_\#$~^{}\[\]|=\\`]+)
    """,
    re.X | re.S | re.M,
)
#: Where a node can begin; the pattern above is tried only there.
_BEGIN = re.compile(r"[<>&`!\[\]{}|*_~'\\$\#=^]|(?:^|(?<=\n))(?:[ ]*(?:[-+•‣]|\d{1,3}[.)])[ ]|-{3}|[ ]+[|*])")
_SIGNS = re.compile(r"[<>&`\[\]{}|*_~'\\$\#=^]|(?:^|\n)-{3}")
_INNER = frozenset("wikihead head row quote strong emph strike wikiemph link wikilink wikitable template command".split())
_PART = frozenset("row under".split())
_CODE = frozenset("pre code nowiki tt kbd samp".split())
_TAG_NAME, _COMMAND_NAME = re.compile(r"</?([A-Za-z0-9:-]+)"), re.compile(r"\\([A-Za-z]+)")
_ATTRIBUTE = re.compile(r"\s([A-Za-z][A-Za-z0-9:-]*)\s*(=\s*[\"'])?")
_LETTERS = re.compile(r"[^\W\d_]+")


class Node:
    """A candidate. ``tail`` is where its subtree ends, ``args`` the ranges of its braces."""

    __slots__ = ("kind", "start", "end", "name", "closing", "depth", "parent", "kids", "pair", "siblings", "place", "tail", "args", "markup")

    def __init__(self, kind: str, start: int, end: int, depth: int, parent: int) -> None:
        self.kind, self.start, self.end, self.depth, self.parent = kind, start, end, depth, parent
        self.name, self.closing, self.kids, self.pair, self.siblings, self.place, self.tail, self.args, self.markup = "", False, [], -1, 0, 0, end, (), False


def _closed(text: str, at: int, hi: int, left: str, right: str, stop: str = "") -> int:
    """The place after the ``right`` that closes the ``left`` at ``at``, or -1; none of ``stop`` may lie between."""
    depth = 0
    while at < hi:
        c = text[at]
        if c == left:
            depth += 1
        elif c == right:
            depth -= 1
            if not depth:
                return at + 1
        elif c in stop:
            return -1
        at += 1
    return -1


def _extent(text: str, kind: str, m: re.Match, hi: int) -> tuple[str, int, tuple[tuple[int, int], ...]]:
    """(kind, end, ranges of the arguments) of a match; what does not close is a bare sign."""
    end = m.end()
    if kind == "command":
        args = []
        while end < hi and text[end] == "{" and (to := _closed(text, end, hi, "{", "}")) > 0:
            args.append((end + 1, to - 1))
            end = to
        return kind, end, tuple(args)
    if kind == "template":
        to = _closed(text, m.start(), hi, "{", "}")
        return (kind, to, ()) if to > 0 and text[to - 2] == "}" else ("sign", end, ())
    if kind == "link":
        to = _closed(text, end - 1, hi, "(", ")", "\n")
        inside = text[end : to - 1]
        if to > 0 and re.fullmatch(r'\S*(?:\s"[^"]*")?', inside):
            return kind, to, ((text.index("[", m.start()) + 1, end - 2),)
        return "sign", m.start() + (2 if text[m.start()] == "!" else 1), ()
    return kind, end, ()


def parse(text: str) -> list[Node]:
    """The nodes in order, parents before their parts. Spans nest; HTML tags nest by their pairs."""
    nodes: list[Node] = []
    if not _SIGNS.search(text):
        return nodes
    todo = [(0, len(text), 0, -1)]
    while todo:
        lo, hi, depth, parent = todo.pop()
        open_: list[int] = []
        named: dict[str, list[int]] = {}  # places in open_ of the open elements of each name
        at = lo
        while at < hi:
            begin = _BEGIN.search(text, at, hi)
            if begin is None:
                break
            m = _NODE.match(text, begin.start(), hi)
            if m is None:
                at = begin.start() + 1
                continue
            kind = m.lastgroup if m.lastgroup in _NUM else next(k for k in KINDS if m.group(k) is not None)
            kind, end, args = _extent(text, kind, m, hi)
            top = open_[-1] if open_ else parent
            node = Node(kind, m.start(), end, depth + len(open_), top)
            node.args = args
            index = len(nodes)
            nodes.append(node)
            if top >= 0:
                node.place = len(nodes[top].kids)
                nodes[top].kids.append(index)
            body = text[m.start() : end]
            if kind == "tag":
                node.closing = body.startswith("</")
                node.name = _TAG_NAME.match(body).group(1).lower()
                if node.closing:
                    if named.get(node.name):
                        k = named[node.name][-1]
                        node.pair, nodes[open_[k]].pair = open_[k], index
                        node.depth, nodes[open_[k]].tail = nodes[open_[k]].depth, end
                        for i in open_[k:]:
                            named[nodes[i].name].pop()
                        del open_[k:]
                elif body.endswith(">") and not body.endswith("/>") and node.name in TAGS and node.name not in VOID:
                    named.setdefault(node.name, []).append(len(open_))
                    open_.append(index)
            elif kind == "env":
                node.name = body[body.index("{") + 1 : -1]
                node.closing = body.startswith("\\end")
            elif kind == "command":
                node.name = _COMMAND_NAME.match(body).group(1)
            elif kind == "raw":
                node.name = m.group("rawname")
            elif kind == "entity":
                node.name = body.strip("&;")
            at = end
            if kind in _INNER:
                if kind == "command":
                    inner = args
                elif kind == "link":
                    inner = args[:1]
                else:
                    lead = len(body) - len(body.lstrip(" ![*_~'#=>|{"))
                    inner = ((m.start() + max(lead, 1), end - 1),)
                todo += [(i, j, node.depth + 1, index) for i, j in inner if i < j]
    seen: dict[tuple[int, str], int] = {}
    for n in nodes:
        seen[(n.parent, n.kind)] = seen.get((n.parent, n.kind), 0) + 1
    for n in nodes:
        n.siblings = seen[(n.parent, n.kind)] - 1
    return nodes


_ENTITIES = frozenset(k.rstrip(";") for k in html.entities.html5)
#: Features besides the kind: of the node, of its attributes, of its siblings, of its subtree.
WIDTH = len(KINDS) + 35


def _class(c: str) -> float:
    """0 none, 1 blank, 2 letter, 3 digit, 4 sign."""
    return 0.0 if not c else 1.0 if c.isspace() else 2.0 if c.isalpha() else 3.0 if c.isdigit() else 4.0


def features(text: str, nodes: list[Node]) -> np.ndarray:
    out = np.zeros((len(nodes), WIDTH))
    if not nodes:
        return out
    total, base = len(text), len(KINDS)
    # nodes of every subtree, counted from the last node to the first
    below, inside_chars = [0] * len(nodes), [0] * len(nodes)
    for r in range(len(nodes) - 1, -1, -1):
        p = nodes[r].parent
        if p >= 0:
            below[p] += below[r] + 1
            inside_chars[p] += nodes[r].end - nodes[r].start
    pairs: dict[int, int] = {}
    for n in nodes:
        if n.pair >= 0:
            pairs[n.parent] = pairs.get(n.parent, 0) + 1
    tops = sum(n.parent < 0 for n in nodes)
    for r, n in enumerate(nodes):
        body = text[n.start : n.end]
        size = n.end - n.start
        inside = body[1:-1]
        after = text[n.end : n.end + 1]
        known = unknown = quoted = 0
        flags = [0.0, 0.0, 0.0, 0.0]
        if n.kind == "tag" and not n.closing:
            for name, value in _ATTRIBUTE.findall(body):
                low = name.lower()
                if low in ATTRIBUTES:
                    known += 1
                    flags[min(ATTRIBUTES.index(low), 3)] = 1.0
                else:
                    unknown += 1
                quoted += bool(value)
        tree = n.tail - n.start
        up = nodes[n.parent] if n.parent >= 0 else None
        brothers = len(up.kids) if up is not None else tops
        letters = sum(map(len, _LETTERS.findall(body)))
        row = out[r]
        row[_NUM[n.kind]] = 1.0
        row[base:] = (
            min(size, 400),
            _class(text[n.start - 1] if n.start else ""),
            _class(after),
            float(not n.start or text[n.start - 1] == "\n"),
            float(after in ("", "\n")),
            float(body.endswith(">")),
            float(n.name in TAGS) if n.kind == "tag" else 2.0 * float(n.name in COMMANDS),
            float(n.name in _ENTITIES or n.name.startswith("#")),
            float(body.endswith(";")),
            float(n.closing),
            float(n.pair >= 0),
            float(n.depth),
            letters / max(size, 1),
            _class(inside[:1]),
            _class(inside[-1:]),
            float("\\" in inside or "^" in inside or ("{" in inside and n.kind != "sign")),
            float(body.count("|")),
            float("=" in inside) + 2.0 * float("+" in inside),
            # attribute tokens
            known,
            unknown,
            quoted,
            *flags,
            # siblings
            min(n.siblings, 20),
            min(n.place, 20),
            min(brothers, 40),
            pairs.get(n.parent, 0) / max(brothers, 1),
            _NUM[up.kind] if up is not None else -1.0,
            float(up.pair >= 0) if up is not None else -1.0,
            # the subtree
            min(len(n.kids), 20),
            min(below[r] / max(tree, 1) * 100, 50.0),
            inside_chars[r] / max(tree, 1),
            min(len(nodes) / total * 100, 50.0),
        )
    return out


def decode(nodes: list[Node], odds: np.ndarray) -> None:
    """Sets ``markup`` of each node: of all labellings that do not contradict the tree, the one with the largest sum of
    log-odds. Nothing below code that is markup is markup (but for a ``code`` right below ``pre``), and the parts of one
    whole (tag and closing tag, rows of a table, an environment with its items) share a label.

    The sum is made from the leaves to the roots: a whole is worth its own odds with its parts as markup, and what
    lies below adds its best; code adds nothing from below. Bullets never are markup.
    """
    group: list[int] = []
    first: dict[object, int] = {}
    for i, n in enumerate(nodes):
        if n.pair >= 0:
            key: object = ("pair", min(i, n.pair))
        elif n.kind in _PART:
            key = (n.kind, n.parent)
        elif n.kind == "env" or n.name == "item":
            key = ("env", n.parent)
        else:
            key = i
        group.append(first.setdefault(key, i))
    own = np.zeros(len(nodes))
    for i, g in enumerate(group):
        own[g] += -1e9 if nodes[i].kind == "bullet" else odds[i]
    code = [n.kind == "tag" and n.name in _CODE and not n.closing for n in nodes]

    def above(g: int) -> int:
        """The group over a group. A closing tag lies beside what it closes."""
        p = nodes[g].parent
        return -1 if p < 0 else group[p]

    free = [0.0] * len(nodes)  # the best of what lies below each group, if it may be markup
    inner = [0.0] * len(nodes)  # of that, what stays allowed below code
    as_markup = [False] * len(nodes)
    for g in range(len(nodes) - 1, -1, -1):
        if group[g] != g:
            continue
        yes = own[g] + (inner[g] if code[g] else free[g])
        as_markup[g] = yes > free[g]
        best = max(yes, free[g])
        up = above(g)
        if up >= 0 and up != g:
            free[up] += best
            if nodes[up].name == "pre" and nodes[g].name == "code":
                inner[up] += max(own[g] + inner[g], 0.0)
    inside = [False] * len(nodes)  # below code that is markup
    for g in range(len(nodes)):
        if group[g] == g:
            up, dead = above(g), False
            if up >= 0 and up != g:
                below_code = code[up] and nodes[up].markup
                inside[g] = dead = inside[up] or below_code
                if below_code and not inside[up] and nodes[up].name == "pre" and nodes[g].name == "code":
                    dead, as_markup[g] = False, own[g] + inner[g] > 0
            nodes[g].markup = as_markup[g] and not dead
        else:
            nodes[g].markup = nodes[group[g]].markup


# --- training ------------------------------------------------------------------------------------------------


def _made_text(rng: random.Random) -> list[tuple[str, bool]]:
    """Segments of a made text with their labels: markup or ordinary."""
    words = "steel lid compact body easy clean ready use power cable rated shelf daily model size color garantía fácil limpiar uso diario ギフト箱付き 工具不要 お手入れ簡単 handle soft 5 12 30 W cm kg GB".split()

    def some(lo: int = 1, hi: int = 6) -> str:
        return " ".join(rng.choice(words) for _ in range(rng.randint(lo, hi)))

    def tag(name: str, body: str, attrs: str = "") -> str:
        name = rng.choice([name, name, name.upper()])
        return f"<{name}{attrs}>{body}</{name}>"

    def markup() -> str:
        item = lambda a, b: "".join(f"{a}{some()}{b}" for _ in range(rng.randint(1, 4)))
        esc = lambda t: html.escape(t, quote=False)
        made = [
            lambda: rng.choice(["<br>", "<br/>", "<BR />", "<hr>", "<wbr>"]),
            lambda: tag(rng.choice(["b", "i", "strong", "em", "u", "span", "p", "div", "h1", "h2", "h3", "sub", "sup", "font", "small", "ref", "a"]), some(), rng.choice(["", "", ' class="x-y"', ' id=t1 style="color:#333"', ' href="http://a.example/"'])),
            lambda: f"<ul>{item('<li>', '</li>')}</ul>",
            lambda: f"<table><tr><th>{some()}</th></tr>{item('<tr><td>', '</td></tr>')}</table>",
            lambda: f"<pre><code>{some()}\n{some()}</code></pre>",
            lambda: f"<style>.a{{margin:0}}</style><p></p><script>var t='</p>';</script><!-- {some()} -->",
            lambda: f"<p><i>{some()}",
            lambda: f"<li>{some()}",
            lambda: f"{some()}</p",
            lambda: f"<!-- {some()} -->",
            lambda: rng.choice(["&nbsp;", "&amp;", "&bull;", "&#39;", "&#x2713;", "&quot;", "&eacute;", "&ndash;", "&lt;", "&gt;", "&nbsp", "&amp"]),
            lambda: esc(tag("b", some()) + "<br>"),
            lambda: esc(esc(tag("p", some()))),
            lambda: esc(f"<ul>{item('<li>', '</li>')}</ul>"),
            lambda: f"{some()}&nbsp;{some()} &amp; {some()}",
            lambda: f"\n{'#' * rng.randint(1, 6)} {some()}\n",
            lambda: f"\n{some()}\n{'=' * rng.randint(3, 30)}\n",
            lambda: f"**{some()}**",
            lambda: f"__{some()}__",
            lambda: f"*{some()}*",
            lambda: f"_{some()}_",
            lambda: f"~~{some()}~~",
            lambda: f"`{some(1, 2)}`",
            lambda: f"\n```\n{some()}\n{some()}\n```\n",
            lambda: f"![{some(1, 3)}](img/f{rng.randint(1, 9)}.png)",
            lambda: f"[{some(1, 3)}](https://care.x.example/d{rng.randint(1, 9)})",
            lambda: f"\n| {some(1, 2)} | {some(1, 2)} |\n|------|-------|\n| {some()} | {some(1, 1)} |\n| {some()} | {some(1, 1)} |\n",
            lambda: f"\n> {some()}\n\n",
            lambda: f"'''{some()}'''",
            lambda: f"''{some()}''",
            lambda: f"[[{some(1, 2)}|{some(1, 2)}]]",
            lambda: f"[[{some(1, 2)}]]",
            lambda: f"{{{{{some(1, 2)}|name={some()}|state=new}}}}",
            lambda: f'\n{{| class="wikitable"\n|-\n| {some()} || {some(1, 1)}\n|-\n| {some()} || {some(1, 1)}\n|}}\n',
            lambda: f"\n{'=' * (k := rng.randint(2, 4))} {some()} {'=' * k}\n",
            lambda: f"\\section{{{some()}}} ",
            lambda: f"\\begin{{itemize}}{item(chr(92) + 'item ', ' ')}\\end{{itemize}}",
            lambda: f"\\emph{{{some()}}} \\\\ ",
            lambda: f"\\textbf{{{some()}}}",
            lambda: f"\\verb|{some(1, 1)}|",
            lambda: r"\[ V = \frac{\pi d^2 h}{4} \]",
            lambda: f"\\textbf{{{some(1, 2)} \\emph{{{some(1, 2)}}} {some(1, 2)}}}",
            lambda: f"[**{some(1, 2)}**](https://a.example/x_({rng.randint(1, 9)}))",
            lambda: f"{{{{{some(1, 1)}|{{{{{some(1, 1)}}}}}|{some(1, 2)}}}}}",
            lambda: f"<div><div><p>{some()}</p><span>{some(1, 2)}</span></div></div>",
            lambda: "$" + " + ".join(f"x_{{{k}}}^2" for k in range(rng.randint(2, 90))) + "$",
            lambda: rng.choice([r"$P = U \cdot I$", r"$50\,\mathrm{W}$", "$x^2$", "$E = mc^2$", r"$a_1 + b$", r"\(a^2\)"]),
            lambda: rng.choice([r"15\%", r"energy \& time", r"60\,cm~wide", r"5~kg", r"\#1"]),
        ]
        return rng.choice(made)()

    def ordinary() -> str:
        n = lambda: rng.randint(1, 99)
        made = [
            lambda: f"Rating: 4.{rng.randint(1, 9)}/5 | Noise: low",
            lambda: f"{some()} | {some()} | {some()}",
            lambda: f"Ports: A/B/C = {n()}+{n()}+{n()}",
            lambda: f"a = {n()} and b={n()}",
            lambda: f"{some()} & {some()}",
            lambda: rng.choice(["Q&A support", "R&D team", "M&M's", "AT&T plan", "B&B style"]),
            lambda: f"works at < {n()} V and > {n()} V",
            lambda: f"uses <{n()} W in standby, >{n()} hours",
            lambda: "If x < y the light turns red; if x > y it is green",
            lambda: rng.choice(["x<y or y>x", "a <b only", "I <3 it"]),
            lambda: f"usually ${n()} to ${n()} in other shops",
            lambda: f"from ${n()} or US${n()}",
            lambda: f"range -{n()} ~ {n()} C",
            lambda: f"about ~{n()} g",
            lambda: f"{some(1, 1)}\\{some(1, 1)} on the disc",
            lambda: rng.choice(["Docs\\Guides", "C:\\Setup\\start", "D:\\Manual"]),
            lambda: f"lab tested*, {some()}",
            lambda: f"* {some()}\n* {some()}\n",
            lambda: f"\n- {some()}\n- {some()}\n",
            lambda: f"1. {some()}\n2. {some()}\n",
            lambda: f"model {''.join(rng.choices('ABCDEFGHKLM', k=3))}_{rng.randint(1000, 9999)}",
            lambda: f"file fw_release_{n()}_b is there",
            lambda: rng.choice(["C# and C++ samples", "F# notes", "rated #1 by testers", "item #12", "#5 size"]),
            lambda: f"sheets of {n()}*{n()} cm",
            lambda: f"{n()} * {n()} = {n() * 3}",
            lambda: rng.choice(["[4-pack]", "[new]", "choose the [6-pack] at checkout", "[see box]"]),
            lambda: rng.choice(["sizes {S/M/L}", "{a, b}", "sets {1/2/3}"]),
            lambda: f"10^{rng.randint(2, 9)} cycles",
            lambda: f"{some()} • {some()} ✓ {some()}",
            lambda: f"{some()} / {some()}; {some()}",
            lambda: "---- " + some(),
            lambda: rng.choice(["it's 'soft' and dogs' choice", "don't", "5' 11'' tall", 'a 15" screen']),
            lambda: f"=> {some()} -> {some()}",
            lambda: f"<{some(1, 1)} or more",
        ]
        return rng.choice(made)()

    out = []
    for _ in range(rng.randint(1, 5)):
        kind = rng.random()
        glue = rng.choice([" ", " ", ". ", "\n", ", "])
        if kind < 0.3:
            out.append((some(2, 8) + glue, False))
        elif kind < 0.65:
            out += [(ordinary(), False), (glue, False)]
        else:
            out += [(markup(), True), (glue, False)]
    return out


@cache
def classifier(texts: int = TRAIN_TEXTS, seed: int = 11) -> BoostedTrees:
    rows, labels = [], []
    rng = random.Random(seed)
    for _ in range(texts):
        parts = _made_text(rng)
        text = "".join(t for t, _ in parts)
        marks = np.concatenate([np.full(len(t), m) for t, m in parts])
        nodes = parse(text)
        rows.append(features(text, nodes))
        labels += [0.0 if n.kind == "bullet" else float(marks[n.start : n.end].mean() > 0.5) for n in nodes]
    x, y = np.concatenate(rows), np.array(labels)
    return BoostedTrees(trees=80, depth=5).fit(x, y)


# --- rendering -----------------------------------------------------------------------------------------------

_HEADING = "\ufdd0"  # stands after a line that is underlined as a heading
_LIST_TAGS = {"li": "\n- ", "dt": "\n- ", "dd": "\n  "}


def _inner(text: str, lead: str) -> str:
    return text.strip(lead).strip()


def render(text: str, nodes: list[Node]) -> str:
    """The text with its markup replaced by plain marks for headings, lists, tables, code and formulas."""

    def span(lo: int, hi: int, kids: list[int]) -> str:
        out, at = [], lo
        for k in kids:
            n = nodes[k]
            if n.start < at or n.end > hi:
                continue
            out.append(text[at : n.start])
            out.append(one(n) if n.markup else own(n))
            at = n.end
        out.append(text[at:hi])
        return "".join(out)

    def own(n: Node) -> str:
        """A node that is no markup, with what is markup inside it."""
        return span(n.start, n.end, [k for k in n.kids if nodes[k].start >= n.start and nodes[k].end <= n.end])

    def strip(n: Node, left: int, right: int) -> str:
        lo, hi = n.start + left, n.end - right
        return span(lo, hi, [k for k in n.kids if nodes[k].start >= lo and nodes[k].end <= hi])

    def one(n: Node) -> str:
        body = text[n.start : n.end]
        if n.kind in ("comment", "raw"):
            return " "
        if n.kind == "tag":
            if re.fullmatch(r"h[1-6]", n.name):
                return "\n" if n.closing else "\n" + "#" * int(n.name[1]) + " "
            if n.name in _LIST_TAGS:
                return "" if n.closing else _LIST_TAGS[n.name]
            if n.name in ("td", "th"):
                return "" if n.closing else " | "
            if n.name == "pre":
                return "\n```\n"
            if n.name == "code":
                up = nodes[n.parent] if n.parent >= 0 else None
                up = nodes[up.parent] if n.closing and up is not None and up.name == "code" and up.parent >= 0 else up
                return "" if up is not None and up.name == "pre" else "`"
            if n.name == "sup":
                return "" if n.closing else "^"
            return "\n" if n.name in BLOCK else ""
        if n.kind == "entity":
            return html.unescape(body if body.endswith(";") else body + ";").replace("\xa0", " ")
        if n.kind in ("fence", "code", "display", "math"):
            return body
        if n.kind == "verb":
            return "`" + body[6:-1] + "`"
        if n.kind == "link":
            return span(*n.args[0], n.kids)
        if n.kind == "wikilink":
            return body[2:-2].rsplit("|", 1)[-1]
        if n.kind == "template":
            parts = [k for k in n.kids if nodes[k].kind != "sign"]
            head, *rest = span(n.start + 2, n.end - 2, parts).split("|")
            return f"{head}: {'; '.join(p.replace('=', ': ', 1) for p in rest)}" if rest else head
        if n.kind == "wikitable":
            rows = [r.strip("|! ") for r in re.split(r"\n\|-[^\n]*\n?|\n", body.removesuffix("|}"))[1:]]
            return "\n" + "\n".join("| " + re.sub(r"\s*(?:\|\||!!)\s*", " | ", r) + " |" for r in rows if r) + "\n"
        if n.kind == "wikihead":
            level = len(body) - len(body.lstrip("="))
            return "#" * level + " " + _inner(body, "= ")
        if n.kind == "head":
            return body
        if n.kind == "under":
            return _HEADING
        if n.kind == "row":
            return "" if re.fullmatch(r"[\s|:-]+", body) else body
        if n.kind == "quote":
            return strip(n, 1, 0).strip()
        if n.kind in ("strong", "strike"):
            return strip(n, 2, 2)
        if n.kind == "emph":
            return strip(n, 1, 1)
        if n.kind == "wikiemph":
            return _inner(body, "'")
        if n.kind == "env":
            return "\n"
        if n.kind == "command":
            if n.name == "item":
                return "\n- "
            arg = [span(i, j, [k for k in n.kids if nodes[k].start >= i and nodes[k].end <= j]) for i, j in n.args]
            level = {"chapter": 1, "section": 1, "subsection": 2, "subsubsection": 3}.get(n.name)
            return f"\n{'#' * level} {arg[-1]}\n" if level and arg else " ".join(arg)
        if n.kind == "escape":
            return {"\\\\": "\n", "\\,": " ", "\\;": " ", "\\!": ""}.get(body, body[1:])
        return " " if n.kind == "tie" else ""

    clean = span(0, len(text), [i for i, n in enumerate(nodes) if n.parent < 0 or nodes[n.parent].kind == "tag"])
    # control characters and blanks, outside the lines of code
    out, fenced = [], False
    for line in clean.split("\n"):
        fenced ^= line.strip().startswith("```")
        if line.strip() == _HEADING:
            if out and out[-1]:
                out[-1] = "# " + out[-1]
            continue
        if not line.isprintable():
            line = "".join(c if c.isprintable() else " " for c in line)
        out.append(line.rstrip() if fenced else " ".join(line.split()))
    joined = re.sub(r"(?<=\|)\n\n+(?=\|)", "\n", "\n".join(out))
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"\n\s*\n(?=- )", "\n", joined)).strip()


def judge(texts: list[str | None], model: BoostedTrees) -> list[tuple[bool, list[Node]]]:
    """(holds markup?, decoded nodes) of every text."""
    parsed = [parse(t) if t else [] for t in texts]
    rows = [features(t or "", n) for t, n in zip(texts, parsed, strict=True)]
    odds = model.score(np.concatenate(rows)) if rows and sum(map(len, rows)) else np.zeros(0)
    at, out = 0, []
    for nodes in parsed:
        decode(nodes, odds[at : at + len(nodes)])
        at += len(nodes)
        out.append((any(n.markup for n in nodes), nodes))
    return out


def clean_texts(texts: list[str | None], model: BoostedTrees) -> list[tuple[str | None, bool]]:
    """(clean text, did it hold markup?); escaped markup is undone and cleaned in turn, however often it was escaped:
    every round makes the text shorter, so there is an end."""
    result: list[tuple[str | None, bool]] = [(t, False) for t in texts]
    todo = list(range(len(texts)))
    while todo:
        again = []
        for i, (found, nodes) in zip(todo, judge([result[i][0] for i in todo], model), strict=True):
            text = result[i][0]
            if text is None:
                continue
            escaped = found and any(n.markup and n.kind == "entity" and n.name.lower() in ("lt", "gt", "amp", "#60", "#62", "#38") for n in nodes)
            if found:
                result[i] = (render(text, nodes), True)
                if escaped and len(result[i][0]) < len(text):
                    again.append(i)
            elif not result[i][1]:
                result[i] = (render(text, []), False)
        todo = again
    return result


def clean_markup(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """``key`` and, for every field, ``<field>_clean`` (string) and ``<field>_markup`` (boolean).

    Null stays null and holds no markup; so does an empty text, which stays empty. Text without markup only
    loses control characters and runs of blanks. Repeated keys stay repeated. Other columns do not matter.
    Whole texts are read.
    """
    shared = df.sparkSession.sparkContext.broadcast(classifier())
    schema = T.StructType([T.StructField(key, df.schema[key].dataType)])
    for f in fields:
        schema = schema.add(f"{f}_clean", T.StringType()).add(f"{f}_markup", T.BooleanType())

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        out = to_arrow_schema(schema)
        for whole in batches:
            for at in range(0, whole.num_rows, BATCH_FIELDS):
                batch = whole.slice(at, BATCH_FIELDS)
                cols = [batch.column(0)]
                for n in range(len(fields)):
                    done = clean_texts(batch.column(n + 1).to_pylist(), shared.value)
                    cols += [pa.array([t for t, _ in done], pa.string()), pa.array([m for _, m in done], pa.bool_())]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(cols, out, strict=True)], schema=out)

    return spread(df.select(key, *[F.col(f).cast("string").alias(f) for f in fields])).mapInArrow(run, schema)
