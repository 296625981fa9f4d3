"""The operators on texts: same products, markup, leaks, mixing, piles."""

import random
from collections import Counter

import numpy as np
import pytest

from vitrine.llm import leaks, listings, markup, mixing, spam


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


# --- listings ------------------------------------------------------------------------------------------------


def test_identifiers():
    assert listings.gtins("EAN 4006381333931, not 4006381333932, 00000000") == ["04006381333931"]
    assert listings.part_numbers("Kettle Xyz QMC 8265 new, or pxh_0372") == ["QMC8265", "PXH0372"]
    assert listings.part_numbers("LED 1000 watts NEW 2025 Edition") == []


@pytest.mark.parametrize(
    ("text", "dim", "amount"),
    [("12-Inch", "length", 304.8), ("30.5 cm", "length", 305), ('18"', "length", 457.2), ("0.35 Liter", "volume", 350), ("20 fl oz", "volume", 591.47), ("17 Oz", "ounce", 17), ("1.5 kW", "power", 1500), ("2 TB", "data", 2e6), ("30-Pound", "mass", 13607.76)],
)
def test_sizes(text, dim, amount):
    (found,) = listings.sizes(f"lamp {text} blue", False)
    assert found[0] == dim and found[1] == pytest.approx(amount)


def test_sizes_of_other_things_in_a_body_do_not_count():
    for t in ("Works at < 5 V", "about 6 l", "Uses <6 W in standby", "Cuts 10*20 cm"):
        assert listings.sizes(t, True) == []
    assert listings.pack("Choose the [4-pack]") is None and listings.pack("Set of 4") == 4 and listings.pack("(2 Count)") == 2
    assert [listings.version(t) for t in ("Gen 2", "2nd Generation", "Mk II", "v2", "lamp")] == [2, 2, 2, 2, None]


PRODUCTS = "product_id string, locale string, title string, brand string, color string, bullets string, description string, group_id string"


def listing(i, title, brand=None, color=None, bullets=None, description=None, locale="us"):
    return (f"p{i}", locale, title, brand, color, bullets, description, "clash")


def same(spark, rows):
    brands = frame(spark, [(1, "Acmetron")], "brand_id long, brand_name string")
    colors = frame(spark, [(1, "gray", ["grey"]), (2, "blue", ["azul"])], "color_id long, color_name string, other_names array<string>")
    # other ranges, from which the words of the trade are learned
    sounds = [a + b + "sk" for a in ("ba", "do", "fi", "gu", "me", "no", "pi") for b in ("lo", "mu", "ra", "ve", "zi")]
    rows = rows + [listing(f"f{i}", f"{w.title()} {sounds[-i - 1].title()} desk lamp mug ABC-{1000 + i}", "Acmetron") for i, w in enumerate(sounds)]
    groups = {}
    for r in listings.same_products(frame(spark, rows, PRODUCTS), brands, colors).collect():
        groups.setdefault(r.group_id, set()).add(r.product_id)
    return sorted(map(sorted, (g for g in groups.values() if len(g) > 1)))


def test_same_products_and_their_variants(spark):
    rows = [
        listing(1, "Acmetron Badusk Nerosk desk lamp 12-Inch gray QMC-8265", "Acmetron"),
        listing(2, "desk lamp | Badusk Nerosk | 30.5 cm | qmc8265", "ACMETRON", "grey"),
        listing(3, "Badusk Nerosk desk lamp", None, None, "Size: 305 mm • color gray"),
        listing(4, "Badusk Nerosk desk lamp 16-Inch gray", "Acmetron"),
        listing(5, "Badusk Nerosk desk lamp 12-Inch azul", "Acmetron"),
        listing(6, "Badusk Nerosk desk lamp 12-Inch gray Set of 2", "Acmetron"),
        listing(7, "Badusk Nerosk desk lamp 12-Inch gray Gen 2", "Acmetron"),
        listing(8, "replacement shade for Badusk Nerosk desk lamp 12-Inch gray", "Acmetron"),
        listing(9, "Morin Talesk desk lamp 12-Inch gray", "Acmetron"),
        listing(10, None),
        listing(11, ""),
        listing(12, "desk lamp " * 2000),
    ]
    assert same(spark, rows + rows[:2]) == [["p1", "p2", "p3"]]


def test_unknown_colour_joins_only_where_there_is_one(spark):
    one = [listing(1, "Badusk Nerosk mug 300 ml gray"), listing(2, "Badusk Nerosk mug 0.30 l")]
    assert same(spark, one) == [["p1", "p2"]]
    assert same(spark, [*one, listing(3, "Badusk Nerosk mug 300 ml azul")]) == []


def test_identifier_joins_different_names(spark):
    rows = [listing(1, "Badusk Nerosk mug 300 ml gray", bullets="EAN 4006381333931"), listing(2, "Kelin Voran mug 300 ml grey", description="4006381333931")]
    assert same(spark, rows) == [["p1", "p2"]]


def test_identifier_joins_an_unknown_colour_but_no_other_colour(spark):
    """Both codes are valid; the range of the first two knows another colour too."""
    rows = [
        listing(1, "Badusk Nerosk mug 300 ml gray", bullets="EAN 4006381333931"),
        listing(2, "Badusk Nerosk mug 300 ml", bullets="4006381333931 and 5901234123457"),
        listing(3, "Badusk Nerosk mug 300 ml azul"),
        listing(4, "Kelin Voran mug 300 ml azul", bullets="EAN 4006381333931"),
        listing(5, "Kelin Voran mug 300 ml", bullets="EAN 5901234123457"),
    ]
    # gray and blue under one code contradict; the other code says that listing 2 is what listings 4 and 5 are
    assert same(spark, rows) == [["p2", "p4", "p5"]]
    assert same(spark, rows[:3]) == [["p1", "p2"]]
    assert same(spark, [rows[0], rows[1], rows[2], rows[4]]) == [["p1", "p2", "p5"]]


def test_chains_of_identifiers_do_not_join_contradictions(spark):
    rows = [
        listing(1, "Badusk Nerosk mug 300 ml gray", bullets="EAN 4006381333931"),
        listing(2, "Kelin Voran mug 300 ml", bullets="4006381333931, 5901234123457"),
        listing(3, "Morin Talesk mug 300 ml azul", bullets="EAN 5901234123457"),
    ]
    assert same(spark, rows) == []


def test_names_of_any_number_of_words_in_any_order(spark):
    one = [listing(1, "Kindle mug 300 ml gray"), listing(2, "mug Kindle 300 ml grey")]
    three = [listing(3, "Badusk Nerosk Talvek mug 300 ml gray"), listing(4, "mug gray Talvek Nerosk Badusk 0.3 l"), listing(5, "Badusk NeroskTalvek mug 30 cl gray")]
    assert same(spark, one) == [["p1", "p2"]]
    assert same(spark, three) == [["p3", "p4", "p5"]]


def test_a_bare_listing_is_found_by_any_of_its_part_numbers(spark):
    rows = [listing(1, "Badusk Nerosk mug 300 ml gray QMC-8265"), listing(2, None, None, "grey", "300 ml, part zzk-1111 or QMC_8265"), listing(3, "Badusk Nerosk mug gray 300 ml ZZK1111")]
    assert same(spark, rows) == [["p1", "p2", "p3"]]


def test_pairs_and_membership(spark, monkeypatch):
    monkeypatch.setattr(listings, "PAIR_SLICE", 4)
    groups = frame(spark, [(f"p{i:02}", "big" if i < 23 else f"g{i // 2}") for i in range(30)], "product_id string, group_id string")
    of = {r.product_id: r.group_id for r in groups.collect()}
    got = [(r.product_id_a, r.product_id_b) for r in listings.pairs(groups).collect()]
    assert sorted(got) == sorted((a, b) for a in of for b in of if a < b and of[a] == of[b])
    told = {r.product_id: (r.representative, r.listings) for r in listings.membership(groups).collect()}
    assert told["p05"] == ("p00", 23) and told["p23"] == ("p23", 1) and told["p25"] == ("p24", 2)


def test_no_listings(spark):
    assert same(spark, []) == []


# --- markup --------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def model():
    return markup.classifier()


def test_classifier_on_texts_it_has_not_seen(model):
    rng = random.Random(99)
    right = total = 0
    for _ in range(400):
        parts = markup._made_text(rng)
        text = "".join(t for t, _ in parts)
        marks = np.concatenate([np.full(len(t), m) for t, m in parts])
        ((found, nodes),) = markup.judge([text], model)
        for n in nodes:
            if n.kind != "bullet" and n.parent < 0:
                total += 1
                right += n.markup == bool(marks[n.start : n.end].mean() > 0.5)
    assert right / total > 0.97


@pytest.mark.parametrize(
    "text",
    ["Rating: 4.8/5 | Noise: low", "works at < 5 V and > 3 V", "Q&A support & more", "$25 to $40 in other shops", "Docs\\Guides on the disc", "lab tested*", "model JCS_5721", "C# and C++", "[4-pack]", "sizes {S/M/L}", "- one\n- two", "1. one\n2. two", "10*20 cm", ""],
)
def test_ordinary_signs_stay(model, text):
    assert markup.clean_texts([text], model) == [(text, False)]


@pytest.mark.parametrize(
    ("text", "clean"),
    [
        ("<h2>Lamp</h2><ul><li>soft</li><li>light</li></ul>", "## Lamp\n- soft\n- light"),
        ("&lt;p&gt;Soft &amp;amp; light&lt;/p&gt;", "Soft & light"),
        ("a <pre><code>set  mode\nsave</code></pre>", "a\n```\nset  mode\nsave\n```"),
        ("'''Lamp''' is in the [[lamps|lamp range]].", "Lamp is in the lamp range."),
        ("\\section{Lamp} \\begin{itemize}\\item soft\\item light\\end{itemize}", "# Lamp\n- soft\n- light"),
        ("Power $P = U \\cdot I$ is **high**", "Power $P = U \\cdot I$ is high"),
        ("<script>var t='</p>';</script><!-- x -->plain text", "plain text"),
        ("Lamp\n=====\n\n1. soft", "# Lamp\n\n1. soft"),
        ("See the [sheet](https://a.example/b) now", "See the sheet now"),
    ],
)
def test_structure_is_kept(model, text, clean):
    assert markup.clean_texts([text], model) == [(clean, True)]


@pytest.mark.parametrize(
    ("text", "clean"),
    [
        ("&amp;amp;amp;amp;lt;b&amp;amp;amp;amp;gt;x", "x"),
        (r"\textbf{a \emph{b} c} is here", "a b c is here"),
        ("See the [sheet](https://a.example/lamp_(b)) now", "See the sheet now"),
        ("<div>" * 90 + "soft" + "</div>" * 90, "soft"),
        ("The sum $" + " + ".join(f"x_{k}^2" for k in range(200)) + "$ holds", "The sum $" + " + ".join(f"x_{k}^2" for k in range(200)) + "$ holds"),
    ],
)
def test_nothing_is_too_deep_or_too_long(model, text, clean):
    assert markup.clean_texts([text], model) == [(clean, True)]


#: Written by hand from the manuals of the formats, not made by the generator: kind -> texts that hold it.
WRITTEN = {
    "html": ["The <em>Aurora</em> kettle boils fast", 'Buy <a title="shop" href="/k?x=1">here</a> today', "<p>First part.</p><p>Second part.</p>", "Line one<br>line two", '<img src="k.jpg" alt="kettle"> front view', "<dl><dt>Cord</dt><dd>two metres</dd></dl>", '<table border="1"><tr><td>Cord</td><td>2 m</td></tr></table>'],
    "entity": ["Fish &amp; chips", "5 &times; 7 cm", "caf&eacute; cup", "it&#8217;s new", "10&nbsp;W"],
    "escaped": ["&lt;b&gt;New&lt;/b&gt; kettle", "&amp;lt;i&amp;gt;light&amp;lt;/i&amp;gt;"],
    "broken": ["A light <b>kettle without an end", "Some text</div> and more", "last item</li"],
    "comment": ["Kettle <!-- internal note --> in blue", "<script>track(1 < 2);</script>Kettle"],
    "markdown": ["# Aurora kettle\n\nBoils fast.", "It is **very** light", "Use `reset` twice", "Read [the guide](guide.html)", "> A fine kettle\n\nsays a buyer", "| Part | Size |\n|---|---|\n| Cord | 2 m |", "```\nmake tea\n```\n", "~~old~~ new"],
    "wiki": ["== Care ==\nWipe it.", "The '''Aurora''' is made of [[steel]].", "{{Infobox|name=Aurora|power=2 kW}}", '{| class="t"\n|-\n| Cord || 2 m\n|}\n'],
    "latex": [r"\section{Care} Wipe it.", r"It is \textbf{very} light", r"A gain of 20\% \& more", r"Energy $E = P \cdot t$ in total", r"\begin{itemize}\item one \item two\end{itemize}"],
}
PLAIN = ["Fish & chips", "7 < 9 and 9 > 7", "5*7*9 mm", "snake_case_name on the box", "$5 or less", "see {A} or [B]", "A | B | C", "~20 minutes", "C:\\temp\\file", "a^2 as typed", "* boils fast\n* light", "- one\n- two", "#1 choice", "100% wool, 50/50", "x = y", "rock 'n' roll", "10' x 12'", "e-mail: a_b@c.example", "Q&A", "2 ** 3"]


def test_recall_per_kind_on_texts_written_by_hand(model):
    missed = {kind: [t for t, (_, found) in zip(texts, markup.clean_texts(texts, model), strict=True) if not found] for kind, texts in WRITTEN.items()}
    assert {k: v for k, v in missed.items() if v} == {}
    wrong = [t for t, (_, found) in zip(PLAIN, markup.clean_texts(PLAIN, model), strict=True) if found]
    assert len(wrong) <= 1, wrong


def test_decoding_finds_the_largest_sum():
    """Against all labellings of small trees that do not contradict themselves."""
    import itertools

    rng = np.random.default_rng(3)
    for text in ("<pre><code>a<b>x</b></code></pre> *y*", "<p>**a `b`**</p> & _c_", "<code>*a* <i>b</i></code> ~ c", "<ul><li>a<li>b</ul>|", "<code><code>a &amp; b</code></code>"):
        nodes = markup.parse(text)
        whole = {i: min(i, n.pair) if n.pair >= 0 else i for i, n in enumerate(nodes)}
        for _ in range(30):
            odds = rng.normal(size=len(nodes))
            best = -1e9
            for labels in itertools.product((0, 1), repeat=len(nodes)):
                if all(labels[i] == labels[w] for i, w in whole.items()) and not any(labels[i] and below_code(nodes, labels, whole, i) for i in range(len(nodes))):
                    best = max(best, float(np.dot(labels, odds)))
            markup.decode(nodes, odds)
            got = [n.markup for n in nodes]
            assert not any(got[i] and below_code(nodes, got, whole, i) for i in range(len(nodes)))
            assert float(np.dot(got, odds)) == pytest.approx(best)


def below_code(nodes, labels, whole, i):
    """Is a node below code that is markup, but for code right below pre? Above a whole is what is above its first part."""
    i = whole[i]
    p, right_below = nodes[i].parent, True
    while p >= 0:
        p = whole[p]
        code = nodes[p].kind == "tag" and nodes[p].name in ("pre", "code", "nowiki", "tt", "kbd", "samp")
        if code and labels[p] and not (right_below and nodes[p].name == "pre" and nodes[i].name == "code"):
            return True
        p, right_below = nodes[p].parent, False
    return False


def test_fields_of_a_table(spark):
    df = frame(spark, [("a", "<b>x</b> one", None, 1), ("b", None, "", 2), ("b", "plain " * 50_000, "it&#39;s", 3)], "id string, d string, u string, d_clean int")
    got = markup.clean_markup(df, "id", ["d", "u"]).collect()
    assert Counter((r.id, r.d_markup, r.u_markup) for r in got) == {("a", True, False): 1, ("b", False, False): 1, ("b", False, True): 1}
    assert [r.d_clean for r in got if r.id == "a"] == ["x one"] and [r.u_clean for r in got if r.u_markup] == ["it's"]
    assert len(next(r.d_clean for r in got if r.u_markup)) == 6 * 50_000 - 1
    assert markup.clean_markup(df.limit(0), "id", ["d"]).count() == 0


def test_odd_texts_do_not_break(model):
    for t in ("<" * 3000, "*a" * 2000, "<ul>" * 400, "{{" * 500, "\\", "&", "```", "|" * 100, "\x00\x07", "[[" * 300, "$" * 99):
        markup.clean_texts([t], model)


# --- leaks ---------------------------------------------------------------------------------------------------


def words(rng, n):
    return [rng.choice("amber birch cedar delta ember fjord grove heron inlet joker knoll linen maple north ocean pearl quartz river stone tulip".split()) + str(rng.randint(1, 40)) for _ in range(n)]


def test_suffix_array_is_sorted_and_searched():
    rng = np.random.default_rng(1)
    ids = rng.integers(0, 4, 500)
    order = leaks.suffix_array(ids)
    known = [i for i in range(497) if (ids[i : i + leaks.START] > 0).all()]
    assert sorted(order.tolist()) == known
    key = lambda i: ids[i : i + leaks.DEPTH].tolist()
    assert [key(i) for i in order.tolist()] == sorted(key(i) for i in order.tolist())
    want = ids[known[7] : known[7] + leaks.START][None, :]
    lo, hi = (int(leaks._bound(ids, order, want, leaks.START, up)[0]) for up in (False, True))
    assert sorted(order[lo:hi].tolist()) == [i for i in known if (ids[i : i + leaks.START] == want[0]).all()]


def numbered(tests, texts):
    return [np.array([tests.number.get(x, 0) for x in t], dtype=np.int64) for t in texts]


def test_all_maximal_matches_with_all_places():
    rng = random.Random(4)
    few = lambda n: [rng.choice("abcde") for _ in range(n)]
    items, texts = [few(30), few(12), few(3), few(30)], [few(60), few(5), few(2), few(40)]
    texts += [items[0] + few(5), few(5) + items[0][:20], items[1] * 2]
    tests = leaks.TestItems([(i, " ".join(w)) for i, w in enumerate(items)])
    want = set()
    for n, w in enumerate(items):
        for d, t in enumerate(texts):
            for i in range(len(w)):
                for j in range(len(t)):
                    if w[i] == t[j] and (i == 0 or j == 0 or w[i - 1] != t[j - 1]):
                        k = next((k for k in range(min(len(w) - i, len(t) - j)) if w[i + k] != t[j + k]), min(len(w) - i, len(t) - j))
                        if k >= leaks.START:
                            want.add((d, n, i, j, k))
    got = [tuple(r) for r in leaks.matches(tests, numbered(tests, texts)).tolist()]
    assert len(got) == len(set(got)) and set(got) == want


def test_leaks_of_every_kind(spark, monkeypatch):
    rng = random.Random(3)
    head = "Pick the best answer for this. "
    items = {i: words(rng, 80) for i in range(6)}
    tests = [(i, head + " ".join(w) + ".") for i, w in items.items()] + [(90, None), (91, ""), (92, head)]
    pad = lambda: " ".join(words(rng, 60))
    swap = lambda w, k: [x if n % k else "changed" for n, x in enumerate(w, 1)]
    a = items[0]
    mixed = a[:]
    rng.shuffle(mixed)
    docs = {
        1: f"{pad()} {' '.join(a)} {pad()}",
        2: f"{pad()} {' '.join(a[:48])} {pad()}",
        3: f"{pad()} {' - '.join(x.upper() for x in swap(a, 9))}",
        4: f"{' '.join(a[40:])} {pad()} {' '.join(a[:38])}",
        5: f"{pad()} {' '.join(a[:20])} {pad()}",
        6: " ".join(mixed),
        7: head + pad(),
        8: None,
        9: "",
        10: f"{' '.join(items[1])} {' '.join(items[2])} " + pad() * 40,
        11: f"{pad()} {' '.join(a)} {pad()}",
    }
    monkeypatch.setattr(leaks, "SHARD_WORDS", 500)
    df = frame(spark, [(i, t, "clash") for i, t in docs.items()], "doc_id long, text string, words string").coalesce(2)
    tests = frame(spark, tests, "item_id long, text string")
    about_half = leaks.Want(leaks.PASSAGE, 0.48)
    found = leaks.find_leaks(df, tests, want=about_half)
    assert {(r.doc_id, r.item_id) for r in found.collect()} == {(1, 0), (2, 0), (3, 0), (4, 0), (10, 1), (10, 2), (11, 0)}
    assert {r.doc_id for r in leaks.without_leaks(df, found).collect()} == {5, 6, 7, 8, 9}
    long = {}
    for r in leaks.longest_matches(df, tests).collect():
        long.setdefault((r.item_id, r.item_at, r.words), set()).add(r.doc_id)
    assert long[(0, 0, 80)] == {1, 11} and long[(1, 5, 75)] == {10}
    monkeypatch.setattr(leaks, "BLOCK_WORDS", 100)
    assert found.count() == leaks.find_leaks(df, tests, want=about_half).count()
    monkeypatch.setattr(leaks, "BLOCKS", 2)
    assert found.count() == leaks.find_leaks(df, tests, want=about_half).count()
    # any passage of 20 words and more
    assert {(r.doc_id, r.item_id) for r in leaks.find_leaks(df, tests, want=leaks.Want(20)).collect()} - {(r.doc_id, r.item_id) for r in found.collect()} == {(5, 0)}
    assert leaks.find_leaks(df.limit(0), tests).count() == 0 and leaks.find_leaks(df, tests.limit(0)).count() == 0


def test_longest_matches_among_many_with_the_same_start():
    rng = random.Random(4)
    items = [words(rng, 150), words(rng, 64), words(rng, 90) * 2]
    a = items[0]
    texts = [a[:70], a, a[3:100], a[:64] + words(rng, 9), a[:149], items[1], items[2][:80], items[2], items[2][5:170], a[80:] + a[:90], words(rng, 300)]
    texts += [words(rng, 5) + t for t in texts]
    tests = leaks.TestItems([(i, " ".join(w)) for i, w in enumerate(items)])
    got = {}
    for n, i, d, j, m in leaks.longest_of(tests, numbered(tests, texts)):
        got.setdefault((n, i), set()).add((d, j, m))

    def shared(x, y):
        return next((n for n, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))  # noqa: B905

    for i, w in enumerate(items):
        for k in range(len(w)):
            all_ = {(d, j, shared(w[k:], t[j:])) for d, t in enumerate(texts) for j in range(len(t))}
            most = max(m for *_, m in all_)
            assert got.get((i, k), set()) == ({x for x in all_ if x[2] == most} if most >= 2 * leaks.START else set())


def test_passages_of_long_items_and_light_edits(spark):
    rng = random.Random(6)
    item = [f"w{rng.randint(1, 5000)}" for _ in range(1000)]
    short = [f"v{k}" for k in range(90)]
    pad = lambda: " ".join(words(rng, 40))
    swap = lambda w, k: " ".join(x if n % k else "changed" for n, x in enumerate(w, 1))
    docs = {1: f"{pad()} {' '.join(item[100:400])} {pad()}", 2: f"{pad()} {' '.join(item[500:970])}", 3: " ".join(item[:200])}
    docs |= {10 + k: f"{pad()} {swap(short, k)} {pad()}" for k in (5, 6, 7)} | {20: f"{pad()} {swap(short[:60], 5)}", 21: " ".join(short[:45]) + " v45 " + pad() + " v44 " + " ".join(short[45:])}
    df = frame(spark, list(docs.items()), "doc_id long, text string")
    tests = frame(spark, [(0, " ".join(item)), (1, " ".join(short))], "item_id long, text string")
    at = lambda share: {(r.doc_id, r.item_id) for r in leaks.find_leaks(df, tests, want=leaks.Want(leaks.PASSAGE, share)).collect()}
    assert at(0.3) == {(1, 0), (2, 0), (15, 1), (16, 1), (17, 1), (20, 1), (21, 1)}
    assert at(0.45) == {(2, 0), (15, 1), (16, 1), (17, 1), (20, 1), (21, 1)}
    assert at(0.8) == {(15, 1), (16, 1), (17, 1), (21, 1)}


# --- mixing --------------------------------------------------------------------------------------------------

TARGETS = "source string, target_share double, max_repeats int"


def mixed(spark, docs, targets, **kw):
    chosen, report = mixing.mix_sources(frame(spark, docs, "doc_id long, source string, text string, tokens int"), frame(spark, targets, TARGETS), "doc_id", "source", "text", "/opt/tokenizers/byte_bpe_50k.json", **kw)
    return chosen.collect(), {r.source: r for r in report.collect()}


def test_shares_are_reached_within_repeats(spark):
    docs = [(i, "big", "one two three four", 0) for i in range(300)] + [(1000 + i, "small", "one two three four", 0) for i in range(20)]
    docs += [(2000, None, "x", 0), (2001, "other", "x", 0), (2002, "small", None, 0), (2003, "small", "", 0)]
    targets = [("big", 0.6, 1), ("small", 0.3, 3), ("absent", 0.1, 2)]
    for limit in (1000, 7):
        chosen, report = mixed(spark, docs, targets, limit=limit)
        tokens = Counter()
        for r in chosen:
            tokens[r.source] += r.tokens * r.copies
        assert tokens["small"] / sum(tokens.values()) == pytest.approx(1 / 3, abs=0.01)
        assert {r.copies for r in chosen if r.source == "small"} == {3} and max(r.copies for r in chosen if r.source == "big") == 1
        assert report["absent"].reached_share == 0 and report["big"].reached_share == pytest.approx(2 / 3, abs=0.01)


def test_given_total_is_cut_and_capped(spark):
    docs = [(i, "a", "one two three", 0) for i in range(100)] + [(500, "b", "one two three", 0)]
    chosen, report = mixed(spark, docs, [("a", 0.5, 1), ("b", 0.5, 2)], total_tokens=120)
    per = chosen[0].tokens
    assert sum(r.copies for r in chosen if r.source == "a") == pytest.approx(60 / per, abs=1)
    assert report["b"].most_copies == 2 and report["b"].selected_tokens == 2 * per
    again, _ = mixed(spark, docs[::-1], [("a", 0.5, 1), ("b", 0.5, 2)], total_tokens=120)
    assert {(r.doc_id, r.copies) for r in chosen} == {(r.doc_id, r.copies) for r in again}


def test_mixing_nothing(spark):
    chosen, report = mixed(spark, [], [("a", 1.0, 1)])
    assert chosen == [] and report["a"].selected_tokens == 0
    chosen, report = mixed(spark, [(1, "a", "x", 0)], [("a", None, 1), ("b", -1.0, None)])
    assert chosen == []


# --- piles ---------------------------------------------------------------------------------------------------


def prose(rng, n):
    nouns, verbs, ends = "lamp door shop friend garden letter engine river".split(), "opens finds paints moves lifts keeps brings".split(), "in the morning,with some care,after two days,for a neighbour,near the old bridge".split(",")
    return " ".join(f"The {rng.choice(nouns)} {rng.choice(verbs)} the {rng.choice('small green heavy quiet early'.split())} {rng.choice(nouns)} {rng.choice(ends)} {rng.randint(1, 99)}." for _ in range(n))


def test_piles_and_honest_pages(spark):
    rng = random.Random(7)
    keys = "cheap sale buy lamp lamp lamp online deal".split()
    pile = lambda sep, n=150: sep.join(rng.choice(keys) for _ in range(n))
    docs = {f"prose{i}": prose(rng, rng.randint(1, 25)) for i in range(200)}
    docs |= {"piled": pile(" "), "menu": pile(" > "), "tags": "#" + pile(" #"), "lines": pile("\n"), "semicolons": pile("; "), "half": prose(rng, 2) + "\n" + pile(", ", 200)}
    docs["links"] = "\n".join(f"lamp {k} - https://x{rng.randint(1, 9999)}.example/{rng.randint(1, 9999)}" for k in range(40))
    docs["stuffed"] = " ".join(f"Our lamp is the best lamp for every lamp buyer. Buy lamp {rng.choice(keys)} lamp, lamp and more lamp." for _ in range(12))
    honest = {
        "little": prose(rng, 20) + "\n" + pile(" ", 20),
        "table": "Size chart\nlabel; chest cm; waist cm\n" + "\n".join(f"{s}; {rng.randint(60, 99)}; {rng.randint(60, 99)}" for s in "XS S M L XL XXL".split()),
        "sheet": "\n".join(f"{k}: {v}" for k, v in (("Weight", "2 kg"), ("Body", "steel"), ("Cord", "blue"), ("Noise", "low"), ("Width", "32 cm"))),
        "empty": "",
        "null": None,
        "long": prose(rng, 6000),
    }
    docs |= honest
    df = frame(spark, [(k, t, rng.choice(["en", None]), 1) for k, t in docs.items()] + [("piled", docs["piled"], "en", 1)], "doc_id string, text string, lang string, spam int")
    got = spam.find_piles(df, "doc_id", "text", "lang").collect()
    assert len(got) == len(docs) + 1
    assert Counter(r.doc_id for r in got if r.spam) == {"piled": 2, "menu": 1, "tags": 1, "lines": 1, "semicolons": 1, "half": 1, "links": 1, "stuffed": 1}
    assert spam.find_piles(df.limit(0), "doc_id", "text", "lang").count() == 0


def test_few_stuffed_sentences_again_and_again(spark):
    rng = random.Random(8)
    stuffed = ["Buy picture frame here because picture frame shoppers love picture frame deals.", "Our picture frame is the best picture frame for every picture frame buyer.", "Order picture frame sets from the picture frame store with picture frame offers."]
    honest = ["The door of the old shop opens at nine in the morning and closes after dark.", "Wash the cover by hand with lukewarm water and let it dry in the shade.", "Our neighbour bought the same model and says that it holds up well in winter."]
    docs = {f"prose{i}": prose(rng, rng.randint(1, 25)) for i in range(200)}
    for n in (1, 2, 3):
        docs |= {f"stuffed{n}": " ".join(stuffed[:n] * (60 // n)), f"honest{n}": " ".join(honest[:n] * (60 // n))}
    df = frame(spark, [(k, t, "en") for k, t in docs.items()], "doc_id string, text string, lang string")
    assert {r.doc_id for r in spam.find_piles(df, "doc_id", "text", "lang").filter("spam").collect()} == {"stuffed1", "stuffed2", "stuffed3"}
