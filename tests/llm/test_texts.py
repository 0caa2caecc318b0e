"""Leakage, residue and markup on small texts."""

import random

import pytest

from loamdex.llm import leakage, markup, residue

ASK = "Read the passage and answer the question that follows it."
ITEMS = {
    1: f"{ASK} The old mill by the river keeps seven grey herons and Anna counts them twice before she drains the pond. Who owns the mill?",
    2: f"{ASK} Every morning the ferry brings forty barrels of salt to the market where nobody has seen the granite tower since. How many barrels remain?",
    3: f"{ASK} Short one. Why?",
    4: None,
}
QUOTE = "The old mill by the river keeps seven grey herons and Anna counts them twice before she drains the pond."


@pytest.fixture(scope="module")
def items(spark):
    rows = [(k, "reading", t) for k, t in ITEMS.items()] + [(100 + k, "x", f"A filler item number {k} about lamp {k} and desk {k} that stands near window {k} of house {k}. What is {k}?") for k in range(30)]
    return spark.createDataFrame([*rows, rows[0]], "item_id long, kind string, text string")


@pytest.mark.parametrize(
    "text, want",
    [
        (f"Before. {QUOTE} After.", {1}),
        (QUOTE.upper().replace(" ", "\n\t"), {1}),
        ("<!-- " + QUOTE + " -->", {1}),
        ("{{Quote box|text=" + QUOTE + "|align=right}}", {1}),
        (QUOTE.replace("river", "[[River (place)|river]]").replace("grey", "''grey''").replace("and Anna", "and<ref>Survey, p. 4</ref> Anna"), {1}),
        (QUOTE.replace("river", "lake").replace("Anna", "Annna"), {1}),
        (QUOTE.replace("e", "е").replace("o", "о"), {1}),
        (QUOTE.replace("herons", "he​rons").replace("a", "á"), {1}),
        (f"{ITEMS[2][len(ASK):]} and {QUOTE}", {1, 2}),
        (" ".join(QUOTE.split()[:12]) + " and so on", set()),
        (ASK + " Nothing else of it.", set()),
        ("", set()),
        ("   ", set()),
        ("word " * 50_000 + QUOTE, {1}),
    ],
)
def test_leaks(spark, items, text, want):
    docs = spark.createDataFrame([(7, text, 1), (7, text, 1), (8, None, 2)], "doc_id long, text string, item_id int")
    assert {(r.doc_id, r.item_id) for r in leakage.leaked(docs, items).collect()} == {(7, i) for i in want}


def test_leaks_in_blocks_and_empty_tables(spark, items):
    docs = spark.createDataFrame([(1, QUOTE), (2, "nothing"), (3, f"{ASK} And {ASK.lower()}")], "doc_id long, text string")
    for words in (250, 10**6):  # sentences are shared, and rare, over all blocks
        assert [tuple(r) for r in leakage.leaked(docs, items, block_words=words, min_words=9).collect()] == [(1, 1)]
    assert leakage.leaked(docs, items.limit(0)).collect() == [] and leakage.leaked(docs.limit(0), items).collect() == []


def test_statistics_over_tables_equal_those_of_all_texts(spark):
    texts = {k: f"{ASK} The {k % 3} mills of town {k} stand by {k * 7} lakes near the old road to town {k + 1} in the hills. Then we left." for k in range(20)}
    df = spark.createDataFrame([(k, t) for k, t in texts.items()], "item_id long, text string")
    assert {r.item_id: r.words for r in leakage.item_words(df).collect()} == {k: w for k, w in leakage.own_words(texts).items() if len(w) >= leakage.MIN_WORDS}


def some_items(r, n):
    word = lambda: f"w{r.randint(0, 60)}"
    return {k: " ".join(word() for _ in range(30)) for k in range(n)}


def test_block_max_search_finds_what_full_scoring_finds():
    """Candidates against scores of every passage and item, computed one by one."""
    r = random.Random(4)
    ix = leakage.ItemIndex.of(some_items(r, 80))
    texts = [[f"w{r.randint(0, 60)}" for _ in range(200)] for _ in range(5)] + [ix.own[3][2:25]]
    got = {x[:2] for x in ix.candidates(texts)}
    weight = {}
    for row, key in enumerate(ix.keys.tolist()):
        for e in range(ix.blocks[row], ix.blocks[row + 1]):
            for p in range(ix.block_first[e], ix.block_end[e]):
                weight[key, int(ix.item[p])] = float(ix.share[p])
    for d, t in enumerate(texts):
        a = [ix.vocab.get(w, -1) for w in t]
        keys = [x * ix.v + y for x, y in zip(a, a[1:])]
        for n in range(len(ix.items)):
            near = [[weight[k, n] for k in keys[s : s + leakage.WINDOW] if (k, n) in weight] for s in range(len(keys))]
            best = max(sum(x) if len(x) >= ix.least_pairs else 0 for x in near)
            if abs(best - 1) > 1e-4:
                assert ((d, n) in got) == (best >= 1), (d, n, best)


def test_no_altered_quotation_is_lost():
    """Whatever the verification accepts of quotations with altered, lost and added words has been retrieved."""
    r = random.Random(9)
    ix = leakage.ItemIndex.of(some_items(r, 60))
    held = 0
    for _ in range(1500):
        n = r.randrange(60)
        own = ix.own[ix.items[n]]
        at = r.randint(0, 15)
        quote, k = [], 0
        for w in own[at : at + r.randint(15, 17)]:
            k += 1
            if k >= 3 and r.random() < 0.6:
                k = 0
                quote += r.choice([["zzq"], [], [w, "zzq"]])
            else:
                quote.append(w)
        text = ["x"] * r.randint(0, 40) + quote + ["y"] * 5
        if ix.holds(text, n):
            held += 1
            assert any(x[1] == n and ix.holds(text[x[2] : x[3]], n) for x in ix.candidates([text]))
    assert held > 200


def test_least_kept_is_the_least():
    """Against all ways to alter a stretch of words."""
    r = random.Random(3)
    for _ in range(20):
        w = [r.random() for _ in range(9)]
        best = float("inf")
        for start in range(10 - 7 + 1):
            for marks in range(3**6):  # of each word but the first: kept, altered, or kept after an added one
                kinds = [0, *((marks // 3**k) % 3 for k in range(6))]
                total, run, ok = 0.0, 1, True
                for i in range(1, 7):
                    if kinds[i] == 0:
                        total, run = (total + w[start + i - 1], run + 1) if run else (total, 1)
                    elif kinds[i] == 1:
                        ok, run = ok and run >= 2, 0
                    else:
                        ok, run = ok and run >= 2, 1
                best = min(best, total if ok else best)
        assert leakage.least_kept(leakage.np.array(w), 7) == pytest.approx(best)


RESIDUE = ["Dear {first_name}, welcome.", "Hello <%= user.name %>", "It lies in %%REGION%%.", "Opened on [INSERT DATE] by [SOURCE].", "About ${count} were seen.", "The mill of __NAME__ is old.", "{{ page.title }} was changed.", "&lt;first_name&gt; was here", "It is a [object Object] in undefined.", "Intro.\n\nPage not found.\n\nMore.", "You need to enable JavaScript to view this article.", "Your text goes here.", "Lorem ipsum dolor sit amet fugit velut esto.", "(content)\n(references)", "503 – the upstream service did not answer in time.", "Bitte aktivieren Sie JavaScript, um diesen Artikel zu lesen."]
CLEAN = ["An ordinary page about a mill.", "{{Infobox river\n| name = \n| note = {{{note|}}}\n}}\nA river.", "<pre>Dear {first_name},</pre> is quoted from the manual.", "Use <code>${x}</code> and <nowiki>{{{1|d}}}</nowiki> in templates.", "#REDIRECT [[Mill]]", "{{stub}}", "  \n ", "", "asdf asdf hahaha", "A server error in 2013 closed the archive; the article was restored from paper.", "The status number 404 was painted on the wall.", "Visitors had to insert a coin and try again when the page was not found.", "__NOTOC__ text <ref name=\"a\">b</ref> <br> x"]


def test_residue(spark):
    rows = [(k, t) for k, t in enumerate(RESIDUE + CLEAN)] + [(0, RESIDUE[0]), (900, None), (901, "plain words " * 20_000), (902, "plain words " * 20_000 + RESIDUE[0])]
    rows += [(1000 + k, f"The page number {k} tells of a mill, a user, the text and the name of a road in the town.") for k in range(300)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, n string")
    assert {r.doc_id for r in residue.residue(df).collect()} == {*range(len(RESIDUE)), 902}
    assert residue.residue(df.limit(0)).collect() == []


def test_prefix_filter_loses_nothing():
    """Passages with enough of an exemplar always share one of its indexed words."""
    ix = residue.Exemplars().weigh({}, 1000)
    r = random.Random(2)
    for k, phrase in enumerate(residue.PHRASES):
        words = [t for w in phrase.split() if w != "_" for t in residue.terms(w)]
        for _ in range(5):
            t = [w for w in words if r.random() < 0.9]
            if ix.coverage(k, t, residue._grams(t)) >= ix.part[k]:
                assert set(t) & ix.anchors and ix.matches(t)


@pytest.mark.parametrize("exemplar", residue.SLOTS)
def test_every_slot_exemplar_is_found_by_its_shape(exemplar):
    ix = residue.Exemplars().weigh({}, 1000)
    slot = exemplar.replace("…", " q ") if exemplar.count("…") and exemplar[-1] != "…" else exemplar.replace("…", " }}" if exemplar[0] == "{" else "")
    for w, case in (("x", "name"), ("a", "name"), ("A", "NAME"), ("W", "Name")):
        slot = residue.re.sub(rf"(?<![^\W_]){w}(?![^\W_])", case, slot)
    assert residue.is_residue(f"Some words {slot} and more.", ix), slot


def test_long_lines_of_signs_take_no_long_time():
    ix = residue.Exemplars().weigh({}, 1000)
    for sign in ("{%", "<?", "(", "[", "$", "__", "{{", "&lt;", "@", "<!--#"):
        assert not residue.is_residue(sign * 50_000 + " a", ix)


ELEMENTS = [
    ("# A title\n\nText", {"heading"}),
    ("== A title ==", {"heading"}),
    ("Title\n=====\n\nText", {"heading"}),
    ("<h2 class='x'>\nTitle\n</h2>", {"heading"}),
    ("\\subsection*{Title}", {"heading"}),
    ("# one\n## two\n# three", {"list"}),
    ("* one\n** two", {"list"}),
    ("1. one\n2. two", {"list"}),
    ("- [ ] open\n- [x] done", {"list"}),
    ("<ol>\n<li>one<li>two</ol>", {"list"}),
    ("\\begin{itemize}\n\\item a\n\\item b\n\\end{itemize}", {"list"}),
    ("```sql\n# not a title\n- a\n```", {"code"}),
    ("~~~\n$x$ **b**\n~~~", {"code"}),
    ("Text\n\n    indented = 1\n\n    more", {"code"}),
    ("<pre><code>a &lt; b</code></pre>", {"code"}),
    ("<syntaxhighlight lang='c'>\nint *x;\n</syntaxhighlight>", {"code"}),
    ("\\begin{verbatim}\n\\textbf{x}\n\\end{verbatim}", {"code"}),
    ("$$\nx_1 + y_2\n$$", {"formula"}),
    ("Here $a_{i} = 1$ holds.", {"formula"}),
    ("We get \\(x^2\\) here.", {"formula"}),
    ("<math><mi>x</mi></math>", {"formula"}),
    ("\\begin{equation}\nx\n\\end{equation}", {"formula"}),
    *[(f"Some {x} here.", {"inline"}) for x in ("**bold**", "_word_", "`code`", "~~gone~~", "[a](b.md)", "![a](b.png)", "[[Page|it]]", "{{note|x}}", "''it''", "'''b'''", "<b>x</b>", "<!-- c -->", "a&nbsp;b", "<ref name='a'/>", "\\textbf{x}", "x\\footnote{y}", "~\\cite{k}", "<br/>")],
    ("<p>A paragraph.</p>", {"inline"}),
    ("# T\n\n- a **b**\n\n```\nx\n```\n\n$y$", {"heading", "list", "inline", "code", "formula"}),
    *[(x, set()) for x in ("See ticket #482.", "A block of 4 * 3 * 2 cells.", "It costs $5 or perhaps $6 per row.", "The file row_count_v2 was kept.", "3 < 5 while 7 > 2.", "An item - once open - was closed.", "Ask for 10-12 copies; 3. is wrong.", "[sic] and {sic}", "About 5% of A&B.", "Use f(x) = x^2.", "The C# port.", "", "  ", "Plain\nlines\nof words.")],
]


@pytest.mark.parametrize("text, want", ELEMENTS)
def test_elements(text, want):
    c = markup.Classifier(markup.tree())
    assert markup.kinds(text, c) == want and markup.kinds(text.replace("\n", "\r\n"), c) == want


def test_tree_on_held_out_blocks():
    """Each fifth of the labelled texts, with all their fillings and neighbours, is left out of the training and classified afterwards."""
    x, y, source = markup.labelled()
    right = 0
    for part in range(5):
        held = source % 5 == part
        tree = markup.fit(x[~held], y[~held])
        right += sum(markup.predict(tree, tuple(r)) == t for r, t in zip(x[held].tolist(), y[held].tolist()))
    assert right / len(y) > 0.85


def test_word_counts_and_link_densities_decide():
    """Own words and density and the neighbours' densities are in the tree, and change what a block is."""
    assert {14, 15} <= markup.used(markup.tree()) and {17, 19} & markup.used(markup.tree())
    c = markup.Classifier(markup.tree())
    label = lambda t, k: markup.KINDS[c.label(markup.blocks(t))[k]]
    assert label("Old mill\n-----", 0) == "heading" and label("This line is " + "long and tells of much more than a title would ever " * 3 + "say.\n-----", 0) == "plain"
    assert label("Text.\n\n[mill](a.md)\n\nMany words stand here and more.", 1) == "plain" and label("[hill](b.md)\n\n[mill](a.md)\n\n[till](c.md)", 1) == "menu"
    assert markup.clean("[home](/) | [mill](/a) | [hill](/b) | [help](/c)\n\nThe old mill of [[Hill|the hill]] stands.", c) == "The old mill of the hill stands."
    assert markup.kinds("- [home](/)\n- [mill](/a)", c) == {"list", "inline"}


def test_clean_text():
    c = markup.Classifier(markup.tree())
    text = "Mill\n----\n\nA **bold** [link](a.md) and {{note|x}}&nbsp;here<!-- c -->.\n\n* one\n* ''two''\n\n<pre><code>a &lt; b</code></pre>\n\n$$\nx\n$$\n\n<ol><li>p</li><li>q</li></ol>\n\n\\section{Old mill}"
    assert markup.clean(text, c) == "# Mill\n\nA bold link and x here.\n\n- one\n- two\n\n```\na < b\n```\n\n$x$\n\n- p\n- q\n\n# Old mill"


def test_elements_of_tables(spark):
    rows = [("a", "# T\n\ntext"), ("a", "# T\n\ntext"), ("b", None), ("c", ""), ("d", "word " * 100_000 + "**x**")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "packet_id string, body string, kind int")
    assert sorted(map(tuple, markup.elements(df, text="body", keys=["packet_id"]).collect())) == [("a", "heading"), ("d", "inline")]
    assert markup.elements(df.limit(0), text="body", keys=["packet_id"]).collect() == []
    got = {r.packet_id: r.clean for r in markup.clean_text(df, text="body").collect()}
    assert got["a"] == "# T\n\ntext" and got["b"] is None and got["c"] == ""
