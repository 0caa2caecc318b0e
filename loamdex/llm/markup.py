"""Markup in text documents: HTML, Markdown, wiki and LaTeX to clean text with its structure kept.

Method: a text is cut into flat blocks; each block gets its word count and link density,
those of its neighbours and shallow counts of signs; a decision tree trained on the small
labelled table below says whether a block is plain text, a heading, a list, code, a formula or a menu.
Signs alone don't decide: a line over a rule is a heading or the end of a paragraph by its word count, a stretch between dollar
signs a formula or prices, links a menu or a reference by their density and that of the blocks around.
What the tree says rests on shallow features only, so it costs one pass over the text and no parse tree.
An exact check then finds markup inside lines of blocks that are neither code nor formula. Menus are left out of clean text.

Defined results: null and empty texts hold no element and clean to themselves; repeated rows
yield their elements once; whole texts are read whatever their length; extra columns are ignored.
"""

from __future__ import annotations

import html
import re
from functools import cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PLAIN, HEADING, LIST, CODE, FORMULA, MENU = range(6)
KINDS = ("plain", "heading", "list", "code", "formula", "menu")

_EOL = re.compile(r"\r\n?")
_SIGN = re.compile(r"[<\\$`~*_=#&\[{|]|''|^[ \t]*(?:[-+•]|\d{1,9}[.)])[ \t]|^(?: {4}|\t)|^-{3,}[ \t]*$", re.M)
# Spans that make one block whatever lines they hold.
_SPAN = re.compile(
    r"(?m:^[ \t]{0,3}(?P<f>```+|~~~+)[^\n]*\n(?s:.*?)(?:^[ \t]{0,3}(?P=f)[`~]*[ \t]*$|\Z))"
    r"|<(?P<t>pre|source|syntaxhighlight|math|h[1-6]|ul|ol|dl)\b(?s:[^>]*>.*?</(?P=t)\s*>)"
    r"|\\begin\{(?P<e>verbatim|lstlisting|minted|equation|align|gather|multline|eqnarray|displaymath|math|itemize|enumerate|description)(?P<s>\*?)\}(?s:.*?)\\end\{(?P=e)(?P=s)\}"
    r"|\$\$(?s:.+?)\$\$|\\\[(?s:.+?)\\\]|\\\((?s:.+?)\\\)"
    r"|(?<![\\$\w])\$(?=[^\s$])[^$\n]*?(?<=[^\s$\\])\$(?![\w$])"
    r"|\\(?:part|chapter|(?:sub)*section|paragraph)\*?\{[^{}\n]*\}",
    re.I,
)
_INLINE = re.compile(
    r"</?[A-Za-z][^<>\n]*/?>|<!--(?s:.*?)-->|&(?:[A-Za-z]{2,31}|#\d{1,7}|#[xX][0-9A-Fa-f]{1,6});"
    r"|'''?(?=\S)[^'\n]+'''?|\[\[[^\[\]\n]+\]\]|\{\{[^{}]+\}\}|!?\[[^\[\]\n]*\]\([^()\n]*\)|\[https?://[^\]\n]+\]"
    r"|(?<![*\w])\*\*?(?=[^\s*])[^*\n]*(?<=[^\s*])\*\*?(?![*\w])|(?<![_\w])__?(?=[^\s_])[^_\n]*(?<=[^\s_])__?(?![_\w])"
    r"|~~(?=\S)[^~\n]+~~|(?<!`)`[^`\n]+`(?!`)"
    r"|\\(?:textbf|textit|texttt|textsc|emph|underline|footnote|cite[pt]?|ref|label|href|url|caption)\*?(?:\[[^\]\n]*\])?\{[^{}\n]*\}|(?m:^\{\|)"
)
_STRUCTURE = re.compile(r"</?(?:h[1-6]|ul|ol|li|dl|dt|dd)\b[^<>\n]*>", re.I)
_LINE = re.compile(r"[ \t]*(?:[-+*•](?:[ \t]|(?=[*]))|[*]{1,4}[ \t]|\d{1,9}[.)][ \t])")
_WIKIHEAD = re.compile(r"[ \t]*(={1,6})[^=\n].*?\1[ \t]*$")
_HASH = re.compile(r"#{1,6}[ \t]")
_RULE = re.compile(r"[ \t]{0,3}(?:=+|-{2,})[ \t]*$")
_LINKED = re.compile(r"\[\[[^\[\]]+\]\]|\[[^\[\]]*\]\([^()]*\)|<a\b[^<>]*>.*?</a>", re.S | re.I)


def _line_class(line: str, before: str, indented: bool) -> int:
    """0 text, 1 list sign, 2 hash, 3 wiki heading, 4 underline, 5 indented."""
    if _RULE.match(line) and before.strip() and not _RULE.match(before):
        return 4
    if indented:
        return 5
    if _HASH.match(line):
        return 2
    if _LINE.match(line):
        return 1
    return 3 if _WIKIHEAD.match(line) else 0


def blocks(text: str) -> list[tuple[int, str]]:
    """Flat blocks (sign class, text); class 6 is a delimited span, 7 one inside a line of text."""
    out: list[tuple[int, str]] = []

    def lines(part: str) -> None:
        run: list[str] = []
        kind, before, blank = -1, "", True
        for line in part.split("\n"):
            if not line.strip():
                if run:
                    out.append((kind, "\n".join(run)))
                run, kind, before, blank = [], -1, "", True
                continue
            c = _line_class(line, before, line.startswith(("    ", "\t")) and (blank or kind == 5))
            if c == 4 and run and kind == 0:
                if len(run) > 1:
                    out.append((0, "\n".join(run[:-1])))
                out.append((4, f"{run[-1]}\n{line}"))
                run, kind, before, blank = [], -1, "", False
                continue
            if c != kind and run:
                out.append((kind, "\n".join(run)))
                run = []
            kind, before, blank = c, line, False
            run.append(line)
        if run:
            out.append((kind, "\n".join(run)))

    at, rest = 0, []
    for m in _SPAN.finditer(text):
        s, e = m.span()
        inside = "\n" not in m[0] and (text[text.rfind("\n", 0, s) + 1 : s].strip() or text[e : text.find("\n", e) if "\n" in text[e:] else len(text)].strip())
        if inside:
            rest.append((7, m[0]))
            lines_part = text[at:s]
            rest.append((None, lines_part, True))
        else:
            rest.append((None, text[at:s], False))
            rest.append((6, m[0]))
        at = e
    rest.append((None, text[at:], False))
    # Text around a span inside a line stays one piece.
    piece: list[str] = []
    for r in rest:
        if r[0] == 7:
            out.append((7, r[1]))
        elif r[0] == 6:
            out.append((6, r[1]))
        else:
            piece.append(r[1])
            if not r[2]:
                lines(" ".join(piece))
                piece = []
    return out


_OPEN = re.compile(r"\s*(?:(```|~~~)|<(pre|source|syntaxhighlight)\b|\\begin\{(verbatim|lstlisting|minted)|(<math\b|\$|\\\[|\\\(|\\begin\{(?:equation|align|gather|multline|eqnarray|displaymath|math))|<(h[1-6])\b|\\((?:sub)*section|part|chapter|paragraph)|<(ul|ol|dl)\b|\\begin\{(itemize|enumerate|description))", re.I)


def _size(block: str) -> tuple[int, int]:
    """Word count, and percent of the words that stand in links."""
    n = block.count(" ") + block.count("\n") + 1
    if "[" in block or "<a" in block or "<A" in block:
        linked = sum(m[0].count(" ") + 1 for m in _LINKED.finditer(block))
        return n, min(100, 100 * linked // n)
    return n, 0


def features(flat: list[tuple[int, str]]) -> list[tuple[int, ...]]:
    """Of each block: sign class; opening sign; lines; words and link density of it, the one before and the one after."""
    size = [(0, 0), *(_size(b) for _, b in flat), (0, 0)]
    out = []
    for k, (c, b) in enumerate(flat):
        m = _OPEN.match(b) if c in (6, 7) else None
        words, density = size[k + 1]
        out.append((*(int(c == x) for x in (1, 2, 3, 4, 5)), *(int(bool(m and m.lastindex == g)) for g in range(1, 9)), min(b.count("\n"), 3), min(words, 40), density, min(size[k][0], 40), size[k][1], min(size[k + 2][0], 40), size[k + 2][1]))
    return out


# ------------------------------------------------------------------ the labelled table and the tree

_TEXT = ["One line of plain words about a bridge.", "Words with a [link](a.md) in them.", "Many words stand here, and still more words follow them, so that the paragraph is long enough to fill its lines.", "See [[A page|it]]."]
_LONG_OVER_RULE = [f"Many words stand {'here, and still more follow them, ' * k}so that the line is no title of a mill.\n-----" for k in (3, 4, 5, 6)]
_PRICES = [f"${k} for the mill {'and a little more for all of the rest ' * k}of it in$" for k in (1, 2, 3, 4)]
_LABELLED: list[tuple[int, list[str]]] = [
    (HEADING, ["# Old mill", "## Old mill by the lake", "### Mill ###", "== Mill ==", "=== The mill ===", "Old mill\n========", "Old mill by the lake\n---------", "<h1>Mill</h1>", "<h2 class=\"a\">Old mill</h2>", "<H3>\nMill\n</H3>", "\\section{Mill}", "\\subsection*{Old mill}", "\\chapter{The old mill}"]),
    (LIST, ["- a", "- a\n- b", "* a\n* b\n** c", "+ a b c\n+ d", "1. a\n2. b", "  - a\n  - b c d e f", "- [ ] a\n- [x] b", "# a\n# b", "# a\n## b\n# c", "<ul><li>a</li></ul>", "<ol>\n<li>a\n<li>b</ol>", "\\begin{itemize}\n\\item a\n\\end{itemize}", "\\begin{enumerate}\n\\item a\n\\item b\n\\end{enumerate}", "1) a\n2) b\n3) c\n4) d", "- mill", "- mill\n- mill", "# mill\n## mill", "<ul><li>mill</ul>"]),
    (CODE, ["```\nmill = 1\n```", "```sql\nselect 1\n```", "~~~\nmill\ny\n~~~", "<pre>x</pre>", "<pre>mill</pre>", "<pre>\nmill\n</pre>", "<pre><code>x\ny</code></pre>", "<source>\nmill\n</source>", "<syntaxhighlight lang=\"c\">int mill;</syntaxhighlight>", "\\begin{verbatim}\nmill\n\\end{verbatim}", "\\begin{lstlisting}\nmill = 1\n\\end{lstlisting}", "    mill = 1\n    b = 2", "\ta = 1", "    if (mill) {\n      y();\n    }", "    a\n    b\n    c\n    d", "```\na mill\nb\nc\n```", "~~~ c\na mill\nb\nc\nd\n~~~", "<pre>\na mill\nb\nc\n</pre>", "<source>\na mill\nb\nc\n</source>", "<syntaxhighlight>\na mill\nb\nc\n</syntaxhighlight>", "\\begin{verbatim}\na mill\nb\nc\n\\end{verbatim}", "\\begin{lstlisting}\na mill\nb\nc\n\\end{lstlisting}"]),
    (FORMULA, ["$$x$$", "$$mill$$", "$$\nx^2\n$$", "\\[ x \\]", "\\begin{equation}\nmill\n\\end{equation}", "\\begin{align*}\nx\n\\end{align*}", "<math>x</math>", "<math><mi>x</mi></math>", "$x^2$", "\\(x\\)", "$$\na mill\nb\nc\n$$", "<math>\na mill\nb\nc\n</math>", "\\begin{equation}\na mill\nb\nc\n\\end{equation}"]),
    (PLAIN, [*_TEXT, "Two lines of words\nwithout any sign.", "A short one.", "Title words", "Mill", "Old mill", "The mill\nand more", "A mill\na mill\nb\nc", "He said: 3 < 5.", "<p>A paragraph of words.</p>", *_LONG_OVER_RULE, *_PRICES]),
]
_LINKS = ["[[Mill]]", "[mill](a.md)", "- [mill](a.md)\n- [hill](b.md)", "* [[Mill]]\n* [[Hill]]\n* [[Till]]", "1. [mill](a.md)\n2. [hill](b.md)", "# [mill](a.md)", "== [[Mill]] ==", "<ul><li><a href='a'>mill</a><li><a href='b'>hill</a></ul>"]
_REFERRING = ["This note collects the open questions about [the old mill](a.md) and the market.", "The old mill of [[Hill|the hill]] stands.", "See [[A page|it]] and [that](b.md) too.", "Ask [the miller](a.md), [the carter](b.md) or [[Ann]] for the key of the [old mill by the lake](c.md).", "The [[mill]] was moved.", "Read [the long report on the old mill and its wheel](a.md) first.", "Go to [the mill](a.md) now."]
_MENUS = ["[home](/) | [mill](/a) | [hill](/b) | [help](/c)", "[[Home]] · [[Mill]] · [[Hill]] · [[Till]]", "[home](/)\n[mill](/a)\n[hill](/b)\n[help](/c)", "<a href='/'>home</a> <a href='/a'>mill</a> <a href='/b'>hill</a> <a href='/c'>help</a>", "[previous](/a) [up](/b) [next](/c) [index](/d) [about](/e)"]


_FILLS = ("ill", "ill hill", "ill and a hill by the lake", "ill of a town that lies far from here and further from there", "ill" + " so and so" * 14)
_BEFORE = ("", *_TEXT, "- a\n- b", "## Mill")
_AFTER = ("", _TEXT[0], _TEXT[1], "```\nx\n```")


def labelled() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each labelled block between each two kinds of neighbours: features, labels, and the number of the labelled text they come from."""
    x, y, source = [], [], []

    def add(label: int, text: str, befores, afters, number: int) -> None:
        for before in befores:
            for after in afters:
                own = len(blocks(before)) if before else 0
                f = features([*(blocks(before) if before else []), *blocks(text), *(blocks(after) if after else [])])
                x.append(f[own])
                y.append(label)
                source.append(number)

    number = 0
    for label, texts in _LABELLED:
        for t in texts:
            fixed = t in _LONG_OVER_RULE or t in _PRICES
            for fill in ("ill",) if fixed else _FILLS:
                if label == HEADING and _RULE.search(t) and len(fill) > 60 or label == FORMULA and t[:1] == "$" and t[1:2] != "$" and len(fill) > 30:
                    continue  # too long for what it is
                add(label, t.replace("ill", fill), _BEFORE, _AFTER, number)
            number += 1
    signs = {"-": LIST, "*": LIST, "1": LIST, "<": LIST, "#": HEADING, "=": HEADING}
    for t in _LINKS:
        add(signs.get(t[0], PLAIN), t, _BEFORE, _AFTER, number)
        if t[0] in signs:
            add(signs[t[0]], t, ("[[Mill]]", _MENUS[0]), ("[[Hill]]", _MENUS[1]), number)
        else:  # one link is a reference among text and a part of a menu among links
            add(MENU, t, ("[[Mill]]", "[hill](b.md)", _MENUS[0]), ("[[Hill]]", "[till](c.md)", _MENUS[1]), number)
        number += 1
    for t in _REFERRING:
        add(PLAIN, t, (*_BEFORE, "[[Mill]]", _MENUS[0]), (*_AFTER, "[[Hill]]", _MENUS[1]), number)
        number += 1
    for t in _MENUS:
        add(MENU, t, (*_BEFORE, "[[Mill]]", _MENUS[0]), (*_AFTER, "[[Hill]]", _MENUS[1]), number)
        number += 1
    return np.array(x), np.array(y), np.array(source)


def fit(x: np.ndarray, y: np.ndarray, depth: int = 18) -> tuple | int:
    """A CART decision tree by Gini impurity: (feature, threshold, left, right) or a label."""
    counts = np.bincount(y, minlength=len(KINDS))
    if depth == 0 or counts.max() == len(y):
        return int(counts.argmax())
    best, least = None, None
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for t in values[:-1]:
            left = x[:, f] <= t
            gini = sum(m.sum() * (1 - ((np.bincount(y[m], minlength=len(KINDS)) / m.sum()) ** 2).sum()) for m in (left, ~left))
            if least is None or gini < least - 1e-9:
                least, best = gini, (f, int(t), left)
    if best is None:
        return int(counts.argmax())
    f, t, left = best
    low, high = fit(x[left], y[left], depth - 1), fit(x[~left], y[~left], depth - 1)
    return low if low == high else (f, t, low, high)


@cache
def tree() -> tuple | int:
    return fit(*labelled()[:2])


def used(node: tuple | int) -> set[int]:
    """Features a tree splits on."""
    return set() if isinstance(node, int) else {node[0]} | used(node[2]) | used(node[3])


def predict(node: tuple | int, row: tuple[int, ...]) -> int:
    while not isinstance(node, int):
        node = node[2] if row[node[0]] <= node[1] else node[3]
    return node


class Classifier:
    """The tree with a memory of the feature rows it has met."""

    def __init__(self, node: tuple | int):
        self.node, self.seen = node, {}

    def label(self, flat: list[tuple[int, str]]) -> list[int]:
        out = []
        for row in features(flat):
            if (k := self.seen.get(row)) is None:
                if len(self.seen) > 500_000:
                    self.seen.clear()
                self.seen[row] = k = predict(self.node, row)
            out.append(k)
        return out


def kinds(text: str, classifier: Classifier) -> set[str]:
    """Kinds of marked-up elements in a text, ``inline`` among them."""
    if "\r" in text:
        text = _EOL.sub("\n", text)
    if not _SIGN.search(text):
        return set()
    flat = blocks(text)
    out = set()
    for (_, b), k in zip(flat, classifier.label(flat)):
        if k not in (PLAIN, MENU):
            out.add(KINDS[k])
        if k not in (CODE, FORMULA) and "inline" not in out and any(not _STRUCTURE.fullmatch(m[0]) for m in _INLINE.finditer(b)):
            out.add("inline")
    return out


# ------------------------------------------------------------------ clean text

_STRIP = [
    (re.compile(r"<!--.*?-->", re.S), ""),
    (re.compile(r"<ref\b[^<>]*/>|<ref\b[^<>]*>.*?</ref\s*>", re.S | re.I), ""),
    (re.compile(r"!?\[([^\[\]\n]*)\]\([^()\n]*\)"), r"\1"),
    (re.compile(r"\[\[(?:[^\[\]|\n]*\|)?([^\[\]|\n]*)\]\]"), r"\1"),
    (re.compile(r"\{\{[^{}|]*\|(?:[^{}|]*\|)*([^{}|]*)\}\}"), r"\1"),
    (re.compile(r"\{\{[^{}]*\}\}"), ""),
    (re.compile(r"\\(?:footnote|cite[pt]?|label|ref)\*?(?:\[[^\]\n]*\])?\{[^{}\n]*\}"), ""),
    (re.compile(r"\\(?:textbf|textit|texttt|textsc|emph|underline)\{([^{}\n]*)\}"), r"\1"),
    (re.compile(r"'''?"), ""),
    (re.compile(r"(?<![*\w])\*\*?(?=[^\s*])([^*\n]*(?<=[^\s*]))\*\*?(?![*\w])"), r"\1"),
    (re.compile(r"(?<![_\w])__?(?=[^\s_])([^_\n]*(?<=[^\s_]))__?(?![_\w])"), r"\1"),
    (re.compile(r"~~([^~\n]+)~~"), r"\1"),
    (re.compile(r"(?<!`)`([^`\n]+)`(?!`)"), r"\1"),
    (re.compile(r"<br\s*/?>", re.I), "\n"),
    (re.compile(r"</?[A-Za-z][^<>\n]*>"), ""),
]
_WRAP = re.compile(r"\A\s*(?:(?:```+|~~~+)[^\n]*\n|<(?:pre|source|syntaxhighlight|math)\b[^>]*>(?:<code[^>]*>)?|\\begin\{\w+\*?\}(?:\[[^\]]*\])?|\$\$?|\\\[|\\\()\n?|\n?(?:^(?:```+|~~~+)[ \t]*|(?:</code>)?</(?:pre|source|syntaxhighlight|math)\s*>|\\end\{\w+\*?\}|\$\$?|\\\]|\\\))\s*\Z", re.I | re.M)


def bare(text: str) -> str:
    for rule, to in _STRIP:
        text = rule.sub(to, text)
    return html.unescape(text).replace("\xa0", " ").strip()


def clean(text: str, classifier: Classifier) -> str:
    """Headings as ``# x``, list items as ``- x``, code fenced, formulas between dollar signs, the rest bare."""
    text = _EOL.sub("\n", text)
    if not _SIGN.search(text):
        return text.strip()
    flat = blocks(text)
    out = []
    for (c, b), k in zip(flat, classifier.label(flat)):
        if k == MENU:
            continue
        if k == CODE:
            body = _WRAP.sub("", b) if c == 6 else "\n".join(line[4:] if line.startswith("    ") else line.lstrip("\t") for line in b.split("\n"))
            out.append(f"```\n{html.unescape(body) if '<' in b else body}\n```")
        elif k == FORMULA:
            out.append(f"${re.sub(r'<[^<>]*>', '', _WRAP.sub('', b)).strip()}$")
        elif k == HEADING:
            head = re.sub(r"\A\s*(?:#+|=+)|\\\w+\*?\{|</?h\d[^<>]*>|(?:#+|=+|\})\s*\Z|\n[-=]+\s*\Z", "", b, flags=re.I)
            out.append("# " + " ".join(bare(head).split()))
        elif k == LIST:
            items = re.split(r"<li\b[^<>]*>|\\item\b(?:\[[^\]]*\])?|<d[td]\b[^<>]*>", re.sub(r"\\(?:begin|end)\{\w+\}", "", b), flags=re.I) if c == 6 else [re.sub(r"\A[ \t]*(?:[-+*#•]+|\d+[.)])[ \t]*(?:\[[ xX]\][ \t]*)?", "", line) for line in b.split("\n")]
            out.append("\n".join(f"- {t}" for x in items if (t := bare(x))))
        elif t := bare(b):
            out.append(t)
    return "\n\n".join(out)


# ------------------------------------------------------------------ over tables


def _classifier(df: DataFrame):
    return df.sparkSession.sparkContext.broadcast(tree())


def elements(df: DataFrame, *, text: str, keys: list[str]) -> DataFrame:
    """One row (keys..., kind) for each kind of element a row's text holds."""
    import pyarrow as pa

    shared = _classifier(df)
    src = df.select(*keys, F.col(text).alias("_text")).filter("length(_text) > 0")
    schema = [f.dataType.simpleString() for f in src.schema.fields[:-1]]

    def run(batches):
        c = Classifier(shared.value)
        for batch in batches:
            at, kind = [], []
            for k, t in enumerate(batch.column(len(keys)).to_pylist()):
                for x in kinds(t, c):
                    at.append(k)
                    kind.append(x)
            cols = [batch.column(k).take(pa.array(at, pa.int64())) for k in range(len(keys))]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(kind, pa.string())], names=[*keys, "kind"])

    return src.mapInArrow(run, ", ".join(f"`{k}` {t}" for k, t in zip(keys, schema)) + ", kind string").distinct()


def clean_text(df: DataFrame, *, text: str, into: str = "clean") -> DataFrame:
    """The table with the clean text of a column added; null stays null."""
    shared = _classifier(df)

    @F.pandas_udf("string")
    def run(col):
        c = Classifier(shared.value)
        return col.map(lambda t: None if t is None else clean(t, c))

    return df.withColumn(into, run(F.col(text)))
