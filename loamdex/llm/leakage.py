"""Evaluation texts leaking into training text.

Method: a BM25 inverted index over the held-out items (terms are adjacent word
pairs) is probed by every training passage with block-max WAND; each retrieved
(document, item) pair is then verified word by word.

An item's threshold is the least total of BM25 impacts that a quotation of ``min_words`` of its words can keep
when single words are altered, lost or added as the verification allows, so retrieval loses nothing that would be
verified. Postings carry the share of the threshold they contribute, and a passage is retrieved where the shares reach 1.

Shared sentences, document frequencies and lengths are counted over all items first. The index is
then built in blocks of at most about ``block_words`` words, each a bounded broadcast, and the
corpus streamed once per block, never shuffled; what is found doesn't depend on the blocks.

Defined results: null, empty and blank texts hold nothing; repeated items are
indexed once, of several texts under one id the largest holds; an item shorter than ``min_words`` (without shared instruction
sentences) can't leak; extra columns are ignored; an empty table on either side
gives an empty result.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loamdex.session import checkpointed

MIN_WORDS = 15
# Words of a text that min_words words of an item spread over at most, added ones among them; and with what ends the run.
WINDOW, PASSAGE = 24, 32
BLOCK_WORDS = 2_000_000
POSTING_BLOCK = 32
SHARED_SENTENCE = 3
K1, B = 1.2, 0.75

_WORD = re.compile(r"\w+")
_SENTENCE = re.compile(r"(?<=[.!?])\s+")
_REF = re.compile(r"<ref\b[^<>]*/>|<ref\b[^<>]*>.*?</ref\s*>", re.S | re.I)
_NOTE = re.compile(r"\{\{\s*(?:citation needed|cn|fact|clarify|when|who|note|sfn|efn)\b[^{}]*\}\}", re.I)
_LINK = re.compile(r"\[\[[^\[\]|]*\|([^\[\]|]*)\]\]")
_MDLINK = re.compile(r"!?\[([^\[\]]*)\]\([^()\s]*\)")
_LANG = re.compile(r"\{\{\s*lang\s*\|[^{}|]*\|([^{}|]*)\}\}", re.I)
_TAG = re.compile(r"</?[A-Za-z][^<>]*>")
_COMMENT = re.compile(r"<!--.*?-->", re.S)

# Letters of other scripts drawn like Latin ones.
_LOOKALIKE = dict(
    zip(
        "авсеғһіјкмнопрԛѕтԝхуΑΒΕΖΗΙΚΜΝΟΡΤΥΧοαινρυχ",
        "abcefhijkmhonpqstwxyabezhikmnoptyxoaivpux",
    )
)
_FOLD = {ord(k): v for k, v in _LOOKALIKE.items()} | {ord("ß"): "ss"}
_HIDDEN = re.compile("[\u00ad\u200b-\u200f\u2060\ufeff]+")
_MARKS = re.compile("[\u0300-\u036f]+")


_APART = {n: " " for n in range(128) if not chr(n).isalnum()}


def _letters(word: str) -> str:
    """One word in lower case, its marks dropped and look-alike letters folded."""
    if not word.isascii():
        word = _MARKS.sub("", unicodedata.normalize("NFKD", word.casefold())).translate(_FOLD)
    return word.lower()


def _tokens(text: str) -> list[str]:
    """Words as written, of a text with entities, compatibility forms and hidden characters resolved."""
    if "&" in text:
        text = html.unescape(text)
    if not text.isascii():
        text = unicodedata.normalize("NFKC", _HIDDEN.sub("", text))
    else:
        return text.translate(_APART).split()
    return _WORD.findall(text.replace("_", " ") if "_" in text else text)


def words(text: str) -> list[str]:
    return [_letters(w) for w in _tokens(text)]


class _Ids(dict):
    """Word as written -> id in a vocabulary or -1; folds each spelling once, and forgets all when it grows large."""

    def __init__(self, vocab: dict[str, int]):
        super().__init__()
        self.vocab = vocab

    def __missing__(self, word: str) -> int:
        if len(self) > 1_000_000:
            self.clear()
        self[word] = n = self.vocab.get(_letters(word), -1)
        return n


def views(text: str) -> list[list[str]]:
    """Words, as they are spelled, of a text as shown, without its notes, and as written."""
    if "&" in text:
        text = html.unescape(text)
    shown = _TAG.sub("", _LINK.sub(r"\1", _MDLINK.sub(r"\1", _LANG.sub(r"\1", text)))).replace("''", "")
    bare = _LINK.sub(r"\1", _MDLINK.sub(r"\1", _LANG.sub(r"\1", _NOTE.sub("", _REF.sub("", text)))))
    plain = _TAG.sub("", _COMMENT.sub("", bare)).replace("''", "")
    out = []
    for v in dict.fromkeys((plain, shown, _TAG.sub("", bare).replace("''", ""), text)):
        w = _tokens(v)
        if w not in out:
            out.append(w)
    return out


def sentences(text: str | None) -> list[list[str]]:
    return [w for x in _SENTENCE.split(text or "") if (w := words(x))]


def own_words(texts: dict[int, str | None]) -> dict[int, list[str]]:
    """Words of each item without sentences that ``SHARED_SENTENCE`` or more items have; ``item_words`` does the same over tables."""
    split = {k: sentences(t) for k, t in texts.items()}
    often = Counter(s for x in split.values() for s in {tuple(s) for s in x})
    return {k: [w for s in x if often[tuple(s)] < SHARED_SENTENCE for w in s] for k, x in split.items()}


def least_kept(w: np.ndarray, length: int) -> float:
    """Least total of pair weights ``w`` (of words i and i + 1) in any ``length`` consecutive words with the alterations ``longest_quote`` bridges.

    The way through a stretch of words: ``one`` where a word is the first of an equal stretch, ``more`` where it follows an
    equal one (and its pair is kept). A new stretch begins after an altered or lost word, or after an added one,
    if the one before has two words or more. A longer quotation cut at ``length`` words may end anywhere.
    """
    n = len(w) + 1
    starts = n - length + 1
    if starts < 1:
        return 0.0
    inf = np.full(starts, np.inf)
    one, more, before = np.zeros(starts), inf, inf
    for t in range(1, length):
        kept = np.minimum(one, more) + w[t - 1 : t - 1 + starts]
        fresh = np.minimum(more, before)
        one, more, before = fresh, kept, more
    return float(np.minimum(np.minimum(one, more), before).min())


class ItemIndex:
    """Inverted index of word pairs: BM25 impacts as shares of the item's threshold, with maxima by term and by block of items."""

    def __init__(self, own: dict[int, list[str]], df: dict[tuple[str, str], int], n_items: int, mean: float, min_words: int = MIN_WORDS):
        """``own``: words of the items of this index; ``df`` (1 where absent), ``n_items`` and ``mean`` length are those of all items."""
        self.own = {k: w for k, w in own.items() if len(w) >= min_words}
        self.min_words, self.ids = min_words, None
        self.least_pairs = int(least_kept(np.ones(min_words - 1), min_words))
        self.items = sorted(self.own)
        vocab: dict[str, int] = {}
        key, item, share = [], [], []
        coded = {k: np.array([vocab.setdefault(w, len(vocab)) for w in self.own[k]], dtype=np.int64) for k in self.items}
        self.vocab, self.v = vocab, max(1, len(vocab))
        for n, k in enumerate(self.items):
            w, ids = self.own[k], coded[k]
            pairs, first, at, tf = np.unique(ids[:-1] * self.v + ids[1:], return_index=True, return_inverse=True, return_counts=True)
            often = np.array([df.get((w[i], w[i + 1]), 1) for i in first.tolist()], dtype=np.float64)
            norm = K1 * (1 - B + B * len(w) / mean)
            impact = np.log1p((n_items - often + 0.5) / (often + 0.5)) * tf * (K1 + 1) / (tf + norm)
            key.append(pairs)
            item.append(np.full(len(pairs), n, dtype=np.int64))
            share.append(impact / least_kept(impact[at.ravel()], min_words))
        cat = lambda x, t: np.concatenate(x).astype(t) if x else np.zeros(0, t)
        key, item, share = cat(key, np.int64), cat(item, np.int64), cat(share, np.float64)
        order = np.lexsort((item, key))
        key, self.item, self.share = key[order], item[order], share[order]
        self.keys, start = np.unique(key, return_index=True)
        self.term_max = np.maximum.reduceat(self.share, start) if len(start) else np.zeros(0)
        row = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(key))))
        # Postings of one term and one block of items stand together: (first, end, block, greatest share).
        new = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (self.item[1:] // POSTING_BLOCK != self.item[:-1] // POSTING_BLOCK))) if len(row) else start
        self.block_first, self.block_end = new, np.append(new[1:], len(key))
        self.block, self.block_max = self.item[new] // POSTING_BLOCK, np.maximum.reduceat(self.share, new) if len(new) else np.zeros(0)
        self.blocks = np.searchsorted(row[new], np.arange(len(start) + 1))

    @classmethod
    def of(cls, texts: dict[int, str | None], min_words: int = MIN_WORDS) -> ItemIndex:
        """An index of all there is."""
        own = {k: w for k, w in own_words(texts).items() if len(w) >= min_words}
        df = Counter(p for w in own.values() for p in set(zip(w, w[1:])))
        return cls(own, df, len(own), sum(map(len, own.values())) / max(1, len(own)), min_words)

    def candidates(self, texts: list[list[str]]) -> list[tuple[int, int, int, int]]:
        """(index of word sequence, index of item, begin, end) of passages whose shares reach 1; such that overlap are one."""
        if not len(self.keys):
            return []
        if self.ids is None:
            self.ids = _Ids(self.vocab)
        get = self.ids.__getitem__
        ids: list[int] = []
        bounds = []
        pad = [-1] * WINDOW
        for t in texts:
            ids += map(get, t)
            ids += pad
            bounds.append(len(ids))
        a = np.array(ids, dtype=np.int64)
        both = np.flatnonzero((a[:-1] >= 0) & (a[1:] >= 0))
        key = a[both] * self.v + a[both + 1]
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        hit = self.keys[at] == key
        pos, term = both[hit], at[hit]
        # Passages by the terms' maxima, then by the maxima of blocks, then by the postings of the blocks left.
        left = _reached(np.zeros(len(pos), np.int64), pos, self.term_max[term], len(a), self.least_pairs)[0]
        pos, term = pos[left], term[left]
        hits, entry = _expand(self.blocks[term], self.blocks[term + 1])
        left, order = _reached(self.block[entry], pos[hits], self.block_max[entry], len(a), self.least_pairs)
        hits, entry = hits[order][left], entry[order][left]
        row, post = _expand(self.block_first[entry], self.block_end[entry])
        where = pos[hits[row]]
        _, order, begins = _reached(self.item[post], where, self.share[post], len(a), self.least_pairs, starts=True)
        at, n = where[order][begins], self.item[post][order][begins]
        doc = np.searchsorted(np.array(bounds), at, side="right")
        out: list[tuple[int, int, int, int]] = []
        for d, k, p in zip(doc.tolist(), n.tolist(), at.tolist()):  # in order of item, then position
            p -= bounds[d - 1] if d else 0
            if out and out[-1][:2] == (d, k) and p <= out[-1][3]:
                out[-1] = (d, k, out[-1][2], p + PASSAGE)
            else:
                out.append((d, k, p, p + PASSAGE))
        return sorted(out)

    def holds(self, passage: list[str], n: int) -> bool:
        return longest_quote([_letters(w) for w in passage], self.own[self.items[n]]) >= self.min_words


def _expand(first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of ranges: the number of the range and each position in it."""
    size = end - first
    row = np.repeat(np.arange(len(first)), size)
    return row, np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(first, size)


def _reached(group: np.ndarray, pos: np.ndarray, share: np.ndarray, length: int, least: int, *, starts: bool = False):
    """Entries in a window of ``WINDOW`` positions that holds ``least`` of a group or more and whose shares reach 1, as marks over the entries in order of (group, position), and that order."""
    place = group * (length + WINDOW) + pos
    order = np.argsort(place, kind="stable")
    place = place[order]
    end = np.searchsorted(place, place + WINDOW)
    total = np.concatenate([[0], np.cumsum(share[order])])
    good = np.flatnonzero((total[end] - total[:-1] >= 1 - 1e-6) & (end - np.arange(len(place)) >= least))
    mark = np.zeros(len(place) + 1, dtype=np.int64)
    np.add.at(mark, good, 1)
    np.add.at(mark, end[good], -1)
    left = np.cumsum(mark)[:-1] > 0
    return (left, order, good) if starts else (left, order)


def longest_quote(text: list[str], item: list[str]) -> int:
    """Longest run of consecutive item words in the text, single altered, lost or added words bridged.

    A run begins and ends with equal words; between two equal stretches at most one word
    differs, is missing or is added, and at least two equal words lie on each side of it.
    """
    where = defaultdict(list)
    for j, w in enumerate(item):
        where[w].append(j)
    stretches = []  # (text start, item start, length) of maximal equal stretches of two or more words
    live: dict[int, int] = {}
    for i, w in enumerate(text):
        new: dict[int, int] = {}
        for j in where.get(w, ()):
            new[j] = live.pop(j - 1, 0) + 1
        stretches += [(i - k, j - k + 1, k) for j, k in live.items() if k > 1]
        live = new
    stretches += [(len(text) - k, j - k + 1, k) for j, k in live.items() if k > 1]
    stretches.sort()
    best = 0
    begins: dict[tuple[int, int], int] = {}  # where the run that ends at (text, item) begins in the item
    for ti, ii, k in stretches:
        begin = min([ii, *(begins[e] for e in ((ti - x, ii - y) for x in (0, 1) for y in (0, 1)) if e in begins)])
        end = (ti + k, ii + k)
        begins[end] = min(begin, begins.get(end, begin))
        best = max(best, ii + k - begin)
    return best


def item_words(items: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(item_id, words) of items (item_id, text): the words without sentences shared by ``SHARED_SENTENCE`` or more items, where ``min_words`` are left."""
    import pyarrow as pa

    def split(batches):
        for batch in batches:
            rows = [(k, n, w) for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for n, w in enumerate(sentences(t))]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.list_(pa.string()))], names=["item_id", "at", "words"])

    s = items.groupBy("item_id").agg(F.max("text").alias("text")).mapInArrow(split, "item_id long, at int, words array<string>")
    s = checkpointed(s.withColumn("h", F.struct(F.xxhash64("words"), F.hash("words"), F.size("words"))))
    shared = s.select("item_id", "h").distinct().groupBy("h").count().filter(F.col("count") >= SHARED_SENTENCE).select("h")
    own = s.join(shared, "h", "left_anti").groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("at", "words"))).alias("x"))
    return checkpointed(own.select("item_id", F.flatten("x.words").alias("words")).filter(F.size("words") >= min_words))


def leaked(
    documents: DataFrame,
    items: DataFrame,
    *,
    doc_id: str | Column = "doc_id",
    text: str | Column = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    min_words: int = MIN_WORDS,
    block_words: int = BLOCK_WORDS,
) -> DataFrame:
    """One row (doc_id, item_id) for each item of which a document holds ``min_words`` consecutive words."""
    docs = documents.select(F.col(doc_id).cast("long").alias("doc_id") if isinstance(doc_id, str) else doc_id.alias("doc_id"), F.col(text).alias("text") if isinstance(text, str) else text.alias("text"))
    docs = docs.filter("length(text) > 0")
    known = items.select(F.col(item_id).cast("long").alias("item_id"), F.col(item_text).alias("text")).filter("item_id is not null")
    own = item_words(known, min_words)
    n, total = own.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("words")), F.lit(0))).first()
    blocks = max(1, -(-total // block_words))
    pair = F.expr("explode(array_distinct(transform(sequence(1, size(words) - 1), i -> struct(words[i - 1] as a, words[i] as b))))").alias("p")
    pairs = own.select("item_id", pair)
    often = pairs.groupBy("p").count().filter("count > 1")
    of_block = F.pmod(F.xxhash64("item_id"), F.lit(blocks))
    out = None
    for b in range(blocks):
        # What is gathered is bounded by the words of a block.
        texts = {r.item_id: r.words for r in own.filter(of_block == b).toLocalIterator()}
        df = {(r.p.a, r.p.b): r["count"] for r in often.join(pairs.filter(of_block == b).select("p").distinct(), "p", "left_semi").toLocalIterator()}
        part = _probe(docs, ItemIndex(texts, df, n, total / max(1, n), min_words))
        out = part if out is None else out.unionByName(part)
    return out.distinct()


def _probe(docs: DataFrame, index: ItemIndex) -> DataFrame:
    import pyarrow as pa

    shared = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches):
        ix = shared.value
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            rows: set[tuple[int, int]] = set()
            for s in range(0, len(texts), 256):
                owner, shown = [], []
                for d in range(s, min(s + 256, len(texts))):
                    for v in views(texts[d]):
                        owner.append(d)
                        shown.append(v)
                for v, n, begin, end in ix.candidates(shown):
                    row = (ids[owner[v]], ix.items[n])
                    if row not in rows and ix.holds(shown[v][begin:end], n):
                        rows.add(row)
            got = sorted(rows, key=str)
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in got], pa.int64()), pa.array([r[1] for r in got], pa.int64())], names=["doc_id", "item_id"])

    return docs.mapInArrow(run, "doc_id long, item_id long")
