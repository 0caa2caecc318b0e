"""Encoding of a whole corpus with a public byte-level BPE tokenizer.

Method: monoid tree reduction. A text is halved recursively down to leaves of
``leaf_chars`` characters. A leaf is scanned by the tokenizer's pattern on its own; two neighbours are
joined by scanning a window again that begins at the left one's last stable pretoken and
grows over the right one, doubling, until a boundary found in it that can't change any more is also a boundary of the right
one's own scan. Since the scan has no memory, all pretokens outside the window are then those of the whole text.
A pretoken is stable if it doesn't touch the end of its part and begins ``REACH`` characters or more before it:
no alternative of the pattern looks further ahead but over a run it takes to its end. Merges
happen within pretokens alone, so the ids of a text are those of its pretokens; decoding concatenates their bytes.

Pretokens repeat all over a corpus, so each worker keeps the ids of those it has met (a bounded memory, emptied when full).

Defined results: an empty list for empty and null texts; a text of blanks is encoded as it
stands; repeated rows give repeated rows (``distinct`` them by id first if need be); special
tokens' strings in a text are ordinary text.
"""

from __future__ import annotations

import base64
import os
from functools import cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAF_CHARS = 512
# Length of the longest contraction, which is as far as the pattern looks ahead.
REACH = 3
TOKENIZER_DIR = "/opt/tokenizers"


def pattern(folder: str) -> str:
    """The pattern by which the tokenizers of a folder of public vocabulary files cut texts into pretokens."""
    import sys

    parent, package = os.path.split(os.path.realpath(folder))
    sys.path.insert(0, parent)
    try:
        return __import__(package).PATTERN
    finally:
        sys.path.remove(parent)


@cache
def encoding(folder: str, name: str):
    """The tokenizer of ``name``.tiktoken in a folder of public vocabulary files."""
    import tiktoken

    with open(os.path.join(folder, f"{name}.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(name, pat_str=pattern(folder), mergeable_ranks=ranks, special_tokens={})


class _Memory(dict):
    """Pretoken -> its ids as 32-bit integers."""

    LONGEST, MOST = 48, 400_000

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, pretoken: str) -> bytes:
        import numpy as np

        ids = np.array(self.encode(pretoken), dtype=np.int32).tobytes()
        if len(pretoken) <= self.LONGEST:
            if len(self) >= self.MOST:
                self.clear()
            self[pretoken] = ids
        return ids


class TreeEncoder:
    def __init__(self, encode, scan, leaf_chars: int = LEAF_CHARS):
        """``encode`` gives the ids of one pretoken, ``scan`` the pretokens of a text."""
        self.scan, self.leaf_chars, self.ids = scan, max(1, leaf_chars), _Memory(encode)

    def stable(self, part: list[str]) -> int:
        """How many pretokens of a part can't change whatever follows it."""
        n, left = len(part), 0
        while n and (n == len(part) or left < REACH):
            n -= 1
            left += len(part[n])
        return n

    def join(self, x: list[str], y: list[str]) -> list[str]:
        if not x or not y:
            return x or y
        keep = self.stable(x)
        open_ = "".join(x[keep:])
        width = 2
        while True:
            window = self.scan(open_ + "".join(y[:width]))
            if width >= len(y):
                return x[:keep] + window
            ends, at = {}, len(open_)
            for k, t in enumerate(y[:width]):
                ends[at] = k
                at += len(t)
            at = 0
            for n, t in enumerate(window[: self.stable(window) + 1]):
                if at in ends:
                    return x[:keep] + window[:n] + y[ends[at] :]
                at += len(t)
            width *= 2

    def tree(self, text: str) -> list[str]:
        if len(text) <= self.leaf_chars:
            return self.scan(text)
        half = len(text) // 2
        return self.join(self.tree(text[:half]), self.tree(text[half:]))

    def __call__(self, text: str | None) -> bytes:
        return b"".join(map(self.ids.__getitem__, self.tree(text))) if text else b""


def encode_corpus(df: DataFrame, *, key: str = "doc_id", text: str = "text", tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZER_DIR, leaf_chars: int = LEAF_CHARS) -> DataFrame:
    """One row (key, ids) for each row."""
    import pyarrow as pa

    src = df.select(F.col(key), F.col(text).alias("_text"))
    kind = src.schema[0].dataType.simpleString()

    def run(batches):
        import numpy as np

        import regex

        encode = TreeEncoder(encoding(folder, tokenizer).encode_ordinary, regex.compile(pattern(folder)).findall, leaf_chars)
        for batch in batches:
            for start in range(0, batch.num_rows, 2048):
                part = batch.slice(start, 2048)
                got = [encode(t) for t in part.column(1).to_pylist()]
                offsets = np.zeros(len(got) + 1, dtype=np.int32)
                np.cumsum([len(g) // 4 for g in got], out=offsets[1:])
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(got), dtype=np.int32)))
                yield pa.RecordBatch.from_arrays([part.column(0), ids], names=[key, "ids"])

    return src.mapInArrow(run, f"`{key}` {kind}, ids array<int>")


def decode(ids: list[int], *, tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZER_DIR) -> str:
    return encoding(folder, tokenizer).decode_bytes(ids).decode("utf-8", errors="replace")
