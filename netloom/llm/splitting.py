"""Cutting long texts at natural boundaries into overlapping pieces of bounded token count."""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from netloom.core.arrow import spread
from netloom.llm import tokens

#: Strength of a boundary; the strongest are the last to be merged away.
ANYWHERE, WORD, SENTENCE, LINE, PARAGRAPH, HEADING = range(6)
BOUNDARY = re.compile(  # the first look is at one character
    r"(?=[\r\n<.!?…。！？])(?:(?P<h>(?:\r?\n)+(?=\#{1,6}[ \t]|<h[1-6]|={3,}|-{3,}))|(?P<p>\r?\n[ \t]*(?:\r?\n[ \t]*)+|</p>\s*)|(?P<l>\r?\n)|(?P<s>[.!?…][\"')\]»”]*(?=\s)|[。！？][」』）”]*))"
)
STRENGTH = {"h": HEADING, "p": PARAGRAPH, "l": LINE, "s": SENTENCE}


@cache
def lengths(path: str) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of each token, and whether it begins with a blank."""
    enc = tokens.encoding(path)
    raw = [enc.decode_single_token_bytes(i) for i in range(enc.max_token_value + 1)]
    return np.array([len(r) for r in raw], np.int64), np.array([r[:1].isspace() for r in raw])


def atoms(text: str, ids: np.ndarray, ends: np.ndarray, starts_char: np.ndarray, path: str, most: int) -> tuple[list[int], list[int]]:
    """Token positions at which segments start, and the strength of the boundary before each; no segment exceeds most."""
    if text.isascii():
        at = lambda i: i
    else:
        codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        place = np.concatenate(([0], np.cumsum(1 + (codes > 0x7F) + (codes > 0x7FF) + (codes > 0xFFFF))))
        at = lambda i: place[i]
    spots, kinds = [], []
    for m in BOUNDARY.finditer(text):
        spots.append(m.end())
        kinds.append(STRENGTH[m.lastgroup])
    where = np.searchsorted(ends, at(np.array(spots, np.int64)), "left") + 1 if spots else np.array([], np.int64)
    strength: dict[int, int] = {0: HEADING}
    n = len(ids)
    for t, k in zip(where.tolist(), kinds):
        while t < n and not starts_char[t]:
            t += 1
        if t < n:
            strength[t] = max(k, strength.get(t, 0))
    blank = lengths(path)[1]
    starts = sorted(strength)
    for a, b in zip(starts, [*starts[1:], n]):
        while b - a > most:
            t = a + most
            words = np.flatnonzero(blank[ids[a + most // 2 : t + 1]] & starts_char[a + most // 2 : t + 1])
            if len(words):
                t, kind = a + most // 2 + int(words[-1]), WORD
            else:
                kind = ANYWHERE
                while t > a + 1 and not starts_char[t]:
                    t -= 1
            strength[t] = kind
            a = t
    starts = sorted(strength)
    return starts, [strength[s] for s in starts]


def merge(starts: list[int], strength: list[int], n: int, most: int) -> list[int]:
    """Starts of the segments that remain when neighbours are merged, the weakest boundary first (then the smallest result,
    then the first), as long as they hold at most `most` tokens together."""
    end = [*starts[1:], n]
    k = len(starts)
    after, before, alive = list(range(1, k + 1)), list(range(-1, k - 1)), [True] * k
    heap = [(strength[i + 1], end[i + 1] - starts[i], i, i + 1) for i in range(k - 1)]
    heapq.heapify(heap)
    while heap:
        s, size, i, j = heapq.heappop(heap)
        if not (alive[i] and alive[j] and after[i] == j and end[j] - starts[i] == size) or size > most:
            continue  # out of date, or too large: neither part will shrink
        end[i], after[i], alive[j] = end[j], after[j], False
        if after[i] < k:
            before[after[i]] = i
            heapq.heappush(heap, (strength[after[i]], end[after[i]] - starts[i], i, after[i]))
        if before[i] >= 0:
            heapq.heappush(heap, (strength[i], end[i] - starts[before[i]], before[i], i))
    return [starts[i] for i in range(k) if alive[i]]


def pieces(text: str, limit: int = 512, overlap: int = 64, path: str = tokens.VOCABULARY) -> list[tuple[int, int, int, int]]:
    """(from, own, to, tokens) of each piece, character positions: text[from:to] is the piece, of which text[from:own]
    repeats the end of the one before.

    The own parts follow one another and make up the text.  tokens is counted on the piece itself; where a cut raises the
    count of a piece above the limit, it repeats a little less, and if that isn't enough it is cut once more.  A single character may have up to four tokens, so
    limit - overlap must be 8 at least.
    """
    if overlap < 0 or limit - overlap < 8:
        raise ValueError(f"pieces of {limit} tokens can't overlap by {overlap}: 8 at least must be their own")
    ids = np.array(tokens.encode(text, path), np.int64)
    n = len(ids)
    if n <= limit:
        return [(0, 0, len(text), n)] if text else []
    ends = np.cumsum(lengths(path)[0][ids])
    raw = np.frombuffer(text.encode(), np.uint8)
    begin = np.concatenate(([0], ends))
    starts_char = np.append((raw[begin[:-1]] & 0xC0) != 0x80, True)
    most = limit - overlap
    cuts = [*merge(*atoms(text, ids, ends, starts_char, path, most), n, most), n]
    char_at = None if text.isascii() else np.cumsum((raw & 0xC0) != 0x80)

    def char(t: int) -> int:
        b = int(begin[t])
        return b if char_at is None else (int(char_at[b - 1]) if b else 0)

    blank, out, last = lengths(path)[1], [], 0
    parts = list(zip(cuts, cuts[1:]))[::-1]
    while parts:
        a, b = parts.pop()
        t = max(last, a - overlap) if a else 0
        for u in range(t, min(t + overlap // 4, a)):  # from a word's start if there is one near
            if blank[ids[u]] and starts_char[u]:
                t = u
                break
        while True:
            while t < a and not starts_char[t]:
                t += 1
            size = tokens.count(text[char(t) : char(b)], path)
            if size <= limit or t >= a:
                break
            t = min(a, t + size - limit)
        if size > limit:  # the own part by itself, whose tokens a cut has broken up
            half = (a + b) // 2
            while half > a + 1 and not starts_char[half]:
                half -= 1
            if starts_char[half] and half > a:
                parts += [(half, b), (a, half)]
                continue
        out.append((char(t), char(a), char(b), size))
        last = t
    return out


SPLIT = "doc_id long, piece int, pieces int, text string, tokens int, from_char long, own_char long, to_char long"


def split_documents(documents: DataFrame, limit: int = 512, overlap: int = 64, path: str = tokens.VOCABULARY, whole: bool = False) -> DataFrame:
    """doc_id, piece (from 0), pieces, text, tokens, from_char, own_char, to_char of the documents above limit tokens.

    Segments end at headings, paragraphs, lines and sentences; a segment that is too long by itself is cut at blanks, or
    where it has none, between characters.  Neighbours are merged, weakest boundary first, while they and the overlap fit.
    own_char is where the part that the piece before doesn't have begins.  whole: smaller documents come out too, as one
    piece.  Null and empty texts have no pieces; repeated rows are cut each; ids may be null.
    """
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
    names = [c.split()[0] for c in SPLIT.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, held = [], 0
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py()
                if len(text.encode()) <= limit and not whole:
                    continue  # a token has a byte at least
                got = pieces(text, limit, overlap, path)
                if len(got) > 1 or whole:
                    rows += [(doc, i, len(got), text[f:t], size, f, own, t) for i, (f, own, t, size) in enumerate(got)]
                    held += len(text)
                if held > 4_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], names=names)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], names=names)

    if overlap < 0 or limit - overlap < 8:
        raise ValueError(f"pieces of {limit} tokens can't overlap by {overlap}: 8 at least must be their own")
    rows = documents.where("text is not null and text <> ''").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return spread(rows).mapInArrow(run, SPLIT)
