"""Held-out passages inside a corpus, found by counting shared q-grams along diagonals."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from netloom.core.arrow import spread

INVISIBLE = re.compile(r"[\u00ad\u034f\u061c\u180e\u200b-\u200f\u202a-\u202e\u2060-\u2064\u2066-\u206f\ufeff]")
TAG = re.compile(r"<!--.*?-->|</?[A-Za-z][^<>]*>", re.S)
NO_WORD = re.compile(r"[\W_]+")
ASCII = str.maketrans({chr(c): " " for c in range(128) if not chr(c).isalnum()})
Q = 8
MULTIPLIER, SPREAD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
#: Flags per q-gram of an index, about, so that one in so many foreign q-grams passes.
FLAGS_A_GRAM = 8
#: Characters looked at in one go, and characters of passages in one block of items.
STRETCH, BLOCK_CHARS = 1_000_000, 2_000_000


def plain(text: str, tag: str = " ") -> str:
    """Words in their compared form, a blank before, between and after: no invisible characters, tags replaced by tag,
    compatibility form, case folded; a word is a run of letters and digits."""
    if "<" in text:
        text = TAG.sub(tag, INVISIBLE.sub("", text))
    if text.isascii():
        words = text.translate(ASCII).lower().split()
    else:
        text = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", INVISIBLE.sub("", text)).casefold())
        words = NO_WORD.sub(" ", text).split()
    return f" {' '.join(words)} "


def forms(text: str) -> list[str]:
    """A tag may stand inside a word or between two: both readings where they differ."""
    spaced = plain(text)
    if "<" not in text:
        return [spaced]
    joined = plain(text, "")
    return [spaced] if joined == spaced else [spaced, joined]


def grams(codes: np.ndarray) -> np.ndarray:
    """Hashes of all q-grams of Q code points."""
    h, step, m = codes.astype(np.uint64) + np.uint64(1), 1, MULTIPLIER
    with np.errstate(over="ignore"):
        while step < Q:
            h = h[:-step] * m + h[step:] if len(h) > step else h[:0]
            m, step = m * m, step * 2
        return h * SPREAD


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def run_of(text: str, words: int) -> int:
    """Characters of the shortest run of `words` words of a plain text, the blanks about it included."""
    blanks = np.flatnonzero(codes_of(text) == 32)
    return int((blanks[words:] - blanks[:-words]).min()) + 1


@dataclass
class Index:
    """q-grams of a block of passages: sorted hashes with where they occur, and a flag table to pass over the rest."""

    ids: list[int]
    texts: list[str]
    hashes: np.ndarray
    item: np.ndarray
    at: np.ndarray
    flags: np.ndarray
    sizes: np.ndarray  # of each text: characters of a window

    @property
    def shift(self) -> np.uint64:
        return np.uint64(64 - (len(self.flags).bit_length() - 1))

    @staticmethod
    def of(items: list[tuple[int, str]], words: int, edits: int = 0, window: int | None = None) -> list[tuple[Index, int]]:
        """Indexes of the items and the edits each is searched with: `edits` where a window (or else the item's shortest run of
        `words` words) is long enough to keep Q q-grams of its own however many are altered, none for the other items."""
        rows = [(i, form) for i, text in items for form in forms(text) if form.count(" ") > words]
        least = [window or run_of(text, words) for _, text in rows]
        enough = Q * edits + 2 * Q - 1
        sides = [([(*r, n) for r, n in zip(rows, least) if n >= enough], edits), ([(*r, n) for r, n in zip(rows, least) if n < enough], 0)]
        return [(Index._of(part), e) for part, e in sides if part]

    @staticmethod
    def _of(rows: list[tuple[int, str, int]]) -> Index:
        hashes, item, at = [], [], []
        for k, (_, text, _) in enumerate(rows):
            h = grams(codes_of(text))
            hashes.append(h)
            item.append(np.full(len(h), k, np.int32))
            at.append(np.arange(len(h), dtype=np.int32))
        h, it, a = map(np.concatenate, (hashes, item, at))
        order = np.argsort(h, kind="stable")
        bits = max(16, (FLAGS_A_GRAM * len(h)).bit_length())
        flags = np.zeros(1 << bits, bool)
        flags[h >> np.uint64(64 - bits)] = True
        return Index([r[0] for r in rows], [r[1] for r in rows], h[order], it[order], a[order], flags, np.array([r[2] for r in rows], np.int64))


def regions(index: Index, h: np.ndarray, edits: int) -> list[tuple[int, int, int, int, int]]:
    """(item, doc from, doc to, item from, item to) of the stretches that may hold a window of an item with at most edits
    differences; h: the q-grams of the text.

    A stretch of window characters with e differences shares at least window - Q + 1 - Q * e q-grams with the item, on
    diagonals no more than e apart.  First the q-grams of any item are counted in windows of the text; what reaches the
    bound of the smallest window (a larger one misses no more of its positions, so its parts reach it too) is looked up and
    counted again, by the item's own bound, in overlapping bands of 2 * edits + 1 diagonals, laid out twice, so that every
    set of diagonals at most edits apart lies inside one band.  Without edits a stretch ends where its q-grams do.
    """
    needs, spans = index.sizes - Q + 1 - Q * edits, index.sizes - Q + 1 + edits
    need, span = int(needs.min()), int(spans.min())
    if len(h) < need:
        return []
    hit = index.flags[h >> index.shift]
    where = np.flatnonzero(hit)
    if len(where) < need:
        return []
    where = where[_crowded(where, need, span)]
    lo = np.searchsorted(index.hashes, h[where], "left")
    hi = np.searchsorted(index.hashes, h[where], "right")
    real = hi > lo
    where, lo, hi = where[real], lo[real], hi[real]
    if len(where) < need:
        return []
    close = _crowded(where, need, span)
    where, lo, hi = where[close], lo[close], hi[close]
    n = hi - lo
    if not n.sum():
        return []
    post = np.repeat(lo - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
    doc, item, at = np.repeat(where, n), index.item[post], index.at[post]
    diagonal = doc.astype(np.int64) - at
    diagonal -= diagonal.min()
    width = 2 * edits + 1
    bands = int(diagonal.max()) // width + 2
    found = set()
    for shift in range(0, width, edits + 1) if edits else (0,):
        # One number for item and band; the order of the text stays within it.
        key = item * np.int64(bands) + ((diagonal + shift) // width if edits else diagonal)
        # Most bands hold too few q-grams whatever their place; a count by hash passes them over.
        slot = (key.astype(np.uint64) * SPREAD) >> np.uint64(44)
        alive = np.flatnonzero(np.bincount(slot, minlength=1 << 20)[slot] >= needs[item])
        order = alive[np.argsort(key[alive], kind="stable")]
        if len(order) < need:
            continue
        key, key_item, d, a = key[order], item[order], doc[order], at[order]
        new = np.ones(len(d), bool)
        new[1:] = key[1:] != key[:-1]
        # Hits i .. i + need - 1 in one band and within span positions, by the item's need and span.
        group = np.cumsum(new)
        n, far = needs[key_item], spans[key_item]
        last = np.arange(len(d)) + n - 1
        can = last < len(d)
        last[~can] = 0
        first = np.flatnonzero(can & (group[last] == group) & (d[last] - d < far))
        if not len(first):
            continue
        ok = np.zeros(len(d) + 1, np.int32)
        np.add.at(ok, first, 1)
        np.add.at(ok, first + n[first], -1)
        inside = np.cumsum(ok[:-1]) > 0
        index_in = np.flatnonzero(inside)
        cuts = np.flatnonzero((np.diff(index_in) > 1) | (np.diff(group[index_in]) > 0) | (np.diff(d[index_in]) > (far[index_in][1:] if edits else 1))) + 1
        for part in np.split(index_in, cuts):
            x, y = part[0], part[-1]
            found.add((int(key_item[x]), int(d[x]), int(d[y]) + Q, int(a[part].min()), int(a[part].max()) + Q))
    return sorted(found)


def _crowded(at: np.ndarray, need: int, span: int) -> np.ndarray:
    """Which of the rising positions lie in some window of span positions with at least need of them."""
    if len(at) < need:
        return np.zeros(len(at), bool)
    starts = np.flatnonzero(at[need - 1 :] - at[: len(at) - need + 1] < span)
    mark = np.zeros(len(at) + 1, np.int64)
    np.add.at(mark, starts, 1)
    np.add.at(mark, starts + need, -1)
    return np.cumsum(mark[:-1]) > 0


def same_length(a: str, i: int, b: str, j: int) -> int:
    """Length of the longest common prefix of a[i:] and b[j:]."""
    most, n, step = min(len(a) - i, len(b) - j), 0, 32
    while n < most:
        step = min(step, most - n)
        if a[i + n : i + n + step] == b[j + n : j + n + step]:
            n, step = n + step, step * 2
        elif step == 1:
            break
        else:
            step //= 2
    return n


def alignment(a: str, b: str, most: int) -> int | None:
    """Edit distance of a and b if at most `most`: furthest points per diagonal in a band of `most` either way."""
    if abs(len(a) - len(b)) > most:
        return None
    goal = len(b) - len(a)
    far = {0: same_length(a, 0, b, 0)}
    for e in range(most + 1):
        if far.get(goal, -1) >= len(a):
            return e
        grown: dict[int, int] = {}
        for d in range(-e - 1, e + 2):
            i = max(far.get(d, -9) + 1, far.get(d - 1, -9), far.get(d + 1, -9) + 1)
            i = min(i, len(a))
            if i >= 0 and 0 <= i + d <= len(b):
                grown[d] = i + same_length(a, i, b, i + d)
        far = grown
    return None


def reaches(a: str, b: str, most: int) -> tuple[list[int], list[int]]:
    """Per number of edits up to `most`: the longest prefix of a alike to a prefix of b, and the longest that ends with Q equal
    characters (or is equal throughout)."""
    far = {0: same_length(a, 0, b, 0)}
    free, firm = [far[0]], [far[0]]
    for e in range(1, most + 1):
        grown: dict[int, int] = {}
        end = firm[-1]
        for d in range(-e, e + 1):
            i = max(far.get(d, -9) + 1, far.get(d - 1, -9), far.get(d + 1, -9) + 1)
            i = min(i, len(a), len(b) - d)
            if i >= 0 and i + d >= 0:
                n = same_length(a, i, b, i + d)
                grown[d] = i + n
                end = i + n if n >= Q and i + n > end else end
        far = grown
        free.append(max(free[-1], *far.values()))
        firm.append(end)
    return free, firm


def alike_parts(text: str, a: int, b: int, lo: int, hi: int, item: str, c: int, d: int, size: int, edits: int) -> set[tuple[int, int, int]]:
    """(words, chars, edits) of the parts of text[a:b] and item[c:d] that hold `size` characters of the item with at most edits
    differences, each grown as far as edits per size characters allow, inside text[lo:hi].

    Of `size` characters with e differences at least (size - e) / (e + 1) are equal in a row; so every such part is found by
    growing both ways from the equal stretches of that length, which lie at most 2 * edits diagonals from that of (a, c).
    """
    least = max(1, -(-(size - edits) // (edits + 1)))
    most = edits * -(-(d - c) // size)
    t, p = codes_of(text[a:b]), codes_of(item)
    parts = set()
    for diagonal in range(a - c - 2 * edits, a - c + 2 * edits + 1):
        x0, x1 = max(a, diagonal), min(b, diagonal + len(p))
        if x1 - x0 < least:
            continue
        same = np.concatenate(([False], t[x0 - a : x1 - a] == p[x0 - diagonal : x1 - diagonal], [False]))
        turns = np.flatnonzero(same[1:] != same[:-1])
        for x, y in zip(turns[::2], turns[1::2]):
            if y - x < least:
                continue
            x, y = int(x) + x0, int(y) + x0
            if not lo <= x < hi:
                continue
            left = item[: x - diagonal][::-1], text[max(lo, x - len(item) - most) : x][::-1]
            right = item[y - diagonal :], text[y : min(hi, y + len(item) + most)]
            before, after = reaches(*left, edits)[0], reaches(*right, edits)[0]
            e = next((e for e in range(edits + 1) if max(before[k] + after[e - k] for k in range(e + 1)) + y - x >= size), None)
            if e is None:
                continue
            before, after = reaches(*left, most)[1], reaches(*right, most)[1]
            grown = [(before[k] + y - x + after[n], -k - n) for k in range(most + 1) for n in range(most + 1 - k)]
            chars, minus = max([(size, -e)] + [g for g in grown if g[0] >= size and -g[1] <= edits * -(-g[0] // size)])
            parts.add((max(0, item.count(" ", x - diagonal, y - diagonal) - 1), chars, -minus))
    return parts


def words_near(text: str, a: int, b: int, item: str, c: int, off: int) -> int:
    """Most consecutive whole words that text[a:b] has in common with the item on the diagonals at most off from that of (a, c)."""
    t, p, best = codes_of(text[a:b]), codes_of(item), 0
    for diagonal in range(a - c - off, a - c + off + 1):
        x0, x1 = max(a, diagonal), min(b, diagonal + len(p))
        if x1 <= x0:
            continue
        same = np.concatenate(([False], t[x0 - a : x1 - a] == p[x0 - diagonal : x1 - diagonal], [False]))
        turns = np.flatnonzero(same[1:] != same[:-1])
        long = turns[1::2] - turns[::2] >= Q
        for x, y in zip(turns[::2][long].tolist(), turns[1::2][long].tolist()):
            best = max(best, item.count(" ", x + x0 - diagonal, y + x0 - diagonal) - 1)
    return best


def exact_words(text: str, at: int, item: str, start: int, length: int) -> int:
    """Most consecutive whole words in a common stretch through text[at:] and item[start:]; blanks enclose every word."""
    best, i = 0, 0
    while i < length:
        if text[at + i] != item[start + i]:
            i += 1
            continue
        n = same_length(text, at + i, item, start + i)
        best = max(best, item.count(" ", start + i, start + i + n) - 1)
        i += n + 1
    return best


def stretches(text: str, longest: int) -> Iterator[str]:
    """The text, or if it is very long, parts that overlap by more than any passage."""
    if len(text) <= 2 * STRETCH:
        yield text
        return
    overlap = 2 * longest + Q
    for a in range(0, len(text), STRETCH):
        yield text[a : a + STRETCH + overlap]


def search(indexes: list[tuple[Index, int]]):
    """mapInArrow function: doc_id, item_id, words, chars, edits of every verified region."""
    longest = max(len(t) for index, _ in indexes for t in index.texts)
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("words", pa.int32()), ("chars", pa.int32()), ("edits", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[int, int, int, int, int]] = []
            pack: list[tuple[int, str]] = []
            held = 0
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py()
                if not text:
                    continue
                for form in forms(text):
                    for part in stretches(form, longest):
                        pack.append((doc, part))
                        held += len(part)
                        if held >= STRETCH:
                            out += scan(pack)
                            pack, held = [], 0
            out += scan(pack)
            cols = zip(*out) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(cols, schema)], schema=schema)

    def scan(pack: list[tuple[int, str]]) -> list[tuple[int, int, int, int, int]]:
        if not pack:
            return []
        # A line feed is in no plain form, so no q-gram of an item spans two texts.
        text = "\n".join(p for _, p in pack)
        ends = np.cumsum([len(p) + 1 for _, p in pack])
        h = grams(codes_of(text))
        got = []
        for index, edits in indexes:
            for region in regions(index, h, edits):
                got += verified(index, edits, pack, text, ends, *region)
        return got

    def verified(index: Index, edits: int, pack: list[tuple[int, str]], text: str, ends: np.ndarray, item: int, a: int, b: int, c: int, d: int) -> list[tuple[int, int, int, int, int]]:
        first, last = (int(k) for k in np.searchsorted(ends, (a, b - 1), "right"))
        doc, name, whole, size = pack[first][0], index.ids[item], index.texts[item], int(index.sizes[item])
        if edits == 0:
            n = same_length(text, a, whole, c)
            return [(doc, name, exact_words(text, a, whole, c, min(n, b - a)), n, 0)]
        budget = edits * -(-(d - c) // size)
        off = alignment(whole[c:d], text[a:b], budget) if first == last else None
        if off is not None and d - c >= size:
            return [(doc, name, words_near(text, a, b, whole, c, 2 * edits), d - c, off)]
        # Too much lies between the alike parts, or they are in two texts, or edits lie at their ends: each is held against the
        # item by itself.
        out = []
        for k in range(first, last + 1):
            hi = int(ends[k]) - 1
            out += [(pack[k][0], name, *part) for part in alike_parts(text, a, b, hi - len(pack[k][1]), hi, whole, c, d, size, edits)]
        return out

    return run


FOUND = "doc_id long, item_id long, words int, chars int, edits int"


def leaks(documents: DataFrame, items: DataFrame, words: int = 8, edits: int = 1, window: int | None = None) -> DataFrame:
    """doc_id, item_id, words, chars, edits: regions of documents in which at least window characters of a passage occur with at
    most edits differences each window, verified by banded alignment; what isn't alike as a whole is verified part by part.
    words: the most consecutive words of the item that such a region holds unaltered.

    window None: of each passage its shortest run of `words` words.  Every unaltered run of that many words then lies in a
    region, whatever edits is.  A passage whose runs are too short for a q-gram to outlast the edits is searched without
    edits (see Index.of): each region is a stretch that is equal throughout.

    Items are read by the driver in blocks of bounded size, each block a broadcast index that all documents are held
    against; so the passages may outgrow a broadcast, at the price of another pass for every two million characters.  Each
    document is searched by one task, whole, in stretches that overlap by more than a passage.  Null and empty texts, null
    ids and passages of fewer than `words` words match nothing; repeated documents are reported each; other columns don't
    matter.
    """
    spark = documents.sparkSession
    rows = spread(documents.where("doc_id is not null and text is not null and text <> ''").select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    out = spark.createDataFrame([], FOUND)
    block: list[tuple[int, str]] = []
    held = 0

    def found() -> DataFrame:
        indexes = Index.of(block, words, edits, window)
        if not indexes:
            return out
        shared = spark.sparkContext.broadcast(indexes)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield from search(shared.value)(batches)

        return out.unionByName(rows.mapInArrow(run, FOUND))

    passages = items.where("item_id is not null and passage is not null").select(F.col("item_id").cast("long"), "passage")
    for r in passages.toLocalIterator():
        block.append((r[0], r[1]))
        held += len(r[1])
        if held >= BLOCK_CHARS:
            out, block, held = found(), [], 0
    return found() if block else out


def shared_words(documents: DataFrame, items: DataFrame, words: int = 8) -> DataFrame:
    """doc_id, item_id of documents with at least `words` consecutive words of an item's passage, one row each: the regions
    alike within one edit, then an exact check of their words."""
    return leaks(documents, items, words).where(F.col("words") >= words).select("doc_id", "item_id").distinct()


def altered_passages(documents: DataFrame, items: DataFrame, window: int = 80, edits: int = 3) -> DataFrame:
    """doc_id, item_id, chars, edits: of each document and item, the longest region alike within edits per window characters."""
    best = leaks(documents, items, 8, edits, window).groupBy("doc_id", "item_id").agg(F.max(F.struct("chars", (-F.col("edits")).alias("e"))).alias("b"))
    return best.select("doc_id", "item_id", F.col("b.chars").alias("chars"), (-F.col("b.e")).alias("edits"))
