"""Packing, leak search and splitting on documents."""

import re
import unicodedata
from collections import Counter, defaultdict
from random import Random

import pytest

from netloom.llm import leak, packing, splitting, tokens

DOCS = "doc_id long, text string, tokens long, item_id long, container string"


def docs(spark, texts):
    return spark.createDataFrame([(i, t, 7, 8, "x") for i, t in enumerate(texts)], DOCS)


def words_of(text):
    return re.findall(r"[^\W_]+", unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", re.sub(r"[­​⁠]", "", text)).casefold()))


def sample_texts(rng, n=60):
    lex = ["flow", "Zähler", "port", "採取率", "x", "rate_limit", "7", "straße", "exporter", "a"]
    out = []
    for _ in range(n):
        parts = []
        for _ in range(rng.randint(0, 60)):
            parts.append(rng.choice(lex) + rng.choice([" ", " ", ". ", "\n", "\n\n", "\r\n# ", "", "。"]))
        out.append("".join(parts))
    return out


def test_plan_fits_and_is_close_to_full():
    for capacity, seed in ((2048, 1), (100, 2), (7, 3), (1, 4)):
        rng = Random(seed)
        counts = Counter(min(capacity, 1 + int(rng.expovariate(6 / capacity))) for _ in range(5000))
        runs, opened = packing.plan(counts, capacity)
        room, seen, large = Counter(), defaultdict(list), Counter()
        for size, rank, first, n in runs:
            seen[size] += range(rank, rank + n)
            for c in range(first, first + n):
                room[c] += size
                large[c] += 3 * size > capacity
        assert max(room.values()) <= capacity and set(room) == set(range(opened)) and max(large.values()) <= 3 - (capacity > 3)
        assert all(sorted(seen[s]) == list(range(n)) for s, n in counts.items())
        assert opened <= 1.02 * -(-sum(s * n for s, n in counts.items()) // capacity) + 1
    assert packing.plan({}, 10) == ([], 0)


def test_containers(spark):
    rng = Random(1)
    texts = sample_texts(rng) + ["word " * 500, "word " * 100, None, "", "same text here"] + ["same text here"] * 40
    out = packing.containers(docs(spark, texts), 100).collect()
    by, room = defaultdict(list), Counter()
    for r in out:
        by[r.doc_id].append(r)
        room[r.container] += r.tokens
    assert max(room.values()) <= 100 and len({(r.doc_id, r.piece) for r in out}) == len(out)
    for i, text in enumerate(texts):
        n = tokens.count(text)
        own = sorted(by[i], key=lambda r: r.piece)
        assert sum(r.tokens for r in own) == n and [r.from_token for r in own] == list(range(0, max(n, 1), 100))
        assert len(own) == max(1, -(-n // 100))
    assert packing.containers(docs(spark, []), 100).count() == 0
    assert {r.container for r in packing.containers(docs(spark, ["", None]), 100).collect()} == {0}


def test_leaks_against_word_windows(spark):
    rng = Random(7)
    lex = [f"w{k}" for k in range(60)] + ["ein", "a", "8", "Straße", "ﬁne", "採取率"]
    passages = [" ".join(rng.choice(lex) for _ in range(rng.randint(5, 60))) for _ in range(25)]
    passages[3] = passages[2][: len(passages[2]) // 2] + " " + passages[3]
    texts = []
    for k in range(160):
        body = [rng.choice(lex) for _ in range(rng.randint(0, 80))]
        if k % 2:
            p = rng.choice(passages).split()
            n = rng.choice([6, 7, 8, 9, 30])
            at = rng.randint(0, max(0, len(p) - n))
            part = p[at : at + n]
            form = rng.choice([lambda w: w.upper(), lambda w: w[:1] + "­" + w[1:], lambda w: w + rng.choice([",", "_", " |\n>"]), lambda w: f"<b>{w}</b> ", lambda w: "".join(chr(ord(c) + 0xFEE0) if c.isascii() else c for c in w)])
            body[5:5] = [form(w) for w in part]
        texts.append(" ".join(body))
    texts += [None, "", "x" * 3000]
    items = spark.createDataFrame([(i, p, 1, "z") for i, p in enumerate(passages)] + [(90, None, 1, "z"), (91, "", 1, "z"), (92, "too short", 1, "z")], "item_id long, passage string, doc_id long, text string")
    windows = defaultdict(set)
    for i, p in enumerate(passages):
        w = words_of(p)
        for k in range(len(w) - 7):
            windows[tuple(w[k : k + 8])].add(i)
    want = set()
    for d, t in enumerate(texts):
        for tag in (" ", ""):
            w = words_of(re.sub(r"</?[A-Za-z][^<>]*>", tag, t or ""))
            for k in range(len(w) - 7):
                want |= {(d, i) for i in windows.get(tuple(w[k : k + 8]), ())}
    got = {tuple(r) for r in leak.shared_words(docs(spark, texts), items).collect()}
    assert got == want and len(want) > 30
    assert leak.shared_words(docs(spark, []), items).count() == 0
    assert leak.shared_words(docs(spark, texts), items.limit(0)).count() == 0


def test_stretches_parted_by_an_equally_long_word(spark):
    passage = "unmistakable correspondents everywhere acknowledged extraordinarily complicated 20 a b c d e f g h i j k l m n o p q r"
    texts = [passage.replace("20", "35"), passage.replace("20 a", "20 z"), passage.replace(" h ", " 7 ")]
    items = spark.createDataFrame([(0, passage)], "item_id long, passage string")
    assert {tuple(r) for r in leak.shared_words(docs(spark, texts), items).collect()} == {(0, 0), (1, 0), (2, 0)}
    # The next document may begin where the diagonal of this one's end goes on.
    head, tail = passage.split(" 20 ")
    items = spark.createDataFrame([(0, f"{head} 2 {tail}")], "item_id long, passage string")
    got = leak.shared_words(docs(spark, [head, tail]).coalesce(1), items).collect()
    assert {tuple(r) for r in got} == {(1, 0)}


def test_many_blocks_and_long_documents(spark, monkeypatch):
    rng = Random(8)
    passages = [" ".join(f"p{k}x{rng.randint(0, 9999)}" for _ in range(40)) for k in range(9)]
    long = " ".join(f"n{k}" for k in range(2000))
    texts = [f"{long} {passages[k]} {long}" for k in range(9)]
    items = spark.createDataFrame(list(enumerate(passages)), "item_id long, passage string")
    monkeypatch.setattr(leak, "BLOCK_CHARS", 700)
    ((index, _),) = leak.Index.of(list(enumerate(passages)), 8)
    assert {tuple(r) for r in leak.shared_words(docs(spark, texts), items).collect()} == {(k, k) for k in range(9)}
    monkeypatch.setattr(leak, "STRETCH", 3000)
    text = " ".join(texts)
    parts = list(leak.stretches(leak.plain(text), max(map(len, index.texts))))
    assert len(parts) > 5 and all(any(leak.plain(p).strip() in part for part in parts) for p in passages)


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[j - 1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def test_banded_alignment():
    rng = Random(9)
    for _ in range(400):
        a = "".join(rng.choice("abc") for _ in range(rng.randint(0, 25)))
        b = list(a)
        for _ in range(rng.randint(0, 5)):
            k = rng.randint(0, len(b))
            b[k : k + rng.randint(0, 1)] = rng.choice(["", "a", "c"])
        b = "".join(b)
        d = edit_distance(a, b)
        assert leak.alignment(a, b, 4) == (d if d <= 4 else None)


def test_altered_passages_are_found(spark):
    rng = Random(10)
    passages = [" ".join(f"{rng.choice(['ledger', 'token', 'clerk', 'depot'])}{rng.randint(0, 99999)}" for _ in range(40)) for _ in range(12)]
    texts = []
    for p in passages:
        t = list(p)
        for k in range(60, len(t), 110):  # an edit in every 110 characters
            t[k] = rng.choice(["", "q", t[k] + "z"])
        texts.append("before it " + "".join(t) + " after it")
    items = spark.createDataFrame(list(enumerate(passages)), "item_id long, passage string")
    got = {(r.doc_id, r.item_id): r for r in leak.altered_passages(docs(spark, texts + ["nothing of the kind"]), items).collect()}
    assert set(got) == {(k, k) for k in range(12)}
    assert all(r.chars >= 80 and 0 < r.edits <= 15 for r in got.values())


def test_alike_parts_of_a_region_that_is_not_alike_as_a_whole(spark):
    rng = Random(11)
    other = lambda n: "".join(rng.choice("vwxyz") for _ in range(n))
    passage = "".join(rng.choice("abcdefghijklm nop") for _ in range(260)).strip()
    p = " ".join(passage.split())
    texts = [
        f"{other(30)}{p[:80]}{other(60)}{p[140:220]}{other(30)}", f"{p[:50]}{other(1)}{p[51:90]}{other(50)}{p[140:240]}",
        f"{p[:60]}{other(60)}{p[120:180]}{other(30)}", p[:100], p[101:220],
    ]
    items = spark.createDataFrame([(0, passage)], "item_id long, passage string")
    got = {r.doc_id: (r.chars, r.edits) for r in leak.altered_passages(docs(spark, texts).coalesce(1), items).collect()}
    assert set(got) == {0, 1, 3, 4} and all(chars >= 80 and edits <= 3 for chars, edits in got.values()) and got[0][1] == 0


def test_recall_at_the_bound(spark):
    """Three edits in every 80 characters, of four kinds: every passage is found in its copy, and no other."""
    rng = Random(14)
    lex = ["ledger", "token", "clerk", "depot", "a", "in", "rate", "counter", "sample"]
    passages = [" ".join(f"{rng.choice(lex)}{rng.choice(['', rng.randint(0, 9999)])}" for _ in range(60)) for _ in range(40)]
    noise = lambda n: " ".join(f"n{rng.randint(0, 10**6)}" for _ in range(n))

    def altered(t, spots):
        t = list(t)
        for k in spots:
            t[k] = rng.choice(["", "q", t[k] + "z", "7"])
        return "".join(t)

    def spots(a, b):  # three in each 80 characters, the last of them too
        return [k for at in range(a, b - 79, 80) for k in sorted(rng.sample(range(at + 2, at + 78), 3))]

    kinds = [
        lambda p: altered(p[:80], spots(0, 80)), lambda p: altered(p, spots(0, len(p))),
        lambda p: p[:90] + altered(p[90:170], rng.sample(range(80), 30)) + p[170:260], lambda p: p[:30] + altered(p[30:110], spots(0, 80)),
    ]
    texts = [f"{noise(20)} {kinds[i % 4](p)} {noise(20)}" for i, p in enumerate(passages)]
    items = spark.createDataFrame(list(enumerate(passages)), "item_id long, passage string")
    got = {(r.doc_id, r.item_id) for r in leak.altered_passages(docs(spark, texts), items).collect()}
    assert got == {(k, k) for k in range(len(passages))}


def test_short_runs_are_searched_without_edits(spark):
    passages = ["a b c d e f g h i j", "some longer words that leave room for one edit here"]
    indexes = leak.Index.of(list(enumerate(passages)), 8, 1)
    assert [(index.ids, e) for index, e in indexes] == [([1], 1), ([0], 0)]
    items = spark.createDataFrame(list(enumerate(passages)), "item_id long, passage string")
    texts = ["x A B, C D E F G H y", "a b c d x e f g h i", passages[1][5:48], passages[1].replace("leave", "leavo")]
    got = {(r.doc_id, r.item_id) for r in leak.shared_words(docs(spark, texts), items).collect()}
    assert got == {(0, 0), (2, 1)}
    found = {(r.doc_id, r.item_id, r.words, r.edits) for r in leak.leaks(docs(spark, texts), items).collect()}
    assert any(f[:2] == (3, 1) and f[3] == 1 and f[2] < 8 for f in found)  # alike within an edit, but too few words in a row


def check_pieces(text, limit, overlap):
    got = splitting.pieces(text, limit, overlap)
    assert all(tokens.count(text[f:t]) == n <= limit for f, _, t, n in got)
    assert "".join(text[own:t] for _, own, t, _ in got) == text
    assert got[0][0] == 0 and all(f <= own for f, own, _, _ in got)
    for (f0, _, t0, _), (f, own, _, _) in zip(got, got[1:]):
        assert own == t0 and f0 <= f
    return got


@pytest.mark.parametrize("seed", range(4))
def test_pieces_make_up_the_text(seed):
    rng = Random(seed)
    for text in sample_texts(rng, 12):
        check_pieces(text * rng.randint(1, 8), rng.choice([40, 64]), rng.choice([0, 8, 16]))


def test_hard_texts():
    for text in ("a" * 5000, "採" * 3000, "\n" * 3000, " " * 4000, "🙂" * 1500, "word " * 3000, "<p>x</p>" * 900, "é" * 2000, "\r\n\r\n# T\r\n" * 700):
        got = check_pieces(text, 512, 64)
        if text == "word " * 3000:
            sizes = [tokens.count(text[f:own]) for f, own, _, _ in got[1:]]
            assert min(sizes) >= 40 and max(sizes) <= 66


def test_cuts_prefer_strong_boundaries():
    section = "\n\n".join("One sentence here. Another one there. A third follows." for _ in range(4))
    text = "\n\n".join(f"# Part {k}\n\n{section}" for k in range(12))
    cuts = [own for _, own, _, _ in check_pieces(text, 110, 10)][1:]
    assert cuts and all(text[own:].startswith("# Part") for own in cuts)


def test_split_documents(spark):
    texts = ["short", None, "", "long text. " * 400, "long text. " * 400]
    rows = splitting.split_documents(docs(spark, texts)).collect()
    assert {r.doc_id for r in rows} == {3, 4} and all(r.tokens <= 512 and r.pieces > 1 for r in rows)
    assert all(texts[r.doc_id][r.from_char : r.to_char] == r.text for r in rows)
    assert {r.doc_id for r in splitting.split_documents(docs(spark, texts), whole=True).collect()} == {0, 3, 4}
    assert splitting.split_documents(docs(spark, [])).count() == 0


def test_ids_are_those_of_the_whole_text(monkeypatch):
    whole = tokens.encoding().encode_ordinary
    rng = Random(12)
    for alphabet in ("abcdefghij", "ab,\n\r", "採取率流量", "0123456789'", "a b' \n.,s"):
        text = "".join(rng.choice(alphabet) for _ in range(300_000))
        assert tokens.encode(text) == whole(text)
    monkeypatch.setattr(tokens, "RUN", 3)
    blanks = [" ", "\n", "\t", "\r\n", "\x85", "\xa0", "\u3000", "\x1c", "  ", "   ", "\n\n\n"]
    for _ in range(400):
        text = "".join(rng.choice([*blanks, *blanks, "a", "'s", "!", "7", "é"]) for _ in range(rng.randint(0, 40)))
        assert tokens.encode(text) == whole(text), repr(text)
    monkeypatch.undo()
    assert tokens.count(" " * 3_000_000 + "x") > 0 and tokens.count("x" + "\n" * 500_000) > 0
    long = "x" + " " * 5_000 + "y z"
    assert tokens.encode(long) == whole(long)


def test_pieces_without_overlap_and_bad_limits():
    rng = Random(13)
    for text in ["".join(rng.choice("🙂é採a ") for _ in range(900)) for _ in range(20)]:
        check_pieces(text, 9, 0)
    with pytest.raises(ValueError):
        splitting.pieces("word " * 100, 64, 60)
