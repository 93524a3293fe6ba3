"""Token counts with a public byte-level vocabulary; the vocabulary's path is a parameter."""

from __future__ import annotations

import base64
import functools
import re

import tiktoken

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the public pattern that splits text before the merges of this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Runs of at least so many blanks are encoded by themselves: the pattern's look-ahead would need the stack for each of them.
RUN = 2_000
BLANK = "[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


@functools.cache
def encoding(path: str = VOCABULARY) -> tiktoken.Encoding:
    """Read once per Python worker."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@functools.cache
def runs_of_blanks(least: int) -> re.Pattern:
    return re.compile(f"{BLANK}{{{least},}}")


def encode(text: str, path: str = VOCABULARY) -> list[int]:
    """Token ids of the whole text, of any length; strings of special tokens are ordinary text.

    A run of blanks is one piece of the pattern but for its last blank, which belongs to what follows; no piece reaches into
    a run from before it.  So a long run's piece goes to the merges directly and the text around it is encoded as ever.
    """
    enc = encoding(path)
    if len(text) < RUN:
        return enc.encode_ordinary(text)
    ids: list[int] = []
    at = 0
    for m in runs_of_blanks(RUN).finditer(text):
        ids += enc.encode_ordinary(text[at : m.start()])
        at = m.end() if m.end() == len(text) else m.end() - 1
        ids += enc._encode_single_piece(text[m.start() : at])
    return ids + enc.encode_ordinary(text[at:])


def count(text: str | None, path: str = VOCABULARY) -> int:
    return len(encode(text, path)) if text else 0
