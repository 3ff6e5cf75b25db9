"""Pre-tokens of byte-level BPE vocabularies, and a bounded cache over the chunks of texts.

A chunk starts at each space before a non-space (and at the text's start). The pre-token pattern of these
vocabularies ends a match before every such space, whatever stands around it, so the tokens of a text are the
tokens of its chunks in order. Chunks repeat, so each distinct one is encoded once and then looked up.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from functools import lru_cache

import regex

#: Distinct chunks that a worker keeps; beyond it the cache starts anew.
CACHE_CHUNKS = 400_000

_odd_space = re.compile(r" (?:\s|\Z)").search
_boundaries = re.compile(r"(?= \S)").split


def chunks(text: str) -> list[str]:
    """The text's first chunk, then the others without their leading space."""
    if _odd_space(text) is None:
        return text.split(" ")
    first, *rest = _boundaries(text)
    return [first, *(c[1:] for c in rest)]


class _Numbers(dict):
    """Chunk -> number; an unknown chunk gets the next number and is put on the list of new ones."""

    def __init__(self, coder: ChunkCoder, lead: str):
        super().__init__()
        self.coder, self.lead = coder, lead

    def __missing__(self, chunk: str) -> int:
        new = self.coder.new
        number = self[chunk] = len(self.coder.known) + len(new)
        new.append(self.lead + chunk)
        return number


class ChunkCoder:
    """Values of the chunks of texts; ``encode_many`` gives the values of a list of chunks. Each chunk is looked up once."""

    def __init__(self, encode_many: Callable[[list[str]], list], limit: int = CACHE_CHUNKS):
        self.encode_many, self.limit = encode_many, limit
        self.known: list = []
        self.new: list[str] = []
        self.first, self.rest = _Numbers(self, ""), _Numbers(self, " ")

    def values(self, texts: list[str]) -> list[list]:
        if len(self.known) > self.limit:
            for kept in (self.known, self.first, self.rest):
                kept.clear()
        first, rest = self.first, self.rest.__getitem__
        try:
            numbers = [[first[c[0]], *map(rest, c[1:])] for c in map(chunks, texts)]
            if self.new:
                self.known += self.encode_many(self.new)
        except BaseException:
            self.known, self.first, self.rest = [], _Numbers(self, ""), _Numbers(self, " ")
            raise
        finally:
            self.new = []
        value = self.known.__getitem__
        return [[*map(value, n)] for n in numbers]


def byte_chars() -> list[str]:
    """The printable character that stands for each byte: itself if printable Latin-1, else the next from U+0100 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    table, free = [], 0x100
    for b in range(256):
        if b in own:
            table.append(chr(b))
        else:
            table.append(chr(free))
            free += 1
    return table


@lru_cache(maxsize=4)
def splitter(pattern: str) -> Callable[[str], list[str]]:
    """A function from a text to its matches of ``pattern``, with letters and numbers as the libraries' older Unicode tables have them.

    Latin-1 texts hold no code point on which the tables differ and take the plain pattern.
    """
    plain = regex.compile(pattern).findall

    @lru_cache(maxsize=1)
    def exact():
        late = _late_ranges()
        if not late:
            return plain
        return regex.compile(
            pattern.replace(r"[^\s\p{L}\p{N}]", rf"(?:[^\s\p{{L}}\p{{N}}]|[{late}])").replace(r"\p{L}+", rf"(?:(?![{late}])\p{{L}})+").replace(r"\p{N}+", rf"(?:(?![{late}])\p{{N}})+")
        ).findall

    def split(text: str) -> list[str]:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return exact()(text)
        return plain(text)

    return split


def _late_ranges() -> str:
    """Regex class body of the code points that are letters or numbers to ``regex`` but neither to the byte-level pre-tokenizer.

    Only code points that the interpreter's tables lack can differ; each is shown to the pre-tokenizer once.
    """
    from tokenizers import pre_tokenizers

    split = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str
    known = regex.compile(r"[\p{L}\p{N}]").match
    spans: list[list[int]] = []
    for c in range(0x80, 0x110000):
        ch = chr(c)
        if not 0xD800 <= c <= 0xDFFF and unicodedata.category(ch) == "Cn" and known(ch) and len(split(f"a{ch}")) > 1 and len(split(f"1{ch}")) > 1:
            if spans and spans[-1][1] == c - 1:
                spans[-1][1] = c
            else:
                spans.append([c, c])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in spans)
