"""Encoding of whole texts out of encodings of their space-separated chunks.

A byte-level tokenizer splits a text into words before it merges. No word crosses a single space
that stands between two characters that are not white space, and a space at such a place opens
the next word. So a text may be cut before these spaces, and frequent chunks, encoded once per
worker process, are put together again.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Mapping, Sequence

import regex

MOST_CHUNKS = 1_000_000  # a worker keeps at most so many chunks
MOST_WORDS = 250_000  # and so many words,
LONGEST_CHUNK = 64  # none longer than this

# The word pattern of the vocabulary's pre-tokenizer.
WORDS = regex.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+"
    r"|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
)
PLAIN_ENDS = frozenset(".,;:!?|")  # one of these after letters is a word of its own
_SAFE_CUT = re.compile(r"(?<=\S)(?= \S)")


def split_words(text: str) -> list[str]:
    """The words of a text, spaces before them included."""
    bare = text[1:] if text[:1] == " " else text
    if bare.isalpha():
        return [text]
    if bare[-1:] in PLAIN_ENDS and bare[:-1].isalpha():
        return [text[:-1], text[-1]]
    return WORDS.findall(text)


class ChunkCache:
    """Values of texts as the joined values of their words.

    ``encode`` maps a word to its value, ``join`` puts the values of neighbours together.
    ``special`` has strings with a value of their own, which are cut out first.
    """

    def __init__(
        self,
        encode: Callable[[str], object],
        join: Callable[[Iterable], object],
        special: Mapping[str, object],
        words: Callable[[str], list[str]] = split_words,
    ):
        self.encode, self.join, self.special, self.words = encode, join, special, words
        self.cut = re.compile("|".join(map(re.escape, special))) if special else None
        self.opening: dict[str, object] = {}  # chunks at the start of a text
        self.spaced: dict[str, object] = {}  # chunks after a space, which is part of them
        self.known_words: dict[str, object] = {}

    def _word(self, word: str) -> object:
        value = self.known_words.get(word)
        if value is None:
            value = self.encode(word)
            if len(self.known_words) < MOST_WORDS and len(word) <= LONGEST_CHUNK:
                self.known_words[word] = value
        return value

    def _between(self, text: str) -> list:
        return [self._word(word) for word in self.words(text)] if text else []

    def value(self, text: str) -> object:
        """The value of any text, without use of the cache."""
        if self.cut is None or self.cut.search(text) is None:
            return self.join(self._between(text))
        parts, at = [], 0
        for found in self.cut.finditer(text):
            parts += self._between(text[at : found.start()])
            parts.append(self.special[found.group()])
            at = found.end()
        return self.join([*parts, *self._between(text[at:])])

    def _missing(self, known: dict, chunks: set[str], space: str) -> dict:
        """Values of chunks that are not known; None stands for a chunk that is no safe cut."""
        values: dict[str, object] = {}
        for chunk in chunks.difference(known):
            if chunk and not chunk[0].isspace() and not chunk[-1].isspace():
                values[chunk] = self.value(space + chunk)
        if len(known) + len(values) <= MOST_CHUNKS:
            known.update((c, v) for c, v in values.items() if len(c) <= LONGEST_CHUNK)
        return values

    def values(self, texts: Sequence[str]) -> list:
        split = [text.split(" ") for text in texts]
        opening = self._missing(self.opening, {s[0] for s in split}, "")
        spaced = self._missing(self.spaced, set().union(*(s[1:] for s in split)), " ")
        out = []
        for text, chunks in zip(texts, split, strict=True):
            parts = [opening.get(chunks[0], self.opening.get(chunks[0]))]
            parts += map(self.spaced.get, chunks[1:])
            if None in parts:
                rest = [spaced.get(c) if v is None else v
                        for v, c in zip(parts[1:], chunks[1:], strict=True)]
                parts[1:] = rest
            if None in parts:
                parts = [self.value(part) for part in _SAFE_CUT.split(text)]
            out.append(self.join(parts))
        return out
