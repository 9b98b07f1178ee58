"""Sets of word shingles as sorted 64-bit hashes."""

from __future__ import annotations

import numpy as np
import xxhash

from cargolens.llm.exact_dedup import lower_ascii
from cargolens.llm.storage import process_value

WIDTH = 5
_MOST_WORDS = 500_000
_ODD = np.array(
    [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93,
     0xA0761D6478BD642F], dtype=np.uint64,
)
_MIX = np.uint64(0xE7037ED1A0B428DB)


class WordHashes(dict):
    """Words to 64-bit hashes, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh64_intdigest(word)
        if len(self) < _MOST_WORDS:
            self[word] = value
        return value


def word_hashes(text: bytes | None) -> np.ndarray:
    """Hashes of the words of a text in order: runs without ASCII white space, A-Z lower-cased."""
    words = lower_ascii(text).split() if text else []
    known = process_value("word_hashes", WordHashes)
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def shingle_set(text: bytes | None) -> np.ndarray:
    """Sorted distinct hashes of five-word shingles; of fewer words the whole sequence is one.

    Two shingles of a text get one hash with a probability of about 2^-64 per pair.
    """
    words = word_hashes(text)
    if not len(words):
        return words
    width = min(WIDTH, len(words))
    n = len(words) - width + 1
    found = np.full(n, width, dtype=np.uint64)
    for j in range(width):
        found += words[j : j + n] * _ODD[j]
    found ^= found >> np.uint64(31)
    found *= _MIX
    found ^= found >> np.uint64(29)
    return np.unique(found)
