"""Byte-pair encoding by a deterministic automaton over tokens (after Berglund et al., 2024).

The automaton starts with one state and one loop per byte. The gadget of a merge (u, v) changes
it in three places: the state that u leads to is split, so that u has one of its own; that state
loses its arc v; and wherever u and then v could be read, an arc uv leads to a copy of the state
behind v. After all gadgets there is one state per token, and the automaton accepts just one
token sequence per byte string: the one the merges give. Its arcs are kept as the list of gadgets
(birth, left part, right part, removed arc); whether a state has an arc follows from going back
through the gadgets that made both, and the answer stays in the transition table.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cargolens.llm.chunk_cache import ChunkCache
from cargolens.llm.public_bpe import (
    TEXTS_AT_ONCE, byte_letters, shared_vocabulary, special_tokens,
)
from cargolens.llm.storage import process_value

MOST_ARCS = 300_000  # entries a worker's transition table keeps


class MergeAutomaton:
    """The automaton of a list of merges; tokens are numbered as in the vocabulary."""

    def __init__(self, numbers: dict[bytes, int], merges: Sequence[tuple[bytes, bytes]]):
        size = max(numbers.values(), default=-1) + 1
        self.birth = [-1] * size  # the gadget that made a token; bytes are older than all
        self.left, self.right = [-1] * size, [-1] * size
        self.removed: dict[tuple[int, int], int] = {}  # (state, arc): the gadget that took it
        self.token: dict[bytes, int] = {t: k for t, k in numbers.items() if len(t) == 1}
        self.label = {k: t for t, k in numbers.items()}
        self.arcs: dict[tuple[int, int], bool] = {}
        for gadget, (first, second) in enumerate(merges):
            self._add(gadget, numbers[first], numbers[second], numbers[first + second])
        self.longest = max(map(len, self.token), default=0)

    def _add(self, gadget: int, u: int, v: int, merged: int) -> None:
        # A token that its own bytes do not lead to has no arcs, nor has one made of such.
        if not all(self.label[part] in self.token for part in (u, v)):
            return
        if self._has_arc(u, v, gadget - 1) and self.label[merged] not in self.token:
            self.birth[merged], self.left[merged], self.right[merged] = gadget, u, v
            self.token[self.label[merged]] = merged
        self.removed.setdefault((u, v), gadget)

    def _has_arc(self, state: int, arc: int, gadget: float = float("inf")) -> bool:
        """Whether ``state`` has ``arc`` after the given gadget."""
        birth = self.birth
        while True:
            removed = self.removed.get((state, arc))
            if removed is not None and removed <= gadget:
                return False
            if birth[state] > birth[arc]:  # a copy of the state behind the right part
                gadget, state = birth[state] - 1, self.right[state]
            elif birth[arc] >= 0:  # made where the left part could be read
                gadget, arc = birth[arc], self.left[arc]
            else:
                return True

    def has_arc(self, state: int, arc: int) -> bool:
        known = self.arcs.get((state, arc))
        if known is None:
            known = self._has_arc(state, arc)
            if len(self.arcs) < MOST_ARCS:
                self.arcs[state, arc] = known
        return known

    def encode(self, word: bytes) -> list[int]:
        """The tokens of the one accepted path that spells ``word``."""
        whole = self.token.get(word)
        if whole is not None:
            return [whole]
        token, has_arc = self.token.get, self.has_arc
        path, starts, dead = [], [], set()
        at, end = 0, min(self.longest, len(word))
        while at < len(word):
            # Longest arc first. The accepted path to a place is unique, so a place from which
            # no path goes on stays dead.
            while end > at:
                arc = None if end in dead else token(word[at:end])
                if arc is not None and (not path or has_arc(path[-1], arc)):
                    break
                end -= 1
            if end > at:
                path.append(arc)
                starts.append(at)
                at, end = end, min(end + self.longest, len(word))
            else:
                dead.add(at)
                end, at = at - 1, starts.pop()
                path.pop()
        return path

    def decode(self, tokens: Sequence[int]) -> bytes:
        return b"".join([self.label[t] for t in tokens])


def read_merges(vocabulary: str) -> tuple[dict[bytes, int], list[tuple[bytes, bytes]]]:
    """Token numbers and merges of a byte-level vocabulary, as bytes."""
    model = json.loads(vocabulary)["model"]
    byte_of = {letter: b for b, letter in enumerate(byte_letters())}
    special = special_tokens(vocabulary)

    def spelled(token: str) -> bytes:
        return bytes([byte_of[letter] for letter in token])

    numbers = {spelled(t): k for t, k in model["vocab"].items() if t not in special}
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    return numbers, [(spelled(u), spelled(v)) for u, v in pairs]


def _joined(parts: Sequence[str]) -> str:
    return ",".join([p for p in parts if p])


def _worker(vocabulary: str) -> tuple[ChunkCache, dict[str, bytes]]:
    def make():
        automaton = MergeAutomaton(*read_merges(vocabulary))
        special = special_tokens(vocabulary)
        labels = {str(k): t for k, t in automaton.label.items()}
        labels |= {str(k): t.encode() for t, k in special.items()}

        def encode(word: str) -> str:
            return ",".join(map(str, automaton.encode(word.encode())))

        specials = {text: str(k) for text, k in special.items()}
        return ChunkCache(encode, _joined, specials), labels

    return process_value(f"automaton_{hash(vocabulary)}", make)


def _decoded(ids: str | None, labels: dict[str, bytes]) -> str:
    raw = b"".join(map(labels.__getitem__, ids.split(","))) if ids else b""
    return raw.decode("utf-8", errors="replace")


def _mapped(frame: DataFrame, vocabulary: str | None, columns: str, task: Callable) -> DataFrame:
    """``frame`` of an id and a text, with columns that ``task`` makes of slices of its texts."""
    shared = shared_vocabulary(frame.sparkSession, vocabulary)
    id_type = frame.schema[0].dataType.simpleString()
    names = ["doc_id", *(c.split(" ")[0] for c in columns.split(", "))]

    def run(batches):
        worker = _worker(shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS_AT_ONCE):
                part = batch.slice(at, TEXTS_AT_ONCE)
                found = task(part.column(1).to_pylist(), *worker)
                yield pa.RecordBatch.from_arrays([part.column(0), *map(pa.array, found)], names)

    return frame.mapInArrow(run, f"doc_id {id_type}, {columns}")


def _encoded(texts: list, cache: ChunkCache, _labels=None) -> tuple[list[int], list[str]]:
    ids = cache.values([t or "" for t in texts])
    return [i.count(",") + 1 if i else 0 for i in ids], ids


def bpe_encode(docs: DataFrame, vocabulary: str | None = None, id_column: str = "doc_id",
               text_column: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids`` of whole texts; ``ids`` are decimal numbers joined by commas.

    Texts are split by the vocabulary's word pattern, special tokens in them are cut out first,
    and the automaton encodes each word. Null text counts as empty, which has no ids. Null and
    repeated ids are returned as they are; other columns are ignored.
    """
    rows = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    return _mapped(rows, vocabulary, "n_tokens long, ids string", _encoded)


def bpe_decode(encoded: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """``doc_id, decoded`` from ``doc_id, ids``: the labels of the arcs, special tokens included.

    Null ids give the empty text; bytes that are no UTF-8 give replacement characters.
    """

    def task(ids, _cache, labels):
        return ([_decoded(i, labels) for i in ids],)

    return _mapped(encoded.select("doc_id", "ids"), vocabulary, "decoded string", task)


def bpe_round_trip(docs: DataFrame, vocabulary: str | None = None, id_column: str = "doc_id",
                   text_column: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids, decoded``: both directions in one pass over the documents."""

    def task(texts, cache, labels):
        counts, ids = _encoded(texts, cache)
        return counts, ids, [_decoded(i, labels) for i in ids]

    rows = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    return _mapped(rows, vocabulary, "n_tokens long, ids string, decoded string", task)
