"""Texts to ids by the tokenizers library, for tasks."""

from __future__ import annotations

import json
import struct
from collections.abc import Callable, Sequence

from pyspark.sql import SparkSession

from cargolens.llm.chunk_cache import ChunkCache
from cargolens.llm.storage import process_value

TEXTS_AT_ONCE = 256  # texts held as chunks at a time
#: Bytes that stand for themselves in a byte-level vocabulary; the others follow from 256 on.
VISIBLE = [*range(33, 127), *range(161, 173), *range(174, 256)]


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def read_vocabulary(path: str | None) -> str:
    """The vocabulary file's text: a few megabytes that go to the tasks as a broadcast."""
    with open(path or default_vocabulary(), encoding="utf-8") as file:
        return file.read()


def shared_vocabulary(spark: SparkSession, path: str | None):
    return spark.sparkContext.broadcast(read_vocabulary(path))


def byte_letters() -> list[str]:
    """The letter of each byte in a byte-level vocabulary."""
    hidden = [b for b in range(256) if b not in VISIBLE]
    letters = {b: chr(b) for b in VISIBLE} | {b: chr(256 + k) for k, b in enumerate(hidden)}
    return [letters[b] for b in range(256)]


def special_tokens(vocabulary: str) -> dict[str, int]:
    return {t["content"]: t["id"] for t in json.loads(vocabulary)["added_tokens"]}


def _four_bytes(ids: Sequence[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def _library_cache(vocabulary: str) -> ChunkCache:
    from tokenizers import Tokenizer

    model = Tokenizer.from_str(vocabulary).model
    letters = byte_letters()
    special = {text: _four_bytes([k]) for text, k in special_tokens(vocabulary).items()}

    space = letters[ord(" ")]

    def encode(word: str) -> bytes:
        if word[:1] == " " and word[1:].isalpha() and word.isascii():
            spelled = space + word[1:]
        else:
            spelled = "".join([letters[b] for b in word.encode()])
        return _four_bytes([token.id for token in model.tokenize(spelled)])

    return ChunkCache(encode, b"".join, special)


def id_bytes(vocabulary: str) -> Callable[[Sequence[str]], list[bytes]]:
    """Texts to their ids, little-endian unsigned 32-bit; the worker process keeps the cache."""
    name = f"library_{hash(vocabulary)}"
    return process_value(name, lambda: _library_cache(vocabulary)).values
