"""Splitting of documents into passages for retrieval."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cargolens.functions.text import strip

# Fixed values ---------------------------------------------------------------
CHUNK_SIZE = 500
CHUNK_STRIDE = 400
NO_SECTION = "N/A"
PREAMBLE = "Preamble"
# A section header line; (?d) keeps lines ending at newlines only.
HEADER = r"(?dm)^## .+$"
BEFORE_HEADER = r"(?dm)(?=^## .+$)"
# ----------------------------------------------------------------------------


def windows(text: Column) -> Column:
    """Overlapping windows of the whole text, stripped; blank ones become empty strings."""
    starts = F.when(
        F.length(text) > 0,
        F.sequence(F.lit(1), F.length(text), F.lit(CHUNK_STRIDE)),
    ).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda at: strip(F.substring(text, at, F.lit(CHUNK_SIZE))))


def chunk_windows(documents: DataFrame, key: str = "doc", text: str = "text") -> DataFrame:
    """Windows of 500 characters, each 400 after the last, numbered from 0 per document."""
    pieces = F.filter(windows(F.col(text)), lambda piece: piece != "")
    return documents.select(key, F.posexplode(pieces).alias("chunk_no", "text")).select(
        key, "chunk_no", F.lit(NO_SECTION).alias("section"), "text"
    )


def chunk_sections(documents: DataFrame, key: str = "doc", text: str = "text") -> DataFrame:
    """Passages along ``## `` headers; long sections and texts without headers in windows.

    Works row by row, so a document is split where it is read.
    """
    body = F.col(text)
    parts = F.filter(F.split(body, BEFORE_HEADER), lambda part: part != "")

    def passages(part: Column) -> Column:
        header = F.regexp_extract(part, HEADER, 0)
        name = strip(F.regexp_replace(strip(header), "^#+", ""))
        rest = strip(F.substring(part, F.length(header) + 1, F.length(part)))
        full = F.concat(name, F.lit("\n"), rest)
        pieces = F.when(F.length(full) <= CHUNK_SIZE, F.array(full)).otherwise(windows(full))
        section = F.when(header == "", PREAMBLE).otherwise(name)
        pieces = F.when(header == "", F.array(strip(part))).otherwise(pieces)
        return F.transform(
            pieces, lambda piece: F.struct(section.alias("section"), piece.alias("text"))
        )

    sectioned = F.flatten(F.transform(parts, passages))
    plain = F.transform(
        windows(body),
        lambda piece: F.struct(F.lit(NO_SECTION).alias("section"), piece.alias("text")),
    )
    chosen = F.when(body.rlike(HEADER), sectioned).otherwise(plain)
    kept = F.filter(chosen, lambda chunk: chunk["text"] != "")
    return documents.select(key, F.posexplode(kept).alias("chunk_no", "chunk")).select(
        key, "chunk_no", "chunk.section", "chunk.text"
    )
