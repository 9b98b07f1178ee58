"""Text expressions: stripping, titles, tokens and word sets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

# Fixed values ---------------------------------------------------------------
# White space as Unicode text processing counts it, separators U+001C-U+001F included.
SPACES = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007"
    "\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
SPACE_CLASS = (
    r"[\t-\r\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)
# A token is a run of two or more word characters.
TOKEN_PATTERN = r"[\p{L}\p{N}_]{2,}"
# A word, for word overlap, is a run of ASCII letters and apostrophes.
WORD_PATTERN = r"[a-zA-Z']+"
# Spark's default English stop words, without those a token can never equal.
STOP_WORDS = """
me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her
hers herself it its itself they them their theirs themselves what which who whom this that these
those am is are was were be been being have has had having do does did doing an the and but if or
because as until while of at by for with about against between into through during before after
above below to from up down in out on off over under again further then once here there when where
why how all any both each few more most other some such no nor not only own same so than too very
can will just don should now cannot could ought would
""".split()
# ----------------------------------------------------------------------------


def strip(text: Column) -> Column:
    """Drop white space of every kind from both ends."""
    return F.trim(text, F.lit(SPACES))


def title_case(text: Column) -> Column:
    """Upper-case the first letter of every run of letters, lower-case the rest."""
    pieces = F.regexp_extract_all(F.lower(text), F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1))
    return F.array_join(F.transform(pieces, F.initcap), "")


def document_title(file_stem: Column) -> Column:
    """``delivery_policy`` → ``Delivery Policy``."""
    return title_case(F.translate(file_stem, "_", " "))


def tokens(text: Column, stop_words: Sequence[str] = tuple(STOP_WORDS)) -> Column:
    """Lower-case tokens in order, without stop words."""
    found = F.regexp_extract_all(F.lower(text), F.lit(f"({TOKEN_PATTERN})"), F.lit(1))
    return F.filter(found, lambda token: ~token.isin(list(stop_words)))


def with_bigrams(words: Column | str) -> Column:
    """The words followed by all pairs of neighbours."""
    words = F.col(words) if isinstance(words, str) else words
    pair_count = F.greatest(F.size(words) - 1, F.lit(0))
    pairs = F.zip_with(
        F.slice(words, F.lit(1), pair_count),
        F.slice(words, F.lit(2), pair_count),
        lambda left, right: F.concat(left, F.lit(" "), right),
    )
    return F.concat(words, pairs)


def word_set(text: Column) -> Column:
    """Distinct lower-case words."""
    return F.array_distinct(
        F.regexp_extract_all(F.lower(text), F.lit(f"({WORD_PATTERN})"), F.lit(1))
    )
