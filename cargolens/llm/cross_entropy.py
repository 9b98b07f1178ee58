"""Documents scored by the difference of two cross-entropies (Moore and Lewis, ACL 2010)."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, functions as F

from cargolens.llm.shingles import word_hashes
from cargolens.llm.storage import discard, least_reached, small, written

WORD_BITS = 18  # smoothing spreads over at least 2^18 words, more if the texts hold more
PAIR_WEIGHT = 0.7  # of the pair model, the rest goes to the word model
HEAD_WORDS = 200_000  # of the most frequent words, whose counts go to all tasks
HEAD_PAIRS = 100_000  # pairs at most whose losses go to all tasks
CHOSEN_FROM = 8_000  # texts, drawn to choose these pairs from; they are counted in all texts
AT_ONCE = 300_000  # words or entries that a task works on at a time
PASS_WORDS = 1_000_000_000  # of a pass over the texts, so that a part of the entries is on disk
PASSES = 3  # at most
PARTS = 48  # that entries are dealt to; few, as a text has a sum in each of them
PART_WORDS = 100_000, 8_000_000  # in a part: fewer only in one of all, more take more parts
FOLLOWS = 1 << 40  # added to a word that follows a rare one
TEXT = 1 << 62  # from here on an entry's group is that of a text's own entry
_ODD = np.uint64(0x9E3779B97F4A7C15)
_RARE = np.uint64(1 << 63)


def _found(known: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which keys are among the sorted known ones, and the places of those that are."""
    at = np.searchsorted(known, keys)
    hit = at < len(known)
    hit[hit] = known[at[hit]] == keys[hit]
    return hit, at[hit]


class Head:
    """Frequent words in order of their hashes; a word's code is its place, from 1 on.

    Other words' codes are their hashes with the highest bit set, so negative; 0 is no word.
    ``pairs`` of frequent words, as numbers of both codes, have known ``losses``.
    """

    def __init__(self, words: pa.Table, total: dict, vocabulary: int):
        hashes = words["key"].to_numpy().view(np.uint64)
        order = np.argsort(hashes)
        self.words, self.spread = hashes[order], [total[c] + vocabulary for c in ("t", "b")]
        self.counts = [np.append(0.0, words[c].to_numpy()[order]) for c in ("t", "b")]
        self.pairs, self.losses = np.zeros(0, np.int64), [np.zeros(0)] * 2

    def know(self, before: np.ndarray, word: np.ndarray, counts: list[np.ndarray]) -> None:
        """Take up the losses of pairs of word hashes, if both are frequent."""
        before, word = self.codes(before), self.codes(word)
        both = (before > 0) & (word > 0)
        pairs = before[both] << 32 | word[both]
        order = np.argsort(pairs)
        self.pairs = pairs[order]
        self.losses = [
            self.pair_loss(k, n[both], self.counts[k][before[both]], self.counts[k][word[both]])[order]
            for k, n in enumerate(counts)
        ]

    def codes(self, words: np.ndarray) -> np.ndarray:
        hit, at = _found(self.words, words)
        codes = (words | _RARE).view(np.int64)
        codes[hit] = at + 1
        return codes

    def pair_loss(self, k: int, n, before, word) -> np.ndarray:
        """-log p(word | word before) in model ``k`` by the counts of the pair and of both words;
        by the word model alone where there is no word before."""
        once = (word + 1.0) / self.spread[k]
        follows = PAIR_WEIGHT * n / np.maximum(before, 1.0) + (1.0 - PAIR_WEIGHT) * once
        return -np.log(np.where(before > 0, follows, once))


def _texts(batch: pa.RecordBatch, column: int) -> Iterator[bytes | None]:
    for value in batch.column(column).cast(pa.binary()):
        raw = value.as_buffer()
        yield raw.to_pybytes() if raw is not None else None


def _blocks(batches) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, pa.RecordBatch]]:
    """``before, words, lengths, rows`` of some texts at a time, side by side: hashes of words and
    of those before them (0: none), words of each text, and the texts' rows of the batch."""
    def joined(held, batch, first):
        lengths = np.array([len(h) for h in held])
        words = np.concatenate(held)
        before = np.roll(words, 1)
        before[(np.cumsum(lengths) - lengths)[lengths > 0]] = 0
        return before, words, lengths, batch.slice(first, len(held))

    for batch in batches:
        held, size, first = [], 0, 0
        for text in _texts(batch, 0):
            held.append(word_hashes(text))
            size += len(held[-1])
            if size >= AT_ONCE:
                yield joined(held, batch, first)
                held, size, first = [], 0, first + len(held)
        if held:
            yield joined(held, batch, first)


def _summed(keys: np.ndarray, *values: np.ndarray) -> list[np.ndarray]:
    """Distinct keys and the sums of their values."""
    if not len(keys):
        return [keys, *values]
    order = np.argsort(keys)
    keys = keys[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return [keys[first], *(np.add.reduceat(v[order], first) for v in values)]


def _keys(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    """64-bit hashes of pairs of word hashes."""
    mixed = (before * _ODD + (word ^ (before >> np.uint64(29)))) * _ODD
    return (mixed ^ (mixed >> np.uint64(32))) * _ODD


def _batches(names: list[str], *columns: np.ndarray) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(columns[0]), 100_000):
        part = [pa.array(c[at : at + 100_000]) for c in columns]
        yield pa.RecordBatch.from_arrays(part, names)


def frequent_pairs(docs: DataFrame, text_column: str = "text") -> pa.Table:
    """``before, word`` hashes of up to ``HEAD_PAIRS`` pairs, the most frequent of some texts.

    Only which pairs are counted beforehand depends on the draw, no result does.
    """
    def counted(batches):
        for before, words, _, _ in _blocks(batches):
            there = before != 0
            before, words = before[there], words[there]
            keys = _keys(before, words)
            _, first, n = np.unique(keys, return_index=True, return_counts=True)
            yield from _batches(
                ["before", "word", "n"], before[first].view(np.int64), words[first].view(np.int64), n
            )

    texts = docs.select(F.col(text_column).alias("text"))
    drawn = texts.sample(min(1.0, CHOSEN_FROM / max(1, docs.count())), seed=9)
    seen = drawn.mapInArrow(counted, "before long, word long, n long").groupBy("before", "word")
    seen = written(seen.agg(F.sum("n").alias("n")).filter("n > 1"), "seen")
    least = least_reached(seen, "n", HEAD_PAIRS)
    found = seen.filter(F.col("n") >= least).select("before", "word").toArrow()
    discard(seen)
    return found


def counts_of(docs: DataFrame, target: DataFrame, pairs: Broadcast, text_column: str = "text") -> DataFrame:
    """``pair, key, t, b`` of all words (by their hashes) and of the given pairs (by their places),
    a written table: counts in the target and in the corpus."""
    def counted(batches):
        keys, place = pairs.value
        held, of_pairs = [np.zeros(0, np.uint64), np.zeros(0, np.int64)], np.zeros(len(keys), np.int64)
        for before, words, _, _ in _blocks(batches):
            found, n = np.unique(words, return_counts=True)
            held = _summed(np.concatenate([held[0], found]), np.concatenate([held[1], n]))
            _, at = _found(keys, _keys(before, words)[before != 0])
            of_pairs += np.bincount(place[at], minlength=len(keys))
            if len(held[0]) >= AT_ONCE:
                yield from sent(False, *held)
                held = [h[:0] for h in held]
        yield from sent(False, *held)
        yield from sent(True, np.flatnonzero(of_pairs), of_pairs[of_pairs > 0])

    def sent(pair, keys, n):
        return _batches(["pair", "key", "n"], np.full(len(n), pair), keys.view(np.int64), n)

    def of(frame, n):
        texts = frame.select(F.col(text_column).alias("text"))
        return texts.mapInArrow(counted, "pair boolean, key long, n long").select("pair", "key", *(
            (F.col("n") if c == n else F.lit(0).cast("long")).alias(c) for c in ("t", "b")
        ))

    sums = of(target, "t").union(of(docs, "b")).groupBy("pair", "key")
    return written(sums.agg(F.sum("t").alias("t"), F.sum("b").alias("b")), "words")


def _entries(head: Broadcast, in_target: bool, number: int, passes: int, id_type: pa.DataType):
    """A function of batches ``text, row, id`` to ``group, other, row, id``: the words whose losses
    the head does not know, and three own entries of each text, which alone have its id (``other``
    is its number of words and, in bits, the sums of its known losses).

    A pair of frequent words is a group. Other words have groups of their own: ``other`` is the
    word before (0: none) or, with ``FOLLOWS`` added, the frequent word after. In the target,
    rows are -1 and texts have no entries.
    """
    names = ["group", "other", "row", "id"]

    def entries(batches):
        know = head.value
        for before, words, lengths, texts in _blocks(batches):
            rows = texts.column(1).to_numpy()
            text = np.repeat(np.arange(len(lengths)), lengths)
            word = know.codes(words)
            before = np.where(before == 0, 0, np.roll(word, 1))
            pairs = before << 32 | word
            frequent = np.flatnonzero((before > 0) & (word > 0))
            hit, at = _found(know.pairs, pairs[frequent])
            if number == 0 and not in_target:
                first = (before == 0) & (word > 0)
                places = np.concatenate([text[frequent[hit]], text[first]])
                sums = [
                    np.bincount(places, np.concatenate([
                        know.losses[k][at],
                        know.pair_loss(k, 0.0, np.zeros(first.sum()), know.counts[k][word[first]]),
                    ]), len(lengths)).astype(float)
                    for k in (0, 1)
                ]
                for kind, x in enumerate([lengths.astype(np.int64), *(x.view(np.int64) for x in sums)]):
                    # Dealt by their rows, after all other entries of a task.
                    dealt = TEXT + ((rows << 2) & (TEXT - 1)) + kind
                    own = [pa.array(v) for v in (dealt, x, rows)]
                    yield pa.RecordBatch.from_arrays([*own, texts.column(2)], names)
            rest, rare, after = frequent[~hit], word < 0, (before < 0) & (word > 0)
            group = np.concatenate([pairs[rest], word[rare], before[after]])
            other = np.concatenate([np.zeros(len(rest), np.int64), before[rare], word[after] + FOLLOWS])
            row = rows[np.concatenate([text[rest], text[rare], text[after]])]
            if passes > 1:
                mine = (group.view(np.uint64) * _ODD >> np.uint64(40)) % np.uint64(passes) == number
                group, other, row = group[mine], other[mine], row[mine]
            if in_target:
                row = np.full(len(row), -1)
            for batch in _batches(names[:3], group, other, row):
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.nulls(len(batch), id_type)], names
                )

    return entries


def _pairs_scored(know: Head, group: np.ndarray, row: np.ndarray):
    """``row`` and both losses of the entries of whole, sorted groups of frequent words."""
    first = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    sizes, own = np.diff(np.append(first, len(group))), row >= 0
    b = np.add.reduceat(own.astype(np.int64), first)
    before, word = group[first] >> 32, group[first] & 0xFFFFFFFF
    losses = [
        know.pair_loss(k, n, know.counts[k][before], know.counts[k][word])
        for k, n in enumerate((sizes - b, b))
    ]
    return row[own], *(np.repeat(x, sizes)[own] for x in losses)


def _rare_scored(know: Head, group: np.ndarray, other: np.ndarray, row: np.ndarray):
    """``row`` and both losses of the entries of whole groups of rare words, and ``before, row``
    and the counts of the pair and of the word for those whose word before is rare, too."""
    order = np.lexsort((other, group))
    group, other, row = group[order], other[order], row[order]
    new = np.append(True, group[1:] != group[:-1])
    pair = np.append(True, (group[1:] != group[:-1]) | (other[1:] != other[:-1]))
    of_word, of_pair = np.cumsum(new) - 1, np.cumsum(pair) - 1
    follows, own = other >= FOLLOWS, row >= 0
    words = [np.add.reduceat((x & ~follows).astype(np.int64), np.flatnonzero(new))[of_word] for x in (~own, own)]
    pairs = [np.add.reduceat(x.astype(np.int64), np.flatnonzero(pair))[of_pair] for x in (~own, own)]
    done, left = own & (other >= 0), own & (other < 0)
    known = np.where(follows, other - FOLLOWS, other)[done]
    losses = []
    for k in (0, 1):
        rare, frequent = words[k][done], know.counts[k][known]
        after = follows[done]
        losses.append(know.pair_loss(
            k, pairs[k][done], np.where(after, rare, frequent), np.where(after, frequent, rare)
        ))
    return (row[done], *losses), (other[left], row[left], *(x[left] for x in (*pairs, *words)))


def _scored(head: Broadcast, names: list[str], types: list[pa.DataType]):
    """A function of batches of entries, in order of their groups, to sums of losses of rows."""
    def sent(size, **columns):
        return pa.RecordBatch.from_arrays(
            [columns[n] if n in columns else pa.nulls(size, t) for n, t in zip(names, types, strict=True)],
            names,
        )

    def sums_sent(row, t, b):
        for x in _batches(["row", "t", "b"], row, t, b):
            yield sent(len(x), row=x.column(0), t=x.column(1), b=x.column(2))

    def scored(batches):
        know = head.value
        none = [np.zeros(0, np.int64), np.zeros(0), np.zeros(0)]
        held, size, most, sums = [], 0, AT_ONCE, none
        for last, batch in _marked(batches):
            if batch is not None:
                group = batch.column(0).to_numpy()
                cut = int(np.searchsorted(group, TEXT))
                if cut < len(group):
                    texts = batch.slice(cut)
                    kind, of = group[cut:] & 3, texts.column(1).to_numpy()
                    n, t, b = (
                        pa.array(of if k == 0 else of.view(np.float64), mask=kind != k) for k in range(3)
                    )
                    yield sent(len(texts), row=texts.column(2), doc_id=texts.column(3), n_words=n, t=t, b=b)
                if cut:
                    held.append([batch.column(k).to_numpy()[:cut] for k in range(3)])
                    size += cut
            if size >= most or last and size:
                entries = [np.concatenate(x) for x in zip(*held, strict=True)]
                # The last group may go on in the next batch.
                whole = size if last else int(np.searchsorted(entries[0], entries[0][-1]))
                held, size = [[x[whole:] for x in entries]], size - whole
                most = max(AT_ONCE, 2 * size)
                group, other, row = (x[:whole] for x in entries)
                rare = int(np.searchsorted(group, 0))
                parts = [sums]
                if rare:
                    done, left = _rare_scored(know, group[:rare], other[:rare], row[:rare])
                    parts.append(done)
                    for x in _batches(["before", "row", "n_t", "n_b", "word_t", "word_b"], *left):
                        yield sent(len(x), **dict(zip(x.schema.names, x.columns, strict=True)))
                if rare < whole:
                    parts.append(_pairs_scored(know, group[rare:], row[rare:]))
                sums = _summed(*(np.concatenate(x) for x in zip(*parts, strict=True)))
                if len(sums[0]) >= AT_ONCE:
                    yield from sums_sent(*sums)
                    sums = none
        yield from sums_sent(*sums)

    return scored


def _marked(batches) -> Iterator[tuple[bool, pa.RecordBatch | None]]:
    """The batches, and a last mark without one."""
    for batch in batches:
        yield False, batch
    yield True, None


def _loss(n: str, word: str, before: str, spread: int) -> Column:
    """``Head.pair_loss`` for columns, where there is a word before."""
    once = (F.col(word) + 1.0) / F.lit(float(spread))
    follows = PAIR_WEIGHT * F.col(n) / F.col(before) + (1.0 - PAIR_WEIGHT) * once
    return -F.log(F.when(F.col(before) > 0, follows).otherwise(once))


def cross_entropy_difference(docs: DataFrame, target: DataFrame, id_column: str = "doc_id",
                             text_column: str = "text") -> DataFrame:
    """``doc_id, n_words, loss_target, loss_background, difference`` of every whole text.

    Two interpolated models of all words and word pairs, counted by 64-bit hashes, share one
    smoothing and one weight. The background model counts all texts of ``docs``, the target
    model all texts of ``target``. Losses are nats per word after lower-casing A to Z; a low
    difference marks a text that is more like the target than like the corpus.

    Losses of frequent pairs are computed first and summed where the text is read. All others
    are shuffled once: the entries of a pair, or of a rare word, meet in a group that counts
    them and gives each its loss. Pairs of two rare words then look up the count of the first.

    Null, empty and wordless texts have no words and null losses. With an empty target all its
    words are equally likely. Repeated rows and null ids are scored each; other columns are
    ignored.
    """
    context = docs.sparkSession.sparkContext
    before, word = (
        x.to_numpy().view(np.uint64) for x in frequent_pairs(docs, text_column).columns
    ) if HEAD_PAIRS else (np.zeros(0, np.uint64),) * 2
    keys = _keys(before, word)
    order = np.argsort(keys)
    counts = counts_of(docs, target, context.broadcast((keys[order], order)), text_column)
    words = counts.filter("NOT pair").drop("pair")
    sums = words.agg(F.sum("t").alias("t"), F.sum("b").alias("b"), F.count("*").alias("n")).first()
    total = {c: sums[c] or 0 for c in ("t", "b")}
    vocabulary = max(1 << WORD_BITS, sums["n"])
    uses = words.withColumn("n", F.col("t") + F.col("b"))
    least = least_reached(uses, "n", HEAD_WORDS)
    know = Head(uses.filter(F.col("n") >= least).toArrow(), total, vocabulary)
    of_pairs = counts.filter("pair").toArrow()
    at = of_pairs["key"].to_numpy()
    know.know(before[at], word[at], [of_pairs[c].to_numpy() for c in ("t", "b")])
    head = context.broadcast(know)
    rare = written(
        uses.filter(F.col("n") < least).select(
            F.col("key").bitwiseOR(F.lit(-(1 << 63))).alias("before"),
            F.col("t").alias("before_t"), F.col("b").alias("before_b"),
        ),
        "rare",
    )
    discard(counts)

    rows = docs.select(
        F.col(text_column).alias("text"), F.monotonically_increasing_id().alias("row"),
        F.col(id_column).alias("id"),
    )
    none = F.lit(None).cast(rows.schema["id"].dataType)
    asked = target.select(F.col(text_column).alias("text"), F.lit(-1).cast("long").alias("row"), none.alias("id"))
    id_type = rows.schema["id"].dataType.simpleString()
    arrow_id = rows.limit(0).toArrow().schema.field("id").type
    entry = f"group long, other long, row long, id {id_type}"
    numbers = ["before", "n_t", "n_b", "word_t", "word_b"]
    names = ["row", "doc_id", "n_words", "t", "b", *numbers]
    types = [pa.int64(), arrow_id, pa.int64(), pa.float64(), pa.float64(), *[pa.int64()] * 5]
    schema = f"row long, doc_id {id_type}, n_words long, t double, b double, " + ", ".join(
        f"{n} long" for n in numbers
    )
    passes, parts = max(1, min(PASSES, -(-total["b"] // PASS_WORDS))), []
    least, most = PART_WORDS
    dealt_to = max(min(PARTS, total["b"] // least + 1), total["b"] // (passes * most))
    if passes > 1:  # which must find the same rows under the same numbers
        rows = numbered = written(rows, "rows")
    for number in range(passes):
        entries = asked.mapInArrow(_entries(head, True, number, passes, arrow_id), entry).union(
            rows.mapInArrow(_entries(head, False, number, passes, arrow_id), entry)
        )
        dealt = entries.repartition(dealt_to, "group").sortWithinPartitions("group")
        parts.append(written(dealt.mapInArrow(_scored(head, names, types), schema), "sums"))
        left = parts[-1].filter("before IS NOT NULL").join(small(rare), "before").select(
            "row", none.alias("doc_id"), F.lit(None).cast("long").alias("n_words"),
            *(_loss(f"n_{c}", f"word_{c}", f"before_{c}", total[c] + vocabulary).alias(c) for c in "tb"),
        )
        done = parts[-1].filter("before IS NULL").select("row", "doc_id", "n_words", "t", "b")
        sums = done.union(left).groupBy("row").agg(
            F.first("doc_id", ignorenulls=True).alias("doc_id"),  # only a text's own entries have it
            *(F.sum(c).alias(c) for c in ("n_words", "t", "b")),
        )
        if passes > 1:
            part = written(sums, "part")
            discard(parts[-1])
            parts[-1] = part
    if passes > 1:
        discard(numbered)
        sums = reduce(DataFrame.union, parts).groupBy("row").agg(
            F.first("doc_id", ignorenulls=True).alias("doc_id"),
            *(F.sum(c).alias(c) for c in ("n_words", "t", "b")),
        )
    means = [
        F.when(F.col("n_words") > 0, F.col(c) / F.col("n_words")).alias(name)
        for c, name in (("t", "loss_target"), ("b", "loss_background"))
    ]
    scores = written(sums.select("doc_id", "n_words", *means).withColumn(
        "difference", F.col("loss_target") - F.col("loss_background")
    ), "scores")
    discard(rare, *parts)
    return scores
