"""Jaccard similarity join of shingle sets: a size-aware heavy-light join.

After Deng, Tao and Li (SIGMOD 2018): small sets meet over fixed-size subsets of their shingles,
large ones over inverted lists of single shingles, and a cost estimate over the sizes of all sets
draws the boundary. Sets that can be similar share two of the rarest shingles (the first
``n - c + 2`` of a set of ``n``, with ``c`` the least overlap that any partner needs), so a small
set enumerates the pairs of these; and they share one of the first ``n - c + 1``, whose inverted
lists the large sets are entered in. Small sets near the boundary are entered there too.

An inverted list is scanned as a stream. Every entry is paired with the first entries of its list
only, which leaves nothing open in short lists. What it leaves open in long ones is taken up when
the components of the links found so far are known: only entries of different components are
paired then. Round by round, entries outside their list's largest component meet eight times as
many entries of the list, drawn anew, until all are met or the list is of one component. So a list
of near copies costs a few pairs per entry, and no link between components is lost. Candidates pass
a size filter, a filter by place in the list's set, and one by a parity sketch, all of them free of
false negatives; then the whole sets are compared.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from cargolens.llm.components import connected_components
from cargolens.llm.shingles import shingle_set
from cargolens.llm.storage import discard, least_reached, observed, small, written

THRESHOLD = 75  # percent
SUBSET = 2  # shingles of a subset
LEADERS = 2  # first entries of a list that all others are paired with
DRAWN = 8  # entries of a long list that open ones meet in the first round, growing as a power
FOLD_WORDS = 8  # 64-bit words of the sketches that open entries carry, the least that any set has
SCAN_COST = 2.0  # of an entry in an inverted list, against one for a subset
WINDOW_SHINGLES = 4_000_000  # shingles a task counts at a time,
WINDOW_REPEATS = 2  # and sends on if they are repeated so often
MOST_FREQUENT = 2_000_000  # shingles ordered by frequency, the bound of a broadcast


def least_overlap(n, percent: int):
    """The fewest shingles that a set of n shares with any partner."""
    return -(-n * percent // 100)


def similar(overlap, n_a, n_b, percent: int):
    """Whether overlap / union reaches the threshold, in whole numbers."""
    return (100 + percent) * overlap >= percent * (n_a + n_b)


def parity_sketch(hashes: np.ndarray) -> bytes:
    """How often each of a power of two of buckets is hit, modulo two.

    Two sets differ in at least as many elements as their sketches do in bits.
    """
    bits = 64 * FOLD_WORDS
    while bits < len(hashes):
        bits *= 2
    hits = np.bincount((hashes & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(hits.astype(np.uint8)).tobytes()


def sketch_distance(a: bytes, b: bytes) -> int:
    """Bits in which two sketches differ; the longer one is folded to the shorter one's length."""
    while len(a) != len(b):
        if len(a) < len(b):
            a, b = b, a
        half = len(a) // 2
        a = (int.from_bytes(a[:half]) ^ int.from_bytes(a[half:])).to_bytes(half)
    return (int.from_bytes(a) ^ int.from_bytes(b)).bit_count()


def _fingerprint(hashes: np.ndarray) -> tuple[int, int]:
    raw = xxhash.xxh3_128_digest(hashes.tobytes())
    return int.from_bytes(raw[:8], signed=True), int.from_bytes(raw[8:], signed=True)


def _texts(column: pa.Array):
    for value in column.cast(pa.binary()):
        raw = value.as_buffer()
        yield raw.to_pybytes() if raw is not None else None


def _batch(names: list[str], kinds: list[pa.DataType], rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names
    )


# --- sets ---------------------------------------------------------------------


def _profiles(rows: DataFrame) -> DataFrame:
    """One row per document, and rows of shingles that repeat within a part of a task's texts.

    Documents have ``doc_id, n, class, check, sketch``: ``class`` and ``check`` are halves of a
    128-bit fingerprint of the set. Frequent shingles have ``shingle, repeats``; only sets that
    the task has not met before are counted.
    """
    id_type = rows.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n", "class", "check", "sketch", "shingle", "repeats"]

    def frequent(window):
        # Sorted in place, with no copies: tasks hold little else.
        hashes = np.concatenate(window)
        window.clear()
        hashes.sort()
        ahead = WINDOW_REPEATS - 1
        found = np.unique(hashes[:-ahead][hashes[:-ahead] == hashes[ahead:]])
        ends = (np.searchsorted(hashes, found, side) for side in ("right", "left"))
        return found.view(np.int64), np.subtract(*ends)

    def run(batches):
        window, held, seen, id_kind = [], 0, set(), None
        for batch in batches:
            id_kind = batch.column(0).type
            found = []
            for text in _texts(batch.column(1)):
                hashes = shingle_set(text)
                if not len(hashes):
                    found.append((0, None, None, None))
                    continue
                own, check = _fingerprint(hashes)
                found.append((len(hashes), own, check, parity_sketch(hashes)))
                if own not in seen:
                    seen.add(own)
                    window.append(hashes)
                    held += len(hashes)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            arrays = _batch(names[1:5], kinds, found).columns
            nothing = pa.nulls(batch.num_rows, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays, nothing, nothing], names)
            if held >= WINDOW_SHINGLES:
                yield from shingle_rows(window, id_kind)
                window, held = [], 0
        if window:
            yield from shingle_rows(window, id_kind)

    def shingle_rows(window, id_kind):
        shingles, counts = frequent(window)
        n = len(shingles)
        empty = [pa.nulls(n, k) for k in (id_kind, *[pa.int64()] * 3, pa.binary())]
        yield pa.RecordBatch.from_arrays([*empty, pa.array(shingles), pa.array(counts)], names)

    return rows.mapInArrow(
        run, f"doc_id {id_type}, n long, class long, check long, sketch binary, "
        "shingle long, repeats long",
    )


def _frequent(found: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Frequent shingles, sorted, and their places in the order of frequency.

    Those of the least frequency that at most ``MOST_FREQUENT`` shingles reach are fetched, whatever
    their share of all: it falls as tables grow, while lists do not get shorter. Lists of fewer
    entries than leave any open need no place. The order only decides which shingles of a set come
    first, never what is found.
    """
    counts = written(
        found.filter("shingle IS NOT NULL").groupBy("shingle").agg(F.sum("repeats").alias("repeats"))
        .filter(F.col("repeats") > LEADERS),
        "frequent",
    )
    least = least_reached(counts, "repeats", MOST_FREQUENT)
    table = counts.filter(F.col("repeats") >= least).toArrow()
    discard(counts)
    shingles = table["shingle"].to_numpy().view(np.uint64)
    repeats = table["repeats"].to_numpy()
    place = np.empty(len(shingles), dtype=np.int32)
    place[np.lexsort((shingles, repeats))] = np.arange(1, len(shingles) + 1, dtype=np.int32)
    by_shingle = np.argsort(shingles)
    return shingles[by_shingle], place[by_shingle]


def rarest_first(hashes: np.ndarray, frequent: np.ndarray, places: np.ndarray) -> np.ndarray:
    """A set with shingles that are not frequent first, then by frequency; by hash among equals."""
    if not len(frequent):
        return hashes
    at = np.searchsorted(frequent, hashes)
    at[at == len(frequent)] = 0
    place = np.where(frequent[at] == hashes, places[at], 0)
    return hashes[np.argsort(place, kind="stable")]


def boundary_by_cost(sizes: dict[int, int], percent: int) -> int:
    """The size from which sets are large: the total of subsets and list entries is smallest."""
    if not sizes:
        return 1
    n = np.array(sorted(sizes), dtype=np.int64)
    sets = np.array([sizes[k] for k in n], dtype=np.float64)
    overlap = least_overlap(n, percent)
    prefix = np.minimum(n, n - overlap + SUBSET).astype(np.float64)
    subsets = sets * prefix * (prefix - 1) / 2
    entries = sets * SCAN_COST * (n - overlap + 1)
    best, cost = 1, entries.sum()
    for bound in range(2, 65):  # subsets of larger sets always cost more than their entries
        low, high = np.searchsorted(n, [least_overlap(bound, percent), bound])
        now = subsets[:high].sum() + entries[low:].sum()
        if now < cost:
            best, cost = bound, now
    return best


# --- candidates ---------------------------------------------------------------


def _entries(rows: DataFrame, shared, boundary: int, percent: int, moved: set[int]) -> DataFrame:
    """``sig, class, n, rest``: subsets of small sets, and list entries of large ones.

    ``rest`` is the number of the set's shingles after the entry's; for subsets all of them.
    """
    low = least_overlap(boundary, percent)

    def signatures(hashes, frequent, places):
        n = len(hashes)
        prefix = n - least_overlap(n, percent)
        ordered = rarest_first(hashes, frequent, places)[: prefix + SUBSET]
        found, rests = [], []
        if n < boundary:
            i, j = np.triu_indices(len(ordered), 1)
            pair = (ordered[i] ^ (ordered[j] * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(
                0xC2B2AE3D27D4EB4F
            ) + (ordered[j] ^ (ordered[i] * np.uint64(0x9E3779B97F4A7C15)))
            found.append(pair)
            rests.append(np.full(len(pair), n))
        if n >= low:
            found.append(ordered[: prefix + 1])
            rests.append(n - 1 - np.arange(len(found[-1])))
        return np.concatenate(found), np.concatenate(rests)

    def run(batches):
        frequent, places = shared.value
        seen = set()
        for batch in batches:
            columns = [[], [], [], []]
            for text in _texts(batch.column(0)):
                hashes = shingle_set(text)
                if not len(hashes):
                    continue
                own, check = _fingerprint(hashes)
                if own in moved:
                    own = check
                if own in seen:
                    continue
                seen.add(own)
                found, rests = signatures(hashes, frequent, places)
                columns[0].append(found.view(np.int64))
                columns[1].append(np.full(len(found), own, dtype=np.int64))
                columns[2].append(np.full(len(found), len(hashes), dtype=np.int32))
                columns[3].append(rests.astype(np.int32))
            if columns[0]:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(c)) for c in columns], ["sig", "class", "n", "rest"]
                )

    return rows.select("text").mapInArrow(run, "sig long, class long, n int, rest int")


def _possible(n_a, n_b, rest_a, rest_b, percent: int):
    """Whether sets that first share an entry with such places can be similar."""
    sizes = 100 * np.minimum(n_a, n_b) >= percent * np.maximum(n_a, n_b)
    return sizes & similar(1 + np.minimum(rest_a, rest_b), n_a, n_b, percent)


def scan_lists(batches, percent: int = THRESHOLD, leaders: int = LEADERS):
    """Entries sorted by ``sig, class`` to pairs of classes, and the entries of long lists.

    Memory holds one batch and the first entries of the list that is being read. Pairs have
    ``a, b`` (a < b) and no ``sig``; entries of lists longer than the leaders and one have
    ``sig, a, n, rest`` and no ``b``.
    """
    kept = leaders + 1
    carry = [np.empty(0, dtype=np.int64)] * 4
    last, told = None, False  # told: the list being read is long, its first entries are out
    for batch in batches:
        rows = [batch.column(k).to_numpy().astype(np.int64) for k in range(4)]
        if not len(rows[0]):
            continue
        fresh = np.ones(len(rows[0]), dtype=bool)
        fresh[1:] = (rows[0][1:] != rows[0][:-1]) | (rows[1][1:] != rows[1][:-1])
        fresh[0] = (rows[0][0], rows[1][0]) != last
        last = rows[0][-1], rows[1][-1]
        known = len(carry[0])
        sig, own, n, rest = (np.concatenate([c, r[fresh]]) for c, r in zip(carry, rows, strict=True))
        if len(sig) == known:
            continue
        place = np.arange(len(sig))
        starts = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
        lengths = np.diff(np.append(starts, len(sig)))
        first = np.repeat(starts, lengths)
        new = place >= known
        for j in range(leaders):
            member = np.flatnonzero(new & (place - first > j))
            lead = first[member] + j
            ok = _possible(n[lead], n[member], rest[lead], rest[member], percent)
            member, lead = member[ok], lead[ok]
            if len(member):
                nothing = pa.nulls(len(member), pa.int64())
                short = pa.nulls(len(member), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [nothing, pa.array(own[lead]), pa.array(own[member]), short, short],
                    ["sig", "a", "b", "n", "rest"],
                )
        is_long = lengths > kept
        was_long = told
        is_long[0] |= told
        out = np.repeat(is_long, lengths) & (new | (not was_long))
        if out.any():
            yield pa.RecordBatch.from_arrays(
                [pa.array(sig[out]), pa.array(own[out]), pa.nulls(int(out.sum()), pa.int64()),
                 pa.array(n[out].astype(np.int32)), pa.array(rest[out].astype(np.int32))],
                ["sig", "a", "b", "n", "rest"],
            )
        at = starts[-1]
        carry = [c[at : at + kept] for c in (sig, own, n, rest)]
        told = bool(is_long[-1])


def _near(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Those pairs of classes whose sketches allow a link."""
    known = classes.select("class", "n", "sketch")
    rows = (
        pairs.join(known.toDF("a", "n_a", "sketch_a"), "a")
        .join(known.toDF("b", "n_b", "sketch_b"), "b")
        .select("a", "b", "n_a", "n_b", "sketch_a", "sketch_b")
    )

    def run(batches):
        for batch in batches:
            a, b, n_a, n_b, first, second = (c.to_pylist() for c in batch.columns)
            keep = []
            for k in range(len(a)):
                # |a - b| + |b - a| = n_a + n_b - 2 overlap, and the sketches show no more
                most = (n_a[k] + n_b[k] - sketch_distance(first[k], second[k])) / 2
                keep.append(similar(most, n_a[k], n_b[k], percent))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return rows.mapInArrow(run, "a long, b long")


def _links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those pairs whose whole sets reach the threshold."""
    rows = (
        pairs.join(sets.toDF("a", "set_a"), "a").join(sets.toDF("b", "set_b"), "b")
        .select("a", "b", "set_a", "set_b")
    )

    def run(batches):
        for batch in batches:
            keep = []
            for first, second in zip(batch.column(2), batch.column(3), strict=True):
                x = np.frombuffer(first.as_buffer(), dtype=np.uint64)
                y = np.frombuffer(second.as_buffer(), dtype=np.uint64)
                overlap = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(similar(overlap, len(x), len(y), percent))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return rows.mapInArrow(run, "a long, b long")


def _sets(rows: DataFrame, chosen: DataFrame, moved: set[int]) -> DataFrame:
    """``class, set`` of the classes ``wanted``, each read from the document ``chosen`` for it."""

    def run(batches):
        for batch in batches:
            found = []
            for wanted, text in zip(batch.column(0).to_pylist(), _texts(batch.column(1)),
                                    strict=True):
                hashes = shingle_set(text)
                if len(hashes):
                    own, check = _fingerprint(hashes)
                    if wanted == (check if own in moved else own):
                        found.append((wanted, hashes.tobytes()))
            yield _batch(["class", "set"], [pa.int64(), pa.binary()], found)

    return (
        rows.join(small(chosen), F.col("doc_id").eqNullSafe(F.col("chosen")))
        .select("wanted", "text").mapInArrow(run, "class long, set binary")
    )


def _folded(classes: DataFrame) -> DataFrame:
    """``class`` and its sketch, folded to the words ``f0, f1, ...``."""
    names = [f"f{k}" for k in range(FOLD_WORDS)]

    def run(batches):
        for batch in batches:
            words = np.zeros((batch.num_rows, FOLD_WORDS), dtype=np.int64)
            for k, sketch in enumerate(batch.column(1)):
                parts = np.frombuffer(sketch.as_buffer(), dtype=np.int64)
                words[k] = np.bitwise_xor.reduce(parts.reshape(-1, FOLD_WORDS), axis=0)
            folds = [pa.array(np.ascontiguousarray(words[:, k])) for k in range(FOLD_WORDS)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *folds], ["class", *names])

    return classes.select("class", "sketch").mapInArrow(
        run, ", ".join(f"{c} long" for c in ("class", *names))
    )


def _open_entries(entries: DataFrame, groups: DataFrame) -> DataFrame:
    """Entries of lists that hold classes of several components, with their ``component``.

    ``minor`` is whether that is not the list's largest one, ``entries`` the list's length.
    """
    labelled = written(
        entries.drop("component", "minor", "entries")
        .join(groups, entries["class"] == groups["node"], "left")
        .drop("node").withColumn("component", F.coalesce("component", "class")),
        "lists",
    )
    parts = labelled.groupBy("sig", "component").agg(F.count("*").alias("n"))
    mixed = parts.groupBy("sig").agg(
        F.max(F.struct("n", "component"))["component"].alias("major"),
        F.sum("n").alias("entries"), F.count("*").alias("components"),
    )
    mixed = mixed.filter("components > 1").drop("components")
    found = written(
        labelled.join(mixed, "sig").withColumn("minor", F.col("component") != F.col("major"))
        .drop("major"),
        "open",
    )
    discard(labelled)
    return found


def _across(entries: DataFrame, others: DataFrame, percent: int) -> DataFrame:
    """Pairs ``a, b`` of possible partners of different components that share a list.

    Of two components in a list one is minor, so only minor entries look for others. Sizes, places
    and folded sketches are conditions of the join: pairs that fail them never become rows.
    """
    x, y = entries.filter("minor").alias("x"), others.alias("y")
    total = F.col("x.n").cast("long") + F.col("y.n")
    sizes = F.least("x.n", "y.n").cast("long") * 100 >= F.greatest("x.n", "y.n").cast("long") * percent
    places = (F.least("x.rest", "y.rest") + 1) * (100 + percent) >= total * percent
    apart = sum(
        (F.bit_count(F.col(f"x.f{k}").bitwiseXOR(F.col(f"y.f{k}"))) for k in range(FOLD_WORDS)),
        F.lit(0),
    )
    sketches = (total - apart) * (100 + percent) >= total * 2 * percent
    same = (F.col("x.sig") == F.col("y.sig")) & (F.col("x.component") != F.col("y.component"))
    return (
        x.join(y, same & sizes & places & sketches)
        .select(F.least("x.class", "y.class").alias("a"), F.greatest("x.class", "y.class").alias("b"))
        .distinct()
    )


def _drawn_entries(entries: DataFrame, most: int) -> DataFrame:
    """About ``most`` entries of each list, all of lists that are not longer."""
    span = 1 << 20
    share = F.pmod(F.xxhash64("class", F.lit(most)), F.lit(span)) * F.col("entries")
    return entries.filter((F.col("entries") <= most) | (share < F.lit(span * most)))


def similar_groups(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                   percent: int = THRESHOLD) -> DataFrame:
    """``doc_id, n_shingles, component_id``: one row per row of ``docs``.

    Texts are sets of five-word shingles after lower-casing A to Z, and link when their Jaccard
    similarity reaches ``percent``; ``component_id`` is the smallest id that links lead to.
    ``percent`` is above 50: up to there, sets may link over a single shingle, which pairs of
    shingles do not find.

    A text with fewer than five words is one shingle. Null, empty and wordless texts have no
    shingles and link with nothing. Equal sets are one class from the start, and rows that
    repeat belong to it; rows of one id with different texts are judged each. Null ids take part
    in links but name no component; a null id that links with no other row has a null one. An
    empty table gives an empty result. Other columns are ignored.
    """
    if percent <= 50:
        raise ValueError("the least similarity must be above 50 percent")
    rows = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    spark = docs.sparkSession
    found = written(_profiles(rows), "profiles")
    members = found.filter("n IS NOT NULL").select("doc_id", "n", "class", "check", "sketch")
    # Sets whose fingerprints share one half are told apart by the other: expected for none of a
    # million sets and a handful of ten thousand million.
    halves = members.groupBy("class").agg(F.min("check").alias("x"), F.max("check").alias("y"))
    moved = {row["class"] for row in halves.filter("x <> y").select("class").collect()}
    if moved:
        members = members.withColumn(
            "class", F.when(F.col("class").isin(*moved), F.col("check")).otherwise(F.col("class"))
        )
    classes = written(
        members.filter("class IS NOT NULL").groupBy("class").agg(
            F.first("n").alias("n"), F.first("sketch").alias("sketch"),
            F.min("doc_id").alias("doc"),
        ),
        "classes",
    )
    sizes = {r["n"]: r["count"] for r in classes.groupBy("n").count().collect()}
    boundary = boundary_by_cost(sizes, percent)
    shared = spark.sparkContext.broadcast(_frequent(found))
    scanned = written(
        _entries(rows, shared, boundary, percent, moved)
        .repartition("sig").sortWithinPartitions("sig", "class")
        .mapInArrow(lambda batches: scan_lists(batches, percent),
                    "sig long, a long, b long, n int, rest int"),
        "scanned",
    )
    pairs = scanned.filter("b IS NOT NULL").select("a", "b").distinct()
    near = written(_near(pairs, classes, percent), "near")

    def compared(candidates):
        asked = written(
            candidates.select(F.col("a").alias("class")).union(candidates.select("b")).distinct(),
            "asked",
        )
        chosen = written(
            classes.join(small(asked), "class", "left_semi").select(
                F.col("class").alias("wanted"), F.col("doc").alias("chosen")
            ),
            "chosen",
        )
        sets = written(_sets(rows, chosen, moved), "sets")
        found, seen = observed(_links(candidates, sets, percent), "links", n=F.count(F.lit(1)))
        discard(asked, chosen, sets)
        return found, seen["n"]

    links, _ = compared(near)
    groups = connected_components(links)
    lists = scanned.filter("b IS NULL").select("sig", F.col("a").alias("class"), "n", "rest")
    first = _open_entries(lists, groups)
    discard(scanned, links)
    asked = written(first.select("class").distinct(), "asked")
    folded = _folded(classes.join(small(asked), "class", "left_semi"))
    entries = written(first.join(folded, "class"), "open")
    discard(first, asked)
    tried, most = near, DRAWN
    while longest := entries.agg(F.max("entries")).first()[0]:
        pairs = _across(entries, _drawn_entries(entries, most), percent)
        near, seen = observed(
            _near(pairs.join(tried, ["a", "b"], "left_anti"), classes, percent), "near",
            n=F.count(F.lit(1)),
        )
        found, gained = compared(near) if seen["n"] else (None, 0)
        if gained:
            # Components so far are stars of few edges, and stand for all links they came from.
            joined = groups.select(F.col("node").alias("a"), F.col("component").alias("b"))
            groups = connected_components(joined.union(found))
        if most >= longest:
            break
        if gained:
            before, entries = entries, _open_entries(entries, groups)
            discard(before)
        tried = tried.union(near)
        # A round that joins nothing leaves little for others: the next takes all entries.
        most = most * DRAWN if gained else longest
    discard(entries)
    groups = written(groups, "groups")
    labelled = written(
        members.join(groups, members["class"] == groups["node"], "left").select(
            "doc_id", "n", F.coalesce("component", "class").alias("root")
        ),
        "labelled",
    )
    names = written(
        labelled.groupBy("root").agg(F.min("doc_id").alias("component_id"))
        .filter("root IS NOT NULL"),
        "names",
    )
    return labelled.join(names, "root", "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
        .alias("component_id"),
    )
