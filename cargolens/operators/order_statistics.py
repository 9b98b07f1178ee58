"""Exact order statistics and quantiles for groups of any size."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from cargolens.operators.filters import lookup
from cargolens.session import materialize

ACCURACY = 20_000  # the sketch is off by at most n / ACCURACY ranks
SMALL_GROUP = 40_000  # up to this many values a bracket's values are ranked as they are
GRID = 64  # quantiles of a bracket that the next, narrower one is chosen from
GRID_SHARES = [k / GRID for k in range(GRID + 1)]


def _joined(
    values: DataFrame, brackets: DataFrame, keys: Sequence[str], deal_by: Sequence[str],
    few_groups: bool,
) -> DataFrame:
    """Each value with the brackets of its group."""
    if not keys:
        one = brackets.select(F.struct("*")).scalar()
        return values.withColumn("__one", one).select("__value", "__one.*")
    if few_groups:
        return values.join(F.broadcast(brackets), list(keys))
    if len(keys) == 1:
        return lookup(values, brackets, keys[0], deal_by=deal_by)
    return values.join(brackets, list(keys))


def _bracket(i: int, *names: str) -> list[Column]:
    return [F.col(f"__{name}{i}") for name in names]


def _counts(at: Column, low: Column, high: Column, accuracy: int) -> dict[str, Column]:
    """What a round has to know of a bracket, as aggregates."""
    inside = at.between(low, high)
    return {
        "below": F.count_if(at < low), "inside": F.count_if(inside),
        "on_low": F.count_if(at == low), "on_high": F.count_if(at == high),
        "next_low": F.min(F.when(at > low, at)), "next_high": F.max(F.when(at < high, at)),
        "grid": F.percentile_approx(F.when(inside, at), GRID_SHARES, accuracy),
    }


def _narrowed(
    values: DataFrame, state: DataFrame, keys: Sequence[str], ranks: Sequence[Column],
    deal_by: Sequence[str], few_groups: bool, accuracy: int, most: int,
) -> DataFrame:
    """The brackets of large groups, each around its rank and with at most ``most`` values.

    Each round counts, per bracket, the values below, inside and on its ends, and sketches those
    inside. A rank outside moves to the part of the bracket before on that side; one on an end is
    found; else the ends are peeled off and the sketch narrows what is left. So every round
    leaves fewer distinct values, however they are tied and whatever the sketch says. Groups that
    are done take no part in further rounds.
    """
    at, sizes = F.col("__value"), [*keys, "rows", "n"]
    picks = range(len(ranks))
    kept = [f"__{name}{i}" for i in picks for name in ("low", "high", "from", "to")]
    found = None
    while True:
        met = _joined(values, state, keys, deal_by, few_groups)
        low, high = ([F.col(f"__{name}{i}") for i in picks] for name in ("low", "high"))
        counted = met.groupBy(*sizes, *kept).agg(*[
            column.alias(f"__{name}{i}") for i in picks
            for name, column in _counts(at, low[i], high[i], accuracy).items()
        ])
        done, changes = F.lit(True), {}
        for i, rank in enumerate(ranks):
            low, high, before, after = _bracket(i, "low", "high", "from", "to")
            below, many, grid = _bracket(i, "below", "inside", "grid")
            on_low, on_high, next_low, next_high = _bracket(
                i, "on_low", "on_high", "next_low", "next_high"
            )
            target = rank - below
            too_high, too_low = target < 0, target >= many
            enough = ~too_high & ~too_low & ((many <= most) | (low == high))
            is_low, is_high = target < on_low, target >= many - on_high
            cell = F.floor(target * GRID / F.greatest(many, F.lit(1)))
            first = F.get(grid, F.greatest(cell - 1, F.lit(0)).cast("int"))
            last = F.get(grid, F.least(cell + 2, F.lit(GRID)).cast("int"))

            def moved(outside_high, outside_low, low_end, high_end, narrowed, own):
                return (
                    F.when(too_high, outside_high).when(too_low, outside_low).when(enough, own)
                    .when(is_low, low_end).when(is_high, high_end).otherwise(narrowed)
                )

            changes |= {
                f"__low{i}": moved(before, high, low, high, F.greatest(first, next_low), low),
                f"__high{i}": moved(low, after, low, high, F.least(last, next_high), high),
                f"__from{i}": moved(before, high, low, high, next_low, before),
                f"__to{i}": moved(low, after, low, high, next_high, after),
            }
            done = done & enough
        counted = materialize(counted.withColumn("__done", done))
        ready = counted.filter("__done").select(*sizes, *kept)
        found = ready if found is None else found.unionByName(ready)
        rest = counted.filter("NOT __done")
        if rest.isEmpty():
            return found
        state = materialize(rest.select(*sizes, *[v.alias(n) for n, v in changes.items()]))


def order_statistics(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    picks: dict[str, tuple[float, Callable[[Column], Column]]],
    deal_by: Sequence[str],
    accuracy: int = ACCURACY,
    small_group: int = SMALL_GROUP,
    few_groups: bool = False,
) -> DataFrame:
    """The values at given ranks per group, with the group's ``rows`` and values ``n``.

    ``picks`` maps an output name to the share of rows around which the rank lies and
    to the rank itself (from 0, as a function of ``n``). Null values do not count.
    ``few_groups`` says that the groups are a small fixed set, such as class labels.

    No group is sorted as a whole. A mergeable sketch brackets each wanted rank, the
    rows between brackets collapse to one counted row, and only the distinct values
    inside the brackets are ranked. Brackets of groups of more than ``small_group`` values are
    counted first and narrowed, or widened, until they hold their rank and at most that many
    values, so no window grows with a group.
    """
    margin = 3.0 / accuracy
    shares = [share for share, _ in picks.values()]
    wanted = [bound for p in shares for bound in (max(p - margin, 0.0), min(p + margin, 1.0))]
    rows = df.select(*keys, *deal_by, F.col(value).cast("double").alias("__value"))
    sizes, small = [*keys, "rows", "n"], F.col("n") <= small_group
    values = rows.filter(F.col("__value").isNotNull())
    extremes = [
        F.count("*").alias("rows"),
        F.count("__value").alias("n"),
        F.min("__value").alias("__min"),
        F.max("__value").alias("__max"),
    ]
    bounds = F.percentile_approx("__value", wanted, accuracy).alias("__bounds")
    if few_groups or not keys:
        sketch = rows.groupBy(*keys).agg(*extremes, bounds)
    else:
        # Most groups are small: only counts are kept of them, and only large ones are sketched.
        counted = materialize(rows.groupBy(*keys).agg(*extremes))
        sketch = counted.withColumn("__bounds", F.lit(None).cast("array<double>"))
        large = counted.filter(~small)
        if not large.isEmpty():
            ends = [*sizes, "__min", "__max"]
            sketched = _joined(values, large, keys, deal_by, few_groups).groupBy(*ends).agg(bounds)
            sketch = sketch.filter(small).unionByName(sketched)
    edges = []
    for i in range(len(picks)):
        low, high = F.col("__bounds")[2 * i], F.col("__bounds")[2 * i + 1]
        edges += [
            F.when(small, F.col("__min")).otherwise(low).alias(f"__low{i}"),
            F.when(small, F.col("__max")).otherwise(high).alias(f"__high{i}"),
            F.col("__min").alias(f"__from{i}"), F.col("__max").alias(f"__to{i}"),
        ]
    brackets = materialize(sketch.select(*sizes, *edges))
    ranks = [rank(F.col("n")) for _, rank in picks.values()]
    large = brackets.filter(~small)
    if not large.isEmpty():
        narrowed = _narrowed(
            values, large, keys, ranks, deal_by, few_groups, accuracy, small_group
        )
        brackets = materialize(brackets.filter(small).unionByName(narrowed))

    at = F.col("__value")
    inside, zone = F.lit(False), F.lit(0)
    for i in range(len(picks)):
        left, right = _bracket(i, "low", "high")
        inside = inside | at.between(left, right)
        zone = zone + (at >= left).cast("int") + (at > right).cast("int")
    steps = (
        _joined(values, brackets, keys, deal_by, few_groups)
        .withColumn("__zone", zone)
        .withColumn("__inside", F.when(inside, at))
        .groupBy(*sizes, "__zone", "__inside")
        .agg(F.count("*").alias("__rows"), F.max("__value").alias("__value"))
    )
    upto = Window.partitionBy(*keys).orderBy("__value").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    ranked = steps.withColumn("__upto", F.sum("__rows").over(upto))
    return ranked.groupBy(*sizes).agg(
        *[
            F.min(F.when(F.col("__upto") > rank, F.struct("__upto", "__inside")))["__inside"]
            .alias(name)
            for name, rank in zip(picks, ranks)
        ]
    )


def column_medians(
    df: DataFrame, columns: Sequence[str], accuracy: int = ACCURACY, small: int = SMALL_GROUP
) -> dict[str, float | None]:
    """The median of each column, half-way between two middle values; null without any.

    All columns share each scan: one sketches them, one counts what lies below and inside their
    brackets, and one ranks the distinct values that lie inside the bracket of their column.
    Brackets of more than ``small`` values are narrowed by further scans. A few numbers per
    column come to the driver. Reads the frame three times; hand it a materialized one.
    """
    value = {c: F.col(c).cast("double") for c in columns}
    shares = [0.5 - 3 / accuracy, 0.5 + 3 / accuracy]
    first = df.agg(*[
        F.struct(
            F.count(v).alias("n"), F.min(v).alias("min"), F.max(v).alias("max"),
            F.percentile_approx(v, shares, accuracy).alias("near"),
        ).alias(c) for c, v in value.items()
    ]).first()
    size = {c: first[c]["n"] for c in columns if first[c]["n"]}
    wanted = [(c, rank) for c, n in size.items() for rank in sorted({(n - 1) // 2, n // 2})]
    outer = {(c, r): (first[c]["min"], first[c]["max"]) for c, r in wanted}
    near = {(c, r): tuple(first[c]["near"]) if size[c] > small else outer[c, r] for c, r in wanted}
    below: dict[tuple, int] = {}
    while open_ := [w for w in wanted if w not in below]:
        counted = df.agg(*[
            F.struct(*[
                v.alias(name)
                for name, v in _counts(value[w[0]], *map(F.lit, near[w]), accuracy).items()
                if near[w][0] != near[w][1] or name in ("below", "inside")
            ]).alias(f"p{k}") for k, w in enumerate(open_)
        ]).first()
        for w, found in zip(open_, counted):
            (low, high), many = near[w], found["inside"]
            target = w[1] - found["below"]
            if target < 0:
                near[w] = outer[w] = (outer[w][0], low)
            elif target >= many:
                near[w] = outer[w] = (high, outer[w][1])
            elif many <= small or low == high:
                below[w] = found["below"]
            elif target < found["on_low"] or target >= many - found["on_high"]:
                near[w] = (low, low) if target < found["on_low"] else (high, high)
            else:
                outer[w] = (found["next_low"], found["next_high"])
                cell, grid = target * GRID // many, found["grid"]
                near[w] = (max(grid[max(cell - 1, 0)], outer[w][0]),
                           min(grid[min(cell + 2, GRID)], outer[w][1]))
    if not wanted:
        return dict.fromkeys(columns)
    # The ends of a bracket of one value are that value; only values of others are ranked.
    picked = {w: near[w][0] for w in wanted if near[w][0] == near[w][1]}
    ranked = [w for w in wanted if w not in picked]
    if ranked:
        entries = F.array(*[
            F.struct(F.lit(k).alias("pick"), F.lit(w[1] - below[w]).alias("rank"),
                     value[w[0]].alias("value"), value[w[0]].between(*near[w]).alias("inside"))
            for k, w in enumerate(ranked)
        ])
        steps = df.select(F.inline(F.filter(entries, lambda e: e["inside"]))).groupBy(
            "pick", "rank", "value"
        ).count()
        upto = Window.partitionBy("pick").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
        found = steps.withColumn("upto", F.sum("count").over(upto)).groupBy("pick").agg(
            F.min(F.when(F.col("upto") > F.col("rank"), F.col("value"))).alias("value")
        )
        picked |= {ranked[row["pick"]]: row["value"] for row in found.collect()}
    middle: dict[str, list[float]] = {}
    for w in wanted:
        middle.setdefault(w[0], []).append(picked[w])
    return {
        c: middle[c][0] + (middle[c][-1] - middle[c][0]) * 0.5 if c in middle else None
        for c in columns
    }


def pair_cuts(
    df: DataFrame, group: str | None, value: str, key: str, share: float, **limits: int
) -> dict:
    """Per group, the pair (``value``, ``key``) of the ⌊share·n⌋-th smallest row, or no entry.

    Rows of equal values are told apart by their keys: ``rank_cut`` finds the value, one scan
    counts the rows below it and, per key, those on it. The groups are few, such as class labels;
    one pair for each comes to the driver. Without ``group`` the one entry is under None.
    """
    keys = [group] if group else []
    cuts = rank_cut(df, keys, value, share, [key], few_groups=True, **limits).collect()

    def per_group(entry: dict, kind: str) -> Column:
        found = F.lit(None).cast(kind)
        for name, number in entry.items():
            mine = F.col(group).eqNullSafe(F.lit(name)) if group else F.lit(True)
            found = F.when(mine, F.lit(number)).otherwise(found)
        return found

    names = [row[group] if group else None for row in cuts]
    cut = {name: row["cut"] for name, row in zip(names, cuts)}
    need = {name: math.floor(share * row["n"] + 1e-9) for name, row in zip(names, cuts)}
    on_cut = F.col(value) == per_group(cut, "double")
    counted = df.filter(F.col(value) <= per_group(cut, "double")).groupBy(
        *keys, on_cut.alias("__on"), F.when(on_cut, F.col(key)).alias("__key")
    ).count()
    # The window sees the keys of one value: of 32-bit hashes, some per 4 billion rows.
    order = Window.partitionBy(*keys).orderBy("__on", "__key").rowsBetween(
        Window.unboundedPreceding, 0
    )
    reached = counted.withColumn("__upto", F.sum("count").over(order)).filter(
        F.col("__on") & (F.col("__upto") >= per_group(need, "bigint"))
    )
    first = reached.groupBy(*keys).agg(F.min(F.struct("__upto", "__key"))["__key"].alias("__key"))
    found = {(row[group] if group else None): row["__key"] for row in first.collect()}
    return {name: (cut[name], found[name]) for name in found if need[name]}


def up_to(cut: tuple | None, value: Column, key: Column) -> Column:
    """Whether a row's pair is at most the cut of ``pair_cuts``; never without a cut."""
    if cut is None:
        return F.lit(False)
    return (value < F.lit(cut[0])) | ((value == F.lit(cut[0])) & (key <= F.lit(cut[1])))


def quantiles(
    df: DataFrame, keys: Sequence[str], value: str, shares: dict[str, float],
    deal_by: Sequence[str], few_groups: bool = False, **limits: int,
) -> DataFrame:
    """Quantiles with linear interpolation between neighbours, per group."""

    def place(share: float) -> Callable[[Column], Column]:
        return lambda n: F.lit(share) * (n - 1)

    picks = {}
    for name, share in shares.items():
        picks[f"{name}__low"] = (share, lambda n, at=place(share): F.floor(at(n)))
        picks[f"{name}__high"] = (share, lambda n, at=place(share): F.ceil(at(n)))
    found = order_statistics(
        df, keys, value, picks, deal_by, few_groups=few_groups, **limits
    )
    columns = []
    for name, share in shares.items():
        at = place(share)(F.col("n"))
        low, high = F.col(f"{name}__low"), F.col(f"{name}__high")
        columns.append((low + (high - low) * (at - F.floor(at))).alias(name))
    return found.select(*keys, "rows", "n", *columns)


def rank_cut(
    df: DataFrame, keys: Sequence[str], value: str, share: float, deal_by: Sequence[str],
    few_groups: bool = False, **limits: int,
) -> DataFrame:
    """Per group, the value of the ⌊share·n⌋-th smallest row, or of the smallest if that is 0."""

    # The small shift keeps a share of n that should be whole from falling below it.
    def rank(n: Column) -> Column:
        return F.greatest(F.floor(F.lit(share) * n + F.lit(1e-9)) - 1, F.lit(0))

    return order_statistics(
        df, keys, value, {"cut": (share, rank)}, deal_by, few_groups=few_groups, **limits
    )
