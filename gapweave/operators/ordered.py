"""Order-dependent work that must not end in one task.

``row_number() over (partition by y)`` sends each group to one task, and
``over (order by x)`` sends the whole table. A class label or a whole table can
hold any share of the rows, so positions are computed here in two levels:
a position inside a small bucket plus the number of rows in earlier buckets.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gapweave.session import cut, shuffle_width

_FINAL_ROWS = 2_000
_ACCURACY = 10_000


def rank_by_draw(
    df: DataFrame,
    draw_col: str,
    tiebreak: str,
    group: list[str] | None = None,
    out: str = "rn",
    buckets: int | None = None,
) -> DataFrame:
    """1-based position by (draw, tiebreak) in each group, whatever the group's size.

    A draw is uniform, so equal slices of [0, 1) hold equal shares of a group.
    Adds ``out`` and ``group_size``.
    """
    group = list(group or [])
    b = buckets or shuffle_width(df.sparkSession) * 4
    sliced = df.withColumn("_slice", F.floor(F.col(draw_col) * b).cast("int"))
    counts = sliced.groupBy(*group, "_slice").agg(F.count(F.lit(1)).alias("_n"))
    # one row per (group, slice): at most b rows meet in a window task
    running = W.partitionBy(*(group or [F.lit(0)]))
    counts = counts.withColumn(
        "_before",
        F.coalesce(F.sum("_n").over(running.orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)),
    ).withColumn("group_size", F.sum("_n").over(running))
    inner = W.partitionBy(*group, "_slice").orderBy(draw_col, tiebreak)
    ranked = sliced.withColumn("_pos", F.row_number().over(inner))
    left, right = ranked.alias("l"), counts.alias("r")
    on = F.col("l._slice") == F.col("r._slice")
    for g in group:
        on = on & F.col(f"l.{g}").eqNullSafe(F.col(f"r.{g}"))
    return left.join(right, on).select(
        *[F.col(f"l.{c}") for c in df.columns],
        (F.col("l._pos") + F.col("r._before")).alias(out),
        F.col("r.group_size").alias("group_size"),
    )


def ordinal(df: DataFrame, order: list[str | Column], out: str = "rn") -> DataFrame:
    """1-based position of every row in a total order (distributed sort).

    The sorted rows are written once, so the ids that
    ``monotonically_increasing_id`` gave them stay as they are when a task is
    run again; only one count per partition is then added up.
    """
    placed = cut(df.orderBy(*order).withColumn("_mid", F.monotonically_increasing_id()))
    part = F.shiftright("_mid", 33)
    offsets = (
        placed.groupBy(part.alias("_part"))
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn(
            "_before",
            F.coalesce(
                F.sum("_n").over(W.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)),
                F.lit(0),
            ),
        )
        .select("_part", "_before")
    )
    pos = F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1))
    # one offset row per partition of the sorted table
    return (
        placed.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")
        .select(*df.columns, (F.col("_before") + pos + 1).alias(out))
    )


def ordinal_in_group(df: DataFrame, group: list[str], order: list[str | Column], out: str = "rn") -> DataFrame:
    """Like :func:`ordinal`, restarted in each group; a group may span tasks."""
    placed = ordinal(df, [*group, *order], "_g")
    starts = placed.groupBy(*group).agg(F.min("_g").alias("_start"))
    return placed.join(starts, group).select(*df.columns, (F.col("_g") - F.col("_start") + 1).alias(out))


def cumulative(
    df: DataFrame, group: list[str], value: str, sums: list[str], descending: bool = False
) -> DataFrame:
    """Running totals of ``sums`` over distinct ``value`` in each group, own row excluded.

    Expects one row per (group, value). Buckets come from approximate
    quantiles of ``value``; totals of earlier buckets are added back.
    Adds ``<s>_before`` for every summed column.
    """
    b = shuffle_width(df.sparkSession)
    probs = [i / b for i in range(1, b)]
    cuts = sorted(set(df.approxQuantile(value, probs, 1.0 / (4 * b)))) if b > 1 else []
    bucket = _bucket_of(F.col(value), cuts)
    keyed = df.withColumn("_b", bucket)
    direction = F.desc if descending else F.asc
    totals = keyed.groupBy(*group, "_b").agg(*[F.sum(s).alias(f"_{s}") for s in sums])
    w = W.partitionBy(*(group or [F.lit(0)])).orderBy(direction("_b")).rowsBetween(W.unboundedPreceding, -1)
    totals = totals.select(
        *group, "_b", *[F.coalesce(F.sum(f"_{s}").over(w), F.lit(0)).alias(f"_{s}_off") for s in sums]
    )
    inner = W.partitionBy(*group, "_b").orderBy(direction(value)).rowsBetween(W.unboundedPreceding, -1)
    local = keyed.select(
        *df.columns, "_b", *[F.coalesce(F.sum(s).over(inner), F.lit(0)).alias(f"_{s}_in") for s in sums]
    )
    return local.join(totals, [*group, "_b"]).select(
        *df.columns, *[(F.col(f"_{s}_in") + F.col(f"_{s}_off")).alias(f"{s}_before") for s in sums]
    )


def _bucket_of(x: Column, cuts: list[float]) -> Column:
    """Number of cut points at or below ``x``, found by halving (log2 comparisons)."""
    if not cuts:
        return F.lit(0)

    def search(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(x < F.lit(cuts[mid]), search(lo, mid)).otherwise(search(mid + 1, hi))

    if len(cuts) <= 256:
        return search(0, len(cuts))
    bounds = F.array(*[F.lit(v) for v in cuts])
    return F.size(F.filter(bounds, lambda v: v <= x))


def kth_values(df: DataFrame, ranks: dict[str, list[int]]) -> dict[str, list[float]]:
    """Exact values at 1-based ranks, several columns at once, no sort of the table.

    Each pass narrows every requested rank to a bracket whose width is set by
    the error bound of ``percentile_approx``; a bracket shrinks by about
    ``_ACCURACY`` per pass. What is left then is counted by value.
    """
    jobs = [_Rank(col, k) for col, ks in ranks.items() for k in ks]
    # each pass settles a rank, shrinks its bracket or leaves it to be counted by value, so this ends
    while todo := [j for j in jobs if j.value is None]:
        row = df.agg(
            *[F.count_if(j.inside()).alias(f"n{i}") for i, j in enumerate(todo)],
            *[F.count_if(j.below()).alias(f"b{i}") for i, j in enumerate(todo)],
        ).first()
        few, many = [], []
        for i, j in enumerate(todo):
            j.n, j.before = row[f"n{i}"], row[f"b{i}"]
            if not 0 < j.k - j.before <= j.n:
                raise ValueError(f"rank {j.k} lies outside column {j.column}")
            if j.lo is not None and j.lo == j.hi:
                j.value = j.lo
            else:
                (few if j.n <= _FINAL_ROWS or j.stuck else many).append(j)
        if few:
            _count_by_value(df, few)
            if any(j.value is None for j in few):
                raise ArithmeticError("the table changed while its ranks were counted")
        if many:
            slack = 2.0 / _ACCURACY
            row = df.agg(
                *[
                    F.percentile_approx(
                        F.when(j.inside(), F.col(j.column)),
                        [max((j.k - j.before) / j.n - slack, 0.0), min((j.k - j.before) / j.n + slack, 1.0)],
                        _ACCURACY,
                    ).alias(f"q{i}")
                    for i, j in enumerate(many)
                ]
            ).first()
            for i, j in enumerate(many):
                j.narrow(*row[f"q{i}"])
    out: dict[str, list[float]] = {col: [] for col in ranks}
    for j in jobs:
        out[j.column].append(j.value)
    return out


@dataclass
class _Rank:
    """One requested rank and the bracket of values that holds it."""

    column: str
    k: int
    lo: float | None = None
    hi: float | None = None
    n: int = 0
    before: int = 0
    stuck: bool = False
    value: float | None = None

    def inside(self) -> Column:
        x = F.col(self.column)
        return x.isNotNull() if self.lo is None else x.between(self.lo, self.hi)

    def below(self) -> Column:
        return F.lit(False) if self.lo is None else F.col(self.column) < self.lo

    def narrow(self, lo: float, hi: float) -> None:
        self.stuck = (lo, hi) == (self.lo, self.hi)
        self.lo, self.hi = lo, hi


def _count_by_value(df: DataFrame, jobs: list[_Rank]) -> None:
    """Finish several ranks with one count by value; each has few rows left (or few distinct values)."""
    entries = [
        F.struct(F.lit(i).alias("i"), F.when(j.inside(), F.col(j.column).cast("double")).alias("v"))
        for i, j in enumerate(jobs)
    ]
    counts = (
        df.select(F.inline(F.array(*entries))).filter("v is not null").groupBy("i", "v").agg(F.count(F.lit(1)).alias("n"))
    )
    seen = {i: j.before for i, j in enumerate(jobs)}
    for r in counts.orderBy("i", "v").toLocalIterator():
        j = jobs[r["i"]]
        if j.value is None:
            seen[r["i"]] += r["n"]
            if seen[r["i"]] >= j.k:
                j.value = r["v"]


def lowest(df: DataFrame, id_col: str, draws: dict[str, Column], sizes: dict[str, int]) -> dict[str, Column]:
    """For each named draw, a predicate that holds for exactly the ``sizes[name]`` rows lowest by (draw, id).

    A draw that is NULL leaves its row out. Choosing rows by an exact cut-off
    keeps the choice a projection: no row is shuffled, however wide it is.
    Rows that share the cut-off draw (about one in 2**32) are told apart by id.
    """
    out = {name: F.lit(False) for name in draws}
    wanted = {name: m for name, m in sizes.items() if m > 0}
    if not wanted:
        return out
    # ids and draws only, written once for the passes below
    keyed = cut(df.select(id_col, *[draws[name].alias(name) for name in wanted]))
    cutoff = {name: v[0] for name, v in kth_values(keyed, {name: [m] for name, m in wanted.items()}).items()}
    row = keyed.agg(
        *[F.count_if(F.col(name) < cutoff[name]).alias(f"b_{name}") for name in wanted],
        *[F.count_if(F.col(name) == cutoff[name]).alias(f"t_{name}") for name in wanted],
        *[F.max(F.when(F.col(name) == cutoff[name], F.col(id_col))).alias(f"i_{name}") for name in wanted],
    ).first()
    for name, m in wanted.items():
        room, tied = m - row[f"b_{name}"], row[f"t_{name}"]
        last = row[f"i_{name}"]
        if room < tied:
            at = keyed.filter(F.col(name) == cutoff[name]).select(id_col).orderBy(id_col).limit(room)
            last = at.agg(F.max(id_col)).first()[0]
        u = draws[name]
        out[name] = F.coalesce((u < cutoff[name]) | ((u == cutoff[name]) & (F.col(id_col) <= F.lit(last))), F.lit(False))
    return out
