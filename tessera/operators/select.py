"""Exact quantiles of large groups, and running sums over them, without all of a group in one task.

Quantiles: a sketch brackets the wanted ranks, a scan counts what lies below the bracket, and only the distinct values
within it, a share of the rows that the sketch's accuracy bounds, are put in order. Running sums: rows are dealt to ranges
of the ordering value by cut points of a sketch; each range sums its own rows and begins with the totals of those before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.sources.stage import stage_table


def _same(by: list[str]) -> Column:
    """Null-safe equality of the columns *by* with __by0 and so on."""
    out = F.lit(True)
    for i, c in enumerate(by):
        out = out & F.col(c).eqNullSafe(F.col(f"__by{i}"))
    return out


def _keys(by: list[str]) -> list[Column]:
    return [F.col(c).alias(f"__by{i}") for i, c in enumerate(by)]


def quantiles(rows: DataFrame, by: list[str], wanted: dict[str, tuple[str, float]], accuracy: int = 10_000, stored: bool = False) -> DataFrame:
    """(by, and for each name in *wanted* the exact quantile of its column, interpolated): equal to ``percentile``; NULL
    without values, NaN counts as the largest.

    A task holds sketches of about *accuracy* values and, for one group and name, the distinct values of about 4 /
    *accuracy* of the rows, which spill. Brackets that miss a rank, which a sketch may in principle, are widened until none
    does. *rows* are written once, unless they are *stored* already; a row for each group and name is broadcast."""
    columns = sorted({c for c, _ in wanted.values()})
    rows = rows.select(*by, *[F.col(c).cast("double").alias(f"__{k}") for k, c in enumerate(columns)])
    rows = rows if stored else stage_table(rows, "selected")
    at = {c: f"__{k}" for k, c in enumerate(columns)}
    groups, near = rows.select(*by).distinct(), 2.0 / accuracy
    out, todo = groups, dict(wanted)
    found: dict[str, DataFrame] = {}
    while todo:
        ends = {n: F.percentile_approx(at[c], [max(0.0, q - near), min(1.0, q + near)], accuracy).alias(f"e_{n}") for n, (c, q) in todo.items()}
        brackets = stage_table(rows.groupBy(*by).agg(*ends.values()), "brackets")
        joined = rows.join(F.broadcast(brackets.select(*_keys(by), *[f"e_{n}" for n in todo])), _same(by))
        # Rank k = floor(q (n - 1)) and the next one must lie between the bracket's ends; the ends at 0 and 1 are open.
        checks, lows = [], []
        for n, (c, q) in todo.items():
            v, lo, hi = F.col(at[c]), F.get(f"e_{n}", F.lit(0)), F.get(f"e_{n}", F.lit(1))
            below = F.count_if(v < lo) if q - near > 0 else F.lit(0)
            upto = F.count_if(v <= hi) if q + near < 1 else F.count(v)
            rank = F.floor(F.lit(q) * (F.count(v) - 1))
            lows += [below.cast("long").alias(f"b_{n}"), F.count(v).alias(f"n_{n}")]
            checks.append(((F.count(v) > 0) & ((below > rank) | (upto < F.least(rank + 2, F.count(v))))).alias(f"x_{n}"))
        counted = stage_table(joined.groupBy(*by).agg(*lows, *checks), "ranks")
        missed = counted.agg(*[F.coalesce(F.max(F.col(f"x_{n}").cast("int")), F.lit(0)).alias(n) for n in todo]).first()
        for n in [n for n in todo if not missed[n]]:
            c, q = todo.pop(n)
            v, lo, hi = F.col(at[c]), F.get(f"e_{n}", F.lit(0)), F.get(f"e_{n}", F.lit(1))
            inside = joined.filter(v.isNotNull() & ((v >= lo) if q - near > 0 else F.lit(True)) & ((v <= hi) if q + near < 1 else F.lit(True)))
            per = inside.groupBy(*by, v.alias("v")).agg(F.count(F.lit(1)).alias("m"))
            here = counted.select(*_keys(by), F.col(f"b_{n}").alias("b"), F.col(f"n_{n}").alias("n"))
            per = per.join(F.broadcast(here), _same(by))
            upto = F.sum("m").over(Window.partitionBy(*by).orderBy("v").rowsBetween(Window.unboundedPreceding, 0)) + F.col("b")
            exact = F.lit(q) * (F.col("n") - 1)
            first, share = F.floor(exact), exact - F.floor(exact)
            ranked = per.withColumn("upto", upto)
            pick = lambda k: F.min(F.when(F.col("upto") > k, F.col("v")))
            low, high = pick(first), pick(F.least(F.ceil(exact), F.col("n") - 1))
            share = F.max(share)
            found[n] = ranked.groupBy(*by).agg(F.when(low == high, low).otherwise(low * (1 - share) + high * share).alias(n))
        near *= 8
    for n in wanted:
        out = out.join(found[n].select(*_keys(by), n), _same(by), "left").drop(*[f"__by{i}" for i in range(len(by))])
    return out


def running(rows: DataFrame, by: list[str], order: str, sums: list[str], ranges: int = 64, accuracy: int = 2000) -> DataFrame:
    """*rows*, of which none has its neighbour's *by* and *order*, with for each of *sums* ``run_``, the sum from the largest
    *order* down to the row; ``all_``, the group's; and ``next_``, that of the row after it (NULL for the last).

    A task holds one of *ranges* ranges of a group, not the group. Ranges are cut at quantiles of *order* over all groups;
    values that are equal are in one range, NULL in the lowest."""
    cuts = rows.agg(F.percentile_approx(F.col(order).cast("double"), [i / ranges for i in range(1, ranges)], accuracy).alias("__cuts"))
    at = F.size(F.filter(F.coalesce("__cuts", F.array().cast("array<double>")), lambda c: c < F.col(order)))
    rows = rows.crossJoin(F.broadcast(cuts)).withColumn("__range", at).drop("__cuts")
    within = Window.partitionBy(*by, "__range").orderBy(F.desc(order))
    down = within.rowsBetween(Window.unboundedPreceding, 0)
    per = rows.groupBy(*by, "__range").agg(*[F.sum(s).alias(f"s_{s}") for s in sums], F.max(F.struct(F.col(order).isNotNull(), F.col(order), *sums)).alias("first"))
    # From the highest range down: what lies before a range, its group's sums, and the first row of the next one.
    ranges_ = Window.partitionBy(*by).orderBy(F.desc("__range"))
    whole = Window.partitionBy(*by)
    before = ranges_.rowsBetween(Window.unboundedPreceding, -1)
    per = per.select(
        *_keys(by), F.col("__range").alias("__at"),
        *[F.coalesce(F.sum(f"s_{s}").over(before), F.lit(0)).alias(f"b_{s}") for s in sums], *[F.sum(f"s_{s}").over(whole).alias(f"all_{s}") for s in sums],
        *[F.lead(f"first.{s}").over(ranges_).alias(f"n_{s}") for s in sums],
    )
    rows = rows.withColumns({f"run_{s}": F.sum(s).over(down) for s in sums} | {f"next_{s}": F.lead(s).over(within) for s in sums})
    rows = rows.join(per, _same(by) & (F.col("__range") == F.col("__at")))
    rows = rows.withColumns({f"run_{s}": F.col(f"run_{s}") + F.col(f"b_{s}") for s in sums} | {f"next_{s}": F.coalesce(f"next_{s}", f"n_{s}") for s in sums})
    return rows.drop("__range", "__at", *[f"__by{i}" for i in range(len(by))], *[f"{k}_{s}" for k in "bn" for s in sums])
