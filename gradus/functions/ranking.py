"""Rank primitives shared by the metric operators.

Groups of up to ``BIG`` rows are ranked by windows: one exchange on the group, whatever their
number. Larger groups, found by one counting job over the group columns, don't fit a task; they are
ranked from one *sorted table*: rows are range-partitioned by (group, order) with Spark's own ordering
of the columns' types, and written once with the number of their range. Inside a range one window per
group gives the running sums. A group that lies in several ranges gets the exact sums of its ranges
before: only the first and the last group of a range can, so these offsets are at most two rows a
range, whatever the table's size; the driver adds them up and they are broadcast. Tie blocks that
lie in several ranges are mended alike. Both ways give the same ranks.

Value ranks start from *value counts*, one row per (group, value), so ties collapse in a partial
aggregation before they are moved.

Order: NaN is larger than every number; NULL comes last in both directions. NULL groups
are groups (every join back is null-safe).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, LongType, StructField, StructType
from pyspark.sql.window import Window

from gradus.sources.scratch import written

#: Rows of a group that one task ranks at most.
BIG = 1_000_000
#: Larger groups that are told apart from the others by a broadcast list; with more of them all rows are range-sorted.
LISTED = 50_000
#: Rows that a task makes of the items it holds, where each becomes several, so that it sorts them in memory.
TASK_ROWS = 2_000_000
#: Ranges of a sorted table; None: ``spark.sql.shuffle.partitions``, coalesced by adaptive execution.
RANGES: int | None = None


def _cols(x: str | Sequence[str]) -> list[str]:
    return [x] if isinstance(x, str) else list(x)


def join_on(left: DataFrame, right: DataFrame, cols: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join on columns of the same name, NULL matching NULL; the left ones are kept."""
    r = right.withColumnsRenamed({c: f"__r_{c}" for c in cols})
    cond = None
    for c in cols:
        e = F.col(c).eqNullSafe(F.col(f"__r_{c}"))
        cond = e if cond is None else cond & e
    out = left.join(r, cond, how)
    return out if how in ("left_semi", "left_anti") else out.drop(*[f"__r_{c}" for c in cols])


def value_counts(df: DataFrame, group: str | Sequence[str], value: str, *extra: Column) -> DataFrame:
    """Pre-aggregate rows into ``(group, value, cnt, extra...)`` (map-side combined)."""
    g = _cols(group)
    return df.groupBy(*g, value).agg(F.count(F.lit(1)).alias("cnt"), *extra)


def per_size(df: DataFrame, group: str | Sequence[str], fn: Callable[..., DataFrame], weight: Column | None = None) -> DataFrame:
    """``fn(rows, cut)`` of the rows of groups that fit a task (``cut`` False) and of the others (True), together.
    One job counts the rows per group; with a ``weight`` it adds that up too, and ``fn`` gets the total as well."""
    g = _cols(group)
    if not g:
        return fn(df, True)
    k = df.groupBy(*g).agg(F.count(F.lit(1)).alias("__k"), F.sum(F.lit(0) if weight is None else weight).alias("__w"))
    # there is a group above BIG in BIG rows at most, so the list is short
    got = k.agg(F.sum("__w").alias("w"), F.collect_list(F.when(F.col("__k") > BIG, F.struct(*g))).alias("big")).first()
    more = () if weight is None else (got.w or 0,)
    if not got.big:
        return fn(df, False, *more)
    if len(got.big) > LISTED:
        return fn(df, True, *more)
    listed = F.broadcast(_local(df, g, [tuple(r) for r in got.big]))  # at most LISTED rows
    return fn(join_on(df, listed, g, "left_anti"), False, *more).unionByName(fn(join_on(df, listed, g, "left_semi"), True, *more))


def _sorted_table(df: DataFrame, by: Sequence[Column]) -> DataFrame:
    x = df.repartitionByRange(*by) if RANGES is None else df.repartitionByRange(RANGES, *by)
    return written(x.withColumn("__p", F.spark_partition_id()), "sorted")


def _cut_groups(x: DataFrame, g: list[str], sums: Sequence[str], ends: Sequence[Column] = ()) -> list[Row]:
    """(group..., __p, sums..., ends...) of the groups that lie in several ranges, by range. They are the
    last group of a range and the first of the next, so there are at most two rows a range."""
    if g:
        own = F.struct(*[F.col(c).alias(f"g{i}") for i, c in enumerate(g)])
        edges = x.groupBy("__p").agg(F.min(own).alias("lo"), F.max(own).alias("hi")).collect()
        at: dict[tuple, set[int]] = {}
        for r in edges:
            for e in (r.lo, r.hi):
                at.setdefault(_comparable(tuple(e)), set()).add(r["__p"])
        edge = {(_comparable(tuple(e)), tuple(e), r["__p"]) for r in edges for e in (r.lo, r.hi)}
        rows = [(*e, p) for k, e, p in edge if len(at[k]) > 1]
        if not rows:
            return []
        x = join_on(x, F.broadcast(_local(x, [*g, "__p"], rows)), [*g, "__p"], "left_semi")
    out = x.groupBy(*g, "__p").agg(*[F.sum(c).alias(f"s{i}") for i, c in enumerate(sums)], *ends).collect()
    return sorted(out, key=lambda r: r["__p"])


def _comparable(values: tuple) -> tuple:
    """NaN equals NaN, NULL equals NULL."""
    return tuple("NaN" if isinstance(v, float) and v != v else v for v in values)


def _local(x: DataFrame, cols: Sequence[str], rows: list[tuple], *more: tuple[str, DataType]) -> DataFrame:
    """A small table: rows of ``cols``, typed as in ``x``, and ``more`` columns."""
    fields = [StructField(c, x.schema[c].dataType) for c in cols] + [StructField(n, t) for n, t in more]
    return x.sparkSession.createDataFrame(rows, StructType(fields))


def _offsets(cut: list[Row], width: int, sums: int) -> list[tuple]:
    """(key..., __p, sums over the ranges before..., sums over all...) from rows of (key, __p, sums) in order of __p."""
    total: dict[tuple, list] = {}
    part = []
    for r in cut:
        own = total.setdefault(_comparable(tuple(r[:width])), [None] * sums)
        part.append((r, list(own)))
        for i, v in enumerate(r[width + 1:width + 1 + sums]):
            own[i] = v if own[i] is None else own[i] if v is None else own[i] + v
    return [(*r[:width + 1], *before, *total[_comparable(tuple(r[:width]))]) for r, before in part]


def _zero(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(0))


def sorted_sums(df: DataFrame, group: str | Sequence[str], order: Sequence[Column], sums: dict[str, str],
                cut: bool | None = None) -> DataFrame:
    """Add to the rows, for every ``column -> name`` of ``sums``, the sum of the column over the
    rows of the group that come before in ``order`` (``name``) and over the whole group
    (``name_all``). Rows that are equal in ``order`` come in any order among themselves. With an
    empty ``group`` all rows are one group. ``cut``: whether groups may be too large for a task; None finds out."""
    g, cols, names = _cols(group), list(sums), list(sums.values())
    if cut is None:
        return per_size(df, g, lambda part, c: sorted_sums(part, g, order, sums, c))
    x = _sorted_table(df, [*[F.col(c) for c in g], *order]) if cut else df
    own = Window.partitionBy("__p", *g) if cut else Window.partitionBy(*g)
    upto = own.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    over = _cut_groups(x, g, cols) if cut else []
    y = x.withColumns({**{n: F.sum(c).over(upto) for c, n in sums.items()},
                       **{f"{n}_all": F.sum(c).over(own) for c, n in sums.items()}})
    if over:
        kind = [y.schema[n].dataType for n in names]
        more = [*[(f"__o_{n}", t) for n, t in zip(names, kind)], *[(f"__t_{n}", t) for n, t in zip(names, kind)]]
        y = join_on(y, F.broadcast(_local(x, [*g, "__p"], _offsets(over, len(g), len(names)), *more)), [*g, "__p"], "left")
        y = y.withColumns({**{n: _zero(n) + _zero(f"__o_{n}") for n in names},
                           **{f"{n}_all": F.coalesce(f"__t_{n}", f"{n}_all") for n in names}})
        y = y.drop(*[n for n, _ in more])
    return y.withColumns({n: _zero(n) for n in names}).drop("__p")


def ranked_rows(df: DataFrame, group: str | Sequence[str], value: str, key: Sequence[str], name: str,
                weight: str | None = None, descending: bool = False, cut: bool | None = None) -> DataFrame:
    """Rank whole rows without a join: adds ``{name}_pos`` (rows before, ties by ``key``), ``{name}_start`` (rows
    with a strictly earlier value), ``{name}_cnt`` (rows of the tie block) and ``n``. A row counts ``weight`` times.

    Ranges are cut by value and ``key``, so a tie block of any size is cut too; blocks that lie in
    several ranges are mended like groups that do. ``cut``: see ``sorted_sums``."""
    if cut is None:
        return per_size(df, group, lambda part, c: ranked_rows(part, group, value, key, name, weight, descending, c))
    g, w = _cols(group), F.lit(1).cast("long") if weight is None else F.col(weight)
    order, ties = _in_order(value, descending), [_in_order(c, False) for c in key]
    x = df.withColumn("__w", w)
    x = _sorted_table(x, [*[F.col(c) for c in g], order, *ties]) if cut else x
    part = ["__p", *g] if cut else g
    flag = F.struct((F.col(value).isNotNull() if descending else F.col(value).isNull()).alias("f"), F.col(value).alias("v"))
    first, last = (F.max(flag), F.min(flag)) if descending else (F.min(flag), F.max(flag))
    over = _cut_groups(x, g, ["__w"], [first.alias("first"), last.alias("last")]) if cut else []
    peers = Window.partitionBy(*part).orderBy(order)
    y = x.withColumn("__pos", F.sum("__w").over(peers.orderBy(order, *ties).rowsBetween(Window.unboundedPreceding, -1)))
    y = y.withColumns({"__upto": F.sum("__w").over(peers.rangeBetween(Window.unboundedPreceding, Window.currentRow)),
                       "__tie": F.sum("__w").over(peers.rangeBetween(Window.currentRow, Window.currentRow)),
                       "n": F.sum("__w").over(Window.partitionBy(*part))})
    y = y.withColumns({f"{name}_pos": _zero("__pos"), f"{name}_start": F.col("__upto") - F.col("__tie"), f"{name}_cnt": F.col("__tie")})
    if over:
        o = _local(x, [*g, "__p"], _offsets(over, len(g), 1), ("__og", LongType()), ("__tg", LongType()))
        y = join_on(y, F.broadcast(o), [*g, "__p"], "left")
        y = y.withColumns({f"{name}_pos": F.col(f"{name}_pos") + _zero("__og"), f"{name}_start": F.col(f"{name}_start") + _zero("__og"),
                           "n": F.coalesce("__tg", "n")}).drop("__og", "__tg")
        # a tie block goes on where a range ends and the next one of the group begins with its value
        blocks, ended = set(), {}
        for r in over:
            k = _comparable(tuple(r[:len(g)]))
            if k in ended and _comparable((ended[k][1].v,)) == _comparable((r.first.v,)):
                blocks |= {(*r[:len(g)], r.first.v, ended[k][0]), (*r[:len(g)], r.first.v, r["__p"])}
            ended[k] = (r["__p"], r.last)
        if blocks:
            at = [*g, value, "__p"]
            own = join_on(x, F.broadcast(_local(x, at, list(blocks))), at, "left_semi").groupBy(*at).agg(F.sum("__w").alias("s"))
            own = _offsets(sorted(own.collect(), key=lambda r: r["__p"]), len(g) + 1, 1)
            o = _local(x, at, own, ("__ov", LongType()), ("__tv", LongType()))
            y = join_on(y, F.broadcast(o), at, "left")
            y = y.withColumns({f"{name}_start": F.col(f"{name}_start") - _zero("__ov"), f"{name}_cnt": F.coalesce("__tv", f"{name}_cnt")}).drop("__ov", "__tv")
    return y.drop("__p", "__w", "__pos", "__upto", "__tie")


def mid_rank(name: str) -> Column:
    """1-based average rank from the columns of ``ranked_rows``."""
    return F.col(f"{name}_start") + (F.col(f"{name}_cnt") + 1) / F.lit(2.0)


def _in_order(value: str, descending: bool) -> Column:
    return F.col(value).desc_nulls_last() if descending else F.col(value).asc_nulls_last()


def running_sums(vc: DataFrame, group: str | Sequence[str], value: str, sums: dict[str, str], cut: bool | None = None) -> DataFrame:
    """``sorted_sums`` of a value table, in ascending order of the value."""
    return sorted_sums(vc, group, [_in_order(value, False)], sums, cut)


def rank_values(vc: DataFrame, group: str | Sequence[str], value: str, cnt: str = "cnt",
                descending: bool = False, cut: bool | None = None) -> DataFrame:
    """Add ``before`` (rows strictly ahead in the order), ``n`` (rows in the group)
    and ``avg_rank`` (1-based average rank of the tie block) to a value-count table.

    ``vc`` has one row per (group, value) with a row count ``cnt``."""
    x = sorted_sums(vc, group, [_in_order(value, descending)], {cnt: "before"}, cut).withColumnRenamed("before_all", "n")
    return x.withColumn("avg_rank", F.col("before") + (F.col(cnt) + 1) / F.lit(2.0))


def row_positions(df: DataFrame, group: str | Sequence[str], value: str, key: Sequence[str], out: str,
                  descending: bool = False) -> DataFrame:
    """1-based position of every row of a group by ``value``, ties by ``key`` ascending."""
    order = [_in_order(value, descending), *[_in_order(c, False) for c in key]]
    x = sorted_sums(df.withColumn("__one", F.lit(1).cast("long")), group, order, {"__one": "__before"})
    return x.withColumn(out, F.col("__before") + 1).drop("__one", "__before", "__before_all")


def tie_positions(df: DataFrame, block: str | Sequence[str], key: Sequence[str], out: str) -> DataFrame:
    """1-based position of every row of a tie block in ascending order of ``key``."""
    return row_positions(df, block, key[0], key[1:], out)


def discount_sum_rows(df: DataFrame, start: str, count: str, cuts: dict[str, str | None],
                      chunk: int = 4096) -> DataFrame:
    """For each tie block at positions ``start+1 .. start+count`` add one column per
    entry of ``cuts``: the sum of 1/log2(i+1) over those positions, cut at the
    position held in the named column (``None`` = no cut).

    Every block is exploded into rows of at most ``chunk`` positions, dealt by a hash of
    the chunk, so a tie block holding a third of all rows is summed by many tasks; the
    caller sums the partial columns per group."""
    lo, hi = F.col("_lo"), F.col("_hi")
    x = df.withColumn("_lo", F.col(start) + 1).withColumn("_hi", F.col(start) + F.col(count))
    x = x.withColumn("_cs", F.explode(F.sequence(lo, hi, F.lit(chunk).cast("long")))) \
        .repartition("_cs", F.xxhash64(*df.columns))
    end = F.least(F.col("_cs") + (chunk - 1), hi)
    for name, cut in cuts.items():
        to = end if cut is None else F.least(end, F.col(cut))
        s = F.aggregate(F.sequence(F.col("_cs"), F.greatest(to, F.col("_cs"))), F.lit(0.0),
                        lambda acc, i: acc + F.lit(1.0) / F.log2(i + 1))
        x = x.withColumn(name, F.when(to >= F.col("_cs"), s).otherwise(F.lit(0.0)))
    return x.drop("_lo", "_hi", "_cs")
