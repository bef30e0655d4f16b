"""Bucketing, pivots, gap filling, as-of alignment, sequences and coverage of signals by lift."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import TagGroup, group_table
from ..functions.quantiles import exact_quantiles

KEY = ("lift_id", "bucket_start_unix")


def _q(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def bucket_start(ts: Column, size: Column | int) -> Column:
    """The start of the epoch-aligned bucket of whole seconds that holds ts."""
    size = F.lit(size) if isinstance(size, int) else size
    return (F.floor(F.unix_timestamp(ts) / size) * size).cast("long")


def bucketed(df: DataFrame, groups: Iterable[TagGroup], ts: str = "timestamp_utc", tag: str = "tagname", lift: str = "lift_id") -> DataFrame:
    """Rows of tags that a group has, with group, bucket and the key lift_bucket, in one pass.

    The configuration is a table of fixed size, one row per configured tag, and is broadcast; its
    tags are also a filter that reaches the scan.
    """
    groups = tuple(groups)
    table = F.broadcast(group_table(df.sparkSession, groups)).withColumnRenamed("tagname", "__tag")
    tags = sorted({t for g in groups for t in g.tags})
    out = df.filter(F.col(tag).isin(*tags)).join(table, F.col(tag) == F.col("__tag")).drop("__tag")
    out = out.withColumn("ts_unix", F.unix_timestamp(ts)).withColumn("bucket_start_unix", bucket_start(F.col(ts), F.col("bucket_size_s")))
    return out.withColumns(
        {"bucket_start_ts": F.timestamp_seconds("bucket_start_unix"), "lift_group_bucket": F.concat_ws("_", F.col(lift).cast("string"), F.col("bucket_start_unix").cast("string"))}
    )


def unmapped_tags(df: DataFrame, groups: Iterable[TagGroup], tag: str = "tagname") -> DataFrame:
    """Tags of df that no group has, with their numbers of rows."""
    known = F.broadcast(group_table(df.sparkSession, groups)).select(F.col("tagname").alias(tag))
    return df.join(known, tag, "left_anti").groupBy(tag).agg(F.count(F.lit(1)).alias("n"))


def group_matrix(rows: DataFrame, group: TagGroup, value: str = "value", tag: str = "tagname") -> DataFrame:
    """lift_id, bucket_start_unix and a column of means for each tag of the group; a row where at
    least one tag reported. The tags are given, so no pass is spent on finding them."""
    own = rows.filter((F.col("tag_group") == group.name) & F.col(tag).isin(*group.tags))
    return own.groupBy(*KEY).pivot(tag, list(group.tags)).agg(F.avg(value))


def fill_model(matrix: DataFrame, columns: Sequence[str], max_gap: int, zero_fill: Sequence[str] = (), lift: str = "lift_id", order: str = "bucket_start_unix") -> DataFrame:
    """Fill runs of nulls by row, within a lift, in the order of buckets.

    In zero_fill columns a run between two zeros is zero, however long. Other runs of max_gap rows
    or fewer are interpolated between their neighbours by row, or get the one neighbour there is.
    """
    one = Window.partitionBy(lift).orderBy(order)
    back, ahead = one.rowsBetween(Window.unboundedPreceding, 0), one.rowsBetween(0, Window.unboundedFollowing)
    numbered = matrix.withColumn("__n", F.row_number().over(one))
    near = {}
    for c in columns:
        seen = F.when(_q(c).isNotNull(), F.struct(_q(c).alias("v"), F.col("__n").alias("n")))
        near |= {f"__p_{c}": F.last(seen, ignorenulls=True).over(back), f"__f_{c}": F.first(seen, ignorenulls=True).over(ahead)}
    size = F.count(F.lit(1)).over(Window.partitionBy(lift))
    found = numbered.select("*", size.alias("__size"), *[v.alias(k) for k, v in near.items()])

    def filled(c: str) -> Column:
        p, f = _q(f"__p_{c}"), _q(f"__f_{c}")
        run = F.coalesce(f["n"], F.col("__size") + 1) - F.coalesce(p["n"], F.lit(0)) - 1
        a, b = (F.col("__n") - p["n"]).cast("double"), (f["n"] - F.col("__n")).cast("double")
        between = (p["v"] / a + f["v"] / b) / (1 / a + 1 / b)
        value = F.when(run <= max_gap, F.coalesce(F.when(p.isNotNull() & f.isNotNull(), between), p["v"], f["v"]))
        if c in zero_fill:
            value = F.when((p["v"] == 0) & (f["v"] == 0), F.lit(0.0)).otherwise(value)
        return F.when(_q(c).isNotNull(), _q(c)).otherwise(value).alias(c)

    return found.select(*[filled(c) if c in columns else _q(c) for c in matrix.columns])


def fill_time(matrix: DataFrame, columns: Sequence[str], size_s: int, max_gap: int, zero_fill: Sequence[str] = (), lift: str = "lift_id", order: str = "bucket_start_unix") -> DataFrame:
    """Fill between two values, linear in time, where max_gap buckets or fewer are missing between
    them; zero between two zeros in zero_fill columns, under the same limit."""
    one = Window.partitionBy(lift).orderBy(order)
    back, ahead = one.rowsBetween(Window.unboundedPreceding, 0), one.rowsBetween(0, Window.unboundedFollowing)
    near = []
    for c in columns:
        seen = F.when(_q(c).isNotNull(), F.struct(_q(c).alias("v"), F.col(order).alias("t")))
        near += [F.last(seen, ignorenulls=True).over(back).alias(f"__p_{c}"), F.first(seen, ignorenulls=True).over(ahead).alias(f"__f_{c}")]
    found = matrix.select("*", *near)

    def filled(c: str) -> Column:
        p, f = _q(f"__p_{c}"), _q(f"__f_{c}")
        width = f["t"] - p["t"]
        value = p["v"] + (f["v"] - p["v"]) * (F.col(order) - p["t"]) / width
        if c in zero_fill:
            value = F.when((p["v"] == 0) & (f["v"] == 0), F.lit(0.0)).otherwise(value)
        return F.when(_q(c).isNotNull(), _q(c)).otherwise(F.when((width > 0) & (width / size_s - 1 <= max_gap), value)).alias(c)

    return found.select(*[filled(c) if c in columns else _q(c) for c in matrix.columns])


def fill_recursive(matrix: DataFrame, columns: Sequence[str], max_gap: int, lift: str = "lift_id", order: str = "bucket_start_unix") -> DataFrame:
    """Fill from left to right from the nearest values max_gap rows or fewer away on either side,
    weighted by 1 / distance, where values already filled count: once a lift has a value, nothing
    after it stays null.

    What a null becomes follows from the run of nulls it lies in. With a value before the run, each
    null is at distance 1 from the one filled before it: those that the value behind the run is too
    far from repeat the value before; of the others, the one at distance d from the value behind it
    moves 1 / (d + 1) of the way there. With none before, the last max_gap get the value behind. As
    the nulls within reach of the value w behind are the last max_gap at most, each is the value
    before plus a fixed share of the way to w: no fold, three windows over a lift.
    """
    one = Window.partitionBy(lift).orderBy(order)
    back, ahead = one.rowsBetween(Window.unboundedPreceding, 0), one.rowsBetween(0, Window.unboundedFollowing)
    near = []
    for i, c in enumerate(columns):
        seen = F.when(_q(c).isNotNull(), F.struct(_q(c).cast("double").alias("v"), F.col("__n").alias("n")))
        near += [F.last(seen, ignorenulls=True).over(back).alias(f"__p_{i}"), F.first(seen, ignorenulls=True).over(ahead).alias(f"__f_{i}")]
    found = matrix.withColumn("__n", F.row_number().over(one)).select("*", *near)

    def filled(i: int, c: str) -> Column:
        before, behind = _q(f"__p_{i}"), _q(f"__f_{i}")
        d = behind["n"] - F.col("__n")
        # the run's nulls in reach of the value behind have distances reach, ..., d; each leaves d / (d + 1) of the way
        reach = F.least(F.lit(max_gap), behind["n"] - before["n"] - 1)
        left = d / (reach + 1)
        between = before["v"] * left + behind["v"] * (1 - left)
        value = F.when(before.isNull(), F.when(d <= max_gap, behind["v"])).when(behind.isNull() | (d > max_gap), before["v"]).otherwise(between)
        return F.when(_q(c).isNotNull(), _q(c).cast("double")).when(F.lit(max_gap) < 1, F.lit(None)).otherwise(value).alias(c)

    place = {c: i for i, c in enumerate(columns)}
    return found.select(*[filled(place[c], c) if c in place else _q(c) for c in matrix.columns])


def forward_fill(matrix: DataFrame, columns: Sequence[str], lift: str = "lift_id", order: str = "bucket_start_unix") -> DataFrame:
    """The last value before, within a lift."""
    back = Window.partitionBy(lift).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return matrix.select(*[F.last(_q(c), ignorenulls=True).over(back).alias(c) if c in columns else _q(c) for c in matrix.columns])


def asof_align(base: DataFrame, others: Mapping[str, tuple[DataFrame, Sequence[str]]], by: str = "lift_id", at: str = "ts", chunk: int | None = None) -> DataFrame:
    """base with, for each other table, its columns as of the last row of the same lift at or before
    the base row's time; nulls where there is none.

    All tables go through one union and one window, ordered so that rows of equal time are seen;
    no join, whatever the number of tables. Each table's columns become name_column. With chunk
    (in the unit of a numeric `at`) a lift is cut into stretches of time that different tasks work
    on; what a stretch begins with comes from a small table of what the stretches before end with.
    """
    columns = [(name, c) for name, (_, cols) in others.items() for c in cols]
    stacked = base.select(F.lit(1).alias("__side"), *base.columns)
    for name, (df, cols) in others.items():
        own = df.select(F.lit(0).alias("__side"), by, at, F.struct(*[F.col(c) for c in cols]).alias(f"__{name}"))
        stacked = stacked.unionByName(own, allowMissingColumns=True)
    keys = [by]
    if chunk is not None:
        stacked, keys = stacked.withColumn("__chunk", F.floor(F.col(at) / chunk)), [by, "__chunk"]
    back = Window.partitionBy(*keys).orderBy(at, "__side").rowsBetween(Window.unboundedPreceding, 0)
    seen = stacked.select("*", *[F.last(f"__{name}", ignorenulls=True).over(back).alias(f"__l_{name}") for name in others]).filter("__side = 1")
    if chunk is not None:
        present = [F.col(f"__{n}").isNotNull() for n in others]
        last = [F.max_by(f"__{n}", F.when(p, F.col(at))).alias(f"__e_{n}") for n, p in zip(others, present, strict=True)]
        ends = stacked.groupBy(*keys).agg(*last)
        before = Window.partitionBy(by).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
        carried = ends.select(*keys, *[F.last(f"__e_{n}", ignorenulls=True).over(before).alias(f"__c_{n}") for n in others])
        seen = seen.join(carried, keys)
        seen = seen.withColumns({f"__l_{n}": F.coalesce(f"__l_{n}", f"__c_{n}") for n in others})
    return seen.select(*base.columns, *[F.col(f"__l_{n}.{c}").alias(f"{n}_{c}") for n, c in columns])


def timeline(frames: Iterable[DataFrame], by: str = "lift_id", at: str = "ts") -> DataFrame:
    """The distinct times of all frames."""
    out = None
    for df in frames:
        own = df.select(by, at)
        out = own if out is None else out.union(own)
    return out.distinct()


def base_group(groups: Sequence[TagGroup]) -> TagGroup:
    """The group that gives the timeline: that of the smallest buckets, the first of equal ones."""
    return min(groups, key=lambda g: g.bucket_s)


def update_gaps(
    df: DataFrame, tag: str = "tagname", ts: str = "timestamp_utc", per_lift: str | None = None, chunk_s: int = 86_400, accuracy: int | None = None
) -> DataFrame:
    """tagname, n_gaps, median_gap_s, p90_gap_s of the positive times between a tag's rows.

    A tag's rows are worked on in stretches of chunk_s seconds, so that a frequent tag is spread;
    the gaps between stretches come from their first and last times. Percentiles are exact
    (see exact_quantiles), or approximate with an accuracy.
    """
    keys = [tag, *([per_lift] if per_lift else [])]
    rows = df.select(*keys, F.unix_micros(ts).alias("t")).filter("t IS NOT NULL")
    rows = rows.withColumn("chunk", F.floor(F.col("t") / F.lit(chunk_s * 1_000_000)))
    within = rows.select(*keys, (F.col("t") - F.lag("t").over(Window.partitionBy(*keys, "chunk").orderBy("t"))).alias("us"))
    edges = rows.groupBy(*keys, "chunk").agg(F.min("t").alias("first"), F.max("t").alias("last"))
    between = edges.select(*keys, (F.col("first") - F.lag("last").over(Window.partitionBy(*keys).orderBy("chunk"))).alias("us"))
    gaps = within.unionByName(between).filter("us > 0").select(tag, (F.col("us") / 1e6).alias("gap"))
    counts = gaps.groupBy(tag).agg(F.count(F.lit(1)).alias("n_gaps"))
    points = [0.5, 0.9]
    found = gaps.groupBy(tag).agg(F.percentile_approx("gap", points, accuracy).alias("quantiles")) if accuracy else exact_quantiles(gaps, [tag], "gap", points)
    return counts.join(found, tag).select(tag, "n_gaps", F.col("quantiles")[0].alias("median_gap_s"), F.col("quantiles")[1].alias("p90_gap_s"))


def null_runs(matrix: DataFrame, columns: Sequence[str], lift: str = "lift_id", order: str = "bucket_start_unix") -> DataFrame:
    """tagname, lift_id, length of the runs of nulls between two values of a lift's column."""
    long = unpivot(matrix, columns, [lift, order])
    one = Window.partitionBy("tagname", lift).orderBy(order)
    seen = long.withColumn("after", F.count("value").over(one.rowsBetween(Window.unboundedPreceding, 0)))
    total = F.count("value").over(Window.partitionBy("tagname", lift))
    inner = seen.withColumn("all", total).filter("value IS NULL AND after > 0 AND after < all")
    return inner.groupBy("tagname", lift, "after").agg(F.count(F.lit(1)).alias("length")).drop("after")


def gap_statistics(matrix: DataFrame, columns: Sequence[str], size_s: int, lift: str = "lift_id", order: str = "bucket_start_unix") -> DataFrame:
    """Per column: number of inner gaps and their median, p90, p99 (whole buckets), max and mean, in
    seconds; zeros where there is none."""
    names = matrix.sparkSession.createDataFrame([(c,) for c in columns], "tagname string")
    runs = null_runs(matrix, columns, lift, order).groupBy("tagname").agg(
        F.count(F.lit(1)).alias("num_gaps"),
        *[(F.expr(f"percentile(length, {p})").cast("long") * size_s).alias(n) for n, p in (("median_s", 0.5), ("p90_s", 0.9), ("p99_s", 0.99))],
        (F.max("length") * size_s).alias("max_s"),
        (F.avg("length") * size_s).alias("mean_s"),
    )
    return names.join(runs, "tagname", "left").na.fill(0)


def unpivot(matrix: DataFrame, columns: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """keys, tagname, value."""
    return matrix.unpivot(list(keys), [_q(c) for c in columns], "tagname", "value").withColumn("tagname", F.replace(F.col("tagname"), F.lit("`"), F.lit("")))


def missingness(matrix: DataFrame, columns: Sequence[str], lift: str = "lift_id", order: str = "bucket_start_unix") -> DataFrame:
    """Per column: share of nulls (%) before and after a forward fill within lifts, over all rows
    and over the rows in which any column has a value."""
    filled = forward_fill(matrix, columns, lift, order)
    some = F.greatest(*[_q(c).isNotNull() for c in columns], F.lit(False))
    share = lambda c, cond: 100 * F.avg(F.when(cond, _q(c).isNull().cast("double")))

    def stats(df: DataFrame, name: str) -> DataFrame:
        aggregates = [F.struct(F.lit(c).alias("tagname"), share(c, F.lit(True)).alias(f"all_{name}"), share(c, some).alias(f"active_{name}")) for c in columns]
        return df.agg(F.array(*aggregates).alias("r")).select(F.inline("r"))

    return stats(matrix, "before").join(stats(filled, "after"), "tagname")


def health(missing: DataFrame, column: str = "all_after", good: float = 10, ok: float = 25) -> DataFrame:
    """mean_residual and verdict (GOOD, OK, BAD) of a group's columns."""
    mean = missing.agg(F.avg(column).alias("mean_residual"))
    return mean.withColumn("verdict", F.when(F.col("mean_residual") < good, "GOOD").when(F.col("mean_residual") < ok, "OK").otherwise("BAD"))


def activity(columns: Sequence[str], threshold: float) -> Column:
    """Whether any of the scaled columns is further from 0 than the threshold."""
    sizes = [F.abs(_q(c)) for c in columns]
    return (F.greatest(*sizes) if len(sizes) > 1 else sizes[0]) > threshold


def active_groups(columns: Sequence[str]) -> Column:
    """The number of groups active in a row; flags that are null count as not."""
    out = F.lit(0)
    for c in columns:
        out = out + F.coalesce(_q(c).cast("int"), F.lit(0))
    return out


def sequences(df: DataFrame, columns: Sequence[str], length: int, active: str | None = None, lift: str = "lift_id", at: str = "ts") -> DataFrame:
    """lift_id, ts, steps (array of rows), active: for each row with length - 1 rows before it in
    its lift, those and itself; active if any of them is."""
    one = Window.partitionBy(lift).orderBy(at)
    frame = one.rowsBetween(-(length - 1), 0)
    flag = F.max(F.col(active)).over(frame) if active else F.lit(None).cast("int")
    steps = F.collect_list(F.array(*[_q(c).cast("double") for c in columns])).over(frame)
    return df.select(lift, at, steps.alias("steps"), flag.alias("active"), F.row_number().over(one).alias("n")).filter(F.col("n") >= length).drop("n")


def prediction_windows(df: DataFrame, columns: Sequence[str], length: int, active: str, lift: str = "lift_id", at: str = "ts") -> DataFrame:
    """lift_id, ts, steps, target, active: for each row, the length rows before it (x) and itself
    (y). A lift's first rows lack some of them: their x is filled with the lift's first row, which
    doesn't count as active, in lifts of length rows or fewer; in longer lifts they are left out."""
    one = Window.partitionBy(lift).orderBy(at)
    row = F.array(*[_q(c).cast("double") for c in columns])
    before, whole = one.rowsBetween(-length, -1), one.rowsBetween(-length, 0)
    size = F.count(F.lit(1)).over(Window.partitionBy(lift))
    seen = df.select(
        lift, at, F.collect_list(row).over(before).alias("x"), row.alias("target"), F.max(active).over(whole).alias("active"),
        F.first(row).over(one).alias("head"), F.row_number().over(one).alias("n"), size.alias("size"),
    )
    kept = seen.filter((F.col("n") > length) | ((F.col("size") <= length) & (F.col("n") == F.col("size"))))
    steps = F.concat(F.array_repeat("head", F.lit(length) - F.size("x")), F.col("x"))
    return kept.select(lift, at, steps.alias("steps"), "target", "active")


def coverage(matrix: DataFrame, columns: Sequence[str], lift: str = "lift_id", order: str = "bucket_start_unix") -> DataFrame:
    """Per lift: n_tags, n_buckets, first and last bucket, duration_min, expected, observed and
    missing values, their percentages, and lift_quality_flag (>= 95, 80, 60 percent)."""
    present = sum((_q(c).isNotNull().cast("long") for c in columns), F.lit(0).cast("long"))
    rows = matrix.groupBy(lift).agg(
        F.count(F.lit(1)).alias("n_buckets"), F.min(order).alias("first_bucket"), F.max(order).alias("last_bucket"), F.sum(present).alias("observed_values")
    )
    expected = F.col("n_buckets") * len(columns)
    share = F.round(F.col("observed_values") / F.col("expected_values") * 100, 2)
    rows = rows.withColumn("n_tags", F.lit(len(columns))).withColumn("expected_values", expected)
    rows = rows.withColumns(
        {
            "missing_values": F.col("expected_values") - F.col("observed_values"),
            "duration_min": F.round((F.col("last_bucket") - F.col("first_bucket")) / 60, 2),
            "coverage_pct": share,
            "missing_pct": F.round((F.col("expected_values") - F.col("observed_values")) / F.col("expected_values") * 100, 2),
        }
    )
    c = F.col("coverage_pct")
    return rows.withColumn("lift_quality_flag", F.when(c >= 95, "excellent").when(c >= 80, "good").when(c >= 60, "usable_with_caution").otherwise("poor"))
