"""Profiles of tables and comparisons of two populations, each in one pass over the data."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def classify_columns(df: DataFrame) -> dict[str, list[str]]:
    """numeric, categorical (string, boolean), time and other columns, from the schema."""
    out: dict[str, list[str]] = {"numeric": [], "categorical": [], "time": [], "other": []}
    for f in df.schema:
        kind = f.dataType
        if isinstance(kind, T.NumericType):
            out["numeric"].append(f.name)
        elif isinstance(kind, T.StringType | T.BooleanType):
            out["categorical"].append(f.name)
        elif isinstance(kind, T.TimestampType | T.TimestampNTZType | T.DateType):
            out["time"].append(f.name)
        else:
            out["other"].append(f.name)
    return out


def numeric_only(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame | None:
    """The keys and the numeric columns of df; None, so that a group is skipped, if no others are numeric."""
    columns = [c for c in classify_columns(df)["numeric"] if c not in keys]
    return df.select(*[F.col(f"`{c}`") for c in (*keys, *columns)]) if columns else None


def first_present(df: DataFrame, candidates: Sequence[str]) -> str | None:
    """The first of candidates that df has."""
    return next((c for c in candidates if c in df.columns), None)


def with_columns_of(df: DataFrame, expected: Sequence[str], kind: str = "double") -> DataFrame:
    """expected columns in their order, nulls for those that df lacks."""
    return df.select(*[F.col(f"`{c}`") if c in df.columns else F.lit(None).cast(kind).alias(c) for c in expected])


def missing_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """column, rows, missing, missing_pct of each column."""
    columns = list(columns or df.columns)
    counts = df.agg(F.count(F.lit(1)).alias("__rows"), *[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in columns])
    long = counts.unpivot("__rows", [F.col(f"`{c}`") for c in columns], "column", "missing")
    pct = F.round(100 * F.try_divide(F.col("missing"), F.col("__rows")), 3)
    return long.select("column", F.col("__rows").alias("rows"), "missing", pct.alias("missing_pct"))


def numeric_profile(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """by, tagname, rows, non_null_count, null_count, null_pct, min, max, mean, stddev of each column."""
    long = df.unpivot(list(by), [F.col(f"`{c}`").cast("double").alias(c) for c in columns], "tagname", "value")
    return long_profile(long, [*by, "tagname"])


def long_profile(long: DataFrame, by: Sequence[str], value: str = "value") -> DataFrame:
    v = F.col(value)
    out = long.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows"), F.count(v).alias("non_null_count"), F.count_if(v.isNull()).alias("null_count"),
        F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("stddev"),
    )
    return out.withColumn("null_pct", F.round(F.col("null_count") / F.col("rows") * 100, 3))


def shares(df: DataFrame, by: str, count: str = "count") -> DataFrame:
    """by, count, share of all."""
    counts = df.groupBy(by).agg(F.count(F.lit(1)).alias(count))
    return counts.withColumn("share", F.col(count) / F.sum(count).over(Window.partitionBy()))


def compare_categories(train: DataFrame, test: DataFrame, column: str) -> DataFrame:
    """value, train and test counts and percentages, and their difference, over a full join: a null
    category comes once for each side."""
    side = lambda df, n: df.groupBy(F.col(column).cast("string").alias("value")).agg(F.count(F.lit(1)).alias(f"{n}_count")).withColumn(f"{n}_share", F.col(f"{n}_count") / F.sum(f"{n}_count").over(Window.partitionBy()))
    both = side(train, "train").join(side(test, "test"), "value", "full").na.fill(0)
    pct = lambda n: F.round(F.col(f"{n}_share") * 100, 3).alias(f"{n}_pct")
    return both.select(F.lit(column).alias("column"), "value", "train_count", pct("train"), "test_count", pct("test"), F.round(F.abs(F.col("test_share") - F.col("train_share")) * 100, 3).alias("abs_pct_diff"))


def lift_overlap(train: DataFrame, test: DataFrame, key: str = "lift_id") -> DataFrame:
    """check, value, status: the lifts that are in both; none should be."""
    both = train.select(key).distinct().join(test.select(key).distinct(), key, "left_semi").agg(F.count(F.lit(1)).alias("value"))
    return both.select(F.lit("lift_leakage").alias("check"), "value", F.when(F.col("value") == 0, "PASS").otherwise("FAIL").alias("status"))


def _status(train: Column, test: Column) -> Column:
    return F.when((train > 0) & (test > 0), "present_in_both").when((train > 0) & (test == 0), "missing_in_test").when((train == 0) & (test > 0), "new_in_test").otherwise("unknown")


def tag_comparison(train: DataFrame, test: DataFrame, tag: str = "tagname", lift: str = "lift_id") -> DataFrame:
    """Per tag: counts, lifts, percentages of both populations, their difference and ratio,
    coverage_status and tag_shift_flag. Both populations go through one aggregate."""
    side = F.col("side")
    rows = train.select(tag, lift, F.lit(0).alias("side")).unionByName(test.select(tag, lift, F.lit(1).alias("side")))
    agg = rows.groupBy(tag).agg(
        F.count_if(side == 0).alias("train_count"), F.count_if(side == 1).alias("test_count"),
        F.count_distinct(F.when(side == 0, F.col(lift))).alias("train_lifts"), F.count_distinct(F.when(side == 1, F.col(lift))).alias("test_lifts"),
    )
    whole = Window.partitionBy()
    a, b = (F.coalesce(F.try_divide(F.col(f"{n}_count"), F.sum(f"{n}_count").over(whole)), F.lit(0.0)) for n in ("train", "test"))
    out = agg.withColumns({"train_prop": a, "test_prop": b})
    diff = F.round((F.col("test_prop") - F.col("train_prop")) * 100, 4)
    out = out.withColumns({"coverage_status": _status(F.col("train_count"), F.col("test_count")), "prop_diff_pct": diff})
    size = F.abs("prop_diff_pct")
    flag = F.when(F.col("coverage_status") != "present_in_both", "coverage_issue").when(size >= 1.0, "large_proportion_shift").when(size >= 0.1, "moderate_proportion_shift").otherwise("similar_proportion")
    ratio = F.round(F.try_divide(F.col("test_count"), F.col("train_count")), 6)
    return out.select(
        tag, "coverage_status", flag.alias("tag_shift_flag"), "train_count", F.round(F.col("train_prop") * 100, 4).alias("train_pct"), "train_lifts",
        "test_count", F.round(F.col("test_prop") * 100, 4).alias("test_pct"), "test_lifts", "prop_diff_pct", ratio.alias("test_train_count_ratio"),
    )


def before_after(before: DataFrame, after: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The profiles of a table before and after a step, side by side, with what the step filled."""
    names = ("rows", "null_pct", "mean", "stddev")
    b = before.select(*keys, *[F.col(n).alias(f"{n}_before") for n in names])
    a = after.select(*keys, *[F.col(n).alias(f"{n}_after") for n in names])
    return b.join(a, list(keys)).withColumn("null_pct_reduction", F.round(F.col("null_pct_before") - F.col("null_pct_after"), 3))


def train_vs_test(profile: DataFrame, dataset: str = "dataset", keys: Sequence[str] = ("tagname",)) -> DataFrame:
    """The rows of dataset = training and test of a profile side by side: conditional aggregates in
    the place of a self join."""
    pick = lambda side, c: F.max(F.when(F.col(dataset) == side, F.col(c))).alias(f"{side}_{c}")
    out = profile.groupBy(*keys).agg(*[pick(s, c) for c in ("null_pct", "mean", "stddev") for s in ("training", "test")])
    return out.withColumn("null_pct_difference", F.round(F.col("test_null_pct") - F.col("training_null_pct"), 3))


def conclusion(checks: Sequence[tuple[str, DataFrame, str, str]]) -> DataFrame:
    """check, value, status, interpretation. A check: name, a table of one number, what a number
    over 0 means (FAIL, WARN; INFO: always) and the interpretation."""
    out = None
    for name, value, over, text in checks:
        v = F.col(value.columns[0]).cast("long")
        status = F.lit("INFO") if over == "INFO" else F.when(v > 0, over).otherwise("PASS")
        row = value.select(F.lit(name).alias("check"), v.alias("value"), status.alias("status"), F.lit(text).alias("interpretation"))
        out = row if out is None else out.unionByName(row)
    return out


def raw_and_deduplicated(df: DataFrame, category: str, key: str) -> DataFrame:
    """category, raw_count, deduplicated_count (one row per key: that of the smallest category), share."""
    first = df.groupBy(key).agg(F.min(category).alias(category)).groupBy(category).agg(F.count(F.lit(1)).alias("deduplicated_count"))
    raw = df.groupBy(category).agg(F.count(F.lit(1)).alias("raw_count"))
    both = raw.join(first, category, "full").na.fill(0, ["raw_count", "deduplicated_count"])
    return both.withColumn("share", F.col("raw_count") / F.sum("raw_count").over(Window.partitionBy()))


def file_distance(df: DataFrame, file: str, category: str, min_rows: int = 100) -> DataFrame:
    """file, rows, distance: Euclidean distance of each file's shares of categories from those of
    all files, nearest first; files with fewer rows are left out. Null categories don't count."""
    rows = df.filter(F.col(category).isNotNull())
    full = shares(rows, category, "full_count").select(category, F.col("share").alias("full_share"))
    own = rows.groupBy(file, category).agg(F.count(F.lit(1)).alias("n")).withColumn("rows", F.sum("n").over(Window.partitionBy(file)))
    own = own.filter(F.col("rows") >= min_rows).withColumn("own_share", F.col("n") / F.col("rows"))
    # categories that a file lacks add their full share: all of full_share ** 2, less those it has
    both = own.join(full, category)
    square = full.agg(F.sum(F.col("full_share") * F.col("full_share")).alias("square"))
    part = both.groupBy(file, "rows").agg(F.sum(F.pow(F.col("own_share") - F.col("full_share"), 2) - F.pow("full_share", 2)).alias("d"))
    return part.crossJoin(F.broadcast(square)).select(file, "rows", F.sqrt(F.greatest(F.col("d") + F.col("square"), F.lit(0.0))).alias("distance")).orderBy("distance", file)


def pareto(df: DataFrame, by: str, tops: Sequence[int] = (6, 10, 30)) -> DataFrame:
    """by, count, rank (by count, then name), share, cumulative_share."""
    order = Window.orderBy(F.desc("count"), by)
    ranked = shares(df, by).withColumn("rank", F.row_number().over(order))
    return ranked.withColumn("cumulative_share", F.sum("share").over(order.rowsBetween(Window.unboundedPreceding, 0)))


def pareto_summary(ranked: DataFrame, share: float = 0.8, tops: Sequence[int] = (6, 10, 30)) -> DataFrame:
    """The rank that reaches share, and the shares of the first tops."""
    return ranked.agg(
        F.min(F.when(F.col("cumulative_share") >= share - 1e-12, F.col("rank"))).alias("rank_reaching"),
        *[F.sum(F.when(F.col("rank") <= k, F.col("share"))).alias(f"top{k}_share") for k in tops],
    )


def histogram(df: DataFrame, value: str, edges: Sequence[float], labels: Sequence[str], weight: str | None = None) -> DataFrame:
    """bin, label, n, total (of weight), shares: bins closed on the left, the last one open; empty
    bins stay. The bins are a table of fixed size."""
    spark = df.sparkSession
    table = spark.createDataFrame(list(enumerate(labels, 1)), "bin int, label string")
    number = F.lit(None).cast("int")
    for i, low in enumerate(edges, 1):
        number = F.when(F.col(value) >= low, F.lit(i)).otherwise(number) if i == 1 else F.when(F.col(value) >= low, F.lit(i)).otherwise(number)
    counted = df.withColumn("bin", number).groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(weight) if weight else F.lit(1)).alias("total"))
    out = table.join(counted, "bin", "left").na.fill(0, ["n", "total"])
    whole = Window.partitionBy()
    return out.withColumns({"n_share": F.try_divide(F.col("n"), F.sum("n").over(whole)), "total_share": F.try_divide(F.col("total"), F.sum("total").over(whole))})


MAGNITUDES = ((0, 1_000, 10_000, 100_000, 1_000_000, 10_000_000), ("<1k", "1k-10k", "10k-100k", "100k-1M", "1M-10M", ">10M"))


def subsystem_rollup(df: DataFrame, tag: str = "tagname") -> DataFrame:
    """source, subsystem, label, n_tags, n_observations and their shares, from dotted tag names."""
    per_tag = df.groupBy(tag).agg(F.count(F.lit(1)).alias("n"))
    parts = F.split(tag, r"\.")
    per = per_tag.withColumns({"source": F.get(parts, 0), "subsystem": F.get(parts, 1)}).groupBy("source", "subsystem")
    out = per.agg(F.count(F.lit(1)).alias("n_tags"), F.sum("n").alias("n_observations"))
    whole = Window.partitionBy()
    return out.withColumns(
        {
            "label": F.when(F.col("source") == "Sys", F.col("subsystem")).otherwise(F.concat_ws("/", "source", "subsystem")),
            "tag_share": F.col("n_tags") / F.sum("n_tags").over(whole),
            "observation_share": F.col("n_observations") / F.sum("n_observations").over(whole),
        }
    )
