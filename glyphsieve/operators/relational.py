"""Joins by order and by range, set operations, cubes and dates: what audits over time and over groups are put together from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof_join(left: DataFrame, right: DataFrame, key: str, at: str, values: list[str], width: int = 86_400) -> DataFrame:
    """``left`` with the ``values`` of the last row of ``right`` of the same key at the same time or before; null where there is none.

    Of rows of ``right`` with one time the largest values count. Times fall into spans of ``width`` seconds: a task goes through one span
    of a key, and gets the last row before it from a window over the spans, a row each. So a key of any size is spread over its spans.
    Rows without a key or a time find nothing.
    """
    span = F.floor(F.unix_seconds(F.col(at).cast("timestamp")) / width)
    seen = F.struct(F.col(at), *values)
    rights = right.where(F.col(key).isNotNull() & F.col(at).isNotNull()).select(F.col(key).alias("__key"), F.col(at).alias("__at"), span.alias("__span"), seen.alias("__right"), F.lit(0).alias("__side"))
    lefts = left.select(F.col(key).alias("__key"), F.col(at).alias("__at"), span.alias("__span"), F.struct("*").alias("__left"), F.lit(1).alias("__side"))
    both = rights.unionByName(lefts, allowMissingColumns=True)
    before = Window.partitionBy("__key", "__span").orderBy("__at", "__side", "__right").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    near = both.withColumn("__found", F.last("__right", ignorenulls=True).over(before)).where("__side = 1")
    spans = both.groupBy("__key", "__span").agg(F.max("__right").alias("__last"))
    earlier = F.last("__last", ignorenulls=True).over(Window.partitionBy("__key").orderBy("__span").rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.select(F.col("__key").alias("__k"), F.col("__span").alias("__s"), earlier.alias("__carried"))
    out = near.join(spans, near["__key"].eqNullSafe(spans["__k"]) & near["__span"].eqNullSafe(spans["__s"]))
    held = F.when(F.col("__key").isNotNull() & F.col("__at").isNotNull(), F.coalesce("__found", "__carried"))
    return out.select("__left.*", *[held[v].alias(v) for v in values])


def range_join(points: DataFrame, ranges: DataFrame, at: str, low: str, high: str, width: float) -> DataFrame:
    """Pairs of a point and a range with ``low <= at < high``, both sides' columns.

    Values fall into bins of ``width``; a range has a row per bin that it reaches into, so each point meets the ranges of its bin only.
    A width near the ranges' usual length is best. Rows without a value or a bound find nothing.
    """
    bin_of = lambda c: F.floor(c.cast("double") / width)
    bins = F.sequence(bin_of(F.col(low)), bin_of(F.col(high)))
    dealt = ranges.where(F.col(low) < F.col(high)).withColumn("__bin", F.explode(bins))
    return points.withColumn("__bin", bin_of(F.col(at))).join(dealt, "__bin").where((F.col(at) >= F.col(low)) & (F.col(at) < F.col(high))).drop("__bin")


def range_totals(points: DataFrame, ranges: DataFrame, at: str, low: str, high: str, value: str, width: float) -> DataFrame:
    """``ranges`` with ``n`` and ``total`` of the points with ``low <= at < high``, whose ``value`` is summed up; ranges without points are left out.

    No pairs are made: points are added up by time, a bin of ``width`` is gone through once for the sums before each bound in it, and a range is
    the bins from its lower bound's on to before its upper bound's, less what lies before the one bound in its bin, with what lies before the other.
    So the work goes with points and ranges, however many of them meet. A width near the ranges' usual length or below is best.
    """
    bin_of = lambda c: F.floor(c.cast("double") / width)
    v = F.col(value).cast("double")
    odd = {"__nan": F.isnan(v), "__up": v == float("inf"), "__down": v == float("-inf")}
    finite = v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
    each = {"n": F.count(F.lit(1)), "__valued": F.count(v), "total": F.coalesce(F.sum(F.when(finite, v)), F.lit(0.0)), **{k: F.count_if(c) for k, c in odd.items()}}
    times = points.where(F.col(at).isNotNull()).groupBy(F.col(at).alias("__t")).agg(*[c.alias(k) for k, c in each.items()]).withColumn("__bin", bin_of(F.col("__t")))
    pairs = ranges.where(F.col(low) < F.col(high)).select(F.col(low).alias("__low"), F.col(high).alias("__high")).distinct()
    bounds = pairs.select(F.explode(F.array("__low", "__high")).alias("__t")).distinct().withColumn("__bin", bin_of(F.col("__t"))).withColumn("__side", F.lit(0))
    before = Window.partitionBy("__bin").orderBy("__t", "__side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = times.withColumn("__side", F.lit(1)).unionByName(bounds, allowMissingColumns=True)
    sums = both.select("__side", F.lit(1).alias("__kind"), F.col("__t").cast("double").alias("__k"), *[F.sum(k).over(before).alias(k) for k in each]).where("__side = 0").drop("__side")
    bins = times.groupBy("__bin").agg(*[F.sum(k).alias(k) for k in each]).select(F.lit(0).alias("__kind"), F.col("__bin").cast("double").alias("__k"), *each)
    part = lambda kind, k, sign: F.struct(F.lit(kind).alias("__kind"), k.cast("double").alias("__k"), F.lit(sign).alias("__sign"))
    first, last = bin_of(F.col("__low")), bin_of(F.col("__high"))
    whole = F.when(first < last, F.transform(F.sequence(first, F.greatest(first, last - 1)), lambda b: part(0, b, 1))).otherwise(F.array().cast("array<struct<__kind:int,__k:double,__sign:int>>"))
    parts = pairs.select("__low", "__high", F.explode(F.concat(whole, F.array(part(1, F.col("__low"), -1), part(1, F.col("__high"), 1)))).alias("p")).select("__low", "__high", "p.*")
    found = parts.join(bins.unionByName(sums), ["__kind", "__k"]).groupBy("__low", "__high").agg(*[F.coalesce(F.sum(F.col("__sign") * F.col(k)), F.lit(0)).alias(k) for k in each]).where("n > 0")
    total = F.when(F.col("__valued") == 0, None).when((F.col("__nan") > 0) | (F.col("__up") > 0) & (F.col("__down") > 0), float("nan")).when(F.col("__up") > 0, float("inf")).when(F.col("__down") > 0, float("-inf")).otherwise(F.col("total"))
    found = found.select("__low", "__high", F.col("n").cast("long").alias("n"), total.alias("total"))
    return ranges.join(found, (F.col(low) == F.col("__low")) & (F.col(high) == F.col("__high"))).drop("__low", "__high")


def shared_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct rows that both have, and which only one of them has: ``side`` is both, first or second."""
    side = lambda df, name: df.withColumn("side", F.lit(name))
    return side(a.intersect(b), "both").unionByName(side(a.subtract(b), "first")).unionByName(side(b.subtract(a), "second"))


def counts_cube(rows: DataFrame, *by: str) -> DataFrame:
    """Counts for each combination of the columns and of any subset of them, which ``level`` numbers by the columns left out."""
    return rows.cube(*by).agg(F.grouping_id().alias("level"), F.count(F.lit(1)).alias("n"))


def merged_counts(a: Column, b: Column) -> Column:
    """Two maps of counts added up by key."""
    return F.map_from_entries(F.array_sort(F.map_entries(F.map_zip_with(*[F.coalesce(x, F.create_map().cast("map<string,bigint>")) for x in (a, b)], lambda _, x, y: F.coalesce(x, F.lit(0)) + F.coalesce(y, F.lit(0))))))


def pdf_date(at: Column) -> Column:
    """``D:YYYYMMDDHHmmSS+00'00'`` in UTC."""
    return F.concat(F.lit("D:"), F.date_format(F.to_utc_timestamp(at.cast("timestamp"), F.current_timezone()), "yyyyMMddHHmmss"), F.lit("+00'00'"))


def from_pdf_date(text: Column) -> Column:
    """The time that a date of that form says, with any offset; parts from the month on may be missing. Null for other texts."""
    part = lambda k, rest: F.when(F.regexp_extract(text, _PDF_DATE, k) != "", F.regexp_extract(text, _PDF_DATE, k)).otherwise(rest)
    plain = F.concat(part(1, ""), F.lit("-"), part(2, "01"), F.lit("-"), part(3, "01"), F.lit(" "), part(4, "00"), F.lit(":"), part(5, "00"), F.lit(":"), part(6, "00"))
    zone = F.when(F.regexp_extract(text, _PDF_DATE, 7).isin("+", "-"), F.concat(part(7, "+"), part(8, "00"), F.lit(":"), part(9, "00"))).otherwise("+00:00")
    return F.when(F.regexp_like(text, F.lit(_PDF_DATE)), F.try_to_timestamp(F.concat(plain, zone), F.lit("yyyy-MM-dd HH:mm:ssXXX")))


_PDF_DATE = r"^D:([0-9]{4})([0-9]{2})?([0-9]{2})?([0-9]{2})?([0-9]{2})?([0-9]{2})?(?:([-+Z])(?:([0-9]{2})'?(?:([0-9]{2})'?)?)?)?$"
