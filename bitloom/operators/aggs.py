"""Aggregations, rankings and states of groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bitloom.sources.shared import stored


def trim_trailing(df: DataFrame, keys: list[str], index: str, filled: Column) -> DataFrame:
    """Rows up to each group's last filled one, holes included; at least the first row stays.

    The last places are an aggregate of one row a group, so a group of any size is summed up before the
    shuffle and its rows are joined back from many tasks.
    """
    last = df.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(F.coalesce(F.max(F.when(filled, F.col(index))), F.min(index)).alias("_last"))
    joined = df.join(last, [df[k].eqNullSafe(last[f"_k{i}"]) for i, k in enumerate(keys)])
    return joined.where(F.col(index) <= F.col("_last")).select(*[df[c] for c in df.columns])


def first_of(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in order; partial aggregation does most of it before any shuffle."""
    rest = [c for c in df.columns if c not in key and c not in order]
    return df.groupBy(*key).agg(F.min(F.struct(*order, *rest)).alias("_f")).select(*key, *[F.col(f"_f.{c}").alias(c) for c in [*order, *rest]])


def checksums(df: DataFrame, keys: list[str], value: str, index: str | None = None, header: tuple[int, int] | None = None, stored_at: int | None = None) -> DataFrame:
    """(keys, header, total): (-sum(b + 1)) mod 256 and the 16-bit sum of bytes.

    With an index column, `header` limits the first sum to [from, to), and `stored_at` is where the
    16-bit sum itself is kept, high byte first: its two bytes stay out of the sum, and the result has
    stored and matches as well (null where the bytes are not there).
    """
    v = F.col(value)
    inside = F.col(index).between(header[0], header[1] - 1) if header else F.lit(True)
    own = F.col(index).isin(stored_at, stored_at + 1) if stored_at is not None else F.lit(False)
    sums = [F.pmod(-F.coalesce(F.sum(F.when(inside, v + 1)), F.lit(0)), F.lit(256)).alias("header"), F.pmod(F.coalesce(F.sum(F.when(~own, v)), F.lit(0)), F.lit(65536)).alias("total")]
    if stored_at is None:
        return df.groupBy(*keys).agg(*sums)
    at = lambda i: F.max(F.when(F.col(index) == i, v))
    return df.groupBy(*keys).agg(*sums, (at(stored_at) * 256 + at(stored_at + 1)).alias("stored")).withColumn("matches", F.col("stored") == F.col("total"))


def ranked(df: DataFrame, order: list[str]) -> DataFrame:
    """df with place, its rank from 1 in a total order, without one task for all rows.

    Rows are range-partitioned and numbered within their partition; the few partition counts are
    summed up and joined back.
    """
    parted = stored(df.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()), "ranges")
    local = parted.withColumn("_n", F.row_number().over(Window.partitionBy("_p").orderBy(*order)))
    sizes = parted.groupBy("_p").agg(F.count("*").alias("_c"))
    before = sizes.select("_p", F.coalesce(F.sum("_c").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_b"))
    return local.join(before, "_p").withColumn("place", F.col("_b") + F.col("_n")).drop("_p", "_n", "_b")


def select_codes(df: DataFrame, column: str, ranks: dict[str, int], threshold: int, select: list[str], ignore: list[str]) -> DataFrame:
    """Rows up to a rank whose code begins with one of `select` (all, if none) and none of `ignore`."""
    up = F.upper(column)
    some = lambda ps: F.greatest(*[up.startswith(p.upper()) for p in ps], F.lit(False))
    kept = df.where(F.col(column).isin([k for k, v in ranks.items() if v <= threshold]))
    kept = kept.where(some(select)) if select else kept
    return kept.where(~some(ignore)) if ignore else kept


def dirty(log: DataFrame, key: str, seq: str, action: str, rev: str) -> DataFrame:
    """(key, current, saved, dirty): the last edited and the last saved revision differ."""
    current = F.max_by(F.when(F.col(action).isin("edit", "undo"), F.col(rev)), F.when(F.col(action).isin("edit", "undo"), F.col(seq)))
    saved = F.max_by(F.when(F.col(action) == "save", F.col(rev)), F.when(F.col(action) == "save", F.col(seq)))
    return log.groupBy(key).agg(current.alias("current"), saved.alias("saved")).withColumn("dirty", ~F.col("current").eqNullSafe(F.col("saved")) & F.col("current").isNotNull())


def sequence_totals(steps: DataFrame, keys: list[str], amount: str, unknown: Column) -> DataFrame:
    """(keys, ticks, unknown, steps): the sum of the steps' amounts, how many name something unknown, and all."""
    return steps.groupBy(*keys).agg(F.sum(amount).alias("ticks"), F.count_if(unknown).alias("unknown"), F.count("*").alias("steps"))


def geometry(units: DataFrame, keys: list[str], size: str, pixels: int, per_row: int, unit: int, limit: int) -> DataFrame:
    """(keys, bpp, capacity, read_size, row_count) of the units of a key.

    Bits a pixel of as many bytes as there are units, whole rows of them, their sizes rounded up to a
    unit, and the rows they take, one at least and those of `limit` at most.
    """
    n = F.count("*")
    rows = F.greatest(F.lit(1), F.least(F.ceil(n / per_row), F.lit(limit // per_row)))
    return units.groupBy(*keys).agg(
        F.ceil(n * 8 / pixels).cast("double").alias("bpp"), (F.floor(n / per_row) * per_row).alias("capacity"),
        (F.ceil(F.sum(size) / unit) * unit).cast("double").alias("read_size"), rows.cast("double").alias("row_count"),
    )


def first_from(df: DataFrame, keys: list[str], index: str, start: int, found: Column) -> DataFrame:
    """(keys, first): the least index from `start` on where `found` holds."""
    return df.where((F.col(index) >= start) & found).groupBy(*keys).agg(F.min(index).alias("first"))


def compare_sets(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """One row (left_only, right_only, left_repeats): keys of one side alone, and keys that the left has several times."""
    a = left.groupBy(key).agg(F.count("*").alias("_n"))
    both = a.join(right.select(key).distinct().withColumn("_there", F.lit(True)), key, "full_outer")
    return both.agg(F.count_if(F.col("_there").isNull()).alias("left_only"), F.count_if(F.col("_n").isNull()).alias("right_only"), F.count_if(F.col("_n") > 1).alias("left_repeats"))


def kinds_of_both(left: DataFrame, right: DataFrame, kind: str) -> DataFrame:
    """(kind): the kinds that both sides allow."""
    return left.select(kind).intersect(right.select(kind))


def page_width(columns: int, rows: int, pages: Column) -> Column:
    """Pages side by side, of the divisors of their number, that come closest to a square; ties to the wider."""
    divisors = F.filter(F.sequence(F.lit(1).cast("long"), pages), lambda a: pages % a == 0)

    def badness(a: Column) -> Column:
        w, h = a * columns, pages / a * rows
        return F.struct((F.greatest(w, h) / F.least(w, h)).alias("ratio"), (-a).alias("wide"))

    return -F.array_min(F.transform(divisors, badness))["wide"]


def with_notices(df: DataFrame, rules: list[tuple[str, str, str, Column]]) -> DataFrame:
    """df with notices, an array of (level, summary, detail, source) of the rules that hold, in their order."""
    made = [F.when(cond, F.struct(F.lit(level).alias("level"), F.lit(summary).alias("summary"), F.lit("").alias("detail"), F.lit(source).alias("source"))) for level, summary, source, cond in rules]
    return df.withColumn("notices", F.filter(F.array(*made), lambda n: n.isNotNull()))


def rollup(df: DataFrame, severity: str, ranks: dict[str, int], threshold: str) -> DataFrame:
    """(severity, n, worst, failed): counts with zeros, the worst severity present, any at or above the threshold."""
    spark = df.sparkSession
    dims = spark.createDataFrame(list(ranks.items()), "severity string, rank int")
    counts = df.groupBy(F.col(severity).alias("severity")).agg(F.count("*").alias("n"))
    out = dims.join(counts, "severity", "left").select("severity", "rank", F.coalesce("n", F.lit(0)).alias("n"))
    w = Window.partitionBy()
    worst = F.min_by("severity", F.when(F.col("n") > 0, F.col("rank"))).over(w)
    failed = F.bool_or((F.col("n") > 0) & (F.col("rank") <= ranks[threshold])).over(w)
    return out.select("severity", "n", worst.alias("worst"), failed.alias("failed"))
