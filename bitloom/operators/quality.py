"""Data-quality rules over any table; every rule writes rows of one findings table.

(code, severity, pointer, entry, entry_name, message, detail)
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bitloom.operators.scan import ranges_of

COLUMNS = ["code", "severity", "pointer", "entry", "entry_name", "message", "detail"]


def rule(df: DataFrame, code: str, severity: str | Column, where: Column, entry: str, message: str | Column, field: str = "", detail: Column | None = None, name: str | None = None) -> DataFrame:
    """A finding for each row where the condition holds; a null condition finds nothing."""
    text = lambda v: v if isinstance(v, Column) else F.lit(v)
    pointer = F.concat(F.lit("/"), F.col(entry).cast("string"), F.lit(f"/{field}" if field else ""))
    return df.where(where).select(
        F.lit(code).alias("code"), text(severity).alias("severity"), pointer.alias("pointer"), F.col(entry).cast("long").alias("entry"),
        (F.col(name) if name else F.lit("")).alias("entry_name"), text(message).alias("message"), F.coalesce(detail.cast("string") if detail is not None else F.lit(""), F.lit("")).alias("detail"),
    )


def run(passes: list[list[DataFrame]], fatal: DataFrame | None = None, file: Column | None = None) -> DataFrame:
    """All findings of the rules of each pass, with the number of the pass that made them, from 1.

    fatal holds the findings of reading the files; they make pass 0 and end their files: nothing else
    is told of a file that could not be read. `file` tells a finding's file from its columns.
    """
    numbered = [r.select(*COLUMNS).withColumn("pass", F.lit(i)) for i, rules in enumerate(passes, 1) for r in rules]
    every = reduce(DataFrame.unionByName, numbered)
    if fatal is None:
        return every
    first = fatal.select(*COLUMNS).withColumn("pass", F.lit(0))
    ended = first.select(file.alias("_ended")).distinct()
    return first.unionByName(every.withColumn("_file", file).join(ended, F.col("_file") == F.col("_ended"), "left_anti").drop("_file"))


def unknown_keys(df: DataFrame, code: str, entry: str, json: str, known: list[str]) -> DataFrame:
    """Keys of a JSON object that are not in the known list."""
    keys = df.select(entry, F.explode(F.expr(f"json_object_keys({json})")).alias("key")).where(~F.col("key").isin(known))
    return rule(keys, code, "warning", F.lit(True), entry, "unknown key", detail=F.col("key"))


def required(df: DataFrame, code: str, entry: str, kind: str, rules: dict[str, tuple[list[str], list[str]]]) -> DataFrame:
    """By kind: columns that must and columns that must not have a value."""
    found = []
    for k, (must, never) in rules.items():
        found += [rule(df, code, "error", (F.col(kind) == k) & F.col(c).isNull(), entry, "missing", c) for c in must]
        found += [rule(df, code, "warning", (F.col(kind) == k) & F.col(c).isNotNull(), entry, "never read", c) for c in never]
    return reduce(DataFrame.unionByName, found)


def ranges(df: DataFrame, code: str, entry: str, limits: dict[str, tuple[float, float]]) -> DataFrame:
    """Columns that are no number, negative, or outside their limits; first complaint only."""
    found = []
    for c, (low, high) in limits.items():
        v = F.expr(f"try_cast({c} as double)")
        message = F.when(v.isNull(), "not a number").when(v < 0, "negative").when(v < low, "too small").otherwise("too large")
        found.append(rule(df, code, "error", F.col(c).isNotNull() & (v.isNull() | (v < low) | (v > high)), entry, message, c, F.col(c)))
    return reduce(DataFrame.unionByName, found)


def enumeration(df: DataFrame, code: str, entry: str, column: str, members: list[str], default: str) -> DataFrame:
    """Unknown values, with what they read as."""
    return rule(df, code, "warning", ~F.col(column).isin(members), entry, f"unknown, reads as {default}", column, F.col(column))


def membership(df: DataFrame, code: str, entry: str, column: str, stage: str, registry: DataFrame, renamed: DataFrame, complete: bool = True) -> DataFrame:
    """Ids against a registry (stage, id): of another stage (error), renamed (info), unknown (error if the registry is complete)."""
    own = registry.where(F.col("stage") == stage).select(F.col("id").alias("_own"))
    other = registry.where(F.col("stage") != stage).groupBy("id").agg(F.min("stage").alias("_stage")).withColumnRenamed("id", "_other")
    al = renamed.select(F.col("old").alias("_old"), F.col("new").alias("_new"))
    j = df.join(own, F.col(column) == F.col("_own"), "left_anti").join(other, F.col(column) == F.col("_other"), "left").join(al, F.col(column) == F.col("_old"), "left")
    severity = F.when(F.col("_new").isNotNull(), "info").when(F.col("_stage").isNotNull() | F.lit(complete), "error").otherwise("warning")
    message = F.when(F.col("_new").isNotNull(), F.concat(F.lit("renamed to "), F.col("_new"))).when(F.col("_stage").isNotNull(), F.concat(F.lit("belongs to stage "), F.col("_stage"))).otherwise("unknown id")
    return rule(j, code, severity, F.col(column).isNotNull(), entry, message, column, F.col(column))


def orphans(child: DataFrame, code: str, entry: str, key: str, parent: DataFrame, parent_key: str, wrong: DataFrame | None = None) -> DataFrame:
    """Children without a parent; a note when a row of the wrong kind has that key."""
    lost = child.join(parent.select(F.col(parent_key).alias("_p")), F.col(key) == F.col("_p"), "left_anti")
    if wrong is None:
        return rule(lost, code, "error", F.lit(True), entry, "no parent", key, F.col(key))
    noted = lost.join(wrong.select(F.col(parent_key).alias("_w")).distinct(), F.col(key) == F.col("_w"), "left")
    return rule(noted, code, "error", F.lit(True), entry, F.when(F.col("_w").isNotNull(), "parent is of the wrong kind").otherwise("no parent"), key, F.col(key))


def precedes(child: DataFrame, code: str, entry: str, key: str, order: Column, parent: DataFrame, parent_key: str, parent_order: str) -> DataFrame:
    """Children that stand before their parent. Parents are hashed, so a task sorts and holds no children."""
    j = child.withColumn("_o", order).join(parent.select(F.col(parent_key).alias("_p"), F.col(parent_order).alias("_po")).hint("shuffle_hash"), F.col(key) == F.col("_p"))
    return rule(j, code, "error", F.col("_po") > F.col("_o"), entry, "parent comes after", key, F.col(key))


def index_bounds(df: DataFrame, code: str, entry: str, column: str, count: int, bad_kind: DataFrame | None = None, kind_key: str = "") -> DataFrame:
    """-1 is a warning; outside [0, count), the row's own index, and a target of the wrong kind are errors."""
    v = F.col(column)
    bad = F.lit(None).cast("long")
    j = df
    if bad_kind is not None:
        j = df.join(bad_kind.select(F.col(kind_key).alias("_bad")), v == F.col("_bad"), "left")
        bad = F.col("_bad")
    message = F.when(v == -1, "not set").when((v < 0) | (v >= count), "out of range").when(v == F.col(entry), "refers to itself").when(bad.isNotNull(), "target kind not allowed")
    return rule(j, code, F.when(v == -1, "warning").otherwise("error"), message.isNotNull(), entry, message, column, v)


def files(df: DataFrame, code: str, entry: str, path: str, inventory: DataFrame) -> DataFrame:
    """Paths that the inventory (path, length) lacks, and empty files."""
    j = df.join(inventory.select(F.col("path").alias("_path"), F.col("length").alias("_len")), F.col(path) == F.col("_path"), "left")
    message = F.when(F.col("_path").isNull(), "missing").when(F.col("_len") == 0, "empty")
    return rule(j, code, "error", message.isNotNull(), entry, message, path, F.col(path))


def inside(df: DataFrame, code: str, entry: str, offset: Column, length: Column, size: Column) -> DataFrame:
    """Ranges that begin or end past their container; an unknown size finds nothing."""
    message = F.when(offset >= size, "begins past the end").when(offset + length > size, "ends past the end")
    return rule(df, code, "error", message.isNotNull(), entry, message, "offset", offset)


def duplicates(df: DataFrame, code: str, entry: str, key: Column) -> DataFrame:
    """Later rows of a key, with the first row that owns it; owners come of an aggregate, not a window over a hot key."""
    keyed = df.select(entry, key.alias("_k")).where("_k is not null")
    owners = keyed.groupBy("_k").agg(F.min(entry).alias("_first"), F.count("*").alias("_n")).where("_n > 1")
    return rule(keyed.join(owners, "_k"), code, "warning", F.col(entry) != F.col("_first"), entry, "same as an earlier entry", detail=F.col("_first"))


def permutation(df: DataFrame, code: str, entry: str, group: str, source: str, target: str, flags: str | None = None) -> DataFrame:
    """Faults of pair lists: a null or negative member rejects its whole list; slots mapped twice, targets hit twice, flags outside 0..7."""
    bad = df.groupBy(group).agg(F.bool_or(F.col(source).isNull() | F.col(target).isNull() | (F.col(source) < 0) | (F.col(target) < 0)).alias("_fatal")).where("_fatal")
    j = df.where(F.col(group).isNotNull())
    # the windows' tasks are as many as the rows need, whatever size Spark would fuse them to
    parts = ranges_of(df)
    by = lambda c: F.row_number().over(Window.partitionBy(group, c).orderBy(entry)) > 1
    j = j.repartition(parts, group, source).withColumn("_s", by(source)).repartition(parts, group, target).withColumn("_t", by(target))
    # rejected lists come last and are hashed: their number is held, the pairs are neither sorted nor dealt again
    j = j.join(bad.hint("shuffle_hash"), group, "left")
    message = F.when(F.col("_fatal"), "list rejected").when(F.col("_s"), "slot mapped twice").when(F.col("_t"), "two slots to one target")
    if flags:
        message = message.when(~F.col(flags).between(0, 7), "flags out of range")
    return rule(j, code, "error", message.isNotNull(), entry, message, "", F.concat_ws("->", source, target))


def agreement(df: DataFrame, code: str, entry: str, needs: Column, has: Column, what: str) -> DataFrame:
    """A mode without its block (error), a block without its mode (warning)."""
    severity = F.when(needs & ~has, "error").otherwise("warning")
    message = F.when(needs & ~has, f"{what} is missing").otherwise(f"{what} is never read")
    return rule(df, code, severity, needs != has, entry, message)


def same_lists(parent: DataFrame, child: DataFrame, code: str, key: str, entry: str) -> DataFrame:
    """Groups whose ordered lists (column items) differ."""
    j = parent.select(key, F.col("items").alias("_p")).join(child.select(key, entry, "items"), key)
    return rule(j, code, "error", F.col("_p") != F.col("items"), entry, "lists differ")
