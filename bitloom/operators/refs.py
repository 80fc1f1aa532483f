"""References between tables: resolution, overlays, repair, worklists and ranges of legal ids."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def resolve(cells: DataFrame, index: str, bank: DataFrame, key: str, blanks: dict[str, Column], base: int = 0) -> DataFrame:
    """cells with the columns of the bank row that base + index names; a miss takes the blanks."""
    held = bank.select(F.col(key).alias("_key"), *blanks)
    joined = cells.join(held, F.col(index) + base == F.col("_key"), "left")
    return joined.select(*cells.columns, *[F.coalesce(F.col(c), b).alias(c) for c, b in blanks.items()])


def legal_range(base: int, count: Column, limit: int | None = None) -> tuple[Column, Column]:
    """Ids [from, to) whose base + id lies in a bank of `count`, cut by limit + 1."""
    top = count - base
    return F.greatest(F.lit(0), F.lit(-base)), F.least(top, F.lit(limit + 1)) if limit is not None else top


def aligned(id_: Column, offset: int, stride: int, across: int, down: int) -> Column:
    """Is the id at a corner of the unit grid."""
    at = id_ + offset
    return (F.pmod(F.pmod(at, F.lit(stride)), F.lit(across)) == 0) & (F.pmod(F.floor(at / stride), F.lit(down)) == 0)


def overlay(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """Union by key in which rows of the second table win."""
    return first.join(second.select(key).distinct(), key, "left_anti").unionByName(second)


def shift_codes(df: DataFrame, code: str, base: int, digits: int) -> DataFrame:
    """Codes moved by base; those outside 0 .. 16**digits - 1 drop."""
    return df.withColumn(code, F.col(code) + base).where(F.col(code).between(0, 16**digits - 1))


def missing_keys(references: list[DataFrame], inventory: DataFrame, key: str, order: str) -> DataFrame:
    """(key, first_seen) of references whose key the inventory lacks, once each."""
    every = reduce(DataFrame.unionByName, [r.select(key, order) for r in references])
    return every.groupBy(key).agg(F.min(order).alias("first_seen")).join(inventory.select(key).distinct(), key, "left_anti")


def repoint(df: DataFrame, column: str, mapping: DataFrame, name: str | None = None) -> DataFrame:
    """Old keys replaced through (old, new); where the row's name was the old key, it follows."""
    m = mapping.select(F.col("old").alias("_old"), F.col("new").alias("_new"))
    joined = df.join(m, F.col(column) == F.col("_old"), "left")
    out = {column: F.coalesce("_new", column)}
    if name:
        out[name] = F.when(F.col("_new").isNotNull() & (F.col(name) == F.col(column).cast("string")), F.col("_new").cast("string")).otherwise(F.col(name))
    return joined.select(*[out.get(c, F.col(c)).alias(c) for c in df.columns])


def bulk_export(parents: DataFrame, parent: str, children: DataFrame, child: str, of: str, names: tuple[str, str]) -> DataFrame:
    """(kind, id): all children, and the parents that have none; names are the two kinds, parents' first."""
    bare = parents.join(children, parents[parent] == children[of], "left_anti")
    return bare.select(F.lit(names[0]).alias("kind"), F.col(parent).alias("id")).unionByName(children.select(F.lit(names[1]).alias("kind"), F.col(child).alias("id")))


def parents_by_key(df: DataFrame, id_: str, key: str) -> DataFrame:
    """(id, key, parent) of the rows that are not the first of their key, which is their parent."""
    parents = df.groupBy(key).agg(F.min(id_).alias("parent"))
    return df.select(id_, key).join(parents, key).where(F.col(id_) != F.col("parent")).select(id_, key, "parent")


def consumers(bank: DataFrame, key: str, cells: DataFrame, reference: str, exempt: Column) -> DataFrame:
    """(key, consumers, others) of bank rows that are referred to: how many cells do, and how many of them are not exempt."""
    used = cells.groupBy(reference).agg(F.count("*").alias("consumers"), F.count_if(~exempt).alias("others"))
    return bank.join(used, bank[key] == used[reference]).select(key, "consumers", "others")


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\\\]*)$", 1)


def repoint_all(df: DataFrame, id_: str, mapping: DataFrame, columns: list[str], arrays: list[str] = (), named: tuple[str, str, Column] | None = None) -> DataFrame:
    """df with touched: old keys replaced through (old, new) in every reference column and every array of references.

    Each reference moves for itself. named = (name, column, applies): where `applies` holds and the name
    was the file name of that column's old key, it becomes that of the new one; a name given by hand
    stays. Keys of `mapping` are unique. An array's elements are joined one by one and put back in order.
    """
    m = mapping.select(F.col("old").alias("_old"), F.col("new").alias("_new"))
    out, moved = df, []
    for i, c in enumerate(columns):
        out = out.join(m.withColumnsRenamed({"_old": f"_old{i}", "_new": f"_new{i}"}), F.col(c) == F.col(f"_old{i}"), "left")
        moved.append(F.col(f"_new{i}").isNotNull())
    for i, c in enumerate(arrays):
        each = df.where(F.size(c) > 0).select(F.col(id_).alias(f"_id{i}"), F.posexplode(c).alias("_p", "_v")).join(m, F.col("_v") == F.col("_old"), "left")
        put = F.transform(F.array_sort(F.collect_list(F.struct("_p", F.coalesce("_new", "_v").alias("v")))), lambda x: x["v"])
        back = each.groupBy(f"_id{i}").agg(put.alias(f"_put{i}"), F.bool_or(F.col("_new").isNotNull()).alias(f"_hit{i}")).where(f"_hit{i}")
        out = out.join(back, F.col(id_) == F.col(f"_id{i}"), "left")
        moved.append(F.col(f"_put{i}").isNotNull())
    new = {c: F.coalesce(f"_new{i}", c) for i, c in enumerate(columns)} | {c: F.coalesce(f"_put{i}", c) for i, c in enumerate(arrays)}
    if named:
        name, column, applies = named
        follows = applies & F.col(f"_new{columns.index(column)}").isNotNull() & (F.col(name) == basename(F.col(column)))
        new[name] = F.when(follows, basename(F.col(f"_new{columns.index(column)}"))).otherwise(F.col(name))
    touched = reduce(lambda a, b: a | b, moved, F.lit(False))
    return out.select(*[new.get(c, F.col(c)).alias(c) for c in df.columns], touched.alias("touched"))


def retarget(df: DataFrame, moves: DataFrame, id_: str, path: str, extra: str, name: str, is_file: Column) -> DataFrame:
    """df with touched: files put on new lists of paths (id, paths), and their children with them.

    A child is a row that is no file and has the path of one. It takes the whole list, since it lies in
    the joined content. A file's name follows its first path while it is the file name of the old one.
    Moves without a path are left out; one path belongs to one file.
    """
    given = moves.where(F.size("paths") > 0).select(F.col("id").alias("_mid"), "paths")
    files = df.where(is_file).join(given, F.col(id_) == F.col("_mid")).select(F.col(id_).alias("_file"), F.col(path).alias("_old"), "paths")
    out = df.withColumn("_own", is_file).join(files, (F.col(path) == F.col("_old")) & (~F.col("_own") | (F.col(id_) == F.col("_file"))), "left")
    first = F.get("paths", F.lit(0))
    new = {
        path: F.coalesce(first, path), extra: F.when(F.col("_file").isNotNull(), F.slice("paths", 2, F.greatest(F.size("paths") - 1, F.lit(0)))).otherwise(F.col(extra)),
        name: F.when(F.col("_own") & F.col("_file").isNotNull() & (F.col(name) == basename(F.col(path))), basename(first)).otherwise(F.col(name)),
    }
    return out.select(*[new.get(c, F.col(c)).alias(c) for c in df.columns], F.col("_file").isNotNull().alias("touched"))


def repair(df: DataFrame, column: str, allowed: DataFrame, default: Column) -> tuple[DataFrame, DataFrame]:
    """(repaired, report): ids that `allowed` lacks become the default; the report has each old id and its rows."""
    known = allowed.select(F.col(column).alias("_known")).distinct()
    joined = df.join(known, F.col(column) == F.col("_known"), "left")
    fixed = joined.withColumn("repaired", F.col("_known").isNull()).withColumn(column, F.coalesce("_known", default)).drop("_known")
    report = df.join(allowed.select(column).distinct(), column, "left_anti").groupBy(F.col(column).alias("old")).agg(F.count("*").alias("n"))
    return fixed, report


def merge_partial(old: DataFrame, new: DataFrame, keys: list[str], inside: Column, value: str) -> DataFrame:
    """Inside the covered area the new value, outside it the old one; a value missing on one side takes the other."""
    joined = old.withColumnRenamed(value, "_old").join(new.withColumnRenamed(value, "_new"), keys, "full_outer")
    return joined.select(*keys, F.when(inside, F.coalesce("_new", "_old")).otherwise(F.coalesce("_old", "_new")).alias(value))


def best_match(df: DataFrame, key: str, score: str, order: str) -> DataFrame:
    """The row of each key with the greatest score, ties to the least order."""
    w = Window.partitionBy(key).orderBy(F.desc(score), F.col(order))
    return df.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def detect(pages: DataFrame, signatures: list[tuple]) -> DataFrame:
    """Best signature of each page: narrowing terms reject, magic decides alone with 2, a suffix counts 1, raw if none.

    signatures: (name, place, magic, suffix, least size, order), and if need be the exact size and a
    (modulus, remainder) of the size. They become one literal array, so each page is scored in place
    without a join or a shuffle.
    """
    scored = []
    size = F.length("html")
    for name, place, magic, suffix, least, order, *more in signatures:
        exact, (modulus, remainder) = (more[0] if more else None), (more[1] if len(more) > 1 and more[1] else (1, 0))
        hit = F.when(F.substring("html", place, len(magic)) == magic, 2) if magic is not None else F.when(F.endswith(F.lower("url"), F.lit(suffix)), 1) if suffix is not None else F.lit(0)
        narrow = (size < least) | (size % modulus != remainder) | (size != exact if exact is not None else F.lit(False))
        scored.append(F.struct(F.when(narrow, 0).otherwise(F.coalesce(hit, F.lit(0))).alias("score"), F.lit(-order).alias("ord"), F.lit(name).alias("name")))
    best = F.array_max(F.array(*scored))
    return pages.select("page_id", best.alias("b")).select("page_id", F.when(F.col("b.score") > 0, F.col("b.name")).otherwise("raw").alias("container"), F.col("b.score").alias("score"))
