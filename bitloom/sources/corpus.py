"""File corpora and tolerant catalogs: binary scans, JSON records, sparse records, write plans, findings."""

from __future__ import annotations

from fnmatch import fnmatch

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Leading bytes that detection looks at.
HEAD = 0x10100
#: Files up to this size are read by tasks, which have their bytes whole; of larger ones only the head is asked for.
WHOLE = 1 << 22


def _heads(spark: SparkSession, files: DataFrame, head: int) -> DataFrame:
    """(path, length, head) of files too large to be a task's bytes: the driver asks each for its first bytes only."""
    conf, rows = spark._jsc.hadoopConfiguration(), []
    for path, length in files.select("path", "length").collect():
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        stream = place.getFileSystem(conf).open(place)
        try:
            rows.append((path, length, bytearray(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(spark._jvm.org.apache.commons.io.input.BoundedInputStream(stream, head)))))
        finally:
            stream.close()
    return spark.createDataFrame(rows, "path string, length long, head binary")


def scan(spark: SparkSession, path: str, glob: str = "*", with_empty: bool = False, head: int = HEAD) -> DataFrame:
    """(path, length, head): one row a file, with its first `head` bytes; without any (0) no file is opened.

    Tasks read the files of up to WHOLE bytes, and content is read only if head is selected. A larger file
    would be one task's whole, and over 2 GB fails, so its head is read by itself: what the driver gets
    is at most HEAD bytes for each WHOLE bytes of input.

    Spark's file index leaves out files without a byte. `with_empty` adds them from a listing by the
    driver, which takes a call for each file below the path.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    if head:
        small, large = F.col("length") <= WHOLE, F.col("length") > WHOLE
        found = files.where(small).select("path", "length", F.substring("content", 1, head).alias("head")).union(_heads(spark, files.where(large), head))
    else:
        found = files.select("path", "length", F.lit(b"").cast("binary").alias("head"))
    if not with_empty:
        return found
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    listed, empty = root.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(root, True), []
    while listed.hasNext():
        file = listed.next()
        name = file.getPath().getName()
        if file.getLen() == 0 and fnmatch(name, glob) and name[0] not in "._":
            empty.append((file.getPath().toString(),))
    return found.union(spark.createDataFrame(empty, "path string").select("path", F.lit(0).cast("long"), F.lit(b"").cast("binary")))


def with_missing(wanted: DataFrame, files: DataFrame) -> DataFrame:
    """wanted (path) with length and head; a file that cannot be read has length -1 and an empty head."""
    j = wanted.join(files, "path", "left")
    return j.withColumn("length", F.coalesce("length", F.lit(-1))).withColumn("head", F.coalesce("head", F.lit(b"").cast("binary")))


def read_catalogs(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, fatal, ord, entry): a JSON document's `entries`, one row each, positions kept.

    fatal is F001 (not JSON), F002 (not an object), F003 (no entries) or F004 (entries is no array);
    a bad entry is null in its place.
    """
    v = F.expr(f"try_parse_json({text})")
    entries = F.try_variant_get("v", "$.entries", "variant")
    listed = F.expr("try_variant_get(v, '$.entries', 'array<variant>')")
    kind = F.schema_of_variant("v")
    fatal = F.when(F.col("v").isNull(), "F001").when(~kind.startswith("OBJECT"), "F002").when(entries.isNull(), "F003").when(listed.isNull(), "F004")
    rows = docs.select(key, v.alias("v")).select(key, fatal.alias("fatal"), F.posexplode_outer(listed).alias("ord", "e"))
    return rows.select(key, "fatal", "ord", F.when(F.schema_of_variant("e").startswith("OBJECT"), F.to_json("e")).alias("entry"))


def number(text: Column, default: int) -> Column:
    """A whole number, or the default if the text is missing or of another type."""
    return F.coalesce(text.try_cast("long"), F.lit(default))


def member(value: Column, allowed: list[str], default: str) -> Column:
    return F.when(value.isin(allowed), value).otherwise(default)


def sparse(defaults: dict[str, object]) -> Column:
    """A record's JSON with only the fields that differ from their defaults."""
    fields = [F.nullif(F.col(c), F.lit(v)).alias(c) if v is not None else F.col(c) for c, v in defaults.items()]
    return F.to_json(F.struct(*fields), {"ignoreNullFields": "true"})


def records(df: DataFrame, key: str, text: str, size: int, first: int, count: int, nudge: int = 0) -> DataFrame:
    """(key, rec, body): fixed-size records first .. first + count - 1, moved by nudge, the last one padded."""
    whole = F.ceil(F.greatest(F.length(text) - nudge, F.lit(0)) / size).cast("int")
    span = F.when(F.least(whole, F.lit(first + count)) > first, F.sequence(F.lit(first), F.least(whole, F.lit(first + count)) - 1))
    each = df.select(key, text, F.explode(span).alias("rec"))
    return each.select(key, "rec", F.rpad(F.expr(f"substring({text}, rec * {size} + {nudge} + 1, {size})"), size, "0").alias("body"))


def write_plan(length: Column, slot: Column, compressed: Column, reshaped: Column) -> Column:
    """What to do with a write into a bounded slot."""
    return F.when(length > slot, "reject").when(reshaped & (length != slot), "reject").when(compressed & (length < slot), "pad").when(length < slot, "keep tail").otherwise("fit")


def slot_bytes(payload: Column, old: Column, plan: Column, slot: Column, pad: str = "FF") -> Column:
    """What a slot holds after a planned write: the payload, padded with one byte, or before the tail that was there; null where it is rejected."""
    missing = F.greatest(slot - F.octet_length(payload), F.lit(0)).cast("int")
    filler = F.unhex(F.repeat(F.lit(pad), missing))
    tail = F.substring(old, F.octet_length(payload) + 1, missing)
    return F.when(plan == "fit", payload).when(plan == "pad", F.concat(payload, filler)).when(plan == "keep tail", F.concat(payload, tail))


#: Severities from the worst down.
SEVERITIES = ["error", "warning", "info"]


def _rank(severity: Column) -> Column:
    return F.coalesce(*[F.when(severity == s, i) for i, s in enumerate(SEVERITIES)], F.lit(len(SEVERITIES)))


def write_findings(findings: DataFrame, path: str) -> None:
    """Findings as JSON files in one order over all files: the worst first, then by entry, code and place."""
    order = [_rank(F.col("severity")), "entry", "code", "pointer", "message", "detail"]
    findings.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").json(path)


def summary_lines(findings: DataFrame) -> DataFrame:
    """(entry, kind, rank, code, pointer, line): a text report, a heading for each entry (kind 0) and a line for each finding."""
    names = findings.groupBy("entry").agg(F.max("entry_name").alias("name"))
    heading = F.concat(F.lit("entries["), F.col("entry").cast("string"), F.lit("]"), F.when(F.col("name") != "", F.concat(F.lit("  "), "name")).otherwise(""))
    top = names.select("entry", F.lit(0).alias("kind"), F.lit(0).alias("rank"), F.lit("").alias("code"), F.lit("").alias("pointer"), heading.alias("line"))
    said = F.concat(F.lit("  "), "severity", F.lit(" "), "code", F.lit(" "), "pointer", F.lit(": "), "message", F.when(F.col("detail") != "", F.concat(F.lit(" ("), "detail", F.lit(")"))).otherwise(""))
    return top.unionByName(findings.select("entry", F.lit(1).alias("kind"), _rank(F.col("severity")).alias("rank"), "code", "pointer", said.alias("line")))


def write_summary(findings: DataFrame, path: str) -> None:
    """The text report in order over all files."""
    order = ["entry", "kind", "rank", "code", "pointer", "line"]
    summary_lines(findings).repartitionByRange(*order).sortWithinPartitions(*order).select("line").write.mode("overwrite").text(path)
