"""Text expressions: names, keys, code tables, dictionary coding."""

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def matches(text: Column, query_text: str) -> Column:
    """Does a text hold every blank-separated word of the query, in any case and order; no words match all."""
    out = F.lit(True)
    for word in query_text.lower().split():
        out = out & F.contains(F.lower(text), F.lit(word))
    return out


def safe_name(name: Column) -> Column:
    """Letters, digits, - _ . kept, the rest _; dots and underscores trimmed off both ends; 'export' if nothing is left."""
    kept = F.regexp_replace(F.regexp_replace(name, r"[^A-Za-z0-9\-_.]", "_"), r"^[._]+|[._]+$", "")
    return F.coalesce(F.nullif(kept, F.lit("")), F.lit("export"))


def child_name(parent: Column, child: Column) -> Column:
    """A child's export name, after its parent's stem."""
    return F.concat(safe_name(F.regexp_replace(parent, r"\.[^.]*$", "")), F.lit("_"), safe_name(child))


def normal_path(path: Column, base: Column | None = None) -> Column:
    """An absolute path in one spelling: slashes single and forward, no '.' and '..' steps, no end slash.

    A path without a root stands below `base`. A drive letter or a scheme counts as a root; steps
    above the root vanish.
    """
    rooted = path.rlike(r"^([\\/]|[A-Za-z][A-Za-z0-9+.-]*:)")
    out = path if base is None else F.when(rooted, path).otherwise(F.concat(base, F.lit("/"), path))
    flat = F.regexp_replace(out, r"[\\/]+", "/")
    root = F.regexp_extract(flat, r"^([A-Za-z][A-Za-z0-9+.-]*:/?|/)?", 0)
    names = F.filter(F.split(F.substring(flat, F.length(root) + 1, F.length(flat)), "/"), lambda n: ~n.isin("", "."))
    kept = F.aggregate(
        names, F.array().cast("array<string>"),
        lambda acc, n: F.when(n != "..", F.concat(acc, F.array(n))).otherwise(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))),
    )
    return F.concat(root, F.array_join(kept, "/"))


def path_key(path: Column, base: Column | None = None) -> Column:
    """Key under which two spellings of a path are one: absolute below `base`, normalized, in lower case."""
    return F.lower(normal_path(path, base))


def stored_path(path: Column, base: Column) -> Column:
    """How a path is stored next to `base`: relative where it lies below base, else absolute; with forward slashes."""
    whole, root = normal_path(path, base), F.concat(F.regexp_replace(normal_path(base), "/$", ""), F.lit("/"))
    return F.when(F.startswith(F.lower(whole), F.lower(root)), F.substring(whole, F.length(root) + 1, F.length(whole))).otherwise(whole)


def natural_key(name: Column) -> Column:
    """Sort key: text folded, digit runs as numbers of any length, a number never meeting a text."""
    parts = F.regexp_extract_all(F.lower(name), F.lit(r"(\d+|\D+)"), F.lit(1))

    def number(p: Column) -> Column:
        digits = F.regexp_replace(p, r"^0+(?=\d)", "")
        return F.concat(F.lit("0"), F.lpad(F.length(digits).cast("string"), 10, "0"), digits)

    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike(r"^\d"), number(p)).otherwise(F.concat(F.lit("1"), p))), "\u0001")


def parse_code_line(line: Column, text_first: bool = False) -> Column:
    """struct(code, text, params) of a code=text line, null if it does not parse.

    Code-first lines split at the first =, text-first at the last. Bracketed text is a command, and
    [name, n] states n operands; a line with more operands than an int counts does not parse.
    """
    pattern = r"^\s*(.*)=\s*\$?([0-9A-Fa-f]{1,8})\s*$" if text_first else r"^\s*\$?([0-9A-Fa-f]{1,8})\s*=(.*)$"
    code = F.regexp_extract(line, pattern, 2 if text_first else 1)
    text = F.regexp_extract(line, pattern, 1 if text_first else 2)
    stated = F.nullif(F.regexp_extract(text, r"^\[[^\],]*,\s*(\d+)\s*\]$", 1), F.lit(""))
    name = F.when(text.rlike(r"^\[[^\]]*\]$"), F.regexp_replace(text, r",\s*\d+\s*\]$", "]")).otherwise(text)
    params = F.when(stated.isNull(), 0).otherwise(stated.try_cast("int"))
    parsed = F.struct(F.conv(code, 16, 10).try_cast("long").alias("code"), name.alias("text"), params.alias("params"))
    return F.when(line.rlike(pattern) & params.isNotNull(), parsed)


def commands_text(codes: Column, names: dict[int, tuple[str, int]]) -> Column:
    """Codes as text where some codes are commands (name, operands) that swallow the codes after them.

    Operands are cut at the end of the stream. Streams travel in Arrow batches.
    """

    def shown(stream: list[int]) -> str:
        out, i = [], 0
        while i < len(stream):
            name, n = names.get(stream[i], (None, 0))
            if name is None:
                out.append(f"<{stream[i]:X}>")
            else:
                out.append("[" + " ".join([name, *(f"${c:X}" for c in stream[i + 1 : i + 1 + n])]) + "]")
            i += 1 + n
        return "".join(out)

    @F.pandas_udf("string")
    def text(streams: pd.Series) -> pd.Series:
        return streams.map(lambda s: None if s is None else shown(list(s)))

    return text(codes)


def expand_words(words: DataFrame, key: str, text: str, glyphs: DataFrame) -> DataFrame:
    """(key, codes): the codes of a word's characters, empty if one has none; glyphs: (char, code)."""
    each = words.select(key, F.posexplode(F.split(text, "")).alias("pos", "char")).where("char <> ''")
    held = each.join(glyphs.select("char", "code"), "char", "left")
    row = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "code"))), lambda s: s["code"].cast("string")), " ")
    return held.groupBy(key).agg(F.when(F.count("code") == F.count("*"), row).otherwise("").alias("codes"))


def positional(df: DataFrame, key: str, text: str, first: int, hole: str) -> DataFrame:
    """(key, code, char): character i has code first + i; a hole keeps the count and gives no row."""
    each = df.select(key, F.posexplode(F.split(text, "")).alias("i", "char"))
    return each.where((F.col("char") != hole) & (F.col("char") != "")).select(key, (F.col("i") + first).alias("code"), "char")
