"""Repair of conversation structure by dynamic programming over grammar-compressed symbols.

Each row of a conversation is a symbol: its role's initial and its first fault. A repair keeps,
re-roles or deletes rows and inserts empty ones so that the initials read (s?(ua)+)?. Between the
four states of that pattern (start, after s, after u, after a) a row is a min-plus transfer matrix of
cheapest edits, and a stretch of rows is the product of its rows' matrices.

Spark cuts ordered conversations into blocks of symbols, and equal blocks of all conversations
become one string. Re-Pair runs over these strings in Spark rounds: each counts neighbouring pairs
of symbols and replaces the most frequent ones, of those that cannot overlap, by a new symbol. A rule
has one matrix, made bottom-up from those of its two symbols, and a rope in place of each entry's
audit: the state between its halves. A string then costs one product a compressed symbol, whichever
conversations it occurs in; conversations fold the matrices of their blocks in order.

Ties go to the least audit. No audits are compared for that: two entries of one row of a matrix
consume the same rows and end in a row's edit, so neither audit begins with the other, and they
differ, since an audit leads from one state to one state. The order of the left halves thus decides,
and each matrix keeps the places of its entries.

The grammar changes the work only, never a result: max_rules bounds it. No conversation has to fit a
task but for its one result row and the digest, which is sequential by its nature and is streamed.

Defined results: nulls in conv_id are one conversation; null role, text, and turn in the damage key
count as one space; null turns come first; rows of one turn are ordered by role and the digest of the
text, so equal rows lie together, and all but the first are duplicates; a role other than s, u, a by
its initial (an empty one too) has to be re-roled or deleted; a conversation without rows costs
nothing and has an empty audit; texts of any length take part whole; other columns, of any name, are
left out; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from bitloom.llm.common import discard, stored, table

#: Rows of a conversation that make one string at most.
BLOCK = 1024
#: A block's strings are dealt over so many keys, lest a common one be a hot key.
SALTS = 32

START, AFTER_S, AFTER_U, AFTER_A = range(4)
_STEP = {(START, "s"): AFTER_S, (START, "u"): AFTER_U, (AFTER_S, "u"): AFTER_U, (AFTER_U, "a"): AFTER_A, (AFTER_A, "u"): AFTER_U}
#: The role that the pattern wants next, besides a leading s.
WANTED = {START: "user", AFTER_S: "user", AFTER_U: "assistant", AFTER_A: "user"}
_NEXT = {p: _STEP[p, role[0]] for p, role in WANTED.items()}
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: Inserts that reach an accepting state from each state.
_CLOSING = {START: "", AFTER_S: "II", AFTER_U: "I", AFTER_A: ""}
#: A letter for each initial (s, u, a, other) of a sound, truncated, blank and duplicate row.
LETTERS = "suaoSUAO01234567"

#: By first state: last state -> (cost, state between the halves, place of the audit within its row).
Matrix = list[dict[int, tuple[int, int, int]]]


@cache
def _row(letter: str) -> tuple[Matrix, dict[tuple[int, int], str]]:
    """Matrix of one row, inserts before it included, and its audits; letter D has to be deleted."""
    out: Matrix = []
    audits = {}
    for p in range(4):
        best: dict[int, tuple[int, str]] = {}

        def offer(q: int, cost: int, audit: str, best: dict = best) -> None:
            best[q] = min(best.get(q, (cost, audit)), (cost, audit))

        at, before = p, ""
        for _ in range(3):  # a third insert would only come back to a state reached before
            paid = INSERT * len(before)
            offer(at, paid + DELETE, before + "D")
            if letter != "D":
                late = TRUNCATED if letter.isupper() else 0
                if (kept := _STEP.get((at, letter.lower()))) is not None:
                    offer(kept, paid + KEEP + late, before + "K")
                offer(_NEXT[at], paid + REROLE + late, before + "R")
            at, before = _NEXT[at], before + "I"
        order = sorted(best, key=lambda q: best[q][1])
        out.append({q: (cost, -1, order.index(q)) for q, (cost, _) in best.items()})
        audits |= {(p, q): audit for q, (_, audit) in best.items()}
    return out, audits


def product(left: Matrix, right: Matrix) -> Matrix:
    """Min-plus product; ties to the least audit, by the places of the left halves."""
    out: Matrix = []
    for row in left:
        best: dict[int, tuple[int, int, int]] = {}
        for q, (cost, _, place) in row.items():
            for r, (more, _, _) in right[q].items():
                if r not in best or (cost + more, place) < best[r][:2]:
                    best[r] = (cost + more, place, q)
        order = sorted(best, key=lambda r: (best[r][1], right[best[r][2]][r][2]))
        out.append({r: (cost, q, order.index(r)) for r, (cost, _, q) in best.items()})
    return out


class Grammar:
    """Rules (symbol, pair) with a matrix and a rope for each."""

    def __init__(self, rules: list[tuple[str, str]]) -> None:
        self.rules = rules
        self.pair = dict(rules)
        self.matrix = {x: _row(x)[0] for x in "suaoSUAOD"}
        for name, (a, b) in rules:
            self.matrix[name] = product(self.matrix[a], self.matrix[b])
        self.texts: dict[tuple[str, int, int], str] = {}

    def compressed(self, symbols: Column) -> Column:
        for name, pair in self.rules:
            symbols = F.replace(symbols, F.lit(pair), F.lit(name))
        return symbols

    def text(self, symbol: str, p: int, q: int) -> str:
        """The audit of an entry: the rope written out, once for each entry."""
        key = (symbol, p, q)
        if key not in self.texts:
            if symbol in self.pair:
                (a, b), between = self.pair[symbol], self.matrix[symbol][p][q][1]
                self.texts[key] = self.text(a, p, between) + self.text(b, between, q)
            else:
                self.texts[key] = _row(symbol)[1][p, q]
        return self.texts[key]

    def paths(self, symbols: str) -> list[tuple[int, int, int, int, str]]:
        """(first state, last state, cost, place, audit) of a compressed string."""
        steps = [self.matrix[symbols[0]]]
        for x in symbols[1:]:
            steps.append(product(steps[-1], self.matrix[x]))
        out = []
        for p in range(4):
            for q, (cost, _, place) in steps[-1][p].items():
                at, parts = q, []
                for k in range(len(symbols) - 1, 0, -1):
                    between = steps[k][p][at][1]
                    parts.append(self.text(symbols[k], between, at))
                    at = between
                parts.append(self.text(symbols[0], p, at))
                out.append((p, q, cost, place, "".join(reversed(parts))))
        return out


def faults(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, digest, initial, fault) of rows without nulls in role and text.

    fault: 0 none, 1 truncated, 2 blank, 3 duplicate of a row of an earlier turn. Copies within a
    turn are told apart when the rows are in order. The first turn of a text is an aggregate, so a
    text that half the rows have is summed up before any shuffle.
    """
    space = " \t\n\x0b\x0c\r"
    trimmed = F.rtrim(F.col("text"), F.lit(space))
    fault = F.when(F.trim(trimmed, F.lit(space)) == "", 2).when(~F.right(trimmed, F.lit(1)).isin(".", "!", "?"), 1).otherwise(0)
    seen = rows.select("conv_id", "turn", "role", F.sha2("text", 256).alias("digest"), F.substring("role", 1, 1).alias("initial"), fault.alias("fault"))
    first = seen.groupBy("conv_id", "role", "digest").agg(F.min(F.struct("turn")).alias("first"))
    a, b = seen.alias("a"), first.alias("b")
    joined = a.join(b, F.col("a.conv_id").eqNullSafe(F.col("b.conv_id")) & (F.col("a.role") == F.col("b.role")) & (F.col("a.digest") == F.col("b.digest")))
    again = ~F.col("a.turn").eqNullSafe(F.col("b.first.turn"))
    return joined.select(*[F.col(f"a.{c}") for c in ("conv_id", "turn", "role", "digest", "initial")], F.when(again & (F.col("a.fault") < 2), 3).otherwise(F.col("a.fault")).alias("fault"))


def blocks(marked: DataFrame) -> DataFrame:
    """(conv_id, part, number, symbols): ordered conversations cut at the borders of range partitions and each BLOCK rows.

    Equal rows meet in one range partition, so copies within a turn lie side by side there.
    """
    kind = marked.schema["conv_id"]
    schema = StructType([kind, *StructType.fromDDL("part int, number long, symbols string")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        part = context.partitionId() if context else 0
        last, held, number = None, [], 0
        done: list[tuple] = []

        def batch() -> pa.RecordBatch:
            ids, numbers, symbols = zip(*done, strict=True)
            out = pa.RecordBatch.from_arrays([pa.array(ids, kinds), pa.array([part] * len(ids), pa.int32()), pa.array(numbers, pa.int64()), pa.array(symbols, pa.string())], schema.names)
            done.clear()
            return out

        kinds = None
        for b in batches:
            kinds = b.column(0).type
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                *key, initial, fault = row
                if held and (last[0] != key[0] or len(held) == BLOCK):
                    done.append((last[0], number, "".join(held)))
                    held, number = [], number + 1
                if fault < 2 and key == last:
                    fault = 3
                held.append(LETTERS[4 * fault + ("sua".find(initial) if initial in ("s", "u", "a") else 3)])
                last = key
            if len(done) >= 4096:
                yield batch()
        if held:
            done.append((last[0], number, "".join(held)))
        if done:
            yield batch()

    order = ["conv_id", "turn", "role", "digest"]
    return marked.select(*order, "initial", "fault").repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, schema)


def re_pair(strings: DataFrame, column: str, max_rules: int = 128) -> Grammar:
    """Rules over distinct strings: rounds of the most frequent pairs, until none occurs twice.

    A round counts the pairs of all strings and takes, of the 64 most frequent, those with at least
    half the greatest count that no pair taken before can overlap. Only these counts reach the driver.
    """
    rules: list[tuple[str, str]] = []
    while len(rules) < max_rules:
        now = strings.select(Grammar(rules).compressed(F.col(column)).alias("q")).where("length(q) > 1")
        pairs = now.select(F.explode(F.expr("transform(sequence(1, length(q) - 1), i -> substr(q, i, 2))")).alias("pair"))
        top = pairs.groupBy("pair").count().where("count > 1").orderBy(F.desc("count"), "pair").limit(64).collect()
        firsts, seconds, before = set(), set(), len(rules)
        for pair, count in top:
            if 2 * count >= top[0]["count"] and pair[0] not in seconds and pair[1] not in firsts and len(rules) < max_rules:
                firsts.add(pair[0])
                seconds.add(pair[1])
                rules.append((chr(0xE000 + len(rules)), pair))
        if len(rules) == before:
            break
    return Grammar(rules)


def audits(rows: DataFrame, max_rules: int = 128) -> DataFrame:
    """(conv_id, blank, duplicate, truncated, illegal, cost, audit) of each conversation that has rows.

    rows: conv_id, turn, role, text, without nulls in role and text.
    """
    marked = stored(faults(rows), "faults")
    cut = stored(blocks(marked).withColumn("plain", F.translate("symbols", LETTERS[8:], "D" * 8)).withColumn("salt", F.pmod(F.xxhash64("conv_id"), F.lit(SALTS))), "blocks")
    discard(marked)
    strings = cut.select("plain").distinct()
    grammar = re_pair(strings, "plain", max_rules)
    field = "array<struct<p:int,q:int,cost:long,place:int,audit:string>>"
    entries = pa.list_(pa.struct([("p", pa.int32()), ("q", pa.int32()), ("cost", pa.int64()), ("place", pa.int32()), ("audit", pa.string())]))

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 64):
                few = b.slice(i, 64)
                found = [[dict(zip(("p", "q", "cost", "place", "audit"), x, strict=True)) for x in grammar.paths(s)] for s in few.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([few.column(0), few.column(1), pa.array(found, entries)], ["plain", "salt", "paths"])

    asked = cut.select("plain", "salt").distinct().withColumn("short", grammar.compressed(F.col("plain")))
    solved = asked.mapInArrow(solve, f"plain string, salt long, paths {field}")
    whole = cut.join(solved, ["plain", "salt"]).select("conv_id", "part", "number", "symbols", "paths")
    schema = StructType([rows.schema["conv_id"], *StructType.fromDDL("blank long, duplicate long, truncated long, illegal long, cost long, audit string")])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, done, held = None, [], None

        def batch() -> pa.RecordBatch:
            columns = list(zip(*done, strict=True))
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(columns[0], kind), *(pa.array(c, pa.int64()) for c in columns[1:6]), pa.array(columns[6], pa.string())], schema.names)

        for b in batches:
            kind = b.column(0).type
            for conv, symbols, paths in zip(b.column(0).to_pylist(), b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True):
                if held is None or held.conv != conv:
                    if held is not None:
                        done.append(held.result())
                    held = Folded(conv)
                held.add(symbols, paths)
                if len(done) >= 4096:
                    yield batch()
        if held is not None:
            done.append(held.result())
        if done:
            yield batch()

    return whole.repartition("conv_id").sortWithinPartitions("conv_id", "part", "number").mapInArrow(fold, schema)


class Folded:
    """The cheapest edits of a conversation's blocks so far, by state."""

    def __init__(self, conv: object) -> None:
        self.conv, self.last = conv, ""
        self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.live: dict[int, tuple[int, int, tuple | None]] = {START: (0, 0, None)}

    def add(self, symbols: str, paths: list[dict]) -> None:
        self.blank += sum(map(symbols.count, LETTERS[8:12]))
        self.duplicate += sum(map(symbols.count, LETTERS[12:]))
        self.truncated += sum(map(symbols.count, LETTERS[4:8]))
        initials = self.last + symbols.translate(str.maketrans(LETTERS, "suao" * 4))
        self.illegal += len(initials) - 1 - sum(map(initials.count, ("su", "ua", "au")))
        self.last = initials[-1]
        best: dict[int, tuple] = {}
        for x in paths:
            if x["p"] in self.live:
                cost, place, rope = self.live[x["p"]]
                offer = (cost + x["cost"], place, x["place"], (rope, x["audit"]))
                if x["q"] not in best or offer[:3] < best[x["q"]][:3]:
                    best[x["q"]] = offer
        order = sorted(best, key=lambda q: best[q][1:3])
        self.live = {q: (best[q][0], order.index(q), best[q][3]) for q in best}

    def result(self) -> tuple:
        cost, _, q = min((cost + INSERT * len(_CLOSING[q]), place, q) for q, (cost, place, _) in self.live.items())
        parts, rope = [_CLOSING[q]], self.live[q][2]
        while rope is not None:
            rope, text = rope
            parts.append(text)
        return self.conv, self.blank, self.duplicate, self.truncated, self.illegal, cost, "".join(reversed(parts))


def repaired(rows: DataFrame, found: DataFrame) -> DataFrame:
    """(conv_id, place, edit, role, text): rows after their repair, in order within each partition.

    Each conversation's audit precedes its rows in one sorted partition, where both are streamed.
    """
    kind = rows.schema["conv_id"]
    schema = StructType([kind, *StructType.fromDDL("place long, edit string, role string, text string")])
    edits = found.select("conv_id", F.lit(0).alias("_row"), F.lit(None).cast(rows.schema["turn"].dataType).alias("turn"), F.lit("").alias("role"), F.lit("").alias("digest"), F.col("audit").alias("text"))
    lines = rows.select("conv_id", F.lit(1).alias("_row"), "turn", "role", F.sha2("text", 256).alias("digest"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, audit, at, place, state = None, "", 0, 0, START
        done: list[tuple] = []
        kinds = None

        def batch() -> pa.RecordBatch:
            c = list(zip(*done, strict=True))
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(c[0], kinds), pa.array(c[1], pa.int64()), *(pa.array(x, pa.string()) for x in c[2:])], schema.names)

        def put(edit: str, role: str, text: str) -> None:
            nonlocal place, state
            done.append((conv, place, edit, role, text))
            place += 1
            state = _STEP[state, role[0]]

        def inserts() -> None:
            nonlocal at
            while at < len(audit) and audit[at] == "I":
                put("I", WANTED[state], "")
                at += 1

        size = 0
        for b in batches:
            kinds = b.column(0).type
            for who, is_row, role, text in zip(*(b.column(i).to_pylist() for i in (0, 1, 3, 5)), strict=True):
                if not is_row:
                    inserts()
                    conv, audit, at, place, state = who, text, 0, 0, START
                    continue
                inserts()
                edit = audit[at]
                at += 1
                if edit != "D":
                    put(edit, WANTED[state] if edit == "R" else role, text)
                    size += len(text)
                if len(done) >= 4096 or size > 1 << 23:
                    yield batch()
                    size = 0
        inserts()
        if done:
            yield batch()

    return edits.unionByName(lines).repartition("conv_id").sortWithinPartitions("conv_id", "_row", "turn", "role", "digest").mapInArrow(run, schema)


def digests(ordered: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) of repaired(): its lines role:text, joined by newlines, hashed as they pass."""
    schema = StructType([ordered.schema["conv_id"], *StructType.fromDDL("repaired_sha256 string")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, hashed, kind = None, None, None
        ids, out = [], []
        for b in batches:
            kind = b.column(0).type
            for who, place, role, text in zip(*(b.column(i).to_pylist() for i in (0, 1, 3, 4)), strict=True):
                if place == 0:
                    if hashed is not None:
                        ids.append(conv)
                        out.append(hashed.hexdigest())
                    conv, hashed = who, hashlib.sha256()
                else:
                    hashed.update(b"\n")
                hashed.update(f"{role}:{text}".encode())
            if len(ids) >= 4096:
                yield pa.RecordBatch.from_arrays([pa.array(ids, kind), pa.array(out, pa.string())], schema.names)
                ids, out = [], []
        if hashed is not None:
            ids.append(conv)
            out.append(hashed.hexdigest())
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array(ids, kind), pa.array(out, pa.string())], schema.names)

    return ordered.mapInArrow(run, schema)


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) after the damage that crc32 of `conv_id:turn` modulo 20 names."""
    held = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(held("conv_id"), F.lit(":"), held("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", held("role").alias("role"), held("text").alias("text"), kind.alias("_kind")).where("_kind <> 0")
    text = F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.explode(F.when(F.col("_kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", F.when(F.col("_kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), copies.alias("_copy")).drop("_copy")


def gaps(rows: DataFrame) -> DataFrame:
    """(conv_id, gaps): turns that are missing between the least and the greatest one."""
    turns = rows.groupBy("conv_id", "turn").agg(F.count(F.lit(1)).alias("_n"))
    return turns.groupBy("conv_id").agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("long").alias("gaps"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    rows = damaged(conversations)
    found = stored(audits(rows), "audits")
    hashed = digests(repaired(rows, found))
    out = conversations.select("conv_id").distinct()
    for part in (gaps(rows), found, hashed):
        named = part.withColumnRenamed("conv_id", "_id")
        out = out.join(named, F.col("conv_id").eqNullSafe(F.col("_id")), "left").drop("_id")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return out.select(
        "conv_id", *map(zero, ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"),
    )
