"""Repair of a conversation's structure: the cheapest edits that make its roles read ``(s?(ua)+)?``.

Rows of a conversation stand in the order of turn (nulls first), role, text. Edits: Keep (0), Rerole to user or assistant
(2), Delete (3; blank rows and repeats of an earlier role and text must go), Insert an empty user or assistant row (2); a
truncated row that stays costs 1 more. Of the cheapest edit strings (initials in order) the ASCII-least is taken.

A backward dynamic program over four states gives each row's cost vector. Vectors are stored only at checkpoints, which lie
at growing distances (32 rows, 33, 34 ...), so that a conversation of n rows has O(sqrt n) of them, O(sqrt n) rows apart.
The stretch of rows between two checkpoints is a row of a table of blocks. A block's costs from each entry state to each
exit state are a min-plus matrix, computed for all blocks in parallel; the matrices of a conversation, taken backward, give
the vectors at its checkpoints. From the vector at its end each block recomputes its own vectors and walks forward from each
entry state, again in parallel; the blocks' exits, taken in order, tell which of the four walks holds.

A conversation may hold a third of all rows: rows are range-partitioned within conversations, and no task holds more than one
block's rows and one conversation's matrices. Only the digest of the repaired text is sequential by its nature: the pieces
of one conversation stream through one task, of which it keeps the hash alone.

Defined cases: a null role or text is one space, a null conv_id is a conversation of its own. Repeated rows count as repeats.
An empty table gives an empty table. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import release, stash, table
from .lines import BLANK

#: Rows of a conversation's first block; each further block has one more.
FIRST_BLOCK = 32
INITIALS = "sua"
OK, TRUNCATED, BLANK_ROW, REPEAT = range(4)
#: States: start, after s, after u, after a. The state after a kept row of initial s, u, a or another (none: not allowed).
KEEP = ((1, 2, None, None), (None, 2, None, None), (None, None, 3, None), (None, 2, None, None))
#: The state after an inserted or re-roled row, and the cost to end in each state.
NEXT = (2, 2, 3, 2)
END = (0, 4, 2, 0)
FAR = 1 << 40
#: Code letters A-P are 4 * initial + kind, from A.
LETTERS = {chr(65 + 4 * i + k): (i, k) for i in range(4) for k in range(4)}
#: Two neighbouring rows whose roles may follow each other.
LEGAL = r"[A-D](?=[E-H])|[E-H](?=[I-L])|[I-L](?=[E-H])"


def damage(rows: DataFrame) -> DataFrame:
    """Rows with planted faults, by crc32 of conv_id:turn modulo 20: 0 drops, 1 empties the text, 2 removes its end marks,
    3 repeats the row, 4 sets the role to user. Nulls count as one space."""
    word = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(word("conv_id"), F.lit(":"), word("turn"))) % 20
    text = F.when(fault == 1, "").when(fault == 2, F.regexp_replace(word("text"), "[.!?]", "")).otherwise(word("text"))
    role = F.when(fault == 4, "user").otherwise(word("role"))
    copies = F.explode(F.array_repeat(F.lit(0), F.when(fault == 3, 2).otherwise(1))).alias("copy")
    return rows.where(fault != 0).select("conv_id", "turn", role.alias("role"), text.alias("text"), copies).drop("copy")


def _rows(rows: DataFrame) -> DataFrame:
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    r = rows.select(F.col("conv_id").alias("conv"), "turn", role.alias("role"), text.alias("text"), F.monotonically_increasing_id().alias("rid"))
    return r.withColumns({"h1": F.xxhash64("role", "text"), "h2": F.xxhash64(F.lit("second"), "text", "role")})


def _codes(rows: DataFrame) -> DataFrame:
    """rows with code, a letter for a row's initial and its first fault. The first row of each role and text is found by an
    aggregation, then met again by its number, so that a text in many rows is no hot key."""
    first = rows.groupBy("conv", "h1", "h2").agg(F.min(F.struct("turn", "rid")).alias("x")).select(F.col("x.rid").alias("rid"), F.lit(True).alias("is_first"))
    end = F.btrim("text", F.lit(BLANK))
    kind = F.when(end == "", BLANK_ROW).when(F.col("is_first").isNull(), REPEAT).when(~F.substring(end, -1, 1).isin(*".!?"), TRUNCATED).otherwise(OK)
    initial = F.coalesce(*[F.when(F.substring("role", 1, 1) == x, i) for i, x in enumerate(INITIALS)], F.lit(3))
    return rows.join(first, "rid", "left").withColumn("code", F.char(65 + 4 * initial + kind))


def cut_blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of the rows of each conversation, which come sorted; a block ends at its size or with the conversation's rows."""
    kind, now, held, done = None, None, [], []

    def out():
        cols = list(zip(*done, strict=True))
        arrays = [pa.array(cols[0], kind), pa.array(cols[1], pa.int64()), pa.array(cols[2]), *[pa.array(c, pa.list_(pa.string())) for c in cols[3:]]]
        return pa.RecordBatch.from_arrays(arrays, ["conv", "at", "codes", "roles", "texts"])

    def close():
        at, codes, roles, texts = zip(*held, strict=True)
        done.append((now, at[0], "".join(codes), roles, texts))

    size, waiting = FIRST_BLOCK, 0
    for b in batches:
        kind = b.schema.field("conv").type
        for conv, *row in zip(*[b.column(c).to_pylist() for c in ("conv", "at", "code", "role", "text")], strict=True):
            if held and (conv != now or len(held) == size):
                close()
                size, held = (size + 1 if conv == now else FIRST_BLOCK), []
            elif conv != now:
                size = FIRST_BLOCK
            now = conv
            held.append(row)
            waiting += len(row[3]) + 8
        if done and waiting > 1 << 22:
            yield out()
            done, waiting = [], 0
    if held:
        close()
    if done:
        yield out()


def before(letter: str, after: tuple | list) -> list:
    """The cost vector before a row, inserts ahead of it included, from that after it."""
    initial, kind = LETTERS[letter]
    extra = int(kind == TRUNCATED)
    base = []
    for s in range(4):
        cost = 3 + after[s]
        if kind in (OK, TRUNCATED):
            kept = KEEP[s][initial]
            cost = min(cost, 2 + extra + after[NEXT[s]], FAR if kept is None else extra + after[kept])
        base.append(cost)
    return [min(base[s], 2 + base[NEXT[s]], 4 + base[NEXT[NEXT[s]]]) for s in range(4)]


def block_costs(codes: str) -> list:
    """Costs from each entry state to each exit state, row by row of the 4 x 4 matrix."""
    columns = []
    for end in range(4):
        v = [0 if s == end else FAR for s in range(4)]
        for letter in reversed(codes):
            v = before(letter, v)
        columns.append(v)
    return [columns[e][s] for s in range(4) for e in range(4)]


def across(costs: list, after: tuple | list) -> list:
    return [min(costs[4 * s + e] + after[e] for e in range(4)) for s in range(4)]


def walk(codes: str, after: tuple | list, last: bool) -> list:
    """For each entry state: the exit state and the ASCII-least tight edits. after: the cost vector at the block's end."""
    vectors = [list(after)]
    for letter in reversed(codes):
        vectors.append(before(letter, vectors[-1]))
    vectors.reverse()
    found = []
    for s in range(4):
        edits = []
        for i, letter in enumerate(codes):
            (initial, kind), v, w = LETTERS[letter], vectors[i], vectors[i + 1]
            while v[s] != 3 + w[s] and v[s] == 2 + v[NEXT[s]]:
                edits.append("I")
                s = NEXT[s]
            kept = KEEP[s][initial]
            if v[s] == 3 + w[s]:
                edits.append("D")
            elif kept is not None and v[s] == int(kind == TRUNCATED) + w[kept]:
                edits.append("K")
                s = kept
            else:
                edits.append("R")
                s = NEXT[s]
        while last and END[s]:
            edits.append("I")
            s = NEXT[s]
        found.append((s, "".join(edits)))
    return found


def repaired(entry: int, edits: str, roles: list, texts: list) -> list:
    """The lines ``role:text`` that a block's edits leave."""
    s, row, out = entry, 0, []
    for e in edits:
        if e == "I":
            s = NEXT[s]
            out.append(("user:", "assistant:")[s == 3])
            continue
        role, text, row = roles[row], texts[row], row + 1
        if e == "D":
            continue
        s = KEEP[s][INITIALS.find(role[:1])] if e == "K" else NEXT[s]
        out.append(f"{role if e == 'K' else ('user', 'assistant')[s == 3]}:{text}")
    return out


def _batch(columns: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def add_costs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        costs = [block_costs(x) for x in b.column("codes").to_pylist()]
        yield _batch({"conv": b.column("conv"), "at": b.column("at"), "costs": pa.array(costs, pa.list_(pa.int64()))})


def add_ends(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The vector at each block's end; blocks: a conversation's (at, costs) in order. cost: of the whole conversation."""
    for b in batches:
        rows = []
        for blocks in b.column("blocks").to_pylist():
            v, back = END, []
            for k, x in enumerate(reversed(blocks)):
                back.append((x["at"], list(v), k == 0))
                v = across(x["costs"], v)
            rows += [(*x, v[0]) for x in back]
        cols = list(zip(*rows, strict=True)) or [[]] * 4
        kinds = (pa.int64(), pa.list_(pa.int64()), pa.bool_(), pa.int64())
        yield _batch({n: pa.array(c, t) for n, c, t in zip(("at", "after", "last", "cost"), cols, kinds, strict=True)})


def add_walks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = [walk(*x) for x in zip(*[b.column(c).to_pylist() for c in ("codes", "after", "last")], strict=True)]
        exits, edits = [[w[0] for w in x] for x in found], [[w[1] for w in x] for x in found]
        cols = {"exits": pa.array(exits, pa.list_(pa.int32())), "edits": pa.array(edits, pa.list_(pa.string()))}
        yield _batch({c: b.column(c) for c in ("conv", "at", "cost")} | cols)


def add_entries(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The state in which each block is entered; blocks: a conversation's (at, exits) in order."""
    for b in batches:
        at, entry = [], []
        for blocks in b.column("blocks").to_pylist():
            s = 0
            for x in blocks:
                at.append(x["at"])
                entry.append(s)
                s = x["exits"][s]
        yield _batch({"at": pa.array(at, pa.int64()), "entry": pa.array(entry, pa.int32())})


def add_lines(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        lines = [repaired(*x) for x in zip(*[b.column(c).to_pylist() for c in ("entry", "edit", "roles", "texts")], strict=True)]
        yield _batch({c: b.column(c) for c in ("conv", "at", "edit")} | {"lines": pa.array(lines, pa.list_(pa.string()))})


def digest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """conv, audit and repaired_sha256 from the pieces of each conversation, which come sorted."""
    now, edits, sha, empty, kind = None, [], None, True, None
    for b in batches:
        kind, done = b.schema.field("conv").type, []
        for conv, edit, lines in zip(*[b.column(c).to_pylist() for c in ("conv", "edit", "lines")], strict=True):
            if sha is not None and conv != now:
                done.append((now, "".join(edits), sha.hexdigest()))
                sha = None
            if sha is None:
                now, edits, sha, empty = conv, [], hashlib.sha256(), True
            edits.append(edit)
            if lines:
                sha.update((("" if empty else "\n") + "\n".join(lines)).encode())
                empty = False
        if done:
            yield _batch({n: pa.array(c, t) for n, c, t in zip(("conv", "audit", "repaired_sha256"), zip(*done, strict=True), (kind, pa.string(), pa.string()), strict=True)})
    if sha is not None:
        yield _batch({"conv": pa.array([now], kind), "audit": pa.array(["".join(edits)]), "repaired_sha256": pa.array([sha.hexdigest()])})


def _struct(conv: T.DataType, **more: str) -> T.StructType:
    return T.StructType([T.StructField("conv", conv)] + [T.StructField(n, T._parse_datatype_string(t)) for n, t in more.items()])


def _in_order(blocks: DataFrame, *cols: str) -> DataFrame:
    return blocks.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("at", *cols))).alias("blocks"))


def _counts(rows: DataFrame, blocks: DataFrame) -> DataFrame:
    """conv, gaps, blank, duplicate, truncated, illegal."""
    turns = rows.groupBy("conv", "turn").agg(F.lit(1).alias("one")).groupBy("conv").agg((F.max("turn") - F.min("turn") + 1 - F.count("turn")).cast("long").alias("gaps"))
    earlier = F.lag(F.right("codes", F.lit(1))).over(Window.partitionBy("conv").orderBy("at"))
    chain = blocks.select("conv", "codes", F.concat(F.coalesce(earlier, F.lit("")), F.col("codes")).alias("chain"))
    many = lambda kind: F.sum(F.regexp_count("codes", F.lit("[" + "".join(x for x, (_, k) in LETTERS.items() if k == kind) + "]"))).cast("long")
    illegal = F.sum(F.length("chain") - 1 - F.regexp_count("chain", F.lit(LEGAL))).cast("long")
    found = chain.groupBy("conv").agg(many(BLANK_ROW).alias("blank"), many(REPEAT).alias("duplicate"), many(TRUNCATED).alias("truncated"), illegal.alias("illegal"))
    return _beside(found, turns)


def _beside(a: DataFrame, b: DataFrame, how: str = "inner") -> DataFrame:
    same: Column = F.col("a.conv").eqNullSafe(F.col("b.conv"))
    return a.alias("a").join(b.alias("b"), same, how).select("a.*", *[F.col(f"b.{c}") for c in b.columns if c != "conv"])


def repair(conversations: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of each conversation with a row.
    conversations: conv_id, turn (whole numbers), role, text."""
    conv = conversations.schema["conv_id"].dataType
    rows = stash(_rows(conversations), "rows")
    sorted_ = _codes(rows).repartitionByRange("conv", "turn", "role", "text", "rid").sortWithinPartitions("conv", "turn", "role", "text", "rid")
    numbered = sorted_.select("conv", F.monotonically_increasing_id().alias("at"), "code", "role", "text")
    blocks = stash(numbered.mapInArrow(cut_blocks, _struct(conv, at="long", codes="string", roles="array<string>", texts="array<string>")), "blocks")
    codes = blocks.select("conv", "at", "codes")
    costs = codes.mapInArrow(add_costs, _struct(conv, at="long", costs="array<long>"))
    ends = _in_order(costs, "costs").mapInArrow(add_ends, "at long, after array<long>, last boolean, cost long")
    walks = stash(codes.join(ends, "at").mapInArrow(add_walks, _struct(conv, at="long", cost="long", exits="array<int>", edits="array<string>")), "walks")
    entries = _in_order(walks.select("conv", "at", "exits"), "exits").mapInArrow(add_entries, "at long, entry int")
    chosen = walks.join(entries, "at").select("at", "entry", F.get("edits", F.col("entry")).alias("edit"))
    pieces = blocks.drop("codes").join(chosen, "at").mapInArrow(add_lines, _struct(conv, at="long", edit="string", lines="array<string>"))
    texts = pieces.repartition("conv").sortWithinPartitions("conv", "at").mapInArrow(digest, _struct(conv, audit="string", repaired_sha256="string"))
    costs_of = walks.groupBy("conv").agg(F.max("cost").alias("cost"))
    out = stash(_beside(_beside(_counts(rows, codes), costs_of), texts), "repaired")
    release(rows, blocks, walks)
    return out.select(F.col("conv").alias("conv_id"), "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    ids = given.select(F.col("conv_id").alias("conv")).distinct()
    got = _beside(ids, repair(damage(given)).withColumnRenamed("conv_id", "conv"), "left")
    counts = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    none = hashlib.sha256(b"").hexdigest()
    return got.select(F.col("conv").alias("conv_id"), *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(none)).alias("repaired_sha256"))
