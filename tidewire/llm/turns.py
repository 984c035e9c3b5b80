"""Conversation structure repair (13).

A conversation's rows are taken by turn (nulls first), then role, then text.  The roles' initials should form ``(s?(ua)+)?``.  Edits:
Keep (K, 0), Rerole to user or assistant (R, 1), Delete (D, 2; the only one for blank and duplicate rows), Insert an
empty-text user or assistant anywhere (I, 5); a truncated row that stays costs 5 more.  The grammar's state (nothing yet, after s, u, a) and
an edit's letter settle the role, so a backward pass computes the cost to go from each (row, state), and a forward walk takes the
ASCII-least letter among the transitions that keep to it: the cheapest edits, ties ASCII-least.  A row's first fault counts: blank
(white space only), duplicate (role and text seen earlier), truncated (the last character that is not white space is none of . ! ?).

Conversations of up to LONG_ROWS rows and LONG_CHARS characters are repaired whole, streaming through sorted partitions.  Longer ones, of any
length, are cut into blocks of a range-partitioned sort: each block gives the least cost from each state at its start to each at its end,
a conversation's blocks hand the cost to go back to front and the state front to back (a few numbers a block), and every block is walked
by itself.  Both ways give the same rows.  Only the digest of a long conversation needs its repaired text in order: one task streams it, holding
one row at a time; its audit is one string by the result's definition.

Odd input: a null role or text is one space, a null turn sorts first; a null conv_id is a conversation of its own; roles are
compared by their first character, so an unknown or empty one can only be reroled or deleted; rows that repeat are duplicates
(all but the first); an empty table gives no row.  Columns other than conv_id, turn, role and text do not matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches, cut, fresh_dir, map_arrow, table

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: Conversations beyond either are repaired by blocks of BLOCK_ROWS.
LONG_ROWS, LONG_CHARS, BLOCK_ROWS = 20_000, 16_000_000, 4_096
#: States: nothing yet, after s, after u, after a; where a user or assistant leads from each; what an initial leads to from each.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = (USER, USER, ASSISTANT, USER)
KEPT = {"s": (SYSTEM, None, None, None), "u": (USER, USER, None, USER), "a": (None, None, ASSISTANT, None)}
NEVER = 1 << 60
AT_END = (0, 2 * INSERT, INSERT, 0)  # cost to go after the last row
ROLE = {USER: "user", ASSISTANT: "assistant"}
LEGAL = {"su", "ua", "au"}
WHITE = " \t\n\x0b\x0c\r"
FAULTS = ("", "blank", "duplicate", "truncated")

_ROW = tuple[str, str, int]  # role, text, fault (a place in FAULTS)


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) after deterministic damage by crc32(conv_id:turn) mod 20."""
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    own = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), shown("role").alias("role"), shown("text").alias("text"), (F.crc32(F.concat_ws(":", shown("conv_id"), shown("turn"))) % 20).alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.array_repeat(F.lit(0), F.when(F.col("kind") == 3, 2).otherwise(1))
    return own.where("kind <> 0").select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(copies).alias("copy")).drop("copy")


def fault(text: str, seen: bool) -> int:
    """A row's first fault, as a place in FAULTS."""
    told = text.rstrip(WHITE)
    return 1 if not told else 2 if seen else 3 if told[-1] not in ".!?" else 0


def step_back(row: _ROW, after: tuple[int, ...]) -> tuple[int, ...]:
    """The cost to go before a row, out of that after it, for each state."""
    role, _, wrong = row
    costs = [c + DELETE for c in after]
    if wrong in (0, 3):
        more = TRUNCATED if wrong else 0
        kept = KEPT.get(role[:1])
        for g in range(4):
            costs[g] = min(costs[g], after[NEXT[g]] + REROLE + more)
            if kept and kept[g] is not None:
                costs[g] = min(costs[g], after[kept[g]] + KEEP + more)
    u, a = min(costs[USER], costs[ASSISTANT] + INSERT), min(costs[ASSISTANT], costs[USER] + INSERT)
    return min(costs[START], u + INSERT), min(costs[SYSTEM], u + INSERT), u, a


def costs_back(rows: list[_ROW], after: tuple[int, ...]) -> list[tuple[int, ...]]:
    """The cost to go before each row, and after the last."""
    out = [after]
    for row in reversed(rows):
        out.append(step_back(row, out[-1]))
    return out[::-1]


def walk(rows: list[_ROW], costs: list[tuple[int, ...]], state: int, ends: bool) -> tuple[list[tuple[str, str, str]], int]:
    """The edits (letter, role, text) from a state on, and the state that they end in; ``ends``: nothing comes after the rows."""
    edits = []
    for i, (role, text, wrong) in enumerate(rows):
        more, kept = TRUNCATED if wrong == 3 else 0, KEPT.get(role[:1])
        while True:
            here, after = costs[i][state], costs[i + 1]
            if here == after[state] + DELETE:
                edits.append(("D", role, text))
                break
            to = NEXT[state]
            if here == costs[i][to] + INSERT:
                edits.append(("I", ROLE[to], ""))
                state = to
                continue
            if kept and kept[state] is not None and here == after[kept[state]] + KEEP + more:
                edits.append(("K", role, text))
                state = kept[state]
            else:
                edits.append(("R", ROLE[to], text))
                state = to
            break
    while ends and costs[-1][state]:
        state = NEXT[state]
        edits.append(("I", ROLE[state], ""))
    return edits, state


def across(rows: list[_ROW]) -> list[list[int]]:
    """The least cost from each state before the rows to each state after them."""
    ends = []
    for end in range(4):
        goal = [NEVER] * 4
        goal[end] = 0
        ends.append(costs_back(rows, tuple(goal))[0])
    return [[ends[end][start] for end in range(4)] for start in range(4)]


def _flagged(rows: list[tuple]) -> list[_ROW]:
    seen, out = set(), []
    for role, text in rows:
        key = (role, text)
        out.append((role, text, fault(text, key in seen)))
        seen.add(key)
    return out


def repair(rows: list[_ROW]) -> tuple[int, str, list[tuple[str, str, str]]]:
    """(cost, audit, edits) of one conversation."""
    costs = costs_back(rows, AT_END)
    edits, _ = walk(rows, costs, START, True)
    return costs[0][START], "".join(e[0] for e in edits), edits


_SUMMARY = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_TURNS = "conv_id long, place long, edit string, role string, text string"
_NAMES = [f.split()[0] for f in _SUMMARY.split(", ")]
_TYPES = [pa.int64()] * 7 + [pa.string()] * 2


def _conversations(iterator: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple[int | None, list[tuple]]]:
    """Runs of rows of one conversation; names[0] is its id."""
    held, current = [], None
    for batch in batches(iterator, 4 << 20):
        for conv, *row in zip(*(batch[n].to_pylist() for n in names), strict=True):
            if held and conv != current:
                yield current, held
                held = []
            current = conv
            held.append(row)
    if held:
        yield current, held


def _whole(iterator: Iterator[pa.RecordBatch], turns: bool) -> Iterator[pa.RecordBatch]:
    out: list[list] = [[] for _ in range(5 if turns else 9)]
    held = 0
    for conv, taken in _conversations(iterator, ["conv_id", "turn", "role", "text"]):
        rows = _flagged([(role, text) for _, role, text in taken])
        cost, audit, edits = repair(rows)
        if turns:
            stays = [e for e in edits if e[0] != "D"]
            found = [[conv] * len(stays), list(range(len(stays))), *map(list, zip(*stays, strict=True))] if stays else []
            for column, more in zip(out, found, strict=False):
                column.extend(more)
            held += sum(len(e[2]) + 20 for e in stays)
        else:
            at = [t for t, _, _ in taken if t is not None]
            initials = [role[:1] for role, _, _ in rows]
            text = "\n".join(f"{role}:{text}" for letter, role, text in edits if letter != "D")
            row = [conv, max(at) - min(at) + 1 - len(set(at)) if at else 0, *(sum(r[2] == k for r in rows) for k in (1, 2, 3)), sum(a + b not in LEGAL for a, b in zip(initials, initials[1:], strict=False)), cost, audit, hashlib.sha256(text.encode()).hexdigest()]
            for column, value in zip(out, row, strict=True):
                column.append(value)
            held += len(audit) + 200
        if held > 4 << 20:
            yield _batch(out, turns)
            out, held = [[] for _ in out], 0
    if out[0]:
        yield _batch(out, turns)


def _batch(columns: list[list], turns: bool) -> pa.RecordBatch:
    if turns:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()], strict=True)], ["conv_id", "place", "edit", "role", "text"])
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _TYPES, strict=True)], _NAMES)


def _key() -> Column:
    return F.coalesce(F.col("conv_id").cast("string"), F.lit("null"))


def long_conversations(rows: DataFrame, most_rows: int = LONG_ROWS, most_chars: int = LONG_CHARS) -> DataFrame:
    """(key) of conversations that one task should not hold."""
    return rows.groupBy(_key().alias("key")).agg(F.count("*").alias("n"), F.sum(F.length("text") + 16).alias("chars")).where((F.col("n") > most_rows) | (F.col("chars") > most_chars)).select("key")


def _split(rows: DataFrame, most_rows: int, most_chars: int) -> tuple[DataFrame, DataFrame | None]:
    """Rows of short conversations, and of long ones if there are any."""
    found = cut(long_conversations(rows, most_rows, most_chars))
    if found.isEmpty():
        return rows, None
    return rows.join(found, _key() == F.col("key"), "left_anti"), rows.join(found, _key() == F.col("key"), "left_semi")


def _short(rows: DataFrame, turns: bool) -> DataFrame:
    own = rows.select("conv_id", "turn", "role", "text").repartition("conv_id").sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "text")
    return map_arrow(own, partial(_whole, turns=turns), _TURNS if turns else _SUMMARY)


def _blocks(rows: DataFrame, block_rows: int) -> DataFrame:
    """(conv_id, seq, block, turn, role, text, wrong) of long conversations: seq is the order, wrong the fault."""
    order = ["conv_id", F.asc_nulls_first("turn"), "role", F.substring("text", 1, 64), "digest", "salt"]
    own = rows.select("conv_id", "turn", "role", "text", F.sha2(F.concat_ws(":", F.length("role").cast("string"), "role", "text"), 256).alias("digest"), F.monotonically_increasing_id().alias("salt"))
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    path = fresh_dir(rows.sparkSession, "turns")
    own.repartitionByRange(n, *order).sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "text", "salt").withColumn("seq", F.monotonically_increasing_id()).write.parquet(path)
    own = rows.sparkSession.read.parquet(path)
    firsts = own.groupBy("conv_id", "digest").agg(F.min("seq").alias("seq")).select("seq", F.lit(True).alias("is_first"))
    last = F.regexp_extract("text", r"([^ \t-\r])[ \t-\r]*\z", 1)
    wrong = F.when(last == "", 1).when(F.col("is_first").isNull(), 2).when(~last.isin(".", "!", "?"), 3).otherwise(0)
    block = F.floor(F.col("seq") / (1 << 33)) * (1 << 20) + F.floor((F.col("seq") % (1 << 33)) / block_rows)
    return own.join(firsts, "seq", "left").select("conv_id", "seq", block.alias("block"), "turn", "role", "text", wrong.cast("int").alias("wrong"))


def _block_rows(table: pa.Table) -> tuple[pa.Table, list[_ROW]]:
    """The rows of a block, with their seq in place of the text."""
    table = table.sort_by("seq")
    return table, list(zip(table["initial"].to_pylist(), table["seq"].to_pylist(), table["wrong"].to_pylist(), strict=True))


def _block_costs(table: pa.Table) -> pa.Table:
    table, rows = _block_rows(table)
    flat = [c for line in across(rows) for c in line]
    return pa.table({"conv_id": table["conv_id"][:1], "block": table["block"][:1], "across": pa.array([flat], pa.list_(pa.int64()))})


def _hand_over(table: pa.Table) -> pa.Table:
    """Cost to go after each block of a conversation and the state it is entered in."""
    table = table.sort_by("block")
    lines = [[flat[4 * s : 4 * s + 4] for s in range(4)] for flat in table["across"].to_pylist()]
    after = [AT_END]
    for line in reversed(lines):
        last = after[-1]
        after.append(tuple(min(c + x for c, x in zip(line[s], last, strict=True)) for s in range(4)))
    after = after[::-1]
    n = len(lines)
    return pa.table({"conv_id": table["conv_id"], "block": table["block"], "after": pa.array([list(a) for a in after[1:]], pa.list_(pa.int64())), "cost": pa.array([after[0][START]] * n, pa.int64())})


def _exits(table: pa.Table) -> pa.Table:
    """For each state that a block may be entered in, the state that its cheapest walk ends in."""
    table, rows = _block_rows(table)
    costs = costs_back(rows, tuple(table["after"][0].as_py()))
    return pa.table({"conv_id": table["conv_id"][:1], "block": table["block"][:1], "leads": pa.array([[walk(rows, costs, s, False)[1] for s in range(4)]], pa.list_(pa.int32()))})


def _entries(table: pa.Table) -> pa.Table:
    table = table.sort_by("block")
    states = [START]
    for leads in table["leads"].to_pylist():
        states.append(leads[states[-1]])
    last = [False] * (table.num_rows - 1) + [True]
    return pa.table({"conv_id": table["conv_id"], "block": table["block"], "state": pa.array(states[:-1], pa.int32()), "last": pa.array(last)})


def _walked(table: pa.Table) -> pa.Table:
    table, rows = _block_rows(table)
    costs = costs_back(rows, tuple(table["after"][0].as_py()))
    edits, _ = walk(rows, costs, table["state"][0].as_py(), table["last"][0].as_py())
    n = len(edits)
    columns = {"edit": pa.array([e[0] for e in edits], pa.string()), "new_role": pa.array([None if e[0] in "DK" else e[1] for e in edits], pa.string()), "seq": pa.array([None if e[0] == "I" else e[2] for e in edits], pa.int64())}
    return pa.table({"conv_id": pa.array([table["conv_id"][0].as_py()] * n, pa.int64()), "block": pa.array([table["block"][0].as_py()] * n, pa.int64()), "at": pa.array(range(n), pa.int32()), **columns})


def _long(rows: DataFrame, block_rows: int) -> tuple[DataFrame, DataFrame]:
    """(summary of long conversations, edits in order) through blocks."""
    own = _blocks(rows, block_rows)
    short = cut(own.select("conv_id", "block", "seq", F.substring("role", 1, 1).alias("initial"), "wrong"))
    keys = ["conv_id", "block"]
    costs = cut(short.groupBy(*keys).applyInArrow(_block_costs, "conv_id long, block long, across array<long>"))
    handed = cut(costs.groupBy("conv_id").applyInArrow(_hand_over, "conv_id long, block long, after array<long>, cost long"))
    ready = _beside(short, handed.drop("cost"), keys)
    exits = cut(ready.groupBy(*keys).applyInArrow(_exits, "conv_id long, block long, leads array<int>"))
    entered = cut(exits.groupBy("conv_id").applyInArrow(_entries, "conv_id long, block long, state int, last boolean"))
    walked = _beside(ready, entered, keys).groupBy(*keys).applyInArrow(_walked, "conv_id long, block long, at int, edit string, new_role string, seq long")
    texts = own.select(F.col("seq").alias("s"), F.col("role").alias("old_role"), F.col("text").alias("old_text"))
    edits = cut(walked.join(texts, F.col("seq") == F.col("s"), "left").select("conv_id", "block", "at", "edit", F.coalesce("new_role", "old_role").alias("role"), F.coalesce("old_text", F.lit("")).alias("text")))
    return _long_summary(own, handed, edits), edits


def _beside(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """An equi-join in which null ids are equal."""
    named = right.withColumnsRenamed({k: f"__{k}" for k in keys})
    condition = F.col(keys[0]).eqNullSafe(F.col(f"__{keys[0]}"))
    for k in keys[1:]:
        condition &= F.col(k).eqNullSafe(F.col(f"__{k}"))
    return left.join(named, condition, "left").drop(*[f"__{k}" for k in keys])


def _long_summary(own: DataFrame, handed: DataFrame, edits: DataFrame) -> DataFrame:
    turn = F.col("turn")
    faults = [F.count_if(F.col("wrong") == i).alias(FAULTS[i]) for i in (1, 2, 3)]
    counts = own.groupBy("conv_id").agg(F.coalesce(F.max(turn) - F.min(turn) + 1 - F.count_distinct(turn), F.lit(0)).cast("long").alias("gaps"), *faults)
    initials = F.transform(F.array_sort(F.collect_list(F.struct("seq", F.substring("role", 1, 1).alias("i")))), lambda x: x["i"])
    illegal = lambda pairs: F.size(F.filter(pairs, lambda p: ~p.isin(*LEGAL))).cast("long")
    inside = own.groupBy("conv_id", "block").agg(initials.alias("i"))
    inside = inside.select("conv_id", "block", illegal(F.zip_with(F.slice("i", 1, F.size("i") - 1), F.slice("i", 2, F.size("i")), lambda a, b: F.concat(a, b))).alias("n"), F.get("i", F.lit(0)).alias("first"), F.element_at("i", -1).alias("last"))
    by_block = inside.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("block", "first", "last"))).alias("b"), F.sum("n").alias("n"))
    between = illegal(F.zip_with(F.slice("b", 1, F.size("b") - 1), F.slice("b", 2, F.size("b")), lambda a, b: F.concat(a["last"], b["first"])))
    broken = by_block.select("conv_id", (F.col("n") + between).alias("illegal"))
    letters = edits.groupBy("conv_id", "block").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "edit"))), lambda x: x["edit"]), "").alias("a"))
    audits = letters.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "a"))), lambda x: x["a"]), "").alias("audit"))
    cost = handed.groupBy("conv_id").agg(F.max("cost").alias("cost"))
    digests = map_arrow(edits.where("edit <> 'D'").select("conv_id", "block", "at", "role", "text").repartition("conv_id").sortWithinPartitions("conv_id", "block", "at"), _digests, "conv_id long, repaired_sha256 string")
    out = counts
    for part in (broken, cost, audits, digests):
        out = _beside(out, part, ["conv_id"])
    return out.select(*_NAMES[:-1], F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))


def _digests(iterator: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    digest, current, started = None, None, False
    done = lambda: pa.RecordBatch.from_arrays([pa.array([current], pa.int64()), pa.array([digest.hexdigest()])], ["conv_id", "repaired_sha256"])
    for batch in iterator:
        for conv, role, text in zip(batch["conv_id"].to_pylist(), batch["role"].to_pylist(), batch["text"].to_pylist(), strict=True):
            if digest is None or conv != current:
                if digest is not None:
                    yield done()
                digest, current, started = hashlib.sha256(), conv, False
            digest.update(f"{chr(10) * started}{role}:{text}".encode())
            started = True
    if digest is not None:
        yield done()


def repaired(rows: DataFrame, most_rows: int = LONG_ROWS, most_chars: int = LONG_CHARS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of each conversation of rows (conv_id, turn, role, text)."""
    short, long = _split(rows, most_rows, most_chars)
    out = _short(short, False)
    return out if long is None else out.unionByName(_long(long, block_rows)[0])


def repaired_turns(rows: DataFrame, most_rows: int = LONG_ROWS, most_chars: int = LONG_CHARS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The repaired conversations: (conv_id, place, edit, role, text), where place orders a conversation's turns."""
    short, long = _split(rows, most_rows, most_chars)
    out = _short(short, True)
    if long is None:
        return out
    edits = _long(long, block_rows)[1].where("edit <> 'D'")
    return out.unionByName(edits.select("conv_id", ((F.col("block") + 1) * (1 << 20) + F.col("at")).alias("place"), "edit", "role", "text"))


def op13_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    found = repaired(damaged(conversations))
    ids = conversations.select(F.col("conv_id").cast("long").alias("id")).distinct()
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    joined = ids.join(found, F.col("id").eqNullSafe(F.col("conv_id")), "left")
    return joined.select(F.col("id").alias("conv_id"), *[zero(c) for c in _NAMES[1:7]], F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))
