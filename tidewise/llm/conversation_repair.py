"""Conversation structure repair by Knuth's lightest-derivation agenda.

An item (i, q, x) says that the rows from place i on can be edited so that their roles lead the role automaton from
state q to state x. The axioms are (n, x, x) with cost 0 and an empty audit; Keep, Rerole and Delete
derive an item from one of the next place, Insert derives one of the same place. Derivations run from the
last row to the first, so that an edit is put before the audit of the rest: then a smaller audit stays smaller.
Items leave the agenda by (cost, rows done, audit). Every edit makes that key larger (Insert has a cost, the others
do a row), and keeps the order of two derivations of one item, so the functions are monotone and superior and an item
is final when it is popped; the search stops as soon as the goal item is.

Long conversations are cut into blocks that are deduced for every pair of states and then joined like
matrices. This is exact: of two audits of the same rows, states and cost neither begins the other
(the longer would have more inserts, so a higher cost), so their order does not depend on what follows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from heapq import heappop, heappush
from itertools import groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewise.llm.common import look_up, read, saved

#: Role automaton of ``(s?(ua)+)?``: state, role initial -> state.
STEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
STATES, START, ACCEPT = range(4), 0, (0, 3)
BACK = {(r, c): [q for q in STATES if STEP.get((q, c)) == r] for r in STATES for c in "sua"}
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
LEGAL = {"su", "ua", "au"}
#: Rows that one agenda takes; the blocks of a longer conversation are joined.
BLOCK = 64
WHITE = " \t\n\x0b\x0c\r"

Derived = tuple[int, str]
#: Lightest (cost, audit) by (state before, state after).
Table = dict[tuple[int, int], Derived]


def lightest(codes: str, whole: bool) -> Table:
    """Lightest derivations of a block of rows: of the goal item alone if ``whole``, else for all pairs of states.

    A code is the role initial of a row (``x``: another one), a capital if the row is truncated, ``-`` if
    it must go. The result of ``whole`` is the entry (START, final state).
    """
    n = len(codes)
    agenda: list[tuple[int, int, str, int, int]] = [(0, 0, "", x, x) for x in (ACCEPT if whole else STATES)]
    final: set[tuple[int, int, int]] = set()
    out: Table = {}
    while agenda:
        cost, done, audit, r, x = heappop(agenda)
        if (done, r, x) in final:
            continue
        final.add((done, r, x))
        if done == n:
            if not whole:
                out[r, x] = (cost, audit)
            elif r == START:
                return {(r, x): (cost, audit)}
        for c in "ua":
            for q in BACK[r, c]:
                heappush(agenda, (cost + INSERT, done, "I" + audit, q, x))
        if done < n:
            code = codes[n - 1 - done]
            heappush(agenda, (cost + DELETE, done + 1, "D" + audit, r, x))
            if code != "-":
                own = cost + (TRUNCATED if code.isupper() else 0)
                for q in BACK.get((r, code.lower()), ()):
                    heappush(agenda, (own + KEEP, done + 1, "K" + audit, q, x))
                for c in "ua":
                    for q in BACK[r, c]:
                        heappush(agenda, (own + REROLE, done + 1, "R" + audit, q, x))
    return out


_known = lru_cache(maxsize=1 << 14)(lightest)


def joined(a: Table, b: Table) -> Table:
    """Table of the rows of ``a`` followed by those of ``b``."""
    out: Table = {}
    for (q, m), (cost, audit) in a.items():
        for x in STATES:
            if (m, x) in b:
                new = (cost + b[m, x][0], audit + b[m, x][1])
                if (q, x) not in out or new < out[q, x]:
                    out[q, x] = new
    return out


class _Run:
    """Rows of one conversation in one range; equal-sized tables are joined first, like the digits of a counter."""

    def __init__(self) -> None:
        self.codes, self.tables, self.faults = "", [], [0, 0, 0]

    def add(self, codes: str, faults: Iterable[int]) -> None:
        self.faults = [a + b for a, b in zip(self.faults, faults, strict=True)]
        self.codes += codes
        while len(self.codes) > BLOCK:
            self._push(_known(self.codes[:BLOCK], False))
            self.codes = self.codes[BLOCK:]

    def _push(self, table: Table, size: int = 1) -> None:
        while self.tables and self.tables[-1][1] <= size:
            before, n = self.tables.pop()
            table, size = joined(before, table), size + n
        self.tables.append((table, size))

    def table(self, may_continue: bool) -> Table:
        if not self.tables and not may_continue:
            return _known(self.codes, True)
        self._push(_known(self.codes, False))
        return _all_joined([t for t, _ in self.tables])


def _all_joined(tables: list[Table]) -> Table:
    while len(tables) > 1:
        tables = [joined(*tables[i:i + 2]) if i + 1 < len(tables) else tables[i] for i in range(0, len(tables), 2)]
    return tables[0]


_PART = "part int, states array<int>, costs array<long>, audits array<string>, blank long, duplicate long, truncated long"


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The table of each conversation's rows in this range of the sorted rows."""
    part, first = TaskContext.get().partitionId(), True

    def rows() -> Iterator[tuple]:
        for b in batches:
            ids.append(b.schema.field(0).type)
            yield from zip(*[b.column(c).to_pylist() for c in ("conv_id", "code", "m", "blank", "duplicate", "truncated")], strict=True)

    ids: list[pa.DataType] = []
    waiting: list[tuple] = []

    def flush(last: bool) -> Iterator[pa.RecordBatch]:
        ready = waiting if last else waiting[:-1]
        if ready:
            out = [[] for _ in range(8)]
            for i, (conv, run, at_start) in enumerate(ready):
                # only the first and the last conversation of a range can have rows in other ranges
                table = run.table(at_start or (last and i == len(ready) - 1))
                row = [conv, part, [4 * q + x for q, x in table], [c for c, _ in table.values()], [a for _, a in table.values()], *run.faults]
                for column, value in zip(out, row, strict=True):
                    column.append(value)
            kinds = [ids[0], pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.string()), *[pa.int64()] * 3]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, kinds, strict=True)],
                                             names=["conv_id", "part", "states", "costs", "audits", "blank", "duplicate", "truncated"])
        del waiting[:len(ready)]

    for conv, group in groupby(rows(), key=lambda r: r[0]):
        run = _Run()
        for _, code, m, *faults in group:
            run.add(code, faults)
            for lo in range(1, m, 1 << 16):  # further copies of the row are duplicates
                run.add("-" * min(m - lo, 1 << 16), (0, 0, 0))
        waiting.append((conv, run, first))
        first = False
        if len(waiting) > 1000:
            yield from flush(False)
    yield from flush(True)


_AUDIT = ("conv_id", "cost", "audit", "blank", "duplicate", "truncated")


def _audits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a conversation from the tables of its ranges, which come in order."""
    ids: list[pa.DataType] = []

    def rows() -> Iterator[dict]:
        for b in batches:
            ids.append(b.schema.field(0).type)
            yield from b.to_pylist()

    out: list[tuple] = []

    def batch() -> pa.RecordBatch:
        kinds = [ids[0], pa.int64(), pa.string(), *[pa.int64()] * 3]
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out, strict=True), kinds, strict=True)], names=list(_AUDIT))

    for conv, group in groupby(rows(), key=lambda r: r["conv_id"]):
        tables, faults = [], [0, 0, 0]
        for r in group:
            tables.append({divmod(s, 4): (c, a) for s, c, a in zip(r["states"], r["costs"], r["audits"], strict=True)})
            faults = [n + r[f] for n, f in zip(faults, _AUDIT[3:], strict=True)]
        whole = _all_joined(tables)
        out.append((conv, *min(whole[START, x] for x in ACCEPT if (START, x) in whole), *faults))
        if len(out) >= 1000 or len(out[-1][2]) > 1 << 20:
            yield batch()
            out = []
    if out:
        yield batch()


def _initial(role: Column) -> Column:
    return F.substring(role, 1, 1)


_ORDER = ("conv_id", "turn", "role", "digest")


def audits(rows: DataFrame) -> DataFrame:
    """(conv_id, cost, audit, blank, duplicate, truncated) of rows (conv_id, turn, role, text, digest) without nulls in role or text."""
    last = F.substring(F.rtrim(F.col("text"), F.lit(WHITE)), -1, 1)
    ending = F.when(last == "", "blank").when(last.isin(".", "!", "?"), "whole").otherwise("truncated")
    # equal rows of one turn are one row with a number; texts do not go on
    equal = saved(rows.withColumn("ending", ending).groupBy(*_ORDER, "ending").agg(F.count(F.lit(1)).alias("m"))
                  .withColumn("said", F.unhex(F.sha2(F.concat(F.to_json(F.struct("conv_id", "role")), F.hex("digest")), 256))), "turns")
    when = F.struct(F.col("turn").isNotNull().alias("known"), F.coalesce(F.col("turn").cast("long"), F.lit(0)).alias("turn"))
    firsts = saved(equal.groupBy("said").agg(F.min(when).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1"), "firsts")
    blank = F.col("ending") == "blank"
    again = ~blank & F.coalesce(F.col("first") < when, F.lit(False))
    initial = F.when(_initial(F.col("role")).isin("s", "u", "a"), _initial(F.col("role"))).otherwise("x")
    cut = ~blank & ~again & (F.col("ending") == "truncated")
    coded = look_up(equal, "said", firsts, "n", "said").select(
        *_ORDER, F.col("m").cast("long").alias("m"), F.when(blank | again, "-").when(cut, F.upper(initial)).otherwise(initial).alias("code"),
        F.when(blank, F.col("m")).otherwise(0).cast("long").alias("blank"),
        F.when(blank, 0).otherwise(F.col("m") - 1 + again.cast("long")).cast("long").alias("duplicate"), cut.cast("long").alias("truncated"))
    coded = saved(coded, "codes")
    conv = T.StructType([rows.schema["conv_id"]]).simpleString()[len("struct<"):-1].replace(":", " ", 1)
    parts = saved(coded.repartitionByRange(*_ORDER).sortWithinPartitions(*_ORDER).mapInArrow(_parts, f"{conv}, {_PART}"), "parts")
    schema = f"{conv}, cost long, audit string, blank long, duplicate long, truncated long"
    return parts.repartition("conv_id").sortWithinPartitions("conv_id", "part").mapInArrow(_audits, schema)


def _role_in(state: int) -> str:
    return "assistant" if state == 2 else "user"


def _edits(rows: Iterator[dict]) -> Iterator[dict]:
    """The head row of each conversation, then a row for every edit of its audit."""
    for _, group in groupby(rows, key=lambda r: r["conv_id"]):
        head = next(group)
        audit, at, state, place = head["text"], 0, START, 0
        yield {**head, "edit": None, "text": None, "place": None, "new_role": None, "audit": audit}

        def insert(head: dict = head) -> dict:
            return {**dict.fromkeys(head), "conv_id": head["conv_id"], "kind": 1, "edit": "I", "place": place,
                    "new_role": _role_in(state), "text": "", "audit": None}

        for r in group:
            while audit[at] == "I":
                yield insert()
                state, place, at = STEP[state, _role_in(state)[0]], place + 1, at + 1
            edit, at = audit[at], at + 1
            role = None if edit == "D" else r["role"] if edit == "K" else _role_in(state)
            yield {**r, "edit": edit, "new_role": role, "place": None if role is None else place, "audit": None}
            if role is not None:
                state, place = STEP[state, role[0]], place + 1
        while at < len(audit):
            yield insert()
            state, place, at = STEP[state, _role_in(state)[0]], place + 1, at + 1


def _batched(rows: Iterator[dict], schema: pa.Schema, sized: str) -> Iterator[pa.RecordBatch]:
    out, size = [], 0
    for r in rows:
        out.append(r)
        size += len(r[sized] or "")
        if len(out) >= 2000 or size > 4 << 20:
            yield pa.RecordBatch.from_pylist(out, schema)
            out, size = [], 0
    if out:
        yield pa.RecordBatch.from_pylist(out, schema)


def _edited(conversations: DataFrame, conv_id: str, turn: str, role: str, text: str) -> DataFrame:
    """Head rows (kind 0) and edit rows (kind 1), each conversation in order within one partition.

    A text goes through one task, in a stream that is sorted on disk; a conversation is never held whole.
    """
    def one_space(c: str) -> Column:
        return F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" "))

    rows = conversations.select(F.col(f"`{conv_id}`").alias("conv_id"), F.col(f"`{turn}`").cast("long").alias("turn"),
                                one_space(role).alias("role"), one_space(text).alias("text"))
    rows = rows.withColumn("digest", F.unhex(F.sha2("text", 256)))
    numbers = ["cost", "blank", "duplicate", "truncated"]
    heads = saved(audits(rows), "audits").withColumnRenamed("audit", "text").withColumn("kind", F.lit(0))
    lines = heads.unionByName(rows.withColumn("kind", F.lit(1)), allowMissingColumns=True)
    # the audit comes first; the order of the rows is that of the audit
    lines = lines.repartition("conv_id").sortWithinPartitions("conv_id", "kind", "turn", "role", "digest")
    lines = lines.select("conv_id", "kind", "turn", "role", "text", *numbers)
    schema = T.StructType([f if f.name != "kind" else T.StructField("kind", T.IntegerType()) for f in lines.schema] + [
        T.StructField("edit", T.StringType()), T.StructField("place", T.LongType()), T.StructField("new_role", T.StringType()),
        T.StructField("audit", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds: list[pa.Schema] = []

        def stream() -> Iterator[dict]:
            for b in batches:
                if not kinds:
                    own = {f.name: f.type for f in b.schema}
                    more = {"edit": pa.string(), "place": pa.int64(), "new_role": pa.string(), "audit": pa.string()}
                    kinds.append(pa.schema(list((own | more).items())))
                for lo in range(0, b.num_rows, 256):  # few texts are Python strings at a time
                    yield from b.slice(lo, 256).to_pylist()

        rows = _edits(stream())
        first = next(rows, None)
        if first is not None:
            yield from _batched((r for part in ((first,), rows) for r in part), kinds[0], "text")

    return lines.mapInArrow(run, schema)


def repair_conversations(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role",
                         text: str = "text") -> DataFrame:
    """The edits of all conversations: (conv_id, place, edit, turn, old_role, role, text), a row for each.

    ``edit`` is K(eep), R(erole), D(elete) or I(nsert); ``place`` counts the rows of the repaired conversation from 0
    and is null for deleted rows. So the rows with a place, in that order, are the repaired
    conversations. They are the cheapest whose role initials form ``(s?(ua)+)?``, ties go to the ASCII-least audit.

    The rows of a conversation are taken by turn, null turns first; rows of one turn by role, then by the SHA-256 of their
    text, so that repeated rows stand together (all but the first are duplicates). A null role or text is one space, a null
    conv_id is a conversation of its own. Conversations whose rows all go have only deleted rows; an empty
    table gives an empty result. Other columns are not read. Memory: 64 rows a deduction, and the audits (a byte a
    row) of one conversation.
    """
    rows = _edited(conversations, conv_id, turn, role, text).filter("kind = 1")
    return rows.select("conv_id", "place", "edit", "turn", F.col("role").alias("old_role"), F.col("new_role").alias("role"), "text")


def _report(rows: Iterator[dict]) -> Iterator[dict]:
    """One row a conversation: its head, figures of the rows as they were, and the hash of the repaired ones."""
    for conv, group in groupby(rows, key=lambda r: r["conv_id"]):
        head = next(group)
        illegal, low, high, turns, before, sha, n = 0, None, None, 0, None, hashlib.sha256(), 0
        for r in group:
            if r["edit"] != "I":
                initial = r["role"][:1]
                illegal += before is not None and before + initial not in LEGAL
                before = initial
                if r["turn"] is not None:
                    turns += r["turn"] != high
                    low, high = r["turn"] if low is None else low, r["turn"]
            if r["new_role"] is not None:
                sha.update(f"{chr(10) if n else ''}{r['new_role']}:{r['text']}".encode())
                n += 1
        gaps = 0 if low is None else high - low + 1 - turns
        yield {"conv_id": conv, "gaps": gaps, "blank": head["blank"], "duplicate": head["duplicate"], "truncated": head["truncated"],
               "illegal": illegal, "cost": head["cost"], "audit": head["audit"], "repaired_sha256": sha.hexdigest()}


def repair_report(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """A row for each conversation: gaps, faults, illegal neighbours, cost, audit and the hash of the repaired rows.

    The hash runs over ``role:text`` of the repaired rows, joined by newlines. Nulls, ties and empty tables
    are as in :func:`repair_conversations`.
    """
    edited = _edited(conversations, conv_id, turn, role, text)
    numbers = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    schema = T.StructType([edited.schema["conv_id"]] + [T.StructField(c, T.LongType()) for c in numbers]
                          + [T.StructField(c, T.StringType()) for c in ("audit", "repaired_sha256")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds: list[pa.Schema] = []

        def stream() -> Iterator[dict]:
            for b in batches:
                if not kinds:
                    kinds.append(pa.schema([("conv_id", b.schema.field("conv_id").type), *[(c, pa.int64()) for c in numbers],
                                            ("audit", pa.string()), ("repaired_sha256", pa.string())]))
                yield from b.to_pylist()

        rows = _report(stream())
        first = next(rows, None)
        if first is not None:
            yield from _batched((r for part in ((first,), rows) for r in part), kinds[0], "audit")

    return edited.mapInArrow(run, schema)


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows of ``conversations`` after the damage that crc32 of ``conv_id:turn`` gives; ``dropped`` marks those that go."""
    def one_space(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    kind = F.crc32(F.concat(one_space("conv_id"), F.lit(":"), one_space("turn")).cast("binary")) % 20
    text, role = one_space("text"), one_space("role")
    rows = conversations.select("conv_id", "turn", kind.alias("damage"), F.when(kind == 4, "user").otherwise(role).alias("role"),
                                F.when(kind == 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"))
    twice = F.explode(F.when(F.col("damage") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.withColumn("copy", twice).withColumn("dropped", F.col("damage") == 0).drop("copy", "damage")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = damaged(read(spark, sf_dir, "conversations"))
    gone = rows.groupBy("conv_id").agg(F.min("dropped").alias("all_dropped")).filter("all_dropped").select(
        "conv_id", *[F.lit(0).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
        F.lit("").alias("audit"), F.sha2(F.lit("").cast("binary"), 256).alias("repaired_sha256"))
    return repair_report(rows.filter(~F.col("dropped"))).unionByName(gone)
