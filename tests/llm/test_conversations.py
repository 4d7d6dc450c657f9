"""Conversation repair against an exhaustive search, whole and in blocks."""

import hashlib
import re
from functools import cache
from zlib import crc32

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql import types as T

from llm_helpers import MEDIUM
from tidewise.llm import conversation_repair as C
from tidewise.llm.common import read

SOLID = re.compile(r"[^\x20\x09-\x0D]")
ROWS = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()),
                     T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        k = crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if k == 0:
            continue
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        out += [(conv, turn, "user" if k == 4 else role, text)] * (2 if k == 3 else 1)
    return out


def in_order(rows):
    return sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.sha256(r[3].encode()).digest()))


def faults(rows):
    out, seen = [], set()
    for _, _, role, text in rows:
        solid = SOLID.findall(text)
        out.append("blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def brute(rows):
    """(cost, audit, repaired rows) by a search over all edits from the front; inserts are tried up to two in a row."""
    bad = faults(rows)
    step = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}

    @cache
    def best(i, last, inserted):
        found = []
        if i == len(rows) and last in ("", "a"):
            found.append((0, "", ()))
        if inserted < 2:
            for role in ("user", "assistant"):
                if role[0] in step[last]:
                    c, a, r = best(i, role[0], inserted + 1)
                    found.append((c + 5, "I" + a, ((role, ""), *r)))
        if i < len(rows):
            _, _, role, text = rows[i]
            c, a, r = best(i + 1, last, 0)
            found.append((c + 2, "D" + a, r))
            if bad[i] not in ("blank", "duplicate"):
                extra = 5 * (bad[i] == "truncated")
                options = [(role, 0, "K")] + [(x, 1, "R") for x in ("user", "assistant")]
                for new, cost, letter in options:
                    if new[:1] in step[last]:
                        c, a, r = best(i + 1, new[0], 0)
                        found.append((c + cost + extra, letter + a, ((new, text), *r)))
        return min(found, default=(10 ** 9, "", ()))

    return best(0, "", 0)


def expected(conv, rows):
    rows = in_order(rows)
    turns = [r[1] for r in rows if r[1] is not None]
    bad = faults(rows)
    pairs = [a[2][:1] + b[2][:1] for a, b in zip(rows, rows[1:], strict=False)]
    cost, audit, repaired = brute(rows)
    return (conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, bad.count("blank"), bad.count("duplicate"),
            bad.count("truncated"), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit,
            hashlib.sha256("\n".join(f"{r}:{t}" for r, t in repaired).encode()).hexdigest())


def by_conversation(rows, ids):
    return sorted((expected(c, [r for r in rows if r[0] == c]) for c in ids), key=repr)


CODES = st.text(alphabet="suaxSUAX-", max_size=9)


def as_rows(codes):
    role = {"s": "system", "u": "user", "a": "assistant", "x": "tool"}
    return [(1, i, role.get(c.lower(), "user"), "" if c == "-" else f"t{i}" + ("" if c.isupper() else ".")) for i, c in enumerate(codes)]


@settings(max_examples=300, deadline=None)
@given(CODES)
def test_agenda_equals_search(codes):
    (found,) = C.lightest(codes, True).values()
    assert found == brute(as_rows(codes))[:2]


@settings(max_examples=200, deadline=None)
@given(CODES, st.integers(0, 9))
def test_blocks_join_exactly(codes, cut):
    table = C.joined(C.lightest(codes[:cut], False), C.lightest(codes[cut:], False))
    assert table == C.lightest(codes, False)
    assert min(table[C.START, x] for x in C.ACCEPT if (C.START, x) in table) == next(iter(C.lightest(codes, True).values()))


def test_ties_need_the_audit_of_the_rest():
    # the same cost by several edits: the ASCII-least audit wins
    for codes in ("uu", "aa", "ua-ua", "suau", "UA", "xuaxa", "auau", "sss"):
        assert next(iter(C.lightest(codes, True).values())) == brute(as_rows(codes))[:2]


def test_query_equals_brute_force(spark):
    rows = [tuple(r) for r in read(spark, MEDIUM, "conversations").select("conv_id", "turn", "role", "text").collect()]
    got = sorted(map(tuple, C.op12_conversation_repair(spark, MEDIUM).collect()), key=repr)
    assert got == by_conversation(damage(rows), {r[0] for r in rows})


EDGE = [(1, 0, "user", "Hi."), (1, 1, "assistant", None), (1, 1, None, "x"), (None, None, "user", "a?"), (None, None, "user", "a?"), (None, 4, None, None),
        (2, None, "user", "b."), (2, None, "assistant", "c. \t\n"), (2, 9, "user", "b."), (3, 5, "", "no"), (3, 5, "sys", "y."), (3, 5, "u", "é"),
        (4, -3, "system", "s."), (4, 2 ** 40, "user", "q"), (4, 7, "assistant", "A" * 50_000 + "!"), (5, 1, "assistant", "   "),
        (6, 0, "user", "."), (6, 0, "user", "."), (6, 0, "user", "."), (7, 1, "a\nb", "x\n:y.")]


@pytest.fixture(params=["true", "false"])
def adaptive(spark, request):
    """Without adaptive execution the ranges of a small table are not put together again."""
    spark.conf.set("spark.sql.adaptive.enabled", request.param)
    yield request.param
    spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_conversations_cut_by_ranges(spark, adaptive):
    # three rows each: some range begins inside a conversation
    rows = [(c, t, ("user", "assistant", "tool", "user")[(c + t) % 4], f"t{c % 5}{t}" + "." * (c % 3 > 0)) for c in range(50) for t in range(3)]
    got = sorted(map(tuple, C.repair_report(spark.createDataFrame(rows, ROWS).repartition(4)).collect()), key=repr)
    assert got == by_conversation(rows, range(50))


def test_edge_rows(spark, adaptive):
    df = spark.createDataFrame(EDGE, ROWS).withColumn("cost", F.lit("c")).withColumn("audit", F.lit(1)).withColumn("kind", F.lit(9))
    full = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in EDGE]
    got = sorted(map(tuple, C.repair_report(df).collect()), key=repr)
    assert got == by_conversation(full, {r[0] for r in EDGE})
    edits = C.repair_conversations(df).collect()
    for conv, audit in {(r[0], r[7]) for r in got}:
        own = [r for r in edits if r.conv_id == conv]
        assert sorted(r.edit for r in own) == sorted(audit)
        kept = sorted((r for r in own if r.place is not None), key=lambda r: r.place)
        assert [r.place for r in kept] == list(range(len(kept)))
        assert re.fullmatch("(s?(ua)+)?", "".join(r.role[0] for r in kept))


def test_one_conversation_over_many_ranges(spark, adaptive):
    rows = [(8, i, ("user", "assistant", "tool")[i * 7 % 11 % 3], f"t{i % 97}" + "." * (i % 5 > 0)) for i in range(900)] + [(9, 0, "user", "x."), (7, 0, "user", "y.")]
    df = spark.createDataFrame(rows, ROWS).repartition(5)
    got = {r.conv_id: r for r in C.repair_report(df).collect()}
    ordered = in_order([r for r in rows if r[0] == 8])
    role = {"user": "u", "assistant": "a", "tool": "x"}
    codes = "".join("-" if f in ("blank", "duplicate") else role[r[2]].upper() if f else role[r[2]] for r, f in zip(ordered, faults(ordered), strict=True))
    (alone,) = C.lightest(codes, True).values()
    assert (got[8].cost, got[8].audit) == alone and got[8].duplicate == faults(ordered).count("duplicate") > 0
    edits = [r for r in C.repair_conversations(df).filter("conv_id = 8 and place is not null").orderBy("place").collect()]
    assert got[8].repaired_sha256 == hashlib.sha256("\n".join(f"{r.role}:{r.text}" for r in edits).encode()).hexdigest()


def test_all_rows_dropped_and_empty_table(spark, tmp_path):
    dropped = next(i for i in range(1000) if crc32(f"{i}:0".encode()) % 20 == 0)
    spark.createDataFrame([(dropped, 0, "user", "x."), (5, 1, "user", "y.")], ROWS).write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: tuple(r)[1:] for r in C.op12_conversation_repair(spark, str(tmp_path)).collect()}
    assert got[dropped] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) and 5 in got
    empty = spark.createDataFrame([], ROWS)
    assert C.repair_report(empty).collect() == [] and C.repair_conversations(empty).collect() == []
