import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest

from wordpair.llm import conversation_repair as R

SCHEMA = "conv_id long, turn long, role string, text string"


def filled(x):
    return " " if x is None else str(x)


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        fate = zlib.crc32(f"{filled(conv)}:{filled(turn)}".encode()) % 20
        role, text = filled(role), filled(text)
        if fate == 0:
            continue
        text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
        role = "user" if fate == 4 else role
        out += [(conv, turn, role, text)] * (2 if fate == 3 else 1)
    return out


NEXT, FITS = {0: 2, 1: 2, 2: 3, 3: 2}, {0: "user", 1: "user", 2: "assistant", 3: "user"}


def cheapest(rows):
    """(cost, audit, lines) by dynamic programming over whole prefixes."""
    def inserts(best):
        for _ in range(3):
            for q, (c, a, o) in list(best.items()):
                new = (c + 3, a + "I", [*o, FITS[q] + ":"])
                if NEXT[q] not in best or new < best[NEXT[q]]:
                    best[NEXT[q]] = new
        return best

    best = {0: (0, "", [])}
    for role, text, fault in rows:
        after = {}

        def put(q, cost, audit, lines, after=after):
            if q not in after or (cost, audit) < after[q][:2]:
                after[q] = (cost, audit, lines)

        for q, (c, a, o) in inserts(dict(best)).items():
            put(q, c + 4, a + "D", o)
            if fault in ("blank", "duplicate"):
                continue
            extra = 3 if fault == "truncated" else 0
            put(NEXT[q], c + 3 + extra, a + "R", [*o, f"{FITS[q]}:{text}"])
            if q == 0 and role[:1] == "s":
                put(1, c + extra, a + "K", [*o, f"{role}:{text}"])
            elif role[:1] == FITS[q][0]:
                put(NEXT[q], c + extra, a + "K", [*o, f"{role}:{text}"])
        best = after
    best = inserts(dict(best))
    return min((best[q] for q in (0, 3) if q in best), key=lambda x: x[:2])


def brute(rows, ids):
    out = {}
    for conv in ids:
        mine = sorted((r for r in rows if r[0] == conv),
                      key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
        turns = [r[1] for r in mine if r[1] is not None]
        seen, faults = set(), []
        for _, _, role, text in mine:
            solid = re.findall(r"[^\x20\x09-\x0D]", text)
            faults.append("blank" if not solid else "duplicate" if (role, text) in seen
                          else "truncated" if solid[-1] not in ".!?" else None)
            seen.add((role, text))
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(mine))
        cost, audit, lines = cheapest([(r[2], r[3], f) for r, f in zip(mine, faults, strict=True)])
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
                     *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit,
                     hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def check(spark, rows, **kw):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = R.audit_conversations(R.damage(df), df, **kw).collect()
    assert {r.conv_id: tuple(r)[1:] for r in got} == brute(damage(rows), {r[0] for r in rows})
    assert len(got) == len({r[0] for r in rows})


def random_rows(n, convs, seed=1):
    rnd = random.Random(seed)
    roles = ["user", "assistant", "system", "tool", "", None, "user", "assistant", "umpire"]
    texts = ["a.", "b", "c!", " ", "", None, "x y?", "tail.\n", "é…", *(f"q{i}." for i in range(40))]
    return [(rnd.choice([*range(convs), None]), rnd.choice([*range(n), None]), rnd.choice(roles), rnd.choice(texts))
            for _ in range(n)]


def test_whole_table(spark):
    check(spark, [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").collect()])


def test_random_conversations_with_nulls_ties_and_repeats(spark):
    rows = random_rows(300, 40)
    check(spark, rows + rows[:20])


@pytest.mark.parametrize(("run", "fan", "block"), [(16, 3, 4), (1, 2, 1), (5, 512, 2)])
def test_long_conversations_in_runs(spark, run, fan, block):
    check(spark, random_rows(400, 2, seed=run), run=run, fan=fan, block=block)


def test_every_short_conversation_by_its_table():
    """All strings of up to four symbols: the tables' cost and edits are the cheapest."""
    names = ["system", "user", "assistant", "tool"]
    for block in (1, 3, 4):
        t = R.Tables(block)
        for n in range(5):
            for symbols in itertools.product(range(R.SYMBOLS - 1), repeat=n):
                rows = [(names[s % 4] if s < R.GONE else "user", "x",
                         "blank" if s == R.GONE else "truncated" if s >= 4 else None) for s in symbols]
                s = np.array(symbols, np.int64)
                v, cost = t.back(s)
                edits, _, _, state = t.walk(s, 0, 0)
                want = cheapest(rows)
                assert (int(cost[0]) + t.vectors[v[0]][0], edits + "I" * len(t.close(state))) == want[:2], symbols
            if block != 4 and n == 3:
                break


def test_few_vectors():
    t = R.Tables()
    assert len(t.vectors) == 30 and max(map(max, t.vectors)) <= 2 * R.INSERT
    assert t.to.shape == (30, R.SYMBOLS ** R.BLOCK)


def test_empty_and_extra_columns(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert R.audit_conversations(R.damage(df), df).count() == 0
    rows = random_rows(60, 5)
    df = spark.createDataFrame(rows, SCHEMA)
    more = df.selectExpr("*", *[f"{i} as {c}" for i, c in enumerate(("idx", "run", "fate", "conv", "edit", "nth", "same"))])
    assert sorted(map(tuple, R.audit_conversations(R.damage(more), more).collect()), key=str) == sorted(
        map(tuple, R.audit_conversations(R.damage(df), df).collect()), key=str)


def test_conversations_without_rows_left(spark):
    ids = spark.createDataFrame([(1, 0, "user", "x"), (None, 0, "user", "x")], SCHEMA)
    got = R.audit_conversations(R.damage(ids).limit(0), ids).collect()
    empty = hashlib.sha256().hexdigest()
    assert sorted(map(tuple, got), key=str) == sorted([(1, *[0] * 6, "", empty), (None, *[0] * 6, "", empty)], key=str)


def test_repaired_rows_read_as_asked(spark):
    df = spark.createDataFrame(random_rows(200, 10, seed=9), SCHEMA)
    marked = R.mark_faults(df)
    _, edits = R.repair(marked)
    by_conv = {}
    for r in sorted(R.repaired_rows(marked, edits).collect(), key=lambda r: (r.conv, r.run, r.nth)):
        by_conv.setdefault(r.conv, []).append(r)
    for rows in by_conv.values():
        assert re.fullmatch("(s?(ua)+)?", "".join(r.role[:1] for r in rows if r.edit != "D"))
        assert all((r.role is None) == (r.edit == "D") for r in rows)
