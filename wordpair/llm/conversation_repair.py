"""Cheapest repair of conversation structure, by Four-Russians block tables.

A conversation is a string of symbols, one a row: the role's initial, and whether
the row is truncated or must go.  Edits keep, re-role, delete or insert rows so
that roles read ``(s?(ua)+)?``.  The cost of repairing what is left, seen from each
of the four states of that pattern, is a vector; less its least entry it is one of
few vectors, since two inserts or a delete lead from any state to any other.

* Tables hold, for each such vector behind a block and each block of ``BLOCK``
  symbols, the vector before the block and the cost that was taken off.  A
  conversation is processed a block at a time by lookup, from its end.
* Of equally cheap repairs the one whose edits come first as text counts.  A block
  is expanded backwards from the vector behind it, then walked forwards: each state
  and edit lead to one next state, so the least edit that stays cheapest is right.

Conversations of any length: rows are numbered in order and cut into runs of at most
``RUN`` rows.  A run is a map of vectors (costs) and of states (edits); maps compose,
so :func:`entries` finds what each run starts from with a fan-in of ``FAN`` maps,
and no conversation is ever gathered.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordpair.llm.store import written
from wordpair.operators.ordering import dense_index

#: Costs of the edits, and what a truncated row adds unless it is deleted.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3

#: Symbols: initial (s, u, a, other), the same truncated, must go, nothing.
INITIALS = "sua"
GONE, NOTHING, SYMBOLS = 8, 9, 10
BLOCK = 4
RUN = 4096
FAN = 512
#: Expanded blocks that a task holds.
HELD = 1 << 16

# States: nothing yet, after s, after u, after a.
_NEXT = (2, 2, 3, 2)          # state behind a row that has the role which fits
_FITS = ("u", "u", "a", "u")  # the initial of that role
_ROLE = {"u": "user", "a": "assistant"}
_END = (0, 2 * INSERT, INSERT, 0)


def _keeps(state: int, symbol: int) -> int | None:
    """The state behind a kept row, None where it does not fit."""
    initial = symbol % 4
    if symbol >= GONE or initial == 3:
        return None
    if state == 0 and initial == 0:
        return 1
    return _NEXT[state] if INITIALS[initial] == _FITS[state] else None


def _before(vector: tuple, symbol: int) -> tuple:
    """Costs before a symbol from those behind it (neither normalised)."""
    if symbol == NOTHING:
        return vector
    extra = TRUNCATED if 4 <= symbol < GONE else 0
    cost = []
    for q in range(4):
        ways = [vector[q] + DELETE]
        if symbol != GONE:
            ways.append(vector[_NEXT[q]] + REROLE + extra)
            to = _keeps(q, symbol)
            if to is not None:
                ways.append(vector[to] + extra)
        cost.append(min(ways))
    for _ in range(3):   # inserts before the row, at most two of use
        cost = [min(cost[q], cost[_NEXT[q]] + INSERT) for q in range(4)]
    return tuple(cost)


class Tables:
    """Vectors that can occur, and their transitions by symbol and by block."""

    def __init__(self, block: int = BLOCK):
        self.block = block
        self.held: dict[tuple, tuple] = {}
        self.vectors = [_END]
        number = {_END: 0}
        step, taken = [], []
        for v in self.vectors:   # grows while it is walked
            to, off = [], []
            for s in range(SYMBOLS):
                cost = _before(v, s)
                low = min(cost)
                cost = tuple(c - low for c in cost)
                if cost not in number:
                    number[cost] = len(self.vectors)
                    self.vectors.append(cost)
                to.append(number[cost])
                off.append(low)
            step.append(to)
            taken.append(off)
        one, off = np.array(step, np.int32), np.array(taken, np.int32)
        self.one = one
        # to[v, code]: vector before the block; the block's first symbol is the code's highest digit
        self.to, self.off = one, off
        for _ in range(block - 1):
            # put one more symbol before every block
            self.off = np.stack([self.off + off[self.to, s] for s in range(SYMBOLS)], 1).reshape(len(one), -1)
            self.to = np.stack([one[self.to, s] for s in range(SYMBOLS)], 1).reshape(len(one), -1)

    def codes(self, symbols: np.ndarray) -> np.ndarray:
        """The symbols' blocks as numbers; the last one is filled with nothing."""
        n = -(-len(symbols) // self.block) * self.block
        full = np.full(n, NOTHING, np.int64)
        full[:len(symbols)] = symbols
        return full.reshape(-1, self.block) @ (SYMBOLS ** np.arange(self.block - 1, -1, -1))

    def back(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For every vector behind the symbols: the vector before them and the cost
        taken off."""
        v, cost = np.arange(len(self.vectors)), np.zeros(len(self.vectors), np.int64)
        for code in self.codes(symbols)[::-1].tolist():
            cost += self.off[v, code]
            v = self.to[v, code]
        return v, cost

    def expanded(self, behind: int, code: int, state: int) -> tuple[str, tuple, tuple, int]:
        """Edits of a block entered in ``state``: their initials, the row in the block
        of each (-1: inserted), the new role's initial of each (kept or deleted: empty)
        and the state behind.  Some are held for the next time."""
        key = (behind, code, state)
        if key not in self.held:
            if len(self.held) >= HELD:
                self.held.clear()
            self.held[key] = self._expand(*key)
        return self.held[key]

    def _expand(self, behind: int, code: int, state: int) -> tuple[str, tuple, tuple, int]:
        symbols = [code // SYMBOLS ** i % SYMBOLS for i in range(self.block - 1, -1, -1)]
        # costs at each place of the block, from behind; kept comparable by adding up
        costs = [self.vectors[behind]]
        for s in symbols[::-1]:
            costs.append(_before(costs[-1], s))
        costs.reverse()
        edits, rows, roles = "", [], []
        for i, s in enumerate(symbols):
            if s == NOTHING:
                continue
            extra = TRUNCATED if 4 <= s < GONE else 0
            while True:
                here, behind_row = costs[i][state], costs[i + 1]
                to = _keeps(state, s)
                if here == behind_row[state] + DELETE:
                    edit, row, role, after = "D", i, "", state
                elif here == costs[i][_NEXT[state]] + INSERT:
                    edit, row, role, after = "I", -1, _FITS[state], _NEXT[state]
                elif to is not None and here == behind_row[to] + extra:
                    edit, row, role, after = "K", i, "", to
                else:
                    edit, row, role, after = "R", i, _FITS[state], _NEXT[state]
                edits, state = edits + edit, after
                rows.append(row)
                roles.append(role)
                if edit != "I":
                    break
        return edits, tuple(rows), tuple(roles), state

    def walk(self, symbols: np.ndarray, behind: int, state: int):
        """All edits of a run whose end has the vector ``behind``."""
        codes = self.codes(symbols).tolist()
        at = [behind]
        for code in codes[::-1]:
            at.append(int(self.to[at[-1], code]))
        at.reverse()
        edits, rows, roles = [], [], []
        for i, code in enumerate(codes):
            e, r, o, state = self.expanded(at[i + 1], code, state)
            edits.append(e)
            rows += [x + i * self.block if x >= 0 else -1 for x in r]
            roles += o
        return "".join(edits), rows, roles, state

    @staticmethod
    def close(state: int) -> str:
        """The initials of the roles inserted at a conversation's end."""
        return {0: "", 1: "ua", 2: "a", 3: ""}[state]


def entries(maps: DataFrame, start: int, fan: int = FAN, from_end: bool = False) -> DataFrame:
    """What each of a conversation's runs starts from.

    ``maps(conv, run, map array<int>)``: of each run, what it makes of every value;
    runs follow each other by ``run`` (0 or more, any gaps), ``from_end`` the other way
    round.  The first starts from ``start``, each other from what the one before makes.
    Returns ``conv, run, entry``.  Up to ``fan`` runs whose numbers share a quotient are composed into
    one, level by level, until a conversation is one map; then starts are handed
    down the same way, so that no task holds more than ``fan`` maps of a
    conversation."""

    order = [("run", "descending" if from_end else "ascending")]

    def compose(table: pa.Table) -> pa.Table:
        t = table.sort_by(order)
        value = None
        for m in t.column("map").to_pylist():
            m = np.array(m)
            value = m if value is None else m[value]
        return pa.table({"conv": t.column("conv")[:1], "run": t.column("up")[:1],
                         "map": pa.array([value.tolist()], pa.list_(pa.int32()))})

    def hand_down(table: pa.Table) -> pa.Table:
        t = table.sort_by(order)
        value, out = t.column("entry")[0].as_py(), []
        for m in t.column("map").to_pylist():
            out.append(value)
            value = m[value]
        return pa.table({"conv": t.column("conv"), "run": t.column("run"), "entry": pa.array(out, pa.int32())})

    shape = "conv string, run long, map array<int>"
    levels = [maps.select("conv", "run", "map")]
    while not levels[-1].groupBy("conv").count().where("count > 1").isEmpty():
        up = levels[-1].withColumn("up", F.expr(f"run div {fan}"))
        levels.append(written(up.groupBy("conv", "up").applyInArrow(compose, shape), "maps"))
    found = levels[-1].select("conv", "run", F.lit(start).alias("entry"))
    for level in levels[-2::-1]:
        below = level.withColumn("up", F.expr(f"run div {fan}")).join(
            found.select("conv", F.col("run").alias("up"), "entry"), ["conv", "up"])
        found = written(below.groupBy("conv", "up").applyInArrow(hand_down, "conv string, run long, entry int"),
                        "entries")
    return found


def _blank(text: Column) -> Column:
    return ~text.rlike(r"[^\x20\x09-\x0D]")


def _truncated(text: Column) -> Column:
    return ~F.regexp_extract(text, r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*$", 1).isin(".", "!", "?")


def mark_faults(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn",
                role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``idx, conv, conv_id, turn, role, text, fault, initial`` in order.

    Rows of a conversation are ordered by turn (nulls first), role, text; ``idx``
    numbers all rows.  ``fault`` is the first of ``blank``, ``duplicate`` (role and
    text seen earlier in the conversation) and ``truncated`` that holds, else null.
    A null role or text is one space.  Rows with a null ``conv_id`` are one
    conversation.  Turns may repeat.  An empty table gives no rows.
    """
    def filled(c):
        return F.coalesce(F.col(c), F.lit(" "))

    conv = F.col(conv_col)
    r = rows.select(conv.alias("conv_id"),
                    F.coalesce(F.concat(F.lit("v"), conv.cast("string")), F.lit("n")).alias("conv"),
                    F.col(turn_col).alias("turn"), filled(role_col).alias("role"),
                    filled(text_col).alias("text"))
    r = dense_index(r, ["conv", F.col("turn").asc_nulls_first(), "role", "text"])
    # 256 bits of conversation, role and text stand for them
    same = F.unhex(F.sha2(F.concat_ws(":", "conv", F.length("role").cast("string"), "role", "text"), 256))
    r = r.withColumn("same", same)
    first = (r.groupBy("same").agg(F.min("idx").alias("first"), F.count(F.lit(1)).alias("n"))
             .where("n > 1").select("same", "first"))
    fault = (F.when(_blank(F.col("text")), "blank").when(F.col("first") < F.col("idx"), "duplicate")
             .when(_truncated(F.col("text")), "truncated"))
    return (r.join(first, "same", "left")
            .select("idx", "conv", "conv_id", "turn", "role", "text", fault.alias("fault"),
                    F.substring("role", 1, 1).alias("initial")))


def _runs(marked: DataFrame, run: int) -> DataFrame:
    """``conv, run, first, symbols, illegal, head, tail``: a row for the rows of one
    conversation whose numbers share a quotient (at most ``run`` of them)."""
    initial = F.expr("case initial when 's' then 0 when 'u' then 1 when 'a' then 2 else 3 end")
    symbol = (F.when(F.col("fault").isin("blank", "duplicate"), GONE)
              .when(F.col("fault") == "truncated", initial + 4).otherwise(initial))
    narrow = marked.select("conv", F.expr(f"idx div {run}").alias("run"), "idx", symbol.alias("symbol"),
                           initial.alias("kind"))
    got = narrow.groupBy("conv", "run").agg(
        F.array_sort(F.collect_list(F.struct("idx", "symbol", "kind"))).alias("rows"))
    kinds = F.col("rows")["kind"]
    pairs = F.zip_with(F.slice(kinds, 1, F.size(kinds) - 1), F.slice(kinds, 2, F.size(kinds) - 1), _illegal)
    return got.select("conv", "run", F.col("rows")[0]["idx"].alias("first"), F.col("rows")["symbol"].alias("symbols"),
                      F.aggregate(pairs, F.lit(0), lambda n, bad: n + bad.cast("int")).alias("illegal"),
                      F.element_at(kinds, 1).alias("head"), F.element_at(kinds, -1).alias("tail"))


def _illegal(a: Column, b: Column) -> Column:
    """Whether neighbouring initials (numbered) are none of su, ua, au."""
    return ~(((a == 0) & (b == 1)) | ((a == 1) & (b == 2)) | ((a == 2) & (b == 1)))


def _mapped(runs: DataFrame, block: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = Tables(block)
        for batch in batches:
            maps = [t.back(np.array(s))[0].tolist() for s in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(maps, pa.list_(pa.int32()))],
                                             names=["conv", "run", "map"])

    return runs.select("conv", "run", "symbols").mapInArrow(run, "conv string, run long, map array<int>")


_WALKED = ("conv string, run long, cost long, edits array<struct<idx:long, edit:string, role:string>>")


def _exits(runs: DataFrame, block: int) -> DataFrame:
    """``conv, run, behind, symbols`` -> the state each state leads to."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = Tables(block)
        for batch in batches:
            maps = [[t.walk(np.array(s), v, q)[3] for q in range(4)]
                    for s, v in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(maps, pa.list_(pa.int32()))],
                                             names=["conv", "run", "map"])

    return runs.select("conv", "run", "symbols", "behind").mapInArrow(run, "conv string, run long, map array<int>")


def _walked(runs: DataFrame, block: int) -> DataFrame:
    """``conv, run, symbols, behind, state, last, first`` -> cost and edits.  The
    cost of a run is what its blocks took off, and at a conversation's start the rest."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = Tables(block)
        for batch in batches:
            costs, all_edits = [], []
            for symbols, behind, state, last, opens, first in zip(
                    *(batch.column(i).to_pylist() for i in range(2, 8)), strict=True):
                symbols = np.array(symbols)
                v, cost = t.back(symbols)
                edits, rows, roles, state = t.walk(symbols, behind, state)
                cost = int(cost[behind]) + (t.vectors[v[behind]][0] if opens else 0)
                close = t.close(state) if last else ""
                all_edits.append([{"idx": None if x < 0 else first + x, "edit": e, "role": _ROLE.get(r)}
                                  for e, x, r in zip(edits + "I" * len(close), [*rows, *[-1] * len(close)],
                                                     [*roles, *close], strict=True)])
                costs.append(cost)
            kind = pa.list_(pa.struct([("idx", pa.int64()), ("edit", pa.string()), ("role", pa.string())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(costs, pa.int64()), pa.array(all_edits, kind)],
                names=["conv", "run", "cost", "edits"])

    return (runs.select("conv", "run", "symbols", "behind", "state", "last", "opens", "first")
            .mapInArrow(run, _WALKED))


def repair(marked: DataFrame, run: int = RUN, block: int = BLOCK, fan: int = FAN) -> tuple[DataFrame, DataFrame]:
    """``(runs, edits)`` of rows from :func:`mark_faults`.

    ``edits``: ``conv, run, nth, idx, edit, role`` in order of ``run, nth``; ``edit`` is
    K, R, D or I, ``idx`` the row (null for inserted ones), ``role`` the role that R
    and I give.  ``runs``: ``conv, run, cost, illegal`` whose sums over a
    conversation are its cost and its neighbouring roles that do not fit."""
    runs = written(_runs(marked, run), "runs")
    # whether a conversation goes on before or behind a run: its runs have neighbouring numbers
    edge = runs.select("conv", (F.col("run") + 1).alias("run"), F.col("tail").alias("left"))
    runs = runs.join(edge, ["conv", "run"], "left")
    edge = runs.select("conv", (F.col("run") - 1).alias("run"), F.lit(True).alias("more"))
    runs = runs.join(edge, ["conv", "run"], "left")
    runs = written(runs.select(
        "conv", "run", "first", "symbols", F.col("left").isNull().alias("opens"), F.col("more").isNull().alias("last"),
        (F.col("illegal") + F.when(F.col("left").isNull(), 0)
         .otherwise(_illegal(F.col("left"), F.col("head")).cast("int"))).alias("illegal")),
        "runs")
    alone = F.col("opens") & F.col("last")
    long = runs.where(~alone)
    states = runs.where(alone).withColumn("behind", F.lit(0)).withColumn("state", F.lit(0))
    if not long.isEmpty():
        # costs come from the end
        behind = (entries(written(_mapped(long, block), "maps"), 0, fan, from_end=True)
                  .withColumnRenamed("entry", "behind"))
        long = written(long.join(behind, ["conv", "run"]), "runs")
        state = entries(written(_exits(long, block), "maps"), 0, fan).select("conv", "run", F.col("entry").alias("state"))
        states = states.unionByName(long.join(state, ["conv", "run"]))
    walked = written(_walked(states, block), "edits")
    edits = walked.select("conv", "run", F.posexplode("edits").alias("nth", "e")).select("conv", "run", "nth", "e.*")
    return walked.select("conv", "run", "cost").join(runs.select("conv", "run", "illegal"), ["conv", "run"]), edits


def repaired_rows(marked: DataFrame, edits: DataFrame) -> DataFrame:
    """``conv, run, nth, edit, role, text``: an edit each, with the role and text of
    the row that stays (null for deleted rows)."""
    have = marked.select("idx", F.col("role").alias("old"), F.col("text").alias("old_text"))
    # inserted rows have no row to meet, so the join never sees their null key
    met = edits.where("idx is not null").join(have, "idx")
    gone = F.col("edit") == "D"
    met = met.select("conv", "run", "nth", "edit", F.when(~gone, F.coalesce("role", "old")).alias("role"),
                     F.when(~gone, F.col("old_text")).alias("text"))
    new = edits.where("idx is null").select("conv", "run", "nth", "edit", "role", F.lit("").alias("text"))
    return met.unionByName(new)


def audits(rows: DataFrame) -> DataFrame:
    """``conv, audit, repaired_sha256`` from :func:`repaired_rows`.

    A hash over a whole conversation is one pass in order: rows stream through a task
    sorted, which holds the running hash and the audit that it returns, no texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, audit, sha, lines = None, [], None, 0

        def out():
            return pa.RecordBatch.from_arrays(
                [pa.array([conv]), pa.array(["".join(audit)]), pa.array([sha.hexdigest()])],
                names=["conv", "audit", "repaired_sha256"])

        for batch in batches:
            for c, e, r, t in zip(*(batch.column(batch.schema.get_field_index(n)).to_pylist()
                                    for n in ("conv", "edit", "role", "text")), strict=True):
                if c != conv:
                    if sha:
                        yield out()
                    conv, audit, sha, lines = c, [], hashlib.sha256(), 0
                audit.append(e)
                if r is not None:
                    sha.update((b"\n" if lines else b"") + f"{r}:{t}".encode())
                    lines += 1
        if sha:
            yield out()

    ordered = rows.repartition("conv").sortWithinPartitions("conv", "run", "nth")
    return ordered.mapInArrow(run, "conv string, audit string, repaired_sha256 string")


def damage(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` of rows damaged by ``crc32(conv_id:turn) % 20``: 0
    drops a row, 1 empties its text, 2 removes the text's ``[.!?]``, 3 repeats the row,
    4 sets the role user.  Nulls in the key, role and text are one space."""
    def filled(c):
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    r = conversations.select("conv_id", "turn", filled("role").alias("role"), filled("text").alias("text"),
                             (F.crc32(F.concat(filled("conv_id"), F.lit(":"), filled("turn")).cast("binary"))
                              % 20).alias("fate"))
    text = (F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.regexp_replace("text", "[.!?]", ""))
            .otherwise(F.col("text")))
    r = r.where("fate <> 0").select("conv_id", "turn", F.when(F.col("fate") == 4, "user").otherwise(F.col("role"))
                                    .alias("role"), text.alias("text"),
                                    F.explode(F.when(F.col("fate") == 3, F.array(F.lit(0), F.lit(1)))
                                              .otherwise(F.array(F.lit(0)))).alias("copy"))
    return r.drop("copy")


def audit_conversations(rows: DataFrame, originals: DataFrame, run: int = RUN, block: int = BLOCK,
                        fan: int = FAN) -> DataFrame:
    """One row for each ``conv_id`` of ``originals`` (a null one too): faults of
    ``rows``, the cheapest repair's cost, its edits and the hash of its result.

    A conversation without rows has zeros, an empty audit and the hash of the empty
    string."""
    marked = written(mark_faults(rows), "marked")
    runs, edits = repair(marked, run, block, fan)
    turns = marked.groupBy("conv", "turn").agg(*[
        F.count(F.when(F.col("fault") == f, 1)).alias(f) for f in ("blank", "duplicate", "truncated")])
    sums = turns.groupBy("conv").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).alias("gaps"),
        *[F.sum(f).alias(f) for f in ("blank", "duplicate", "truncated")])
    costs = runs.groupBy("conv").agg(F.sum("illegal").alias("illegal"), F.sum("cost").alias("cost"))
    texts = audits(repaired_rows(marked, edits))
    ids = originals.select("conv_id").distinct().withColumn(
        "conv", F.coalesce(F.concat(F.lit("v"), F.col("conv_id").cast("string")), F.lit("n")))
    out = ids.join(sums.join(costs, "conv").join(texts, "conv"), "conv", "left")
    empty = hashlib.sha256().hexdigest()
    return out.select("conv_id", *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in (
        "gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(empty)).alias("repaired_sha256"))
