"""Mixing sources to target weights by entropy balancing.

A document of ``x`` words gets a rate ``r`` (expected copies).  Among all
rates in (0, cap] that give each source its target number of words, entropy
balancing takes those closest to 1 in Kullback-Leibler divergence.  The convex
dual has one multiplier a source, and the optimum is the exponentially tilted
rate ``r = min(cap, exp(lambda_source * x / mean_source))``.

* The rate depends on the source and ``x`` only, so the Newton iterations run
  over the (source, size) histogram: each is one join with the multipliers and
  one partial + final sum.  Steps that leave the bracket known to hold the root
  fall back to bisection.
* Sums are taken in fixed point (BIGINT), so they do not depend on the order
  of rows and reruns agree bit for bit.
* Copies are ``floor(r)`` plus one for the documents that come first when those
  of a source are ordered by ``hash / fraction`` (sequential Poisson sampling)
  until the words still missing are reached.  The cut is found digit by digit
  from sums per bucket, at most 4,096 a source and level: no source is sorted
  or gathered in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wordpair.llm.store import written

WORD = r"[^\x20\x09-\x0D]+"
#: Fixed-point units a word, for sums that do not depend on row order.
UNIT = 1 << 12
#: A source's words under its rates may differ from the target by this share.
TOLERANCE = 1e-7
MAX_STEPS = 80
DIGIT_BITS, LEVELS = 12, 5
U_BITS, TIE_BITS = 40, 20


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_weights(sizes: DataFrame, weights=(5, 2, 1)) -> DataFrame:
    """``sources(source, source_size)`` -> the same with ``weight``: ``weights``
    in turn, sources by code point, null last.

    Ranks come from a range sort and the row counts of its partitions (one row
    a partition), so no task holds all sources."""
    order = [F.col("source").isNull(), F.col("source")]
    ranged = written(sizes.orderBy(*order).withColumn("pid", F.spark_partition_id())
                     .withColumn("mid", F.monotonically_increasing_id()), "ranked")
    counts = ranged.groupBy("pid").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("pid", (F.sum("n").over(Window.orderBy("pid")) - F.col("n")).alias("before"))
    rank = F.col("before") + F.col("mid").bitwiseAND(F.lit((1 << 33) - 1))
    return (ranged.join(before, "pid")
            .withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]),
                                               (rank % len(weights) + 1).cast("int")))
            .select("source", "source_size", "weight"))


def share_targets(sources: DataFrame, max_repeat: float = 3.0) -> DataFrame:
    """Add ``target``: all words shared by weight, no target above ``max_repeat``
    times its source's size, what is above reshared among the others by weight.

    Each round is one aggregate over the sources; a round freezes every source
    above its limit, so there are few rounds."""
    cap = F.col("source_size") * F.lit(float(max_repeat))
    state = sources.withColumn("target", F.lit(None).cast("double"))
    total = None
    while True:
        open_ = F.col("target").isNull()
        row = state.agg(F.sum("source_size").alias("total"),
                        F.sum(F.when(~open_, F.col("target"))).alias("taken"),
                        F.sum(F.when(open_, F.col("weight"))).alias("weight")).first()
        total = float(row["total"] or 0)
        left = max(total - float(row["taken"] or 0.0), 0.0)
        if not row["weight"]:
            return state
        share = F.lit(left) * F.col("weight") / F.lit(float(row["weight"]))
        above = state.where(open_ & (share > cap)).limit(1).count()
        if not above:
            return state.withColumn("target", F.coalesce("target", share))
        state = written(state.withColumn("target", F.when(open_ & (share > cap), cap)
                                         .otherwise(F.col("target"))), "targets")


def rate(lam: Column, size: Column, mean: Column, max_repeat: float) -> Column:
    """exp(lambda * size / mean), at most ``max_repeat``; lambda null: the cap."""
    cap = F.lit(float(max_repeat))
    e = lam * size / F.greatest(mean, F.lit(1e-9))
    return F.when(lam.isNull(), cap).otherwise(
        F.least(cap, F.exp(F.least(e, F.lit(50.0)))))


def tilt(hist: DataFrame, sources: DataFrame, max_repeat: float = 3.0) -> DataFrame:
    """``hist(source, size, n)`` and ``sources(source, source_size, target)`` ->
    sources with ``lam`` (null: every rate is the cap) and ``mean``, by Newton's
    method on the dual."""
    n_docs = hist.groupBy("source").agg(F.sum("n").alias("docs"))
    state = (sources.join(n_docs, sources["source"].eqNullSafe(n_docs["source"]))
             .select(sources["source"], "source_size", "target",
                     (F.col("source_size") / F.col("docs")).alias("mean")))
    full = F.col("target") >= F.col("source_size") * F.lit(max_repeat * (1 - 1e-12))
    state = state.select(
        "*", F.lit(0.0).alias("lam"), F.lit(None).cast("double").alias("lo"),
        F.lit(None).cast("double").alias("hi"),
        (full | (F.col("source_size") == 0)).alias("done"))
    state = written(state.withColumn("lam", F.when(full, None).otherwise(F.col("lam"))), "duals")
    cap = float(max_repeat)
    for _ in range(MAX_STEPS):
        if state.where(~F.col("done")).isEmpty():
            break
        live = state.where(~F.col("done")).alias("s")
        h = hist.where("size > 0").alias("h")
        r = rate(F.col("s.lam"), F.col("h.size"), F.col("s.mean"), cap)
        words = F.col("h.n") * F.col("h.size")
        slope = F.when(r < cap, words * r * F.col("h.size") / F.col("s.mean")).otherwise(0.0)
        sums = (h.join(live, F.col("h.source").eqNullSafe(F.col("s.source")))
                .groupBy(F.col("s.source").alias("source"))
                .agg(F.sum(F.round(words * r * UNIT).cast("long")).alias("got"),
                     F.sum(F.round(slope).cast("decimal(38,0)")).alias("slope")).alias("g"))
        got = F.col("g.got") / F.lit(float(UNIT))
        gap = got - F.col("t.target")
        lo = F.when(gap < 0, F.col("t.lam")).otherwise(F.col("t.lo"))
        hi = F.when(gap > 0, F.col("t.lam")).otherwise(F.col("t.hi"))
        done = (F.abs(gap) <= F.greatest(F.col("t.target") * TOLERANCE, F.lit(0.5))) | \
            F.coalesce(hi - lo < 1e-13, F.lit(False))
        step = F.when(F.col("g.slope") > 0,
                      F.col("t.lam") - gap / F.greatest(F.col("g.slope").cast("double"), F.lit(1e-9)))
        # without a bracket a step is at most 4, so that the flat end beyond the cap is not skipped to
        step = F.least(F.greatest(step, F.col("t.lam") - 4.0), F.col("t.lam") + 4.0)
        inside = step.isNotNull() & F.coalesce(step > lo, F.lit(True)) & F.coalesce(step < hi, F.lit(True))
        other = (F.when(lo.isNull(), hi - 4.0).when(hi.isNull(), lo + 4.0).otherwise((lo + hi) / 2))
        t = state.alias("t")
        moved = t.join(sums, F.col("t.source").eqNullSafe(F.col("g.source")), "left")
        keep = F.col("t.done") | F.col("g.got").isNull()
        state = written(moved.select(
            F.col("t.source").alias("source"), "t.source_size", "t.target", "t.mean",
            F.when(keep | done, F.col("t.lam")).when(inside, step).otherwise(other).alias("lam"),
            F.when(keep, F.col("t.lo")).otherwise(lo).alias("lo"),
            F.when(keep, F.col("t.hi")).otherwise(hi).alias("hi"),
            (keep | done).alias("done")), "duals")
    return state.select("source", "source_size", "target", "mean", "lam")


def _cut(rated: DataFrame, sources: DataFrame) -> DataFrame:
    """Per source the key below which documents get one copy more, and the one
    document beyond it (by its place) that comes closest to the words then
    still missing: ``source, cut, extra``."""
    base = rated.groupBy("source").agg(F.sum(F.col("size") * F.col("whole")).alias("sure"))
    state = (sources.join(base, sources["source"].eqNullSafe(base["source"]))
             .select(sources["source"], (F.col("target") - F.col("sure")).alias("left"),
                     F.lit(0).cast("long").alias("prefix")))
    state = written(state, "cut")
    for level in range(LEVELS):
        shift = DIGIT_BITS * (LEVELS - 1 - level)
        c, s = rated.where("size > 0 and frac > 0").alias("c"), state.alias("s")
        digit = F.shiftright(F.col("c.key"), shift)
        inside = F.shiftright(digit, DIGIT_BITS) == F.col("s.prefix")
        buckets = (c.join(s, F.col("c.source").eqNullSafe(F.col("s.source")) & inside)
                   .groupBy(F.col("c.source").alias("source"), digit.alias("digit"))
                   .agg(F.sum("c.size").alias("words")))
        # at most 2**DIGIT_BITS rows a source
        up_to = F.sum("words").over(Window.partitionBy("source").orderBy("digit"))
        buckets = buckets.withColumn("up_to", up_to).alias("b")
        over = (buckets.join(s, F.col("b.source").eqNullSafe(F.col("s.source")))
                .groupBy(F.col("s.source").alias("source"))
                .agg(F.min(F.when(F.col("up_to") > F.col("left"), F.col("digit"))).alias("at"),
                     F.max(F.when(F.col("up_to") <= F.col("left"), F.col("up_to"))).alias("below"),
                     F.max("digit").alias("last"))
                .alias("o"))
        nxt = s.join(over, F.col("s.source").eqNullSafe(F.col("o.source")), "left")
        left = F.col("s.left") - F.coalesce(F.col("o.below"), F.lit(0))
        here = F.coalesce("o.at", F.col("o.last") + 1, F.shiftleft(F.col("s.prefix"), DIGIT_BITS))
        state = written(nxt.select(F.col("s.source").alias("source"), left.alias("left"),
                                   here.cast("long").alias("prefix")), "cut")
    c, s = rated.where("size > 0 and frac > 0").alias("c"), state.alias("s")
    miss = F.abs(F.col("s.left") - F.col("c.size"))
    extra = (c.join(s, F.col("c.source").eqNullSafe(F.col("s.source")) &
                    (F.col("c.key") >= F.col("s.prefix")) & (miss < F.abs(F.col("s.left"))))
             .groupBy(F.col("s.source").alias("source"))
             .agg(F.min(F.struct(miss.alias("miss"), "c.key", "c.place")).alias("best")).alias("e"))
    return written(s.join(extra, F.col("s.source").eqNullSafe(F.col("e.source")), "left")
                   .select(F.col("s.source").alias("source"), F.col("prefix").alias("cut"),
                           F.col("e.best.place").alias("extra")), "cut")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        source_col: str = "source", weights=(5, 2, 1), max_repeat: int = 3,
        seed: int = 0, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: ``doc_id, size, source_size, target, taken,
    copies, rate, source`` and the columns named in ``carry``.

    Sizes are words; a null text has none.  Sources by code point, null last
    (null is a source of its own, distinct from ''), weigh ``weights`` in turn.
    Rows without words get one copy and take nothing.  Rows that repeat an id
    are documents of their own (told apart by their place in the input).  An
    empty table gives an empty result.
    """
    picked = docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"),
        word_count(F.col(text_col)).alias("size"),
        F.monotonically_increasing_id().alias("place"),
        *[F.col(c).alias(f"carry_{k}") for k, c in enumerate(carry)])
    sized = written(picked, "sizes")
    hist = written(sized.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "sizes")
    per_source = hist.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"))
    sources = written(share_targets(source_weights(per_source, weights), max_repeat), "targets")
    duals = written(tilt(hist, sources, max_repeat), "duals")

    r = rate(F.col("lam"), F.col("size"), F.col("mean"), max_repeat)
    mask = (1 << U_BITS) - 1
    u = (F.xxhash64("doc_id", F.lit(seed)).bitwiseAND(F.lit(mask)) + 0.5) / F.lit(float(1 << U_BITS))
    v = u / F.col("frac")
    first = F.least(F.floor(v / (v + 1) * F.lit(float(1 << U_BITS))).cast("long"), F.lit(mask))
    tie = F.xxhash64("place", F.lit(seed)).bitwiseAND(F.lit((1 << TIE_BITS) - 1))

    def rated(rows: DataFrame) -> DataFrame:
        d, s = rows.alias("d"), duals.alias("s")
        return (d.join(s, F.col("d.source").eqNullSafe(F.col("s.source")))
                .select("d.*", "source_size", "target", r.alias("rate"))
                .withColumn("whole", F.least(F.floor("rate"), F.lit(max_repeat)).cast("long"))
                .withColumn("frac", F.col("rate") - F.col("whole"))
                .withColumn("key", F.when(F.col("frac") > 0, F.shiftleft(first, TIE_BITS) + tie)))

    narrow = written(rated(sized.select("doc_id", "source", "size", "place"))
                     .select("source", "size", "place", "whole", "frac", "key"), "rated")
    cut = _cut(narrow, sources).alias("k")
    d = rated(sized).alias("d")
    copies = F.col("whole") + F.when((F.col("frac") > 0) & (F.col("size") > 0) &
                                     ((F.col("key") < F.col("cut")) |
                                      F.coalesce(F.col("place") == F.col("extra"), F.lit(False))),
                                     1).otherwise(0)
    return (d.join(cut, F.col("d.source").eqNullSafe(F.col("k.source")))
            .select("doc_id", "size", "source_size", "target",
                    (copies * F.col("size")).alias("taken"), copies.cast("int").alias("copies"),
                    "rate", F.col("d.source").alias("source"),
                    *[F.col(f"carry_{k}").alias(c) for k, c in enumerate(carry)]))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with each row repeated as often as the mix takes it (some not
    at all); all its columns, whatever their names."""
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    named = {k: options.pop(k, v) for k, v in
             (("id_col", "doc_id"), ("text_col", "text"), ("source_col", "source"))}
    flat = whole.select(*[F.col(f"row.`{v}`").alias(k) for k, v in named.items()], "row")
    out = mix(flat, "id_col", "text_col", "source_col", carry=("row",), **options)
    return (out.where("copies > 0")
            .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
            .select("row.*"))
