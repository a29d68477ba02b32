"""Exact Jaccard self-join of documents on word shingles by T-occurrence search.

Two documents with Jaccard similarity >= t share at least ``T = ceil(t * n)``
shingles of either one, so partners are those found in at least T of a document's
inverted lists.  The join runs in steps that each keep every link:

1. Copies.  Texts with equal words are one text with a 128-bit key.
2. Required overlap.  Of each text the shingles with the smallest hashes (half of
   them) are sent to buckets of the hash range, packed as byte strings; a bucket
   counts for each text how many of its shingles another text has too.  A text
   below the overlap that any partner would leave there has no partner, and only
   the others go on.  Shingles that several texts of one task share are settled in
   the task, so the list of a frequent shingle has one entry a task.
3. Short lists.  By ascending list length, a text's lists but its T - 1 longest are
   its short ones (DivideSkip: the long ones are never merged); partners share a
   short list of both.
4. Search among leaders.  Each short list has one leader; the texts of a list query an
   index over blocks of leaders, and linked texts are merged into classes.
5. Search between classes.  Where a short list still holds several classes, the texts
   of the smaller class query an index over blocks of the larger one.

All links come from the T-occurrence search: a heap merges the query's short inverted
lists, counts that can still reach T are kept, long lists are probed by binary search.
Only links that join two classes are sent on.

So copies and near copies are never expanded into pairs, and no step sets a limit
on partners or candidates.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordpair.llm.components import components
from wordpair.llm.memory import trimmed, trimmed_group
from wordpair.llm.shingles import shingle_hashes
from wordpair.llm.store import columns_of, new_name, temporary, written

#: Postings a task collects before it sends them off.
CHUNK_POSTINGS = 2_000_000
#: Postings a bucket of the hash range holds on average, and how many buckets there
#: are at least (powers of two).
BUCKET_POSTINGS = 1_000_000
#: Ranges of text keys (a power of two): a bucket sends one packed row to each.
RANGE_BITS = 8
#: Texts a block of the final search indexes, and queries it answers in one task.
INDEX_TEXTS, QUERY_TEXTS = 2000, 4000
#: Weight of binary search against merging (DivideSkip).
MU = 0.0085
#: Marks a shingle that several texts of one task share.
SEVERAL = -1


def needed(n, percent: int):
    """Shingles that a partner must share with a set of ``n``: ceil(n * percent / 100)."""
    return -(-n * percent // 100)


def kept_overlap(n):
    """Shared shingles that the prefix of step 2 still has to show."""
    return np.maximum(1, n // 4)


def _text_key(text: bytes | None) -> bytes:
    import xxhash
    return xxhash.xxh3_128_digest(b" ".join((text or b"").lower().split()))


def _key_of(text_col: str):
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([_text_key(t.as_py()) for t in texts], pa.binary())

    # not evaluated again in filters
    return F.arrow_udf(run, "binary").asNondeterministic()(F.col(text_col).cast("binary"))


def _sketch(rows: DataFrame, words: int) -> DataFrame:
    """(doc_id, text) -> doc_id, key, n (shingles)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, sizes = [], []
            for t in batch.column(1):
                t = t.as_py()
                keys.append(_text_key(t))
                sizes.append(len(shingle_hashes(t, words)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64())],
                names=["doc_id", "key", "n"])

    return rows.mapInArrow(trimmed(run), "doc_id long, key binary, n long")


def _prefix_postings(rows: DataFrame, words: int, percent: int, bits: int) -> DataFrame:
    """(text) -> packed postings by bucket (``bucket, keys, texts, hashes``) and, in
    buckets below 0, ``key64, shared`` counts that are already known in the task."""
    schema = "bucket long, keys binary, texts binary, hashes binary, key64 long, shared long"

    def send(block: dict[bytes, np.ndarray]) -> Iterator[pa.RecordBatch]:
        keys = np.array([int.from_bytes(k[:8], "little", signed=True) for k in block], np.int64)
        h = np.concatenate(list(block.values()))
        text = np.repeat(np.arange(len(keys), dtype=np.uint32), [len(x) for x in block.values()])
        block.clear()
        order = np.argsort(h, kind="stable")
        h, text = h[order], text[order]
        del order
        first = np.concatenate([[True], h[1:] != h[:-1]])
        size = np.diff(np.append(np.flatnonzero(first), len(h)))
        several_row = np.repeat(size > 1, size)
        del size
        shared = np.bincount(text[several_row], minlength=len(keys))
        some = np.flatnonzero(shared)
        none = pa.nulls(len(some), pa.binary())
        yield pa.RecordBatch.from_arrays(
            [pa.array(-1 - (keys[some] & ((1 << bits) - 1))), none, none, none, pa.array(keys[some]),
             pa.array(shared[some].astype(np.int64))],
            names=["bucket", "keys", "texts", "hashes", "key64", "shared"])
        h, text = h[first], text[first]
        text[several_row[first]] = len(keys)
        del first, several_row
        keys = np.append(keys, SEVERAL)
        bucket = (h >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(h), np.int64)
        low = ((h >> np.uint64(32 - bits)) & np.uint64(0xFFFFFFFF)).astype("<u4")
        cut = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
        out: list[tuple] = []
        for a, b in zip(cut, np.append(cut[1:], len(h)), strict=True):
            mine, place = np.unique(text[a:b], return_inverse=True)
            out.append((int(bucket[a]), keys[mine].astype("<i8").tobytes(),
                        place.astype("<u4" if len(mine) > 65535 else "<u2").tobytes(),
                        low[a:b].tobytes()))
        yield pa.RecordBatch.from_arrays(
            [pa.array([o[0] for o in out], pa.int64()), *(pa.array([o[i] for o in out], pa.binary())
                                                         for i in (1, 2, 3)),
             pa.nulls(len(out), pa.int64()), pa.nulls(len(out), pa.int64())],
            names=["bucket", "keys", "texts", "hashes", "key64", "shared"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: dict[bytes, np.ndarray] = {}   # by the whole key: half of one may be another text's
        held = 0
        for batch in batches:
            for t in batch.column(0):
                t = t.as_py()
                key = _text_key(t)
                if key in block:
                    continue
                h = shingle_hashes(t, words)
                if not len(h):
                    continue
                n = len(h)
                block[key] = h[:n - needed(n, percent) + int(kept_overlap(n))]
                held += len(block[key])
                if held >= CHUNK_POSTINGS:
                    yield from send(block)
                    block, held = {}, 0
        if block:
            yield from send(block)

    return rows.mapInArrow(trimmed(run), schema)


def _shared_of(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """One bucket's postings -> texts and how many shingles another text has too."""
    if table.column("bucket")[0].as_py() < 0:
        return _added(table.column("key64").to_numpy(), table.column("shared").to_numpy())
    # a posting is one number: its hash above its text's number, so that plain numbers are sorted in place
    texts = np.unique(np.concatenate([np.frombuffer(k.as_buffer(), "<i8") for k in table.column("keys")]))
    found = np.empty(sum(h.as_buffer().size // 4 for h in table.column("hashes")), np.uint64)
    at = 0
    for k, t, h in zip(*(table.column(c) for c in ("keys", "texts", "hashes")), strict=True):
        number = np.searchsorted(texts, np.frombuffer(k.as_buffer(), "<i8")).astype(np.uint64)
        h, t = np.frombuffer(h.as_buffer(), "<u4"), t.as_buffer()
        mine = found[at:at + len(h)]
        mine[:] = h
        mine <<= np.uint64(32)
        mine |= number[np.frombuffer(t, "<u4" if t.size == 4 * len(h) else "<u2")]
        at += len(h)
    found.sort()
    # copies of a text in other tasks must not count a shingle twice
    found = found[np.concatenate([[True], found[1:] != found[:-1]])]
    h = (found >> np.uint64(32)).astype(np.uint32)
    number = found.astype(np.uint32)   # the low half
    del found
    # another text has the shingle too: the posting before or after has its hash
    equal = h[1:] == h[:-1]
    several = np.concatenate([[False], equal]) | np.concatenate([equal, [False]])
    counts = np.bincount(number[several], minlength=len(texts))
    counts[texts == SEVERAL] = 0
    some = np.flatnonzero(counts)
    return texts[some], counts[some]


def _added(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys (ascending) and their sums."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else order
    return keys[first], np.add.reduceat(counts, first) if len(keys) else counts


def _count_shared(range_bits: int):
    """One bucket's postings -> counts packed by range of the text keys
    (``range, keys, counts``), so a bucket sends at most 2**range_bits rows."""

    @trimmed_group
    def count(table: pa.Table) -> pa.Table:
        keys, counts = _shared_of(table)
        range_ = keys >> np.int64(64 - range_bits)
        cut = np.flatnonzero(np.concatenate([[True], range_[1:] != range_[:-1]])) if len(keys) else []
        ends = np.append(cut[1:], len(keys)) if len(keys) else []
        parts = list(zip(cut, ends, strict=True))
        return pa.table({"range": pa.array([int(range_[a]) for a, _ in parts], pa.int64()),
                         "keys": pa.array([keys[a:b].astype("<i8").tobytes() for a, b in parts], pa.binary()),
                         "counts": pa.array([counts[a:b].astype("<i4").tobytes() for a, b in parts], pa.binary())})

    return count


@trimmed_group
def _add_shared(table: pa.Table) -> pa.Table:
    """The packed counts of one range of text keys -> ``key64, shared``."""
    keys = np.concatenate([np.frombuffer(x.as_buffer(), "<i8") for x in table.column("keys")])
    counts = np.concatenate([np.frombuffer(x.as_buffer(), "<i4") for x in table.column("counts")])
    keys, counts = _added(keys, counts.astype(np.int64))
    return pa.table({"key64": pa.array(keys, pa.int64()), "shared": pa.array(counts, pa.int64())})


def _sets(rows: DataFrame, words: int) -> DataFrame:
    """(rep, key, text) -> rep, key, n, hashes (signed 64-bit), for texts that are
    the key's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rep, key, n, sets = [], [], [], []
            for r, k, t in zip(*batch.columns, strict=True):
                t, k = t.as_py(), k.as_py()
                if _text_key(t) == k:
                    h = np.sort(shingle_hashes(t, words).view(np.int64))
                    rep.append(r.as_py())
                    key.append(k)
                    n.append(len(h))
                    sets.append(h)
            yield pa.RecordBatch.from_arrays(
                [pa.array(rep, pa.int64()), pa.array(key, pa.binary()), pa.array(n, pa.int64()),
                 pa.array(sets, pa.list_(pa.int64()))], names=["rep", "key", "n", "hashes"])

    return rows.mapInArrow(trimmed(run), "rep long, key binary, n long, hashes array<long>")


def merged(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of ascending lists, each once and ascending, and in how many lists
    each is: a heap holds the next number of every list."""
    numbers: list[int] = []
    counts: list[int] = []
    last = None
    for x in heapq.merge(*lists):
        if x == last:
            counts[-1] += 1
        else:
            numbers.append(x)
            counts.append(1)
            last = x
    return np.array(numbers, np.int64), np.array(counts, np.int64)


class Inverted:
    """Inverted lists over a block of sorted sets."""

    def __init__(self, sets: list[np.ndarray], percent: int):
        self.sets, self.percent = sets, percent
        self.sizes = np.array([len(s) for s in sets])
        h = np.concatenate(sets)
        text = np.repeat(np.arange(len(sets)), self.sizes)
        order = np.argsort(h, kind="stable")
        h, self.text = h[order], text[order]
        first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        self.shingle, self.start = h[first], np.append(first, len(h))

    def search(self, query: np.ndarray) -> list[int]:
        """Indexed sets whose Jaccard similarity with ``query`` reaches the threshold."""
        n = len(query)
        at = np.searchsorted(self.shingle, query)
        at = at[(at < len(self.shingle)) & (self.shingle[np.minimum(at, len(self.shingle) - 1)] == query)]
        t = needed(n, self.percent)
        if len(at) < t:
            return []
        length = self.start[at + 1] - self.start[at]
        at = at[np.argsort(length, kind="stable")]
        length = np.sort(length)
        # DivideSkip: set aside so many of the longest lists that probing pays
        skip = min(t - 1, int(t / (MU * math.log2(int(length[-1]) + 1) + 1)))
        short, long_ = at[:len(at) - skip], at[len(at) - skip:]
        text, count = merged([self.text[a:b].tolist() for a, b in
                              zip(self.start[short].tolist(), self.start[short + 1].tolist(), strict=True)])
        fits = (count >= t - skip) & (self.sizes[text] * 100 >= n * self.percent) & \
            (n * 100 >= self.sizes[text] * self.percent)
        probes = np.sort(self.shingle[long_])
        found = []
        for x, c in zip(text[fits].tolist(), count[fits].tolist(), strict=True):
            s = self.sets[x]
            p = np.minimum(np.searchsorted(s, probes), len(s) - 1)
            both = c + int((s[p] == probes).sum())
            if 100 * both >= self.percent * (n + len(s) - both):
                found.append(x)
        return found


def _search_block(percent: int):
    @trimmed_group
    def search(table: pa.Table) -> pa.Table:
        k, label, query = (table.column(c).to_pylist() for c in ("k", "label", "query"))
        sets = [np.array(x.values.to_numpy(), np.int64) for x in table.column("hashes")]
        here = [i for i, q in enumerate(query) if not q]
        edges: list[tuple[int, int]] = []
        if here and len(here) < len(k):
            index = Inverted([sets[i] for i in here], percent)
            up: dict[int, int] = {}

            def root(x: int) -> int:
                while up.get(x, x) != x:
                    up[x] = up.get(up[x], up[x])
                    x = up[x]
                return x

            for i, q in enumerate(query):
                if q:
                    for j in index.search(sets[i]):
                        a, b = root(label[i]), root(label[here[j]])
                        if a != b:
                            up[a] = b
                            edges.append((k[i], k[here[j]]))
        return pa.table({"a": pa.array([e[0] for e in edges], pa.int64()),
                         "b": pa.array([e[1] for e in edges], pa.int64())})
    return search


def _links(sets: DataFrame, percent: int) -> DataFrame:
    """Edges ``a, b`` between texts ``sets(k, n, hashes)`` whose components are those
    of all links (steps 3 to 5)."""
    t = F.ceil(F.col("n") * percent / 100)
    postings = sets.select("k", "n", F.explode("hashes").alias("h"))
    lengths = postings.groupBy("h").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    lists = (postings.join(lengths, "h").groupBy("k", "n")
             .agg(F.array_sort(F.collect_list(F.struct("df", "h"))).alias("lists")))
    short = (lists.where(F.size("lists") >= t)
             .select("k", "n", F.explode(F.slice("lists", F.lit(1), (F.size("lists") - t + 1).cast("int"))).alias("l"))
             .select("k", "n", F.col("l.h").alias("h")))
    short = written(short, "short-lists")

    leaders = (short.groupBy("h").agg(F.min(F.struct(F.xxhash64("k").alias("x"), "k", "n")).alias("l"),
                                      F.count(F.lit(1)).alias("m"))
               .where("m > 1").select("h", F.col("l.k").alias("lead"), F.col("l.n").alias("lead_n")))
    fits = (F.col("n") * 100 >= F.col("lead_n") * percent) & (F.col("lead_n") * 100 >= F.col("n") * percent)
    pairs = written(short.join(leaders, "h").where(fits & (F.col("k") != F.col("lead"))).select("k", "lead").distinct(),
                    "leader-pairs")
    leads = pairs.select(F.col("lead").alias("k")).distinct()
    blocks = max(1, -(-leads.count() // INDEX_TEXTS))

    def place(c):
        return F.pmod(F.xxhash64(c), F.lit(blocks)).alias("block")

    near = written(_searched(pairs.select("k", F.col("k").alias("label"), place("lead")).distinct(),
                             leads.select("k", F.col("k").alias("label"), place("k")), sets, percent), "leader-links")

    roots = components(near)
    labelled = (sets.select("k").join(roots.withColumnRenamed("node", "k"), "k", "left")
                .select("k", F.coalesce("root", "k").alias("label")))
    sizes = labelled.groupBy("label").agg(F.count(F.lit(1)).alias("members"))
    labelled = written(labelled.join(sizes, "label"), "classes")
    mixed = short.select("h", "k").join(labelled, "k")
    several = (mixed.groupBy("h").agg(F.min("label").alias("x"), F.max("label").alias("y"))
               .where("x <> y").select("h"))
    mixed = written(mixed.join(several, "h"), "mixed-lists")
    # Classes that share lists mostly share their smallest one too, so they are indexed
    # together; of those with the same smallest list a block holds about INDEX_TEXTS texts.
    place = mixed.groupBy("label").agg(F.min("h").alias("place"))
    texts = mixed.select("k", "label").distinct().join(place, "label")
    crowd = texts.groupBy("place").agg(F.count(F.lit(1)).alias("n"))
    parts = F.ceil(F.col("n") / F.lit(float(INDEX_TEXTS))).cast("long")
    texts = written(texts.join(crowd, "place").withColumn("part", F.pmod(F.xxhash64("k"), parts))
                    .select("k", "place", "part"), "places")
    blocks = max(1, -(-texts.count() // INDEX_TEXTS))
    block = F.pmod(F.xxhash64("place", "part"), F.lit(blocks))
    mixed = mixed.join(texts, "k").select("h", "k", "label", block.alias("block"),
                                          F.struct("members", "label").alias("rank"))
    # a text asks the blocks where a list of its has a text of a larger class
    hosts = mixed.groupBy("h", "block").agg(F.max("rank").alias("top")).alias("i")
    q = mixed.alias("q")
    asks = (q.join(hosts, (F.col("q.h") == F.col("i.h")) & (F.col("i.top") > F.col("q.rank")))
            .select(F.col("q.k").alias("k"), F.col("q.label").alias("label"),
                    F.col("i.block").alias("block")).distinct())
    index = mixed.select("k", "label", "block").distinct()
    return near.unionByName(written(_searched(asks, index, sets, percent), "search-links"))


def _searched(asks: DataFrame, index: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links ``a, b`` that join two labels, between texts ``asks(k, label, block)`` and those
    indexed in the same block, ``index(k, label, block)``.  A block's queries are split
    into turns of about QUERY_TEXTS, each with the block's index."""
    asks = written(asks, "queries")
    turns = asks.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / F.lit(float(QUERY_TEXTS))).alias("turns"))
    turns = written(turns, "turns")
    index = (index.join(turns, "block")
             .withColumn("turn", F.explode(F.sequence(F.lit(0).cast("long"), F.col("turns") - 1))))
    rows = (asks.join(turns, "block").withColumn("turn", F.pmod(F.xxhash64("k"), F.col("turns")))
            .select("block", "turn", "k", "label", F.lit(True).alias("query"))
            .unionByName(index.select("block", "turn", "k", "label", F.lit(False).alias("query"))))
    return (rows.join(sets.select("k", "hashes"), "k").groupBy("block", "turn")
            .applyInArrow(_search_block(percent), "a long, b long"))


def _classes(docs: DataFrame, id_col: str, text_col: str, words: int = 5, percent: int = 75) -> DataFrame:
    """``shingle_classes`` with the text's ``key`` and the ``root`` of its class (null
    where no other text is linked)."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       F.col(text_col).cast("binary").alias("text"))
    sketch = written(_sketch(rows, words), "sketch")
    texts = (sketch.where("n > 0").groupBy("key").agg(F.min("doc_id").alias("rep"), F.max("n").alias("n")))
    texts = written(texts.select("key", "rep", "n", _key64("key").alias("key64")), "texts")

    total = texts.agg(F.sum("n")).first()[0] or 0
    bits = max(0, math.ceil(math.log2(max(1, total / 2 / BUCKET_POSTINGS))))
    sent = _prefix_postings(rows.select("text"), words, percent, bits)
    # far more buckets than ranges would make the ranges too large for a task
    packed = _count_shared(max(RANGE_BITS, bits - 4))
    counted = sent.groupBy("bucket").applyInArrow(packed, "range long, keys binary, counts binary")
    shared = counted.groupBy("range").applyInArrow(_add_shared, "key64 long, shared long")
    least = F.greatest(F.lit(1), F.floor(F.ceil(F.col("n") * percent / 100) / 4))
    live = texts.join(shared, "key64").where(F.col("shared") >= least).select("key", "rep")
    live = written(live, "live")

    # the same join at every size; near-duplicates grow with the input
    chosen = (rows.where("doc_id is not null").join(live.hint("merge"), F.col("doc_id") == F.col("rep"))
              .select("rep", "key", "text"))
    sets = _sets(chosen, words).dropDuplicates(["key"])
    # a text that only has null ids is found by its key
    unnamed = rows.where("doc_id is null").select(_key_of("text").alias("key"), "text").dropDuplicates(["key"])
    unnamed = unnamed.join(live.where("rep is null"), "key").select("rep", "key", "text")
    sets = sets.unionByName(_sets(unnamed, words))
    # numbered before the write: a number made in each scan would follow the scan's splits
    sets = written(sets.withColumn("k", F.monotonically_increasing_id()), "sets")
    with temporary(docs.sparkSession) as keep:
        roots = components(_links(sets, percent))
        keep.append(roots)
    linked = (sets.select("k", "key", "rep").join(roots.withColumnRenamed("node", "k"), "k")
              .select("key", "rep", "root"))
    least_id = linked.groupBy("root").agg(F.min("rep").alias("component"))
    by_key = linked.join(least_id, "root").select("key", "component", "root")
    found = texts.select("key", "rep").join(by_key, "key", "left") \
        .select("key", F.coalesce("component", "rep").alias("component_id"), "root")
    a = sketch.where("n > 0").join(found, "key") \
        .select("doc_id", "key", F.col("n").alias("n_shingles"), "component_id", "root")
    b = sketch.where("n = 0").select("doc_id", "key", F.col("n").alias("n_shingles"),
                                     F.col("doc_id").alias("component_id"), F.lit(None).cast("long").alias("root"))
    return a.unionByName(b)


def shingle_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    words: int = 5, percent: int = 75) -> DataFrame:
    """``doc_id, n_shingles, component_id``, one row a document.

    Words are runs of other than ASCII white space, A-Z in lower case; a text with
    fewer than ``words`` words is one shingle.  Texts link when their shingle sets'
    Jaccard similarity is at least ``percent`` %.  ``component_id`` is the smallest
    id reachable by links.  Null or empty texts have no shingles and link with
    nothing.  A row with a null id passes links on; its component is that of its
    text (null if no row of the component has an id).  Repeated rows are copies.
    Extra columns are ignored.
    """
    return _classes(docs, id_col, text_col, words, percent).drop("key", "root")


def _key64(key: str):
    """The first 8 bytes of a key, as a little-endian signed number."""
    turned = F.concat(*[F.substring(key, i, 1) for i in range(8, 0, -1)])
    high = F.conv(F.hex(F.substring(turned, 1, 4)), 16, 10).cast("long")
    low = F.conv(F.hex(F.substring(turned, 5, 4)), 16, 10).cast("long")
    return F.shiftleft(high, 32) + low


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one row of each class, that of the smallest id; its columns
    untouched.  A row goes only if its own text is a copy or near copy: rows that
    repeat an id with texts of several classes stay, one a class.  Rows with a null
    id stay."""
    classes = _classes(docs, id_col, text_col, **options).where("doc_id = component_id")
    near = F.coalesce(F.col("root").cast("string").cast("binary"), F.col("key"))
    keep = (classes.groupBy("doc_id", near, F.col("root").isNull()).agg(F.min("key").alias("key"))
            .select("doc_id", "key").alias("k"))
    own = new_name("__own", docs.columns)
    keyed = docs.withColumn(own, _key_of(text_col)).alias("d")
    own_id, own_key = F.col(f"d.`{id_col}`"), F.col(f"d.`{own}`")
    named = keyed.join(keep, (own_id == F.col("k.doc_id")) & (own_key == F.col("k.key")))
    named = named.select("d.*").dropDuplicates([id_col, own]).select(*columns_of(docs))
    return named.unionByName(docs.where(F.col(f"`{id_col}`").isNull()))
