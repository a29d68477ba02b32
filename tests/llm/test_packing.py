import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from wordpair.llm import packing as pk

PATH = public_tokenizers.path("word_bpe_49k.json")


def naive(lengths, capacity):
    left = []
    for n in sorted(lengths, reverse=True):
        fits = [x for x in left if x >= n]
        if fits:
            left.remove(min(fits))
            left.append(min(fits) - n)
        else:
            left.append(capacity - n)
    return len(left)


def test_best_fit_decreasing():
    rng = random.Random(0)
    for _ in range(40):
        cap = rng.choice([7, 64, 100, 4096])
        lengths = [rng.randint(0 if rng.random() < 0.1 else 1, cap) for _ in range(rng.randint(0, 200))]
        bins, offsets = pk.best_fit_decreasing(np.array(lengths, np.int64), cap)
        used = defaultdict(list)
        for n, b, o in zip(lengths, bins.tolist(), offsets.tolist(), strict=True):
            if n:
                used[b].append((o, n))
        for items in used.values():
            at = 0
            for o, n in sorted(items):
                assert o == at
                at += n
            assert at <= cap
        assert len(used) == naive([n for n in lengths if n], cap)


def check(rows, want_ids, capacity):
    seqs, seen = defaultdict(list), defaultdict(int)
    for r in rows:
        seqs[r.sequence_id].append((r.offset, r.length))
        seen[r.doc_id, r.piece, r.start, r.length, r.ids_crc32] += 1
    want = defaultdict(int)
    for i, ids in want_ids:
        for k, at in enumerate(range(0, len(ids), capacity)):
            part = np.array(ids[at:at + capacity], "<u4")
            want[i, k, at, len(part), zlib.crc32(part.tobytes())] += 1
    assert seen == want
    for items in seqs.values():
        at = 0
        for o, n in sorted(items):
            assert o == at
            at += n
        assert at <= capacity
    return len(seqs)


def test_documents(spark, odd_docs, no_docs):
    t = Tokenizer.from_file(PATH)
    ids = [(r.doc_id, t.encode(r.text or "", add_special_tokens=False).ids + [1]) for r in odd_docs.collect()]
    n = check(pk.pack_documents(odd_docs, PATH).collect(), ids, 4096)
    assert n <= 1 + -(-sum(len(x) for _, x in ids) // 4096)
    assert pk.pack_documents(no_docs, PATH).count() == 0


def test_groups_and_sequences(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    t = Tokenizer.from_file(PATH)
    ids = {r.doc_id: t.encode(r.text or "", add_special_tokens=False).ids + [1] for r in docs.collect()}
    pieces = pk.pieces_of(docs, PATH, capacity=512, with_ids=True)
    out = pk.assign(pieces, capacity=512, group_pieces=40)
    check(out.collect(), ids.items(), 512)
    for r in pk.sequences(out).limit(50).collect():
        at = list(r.starts) + [len(r.ids)]
        for d, a, b in zip(r.doc_ids, at[:-1], at[1:], strict=True):
            assert str(r.ids[a:b])[1:-1] in str(ids[d])


def test_short_pieces_fill_sequences(spark):
    """Groups are sized by tokens: 60,000 pieces of 8 to 12 ids leave few ids unused."""
    df = spark.range(60_000).select((F.abs(F.xxhash64("id")) % 5 + 8).alias("length"))
    out = pk.assign(df)
    total, used = out.agg(F.sum("length"), F.countDistinct("sequence_id")).first()
    print("sequences", used, "of at least", -(-total // 4096))
    assert used <= 1 + -(-total // 4096)
    assert pk.pieces_a_group(10 ** 9, 4 * 10 ** 11, 4096) == 10240
    assert pk.pieces_a_group(10 ** 9, 10 ** 9, 4096) == pk.MOST_PIECES


def test_other_columns_go_along(spark):
    df = spark.range(50).select((F.col("id") % 9 + 1).alias("length"), F.col("id").alias("group"),
                                F.lit("x").alias("bin"))
    out = pk.assign(df, capacity=10, group_pieces=7)
    assert out.count() == 50 and {"group", "bin"} <= set(out.columns)


def test_poor_sequences_are_packed_again(spark):
    """Groups of 20 pieces leave half-empty sequences; at most one is left in the end."""
    df = spark.range(3000).select((F.abs(F.xxhash64("id")) % 90).alias("length")).repartition(4)
    out = pk.assign(df, capacity=100, group_pieces=20)
    filled = out.where("length > 0").groupBy("sequence_id").agg(F.sum("length").alias("n"))
    assert filled.where("2 * n <= 100").count() <= 1
    items = out.collect()
    assert len(items) == 3000
    by_sequence = defaultdict(list)
    for r in items:
        if r.length:
            by_sequence[r.sequence_id].append((r.offset, r.length))
    for parts in by_sequence.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 100


def test_only_empty_pieces(spark):
    df = spark.range(100).select(F.lit(0).cast("long").alias("length"))
    assert pk.assign(df, capacity=10, group_pieces=3).where("offset = 0").count() == 100
