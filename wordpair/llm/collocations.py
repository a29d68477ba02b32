"""Phrase collocations from Rabin-Karp fingerprints.

1. Each task hashes every phrase of up to ``longest`` words.  Word hashes are
   differences of a prefix polynomial over the text's bytes, phrase hashes are
   polynomials of word hashes, all modulo 31-bit primes: two primes make the
   fingerprint (which the language is part of), a third a check.
2. Per buffer of text the fingerprints are sorted and added up: one entry a
   distinct phrase holds its count, the sum of its checks and a pointer to a
   document that has it.  Entries go, packed, to ranges of the fingerprint; the
   number of ranges follows the bytes of text, so a range stays small.
3. A range adds up its entries and keeps phrases that occur often enough.
4. Only those are materialised: documents that are pointed to are hashed again and
   give the words.  The check of the words times the count must equal the sum of
   checks; where it does not, different phrases share a fingerprint, and all
   phrases of that fingerprint are counted anew by their text.
5. Scores, cuts and ranks are built-in functions on frequent phrases.  Part counts
   need no more than those: a part occurs at least as often as the phrase.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordpair.llm.memory import trimmed
from wordpair.llm.store import written
from wordpair.operators.ordering import dense_index

#: Sums of checks are taken modulo this prime, so that a count cannot cancel them.
CHECK = 65521
#: Two primes for the fingerprint, one for the check, and their bases for bytes and
#: for words (with one base for both, bytes of neighbouring words could change places).
PRIMES = (2147483647, 2147483629, 2147483587)
BASES = (1103515245, 1566083941, 747796405)
WORD_BASES = (1835008971, 1204756307, 1990292843)
_SPREAD = np.uint64(0x9E3779B97F4A7C15)

#: Bytes of text that a task adds up at once, bytes of text for each range of
#: fingerprints, bytes that share one prefix polynomial, longest word inside it.
BUFFER = 8 << 20
RANGE_BYTES = 8 << 20
BLOCK = 1 << 18
LONG_WORD = 1 << 16
#: Languages whose totals are broadcast; beyond that they are joined by shuffle.
BROADCAST_LANGS = 100_000

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\t\x0b\x0c\r",
                         b"abcdefghijklmnopqrstuvwxyz\n\n\n\n\n\n \n\n\n")
_EDGE, _WORD = re.compile(rb"[ \n]"), re.compile(rb"[^ \n]+")

COUNTED = "part int, n long, blob binary"
FREQUENT = "fp long, a long, checks long, pointer long"


def plain(text: bytes | None) -> bytes:
    """A-Z lowered, piece ends as line feeds, tabs as spaces."""
    return (text or b"").translate(_LOWER)


class Hasher:
    """Phrase hashes of plain texts, modulo each of ``primes``."""

    def __init__(self, primes=PRIMES, longest: int = 3):
        self.primes, self.longest = primes, longest
        self.powers = []
        for p, base in zip(primes, BASES, strict=True):
            # powers by doubling: the second half is the first one times base**len
            a = np.ones(1, np.uint64)
            while len(a) <= BLOCK + LONG_WORD:
                a = np.concatenate([a, a * np.uint64(pow(base, len(a), p)) % np.uint64(p)])
            self.powers.append(a[:BLOCK + LONG_WORD + 1])
        self.seeds: dict[str, list[int]] = {}

    def seed(self, lang: str) -> list[int]:
        if lang not in self.seeds:
            h = int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=24).digest(), "big")
            self.seeds[lang] = [h % p for p in self.primes]
        return self.seeds[lang]

    def words(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the words."""
        a = np.frombuffer(data, np.uint8)
        inside = np.empty(len(a) + 2, np.int8)
        inside[0] = inside[-1] = 0
        inside[1:-1] = (a != 0x20) & (a != 0x0A)
        turn = np.diff(inside)
        return (np.flatnonzero(turn == 1).astype(np.int32), np.flatnonzero(turn == -1).astype(np.int32))

    def word_hashes(self, data: bytes, starts: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
        a = np.frombuffer(data, np.uint8)
        out = [np.empty(len(starts), np.uint32) for _ in self.primes]
        long = np.flatnonzero(ends - starts > LONG_WORD)
        at = 0
        while at < len(starts):
            low = int(starts[at])
            to = int(np.searchsorted(starts, low + BLOCK))
            s, e = starts[at:to] - low, np.minimum(ends[at:to] - low, BLOCK + LONG_WORD)
            # bytes count from 1, so that a trailing zero byte changes the hash
            block = a[low:low + int(e.max())].astype(np.uint64) + np.uint64(1)
            for i, p in enumerate(self.primes):
                prefix = np.zeros(len(block) + 1, np.uint64)
                np.cumsum(block * self.powers[i][:len(block)], out=prefix[1:])
                inner = (prefix[e] - prefix[s]) % np.uint64(p)
                out[i][at:to] = inner * self.powers[i][BLOCK - s] % np.uint64(p)
            at = to
        for w in long:
            h = int.from_bytes(hashlib.blake2b(data[starts[w]:ends[w]], digest_size=24).digest(), "big")
            for i, p in enumerate(self.primes):
                out[i][w] = h % p
        return out

    def phrases(self, docs: list[tuple[str, bytes]], below: int | None = None) -> Iterator[tuple]:
        """For each phrase length: ``n, fp, check, first word, doc`` of every phrase of
        the texts (``below``: of those that start before that byte).  The empty phrase of
        a language stands before every word, so its count is the language's words.  The
        first item is ``None, data, starts, ends``: where the words lie."""
        data = b"\n".join(t for _, t in docs)
        starts, ends = self.words(data)
        sizes = np.array([len(t) + 1 for _, t in docs], np.int64)
        doc = np.searchsorted(np.cumsum(sizes), starts, side="right").astype(np.int32)
        counted = len(starts) if below is None else int(np.searchsorted(starts, below))
        yield None, data, starts, ends
        breaks = np.flatnonzero(np.frombuffer(data, np.uint8) == 0x0A)
        piece = np.searchsorted(breaks, starts).astype(np.int32)
        words = self.word_hashes(data, starts, ends)
        seeds = np.array([self.seed(lang) for lang, _ in docs], np.uint64).reshape(-1, len(self.primes))
        grams = [seeds[doc, i].astype(np.uint32) for i in range(len(self.primes))]
        for n in range(self.longest + 1):
            size = len(starts) - max(0, n - 1)
            if size <= 0:
                return
            for i, p in enumerate(self.primes) if n else ():
                grams[i] = ((grams[i][:size].astype(np.uint64) * np.uint64(WORD_BASES[i]) + words[i][n - 1:])
                            % np.uint64(p)).astype(np.uint32)
            size, last = min(size, counted), max(0, n - 1)
            whole = np.flatnonzero(piece[:size] == piece[last:last + size])
            fp = ((grams[0][whole].astype(np.uint64) << np.uint64(31)) | grams[1][whole]) * _SPREAD
            yield n, fp, (grams[2][whole] % np.uint32(CHECK)).astype(np.uint16), whole, doc[whole]


def _cut(text: bytes, longest: int) -> Iterator[tuple[bytes, int]]:
    """Parts of a long plain text, each with the byte before which its phrases
    start; the words behind it only complete those."""
    at = 0
    while at < len(text):
        edge = _EDGE.search(text, at + BUFFER)
        end = edge.start() if edge else len(text)
        more = end
        for _, word in zip(range(longest - 1), _WORD.finditer(text, end)):
            more = word.end()
        yield text[at:more], end - at
        at = end


def _buffers(rows: Iterator[tuple], longest: int) -> Iterator[tuple[list, int | None]]:
    """Lists of rows ``(..., text)`` of some ``BUFFER`` bytes; a longer text comes
    alone and in parts."""
    held, size = [], 0
    for *row, text in rows:
        text = plain(text)
        if len(text) > BUFFER:
            for part, below in _cut(text, longest):
                yield [(*row, part)], below
            continue
        held.append((*row, text))
        size += len(text) + 1
        if size >= BUFFER:
            yield held, None
            held, size = [], 0
    if held:
        yield held, None


def _planes(column: np.ndarray) -> bytes:
    """A column by byte place, so that bytes which are mostly alike shrink."""
    return np.ascontiguousarray(column.view(np.uint8).reshape(len(column), -1).T).tobytes()


def pack(fp: np.ndarray, count: np.ndarray, checks: np.ndarray, pointer: np.ndarray) -> bytes:
    """Ascending fingerprints as gaps, and pointers as places in the list of those there are."""
    keys, place = np.unique(pointer, return_inverse=True)
    raw = b"".join([np.uint32(len(keys)).tobytes(), _planes(np.diff(keys, prepend=np.uint64(0))),
                    _planes(np.diff(fp, prepend=np.uint64(0))), _planes(count.astype("<u4")),
                    _planes(checks.astype("<u2")), _planes(place.astype("<u4"))])
    return np.uint32(len(raw)).tobytes() + pa.compress(raw, codec="zstd", asbytes=True)


def unpack(blob, n: int) -> list[np.ndarray]:
    size = int(np.frombuffer(blob, np.uint32, 1)[0])
    raw = np.frombuffer(pa.decompress(memoryview(blob)[4:], decompressed_size=size, codec="zstd", asbytes=True), np.uint8)
    at = 4

    def column(n, dtype):
        nonlocal at
        width = np.dtype(dtype).itemsize
        planes = raw[at:at + width * n].reshape(width, n)
        at += width * n
        return np.ascontiguousarray(planes.T).view(dtype).ravel()

    keys = np.cumsum(column(int(raw[:4].view(np.uint32)[0]), "<u8"), dtype=np.uint64)
    fp = np.cumsum(column(n, "<u8"), dtype=np.uint64)
    count, checks = column(n, "<u4").astype(np.uint64), column(n, "<u2")
    return [fp, count, checks, keys[column(n, "<u4")]]


def _add(fp, count, checks, pointer):
    """Entries of equal fingerprints added up, ascending."""
    order = np.argsort(fp)
    fp = fp[order]
    first = np.flatnonzero(np.concatenate([[True], fp[1:] != fp[:-1]])) if len(fp) else np.zeros(0, int)
    if not len(first):
        return fp, count, checks, pointer
    return (fp[first], np.add.reduceat(count[order], first),
            (np.add.reduceat(checks[order], first, dtype=np.uint64) % np.uint64(CHECK)).astype(np.uint16),
            np.minimum.reduceat(pointer[order], first))


def _count(rows: DataFrame, longest: int, ranges: int, primes) -> DataFrame:
    """``(pointer, lang, text)`` -> packed entries by range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(primes, longest)

        def each():
            for batch in batches:
                for at in range(0, batch.num_rows, 256):
                    yield from zip(*(c.to_pylist() for c in batch.slice(at, 256).columns), strict=True)

        for docs, below in _buffers(each(), longest):
            keys = np.array([k for k, _, _ in docs], np.uint64)
            for n, *got in hasher.phrases([(lang, text) for _, lang, text in docs], below):
                if n is None:
                    continue
                fp, check, _, doc = got
                entry = _add(fp, np.ones(len(fp), np.uint32), check, keys[doc])
                # ranges are equal stretches of the 64-bit fingerprint
                part = ((entry[0] >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)
                edges = np.searchsorted(part, np.arange(ranges + 1, dtype=np.uint64))
                held = [(i, a, b) for i, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if a < b]
                for at in range(0, len(held), 64):
                    some = held[at:at + 64]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([i for i, _, _ in some], pa.int32()),
                         pa.array([b - a for _, a, b in some], pa.int64()),
                         pa.array([pack(*(c[a:b] for c in entry)) for _, a, b in some], pa.binary())],
                        names=["part", "n", "blob"])

    return rows.mapInArrow(trimmed(run), COUNTED)


def _frequent(counted: DataFrame, ranges: int, least: int) -> DataFrame:
    def add(table: pa.Table) -> pa.Table:
        entries = [unpack(blob.as_buffer(), n) for n, blob in
                   zip(table.column("n").to_pylist(), table.column("blob"), strict=True)]
        fp, count, checks, pointer = _add(*(np.concatenate(c) for c in zip(*entries, strict=True)))
        often = count >= least
        return pa.table({"fp": fp[often].view(np.int64), "a": count[often].astype(np.int64),
                         "checks": checks[often].astype(np.int64),
                         "pointer": pointer[often].view(np.int64)})

    # a number given stays as it is: one range a task, however many tables' partitions are set
    return counted.repartition(ranges, "part").groupBy("part").applyInArrow(add, FREQUENT)


PHRASES = "fp long, lang string, n int, phrase string, a long, sure boolean"


def _materialise(docs: DataFrame, longest: int, primes) -> DataFrame:
    """``(pointer, lang, text, wanted)`` -> the wanted fingerprints' words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, done = Hasher(primes, longest), set()

        def each():
            for batch in batches:
                for key, lang, text, wanted in zip(*(batch.column(c) for c in range(4)), strict=True):
                    text = text.as_py()
                    mark = (key.as_py(), hash(text))
                    if mark not in done:   # a row that is there many times gives its words once
                        done.add(mark)
                        w = wanted.values
                        yield lang.as_py(), [w.field(i).to_numpy(zero_copy_only=False) for i in range(3)], text

        for rows, below in _buffers(each(), longest):
            fps, a, checks = (np.concatenate([w[i] for _, w, _ in rows]) for i in range(3))
            order = np.argsort(fps)
            fps, a, checks = fps[order], a[order], checks[order]
            for n, *got in hasher.phrases([(lang, text) for lang, _, text in rows], below):
                if n is None:
                    data, starts, ends = got
                    continue
                fp, check, first, doc = got
                found, at = np.unique(fp.view(np.int64), return_index=True)
                place = np.searchsorted(fps, found).clip(max=len(fps) - 1)
                hit = np.flatnonzero(fps[place] == found)
                place, at = place[hit], at[hit]
                words = [[data[starts[w + i]:ends[w + i]] for i in range(n)] for w in first[at].tolist()]
                sure = check[at].astype(np.int64) * (a[place] % CHECK) % CHECK == checks[place]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(fps[place]), pa.array([rows[d][0] for d in doc[at].tolist()], pa.string()),
                     pa.array([n] * len(at), pa.int32()),
                     pa.array([b" ".join(w) for w in words], pa.binary()).cast(pa.string()),
                     pa.array(a[place]), pa.array(sure)],
                    names=["fp", "lang", "n", "phrase", "a", "sure"])

    return docs.mapInArrow(trimmed(run), PHRASES)


def _by_text(rows: DataFrame, bad: DataFrame, longest: int, least: int, primes) -> DataFrame:
    """Counts by text of all phrases whose fingerprint is in ``bad``."""
    # at most 2**20 numbers, whatever the size of ``bad``
    marks = np.zeros(1 << 20, bool)
    for row in bad.select(F.shiftrightunsigned("fp", 44).alias("m")).distinct().collect():
        marks[row["m"]] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(primes, longest)

        def each():
            for batch in batches:
                for at in range(0, batch.num_rows, 256):
                    some = batch.slice(at, 256)
                    yield from zip(some.column(1).to_pylist(), some.column(2).to_pylist(), strict=True)

        for docs, below in _buffers(each(), longest):
            for n, *got in hasher.phrases(docs, below):
                if n is None:
                    data, starts, ends = got
                    continue
                fp, _, first, doc = got
                counts: dict[tuple, int] = {}
                for i in np.flatnonzero(marks[(fp >> np.uint64(44)).astype(np.int64)]).tolist():
                    w = int(first[i])
                    key = (int(fp[i].view(np.int64)), docs[doc[i]][0],
                           b" ".join(data[starts[w + j]:ends[w + j]] for j in range(n)))
                    counts[key] = counts.get(key, 0) + 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k[0] for k in counts], pa.int64()), pa.array([k[1] for k in counts], pa.string()),
                     pa.array([n] * len(counts), pa.int32()),
                     pa.array([k[2] for k in counts], pa.binary()).cast(pa.string()),
                     pa.array(list(counts.values()), pa.int64())],
                    names=["fp", "lang", "n", "phrase", "a"])

    found = rows.mapInArrow(run, "fp long, lang string, n int, phrase string, a long")
    return (found.join(bad.select("fp").distinct(), "fp", "left_semi")
            .groupBy("lang", "n", "phrase").agg(F.sum("a").alias("a")).where(F.col("a") >= least))


def phrase_counts(docs: DataFrame, longest: int = 3, least: int = 10, text_col: str = "text",
                  lang_col: str = "lang", id_col: str = "doc_id", primes=PRIMES,
                  range_bytes: int = RANGE_BYTES) -> tuple[DataFrame, DataFrame]:
    """``(phrases, words)``: ``lang, n, phrase, a`` of every phrase of up to
    ``longest`` words that occurs ``least`` times or more, and ``lang, n``, the words of
    every language with ``least`` words or more.

    A null language is ``und`` and falls in one group with that name; a null text
    counts as empty.  Rows that are repeated count each.  Ids may repeat or be null:
    with the text they only tell which rows to read again.  An empty table gives
    empty tables."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    # 40 bits: rows that share a pointer by chance are both read again
    pointer = F.shiftrightunsigned(F.xxhash64(F.col(id_col), text), 24)
    rows = docs.select(pointer.alias("pointer"), F.coalesce(F.col(lang_col), F.lit("und")).alias("lang"),
                       text.cast("binary").alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = total // range_bytes + 1
    frequent = written(_frequent(_count(rows, longest, ranges, primes), ranges, least), "frequent")
    wanted = frequent.groupBy("pointer").agg(F.collect_list(F.struct("fp", "a", "checks")).alias("wanted"))
    # most texts are pointed to by nothing and go before any text is moved
    pointers = written(frequent.select("pointer").distinct(), "pointers")
    texts = rows.join(pointers, "pointer", "left_semi").join(wanted, "pointer").select("pointer", "lang", "text", "wanted")
    found = written(_materialise(texts, longest, primes), "phrases").dropDuplicates(["fp"])
    sure = found.where("sure").select("lang", "n", "phrase", "a")
    bad = found.where("not sure").select("fp")
    if not bad.isEmpty():
        sure = sure.unionByName(_by_text(rows, written(bad, "shared"), longest, least, primes))
    sure = written(sure, "phrase-counts")
    return sure.where("n > 0"), sure.where("n = 0").select("lang", F.col("a").alias("n"))


def _joined(words: Column, at, n) -> Column:
    return F.array_join(F.slice(words, at, n), " ")


def collocations(phrases: DataFrame, words: DataFrame, top: int = 2000, shortest: int = 2,
                 inside_percent: int = 50) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score`` of the ``top`` phrases a language.

    The score of a cut is ``floor(10**6 a a / (l r))`` in whole numbers; the lowest
    cut counts, of equal ones that with the shortest first part.  A phrase inside a
    longer one with at least ``inside_percent`` of its count goes.  Ties in score
    and count are ordered by the phrase's bytes.  Without phrases the result is
    empty."""
    split = F.split("phrase", " ")
    cand = phrases.where(F.col("n") >= shortest).select("lang", "phrase", "a", F.col("n").alias("size"),
                                                        split.alias("ws"))
    cuts = cand.select("lang", "phrase", "a", "size", "ws",
                       F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", _joined(F.col("ws"), F.lit(1), F.col("k")).alias("left"),
                       _joined(F.col("ws"), F.col("k") + 1, F.col("size") - F.col("k")).alias("right"))
    for side, count in (("left", "l"), ("right", "r")):
        part = phrases.select("lang", F.col("phrase").alias(side), F.col("a").alias(count))
        cuts = cuts.join(part, ["lang", side])
    score = F.expr("(cast(1000000 as decimal(7,0)) * cast(a as decimal(15,0)) * cast(a as decimal(15,0)))"
                   " div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))")
    best = (cuts.withColumn("score", score).groupBy("lang", "phrase", "a")
            .agg(F.min(F.struct("score", "k", "l", "r")).alias("cut")))
    inner = (cand.where(F.col("size") > shortest)
             .select("lang", F.col("a").alias("f"), "ws", "size",
                     F.explode(F.sequence(F.lit(shortest), F.col("size") - 1)).alias("m"))
             .select("lang", "f", "ws", "m", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("m") + 1)).alias("at"))
             .groupBy("lang", _joined(F.col("ws"), F.col("at"), F.col("m")).alias("phrase"))
             .agg(F.max("f").alias("longer")))
    kept = (best.join(inner, ["lang", "phrase"], "left")
            .where(F.coalesce(100 * F.col("longer") < inside_percent * F.col("a"), F.lit(True))))
    kept = kept.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    placed = dense_index(kept, [F.col("lang"), F.col("score").desc(), F.col("a").desc(), F.col("phrase")])
    # a row a language: broadcast up to BROADCAST_LANGS of them, so that a language with most
    # phrases is no hot key
    langs = written(placed.groupBy("lang").agg(F.min("idx").alias("first")).join(words, "lang"), "languages")
    langs = F.broadcast(langs) if langs.count() <= BROADCAST_LANGS else langs
    return (placed.join(langs, "lang").withColumn("rank", F.col("idx") - F.col("first") + 1)
            .where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score"))
