"""Language identification as a mixture: which languages a text is written in,
and in what proportions.

Each language has a smoothed distribution over hashed n-grams (1 to 4 bytes),
counted over all training rows.  A text's n-grams come from a mixture of those
distributions; expectation-maximisation estimates the proportions.  Of the sets
made of the k largest languages (k = 1, 2, ...), the one with the highest
likelihood minus a penalty a language is chosen.  All texts of a batch run through
EM together, as one sparse matrix.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordpair.llm.ngrams import add_up, bucket_counts
from wordpair.llm.store import written

ORDERS = (1, 2, 3, 4)
BITS = 15
ALPHA = 0.5
#: Steps before the first look at the bound, which ends EM for most texts; the others go
#: on until it is close, so this changes time and not results.
EM_STEPS = 4
SET_STEPS = 12
#: How far above the proportions' likelihood that of a set may still lie when sets are
#: compared, in log units.
CLOSE = 1.0
#: Penalty a language of the chosen set, in units of ln(n-grams).
PENALTY = 8.0
#: The model holds languages x 2**BITS floats (128 KB a language) and goes to every
#: task; beyond this many languages fitting is an error, nothing is dropped.
MAX_LANGUAGES = 1000
#: Relative error of a likelihood summed in single precision.
ROUNDING = 2e-6
#: n-gram entries that run through EM at once.
ENTRIES = 400_000

_ASCII_LETTER = re.compile(rb"[A-Za-z]")



def fit(rows: DataFrame, text_col: str = "text", lang_col: str = "lang") -> dict[str, np.ndarray]:
    """Language -> log probabilities of the buckets, from rows whose language is
    not null (null texts count as empty)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        totals: dict[str, list] = {}
        for batch in batches:
            for lang, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                mine = totals.setdefault(lang, [0, np.zeros(1 << BITS, np.int64)])
                mine[0] += 1
                mine[1] += bucket_counts(text, ORDERS, BITS)
        for lang, (n, counts) in totals.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang]), pa.array([n], pa.int64()), pa.array([counts.tobytes()], pa.binary()),
                 pa.array([TaskContext.get().partitionId()], pa.int64())],
                names=["label", "n", "counts", "part"])

    known = (rows.where(F.col(lang_col).isNotNull())
             .select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("binary")))
    sums = add_up(written(known.mapInArrow(run, "label string, n long, counts binary, part long"), "languages"))
    got = sums.limit(MAX_LANGUAGES + 1).collect()
    if len(got) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    model = {}
    for row in sorted(got, key=lambda r: r["label"]):
        c = np.frombuffer(bytes(row["counts"]), np.int64) + ALPHA
        model[row["label"]] = np.log(c / c.sum()).astype(np.float32)
    return model


def _counts(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Distinct buckets of a text and their occurrences."""
    dense = bucket_counts(text, ORDERS, BITS)
    found = np.flatnonzero(dense)
    return found, dense[found]


class Entries:
    """The n-grams of a block of texts as one sparse matrix."""

    def __init__(self, doc: np.ndarray, count: np.ndarray, logp: np.ndarray):
        self.count, self.logp = count, logp
        self.first = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
        self.doc = np.repeat(np.arange(len(self.first)), np.diff(np.append(self.first, len(doc))))
        self.total = np.add.reduceat(count, self.first, dtype=np.float64)
        # relative to the best language of each n-gram, so that exp() keeps its range
        peak = logp.max(axis=1)
        self.like = np.exp(logp - peak[:, None])
        self.base = np.add.reduceat((count * peak).astype(np.float64), self.first)

    def em(self, pi: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray]:
        """Proportions after ``steps`` and their log-likelihood, per text."""
        for _ in range(steps):
            joint = self.like * pi[self.doc]
            joint *= (self.count / joint.sum(axis=1))[:, None]
            pi = (np.add.reduceat(joint, self.first, axis=0) / self.total[:, None]).astype(np.float32)
        mixed = np.einsum("ij,ij->i", self.like, pi[self.doc])
        return pi, self.base + np.add.reduceat((self.count * np.log(np.maximum(mixed, 1e-30)))
                                               .astype(np.float64), self.first)

    def likelihood(self, pi: np.ndarray) -> np.ndarray:
        mixed = np.einsum("ij,ij->i", self.like, pi[self.doc])
        return self.base + np.add.reduceat(self.count * np.log(np.maximum(mixed, 1e-30)), self.first,
                                           dtype=np.float64)

    def gain(self, pi: np.ndarray) -> np.ndarray:
        """The gradient of the log-likelihood over the text's n-grams: the factors of
        an EM step."""
        mixed = np.maximum(np.einsum("ij,ij->i", self.like, pi[self.doc]), 1e-30)
        g = np.add.reduceat((self.like * (self.count / mixed)[:, None]).astype(np.float64), self.first, axis=0)
        return g / self.total[:, None]

    def slack(self, gain: np.ndarray, within: np.ndarray | None = None) -> np.ndarray:
        """How much a log-likelihood with this gain may be below the maximum (over the
        languages ``within``, if given), at most.

        It is concave, and by Jensen's inequality no proportions are likelier by more
        than n ln(max_k gain_k).
        """
        most = (gain if within is None else np.where(within, gain, 0.0)).max(axis=1)
        # and the rounding of single precision
        return self.total * (np.log(np.maximum(most, 1.0)) + ROUNDING)

    def settle(self, pi: np.ndarray, need: np.ndarray, within: np.ndarray | None = None
               ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(pi, log-likelihood, slack)`` with a slack of at most ``need`` (per text),
        or what rounding allows.

        EM steps with their factors raised to a power, which grows as long as the
        likelihood does; where it does not, a plain step is taken, which cannot lose.
        """
        pi, need = pi.astype(np.float64), np.maximum(need, 2 * ROUNDING * self.total)
        value, power = self.likelihood(pi), np.ones(len(pi))
        stuck = np.zeros(len(pi), bool)
        while True:
            gain = self.gain(pi)
            slack = self.slack(gain, within)
            open_ = (slack > need) & ~stuck
            if not open_.any():
                return pi.astype(np.float32), value, slack

            def step(by, pi=pi, gain=gain):
                new = pi * gain ** by[:, None]
                return new / np.maximum(new.sum(axis=1, keepdims=True), 1e-300)

            new = step(power)
            got = self.likelihood(new)
            worse = open_ & ~(got > value) & (power > 1)
            if worse.any():
                plain = step(np.ones(len(pi)))
                new[worse], got[worse] = plain[worse], self.likelihood(plain)[worse]
            # a plain step that gains nothing is at the end of what can be told apart
            stuck |= open_ & ~(got > value) & (worse | (power <= 1))
            moved = open_ & (got > value)
            pi[moved], value[moved] = new[moved], got[moved]
            power = np.where(moved & ~worse, np.minimum(power * 1.5, 64.0), 1.0)

    def of(self, docs: np.ndarray) -> Entries:
        """The same for some of the texts (ascending)."""
        keep = np.isin(self.doc, docs)
        return Entries(self.doc[keep], self.count[keep], self.logp[keep])


class Mixture:
    """EM over a block of texts at once."""

    def __init__(self, model: dict[str, np.ndarray]):
        self.langs = sorted(model)
        self.logp = (np.stack([model[k] for k in self.langs], axis=1) if model
                     else np.zeros((1 << BITS, 0), np.float32))

    def infer(self, texts: list[bytes]) -> list[dict[str, float]]:
        """Proportions of the chosen languages of each text."""
        out: list[dict[str, float]] = []
        block: list[tuple[np.ndarray, np.ndarray]] = []
        entries = 0
        for t in texts:
            block.append(_counts(t))
            entries += len(block[-1][0])
            if entries >= ENTRIES:
                out += self._block(block)
                block, entries = [], 0
        return out + (self._block(block) if block else [])

    def _block(self, block) -> list[dict[str, float]]:
        n_docs, n_langs = len(block), len(self.langs)
        found = np.concatenate([f for f, _ in block])
        count = np.concatenate([c for _, c in block]).astype(np.float32)
        doc = np.repeat(np.arange(n_docs), [len(f) for f, _ in block])
        texts = Entries(doc, count, self.logp[found])

        pi, most = texts.em(np.full((n_docs, n_langs), 1.0 / n_langs, np.float32), EM_STEPS)
        single = np.add.reduceat((texts.count[:, None] * texts.logp).astype(np.float64), texts.first, axis=0)
        chosen = np.zeros((n_docs, n_langs), np.float32)
        chosen[np.arange(n_docs), single.argmax(axis=1)] = 1.0
        cost = PENALTY * np.log(np.maximum(texts.total, 2.0))
        value = single.max(axis=1) - cost
        slack = texts.slack(texts.gain(pi))
        open_ = np.flatnonzero((most + slack - 2 * cost > value) & (slack > cost / 4))
        if len(open_):
            pi[open_], most[open_], slack[open_] = texts.of(open_).settle(pi[open_], cost[open_] / 4)
        order = np.argsort(-pi, axis=1, kind="stable")
        rank = np.empty_like(order)
        np.put_along_axis(rank, order, np.arange(n_langs)[None, :], axis=1)
        for k in range(2, n_langs + 1):
            # no set is likelier than all languages together, so most texts end here
            open_ = np.flatnonzero(most + slack - k * cost > value)
            if not len(open_):
                break
            start = np.where(rank[open_] < k, np.maximum(pi[open_], 1e-4), 0.0).astype(np.float32)
            start /= start.sum(axis=1, keepdims=True)
            some, within = texts.of(open_), start > 0
            got, ll = some.em(start, SET_STEPS)
            short = some.slack(some.gain(got), within)
            again = np.flatnonzero((ll + short - k * cost[open_] > value[open_]) & (short > CLOSE))
            if len(again):
                got[again], ll[again], _ = some.of(again).settle(got[again], np.full(len(again), CLOSE), within[again])
            better = ll - k * cost[open_] > value[open_]
            chosen[open_[better]] = got[better]
            value[open_[better]] = (ll - k * cost[open_])[better]
        return [{self.langs[j]: float(row[j]) for j in np.flatnonzero(row > 0)} for row in chosen]


def has_letter(text: bytes) -> bool:
    """Whether a text has a character of a Unicode category L*."""
    # nearly all texts have an ASCII letter near their start
    if _ASCII_LETTER.search(text):
        return True
    return any(c.isalpha() for c in text.decode("utf-8", "replace"))


def identify(docs: DataFrame, model: dict[str, np.ndarray], text_col: str = "text") -> DataFrame:
    """``docs`` plus ``lang_pred``, ``lang_score`` (its proportion) and ``lang_mix``
    (map of the chosen languages to proportions).

    A text that is null or has no letter, and every text if the model knows no
    language, is ``und`` with score 0 and an empty mix.  Equal proportions go to
    the language that comes first by name.
    """
    new = ("lang_pred", "lang_score", "lang_mix")
    rest = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in new])
    names = rest.schema.names
    place = names.index(text_col)
    # columns go by their places: Python functions do not take names with dots
    numbered = [f"c{i}" for i in range(len(names))]
    ddl = ", ".join(f"{c} {f.dataType.simpleString()}" for c, f in zip(numbered, rest.schema.fields, strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mixture = Mixture(model)
        for batch in batches:
            texts = batch.column(place).cast(pa.binary()).to_pylist()
            real = [i for i, t in enumerate(texts) if model and t and has_letter(t)]
            mixes: list[dict[str, float]] = [{} for _ in texts]
            for i, mix in zip(real, mixture.infer([texts[i] for i in real]), strict=True):
                mixes[i] = mix
            top = [max(sorted(m), key=m.get) if m else "und" for m in mixes]
            share = [min(1.0, m[k]) if m else 0.0 for m, k in zip(mixes, top, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(top, pa.string()), pa.array(share, pa.float64()),
                 pa.array([sorted(m.items()) for m in mixes], pa.map_(pa.string(), pa.float64()))],
                names=[*numbered, *new])

    return (rest.toDF(*numbered).mapInArrow(run, ddl + ", lang_pred string, lang_score double, "
                                            "lang_mix map<string, double>").toDF(*names, *new))
