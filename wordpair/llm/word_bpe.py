"""Token ids of whole texts by a public word BPE, a distinct word at a time.

The tokenizer of ``word_bpe_49k.json`` drops white space, and none of its
pre-tokens spans any: the ids of a text are those of its white-space separated
words in a row.  Each Python worker keeps the ids of the words it has met (up
to ``max_words``, then it starts over), so a word is encoded once and a text
costs one lookup a word.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterable, Iterator
from itertools import compress

import numpy as np

from wordpair.llm.memory import kept

#: Words that a worker keeps (some 100 bytes each) before it forgets those met once.
MAX_WORDS = 400_000
#: Words looked up before their ids are expanded; bounds the memory of a task.
SLICE_WORDS = 200_000
#: Bytes of one text that are split at once.
SLICE_BYTES = 1 << 20

_SPACE = re.compile(rb"[\x20\x09-\x0D]")
# One letter run, perhaps closed by one run of ASCII punctuation without apostrophes:
# exactly the pre-tokens of the tokenizer, and nothing that its normaliser changes.
_PLAIN = re.compile(r"([a-zß-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)").fullmatch


def byte_letters() -> dict[int, str]:
    """The printable character that byte-level BPE files write for each byte."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class _Places(dict):
    """word -> its place in the encoder's table, filled on first use."""

    def __init__(self, add):
        super().__init__()
        self.add = add

    def __missing__(self, word: bytes) -> int:
        place = self[word] = self.add(word)
        return place


class WordEncoder:
    def __init__(self, path: str, max_words: int = MAX_WORDS):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = byte_letters()
        self.max_words = max_words
        self.clear()

    def clear(self) -> None:
        self.places = _Places(self._add)
        self.marks: dict[str, list[int]] = {}
        self.ids = array("I")
        self.starts = array("q")           # of each place; its ids end where the next one's start
        self.met = np.zeros(0, np.int64)   # how often each place was looked up

    def _forget(self) -> None:
        """Keep the words met most often, at most half as many as a worker keeps, and
        none that was met once."""
        met = self.met
        most = len(met) - self.max_words // 2
        least = max(2, int(np.partition(met, most)[most]) + 1) if most > 0 else 2
        kept = met >= least
        # a word's place is its number in the table, so the table's order is that of places
        words = list(compress(self.places, kept.tolist()))
        size = np.diff(self.starts, append=len(self.ids))
        ids = np.frombuffer(self.ids, np.uint32)[np.repeat(kept, size)]
        size = size[kept]
        self.clear()
        if len(ids) <= 8 * self.max_words:
            self.places.update(zip(words, range(len(words))))
            self.starts.frombytes((np.cumsum(size) - size).astype(np.int64).tobytes())
            self.ids.frombytes(ids.tobytes())
        self.met = np.zeros(len(self.starts), np.int64)

    def _whole(self, word: str) -> list[int]:
        return self.tokenizer.encode(word, add_special_tokens=False).ids

    def _add(self, word: bytes) -> int:
        text = word.decode("utf-8", "replace")
        m = _PLAIN(text) or _PLAIN(text.lower())
        if m is None:
            ids = self._whole(text)
        else:
            run, mark = m.groups()
            if not run.isascii():
                run = run.encode().decode("latin-1").translate(self.letters)
            ids = [t.id for t in self.model.tokenize(run)]
            if mark:
                if mark not in self.marks:
                    self.marks[mark] = self._whole(mark)
                ids += self.marks[mark]
        self.starts.append(len(self.ids))
        self.ids.extend(ids)
        return len(self.starts) - 1

    def _expand(self, places: list[np.ndarray]) -> list[np.ndarray]:
        """The ids of each run of word places."""
        k = np.concatenate(places)
        met = np.bincount(k, minlength=len(self.starts))
        met[:len(self.met)] += self.met
        self.met = met
        starts = np.array(self.starts, np.int64)
        size = np.diff(starts, append=len(self.ids))[k]
        start = starts[k]
        end = np.cumsum(size)
        at = np.repeat(start - (end - size), size) + np.arange(end[-1] if len(end) else 0)
        flat = np.frombuffer(self.ids, np.uint32)[at] if len(at) else np.zeros(0, np.uint32)
        cuts = np.concatenate([[0], end])[np.cumsum([len(p) for p in places])]
        return np.split(flat, cuts[:-1])

    def _slices(self, text: bytes) -> Iterator[bytes]:
        at = 0
        while len(text) - at > SLICE_BYTES:
            m = _SPACE.search(text, at + SLICE_BYTES)
            if m is None:
                break
            yield text[at:m.start()]
            at = m.end()
        yield text[at:] if at else text

    def encode_many(self, texts: Iterable[bytes | None]) -> Iterator[np.ndarray]:
        """uint32 ids of each text (UTF-8; null: none), in order."""
        places: list[np.ndarray] = []   # of the slices that wait
        owner: list[int] = []           # number of slices of each text that waits
        parts: list[np.ndarray] = []
        words = 0

        def flush() -> Iterator[np.ndarray]:
            got = self._expand(places) if places else []
            at = 0
            for n in owner:
                yield got[at] if n == 1 else np.concatenate(got[at:at + n])
                at += n
            places.clear()
            owner.clear()
            if len(self.starts) > self.max_words or len(self.ids) > 16 * self.max_words:
                self._forget()

        for text in texts:
            text = text or b""
            if b"<|" not in text:
                # names of special tokens are matched before the tokenizer lower-cases
                text = text.lower()
            parts = []
            for piece in self._slices(text):
                w = piece.split()
                parts.append(np.fromiter(map(self.places.__getitem__, w), np.int64, len(w)))
                words += len(w)
            places += parts
            owner.append(len(parts))
            if words >= SLICE_WORDS:
                yield from flush()
                words = 0
        yield from flush()


def encoder(path: str, max_words: int = MAX_WORDS) -> WordEncoder:
    """This worker process's encoder for a file; it outlives the task."""
    encoders = kept("encoders")
    if (path, max_words) not in encoders:
        encoders[path, max_words] = WordEncoder(path, max_words)
    return encoders[path, max_words]
