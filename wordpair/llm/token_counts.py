"""Unigram token counts with dynamic programming shared over a trie.

A pre-token is a white-space separated word after the word mark.  Its tokens are
the segmentation into vocabulary pieces with the highest sum of piece scores.
Each worker inserts the distinct pre-tokens it meets in a trie; a node stores the
best score and token count of its prefix, computed once from its ancestors, so
words that share a prefix share that work.  The count at a word's last node is
the word's; a document's is the sum over its words.

Nothing is shuffled: a text costs one lookup a word in the scan task.  The trie
starts over when it reaches ``max_nodes``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordpair.llm.memory import kept

WORD_MARK = "▁"
#: A character that no piece covers costs this much more than the worst piece.
UNKNOWN_PENALTY = 10.0
SLICE_BYTES = 1 << 20
_SPACE = re.compile(rb"[\x20\x09-\x0D]")


def load_pieces(path: str) -> dict[str, float]:
    """Pieces and scores of a sentencepiece model file (no control, unknown or
    byte pieces)."""
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    return {sp.id_to_piece(i): sp.get_score(i) for i in range(sp.get_piece_size())
            if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))}


class ForwardTrie:
    """Prefix trie with the best score and token count of each prefix."""

    def __init__(self, pieces: dict[str, float], max_nodes: int = 1_000_000):
        self.pieces = pieces
        self.longest = max(map(len, pieces), default=1)
        self.unknown = min(pieces.values(), default=0.0) - UNKNOWN_PENALTY
        self.max_nodes = max_nodes
        self.clear()

    def clear(self) -> None:
        self.child: dict[tuple[int, str], int] = {}
        self.best = [0.0]
        self.tokens = [0]

    def _extend(self, path: list[int], word: str, end: int) -> int:
        """A new node for ``word[:end]``, below ``path`` (the nodes of its prefixes)."""
        best, tokens, pieces = self.best, self.tokens, self.pieces
        top, count = -1e300, 0
        # longest last piece first, so that of equal scores it wins
        for start in range(max(0, end - self.longest), end):
            s = pieces.get(word[start:end])
            if s is not None:
                s += best[path[start]]
                if s > top:
                    top, count = s, tokens[path[start]] + 1
        if word[end - 1] not in pieces:
            s = best[path[end - 1]] + self.unknown
            if s > top:
                # an unknown character is written as its bytes
                top, count = s, tokens[path[end - 1]] + len(word[end - 1].encode("utf-8", "replace"))
        best.append(top)
        tokens.append(count)
        return len(best) - 1

    def count(self, word: str) -> int:
        path = [0]
        node, child = 0, self.child
        for i, ch in enumerate(word):
            nxt = child.get((node, ch))
            if nxt is None:
                nxt = child[node, ch] = self._extend(path, word, i + 1)
            path.append(nxt)
            node = nxt
        return self.tokens[node]

    def full(self) -> bool:
        return len(self.best) > self.max_nodes


class _Counts(dict):
    """Terminal counts by word, taken from the trie on first use."""

    def __init__(self, trie: ForwardTrie):
        super().__init__()
        self.trie = trie

    def __missing__(self, word: bytes) -> int:
        n = self[word] = self.trie.count(WORD_MARK + word.decode("utf-8", "replace"))
        return n


class TokenCounter:
    def __init__(self, path: str, max_nodes: int):
        self.trie = ForwardTrie(load_pieces(path), max_nodes)
        self.counts = _Counts(self.trie)

    def __call__(self, text: bytes | None) -> tuple[int, int]:
        """(pre-tokens, tokens) of a whole text."""
        text = text or b""
        at = words = total = 0
        while at <= len(text):
            end = len(text)
            if end - at > SLICE_BYTES:
                m = _SPACE.search(text, at + SLICE_BYTES)
                end = m.start() if m else end
            w = text[at:end].split()
            words += len(w)
            total += sum(map(self.counts.__getitem__, w))
            at = end + 1
            if self.trie.full():
                self.trie.clear()
                self.counts.clear()
        return words, total


def _counter(path: str, max_nodes: int) -> TokenCounter:
    """This worker process's counter; it outlives the task."""
    counters = kept("counters")
    if (path, max_nodes) not in counters:
        counters[path, max_nodes] = TokenCounter(path, max_nodes)
    return counters[path, max_nodes]


def token_counts(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text",
                 max_nodes: int = 1_000_000) -> DataFrame:
    """``doc_id, n_pretokens, n_tokens`` for every row of ``docs``.

    A null or empty text has no tokens.  Rows are counted each on their own, so
    repeated ids, ties and null ids pass through; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _counter(model_path, max_nodes)
        for batch in batches:
            got = np.array([count(t) for t in batch.column(1).to_pylist()], np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(got[:, 0]), pa.array(got[:, 1])],
                names=["doc_id", "n_pretokens", "n_tokens"])

    return (docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary"))
            .mapInArrow(run, "doc_id long, n_pretokens long, n_tokens long"))
