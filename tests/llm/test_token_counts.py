import public_tokenizers
import pytest
from tokenizers import models

from wordpair.llm import token_counts as tc

PATH = public_tokenizers.path("piece_bpe_32k.model")
PIECES = tc.load_pieces(PATH)


@pytest.fixture(scope="module")
def unigram():
    return models.Unigram([("<unk>", 0.0), *PIECES.items()], 0, False)


def brute(unigram, text):
    words = (text or "").encode().split()
    total = 0
    for w in words:
        w = tc.WORD_MARK + w.decode()
        for t in unigram.tokenize(w):
            # offsets are in bytes; an unknown run is written as its bytes
            total += t.offsets[1] - t.offsets[0] if t.id == 0 else 1
    return len(words), total


def test_against_a_unigram_tokenizer(spark, unigram):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = {r.doc_id: r.text for r in docs.collect()}
    for r in tc.token_counts(docs, PATH).collect():
        assert (r.n_pretokens, r.n_tokens) == brute(unigram, rows[r.doc_id]), r.doc_id


def test_odd_rows(odd_docs, no_docs, unigram):
    want = sorted((str(r.doc_id), *brute(unigram, r.text)) for r in odd_docs.collect())
    got = tc.token_counts(odd_docs, PATH)
    assert sorted((str(r.doc_id), r.n_pretokens, r.n_tokens) for r in got.collect()) == want
    assert tc.token_counts(no_docs, PATH).count() == 0


def test_a_small_trie_starts_over(odd_docs):
    a = tc.token_counts(odd_docs, PATH).collect()
    b = tc.token_counts(odd_docs, PATH, max_nodes=50).collect()
    assert sorted(map(str, a)) == sorted(map(str, b))


def test_prefixes_are_scored_once():
    trie = tc.ForwardTrie({"a": -1.0, "b": -2.0, "ab": -1.5, "abc": -9.0, "c": -3.0})
    assert trie.count("abc") == 2 and trie.count("ab") == 1 and trie.count("") == 0
    nodes = len(trie.best)
    assert trie.count("abca") == 3
    assert len(trie.best) == nodes + 1


def brute_best(word, pieces, unknown):
    best = [(0.0, 0)] + [None] * len(word)
    for end in range(1, len(word) + 1):
        options = [(best[s][0] + pieces[word[s:end]], s) for s in range(end) if word[s:end] in pieces]
        if word[end - 1] not in pieces:
            options.append((best[end - 1][0] + unknown, end - 1))
        score, start = max(options, key=lambda o: (o[0], -o[1]))
        n = 1 if word[start:end] in pieces else len(word[start:end].encode())
        best[end] = (score, best[start][1] + n)
    return best[-1][1]


def test_against_plain_dynamic_programming():
    import random
    rng = random.Random(2)
    letters = "abcé"
    pieces = {"".join(rng.choices("abc", k=rng.randint(1, 4))): -rng.randint(1, 9) for _ in range(25)}
    pieces.setdefault("a", -5)
    trie = tc.ForwardTrie(pieces)
    for _ in range(300):
        w = "".join(rng.choices(letters, k=rng.randint(0, 12)))
        assert trie.count(w) == brute_best(w, pieces, trie.unknown), w
