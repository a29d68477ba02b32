import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from wordpair.llm import token_files as tf
from wordpair.llm import word_bpe
from wordpair.llm.store import new_folder

PATH = public_tokenizers.path("word_bpe_49k.json")
HARD = ["Don't we'll O'CLOCK 'sup they're", "<|endoftext|> a<|EndOfText|>b <|startoftext|>x Mixed Case",
        "école É café, İ K Å STRASSE ß ẞ Σίσυφος ΣΑΣ", "tab\tnl\nvt\x0bff\x0ccr\rnbsp x y\x1cz\x85w",
        "3.14, 1,000.50!!! ...what?! (a,b;c:d) x_y a-b €5", "日本語 テキスト 中文。 한국어", "👍🏽 👨‍👩‍👧 ok", "\x00\x01 ﻿bom ́lead",
        "word.,;:!? A.B.C. É, ÀÉÎ.", "", "   ", "ﬁne ﬂow ½ ², x²"]


def test_words_encode_like_whole_texts(spark):
    t = Tokenizer.from_file(PATH)
    texts = HARD + [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    enc = word_bpe.WordEncoder(PATH)
    for text, ids in zip(texts, enc.encode_many([x.encode() for x in texts]), strict=True):
        assert ids.tolist() == t.encode(text, add_special_tokens=False).ids, text[:80]


def test_small_caches_and_slices(monkeypatch):
    monkeypatch.setattr(word_bpe, "SLICE_WORDS", 5)
    monkeypatch.setattr(word_bpe, "SLICE_BYTES", 16)
    t = Tokenizer.from_file(PATH)
    enc = word_bpe.WordEncoder(PATH, max_words=3)
    texts = [" ".join(HARD), None, "a", "x" * 100 + " y", *HARD]
    for text, ids in zip(texts, enc.encode_many([x and x.encode() for x in texts]), strict=True):
        assert ids.tolist() == t.encode(text or "", add_special_tokens=False).ids


def test_round_trip(spark, odd_docs):
    t = Tokenizer.from_file(PATH)
    path = tf.write_token_files(odd_docs, new_folder(spark, "tokens"), PATH)
    rows = tf.read_token_files(spark, path).orderBy("start").collect()
    ids = {}
    for r in odd_docs.collect():
        ids.setdefault(r.doc_id, []).append(t.encode(r.text or "", add_special_tokens=False).ids + [2])
    order = [r.doc_id for r in rows]
    assert order == sorted((x for x in order if x is not None)) + [None, None]
    at = 0
    for r in rows:
        assert r.start == at and r.n_tokens == len(r.ids)
        ids[r.doc_id].remove(list(r.ids))
        at += r.n_tokens
    assert not any(ids.values())
    got = {(r.start, r.n_tokens, r.ids_crc32) for r in tf.checksums(tf.read_token_files(spark, path)).collect()}
    assert got == {(r.start, r.n_tokens, zlib.crc32(np.array(r.ids, "<u4").tobytes())) for r in rows}


def test_lookup_is_pushed_down(spark, odd_docs):
    path = tf.write_token_files(odd_docs, new_folder(spark, "tokens"), PATH)
    found = tf.find_documents(spark, path, [20, 12])
    assert sorted(r.doc_id for r in found.collect()) == [12, 20, 20]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(doc_id" in plan


def test_empty(spark, no_docs):
    path = tf.write_token_files(no_docs, new_folder(spark, "tokens"), PATH)
    assert tf.checksums(tf.read_token_files(spark, path)).count() == 0


def test_words_met_again_stay_when_the_table_is_full(monkeypatch):
    """Words met once are forgotten; those met often keep their ids, and all ids are right."""
    whole = word_bpe.WordEncoder(PATH)
    enc = word_bpe.WordEncoder(PATH, max_words=20)
    monkeypatch.setattr(word_bpe, "SLICE_WORDS", 10)
    added = []
    monkeypatch.setattr(enc, "_add", lambda w, real=enc._add: (added.append(w), real(w))[1])
    enc.places.add = enc._add
    texts = [f"the cat of the word{chr(97 + i % 26)}{chr(97 + i // 26)} the cat one{chr(97 + i // 26)}two{chr(97 + i % 26)}"
             .encode() for i in range(200)]
    for text, ids in zip(texts, enc.encode_many(texts)):
        assert ids.tolist() == whole.tokenizer.encode(text.decode(), add_special_tokens=False).ids
    assert added.count(b"the") == 1 and len(enc.starts) <= 45


def test_punctuation_after_a_word_needs_no_whole_tokenizer(monkeypatch):
    enc = word_bpe.WordEncoder(PATH)
    words = ["the", "ofthen", "ndoüng", "éc", "l", "s"]
    marks = ["###", "%%%", ",***", "<|>", "\"", ")]}", "-", "_~`", "$&@", "...", "!?"]
    want = [enc.tokenizer.encode(w + m, add_special_tokens=False).ids for w in words for m in marks]
    asked = []
    monkeypatch.setattr(enc, "_whole", lambda w, real=enc._whole: (asked.append(w), real(w))[1])
    got = [x.tolist() for x in enc.encode_many([(w + m).encode() for w in words for m in marks])]
    assert got == want and sorted(asked) == sorted(marks)


def test_a_table_that_forgets_stays_in_order_of_places():
    """What stays is cut out of the table as a whole: places count up, and ids lie between starts."""
    enc = word_bpe.WordEncoder(PATH, max_words=20)
    words = [w.encode() for w in "the cat éc word.,;: onetwo <| ndoüng x l's Don't".split()]
    want = {w: enc.tokenizer.encode(w.decode(), add_special_tokens=False).ids for w in words}
    list(enc._expand([np.array([enc.places[w] for w in words] + [enc.places[w] for w in words[::3]])]))
    enc._forget()
    assert set(enc.places) == set(words[::3]) and list(enc.places.values()) == list(range(len(enc.places)))
    ends = [*enc.starts, len(enc.ids)]
    assert {w: enc.ids[ends[k]:ends[k + 1]].tolist() for w, k in enc.places.items()} == {w: want[w] for w in words[::3]}
    enc.places[b"again"]
    assert enc.places[b"again"] == len(enc.starts) - 1
    assert [x.tolist() for x in enc.encode_many(words)] == list(want.values())
