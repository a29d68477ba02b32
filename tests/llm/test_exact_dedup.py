import hashlib
import re
from collections import defaultdict

from pyspark.sql import functions as F

from wordpair.llm.exact_dedup import drop_duplicates, exact_groups


def norm(t):
    return re.sub("[\x20\x09-\x0d]+", " ", t or "")


def brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[norm(t)].append(i)
    out = []
    for i, t in rows:
        g = groups[norm(t)]
        keep = min((x for x in g if x is not None), default=None)
        out.append((i, keep, len(g), i == keep, hashlib.sha256(norm(t).encode()).hexdigest()))
    return sorted(out, key=str)


def test_groups(odd_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    assert sorted(map(tuple, exact_groups(odd_docs).collect()), key=str) == brute(rows)


def test_colliding_hashes_are_told_apart_by_bytes(odd_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    got = exact_groups(odd_docs, hash_fn=lambda c: F.unhex(F.concat(F.lit("0"), F.substring(F.md5(c), 1, 1))))
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)


def test_drop(odd_docs):
    out = drop_duplicates(odd_docs)
    assert out.columns == odd_docs.columns
    rows = out.collect()
    assert len({norm(r.text) for r in rows}) == len(rows)
    assert {norm(r.text) for r in rows} == {norm(r.text) for r in odd_docs.collect()}
    assert [r.doc_id for r in rows if norm(r.text) == "one two"] == [17]
    assert [r.doc_id for r in rows if r.text == "alone without an id"] == [None]


def test_empty(no_docs):
    assert exact_groups(no_docs).count() == 0
    assert drop_duplicates(no_docs).count() == 0


def test_plan_is_native(odd_docs):
    plan = exact_groups(odd_docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
