import gzip
from collections import defaultdict

import pytest

from wordpair.llm import warc
from wordpair.llm.store import new_folder

NESTED = gzip.compress(b"WARC/1.1\r\nWARC-Type: response\r\n\r\n").decode("latin-1")
PAGES = [(1, "http://a/x y?q=é", "<p>one</p>"), (2, "http://b", "<p>one</p>"), (3, None, None), (4, "u", ""),
         (5, "bad\r\nurl", "\x1f\u008b\x08 magic " * 50), (6, "http://c", NESTED * 40),
         (7, "http://d", "long " * 200_000), (8, "http://d", "long " * 200_000), (9, "http://e", "tiny"),
         (9, "http://e", "tiny"), (None, "http://f", "<p>one</p>"), (None, "http://g", "only null ids"),
         (0, "http://h", "<p>one</p>"), (10, "%41", "WARC/1.1\r\nContent-Length: 3\r\n\r\nabc")]


def brute(rows, min_bytes=0):
    first = defaultdict(list)
    for i, _, h in rows:
        first[h or ""].append(i)
    out = []
    for i, u, h in rows:
        b = (h or "").encode()
        ids = [x for x in first[h or ""] if x is not None]
        again = len(b) >= min_bytes and bool(ids) and i != min(ids)
        out.append((i, u, "revisit" if again else "response", min(ids) if again else None, len(b),
                    warc.base32_sha1(b)))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(*p, "extra", 1) for p in PAGES],
                                 "page_id long, url string, html string, path string, bytes int").repartition(3)


@pytest.fixture(scope="module")
def files(spark, pages):
    return warc.write_warc(pages, new_folder(spark, "test"))


@pytest.mark.parametrize("split", [37, 1000, 4 << 20])
def test_round_trip_at_any_split(spark, files, split):
    got = sorted(map(tuple, warc.read_warc(spark, files, split).collect()), key=str)
    assert got == brute(PAGES)


def test_payloads(spark, files):
    got = [bytes(r.payload).decode() for r in warc.read_warc(spark, files, 500, True).collect()
           if r.record_type == "response"]
    assert sorted(got) == sorted((PAGES[i][2] or "") for i in range(len(PAGES))
                                 if brute(PAGES) and PAGES[i][0] not in (2, 4, 8, 1)
                                 and not (PAGES[i][0] is None and PAGES[i][2] == "<p>one</p>"))


def test_small_payloads_are_responses(pages):
    got = warc.round_trip(pages, min_bytes=5).collect()
    assert sorted(map(tuple, got), key=str) == brute(PAGES, 5)


def test_files_are_plain_gzip_members(spark, files):
    fs, name = warc.open_fs(files.first().path)
    with fs.open_input_file(name) as f:
        text = gzip.decompress(f.read())
    assert text.count(b"WARC/1.1\r\nWARC-Type") >= files.first().records


def test_broken_member_is_an_error(spark, files, tmp_path):
    fs, name = warc.open_fs(max(files.collect(), key=lambda r: r.bytes).path)
    with fs.open_input_file(name) as f:
        data = f.read()
    (tmp_path / "cut.warc.gz").write_bytes(data[:-5])
    with open(tmp_path / "cut.warc.gz", "rb") as source, pytest.raises(ValueError):
        list(warc.RangeScanner(source, 0, len(data) - 5).members())


def test_empty(spark, pages):
    assert warc.round_trip(pages.limit(0)).count() == 0
