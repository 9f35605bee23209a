"""WARC round trips and revisit resolution against plain Python."""

import gzip
import hashlib
import io

import pytest

from tessera.llm import warc


def want(rows):
    by: dict[bytes, list] = {}
    for i, h in rows:
        if len(h) >= 100:
            by.setdefault(h, []).append(i)
    out = []
    for i, h in rows:
        first = min((x for x in by.get(h, []) if x is not None), default=None)
        again = h in by and i != first
        out.append((i, len(h), hashlib.sha256(h).hexdigest(), "revisit" if again else "response", first if again else None))
    return sorted(out, key=repr)


def run(df):
    return sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.archive_pages(df, "2024-01-01T00:00:00Z").collect()), key=repr)


def test_fixture(spark, sf):
    p = spark.read.parquet(f"{sf}/pages.parquet")
    assert run(p) == want([(r["page_id"], (r["html"] or "").encode()) for r in p.collect()])


def test_awkward_rows(spark):
    rows = [(5, "u", "z" * 99), (6, "u", "z" * 99), (9, "a\r\nb: c", "y" * 100), (-3, None, "y" * 100), (None, "n", "y" * 100), (1, "e", ""), (2, "e", None), (2**63 - 1, "é", "\r\n\r\nWARC/1.1\r\n" * 20), (-(2**63), "é", "\r\n\r\nWARC/1.1\r\n" * 20), (8, "l", "long é" * 200_000)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "page_id long, url string, html string, digest int, file string").repartition(3)
    assert run(df) == want([(i, (h or "").encode()) for i, _, h in rows])


def test_repeated_rows(spark):
    got = run(spark.createDataFrame([(7, "u", "q" * 200)] * 4, "page_id long, url string, html string").repartition(2))
    assert sorted(r[3] for r in got) == ["response", "revisit", "revisit", "revisit"] and {r[4] for r in got} == {None, 7}


def test_no_rows(spark):
    assert run(spark.createDataFrame([], "page_id long, url string, html string")) == []


def test_small_files(spark, monkeypatch):
    monkeypatch.setattr(warc, "FILE_RECORDS", 3)
    rows = [(i, "u", f"{i % 5} " * 100) for i in range(20)]
    assert run(spark.createDataFrame(rows, "page_id long, url string, html string")) == want([(i, h.encode()) for i, _, h in rows])


@pytest.mark.parametrize("page", [None, 0, 7, -1, 2**63 - 1, -(2**63)])
def test_record_ids(page):
    assert warc._page_of(f"<{warc.record_id(page, 'a')}>") == page
    assert warc.record_id(page, "a") != warc.record_id(page, "b")


def test_members_are_standard_gzip():
    a, b = warc.gzip_member(b"x" * 70_000, 1), warc.gzip_member(b"y", 6)
    assert gzip.decompress(a + b) == b"x" * 70_000 + b"y"
    assert list(warc.members(io.BytesIO(a + b), 7)) == [b"x" * 70_000, b"y"]
    with pytest.raises(EOFError):
        list(warc.members(io.BytesIO(a[:-30])))
