"""Operator 2: exact round trip, split ranges, damaged archives, odd rows."""
import gzip
import os
import random

import duckdb
import pytest

from duelframe.llm import queries as Q
from duelframe.llm import warc as W
from llm_helpers import llm  # noqa: F401

SF01 = "/root/testdata/sf0.01"
SCHEMA = "page_id long, url string, html string"


def path_of(uri):
    return uri[len("file:"):] if uri.startswith("file:") else uri


@pytest.mark.parametrize("split", [100, 777, 1 << 20])
def test_round_trip_at_any_split(llm, split):
    rnd = random.Random(split)
    pages = [(i, f"http://h/{i}?é", "".join(rnd.choice("abcé日<>\r\n\0") for _ in range(rnd.choice([0, 5, 3000])))) for i in range(60)]
    manifest = W.write(llm.createDataFrame(pages, SCHEMA), revisit_bytes=1 << 30)
    rows = {r["id"]: r for r in W.read(manifest, split).collect()}
    assert len(rows) == 60
    for i, url, html in pages:
        assert bytes(rows[i]["payload"]) == html.encode() and rows[i]["record_type"] == "response"
        assert rows[i]["payload_digest"] == W.payload_digest(html.encode())
    for f in manifest.collect():                       # plain gzip reads the whole archive
        with gzip.open(path_of(f["path"])) as g:
            assert g.read().count(b"WARC/1.1\r\n") == f["records"]


def test_magic_inside_a_member_is_no_record(llm, tmp_path):
    """Stored blocks that hold the magic, and bytes of junk before the first member."""
    fake = b"\x1f\x8b\x08\x00 not a member"
    records = [W.record(i, None, fake * 50) for i in range(5)]
    path = tmp_path / "a.warc.gz"
    path.write_bytes(fake + b"".join(W.member(r, 0) for r in records))
    manifest = llm.createDataFrame([(str(path), os.path.getsize(path))], "path string, bytes long")
    for split in (50, 333, 1 << 20):
        assert sorted(r["id"] for r in W.read(manifest, split).collect()) == [0, 1, 2, 3, 4]


def test_damage_is_an_error(llm, tmp_path):
    whole = W.member(W.record(1, "u", os.urandom(200_000)))
    path = tmp_path / "cut.warc.gz"
    path.write_bytes(whole[:150_000])
    manifest = llm.createDataFrame([(str(path), 150_000)], "path string, bytes long")
    with pytest.raises(Exception, match="damaged record"):
        W.read(manifest).count()


@pytest.mark.parametrize("split", [5000, 30_000, 1 << 20])
def test_long_records_of_few_bytes(llm, split):
    """Pages and a URL that inflate to several MB from one block of 64 KB."""
    rnd = random.Random(1)
    passage = "".join(rnd.choice("abcdefgh <>") for _ in range(3000))
    pages = [(1, "u", "<li>one line of a template</li>\n" * 80_000), (2, "u", passage * 900), (3, "v", "x" * 5_000_000),
             (4, "http://h/" + "é" * 500_000, "short"), (5, "w", "x" * 5_000_000), (6, "w", "end")]
    got = {r["id"]: r for r in W.read(W.write(llm.createDataFrame(pages, SCHEMA).coalesce(1)), split).collect()}
    assert [(i, got[i]["payload_bytes"]) for i in sorted(got)] == [(i, len(html)) for i, _, html in pages]
    assert (got[5]["record_type"], got[5]["refers_to"]) == ("revisit", 3)
    assert all(bytes(got[i]["payload"]).decode() == html for i, _, html in pages if i != 5)


def test_damage_near_a_start_is_an_error(llm, tmp_path):
    """In the first block, in the header, and where only the manifest's count tells."""
    rnd = random.Random(2)
    first, last = (W.member(W.record(i, "u", rnd.randbytes(9000))) for i in (1, 3))
    whole = W.member(W.record(2, "u", rnd.randbytes(9000)))
    no_length = W.member(b"WARC/1.1\r\nWARC-Type: response\r\n\r\nbody")
    endless = W.member(b"WARC/1.1\r\nWARC-Type: " + b"x" * 3_000_000)
    torn = whole[:5000] + bytes(b ^ 255 for b in whole[5000:])
    unknown = b"\0" * 12 + whole[12:]
    for k, (middle, error) in enumerate([(torn, "damaged record"), (no_length, "damaged record"), (endless, "damaged record"),
                                         (unknown, "has 2 records, the manifest 3")]):
        path = tmp_path / f"{k}.warc.gz"
        path.write_bytes(first + middle + last)
        manifest = llm.createDataFrame([(str(path), os.path.getsize(path), 3)], "path string, bytes long, records long")
        with pytest.raises(Exception, match=error):
            W.read(manifest).count()


def test_revisits_and_odd_rows(llm):
    pages = [(5, "u", "same"), (3, None, "same"), (9, "v", "same"), (3, None, "same"), (1, "w", None), (2, "w", ""), (None, None, "same"),
             (None, "n", "lone"), (None, "n", "lone"), (7, "x", "é" * 300_000), (8, None, "short")]
    df = llm.createDataFrame([(*p, "m", "m", "m") for p in pages], SCHEMA + ", id string, key string, payload string")
    rows = sorted(((r["id"], r["record_type"], r["refers_to"], r["payload_bytes"]) for r in W.read(W.write(df)).collect()), key=repr)
    assert rows == sorted([(5, "revisit", 3, 4), (3, "response", None, 4), (9, "revisit", 3, 4), (3, "response", None, 4),
                           (1, "response", None, 0), (2, "revisit", 1, 0), (None, "revisit", 3, 4), (None, "response", None, 4),
                           (None, "response", None, 4), (7, "response", None, 600_000), (8, "response", None, 5)], key=repr)
    assert W.read(W.write(df.where("false"))).count() == 0
    long_only = {r["id"]: r["record_type"] for r in W.read(W.write(df.where("html = 'same'"), revisit_bytes=5)).collect()}
    assert set(long_only.values()) == {"response"}


def test_query_equals_sql(llm):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{SF01}/pages.parquet')")
    columns = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    got = sorted(tuple(r[c] for c in columns) for r in Q.op2_warc(llm, SF01).collect())
    assert got == sorted(con.sql(Q.OP2_SQL).fetchall())
