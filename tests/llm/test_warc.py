import gzip
import io
import random

import duckdb
import pytest

from framewright.llm import warc as W

HTML = ["<p>one</p>", "<p>zwei ß</p>", "", None, "<p>one</p>", "x" * 300_000, "\x1f\x8b not gzip", "<p>one</p>", "", "\r\n\r\n", "é" * 1000]
ROWS = [(i, f"http://h/{i}", h, "clash") for i, h in enumerate(HTML)] + [(20, None, "<p>one</p>", None), (None, "http://n", "alone", None), (None, "http://n", "<p>one</p>", None)]
SCHEMA = "page_id long, url string, html string, payload_digest string"


def expected(rows):
    out = []
    for k, _, h, _ in rows:
        same = [r[0] for r in rows if (r[2] or "") == (h or "")]
        first = min((x for x in same if x is not None), default=None) if len(same) > 1 else None
        revisit = first is not None and k != first
        raw = (h or "").encode()
        out.append((k, len(raw), W.digest32(raw), "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r[:5]) for r in df.collect()), key=str)


def test_round_trip(spark, tmp_path):
    df = spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    assert got(W.round_trip(df, f"file://{tmp_path}/a")) == expected(ROWS)


def test_empty_table_and_repeated_rows(spark, tmp_path):
    df = spark.createDataFrame(ROWS, SCHEMA)
    assert got(W.round_trip(df.limit(0), f"file://{tmp_path}/e")) == []
    twice = [(5, "u", "same", None), (5, "u", "same", None), (6, "u", "same", None)]
    assert [r[3] for r in got(W.round_trip(spark.createDataFrame(twice, SCHEMA), f"file://{tmp_path}/t"))] == ["response", "response", "revisit"]


@pytest.mark.parametrize("size", [1, 7, 100, 5000])
def test_any_ranges_give_each_record_once(size, monkeypatch):
    monkeypatch.setattr(W, "READ_BYTES", 64)
    rng = random.Random(size)
    blocks = [bytes(rng.randrange(256) for _ in range(rng.randrange(400))) + W.MAGIC * 3 for _ in range(12)]
    members = [W.record([("WARC-Type", "resource"), ("WARC-Record-ID", str(i))], b) for i, b in enumerate(blocks)]
    file = b"junk\x1f\x8b\x08junk" + b"".join(members[:6]) + gzip.compress(b"no record") + b"".join(members[6:])
    found = []
    for start in range(0, len(file), size):
        for at, raw in W.scan(io.BytesIO(file), start, min(start + size, len(file))):
            fields, block = W.parse(raw)
            found.append((int(fields["warc-record-id"]), block))
    assert found == list(enumerate(blocks))


def test_members_are_gzip_and_cut_files_lose_only_their_last_record():
    members = [W.record([("WARC-Record-ID", str(i))], b"body") for i in range(3)]
    assert gzip.decompress(members[0]).startswith(b"WARC/1.1\r\n")
    file = b"".join(members)[:-5]
    assert len(list(W.scan(io.BytesIO(file), 0, len(file)))) == 2


def test_small_payloads_are_not_revisited(spark, tmp_path):
    df = spark.createDataFrame(ROWS, SCHEMA)
    r = W.round_trip(df, f"file://{tmp_path}/m", min_bytes=11).collect()
    assert {x.record_type for x in r} == {"response"}


def test_sql_agrees(spark, tmp_path):
    rows = [r for r in ROWS if r[0] is not None]
    con = duckdb.connect()
    con.execute("create table pages (page_id bigint, url varchar, html varchar)")
    con.executemany("insert into pages values (?, ?, ?)", [r[:3] for r in rows])
    assert sorted(con.execute(W.OP8_SQL).fetchall(), key=str) == expected(rows)
