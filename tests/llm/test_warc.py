from __future__ import annotations

import base64
import hashlib

import numpy as np
import pytest

from quarry.llm import warc

SCHEMA = "page_id long, url string, html string, digest string, file int"


def sha(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


@pytest.fixture
def split_small(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def rows():
    inner = "WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    html = ["<p>a</p>", None, "", "x" * 3000, "<p>a</p>", "before " + inner + "WARC/1.0\r\nrest", "WARC/1.0\r\n", inner * 30, "é日\r\n\r\n", "<p>a</p>", "\n", "end\r\n\r\n"]
    html += [f"page {k} " * (k % 90) + ("WARC/1.0\r\n" if k % 7 == 0 else "") for k in range(200)]
    return [(k * 3 % 1009, None if k == 2 else f"http://h/{k}\r\nX: y", h, "d", 1) for k, h in enumerate(html)]


@pytest.mark.parametrize("least", [0, 20])
def test_round_trip_against_brute_force(spark, split_small, least):
    data = rows()
    first = {}
    for page, _, html, _, _ in data:
        first[html or ""] = min(page, first.get(html or "", page))
    want = set()
    for page, _, html, _, _ in data:
        size = len((html or "").encode())
        lead = first[html or ""] if size >= least else page
        want.add((page, size, sha(html), "response" if lead == page else "revisit", None if lead == page else lead))
    found = [tuple(r) for r in warc.round_trip(spark.createDataFrame(data, SCHEMA).repartition(3), least).collect()]
    assert len(found) == len(data)
    assert set(found) == want


def test_payloads_come_back_whole(spark, split_small, tmp_path):
    data = rows()
    path = f"file://{tmp_path}/w"
    roles = warc.with_roles(spark.createDataFrame(data, SCHEMA).repartition(2))
    warc.write_archives(roles, path)
    got = {r["record_id"]: (bytes(r["payload"]), r["uri"]) for r in warc.read_archives(spark, path, payload=True).where("record_type = 'response'").collect()}
    for page, url, html, _, _ in data:
        if (name := f"<urn:page:{page}>") in got:
            assert got[name] == ((html or "").encode(), url and url.replace("\r", "%0D").replace("\n", "%0A"))


def test_null_ids_repeats_and_empty(spark):
    data = [(None, "u", "same", "", 1), (4, "u", "same", "", 1), (4, "u", "same", "", 1), (None, None, None, "", 1)]
    found = [tuple(r)[0:1] + tuple(r)[3:] for r in warc.round_trip(spark.createDataFrame(data, SCHEMA)).collect()]
    assert sorted(found, key=str) == sorted([(None, "revisit", 4), (4, "response", None), (4, "response", None), (None, "response", None)], key=str)
    assert warc.round_trip(spark.createDataFrame([], SCHEMA)).count() == 0


def test_chain_rejects_what_it_does_not_reach():
    offsets = np.array([0, 10, 15, 30, 40])
    ends = np.array([10, 30, 99, 50, 50])
    assert warc.reached(offsets, ends).tolist() == [True, True, False, True, False]
    assert warc.reached(offsets[1:], ends[1:]).tolist() == [False] * 4
