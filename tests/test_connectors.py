"""Web connectors against a server of this process, and tagged-record files against a plain parser."""

from __future__ import annotations

import csv
import json
import random
import threading
from collections import Counter
from datetime import date
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from strideline.sources import readers, web


@pytest.fixture
def server():
    """Answers by path; ``busy`` counts down the 429s that a path gives first."""
    asked, busy, answers, lock = Counter(), Counter(), {}, threading.Lock()

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            with lock:
                asked[self.path] += 1
                wait = busy[self.path] > 0
                busy[self.path] -= 1
            code, body = (429, b"") if wait else answers.get(self.path, (404, b""))
            self.send_response(code)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *args):
            pass

    http = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=http.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{http.server_port}", asked, busy, answers
    http.shutdown()


def test_documents_with_retries_and_failures(spark, server):
    base, asked, busy, answers = server
    answers |= {"/a": (200, b'{"x": 1}'), "/b": (200, b'{"x": 2}'), "/c": (500, b""), "/d": (200, b"no json"), "/e": (200, b"[1]"), "/f": (200, b'{"x": 6}')}
    busy |= {"/b": 2, "/f": 99}
    found = web.read(spark, web.Documents, base + "/{name}", [{"name": x} for x in "abcdefg"], tries=3, wait=0.01, timeout=5)
    assert found.schema.simpleString() == "struct<key:string,value:string,tries:int>" and found.rdd.getNumPartitions() == 7
    got = {r["key"]: (json.loads(r["value"]), r["tries"]) for r in found.collect()}
    assert got == {"a": ({"x": 1}, 1), "b": ({"x": 2}, 3), "c": ({}, 1), "d": ({}, 1), "e": ({}, 1), "f": ({}, 3), "g": ({}, 1)}
    assert asked["/a"] == 1 and asked["/b"] == 3 and asked["/f"] == 3
    # What failed has no events, and the rest is read.
    assert readers.feed_events(found).count() == 0


def test_weather_of_places(spark, server):
    base, asked, busy, answers = server
    daily = {"time": ["2024-01-01", "2024-01-02"], "temperature_2m_max": [50.5, None], "temperature_2m_min": [1, 2], "wind_speed_10m_max": [7, 8]}
    answers |= {"/1.5/2.5": (200, json.dumps({"daily": daily}).encode()), "/3.0/4.0": (200, b"{}")}
    busy |= {"/1.5/2.5": 1}
    keys = [{"lat": 1.5, "lon": 2.5}, {"lat": 3.0, "lon": 4.0}, {"lat": 5.0, "lon": 6.0}]
    rows = web.read(spark, web.Weather, base + "/{lat}/{lon}", keys, tries=4, wait=0.01, timeout=5).collect()
    assert sorted(tuple(r) for r in rows) == [(1.5, 2.5, date(2024, 1, 1), 50.5, 1.0, 7.0, None, 2), (1.5, 2.5, date(2024, 1, 2), None, 2.0, 8.0, None, 2)]
    assert web.read(spark, web.Weather, "http://127.0.0.1:9/{lat}", keys, tries=2, wait=0.01, timeout=1).count() == 0


def test_back_off_doubles(monkeypatch, server):
    base, asked, busy, answers = server
    waits = []
    monkeypatch.setattr(web.time, "sleep", waits.append)
    busy |= {"/x": 9}
    assert web.fetched(base + "/x", tries=5, wait=2.0) == ({}, 5) and waits == [2.0, 4.0, 8.0, 16.0]


def plain(text: str) -> tuple[dict, list]:
    """Starters and appearances by record, line by line."""
    games, came, now = {}, [], None
    for line in csv.reader(text.splitlines()):
        if not line:
            continue
        if line[0] == "id":
            now = games.setdefault(line[1], {"home": None, "away": None, "er": {}})
            record = line[1]
        elif now is None:
            continue
        elif line[0] in ("start", "sub") and line[5] == "1":
            side = "home" if line[3] == "1" else "away"
            came.append((record, line[1], side == "home", line[0] == "start"))
            if line[0] == "start":
                now[side] = line[1]
        elif line[:2] == ["data", "er"]:
            now["er"][line[2]] = float(line[3])
    return games, came


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_files_are_split_at_records(spark, tmp_path, end):
    """A file of several splits, with lines before the first record, quoted commas, blank lines and repeated keys."""
    rng = random.Random(2)
    out = ["com,\"made by hand, not by machine\"", "version,2"]
    for i in range(400):
        out += [f"id,G{i:05d}", "version,2", f"info,site,P{i % 7}", "info,site,last", "com,id is no tag here", ""]
        for side in (0, 1):
            out.append(f'start,s{i}{side},"Doe, J. ""Jay""",{side},9,1')
            out += [f'start,b{i}{side}{k},"B, {k}",{side},{k},{k}' for k in range(2, 6)]
            out += [f'sub,r{i}{side}{k},"Relief",{side},0,{rng.choice([1, 1, 4])}' for k in range(rng.randrange(4))]
            out += [f"data,er,s{i}{side},9", f"data,er,s{i}{side},{rng.randrange(8)}"] if i % 5 else []
    text = end.join(out) + end
    (tmp_path / "a.EVA").write_bytes(text.encode())
    (tmp_path / "b.EVA").write_bytes(f"id,ONLY{end}start,x,\"X\",1,9,1".encode())
    (tmp_path / "empty.EVA").write_bytes(b"")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        records = readers.tagged_records(spark, str(tmp_path))
        assert records.rdd.getNumPartitions() > 5
        got = {r["record_id"]: r for r in readers.starters(records).collect()}
        came = Counter((r["record_id"], r["pitcher"], r["is_home"], r["is_start"]) for r in readers.appearances(records).collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    games, want = plain(text)
    assert came == Counter([*want, ("ONLY", "x", True, True)])
    assert len(got) == 401 and got["ONLY"]["home_starter"] == "x" and got["ONLY"]["home_er"] is None and got["ONLY"]["info"] == {}
    for k, g in games.items():
        assert (got[k]["home_starter"], got[k]["away_starter"], got[k]["info"]) == (g["home"], g["away"], {"site": "last"})
        assert (got[k]["home_er"], got[k]["away_er"]) == (g["er"].get(g["home"]), g["er"].get(g["away"]))
