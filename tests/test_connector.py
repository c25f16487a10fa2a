"""Paged services: retries, waits, cursors, limits, and conditions that reach the requests."""

import json

import pytest
from pyspark.sql import functions as F

from lectern.sources import connector
from lectern.sources.connector import Answer, Pager

SERVICE = '''
import json, os
from lectern.sources.connector import Answer

ITEMS = [{"identifier": f"id{i}", "year": 1400 + i % 200, "query": "ab"[i % 2]} for i in range(1000)]


def fetch(request):
    with open(os.path.join(request["log"], f"{os.getpid()}.log"), "a") as f:
        f.write(json.dumps(request) + chr(10))
    found = [x for x in ITEMS if x["query"] == request["query"]]
    found = [x for x in found if request.get("from", 0) <= x["year"] <= request.get("to", 9999)]
    if "identifiers" in request:
        found = [x for x in found if x["identifier"] in request["identifiers"]]
    at = int(request.get("cursor", 0))
    return Answer(200, {"items": found[at : at + request["size"]], "next": str(at + request["size"]) if at + request["size"] < len(found) else None})
'''


def test_pager_retries_waits_and_stops():
    calls, slept = [], []

    def fetch(answers):
        def ask(request):
            calls.append(request)
            answer = answers.pop(0)
            if isinstance(answer, Exception):
                raise answer
            return answer

        return ask

    pager = lambda answers, **more: Pager(fetch(answers), sleep=slept.append, delay=2, **more)
    body = {"items": [1, 2], "next": "c"}
    assert list(pager([OSError("x"), Answer(503), Answer(200, body), Answer(200, {"items": [3]})]).items({"q": 1})) == [1, 2, 3]
    assert slept == [2, 4] and calls[-1] == {"q": 1, "start": 100, "size": 100, "cursor": "c"}
    slept.clear()
    full = [Answer(429, None, {"Retry-After": "7"}), Answer(429, None, {"Retry-After": "soon"}), Answer(200, {"items": []})]
    assert list(pager(full).items({})) == [] and slept == [7, 60]
    assert list(pager([Answer(404)]).items({})) == []
    for answers, n in (([Answer(403)], 1), ([Answer(500)] * 3, 3), ([Answer(429)] * 3, 3), ([OSError("x")] * 3, 3)):
        calls.clear()
        with pytest.raises(connector.RefusedError):
            list(pager(answers).items({}))
        assert len(calls) == n
    calls.clear()
    page = lambda a, n: Answer(200, {"items": list(range(a, a + n)), "total": 100})
    assert list(pager([page(0, 5), page(5, 5), page(10, 2)], size=5, limit=12).items({})) == list(range(12))
    assert [(c["start"], c["size"]) for c in calls] == [(0, 5), (5, 5), (10, 2)]
    holes = {"data": [{"obj": {"a": 1}}, {}, None, {"obj": None}], "recordsFiltered": 9}
    last = {"data": [{"obj": {"a": 2}}], "recordsFiltered": 9}
    got = list(pager([Answer(200, holes), Answer(200, last)], size=4, limit=2, page=connector.inscriptions_page).items({}))
    assert got == [{"a": 1}, {"a": 2}]


@pytest.fixture
def catalogue(spark, tmp_path):
    (tmp_path / "a_service.py").write_text(SERVICE)
    spark.sparkContext.addPyFile(str(tmp_path / "a_service.py"))
    connector.register(spark)
    log = tmp_path / "log"

    def load(**options):
        log.mkdir(exist_ok=True)
        for f in log.iterdir():
            f.unlink()
        options = {"fetch": "a_service:fetch", "queries": "a;b;c", "size": 50, "log": str(log)} | options
        return spark.read.format("catalogue").options(**options).load()

    def asked():
        return [json.loads(line) for f in log.iterdir() for line in f.read_text().splitlines()]

    return load, asked


def test_conditions_reach_the_requests(catalogue):
    load, asked = catalogue
    assert load().count() == 1000 and {x["query"] for x in asked()} == {"a", "b", "c"}
    got = load().where("query = 'a' and year >= 1450 and year < 1460")
    assert sorted(r["year"] for r in got.collect()) == sorted(1400 + i % 200 for i in range(0, 1000, 2) if 1450 <= 1400 + i % 200 < 1460)
    assert {(x["query"], x["from"], x["to"]) for x in asked()} == {("a", 1450, 1459)}
    got = load().where(F.col("identifier").isin("id3", "id5", "id6") & (F.col("query") == "b"))
    assert sorted(r["identifier"] for r in got.collect()) == ["id3", "id5"]
    assert [(x["query"], sorted(x["identifiers"])) for x in asked()] == [("b", ["id3", "id5", "id6"])]
    assert load().where("query = 'z'").count() == 0 and asked() == []
    assert load(years="1400-1599", slices=4).where("query = 'a' and year < 1500").count() == 250
    assert {(x["from"], x["to"]) for x in asked()} == {(1400, 1424), (1425, 1449), (1450, 1474), (1475, 1499)}
    assert load(years="1400-1599", slices=4).where("year > 1700").count() == 0 and asked() == []


def test_limit_stops_asking(catalogue):
    load, asked = catalogue
    assert load(limit=120, queries="a").count() == 120 and [x["size"] for x in asked()] == [50, 50, 20]
    assert [r["pos"] for r in load(limit=3, queries="b").collect()] == [0, 1, 2]


def test_a_refusal_fails_the_read(spark):
    requests = spark.createDataFrame([(1, "{}")], "id long, request string")
    broken = connector.fetched(requests, "id", lambda row: Pager(lambda r: Answer(500), delay=0, tries=2))
    with pytest.raises(Exception, match="RefusedError"):
        broken.collect()
    assert connector.fetched(requests.limit(0), "id", lambda row: None).count() == 0
