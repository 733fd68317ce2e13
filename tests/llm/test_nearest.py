import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tessera.llm.nearest import nearest_in_time

T = dt.datetime(2026, 1, 5)
KEYS = ["code"]


def _run(spark, probes, records, **kw):
    p = spark.createDataFrame(probes, "pid bigint, code string, t timestamp_ntz, tol int, rid string, bucket int")
    r = spark.createDataFrame(records, "rid bigint, code string, t timestamp_ntz, pid string, gap int")
    out = nearest_in_time(p, r, probe_id="pid", probe_time="t", tolerance_ms="tol", record_id="rid", record_time="t", keys=[(F.col(k), F.col(k)) for k in KEYS], **kw)
    return {x["probe_id"]: x["record_id"] for x in out.collect()}


@pytest.mark.parametrize("hot", [1_000_000, 20])
def test_against_brute_force(spark, hot):
    g = random.Random(1)
    at = lambda: T + dt.timedelta(milliseconds=g.randrange(20_000) // 50 * 50)
    records = [(i, g.choice(["a", "a", "a", "b", None]), at() if g.random() < 0.97 else None, "x", 1) for i in range(600)]
    probes = [(i, g.choice(["a", "b", "c", None]), at() if g.random() < 0.97 else None, g.choice([0, 25, 100, 2000, None, -5]), "x", 1) for i in range(150)]
    want = {}
    for pid, code, t, tol, *_ in probes:
        near = [(abs(u - t), rid) for rid, c, u, *_ in records if code and c == code and t and u and tol is not None and abs(u - t) <= dt.timedelta(milliseconds=tol)]
        if near:
            want[pid] = min(near)[1]
    assert _run(spark, probes, records, hot_rows=hot) == want and want


def test_ties_edges_and_empty_tables(spark):
    s = lambda x: T + dt.timedelta(seconds=x)
    records = [(5, "a", s(9), "", 0), (3, "a", s(11), "", 0), (4, "a", s(11), "", 0), (9, "a", s(20), "", 0), (8, "a", s(20), "", 0)]
    assert _run(spark, [(1, "a", s(10), 1000, "", 0), (2, "a", s(20), 0, "", 0), (3, "a", s(15), 3999, "", 0), (4, "a", s(15), 4000, "", 0)], records) == {1: 3, 2: 8, 4: 3}
    assert _run(spark, [], records) == {} and _run(spark, [(1, "a", s(10), 1000, "", 0)], []) == {}
