"""The queries of the subpackage against their SQL, and what they promise where SQL cannot say it."""

import oracle
import pytest
from pyspark.sql import functions as F

from tessera.llm import queries

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle.connect(FOLDER)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_its_sql(spark, con, name):
    assert oracle.differences(queries.QUERIES[name](spark, FOLDER), con, queries.SQL[name]) == []


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_query_without_sql_runs(spark, name):
    assert queries.QUERIES[name](spark, FOLDER).collect() is not None


def test_packing_uses_nearly_all_room(spark):
    assert queries.p7_fill(spark, FOLDER).agg(F.min("filled")).first()[0] > 0.9


def test_mixes_meet_their_shares(spark):
    off = queries.p8_shares(spark, FOLDER).where("documents > 3").withColumn("off", F.abs(F.col("actual_share") - F.col("target_share")))
    assert off.agg(F.max("off")).first()[0] < 0.1
    assert queries.p8_shares(spark, FOLDER).where("most_uses > max_repeats").count() == 0
