"""Query operators over the titles of a table, against the SQL of the short list with that one relation replaced."""

from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from evidex import plans
from evidex.plans import checking, retrieval
from test_queries import FOLDER, _rows

pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test tables here")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Records of ASCII alone, for which the SQL holds; with ids times ten, every fifth is a question."""
    at = tmp_path_factory.mktemp("ascii")
    rows = spark.read.parquet(f"{FOLDER}/doc_records.parquet")
    rows.where(~F.concat_ws(" ", "title", "content").rlike(r"[^\x00-\x7F]")).withColumn("record_id", F.col("record_id") * 10).coalesce(1).write.parquet(f"{at}/doc_records.parquet")
    return at


@pytest.mark.parametrize("name", [*retrieval.ROW_WISE, *checking.ROW_WISE, *retrieval.SEARCHES, *checking.SEARCHES])
def test_titles_equal_sql(spark, folder, name):
    row_wise = name in retrieval.ROW_WISE + checking.ROW_WISE
    con = duckdb.connect()
    con.execute(f"create view doc_records as select * from '{folder}/doc_records.parquet/*.parquet'")
    sql = plans.registry()[name][1].replace(retrieval._Q, retrieval.TITLES if row_wise else retrieval.SEARCHED_TITLES)
    got = plans.registry()[f"{name}_titles"][0](spark, str(folder)).toPandas()
    assert _rows(got) == _rows(con.execute(sql).df())
    if name in ("query_intent", "route", "decompose", "sparse_topk", "rerank_topk", "verdict"):
        every = spark.read.parquet(f"{folder}/doc_records.parquet").where("true" if row_wise else "record_id % 50 = 0").count()
        assert 1 < got["query_id"].nunique() <= every and (not row_wise or got["query_id"].nunique() == every)
