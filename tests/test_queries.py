"""Every registered core query against its SQL on the smallest tables, and the shape of the registry."""

from pathlib import Path

import duckdb
import pandas as pd
import pytest

from evidex import plans

FOLDER = Path("/root/testdata/sf0.001")
#: Queries whose result may be empty on the smallest tables.
MAY_BE_EMPTY = {"doi_matches", "title_dupes", "contradictions", "contradictions_titles", "run_alerts", "quality_gate", "context_prefix", "chunk_exists"}

pytestmark = pytest.mark.skipif(not FOLDER.exists(), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in FOLDER.glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    return con


def _rows(df):
    def cell(v):
        if pd.isna(v):
            return None
        if isinstance(v, float):
            return round(v, 6)
        return int(v) if isinstance(v, bool) or hasattr(v, "__index__") else str(v) if not isinstance(v, (int, str)) else v

    df = df[sorted(df.columns)].astype(object)
    return sorted((tuple(cell(v) for v in r) for r in df.itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(plans.registry()))
def test_query_equals_sql(spark, duck, name):
    query, sql = plans.registry()[name]
    got = query(spark, str(FOLDER)).toPandas()
    assert len(got) or name in MAY_BE_EMPTY
    if sql:
        want = duck.execute(sql).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert _rows(got) == _rows(want)


def test_core_stands_without_the_subpackage():
    import re

    root = Path(plans.__file__).parents[1]
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert not re.search(r"evidex\.llm", p.read_text()), p
