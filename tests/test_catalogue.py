"""Every query of the catalogue against its SQL, on the smallest tables."""

from collections import Counter
from pathlib import Path

import duckdb
import pytest

from tessera.plans import format_queries  # noqa: F401  its queries join the catalogue's
from tessera.plans.catalogue import ORACLE, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{DATA}/{t}.parquet')")
    return con


@pytest.mark.skipif(not Path(DATA).exists(), reason="the tables are not here")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    mine = Counter(tuple(r) for r in df.select(*sorted(df.columns)).collect())
    rel = duck.sql(ORACLE[name])
    columns = sorted(rel.columns)
    assert columns == sorted(df.columns)
    quoted = ", ".join(f'"{c}"' for c in columns)
    theirs = Counter(duck.sql(f"select {quoted} from ({ORACLE[name]})").fetchall())
    assert mine == theirs


def test_entry_works_without_the_training_data_part(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 200
    assert set(QUERIES) <= set(__spark_entry__.queries())
