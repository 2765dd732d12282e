"""Archives by hash that hold two entries of one hash: f9391.p and f9891.f are such names."""

from collections import Counter

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from tessera.plans import format_queries  # noqa: F401  its queries join the catalogue's
from tessera.plans.catalogue import ORACLE, QUERIES
from tessera.sources import archives

ORDERS = [(9390, 803, "O", 1.0, "5-LOW"), (9391, 803, "P", 2.0, "1-URGENT"), (9891, 803, "F", 3.0, "2-HIGH"), (9892, 803, "F", 4.0, "3-MEDIUM"), (9393, 804, "O", 5.0, "1-URGENT")]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    names = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"]
    at = tmp_path_factory.mktemp("orders")
    pq.write_table(pa.table(dict(zip(names, zip(*ORDERS, strict=True), strict=True))), at / "orders.parquet")
    return str(at)


def differs(spark, folder, name):
    con = duckdb.connect()
    con.execute(f"create view orders as select * from read_parquet('{folder}/orders.parquet')")
    df = QUERIES[name](spark, folder)
    columns = sorted(df.columns)
    mine, theirs = Counter(tuple(r) for r in df.select(*columns).collect()), Counter(con.sql(f"select {', '.join(columns)} from ({ORACLE[name]})").fetchall())
    return (mine - theirs) + (theirs - mine)


def test_mix_keeps_entries_of_one_hash():
    data = archives.encode_mix([(9, b"last"), (5, b"one"), (5, b"two")])
    found = [(e["idx"], e["crc"], data[e["offset"] : e["offset"] + e["size"]]) for e in archives.mix(data)]
    assert found == [(0, 5, b"one"), (1, 5, b"two"), (2, 9, b"last")]


def test_q44_mix_list(spark, folder):
    assert not differs(spark, folder, "q44_mix_list")


def test_q45_mix_extract(spark, folder):
    assert not differs(spark, folder, "q45_mix_extract")


def test_q76_mix_embedded_names(spark, folder):
    assert not differs(spark, folder, "q76_mix_embedded_names")


def test_own_names_of_one_hash(spark):
    """One name for two entries, two for one, two for two."""
    from pyspark.sql import functions as F

    from tessera.functions.columns import name_hash
    from tessera.plans import verbs

    crc = spark.range(1).select(name_hash(F.lit("f9391.p"))).first()[0]

    def own(entries, *names):
        return bytearray(archives.encode_mix([(crc, b"%d" % i) for i in range(entries)] + [(archives.NAMES_ENTRY, len(names).to_bytes(4, "little") + b"".join(n + b"\0\0" for n in names))]))

    a, b = b"f9391.p", b"f9891.f"
    files = spark.createDataFrame([("2, 1", own(2, a)), ("1, 2", own(1, a, b)), ("2, 2", own(2, a, b))], "path string, content binary")
    found = verbs.list_entries(files, "mix").where(F.col("crc") == crc).orderBy("path", "idx").collect()
    assert [(r["path"], r["name"]) for r in found] == [("1, 2", "f9891.f"), ("2, 1", "f9391.p"), ("2, 1", "f9391.p"), ("2, 2", "f9391.p"), ("2, 2", "f9891.f")]
