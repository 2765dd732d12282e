from tessera.functions.udfs import register_codecs
from tessera.sources import images
from tessera.streaming.files import sessions, tumbling_counts, watch


def test_files_arrive(spark, tmp_path):
    (tmp_path / "a.shp").write_bytes(images.encode_shp([bytes(4)], 2, 2))
    q = watch(spark, str(tmp_path), "shp", "*.shp").writeStream.format("memory").queryName("frames").start()
    q.processAllAvailable()
    (tmp_path / "b.shp").write_bytes(images.encode_shp([bytes(4), bytes(4)], 2, 2))
    q.processAllAvailable()
    q.stop()
    assert spark.table("frames").count() == 3


def test_windows(spark):
    e = spark.sql("select timestamp'2020-01-01 00:00:00' + make_interval(0,0,0,0,0,m,0) as ts, u from values (0,'a'), (1,'a'), (7,'a'), (30,'b') t(m, u)")
    assert sorted(r["n"] for r in tumbling_counts(e, "ts", ["u"]).collect()) == [1, 1, 2]
    assert sorted(r["n"] for r in sessions(e, "ts", ["u"]).collect()) == [1, 1, 2]


def test_codecs_in_sql(spark):
    register_codecs(spark)
    r = spark.sql("select cast(lcw_decompress(lcw_compress(cast('abcabcabc' as binary)), 9) as string) s, lcw_decompress(cast('x' as binary), 9) n, hex(vlq(300)) v").first()
    assert (r["s"], r["n"], r["v"]) == ("abcabcabc", None, "822C")
