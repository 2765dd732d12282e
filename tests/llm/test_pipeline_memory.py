"""What the pipeline's workers keep from one stage for the next."""

import pyarrow as pa

import corpus_pipeline
from tessera.llm.packing import pack_documents
from tessera.llm.queries import tokenizer
from tessera.session import MEMORY, TIGHT, ship


def held(spark):
    """Pieces that each worker's memos hold."""

    def look(batches):
        from tessera.llm import tokens

        for _ in batches:
            yield pa.RecordBatch.from_arrays([pa.array([sum(len(m.pieces) + len(m.pieces.before) for m in tokens._memos.values())], pa.int64())], names=["n"])

    return [r["n"] for r in spark.range(0, 16, 1, 16).mapInArrow(look, "n long").collect()]


def test_packing_keeps_a_bounded_memo(spark, monkeypatch):
    ship(spark)
    docs = spark.createDataFrame([(i, " ".join(f"w{i}x{k}" for k in range(100))) for i in range(80)], "doc_id long, text string").repartition(4)
    all_pieces = {tuple(r) for r in pack_documents(spark, docs, tokenizer("word_bpe_49k.json"), 1).select("doc_id", "doc_tokens", "length", "ids_crc32").collect()}
    monkeypatch.setattr(corpus_pipeline, "MEMO", 50)
    few = {tuple(r) for r in corpus_pipeline.packing(spark, docs, "").select("doc_id", "doc_tokens", "length", "ids_crc32").collect()}
    assert {x[:2] for x in few} == {x[:2] for x in all_pieces}
    assert 0 < max(held(spark)) and min(x for x in held(spark) if x) <= 100


def test_ship_takes_the_callers_memory():
    class Conf(dict):
        def set(self, k, v):
            self[k] = v

    class Session:
        conf = Conf({"spark.sql.execution.arrow.maxRecordsPerBatch": "10000"})

    for memory in (MEMORY, TIGHT):
        s = Session()
        s.sparkContext = type("C", (), {"environment": {}})()
        ship(s, memory)
        assert {k: v for k, v in s.sparkContext.environment.items() if k != "PYTHONPATH"} == memory
