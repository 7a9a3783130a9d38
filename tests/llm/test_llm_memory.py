"""Workers that the pipeline's stages share give the memory of a task back at its end."""

from types import SimpleNamespace

import pyarrow as pa

from pitchflow.llm import common, decontaminate, quality, token_shards


def test_workers_give_their_memory_back(spark, monkeypatch):
    given = []
    pool = SimpleNamespace(release_unused=lambda: given.append(1))
    monkeypatch.setattr(common.pa, "default_memory_pool", lambda: pool)
    texts = [pa.array(["some words of a text", None])]
    assert [len(a) for a in quality._scorer(quality.AttentionModel()).func(iter(texts))] == [2]
    assert len(given) == 1
    items = SimpleNamespace(value=[("i", "one two three four five six seven eight nine ten")])
    assert [a.to_pylist() for a in decontaminate._is_hit(("digest", items)).func(iter(texts))] == [[False, False]]
    assert len(given) == 2


def test_small_tables_of_the_driver_start_no_workers(spark):
    schema = pa.schema({"a": pa.int64(), "b": pa.string()})
    some = common.arrow_table(spark, [(1, "x"), (2, None)], schema)
    assert sorted(map(tuple, some.collect())) == [(1, "x"), (2, None)]
    assert "PythonRDD" not in some._jdf.queryExecution().toRdd().toDebugString()
    assert common.arrow_table(spark, [], schema).collect() == []


def test_an_encoder_goes_when_shards_are_read():
    token_shards._ENCODERS["some"] = object()
    list(token_shards._read(iter([]), 512, {}, 0, True))
    assert not token_shards._ENCODERS
