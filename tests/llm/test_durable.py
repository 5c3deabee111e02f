"""Tables in the shared folder, and the ways above the bounds of broadcasts."""

import random
from types import SimpleNamespace

import pytest

from quillspark.llm import durable, line_dedup, minhash


def test_a_cluster_needs_a_shared_folder():
    conf = SimpleNamespace(get=lambda key, other: None)
    with pytest.raises(ValueError):
        durable.shared_dir(SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="spark://host:7077")))
    named = SimpleNamespace(get=lambda key, other: "hdfs:///shared/")
    assert durable.shared_dir(SimpleNamespace(conf=named)) == "hdfs:///shared"


def test_sweep_removes_what_was_made_since(spark):
    mark = durable.made()
    first, second, third = (durable.durable(spark.range(n), "swept") for n in (1, 2, 3))
    durable.sweep(spark, mark, keep=1)
    assert durable.made() == mark + 1 and third.count() == 3
    with pytest.raises(Exception):  # noqa: B017
        first.count()
    durable.sweep(spark, mark)
    assert durable.made() == mark


def test_results_do_not_depend_on_broadcasts(spark, monkeypatch):
    rng = random.Random(7)
    words = [f"w{k}" for k in range(60)]
    base = [" ".join(rng.choice(words) for _ in range(30)) for _ in range(12)]
    near = [" ".join(w if rng.random() > 0.04 else "z" for w in b.split()) for b in base]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(base + near + base[:3])], "doc_id long, text string").repartition(3)

    def results():
        lines = line_dedup.drop_repeated_lines(docs).collect()
        groups = minhash.near_duplicates(docs, 2).collect()
        return sorted(map(tuple, lines)), sorted(map(tuple, groups)), sorted(map(tuple, minhash.drop_near_duplicates(docs, 2).collect()))

    want = results()
    assert len(want[0]) < len(base + near)
    for module in (line_dedup, minhash):
        monkeypatch.setattr(module, "light", lambda df, rows, most=0: df)
    assert results() == want
