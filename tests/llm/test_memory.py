"""What an executor's Python workers hold: bounded while a task runs, given back at its end."""

import tracemalloc

import numpy as np
import psutil
import pytest

from tidegauge.llm import packing, toxicity
from tidegauge.llm.common import sampled

BAD = ["stupid", "idiot", "worthless", "moron"]


def texts(n, seed):
    rng = np.random.default_rng(seed)
    rows = []
    for _ in range(n):
        w = ["".join(map(chr, rng.integers(97, 123, 9))) for _ in range(250)]
        w[3:5] = BAD[rng.integers(4)], "plain"
        rows.append(" ".join(w))
    return rows


def test_scoring_remembers_a_bounded_number_of_words():
    rows = texts(1200, 1)  # 300,000 different words
    tracemalloc.start()
    machine = toxicity.Machine(BAD * 40)
    machine.pooled(rows)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60e6
    machine.forget()
    assert not [k for k in vars(machine) if k.startswith("_")]


@pytest.mark.parametrize("words", [0, 60, 10**9])
def test_forgotten_words_score_the_same(words, monkeypatch):
    rows = [None, "", "i d i o t", "plain " * 3000 + "stup-id" * 9] + texts(40, 2) * 2
    want = np.concatenate([toxicity.Machine(BAD).pooled([t]) for t in rows])
    monkeypatch.setattr(toxicity, "KNOWN_WORDS", words)
    monkeypatch.setattr(toxicity, "PART", 7)
    machine = toxicity.Machine(BAD)
    assert np.array_equal(np.concatenate([machine.pooled(rows[i : i + 6]) for i in range(0, len(rows), 6)]), want)
    assert words > 60 or len(machine._known) + len(machine._older) < 2 * (words + 6 * 260)


def test_compact_table_is_the_dense_one():
    words = BAD + ["a", "überaus", "x" * 60, "stupid"] * 9
    slots, table = toxicity.compact(words)
    assert np.array_equal(table[slots], toxicity.dense(words).T) and not table[0].any()


def test_sampling_starts_no_python_workers(spark):
    rows = spark.range(3000).selectExpr("id AS doc_id", "CASE WHEN id % 7 < 3 THEN 'en' WHEN id % 7 < 6 THEN 'de' END AS lang")

    def workers():
        return {p.pid for p in psutil.Process().children(recursive=True) if "pyspark" in " ".join(p.cmdline()) and "python" in p.name()}

    before = workers()
    got = sampled(rows.where("lang IS NOT NULL"), "lang", 100, 1).groupBy("lang").count().collect()
    assert {r["lang"]: 60 < r["count"] < 140 for r in got} == {"en": True, "de": True}
    assert not workers() - before


def test_packing_gives_memory_back(monkeypatch):
    import pyarrow as pa

    from tidegauge.llm.queries import vocabulary

    calls = []
    monkeypatch.setattr(packing, "give_back", lambda: calls.append(1), raising=False)
    monkeypatch.setattr(packing, "TaskContext", type("T", (), {"get": staticmethod(lambda: type("C", (), {"partitionId": lambda self: 0})())}))
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array(["one two", None])], names=["doc_id", "text"])
    assert sum(b.num_rows for b in packing._pieces(vocabulary(), 2048)(iter([batch]))) == 2
    assert calls
