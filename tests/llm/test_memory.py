"""What a task takes into memory at once, and what its worker keeps of it afterwards."""

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions

from quarry.llm import common, language, neighbours, seekable, shingles


def test_token_id_batches_are_taken_one_at_a_time(monkeypatch):
    taken, released = [], []
    monkeypatch.setattr(common, "release", lambda: released.append(len(taken)))

    def batches():
        for k in range(4):
            taken.append(k)
            yield pa.RecordBatch.from_pydict({"id": [k] * (k % 2), "text": ["a"] * (k % 2)})  # every other one is empty

    rows = seekable._encoded(batches(), lambda texts: [t.encode() for t in texts], b"!")
    assert next(rows) == (1, b"a!")
    assert taken == [0, 1]
    assert list(rows) == [(3, b"a!")]
    assert released == [1, 2, 3, 4]


class Frame:
    """Stands for a DataFrame and keeps the function that a task would run."""

    def mapInArrow(self, run, _):  # noqa: N802
        self.run = run
        return self

    def select(self, *_):
        return self


def test_shingle_tasks_give_memory_back(monkeypatch):
    released = []
    monkeypatch.setattr(common, "release", lambda: released.append(1))
    batch = pa.RecordBatch.from_pydict({"doc_id": [1, 2], "row": [3, 4], "text": ["a b c d e f", None]})
    for make in (shingles._rows, shingles._sets):
        released.clear()
        assert sum(b.num_rows for b in make(Frame(), 5).run(iter([batch, batch]))) == 4
        assert len(released) == 2


def test_model_runs_give_memory_back(spark, monkeypatch):
    released, runs, real = [], [], functions.pandas_udf
    monkeypatch.setattr(common, "release", lambda: released.append(1))
    monkeypatch.setattr(functions, "pandas_udf", lambda kind: lambda run: runs.append(run) or real(kind)(run))
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    language.identify(docs, language.Kernel([language.grams("a b"), language.grams("c d")], ["x", "y"]))
    assert runs.pop()(pd.Series(["a b", None]))["lang"].tolist() == ["x", "und"]
    assert released == [1]

    class Even:
        def score(self, texts):
            return np.full(len(texts), 0.5)

    neighbours.classify(docs, Even())
    assert runs.pop()(pd.Series(["a b"] * 300)).tolist() == [0.5] * 300
    assert released == [1, 1]
