import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tricolor.llm import toxicity
from tricolor.llm.common import BATCH_BYTES, lean, ship


def resident_mb():
    with open("/proc/self/status") as f:
        return next(int(x.split()[1]) for x in f if x.startswith("RssAnon")) / 1024


def test_a_worker_keeps_nothing_of_an_ended_partition():
    pins = []

    def many_arrays(batches):
        for b in batches:
            held = [np.ones(12_000) for _ in range(2_000)]  # 192 MB in pieces too small for maps of their own
            pins.append(np.ones(12_000))                    # what still lives lies behind them
            yield b.slice(0, len(held) and 1)

    one = pa.RecordBatch.from_pydict({"n": [1]})
    before = resident_mb()
    assert [b.num_rows for b in lean(many_arrays)(iter([one]))] == [1]
    assert resident_mb() - before < 60


def test_batches_of_long_texts_are_bounded(spark):
    ship(spark)

    def count(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": [b.num_rows]})

    texts = spark.range(0, 40, 1, 1).select(F.repeat(F.lit("x"), 1 << 20).alias("text"))
    n = [r["n"] for r in texts.mapInArrow(count, "n long").collect()]
    assert sum(n) == 40 and max(n) <= (BATCH_BYTES >> 20) + 1


def test_features_without_holders_need_no_memory(monkeypatch):
    rng = np.random.default_rng(5)
    pos, unl = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
    at = rng.choice(1 << 16, 900, replace=False)
    pos[at], unl[at] = rng.integers(0, 40, 900), rng.integers(0, 90, 900)
    a, b = (pos + 0.5) / 41, (unl + 0.5) / 91
    z = np.abs((a - b) / np.sqrt(a * (1 - a) / 40 + b * (1 - b) / 90))
    expected = np.sort(np.argsort(-z, kind="stable")[:64])
    widths = []
    sqrt = np.sqrt
    monkeypatch.setattr(toxicity.np, "sqrt", lambda x: (widths.append(len(x)), sqrt(x))[1])
    got = toxicity.choose_features(pos, unl, 40, 90, 64)
    assert got.tolist() == expected[z[expected] >= 3].tolist() and max(widths) <= 900
