"""Splitters against exact ones, the driver's work, and columns that clash."""

import time

import numpy as np
import pytest

from tricolor.llm import sharding as sh


def counter(key, uid, size):
    order = np.lexsort((uid, key))
    key, uid, below = key[order], uid[order], np.concatenate([[0], np.cumsum(size[order])])

    def at(points):
        """Rows before each point."""
        pk, pu = sh._columns(points)
        lo, hi = np.searchsorted(key, pk, "left"), np.searchsorted(key, pk, "right")
        return np.array([a + np.searchsorted(uid[a:b], u, "left") for a, b, u in zip(lo, hi, pu)], np.int64)

    def count(probes):
        i = np.concatenate([[0], at(probes), [len(key)]])
        return np.diff(below[i]), np.diff(i)
    return at, count, below


@pytest.mark.parametrize("case", ["plain", "one key", "hot key", "sparse keys", "long rows"])
def test_points_equal_the_exact_nearest(case):
    g = np.random.default_rng(3)
    n = 4000
    key = {"plain": g.permutation(n), "one key": np.zeros(n, np.int64), "hot key": np.where(g.random(n) < 0.4, 7, g.integers(0, 900, n)),
           "sparse keys": g.integers(-(1 << 62), 1 << 62, n), "long rows": g.permutation(n)}[case].astype(np.int64)
    uid = (np.arange(n) % 8 << 33) + np.arange(n) // 8
    size = g.integers(1, 50, n) if case != "long rows" else np.where(g.random(n) < 0.01, 20_000, 3)
    at, count, below = counter(key, uid, size)
    total = int(size.sum())
    want = [total * i // 16 for i in range(1, 16)]
    end = (int(key.max()) + 1, sh._LEAST)
    points, rounds = sh.refine(count, (int(key.min()), sh._LEAST), end, total, n, int(uid.max()), want, [0] * 15)
    for w, got in zip(want, below[at(points)]):
        assert abs(int(got) - w) == np.abs(below - w).min()
    assert rounds <= (64 + 37) / np.log2(sh.PROBES + 1) + 4


def test_thirty_thousand_ranges_are_planned_in_seconds():
    g = np.random.default_rng(4)
    n = 400_000
    key, uid = np.sort(g.integers(0, 1 << 50, n)), np.arange(n)
    size = np.minimum((g.pareto(1.3, n) * 50 + 1).astype(np.int64), 20_000)
    at, count, below = counter(key, uid, size)
    total, shards, each = int(size.sum()), 16, 1900
    parts = shards * each
    want = [total * i // parts for i in range(1, parts)]
    tolerance = [max(1, total // parts // 4) if i % each else max(1, total // shards // 1000) for i in range(1, parts)]
    spent, seen = [0.0], [0]

    def timed(probes):
        t = time.time()
        out = count(probes)
        spent[0] += time.time() - t
        seen[0] = max(seen[0], len(probes))
        return out
    t = time.time()
    points, rounds = sh.refine(timed, (int(key[0]), sh._LEAST), (int(key[-1]) + 1, sh._LEAST), total, n, n - 1, want, tolerance)
    assert time.time() - t - spent[0] < 20 and rounds < 30 and seen[0] <= 2 * sh.MOST_PROBES
    off = np.abs(below[at(points)] - np.array(want))
    nearest = np.abs(below[np.clip(np.searchsorted(below, want), 1, n)] - np.array(want))
    before = np.abs(below[np.clip(np.searchsorted(below, want) - 1, 0, n)] - np.array(want))
    assert (off <= np.maximum(np.array(tolerance), np.minimum(nearest, before))).all()


def test_clashing_columns_survive_and_hot_keys_split(rows):
    docs = [(5 if i % 3 else i, "x" * (i % 40), f"k{i}", f"u{i}", f"p{i}") for i in range(600)]
    df = rows("doc_id long, text string, __key string, __UID string, __part string", docs)
    got = sh.histogram_shards(df, shards=8, range_bytes=300).collect()
    assert sorted((r["doc_id"], r["text"], r["__key"], r["__UID"], r["__part"]) for r in got) == sorted(docs)
    sizes = np.bincount([r["shard"] for r in got], [r["size"] for r in got], minlength=8)
    assert sizes.max() - sizes.min() <= 80
    for s in range(8):
        mine = sorted((r["slot"], r["doc_id"]) for r in got if r["shard"] == s)
        assert [a for a, _ in mine] == list(range(len(mine))) and [b for _, b in mine] == sorted(b for _, b in mine)
