import os
import random
import tracemalloc
import zlib

import numpy as np
import pytest

from tests.llm.text_cases import prose
from tricolor.llm import toxicity as tox
from tricolor.llm.site_quality import fit_logistic, site_quality
from tricolor.llm.toxicity import drop_toxic, fit_nnpu, fit_toxicity, toxicity


def labelled(seed=1, n=900):
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        bad = rng.random() < 0.15
        w = prose(rng, rng.randint(15, 120)).split(" ")
        if bad:
            for _ in range(rng.randint(1, 4)):
                w.insert(rng.randint(0, len(w)), rng.choice(["vilewretch", "vilewretchen,", "Scoundrel.", "scoundrels"]))
        docs.append((i, " ".join(w), int(bad)))
        if rng.random() < 0.6:
            labels.append((i, int(bad)))
    return docs, labels


def test_toxicity_on_the_held_out_fold(rows):
    docs, labels = labelled()
    extra = [(5000, None, 0), (5001, "", 0), (None, "vilewretch scoundrel vilewretch", 1)]
    df = rows("doc_id long, text string, score string, source string", [(i, t, "x", "s") for i, t, _ in docs + extra])
    got = toxicity(df, rows("doc_id long, toxic int", labels + [(None, 1), (3, None)])).collect()
    assert len(got) == len(docs) + 3 and all(0 <= r["score"] <= 1 for r in got)
    truth = {i: y for i, _, y in docs}
    right = [r["predicted"] == truth[r["doc_id"]] for r in got if r["held_out"] and r["doc_id"] in truth]
    assert np.mean(right) > 0.95
    for r in got:
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
    by = {r["doc_id"]: r["score"] for r in got}
    assert by[5000] == by[5001] < 0.5 and by[None] > 0.5


def test_toxicity_without_labels_and_empty(rows):
    none = rows("doc_id long, toxic int", [])
    assert {r["score"] for r in toxicity(rows("doc_id long, text string", [(1, "a"), (2, None)]), none).collect()} == {0.0}
    assert toxicity(rows("doc_id long, text string", []), none).count() == 0
    df = rows("doc_id long, text string, __score2 int, score string", [(1, "a", 2, "own")])
    assert drop_toxic(df, none).collect() == df.collect()


def test_risk_stays_non_negative_where_plain_risk_would_not():
    rng = np.random.default_rng(3)
    feats = [np.unique(rng.integers(0, 40, 12)).astype(np.uint32) + np.uint32(1000 * (i < 30)) for i in range(400)]
    positive = np.arange(400) < 30
    risk = {}
    for held in (True, False):
        chosen, w, bias = fit_nnpu(feats, positive, 0.3, keep=512, non_negative=held)
        f = np.array([bias + w[np.isin(chosen, x)].sum() for x in feats])
        risk[held] = np.logaddexp(0, f[~positive]).mean() - 0.3 * np.logaddexp(0, f[positive]).mean()
        assert f[positive].mean() > f[~positive].mean() + 0.5
    # the steps go against a negative risk, so it only swings around 0; the plain one keeps falling
    assert risk[False] < -0.5 < 2 * risk[True]


def test_logistic_recovers_a_line():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((4000, 2))
    y = (rng.random(4000) < 1 / (1 + np.exp(-(2 * x[:, 0] - x[:, 1] + 0.5)))).astype(float)
    w, bias, mean, scale = fit_logistic(x, y)
    assert np.allclose(w / scale, [2, -1], atol=0.25) and abs(bias - (w / scale) @ mean - 0.5) < 0.25


def test_site_posteriors_against_numpy(rows):
    rng = random.Random(2)
    docs, labels = [], []
    for i in range(400):
        host = rng.choice(["good"] * 4 + ["junk"] * 3 + [f"h{i % 30}"])
        bad = rng.random() < (0.8 if host == "junk" else 0.1)
        t = prose(rng, 40) + " the and of the" if not bad else " ".join(w + "##$$" for w in prose(rng, 40).split(" "))
        docs.append((i, t, None if host == "h3" else host, rng.choice(["a", "b", None])))
        labels.append((i, int(not bad)))
    df = rows("doc_id long, text string, source string, lang string, posterior string", [(*d, "x") for d in docs])
    got = site_quality(df, rows("doc_id long, quality int", labels)).collect()
    truth = dict(labels)
    assert len(got) == 400 and np.mean([r["kept"] == truth[r["doc_id"]] for r in got]) > 0.97
    host = {d[0]: d[2] for d in docs}
    rate = {}
    for r in got:
        rate.setdefault(host[r["doc_id"]], set()).add(round(r["host_rate"], 9))
    assert all(len(v) == 1 for v in rate.values())
    p = np.array([r["evidence"] for r in got])
    mean = {h: np.mean([r["evidence"] for r in got if host[r["doc_id"]] == h]) for h in rate}
    for h, v in rate.items():  # a shrunken rate lies between the host's own mean and the global one
        assert min(mean[h], p.mean()) - 1e-6 <= next(iter(v)) <= max(mean[h], p.mean()) + 1e-6
    for r in got:
        odds = lambda x: np.log(x / (1 - x))
        assert abs(odds(r["posterior"]) - (odds(r["evidence"]) + odds(r["path_rate"]) - odds(p.mean()))) < 1e-6
    assert site_quality(rows("doc_id long, text string, source string, lang string", []), rows("doc_id long, quality int", [])).count() == 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="driver data not present")
def test_pipeline_stage_by_stage(spark, sf_small):
    import corpus_pipeline
    from tests.llm.text_cases import words_of
    from tests.llm.test_near_dedup import brute
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "repeated_passages", "source_mixing", "packing"]
    at = docs
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r for r in at.collect()}
        out = stage(spark, at, sf_small)
        got = out.collect()
        if name != "packing":
            assert out.columns == docs.columns
        after = {r["doc_id"]: r for r in got}
        assert set(after) <= set(before)
        if name == "near_duplicates":
            comp = brute([(i, r["text"]) for i, r in before.items()], 5, 80)
            assert set(after) == {i for i in before if comp[i][1] == i or not comp[i][0]}
        if name == "repeated_passages":
            assert set(after) == set(before)
            first = {}
            for i in sorted(after):
                w = words_of(after[i]["text"])
                for p in range(len(w) - 49):
                    assert first.setdefault(tuple(w[p:p + 50]), i) == i
        if name == "packing":
            size = {}
            for r in at.collect():
                size[r["doc_id"]] = size.get(r["doc_id"], 0) + len(words_of(r["text"]))
            packed = {}
            for r in got:
                packed[r["doc_id"]] = packed.get(r["doc_id"], 0) + r["length"]
            assert packed == size
        at = spark.createDataFrame(got, out.schema)


def test_prior_counts_the_drawn_positives_only(rows):
    rng = random.Random(31)
    data = [(i, prose(rng, 12) + (" vile awful" if i % 3 == 0 else "")) for i in range(900)]
    docs = rows("doc_id long, text string", data)
    labels = rows("doc_id long, toxic int", [(i, int(i % 3 == 0)) for i, _ in data])
    _, whole = fit_toxicity(docs, labels)
    models, few = fit_toxicity(docs, labels, most_positive=30, most_unlabelled=600)
    assert whole == 0.001  # everything toxic is known and taken out
    assert models and 0.27 < few < 0.34  # about 30 of 240 are out


def test_bags_are_bounded_in_bytes(rows):
    rng = random.Random(32)
    data = [(i, prose(rng, 200) + (" vile awful" if i % 3 == 0 else "")) for i in range(300)]
    docs, labels = rows("doc_id long, text string", data), rows("doc_id long, toxic int", [(i, int(i % 3 == 0)) for i, _ in data[:150]])
    models, _ = fit_toxicity(docs, labels, most_bytes=40_000)
    whole, _ = fit_toxicity(docs, labels)
    assert models and whole
    assert not any(len(a[1]) == len(b[1]) and (a[1] == b[1]).all() for a in models for b in whole)


def test_columns_that_could_clash_are_kept(rows):
    from tricolor.llm.mixing import mixed_documents
    from tricolor.llm.substring_dedup import cut_repeats
    rng = random.Random(33)
    names = ["__text", "__id", "__spans", "_id", "_take", "_Source", "toxicity_score", "cut_id", "cut_spans", "mix_id", "mix_take", "mix_own_tie", "size", "score"]
    passage = prose(rng, 80)
    data = [(i, prose(rng, 30) + " " + passage, "s", *[f"{c}{i}" for c in names]) for i in range(6)]
    docs = rows("doc_id long, text string, source string, " + ", ".join(f"`{c}` string" for c in names), data)
    labels = rows("doc_id long, toxic int", [(0, 1), (1, 0), (2, 0)])
    for run in (lambda d: drop_toxic(d, labels), cut_repeats, mixed_documents):
        out = run(docs)
        assert out.columns == docs.columns
        got = out.collect()
        assert got and all(r[c] == f"{c}{r.doc_id}" for r in got for c in names)


def test_training_needs_little_beside_the_texts():
    """Rates are counted text by text: the features of a bag (80 MB here) are not copied whole."""
    rng = np.random.default_rng(4)
    feats = [np.unique(rng.integers(0, 1 << 21, 10_000)).astype(np.uint32) for _ in range(2000)]
    positive = np.arange(2000) % 4 == 0
    feats = [np.unique(np.append(f, np.arange(50 if p else 5))).astype(np.uint32) for f, p in zip(feats, positive)]
    tracemalloc.start()
    try:
        chosen, w, _ = fit_nnpu(feats, positive, 0.2, keep=64, steps=3)
        assert tracemalloc.get_traced_memory()[1] < 170 << 20
    finally:
        tracemalloc.stop()
    assert set(range(5, 50)) <= set(chosen.tolist()) and (w[np.isin(chosen, np.arange(5, 50))] > 0).all()


def test_steps_do_not_depend_on_pieces(monkeypatch):
    rng = np.random.default_rng(5)
    held = [np.sort(rng.choice(40, rng.integers(0, 12), replace=False)).astype(np.int32) for _ in range(300)]
    positive = rng.random(300) < 0.3
    w, bias = tox.train_nnpu(held, 40, positive, 0.3, steps=50)
    for piece in (1, 7, 100):
        monkeypatch.setattr(tox, "PIECE", piece)
        again, b = tox.train_nnpu(held, 40, positive, 0.3, steps=50)
        assert np.array_equal(w, again) and b == bias
