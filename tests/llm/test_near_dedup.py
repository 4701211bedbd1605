import random
import re

import pytest

from tests.llm.text_cases import corpus, edited, prose, words_of
from tricolor.llm import components, near_dedup
from tricolor.llm.near_dedup import drop_near_duplicates, near_duplicates


def shingles(text, k):
    w = words_of(text)
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute(docs, k, percent):
    sets = [(i, shingles(t, k)) for i, t in docs]
    root = {i: i for i, _ in docs}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets}


@pytest.mark.parametrize("k", [2, 5])
def test_equals_brute_force(rows, k):
    docs = corpus(seed=k)
    got = near_duplicates(rows("doc_id long, text string, id string, n long, mark int", [(i, t, "x", 0, 1) for i, t in docs]), k=k).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute(docs, k, 80)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_large_group_of_near_copies_is_split_and_whole(rows):
    rng = random.Random(3)
    base = prose(rng, 150)
    docs = [(i, edited(rng, base, 0.02)) for i in range(150)] + [(1000 + i, prose(rng, 60)) for i in range(30)]
    got = near_duplicates(rows("doc_id long, text string", docs), k=2, leaf=8, depth=3, block=16, pivots=2).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute(docs, 2, 80)


def test_nulls_repeats_and_empty_table(rows):
    t = prose(random.Random(1), 40)
    got = near_duplicates(rows("doc_id long, text string", [(None, t), (7, t), (7, t), (9, None), (7, "other words here"), (3, "other words here")])).collect()
    by = sorted((r["doc_id"] or -1, r["n_shingles"], r["component_id"], r["kept"]) for r in got if r["doc_id"] is not None)
    assert by == [(3, 1, 3, True), (7, 1, 3, False), (7, 36, 3, False), (7, 36, 3, False), (9, 0, 9, True)]
    assert [(r["component_id"], r["kept"]) for r in got if r["doc_id"] is None] == [(None, True)]
    assert near_duplicates(rows("doc_id long, text string", [])).count() == 0


def test_drop_keeps_columns(rows):
    t = prose(random.Random(1), 40)
    df = rows("doc_id long, text string, kept int, component_id string", [(1, t, 5, "a"), (2, t, 6, "b"), (3, "", 7, None)])
    out = drop_near_duplicates(df)
    assert out.columns == df.columns
    assert sorted(r["doc_id"] for r in out.collect()) == [1, 3]


def test_no_task_holds_a_whole_group_of_template_documents(rows, monkeypatch):
    """Documents of similarity about 0.7 are one candidate group, but hardly any link is confirmed."""
    rng = random.Random(6)
    base = prose(rng, 150)
    docs = [(i, edited(rng, base, 0.09)) for i in range(200)]
    docs += [(200 + i, edited(rng, docs[i][1], 0.01)) for i in range(0, 60, 3)]
    most, by_block = [], near_dedup._by_block

    def watched(df, fn):
        keys = [c for c in ("grp", "block", "room") if c in df.columns]
        most.append(max(r["count"] for r in df.groupBy(*keys).count().collect()))
        return by_block(df, fn)

    monkeypatch.setattr(near_dedup, "_by_block", watched)
    got = near_duplicates(rows("doc_id long, text string", docs), k=2, leaf=8, depth=3, block=16, pivots=2).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute(docs, 2, 80)
    assert len({r["component_id"] for r in got}) > 100
    assert len(most) == 2 and max(most) <= 80, most  # blocks and rooms are about 16, dealt by hash


def test_rows_of_the_descent_stay_in_proportion_to_a_group_of_near_copies(rows, monkeypatch):
    """Near copies stop at the first large nodes and are not followed along all 128 paths of each."""
    rng = random.Random(8)
    base = prose(rng, 150)
    docs = [(i, edited(rng, base, 0.005 * (1 + i % 6))) for i in range(240)]
    held, stage = [], near_dedup.stage_table

    def watched(df, name):
        out = stage(df, name)
        if name == "sized":
            held.append(out.count())
        return out

    monkeypatch.setattr(near_dedup, "stage_table", watched)
    made = []
    for n in (120, 240):
        held.clear()
        got = near_duplicates(rows("doc_id long, text string", docs[:n]), k=2, leaf=8).collect()
        assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute(docs[:n], 2, 80)
        made.append(sum(held))
    assert made[1] <= 40 * 240, made
    assert made[1] <= 2.5 * made[0], made


@pytest.mark.parametrize("percent", [50, 80, 95])
def test_chains_from_copies_that_stop_early_stay_linked(rows, percent):
    """Each document is linked with the next ones only, so links lead out of what is near the smallest id."""
    rng = random.Random(9)
    text, docs = prose(rng, 120), []
    for i in range(160):
        docs.append((i, text))
        text = edited(rng, text, {50: 0.04, 80: 0.012, 95: 0.004}[percent])
    got = near_duplicates(rows("doc_id long, text string", docs), k=2, percent=percent, leaf=4).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute(docs, 2, percent)


def broadcasts(df):
    """The plan below each broadcast of ``df``, as text."""
    lines = df._jdf.queryExecution().executedPlan().toString().split("\n")
    deep = [len(re.match(r"[ :+-]*", x)[0]) for x in lines]
    for i, x in enumerate(lines):
        if "BroadcastExchange" in x:
            end = next((j for j in range(i + 1, len(lines)) if deep[j] <= deep[i]), len(lines))
            yield "\n".join(lines[i + 1:end])


def test_no_table_that_grows_with_the_documents_is_broadcast(rows, monkeypatch):
    """Small files of edges and of pairs hold many rows; in a hash table on the driver each takes 16 to 80 bytes."""
    rng = random.Random(6)
    base = prose(rng, 150)
    docs = [(i, edited(rng, base, 0.09)) for i in range(120)]
    docs += [(200 + i, edited(rng, docs[i][1], 0.01)) for i in range(0, 60, 3)]
    sent, stage = {}, near_dedup.stage_table

    def watched(df, name):
        sent.setdefault(name, []).extend(broadcasts(df))
        return stage(df, name)

    monkeypatch.setattr(near_dedup, "stage_table", watched)
    monkeypatch.setattr(components, "stage_table", watched)
    out = near_duplicates(rows("doc_id long, text string", docs), k=2, leaf=8, depth=3, block=16, pivots=2)
    assert {"cc", "sized", "placed", "asked", "more"} <= sent.keys()
    sent["result"] = list(broadcasts(out))
    assert not [n for n in ("cc", "sized", "part", "comp", "result") if sent.get(n)]
    assert [p for p in sent["more"]] and not [p for p in sent["more"] if "room#" in p or "block#" in p]
    assert not [p for n in ("placed", "asked") for p in sent[n] if re.search(r"FileScan parquet \[[^\]]*\bid#", p)]
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in out.collect()} == brute(docs, 2, 80)
