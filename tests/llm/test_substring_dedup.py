import random

import numpy as np
import pyarrow as pa

from tests.llm.text_cases import edited, prose, words_of
from tricolor.llm.substring_dedup import _around, _texts, align, chain, cut_repeats, repeated_passages, segments


def brute_chain_score(b0, b1, a0, a1, cost=0.1):
    score = {}
    for i in sorted(range(len(b0)), key=lambda i: (b0[i], a0[i])):
        before = [score[j] - cost * (a0[i] - a1[j] + b0[i] - b1[j]) for j in score if b1[j] <= b0[i] and a1[j] <= a0[i]]
        score[i] = b1[i] - b0[i] + max([0.0, *before])
    return max(score.values())


def test_fenwick_chain_is_optimal():
    rng = random.Random(2)
    for _ in range(200):
        n = rng.randint(1, 12)
        b0 = np.array([rng.randint(0, 200) for _ in range(n)])
        a0 = np.array([rng.randint(0, 200) for _ in range(n)])
        size = np.array([rng.randint(1, 30) for _ in range(n)])
        chains = chain(b0, b0 + size, a0, a0 + size)
        assert sorted(i for c in chains for i in c) == list(range(n))
        first, total = chains[0], 0.0
        for x, i in enumerate(first):
            if x:
                j = first[x - 1]
                assert b0[j] + size[j] <= b0[i] and a0[j] + size[j] <= a0[i]
                total -= 0.1 * (a0[i] - a0[j] - size[j] + b0[i] - b0[j] - size[j])
            total += size[i]
        assert abs(total - brute_chain_score(b0, b0 + size, a0, a0 + size)) < 1e-9


def test_alignment_and_segments():
    a = np.arange(100)
    b = np.concatenate([a[:40], [900, 901], a[42:60], a[63:]])
    to = align(b, a, [(5, 30, 5), (70, 90, 73)])
    assert (to[:40] == a[:40]).all() and (to[40:42] == -1).all() and to[-1] == 99
    assert segments(to >= 0) == [(0, len(b))]
    assert segments(np.zeros(5, bool)) == []
    assert segments(np.array([1] * 60 + [0] * 40 + [1] * 60, bool)) == [(0, 60), (100, 160)]


def planted(seed=4):
    rng = random.Random(seed)
    passages = [prose(rng, 80) for _ in range(4)]
    docs = {}
    for i in range(60):
        parts = [prose(rng, rng.randint(5, 90))]
        if i % 2 == 0:
            p = passages[i % 4]
            parts += [p if i % 3 else edited(rng, p, 0.04), prose(rng, 20)]
        docs[i] = " ".join(parts)
    docs[60], docs[61], docs[62] = docs[0], "", "w " * 700
    docs[63] = docs[62]
    return docs


def test_every_exact_repeat_is_covered(rows):
    docs = planted()
    got = repeated_passages(rows("doc_id long, text string, start int, id int", [(i, t, 0, 0) for i, t in docs.items()])).collect()
    words = {i: words_of(t) for i, t in docs.items()}
    covered = {i: np.zeros(len(w), bool) for i, w in words.items()}
    for r in got:
        assert r["source_id"] < r["doc_id"] and r["end"] - r["start"] >= 50
        assert r["matched"] >= 0.8 * max(r["end"] - r["start"], r["source_end"] - r["source_start"])
        covered[r["doc_id"]][r["start"]:r["end"]] = True
    first = {}
    for i, w in words.items():
        for p in range(len(w) - 50):
            holder = first.setdefault(tuple(w[p:p + 51]), i)
            if holder != i and i not in (62, 63):
                assert covered[i][p:p + 51].all(), (i, p)
    # each fuzzy copy of a passage is found too, and unrelated documents are left alone
    assert {i for i in range(4, 60, 2)} <= {r["doc_id"] for r in got}
    assert not {r["doc_id"] for r in got} & set(range(1, 60, 2))


def test_cut_keeps_rows_and_first_holder(rows):
    docs = planted()
    extra = [(100, None, "k", 3), (None, docs[0], "k", 4)]
    df = rows("doc_id long, text string, __x string, n_chars long", [(i, t, "k", len(t)) for i, t in docs.items()] + extra)
    out = cut_repeats(df)
    assert out.columns == df.columns
    by = {r["doc_id"]: r for r in out.collect()}
    assert len(by) == len(docs) + 2
    assert by[1]["text"] == docs[1] and by[0]["text"] == docs[0] and by[60]["text"] == ""
    assert by[100]["text"] is None and by[100]["n_chars"] == 3 and by[None]["text"] == docs[0]
    assert all(r["text"] is None or r["n_chars"] == len(r["text"]) for r in by.values())
    assert repeated_passages(rows("doc_id long, text string", [])).count() == 0
    assert cut_repeats(rows("doc_id long, text string", [])).count() == 0


def covered_words(rows, docs):
    got = repeated_passages(rows("doc_id long, text string", list(docs.items()))).collect()
    covered = {i: np.zeros(len(words_of(t)), bool) for i, t in docs.items()}
    for r in got:
        assert r["source_id"] < r["doc_id"] and r["end"] - r["start"] >= 50
        assert r["matched"] >= 0.8 * max(r["end"] - r["start"], r["source_end"] - r["source_start"])
        covered[r["doc_id"]][r["start"]:r["end"]] = True
    return covered


def test_passage_whose_seeds_stand_in_other_documents_too(rows):
    rng = random.Random(8)
    w = prose(rng, 60).split(" ")
    parts = [w[:40], w[20:], w, w, w[:34], w[14:48], w[26:], w]  # the parts stand before each whole one
    docs = {i: " ".join([prose(rng, 30), *p, prose(rng, 30)]) for i, p in enumerate(parts, 1)}
    # the source holds the passage's seeds elsewhere first, scattered
    v = prose(rng, 50).split(" ")
    docs[20] = " ".join([prose(rng, 5) + " " + " ".join(v[a:a + 12]) for a in range(0, 50, 6)] + [prose(rng, 9), *v, prose(rng, 9)])
    docs[21] = " ".join([prose(rng, 30), *v, prose(rng, 30)])
    covered = covered_words(rows, docs)
    assert covered[4][30:90].all() and covered[8][30:90].all() and covered[21][30:80].all()
    assert not covered[1].any() and not covered[20].any()


def test_exact_repeats_against_brute_force_in_overlapping_cuttings(rows):
    rng = random.Random(12)
    w = prose(rng, 160).split(" ") + ["la", "lu"] * 60
    docs = {}
    for i in range(40):
        a, n = rng.randint(0, 220), rng.choice([25, 35, 45, 50, 51, 70])
        docs[i] = " ".join([prose(rng, rng.randint(0, 20)), *w[a:a + n], prose(rng, 20)])
    covered, first = covered_words(rows, docs), {}
    for i, t in docs.items():
        x = words_of(t)
        for p in range(len(x) - 49):
            if first.setdefault(tuple(x[p:p + 50]), i) != i:
                assert covered[i][p:p + 50].all(), (i, p)


def test_recall_of_fuzzy_passages(rows):
    rng = random.Random(1)
    docs, kind = {}, {}
    for j in range(240):
        w = prose(rng, 50).split(" ")
        edits = [5, 7, 10][j % 3]  # identity 0.9, 0.86 and 0.8, with the first and last word kept
        at = range(2, 50, 50 // edits) if j % 2 else rng.sample(range(1, 49), edits)
        v = list(w)
        for a in list(at)[:edits]:
            v[a] = f"q{rng.randint(0, 10**9)}"
        for i, x in enumerate((w, v)):
            docs[2 * j + i] = " ".join([prose(rng, 40), *x, prose(rng, 40)])
        kind[2 * j + 1] = edits, j % 2
    got = {r["doc_id"] for r in repeated_passages(rows("doc_id long, text string", list(docs.items()))).collect()}
    assert got <= set(kind)
    share = {x: sum(i in got for i in kind if kind[i] == x) / 40 for x in set(kind.values())}
    print(share)
    assert min(share.values()) >= 0.9, share


def test_packed_rows_come_back():
    import numpy as np

    from tricolor.llm.substring_dedup import REST, _decode, _encode
    rng = np.random.default_rng(3)
    for n in (1, 2, 500):
        ids, pos = np.sort(rng.choice([-5, 0, 7, 1 << 62], n)), rng.integers(0, 1 << 31, n).astype(np.int32)
        order = np.lexsort((pos, ids))
        ids, pos, h = ids[order], pos[order], rng.integers(0, 1 << 63, n, dtype=np.uint64)
        a, b, c = _decode(_encode(ids, pos, h))
        assert (a == ids).all() and (b == pos).all() and (c == (h & np.uint64((1 << 8 * REST) - 1))).all()


def test_rooms_and_buckets_change_nothing_but_the_holder_named(rows, monkeypatch):
    from tricolor.llm import substring_dedup as module
    rng = random.Random(21)
    shared = [prose(rng, 70) for _ in range(6)]
    data = [(i, " ".join([prose(rng, rng.randint(0, 60)), *rng.sample(shared, rng.randint(0, 3)), prose(rng, 30)])) for i in range(90)]
    frame = rows("doc_id long, text string", data)
    one = repeated_passages(frame).collect()
    monkeypatch.setattr(module, "ROOM_DOCS", 20)
    monkeypatch.setattr(module, "BUCKET_CHARS", 3000)
    many = repeated_passages(frame).collect()

    def covered(found):
        out = {}
        for r in found:
            assert r.source_id < r.doc_id
            out.setdefault(r.doc_id, set()).update(range(r.start, r.end))
        return out
    assert covered(one) == covered(many) and len(covered(one)) > 40


def test_a_text_of_several_chains_is_hashed_once():
    w, text = _texts(np.array([3, 3, 3, 5, 5, 5]), pa.array(["a b c", "a b c", "a c", "a c", "a c", ""]))
    assert text.tolist() == [0, 0, 1, 2, 2, 3] and w.ptr.tolist() == [0, 3, 5, 7, 7]
    lo, hi = _around(w, text, np.array([0, 1, 0, 1, 2, 4]), np.array([2, 9, 1, 1, 3, 1]))
    assert (lo.tolist(), hi.tolist()) == ([0, 1, 3, 6, 7, 7], [2, 3, 4, 7, 7, 7])


def test_segments_equal_the_word_by_word_rule():
    def plain(match):
        at = np.flatnonzero(match)
        out, start, score, best, end = [], int(at[0]), 1, 1, int(at[0])
        for p, q in zip(at[:-1], at[1:]):
            score -= 2 * int(q - p - 1)
            if best - score > 20 or score <= 0:
                out.append((start, end + 1))
                start, score, best = int(q), 0, 0
            score += 1
            if score >= best:
                best, end = score, int(q)
        return [*out, (start, end + 1)]

    rng = np.random.default_rng(8)
    for _ in range(500):
        match = np.repeat(rng.random(40) < rng.choice([0.3, 0.6, 0.9]), rng.integers(1, 9, 40))
        if match.any():
            assert segments(match) == plain(match)
