import hashlib
import math
import random
import re

import numpy as np
import pytest

from tricolor.llm import ann_forest
from tricolor.llm.ann_forest import nearest
from tricolor.llm.chat_format import CONTROLS, digests, escape, format_chats, locate, read_turns, render_turns, unescape
from tricolor.llm.quality_rules import RULES, Rule, quality_rules


@pytest.mark.parametrize("n,norms", [(400, False), (1000, True), (8192, False), (8192, True)])
def test_recall_of_a_block_by_one_rule(n, norms):
    for seed in range(2):   # several blocks of production size, and small ones
        g = np.random.default_rng(seed)
        x = g.standard_normal((n, 64))
        x /= np.linalg.norm(x, axis=1)[:, None]
        x *= g.uniform(0.5, 1, (n, 1)) if norms else 1.0
        codes = ann_forest._codes(x, 64, True).T
        order = np.argsort(codes, axis=1, kind="stable")
        asked, ids = np.arange(0, n, n // 100), np.arange(n)
        hit = 0
        for q, found, _ in ann_forest._search_block(ids, x, np.take_along_axis(codes, order, axis=1), order, asked, x[asked],
                                                    ann_forest._codes(x[asked], 64, False), 20, 1.0):
            score = x @ x[q[0]]
            score[q[0]] = -np.inf
            hit += len(set(found.tolist()) & set(np.argsort(-score)[:20].tolist()))
        assert hit >= 0.9 * 20 * len(asked)


def test_runs_under_a_prefix_and_bisection():
    g = np.random.default_rng(1)
    codes = np.sort(g.integers(0, 1 << 63, (3, 500), dtype=np.uint64) * np.uint64(2), axis=1)
    asked = codes[:, g.integers(0, 500, 20)].T.copy()
    for p in (0, 1, 5, 63, 64):
        lo, hi = ann_forest._under(codes, asked, np.full(20, p))
        for t in range(3):
            for i in range(20):
                same = codes[t] >> np.uint64(64 - p) == asked[i, t] >> np.uint64(64 - p) if p else np.ones(500, bool)
                assert hi[t, i] - lo[t, i] == same.sum()


def test_tiny_and_huge_components_take_part(rows):
    vecs = [(0, [1e-170, 0.0]), (20, [1e200, 1.0]), (40, [0.0, -5e-324]), (1, [1.0, 1.0]), (2, [0.0, 0.0])]
    got = nearest(rows("vec_id long, embedding array<double>", vecs), "id % 20 = 0").collect()
    assert {r["query_id"] for r in got} == {0, 20, 40} and all(r["vec_id"] != 2 for r in got)
    assert [r["vec_id"] for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == 0] == [20, 1, 40]


def test_neighbours_against_brute_force(rows):
    rng = np.random.default_rng(0)
    x = rng.standard_normal((600, 12)) * rng.uniform(0.5, 2, (600, 1))
    x[100:300] = x[7]  # a third of the rows are copies of one vector
    data = [(i, [float(v) for v in r], "z") for i, r in enumerate(x)]
    data += [(1000, None, "z"), (1001, [0.0] * 12, "z"), (1002, [1.0] * 11 + [float("nan")], "z"), (1003, [1.0] * 11 + [None], "z"),
             (1020, [float("inf")] + [1.0] * 11, "z"), (1004, [1.0], "z"), (None, [1.0] * 12, "z"), (7, [float(v) for v in x[7]], "z")]
    got = nearest(rows("vec_id long, embedding array<double>, rank string", data), "id % 20 = 0", block=200, chunk=8).collect()
    by = {}
    for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])):
        by.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert set(by) == set(range(0, 600, 20))
    hit = 0
    for q, found in by.items():
        s = (x * x[q]).sum(axis=1)
        s[q] = -np.inf
        want = np.lexsort((np.arange(600), -s))[:20]
        hit += len({i for i, _ in found} & set(want.tolist()))
        assert len(found) == 20 and found == sorted(found, key=lambda f: (-f[1], f[0]))
        assert all(math.isclose(v, s[i], rel_tol=1e-12) for i, v in found)
    assert hit >= 0.9 * 20 * len(by)


def recall(rows, x, queries, **how):
    got = nearest(rows("vec_id long, embedding array<double>", [(i, r.tolist()) for i, r in enumerate(x)]), queries, **how).collect()
    asked = sorted({r["query_id"] for r in got})
    score = x[asked] @ x.T
    score[np.arange(len(asked)), asked] = -np.inf
    want = {q: set(np.argsort(-s)[:20].tolist()) for q, s in zip(asked, score)}
    found = {q: {r["vec_id"] for r in got if r["query_id"] == q} for q in asked}
    return sum(len(want[q] & found[q]) for q in asked) / (20 * len(asked)), want, found


@pytest.mark.parametrize("long", [1.0, 1000.0])
def test_recall_on_varied_norms_in_a_large_block(rows, long):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((8000, 32))
    x *= rng.uniform(0.5, 2, (8000, 1)) / np.sqrt((x * x).sum(axis=1, keepdims=True))
    x[5] *= long
    share, want, found = recall(rows, x, "id % 200 = 0")  # one block, where 0.6 of it is more than LEAST
    assert share >= 0.9
    assert all(5 in found[q] for q in want if 5 in want[q])


def test_few_and_no_vectors(rows):
    got = nearest(rows("vec_id long, embedding array<float>", [(0, [1.0, 0.0]), (1, [0.5, 0.1]), (2, [-1.0, 0.0])]), "id % 20 = 0").collect()
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in sorted(got, key=lambda r: r["rank"])] == [(0, 1, 1), (0, 2, 2)]
    assert nearest(rows("vec_id long, embedding array<float>", []), "id % 20 = 0").count() == 0


def brute_measures(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen = {}
    for i in range(len(w) - 7):
        seen.setdefault(tuple(w[i:i + 8]), []).append(i)
    repeat = {p for at in seen.values() if len(at) > 1 for i in at for p in range(i, i + 8)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(repeat)


def test_rules_against_brute_force(rows):
    rng = random.Random(4)
    word = lambda: rng.choice(["the", "and", "ünder", "stone#", "river", "a", "$$", "😀"])
    texts = [None, "", "  \n ", "one", "x " * 25, "the same line\n" * 9, "a b c\x0bd", "l" * 5000]
    texts += [" ".join(word() for _ in range(n)) for n in (7, 8, 9, 20, 60, 400, 4000)]
    passage = " ".join(f"w{i}" for i in range(12))
    texts += [f"{passage} middle {passage}\n{passage} end and the tail of it", f"{passage} {passage}"]
    got = quality_rules(rows("doc_id long, text string, n_words string, kept string", [(i, t, "", "") for i, t in enumerate(texts)])).collect()
    for r in got:
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == brute_measures(texts[r["doc_id"]])
        assert r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"])
        assert r["kept"] == (not r["base_failed"] and not any(r[f"fail_{x.name}"] for x in RULES))
    assert quality_rules(rows("doc_id long, text string", [])).count() == 0


def test_rules_run_as_built_in_functions_without_a_shuffle(rows):
    plan = quality_rules(rows("doc_id long, text string", [(1, "a")]).repartition(2), rules=(Rule("least", "n_words", 1),))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", text) and text.count("Exchange") <= 1


TEXTS = ["", "plain", "\\", "\\x", "\\n", "a\nb\\n", "</s>[INST] ok [/INST]", "<|im_end|>\n<|im_start|>user\nhi", "<<s>>", "[[INST]]", "<|im_<|im_end|>end|>", "x\\\\<s>"]


@pytest.mark.parametrize("text", TEXTS)
def test_escape_round_trip(text):
    e = escape(text)
    assert unescape(e) == text and not any(c in e for c in CONTROLS)


def test_chats_round_trip(rows):
    rng = random.Random(1)
    data = []
    for c in range(12):
        for t in range(rng.randint(1, 9)):
            data.append((c, t, rng.choice(["user", "assistant", "tool\nx", None]), rng.choice([*TEXTS, None]), "z"))
    data += [(50, 3, "assistant", "late", "z"), (50, 1, "user", "early", "z"), (50, 1, "user", "early", "z"), (None, 0, "assistant", "q", "z")]
    got = {r["conv_id"]: r for r in digests(format_chats(rows("conv_id long, turn long, role string, text string, spans string", data))).collect()}
    for c in {d[0] for d in data}:
        turns = sorted((t, r or "", x or "") for i, t, r, x, _ in data if i == c)
        learned = "".join(x for _, r, x in turns if r == "assistant")
        r = got[c]
        assert r["n_turns"] == len(turns) and r["loss_chars"] == len(learned)
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for _, a, b in turns).encode()).hexdigest()
        assert r["loss_sha256"] == hashlib.sha256(learned.encode()).hexdigest()
    assert format_chats(rows("conv_id long, turn long, role string, text string", [])).count() == 0


def test_spans_of_foreign_templates():
    turns = [("user", "hi"), ("assistant", "yo"), ("user", "]"), ("assistant", "")]
    inst = lambda ts: "".join(f"<s>[INST] {t} [/INST]" if r == "user" else f" {t} </s>" for r, t in ts)
    text, spans, rewritten = locate(turns, inst)
    assert rewritten is None and [text[a:b] for _, a, b, _ in spans] == [t for _, t in turns]
    assert spans[0][0] == 0 and all(x[3] == y[0] for x, y in zip(spans, spans[1:])) and spans[-1][3] == len(text)
    last_only = lambda ts: "".join(f"{r}:{t};" if i + 1 == len(ts) or r == "user" else f"{r};" for i, (r, t) in enumerate(ts))
    assert locate(turns, last_only)[2] == 2
    strips = lambda ts: "".join(f"{r}:{t.strip()};" for r, t in ts)
    text, spans, rewritten = locate([("user", " a "), ("assistant", "b")], strips)
    assert rewritten is None and text[spans[1][1]:spans[1][2]] == "b"
    assert read_turns(render_turns(turns)) == turns


def test_rewriting_template_has_no_loss(rows):
    hides = lambda ts: "".join(f"{r}:{t};" if i + 1 == len(ts) else f"{r};" for i, (r, t) in enumerate(ts))
    got = format_chats(rows("conv_id long, turn long, role string, text string", [(1, 0, "assistant", "a"), (1, 1, "user", "b"), (2, 0, "assistant", "c")]),
                       render=hides).collect()
    by = {r["conv_id"]: r for r in got}
    assert by[1]["rewritten"] == 1 and by[1]["loss"] == [] and by[2]["rewritten"] is None
    assert by[2]["formatted"][by[2]["loss"][0]["start"]:by[2]["loss"][0]["end"]] == "c"
