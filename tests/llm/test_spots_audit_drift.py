import hashlib
import math
import random
from collections import Counter, defaultdict

import numpy as np

from tests.llm.text_cases import LOW, prose
from tricolor.llm.drift_clusters import drift_clusters, loosening, square_distances
from tricolor.llm.source_audit import source_audit
from tricolor.llm.spot_sigs import ANCHORS, SPAN, edited_likeness

# --- fingerprints ------------------------------------------------------------------------------


def spot_hashes(text, chain=2):
    word, tokens = "", []
    for c in (text or "").translate(LOW):
        if c in " \t\n\x0b\x0c\r.,;:!?()\"":
            tokens += [word] if word else []
            word = ""
        else:
            word += c
    tokens += [word] if word else []
    spots, since = [], SPAN
    for t in tokens:
        if t in ANCHORS or since == SPAN:
            spots.append([t])
            since = 0
        else:
            spots[-1].append(t)
        since += 1
    spots = [s for s in spots if len(s) > 1]
    out = set()
    for i, s in enumerate(spots):
        content = [w for x in spots[i:i + chain] for w in x[1:chain + 1]][:chain]
        if len(content) == chain:
            out.add(" ".join([s[0], *content]))
    if tokens and not out:
        out = {" ".join(tokens)}
    return {hashlib.md5(x.encode()).hexdigest()[:8] for x in out}


def jaccard(a, b):
    if not a and not b:
        return 1.0
    if min(len(a), len(b)) < 0.05 * max(len(a), len(b)):
        return 0.0
    return len(a & b) / len(a | b)


def spoken(rng, n):
    return " ".join(rng.choice(ANCHORS) if rng.random() < 0.3 else w for w in prose(rng, n).split(" "))


def test_spot_signatures_against_brute_force(rows):
    rng = random.Random(1)
    texts = [spoken(rng, rng.choice([3, 20, 90])) for _ in range(30)]
    texts += [None, "", " \n ", "the", "The of and", "one", "One, two", "der Hund ist nicht für das Haus", "Ünïcode 🎉 für die Katze " * 9,
              "a | b | c | d | e | f | g | h | i | j", texts[0], texts[0], spoken(rng, 30_000), "same the " * 300]
    data = [(i, t, "x") for i, t in enumerate(texts)] + [(2, texts[2], "x"), (2, "same id", "y"), (None, "no id", "z"), (None, None, "z")]
    rng.shuffle(data)
    got = edited_likeness(rows("doc_id long, text string, fingerprint string", data)).collect()
    order = sorted(((i, t or "") for i, t, _ in data),
                   key=lambda x: (x[0] is not None, x[0] or 0, hashlib.md5(x[1].encode()).hexdigest()))
    want = []
    for (i, t), (_, after) in zip(order, order[1:] + order[:1]):
        quarter = len(t) // 4
        edited = t[:len(t) - quarter] + after[:quarter]
        own, other, following = spot_hashes(t), spot_hashes(edited), spot_hashes(after)
        want.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), "".join(sorted(own)), "".join(sorted(other)),
                     round(jaccard(own, other), 9), round(jaccard(own, following), 9)))
    key = lambda r: tuple(str(x) for x in r)
    assert sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in got), key=key) == sorted(want, key=key)


def test_spot_signatures_empty_and_single(rows):
    schema = "doc_id long, text string"
    assert edited_likeness(rows(schema, [])).collect() == []
    one = edited_likeness(rows(schema, [(5, "der Hund ist auf dem Dach und bellt laut")])).collect()
    assert len(one) == 1 and one[0].near_next == 1.0


def test_copies_are_near_and_strangers_are_not(rows):
    rng = random.Random(2)
    data = [(i, spoken(rng, 400)) for i in range(40)]
    got = edited_likeness(rows("doc_id long, text string", data)).collect()
    assert all(0.4 < r.near_edited < 0.8 for r in got) and all(r.near_next < 0.05 for r in got)


# --- source audit ------------------------------------------------------------------------------


def audit(data, least=3, top=200):
    """Dense evaluation: every term of every pair."""
    held, counts = defaultdict(set), defaultdict(Counter)
    for n, (lang, source, text) in enumerate(data):
        group, word = (lang or "", source or ""), ""
        counts[group]
        for c in (text or "").translate(LOW) + " ":
            if c > "\x7f" or "a" <= c <= "z":
                word += c
            else:
                if word:
                    counts[group][word] += 1
                    held[group[0], word].add(n)
                word = ""
    out = set()
    for lang in {g[0] for g in counts}:
        kept = [t for (x, t), docs in held.items() if x == lang and len(docs) >= least]
        groups = {s: c for (x, s), c in counts.items() if x == lang}
        total = Counter()
        for c in groups.values():
            total.update(c)
        share = lambda c: {t: 1 + 10**9 * (c[t] + 1) // (sum(c[u] for u in kept) + len(kept)) for t in kept}
        p, q = {s: share(c) for s, c in groups.items()}, share(total)
        for s in groups:
            pair = [(o, sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept)) for o in groups if o != s]
            term = [(t, (p[s][t] - q[t]) ** 2 // q[t]) for t in kept if groups[s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pair, len(pair)), ("term", term, top)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out |= {(lang, s, part, item, value, i + 1) for i, (item, value) in enumerate(found[:most])}
    return out


def test_source_audit_against_dense_evaluation(rows):
    rng = random.Random(3)
    vocabulary = prose(rng, 60).split(" ") + ["Ärger", "ärger", "STRASSE", "x2y", "naïve", "🎉"]
    data = []
    for _ in range(150):
        text = " ".join(rng.choice(vocabulary[:rng.choice([10, 66])]) for _ in range(rng.choice([0, 1, 5, 40])))
        data.append((rng.choice(["en", "de", None]), rng.choice(["a", "b", "c", None, "ü"]), text))
    hot = "of the hot text " * 50
    data += [("en", "a", hot)] * 60 + [("en", "b", hot)] * 5 + [("xx", "lone", "only one"), ("yy", "p", None), ("yy", "q", ""), ("en", "c", prose(rng, 20_000))]
    got = source_audit(rows("lang string, source string, text string, term string, n string", [(*r, "", "") for r in data]))
    found = [tuple(r) for r in got.collect()]
    assert len(found) == len(set(found)) and set(found) == audit(data)
    few = {tuple(r) for r in source_audit(rows("lang string, source string, text string", data), least_docs=2, top_terms=3).collect()}
    assert few == audit(data, 2, 3)


def test_source_audit_empty(rows):
    assert source_audit(rows("lang string, source string, text string", [])).collect() == []


def test_source_audit_flushes_tasks(rows, monkeypatch):
    import tricolor.llm.source_audit as module
    rng = random.Random(4)
    data = [("en", rng.choice("ab"), prose(rng, 30)) for _ in range(40)] * 3
    whole = {tuple(r) for r in source_audit(rows("lang string, source string, text string", data)).collect()}
    copies, count_terms = module._copies, module._count_terms

    def small(run):
        def with_small_bounds(batches):
            import tricolor.llm.source_audit as inside
            inside.HELD_BYTES, inside.HELD_TERMS = 500, 40
            yield from run(batches)
        return with_small_bounds
    monkeypatch.setattr(module, "_copies", small(copies))
    monkeypatch.setattr(module, "_count_terms", small(count_terms))
    assert {tuple(r) for r in source_audit(rows("lang string, source string, text string", data)).collect()} == whole == audit(data)


# --- clustering --------------------------------------------------------------------------------


def lloyd(data, dims, k, rounds, scale=64):
    kept = []
    for i, v in data:
        if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, [math.floor(scale * x) for x in v]))
    first = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))[:k]
    centroids = [v for _, v in first]
    for n in range(rounds + 1):
        d = [[sum((a - b) ** 2 for a, b in zip(v, c)) for c in centroids] for _, v in kept]
        cluster = [min(range(len(centroids)), key=lambda j: (row[j], j)) for row in d]
        if n < rounds:
            centroids = [[sum(x) // len(x) for x in zip(*m)] if (m := [v for (_, v), a in zip(kept, cluster) if a == j]) else c
                         for j, c in enumerate(centroids)]
    own = [row[a] for row, a in zip(d, cluster)]
    per = Counter()
    for a, x in zip(cluster, own):
        per[a] += x
    return [(i, a, x, per[a], sum(own), hashlib.sha256(",".join(map(str, centroids[a])).encode()).hexdigest())
            for (i, _), a, x in zip(kept, cluster, own)]


def clustered(rng, n, dims, k, spread=0.1):
    centres = [[rng.gauss(0, 1) for _ in range(dims)] for _ in range(k)]
    return [(i, [c + rng.gauss(0, spread) for c in rng.choice(centres)]) for i in range(n)]


def same(got, want):
    key = lambda r: tuple(str(x) for x in r)
    assert sorted((tuple(r)[:6] for r in got), key=key) == sorted(want, key=key)


def test_drift_clusters_against_lloyd(rows):
    rng = random.Random(5)
    data = clustered(rng, 300, 8, 6) + [(7, None), (8, [1.0] * 7), (9, [None] + [0.0] * 7), (10, [float("nan")] * 8), (11, [float("inf")] * 8)]
    data += [(3, data[3][1]), (3, data[3][1]), (3, [0.5] * 8), (None, [0.25] * 8), (400, [0.0] * 8), (401, [-0.001] * 8)]
    data += [(500 + i, [round(rng.random()) * 1.0 for _ in range(8)]) for i in range(60)]  # ties
    frame = rows("vec_id long, embedding array<double>, cluster string", [(*r, "") for r in data])
    for k, rounds in ((6, 3), (16, 5), (1, 2)):
        same(drift_clusters(frame, dims=8, k=k, rounds=rounds).collect(), lloyd(data, 8, k, rounds))


def test_drift_clusters_few_large_and_empty(rows):
    schema = "vec_id long, embedding array<double>"
    assert drift_clusters(rows(schema, [])).collect() == []
    same(drift_clusters(rows(schema, [(1, [0.5] * 64), (2, [0.75] * 64)])).collect(), lloyd([(1, [0.5] * 64), (2, [0.75] * 64)], 64, 16, 3))
    rng = random.Random(6)
    large = [(i, [rng.gauss(0, 1) * 10.0 ** (i % 7) for _ in range(4)]) for i in range(80)]
    same(drift_clusters(rows(schema, large), dims=4, k=4, rounds=3).collect(), lloyd(large, 4, 4, 3))
    beyond = [(1, [1e12, 0.0]), (2, [-1e12, 0.0]), (3, [3e12, 1.0])]
    got = drift_clusters(rows(schema, beyond), dims=2, k=1, rounds=1).collect()
    assert {r.vec_id: r.distance for r in got} == {1: 21 * 21, 2: None, 3: None}  # the centroid is at (1e12, 1/3)
    assert all(r.inertia is None and r.cluster_inertia is None for r in got)


def test_bounds_leave_structured_vectors_alone(rows):
    rng = random.Random(7)
    data = clustered(rng, 600, 16, 5, 0.02)
    got = drift_clusters(rows("vec_id long, embedding array<double>", data), dims=16, k=5, rounds=4).collect()
    same(got, lloyd(data, 16, 5, 4))
    assert sum(r.scanned for r in got) < 0.2 * len(got)


def test_loosening_holds_for_every_member_and_is_under_the_drift():
    rng = np.random.default_rng(8)
    tighter = 0
    for _ in range(300):
        k, dims = 4, int(rng.integers(2, 6))
        old = rng.integers(-1000, 1000, (k, dims))
        new = old + rng.integers(-300, 300, (k, dims))
        radius = rng.uniform(0, 900, k)
        loose = loosening(old, new, radius)
        drift = np.linalg.norm((new - old).astype(float), axis=1)
        for i in range(k):
            x = rng.normal(size=(200, dims))
            x = old[i] + x / np.linalg.norm(x, axis=1)[:, None] * radius[i] * rng.uniform(0, 1, (200, 1)) ** 0.3
            others = [j for j in range(k) if j != i]
            fall = max((np.linalg.norm(x - old[j], axis=1) - np.linalg.norm(x - new[j], axis=1)).max() for j in others)
            assert fall <= loose[i] + 1e-6 <= drift[others].max() + 1e-3
            tighter += loose[i] < 0.99 * drift[others].max()
    assert tighter > 300


def test_square_distances_in_every_number_type():
    rng = np.random.default_rng(9)
    for most in (10, 1 << 24, 1 << 27, 1 << 50):
        v, c = rng.integers(-most, most, (20, 3)), rng.integers(-most, most, (4, 3))
        want = [[sum((int(a) - int(b)) ** 2 for a, b in zip(x, y)) for y in c] for x in v]
        assert [[int(x) for x in r] for r in square_distances(v, c)] == want
