"""Toxicity by non-negative positive-unlabelled learning (numpy classifiers trained in Spark tasks).

Confirmed toxic texts are the positives; all other training texts, whatever their label, are
unlabelled. With class prior p the risk p * E+[l(f)] + max(0, Eu[l(-f)] - p * E+[l(-f)]) is
minimised: the second term is the risk on negatives, estimated from the unlabelled texts, and when
it turns negative (over-fitting) the step goes against it, as the non-negative estimator asks.

Features are hashed words and word beginnings, present or not; each classifier keeps the ``keep``
features whose rates differ most between positives and unlabelled texts. They are counted by a pass
that keeps no text, and only they go on to the task that trains. ``bags`` classifiers are
trained in parallel on disjoint bounded samples and their probabilities averaged. What reaches the
driver are the classifiers' weights, whose size is fixed; every whole text is scored by a streaming
pass without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tricolor.llm.common import hash_words, lean, runs, ship, slices, stage_table, unused

SPACE = 1 << 21
PREFIXES = (4, 5, 6, 8)
PIECE = 1 << 18


def _features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(text number, feature) of every word and word beginning, repeats included."""
    w = hash_words(column, PREFIXES)
    text = np.repeat(np.arange(len(column)), np.diff(w.ptr))
    all_ = [w.hash, *[w.prefixes[p] for p in PREFIXES]]
    return np.tile(text, len(all_)), np.concatenate([(h >> np.uint64(43)).astype(np.int64) for h in all_])


def _sample_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for b in slices(batch, "text"):
            text, f = _features(b.column("text"))
            pair = np.unique(text * SPACE + f)
            cut = np.searchsorted(pair, np.arange(b.num_rows + 1) * SPACE)
            f = (pair % SPACE).astype(np.uint32)
            yield pa.RecordBatch.from_arrays(
                [b.column("bag"), b.column("toxic"), pa.array([f[x:y].tobytes() for x, y in zip(cut[:-1], cut[1:])], pa.binary())],
                names=["bag", "toxic", "feats"])


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * z))


def choose_features(pos: np.ndarray, unl: np.ndarray, n_pos: int, n_unl: int, keep: int) -> np.ndarray:
    """The ``keep`` features whose rates differ most, from the number of texts of each kind that hold them."""
    held = np.flatnonzero((pos > 0) | (unl > 0))   # the others are far from a difference
    a, b = (pos[held] + 0.5) / (n_pos + 1), (unl[held] + 0.5) / (n_unl + 1)
    z = (a - b) / np.sqrt(a * (1 - a) / n_pos + b * (1 - b) / n_unl)
    chosen = np.sort(np.argsort(-np.abs(z), kind="stable")[:keep])
    return held[chosen[np.abs(z[chosen]) >= 3]]


def train_nnpu(held: list[np.ndarray], n_features: int, positive: np.ndarray, prior: float, steps: int = 400,
               rate: float = 0.1, decay: float = 1e-4, non_negative: bool = True) -> tuple[np.ndarray, float]:
    """(weights, bias); ``held`` has the numbers of the chosen features in every text.

    Entries are gone through in pieces of about ``PIECE``, so that a step needs little beside them."""
    pos, unl = np.flatnonzero(positive), np.flatnonzero(~positive)
    size = np.array([len(h) for h in held], np.int64)
    row = np.repeat(np.arange(len(held), dtype=np.int32), size)
    col = np.concatenate([h.astype(np.int32, copy=False) for h in held]) if held else np.zeros(0, np.int32)
    ends = np.concatenate([[0], np.cumsum(size)])
    at = [0]   # texts at which a piece begins
    while at[-1] < len(held):
        at.append(max(at[-1] + 1, int(np.searchsorted(ends, ends[at[-1]] + PIECE, "right")) - 1))
    pieces = [(x, y, slice(int(ends[x]), int(ends[y]))) for x, y in zip(at[:-1], at[1:])]
    w, bias = np.zeros(n_features), float(np.log(prior / (1 - prior)))
    m, v = np.zeros(n_features + 1), np.zeros(n_features + 1)
    f = np.zeros(len(held))
    for step in range(1, steps + 1):
        for x, y, s in pieces:
            f[x:y] = bias + np.bincount(row[s] - x, w[col[s]], minlength=y - x)
        s = _sigmoid(f)
        # logistic loss: l(f) = log(1 + exp(-f)); l'(f) = s - 1, d/df l(-f) = s
        loss_neg = np.logaddexp(0, f)
        negative = loss_neg[unl].mean() - prior * loss_neg[pos].mean()
        g_neg = np.zeros(len(held))
        g_neg[unl] = s[unl] / len(unl)
        g_neg[pos] = -prior * s[pos] / len(pos)
        if negative >= 0 or not non_negative:
            g = g_neg
            g[pos] += prior * (s[pos] - 1) / len(pos)
        else:
            g = -g_neg
        total = np.zeros(n_features)
        for _, _, s in pieces:
            np.add.at(total, col[s], g[row[s]])   # in the order of the texts, whatever the pieces
        grad = np.append(total + decay * w, g.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        move = rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
        w, bias = w - move[:-1], bias - move[-1]
    return w, bias


def fit_nnpu(feats: list[np.ndarray], positive: np.ndarray, prior: float, keep: int, steps: int = 400,
             rate: float = 0.1, decay: float = 1e-4, non_negative: bool = True) -> tuple[np.ndarray, np.ndarray, float]:
    """(features, weights, bias) of one logistic classifier under the non-negative PU risk."""
    pos, unl = np.zeros(SPACE, np.int64), np.zeros(SPACE, np.int64)
    for f, p in zip(feats, positive):
        (pos if p else unl)[f] += 1
    chosen = choose_features(pos, unl, int(positive.sum()), int((~positive).sum()), keep)
    w, bias = train_nnpu(_places(feats, chosen), len(chosen), positive, prior, steps, rate, decay, non_negative)
    return chosen, w, bias


def _places(feats: list[np.ndarray], chosen: np.ndarray) -> list[np.ndarray]:
    """Per text the numbers of those of its features that are chosen."""
    place = np.full(SPACE, -1, np.int32)
    place[chosen] = np.arange(len(chosen))
    return [x[x >= 0] for x in (place[f] for f in feats)]


def _binaries(column: pa.Array, dtype) -> list[np.ndarray]:
    """The values of a binary column as views of its buffer, without a copy."""
    _, off, data = column.buffers()
    o = np.frombuffer(off, np.int32)[column.offset:column.offset + len(column) + 1]
    flat = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return [flat[x:y].view(dtype) for x, y in zip(o[:-1], o[1:])]


def _pick(keep: int):
    """The chosen features of every bag (partitions sorted by it), from counts: no text is kept."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bag, n = None, np.zeros(2, np.int64)
        count = np.zeros((2, SPACE), np.int32)

        def done() -> Iterator[pa.RecordBatch]:
            if n.all():
                f = choose_features(count[1], count[0], int(n[1]), int(n[0]), keep)
                yield pa.RecordBatch.from_pydict({"bag": pa.array([bag], pa.int32()), "features": [f.astype(np.int64).tobytes()]})

        for b in batches:
            kind = b.column("toxic").to_numpy().astype(np.int64)
            for x, i, f in zip(b.column("bag").to_pylist(), kind, _binaries(b.column("feats"), np.uint32)):
                if x != bag:
                    yield from done()
                    bag = x
                    n[:], count[:] = 0, 0
                n[i] += 1
                count[i, f] += 1   # a text holds a feature once
        yield from done()
    return run


def _hold(chosen: dict[int, np.ndarray]):
    """Texts with the numbers of their bag's chosen features; texts of bags without any choice go."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bag = b.column("bag").to_numpy()
            feats = _binaries(b.column("feats"), np.uint32)
            for x, features in chosen.items():
                i = np.flatnonzero(bag == x)
                if len(i):
                    held = _places([feats[j] for j in i], features)
                    yield pa.RecordBatch.from_arrays(
                        [b.column("bag").take(pa.array(i)), b.column("toxic").take(pa.array(i)), b.column("turn").take(pa.array(i)),
                         pa.array([h.tobytes() for h in held], pa.binary())], names=["bag", "toxic", "turn", "held"])
    return run


def _train(prior: float, chosen: dict[int, np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, cut in runs(batches, ["bag"]):
            for lo, hi in zip(cut[:-1], cut[1:]):
                g = t.slice(lo, hi - lo)
                f = chosen[g.column("bag")[0].as_py()]
                held = [x for c in g.column("held").chunks for x in _binaries(c, np.int32)]
                w, bias = train_nnpu(held, len(f), g.column("toxic").to_numpy().astype(bool), prior)
                yield pa.RecordBatch.from_pydict({"features": [f.tobytes()], "weights": [w.tobytes()], "bias": [bias]})
    return run


def _score(models: list[tuple[np.ndarray, np.ndarray, float]], default: float, text_col: str, score_col: str):
    tables = [None]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tables[0] is None and models:
            used = np.unique(np.concatenate([f for f, _, _ in models]))
            place = np.full(SPACE, -1, np.int32)
            place[used] = np.arange(len(used))
            weight = np.zeros((len(models), len(used)))
            for i, (f, w, _) in enumerate(models):
                weight[i, place[f]] = w
            tables[0] = place, weight, np.array([b for _, _, b in models])
        for batch in batches:
            for b in slices(batch, text_col):
                score = np.full(b.num_rows, default)
                if models:
                    place, weight, bias = tables[0]
                    text, f = _features(b.column(text_col))
                    at = place[f]
                    hit = at >= 0
                    pair = np.unique(text[hit] * len(weight[0]) + at[hit])
                    text, at = pair // max(1, len(weight[0])), pair % max(1, len(weight[0]))
                    score = np.mean([_sigmoid(bias[i] + np.bincount(text, weight[i, at], minlength=b.num_rows))
                                     for i in range(len(models))], axis=0)
                yield b.append_column(score_col, pa.array(score, pa.float64()))
    return run


def held_out(id_col: Column) -> Column:
    """The fold kept from training: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(id_col.cast("string")) % 5 == 0, F.lit(False))


def fit_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
                 most_positive: int = 12_000, most_unlabelled: int = 36_000, bags: int = 3,
                 keep: int = 1024, most_bytes: int = 256 << 20) -> tuple[list[tuple[np.ndarray, np.ndarray, float]], float]:
    """The classifiers and the class prior, learned outside the held-out fold.

    Bounds: about ``most_positive`` confirmed positives and ``most_unlabelled`` other texts, drawn
    by a hash of the id, and about ``most_bytes`` of hashed features a bag (fewer texts of each kind,
    by a hash, where they are longer), so that a bag fits into a task. The prior is the share of positives among labelled rows of the training
    folds, carried over to the texts that are left when the confirmed positives are taken out.
    Without positives or labels there is no classifier.
    """
    known = (labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(F.col(id_col)))
             .groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).alias("toxic")))
    n, p = known.agg(F.count(F.lit(1)), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not p or p == n:
        return [], (p / n if n else 0.0)
    prior = min(max(p / n, 0.001), 0.5)
    draw = lambda c, share: F.pmod(F.xxhash64(c, F.lit(23)), F.lit(1 << 20)) < int(min(1.0, share) * (1 << 20))
    # bounded by most_positive: at most a few hundred kilobytes
    positive = known.where((F.col("toxic") == 1) & draw("id", most_positive / p)).select("id", F.lit(1).alias("toxic"))
    rows = docs.where(F.col(id_col).isNotNull() & ~held_out(F.col(id_col))).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    total, drawn = rows.count(), positive.count()
    # the drawn positives are not among the unlabelled texts, which so hold fewer; positives that were
    # not drawn still are, whatever is known of them
    prior = min(max((prior * total - drawn) / max(1, total - drawn), 0.001), 0.5)
    rows = rows.join(F.broadcast(positive), "id", "left").withColumn("toxic", F.coalesce("toxic", F.lit(0)))
    sample = rows.where((F.col("toxic") == 1) | draw("id", most_unlabelled / max(1, total)))
    sample = sample.select(F.pmod(F.xxhash64("id", F.lit(5)), F.lit(bags)).cast("int").alias("bag"), "toxic", "text")
    sample = stage_table(sample.mapInArrow(lean(_sample_rows), "bag int, toxic int, feats binary"), "sample")
    size = sample.agg(F.sum(F.length("feats"))).first()[0] or 0
    sample = sample.where(draw("feats", bags * most_bytes / max(1, size)))
    picked = (sample.repartition("bag").sortWithinPartitions("bag")
              .mapInArrow(lean(_pick(keep)), "bag int, features binary").collect())   # a bag is at most ``keep`` numbers
    chosen = {r["bag"]: np.frombuffer(r["features"], np.int64) for r in picked}
    fitted = (sample.select("bag", "toxic", "feats", F.xxhash64("feats").alias("turn"))
              .mapInArrow(lean(_hold(chosen)), "bag int, toxic int, turn bigint, held binary")
              .repartition("bag").sortWithinPartitions("bag", "turn")
              .mapInArrow(lean(_train(prior, chosen)), "features binary, weights binary, bias double").collect())
    return [(np.frombuffer(r["features"], np.int64), np.frombuffer(r["weights"], float), r["bias"]) for r in
            sorted(fitted, key=lambda r: r["bias"])], prior


def score_toxicity(docs: DataFrame, models, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` with a column ``score_col`` (0 to 1), a name that is not taken; all columns stay."""
    return docs.mapInArrow(lean(_score(models, 0.0, text_col, score_col)), StructType([*docs.schema.fields, StructField(score_col, DoubleType())]))


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             label_col: str = "toxic", **how) -> DataFrame:
    """One row per row of ``docs``: (id, held_out, score, predicted).

    Edge cases: null, empty and wordless texts get the classifiers' answer without features; texts of
    any length are scored whole, about a megabyte of them at a time (or one text); equal
    texts get equal scores; without a positive or a negative label every score is 0; rows with a
    null id are scored but never train; an empty table gives an empty result. Other columns,
    source and language among them, are not read.
    """
    ship(docs.sparkSession)
    models, _ = fit_toxicity(docs, labels, id_col, text_col, label_col, **how)
    scored = score_toxicity(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), models)
    return scored.select(F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of ``docs`` whose score is below 0.5, columns and texts as they are."""
    ship(docs.sparkSession)
    models, _ = fit_toxicity(docs, labels, id_col, text_col, **how)
    score = unused(docs, "toxicity_score")
    return score_toxicity(docs, models, text_col, score).where(F.col(score) < 0.5).select(*docs.columns)
