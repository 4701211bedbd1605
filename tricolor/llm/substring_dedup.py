"""Repeated passages across documents by collinear chaining, exact and fuzzy.

1. Seeds: k-word windows, without their last word but one (so that one word changed in every five
   leaves seeds), whose hash is the smallest of ``window`` consecutive ones (minimizers): every common
   run of window + k - 1 words shares a seed.
2. Each seed's first holder (smallest document id) is its anchor; every other occurrence is matched
   with the anchor, not with each other, so matches grow with the text even where thousands of
   documents share a passage. Seeds are exchanged once, packed: a task writes one value per bucket
   of hashes (ids, steps of positions, hash remainders, some 7 bytes a seed), and the bucket's task
   finds first holders and emits the matches. The number of buckets grows with the text and the
   number of rooms with the documents, so a task's memory is bounded whatever a seed's copies are;
   first holders of rooms are matched once more.
   Seeds of one passage may be anchored in different documents, none of which holds all of it.
   Whole windows of ``min_words`` words are therefore matched with their own first holder too: all
   of those whose seeds (smallest hashes of inner windows, the same in every holder) are shared.
   So every exact repeat of ``min_words`` words is found, whatever else holds its parts.
3. Per document and anchor document, matches on one diagonal merge into fragments and fragments are
   chained in order of both texts: a Fenwick tree over the anchor positions holds the best prefix
   score, gaps cost in proportion to the words skipped on both sides.
4. The words around each chain are fetched by two joins, which leave the rows of a text side by side so
   that it is hashed once, and aligned: along fragments word by word,
   between them by a small longest-common-subsequence table, beyond the ends along the diagonal.
   Maximal segments of the alignment with at least ``min_words`` words and ``identity`` matching
   are the passages; where these leave words out, so are the longest stretches that meet both.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tricolor.llm.common import Words, drop_tables, give_back, hash_words, lean, mix, runs, ship, slices, stage_table, text_buffers, unused

SPACED = 6  # seeds of so many words or more leave one out
MAX_GAP = 64
MARGIN = 48
GAP_COST = 0.1
MISMATCH, DROP = 2, 20
REST = 5                   # bytes of a hash that are sent; its other bits choose the bucket
HELD_ROWS = 1 << 20        # rows that a task holds before it sends them
BUCKET_CHARS = 12_000_000  # characters of text whose seeds meet in one bucket, on average
ROOM_DOCS = 1 << 23        # documents whose copies of one seed meet in one task
_CODEC = pa.Codec("zstd")


def _grams(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(seed hash at every position that has k words, pointer per text)."""
    count = np.maximum(np.diff(w.ptr) - k + 1, 0)
    ptr = np.concatenate([[0], np.cumsum(count)])
    at = np.arange(ptr[-1]) - np.repeat(ptr[:-1] - w.ptr[:-1], count)
    acc = np.zeros(len(at), np.uint64)
    for j in range(k):
        if k < SPACED or j != k - 2:
            acc = mix(acc * np.uint64(0x9E3779B97F4A7C15) + w.hash[at + j])
    return acc, ptr


def _minima(h: np.ndarray, window: int) -> tuple[np.ndarray, int]:
    """The leftmost minimum of the windows that start at each row, and the width reached."""
    best, width = np.arange(len(h)), 1
    while width < window and len(best) > width:
        a, b = best[:-width], best[width:]
        best = np.where(h[b] < h[a], b, a)
        width *= 2
    return best, width


def _minimizers(h: np.ndarray, ptr: np.ndarray, window: int) -> np.ndarray:
    """Rows of ``h`` that are the leftmost minimum of some window inside their text; a text with
    fewer hashes than a window gives its minimum. ``window`` is a power of two."""
    best, width = _minima(h, window)
    count = np.diff(ptr)
    picks = []
    if width == window:
        inside = np.zeros(len(h) + 1, np.int64)
        full = count >= window
        np.add.at(inside, ptr[:-1][full], 1)
        np.add.at(inside, ptr[1:][full] - window + 1, -1)
        picks.append(best[(np.cumsum(inside)[:-1] > 0)[:len(best)]])
    for d in np.flatnonzero((count > 0) & (count < window)):
        picks.append([ptr[d] + np.argmin(h[ptr[d]:ptr[d + 1]])])
    return np.unique(np.concatenate(picks)).astype(np.int64) if picks else np.zeros(0, np.int64)


def _seeds(k: int, window: int):
    """Batches of (id, text) -> (id, pos, hash) arrays of their seeds."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        for batch in batches:
            for b in slices(batch, "text"):
                w = hash_words(b.column("text"))
                h, ptr = _grams(w, k)
                at = _minimizers(h, ptr, window)
                doc = np.searchsorted(ptr, at, "right") - 1
                x, pos = h[at], (at - ptr[doc]).astype(np.int32)
                # the n-th holder inside a text is also a seed of its own, matched with n-th holders
                ranked = np.sort(x)
                twice = np.unique(ranked[1:][ranked[1:] == ranked[:-1]])
                own, nth = np.zeros(0, np.int64), np.zeros(0, np.int64)
                if len(twice):
                    place = np.minimum(np.searchsorted(twice, x), len(twice) - 1)
                    rows = np.flatnonzero(twice[place] == x)
                    rows = rows[np.argsort(x[rows], kind="stable")]   # texts and positions stay in order
                    first = np.ones(len(rows), bool)
                    first[1:] = (doc[rows][1:] != doc[rows][:-1]) | (x[rows][1:] != x[rows][:-1])
                    nth = np.arange(len(rows)) - np.maximum.accumulate(np.where(first, np.arange(len(rows)), 0))
                    own, nth = rows[nth > 0], nth[nth > 0]
                    order = np.argsort(own)
                    own, nth = own[order], nth[order]
                x = np.append(x, mix(x[own] + nth.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
                yield b.column("id").to_numpy()[np.append(doc, doc[own])], np.append(pos, pos[own]), x
    return run


def _tiling(pos: np.ndarray, size: int) -> list[int]:
    """Indexes of sorted positions whose windows of ``size`` words cover what all of them cover."""
    keep, end = [], -1
    for i, p in enumerate(pos):
        if not keep or i + 1 == len(pos) or pos[i + 1] > end:
            keep.append(i)
            end = int(p) + size
    return keep


def _windows(k: int, window: int, size: int):
    """Batches of (id, text, live) -> (id, pos, hash) arrays of the windows of ``size`` words whose seeds are all in ``live``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        for batch in batches:
            for b in slices(batch, "text"):
                w = hash_words(b.column("text"))
                h, ptr = _grams(w, k)
                live, grams = np.zeros(len(h), bool), np.diff(ptr)
                at, n = b.column("live"), size - k + 1
                row = np.repeat(np.arange(b.num_rows), at.value_lengths().to_numpy())
                pos = at.flatten().to_numpy()
                live[(ptr[row] + pos)[pos < grams[row]]] = True
                held = live[_minima(h, window)[0]]
                start = np.concatenate([np.arange(lo, hi - n + 1) for lo, hi, words in zip(ptr[:-1], ptr[1:], np.diff(w.ptr)) if words >= size]
                                       or [np.zeros(0, np.int64)])
                for o in {*range(0, n - window, window - 1 or 1), n - window}:
                    start = start[held[start + o]]
                whole = np.zeros(len(start), np.uint64)
                for o in sorted({*range(0, size - k, max(1, k - 2)), max(0, size - k - 1), size - k}):  # every word is in one
                    whole = mix(whole * np.uint64(0x9E3779B97F4A7C15) + h[start + o])
                doc = np.searchsorted(ptr, start, "right") - 1
                # equal windows of one text that overlap: as many as cover the same words
                order = np.lexsort((start, whole, doc))
                d, x = doc[order], whole[order]
                cut = np.flatnonzero(np.append(True, (d[1:] != d[:-1]) | (x[1:] != x[:-1]))) if len(d) else np.zeros(0, np.int64)
                ends = np.append(cut[1:], len(d))
                keep = np.ones(len(d), bool)
                for lo, hi in zip(cut[ends - cut > 1], ends[ends - cut > 1]):
                    keep[lo:hi] = False
                    keep[lo + np.array(_tiling(start[order[lo:hi]], size))] = True
                at = np.sort(order[keep])
                yield b.column("id").to_numpy()[doc[at]], (start[at] - ptr[doc[at]]).astype(np.int32), whole[at]
    return run


def _encode(ids: np.ndarray, pos: np.ndarray, h: np.ndarray) -> bytes:
    """Rows of one bucket, those of an id side by side by pos, as one value: ids and their row counts, steps of the
    positions (byte by byte, compressed together), and the hashes' last REST bytes as they are."""
    new = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
    step = np.diff(pos, prepend=np.int32(0))
    step[new] = pos[new]
    head = b"".join((ids[new].astype(np.int64).tobytes(), np.diff(np.append(new, len(ids))).astype(np.int32).tobytes(),
                     step.astype(np.int32).view(np.uint8).reshape(-1, 4).T.tobytes()))
    small = _CODEC.compress(head, asbytes=True)
    rest = np.ascontiguousarray(h).view(np.uint8).reshape(-1, 8)[:, :REST].tobytes()
    return np.array([len(new), len(ids), len(small)], np.int64).tobytes() + small + rest


def _decode(value: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    docs, rows, size = map(int, np.frombuffer(value, np.int64, 3))
    head = _CODEC.decompress(value[24:24 + size], decompressed_size=12 * docs + 4 * rows, asbytes=True)
    count = np.frombuffer(head, np.int32, docs, 8 * docs)
    step = np.ascontiguousarray(np.frombuffer(head, np.uint8, 4 * rows, 12 * docs).reshape(4, rows).T).view(np.int32).ravel()
    total = np.cumsum(step, dtype=np.int64)
    new = np.cumsum(count) - count
    pos = total - np.repeat(total[new] - step[new], count)
    h = np.zeros((rows, 8), np.uint8)
    h[:, :REST] = np.frombuffer(value, np.uint8, REST * rows, 24 + size).reshape(rows, REST)
    return np.repeat(np.frombuffer(head, np.int64, docs), count), pos.astype(np.int32), h.view(np.uint64).ravel()


def _blocks(ids: np.ndarray, pos: np.ndarray, h: np.ndarray, bucket: np.ndarray) -> pa.RecordBatch:
    """One row per bucket: (bucket, rows), whose rows stay in their order."""
    top = int(bucket.max()) if len(bucket) else 0
    order = np.argsort(bucket.astype(np.uint16 if top < 1 << 16 else np.uint64), kind="stable")
    ids, pos, h, bucket = ids[order], pos[order], h[order], bucket[order]
    cut = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
    ends = np.append(cut[1:], len(bucket))
    return pa.RecordBatch.from_arrays(
        [pa.array(bucket[cut].astype(np.int64)), pa.array([_encode(ids[x:y], pos[x:y], h[x:y]) for x, y in zip(cut, ends)], pa.binary())],
        names=["bucket", "rows"])


def _packed(found, buckets: int, rooms: int):
    """Rows found by a task, per bucket of hashes and room of documents one value; a bounded number at a time."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0

        def out() -> pa.RecordBatch:
            ids, pos, h = (np.concatenate(x) for x in zip(*held))
            held.clear()
            room = mix(ids.astype(np.uint64)) % np.uint64(rooms)
            return _blocks(ids, pos, h, ((h >> np.uint64(8 * REST)) % np.uint64(buckets)) * np.uint64(rooms) + room)

        for rows in found(batches):
            held.append(rows)
            size += len(rows[0])
            del rows
            if size >= HELD_ROWS:
                yield out()
                size = 0
                give_back()
        if size:
            yield out()
    return run


def _matches(rooms: int):
    """Values of a bucket -> every row whose hash several documents hold, with the hash's first holder.

    With several rooms, the first holders of a room go on as one value of the bucket, so that those
    of all rooms are matched once more."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, groups in runs(batches, ["bucket"]):
            values = t.column("rows").to_pylist()
            for x, y in zip(groups[:-1], groups[1:]):
                ids, pos, h = (np.concatenate(c) for c in zip(*map(_decode, values[x:y])))
                order = np.argsort(h)
                ids, pos, h = ids[order], pos[order], h[order]
                cut = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
                count = np.diff(np.append(cut, len(h)))
                # the first holder: the smallest id, and there the smallest position
                a_id = np.minimum.reduceat(ids, cut)
                a_pos = np.minimum.reduceat(np.where(ids == np.repeat(a_id, count), pos, np.iinfo(np.int32).max), cut)
                if rooms > 1:
                    bucket = np.full(len(cut), int(t.column("bucket")[int(x)].as_py()) // rooms)
                    order = np.lexsort((a_pos, a_id))
                    more = _blocks(a_id[order], a_pos[order], h[cut][order], bucket)
                    none = [pa.nulls(1, kind) for kind in (pa.int64(), pa.int32(), pa.int64(), pa.int32())]
                    yield pa.RecordBatch.from_arrays([*none, *more.columns], names=_MATCH)
                shared = a_id != np.maximum.reduceat(ids, cut)
                rows = np.flatnonzero(np.repeat(shared, count))
                first = np.repeat(np.flatnonzero(shared), count[shared])
                order = np.lexsort((a_id[first], ids[rows]))
                rows, first = rows[order], first[order]
                for at in range(0, len(rows), 100_000):
                    r, f = rows[at:at + 100_000], first[at:at + 100_000]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ids[r]), pa.array(pos[r]), pa.array(a_id[f]), pa.array(a_pos[f]), pa.nulls(len(r), pa.int64()), pa.nulls(len(r), pa.binary())],
                        names=_MATCH)
    return run


_MATCH = ["id", "pos", "a_id", "a_pos", "bucket", "rows"]


def _shared(source: DataFrame, found, buckets: int, rooms: int, name: str) -> DataFrame:
    """(id, pos, a_id, a_pos) of rows whose hash several documents hold: one exchange of packed rows
    by bucket of hashes (and one of the rooms' first holders, where there are several rooms)."""
    schema = "id long, pos int, a_id long, a_pos int, bucket long, rows binary"

    def matched(blocks: DataFrame, rooms: int) -> DataFrame:
        return blocks.repartitionById(buckets * rooms, F.col("bucket").cast("int")).sortWithinPartitions("bucket").mapInArrow(lean(_matches(rooms)), schema)

    out = stage_table(matched(source.mapInArrow(lean(_packed(found, buckets, rooms)), "bucket long, rows binary"), rooms), name)
    rows = out.where("id is not null").drop("bucket", "rows")
    if rooms == 1:
        return rows
    return rows.unionByName(stage_table(matched(out.where("id is null").select("bucket", "rows"), 1), name).drop("bucket", "rows"))


class _PrefixBest:
    """Fenwick tree: best (score, item) over positions up to a given one."""

    def __init__(self, n: int):
        self.score, self.item = [-1e18] * (n + 1), [-1] * (n + 1)

    def put(self, at: int, score: float, item: int) -> None:
        at += 1
        while at < len(self.score):
            if score > self.score[at]:
                self.score[at], self.item[at] = score, item
            at += at & -at

    def best(self, upto: int) -> tuple[float, int]:
        score, item = -1e18, -1
        while upto > 0:
            if self.score[upto] > score:
                score, item = self.score[upto], self.item[upto]
            upto -= upto & -upto
        return score, item


def chain(b0: np.ndarray, b1: np.ndarray, a0: np.ndarray, a1: np.ndarray) -> list[list[int]]:
    """Disjoint collinear chains of fragments [b0, b1) x [a0, a1), best first.

    A fragment may follow one that ends before it starts in both texts; it scores its length, less
    GAP_COST per word skipped on either side.
    """
    n = len(b0)
    if n == 1:
        return [[0]]
    ends = np.unique(a1)
    rank_end = np.searchsorted(ends, a1)
    upto = np.searchsorted(ends, a0, "right")
    tree, score, back = _PrefixBest(len(ends)), [0.0] * n, [-1] * n
    by_end, waiting = np.argsort(b1, kind="stable"), 0
    for i in np.lexsort((a0, b0)):
        while waiting < n and b1[by_end[waiting]] <= b0[i]:
            j = by_end[waiting]
            tree.put(int(rank_end[j]), score[j] + GAP_COST * float(a1[j] + b1[j]), int(j))
            waiting += 1
        best, j = tree.best(int(upto[i]))
        best -= GAP_COST * float(a0[i] + b0[i])
        score[i] = float(b1[i] - b0[i]) + max(0.0, best)
        back[i] = j if best > 0 else -1
    used, out = [False] * n, []
    for i in np.argsort(-np.array(score), kind="stable"):
        path, at = [], int(i)
        while at >= 0 and not used[at]:
            used[at] = True
            path.append(at)
            at = back[at]
        if path:
            out.append(path[::-1])
    return out


def _chains(k: int, margin: int, min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, _ in runs(batches, ["id"], 50_000):
            doc, anchor = t.column("id").to_numpy(), t.column("a_id").to_numpy()
            pos, a_pos = t.column("pos").to_numpy().astype(np.int64), t.column("a_pos").to_numpy().astype(np.int64)
            # a whole window counts as the seeds at its two ends
            size = t.column("size").to_numpy().astype(np.int64)
            n = np.where(size > k, 2, 1)
            end = np.repeat(size - k, n)
            end[np.cumsum(n) - n] = 0
            doc, anchor, pos, a_pos = np.repeat(doc, n), np.repeat(anchor, n), np.repeat(pos, n) + end, np.repeat(a_pos, n) + end
            # by diagonal inside a pair, so that a repeated seed does not break a run
            order = np.lexsort((pos, pos - a_pos, anchor, doc))
            doc, anchor, pos, a_pos = doc[order], anchor[order], pos[order], a_pos[order]
            pair = np.ones(len(doc), bool)
            pair[1:] = (doc[1:] != doc[:-1]) | (anchor[1:] != anchor[:-1])
            group = np.cumsum(pair)
            new = np.ones(len(doc), bool)
            new[1:] = (group[1:] != group[:-1]) | (pos[1:] != pos[:-1]) | (a_pos[1:] != a_pos[:-1])
            doc, anchor, pos, a_pos, group = doc[new], anchor[new], pos[new], a_pos[new], group[new]
            cut = np.ones(len(doc), bool)
            cut[1:] = (group[1:] != group[:-1]) | (pos[1:] - a_pos[1:] != pos[:-1] - a_pos[:-1]) | (pos[1:] - pos[:-1] > MAX_GAP)
            f = np.flatnonzero(cut)
            last = np.append(f[1:], len(doc)) - 1
            seeds, b0, b1, a0, a1 = last - f + 1, pos[f], pos[last] + 1, a_pos[f], a_pos[last] + 1
            group = group[f]
            lo = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
            out: dict[str, list] = {c: [] for c in ("id", "a_id", "path")}
            for x, y in zip(lo, np.append(lo[1:], len(f))):
                for c in chain(b0[x:y], b1[x:y], a0[x:y], a1[x:y]):
                    c = np.array(c) + x
                    if seeds[c].sum() >= 2 and b1[c[-1]] + k - b0[c[0]] + 2 * margin >= min_words:
                        out["id"].append(int(doc[f[x]]))
                        out["a_id"].append(int(anchor[f[x]]))
                        out["path"].append(np.stack([b0[c], b1[c] - 1 + k, a0[c]], axis=1).ravel().tolist())
            yield pa.RecordBatch.from_arrays([pa.array(out["id"], pa.int64()), pa.array(out["a_id"], pa.int64()),
                                              pa.array(out["path"], pa.list_(pa.int64()))], names=["id", "a_id", "path"])
    return run


def _common(b: np.ndarray, a: np.ndarray) -> list[tuple[int, int]]:
    """Matched pairs of a longest common subsequence of two short runs."""
    n, m = len(b), len(a)
    if not n or not m or n > MAX_GAP or m > MAX_GAP:
        return []
    b, a = b.tolist(), a.tolist()
    if set(b).isdisjoint(a):
        return []
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        row, down = best[i], best[i + 1]
        for j in range(m - 1, -1, -1):
            row[j] = down[j + 1] + 1 if b[i] == a[j] else max(down[j], row[j + 1])
    out, i, j = [], 0, 0
    while i < n and j < m:
        if b[i] == a[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


def align(b: np.ndarray, a: np.ndarray, path: list[tuple[int, int, int]]) -> np.ndarray:
    """For every word of ``b`` the word of ``a`` it is aligned and equal to, or -1.

    ``path`` has the chain's fragments (start in b, end in b, start in a), in local positions.
    """
    to = np.full(len(b), -1, np.int64)

    def diagonal(lo: int, hi: int, shift: int) -> None:
        lo, hi = max(lo, 0, -shift), min(hi, len(b), len(a) - shift)
        if hi > lo:
            at = np.arange(lo, hi)
            same = at[b[lo:hi] == a[lo + shift:hi + shift]]
            to[same] = same + shift

    if len(path) == 1:
        diagonal(0, len(b), path[0][2] - path[0][0])
        return to
    diagonal(0, path[0][0], path[0][2] - path[0][0])
    done_b = done_a = None
    for lo, hi, x in path:
        shift = x - lo
        if done_b is not None:
            skip = max(0, done_b - lo, done_a - x)  # fragments may overlap by less than a seed
            lo, x = lo + skip, x + skip
            if max(lo - done_b, x - done_a) > MAX_GAP:  # each side goes on along its own diagonal
                half = min(lo - done_b, x - done_a) // 2
                diagonal(done_b, done_b + half, done_a - done_b)
                diagonal(lo - half, lo, shift)
            for i, j in _common(b[done_b:lo], a[done_a:x]):
                to[done_b + i] = done_a + j
        diagonal(lo, hi, shift)
        done_b, done_a = max(lo, hi), max(x, hi + shift)
    diagonal(done_b, len(b), done_a - done_b)
    return to


def segments(match: np.ndarray) -> list[tuple[int, int]]:
    """Maximal segments that begin and end with a match: a match scores 1, a mismatch -MISMATCH, and
    a segment ends where the score has fallen by more than DROP."""
    at = np.flatnonzero(match)
    if not len(at):
        return []
    # run by run of matches without a gap, inside which the score only rises
    gap = np.flatnonzero(np.diff(at) > 1)
    first, last = at[np.append(0, gap + 1)].tolist(), at[np.append(gap, len(at) - 1)].tolist()
    start, end = first[0], last[0]
    out, score, best = [], end + 1 - start, end + 1 - start
    for p, q, r in zip(last[:-1], first[1:], last[1:]):
        score -= MISMATCH * (q - p - 1)
        if best - score > DROP or score <= 0:
            out.append((start, end + 1))
            start, score, best = q, 0, 0
        score += r + 1 - q
        if score >= best:
            best, end = score, r
    out.append((start, end + 1))
    return out


def stretches(match: np.ndarray, least: int, identity: float) -> list[tuple[int, int]]:
    """For every match the longest stretch from it, ending with a match, of at least ``least`` words
    of which at least ``identity`` match; only those that reach further than the ones before."""
    at = np.flatnonzero(match)
    if not len(at):
        return []
    i = np.arange(len(at))
    start, end = i - identity * at, i + 1 - identity * (at + 1)
    after = np.maximum.accumulate(end[::-1])[::-1]  # falls, so that the last end at or over a start is found by bisection
    last = np.searchsorted(-after, -start + 1e-9, "right") - 1
    out, reach = [], 0
    for lo, j in zip(at, last):
        if j >= 0 and at[j] + 1 - lo >= least and at[j] + 1 > reach:
            reach = int(at[j]) + 1
            out.append((int(lo), reach))
    return out


def exact_runs(b: np.ndarray, a: np.ndarray, path: list[tuple[int, int, int]], least: int) -> list[tuple[int, int, int]]:
    """Unbroken equal runs (start in b, end in b, start in a) of ``least`` words or more in a chain's fragments."""
    out = []
    for lo, hi, x in path:
        skip = max(0, -lo, -x)
        lo, x = lo + skip, x + skip
        hi = min(hi, len(b), len(a) - x + lo)
        if hi - lo >= least:
            step = np.diff(np.concatenate([[False], b[lo:hi] == a[x:x + hi - lo], [False]]).astype(np.int8))
            out += [(lo + int(s), lo + int(e), x + int(s)) for s, e in zip(np.flatnonzero(step == 1), np.flatnonzero(step == -1)) if e - s >= least]
    return out


def _texts(ids: np.ndarray, column: pa.Array) -> tuple[Words, np.ndarray]:
    """(words, text of every row): a text that stands in several rows on end is hashed once."""
    data, o = text_buffers(column)
    size, new = np.diff(o), np.ones(len(ids), bool)
    for i in np.flatnonzero((ids[1:] == ids[:-1]) & (size[1:] == size[:-1])) + 1:
        new[i] = not np.array_equal(data[o[i - 1]:o[i]], data[o[i]:o[i + 1]])
    return hash_words(column.take(pa.array(np.flatnonzero(new)))), np.cumsum(new) - 1


def _around(w: Words, text: np.ndarray, off: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and end of ``n`` words from the ``off``-th of every row's text, as far as it has them."""
    lo, hi = w.ptr[text], w.ptr[text + 1]
    return np.minimum(lo + off, hi), np.minimum(lo + off + n, hi)


def _anchor_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chains with their anchor's whole ``text`` -> the chains with the part around each, ``a_text``."""
    for batch in batches:
        for r in slices(batch, "text"):
            w, text = _texts(r.column("a_id").to_numpy(), r.column("text"))
            lo, hi = _around(w, text, r.column("a_off").to_numpy(), r.column("a_len").to_numpy())
            part = [w.data[w.start[x]:w.end[y - 1]].tobytes() if y > x else b"" for x, y in zip(lo.tolist(), hi.tolist())]
            yield pa.RecordBatch.from_arrays([*(r.column(c) for c in _CHAIN), pa.array(part, pa.binary()).cast(pa.string())], names=[*_CHAIN, "a_text"])


_CHAIN = ["id", "a_id", "path", "b_off", "b_len", "a_off"]


def _passages(min_words: int, identity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in slices(batch, "text"):
                ids, a_ids, b_off, a_off = (r.column(c).to_numpy() for c in ("id", "a_id", "b_off", "a_off"))
                wb, text = _texts(ids, r.column("text"))
                wa = hash_words(r.column("a_text"))
                lows, highs = _around(wb, text, b_off, r.column("b_len").to_numpy())
                found = []
                for i, path in enumerate(r.column("path").to_pylist()):
                    b, a = wb.hash[lows[i]:highs[i]], wa.hash[wa.ptr[i]:wa.ptr[i + 1]]
                    p = np.array(path).reshape(-1, 3) - [b_off[i], b_off[i], a_off[i]]
                    p = [tuple(x) for x in p.tolist()]
                    to, done = align(b, a, p), np.zeros(len(b), bool)
                    match = to >= 0
                    at = np.flatnonzero(match)
                    for step in (segments, lambda x: stretches(x, min_words, identity)):
                        if len(at) < identity * min_words or done[at[0]:at[-1] + 1].all():
                            break   # nothing that begins and ends with a match is left
                        inside = done.copy()
                        for lo, hi in step(match):
                            if hi - lo < min_words or inside[lo:hi].all():
                                continue
                            hit = to[lo:hi]
                            hit = hit[hit >= 0]
                            x, y = int(hit[0]), int(hit[-1]) + 1
                            if len(hit) >= identity * max(hi - lo, y - x):
                                found.append((ids[i], lo + b_off[i], hi + b_off[i], a_ids[i], x + a_off[i], y + a_off[i], len(hit)))
                                done[lo:hi] = True
                    # what the alignment spent on other fragments, or joined to too poor a segment
                    p = [x for x in p if not done[max(0, x[0]):max(0, x[1])].all()]
                    for lo, hi, x in exact_runs(b, a, p, min_words):
                        if not done[lo:hi].all():
                            found.append((ids[i], lo + b_off[i], hi + b_off[i], a_ids[i], x + a_off[i], x + hi - lo + a_off[i], hi - lo))
                cols = np.array(found, np.int64).reshape(-1, 7).T
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in cols], names=_FIELDS)
    return run


_FIELDS = ["id", "start", "end", "source_id", "source_start", "source_end", "matched"]


def repeated_passages(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 50, identity: float = 0.8,
                      k: int = 6, window: int = 2) -> DataFrame:
    """One row per passage: (id, start, end, source_id, source_start, source_end, matched).

    Words [start, end) of document ``id`` repeat words [source_start, source_end) of document
    ``source_id``, which has a smaller id; ``matched`` words are equal (A-Z lower-cased) and
    aligned, at least ``identity`` of the longer side. A document that shares one passage with many
    has a row for the first holder of it, not one for each.

    Edge cases: null and empty texts and texts of fewer than k words have no passages; rows with a null id are left
    out; rows that share an id are one document to the search, and each is aligned; repeated rows give the same
    passage once; an empty table gives an empty result. Other columns are not read.
    """
    spark = df.sparkSession
    ship(spark)
    docs = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")).where("id is not null and text is not null")
    k = min(k, min_words)
    window = min(window, 1 << (min_words - k + 1).bit_length() - 1)
    size = docs.agg(F.sum(F.length("text")).alias("chars"), F.count(F.lit(1)).alias("docs")).first()
    spread = (max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(size["chars"] or 0) // BUCKET_CHARS)), max(1, -(-size["docs"] // ROOM_DOCS)))
    shared = _shared(docs, _seeds(k, window), *spread, "shared")
    drop_tables(spark)
    live = shared.groupBy("id").agg(F.collect_set("pos").alias("live"))
    whole = _shared(live.join(docs, "id").select("id", "text", "live"), _windows(k, window, min_words), *spread, "windows")
    drop_tables(spark)
    links = shared.withColumn("size", F.lit(k)).unionByName(whole.withColumn("size", F.lit(min_words))).where("id <> a_id")
    margin = MARGIN
    chains = stage_table(links.repartition("id").sortWithinPartitions("id")
                         .mapInArrow(lean(_chains(k, margin, min_words)), "id long, a_id long, path array<long>"), "chains")
    del live, links
    drop_tables(spark, shared, whole)
    last = F.element_at("path", -2)
    b_off = F.greatest(F.col("path")[0] - margin, F.lit(0))
    a_off = F.greatest(F.col("path")[2] - margin, F.lit(0))
    b_len = last + margin - b_off
    a_len = F.element_at("path", -1) + last - F.element_at("path", -3) + margin - a_off
    # the joins leave the rows of a text side by side, which is hashed once for all of them
    with_a = (chains.withColumn("b_off", b_off).withColumn("a_off", a_off).withColumn("b_len", b_len).withColumn("a_len", a_len)
              .join(docs.withColumnRenamed("id", "a_id"), "a_id").select(*_CHAIN, "a_len", "text")
              .mapInArrow(lean(_anchor_parts), "id long, a_id long, path array<long>, b_off long, b_len long, a_off long, a_text string"))
    found = (with_a.join(docs, "id").select(*_CHAIN, "a_text", "text")
             .mapInArrow(lean(_passages(min_words, identity)), ", ".join(f"{c} long" for c in _FIELDS)))
    return found.distinct().withColumnRenamed("id", id_col)


def _cut(schema: list[str], text_col: str, spans_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = b.column(text_col)
            texts = column.to_pylist()
            spans = b.column(spans_col).to_pylist()
            rows = [i for i, s in enumerate(spans) if s and texts[i]]
            if rows:
                w = hash_words(column.take(pa.array(rows)))
                for n, i in enumerate(rows):
                    first, end = int(w.ptr[n]), int(w.bounds[n + 1])
                    keep, at = [], int(w.bounds[n])
                    for lo, hi in sorted((s["start"], s["end"]) for s in spans[i]):
                        lo_byte = int(w.start[first + lo]) if first + lo < w.ptr[n + 1] else end
                        hi_byte = int(w.start[first + hi]) if first + hi < w.ptr[n + 1] else end
                        if lo_byte > at:
                            keep.append(w.data[at:lo_byte].tobytes())
                        at = max(at, hi_byte)
                    keep.append(w.data[at:end].tobytes())
                    texts[i] = b"".join(keep).decode()
            yield pa.RecordBatch.from_arrays([pa.array(texts, column.type) if c == text_col else b.column(c) for c in schema], names=schema)
    return run


def cut_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of ``df`` with repeated passages cut out of all documents but their first holder.

    Every row stays, with its other columns (``n_chars``, where there is one, is counted again); a
    document that is nothing but repeated passages keeps an empty text. Null ids and null texts stay as
    they are, and so do columns of any name.
    """
    found = repeated_passages(df, id_col, text_col, **how)
    key, held = unused(df, "cut_id"), unused(df, "cut_spans")
    spans = stage_table(found.groupBy(F.col(id_col).alias(key)).agg(F.collect_list(F.struct("start", "end")).alias(held)), "spans")
    joined = df.join(spans, df[id_col] == spans[key], "left").drop(key)
    cut = joined.mapInArrow(lean(_cut(df.columns, text_col, held)), df.schema)
    if "n_chars" in df.columns:
        cut = cut.withColumn("n_chars", F.coalesce(F.length(text_col).cast(df.schema["n_chars"].dataType), F.col("n_chars")))
    return cut.select(*df.columns)
