"""MinHash near-duplicate detection by a chosen-path set similarity join.

Documents are sets of distinct k-word shingles. The join recurses over *nodes*: a node is a path
of (signature position, minimum token) choices, and it holds the documents that agree with the
whole path. Every node picks ``branch`` signature positions from its own path hash; each of its
documents follows the branch of its minimum token there. Nodes of at most ``leaf`` documents are
compared exhaustively, larger ones branch on, and ``trees`` independent trees repeat the descent.
Two documents of similarity s part ways in one tree with probability q = (1 - s (1 - q))**branch
at most (1/16 for s = 0.8 and branch 2), so four trees miss a link of exactly 0.8 about once in
65,000 and closer pairs less.

Plan, chosen for bounded memory with groups of any size:

1. one pass makes size, set fingerprint and signature; documents with equal sets form a class and
   only its smallest id goes on (a third of all rows may be one class);
2. nodes are rows (path, id); counts are pre-aggregated; leaves are streamed in path order and
   compared on 4-bit sketches, keeping those within four standard deviations of the threshold as
   *star* edges. Before a large node branches on, its documents are compared with its smallest id:
   those very close to it are linked to it and go no further down, so that a group of near copies
   is not followed along every path. No link is lost: sketch distances obey the triangle
   inequality, so whatever a leaf would link to one that stopped is itself near the smallest id,
   and is linked to it at that wider distance while it goes on. A node that is still large at
   ``depth`` links its documents to its smallest id without comparing (both wider links can only
   make the next groups coarser, never lose a link);
3. components of these edges are disjoint candidate groups; the texts of their members are read
   again and links are decided on the full sets. Groups up to ``block`` documents are one block;
   larger ones are salted into blocks, and ``pivots`` members go along with every block, which
   joins what the blocks found. Documents that then are not in the largest component of their
   group are compared with every block of the group, as a stated query set: no pair that could
   join two components stays untested, and pairs inside one component need no test. The queries are
   dealt into blocks too (*rooms*), so that a task holds one block of members and one of queries.

The result never depends on a candidate or partner cap. Tables that grow with the corpus are joined by
shuffles, so that none goes through the driver; Spark may broadcast those with a row for each large node or
large group, and the ids whose texts or signatures need not be shuffled for them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tricolor.llm.common import (binary_rows, fixed_binary, hash_words, lean, long_array, mix, runs, shingle_hashes,
                                 ship, slices, stage_table)
from tricolor.llm.components import connected_components

POSITIONS = 128
_U = np.uint64


def _signatures(k: int):
    rng = np.random.default_rng(977)
    mul = rng.integers(0, 1 << 31, POSITIONS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    add = rng.integers(0, 1 << 32, POSITIONS, dtype=np.uint32)

    def signature(h: np.ndarray) -> np.ndarray:
        low = np.full(POSITIONS, np.uint32(0xFFFFFFFF))
        h = (h >> _U(32)).astype(np.uint32)
        for at in range(0, len(h), 4096):
            x = h[at:at + 4096, None] * mul + add
            x ^= x >> np.uint32(15)
            x *= np.uint32(0x2C1B3C6D)
            low = np.minimum(low, x.min(axis=0))
        return low

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch, "text"):
                sh, ptr = shingle_hashes(hash_words(b.column("text")), k)
                size = np.zeros(b.num_rows, np.int64)
                mark = np.zeros((b.num_rows, 2), np.uint64)
                sig = np.zeros((b.num_rows, POSITIONS), np.uint32)
                for d in range(b.num_rows):
                    s = np.unique(sh[ptr[d]:ptr[d + 1]])
                    size[d] = len(s)
                    if len(s):
                        mark[d] = s.sum(dtype=np.uint64), mix(s + _U(0x632BE59BD9B4E019)).sum(dtype=np.uint64)
                        sig[d] = signature(s)
                yield pa.RecordBatch.from_arrays(
                    [b.column("id"), pa.array(size), fixed_binary(np.hstack([mark, size[:, None].view(np.uint64)])),
                     fixed_binary(sig)], names=["id", "n", "mark", "sig"])
    return run


def _children(branch: int, levels: int = 1):
    """(path, id, sig) -> the rows (path, id) that many levels below; roots are small numbers."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            sig = binary_rows(b.column("sig"), np.uint32, POSITIONS)
            path = b.column("path").to_numpy().view(np.uint64)
            rows = np.arange(b.num_rows)
            for _ in range(levels):
                # the branch positions are distinct: an odd step through a power-of-two count
                h, out = mix(path * _U(0x9E3779B97F4A7C15) + _U(0x51ED2701)), []
                for j in range(branch):
                    at = ((h >> _U(8)) + _U(j) * ((h >> _U(32)) | _U(1))) % _U(POSITIONS)
                    token = sig[rows, at.astype(np.int64)].astype(np.uint64)
                    out.append(mix(path ^ mix(token + (at << _U(40)) + _U(1 << 56))))
                path, rows = np.concatenate(out), np.tile(rows, branch)
            yield pa.RecordBatch.from_arrays([long_array(path), pa.array(b.column("id").to_numpy()[rows])], names=["path", "id"])
    return run


def _packed(column) -> np.ndarray:
    """4-bit sketches of signatures, two positions in a byte."""
    nib = (binary_rows(column, np.uint32, POSITIONS) >> np.uint32(11)).astype(np.uint8) & 15
    return nib[:, ::2] << 4 | nib[:, 1::2]


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column("id"), fixed_binary(_packed(b.column("sig")))], names=["id", "sketch"])


def _branch_on(branch: int, core: int, shell: int):
    """(path, id, low, sketch of low, sig), rows of large nodes -> (path, id, low): the rows (path, id)
    two levels below of documents that differ from low in more than ``core`` positions, and an edge
    (id, low), without a path, for every other document that differs in ``shell`` at most."""
    below = _children(branch, 2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            diff = _packed(b.column("sig")) ^ binary_rows(b.column("sketch"), np.uint8, POSITIONS // 2)
            apart = np.count_nonzero(diff >> 4, axis=1) + np.count_nonzero(diff & 15, axis=1)
            id, low = b.column("id").to_numpy(), b.column("low").to_numpy()
            edge = (apart <= shell) & (id != low)
            none = pa.nulls(int(edge.sum()), pa.int64())
            yield pa.RecordBatch.from_arrays([none, pa.array(id[edge]), pa.array(low[edge])], names=["path", "id", "low"])
            for c in below(iter([b.filter(pa.array(apart > core))])):
                yield pa.RecordBatch.from_arrays([*c.columns, pa.nulls(c.num_rows, pa.int64())], names=["path", "id", "low"])
    return run


def _min_labels(link: np.ndarray) -> np.ndarray:
    """Smallest reachable index for boolean adjacency (groups, n, n)."""
    n = link.shape[-1]
    link = link | np.eye(n, dtype=bool)
    lab = np.broadcast_to(np.arange(n, dtype=np.int32), link.shape[:-1]).copy()
    while True:
        new = np.where(link, lab[..., None, :], n).min(axis=-1).astype(np.int32)
        if np.array_equal(new, lab):
            return lab
        lab = new


def _leaf_edges(least: int):
    """Star edges of every leaf: rows sorted by (path, id) with a sketch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, cut in runs(batches, ["path"], 20_000):
            ids = t.column("id").to_numpy()
            packed = binary_rows(t.column("sketch"), np.uint8, POSITIONS // 2)
            sketch = np.empty((len(ids), POSITIONS), np.uint8)
            sketch[:, ::2], sketch[:, 1::2] = packed >> 4, packed & 15
            size, out = np.diff(cut), []
            for s in np.unique(size[size > 1]):
                groups = cut[:-1][size == s]
                i, j = np.triu_indices(int(s), 1)
                step = max(1, (16 << 20) // (len(i) * POSITIONS))
                for g in range(0, len(groups), step):
                    rows = groups[g:g + step, None] + np.arange(s)
                    x = sketch[rows]
                    near = (x[:, i] == x[:, j]).sum(axis=2, dtype=np.int16) >= least
                    link = np.zeros((len(rows), s, s), bool)
                    link[:, i, j] = near
                    link[:, j, i] = near
                    lab = _min_labels(link)
                    own = ids[rows]
                    root = np.take_along_axis(own, lab, axis=1)
                    keep = root != own
                    out.append(np.stack([own[keep], root[keep]]))
            e = np.concatenate(out, axis=1) if out else np.zeros((2, 0), np.int64)
            e = np.unique(e, axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(e[0]), pa.array(e[1])], names=["a", "b"])
    return run


def _overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """All pairwise intersection sizes of a block: tokens held by one set alone are put aside, the
    rest become a 0/1 matrix in column slabs."""
    n = len(sets)
    if n == 2:
        both = np.intersect1d(sets[0], sets[1], assume_unique=True).size
        return np.array([[len(sets[0]), both], [both, len(sets[1])]], float)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    token, col, held = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = held[col] > 1
    owner, col = owner[shared], np.cumsum(held > 1)[col[shared]] - 1
    order = np.argsort(col, kind="stable")
    owner, col = owner[order], col[order]
    out, width = np.zeros((n, n)), max(256, (8 << 20) // n)
    for at in range(0, int(col[-1]) + 1 if len(col) else 0, width):
        lo, hi = np.searchsorted(col, [at, at + width])
        x = np.zeros((n, min(width, int(col[-1]) + 1 - at)), np.float32)
        x[owner[lo:hi], col[lo:hi] - at] = 1
        out += x @ x.T
    return out


def _confirmed(k: int, percent: int, queries: bool):
    """Exact links of each block: rows sorted by (grp, block, room), all of room 0 but for queries; the result is star edges.

    role 0: a member of the block, 1: a pivot or, with ``queries``, a stated query row that is only
    compared with members, skipping pairs that already share a component (column ``comp``).
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, cut in runs(batches, ["grp", "block", "room"]):
            for lo, hi in zip(cut[:-1], cut[1:]):
                g = t.slice(lo, hi - lo).combine_chunks()
                if g.num_rows < 2:
                    continue
                ids = g.column("id").to_numpy()
                w = hash_words(g.column("text"))
                sh, ptr = shingle_hashes(w, k)
                sets = [np.unique(sh[ptr[d]:ptr[d + 1]]) for d in range(len(ids))]
                if queries:
                    role, comp = g.column("role").to_numpy(), g.column("comp").to_numpy()
                    edges = _query_links(sets, role, comp, percent)
                else:
                    n = np.array([len(s) for s in sets], float)
                    both = _overlaps(sets)
                    link = 100 * both >= percent * (n[:, None] + n[None, :] - both)
                    link[n == 0] = False
                    link[:, n == 0] = False
                    order = np.argsort(ids, kind="stable")
                    lab = _min_labels(link[np.ix_(order, order)][None])[0]
                    own = ids[order]
                    edges = np.stack([own, own[lab]])[:, own[lab] != own]
                yield pa.RecordBatch.from_arrays([pa.array(edges[0]), pa.array(edges[1])], names=["a", "b"])
    return run


def _query_links(sets, role, comp, percent) -> np.ndarray:
    members, asked = np.flatnonzero(role == 0), np.flatnonzero(role == 1)
    out = []
    for part in range(0, len(asked), 64):
        q = asked[part:part + 64]
        both = _overlaps([sets[i] for i in (*members, *q)])[len(members):, :len(members)]
        nq = np.array([len(sets[i]) for i in q], float)[:, None]
        nm = np.array([len(sets[i]) for i in members], float)[None, :]
        link = (100 * both >= percent * (nq + nm - both)) & (comp[q][:, None] != comp[members][None, :]) & (nq > 0) & (nm > 0)
        i, j = np.nonzero(link)
        out.append(np.stack([comp[q[i]], comp[members[j]]]))
    return np.unique(np.concatenate(out, axis=1), axis=1) if out else np.zeros((2, 0), np.int64)


def _by_block(rows: DataFrame, fn) -> DataFrame:
    return (rows.repartition("grp", "block", "room").sortWithinPartitions("grp", "block", "room", "id")
            .mapInArrow(lean(fn), "a long, b long"))


def _rooms(comp: DataFrame, rest: DataFrame, sizes: DataFrame, block: int, block_shingles: int) -> DataFrame:
    """(grp, block, room, id, comp, role): the members of every block of a group (role 0) beside every
    room of its queries ``rest`` (role 1), a room being about a block's worth of documents and shingles."""
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))
    many = stage_table(rest.join(sizes.hint("merge"), "id").groupBy("grp")
                       .agg(F.greatest(F.ceil(F.count(F.lit(1)) / block), F.ceil(F.sum("n") / block_shingles)).alias("rooms")), "rooms")
    asked = (rest.join(many, "grp").withColumn("room", F.pmod(F.xxhash64("id", F.lit(11)), F.col("rooms")))
             .select("grp", upto("blocks").alias("block"), "room", "id", "comp", F.lit(1).alias("role")))
    held = comp.join(many, "grp").select("grp", "block", upto("rooms").alias("room"), "id", "comp", F.lit(0).alias("role"))
    return held.unionByName(asked)


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5,
                    percent: int = 80, trees: int = 4, branch: int = 2, leaf: int = 64, depth: int = 5,
                    block: int = 256, block_shingles: int = 500_000, pivots: int = 8) -> DataFrame:
    """One row per row of ``df``: (id, n_shingles, component_id, kept).

    Two documents are linked if 100 * |A and B| >= percent * |A or B| on their sets of distinct
    k-word shingles; ``component_id`` is the smallest id reachable over links, ``kept`` marks the
    row(s) whose id it is. Edge cases: a null text counts as empty; an empty text or one without
    words has no shingles and no links; a text of fewer than k words has its whole sequence as one
    shingle; rows with the same id count as one document (their links are united); a row with a
    null id has no links, a null ``component_id`` and is kept. An empty table gives an empty one;
    other columns, whatever their names, are not read.
    """
    spark = df.sparkSession
    ship(spark)
    docs = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    signed = stage_table(docs.mapInArrow(lean(_signatures(k)), "id long, n long, mark binary, sig binary"), "sig")
    classes = stage_table(signed.where("n > 0 and id is not null").groupBy("mark")
                          .agg(F.min(F.struct("id", "n", "sig")).alias("x")).select("mark", "x.id", "x.n", "x.sig"), "classes")

    s = percent / 100
    p = s + (1 - s) / 16
    least = int(np.floor(POSITIONS * p - 4 * np.sqrt(POSITIONS * p * (1 - p))))
    apart = POSITIONS - least   # of two linked documents at most
    core = min(2 * apart // 3, 3 * POSITIONS // 5 - apart)   # core + apart is far from what unlike documents show

    # -- descent: rows (path, id) of one level at a time, large nodes only going on
    roots = classes.select(F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(trees).cast("bigint"))).alias("path"), "id", "sig")
    level = stage_table(roots.mapInArrow(lean(_children(branch)), "path long, id long"), "nodes")
    small, edges = [], []
    for d in range(1, depth + 1, 2):
        sizes = level.groupBy("path").agg(F.count(F.lit(1)).alias("size"), F.min("id").alias("low")).where("size > 1")
        sized = stage_table(level.join(sizes.hint("merge"), "path"), "sized")
        small.append(sized.where(F.col("size") <= leaf).select("path", "id"))
        big = sized.where(F.col("size") > leaf)
        if d + 2 > depth:
            edges.append(big.where("id <> low").select(F.col("id").alias("a"), F.col("low").alias("b")))
        elif big.isEmpty():
            break
        else:
            # written first: Spark then knows how few these mostly are, and need not shuffle the signatures for them
            heads = stage_table(big.where("id = low").select("id"), "heads")
            lows = stage_table(classes.select("id", "sig").join(heads, "id", "left_semi")
                               .mapInArrow(lean(_sketch), "id long, sketch binary"), "lows").withColumnRenamed("id", "low")
            told = stage_table(big.select("path", "id", "low").join(lows, "low").join(classes.select("id", "sig"), "id")
                               .select("path", "id", "low", "sketch", "sig")
                               .mapInArrow(lean(_branch_on(branch, core, core + apart if core >= 0 else -1)), "path long, id long, low long"), "nodes")
            edges.append(told.where("path is null").select(F.col("id").alias("a"), F.col("low").alias("b")))
            level = told.where("path is not null").select("path", "id")
    leaves = small[0]
    for s in small[1:]:
        leaves = leaves.unionByName(s)
    sketches = classes.select("id", "sig").mapInArrow(lean(_sketch), "id long, sketch binary")
    found = (leaves.join(sketches.hint("merge"), "id").repartition("path").sortWithinPartitions("path", "id")
             .select("path", "id", "sketch").mapInArrow(lean(_leaf_edges(least)), "a long, b long"))
    for e in edges:
        found = found.unionByName(e)
    groups = connected_components(found).withColumnRenamed("component", "grp")

    # -- exact links inside the candidate groups, on the full sets
    size_of = (groups.join(classes.select("id", "n").hint("merge"), "id").groupBy("grp").agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("shingles"))
               .select("grp", F.greatest(F.ceil(F.col("docs") / block), F.ceil(F.col("shingles") / block_shingles)).alias("blocks")))
    # written first, as are the other tables with a row for each large group: these are what Spark may broadcast, not the members
    large = stage_table(size_of.where("blocks > 1"), "large")
    placed = stage_table(groups.join(large, "grp", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
                         .withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks"))), "placed")
    hot = placed.where("blocks > 1")
    any_hot = not hot.isEmpty()
    members = placed.select("grp", "block", "id")
    if any_hot:
        first = Window.partitionBy("grp").orderBy(F.xxhash64("id", F.lit(7)), "id")
        pivot = (hot.withColumn("r", F.row_number().over(first)).where(F.col("r") <= pivots)
                 .select("grp", "id", F.col("block").alias("home"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)).alias("block"))
                 .where("block <> home").select("grp", "block", "id"))
        members = members.unionByName(pivot)
    texts = docs.where("id is not null and text is not null")
    # both sides grow with the corpus: no broadcast, at any size
    links = stage_table(_by_block(members.hint("merge").join(texts, "id").select("grp", "block", F.lit(0).alias("room"), "id", "text"),
                                  _confirmed(k, percent, False)), "links")
    final = links.select(F.col("a").alias("id"), F.col("b").alias("component"))  # stars already, but for salted groups
    if any_hot:
        inside = hot.select(F.col("id").alias("a")).hint("merge")
        final = links.join(inside, "a", "left_anti").select(F.col("a").alias("id"), F.col("b").alias("component"))
        part = stage_table(connected_components(links.join(inside, "a", "left_semi")), "part")
        comp = stage_table(hot.join(part.hint("merge"), "id", "left")
                           .select("grp", "block", "blocks", "id", F.coalesce("component", "id").alias("comp")), "comp")
        main = stage_table(comp.groupBy("grp", "comp").agg(F.count(F.lit(1)).alias("c"))
                           .groupBy("grp").agg(F.max(F.struct("c", "comp")).alias("x")).select("grp", F.col("x.comp").alias("main")), "main")
        rest = comp.join(main, "grp").where("comp <> main")
        pairs = _rooms(comp, rest, classes.select("id", "n"), block, block_shingles)
        pairs = stage_table(pairs, "asked")
        # a document has a row for each block or room, which a file holds in few bytes: only the ids, once each, may be
        # broadcast. Written first: Spark then knows how few they mostly are, and need not shuffle the other texts
        ids = stage_table(pairs.select("id").distinct(), "ids")
        more = stage_table(_by_block(pairs.hint("merge").join(texts.join(ids, "id", "left_semi"), "id").select("grp", "block", "room", "id", "text", "comp", "role"),
                                     _confirmed(k, percent, True)), "more")
        # components found so far are the vertices of what the queries add
        top = stage_table(connected_components(more), "top")
        final = final.unionByName(comp.select("id", "comp").join(top.select(F.col("id").alias("comp"), "component").hint("merge"), "comp", "left")
                                  .select("id", F.coalesce("component", "comp").alias("component")))

    # rows that share an id are one document: unite their classes as well
    shared = (signed.where("n > 0 and id is not null").groupBy("id").agg(F.countDistinct("mark").alias("marks")).where("marks > 1")
              .select("id"))
    if not shared.isEmpty():
        same = (signed.join(shared.hint("merge"), "id", "left_semi").select(F.col("id").alias("a"), "mark")
                .join(classes.select("mark", F.col("id").alias("b")).hint("merge"), "mark").select("a", "b"))
        final = connected_components(final.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(same))
    by_mark = (classes.select("mark", "id").join(final.hint("merge"), "id", "left")
               .select("mark", F.coalesce("component", "id").alias("root")))
    rooted = signed.select("id", "n", "mark").join(by_mark.hint("merge"), "mark", "left")
    return rooted.select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"),
        F.when(F.col("id").isNull(), F.lit(None)).otherwise(F.least("id", F.coalesce("root", "id"))).alias("component_id"),
    ).withColumn("kept", F.coalesce(F.col("component_id") == F.col(id_col), F.lit(True)))


def drop_near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of ``df`` with one document of each group of near duplicates (its smallest id).

    Columns and texts stay as they are. Rows with a null id or without words stay; exact repeats of
    a kept row (same id) stay with it.
    """
    gone = stage_table(near_duplicates(df, id_col, text_col, **how).where("not kept").select(id_col).distinct(), "gone")
    return df.join(gone, id_col, "left_anti")
