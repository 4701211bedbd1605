"""Source divergence audit: how far the word use of the sources of a language lies apart.

1. Duplicate-text collapse. Equal texts of a language become one row with its number of copies per
   source: tasks add up copies while they read (bounded memory), one exchange on (language, text)
   brings them together.
2. Each distinct text is split into terms once; its counts are added to every source that holds it
   times that source's copies, its document frequency likewise. Tasks add up (language, source,
   term) before they send anything.
3. Terms in at least ``least_docs`` documents of a language stay. Smoothed shares are integers per
   ``UNIT``; all arithmetic is on longs and decimals.
4. Sources are compared sparsely. A term that neither source holds adds the same amount, so a pair
   starts with that amount for all terms; a term of one source adds a correction that depends on its
   count alone (evaluated once per distinct count); only terms that both hold are joined.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tricolor.llm.common import UPPER, ship, slices, stage_table

UNIT = 1_000_000_000
HELD_BYTES = 16 << 20    # texts that a task holds before it passes its copies on
HELD_TERMS = 500_000     # term rows that a task holds before it passes them on
DOCS = 40                # bits for documents beside the occurrences, in one integer per term
# A-Z become a-z; ASCII that is no letter parts terms; bytes of other code points are kept.
_TERMS = bytes(b + 32 if chr(b) in UPPER else b if b >= 0x80 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))


def terms_of(text: str) -> list[bytes]:
    """Terms of a text as UTF-8: runs of ASCII letters (A-Z lower-cased) and non-ASCII characters."""
    return text.encode().translate(_TERMS).split()


def _copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: Counter = Counter()
    size = 0

    def out() -> Iterator[pa.RecordBatch]:
        keys, at = list(held), 0
        while at < len(keys):  # batches of about a megabyte of text
            to, most = at, 1 << 20
            while to < len(keys) and (to == at or most > 0):
                most -= len(keys[to][2])
                to += 1
            part = keys[at:to]
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[i] for k in part], pa.string()) for i in range(3)] + [pa.array([held[k] for k in part], pa.int64())],
                names=["lang", "source", "text", "n"])
            at = to

    for batch in batches:
        for b in slices(batch, "text"):
            for key in zip(*(b.column(c).to_pylist() for c in ("lang", "source", "text"))):
                if key not in held:
                    size += len(key[2]) + 200
                held[key] += 1
            if size > HELD_BYTES:
                yield from out()
                held.clear()
                size = 0
    yield from out()


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[tuple[str, str], dict[bytes, int]] = {}
    size = 0

    def out() -> Iterator[pa.RecordBatch]:
        for (lang, source), terms in held.items():
            words = sorted(terms)   # neighbours are alike, which compresses better
            sums = [terms[w] for w in words]
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(terms), pa.string()), pa.array([source] * len(terms), pa.string()),
                 pa.array(words, pa.binary()).cast(pa.string()),
                 pa.array([x >> DOCS for x in sums], pa.int64()), pa.array([x & ((1 << DOCS) - 1) for x in sums], pa.int64())],
                names=["lang", "source", "term", "n", "docs"])

    for b in batches:
        for lang, text, copies in zip(*(b.column(c) for c in ("lang", "text", "copies"))):
            counts = Counter(terms_of(text.as_py()))
            for c in copies.as_py():
                mine = held.setdefault((lang.as_py(), c["source"]), {})
                times = c["n"]
                size -= len(mine)
                for term, n in counts.items():
                    mine[term] = mine.get(term, 0) + (n * times << DOCS) + times
                size += len(mine)
            if size > HELD_TERMS:
                yield from out()
                held.clear()
                size = 0
    yield from out()


def term_counts(df: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, term, n, docs): occurrences of each term in a group, and documents that hold it."""
    ship(df.sparkSession)
    docs = df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(a)
                       for c, a in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))])
    copies = docs.mapInArrow(_copies, "lang string, source string, text string, n long")
    # one exchange serves both groupings: rows of one text of a language meet, whatever their source
    per_source = copies.repartition("lang", "text").groupBy("lang", "text", "source").agg(F.sum("n").alias("n"))
    collapsed = per_source.groupBy("lang", "text").agg(F.collect_list(F.struct("source", "n")).alias("copies"))
    # rows of a term meet, whatever their source: added up per task before, they are few for any term
    counted = collapsed.mapInArrow(_count_terms, "lang string, source string, term string, n long, docs long").repartition("lang", "term")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _share(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(UNIT * (n + 1) / (total + terms)); exact, products are decimals."""
    over = (n + 1).cast("decimal(20,0)") * F.lit(UNIT).cast("decimal(10,0)")
    return F.lit(1).cast("bigint") + F.call_function("div", over, F.greatest(total + terms, F.lit(1)).cast("decimal(20,0)"))


def _apart(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q)."""
    return F.call_function("div", (p - q) * (p - q), q)


def source_audit(df: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
                 least_docs: int = 3, top_terms: int = 200) -> DataFrame:
    """(lang, source, part, item, value, rank): part ``pair`` has every other source of the language
    and its divergence from it, part ``term`` the ``top_terms`` terms by which a source stands out
    from its language.

    Edge cases: null texts, languages and sources count as empty strings; a group whose texts have
    no kept terms is compared like the others (0, if its language keeps no terms); a language with
    one source has no pairs; equal values are ranked by the UTF-8 bytes of the item; repeated rows
    count as documents of their own; texts of any length are split whole, a megabyte of texts at a
    time (or one text); an empty table gives an empty result. Other columns are not read.
    """
    groups = df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(a)
                         for c, a in ((lang_col, "lang"), (source_col, "source"))]).distinct()
    # one entry of ``held`` for each source of the language
    terms = stage_table(term_counts(df, text_col, lang_col, source_col)
                        .groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs"),
                                                     F.collect_list(F.struct("source", "n")).alias("held"))
                        .where(F.col("docs") >= least_docs), "terms")
    rows = terms.select("lang", "term", "lang_n", F.inline("held"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c)
    stats = stage_table(
        groups.join(rows.groupBy("lang", "source").agg(F.sum("n").alias("total")), ["lang", "source"], "left")
        .join(terms.groupBy("lang").agg(F.sum("lang_n").alias("lang_total"), F.count(F.lit(1)).alias("kept")), "lang", "left")
        .select("lang", "source", zero("total"), zero("lang_total"), zero("kept"))
        .withColumn("p0", _share(F.lit(0).cast("bigint"), F.col("total"), F.col("kept"))), "groups")
    shares = (rows.join(stats, ["lang", "source"])
              .select("lang", "source", "term", "n", "p0", _share(F.col("n"), F.col("total"), F.col("kept")).alias("p"),
                      _share(F.col("lang_n"), F.col("lang_total"), F.col("kept")).alias("q")))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    out = (shares.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"),
                                        _apart(F.col("p"), F.col("q")).alias("value"))
           .withColumn("rank", rank).where(F.col("rank") <= top_terms))
    return _pairs(stats, shares).withColumn("rank", rank).unionByName(out)


def _pairs(stats: DataFrame, shares: DataFrame) -> DataFrame:
    """(lang, source, 'pair', other source, value): the divergence over all kept terms."""
    a, b = (stats.select("lang", F.col("source").alias(x), F.col("p0").alias(f"{x}0"), *more)
            for x, more in (("a", ["kept"]), ("b", [])))
    pairs = a.join(b, "lang").where("a <> b")   # as many as the result has rows
    neither = _apart(F.col("a0"), F.col("b0"))
    base = pairs.select("lang", "a", "b", F.when(F.col("kept") > 0, F.col("kept") * neither).otherwise(0).alias("value"))
    # terms of one side: a share depends on the count alone, so each distinct count is evaluated once
    spread = shares.groupBy("lang", "source", "p").agg(F.count(F.lit(1)).alias("times"))
    one = [pairs.join(spread.withColumnRenamed("source", x), ["lang", x])
           .select("lang", "a", "b", (F.col("times") * (f - neither)).alias("value"))
           for x, f in (("a", _apart(F.col("p"), F.col("b0"))), ("b", _apart(F.col("a0"), F.col("p"))))]
    # terms of both sides: what the two corrections got wrong
    held = shares.groupBy("lang", "term").agg(F.collect_list(F.struct("source", "p", "p0")).alias("held"))
    both = (held.where(F.size("held") > 1).select("lang", "held", F.explode("held").alias("x")).select("lang", "x", F.explode("held").alias("y"))
            .where("x.source <> y.source")
            .select("lang", F.col("x.source").alias("a"), F.col("y.source").alias("b"),
                    (_apart(F.col("x.p"), F.col("y.p")) - _apart(F.col("x.p"), F.col("y.p0"))
                     - _apart(F.col("x.p0"), F.col("y.p")) + _apart(F.col("x.p0"), F.col("y.p0"))).alias("value")))
    parts = [x.groupBy("lang", "a", "b").agg(F.sum("value").alias("value")) for x in (*one, both)]
    total = base.unionByName(parts[0]).unionByName(parts[1]).unionByName(parts[2])
    return (total.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
            .select("lang", F.col("a").alias("source"), F.lit("pair").alias("part"), F.col("b").alias("item"), "value"))
