"""Document fingerprints by SpotSigs, in built-in functions only.

A spot is a common word (an anchor) followed by content words; its signature is the anchor and the
chain of the next ``chain`` content words, other anchors skipped (of anchors in a row the last is
taken). Words without an anchor before them, and every further ``SPAN`` words without one, start a
spot with their first word, so that tables, lists and texts of other languages are not blind spots.
A fingerprint is the sorted set of the hashed signatures; a text without a whole chain has one
signature, of all its words.

Two fingerprints are compared by the Jaccard index of their sets, in partitions by set length:
lengths fall into bands that grow by 1 / ``least``, and sets whose bands do not touch, or whose
lengths alone keep the index under ``least``, are not intersected (their likeness is 0).

``edited_likeness`` measures it on a corpus: every document against a copy whose last quarter
comes from the document after it, and against that document. Documents are brought together by two
equi-joins on one and the same exchange of texts and fingerprints; the order of ids is a rank over
narrow rows. Equal rows are one row with a count before they are exchanged.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tricolor.llm.common import lower_ascii
from tricolor.llm.quality_rules import STOP_WORDS
from tricolor.sources.rowid import ordered_rank_n

ANCHORS = tuple(sorted({w for ws in STOP_WORDS.values() for w in ws}))
BREAK = r"[\x20\x09-\x0D.,;:!?()\x22]+"
CHAIN = 2
SPAN = 8
LEAST = 0.05
HEX = 8   # digits of a hashed signature


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def _chains(spots: Column, chain: int) -> Column:
    """The words of every signature: an anchor and ``chain`` content words of its spot and the next ones."""
    content = lambda i: F.slice(F.flatten(F.transform(F.slice(spots, i, chain), lambda s: F.slice(s, 2, chain))), 1, chain)
    words = F.transform(F.sequence(F.lit(1), F.size(spots)), lambda i: F.concat(F.slice(spots[i - 1], 1, 1), content(i)))
    return F.filter(words, lambda w: F.size(w) == chain + 1)  # the last chains may be cut off by the end of the text


def signatures(text: Column, chain: int = CHAIN) -> Column:
    """Sorted distinct hashes of the signatures of a text (of an empty text: none)."""
    none = F.array().cast("array<string>")
    hashed = lambda words: F.substring(F.md5(F.array_join(words, " ")), 1, HEX)

    def of_tokens(tokens: Column) -> Column:
        # a line break before each anchor: tokens hold no white space, so lines are spots
        marked = F.array_join(F.transform(tokens, lambda w: F.when(w.isin(*ANCHORS), F.concat(F.lit("\n"), w)).otherwise(w)), " ")
        lines = F.transform(F.split(marked, "\n"), lambda s: F.split(F.rtrim(s), " "))
        pieces = F.flatten(F.transform(lines, lambda s: F.transform(F.sequence(F.lit(1), F.size(s), F.lit(SPAN)), lambda i: F.slice(s, i, SPAN))))
        spots = F.filter(pieces, lambda s: (F.size(s) > 1) & (s[0] != ""))
        found = _let(spots, lambda x: F.when(F.size(x) > 0, F.transform(_chains(x, chain), hashed)).otherwise(none))
        return F.when(F.size(tokens) == 0, none).otherwise(
            _let(found, lambda x: F.when(F.size(x) > 0, F.array_sort(F.array_distinct(x))).otherwise(F.array(hashed(tokens)))))

    return _let(F.filter(F.split(lower_ascii(text), BREAK), lambda w: w != ""), of_tokens)


def fingerprint(text: Column, chain: int = CHAIN) -> Column:
    """The fingerprint as a string: hashes of ``HEX`` hexadecimal digits each, ascending."""
    return F.array_join(signatures(text, chain), "")


def signature_set(print_: Column) -> Column:
    return F.regexp_extract_all(print_, F.lit(f"(.{{{HEX}}})"), F.lit(1))


def band(size: Column, least: float = LEAST) -> Column:
    """The length partition of a set: sets that reach ``least`` are in the same band or the next."""
    return F.floor(F.log(F.greatest(size, F.lit(1))) / math.log(1 / least)).cast("int")


def likeness(a: Column, b: Column, least: float = LEAST) -> Column:
    """Jaccard index of two sets of signatures; 0 where their lengths alone keep it under ``least``,
    1 for two empty sets."""
    def of_sets(x: Column, y: Column) -> Column:
        small, large = F.least(F.size(x), F.size(y)), F.greatest(F.size(x), F.size(y))
        index = _let(F.size(F.array_intersect(x, y)), lambda common: common / (small + large - common))
        return (F.when(large == 0, F.lit(1.0))
                .when((F.abs(band(small, least) - band(large, least)) > 1) | (small < least * large), F.lit(0.0)).otherwise(index))
    return _let(a, lambda x: _let(b, lambda y: of_sets(x, y)))


def edited_likeness(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", chain: int = CHAIN, least: float = LEAST) -> DataFrame:
    """One row per document: (id_col, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next).

    The edited text has its last floor(n_chars / 4) characters replaced by the first as many of the
    next document (all, where it has fewer), in ascending order of ids; after the last comes the first.

    Edge cases: a null text is empty; null ids come first, ties of an id in the order of the md5 of
    their texts, and equal rows follow one another; a single document is its own next one; texts of
    any length are fingerprinted whole, one at a time; an empty table gives an empty result. Other
    columns are not read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    docs = df.select(F.col(id_col).cast("bigint").alias("id"), text.alias("text"))
    key = F.concat(F.coalesce(F.col("id").cast("string"), F.lit("-")), F.lit(":"), F.md5("text"))
    narrow = docs.select("id", key.alias("key"), F.length("text").cast("bigint").alias("n"))
    ranked, rows = ordered_rank_n(narrow, ["id", "key"], "r", persist_input=False)
    after = ranked.select(F.col("key").alias("next"), ((F.col("r") + (rows - 2)) % max(rows, 1) + 1).alias("r"))
    asked = ranked.join(after, "r").groupBy("id", "key", "n", "next").agg(F.count(F.lit(1)).alias("copies"))
    # the same columns for both joins, so that they share one exchange
    whole = (docs.select(key.alias("key"), "text", F.unhex(fingerprint(F.col("text"), chain)).alias("print"))
             .groupBy("key").agg(F.first("text").alias("text"), F.first("print").alias("print")))
    quarter = F.floor(F.col("n") / 4).cast("int")
    tails = (whole.withColumnRenamed("key", "next").join(asked, "next")
             .select("key", "id", "n", "copies", F.substring(F.col("text"), F.lit(1), quarter).alias("tail"), F.col("print").alias("next_print")))
    print_ = lambda c: F.lower(F.hex(c))
    edited = (whole.join(tails, "key")
              .select("id", "n", "copies", print_("print").alias("fingerprint"), print_("next_print").alias("next_fingerprint"),
                      F.concat(F.substring(F.col("text"), F.lit(1), (F.col("n") - quarter).cast("int")), "tail").alias("edited")))
    prints = edited.select("id", "n", "copies", "fingerprint", "next_fingerprint", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
                           fingerprint(F.col("edited"), chain).alias("edited_fingerprint"))
    a, b, c = (signature_set(F.col(x)) for x in ("fingerprint", "edited_fingerprint", "next_fingerprint"))
    near = prints.select("id", "n", "copies", "edited_sha256", "fingerprint", "edited_fingerprint",
                         likeness(a, b, least).alias("near_edited"), likeness(a, c, least).alias("near_next"))
    return (near.select("*", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int"))))
            .select(F.col("id").alias(id_col), F.col("n").alias("n_chars"), "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"))
