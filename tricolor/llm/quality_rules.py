"""Quality rules: a threshold table compiled into one Spark projection, without user functions.

``measures`` derives the counts of a text with built-in functions only; ``RULES`` is the table of
(name, expression over those counts, least, most) and ``verdict`` compiles it into boolean columns.
No stage of it shuffles: every row is measured on its own, over its whole text.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tricolor.llm.common import WORD, lower_ascii, words

SYMBOLS = "#*$%&|<>"
WINDOW = 8

# Frequent function words of the four languages of the corpus.
STOP_WORDS = {
    "en": ("the", "of", "and", "to", "in", "is", "that", "with", "for", "as", "on", "be", "at", "by", "this", "are",
           "was", "from", "have", "it"),
    "de": ("der", "die", "das", "und", "in", "zu", "den", "nicht", "von", "sie", "ist", "des", "sich", "mit", "dem",
           "ein", "eine", "auf", "für", "im"),
    "fr": ("le", "la", "les", "de", "des", "et", "un", "une", "du", "en", "que", "qui", "dans", "est", "pour", "pas",
           "sur", "par", "au", "ce"),
    "es": ("el", "la", "los", "las", "de", "que", "y", "en", "un", "una", "del", "se", "por", "con", "no", "para",
           "es", "su", "al", "lo"),
}


@dataclass(frozen=True)
class Rule:
    """``least <= value <= most``; an open side is None. ``value`` is SQL over the measures."""
    name: str
    value: str
    least: float | None = None
    most: float | None = None


RULES = (
    Rule("word_length", "word_chars / n_words", 2.5, 14.0),
    Rule("symbol_ratio", "n_symbols / n_words", None, 0.1),
    Rule("stop_words", "n_stop_words", 2, None),
    Rule("stop_ratio", "n_stop_words / n_words", 0.02, None),
    Rule("upper_ratio", "n_upper / word_chars", None, 0.5),
    Rule("dup_line_ratio", "(n_dup_lines - 1) / n_lines", None, 0.3),
    Rule("ellipsis_ratio", "n_ellipsis_lines / n_lines", None, 0.3),
    Rule("bullet_ratio", "n_bullet_lines / n_lines", None, 0.9),
)


def measures(df: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """``keep`` columns and the counts of each whole text (a null text counts as empty).

    n_words, word_chars (code points in words), n_symbols, n_upper, n_stop_words, n_lines (lines
    with a word), n_dup_lines (such lines equal to an earlier one), n_ellipsis_lines,
    n_bullet_lines, n_repeat_words (words inside a window of eight words that occurs twice or more
    in the text, the first occurrence included).
    """
    stop = sorted({w for ws in STOP_WORDS.values() for w in ws})
    own = [F.col(c) for c in keep]
    # Each array is read at least twice by the next projection, so that it stays a column there
    # and is not evaluated again for every element.
    a = df.select(*own, F.coalesce(F.col(text_col), F.lit("")).alias("_t")).select(*own, "_t", words("_t").alias("_w"),
                  F.filter(F.split("_t", "\n"), lambda x: x.rlike(WORD)).alias("_l"))
    b = a.select(
        *own, F.size("_w").cast("bigint").alias("n_words"),
        F.length(F.translate("_t", " \t\n\x0b\x0c\r", "")).cast("bigint").alias("word_chars"),
        (F.length("_t") - F.length(F.translate("_t", SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
        (F.length("_t") - F.length(F.translate("_t", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))).cast("bigint").alias("n_upper"),
        F.size(F.filter("_w", lambda x: F.rtrim(lower_ascii(x), F.lit(".,;:!?")).isin(stop))).cast("bigint").alias("n_stop_words"),
        F.size("_l").cast("bigint").alias("n_lines"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("bigint").alias("n_dup_lines"),
        F.size(F.filter("_l", lambda x: x.rlike(r"(\.\.\.|…)[\x20\x09-\x0D]*$"))).cast("bigint").alias("n_ellipsis_lines"),
        F.size(F.filter("_l", lambda x: x.rlike(r"^[\x20\x09-\x0D]*[-*•][\x20\x09]"))).cast("bigint").alias("n_bullet_lines"),
        F.transform("_w", lambda x: F.xxhash64(x)).alias("_h"))
    counts = [c for c in b.columns if c != "_h"]
    # hash of the window that begins at each word
    c = b.select(*counts, F.when(F.size("_h") >= WINDOW, F.transform(
        F.sequence(F.lit(1), F.greatest(F.size("_h") - (WINDOW - 1), F.lit(1))),
        lambda i: F.xxhash64(F.slice("_h", i, F.lit(WINDOW))))).otherwise(F.array().cast("array<bigint>")).alias("_g"))
    # windows sorted by hash, only where a hash occurs twice
    none = F.array().cast("array<struct<g:bigint,i:int>>")
    d = c.select(*counts, F.when(F.size(F.array_distinct("_g")) < F.size("_g"), F.sort_array(F.transform(
        "_g", lambda g, i: F.struct(g.alias("g"), i.alias("i"))))).otherwise(none).alias("_s"))
    same = lambda x, i: F.coalesce(F.get("_s", i)["g"] == x["g"], F.lit(False))
    e = d.select(*counts, F.sort_array(F.transform(F.filter(
        "_s", lambda x, i: same(x, i - 1) | same(x, i + 1)), lambda x: x["i"])).alias("_p"))
    return e.select(*counts, F.aggregate(F.transform("_p", lambda p, i: F.least(
        F.lit(WINDOW), F.coalesce(F.get("_p", i + 1) - p, F.lit(WINDOW))).cast("bigint")),
        F.lit(0).cast("bigint"), lambda x, y: x + y).alias("n_repeat_words"))


def verdict(measured: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Adds base_failed, a boolean fail_<rule> for each rule of the table, and kept.

    A rule whose value is undefined (no words, no lines) does not fail; such texts fail the base.
    """
    base = F.expr("n_words < 20 or 100 * n_repeat_words > 30 * n_words")
    fails = []
    for r in rules:
        v = F.expr("try_divide(" + ", ".join(r.value.split(" / ")) + ")" if " / " in r.value else r.value)
        bad = F.lit(False)
        if r.least is not None:
            bad = bad | (v < r.least)
        if r.most is not None:
            bad = bad | (v > r.most)
        fails.append(F.coalesce(bad, F.lit(False)).alias(f"fail_{r.name}"))
    out = measured.select("*", base.alias("base_failed"), *fails)
    ok = ~F.col("base_failed")
    for r in rules:
        ok = ok & ~F.col(f"fail_{r.name}")
    return out.withColumn("kept", ok)


def quality_rules(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per row: id, the measures, base_failed, fail_<rule>..., kept.

    Edge cases: null and empty texts have zero counts and fail the base (fewer than 20 words); a
    null id and repeated rows pass through; an empty table gives an empty one; other columns,
    whatever their names, are not read.
    """
    named = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    return verdict(measures(named, "_text", ("_id",)), rules).withColumnRenamed("_id", id_col)
