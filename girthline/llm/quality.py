"""Quality rules as a short-circuit cascade, in native column expressions over whole texts.

Words are runs without white space. ``measured`` gives for each document ``n_words``, ``word_chars`` (code points in words),
``n_symbols`` (characters of ``#*$%&|<>``), ``n_dup_lines`` (lines with a word that equal an earlier line) and ``n_repeat_words``
(words inside three-word windows that the text has twice or more). ``base_failed`` tells texts under 50 words or with over half
of their words repeated; the other rules are judged only for texts that pass it.

The cascade: each rule's cost (time of a job over the sample) and rejection rate are estimated on ``sample`` documents, the
rules are ordered by rejections per cost, and ``first_failed`` is a CASE that stops at the first rule a text breaks, so
that dear rules run on what cheap ones leave. The verdict doesn't depend on the order, only the time and the name of the rule do.

A null text counts as empty: no words, so the base fails. Texts are handled in their rows: nothing is shuffled, and repeated
rows get equal results. Every document gives one row; other columns are not looked at.
"""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from girthline.session import cut

WORD, SPACES, SYMBOLS = r"[^\x20\x09-\x0D]+", " \t\n\x0b\f\r", "#*$%&|<>"
SAMPLE = 1000


def _without(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


def measured(docs: DataFrame, row_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``row_id``, ``text`` and the five measures of each document."""
    t = docs.select(F.col(row_id).alias("row_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    lines = F.filter(F.split("text", "\n", -1), lambda x: F.length(_without(x, SPACES)) > 0)
    t = t.select(
        "row_id", "text", words.alias("w"), lines.alias("l"),
        F.char_length(_without(F.col("text"), SPACES)).alias("word_chars"),
        (F.char_length("text") - F.char_length(_without(F.col("text"), SYMBOLS))).alias("n_symbols"),
    )
    t = t.withColumn("n", F.size("w")).withColumn("n_dup_lines", F.size("l") - F.size(F.array_distinct("l")))
    # Windows as (hash, place), sorted: equal ones are neighbours. Functions over elements look at their own elements only: an
    # outer array in them would be made anew for each element wherever Catalyst inlines it, as below a pushed filter.
    def from_place(k: int) -> Column:
        return F.slice("w", F.lit(k), F.greatest(F.size("w"), F.lit(1)))

    firsts = F.zip_with("w", from_place(2), lambda a, b: F.xxhash64(a, b))
    hashes = F.slice(F.zip_with(firsts, from_place(3), lambda h, c: F.xxhash64(h, c)), F.lit(1), F.greatest(F.col("n") - 2, F.lit(0)))
    t = t.withColumn("g", F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    twins = F.zip_with("g", F.slice("g", F.lit(2), F.greatest(F.size("g"), F.lit(1))), lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])))
    t = t.withColumn("starts", F.array_distinct(F.flatten(F.filter(twins, lambda x: x.isNotNull()))))
    covered = F.size(F.array_distinct(F.flatten(F.transform("starts", lambda i: F.array(i, i + 1, i + 2)))))
    t = t.withColumn("n_repeat_words", covered)
    return t.select("row_id", "text", F.col("n").cast("long").alias("n_words"), *(F.col(c).cast("long") for c in ("word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")))


BASE = "n_words < 50 OR 100 * n_repeat_words > 50 * n_words"

#: What a document that breaks a rule has. The first ones read the measures, the last two go over the text again.
RULES = {
    "short_words": "word_chars < 2 * n_words",
    "long_words": "word_chars > 20 * n_words",
    "symbols": "5 * n_symbols > n_words",
    "repeated_lines": "20 * n_dup_lines > n_words",
    "few_letters": r"2 * regexp_count(text, '\\p{L}') < word_chars",
    "few_words": r"size(array_distinct(split(text, '[\\x20\\x09-\\x0D]+'))) < 10",
}


def ordered_rules(docs: DataFrame, sample: int = SAMPLE, rules: dict[str, str] = RULES, row_id: str = "doc_id", text: str = "text") -> list[tuple[str, float, float]]:
    """(rule, cost in seconds, share rejected) on a sample, most rejections per cost first."""
    some = docs.select(F.col(row_id).alias("row_id"), F.col(text).alias("text"))
    # Ids first, so that no text moves for the sample.
    ids = cut(some.select(F.col("row_id").alias("chosen")).orderBy(F.xxhash64("row_id")).limit(sample).distinct())
    some = some.join(F.broadcast(ids), F.col("row_id").eqNullSafe(F.col("chosen")), "left_semi")
    some = cut(measured(some, "row_id", "text")).where(f"NOT ({BASE})")
    found, n = [], max(1, some.count())
    for name, rule in rules.items():
        began = time.monotonic()
        failed = some.where(rule).count()
        found.append((name, time.monotonic() - began, failed / n))
    return sorted(found, key=lambda x: (-x[2] / x[1], x[1], x[0]))


def cascade(order: list[str], rules: dict[str, str] = RULES) -> Column:
    """The first rule that a measured document breaks, in this order; null if none."""
    chain = F.when(F.expr(BASE), "base")
    for name in order:
        chain = chain.when(F.expr(rules[name]), name)
    return chain


def judged(docs: DataFrame, sample: int = SAMPLE, row_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Measures and verdict of each document: ``base_failed``, ``kept``, ``first_failed``."""
    order = [name for name, _, _ in ordered_rules(docs, sample, row_id=row_id, text=text)]
    found = measured(docs, row_id, text).withColumn("base_failed", F.expr(BASE)).withColumn("first_failed", cascade(order))
    return found.withColumn("kept", F.col("first_failed").isNull()).drop("text").withColumnRenamed("row_id", row_id)
