"""Quality rules: a table of thresholds, compiled into one projection of built-in functions.

A rule bounds the ratio of two counts of a text, in thousandths, so that every
comparison is one of whole numbers.  ``judge`` compiles the measures and the
rules of a table into columns; no user function runs, nothing is shuffled, and
each text is judged where it lies.

Words are runs of characters other than ASCII white space.  Words that repeat
are found by the hashes of all windows of eight words: the hashes are compared
as a set, and only where two are equal they are sorted with their places, and
the places of the repeated ones say how many words they cover.  So the work is
linear in the text but for one sort.  Two windows that differ have the same
64-bit hash with probability 5e-20; nothing else is approximate.

Cases: a null text is judged as an empty one, which has no words and fails.
Repeated rows are judged each; rows that share a doc_id too.  A null doc_id is
kept as it is.  Texts may be as long as a row may be; the windows take some 40
bytes a word.  Ratios of nothing (no words, no lines) break no rule.  An empty
table gives no rows.  Other columns are left out, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that ends a word, symbols, and how many words a window has.
SPACE, SYMBOLS, WINDOW = r"\x20\x09-\x0D", "[#*$%&|<>]", 8
#: Frequent function words of four languages, as texts write them in lower case.
STOP_WORDS = (
    "the", "of", "and", "to", "in", "is", "that", "for", "on", "with", "as", "was", "are", "this", "from", "have",
    "le", "la", "les", "de", "des", "et", "est", "un", "une", "que", "dans", "pour", "au", "qui",
    "der", "die", "das", "und", "ist", "den", "mit", "von", "zu", "ein", "eine", "nicht", "auf",
    "el", "los", "las", "y", "en", "es", "una", "por", "con", "para", "del", "se",
)


@dataclass(frozen=True)
class Rule:
    """``low`` <= 1000 * ``count`` / ``per`` <= ``high``; a bound of None is none."""

    name: str
    count: str
    per: str
    low: int | None = None
    high: int | None = None

    def sql(self) -> str:
        """The rule as a condition, the same in Spark and in other SQL."""
        parts = [f"1000 * {self.count} >= {self.low} * {self.per}"] if self.low is not None else []
        return " AND ".join(parts + ([f"1000 * {self.count} <= {self.high} * {self.per}"] if self.high is not None else []))


#: What a text of prose keeps to, with room: the thresholds of the query.
RULES = (
    Rule("length", "n_words", "1", 20_000, 1_000_000_000),
    Rule("word_length", "word_chars", "n_words", 2_000, 12_000),
    Rule("symbols", "n_symbols", "n_words", None, 100),
    Rule("stop_words", "n_stop_words", "n_words", 20, None),
    Rule("letters", "n_letter_words", "n_words", 700, None),
    Rule("repeated_lines", "n_dup_lines", "n_lines", None, 400),
    Rule("bullets", "n_bullet_lines", "n_lines", None, 900),
    Rule("ellipses", "n_open_lines", "n_lines", None, 300),
)
#: The contract's own rules, which come before those of a table.
BASE = "n_words < 20 OR 100 * n_repeat_words > 30 * n_words"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_bullet_lines", "n_open_lines", "n_stop_words", "n_letter_words", "n_repeat_words")


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.transform(F.array(value), use)[0]


def window_hashes(words: Column, window: int = WINDOW) -> Column:
    """The hash of every window of ``window`` words (there must be one): from hashes of windows half as long, and so on."""

    def wider(hashes: Column, have: int) -> Column:
        step = min(have, window - have)  # two windows side by side, or overlapping, make one
        n = F.size(hashes) - step
        both = F.zip_with(F.slice(hashes, F.lit(1), n), F.slice(hashes, F.lit(step + 1), n), lambda a, b: F.xxhash64(a, b))
        return both if have + step == window else bound(both, lambda h: wider(h, have + step))

    return wider(words, 1)


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """How many words lie in windows of ``window`` words that the text has twice or more."""

    def covered(hashes: Column) -> Column:
        placed = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        twice = bound(placed, lambda p: F.transform(p, lambda x, j: F.when((x["h"] == F.get(p, j - 1)["h"]) | (x["h"] == F.get(p, j + 1)["h"]), x["i"])))
        starts = F.sort_array(F.filter(twice, lambda x: x.isNotNull()))
        reach = bound(starts, lambda s: F.transform(s, lambda x, j: F.least(F.lit(window), F.coalesce(F.get(s, j + 1) - x, F.lit(window)))))
        total = F.aggregate(reach, F.lit(0), lambda a, b: a + b)
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), 0).otherwise(total)

    return F.when(F.size(words) > window, bound(window_hashes(words, window), covered)).otherwise(0)


def measures(text: Column, stop_words: Sequence[str] = STOP_WORDS) -> Column:
    """A struct of all counts of a text that rules may use."""

    def counted(words: Column, lines: Column) -> Column:
        def how_many(values: Column, test: Callable[[Column], Column]) -> Column:
            return F.size(F.filter(values, test))

        values = {
            "n_words": F.size(words), "word_chars": F.char_length(F.array_join(words, "")), "n_symbols": F.regexp_count(text, F.lit(SYMBOLS)),
            "n_lines": F.size(lines), "n_dup_lines": F.size(lines) - F.size(F.array_distinct(lines)),
            "n_bullet_lines": how_many(lines, lambda x: x.rlike(f"^[{SPACE}]*[-*•]")), "n_open_lines": how_many(lines, lambda x: x.rlike(rf"(\.\.\.|…)[{SPACE}]*$")),
            "n_stop_words": how_many(words, lambda w: F.lower(w).isin(*stop_words)), "n_letter_words": how_many(words, lambda w: w.rlike(r"\p{L}")),
            "n_repeat_words": repeated_words(words),
        }
        return F.struct(*[F.coalesce(values[name], F.lit(0)).cast("long").alias(name) for name in MEASURES])

    words = F.array_remove(F.split(text, f"[{SPACE}]+"), "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(f"[^{SPACE}]"))
    return bound(words, lambda w: bound(lines, lambda x: counted(w, x)))


def judge(docs: DataFrame, rules: Sequence[Rule] = RULES, stop_words: Sequence[str] = STOP_WORDS) -> DataFrame:
    """doc_id, every measure, base_failed, ``broken`` (the names of the rules a text breaks) and kept."""
    counts = docs.select("doc_id", measures(F.coalesce(F.col("text").cast("string"), F.lit("")), stop_words).alias("m")).select("doc_id", "m.*")
    broken = F.array_compact(F.array(*[F.when(~F.expr(r.sql()), F.lit(r.name)) for r in rules])) if rules else F.array().cast("array<string>")
    judged = counts.withColumns({"base_failed": F.expr(BASE), "broken": broken})
    return judged.withColumn("kept", ~F.col("base_failed") & (F.size("broken") == 0))


def keep_good(docs: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """The rows of ``docs`` that fail neither the base rules nor the table's; all columns as they are."""
    m = measures(F.coalesce(F.col("text").cast("string"), F.lit("")))
    fine = f"NOT ({BASE})" + "".join(f" AND {r.sql()}" for r in rules)
    rows = docs.select(F.struct(*docs.columns).alias("row"), m.alias("m")).select("row", "m.*")
    return rows.filter(fine).select("row.*")


def op11_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = judge(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)
OP11_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^{SPACE}]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^{SPACE}]')) AS lines
  FROM documents
), windows AS (
  SELECT r, unnest(range(1, len(w) - 6)) AS i, unnest(list_transform(range(1, len(w) - 6), lambda i: array_to_string(w[i:i + 7], ' '))) AS words FROM d WHERE len(w) >= 8
), repeated AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, words) AS n FROM windows) WHERE n > 1
), covered AS (
  SELECT r, sum(least(8, after - i)) AS n_repeat_words FROM (SELECT r, i, coalesce(lead(i) OVER (PARTITION BY r ORDER BY i), i + 8) AS after FROM repeated) GROUP BY r
), counted AS (
  SELECT doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS word_chars, len(regexp_extract_all(t, '{SYMBOLS}')) AS n_symbols,
         len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
         len(list_filter(lines, lambda x: regexp_matches(x, '^[{SPACE}]*[-*•]'))) AS n_bullet_lines,
         len(list_filter(lines, lambda x: regexp_matches(x, '(\.\.\.|…)[{SPACE}]*$'))) AS n_open_lines,
         len(list_filter(w, lambda x: lower(x) IN ({_STOP}))) AS n_stop_words, len(list_filter(w, lambda x: regexp_matches(x, '\pL'))) AS n_letter_words,
         coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM d LEFT JOIN covered USING (r)
)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
       CAST(n_repeat_words AS BIGINT) AS n_repeat_words, ({BASE}) AS base_failed, NOT ({BASE}) AND {" AND ".join(f"({r.sql()})" for r in RULES)} AS kept
FROM counted
"""
