"""The rule table against a loop over words and lines; odd rows; thresholds."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tallyframe.llm.op11_quality_rules import RULES, STOP_WORDS, Rule, judge, keep_good, window_hashes

DOCS = "doc_id long, text string, n_words string, m int, broken int"


def counted(text):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words), one thing after the other."""
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    n = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if n[w] > 1 for k in range(8)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    passage = " ".join(f"p{i}" for i in range(11))
    out = [None, "", " \n\t", "one", "a b c d e f g h", "x " * 8, "x " * 9, "y\x0b\x0cz\r\n\r\n  z", "É 漢字 😀  x y", f"{passage} {passage}", f"{passage}\n{passage} z {passage}"]
    out += [" ".join(rng.choice("abc") for _ in range(rng.randrange(60))) for _ in range(60)]
    out += ["\n".join(rng.choice(["the a", "* the", "", " ", "so...", "| # |"]) for _ in range(30)) for _ in range(20)]
    return [*out, " ".join(f"w{rng.randrange(3000)}" for _ in range(40_000)), "q" * 100_000, "same " * 30_000]


def test_counts_equal_a_loop(spark, texts):
    rows = [(i, t, "x", 1, 2) for i, t in enumerate(texts)] + [(None, "no id", "x", 1, 2), (3, "one", "x", 1, 2)]
    out = judge(spark.createDataFrame(rows, DOCS).repartition(3)).collect()
    assert len(out) == len(rows)
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in out)
    want = Counter()
    for doc_id, text, *_ in rows:
        c = counted(text)
        want[(doc_id, *c, c[0] < 20 or 100 * c[4] > 30 * c[0])] += 1
    assert got == want
    assert all(not r.kept for r in out if r.base_failed or r.broken)


@pytest.mark.parametrize("window", [1, 2, 3, 5, 8, 13])
def test_window_hashes_tell_windows_apart(spark, window):
    words = "a b a b a c a b a b a c a b b a b a c d".split()
    df = spark.createDataFrame([(words,)], "w array<string>")
    hashes = df.select((window_hashes(F.col("w"), window) if window > 1 else F.col("w")).alias("h")).first().h
    windows = [tuple(words[i : i + window]) for i in range(len(words) - window + 1)]
    assert len(hashes) == len(windows)
    assert len(set(zip(hashes, windows, strict=True))) == len(set(hashes)) == len(set(windows))


def test_each_rule_of_the_table(spark):
    prose = "the house and the garden of a friend is quiet in this early morning hour when we walk along to see that tree again"
    broken = {
        "length": "the quiet house of a friend", "word_length": "the of and " * 3 + "incomprehensibilities " * 17, "symbols": prose + " # * | $", "stop_words": " ".join(f"vok{i} lamt" for i in range(20)),
        "letters": prose + " 11 22 33 44 55 66 77 88 99 12 13 14 15", "repeated_lines": prose + "\nthe end\nthe end\nthe end", "bullets": "\n".join(f"- the {w}" for w in prose.split()), "ellipses": prose + "\nso...\nand…",
    }
    rows = [(name, text, "", 0, 0) for name, text in broken.items()] + [("", prose, "", 0, 0), ("", "\n".join(f"- {w} the" for w in prose.split()[:9]) + "\n" + prose, "", 0, 0)]
    out = judge(spark.createDataFrame(rows, DOCS.replace("long", "string", 1))).collect()
    assert {r.name for r in RULES} == set(broken)
    for r in out:
        assert (r.doc_id in r.broken) if r.doc_id else r.kept and not r.broken, r
    assert len(set(STOP_WORDS)) == len(STOP_WORDS)
    assert Rule("x", "a", "b", 1, 2).sql() == "1000 * a >= 1 * b AND 1000 * a <= 2 * b"


def test_filter_keeps_columns_and_empty_tables(spark, texts):
    docs = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in enumerate(texts)], DOCS)
    kept = {r.doc_id for r in judge(docs, RULES[:2]).filter("kept").collect()}
    out = keep_good(docs, RULES[:2])
    assert out.columns == docs.columns and {r.doc_id for r in out.collect()} == kept
    empty = spark.createDataFrame([], DOCS)
    assert judge(empty).collect() == [] and keep_good(empty).collect() == []
    assert judge(docs, ()).filter("NOT base_failed AND NOT kept").count() == 0


def test_plan_is_one_projection(spark, texts):
    docs = spark.createDataFrame([(1, "x", "", 0, 0)], DOCS)
    plan = judge(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan and plan.count("regexp_extract_all") == 1
