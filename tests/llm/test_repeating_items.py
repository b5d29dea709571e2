"""Benchmark items that repeat words, share an id or have none."""

from tallyframe.llm.op4_string_tiling import find_leaks, remove_leaks
from tests.llm.test_operators import DOCS


def test_op4_finds_repeating_clashing_and_nameless_items(spark):
    refrain = " ".join(f"la{i}" for i in range(15))
    items = [(1, " ".join(["same"] * 12)), (2, " ".join([refrain] * 11)), (3, " ".join(f"first{i}" for i in range(20))), (3, " ".join(f"second{i}" for i in range(20))), (None, " ".join(f"nameless{i}" for i in range(20)))]
    docs = spark.createDataFrame([(i, f"before {text.upper()} after", "en", "s", 1) for i, (_, text) in enumerate(items)] + [(9, "nothing of the kind is in here", "en", "s", 1)], DOCS)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: r for r in find_leaks(docs, bench, 5, 0.5).collect()}
    assert len(got) == 6 and not got[9].contaminated
    for i, (item_id, _) in enumerate(items):
        assert got[i].contaminated and got[i].item_id == item_id and got[i].coverage == 1.0
    assert [r.doc_id for r in remove_leaks(docs, bench).collect()] == [9]
