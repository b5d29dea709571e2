"""Short lines count as any other, in the query and in the stage."""

import corpus_pipeline

from tallyframe.llm.op5_line_spread import op5_line_spread
from tests.llm.test_operators import DOCS


def test_op5_counts_short_lines(spark, tmp_path):
    rows = [(i, f"own line of document {i}\nAnd ornd.\n\n" + ("Few." if i < 4 else "x"), "en", f"site{i % 6}", 1) for i in range(12)]
    docs = spark.createDataFrame(rows, DOCS)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.n_removed for r in op5_line_spread(spark, str(tmp_path)).collect()}
    assert got == {0: 0, 1: 1, 2: 1, 3: 1, 4: 1} | {i: 2 for i in range(5, 12)}
    after = {r.doc_id: r.text for r in corpus_pipeline.lines(spark, docs, str(tmp_path)).select("doc_id", "text").collect()}
    assert after[0] == rows[0][1] and after[1] == "own line of document 1\n\nFew." and after[11] == "own line of document 11\n"
