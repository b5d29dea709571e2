"""The pipeline's stages on a small corpus, each against brute force on its own input."""

import random
from collections import defaultdict

import corpus_pipeline
import public_tokenizers
from tokenizers import Tokenizer

from tallyframe.llm.common import kept
from tests.llm.test_operators import DOCS, brute_components

KINDS = {"en": "the and thing wash other", "de": "der und schön auch keit"}


def corpus(rng):
    item, shared, rows = " ".join(f"bench{i}" for i in range(30)), "this very line stands on many sites", []
    for i in range(60):
        lang = "en" if i % 2 else "de"
        words = [rng.choice(KINDS[lang].split()) + rng.choice(["", "en", "er", "ung"]) + str(rng.randrange(10**6)) for _ in range(80)]
        if i == 7:
            words = item.split()[15:] + words + item.split()[:15]
        rows.append([i, " ".join(words) + (f"\n{shared}" if i < 20 else ""), lang, f"site{i % 10}", 1])
    rows.append([60, rows[30][1], "de", "site1", 1])  # a copy
    rows.append([61, rows[31][1].rsplit(" ", 1)[0], "en", "site2", 1])  # a near copy
    rows += [[62, None, "en", "site3", 0], [63, "123 456", "en", "site3", 0]]
    return rows, item, shared


def test_stages(spark, tmp_path):
    rows, item, shared = corpus(random.Random(5))
    docs = spark.createDataFrame([tuple(r) for r in rows], DOCS)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    texts, seen = {r[0]: r[1] for r in rows}, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = kept(stage(spark, docs, str(tmp_path)), "t")
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        after = {r.doc_id: r.text for r in docs.collect()}
        if name == "language":
            assert set(after) == set(texts) - {62, 63} and all(after[k] == texts[k] for k in after)
        elif name == "lines":
            assert set(after) == set(texts) and shared in after[0] and all(shared not in after[k] for k in range(1, 20))
            assert all(after[k] == texts[k].replace(f"\n{shared}", "") for k in range(1, 20))
        elif name == "near_duplicates":
            assert set(after) == {k for k, (_, c) in brute_components(texts, 80).items() if k == c} and not {60, 61} & set(after)
        else:
            assert set(after) == set(texts) - {7}
        texts = after
        seen.append(name)
    assert len(seen) == 4
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    encode, length, room = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode, defaultdict(int), defaultdict(int)
    for r in packed:
        length[r.doc_id] += r.length
        room[r.sequence_id] += r.length
    assert length == {k: len(encode(t, add_special_tokens=False).ids) + 1 for k, t in texts.items()} and max(room.values()) <= 1024
    first_fit: list[int] = []
    for n in sorted(length.values(), reverse=True):  # every text here is one piece
        at = next((i for i, used in enumerate(first_fit) if used + n <= 1024), None)
        if at is None:
            first_fit.append(n)
        else:
            first_fit[at] += n
    assert len(packed) == len(length) and len(room) <= len(first_fit)


def test_stages_on_odd_rows(spark, tmp_path):
    """Nulls, empty and very long texts, repeated rows, one doc_id with two texts, clashing columns, empty tables."""
    rows, item, shared = corpus(random.Random(6))
    long = " ".join(f"the{i} and{i}" for i in range(30_000))
    odd = [tuple(r) for r in rows[:40]] + [(70, None, None, None, None), (None, rows[41][1], "de", "s", 1), (71, "", "en", "s", 0), (72, long, "en", "s", 5), (73, rows[45][1], "de", "s", 1), (73, rows[45][1], "de", "s", 1), (73, rows[46][1], "en", "s", 1)]
    docs = spark.createDataFrame(odd, DOCS).selectExpr("*", "7 AS n_removed", "8 AS key_a", "9 AS n_lines", "'x' AS row")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kinds, sizes = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
        docs = kept(stage(spark, docs, str(tmp_path)), "t")
        assert docs.columns == kinds and {tuple(r) for r in docs.select("n_removed", "key_a", "n_lines", "row").distinct().collect()} == {(7, 8, 9, "x")}
        sizes[name] = sorted((-1 if r.doc_id is None else r.doc_id) for r in docs.collect())
    assert {70, 71}.isdisjoint(sizes["language"]) and sizes["language"].count(73) == 3 and -1 in sizes["language"] and 72 in sizes["language"]
    assert sizes["lines"].count(73) == 3 and sizes["near_duplicates"].count(73) == 2 and 72 in sizes["decontamination"]
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path))
    assert packed.filter("doc_id = 72").count() > 50 and packed.filter("doc_id IS NULL").count() == 1
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), str(tmp_path)).count() == 0
