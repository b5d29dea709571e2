"""Both Lloyd operators against plain loops over whole numbers."""

import hashlib
import math
import random

import numpy as np
import pytest

from tallyframe.llm import op12_dimension_lloyd as op12
from tallyframe.llm import op13_resident_lloyd as op13
from tallyframe.llm.lloyd import from_bytes, squared_distances, sums_by, to_bytes

SCHEMA = "vec_id long, embedding array<float>, label int, row int, block string, cluster int"


def vectors(n, dims, seed=1, spread=0.3):
    """Rows with nulls, bad components, other lengths, repeated rows, shared ids and one vector that many rows hold."""
    rng = random.Random(seed)
    one = [round(rng.gauss(0, spread), 2) for _ in range(dims)]
    out = [(i, [rng.gauss(0, spread) for _ in range(dims)] if i % 3 else list(one), rng.choice([None, 0, 1, 2])) for i in range(n)]
    out += [out[4], out[4], (out[5][0], out[7][1], 1), (None, out[8][1], None)]
    out += [(n + 1, None, 1), (n + 2, [], 1), (n + 3, [0.1] * (dims - 1) + [None], 1), (n + 4, [math.nan] * dims, 1), (n + 5, [math.inf] + [0.0] * (dims - 1), 2), (n + 6, [0.5] * (dims + 1), 2)]
    return [(*r, 1, "b", 2) for r in out]


def usable(rows, dims, scale):
    x = [(r[0], r[2], r[1]) for r in rows if r[1] is not None and len(r[1]) == dims and all(c is not None and math.isfinite(c) for c in r[1])]
    return [(i, label, [math.floor(scale * float(np.float32(c))) for c in v]) for i, label, v in x]


def nearest(v, centroids):
    d = [sum((a - b) ** 2 for a, b in zip(v, c, strict=True)) for c in centroids]
    return d.index(min(d)), min(d)


def lloyd(values, centroids, rounds):
    centroids = [list(c) for c in centroids]
    for _ in range(rounds):
        members = [[] for _ in centroids]
        for v in values:
            members[nearest(v, centroids)[0]].append(v)
        centroids = [[sum(c) // len(m) for c in zip(*m, strict=True)] if m else old for m, old in zip(members, centroids, strict=True)]
    return centroids, [nearest(v, centroids) for v in values]


def joined_sha(values):
    return hashlib.sha256(",".join(map(str, values)).encode()).hexdigest()


@pytest.mark.parametrize(("n", "k", "dims", "blocks"), [(300, 7, 6, 2), (60, 40, 5, 3), (9, 40, 4, 4)])
def test_op12_equals_a_loop(spark, monkeypatch, n, k, dims, blocks):
    monkeypatch.setattr(op12, "GROUP_ROWS", 50)
    rows = vectors(n, dims)
    out = op12.cluster(spark.createDataFrame(rows, SCHEMA).repartition(3), k, 5, dims, 256, "2:", blocks).collect()
    fine = usable(rows, dims, 256)
    first = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), v) for i, _, v in fine if i is not None)[:k]
    centroids, found = lloyd([v for *_, v in fine], [v for _, v in first], 5)
    inertia = [sum(d for c, d in found if c == j) for j in range(len(centroids))]
    want = [(i, c, d, inertia[c], sum(inertia), joined_sha(centroids[c])) for (i, *_), (c, d) in zip(fine, found, strict=True)]
    assert sorted(map(tuple, out), key=str) == sorted(want, key=str)


@pytest.mark.parametrize(("n", "entries", "dims", "parts"), [(300, 5, 8, 4), (40, 16, 16, 8), (9, 16, 8, 8)])
def test_op13_equals_a_loop(spark, monkeypatch, n, entries, dims, parts):
    monkeypatch.setattr(op13, "OWNER_ROWS", 64)  # several salts
    rows = vectors(n, dims)
    out = op13.compress(spark.createDataFrame(rows, SCHEMA).repartition(3), parts, entries, 6, 4096).collect()
    fine = usable(rows, dims, 4096)
    seeds = [v for _, v in sorted((math.inf if i is None else i, v) for i, _, v in fine)[:entries]]
    width, books, codes = dims // parts, [], []
    for p in range(parts):
        at = slice(p * width, (p + 1) * width)
        book, found = lloyd([v[at] for *_, v in fine], [s[at] for s in seeds], 6)
        books.append(book)
        codes.append(found)
    each = [("".join(f"{c[i][0]:02x}" for c in codes), sum(c[i][1] for c in codes)) for i in range(len(fine))]
    by_label = {x: sum(e for (_, e), (_, label, _) in zip(each, fine, strict=True) if label == x) for _, x, _ in fine}
    sha = joined_sha([x for book in books for entry in book for x in entry])
    want = [(i, code, error, by_label[label], sha) for (i, label, _), (code, error) in zip(fine, each, strict=True)]
    assert sorted(map(tuple, out), key=str) == sorted(want, key=str)


def test_only_members_that_change_entry_are_shuffled(spark):
    owners = op13.Owners(2, 3)
    parts = np.arange(40)[:, None]
    blocks = list(owners.blocks(0, np.arange(40), parts, (parts[:, 0] >= 30).astype(np.int64)))
    state = spark.sparkContext.parallelize(blocks, 2).partitionBy(4, op13.place)
    step = op13.moved(state, np.array([[[5], [35]]]), owners).persist()
    after = op13.next_state(step)
    assert after.getNumPartitions() == 4 and after.partitioner == state.partitioner
    went = [(o, m) for o, (stays, m) in step.collect() if not stays]
    assert sorted(np.concatenate([m[1][:, 0] for _, m in went])) == list(range(21, 30))
    lineage = after.toDebugString().decode()
    assert "PartitionerAwareUnionRDD" in lineage
    held = after.mapPartitionsWithIndex(lambda i, b: [(i, o, len(m[0])) for o, m in b]).collect()
    assert all(o % 4 == i for i, o, _ in held) and sum(n for *_, n in held) == 40
    step.unpersist()


def test_owners_of_one_entry_are_many():
    owners = op13.Owners(16, 10)
    sizes = [len(rows) for _, (rows, _) in owners.blocks(3, np.arange(100_000), np.zeros((100_000, 2), np.int64), np.full(100_000, 5))]
    assert len(sizes) == 10 and max(sizes) < 11_000 and sum(sizes) == 100_000


def test_no_vectors(spark):
    none = spark.createDataFrame([(1, None, 1, 1, "", 1), (2, [math.nan], 1, 1, "", 1)], SCHEMA)
    assert op12.cluster(none, 3, 2, 1).collect() == [] and op13.compress(none, 1).collect() == []
    assert op12.cluster(none, 3, 2, 1).schema.names == [c.split()[0] for c in op12.OUT.split(", ")]
    with pytest.raises(ValueError):
        op13.compress(spark.createDataFrame([(1, [1.0, 2.0, 3.0], 1, 1, "", 1)], SCHEMA), 2)


@pytest.mark.parametrize("size", [100, 10**7, 10**8])
def test_distances_are_exact(size):
    rng = np.random.default_rng(size)
    x, c = rng.integers(-size, size, (20, 9)), rng.integers(-size, size, (5, 9))
    want = [[sum((int(a) - int(b)) ** 2 for a, b in zip(v, w, strict=True)) for w in c] for v in x]
    assert squared_distances(x, c).tolist() == want
    assert from_bytes(to_bytes(x)).reshape(x.shape).tolist() == x.tolist() and len(to_bytes(x % 100)) == x.size + 1
    labels = rng.integers(0, 3, 20) * 2
    total, n = sums_by(labels, x, 6)
    assert total.tolist() == [x[labels == j].sum(axis=0).tolist() for j in range(6)] and n.tolist() == [int((labels == j).sum()) for j in range(6)]


def test_distances_that_do_not_fit_raise():
    with pytest.raises(OverflowError):
        squared_distances(np.array([[1 << 40]]), np.array([[0]]))
