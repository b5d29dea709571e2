"""Near-duplicate groups by SuperMinHash, banding, verification and union-find.

1. Every text becomes the set of its distinct runs of five words.  Documents
   with the same set are one class, which its smallest doc_id stands for; the
   rest of the work is on classes, so copies cost nothing more.
2. A class's signature is its SuperMinHash: every element walks one random
   permutation of the signature's places and offers a growing rank at each, so
   places are negatively correlated (less variance than independent hashes)
   and the walk ends as soon as no place can still improve.
3. Signatures are banded.  With 32 bands of 5 places a pair at similarity 0.85
   shares no band with probability 7e-9, one at 0.8 with 3e-6.  The members of
   a bucket are tied to its smallest member (a star, never all pairs); what
   hangs together so is a family, and all links lie within families.
4. Families are cut into blocks of bounded size, and blocks meet as tiles.  In a
   tile, pairs whose signatures agree too little for the similarity (5 standard
   errors) are passed over, pairs already linked in the tile as well, and the
   rest are verified on their full sets.  A tile returns a spanning forest of
   its links, so what leaves it grows with its members, not its pairs.
5. Links meet in connected components by alternating stars.

Cases: a null or blank text has no shingles and stays alone.  A text of fewer
than five words is one shingle.  Repeated rows are copies; rows that share a
doc_id are one node of the graph (``keep_one_of_each`` tells them apart by text).
A very long text is one set, held by one task at a time.  A row without doc_id is linked with nothing and
kept.  An empty table gives no rows.  Other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm.common import in_arrow, kept, mixed, row_key, slices
from tallyframe.llm.graph import components
from tallyframe.llm.hashing import shingles, words

BANDS, BAND_ROWS = 32, 5
#: Ids or buckets of at most so many rows are broadcast (some 10 MB); beyond it the join shuffles.
BROADCAST_IDS = 500_000
#: Bytes of shingles in one block of a family.
BLOCK_BYTES = 4 << 20
#: Elements that walk together.
WALKERS = 65_536


def superminhash(elements: np.ndarray, owner: np.ndarray, n_owners: int, places: int) -> np.ndarray:
    """Signatures (n_owners x places) of the sets whose hashed elements are given with their owner."""
    best = np.full((n_owners, places), np.inf)
    flat = best.reshape(-1)
    for at in range(0, len(elements), WALKERS):
        seeds, own = elements[at : at + WALKERS], owner[at : at + WALKERS].astype(np.int64)
        walk = np.tile(np.arange(places, dtype=np.int16), (len(seeds), 1))
        row = np.arange(len(seeds))
        for j in range(places):
            x = mixed(seeds[row] + np.uint64((j * 0x9E3779B97F4A7C15 + 1) % 2**64))
            rank = (x >> np.uint64(11)).astype(np.float64) * 2.0**-53 + j
            k = j + (((x * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(32)) * np.uint64(places - j) >> np.uint64(32)).astype(np.int64)
            place = walk[row, k]
            walk[row, k] = walk[row, j]
            np.minimum.at(flat, own[row] * places + place, rank)
            if j + 1 < places:
                owners = np.unique(own[row])
                still = owners[best[owners].max(axis=1) > j + 1]  # early stop: ranks only grow
                if len(still) < len(owners):
                    row = row[np.isin(own[row], still)]
                    if not len(row):
                        break
    return best


def band_hashes(signatures: np.ndarray, bands: int, band_rows: int) -> np.ndarray:
    bits = signatures.view(np.uint64).reshape(len(signatures), bands, band_rows)
    out = np.full(bits.shape[:2], np.uint64(17))
    for j in range(band_rows):
        out = mixed(out * np.uint64(31) + bits[:, :, j])
    return mixed(out + np.arange(bands, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


def _long(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


def signed(docs: DataFrame, k: int = 5, bands: int = BANDS, band_rows: int = BAND_ROWS) -> DataFrame:
    """doc_id, the row's key, n_shingles, a 128-bit digest of the shingle set, and the band hashes of every row."""
    schema = pa.schema([("doc_id", pa.int64()), ("key_a", pa.int64()), ("key_b", pa.int64()), ("n_shingles", pa.int64()), ("set_a", pa.int64()), ("set_b", pa.int64()), ("bands", pa.list_(pa.int64()))])

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 128):
            sets = shingles(*words(batch.column("text")), k)
            n = np.array([len(s) for s in sets], np.int64)
            every, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), n)
            places = band_hashes(superminhash(every, owner, len(sets), bands * band_rows), bands, band_rows)
            sums = [[int(mixed(s + np.uint64(salt)).sum()) for s in sets] for salt in (1, 2)]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in ("doc_id", "key_a", "key_b")], pa.array(n), *[pa.array(_long(np.array(s, dtype=np.uint64))) for s in sums], pa.array(list(places), pa.list_(pa.int64()))], schema=schema
            )

    return in_arrow(docs.select("doc_id", "text", *row_key("doc_id", "text")), step, "doc_id long, key_a long, key_b long, n_shingles long, set_a long, set_b long, bands array<long>")


def sets_of(docs: DataFrame, k: int, places: int) -> DataFrame:
    """doc_id, its sorted shingle hashes, and 16 bits of each place of its signature, as binary."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 128):
            sets = shingles(*words(batch.column("text")), k)
            owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
            signature = mixed(superminhash(np.concatenate(sets), owner, len(sets), places).view(np.uint64)).astype(np.uint16)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([s.tobytes() for s in sets], pa.binary()), pa.array([s.tobytes() for s in signature], pa.binary())], names=["doc_id", "elements", "signature"])

    return in_arrow(docs.select("doc_id", "text"), step, "doc_id long, elements binary, signature binary")


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    small, large = (x, y) if len(x) < len(y) else (y, x)
    at = np.searchsorted(large, small)
    at[at == len(large)] = 0
    both = int(np.count_nonzero(large[at] == small))
    return 100 * both >= percent * (len(x) + len(y) - both)


def tile_links(left: list[dict], right: list[dict], percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links within ``left`` (``right`` empty), or between ``left`` and ``right``."""
    rows = left + right
    sets = [np.frombuffer(r["elements"], np.uint64) for r in rows]
    n, signature = np.array([len(s) for s in sets]), np.stack([np.frombuffer(r["signature"], np.uint16) for r in rows])
    j = percent / 100
    least = j - 5 * np.sqrt(j * (1 - j) / signature.shape[1])
    parent, out = list(range(len(rows))), []

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i in range(len(left)):
        first = len(left) if right else i + 1
        if first >= len(rows):
            break
        agree = (signature[first:] == signature[i]).mean(axis=1)
        possible = np.flatnonzero((agree >= least) & (100 * np.minimum(n[first:], n[i]) >= percent * np.maximum(n[first:], n[i])))
        for k in (possible[np.argsort(-agree[possible], kind="stable")] + first).tolist():
            a, b = find(i), find(k)
            if a != b and similar(sets[i], sets[k], percent):
                parent[max(a, b)] = min(a, b)
                out.append((rows[i]["rid"], rows[k]["rid"]))
    return out


def family_links(sets: DataFrame, percent: int, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Links (a, b) that connect what is similar within each family of ``sets`` (family, rid, elements, signature)."""
    weight = sets.groupBy("family").agg(F.sum(F.octet_length("elements") + F.octet_length("signature")).alias("bytes"))
    blocks = weight.select("family", F.ceil(F.col("bytes") / block_bytes).cast("int").alias("blocks"))
    placed = sets.join(blocks, "family").withColumn("block", F.pmod(F.xxhash64("rid"), F.col("blocks")).cast("int"))
    # Dealt out by block: what went before lies by family, and a family can be any size.
    packed = kept(placed.repartition("family", "block").groupBy("family", "block").agg(F.first("blocks").alias("blocks"), F.collect_list(F.struct("rid", "elements", "signature")).alias("rows")), "blocks")
    within = packed.select("rows", F.array().cast(packed.schema["rows"].dataType).alias("others"))
    left = packed.filter("block < blocks - 1").withColumn("other", F.explode(F.sequence(F.col("block") + 1, F.col("blocks") - 1)))
    right = packed.filter("block > 0").select("family", F.col("block").alias("other"), F.col("rows").alias("others"))
    across = left.join(right, ["family", "other"]).select("rows", "others")

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            links = tile_links(batch.column("rows")[0].as_py(), batch.column("others")[0].as_py(), percent)
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in links], pa.int64()) for i in (0, 1)], names=["a", "b"])

    return in_arrow(within.unionByName(across), step, "a long, b long")


def near_duplicates(docs: DataFrame, percent: int = 85, k: int = 5, bands: int = BANDS, band_rows: int = BAND_ROWS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of ``docs``."""
    return _grouped(docs, percent, k, bands, band_rows, block_bytes).select("doc_id", "n_shingles", "component_id", "kept")


def _grouped(docs: DataFrame, percent: int, k: int = 5, bands: int = BANDS, band_rows: int = BAND_ROWS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    rows = kept(signed(docs, k, bands, band_rows), "signed")
    classes = kept(
        rows.filter("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("set_a", "set_b", "n_shingles").agg(F.min("doc_id").alias("rid"), F.first("bands").alias("bands")), "classes"
    )
    banded = classes.select("rid", F.explode("bands").alias("bucket"))
    shared = kept(banded.groupBy("bucket").agg(F.min("rid").alias("low"), F.max("rid").alias("high")).filter("low < high").select("bucket", "low"), "shared")
    shared = F.broadcast(shared) if shared.count() <= BROADCAST_IDS else shared
    families = kept(components(banded.join(shared, "bucket").select(F.col("low").alias("a"), F.col("rid").alias("b"))), "families")
    members = families.select(F.col("node").alias("doc_id"))
    named = docs.join(F.broadcast(members) if families.count() <= BROADCAST_IDS else members, "doc_id", "left_semi")
    sets = sets_of(named, k, bands * band_rows).select(F.col("doc_id").alias("rid"), "elements", "signature")
    sets = kept(sets.join(families.select(F.col("node").alias("rid"), F.col("comp").alias("family")), "rid"), "sets")
    groups = components(family_links(sets, percent, block_bytes))

    named = classes.select("set_a", "set_b", "n_shingles", "rid").join(groups.withColumnRenamed("node", "rid"), "rid", "left").select("set_a", "set_b", "n_shingles", F.coalesce("comp", "rid").alias("component_id"))
    return (
        rows.drop("bands")
        .join(named, ["set_a", "set_b", "n_shingles"], "left")
        .withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")))
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    )


def keep_one_of_each(docs: DataFrame, percent: int = 80) -> DataFrame:
    """``docs`` without all but one document of each group.

    Rows go by content: of two texts under one doc_id, one may go and the other
    stay.  Of rows that share doc_id and shingles one stays, so a row that is
    repeated in full is there once.  Rows without shingles or doc_id all stay.
    What goes is broadcast while it is few, shuffled beyond that.
    """
    found = kept(_grouped(docs, percent).select("doc_id", "key_a", "key_b", "n_shingles", "set_a", "set_b", "kept"), "grouped")
    real = found.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    key = F.struct("key_a", "key_b")
    shared = real.filter("kept").groupBy("doc_id", "set_a", "set_b").agg(F.min(key).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    more = real.join(shared, ["doc_id", "set_a", "set_b"])
    gone = kept(real.filter(~F.col("kept")).select("key_a", "key_b").unionByName(more.filter(key != F.col("first")).select("key_a", "key_b")).distinct(), "gone")
    again = kept(more.filter(key == F.col("first")).groupBy("key_a", "key_b").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key_a", "key_b"), "repeated")
    few = {name: F.broadcast(df) if df.count() <= BROADCAST_IDS else df for name, df in (("gone", gone), ("again", again))}
    left = docs.select(F.struct("*").alias("row"), *row_key("doc_id", "text")).join(few["gone"], ["key_a", "key_b"], "left_anti")
    once = left.join(few["again"], ["key_a", "key_b"], "left_semi").dropDuplicates(["key_a", "key_b"])
    return left.join(few["again"], ["key_a", "key_b"], "left_anti").unionByName(once).select("row.*")


def op8_superminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), 85)


OP8_SQL = r"""
WITH RECURSIVE cut AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))
                      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM cut
), sizes AS (
  SELECT doc_id, len(s) AS n FROM sets
), elements AS (
  SELECT doc_id, unnest(s) AS g FROM sets
), shared AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM elements a JOIN elements b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2
), links AS (
  SELECT x, y FROM shared JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * i >= 85 * (p.n + q.n - i)
), edges AS (
  SELECT x, y FROM links UNION ALL SELECT y, x FROM links
), reach AS (
  SELECT doc_id AS node, doc_id AS root FROM sizes
  UNION
  SELECT edges.y, reach.root FROM reach JOIN edges ON edges.x = reach.node
), comps AS (
  SELECT node, min(root) AS component_id FROM reach GROUP BY node
)
SELECT s.doc_id, CAST(s.n AS BIGINT) AS n_shingles, component_id, s.doc_id = component_id AS kept FROM sizes s JOIN comps ON node = s.doc_id
"""
