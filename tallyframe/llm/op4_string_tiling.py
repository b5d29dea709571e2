"""Benchmark decontamination by greedy string tiling.

A benchmark item leaks into a document when enough of the item's words can be
covered by non-overlapping runs that the two have in common, wherever and in
whichever order the runs stand in the document.

1. Seeds: every run of ``min_match`` words of every item, hashed.  Documents are
   searched for seeds, first through a bitmap of fixed size (2 MB) that lets
   nothing through but possible seeds, then by a join on the seed.
2. A pair of document and item is tiled only if its seeds could cover enough of
   the item: a seed covers ``min_match`` words at most at each of its places in
   the item.
3. Tiling: Karp-Rabin hashes of the unmarked windows of both texts give the
   longest common run; it is marked, then the longest of what is left, down to
   ``min_match`` words.  Coverage is the marked share of the item's words.

Words are runs of letters and digits, lower-cased.

Cases: an item of fewer than ``min_match`` words is one seed of its own length;
an item without words is left out.  Items with the same words are one, the
smallest item_id; items that share an item_id but not the words, or have none,
are items of their own.  A null or blank document leaks nothing (coverage 0).
Repeated rows keep a row each.  Ties between items go to the smallest item_id.
Empty tables give no rows, or no leaks.  Other columns are left out, and kept
by ``remove_leaks``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm.common import in_arrow, kept, mixed, row_key, slices
from tallyframe.llm.hashing import ALPHANUMERIC, powers, runs, words

BITMAP_BITS = 1 << 24
#: Leaking documents' keys of at most so many rows are broadcast (8 MB); beyond it the join shuffles.
BROADCAST_KEYS = 200_000


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return words(pc.utf8_lower(column), ALPHANUMERIC)


class _Windows:
    """Karp-Rabin hashes of all windows of a text, of any length, and which of its words are marked."""

    def __init__(self, hashes: np.ndarray):
        up, self.down = powers(1 << max(10, len(hashes).bit_length()))
        self.total = np.zeros(len(hashes) + 1, np.uint64)
        np.cumsum(hashes * up[: len(hashes)], out=self.total[1:])
        self.marked = np.zeros(len(hashes), bool)

    def free(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and hashes of the windows without a marked word."""
        seen = np.concatenate(([0], np.cumsum(self.marked)))
        at = np.flatnonzero(seen[length:] == seen[:-length])
        return at, mixed((self.total[at + length] - self.total[at]) * self.down[at])


def _mark(a: _Windows, b: _Windows, length: int) -> list[tuple[int, int, int]]:
    """Mark the common windows of a length, first in the document first, then first in the item."""
    (x, hx), (y, hy) = a.free(length), b.free(length)
    both = np.intersect1d(hx, hy)
    x, hx, y, hy = x[np.isin(hx, both)], hx[np.isin(hx, both)], y[np.isin(hy, both)], hy[np.isin(hy, both)]
    places: dict[int, list[int]] = {}
    for place, h in zip(x[::-1].tolist(), hx[::-1].tolist(), strict=True):
        places.setdefault(h, []).append(place)
    out, end = [], 0
    for place, h in zip(y.tolist(), hy.tolist(), strict=True):
        mine = places[h]
        while place >= end and mine:
            at = mine.pop()  # a place that is taken now stays taken
            if not a.marked[at : at + length].any():
                a.marked[at : at + length] = b.marked[place : place + length] = True
                out.append((at, place, length))
                end = place + length
    return out


def tiled(item: np.ndarray, doc: np.ndarray, min_match: int) -> list[tuple[int, int, int]]:
    """(place in item, place in doc, length) of the tiles, longest first.

    The longest length at which the texts have an unmarked window in common is
    searched by halving, its windows are marked, and the search goes on below it:
    memory is linear in the texts, however repetitive they are.
    """
    least, out = min(min_match, len(item)), []
    if not least or len(doc) < least:
        return out
    a, b, high = _Windows(item), _Windows(doc), min(len(item), len(doc))
    while high >= least:
        low = least - 1
        while low < high:
            middle = (low + high + 1) // 2
            if len(np.intersect1d(a.free(middle)[1], b.free(middle)[1])):
                low = middle
            else:
                high = middle - 1
        if low < least:
            break
        out += _mark(a, b, low)
        high = low - 1
    return out


def different_items(items: DataFrame, min_match: int) -> DataFrame:
    """(same, n_words, item_id, span, item, seeds, places), a row for each different run of words.

    ``same`` is a hash of all words; ``span`` is the words of a seed, and
    ``places`` has how often the item holds each seed.
    """
    schema = pa.schema([("item_id", pa.int64()), ("same", pa.int64()), ("n_words", pa.int32()), ("span", pa.int32()), ("item", pa.string()), ("seeds", pa.list_(pa.int64())), ("places", pa.list_(pa.int32()))])

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            hashes, bounds = word_hashes(batch.column("text"))
            out = []
            for item_id, text, a, b in zip(batch.column("item_id").to_pylist(), batch.column("text").to_pylist(), bounds[:-1], bounds[1:], strict=True):
                if b > a:
                    span = int(min(min_match, b - a))
                    whole = int(runs(hashes[a:b], int(b - a)).view(np.int64)[0])
                    seeds, places = np.unique(runs(hashes[a:b], span), return_counts=True)
                    out.append({"item_id": item_id, "same": whole, "n_words": int(b - a), "span": span, "item": text, "seeds": seeds.view(np.int64).tolist(), "places": places.tolist()})
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    every = in_arrow(items.select("item_id", "text"), step, "item_id long, same long, n_words int, span int, item string, seeds array<long>, places array<int>")
    first = F.min(F.struct("item", "seeds", "places")).alias("first")
    return every.groupBy("same", "n_words", "span").agg(F.min("item_id").alias("item_id"), first).select("same", "n_words", "span", "item_id", "first.*")


def bitmap_of(seeds: DataFrame) -> np.ndarray:
    """One bit for each seed modulo the bitmap's size, as bytes; 2 MB whatever the seeds."""
    bit = F.pmod(F.col("seed"), F.lit(BITMAP_BITS)) + 1  # the bitmap functions count from 1
    rows = seeds.groupBy(F.bitmap_bucket_number(bit).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bits")).collect()
    out = np.zeros(BITMAP_BITS // 8, np.uint8)
    for r in rows:
        at = (r["bucket"] - 1) * 4096
        out[at : at + 4096] |= np.frombuffer(bytes(r["bits"]), np.uint8)
    return out


def leaks(docs: DataFrame, items: DataFrame, min_match: int = 5, coverage: float = 0.5) -> DataFrame:
    """(key_a, key_b, item_id, coverage, n_tiles) of every document's best item that reaches the coverage."""
    spark = docs.sparkSession
    different = kept(different_items(items, min_match), "items")
    seeds = kept(different.select("same", "n_words", "span", F.explode(F.arrays_zip("seeds", "places")).alias("s")).select("same", "n_words", "span", F.col("s.seeds").alias("seed"), F.col("s.places").alias("places")), "seeds")
    spans = sorted(r["span"] for r in seeds.select("span").distinct().collect())  # min_match values at most
    bitmap = spark.sparkContext.broadcast(bitmap_of(seeds))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = bitmap.value
        for batch in slices(batches):
            hashes, bounds = word_hashes(batch.column("text"))
            found = []  # (row, seed)
            for span in spans:
                every = runs(hashes, span)
                bit = (every.view(np.int64) % BITMAP_BITS).astype(np.int64)
                hit = np.flatnonzero(bits[bit >> 3] >> (bit & 7) & 1)
                row = np.searchsorted(bounds, hit, side="right") - 1
                inside = hit + span <= bounds[row + 1]
                found.append(np.stack([row[inside], every[hit[inside]].view(np.int64)]))
            pairs = np.unique(np.concatenate(found, axis=1), axis=1) if found else np.empty((2, 0), np.int64)
            rows, at = np.unique(pairs[0], return_index=True)
            if len(rows):
                own = pa.ListArray.from_arrays(pa.array(np.append(at, pairs.shape[1]), pa.int32()), pa.array(pairs[1]))
                yield pa.RecordBatch.from_arrays([*[batch.column(c).take(pa.array(rows)) for c in ("key_a", "key_b", "text")], own], names=["key_a", "key_b", "text", "seeds"])

    hits = in_arrow(docs.select(*row_key("doc_id", "text"), "text"), search, "key_a long, key_b long, text string, seeds array<long>")
    hits = kept(hits.dropDuplicates(["key_a", "key_b"]), "hits")
    shared = hits.select("key_a", "key_b", F.explode("seeds").alias("seed")).join(seeds, "seed")
    # Every covered word lies in a shared seed at one of its places in the item.
    pairs = shared.groupBy("key_a", "key_b", "same", "n_words", "span").agg(F.sum("places").alias("n")).filter(F.col("n") * F.col("span") >= coverage * F.col("n_words")).select("key_a", "key_b", "same", "n_words")

    def tile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 64):
            x, xb = word_hashes(batch.column("item"))
            y, yb = word_hashes(batch.column("text"))
            found = [tiled(x[xb[i] : xb[i + 1]], y[yb[i] : yb[i + 1]], min_match) for i in range(batch.num_rows)]
            share = [sum(t[2] for t in f) / max(1, int(xb[i + 1] - xb[i])) for i, f in enumerate(found)]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in ("key_a", "key_b", "item_id")], pa.array(share, pa.float64()), pa.array([len(f) for f in found], pa.int64())], names=["key_a", "key_b", "item_id", "coverage", "n_tiles"]
            )

    texts = different.select("same", "n_words", "item_id", "item")
    tiles = pairs.join(texts, ["same", "n_words"]).join(hits.select("key_a", "key_b", "text"), ["key_a", "key_b"]).select("key_a", "key_b", "item_id", "item", "text")
    tiles = in_arrow(tiles, tile, "key_a long, key_b long, item_id long, coverage double, n_tiles long").filter(F.col("coverage") >= coverage)
    best = F.max(F.struct("coverage", (-F.col("item_id")).alias("m"), "n_tiles"))
    return kept(tiles.groupBy("key_a", "key_b").agg(best.alias("best")).select("key_a", "key_b", (-F.col("best.m")).alias("item_id"), F.col("best.coverage").alias("coverage"), F.col("best.n_tiles").alias("n_tiles")), "leaks")


def _few(found: DataFrame) -> DataFrame:
    return F.broadcast(found) if found.count() <= BROADCAST_KEYS else found


def find_leaks(docs: DataFrame, items: DataFrame, min_match: int = 5, coverage: float = 0.5) -> DataFrame:
    """doc_id, contaminated, item_id, coverage and n_tiles of every row of ``docs``."""
    found = _few(leaks(docs, items, min_match, coverage))
    return docs.select("doc_id", *row_key("doc_id", "text")).join(found, ["key_a", "key_b"], "left").select(
        "doc_id", F.col("coverage").isNotNull().alias("contaminated"), "item_id", F.coalesce("coverage", F.lit(0.0)).alias("coverage"), F.coalesce("n_tiles", F.lit(0)).cast("long").alias("n_tiles")
    )


def remove_leaks(docs: DataFrame, items: DataFrame, min_match: int = 5, coverage: float = 0.5) -> DataFrame:
    """``docs`` without the documents into which an item leaks; all columns are kept."""
    found = _few(leaks(docs, items, min_match, coverage))
    keyed = docs.select(F.struct("*").alias("row"), *row_key("doc_id", "text"))
    return keyed.join(found, ["key_a", "key_b"], "left_anti").select("row.*")


def op4_string_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), 5, 0.5)
