"""Best-fit packing of token pieces into sequences of a fixed length, by bulk-synchronous supersteps.

Documents are encoded and cut into pieces; every piece gets its rank among the
pieces of its length, by counting within partitions and adding up the counts of
the partitions before (no window over single pieces).  Pieces of a length are
alike, and so are gaps of a size; the range-sorted list of pieces and that of
gaps are kept as tables of runs (length, first rank, how many), whose number
depends on ``max_tokens`` and the supersteps, not on the documents.

A superstep takes the band of the longest pieces that are left and places as
many of them as there is room for, all at once:

1. Gaps are sorted by size, and each offers as many slots as it holds pieces of
   the band.  Running sums of slots and pieces from the longest down say how
   many pieces of each length get a slot: where more claim the slots than there
   are, the ranks decide, longest first.
2. Those pieces, shortest first, each go to their successor, the first slot that
   holds them and that no piece before them has: a running maximum.
3. Runs of pieces and of slots, cut into ranges of the slots' order, meet in a
   sweep over each range.  Ranges are tasks of their own.  Runs are of few sizes:
   where ``max_tokens`` says that they are one range of ``RANGE_RUNS``, whatever the
   documents, its task goes from superstep to superstep (``supersteps``).
4. The gaps are updated and written with what is left, and the next superstep
   begins.

Where no gap holds a piece of the band, the longest pieces open sequences: those
of which whole sequences can be filled do so, else as many of the longest as the
band's volume needs.  The driver sees the lengths that are left, the largest gap
and a counter; runs are matched by Spark and the result is joined to the pieces.

Sequences are as many as one-by-one best-fit decreasing makes, to within a few
(tested).

Cases: a null or empty text is the end id alone.  Repeated rows are packed as
documents of their own, and rows that share a doc_id too.  A null doc_id is kept
as it is.  A very long text is cut into pieces and needs one batch of memory.
An empty table gives no rows.  Other columns are left out.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyframe.llm.common import in_arrow, kept, scratch, slices
from tallyframe.llm.encoding import ENCODE_BYTES, ENCODE_ROWS, byte_level

PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long, part int, local long"
_PIECES = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int32()), ("ids_crc32", pa.int64()), ("part", pa.int32()), ("local", pa.int64())])

#: Runs of gaps and lengths to a range: with more of them a sweep is spread over several tasks.
RANGE_RUNS = 4096
#: Kinds of runs: pieces that are left, gaps, and pieces that have their place.
LEFT, GAP, PLACED = 0, 1, 2
RUNS = "kind int, size int, first long, n long, sequence long, each long, at int"


def cut(n: int, most: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` ids; the first one takes what full pieces leave."""
    first = n if n <= most else n % most or most
    return [(0, first)] + [(at, most) for at in range(first, n, most)]


def pieces(docs: DataFrame, tokenizer: str, end_id: int, max_tokens: int) -> DataFrame:
    """One row for each piece, with its number among the pieces of its length in its partition."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), [0] * (max_tokens + 1)
        for batch in slices(batches, ENCODE_ROWS, ENCODE_BYTES):
            ids, bounds = byte_level(tokenizer).encode(batch.column("text"), end_id)
            data, out = memoryview(ids).cast("B"), []
            for doc_id, at, n in zip(batch.column("doc_id").to_pylist(), bounds[:-1].tolist(), np.diff(bounds).tolist(), strict=True):
                for k, (start, length) in enumerate(cut(n, max_tokens)):
                    out.append((doc_id, k, start, length, zlib.crc32(data[4 * (at + start) : 4 * (at + start + length)]), part, seen[length]))
                    seen[length] += 1
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _PIECES, strict=True)], schema=_PIECES)

    return in_arrow(docs.select("doc_id", "text"), encode, PIECES)


def band_of(longest: int, max_tokens: int) -> int:
    """The length over which pieces are in the band of the longest one: as many fill a sequence, or half to double as many."""
    k = max_tokens // longest
    if k < 4:
        return max_tokens // (k + 1)
    low = max_tokens // 4
    while low >= longest:
        low //= 2
    return low


_GAP, _PIECE = "STRUCT<size: INT, sequence: BIGINT, k: BIGINT, lo: BIGINT, hi: BIGINT>", "STRUCT<size: INT, first: BIGINT, lo: BIGINT, hi: BIGINT>"


def _run(*values: str) -> str:
    """A row of the table of runs as a SQL struct."""
    return "named_struct(" + ", ".join(f"'{name}', CAST({value} AS {kind})" for (name, kind), value in zip((c.split() for c in RUNS.split(", ")), values, strict=True)) + ")"


#: One superstep in which the band's pieces go to their successors among the gaps.
MATCH = f"""
WITH both AS (  -- slots that hold a piece, and pieces as long or longer; a gap counts for pieces of its own size
  SELECT *, sum(slots) OVER down AS hold, sum(n) OVER down AS pieces, sum(slots) OVER () AS total FROM (
    SELECT kind, size, first, sequence, IF(kind = 0, n, 0L) AS n, greatest(1, size DIV :longest) AS k, IF(kind = 1, n * greatest(1, size DIV :longest), 0L) AS slots FROM {{runs}} WHERE size > :low)
  WINDOW down AS (ORDER BY size DESC, kind DESC, sequence DESC)
), settled AS (  -- where more pieces claim the slots than there are, the longest get them
  SELECT size, first, n, total, hold, get - lag(get, 1, 0L) OVER (ORDER BY size DESC) AS take FROM (
    SELECT *, pieces + least(0, min(hold - pieces) OVER (ORDER BY size DESC)) AS get FROM both WHERE kind = 0)
), sent AS (  -- shortest first to the successor that is free
  SELECT size, first, total, lo + before AS lo, lo + before + take AS hi FROM (
    SELECT *, max(total - hold - before) OVER (ORDER BY size) AS lo FROM (
      SELECT *, sum(take) OVER (ORDER BY size) - take AS before FROM settled WHERE take > 0))
), placed AS (  -- the slots in order
  SELECT struct(size, sequence, k, total - hold AS lo, total - hold + slots AS hi) AS gap, total FROM both WHERE kind = 1
), cells AS (  -- both sides, cut at the bounds of ranges of slots
  SELECT gap, NULL AS piece, gap.lo AS lo, gap.hi AS hi, greatest(1, total DIV :ranges + 1) AS width FROM placed
  UNION ALL SELECT NULL, struct(size, first, lo, hi), lo, hi, greatest(1, total DIV :ranges + 1) FROM sent
), events AS (
  SELECT range, e.* FROM (
    SELECT range, inline(filter(array(
      struct(greatest(lo, range * width) AS pos, least(hi, (range + 1) * width) AS stop, gap, piece),
      IF(piece IS NULL, NULL, struct(least(hi, (range + 1) * width) AS pos, CAST(NULL AS LONG) AS stop, CAST(NULL AS {_GAP}) AS gap, CAST(NULL AS {_PIECE}) AS piece))), e -> e IS NOT NULL)) FROM (
        SELECT *, explode(sequence(lo DIV width, (hi - 1) DIV width)) AS range FROM cells)) e
), swept AS (  -- from each event to the next, with the runs that are open there
  SELECT pos, next, last(gap, true) OVER seen AS gap, last(piece, true) OVER seen AS piece FROM (
    SELECT *, coalesce(lead(pos) OVER (PARTITION BY range ORDER BY pos), max(stop) OVER (PARTITION BY range)) AS next FROM events)
  WINDOW seen AS (PARTITION BY range ORDER BY pos RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
), met AS (
  SELECT gap.size AS gap, gap.sequence, gap.k, pos - gap.lo AS x, next - gap.lo AS y, IF(has, piece.size, 0) AS length, IF(has, piece.first + pos - piece.lo, NULL) AS rank FROM (
    SELECT *, coalesce(pos < piece.hi, false) AS has FROM swept WHERE next > pos)
), filled AS (  -- sequences that are filled alike, with k pieces each, and parts of a sequence at either end of a run
  SELECT gap, length, sequence + nth AS sequence, many, m, rank + a - x AS rank, a FROM (
    SELECT *, inline(filter(array(
      named_struct('nth', (x + k - 1) DIV k, 'many', y DIV k - (x + k - 1) DIV k, 'a', (x + k - 1) DIV k * k, 'm', k),
      named_struct('nth', x DIV k, 'many', 1L, 'a', x, 'm', IF(x % k <> 0, least(y, (x + k - 1) DIV k * k) - x, 0L)),
      named_struct('nth', y DIV k, 'many', 1L, 'a', y DIV k * k, 'm', IF(y DIV k >= (x + k - 1) DIV k, y % k, 0L))), f -> f.many > 0 AND f.m > 0)) FROM met)
), joined AS (
  SELECT *, (sum(length * m) OVER mine) - length * m AS before, sum(length * m) OVER (PARTITION BY sequence) AS used, row_number() OVER mine AS i FROM filled AS f
  WINDOW mine AS (PARTITION BY sequence ORDER BY a)
), done AS (
  SELECT kind, size, first, n, sequence, each, at FROM {{runs}} WHERE kind < 2 AND size <= :low
  UNION ALL SELECT 0, size, first + take, n - take, NULL, NULL, NULL FROM settled WHERE n > take
  UNION ALL SELECT inline(array({_run("IF(i = 1, 1, NULL)", "gap - used", "NULL", "many", "sequence", "NULL", "NULL")}, {_run("2", "length", "rank", "many * m", "sequence", "m", ":most - gap + before")})) FROM joined
)
SELECT CAST(kind AS INT), CAST(size AS INT), CAST(first AS LONG), CAST(n AS LONG), CAST(sequence AS LONG), CAST(each AS LONG), CAST(at AS INT) FROM done
WHERE kind = 0 OR kind = 1 AND size >= :least OR kind = 2 AND size > 0
"""

#: One superstep in which no gap holds a piece of the band: the longest open sequences.
OPEN = f"""
WITH band AS (  -- whole sequences of those of which the fewest fill one, else as many pieces as the band's volume needs
  SELECT *, IF(whole > 0, n DIV fill, 0) AS filled FROM (SELECT size, first, n, :most DIV :longest AS fill, IF(:most DIV size = :most DIV :longest, n DIV (:most DIV size), 0) AS whole FROM {{runs}} WHERE kind = 0 AND size > :low)
), opened AS (
  SELECT size, first, n, IF(any, filled, greatest(0, least(n, volume - longer))) AS open, IF(any, fill, 1) AS each FROM (
    SELECT *, max(filled) OVER () > 0 AS any, greatest(1, sum(size * n) OVER () DIV :most) AS volume, sum(n) OVER (ORDER BY size DESC) - n AS longer FROM band)
), numbered AS (
  SELECT *, open * each AS take, :new + sum(open) OVER (ORDER BY size DESC) - open AS sequence FROM opened
), done AS (
  SELECT kind, size, first, n, sequence, each, at FROM {{runs}} WHERE kind = 1 OR kind = 0 AND size <= :low
  UNION ALL SELECT 0, size, first + take, n - take, NULL, NULL, NULL FROM numbered WHERE n > take
  UNION ALL SELECT inline(array({_run("1", ":most - each * size", "NULL", "open", "sequence", "NULL", "NULL")}, {_run("2", "size", "first", "take", "sequence", "each", "0")})) FROM numbered WHERE open > 0
)
SELECT CAST(kind AS INT), CAST(size AS INT), CAST(first AS LONG), CAST(n AS LONG), CAST(sequence AS LONG), CAST(each AS LONG), CAST(at AS INT) FROM done
WHERE kind <> 1 OR size >= :least
"""


Left, Gap, Placed = tuple[int, int, int], tuple[int, int, int], tuple[int, int, int, int, int, int]


def match_range(left: list[Left], gaps: list[Gap], low: int, longest: int, most: int) -> tuple[list[Left], list[Gap], list[Placed]]:
    """``MATCH`` over a single range: what is left (size, first, n), gaps (size, n, sequence), and what has its place now."""
    band, rest = sorted(x for x in left if x[0] > low), [x for x in left if x[0] <= low]
    slots = sorted((size, sequence, n, max(1, size // longest)) for size, n, sequence in gaps if size > low)
    kept_gaps, placed = [g for g in gaps if g[0] <= low], []
    ends = np.cumsum([n * k for _, _, n, k in slots])
    total, sizes = int(ends[-1]), [size for size, *_ in slots]
    # Slots too small for a piece of each length; where more pieces claim the others than there are, the longest get them.
    small = [int(ends[i - 1]) if i else 0 for i in np.searchsorted(sizes, [size for size, *_ in band], side="left").tolist()]
    take, got, claimed, over = {}, 0, 0, 0
    for (size, _, n), without in zip(reversed(band), reversed(small), strict=True):
        claimed += n
        over = min(over, total - without - claimed)
        take[size], got = claimed + over - got, claimed + over
    sent, before, free = [], 0, 0
    for (size, first, n), without in zip(band, small, strict=True):  # shortest first, each to its free successor
        free = max(free, without - before)
        if take[size]:
            sent.append((free + before, free + before + take[size], size, first))
            before += take[size]
        if n > take[size]:
            rest.append((size, first + take[size], n - take[size]))
    at = 0
    for (size, sequence, n, k), end in zip(slots, ends.tolist(), strict=True):  # the sweep
        begin, x, stretches = end - n * k, 0, []
        while at < len(sent) and sent[at][1] <= begin:
            at += 1
        for lo, hi, length, first in sent[at:]:
            if lo >= end:
                break
            a, b = max(lo, begin) - begin, min(hi, end) - begin
            stretches += [(x, a, 0, 0), (a, b, length, first + begin + a - lo)]
            x = b
        new_gaps, new_placed = _filled_run(size, sequence, k, [*stretches, (x, n * k, 0, 0)], most)
        kept_gaps += new_gaps
        placed += new_placed
    return rest, kept_gaps, placed


def _filled_run(size: int, sequence: int, k: int, stretches: list[tuple[int, int, int, int]], most: int) -> tuple[list[Gap], list[Placed]]:
    """A run of gaps with ``k`` slots each after stretches (begin, end, length, first rank) of its slots are filled; length 0 is nothing."""
    gaps, placed, parts = [], [], {}
    for x, y, length, first in stretches:
        at = x
        while at < y:
            nth, inside = divmod(at, k)
            m = min(y - at, k - inside)
            if m == k:  # sequences that are filled alike
                many = (y - at) // k
                gaps.append((size - k * length, many, sequence + nth))
                placed += [(length, first + at - x, many * k, sequence + nth, k, most - size)] if length else []
                at += many * k
            else:
                parts.setdefault(nth, []).append((m, length, first + at - x))
                at += m
    for nth, pieces_ in parts.items():
        used = 0
        for m, length, first in pieces_:
            placed += [(length, first, m, sequence + nth, m, most - size + used)] if length else []
            used += m * length
        gaps.append((size - used, 1, sequence + nth))
    return gaps, placed


def open_range(left: list[Left], low: int, longest: int, new: int, most: int) -> tuple[list[Left], list[Gap], list[Placed]]:
    """``OPEN`` over a single range."""
    band, rest = sorted((x for x in left if x[0] > low), reverse=True), [x for x in left if x[0] <= low]
    fill = most // longest
    opened = [n // fill if most // size == fill else 0 for size, _, n in band]
    each = fill if any(opened) else 1
    if not any(opened):
        room = max(1, sum(size * n for size, _, n in band) // most)
        for i, (_, _, n) in enumerate(band):
            opened[i] = min(n, room)
            room -= opened[i]
    gaps, placed = [], []
    for (size, first, n), some in zip(band, opened, strict=True):
        if some:
            gaps.append((most - each * size, some, new))
            placed.append((size, first, some * each, new, each, 0))
            new += some
        if n > some * each:
            rest.append((size, first + some * each, n - some * each))
    return rest, gaps, placed


def supersteps(lengths: list[tuple[int, int]], most: int) -> list[Placed]:
    """(length, first, n, sequence, each, at) of all runs, from (length, n): the supersteps of a single range."""
    left, gaps, placed, new = [(size, 0, n) for size, n in lengths], [], [], 0
    while left:
        longest, least = max(left)[0], min(left)[0]
        low = band_of(longest, most)
        if max(gaps, default=(0,))[0] >= min(size for size, *_ in left if size > low):
            left, gaps, done = match_range(left, gaps, low, longest, most)
        else:
            left, more, done = open_range(left, low, longest, new, most)
            gaps = gaps + more
        gaps = [g for g in gaps if g[0] >= least]
        new = max([new, *(sequence + -(-n // each) for _, _, n, sequence, each, _ in done)])
        placed += done
    return placed


def placed_runs(counts: DataFrame, max_tokens: int, range_runs: int = RANGE_RUNS) -> DataFrame:
    """(length, first, n, sequence, each, at) of all runs of pieces, from (length, n).

    Piece ``first + i`` goes to sequence ``sequence + i // each``, at place ``at + i % each * length``.
    Lengths and gaps of so few sizes that they are one range go through all
    supersteps in its task; otherwise a superstep is a job over all ranges.
    """
    spark = counts.sparkSession
    if 2 * max_tokens <= range_runs:

        def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            done = supersteps([x for b in batches for x in zip(b.column("length").to_pylist(), b.column("n").to_pylist(), strict=True)], max_tokens)
            columns = zip(*done, strict=True) if done else [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["length", "first", "n", "sequence", "each", "at"])

        types = [pa.int32(), *[pa.int64()] * 4, pa.int32()]
        return in_arrow(counts.select("length", "n").coalesce(1), packed, "length int, first long, n long, sequence long, each long, at int")
    runs = kept(counts.selectExpr("0 AS kind", "length AS size", "0L AS first", "n", "CAST(NULL AS LONG) AS sequence", "CAST(NULL AS LONG) AS each", "CAST(NULL AS INT) AS at"), "runs")
    steps, new = [], 0
    while True:
        # Control only: the lengths that are left, the largest gap, the sequences opened.
        sign = runs.agg(
            F.sort_array(F.collect_set(F.when(F.col("kind") == LEFT, F.col("size")))).alias("left"), F.max(F.when(F.col("kind") == GAP, F.col("size"))).alias("gap"),
            F.max(F.when(F.col("kind") == PLACED, F.col("sequence") + F.ceil(F.col("n") / F.col("each")))).alias("end"), F.count_if(F.col("kind") != PLACED).alias("runs"),
        ).first()
        new = max(new, sign["end"] or 0)
        if not sign["left"]:
            break
        longest, least = sign["left"][-1], sign["left"][0]
        low = band_of(longest, max_tokens)
        fits = (sign["gap"] or 0) >= next(size for size in sign["left"] if size > low)
        here, ranges = runs.filter(F.col("kind") != PLACED), 1 + sign["runs"] // range_runs
        step = spark.sql(
            MATCH if fits else OPEN, {"low": low, "longest": longest, "least": least, "most": max_tokens, **({"ranges": ranges} if fits else {"new": new})},
            runs=here if ranges > 1 else here.coalesce(1),  # few runs need no shuffle
        )
        steps.append(scratch(spark, "superstep"))
        runs = kept(step.coalesce(1), "superstep", steps[-1])
    done = (spark.read.schema(RUNS).parquet(*steps) if steps else runs).filter(F.col("kind") == PLACED)
    return done.select(F.col("size").alias("length"), "first", "n", "sequence", "each", "at")


def pack(docs: DataFrame, tokenizer: str, end_id: int = 2, max_tokens: int = 1024) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of ``docs``."""
    rows = kept(pieces(docs, tokenizer, end_id, max_tokens), "pieces")
    by_part = rows.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before_part = by_part.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    ranked = rows.join(before_part, ["part", "length"]).withColumn("rank", F.col("before") + F.col("local"))
    # A few rows for each length and superstep, whatever the documents: bounded by max_tokens.
    runs = F.broadcast(placed_runs(by_part.groupBy("length").agg(F.sum("n").alias("n")), max_tokens).withColumnRenamed("length", "size"))
    found = ranked.join(runs, (F.col("length") == F.col("size")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("first") + F.col("n")))
    nth = F.col("rank") - F.col("first")
    return found.select(
        "doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32",
        (F.col("sequence") + F.floor(nth / F.col("each"))).alias("sequence_id"), (F.col("at") + nth % F.col("each") * F.col("length")).cast("long").alias("offset"),
    )


def op10_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"), 2, 1024)
