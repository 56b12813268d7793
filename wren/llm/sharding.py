"""Sharding by a minimax contiguous partition (operator 6), DataFrame functions only.

Rows with equal texts form one atomic group.  A group of an equal share or more
fills a shard by itself; there are fewer of them than shards, and they stand
behind all others.  The rest stands in the order of a 64-bit hash of the
text, and the shards left take contiguous runs of it so that the largest is as
small as it can be: the smallest feasible capacity is found by binary search
with a greedy check, the first run is cut where the check cuts it, and the same
is done for what is left, so later shards are no larger than they have to be.

The driver never sees groups but those that fill a shard, only sizes of at most ``2 ** MAX_CELL_BITS``
ranges of the hash.  Where a cut may fall inside a range of several groups,
that range is read again in finer ranges, until the capacity is exact.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import defaultdict, namedtuple
from functools import reduce
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wren.session import ensure_checkpoint_dir

FIRST_BITS, MAX_CELL_BITS = 12, 17


def greedy_cuts(starts: list[int], capacity: int, k: int) -> list[int] | None:
    """Indexes at which runs of at most ``capacity`` end, or None if ``k`` runs don't reach the end.

    ``starts`` are prefix sums of the atomic sizes, from 0 to the total.
    """
    cuts, at, n = [], 0, len(starts) - 1
    for _ in range(k):
        if at == n:
            break
        nxt = bisect_right(starts, starts[at] + capacity) - 1
        if nxt == at:
            return None
        cuts.append(at := nxt)
    return cuts if at == n else None


def smallest_capacity(starts: list[int], k: int) -> int:
    """Binary search for the smallest capacity under which ``k`` contiguous runs hold everything."""
    total = starts[-1]
    low = max([-(-total // k), *(b - a for a, b in zip(starts, starts[1:]))])
    high = max(low, total)
    while low < high:
        mid = (low + high) // 2
        if greedy_cuts(starts, mid, k) is None:
            low = mid + 1
        else:
            high = mid
    return low


def cut_runs(starts: list[int], k: int) -> list[int]:
    """Ends of ``k`` runs: each as the greedy check cuts it under the smallest capacity for what is left.

    No run is empty while there are as many sizes as runs.
    """
    cuts, at, n = [], 0, len(starts) - 1
    for left in range(k, 0, -1):
        rest = [s - starts[at] for s in starts[at:]]
        end = at + greedy_cuts(rest, smallest_capacity(rest, left), left)[0] if at < n else n
        cuts.append(at := max(min(end, n - left + 1), min(at + 1, n)))
    return cuts


#: A range of hashes: its leading bits as a number, how many, the bytes and the groups in it.
Cell = namedtuple("Cell", "prefix bits size n")


def _cells(groups: DataFrame, bits: int, inside: list[Cell] | None = None) -> list[Cell]:
    """The ranges of ``2 ** (64 - bits)`` hashes that have groups, of all hashes or those in the ranges ``inside``."""
    parts = [groups]
    if inside is not None:
        by_bits = defaultdict(list)
        for c in inside:
            by_bits[c.bits].append((c.prefix,))
        # At most 2 ** MAX_CELL_BITS ranges of 8 bytes.
        parts = [groups.join(F.broadcast(groups.sparkSession.createDataFrame(open_, "prefix long")),
                             F.shiftright("h", 64 - b) == F.col("prefix"), "left_semi") for b, open_ in by_bits.items()]
    rows = reduce(DataFrame.unionAll, parts).groupBy(F.shiftright("h", 64 - bits).alias("prefix")).agg(
        F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).collect()
    return [Cell(r["prefix"], bits, r["size"], r["n"]) for r in rows]


def _first_hash(cell: Cell) -> int:
    return cell.prefix << (64 - cell.bits)


def cut_hashes(groups: DataFrame, k: int) -> tuple[list[int], int]:
    """First hashes of shards 1 to ``k - 1`` (fewer if there are fewer groups) and the capacity, from ``(h, size)``."""
    ends = groups.agg(F.sum("size"), F.max("size")).first()
    if ends[0] is None:
        return [], 0
    total, biggest = int(ends[0]), int(ends[1])
    low = max(biggest, -(-total // k))
    bits = FIRST_BITS
    cells = sorted(_cells(groups, bits), key=_first_hash)
    while True:
        starts = [0, *accumulate(c.size for c in cells)]
        high = smallest_capacity(starts, k)
        if high == low and len(cells) >= k:
            break
        # Cut j of any capacity from low to high lies between these offsets.
        wanted, at = [], 0
        for j in range(1, k):
            at = max(at, bisect_right(starts, starts[at] + low) - 1)
            wanted.append((bisect_right(starts, starts[at]) - 1, bisect_left(starts, min(total, j * high))))
        near = {i for a, b in wanted for i in range(a, b)} if len(cells) >= k else range(len(cells))
        open_cells = [i for i in near if cells[i].n > 1]
        if not open_cells:
            break
        bits = min(64, max(cells[i].bits for i in open_cells) + max(1, MAX_CELL_BITS - len(open_cells).bit_length()))
        finer = _cells(groups, bits, [cells[i] for i in open_cells])
        again = set(open_cells)
        cells = sorted([c for i, c in enumerate(cells) if i not in again] + finer, key=_first_hash)
    return [_first_hash(cells[i]) for i in cut_runs(starts, k)[:-1] if i < len(cells)], high


def own_shards(groups: DataFrame, k: int) -> list[int]:
    """Hashes of the groups of at least an equal share of the bytes that larger ones leave; fewer than ``k``."""
    total = groups.agg(F.sum("size")).first()[0] or 0
    out = []
    for r in groups.orderBy(F.desc("size"), "h").limit(k - 1).collect():
        if r["size"] * (k - len(out)) < total:
            break
        out.append(r["h"])
        total -= r["size"]
    return out


def text_groups(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.col(id_col).alias("id"), (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("h"))


def shard_of(h: Column, cuts: list[int], own: list[int], k: int) -> Column:
    """Shards from 0 for the runs, the last ones for groups with a shard of their own."""
    out = F.lit(0)
    for c in cuts:
        out = out + (h >= F.lit(c)).cast("int")
    for j, c in enumerate(own, k - len(own)):
        out = F.when(h == F.lit(c), j).otherwise(out)
    return out


def assign_shards(docs: DataFrame, k: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``id_col, size, text_crc32, shard, slot``.

    Sizes are UTF-8 bytes plus 1; a null text counts as an empty one.  Equal
    texts share a shard; no shard is empty while another holds two groups.  Slots number the rows of a shard from 0 without gaps:
    rows are spread over bins by id and text, numbered in their bin, and moved by
    the count of the bins before, so a large group is numbered by many tasks.
    An empty table stays empty; other columns of ``docs`` play no part.
    """
    spark = docs.sparkSession
    ensure_checkpoint_dir(spark)
    rows = text_groups(docs, id_col, text_col)
    groups = rows.groupBy("h").agg(F.sum("size").alias("size")).checkpoint(eager=True)
    own = own_shards(groups, k)
    cuts, _ = cut_hashes(groups.where(~F.col("h").isin(own)), k - len(own))
    bins = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    placed = rows.withColumn("shard", shard_of(F.col("h"), cuts, own, k)).withColumn(
        "bin", F.pmod(F.xxhash64("id", "h"), F.lit(bins)).cast("int"))
    before = Window.partitionBy("shard").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("shard", "bin").agg(F.count(F.lit(1)).alias("n")).select(
        "shard", "bin", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    in_bin = Window.partitionBy("shard", "bin").orderBy("h", "id", "text_crc32")
    numbered = placed.withColumn("nth", F.row_number().over(in_bin))
    # k times the number of shuffle partitions at most
    return numbered.join(F.broadcast(offsets), ["shard", "bin"]).select(
        F.col("id").alias(id_col), "size", "text_crc32", "shard", (F.col("offset") + F.col("nth") - 1).cast("long").alias("slot"))


def shard_report(docs: DataFrame) -> DataFrame:
    """The shards of a corpus under the law ``bytes``."""
    return assign_shards(docs, 16).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))
