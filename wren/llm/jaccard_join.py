"""N-gram Jaccard join by universe partition and pigeonhole (operator 3).

A document is the set of its distinct word shingles, as 64-bit hashes.  Two
sets of sizes r <= s whose similarity reaches the threshold differ in at most H
shingles, so of H + 1 segments of the universe at least one holds the same
shingles in both.  Sets are signed per size band: one number for the content of
each segment.  Costs decide the allocation:

* a segment that is empty, or has nothing but shingles that a sample of the
  corpus shows to be frequent, has a long list; it is left out (0 signatures);
* every other segment is indexed as it is (1 signature);
* a band has s segments more than the H + 1, as many as a set of its sizes will
  hardly leave out; if a set leaves out q > s, its first 2 q - s segments are
  indexed with all their one-deletion neighbours as well.

This loses no pair.  Two similar sets agree in s + 1 segments or more.  If one of
these is indexed, they meet there.  If not, the x > s segments in which they agree
are left out in both, since leaving out depends on content alone; the others
differ, by at most H in all, so at most x - 1 - s of them by more than one, and of
the first 2 x - s segments one differs by exactly one shingle: the neighbours
meet there.

Sets that meet are joined to families, and each family is verified exactly, in
blocks: a task gets two blocks of a family, keeps the sets that share a rare
enough shingle (prefix filter), counts intersections by matrix products, and
returns one link per set towards the least set it reaches - never the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, exp, sqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wren.session import shuffles_dropped

from .frames import fresh, map_text
from .graph import components

#: Ratio of the ends of a size band.
BAND = 1.25
#: Documents of the sample that shows frequent shingles, the share of them that makes one frequent, and the most kept.
SAMPLE_DOCS, FREQUENT_SHARE, MAX_FREQUENT = 4000, 0.002, 50_000
#: Shingles in a block of a family; a task holds two blocks.
BLOCK_SHINGLES = 1_000_000
#: Documents whose signatures are reduced together before they are shuffled.
CHUNK_DOCS = 2048
#: Words whose hash a task remembers.
WORD_TABLE = 400_000

U = np.uint64


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
        return h ^ (h >> U(31))


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(self) >= WORD_TABLE:
            self.clear()
        self[word] = h
        return h


def shingle_sets(texts: list, size: int, table: WordHashes) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    words = [(t or "").encode("utf-8").lower().split() for t in texts]  # bytes: ASCII letters and the six ASCII spaces
    flat = [w for ws in words for w in ws]
    h = np.fromiter(map(table.__getitem__, flat), dtype=np.uint64, count=len(flat))
    out, at = [], 0
    with np.errstate(over="ignore"):
        for ws in words:
            own = h[at:at + len(ws)]
            at += len(ws)
            k = min(size, len(ws))
            acc = np.full(max(0, len(ws) - k + 1) if k else 0, U(k + 1))
            for j in range(k):
                acc = mix(acc * U(0x9E3779B97F4A7C15) + own[j:j + len(acc)])
            out.append(np.unique(acc))
    return out


class Bands:
    """Size bands and their segments for similarity ``num / den``: sets of sizes r <= s link if den * common >= num * union."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        self.low = [1]
        self.known: dict[int, list[tuple[int, int, int]]] = {}

    def most(self, r: int) -> int:
        """The largest set that can link with one of ``r``."""
        return r * self.den // self.num

    def difference(self, total: int) -> int:
        """The largest difference of two linked sets whose sizes add up to ``total``."""
        return total - 2 * -(-self.num * total // (self.num + self.den))

    def band(self, n: int) -> int:
        while self.low[-1] <= n:
            self.low.append(max(self.low[-1] + 1, ceil(self.low[-1] * BAND)))
        lo, hi = 0, len(self.low) - 1
        while lo < hi - 1:
            mid = (lo + hi) // 2
            lo, hi = (mid, hi) if self.low[mid] <= n else (lo, mid)
        return lo

    def spare(self, band: int, least: int) -> int:
        """Segments beyond ``least`` for those that a set of the band's least size leaves empty: the mean and three deviations."""
        n, spare = self.low[band], 0
        for _ in range(2):
            m = least + spare
            empty = m * exp(-n / m)
            spare = ceil(empty + 3 * sqrt(empty))
        return spare

    def of(self, n: int) -> list[tuple[int, int, int]]:
        """``(band, segments, spare ones)`` in which a set of ``n`` shingles is signed: its own band and a lower one it can link into."""
        if n in self.known:
            return self.known[n]
        own, out = self.band(n), []
        for b in range(own, -1, -1):
            top = self.low[b + 1] - 1
            if b < own and self.most(top) < n:
                break
            t = top + self.most(top)
            apart = max(self.difference(x) for x in range(max(2, t - self.num - self.den), t + 1))
            if apart > 0:
                spare = self.spare(b, apart + 1)
                out.append((b, apart + 1 + spare, spare))
        self.known[n] = out
        return out


def segment_sums(seg: np.ndarray, h: np.ndarray, m: int) -> np.ndarray:
    """Sum of the hashes of each segment, modulo 2 ** 64 (exact: halves of 32 bits)."""
    low = np.bincount(seg, weights=(h & U(0xFFFFFFFF)).astype(np.float64), minlength=m).astype(np.uint64)
    high = np.bincount(seg, weights=(h >> U(32)).astype(np.float64), minlength=m).astype(np.uint64)
    with np.errstate(over="ignore"):
        return (high << U(32)) + low


def signatures(s: np.ndarray, bands: Bands, frequent: np.ndarray) -> np.ndarray:
    """The signatures of one set; ``frequent`` are sorted hashes of frequent shingles."""
    out = []
    with np.errstate(over="ignore"):
        rare = np.ones(len(s), dtype=bool)
        if len(frequent):
            at = np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)
            rare = frequent[at] != s
        inner = mix(s ^ U(0x5851F42D4C957F2D))
        for band, m, spare in bands.of(len(s)):
            seg = (mix(s + U(band * 2 + 1)) % U(m)).astype(np.int64)
            sums = segment_sums(seg, inner, m)
            places = mix(np.arange(m, dtype=np.uint64) + U(band << 32))
            kept = np.bincount(seg[rare], minlength=m) > 0
            out.append(mix(sums[kept] ^ places[kept]))
            left_out = int(m - kept.sum())
            if left_out > spare:
                first = min(m, 2 * left_out - spare)
                # the left-out ones among them are indexed too, as neighbours may shrink to them
                out.append(mix(sums[:first] ^ places[:first]))
                near = seg < first
                out.append(mix((sums[seg[near]] - inner[near]) ^ places[seg[near]]))
    return np.unique(np.concatenate(out)) if out else np.empty(0, np.uint64)


def set_number(s: np.ndarray) -> np.uint64:
    """A 64-bit name of a set."""
    with np.errstate(over="ignore"):
        return mix(np.array([np.add.reduce(mix(s ^ U(0xD6E8FEB86659FD93))) + U(len(s))], dtype=np.uint64))[0]


#: tag of a row: the set size of a document, or one of these
SIGNATURE, MEETING = -1, -2
ROWS = "key long, node long, other long, tag long"
ARROW_ROWS = pa.schema([("key", pa.int64()), ("node", pa.int64()), ("other", pa.int64()), ("tag", pa.int64())])


def _rows(key, node, other, tag) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([
        pa.array(np.asarray(key, dtype=np.uint64).view(np.int64)), pa.array(np.asarray(node, dtype=np.uint64).view(np.int64)),
        other if isinstance(other, pa.Array) else pa.array(other, type=pa.int64()),
        tag if isinstance(tag, pa.Array) else pa.array(np.asarray(tag, dtype=np.int64))], schema=ARROW_ROWS)


def _meet(sig: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of rows sorted by signature and node: index of each run's first row, and the distinct (node, first node of its run)."""
    new = np.r_[True, sig[1:] != sig[:-1]]
    first = np.flatnonzero(new)
    pivot = node[first][np.cumsum(new) - 1]
    apart = node != pivot
    pairs = np.unique(np.stack([node[apart], pivot[apart]], axis=1), axis=0)
    return first, pairs[:, 0], pairs[:, 1]


def sign_documents(docs: DataFrame, size: int, num: int, den: int, frequent: np.ndarray) -> DataFrame:
    """Rows of documents (``other`` = id, ``tag`` = set size), signatures and local meetings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, bands = WordHashes(), Bands(num, den)
        sigs: list[np.ndarray] = []
        nodes: list[np.ndarray] = []

        def flush() -> Iterator[pa.RecordBatch]:
            if not sigs:
                return
            sig, node = np.concatenate(sigs), np.concatenate(nodes)
            sigs.clear()
            nodes.clear()
            if not len(sig):
                return
            order = np.lexsort((node, sig))
            sig, node = sig[order], node[order]
            first, u, v = _meet(sig, node)
            yield _rows(sig[first], node[first], pa.nulls(len(first), pa.int64()), np.full(len(first), SIGNATURE))
            if len(u):
                yield _rows(u, u, v.view(np.int64), np.full(len(u), MEETING))

        held = 0
        for big in batches:
            for at in range(0, big.num_rows, 256):
                b = big.slice(at, 256)
                sets = shingle_sets(b.column(1).to_pylist(), size, table)
                names = np.array([set_number(s) for s in sets], dtype=np.uint64)
                yield _rows(mix(names + np.arange(len(names), dtype=np.uint64)), names, b.column(0),
                            [len(s) for s in sets])
                done = set()
                for s, name in zip(sets, names):
                    if name not in done and len(s):
                        done.add(name)
                        own = signatures(s, bands, frequent)
                        sigs.append(own)
                        nodes.append(np.full(len(own), name))
                held += len(sets)
                if held >= CHUNK_DOCS:
                    yield from flush()
                    held = 0
        yield from flush()

    return docs.mapInArrow(run, ROWS)


def scan_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key: signatures become meetings with the first node of their run, other rows pass."""
    last_key, last_node = None, None
    for b in batches:
        tag = b.column(3).to_numpy()
        plain = tag != SIGNATURE
        if plain.any():
            yield b.filter(pa.array(plain))
        key = b.column(0).to_numpy()[~plain]
        node = b.column(1).to_numpy()[~plain]
        if not len(key):
            continue
        new = np.r_[key[0] != last_key, key[1:] != key[:-1]]
        start = np.where(new, np.arange(len(key)), 0)
        pivot = node[np.maximum.accumulate(start)]
        if not new[0]:
            upto = np.flatnonzero(new)[0] if new.any() else len(key)
            pivot[:upto] = last_node
        last_key, last_node = key[-1], pivot[-1]
        apart = node != pivot
        if apart.any():
            pairs = np.unique(np.stack([node[apart], pivot[apart]], axis=1), axis=0)
            u, v = np.ascontiguousarray(pairs[:, 0]), np.ascontiguousarray(pairs[:, 1])
            yield _rows(u.view(np.uint64), u.view(np.uint64), v, np.full(len(u), MEETING))


def linked(sets: list[np.ndarray], num: int, den: int) -> np.ndarray:
    """For each set the index of the least set it reaches over links among ``sets``; exact."""
    n = len(sets)
    label = np.arange(n)
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(n), sizes)
    values, code, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    # Prefix filter: linked sets share one of the rarest size - ceil(threshold * size) + 1 shingles of either.
    order = np.lexsort((code, counts[code], owner))
    rank = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    prefix = sizes - -(-num * sizes // den) + 1
    o_owner, o_code = owner[order], code[order]
    front = (rank < prefix[o_owner]) & (counts[o_code] > 1)
    p_owner, p_code = o_owner[front], o_code[front]
    if not len(p_owner):
        return label
    # Sets that share such shingles, directly or through others: work on these groups only.
    group = np.arange(n)
    while True:
        least = np.full(len(values), n)
        np.minimum.at(least, p_code, group[p_owner])
        new = group.copy()
        np.minimum.at(new, p_owner, least[p_code])
        new = new[new]
        if (new == group).all():
            break
        group = new
    by_group = np.argsort(group, kind="stable")
    bounds = np.flatnonzero(np.r_[True, group[by_group][1:] != group[by_group][:-1], True])
    starts = np.r_[0, np.cumsum(sizes)]
    for a, z in zip(bounds[:-1], bounds[1:]):
        members = by_group[a:z]
        if len(members) > 1:
            _link_group(members, starts, code, sizes, label, num, den)
    return label


def _link_group(members, starts, code, sizes, label, num, den) -> None:
    """Labels of one group by intersection counts: products of 0/1 matrices, in tiles of rows and columns."""
    k = len(members)
    flat = np.concatenate([code[starts[i]:starts[i + 1]] for i in members])
    row = np.repeat(np.arange(k), sizes[members])
    _, col, freq = np.unique(flat, return_inverse=True, return_counts=True)
    shared = freq[col] > 1
    row, col = row[shared], col[shared]
    _, col = np.unique(col, return_inverse=True)
    width = int(col.max()) + 1 if len(col) else 0
    size = sizes[members]
    tile_cols = max(256, min(width, 8_000_000 // k))
    by_col = np.argsort(col, kind="stable")
    row, col = row[by_col], col[by_col]
    edges = np.searchsorted(col, np.arange(0, width + tile_cols, tile_cols))
    tile_rows = max(1, min(k, 4_000_000 // k))
    for r in range(0, k, tile_rows):
        e = min(k, r + tile_rows)
        common = np.zeros((e - r, k), dtype=np.float32)
        for c, (a, z) in enumerate(zip(edges[:-1], edges[1:])):
            x = np.zeros((k, min(tile_cols, width - c * tile_cols)), dtype=np.float32)
            x[row[a:z], col[a:z] - c * tile_cols] = 1
            common += x[r:e] @ x.T
        common = common.astype(np.int64)
        link = den * common >= num * (size[r:e, None] + size[None, :] - common)
        link[np.arange(e - r), np.arange(r, e)] = True  # own shingles that no other set has aren't in ``common``
        for i in range(e - r):
            near = np.unique(label[members[link[i]]])
            if len(near) > 1:
                own = label[members]
                own[np.isin(own, near)] = near[0]
                label[members] = own


def verify_families(sets: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """Links ``(u, v)`` from ``(family, node, text, blocks, block)``; one per set and pair of blocks at most."""
    at = sets.withColumn("to", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    paired = at.select("family", "node", "text", F.least("block", "to").alias("x"), F.greatest("block", "to").alias("y"))

    def run(key, rows):
        table = WordHashes()
        found = shingle_sets(rows.column("text").to_pylist(), size, table)
        # Rows that repeat an id may carry another text than the one meant, or the same one again.
        own = np.array([set_number(s) for s in found], dtype=np.uint64).view(np.int64)
        mine = np.flatnonzero(own == rows.column("node").to_numpy())
        names, at = np.unique(own[mine], return_index=True)
        label = linked([found[i] for i in mine[at]], num, den) if len(names) else np.arange(0)
        moved = np.flatnonzero(label != np.arange(len(label)))
        return pa.table({"u": names[moved], "v": names[label[moved]]}, schema=pa.schema([("u", pa.int64()), ("v", pa.int64())]))

    return paired.groupBy("family", "x", "y").applyInArrow(run, "u long, v long")


def frequent_shingles(docs: DataFrame, size: int) -> np.ndarray:
    """Hashes of shingles that many documents of a bounded sample have; they steer costs, never results."""
    ids = docs.select("id").where("id IS NOT NULL").orderBy(F.xxhash64("id"), "id").limit(SAMPLE_DOCS)
    sample = docs.join(F.broadcast(ids.distinct()), "id", "left_semi")  # SAMPLE_DOCS rows at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = WordHashes()
        for b in batches:
            for s in shingle_sets(b.column(1).to_pylist(), size, table):
                yield pa.RecordBatch.from_arrays([pa.array(s.view(np.int64))], names=["h"])

    counts = sample.mapInArrow(run, "h long").groupBy("h").count()
    enough = counts.where(F.col("count") >= max(3, int(SAMPLE_DOCS * FREQUENT_SHARE)))
    top = enough.orderBy(F.desc("count"), "h").limit(MAX_FREQUENT).collect()
    return np.sort(np.array([r["h"] for r in top], dtype=np.int64).view(np.uint64))


def with_nodes(rows: DataFrame, text_col: str, size: int, name: str) -> DataFrame:
    """``rows`` plus the name of each text's shingle set in column ``name``, null where the set is empty."""

    def run(texts: list) -> list[dict]:
        return [{name: int(set_number(s).view(np.int64)) if len(s) else None} for s in shingle_sets(texts, size, WordHashes())]

    return map_text(rows, text_col, run, T.StructType([T.StructField(name, T.LongType())]))


def grouped_sets(read: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """``(id, n, node, root, component_id)`` for each row of ``(id, text)``: set size, set, the set that names its group and
    the group's least id; an empty set has no node and no root, and its own id."""
    frequent = frequent_shingles(read, size)
    signed = sign_documents(read, size, num, den, frequent)
    rows = signed.repartition("key").sortWithinPartitions("key", "node").mapInArrow(scan_runs, ROWS)
    with shuffles_dropped(read.sparkSession):
        rows = rows.checkpoint(eager=True)  # documents and meetings; signatures are gone
    found = rows.where(F.col("tag") >= 0).select(F.col("other").alias("id"), F.col("tag").alias("n"), "node")
    meetings = rows.where(F.col("tag") == MEETING).select(F.col("node").alias("u"), F.col("other").alias("v")).distinct()
    families = components(meetings)

    sets = found.where("n > 0").groupBy("node").agg(F.min("id").alias("id"), F.max("n").alias("n"))
    members = families.join(sets, "node").select(F.col("root").alias("family"), "node", "id", "n")
    weight = members.groupBy("family").agg(F.ceil(F.sum("n") / BLOCK_SHINGLES).cast("int").alias("blocks"))
    members = members.join(weight, "family").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    texts = read.where("id IS NOT NULL").join(members.where("id IS NOT NULL").drop("n"), "id")
    # a set that only rows without id have is found by its name
    nameless = with_nodes(read.where("id IS NULL").drop("id"), "text", size, "node").join(members.where("id IS NULL").drop("n"), "node")
    links = verify_families(texts.unionByName(nameless.select(texts.columns)), size, num, den)

    roots = components(links)
    named = sets.join(roots, "node", "left").select("node", "id", F.coalesce("root", "node").alias("root"))
    least = named.groupBy("root").agg(F.min("id").alias("component_id"))
    names = named.join(least, "root").select("node", "root", "component_id")
    none = F.lit(None).cast("long")
    plain = found.where("n = 0").select("id", "n", none.alias("node"), none.alias("root"), F.col("id").alias("component_id"))
    return found.where("n > 0").join(names, "node").select("id", "n", "node", "root", "component_id").unionByName(plain)


def similarity_groups(docs: DataFrame, size: int = 3, num: int = 90, den: int = 100, id_col: str = "doc_id",
                      text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``id_col, n_shingles, component_id``.

    Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z; a text with fewer
    than ``size`` words is one shingle.  Sets link if ``den * common >= num *
    union``.  ``component_id`` is the least id reachable over links.  Null, empty
    and wordless texts have empty sets that link with nothing; copies link;
    null ids take part but never name a component that has another id.  Other
    columns of ``docs`` play no part.
    """
    read = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return grouped_sets(read, size, num, den).select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")


def one_of_each_group(docs: DataFrame, size: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id",
                      text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each similarity group: the one of the least id (of those that repeat it, the least set).

    A row is told apart by id and set: where an id repeats with different texts, each text goes by its own group, and
    of rows that repeat both one stays.  Documents without words link with nothing and all stay, as do rows without id.
    """
    read = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id IS NOT NULL")
    with shuffles_dropped(docs.sparkSession):
        rows = grouped_sets(read, size, num, den).checkpoint(eager=True)  # numbers only
    chosen = rows.where("root IS NOT NULL").groupBy("root").agg(F.min(F.struct("id", "node")).alias("k")).select("k.id", "k.node")
    twice = rows.groupBy("id").count().where("count > 1").select("id")
    gone = rows.where("root IS NOT NULL").join(chosen, ["id", "node"], "left_anti").select("id").unionByName(twice).distinct()
    once = docs.join(gone, docs[id_col] == gone["id"], "left_anti")
    # only rows of ids that repeat are looked at text by text
    node = fresh("node", docs.columns)
    keys = chosen.select(F.col("id").alias(fresh("of", [*docs.columns, node])), F.col("node").alias(fresh("set", [*docs.columns, node])))
    again = with_nodes(docs.join(twice, docs[id_col] == twice["id"], "left_semi"), text_col, size, node)
    texts = again.join(keys, (again[id_col] == keys[0]) & (again[node] == keys[1]), "left_semi").dropDuplicates([id_col, node])
    wordless = again.where(F.col(node).isNull())
    return once.unionByName(texts.select(docs.columns)).unionByName(wordless.select(docs.columns))
