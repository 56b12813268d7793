"""Alignment of two tokenizers over the same bytes (operator 12).

Both tokenizers cut the bytes of a space and the text.  For each list of ids a
dictionary maps every byte offset at which a token ends to the place behind that
token; the offsets that both dictionaries hold, sorted, cut the two id lists
into groups that cover equal bytes.  Inside a group only its last two tokens end
together, so a group expands to one link between them.

How often an id pair is linked is counted over the corpus.  Where two tokens end
together, the shorter is a suffix of the longer, so the pairs that can occur at
all are bounded by the suffixes of the two vocabularies (``pair_bound``), and
the table of counts is small whatever the corpus: tasks add up counts of
distinct pairs, Spark sums them, and the table is broadcast to the pass that
reads the counts back for every document.  The aligned documents are stored once
in the checkpoint folder between the two passes, so no text is encoded twice and
a lost executor costs a task of one pass.
"""

from __future__ import annotations

import hashlib
import uuid
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wren.session import scratch_path

from . import byte_level
from .frames import SLICE_ROWS, map_text

#: An id pair as one number: id of A times ``PAIR`` plus id of B.
PAIR = 1 << 32


def read_pieces(path: str) -> dict:
    """What a task needs for a sentencepiece file: the model and the bytes of each id."""
    import sentencepiece

    with open(path, "rb") as f:
        model = f.read()
    sp = sentencepiece.SentencePieceProcessor(model_proto=model)
    table = []
    for i in range(sp.get_piece_size()):
        piece = sp.id_to_piece(i)
        table.append(bytes([int(piece[3:5], 16)]) if sp.is_byte(i) else piece.replace("▁", " ").encode())
    return {"model": model, "bytes": table, "live": {}}


def _pieces(spec: dict) -> dict:
    live = spec["live"]
    if not live:
        import sentencepiece

        live.update(sp=sentencepiece.SentencePieceProcessor(model_proto=spec["model"]),
                    lengths=np.array([len(t) for t in spec["bytes"]], dtype=np.int64))
    return live


def pair_bound(a: list[bytes], b: list[bytes]) -> int:
    """How many id pairs there are of which one's bytes are a suffix of the other's."""
    of_a, of_b = defaultdict(int), defaultdict(int)
    for t in a:
        of_a[t] += 1
    for t in b:
        of_b[t] += 1
    longer_a = sum(of_b.get(t[k:], 0) for t in a for k in range(len(t)))
    return longer_a + sum(of_a.get(t[k:], 0) for t in b for k in range(1, len(t)))


def common_cuts(a_ends: list[int], b_ends: list[int]) -> tuple[list[int], list[int]]:
    """Places behind the last token of each group, in the first and in the second list."""
    at_a, at_b = dict(zip(a_ends, range(1, len(a_ends) + 1))), dict(zip(b_ends, range(1, len(b_ends) + 1)))
    both = sorted(at_a.keys() & at_b.keys())
    return list(map(at_a.__getitem__, both)), list(map(at_b.__getitem__, both))


def align_texts(a_spec: dict, b_spec: dict, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray, list[int], list[int]]]:
    """Ids of A, ids of B and the places that end the groups, for every text; nothing where the bytes differ."""
    none = (np.zeros(0, "<u4"), np.zeros(0, "<u4"), [], [])
    given = [t for t in texts if t]
    a_live, b_live = byte_level._live(a_spec), _pieces(b_spec)
    b_coded = iter(b_live["sp"].encode(given, num_threads=1) if given else [])
    a_coded = iter(byte_level.encode_texts(a_spec, [" " + t for t in given]))
    out = []
    for text in texts:
        if not text:
            out.append(none)
            continue
        a, b_list = next(a_coded), next(b_coded)
        b = np.array(b_list, dtype="<u4")
        whole = (" " + text).encode()
        a_ends, b_ends = np.cumsum(a_live["lengths"][a]), np.cumsum(b_live["lengths"][b])
        # A byte-level token spells the bytes it stands for, so A can only leave bytes out; B may change characters.
        if len(a) == 0 or a_ends[-1] != len(whole) or b"".join(map(b_spec["bytes"].__getitem__, b_list)) != whole:
            out.append(none)
            continue
        cuts = common_cuts(a_ends.tolist(), b_ends.tolist())
        out.append((a, b, *cuts))
    return out


def group_names(a_size: int, b_size: int) -> np.ndarray:
    """Every id with the mark behind it: ``,`` inside a list, ``|`` and ``;`` behind the last of A's and of B's.

    Of fixed width, filled up with zero bytes.
    """
    return np.array([f"{i}{m}".encode() for size, marks in ((a_size, ",|"), (b_size, ",;")) for i in range(size) for m in marks])


def spell_groups(names: np.ndarray, a_size: int, a: np.ndarray, b: np.ndarray, a_cuts: np.ndarray, b_cuts: np.ndarray) -> bytes:
    """``a1,a2|b1;a3|b2,b3``: the ids of each group, from ``group_names`` in their order."""
    if not len(a_cuts):
        return b""
    a_len, b_len = np.diff(a_cuts, prepend=0), np.diff(b_cuts, prepend=0)
    seq = np.empty(len(a) + len(b), dtype=np.int64)
    a_at = np.arange(len(a)) + np.repeat(b_cuts - b_len, a_len)  # behind the B ids of the groups before
    b_at = np.arange(len(b)) + np.repeat(a_cuts, b_len)  # behind the A ids up to the own group
    seq[a_at], seq[b_at] = a.astype(np.int64) * 2, (b.astype(np.int64) + a_size) * 2
    seq[a_at[a_cuts - 1]] += 1
    seq[b_at[b_cuts - 1]] += 1
    return names[seq].tobytes().translate(None, b"\0")[:-1]


def align(docs: DataFrame, a_spec: dict, b_spec: dict, text_col: str = "text") -> DataFrame:
    """Add ``a_ids, b_ids`` and ``a_cuts, b_cuts``: the ids of every whole text and where each group ends in them.

    Group ``g`` holds the ids from cut ``g - 1`` (0 for the first) to cut ``g`` of
    each list; its link is between the last id on each side.  Texts that are
    null or empty, or whose bytes either tokenizer changes, have empty arrays.
    Other columns stay, clashing ones give way; an empty table stays empty.
    """
    a_shared, b_shared = byte_level.share(docs, a_spec), byte_level.share(docs, b_spec)
    names = ["a_ids", "b_ids", "a_cuts", "b_cuts"]

    def run(texts: list) -> list[dict]:
        return [dict(zip(names, (a.tolist(), b.tolist(), i, k)))
                for a, b, i, k in align_texts(a_shared.value, b_shared.value, texts)]

    return map_text(docs, text_col, run, T.StructType([T.StructField(c, T.ArrayType(T.LongType())) for c in names]))


def _linked(docs: DataFrame, a_spec: dict, b_spec: dict) -> DataFrame:
    """Per document the counts and digest of its groups, its distinct id pairs (sorted) and how often each is linked."""
    a_shared, b_shared = byte_level.share(docs, a_spec), byte_level.share(docs, b_spec)

    def run(texts: list) -> list[dict]:
        a_spec, b_spec = a_shared.value, b_shared.value
        a_size, live, out = len(a_spec["bytes"]), _pieces(b_spec), []
        if "group_names" not in live:
            live["group_names"] = group_names(a_size, len(b_spec["bytes"]))
        for a, b, a_cuts, b_cuts in align_texts(a_spec, b_spec, texts):
            a_cuts, b_cuts = np.array(a_cuts, dtype=np.int64), np.array(b_cuts, dtype=np.int64)
            groups = spell_groups(live["group_names"], a_size, a, b, a_cuts, b_cuts)
            links = a[a_cuts - 1].astype(np.int64) * PAIR + b[b_cuts - 1]
            pairs, times = np.unique(links, return_counts=True)
            out.append({"n_a": len(a), "n_b": len(b), "n_groups": len(a_cuts), "n_links": len(links),
                        "pairs": pairs.astype("<i8").tobytes(), "times": times.astype("<i4").tobytes(),
                        "groups_sha256": hashlib.sha256(groups).hexdigest() if len(a) else ""})
        return out

    added = T.StructType([
        *(T.StructField(c, T.LongType()) for c in ("n_a", "n_b", "n_groups", "n_links")),
        T.StructField("pairs", T.BinaryType()), T.StructField("times", T.BinaryType()), T.StructField("groups_sha256", T.StringType())])
    return map_text(docs.select("doc_id", "text"), "text", run, added).drop("text")


def _add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per distinct pair of a task and how often it is linked there; memory is bounded by the pairs that exist."""
    keys, sums = np.zeros(0, "<i8"), np.zeros(0, "<i8")
    for big in batches:
        for at in range(0, big.num_rows, SLICE_ROWS):
            part = big.slice(at, SLICE_ROWS)
            held = np.concatenate([keys, *(np.frombuffer(p, "<i8") for p in part.column(0).to_pylist())])
            times = np.concatenate([sums, *(np.frombuffer(p, "<i4") for p in part.column(1).to_pylist())])
            keys, where = np.unique(held, return_inverse=True)
            sums = np.bincount(where, weights=times, minlength=len(keys)).astype("<i8")
    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(sums, pa.int64())], names=["pair", "n"])


def pair_counts(linked: DataFrame) -> DataFrame:
    """``pair, n, best``: corpus-wide count of every linked id pair and whether none of its B id has a higher one."""
    counts = linked.select("pairs", "times").mapInArrow(_add_up, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    # A B id has at most as many pairs as there are A ids that end like it: bounded by the vocabulary.
    same_b = Window.partitionBy(F.pmod("pair", F.lit(PAIR)))
    return counts.select("pair", "n", (F.col("n") == F.max("n").over(same_b)).alias("best"))


def alignment_report(docs: DataFrame, a_spec: dict, b_spec: dict) -> DataFrame:
    """One row per document: ``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``.

    ``count_sum`` adds the corpus-wide counts of the id pairs over the links of a
    document; ``n_best`` counts the links whose pair is the most frequent of its B
    id, ties included.  Documents without tokens have zeros and an empty digest;
    repeated rows count each; an empty table stays empty; other columns play no part.
    """
    spark = docs.sparkSession
    path = scratch_path(spark, f"alignment-{uuid.uuid4().hex}")
    _linked(docs, a_spec, b_spec).write.option("compression", "zstd").parquet(path)
    linked = spark.read.parquet(path)
    # At most pair_bound(A, B) rows of 17 bytes, whatever the corpus.
    table: pd.DataFrame = pair_counts(linked).toPandas().sort_values("pair")
    shared = spark.sparkContext.broadcast(
        (table["pair"].to_numpy("<i8"), table["n"].to_numpy("<i8"), table["best"].to_numpy(dtype=bool)))

    def run(rows: list) -> list[dict]:
        keys, counts, best = shared.value
        out = []
        for r in rows:
            at = np.searchsorted(keys, np.frombuffer(r["pairs"], "<i8"))
            times = np.frombuffer(r["times"], "<i4").astype(np.int64)
            out.append({"n_best": int(times[best[at]].sum()), "count_sum": int((counts[at] * times).sum())})
        return out

    packed = linked.select("*", F.struct("pairs", "times").alias("packed")).drop("pairs", "times")
    added = T.StructType([T.StructField("n_best", T.LongType()), T.StructField("count_sum", T.LongType())])
    return map_text(packed, "packed", run, added).select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
