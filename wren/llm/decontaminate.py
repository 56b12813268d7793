"""Benchmark decontamination (operator 1), DataFrame functions only.

The benchmark's normalised word windows become a small hash table that is
broadcast (its row count is checked; beyond the bound Spark joins by shuffle).
Every document is read once: its windows are hashed, probed against the table,
and each hit is verified on the words themselves.  Only hits and one row per
document are shuffled.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z.
Documents are told apart by id and text, so rows that repeat an id with
another text are judged apart and rows that repeat both give one result each.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .frames import broadcast_if_small

#: Letters, digits and everything beyond ASCII, before lower-casing.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: Largest number of benchmark windows that is broadcast (about 100 bytes each).
MAX_BROADCAST_WINDOWS = 500_000
#: A document is contaminated if this share of its words, or more, is hit.
MIN_SHARE = (1, 20)


def lower_ascii(c: Column) -> Column:
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def words_of(text: Column) -> Column:
    """The words of a text in their own case; none for null."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def window_codes(n_words: Column, size: int, step: int) -> Column:
    """One number for each run of ``size`` words: ``step`` times its first position, plus ``size``."""
    last = (n_words - F.lit(size)) * F.lit(step) + F.lit(size)
    return F.when(n_words >= size, F.sequence(F.lit(size), last, F.lit(step))).otherwise(F.array().cast("array<int>"))


def window_text(words: Column, pos: Column, size: Column) -> Column:
    return lower_ascii(F.array_join(F.slice(words, pos + 1, size), " "))


def word_hashes(words: Column) -> Column:
    # lower() folds more than A-Z: the probe lets a little too much through, the check on the words decides.
    return F.transform(words, lambda w: F.xxhash64(F.lower(w)))


def benchmark_windows(benchmark: DataFrame, n: int = 13, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Distinct windows ``(h, len, window, items)``: ``n`` words, or all words of an item that has fewer."""
    items = benchmark.select(F.col(id_col).alias("item_id"), words_of(F.col(text_col)).alias("words"))
    items = items.where(F.size("words") > 0).withColumn("len", F.least(F.lit(n), F.size("words")))
    at = items.select("item_id", "words", "len", F.explode(F.sequence(F.lit(0), F.size("words") - F.col("len"))).alias("pos"))
    windows = at.select(
        "item_id", "len", window_text(F.col("words"), F.col("pos"), F.col("len")).alias("window"),
        F.xxhash64(word_hashes(F.slice("words", F.col("pos") + 1, F.col("len")))).alias("h"))
    return windows.groupBy("h", "len", "window").agg(F.collect_set("item_id").alias("items"))


def contamination(docs: DataFrame, benchmark: DataFrame, n: int = 13, id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """One row per document row: ``id_col, text_hash, n_words, n_hit, n_items, items_sha256, contaminated, spans``.

    ``spans`` are the hit windows as ``struct(pos, len)`` in words.  Null and
    empty texts have no words and are never contaminated; an empty benchmark
    hits nothing; other columns of ``docs`` play no part.  Items without an id
    hit words but aren't counted.
    """
    windows = benchmark_windows(benchmark, n)
    sizes = sorted(r["len"] for r in windows.select("len").distinct().collect())  # n values at most
    table = broadcast_if_small(windows.select("h", "len", "window", "items"), MAX_BROADCAST_WINDOWS)

    read = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("text_hash"),
                       words_of(F.col(text_col)).alias("words"))
    # Positions are exploded as bare numbers; a window is hashed from the document's arrays after that, inside
    # generated code, so no window text exists before the probe.
    step = n + 1
    marked = F.concat(F.array(F.lit(-1)), *[window_codes(F.size("words"), s, step) for s in sizes])
    at = (read.withColumn("hashes", word_hashes(F.col("words")))
          .select("id", "text_hash", "words", "hashes", F.explode(marked).alias("code"))
          .withColumn("pos", F.expr(f"IF(code < 0, -1, code div {step})").cast("int"))
          .withColumn("len", F.expr(f"IF(code < 0, 0, code % {step})").cast("int"))
          .withColumn("h", F.when(F.col("pos") >= 0, F.xxhash64(F.slice("hashes", F.col("pos") + 1, F.col("len"))))))
    probed = at.join(table, ["h", "len"], "left").where(
        (F.col("pos") < 0) | (F.col("window").isNotNull()
                              & (window_text(F.col("words"), F.col("pos"), F.col("len")) == F.col("window"))))
    slim = probed.select(
        "id", "text_hash", F.when(F.col("pos") < 0, F.size("words")).alias("n_words"),
        F.when(F.col("pos") >= 0, F.struct("pos", "len")).alias("span"), "items")
    per_doc = slim.groupBy("id", "text_hash").agg(
        F.max("n_words").cast("long").alias("n_words"), F.count("n_words").alias("n_rows"),
        F.sort_array(F.collect_set("span")).alias("spans"),
        F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"))
    reach = F.aggregate(
        "spans", F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end")),
        lambda a, s: F.struct(
            (a["n"] + F.greatest(F.lit(0), s["pos"] + s["len"] - F.greatest(a["end"], s["pos"]))).alias("n"),
            F.greatest(a["end"], s["pos"] + s["len"]).alias("end")), lambda a: a["n"])
    ids = F.sort_array(F.transform("items", lambda i: i.cast("string")))
    out = per_doc.select(
        F.col("id").alias(id_col), "text_hash", "n_words", reach.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(ids, ",").cast("binary"), 256).alias("items_sha256"),
        "spans", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n_rows"))).alias("copy"))
    num, den = MIN_SHARE
    return out.select(id_col, "text_hash", "n_words", "n_hit", "n_items", "items_sha256",
                      ((F.col("n_hit") > 0) & (den * F.col("n_hit") >= num * F.col("n_words"))).alias("contaminated"), "spans")


def decontaminate(docs: DataFrame, benchmark: DataFrame, remove: str = "documents", n: int = 13,
                  id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without contaminated documents, or (``remove="spans"``) with the hit words cut out of their texts.

    All columns stay as they are.  With ``"spans"`` each word in a hit window
    goes together with the separators before it; a null text stays null.
    """
    judged = contamination(docs, benchmark, n, id_col, text_col)
    key = lambda d: [d[id_col].eqNullSafe(F.col("j.id")), F.xxhash64(d[text_col]) == F.col("j.hash")]
    if remove == "documents":
        bad = judged.where("contaminated").select(F.col(id_col).alias("id"), F.col("text_hash").alias("hash")).distinct()
        return docs.join(bad.alias("j"), key(docs), "left_anti")
    if remove != "spans":
        raise ValueError(f"remove must be 'documents' or 'spans', not {remove!r}")
    hits = judged.where("n_hit > 0").select(F.col(id_col).alias("id"), F.col("text_hash").alias("hash"), "spans").distinct()
    joined = docs.join(hits.alias("j"), key(docs), "left")
    text, spans = docs[text_col], F.col("j.spans")
    pieces = F.regexp_extract_all(text, F.lit(rf"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*{WORD}"), F.lit(0))
    kept = F.filter(pieces, lambda _, i: ~F.exists(spans, lambda s: (s["pos"] <= i) & (i < s["pos"] + s["len"])))
    tail = F.regexp_extract(text, r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*$", 0)
    cut = F.when(spans.isNull(), text).otherwise(F.concat(F.array_join(kept, ""), tail))
    return joined.select(*[cut.alias(c) if c == text_col else docs[c] for c in docs.columns])


#: The contract's columns in DuckDB SQL.
DIGEST_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(13, len(ws)) AS n, array_to_string(ws[i:i + least(13, len(ws)) - 1], ' ') AS win
       FROM (SELECT *, unnest(range(1, len(ws) - least(13, len(ws)) + 2)) AS i FROM b WHERE len(ws) > 0)),
dw AS (SELECT doc_id, i, n, array_to_string(ws[i:i + n - 1], ' ') AS win
       FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i
             FROM d, (SELECT DISTINCT n FROM bw) WHERE len(ws) >= n)),
hit AS (SELECT doc_id, i, dw.n, item_id FROM dw JOIN bw USING (n, win)),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY 1),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids
       FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS s FROM hit) GROUP BY 1)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN it USING (doc_id)
"""


def contamination_digests(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    return contamination(docs, benchmark).select(
        "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
