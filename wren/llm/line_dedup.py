"""Line deduplication by content-defined chunks (operator 5), DataFrame functions only.

A rolling hash over the digests of neighbouring lines chooses chunk boundaries:
of two neighbouring places the one with the smaller hash, so an insertion shifts
none behind it.  A line of ``LONG_LINE`` words or more is a chunk by itself.
Chunks that occur again anywhere in the corpus are candidates, all but the first
occurrence (least id, then position).  A chunk at the edge of a repeated passage
takes in foreign neighbours, so candidates are extended by up to ``FLANK`` lines
on both sides, as long as the step from line to line (the rolling hash) has
occurred before.  A run of more than ``MIN_WORDS`` words is removed after its
chunks and steps were compared byte by byte with their first occurrence.

No passage is missed.  Take lines 1 to n that occur at an earlier place too, with
more than ``MIN_WORDS`` words.  Hashes agree from line 2 on.  If n is 5 or more,
one of the places behind lines 2 and 3 is a boundary at both places of the
passage, and so is the next one, as all places between depend on lines of the
passage alone; so a whole chunk begins at line 4 or before, all chunks after it
are shared up to line n - 1 or n, and the steps reach the rest.  If n is 4 or
less, one line is a chunk by itself and within three lines of all others.

Only numbers are shuffled to count chunks.  Whole texts move by document: for the
first occurrences to be cut out, and to be compared with them and rewritten.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wren.session import ensure_checkpoint_dir, scratch_path

#: Words from which a line is a chunk by itself, and lines by which candidates are extended; the argument above needs
#: LONG_LINE <= MIN_WORDS // 4 and three lines.
LONG_LINE, FLANK = 12, 3
#: A run of repeated lines must have more words than this to be removed.
MIN_WORDS = 50
#: A key of at least this part of all rows is hot; there are at most so many of them, so they are broadcast.
HOT_KEYS = 1000
#: Rows that repeat one piece and meet its text in one task.
SALT_ROWS = 1024

WORD = r"[^\x20\x09-\x0D]+"


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _bits60(x: Column) -> Column:
    return F.conv(F.substring(F.md5(x.cast("binary")), 1, 15), 16, 10).cast("long")


def line_table(docs: DataFrame) -> DataFrame:
    """``(id, th, pos, digest, words)`` of every line of every distinct document of ``(id, text)``; digests have 60 bits."""
    lines = docs.where("id IS NOT NULL").select("id", F.xxhash64("text").alias("th"), F.posexplode(F.transform(
        _lines(F.col("text")), lambda x: F.struct(_bits60(x).alias("digest"),
                                                 F.size(F.regexp_extract_all(x, F.lit(WORD), F.lit(0))).alias("words")))))
    rows = lines.select("id", "th", "pos", "col.digest", "col.words").repartition("id", "th")
    return rows.dropDuplicates(["id", "th", "pos"])


def chunk_table(lines: DataFrame) -> DataFrame:
    """``(id, th, chunk, first, key, words, rolls)`` of the chunks.

    ``first`` counts lines, ``words`` and ``rolls`` have an entry a line; a line's
    roll is the rolling hash of the line before and itself.
    """
    doc = Window.partitionBy("id", "th").orderBy("pos")
    rolled = lines.withColumn("roll", _bits60(
        F.concat_ws(",", F.lag("digest", 1, 0).over(doc).cast("string"), F.col("digest").cast("string"))))
    least = F.coalesce((F.col("roll") <= F.lead("roll").over(doc)) | (F.col("roll") < F.lag("roll").over(doc)), F.lit(False))
    ends = least | (F.col("words") >= LONG_LINE) | (F.lead("words", 1, 0).over(doc) >= LONG_LINE)
    before = doc.rowsBetween(Window.unboundedPreceding, -1)
    numbered = rolled.withColumn("ends", ends).withColumn(
        "chunk", F.coalesce(F.sum(F.col("ends").cast("int")).over(before), F.lit(0)).cast("int"))
    chunks = numbered.groupBy("id", "th", "chunk").agg(
        F.min("pos").alias("first"), F.sort_array(F.collect_list(F.struct("pos", "digest", "words", "roll"))).alias("l"))
    return chunks.select("id", "th", "chunk", "first", F.xxhash64("l.digest").alias("key"),
                         F.col("l.words").alias("words"), F.col("l.roll").alias("rolls"))


def with_first(rows: DataFrame, places: DataFrame, key: str, at: str, total: int) -> DataFrame:
    """``rows`` plus ``origin`` and ``times``: where ``key`` stands first in ``places`` and how often, null if only there.

    The origin is a struct ``(id, at, th)``, and null for the first place itself.  ``total`` counts the rows of ``places``.
    Keys of a thousandth of them or more, a thousand at most, are joined by broadcast; the others are shuffled.
    """
    firsts = places.groupBy(key).agg(F.count(F.lit(1)).alias("times"), F.min(F.struct("id", at, "th")).alias("origin")).where("times > 1")
    hot = firsts.where(F.col("times") * HOT_KEYS >= total).withColumnsRenamed({"times": "h_times", "origin": "h_origin"})
    cold = firsts.where(F.col("times") * HOT_KEYS < total).withColumnRenamed(key, "c_key")
    # rows of hot keys have their answer already and are spread over the shuffle
    known = rows.join(F.broadcast(hot), key, "left").withColumn(
        "c_key", F.when(F.col("h_times").isNotNull(), F.xxhash64("id", "th", at)).otherwise(F.col(key)))
    found = known.join(cold, "c_key", "left").withColumn("origin", F.coalesce("h_origin", "origin")).withColumn(
        "times", F.coalesce("h_times", "times"))
    repeats = F.struct("id", at, "th") != F.col("origin")
    return found.withColumn("times", F.when(repeats, F.col("times"))).withColumn(
        "origin", F.when(repeats, F.col("origin"))).drop("c_key", "h_times", "h_origin")


def repeated_runs(chunks: DataFrame) -> DataFrame:
    """Pieces of repeated runs of more than ``MIN_WORDS`` words: lines ``first`` to ``first + n - 1`` of a document.

    Columns ``id, th, first, n, o_id, o_th, o_first`` (where the piece stands first) and ``times``.  A piece is a chunk
    or, where a run is extended, a line with the line next to it.
    """
    doc = Window.partitionBy("id", "th").orderBy("chunk")
    total = chunks.agg(F.count(F.lit(1)).alias("chunks"), F.coalesce(F.sum(F.size("rolls")), F.lit(0)).alias("lines")).first()
    found = with_first(chunks, chunks, "key", "first", total["chunks"])
    near = F.max(F.col("origin").isNotNull()).over(doc.rowsBetween(-FLANK, FLANK))
    near_lines = found.withColumn("near", near).where("near").select(
        "id", "th", F.struct("first", F.size("words").alias("n"), "origin", "times").alias("chunk"),
        F.posexplode(F.arrays_zip("words", "rolls")).alias("k", "line")).select(
        "id", "th", (F.col("chunk.first") + F.col("k")).alias("pos"), "line.words", F.col("line.rolls").alias("roll"),
        F.when(F.col("k") == 0, F.col("chunk")).alias("chunk"), F.col("chunk.origin").isNotNull().alias("c"))

    line = Window.partitionBy("id", "th").orderBy("pos")
    steps = chunks.select("id", "th", "first", F.posexplode("rolls").alias("k", "roll")).select(
        "id", "th", (F.col("first") + F.col("k")).alias("pos"), "roll")
    stepped = with_first(near_lines, steps, "roll", "pos", total["lines"])
    # a step comes from the line before, so the first line of a document has none
    stepped = stepped.withColumn("again", F.col("origin").isNotNull() & (F.col("pos") > 0)).withColumn("k0", F.col("c"))
    for k in range(FLANK):
        c = f"k{k}"
        right = F.col("again") & F.lag(c, 1, False).over(line)
        left = F.lead("again", 1, False).over(line) & F.lead(c, 1, False).over(line)
        stepped = stepped.withColumn(f"k{k + 1}", F.col(c) | right | left)
    last, step = f"k{FLANK}", F.struct("pos", "origin", "times")
    # the step that an added line hangs on: the one to the line behind it, or its own
    behind = F.lead("again", 1, False).over(line) & F.lead(f"k{FLANK - 1}", 1, False).over(line)
    covered = stepped.withColumn("step", F.when(behind, F.lead(step).over(line)).otherwise(step)).where(last)
    covered = covered.withColumn("run", F.col("pos") - F.row_number().over(line))
    run = Window.partitionBy("id", "th", "run")
    kept = covered.withColumn("run_words", F.sum("words").over(run)).where(F.col("run_words") > MIN_WORDS)
    whole = kept.where("c AND chunk IS NOT NULL").select(
        "id", "th", "chunk.first", "chunk.n", F.col("chunk.origin.id").alias("o_id"), F.col("chunk.origin.th").alias("o_th"),
        F.col("chunk.origin.first").alias("o_first"), "chunk.times")
    added = kept.where("NOT c").select(
        "id", "th", (F.col("step.pos") - 1).alias("first"), F.lit(2).alias("n"), F.col("step.origin.id").alias("o_id"),
        F.col("step.origin.th").alias("o_th"), (F.col("step.origin.pos") - 1).alias("o_first"), "step.times")
    return whole.unionByName(added)


def removable_pieces(base: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(g_id, g_th, places)``: arrays of ``struct(first, n, piece)``, line ranges with the text of their first occurrence.

    ``base`` has the digest ``__th`` of the text.  Only first occurrences are cut
    out and sent, to the documents that repeat them; one that is repeated often
    is sent once for every ``SALT_ROWS`` repeats.
    """
    spark = base.sparkSession
    ensure_checkpoint_dir(spark)
    work = base.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    home = scratch_path(spark, f"line-dedup-{uuid.uuid4().hex}")
    chunk_table(line_table(work)).write.parquet(home)  # numbers only
    salts = F.ceil(F.col("times") / SALT_ROWS).cast("int")
    runs = repeated_runs(spark.read.parquet(home)).withColumn("salts", salts).drop("times").checkpoint(eager=True)
    place = ["o_id", "o_th", "o_first", "n", "salts"]
    wanted = runs.select(place).distinct().groupBy("o_id", "o_th").agg(
        F.collect_list(F.struct("o_first", "n", "salts")).alias("wanted"))
    found = base.select(id_col, text_col, "__th").join(wanted, (F.col(id_col) == F.col("o_id")) & (F.col("__th") == F.col("o_th")))
    pieces = found.select("o_id", "o_th", _lines(F.col(text_col)).alias("lines"), F.explode("wanted").alias("w")).select(
        "o_id", "o_th", "w.o_first", "w.n", "w.salts",
        F.array_join(F.slice("lines", F.col("w.o_first") + 1, F.col("w.n")), "\n").alias("piece")).select(
        "*", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    salted = runs.withColumn("salt", F.pmod(F.xxhash64("id", "first"), F.col("salts")).cast("int"))
    return salted.join(pieces, [*place, "salt"]).groupBy(
        F.col("id").alias("g_id"), F.col("th").alias("g_th")).agg(F.collect_set(F.struct("first", "n", "piece")).alias("places"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with repeated runs of lines removed from ``text_col``, plus ``n_lines`` and ``n_removed`` (longs).

    Null texts stay null and have no lines; an empty text has one.  Rows that
    repeat both id and text are one document and change alike; rows without id
    are left as they are.  Columns whose names clash with the counts give way.
    """
    columns = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    # The caller's columns go by their place until the end, so that no name of theirs meets one of the joins.
    held = {c: f"in{k}" for k, c in enumerate(columns)}
    id_in, text_in = held[id_col], held[text_col]
    # Both joins below shuffle this frame by the same keys, so Spark can shuffle it once.
    base = docs.select(*[F.col(f"`{c}`").alias(held[c]) for c in columns]).where(F.col(id_in).isNotNull()).withColumn(
        "__th", F.xxhash64(text_in))
    places = removable_pieces(base, id_in, text_in)
    joined = base.alias("d").join(places.alias("g"), (F.col(f"d.{id_in}") == F.col("g.g_id"))
                                  & (F.col("d.__th") == F.col("g.g_th")), "left")
    # Each step is one generated column, so that a filter on the result can't pull the work apart and repeat it.
    step = lambda df, c, name: df.select("*", F.explode(F.array(c)).alias(name))
    joined = step(joined, _lines(F.col(f"d.{text_in}")), "__lines")
    # the byte comparison: a place is removed if its lines are those of the first occurrence
    same = F.filter("g.places", lambda p: F.array_join(F.slice("__lines", p["first"] + 1, p["n"]), "\n") == p["piece"])
    joined = step(joined, F.transform(same, lambda p: F.struct(p["first"].alias("first"), p["n"].alias("n"))), "__gone")
    gone = F.flatten(F.transform("__gone", lambda r: F.sequence(r["first"], r["first"] + r["n"] - 1)))
    left = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), gone)
    joined = step(joined, F.when(F.col("__gone").isNotNull(), F.transform(left, lambda i: F.get("__lines", i))), "__left")
    text = F.when(F.col("__left").isNull(), F.col(f"d.{text_in}")).otherwise(F.array_join("__left", "\n"))
    n_removed = F.when(F.col("__left").isNull(), 0).otherwise(F.size("__lines") - F.size("__left")).cast("long")
    joined = step(joined, F.struct(text.alias("text"), n_removed.alias("n_removed")), "__result")
    n_lines = lambda lines: F.when(lines.isNull(), 0).otherwise(F.size(lines)).cast("long").alias("n_lines")
    out = joined.select(*[F.col("__result.text").alias(c) if c == text_col else F.col(f"d.{held[c]}").alias(c) for c in columns],
                        n_lines(F.col("__lines")), F.col("__result.n_removed").alias("n_removed"))
    nameless = docs.where(F.col(id_col).isNull()).select(
        *[F.col(f"`{c}`") for c in columns], n_lines(_lines(F.col(text_col))), F.lit(0).cast("long").alias("n_removed"))
    return out.unionByName(nameless)


def dedup_report(docs: DataFrame) -> DataFrame:
    return dedup_lines(docs.select("doc_id", "text"))


#: The same in DuckDB SQL; chunks are grouped by their text there.
DIGEST_SQL = r"""
WITH ln AS (SELECT doc_id, text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos, unnest(string_split(text, chr(10))) AS line
            FROM documents WHERE text IS NOT NULL),
lw AS (SELECT doc_id, pos, line, ('0x' || substr(md5(line), 1, 15))::BIGINT AS digest, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS words FROM ln),
lr AS (SELECT *, lag(line) OVER w AS prev, ('0x' || substr(md5((lag(digest, 1, 0) OVER w)::VARCHAR || ',' || digest::VARCHAR), 1, 15))::BIGINT AS roll
       FROM lw WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
le AS (SELECT *, coalesce(roll <= lead(roll) OVER w, false) OR coalesce(roll < lag(roll) OVER w, false)
              OR words >= 12 OR lead(words, 1, 0) OVER w >= 12 AS ends FROM lr WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
lc AS (SELECT *, coalesce(sum(ends::INT) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS chunk FROM le),
ch AS (SELECT doc_id, chunk, min(pos) AS first, list(line ORDER BY pos) AS piece FROM lc GROUP BY 1, 2),
rp AS (SELECT doc_id, chunk, row_number() OVER (PARTITION BY piece ORDER BY doc_id, first) > 1 AS k FROM ch),
la AS (SELECT doc_id, pos, line, words, k AS k0, prev IS NOT NULL AND row_number() OVER (PARTITION BY prev, line ORDER BY doc_id, pos) > 1 AS again
       FROM lc JOIN rp USING (doc_id, chunk)),
l1 AS (SELECT *, k0 OR again AND lag(k0, 1, false) OVER w OR lead(again, 1, false) OVER w AND lead(k0, 1, false) OVER w AS k1
       FROM la WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
l2 AS (SELECT *, k1 OR again AND lag(k1, 1, false) OVER w OR lead(again, 1, false) OVER w AND lead(k1, 1, false) OVER w AS k2
       FROM l1 WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
l3 AS (SELECT *, k2 OR again AND lag(k2, 1, false) OVER w OR lead(again, 1, false) OVER w AND lead(k2, 1, false) OVER w AS k3
       FROM l2 WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
ru AS (SELECT *, pos - row_number() OVER (PARTITION BY doc_id, k3 ORDER BY pos) AS run FROM l3),
rw AS (SELECT *, k3 AND sum(words) OVER (PARTITION BY doc_id, k3, run) > 50 AS gone FROM ru),
kept AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone) AS text, count(*) FILTER (gone) AS n_removed FROM rw GROUP BY 1)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(kept.text, '') END AS text,
       CASE WHEN d.text IS NULL THEN 0 ELSE len(string_split(d.text, chr(10))) END::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed
FROM documents d LEFT JOIN kept USING (doc_id)
"""
