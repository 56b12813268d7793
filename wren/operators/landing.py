"""Landing, keyed insert and snapshot upsert.

Semi-structured items are parsed with an explicit schema (no inference pass),
flattened, keyed and merged into a keyed table.  Writes never update in place:
an upsert produces a new snapshot (write to a new path, then point readers at
it), which is safe to retry when executors are lost mid-job.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .windows import top_n_per_group
from pyspark.sql import types as TT

ITEM_SCHEMA = ("type string, id string, text string, likeCount string, "
               "author struct<userName:string,followers:bigint,following:bigint>, "
               "hashtags array<string>, finishedAt timestamp")


# A2
def valid_items(items: DataFrame) -> DataFrame:
    return items.filter(F.col("type") == "tweet")


# A3
def parse_items(raw: DataFrame, schema: str = ITEM_SCHEMA, column: str = "raw") -> DataFrame:
    return raw.select(F.from_json(F.col(column), schema).alias("_item")).select("_item.*")


def flatten(df: DataFrame, sep: str = "_") -> DataFrame:
    """Expand nested structs into ``parent_child`` columns (``json_normalize``)."""
    def cols(dt: TT.StructType, prefix: list[str]) -> list[Column]:
        out: list[Column] = []
        for f in dt.fields:
            path = prefix + [f.name]
            if isinstance(f.dataType, TT.StructType):
                out += cols(f.dataType, path)
            else:
                out.append(F.col(".".join(f"`{p}`" for p in path)).alias(sep.join(path)))
        return out
    return df.select(*cols(df.schema, []))


# A4
def union_batches(*batches: DataFrame) -> DataFrame:
    out = batches[0]
    for b in batches[1:]:
        out = out.unionByName(b, allowMissingColumns=True)
    return out


# A5
def lists_to_csv(df: DataFrame) -> DataFrame:
    """Every array column becomes a comma string."""
    repl = {f.name: F.array_join(F.transform(F.col(f"`{f.name}`"), lambda x: x.cast("string")), ",")
            for f in df.schema.fields if isinstance(f.dataType, TT.ArrayType)}
    return df.withColumns(repl) if repl else df


# A6
def with_run_key(df: DataFrame, id_col: str = "id", run_col: str = "finishedAt") -> DataFrame:
    key = F.concat_ws("_", F.col(id_col), F.date_format(F.col(run_col), "yyyyMMddHHmmss"))
    return df.withColumn("uniqueid", key)


def land(raw: DataFrame) -> DataFrame:
    """A2 + A3 + A5 + A6: raw JSON items -> flat, keyed post rows."""
    items = valid_items(parse_items(raw))
    return with_run_key(lists_to_csv(flatten(items)))


# A7
def following_usernames(landed: DataFrame, max_items: int = 100) -> DataFrame:
    return (landed.select(F.col("author_userName").alias("userName")).filter(F.col("userName").isNotNull())
            .distinct().orderBy("userName").limit(max_items))


# A8
def cap_per_author(posts: DataFrame, as_of: Column, within_days: int, lang: str | None,
                   max_items: int, min_likes: int = 0, min_retweets: int = 0, min_replies: int = 0) -> DataFrame:
    """Latest ``max_items`` posts per author inside the window and filters.

    ``row_number() <= n`` per author is planned with a partial window group
    limit, so a hot author contributes at most n rows per task to the shuffle.
    """
    cond = ((F.col("created_at") >= as_of - F.make_dt_interval(days=F.lit(within_days)))
            & (F.coalesce("like_count", F.lit(0)) >= min_likes)
            & (F.coalesce("retweet_count", F.lit(0)) >= min_retweets)
            & (F.coalesce("reply_count", F.lit(0)) >= min_replies))
    if lang is not None:
        cond = cond & (F.col("lang") == lang)
    return top_n_per_group(posts.filter(cond), ["author_username"],
                           [F.desc("created_at"), F.asc("uniqueid")], max_items)


# A9 / C4
def insert_new(target: DataFrame, batch: DataFrame, key: str = "uniqueid") -> tuple[DataFrame, DataFrame]:
    """Rows of ``batch`` to append, and the insert report.

    Null keys are rejected; within the batch one row per key wins (least 64-bit
    hash of the remaining columns, so a re-run picks the same); keys already in
    the target are rejected.  The report counts keys only (hash aggregation of
    the key column); whole rows are ranked per key behind a group limit.
    Returns ``(rows_to_append, report)``.
    """
    cols = [c for c in batch.columns if c != key]
    existing = target.select(key).filter(F.col(key).isNotNull()).distinct().withColumn("_exists", F.lit(True))
    k, n, ex = F.col(key), F.col("_n"), F.coalesce(F.col("_exists"), F.lit(False))
    fresh = batch.filter(k.isNotNull()).join(existing, key, "left_anti").withColumn("_h", F.xxhash64(*cols) if cols else F.lit(0))
    rows = top_n_per_group(fresh, [key], [F.asc("_h")], 1).select(key, *cols)
    marked = batch.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).join(existing, key, "left")
    report = marked.agg(
        F.coalesce(F.sum(n), F.lit(0)).alias("offered"),
        F.coalesce(F.sum(F.when(k.isNull(), n)), F.lit(0)).alias("rejected_null_key"),
        F.coalesce(F.sum(F.when(k.isNotNull(), n - 1)), F.lit(0)).alias("rejected_duplicate"),
        F.count_if(k.isNotNull() & ~ex).alias("inserted"),
        F.count_if(k.isNotNull() & ex).alias("rejected_existing"),
    )
    return rows, report


# A10
def ingest_log(landed: DataFrame, run_col: str = "finishedAt") -> DataFrame:
    return (landed.groupBy(F.col(run_col).alias("run_at")).agg(F.count(F.lit(1)).alias("rows_added"))
            .select(F.concat(F.date_format("run_at", "yyyy-MM-dd HH:mm:ss"), F.lit(": "),
                             F.col("rows_added").cast("string"), F.lit(" rows added")).alias("line"),
                    "run_at", "rows_added"))


# A11 / A12 / C3
def upsert(target: DataFrame, updates: DataFrame, cols: list[str], key: str = "uniqueid",
           sequence: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Set ``cols`` by key (a matched null overwrites, like ``$set``).

    Of several updates for one key the last one by ``sequence`` wins; without a
    sequence column the one with the greatest 64-bit hash, so the target never
    gains rows and a re-run gives the same result.

    Returns ``(new_snapshot, changed)`` where ``changed`` counts target rows
    whose values actually changed (null-safe comparison).  Update rows with
    no target row are ignored, as an update-by-key does.
    """
    hashed = F.xxhash64(*cols)
    rank = [F.desc(sequence), hashed.desc()] if sequence else [hashed.desc()]
    last = top_n_per_group(updates.filter(F.col(key).isNotNull()), [key], rank, 1)
    upd = last.select(key, *[F.col(c).alias(f"_new_{c}") for c in cols]).withColumn("_hit", F.lit(True))
    joined = target.join(upd, key, "left")
    hit = F.coalesce(F.col("_hit"), F.lit(False))
    new_cols = {}
    changed_any = F.lit(False)
    for c in cols:
        old = F.col(c) if c in target.columns else F.lit(None)
        new = F.when(hit, F.col(f"_new_{c}")).otherwise(old)
        if c in target.columns:
            new = new.cast(target.schema[c].dataType)
        new_cols[c] = new
        changed_any = changed_any | (hit & ~old.eqNullSafe(F.col(f"_new_{c}")))
    flagged = joined.withColumn("_changed", changed_any).withColumns(new_cols)
    snapshot = flagged.select(*target.columns, *[c for c in cols if c not in target.columns])
    changed = flagged.agg(F.count_if(F.col("_changed")).alias("rows_changed"))
    return snapshot, changed


def write_snapshot(df: DataFrame, base: str, version: int, fmt: str = "parquet") -> str:
    """Write a new table version; readers switch to the returned path."""
    path = f"{base.rstrip('/')}/v={version:06d}"
    df.write.mode("overwrite").format(fmt).save(path)
    return path


# A13 / A14 / A15
JSON_TIMESTAMP_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"  # keep microseconds


def write_results(df: DataFrame, path: str, fmt: str = "json") -> str:
    w = df.write.mode("overwrite").format(fmt)
    if fmt == "json":
        w = w.option("timestampFormat", JSON_TIMESTAMP_FORMAT)
    w.save(path)
    return path


HISTORY_SCHEMA = ("seq long, run_id long, iteration long, tweet string, predicted_engagement double, "
                  "is_exploration boolean, actual_engagement double, feedback_collected_at timestamp, "
                  "variations array<string>, selected_idx int")
METRICS_SCHEMA = ("mean_absolute_error double, mean_relative_error double, exploration_error double, "
                  "exploitation_error double, sample_size long")


def load_json_table(spark: SparkSession, path: str, schema: str, multi_line: bool = False) -> DataFrame:
    """Read JSON with a fixed schema; an absent path gives an empty table and
    corrupt records become null rows instead of failing the job.

    ``multi_line=True`` reads files that hold one JSON document each (a
    top-level array of entries, as the reference writes its history); the
    default reads JSON Lines, as Spark writes them."""
    try:
        return (spark.read.schema(schema).option("mode", "PERMISSIVE").option("multiLine", str(multi_line).lower())
                .json(path))
    except Exception as e:  # noqa: BLE001 - missing path
        if "PATH_NOT_FOUND" in str(e) or "does not exist" in str(e):
            return spark.createDataFrame([], schema)
        raise


def load_history(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    return load_json_table(spark, path, HISTORY_SCHEMA, multi_line)


def load_metrics(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    return load_json_table(spark, path, METRICS_SCHEMA, multi_line)


# A16
@dataclass
class ProcessingOptions:
    """Job parameters of the feature batch job (defaults as in the reference code)."""
    batch_size: int = 50
    max_tweets: int | None = 5000  # None takes all
    process_topics: bool = True
    skip_short_replies: bool = True
    min_word_count: int = 0
    process_engagement: bool = True
    max_retries: int = 3
    delay_between: float = 1.0
    extra: dict = field(default_factory=dict)

    @classmethod
    def from_json(cls, text: str | None) -> "ProcessingOptions":
        if not text:
            return cls()
        raw = json.loads(text)
        known = {k: raw[k] for k in asdict(cls()) if k in raw and k != "extra"}
        return cls(**known, extra={k: v for k, v in raw.items() if k not in known})
