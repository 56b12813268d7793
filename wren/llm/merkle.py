"""Merkle manifest of a dataset (operator 11), DataFrame functions only.

Every row is a leaf.  Leaves of one part (``lang``) are numbered in the order of
their ids, and a slot pivot builds each level: node ``i`` stands in slot
``i % 8`` of parent ``i / 8``; one conditional aggregate per slot spreads the
children of a parent into eight columns, whose concatenation is hashed.  A part
of which one node remains is done, that node is its subroot; the subroots form a
last tree of the same kind.  On the way back down a node's siblings are the
columns of its parent without its own slot, so the path of a node is one
element longer than that of its parent.

Every step groups or joins by (part, parent), which holds eight rows at most, so
a part with any share of the rows spreads over all tasks.  The order comes from a range sort with
offsets, one row per range and part.  Only tables of parents carry paths (an
eighth of the rows); a leaf reads its siblings from its parent's row and hashes
them at once.  Leaves and levels are stored in the checkpoint folder.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wren.session import ensure_checkpoint_dir

FANOUT = 8
#: Columns of a row that make its leaf, in order.
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
SLOTS = [f"c{k}" for k in range(FANOUT)]


def field(value: Column) -> Column:
    """One input of a leaf: ``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the parts one after the other."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def joined(columns: list[Column]) -> Column:
    """Hex digests one after the other, nulls left out."""
    return F.concat_ws("", *columns) if columns else F.lit("")


def numbered(rows: DataFrame, part: str, order: list[str]) -> DataFrame:
    """Add ``i``: the place of a row in its part from 0, by ``order``; equal rows take places in any order.

    Ranges of (part, order, a random number) are sorted and numbered by themselves
    and moved by the rows of the same part in earlier ranges.  The rows are
    stored before and after they are dealt, as a random number or range bounds drawn again would
    give another order.
    """
    ensure_checkpoint_dir(rows.sparkSession)
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [part, *order, "spread"]
    spread = rows.withColumn("spread", F.rand(11)).checkpoint(eager=True)
    ranged = spread.repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumn(
        "at", F.monotonically_increasing_id()).checkpoint(eager=True)
    ranged = ranged.withColumn("rng", F.shiftright("at", 33))
    sizes = ranged.groupBy("rng", part).agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    before = Window.partitionBy(part).orderBy("rng").rowsBetween(Window.unboundedPreceding, -1)
    # One row per range and part that the range holds.
    offsets = sizes.select("rng", part, (F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")).alias("move"))
    return ranged.join(offsets, ["rng", part]).withColumn("i", F.col("at") + F.col("move")).drop("rng", "at", "move", "spread")


def pivot(nodes: DataFrame) -> DataFrame:
    """Parents of ``(part, i, h)``: ``part, i``, the digests of the children in ``c0`` to ``c7`` and of all as ``h``."""
    slot = F.pmod("i", F.lit(FANOUT))
    spread = nodes.groupBy("part", F.expr(f"i div {FANOUT}").alias("up")).agg(
        *(F.max(F.when(slot == k, F.col("h"))).alias(c) for k, c in enumerate(SLOTS)))
    return spread.select("part", F.col("up").alias("i"), *SLOTS, digest(joined([F.col(c) for c in SLOTS])).alias("h"))


def alone() -> Column:
    """Whether a parent's only child is the only node of its part: then the child is the subroot."""
    return (F.col("i") == 0) & F.col("c1").isNull()


def levels(leaves: DataFrame, most: int) -> Iterator[tuple[DataFrame, DataFrame]]:
    """``(parents, subroots)`` of each level from the leaves up, both stored; ``most`` is the size of the largest part."""
    nodes = leaves
    while most:
        made = pivot(nodes).checkpoint(eager=True)
        parents = made.where(~alone())
        yield parents, made.where(alone()).select("part", F.col("c0").alias("h"))
        nodes, most = parents.select("part", "i", "h"), 0 if most == 1 else -(-most // FANOUT)


def sides(slot: Column, parent: str) -> Column:
    """The siblings before and behind a slot, each joined: the slot columns of ``parent`` without the own one."""
    before = joined([F.when(slot > k, F.col(f"{parent}.{c}")) for k, c in enumerate(SLOTS)])
    behind = joined([F.when(slot < k, F.col(f"{parent}.{c}")) for k, c in enumerate(SLOTS)])
    return F.struct(before.alias("l"), behind.alias("r"))


def descend(leaves: DataFrame, built: list[tuple[DataFrame, DataFrame]], tops: DataFrame) -> DataFrame:
    """``leaves`` with ``path`` (siblings of each level, from the leaf up) and ``subroot``.

    ``built`` are the levels from the leaves up, ``tops`` has ``part, path, subroot``
    of every part: the path that goes on from its subroot.
    """
    above = None
    for k in reversed(range(len(built))):
        nodes = leaves if k == 0 else built[k - 1][0]
        done = built[k][1].select("part").join(tops, "part")  # one row per part whose subroot is at this level
        found = nodes.where(F.col("i") == 0).join(done, "part")
        if above is not None:
            over = above.select(F.col("part").alias("p"), F.col("i").alias("o"), F.struct(*SLOTS).alias("over"),
                                F.col("path").alias("rest"), F.col("subroot").alias("subroot"))
            own = F.array(sides(F.pmod("i", F.lit(FANOUT)), "over"))
            under = nodes.join(over, (F.col("part") == F.col("p")) & (F.expr(f"i div {FANOUT}") == F.col("o")))
            found = found.unionByName(under.withColumn("path", F.concat(own, "rest")).drop("p", "o", "over", "rest"))
        above = found
    return above


def manifest(rows: DataFrame, fields: list[str] = FIELDS, id_col: str = "doc_id", part_col: str = "lang",
             changed: dict[str, Column] | None = None) -> DataFrame:
    """One row per row: ``id_col, leaf, changed_leaf, subroot, root, path``.

    ``fields`` make the leaf; parts are the values of ``part_col`` (null first,
    then bytewise), leaves ascend by ``id_col`` (null first) and leaf.  ``path`` is
    an array of ``(l, r)``: the siblings before and behind the node, level by
    level; ``fold`` over it from the leaf gives the root.  ``changed`` replaces fields
    by other expressions, ``changed_leaf`` is the leaf made of them, null where
    they are as before.  Rows with equal ids and fields have equal leaves and take
    neighbouring places.  Columns not named play no part; an empty table stays empty.
    """
    now = [F.col(f"`{c}`") for c in fields]
    then = [(changed or {}).get(c, F.col(f"`{c}`")) for c in fields]
    differs = F.lit(False)
    for a, b in zip(now, then):
        differs = differs | ~a.eqNullSafe(b)
    leaves = rows.select(
        F.coalesce(F.concat(F.lit("="), F.col(f"`{part_col}`").cast("string")), F.lit("")).alias("part"),
        F.col(f"`{id_col}`").alias("id"), digest(*(field(c) for c in now)).alias("h"),
        F.when(differs, digest(*(field(c) for c in then))).alias("changed_leaf"))
    leaves = numbered(leaves, "part", ["id", "h"])
    most = leaves.agg(F.max("i")).first()[0]
    built = list(levels(leaves.select("part", "i", "h"), 0 if most is None else most + 1))
    empty = F.array().cast("array<struct<l:string,r:string>>")
    if not built:
        none = F.lit(None).cast("string")
        return leaves.select(F.col("id").alias(id_col), F.col("h").alias("leaf"), "changed_leaf", none.alias("subroot"),
                             none.alias("root"), empty.alias("path"))
    subroots = built[0][1]
    for _, more in built[1:]:
        subroots = subroots.unionByName(more)
    parts = numbered(subroots.select(F.lit("").alias("part"), F.col("part").alias("name"), "h"), "part", ["name"])
    last = list(levels(parts.select("part", "i", "h"), parts.agg(F.max("i")).first()[0] + 1))
    root = last[-1][1].first()["h"]
    whole = parts.sparkSession.range(1).select(F.lit("").alias("part"), empty.alias("path"), F.lit(root).alias("subroot"))
    tops = descend(parts, last, whole).select(F.col("name").alias("part"), "path", F.col("h").alias("subroot"))
    return descend(leaves, built, tops).select(
        F.col("id").alias(id_col), F.col("h").alias("leaf"), "changed_leaf", "subroot", F.lit(root).alias("root"), "path")


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its siblings give."""
    return F.aggregate(path, leaf, lambda h, s: digest(s["l"], h, s["r"]))


def proof(path: Column) -> Column:
    """Digest of all siblings of a path, level by level, left to right."""
    return digest(F.array_join(F.transform(path, lambda s: F.concat(s["l"], s["r"])), ""))


def lower_ascii(text: Column) -> Column:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(text, upper, upper.lower())


def proof_report(docs: DataFrame) -> DataFrame:
    """Manifest and membership proofs of ``documents``, every third tampered with.

    A document is tampered with where 3 divides the CRC-32 of its decimal id; its
    text is then read in lower case.  Without an id it is left as it is.  Texts
    without capitals, null and empty texts stay the same and verify.
    """
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, F.lit(False))
    text = F.when(hit, lower_ascii(F.col("text"))).otherwise(F.col("text"))
    made = manifest(docs, changed={"text": text})
    return made.select(
        "doc_id", "leaf", "subroot", "root", proof(F.col("path")).alias("proof_sha256"),
        fold(F.coalesce("changed_leaf", "leaf"), F.col("path")).alias("folded_root")).withColumn(
        "verified", F.col("folded_root") == F.col("root"))


def _levels_sql(source: str, name: str, depth: int) -> str:
    """CTEs of a tree over ``source(part, i, h)``: ``name0`` to ``name{depth}`` with siblings and the nodes left."""
    out = [f"{name}0 AS (SELECT part, i, h, count(*) OVER (PARTITION BY part) AS n FROM {source})"]
    for k in range(depth):
        near = "OVER (PARTITION BY part, i // 8 ORDER BY i ROWS BETWEEN"
        out.append(
            f"{name}s{k} AS (SELECT part, i, n, coalesce(string_agg(h, '') {near} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l, "
            f"coalesce(string_agg(h, '') {near} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM {name}{k})")
        out.append(
            f"{name}{k + 1} AS (SELECT part, i // 8 AS i, CASE WHEN max(n) > 1 THEN sha256(string_agg(h, '' ORDER BY i)) "
            f"ELSE max(h) END AS h, (max(n) + 7) // 8 AS n FROM {name}{k} GROUP BY part, i // 8)")
    return ",\n".join(out)


def _climb_sql(source: str, name: str, depth: int, keep: str) -> str:
    """CTE steps that take ``source(part, i, proof, folded)`` up all levels of a tree."""
    out, at = [], source
    for k in range(depth):
        out.append(
            f"{source}{k} AS (SELECT {keep}, x.part, x.i // 8 AS i, x.proof || s.l || s.r AS proof, "
            f"CASE WHEN s.n > 1 THEN sha256(s.l || x.folded || s.r) ELSE x.folded END AS folded "
            f"FROM {at} x JOIN {name}s{k} s ON s.part = x.part AND s.i = x.i)")
        at = f"{source}{k}"
    return ",\n".join(out)


def report_sql(depth: int = 9, part_depth: int = 5) -> str:
    """``proof_report`` in DuckDB SQL, for parts of up to ``8 ** depth`` rows and up to ``8 ** part_depth`` parts."""
    def make(text: str) -> str:
        one = "coalesce(strlen(CAST({0} AS VARCHAR)) || ':' || CAST({0} AS VARCHAR), '-')"
        return "sha256(" + " || ".join(one.format(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"

    step = "xor(c, x)"
    crc = (f"xor(list_reduce([4294967295] || flatten([[CAST(ascii(d) AS BIGINT), 0, 0, 0, 0, 0, 0, 0] FOR d IN "
           f"string_split(CAST(doc_id AS VARCHAR), '')]), lambda c, x: CASE WHEN {step} & 1 = 1 "
           f"THEN xor({step} >> 1, 3988292384) ELSE {step} >> 1 END), 4294967295)")
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    top = depth - 1
    return f"""WITH leaf AS (
  SELECT doc_id, coalesce('=' || lang, '') AS part, {make("text")} AS leaf,
    CASE WHEN {crc} % 3 = 0 THEN {make(lower)} ELSE {make("text")} END AS tampered
  FROM documents),
placed AS (SELECT *, row_number() OVER (PARTITION BY part ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM leaf),
nodes AS (SELECT part, i, leaf AS h FROM placed),
{_levels_sql("nodes", "t", depth)},
tops AS (SELECT '' AS part, part AS name, row_number() OVER (ORDER BY part) - 1 AS i, h FROM t{depth}),
{_levels_sql("tops", "u", part_depth)},
up AS (SELECT doc_id, part AS name, leaf, part, i, '' AS proof, tampered AS folded FROM placed),
{_climb_sql("up", "t", depth, "x.doc_id, x.leaf, x.name")},
over AS (SELECT x.doc_id, x.leaf, p.h AS subroot, p.part, p.i, x.proof, x.folded FROM up{top} x JOIN tops p ON p.name = x.name),
{_climb_sql("over", "u", part_depth, "x.doc_id, x.leaf, x.subroot")}
SELECT x.doc_id, x.leaf, x.subroot, r.h AS root, sha256(x.proof) AS proof_sha256, x.folded AS folded_root,
  x.folded = r.h AS verified
FROM over{part_depth - 1} x CROSS JOIN u{part_depth} r"""


REPORT_SQL = report_sql()
