"""Personal data by candidate gradient boosting (operator 9).

Four fixed patterns with validators always count.  Beyond them, generators with
high recall propose overlapping spans (keys and tokens, values after a secret's
name, telephone and identity numbers);
boosted trees judge each by its format and its context, and a threshold that is
calibrated on held-out candidates selects the ones that are added.

The trees are fitted by Spark ML on the candidates of all documents.  Nobody
labels spans, so they label themselves: validated matches
and values that a secret's name introduces are positive, rejected matches and
ordinary long words negative.  Half of the examples lose their context features, so
that the format alone is learned as well.  The fitted trees are a few hundred
numbers; they travel to the tasks.  The table is read twice, for the fit and for
the spans, and only different examples are shuffled.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter

import numpy as np
import xxhash
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .frames import map_text

KINDS = ("email", "ip", "card", "phone", "secret", "identity")
BASE_KINDS = KINDS[:4]

#: Settings of the fit, and examples that a task of it holds.
TREES, DEPTH, PART_EXAMPLES = 20, 4, 50_000
#: Held-out precision that a threshold must reach, the least threshold, and examples of each class below which nothing is fitted.
PRECISION, LEAST_THRESHOLD, MIN_EXAMPLES = 0.98, 0.5, 20

AT_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A match can only begin at the first of a run of digits, so later starts needn't be tried.
IP = re.compile(r"(?<![0-9])([0-9]+)(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

#: Names that introduce secrets.
NAMES = r"(?:token|password|passwd|pwd|secret|api[_-]?key|access[_-]?key|private[_-]?key|credential|auth)"
VALUE = re.compile(NAMES + r"[\"']?\s{0,3}[:=]\s{0,3}[\"']?([^\s\"'#*$&,;|<>]{6,})", re.IGNORECASE | re.ASCII)
TOKEN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}={0,2}", re.ASCII)
LOCAL_PHONE = re.compile(r"(?<![\w+])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])", re.ASCII)
NUMBER_GROUPS = re.compile(r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])", re.ASCII)
ACCOUNT = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}(?![A-Za-z0-9])", re.ASCII)
NAME_BEFORE = re.compile(NAMES + r"\W{0,6}$", re.IGNORECASE | re.ASCII)
HINT_BEFORE = re.compile(r"(?:phone|tel|call|fax|card|visa|iban|account|ssn|passport|mail|key|id)\W{0,6}$", re.IGNORECASE | re.ASCII)
#: Beginnings of issued keys.
ISSUED = re.compile(r"(?:AKIA|ASIA|AIza|gh[pousr]_|xox[abprs]-|sk-)", re.ASCII)


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d)
        if i % 2:
            n = n * 2 - 9 * (n > 4)
        total += n
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    out, end = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        m = AT_DOMAIN.match(text, at) if start < at else None
        if m:
            out.append((start, m.end()))
            end = m.end()
        at = text.find("@", max(at + 1, end))
    return out


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def fixed_spans(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Matches of the fixed patterns that pass their validators, and those that fail."""
    good, bad = [("email", a, z) for a, z in _emails(text)], []
    for m in IP.finditer(text):
        parts = [p.lstrip(".").lstrip("0") for p in m.groups()]
        ok = all(len(p) <= 3 and int(p or 0) <= 255 for p in parts)
        (good if ok else bad).append(("ip", *m.span()))
    for m in CARD.finditer(text):
        d = _digits(m[0])
        (good if 16 <= len(d) <= 19 and luhn(d) else bad).append(("card", *m.span()))
    for m in PHONE.finditer(text):
        (good if 8 <= len(_digits(m[0])) <= 15 else bad).append(("phone", *m.span()))
    return good, bad


def candidates(text: str) -> list[tuple[str, int, int]]:
    """Overlapping spans that may be personal data, beyond the fixed matches."""
    found = [("secret", *m.span(1)) for m in VALUE.finditer(text)]
    found += [("secret", *m.span()) for m in TOKEN.finditer(text)]
    found += [("phone", *m.span()) for m in LOCAL_PHONE.finditer(text)]
    found += [("identity", *m.span()) for rule in (NUMBER_GROUPS, ACCOUNT) for m in rule.finditer(text)]
    return list(dict.fromkeys(found))


def features(text: str, kind: str, a: int, z: int) -> list[float]:
    """Format features, then context features (the last ``CONTEXT`` of them)."""
    s = text[a:z]
    n = len(s)
    digits = sum("0" <= c <= "9" for c in s)
    upper = sum("A" <= c <= "Z" for c in s)
    lower = sum("a" <= c <= "z" for c in s)
    hexed = sum(c in "0123456789abcdefABCDEF" for c in s)
    counts = Counter(s).values()
    entropy = -sum(c / n * math.log2(c / n) for c in counts)
    turns = sum(("0" <= x <= "9") != ("0" <= y <= "9") for x, y in zip(s, s[1:]))
    d = _digits(s)
    left, right = text[max(0, a - 24):a], text[z:z + 1]
    return [
        *[float(kind == k) for k in KINDS], float(min(n, 200)), digits / n, upper / n, lower / n, hexed / n,
        (n - digits - upper - lower) / n, entropy, turns / n, float(len(d)), float(16 <= len(d) <= 19 and luhn(d)),
        float(NAME_BEFORE.search(left) is not None), float(HINT_BEFORE.search(left) is not None),
        float(left[-1:] in "\"'=:"), float(right in "\"'"), float(left[-1:].isalnum()), float(right.isalnum()),
    ]


N_FEATURES, CONTEXT = len(features("x", "ip", 0, 1)), 6


def examples(text: str) -> list[tuple[float, list[float]]]:
    """Self-labelled candidates of one text: ``(label, features)``."""
    good, bad = fixed_spans(text)
    out = [(1.0, k, a, z) for k, a, z in good] + [(0.0, k, a, z) for k, a, z in bad]
    for m in VALUE.finditer(text):
        s = m[1]
        out.append((float(any(c.isdigit() for c in s) and len(set(s)) >= 6), "secret", *m.span(1)))
    for m in TOKEN.finditer(text):
        if ISSUED.match(m[0]):
            out.append((1.0, "secret", *m.span()))
        elif not any(c.isdigit() for c in m[0]):
            out.append((0.0, "secret", *m.span()))
    for m in LOCAL_PHONE.finditer(text):
        inside = any(k == "phone" and a <= m.start() and m.end() <= z for k, a, z in good)
        if inside:
            out.append((1.0, "phone", *m.span()))
    return [(y, f) for y, k, a, z in out for f in (features(text, k, a, z),)]


def _blind(f: list[float], key: int) -> list[float]:
    return [*f[:-CONTEXT], *[0.0] * CONTEXT] if key % 2 else f


class Trees:
    """Boosted trees as plain tables, and a threshold for their probability."""

    def __init__(self, trees: list[list[tuple]], weights: list[float], threshold: float):
        self.trees, self.weights, self.threshold = trees, weights, threshold

    def probability(self, x: list[float]) -> float:
        margin = 0.0
        for nodes, w in zip(self.trees, self.weights):
            at = 0
            while len(nodes[at]) > 1:
                feature, cut, left, right = nodes[at]
                at = left if x[feature] <= cut else right
            margin += w * nodes[at][0]
        return 1 / (1 + math.exp(-2 * max(-30.0, min(30.0, margin))))


def _tree_table(node, out: list) -> int:
    at = len(out)
    out.append(None)
    if node.getClass().getSimpleName().startswith("Leaf"):
        out[at] = (float(node.prediction()),)
    else:
        split = node.split()
        left = _tree_table(node.leftChild(), out)
        right = _tree_table(node.rightChild(), out)
        out[at] = (int(split.featureIndex()), float(split.threshold()), left, right)
    return at


def fit_trees(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Trees | None:
    """Trees fitted on the self-labelled candidates of all documents, or None if they show too few of a class.

    Equal examples count once.  A fifth of the candidates is held out; the threshold is the least at which the precision there reaches
    ``PRECISION``.
    """
    read = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("id IS NOT NULL")

    def run(texts: list) -> list[dict]:
        out = []
        for t in texts:
            found = examples(t or "")
            keys = [xxhash.xxh3_64_intdigest(repr(f)) & 0xFFFFFF for _, f in found]
            out.append({"found": [{"label": y, "part": k % 5, "f": _blind(f, k // 5)} for (y, f), k in zip(found, keys)]})
        return out

    schema = T.StructType([T.StructField("found", T.ArrayType(T.StructType([
        T.StructField("label", T.DoubleType()), T.StructField("part", T.IntegerType()),
        T.StructField("f", T.ArrayType(T.DoubleType()))])))])
    rows = map_text(read, "text", run, schema).select(F.explode("found").alias("c")).select("c.*").distinct()
    rows = rows.withColumn("features", array_to_vector("f")).persist()
    try:
        fit, held = rows.where("part > 0"), rows.where("part = 0")
        counts = {r["label"]: r["count"] for r in fit.groupBy("label").count().collect()}
        if min(counts.get(0.0, 0), counts.get(1.0, 0)) < MIN_EXAMPLES:
            return None
        model = GBTClassifier(featuresCol="features", labelCol="label", maxIter=TREES, maxDepth=DEPTH, seed=7,
                              maxBins=32).fit(fit.repartition(max(2, -(-int(sum(counts.values())) // PART_EXAMPLES))))
        tables = []
        for tree in model.trees:
            tables.append([])
            _tree_table(tree._java_obj.rootNode(), tables[-1])
        trees = Trees(tables, list(model.treeWeights), LEAST_THRESHOLD)
        scored = model.transform(held).select(F.round(vector_to_array("probability")[1], 2).alias("p"), "label")
        table = scored.groupBy("p").agg(F.sum("label").alias("pos"), F.count(F.lit(1)).alias("n")).collect()
    finally:
        rows.unpersist()
    pos = n = 0
    for r in sorted(table, key=lambda r: -r["p"]):  # 101 rows at most
        pos, n = pos + r["pos"], n + r["n"]
        if pos >= PRECISION * n:
            trees.threshold = max(LEAST_THRESHOLD, r["p"])
    return trees


def spans_of(text: str | None, trees: Trees | None) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """The fixed spans of a text, and these with the added ones; by kind, then start.

    Added spans don't overlap each other, the more probable one wins.  They may reach
    over fixed ones (a key that holds a valid card number); a candidate that lies
    within one fixed span covers nothing more and is left out.
    """
    if not text:
        return [], []
    base, _ = fixed_spans(text)
    good = list(base)
    if trees is not None:
        scored = []
        # the furthest end among the fixed spans that begin no later decides whether one of them holds a candidate
        starts, ends = [], []
        for a, z in sorted((a, z) for _, a, z in base):
            starts.append(a)
            ends.append(max(z, ends[-1]) if ends else z)
        for k, a, z in candidates(text):
            at = bisect_right(starts, a)
            if at and z <= ends[at - 1]:
                continue
            p = trees.probability(features(text, k, a, z))
            if p >= trees.threshold:
                scored.append((-p, a - z, k, a, z))
        taken: list[tuple[int, int]] = []  # disjoint, in order
        for _, _, k, a, z in sorted(scored):
            at = bisect_right(taken, (a, z))
            if (at == 0 or taken[at - 1][1] <= a) and (at == len(taken) or z <= taken[at][0]):
                taken.insert(at, (a, z))
                good.append((k, a, z))
    order = lambda s: (KINDS.index(s[0]), s[1])
    return sorted(base, key=order), sorted(good, key=order)


def find_personal_data(docs: DataFrame, trees: Trees | None, text_col: str = "text", redacted_col: str | None = None) -> DataFrame:
    """``docs`` with ``n_email, n_ip, n_card, n_phone`` and ``base_spans`` of the fixed matches and all ``spans``.

    Spans are ``kind:start:end`` in code points, comma-joined.  With
    ``redacted_col`` the text with every span replaced by its kind in brackets is
    added too.  Null and empty texts have no spans; repeated rows are judged
    each; columns whose names clash with the results give way.
    """
    shared = docs.sparkSession.sparkContext.broadcast(trees)

    def run(texts: list) -> list[dict]:
        out = []
        for t in texts:
            base, spans = spans_of(t, shared.value)
            row = {f"n_{k}": sum(s[0] == k for s in base) for k in BASE_KINDS}
            row["base_spans"], row["spans"] = (",".join(f"{k}:{a}:{z}" for k, a, z in x) for x in (base, spans))
            if redacted_col:
                row[redacted_col] = redact(t, spans)
            out.append(row)
        return out

    fields = [T.StructField(f"n_{k}", T.LongType()) for k in BASE_KINDS]
    fields += [T.StructField(c, T.StringType()) for c in ("base_spans", "spans", *([redacted_col] if redacted_col else []))]
    return map_text(docs, text_col, run, T.StructType(fields))


def redact(text: str | None, spans: list[tuple[str, int, int]]) -> str | None:
    if text is None:
        return None
    out, at = [], 0
    for k, a, z in sorted(spans, key=lambda s: (s[1], s[2])):
        if a >= at:
            out += [text[at:a], f"[{k}]"]
        at = max(at, z)
    return "".join([*out, text[at:]])


def personal_data_digests(docs: DataFrame) -> DataFrame:
    read = docs.select("doc_id", "text")
    found = find_personal_data(read, fit_trees(read))
    return found.select("doc_id", *[f"n_{k}" for k in BASE_KINDS],
                        F.sha2(F.col("base_spans").cast("binary"), 256).alias("base_sha256"), "spans")
