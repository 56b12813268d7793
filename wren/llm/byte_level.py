"""Byte-level BPE encoding and decoding with the tokenizers library (operator 13).

The vocabulary is a file of ranks (base64 of a token's bytes and its rank) or a
tokenizers JSON file.  Ranks become merges: the token of rank ``r`` is made by
the one pair that the merges before ``r`` leave of its own bytes.  That gives
the same ids as merging by rank alone.  Suppose another pair ``(a, b)`` spelled
a token ``t`` inside a word: no merge has crossed the ends of ``t`` there, so
the merges up to the rank of ``t`` went as they go on ``t`` by itself, and have
already made ``t``.  ``merges_of`` raises where a token doesn't come down to two parts.

Tasks work on slices of Arrow batches.  A text is cut by the pattern, the words
of a slice that the task's table doesn't hold go to the library in one call, and
the ids are put together from the table.  Texts with characters whose class may
depend on the Unicode version of the regular expression engine go to the
library whole, so its own pattern engine cuts them.

Bytes and characters: a token covers bytes ``[s, e)`` of the UTF-8 text; the
running count of bytes that start a character maps them to code points, and a
token that holds part of a character covers that character.  Decoding looks the
bytes of the ids up in the reversed byte table and joins them before they are
read as UTF-8, so characters split between tokens come out whole; what is left
of a character whose other bytes are missing becomes U+FFFD.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re

import numpy as np
import regex
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .bpe import byte_symbols
from .frames import map_text

#: Words kept in each of the two generations of a task's table, and the greatest length of a kept word.
WORD_TABLE, WORD_CHARS = 300_000, 64
#: Characters outside these ranges may be of another class in another Unicode version.
LATIN = r"[\x00-\u024f]*"
UNSTABLE = r"[^\x00-\u024f\u2010-\u2027\u4e00-\u9fa5]"


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a rank file; the file is bounded by its vocabulary and read on the driver."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def parts_below(token: bytes, rank: int, ranks: dict[bytes, int]) -> list[bytes]:
    """What the merges of a rank below ``rank`` leave of the bytes of ``token``."""
    parts = [token[i:i + 1] for i in range(len(token))]
    while len(parts) > 1:
        r, i = min((ranks.get(a + b, rank), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
        if r >= rank:
            break
        parts[i:i + 2] = [parts[i] + parts[i + 1]]
    return parts


def merges_of(ranks: dict[bytes, int]) -> list[tuple[bytes, bytes]]:
    """The pair that makes each token of two bytes or more, by rank."""
    out = []
    for token, rank in sorted(ranks.items(), key=lambda kv: kv[1]):
        if len(token) > 1:
            parts = parts_below(token, rank, ranks)
            if len(parts) != 2:
                raise ValueError(f"no pair of lower ranks makes token {rank}")
            out.append((parts[0], parts[1]))
    return out


def from_ranks(ranks: dict[bytes, int], pattern: str) -> dict:
    """What a task needs for a rank file: the library's own description as JSON, the pattern, the bytes of each id."""
    from tokenizers import Regex, Tokenizer, models, pre_tokenizers

    symbol = byte_symbols()

    def spell(token: bytes) -> str:
        return "".join(symbol[b] for b in token)

    model = models.BPE({spell(t): r for t, r in ranks.items()}, [(spell(a), spell(b)) for a, b in merges_of(ranks)])
    whole = Tokenizer(model)
    whole.pre_tokenizer = pre_tokenizers.Sequence([
        pre_tokenizers.Split(Regex(pattern), behavior="isolated"),
        pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    table = [b""] * (max(ranks.values(), default=-1) + 1)
    for token, rank in ranks.items():
        table[rank] = token
    return {"whole": whole.to_str(), "pattern": pattern, "bytes": table, "live": {}}


def from_json(path: str, pattern: str) -> dict:
    """The same for a tokenizers JSON file of a byte-level model whose own pattern is ``pattern``."""
    with open(path, encoding="utf-8") as f:
        text = f.read()
    spec = json.loads(text)
    back = {s: b for b, s in enumerate(byte_symbols())}
    added = {t["id"]: t["content"].encode() for t in spec.get("added_tokens", [])}
    vocab = spec["model"]["vocab"]
    table = [b""] * (max([*vocab.values(), *added], default=-1) + 1)
    for token, i in vocab.items():
        table[i] = bytes(back[c] for c in token)
    for i, token in added.items():
        table[i] = token
    return {"whole": text, "pattern": pattern, "bytes": table, "live": {}}


def plain_pattern(pattern: str, points: list[int]) -> str:
    """``pattern`` with its classes spelled out for texts of the characters ``points`` only."""
    def ranges(kind: str) -> str:
        found = [c for c in points if regex.fullmatch(kind, chr(c))]
        runs = [(a, b) for a, b in zip([c for c in found if c - 1 not in found], [c for c in found if c + 1 not in found])]
        return "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in runs)

    out = re.sub(r"\[[^]]*\]", lambda m: m[0].replace(r"\p{L}", ranges(r"\p{L}")).replace(r"\p{N}", ranges(r"\p{N}"))
                 .replace(r"\s", ranges(r"\s")), pattern)
    for kind in (r"\p{L}", r"\p{N}", r"\s"):
        out = out.replace(kind, f"[{ranges(kind)}]")
    return out.replace(r"\S", f"[^{ranges(chr(92) + 's')}]")


def _live(spec: dict) -> dict:
    """The library's objects and the word table of this Python process, made on first use."""
    live = spec["live"]
    if not live:
        from tokenizers import Tokenizer, pre_tokenizers

        whole = Tokenizer.from_str(spec["whole"])
        whole.no_truncation()
        whole.no_padding()
        whole.encode_special_tokens = True
        words = Tokenizer(whole.model)
        words.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        live.update(
            whole=whole, words=words, table={}, older={}, unstable=re.compile(UNSTABLE).search,
            find=regex.compile(spec["pattern"]).findall, latin=re.compile(LATIN).fullmatch,
            find_ascii=re.compile(plain_pattern(spec["pattern"], list(range(0x80)))).findall,
            find_latin=re.compile(plain_pattern(spec["pattern"], list(range(0x250)))).findall,
            lengths=np.array([len(t) for t in spec["bytes"]], dtype=np.int64),
            names=np.array([b"%d " % i for i in range(len(spec["bytes"]))]))
    return live


def share(df: DataFrame, spec: dict) -> Broadcast:
    """``spec`` as a broadcast; its size is that of the vocabulary file, whatever the table."""
    return df.sparkSession.sparkContext.broadcast({**spec, "live": {}})


def encode_texts(spec: dict, texts: list[str]) -> list[np.ndarray]:
    """Ids of every text, without special tokens."""
    live = _live(spec)
    cut, whole = [], []
    for text in texts:
        if text.isascii():
            cut.append(live["find_ascii"](text))
        elif live["latin"](text):
            cut.append(live["find_latin"](text))
        elif live["unstable"](text):
            cut.append(None)
            whole.append(text)
        else:
            cut.append(live["find"](text))
    direct = iter(live["whole"].encode_batch_fast(whole, add_special_tokens=False))
    if len(live["table"]) >= WORD_TABLE:
        live["older"], live["table"] = live["table"], {}
    table, older = live["table"], live["older"]
    missing = set().union(*(c for c in cut if c)) - table.keys()
    known = {w: older[w] for w in missing & older.keys()}
    table.update(known)
    missing = list(missing - known.keys())
    if missing:  # one call: the words as a text that is cut already
        coded = live["words"].encode(missing, is_pretokenized=True, add_special_tokens=False)
        ids = np.array(coded.ids, dtype="<u4").tobytes()
        ends = (4 * np.cumsum(np.bincount(np.array(coded.word_ids, dtype=np.int64), minlength=len(missing)))).tolist()
        table.update((word, ids[i:j]) for word, i, j in zip(missing, [0, *ends], ends))
    out = [np.array(next(direct).ids, dtype="<u4") if words is None
           else np.frombuffer(b"".join(map(table.__getitem__, words)), dtype="<u4") for words in cut]
    for word in missing:
        if len(word) > WORD_CHARS:
            del table[word]
    return out


def decode_ids(spec: dict, ids: np.ndarray) -> bytes:
    """The bytes that the ids stand for, one after the other; an id outside the vocabulary stands for none."""
    table = spec["bytes"]
    if ids.size and int(ids.max()) >= len(table):
        ids = ids[ids < len(table)]
    return b"".join(map(table.__getitem__, ids.tolist()))


def char_spans(text: bytes, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and past-the-end code points of tokens that end at the byte offsets ``ends`` of a UTF-8 text."""
    if not len(ends):
        return np.zeros(0, "<i4"), np.zeros(0, "<i4")
    nth = np.cumsum((np.frombuffer(text, dtype=np.uint8) & 0xC0) != 0x80)  # characters begun up to a byte
    starts = np.concatenate([[0], ends[:-1]])
    return (nth[starts] - 1).astype("<i4"), nth[ends - 1].astype("<i4")


def encode(docs: DataFrame, spec: dict, text_col: str = "text", ids_col: str = "ids", starts_col: str | None = "starts",
           ends_col: str | None = "ends") -> DataFrame:
    """Add the token ids of every whole text and the code points that each token covers.

    All three columns are binary: ids as little-endian unsigned 32-bit integers,
    starts and ends (past the end) as little-endian signed ones; ``None`` for
    ``starts_col`` and ``ends_col`` leaves them out.  Null and empty texts have no
    ids.  Other columns stay, one whose name clashes with an output column gives
    way; repeated rows are encoded each; an empty table stays empty.
    """
    shared = share(docs, spec)
    spans = [c for c in (starts_col, ends_col) if c]

    def run(texts: list) -> list[dict]:
        spec = shared.value
        out = []
        for text, ids in zip(texts, encode_texts(spec, [t or "" for t in texts])):
            row = {ids_col: ids.tobytes()}
            if spans:
                ends = np.cumsum(_live(spec)["lengths"][ids])
                first, last = char_spans((text or "").encode(), ends)
                row |= {starts_col: first.tobytes(), ends_col: last.tobytes()}
            out.append(row)
        return out

    return map_text(docs, text_col, run, T.StructType([T.StructField(c, T.BinaryType()) for c in [ids_col, *spans]]))


def decode(coded: DataFrame, spec: dict, ids_col: str = "ids", bytes_col: str = "decoded_bytes",
           text_col: str = "decoded") -> DataFrame:
    """Add the bytes that the ids of ``ids_col`` stand for and their text.

    Ids may be any run of a text's ids: parts of a character at its edges become
    U+FFFD in ``text_col`` and stay as they are in ``bytes_col``.  Null ids stand
    for nothing.  Other columns stay, clashing ones give way.
    """
    shared = share(coded, spec)

    def run(packed: list) -> list[dict]:
        out = []
        for ids in packed:
            raw = decode_ids(shared.value, np.frombuffer(ids or b"", dtype="<u4"))
            out.append({bytes_col: raw, text_col: raw.decode("utf-8", errors="replace")})
        return out

    added = T.StructType([T.StructField(bytes_col, T.BinaryType()), T.StructField(text_col, T.StringType())])
    return map_text(coded, ids_col, run, added)


def token_digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """One row per document: number of tokens, digest of the decimal ids, digest of the decoded bytes.

    Ids are encoded, written out and decoded again in one pass over the texts, so
    no id leaves its task.  Null and empty texts have no tokens.
    """
    shared = share(docs, from_ranks(read_ranks(path), pattern))

    def run(texts: list) -> list[dict]:
        spec = shared.value
        names, out = _live(spec)["names"], []
        for ids in encode_texts(spec, [t or "" for t in texts]):
            decimal = names[ids].tobytes().translate(None, b"\0")[:-1]  # fixed width, filled up with zero bytes
            out.append({"n_tokens": len(ids), "ids_sha256": hashlib.sha256(decimal).hexdigest(),
                        "decoded_sha256": hashlib.sha256(decode_ids(spec, ids)).hexdigest()})
        return out

    added = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()),
                          T.StructField("decoded_sha256", T.StringType())])
    return map_text(docs.select("doc_id", "text"), "text", run, added).drop("text")
