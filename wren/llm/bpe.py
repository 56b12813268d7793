"""BPE encoding and decoding with a tokenization automaton (operator 4).

The merge list is compiled into a deterministic automaton whose states are the
token just read and whose arcs are labelled with the next token.  The start is
the automaton that reads any string of base symbols.  Taking the merges in rank
order, the gadget of a merge ``(a, b) -> c`` adds the arc ``c`` wherever ``a b``
can be read and deletes the path ``a b``.  Behind a token ``u`` the arc ``v``
stays exactly if no gadget fires on the seam between them; ``seam`` plays the
gadgets that touch one seam in rank order, and the arc table is filled from it.
Every word then has one path, the canonical tokenization, which is found left
to right: a trie gives the tokens that start at a position, the arc table says
which of them may follow the token that ended there.

The compiled tables are bounded by the vocabulary file and travel as one
broadcast; encoding is row by row inside the tasks, so no row is shuffled.
"""

from __future__ import annotations

import json
import re
import struct
import unicodedata

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .frames import map_text

#: Entries kept in a task's word table (in each of two generations) and arc table before they are started anew.
WORD_TABLE, ARC_TABLE = 300_000, 2_000_000


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself if it prints, else the next one from U+0100 on."""
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    extra = iter(range(0x100, 0x200))
    return [chr(b) if b in prints else chr(next(extra)) for b in range(256)]


class WordTable(dict):
    """Ids of words already read: two generations of bounded size, so that frequent words stay."""

    def __init__(self, encode):
        self.encode, self.older = encode, {}

    def __missing__(self, word: str) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            ids = self.encode(word)
            ids = struct.pack(f"<{len(ids)}I", *ids)
        if len(self) >= WORD_TABLE:
            self.older = dict(self)
            self.clear()
        if len(word) <= 64:
            self[word] = ids
        return ids


class Automaton:
    """Compiled tables of one vocabulary file: trie, seams, labels, pre-split rule."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        self.end = model.get("end_of_word_suffix") or ""
        self.labels: dict[int, str] = {i: t for t, i in vocab.items()}
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.labels.update({i: t for t, i in self.added.items()})
        pretokenizers = spec["pre_tokenizer"]["pretokenizers"]
        self.split = pretokenizers[0]["pattern"]["Regex"]
        self.rank: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}  # token -> (left, right, rank of the merge that makes it)
        for r, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            left, right, made = vocab[a], vocab[b], vocab[a + b]
            self.rank.setdefault((left, right), r)
            self.parts.setdefault(made, (left, right, r))
        self._build_trie(vocab)

    def _build_trie(self, vocab: dict[str, int]) -> None:
        spelled: dict[int, tuple[str, ...]] = {i: (t,) for t, i in vocab.items() if i not in self.parts}
        reachable = set(spelled)
        for token, (a, b, r) in sorted(self.parts.items(), key=lambda kv: kv[1][2]):
            spelled[token] = spelled[a] + spelled[b]
            if a in reachable and b in reachable and self.seam(a, b) == (a, b):
                reachable.add(token)
        self.goto: list[dict[str, int]] = [{}]
        self.accept: list[int] = [-1]
        for token in reachable:
            node = 0
            for s in spelled[token]:
                nxt = self.goto[node].get(s)
                if nxt is None:
                    nxt = self.goto[node][s] = len(self.goto)
                    self.goto.append({})
                    self.accept.append(-1)
                node = nxt
            self.accept[node] = token
        self.length = {t: len(spelled[t]) for t in reachable}
        self.shorter = {}  # token -> its longest proper prefix that is a token
        for token in reachable:
            node, best = 0, -1
            for s in spelled[token][:-1]:
                node = self.goto[node][s]
                best = self.accept[node] if self.accept[node] >= 0 else best
            self.shorter[token] = best

    def _spine(self, token: int, side: int) -> list[tuple[int, float]]:
        """The pieces of a token that touch its left (0) or right (1) edge, smallest first, each with the rank that consumes it."""
        out, until = [], float("inf")
        while True:
            out.append((token, until))
            if token not in self.parts:
                return out[::-1]
            until = self.parts[token][2]
            token = self.parts[token][side]

    def seam(self, u: int, v: int) -> tuple[int, int] | None:
        """The first merge whose gadget fires across the seam of ``u`` and ``v``, or None: then the arc stays."""
        right, left = self._spine(u, 1), self._spine(v, 0)
        i = j = 0
        while True:
            (x, x_until), (y, y_until) = right[i], left[j]
            r = self.rank.get((x, y))
            # Of equal merges the leftmost goes first: before the seam inside u, after it inside v.
            if r is not None and r < x_until and r <= y_until:
                return x, y
            if x_until == y_until == float("inf"):
                return None
            if x_until <= y_until:
                i += 1
            else:
                j += 1

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if not k.startswith("_")}

    def __setstate__(self, state):
        self.__dict__.update(state)

    # -- in the tasks ------------------------------------------------------

    def _ready(self) -> None:
        if "_words" not in self.__dict__:
            self._words = WordTable(self.word_ids)
            self._arcs: dict[int, bool] = {}
            self._bytes = str.maketrans({chr(b): s for b, s in enumerate(byte_symbols())})
            self._find = regex.compile(self.split).findall
            # The same rule for lower-case ASCII, where letters, digits and white space are plain ranges.
            self._find_ascii = re.compile(self.split.replace(r"[\p{L}]", "[a-z]").replace(r"[\p{N}]", "[0-9]")
                                          .replace(r"[^\s\p{L}\p{N}]", r"[^\t-\r a-z0-9]")).findall
            self._special = regex.compile("|".join(map(regex.escape, self.added))) if self.added else None
            self._label = [self.labels.get(i, "") for i in range(max(self.labels) + 1)]

    def _arc(self, u: int, v: int) -> bool:
        """Fill one entry of the arc table."""
        if len(self._arcs) >= ARC_TABLE:
            self._arcs.clear()
        hit = self._arcs[u << 32 | v] = self.seam(u, v) is None
        return hit

    def word_ids(self, word: str) -> list[int]:
        """Tokens of one pre-split word: the labels on its path through the automaton."""
        self._ready()
        syms = list(word.encode("utf-8").decode("latin-1").translate(self._bytes))
        syms[-1] += self.end
        n = len(syms)
        goto, accept, arcs, length, shorter = self.goto, self.accept, self._arcs, self.length, self.shorter
        path: list[int] = []
        dead = bytearray(n + 1)  # positions from which no path reaches the end
        at, u, trial = 0, -1, None
        while at < n:
            token = trial
            if token is None:  # the longest token that starts here
                token, i, node = -1, at, goto[0].get(syms[at])
                while node is not None:
                    if accept[node] >= 0:
                        token = accept[node]
                    i += 1
                    node = goto[node].get(syms[i]) if i < n else None
            while token >= 0:
                if not dead[at + length[token]]:
                    stays = True if u < 0 else arcs.get(u << 32 | token)
                    if stays or stays is None and self._arc(u, token):
                        break
                token = shorter[token]
            if token >= 0:
                path.append(token)
                at += length[token]
                u, trial = token, None
            else:  # no arc leads on: step back and take a shorter token there
                dead[at] = 1
                back = path.pop()
                at -= length[back]
                u, trial = path[-1] if path else -1, shorter[back]
        return path

    def _plain(self, text: str) -> bytes:
        if text.isascii():
            words = self._find_ascii(text.lower())
        else:  # letters are lowered one by one, so sigma takes no final form
            words = self._find(unicodedata.normalize("NFC", text).replace("Σ", "σ").lower())
        return b"".join(map(self._words.__getitem__, words))

    def encode(self, text: str | None) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers; nothing for null or empty text."""
        self._ready()
        if not text:
            return b""
        if self._special is None or not self._special.search(text):
            return self._plain(text)
        out, at = [], 0
        for m in self._special.finditer(text):
            out += [self._plain(text[at:m.start()]), struct.pack("<I", self.added[m[0]])]
            at = m.end()
        return b"".join([*out, self._plain(text[at:])])

    def decode(self, ids: bytes | None) -> str:
        """The labels of the arcs, one after the other; the file names no decoder, so a space stands between them."""
        self._ready()
        return " ".join(map(self._label.__getitem__, np.frombuffer(ids or b"", dtype="<u4").tolist()))


def encode_decode(docs: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids",
                  decoded_col: str = "decoded") -> DataFrame:
    """Add the token ids of every whole text and the text decoded from them.

    ``ids_col`` is binary, four bytes little-endian for each id; ``decoded_col``
    is a string.  All other columns stay; one whose name clashes with an output
    column gives way to it.  Null and empty texts have no ids and decode to the
    empty string; repeated rows are encoded each; an empty table stays empty.
    """
    automaton = docs.sparkSession.sparkContext.broadcast(Automaton(path))

    def run(texts: list) -> list[dict]:
        a = automaton.value
        out = []
        for t in texts:
            ids = a.encode(t)
            out.append({ids_col: ids, decoded_col: a.decode(ids)})
        return out

    added = T.StructType([T.StructField(ids_col, T.BinaryType()), T.StructField(decoded_col, T.StringType())])
    return map_text(docs, text_col, run, added)


def token_digests(docs: DataFrame, path: str) -> DataFrame:
    """One row per document: number of tokens and the digests of ids and decoded text."""
    coded = encode_decode(docs.select("doc_id", "text"), path)
    return coded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
