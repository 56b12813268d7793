import hashlib
import random

import numpy as np
import pytest

from wren.llm import byte_level as bl

tokenizers = pytest.importorskip("tokenizers")
tiktoken = pytest.importorskip("tiktoken")
P = pytest.importorskip("public_tokenizers")

RANKS = P.path("byte_bpe_50k.tiktoken")
TEXTS = ["", " ", "a", "Hello  world!\n\n x'll don't 'S", "naïve café — “quoted” 漢字 かな 🎉🎉 é́", "\x1c\x85\xa0  ﻿",
         "<|endoftext|> x", "aaaaaaaaaaaaaaaaaaaa" * 20, "x" * 5000, "1234567890" * 30, " \t " * 50, "՘ೝ꟏𐥀", "\x00\x01\x7f"]


@pytest.fixture(scope="module")
def ranks():
    return bl.read_ranks(RANKS)


@pytest.fixture(scope="module")
def spec(ranks):
    return bl.from_ranks(ranks, P.PATTERN)


@pytest.fixture(scope="module")
def library(ranks):
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def random_texts(n):
    rng = random.Random(11)
    letters = "abcdeinorstABC'lvmd 0123456789!?.<|>/\n\t\r\x0b\x1céñß漢字ΣИ🎉́\x85\xa0 "
    return ["".join(rng.choice(letters) for _ in range(rng.randint(0, 80))) for _ in range(n)]


def test_ids_equal_merging_by_rank(spec, library):
    texts = TEXTS + random_texts(3000)
    for text, ids in zip(texts, bl.encode_texts(spec, texts)):
        assert ids.tolist() == library.encode_ordinary(text), text
        assert bl.decode_ids(spec, ids) == text.encode()


def test_every_stable_character_is_cut_alike(spec, library):
    """Characters that the tasks' own pattern engine may cut are of one class in all engines."""
    points = [c for c in [*range(0x250), *range(0x2010, 0x2028), *range(0x4E00, 0x9FA6)]]
    texts = [f"a{chr(c)}1{chr(c)}!{chr(c)} {chr(c)}" for c in points]
    for text, ids in zip(texts, bl.encode_texts(spec, texts)):
        assert ids.tolist() == library.encode_ordinary(text), ascii(text)


def test_merges_are_those_of_the_json_file(ranks):
    import json

    with open(P.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        merges = json.load(f)["model"]["merges"]
    symbol = bl.byte_symbols()
    ours = [["".join(symbol[b] for b in part) for part in pair] for pair in bl.merges_of(ranks)]
    assert ours == [m if isinstance(m, list) else m.split(" ") for m in merges]
    with pytest.raises(ValueError):
        bl.merges_of({b"a": 0, b"b": 1, b"c": 2, b"abc": 3})


def test_table_starts_anew(spec, library, monkeypatch):
    monkeypatch.setattr(bl, "WORD_TABLE", 50)
    own = {**spec, "live": {}}
    for text in random_texts(400):
        assert bl.encode_texts(own, [text, text])[1].tolist() == library.encode_ordinary(text)


def test_offsets_and_split_characters(spark, spec):
    """Offsets equal the library's; ids cut inside a character decode to its other bytes and U+FFFD."""
    whole = tokenizers.Tokenizer.from_str(spec["whole"])
    texts = [t for t in TEXTS + random_texts(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    coded = bl.encode(docs, spec)
    for r in coded.collect():
        want = whole.encode(r["text"], add_special_tokens=False)
        assert np.frombuffer(r["ids"], "<u4").tolist() == want.ids
        spans = list(zip(np.frombuffer(r["starts"], "<i4").tolist(), np.frombuffer(r["ends"], "<i4").tolist()))
        assert spans == want.offsets, r["text"]
    back = {r["doc_id"]: (r["decoded_bytes"], r["decoded"]) for r in bl.decode(coded, spec).collect()}
    assert back == {i: (t.encode(), t) for i, t in enumerate(texts)}
    ids = np.array(whole.encode("🎉").ids, "<u4")
    assert len(ids) > 1
    cut = spark.createDataFrame([(1, ids[:1].tobytes()), (2, ids[1:].tobytes()), (3, None), (4, b"")], "k int, ids binary")
    rows = {r["k"]: r for r in bl.decode(cut, spec).collect()}
    assert rows[1]["decoded_bytes"] + rows[2]["decoded_bytes"] == "🎉".encode()
    assert "�" in rows[1]["decoded"] and rows[3]["decoded"] == rows[4]["decoded"] == ""


def test_edge_rows(spark, edge_docs, no_docs, library, spec):
    got = sorted(map(tuple, bl.token_digests(edge_docs, RANKS, P.PATTERN).collect()), key=str)
    want = []
    for r in edge_docs.collect():
        ids = library.encode_ordinary(r["text"] or "")
        want.append((r["doc_id"], len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
                     hashlib.sha256((r["text"] or "").encode()).hexdigest()))
    assert got == sorted(want, key=str)
    assert bl.token_digests(no_docs, RANKS, P.PATTERN).collect() == []
    clash = edge_docs.withColumnRenamed("n_words", "ids")
    out = bl.encode(clash, spec, starts_col=None, ends_col=None)
    assert out.columns == ["doc_id", "text", "lang", "source", "ids"] and out.count() == edge_docs.count()
