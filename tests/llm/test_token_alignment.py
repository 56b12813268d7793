import hashlib
import random
from collections import Counter

import pytest

from wren.llm import byte_level as bl
from wren.llm import token_alignment as ta

tokenizers = pytest.importorskip("tokenizers")
sentencepiece = pytest.importorskip("sentencepiece")
P = pytest.importorskip("public_tokenizers")

A_PATH, B_PATH = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
EXTRA = ["a▁b", "<|endoftext|> <s> <unk>", "🎉 漢字", "  two  spaces ", "ﬁ", "a\r\nb", "\x00", "tokenization unbelievable"]


@pytest.fixture(scope="module")
def specs():
    return bl.from_json(A_PATH, P.PATTERN), ta.read_pieces(B_PATH)


def brute_rows(texts, a_bytes, b_bytes):
    """Every group and link by comparing all byte ranges, with plain library calls."""
    a_lib = tokenizers.Tokenizer.from_file(A_PATH)
    a_lib.encode_special_tokens = True
    b_lib = sentencepiece.SentencePieceProcessor(model_file=B_PATH)
    docs, count = [], Counter()
    for text in texts:
        whole = " " + (text or "")
        a = a_lib.encode(whole, add_special_tokens=False).ids if text else []
        b = b_lib.encode(text) if text else []
        if b"".join(a_bytes[i] for i in a) != whole.encode() or b"".join(b_bytes[i] for i in b) != whole.encode():
            docs.append((0, 0, 0, [], ""))
            continue
        groups, links, i, k, left, right, pos_a, pos_b = [], [], 0, 0, [], [], 0, 0
        while i < len(a) or k < len(b):
            if pos_a <= pos_b and i < len(a):
                pos_a += len(a_bytes[a[i]])
                left.append(a[i])
                i += 1
            else:
                pos_b += len(b_bytes[b[k]])
                right.append(b[k])
                k += 1
            if pos_a == pos_b:
                groups.append(",".join(map(str, left)) + "|" + ",".join(map(str, right)))
                links.append((left[-1], right[-1]))
                left, right = [], []
        count.update(links)
        docs.append((len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    top = Counter()
    for (_, y), n in count.items():
        top[y] = max(top[y], n)
    return [(na, nb, ng, len(links), sum(count[x] == top[x[1]] for x in links), sum(count[x] for x in links), h)
            for na, nb, ng, links, h in docs]


def check(docs, specs):
    rows = docs.collect()
    want = sorted(((r["doc_id"], *w) for r, w in zip(rows, brute_rows([r["text"] for r in rows], specs[0]["bytes"], specs[1]["bytes"]))), key=str)
    assert sorted(map(tuple, ta.alignment_report(docs, *specs).collect()), key=str) == want


def test_edge_rows(spark, edge_docs, no_docs, specs):
    check(edge_docs, specs)
    assert ta.alignment_report(no_docs, *specs).collect() == []


def test_equals_brute_force(spark, specs):
    rng = random.Random(3)
    letters = "abcdeinorst AB'0123.,!\n\té漢🎉 "
    texts = EXTRA + ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(150)]
    texts += ["the same text again and again"] * 60  # ties and a hot text
    check(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3), specs)


def test_groups_cover_equal_bytes(spark, specs):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(EXTRA)], "a_ids long, text string")  # a_ids gives way
    out = ta.align(docs, *specs)
    assert out.columns == ["text", "a_ids", "b_ids", "a_cuts", "b_cuts"]
    for r in out.collect():
        assert len(r["a_cuts"]) == len(r["b_cuts"])
        for i, j, k, m in zip([0, *r["a_cuts"]], r["a_cuts"], [0, *r["b_cuts"]], r["b_cuts"]):
            left = b"".join(specs[0]["bytes"][x] for x in r["a_ids"][i:j])
            assert left and left == b"".join(specs[1]["bytes"][x] for x in r["b_ids"][k:m])
        if r["a_ids"]:
            assert b"".join(specs[0]["bytes"][x] for x in r["a_ids"]) == (" " + r["text"]).encode()
            assert r["a_cuts"][-1] == len(r["a_ids"]) and r["b_cuts"][-1] == len(r["b_ids"])


def test_pairs_stay_in_their_bound(spark, specs):
    assert ta.pair_bound([b"ab", b"b"], [b"b", b"xb", b"c"]) == 3  # ab-b, b-b, b-xb
    bound = ta.pair_bound(specs[0]["bytes"], specs[1]["bytes"])
    assert bound < 350_000
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(EXTRA)], "doc_id long, text string")
    for r in ta.pair_counts(ta._linked(docs, *specs)).collect():
        a, b = specs[0]["bytes"][r["pair"] // ta.PAIR], specs[1]["bytes"][r["pair"] % ta.PAIR]
        assert a.endswith(b) or b.endswith(a)
