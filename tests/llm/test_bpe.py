import random
import struct

import pytest

from wren.llm.bpe import Automaton, encode_decode, token_digests
from wren.llm.queries import word_vocabulary

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(word_vocabulary())


@pytest.fixture(scope="module")
def automaton():
    return Automaton(word_vocabulary())


def ids_of(packed):
    return list(struct.unpack(f"<{len(packed) // 4}I", packed))


def test_equals_the_library_on_random_texts(automaton, library):
    rng = random.Random(5)
    letters = "abcdefghijklmnopqrstuvwxyz ABC'’é漢字ñΣςİßǅﬁ 0123456789!?.<|>/w🎉́​\x85\xa0\x1c\t\n"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(4000)]
    texts += ["".join(rng.choice("abethrinso") for _ in range(rng.randint(0, 40))) for _ in range(4000)]
    texts += ["".join(rng.choice("ae") for _ in range(rng.randint(0, 40))) for _ in range(1000)]
    texts += ["a" * 3000, "!" * 300, "x<|endoftext|>y <|startoftext|>", "", "<|endoftext|>", "ΑΣ Σ"]
    for text, coded in zip(texts, library.encode_batch(texts, add_special_tokens=False)):
        packed = automaton.encode(text)
        assert ids_of(packed) == coded.ids, text
        assert automaton.decode(packed) == library.decode(coded.ids, skip_special_tokens=False)


def test_seam_agrees_with_merging_two_tokens(automaton):
    """The arc v stays behind u exactly if plain merging of u's and v's symbols gives u, v again."""
    rng = random.Random(2)
    merges = automaton.rank
    tokens = [t for t in automaton.accept if t >= 0 and not automaton.labels[t].endswith("</w>")]

    def symbols(t):
        return symbols(automaton.parts[t][0]) + symbols(automaton.parts[t][1]) if t in automaton.parts else [t]

    by_rank = {r: c for c, (a, b, r) in automaton.parts.items()}

    def merged(s):
        s = list(s)
        while len(s) > 1:
            r, i = min((merges.get(p, 1 << 60), i) for i, p in enumerate(zip(s, s[1:])))
            if r == 1 << 60:
                break
            s[i:i + 2] = [by_rank[r]]
        return s

    for _ in range(3000):
        u, v = rng.choice(tokens), rng.choice(tokens)
        assert (automaton.seam(u, v) is None) == (merged(symbols(u) + symbols(v)) == [u, v])


def test_edge_rows(spark, edge_docs, no_docs, automaton, library):
    rows = encode_decode(edge_docs.withColumnRenamed("n_words", "ids"), word_vocabulary()).collect()
    assert len(rows) == edge_docs.count()
    for r in rows:
        want = library.encode(r["text"] or "", add_special_tokens=False).ids
        assert ids_of(r["ids"]) == want
        assert r["decoded"] == library.decode(want, skip_special_tokens=False)
    assert token_digests(no_docs, word_vocabulary()).count() == 0
    empty = token_digests(edge_docs.where("doc_id = 2"), word_vocabulary()).first()
    assert empty["n_tokens"] == 0
