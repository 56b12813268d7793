import random
import re
import time

import pytest

from wren.llm import personal_data as P
from wren.llm.personal_data import find_personal_data, fit_trees, fixed_spans, luhn, redact

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
         "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in m[0].split(".")),
                  "card": 16 <= len(d) <= 19 and luhn(d), "phone": 8 <= len(d) <= 15}[kind]
            if ok:
                out.append((kind, *m.span()))
    return out


def test_fixed_patterns_against_plain_search():
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab1.@+-() 5%_9:2") for _ in range(rng.randint(0, 60))) for _ in range(8000)]
    texts += ["".join(rng.choice("0123456789. -") for _ in range(rng.randint(0, 80))) for _ in range(4000)]
    texts += ["é@a.b x@y.z@q.r", "4111 1111 1111 1111", "+1 (555) 123-4567 4111111111111111", "1.2.3.4.5.6.7.8", "0001.2.3.4", "256.1.1.1"]
    for t in texts:
        assert fixed_spans(t)[0] == plain(t), t


def test_luhn():
    assert luhn("4111111111111111") and not luhn("4111111111111112")


def test_long_texts_take_linear_time():
    for piece in ("1", "a", "a@", "1.", "+1", "+1(", "@", "- ", "A1", "token="):
        P.spans_of(piece * 50_000, None)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 18)))

    def card():
        while True:
            d = "".join(rng.choice("0123456789") for _ in range(16))
            if luhn(d):
                return d

    makers = [lambda: 'token = "' + "".join(rng.choice("0123456789abcdef") for _ in range(40)) + '"',
              lambda: "password=" + "".join(rng.choice("0123456789abcdef") for _ in range(18)),
              lambda: "AKIA" + "".join(rng.choice("ABCDEFGHJKLMNPQRSTUVWXYZ234567") for _ in range(16)),
              card, lambda: ".".join(str(rng.randint(0, 255)) for _ in range(4)), lambda: f"{word()}@{word()}.org",
              lambda: f"+1 ({rng.randint(200, 999)}) 555-{rng.randint(1000, 9999)}",
              lambda: "9" * 16, lambda: "999.888.777.666", lambda: word() + word() + word() + word(), lambda: str(rng.randint(1, 99999))]
    return [(i, " ".join(x for _ in range(6) for x in ([word() for _ in range(8)] + [rng.choice(makers)()]))) for i in range(900)]


def test_held_out_secrets_are_found_and_plain_words_left(spark, corpus):
    trees = fit_trees(spark.createDataFrame(corpus[:600], "doc_id long, text string"))
    assert trees is not None
    n = found = 0
    for _, t in corpus[600:]:
        base, spans = P.spans_of(t, trees)
        assert set(base) <= set(spans) and base == [s for s in fixed_spans(t)[0]]
        secrets = [m.span(m.lastindex) for m in re.finditer(r'token = "(\w+)"|password=(\w+)|(AKIA\w{16})', t)]
        n += len(secrets)
        found += sum(("secret", *s) in spans for s in secrets)
        for k, a, z in set(spans) - set(base):
            assert any(c.isdigit() or c.isupper() for c in t[a:z])
    assert found >= 0.95 * n > 100


def test_long_secrets_are_found_whole(spark, corpus):
    trees = fit_trees(spark.createDataFrame(corpus[:600], "doc_id long, text string"))
    rng = random.Random(4)
    for n in (150, 201, 401, 1000, 20_000):
        value = "".join(rng.choice("0123456789abcdef") for _ in range(n))
        while fixed_spans(value)[0]:  # a card number inside would count by itself
            value = "".join(rng.choice("abcdef") if c.isdigit() and i % 9 == 0 else c for i, c in enumerate(value))
        for before in ("we use token=", 'password: "', "keep "):
            text = f"{before}{value} \" for now"
            assert ("secret", len(before), len(before) + n) in P.candidates(text)
            if before != "keep ":
                assert redact(text, P.spans_of(text, trees)[1]) == f"{before}[secret] \" for now"
    key = "sk-" + value
    assert sum(y for y, _ in P.examples(key)) == 1


def test_a_key_that_holds_a_card_number_is_found_whole(spark, corpus):
    trees = fit_trees(spark.createDataFrame(corpus[:600], "doc_id long, text string"))
    key = "a3f9c1d07be4111111111111111e8b2c6d4f0a9"
    text = f'token = "{key}" and a@b.co'
    base, spans = P.spans_of(text, trees)
    assert [k for k, _, _ in base] == ["email", "card"] and set(base) <= set(spans)
    assert ("secret", 9, 9 + len(key)) in spans
    assert redact(text, spans) == 'token = "[secret]" and [email]'
    # one within a fixed match adds nothing, and added spans don't overlap each other
    inside = "some-long-user-name-2024@b.co +1 555 555 1234"
    assert P.spans_of(inside, trees)[1] == P.spans_of(inside, trees)[0]
    for _, t in corpus[600:]:
        base, spans = P.spans_of(t, trees)
        added = sorted((a, z) for _, a, z in set(spans) - set(base))
        assert all(z <= a for (_, z), (a, _) in zip(added, added[1:]))


def test_many_candidates_in_one_text(spark, corpus):
    """Overlaps are found by search, not by comparing all spans of a text."""
    trees = fit_trees(spark.createDataFrame(corpus[:600], "doc_id long, text string"))
    text = " ".join(f"u{i}@b.co password=8f3e{i:06d}c1a9" for i in range(20_000))
    began = time.monotonic()
    base, spans = P.spans_of(text, trees)
    assert len(base) == 20_000 and len(spans) == 40_000 and time.monotonic() - began < 60


def test_redaction():
    t = "mail a@b.co or 10.0.0.1 now"
    assert redact(t, fixed_spans(t)[0]) == "mail [email] or [ip] now"
    assert redact(None, []) is None


def test_edge_rows(spark, edge_docs, no_docs):
    assert fit_trees(edge_docs) is None and fit_trees(no_docs) is None  # too little to learn from
    out = find_personal_data(edge_docs.withColumnRenamed("n_words", "spans"), None, redacted_col="clean")
    rows = out.collect()
    assert len(rows) == edge_docs.count() and all(r["spans"] == "" and r["n_email"] == 0 for r in rows)
    assert {r["doc_id"]: r["clean"] for r in rows}[2] is None
    one = spark.createDataFrame([(1, "😀 a@b.co 4111-1111-1111-1111")], "doc_id long, text string")
    assert find_personal_data(one, None).first()["spans"] == "email:2:8,card:9:28"


def test_trees_are_fitted_on_all_documents(spark, corpus, monkeypatch):
    from wren.llm import personal_data as P

    monkeypatch.setattr(P, "SAMPLE_DOCS", 1, raising=False)
    assert fit_trees(spark.createDataFrame(corpus[:600], "doc_id long, text string")) is not None
