import random
from collections import defaultdict

import pytest

from wren.llm.html_text import AROUND, ARTICLE, OPEN, blocks_of, covered_shares, extract_text


def article(page):
    return "\n\n".join(t for r, t in blocks_of(page) if r == ARTICLE)


def test_article_without_what_stands_around_it():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="has-sidebar">
    <header><h1>Site</h1></header><nav><ul><li><a href="/a">Home</a></ul></nav><div id="cookie-notice">We use cookies</div>
    <!-- note <p>no</p> --><div class="ad">Buy</div>
    <article><header><h1>Title &lt;x&gt; &amp; more</h1></header><p>One <b>two
      three<br>four &nbsp; &eacute;&#233;&#x1F389;<p>Five <span class="advert">BUY</span> six <i>seven</i></p>
      <script>if (a<b) { document.write("</p><p>no") }</script><ul><li>First<li>Second</ul>
      <form><p>Mail us</p></form><aside>Related</aside><section class="comments"><p>First!</p></section>
      <p>a < b & c <img src=x.png alt="y>z"> end</p></article>
    <div class="sidebar"><p>Side</p></div><footer>&copy; Foot</footer></body>"""
    assert article(page) == "Title <x> & more\n\nOne two three four éé🎉\n\nFive six seven\n\nFirst\n\nSecond\n\na < b & c end"
    roles = {t: r for r, t in blocks_of(page)}
    assert all(roles[t] == AROUND for t in ("Site", "We use cookies", "Buy", "Side", "© Foot", "First!", "Mail us", "Related"))


@pytest.mark.parametrize("page,text", [
    (None, []), ("", []), ("<p>", []), ("plain", ["plain"]), ("a<b", ["a<b"]), ("<p>x</p>y<", ["x", "y<"]), ("<!-- open", []),
    ("<script>never closed <p>x", []), ("</div></p>x", ["x"]), ("<p>&am &amp;lt; &bogus;", ["&am &lt; &bogus;"])])
def test_broken_pages(page, text):
    assert [t for _, t in blocks_of(page)] == text


def test_long_broken_pages_take_linear_time():
    for piece in ('<a "', "<", "<div>", "<p>a", "<!-- ", "</b>", "&amp", "<p class='"):
        blocks_of(piece * 40_000)


def brute_shares(pages, run):
    whole = [tuple(p) for p in pages]
    owners = defaultdict(set)
    streams = [[(t, i) for i, b in enumerate(p) for t in b.split()] for p in pages]
    for p, s in zip(whole, streams):
        for i in range(len(s) - run + 1):
            owners[tuple(t for t, _ in s[i:i + run])].add(p)
    out = []
    for p, s in zip(whole, streams):
        inside = set()
        for i in range(len(s) - run + 1):
            if len(owners[tuple(t for t, _ in s[i:i + run])]) > 1:
                inside |= set(range(i, i + run))
        total, hit = defaultdict(int), defaultdict(int)
        for i, (_, b) in enumerate(s):
            total[b] += 1
            hit[b] += i in inside
        out.append([hit[b] / total[b] if total[b] else 0.0 for b in range(len(p))])
    return out


def test_shared_runs_against_brute_force():
    rng = random.Random(8)
    common = [" ".join(rng.choice("abcdef") for _ in range(rng.randint(2, 9))) for _ in range(6)]
    pages = [[rng.choice(common) if rng.random() < 0.4 else " ".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 12)))
              for _ in range(rng.randint(0, 6))] for _ in range(40)]
    pages += [pages[0], []]
    for run in (2, 3, 6):
        assert [[round(x, 9) for x in s] for s in covered_shares(pages, run)] == [[round(x, 9) for x in s] for s in brute_shares(pages, run)]
    assert [len(s) for s in covered_shares([[], []])] == [0, 0]


def test_pages_without_marked_article(spark):
    """What the markup leaves open is decided by the host's other pages."""
    frame = "<div>Welcome to the site of our little town today</div><div>{}</div><div>Call the office from nine to five on weekdays</div>"
    rows = [(i, f"http://Town.example/{i}", frame.format(" ".join(f"own{i}w{j}" for j in range(12)))) for i in range(4)]
    rows += [(10, "http://other.example/", frame.format("lonely words stay")), (11, None, "<div>no url</div>"), (12, "nohost", None)]
    out = {r["page_id"]: r["text"] for r in extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(4):
        assert out[i] == " ".join(f"own{i}w{j}" for j in range(12))
    assert out[10].count("\n\n") == 2 and out[11] == "no url" and out[12] == ""


def test_edge_rows(spark):
    rows = [(1, "http://h/a", "<article>x</article>", "text"), (1, "http://h/a", "<article>x</article>", "text"),
            (None, None, None, None), (3, "", "", "t"), (4, "http://h/" + "a" * 5000, "<p>" + "word " * 50_000, "t")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    out = extract_text(pages)
    assert out.columns == ["page_id", "url", "text", "n_blocks", "n_shared"]
    got = sorted((r["page_id"] or 0, len(r["text"])) for r in out.collect())
    assert got == [(0, 0), (1, 1), (1, 1), (3, 0), (4, 249_999)]
    assert extract_text(pages.where("false")).count() == 0




def test_a_host_in_many_parts_against_brute_force(spark, monkeypatch):
    """Runs that pages of different parts share count as in one comparison; copies in several parts are one page."""
    rng = random.Random(5)
    common = [" ".join(rng.choice("abcdef") for _ in range(rng.randint(6, 9))) for _ in range(40)]
    pages = [[rng.choice(common) if rng.random() < 0.3 else " ".join(rng.choice("abcdefghijkl") for _ in range(rng.randint(1, 12)))
              for _ in range(rng.randint(0, 6))] for _ in range(60)]
    pages += [pages[0]] * 5 + [["only copies of this page have these seven words"]] * 8 + [["too short"], []]
    rows = [(i, f"http://big.example/{i}", "".join(f"<div>{b}</div>" for b in p)) for i, p in enumerate(pages)]
    rows += [(1000 + i, f"http://small{i}.example/", f"<div>{common[0]}</div>") for i in range(3)]
    shares = brute_shares(pages, 6)
    want = {i: ("\n\n".join(b for b, s in zip(p, shares[i]) if s < 0.5), sum(s >= 0.5 for s in shares[i])) for i, p in enumerate(pages)}
    want |= {1000 + i: (common[0], 0) for i in range(3)}
    table = spark.createDataFrame(rows, "page_id long, url string, html string")
    for size in (10**6, 2000, 300):
        monkeypatch.setattr("wren.llm.html_text.GROUP_BYTES", size)
        assert {r["page_id"]: (r["text"], r["n_shared"]) for r in extract_text(table).collect()} == want


def test_ends_of_raw_elements_in_any_case():
    from wren.llm.html_text import blocks_of

    page = "<body><SCRIPT>a</scRIPT ><p>é one</p><style>K</STYLE><p>two</p><title>x</TITLE><p>three</p><script>no end"
    assert [t for _, t in blocks_of(page)] == ["é one", "two", "three"]
