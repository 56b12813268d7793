from collections import Counter

import pytest

from wren.llm.quality_rules import judge, line_fails, line_rules, repeated_words


def brute_repeats(words):
    windows = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    times = Counter(windows)
    return len({p for i, w in enumerate(windows) if times[w] > 1 for p in range(i, i + 8)})


@pytest.mark.parametrize("text", [
    "", "a", "a b c d e f g h", "a " * 9, "a b " * 30, " ".join(map(str, range(50))) + " x " + " ".join(map(str, range(20, 40))),
    "p q r s t u v w p q r s t u v w z"])
def test_repeated_words(text):
    assert repeated_words(text.encode().split()) == brute_repeats(text.split())


def test_lines():
    assert line_fails("a | b | c | d", 7)
    assert line_fails("WIN!! NOW!!", 2)
    assert line_fails("one two three four five six seven eight nine", 9)
    assert line_fails("All Rights Reserved.", 3)
    assert not line_fails("A plain sentence that says what it says, and stops.", 10)


def test_verdicts():
    good = "\n".join(f"Sentence number {i} has its own words, such as {i * 7} and {i * 13}." for i in range(6))
    assert judge(good)["kept"] and judge(good)["clean_text"] == good
    menu = good.split("\n")[0] + "\n" + "home | news | sport | shop | help | about | jobs | press | terms | login"
    assert not judge(menu)["kept"]  # it loses more than half
    assert judge(menu)["clean_text"] == good.split("\n")[0]
    assert not judge("too short.")["kept"] and judge("too short.")["base_failed"]


def test_edge_rows(edge_docs, no_docs):
    rows = line_rules(edge_docs).collect()
    assert len(rows) == edge_docs.count()
    by = {r["doc_id"]: r for r in rows}
    assert by[2]["n_words"] == 0 and by[2]["base_failed"] and by[2]["clean_text"] == ""
    assert by[4]["n_words"] == 0 and by[4]["word_chars"] == 0
    assert by[8]["word_chars"] == len(by[8]["text"].replace(" ", ""))
    assert by[6]["n_words"] == 30_000 and by[6]["n_repeat_words"] == 30_000
    assert line_rules(no_docs).count() == 0
