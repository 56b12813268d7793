"""Text columns.

Regexes use explicit Unicode classes because Java's ``\\w`` is ASCII-only while
the reference's Python ``\\w`` is Unicode.  All of these are native Spark
expressions (regex, higher-order array functions) evaluated inside codegen;
the whole text of every row is processed.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values (patterns).
WORD = r"[\p{L}\p{N}_]+"
HASHTAG = r"#[\p{L}\p{N}_]+"
MENTION = r"@[\p{L}\p{N}_]+"
URL = r"https?://\S+"
# Emoji: one code point each, from these blocks (own definition; the library
# table the reference uses is not available):
#   U+1F1E6-U+1F1FF regional indicators, U+1F300-U+1F6FF pictographs,
#   emoticons and transport, U+1F900-U+1F9FF and U+1FA70-U+1FAFF supplemental
#   symbols, U+2600-U+27BF miscellaneous symbols and dingbats.
EMOJI = r"[\x{1F1E6}-\x{1F1FF}\x{1F300}-\x{1F6FF}\x{1F900}-\x{1F9FF}\x{1FA70}-\x{1FAFF}\x{2600}-\x{27BF}]"
VOWEL_GROUP = r"[aeiouy]+"
NON_WORD = r"[^\p{L}\p{N}_]+"
# a whole word token (not preceded or followed by a word character) that
# contains none of the vowels a, e, i, o, u, y
VOWELLESS_WORD = r"(?<![\p{L}\p{N}_])[\p{L}\p{N}_&&[^aeiouy]]+(?![\p{L}\p{N}_])"
SENTENCE_END = r"[.!?]+"
# Suffixes of the reference's fallback rewrites.
ROCKET = "\U0001F680"
SPARKLES = "✨"
SHORT_REPLY_TOPIC = "short reply"


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def count_matches(text: str | Column, pattern: str) -> Column:
    """Number of non-overlapping matches; 0 for null text."""
    return F.coalesce(F.regexp_count(_c(text), F.lit(pattern)), F.lit(0)).cast("int")


def words(text: str | Column) -> Column:
    """Lower-cased Unicode word tokens (Python ``re.findall(r'\\b\\w+\\b', t.lower())``)."""
    return F.regexp_extract_all(F.lower(_c(text)), F.lit(WORD), 0)


def whitespace_words(text: str | Column) -> Column:
    """``str.split()``: runs of whitespace, ends ignored."""
    t = _c(text)
    return F.filter(F.split(t, r"\s+"), lambda w: w != "")


def text_length(text: str | Column) -> Column:
    return F.coalesce(F.length(_c(text)), F.lit(0)).cast("int")


def word_count(text: str | Column) -> Column:
    return count_matches(F.lower(_c(text)), WORD)


def hashtag_count(text: str | Column) -> Column:
    return count_matches(text, HASHTAG)


def mention_count(text: str | Column) -> Column:
    return count_matches(text, MENTION)


def emoji_count(text: str | Column) -> Column:
    return count_matches(text, EMOJI)


def url_count(text: str | Column) -> Column:
    return count_matches(text, URL)


def avg_word_length(text: str | Column) -> Column:
    """Mean length of the word tokens; null when there are none.

    Removing every non-word character leaves exactly the concatenated tokens,
    so the total token length is one ``regexp_replace`` (codegen, no lambda).
    """
    low = F.lower(_c(text))
    n = count_matches(low, WORD)
    total = F.length(F.regexp_replace(low, NON_WORD, ""))
    return F.when(n > 0, total / n)


def syllables(text: str | Column) -> Column:
    """Vowel groups per word token, at least one per token, summed.

    A vowel group is a run of letters, so it never crosses a token boundary:
    the sum over tokens is the number of vowel groups in the whole text plus
    the number of tokens without a vowel."""
    low = F.lower(_c(text))
    return count_matches(low, VOWEL_GROUP) + count_matches(low, VOWELLESS_WORD)


def flesch_reading_ease(text: str | Column) -> Column:
    """Flesch reading ease by formula (own definition of syllables and sentences).

    syllables: vowel groups per word, at least one; sentences: runs of
    ``.!?``, at least one; 0 when the text has no words.
    """
    n_words = word_count(text)
    sentences = F.greatest(F.lit(1), count_matches(text, SENTENCE_END))
    score = (F.lit(206.835) - F.lit(1.015) * (n_words / sentences)
             - F.lit(84.6) * (syllables(text) / n_words))
    return F.when(n_words > 0, score).otherwise(F.lit(0.0))


def is_short_reply(text: str | Column) -> Column:
    """Starts with '@' and has at most 3 whitespace-separated words."""
    t = _c(text)
    return F.coalesce(t.startswith("@") & (F.size(whitespace_words(t)) <= 3), F.lit(False))


def parse_list(s: str | Column) -> Column:
    """List literal (``['a', 'b']``) or comma string -> array<string>; null -> []."""
    col = _c(s)
    parsed = F.from_json(col, "array<string>", {"allowSingleQuotes": "true"})
    return F.coalesce(
        parsed,
        F.when(F.trim(col) != "", F.split(col, ",")),
        F.array().cast("array<string>"),
    )


def parse_topics_json(s: str | Column) -> Column:
    """``{"topics": [...]}`` -> array<string>; bad or missing -> []."""
    parsed = F.from_json(_c(s), "topics array<string>")
    return F.coalesce(parsed.getField("topics"), F.array().cast("array<string>"))


def topics_to_csv(topics: str | Column, enabled: bool = True,
                  current: str | Column | None = None) -> Column:
    """Array of topics -> comma string, or the current string when topics are off."""
    if not enabled:
        return _c(current) if current is not None else F.lit(None).cast("string")
    return F.array_join(_c(topics), ",")


def split_topics(topics: str | Column) -> Column:
    """Comma string -> trimmed, non-empty topic array (spaces-only trim, as ``$trim``)."""
    parts = F.split(F.coalesce(_c(topics), F.lit("")), ",")
    return F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != "")


def strip_all(s: str | Column) -> Column:
    """Python ``str.strip()``: all leading and trailing whitespace."""
    return F.regexp_replace(_c(s), r"^\s+|\s+$", "")


def parse_variations(text: str | Column, n: int | Column) -> Column:
    """Numbered-list text -> array of items.

    Lines are stripped; a line starting with ``k.`` for k in 1..n opens an
    item (its text after the first '.'); other non-empty lines continue the
    open item; text before the first item is ignored.
    """
    n_col = n if isinstance(n, Column) else F.lit(n)
    lines = F.transform(F.split(F.coalesce(_c(text), F.lit("")), "\n"), lambda x: strip_all(x))

    def starts_item(line: Column) -> Column:
        num = F.regexp_extract(line, r"^(\d+)\.", 1)
        k = num.try_cast("int")
        return (num != "") & (k >= 1) & (k <= n_col) & ~num.startswith("0")

    empty = F.array().cast("array<string>")

    def step(items: Column, line: Column) -> Column:
        # An item is open while the last one is non-empty (an empty item
        # swallows nothing, as in the reference).
        opened = (F.size(items) > 0) & (F.element_at(items, -1) != "")
        return (
            F.when(starts_item(line),
                   F.array_append(items, strip_all(F.regexp_replace(line, r"^[^.]*\.", ""))))
            .when(opened & (line != ""),
                  F.array_append(F.slice(items, 1, F.size(items) - 1),
                                 F.concat(F.element_at(items, -1), F.lit(" "), line)))
            .otherwise(items)
        )

    folded = F.aggregate(lines, empty, step)
    return F.filter(F.transform(folded, lambda x: strip_all(x)), lambda x: x != "")


def pad_variations(items: str | Column, seed: str | Column, n: int | Column) -> Column:
    """Pad parsed items to n with the reference's rule, then cut to n.

    Empty list -> [seed]; further items derive from the first one: add '!' if
    it has none, else swap '!' for '?' if it has no '?', else add a rocket.
    The padded items are all equal, so one ``array_repeat`` suffices.
    """
    n_col = n if isinstance(n, Column) else F.lit(n)
    base0 = F.when(F.size(_c(items)) == 0, F.array(_c(seed))).otherwise(_c(items))
    first = F.element_at(base0, 1)
    pad = (F.when(~first.contains("!"), F.concat(first, F.lit("!")))
           .when(~first.contains("?"), F.regexp_replace(first, "!", "?"))
           .otherwise(F.concat(first, F.lit(" " + ROCKET))))
    missing = F.greatest(n_col - F.size(base0), F.lit(0))
    padded = F.concat(base0, F.array_repeat(pad, missing))
    return F.slice(padded, 1, n_col)


def error_variations(seed: str | Column, n: int | Column) -> Column:
    """The fixed five rewrites used when candidate generation fails."""
    s = _c(seed)
    n_col = n if isinstance(n, Column) else F.lit(n)
    basic = F.array(s, F.concat(s, F.lit("!")), F.concat(s, F.lit(" " + ROCKET)),
                    F.concat(s, F.lit("?")), F.concat(s, F.lit(" " + SPARKLES)))
    return F.slice(basic, 1, n_col)


def text_features(text: str | Column) -> dict[str, Column]:
    """The S1-S3 feature columns for one text column (zeros for null text)."""
    t = _c(text)
    return {
        "text_length": text_length(t),
        "word_count": word_count(t),
        "hashtag_count": hashtag_count(t),
        "mention_count": mention_count(t),
        "emoji_count": emoji_count(t),
        "flesch_reading_ease": F.when(t.isNull(), F.lit(0.0)).otherwise(flesch_reading_ease(t)),
    }
