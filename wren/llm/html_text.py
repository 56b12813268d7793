"""Main text of web pages (operator 2).

A page is cut into blocks, and its markup says of each whether it is the article,
something around it (menu, header, footer, sidebar, notice, advert, form,
comments), or neither.  Then the pages of a host are compared: their token
streams are concatenated, a suffix array over the first ``RUN`` tokens finds the
substrings that distinct pages share, and a block that such runs cover is
boilerplate.  Blocks that the markup leaves open are kept or removed by that.
Where the markup names the article it has the last word, because articles share
passages and adverts don't (README, "HTML extraction").

Pages of a host are dealt to parts of bounded size, so a host with a third of all
pages is many tasks.  The parts of a host find their common runs by 64-bit hashes
of the windows of ``RUN`` tokens: first by short fingerprints, which say which
windows other parts may have too, then by whole hashes of these, with the pages
that have them.
"""

from __future__ import annotations

import html
import json
import re
import struct
import zlib
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .frames import broadcast_if_small, map_text

#: Tokens that a shared substring has at least, and the share of a block that makes it boilerplate.
RUN, COVERED = 6, 0.5
#: Bytes of HTML of one host that are compared in one task, and hosts with more than that which are broadcast at most.
GROUP_BYTES, MAX_BROADCAST_HOSTS = 4_000_000, 200_000
#: Bits of a fingerprint besides those that count parts (a part has some 2**19 windows), and parts whose windows one task compares.
PRINT_BITS, TASK_PARTS = 25, 4
#: Share of a block's characters inside links from which an open block counts as a menu.
MENU_SHARE = 0.6

ARTICLE, OPEN, AROUND = 0, 1, 2

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template textarea iframe noembed noframes xmp title object".split())
BLOCK = frozenset("""address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption
figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table
tbody td tfoot th thead tr ul""".split())
AROUND_TAGS = frozenset("nav footer aside form button select dialog menu noscript svg canvas audio video head map".split())
#: Words of a class or id, or values of the role attribute, that name something around the article.
AROUND_WORDS = frozenset("""ad ads adv advert adverts advertisement advertising sponsor sponsored promo promoted promotion
banner nav navbar navigation menu menubar header masthead topbar footer bottombar sidebar aside rail widget widgets
cookie cookies consent gdpr notice notices notification popup modal overlay newsletter subscribe subscription signup
login search searchbox share sharing social breadcrumb breadcrumbs pagination pager comment comments commentlist
disqus reply replies respond related recommended recommendations toolbar skip copyright disclaimer hidden
contentinfo complementary alertdialog""".split())
ARTICLE_NAMES = frozenset("""article main content maincontent articlebody articlecontent post postcontent postbody entry
entrycontent entrybody story storybody storycontent pagecontent textcontent bodytext""".split())

TAG = re.compile(r"""<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)([^<>"']*+(?:(?:"[^"<]*+"|'[^'<]*+')[^<>"']*+)*+)>""")
ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
RAW_END = {tag: re.compile("</" + tag, re.IGNORECASE | re.ASCII) for tag in RAW}


@lru_cache(maxsize=8192)
def _role(tag: str, attributes: str, in_article: bool) -> int | None:
    """What an element is to the article; None if it says nothing.  Pages of a site repeat their tags, so answers are kept."""
    found = None
    if tag in AROUND_TAGS or tag == "header" and not in_article:
        return AROUND
    if tag in ("article", "main"):
        found = ARTICLE
    if attributes and tag not in ("html", "body"):
        for name, *values in ATTRIBUTE.findall(attributes):
            name, value = name.lower(), "".join(values)
            if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
                return AROUND
            if name == "style" and re.search(r"display\s*:\s*none", value, re.IGNORECASE):
                return AROUND
            if name in ("class", "id", "role"):
                words = {w.lower() for w in WORDS.findall(value)}
                if words & AROUND_WORDS and not (in_article and words & AROUND_WORDS <= {"header"}):
                    return AROUND
                if any(re.sub("[^a-z]", "", w.lower()) in ARTICLE_NAMES for w in value.split()):
                    found = ARTICLE
            elif name == "itemprop" and value.lower() == "articlebody":
                found = ARTICLE
    return found


def blocks_of(page: str | None) -> list[tuple[int, str]]:
    """``(role, text)`` of the blocks of a page in order, white space and references resolved, empty ones left out."""
    page = page or ""
    out: list[tuple[int, str]] = []
    stack: list[tuple[str, int | None]] = []
    around = article = links = 0
    buffer: list[str] = []
    role = OPEN
    link_chars = 0

    def flush() -> None:
        nonlocal link_chars, role
        if buffer:
            text = " ".join("".join(buffer).split())
            if text:
                menu = role == OPEN and link_chars >= MENU_SHARE * len(text)
                out.append((AROUND if menu else role, text))
            buffer.clear()
        link_chars = 0

    def add(a: int, z: int) -> None:
        nonlocal role, link_chars
        if a < z:
            text = page[a:z]
            if "&" in text:
                text = html.unescape(text)
            now = AROUND if around else ARTICLE if article else OPEN
            if buffer and now != role:
                if now == AROUND and stack and stack[-1][0] not in BLOCK:
                    return  # an inline element that is no part of the paragraph around it
                flush()
            if not buffer:
                role = now
            buffer.append(text)
            if links:
                link_chars += len(text.strip())

    def pop() -> None:
        nonlocal around, article, links
        tag, r = stack.pop()
        around -= r == AROUND
        article -= r == ARTICLE
        links -= tag == "a"

    at, n = 0, len(page)
    closes = True  # whether a '>' is still ahead
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            add(at, n)
            break
        add(at, lt)
        m = TAG.match(page, lt)
        if not m:
            nxt = page[lt + 1:lt + 2]
            if page.startswith("<!--", lt):
                end = page.find("-->", lt + 4)
                at = n if end < 0 else end + 3
            elif nxt and (nxt in "!?/" or nxt.isascii() and nxt.isalpha()) and closes:
                end = page.find(">", lt)
                closes = end >= 0
                if closes:
                    at = end + 1
                else:
                    add(lt, lt + 1)
                    at = lt + 1
            else:
                add(lt, lt + 1)
                at = lt + 1
            continue
        at = m.end()
        close, tag, attributes = m[1], m[2].lower(), m[3]
        if close:
            block = tag in BLOCK
            if block:
                flush()
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    while len(stack) > i:
                        pop()
                    break
                if not block and stack[i][0] in BLOCK or tag == "p" and stack[i][0] in ("div", "article", "section", "body"):
                    break
            continue
        if tag in RAW:
            if not attributes.endswith("/"):
                end = RAW_END[tag].search(page, at)
                gt = page.find(">", end.start()) if end else -1
                at = n if gt < 0 else gt + 1
            continue
        if tag == "br":
            if buffer:
                buffer.append(" ")
            continue
        if tag in BLOCK:
            flush()
            if tag == "li" or tag == "p" or stack and stack[-1][0] == "p":
                want = "li" if tag == "li" else "p"
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == want:
                        while len(stack) > i:
                            pop()
                        break
                    if stack[i][0] in BLOCK:
                        break
        if tag in VOID or attributes.endswith("/"):
            continue
        r = _role(tag, attributes, article > 0)
        stack.append((tag, r))
        around += r == AROUND
        article += r == ARTICLE
        links += tag == "a"
    flush()
    return out


def covered_shares(pages: list[list[str]], run: int = RUN) -> list[np.ndarray]:
    """For each page the share of each of its blocks that lies in token runs found on other pages too.

    The streams are concatenated with a mark of its own after each page.  Ranks
    of windows of 1, 2, 4 ... tokens are doubled up to ``run`` tokens; sorted by
    rank they are the suffix array as far as it is needed, and neighbours of one
    rank share a substring of ``run`` tokens or more.  Pages with the same text
    count as one page.
    """
    same: dict[str, int] = {}
    who = [same.setdefault("\n\n".join(p), len(same)) for p in pages]
    number: dict[str, int] = {}
    tokens: list[int] = []
    block_of: list[int] = []
    page_of: list[int] = []
    n_blocks = 0
    for k, blocks in enumerate(pages):
        for b in blocks:
            own = [number.setdefault(t, len(number)) for t in b.split()]
            tokens += own
            block_of += [n_blocks] * len(own)
            page_of += [who[k]] * len(own)
            n_blocks += 1
        tokens.append(-k - 1)
        block_of.append(-1)
        page_of.append(who[k])
    stream = np.array(tokens, dtype=np.int64)
    block, page = np.array(block_of, dtype=np.int64), np.array(page_of, dtype=np.int64)
    share = np.zeros(n_blocks)
    if len(stream) > run:
        _, rank = np.unique(stream, return_inverse=True)
        have = 1
        while have < run:
            step = min(have, run - have)
            pair = rank[:-step].astype(np.int64) * len(stream) + rank[step:]
            _, rank = np.unique(pair, return_inverse=True)
            have += step
        order = np.argsort(rank, kind="stable")  # the suffix array
        ranks, owners = rank[order], page[:len(rank)][order]
        first = np.flatnonzero(np.r_[True, ranks[1:] != ranks[:-1]])
        shared = np.minimum.reduceat(owners, first) != np.maximum.reduceat(owners, first)
        starts = order[np.repeat(shared, np.diff(np.r_[first, len(ranks)]))]
        edge = np.zeros(len(stream) + 1, dtype=np.int64)
        np.add.at(edge, starts, 1)
        np.add.at(edge, starts + run, -1)
        inside = np.cumsum(edge[:-1]) > 0
        real = block >= 0
        total = np.bincount(block[real], minlength=n_blocks)
        share = np.bincount(block[real & inside], minlength=n_blocks) / np.maximum(total, 1)
    ends = np.cumsum([len(p) for p in pages])
    return [share[e - len(p):e] for p, e in zip(pages, ends)]


class Windows:
    """Hashes of the windows of ``run`` tokens of some pages of a host, none across two pages."""

    def __init__(self, pages: list[list[str]], run: int = RUN):
        words = [b.split() for p in pages for b in p]
        number = {t: xxhash.xxh3_64_intdigest(t.encode("utf-8", "surrogatepass")) for t in set(chain.from_iterable(words))}
        self.run, self.lengths, self.n_blocks = run, np.array([len(w) for w in words], dtype=np.int64), [len(p) for p in pages]
        n = int(self.lengths.sum())
        tokens = np.fromiter(map(number.__getitem__, chain.from_iterable(words)), np.uint64, n)
        page = np.repeat(np.repeat(np.arange(len(pages)), self.n_blocks), self.lengths)
        last = max(n - run + 1, 0)
        hashes = np.zeros(last, dtype=np.uint64)
        for j in range(run):
            hashes = (hashes ^ tokens[j:j + last]) * np.uint64(0x9E3779B97F4A7C15)
            hashes ^= hashes >> np.uint64(29)
        hashes = hashes * np.uint64(0xBF58476D1CE4E5B9)
        hashes ^= hashes >> np.uint64(32)
        self.starts = np.flatnonzero(page[:last] == page[run - 1:run - 1 + last])
        self.hashes, self.page = hashes[self.starts], page[self.starts]
        self.who = np.array([xxhash.xxh3_64_intdigest("\n\n".join(p).encode("utf-8", "surrogatepass")) for p in pages], dtype=np.uint64)

    def owners(self, chosen=slice(None)) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The distinct hashes in order, and the least and greatest page that has each; copies are one page."""
        return least_and_greatest(self.hashes[chosen], self.who[self.page[chosen]])

    def shares(self, elsewhere: np.ndarray) -> list[np.ndarray]:
        """As ``covered_shares``, where other parts of the host share the windows ``elsewhere`` (hashes in order)."""
        hashes, least, greatest = self.owners()
        shared = member(self.hashes, np.union1d(hashes[least != greatest], elsewhere))
        edge = np.zeros(int(self.lengths.sum()) + 1, dtype=np.int64)
        starts = self.starts[shared]
        edge[starts] += 1
        edge[starts + self.run] -= 1
        inside = np.r_[0, np.cumsum(np.cumsum(edge[:-1]) > 0)]
        ends = np.cumsum(self.lengths)
        share = (inside[ends] - inside[ends - self.lengths]) / np.maximum(self.lengths, 1)
        pages = np.cumsum(self.n_blocks)
        return [share[e - k:e] for e, k in zip(pages, self.n_blocks)]


def least_and_greatest(hashes: np.ndarray, owners: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if not len(hashes):
        return hashes, owners, owners
    order = np.argsort(hashes)
    hashes, owners = hashes[order], owners[order]
    first = np.flatnonzero(np.r_[True, hashes[1:] != hashes[:-1]])
    return hashes[first], np.minimum.reduceat(owners, first), np.maximum.reduceat(owners, first)


def member(values: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Which of ``values`` are in ``among``, which is in order."""
    if not len(among):
        return np.zeros(len(values), dtype=bool)
    return among[np.minimum(np.searchsorted(among, values), len(among) - 1)] == values


def bits(parts: int) -> tuple[int, int]:
    """Of a host in so many parts: the bits of a fingerprint, and its first bits that choose the task."""
    tasks = max(min(parts, 64), -(-parts // TASK_PARTS))
    return min(64, PRINT_BITS + (parts - 1).bit_length()), (tasks - 1).bit_length()


def by_task(ordered: np.ndarray, width: int, first_bits: int):
    """``(task, from, to)`` of the ranges of ``ordered`` (numbers of ``width`` bits) that go to one task."""
    tasks = ordered >> np.uint64(width - first_bits) if first_bits else np.zeros(len(ordered), dtype=np.uint64)
    cuts = np.flatnonzero(np.r_[True, tasks[1:] != tasks[:-1], True]) if len(ordered) else np.zeros(1, dtype=np.int64)
    return [(int(tasks[a]), a, z) for a, z in zip(cuts[:-1], cuts[1:])]


def pack_ordered(ordered: np.ndarray) -> bytes:
    """Distinct numbers in order as the first and the steps, these byte plane by byte plane."""
    steps = np.diff(ordered)
    width = (int(steps.max()).bit_length() + 7) // 8 if len(steps) else 0
    planes = steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()
    return struct.pack("<QB", int(ordered[0]), width) + zlib.compress(planes, 1)


def unpack_ordered(packed: bytes) -> np.ndarray:
    first, width = struct.unpack_from("<QB", packed)
    planes = np.frombuffer(zlib.decompress(packed[9:]), dtype=np.uint8)
    steps = np.zeros((len(planes) // width if width else 0, 8), dtype=np.uint8)
    steps[:, :width] = planes.reshape(width, -1).T if width else 0
    return np.cumsum(np.r_[np.uint64(first), steps.view("<u8").ravel().astype(np.uint64)], dtype=np.uint64)


def _ordered(column) -> np.ndarray:
    """The numbers of all rows of a packed column, each once, in order."""
    found = [unpack_ordered(p) for p in column.to_pylist()]
    return np.unique(np.concatenate(found)) if found else np.zeros(0, dtype=np.uint64)


def main_text(blocks: list[tuple[int, str]], shares) -> str:
    """The article blocks; where the markup names none, the open blocks that shared runs don't cover."""
    kept = [t for r, t in blocks if r == ARTICLE]
    if not kept:
        kept = [t for (r, t), s in zip(blocks, shares) if r == OPEN and s < COVERED]
    return "\n\n".join(kept)


#: Blocks of a page on their way to the task that compares them: text compresses well page by page.
PACKED = T.StructType([T.StructField("packed", T.BinaryType())])


def pack(blocks: list[tuple[int, str]]) -> bytes:
    return zlib.compress(json.dumps(blocks, ensure_ascii=False, separators=(",", ":")).encode("utf-8", "surrogatepass"), 3)


def unpack(packed: bytes) -> list[tuple[int, str]]:
    return json.loads(zlib.decompress(packed).decode("utf-8", "surrogatepass"))


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of ``pages``: ``id_col, url_col, text, n_blocks, n_shared`` (blocks covered by shared runs).

    Null and empty pages have empty text.  Null URLs and those without a host
    form one host.  Repeated rows give a row each; pages that are copies of each
    other don't make each other boilerplate.  Other columns play no part.
    """
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))
    size = F.coalesce(F.octet_length(F.col(html_col)), F.lit(0)).cast("long")
    weights = pages.select(host.alias("host"), size.alias("size")).groupBy("host").agg(F.sum("size").alias("size"))
    large = weights.where(F.col("size") > GROUP_BYTES).select(
        "host", F.ceil(F.col("size") / GROUP_BYTES).cast("int").alias("parts"))
    read = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"), host.alias("host"))

    cut_pages = map_text(read.withColumn("salt", F.xxhash64("id", "url")), "html",
                         lambda texts: [{"packed": pack(blocks_of(t))} for t in texts], PACKED).drop("html")
    dealt = cut_pages.join(broadcast_if_small(large, MAX_BROADCAST_HOSTS), "host", "left").withColumn(
        "parts", F.coalesce("parts", F.lit(1))).withColumn("part", F.pmod("salt", "parts").cast("int")).drop("salt")
    by_part = dealt.groupBy("host", "part")
    marks = shared_elsewhere(by_part)
    fields = {f.name: f.dataType for f in read.schema.fields}
    result = T.StructType([
        T.StructField("id", fields["id"]), T.StructField("url", T.StringType()), T.StructField("text", T.StringType()),
        T.StructField("n_blocks", T.LongType()), T.StructField("n_shared", T.LongType())])
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(result)

    def compare(table, marks):
        found = [unpack(p) for p in table.column("packed").to_pylist()]
        texts = [[t for _, t in f] for f in found]
        if table.column("parts")[0].as_py() == 1:
            shares = covered_shares(texts)
        else:
            shares = Windows(texts).shares(_ordered(marks.column("hashes")))
        return pa.table([
            table.column("id").cast(arrow.field("id").type), table.column("url").cast(pa.string()),
            pa.array([main_text(f, s) for f, s in zip(found, shares)], pa.string()),
            pa.array([len(f) for f in found], pa.int64()),
            pa.array([int((s >= COVERED).sum()) for s in shares], pa.int64())], schema=arrow)

    return by_part.cogroup(marks.groupBy("host", "part")).applyInArrow(compare, result).withColumnsRenamed(
        {"id": id_col, "url": url_col})


def shared_elsewhere(by_part) -> DataFrame:
    """``(host, part, hashes)``: windows of a part that another part of its host has on another page.

    Both rounds read the shuffle of the pages again instead of storing the
    windows.  Copies of a page may lie in several parts, so a window counts if
    its least and greatest page differ.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    def fields(names: str) -> T.StructType:
        kinds = {"host": T.StringType(), "part": T.IntegerType(), "task": T.LongType()}
        return T.StructType([T.StructField(n, kinds.get(n, T.BinaryType())) for n in names.split()])

    rows = {n: fields(n) for n in ("host part task prints", "host part prints", "host part task hashes owners", "host part hashes")}
    arrows = {n: to_arrow_schema(s) for n, s in rows.items()}

    def out(names: str, found: list[tuple]) -> pa.Table:
        return pa.Table.from_pylist([dict(zip(names.split(), r)) for r in found], schema=arrows[names])

    def windows(table) -> Windows:
        return Windows([[t for _, t in unpack(p)] for p in table.column("packed").to_pylist()])

    def ask(key, table):
        host, part = (k.as_py() for k in key)
        parts, found = table.column("parts")[0].as_py(), []
        if parts > 1:
            width, first = bits(parts)
            prints = np.unique(windows(table).hashes >> np.uint64(64 - width))
            found = [(host, part, t, pack_ordered(prints[a:z])) for t, a, z in by_task(prints, width, first)]
        return out("host part task prints", found)

    def meet(key, table):
        host, each = key[0].as_py(), [unpack_ordered(p) for p in table.column("prints").to_pylist()]
        values, times = np.unique(np.concatenate(each), return_counts=True)
        again, found = values[times > 1], []
        for part, own in zip(table.column("part").to_pylist(), each):
            own = own[member(own, again)]
            if len(own):
                found.append((host, part, pack_ordered(own)))
        return out("host part prints", found)

    def tell(key, table, asked):
        host, part = (k.as_py() for k in key)
        parts, found = table.column("parts")[0].as_py(), []
        if parts > 1 and asked.num_rows:
            width, first = bits(parts)
            own = windows(table)
            hashes, least, greatest = own.owners(member(own.hashes >> np.uint64(64 - width), _ordered(asked.column("prints"))))
            owners = np.c_[least, greatest].astype("<u8")
            found = [(host, part, t, pack_ordered(hashes[a:z]), zlib.compress(owners[a:z].tobytes(), 1))
                     for t, a, z in by_task(hashes, 64, first)]
        return out("host part task hashes owners", found)

    def settle(key, table):
        host, each = key[0].as_py(), [unpack_ordered(p) for p in table.column("hashes").to_pylist()]
        owners = [np.frombuffer(zlib.decompress(p), dtype="<u8").reshape(-1, 2) for p in table.column("owners").to_pylist()]
        hashes, least, greatest = least_and_greatest(np.concatenate(each * 2), np.concatenate(
            [o[:, k] for k in (0, 1) for o in owners]).astype(np.uint64))
        shared, found = hashes[least != greatest], []
        for part, own in zip(table.column("part").to_pylist(), each):
            own = own[member(own, shared)]
            if len(own):
                found.append((host, part, pack_ordered(own)))
        return out("host part hashes", found)

    asked = by_part.applyInArrow(ask, rows["host part task prints"])
    met = asked.groupBy("host", "task").applyInArrow(meet, rows["host part prints"])
    told = by_part.cogroup(met.groupBy("host", "part")).applyInArrow(tell, rows["host part task hashes owners"])
    return told.groupBy("host", "task").applyInArrow(settle, rows["host part hashes"])


def page_texts(pages: DataFrame) -> DataFrame:
    return extract_text(pages).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"),
                                      "n_blocks", "n_shared")
