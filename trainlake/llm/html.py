"""Main text of web pages, with wrappers inferred from the pages of each host.

A wrapper is a union-free regular expression over tags and texts: a sequence of tags, constant
texts, text slots, optional groups ``(...)?`` and repeated groups ``(...)+``. It starts as the
first page's token stream, in which neighbouring equal runs become repeated groups. Every further
page is aligned with it: where texts differ, the text becomes a slot; a run that one side repeats
is a repeated group in both; what only one side has becomes an optional group.
"""

from __future__ import annotations

import hashlib
import html as entities
import json
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trainlake.llm.common import col, ship_by_value, shuffle_partitions, slices, written

ship_by_value(__name__)

# Names of HTML elements by what they do.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe xmp".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
DROPPED = frozenset("script style textarea title noscript template iframe xmp head nav aside form footer menu button select option dialog svg canvas object audio video".split())
MAIN = frozenset(["article", "main"])
#: Elements whose id is the name of a passage and says nothing of what they are.
NAMED = frozenset("h1 h2 h3 h4 h5 h6 p li dt dd blockquote pre table caption tr td th figure".split())
# Names in class, id and role that mark what is not the article.
BOILERPLATE = frozenset(
    "nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar side aside footer banner masthead ad ads advert adverts advertisement "
    "advertising sponsor sponsored sponsors promo promotion cookie cookies consent notice notices alert popup modal overlay comment comments "
    "disqus replies reply respond share sharing social related newsletter subscribe subscription signup login pagination pager toolbar widget "
    "contentinfo complementary search skip".split()
)

OUTSIDE = BOILERPLATE | {"header"}
#: What such a name may be joined with to a name that means the same: where or how it is shown.
JOINED = frozenset("header main site page top bottom left right primary secondary global list links items posts articles buttons form box bar area wrapper container section block".split())
PARTS = re.compile(r"[-_\d]+")

#: How an element is dropped: not at all, by a form around it, by a name, or by what it is.
KEPT, FORM, NAMED_SO, ELEMENT = range(4)

TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^"'>]|"[^"]*"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|[^<]+|<""",
    re.S,
)
ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|/|$)|display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.I)
SPACE = re.compile(r"\s+")


class Element:
    """An open element: its name and class for paths, and what holds for all inside it: how it is
    dropped, in an article element from there on, and by a name around that article element."""

    __slots__ = ("around", "dropped", "inside", "link", "name", "path")

    def __init__(self, name: str, path: str, dropped: int, inside: bool, link: bool = False, around: bool = False):
        self.name, self.path, self.dropped, self.inside, self.link, self.around = name, path, dropped, inside, link, around


def is_boilerplate(mark: str, names: frozenset[str]) -> bool:
    """Whether a whole name of a class, id or role means boilerplate: ``sidebar``, ``left-sidebar``,
    ``cookie-notice`` and ``related-posts`` do, ``has-sidebar`` and ``share-price`` do not."""
    if mark in names:
        return True
    parts = [p for p in PARTS.split(mark) if p]
    return not names.isdisjoint(parts) and all(p in names or p in JOINED for p in parts)


def opened(name: str, attributes: str, parent: Element) -> Element:
    found = [(k.lower(), v.strip("\"'").lower()) for k, v in ATTRIBUTE.findall(attributes)] if attributes else []
    label = name + "".join(f".{v}" for _, v in found[:1])
    inside, around, dropped = parent.inside or name in MAIN, parent.around, parent.dropped
    if name in MAIN and dropped in (FORM, NAMED_SO) and (name == "article" or not parent.inside):
        around, dropped = around or dropped == NAMED_SO, KEPT
    if name == "form":
        dropped = max(dropped, FORM)
    elif name in DROPPED or (name == "header" and not parent.inside) or (attributes and HIDDEN.search(attributes)):
        dropped = ELEMENT
    if found and name not in ("html", "body", *MAIN):
        names = BOILERPLATE if parent.inside else OUTSIDE
        if any(is_boilerplate(m, names) for k, v in found if k != "id" or name not in NAMED for m in v.split()):
            dropped = max(dropped, NAMED_SO)
    path = parent.path if label in INLINE else f"{parent.path}/{label}"
    return Element(name, path, dropped, inside, parent.link or name == "a", around)


def events(page: str) -> Iterator[tuple[str, str, Element]]:
    """The page as ``("open" | "close" | "break", name, element)`` and ``("text", text, element)``,
    with elements closed as HTML closes them where end tags are missing."""
    stack = [Element("", "", KEPT, False)]
    at, size = 0, len(page)
    while at < size:
        m = TOKEN.match(page, at)
        at = m.end()
        closing, name, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not name:
            text = m[0]
            if text[0] != "<" or text == "<":
                yield "text", text, stack[-1]
            elif text.startswith("<![CDATA["):
                yield "text", entities.escape(text[9:].removesuffix("]]>")), stack[-1]
            continue
        name = name.lower()
        if closing:
            depth = next((k for k in range(len(stack) - 1, 0, -1) if stack[k].name == name), 0)
            if depth:
                for element in reversed(stack[depth:]):
                    yield "close", element.name, element
                del stack[depth:]
            elif name in ("p", "br"):
                yield "break", name, stack[-1]
            continue
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            at = end.end() if end else size
            continue
        if name in VOID:
            if name in ("br", "hr"):
                yield "break", name, stack[-1]
            continue
        implied = ("p",) if name not in INLINE else ()
        implied += {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th")}.get(name, ())
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].name in implied:
                for element in reversed(stack[k:]):
                    yield "close", element.name, element
                del stack[k:]
                break
            if stack[k].name not in INLINE and stack[k].name not in implied:
                break
        element = opened(name, attributes, stack[-1])
        if attributes and attributes.endswith("/") and name not in INLINE and "=" not in attributes[-2:]:
            yield "break", name, stack[-1]
            continue
        stack.append(element)
        yield "open", name, element
    for element in reversed(stack[1:]):
        yield "close", element.name, element


def blocks(page: str) -> Iterator[list[tuple[str, Element]]]:
    """The texts of each block of the page, in order, with their elements."""
    block: list[tuple[str, Element]] = []
    for kind, value, element in events(page):
        if kind == "text":
            block.append((entities.unescape(value), element))
        elif value not in INLINE and block:
            yield block
            block = []
    if block:
        yield block


def tidy(text: str) -> str:
    return SPACE.sub(" ", text).strip()


def mark(text: str) -> str:
    """What stands for a text in a wrapper: itself, or a digest of a long one."""
    return text if len(text) <= 120 else "sha1:" + hashlib.sha1(text.encode("utf-8", "surrogatepass")).hexdigest()


# A token is a list: ["t", tag], ["x", path, text or None for a slot, inside, outside, pages],
# ["+", *tokens] or ["?", *tokens]. Of a text, inside and outside are the characters that pages have
# there within and outside an article element, links and what is no content by its element left out;
# pages are digests of up to SUPPORT different pages that have it. A wrapper of many varied pages ends
# in ["b", {path: [text, inside, outside, pages]}]: the texts of optional groups by their paths.

#: A wrapper with more tokens keeps its optional groups as a bag of texts: their order, which no
#: decision needs, is given up; texts, sizes and pages are not.
LONGEST_WRAPPER = 4096
#: Cells of an alignment's table that are held at a time. Longer sequences are halved, and come to a
#: common subsequence of the same length.
CELLS = 1 << 21

#: So many pages that differ elsewhere must have a text before it is the host's template.
SUPPORT = 2
#: Headings that pages share stay: they head what differs.
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())


def shape(token: list) -> tuple:
    """A token without its texts; tokens of one shape can be merged."""
    if token[0] in "tx":
        return (token[0], token[1])
    return (token[0], *map(shape, token[1:]))


def texts_in(tokens: list[list]) -> Iterator[list]:
    """The text tokens of a wrapper, groups and bag included."""
    for t in tokens:
        if t[0] == "x":
            yield t
        elif t[0] in "+?":
            yield from texts_in(t[1:])
        elif t[0] == "b":
            yield from (["x", path, *figures] for path, figures in t[1].items())


def bagged(texts: Iterator[list]) -> list[list]:
    """Texts by their paths as a bag; no bag without texts."""
    bag: dict[str, list] = {}
    for t in texts:
        known = bag.get(t[1])
        bag[t[1]] = (merged(["x", t[1], *known], t) if known else t)[2:]
    return [["b", bag]] if bag else []


def tokens_in(tokens: list[list]) -> int:
    return sum(1 + tokens_in(t[1:]) if t[0] in "+?" else 1 for t in tokens)


def bounded(tokens: list[list]) -> list[list]:
    """The wrapper, and once it is too long, with its optional groups in the bag."""
    if tokens_in(tokens) <= LONGEST_WRAPPER:
        return tokens
    kept = [t for t in tokens if t[0] not in "?b"]
    return kept + bagged(texts_in([t for t in tokens if t[0] in "?b"]))


def common(x: np.ndarray, y: np.ndarray) -> list[tuple[int, int]]:
    """Places ``(i, j)`` of a longest common subsequence of two sequences of numbers, in memory that
    does not grow with their product."""
    n, m = len(x), len(y)
    if not n or not m:
        return []
    if n * m > CELLS and n > 1:
        half = n // 2
        ahead, behind = lengths(x[:half], y), lengths(x[half:][::-1], y[::-1])[::-1]
        cut = int((ahead + behind).argmax())
        return common(x[:half], y[:cut]) + [(i + half, j + cut) for i, j in common(x[half:], y[cut:])]
    best = np.zeros((n + 1, m + 1), np.int32)
    for i in range(n - 1, -1, -1):
        row = best[i + 1].copy()
        same = y == x[i]
        row[:-1][same] = best[i + 1, 1:][same] + 1
        best[i] = np.maximum.accumulate(row[::-1])[::-1]
    out, i, j = [], 0, 0
    while i < n and j < m:
        if x[i] == y[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif best[i + 1, j] >= best[i, j + 1]:
            i += 1
        else:
            j += 1
    return out


def lengths(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """For each beginning of ``y``, the length of a longest common subsequence with ``x``."""
    row = np.zeros(len(y) + 1, np.int32)
    for value in x.tolist():
        after = row.copy()
        same = y == value
        after[1:][same] = row[:-1][same] + 1
        row = np.maximum.accumulate(after)
    return row


def merged(a: list, b: list) -> list:
    """Two tokens of one shape; texts that differ make a slot."""
    if a[0] == "t":
        return a
    if a[0] == "x":
        return ["x", a[1], a[2] if a[2] == b[2] else None, a[3] + b[3], a[4] + b[4], sorted({*a[5], *b[5]})[:SUPPORT]]
    return [a[0], *(merged(x, y) for x, y in zip(a[1:], b[1:], strict=True))]


def folded(tokens: list[list], longest: int = 16) -> list[list]:
    """Neighbouring runs of equal shape, up to ``longest`` tokens each, as repeated groups;
    short runs first, so that lists in lists are found from the inside."""
    for size in range(1, longest + 1):
        shapes = [shape(t) for t in tokens]
        out, k = [], 0
        while k < len(tokens):
            run = shapes[k : k + size]
            if len(run) == size and shapes[k + size : k + 2 * size] == run and not (size == 1 and run[0][0] == "+"):
                group = tokens[k : k + size]
                k += size
                while shapes[k : k + size] == run:
                    group = [merged(x, y) for x, y in zip(group, tokens[k : k + size], strict=True)]
                    k += size
                out.append(["+", *group])
            else:
                out.append(tokens[k])
                k += 1
        tokens = out
    return tokens


def adopted(tokens: list[list], other: list[list]) -> list[list]:
    """``tokens`` with the runs that ``other`` holds as a group made such a group as well."""
    groups = {shape(t): t for t in other if t[0] in "+?"}
    for form in sorted(groups, key=lambda f: (len(f), str(f)), reverse=True):
        run, size = form[1:], len(form) - 1
        shapes = [shape(t) for t in tokens]
        out, k = [], 0
        while k < len(tokens):
            if tuple(shapes[k : k + size]) == run:
                group = tokens[k : k + size]
                k += size
                while form[0] == "+" and tuple(shapes[k : k + size]) == run:
                    group = [merged(x, y) for x, y in zip(group, tokens[k : k + size], strict=True)]
                    k += size
                out.append([form[0], *group])
            else:
                out.append(tokens[k])
                k += 1
        tokens = out
    return tokens


def optional(run: list[list]) -> list[list]:
    """A run that only one side has: what is not optional in it yet becomes one group."""
    out, plain = [], []
    for token in run:
        if token[0] == "?":
            out += [["?", *plain], token] if plain else [token]
            plain = []
        else:
            plain.append(token)
    return [*out, ["?", *plain]] if plain else out


def aligned(a: list[list], b: list[list]) -> list[list]:
    """The wrapper of both: common tokens merged along a longest common subsequence."""
    bags = bagged(texts_in([t for t in (*a, *b) if t[0] == "b"]))
    a, b = [t for t in a if t[0] != "b"], [t for t in b if t[0] != "b"]
    a, b = adopted(a, b), adopted(b, a)
    x, y = [shape(t) for t in a], [shape(t) for t in b]
    lo = 0
    while lo < min(len(x), len(y)) and x[lo] == y[lo]:
        lo += 1
    hi = 0
    while hi < min(len(x), len(y)) - lo and x[-1 - hi] == y[-1 - hi]:
        hi += 1
    n, m = len(x) - lo - hi, len(y) - lo - hi
    number: dict[tuple, int] = {}
    coded = [np.array([number.setdefault(s, len(number)) for s in side], np.int64) for side in (x[lo : lo + n], y[lo : lo + m])]
    out = [merged(s, t) for s, t in zip(a[:lo], b[:lo], strict=True)]
    i = j = 0
    for p, q in [*common(*coded), (n, m)]:
        out += [*optional(a[lo + i : lo + p]), *optional(b[lo + j : lo + q])]
        if p < n:
            out.append(merged(a[lo + p], b[lo + q]))
        i, j = p + 1, q + 1
    out += [merged(s, t) for s, t in zip(a[len(a) - hi :], b[len(b) - hi :], strict=True)]
    return bounded(out + bags)


def stream(page: str) -> list[list]:
    """The token stream of a page with its repeated groups; formatting is left out, and texts
    that only formatting separates are one slot. Pages are told apart by their content, so that
    copies with another menu or footer are copies."""
    tokens: list[list] = []
    pages: list[str] = []
    content = hashlib.sha1()
    for kind, value, element in events(page):
        if kind == "text":
            text = tidy(entities.unescape(value))
            if not text:
                continue
            size = 0 if element.dropped or element.around or element.link else len(text)
            if size:
                content.update(f"{element.path} {text}\n".encode("utf-8", "surrogatepass"))
            token = ["x", element.path, mark(text), size * element.inside, size * (not element.inside), pages]
            if tokens and tokens[-1][0] == "x" and tokens[-1][1] == element.path:
                last = tokens[-1]
                tokens[-1] = ["x", element.path, None, last[3] + token[3], last[4] + token[4], pages]
            else:
                tokens.append(token)
        elif value not in INLINE and kind != "break":
            tokens.append(["t", f"{'/' if kind == 'close' else ''}{element.path.rpartition('/')[2]}"])
    pages.append(content.hexdigest()[:16])
    return folded(tokens)


def expression(tokens: list[list]) -> str:
    """A wrapper as the text of its regular expression."""
    out = []
    for t in tokens:
        if t[0] == "t":
            out.append(f"<{t[1]}>")
        elif t[0] == "x":
            out.append("#" if t[2] is None else re.escape(t[2]))
        elif t[0] == "b":
            texts = sorted("#" if text is None else re.escape(text) for text, *_ in t[1].values())
            out.append(f"({'|'.join(dict.fromkeys(texts))})*")
        else:
            out.append(f"({expression(t[1:])}){t[0]}")
    return "".join(out)


def path_texts(tokens: list[list]) -> dict[str, tuple[str | None, frozenset[str]]]:
    """The constant text of each path of a wrapper, None where any place of it is a slot, and the
    pages that have the path."""
    found: dict[str, tuple[str | None, frozenset[str]]] = {}
    for _, path, text, _, _, pages in texts_in(tokens):
        before, others = found.get(path, (text, frozenset()))
        found[path] = (text if before == text else None, others | frozenset(pages))
    return found


def template_texts(tokens: list[list]) -> dict[str, str | None]:
    """The constant text of each path of a wrapper; None where any place of it is a slot."""
    return {path: text for path, (text, _) in path_texts(tokens).items()}


def removable(tokens: list[list]) -> dict[str, str | None]:
    """The constant texts that ``SUPPORT`` different pages have and that are no headings."""
    return {path: text for path, (text, pages) in path_texts(tokens).items() if len(pages) >= SUPPORT and path.rpartition("/")[2].partition(".")[0] not in HEADINGS}


def in_articles(tokens: list[list]) -> bool:
    """Whether the article elements hold most of what differs between the pages of a wrapper.
    Where nothing differs, they are believed."""
    texts = path_texts(tokens)
    differing = {path for path, (text, pages) in texts.items() if text is None and len(pages) >= SUPPORT}
    return sum(t[3] - t[4] for t in texts_in(tokens) if t[1] in differing) >= 0


def main_text(page: str, constants: dict[str, str | None], articles: bool = True) -> str:
    """The blocks of the page without texts that are the host's template; with ``articles``, only
    those of the article elements, where the page has them with text. A template text that is
    longer than all that would be left of the page stays: it is what the page is about.

    An article element in one that is dropped by its name counts where the page has no other text
    in articles, one in a form always; and if all else of a page is in a form, so is its text."""
    all_blocks = list(blocks(page))

    def is_template(text: str, e: Element) -> bool:
        constant = constants.get(e.path)
        return constant is not None and constant == mark(tidy(text))

    choices: list[Callable[[Element], bool]] = [
        lambda e: e.inside and not e.around and not e.dropped,
        lambda e: e.inside and not e.dropped,
        lambda e: not e.around and not e.dropped,
        lambda e: e.dropped <= FORM,
    ]
    own = [(tidy(t), e) for b in all_blocks for t, e in b if e.dropped <= FORM and not is_template(t, e)]
    chosen = next((c for c in choices[0 if articles else 2 :] if any(t and c(e) for t, e in own)), choices[-1])
    left = sum(len(t) for t, e in own if chosen(e))
    kept = []
    for block in all_blocks:
        texts = [t for t, e in block if chosen(e) and not (is_template(t, e) and len(tidy(t)) <= left)]
        text = tidy("".join(texts))
        if text:
            kept.append(text)
    return " ".join(kept)


WRAPPERS = "host string, wrapper string, n_pages long"
HOSTS_HELD = 2000


def merge_rows(rows: Iterator[tuple[str, list[list], int]]) -> Iterator[pa.RecordBatch]:
    """Wrappers of hosts merged as they come; some hosts are held at a time."""
    held: dict[str, tuple[list[list], int]] = {}

    def flushed() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays(
            [pa.array(list(held), pa.string()), pa.array([json.dumps(w) for w, _ in held.values()], pa.string()), pa.array([n for _, n in held.values()], pa.int64())],
            names=["host", "wrapper", "n_pages"],
        )
        held.clear()
        return batch

    for host, tokens, n in rows:
        if host in held:
            before, m = held[host]
            held[host] = (aligned(before, tokens), m + n)
        else:
            if len(held) >= HOSTS_HELD:
                yield flushed()
            held[host] = (tokens, n)
    if held:
        yield flushed()


def host_of(url):
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][\w+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1)), F.lit(""))


def infer_wrappers(pages: DataFrame, url_col: str = "url", html_col: str = "html", salts: int = 32) -> DataFrame:
    """``host, wrapper, n_pages``: one wrapper for each host, from all its pages.

    Each task aligns the pages it has; then the tasks' wrappers are aligned within (host, salt),
    and then those of the salts. Wrappers stream by, so that a host with most of the pages costs
    no task more than its running wrapper. Pages without a host form one; pages without tokens
    count but add nothing."""
    rows = pages.select(host_of(col(url_col)).alias("host"), F.coalesce(col(html_col), F.lit("")).alias("html"))

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def streams():
            for part in slices(batches, "html"):
                yield from ((host, stream(page), 1) for host, page in zip(part.column("host").to_pylist(), part.column("html").to_pylist(), strict=True))

        yield from merge_rows(streams())

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from merge_rows((r["host"], json.loads(r["wrapper"]), r["n_pages"]) for b in batches for r in b.to_pylist())

    n = shuffle_partitions(pages.sparkSession)
    found = rows.mapInArrow(local, WRAPPERS).withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(salts)))
    salted = found.repartition(n, "host", "salt").sortWithinPartitions("host", "salt", "wrapper")
    some = salted.select("host", "wrapper", "n_pages").mapInArrow(again, WRAPPERS)
    return some.repartition(n, "host").sortWithinPartitions("host", "wrapper").mapInArrow(again, WRAPPERS)


def decisions(wrappers: DataFrame) -> DataFrame:
    """``host, decision``: what a wrapper says about the pages of its host, the constant texts that go
    and whether the article elements are the content. Only this goes to the pages."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            said = [json.dumps([{p: t for p, t in removable(w).items() if t is not None}, in_articles(w)]) for w in map(json.loads, batch.column("wrapper").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array(said, pa.string())], names=["host", "decision"])

    return wrappers.select("host", "wrapper").mapInArrow(task, "host string, decision string")


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: ``page_id, url, text, n_chars``.

    The wrapper of the page's host, where several different pages made it, decides: constant texts
    that two pages with different content share go, also those in an article element, but for
    headings and what is longer than the rest of the page; and the article (or main) elements are
    the content if they hold most of the text that differs between the pages. If not, or on a page
    without one, the whole body is. One page, or copies of one, say nothing; there the article
    elements are the content, and nothing is template. Menus,
    headers, footers, sidebars, notices, adverts, forms and comments go in any case. References
    are decoded, white space in a block becomes one blank, blocks are joined by one blank. A
    null or empty page gives an empty text; repeated rows and rows without an id or address are
    answered each; an empty table gives no rows; other columns are ignored.
    """
    said = written(decisions(infer_wrappers(pages, url_col, html_col)), "wrappers")
    rows = pages.select(col(id_col).alias("page_id"), col(url_col).alias("url"), host_of(col(url_col)).alias("host"), F.coalesce(col(html_col), F.lit("")).alias("html"))
    placed = rows.join(said, "host").select("page_id", "url", "host", "html", "decision")
    fields = f"page_id {dict(placed.dtypes)['page_id']}, url string, text string, n_chars long"

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        host, constants, articles = None, {}, True
        for part in slices(batches, "html"):
            texts = []
            for k, (own, page) in enumerate(zip(part.column("host").to_pylist(), part.column("html").to_pylist(), strict=True)):
                if own != host:
                    host, (constants, articles) = own, json.loads(part.column("decision")[k].as_py())
                texts.append(main_text(page, constants, articles))
            yield pa.RecordBatch.from_arrays([part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return placed.mapInArrow(task, fields)
