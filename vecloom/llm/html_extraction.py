"""HTML extraction with inferred wrappers.

Pages of a host are made from a few templates. A page's token stream becomes a union-free
regular expression: a tree of elements and text slots in which repeated neighbours fold
into one repeated group. The expressions of a host's pages are aligned one after another;
where they differ, tokens found on one side only become optional, neighbours that repeat
become a group, and differing texts become one slot. The result is the host's *wrapper*.

Aligning is associative in what it keeps, so every task folds its own pages into one
wrapper per host before anything is shuffled, and the partial wrappers of a host are aligned
in their turn: a host of any size costs one small row per task.

A wrapper then says which text is content. The elements around a slot are one hint (article
or main part; not navigation, notices, adverts, forms, comments); the other is whether the
text varies between the host's different pages. Slots of one element path count as one,
because positions among optional neighbours depend on the order of aligning; what stands in
such a slot is told apart by its text instead: a block of text that every page of the host
with that path has, word for word, is template wherever it stands, inside main parts too.
This needs three different pages, and that such blocks hold less than half of the text of the
page with most text: pages that share more than that are versions of one another.
On pages without a marked main part, a slot with the same single text on two pages is template.
"""

from __future__ import annotations

import html
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecloom.llm.packed import arrow_rows, rows_of

#: Elements without an end tag.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that begin and end a block of text.
BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset "
    "figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p "
    "pre section summary table tbody td tfoot th thead title tr ul".split()
)
#: Elements whose content is no markup.
RAW = frozenset("script style textarea noembed noframes xmp".split())
#: Elements whose text is never content.
SKIP = frozenset(
    "aside audio button canvas datalist dialog embed fieldset footer form head iframe input legend map menu nav "
    "noembed noframes noscript object option optgroup script select style svg template textarea title video".split()
)
#: Words in a class, id or role that mark a part that is no content.
SKIP_NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|banner|breadcrumbs?|comments?|comment-?list|consent|cookies?|copyright|"
    r"disclaimer|discuss\w*|disqus\w*|footer|gdpr|masthead|menu|modal|nav|navbar|navigation|newsletter|notice|"
    r"notification|pager|pagination|popup|promo\w*|promoted|recommend\w*|related|replies|responses|search|share|"
    r"sharing|sidebar|side-bar|signup|social|sponsor\w*|subscribe|subscription|tags|toolbar|toc|widget)(?:$|[\s_-])",
    re.I,
)
SKIP_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert".split())
#: Names of the part that holds the content.
MAIN_NAMES = re.compile(
    r"(?:^|[\s_-])(?:article|article-?body|content|main|main-?content|post|post-?body|entry|entry-?content|story|"
    r"story-?body|text)(?:$|[\s_-])",
    re.I,
)
#: A start tag of these ends an open element of the same set.
CLOSES = {
    "li": ("li", ("ul", "ol", "menu", "dir")),
    "dt": ("dt dd", ("dl",)),
    "dd": ("dt dd", ("dl",)),
    "tr": ("tr td th", ("table",)),
    "td": ("td th", ("tr", "table")),
    "th": ("td th", ("tr", "table")),
    "option": ("option", ("select", "datalist")),
}
#: A start tag of these ends an open paragraph.
ENDS_P = BLOCK - {"br", "body", "html", "tr", "td", "th", "tbody", "thead", "tfoot", "caption", "title", "legend"}
INLINE = frozenset("a abbr b bdi bdo big cite code em font i kbd mark q s samp small span strike strong sub sup tt u var".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|"
    r"<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|$)|'[^']*(?:'|$))*)(?:>|$)",
    re.S,
)
_ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_DIGITS = re.compile(r"\d+")


#: Elements inside one another that a page is read with; deeper ones are flattened.
MAX_DEPTH = 200
#: Class and id texts above this length appear in element names as a prefix and a digest.
LONG_NAMES = 80


@lru_cache(50_000)
def element_name(tag: str, attributes: str) -> str:
    """A tag with what its class, id and role say; numbers in them are dropped, so that rows look alike.

    Long class and id texts are shortened to a prefix and a digest of the whole; what the
    whole says of the part ("skip", "main") is the last field.
    """
    if not attributes or "=" not in attributes and "hidden" not in attributes:
        return tag
    found = {m[1].lower(): next((g for g in m.groups()[1:] if g is not None), "") for m in _ATTRIBUTE.finditer(attributes)}
    names = " ".join(_DIGITS.sub("", found.get(k, "")).strip() for k in ("class", "id") if found.get(k))
    names = " ".join(names.replace("|", " ").split())
    role = found.get("role", "").replace("|", " ").strip().lower()
    hidden = "hidden" in found or found.get("aria-hidden", "").lower() == "true"
    if not names and not role and not hidden:
        return tag
    says = " ".join(w for w, of in (("skip", SKIP_NAMES), ("main", MAIN_NAMES)) if names and of.search(names))
    if len(names) > LONG_NAMES:
        names = f"{names[: LONG_NAMES - 17]}~{xxhash.xxh3_64_hexdigest(names.encode('utf-8', 'replace'))}"
    return "|".join((tag, names, role, "hidden" if hidden else "", says))


def tokens(page: str) -> Iterator[tuple[str, str]]:
    """("open", element), ("close", tag), ("void", element) and ("text", raw text), in page order."""
    at, end = 0, len(page)
    while at < end:
        found = _TOKEN.search(page, at)
        if not found:
            yield "text", page[at:]
            return
        if found.start() > at:
            yield "text", page[at : found.start()]
        at = found.end()
        if not found[2]:
            if found[0].startswith("<![CDATA["):
                yield "text", html.escape(found[0][9:].removesuffix("]]>"))
            continue
        tag = found[2].lower()
        if found[1]:
            yield "close", tag
        elif tag in VOID:
            yield "void", tag
        else:
            yield "open", element_name(tag, found[3])
            if tag in RAW:
                stop = re.compile(rf"</{tag}[\s/>]", re.I).search(page, at)
                at = stop.start() if stop else end


def walk(page: str) -> Iterator[tuple[str, tuple[str, ...], str]]:
    """("in" | "out" | "void" | "text", path of open elements, text); open elements are closed as browsers do.

    An element inside MAX_DEPTH others adds no level: its text is the innermost one's, and its ends are those of a
    block if it is one. Only skipped elements still open there, so that their text is left out.
    """
    stack: list[str] = []
    tags: list[str] = []
    flat: list[str] = []

    def pop_to(depth: int) -> Iterator[tuple[str, tuple[str, ...], str]]:
        while len(tags) > depth:
            yield "out", tuple(stack), ""
            stack.pop()
            tags.pop()

    for kind, value in tokens(page):
        if kind == "text":
            yield "text", tuple(stack), value
        elif kind == "void":
            yield "void", (*stack, value), ""
        elif kind == "open":
            tag = value.split("|", 1)[0]
            if tag in ENDS_P and "p" in tags:
                yield from pop_to(len(tags) - 1 - tags[::-1].index("p"))
            if tag in CLOSES:
                ends, within = CLOSES[tag]
                for depth in range(len(tags) - 1, -1, -1):
                    if tags[depth] in within:
                        break
                    if tags[depth] in ends.split():
                        yield from pop_to(depth)
                        break
            if len(tags) < MAX_DEPTH:
                flat.clear()
            elif len(tags) > MAX_DEPTH or not skipped(value, False):
                flat.append(tag)
                yield "void", (*stack, tag), ""
                continue
            stack.append(value)
            tags.append(tag)
            yield "in", tuple(stack), ""
        elif len(tags) >= MAX_DEPTH and value in flat:
            del flat[len(flat) - 1 - flat[::-1].index(value) :]
            yield "void", (*stack, value), ""
        elif value in tags:
            yield from pop_to(len(tags) - 1 - tags[::-1].index(value))
    yield from pop_to(0)


# ---- expressions -------------------------------------------------------------------
#
# An item is [name, flags, items, slot]: an element (or "#" for text), flags "?" optional and
# "+" repeated, the items inside, and for text [pages, low, high] of its values: the least
# digests of up to ENOUGH_PAGES different pages, and the least and greatest digest of a value.
# All three take copies of a page as one, in whatever order and task they come.

#: So many different pages a slot remembers.
ENOUGH_PAGES = 3


def _digest(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "replace")) >> 1


def page_expression(page: str) -> list:
    """The expression of one page: its items, with repeated neighbours folded.

    Pages of equal texts are copies of one another, whatever their scripts and attributes.
    """
    root: list = ["", "", [], None]
    open_items = [root]
    events = list(walk(page))
    pages = [_digest("\n".join(" ".join(text.split()) for kind, _, text in events if kind == "text"))]
    for kind, path, text in events:
        if kind == "in":
            item = [path[-1], "", [], None]
            open_items[-1][2].append(item)
            open_items.append(item)
        elif kind == "out":
            item = open_items.pop()
            item[2] = fold_repeats(item[2])
        elif kind == "void":
            if path[-1] in BLOCK:
                open_items[-1][2].append([path[-1], "", [], None])
        elif words := text.split():
            value = _digest(" ".join(words))
            open_items[-1][2].append(["#", "", [], [pages, value, value]])
    return fold_repeats(root[2])


def _flags(a: str, b: str, more: str = "") -> str:
    return "".join(f for f in "?+" if f in a + b + more)


def _pages(a: list[int], b: list[int]) -> list[int]:
    return a if a == b else sorted({*a, *b})[:ENOUGH_PAGES]


def _slot(a: list | None, b: list | None) -> list | None:
    if a is None or b is None:
        return a or b
    return [_pages(a[0], b[0]), min(a[1], b[1]), max(a[2], b[2])]


def merge(a: list, b: list, more: str = "") -> list:
    """One item that covers two items of the same name."""
    return [a[0], _flags(a[1], b[1], more), align(a[2], b[2]), _slot(a[3], b[3])]


def fold_repeats(items: list) -> list:
    """Neighbours of one name become one repeated item; so do repeats of a pair or triple of names."""
    out: list = []
    for item in items:
        if out and out[-1][0] == item[0]:
            out[-1] = merge(out[-1], item, "+")
        else:
            out.append(item)
    for width in (2, 3):
        at = 0
        while at + 2 * width <= len(out):
            names = [i[0] for i in out[at : at + width]]
            if names == [i[0] for i in out[at + width : at + 2 * width]] and len(set(names)) == width:
                for k in range(width):
                    out[at + k] = merge(out[at + k], out[at + width + k], "+")
                del out[at + width : at + 2 * width]
            else:
                at += 1
    return out


def align(a: list, b: list) -> list:
    """Two item lists as one: a longest common subsequence of names is merged, the rest is optional."""
    if not a and not b:
        return []
    names_a, names_b = [i[0] for i in a], [i[0] for i in b]
    if names_a == names_b:
        return [merge(x, y) for x, y in zip(a, b, strict=True)]
    n, m = len(a), len(b)
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if names_a[i] == names_b[j] else max(best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0
    while i < n or j < m:
        if i < n and j < m and names_a[i] == names_b[j]:
            out.append(merge(a[i], b[j]))
            i, j = i + 1, j + 1
        elif j == m or i < n and best[i + 1][j] >= best[i][j + 1]:
            out.append([a[i][0], _flags(a[i][1], "?"), a[i][2], a[i][3]])
            i += 1
        else:
            out.append([b[j][0], _flags(b[j][1], "?"), b[j][2], b[j][3]])
            j += 1
    return fold_repeats(out)


def shape(items: list) -> str:
    """An expression without its slots' values, as text."""
    return "".join(
        (f"({name}{'<' + shape(inner) + '>' if inner else ''}){flags}" if name != "#" else f"#{flags}")
        for name, flags, inner, _ in items
    )


# ---- blocks that all pages of a host have --------------------------------------------


def page_blocks(page: str, slots: dict[str, frozenset[str]] | None = None) -> tuple[list[tuple[str, str, str, str]], bool]:
    """Blocks of text outside skipped elements, in page order: (zone, path, text, kept); has the page a main part?

    White space inside a block is one space; the path is that of the elements around the
    block's first text; kept is what stands in the ``slots`` of its zone.
    """
    done: list[tuple[str, str, str, str]] = []
    open_blocks: dict[str, list[tuple[str, str]]] = {}
    has_main = False

    def end() -> None:
        for where, parts in open_blocks.items():
            text = " ".join("".join(part for _, part in parts).split())
            kept = text
            if slots and not all(path in slots[where] for path, _ in parts):
                kept = " ".join("".join(part for path, part in parts if path in slots[where]).split())
            if text:
                first = next(path for path, part in parts if part.strip())
                done.append((where, first, text, kept))
        open_blocks.clear()

    for kind, path, text in walk(page):
        if kind == "text":
            if (where := zone(path)) != "skip":
                open_blocks.setdefault(where, []).append(("".join(f">{name}" for name in path), html.unescape(text)))
            continue
        has_main = has_main or kind == "in" and zone(path) == "main"
        if path[-1].split("|", 1)[0] in BLOCK:
            end()
    end()
    return done, has_main


class Common:
    """Per path the blocks that all pages seen have; pages, and the text of the longest one.

    Adding a page twice changes nothing, and the order of pages and of merging does not
    matter, so tasks keep their own and these are merged by host.
    """

    def __init__(self, paths: dict[str, list] | None = None, longest: int = 0):
        #: path: [least digests of up to ENOUGH_PAGES different pages, {digest of a block: its length}]
        self.paths, self.longest = paths or {}, longest

    @classmethod
    def of(cls, page: str) -> Common:
        blocks, _ = page_blocks(page)
        pages = [_digest("\n".join(text for _, _, text, _ in blocks))]
        paths: dict[str, list] = {}
        for _, path, text, _ in blocks:
            paths.setdefault(path, [pages, {}])[1][_digest(text)] = len(text)
        return cls(paths, sum(len(text) for _, _, text, _ in blocks))

    def add(self, other: Common) -> Common:
        for path, (pages, blocks) in other.paths.items():
            if own := self.paths.get(path):
                own[0] = _pages(own[0], pages)
                own[1] = {d: n for d, n in own[1].items() if d in blocks}
            else:
                self.paths[path] = [pages, blocks]
        self.longest = max(self.longest, other.longest)
        return self

    def pack(self) -> bytes:
        """Names as text, digests and lengths as numbers of eight and four bytes."""
        head = [[path, pages, len(blocks)] for path, (pages, blocks) in self.paths.items()]
        text = json.dumps([self.longest, head]).encode()
        digests = [d for _, blocks in self.paths.values() for d in blocks]
        lengths = [n for _, blocks in self.paths.values() for n in blocks.values()]
        size = np.array([len(text)], np.int64).tobytes()
        return size + text + np.array(digests, np.int64).tobytes() + np.array(lengths, np.uint32).tobytes()

    @classmethod
    def unpack(cls, packed: bytes) -> Common:
        size = 8 + int(np.frombuffer(packed[:8], np.int64)[0])
        longest, head = json.loads(packed[8:size])
        total = sum(n for _, _, n in head)
        digests = np.frombuffer(packed[size : size + 8 * total], np.int64).tolist()
        lengths = np.frombuffer(packed[size + 8 * total :], np.uint32).tolist()
        paths, at = {}, 0
        for path, pages, n in head:
            paths[path] = [pages, dict(zip(digests[at : at + n], lengths[at : at + n], strict=True))]
            at += n
        return cls(paths, longest)

    def template(self) -> list[int]:
        """Digests of (path, block) that are template."""
        found = [
            (path, digest, length)
            for path, (pages, blocks) in self.paths.items()
            if len(pages) == ENOUGH_PAGES
            for digest, length in blocks.items()
        ]
        if 2 * sum(length for _, _, length in found) >= self.longest:
            return []
        return sorted(block_key(path, digest) for path, digest, _ in found)


def block_key(path: str, digest: int) -> int:
    return _digest(f"{digest}{path}")


# ---- what a wrapper keeps ----------------------------------------------------------


def _parts(element: str) -> tuple[str, str, str, list[str]]:
    tag, _, role, hidden, says = (element.split("|") + ["", "", "", ""])[:5]
    return tag, role, hidden, says.split()


def skipped(element: str, in_main: bool) -> bool:
    tag, role, hidden, says = _parts(element)
    if tag in ("html", "body", "article", "main"):
        return False
    if tag == "header" and not in_main:
        return True
    return tag in SKIP or bool(hidden) or role in SKIP_ROLES or "skip" in says


def is_main(element: str) -> bool:
    tag, role, _, says = _parts(element)
    return tag in ("article", "main") or role in ("main", "article") or tag in ("div", "section", "td") and "main" in says


@lru_cache(50_000)
def zone(path: tuple[str, ...]) -> str:
    """Where a path of open elements lies: "main", "skip" (from the first skipped element on) or "loose"."""
    if not path:
        return "loose"
    above = zone(path[:-1])
    if above == "skip" or skipped(path[-1], above == "main"):
        return "skip"
    return "main" if above == "main" or is_main(path[-1]) else "loose"


def content_slots(items: list) -> tuple[list[str], list[str]]:
    """Paths of the text slots of a wrapper that hold content: (in a marked main part, elsewhere).

    The first are all slots inside a main part that no skipped element encloses. The others are
    those outside skipped elements whose text differs between pages (all of them if the host has
    one page, however many copies of it); they count for pages of the host that have no main part.
    """
    marked: dict[str, bool] = {}
    loose: dict[str, list] = {}

    def visit(items: list, path: str, in_main: bool) -> None:
        for name, _, inner, slot in items:
            if name == "#":
                (marked if in_main else loose)[path] = _slot(loose.get(path), slot) if not in_main else True
            elif not skipped(name, in_main):
                visit(inner, f"{path}>{name}", in_main or is_main(name))

    visit(items, "", False)
    return sorted(marked), sorted(path for path, slot in loose.items() if len(slot[0]) < 2 or slot[1] != slot[2])


def main_text(page: str, marked: frozenset[str], loose: frozenset[str], template: frozenset[int] = frozenset()) -> str:
    """Blocks of the slots in the page's main part; of the loose slots if it has no main part.

    A main element inside a skipped one is no main part of the page. Blocks in ``template``
    are left out.
    """
    blocks, has_main = page_blocks(page, {"main": marked, "loose": loose})
    return "\n".join(
        kept
        for where, path, text, kept in blocks
        if kept and (where == "main") == has_main and not (template and block_key(path, _digest(text)) in template)
    )


# ---- Spark -------------------------------------------------------------------------


def _fold_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One partial wrapper and the common blocks per host and task."""
    schema = pa.schema([("host", pa.string()), ("wrapper", pa.string()), ("common", pa.binary())])
    hosts: dict[str, tuple[list, Common]] = {}

    def flush() -> pa.RecordBatch:
        rows = [(host, json.dumps(wrapper), common.pack()) for host, (wrapper, common) in hosts.items()]
        hosts.clear()
        return arrow_rows(schema, rows)

    for host, page in rows_of(batches):
        if page:
            text = page.decode("utf-8", "replace")
            own, common = page_expression(text), Common.of(text)
            if host in hosts:
                wrapper, before = hosts[host]
                own, common = align(wrapper, own), before.add(common)
            hosts[host] = own, common
        if len(hosts) > 5000:
            yield flush()
    yield flush()


def _align_host(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
    whole, common = None, Common()
    for text, packed in sorted(zip(group["wrapper"], group["common"], strict=True)):
        part = json.loads(text)
        whole = part if whole is None else align(whole, part)
        common.add(Common.unpack(packed))
    marked, loose = content_slots(whole)
    return pd.DataFrame(
        {"host": [key[0]], "expression": [shape(whole)], "slots": [marked], "loose": [loose], "template": [common.template()]}
    )


def infer_wrappers(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, expression, slots, loose, template): the regular expression of each host, its content slots and
    the keys of the blocks that all its pages have. The expression is for reading; extraction needs the others."""
    return (
        pages.select(page_host(url_col).alias("host"), F.col(f"`{html_col}`").cast("string").cast("binary").alias("html"))
        .mapInArrow(_fold_pages, "host string, wrapper string, common binary")
        .groupBy("host")
        .applyInPandas(
            _align_host, "host string, expression string, slots array<string>, loose array<string>, template array<long>"
        )
    )


def page_host(url_col: str):
    return F.coalesce(F.lower(F.regexp_extract(F.col(f"`{url_col}`"), r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1)), F.lit(""))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string())])
    for batch in batches:
        known: dict[tuple, frozenset] = {}
        out = []
        for page_id, url, page, *slots in rows_of([batch]):
            known_slots = (known.setdefault(key, frozenset(key)) for key in (tuple(s or ()) for s in slots))
            out.append((page_id, url, main_text(page.decode("utf-8", "replace"), *known_slots) if page else ""))
        yield arrow_rows(schema, out)


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per page: page_id, url, text (main text, empty if none), n_chars.

    Null and empty pages give an empty text. Pages whose URL is null or has no host share one
    wrapper. A page without content gives an empty text. Broken markup is read as
    browsers do: unclosed elements end with what encloses them. Repeated pages are extracted
    each and count once where pages of a host are compared. Elements nested deeper than MAX_DEPTH are read as part
    of the one at that depth. Other columns are not read. An empty table gives an empty result.
    """
    wrappers = infer_wrappers(pages, url_col, html_col).select("host", "slots", "loose", "template")
    rows = pages.select(
        F.col(f"`{id_col}`").cast("long").alias("page_id"),
        F.col(f"`{url_col}`").cast("string").alias("url"),
        F.col(f"`{html_col}`").cast("string").cast("binary").alias("html"),
        page_host(url_col).alias("host"),
    )
    return (
        rows.join(wrappers, "host", "left")
        .select("page_id", "url", "html", "slots", "loose", "template")
        .mapInArrow(_extract, "page_id long, url string, text string")
        .withColumn("n_chars", F.length("text").cast("long"))
    )
