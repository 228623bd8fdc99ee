"""Main text of web pages: markup where it is certain, and elsewhere repeats found by suffix arrays over each host's pages."""

from __future__ import annotations

import html as _html
import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import table
from .parts import Unpacked, pack_blocks, pack_cells, pack_numbers, part_of, unpack_cells, unpack_rows

#: A substring of so many tokens that two pages of a host share is boilerplate.
LONG = 6
#: A block of prose is a notice, not main text, if all of it lies in substrings that more than half of the other rows of the
#: host have, of so many other rows at least.
OTHERS = 7
#: Bytes of pages in a block of streams, and bytes of all pages to a part of the table of heads.
STREAM, PART = 1 << 23, 1 << 24

# Element names and the words in class, id and role attributes that mark what is not main text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea template noscript iframe svg math select object xmp noembed noframes".split())
DROP = frozenset("head nav footer aside form button dialog menu canvas audio video map label fieldset".split())
BLOCK = frozenset(
    "html body article main section header hgroup address div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd pre blockquote figure figcaption table caption thead tbody tfoot tr td th hr br center details summary nav footer aside form dialog menu fieldset legend".split()
)
#: Blocks of running text: inside the main container they are main text by declaration.
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd pre blockquote figcaption td th caption".split())
CLOSES_P = BLOCK - {"br"}
_NOT_P, _NOTHING = BLOCK - {"p"}, frozenset()
_CONTAINERS = frozenset(("article", "main", "body"))
_LISTS = frozenset("ul ol menu table dl article main body".split())
#: An element ends at the start of such another.
_SIBLINGS = {"li": ("li",), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th"), "dt": ("dt", "dd"), "dd": ("dt", "dd")}
BAD_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar toolbar note".split())
BAD_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert sidebar aside rail menu nav navbar navigation breadcrumb breadcrumbs footer foot masthead topbar toolbar comment comments discussion disqus respond replies share sharing social related recommended recommendations newsletter subscribe subscription signup popup modal overlay widget pagination pager skip".split()
)
#: Such words only suggest it: the repeats decide.
WEAK_WORDS = frozenset("copyright legal search".split())
GOOD_WORDS = frozenset("content article post entry story maincontent articlebody postbody".split())
_MARK = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>"
    rf"|<(?:{'|'.join(sorted(RAW, key=len, reverse=True))})(?=[\s/>])[^>]*>"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>\"']*(?:\"[^\"<]*\"[^>\"']*|'[^'<]*'[^>\"']*)*[^>]*)>",
    re.S | re.I,
)
_RAW_END = {name: re.compile(rf"</{name}\s*>", re.I) for name in RAW}
_RAW_NAME = re.compile(r"<([a-zA-Z]+)")
_ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_HOST = re.compile(r"^[a-zA-Z][-+.\w]*://(?:[^/?#@]*@)?([^/?#:]*)")


class Block:
    """Text of one block: where it stands, and whether rules drop or protect it."""

    __slots__ = ("text", "dropped", "scope", "prose")

    def __init__(self, text: str, dropped: bool, scope: int, prose: bool) -> None:
        self.text, self.dropped, self.scope, self.prose = text, dropped, scope, prose


def _judge(attributes: str) -> tuple[bool, bool, bool]:
    """Whether an element's attributes mark it as no main text, suggest that, and mark it as a container of main text."""
    if not attributes or attributes == "/":
        return False, False, False
    bad = weak = good = False
    for key, a, b, c in _ATTRIBUTE.findall(attributes):
        key, value = key.lower(), (a or b or c).lower()
        if key == "role":
            bad |= value in BAD_ROLES
            good |= value == "main"
        elif key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value)):
            bad = True
        elif key == "itemprop":
            good |= value == "articlebody"
            bad |= value == "comment"
        elif key in ("class", "id"):
            for token in value.split():
                words = re.split(r"[^a-z0-9]+", token)
                if words[0] in ("has", "with", "no", "without"):
                    continue
                bad |= not BAD_WORDS.isdisjoint(words)
                weak |= not WEAK_WORDS.isdisjoint(words)
                good |= token.replace("-", "").replace("_", "") in GOOD_WORDS
    return bad, weak, good


def blocks_of(page: str) -> list[Block]:
    """The blocks of a page in order, with white space folded and character references decoded."""
    out: list[Block] = []
    # open elements: (name, dropped, scope, prose, doubt); scope 3 in an article, 2 in main, 1 in a named content container
    stack: list[tuple[str, bool, int, bool, bool]] = [("", False, 0, False, False)]
    words: list[str] = []

    def flush() -> None:
        text = "".join(words)
        text = " ".join((_html.unescape(text) if "&" in text else text).split())
        words.clear()
        if text:
            out.append(Block(text, *stack[-1][1:4]))

    def leave(name: str, wall: frozenset = frozenset()) -> None:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i][0] == name:
                del stack[i:]
                return
            if stack[i][0] in wall:
                return

    at = 0  # end of what is read; marks before it lie inside an element without markup
    for m in _MARK.finditer(page):
        start = m.start()
        if start < at:
            continue
        if start > at:
            words.append(page[at:start])
        at = m.end()
        name = m[2]
        if name is None:
            raw = _RAW_NAME.match(m[0])
            if raw and not (m[0].endswith("/>") and raw[1].lower() in ("svg", "math")):
                end = _RAW_END[raw[1].lower()].search(page, at)
                at = end.end() if end else len(page)
            continue
        name = name.lower()
        if m[1]:
            if name in BLOCK or name in DROP:
                flush()
            leave(name, _CONTAINERS if name not in _CONTAINERS and name != "html" else _NOTHING)
            continue
        attributes = m[3]
        if name in BLOCK or name in DROP:
            flush()
            if name in CLOSES_P:
                leave("p", _NOT_P)
            for other in _SIBLINGS.get(name, ()):
                leave(other, _LISTS)
        if name in VOID:
            continue
        _, dropped, scope, prose, doubt = stack[-1]
        bad, weak, good = _judge(attributes)
        doubt |= weak
        dropped |= (name in DROP) or (bad and name not in ("html", "body", "main"))
        if name == "header" and not scope:
            dropped = True
        scope = max(scope, 3 if name == "article" else 2 if name == "main" else 1 if good else 0)
        stack.append((name, dropped, scope, not doubt and (name in PROSE or (prose and name not in BLOCK)), doubt))
    if at < len(page):
        words.append(page[at:])
    flush()
    return out


def host_of(url: str | None) -> str:
    m = _HOST.match(url or "")
    return m[1].lower() if m else ""


def split_page(page: str, trust_markup: bool = True) -> tuple[list[tuple[str, int]], list[str]]:
    """``(text, open)`` of the blocks that may be main text, and the texts that are only seen as evidence of repeats.

    The scope is the articles if there are any, else the main element, else a named content container, else the body.
    Prose in a container is declared to be main text (0); other blocks in scope are open (1). Blocks that markup drops, and
    those out of scope, are evidence. The repeats decide about all of them. Without ``trust_markup`` every block is open.
    """
    blocks = blocks_of(page)
    if not trust_markup:
        return [(b.text, 1) for b in blocks], []
    scope = max((b.scope for b in blocks if not b.dropped), default=0)
    inside = [(b.text, int(not (scope and b.prose))) for b in blocks if not b.dropped and b.scope >= scope]
    return inside, [b.text for b in blocks if b.dropped or b.scope < scope]


def streams_of(pages: list[tuple[list[tuple[str, int]], list[str]]]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens of the pages, and how many each has: those of its open blocks in page order, of its evidence, and of its prose."""
    words: list[str] = []
    ends = [0]
    for inside, evidence in pages:
        for text in (*(t for t, free in inside if free), *evidence, *(t for t, free in inside if not free)):
            words += text.split()
        ends.append(len(words))
    kinds = pa.array(words, pa.large_string()).dictionary_encode()
    hashes = np.array([xxhash.xxh64_intdigest(w) for w in kinds.dictionary.to_pylist()], np.uint64)
    return hashes[kinds.indices.to_numpy()], np.diff(ends)


def head_names(tokens: np.ndarray, host: np.ndarray | np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """128-bit names of the host's next ``LONG`` tokens from each place on that has as many."""
    n = max(0, len(tokens) - LONG + 1)
    names = []
    for odd in (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)):
        head = np.zeros(n, np.uint64) + (host if np.ndim(host) == 0 else host[:n])
        for i in range(LONG):
            head = ((head ^ (head >> np.uint64(31))) + tokens[i : n + i]) * odd
        names.append(((head ^ (head >> np.uint64(29))) * odd).view(np.int64))
    return names[0], names[1]


def labels(values: np.ndarray, kind: int) -> np.ndarray:
    """First names of hosts (0) and pages (1), apart from those of heads."""
    odd = np.uint64(0x9E3779B97F4A7C15 if kind else 0xC2B2AE3D27D4EB4F)
    values = (values ^ (values >> np.uint64(31)) ^ odd) * np.uint64(0xD6E8FEB86659FD93)
    return (values ^ (values >> np.uint64(29))) * odd


def whole_heads(page: np.ndarray) -> np.ndarray:
    """Places from which ``LONG`` tokens of one page follow."""
    return np.flatnonzero(page[: max(0, len(page) - LONG + 1)] == page[LONG - 1 :]) if len(page) >= LONG else np.zeros(0, np.int64)


def suffix_array(tokens: np.ndarray, host: np.ndarray, page: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the concatenated streams in the order of their suffixes, and where suffixes with a new head begin.

    Suffixes are sorted to the depth of ``LONG`` tokens by doubling ranks: tokens of a host, then pairs of ranks. A suffix
    belongs here if so many tokens of its page follow. Neighbours between two beginnings agree in that many tokens, each
    compared by its rank; longer repeats are chains of such places.
    """
    n = len(tokens)
    token, of_host = (np.unique(x, return_inverse=True)[1].ravel() for x in (tokens, host))
    rank = np.unique(of_host * max(1, n) + token, return_inverse=True)[1].ravel()
    ranks = {1: rank}

    def join(a: int, b: int) -> None:
        behind = np.concatenate([ranks[b][a:], np.full(min(a, n), -1)]) + 1
        ranks[a + b] = np.unique(ranks[a].astype(np.int64) * (n + 2) + behind, return_inverse=True)[1].ravel() if n else rank

    depth = 1
    while 2 * depth <= LONG:
        join(depth, depth)
        depth *= 2
    while depth < LONG:
        step = max(d for d in ranks if d <= LONG - depth)
        join(depth, step)
        depth += step
    whole = whole_heads(page)
    order = whole[np.argsort(ranks[LONG][whole], kind="stable")]
    sorted_ranks = ranks[LONG][order]
    return order, np.flatnonzero(np.concatenate([[True], sorted_ranks[1:] != sorted_ranks[:-1]])) if len(order) else np.zeros(0, np.int64)


def unique_runs(inside: list[tuple[str, int]], n_evidence: int, repeated: np.ndarray, common: np.ndarray) -> tuple[str, int, int, int, int]:
    """Text of the blocks without what repeats, and numbers of tokens: open, cut from open blocks, of prose repeated and cut.

    Of open blocks the ``repeated`` tokens go, of prose the blocks all of whose tokens are ``common``. If nothing would be
    left, the whole text stays.
    """
    n_open = sum(len(text.split()) for text, free in inside if free)
    kept, at, prose, notices = [], 0, n_open + n_evidence, 0
    for text, free in inside:
        words = text.split()
        if free:
            kept.append(" ".join(w for w, c in zip(words, repeated[at : at + len(words)]) if not c))
            at += len(words)
        else:
            notice = bool(common[prose : prose + len(words)].all())
            notices += notice * len(words)
            kept.append("" if notice else text)
            prose += len(words)
    text = " ".join(t for t in kept if t) or " ".join(text for text, _ in inside)
    return text, n_open, int(repeated[:n_open].sum()), int(repeated[n_open + n_evidence :].sum()), notices


def spans(begins: np.ndarray, n: int) -> np.ndarray:
    """Which of ``n`` tokens lie in one of the substrings of ``LONG`` tokens that begin at the given places."""
    change = np.zeros(n + LONG + 1, np.int64)
    np.add.at(change, begins, 1)
    np.add.at(change, begins + LONG, -1)
    return np.cumsum(change)[:n] > 0


def host_hash(address: str | None) -> int:
    return xxhash.xxh64_intdigest(host_of(address).encode("utf-8", "surrogatepass"))


def parsed(own: pa.Table, trust_markup: bool) -> pa.Table:
    """What later steps need of the pages: the blocks in scope, whether each is open, and the evidence. A block has no line break."""
    split = [split_page(page, trust_markup) for page in own["html"].to_pylist()]
    texts = ["\n".join(t for t, _ in inside) for inside, _ in split], ["".join(str(free) for _, free in inside) for inside, _ in split], ["\n".join(evidence) for _, evidence in split]
    return pa.table([own["page_id"], own["url"], own["key"], *(pa.array(t, pa.large_string()) for t in texts)], names=["page_id", "url", "key", "inside", "open", "evidence"])


class Pages:
    """A block of pages as ``parsed`` left it: ``split`` as of ``split_page``, the ``tokens`` of all with their ``page`` and ``host``."""

    def __init__(self, value: bytes) -> None:
        own = unpack_rows(value)
        self.ids, self.urls, self.keys = own["page_id"].to_pylist(), own["url"].to_pylist(), own["key"].to_numpy().view(np.uint64)
        texts = zip(*(own[c].to_pylist() for c in ("inside", "open", "evidence")))
        self.split = [(list(zip(inside.split("\n"), map(int, free))), evidence.split("\n") if evidence else []) for inside, free, evidence in texts]
        self.tokens, self.size = streams_of(self.split)
        self.page = np.repeat(np.arange(len(self.size)), self.size)
        self.hosts = np.array([host_hash(u) for u in self.urls], np.uint64)
        self.host = np.repeat(self.hosts, self.size)

    def names(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Names of the heads at some places."""
        return tuple(x.view(np.uint64)[places] for x in head_names(self.tokens, self.host))


def extract(pages: DataFrame, html: str = "html", url: str = "url", page_id: str = "page_id", trust_markup: bool = True) -> DataFrame:
    """``page_id``, ``url``, ``text``, ``n_chars``, ``n_open``, ``n_cut``, ``n_repeat`` and ``n_notice`` for every row of ``pages``.

    The tokens of all blocks of all pages go through suffix arrays, prose included: these find what ``LONG`` or more tokens
    in a row other pages of the host share, and how many rows of the host have it. Markup says what a repeat means.
    In blocks that it leaves open, repeated tokens are cut and the unique runs stay. Prose in the main container is cut
    where a whole block is a notice that most pages of the host carry (``OTHERS``); prose that only some pages repeat is a
    reprint and stays main text. Elements that hold no main text by their name, role, class or id are evidence only. A page
    of which nothing would be left (a copy under another address) keeps its scope. ``n_open`` counts a page's open tokens
    and ``n_cut`` those cut, ``n_repeat`` the tokens of prose that others repeat and ``n_notice`` those cut. Without
    ``trust_markup`` every block of a page is open.

    A suffix array is built for each block of pages of any host, so that a large host is spread like any other. Of each
    different head a block first sends a few bits, its cell, to the part of a table that says which cells other blocks
    have too. A head alone in its cell is no repeat; of the others the block sends the name and the number of rows to
    the part that sums the rows up, and gets back those in several rows.

    Null html counts as empty; a page without main text has the empty text. Rows that repeat a page's url and html are no
    repeats of each other. A null url is a host of its own. An empty table gives no rows; extra columns are ignored.
    """
    rows = pages.select(F.col(f"`{page_id}`").alias("page_id"), F.col(f"`{url}`").alias("url"), F.coalesce(F.col(f"`{html}`"), F.lit("")).alias("html"))
    rows = rows.select("page_id", "url", "html", F.xxhash64("url", "html").alias("key"), F.octet_length("html").alias("size"), F.spark_partition_id().alias("part"))
    id_type = rows.schema["page_id"].dataType.simpleString()
    total = rows.agg(F.sum("size")).first()[0] or 0
    parts = 1 + total // PART
    # a page of html has a token for every six or seven bytes: a cell has a head of other blocks in one of a dozen cases
    shift = np.uint64(max(0, 64 - max(8, (2 * total).bit_length())))

    def dealt(block: int, sign: int, first: np.ndarray, pack: Callable[[int, int], bytes]) -> pa.Table:
        """Sorted names or cells in a row for each part; ``pack`` has the bytes between two places."""
        bounds = np.searchsorted(part_of(first, parts), np.arange(parts + 1))
        kept = [(p, a, b) for p, (a, b) in enumerate(zip(bounds, bounds[1:])) if a < b]
        blobs = [pack(a, b) for _, a, b in kept]
        columns = [p for p, _, _ in kept], [block] * len(kept), [sign] * len(kept), blobs, [b - a for _, a, b in kept]
        return pa.table([pa.array(x, t) for x, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64()))], names=["part", "block", "sign", "blob", "n"])

    def one(left: pa.Table, right: pa.Table | None = None) -> tuple[int, int, Pages]:
        if len(left) != 1 or (right is not None and not set(right["sign"].to_pylist()) <= set(left["sign"].to_pylist())):
            raise ValueError("a block of pages was not read alike twice: checkpoint the pages first")
        return left["block"][0].as_py(), left["sign"][0].as_py(), Pages(left["rows"][0].as_py())

    def ask_cells(left: pa.Table) -> pa.Table:
        """The cells of the different heads of a block's suffix array."""
        block, sign, own = one(left)
        order, begins = suffix_array(own.tokens, own.host, own.page)
        cells = np.unique(own.names(order[begins])[0] >> shift)
        return dealt(block, sign, cells << shift, lambda a, b: pack_cells(cells[a:b]))

    def answer_cells(key: tuple, table: pa.Table) -> pa.Table:
        """To each block, a bit for each of its cells: whether another block has it."""
        cells = [unpack_cells(blob, n) for blob, n in zip(table["blob"].to_pylist(), table["n"].to_pylist())]
        _, inverse, n = np.unique(np.concatenate(cells), return_inverse=True, return_counts=True)
        shared = np.split(n[inverse.ravel()] > 1, np.cumsum([len(c) for c in cells])[:-1])
        blobs = [pack_numbers((np.packbits(x).astype(np.uint64), 1)) for x in shared]
        return pa.table([table["block"], table["part"], table["sign"], pa.array(blobs, pa.binary()), table["n"]], names=["block", "part", "sign", "blob", "n"])

    def ask_names(left: pa.Table, right: pa.Table) -> pa.Table:
        """The different heads of a block that may be repeats, its hosts and its pages, with the rows of each."""
        block, sign, own = one(left, right)
        places = whole_heads(own.page)
        _, inverse, n_places = np.unique(own.names(places)[0] >> shift, return_inverse=True, return_counts=True)
        told = [np.zeros(0, bool)]
        for _, blob, n in sorted(zip(right["part"].to_pylist(), right["blob"].to_pylist(), right["n"].to_pylist())):
            told.append(np.unpackbits(Unpacked(blob).take((n + 7) // 8, 1).astype(np.uint8), count=n).astype(bool))
        told = np.concatenate(told)
        if len(told) != len(n_places):
            raise ValueError("a block of pages has lost some of its cells' answers")
        places = places[((n_places > 1) | told)[inverse.ravel()]]
        first, second = own.names(places)
        page = own.page[places]
        order = np.lexsort((page, second, first))
        first, second, page = first[order], second[order], page[order]
        head = np.ones(len(first), bool)
        head[1:] = (first[1:] != first[:-1]) | (second[1:] != second[:-1])
        new = head.copy()
        new[1:] |= page[1:] != page[:-1]
        begins = np.flatnonzero(head)
        first, second, n = first[begins], second[begins], np.add.reduceat(new.astype(np.int64), begins) if len(begins) else np.zeros(0, np.int64)
        for odd, values in enumerate((own.hosts, own.keys)):
            values, rows_of = np.unique(values, return_counts=True)
            first, second, n = (np.concatenate(x) for x in ((first, labels(values, odd)), (second, values), (n, rows_of)))
        by_name = np.argsort(first)
        first, second, n = first[by_name], second[by_name] & np.uint64(255), n[by_name]
        return dealt(block, sign, first, lambda a, b: pack_numbers((np.diff(first[a:b], prepend=np.uint64(0)), 8), (second[a:b], 1), (n[a:b], 4)))

    def answer_names(key: tuple, table: pa.Table) -> pa.Table:
        """To each block, those of its heads that several rows have, with the number of rows."""
        names, ends = [], [0]
        for blob, n in zip(table["blob"].to_pylist(), table["n"].to_pylist()):
            source = Unpacked(blob)
            names.append((np.cumsum(source.take(n, 8), dtype=np.uint64), source.take(n, 1), source.take(n, 4)))
            ends.append(ends[-1] + n)
        a, b, n = (np.concatenate(x) for x in zip(*names))
        order = np.lexsort((b, a))
        new = np.concatenate([[True], (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])])
        total = np.empty(len(order), np.uint64)
        total[order] = np.add.reduceat(n[order], np.flatnonzero(new))[np.cumsum(new) - 1]
        blobs, sizes = [], []
        for lo, hi in zip(ends, ends[1:]):
            at = lo + np.flatnonzero(total[lo:hi] > 1)
            blobs.append(pack_numbers((np.diff(a[at], prepend=np.uint64(0)), 8), (b[at], 1), (total[at], 6)))
            sizes.append(len(at))
        return pa.table([table["block"], table["sign"], pa.array(blobs, pa.binary()), pa.array(sizes, pa.int64())], names=["block", "sign", "blob", "n"])

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        _, _, own = one(left, right)
        known = [(np.zeros(0, np.uint64),) * 3]
        for blob, n in zip(right["blob"].to_pylist(), right["n"].to_pylist()):
            source = Unpacked(blob)
            known.append((np.cumsum(source.take(n, 8), dtype=np.uint64), source.take(n, 1), source.take(n, 6)))
        a, b, rows_of = (np.concatenate(x) for x in zip(*known))
        order = np.lexsort((b, a))
        a, b, rows_of = a[order], b[order], rows_of[order].astype(np.int64)

        def rows_with(first: np.ndarray, second: np.ndarray) -> np.ndarray:
            """Number of rows of each name, 1 of those that were not answered."""
            place, n = np.searchsorted(a, first), np.ones(len(first), np.int64)
            while len(a):  # names that differ only in the second hash stand behind each other
                here = np.minimum(place, len(a) - 1)
                same = (place < len(a)) & (a[here] == first)
                hit = same & (b[here] == second & np.uint64(255))
                n[hit] = rows_of[here[hit]]
                if not (same & ~hit).any():
                    break
                place = np.where(same & ~hit, place + 1, len(a))
            return n

        of_host, alike = rows_with(labels(own.hosts, 0), own.hosts), rows_with(labels(own.keys, 1), own.keys)
        others = of_host - alike
        places = whole_heads(own.page)
        n, page = rows_with(*own.names(places)), own.page[places]
        repeated = spans(places[n > alike[page]], len(own.tokens))
        common = spans(places[(2 * (n - alike[page]) > others[page]) & (others[page] >= OTHERS)], len(own.tokens))
        bounds = np.cumsum(own.size)[:-1]
        out = []
        for id_, address, (inside, evidence), r, c in zip(own.ids, own.urls, own.split, np.split(repeated, bounds), np.split(common, bounds)):
            out.append((id_, address, *unique_runs(inside, sum(len(t.split()) for t in evidence), r, c)))
        return pa.table([pa.array(x, t) for x, t in zip(zip(*out), (kind, pa.string(), pa.string(), *[pa.int64()] * 4))], names=["page_id", "url", "text", *counted])

    counted = ["n_open", "n_cut", "n_repeat", "n_notice"]
    kind = to_arrow_type(rows.schema["page_id"].dataType)
    asked, told = "part long, block long, sign long, blob binary, n long", "block long, sign long, blob binary, n long"
    # one plan, so that the parsed blocks are written once and their exchange is read three times
    blocks = pack_blocks(rows, STREAM, lambda own: parsed(own, trust_markup), level=6).groupBy("block")
    cells = blocks.applyInArrow(ask_cells, asked).groupBy("part").applyInArrow(answer_cells, "block long, part long, sign long, blob binary, n long")
    answered = blocks.cogroup(cells.groupBy("block")).applyInArrow(ask_names, asked).groupBy("part").applyInArrow(answer_names, told)
    shown = f"page_id {id_type}, url string, text string, {', '.join(f'{c} long' for c in counted)}"
    done = blocks.cogroup(answered.groupBy("block")).applyInArrow(finish, shown)
    return done.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"), *counted)


def op10_html(spark, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return extract(table(spark, sf_dir, "pages"))
