"""Main text of web pages by wrapper induction: what same-host pages share is template, what varies is content."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, stored
from .dom import INLINE, RAW, Node, match, numbered, parse

#: Elements, roles and words of class or id that mark what is not the article.
SKIPPED = frozenset("head nav footer aside form script style noscript template button select option input textarea iframe svg canvas object embed audio video dialog menu".split()) | RAW
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
_WORDS = frozenset(
    "nav navbar navigation menu menus breadcrumb breadcrumbs footer foot header masthead sidebar side aside ad ads adv advert adverts advertisement banner sponsor sponsored promo promotion"
    " cookie cookies consent gdpr notice notices popup modal overlay comment comments reply replies respond disqus share sharing social related recommended newsletter subscribe signup login"
    " search pagination pager toolbar widget widgets skip hidden".split()
)
_CONTAINERS = frozenset("div section ul ol dl table figure details fieldset".split())
_TEXTS = frozenset("h1 h2 h3 h4 h5 h6 p section".split())
_COMMENTS = frozenset("comment comments reply replies respond disqus".split())
_MAIN = frozenset("article content main post entry story body maincontent articlebody postbody".split())
#: How many hosts may have more than one salt, at most.
HOSTS = 100_000
_STARTS: dict[str, tuple[Node, list[Node]]] = {}


def _words(said: str) -> set[str]:
    return {w for w in re.split(r"[^a-z0-9]+", re.sub(r"(?<=[a-z])(?=[A-Z])", " ", said).lower()) if w}


def _marks(node: Node, ids: bool = True) -> set[str]:
    return _words(f"{node.attributes.get('class', '')} {node.attributes.get('id', '') if ids else ''}")


def _whole(name: str) -> bool:
    """Whether all words of a class name are marks, as in social-share, but not related-work."""
    words = _words(name)
    return bool(words) and words <= _WORDS - {"header"}


def skipped(node: Node, in_article: bool) -> bool:
    """Whether the node is marked as anything but article text. A header inside an article holds its title.

    Inside an article only whole class names of block containers are marks, as ids and single words come from its
    headings too; other constant text is left to the wrapper. Outside, ids of headings and paragraphs are no marks."""
    if node.tag in SKIPPED or "hidden" in node.attributes or node.attributes.get("aria-hidden") == "true":
        return True
    if node.tag == "header" and not in_article or node.attributes.get("role") in _ROLES:
        return True
    if node.tag == "article":  # comments can be articles; a class of another kind can end in such a word
        return any(re.split("[^a-z0-9]+", c)[0] in _COMMENTS for c in node.attributes.get("class", "").lower().split())
    if node.tag in ("body", "html", "main", "#root"):
        return False
    if in_article:
        return node.tag in _CONTAINERS and any(_whole(c) for c in node.attributes.get("class", "").split())
    return bool(_marks(node, node.tag not in _TEXTS) & _WORDS)


def blocks(node: Node, dropped: set[int], in_article: bool = False) -> list[str]:
    """Texts of the blocks below a node in page order, without skipped and dropped nodes; inline elements do not
    break a block, all others do."""
    out: list[str] = []
    here: list[str] = []

    def close() -> None:
        text = " ".join("".join(here).split())
        if text:
            out.append(text)
        here.clear()

    todo: list = [(iter(node.parts), False, in_article)]
    while todo:
        parts, is_block, inside = todo[-1]
        for p in parts:
            if isinstance(p, str):
                here.append(p)
            elif id(p) in dropped or skipped(p, inside):
                if p.tag not in INLINE:
                    close()
            else:
                block = p.tag not in INLINE
                if block:
                    close()
                todo.append((iter(p.parts), block, inside or _is_article(p)))
                break
        else:
            todo.pop()
            if is_block:
                close()
    close()
    return out


def _is_article(node: Node) -> bool:
    said = node.attributes
    return node.tag in ("article", "main") or said.get("role") == "main" or said.get("itemprop", "").lower() == "articlebody"


def _article(root: Node, dropped: set[int]) -> list[str]:
    """The blocks of all outermost elements that are marked as article, main part or its container, in page order,
    those below skipped elements left out; without a text in them, those of the page. A container that holds an article
    can hold the site's header too; other headers in it are the article's."""
    out: list[str] = []
    todo = [root]
    while todo:
        node = todo.pop()
        if id(node) in dropped or skipped(node, False):
            continue
        if _is_article(node):
            out += blocks(node, dropped, True)
        elif node.tag in ("div", "section", "td") and _marks(node) & _MAIN:
            out += blocks(node, dropped, not any(map(_is_article, numbered(node))))
        else:
            todo += reversed(node.children)
    return out or blocks(root, dropped)


def _own_text(node: Node) -> str:
    """The text of a block without blocks in it; inline elements are parts of one, never template by themselves."""
    return node.text() if node.tag not in INLINE and not any(c.tag not in INLINE for c in node.children) else ""


def _started(page: str) -> tuple[Node, list[Node]]:
    """A host's first page, parsed once in a worker."""
    if page not in _STARTS:
        if len(_STARTS) > 200:
            _STARTS.clear()
        root = parse(page)
        _STARTS[page] = root, numbered(root)
    return _STARTS[page]


def aligned(page: Node, first: str) -> list[tuple[int, str, str, Node]]:
    """(number in the first page, its text, the page's text, the page's node) of aligned leaf blocks."""
    root, nodes = _started(first)
    number = {id(n): k for k, n in enumerate(nodes)}
    pairs: list[tuple[Node, Node]] = []
    match(root, page, pairs)
    return [(number[id(a)], x, y, b) for a, b in pairs if (x := _own_text(a)) and (y := _own_text(b))]


def _alignments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each page but the reference itself: the reference's nodes that it is aligned with, whether their texts are
    equal, the lengths of its own, and the length of its blocks that are aligned with none."""
    for batch in batches:
        kept, out = [], ([], [], [], [])
        for at, (page, first) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("html", "first")), strict=True)):
            if page == first:
                continue
            root = parse(page)
            pairs = aligned(root, first)
            sizes = [len(y) for _, _, y, _ in pairs]
            rest = sum(len(_own_text(n)) for n in numbered(root)) - sum(sizes)
            kept.append(at)
            for column, value in zip(out, ([k for k, *_ in pairs], [x == y for _, x, y, _ in pairs], sizes, rest), strict=True):
                column.append(value)
        types = (pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int64()), pa.int64())
        yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(kept, pa.int64())) for c in ("host", "layout", "salt")), *(pa.array(v, t) for v, t in zip(out, types, strict=True))], names=["host", "layout", "salt", "nodes", "same", "sizes", "rest"])


def is_copy(nodes: list[int], same: list[bool], sizes: list[int], rest: int, varying: set[int], close: float) -> bool:
    """Whether a page says what its reference says: whether over ``close`` of the text in its varying slots is equal. Text
    that is aligned with nothing varies."""
    total = rest + sum(size for k, size in zip(nodes, sizes, strict=True) if k in varying)
    return not total or sum(size for k, equal, size in zip(nodes, same, sizes, strict=True) if equal and k in varying) > close * total


def _votes(batches: Iterator[pa.RecordBatch], least: int, close: float) -> Iterator[pa.RecordBatch]:
    """Per host, layout and node of its reference: pages aligned there, and those with equal text. Copies of the
    reference have no vote."""
    counts: dict[tuple[str, str, int], list[int]] = {}

    def batch_of() -> pa.RecordBatch:
        keys = list(counts)
        out = pa.RecordBatch.from_arrays([*(pa.array([k[i] for k in keys], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64()))), *(pa.array([counts[k][i] for k in keys], pa.int64()) for i in (0, 1))], names=["host", "layout", "node", "pages", "same"])
        counts.clear()
        return out

    for batch in batches:
        varying: dict[tuple[str, str], set[int]] = {}
        hosts, layouts, slots = batch.column("host").to_pylist(), batch.column("layout").to_pylist(), batch.column("slots")
        for at, (host, layout, nodes, same, sizes, rest) in enumerate(zip(hosts, layouts, *(batch.column(c).to_pylist() for c in ("nodes", "same", "sizes", "rest")), strict=True)):
            if (host, layout) not in varying:
                varying[host, layout] = {s["node"] for s in slots[at].as_py() or () if s["pages"] - s["same"] >= least}
            if is_copy(nodes, same, sizes, rest, varying[host, layout], close):
                continue
            for k, equal in zip(nodes, same, strict=True):
                seen = counts.setdefault((host, layout, k), [0, 0])
                seen[0] += 1
                seen[1] += equal
        if len(counts) > 50_000:
            yield batch_of()
    yield batch_of()


def layout_of(html: Column) -> Column:
    """A digest of a page's layout: the tags and classes of its containers without digits, and the number of its blocks
    to a power of four."""
    block = r"(?i)<(?:p|li|h[1-6]|td|dt|dd|div|section|main|article|table)(?=[\s/>])[^>]*"
    said = lambda t: F.concat(F.regexp_extract(t, "^<[a-z]+", 0), F.lit("."), F.regexp_replace(F.regexp_extract(t, r"""\sclass\s*=\s*["']?([^"']*)""", 1), "[0-9]+", ""))
    holders = lambda starts: F.filter(F.array_distinct(F.transform(starts, lambda t: F.lower(t))), lambda t: t.rlike("^<(?:div|section|main|article|table)"))
    digest = lambda starts: F.md5(F.concat_ws(" ", F.sort_array(F.array_distinct(F.transform(holders(starts), said))), F.floor(F.log(4.0, F.size(starts) + 1)).cast("string")))
    return let(F.regexp_extract_all(html, F.lit(block), 0), digest)


def main_text(page: str, first: str | None, constant: list[int]) -> str:
    """The article: its blocks without marked elements and without nodes that are template."""
    root = parse(page)
    dropped: set[int] = set()
    if constant and page != first:
        fixed = set(constant)
        dropped = {id(b) for k, x, y, b in aligned(root, first) if k in fixed and x == y}
    elif constant:
        root, nodes = _started(page)
        dropped = {id(nodes[k]) for k in constant}
    return "\n".join(_article(root, dropped))


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1))


def extract(pages: DataFrame, least: int = 3, share: float = 0.9, close: float = 0.5, per_task: int = 64, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``page_id, url, text`` for each row.

    1. A host's pages are told apart by their layout (``layout_of``). Each layout of over ``least`` pages has its page with
       the smallest id as its reference; pages of rarer layouts go with the reference of the host's commonest one, or, if
       all are rare, with the first page. Every page's tree is aligned with its reference by simple tree matching.
    2. Each aligned block votes whether its text equals the reference's; votes are summed by reference and node, in the task
       first. Nodes with equal text on ``share`` of at least ``least`` pages are template. Copies of the reference, pages
       of which more than ``close`` of the text in the varying slots equals its own, do not vote, so that groups of
       copies do not turn articles into template. A slot varies if its text differs on ``least`` pages; text that is
       constant does not make a page a copy.
    3. Each page is aligned again; template nodes go, and the blocks of the article, the varying slots, stay, without
       elements that are marked as menus, headers, footers, sidebars, notices, adverts, forms or comments.

    Pages meet their reference by host, layout and a salt, of which a host has one for every ``per_task`` pages, or for
    every hundred thousandth of all pages if that is more: a host with a third of all pages is spread over a third of
    the tasks, and at most 100,000 hosts have salts, whose list is broadcast. Hosts of at most ``least`` pages have no template; marks alone decide.

    Null or empty html: empty text. Null url: the host is empty, as for urls without one. Null and repeated ids: a row
    each. Equal pages get equal texts. Very long pages are read whole. No rows: none. Other columns are not read.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    rows = rows.withColumn("host", host_of(F.col("url"))).withColumn("form", F.when(F.col("html") != "", layout_of(F.col("html"))))
    order = F.struct(F.col("page_id").isNull(), "page_id", "form")
    forms = stored(rows.filter("html <> ''").groupBy("host", "form").agg(F.count("*").alias("n"), F.min(order).alias("low")), "layouts")
    most = max(per_task, (forms.agg(F.sum("n")).first()[0] or 0) / HOSTS)
    salts = F.ceil(F.col("n") / F.lit(most)).cast("long")
    large = F.broadcast(stored(forms.groupBy("host").agg(F.sum("n").alias("n")).filter(F.col("n") > most).select("host", salts.alias("salts")), "large-hosts"))
    rows = rows.join(large, "host", "left").withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.coalesce("salts", F.lit(1)))).drop("salts")
    every = lambda df: df.join(large, "host", "left").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("salts", F.lit(1)) - 1))).drop("salts")
    usual = forms.groupBy("host").agg(F.min(F.struct(F.when(F.col("n") > least, -F.col("n")).otherwise(0).alias("n"), "low", "form")).alias("m"), F.sum("n").alias("n"))
    usual = usual.filter(F.col("n") > least).select("host", F.col("m.form").alias("usual"))  # fewer pages can't agree often enough
    # The rows of a rare layout go with the usual one; only common layouts and one more for each host are listed.
    listed = forms.filter(F.col("n") > least).select("host", "form").join(usual, "host").select("host", "form", F.col("form").alias("common"))
    listed = stored(listed.unionByName(usual.select("host", F.lit("").alias("form"), F.col("usual").alias("common"))), "references")
    by_form = stored(every(listed.filter("form <> ''")), "layout-salts")
    by_host = stored(every(listed.filter("form = ''").select("host", F.col("common").alias("usual"))), "host-salts")
    rows = rows.join(by_form, ["host", "form", "salt"], "left").join(by_host, ["host", "salt"], "left").withColumn("layout", F.coalesce("common", "usual"))
    first = rows.filter("html <> '' AND form = layout").groupBy("host", "layout").agg(F.min_by("html", F.struct(F.col("page_id").isNull(), "page_id", "html")).alias("first"))
    first = every(stored(first, "first-pages"))
    paired = rows.filter("html <> ''").join(first, ["host", "layout", "salt"]).select("host", "layout", "salt", "html", "first")
    found = stored(paired.mapInArrow(_alignments, "host string, layout string, salt long, nodes array<long>, same array<boolean>, sizes array<long>, rest long"), "alignments")
    slots = found.select("host", "layout", F.explode(F.arrays_zip("nodes", "same")).alias("a")).groupBy("host", "layout", F.col("a.nodes").alias("node")).agg(F.count("*").alias("pages"), F.sum(F.col("a.same").cast("long")).alias("same"))
    slots = every(slots.groupBy("host", "layout").agg(F.collect_list(F.struct("node", "pages", "same")).alias("slots")))
    votes = found.join(slots, ["host", "layout", "salt"], "left").mapInArrow(lambda batches: _votes(batches, least, close), "host string, layout string, node long, pages long, same long")
    votes = votes.groupBy("host", "layout", "node").agg(F.sum("pages").alias("pages"), F.sum("same").alias("same"))
    constant = votes.filter((F.col("pages") >= least) & (F.col("same") >= share * F.col("pages"))).groupBy("host", "layout").agg(F.sort_array(F.collect_list("node")).alias("constant"))
    constant = stored(constant, "templates")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page, first, constant or []) if page else "" for page, first, constant in zip(*(batch.column(c).to_pylist() for c in ("html", "first", "constant")), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    if constant.isEmpty():  # no host has a template, so no page needs its reference
        full = rows.select("page_id", "url", "html", F.lit(None).cast("string").alias("first"), F.lit(None).cast("array<long>").alias("constant"))
    else:
        known = first.join(constant, ["host", "layout"])
        full = rows.join(known, ["host", "layout", "salt"], "left").select("page_id", "url", "html", "first", "constant")
    return full.mapInArrow(read, f"page_id {dict(rows.dtypes)['page_id']}, url string, text string")
