"""HTML extraction by union-free regular-expression inference: wrappers from aligned token streams of a host's pages.

1. A page becomes a stream of tokens: block elements that open and close (end tags that HTML lets one leave out are put
   in, inline markup belongs to the text) and places of text. Neighbours of equal form are one repeated token, so the
   form of a page is a short expression such as ``nav! div! article.3(h1(#)p(#)+)footer!``; ``!`` is an opaque element.
2. The distinct forms of a host are aligned one after the other: what both have is merged, what one lacks becomes
   optional, neighbours alike become a repeated group, text becomes a slot, and where groups repeat or alternate beyond
   ``WIDTH`` items the sequence becomes ``(a? b? ...)+``. This expression without unions is the host's wrapper; each form
   aligned is an instance of it. Distinct forms are dealt to buckets by hash, folded there in order, and the buckets'
   wrappers are folded once more, so a host with a third of all pages is no single task's work and the result does not
   depend on how rows are dealt.
3. Every page is parsed by its host's wrapper, which says for each text which slot it fills. Over all pages, slots of mostly
   links are template if the host has others, and so are slots of one and the same text on FIXED_PAGES pages or more.
4. The text of a page is what fills slots of its main region: of the highest level that has text there, an ``article``, else ``main``,
   else an element named as content, else all slots that are no template. Menus, headers, footers, sidebars, notices,
   adverts, forms, scripts, styles and comments, by element, role or class, are in no slot.

Defined results: null and empty pages, and pages without main text, give an empty text; null urls and urls without a host
are a host of their own; a page cut off anywhere is read as far as it goes; elements deeper than DEPTH count to the one at
that depth; rows that repeat an id each have their row; a null id stays null. White space is ASCII white space. Further columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyfold.llm.common import Kept, small_batches, worker_store

WIDTH, DEPTH, BUCKETS, FIXED_PAGES, ALIKE = 24, 64, 64, 3, 0.6

#: Elements of HTML, by what they are here.
BLOCKS = set("address article aside blockquote caption center dd details dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
OUT = set("aside audio button canvas datalist dialog footer form head iframe map menu nav noscript object search select svg template video".split())
RAW = set("iframe noembed noframes script style textarea title xmp".split())
BREAKS = {"br", "hr"}
#: An element that opens ends those of the first set, up to one of the second.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "td": ({"td", "th"}, {"table"}),
    "th": ({"td", "th"}, {"table"}),
    "tr": ({"tr"}, {"table"}),
    "tbody": ({"tbody", "thead", "tfoot"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot"}, {"table"}),
}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Elements of which neighbours are one repeated group whatever they hold; others if they share ALIKE of what they hold.
MEMBERS = {"li", "p", "tr", "dt", "dd"}
#: Words of class and id names. "header" is out unless a word of content stands beside it.
OUT_WORDS = set("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe signup sidebar aside widget related recommended share sharing social comment comments disqus reply replies respond menu nav navbar navigation breadcrumb breadcrumbs pagination pager footer masthead toolbar login search skip".split())
CONTENT_WORDS = set("article content entry main post story".split())
CONTENT_NAMES = set("article articlebody articlecontent content entry entrycontent main maincontent pagecontent post postbody postcontent story storybody storycontent".split())
OUT_ROLES = set("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar form".split())

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]{0,4096}"|'[^']{0,4096}')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""([^\s"'=<>/]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
NAME_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
SPACES = re.compile(r"[\x20\x09-\x0D]+")
FORM = re.compile(r"[a-z][a-z0-9.]*[!(]|[#)+]")


def _named(attributes: str) -> tuple[bool, int]:
    """Whether an element is out by its attributes, and the level of content that they name."""
    out, level, words, names = False, 0, [], []
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), unescape(m[2] or m[3] or m[4] or "")
        if name == "hidden" or name == "style" and re.search(r"display\s*:\s*none", value):
            out = True
        elif name == "role":
            role = value.strip().lower()
            out, level = out or role in OUT_ROLES, max(level, {"article": 3, "main": 2}.get(role, 0))
        elif name == "itemprop" and value.strip().lower() == "articlebody":
            level = 3
        elif name in ("class", "id"):
            for part in value.split():
                found = [w.lower() for w in NAME_WORD.findall(part)]
                names.append("".join(found))
                words += [w for i, w in enumerate(found) if not i or found[i - 1] not in ("with", "has", "no", "without")]
    if any(n in CONTENT_NAMES for n in names):
        level = max(level, 1)
    held = set(words)
    return out or bool(held & OUT_WORDS) or "header" in held and not held & CONTENT_WORDS, level


class Leaf:
    """A place of text in a page's form."""

    __slots__ = ("level", "same", "at")
    form = "#"

    def __init__(self, level: int) -> None:
        self.level, self.same, self.at = level, None, -1


class Element:
    __slots__ = ("tag", "sig", "out", "level", "kids", "form", "many", "shown")

    def __init__(self, tag: str, sig: str, out: bool, level: int, shown: bool) -> None:
        self.tag, self.sig, self.out, self.level, self.shown = tag, sig, out, level, shown
        self.kids: list = []
        self.form, self.many = "", False


def _same(a: Element, b: Element) -> None:
    """b has a's form: its leaves are a's."""
    work = [(a, b)]
    while work:
        for x, y in zip(*(e.kids for e in work.pop()), strict=True):
            if isinstance(y, Leaf):
                y.same = x
            else:
                work.append((x, y))


def read(html: str) -> tuple[str, list[tuple[int, int, str, int]]]:
    """The form of a page, and its texts outside what is out: (place in the form, level, text, characters in links)."""
    root = Element("", "", False, 0, True)
    stack, blocks, pieces, link, linked = [root], [], [], 0, 0

    def flush() -> None:
        nonlocal pieces, linked
        if pieces:
            text = SPACES.sub(" ", "".join(pieces)).strip(" ")
            if text:
                holder = stack[-1]
                if not holder.kids or not isinstance(holder.kids[-1], Leaf):
                    holder.kids.append(Leaf(holder.level))
                blocks.append((holder.kids[-1], text, min(linked, len(text))))
            pieces, linked = [], 0

    def close() -> None:
        flush()
        e = stack.pop()
        above = stack[-1]
        if not e.shown:
            return
        if e.out:
            e.form = f"{e.sig}!"
        else:
            if not e.kids:
                above.kids.pop()
                return
            if len(e.kids) == 1 and isinstance(e.kids[0], Element) and e.kids[0].sig == e.sig and not (e.kids[0].out or e.kids[0].many):
                e.kids = e.kids[0].kids
            e.form = f"{e.sig}({''.join([k.form + '+' if isinstance(k, Element) and k.many else k.form for k in e.kids])})"
        before = above.kids[-2] if len(above.kids) > 1 else None
        if isinstance(before, Element) and before.form == e.form:
            _same(before, e)
            before.many = True
            above.kids.pop()

    def end(tags: set[str], until: set[str]) -> None:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in tags:
                while len(stack) > i:
                    close()
                return
            if stack[i].tag in until:
                return

    at, tokens = 0, TOKEN
    while True:
        m = tokens.search(html, at)
        text = html[at : m.start() if m else len(html)]
        if text and not stack[-1].out:
            piece = unescape(text) if "&" in text else text
            pieces.append(piece)
            if link:
                linked += len(piece)
        if m is None:
            break
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        closes = m[1] or m[4]
        if tag in RAW:
            if not closes:
                stop = re.compile(rf"</{tag}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(html, at)
                at = stop.end() if stop else len(html)
        elif closes:
            if tag == "a":
                link = 0
            elif tag in BLOCKS or tag in OUT:
                flush()
                end({tag}, {"ul", "ol"} if tag == "li" else {"table"} if tag in ("td", "th", "tr") else {"div", "article", "section", "td", "li"} if tag == "p" else set())
        elif tag == "a":
            link = 1
        elif tag in BREAKS:
            flush()
        elif tag == "body":
            end({"head"}, set())
        elif tag in BLOCKS or tag in OUT:
            flush()
            if tag in BLOCKS and stack[-1].tag == "head":
                close()
            if tag in BLOCKS and (stack[-1].tag == "p" or tag in HEADINGS and stack[-1].tag in HEADINGS):
                close()
            if tag in ENDS:
                end(*ENDS[tag])
            above = stack[-1]
            out, level = above.out, 0
            if not out:
                attributes = m[3] or m[6] or ""
                named, level = _named(attributes) if attributes.strip() else (False, 0)
                level = max(level, {"article": 3, "main": 2}.get(tag, 0))
                out = named and tag != "main" or tag in OUT or tag == "header" and not above.level
            shown = not above.out and len(stack) <= DEPTH
            e = Element(tag, tag + (f".{level}" if level and not out else ""), out, max(above.level, level), shown)
            if shown:
                above.kids.append(e)
            elif not out:  # below DEPTH: the texts are those of the element there
                e.kids = above.kids
            stack.append(e)
            link = 0
    while len(stack) > 1:
        close()
    flush()
    n, work = 0, [root]
    while work:
        top = work.pop()
        if isinstance(top, Leaf):
            top.at, n = n, n + 1
        else:
            work.extend(reversed(top.kids))
    found = []
    for leaf, text, links in blocks:
        level = leaf.level
        while leaf.same is not None:
            leaf = leaf.same
        found.append((leaf.at, level, text, links))
    return "".join(k.form + ("+" if isinstance(k, Element) and k.many else "") for k in root.kids), found


class Item:
    """A token of a wrapper with what it holds: a sequence, or (``mix``) any order of optional repeated items."""

    __slots__ = ("sig", "many", "opt", "mix", "kids", "slot")

    def __init__(self, sig: str, kids: list | None = None, many: bool = False, opt: bool = False, mix: bool = False) -> None:
        self.sig, self.kids, self.many, self.opt, self.mix, self.slot = sig, kids or [], many, opt, mix, -1

    def packed(self) -> list:
        return [self.sig, self.many + 2 * self.opt + 4 * self.mix, [k.packed() for k in self.kids]]

    @staticmethod
    def unpacked(p: list) -> Item:
        return Item(p[0], [Item.unpacked(k) for k in p[2]], bool(p[1] & 1), bool(p[1] & 2), bool(p[1] & 4))

    def __str__(self) -> str:
        inner = "" if self.sig == "#" or self.sig.endswith("!") else f"({''.join(map(str, self.kids))})" + "+" * self.mix
        return f"{self.sig}{inner}{['', '+', '?', '*'][self.many + 2 * self.opt]}"


def parsed(form: str) -> Item:
    """A page's form as a tree, nothing generalised."""
    root = Item("")
    stack = [root]
    for t in FORM.findall(form):
        if t == ")":
            stack.pop()
        elif t == "+":
            stack[-1].kids[-1].many = True
        else:
            item = Item(t[:-1] if t[-1] == "(" else t)
            stack[-1].kids.append(item)
            if t[-1] == "(":
                stack.append(item)
    return root


def _alike(a: Item, b: Item) -> float:
    """Share of common tokens below."""
    x, y = {k.sig for k in a.kids}, {k.sig for k in b.kids}
    return len(x & y) / len(x | y) if x or y else 1.0


def _settled(item: Item) -> Item:
    """Neighbours alike become one repeated group; repeated squares and overlong sequences become a mix."""
    kids: list[Item] = []
    for k in item.kids:
        if kids and kids[-1].sig == k.sig and (k.sig in MEMBERS or _alike(kids[-1], k) >= ALIKE):
            joined = merged(kids[-1], k)
            joined.many, joined.opt = True, kids[-1].opt and k.opt
            kids[-1] = joined
        else:
            kids.append(k)
    sigs = [k.sig for k in kids]
    square = any(sigs[i : i + p] == sigs[i + p : i + 2 * p] for p in (2, 3, 4) for i in range(len(sigs) - 2 * p + 1))
    item.kids = kids
    return _mixed(item) if item.mix or square or len(kids) > WIDTH else item


def _mixed(item: Item) -> Item:
    of: dict[str, Item] = {}
    for k in item.kids:
        of[k.sig] = merged(of[k.sig], k) if k.sig in of else k
    for k in of.values():
        k.many = k.opt = True
    item.kids, item.mix = list(of.values()), True
    return item


def general(form: Item) -> Item:
    """A page's form as a wrapper of its own: settled from the inside out."""
    form.kids = [general(k) for k in form.kids]
    return _settled(form)


def _aligned(a: list[Item], b: list[Item]) -> list[tuple[Item | None, Item | None]]:
    """The alignment of two sequences that agrees in most tokens."""
    if [x.sig for x in a] == [y.sig for y in b]:
        return list(zip(a, b, strict=True))
    n, m = len(a), len(b)
    best = [[0.0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            both = 1 + _alike(a[i], b[j]) + best[i + 1][j + 1] if a[i].sig == b[j].sig else -1.0
            best[i][j] = max(both, best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0
    while i < n or j < m:
        if i < n and j < m and a[i].sig == b[j].sig and best[i][j] == 1 + _alike(a[i], b[j]) + best[i + 1][j + 1]:
            out.append((a[i], b[j]))
            i, j = i + 1, j + 1
        elif j == m or i < n and best[i][j] == best[i + 1][j]:
            out.append((a[i], None))
            i += 1
        else:
            out.append((None, b[j]))
            j += 1
    return out


def merged(a: Item, b: Item) -> Item:
    """The wrapper of both."""
    item = Item(a.sig, None, a.many or b.many, a.opt or b.opt)
    if a.mix or b.mix:
        item.kids = a.kids + b.kids
        return _mixed(item)
    for x, y in _aligned(a.kids, b.kids):
        if x is not None and y is not None:
            item.kids.append(merged(x, y))
        else:
            item.kids.append(x or y)
            item.kids[-1].opt = True
    return _settled(item)


def numbered(wrapper: Item) -> Item:
    """The wrapper with its slots numbered in order."""
    n, work = 0, [wrapper]
    while work:
        top = work.pop()
        if top.sig == "#":
            top.slot, n = n, n + 1
        work.extend(reversed(top.kids))
    return wrapper


def _matched(items: list[Item], wrapper: Item) -> list[Item | None]:
    """For each token of a page's sequence the wrapper's, by the alignment that agrees most; a repeated one takes several."""
    if wrapper.mix:
        of = {k.sig: k for k in wrapper.kids}
        return [of.get(x.sig) for x in items]
    kids = wrapper.kids
    if [x.sig for x in items] == [k.sig for k in kids]:
        return list(kids)
    n, m = len(items), len(kids)
    # best[i][j]: the most that items from i on agree with kids from j on; kept decisions: 0 skip item, 1 skip kid, 2 take, 3 take and stay
    best = [[0.0] * (m + 1) for _ in range(n + 1)]
    how = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            ways = [(best[i][j + 1], 1), (best[i + 1][j], 0)]
            if items[i].sig == kids[j].sig:
                fit = 1 + _alike(items[i], kids[j])
                ways.append((fit + best[i + 1][j + 1], 2))
                if kids[j].many:
                    ways.append((fit + best[i + 1][j], 3))
            best[i][j], how[i][j] = max(ways)
    out, i, j = [], 0, 0
    while i < n:
        step = how[i][j] if j < m else 0
        if step == 1:
            j += 1
            continue
        out.append(kids[j] if step >= 2 else None)
        i, j = i + 1, j + (step == 2)
    return out


def assigned(form: str, wrapper: Item) -> list[int]:
    """For each place of text of a page's form the slot of the wrapper that it fills; -1 where it fills none."""
    out: list[int] = []
    work: list[tuple[Item, Item | None]] = [(parsed(form), wrapper)]
    while work:
        item, of = work.pop()
        if item.sig == "#":
            out.append(-1 if of is None else of.slot)
            continue
        below = _matched(item.kids, of) if of is not None else [None] * len(item.kids)
        work.extend(reversed(list(zip(item.kids, below, strict=True))))
    return out


def _slots(form: str, wrapper: str) -> list[int]:
    """assigned(), remembered by the worker."""
    known = worker_store("wrapper-slots")
    if len(known) > 20_000:
        known.clear()
    if (form, wrapper) not in known:
        trees = worker_store("wrapper-trees")
        if len(trees) > 2000:
            trees.clear()
        if wrapper not in trees:
            trees[wrapper] = numbered(Item.unpacked(json.loads(wrapper)))
        known[form, wrapper] = assigned(form, trees[wrapper])
    return known[form, wrapper]


def _forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        seen = dict.fromkeys((host, read(html or "")[0]) for host, html in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in seen], pa.string()) for c in range(2)], ["host", "form"])


def _folded(batches: Iterator[pa.RecordBatch], of_forms: bool) -> Iterator[pa.RecordBatch]:
    """Rows (host, bucket, form or wrapper) in order to one wrapper for each host and bucket, or for each host."""
    own, whole, out = None, None, []

    def done() -> None:
        out.append((*own, json.dumps(whole.packed(), separators=(",", ":"))))

    for batch in batches:
        for host, bucket, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            item = general(parsed(text)) if of_forms else Item.unpacked(json.loads(text))
            key = (host, bucket if of_forms else 0)
            if key != own:
                if own is not None:
                    done()
                own, whole = key, item
            else:
                whole = merged(whole, item)
    if own is not None:
        done()
    columns = list(zip(*out, strict=True)) if out else [[]] * 3
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.string()), strict=True)], ["host", "bucket", "wrapper"])


def with_host(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    host = F.regexp_extract(F.col(f"`{url_column}`").cast("string"), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#]*@)?([^/?#:@]*)", 1)
    return small_batches(pages).select(F.col(f"`{id_column}`").alias("page_id"), F.col(f"`{url_column}`").alias("url"), F.col(f"`{html_column}`").cast("string").alias("html"), F.coalesce(F.lower(host), F.lit("")).alias("host"))


def infer(pages: DataFrame) -> Kept:
    """pages: what with_host() returns. Rows (host, wrapper); see Item.packed for the wrapper."""
    forms = pages.select("host", "html").mapInArrow(_forms, "host string, form string").distinct()
    kind = "host string, bucket int, wrapper string"
    forms = forms.select("host", F.pmod(F.xxhash64("form"), F.lit(BUCKETS)).cast("int").alias("bucket"), "form")
    parts = forms.repartition("host", "bucket").sortWithinPartitions("host", "bucket", "form").mapInArrow(lambda it: _folded(it, True), kind)
    whole = parts.repartition("host").sortWithinPartitions("host", "bucket").mapInArrow(lambda it: _folded(it, False), kind)
    return Kept(whole.select("host", "wrapper"), "wrappers", counted=True)


def _filled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (host, html, wrapper): for each host and slot outside regions that are known as content, over the batch's pages."""
    kinds = {"host": pa.string(), "slot": pa.int32(), "pages": pa.int64(), "low": pa.int64(), "high": pa.int64(), "chars": pa.int64(), "links": pa.int64()}
    for batch in batches:
        total: dict[tuple, list[int]] = {}
        for host, html, wrapper in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            form, texts = read(html or "")
            if any(level for _, level, _, _ in texts):
                continue
            slots, page = _slots(form, wrapper), {}
            for at, _, text, links in texts:
                own = page.setdefault(slots[at], [[], 0, 0])
                own[0].append(text)
                own[1] += len(text)
                own[2] += links
            for slot, (parts, chars, links) in page.items():
                h = int.from_bytes(hashlib.blake2b("\n".join(parts).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)
                t = total.setdefault((host, slot), [0, h, h, 0, 0])
                t[:] = t[0] + 1, min(t[1], h), max(t[2], h), t[3] + chars, t[4] + links
        rows = [(*k, *t) for k, t in total.items() if k[1] >= 0]
        columns = zip(*rows, strict=True) if rows else [[]] * 7
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds.values(), strict=True)], list(kinds))


def template_slots(pages: DataFrame, wrappers: Kept) -> Kept:
    """Rows (host, template): the slots of a host that are no content, where the host has others."""
    rows = pages.join(wrappers.side(), "host").select("host", "html", "wrapper").mapInArrow(_filled, "host string, slot int, pages long, low long, high long, chars long, links long")
    slots = rows.groupBy("host", "slot").agg(F.sum("pages").alias("pages"), F.min("low").alias("low"), F.max("high").alias("high"), F.sum("chars").alias("chars"), F.sum("links").alias("links"))
    links, fixed = 2 * F.col("links") > F.col("chars"), (F.col("pages") >= FIXED_PAGES) & (F.col("low") == F.col("high"))
    kind = F.when(links, 0).when(fixed, 1).otherwise(2)  # a kind is template where the host has slots of a later one
    named = slots.withColumn("kind", kind).groupBy("host").agg(F.collect_list(F.struct("kind", "slot")).alias("all"), F.max("kind").alias("most"))
    template = F.transform(F.filter("all", lambda s: s["kind"] < F.col("most")), lambda s: s["slot"])
    return Kept(named.select("host", F.array_sort(template).alias("template")).filter("size(template) > 0"), "wrapper-templates", counted=True)


_TEXT = "page_id long, url string, text string, n_chars long"


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for html, wrapper, template in zip(*(batch.column(i).to_pylist() for i in range(2, 5)), strict=True):
            form, texts = read(html or "")
            slots, top = _slots(form, wrapper), max((level for _, level, _, _ in texts), default=0)
            template = set(template or ()) if not top else ()
            out.append("\n".join(text for at, level, text, _ in texts if level == top and slots[at] not in template))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    rows = with_host(pages, id_column, url_column, html_column)
    wrappers = infer(rows)
    template = template_slots(rows, wrappers)
    known = rows.join(wrappers.side(), "host").join(template.side(), "host", "left")
    return known.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html", "wrapper", "template").mapInArrow(_extracted, _TEXT)
