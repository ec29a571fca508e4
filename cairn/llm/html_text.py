"""Main text of HTML pages with site template removal.

A page becomes a flat list of balanced events. Structural rules leave out what is marked as no article (menus, headers,
footers, sidebars, notices, adverts, forms, scripts, comments); a form around the whole page loses its controls alone. Where the
page has an article or main part, the one that holds most of its text is read. The subtrees that are left are hashed and
counted per host in Spark, over pages that differ in their text, so that copies of one article count once; subtrees that recur
on a large share of a host's pages are its template and are deleted in the second reading. On a host of fewer than MIN_PAGES
differing pages there is too little to tell a template by, and only the rules decide.
"""

from __future__ import annotations

import html
import re
from collections import Counter

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm import common

MIN_PAGES = 10
SHARE_ARTICLE, SHARE_PAGE = 0.5, 0.3  # of a host's differing pages: within article or main, and on pages without either

_NAME = r"[a-zA-Z][^\s/>]*+"
_TAG = re.compile(
    rf"<(?:!--(?P<c>.*?)(?:--!?>|\Z)|!\[CDATA\[(?P<d>.*?)(?:\]\]>|\Z)|[!?][^>]*+(?:>|\Z)|/(?P<e>{_NAME})[^>]*+(?:>|\Z)"
    rf"|(?P<s>{_NAME})(?P<a>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|(?P<t>{_NAME})(?P<b>[^>]*+)(?P<x>>|\Z))",
    re.S,
)
_ATTR = re.compile(r"""\b(class|id|role|style|hidden|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?(?=[\s/"']|$)""", re.I)
_SPACES = re.compile(r"[ \t\r\n\f\v   \s]+")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noframes xmp noembed".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header "
    "hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
_ENDS_P = _BLOCK - frozenset("body head html title option optgroup caption tbody td tfoot th thead tr".split())
_OUT = frozenset(
    "audio aside button canvas datalist dialog embed footer frame frameset head iframe input map menu nav noembed noframes noscript object progress script "
    "select style svg template textarea title video".split()
)
_PAGE_PART = frozenset("article main header footer nav h1".split())  # a form around one of these is the page's, not a form of it
_CLOSES = {  # a start tag that ends an open one, up to the nearest of the named containers
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}), "body": ({"head"}, set()),
    "tbody": ({"tbody", "thead", "tfoot"}, {"table"}), "tfoot": ({"tbody", "thead", "tfoot"}, {"table"}), "thead": ({"tbody", "thead"}, {"table"}),
}
_P_SCOPE = frozenset("article aside blockquote body button caption dd div figure footer form header html li main nav object section table td th".split())
_BAD = frozenset(
    "ad ads adbox adslot advert adverts advertisement advertising alert banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies disqus "
    "footer gdpr login masthead menu modal nav navbar navigation newsletter notice notices notification overlay pager pagination popup promo promotion related recommended "
    "recommendations replies reply respond search share sharebar sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar widget".split()
)
_BAD_ROLE = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search status toolbar".split())
_BESIDE = frozenset(
    "area articles bar bottom box button buttons container content count form group header heading icon icons inline inner item items left link links list "
    "module outer panel posts right row section signup slot stories title top unit widget wrap wrapper".split()
)  # with one of _BAD they make a name such as related-posts; with other words, as in related-work, the name says nothing
_ENDS = ("navbar", "topnav", "sidenav", "subnav", "mainnav", "sitenav", "menu", "footer", "sidebar", "adbox")
_STARTS = ("advert", "breadcrumb", "cookie", "newsletter", "sidebar", "sponsor")
_PART = re.compile(r"[^a-z0-9]+")


def _unwanted(tag: str, attrs: str, inside: bool) -> bool:
    """Whether an element is no part of the article; inside: within article or main."""
    if tag in _OUT or (tag == "header" and not inside):
        return True
    if not attrs or tag in ("html", "body", "main"):
        return False
    for m in _ATTR.finditer(attrs):
        name, value = m[1].lower(), (m[2] or "").strip("\"'").lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and "display:none" in value.replace(" ", "")):
            return True
        if name == "role" and value in _BAD_ROLE:
            return True
        if name in ("class", "id"):
            for word in value.split():
                got = [x for x in _PART.split(word) if x and not x.isdigit()]
                if tag == "article":
                    if "comment" in got or "comments" in got:
                        return True
                elif inside:
                    if not _BAD.isdisjoint(got) and all(x in _BAD or x in _BESIDE for x in got) or "".join(got) in _BAD:
                        return True
                elif not _BAD.isdisjoint(got) or "header" in got:
                    return True
                elif any(g.endswith(_ENDS) or g.startswith(_STARTS) for g in got):
                    return True
    return False


def events(page: str) -> list[tuple[int, str, str]]:
    """(0, tag, attributes) at a start, (1, text, '') for text, (2, tag, '') at an end; every start has its end, in order."""
    out: list[tuple[int, str, str]] = []
    stack: list[str] = []
    opened: Counter = Counter()  # how many of a tag are open, so that the stack is searched only where one is found

    def close(to: int) -> None:
        while len(stack) > to:
            tag = stack.pop()
            opened[tag] -= 1
            out.append((2, tag, ""))

    at, n = 0, len(page)
    while at < n:
        m = _TAG.search(page, at)
        if not m:
            out.append((1, page[at:], ""))
            break
        if m.start() > at:
            out.append((1, page[at : m.start()], ""))
        at = m.end()
        if m["d"] is not None:
            out.append((1, m["d"].replace("&", "&amp;"), ""))
        elif m["e"]:
            tag = m["e"].lower()
            if opened[tag]:
                k = len(stack) - 1
                while stack[k] != tag:
                    k -= 1
                close(k)
            elif tag == "p":
                out += [(0, "p", ""), (2, "p", "")]
            elif tag == "br":
                out += [(0, "br", ""), (2, "br", "")]
        elif m["s"] or m["t"]:
            if m["t"] and not m["x"]:
                break  # the page ends inside a tag
            tag, attrs = (m["s"] or m["t"]).lower(), m["a"] or m["b"] or ""
            if tag in _ENDS_P and opened["p"]:
                _close_p(stack, close)
            if opened["head"] and (tag in _ENDS_P or tag == "body"):
                close(stack.index("head"))
            ends = _CLOSES.get(tag)
            if ends and any(opened[x] for x in ends[0]):
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k] in ends[0]:
                        close(k)
                        break
                    if stack[k] in ends[1]:
                        break
            out.append((0, tag, attrs))
            if tag in _VOID or (attrs.endswith("/") and tag in ("svg", "path", "use")):
                out.append((2, tag, ""))
            elif tag in _RAW:
                end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(page, at)
                out += [(1, page[at : end.start() if end else n], ""), (2, tag, "")]
                at = end.end() if end else n
            else:
                stack.append(tag)
                opened[tag] += 1
    close(0)
    return out


def _close_p(stack: list[str], close) -> None:
    for k in range(len(stack) - 1, -1, -1):
        if stack[k] == "p":
            close(k)
            return
        if stack[k] in _P_SCOPE:
            return


class Page:
    """Events of a page, which of them count, and the hash of every counted subtree by its start event."""

    def __init__(self, source: str) -> None:
        self.events = events(source)
        self._pair()
        inside_of, self.has_main = self._scopes()
        self.keep: list[bool] = []
        skip = 0
        for k, (kind, tag, attrs) in enumerate(self.events):
            if kind == 0:
                if skip or self._unwanted(k, inside_of[k]):
                    skip += 1
            self.keep.append(not skip and (inside_of[k] or not self.has_main))
            if kind == 2 and skip:
                skip -= 1

    def _pair(self) -> None:
        """The end of each start, and the forms that hold a part of the page and not just fields."""
        self.end: dict[int, int] = {}
        self.page_forms: set[int] = set()
        starts: list[int] = []
        forms: list[int] = []
        for k, (kind, tag, _) in enumerate(self.events):
            if kind == 0:
                starts.append(k)
                if tag == "form":
                    forms.append(k)
                elif forms and tag in _PAGE_PART:
                    self.page_forms.update(forms)
                    forms.clear()
            elif kind == 2:
                at = starts.pop()
                self.end[at] = k
                if forms and forms[-1] == at:
                    forms.pop()

    def _unwanted(self, k: int, inside: bool) -> bool:
        _, tag, attrs = self.events[k]
        if tag == "form":
            return k not in self.page_forms
        if tag in ("label", "fieldset", "legend") and self.page_forms:
            return True
        return _unwanted(tag, attrs, inside)

    def _scopes(self) -> tuple[list[bool], bool]:
        """Whether each event lies in the part of the page that counts, and whether the page marks such a part.

        Of outermost article and main elements that with the most text is taken, and others of at least half as much. A main
        that holds an article with half of its text or more is left for the article; else its articles are teasers and go.
        """
        spans: list[tuple[int, int, int, str]] = []  # start, end, signs of text, tag
        open_: list[list] = []
        size = skip = depth = 0
        for k, (kind, tag, attrs) in enumerate(self.events):
            if kind == 0:
                depth += 1
                if skip or self._unwanted(k, bool(open_)):
                    skip += 1
                elif tag in ("article", "main") or ("role" in attrs and re.search(r"role\s*=\s*[\"']?main\b", attrs)):
                    open_.append([k, depth, size, "article" if tag == "article" else "main"])
            elif kind == 1:
                size += 0 if skip else len(tag.split())
            else:
                if skip:
                    skip -= 1
                elif open_ and open_[-1][1] == depth:
                    at, _, before, name = open_.pop()
                    spans.append((at, k, size - before, name))
                depth -= 1
        if not any(n for _, _, n, _ in spans):
            return [False] * len(self.events), False
        gone: list[tuple[int, int, int, str]] = []
        spans.sort()
        mains = [s for s in spans if s[3] == "main"]
        parts = [s for s in spans if s[3] == "article"]
        outer: list[tuple[int, int, int, str]] = []
        for s in parts:
            if not outer or s[0] > outer[-1][1]:
                outer.append(s)
        chosen = outer
        if mains:
            best = max(mains, key=lambda s: (s[2], -s[0]))
            held = [s for s in outer if best[0] < s[0] < best[1]]
            most = max((s[2] for s in held), default=0)
            if 2 * most >= best[2] and most:
                chosen = held
            elif 2 * best[2] >= max((s[2] for s in outer), default=0):
                chosen, gone = [best], held
        most = max(s[2] for s in chosen)
        chosen = [s for s in chosen if 2 * s[2] >= most]
        inside = [False] * len(self.events)
        for at, end, _, _ in chosen:
            inside[at : end + 1] = [True] * (end + 1 - at)
        for at, end, _, _ in gone:
            inside[at : end + 1] = [False] * (end + 1 - at)
        return inside, True

    def hashes(self) -> dict[int, int]:
        """Start event -> hash of tag, class-free structure and text of each kept subtree that has text."""
        got: dict[int, int] = {}
        parts: list[list[str]] = [[]]
        starts: list[int] = []
        for k, (kind, x, _) in enumerate(self.events):
            if not self.keep[k]:
                continue
            if kind == 0:
                parts.append([])
                starts.append(k)
            elif kind == 1:
                t = _SPACES.sub(" ", x).strip()
                if t:
                    parts[-1].append(t)
            elif starts:
                own = parts.pop()
                at = starts.pop()
                if own:
                    h = xxhash.xxh64_intdigest(x + "\0" + "\1".join(own))
                    got[at] = h - (1 << 64) if h >> 63 else h
                    parts[-1].append(f"{h:x}")
        return got

    def text(self, template: frozenset | set = frozenset()) -> str:
        """Blocks of the kept text in page order, without subtrees whose hash is in template."""
        gone = {k for k, h in self.hashes().items() if h in template} if template else ()
        blocks: list[str] = []
        buf: list[str] = []
        skip = 0

        def flush() -> None:
            t = _SPACES.sub(" ", html.unescape("".join(buf))).strip()
            if t:
                blocks.append(t)
            buf.clear()

        for k, (kind, x, _) in enumerate(self.events):
            if kind == 0 and (skip or k in gone):
                skip += 1
            if kind == 1:
                if not skip and self.keep[k]:
                    buf.append(x)
            elif x in _BLOCK:
                flush()
            elif x == "br":
                buf.append(" ")
            if kind == 2 and skip:
                skip -= 1
        flush()
        return "\n".join(blocks)


# -- Spark
def host_of(url: str) -> F.Column:
    """Host of a url column in lower case, '' if there is none."""
    return F.coalesce(F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit(""))


def templates(pages: DataFrame, url_col: str = "url", html_col: str = "html", min_pages: int = MIN_PAGES, share: float = SHARE_PAGE, share_article: float = SHARE_ARTICLE) -> DataFrame:
    """host, hashes: subtrees that recur on at least min_pages of a host's differing pages and on that share of them.

    A host's list is bounded by the subtrees of a page over the share. Counting is by (host, subtree), so a host that
    holds a third of all pages is spread over all tasks.
    """

    def run(batches):
        for b in batches:
            host, h, root, main = [], [], [], []
            for name, source in zip(b.column("host").to_pylist(), b.column("html").to_pylist()):
                p = Page(source or "")
                own = set(p.hashes().values())
                mark = xxhash.xxh64_intdigest(",".join(map(str, sorted(own)))) >> 1
                host += [name] * (len(own) + 1)
                h += [None, *own]  # null: the page itself
                root += [mark] * (len(own) + 1)
                main += [p.has_main] * (len(own) + 1)
            yield pa.RecordBatch.from_arrays([pa.array(host, pa.string()), pa.array(h, pa.int64()), pa.array(root, pa.int64()), pa.array(main, pa.bool_())], names=["host", "h", "root", "main"])

    rows = pages.select(host_of(url_col).alias("host"), F.col(html_col).alias("html")).mapInArrow(run, "host string, h long, root long, main boolean")
    # pages with the same kept subtrees are copies and count once
    seen = rows.groupBy("host", "h", "root").agg(F.min("main").alias("main")).groupBy("host", "h").agg(F.count(F.lit(1)).alias("n"), F.min("main").alias("main"))
    seen = common.cut(seen.filter(F.col("n") >= min_pages), "subtrees")
    total = seen.filter("h is null").select("host", F.col("n").alias("pages"))
    often = seen.filter("h is not null").join(total, "host").filter(F.col("n") >= F.col("pages") * F.when(F.col("main"), share_article).otherwise(share))
    return common.cut(often.groupBy("host").agg(F.collect_list("h").alias("hashes")), "templates")


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id, url, text, n_chars (code points) of every page; text is empty for null, empty and text-free pages.

    Null or broken urls share the host ''. Repeated pages come out each. Whole pages are read; nothing is capped.
    """
    common.ship(pages.sparkSession)
    found = templates(pages, url_col, html_col)
    kind = pages.schema[id_col].dataType.simpleString()
    src = pages.select(F.col(id_col).alias("__id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    hosts = src.withColumn("host", host_of("url"))
    joined = common.salted_join(hosts, found, "host", common.hot_keys(hosts.select("host"), "host"))

    def run(batches):
        for b in batches:
            texts = [Page(s or "").text(frozenset(t or ())) for s, t in zip(b.column("html").to_pylist(), b.column("hashes").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("__id"), b.column("url"), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=["__id", "url", "text", "n_chars"])

    return joined.select("__id", "url", "html", "hashes").mapInArrow(run, f"__id {kind}, url string, text string, n_chars long").withColumnRenamed("__id", id_col)
