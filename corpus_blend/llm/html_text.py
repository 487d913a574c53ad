"""Main text of web pages by the consensus of their host.

Pages of a host come from few templates. Every page scores its own containers and votes for the
path (generalised tags and classes from the root down) of the best; Spark counts the votes of each
host; then every page is read again and its text taken from the containers on the winning path.
A page without such a container, or without a host, keeps its own best one.
"""

from __future__ import annotations

import html
import re
from collections import Counter

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpus_blend.llm.common import stage, text_slices

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)"
    r"|</(?P<close>[a-zA-Z][^\s/>]*+)[^>]*+>"
    r"""|<(?P<open>[a-zA-Z][^\s/>]*+)(?P<set>(?:[^>"']++|"[^"]*+"|'[^']*+')*+)>"""
    r"|<(?P<open2>[a-zA-Z][^\s/>]*+)(?P<set2>[^>]*+)>"
    r"|</?[a-zA-Z][^>]*+\Z",  # a tag that breaks off with the page
    re.S,
)
ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")

# What HTML says of its elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg math noembed noframes xmp".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table "
    "tbody td tfoot th thead tr ul".split()
)
CLOSED_BY_SAME = {  # an element of a group ends the open one of that group, inside these limits
    "li": (("li",), ("ul", "ol", "menu")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "option": (("option",), ("select",)),
}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

# What is never main text: by tag, by a word of the class or id, by role.
SKIPPED_TAGS = frozenset("nav footer aside form button select dialog menu head object canvas audio video map".split())
SKIPPED_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies "
    "consent gdpr notice notices notification alert newsletter subscribe subscription signup login comment comments "
    "commentlist respond disqus sidebar menu nav navbar navigation breadcrumb breadcrumbs footer masthead share "
    "sharing social related recommended popup modal overlay toolbar pagination pager widget widgets".split()
)
SKIPPED_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert menu menubar toolbar".split())
CONTAINERS = frozenset("body article main section div td".split())
MAIN_TAGS = frozenset("article main".split())
MAIN_WORDS = frozenset("article content post entry story main text body".split())
WORD = re.compile(r"[a-zA-Z]+")
NUMBER = re.compile(r"\d+")

# A form, or a mere word of a class or id, may also name what wraps the article: SOFT. Such an element
# is read after all if it holds most of the page's text; see ``Page._wrappers``.
KEEP, SKIP, HEADINGS_ONLY, SOFT = 0, 1, 2, 3
MODIFIER = re.compile(r"(?:has|no|with|without)[-_]", re.I)
COMMENT_WORDS = frozenset("comment comments commentlist respond disqus".split())
STORY_WORDS = MAIN_WORDS - {"main", "body"}
LONG = 500  # characters outside links that speak for an article without a title or a name


class Page:
    """The elements and text blocks of a page, in order.

    ``parent``, ``tag``, ``path`` and ``good`` are by element; ``path`` is a hash of its generalised
    tags and classes from the root. ``blocks`` are ``(element, text, characters in links)`` of what
    may be main text.
    """

    def __init__(self, source: str):
        self.lenient = False
        self._wraps: frozenset[int] = frozenset()
        self._begin(source)
        if self._soft and (found := self._wrappers()):
            self._reopen(source, found)
        if not self.blocks and "form" in self.tag:  # the page may be wrapped whole in a form
            self.lenient = True
            self._begin(source)

    def _reopen(self, source: str, wrappers: set[int]):
        self._wraps |= wrappers
        self._begin(source)

    def _begin(self, source: str):
        self.parent, self.tag, self.path, self.good, self.state = [-1], [""], [0], [1.0], [KEEP]
        self.named, self.root = [False], [0]  # a name of main text; the innermost soft skip around
        self._soft: dict[int, list[int]] = {}  # soft skip -> characters, those in links, signs of an article, titles
        self._commented: set[int] = set()
        self.blocks: list[tuple[int, str, int]] = []
        self._text: list[str] = []
        self._linked = 0
        self._links = 0
        self._open: Counter = Counter()
        self._stack = [0]
        self._read(source)

    def _read(self, source: str):
        at, end = 0, len(source)
        while at < end:
            found = TOKEN.search(source, at)
            self._add(source[at : found.start() if found else end])
            if not found:
                break
            at = found.end()
            if found["close"]:
                self._close(found["close"].lower())
            elif tag := found["open"] or found["open2"]:
                tag = tag.lower()
                settings = found["set"] or found["set2"] or ""
                if tag in RAW and not settings.endswith("/"):
                    # What is inside is no markup; it ends with its own closing tag only.
                    last = re.compile(rf"</{re.escape(tag)}\b[^>]*+>", re.I).search(source, at)
                    at = last.end() if last else end
                    self._add(" ")
                else:
                    self._start(tag, settings)
        self._flush()

    def _add(self, text: str):
        top = self._stack[-1]
        if text and self.state[top] == SOFT:
            n = len(text.strip())
            weight = self._soft[self.root[top]]
            weight[0] += n
            weight[1] += n if self._links else 0
        elif text and self.state[top] == KEEP:
            if "&" in text:
                text = html.unescape(text)
            self._text.append(text)
            if self._links:
                self._linked += len(text.strip())

    def _wrappers(self) -> set[int]:
        """Soft skips that are layout: they hold over half of the text outside links, what is kept without
        them is less than a quarter of theirs, their own text is mostly not links, and a title, an
        article, its usual names or sheer length speak for an article. Comments need the title."""
        inner = {r: list(v) for r, v in self._soft.items()}
        for r in sorted(inner, reverse=True):  # an inner one comes later
            if outer := self.root[self.parent[r]]:
                for i, n in enumerate(inner[r]):
                    inner[outer][i] += n
        kept = sum(len(text) - linked for _, text, linked in self.blocks)
        whole = kept + sum(n - linked for n, linked, _, _ in self._soft.values())
        found = set()
        for r, (n, linked, signs, titles) in inner.items():
            free = n - linked
            proof = titles if r in self._commented else signs or titles or free >= LONG
            if proof and 2 * free > whole and 4 * kept < free and 2 * linked <= n:
                found.add(r)
        return found

    def _flush(self):
        if self._text:
            text = " ".join("".join(self._text).split())
            if text:
                self.blocks.append((self._stack[-1], text, self._linked))
            self._text, self._linked = [], 0

    def _start(self, tag: str, settings: str):
        if tag in BLOCKS:
            self._flush()
            if tag not in ("html", "body") and self._open["p"]:
                self._end_until(("p",), ("td", "th", "article", "section", "div", "li", "button", "object"))
        elif tag == "br":
            self._add(" ")
        if tag in VOID:
            return
        if tag in CLOSED_BY_SAME:
            self._end_until(*CLOSED_BY_SAME[tag])
        if settings.endswith("/") and tag not in BLOCKS and tag != "a":
            return
        above = self._stack[-1]
        known = {}
        if settings.strip():
            for name, *values in ATTRIBUTE.findall(settings):
                known.setdefault(name.lower(), "".join(values))
        classes = known.get("class", "")
        label = tag if not classes else f"{tag}.{'.'.join(sorted(set(NUMBER.sub('#', classes).split())))}"
        names = [n for n in f"{classes} {known.get('id', '')}".split() if not MODIFIER.match(n)] if known else ()
        words = {w.lower() for w in WORD.findall(" ".join(names))}
        self.parent.append(above)
        self.tag.append(tag)
        self.path.append(xxhash.xxh64_intdigest(label, self.path[above]))
        self.good.append((1.5 if tag in MAIN_TAGS else 1.0) * (1.25 if words & MAIN_WORDS else 1.0))
        self.named.append(bool(words & STORY_WORDS))
        state = self._state(tag, words, known, self.state[above])
        self.state.append(state)
        at = len(self.tag) - 1
        starts = state == SOFT and (words & SKIPPED_WORDS or tag == "form" or not self.root[above])
        self.root.append(at if starts else self.root[above] if state == SOFT else 0)
        if state == SOFT:
            weight = self._soft.setdefault(self.root[at], [0, 0, 0, 0])
            weight[2] += tag in MAIN_TAGS or bool(words & STORY_WORDS and not words & SKIPPED_WORDS)
            weight[3] += tag == "h1"
            if starts and words & COMMENT_WORDS:
                self._commented.add(at)
        self._stack.append(at)
        self._open[tag] += 1
        self._links += tag == "a"

    def _state(self, tag: str, words, known: dict, above: int) -> int:
        if above == SKIP:
            return SKIP
        if above == SOFT and tag in MAIN_TAGS and not words & SKIPPED_WORDS:
            # Inside an article they are its comments or related ones.
            return SOFT if self._open["article"] or self._open["main"] else KEEP
        if tag in ("html", "body") or tag in MAIN_TAGS:
            return above
        if (
            (tag in SKIPPED_TAGS and tag != "form")
            or known.get("role", "").lower() in SKIPPED_ROLES
            or "hidden" in known
            or known.get("aria-hidden", "").lower() == "true"
            or re.search(r"display\s*:\s*none", known.get("style", ""), re.I)
        ):
            return SKIP
        if above == SOFT:
            return SOFT
        wraps = len(self.tag) - 1 in self._wraps
        if not wraps and (words & SKIPPED_WORDS or (tag == "form" and not self.lenient)):
            return SOFT
        if tag in HEADINGS and above == HEADINGS_ONLY:
            return KEEP
        if tag == "header" or ("header" in words and tag not in HEADINGS):
            # An article's own header may hold its title; the page's header does not.
            own = self._open["article"] or self._open["main"] or self.named[self._stack[-1]]
            return HEADINGS_ONLY if own else SKIP
        return above

    def _close(self, tag: str):
        if tag in BLOCKS:
            self._flush()
        if tag == "br":
            self._add(" ")
        if self._open[tag]:
            while self._pop() != tag:
                pass

    def _pop(self) -> str:
        if self.tag[self._stack[-1]] in BLOCKS:
            self._flush()
        tag = self.tag[self._stack.pop()]
        self._open[tag] -= 1
        self._links -= tag == "a"
        return tag

    def _end_until(self, ends: tuple, limits: tuple):
        """End the innermost open element of ``ends``, unless one of ``limits`` is further in."""
        if not any(self._open[t] for t in ends):
            return
        for depth in range(len(self._stack) - 1, 0, -1):
            tag = self.tag[self._stack[depth]]
            if tag in ends:
                self._flush()
                while len(self._stack) > depth:
                    self._pop()
                return
            if tag in limits:
                return

    def best(self) -> tuple[int, float]:
        """The container whose blocks speak most for main text; 0, the root, if there is none.

        A block counts by its characters less three times those in links: in full for the nearest
        container around it, and half as much for each one further out.
        """
        scores: dict[int, float] = {}
        for element, text, linked in self.blocks:
            worth = len(text) - 3.0 * linked
            while element > 0 and worth >= 0.5:
                if self.tag[element] in CONTAINERS:
                    scores[element] = scores.get(element, 0.0) + worth * self.good[element]
                    worth /= 2
                element = self.parent[element]
        if not scores:
            return 0, 0.0
        top = max(scores, key=lambda e: (scores[e], -e))
        return self._around(top), scores[top]

    def _around(self, chosen: int) -> int:
        """The outermost element around it that adds text of the same article; else itself.

        Title, lead and further sections lie beside the richest container. An element named as main text
        counts if what it adds is mostly not links; any other, the body apart, if it adds the title that
        is missing so far, or paragraphs of a tenth of the text at least. Where other articles would come
        in, or links into a main text, the climb ends.
        """
        levels = self._levels(chosen)
        inside, at = chosen, self.parent[chosen]
        held, titled = levels[chosen].length, levels[chosen].titles
        added = _Added()
        while at > 0 and self.tag[at] not in ("body", "html"):
            added.take(levels[at])
            if added.articles:
                break
            mostly_text = 2 * added.links <= added.length
            if self.good[at] > 1:
                if not mostly_text:
                    break
                accepted = True
            else:
                title = added.titles and not titled
                accepted = mostly_text and 3 * added.prose >= 2 * added.length and (title or 10 * added.prose >= held)
                accepted = accepted and added.length > 0 and self.tag[at] in CONTAINERS
            if accepted:
                inside, held, titled, added = at, held + added.length, titled + added.titles, _Added()
            at = self.parent[at]
        return inside

    def _levels(self, chosen: int) -> dict[int, _Added]:
        """For an element and all around it: what its blocks add to those of the next one inside."""
        levels, at = {}, chosen
        while at >= 0:
            levels[at] = _Added()
            at = self.parent[at]
        known = {e: (e, False) for e in levels}
        for element, text, linked in self.blocks:
            way, at = [], element
            while at not in known:
                way.append(at)
                at = self.parent[at]
            level, other = known[at]
            for step in reversed(way):
                # inside the chosen element articles are its own
                other = other or (self.tag[step] == "article" and level != chosen)
                known[step] = level, other
            tag = self.tag[element]
            levels[level].block(len(text), linked, tag == "p" or tag in HEADINGS, tag == "h1", other)
        return levels

    def text(self, roots: set[int]) -> str:
        """The blocks inside any of these elements."""
        inside: dict[int, bool] = {}
        kept = []
        for element, text, _ in self.blocks:
            way, at = [], element
            while at not in inside:
                if at in roots or at <= 0:
                    inside[at] = at in roots
                    break
                way.append(at)
                at = self.parent[at]
            for step in way:
                inside[step] = inside[at]
            if inside[element]:
                kept.append(text)
        return "\n\n".join(kept)

    def outer_skips(self, skips: set[int]) -> set[int]:
        """These soft skips and those around them."""
        found = set()
        for r in skips:
            while r and r not in found:
                found.add(r)
                r = self.root[self.parent[r]]
        return found

    def on_path(self, path: int | None) -> set[int]:
        return {i for i, p in enumerate(self.path) if p == path and self.tag[i] in CONTAINERS}


class _Added:
    """What some blocks are made of."""

    def __init__(self):
        self.length = self.links = self.prose = self.titles = 0
        self.articles = False

    def block(self, length: int, links: int, prose: bool, title: bool, other_article: bool):
        self.length += length
        self.links += links
        self.prose += length - links if prose else 0
        self.titles += title
        self.articles |= other_article

    def take(self, other: _Added):
        self.length, self.links = self.length + other.length, self.links + other.links
        self.prose, self.titles = self.prose + other.prose, self.titles + other.titles
        self.articles |= other.articles


def extract(source: str, path: int | None = None) -> str:
    """Main text: from the containers on ``path`` if the page has any with text, else its own best.

    Where the host's pages found their text inside an element that is named like furniture, it is opened
    on this page too.
    """
    page = Page(source)
    chosen = page.on_path(path) if path is not None else set()
    if hidden := {page.root[e] for e in chosen if page.state[e] == SOFT}:
        page._reopen(source, page.outer_skips(hidden))
    return (page.text(chosen) if chosen else "") or page.text({page.best()[0]})


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _host(url_col: str):
    return F.lower(F.try_parse_url(F.col(f"`{url_col}`").cast("string"), F.lit("HOST")))


def host_paths(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``host, path, votes``: the container path that most pages of a host vote for. Ties go to the
    higher sum of scores, then to the smaller path. Each task counts its own pages' votes first."""

    def run(batches):
        for batch in batches:
            for part in text_slices(batch, "html"):
                found = [(p := Page(x.as_py())).best() + (p.path,) for x in part.column("html")]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("host"),
                        pa.array([_signed(paths[top]) if top else None for top, _, paths in found], pa.int64()),
                        pa.array([score for _, score, _ in found], pa.float64()),
                    ],
                    names=["host", "path", "score"],
                )

    rows = pages.select(_host(url_col).alias("host"), F.col(f"`{html_col}`").cast("string").alias("html"))
    rows = rows.where("host is not null and html is not null")
    votes = rows.mapInArrow(run, "host string, path bigint, score double").where("path is not null")
    counted = votes.groupBy("host", "path").agg(
        F.count(F.lit(1)).alias("votes"), F.sum(F.round("score").cast("bigint")).alias("score")
    )
    first = F.max(F.struct("votes", "score", (-F.col("path").cast("decimal(20,0)")).alias("order"), "path"))
    return counted.groupBy("host").agg(first.alias("top")).select("host", "top.path", "top.votes")


def extract_text(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html"
) -> DataFrame:
    """``id, url, text`` of every row.

    A null page is empty; a page without main text has text "". A null or broken url means no host,
    so the page's own best container counts. Repeated rows have equal texts and vote each. Other
    columns are not looked at.
    """
    winners = stage(host_paths(pages, url_col, html_col), "host-paths")
    rows = pages.select(
        F.col(f"`{id_col}`").cast("bigint").alias("id"),
        F.col(f"`{url_col}`").cast("string").alias("url"),
        F.coalesce(F.col(f"`{html_col}`").cast("string"), F.lit("")).alias("html"),
        _host(url_col).alias("host"),
    )
    # One narrow row per host: broadcast if its files are small, else crowded hosts are split.
    joined = rows.join(winners.select("host", "path"), "host", "left").select("id", "url", "html", "path")

    def run(batches):
        for batch in batches:
            for part in text_slices(batch, "html"):
                paths = [None if p is None else p % (1 << 64) for p in part.column("path").to_pylist()]
                texts = [extract(x.as_py(), p) for x, p in zip(part.column("html"), paths, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), part.column("url"), pa.array(texts, pa.string())], names=["id", "url", "text"]
                )

    return joined.mapInArrow(run, "id bigint, url string, text string")
