"""Main text of web pages by consensus host paths.

Every page is read into blocks of text, each under a path of containers. A path is generalised:
tag names with class and id, digits taken out. Pages of a host vote: each page scores its
containers by the share of its prose, text that is not links, that they hold, and the scores are added per
host and path in Spark. The path that wins a host is then used to extract all its pages again;
a page without that path falls back to its own best container.

Text of navigation, headers, footers, sidebars, notices, adverts, forms, scripts, styles and
reader comments is never part of a page's text, inside the winning container or not. Captions,
formulas, drawings' labels and what stands in for an object are text like any other. Character
references are decoded once; white space inside a block becomes one space, blocks are trimmed,
empty ones left out, and the rest joined by line ends in page order. A line break is white
space. A tag that is cut off at the end of the page is no text. Comments and declarations are
skipped.

Null html is an empty page and has empty text. A page without a host (null or odd url) votes
with the others without one. Rows without an identifier and repeated rows are pages like any
others; other columns are ignored. Pages of any size are read whole.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tillproof.llm.common import map_batches
from tillproof.scale import written

# Elements of the markup language by what they do.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = ("script", "style", "noscript", "template", "textarea", "title", "iframe", "select")
NOT_CONTENT = frozenset("nav header footer aside form button dialog menu head fieldset".split()) | set(RAW)
BLOCKS = frozenset(
    "address article aside blockquote body center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 "
    "h5 h6 head header hr html legend li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
CONTAINERS = frozenset("article body div main section td".split())
# An opening tag of the first kind ends an open element of the second, as far as the third.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"})}
# Words at the start of a class or id, or after a word for a place, that mark what is not the article.
AVOIDED = (r"ads?|advert\w*|adsense|adslot|banner|sponsor\w*|promo\w*|nav\w*|menu\w*|breadcrumbs?|header|masthead|footer|"
           r"side-?bar|aside|widgets?|related|recommend\w*|share|sharing|social|cookies?\w*|consent|notices?|alerts?|gdpr|"
           r"pop-?up|modal|overlay|subscribe\w*|subscription|newsletter|sign-?up|login|search\w*|form|comments?|commentlist|"
           r"comment-?section|replies|reply|respond|disqus\w*|pagination|pager|toolbar|skip-?link|hidden")
PLACES = "site|page|main|top|left|right|bottom|global|user|reader|article|post|primary|secondary|contact|sticky|mobile"
AVOID = re.compile(rf"(?:(?:{PLACES})[-_]?)?(?:{AVOIDED})(?:[-_].*)?", re.S)
# An article is left out only as one of the readers' own, or as a teaser.
AVOID_ARTICLE = re.compile(r"(?:(?:user|reader)[-_]?)?(?:comments?|repl(?:y|ies)|related|teaser|promo\w*|sponsor\w*|ads?)(?:[-_].*)?", re.S)
ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu".split())
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)"
    r"|<(?=[A-Za-z/])[^>]*(?:>|\Z)|([^<]+|<)", re.S)
ATTRIBUTE = re.compile(r"([A-Za-z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
VALUE = re.compile(r"=\s*(?:\"[^\"]*\"|'[^']*'|\S+)")
SPACE = re.compile(r"\s+")
ROOT = "/"
DIRECT, TITLE, NAMED = 0.3, 0.3, 0.1


def flags(attributes: str) -> set[str]:
    """Attributes without a value."""
    return set(VALUE.sub(" ", attributes).lower().split()) if attributes else set()


class Page:
    """The blocks of a page: (containers from the outside in, text, characters inside links)."""

    def __init__(self, source: str):
        self.blocks: list[tuple[tuple[int, ...], str, int]] = []
        self.paths: list[str] = [ROOT]  # of each container, by number
        # Open elements: tag, number of its container or of the one around it, whether it is left out.
        self.open: list[tuple[str, int, bool]] = []
        self.chain: list[int] = [0]
        self.parts: list[str] = []
        self.linked = 0
        self.title: tuple[int, ...] | None = None  # the containers of the first main heading
        self._read(source)
        self._flush()

    def _read(self, source: str) -> None:
        at = 0
        while at < len(source):
            found = TOKEN.match(source, at)
            at = found.end()
            closing, tag, attributes, text = found.group(1, 2, 3, 4)
            if text is not None:
                self._text(text)
            elif tag is not None:
                tag = tag.lower()
                if closing:
                    self._close(tag)
                    continue
                if at == len(source) and source[-1] != ">":
                    break  # a tag that is cut off
                if tag in RAW and not attributes.rstrip().endswith("/"):
                    self._break(tag)
                    end = re.compile(rf"</{tag}\s*>|\Z", re.I).search(source, at)
                    at = end.end()
                else:
                    self._start(tag, attributes)

    def _break(self, tag: str) -> None:
        if tag in BLOCKS or tag in RAW:
            self._flush()

    def _text(self, text: str) -> None:
        if not (self.open and self.open[-1][2]):
            self.parts.append(text)
            if any(e[0] == "a" for e in self.open[-6:]):
                self.linked += len(text)

    def _flush(self) -> None:
        text = SPACE.sub(" ", html.unescape("".join(self.parts))).strip()
        if text:
            self.blocks.append((tuple(self.chain), text, self.linked))
        self.parts, self.linked = [], 0

    def _start(self, tag: str, attributes: str) -> None:
        if tag == "br":
            self.parts.append(" ")
        if tag in BLOCKS:
            self._flush()
            while self.open and self.open[-1][0] == "p":
                self._pop()
            # A paragraph left open below formatting ends with the next block, too.
            names = [e[0] for e in self.open]
            if "p" in names:
                last = len(names) - 1 - names[::-1].index("p")
                if not any(n in BLOCKS for n in names[last + 1:]):
                    del self.open[last:]
        if tag in CLOSES:
            ended, fence = CLOSES[tag]
            names = [e[0] for e in self.open]
            for i in range(len(names) - 1, -1, -1):
                if names[i] in fence:
                    break
                if names[i] in ended:
                    while len(self.open) > i:
                        self._pop()
                    break
        if tag in VOID:
            return
        named = {m[0].lower(): m[1] or m[2] or m[3] for m in ATTRIBUTE.findall(attributes)} if attributes else {}
        mark = f"{named.get('class', '')} {named.get('id', '')}".strip()
        avoid = AVOID_ARTICLE if tag == "article" else AVOID
        left_out = (bool(self.open) and self.open[-1][2]) or tag in NOT_CONTENT or named.get("role", "").lower() in ROLES or (
            tag not in ("html", "body", "main") and any(avoid.fullmatch(w) for w in mark.lower().split())
        ) or "hidden" in flags(attributes)
        if attributes.rstrip().endswith("/") and tag not in CONTAINERS:
            return
        number = -1
        if tag in CONTAINERS and not left_out:
            number = len(self.paths)
            step = tag + "".join("." + re.sub(r"\d+", "#", w) for w in sorted(mark.lower().split()))
            self.paths.append(self.paths[self.chain[-1]].rstrip("/") + "/" + step)
            self.chain.append(number)
        self.open.append((tag, number, left_out))
        if tag == "h1" and not left_out and self.title is None:
            self.title = tuple(self.chain)

    def _pop(self) -> None:
        tag, number, _ = self.open.pop()
        if number >= 0:
            self.chain.pop()

    def _close(self, tag: str) -> None:
        if tag in BLOCKS:
            self._flush()
        elif tag == "br":
            self.parts.append(" ")
        names = [e[0] for e in self.open]
        if tag in names[::-1]:
            # Formatting does not end across a block; a block ends all that is open inside it.
            i = len(names) - 1 - names[::-1].index(tag)
            if tag in BLOCKS or not any(n in BLOCKS for n in names[i + 1:]):
                while len(self.open) > i:
                    self._pop()

    def scores(self) -> dict[str, float]:
        """The points of every path: its share of the page's prose counts 1, what of it stands
        directly in it DIRECT more, the first main heading TITLE and a semantic element NAMED."""
        prose = [max(0, len(text) - 2 * linked) for _, text, linked in self.blocks]
        total = sum(prose)
        out: dict[str, float] = {}
        if not total:
            return out
        for (chain, _, _), n in zip(self.blocks, prose):
            for path in {self.paths[c] for c in chain}:
                out[path] = out.get(path, 0.0) + n / total
            inner = self.paths[chain[-1]]
            out[inner] += DIRECT * n / total
        if self.title is not None:
            for path in {self.paths[c] for c in self.title}:
                out[path] = out.get(path, 0.0) + TITLE
        return {p: v + NAMED * bool(re.search(r"/(?:article|main)[^/]*$", p)) for p, v in out.items()}

    def text(self, path: str | None) -> str:
        """The blocks under ``path``; those of the best own container if it has none."""
        found = self._under(path)
        if not found:
            own = self.scores()
            found = self._under(max(sorted(own), key=own.get) if own else None)
        return "\n".join(found)

    def _under(self, path: str | None) -> list[str]:
        return [t for chain, t, _ in self.blocks if any(self.paths[n] == path for n in chain)]


def host(url: Column) -> Column:
    """The host of an address, lower-cased, without port or user; empty if there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def host_paths(pages: DataFrame) -> DataFrame:
    """host and the winning path of every host. A task adds up its own pages before anything moves."""
    source = pages.select(host(F.col("url")).alias("host"), F.coalesce("html", F.lit("")).alias("html"))

    def make():
        def work(batch):
            total: dict[tuple[str, str], float] = {}
            for name, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for path, value in Page(page).scores().items():
                    total[name, path] = total.get((name, path), 0.0) + value
            keys = list(total)
            return pa.record_batch({
                "host": pa.array([k[0] for k in keys], pa.string()), "path": pa.array([k[1] for k in keys], pa.string()),
                "score": pa.array(total.values(), pa.float64())})
        return work

    votes = map_batches(source, make, "host string, path string, score double").groupBy("host", "path").agg(F.sum("score").alias("score"))
    # Ties go to the shorter path, then to the first in order of letters.
    best = W.partitionBy("host").orderBy(F.col("score").desc(), F.length("path"), "path")
    return written(votes.withColumn("_place", F.row_number().over(best)).filter("_place = 1").select("host", "path"), "host-paths")


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row."""
    winners = host_paths(pages)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", host(F.col("url")).alias("host"))
    source = rows.join(winners, "host", "left").select("page_id", "url", "path", F.coalesce("html", F.lit("")).alias("html"))

    def make():
        def work(batch):
            texts = [Page(h).text(p) for p, h in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            return pa.record_batch({
                "page_id": batch.column(0), "url": batch.column(1), "text": pa.array(texts, pa.string()),
                "n_chars": pa.array([len(t) for t in texts], pa.int64())})
        return work

    return map_batches(source, make, "page_id long, url string, text string, n_chars long")
