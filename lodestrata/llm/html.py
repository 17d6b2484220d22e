"""Main text of web pages: parser events, text-to-tag ratios, smoothing and threshold clusters."""

from __future__ import annotations

import re
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that are never main text.
BOILERPLATE = frozenset("aside button dialog footer head iframe menu nav noscript object option script select style svg template textarea title".split())
#: Elements that don't end a line of text.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements whose end tag is often left out; the next block ends them.
LOOSE = frozenset("p h1 h2 h3 h4 h5 h6 dt dd".split())
SEMANTIC = frozenset(("article", "main"))
#: Names that say, as a whole class, id or role, what an element is. They weigh only against elements with less than half of the page's text.
NAMED = frozenset(
    "ad ad-banner ad-container ad-slot ads advert advertisement adverts banner breadcrumb breadcrumbs comment-list comments complementary contentinfo cookie-banner cookie-consent cookie-notice dialog footer header menu nav navbar navigation newsletter notice search share sidebar social sponsored widget".split()
)
HARD, SOFT = 2, 1


class Lines(HTMLParser):
    """Streams a page into lines: text, tags met, characters in links, the container around it, and whether it is boilerplate.

    Containers are numbered as they open, so a parent's number is always the
    smaller one; ``parent``, ``semantic`` (inside an article or main element)
    and ``why`` go by that number. ``why`` is HARD for elements that are never
    main text, SOFT for forms and for names in ``NAMED``, else 0.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, int]] = []  # tag and number
        self.open: dict[str, int] = {}
        self.parent, self.semantic, self.why = [0], [False], [0]
        self.roots: set[int] = set()
        self.lines: list[tuple[str, int, int, int]] = []
        self.parts: list[str] = []
        self.tags, self.linked, self.links = 0, 0, 0

    def cut(self):
        text = " ".join("".join(self.parts).split())
        if text or self.tags:
            self.lines.append((text, self.tags, self.linked, self.stack[-1][1] if self.stack else 0))
        self.parts, self.tags, self.linked = [], 0, 0

    def reason(self, tag: str, attrs: dict[str, str | None]) -> int:
        if tag in BOILERPLATE or tag == "header" and not any(self.open.get(t) for t in SEMANTIC):
            return HARD
        if "hidden" in attrs or attrs.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none", attrs.get("style") or ""):
            return HARD
        names = {w for name in ("class", "id", "role") for w in (attrs.get(name) or "").lower().split()}
        return SOFT if tag == "form" or tag not in ("html", "body", "main") and names & NAMED else 0

    def pop(self, down_to: int):
        for tag, *_ in self.stack[down_to:]:
            self.open[tag] -= 1
        del self.stack[down_to:]

    def handle_starttag(self, tag, attrs):
        if tag not in INLINE:
            self.cut()
        self.tags += 1
        if tag == "a":
            self.links += 1
        if tag in VOID:
            return
        if tag not in INLINE and self.stack and self.stack[-1][0] in LOOSE:
            self.pop(len(self.stack) - 1)
        why = self.reason(tag, dict(attrs))
        if (tag in INLINE or tag in LOOSE) and not why:
            return
        parent = self.stack[-1][1] if self.stack else 0
        number = len(self.parent)
        self.parent.append(parent)
        self.semantic.append(self.semantic[parent] or tag in SEMANTIC)
        if tag in SEMANTIC:
            self.roots.add(number)
        self.why.append(why)
        self.stack.append((tag, number))
        self.open[tag] = self.open.get(tag, 0) + 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag not in INLINE:
            self.cut()
        self.tags += 1
        if tag == "a":
            self.links = max(0, self.links - 1)
        if not self.open.get(tag):
            return
        if tag in INLINE or tag in LOOSE:
            if self.stack[-1][0] == tag:
                self.pop(len(self.stack) - 1)
            return
        self.pop(max(k for k, (t, *_) in enumerate(self.stack) if t == tag))

    def handle_data(self, data):
        self.parts.append(data)
        if self.links:
            self.linked += len(data)

    def finish(self):
        if re.match(r"<[a-zA-Z/!?]", self.rawdata):  # a tag that the page's end cuts off
            self.rawdata = ""
        self.close()
        self.cut()


def smooth(ratio: np.ndarray, sigma: float) -> np.ndarray:
    reach = int(np.ceil(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    return np.convolve(np.pad(ratio, reach, mode="edge"), kernel / kernel.sum(), mode="valid")


def _sums(parser: Lines, values) -> list[float]:
    """A value of each line, summed over the lines in each container and below."""
    out = [0.0] * len(parser.parent)
    for (*_, at), v in zip(parser.lines, values, strict=True):
        out[at] += v
    for n in range(len(out) - 1, 0, -1):
        out[parser.parent[n]] += out[n]
    return out


def _skipped(parser: Lines, prose: list[float], semantic: list[float]) -> list[bool]:
    """Containers that aren't main text.

    A soft reason doesn't count against an element with most of the page's
    prose, unless there is prose in an article or main element outside it.
    """
    out = [False] * len(parser.parent)
    for n in range(1, len(out)):
        soft = parser.why[n] == SOFT and (prose[n] * 2 <= prose[0] or semantic[n] < semantic[0])
        out[n] = out[parser.parent[n]] or parser.why[n] == HARD or soft
    return out


def main_text(html: str | None, sigma: float = 1.0, chunk: int = 1 << 16, ratios=None) -> str:
    """The main text of one page, blocks joined by a space.

    Each line of the page gets its ratio of text to tags; the ratios are
    smoothed by a Gaussian and those above their standard deviation form the
    content clusters, which choose the container that holds the text: they vote
    by length, those inside an article or main element threefold, for the
    deepest container with over half of the votes. From there it goes up to an
    article or main element around it or, without one, as long as a parent adds
    a sixth of the votes. Every line of that container comes out, short ones
    too, but for boilerplate elements and runs of links outside the clusters.
    ``ratios`` may replace the ratios, for tests.
    """
    if not html:
        return ""
    parser = Lines()
    for at in range(0, len(html), chunk):
        parser.feed(html[at : at + chunk])
    parser.finish()
    lines = parser.lines
    if not any(text for text, *_ in lines):
        return ""
    ratio = np.array([len(text) / max(1, tags) for text, tags, *_ in lines])
    level = smooth(ratio if ratios is None else ratios(ratio), sigma)
    content = level >= min(level.std(), level.max())
    linked = [n * 2 > len(text) for text, _, n, _ in lines]
    hard = [why == HARD for why in parser.why]
    for n in range(1, len(hard)):
        hard[n] |= hard[parser.parent[n]]
    prose = [len(text) * (not hard[at] and not linked[k]) for k, (text, _, _, at) in enumerate(lines)]
    in_semantic = [n * parser.semantic[at] for n, (*_, at) in zip(prose, lines, strict=True)]
    skipped = _skipped(parser, _sums(parser, [n * bool(c) for n, c in zip(prose, content, strict=True)]), _sums(parser, in_semantic))
    weight = [(3 if parser.semantic[at] else 1) * n * (not skipped[at]) for n, (*_, at) in zip(prose, lines, strict=True)]
    votes = _sums(parser, [n * bool(c) for n, c in zip(weight, content, strict=True)])
    if not votes[0]:  # no cluster outside boilerplate: all other lines vote
        votes = _sums(parser, weight if any(weight) else [len(text) * (not skipped[at]) for text, _, _, at in lines])
    if not votes[0]:
        return ""
    best = max(n for n, v in enumerate(votes) if v * 2 > votes[0])
    up = best
    while up and up not in parser.roots:
        up = parser.parent[up]
    chosen = up or best
    if not up:
        above = parser.parent[chosen]
        while chosen:
            if votes[above] * 6 >= votes[chosen] * 7:
                chosen = above
            if not above:
                break
            above = parser.parent[above]
    inside = [False] * len(votes)
    for n in range(len(votes)):
        inside[n] = n == chosen or inside[parser.parent[n]]
    mine = [k for k, (text, _, _, at) in enumerate(lines) if text and not skipped[at] and inside[at]]
    menu = [linked[k] and not content[k] for k in mine]
    return " ".join(lines[k][0] for j, k in enumerate(mine) if not (menu[j] and (any(menu[max(0, j - 1) : j]) or any(menu[j + 1 : j + 2]))))


def _extract(sigma: float):
    def run(batches):
        for batch in slices(batches, 2, 4 << 20):
            texts = [main_text(x, sigma) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return run


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", sigma: float = 1.0) -> DataFrame:
    """Main text of each row: page_id, url, text (empty if there is none), n_chars.

    A null page is empty; null ids and URLs stay; repeated rows give a row
    each; further columns are ignored. No shuffle: one pass, a page at a time.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return rows.mapInArrow(_extract(sigma), "page_id long, url string, text string, n_chars long")


def op3_html(spark, sf_dir: str) -> DataFrame:
    return extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
