"""HTML extraction: the main text is the maximum-scoring run of a page's tokens.

A page is a row of tokens. A word scores positive, a tag negative; the score of each kind of tag
is fitted on labelled pages, which are pages whose own markup names the article. One linear scan
finds the contiguous run with the highest sum. Elements that are never the article (menus, page
headers and footers, sidebars, notices, adverts, forms, scripts, styles, reader comments) score
nothing and give no text, inside the run or outside. An element that only its class, id or role
marks, a form, and one whose end tag is missing are read all the same where they hold the article.
Some marks (share, related, search ...) also stand on parts of articles: each has a weight, fitted on
labelled pages, and the element is read if its words, less its words in links and its tags, outweigh it.
Marks that a class denies (no-sidebar, has-sidebar) don't count.

All steps take time in proportion to the page's length, also on broken or hostile markup.

Defined results: a null or empty page, and one without words, gives the empty string. Malformed
markup is read as far as it goes (open elements end with their parent, an unfinished tag is text). Of
runs with equal scores the first and then the longest wins. An article within an article is a part of
it. Repeated rows are kept, further columns are ignored.
"""

from __future__ import annotations

import bisect
import functools
import functools
import functools
import functools
import functools
import html
import math
import re
from collections import Counter
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stowlens.llm.common import map_batches

#: Labelled pages that the weights are fitted on, at most.
LABELLED_PAGES = 200
EPOCHS = 8

_ATTRS = r"(?:\"[^\"]*\"|'[^']*'|[^<>\"'])*+"
_ATTRS = r"(?:\"[^\"]*\"|'[^']*'|[^<>\"'])*+"
_ATTRS = r"(?:\"[^\"]*\"|'[^']*'|[^<>\"'])*+"
_ATTRS = r"(?:\"[^\"]*\"|'[^']*'|[^<>\"'])*+"
_ATTRS = r"(?:\"[^\"]*\"|'[^']*'|[^<>\"'])*+"
TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)"
    rf"|<(?P<raw>script|style|noscript|template|textarea|svg|math|iframe|select)\b{_ATTRS}>.*?(?:</(?P=raw)\s*>|\Z)"
    rf"|<(?P<end>/?)(?P<name>[a-z][a-z0-9:-]*)(?P<attrs>{_ATTRS})>"
    rf"|<[!?/][^<>]*>",
    re.S | re.I,
)
#: Elements that are never part of the article (fixed values).
SKIPPED = {"head", "nav", "footer", "aside", "form", "button", "menu", "dialog", "label", "object", "embed", "audio", "video", "canvas", "title"}
#: Words of class, id and role that mark such elements (fixed values).
MARKS = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "banner", "breadcrumb", "breadcrumbs", "comment", "comments",
    "consent", "contentinfo", "cookie", "cookies", "disqus", "footer", "masthead", "menu", "modal", "nav", "navbar", "navigation",
    "newsletter", "notice", "notices", "notification", "popup", "promo", "promoted", "related", "replies", "search", "share", "sharing",
    "sidebar", "signup", "skip", "social", "sponsor", "sponsored", "subscribe", "toolbar", "widget", "complementary",
}
#: Marks that parts of articles may have too: their elements are weighed (fixed values).
WEIGHED = {"banner", "complementary", "masthead", "related", "search", "share", "sharing", "skip", "social", "toolbar", "widget"}
#: Words before a mark that deny it (fixed values).
DENIALS = {"no", "not", "has", "with", "without", "non"}
#: Marks that parts of articles may have too: their elements are weighed (fixed values).
WEIGHED = {"banner", "complementary", "masthead", "related", "search", "share", "sharing", "skip", "social", "toolbar", "widget"}
#: Words before a mark that deny it (fixed values).
DENIALS = {"no", "not", "has", "with", "without", "non"}
#: Marks that parts of articles may have too: their elements are weighed (fixed values).
WEIGHED = {"banner", "complementary", "masthead", "related", "search", "share", "sharing", "skip", "social", "toolbar", "widget"}
#: Words before a mark that deny it (fixed values).
DENIALS = {"no", "not", "has", "with", "without", "non"}
#: Marks that parts of articles may have too: their elements are weighed (fixed values).
WEIGHED = {"banner", "complementary", "masthead", "related", "search", "share", "sharing", "skip", "social", "toolbar", "widget"}
#: Words before a mark that deny it (fixed values).
DENIALS = {"no", "not", "has", "with", "without", "non"}
#: Marks that parts of articles may have too: their elements are weighed (fixed values).
WEIGHED = {"banner", "complementary", "masthead", "related", "search", "share", "sharing", "skip", "social", "toolbar", "widget"}
#: Words before a mark that deny it (fixed values).
DENIALS = {"no", "not", "has", "with", "without", "non"}
BLOCKS = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "div", "dl", "dt", "fieldset", "figcaption",
    "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "html", "legend", "li", "main", "nav", "ol", "p", "pre",
    "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
ATTR = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
WORD_SPLIT = re.compile(r"[^a-z0-9]+")
_P = frozenset({"p"}), frozenset({"button", "caption", "object", "table", "td", "th"})
_LIST = frozenset({"ul", "ol", "menu", "dl", "table"})
#: What a start tag ends, and the elements beyond which it ends nothing.
CLOSES = {
    **dict.fromkeys(BLOCKS - {"body", "caption", "html", "legend", "tbody", "td", "tfoot", "th", "thead", "tr"} | {"dialog", "menu"}, (_P,)),
    "li": (_P, (frozenset({"li"}), _LIST)),
    **dict.fromkeys(("dd", "dt"), (_P, (frozenset({"dd", "dt"}), _LIST))),
    **dict.fromkeys(("td", "th"), ((frozenset({"td", "th"}), frozenset({"table", "tr"})),)),
    "tr": ((frozenset({"tr"}), frozenset({"table"})),),
    **dict.fromkeys(("tbody", "tfoot", "thead"), ((frozenset({"tbody", "tfoot", "thead", "tr"}), frozenset({"table"})), (frozenset({"tbody", "tfoot", "thead"}), frozenset({"table"})))),
    "body": ((frozenset({"head"}), frozenset()),),
}
#: The name of an article within an article in its tokens.
NESTED = "section"
#: The name of an article within an article in its tokens.
NESTED = "section"
#: The name of an article within an article in its tokens.
NESTED = "section"
#: The name of an article within an article in its tokens.
NESTED = "section"
#: The name of an article within an article in its tokens.
NESTED = "section"
#: Stands at both ends of a marked element that holds the article.
MARKED = "<marked>"
#: A word's score, and the scores of tags that labelled pages have inside or outside of the article only.
WORD, INSIDE, OUTSIDE = 1.0, -0.05, -50.0
#: Scores without labelled pages, and of kinds of tags that they lack.
#: The least weight of a mark, in words.
MARK = 10.0
#: The least weight of a mark, in words.
MARK = 10.0
#: The least weight of a mark, in words.
MARK = 10.0
#: The least weight of a mark, in words.
MARK = 10.0
#: The least weight of a mark, in words.
MARK = 10.0
OPENING = {"<article>": OUTSIDE, "</article>": OUTSIDE, "<main>": OUTSIDE, "</main>": OUTSIDE, MARKED: OUTSIDE}
TAG = -0.3


def marks_of(attrs: str) -> set[str]:
    """The words of class, id and role that say that an element isn't the article."""
    found = set()
    for m in ATTR.finditer(attrs):
        for name in (m[1] or m[2] or m[3] or "").lower().split():
            before = ""
            for word in WORD_SPLIT.split(name):
                if word in MARKS and before not in DENIALS:
                    found.add(word)
                before = word
    return found


def marks_of(attrs: str) -> set[str]:
    """The words of class, id and role that say that an element isn't the article."""
    found = set()
    for m in ATTR.finditer(attrs):
        for name in (m[1] or m[2] or m[3] or "").lower().split():
            before = ""
            for word in WORD_SPLIT.split(name):
                if word in MARKS and before not in DENIALS:
                    found.add(word)
                before = word
    return found


def marks_of(attrs: str) -> set[str]:
    """The words of class, id and role that say that an element isn't the article."""
    found = set()
    for m in ATTR.finditer(attrs):
        for name in (m[1] or m[2] or m[3] or "").lower().split():
            before = ""
            for word in WORD_SPLIT.split(name):
                if word in MARKS and before not in DENIALS:
                    found.add(word)
                before = word
    return found


def marks_of(attrs: str) -> set[str]:
    """The words of class, id and role that say that an element isn't the article."""
    found = set()
    for m in ATTR.finditer(attrs):
        for name in (m[1] or m[2] or m[3] or "").lower().split():
            before = ""
            for word in WORD_SPLIT.split(name):
                if word in MARKS and before not in DENIALS:
                    found.add(word)
                before = word
    return found


def marks_of(attrs: str) -> set[str]:
    """The words of class, id and role that say that an element isn't the article."""
    found = set()
    for m in ATTR.finditer(attrs):
        for name in (m[1] or m[2] or m[3] or "").lower().split():
            before = ""
            for word in WORD_SPLIT.split(name):
                if word in MARKS and before not in DENIALS:
                    found.add(word)
                before = word
    return found


def marked(attrs: str) -> bool:
    return bool(marks_of(attrs))


class Page:
    """A page's tokens before anything is left out, and where each element ends.

    out: (kind, text, position) as in tokens_of(). starts: index of an element's start tag -> (name,
    attributes, whether an article was open there). ends: that index -> (one past the element's last
    token, whether its own end tag ended it). As HTML has it, an element whose end tag is left out
    ends before the next sibling that it can't hold, or with its parent.
    """

    def __init__(self, page: str):
        self.out: list[tuple[str, str, int]] = []
        self.starts: dict[int, tuple[str, str, bool]] = {}
        self.ends: dict[int, tuple[int, bool]] = {}
        self.stack: list[tuple[str, int]] = []
        self.open: Counter = Counter()
        self.depths: dict[str, list[int]] = {}  # of a name's open elements in the stack
        at = 0
        for m in TOKEN.finditer(page):
            if m.start() > at:
                self.out.append(("w", page[at : m.start()], at))
            at = m.end()
            name = (m["name"] or "").lower()
            if m["raw"]:
                self.out.append((f"<{m['raw'].lower()}>", "", m.start()))
            elif name and m["end"]:
                closes = self.open[name] > 0
                while closes and self.stack[-1][0] != name:
                    self._close(False)
                inner = NESTED if name in ("article", "main") and self.open[name] != 1 else name
                self.out.append((f"</{inner}>", "", m.start()))
                if closes:
                    self._close(True)
            elif name:
                self._siblings(name)
                inner = NESTED if name in ("article", "main") and self.open[name] else name
                if name not in VOID:
                    self.starts[len(self.out)] = name, m["attrs"] or "", self.open["article"] + self.open["main"] > 0
                    self.depths.setdefault(name, []).append(len(self.stack))
                    self.stack.append((name, len(self.out)))
                    self.open[name] += 1
                self.out.append((f"<{inner}>", "", m.start()))
        if at < len(page):
            self.out.append(("w", page[at:], at))
        while self.stack:
            self._close(False)

    def _close(self, own: bool) -> None:
        name, i = self.stack.pop()
        self.depths[name].pop()
        self.open[name] -= 1
        self.ends[i] = len(self.out), own

    def _siblings(self, name: str) -> None:
        """Closes what a start tag ends."""
        deepest = lambda names: max((self.depths[e][-1] for e in names if self.open[e]), default=-1)
        deepest = lambda names: max((self.depths[e][-1] for e in names if self.open[e]), default=-1)
        deepest = lambda names: max((self.depths[e][-1] for e in names if self.open[e]), default=-1)
        deepest = lambda names: max((self.depths[e][-1] for e in names if self.open[e]), default=-1)
        deepest = lambda names: max((self.depths[e][-1] for e in names if self.open[e]), default=-1)
        for ended, within in CLOSES.get(name, ()):
            depth = deepest(ended)
            if depth >= 0 and depth > deepest(within):
                while len(self.stack) > depth:
                    self._close(False)

    @functools.cached_property
    def sums(self) -> list[float]:
        """Of the tokens before each: words, less words in links and TAG for each tag."""
        total, link, out = 0.0, 0, [0.0]
        for i, (kind, text, _) in enumerate(self.out):
            if kind == "w":
                total += len(text.split()) * (-1 if i < link else 1)
            else:
                total += TAG
                if kind == "<a>":
                    link = max(link, self.ends[i][0])
            out.append(total)
        return out

    def weight(self, i: int) -> float:
        """How much prose the element that starts at an index has."""
        return self.sums[self.ends[i][0]] - self.sums[i]

    def kept(self) -> Callable[[int], bool]:
        """Whether the element that starts at an index holds the page's longest unmarked <article> or <main>, or without one most of the page's words."""
        words, n, hidden = [0], 0, 0
        for i, (kind, text, _) in enumerate(self.out):
            if i in self.starts and self.starts[i][0] in SKIPPED - {"form"} and self.ends[i][1]:
                hidden = max(hidden, self.ends[i][0])
            n += len(text.split()) if kind == "w" and i >= hidden else 0
            words.append(n)

        def held(i: int) -> int:
            return words[self.ends[i][0]] - words[i]

        named = [i for i, (name, attrs, _) in self.starts.items() if name in ("article", "main") and held(i) and not marked(attrs)]
        if named:
            longest = max(named, key=lambda i: (held(i), -i))
            return lambda i: i < longest < self.ends[i][0]
        return lambda i: 2 * held(i) > n


def tokens_of(page: str, weights: dict[str, float] = {}) -> list[tuple[str, str, int]]:
    """(kind, text, position): kind is 'w' for text between tags, else the tag; skipped elements give one tag at most.

    A marked element, a form and an element that lacks its end tag are not skipped where they hold
    the article, nor are those whose prose outweighs their marks; then MARKED stands at their ends, which scores low.
    """
    p = Page(page)
    out, i, kept, edges = [], 0, None, set()
    while i < len(p.out):
        if i in edges:
            out.append((MARKED, "", p.out[i][2]))
        token = p.out[i]
        out.append(token)
        name, attrs, inside = p.starts.get(i, ("", "", False))
        i += 1
        if not name or name in ("html", "body", "article", "main"):
            continue
        by_name = name in SKIPPED or name == "header" and not inside
        marks = marks_of(attrs) if attrs else ()
        if by_name or marks:
            end, own = p.ends[i - 1]
            if not (by_name and own and name != "form"):
                if not by_name and inside and marks <= WEIGHED and p.weight(i - 1) > sum(weights.get("~" + m, MARK) for m in marks):
                    continue
                kept = kept or p.kept()
                if kept(i - 1):
                    out.append((MARKED, "", token[2]))
                    edges.add(end)
                    continue
            i = end
    return out


def mark_weights(pages: list[str]) -> dict[str, float]:
    """Of each mark to be weighed the prose that its elements have outside of the articles of labelled pages, MARK at least."""
    out: dict[str, float] = {}
    for page in map(Page, pages):
        for i, (_, attrs, inside) in page.starts.items():
            if attrs and not inside:
                for m in marks_of(attrs) & WEIGHED:
                    if not any(page.starts.get(k, ("",))[0] in ("article", "main") for k in range(i, page.ends[i][0])):
                        out["~" + m] = max(out.get("~" + m, MARK), page.weight(i))
    return out


def score_of(token: tuple[str, str, int], weights: dict[str, float]) -> float:
    kind = token[0]
    return weights["w"] * len(token[1].split()) if kind == "w" else weights.get(kind, OPENING.get(kind, TAG))


def best_run(tokens: list[tuple[str, str, int]], weights: dict[str, float]) -> tuple[int, int]:
    """Kadane's scan: the half-open run of tokens with the highest sum; (0, 0) if none is positive."""
    best, found, total, first = 0.0, (0, 0), 0.0, 0
    for i, token in enumerate(tokens):
        if total <= 0:
            total, first = 0.0, i
        total += score_of(token, weights)
        if total > best + 1e-9:
            best, found = total, (first, i + 1)
    return found


def text_of(tokens: list[tuple[str, str, int]], run: tuple[int, int]) -> str:
    blocks, parts = [], []
    for kind, text, _ in [*tokens[run[0] : run[1]], ("<p>", "", 0)]:
        if kind == "w":
            parts.append(html.unescape(text))
        elif kind == "<br>":
            parts.append(" ")
        elif kind.strip("</>") in BLOCKS:
            if line := " ".join("".join(parts).split()):
                blocks.append(line)
            parts = []
    return "\n".join(blocks)


def labelled_run(tokens: list[tuple[str, str, int]]) -> tuple[int, int] | None:
    """The run inside a page's own <article> or <main>, if it has exactly one."""
    kinds = [k for k, _, _ in tokens]
    for name in ("article", "main"):
        if kinds.count(f"<{name}>") == 1:
            first = kinds.index(f"<{name}>") + 1
            return first, kinds.index(f"</{name}>", first) if f"</{name}>" in kinds[first:] else len(kinds)
    return None


def fit(pages: list[str], epochs: int = EPOCHS) -> dict[str, float]:
    """Scores of tags by how often labelled pages have them inside and outside of the article.

    A tag's score lies between INSIDE and OUTSIDE by its log-odds. Then a structured perceptron
    mends what is still wrong: the tags of the labelled run gain and those of the found run lose.
    """
    inside, outside = Counter(), Counter()
    marks = mark_weights(pages)
    gold = [(t, r) for t in (tokens_of(p, marks) for p in pages) if (r := labelled_run(t))]
    for tokens, (a, b) in gold:
        for i, (kind, _, _) in enumerate(tokens):
            if kind != "w":
                (inside if a <= i < b else outside)[kind] += 1
    weights = {"w": WORD, **marks}
    for kind in sorted({*inside, *outside}):
        odds = math.log((inside[kind] + 0.5) / (outside[kind] + 0.5))
        weights[kind] = INSIDE if odds >= 0 else max(OUTSIDE, INSIDE + 10 * odds)
    for _ in range(epochs):
        wrong = 0
        for tokens, run in gold:
            found = best_run(tokens, weights)
            if text_of(tokens, found) == text_of(tokens, run):
                continue
            wrong += 1
            for (a, b), by in ((run, 0.05), (found, -0.05)):
                for kind, _, _ in tokens[a:b]:
                    if kind != "w":
                        weights[kind] = max(OUTSIDE, min(INSIDE / 5, weights[kind] + by))
        if not wrong:
            break
    return weights


def fit_table(pages: DataFrame, sample: int = LABELLED_PAGES) -> dict[str, float]:
    """fit() on at most `sample` pages that label their own article, taken by a hash of the id."""
    named = pages.select("page_id", "html").where(F.col("html").contains("<article") | F.col("html").contains("<main"))
    ids = [r.page_id for r in named.select("page_id").distinct().orderBy(F.xxhash64("page_id"), "page_id").limit(sample).collect()]
    rows = named.where(F.col("page_id").isin(ids)).select("page_id", "html").dropDuplicates(["page_id"]).collect()
    return fit([r.html for r in sorted(rows, key=lambda r: r.page_id)])


def extract(pages: DataFrame, weights: dict[str, float]) -> DataFrame:
    """page_id, url, text, n_chars, and where the run begins and ends in the page."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, first, last = [], [], []
        for page in batch.column(2).to_pylist():
            page = page or ""
            tokens = tokens_of(page, weights)
            a, b = best_run(tokens, weights)
            texts.append(text_of(tokens, (a, b)))
            first.append(tokens[a][2] if b else 0)
            last.append((tokens[b][2] if b < len(tokens) else len(page)) if b else 0)
        arrays = [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), pa.array(first, pa.int64()), pa.array(last, pa.int64())]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *arrays], ["page_id", "url", "text", "n_chars", "run_start", "run_end"])

    return map_batches(pages.select("page_id", "url", "html"), run, "page_id bigint, url string, text string, n_chars bigint, run_start bigint, run_end bigint")
