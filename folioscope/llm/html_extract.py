"""Main-text extraction: gradient-boosted trees over DOM nodes, decoded as a tree.

A page becomes a tree of its block elements; each run of text directly inside one is a leaf. Every node has
features of its subtree's density, its attribute tokens and those of its ancestors, its depth, its siblings and its
place in the page. Boosted trees give each node the odds of being main text; decoding maximises the sum over the
tree under the rule that nothing below a removed node is kept, so an ancestor and a descendant never contradict.

Training: pages are composed from TRAIN_PAGES rows' paragraphs (a bounded sample; without rows, from built-in
words) in many layouts whose main text is known by construction, and the trees are fitted on the driver.

Defined cases: null, empty and text-free html gives "" and 0; broken markup is closed as browsers do; an
element of HIDDEN is left out with all that is in it, but one that its own end tag does not close hides nothing; repeated
rows are extracted alike; long pages are read whole; extra columns are ignored.
"""

from __future__ import annotations

import html as entities
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import arrow_map, chunks

#: The bounded sample of training: pages, paragraphs of each and their characters; layouts that are composed of them.
TRAIN_PAGES, PARAGRAPHS, CHARS, LAYOUTS = 200, 20, 4000, 900
TREES, DEPTH, RATE, BINS = 40, 4, 0.3, 32

# Fixed values of HTML: elements without content, with raw text, those that are no text of a page, and those that break
# a line of text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript textarea title iframe".split())
HIDDEN = frozenset("template svg object select button annotation annotation-xml".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup html li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES_P = BLOCK - {"html", "head", "body", "td", "th", "tr", "tbody", "thead", "tfoot"} | {"hr"}
#: An opening tag closes an open element of these names, if no element of the others stands between.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
#: Words of class, id and role by what they say of an element.
TOKENS = (
    frozenset("article content main post entry body story text prose richtext".split()),
    frozenset("nav menu navigation navbar breadcrumb breadcrumbs pagination pager toc tabs links".split()),
    frozenset("footer header masthead copyright colophon bottom top banner branding topbar".split()),
    frozenset("sidebar aside related widget promo recommended trending share social rail secondary tags".split()),
    frozenset("ad ads advert adverts advertisement sponsor sponsored promoted adsense dfp".split()),
    frozenset("cookie cookies consent notice alert popup modal newsletter subscribe gdpr overlay toast disclaimer".split()),
    frozenset("comment comments reply replies respond disqus discussion commentlist reviews".split()),
    frozenset("form login search signup contact field".split()),
)
TAGS = (frozenset(["p", "blockquote", "pre"]), frozenset("h1 h2 h3 h4 h5 h6".split()), frozenset("ul ol li dl dt dd menu".split()), frozenset(["nav"]), frozenset(["header", "footer"]), frozenset(["aside", "dialog", "search"]), frozenset(["form", "fieldset"]), frozenset(["article", "main"]), frozenset(["section", "div"]), frozenset("table tbody thead tfoot tr td th".split()))

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|</([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)|<([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*"|'[^']*')*+(?:>|\Z)|[^>]*(?:>|\Z))""",
    re.S,
)
_ATTRIBUTE = re.compile(r"""([a-zA-Z][\w:-]*)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
_PARTS = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]+")


class Page:
    """The block tree of a page. Node 0 is the root; a leaf has tag "#" and its text."""

    def __init__(self, source: str):
        self.tag, self.parent, self.depth, self.attributes, self.text, self.links, self.marked = ["#root"], [-1], [0], [()], [""], [0], [None]
        self._read(source)

    def _add(self, tag: str, parent: int, attributes=(), text="", links=0, marked=None) -> int:
        self.tag.append(tag)
        self.parent.append(parent)
        self.depth.append(self.depth[parent] + 1)
        self.attributes.append(attributes)
        self.text.append(text)
        self.links.append(links)
        self.marked.append(marked)
        return len(self.tag) - 1

    def _read(self, source: str) -> None:
        opened: list[tuple[str, int]] = [("#root", 0)]  # names with the block node that holds their text
        run: list[str] = []
        linked = [0, 0]  # open links, and the characters in them
        # Open elements of HIDDEN: place in opened, run and linked characters before, and the first node within.
        hidden: list[list] = []

        def leaf(parts: list[str], links: int):
            text = " ".join("".join(parts).split())
            if text:
                self._add("#", opened[-1][1], text=text, links=min(links, len(text)))

        def flush():
            before = links = 0
            for held in hidden:
                if held[3] is None:  # what stood before the element is no part of it
                    leaf(run[before : held[1]], held[2] - links)
                    before, links, held[3] = held[1], held[2], len(self.tag)
            leaf(run[before:], linked[1] - links)
            run.clear()
            linked[1] = 0

        def pop(k: int):
            if any(name in BLOCK for name, _ in opened[k:]):
                flush()
            linked[0] -= sum(name == "a" for name, _ in opened[k:])
            del opened[k:]
            while hidden and hidden[-1][0] >= k:
                hidden.pop()

        def leave_out(k: int):
            """Close the element of HIDDEN at k, without what is in it."""
            _, length, links, node = next(held for held in hidden if held[0] == k)
            pop(k)
            if node is None:
                del run[length:]
                linked[1] = links
            else:
                run.clear()
                linked[1] = 0
                for column in (self.tag, self.parent, self.depth, self.attributes, self.text, self.links, self.marked):
                    del column[node:]
            run.append(" ")

        at, size = 0, len(source)
        while at < size:
            hit = _TOKEN.search(source, at)
            words = source[at : hit.start() if hit else size]
            if words:
                # Each piece by itself: tags within a reference end it.
                run.append(entities.unescape(words))
                if linked[0]:
                    linked[1] += len(words.strip())
            if hit is None:
                break
            at = hit.end()
            if name := hit[1]:
                name = name.lower()
                if name == "br" or name == "p" and not any(n == "p" for n, _ in opened):
                    run.append(" ")
                    continue
                for k in range(len(opened) - 1, 0, -1):
                    if opened[k][0] == name:
                        (leave_out if name in HIDDEN else pop)(k)
                        break
                    if name not in BLOCK and name not in HIDDEN and opened[k][0] in BLOCK:
                        break
            elif name := hit[2]:
                name = name.lower()
                if name in VOID:
                    if name == "hr":
                        flush()
                    elif name == "br":
                        run.append(" ")
                    continue
                if name in RAW:
                    if not hit[3].endswith("/>"):
                        end = re.compile(f"</{name}(?=[\\s/>])[^>]*(?:>|\\Z)", re.I).search(source, at)
                        at = end.end() if end else size
                    run.append(" " if name not in ("script", "style", "noscript") else "")
                    continue
                if hit[3].endswith("/>") and (name in ("svg", "math") or any(n in ("svg", "math") for n, _ in opened)):
                    run.append(" ")
                    continue
                if name in HIDDEN:
                    for k in range(len(opened) - 1, 0, -1):
                        if opened[k][0] == name and name in ("button", "select"):  # these do not hold their like
                            pop(k)
                            break
                        if opened[k][0] in BLOCK:
                            break
                    hidden.append([len(opened), len(run), linked[1], None])
                    opened.append((name, opened[-1][1]))
                    continue
                if name in CLOSES_P:
                    for k in range(len(opened) - 1, 0, -1):
                        if opened[k][0] == "p":
                            pop(k)
                            break
                        if opened[k][0] in BLOCK or opened[k][0] in HIDDEN:
                            break
                if name in CLOSES:
                    closed, stop = CLOSES[name]
                    for k in range(len(opened) - 1, 0, -1):
                        if opened[k][0] in stop:
                            break
                        if opened[k][0] in closed:
                            pop(k)
                            if name != "tr":
                                break
                            if name == "tr" and not any(n in closed for n, _ in opened[max(1, k - 2) : k]):
                                break
                if name in BLOCK:
                    flush()
                    if name in ("html", "body", "head") and any(n == name for n, _ in opened):
                        continue
                    pairs = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(hit[3])} if "=" in hit[3] else {}
                    said = " ".join(pairs.get(k, "") for k in ("class", "id", "role", "itemprop", "aria-label"))
                    tokens = frozenset(x.lower() for x in _PARTS.findall(said)) if said.strip() else ()
                    node = self._add(name, opened[-1][1], tokens, marked=pairs.get("data-main"))
                    opened.append((name, node))
                else:
                    linked[0] += name == "a"
                    opened.append((name, opened[-1][1]))
        flush()

    def features(self) -> np.ndarray:
        n = len(self.tag)
        chars, words, links, stops, upper, marks, elements = (np.zeros(n) for _ in range(7))
        children, order = np.zeros(n), np.zeros(n)
        before = np.zeros(n)
        kinds, tags = np.zeros((n, len(TOKENS))), np.zeros((n, len(TAGS)))
        above, above_tags = np.zeros((n, len(TOKENS))), np.zeros((n, len(TAGS)))
        rights = np.zeros(n)
        total = 0
        for k in range(n):
            p = self.parent[k]
            if p >= 0:
                above[k] = np.maximum(above[p], kinds[p])
                above_tags[k] = np.maximum(above_tags[p], tags[p])
                order[k] = children[p]
                children[p] += 1
            before[k] = total
            if self.tag[k] == "#":
                text = self.text[k]
                chars[k], words[k], links[k] = len(text), text.count(" ") + 1, self.links[k]
                stops[k] = text.count(".") + text.count(",") + text.count("?") + text.count("!")
                upper[k] = text.isupper()
                marks[k] = text[-1] in ".!?:;\"'”»)"
                rights[k] = "©" in text or "(c)" in text.lower()
                total += len(text)
            else:
                elements[k] = 1
                if self.attributes[k]:
                    kinds[k] = [not t.isdisjoint(self.attributes[k]) for t in TOKENS]
                tags[k] = [self.tag[k] in t for t in TAGS]
        longest = chars.copy()
        for k in range(n - 1, 0, -1):
            p = self.parent[k]
            for a in (chars, words, links, stops, elements):
                a[p] += a[k]
            rights[p] = max(rights[p], rights[k])
            longest[p] = max(longest[p], longest[k])
        parent = np.maximum(np.array(self.parent), 0)
        base = np.stack(
            [
                np.log1p(chars), np.log1p(words), links / np.maximum(chars, 1), stops / np.maximum(words, 1), chars / np.maximum(words, 1), upper, marks, rights,
                np.log1p(elements), np.log1p(chars / (elements + 1)), np.log1p(longest), np.array(self.depth, float), children, order, children[parent] - order,
                np.log1p((chars[parent] - chars) / np.maximum(children[parent] - 1, 1)), chars / np.maximum(chars[parent], 1), before / max(total, 1), (before + chars) / max(total, 1), chars / max(total, 1),
                np.array([t == "#" for t in self.tag], float),
            ],
            1,
        )
        return np.concatenate([base, kinds, above, tags, above_tags], 1)

    def main_text(self, odds: np.ndarray) -> str:
        """The text of the best labelling in which nothing below a removed node is kept."""
        n = len(self.tag)
        keep, drop = odds.tolist(), [0.0] * n
        for k in range(n - 1, 0, -1):
            keep[self.parent[k]] += max(keep[k], drop[k])
        kept = [True] * n
        out = []
        for k in range(1, n):
            kept[k] = kept[self.parent[k]] and keep[k] > 0
            if kept[k] and self.tag[k] == "#":
                out.append(self.text[k])
        return " ".join(out)


class Trees:
    """Boosted regression trees for logistic loss, over features cut into quantile bins."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
        binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(self.cuts)], 1)
        odds, self.trees = np.zeros(len(y)), []
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-odds))
            g, h = p - y, np.maximum(p * (1 - p), 1e-6)
            node, splits = np.zeros(len(y), np.int64), []
            for level in range(DEPTH):
                width = 1 << level
                best = np.full(width, 1e-9)
                choice = np.tile([0, BINS], (width, 1))
                for j in range(x.shape[1]):
                    at = node * BINS + binned[:, j]
                    gs, hs = (np.bincount(at, weights=w, minlength=width * BINS).reshape(width, BINS).cumsum(1) for w in (g, h))
                    gain = gs**2 / (hs + 1) + (gs[:, -1:] - gs) ** 2 / (hs[:, -1:] - hs + 1) - gs[:, -1:] ** 2 / (hs[:, -1:] + 1)
                    gain[(hs < 1) | (hs[:, -1:] - hs < 1)] = 0
                    top = gain.argmax(1)
                    better = gain[np.arange(width), top] > best
                    best[better] = gain[np.arange(width), top][better]
                    choice[better] = np.stack([np.full(width, j), top], 1)[better]
                splits.append(choice)
                node = node * 2 + (binned[np.arange(len(y)), choice[node, 0]] > choice[node, 1])
            gs, hs = (np.bincount(node, weights=w, minlength=1 << DEPTH) for w in (g, h))
            values = -RATE * gs / (hs + 1)
            self.trees.append((splits, values))
            odds += values[node]

    def odds(self, x: np.ndarray) -> np.ndarray:
        binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(self.cuts)], 1)
        out, rows = np.zeros(len(x)), np.arange(len(x))
        for splits, values in self.trees:
            node = np.zeros(len(x), np.int64)
            for choice in splits:
                node = node * 2 + (binned[rows, choice[node, 0]] > choice[node, 1])
            out += values[node]
        return out


def layouts(paragraphs: list[str], count: int = LAYOUTS, seed: int = 7):
    """Pages of many layouts; their elements with data-main="1" hold the main text."""
    r = random.Random(seed)
    words = sorted({w for p in paragraphs for w in p.split()}) or ["lorem", "ipsum", "dolor", "sit", "amet"]
    some = lambda a, b: " ".join(r.choice(words) for _ in range(r.randint(a, b)))
    sentence = lambda a, b: some(a, b).capitalize() + r.choice([".", ".", ".", "?", ""])
    cut = lambda: entities.escape(r.choice(paragraphs), quote=False) if paragraphs and r.random() < 0.8 else " ".join(sentence(4, 20) for _ in range(r.randint(1, 6)))

    def element(tags, classes, inner, main=False):
        tag = r.choice(tags)
        named = f' {r.choice(["class", "id", "class"])}="{r.choice(classes)}"' if classes and (tag == "div" or r.random() < 0.5) else ""
        return f"<{tag}{named}{' data-main="1"' if main else ''}>{inner}</{tag}>"

    items = lambda n: "<ul>" + "".join(f'<li><a href="/{k}">{some(1, 3)}</a></li>' for k in range(n)) + "</ul>"
    brief = lambda: sentence(1, 4)
    para = lambda short=0.15: f"<p>{r.choice(['', '', '<b>'])}{brief() if r.random() < short else cut()}{r.choice(['', '<br>'])}{r.choice(['</p>', '</p>', ''])}"
    for _ in range(count):
        title = f"<h1>{some(1, 10)}</h1>" if r.random() < 0.85 else ""
        body = title if (within := r.random() < 0.8) else ""
        count_here = r.choice([0, 1, 1, 2, 3, 5, 9, 14])
        for k in range(count_here):
            # Articles often begin or end with a paragraph of a few words.
            body += para(0.3 if k in (0, 1, count_here - 1) else 0.12)
            if r.random() < 0.15:
                body += r.choice([f"<h2>{some(2, 6)}</h2>", "<ul>" + "".join(f"<li>{sentence(2, 14)}</li>" for _ in range(r.randint(2, 6))) + "</ul>", f"<blockquote>{cut()}</blockquote>", f"<table><tr><td>{some(1, 4)}</td><td>{some(1, 4)}</td></tr></table>", f"<p>{some(2, 6)} <a href='/x'>{some(1, 4)}</a> {sentence(3, 12)}</p>"])
            if r.random() < 0.12:
                body += element(["div", "aside"], ["ad", "advert", "ad-slot", "sponsored", "related", "newsletter-signup", "share social", "promo"], r.choice([sentence(3, 14), items(3)])).replace("<div", '<div data-main="0"').replace("<aside", '<aside data-main="0"')
        main = element(["article", "article", "main", "div", "section"], ["content", "post-content", "article-body", "entry", "main", "story text", f"x{r.randint(1, 99)}"], body, True)
        if title and not within:
            main = title.replace("<h1", '<h1 data-main="1"') + main
        around = {
            "nav": element(["nav", "nav", "div", "header"], ["menu", "navbar", "main-nav", "breadcrumbs", "top-links"], items(r.randint(2, 9))),
            "head": element(["header", "div"], ["header", "masthead", "site-branding", "topbar"], r.choice([f"<a href='/'>{some(1, 3)}</a>", sentence(2, 8), f"<p>{sentence(3, 9)}</p>"])),
            "ad": element(["div", "div", "aside"], ["ad", "ads", "advert", "sponsor", "ad banner"], r.choice([sentence(3, 16), f"<p>{sentence(4, 20)}</p>"])),
            "notice": element(["div", "section", "dialog"], ["cookie-notice", "consent", "alert", "gdpr overlay", "modal popup", "notice"], r.choice([sentence(4, 20), f"<p>{sentence(5, 25)}</p><p>{sentence(2, 8)}</p>"])),
        }
        below = {
            "side": element(["aside", "div"], ["sidebar", "related", "widget", "trending", "rail"], r.choice([items(r.randint(2, 7)), f"<h3>{some(1, 3)}</h3>" + items(4), f"<p>{sentence(6, 30)}</p>", cut()])),
            "comments": element(["div", "section", "aside"], ["comments", "comment-list", "disqus", "reader-comments", "replies", f"x{r.randint(1, 99)}"], "".join(f"<div class='comment'><p>{some(1, 2)}</p><p>{sentence(4, 40)}</p></div>" if r.random() < 0.6 else f"<p>{sentence(4, 40)}</p>" for _ in range(r.randint(1, 5)))),
            "form": element(["form", "div"], ["form", "login", "search", "signup form", "contact"], f"<label>{some(1, 3)}</label><input name=q><p>{sentence(2, 10)}</p>"),
            "foot": element(["footer", "footer", "div"], ["footer", "site-footer", "copyright", "bottom"], r.choice([f"&copy; {some(1, 3)} &middot; {sentence(3, 14)}", f"<p>&copy; {some(2, 9)}</p>", items(4) + sentence(3, 9)])),
        }
        first = [v for k, v in around.items() if r.random() < {"nav": 0.85, "ad": 0.5}.get(k, 0.35)]
        last = [v for k, v in below.items() if r.random() < {"foot": 0.85}.get(k, 0.35)]
        r.shuffle(first)
        inner = "".join(first) + (r.choice(["{}", "{}", "<div class='wrapper'>{}</div>", "<div id='page'><div class='row'>{}</div></div>"]).replace("{}", main)) + "".join(last)
        yield f"<!DOCTYPE html><html><head><title>{some(2, 8)}</title></head><body>{inner}" + r.choice(["</body></html>", "</body></html>", ""])


def labelled(page: Page) -> np.ndarray:
    """1 for the nodes of a layouts() page that hold main text."""
    n = len(page.tag)
    inside, y = [False] * n, np.zeros(n)
    for k in range(1, n):
        inside[k] = inside[page.parent[k]] if page.marked[k] is None else page.marked[k] == "1"
        if inside[k] and page.tag[k] == "#":
            at = k
            while at >= 0:
                y[at] = 1
                at = page.parent[at]
    return y


def fit(paragraphs: list[str]) -> Trees:
    pages = [Page(x) for x in layouts(paragraphs)]
    return Trees(np.concatenate([p.features() for p in pages]), np.concatenate([labelled(p) for p in pages]))


def train(pages: DataFrame) -> Trees:
    """Trees fitted on layouts of paragraphs of TRAIN_PAGES pages, the same ones whenever the table is the same.

    The pages are those with the least hashes of their ids: ids alone are read to find them, then their html.
    """
    ids = [r[0] for r in pages.select("page_id").filter("page_id is not null").distinct().orderBy(F.xxhash64("page_id"), "page_id").limit(TRAIN_PAGES).collect()]
    some = pages.filter(F.col("page_id").isin(ids) & F.col("html").isNotNull()).select("html", F.xxhash64("page_id", "html").alias("place"))
    found = []
    for r in some.orderBy("place").limit(TRAIN_PAGES).collect():
        found += [t[:CHARS] for t in Page(r["html"]).text if t.count(" ") >= 8][:PARAGRAPHS]
    return fit(found)


def _extract(batches, model: Trees):
    for batch in batches:
        for part in chunks(batch, "html", 2 << 20):
            pages = [Page(x or "") for x in part.column(2).to_pylist()]
            odds = model.odds(np.concatenate([p.features() for p in pages]))
            ends = np.cumsum([len(p.tag) for p in pages])
            texts = [p.main_text(odds[e - len(p.tag) : e]) for p, e in zip(pages, ends, strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extracted(pages: DataFrame, model: Trees | None = None) -> DataFrame:
    """page_id, url, text, n_chars of every row."""
    return arrow_map(pages.select("page_id", "url", "html"), _extract, "page_id long, url string, text string, n_chars long", model or train(pages))


def op4(spark, sf_dir: str) -> DataFrame:
    return extracted(spark.read.parquet(f"{sf_dir}/pages.parquet"))
