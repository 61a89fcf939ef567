"""Main text of web pages: boosted trees over elements, decoded along the tree.

Elements are blocks, inline elements whose attributes tell something, and the paragraphs that
loose text forms outside all blocks or right in the body. Each has features of its subtree (text, links, tags and their densities,
punctuation), its attribute words and those of its ancestors, its depth and its siblings.
Gradient-boosted trees give it log odds of belonging to the article. Decoding keeps the
set of elements with the largest sum of log odds in which no element is kept below a
dropped one, so an ancestor and a descendant cannot contradict each other.

The trees are trained on the driver on pages that a rule writes (see ``page_templates``), of
which there are ``TRAINING_PAGES``, so training doesn't depend on the corpus and its model is
small.

Defined cases: null or empty html, and pages without an article, give an empty text;
repeated rows give repeated results; an empty table gives an empty result; columns besides
those named are not read.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from anamnesis.llm.boosting import Trees, fit
from anamnesis.llm.common import map_rows, pick
from anamnesis.llm.html import Page

TRAINING_PAGES = 700

# Words of class, id and role that speak for or against an article.
AGAINST = frozenset(
    "ad ads advert advertisement adsbygoogle banner bar breadcrumb breadcrumbs byline comment comments complementary consent contentinfo"
    " cookie cookies copyright disqus footer form gdpr header hidden login masthead menu modal nav navbar navigation"
    " newsletter notice overlay pager pagination popup privacy promo promoted recommended related replies reply respond search share"
    " sharing sidebar signup skip social sponsor sponsored subscribe tags toolbar topbar warning widget widgets".split()
)
FOR = frozenset("article articlebody body content entry main page post prose story text".split())
GROUPS = {
    name: i
    for i, names in enumerate(
        (
            "p #loose", "h1", "h2 h3 h4 h5 h6", "li dt dd", "ul ol dl", "td th", "table thead tbody tfoot tr caption", "blockquote pre figure figcaption",
            "div", "section", "article main", "nav menu", "aside", "header", "footer", "form fieldset legend button input option", "body",
        ),
        1,
    )
    for name in names.split()
}
_OUTSIDE = frozenset(("nav", "aside", "footer", "form", "menu", "dialog"))
_MARKS = ".,;:!?"


def features(page: Page) -> np.ndarray:
    """A row for each element."""
    n = len(page.tag)
    chars, linked, marks, tags, runs = [0] * n, [0] * n, [0] * n, [1] * n, [0] * n
    before = [0] * n
    passed, seen = 0, 0
    signs = [0] * n
    for node, _, text, link in page.runs:
        while seen < node:
            seen += 1
            before[seen] = passed
        size = len(text)
        if size < 40:
            size = len(text.strip())
            if not size:
                continue
        passed += size
        chars[node] += size
        runs[node] += 1
        if link:
            linked[node] += size
        marks[node] += sum(map(text.count, _MARKS))
        if "©" in text:
            signs[node] = 1
    for k in range(seen + 1, n):
        before[k] = passed
    own = chars[:]
    parent = page.parent
    for i in range(n - 1, 0, -1):
        p = parent[i]
        chars[p] += chars[i]
        linked[p] += linked[i]
        marks[p] += marks[i]
        tags[p] += tags[i]
    depth, against, good, above_against, above_good = [0] * n, [0] * n, [0] * n, [0] * n, [0] * n
    outside, inside, children = [0] * n, [0] * n, [0] * n
    groups = [0] * n
    place, previous = [0] * n, [0] * n
    last_child = [0] * n
    for i in range(1, n):
        p, tag = parent[i], page.tag[i]
        depth[i] = depth[p] + 1
        if words := page.words[i]:
            against[i] = len(AGAINST.intersection(words))
            good[i] = len(FOR.intersection(words))
        above_against[i] = above_against[p] + against[p]
        above_good[i] = above_good[p] + good[p]
        outside[i] = outside[p] or tag in _OUTSIDE
        inside[i] = inside[p] or tag == "article" or tag == "main"
        groups[i] = GROUPS.get(tag, 0)
        place[i] = children[p]
        children[p] += 1
        previous[i] = last_child[p]
        last_child[p] = i
    total = max(1, passed)
    table = np.array(
        [groups, chars, linked, marks, tags, depth, against, good, above_against, above_good, outside, inside, children, place, own, runs, before, signs, parent, previous],
        np.float64,
    )
    c, p, q = table[1], table[18].astype(int), table[19].astype(int)
    some = np.maximum(c, 1)
    return np.column_stack(
        [
            table[0],
            np.log1p(c),
            table[2] / some,
            100 * table[3] / some,
            c / table[4],
            table[4],
            *table[5:14],
            table[12][p] - 1 - table[13],
            np.log1p(table[14]),
            table[14] / some,
            table[15],
            table[16] / total,
            c / total,
            c / np.maximum(c[p], 1),
            table[17],
            table[0][p],
            table[0][q],
            np.log1p(c[q]),
            table[2][p] / np.maximum(c[p], 1),
            table[6][q],
        ]
    )


def decode(parent: list[int], odds: list[float]) -> list[bool]:
    """The elements of the best set in which all ancestors of an element are in it."""
    n = len(parent)
    best = list(odds)
    best[0] = 0.0
    for i in range(n - 1, 0, -1):
        if best[i] > 0:
            best[parent[i]] += best[i]
    kept = [True] * n
    for i in range(1, n):
        kept[i] = kept[parent[i]] and best[i] > 0
    return kept


@lru_cache(maxsize=1)
def trained() -> Trees:
    """The model; it is made once in a driver."""
    from anamnesis.llm.page_templates import labelled_pages

    rows, labels = [], []
    for html in labelled_pages(TRAINING_PAGES):
        page = Page(html)
        rows.append(features(page)[1:])
        labels += [m == "1" for m in page.mark[1:]]
    return fit(np.concatenate(rows), np.array(labels, float))


def extract(pages: list[str | None], model: Trees) -> list[str]:
    """Main texts; the elements of all pages are scored together."""
    read = [Page(html or "") for html in pages]
    if not read:
        return []
    rows = [features(p) for p in read]
    odds = model.log_odds(np.concatenate(rows))
    out, at = [], 0
    for page, mine in zip(read, rows):
        kept = decode(page.parent, odds[at : at + len(mine)].tolist())
        if all(t == "#loose" for t in page.tag[1:]):  # a page without elements is its text
            kept = [True] * len(kept)
        out.append(page.text(kept))
        at += len(mine)
    return out


def extract_pages(pages: DataFrame, model: Trees | None = None, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """One row per row of ``pages``: the id, ``url`` and ``text``."""
    shared = pages.sparkSession.sparkContext.broadcast(model or trained())

    def rows(batches):
        for batch in batches:
            for i in range(0, len(batch["id"]), 200):
                part = slice(i, i + 200)
                yield from zip(batch["id"][part], batch["url"][part], extract(batch["html"][part], shared.value))

    return map_rows(
        pick(pages, id_col, "url", html_col).toDF("id", "url", "html").withColumn("id", F.col("id").cast("long")),
        f"{id_col} long, url string, text string",
        pa.schema([(id_col, pa.int64()), ("url", pa.string()), ("text", pa.string())]),
        rows,
        lambda row: 64 + len(row[1] or "") + 2 * len(row[2]),
    )
