"""Main text of web pages by the maximum-scoring contiguous run of tokens.

A page is a run of tags and words. A word scores the log-odds that words in its place (the element it stands in) belong to the article, a tag scores a negative amount that grows with how often it stands outside articles; both are learned from labelled pages. One linear scan finds the best contiguous run, whose blocks, without the elements that never are article text, are the result.
"""

from __future__ import annotations

import html
import math
import re
from collections import defaultdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TRAIN_PAGES = 400  # labelled pages that the weights are learned from, at most
TRAIN_CHARS = 200_000  # longer pages are not used for training
TRAIN_BYTES = 16 << 20  # of the training pages together

#: Fixed values of HTML: elements that hold no article text, raw-text and void elements, and elements inside a block.
NOT_TEXT = frozenset("nav header footer aside script style noscript template form button select option textarea input iframe svg canvas object head title menu dialog audio video math".split())
RAW = frozenset("script style title textarea noscript template iframe".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr param".split())
INLINE = frozenset("a abbr b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements that hold running text: a mark counts there only where it is a whole class, id or role, since their names often tell of what is written (related-work).
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 li dd dt blockquote pre figcaption td th caption q em strong b i span a code".split())
#: Words in class, id and role that mark such elements whatever their name.
MARKS = frozenset("ad ads adbox advert adverts advertisement advertising banner promo promotion sponsor sponsored cookie cookies consent gdpr notice notices alert comment comments commentlist disqus reply replies respond sidebar widget widgets menu nav navbar navigation navigational breadcrumb breadcrumbs share sharing social related recommended footer header masthead subscribe subscription newsletter signup popup modal overlay login toolbar pagination pager skip complementary contentinfo search searchbox toc hidden".split())

_LEX = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
_ATTR = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))|\b(hidden)\b|aria-hidden\s*=\s*[\"']?true|style\s*=\s*[\"'][^\"']*display\s*:\s*none", re.I)
_NAME = re.compile(r"[a-z]+")


def _marked(attrs: str, name: str) -> bool:
    if "=" not in attrs and "hidden" not in attrs.lower():
        return False
    for m in _ATTR.finditer(attrs):
        if not m[1]:
            return True
        value = (m[2] or m[3] or m[4] or "").lower()
        if MARKS.intersection(value.split() if name in PROSE else _NAME.findall(value)):
            return True
    return False


def tokens(page: str):
    """(kind, name, feature, value) in page order: kind 'tag' (value: whether it starts or ends a block) or 'text' (value: the raw text, None where the element is never article text)."""
    out, stack, dropped, at, articles = [], [], 0, 0, 0

    def text(upto: int):
        if upto > at:
            raw = page[at:upto]
            if raw and not raw.isspace():
                block = next((x[0] for x in reversed(stack) if x[0] not in INLINE), "")
                out.append(("text", block, (where(), block), None if dropped else raw))
            elif raw and not dropped:
                out.append(("text", "", None, raw))

    where = lambda: "drop" if dropped else "article" if articles else "page"
    while m := _LEX.search(page, at):
        text(m.start())
        at = m.end()
        if m[2] is None:
            if m[0].startswith("<![CDATA[") and not dropped:
                out.append(("text", "", ("article" if articles else "page", "cdata"), html.escape(m[0][9:].removesuffix("]]>"), quote=False)))
            continue
        name = m[2].lower()
        inline = name in INLINE
        if not m[1]:
            drop = name in NOT_TEXT or _marked(m[3], name)
            out.append(("tag", name, (where(), "open", "marked" if drop else name), not inline))
            if name in VOID or m[3].rstrip().endswith("/") and name not in RAW:
                continue
            if name == "p" and stack and stack[-1][0] == "p":
                _, d, a = stack.pop()  # a paragraph ends where the next one starts
                dropped, articles = dropped - d, articles - a
            stack.append((name, drop, name in ("article", "main")))
            dropped, articles = dropped + drop, articles + stack[-1][2]
            if name in RAW:
                end = re.compile(f"</{re.escape(name)}", re.I).search(page, at)
                at = end.start() if end else len(page)
        else:
            out.append(("tag", name, (where(), "close", name), not inline))
            if any(x[0] == name for x in stack):
                # an unclosed inline element does not keep outer elements from closing
                while stack:
                    n, d, a = stack.pop()
                    dropped, articles = dropped - d, articles - a
                    if n == name:
                        break
    text(len(page))
    return out


def learn(pages) -> dict:
    """Weights by feature from labelled pages: the label is the page's own <article>, without the elements that never are article text."""
    words, tags = defaultdict(lambda: [0, 0]), defaultdict(lambda: [0, 0])
    for page in pages:
        depth = 0
        for kind, name, feature, value in tokens(page):
            if kind == "tag":
                depth += (feature[1] == "open") - (feature[1] == "close") if name == "article" else 0
                tags[feature][int(depth > 0 and name != "article" and feature[2] != "marked")] += 1
            elif feature:
                words[feature][int(depth > 0 and feature[0] != "drop")] += len(value.split()) if value else 5
    odds = lambda c: math.log((c[1] + 1) / (c[0] + 1))
    return {("word", *f): max(-4.0, min(4.0, odds(c))) for f, c in words.items()} | {("tag", *f): -max(0.1, min(6.0, 1 - odds(c))) for f, c in tags.items()}


def _score(weights: dict, kind: str, feature, value) -> float:
    if feature is None:
        return 0.0
    if kind == "tag" and feature[0] == "drop":
        return -0.1
    if kind == "tag":
        return weights.get(("tag", *feature), -0.5 if feature[0] == "page" else -0.1)
    if value is None:
        return -0.05  # in an element that never is article text: nothing is gained, and crossing costs little
    known = weights.get(("word", *feature))
    if known is None:
        known = 1.0 if feature[0] == "article" else 0.5
    return known * len(value.split())


def extract(page: str, weights: dict) -> str:
    """The article's text: blocks joined by two line ends."""
    items = tokens(page)
    has_article = any(k == "tag" and f[1:] == ("open", "article") for k, _, f, _ in items)
    best = run = 0.0
    start = lo = hi = 0
    for i, (kind, _, feature, value) in enumerate(items):
        s = _score(weights, kind, feature, value)
        if has_article and kind == "text" and feature and feature[0] == "page" and ("word", *feature) not in weights:
            s = -abs(s)  # a page that marks its article: unknown places outside it are not text
        if run <= 0:
            run, start = 0.0, i
        run += s
        if run > best:
            best, lo, hi = run, start, i + 1
    blocks, held = [], []
    for kind, name, _, value in items[lo:hi]:
        if kind == "text":
            if value is not None:
                held.append(value)
        elif value:
            blocks.append("".join(held))
            held = []
        elif held or blocks:
            held.append(" " if name == "br" else "")
    blocks.append("".join(held))
    return "\n\n".join(t for t in (" ".join(html.unescape(b).split()) for b in blocks) if t)


def _extract(weights: dict):
    def run(batches):
        import pyarrow as pa

        for b in batches:
            out = [extract(x or "", weights) for x in b.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(out, pa.string()), pa.array(map(len, out), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return run


def extract_text(pages: DataFrame, train_pages: int = TRAIN_PAGES) -> DataFrame:
    """One row per row of pages (page_id, url, html): page_id, url, text, n_chars (code points).

    Weights come from at most train_pages pages, in the order of a hash of page_id, that hold one <article> and at most TRAIN_CHARS characters, and of TRAIN_BYTES together (each whole); every page is extracted whole. Null or empty html gives an empty text; repeated rows are extracted each; an empty table gives an empty result. Other columns are not read.
    """
    labelled = pages.select("page_id", "html").where((F.length("html") <= TRAIN_CHARS) & (F.size(F.split(F.col("html"), "<article[ >]")) == 2))
    first = labelled.groupBy("page_id").agg(F.max(F.octet_length("html")).alias("bytes")).orderBy(F.xxhash64("page_id"), "page_id").limit(train_pages).collect()
    picked, total = [], 0
    for r in first:
        if r.page_id is not None and total + r.bytes <= TRAIN_BYTES:
            total += r.bytes
            picked.append((r.page_id,))
    wanted = F.broadcast(pages.sparkSession.createDataFrame(picked, "page_id long"))
    weights = learn(r.html for r in labelled.join(wanted, "page_id").groupBy("page_id").agg(F.min("html").alias("html")).orderBy("page_id").collect())
    return pages.select("page_id", "url", "html").mapInArrow(_extract(weights), "page_id long, url string, text string, n_chars long")


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
