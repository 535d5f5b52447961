"""Main text of web pages by deducing the template that the pages of a host share.

A token of a page is the path of an element (tags with their classes). Its occurrence vector says how often it occurs in each page of
the host; the vector is kept as an exclusive-or of hashes of (page, count), which tasks and Spark can combine in any order. Tokens
with equal vectors are an equivalence class. Classes whose tokens occur once in every page are the skeleton of the template; classes
with other vectors are valid if one skeleton token encloses all of their tokens, and nest there. What lies between skeleton tokens
are slots. A host's main slot is the one with most text that differs between pages and isn't in links; text that every page
repeats there belongs to the template, if ``SUPPORT`` distinct pages at least have it. Elements that say what they are (nav, footer,
aside, form, class="comments", ...) never count. The slot decides where the text is; marks that pages set themselves (article, main) say
how far a marked slot reaches, and which blocks of it count where they hold most of its text. Alone they serve only pages without the slot
and hosts of fewer than ``SUPPORT`` distinct pages (copies of one page, whatever stands in their noise, teach nothing of what differs).

Only one row per (host, path) travels, summed in each task before it does, so no task gathers a host's pages. Of the digests of a path's
distinct pages the least ``SUPPORT`` travel, which is enough to tell whether there are so many.

Defined results: null html is an empty page and gives an empty text; a null url is a host of its own; repeated rows give repeated
results; unclosed tags and quotes end as browsers end them, a cut tag at the end is dropped.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .scratch import table

SUPPORT = 3
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "xmp", "noembed", "noframes", "template", "svg", "math", "select", "object"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
NOISE_TAGS = {"nav", "footer", "aside", "form", "menu", "button", "dialog", "head", "fieldset"}
NOISE_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "alertdialog", "menu", "menubar", "toolbar"}
NOISE_WORDS = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "alert", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "consent", "cookie", "cookies",
    "copyright", "disqus", "footer", "gdpr", "login", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notification", "overlay", "pager",
    "pagination", "popup", "promo", "promotion", "recommended", "related", "replies", "share", "sharing", "sidebar", "signup", "skip", "social", "sponsor", "sponsored",
    "subscribe", "subscription", "toolbar", "topbar", "widget", "widgets",
}
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
MARKUP = re.compile(r"<!--.*?(?:--!?>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^'\">]++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*(?:>|\Z)|<[a-zA-Z][^>]*\Z", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)"


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(text)}


def _noise(tag: str, attrs: dict[str, str], in_article: bool) -> bool:
    if tag in NOISE_TAGS or tag == "header" and not in_article or attrs.get("role", "").lower() in NOISE_ROLES - ({"banner"} if in_article else set()):
        return True
    if "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attrs.get("style", ""), re.I):
        return True
    if tag in ("html", "body", "main"):
        return False
    for name in f"{attrs.get('class', '')} {attrs.get('id', '')}".split():
        words = [w.lower() for w in WORDS.findall(name)]
        if words and words[0] not in ("has", "with", "without", "no", "is", "not") and (NOISE_WORDS.intersection(words) or words == ["header"] and not in_article):
            return True
    return False


def parse(page: str) -> tuple[list[tuple], dict[str, int]]:
    """Blocks (path, text, noise, in article, in main, linked characters) in page order, and how often each element path occurs."""
    blocks: list[tuple] = []
    counts: dict[str, int] = {}
    stack: list[tuple] = [("", "", False, False, False, False)]  # tag, path, noise, article, main, link
    parts: list[str] = []
    linked = 0
    owner = stack[0]

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            if text:
                blocks.append((owner[1], text, owner[2], owner[3], owner[4], linked))
            parts.clear()
        linked = 0

    def add(text: str) -> None:
        nonlocal owner, linked
        top = stack[-1]
        if not parts:
            owner = next(x for x in reversed(stack) if x[0] not in INLINE)
        if top[2] and not owner[2]:  # an inline element that is noise by its class
            return
        parts.append(text)
        if top[5]:
            linked += len(text)

    def pop_to(k: int) -> None:
        if any(x[0] not in INLINE for x in stack[k:]):
            flush()
        del stack[k:]

    at = 0
    while m := MARKUP.search(page, at):
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if m[1] or m[4]:
            k = next((k for k in range(len(stack) - 1, 0, -1) if stack[k][0] == tag), 0)
            if k:
                pop_to(k)
            elif tag == "p":
                flush()
            continue
        if tag not in INLINE:
            k = next((k for k in range(len(stack) - 1, 0, -1) if stack[k][0] == "p" or stack[k][0] in ("table", "button")), 0)
            if k and stack[k][0] == "p" and tag not in VOID:
                pop_to(k)
            flush()
        if tag in RAW:
            end = re.compile(rf"</{tag}[\s/>]", re.I).search(page, at)
            at = len(page) if end is None else (page.find(">", end.start()) + 1 or len(page))
            continue
        if tag in VOID:
            continue
        if tag in CLOSES:
            own, stop = CLOSES[tag]
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] in stop:
                    break
                if stack[k][0] in own:
                    pop_to(k)
                    break
        up = stack[-1]
        attrs = _attributes(m[3] or m[6] or "")
        name = tag
        if tag not in INLINE and attrs.get("class"):
            name += "." + ".".join(sorted({re.sub(r"\d+", "", c) for c in attrs["class"].split()}))
        path = up[1] if tag in INLINE else f"{up[1]}/{name}"
        if tag not in INLINE:
            counts[path] = counts.get(path, 0) + 1
        noise = up[2] or _noise(tag, attrs, up[3])
        article = up[3] or (tag == "article" or attrs.get("itemprop") == "articleBody") and not noise
        stack.append((tag, path, noise, article, up[4] or (tag == "main" or attrs.get("role") == "main") and not noise, up[5] or tag == "a"))
    if at < len(page):
        add(page[at:])
    flush()
    return blocks, counts


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, path, pages, vector, ones, chars, articles, mains, low, high, texts): what a task's pages say of each path; low = high if its text never
    differs, articles and mains count the characters marked so, and texts are the least digests of the distinct pages that have it."""
    seen: dict[tuple, list] = {}
    schema = pa.schema([("host", pa.string()), ("path", pa.string()), ("pages", pa.int64()), ("vector", pa.int64()), ("ones", pa.int64()), ("chars", pa.int64()), ("articles", pa.int64()), ("mains", pa.int64()), ("low", pa.int64()), ("high", pa.int64()), ("texts", pa.list_(pa.int64()))])

    def out() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*((*k, *v) for k, v in seen.items())), schema.types)], schema=schema)
        seen.clear()
        return batch

    for batch in batches:
        for host, page_id, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            blocks, counts = parse(page.as_py() or "")
            counts[""] = 1  # the page itself, so that a host has one path at least that all of its pages have
            texts: dict[str, tuple[int, int, int, int]] = {}
            for path, text, noise, article, main, linked in blocks:
                if not noise:
                    chars, articles, mains, digest = texts.get(path, (0, 0, 0, 0))
                    own = max(0, len(text) - linked)
                    texts[path] = chars + own, articles + own * article, mains + own * main, xxhash.xxh3_64_intdigest(f"{digest} {text}")
            whole = xxhash.xxh3_64_intdigest(" ".join(b[1] for b in blocks if not b[2])) & (1 << 63) - 1
            for path, n in counts.items():
                chars, articles, mains, digest = texts.get(path, (0, 0, 0, 0))
                digest = (digest & (1 << 63) - 1) if path in texts else 0
                vector = xxhash.xxh3_64_intdigest(f"{page_id} {n}") - (1 << 63)
                s = seen.get((host, path))
                if s is None:
                    seen[host, path] = [1, vector, int(n == 1), chars, articles, mains, digest, digest, [whole]]
                else:
                    s[0] += 1
                    s[1] ^= vector
                    s[2] += n == 1
                    s[3] += chars
                    s[4] += articles
                    s[5] += mains
                    s[6], s[7] = min(s[6], digest), max(s[7], digest)
                    if whole not in s[8]:
                        s[8] = sorted([*s[8], whole])[:SUPPORT]
            if len(seen) > 50_000:
                yield out()
    if seen:
        yield out()


def deduce(paths: list[str], pages: list[int], vectors: list[int], ones: list[int], chars: list[int], articles: list[int], mains: list[int], fixed: list[bool]) -> tuple[str | None, list[str]]:
    """(path of the main slot, paths whose text belongs to the template) of a host, from its equivalence classes; ``fixed`` says which paths
    have the same text on SUPPORT distinct pages or more, and on all that have the path."""
    n = max(pages)
    classes: dict[int, list[int]] = {}
    for i, v in enumerate(vectors):
        classes.setdefault(v, []).append(i)
    skeleton = {paths[i] for i in range(len(paths)) if pages[i] == n and ones[i] == n}  # one class: their vectors are all ones

    def slot(path: str) -> str:
        while path and path not in skeleton:
            path = path.rpartition("/")[0]
        return path

    content, in_article, in_main = {}, {}, {}
    for members in classes.values():
        homes = {slot(paths[i]) for i in members} if paths[members[0]] not in skeleton else set()
        for i in members:
            # a class that isn't enclosed by one slot isn't valid; its members are judged one by one
            home = slot(paths[i]) if len(homes) != 1 else next(iter(homes))
            if not fixed[i]:
                for weights, own in ((content, chars), (in_article, articles), (in_main, mains)):
                    weights[home] = weights.get(home, 0) + own[i]
    if not content or not max(content.values()):
        return None, []

    def within(weights: dict[str, int], path: str) -> int:
        return sum(v for k, v in weights.items() if k == path or k.startswith(path + "/"))

    main = max(content, key=lambda k: (content[k], in_article[k], in_main[k], -len(k)))
    marks = next((w for w in (in_article, in_main) if 2 * w[main] >= content[main]), None)
    parent = main.rpartition("/")[0]
    if marks:  # a marked slot is read with what is marked around it
        up = main
        while up:
            up = up.rpartition("/")[0]
            if within(marks, up) > within(marks, main):
                main = up
    elif parent.count("/") > 1 and within(content, parent) > within(content, main):
        main = parent  # text split over sibling slots of one parent (a headline beside a body) is read together
    return main, [paths[i] for i in range(len(paths)) if fixed[i] and chars[i] and paths[i].startswith(main)]


def _templates(pdf: pd.DataFrame) -> pd.DataFrame:
    main, fixed = deduce(*(pdf[c].tolist() for c in ("path", "pages", "vector", "ones", "chars", "articles", "mains")), ((pdf["low"] == pdf["high"]) & (pdf["distinct"] >= SUPPORT)).tolist())
    return pd.DataFrame({"host": [pdf["host"].iloc[0]], "pages": [int(pdf["distinct"].max())], "main": [main], "fixed": [fixed]})


def main_text(page: str, main: str | None, fixed: list[str], pages: int) -> str:
    """A page's main text, given its host's template and how many distinct pages it comes from (SUPPORT stands for more)."""
    blocks = [b for b in parse(page)[0] if not b[2]]
    if pages >= SUPPORT and main is not None:
        skip = set(fixed)
        inside = [b for b in blocks if (b[0] == main or b[0].startswith(main + "/")) and b[0] not in skip]
        for mark in (3, 4):
            if 2 * sum(len(b[1]) for b in inside if b[mark]) > sum(len(b[1]) for b in inside):
                inside = [b for b in inside if b[mark]]
                break
        if inside:
            return " ".join(b[1] for b in inside)
    for mark in (3, 4):  # what the page itself calls its article, or else its main part
        if any(b[mark] for b in blocks):
            return " ".join(b[1] for b in blocks if b[mark])
    # one page alone: the smallest element that holds most of its text outside links
    weights: dict[str, int] = {}
    for path, text, _, _, _, linked in blocks:
        own = max(0, len(text) - 2 * linked)
        while path:
            weights[path] = weights.get(path, 0) + own
            path = path.rpartition("/")[0]
    total = max(weights.values(), default=0)
    best = max((p for p, w in weights.items() if w >= 0.7 * total and not re.search(r"/(?:p|h[1-6]|li|td|blockquote|pre)[^/]*$", p)), key=lambda p: p.count("/"), default="")
    return " ".join(b[1] for b in blocks if b[5] < 0.8 * len(b[1]) and (b[0] == best or b[0].startswith(best + "/")))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = []
        for page, main, fixed, pages in zip(batch.column("html"), batch.column("main").to_pylist(), batch.column("fixed").to_pylist(), batch.column("pages").to_pylist()):
            texts.append(main_text(page.as_py() or "", main, fixed or [], pages or 0))
        rest = [batch.column("page_id"), batch.column("url")]
        yield pa.RecordBatch.from_arrays([*rest, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: page_id, url, text, n_chars. The templates are one row per host; pages take theirs by an equi-join on the host,
    which Spark broadcasts where the templates are few and splits where a host is large."""
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).cast("string").alias("html"), F.lower(F.coalesce(F.regexp_extract(url_col, HOST, 1), F.lit(""))).alias("host"))
    tokens = rows.select("host", F.coalesce(F.col("page_id").cast("string"), F.col("url"), F.lit("")).alias("page"), "html").mapInArrow(_tokens, "host string, path string, pages long, vector long, ones long, chars long, articles long, mains long, low long, high long, texts array<long>")
    tokens = tokens.groupBy("host", "path").agg(F.sum("pages").alias("pages"), F.bit_xor("vector").alias("vector"), F.sum("ones").alias("ones"), F.sum("chars").alias("chars"), *(F.sum(c).alias(c) for c in ("articles", "mains")), F.min("low").alias("low"), F.max("high").alias("high"), F.size(F.array_distinct(F.flatten(F.collect_list("texts")))).alias("distinct"))
    templates = tokens.groupBy("host").applyInPandas(_templates, "host string, pages long, main string, fixed array<string>")
    kind = pages.schema[id_col].dataType.simpleString()
    return rows.join(templates, "host", "left").select("page_id", "url", "html", "main", "fixed", "pages").mapInArrow(_extract, f"page_id {kind}, url string, text string, n_chars long")


def op4_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
