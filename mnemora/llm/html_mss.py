"""Main text of web pages as a maximum-scoring subsequence.

A page is a sequence of tags and runs of text. A run scores its words times the weight of the
element it stands in; a tag scores its own weight; furniture inside the content scores 0. One
linear scan finds the contiguous stretch with the greatest sum, and the text of that stretch, without
what is marked as furniture inside it, is the main text.

Weights are log-odds learned from labelled pages: pages whose markup names the content (exactly
one ``article``, or else one ``main``). Words are positive and tags negative as a rule; a kind of
word or tag that labelled pages have only outside their content is negative, and tags that they
have only inside may be positive. Kinds that fewer than ``KIND_PAGES`` pages of the sample hold take
the defaults. The sample is ``SAMPLE_PAGES`` pages, those with the smallest hashes of their ids.

Extraction is per row, where the row is read: pages are not shuffled, but for those of the sample.
A page of any length is scanned whole.
"""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches

#: Pages of which the weights are learned, and how many of them must hold a kind of token.
SAMPLE_PAGES, KIND_PAGES = 2000, 2
#: Weights of kinds that the labelled pages don't show: words, words in furniture, tags.
WORD, FURNITURE, TAG = 0.5, -2.0, -0.4

# Fixed values of HTML.
RAW = {"script", "style", "noscript", "template", "iframe", "svg", "textarea", "title"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
BLOCK = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul".split())
ENDS_P = BLOCK - {"body", "caption", "head", "html", "legend", "option", "summary", "tbody", "td", "tfoot", "th", "thead", "tr"}
#: Elements that close an open element of the same group.
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
FURNITURE_TAGS = {"nav", "aside", "footer", "form", "button", "select", "menu", "dialog", "head"}
FURNITURE_ROLES = {"navigation", "banner", "complementary", "contentinfo", "search", "dialog", "alert", "alertdialog", "menu", "form"}
FURNITURE_WORDS = set("ad ads adv advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs byline comment comments cookie cookies consent disclaimer disqus footer footnav gdpr header login masthead menu modal nav navbar navigation newsletter notice notification overlay pager pagination popup promo promoted promotion related recommended recommendations reply replies respond search share sharing sidebar signup skip social sponsor sponsored subscribe subscription tags toc toolbar topbar widget".split())

#: Of these, what names a part of an article, inside it.
ARTICLE_WORDS = {"byline", "tags"}
#: What class names of furniture hold besides such words: "related-posts", "ad-slot".
FURNITURE_PARTS = set("area article articles bar block body box btn button buttons container content form group icon icons inline inner item items label link links list module outer panel post posts section slot text title unit wrap wrapper".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<![^>]*+(?:>|\Z)|<\?[^>]*+(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)"
    r"|<|[^<]++",
    re.S,
)
_ATTR = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_SPLIT = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[A-Z])")


class _Open:
    """An open element: its tag, kind and whether it is furniture (0: no, 1: yes, 2: yes, and inside
    article or main)."""

    __slots__ = ("tag", "kind", "out", "content")

    def __init__(self, tag: str, kind: str, out: int, content: bool) -> None:
        self.tag, self.kind, self.out, self.content = tag, kind, out, content


def _opened(tag: str, attrs: str, parent: _Open) -> _Open:
    names, ids, role = [], [], ""
    for m in _ATTR.finditer(attrs) if "=" in attrs else ():
        value = m[2] or m[3] or m[4] or ""
        if m[1].lower() == "role":
            role = value.lower()
        else:
            names += value.split()
            ids += [m[1].lower() == "id"] * len(value.split())
    words = [{w for w in re.split(r"[^a-z0-9]+", re.sub(r"(?<=[a-z])(?=[A-Z])", " ", n).lower()) if w} for n in names]
    content = parent.content or tag in ("article", "main")
    out = parent.out or tag in FURNITURE_TAGS or tag == "header" and not content or role in FURNITURE_ROLES
    if not out and tag not in ("html", "body", "article", "main", "h1"):
        if parent.content:  # an id, or a word of a longer name, may be what the text is about
            out = tag not in HEADINGS and any(w & (FURNITURE_WORDS - ARTICLE_WORDS) and w <= FURNITURE_WORDS | FURNITURE_PARTS for w, by_id in zip(words, ids, strict=True) if not by_id)
        else:
            out = any(w & FURNITURE_WORDS for w in words)
    kind = tag + ("." + names[0].lower() if names else "")
    place = parent.out or (2 if parent.content else 1) if out else 0
    return _Open(tag, kind + "!" if out else kind, place, content)


def tokens(page: str) -> Iterator[tuple[str, str | None, int, bool]]:
    """``kind, text, furniture, block``: for a tag, its kind with text None; for a run of text,
    the kind of the element it is in. furniture: as in ``_Open``. block: a tag that ends a block of text."""
    stack = [_Open("", "", 0, False)]
    held: dict[str, int] = {}  # open elements by tag

    def close(i: int) -> None:
        """Close the elements from place i of the stack."""
        for o in stack[i:]:
            held[o.tag] -= 1
        del stack[i:]

    at, n = 0, len(page)
    while at < n:
        m = _TOKEN.match(page, at)
        at = m.end()
        tag = m[2] or m[5]
        if tag is None:
            text = m[0]
            if not text.startswith(("<!", "<?")):
                yield "w@" + stack[-1].kind, text, stack[-1].out, False
            continue
        tag = tag.lower()
        block = tag in BLOCK
        if m[1] or m[4]:
            if tag == "p" and not any(o.tag == "p" for o in stack[-8:]):
                yield "/p", None, stack[-1].out, True
            elif held.get(tag):
                i = len(stack) - 1  # what is passed on the way is closed too, so each element is passed once
                while stack[i].tag != tag:
                    i -= 1
                kind, out = stack[i].kind, stack[i].out
                close(i)
                yield "/" + kind, None, out, block
            else:
                yield "/" + tag + "?", None, stack[-1].out, block
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            at = end.end() if end else n
            continue
        if tag in VOID:
            yield tag, " " if tag == "br" else None, stack[-1].out, tag == "hr"
            continue
        if tag in ENDS_P and stack[-1].tag in ("p", "a") and any(o.tag == "p" for o in stack[-4:]):
            close(max(i for i in range(max(0, len(stack) - 4), len(stack)) if stack[i].tag == "p"))
        elif tag in SIBLINGS:
            while stack[-1].tag in SIBLINGS[tag] or (stack[-1].tag in ("p", "a") and len(stack) > 2 and stack[-2].tag in SIBLINGS[tag]):
                close(len(stack) - 1)
        new = _opened(tag, m[3] or m[6] or "", stack[-1])
        if not block and tag != "a" and (stack[-1].out or not new.out):  # inline elements don't count as places, but where furniture begins
            yield "<" + tag, None, stack[-1].out, False
            continue
        stack.append(new)
        held[tag] = held.get(tag, 0) + 1
        yield "<" + new.kind, None, new.out, block


def label(page: str) -> list[tuple[str, int, bool]] | None:
    """``kind, n, inside`` of a labelled page's tokens (n: words, or 1 for a tag); None if the
    page doesn't name its content."""
    got = list(tokens(page))
    for tag in ("article", "main"):
        opens = [i for i, t in enumerate(got) if t[1] is None and re.match(rf"<{tag}\b", t[0])]
        if len(opens) == 1:
            break
    else:
        return None
    start = opens[0]
    end = next((i for i in range(start, len(got)) if got[i][1] is None and re.match(rf"/{tag}\b", got[i][0])), len(got))
    return [(k, 1 if text is None else len(text.split()), start <= i <= end) for i, (k, text, _, _) in enumerate(got) if text is None or text.strip()]


def learn(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", sample: int = SAMPLE_PAGES) -> dict[str, float]:
    """Weights by kind, from the labelled pages of the sample. Ids are chosen first, by hashes (null
    is an id; ties go to the smaller id), so only the sample's pages move; of pages that repeat an
    id one counts, that with the least hash of its text. Null and empty pages have no kinds; an empty table gives
    no weights. The result is bounded by the sample."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[str, bool], list[int]] = {}
        for b in batches:
            for page in b.column(0).to_pylist():
                seen = set()
                for kind, n, inside in label(page or "") or ():
                    x = sums.setdefault((kind, inside), [0, 0])
                    x[0] += n
                    x[1] += kind not in seen
                    seen.add(kind)
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in sums], pa.string()), pa.array([i for _, i in sums], pa.bool_()), *(pa.array([x[j] for x in sums.values()], pa.int64()) for j in (0, 1))], ["kind", "inside", "n", "pages"])

    ids = pages.select(F.xxhash64(F.col(id_col)).alias("_h"), F.col(id_col).alias("_i")).distinct().orderBy("_h", "_i").limit(sample)
    own = pages.select(F.col(id_col).alias("i"), F.col(html_col).alias("page"))
    picked = own.join(F.broadcast(ids), F.col("i").eqNullSafe(F.col("_i")), "left_semi")
    one = picked.groupBy("i").agg(F.min_by("page", F.xxhash64("page")).alias("page")).select("page")
    counts = one.mapInArrow(count, "kind string, inside boolean, n long, pages long").groupBy("kind").agg(F.sum(F.when(F.col("inside"), F.col("n")).otherwise(0)).alias("i"), F.sum(F.when(F.col("inside"), 0).otherwise(F.col("n"))).alias("o"), F.sum("pages").alias("pages"))
    rows = counts.filter(F.col("pages") >= KIND_PAGES).orderBy("kind").collect()
    weights: dict[str, float] = {}
    for words in (True, False):
        own = [r for r in rows if r["kind"].startswith("w@") == words]
        all_in, all_out = sum(r["i"] for r in own) + 1, sum(r["o"] for r in own) + 1
        for r in own:
            odds = math.log((r["i"] + 0.5) / all_in) - math.log((r["o"] + 0.5) / all_out)
            # seen on both sides: words stay positive and tags negative
            mixed = r["i"] > 0.02 * r["o"] and r["o"] > 0.02 * r["i"]
            if words:
                weights[r["kind"]] = max(0.05, min(odds, 1.0)) if mixed or odds > 0 else max(odds, -3.0)
            else:
                weights[r["kind"]] = min(-0.05, odds) if mixed or odds < 0 else min(odds, 3.0)
                if odds < 0 and not mixed:
                    weights[r["kind"]] = max(odds, -8.0) - 2.0
    return weights


def best_stretch(scores: list[float]) -> tuple[int, int]:
    """Begin and end (exclusive) of the contiguous stretch with the greatest positive sum, the
    first and longest of several; (0, 0) if no score is positive."""
    best, begin, end, total, start = 0.0, 0, 0, 0.0, 0
    for i, s in enumerate(scores):
        if total < 0:
            total, start = 0.0, i
        total += s
        if total > best or total == best and best > 0 and start == begin:
            best, begin, end = total, start, i + 1
    return begin, end


def passed_over(got: list[tuple[str, str | None, int, bool]]) -> list[bool]:
    """Whether a token is furniture inside the content, which costs a stretch nothing: it is inside
    article or main, or between two runs of text in elements of the same kind."""
    over, start, last = [out == 2 for _, _, out, _ in got], None, ""
    for i, (kind, text, out, _) in enumerate(got):
        if out:
            start = i if start is None else start
        elif text is not None and text.strip() and kind.startswith("w@"):
            if start is not None and kind == last:
                over[start:i] = [got[j][2] > 0 for j in range(start, i)]
            start, last = None, kind
    return over


def extract(page: str | None, weights: dict[str, float]) -> str:
    """The main text of a page: character references decoded, white space inside a block turned
    into one space, blocks joined by one space. Null or empty page, or one without words: ''."""
    if not page:
        return ""
    got = list(tokens(page))
    scores = []
    for (kind, text, out, _), over in zip(got, passed_over(got), strict=True):
        if over:
            scores.append(0.0)
        elif text is None:
            scores.append(weights.get(kind, TAG))
        elif kind.startswith("w@"):
            scores.append(len(text.split()) * min(FURNITURE, weights.get(kind, FURNITURE)) if out else len(text.split()) * weights.get(kind, WORD))
        else:
            scores.append(weights.get(kind, -0.05))
    begin, end = best_stretch(scores)
    blocks, run = [], []
    for kind, text, out, block in got[begin:end]:
        if block:
            blocks.append("".join(run))
            run = []
        elif text is not None and not out:
            run.append(text)
    blocks.append("".join(run))
    return " ".join(x for x in (" ".join(html.unescape(b).split()) for b in blocks) if x)


def extract_text(pages: DataFrame, weights: dict[str, float], id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``<id_col>, <url_col>, text`` for every row, repeated rows alike. Null and empty pages have the
    text ''; of stretches that tie, the first is taken; an empty table gives none; extra columns are
    left out."""
    w = pages.sparkSession.sparkContext.broadcast(weights)  # of the sample's size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in (b.slice(i, 200) for i in range(0, b.num_rows, 200)):
                texts = pa.array([extract(x, w.value) for x in part.column(2).to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), texts], [id_col, url_col, "text"])

    own = pages.select(id_col, url_col, html_col)
    bounded_batches(pages.sparkSession)
    return own.mapInArrow(run, f"{id_col} {own.schema[0].dataType.simpleString()}, {url_col} string, text string")
