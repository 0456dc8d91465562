"""Main text of web pages as the maximum-scoring run of tokens (operator 8)."""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>|[^<]+|<", re.S)
ATTRS = re.compile(r"""(class|id|role|hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.I)
#: Elements whose content is text alone, up to their own end tag whatever stands before it; without one, to the end of the page.
RAW = {n: re.compile(rf"</{n}(?=[\s/>])[^>]*(?:>|\Z)", re.I) for n in ("script", "style", "iframe", "textarea", "title")}
#: Elements with markup of their own that is not shown.
UNSEEN = {"noscript", "template", "svg"}
#: What may stand in a head besides; anything else begins the body.
HEAD_ONLY = {"html", "head", "base", "link", "meta"}
APART = {"nav", "aside", "footer", "form", "button", "select", "dialog", "menu"}
UNLIKE = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|cookie\w*|consent|notice|alert|popup|modal|sidebar|side|widget|nav\w*|menu|"
    r"breadcrumbs?|footer|comments?|replies|respond|disqus|share|social|related|newsletter|subscribe|login|pagination|pager)(?=$|[\s_-])",
    re.I,
)
HEAD = re.compile(r"(?:^|[\s_-])(?:header|masthead|topbar|banner)(?=$|[\s_-])", re.I)
#: A class that says what a page has or lacks, and names of wrappers, which hold to whole names only.
WITH = re.compile(r"(?:^|[_-])(?:has|have|no|not|non|with|without)[_-]", re.I)
LAYOUT = {"wrapper", "layout", "page", "container", "site", "body", "main", "content"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {
    "a", "abbr", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark",
    "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr",
}
#: Elements of running text; their names say what they are only as a whole.
PROSE = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "dt", "dd", "blockquote", "pre", "td", "th", "figcaption"}
SPACE = re.compile(r"\s+")


class Block:
    """A run of text between block tags: where it stands, its words, and whether markup sets it apart."""

    __slots__ = ("apart", "article", "linked", "parts", "tags", "under", "where")

    def __init__(self, where: str, article: int, apart: bool, under: bool, tags: list[str]) -> None:
        self.where, self.article, self.apart, self.under, self.tags = where, article, apart, under, tags
        self.parts: list[str] = []
        self.linked = 0

    @property
    def inside(self) -> bool:
        return self.article > 0


def marked(pattern: re.Pattern[str], names: str) -> bool:
    """Whether one of an element's names is of the pattern: whole for a wrapper, or in a part of it."""
    if not pattern.search(names):
        return False
    own = [n for n in names.lower().split() if not WITH.search(n)]
    return any(map(pattern.search if LAYOUT.isdisjoint(own) else pattern.fullmatch, own))


def wholly(pattern: re.Pattern[str], names: str) -> bool:
    """Whether all parts of all of an element's names are of the pattern, as those of ``cookie-notice`` are and those of ``share-price`` not."""
    return all(map(pattern.fullmatch, re.findall(r"[^\s_-]+", names)))


def blocks(page: str) -> list[Block]:
    """Blocks of a page in order, with what sets them apart.

    A class or form around an article sets it apart only where another article is without such a mark, and
    a form that holds more than half of the words of a page without articles sets nothing apart.
    """
    found = list(_scan(page))
    loose = [b for b in found if b.under and not b.apart]
    if loose:
        size = {id(b): len("".join(b.parts).split()) for b in found}
        if any(b.inside for b in found):
            reached = any(b.inside and not b.under and not b.apart and size[id(b)] for b in found)
        else:
            reached = 2 * sum(size[id(b)] for b in loose) <= sum(size.values())
        for b in loose:
            b.apart = reached or not b.inside and any(x.inside for x in found)
    return found


def _scan(page: str) -> Iterator[Block]:
    """Blocks of a page in order. The tags since the block before come with each block.

    ``inside`` says whether the block is in an article or main element, the label that pages give themselves;
    ``article`` numbers the outermost of these from 1. ``under`` says that only a class or form around its article,
    or a form around what is in none, may set it apart. A head ends at its end tag, at a body or at the first thing that belongs to a body.
    """
    stack: list[tuple[str, int, bool]] = []  # name, sets apart (1 as a form, 2 by its class, 3 by its name), is an article
    tags: list[str] = []
    block: Block | None = None
    head, articles = False, 0
    tokens = TOKEN.finditer(page)
    while (m := next(tokens, None)) is not None:
        name = m.group(2)
        if name is None:
            if m.group()[0] == "<" and len(m.group()) > 1 or any(x[0] in UNSEEN for x in stack):
                continue
            if head and m.group().isspace():
                continue
            head = False
            if block is None:
                where = next((n for n, _, _ in reversed(stack) if n not in INLINE), "")
                top = next((i for i, x in enumerate(stack) if x[2]), None)
                outer = max((x[1] for x in stack[:top]), default=0)
                own = 0 if top is None else max(x[1] for x in stack[top:])
                apart = own > 0 or outer > (1 if top is None else 2)
                block = Block(where, 0 if top is None else articles, apart, outer > 0, tags)
                tags = []
            block.parts.append(m.group())
            if any(n == "a" for n, _, _ in stack[-3:]):
                block.linked += len(m.group().split())
            continue
        name, closing = name.lower(), bool(m.group(1))
        if name in RAW:
            if not closing and not m.group(3).rstrip().endswith("/"):  # as XML writes an empty one
                end = RAW[name].search(page, m.end())
                tokens = TOKEN.finditer(page, end.end() if end else len(page))
            continue
        if name == "body" and not closing:  # nothing that a head left open reaches into it
            stack = [x for x in stack if x[0] not in UNSEEN]
        empty = m.group(3).rstrip().endswith("/")
        unseen = next((i for i, x in enumerate(stack) if x[0] in UNSEEN), None)
        if unseen is not None or name in UNSEEN:
            if not closing:
                if not empty and name not in VOID:
                    stack.append((name, 0, False))
                continue
            at = max((i for i, x in enumerate(stack) if x[0] == name), default=-1)
            if at >= 0 and (name in UNSEEN or at > unseen):
                del stack[at:]
                continue
            if at < 0 or name in INLINE or name == "p":
                continue  # else the element around ends, and with it what is not shown
        if name == "head":
            head = not closing
            continue
        if head and name in HEAD_ONLY:
            continue
        head = False
        if name == "br":
            if block is not None:
                block.parts.append(" ")
            continue
        if name not in INLINE:
            if block is not None:
                yield block
                block = None
            tags.append(("/" if closing else "") + name)
        if name in VOID:
            continue
        if closing:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    del stack[i:]
                    break
                if stack[i][0] in ("article", "main", "body") and name in INLINE:
                    break
        else:
            if name == "p":  # a paragraph ends the one before, and what that left open
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == "p":
                        del stack[i:]
                        break
                    if stack[i][0] not in INLINE:
                        break
            article = name in ("article", "main")
            names = " ".join(x[1] or x[2] or x[3] for x in ATTRS.findall(m.group(3)) if x[0].lower() != "hidden")
            unlike = bool(names) and name not in ("html", "body", "article", "main", *INLINE) and (wholly if name in PROSE else marked)(UNLIKE, names)
            outside = not any(x[2] for x in stack)  # an article may have a header of its own, with its heading
            heading = name == "header" or bool(names) and name not in ("html", "body", "article", "main", *INLINE) and marked(HEAD, names)
            apart = (1 if name == "form" and not unlike else 3) if name in APART else 2 if unlike or heading and outside else 0
            articles += article and outside
            stack.append((name, apart, article))
    if block is not None:
        yield block


def clean(parts: list[str]) -> str:
    """A block's text: character references decoded, runs of white space made one space, trimmed."""
    return SPACE.sub(" ", html.unescape("".join(parts))).strip()


def features(block: Block) -> tuple[str, int]:
    """What a block's words are weighed by, and how many there are."""
    n = len("".join(block.parts).split())
    kind = "apart" if block.apart else block.where
    return f"word:{kind}{':link' if block.linked * 2 > n else ''}", n


def placed(kind: str, block: Block) -> str:
    """A word feature with the block's place, for pages that have an article."""
    return f"{kind}@{'in' if block.inside else 'out'}"


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: Counter[tuple[str, bool]] = Counter()
    for batch in slices(batches):
        for page in batch.column(0).to_pylist():
            for b in blocks(page):
                kind, n = features(b)
                main = b.inside and not b.apart
                seen[kind, main] += n
                seen[placed(kind, b), main] += n
                for t in b.tags:
                    seen[f"tag:{t}", main] += 1
    if seen:
        yield pa.RecordBatch.from_arrays(
            [pa.array([k for k, _ in seen]), pa.array([i for _, i in seen]), pa.array(list(seen.values()), pa.int64())],
            names=["feature", "inside", "n"],
        )


def fit_weights(pages: DataFrame, sample_pages: int = 2_000, html_col: str = "html", id_col: str = "page_id") -> dict[str, float]:
    """Weights of words by their element and of tags, from pages that label their main text.

    A page with an article or main element is labelled. ``sample_pages`` bounds the sample: the labelled pages
    whose ids have the smallest hashes; all features of those go to the driver. A word's weight is the log of how much likelier its element
    is inside than outside, clipped to 4, at least 0.5 for what is likelier inside and at most -0.5 for what stands outside; a tag's is the
    negative log of its chance inside, between -2 and -0.05. Words are counted twice: by element alone, for pages without an article,
    and by element and place, for pages with one.
    """
    known = pages.where(F.lower(html_col).rlike("<(article|main)[ >]"))
    ids = known.select(id_col).distinct().orderBy(F.xxhash64(F.col(id_col)), F.col(id_col)).limit(sample_pages)
    rows = known.join(F.broadcast(ids), id_col, "left_semi").select(html_col)  # at most sample_pages ids
    counts = rows.mapInArrow(_count, "feature string, inside boolean, n long").groupBy("feature", "inside").agg(F.sum("n").alias("n"))
    got = counts.groupBy("feature").agg(
        F.sum(F.when(F.col("inside"), F.col("n")).otherwise(0)).alias("i"), F.sum(F.when(F.col("inside"), 0).otherwise(F.col("n"))).alias("o")
    ).collect()
    words = [r for r in got if r.feature.startswith("word:") and "@" not in r.feature]
    ni, no = sum(r.i for r in words) + 1, sum(r.o for r in words) + 1
    weights: dict[str, float] = {}
    for r in got:
        odds = math.log((r.i + 0.5) / ni) - math.log((r.o + 0.5) / no)
        if r.feature.startswith("word:"):
            share = (r.i + 0.5) / (r.i + r.o + 1)
            most = -0.5 if r.feature.endswith("@out") else 4.0
            weights[r.feature] = max(-4.0, min(most, odds)) if share < 0.5 else max(0.5, min(4.0, odds))
        else:
            weights[r.feature] = -min(2.0, max(0.05, -math.log((r.i + 0.5) / (r.i + r.o + 1))))
    return weights


def best_run(costs: list[float], gains: list[float]) -> tuple[float, tuple[int, int] | None]:
    """The contiguous run with the largest sum of its gains and of the costs between them, and its first and last place.

    ``costs[i]`` stands before ``gains[i]`` and counts in runs that begin earlier. One pass; of equal runs the one that ends first wins, and
    a run without a positive sum is none.
    """
    best, best_at = 0.0, None
    run, start = 0.0, 0
    for i, (cost, gain) in enumerate(zip(costs, gains, strict=True)):
        if run + cost <= 0:
            run, start, cost = 0.0, i, 0.0
        run += cost + gain
        if run > best:
            best, best_at = run, (start, i)
    return best, best_at


def _best(kept: list[Block], fitted: list[tuple[str, int]], weights: dict[str, float], labelled: bool) -> tuple[float, tuple[int, int] | None]:
    """The best run of blocks; ``labelled`` says whether their places have a weight."""
    costs, gains = [], []
    for i, (b, (kind, n)) in enumerate(zip(kept, fitted, strict=True)):
        same = b.inside and i > 0 and kept[i - 1].article == b.article  # nothing parts an article
        costs.append(0.0 if same else sum(weights.get(f"tag:{t}", -0.5) for t in b.tags))
        gains.append(weight(b, kind, weights, labelled) * n)
    return best_run(costs, gains)


def weight(block: Block, kind: str, weights: dict[str, float], labelled: bool) -> float:
    """What a word of a block scores; 0 for what is set apart inside an article, so that the rest of it stays whole."""
    if block.apart:
        return 0.0 if block.inside else min(-0.5, weights.get(kind, -2.0))
    if labelled:
        return weights.get(placed(kind, block), 1.0 if block.inside else -1.0)
    return weights.get(kind, -1.0 if kind.endswith(":link") else 1.0)


def _teasers(kept: list[Block], fitted: list[tuple[str, int]], weights: dict[str, float]) -> bool:
    """Whether by the weights of elements alone a run outside the articles scores more than the words of any one article do."""
    sizes: Counter[int] = Counter()
    for b, (kind, n) in zip(kept, fitted, strict=True):
        if b.inside and not b.apart:
            sizes[b.article] += abs(weight(b, kind, weights, False)) * n
    rest = [i for i, b in enumerate(kept) if not b.inside]
    return _best([kept[i] for i in rest], [fitted[i] for i in rest], weights, False)[0] > max(sizes.values())


def main_text(page: str | None, weights: dict[str, float]) -> str:
    """The blocks of the contiguous run of words and tags with the largest score.

    Words of elements that were never seen score 1, links and words outside an article -1, tags that were never seen -0.5; words that the
    markup sets apart (menus, forms, adverts, comments) score negative and are left out within the run too.
    Inside an article they and all tags score 0, so that the rest of the article stays whole.
    Where a page has articles, words are weighed by element and place, else by element alone; so they are too where a run outside
    the articles scores more than any one of them, which makes them teasers.
    Of equal runs the first wins; a page whose words all score below 0 has no text.
    """
    if not page:
        return ""
    kept = blocks(page)
    fitted = [features(b) for b in kept]
    labelled = any(b.inside and not b.apart for b in kept) and not _teasers(kept, fitted, weights)
    best_at = _best(kept, fitted, weights, labelled)[1]
    if best_at is None:
        return ""
    texts = (clean(b.parts) for b in kept[best_at[0] : best_at[1] + 1] if not b.apart)
    return "\n\n".join(t for t in texts if t)


def extract_main_text(pages: DataFrame, weights: dict[str, float], html_col: str = "html", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Main text of every page from its whole html: ``page_id, url, text, n_chars``, one row a page row.

    A null or empty page, and one without words that score, has an empty text. A page of any length is read whole, in
    one pass, and no more than 512 pages stand in a worker's memory at once. Each row is read alone, so repeated rows repeat their result; other columns are not read; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = [main_text(p, weights) for p in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    kinds = [pages.schema[c].dataType.simpleString() for c in (id_col, url_col)]
    slim = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return slim.mapInArrow(run, f"page_id {kinds[0]}, url {kinds[1]}, text string, n_chars long")
