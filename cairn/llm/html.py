"""Main text of web pages by equivalence-class template deduction.

Tokens of a page are its elements, told apart by their path of tags and classes
and their place among like siblings (``slot``), and its texts, told apart by
their words and the path below their parent's slot. For each host, tokens that
occur equally often on every page share their occurrence vector; vectors are
compared by two sums of page hashes weighted by the counts, so they are added up
map-side and never gathered. Classes that are on at least half of a host's pages
are read again: tokens that keep their rank within the class on every page stay,
and of two classes whose tokens interleave on a page the rarer one goes. What
stays nests and is the template. Slots whose text is the same wherever they
occur, and texts that are on every page with their path, are template as well.
What varies is data: the template names the path below which most of it stands.

A page's main text is without the template's constant slots and texts, articles
included. It is what stands in the article, or else the main element, the
content element, unless the host's data path lies elsewhere; or else below the
data path, or all of it. Which of the varying elements are menus, notices,
adverts, forms, comments and the like the template cannot tell; these go by tag,
role or class: outside articles by any word of class or id, but for the ids of headings, inside them by a
whole class name. An article with nothing but template (a host's copies of one
page) is kept.

Cases: null html is empty text; pages without url are one host; hosts with one
page have no constant slots; repeated pages count again; broken or cut markup is
read as far as it goes; an empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import html as markup
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.llm._spark import prepare, settle

#: Fewest pages from which a slot can be called constant, and share of pages that a template class is on.
MIN_PAGES, SUPPORT = 3, 0.5
#: The data path has this share of a host's varying text at least.
MAIN_SHARE = 0.6
#: Bytes of all templates up to which they are broadcast; beyond, pages are joined by host.
BROADCAST_BYTES = 8 << 20
#: What the tokens of the template begin with; paths without places have neither.
SLOT, TEXT = "=", "~"
#: Aggregated rows that a task holds before it passes them on.
HELD_ROWS = 50_000

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea select svg canvas title xmp noembed object video audio".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
BOILER_TAGS = frozenset("head nav footer aside form button dialog menu".split())
BOILER_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
#: Words of class and id that mark an element as no part of the text.
BOILER_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr hidden login menu modal nav navbar navigation newsletter notice notices pager pagination popup promo promoted promotion recommended related replies reply search share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar widget".split()
)
CONTENT_WORDS = frozenset("article content entry post story articlebody".split())

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
_ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORD = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
#: Elements that a start tag of the first kind ends if they are open (the innermost p, li and so on).
_ENDS = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_CLOSES_P = BLOCK - {"caption", "tbody", "td", "tfoot", "th", "thead", "tr", "li", "dd", "dt", "body", "html", "head", "legend", "summary", "figcaption"}


def _attributes(text: str) -> dict[str, str]:
    return {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTR.finditer(text)} if text else {}


def _words(value: str) -> set[str]:
    return set(_WORD.findall(_CAMEL.sub(" ", value).lower()))


class Block:
    __slots__ = ("level", "path", "slot", "text", "token")

    def __init__(self, path: str, slot: str, like: str, level: int, text: str):
        self.path, self.slot, self.level, self.text = path, slot, level, text
        self.token = f"{like}\n{xxhash.xxh64_hexdigest(text)}"


def blocks(page: str) -> tuple[list[Block], dict[str, int], list[str]]:
    """The text blocks of a page outside of boilerplate, in order, how often each path occurs, and all slots and texts in order.

    A slot is a path with the place of every element among siblings of its tag and classes, if not the first.

    level: 3 inside an article, 2 inside a main element, 1 inside a content element, 0 elsewhere.
    """
    found: list[Block] = []
    counts: dict[str, int] = {"": 1}
    seen: dict[str, int] = {}
    order: list[str] = [SLOT]
    stack: list[tuple[str, str, bool, int, str, str]] = [("", "", False, 0, "", "")]  # tag, path, boilerplate, level, slot, slot of the first like sibling
    pieces: list[str] = []

    def flush() -> None:
        text = " ".join(markup.unescape("".join(pieces)).split())
        pieces.clear()
        if text:
            _, path, _, level, slot, like = stack[-1]
            found.append(Block(path, slot, like, level, text))
            order.append(TEXT + found[-1].token)

    def pop(to: int) -> None:
        if any(tag in BLOCK for tag, *_ in stack[to:]):
            flush()
        del stack[to:]

    at, size = 0, len(page)
    while at < size:
        m = _TAG.search(page, at)
        if not m:
            break
        if m.start() > at and not stack[-1][2]:
            pieces.append(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            depth = next((i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == tag), 0)
            if depth:
                pop(depth)
            elif tag in BLOCK:
                flush()
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            elif tag == "br":
                pieces.append(" ")
            continue
        ends = _ENDS.get(tag, ())
        for i in range(len(stack) - 1, 0, -1):
            if stack[i][0] in ends or (stack[i][0] == "p" and tag in _CLOSES_P):
                pop(i)
            elif stack[i][0] in BLOCK and stack[i][0] not in ends:
                break
        if tag in BLOCK:
            flush()
        attributes = _attributes(m[3])
        names = attributes.get("class", "") + " " + attributes.get("id", "")
        words = _words(names) if names != " " else set()
        _, path, boiler, level, slot, _ = stack[-1]
        name = tag + (f".{'.'.join(sorted(words))}" if words else "")
        path, like = f"{path}/{name}", f"{slot}/{name}"
        counts[path] = counts.get(path, 0) + 1
        seen[like] = seen.get(like, 0) + 1
        slot = like if seen[like] == 1 else f"{like}[{seen[like]}]"
        order.append(SLOT + slot)
        role = attributes.get("role", "").lower()
        boiler = boiler or tag in BOILER_TAGS or tag in RAW or role in BOILER_ROLES or "hidden" in attributes or attributes.get("aria-hidden") == "true"
        named = words
        if level == 3:  # what an article calls its parts says little: whole class names alone count there
            named = set(attributes.get("class", "").lower().split())
        elif tag in HEADINGS:
            named = _words(attributes.get("class", "")) if attributes.get("class") else set()
        boiler = boiler or bool(named & BOILER_WORDS) and tag not in ("html", "body", "article", "main") or tag == "article" and bool(words & {"comment", "comments", "reply", "replies"})
        boiler = boiler or (tag == "header" or "header" in words and tag != "h1") and level < 3
        if tag == "article":
            level = 3
        elif tag == "main" or role == "main":
            level = max(level, 2)
        elif words & CONTENT_WORDS or attributes.get("itemprop", "").lower() == "articlebody":
            level = max(level, 1)
        if m[3].endswith("/") and tag not in BLOCK:
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            at = end.end() if end else size
            continue
        stack.append((tag, path, boiler, level, slot, like))
    if at < size and not stack[-1][2]:
        pieces.append(page[at:])
    flush()
    return found, counts, order


def host(url: str = "url"):
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1), F.lit("")))


_STATS = "host string, path string, pages long, total long, first_sum long, second_sum long, chars long, low long, high long"


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each host and path, slot or text: pages, occurrences, the vector's two sums, characters, least and greatest hash of its texts."""
    held: dict[tuple[str, str], list[int]] = {}
    names = [x.split()[0] for x in _STATS.split(", ")]

    def out() -> pa.RecordBatch:
        rows = [[*k, *v] for k, v in held.items()]
        held.clear()
        kinds = [pa.string(), pa.string(), *[pa.int64()] * 7]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    for batch in batches:
        for where, page_id, page in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            parts, counts, order = blocks(page or "")
            counts |= Counter(order)
            seed = xxhash.xxh64_intdigest(str(page_id))
            texts: dict[str, list[int]] = {}
            for b in parts:
                h = xxhash.xxh64_intdigest(b.text) >> 1
                for key in (b.path, SLOT + b.slot):
                    t = texts.setdefault(key, [0, h, h])
                    t[0] += len(b.text)
                    t[1], t[2] = min(t[1], h), max(t[2], h)
            for path, n in counts.items():
                chars, low, high = texts.get(path, (0, (1 << 63) - 1, 0))
                own = xxhash.xxh64_intdigest(n.to_bytes(8, "little"), seed=seed)
                v = held.setdefault((where, path), [0, 0, 0, 0, 0, (1 << 63) - 1, 0])
                v[0] += 1
                v[1] += n
                v[2] += own >> 33
                v[3] += own & 0x7FFFFFFF
                v[4] += chars
                v[5], v[6] = min(v[5], low), max(v[6], high)
        if len(held) >= HELD_ROWS:
            yield out()
    if held:
        yield out()


def _ranks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each host and token of its classes: the least and greatest rank within the class, and on how many pages the class interleaves with one on more pages."""
    held: dict[tuple[str, str], list[int]] = {}

    def out() -> pa.RecordBatch:
        rows = [[*k, *v] for k, v in held.items()]
        held.clear()
        kinds = [pa.string(), pa.string(), *[pa.int64()] * 3]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["host", "path", "low", "high", "crossed"])

    known: dict[str, tuple] = {}
    for batch in batches:
        for where, page, classes in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if where not in known:
                if len(known) > 256:
                    known.clear()
                known[where] = {t: i for i, c in enumerate(classes) for t in c["paths"]}, [c["pages"] for c in classes], [len(c["paths"]) for c in classes]
            of, pages, sizes = known[where]
            rank, stacks, on, crossed = [0] * len(pages), {SLOT: [], TEXT: []}, set(), set()  # slots and texts nest each among themselves
            places: list[tuple[str, int, int]] = []
            for token in dict.fromkeys(blocks(page or "")[2]):
                i = of.get(token)
                if i is None:
                    continue
                places.append((token, i, rank[i]))
                rank[i] += 1
                stack = stacks[token[0]]
                if i in on:
                    while stack[-1] != i:
                        last = stack.pop()
                        on.discard(last)
                        if rank[last] < sizes[last]:
                            crossed.add(min(i, last, key=lambda c: (pages[c], -c)))
                else:
                    stack.append(i)
                    on.add(i)
            for token, i, r in places:
                v = held.setdefault((where, token), [r, r, 0])
                v[0], v[1], v[2] = min(v[0], r), max(v[1], r), v[2] + (i in crossed)
        if len(held) >= HELD_ROWS:
            yield out()
    if held:
        yield out()


def templates(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """host, constant (slots whose text never varies), texts (texts that are wherever their path is), main (the data path)."""
    read = pages.select(host(url_col).alias("host"), F.col(id_col).cast("string"), html_col)
    sums = read.mapInArrow(_occurrences, _STATS).groupBy("host", "path")
    tokens = sums.agg(*(F.sum(c).alias(c) for c in ("pages", "total", "first_sum", "second_sum", "chars")), F.min("low").alias("low"), F.max("high").alias("high"))
    whole = F.max("pages").over(Window.partitionBy("host"))  # the empty path is on every page once
    tokens = tokens.withColumn("kind", F.when(F.startswith("path", F.lit(SLOT)), SLOT).when(F.startswith("path", F.lit(TEXT)), TEXT).otherwise(""))
    tokens = tokens.withColumn("host_pages", whole).filter((F.col("pages") >= SUPPORT * F.col("host_pages")) & ((F.col("kind") == "") | (F.col("pages") >= MIN_PAGES)))
    fixed = (F.col("chars") > 0) & (F.col("low") == F.col("high")) & (F.col("pages") >= MIN_PAGES)
    tokens = settle(tokens.withColumn("fixed", fixed))

    classes = tokens.filter("kind <> ''").groupBy("host", "kind", "pages", "total", "first_sum", "second_sum").agg(F.collect_list("path").alias("paths"))
    per_host = settle(classes.groupBy("host").agg(F.collect_list(F.struct("pages", "paths")).alias("classes")))
    ranks = _with(read.select("host", html_col), per_host, "inner").select("host", html_col, "classes").mapInArrow(_ranks, "host string, path string, low long, high long, crossed long")
    valid = ranks.groupBy("host", "path").agg(F.min("low").alias("l"), F.max("high").alias("h"), F.sum("crossed").alias("x")).filter("l = h and x = 0").select("host", "path")
    held = tokens.join(valid, ["host", "path"], "left_semi")
    slots = held.filter((F.col("kind") == SLOT) & F.col("fixed")).select("host", F.struct(F.lit(0).alias("k"), F.substring("path", 2, 1 << 30).alias("p")).alias("t"))
    near = tokens.filter(F.col("kind") == SLOT).select("host", F.substring("path", 2, 1 << 30).alias("like"), F.col("pages").alias("like_pages"))
    texts = held.filter(F.col("kind") == TEXT).withColumn("like", F.regexp_replace(F.substring("path", 2, 1 << 30), r"\n.*", "")).join(near, ["host", "like"])
    texts = texts.filter("pages = like_pages").select("host", F.struct(F.lit(1).alias("k"), F.substring("path", 2, 1 << 30).alias("p")).alias("t"))
    lists = slots.union(texts).groupBy("host").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    only = lambda k: F.transform(F.filter(F.coalesce("ts", F.array()), lambda t: t["k"] == k), lambda t: t["p"])

    plain = tokens.filter("kind = ''").groupBy("host").agg(F.collect_list(F.struct("path", "fixed", "chars")).alias("every"))
    every = F.col("every")
    varying = F.filter(every, lambda t: (t["chars"] > 0) & ~t["fixed"])
    volume = lambda ts: F.aggregate(ts, F.lit(0).cast("long"), lambda a, t: a + t["chars"])
    below = lambda p: F.filter(varying, lambda t: (t["path"] == p) | F.startswith(t["path"], F.concat(p, F.lit("/"))))
    large = F.filter(F.transform(every, lambda t: t["path"]), lambda p: volume(below(p)) > MAIN_SHARE * volume(varying))
    deepest = F.array_max(F.transform(large, lambda p: F.struct(F.char_length(p).alias("n"), p.alias("p"))))["p"]
    return plain.select("host", deepest.alias("main")).join(lists, "host", "left").select("host", only(0).alias("constant"), only(1).alias("texts"), "main")


def _with(read: DataFrame, known: DataFrame, how: str) -> DataFrame:
    """Pages with what is known of their hosts."""
    size = known.agg(F.sum(F.octet_length(F.to_json(F.struct("*"))))).head()[0] or 0
    return read.join(F.broadcast(known) if size <= BROADCAST_BYTES else known, "host", how)


def main_text(page: str, constant: frozenset[str] | set[str] = frozenset(), main: str | None = None, texts: frozenset[str] | set[str] = frozenset()) -> str:
    """The main text of one page, given its host's template."""
    every, _, _ = blocks(page)
    parts = [b for b in every if b.slot not in constant and b.token not in texts]
    inner = [b for b in parts if main and (b.path == main or b.path.startswith(main + "/"))]
    top = max((b.level for b in every), default=0)
    if top == 0:
        parts = inner or parts
    elif not inner or any(b.level == top for b in inner):
        marked = [b for b in parts if b.level == top]
        parts = marked if marked or top < 3 else [b for b in every if b.level == top]
    else:
        parts = inner
    return "\n".join(b.text for b in parts)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id, url, text and n_chars of every page."""
    prepare(pages.sparkSession)
    known = settle(templates(pages, id_col, url_col, html_col))
    joined = _with(pages.select(id_col, url_col, html_col, host(url_col).alias("host")), known, "left")
    schema = T.StructType([pages.schema[id_col], pages.schema[url_col], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, urls, *given = batch.columns
            texts = [main_text(p or "", set(c or ()), m, set(t or ())) for p, c, t, m in zip(*(g.to_pylist() for g in given), strict=True)]
            yield pa.RecordBatch.from_arrays([ids, urls, pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], schema.names)

    return joined.select(id_col, url_col, html_col, "constant", "texts", "main").mapInArrow(run, schema)
