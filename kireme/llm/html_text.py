"""Main text of HTML pages by equivalence-class template deduction.

The pages of one host come from few templates. A page is cut into tokens: its elements, told apart by their path of tags
and names, and its blocks of text, told apart by path and text. Tokens that occur equally often on the same pages of a
host have the same occurrence vector and form an equivalence class. The class of the most pages is the outer template;
another class is valid if its tokens keep their order on all its pages, and nests in the outer one if each of them lies
in the same gap between outer tokens everywhere. Fixed text of valid classes is template, and so are slots that hold
mostly such text. What is left in the other slots says where a host keeps its articles: from the top of the page down,
the element with most of the free text is followed. Tags and class names only weigh in that choice, and name parts that
no statistics can tell (forms, reader comments); pages of hosts too small for a template are judged by their own text.

Vectors are the exclusive-or of page hashes, so they are partial sums of one row per host and token. Copies of an article
vote once. A host with a third of all pages is no large group: only tokens of a minimum share of its pages are gathered,
and where templates are joined to pages, such a host is split.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kireme.llm.storage import decoded, stored

#: Pages (of different articles) that must share a token before it can be template, and the share of the host's pages.
#: With the share, a host has at most 50 times as many such tokens as one of its pages has on average.
SUPPORT = 5
SHARE = 0.02
#: Template tokens that are broadcast at most; more are joined to the pages by host.
BROADCAST_TOKENS = 200_000
#: A host with more than this part of all pages is split in a join.
HOT = 0.001
#: Texts from this length on tell copies of an article from other pages.
LONG_TEXT = 80

NODE = re.compile(r"<!--.*?(?:-->|$)|<(/?)([A-Za-z][^\s/>]*+)((?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+)>|<[!?][^>]*+>", re.S)
ATTRIBUTE = re.compile(r"(?<![^\s\"'/])([^\s=>\"'/]++)(?:\s*+=\s*+(\"[^\"]*+\"|'[^']*+'|[^\s\"'>]++))?")
# Fixed values of the HTML vocabulary.
RAW = frozenset("script style noscript template iframe object svg canvas audio video textarea title xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split())
CHROME = frozenset("head nav footer aside form menu dialog button select fieldset".split())
ENDS_PARAGRAPH = BLOCK - {"br"}
# Elements that hold other blocks rather than text, and headings that a container is not left behind for.
CONTAINERS = frozenset("html body div section main article center table tbody tr td".split())
HEADINGS = frozenset("h1 h2 h3 header".split())
TITLES = frozenset("h1 h2 h3 h4 h5 h6".split())
# Parts of classes, ids and roles that mark chrome, and parts that may stand beside them.
CHROME_NAMES = frozenset("ad ads advert advertisement adverts advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay nav navbar navigation navi menu breadcrumb breadcrumbs sidebar sidebars aside footer comment comments disqus respond replies reply share sharing social related recommended newsletter subscribe subscription signup login search pagination pager toolbar masthead complementary contentinfo dialog widget widgets toc".split())
BESIDE = frozenset("area bar bars block body bottom box boxes button buttons container content count field first form inner item items last left link links list lists main section site slot small reader readers right row side text top unit user users widget widgets wrap wrapper zone".split())


def attributes(raw: str) -> dict[str, str]:
    return {k.lower(): entities.unescape(v.strip("\"'")) for k, v in ATTRIBUTE.findall(raw)}


def names(attrs: dict[str, str]) -> list[list[str]]:
    """The words of each class, id and role."""
    return [w for n in " ".join(attrs.get(k, "") for k in ("class", "id", "role")).lower().split() if (w := re.findall("[a-z]+", n))]


def is_chrome(tag: str, attrs: dict[str, str], found: list[list[str]]) -> bool:
    """Whether an element is chrome by its tag, or by a class, id or role all of whose words are chrome names or stand beside one."""
    if tag in CHROME or "hidden" in attrs or attrs.get("aria-hidden") == "true":
        return True
    return tag not in ("html", "body", "main") and any(not CHROME_NAMES.isdisjoint(w) and all(x in CHROME_NAMES or x in BESIDE for x in w) for w in found)


def hashed(*parts: object) -> int:
    return xxhash.xxh64_intdigest("\0".join(map(str, parts)).encode("utf-8", "surrogatepass")) >> 1


@dataclass
class Page:
    """Elements (parent, tag, path token, article, chrome, place) in page order, and blocks (element, text, characters in links, place)."""

    parent: list[int] = field(default_factory=list)
    tag: list[str] = field(default_factory=list)
    token: list[int] = field(default_factory=list)
    article: list[bool] = field(default_factory=list)
    chrome: list[bool] = field(default_factory=list)
    place: list[int] = field(default_factory=list)
    blocks: list[tuple[int, str, int, int]] = field(default_factory=list)


def parse(page: str | None) -> Page:
    """The block elements of a page and its blocks of text; element 0 is the page itself.

    Comments, scripts and styles are no text. A start tag ends an open paragraph; an end tag closes everything opened
    inside its element, and is ignored if none is open. Character references are decoded once, and white space of a
    block becomes one space. The path of a container tells what comes first in it, so that containers without names
    differ.
    """
    out = Page([-1], [""], [0], [False], [False], [0])
    named, first = [""], [""]
    open_, tags = [0], Counter()
    buffer: list[str] = []
    in_link, linked, place = False, 0, 0

    def flush() -> None:
        nonlocal linked, place
        links, linked = linked, 0
        text = " ".join(entities.unescape("".join(buffer)).split())
        buffer.clear()
        if text:
            place += 1
            first[open_[-1]] = first[open_[-1]] or "#"
            out.blocks.append((open_[-1], text, min(links, len(text)), place))

    at, size = 0, len(page) if page else 0
    # no tag ends behind the last bracket, so none is looked for there
    last = page.rfind(">") + 1 if page else 0
    while at < size:
        m = NODE.search(page, at, last) if at < last else None
        if m is None:
            buffer.append(page[at:])
            linked += (size - at) * in_link
            break
        if m.start() > at:
            buffer.append(page[at : m.start()])
            linked += (m.start() - at) * in_link
        at = m.end()
        if m[2] is None:
            continue
        tag, closing = m[2].lower(), bool(m[1])
        if tag == "a":
            in_link = not closing
        if tag in BLOCK or tag in RAW:
            flush()
        if closing:
            if tags[tag]:
                k = next(i for i in range(len(open_) - 1, 0, -1) if out.tag[open_[i]] == tag)
                if tag not in BLOCK:
                    flush()
                tags.subtract([out.tag[i] for i in open_[k:]])
                del open_[k:]
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            at = end.end() if end else size
            continue
        if tag in ENDS_PARAGRAPH and tags["p"]:
            k = next((i for i in range(len(open_) - 1, max(0, len(open_) - 4), -1) if out.tag[open_[i]] == "p"), None)
            if k is not None:
                tags.subtract([out.tag[i] for i in open_[k:]])
                del open_[k:]
        if tag in VOID or m[3].endswith("/") and tag not in BLOCK:
            continue
        attrs = attributes(m[3]) if m[3] else {}
        found = names(attrs)
        chrome = is_chrome(tag, attrs, found)
        if tag not in BLOCK:
            if not chrome:
                continue
            flush()
        up = open_[-1]
        first[up] = first[up] or tag
        place += 1
        for column, value in ((out.parent, up), (out.tag, tag), (out.token, 0), (out.article, tag == "article" or attrs.get("itemprop") == "articleBody"), (out.chrome, chrome), (out.place, place), (named, ".".join([tag, *sorted({"-".join(w) for w in found})])), (first, "")):
            column.append(value)
        open_.append(len(out.tag) - 1)
        tags[tag] += 1
    flush()
    for i in range(1, len(out.tag)):
        out.token[i] = hashed(out.token[out.parent[i]], named[i], first[i] if out.tag[i] in ("div", "section", "td") else "")
    return out


@dataclass
class Template:
    """What a host's pages say: mean free characters below each element path, slots of template text, and fixed texts."""

    free: dict[int, float] = field(default_factory=dict)
    slots: frozenset[int] = frozenset()
    fixed: frozenset[int] = frozenset()


#: Weights of an article element and of chrome in the choice of a container, and the part of the text that leads into one.
ARTICLE, LESS, LEADS = 4.0, 0.05, 0.6


def main_text(page: str | None, template: Template | None = None) -> str:
    """The article of a page: blocks of its text container outside chrome.

    Template slots and fixed texts say nothing when the container is chosen. Inside it they stay if it is an article by
    its tag; in any other container only headings between free texts do. Null and empty pages give an empty text.
    """
    t, p = template or Template(), parse(page)
    n = len(p.tag)
    own, free = [0] * n, []
    for e, text, links, _ in p.blocks:
        free.append(p.token[e] not in t.slots and hashed(p.token[e], text) not in t.fixed)
        if free[-1]:
            own[e] += len(text) - links
    below = own.copy()
    for i in range(n - 1, 0, -1):
        below[p.parent[i]] += 0 if p.chrome[i] else below[i]
    children: list[list[int]] = [[] for _ in range(n)]
    for i in range(1, n):
        children[p.parent[i]].append(i)

    def score(group: list[int]) -> float:
        """Free characters on the host's pages, or on this one where the host says nothing."""
        e = group[0]
        return t.free.get(p.token[e], sum(below[i] for i in group)) * (LESS if p.chrome[e] else ARTICLE if p.article[e] or p.tag[e] == "main" else 1)

    here = [0]
    while not p.article[here[0]]:
        groups: dict[int, list[int]] = {}
        for i in here:
            for c in children[i]:
                groups.setdefault(p.token[c], []).append(c)
        scores = {k: score(g) for k, g in groups.items()}
        best = max(scores, key=scores.__getitem__, default=None)
        if best is None or scores[best] < LEADS * (sum(scores.values()) + sum(own[i] for i in here)) or not scores[best]:
            break
        e = groups[best][0]
        headed = any(p.tag[g[0]] in HEADINGS and not p.chrome[g[0]] and any(below[i] for i in g) for g in groups.values()) and p.tag[here[0]] not in ("", "html", "body")
        if p.tag[e] not in CONTAINERS or p.chrome[e] or headed or p.tag[here[0]] == "main" and not p.article[e]:
            break
        here = groups[best]
    page_wide = p.tag[here[0]] in ("", "html", "body")
    inside = [False] * n
    for i in here:
        inside[i] = True
    for i in range(1, n):
        inside[i] = inside[i] or inside[p.parent[i]] and not p.chrome[i] and not (page_wide and p.tag[i] == "header")
    rows = [(e, text, f) for (e, text, _, _), f in zip(p.blocks, free, strict=True) if inside[e]]
    if not all(p.article[i] for i in here):
        at = [k for k, row in enumerate(rows) if row[2]]
        rows = [(e, text, f) for e, text, f in rows[at[0] : at[-1] + 1] if f or not page_wide and p.tag[e] in TITLES] if at else []
    return " ".join(text for _, text, _ in rows)


def host_of(url: Column) -> Column:
    """The host of a URL in lower case; empty if it is null or has none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/@?#]*@)?([^/:?#]+)", 1))


TOKENS = "array<struct<token:bigint,slot:bigint,text:boolean,n:int,first:int,chars:int,links:int>>"


def page_tokens(pages: DataFrame) -> DataFrame:
    """host, page (a hash of its long texts, or of all if none is long), copy (of the whole page) and tokens of every page.

    A token has its slot (the path it lies in), whether it is a text, its times on the page, first place, and (elements)
    the characters directly in it and those of links among them.
    """

    def tokens(page: str | None) -> tuple[int, list[dict]]:
        p = parse(page)
        seen: dict[int, list] = {}
        for i in range(1, len(p.tag)):
            seen.setdefault(p.token[i], [p.token[p.parent[i]], False, 0, p.place[i], 0, 0])[2] += 1
        for e, text, links, place in p.blocks:
            slot = seen.setdefault(p.token[e], [0, False, 1, place, 0, 0])
            slot[4] += len(text)
            slot[5] += links
            seen.setdefault(hashed(p.token[e], text), [p.token[e], True, 0, place, len(text), links])[2] += 1
        texts = {text for _, text, _, _ in p.blocks}
        return hashed(*sorted([x for x in texts if len(x) >= LONG_TEXT] or texts)), [dict(zip(("token", "slot", "text", "n", "first", "chars", "links"), (k, *v), strict=True)) for k, v in seen.items()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("token", pa.int64()), ("slot", pa.int64()), ("text", pa.bool_()), ("n", pa.int32()), ("first", pa.int32()), ("chars", pa.int32()), ("links", pa.int32())]))
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                found = [tokens(x) for x in decoded(part.column(2))]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([f[0] for f in found], pa.int64()), part.column(1), pa.array([f[1] for f in found], kind)], ["host", "page", "copy", "tokens"])

    return pages.select(host_of(F.col("url")).alias("host"), F.xxhash64("html").alias("copy"), "html").mapInArrow(run, f"host string, page long, copy long, tokens {TOKENS}")


def frequent_tokens(distinct: DataFrame) -> DataFrame:
    """Tokens of enough pages: host, pages (of the host), token, slot, text, n_pages, vector (its class), chars, free (characters
    outside links and repeated texts) and repeated (the part of a slot's texts that repeat)."""
    sizes = distinct.groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    t = distinct.select("host", "page", F.explode("tokens").alias("t")).select("host", "page", "t.*")
    vectors = t.groupBy("host", "token").agg(
        F.count(F.lit(1)).alias("n_pages"), F.bit_xor(F.xxhash64("page", "n")).alias("vector"), F.min("slot").alias("slot"), F.max("text").alias("text"), F.sum("n").alias("n"), F.sum("chars").alias("chars"), F.sum("links").alias("links")
    )
    often = (F.col("n_pages") >= SUPPORT) & (F.col("n_pages") >= F.col("pages") * SHARE)
    known = vectors.join(sizes, "host").withColumn("key", F.when(F.col("text"), F.col("slot")).otherwise(F.col("token")))
    # one row per slot; the list is bounded by SHARE
    row = F.struct("token", "slot", "text", "n_pages", "vector", "chars", "links")
    repeats = F.col("text") & (F.col("n_pages") >= SUPPORT)
    slots = known.groupBy("host", "pages", "key").agg(
        F.collect_list(F.when(often, row)).alias("rows"), F.sum(F.when(F.col("text"), F.col("n"))).alias("n"), F.sum(F.when(repeats, F.col("n"))).alias("again"), F.sum(F.when(repeats, F.col("chars") - F.col("links"))).alias("fixed_chars")
    )
    part = F.coalesce(F.col("again") / F.col("n"), F.lit(0.0))
    return slots.select("host", "pages", F.inline("rows"), part.alias("repeated"), "fixed_chars").withColumn("free", F.greatest(F.col("chars") - F.col("links") - F.coalesce("fixed_chars", F.lit(0)), F.lit(0))).drop("fixed_chars", "links")


def by_host(rows: DataFrame, table: DataFrame, columns: str, kind: str, use: Callable, fields: str, small: bool) -> DataFrame:
    """``use(batches, of)`` over ``rows`` (whose first column is host), where ``of(host, ...)`` finds the ``kind`` of a host.

    ``table`` has a row (host, ``columns``) for each host that has a template. If it is small it is broadcast; else it is
    joined by host. There a host with more than HOT of all rows is split: at most 1 / HOT such hosts are listed.
    """
    wanted = columns.split()
    if small:
        shared = rows.sparkSession.sparkContext.broadcast({r[0]: made(kind, r[1:]) for r in table.select("host", *wanted).collect()})
        return rows.mapInArrow(lambda batches: use(batches, lambda batch: [shared.value.get(h) for h in batch.column(0).to_pylist()]), fields)
    sizes = stored(rows.groupBy("host").agg(F.count(F.lit(1)).alias("_n")), "hosts")
    total = sizes.agg(F.sum("_n")).first()[0] or 1
    parts = F.broadcast(sizes.filter(F.col("_n") > total * HOT).select("host", F.ceil(F.col("_n") / (total * HOT)).cast("int").alias("_parts")))
    left = rows.join(parts, "host", "left").withColumn("_part", F.floor(F.rand(7) * F.coalesce("_parts", F.lit(1))).cast("int"))
    right = table.select("host", *wanted).join(parts, "host", "left").withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1)))
    joined = left.drop("_parts").join(right.drop("_parts"), ["host", "_part"], "left").drop("_part")
    n = len(rows.columns)

    def of(batch: pa.RecordBatch) -> list:
        out, last, found = [], None, None
        for i, h in enumerate(batch.column(0).to_pylist()):
            if h != last:
                last, found = h, None if batch.column(n)[i].as_py() is None else made(kind, [batch.column(n + k)[i].as_py() for k in range(len(wanted))])
            out.append(found)
        return out

    return joined.mapInArrow(lambda batches: use(batches, of), fields)


def made(kind: str, columns: list) -> Template | dict:
    """A host's template, or the classes of its tokens: token to (class, whether it is the outer one)."""
    if kind == "template":
        return Template({x["token"]: x["mean"] for x in columns[0]}, frozenset(columns[1]), frozenset(columns[2]))
    return {x["token"]: (x["vector"], x["outer"]) for x in columns[0]}


def valid_classes(distinct: DataFrame, frequent: DataFrame, small: bool) -> DataFrame:
    """host and vector of the classes whose tokens keep their order and their gaps of the outer class on all pages."""
    top = frequent.groupBy("host", "vector").agg(F.max("n_pages").alias("n_pages"), F.count(F.lit(1)).alias("size")).groupBy("host").agg(F.max(F.struct("n_pages", "size", "vector")).alias("top"))
    marked = frequent.join(top, "host").select("host", F.struct("token", "vector", (F.col("vector") == F.col("top.vector")).alias("outer")).alias("t"))
    # bounded by SHARE
    classes = marked.groupBy("host").agg(F.collect_list("t").alias("classes"))

    def use(batches: Iterator[pa.RecordBatch], of: Callable) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[tuple, None] = {}
            for host, tokens, classes in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), of(batch), strict=True):
                if not classes:
                    continue
                gap, seen = 0, {}
                for token, _ in sorted(((x["token"], x["first"]) for x in tokens if x["token"] in classes), key=lambda x: x[1]):
                    vector, outer = classes[token]
                    if outer:
                        gap = token
                    seen.setdefault(vector, []).extend((token, 0 if outer else gap))
                found.update(dict.fromkeys((host, v, hashed(*s)) for v, s in seen.items()))
            rows = list(found)
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.string(), pa.int64(), pa.int64()))], ["host", "vector", "order"])

    orders = by_host(distinct.select("host", "tokens"), classes, "classes", "classes", use, "host string, vector long, order long", small)
    return orders.groupBy("host", "vector").agg(F.min("order").alias("low"), F.max("order").alias("high")).filter("low = high").select("host", "vector")


def templates(pages: DataFrame, broadcast_tokens: int = BROADCAST_TOKENS) -> tuple[DataFrame, bool]:
    """host, free (mean free characters below each element path), slots and fixed of every host with a template, and whether they are small.

    Pages without a host are one host. Hosts of fewer than SUPPORT different articles have no template.
    """
    distinct = stored(page_tokens(pages).groupBy("host", "page").agg(F.min_by("tokens", "copy").alias("tokens")), "page-tokens")
    frequent = stored(frequent_tokens(distinct), "frequent-tokens")
    small = frequent.limit(broadcast_tokens + 1).count() <= broadcast_tokens
    valid = valid_classes(distinct, frequent, small).withColumn("valid", F.lit(True))
    checked = frequent.join(valid, ["host", "vector"], "left").select("host", F.struct("token", "slot", "text", "n_pages", "chars", "free", "repeated", F.coalesce("valid", F.lit(False)).alias("valid")).alias("t"))

    def use(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [deduced(t) for t in batch.column(1).to_pylist()]
            mean = pa.list_(pa.struct([("token", pa.int64()), ("mean", pa.float64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[i] for r in rows], kind) for i, kind in enumerate((mean, pa.list_(pa.int64()), pa.list_(pa.int64()))))], ["host", "free", "slots", "fixed"])

    # bounded by SHARE
    gathered = checked.groupBy("host").agg(F.array_sort(F.collect_list("t")).alias("t"))
    return stored(gathered.mapInArrow(use, "host string, free array<struct<token:bigint,mean:double>>, slots array<bigint>, fixed array<bigint>"), "templates"), small


def deduced(tokens: list[dict]) -> tuple[list[dict], list[int], list[int]]:
    """Free characters, slots and fixed texts of one host from its frequent tokens.

    A slot is template if half of its texts repeat, unless it alone has most of the host's text. In other slots a
    text is fixed only if it is on half of the pages that have the slot: a sentence that happens to repeat is content.
    """
    paths = {x["token"]: x for x in tokens if not x["text"]}
    total = sum(x["chars"] for x in paths.values())
    slots = {k for k, x in paths.items() if x["chars"] and x["repeated"] >= 0.5 and x["chars"] * 2 <= total}
    fixed = [x["token"] for x in tokens if x["text"] and x["valid"] and (x["slot"] in slots or x["slot"] in paths and 2 * x["n_pages"] >= paths[x["slot"]]["n_pages"])]
    below = {k: 0.0 if k in slots else x["free"] / x["n_pages"] for k, x in paths.items()}
    depth: dict[int, int] = {}
    for k in paths:
        chain = []
        while k in paths and k not in depth:
            chain.append(k)
            k = paths[k]["slot"]
        for c in reversed(chain):
            depth[c] = depth.get(paths[c]["slot"], 0) + 1
    for k in sorted(paths, key=depth.__getitem__, reverse=True):
        up = paths[k]["slot"]
        if up in below:
            below[up] += below[k] * paths[k]["n_pages"] / paths[up]["n_pages"]
    return [{"token": k, "mean": v} for k, v in below.items()], sorted(slots), sorted(fixed)


def extract_main_text(pages: DataFrame, broadcast_tokens: int = BROADCAST_TOKENS) -> DataFrame:
    """page_id, url, text and n_chars of every page; null and empty pages have an empty text.

    Up to ``broadcast_tokens`` template tokens are broadcast, more are joined by host; the results are the same. Repeated
    rows are each returned. Bad bytes of invalid UTF-8 become replacement characters.
    """
    found, small = templates(pages, broadcast_tokens)

    def use(batches: Iterator[pa.RecordBatch], of: Callable) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page, template) for page, template in zip(decoded(batch.column(3)), of(batch), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    slim = pages.select(host_of(F.col("url")).alias("host"), "page_id", "url", "html")
    out = by_host(slim, found, "free slots fixed", "template", use, "page_id long, url string, text string", small)
    return out.withColumn("n_chars", F.char_length("text").cast("long"))
