"""Main text of web pages by wrappers inferred per host.

A page is a stream of block tags and text slots. Streams of one host are aligned again and again: what
differs becomes optional, what recurs becomes a repeated group, and the result is a union-free regular
expression, the host's wrapper. Every page is then read by that wrapper: its blocks, and the elements around them, are places
of the wrapper, and places are judged by what all pages have in them. A place that holds the same text on page after page is template,
one whose text varies is content; the main region is the part of the wrapper that holds most of the varying plain text, widened as long
as that brings in more content than anything else. What elements are called only settles what the pages leave open.
"""

from __future__ import annotations

import html as entities
import json
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from difflib import SequenceMatcher
from functools import lru_cache

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sceneloom.llm.url_filter import host_of
from sceneloom.shared import stored, with_lookup

#: Fixed values of HTML: elements without content, within a line, with raw content, and never shown.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr img".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
HIDDEN = frozenset("script style textarea title xmp iframe noembed noframes head noscript template svg math object canvas audio video form button select option datalist nav footer aside dialog menu".split())
CLOSED_BY_BLOCK = frozenset(["p"])
SIBLINGS = {"li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr", "td": "td th", "th": "td th", "option": "option"}
SCOPES = frozenset("ul ol dl table article section div main body".split())
#: Nouns in class or id names that mark what is not the main text, those that may also name a part of an article, and words after them that say nothing.
BOILERPLATE = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent notification alert popup modal overlay newsletter subscribe "
    "subscription sidebar menu nav navbar navigation breadcrumb breadcrumbs masthead footer comment comments disqus toolbar copyright widget login signup".split()
)
DOUBTFUL = frozenset("notice notices side reply replies discussion share sharing social related recommended search".split())
NEUTRAL = frozenset("area block box button buttons container group holder inner item items link links list outer panel section wrap wrapper".split())
#: Elements that can be a region of a page; the others are parts of its text.
CONTAINERS = frozenset("article main section div td body html".split())
TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)(/?)>", re.S)
NAMES = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


@dataclass(frozen=True)
class Block:
    """Text of one block: ``path`` names the open elements, ``opens`` their tokens in the stream, ``hidden`` says that an element around it
    is never main text, ``named`` that one is called so."""

    path: tuple[str, ...]
    opens: tuple[int, ...]
    text: str
    linked: int
    hidden: bool
    named: bool


@dataclass(frozen=True)
class Judging:
    """A text is template if at least ``pages`` different pages and the part ``slot`` of the pages that fill its place have it there, and
    the place is filled on the part ``host`` of all pages. Where template would be more than the part ``most`` of all characters, the pages
    are versions of one text and none is template. The main region holds more than the part ``region`` of the varying plain text; it is
    widened where content is ``widen`` times what else comes in. Names count unless less than the part ``unnamed`` of the varying text is
    outside what they mark."""

    pages: int = 5
    host: float = 0.5
    slot: float = 0.9
    most: float = 0.8
    region: float = 0.5
    widen: float = 2.0
    unnamed: float = 0.1


#: Different pages, and characters of html, of which one wrapper is inferred; a host with more has several, pages without a host small ones.
PAGES_PER_WRAPPER = 1_000
CHARS_PER_WRAPPER = 32_000_000
PAGES_WITHOUT_HOST = 20
#: Elements of a path that are told apart; what is nested deeper counts to the last of them.
DEEPEST = 64


def _marks(name: str) -> int:
    """2 if the noun that a name ends in marks boilerplate (``cookie-banner`` and ``comment-list``, but not ``ad-free``), 1 if it may, else 0."""
    words = [w.lower() for w in WORDS.findall(name)]
    while len(words) > 1 and words[-1] in NEUTRAL:
        words.pop()
    return 0 if not words else 2 if words[-1] in BOILERPLATE or len(words) > 1 and words[-2] in BOILERPLATE and words[-1] in DOUBTFUL else 1 if words[-1] in DOUBTFUL else 0


def _key(tag: str, attributes: str) -> tuple[str, bool, int]:
    """Name of an element in paths (tag and class words), whether it holds no main text, and whether (2) or perhaps (1) it is called so."""
    if "=" not in attributes:
        return tag, tag in HIDDEN, 0
    found = [(kind.lower(), name) for kind, *names in NAMES.findall(attributes) for name in "".join(names).split()]
    words = sorted({w.lower() for kind, name in found if kind == "class" and not any(c.isdigit() for c in name) for w in WORDS.findall(name)})
    return ".".join([tag, *words]), tag in HIDDEN, max((_marks(name) for _, name in found), default=0)


def read_page(page: str) -> tuple[list[Block], list[str]]:
    """Blocks of a page in order, and its stream: ``+element``, ``-element``, ``#`` for text.

    Wrong nesting is mended as browsers do: paragraphs end at the next block, list items at the next item,
    an end tag closes what is open inside its element. Inline elements are no tokens unless their names mark
    boilerplate. A doubtful name counts, but for a section of an article only where a block is mostly links.
    """
    blocks: list[Block] = []
    stream: list[str] = []
    stack: list[tuple[str, str, bool, int, int]] = []
    parts: list[str] = []
    linked = links = 0

    def flush() -> None:
        nonlocal linked, links
        if parts:
            text = " ".join(entities.unescape("".join(parts)).split())
            if text:
                hidden, named = any(x[2] for x in stack), any(x[3] == 2 for x in stack)
                named = named or 2 * linked > len(text) and any(x[3] for x in stack)
                top = stack[:DEEPEST]
                blocks.append(Block(tuple(x[1] for x in top), tuple(x[4] for x in top), text, linked, hidden, named))
                stream.append("#")
            parts.clear()
        linked = links = 0

    def close(upto: int) -> None:
        flush()
        while len(stack) > upto:
            stream.append("-" + stack.pop()[1])

    at, size = 0, len(page)
    while at < size:
        m = TOKEN.search(page, at)
        if m is None:
            parts.append(page[at:])
            break
        if m.start() > at:
            parts.append(page[at : m.start()])
            linked += (m.start() - at) if links else 0
        at = m.end()
        if m[2] is None:
            continue
        tag, ending = m[2].lower(), bool(m[1])
        if ending:
            if tag == "a":
                links = max(0, links - 1)
            for depth in range(len(stack) - 1, -1, -1):
                if stack[depth][0] == tag:
                    close(depth)
                    break
                if stack[depth][0] in SCOPES and tag in ("p", "li", "span"):
                    break
            continue
        if tag in RAW and not m[4]:
            end = re.compile(rf"</{tag}\b[^>]*>", re.I).search(page, at)
            at = end.end() if end else size
            if tag not in INLINE:
                flush()
            continue
        key, hidden, named = _key(tag, m[3])
        if named == 1 and not (tag == "section" and any(x[0] in ("article", "main") for x in stack)):
            named = 2
        if tag in INLINE and not ((hidden or named) and tag not in VOID):
            links += tag == "a"
            if tag == "br":
                parts.append(" ")
            continue
        if tag in VOID:
            flush()
            continue
        flush()
        closers = SIBLINGS.get(tag, "").split()
        for depth in range(len(stack) - 1, -1, -1):
            open_tag = stack[depth][0]
            if open_tag in closers or open_tag in CLOSED_BY_BLOCK and tag not in INLINE:
                close(depth)
                if open_tag not in CLOSED_BY_BLOCK:
                    break
            elif open_tag in SCOPES:
                break
        if m[4]:
            continue
        stack.append((tag, key, hidden, named, len(stream)))
        stream.append("+" + key)
    close(0)
    return blocks, stream


def fold(tokens: list, longest: int = 12) -> list:
    """Collapse runs of equal sequences into one repeated group, a tuple ``("+", sequence)``; shortest periods first."""
    return folded(tokens, longest)[0]


def folded(tokens: list, longest: int = 12) -> tuple[list, list[int]]:
    """``fold``, and how many of the tokens each of its tokens stands for."""
    out, sizes = list(tokens), [1] * len(tokens)
    for period in range(1, longest + 1):
        new, spans, i = [], [], 0
        while i < len(out):
            seq = out[i : i + period]
            n = 1
            while len(seq) == period and out[i + n * period : i + (n + 1) * period] == seq:
                n += 1
            if n > 1:
                new.append(seq[0] if period == 1 and isinstance(seq[0], tuple) else ("+", *seq))
                spans.append(sum(sizes[i : i + n * period]))
                i += n * period
            elif period > 1 and new and isinstance(new[-1], tuple) and list(new[-1][1:]) == seq and new[-1][0] == "+":
                spans[-1] += sum(sizes[i : i + period])
                i += period
            else:
                new.append(out[i])
                spans.append(sizes[i])
                i += 1
        out, sizes = new, spans
    return out, sizes


def owners(sizes: list[int]) -> list[int]:
    """For each token of a page the number of the folded token it stands in."""
    return [at for at, n in enumerate(sizes) for _ in range(n)]


def _number(text: str) -> int:
    """Signed 64-bit hash of a text."""
    n = xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"))
    return n - (1 << 64) if n >= 1 << 63 else n


def align(wrapper: list, stream: list) -> list:
    """The least union-free expression found that covers both: what only one has becomes optional, ``("?", ...)``."""
    bare = [x if not (isinstance(x, tuple) and x[0] == "?") else x[1:] for x in wrapper]
    flat, back = [], []
    for i, x in enumerate(bare):
        for y in x if isinstance(wrapper[i], tuple) and wrapper[i][0] == "?" else [x]:
            flat.append(y)
            back.append(i)
    plain = [y for x in stream for y in (x[1:] if isinstance(x, tuple) and x[0] == "?" else [x])]
    maybe = [isinstance(x, tuple) and x[0] == "?" for x in stream for _ in (x[1:] if isinstance(x, tuple) and x[0] == "?" else [x])]
    optional = [isinstance(wrapper[i], tuple) and wrapper[i][0] == "?" for i in back]
    merged: list[tuple[object, bool]] = []
    for kind, a0, a1, b0, b1 in SequenceMatcher(None, flat, plain, autojunk=False).get_opcodes():
        if kind == "equal":
            merged += [(flat[i], optional[i] or maybe[j]) for i, j in zip(range(a0, a1), range(b0, b1))]
        else:
            merged += [(x, True) for x in flat[a0:a1]]
            merged += [(x, True) for x in plain[b0:b1]]
    out: list = []
    run: list = []
    for x, opt in [*merged, (None, False)]:
        if opt:
            run.append(x)
            continue
        if run:
            last = out[-1] if out else None
            body = tuple(run)
            if not (isinstance(last, tuple) and last[0] == "+" and last[1:] == body):
                out.append(("?", *body))
            run = []
        if x is not None:
            out.append(x)
    return out


def _flat(wrapper: list) -> list:
    """The tokens of a wrapper with its optional parts opened; groups stay whole."""
    return [y for x in wrapper for y in (x[1:] if isinstance(x, tuple) and x[0] == "?" else [x])]


@lru_cache(maxsize=4096)
def places(wrapper: str, shape: str) -> tuple[int, ...]:
    """Where in the opened wrapper each token of a page's shape stands, both as JSON; -1 where it has no place.

    A token that the alignment leaves out, as it prefers long matches, takes the nearest place of its kind after those before it.
    """
    flat, tokens = _flat(_loads(wrapper)), _flat(_loads(shape))
    out = [-1] * len(tokens)
    for a, b, n in SequenceMatcher(None, flat, tokens, autojunk=False).get_matching_blocks():
        out[b : b + n] = range(a, a + n)
    kinds: dict = {}
    for at, token in enumerate(flat):
        kinds.setdefault(token, []).append(at)
    last = -1
    for b, token in enumerate(tokens):
        if out[b] < 0 and token in kinds:
            out[b] = next((a for a in kinds[token] if a > last), kinds[token][-1])
        last = max(last, out[b])
    return tuple(out)


def spell(wrapper: list) -> str:
    """A wrapper as text: ``( … )+`` repeats, ``( … )?`` may be missing, ``#`` is a text slot."""
    return " ".join(x if isinstance(x, str) else f"( {spell(list(x[1:]))} ){x[0]}" for x in wrapper)


def _loads(text: str) -> list:
    def tuples(x):
        return tuple(tuples(y) for y in x) if isinstance(x, list) else x

    return [tuples(x) for x in json.loads(text)]


ELEMENTS = "array<struct<path:array<string>,opens:array<int>,hidden:boolean,named:boolean>>"
MARKS = "array<struct<at:int,element:int,text:long,chars:int,linked:int>>"
SHAPES = f"host string, unit long, shape string, page long, elements {ELEMENTS}, marks {MARKS}"
_element = pa.struct([("path", pa.list_(pa.string())), ("opens", pa.list_(pa.int32())), ("hidden", pa.bool_()), ("named", pa.bool_())])
_mark = pa.struct([("at", pa.int32()), ("element", pa.int32()), ("text", pa.int64()), ("chars", pa.int32()), ("linked", pa.int32())])
SHAPE = pa.schema([("host", pa.string()), ("unit", pa.int64()), ("shape", pa.string()), ("page", pa.int64()), ("elements", pa.list_(_element)), ("marks", pa.list_(_mark))])


def read_shape(page: str) -> tuple[list[Block], list[int], list[int], str]:
    """Blocks of a page, the folded token of each of them and of each stream token, and its shape as JSON."""
    blocks, stream = read_page(page)
    tokens, sizes = folded(stream)
    own = owners(sizes)
    return blocks, [own[i] for i, x in enumerate(stream) if x == "#"], own, json.dumps(tokens)


def _shapes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for host, unit, value in zip(*batch.columns):
            blocks, at, own, shape = read_shape(value.as_py() or "")
            elements: dict[tuple, int] = {}
            marks = []
            for b, token in zip(blocks, at):
                element = (b.path, tuple(own[i] for i in b.opens), b.hidden, b.named)
                marks.append((token, elements.setdefault(element, len(elements)), _number(b.text), len(b.text), b.linked))
            page = _number("\n".join([shape, *(b.text for b in blocks if not b.hidden)]))
            names = ("at", "element", "text", "chars", "linked")
            rows.append((host.as_py(), unit.as_py(), shape, page, [dict(zip(("path", "opens", "hidden", "named"), e)) for e in elements], [dict(zip(names, m)) for m in marks]))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(SHAPE.types)], schema=SHAPE)


def merge_shapes(shapes: list[str]) -> list:
    """The wrapper of page shapes (JSON), the most frequent aligned first."""
    counts = Counter(shapes)
    wrapper: list = []
    for i, shape in enumerate(sorted(counts, key=lambda x: (-counts[x], x))):
        wrapper = _loads(shape) if i == 0 else align(wrapper, _loads(shape))
    return wrapper


def chain(path: tuple[str, ...], opens: tuple[int, ...], slots: tuple[int, ...]) -> tuple[tuple[int, str], ...]:
    """An element as the wrapper sees it: place and name of each element around it."""
    return tuple((slots[i], name) for i, name in zip(opens, path))


def main_region(elements: dict[tuple, tuple[float, float]], j: Judging = Judging()) -> tuple | None:
    """The part of a wrapper that holds the main text, from (content, other) characters of each element; none without content.

    It is the innermost container around the element that holds more than half of all content, or around the most of it,
    widened to an outer container where that adds enough content.
    """
    good: Counter = Counter()
    bad: Counter = Counter()
    for element, (content, other) in elements.items():
        for n in range(len(element) + 1):
            good[element[:n]] += content
            bad[element[:n]] += other
    whole = good[()]
    if whole <= 0:
        return None
    region = max((e for e in good if good[e] > j.region * whole), key=lambda e: (len(e), good[e], e))
    while region and region[-1][1].split(".")[0] not in CONTAINERS:
        region = region[:-1]
    for n in range(len(region) - 1, -1, -1):
        outer = region[:n]
        more, else_ = good[outer] - good[region], bad[outer] - bad[region]
        if outer and outer[-1][1].split(".")[0] not in CONTAINERS:
            continue
        if more > 0 and more >= j.widen * else_:
            region = outer
        elif else_ > 0:
            break
    return region


def judge_pages(pages: list[tuple[str, list, list]], j: Judging = Judging(), wrapper: list | None = None) -> dict:
    """Wrapper and verdict on the different pages (shape, elements, marks) of a host: ``plan``, ``region``, ``names``, ``cuts``.

    ``cuts`` are the template texts as (place, element, text), ``names`` says whether names count.
    """
    wrapper = merge_shapes([p[0] for p in pages]) if wrapper is None else wrapper
    plan = json.dumps(wrapper)
    on, filled = Counter(), Counter()
    sums: dict[tuple, list[int]] = {}
    flags: dict[tuple, tuple[bool, bool]] = {}
    for shape, elements, marks in pages:
        slots = places(plan, shape)
        chains = [chain(tuple(e["path"]), tuple(e["opens"]), slots) for e in elements]
        texts, spots = set(), set()
        for m in marks:
            spot = (slots[m["at"]], chains[m["element"]])
            if spot[0] < 0:
                continue
            e, had = elements[m["element"]], flags.get(spot, (False, False))
            flags[spot] = (had[0] or e["hidden"], had[1] or e["named"])
            one = sums.setdefault((*spot, m["text"]), [0, 0])
            one[0] += m["chars"]
            one[1] += m["linked"]
            texts.add((*spot, m["text"]))
            spots.add(spot)
        on.update(texts)
        filled.update(spots)
    shown = {t: c for t, c in sums.items() if not flags[t[:2]][0]}
    cuts = {t for t in shown if on[t] >= j.pages and on[t] >= j.slot * filled[t[:2]] and filled[t[:2]] >= j.host * len(pages)}
    if sum(shown[t][0] for t in cuts) > j.most * sum(c for c, _ in shown.values()):
        cuts = set()
    plain = {t: max(c - 2 * linked, 0) for t, (c, linked) in shown.items()}
    varying = {t: n for t, n in plain.items() if t not in cuts}
    names = sum(n for t, n in varying.items() if not flags[t[:2]][1]) >= j.unnamed * sum(varying.values())
    elements: dict[tuple, tuple[float, float]] = {}
    for t, (chars, linked) in shown.items():
        content = 0 if t in cuts or names and flags[t[:2]][1] else plain[t]
        a, b = elements.get(t[1], (0, 0))
        elements[t[1]] = (a + content, b + chars - content)
    return {"plan": plan, "region": main_region(elements, j), "names": names, "cuts": cuts}


def _element_number(element: tuple) -> int:
    return _number(repr(element))


JUDGED = "host string, unit long, wrapper string, plan string, region string, names boolean, cuts array<struct<slot:int,element:long,text:long>>, pages long"


def _judge_unit(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["page", "shape"])
    pages = list(zip(pdf["shape"], pdf["elements"], pdf["marks"]))
    v = judge_pages(pages)
    cuts = sorted((slot, _element_number(element), text) for slot, element, text in v["cuts"])
    return pd.DataFrame({
        "host": [key[0]], "unit": [key[1]], "wrapper": [spell(_loads(v["plan"]))], "plan": [v["plan"]], "region": [None if v["region"] is None else json.dumps(v["region"])],
        "names": [v["names"]], "cuts": [[dict(zip(("slot", "element", "text"), c)) for c in cuts]], "pages": [len(pdf)],
    })


def with_units(rows: DataFrame) -> DataFrame:
    """Add ``unit`` to rows with ``host, url, html``: pages of one host and unit share a wrapper. Large hosts are dealt to
    several by the hash of url and html, so that no unit grows with the host."""
    sizes = rows.groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.length("html")), F.lit(0)).alias("chars"))
    per = F.when(F.col("host") == "", PAGES_WITHOUT_HOST).otherwise(PAGES_PER_WRAPPER)
    sizes = sizes.select("host", F.greatest(F.ceil(F.col("n") / per), F.ceil(F.col("chars") / CHARS_PER_WRAPPER), F.lit(1)).alias("__units"))
    return with_lookup(rows, sizes, ["host"]).withColumn("unit", F.pmod(F.xxhash64("url", "html"), "__units")).drop("__units")


def infer_wrappers(pages: DataFrame) -> DataFrame:
    """``host, unit, wrapper, plan, region, names, cuts, pages`` from ``pages(host, unit, html)``: one wrapper per host and unit, from all
    its pages, and the verdict on its places. ``wrapper`` is its spelling, ``plan`` the same as JSON.

    Equal pages are first reduced to one, so what is gathered per unit is bounded by its number of different pages."""
    shapes = pages.select("host", "unit", "html").mapInArrow(_shapes, SHAPES)
    one = shapes.groupBy("host", "unit", "page").agg(F.first(F.struct("shape", "elements", "marks")).alias("s")).select("host", "unit", "page", "s.*")
    return one.groupBy("host", "unit").applyInPandas(_judge_unit, JUDGED)


def main_text(page: str, plan: str, region: tuple | None, names: bool = True, cuts: frozenset = frozenset()) -> str:
    """Text of the main region of a page as its host's wrapper reads it, a line for each block.

    Blocks that have no place in the wrapper are not read. A page that has nothing in the host's region finds its own among
    the blocks that have a place, by the same rule.
    """
    blocks, at, own, shape = read_shape(page)
    slots = places(plan, shape)
    placed = []
    for b, token in zip(blocks, at):
        if slots[token] < 0 or b.hidden or names and b.named:
            continue
        element = chain(b.path, tuple(own[i] for i in b.opens), slots)
        if not cuts or (slots[token], _element_number(element), _number(b.text)) not in cuts:
            placed.append((b, element))
    inside = [b for b, e in placed if region is not None and e[: len(region)] == region]
    if not inside and placed:
        sums: dict[tuple, tuple[float, float]] = {}
        for b, e in placed:
            content = max(len(b.text) - 2 * b.linked, 0) or 1e-9 * len(b.text)
            a, c = sums.get(e, (0, 0))
            sums[e] = (a + content, c + len(b.text) - content)
        region = main_region(sums)
        inside = [b for b, e in placed if region is not None and e[: len(region)] == region]
    return "\n".join(b.text for b in inside)


def _region(text: str | None) -> tuple | None:
    return None if text is None else tuple((slot, name) for slot, name in json.loads(text))


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = []
        for html, plan, region, names, cuts in zip(*batch.columns[2:7]):
            found = frozenset((x["slot"], x["element"], x["text"]) for x in cuts.as_py() or [])
            texts.append(main_text(html.as_py() or "", plan.as_py() or "[]", _region(region.as_py()), bool(names.as_py()), found))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: ``page_id, url, text, n_chars``.

    Character references are decoded, white space inside a block becomes one space, blocks are joined in page order by
    a newline. Null or empty html gives an empty text; pages whose url is null or has no host share wrappers in small
    groups; a very long page is read whole, elements nested deeper than ``DEEPEST`` are not told apart; null and repeated ids are each
    returned; an empty table gives an empty result; other columns are not read. Of regions with equal sums the deeper one wins, then the
    later in the wrapper, so the result does not depend on the order of rows.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    rows = with_units(rows.withColumn("host", host_of(F.col("url"))))
    wrappers = stored(infer_wrappers(rows).select("host", "unit", "plan", "region", "names", "cuts"), "wrappers")
    joined = with_lookup(rows, wrappers, ["host", "unit"]).select("page_id", "url", "html", "plan", "region", "names", "cuts")
    out = joined.mapInArrow(_texts, "page_id long, url string, text string")
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
