"""Audit of how far the sources of a language differ in their words.

The words that are kept, those in several documents of the language, are found by refining prefixes. A task first counts its own documents:
a cell (language, term) holds its counts by source and as many rows as the threshold asks for, at most. A cell with that many rows proves its
term. The others are cut to a few bytes; prefixes in too few documents go, and with them their terms, before longer prefixes of the rest are counted,
until what is counted are whole terms. Counts of distinct documents need no longer lists: a union of lists cut at the threshold reaches it exactly if
the whole union does. Shares and divergences are whole numbers.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sceneloom.shared import release, stored, with_lookup

#: Terms in UTF-8 after lower-casing A to Z: letters of ASCII and all that is not ASCII.
TERM = re.compile(rb"[a-z\x80-\xff]+")
WHOLE = 1_000_000_000


@dataclass(frozen=True)
class Audit:
    """Terms in ``documents`` documents of a language are kept; prefixes start at ``prefix`` bytes and grow ``growth`` times a level. A task hands
    its cells on when it holds ``cells`` different terms, or ``entries`` terms of documents. Sources are compared ``tile`` by ``tile``, ``block``
    terms at a time; ``top`` terms a group are returned."""

    documents: int = 3
    prefix: int = 12
    growth: int = 4
    cells: int = 400_000
    entries: int = 6_000_000
    tile: int = 256
    block: int = 4_000
    top: int = 200


COUNT = pa.struct([("source", pa.string()), ("n", pa.int64())])
CELL = pa.schema([("lang", pa.string()), ("term", pa.binary()), ("seen", pa.list_(pa.int64())), ("counts", pa.list_(COUNT))])


def _slices(data: bytes, size: int = 1 << 22) -> Iterator[bytes]:
    """A text in pieces that end where a term does, so that the list of all terms of a very long text is never held."""
    at = 0
    while at < len(data):
        end = at + size
        if end < len(data):
            inside = TERM.match(data, end)
            end = inside.end() if inside else end
        yield data[at:end]
        at = end


class Cells:
    """The terms of one language in a task's documents: term numbers, and per document and term the row, the source and how often."""

    def __init__(self) -> None:
        self.ids: dict[bytes, int] = {}
        self.sources: dict[str, int] = {}
        self.parts: list[tuple[np.ndarray, np.ndarray, int, int]] = []

    def add(self, source: str, row: int, own: Counter[bytes]) -> None:
        ids = self.ids
        found = np.fromiter((ids.setdefault(t, len(ids)) for t in own), dtype=np.int64, count=len(own))
        n = np.fromiter(own.values(), dtype=np.int64, count=len(own))
        self.parts.append((found, n, row, self.sources.setdefault(source, len(self.sources))))

    def table(self, lang: str, documents: int) -> pa.RecordBatch:
        sizes = [len(p[0]) for p in self.parts]
        term = np.concatenate([p[0] for p in self.parts])
        row = np.repeat([p[2] for p in self.parts], sizes)
        order = np.argsort(term, kind="stable")
        starts = np.searchsorted(term[order], np.arange(len(self.ids)))
        rank = np.arange(len(term)) - starts[term[order]]
        few = order[rank < documents]
        seen = np.concatenate([[0], np.cumsum(np.bincount(term[few], minlength=len(self.ids)))])
        width = len(self.sources)
        code, at = np.unique(term * width + np.repeat([p[3] for p in self.parts], sizes), return_inverse=True)
        sums = np.zeros(len(code), dtype=np.int64)
        np.add.at(sums, at, np.concatenate([p[1] for p in self.parts]))
        ends = np.concatenate([[0], np.cumsum(np.bincount(code // width, minlength=len(self.ids)))])
        names = pa.array(list(self.sources), pa.string()).take(pa.array(code % width))
        counts = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([names, pa.array(sums)], fields=list(COUNT)))
        lists = pa.ListArray.from_arrays(pa.array(seen, pa.int32()), pa.array(row[few], pa.int64()))
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(self.ids), pa.string()), pa.array(list(self.ids), pa.binary()), lists, counts], schema=CELL)


def _cells(audit: Audit):
    """Count the terms of a task's documents (lang, source, text, row)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs: dict[str, Cells] = {}
        entries = 0
        for batch in batches:
            for lang, source, text, row in zip(*(batch.column(i).to_pylist() for i in (0, 1)), batch.column(2), batch.column(3).to_pylist()):
                own: Counter[bytes] = Counter()
                for piece in _slices((text.as_py() or "").encode("utf-8").lower()):
                    own.update(TERM.findall(piece))
                if own:
                    langs.setdefault(lang, Cells()).add(source, row, own)
                    entries += len(own)
                if entries >= audit.entries or sum(len(c.ids) for c in langs.values()) >= audit.cells:
                    yield from (c.table(name, audit.documents) for name, c in langs.items())
                    langs, entries = {}, 0
        yield from (c.table(name, audit.documents) for name, c in langs.items())

    return run


def count_cells(docs: DataFrame, audit: Audit = Audit()) -> DataFrame:
    """``lang, term, seen, counts``: terms (bytes) of each task's documents, up to ``documents`` rows that hold them, and counts by source."""
    text = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")]
    rows = docs.select(*text, F.monotonically_increasing_id().alias("row"))
    return rows.mapInArrow(_cells(audit), "lang string, term binary, seen array<long>, counts array<struct<source:string,n:long>>")


def refine(cells: DataFrame, audit: Audit = Audit()) -> DataFrame:
    """The cells that can still be of a term in ``documents`` documents of its language: all whose prefixes, up to the longest that is a part of any
    term left, are in as many.

    Cells that prove their term, and with it its prefixes, stay aside. Terms shorter than a prefix are counted whole with it.
    """
    sure = F.size("seen") >= audit.documents
    proved, live, length = cells.where(sure), cells.where(~sure), audit.prefix
    longest = live.agg(F.max(F.length("term"))).first()[0] or 0
    while length <= longest:
        cut = F.substring("term", 1, length).alias("prefix")
        rows = live.select("lang", cut, F.explode("seen").alias("row")).distinct()
        enough = rows.groupBy("lang", "prefix").count().where(F.col("count") >= audit.documents).select("lang", "prefix")
        enough = stored(enough.union(proved.select("lang", cut)).distinct(), "prefixes")
        before, live = live, stored(with_lookup(live.select("*", cut), enough, ["lang", "prefix"], "left_semi").drop("prefix"), "cells")
        release(before)
        release(enough)
        longest = live.agg(F.max(F.length("term"))).first()[0] or 0
        length *= audit.growth
    return proved.unionByName(live)


def count_kept(cells: DataFrame, audit: Audit = Audit()) -> DataFrame:
    """``lang, term, n, found``: each term in ``documents`` documents or more, with its count and the counts by source, from cells of tasks.

    The last refinement, to whole terms: a document is in one cell of a term, so their rows add up. Cells are dealt by term once, and sums by source
    and by language both follow from that.
    """
    dealt = cells.select("lang", "term", F.size("seen").alias("docs"), "counts").repartition("lang", "term")
    each = dealt.select("lang", "term", "docs", F.posexplode("counts").alias("i", "c"))
    by_source = each.groupBy("lang", "term", F.col("c.source").alias("source")).agg(F.sum("c.n").alias("n"), F.sum(F.when(F.col("i") == 0, F.col("docs")).otherwise(0)).alias("docs"))
    whole = by_source.groupBy("lang", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"), F.collect_list(F.struct("source", "n")).alias("found"))
    return whole.where(F.col("docs") >= audit.documents).drop("docs")


def share(count: Column, total: Column) -> Column:
    """1 + floor(10^9 * (count + 1) / total) for count + 1 <= total < 9 * 10^13, without a product beyond 64 bits."""
    some = (count + 1) * 100_000
    return F.call_function("div", some, total) * 10_000 + F.call_function("div", (some % total) * 10_000, total) + 1


def share_of(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """``share`` over arrays."""
    some = (count + 1) * 100_000
    return some // total * 10_000 + some % total * 10_000 // total + 1


def _compare(audit: Audit):
    """Sums of (p - q)^2 div q over a block of terms, for all pairs of a source of tile ``ta`` with one of tile ``tb``."""
    out = pa.schema([("lang", pa.string()), ("a", pa.int64()), ("b", pa.int64()), ("value", pa.int64())])

    def run(key: tuple, terms: pa.Table, sources: pa.Table) -> pa.Table:
        lang, ta, tb = (x.as_py() for x in key[:3])
        found = terms["found"].combine_chunks()
        if not len(found) or not len(sources):
            return out.empty_table()
        flat = found.flatten()
        seat = pc.index_in(flat.field("source"), value_set=sources["source"].combine_chunks()).to_numpy(zero_copy_only=False)
        row = pc.list_parent_indices(found).to_numpy()
        here = ~np.isnan(seat)
        n = np.zeros((len(found), len(sources)), dtype=np.int64)
        n[row[here], seat[here].astype(np.int64)] = flat.field("n").to_numpy()[here]
        p = share_of(n, sources["total"].to_numpy())
        nos = sources["no"].to_numpy()
        parts = []
        for a in np.flatnonzero(nos // audit.tile == ta):
            cols = np.flatnonzero((nos // audit.tile == tb) & (nos != nos[a]))
            d = p[:, [a]] - p[:, cols]
            parts.append((np.full(len(cols), nos[a]), nos[cols], (d * d // p[:, cols]).sum(axis=0)))
        a, b, value = (np.concatenate([x[i] for x in parts]) if parts else np.empty(0, np.int64) for i in range(3))
        return pa.table([pa.array([lang] * len(a), pa.string()), a, b, value], schema=out)

    return run


def _pair_values(terms: DataFrame, groups: DataFrame, vocabulary: DataFrame, audit: Audit) -> DataFrame:
    """``lang, a, b, value`` for all sources of a language by number; a kept term without occurrences counts with its least share.

    A block of terms meets the sources of two tiles in one task, so neither the terms nor the sources of a language are ever held whole.
    """
    tiles = groups.groupBy("lang").agg(F.max(F.floor(F.col("no") / audit.tile)).cast("int").alias("last"))
    salts = vocabulary.select("lang", F.ceil(F.col("v") / F.lit(float(audit.block))).cast("int").alias("salts"))
    plan = stored(tiles.join(salts, "lang"), "tiles")
    rows = with_lookup(terms.select("lang", "term", "found"), plan, ["lang"]).withColumn("salt", F.pmod(F.xxhash64("term"), F.col("salts")).cast("int"))
    rows = rows.withColumn("ta", F.explode(F.sequence(F.lit(0), "last"))).withColumn("tb", F.explode(F.sequence(F.lit(0), "last"))).select("lang", "ta", "tb", "salt", "found")
    own = F.floor(F.col("no") / audit.tile).cast("int")
    seats = with_lookup(groups.select("lang", "source", "no", "total"), plan, ["lang"]).withColumn("other", F.explode(F.sequence(F.lit(0), "last")))
    first, second = seats.select("*", own.alias("ta"), F.col("other").alias("tb")), seats.select("*", F.col("other").alias("ta"), own.alias("tb")).where("ta <> tb")
    seats = first.unionByName(second).withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).select("lang", "ta", "tb", "salt", "source", "no", "total")
    keys = ["lang", "ta", "tb", "salt"]
    sums = rows.groupBy(*keys).cogroup(seats.groupBy(*keys)).applyInArrow(_compare(audit), "lang string, a long, b long, value long")
    return sums.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def source_divergence(docs: DataFrame, audit: Audit = Audit()) -> DataFrame:
    """``lang, source, part, item, value, rank`` for ``docs(lang, source, text)``; null counts as empty.

    Part ``pair``: every other source of the language with its divergence from this one over all kept terms; part ``term``: the ``top`` kept
    terms that this source uses more than its language does. Equal values go by the item's bytes. Repeated rows are documents of their
    own; a group without terms has its pairs; a language without kept terms has pairs of value 0; an empty table gives an empty
    result. Other columns are not read.
    """
    cells = stored(count_cells(docs, audit), "cells")
    terms = stored(count_kept(refine(cells, audit), audit), "terms")
    vocabulary = stored(terms.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("n").alias("whole")), "vocabulary")
    each = terms.select("lang", "term", "n", F.explode("found").alias("c")).select("lang", "c.source", "term", F.col("c.n").alias("own"), "n")
    text = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]
    groups = docs.select(*text).distinct().join(each.groupBy("lang", "source").agg(F.sum("own").alias("own")), ["lang", "source"], "left").join(vocabulary, "lang", "left")
    number = F.row_number().over(Window.partitionBy("lang").orderBy("source")).cast("long") - 1
    total = F.coalesce("own", F.lit(0)) + F.col("v")
    groups = stored(groups.select("lang", "source", "v", number.alias("no"), total.alias("total"), (F.col("whole") + F.col("v")).alias("whole")), "groups")

    values = _pair_values(terms, groups.where("v > 0"), vocabulary, audit)
    a, b = groups.select("lang", F.col("no").alias("a"), "source"), groups.select("lang", F.col("no").alias("b"), F.col("source").alias("item"))
    pairs = b.join(a, "lang").where("a <> b").join(values, ["lang", "a", "b"], "left")
    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).alias("value"))
    shares = with_lookup(each, groups, ["lang", "source"]).select("lang", "source", "term", share(F.col("own"), F.col("total")).alias("p"), share(F.col("n"), F.col("whole")).alias("q")).where("p > q")
    value = F.call_function("div", (F.col("p") - F.col("q")) * (F.col("p") - F.col("q")), F.col("q"))
    items = shares.select("lang", "source", F.lit("term").alias("part"), F.decode("term", "UTF-8").alias("item"), value.alias("value"))
    ranked = [x.withColumn("rank", F.row_number().over(by_value)) for x in (pairs, items)]
    return ranked[0].unionByName(ranked[1].where(F.col("rank") <= audit.top))
