"""Exact pairs of similar shingle sets, for what fingerprints do not meet.

Two sets with a Jaccard similarity of at least t differ in at most (1 - t) / (1 + t) of their sizes' sum. If the space of
hashes is cut into more classes than that, some class holds the same shingles of both. Each set gives a key per class,
sets of similar sizes use the same cut, and pairs that share a key are verified on the sets themselves.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sceneloom.components import connected_components
from sceneloom.llm.rows import text_digest
from sceneloom.llm.shingles import fingerprint, shingle_hashes
from sceneloom.shared import release, stored, with_lookup

#: A key held by more sets than this is left to the sets that have not enough other keys.
HOT = 64
#: Rounds in which crowded keys propose stars before all pairs of what is still apart are proposed.
STARS = 2
#: Sets of a key up to which pairs are joined; more are compared in blocks of about ``BLOCK`` sets and ``WORDS`` words of their sketches or sets in all.
FEW = 16
BLOCK = 1024
WORDS = 1 << 16
#: Times that sets with too few shared keys are put aside.
PRUNINGS = 2
EPS = 1e-9
ODD = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


@cache
def size_steps(t: float) -> tuple[int, ...]:
    """Least sizes of intervals so wide that similar sets lie in one or in two neighbours."""
    steps = [1]
    while steps[-1] < 1 << 40:
        steps.append(int(steps[-1] / t + EPS) + 1)
    return tuple(steps)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * ODD[1]
    return x ^ (x >> np.uint64(29))


def class_keys(hashes: np.ndarray, step: int, need: int, classes: int) -> tuple[np.ndarray, int]:
    """Keys of the classes of a cut that hold any of the distinct ``hashes``, and how many more there are than ``need``.

    A set with fewer than ``need`` such classes gives keys for its empty classes too, and the second value is -1.
    """
    at = ((hashes * ODD[0]) >> np.uint64(24)) % np.uint64(classes)
    order = np.argsort(at, kind="stable")
    at, values = at[order], _mixed(hashes[order] + ODD[2])
    starts = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    used, sums = at[starts], np.add.reduceat(values, starts)
    margin = len(used) - need
    if margin < 0:
        sums = np.zeros(classes, dtype=np.uint64)
        np.add.at(sums, at.astype(np.int64), values)
        used, margin = np.arange(classes, dtype=np.uint64), -1
    salt = _mixed(used * ODD[2] + np.uint64((step + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
    return _mixed(sums ^ salt).view(np.int64), margin


def set_keys(hashes: np.ndarray, t: float) -> list[tuple[np.ndarray, int]]:
    """Keys and margins of a set in the cut of its own size interval and in that of the one below (smaller partners)."""
    n, steps, part = len(hashes), size_steps(t), (1 - t) / (1 + t)
    if not n:
        return [(np.empty(0, dtype=np.int64), 0)] * 2
    own = bisect_right(steps, n) - 1
    out = []
    for step in (own, own - 1):
        top = steps[step + 1] - 1 if step >= 0 else 0
        if step < own and top + EPS < t * n:
            out.append((np.empty(0, dtype=np.int64), 0))
            continue
        classes = int(part * (top + top / t) + EPS) + 1
        partner = n / t if step == own else top
        out.append(class_keys(hashes, step, int(part * (n + partner) + EPS) + 1, classes + classes // 10 + 3))
    return out


def parity_sketch(hashes: np.ndarray) -> np.ndarray:
    """Bits that say whether an odd number of the distinct ``hashes`` fall on them, two or more bits a hash, as longs.

    The sketches of two sets differ in at most as many bits as the sets in members; halves folded by exclusive or give
    the sketch of half the length."""
    bits = 64
    while bits < 2 * len(hashes):
        bits *= 2
    at = ((hashes * ODD[1]) >> np.uint64(20)) & np.uint64(bits - 1)
    odd = np.bincount(at.astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def folded_sketch(words: np.ndarray, most: int) -> np.ndarray:
    """A parity sketch folded to at most ``most`` longs."""
    while len(words) > most:
        words = words[: len(words) // 2] ^ words[len(words) // 2 :]
    return words


def bits_apart(n_a: np.ndarray, held_a: np.ndarray, n_b: np.ndarray, held_b: np.ndarray) -> np.ndarray:
    """Bits in which the parity sketches of one side differ from each of the other's, folded to the shortest of all; ``held`` has
    a side's sketches one after the other, ``n`` their lengths."""
    most = min(n_a.min(), n_b.min())
    a, b = (np.array([folded_sketch(x, most) for x in np.split(held, np.cumsum(n)[:-1])]).view(np.uint64) for n, held in ((n_a, held_a), (n_b, held_b)))
    out = np.zeros((len(a), len(b)), dtype=np.int64)
    for w in range(most):
        out += np.bitwise_count(a[:, None, w] ^ b[None, :, w])
    return out


def shared_members(n_a: np.ndarray, held_a: np.ndarray, n_b: np.ndarray, held_b: np.ndarray) -> np.ndarray:
    """How many members each set of one side shares with each of the other; ``held`` has a side's sets one after the other, ``n`` their sizes."""
    both = np.intersect1d(held_a, held_b)

    def bits(n: np.ndarray, held: np.ndarray) -> np.ndarray:
        out = np.zeros((len(n), -(-max(len(both), 1) // 64) * 64), dtype=bool)
        met = np.isin(held, both)
        out[np.repeat(np.arange(len(n)), n)[met], np.searchsorted(both, held[met])] = True
        return np.packbits(out, axis=1).view(np.uint64)

    a, b = bits(n_a, held_a), bits(n_b, held_b)
    out = np.zeros((len(n_a), len(n_b)), dtype=np.int64)
    for w in range(a.shape[1]):
        out += np.bitwise_count(a[:, None, w] & b[None, :, w])
    return out


def forest(linked: np.ndarray, ids_a: np.ndarray, ids_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places ``(i, j)`` in the matrix ``linked`` of links that connect all ids it connects, without those between ids that others connect already."""
    ids, at = np.unique(np.concatenate([ids_a, ids_b]), return_inverse=True)
    at_a, at_b, part = at[: len(ids_a)], at[len(ids_a) :], np.arange(len(ids))
    rows, columns = [], []
    for i in np.flatnonzero(linked.any(axis=1)):
        j = np.flatnonzero(linked[i])
        parts, first = np.unique(part[at_b[j]], return_index=True)
        new = parts != part[at_a[i]]
        if new.any():
            part[np.isin(part, parts[new])] = part[at_a[i]]
            rows += [i] * int(new.sum())
            columns += j[first[new]].tolist()
    return np.array(rows, dtype=np.int64), np.array(columns, dtype=np.int64)


def _sets(similarity: float, shingle: int):
    kinds = [("doc_id", pa.int64()), ("text_sha256", pa.string()), ("sketch", pa.list_(pa.int64())), ("digest", pa.binary()), ("n", pa.int32()), ("fp", pa.int64()),
             ("own", pa.list_(pa.int64())), ("own_margin", pa.int32()), ("low", pa.list_(pa.int64())), ("low_margin", pa.int32())]
    schema = pa.schema(kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for value in batch.column(2):
                hashes = shingle_hashes(value.as_buffer().to_pybytes() if value.is_valid else b"", shingle)
                distinct = np.unique(hashes)
                (own, own_margin), (low, low_margin) = set_keys(distinct, similarity)
                fp = fingerprint(hashes)
                rows.append((parity_sketch(distinct), hashlib.sha256(distinct.tobytes()).digest()[:16], len(distinct), fp - (1 << 64) if fp >> 63 else fp, own, own_margin, low, low_margin))
            columns = [pa.array([r[i] for r in rows], kind) for i, (_, kind) in enumerate(kinds[2:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], schema=schema)

    return run


SETS = "doc_id long, text_sha256 string, sketch array<long>, digest binary, n int, fp long, own array<long>, own_margin int, low array<long>, low_margin int"


def _base(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_digest(F.col(text_col)).alias("text_sha256"), F.col(text_col).alias("text"))


def shingled(docs: DataFrame, similarity: float, shingle: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Two stored tables: a row per document with its ids, set digest, size ``n``, fingerprint ``fp``, parity ``sketch``, its number ``row`` and
    ``first``, the least number of a row with the same set; and the keys and margins of the rows that are first."""
    made = _base(docs, id_col, text_col).mapInArrow(_sets(similarity, shingle), SETS)
    raw = stored(made.withColumn("row", F.monotonically_increasing_id()), "sets")
    again = stored(raw.groupBy("digest").agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("of")).where("of > 1").drop("of"), "equal-sets")
    made = with_lookup(raw, again, ["digest"]).withColumn("first", F.coalesce("first", "row"))
    nodes = stored(made.select("row", "first", "doc_id", "text_sha256", "n", "fp", "sketch"), "nodes")
    keys = made.where("row = first").select("row", "own", "own_margin", "low", "low_margin")
    keys._stored_at = raw._stored_at  # what ``release`` deletes when no key is needed any more
    return nodes, keys


def _hashes(shingle: int):
    schema = pa.schema([("doc_id", pa.int64()), ("text_sha256", pa.string()), ("set", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.unique(shingle_hashes(v.as_buffer().to_pybytes() if v.is_valid else b"", shingle)).view(np.int64) for v in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.int64()))], schema=schema)

    return run


def _bits_apart(a: str, b: str) -> Column:
    """Bits in which two parity sketches differ; a sketch of twice the length is folded first."""
    def fit(x: str, y: str) -> Column:
        half = F.size(y)
        folded = F.zip_with(F.slice(x, F.lit(1), half), F.slice(x, half + 1, half), lambda u, v: u.bitwiseXOR(v))
        return F.when(F.size(x) > F.size(y), folded).otherwise(F.col(x))

    return F.aggregate(F.zip_with(fit(a, b), fit(b, a), lambda u, v: F.bit_count(u.bitwiseXOR(v))), F.lit(0), lambda s, x: s + x)


def _sets_of(docs: DataFrame, nodes: DataFrame, rows: DataFrame, shingle: int, id_col: str, text_col: str) -> DataFrame:
    """The stored ``row, set`` of the ``rows`` that are asked for, made again from their documents."""
    asked = stored(rows.select("row").distinct().join(nodes.select("row", "doc_id", "text_sha256"), "row"), "asked")
    on = ["doc_id", "text_sha256"]
    texts = with_lookup(_base(docs, id_col, text_col), stored(asked.select(*on).distinct(), "asked-texts"), on, "left_semi")
    made = texts.mapInArrow(_hashes(shingle), "doc_id long, text_sha256 string, set array<long>")
    made = stored(with_lookup(made, asked, on, "inner").dropDuplicates(["row"]).select("row", "set"), "sets-asked")
    release(asked)
    return made


def verified(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, similarity: float, shingle: int, id_col: str, text_col: str) -> DataFrame:
    """The stored ``pairs(a, b)`` of rows whose sets are similar enough. Pairs whose parity sketches
    differ too much are put aside first; sets are made again for the documents of the others only."""
    part = similarity / (1 + similarity)
    fits = pairs.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    for c in "ab":
        fits = fits.join(nodes.select(F.col("row").alias(c), F.col("n").alias(f"n_{c}"), F.col("sketch").alias(f"s_{c}")), c)
    fits = fits.where(F.least("n_a", "n_b") >= similarity * F.greatest("n_a", "n_b") - EPS)
    apart = F.floor((F.lit(1.0) - 2 * part) * (F.col("n_a") + F.col("n_b")) + EPS)
    fits = stored(fits.where(_bits_apart("s_a", "s_b") <= apart).select("a", "b", "n_a", "n_b"), "pairs")
    if fits.isEmpty():
        return fits.select("a", "b")
    made = _sets_of(docs, nodes, fits.select(F.col("a").alias("row")).union(fits.select(F.col("b").alias("row"))), shingle, id_col, text_col)
    both = fits
    for c in "ab":
        both = both.join(made.select(F.col("row").alias(c), F.col("set").alias(f"set_{c}")), c)
    shared = F.size(F.array_intersect("set_a", "set_b"))
    out = stored(both.where(shared >= part * (F.col("n_a") + F.col("n_b")) - EPS).select("a", "b"), "verified")
    for done in (fits, made):
        release(done)
    return out


def _pruned(live: DataFrame, margins: DataFrame) -> DataFrame:
    """``key, member, n`` without members that share too few keys for any similar partner, and without keys that this leaves alone.

    Similar sets differ in fewer classes than either needs, so they share more keys than either's margin."""
    enough = live.groupBy("member").agg(F.count(F.lit(1)).alias("shared")).join(margins, "member").where("shared > margin").select("member")
    left = stored(live.select("key", "member").join(stored(enough, "members"), "member", "left_semi"), "keys")
    sizes = left.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    out = stored(left.join(sizes, "key").select("key", "member", "n"), "keys")
    release(left)
    return out


def _live(first: DataFrame) -> DataFrame:
    """``key, row`` of keys that several sets share, without those that tell nothing."""
    def member(keys: str, slot: int):
        return F.transform(keys, lambda k: F.struct(k.alias("key"), (F.col("row") * 2 + slot).alias("member")))

    keyed = first.select(F.explode(F.concat(member("own", 0), member("low", 1))).alias("k")).select("k.*")
    live = stored(keyed.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("key"))).where("n > 1"), "keys")
    margins = stored(first.select(F.explode(F.array(*[F.struct((F.col("row") * 2 + i).alias("member"), F.col(m).alias("margin")) for i, m in enumerate(("own_margin", "low_margin"))])).alias("m")).select("m.*"), "margins")
    for _ in range(PRUNINGS):
        live, old = _pruned(live, margins), live
        release(old)
    hot = live.where(F.col("n") > HOT)
    spare = hot.groupBy("member").agg(F.count(F.lit(1)).alias("hot")).join(margins, "member").where("hot <= margin").select("member")
    needed = hot.join(stored(spare, "spare"), "member", "left_anti")
    kept = stored(live.where(F.col("n") <= HOT).unionByName(needed).select("key", F.floor(F.col("member") / 2).alias("row")), "live")
    for done in (live, margins):
        release(done)
    return kept


def _block_pairs(held: DataFrame, linked: Callable[..., np.ndarray], ids: str, name: str) -> DataFrame:
    """Stored links ``(a, b)`` of rows among ``held(key, row, label, n, words)``: those of different labels that ``linked`` finds under a key.

    Rows are dealt to blocks, and each two blocks of a key are compared as matrices. Of the links of two blocks only such leave the task as
    connect ``ids`` that the others leave apart: fewer than the blocks have rows.
    """
    wide = held.groupBy("key").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum(F.size("words")) / WORDS), F.lit(1)).alias("blocks"))
    dealt = held.join(wide, "key").withColumn("block", F.pmod(F.xxhash64("row"), "blocks"))
    blocks = stored(dealt.groupBy("key", "block").agg(F.collect_list(F.struct("row", "label", "n", "words")).alias("sets")), "blocks")
    other = blocks.select("key", F.col("block").alias("o_block"), F.col("sets").alias("o_sets"))

    def one(sets: pa.ListScalar) -> dict[str, np.ndarray]:
        *plain, words = sets.values.flatten()
        columns = {"row": plain[0], "label": plain[1], "n": plain[2], "lengths": pc.list_value_length(words), "words": words.flatten()}
        return {k: v.to_numpy(zero_copy_only=False).astype(np.int64, copy=False) for k, v in columns.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for left, right in zip(batch.column(0), batch.column(1)):
                a, b = one(left), one(right)
                i, j = forest(linked(a, b) & (a["label"][:, None] != b["label"][None, :]), a[ids], b[ids])
                yield pa.RecordBatch.from_arrays([pa.array(a["row"][i]), pa.array(b["row"][j])], names=["a", "b"])

    met = blocks.join(other, "key").where("block <= o_block").select("sets", "o_sets")
    out = stored(met.mapInArrow(run, "a long, b long"), name)
    release(blocks)
    return out


def _in_blocks(docs: DataFrame, nodes: DataFrame, rest: DataFrame, similarity: float, shingle: int, id_col: str, text_col: str) -> DataFrame:
    """Links ``(a, b)`` that connect all similar sets of different labels among those of each crowded key in ``rest(key, row, label)``.

    Sizes and parity sketches first tell which sets of a key may be similar, and the components of these pairs make groups; similar sets are in one
    group. Each set is then in one group only, whatever number of keys it has, and the sets of a group are compared member by member.
    """
    least, most = similarity / (1 + similarity), (1 - similarity) / (1 + similarity)

    def near(a: dict, b: dict) -> np.ndarray:
        n, m = a["n"][:, None], b["n"][None, :]
        sized = np.minimum(n, m) >= similarity * np.maximum(n, m) - EPS
        return sized & (bits_apart(a["lengths"], a["words"], b["lengths"], b["words"]) <= most * (n + m) + EPS)

    def alike(a: dict, b: dict) -> np.ndarray:
        return shared_members(a["lengths"], a["words"], b["lengths"], b["words"]) >= least * (a["n"][:, None] + b["n"][None, :]) - EPS

    held = rest.join(nodes.select("row", "n", F.col("sketch").alias("words")), "row")
    maybe = _block_pairs(held, near, "row", "near-in-blocks")
    if maybe.isEmpty():
        return maybe
    groups = stored(connected_components(maybe), "groups")
    release(maybe)
    made = _sets_of(docs, nodes, groups.select(F.col("node").alias("row")), shingle, id_col, text_col)
    held = groups.select(F.col("component").alias("key"), F.col("node").alias("row")).join(rest.select("row", "label").distinct(), "row").join(made, "row")
    out = _block_pairs(held.select("key", "row", "label", F.size("set").alias("n"), F.col("set").alias("words")), alike, "label", "links-in-blocks")
    for done in (groups, made):
        release(done)
    return out


def similar(docs: DataFrame, nodes: DataFrame, keys: DataFrame, proposed: DataFrame, similarity: float, shingle: int, id_col: str, text_col: str) -> DataFrame:
    """``node, component`` of all rows of ``nodes`` that are linked, where ``proposed(a, b)`` are more pairs to try. ``nodes`` and ``keys``
    come from ``shingled``.

    Keys propose a star to one of their sets, twice; only where the sets of a key are still apart all pairs of sets
    in different components are looked at, in blocks that give links only where there are many. So a group of near copies costs a few pairs for each copy, and no link is lost. A set that
    has keys enough without its crowded ones is not looked up by these: whatever is similar to it shares another key.
    """
    live = _live(keys)
    release(keys)
    edges = labels = met = None
    for turn in range(STARS + 1):
        if labels is None:
            marked = live.withColumn("label", F.col("row"))
        else:
            marked = stored(live.join(labels, live["row"] == labels["node"], "left").select("key", "row", F.coalesce("component", "row").alias("label")), "marked")
        center = F.min_by(F.struct("row", "label"), F.xxhash64("row") if turn else F.col("row"))
        apart = marked.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), center.alias("center")).where("lo <> hi")
        apart = stored(apart.select("key", F.col("center.row").alias("b"), F.col("center.label").alias("b_label")), "apart")
        if labels is not None and apart.isEmpty():
            break
        rest = marked.join(apart, "key")
        if turn < STARS:
            pairs = rest.where("label <> b_label").select(F.col("row").alias("a"), "b")
        else:
            sizes = rest.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
            rest = stored(rest.select("key", "row", "label").join(sizes, "key"), "rest")
            few = rest.where(F.col("n") <= FEW)
            other = few.select("key", F.col("row").alias("b"), F.col("label").alias("b_label"))
            pairs = few.join(other, "key").where("label < b_label").select(F.col("row").alias("a"), "b")
            met = _in_blocks(docs, nodes, rest.where(F.col("n") > FEW).select("key", "row", "label"), similarity, shingle, id_col, text_col)
        if labels is None:
            pairs = pairs.union(proposed)
        found = verified(docs, nodes, pairs, similarity, shingle, id_col, text_col)
        if met is not None:
            found = stored(found.union(met), "found")
        edges = found if edges is None else stored(edges.union(found), "edges")
        if labels is None or not found.isEmpty():
            labels = stored(connected_components(edges), "labels")
        if turn < STARS:
            live, old = stored(live.join(apart.select("key"), "key", "left_semi"), "live"), live
            release(old)
    return labels
