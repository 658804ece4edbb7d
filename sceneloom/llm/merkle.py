"""A Merkle manifest of a dataset, with a proof for every document.

Documents are the leaves of one tree per source, the trees' roots are the leaves of one more. Levels are built bottom up, runs of ``ARITY``
neighbours at a time. Proofs come by pointer jumping: a node first holds the siblings it needs to reach its parent; joining the
table with itself doubles the distance to the ancestor it points to and appends that ancestor's siblings to its own, until
all nodes point past the root. So a tree of depth d takes log2(d) joins. Leaves share what their run needs: only inner nodes jump, and
a run's leaves are folded where the run is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sceneloom.numbering import numbered_in_order
from sceneloom.shared import stored, with_lookup

ARITY = 16
#: The tree whose leaves are the roots of all sources.
TOP = -1
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
STEPS = "array<struct<left:binary,right:binary>>"


def _digest(parts: Column) -> Column:
    """SHA-256, as bytes, of digests (bytes, one after the other) written as lower-case hex."""
    return F.unhex(F.sha2(F.lower(F.hex(parts)).cast("binary"), 256))


def _hex(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def encoded(*values: Column) -> Column:
    """Values one after the other: ``-`` for null, else the bytes of the value in UTF-8, ``:``, the value."""
    texts = [v.cast("string") for v in values]
    return F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts])


def leaf_digest(doc_id: Column, source: Column, lang: Column, n_chars: Column, text: Column) -> Column:
    return F.unhex(F.sha2(encoded(doc_id, source, lang, n_chars, text).cast("binary"), 256))


def _joined(children: Column) -> Column:
    """The digests of nodes, one after the other."""
    return F.aggregate(children, F.lit(bytearray()), lambda acc, x: F.concat(acc, x["digest"]))


def _around(run: Column, at: Column) -> tuple[Column, Column]:
    """The digests to the left and to the right of number ``at`` in a run of digests."""
    return F.substring(run, F.lit(1), at * 32), F.substring(run, at * 32 + 33, F.lit(32 * ARITY))


def _node(tree: Column | str, level: int, at: Column | str) -> Column:
    return F.concat_ws("/", F.col(tree) if isinstance(tree, str) else tree, F.lit(level), F.col(at) if isinstance(at, str) else at)


def _parent_count(n: str) -> Column:
    return F.ceil(F.col(n) / F.lit(float(ARITY))).cast("long")


def _grow(nodes: DataFrame, level: int) -> tuple[list[DataFrame], DataFrame]:
    """Links ``node, up, left, right, sub`` to parents and the topmost nodes, from nodes ``tree, n, at, node, digest, sub`` of one level, ``n`` to a tree."""
    links: list[DataFrame] = []
    tops = nodes.where("n = 1")
    widest = nodes.agg(F.max("n")).first()[0] or 1
    while widest > 1:
        child = F.struct("at", "node", "digest", "sub")
        runs = nodes.where("n > 1").groupBy("tree", "n", F.floor(F.col("at") / ARITY).cast("long").alias("run")).agg(F.array_sort(F.collect_list(child)).alias("children"))
        level += 1
        runs = stored(runs.select("tree", _parent_count("n").alias("n"), "run", _node("tree", level, "run").alias("up"), "children", _joined(F.col("children")).alias("all")), "level")
        left, right = _around(F.col("all"), F.col("i"))
        links.append(runs.select("up", "all", F.posexplode("children").alias("i", "c")).select("c.node", "up", left.alias("left"), right.alias("right"), "c.sub"))
        nodes = runs.select("tree", "n", F.col("run").alias("at"), F.col("up").alias("node"), _digest(F.col("all")).alias("digest"), F.lit(None).cast("binary").alias("sub"))
        tops = tops.unionByName(nodes.where("n = 1"))
        widest = -(-widest // ARITY)
    return links, tops


def _jump(paths: DataFrame) -> DataFrame:
    """Let every node of ``node, up, steps, sub`` point past the root, with the steps to it and the root of its source on the way.

    Each turn joins the table with those of its nodes that others point to; their number falls by the arity to the power of the distance, so
    from some turn on they are few enough to be sent to all.
    """
    paths = stored(paths, "paths")
    while not (waiting := paths.where("up IS NOT NULL")).isEmpty():
        asked = waiting.select(F.col("up").alias("node")).distinct()
        nearer = with_lookup(paths, asked, ["node"], "left_semi")
        nearer = nearer.select(F.col("node").alias("up"), F.col("up").alias("far"), F.col("steps").alias("more"), F.col("sub").alias("above"))
        jumped = with_lookup(waiting, nearer, ["up"]).select("node", F.col("far").alias("up"), F.concat("steps", "more").alias("steps"), F.coalesce("sub", "above").alias("sub"))
        paths = stored(paths.where("up IS NULL").unionByName(jumped), "paths")
    return paths


def _fold(start: Column, steps: Column) -> Column:
    """The digest at the end of the steps from a node's digest."""
    return F.aggregate(steps, start, lambda acc, s: _digest(F.concat(s["left"], acc, s["right"])))


def manifest(leaves: DataFrame) -> DataFrame:
    """Proofs for ``leaves(doc_id, source, leaf, changed)``, digests as bytes: one row per leaf with ``doc_id, leaf, subroot, root,
    proof_sha256, folded_root, verified``, digests as hex.

    ``changed`` is the leaf as it is now where it may differ from the recorded one, else null; the proof is folded from it.
    Leaves of a source are ordered by ``doc_id``, null first; leaves of one id by their digest, which leaves the root the same in whatever
    order rows come. Equal leaves have proofs of their own. A null source is a source, ordered first. No leaves give an empty result.
    """
    leaves = stored(leaves, "leaves")
    placed = numbered_in_order(leaves, [F.col("source").asc_nulls_first(), F.col("doc_id").asc_nulls_first(), F.col("leaf"), F.col("changed")])
    placed = stored(placed, "placed")
    sources = placed.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("first"))
    sources = stored(numbered_in_order(stored(sources, "sources"), [F.col("first")], "tree"), "sources")
    rows = with_lookup(placed, sources, ["source"]).select("tree", "n", (F.col("place") - F.col("first")).alias("at"), "doc_id", "leaf", "changed")

    item = F.struct("at", F.col("leaf").alias("digest"), "changed", "doc_id")
    runs = rows.groupBy("tree", "n", F.floor(F.col("at") / ARITY).cast("long").alias("run")).agg(F.array_sort(F.collect_list(item)).alias("items"))
    many = F.col("n") > 1
    runs = stored(runs.select("tree", "n", "run", F.when(many, _node("tree", 1, "run")).otherwise(_node("tree", 0, "run")).alias("node"), "items", _joined(F.col("items")).alias("all")), "runs")

    own = F.when(many, _digest(F.col("all"))).otherwise(F.col("all"))
    first = runs.select("tree", _parent_count("n").alias("n"), F.col("run").alias("at"), "node", own.alias("digest"), F.lit(None).cast("binary").alias("sub"))
    links, subroots = _grow(first, 1)
    upper, roots = _grow(stored(subroots.select(
        F.lit(TOP).cast("long").alias("tree"), F.lit(sources.count()).cast("long").alias("n"), F.col("tree").alias("at"), "node", "digest", F.col("digest").alias("sub")), "subroots"), 0)
    roots = stored(roots, "root")
    root = roots.select("digest").first()
    step = F.array(F.struct("left", "right")).cast(STEPS)
    paths = roots.select("node", F.lit(None).cast("string").alias("up"), F.array().cast(STEPS).alias("steps"), "sub")
    for link in [*links, *upper]:
        paths = paths.unionByName(link.select("node", "up", step.alias("steps"), "sub"))
    paths = _jump(paths)

    way = F.aggregate("steps", F.lit(bytearray()), lambda acc, s: F.concat(acc, s["left"], s["right"]))
    whole = with_lookup(runs, paths, ["node"]).select("n", "items", "all", "steps", "sub", way.alias("way"))
    each = whole.select("n", "all", "steps", "sub", "way", F.posexplode("items").alias("i", "x"))
    left, right = _around(F.col("all"), F.col("i"))
    now = F.coalesce(F.col("x.changed"), F.col("x.digest"))
    each = each.select(
        F.col("x.doc_id").alias("doc_id"), F.col("x.digest").alias("leaf"), "sub",
        F.sha2(_hex(F.concat(F.when(many, F.concat(left, right)).otherwise(F.lit(bytearray())), F.col("way"))).cast("binary"), 256).alias("proof_sha256"),
        _hex(_fold(F.when(many, _digest(F.concat(left, now, right))).otherwise(now), F.col("steps"))).alias("folded_root"),
    )
    whole_root = F.lit(None if root is None else bytes(root[0]).hex()).cast("string")
    return each.select(
        "doc_id", _hex(F.col("leaf")).alias("leaf"), _hex(F.col("sub")).alias("subroot"), whole_root.alias("root"), "proof_sha256", "folded_root",
        (F.col("folded_root") == whole_root).alias("verified"),
    )


def tampered_leaves(docs: DataFrame, every: int = 5) -> DataFrame:
    """The leaves of ``documents``, and those whose id's CRC-32 is divisible by ``every`` as they are with A to Z lower-cased in the text.

    Null columns count as ``-``; a null id is never tampered with. Other columns are not read.
    """
    doc_id, source, lang, n_chars, text = (F.col(f"`{c}`") for c in ("doc_id", "source", "lang", "n_chars", "text"))
    chosen = F.crc32(doc_id.cast("string").cast("binary")) % every == 0
    changed = F.when(chosen, leaf_digest(doc_id, source, lang, n_chars, F.translate(text, UPPER, LOWER)))
    return docs.select(doc_id.alias("doc_id"), source.alias("source"), leaf_digest(doc_id, source, lang, n_chars, text).alias("leaf"), changed.alias("changed"))
