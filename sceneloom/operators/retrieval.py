"""Retrieval of assets by text, vector and shape, and its audit."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sceneloom.numbering import numbered_in_order
from sceneloom.shared import stored

#: Words without meaning, words of style, synonyms, weights.
STOP = ("kit", "pack", "assets", "3d", "the", "a", "of", "and")
STYLE = (
    "red", "blue", "green", "yellow", "white", "black", "orange", "purple", "pink", "brown", "grey", "gray", "gold", "silver", "dark", "light",
    "a", "b", "c", "d", "e", "f", "g", "h", "i", "j", "k", "l", "m", "n", "large", "small", "wide", "narrow", "long", "short", "tall", "low", "high",
)
SYNONYMS = (
    ("bookshelf", "bookcase"), ("bookcase", "bookshelf"), ("sofa", "couch"), ("couch", "sofa"), ("rug", "carpet"), ("carpet", "rug"), ("cupboard", "cabinet"), ("cabinet", "cupboard"),
    ("mug", "cup"), ("cup", "mug"), ("tv", "television"), ("tv", "monitor"), ("television", "tv"), ("television", "monitor"), ("bin", "trash"), ("trash", "bin"), ("plant", "planter"), ("plant", "pot"),
    ("planter", "plant"), ("block", "cube"), ("block", "brick"), ("brick", "block"), ("cube", "block"), ("couchtable", "coffee"),
)
NAME, VARIANT, KIT, EXTRA, KIT_BONUS = 1.0, 0.85, 0.4, 0.12, 1.25


def tokenize(text: Column) -> Column:
    """Lower-case tokens: split at camel case, before digits and at anything else but letters and digits; stop words go."""
    spaced = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), "(?<=[a-z])(?=[A-Z])", " "), "(?<=[A-Za-z])(?=[0-9])", " ")
    return F.filter(F.transform(F.split(spaced, "[^A-Za-z0-9]+"), F.lower), lambda t: (t != "") & ~t.isin(*STOP))


def variants(token: Column) -> Column:
    """A token's accepted spellings besides itself: plural, singular, synonyms."""
    pairs = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in SYNONYMS])
    synonyms = F.transform(F.filter(pairs, lambda p: p["a"] == token), lambda p: p["b"])
    forms = F.array(
        F.concat(token, F.lit("s")), F.concat(token, F.lit("es")),
        F.when((F.length(token) > 3) & token.endswith("es"), F.regexp_replace(token, "es$", "")),
        F.when((F.length(token) > 2) & token.endswith("s"), F.regexp_replace(token, "s$", "")),
    )
    return F.array_except(F.array_distinct(F.concat(F.filter(forms, lambda f: f.isNotNull()), synonyms)), F.array(token))


def score_assets(queries: DataFrame, assets: DataFrame) -> DataFrame:
    """``query, asset_id, score`` of every asset that shares a word with a query; scores are rounded to four places.

    ``queries(query)`` are made distinct first; ``assets(asset_id, name, kit, kit_title)``. Query words and their variants meet an
    inverted table of asset words, so only assets with a hit are ever scored.
    """
    q = queries.select("query").distinct().withColumn("tokens", tokenize(F.col("query"))).where("size(tokens) > 0")
    words = q.select("query", F.posexplode("tokens").alias("at", "token"))
    asks = words.select("query", "at", F.col("token").alias("word"), F.lit(True).alias("exact")).unionByName(
        words.select("query", "at", F.explode(variants(F.col("token"))).alias("word"), F.lit(False).alias("exact"))
    )
    names = assets.select("asset_id", F.array_distinct(tokenize(F.col("name"))).alias("name_words"), "kit", F.array_distinct(F.concat(tokenize(F.col("kit_title")), tokenize(F.col("kit")))).alias("kit_words"))
    index = names.select("asset_id", F.explode("name_words").alias("word"), F.lit(True).alias("in_name")).unionByName(names.select("asset_id", F.explode("kit_words").alias("word"), F.lit(False).alias("in_name")))
    hits = asks.join(index, "word").withColumn(
        "w", F.when(F.col("in_name"), F.when(F.col("exact"), NAME).otherwise(VARIANT)).otherwise(F.when(F.col("exact"), KIT).otherwise(KIT * VARIANT))
    )
    per_token = hits.groupBy("query", "asset_id", "at").agg(F.max("w").alias("w"), F.max("in_name").alias("in_name"))
    sums = per_token.groupBy("query", "asset_id").agg(F.sum(F.round("w", 6)).alias("hit"), F.count_if("in_name").alias("in_name"))
    j = sums.join(q, "query").join(names, "asset_id")
    meaningful = F.size(F.filter("name_words", lambda t: ~t.isin(*STYLE) & ~t.rlike("^[0-9]+$")))
    score = F.col("hit") / F.size("tokens") / (1 + F.lit(EXTRA) * F.greatest(meaningful - F.col("in_name"), F.lit(0)))
    score = F.when(F.array_contains("tokens", F.col("kit")), score * KIT_BONUS).otherwise(score)
    return j.select("query", "asset_id", F.round(F.least(score, F.lit(1.0)), 4).alias("score")).where("score > 0")


def _query_forms(queries: DataFrame) -> DataFrame:
    """Distinct queries with their tokens and all spellings of each: ``query, tokens, forms`` (place of the token, word, exact)."""
    q = queries.select("query").distinct().withColumn("tokens", tokenize(F.col("query"))).where("size(tokens) > 0")
    form = lambda i, w, exact: F.struct(i.alias("at"), w.alias("word"), F.lit(exact).alias("exact"))
    one = F.transform("tokens", lambda t, i: F.concat(F.array(form(i, t, True)), F.transform(variants(t), lambda v: form(i, v, False))))
    return q.withColumn("forms", F.flatten(one))


def _final_score(hit: Column, tokens: Column, extra: Column, bonus: Column) -> Column:
    score = hit / tokens / (1 + F.lit(EXTRA) * F.greatest(extra, F.lit(0)))
    return F.round(F.least(F.when(bonus, score * KIT_BONUS).otherwise(score), F.lit(1.0)), 4)


class _Postings:
    """The inverted index of one block of assets: rows whose name, or whose kit, has a word; rows are in the order of ids."""

    def __init__(self, assets: list[dict]):
        assets.sort(key=lambda a: a["asset_id"])
        self.ids = np.array([a["asset_id"] for a in assets])
        self.meaningful = np.array([a["meaningful"] for a in assets], dtype=np.int64)
        lists: tuple[dict, dict, dict] = ({}, {}, {})
        for row, a in enumerate(assets):
            for found, words in zip(lists, (a["name_words"], a["kit_words"], [a["kit"]])):
                for w in words:
                    found.setdefault(w, []).append(row)
        self.name, self.kit, self.slug = ({w: np.array(rows) for w, rows in found.items()} for found in lists)

    def best(self, tokens: list[str], forms: list[dict], k: int, margin: float = 1e-4):
        """Rows that can be among the best ``k`` after rounding, with their sums; lists whose weights cannot lift a row to the k-th score are only
        looked up for rows that others brought in."""
        weights = []
        for at in range(len(tokens)):
            mine = [f for f in forms if f["at"] == at]
            named = [(self.name[f["word"]], NAME if f["exact"] else VARIANT) for f in mine if f["word"] in self.name]
            kits = [(self.kit[f["word"]], KIT if f["exact"] else KIT * VARIANT) for f in mine if f["word"] in self.kit]
            if named or kits:
                weights.append((max(w for _, w in named + kits), sum(len(r) for r, _ in named + kits), named, kits))
        weights.sort(key=lambda w: w[1])  # rarest first
        n = len(self.ids)
        hit, inside, known = np.zeros(n), np.zeros(n, dtype=np.int64), np.zeros(n, dtype=bool)
        rest = np.cumsum([w[0] for w in weights][::-1])[::-1] if weights else []
        bonus = np.zeros(n, dtype=bool)
        for t in set(tokens):
            if t in self.slug:
                bonus[self.slug[t]] = True
        least = -1.0
        for place, (_, _, named, kits) in enumerate(weights):
            # What only this list and the more frequent ones hold scores at most this.
            closed = min(rest[place] / len(tokens) * KIT_BONUS, 1.0) + margin < least
            w = np.zeros(n)
            for rows, value in kits + named:
                w[rows] = np.maximum(w[rows], value)
            touched = w > 0
            hit += np.round(w, 6)
            for rows in {id(r): r for r, _ in named}.values():
                touched[rows] = True
            there = np.zeros(n, dtype=bool)
            for rows, _ in named:
                there[rows] = True
            inside += there
            if not closed:
                known |= touched
                score = self._score(hit, inside, bonus, len(tokens))
                mine = score[known]
                least = float(np.partition(mine, len(mine) - k)[len(mine) - k]) if len(mine) >= k else -1.0
        rows = np.flatnonzero(known)
        score = self._score(hit, inside, bonus, len(tokens))[rows]
        rows, score = rows[score > 0], score[score > 0]
        if len(rows) > k:
            floor = np.partition(score, len(score) - k)[len(score) - k] - margin
            rows, score = rows[score >= floor], score[score >= floor]
            order = np.lexsort((rows, -score))
            rows, score = rows[order], score[order]
            first = np.r_[True, score[1:] != score[:-1]]
            nth = np.arange(len(rows)) - np.maximum.accumulate(np.where(first, np.arange(len(rows)), 0))
            rows = rows[nth < k]
        return rows, hit[rows], self.meaningful[rows] - inside[rows], bonus[rows]

    def _score(self, hit, inside, bonus, n_tokens):
        return np.minimum(hit / n_tokens / (1 + EXTRA * np.maximum(self.meaningful - inside, 0)) * np.where(bonus, KIT_BONUS, 1.0), 1.0)


def top_assets(queries: DataFrame, assets: DataFrame, k: int, query_block: int = 1024, asset_block: int = 16384) -> DataFrame:
    """``query, asset_id, score``: the ``k`` best assets of each query by ``score_assets`` (of equal scores the least ids), without scoring all pairs.

    Blocks of queries meet blocks of assets, both of bounded size. A block of assets is an inverted index; its lists are read from the rarest word on,
    and once the words left can't lift an asset to the k-th score they bring in no more assets. Only what can be among the best leaves a block.
    """
    q = stored(_query_forms(queries), "queries")
    meaningful = F.size(F.filter("name_words", lambda t: ~t.isin(*STYLE) & ~t.rlike("^[0-9]+$")))
    a = assets.select("asset_id", F.array_distinct(tokenize(F.col("name"))).alias("name_words"), "kit", F.array_distinct(F.concat(tokenize(F.col("kit_title")), tokenize(F.col("kit")))).alias("kit_words"))
    a = stored(a.withColumn("meaningful", meaningful), "assets")
    n_ask, n_block = max(1, -(-q.count() // query_block)), max(1, -(-a.count() // asset_block))
    blocks = a.groupBy(F.pmod(F.xxhash64("asset_id"), F.lit(n_block)).alias("block")).agg(F.collect_list(F.struct("asset_id", "name_words", "kit", "kit_words", "meaningful")).alias("assets"))
    asks = q.groupBy(F.pmod(F.xxhash64("query"), F.lit(n_ask)).alias("ask")).agg(F.collect_list(F.struct("query", "tokens", "forms")).alias("queries"))
    pairs = asks.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_block - 1)).cast("array<bigint>"))).join(blocks, "block").select("queries", "assets")
    names = ("query", "asset_id", "hit", "n", "extra", "bonus")
    kind = assets.schema["asset_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for queries_, assets_ in zip(batch.column(0), batch.column(1)):
                index = _Postings(assets_.as_py())
                out: list[tuple] = []
                for x in queries_.as_py():
                    rows, hit, extra, bonus = index.best(x["tokens"], x["forms"], k)
                    out += zip([x["query"]] * len(rows), index.ids[rows].tolist(), hit.tolist(), [len(x["tokens"])] * len(rows), extra.tolist(), bonus.tolist())
                types = (pa.string(), None, pa.float64(), pa.int32(), pa.int64(), pa.bool_())
                ids = batch.schema.field(1).type.value_type.field("asset_id").type
                yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], ids if t is None else t) for i, t in enumerate(types)], names=list(names))

    found = pairs.mapInArrow(run, f"query string, asset_id {kind}, hit double, n int, extra long, bonus boolean")
    found = found.select("query", "asset_id", _final_score(F.col("hit"), F.col("n"), F.col("extra"), F.col("bonus")).alias("score")).where("score > 0")
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "asset_id"))
    return found.withColumn("__r", place).where(F.col("__r") <= k).drop("__r")


def retrieve(scored: DataFrame, images: DataFrame | None, k: int = 5, image_weight: float = 0.5, shortlist: int = 24, keys: tuple[str, ...] = ("query",)) -> DataFrame:
    """The k best assets a query with their text score and rank. Text decides who is in; images only reorder the shortlist."""
    by = Window.partitionBy(*keys)
    rows = scored.withColumn("__r", F.row_number().over(by.orderBy(F.desc("score"), "asset_id")))
    if images is not None:
        rows = rows.join(images, [*keys, "asset_id"], "left")
        blend = (1 - image_weight) * F.col("score") + image_weight * F.coalesce("image", F.lit(0.0))
        rows = rows.withColumn("__late", (F.col("__r") > shortlist).cast("int"))
        order = by.orderBy("__late", F.when(F.col("__late") == 0, -blend).otherwise(F.col("__r").cast("double")), "asset_id")
        rows = rows.withColumn("__r", F.row_number().over(order))
    return rows.where(F.col("__r") <= k).select(*keys, "asset_id", "score", F.col("__r").alias("rank"))


def _view_blocks(queries: DataFrame, views: DataFrame, query_block: int, view_block: int) -> DataFrame:
    """Blocks of queries dealt to blocks of views, both of bounded size; all views of an asset lie in one block."""
    n_ask, n_view = max(1, -(-queries.count() // query_block)), max(1, -(-views.count() // view_block))
    blocks = views.groupBy(F.pmod(F.xxhash64("asset_id"), F.lit(n_view)).alias("block")).agg(F.collect_list(F.struct("asset_id", "vec")).alias("views"))
    more = [c for c in queries.columns if c not in ("query_id", "vec")]
    asks = queries.groupBy(F.pmod(F.xxhash64("query_id"), F.lit(n_ask)).alias("ask")).agg(F.collect_list(F.struct("query_id", "vec", *more)).alias("queries"))
    return asks.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_view - 1)).cast("array<bigint>"))).join(blocks, "block").select("queries", "views")


def _unit(rows: list[dict]) -> np.ndarray:
    m = np.array([r["vec"] for r in rows], dtype=np.float64)
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)


def _best_by_asset(asks: list[dict], views: list[dict]) -> tuple[np.ndarray, np.ndarray]:
    """Asset ids, and the best cosine of each query to each asset's views: negative ones zero, four places."""
    views.sort(key=lambda r: r["asset_id"])
    ids = np.array([r["asset_id"] for r in views])
    starts = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
    best = np.maximum.reduceat(np.maximum(_unit(asks) @ _unit(views).T, 0.0), starts, axis=1)
    return ids[starts], np.round(best, 4)


def view_scores(queries: DataFrame, views: DataFrame, k: int | None = None, query_block: int = 512, view_block: int = 4096) -> DataFrame:
    """``query_id, asset_id, score``: best cosine over an asset's views, negative ones zero, four places; with ``k`` a query's best k
    assets only (of equal scores the least id).

    ``queries(query_id, vec)``, ``views(asset_id, view_id, vec)``. Both sides are packed into blocks of bounded size, as many as their
    counts ask for; each block of queries meets each block of views in one matrix product, and only the best per asset, or the k best, leave it.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for asks, views_ in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids, best = _best_by_asset(asks, views_)
                take = np.tile(np.arange(len(ids)), (len(asks), 1))
                if k is not None and k < len(ids):
                    take = np.stack([np.lexsort((ids, -row))[:k] for row in best])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat([r["query_id"] for r in asks], take.shape[1])), pa.array(ids[take].ravel()), pa.array(np.take_along_axis(best, take, 1).ravel())], names=["query_id", "asset_id", "score"]
                )

    found = _view_blocks(queries, views, query_block, view_block).mapInArrow(run, "query_id long, asset_id long, score double")
    if k is None:
        return found
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "asset_id"))
    return found.withColumn("__r", place).where(F.col("__r") <= k).drop("__r")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def normalised(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double") / F.greatest(F.sqrt(dot(v, v)), F.lit(1e-12)))


def leave_one_view_out(views: DataFrame) -> DataFrame:
    """Rank of each asset when its first view is the query and is hidden: 1 + the assets that score higher, and its own score.

    An asset's own score comes from its own views; blocks of the rest only say how many assets beat it, so a query leaves a block
    as one row. Assets with a single view have no score of their own and no rank.
    """
    first = Window.partitionBy("asset_id").orderBy("view_id")
    numbered = views.withColumn("__n", F.row_number().over(first))
    queries = numbered.where("__n = 1").select(F.col("asset_id").alias("query_id"), "vec")
    rest = numbered.where("__n > 1").select("asset_id", "view_id", "vec")
    pairs = queries.join(rest.select(F.col("asset_id").alias("query_id"), F.col("vec").alias("__v")), "query_id")

    def owns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = (_unit([{"vec": v} for v in batch.column(i).to_pylist()]) for i in (1, 2))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.round(np.maximum((a * b).sum(1), 0.0), 4))], names=["query_id", "own"])

    own = pairs.select("query_id", "vec", "__v").mapInArrow(owns, "query_id long, own double").groupBy("query_id").agg(F.max("own").alias("own"))
    asked = queries.join(own, "query_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for asks, views_ in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids, best = _best_by_asset(asks, views_)
                mine = np.array([r["query_id"] for r in asks])
                limit = np.array([r["own"] for r in asks])
                above = ((best > limit[:, None]) & (ids[None, :] != mine[:, None])).sum(1)
                yield pa.RecordBatch.from_arrays([pa.array(mine), pa.array(limit), pa.array(above.astype(np.int64))], names=["query_id", "own", "above"])

    counts = _view_blocks(asked, rest, 512, 4096).mapInArrow(run, "query_id long, own double, above long")
    return counts.groupBy("query_id").agg((F.sum("above") + 1).alias("rank"), F.max("own").alias("own"))


def self_match(ranks: DataFrame) -> DataFrame:
    """One row on ``leave_one_view_out``: assets, median and quartile ranks, and the shares at rank 1 and up to 64. Ranks are counted
    first."""
    counted = ranks.groupBy("rank").agg(F.count(F.lit(1)).alias("n"))
    share = lambda k: F.sum(F.when(F.col("rank") <= k, F.col("n")).otherwise(0)) / F.sum("n")
    q = F.expr("percentile(rank, array(0.25D, 0.5D, 0.75D), n)")
    out = counted.agg(F.sum("n").alias("assets"), q.alias("__q"), share(1).alias("top1"), share(64).alias("top64"))
    return out.select("assets", *[F.col("__q")[i].alias(c) for i, c in enumerate(("q1", "median", "q3"))], "top1", "top64")


def shape_rerank(hits: DataFrame, observed: DataFrame, shapes: DataFrame, weight: float = 0.5, keys: tuple[str, ...] = ("query",)) -> DataFrame:
    """Hits reordered by text (relative to the best) and likeness of edge ratios; a missing shape counts as distance one.

    ``observed(keys, ratios)``, ``shapes(asset_id, ratios)``. Single hits stay.
    """
    by = Window.partitionBy(*keys)
    j = hits.join(observed.withColumnRenamed("ratios", "__o"), list(keys), "left").join(shapes.withColumnRenamed("ratios", "__s"), "asset_id", "left")
    far = F.coalesce(F.aggregate(F.zip_with("__o", "__s", lambda a, b: F.abs(a - b)), F.lit(0.0), lambda s, x: s + x) / 3, F.lit(1.0))
    blend = (1 - weight) * F.col("score") / F.max("score").over(by) + weight * (1 - far)
    j = j.withColumn("blend", F.round(F.when((F.count(F.lit(1)).over(by) >= 2) & F.col("__o").isNotNull(), blend).otherwise(F.col("score")), 6))
    return j.withColumn("rank", F.row_number().over(by.orderBy(F.desc("blend"), "asset_id"))).select(*keys, "asset_id", "score", "blend", "rank")


def best_observation(observations: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The observation of each object with the largest box (``x1, y1, x2, y2``), the first of equal ones; those without a box do not count."""
    area = F.greatest(F.col("x2") - F.col("x1"), F.lit(0.0)) * F.greatest(F.col("y2") - F.col("y1"), F.lit(0.0))
    rows = observations.where("x1 IS NOT NULL AND y1 IS NOT NULL AND x2 IS NOT NULL AND y2 IS NOT NULL").withColumn("area", area)
    first = F.min(F.struct((F.lit(0.0) - F.col("area")).alias("__a"), *order, *[c for c in rows.columns if c not in (*keys, *order)])).alias("__m")
    return rows.groupBy(*keys).agg(first).select(*keys, *[F.col(f"__m.{c}").alias(c) for c in rows.columns if c not in keys])


def choose_assets(hits: DataFrame, least: float = 0.45, keys: tuple[str, ...] = ("query",)) -> DataFrame:
    """The first hit if its text score suffices, else none, with the reason; candidates are counted."""
    out = hits.groupBy(*keys).agg(F.min_by("asset_id", "rank").alias("__a"), F.min_by("score", "rank").alias("score"), F.count(F.lit(1)).alias("candidates"))
    ok = F.col("score") >= least
    return out.select(*keys, F.when(ok, F.col("__a").cast("string")).alias("chosen"), "score", "candidates", F.when(ok, "accepted").otherwise("below_threshold").alias("reason"))


def asset_edge_ratios(points: DataFrame, key: str, least: int = 20) -> DataFrame:
    """Sorted edges of the points' box, divided by the longest, of assets with enough points."""
    box = points.groupBy(key).agg(F.count(F.lit(1)).alias("n"), *[(F.max(c) - F.min(c)).alias(f"e{c}") for c in "xyz"]).where(F.col("n") >= least)
    edges = F.reverse(F.array_sort(F.array("ex", "ey", "ez")))
    return box.where(edges[0] > 0).select(key, F.transform(edges, lambda e: F.round(e / edges[0], 4)).alias("ratios"))


def best_truth_rank(ranked: DataFrame, truths: DataFrame, keys: list[str]) -> DataFrame:
    """Best rank of any true asset of each clip's queries."""
    return ranked.join(truths, [*keys, "asset_id"], "left_semi").groupBy(*keys).agg(F.min("rank").alias("best_rank"))


def size_matched_null(truths: DataFrame, clip: str, asset: str = "asset_id") -> DataFrame:
    """For each clip as many assets as it has truths, taken from the clip after it in the order of hashes (the last takes the first's), by hash order.

    A clip whose donor has fewer gets fewer: ``wanted`` and ``given`` tell. Clips are numbered by a range-partitioned sort.
    """
    own = truths.select(clip, asset).distinct()
    sizes = own.groupBy(clip).agg(F.count(F.lit(1)).alias("wanted"))
    placed = numbered_in_order(sizes, [F.xxhash64(clip), F.col(clip)], "__i")
    n = placed.count()
    donor = placed.select(F.col(clip).alias("__donor"), F.pmod(F.col("__i") - 1, F.lit(n)).alias("__i"))
    pairs = placed.join(donor, "__i").select(clip, "wanted", "__donor")
    dealt = pairs.join(own.select(F.col(clip).alias("__donor"), F.col(asset)), "__donor")
    nth = F.row_number().over(Window.partitionBy(clip).orderBy(F.xxhash64(asset), asset))
    kept = dealt.withColumn("__n", nth).where(F.col("__n") <= F.col("wanted"))
    return kept.select(clip, asset, "wanted", F.count(F.lit(1)).over(Window.partitionBy(clip)).alias("given"))


def union_budget(first: DataFrame, second: DataFrame, truths: DataFrame, keys: list[str], budget: int) -> DataFrame:
    """Whether a truth is among ``budget`` assets of either ranking alone, or among as many of both, half each: one row per query.

    Rankings are ``(keys, asset_id, rank)``; assets that both halves hold count once, so the joint list may be shorter.
    """
    def best(ranked: DataFrame, into: str) -> DataFrame:
        return best_truth_rank(ranked, truths, keys).withColumnRenamed("best_rank", into)

    asked = first.select(*keys).union(second.select(*keys)).distinct()
    out = asked.join(best(first, "__f"), keys, "left").join(best(second, "__s"), keys, "left")
    within = lambda c, k: F.coalesce(F.col(c) <= k, F.lit(False))
    return out.select(*keys, within("__f", budget).alias("first"), within("__s", budget).alias("second"), (within("__f", budget // 2) | within("__s", budget - budget // 2)).alias("both"))


def coverage_at(ranks: DataFrame, ks: list[int]) -> DataFrame:
    """Share of rows whose rank is at most k, for each k; a missing rank covers nothing."""
    table = F.explode(F.array(*[F.lit(k) for k in ks]))
    return ranks.withColumn("k", table).groupBy("k").agg(F.avg(F.coalesce((F.col("best_rank") <= F.col("k")).cast("double"), F.lit(0.0))).alias("coverage"), F.count(F.lit(1)).alias("n"))


def hit_rate_by_bins(rows: DataFrame, score: str, hit: str, ties: list[str], bins: int = 4, least: int = 20) -> DataFrame:
    """Hits by equal-count bins of the score (bin i holds ranks from i*n div bins), and the top bin's lift.

    Ranks come from a range-partitioned sort, so no task sees all rows, nor all rows of one score; equal scores are ordered by
    ``ties``. Nothing below ``least`` rows.
    """
    n = rows.count()
    if n < least:
        return rows.sparkSession.createDataFrame([], "bin int, n long, hits long, rate double, lift double")
    ranked = numbered_in_order(rows.select(score, hit, *[c for c in ties if c not in (score, hit)]), [F.col(score), *[F.col(c) for c in ties]], "__i").withColumn("__rn", F.col("__i") + 1)
    bin_ = F.floor((F.col("__rn") * bins + n - 1) / F.lit(n)) - 1
    out = ranked.groupBy(bin_.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(hit).cast("long")).alias("hits"))
    out = out.withColumn("rate", F.col("hits") / F.col("n"))
    base = F.sum("hits").over(Window.partitionBy(F.lit(1))) / F.sum("n").over(Window.partitionBy(F.lit(1)))
    return out.withColumn("lift", F.when(base > 0, F.col("rate") / base))


def phrase_votes(ranked: DataFrame, phrases: DataFrame, clip: str, patch: str, top: int = 5, most: int = 8) -> DataFrame:
    """Each patch votes for the phrase of the first of its top assets that has one of two or more words; the clip's most voted phrases."""
    good = phrases.where(F.size(tokenize(F.col("phrase"))) >= 2)
    votes = ranked.where(F.col("rank") <= top).join(good, "asset_id").groupBy(clip, patch).agg(F.min_by("phrase", "rank").alias("phrase"))
    counted = votes.groupBy(clip, "phrase").agg(F.count(F.lit(1)).alias("votes"))
    return counted.withColumn("place", F.row_number().over(Window.partitionBy(clip).orderBy(F.desc("votes"), "phrase"))).where(F.col("place") <= most)


def name_agreement(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Share of rows whose two names share a token."""
    return rows.agg(F.avg(F.arrays_overlap(tokenize(F.col(a)), tokenize(F.col(b))).cast("double")).alias("agreement"), F.count(F.lit(1)).alias("n"))


def likeness(frames: DataFrame, clip: str, order: str, vec: str, other: str) -> DataFrame:
    """Median cosine of paired frames against two yardsticks: adjacent frames of the clip, and the floor of unrelated pairs.

    ``frames(clip, order, vec, other)``: other is the paired rendering. The unrelated pairs are neighbours half a clip apart.
    """
    by = Window.partitionBy(clip)
    o = by.orderBy(order)
    rows = frames.withColumns({"__a": normalised(F.col(vec)), "__b": normalised(F.col(other)), "__i": F.row_number().over(o) - 1, "__n": F.count(F.lit(1)).over(by)})
    rows = rows.withColumn("__p", F.lag("__a").over(o))
    far = rows.select(clip, (F.col("__i") + F.floor(F.col("__n") / 2)).alias("__i"), F.col("__a").alias("__f"))
    j = rows.join(far, [clip, "__i"], "left")
    m = lambda x: F.percentile(x, F.lit(0.5))
    out = j.groupBy(clip).agg(m(dot(F.col("__a"), F.col("__b"))).alias("paired"), m(dot(F.col("__a"), F.col("__p"))).alias("self"), m(dot(F.col("__a"), F.col("__f"))).alias("floor"))
    return out.withColumn("normalised", F.when(F.abs(F.col("self") - F.col("floor")) > 1e-9, (F.col("paired") - F.col("floor")) / (F.col("self") - F.col("floor"))))


def observed_ratios(boxes: DataFrame, keys: list[str]) -> DataFrame:
    """Edge ratios of each object's median box size."""
    m = boxes.groupBy(*keys).agg(*[F.percentile(c, F.lit(0.5)).alias(c) for c in ("ex", "ey", "ez")])
    edges = F.reverse(F.array_sort(F.array("ex", "ey", "ez")))
    return m.where(edges[0] > 0).select(*keys, F.transform(edges, lambda e: e / edges[0]).alias("ratios"))


def choice_audit(chosen: DataFrame, truths: DataFrame, keys: list[str]) -> DataFrame:
    """Of choices that are no fallback: share with a true asset, with an asset of a true kit, and mean distance of shape to the nearest truth.

    ``chosen(keys, asset_id, kit, ratios)``, ``truths(keys, true_id, true_kit, true_ratios)``: the clip's truths are a set.
    """
    j = chosen.join(truths, keys)
    far = F.aggregate(F.zip_with("ratios", "true_ratios", lambda a, b: F.abs(a - b)), F.lit(0.0), lambda s, x: s + x) / 3
    per = j.groupBy(*keys, "asset_id").agg(F.bool_or(F.col("asset_id") == F.col("true_id")).alias("exact"), F.bool_or(F.col("kit") == F.col("true_kit")).alias("kit"), F.min(far).alias("far"))
    return per.agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("exact").cast("double")).alias("exact"), F.avg(F.col("kit").cast("double")).alias("same_kit"), F.avg("far").alias("shape_distance"))


def name_words(text: Column) -> Column:
    """Distinct lower-case words of letters and digits; nothing is stopped or split further."""
    return F.array_distinct(F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+"), lambda w: w != ""))


def name_arms(objects: DataFrame, ranked: DataFrame, assets: DataFrame, keys: list[str], top: int = 5) -> DataFrame:
    """How often an object's true class shares a word with its detector's phrase, with its nearest asset, and with any of its best ``top``.

    ``objects(keys, truth, phrase)``, ``ranked(keys, asset_id, rank)``, ``assets(asset_id, name, kit)``. One row: ``n, phrase, nearest, top``
    (shares; null without objects). An object without known assets counts as missed.
    """
    hits = ranked.where(F.col("rank") <= top).join(assets.select("asset_id", F.array_union(name_words(F.col("name")), name_words(F.col("kit"))).alias("__words")), "asset_id")
    j = objects.select(*keys, name_words(F.col("truth")).alias("__truth"), name_words(F.col("phrase")).alias("__phrase")).join(hits, keys, "left")
    same = lambda c: F.coalesce(F.arrays_overlap("__truth", c), F.lit(False))
    per = j.groupBy(*keys).agg(F.bool_or(same("__phrase")).alias("phrase"), F.bool_or(same("__words") & (F.col("rank") == 1)).alias("nearest"), F.bool_or(same("__words")).alias("top"))
    share = lambda c: F.avg(F.coalesce(F.col(c), F.lit(False)).cast("double")).alias(c)
    return per.agg(F.count(F.lit(1)).alias("n"), share("phrase"), share("nearest"), share("top"))
