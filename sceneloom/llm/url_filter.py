"""URL filters: a list of host rules, and association rules mined from labelled pages.

Frequent combinations of URL tokens are mined with Spark's FP-growth; rules that say "bad" with enough
confidence and support are kept, and an inverted index on each rule's rarest token finds the rules that a
URL meets.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sceneloom.shared import stored, with_lookup

BAD = "label=bad"


@dataclass(frozen=True)
class HostRule:
    verdict: str
    host: str
    path: str


RULES = (
    HostRule("block", "net", "/"), HostRule("allow", "example.net", "/en/"), HostRule("block", "example.com", "/de/"), HostRule("allow", "org", "/fr/"),
)


@dataclass(frozen=True)
class Mining:
    """``support`` is the least part of labelled pages that meet a rule, with the label, and ``pages`` their least
    number, below which a rule would be chance; ``confidence`` the least part
    of the pages that meet its tokens and are bad; ``lift`` the least factor over the share of bad pages; ``tokens`` the most
    tokens of a rule. The number of rules is not bounded."""

    support: float = 0.005
    pages: int = 20
    confidence: float = 0.8
    lift: float = 1.5


def _lower_az(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A to Z lower-cased; else empty."""
    return F.coalesce(_lower_az(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def listed(host: Column, path: Column, rules: tuple[HostRule, ...] = RULES) -> Column:
    """Struct (rule, verdict) of the longest list rule that fits, null if none does; of equal lengths the first by name."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (len(r.host) + len(r.path), r.host + r.path)):
        fits = ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path))
        out = F.when(fits, F.struct(F.lit(r.host + r.path).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def url_tokens(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens: domain suffixes, path words and query names; numbers become one token."""
    labels = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat(F.lit("h:"), F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    words = F.filter(F.split(_lower_az(path), r"[^a-z0-9]+"), lambda w: w != "")
    words = F.transform(words, lambda w: F.concat(F.lit("p:"), F.when(w.rlike("^[0-9]+$"), F.lit("#")).otherwise(w)))
    names = F.transform(F.filter(F.split(F.regexp_extract(url, r"(?s)\?([^#]*)", 1), "&"), lambda q: q != ""), lambda q: F.concat(F.lit("q:"), F.substring_index(q, "=", 1)))
    return F.array_sort(F.array_distinct(F.concat(F.when(host != "", suffixes).otherwise(F.array().cast("array<string>")), words, names)))


def _as_one(cut: DataFrame) -> DataFrame:
    """``token, item``: tokens that stand in exactly the same rows of ``cut(__row, token)`` share the least of them as their item."""
    rows = F.col("__row")
    marks = [F.sum(F.xxhash64(rows, F.lit(i)).cast("decimal(38,0)")).alias(f"m{i}") for i in (1, 2)]
    where = stored(cut.groupBy("token").agg(F.count(F.lit(1)).alias("n"), *marks), "occurrences")
    least = where.groupBy("n", "m1", "m2").agg(F.min("token").alias("item"))
    return stored(where.join(least, ["n", "m1", "m2"]).select("token", "item"), "items")


def mine_rules(labelled: DataFrame, mining: Mining = Mining()) -> DataFrame:
    """``rule_id, tokens, confidence, support`` from ``labelled(tokens, bad)``.

    Tokens below the support are removed before mining, as no rule can hold them. Tokens that always come together (the labels
    of one host, say) are mined as one item, since sets of several of them say no more than one does, and a rule is given for each. Without labels of both
    kinds there are no rules; null labels count as not bad; repeated rows each count.
    """
    spark = labelled.sparkSession
    empty = spark.createDataFrame([], "rule_id string, tokens array<string>, confidence double, support double")
    rows = stored(labelled.select("tokens", "bad", F.monotonically_increasing_id().alias("__row")), "labelled")
    n, bad = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col("bad").cast("long")), F.lit(0))).first()
    if not n or not bad or bad == n:
        return empty
    support = max(mining.support, mining.pages / n)
    if support > 1:
        return empty
    frequent = rows.select(F.explode("tokens").alias("token"), "bad").groupBy("token").agg(F.sum(F.col("bad").cast("long")).alias("n")).where(F.col("n") >= support * n)
    frequent = stored(frequent.select("token"), "frequent")  # at most tokens-per-url / support rows
    cut = stored(with_lookup(rows.select("__row", F.explode("tokens").alias("token")), frequent, ["token"], "inner"), "tokens")
    items = _as_one(cut)
    sets = with_lookup(cut, items, ["token"]).groupBy("__row").agg(F.collect_set("item").alias("items"))
    sets = rows.select("__row", "bad").join(sets, "__row", "left").withColumn("items", F.coalesce("items", F.array().cast("array<string>")))
    sets = sets.select(F.when(F.col("bad"), F.concat("items", F.array(F.lit(BAD)))).otherwise(F.col("items")).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=mining.confidence).fit(sets)
    rules = model.associationRules.where((F.col("consequent")[0] == BAD) & (F.col("lift") >= mining.lift))
    rules = stored(rules.select(F.array_sort("antecedent").alias("tokens"), "confidence", "support"), "rules")
    # A rule is redundant if a shorter one whose tokens it contains is at least as confident. Each rule asks for its own
    # shorter token sets, so a token in many rules makes no pairs.
    parts = rules.select("tokens", "confidence", F.explode(_shorter(F.col("tokens"))).alias("part"))
    known = rules.select(F.col("tokens").alias("part"), F.col("confidence").alias("least"))
    redundant = stored(with_lookup(parts, known, ["part"], "inner").where(F.col("least") >= F.col("confidence")).select("tokens").distinct(), "redundant")
    rules = with_lookup(rules, redundant, ["tokens"], "left_anti").withColumn("said", F.array().cast("array<string>"))
    most = rules.agg(F.max(F.size("tokens"))).first()[0] or 0
    for k in range(most):  # each item of a rule becomes each of its tokens
        item = rules.withColumn("item", F.get("tokens", F.lit(k)))
        rules = with_lookup(item, items, ["item"]).withColumn("said", F.when(F.col("token").isNull(), F.col("said")).otherwise(F.concat("said", F.array("token")))).drop("item", "token")
    rules = rules.select(F.array_sort("said").alias("tokens"), "confidence", "support")
    return rules.select(F.array_join("tokens", " ").alias("rule_id"), "tokens", "confidence", "support")


def _shorter(tokens: Column) -> Column:
    """All proper, non-empty subsets of sorted tokens, each sorted."""
    def grown(sets: Column, token: Column) -> Column:
        return F.concat(sets, F.transform(sets, lambda s: F.concat(s, F.array(token))))

    sets = F.aggregate(tokens, F.array(F.array().cast("array<string>")), grown)
    return F.filter(sets, lambda s: (F.size(s) > 0) & (F.size(s) < F.size(tokens)))


def met_rules(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """``key, rule_id`` of the best rule each row of ``pages(key, tokens)`` meets, by inverted index.

    Every rule is listed under its rarest token only, so common tokens bring no candidates; candidates
    are verified against the whole token set.
    """
    seen = rules.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("uses"))
    index = rules.select("rule_id", "tokens", "confidence", "support", F.explode("tokens").alias("token")).join(seen, "token")
    index = index.groupBy("rule_id", "confidence", "support", F.col("tokens").alias("need")).agg(F.min(F.struct("uses", "token")).getField("token").alias("token"))
    hits = with_lookup(pages.select("key", F.col("tokens").alias("have"), F.explode("tokens").alias("token")), stored(index, "index"), ["token"], "inner")
    hits = hits.where(F.size(F.array_except("need", "have")) == 0)
    best = F.max_by("rule_id", F.struct("confidence", "support", "rule_id"))
    return hits.groupBy("key").agg(best.alias("rule_id"))


def judge_urls(pages: DataFrame, labels: DataFrame, mining: Mining = Mining(), rules: tuple[HostRule, ...] = RULES,
               id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per page: ``page_id, host, path, rule, verdict, mined_rule``.

    ``labels(page_id, bad)`` trains the mined rules. A list rule decides; without one a page is blocked if it
    meets a mined rule, else allowed. A very long url is judged whole. A null url, or one without ``://``, has empty host and path, meets no list
    rule and has no tokens: it is allowed. Labels of a page count once each; null ids match no label; repeated pages are
    each returned; an empty table gives an empty result; other columns are not read.

    Distinct token sets are judged, not pages, so a hot host is looked up once.
    """
    host, path = host_of(F.col(url_col)), path_of(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"), F.col(url_col).alias("url"))
    rows = rows.select("page_id", "host", "path", url_tokens(F.col("url"), F.col("host"), F.col("path")).alias("tokens"))
    rows = stored(rows, "urls")
    bad = labels.select(F.col("page_id").alias("__labelled"), F.col("bad").cast("boolean").alias("bad")).where("bad is not null")
    mined = stored(mine_rules(rows.join(bad, F.col("page_id") == F.col("__labelled")).select("tokens", "bad"), mining), "mined")
    marked = rows.withColumn("key", F.array_join("tokens", " "))
    met = met_rules(marked.select("key", "tokens").distinct(), mined)
    out = with_lookup(marked, stored(met.withColumnRenamed("rule_id", "mined_rule"), "met"), ["key"])
    by_list = listed(F.col("host"), F.col("path"), rules)
    return out.select(
        "page_id", "host", "path", by_list.alias("__by"), "mined_rule"
    ).select(
        "page_id", "host", "path", F.col("__by.rule").alias("rule"),
        F.coalesce(F.col("__by.verdict"), F.when(F.col("mined_rule").isNotNull(), F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"), "mined_rule",
    )
