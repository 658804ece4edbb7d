"""Secret scans (native): fixed patterns, and character Markov models for the rest.

Two character models, of random strings and of ordinary identifiers, are trained from labelled samples. A
token is a secret if the log-likelihood ratio of the models, per character, is high enough.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sceneloom.llm.spans import apart_from, find_spans, joined, labelled
from sceneloom.shared import stored

#: Java spelling of the base patterns: possessive where nothing is ever given back, so that long texts
#: cost linear time and no stack.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?+\x20*+[:=]\x20*+["']?+([A-Za-z0-9+/_.=-]++)"""
ACCESS = r"AKIA[A-Z0-9]{14,}+"
HEX = r"[0-9a-f]{16,}+"
#: What the models judge, and what ordinary samples look like.
TOKEN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}+"
ORDINARY = r"(?<![A-Za-z0-9+/_=-])[A-Z]?[a-z]{4,}+(?:[_-][a-z]{2,}+)*+(?![A-Za-z0-9+/_=-])"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"


@dataclass(frozen=True)
class MarkovParams:
    """``samples`` bounds the labelled tokens of each class that train a model (those of least hash), and
    ``per_document`` the ordinary ones that a document offers; ``threshold`` is the mean log-likelihood ratio in nats per
    character; ``prior`` is added to the count of each character and ``backoff`` is the weight of single characters
    against counted transitions."""

    samples: int = 20_000
    per_document: int = 4
    threshold: float = 0.5
    prior: float = 0.5
    backoff: float = 5.0


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", params: MarkovParams = MarkovParams()) -> DataFrame:
    """``doc_id``, base spans ``assign, access, hex``, unjudged ``tokens`` and ``ordinary`` samples. One pass over the texts."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    t = F.col("text")
    assign = F.filter(find_spans(t, ASSIGN, t.contains(":") | t.contains("=")), lambda s: F.length(F.regexp_extract(s["hit"], ASSIGN, 1)) >= 12)
    return base.select(
        "doc_id", assign.alias("assign"), find_spans(t, ACCESS, t.contains("AKIA")).alias("access"),
        find_spans(t, HEX, t.rlike("[0-9a-f]{16}")).alias("hex"), find_spans(t, TOKEN, t.rlike("[A-Za-z0-9+/_=-]{20}")).alias("tokens"),
        F.slice(F.regexp_extract_all(t, F.lit(ORDINARY), F.lit(0)), 1, params.per_document).alias("ordinary"),
    )


def weak_labels(scanned: DataFrame) -> DataFrame:
    """Labelled samples ``(token, random)`` from a scan: what the fixed patterns found, and plain words."""
    values = F.concat(
        F.transform("assign", lambda s: F.regexp_extract(s["hit"], ASSIGN, 1)), F.transform("access", lambda s: s["hit"]),
        F.transform("hex", lambda s: s["hit"]),
    )
    found = scanned.select(F.explode(values).alias("token"), F.lit(True).alias("random"))
    plain = scanned.select(F.explode("ordinary").alias("token"), F.lit(False).alias("random"))
    return found.union(plain)


def train(samples: DataFrame, params: MarkovParams = MarkovParams()) -> list[float]:
    """Log-likelihood ratios of all transitions, flat: row is the character before (last: none), column the next.

    ``samples`` has ``token`` and ``random``. At most ``params.samples`` distinct tokens a class are used, those
    of least hash, so that the same samples give the same model. Only the table of transition counts,
    whose size is fixed by the alphabet, reaches the driver.
    """
    parts = []
    for kind in (True, False):
        own = samples.where(F.col("random") == kind).select("token").distinct()
        parts.append(own.orderBy(F.xxhash64("token"), "token").limit(params.samples).withColumn("random", F.lit(kind)))
    size = len(ALPHABET)
    chars = F.filter(F.split("token", ""), lambda c: F.length(c) > 0)
    codes = parts[0].union(parts[1]).select("random", F.transform(chars, lambda c: F.call_function("instr", F.lit(ALPHABET), c) - 1).alias("codes"))
    codes = codes.withColumn("codes", F.filter("codes", lambda i: i >= 0)).where("size(codes) > 0")
    steps = F.transform("codes", lambda c, i: F.struct(F.when(i > 0, F.get(F.col("codes"), i - 1)).otherwise(F.lit(size)).alias("a"), c.alias("b")))
    counts = codes.select("random", F.explode(steps).alias("s")).groupBy("random", "s.a", "s.b").count().collect()
    table = {kind: [[0.0] * size for _ in range(size + 1)] for kind in (True, False)}
    for r in counts:
        table[r["random"]][r["a"]][r["b"]] += r["count"]

    def logs(kind: bool) -> list[float]:
        """Transitions, backed off to single characters so that an unseen character is rare after any other."""
        cells = table[kind]
        single = [sum(row[b] for row in cells) + params.prior for b in range(size)]
        whole = sum(single)
        return [math.log((row[b] + params.backoff * single[b] / whole) / (sum(row) + params.backoff)) for row in cells for b in range(size)]

    return [x - y for x, y in zip(logs(True), logs(False))]


def llr(token: Column, model: list[float]) -> Column:
    """Mean log-likelihood ratio per character of a token whose characters are all in the alphabet."""
    size = len(ALPHABET)
    ratios = F.split(F.lit(",".join(repr(x) for x in model)), ",").cast("array<double>")
    codes = F.filter(F.transform(F.split(token, ""), lambda c: F.call_function("instr", F.lit(ALPHABET), c) - 1), lambda i: i >= 0)
    start = F.struct(F.lit(size).alias("a"), F.lit(0.0).alias("sum"))
    total = F.aggregate(
        codes, start, lambda acc, c: F.struct(c.alias("a"), (acc["sum"] + F.coalesce(F.get(ratios, acc["a"] * size + c), F.lit(0.0))).alias("sum")),
        lambda acc: acc["sum"],
    )
    return total / F.greatest(F.length(token), F.lit(1))


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", params: MarkovParams = MarkovParams(),
                 samples: DataFrame | None = None) -> DataFrame:
    """One row per document: ``doc_id, assign, access, hex, markov`` (arrays of spans: start, end, hit).

    ``samples(token, random)`` trains the models; without it the scan labels its own. Markov spans are tokens of
    20 or more characters that no base span touches. Places are code points, ends exclusive. Null text
    counts as empty; null and repeated ids are each returned; an empty table gives an empty result and
    trains nothing; other columns are not read. Long texts with many hits cost little more than in proportion.
    """
    scanned = stored(scan(docs, id_col, text_col, params), "secrets")
    model = train(weak_labels(scanned) if samples is None else samples, params)
    taken = F.concat("assign", "access", "hex")
    markov = apart_from(F.filter("tokens", lambda s: llr(s["hit"], model) > params.threshold), taken)
    return scanned.select("doc_id", "assign", "access", "hex", markov.alias("markov"))


def digest(found: DataFrame) -> DataFrame:
    """``doc_id``, counts, ``base_sha256`` and ``spans`` of the result of ``find_secrets``."""
    base = F.concat(labelled(F.col("assign"), 0, "assign"), labelled(F.col("access"), 1, "access"), labelled(F.col("hex"), 2, "hex"))
    order = ("start", "rank", "end")
    return found.select(
        "doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in ("assign", "access", "hex")],
        F.sha2(joined(base, order).cast("binary"), 256).alias("base_sha256"),
        joined(F.concat(base, labelled(F.col("markov"), 3, "markov")), order).alias("spans"),
    )
