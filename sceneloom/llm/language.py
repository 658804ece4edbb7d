"""Language identification that lets a document mix languages.

A language is a smoothed distribution over buckets of letter trigrams, counted over all labelled documents. A document is a mixture of languages;
expectation-maximisation finds the proportions that make its trigrams likeliest. The set of languages grows from the likeliest
single one, and a further language enters only if it raises the log-likelihood by more than it costs. The log-likelihood is concave in the
proportions, so its slope where a language enters bounds what the language can bring; most documents need no further look.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NO_LETTER = regex.compile(r"\P{L}+")
#: Letters of one piece of a long text.
PIECE = 1 << 21


@dataclass(frozen=True)
class LanguageParams:
    """``buckets`` (a power of two) bounds the model: it has that many numbers for each language. ``smooth`` is added to every count.
    Neighbouring trigrams share letters, so log-likelihoods are divided by ``overlap``; a further language costs ``cost`` times half the logarithm
    of the number of trigrams, and a proportion below ``least`` is no language of the document. ``model_bytes`` is the most that is sent to
    executors; languages beyond it take fewer buckets each."""

    buckets: int = 1 << 16
    smooth: float = 0.05
    overlap: float = 3.0
    cost: float = 4.0
    least: float = 0.05
    rounds: int = 40
    cells: int = 1 << 23
    model_bytes: int = 256_000_000


def trigrams(text: str, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the letter trigrams of a text and how often each occurs; words are lower-cased and a space stands on both sides of each.

    Long texts are read in pieces and summed, so that memory is bounded by the buckets.
    """
    letters = NO_LETTER.sub(" ", text).lower().strip()
    if not letters:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    shift = np.uint32(32 - (buckets.bit_length() - 1))
    whole = np.zeros(buckets, dtype=np.int64) if len(letters) > PIECE else None
    found = np.empty(0, dtype=np.int64)
    padded = f" {letters} "
    for at in range(0, len(padded) - 2, PIECE):
        codes = np.frombuffer(padded[at : at + PIECE + 2].encode("utf-32-le"), dtype="<u4")
        h = (codes[:-2] * np.uint32(0x01000193) + codes[1:-1]) * np.uint32(0x01000193) + codes[2:]
        found = ((h * np.uint32(0x9E3779B1)) >> shift).astype(np.int64)
        if whole is not None:
            whole += np.bincount(found, minlength=buckets)
    if whole is not None:
        found = np.flatnonzero(whole)
        return found, whole[found]
    return np.unique(found, return_counts=True)


def _count(buckets: int):
    """Sum the trigrams of a task's documents (lang, text) by language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}

        def rows() -> Iterator[pa.RecordBatch]:
            for lang, total in sums.items():
                at = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(total[at])], names=["lang", "bucket", "n"])

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                found, n = trigrams(text.as_py() or "", buckets)
                if lang not in sums and len(sums) == 64:
                    yield from rows()
                    sums.clear()
                sums.setdefault(lang, np.zeros(buckets, dtype=np.int64))[found] += n
        yield from rows()

    return run


def learn(labelled: DataFrame, params: LanguageParams = LanguageParams()) -> tuple[list[str], np.ndarray]:
    """Languages in code point order and their log-probabilities, a row for each bucket, from all of ``labelled(lang, text)``.

    Counts are summed by task, then by Spark; what reaches the driver has at most ``buckets`` rows a language. Languages without a letter are
    not learned.
    """
    n_langs = labelled.select("lang").distinct().count()
    buckets = params.buckets
    while buckets > 1024 and n_langs * buckets * 4 > params.model_bytes:
        buckets //= 2
    counted = labelled.select("lang", "text").mapInArrow(_count(buckets), "lang string, bucket int, n long")
    table = counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    langs = sorted(set(table["lang"].to_pylist()))
    counts = np.zeros((buckets, len(langs)))
    at = {lang: i for i, lang in enumerate(langs)}
    counts[table["bucket"].to_numpy(), [at[x] for x in table["lang"].to_pylist()]] = table["n"].to_numpy()
    smoothed = counts + params.smooth
    return langs, np.log(smoothed / smoothed.sum(axis=0)).astype(np.float32)


def proportions(p: np.ndarray, n: np.ndarray, rounds: int, start: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """Mixture proportions of columns of ``p`` that make the buckets (rows, occurring ``n`` times) likeliest, and the log-likelihood."""
    share = np.full(p.shape[1], 1 / p.shape[1]) if start is None else start
    total = n.sum()
    for _ in range(rounds):
        mixed = p @ share
        new = share * ((n / mixed) @ p) / total
        done = np.abs(new - share).max() < 1e-4
        share = new
        if done:
            break
    return share, float(n @ np.log(p @ share))


def mixture(log_p: np.ndarray, n: np.ndarray, params: LanguageParams = LanguageParams()) -> tuple[dict[int, float], np.ndarray]:
    """Proportions of the document's languages, by column of ``log_p`` (a row for each bucket that occurs ``n`` times), and the log-likelihood of each
    language alone."""
    alone = n @ log_p
    chosen = [int(np.argmax(alone))]
    share, best = np.ones(1), float(alone[chosen[0]])
    price = params.overlap * params.cost * 0.5 * np.log(max(n.sum(), 2))
    ratios = None
    refused: set[int] = set()
    while len(chosen) < log_p.shape[1]:
        if ratios is None:
            top = log_p.max(axis=1, keepdims=True)
            ratios = np.exp((log_p - top).astype(np.float64))
            scale = float(n @ top[:, 0].astype(np.float64))
        mixed = ratios[:, chosen] @ share
        slope = (n / mixed) @ ratios - n.sum()
        open_ = [int(i) for i in np.argsort(-slope, kind="stable") if i not in chosen and i not in refused and slope[i] > price]
        for i in open_:
            wider, value = proportions(ratios[:, [*chosen, i]], n, params.rounds, np.append(share * 0.9, 0.1))
            if value + scale - best > price and wider[-1] >= params.least:
                chosen, share, best = [*chosen, i], wider, value + scale
                break
            refused.add(i)
        else:
            break
    return {c: float(s) for c, s in zip(chosen, share)}, alone


def judge(text: str, langs: list[str], log_p: np.ndarray, params: LanguageParams = LanguageParams()) -> tuple[str, float, str]:
    """Main language, its score, and all languages with their proportions, greatest first.

    The score is the proportion times the chance that the language is the likeliest among those that are not in the document. Equal
    proportions go to the first in code point order. A text without letters, or a model without languages, gives ``und``.
    """
    found, n = trigrams(text, log_p.shape[0])
    if not len(found) or not langs:
        return "und", 0.0, ""
    shares, alone = mixture(log_p[found], n, params)
    ranked = sorted(shares.items(), key=lambda x: (-x[1], x[0]))
    main = ranked[0][0]
    others = [i for i in range(len(langs)) if i not in shares]
    odds = np.exp(np.minimum((alone[others] - max(alone[i] for i in shares)) / params.overlap, 0.0)).sum() if others else 0.0
    score = min(max(ranked[0][1] / (1.0 + float(odds)), 0.0), 1.0)
    return langs[main], score, ",".join(f"{langs[i]}:{share:.3f}" for i, share in ranked)


def identify(docs: DataFrame, langs: list[str], log_p: np.ndarray, params: LanguageParams = LanguageParams()) -> DataFrame:
    """Add ``lang_pred, score, languages`` to ``docs``, which has a ``text`` and any other columns but these three."""
    model = docs.sparkSession.sparkContext.broadcast((langs, log_p))
    names = [c for c in docs.columns if c != "text"]
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names), "lang_pred string, score double, languages string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, table = model.value
        for batch in batches:
            out = [judge(text.as_py() or "", known, table, params) for text in batch.column("text")]
            kept = [batch.column(c) for c in names]
            new = [pa.array([o[i] for o in out], t) for i, t in enumerate((pa.string(), pa.float64(), pa.string()))]
            yield pa.RecordBatch.from_arrays([*kept, *new], names=[*names, "lang_pred", "score", "languages"])

    return docs.select(*[F.col(f"`{c}`") for c in names], "text").mapInArrow(run, schema)


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from learning: its id's CRC-32 leaves 1 when divided by 3. A null id does not."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def predict_languages(docs: DataFrame, params: LanguageParams = LanguageParams()) -> DataFrame:
    """``doc_id, held_out, lang_pred, score, languages``, one row per document.

    Learned from text and lang of the documents that have a lang and are not held out; predicted from the text alone. Text without a letter, or null,
    is ``und`` with score 0, and so is all text if nothing could be learned. Very long texts are read whole, in pieces; repeated rows and ids are
    documents of their own and learned from as often as they occur; an empty table gives an empty result. Other columns are not read.
    """
    known = docs.where(F.col("`lang`").isNotNull() & ~held_out(F.col("`doc_id`")))
    langs, log_p = learn(known.select(F.col("`lang`").cast("string").alias("lang"), F.col("`text`").alias("text")), params)
    rows = docs.select(F.col("`doc_id`").alias("doc_id"), held_out(F.col("`doc_id`")).alias("held_out"), F.col("`text`").alias("text"))
    return identify(rows, langs, log_p, params)
