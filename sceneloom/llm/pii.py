"""Personal data (native): patterns propose, checksums confirm, context words adjust the score."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sceneloom.llm.spans import SPAN, apart_from, between, cut, find_spans, first_come, joined, labelled, let

LOCAL = "[A-Za-z0-9._%+-]"
#: Java spelling of the base patterns. A start inside a run of local-part characters or digits can only match
#: if the run's start does, except right after the last match; lookbehinds say so and keep the scan linear.
EMAIL = rf"(?:\G|(?<!{LOCAL})){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,18}+(?![0-9])(?![\x20-][0-9])"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Patterns of the added kinds.
IBAN_RUN = r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}+"
IBAN_HEAD = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?=(?:\x20?[A-Z0-9]){11})"
#: Characters of an account number by country (fixed values of the IBAN registry).
IBAN_LENGTHS = {
    n: names.split() for n, names in (
        (15, "NO"), (16, "BE"), (18, "DK FI FK FO GL NL SD"), (19, "MK SI"), (20, "AT BA EE KZ LT LU MN XK"), (21, "CH HR LI LV"),
        (22, "BG BH CR DE GB GE IE ME RS VA"), (23, "AE GI IL IQ OM SO TL"), (24, "AD CZ ES MD PK RO SA SE SK TN VG"), (25, "LY PT ST"), (26, "IS TR"),
        (27, "BI DJ FR GR IT MC MR SM"), (28, "AL AZ BY CY DO GT HN HU LB NI PL SV"), (29, "BR EG PS QA UA"), (30, "JO KW MU YE"), (31, "MT SC"), (32, "LC"), (33, "RU"),
    )
}
LOCAL_PHONE = r"(?<![0-9+.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9.-])"
SOCIAL = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
OCTET = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"

KINDS = ("email", "ip", "card", "phone", "iban", "local_phone", "social")


@dataclass(frozen=True)
class PiiParams:
    """A span of an added kind stays if its score reaches ``least``. The score starts from the kind's own value,
    gains ``checked`` if a checksum confirms it and ``context`` if one of its words stands within ``reach``
    characters before or after it. An account number whose country is not listed loses ``unlisted``, so its checksum alone does not do."""

    least: float = 0.6
    checked: float = 0.4
    context: float = 0.4
    unlisted: float = 0.2
    reach: int = 40
    start: tuple[tuple[str, float], ...] = (
        ("email", 0.6), ("ip", 0.5), ("card", 0.3), ("phone", 0.5), ("iban", 0.3), ("local_phone", 0.3), ("social", 0.3)
    )
    words: tuple[tuple[str, str], ...] = (
        ("email", "mail|contact|write"), ("ip", "ip|host|server|address"), ("card", "card|visa|credit|payment|karte"),
        ("phone", "phone|tel|call|mobile|fax"), ("iban", "iban|account|bank|konto|transfer"),
        ("local_phone", "phone|tel|call|mobile|fax"), ("social", "ssn|social|security"),
    )


def luhn(hit: Column) -> Column:
    """Whether the digits of a string pass the Luhn check."""
    digits = F.transform(F.split(F.reverse(F.regexp_replace(hit, "[^0-9]", "")), ""), lambda d: F.coalesce(d.try_cast("int"), F.lit(0)))
    doubled = F.transform(digits, lambda d, i: F.when(i % 2 == 1, F.when(d * 2 > 9, d * 2 - 9).otherwise(d * 2)).otherwise(d))
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + d) % 10 == 0


def mod97(hit: Column) -> Column:
    """Whether an account number passes the mod-97 check: head to the end, letters to 10..35, remainder 1."""
    plain = F.regexp_replace(hit, r"\x20", "")
    turned = F.concat(F.substring(plain, 5, 40), F.substring(plain, 1, 4))
    values = F.transform(
        F.filter(F.split(turned, ""), lambda c: F.length(c) > 0),
        lambda c: F.when(c.between("0", "9"), c.try_cast("int")).otherwise(F.ascii(c) - 55),
    )
    return F.aggregate(values, F.lit(0), lambda a, v: (a * F.when(v > 9, 100).otherwise(10) + v) % 97) == 1


def find_ibans(t: Column, pieces: Column) -> Column:
    """Account numbers as spans, whatever follows them after a space.

    Every head (two letters, two digits) opens a run of at most 34 characters, and each end of a group in it is tried: the
    number that passes mod-97 at its country's length is taken. Without one the longest that passes is taken if the
    country is not listed, and the whole run if it is. A number that starts inside the one before it is left out. ``pieces`` are those of ``cut``.
    """
    at_least, at_most = 15, 64

    def one(s: Column) -> Column:
        here = between(pieces, s["start"], s["start"] + at_most + 1)
        run = F.regexp_extract(here, "^" + IBAN_RUN, 0)
        country = F.substring(run, 1, 2)
        own = F.lit(0)
        for n, names in IBAN_LENGTHS.items():
            own = F.when(country.isin(names), n).otherwise(own)

        def tried(end: Column) -> Column:
            hit = F.substring(run, F.lit(1), end)
            size = F.length(F.regexp_replace(hit, r"\x20", ""))
            return F.struct((size == own).alias("fits"), end.alias("end"), hit.alias("hit"), size.alias("size"))

        tries = F.transform(F.sequence(F.lit(at_least), F.length(run)), tried)
        good = F.filter(
            tries,
            lambda x: (x["size"] >= at_least) & ~F.endswith(x["hit"], F.lit(" ")) & ~F.substring(here, x["end"] + 1, F.lit(1)).rlike("[A-Za-z0-9]")
            & (x["fits"] | (own == 0) | (x["end"] == F.length(run))) & mod97(x["hit"]),
        )
        best = F.array_max(good)
        return F.struct(s["start"].alias("start"), (s["start"] + best["end"]).alias("end"), best["hit"].alias("hit"))

    heads = find_spans(t, IBAN_HEAD, t.rlike("[A-Z]{2}[0-9]{2}"))
    found = F.filter(F.transform(heads, one), lambda s: s["hit"].isNotNull())
    return let(found, first_come).cast(SPAN)


def _digits(hit: Column) -> Column:
    return F.length(F.regexp_replace(hit, "[^0-9]", ""))


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", params: PiiParams = PiiParams()) -> DataFrame:
    """One row per document: ``doc_id`` and for each kind an array of spans (start, end, hit, score).

    email, ip, card and phone are the base kinds and stay whatever their score; iban, local_phone and social
    are added if their score is high enough and no base span touches them. Places are code points, ends
    exclusive. Null text counts as empty; null and repeated ids are each returned; an empty table
    gives an empty result; other columns are not read. No row leaves its task: there is no shuffle. Long texts with many hits cost
    little more than in proportion.
    """
    starts, words = dict(params.start), dict(params.words)
    base = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    t, pieces = F.col("text"), F.col("pieces")
    base = base.withColumn("pieces", cut(t, t.rlike("[@0-9]")))
    rows = base.select(
        "doc_id", "pieces",
        find_spans(t, EMAIL, t.contains("@")).alias("email"),
        F.filter(find_spans(t, IP, t.rlike(r"[0-9]\.[0-9]")), lambda s: s["hit"].rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$")).alias("ip"),
        F.filter(find_spans(t, CARD, t.rlike(r"[0-9](?:[\x20-]?[0-9]){12}")), lambda s: luhn(s["hit"])).alias("card"),
        F.filter(find_spans(t, PHONE, t.contains("+")), lambda s: _digits(s["hit"]).between(9, 15)).alias("phone"),
        find_ibans(t, pieces).alias("iban"),
        find_spans(t, LOCAL_PHONE, t.rlike(r"[0-9]{3}[\x20.-][0-9]{4}")).alias("local_phone"),
        find_spans(t, SOCIAL, t.rlike(r"[0-9]{3}-[0-9]{2}-[0-9]{4}")).alias("social"),
    )

    def scored(kind: str) -> Column:
        checked = F.lit(params.checked if kind in ("card", "iban") else 0.0)

        def one(s: Column) -> Column:
            before, after = between(pieces, s["start"] - params.reach, s["start"]), between(pieces, s["end"], s["end"] + params.reach)
            near = F.concat_ws(" ", before, after).rlike(rf"(?i)(?<![A-Za-z])(?:{words[kind]})(?![A-Za-z])")
            listed = F.substring(s["hit"], 1, 2).isin([c for names in IBAN_LENGTHS.values() for c in names]) if kind == "iban" else F.lit(True)
            score = F.lit(starts[kind]) + checked - F.when(listed, F.lit(0.0)).otherwise(F.lit(params.unlisted)) + F.when(near, F.lit(params.context)).otherwise(F.lit(0.0))
            return F.struct(s["start"].alias("start"), s["end"].alias("end"), s["hit"].alias("hit"), F.round(F.least(score, F.lit(1.0)), 2).alias("score"))

        return F.transform(kind, one)

    rows = rows.select("doc_id", *[scored(k).alias(k) for k in KINDS])
    taken = F.concat(*KINDS[:4])
    return rows.select(
        "doc_id", *KINDS[:4],
        *[apart_from(F.filter(k, lambda s: s["score"] >= params.least), taken).alias(k) for k in KINDS[4:]],
    )


def digest(found: DataFrame) -> DataFrame:
    """``doc_id``, counts, ``base_sha256``, ``spans`` and their ``scores`` in the same order, of the result of ``find_pii``."""
    marks = [labelled(F.col(k), i, k) for i, k in enumerate(KINDS)]
    order = ("rank", "start", "end")
    return found.select(
        "doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS[:4]],
        F.sha2(joined(F.concat(*marks[:4]), order).cast("binary"), 256).alias("base_sha256"),
        joined(F.concat(*marks), order).alias("spans"),
        F.concat_ws(",", *[F.transform(F.array_sort(k), lambda s: F.format_number(s["score"], 2)) for k in KINDS]).alias("scores"),
    )
