"""Merkle manifest, language identification and source divergence against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from sceneloom.llm import divergence, language, merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars int, tree string, row long, n int, term string"


def table(spark, rows):
    """Documents with further columns that are named like the operators' own."""
    return spark.createDataFrame([(*r, "x", 7, 3, "y") for r in rows], SCHEMA)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# --- Merkle manifest


def plain_leaf(doc_id, text, lang, source, n_chars):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def plain_levels(digests):
    levels = [digests]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i : i + 16])) for i in range(0, len(levels[-1]), 16)])
    return levels


def plain_manifest(rows):
    lower = str.maketrans(merkle.UPPER, merkle.LOWER)
    by_source = defaultdict(list)
    for r in rows:
        by_source[r[3]].append((r[0] is not None, r[0] or 0, plain_leaf(*r), r))
    names = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = [plain_levels([x[2] for x in sorted(by_source[s], key=lambda x: x[:3])]) for s in names]
    top = plain_levels([t[-1][0] for t in trees])
    out = []
    for no, (s, tree) in enumerate(zip(names, trees)):
        for at, (_, _, leaf, r) in enumerate(sorted(by_source[s], key=lambda x: x[:3])):
            now = leaf
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0:
                now = plain_leaf(r[0], None if r[1] is None else r[1].translate(lower), *r[2:])
            sibs = ""
            for levels, i in ((tree, at), (top, no)):
                for level in levels[:-1]:
                    run = level[i // 16 * 16 : i // 16 * 16 + 16]
                    left, right = "".join(run[: i % 16]), "".join(run[i % 16 + 1 :])
                    now, sibs, i = sha(left + now + right), sibs + left + right, i // 16
            root = top[-1][0]
            out.append((r[0], leaf, tree[-1][0], root, sha(sibs), now, now == root))
    return sorted(out, key=str)


def manifest_rows(n, sources, seed=1):
    rnd = random.Random(seed)
    pick = lambda *xs: rnd.choice(xs)
    return [(i, pick("Abc", "é𝒳 Z", "", None, "tEXT" * rnd.randrange(9)) , pick("en", None), rnd.choice(sources), pick(1, 20, None)) for i in range(n)]


@pytest.mark.parametrize(
    "rows",
    [
        [],
        [(5, "One", "en", "a", 3)],
        [(None, None, None, None, None)],
        manifest_rows(16, ["a"]),
        manifest_rows(17, ["a"]),
        manifest_rows(300, ["a"]),
        manifest_rows(700, ["a", "b", "", None, "é", "𝒳", ""] + ["a"] * 9),
        manifest_rows(60, [f"s{i}" for i in range(40)]),
        manifest_rows(30, ["a", None]) * 2 + [(None, "Q", None, "a", 1), (None, "R", None, "a", 1), (3, "other", "de", "a", 1)],
        [(i, "Long Word " * 30_000, "en", "a", 9) for i in range(3)],
    ],
    ids=["empty", "lone", "nulls", "run", "run and one", "two levels", "sources", "many sources", "repeats", "long"],
)
def test_manifest_matches_brute_force(spark, rows):
    got = merkle.manifest(merkle.tampered_leaves(table(spark, rows)))
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain_manifest(rows)


def test_manifest_finds_what_was_tampered_with(spark):
    rows = [(i, "Upper" if i % 2 else "lower", "en", "a", 1) for i in range(100)]
    got = {r.doc_id: r.verified for r in merkle.manifest(merkle.tampered_leaves(table(spark, rows))).collect()}
    assert got == {i: not (i % 2 and zlib.crc32(str(i).encode()) % 5 == 0) for i in range(100)}


# --- language identification

PARTS = {
    "aa": "the of ing and tion er re is on thou blest".split(),
    "bb": "der sch keit ung ver ge ein lich zu pf".split(),
    "cc": "le eau oux ment que pour aient é ois".split(),
}


def words(rnd, lang, n):
    return " ".join("".join(rnd.choice(PARTS[lang]) for _ in range(rnd.randrange(1, 4))) for _ in range(n))


def test_languages_of_held_out_documents(spark):
    rnd = random.Random(3)
    rows = [(i, words(rnd, lang, rnd.randrange(5, 80)), lang, "s", 1) for i, lang in enumerate(rnd.choice("aa bb cc".split()) for _ in range(240))]
    rows += [(1000 + i, words(rnd, "aa", 80) + " " + words(rnd, "bb", 30), None, "s", 1) for i in range(20)]
    got = {r.doc_id: r for r in language.predict_languages(table(spark, rows)).collect()}
    assert len(got) == len(rows)
    for doc_id, text, lang, *_ in rows:
        r = got[doc_id]
        assert r.held_out == (zlib.crc32(str(doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1
        if lang:
            assert r.lang_pred == lang and r.languages.startswith(lang)
        else:
            shares = dict(x.split(":") for x in r.languages.split(","))
            assert r.lang_pred == "aa" and set(shares) == {"aa", "bb"} and 0.1 < float(shares["bb"]) < 0.45


def test_labels_of_held_out_documents_and_other_columns_do_not_matter(spark):
    rnd = random.Random(4)
    rows = [(i, words(rnd, lang, 20), lang, "s", 1) for i, lang in enumerate(rnd.choice("aa bb".split()) for _ in range(60))]
    held = lambda i: zlib.crc32(str(i).encode()) % 3 == 1
    other = [(i, t, "zz" if held(i) else lang, f"q{i}", i) for i, t, lang, *_ in rows]
    a, b = (sorted(tuple(r) for r in language.predict_languages(table(spark, x)).collect()) for x in (rows, other))
    assert a == b and "zz" not in {r[2] for r in b}


def test_language_of_odd_texts(spark):
    rnd = random.Random(5)
    rows = [(i, words(rnd, "aa", 30), "aa", "s", 1) for i in range(9)] + [(20 + i, words(rnd, "bb", 30), "bb", "s", 1) for i in range(9)]
    odd = [(100, None, "aa", None, None), (101, "", None, "s", 1), (102, "12 ½² ٣ !?", None, "s", 1), (None, words(rnd, "bb", 9), None, None, None), (None, "the", None, None, None),
           (103, words(rnd, "bb", 400_000), None, "s", 1), (104, "日本語", None, "s", 1), (105, "a", None, "s", 1)] + rows[:1]
    got = language.predict_languages(table(spark, rows + odd)).collect()
    assert len(got) == len(rows) + len(odd)
    by = defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
    assert all(by[i][0].lang_pred == "und" and by[i][0].score == 0 for i in (100, 101, 102))
    assert by[103][0].lang_pred == "bb" and by[104][0].lang_pred in ("aa", "bb") and by[105][0].lang_pred in ("aa", "bb")
    assert sorted(r.lang_pred for r in by[None]) == ["aa", "bb"] and not any(r.held_out for r in by[None])
    empty = language.predict_languages(table(spark, []))
    assert empty.columns == ["doc_id", "held_out", "lang_pred", "score", "languages"] and empty.count() == 0
    assert {r.lang_pred for r in language.predict_languages(table(spark, [(1, "abc", None, "s", 1)])).collect()} == {"und"}


def test_trigrams_of_long_texts_are_those_of_their_pieces(monkeypatch):
    text = words(random.Random(6), "cc", 500) + " 𝒳é ß"
    whole = language.trigrams(text, 1 << 12)
    monkeypatch.setattr(language, "PIECE", 100)
    pieces = language.trigrams(text, 1 << 12)
    assert [x.tolist() for x in whole] == [x.tolist() for x in pieces] and whole[1].sum() == len(re.sub(r"[^\w]+", " ", text.strip()).lower())


def test_mixture_finds_the_likeliest_proportions():
    rnd = np.random.default_rng(7)
    p = rnd.dirichlet(np.full(40, 0.3), 3).T + 1e-4
    n = rnd.multinomial(600, p[:, :2] @ [0.7, 0.3] / (p[:, :2] @ [0.7, 0.3]).sum())
    shares, alone = language.mixture(np.log(p), n)
    assert set(shares) == {0, 1} and alone.argmax() == 0
    best = max(np.linspace(0.001, 0.999, 999), key=lambda x: n @ np.log(p[:, :2] @ [x, 1 - x]))
    assert abs(shares[0] - best) < 0.01


# --- source divergence


def plain_divergence(rows):
    docs = [(lang or "", source or "", [t.translate(str.maketrans(merkle.UPPER, merkle.LOWER)) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]) for _, text, lang, source, _ in rows]
    out = []
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        df = Counter(t for d in mine for t in set(d[2]))
        kept = sorted((t for t in df if df[t] >= 3), key=str.encode)
        counts = defaultdict(Counter)
        for _, source, terms in mine:
            counts[source].update(t for t in terms if df[t] >= 3)
        whole = sum(counts.values(), Counter())
        p = lambda c, t: 1 + 1_000_000_000 * (c[t] + 1) // (sum(c.values()) + len(kept))
        f = lambda x, y: (x - y) ** 2 // y
        for source in {d[1] for d in mine}:
            pairs = [(o, sum(f(p(counts[source], t), p(counts[o], t)) for t in kept)) for o in {d[1] for d in mine} - {source}]
            terms = [(t, f(p(counts[source], t), p(whole, t))) for t in kept if counts[source][t] and p(counts[source], t) > p(whole, t)]
            for part, items in (("pair", pairs), ("term", terms)):
                ranked = sorted(items, key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, source, part, item, value, i + 1) for i, (item, value) in enumerate(ranked) if part == "pair" or i < 200]
    return sorted(out)


def divergence_rows(n, sources, seed):
    rnd = random.Random(seed)
    vocabulary = ["".join(rnd.choice("aäAbZé𝒳") for _ in range(rnd.randrange(1, 12))) for _ in range(300)] + ["ab", "abc", "abcd", "abcde", "ABCDEFGH", "abcdefghi"]
    text = lambda: rnd.choice(" ,1[\n").join(vocabulary[int(rnd.expovariate(0.02)) % len(vocabulary)] for _ in range(rnd.randrange(0, 40)))
    return [(i, rnd.choice([text(), text(), None, ""]), rnd.choice(["en", "de", None, ""]), rnd.choice(sources), 1) for i in range(n)]


@pytest.mark.parametrize(
    "rows",
    [
        [],
        [(1, None, None, None, None)],
        [(i, "one two", "en", f"s{i}", 1) for i in range(2)],
        [(i, "same same", "en", f"s{i}", 1) for i in range(3)] + [(9, None, "en", "none", 1)],
        divergence_rows(250, ["a", "b", None, "", "é", "", "𝒳"], 8),
        divergence_rows(40, ["a", "b"], 9) * 2,
        [(i, "x" * 300_000 + " " + "y" * (i + 5) * 1_000, "en", "ab"[i % 2], 1) for i in range(4)],
    ],
    ids=["empty", "nulls", "nothing kept", "ties", "random", "repeats", "long"],
)
def test_divergence_matches_brute_force(spark, rows):
    got = divergence.source_divergence(table(spark, rows))
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(tuple(r) for r in got.collect()) == plain_divergence(rows)


def test_divergence_does_not_depend_on_tasks_tiles_or_blocks(spark):
    rows = divergence_rows(120, [f"s{i}" for i in range(9)], 10)
    small = divergence.Audit(prefix=1, growth=2, cells=20, tile=2, block=7)
    assert sorted(tuple(r) for r in divergence.source_divergence(table(spark, rows).repartition(7), small).collect()) == plain_divergence(rows)


def test_pieces_of_long_texts_end_where_terms_do():
    text = b"ab cd efghij k " * 50
    pieces = list(divergence._slices(text, 7))
    assert b"".join(pieces) == text and [t for p in pieces for t in divergence.TERM.findall(p)] == divergence.TERM.findall(text)


def test_shares_are_exact_beyond_what_doubles_hold(spark):
    cases = [(0, 1), (0, 3), (9_223_372_035, 9_223_372_037), (12_345_678_901_234, 80_000_000_000_001), (79_999_999_999_999, 80_000_000_000_000)]
    df = spark.createDataFrame(cases, "c long, t long")
    for r in df.select("c", "t", divergence.share(df.c, df.t).alias("p")).collect():
        assert r.p == 1 + 1_000_000_000 * (r.c + 1) // r.t
