"""Exact and near dedup against brute force on small tables."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash

from sceneloom.llm import exact_dedup, near_sets, rows, simhash

DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp int, recipe string, __gone string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 1, "x", "y") for i, t in rows], DOCS)


def plain_fingerprint(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    """Least id reachable by links of at most two bits, by repeated passes over all pairs."""
    label = {i: i for i in prints}
    changed = True
    while changed:
        changed = False
        for i, a in prints.items():
            for j, b in prints.items():
                if (a ^ b).bit_count() <= 2 and label[j] < label[i]:
                    label[i], changed = label[j], True
    return label


def some_texts():
    rnd = random.Random(3)
    words = [f"w{k}" for k in range(300)]
    rows = {}
    for base in range(12):
        text = [rnd.choice(words) for _ in range(rnd.choice([30, 200, 400]))]
        for _ in range(6):
            copy = list(text)
            copy[rnd.randrange(len(copy))] = rnd.choice(words)
            rows[len(rows)] = " ".join(copy)
    rows |= {100: "", 101: None, 102: "one", 103: "One", 104: "one two", 105: "Ä ä b\u000bc", 106: "w " * 30_000}
    return rows


def test_fingerprints_and_components_match_brute_force(spark):
    rows = some_texts()
    got = {r.doc_id: r for r in simhash.near_groups(docs(spark, rows.items())).collect()}
    prints = {i: plain_fingerprint(t) for i, t in rows.items()}
    assert {i: r.fingerprint for i, r in got.items()} == {i: f"{p:016x}" for i, p in prints.items()}
    assert {i: r.component_id for i, r in got.items()} == plain_components(prints)


def test_crowded_keys_give_the_same_components(spark):
    rows = some_texts()
    one = simhash.near_groups(docs(spark, rows.items())).collect()
    two = simhash.near_groups(docs(spark, rows.items()), pairs_per_key=0).collect()
    assert sorted(one) == sorted(two)


def test_golay_keys_meet_for_every_error_of_two_bits():
    rnd = np.random.default_rng(5)
    for value in rnd.integers(0, 1 << 63, size=6, dtype=np.uint64):
        others = [value] + [value ^ np.uint64(1 << i) for i in range(64)] + [value ^ np.uint64(1 << i | 1 << j) for i in range(64) for j in range(i)]
        _, own_keys, own = simhash.golay_keys(np.array([value], dtype=np.uint64))
        mine = set(own_keys[own].tolist())
        r, keys, _ = simhash.golay_keys(np.array(others, dtype=np.uint64))
        assert set(r[np.isin(keys, list(mine))].tolist()) == set(range(len(others)))
        assert len(own_keys) <= 18


def test_code_is_perfect():
    assert len(set(simhash.ERRORS.tolist())) == 2048


def test_near_groups_of_nulls_repeats_and_nothing(spark):
    rows = [(None, "a b c d"), (4, "a b c d"), (4, "a b c d"), (9, None), (None, "x y z q r s t u")]
    got = sorted(((r.doc_id, r.component_id) for r in simhash.near_groups(docs(spark, rows)).collect()), key=str)
    assert got == sorted([(None, 4), (4, 4), (4, 4), (9, 9), (None, None)], key=str)
    assert simhash.near_groups(docs(spark, [])).count() == 0


def plain_set(text, k=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower())
    return frozenset(tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))) if words else frozenset()


def plain_near(rows, t=0.8):
    """Kept (id, text) of each group connected by pairs of similar five-word sets, over all pairs."""
    sets = [plain_set(x) for _, x in rows]
    label = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            if a == sets[j] or len(a & sets[j]) >= t * len(a | sets[j]) > 0:
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    order = lambda r: (r[0] is None, r[0] or 0, hashlib.sha256((r[1] or "").encode()).hexdigest())
    best = {g: min((r for r, x in zip(rows, label) if x == g), key=order) for g in set(label)}
    return sorted({(i, t or "") for i, t in best.values()}, key=str)


def edited_texts(n=14, seed=5):
    rnd = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    shared = [rnd.choice(words) for _ in range(60)]
    out = []
    for base in range(n):
        text = [rnd.choice(words) for _ in range(rnd.choice([6, 9, 30, 120, 300]))]
        if base % 3 == 0:
            text[3:3] = shared
        for _ in range(rnd.choice([1, 5, 12])):
            copy = list(text)
            for _ in range(rnd.choice([0, 1, 1, 2, 3, len(text) // 30])):
                at = rnd.randrange(len(copy))
                copy[at : at + rnd.choice([0, 1, 1, 2])] = [rnd.choice(words) for _ in range(rnd.choice([0, 1, 1]))]
            out.append(" ".join(copy))
    return out


@pytest.mark.parametrize("hot, stars, block", [(64, 2, 128), (2, 0, 2), (1, 1, 4)])
def test_near_copies_match_all_pairs(spark, monkeypatch, hot, stars, block):
    monkeypatch.setattr(near_sets, "BLOCK", block)
    monkeypatch.setattr(near_sets, "FEW", block // 2)
    monkeypatch.setattr(near_sets, "HOT", hot)
    monkeypatch.setattr(near_sets, "STARS", stars)
    table = list(enumerate(edited_texts())) + [(900, None), (901, ""), (902, "one two"), (903, "One two"), (904, "w " * 20_000), (905, "w " * 20_001), (906, "\u000b")]
    kept = simhash.keep_one(docs(spark, table), simhash.near_copies(docs(spark, table)))
    assert kept.columns == docs(spark, []).columns
    want = plain_near(table)
    assert 10 < len(want) < len(table) - 20
    assert sorted(((r.doc_id, r.text or "") for r in kept.collect()), key=str) == want


def test_crowded_keys_give_links_only(spark, monkeypatch):
    """Copies of one text, each with three words of its own: all pairs lie just below 0.8, where parity sketches let many through."""
    monkeypatch.setattr(near_sets, "FEW", 4)
    inner, made = near_sets._in_blocks, []

    def counted(*args):
        out = inner(*args)
        made.append(out.count())
        return out

    monkeypatch.setattr(near_sets, "_in_blocks", counted)
    table = []
    for i in range(17):
        text = [f"w{k}" for k in range(264)]
        for slot in (3 * i, 3 * i + 1, 3 * i + 2):
            text[5 * slot + 4] = f"own{slot}"
        table.append((i, " ".join(text)))
    kept = simhash.keep_one(docs(spark, table), simhash.near_copies(docs(spark, table)))
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == table == sorted(plain_near(table))
    assert made == [0]


def test_links_of_blocks_connect_what_all_links_connect(spark):
    """Two groups of close copies under one key, and sets of their own: fewer links than sets, and no label left apart."""
    rnd = np.random.default_rng(4)
    sets = []
    for _ in range(2):
        base = rnd.integers(0, 1 << 62, size=90)
        sets += [np.unique(np.concatenate([base[: 90 - k % 3], rnd.integers(0, 1 << 62, size=k % 4)])) for k in range(30)]
    sets += [rnd.integers(0, 1 << 62, size=90) for _ in range(5)] + [np.empty(0, dtype=np.int64)]
    n, held = np.array([len(s) for s in sets]), np.concatenate(sets)
    shared = near_sets.shared_members(n, held, n, held)
    assert (shared == [[len(np.intersect1d(a, b)) for b in sets] for a in sets]).all()
    linked = (shared >= 0.8 / 1.8 * (n[:, None] + n[None, :])) & (n > 0) & ~np.eye(len(n), dtype=bool)
    i, j = near_sets.forest(linked, np.arange(len(n)), np.arange(len(n)))
    assert linked.sum() > 1700 and len(i) == 2 * 29 and linked[i, j].all()
    label = list(range(len(sets)))
    for a, b in zip(i.tolist(), j.tolist()):
        label = [min(label[a], label[b]) if x in (label[a], label[b]) else x for x in label]
    assert label == [0] * 30 + [30] * 30 + list(range(60, 66))


def test_similar_sets_share_a_key_that_neither_can_spare():
    rnd = np.random.default_rng(3)
    for n in [1, 2, 3, 4, 5, 7, 9, 10, 30, 101, 400, 999]:
        for _ in range(20):
            a = rnd.integers(0, 1 << 63, size=n, dtype=np.uint64)
            most = int(0.2 / 1.8 * 2 * n)  # differences that keep 0.8
            cut, new = rnd.integers(0, most + 1), rnd.integers(0, most + 1)
            b = np.concatenate([a[: n - cut], rnd.integers(0, 1 << 63, size=new, dtype=np.uint64)])
            if not len(b) or (n - cut) < 0.8 * (n + new):
                continue
            (own_a, m_a), (low_a, l_a) = near_sets.set_keys(np.unique(a), 0.8)
            (own_b, m_b), (low_b, l_b) = near_sets.set_keys(np.unique(b), 0.8)
            pairs = [(own_a, m_a, own_b, m_b), (own_a, m_a, low_b, l_b), (low_a, l_a, own_b, m_b)]
            shared = [(np.intersect1d(x, y), mx, my) for x, mx, y, my in pairs]
            assert any(len(s) > max(mx, 0) or len(s) > max(my, 0) or (len(s) and min(mx, my) < 0) for s, mx, my in shared), (n, cut, new)


def test_sketches_never_differ_more_than_their_sets(spark):
    rnd = np.random.default_rng(8)
    rows = []
    for n in [1, 5, 31, 32, 33, 40, 64, 65, 200, 500]:
        a = rnd.integers(0, 1 << 63, size=n, dtype=np.uint64)
        for cut, new in [(0, 0), (n // 9, n // 8), (0, n // 4), (n // 2, n // 2)]:
            b = np.concatenate([a[: n - cut], rnd.integers(0, 1 << 63, size=new, dtype=np.uint64)])
            rows.append((near_sets.parity_sketch(np.unique(a)).tolist(), near_sets.parity_sketch(np.unique(b)).tolist(), cut + new))
    got = spark.createDataFrame(rows, "x array<long>, y array<long>, d int").select("d", near_sets._bits_apart("x", "y").alias("bits"), near_sets._bits_apart("y", "x").alias("back")).collect()
    assert all(r.bits == r.back <= r.d and (r.d == 0) <= (r.bits == 0) for r in got)
    assert sum(r.bits for r in got) > 0.4 * sum(r.d for r in got)


def test_near_copies_of_nulls_repeats_and_nothing(spark):
    text = " ".join(f"a{k}" for k in range(40))
    table = [(None, text), (4, text), (4, text), (4, text + " z"), (7, "other words here"), (None, None), (None, "lone words"), (None, "lone words")]
    kept = simhash.keep_one(docs(spark, table), simhash.near_copies(docs(spark, table)))
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == plain_kept(table)
    assert simhash.keep_one(docs(spark, []), simhash.near_copies(docs(spark, []))).count() == 0


def plain_kept(table):
    return sorted(((i, t or None) for i, t in plain_near(table)), key=str)


def test_rows_go_by_id_and_text(spark):
    table = docs(spark, [(None, "a"), (None, "b"), (None, "b"), (1, "a"), (1, "b"), (2, None)])
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    decided = spark.createDataFrame([(None, sha("a"), False), (None, sha("b"), True), (None, sha("b"), True), (1, sha("a"), True), (1, sha("b"), False), (2, sha(""), True)],
                                    "doc_id long, text_sha256 string, kept boolean")
    got = rows.keep_rows(table, decided)
    assert got.columns == table.columns
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted([(None, "b"), (1, "a"), (2, None)], key=str)


def plain_groups(rows):
    out = []
    for i, t in rows:
        same = [j for j, u in rows if (u or "") == (t or "")]
        keep = max((j for j in same if j is not None), default=None)
        out.append((i, keep, len(same), i == keep, hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=str)


def test_exact_groups_match_brute_force(spark):
    rnd = random.Random(1)
    long = "".join(rnd.choice("abcdefgh é") for _ in range(90_000))
    rows = [(0, long), (1, long), (2, long[:-1] + "!"), (3, ""), (4, None), (5, "a"), (6, "a"), (6, "a"), (7, "A"), (None, "a"), (None, "n"), (None, "n")]
    got = sorted(map(tuple, exact_dedup.exact_groups(docs(spark, rows)).collect()), key=str)
    assert got == plain_groups(rows)
    assert exact_dedup.exact_groups(docs(spark, [])).count() == 0


def test_colliding_digests_are_told_apart_by_content(spark):
    rnd = random.Random(2)
    rows = [(i, "".join(rnd.choice("abc") for _ in range(700))) for i in range(40)]
    rows += [(40 + i, t) for i, t in rows[:7]]
    c = exact_dedup.Chunking(mask_bits=6, least=64, digest_bytes=1)
    assert not exact_dedup.collided_chunks(docs(spark, rows), c).isEmpty()
    got = sorted(map(tuple, exact_dedup.exact_groups(docs(spark, rows), c).collect()), key=str)
    assert got == plain_groups(rows)


def test_chunks_follow_content():
    rnd = random.Random(4)
    data = bytes(rnd.randrange(256) for _ in range(200_000))
    c = exact_dedup.Chunking()
    cuts = exact_dedup.cut_points(data, c)
    assert cuts[-1] == len(data) and all(b - a <= c.most for a, b in zip([0, *cuts], cuts))
    moved = exact_dedup.cut_points(b"xyz" + data, c)
    assert len({x + 3 for x in cuts} & set(moved)) > 0.8 * len(cuts)
    assert exact_dedup.cut_points(b"", c) == []
    assert exact_dedup.cut_points(b"a" * 100_000, c)[-1] == 100_000


def test_drop_copies_keeps_columns_and_one_row(spark):
    table = docs(spark, [(1, "a"), (2, "a"), (2, "a"), (2, "b"), (3, None), (4, ""), (None, "z"), (None, "z"), (None, "a")])
    kept = exact_dedup.drop_copies(table, exact_dedup.exact_groups(table))
    assert kept.columns == table.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([(2, "a"), (2, "b"), (4, ""), (None, "z")], key=str)
    assert exact_dedup.drop_copies(docs(spark, []), exact_dedup.exact_groups(docs(spark, []))).count() == 0


def test_stages_carry_columns_of_any_type_and_name(spark):
    """Names of the operators' own columns, and maps, which have no order."""
    from pyspark.sql import functions as F

    import corpus_pipeline

    words = lambda k: " ".join(f"w{k}x{i}" for i in range(80))
    base = [(i, words(i % 9) + (" tail" if i == 11 else "")) for i in range(12)] + [(0, words(0)), (None, words(3)), (5, None)]
    own = "row doc size tokens digest text_sha256 kept keep_id group fp place pieces __n"
    table = spark.createDataFrame([(i, t, "en", f"s{(i or 0) % 2}", len(t or "")) for i, t in base], "doc_id long, text string, lang string, source string, n_chars int")
    table = table.select("*", F.create_map(F.lit("k"), F.col("text")).alias("attributes"), *[F.lit(k).alias(name) for k, name in enumerate(own.split())])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, table, "")
        assert out.columns == table.columns and out.schema["attributes"].dataType == table.schema["attributes"].dataType, name
        assert all(r.row == 0 and r.attributes == {"k": r.text} for r in out.collect()), name
    kept = corpus_pipeline.exact_copies(spark, table, "").collect()
    assert sorted(((r.doc_id, r.text) for r in kept), key=str) == sorted([(9, words(0)), (10, words(1)), (11, words(2) + " tail"), (2, words(2)), (3, words(3)), (4, words(4)), (5, words(5)), (6, words(6)), (7, words(7)), (8, words(8)), (5, None)], key=str)
    packed = corpus_pipeline.packed(spark, table, "")
    assert packed.count() >= table.count() - 1
