"""Mixing, packing, quality rules, token counts and the pipeline against brute force."""

import hashlib
import itertools
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from test_dedup import plain_near

from sceneloom import numbering
from sceneloom.llm import mixing, packing, quality, token_counts

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, target string, words string, __h int, kept int"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, len(t or ""), 1, "t", "w", 2, 3) for i, t, lang, s in rows], SCHEMA)


def n_words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def some_docs(n=300, seed=1):
    rnd = random.Random(seed)
    words = [f"w{k}" for k in range(500)]
    rows = [(i, " ".join(rnd.choice(words) for _ in range(rnd.choice([3, 60, 80, 200, 700]))), rnd.choice(["en", "fr", None]), rnd.choice(["a", "a", "a", "b", "é", "z", None])) for i in range(n)]
    return rows + [(n, None, "en", "a"), (n + 1, "", None, None), (n + 2, "\t \n", "en", "b")]


def plain_targets(sizes):
    """Water filling by repeated resharing, the slow way."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    held, goal = {}, 1.5 * sum(sizes.values())
    while True:
        free = [s for s in order if s not in held]
        if not free:
            return held
        level = (goal - sum(held.values())) / sum(weight[s] for s in free)
        above = [s for s in free if weight[s] * level > 2 * sizes[s]]
        if not above:
            return held | {s: weight[s] * level for s in free}
        held |= {s: 2.0 * sizes[s] for s in above}


def test_targets_and_words_taken(spark):
    rows = some_docs()
    sizes = defaultdict(int)
    for _, t, _, s in rows:
        sizes[s] += n_words(t)
    got = mixing.plan_mix(docs(spark, rows)).collect()
    want = plain_targets(sizes)
    assert len(got) == len(rows)
    taken = Counter()
    for r in got:
        assert r.size == n_words(rows[r.doc_id][1]) and r.source_size == sizes[r.source]
        assert r.target == pytest.approx(want[r.source]) and 0 <= r.taken <= 2 * r.size
        assert r.taken == sum(p.words for p in r.passes)
        taken[r.source] += r.taken
    assert all(abs(taken[s] - want[s]) <= 1 for s in want)
    places = [r.position for r in got if r.position is not None]
    assert places == sorted(places) and all(0 <= p <= 1 for p in places)
    assert [tuple(r) for r in mixing.plan_mix(docs(spark, rows[::-1]).repartition(7)).collect()] == [tuple(r) for r in got]


def test_positions_follow_the_schedules(spark):
    """The share of a source's words placed before a time is the integral of its schedule."""
    rows = [(i, "x " * 20, "en", s) for s in "abc" for i in range(ord(s) * 1000, ord(s) * 1000 + 400)]
    c = mixing.Curriculum()
    plan = mixing.plan_mix(docs(spark, rows), c).collect()
    for slot, source in enumerate("abc"):
        knots = c.schedules[slot]
        places = [(p.position, p.words) for r in plan if r.source == source for p in r.passes]
        whole = sum(w for _, w in places)
        grid = np.linspace(0, 1, 10_001)
        area = np.cumsum(np.interp(grid, *zip(*knots)))
        for t in (0.2, 0.5, 0.7, 0.9):
            asked = area[int(t * 10_000)] / area[-1]
            assert sum(w for p, w in places if p < t) / whole == pytest.approx(asked, abs=0.01)


def test_whole_documents_and_order(spark):
    table = docs(spark, some_docs())
    plan = mixing.plan_mix(table, whole=True).collect()
    mixed = mixing.apply_mix(table)
    assert mixed.columns == table.columns
    order = [r.doc_id for r in mixed.collect()]
    n = Counter(order)
    assert dict(n) == {r.doc_id: len(r.passes) for r in plan if r.passes}
    assert set(n.values()) <= {1, 2}
    places = {r.doc_id: [p.position for p in r.passes] for r in plan}
    at = [places[i].pop(0) for i in order]
    assert at == sorted(at)


def test_each_row_is_read_as_often_as_planned_for_it(spark):
    rows = [(None, "a b c", "en", "s")] * 6 + [(5, "a b", "en", "s"), (5, "a b", "en", "t"), (5, "x y z u", "en", "t")]
    table = docs(spark, rows)
    planned = Counter()
    for r in mixing.plan_mix(table, whole=True).collect():
        planned[r.doc_id, r.size, r.source] += len(r.passes)
    got = Counter((r.doc_id, n_words(r.text), r.source) for r in mixing.apply_mix(table).collect())
    assert got == +planned and sum(got.values()) <= 2 * len(rows)
    assert mixing.apply_mix(docs(spark, [])).count() == 0


def test_mixing_and_packing_of_nothing_and_repeats(spark):
    assert mixing.plan_mix(docs(spark, [])).count() == 0
    assert packing.pack(docs(spark, [])).count() == 0
    rows = [(None, "a b", "en", None), (None, "a b c", "en", None), (3, "x", "en", "s"), (3, "x", "en", "s")]
    assert mixing.plan_mix(docs(spark, rows)).count() == 4
    assert sorted(r.n_words for r in packing.pack(docs(spark, rows)).collect()) == [1, 1, 2, 3]
    assert mixing.plan_mix(docs(spark, [(1, None, "en", "s"), (2, "", "en", "t")])).where("taken = 0").count() == 2


def test_running_sum_spreads_a_position_that_many_rows_share(spark):
    rnd = random.Random(6)
    rows = [("g", None if i % 3 else i, rnd.randrange(5), i) for i in range(4000)] + [(None, None, 1, 9000 + i) for i in range(300)]
    table = spark.createDataFrame(rows, "g string, i long, v long, row long").withColumn("h", numbering.hash60(numbering.F.col("i")))
    got = numbering.sliced_running_sum(table, ["g"], "h", ["i"], "v", "s", rows_per_slice=40, spread="row").collect()
    assert len(got) == len(rows)
    for g in ("g", None):
        mine = sorted((r.s, r.v) for r in got if r.g == g)
        total = 0
        for s, v in sorted(mine, key=lambda x: (x[0], x[1])):
            assert s == total or v == 0
            total = max(total, s + v)
        assert total == sum(r[2] for r in rows if r[0] == g)


def test_prefix_sums_in_blocks(spark):
    rnd = random.Random(7)
    rows = [(rnd.choice("ab"), k, rnd.randrange(9)) for k in range(300)]
    got = numbering.prefix_sums(spark.createDataFrame(rows, "g string, k long, v long"), ["g"], "k", "v", "s", block=16).collect()
    assert all(r.s == sum(v for g, k, v in rows if g == r.g and k < r.k) for r in got) and len(got) == 300


def test_sliced_running_sum_is_a_running_sum(spark):
    rnd = random.Random(8)
    rows = [(rnd.choice("aaab"), i, rnd.randrange(9)) for i in range(3000)] + [(None, 1, 5), (None, 2, 6)]
    table = spark.createDataFrame(rows, "g string, i long, v long").withColumn("h", numbering.hash60(numbering.F.col("i")))
    got = {(r.g, r.i): r.s for r in numbering.sliced_running_sum(table, ["g"], "h", ["i"], "v", "s", rows_per_slice=50).collect()}
    by = defaultdict(list)
    for g, i, v in rows:
        by[g].append((int(hashlib.md5(str(i).encode()).hexdigest()[:15], 16), i, v))
    for g, group in by.items():
        total = 0
        for _, i, v in sorted(group):
            assert got[g, i] == total
            total += v


def plain_boundaries_cost(lengths, counts, k):
    """Least padding by the plain dynamic programme over all splits."""
    n, t = np.concatenate([[0], np.cumsum(counts)]), np.concatenate([[0], np.cumsum(np.array(counts) * lengths)])
    best = {0: 0}
    for _ in range(k):
        best = {i: min(c + (lengths[i - 1] * (n[i] - n[j]) - (t[i] - t[j]) if i > j else 0) for j, c in best.items() if j <= i) for i in range(len(lengths) + 1)}
    return int(best[len(lengths)])


def padding(lengths, counts, bounds):
    return int(sum(c * (min(b for b in bounds if b >= x) - x) for x, c in zip(lengths, counts)))


def test_boundaries_need_the_least_padding():
    rnd = np.random.default_rng(2)
    for _ in range(60):
        m, k = int(rnd.integers(1, 9)), int(rnd.integers(1, 5))
        lengths = sorted(rnd.choice(np.arange(0, 60), m, replace=False).tolist())
        counts = rnd.integers(1, 9, m).tolist()
        best = min(padding(lengths, counts, [*c, lengths[-1]]) for r in range(min(k, m)) for c in itertools.combinations(lengths[:-1], r))
        got = packing.best_boundaries(lengths, counts, k)
        assert len(got) <= k and got[-1] == lengths[-1] and padding(lengths, counts, got) == best
    assert packing.best_boundaries([], [], 3) == []


def test_boundaries_are_exact_for_long_documents():
    rnd = np.random.default_rng(4)
    for spread in [(8_900, 9_100, 150), (0, 20_000, 250), (1, 2_000_000, 120)]:
        lengths = sorted(set(rnd.integers(*spread).tolist()))
        counts = rnd.integers(1, 50, len(lengths)).tolist()
        for k in (1, 2, 6):
            assert padding(lengths, counts, packing.best_boundaries(lengths, counts, k)) == plain_boundaries_cost(lengths, counts, k)


def test_long_documents_are_packed_with_least_padding(spark):
    rnd = random.Random(5)
    sizes = [rnd.randrange(8_950, 9_050) for _ in range(120)] + [20_000, 3]
    got = packing.pack(docs(spark, [(i, "x " * n, "en", "s") for i, n in enumerate(sizes)]), buckets=6).collect()
    table = sorted(Counter(sizes).items())
    assert sum(r.padding for r in got) == plain_boundaries_cost([n for n, _ in table], [c for _, c in table], 6)


def test_packing_in_order_follows_the_files(spark, tmp_path):
    rows = some_docs()
    path = f"file://{tmp_path}/mixed"
    table = docs(spark, rows + rows[:200])
    table.orderBy(numbering.hash60(numbering.F.col("doc_id"))).write.parquet(path)
    read = spark.read.parquet(path)
    got = packing.pack_in_order(read, buckets=4, token_budget=1000).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows + rows[:200])
    assert len({r.place for r in got}) == len(got)
    order = [r.doc_id for r in sorted(got, key=lambda r: r.place)]
    assert order == [r.doc_id for r in read.select("doc_id", "_metadata.file_path", "_metadata.row_index").orderBy("file_path", "row_index").collect()]
    streams = defaultdict(list)
    for r in got:
        streams[r.bucket, r.reading].append((*map(int, r.batch_id.split(":")), r.slot, r.place, r.doc_id))
    for stream in streams.values():
        stream.sort()
        assert [x[4] for x in stream] == sorted(x[4] for x in stream)
    batches = defaultdict(list)
    for r in got:
        batches[r.batch_id].append(r)
    for batch in batches.values():
        assert len({r.doc_id for r in batch}) == len(batch) and sorted(r.slot for r in batch) == list(range(len(batch)))
        assert len(batch) <= max(1, 1000 // max(batch[0].boundary, 1))
    assert packing.pack_in_order(docs(spark, [])).count() == 0
    again = packing.pack_in_order(docs(spark, [(None, "a b", "en", None), (None, "a b", "en", None), (3, None, "en", "s")])).collect()
    assert sorted((r.n_words, r.reading) for r in again) == [(0, 1), (2, 1), (2, 2)]


def test_batches_hold_the_budget(spark):
    rows = some_docs()
    got = packing.pack(docs(spark, rows), buckets=4, token_budget=1000).collect()
    assert len(got) == len(rows)
    batches = defaultdict(list)
    for r in got:
        assert r.n_words == n_words(rows[r.doc_id][1]) and r.padding == r.boundary - r.n_words >= 0
        batches[r.batch_id].append(r)
    full = Counter()
    for name, batch in batches.items():
        per = max(1, 1000 // max(batch[0].boundary, 1))
        assert sorted(r.slot for r in batch) == list(range(len(batch))) and len(batch) <= per
        full[name.split(":")[0]] += len(batch) < per
    assert max(full.values()) <= 1
    tops = Counter(n_words(t) for _, t, _, _ in rows)
    lengths = sorted(tops)
    best = min(sum(n * (min(e for e in (*c, lengths[-1]) if e >= t) - t) for t, n in tops.items()) for r in range(4) for c in itertools.combinations(lengths[:-1], r))
    assert sum(r.padding for r in got) == best


def plain_measures(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(windows)
    covered = {p for i, w in enumerate(windows) if often[w] > 1 for p in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if n_words(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_measures_match_brute_force(spark):
    rnd = random.Random(3)
    texts = [" ".join(rnd.choice("abc") for _ in range(rnd.randrange(0, 30))).replace("b a", "b\na") for _ in range(150)]
    texts += [None, "", "a", "a b c", "a b c a b c", "a\n\na\n \n a\na", "é𝒳 # * | <>&%$\u000b x", "x " * 40_000, "u v w " * 20_000, "\n" * 1000]
    rows = [(i, t, "en", "s") for i, t in enumerate(texts)]
    got = {r.doc_id: r for r in quality.judge(docs(spark, rows)).collect()}
    for i, t in enumerate(texts):
        want = plain_measures(t)
        assert (got[i].n_words, got[i].word_chars, got[i].n_symbols, got[i].n_dup_lines, got[i].n_repeat_words) == want, t and t[:80]
        assert got[i].base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (got[i].base_failed and got[i].kept)
    assert quality.judge(docs(spark, [])).count() == 0


def test_fences_adapt_to_language_and_source(spark):
    rnd = random.Random(4)
    words = [f"word{k}" for k in range(900)]
    prose = lambda: " ".join(rnd.choice(words) for _ in range(120))
    code = lambda: " ".join(rnd.choice(words) + rnd.choice(["", "#"]) for _ in range(120))
    junk = lambda: " ".join(rnd.choice(words) + "###" for _ in range(120))
    rows = [(i, prose(), "en", "news") for i in range(100)] + [(100 + i, code(), "en", "code") for i in range(100)]
    rows += [(200, junk(), "en", "news"), (201, code(), "en", "news"), (202, code(), "en", "code"), (203, prose(), None, None)]
    table = docs(spark, rows)
    judged = quality.judge(table)
    kept = {r.doc_id for r in judged.collect() if r.kept}
    assert set(range(204)) - kept == {200, 201}
    good = quality.keep_good(table)
    assert good.columns == table.columns and {r.doc_id for r in good.collect()} == kept


def test_each_row_goes_by_its_own_text(spark):
    good = " ".join(f"word{k}" for k in range(60))
    rows = [(None, good, "en", "s"), (None, "short", "en", "s"), (5, good, None, None), (5, "x", None, None), (6, None, "en", "s"), (7, good, "en", "s"), (7, good, "en", "s")]
    kept = quality.keep_good(docs(spark, rows))
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([(None, good), (5, good), (7, good), (7, good)], key=str)
    assert [r.kept for r in quality.judge(docs(spark, rows)).collect()].count(True) == 4
    assert quality.keep_good(docs(spark, [])).count() == 0


def test_token_counts_and_cache(spark, tmp_path):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    plain = Tokenizer.from_file(path)
    texts = [None, "", "a", "a", "Hello world " * 300, "x<|endoftext|>y", "é𝒳 \n\n  z", "aaaa" * 20_000]
    rows = [(i, t, "en", "s") for i, t in enumerate(texts)]
    cache = f"file://{tmp_path}/cache"
    for _ in range(2):
        got = {r.doc_id: r for r in token_counts.count_tokens(docs(spark, rows), path, cache).collect()}
        for i, t in enumerate(texts):
            n = len(plain.encode(t or "", add_special_tokens=False).ids)
            assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len((t or "").encode()), n, n > 512)
        assert spark.read.parquet(cache).count() == len({t or "" for t in texts})
    more = token_counts.count_tokens(docs(spark, rows[:3] + [(50, "new one", "en", "s")]), path, cache)
    assert more.count() == 4 and spark.read.parquet(cache).count() == len({t or "" for t in texts}) + 1
    assert token_counts.count_tokens(docs(spark, []), path, cache).count() == 0
    twice = token_counts.count_tokens(docs(spark, [(None, "a", "en", "s"), (None, "b c", "en", "s"), (3, "a", "en", "s"), (3, "a", "en", "s")]), path, cache).collect()
    assert sorted(str(r.doc_id) for r in twice) == ["3", "3", "None", "None"]


def test_only_misses_are_sent_to_the_tokenizer(spark, tmp_path, monkeypatch):
    P = pytest.importorskip("public_tokenizers")
    sent = []
    real = token_counts.with_lookup
    monkeypatch.setattr(token_counts, "with_lookup", lambda df, lookup, on, how: sent.append(lookup.count()) or real(df, lookup, on, how))
    cache, path = f"file://{tmp_path}/cache", P.path("byte_bpe_50k.json")
    for rows, misses in [([(1, "a", "en", "s"), (2, "b", "en", "s")], None), ([(1, "a", "en", "s"), (2, "b", "en", "s")], 0), ([(1, "a", "en", "s"), (3, "new", "en", "s"), (4, "new", "en", "s")], 1)]:
        assert token_counts.count_tokens(docs(spark, rows), path, cache).count() == len(rows)
        assert sent == ([] if misses is None else [misses])
        sent.clear()
    assert spark.read.parquet(cache).count() == 3


def test_pipeline_matches_brute_force(spark, tmp_path):
    """Null ids, repeated ids and rows, copies and near copies; every stage is written and read again, as in a run."""
    import corpus_pipeline

    rnd = random.Random(9)
    words = [f"w{k}" for k in range(400)]
    rows = []
    for i in range(60):
        text = [rnd.choice(words) for _ in range(rnd.choice([20, 200, 300]))]
        name = rnd.choice([None, 3, *[len(rows)] * 8])
        rows.append((name, " ".join(text), "en", rnd.choice("ab")))
        rows += [rows[-1]] * rnd.choice([0, 0, 0, 1])
        for _ in range(rnd.choice([0, 0, 2])):
            rows.append((len(rows), " ".join(text), "en", rnd.choice("ab")))
        if rnd.random() < 0.4:
            text[5] = "w1"
            text[9:11] = []
            rows.append((len(rows), " ".join(text), "en", "b"))
    steps = [docs(spark, rows)]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, steps[-1], "").write.parquet(f"file://{tmp_path}/{k}")
        steps.append(spark.read.parquet(f"file://{tmp_path}/{k}"))
    assert all(s.columns == steps[0].columns for s in steps[:-1])
    pairs = lambda s: sorted(((r.doc_id, r.text) for r in s.collect()), key=str)
    good = [(i, t) for i, t, _, _ in rows if n_words(t) >= 50]
    assert pairs(steps[1]) == sorted(good, key=str)
    last = {}
    for i, t in good:
        last[t] = max((j for j in (i, last.get(t)) if j is not None), default=None)
    unique = sorted(((i, t) for t, i in last.items()), key=str)
    assert pairs(steps[2]) == unique
    near = pairs(steps[3])
    assert near == sorted(plain_near(unique), key=str) and len(near) < len(unique)
    planned = Counter()
    for r in mixing.plan_mix(steps[3], whole=True).collect():
        planned[r.doc_id, r.size] += len(r.passes)
    assert Counter((r.doc_id, n_words(r.text)) for r in steps[4].collect()) == +planned
    packed = steps[5].collect()
    assert Counter((r.doc_id, r.n_words) for r in packed) == +planned
    assert len({(r.batch_id, r.slot) for r in packed}) == len(packed)


def test_whole_readings_match_brute_force(spark):
    rows = some_docs()
    sizes, passes = Counter(), Counter()
    for i, t, _, s in rows:
        sizes[s] += n_words(t)
    target = plain_targets(sizes)
    for s in sizes:
        before = 0
        order = sorted((r for r in rows if r[3] == s), key=lambda r: hashlib.md5(str(r[0]).encode()).hexdigest()[:15])
        for _, (i, t, _, _) in itertools.product(range(2), order):
            size = n_words(t)
            passes[i] += size > 0 and 2 * before + size <= 2 * int(target[s] + 0.5)
            before += size
    assert Counter(r.doc_id for r in mixing.apply_mix(docs(spark, rows)).collect()) == +passes


def test_run_of_an_empty_table(spark, tmp_path):
    import corpus_pipeline

    docs(spark, []).write.parquet(f"file://{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, f"file://{tmp_path}").count() == 0
