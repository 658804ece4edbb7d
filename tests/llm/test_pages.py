"""URL filter and main-text extraction."""

import json

from sceneloom.llm import html_extract, url_filter

PAGES = "page_id long, url string, html string, host string, path string, text string"


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", "y", "z") for i, u, h in rows], PAGES)


def plain_host_path(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    n = min([rest.index(c) for c in "/?#" if c in rest] + [len(rest)])
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:n])
    tail = rest[n:]
    m = min([tail.index(c) for c in "?#" if c in tail] + [len(tail)])
    return host, tail[:m]


def plain_rule(host, path):
    best = None
    for v, h, p in [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[0])):
            best = (h + p, v)
    return best or (None, None)


URLS = [None, "", "nothing", "http://", "http://A.Example.NET/en/1?x=1", "http://a.example.net/de/", "https://notexample.net/en/", "http://net/", "http://net", "http://x.org/fr/2#a",
        "http://x.org/fr", "http://example.com/de/x", "http://ÄB.example.com/de/", "http://b.example.com/en/de/", "a://b://c/net/", "http://h.com?q://x/", "http://h\nost.net/\n", "HTTP://U.COM#f"]


def test_hosts_paths_and_list_rules(spark):
    got = {r.page_id: r for r in url_filter.judge_urls(pages(spark, [(i, u, None) for i, u in enumerate(URLS)]), spark.createDataFrame([], "page_id long, bad int")).collect()}
    assert len(got) == len(URLS)
    for i, u in enumerate(URLS):
        host, path = plain_host_path(u)
        rule, verdict = plain_rule(host, path)
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == (host, path, rule, verdict or "allow"), u


def test_mined_rules_block_what_labels_say(spark):
    rows = [(i, f"http://{'casino' if i % 4 == 0 else 'paper'}{i % 3}.com/{'win' if i % 4 == 0 else 'en'}/{i}?ref=a", None) for i in range(200)]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(0, 200, 1) if i < 120] + [(7, None), (9_999, 1)], "page_id long, bad int")
    got = url_filter.judge_urls(pages(spark, rows), labels).collect()
    assert {r.page_id for r in got if r.verdict == "block"} == {i for i in range(200) if i % 4 == 0}
    assert url_filter.judge_urls(pages(spark, []), labels).count() == 0


def plain_met(token_sets, rules):
    out = {}
    for key, have in token_sets.items():
        fit = [(c, s, i) for i, need, c, s in rules if set(need) <= set(have)]
        if fit:
            out[key] = max(fit)[2]
    return out


def test_inverted_index_finds_what_comparing_all_finds(spark):
    import random

    rnd = random.Random(2)
    names = [f"t{i}" for i in range(12)]
    sets = {str(k): sorted(rnd.sample(names, rnd.randrange(0, 7))) for k in range(120)}
    rules = [(f"r{k}", sorted(rnd.sample(names, rnd.randrange(1, 4))), rnd.choice([0.8, 0.9]), rnd.choice([0.1, 0.2])) for k in range(25)]
    got = url_filter.met_rules(spark.createDataFrame(list(sets.items()), "key string, tokens array<string>"),
                               spark.createDataFrame(rules, "rule_id string, tokens array<string>, confidence double, support double"))
    assert {r.key: r.rule_id for r in got.collect()} == plain_met(sets, rules)


def plain_rules(rows, m):
    """All token sets that say bad, without those that hold an equally confident smaller one."""
    from itertools import combinations

    n, bad = len(rows), sum(b for _, b in rows)
    least = max(m.support, m.pages / n) * n
    tokens = sorted({t for r, _ in rows for t in r})
    found = {}
    for k in range(1, len(tokens) + 1):
        for c in combinations(tokens, k):
            have = [b for r, b in rows if set(c) <= set(r)]
            if sum(have) >= least and sum(have) / len(have) >= m.confidence and sum(have) / len(have) / (bad / n) >= m.lift:
                found[c] = sum(have) / len(have)
    return {c: f for c, f in found.items() if not any(found.get(p, -1) >= f for k in range(1, len(c)) for p in combinations(c, k))}


def test_mined_rules_match_brute_force(spark):
    import random

    import pytest

    rnd = random.Random(12)
    mining = url_filter.Mining(support=0.02, pages=4, confidence=0.7, lift=1.2)
    some = 0
    for seed in range(3):
        rows = []
        for _ in range(150):
            tokens = {t for t in "abcdefg" if rnd.random() < 0.35}
            if rnd.random() < 0.3:
                tokens |= {"x1", "x2", "x3"}  # always together
            bad = ("a" in tokens and "b" in tokens) or ("x1" in tokens and "c" in tokens) or rnd.random() < 0.15
            rows.append((sorted(tokens), bad))
        rows += rows[:10]
        got = {tuple(r.tokens): r.confidence for r in url_filter.mine_rules(spark.createDataFrame(rows, "tokens array<string>, bad boolean"), mining).collect()}
        want = plain_rules(rows, mining)
        assert got.keys() == want.keys() and all(got[c] == pytest.approx(f) for c, f in want.items())
        some += len(want)
    assert some > 5


def test_long_hosts_nulls_and_repeated_pages(spark):
    long = ".".join(f"l{k}" for k in range(150)) + ".com"
    table = spark.createDataFrame([(long,)], "host string").select(url_filter.url_tokens(url_filter.F.lit(""), url_filter.F.col("host"), url_filter.F.lit("/")).alias("t")).first().t
    assert "h:" + long in table and "h:com" in table and len(table) == 151
    rows = [(None, f"http://{long}/a", None), (7, "http://x.net/en/", None), (7, "http://x.net/en/", None), (8, "http://x.com/" + "a/" * 5_000, None)]
    got = url_filter.judge_urls(pages(spark, rows), spark.createDataFrame([(None, True), (7, False)], "page_id long, bad boolean")).collect()
    assert len(got) == 4 and sorted(r.verdict for r in got) == ["allow", "allow", "block", "block"]


def test_many_redundant_rules_push_out_no_general_one(spark):
    """18 groups of 12 tokens on bad pages only give 5,364 rules of at most three tokens at confidence 1."""
    groups = [[f"g{g:02d}t{k:02d}" for k in range(12)] for g in range(18)]
    rows = [(g, True) for g in groups] * 22 + [(["general"], True)] * 36 + [(["general"], False)] * 4 + [(["other"], False)] * 400
    labelled = spark.createDataFrame(rows, "tokens array<string>, bad boolean")
    got = {r.rule_id: r.confidence for r in url_filter.mine_rules(labelled).collect()}
    assert got == {**{t: 1.0 for g in groups for t in g}, "general": 0.9}


HEAD = '<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/a">A</a></li><li><a href="/b">B</a></li></ul></nav><!-- ad 1 -->'
TAIL = '<footer>&copy; host &middot; words</footer></body></html>'


def test_article_without_its_surroundings(spark):
    inner = '<div class="ad">Buy.</div><article><h1>Head &amp; line</h1><p><b>One  two\n three.<br><p>Four &quot;five&quot; &lt;six&gt;</p><div class="share">Share</div><form><p>Mail?</p></form></article>'
    more = '<section id="comments"><article class="comment"><p>First!</p></article></section><aside><p>Side</p></aside>'
    want = 'Head & line\nOne two three.\nFour "five" <six>'
    rows = [(1, "http://h.com/1", HEAD + inner + TAIL), (2, "http://h.com/2", HEAD + inner + more + TAIL), (3, "http://h.com/3", None), (4, None, ""), (5, None, "plain  text"),
            (6, "http://h.com/6", HEAD + "<article><p>Cut off &am"), (6, "http://h.com/6", HEAD + "<article></article>" + TAIL)]
    got = sorted((r.page_id, r.url, r.text, r.n_chars) for r in html_extract.extract(pages(spark, rows)).collect() if r.url) 
    assert [(g[0], g[2]) for g in got] == [(1, want), (2, want), (3, ""), (6, ""), (6, "Cut off &am")]
    assert all(g[3] == len(g[2]) for g in got)
    assert html_extract.extract(pages(spark, [])).count() == 0


def test_pages_without_an_article_element(spark):
    body = lambda i: f'<div id="menu"><a href="/">Home</a></div><div class="wrap"><div class="content"><p>Text {i} one two three four.</p><ul><li>x<li>y</ul></div><div class="sidebar"><p>More</p></div></div><div class="cookie-notice">We use cookies</div>'
    bare = lambda i: f'<div><a href="/">Home</a> <a href="/b">About us</a></div><div><p>Long text {i} one two three.</p><p>Second paragraph {i}.</p></div>'
    rows = [(i, "http://a.com/", HEAD + body(i) + TAIL) for i in range(4)] + [(10 + i, "http://b.com/", HEAD + bare(i) + TAIL) for i in range(4)]
    got = {r.page_id: r.text for r in html_extract.extract(pages(spark, rows)).collect()}
    assert got[2] == "Text 2 one two three four.\nx\ny"
    assert got[12] == "Long text 2 one two three.\nSecond paragraph 2."


def covers(wrapper, tokens):
    """Whether a union-free expression (optional runs, repeated groups) matches a whole list of tokens, by trying everything."""
    def ends(w, at):
        if not w:
            return {at}
        head, rest = w[0], w[1:]
        if isinstance(head, str):
            return ends(rest, at + 1) if at < len(tokens) and tokens[at] == head else set()
        once = ends(list(head[1:]), at)
        if head[0] == "?":
            # what is optional may be there in part, as several pages' options can stand in one run
            found = parts(list(head[1:]), at)
        else:
            found, new = set(once), set(once)
            while new:
                new = {e for a in new for e in ends(list(head[1:]), a)} - found
                found |= new
        return {e for a in found for e in ends(rest, a)}

    def parts(w, at):
        found = {at}
        for x in w:
            found |= {e for a in found for e in ends([x], a)}
        return found

    return len(tokens) in ends(wrapper, 0)


def plain_common(a, b):
    """Length of the longest common subsequence."""
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for k, y in enumerate(b):
            new.append(row[k] + 1 if x == y else max(row[k + 1], new[-1]))
        row = new
    return row[-1]


def small_streams():
    import random

    rnd = random.Random(4)
    part = lambda: rnd.choice(["<p>x</p>", "<h2>h</h2>", "<ul><li>a</li><li>b</li></ul>", "<div><p>q</p></div>", "<pre>c</pre>"])
    return [html_extract.read_page("<main>" + "".join(part() for _ in range(rnd.randrange(1, 6))) + "</main>")[1] for _ in range(60)]


def test_wrappers_are_union_free_and_cover_their_pages():
    streams = small_streams()
    for group in (streams[k : k + 4] for k in range(0, 60, 4)):
        wrapper = html_extract.merge_shapes([json.dumps(html_extract.fold(t)) for t in group])
        assert "|" not in html_extract.spell(wrapper)
        for t in group:
            assert covers(html_extract.fold(t), t) and covers(wrapper, t)


def test_every_token_finds_its_place_in_order_as_a_best_alignment_does():
    streams = [html_extract.fold(t) for t in small_streams()]
    for group in (streams[k : k + 3] for k in range(0, 60, 3)):
        wrapper = html_extract.merge_shapes([json.dumps(t) for t in group])
        flat = html_extract._flat(wrapper)
        for t in group:
            got = html_extract.places(json.dumps(wrapper), json.dumps(t))
            assert all(flat[a] == x for a, x in zip(got, t))
            if plain_common(flat, t) == len(t):
                assert list(got) == sorted(set(got))


def test_wrappers_are_union_free_expressions():
    a = html_extract.fold(html_extract.read_page("<ul><li>a</li><li>b</li></ul><p>x</p>")[1])
    b = html_extract.fold(html_extract.read_page("<ul><li>a</li><li>b</li><li>c</li></ul><div>ad</div><p>x</p><p>y</p>")[1])
    assert html_extract.spell(a) == "+ul ( +li # -li )+ -ul +p # -p"
    merged = html_extract.spell(html_extract.align(a, b))
    assert "( +li # -li )+" in merged and ")?" in merged and "|" not in merged


def test_large_hosts_have_several_wrappers(spark, monkeypatch):
    monkeypatch.setattr(html_extract, "PAGES_PER_WRAPPER", 10)
    body = lambda i: "<main>" + "".join(f"<h{1 + (i >> b) % 2}>x</h{1 + (i >> b) % 2}>" for b in range(5)) + f"<p>Text of page {i}.</p></main>"
    rows = [(i, f"http://h.com/{i}", HEAD + body(i) + TAIL) for i in range(32)] + [(40, "http://g.com/", HEAD + body(0) + TAIL)]
    table = html_extract.with_units(pages(spark, rows).drop("host").withColumn("host", url_filter.host_of(url_filter.F.col("url"))))
    got = html_extract.infer_wrappers(table).collect()
    assert sum(r.pages for r in got if r.host == "h.com") == 32 and len([r for r in got if r.host == "h.com"]) == 4
    assert all(r.region and "|" not in r.wrapper for r in got)
    texts = {r.page_id: r.text for r in html_extract.extract(pages(spark, rows)).collect()}
    assert all(texts[i].endswith(f"Text of page {i}.") for i in range(32))


NEUTRAL = """<html><body><div><div><a href="/">Home</a><a href="/a">About</a></div><div>{notice}</div><div><div><h1>{head}</h1>{body}</div><div>{teaser}</div></div></div></body></html>"""
WORDS = "sun moon river stone cloud harbour window letter garden winter music paper bridge forest signal candle".split()


def neutral_host(n, seed=1):
    """Pages without article, main or telling names: a long notice that never changes, link lists, and a text that varies."""
    import random

    rnd = random.Random(seed)
    say = lambda k: " ".join(rnd.choice(WORDS) for _ in range(k)) + "."
    notice = "<p>" + "This site keeps small files on your device to remember what you chose. " * 6 + "</p>"
    out = []
    for i in range(n):
        body = [say(rnd.randrange(8, 15)) for _ in range(rnd.randrange(1, 4))]
        head = f"{say(3)} {i}"
        teaser = "".join(f'<p><a href="/t{k}">{say(6)}</a></p>' for k in range(3))
        out.append((NEUTRAL.format(notice=notice, head=head, body="".join(f"<p>{b}</p>" for b in body), teaser=teaser), "\n".join([head, *body])))
    return out


def test_slots_decide_where_names_say_nothing(spark):
    host = neutral_host(12)
    got = {r.page_id: r.text for r in html_extract.extract(pages(spark, [(i, f"http://n.com/{i}", h) for i, (h, _) in enumerate(host)])).collect()}
    assert got == {i: want for i, (_, want) in enumerate(host)}
    alone = {r.page_id: r.text for r in html_extract.extract(pages(spark, [(1, "http://one.com/", host[1][0])])).collect()}
    assert "small files" in alone[1]  # one page cannot tell


def judged(host):
    """Verdict on pages given as html, without Spark."""
    shaped = []
    for html in host:
        blocks, at, own, shape = html_extract.read_shape(html)
        elements, marks = {}, []
        for b, token in zip(blocks, at):
            e = elements.setdefault((b.path, tuple(own[i] for i in b.opens), b.hidden, b.named), len(elements))
            marks.append({"at": token, "element": e, "text": html_extract._number(b.text), "chars": len(b.text), "linked": b.linked})
        shaped.append((shape, [dict(zip(("path", "opens", "hidden", "named"), e)) for e in elements], marks))
    return shaped


def test_texts_come_through_the_wrapper():
    host = neutral_host(12)
    shaped = judged([h for h, _ in host])
    v = html_extract.judge_pages(shaped)
    cuts = frozenset((s, html_extract._element_number(e), t) for s, e, t in v["cuts"])
    for html, want in host:
        assert html_extract.main_text(html, v["plan"], v["region"], v["names"], cuts) == want
        assert html_extract.main_text(html, "[]", v["region"], v["names"], cuts) == ""
        assert html_extract.main_text(html, json.dumps(["+p", "#", "-p"]), v["region"], v["names"], cuts) != want
    garbage = html_extract.judge_pages(shaped, wrapper=["GARBAGE"])
    assert garbage["region"] is None and not garbage["cuts"]


def test_names_alone_drop_no_article_text(spark):
    one = '<article><p>Body one two</p><section class="related-work"><p>Earlier studies of rivers.</p></section><div class="text-ad-free"><p>Third part {i}.</p></div></article>'
    rows = [(i, f"http://a.com/{i}", HEAD + one.format(i=i) + TAIL) for i in range(3)]
    # all of the text is in an element that is called a notice: names do not count there
    rows += [(10 + i, f"http://b.com/{i}", HEAD + f'<div class="notice"><h1>Head {i}</h1><p>The whole text {i} of the page.</p></div>' + TAIL) for i in range(3)]
    got = {r.page_id: r.text for r in html_extract.extract(pages(spark, rows)).collect()}
    for i in range(3):
        assert got[i] == f"Body one two\nEarlier studies of rivers.\nThird part {i}."
        assert got[10 + i] == f"Head {i}\nThe whole text {i} of the page."


def test_long_nested_and_repeated_pages(spark):
    long = "<article>" + "".join(f"<p>Line {k} of many.</p>" for k in range(6_000)) + "</article>"
    deep = "<div>" * 500 + "<p>Deep down.</p>" + "</div>" * 500
    rows = [(1, "http://l.com/", HEAD + long + TAIL), (2, "http://d.com/", HEAD + deep + TAIL), (None, "http://e.com/", "<p>No number</p>"), (None, "http://e.com/", "<p>No number</p>"),
            (3, "nothing", "<p>No host</p>"), (4, None, None)]
    got = html_extract.extract(pages(spark, rows)).collect()
    texts = sorted((str(r.page_id), r.text) for r in got)
    assert len(got) == 6 and ("2", "Deep down.") in texts and texts.count(("None", "No number")) == 2 and ("3", "No host") in texts and ("4", "") in texts
    assert next(r.text for r in got if r.page_id == 1).split("\n") == [f"Line {k} of many." for k in range(6_000)]
    again = html_extract.extract(pages(spark, rows[::-1]).repartition(5)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_what_a_host_repeats_in_neutral_elements_is_no_main_text(spark):
    notice, sale = "<p>All rights belong to their owners.</p>", "<div>Today only: one for two.</div>"
    body = lambda i: f"<article><h1>Head {i}</h1>{sale}<p>First {i}.</p><p>Second {i} is a longer text than what is repeated on every page, as it should be.</p>{notice}{'<p>More.</p>' * (i % 2)}</article>"
    one = "<article><p>The very same text.</p><p>Its second part.</p></article>"
    near = lambda i: f"<article><p>One long text in many versions, told apart by a number.</p><p>{i}</p></article>"
    rows = [(i, "http://a.com/", HEAD + body(i) + TAIL) for i in range(8)]
    rows += [(10 + i, "http://b.com/", HEAD + one + TAIL) for i in range(8)] + [(20 + i, "http://c.com/", HEAD + near(i) + TAIL) for i in range(8)]
    rows += [(30 + i, "http://d.com/", HEAD + body(i) + TAIL) for i in range(3)]
    got = {r.page_id: r.text for r in html_extract.extract(pages(spark, rows)).collect()}
    for i in range(8):
        assert got[i].split("\n")[:3] == [f"Head {i}", f"First {i}.", f"Second {i} is a longer text than what is repeated on every page, as it should be."]
        assert got[i].split("\n")[3:] == ["More."] * (i % 2)
        assert got[10 + i] == "The very same text.\nIts second part."
        assert got[20 + i] == f"One long text in many versions, told apart by a number.\n{i}"
    assert "All rights" in got[30] and "Today only" in got[30]  # too few pages to tell


def test_a_rule_may_need_four_tokens_and_blocks(spark):
    from itertools import product

    words = ("alpha", "beta", "gamma", "delta")
    pages, labels, number = [], [], 0
    for chosen in product([False, True], repeat=4):
        for _ in range(30):
            number += 1
            path = "/".join(w for w, c in zip(words, chosen) if c)
            pages.append((number, f"http://h{number % 7}.test/{path}/{number}", "x", 1))
            labels.append((number, all(chosen)))
    seen = spark.createDataFrame(labels, "page_id long, bad boolean")
    more = [(9001, "http://new.test/delta/gamma/beta/alpha", "x", 1), (9002, "http://new.test/alpha/beta/gamma", "x", 1), (9003, "http://a.example.net/en/alpha/beta/gamma/delta", "x", 1), (9004, None, "x", 1)]
    table = spark.createDataFrame(pages + more, "page_id long, url string, tokens string, key int")
    got = {r.page_id: r for r in url_filter.judge_urls(table, seen).collect()}
    assert got[9001].verdict == "block" and sorted(got[9001].mined_rule.split()) == sorted(f"p:{w}" for w in words)
    assert got[9002].verdict == "allow" and got[9003].verdict == "allow" and got[9003].rule and got[9004].verdict == "allow"
    assert {i: got[i].verdict == "block" for i, _ in labels} == dict(labels)


def test_sections_of_an_article_stay_whatever_they_are_called(spark):
    body = lambda i, w: " ".join(f"{w}{i} word{k}" for k in range(40))
    html = [
        f"<html><body><nav>Home</nav><article><h1>Title {i}</h1><section class='methods'><p>{body(i, 'm')}</p></section><section class='discussion'><h2>Talk {i}</h2><p>{body(i, 'd')}</p></section>"
        f"<section id='search'><p>{body(i, 's')}</p></section><section class='related'><a href='/x{i}'>other text number {i}</a></section><div class='comments'><p>{body(i, 'c')}</p></div></article></body></html>"
        for i in range(8)
    ]
    table = spark.createDataFrame([(i, f"http://one.test/{i}", h) for i, h in enumerate(html)], "page_id long, url string, html string")
    for r in html_extract.extract(table).collect():
        i = r.page_id
        assert r.text.split("\n") == [f"Title {i}", body(i, "m"), f"Talk {i}", body(i, "d"), body(i, "s")]
