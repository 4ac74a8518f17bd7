import collections
import datetime as dt
import itertools
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.oracle import DATA, connect, same
from tidemark.llm import golay, leaks, nearcopies, nearest, packing, queries, repeats, spam, wrappers
from tidemark.llm.components import components, groups, splits

WORD = re.compile(r"[^\W_]+")
RECORDS = "record_id bigint, source string, title string, author string, body string, line_no int, text string"


def records(spark, rows):
    return spark.createDataFrame([(i, s, t, a, b, 0, "clash") for i, s, t, a, b in rows], RECORDS)


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
@pytest.mark.parametrize("name", queries.SQL)
def test_query_equals_sql(spark, name):
    same(spark, connect(), queries.QUERIES[name], queries.SQL[name])


def test_a_site_does_not_depend_on_other_sites(spark, monkeypatch):
    monkeypatch.setattr(wrappers, "BLOCK_PAGES", 20)
    rng = random.Random(11)
    rows = [(i, "own", f"Title {i}", None, page(rng, i)[0]) for i in range(12)]
    others = [(1000 + i, "other", None, None, f"Nothing{i} like{i} this{i} was{i} seen{i} before.") for i in range(4000)]
    alone = {tuple(r) for r in wrappers.boilerplate(records(spark, rows)).collect()}
    among = {tuple(r) for r in wrappers.boilerplate(records(spark, rows + others)).where("record_id < 1000").collect()}
    assert len(alone) >= 12 * 8 and among == alone


def test_a_line_counts_in_all_pages_that_have_it(spark, monkeypatch):
    monkeypatch.setattr(wrappers, "SHARE", 0.05)
    notice = "This notice is shown on some pages of the site and nowhere else. It has two sentences."
    unlike = lambda i: "\n".join(f"Nothing{i}x{k} like{i}x{k} this{i}x{k} was{i}x{k} seen{i}x{k} before{i}x{k}." for k in range(4))
    spell = str.maketrans("0123456789", "abcdefghij")
    rows = [(i, "own", None, None, unlike(i).translate(spell) + ("\n" + notice if i % 17 == 0 else "")) for i in range(1000)]
    got = {tuple(r) for r in wrappers.boilerplate(records(spark, rows)).collect()}
    assert got == {(i, 5) for i in range(0, 1000, 17)}


# Nearest time


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(-10**6, 10**6), min_size=0, max_size=400), st.lists(st.integers(-(10**6), 10**6), min_size=1, max_size=60))
def test_learned_positions(times, probes):
    t = np.unique(np.array(times, dtype=np.int64))
    p = np.array(probes, dtype=np.int64)
    got = nearest.positions(p, t, nearest.fit_segments(t, 4), 4) if len(t) else nearest.positions(p, t, (t, t.astype(float), t), 4)
    assert got.tolist() == np.searchsorted(t, p, side="right").tolist()


def test_what_a_template_needs_does_not_grow_with_the_site(spark, monkeypatch):
    monkeypatch.setattr(wrappers, "SHARE", 0.5)
    unlike = lambda i: "\n".join(f"Nothing{i}x{k} like{i}x{k} this{i}x{k} was{i}x{k} seen{i}x{k} before{i}x{k}." for k in range(4))
    spell = str.maketrans("0123456789", "abcdefghij")
    rows = [(i, "own", None, None, unlike(i).translate(spell) + ("\nThis notice is in one section only. It has two sentences." if i % 17 == 0 else "")) for i in range(1000)]
    assert {tuple(r) for r in wrappers.boilerplate(records(spark, rows)).collect()} == {(i, 5) for i in range(0, 1000, 17)}


def test_a_rare_line_is_aligned_among_its_own_pages(spark):
    """A line in ten of three thousand pages is hardly met by partners taken at random; its pages are compared with each other. Copies of one text are no evidence."""
    unlike = lambda i: "\n".join(f"Nothing{i}x{k} like{i}x{k} this{i}x{k} was{i}x{k} seen{i}x{k} before{i}x{k}." for k in range(4))
    spell = str.maketrans("0123456789", "abcdefghij")
    rows = [(i, "own", None, None, unlike(i).translate(spell) + ("\nA notice that only very few pages of this site have. It is long." if i % 300 == 7 else "")) for i in range(3000)]
    rows += [(5000 + k, "own", None, None, unlike(5000).translate(spell)) for k in range(12)]
    assert {tuple(r) for r in wrappers.boilerplate(records(spark, rows)).collect()} == {(i, 5) for i in range(7, 3000, 300)}


@pytest.mark.parametrize("part", [4096, 40])
def test_a_rare_line_is_aligned_with_all_pages_that_have_it(spark, monkeypatch, part):
    """Of 308 pages with a line 300 tell what each of the others tells a half of; only four of one half and four of the other are evidence, and
    they are hardly ever neighbours. Two and two are too few.
    """
    monkeypatch.setattr(wrappers, "PART", part)
    spell = str.maketrans("0123456789", "abcdefghij")
    unlike = lambda i, n=4: "\n".join(f"Nothing{i}x{k} like{i}x{k} this{i}x{k} was{i}x{k} seen{i}x{k} before{i}x{k}." for k in range(n)).translate(spell)
    rows = [(i, "own", None, None, unlike(i)) for i in range(3000)]
    for at, whole, half, line in ((4000, 300, 4, "A notice that few pages of this site have. It is long."), (5000, 30, 2, "Another notice of very few pages. It is long as well.")):
        texts = [unlike(at) + "\n" + unlike(at + 500)] * whole + [unlike(at)] * half + [unlike(at + 500)] * half
        rows += [(at + k, "own", None, None, unlike(at + 5000 + k, 1) + "\n" + t + "\n" + line) for k, t in enumerate(texts)]
    assert {tuple(r) for r in wrappers.boilerplate(records(spark, rows)).collect()} == {(4000 + k, 10 if k < 300 else 6) for k in range(308)}


def test_evidence_equals_alignment_of_all_pairs(monkeypatch):
    monkeypatch.setattr(wrappers, "RARE", 10**9)
    rng = random.Random(8)
    bodies = ["\n".join(rng.sample([f"line {'abcdefghijklmnopqrst'[k] * 9}" for k in range(20)], rng.randrange(1, 9))) for _ in range(150)]
    batch = wrappers.pd.DataFrame({"record_id": range(150), "src": 1, "title": None, "author": None, "body": bodies})
    pages = list(dict.fromkeys(next(wrappers.encode(iter([batch])))["nodes"]))
    label = wrappers.decode(pages[0])[1][0]
    pages = [p for p in pages if label in wrappers.decode(p)[1]]
    want = {False: set(), True: set()}
    for x, y in itertools.combinations(range(len(pages)), 2):
        a, b = wrappers._Page(pages[y]), wrappers._Page(pages[x])
        wrappers.match(a, b)
        for own in (True, False):
            if label in a.matched and (own or x % 3 != y % 3):
                want[own] |= {x, y}
    assert want[True]
    for own in (True, False):
        assert set(wrappers.evidence(pages, [1] * len(pages), [k % 3 for k in range(len(pages))], label, own)) == want[own]


def test_paths_and_bylines_need_other_pages(spark):
    """A line with the page's own title or author is template only if other pages of the site have it, with their titles and authors, in the same frame."""
    rng = random.Random(21)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(8))
    said = lambda: ". ".join(" ".join(word() for _ in range(9)).capitalize() for _ in range(3)) + "."
    rows = []
    for i in range(8):
        title, author = f"{word().capitalize()} {word()} {word()}", f"{word().capitalize()} {word().capitalize()}"
        top = [f"Home > News > {title}", author] if i < 6 else []
        rows.append((i, "site" if i < 7 else "other", title, author, "\n".join([*top, said(), said()])))
    rows.append((9, "alone", "A title of its own kind", "Somebody Else", "Away > A title of its own kind\nhere: Somebody Else\n" + said()))
    assert {tuple(r) for r in wrappers.boilerplate(records(spark, rows)).collect()} == {(i, k) for i in range(6) for k in (1, 2)}


def test_index_error_is_bounded():
    t = np.unique(np.concatenate([np.arange(10**5), 10**6 + np.random.default_rng(0).integers(0, 10**9, 10**5)]))
    keys, slopes, firsts = nearest.fit_segments(t)
    seg = np.searchsorted(keys, t, side="right") - 1
    assert np.abs(firsts[seg] + slopes[seg] * (t - keys[seg]) - np.arange(len(t))).max() <= nearest.ERROR + 1e-6
    assert len(keys) < len(t) / 20


def brute_nearest(left, right, tol):
    out = set()
    for i, e, t in left:
        if None in (i, e, t):
            continue
        c = [(abs(rt - t), j) for j, re_, rt in right if None not in (j, re_, rt) and re_ == e and abs(rt - t) <= tol]
        if c:
            out.add((i, min(c)[1]))
    return out


@pytest.mark.parametrize("shard", [3, 10**6])
def test_nearest_time_join(spark, shard):
    rng = random.Random(5)
    right = [(j, rng.choice(["hot", "hot", "b", None]), rng.choice([rng.randrange(1000), 500, None])) for j in range(200)]
    left = [(i, rng.choice(["hot", "b", "c", None]), rng.choice([rng.randrange(-50, 1100), None])) for i in range(300)]
    l = spark.createDataFrame([(*x, 1) for x in left + left[:20]], "left_id bigint, entity string, t bigint, slot int")  # noqa: E741
    r = spark.createDataFrame([(*x, 1) for x in right], "right_id bigint, entity string, t bigint, slot int")
    assert set(map(tuple, nearest.nearest_time_join(l, r, 7, shard).collect())) == brute_nearest(left, right, 7)
    assert nearest.nearest_time_join(l.limit(0), r, 7).collect() == [] == nearest.nearest_time_join(l, r.limit(0), 7).collect()


# Components and splits


def labels(edges):
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[root(a)] = root(b)
    return {x: root(x) for x in list(parent)}


@pytest.mark.parametrize(("small", "hub"), [(0, 20), (0, 10**5), (10**6, 7), (10**6, 10**5)])
def test_components(spark, small, hub, monkeypatch):
    monkeypatch.setattr("tidemark.llm.components.SMALL_GRAPH", small)
    rng = random.Random(3)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(k, k + 1) for k in range(500, 560)] + [(900, k) for k in range(901, 1000)] + [(7000, 7000), (None, 3)]
    edges = [tuple(x and x * 0x3C5A79B1E8F3 - 2**58 for x in e) for e in edges]  # numbers that a double can't hold
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a bigint, b bigint"), hub=hub).collect()}
    want = labels([e for e in edges if None not in e])
    assert got.keys() == want.keys()
    pairs = collections.defaultdict(set)
    for n, c in got.items():
        pairs[want[n]].add(c)
    assert all(len(v) == 1 for v in pairs.values()) and len({min(v) for v in pairs.values()}) == len(pairs)


ROWS = "row_id bigint, event_id string, author_handle string, component string, split string"


def test_groups_and_splits(spark):
    rows = [(1, "E1 ", "@Ann", "x", "x"), (2, "e2", " ann", "x", "x"), (3, " E2", None, "x", "x"), (4, "e3", "n/a", "x", "x"), (5, "e4", "N/A ", "x", "x"), (6, None, None, "x", "x"), (7, "", "@", "x", "x"), (8, None, "zed", "x", "x"), (9, None, "ZED", "x", "x"), (10, "e9", " ", "x", "x"), (11, "E9", "", "x", "x"), (1, "E1 ", "@Ann", "x", "x"), (None, "e1", "ann", "x", "x")]
    df = spark.createDataFrame(rows, ROWS)
    assert sorted(map(tuple, groups(df).collect())) == [(1, "ann"), (2, "ann"), (3, "ann"), (8, "zed"), (9, "zed"), (10, "e9"), (11, "e9")]
    s = {r.row_id: r.split for r in splits(df, {"train": 7, "validation": 2, "test": 1}).collect()}
    assert s.keys() == set(range(1, 12)) and len({s[1], s[2], s[3]}) == len({s[8], s[9]}) == 1
    empty = df.limit(0)
    assert groups(empty).collect() == [] == splits(empty, {"train": 1.0, "test": 1.0}).collect()


def test_split_shares_with_a_hot_group(spark):
    rows = [(k, "hot" if k % 3 == 0 else f"e{k // 2}", None, "x", "x") for k in range(3000)]
    n = collections.Counter(r.split for r in splits(spark.createDataFrame(rows, ROWS), {"train": 70, "validation": 15, "test": 15}).collect())
    assert sum(n.values()) == 3000 and abs(n["train"] - 2100) < 30 and abs(n["test"] - 450) < 30


# Packing


@settings(max_examples=80, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), max_size=30))
def test_fill_uses_every_length_once(counts):
    used = collections.Counter()
    for inside, times in packing.fill(counts, 64):
        assert sum(inside) <= 64
        used.update({x: k * times for x, k in collections.Counter(inside).items()})
    assert used == collections.Counter(counts)


def test_fill_is_tight():
    rng = np.random.default_rng(1)
    counts = collections.Counter(np.clip(rng.lognormal(5.5, 0.8, 5000).astype(int), 1, 2048).tolist())
    boxes = sum(t for _, t in packing.fill(counts))
    assert boxes <= 1.003 * sum(x * k for x, k in counts.items()) / 2048 + 1


def test_containers(spark):
    texts = ["one two three"] * 300 + ["", None, "word " * 5000, "Überfluss für §5 'll don't   \n x"] + ["many words here " * k for k in range(1, 60)]
    df = spark.createDataFrame([(i, t, "c", 0) for i, t in enumerate(texts)], "doc_id bigint, text string, container string, tokens int")
    out = packing.containers(df).toPandas()
    counter = packing.TokenCounter()
    for t in texts:
        if t:
            assert counter.count(t) == len(counter.encoding.encode_ordinary(t))
    want = {i: counter.count(t) for i, t in enumerate(texts) if t}
    assert out.groupby("doc_id").tokens.sum().to_dict() == want
    assert out.groupby("container").tokens.sum().max() <= 2048
    cut = out.groupby("doc_id").size()
    assert all(k == -(-want[d] // 2048) for d, k in cut.items())
    assert packing.containers(df.limit(0)).collect() == []


# Leaks


def brute_leaks(docs, items, n=12):
    grams = collections.defaultdict(set)
    for i, t in items:
        w = WORD.findall((t or "").lower())
        for k in range(len(w) - n + 1):
            grams[tuple(w[k : k + n])].add(i)
    out = set()
    for d, t in docs:
        w = WORD.findall((t or "").lower())
        for k in range(len(w) - n + 1):
            out |= {(d, i) for i in grams.get(tuple(w[k : k + n]), ())}
    return out


@pytest.mark.parametrize("block", [10, 10**6])
def test_leaks(spark, block):
    rng = random.Random(2)
    vocabulary = [f"w{k}" for k in range(30)]
    say = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(i, " ".join(say(40))) for i in range(20)] + [(98, None), (99, "short one"), (50, "")]
    docs = []
    for d in range(60):
        i = rng.randrange(20)
        w = items[i][1].split()
        k, n = rng.randrange(20), rng.randrange(8, 20)
        docs.append((d, ". ".join([" ".join(say(30)), ", ".join(w[k : k + n]).upper(), "\n".join(say(5))])))
    docs += [(100, None), (101, ""), (102, "x " * 100_000 + items[3][1])]
    dd = spark.createDataFrame([(*x, 1) for x in docs], "doc_id bigint, text string, item_id int")
    ii = spark.createDataFrame([(*x, "s") for x in items], "item_id bigint, text string, suite string")
    spans = leaks.leaked_spans(dd, ii, block_words=block)
    got = {(r.doc_id, r.item_id) for r in spans.collect()}
    assert got == brute_leaks(docs, items) and len(got) > 10
    cleaned = leaks.without_leaks(dd, spans).collect()
    gone = collections.defaultdict(set)
    for r in spans.collect():
        gone[r.doc_id] |= set(range(r.first_word, r.first_word + r.words))
    text = dict(docs)
    for r in cleaned:
        if r.text is not None:
            assert WORD.findall(r.text) == [w for k, w in enumerate(WORD.findall(text[r.doc_id])) if k not in gone[r.doc_id]]
    assert len(cleaned) == len(docs) and brute_leaks([(r.doc_id, r.text) for r in cleaned], items) == set()
    assert leaks.leaked_spans(dd, ii.limit(0)).collect() == [] == leaks.leaked_spans(dd.limit(0), ii).collect()


def test_overlapping_leaks_leave_the_rest_whole(spark):
    words = [f"w{k}" for k in range(70)]
    items = [(1, " ".join(words[5:25])), (2, " ".join(words[15:35])), (3, " ".join(words[35:50])), (4, " ".join(words[55:67])), (5, " ".join(words[56:68]))]
    docs = spark.createDataFrame([(0, ", ".join(words) + "!"), (1, " ".join(words[5:25])), (2, "nothing")], "doc_id bigint, text string")
    got = {r.doc_id: r.text for r in leaks.without_leaks(docs, leaks.leaked_spans(docs, spark.createDataFrame(items, "item_id bigint, text string"))).collect()}
    assert got == {0: ", ".join(words[:5]) + ", , " + ", ".join(words[50:55]) + ", , w68, w69!", 1: "", 2: "nothing"}


# Repeated lines


def brute_lines(rows, least=8):
    key = lambda line: "".join(c for c in line.lower() if c.isalpha())
    seen = collections.defaultdict(set)
    for i, s, _, _, b in rows:
        for line in (b or "").split("\n"):
            seen[s, key(line)].add(i)
    return {(i, n) for i, s, _, _, b in rows for n, line in enumerate((b or "").split("\n"), 1) if key(line) and len(seen[s, key(line)]) >= least}


@pytest.mark.parametrize("limit", [0, 4_000_000])
def test_repeated_lines(spark, limit):
    rng = random.Random(9)
    common = ["Terms of use", "• Älter werden © 2020!", "A long notice that is found again and again on every page of this site, with no end in sight, number 5", "x", "12 34"]
    rows = []
    for i in range(120):
        body = [" ".join(f"v{rng.randrange(10**6)}" for _ in range(rng.randrange(1, 30))) for _ in range(4)]
        body += [rng.choice(["", "  ", "* "]) + rng.choice(common).upper() + rng.choice(["", "…", " \r"]) for _ in range(3)]
        rng.shuffle(body)
        rows.append((i, rng.choice(["a", "a", "b", None]), "t", None, "\n".join(body)))
    rows += [rows[0], (500, "a", "t", None, None), (501, "a", "t", None, ""), (502, "a", "t", None, "y" * 300_000 + "\nTerms of use")]
    df = records(spark, rows)
    found = repeats.repeated_lines(df, broadcast_chunks=limit, broadcast_lines=limit)
    assert set(map(tuple, found.collect())) == brute_lines(rows)
    kept = {r.record_id: r.body for r in repeats.without_lines(df.dropDuplicates(["record_id"]), found).collect()}
    assert kept[500] is None and kept[501] == "" and "Terms" not in kept[502] and len(kept) == 123
    assert repeats.repeated_lines(df.limit(0)).collect() == []


# Wrappers


def test_frames():
    f = lambda x: set(wrappers.frames(x))
    assert f("By Ann Lee, staff writer") & f("By Bob Ray, staff writer") & f("BY CID FOX, STAFF WRITER…")
    assert f("Read also: one thing") == f("* Read also: another") != f("Tags: a, b")
    assert f("Home > News > A title") == f("Home > Press > Other")
    assert not f("") and not f("The committee in Bay City closed the long awaited motion today.")


def page(rng, k):
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(7)) for _ in range(400)]
    para = lambda: ". ".join(" ".join(rng.choice(words) for _ in range(9)).capitalize() for _ in range(3)) + "."
    top = ["Markets", "Prices", f"By {rng.choice('ABCDEFG')}xx {rng.choice('HIJKLMN')}yy, staff writer", f"{rng.randrange(50)} comments"]
    end = ["Trending now", f"Some title {words[0]} of {words[1]}", f"Another about {words[2]} and {words[3]}", "Terms Privacy Cookies", f"© {2000 + rng.randrange(20)} Site. All rights reserved."]
    middle = [para() for _ in range(rng.randrange(3, 6))]
    middle.insert(2, "Advertisement")
    body = top + middle + end
    own = set(range(len(top) + 1, len(top) + len(middle) + 1)) - {len(top) + 3}
    return "\n".join(body), {n for n in range(1, len(body) + 1) if n not in own}


def test_wrapper_induction(spark):
    rng = random.Random(6)
    rows, want = [], set()
    for i in range(150):
        body, lines = page(rng, i)
        rows.append((i, "site" if i % 3 else "other", f"Title {i}", None, body))
        want |= {(i, n) for n in lines}
    rows += [(900, None, None, None, None), (901, "site", None, None, ""), (902, "lonely", "T", None, "A single page. It has text.\nMarkets"), (903, "site", None, None, "long " * 100_000), rows[5]]
    got = {tuple(r) for r in wrappers.boilerplate(records(spark, rows)).collect()}
    hit = {x for x in got if x[0] < 900}
    assert len(hit & want) >= 0.99 * len(want) and len(hit - want) <= 0.01 * len(want)
    assert not {x for x in got if x[0] in (900, 901, 903)} and (902, 1) not in got
    assert wrappers.boilerplate(records(spark, rows[:0] or [rows[0]]).limit(0)).collect() == []


# Near copies


def test_golay_is_perfect():
    assert len(np.unique(golay._leaders()[1])) == 2048
    w = np.random.default_rng(0).integers(0, 1 << 23, 5000)
    c = golay.decode(w)
    assert c.min() >= 0 and c.max() < 4096
    keys, count = golay.keys(w)
    assert set(np.unique(count)) == {1, 6}
    for a, b in itertools.combinations(range(23), 2):  # two words at most two bits apart share a key
        other, n = golay.keys(w[:40] ^ (1 << a) ^ (1 << b))
        assert all(set(keys[i, : count[i]]) & set(other[i, : n[i]]) for i in range(40))


def brute_groups(rows):
    sets = {i: {tuple(w[k : k + 3]) for k in range(len(w) - 2)} for i, _, t, _, b in rows for w in [WORD.findall(((t or "") + "\n" + (b or "")).lower())]}
    edges = [(a, a) for a in sets]
    for a, b in itertools.combinations(sets, 2):
        x, y = sets[a], sets[b]
        if x and y and len(x & y) >= 0.5 * len(x | y):
            edges.append((a, b))
    lab = labels(edges)
    return {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if lab[a] == lab[b]}


@pytest.mark.parametrize(("bucket", "blocks", "hot"), [(2, 8, 20), (3, 1000, 10**6), (4096, 65536, 50_000)])
def test_near_copies(spark, bucket, blocks, hot):
    rng = random.Random(8)
    fresh = lambda n: [f"t{rng.randrange(10**6)}" for _ in range(n)]
    rows, told = [], fresh(150)
    for i in range(60):  # one hot group of different texts
        w = told[:]
        for _ in range(4):
            w[rng.randrange(150)] = f"e{rng.randrange(10**6)}"
        rows.append((i, "s", "head", None, " ".join(w)))
    for i in range(60, 160):
        rows.append((i, "s", " ".join(fresh(5)), None, " ".join(fresh(120))))
    for i in range(160, 200):
        w = rows[i - 90][4].split()
        rows.append((i, "s", rows[i - 90][2], None, " ".join(w[:50] + fresh(3) + w[50:])))
    rows += [(300 + k, "s", "the very same text", None, "over and over again") for k in range(40)]
    rows += [(400, "s", None, None, None), (401, "s", "", None, ""), (402, "s", "two words", None, None), (403, "s", "two words", None, None), (404, "s", "L", None, "long text " * 50_000), rows[0]]
    g = nearcopies.near_copy_groups(records(spark, rows), bucket=bucket, blocks=blocks, hot_rows=hot)
    assert g.count() == len({r[0] for r in rows})
    got = set(map(tuple, nearcopies.group_pairs(g).collect()))
    want = brute_groups(rows)
    assert not got - want and len(got & want) >= 0.99 * len(want)
    assert nearcopies.near_copy_groups(records(spark, rows[:1]).limit(0)).collect() == []


@pytest.mark.parametrize(("edits", "insert"), [(10, 0), (0, 75), (4, 40)])
def test_linked_texts_meet_whatever_the_collection_holds(edits, insert):
    """Pairs with about half of their sequences in common, by scattered edits, one insertion or both, share a key of some table and pass both sketches."""
    rng = np.random.default_rng(4)
    fresh = lambda k: rng.integers(1, 2**63, k, dtype=np.uint64)
    met = 0
    for _ in range(300):
        one = fresh(150)
        two = one.copy()
        two[rng.choice(150, edits, replace=False)] = fresh(edits)
        two = np.insert(two, rng.integers(150), fresh(insert))
        signs, sketch = nearcopies.signatures(np.concatenate([one, two]), np.array([len(one), len(two)]), 3)
        row, key = nearcopies.table_keys(signs)
        far = np.bitwise_count((sketch[0] ^ sketch[1]).view(np.uint64))
        met += bool(set(key[row == 0]) & set(key[row == 1])) and far[:2].sum() <= nearcopies.FAR_CARRIED and far.sum() <= nearcopies.FAR
    assert met >= 0.98 * 300


def test_group_pairs_of_a_large_group(spark, monkeypatch):
    monkeypatch.setattr(nearcopies, "PAIR_PART", 7)
    g = spark.createDataFrame([(i, i % 2, 0) for i in range(60)] + [(100, 9, 9)], "record_id bigint, group_id bigint, text_id bigint")
    got = sorted(map(tuple, nearcopies.group_pairs(g).collect()))
    assert got == [(a, b) for a, b in itertools.combinations(range(60), 2) if (b - a) % 2 == 0]


# Spam


def test_spam(spark):
    rng = random.Random(12)
    noun = [f"noun{k}" for k in range(300)]
    prose = lambda: f"The {rng.choice(noun)} of the {rng.choice(noun)} was shown to be a {rng.choice(noun)} in the end, and it is said that this will not change."
    pile = lambda: rng.choice([lambda: "buy cheap coin, " * 3, lambda: "\n".join(f"https://x.example/{rng.randrange(10**6)}" for _ in range(6)), lambda: " ".join(f"#{rng.choice(noun)}" for _ in range(15)), lambda: "\n".join(f"{rng.choice(noun)} / {rng.choice(noun)} / SKU-{rng.randrange(999)}" for _ in range(5))])()
    docs, want = [], set()
    for i in range(1200):
        spam_ = i % 12 == 0
        parts = [pile() for _ in range(6)] + [prose()] if spam_ else [prose() for _ in range(6)]
        docs.append((i, "\n".join(parts), f"https://h{i % 7}.example/a", "s", "x", 0.0))
        want |= {i} if spam_ else set()
    docs += [(5000, None, None, None, "x", 0.0), (5001, "", None, None, "x", 0.0), (5002, prose() * 3000, "nonsense", "s", "x", 0.0), docs[0]]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, url string, source string, host string, score double")
    got = {r.doc_id for r in spam.spam_pages(df).collect()}
    assert len(got ^ want) <= 0.02 * len(want)
    assert spam.spam_pages(df.limit(0)).collect() == []


def test_hosts_move_pages_near_the_middle(spark):
    """A page of which nearly half is piled up is spam on a host of spam and is none on a clean host."""
    rng = random.Random(13)
    noun = [f"noun{k}" for k in range(300)]
    prose = lambda: f"The {rng.choice(noun)} of the {rng.choice(noun)} was shown to be a {rng.choice(noun)} in the end, and it is said that this will not change."
    pile = lambda: "buy cheap coin | fast free coin | buy best coin | fast free coin | buy best coin | top coin | fast free coin | top coin | buy best coin"
    text = lambda piles, said: "\n".join([prose() for _ in range(said)] + [pile() for _ in range(piles)])
    docs = [(i, text(8, 0) if i % 10 else text(0, 8), "https://bad.example/x") for i in range(200)]
    docs += [(1000 + i, text(0, 8), f"https://good{i % 3}.example/x") for i in range(600)]
    docs += [(5000, text(4, 6), "https://bad.example/y"), (5001, text(4, 6), "https://good1.example/y"), (5002, text(5, 4), "https://good1.example/z")]
    df = spark.createDataFrame([(*d, "s") for d in docs], "doc_id bigint, text string, url string, source string")
    got = {r.doc_id: (r.score, r.smoothed) for r in spam.scored_pages(df).where("doc_id >= 5000").collect()}
    assert got[5000][0] < 0.5 < got[5000][1] and got[5001][1] < got[5001][0] < 0.5
    plain = {r.doc_id: r.smoothed for r in spam.scored_pages(df, host_weight=0.0).where("doc_id >= 5000").collect()}
    assert plain[5000] < 0.5


def test_labels_are_no_features():
    text = "The price of the coin has not changed since the meeting in May.\nA  1.5\nB  2.5\nC  3.5\nD  4.5\n"
    much, said = spam.evidence(text)
    assert 0.2 < much < 0.4 < said < 0.8 and spam.evidence("") == (0, 0)
    x, size = spam.segments(text)
    assert x.shape == (5, len(spam.FEATURES)) and size.sum() == len(text.replace("\n", ""))


def test_trees_learn_held_out():
    rng = np.random.default_rng(5)
    x = rng.random((3000, len(spam.FEATURES)))
    y = ((x[:, 0] > 0.5) ^ (x[:, 3] > 0.7)).astype(float)
    t = spam.BaggedTrees(x[:2000], y[:2000])
    assert ((t.score(x[2000:]) > 0.5) == (y[2000:] > 0)).mean() > 0.97


def test_times_are_utc():
    assert dt.datetime.fromtimestamp(0, dt.UTC).hour == 0
