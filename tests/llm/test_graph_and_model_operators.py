"""Near duplicates, url filters, packing, decontamination, toxicity, fingerprints, the pipeline."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from faultgrain.llm import chunks, components, decontaminate, packing, queries, simhash, toxicity, urls

LAST = (1 << 63) - 1


def plain_fingerprint(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    grams = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(links, nodes):
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in links:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    return {n: root(n) for n in nodes}


@pytest.mark.parametrize("which", [0, 1])
def test_simhash(odd, tables, both, which):
    rows = [(LAST if d is None else d, plain_fingerprint(t)) for d, t in both[which]]
    near = [(a, b) for i, (a, x) in enumerate(rows) for b, y in rows[:i] if (x ^ y).bit_count() <= 3]
    group = plain_components(near, {d for d, _ in rows})
    want = Counter((None if d == LAST else d, f"{f:016x}", None if group[d] == LAST else group[d]) for d, f in rows)
    got = simhash.near_duplicates([odd, tables("documents")][which]).collect()
    assert Counter(map(tuple, got)) == want


@pytest.mark.parametrize("radius,blocks", [(3, 4), (3, 1), (6, 3)])
def test_near_links_find_all(spark, radius, blocks):
    pick = random.Random(radius)
    marks = set()
    for _ in range(80):
        mark = pick.getrandbits(64)
        for _ in range(6):
            marks.add(mark)
            for bit in pick.sample(range(64), pick.randint(1, radius + 1)):
                mark ^= 1 << bit
    marks = sorted(marks)
    near = [(i, j) for i in range(len(marks)) for j in range(i) if (marks[i] ^ marks[j]).bit_count() <= radius]
    want = plain_components(near, range(len(marks)))
    signed = [(i, m - (1 << 64) * (m >> 63)) for i, m in enumerate(marks)]
    edges = simhash.near_links(spark.createDataFrame(signed, "doc long, mark long"), radius, blocks)
    found = {r["node"]: r["component"] for r in components.components(edges).collect()}
    assert {i: found.get(i, i) for i in want} == want


def jaccard(a, b):
    x, y = ({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (a.lower().split(), b.lower().split()))
    return len(x & y) / len(x | y)


def test_near_copies(spark):
    pick, rows, want = random.Random(4), [], {}
    vocabulary = [f"word{i}" for i in range(3000)]
    for k in range(150):
        w = pick.choices(vocabulary, k=pick.randint(60, 400))
        rows.append((10 * k, " ".join(w)))
        for copy in range(1, 4):
            edited = list(w)
            for at in pick.sample(range(len(w)), round(len(w) * pick.choice([0.005, 0.01, 0.02, 0.15]))):
                edited[at] = pick.choice(vocabulary)
            rows.append((10 * k + copy, " ".join(edited)))
            want[10 * k + copy] = jaccard(rows[-1][1], " ".join(w))
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("mark", F.lit("x"))
    group = {r["doc_id"]: r["component_id"] for r in simhash.near_copies(docs).collect()}
    alike = [d for d, j in want.items() if j >= 0.8]
    found = [d for d in alike if group[d] == d - d % 10]
    assert len(found) >= 0.97 * len(alike) > 100
    assert all(g == d - d % 10 or g == d or g // 10 == d // 10 for d, g in group.items())
    assert all(group[d] != d - d % 10 for d, j in want.items() if j < 0.5)


def edited_to(pick, low, high, n_words):
    """Two texts of about this many words whose shingles have a similarity in [low, high)."""
    while True:
        w = [f"v{pick.randrange(10**9)}" for _ in range(n_words)]
        other = list(w)
        for at in pick.sample(range(n_words), pick.randint(1, max(1, n_words // 12))):
            other[at] = f"x{pick.randrange(10**9)}"
        if low <= jaccard(" ".join(w), " ".join(other)) < high:
            return " ".join(w), " ".join(other)


def test_near_copies_are_those_of_brute_force(spark):
    pick, rows = random.Random(12), []
    for low, high, n_words in ((0.8, 0.82, 300), (0.78, 0.8, 300), (0.75, 0.78, 300), (0.8, 0.85, 120), (0.7, 0.75, 120)):
        for _ in range(40):
            rows += [(len(rows) + k, text) for k, text in enumerate(edited_to(pick, low, high, n_words))]
    for n_words in range(5, 13):  # an end word differs: n - 5 of n - 3 shingles are shared
        for _ in range(15):
            w = [f"s{pick.randrange(10**9)}" for _ in range(n_words)]
            rows += [(len(rows) + k, " ".join([*w[:-1], end])) for k, end in enumerate((w[-1], "other"))]
    for _ in range(10):  # the same shingles, repeated
        w = [f"r{pick.randrange(10**9)}" for _ in range(12)]
        rows += [(len(rows) + k, " ".join(w * (k + 3))) for k in range(2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    group = {r["doc_id"]: r["component_id"] for r in simhash.near_copies(docs).collect()}
    text = dict(rows)
    for d in range(0, len(rows), 2):
        assert (group[d + 1] == d) == (jaccard(text[d], text[d + 1]) >= 0.8), (d, jaccard(text[d], text[d + 1]))


def test_pieces_of_a_candidate_component_lose_no_copy(spark, monkeypatch):
    monkeypatch.setattr(simhash, "PIECE_GRAMS", 500)
    base = [f"word{i}" for i in range(100)]
    docs = spark.createDataFrame([(k, " ".join([*base, f"end{k}"])) for k in range(60)], "doc_id long, text string")
    assert {r["component_id"] for r in simhash.near_copies(docs).collect()} == {0}


def test_near_copies_of_odd_rows(odd, odd_rows, empty):
    group = defaultdict(set)
    for r in simhash.near_copies(odd).collect():
        group[r["doc_id"]].add(r["component_id"])
    assert set(group) == {d for d, *_ in odd_rows} and all(len(g) == 1 for g in group.values())
    # Without words, and by way of the rows without doc_id, one of which holds the passage.
    assert group[1] == group[2] == group[3] == group[21] == group[None] == group[-3] == {-3}
    assert simhash.near_copies(empty).collect() == []


def test_shard_pieces_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SHARD_MOST", 40)
    marks = [(i, i) for i in range(1 << 9)]
    edges = simhash.near_links(spark.createDataFrame(marks, "doc long, mark long"), 1, 1)
    assert {r["component"] for r in components.components(edges).collect()} == {0}


def test_components_of_chains_stars_and_loops(spark):
    chain = [(i, i + 1) for i in range(60)]
    star = [(500, i) for i in range(1000, 1400)]
    odd = [(7000, 7000), (8001, 8000), (8000, 8001), (8000, 8001), (None, 3), (4, None)]
    edges = spark.createDataFrame(chain + star + odd, "a long, b long")
    found = {r["node"]: r["component"] for r in components.components(edges).collect()}
    assert found == {**{i: 0 for i in range(61)}, **{i: 500 for i in [500, *range(1000, 1400)]}, 8000: 8000, 8001: 8000}
    assert components.components(edges.limit(0)).count() == 0


def plain_url(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, path = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut]), rest[cut:]
    path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    rules = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
    fit = [r for r in rules if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    best = max(fit, key=lambda r: len(r[0] + r[1]), default=None)
    return host, path, best and best[0] + best[1], best and best[2]


def test_url_rules(spark, tables):
    odd = [
        None, "", "no scheme", "http://", "HTTP://A.ORG", "x://É.Example.ORG/es/1?x", "http://a.com?/fr/", "http://a.com#/fr/", "http://org/",
        "http://example.org/en/12#y", "http://com/fr/", "ftp://b.com/de/x?u=http://c.org/", "http://xorg/", "http://a.org/a://b", "http://a\n.org/x",
    ]
    pages = spark.createDataFrame([(i, u, None, "x") for i, u in enumerate(odd)], "page_id long, url string, html string, node string")
    pages = pages.select("page_id", "url", "html").union(tables("pages").withColumn("page_id", F.col("page_id") + 1000))
    got = {r["page_id"]: r for r in urls.judge(pages).collect()}
    for row in pages.collect():
        host, path, rule, verdict = plain_url(row["url"])
        have = got[row["page_id"]]
        assert (have["host"], have["path"], have["rule"]) == (host, path, rule), row["url"]
        assert have["verdict"] == (verdict or "allow")
    assert urls.judge(pages.limit(0)).collect() == []


def judged_alike(spark, rows):
    """The judged rows, which are those that the SQL states."""
    got = urls.judge(spark.createDataFrame(rows, "page_id long, url string, html string"))
    with duckdb.connect() as con:
        con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
        con.executemany("INSERT INTO pages VALUES (?, ?, ?)", rows)
        stated = con.sql(queries.ORACLES["op2_url_filters"])
        stated = sorted(map(repr, stated.select(*got.columns).fetchall()))
    got = got.collect()
    assert sorted(repr(tuple(r)) for r in got) == stated
    return got


def test_pages_that_nothing_links_stay_apart(spark):
    refresh = "<meta http-equiv='refresh' content='0; url=http://bad.com/de/x'>"
    urls_of = [f"http://x.net/watch?v={k}" for k in (1, 2, 3)] + [
        "http://x.net/watch", "http://x.net/watch.html", "http://www.x.net/watch?v=2", "http://x.net/watch/?v=2",
        "https://x.net/watch?utm_campaign=7&v=2#t", "http://x.net/watch?v=2&utm=1", "http://x.net", "http://x.net/?", "x://X.net/#a",
    ]
    got = judged_alike(spark, [(k, url, refresh if k == 1 else None) for k, url in enumerate(urls_of)])
    assert {r["page_id"] for r in got if r["verdict"] == "block"} == {1, 7}
    assert {r["alias_of"] for r in got if r["page_id"] in (9, 10, 11)} == {"x.net/"}


def test_every_canonical_and_refresh_tag_counts(spark):
    tags = "".join(f'<link rel="canonical" href="{u}"><meta http-equiv=refresh content="1;url={u}b">' for u in ("/a", "http://bad.com/de/", "c"))
    got = judged_alike(spark, [(1, "http://x.net/p/q", tags), (2, "http://x.net/a", ""), (3, "http://x.net/p/cb", ""), (4, "http://x.net/c", "")])
    assert {r["page_id"]: r["verdict"] for r in got} == {1: "block", 2: "block", 3: "block", 4: "allow"}


def test_blocks_reach_aliases(spark):
    link = '<head><LINK href="{}" rel=canonical></head>'
    refresh = "<meta http-equiv='refresh' content='0; url={}'>"
    rows = [
        (1, "http://bad.com/de/x", None),
        (2, "http://one.net/a", link.format("https://Two.net/b?utm_source=one&q=1#x")),
        (3, "http://two.net/b?q=1&fbclid=3", refresh.format("http://bad.com/de/x#top")),
        (4, "http://one.net/a/", ""),
        (5, "http://good.org/a", link.format("http://three.net/c")),
        (6, "http://three.net/c", link.format("http://bad2.com/de/y")),
        (7, "http://bad2.com/de/y", "<link rel='canonical'>"),
        (8, "http://lone.net/z", link.format("/z2")),
        (8, "http://lone.net/z2", None),
        (None, None, link.format("http://bad.com/de/x")),
    ]
    got = judged_alike(spark, rows)
    got = sorted((r["page_id"] or 0, r["verdict"], r["alias_of"]) for r in got)
    # 6 is an alias of a blocked page, but also of one that a rule allows.
    assert got == [
        (0, "allow", None), (1, "block", "bad.com/de/x"), (2, "block", "bad.com/de/x"), (3, "block", "bad.com/de/x"),
        (4, "allow", "one.net/a/"), (5, "allow", "bad2.com/de/y"), (6, "allow", "bad2.com/de/y"),
        (7, "block", "bad2.com/de/y"), (8, "allow", "lone.net/z"), (8, "allow", "lone.net/z"),
    ]


def test_blocks_come_from_targets_that_are_no_pages(spark):
    refresh = "<meta http-equiv='refresh' content='0; url={}'>"
    links = [
        ("http://x.net/a", "http://bad.com/de/x", "block"), ("http://x.net/b", "http://fine.net/c", "allow"),
        ("http://y.net/p/q/one", "two", "block"), ("http://y.net/p/q/two", "http://bad.com/de/y", "block"),
        ("http://y.net/r/s/one", "../t/?utm_term=1", "block"), ("http://y.net/r/t", "//bad.com/z/../de/z", "allow"), ("http://y.net/r/t/", "/../v/./w", "block"),
        ("http://y.net/v/w", "http://bad.com/de/w", "block"), ("http://z.net", "u", "block"), ("http://z.net/u", "http://bad.com/de/u", "block"),
        ("http://w.net/a", "mailto:a@bad.com/de/", "allow"), ("http://w.net/b", "?u=http://bad.com/de/", "allow"), ("http://w.net/c", "#top", "allow"),
        ("http://v.net/c", "https://some.org/x", "allow"), ("http://v.net/d", "http://v.net/c", "allow"), ("http://v.net/d/", "http://bad.com/de/v", "block"),
    ]
    want = {k: v for k, (_, _, v) in enumerate(links)}
    rows = [(k, url, refresh.format(link)) for k, (url, link, _) in enumerate(links)]
    got = judged_alike(spark, rows)
    assert {r["page_id"]: r["verdict"] for r in got} == want


@pytest.mark.parametrize("which", [0, 1])
def test_packing(odd, tables, both, which):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    want = Counter()
    for doc, text in both[which]:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        for piece, start in enumerate(range(0, len(ids), 2048)):
            own = np.array(ids[start : start + 2048], "<u4")
            want[doc, piece, start, len(own), zlib.crc32(own.tobytes())] += 1
    packed = packing.pack_documents([odd, tables("documents")][which], packing.tokenizer_path()).collect()
    assert Counter(tuple(r)[:5] for r in packed) == want
    by_sequence = defaultdict(list)
    for r in packed:
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in by_sequence.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 2048
    tokens = sum(r["length"] for r in packed)
    assert len(by_sequence) <= max(-(-tokens // 2048) * 1.02 + 1, sum(r["length"] > 1024 for r in packed) + 1)


def test_sequences_hold_the_ids(odd):
    packed = packing.pack_documents(odd, packing.tokenizer_path(), with_ids=True).cache()
    built = {r["sequence_id"]: r["ids"] for r in packing.sequences(packed).collect()}
    for r in packed.collect():
        assert built[r["sequence_id"]][r["offset"] : r["offset"] + r["length"]] == r["ids"]


def plain_best_fit(histogram, capacity):
    """Best-fit decreasing, one piece after the other."""
    room = []
    for length in sorted((n for n, count in histogram.items() for _ in range(count)), reverse=True):
        fits = [k for k, r in enumerate(room) if r >= length]
        if fits:
            room[min(fits, key=room.__getitem__)] -= length
        else:
            room.append(capacity - length)
    return len(room)


def test_plan_packs_every_piece_once():
    pick = random.Random(1)
    for capacity in (10, 64, 500):
        for _ in range(40):
            histogram = {pick.randint(1, capacity): pick.randint(1, 50) for _ in range(pick.randint(1, 30))}
            taken, sequences = Counter(), defaultdict(int)
            for length, low, high, first, _ in packing._places(histogram, capacity):
                for rank in range(low, high + 1):
                    taken[length, rank] += 1
                    sequences[first + rank - low] += length
            assert taken == Counter((n, rank) for n, count in histogram.items() for rank in range(count))
            assert max(sequences.values()) <= capacity
            assert len(sequences) <= 1.03 * plain_best_fit(histogram, capacity) + 1


def edit_search(pattern, text):
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, c in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (p != c)))
        row = new
    return min((d, j) for j, d in enumerate(row))


def test_bit_parallel_distance():
    pick = random.Random(5)
    for _ in range(400):
        pattern = "".join(pick.choices("abc ", k=pick.randint(1, 80)))
        text = "".join(pick.choices("abc ", k=pick.randint(0, 120)))
        want = edit_search(pattern, text)
        if want[1] == 0:
            assert decontaminate.closest(pattern, text, len(pattern) - 1) is None
        else:
            assert decontaminate.closest(pattern, text, len(pattern)) == want
        assert decontaminate.closest(pattern, text, want[0] - 1) is None


def test_decontamination(spark, tables, given):
    items = [(r["item_id"], r["text"]) for r in tables("benchmark").collect()]
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(tables("documents"), tables("benchmark")).collect()}
    plain = {i: decontaminate.plain(t) for i, t in items}
    assert got == {(d, i) for d, t in given for i, p in plain.items() if f" {p} " in f" {decontaminate.plain(t)} "}
    assert got


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_word_bounded_distances():
    pick = random.Random(6)
    for _ in range(200):
        pattern = "".join(pick.choices("ab ", k=pick.randint(1, 14)))
        text = "".join(pick.choices("ab ", k=pick.randint(0, 24)))
        most = pick.randint(0, 6)
        ends = [e for e in range(1, min(len(text), len(pattern) + most) + 1) if e == len(text) or " " in text[e - 1 : e + 1]]
        want = [(d, e) for e in ends if (d := edit_distance(pattern, text[:e])) <= most]
        assert decontaminate.distances(pattern, text, most) == want
        at = pick.randint(0, max(0, len(text) - 1))
        found = decontaminate.quoted(pattern, text, at, most)
        bounds = [k for k in range(len(text) + 1) if k in (0, len(text)) or " " in text[k - 1 : k + 1]]
        parts = [(edit_distance(pattern, text[a:b]), a, b) for a in bounds for b in bounds if a < b and abs(a - at) <= most and b <= at + len(pattern) + most]
        best = min((d for d, *_ in parts if d <= most), default=None)
        assert (found and found[0]) == best
        if found:
            assert edit_distance(pattern, text[found[1] : found[2]]) == best


def plain_contaminated(line, unit):
    """Whether a unit is in a line of plain words, by all word-bounded parts of about its length."""
    if unit.alone:
        return line == unit.text
    words, own = line.split(" "), unit.text.split(" ")
    bounds = [k for k in range(len(line) + 1) if k in (0, len(line)) or " " in line[k - 1 : k + 1]]
    for a in bounds:
        for b in bounds:
            if abs(b - a - len(unit.text)) <= unit.edits and edit_distance(unit.text, line[a:b]) <= unit.edits:
                return True
    if unit.words:
        for i in range(len(words)):
            if any(edit_distance(own, words[i : i + n]) <= 1 for n in (len(own) - 1, len(own), len(own) + 1)):
                return True
    return False


def test_found_and_not_found_as_by_brute_force(spark):
    pick = random.Random(4)
    items = [
        (1, "yes"), (2, "a"), (3, "What is the capital of France?"), (4, "one two three"), (5, "which is the best way home today"),
        (6, "the quick brown fox jumps over the lazy dog and runs far away from it all"), (7, "x" * 40), (8, "Deux mots é ü, trois!"),
    ]
    texts = [
        "yesterday cats sat", "yes", "Yes!", "a", "no, a cat", "tell me what is the capital of francesca now", "what is the capital of france",
        "so what is the capitol of france then", "what is the capital of fran", "one two three", "count one two three", "one two threes",
        "awhich is the best way home today", "which is the best way home todays", "which is tha best way home today or not",
        "deux mots e u trois", "et deux mots é ü trois fois", "y" + "x" * 40, "x" * 40 + " y", "x" * 39 + "y x", "", " ",
    ]
    line = decontaminate.plain(items[5][1]).split(" ")
    for _ in range(60):
        own = line[pick.randint(0, 3) : pick.randint(12, 16)]
        for _ in range(pick.randint(0, 3)):
            k = pick.randrange(len(own))
            own[k] = pick.choice([own[k][1:], own[k] + "s", "other", own[k] + " " + own[k]])
        texts.append(pick.choice(["", "pre", "and then "]) + " ".join(own) + pick.choice(["", "post", " it was"]))
    rows = [(k, t) for k, t in enumerate(texts)] + [(3, texts[3])]
    got = decontaminate.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    got = [(r["doc_id"], r["item_id"]) for r in got.collect()]
    units = [u for item in items for u in decontaminate.units(*item)]
    want = {(k, u.item_id) for k, t in enumerate(texts) for u in units if plain_contaminated(decontaminate.plain(t), u)}
    assert sorted(got) == sorted(want)
    assert {(0, 1), (4, 2), (5, 3)}.isdisjoint(want) and {(1, 1), (2, 1), (3, 2), (6, 3), (7, 3)} <= want


def test_long_items_are_taken_by_stretches(spark, tables):
    words = " ".join(f"word{k * 7919 % 1000}" for k in range(8000))
    units = decontaminate.units(1, words)
    assert max(len(u.text) for u in units) < 3 * decontaminate.STRETCH
    parts = decontaminate._stretches(decontaminate.plain(words).split(" "))
    assert " ".join(parts) == words and min(map(len, parts)) >= decontaminate.STRETCH - 1
    docs = spark.createDataFrame([(1, "start " + words[30_000:31_000] + " end"), (2, "word1 word2")], "doc_id long, text string")
    found = decontaminate.contaminated(docs, spark.createDataFrame([(5, words)], "item_id long, text string")).collect()
    assert {r["doc_id"] for r in found} == {1}


def test_decontamination_within_the_budget(spark, tables):
    pick, rows = random.Random(8), []
    items = [r["text"] for r in tables("benchmark").collect()]
    for k, item in enumerate(items):
        line = list(decontaminate.plain(item))
        for at in pick.sample(range(len(line)), len(line) // decontaminate.EDIT_EVERY):
            line[at] = pick.choice(["", "q", "7"])
        rows.append((k, "An opening, " + re.sub("[a-z]", lambda m: m.group().upper(), "".join(line)) + " and an ENDING."))
        rows.append((1000 + k, "é ñ " + item[: len(item) // 8]))
    rows += [(5000, None), (5001, ""), (None, items[0])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("item_id", F.lit("x"))
    marks = [(k, t) for k, t in enumerate(items)] + [(0, items[0]), (None, "x"), (900, None), (901, ""), (902, "...")]
    found = decontaminate.contaminated(docs, spark.createDataFrame(marks, "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} >= {(k, k) for k in range(len(items))} | {(None, 0)}
    assert not {r["doc_id"] for r in found if r["doc_id"] is not None and r["doc_id"] >= 1000}


def test_any_thirteen_words_are_found(spark):
    folder, pick = "/root/testdata/sf0.1", random.Random(9)
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    items.append((9000, " ".join(["i"] * 6 + ["x" * 900] + ["o"] * 6)))
    rows, want = [], set()

    def quote(item_id, own):
        rows.append((len(rows), "before it " + " ".join(own) + " after it"))
        want.add((rows[-1][0], item_id))

    for item_id, text in items:
        own = decontaminate.plain(text).split(" ")
        for cut in (1, 2):
            if len(own) - 2 * cut >= decontaminate.UNIT_WORDS:
                quote(item_id, own[cut:-cut])
        at = pick.randint(0, len(own) - 13)
        quote(item_id, own[at : at + 13])
        quote(item_id, [f"{k}other" if k % 10 == 9 else w for k, w in enumerate(own)])
        lost = pick.randint(1, 11)
        for put in ([], ["z" * 40], [own[at + lost], "added"]):
            quote(item_id, own[at : at + lost] + put + own[at + lost + 1 : at + 13])
        rows.append((len(rows), " ".join(own[at : at + 7] + ["q"] + own[at + 9 : at + 13])))  # 11 of 13 words
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = decontaminate.contaminated(docs, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} >= want


def test_decontamination_of_empty_tables(spark, empty, tables):
    assert decontaminate.contaminated(empty, tables("benchmark")).collect() == []
    assert decontaminate.contaminated(tables("documents"), tables("benchmark").limit(0)).collect() == []


def test_toxicity_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{n}.parquet") for n in ("documents", "labels"))
    scored = toxicity.toxicity(docs, labels)
    assert scored.filter("score IS NULL OR score < 0 OR score > 1").count() == 0
    fold = {r["doc_id"]: zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1 for r in scored.select("doc_id").collect()}
    rows = scored.join(labels, "doc_id").select("doc_id", "held_out", "predicted", "toxic", "score").collect()
    assert all(r["held_out"] == fold[r["doc_id"]] for r in rows)
    held = [r for r in rows if r["held_out"]]
    right = sum(r["predicted"] and r["toxic"] for r in held)
    assert right / sum(r["predicted"] for r in held) > 0.95
    assert right / sum(r["toxic"] for r in held) > 0.75


def test_toxicity_never_reads_held_out_labels(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{n}.parquet") for n in ("documents", "labels"))
    turned = labels.withColumn("toxic", F.when(toxicity.fold() == 1, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = ({r["doc_id"]: r["score"] for r in toxicity.toxicity(docs, x).collect()} for x in (labels, turned))
    assert a == pytest.approx(b)


def test_toxicity_of_odd_rows(spark, odd, odd_rows, empty):
    labels = spark.createDataFrame([(4, 1, 1), (5, 0, 0), (5, 0, None), (8, 1, 0), (12, None, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = toxicity.toxicity(odd, labels).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(d for d, *_ in odd_rows)
    assert {r["score"] for r in toxicity.toxicity(odd, labels.limit(0)).collect()} == {0.5}
    assert toxicity.toxicity(empty, labels).collect() == []


def plain_boundaries(data):
    """The chunking rule byte by byte."""
    out, start, n = [], 0, len(data)
    if n <= chunks.MIN_CHUNK:
        return [n] if n else []

    def rolled(i):
        return sum(int(chunks._GEAR[data[i - j]]) << j for j in range(16) if i >= j) % (1 << 32) >> 15

    while n - start > chunks.MIN_CHUNK:
        for end in range(start + chunks.MIN_CHUNK, min(n, start + chunks.MAX_CHUNK) + 1):
            bits = 7 if end < start + chunks.USUAL_CHUNK else 4
            strict = end == start + chunks.USUAL_CHUNK and rolled(end - 1) % 128 == 0
            if strict or rolled(end - 1) % (1 << bits) == 0:
                break
        start = end
        out.append(start)
    return out + [n] if start < n else out


def test_chunk_boundaries(given):
    for _, text in given[:40]:
        data = (text or "").encode()[:3000]
        assert chunks.boundaries(data) == plain_boundaries(data)


def test_chunks_resist_shifts(given):
    text = next(t for _, t in given if t and len(t) > 5000)
    moved = "Some words before. " + text
    a, b = (chunks.chunk_weights(t.encode()) for t in (text, moved))
    assert chunks.containment(a, b) > 0.9


@pytest.mark.parametrize("which", [0, 1])
def test_edit_likeness(odd, tables, both, which):
    rows = sorted(((LAST if d is None else d, t or "") for d, t in both[which]))
    want = Counter()
    for (doc, text), (_, following) in zip(rows, rows[1:] + rows[:1]):
        edited = chunks.edited_text(text, following)
        assert len(edited) == len(text) - len(text) // 4 + min(len(text) // 4, len(following))
        sets = [chunks.chunk_weights(t.encode()) for t in (text, edited, following)]
        row = chunks._likeness(doc, text, sets[0], following, sets[2])
        want[(None if doc == LAST else doc, *row[1:])] += 1
    got = chunks.edit_likeness([odd, tables("documents")][which]).collect()
    assert Counter(map(tuple, got)) == want
    for r in got:
        assert (r["fingerprint"] == r["edited_fingerprint"]) <= (r["near_edited"] == 1.0)


def test_chunk_sets(odd, odd_rows, empty):
    got = chunks.chunk_sets(odd).collect()
    sizes = Counter((r["doc_id"], sum(c["bytes"] for c in r["chunks"])) for r in got)
    assert sizes[1, 0] and sizes[2, 0] and sizes[4, 3]
    assert len({r["fingerprint"] for r in got if r["doc_id"] in (5, 10)}) == 2
    assert chunks.edit_likeness(empty).collect() == [] == chunks.chunk_sets(empty).collect()


def test_near_duplicates_and_packing_of_an_empty_table(empty):
    assert simhash.near_duplicates(empty).collect() == []
    assert packing.pack_documents(empty, packing.tokenizer_path()).collect() == []


def test_pipeline_stages_keep_all_columns(spark, odd):
    docs = odd
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, "/root/testdata/sf0.001").cache()
        assert kept.dtypes == docs.dtypes
        assert 0 < kept.count() <= docs.count()
        docs = kept
    assert corpus_pipeline.STAGES[-1][1](spark, docs, "/root/testdata/sf0.001").count() >= docs.count()


def test_pipeline_stages_take_an_empty_table(spark, empty):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, "/root/testdata/sf0.001").count() == 0


def test_pipeline_drops_copies_and_passages(spark, tables):
    item = tables("benchmark").first()["text"]
    base = " ".join(f"word{i}" for i in range(300))
    rows = [(1, base), (2, base), (3, base + " more"), (4, f"An essay. {item} And so on."), (5, "clean words only here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    folder = "/root/testdata/sf0.001"
    assert {r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, docs, folder).collect()} >= {1, 4, 5}
    assert 2 not in {r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, docs, folder).collect()}
    assert {r["doc_id"] for r in corpus_pipeline.drop_contaminated(spark, docs, folder).collect()} == {1, 2, 3, 5}


def test_pipeline_decides_by_row(spark, tables):
    item, folder = tables("benchmark").first()["text"], "/root/testdata/sf0.001"
    one, two = (" ".join(f"{w}{i}" for i in range(100)) for w in ("one", "two"))
    rows = [
        (None, one), (None, two), (None, "a clean text without id"), (None, f"An essay. {item} And so on."),
        (7, one), (7, two), (8, one + " end"), (9, "clean"), (9, f"{item} {item[::-1]}"), (6, "copies of one id"), (6, "copies of one id"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)

    def left(stage):
        return Counter((r["doc_id"], r["text"]) for r in stage(spark, docs, folder).collect())

    assert left(corpus_pipeline.drop_contaminated) == Counter(r for r in rows if item not in r[1])
    # Neither the rows without id nor those of 7 join the two texts; a proper id stays before none.
    gone = [(None, one), (None, two), (8, one + " end"), (6, "copies of one id")]
    assert left(corpus_pipeline.drop_near_copies) == Counter(rows) - Counter(gone)


def test_pipeline_drops_what_fingerprints_link(spark):
    """The stage is the operator's: a link by fingerprints makes a copy also where five-word shingles differ."""
    pick = random.Random(21)
    words = [f"w{pick.randrange(10**6)}" for _ in range(60)]
    rows = [(0, " ".join(words * 40))]
    # Words changed far apart: few three-word shingles of the many, and the bits of the fingerprint hold.
    for step in (9, 12, 20, 40):
        edited = list(words * 40)
        for at in range(0, len(edited), step):
            edited[at] = f"x{at}"
        rows.append((step, " ".join(edited)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    linked = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(docs).collect()}
    alike = {r["doc_id"]: r["component_id"] for r in simhash.near_copies(docs).collect()}
    only = {d for d in linked if linked[d] != d and alike[d] == d}
    assert only
    left = {r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, docs, "/root/testdata/sf0.001").collect()}
    assert not only & left
    assert left == {d for d in linked if linked[d] == d and alike[d] == d}


def test_pipeline_drops_toxic_rows_alone(spark, monkeypatch):
    docs = spark.createDataFrame([(None, "bad words"), (None, "good"), (5, "bad"), (5, "fine")], "doc_id long, text string")
    monkeypatch.setattr(toxicity, "THRESHOLD", 0.5)
    labels = [(100 + k, int(k % 2)) for k in range(60)]
    known = [(d, "bad bad awful" if t else "good fine plain") for d, t in labels]
    docs = docs.union(spark.createDataFrame(known, "doc_id long, text string"))
    folder = str(corpus_pipeline.scratch_path(spark, "toxic-test"))
    spark.createDataFrame([(d, 0, t) for d, t in labels], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    left = {(r["doc_id"], r["text"]) for r in corpus_pipeline.drop_toxic(spark, docs, folder).collect()}
    assert {(None, "good"), (5, "fine")} <= left and not {(None, "bad words"), (5, "bad")} & left


def test_edit_likeness_by_a_version_of_its_own(spark, given):
    """Chunks cut byte by byte and compared as they are, without the module's digests, edits or likeness."""
    rows = [(7 * k, t) for k, (_, t) in enumerate(sorted(given)) if t is not None and len(t) < 1500][:60]
    rows += [(1001, ""), (1002, None), (1003, "é" * 90), (1004, rows[3][1]), (1005, rows[3][1]), (1006, "short")]

    def cut(text):
        data = text.encode()
        ends = plain_boundaries(data)
        return frozenset(data[a:b] for a, b in zip([0, *ends], ends))

    def alike(a, b):
        if not a or not b:
            return float(a == b)
        return min(1.0, sum(map(len, a & b)) / min(sum(map(len, a)), sum(map(len, b))))

    want, sets = {}, {}
    for (doc, text), (_, following) in zip(rows, rows[1:] + rows[:1]):
        text, following = text or "", following or ""
        quarter = len(text) // 4
        edited = "".join([*text[: len(text) - quarter], *following[:quarter]])
        sets[doc] = own, other = cut(text), cut(edited)
        want[doc] = (len(text), hashlib.sha256(edited.encode()).hexdigest(), alike(own, other), alike(own, cut(following)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: r for r in chunks.edit_likeness(docs).collect()}
    assert {d: (r["n_chars"], r["edited_sha256"]) for d, r in got.items()} == {d: w[:2] for d, w in want.items()}
    for doc, (_, _, near_edited, near_next) in want.items():
        assert got[doc]["near_edited"] == pytest.approx(near_edited) and got[doc]["near_next"] == pytest.approx(near_next)
    # Fingerprints are equal just where the sets of chunks are.
    named = {}
    for doc, (own, other) in sets.items():
        for chunk_set, name in ((own, got[doc]["fingerprint"]), (other, got[doc]["edited_fingerprint"])):
            assert named.setdefault(chunk_set, name) == name
    assert len(set(named.values())) == len(named)


def test_near_copies_from_given_links(spark, tables):
    """Links that are handed over give the groups that links found anew give."""
    docs = tables("documents").select("doc_id", "text")
    groups = simhash.near_duplicates(docs).filter("doc_id != component_id").select(F.col("doc_id").alias("a"), F.col("component_id").alias("b"))
    found = [{r["doc_id"]: r["component_id"] for r in g.collect()} for g in (simhash.near_copies(docs), simhash.near_copies(docs, linked=groups))]
    assert found[0] == found[1] and any(d != c for d, c in found[0].items())
