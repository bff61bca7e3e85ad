"""The Jaccard join, the url filter and top-k against brute force."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from reviewlake.llm import jaccard, topk, urls

WORD = re.compile(r"[^\x20\x09-\x0d]+")


def shingles(text):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if len(words) < 5:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i:i + 5]) for i in range(len(words) - 4))


def plain_components(rows):
    """(doc_id, set size, component) of each row by comparing all pairs."""
    sets = [shingles(r.text) for r in rows]
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            o = len(a & sets[j])
            if a and sets[j] and 100 * o >= 75 * (len(a) + len(sets[j]) - o):
                up[root(i)] = root(j)
    best = {}
    for i, r in enumerate(rows):
        if r.doc_id is not None:
            best[root(i)] = min(best.get(root(i), r.doc_id), r.doc_id)
    return Counter((r.doc_id, len(sets[i]), best.get(root(i)) if sets[i] else r.doc_id) for i, r in enumerate(rows))


def got(frame):
    return Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.linked_documents(frame).collect())


def edited(rng, words, share):
    return " ".join(rng.choice(["P", "q", "r1"]) + str(rng.randrange(9999)) if rng.random() < share else w for w in words)


def test_components_equal_brute_force(spark, monkeypatch):
    """Families of near copies around the threshold, chains, a passage that many share, and very common lines."""
    rng = random.Random(11)
    passage = " ".join(f"common{i}" for i in range(60))
    texts = []
    for family in range(12):
        words = [f"w{family}x{rng.randrange(400)}" for _ in range(rng.choice([6, 30, 90]))]
        for _ in range(rng.randrange(2, 14)):
            texts.append(edited(rng, words, rng.choice([0.0, 0.01, 0.02, 0.04])) + (" " + passage if rng.random() < 0.4 else ""))
        chain = list(words)
        for _ in range(4):
            chain[rng.randrange(len(chain))] = f"z{rng.randrange(9999)}"
            texts.append(" ".join(chain))
    texts += [passage + f" own{i} " + " ".join(f"u{i}v{j}" for j in range(5)) for i in range(20)]
    texts += [passage] * 3 + ["a b c", "A  B\tc", "a b", "x"] + ["short text of five words", "Short text OF five words"]
    rng.shuffle(texts)
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    want = plain_components(frame.collect())
    for part in (2000, 8 << 20):
        monkeypatch.setattr(jaccard, "PART_BYTES", part)
        assert got(frame) == want


def test_tiles_of_a_large_family(spark, monkeypatch):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(80)]
    rows = [(i, edited(rng, words, rng.choice([0.0, 0.01, 0.03, 0.05]))) for i in range(150)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    links = jaccard.node_links
    monkeypatch.setattr(jaccard, "node_links", lambda sets: links(sets, tile=20))
    monkeypatch.setattr(jaccard, "PRODUCTS", 500)
    monkeypatch.setattr(jaccard, "PART_BYTES", 4000)
    assert got(frame) == plain_components(frame.collect())


def test_dense_and_sparse_products_agree():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 40, 25)) for _ in range(60)]
    left, right = np.arange(40), np.arange(20, 60)
    want = {(i, j): len(np.intersect1d(sets[i], sets[j])) for i in left for j in right}
    for portion in (7, 10**6):
        jaccard.PRODUCTS, kept = portion, jaccard.PRODUCTS
        codes, counts = jaccard.product(sets, left, right)
        jaccard.PRODUCTS = kept
        found = {(c // 60, c % 60): n for c, n in zip(codes.tolist(), counts.tolist(), strict=True)}
        assert found == {k: n for k, n in want.items() if n}


def test_components_of_odd_documents(odd_documents, no_documents):
    assert got(odd_documents) == plain_components(odd_documents.collect())
    assert jaccard.linked_documents(no_documents).collect() == []


def test_labels_of_chains(spark):
    edges = spark.range(40).selectExpr("id * 3 a", "id * 3 + 3 b").unionByName(spark.range(1).selectExpr("1L a", "2L b"))
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    labels = {r.node: r.label for r in jaccard.smallest_labels(nodes, edges).collect()}
    assert labels == {**{3 * i: 0 for i in range(41)}, 1: 1, 2: 1}


URLS = [None, "no scheme", "http://A.Com", "http://a.com/", "https://x.example.com/en/1?q", "http://www.example.com/en/2#f",
        "http://b.www.EXAMPLE.com/en/", "ftp://n.net/es/x", "http://n.net/fr", "http://n.net/fr/", "http://notcom/", "http://o.org?com/",
        "http://example.com/en", "a://b://c.com/x", "http:///path", "http://com/"]


def plain_url(url):
    """Host, path and rule as the contract words them."""
    at = (url or "").find("://")
    rest = "" if at < 0 else url[at + 3:]
    end = next((i for i, c in enumerate(rest) if c in "/?#"), len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end])
    path = re.split(r"[?#]", rest[end:])[0]
    fits = [(len(h + p), h + p, kind) for kind, h, p in urls.RULES
            if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, *(max(fits)[1:] if fits else (None, None))


def test_rules(spark):
    pages = spark.createDataFrame([(i, u, None) for i, u in enumerate(URLS)], "page_id long, url string, html string")
    for r in urls.judge_pages(pages, rounds=2).collect():
        host, path, rule, kind = plain_url(URLS[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert kind is None or r.verdict == kind


def page(number, host, *links, path="/x"):
    return number, f"http://{host}{path}", "".join(f'<p><a class="k" HREF=\'{u}\'>t</a>' for u in links)


LINKED = [page(0, "good.com", "http://friend.org/a", "//friend.org/b", "/own"), page(1, "friend.org", "https://far.org"),
          page(2, "bad.net", path="/es/1"), page(3, "farm.org", "http://bad.net/", "http://bad.net/2"), page(4, "far.org"),
          page(5, "ring.org", "http://farm.org/"), page(6, "both.org", "http://good.com/", "http://bad.net"), page(7, "alone.org")]


def plain_scores(edges, start, damping, rounds):
    score = dict(start)
    for _ in range(rounds):
        new = defaultdict(float, start)
        for (a, b), share in edges.items():
            new[b] += damping * share * score.get(a, 0.0)
        score = new
    return score


def test_scores_equal_a_plain_propagation(spark):
    pages = spark.createDataFrame(LINKED, "page_id long, url string, html string")
    got_rows = {r.host: r for r in urls.judge_pages(pages, family=False).collect()}
    links = Counter()
    for _, u, html in LINKED:
        a = plain_url(u)[0]
        for x in re.findall(r"HREF='([^']*)'", html):
            b = re.match(r"(?:https?:)?//([^/]+)", x)
            if b and b.group(1) != a:
                links[a, b.group(1)] += 1
    out, into = Counter(), Counter()
    for (a, b), n in links.items():
        out[a] += n
        into[b] += n
    trust = plain_scores({(a, b): n / out[a] for (a, b), n in links.items()}, {"good.com": 0.15}, 0.85, 20)
    distrust = plain_scores({(b, a): n / into[b] for (a, b), n in links.items()}, {"bad.net": 0.15}, 0.85, 20)
    for host, r in got_rows.items():
        assert r.trust == pytest.approx(trust.get(host, 0) / 0.15, abs=1e-5)
        assert r.distrust == pytest.approx(distrust.get(host, 0) / 0.15, abs=1e-5)
    assert {h: r.verdict for h, r in got_rows.items()} == {
        "good.com": "allow", "bad.net": "block", "friend.org": "allow", "far.org": "allow", "farm.org": "block",
        "ring.org": "allow", "both.org": "allow", "alone.org": "allow"}


def test_urls_of_odd_tables(spark):
    rows = [(1, None, None, "c"), (1, None, None, "c"), (None, "http://a.com/x", "<a href=//b.org>" * 5000, "c"), (2, "", "", "c")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host string").selectExpr(
        "*", "'c' as trust", "'c' as rule", "'c' as score_host")
    found = urls.judge_pages(pages, rounds=3)
    assert Counter((r.page_id, r.host, r.verdict) for r in found.collect()) == Counter(
        [(1, "", "allow"), (1, "", "allow"), (None, "a.com", "allow"), (2, "", "allow")])
    assert urls.judge_pages(pages.limit(0), rounds=1).collect() == []


def plain_top(rows, every, k):
    good = [(i, np.floor(np.array(v, float) * 1024).astype(np.int64)) for i, v in rows
            if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, a in good:
        if q % every == 0:
            scored = sorted(((-int(a @ b), i) for i, b in good if i != q and len(b) == len(a)))[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scored)]
    return Counter(out)


@pytest.mark.parametrize("block", [4096, 150])
def test_top_k_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(topk, "CANDIDATES", block)
    monkeypatch.setattr(topk, "QUERIES", 3)
    rng = np.random.default_rng(3)
    near = rng.normal(0, 0.3, 24)
    rows = [(i, (rng.normal(0, 0.2, 24) + near * (i % 3)).round(2).tolist()) for i in range(600)]
    rows += [(600 + i, [0.25] * 24) for i in range(40)] + [(700, None), (701, [None] * 24), (702, [float("nan")] + [0.0] * 23),
             (703, [float("inf")] * 24), (None, [0.1] * 24), (800, [0.0] * 24), (900, [1.0, 2.0]), (901, [2.0, 1.0]), (1000, [])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "'c' as score", "0 as part")
    found = topk.nearest_vectors(frame, every=50, k=7).collect()
    assert Counter((r.query_id, r["rank"], r.vec_id, r.score) for r in found) == plain_top(rows, 50, 7)


def test_reading_rules_out_nearly_all_candidates(spark, sf):
    """On the given embeddings, and with numbers too large for doubles."""
    rows = spark.read.parquet(sf.replace("0.001", "0.01") + "/embeddings.parquet")
    found = [(r.vec_id, r.vector) for r in topk.whole_vectors(rows).collect()]
    ids, vectors = np.array([i for i, _ in found]), np.array([v for _, v in found], np.int64)
    for factor in (1, 1 << 18):
        lists = topk.SortedLists(ids, vectors * factor)
        queries, own = vectors[::50] * factor, ids[::50]
        for q, mine, (best, scores) in zip(queries, own, lists.top(queries, 10, own), strict=True):
            all_scores = (vectors * factor) @ q
            order = [i for i in np.lexsort((ids, -all_scores)) if ids[i] != mine][:10]
            assert best.tolist() == ids[order].tolist() and scores.tolist() == all_scores[order].tolist()
        assert lists.resolved < 0.1 * lists.seen


def test_repeated_queries_and_empty_tables(spark):
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [0.5, 0.5]), (1, [0.5, 0.5])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found = topk.nearest_vectors(frame).collect()
    assert sorted((r["rank"], r.vec_id, r.score) for r in found) == [(1, 1, 524288)] * 2 + [(2, 1, 524288)] * 2
    assert topk.nearest_vectors(frame.limit(0)).collect() == []


def test_hosts_of_many_labels_reach_their_domain(spark):
    from reviewlake.llm.urls import host_edges

    for n in (60, 200):
        host = ".".join(["a"] * (n - 2) + ["site", "org"])
        pages = spark.createDataFrame([(host, "x")], "host string, html string")
        edges = {r.src: r.dst for r in host_edges(pages).collect()}
        steps = 0
        while host in edges and steps < 300:
            host, steps = edges[host], steps + 1
        assert host == "site.org"


def test_few_links_are_joined_up_without_rounds(spark):
    """The smallest labels, and a long chain does not keep the driver planning."""
    rng = random.Random(3)
    order = rng.sample(range(-400, 400), 600)
    links = [*zip(order, order[1:300]), *[(order[rng.randrange(300, 600)], order[rng.randrange(300, 600)]) for _ in range(200)], (7, 7)]
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    edges = spark.createDataFrame(links, "a long, b long").repartition(5)
    nodes = spark.createDataFrame([(n,) for n in [*sorted(up), 5000]], "node long")
    want = {n: root(n) for n in up} | {5000: 5000}
    spark.sparkContext.setJobGroup("few-links", "")
    try:
        found = jaccard.smallest_labels(nodes, edges)
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("few-links"))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert {r.node: r.label for r in found.collect()} == want
    assert jobs <= 6
