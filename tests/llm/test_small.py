"""Operators of the subpackage on small fixtures, held against brute force; nulls, empties, ties, repeats, clashing columns."""

import hashlib
import math
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lithic.llm import bpe, components, exact_dedup, html_text, near_dedup, packing, quality_classifier, quality_rules, simhash, substring_dedup, token_counts, warc_revisits

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
R = random.Random(1)
WORDS = [f"w{k}" for k in range(400)]
PASSAGE = " ".join(R.choices(WORDS, k=60))
TEXTS = [
    None, "", " \t\n", "One two", "one TWO", "ÄB", "äb", "Äb", "a" * 3000, " ".join(["x"] * 200), " ".join(R.choices(WORDS, k=3000)),
    PASSAGE, PASSAGE, PASSAGE.upper(), "start " + PASSAGE + "\nend", " ".join(R.choices(WORDS, k=30)) + "  " + PASSAGE + " tail", PASSAGE + " " + PASSAGE,
    *[" ".join(R.choices(WORDS, k=R.randrange(1, 150))) for _ in range(25)], "a\x1cb\x85c d e",
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, "en", f"s{k % 3}", len(t or "")) for k, t in enumerate(TEXTS)] + [(5, "ÄB", "en", None, 2), (None, "no id", "en", "s1", 5)]
    df = spark.createDataFrame(rows, SCHEMA)
    clash = ["id", "norm", "sha", "keep_id", "fp", "shard", "kind", "h", "uid", "words", "f", "n", "label", "table"]
    return df.select("*", *[F.lit("x").alias(c) for c in clash]).repartition(3)


def got(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def every(docs):
    return [(r.doc_id, r.text or "") for r in docs.collect()]


def words(t):
    return t.encode().split()


def lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def test_exact_dedup(docs):
    groups = {}
    for i, t in every(docs):
        groups.setdefault(lower(t), []).append(i)
    want = []
    for t, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        want += [(i, keep, len(ids), i == keep, hashlib.sha256(t.encode()).hexdigest()) for i in ids]
    assert got(exact_dedup.exact_dedup(docs, salts=3), "doc_id", "keep_id", "group_size", "kept", "text_sha256") == sorted(want, key=repr)


def test_bpe(docs):
    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    want = []
    for i, text in every(docs):
        e = t.encode(text, add_special_tokens=False)
        want.append((i, len(e.ids), hashlib.sha256(",".join(map(str, e.ids)).encode()).hexdigest(), hashlib.sha256(t.decode(e.ids, skip_special_tokens=False).encode()).hexdigest()))
    assert got(bpe.bpe_digests(docs, path), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(want, key=repr)


def test_bpe_words():
    path = public_tokenizers.path("byte_bpe_50k.json")
    with open(path) as f:
        e = bpe.Encoder(bpe.Bpe(f.read()))
    t = Tokenizer.from_file(path)
    texts = ["".join(R.choices("aeinrstAB eo1,.\n\t é漢🎉'<|>", k=60)) for _ in range(300)] + ["<|endoftext|>", "a<|endoftext|> b", "ab" * 3000, " " * 50 + "x"]
    assert [a for a, _ in e.encode(texts)] == [",".join(map(str, x.ids)) for x in t.encode_batch(texts, add_special_tokens=False)]
    assert [b for _, b in e.encode(texts)] == texts
    assert e.bpe.decode(t.encode("héllo").ids) == "héllo"


def brute_fingerprint(t, k):
    w = t.encode().lower().split()
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + k]), 42) for i in range(max(1, len(w) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize(("shingle", "bits", "blocks"), [(3, 2, 8), (5, 4, 9)])
def test_simhash(docs, shingle, bits, blocks):
    near = [(1000 + k, PASSAGE.replace(f" {w} ", " other ", 1) + " " + PASSAGE[::-1], None, None, 0) for k, w in enumerate(PASSAGE.split()[1:4])]
    docs = docs.select("doc_id", "text", "lang", "source", "n_chars").union(docs.sparkSession.createDataFrame(near, SCHEMA))
    rows = [(i, brute_fingerprint(t, shingle)) for i, t in every(docs)]
    comp = {i: i for i, _ in rows if i is not None}

    def linked(a, b):
        return (a[1] ^ b[1]).bit_count() <= bits

    changed = True
    while changed:
        changed = False
        for a in rows:
            for b in rows:
                if a[0] is not None and b[0] is not None and comp[b[0]] < comp[a[0]] and linked(a, b):
                    comp[a[0]], changed = comp[b[0]], True
    out = simhash.simhash_neardup(docs, shingle=shingle, max_distance=bits, blocks=blocks)
    found = {r.doc_id: (r.fingerprint, r.component_id) for r in out.collect()}
    assert out.count() == len(rows)
    assert {i: v for i, v in found.items() if i is not None} == {i: (f"{f:016x}", comp[i]) for i, f in rows if i is not None}


def test_gray_index_in_dense_groups():
    rng = np.random.default_rng(3)
    for limit in range(4):
        base = rng.integers(0, 1 << 62, dtype=np.uint64)
        codes = np.unique(np.array([base ^ np.uint64(sum(1 << int(b) for b in rng.choice(18, rng.integers(0, 7), replace=False))) for _ in range(300)], np.uint64))
        codes = codes[np.argsort(simhash.gray_rank(codes))]
        root = simhash.GrayIndex(np.zeros(len(codes), int), codes).connect(limit).root
        want, old = np.arange(len(codes)), None
        near = np.bitwise_count(codes[:, None] ^ codes[None, :]) <= limit
        while old is None or (old != want).any():
            old, want = want, np.where(near, want[None, :], len(codes)).min(1)
        assert (root == want).all()


def test_components(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 130)] + [(7, 7), (200, 201), (201, 200)]
    out = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert out == {**{k: 0 for k in range(1, 41)}, **{k: 100 for k in range(101, 130)}, 201: 200}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("at_once", [1 << 20, 50, 0])
def test_components_in_tasks_and_in_rounds(spark, monkeypatch, at_once):
    """Of random graphs and shuffled paths, whether the edges left fit one task or not."""
    monkeypatch.setattr(components, "AT_ONCE", at_once)
    r = random.Random(at_once)
    names = list({r.randrange(-(1 << 62), 1 << 62) for _ in range(400)})
    r.shuffle(names)
    edges = [(k, k + 1) for k in range(120)] + [tuple(r.choices(range(150, 400), k=2)) for _ in range(150)] + [(390, 390), (0, 1), (1, 0)]
    r.shuffle(edges)
    order = sorted(names)
    place = {v: k for k, v in enumerate(order)}
    want = least_reachable(400, [(place[names[a]], place[names[b]]) for a, b in edges])
    out = components.components(spark.createDataFrame([(names[a], names[b]) for a, b in edges], "a long, b long").repartition(5)).collect()
    assert sorted((x.node, x.root) for x in out) == [(order[k], order[v]) for k, v in enumerate(want) if k != v]


def test_components_of_few_edges_take_few_tasks(spark):
    """An exchange for each step of each round gave check_h 211 tasks a time: most of the disk and time of the pipeline's near-dedup."""
    sc = spark.sparkContext
    edges = spark.createDataFrame([(k, k + 1) for k in range(500)], "a long, b long").repartition(4)
    sc.setJobGroup("few-edges", "")
    try:
        assert components.components(edges).count() == 500
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    of = sc.statusTracker()
    ran = [of.getStageInfo(s) for j in of.getJobIdsForGroup("few-edges") for s in of.getJobInfo(j).stageIds]
    assert 0 < sum(x.numCompletedTasks for x in ran if x) <= 40


def test_substring(docs):
    rows = every(docs)
    seen = Counter(tuple(w[k : k + 35]) for _, t in rows if len(w := words(t)) >= 35 for k in range(len(w) - 34))
    want = []
    for i, t in rows:
        w = words(t)
        gone = {j for k in range(len(w) - 34) if seen[tuple(w[k : k + 35])] > 1 for j in range(k, k + 35)}
        kept = b" ".join(x for j, x in enumerate(w) if j not in gone)
        want.append((i, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    assert got(substring_dedup.substring_dedup(docs, shard_rows=10), "doc_id", "n_words", "n_removed", "kept_sha256") == sorted(want, key=repr)


def test_word_hashes():
    """Equal words have equal hashes wherever they stand, different ones different hashes; words of more than a block too."""
    r = random.Random(9)
    pool = [bytes(r.choices(b"abc\xc3\xa4", k=r.randrange(1, 9))) for _ in range(3000)] + [b"x" * 70_000, b"x" * 70_001, b"y" * 200_000]
    words_ = r.choices(pool, k=60_000) + pool
    data = b"".join(w + r.choice([b" ", b"\n", b" \t\r", b"\x0b\x0c"]) for w in words_)
    starts, h = substring_dedup.word_hashes(np.frombuffer(data, np.uint8))
    found = {}
    assert len(h) == len(words_) and [data[s : s + len(w)] for s, w in zip(starts.tolist(), words_)] == words_
    for w, x in zip(words_, h.tolist()):
        assert found.setdefault(w, x) == x
    assert len(set(found.values())) == len(found)


def test_substring_needs_its_automata(docs, monkeypatch):
    """Every removed word lies under a hit of an automaton: without passages nothing goes."""
    monkeypatch.setattr(substring_dedup, "passage_rows", lambda width: lambda d, r: __import__("pyarrow").table({"g": [], "h": [], "words": []}, schema=__import__("pyarrow").schema([("g", "int64"), ("h", "int64"), ("words", "binary")])))
    assert {r.n_removed for r in substring_dedup.substring_dedup(docs, shard_rows=10).collect()} == {0}


def test_quality_rules(docs):
    trusted = docs.where("doc_id > 16").select("doc_id")
    out = {r.doc_id: r for r in quality_rules.quality_rules(docs, trusted, buckets=512).collect()}
    for i, t in every(docs):
        w, lines = words(t), [x for x in t.split("\n") if words(x)]
        seen = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        rep = len({j for k in range(len(w) - 2) if seen[tuple(w[k : k + 3])] > 1 for j in range(k, k + 3)})
        r = out[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(len(x.decode()) for x in w), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), rep)
        assert r.base_failed == (len(w) < 50 or 100 * rep > 50 * len(w)) and not (r.base_failed and r.kept)


def test_quality_rules_rejects_what_trusted_texts_lack(spark):
    good = [(k, " ".join(R.choices(WORDS[:100], k=80))) for k in range(60)]
    bad = [(k, " ".join(R.choices(["###", "$$$", "%%%", "|"], k=20) + R.choices(WORDS[300:], k=60))) for k in range(60, 80)]
    df = spark.createDataFrame(good + bad, "doc_id long, text string")
    out = {r.doc_id: r.kept for r in quality_rules.quality_rules(df, df.where("doc_id < 40").select("doc_id"), buckets=4096).collect()}
    assert all(out[k] for k in range(60)) and not any(out[k] for k in range(60, 80))


def test_quality_classifier(spark):
    rows = [(k, " ".join(R.choices(WORDS[:100], k=50)) if k % 2 else " ".join(R.choices(WORDS[:8], k=3) * 20)) for k in range(300)] + [(300, None), (301, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("label", F.lit("x"))
    labels = spark.createDataFrame([(k, k % 2) for k in range(300)] + [(None, 1), (5, None)], "doc_id long, quality int")
    out = quality_classifier.quality_classifier(df, labels).collect()
    import zlib

    assert len(out) == 302 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in out)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out)
    held = [r for r in out if r.held_out and r.doc_id < 300]
    assert sum(r.predicted == r.doc_id % 2 for r in held) >= 0.95 * len(held)
    assert {r.score for r in quality_classifier.quality_classifier(df, labels.limit(0)).collect()} == {0.5}


def test_html():
    page = """<html><head><title>T</title><style>p{}</style></head><body class="with-sidebar"><header><a href="/">Home</a></header><div class="cookie-notice">We use cookies</div>
    <main><article><h1>Head &amp; more</h1><p>Some <b>bold</b>&nbsp;text<br>goes on.<!-- no --><p>Next</p><div class="ad">Buy</div><script>var x = "</p>";</script><form><input><label>Mail</label></form>
    <div id="comments"><p>A long reader comment, with many words, that looks like a paragraph of the article itself.</p></div></article></main><aside><p>Other</p></aside><footer>&copy; us</footer></body></html>"""
    assert html_text.main_text(page) == "Head & more\nSome bold text goes on.\nNext"
    assert html_text.main_text(None) == html_text.main_text("") == html_text.main_text("<p></p>") == ""
    assert html_text.main_text("<article>" + "<p>a</p>" * 3000 + "</article>").count("\n") == 2999


ARTICLE = " ".join(f"Sentence {k} of the article, with some words." for k in range(8))


@pytest.mark.parametrize("attribute", [
    'aria-hidden="false"', "title='the hidden gem'", "data-id='social-7'", "class='post has-sidebar'", "class='content with-sidebar'", "class='post header-image'", "id='related-work'",
    "class='entry no-comments'", 'data-x="class=ad"', "class='article-header'",
])
def test_html_attributes_that_only_mention_boilerplate(attribute):
    page = f"<body><nav><a href=/>Home</a></nav><div {attribute}><p>{ARTICLE}</p></div><footer>us</footer></body>"
    assert html_text.main_text(page) == ARTICLE


@pytest.mark.parametrize("attribute", ["class='ad'", "class='cookie-notice'", "id=sidebar-left", "role='navigation'", "class=' x commentList'", "hidden", "style='color:red; display : none'", "class='share-buttons'", "class='site-footer'", "itemprop=comment"])
def test_html_marked_boilerplate_goes(attribute):
    assert html_text.main_text(f"<body><article><p>{ARTICLE}</p></article><div {attribute}><p>{ARTICLE[::-1]}</p></div></body>") == ARTICLE


def test_html_reader_comments_below_their_heading():
    page = f"<article><h1>Head</h1><p>{ARTICLE}</p><section class='x9'><h3>2 Comments</h3><div><p>{ARTICLE} I say.</p></div><p>{ARTICLE} Me too.</p></section><p>An end, of the article.</p></article>"
    assert html_text.main_text(page) == f"Head\n{ARTICLE}\nAn end, of the article."
    assert html_text.main_text(f"<article><p>{ARTICLE}</p><p>Let <math><mi>x</mi><mo>=</mo><mn>2</mn></math> hold.</p></article>") == f"{ARTICLE}\nLet x=2 hold."


def test_html_is_read_in_linear_time():
    import time

    began = time.perf_counter()
    for tail in ("<a " + " ".join(f"b{k}='c'" for k in range(200)), "<a " * 50_000, "<" * 100_000, "<a b=\"" * 30_000, "<a ='" * 30_001, "<!--" * 50_000, "<script>" * 20_000, "</script" * 20_000, "<p " + "=" * 100_000, "<div>" * 3000, "&" * 50_000):
        assert html_text.main_text(f"<article><p>{ARTICLE}</p>{tail}").startswith(ARTICLE)
    assert time.perf_counter() - began < 20


def test_html_weights_are_fitted(spark):
    page = lambda k: f"<body><nav><ul><li><a href=/>Link {k}</a></li><li><a href=/>Other</a></li></ul></nav><article><h1>Title {k}</h1><p>{ARTICLE} {k}.</p><p>More of it, {k}.</p></article><footer>us</footer></body>"
    df = spark.createDataFrame([(page(k % 60),) for k in range(80)], "html string")
    weights = html_text.taught(df, 50)
    assert weights is not None and weights[2] < 0 < weights[3] and (html_text.taught(df.repartition(7), 50) == weights).all()
    plain = f"<body><div><a href=/>Home</a> <a href=/>News</a></div><div><p>{ARTICLE}</p><p>More of it, too.</p></div></body>"
    assert html_text.main_text(plain, weights) == f"{ARTICLE}\nMore of it, too."
    assert html_text.taught(df.limit(0), 50) is None and html_text.taught(df.limit(3), 50) is None


def test_html_planted_pages(spark):
    """Whole pages with known main text, in several dresses, against what was planted."""
    r, rows = random.Random(3), []
    dresses = [("<main>", "</main>"), ("<article>", "</article>"), ("<div class='post-content'>", "</div>"), ("<div id=content><section>", "</section></div>"), ("<div>", "</div>")]
    for k in range(100):
        paragraphs = [" ".join(r.choices(WORDS, k=r.randrange(25, 60))) + "." for _ in range(r.randrange(2, 9))]
        a, b = dresses[k % 5]
        menu = "".join(f"<li><a href='/{w}'>{w}</a></li>" for w in r.choices(WORDS, k=6))
        body = "".join(f"<p>{p.replace(' ', ' <b>', 1).replace(' ', '</b>  ', 2) if k % 3 == 0 else p}</p>" for p in paragraphs)
        page = f"<html><head><title>t</title></head><body><nav><ul>{menu}</ul></nav><div class='ad'>Buy {k}</div>{a}<h1>Head {k}</h1>{body}{b}<aside><p>{' '.join(r.choices(WORDS, k=20))}</p></aside><footer>&copy; {k}</footer></body></html>"
        rows.append((k, page, "\n".join([f"Head {k}", *paragraphs])))
    out = {x.page_id: x.text for x in html_text.html_main_text(spark.createDataFrame(rows, "page_id long, html string, want string").withColumn("url", F.lit("u"))).collect()}
    clean = lambda t: " ".join(t.replace("<b>", "").split())
    assert [k for k, _, want in rows if clean(out[k]) != clean(want)] == []


def test_minimum_cut():
    for _ in range(150):
        n = R.randrange(1, 8)
        margin = [R.randrange(-9, 10) for _ in range(n)]
        pairs = [(a, b, R.randrange(1, 7)) for a in range(n) for b in range(a) if R.random() < 0.5]
        cost = lambda x: sum(max(m, 0) for m, c in zip(margin, x) if not c) + sum(max(-m, 0) for m, c in zip(margin, x) if c) + sum(w for a, b, w in pairs if x[a] != x[b])  # noqa: B023, E731
        least = min(cost([k >> j & 1 for j in range(n)]) for k in range(1 << n))
        assert cost(html_text.minimum_cut(margin, pairs)) == least


def test_html_rows(spark):
    df = spark.createDataFrame([(1, "u", "<p>Long enough text to be the content of this page, surely, it is.</p>"), (2, None, None)], "page_id long, url string, html string").withColumn("text", F.lit(1))
    assert [r.n_chars for r in html_text.html_main_text(df).orderBy("page_id").collect()] == [len("Long enough text to be the content of this page, surely, it is."), 0]


def test_packing(docs):
    out = packing.pack(docs, capacity=100, shard_rows=15).collect()
    n = Counter()
    for r in out:
        n[r.doc_id] += r.n_words
    want = Counter()
    for i, t in every(docs):
        want[i] += len(words(t))
    assert n == want and len({r.doc_id for r in out}) == len({i for i, _ in every(docs)})
    bins = {}
    for r in out:
        bins.setdefault(r.bin_id, []).append(r)
    for b in bins.values():
        assert sum(r.n_words for r in b) <= 100 and len({r.source for r in b}) == len(b)


def test_best_fit_is_tightest_compatible():
    sizes = sorted((R.randrange(0, 60) for _ in range(300)), reverse=True)
    sources, clusters = [R.randrange(20) for _ in sizes], [R.randrange(90) for _ in sizes]
    out = packing.best_fit(sizes, sources, clusters, 100)
    left, held = {}, {}
    for s, a, c, b in zip(sizes, sources, clusters, out):
        fit = [(left[k], k) for k in left if left[k] >= s and left[k] > 0 and all(x != a and y != c for x, y in held[k])]
        assert (b == min(fit)[1]) if fit else b not in left
        left[b] = left.get(b, 100) - s
        held.setdefault(b, []).append((a, c))


def test_token_counts(docs):
    scores, byte = token_counts.vocabulary_scores(public_tokenizers.path("piece_bpe_32k.model"))

    def brute(w):
        t = "▁" + w
        best = [(0.0, 0)] + [(-math.inf, 0)] * len(t)
        for e in range(1, len(t) + 1):
            nb = len(t[e - 1].encode())
            options = [(best[e - 1][0] + nb * byte, best[e - 1][1] + nb)] + [(best[b][0] + scores[t[b:e]], best[b][1] + 1) for b in range(e - 1, -1, -1) if t[b:e] in scores]
            best[e] = max(options, key=lambda x: x[0])
        return best[-1][1]

    want = [(i, len(words(t)), sum(brute(w.decode()) for w in words(t) if len(w) < 100)) for i, t in every(docs) if len(t) != 3000]
    out = [x for x in got(token_counts.token_counts(docs, public_tokenizers.path("piece_bpe_32k.model")), "doc_id", "n_pretokens", "n_tokens") if x[0] != 8]
    assert out == sorted(want, key=repr)


def test_revisits(spark):
    h = lambda **k: {a.replace("_", "-"): b for a, b in k.items()}
    rows = [(k, "http://Hot.org/a/?b=2&a=1#x", k, "response" if k % 5 == 0 else "revisit", h(ETag=f'"{k // 5 * 5 if k % 7 else 1}"', X_A=str(k), Date=str(k), Content_Length="9")) for k in range(200)]
    rows += [(900, "https://www.other.org", 1, "revisit", h(ETag='"z"')), (901, None, None, "revisit", None), (902, "m.hot.org:80/a?a=1&b=2&ref=q", 400, "revisit", h(ETag='W/"195"')), (903, "x", 1, "warcinfo", None)]
    df = spark.createDataFrame(rows, "record_id long, url string, ts long, kind string, headers map<string,string>").withColumn("canonical", F.lit(1))
    out = {r.record_id: r for r in warc_revisits.resolve_revisits(df).collect()}
    assert len(out) == 163 and out[900].status == out[901].status == "no_response" and out[902].resolved_id == 195
    for k in range(200):
        if k % 5:
            last = k // 5 * 5
            fits = (last if last % 7 else 1) == (last if k % 7 else 1)
            assert (out[k].status, out[k].resolved_id) == (("resolved", last) if fits else ("validator_mismatch", None))
    assert out[6].headers["x-a"] == "5" and out[6].headers["date"] == "6" and out[6].canonical == "hot.org/a?a=1&b=2"


def test_capture_log_has_every_case(spark):
    pages = spark.createDataFrame([(k, f"http://www.h{k}.org/{k}/", f"<p>{k}</p>") for k in range(16)] + [(None, "u", None)], "page_id long, url string, html string")
    out = {r.record_id: r for r in warc_revisits.resolve_revisits(warc_revisits.capture_log(pages)).collect()}
    assert len(out) == 28 and all((out[4 * k + 1].status, out[4 * k + 1].resolved_id) == ("resolved", 4 * k) for k in range(16))
    for first in (0, 32):
        section = [out[first + 4 * k + 2] for k in (0, 2, 3, 5, 6, 7)]
        assert [r.status for r in section] == ["no_response", "resolved", "validator_mismatch", "validator_mismatch", "resolved", "validator_mismatch"]
        assert [r.resolved_id for r in section] == [None, first + 6, None, None, first + 18, None]


def test_a_response_of_the_same_time_is_not_earlier(spark):
    rows = [(1, "u", 5, "response", {"etag": "a"}), (2, "u", 5, "revisit", {"etag": "a"}), (3, "u", 6, "revisit", {"etag": "a"}), (3, "u", 6, "revisit", {"etag": "a"}), (4, "u", None, "revisit", None)]
    out = warc_revisits.resolve_revisits(spark.createDataFrame(rows, "record_id long, url string, ts long, kind string, headers map<string,string>")).collect()
    assert sorted((r.record_id, r.status, r.resolved_id) for r in out) == [(2, "no_response", None), (3, "resolved", 1), (3, "resolved", 1), (4, "no_response", None)]


def test_empty_tables(spark):
    docs = spark.createDataFrame([], SCHEMA)
    labels = spark.createDataFrame([], "doc_id long, quality int")
    for out in (
        exact_dedup.exact_dedup(docs), simhash.simhash_neardup(docs), substring_dedup.substring_dedup(docs), packing.pack(docs), quality_rules.quality_rules(docs, labels), quality_classifier.quality_classifier(docs, labels),
        bpe.bpe_digests(docs, public_tokenizers.path("byte_bpe_50k.json")), token_counts.token_counts(docs, public_tokenizers.path("piece_bpe_32k.model")),
        warc_revisits.resolve_revisits(spark.createDataFrame([], "record_id long, url string, ts long, kind string, headers map<string,string>")),
        html_text.html_main_text(spark.createDataFrame([], "page_id long, url string, html string")),
    ):
        assert out.count() == 0


def test_pipeline_stages(spark):
    import corpus_pipeline

    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet").where("doc_id < 60").cache()
    for (name, stage), n in zip(corpus_pipeline.STAGES, (6, 9, 3, 4, 8), strict=True):
        out = stage(spark, docs, d)
        if n == 8:
            assert out.select("doc_id").distinct().count() == docs.count()
        else:
            assert out.columns == docs.columns, name
            assert 0 < out.count() <= docs.count(), name


def near_copies():
    """Families of a random text and copies with some words replaced, similarity about 0.6 to 1."""
    r, out = random.Random(7), []
    for _ in range(40):
        base = [f"v{r.randrange(5000)}" for _ in range(r.randrange(40, 400))]
        out.append(base)
        for _ in range(3):
            copy = list(base)
            for k in r.sample(range(len(base)), max(1, int(len(base) * r.uniform(0.005, 0.05)))):
                copy[k] = f"v{r.randrange(5000)}"
            out.append(copy)
    return [" ".join(t) for t in out] + [None, "", " \n", "one two", "One  two", "x", PASSAGE, PASSAGE]


def five_words(t):
    w = (t or "").encode().lower().split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def exact_links(texts):
    sets = [five_words(t) for t in texts]
    return {(a, b) for b in range(len(sets)) for a in range(b) if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])}


def least_reachable(n, links):
    name, old = list(range(n)), None
    while name != old:
        old = list(name)
        for a, b in links:
            name[a] = name[b] = min(name[a], name[b])
    return name


@pytest.mark.parametrize(("rounds", "in_tasks"), [(8, 4000), (8, 0), (2, 0), (0, 0)])
def test_near_dedup_confirms_by_exact_jaccard(spark, monkeypatch, rounds, in_tasks):
    """Whatever is settled in rounds of joins, and what in tasks."""
    monkeypatch.setattr(near_dedup, "ROUNDS", rounds)
    monkeypatch.setattr(near_dedup, "IN_TASKS", in_tasks)
    texts = near_copies()
    want = least_reachable(len(texts), exact_links(texts))
    df = spark.createDataFrame([(k, t, 0) for k, t in enumerate(texts)] + [(None, texts[1], 0), (0, "another text of the first id", 0), (None, "no id at all", 0)], "doc_id long, text string, digest int").repartition(3)
    out = near_dedup.near_dedup(df).collect()
    assert len(out) == len(texts) + 3
    assert sorted((r.doc_id, r.component_id) for r in out if r.doc_id) == sorted((k, v) for k, v in enumerate(want) if k)
    assert Counter(r.component_id for r in out if r.doc_id is None) == Counter([want[1], None])


def test_pipeline_near_stage_finds_similarity_of_0_8(spark):
    import corpus_pipeline

    texts = near_copies()
    want = least_reachable(len(texts), exact_links(texts))
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    assert {r.doc_id for r in corpus_pipeline.near(spark, docs, "").collect()} == set(want)


def test_linked_against_all_pairs():
    r = random.Random(5)
    for _ in range(60):
        base = [r.sample(range(60), r.randrange(1, 30)) for _ in range(4)]
        sets = [np.unique(np.array([x for x in r.choice(base) if r.random() < 0.93], np.uint64)) for _ in range(25)]
        links = [(a, b) for b in range(25) for a in range(b) if 5 * len(np.intersect1d(sets[a], sets[b])) >= 4 * len(np.union1d(sets[a], sets[b]))]
        assert near_dedup.linked(sets, 4, 5).tolist() == least_reachable(25, links)


def test_quality_rules_count_every_trusted_text(spark):
    """Of 20,800 trusted texts, one that comes late by hash has words of its own: they count for the target."""
    rows = [(k, "plain common words") for k in range(20_800)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    hashes = [r.doc_id for r in df.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").collect()]
    late = [k for k in hashes[20_000:] if df.sparkSession.range(k, k + 1).select((F.pmod(F.xxhash64("id"), F.lit(64)) < 32).alias("v")).first().v][:1]
    df = df.withColumn("text", F.when(F.col("doc_id").isin(late), "rarely seen thing").otherwise(F.col("text")))
    scores = {r.doc_id: r.llr for r in quality_rules.quality_rules(df, df.select("doc_id"), buckets=4096).where(F.col("doc_id").isin(late)).collect()}
    assert len(late) == 1 and scores[late[0]] > 0


def test_pipeline_stages_decide_by_row(spark, tmp_path):
    """Rows without an id and rows that share one get their own decision and their own text."""
    import corpus_pipeline

    r = random.Random(11)
    fresh = lambda n: " ".join(f"z{r.randrange(10**6)}" for _ in range(n))
    same, near, passage = fresh(60), fresh(300), fresh(50)
    rows = [(None, same), (None, same), (None, near), (None, near + " more"), (7, fresh(20) + " " + passage), (7, fresh(20) + " " + passage + " end"), (None, fresh(9) + " " + passage), (7, fresh(30))]
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], SCHEMA).repartition(2).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    texts = lambda df: Counter((x.doc_id, x.text) for x in df.collect())
    want = Counter(rows)
    want[None, same] -= 1
    assert texts(corpus_pipeline.exact(spark, docs, "")) == want
    kept = corpus_pipeline.near(spark, docs, "").collect()
    assert len(kept) == len(rows) - 2 and sum(x.text.startswith(near) for x in kept) == 1
    cut = Counter((i, t.replace(passage, "")) for i, t in rows if passage in t)
    found = Counter((x.doc_id, x.text) for x in corpus_pipeline.substring(spark, docs, "").collect())
    assert not any(passage in t for _, t in found) and found[rows[7]] == 1
    squeezed = lambda c: Counter({(i, " ".join(t.split())): n for (i, t), n in c.items()})
    assert squeezed(cut) <= squeezed(found) and corpus_pipeline.substring(spark, docs, "").count() == len(rows)


def test_pipeline_quality_stage_decides_by_row(spark, tmp_path):
    import corpus_pipeline

    good = [" ".join(R.choices(WORDS[:100], k=50)) for _ in range(200)]
    bad = [" ".join(R.choices(WORDS[:8], k=3) * 20) for _ in range(200)]
    rows = [(2 * k, t) for k, t in enumerate(good)] + [(2 * k + 1, t) for k, t in enumerate(bad)] + [(None, good[0]), (None, bad[0])]
    spark.createDataFrame([(k, 1 - k % 2) for k in range(400)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], SCHEMA)
    out = corpus_pipeline.quality(spark, docs, str(tmp_path))
    assert out.columns == docs.columns and [r.text for r in out.where("doc_id IS NULL").collect()] == [good[0]]


def test_quality_vectors_come_from_all_texts(spark):
    """A word that no labelled text has gets its context from the unlabelled ones."""
    labelled = [(k, " ".join(R.choices(WORDS[:50], k=30))) for k in range(40)]
    others = [(k, " ".join(["unlabelled", "words", "only"] * 20)) for k in range(40, 60)]
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)], "id long, label int")
    vectors = lambda rows: quality_classifier.fitted(spark.createDataFrame(rows, "id long, text string"), labels, 4000)[0]
    few, all_of_them = vectors(labelled), vectors(labelled + others)
    assert np.count_nonzero(np.abs(all_of_them).sum(1)) > np.count_nonzero(np.abs(few).sum(1))


def test_pipeline_against_brute_force(spark, tmp_path):
    """run() over some hundred rows with nulls, repeats and copies: every stage as a plain function decides it, on the rows that the stage before it kept."""
    import corpus_pipeline
    from lithic.llm.common import table

    r = random.Random(23)
    fresh = lambda n: " ".join(f"q{r.randrange(10**6)}" for _ in range(n))
    junk = lambda: " ".join(["spam", "$$$", "click"] * r.randrange(15, 25))
    passage = fresh(60)
    rows, labels = [], []
    for k in range(240):
        good = k % 3 > 0
        rows.append((k, f"{fresh(r.randrange(40, 120))}" if good else junk()))
        labels.append((k, int(good)))
    base = [t for _, t in rows if t.startswith("q")]
    rows += [(300 + k, base[k]) for k in range(6)] + [(310 + k, base[k].upper()) for k in range(3)] + [(320, base[10] + " tail"), (321, "head " + base[11]), (None, base[12]), (None, fresh(70)), (7, fresh(50)), (330, None), (331, "")]
    rows += [(340 + k, f"{fresh(30)} {passage} {fresh(10)}") for k in range(4)] + [(None, f"{fresh(30)} {passage}")]
    data = [(i, t, "en" if i is None or i % 2 else None, None if i == 5 else f"s{(i or 0) % 9}", None if t is None else len(t)) for i, t in rows]
    spark.createDataFrame(data, SCHEMA).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    d = str(tmp_path)
    scored = quality_classifier.quality_classifier(table(spark, d, "documents"), table(spark, d, "labels"))
    verdict = {}
    for x in scored.join(table(spark, d, "documents").select("doc_id", "text"), "doc_id").collect():
        verdict.setdefault((x.doc_id, x.text), set()).add(x.predicted)
    kept = [x for x in corpus_pipeline.quality(spark, table(spark, d, "documents"), d).collect()]
    junk_ids = {i for i, t in rows if t and t.startswith("spam")}
    assert not junk_ids & {x.doc_id for x in kept} and len(kept) >= len(rows) - len(junk_ids) - 2
    # exact: of equal texts the largest id; a row without an id only where no other has the text
    groups = {}
    for x in kept:
        groups.setdefault(lower(x.text or ""), []).append((x.doc_id, x.text))
    exact = []
    for copies in groups.values():
        ids = [i for i, _ in copies if i is not None]
        exact += [(max(ids), t) for i, t in copies if i == max(ids)][:1] if ids else copies[:1]
    # near: five-word Jaccard of 0.8, the smallest id of a group
    sets = [five_words(t) for _, t in exact]
    links = {(a, b) for b in range(len(sets)) for a in range(b) if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])}
    tree, near = least_reachable(len(sets), links), {}
    for k, row in enumerate(exact):
        near.setdefault(tree[k], []).append(row)
    near = [min(g, key=lambda x: (x[0] is None, x[0] or 0)) for g in near.values()]
    # substring: words under a window of 35 words that begins twice
    seen = Counter(tuple(w[k : k + 35]) for _, t in near for w in [words(t or "")] for k in range(len(w) - 34))
    want = Counter()
    for i, t in near:
        w = words(t or "")
        gone = {j for k in range(len(w) - 34) if seen[tuple(w[k : k + 35])] > 1 for j in range(k, k + 35)}
        want[i] += len(w) - len(gone)
    out = corpus_pipeline.run(spark, d).collect()
    got_words, bins = Counter(), {}
    for x in out:
        got_words[x.doc_id] += x.n_words
        bins.setdefault(x.bin_id, []).append(x)
    assert got_words == want and len({x.doc_id for x in out}) == len({i for i, _ in near})
    assert all(sum(x.n_words for x in b) <= 2048 and len({x.source for x in b}) == len(b) for b in bins.values())
    assert not any(passage in (x.text or "") for x in corpus_pipeline.substring(spark, spark.createDataFrame([(i, t, "en", "s", 0) for i, t in near], SCHEMA), d).collect())


def test_pipeline_over_empty_tables(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_quality_held_out_over_real_labels(spark):
    """Held-out accuracy on the labelled rows that teach nothing."""
    d = "/root/testdata/sf0.01"
    out = quality_classifier.quality_classifier(spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")).where("held_out")
    rows = out.join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").collect()
    assert len(rows) >= 50 and sum(r.predicted == r.quality for r in rows) >= 0.95 * len(rows)


def test_quality_rules_llr_against_brute_force(docs):
    """llr and kept from counts made in plain Python with the same hashes."""
    spark, buckets = docs.sparkSession, 512
    trusted = docs.where("doc_id > 16").select("doc_id")
    out = quality_rules.quality_rules(docs, trusted, buckets=buckets).collect()
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).collect()
    every_word = sorted({w for r in rows for w in words(r.text)})
    h = {w: x for w, x in zip(every_word, [r.h for r in spark.createDataFrame([(k, w.decode()) for k, w in enumerate(every_word)], "k long, w string").orderBy("k").select(F.xxhash64("w").alias("h")).collect()])}
    pairs = sorted({p for r in rows for p in zip(words(r.text), words(r.text)[1:])})
    both = spark.createDataFrame([(k, h[a], h[b]) for k, (a, b) in enumerate(pairs)], "k long, a long, b long").orderBy("k").select(F.xxhash64("a", "b").alias("h")).collect()
    h2 = {p: x.h for p, x in zip(pairs, both)}
    grams = lambda t: [h[w] % buckets for w in words(t)] + [h2[p] % buckets for p in zip(words(t), words(t)[1:])]
    ids = {r.doc_id for r in trusted.collect()}
    fit = {r.doc_id: r.f for r in trusted.distinct().select("doc_id", (F.pmod(F.xxhash64("doc_id"), F.lit(64)) < 32).alias("f")).collect()}
    raw, target = Counter(), Counter()
    for r in rows:
        raw.update(grams(r.text))
        if r.doc_id in ids and fit[r.doc_id]:
            target.update(grams(r.text))
    n_raw, n_target = sum(raw.values()), sum(target.values())
    ratio = lambda b: math.log(0.5 + 0.5 * target[b] / n_target / ((raw[b] + 1) / (n_raw + buckets)))
    score = lambda t: sum(map(ratio, grams(t))) / len(grams(t)) if grams(t) else 0.0
    got_scores, want_scores = sorted((repr(r.doc_id), r.n_words, round(r.llr, 9)) for r in out), sorted((repr(r.doc_id), len(words(r.text)), round(score(r.text), 9)) for r in rows)
    assert got_scores == want_scores
    held = sorted(score(r.text) for r in rows if r.doc_id in ids and not fit[r.doc_id] and len(words(r.text)) >= 50)
    least = (float(np.percentile(held, 0.2)) if held else 0.0) - 0.02
    assert all(r.kept == (not r.base_failed and r.llr >= least) for r in out if abs(r.llr - least) > 1e-9)


def test_repeated_rows_are_each_returned(spark):
    page = [(1, "u", f"<article><p>{ARTICLE}</p></article>")] * 3 + [(None, None, None)] * 2
    assert sorted(x.n_chars for x in html_text.html_main_text(spark.createDataFrame(page, "page_id long, url string, html string")).collect()) == [0, 0, len(ARTICLE), len(ARTICLE), len(ARTICLE)]
    rows = [(k % 4, f"text {k % 4} again and again") for k in range(12)]
    labels = spark.createDataFrame([(0, 1), (0, 1), (1, 0), (2, 1)], "doc_id long, quality int")
    assert quality_classifier.quality_classifier(spark.createDataFrame(rows, "doc_id long, text string"), labels).count() == 12


def test_very_long_texts(spark):
    """200,000 words in one text: nothing is read only in part."""
    r = random.Random(3)
    long = " ".join(f"l{r.randrange(5000)}" for _ in range(200_000))
    df = spark.createDataFrame([(1, long), (2, "short one")], "doc_id long, text string")
    path = public_tokenizers.path("piece_bpe_32k.model")
    assert {x.doc_id: x.n_pretokens for x in token_counts.token_counts(df, path).collect()} == {1: 200_000, 2: 2}
    parts = token_counts.token_counts(spark.createDataFrame([(k, " ".join(long.split()[k * 50_000 : (k + 1) * 50_000])) for k in range(4)], "doc_id long, text string"), path)
    assert token_counts.token_counts(df, path).where("doc_id = 1").first().n_tokens == sum(x.n_tokens for x in parts.collect())
    vectors = quality_classifier.Vectors()
    assert abs(vectors.pooled([long])[0] - np.mean([vectors.pooled([" ".join(long.split()[k * 8192 : (k + 1) * 8192])])[0] for k in range(24)], axis=0))[:64].max() < 0.05
