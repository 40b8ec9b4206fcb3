"""The training-data operators against brute force, round trips and held-out accuracy."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corvane.llm import components as C
from corvane.llm import decontamination as D
from corvane.llm import html_text, language_id, masked_lm, packing, shingles, toxicity
from corvane.llm.exact_topk import exact_topk
from corvane.llm.jaccard_join import jaccard_components, parity
from corvane.llm.queries import QUERIES, tokenizer_path
from corvane.llm.sharding import shard
from corvane.llm.url_filter import url_filter


def shingle_set(text):
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not w:
        return frozenset()
    return frozenset([tuple(w)]) if len(w) < 5 else frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4))


def brute_components(rows, percent=80):
    sets = {i: shingle_set(t) for i, t in rows}
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if sets[a] and sets[b]:
                n = len(sets[a] & sets[b])
                if 100 * n >= percent * len(sets[a] | sets[b]):
                    x, y = root(a), root(b)
                    up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in ids}


def near_copies(seed, groups=6, copies=40, words=60):
    """Groups of variants of one text, many of them just about linked, plus a passage that all share."""
    rng = random.Random(seed)
    rows, shared = [], [f"s{k}" for k in range(30)]
    for g in range(groups):
        base = [f"g{g}w{k}" for k in range(words)]
        for _ in range(copies):
            t = list(base)
            for _ in range(rng.randrange(0, 4)):
                t[rng.randrange(len(t))] = f"x{rng.randrange(10**6)}"
            if rng.random() < 0.3:
                t = t + shared[: rng.randrange(5, 30)]
            rows.append((len(rows), " ".join(t)))
    for _ in range(40):  # mostly the shared passage
        rows.append((len(rows), " ".join(shared + [f"y{rng.randrange(10**6)}" for _ in range(rng.randrange(0, 12))])))
    return rows


def test_jaccard_matches_brute_force(spark, monkeypatch):
    rows = near_copies(1)
    got = jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute_components(rows)


@pytest.mark.parametrize("seed", [2, 3])
def test_jaccard_in_wide_cells(spark, monkeypatch, seed):
    from corvane.llm import jaccard_join as J

    for name, value in {"SMALL": 2, "WIDE": 10, "FEW_IDS": 0, "BLOCK": 7, "SPLIT": 3}.items():
        monkeypatch.setattr(J, name, value)
    rows = near_copies(seed, groups=2, copies=18)
    got = jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute_components(rows)


@pytest.mark.parametrize("leaf", [2, 8, 500])
def test_regions_lose_no_link(monkeypatch, leaf):
    from corvane.llm import jaccard_join as J

    monkeypatch.setattr(J, "LEAF", leaf)
    rows = near_copies(4, groups=8, copies=25) + near_copies(5, groups=2)
    rows = [(k, t) for k, (_, t) in enumerate(rows)]
    sets = shingles.shingle_sets([t for _, t in rows])
    zero = np.zeros(len(rows))
    cell = J.Members(sets, np.arange(len(rows)), 80, [len(x) for x in sets], zero, zero)
    up = list(range(len(rows)))
    for x, y in cell.join():
        assert J.linked(sets[x], sets[y], 80) and up[x] != up[y]  # each joins two components
        low, high = sorted((up[x], up[y]))
        up = [low if c == high else c for c in up]
    want = brute_components(rows)
    assert up == [want[k][1] for k in range(len(rows))]


def test_jaccard_of_repeated_ids(spark):
    base = [f"w{k}" for k in range(60)]
    a, b = " ".join(base), " ".join(["u", *base[1:]])
    c = " ".join(f"v{k}" for k in range(40))
    rows = [(1, a), (2, b), (2, c), (3, c), (9, c), (9, c), (4, ""), (None, a), (5, None), (6, "q r")]
    got = sorted((r["doc_id"] or 0, r["n_shingles"], r["component_id"]) for r in jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert [r[0] for r in got] == [0, 1, 2, 2, 3, 4, 5, 6, 9, 9]
    assert [r[2] for r in got] == [None, 1, 1, 1, 1, 4, 5, 6, 1, 1]


@given(st.lists(st.text(alphabet="abAB \n\té", max_size=60), max_size=6))
@settings(max_examples=60, deadline=None)
def test_shingle_counts(texts):
    assert [len(s) for s in shingles.shingle_sets(texts)] == [len(shingle_set(t)) for t in texts]


def test_parity_never_exceeds_the_difference():
    rng = np.random.default_rng(0)
    for n in (5, 80, 900):
        a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        b = np.unique(np.concatenate([a[n // 4 :], rng.integers(0, 2**63, n // 5, dtype=np.uint64)]))
        x, y = (parity(s) for s in (a, b))
        assert np.bitwise_count(x ^ y).sum() <= len(np.setxor1d(a, b))


def test_components_by_contraction(spark, monkeypatch):
    monkeypatch.setattr(C, "LOCAL", 3)
    links = [(k, k + 1) for k in range(30) if k % 10] + [(100, 50), (50, 7), (200, 201)]
    got = {r["id"]: r["component"] for r in C.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got[100] == got[50] == got[7] == 1 and got[201] == 200 and got[25] == 21


def test_shards(spark):
    rng = random.Random(3)
    rows = [(k, "x" * rng.randrange(0, 400) + str(rng.randrange(900))) for k in range(3000)] + [(10_000 + k, "hot text") for k in range(1500)]
    out = shard(spark.createDataFrame(rows, "doc_id long, text string"), 8).toPandas()
    assert len(out) == len(rows) and sorted(out.doc_id) == sorted(r[0] for r in rows)
    by = out.groupby("shard")
    assert (by["slot"].max() + 1 == by.size()).all() and not out.duplicated(["shard", "slot"]).any()
    size = by["size"].sum()
    assert len(size) == 8 and size.max() <= 1.05 * size.mean()
    texts = dict(rows)
    assert all(s == len(texts[i].encode()) + 1 and c == zlib.crc32(texts[i].encode()) for i, s, c in zip(out.doc_id, out["size"], out.text_crc32, strict=True))


def test_topk_matches_brute_force(spark):
    rng = np.random.default_rng(5)
    v = [(k, [float(x) for x in rng.normal(0, 1, 40) * rng.choice([0.2, 1, 3])]) for k in range(400)]
    v += [(1000 + k, v[0][1]) for k in range(30)]
    got = exact_topk(spark.createDataFrame(v, "vec_id long, embedding array<float>"), 20, is_query=F.col("id") % 20 == 0).toPandas()
    q = {i: [math.floor(64 * float(np.float32(y))) for y in x] for i, x in v}
    want = []
    for i in [i for i in q if i % 20 == 0]:
        best = sorted(((-sum(a * b for a, b in zip(q[i], q[j], strict=True)), j) for j in q if j != i))[:20]
        want += [(i, k + 1, j, -s) for k, (s, j) in enumerate(best)]
    assert sorted(map(tuple, got[["query_id", "rank", "vec_id", "score"]].to_numpy().tolist())) == sorted(want)


def test_url_rules(spark):
    rules = spark.createDataFrame([("net", "/", "block"), ("example.net", "/en/", "allow"), ("b.example.net", "/en/x", "block")], "host string, path string, verdict string")
    cases = [
        ("http://A.Example.NET/en/1", "example.net/en/", "allow"), ("http://b.example.net/en/x?q", "b.example.net/en/x", "block"), ("http://xexample.net/en/1", "net/", "block"),
        ("http://net", None, "allow"), ("http://net/", "net/", "block"), ("no scheme.net/", None, "allow"), (None, None, "allow"), ("x://y.net#/a", None, "allow"), ("http://nett/", None, "allow"),
    ]
    pages = spark.createDataFrame([(k, u) for k, (u, _, _) in enumerate(cases)], "page_id long, url string")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_filter(pages, rules).collect()}
    assert got == {k: (r, v) for k, (_, r, v) in enumerate(cases)}


def test_url_filter_with_many_rules_and_a_hot_host(spark):
    rng = random.Random(1)
    hosts = ["a.com", "b.a.com", "c.b.a.com", "d.com", "e.org"]
    rules = [(h, p, rng.choice(["allow", "block"])) for h in ["com", *hosts] for p in ("", "/", "/x", "/x/y")]
    urls = [(k, f"http://{'a.com' if k % 3 == 0 else rng.choice(hosts)}{rng.choice(['', '/', '/x', '/x/y/z', '/q'])}") for k in range(3000)]
    got = url_filter(spark.createDataFrame(urls, "page_id long, url string"), spark.createDataFrame(rules, "host string, path string, verdict string"))
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in got.collect()}
    for k, u in urls:
        host, slash, rest = u[7:].partition("/")
        path = slash + rest
        fits = [(len(h) + len(p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=None)
        assert got[k] == ((best[2], best[3]) if best else (None, "allow"))


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_token_ids_are_the_tokenizers(name):
    from tokenizers import Tokenizer

    path = tokenizer_path(name)
    own, real = packing.WordIds(path), Tokenizer.from_file(path)
    assert own.wordly == (name == "word_bpe_49k.json")
    for t in ["It's ΣΑΣ don't¹²½ x<|endoftext|> y", "İ ſ µm ªº ''s !!'s", "a\x1cb \x85c", "naïve café €", "日本語 🎉", "'S O'RE we'VE", "", " \n", "A,b;c…d"]:
        assert np.frombuffer(own.encode(t), dtype="<u4").tolist() == real.encode(t, add_special_tokens=False).ids


@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), max_size=20))
@settings(max_examples=40, deadline=None)
def test_packing_plan(histogram):
    runs, n = packing.plan(histogram, 64)
    used, fill = Counter(), Counter()
    for length, first, count, seq, m, offset in runs.tolist():
        for k in range(count):
            used[length, first + k] += 1
            fill[seq + k // m] += length
    assert used == Counter({(a, k): 1 for a, c in histogram.items() for k in range(c)})
    assert all(f <= 64 for f in fill.values()) and len(fill) == n
    bins: list[int] = []  # first fit, longest first
    for a in sorted((a for a, c in histogram.items() for _ in range(c)), reverse=True):
        at = next((k for k, f in enumerate(bins) if f + a <= 64), None)
        if at is None:
            bins.append(a)
        else:
            bins[at] += a
    assert n <= 1.06 * len(bins) + 1


def test_packing_round_trip(spark):
    rng = random.Random(2)
    rows = [(k, " ".join(rng.choice(["alpha", "beta", "The", "x9"]) for _ in range(rng.choice([1, 5, 300, 3000])))) for k in range(60)] + [(99, None)]
    out = packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), tokenizer_path(), with_ids=True).toPandas()
    known = packing.WordIds(tokenizer_path())
    for i, t in rows:
        own = out[out.doc_id == i].sort_values("piece")
        assert b"".join(own.ids) == (known.encode(t) if t else b"") + b"\0\0\0\0"
    assert all(zlib.crc32(b) == c for b, c in zip(out.ids, out.ids_crc32, strict=True))
    for _, g in out.sort_values("offset").groupby("sequence_id"):
        assert g.offset.tolist() == [0, *np.cumsum(g.length)[:-1]] and g.length.sum() <= 2048
    assert out.sequence_id.nunique() <= math.ceil(out.length.sum() / 2048) + 2


def test_stray_end_tags_take_linear_time():
    import time

    def took(n):
        began = time.process_time()
        html_text.main_text("<div>" * n + "</x>" * n + "<p>text</p>" + "</main>" * n)
        return time.process_time() - began

    took(1000)
    assert took(40_000) < 12 * took(10_000) + 0.5


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body class="has-sidebar"><header>Site</header>
<nav><ul><li><a href="/a">A</a></li></ul></nav><div id="cookie-banner">We use cookies and more words than one would think</div><div class="ad">Buy now</div>
<main><article><h1>Head &amp; more</h1><p><b>One
 two<br>three.<p>Of.</p><form><p>Your name</p></form><div class="comments"><p>A comment by a reader, quite long, with many words in it for sure.</p></div></article></main>
<aside>Related</aside><footer>&copy; x</footer>"""


def test_main_text():
    assert html_text.main_text(PAGE) == "Head & more\n\nOne two three.\n\nOf."
    assert html_text.main_text(None) == html_text.main_text("") == ""
    for broken in ("<p", '<a b="c', "<!-- x", "<script>a", "</p></p>", "<" * 50):
        html_text.main_text(broken)


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ('<div class="wrapper has-sidebar"><main><article><p>One two three four five.</article></main></div>', "One two three four five."),
        ('<div class="content no-sidebar"><p>One two three four five.</div>', "One two three four five."),
        ('<div class="sidebar-layout"><main><p>One two three four five.</main></div>', "One two three four five."),
        ('<article><div class="entry-header"><h1>Head</h1></div><p>One two three four five.</article>', "Head\n\nOne two three four five."),
        ('<main><svg class="i"/><p>One two three four five.</main>', "One two three four five."),
        ("<main><svg><p>One two three four five.</main>", "One two three four five."),
        ("<main><noscript><p>One two three four five.</main>", "One two three four five."),
        ('<main><p>One two three.<div class="comments"><article class="comment-body"><p>Nice.</article></div></main>', "One two three."),
        ("<main><p>One two three.</main><aside><article><p>Other news.</article></aside>", "One two three."),
    ],
)
def test_main_text_in_named_wrappers(page, text):
    assert html_text.main_text(page) == text


def test_pages_of_the_data(spark, sf_dir):
    import re
    from html import unescape

    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    got = {r["page_id"]: r for r in QUERIES["op7_html_extraction"](spark, sf_dir).collect()}
    for r in pages.collect():
        body = r["html"][r["html"].index("<article>") + 9 : r["html"].index("</article>")]
        parts = [" ".join(unescape(re.sub(r"<br>", " ", re.sub(r"</?b>", "", x))).split()) for x in re.split(r"</?(?:p|h1)>", body)]
        assert got[r["page_id"]]["text"] == "\n\n".join(x for x in parts if x)
        assert got[r["page_id"]]["n_chars"] == len(got[r["page_id"]]["text"])


def test_language_on_held_out_texts(spark, sf_dir):
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = QUERIES["op8_language_id"](spark, sf_dir).collect()
    held = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) >= 0.97 * len(held)


def test_folded_matrix_equals_the_kernel():
    texts = ["the cat and the dog", "le chat et le chien", "die katze und der hund", "the bird", "le chien"]
    x = language_id.presence(texts)
    names, m = language_id.fit(x, ["en", "fr", "de", "en", "fr"])
    got, scores = language_id.predict([*texts, "123 !!", None], names, m)
    assert got == ["en", "fr", "de", "en", "fr", "und", "und"] and all(0 <= s <= 1 for s in scores)


def test_nearest_examples_are_exact():
    rng = np.random.default_rng(7)
    vectors = (rng.random((500, 60)) * (rng.random((500, 60)) < 0.1)).astype(np.float32)
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
    model = toxicity.Model(idf=np.ones(60), lists=toxicity.Lists(vectors))
    for v in vectors[::25]:
        rows, cosines = toxicity.nearest(model, v, 15)
        want = np.sort((vectors @ v)[vectors @ v > 1e-6])[::-1][:15]
        assert np.allclose(cosines, want, atol=1e-5) and np.allclose((vectors @ v)[rows], cosines, atol=1e-5)
        bounds = model.lists.bounds(v)
        assert all((vectors @ v)[k : k + toxicity.BLOCK].max() <= bounds[k // toxicity.BLOCK] + 1e-5 for k in range(0, 500, toxicity.BLOCK))


def test_toxicity_is_the_brute_force_vote(spark):
    """The whole operator against cosines of all examples, where every labelled row is an example."""
    rng = random.Random(8)
    bad, good = [f"bad{k}" for k in range(12)], [f"w{k}" for k in range(40)]
    rows = [(k, " ".join(rng.choices(good, k=40) + rng.choices(bad, k=rng.randrange(1, 6) if k % 3 == 0 else rng.random() < 0.05))) for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(200)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels, F.lit(True))
    v = np.zeros((model.lists.count, len(model.idf)))
    for block, (terms, at, weights) in enumerate(model.lists.postings):
        v[block * toxicity.BLOCK + at, terms] = weights
    known = toxicity.Known(model.terms)
    for r in toxicity.score_toxicity(docs, labels, F.lit(True)).collect():
        q = toxicity.vector_of(model, toxicity.words_of(r["text"]), known)
        if q is None:
            assert r["tox_score"] == pytest.approx(model.without) and not r["tox_evidence"]
            continue
        cosines = v @ q
        order = np.lexsort((np.arange(len(v)), -np.round(cosines, 6)))[: toxicity.K]
        order = order[cosines[order] > 1e-6]
        pull = cosines[order] ** 4 * model.weight[order]
        doubt = 0.1 * model.weight[~model.toxic].mean()
        want = (pull[model.toxic[order]].sum() + doubt * model.prior) / (pull.sum() + doubt)
        assert r["tox_score"] == pytest.approx(want, abs=1e-4) and len(r["tox_evidence"]) == len(order)


def test_toxicity_learns(spark):
    rng = random.Random(0)
    filler = [f"w{k}" for k in range(50)]
    rows = [(k, " ".join(rng.choices(filler, k=30) + (["nasty", "awful"] if k % 4 == 0 else []))) for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(400) if k % 3], "doc_id long, toxic int")
    got = toxicity.score_toxicity(docs, labels, F.col("doc_id") % 3 == 1).collect()
    assert all(r["tox_pred"] == int(r["doc_id"] % 4 == 0) for r in got)
    assert all(r["tox_evidence"] for r in got if r["tox_pred"])


def test_language_model_gradient():
    rng = np.random.default_rng(1)
    net = masked_lm.Network.fresh(np.zeros(masked_lm.CLASSES))
    side = [masked_lm.EDGE] * masked_lm.SIDE
    classes = np.array([*side, *rng.integers(0, masked_lm.EDGE, 64), *side], dtype=np.uint8)
    loss = lambda n: -n.log_probabilities(classes).mean()
    before, flat = loss(net), net.flat().astype(np.float64)
    moved = masked_lm.Network.of(flat.copy())
    moved.step(classes, np.arange(masked_lm.SIDE, 64 + masked_lm.SIDE), 1e-2)
    step = moved.flat().astype(np.float64) - flat
    assert before - loss(moved) == pytest.approx((step**2).sum() / 1e-2, rel=0.05)  # the step is the gradient's


def test_language_model_scores_as_a_plain_one(spark):
    rows = [(k, f"the cat number {k} sat, on the mat! {'x' * (k % 7)}Ing don't d\u00f6g") for k in range(200)] + [(500, ""), (501, None), (502, "one"), (503, " \n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model, rest = masked_lm.train(docs)
    assert rest.isEmpty()
    split = lambda t: re.findall(r"[\w]+|[^\w\s]", (t or "").lower())
    net, counts = model.network, Counter(w for _, t in rows for w in split(t))
    seen = {w: masked_lm.tokens([w.encode()]) for w in counts}
    own = {w: int(model.vocabulary.frequent[model.vocabulary.places(t.hashes)[0]]) for w, t in seen.items()}
    known = {w: own[w] if own[w] != masked_lm.EDGE else int(seen[w].tail[0]) for w in counts}
    assert len({k for k in own.values()} - {masked_lm.EDGE}) == masked_lm.FREQUENT and len(counts) > 150
    inside = Counter()
    for w, n in counts.items():
        inside[known[w]] += (n + 1) * (own[w] == masked_lm.EDGE)
    for r in masked_lm.score_documents(docs, model=(model, rest)).collect():
        words = split(dict(rows)[r["doc_id"]])
        total = 0.0
        for k, w in enumerate(words):
            h = sum(net.inputs[p][known[words[k + d]] if 0 <= k + d < len(words) else masked_lm.EDGE] for p, d in enumerate((-2, -1, 1, 2)))
            z = np.tanh(h) @ net.out + net.bias
            total += z[known[w]] - np.log(np.exp(z).sum())
            if own[w] == masked_lm.EDGE:
                total += math.log((counts[w] + 1) / (inside[known[w]] + 1))
        assert r["n_tokens"] == len(words) and r["log_likelihood"] == pytest.approx(total, rel=1e-4, abs=1e-4)


def test_language_model_prefers_order(spark):
    rng = random.Random(4)
    rows = [(k, " ".join(["the", "cat", "sat", "on", "a", "mat"] * 20)) for k in range(300)]
    shuffled = "the cat sat on a mat".split() * 20
    rng.shuffle(shuffled)
    docs = spark.createDataFrame([*rows, (900, " ".join(shuffled)), (901, None), (902, " ")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in masked_lm.score_documents(docs).collect()}
    assert got[0]["mean_log_likelihood"] > got[900]["mean_log_likelihood"] + 0.1
    assert got[901]["n_tokens"] == got[902]["n_tokens"] == 0 and got[901]["log_likelihood"] == 0.0


def test_language_model_trains_on_every_text(spark):
    for text in ("one two three", "four five", "six", "seven seven eight nine"):  # the old draw by id took no null id
        docs = spark.createDataFrame([(None, text)] * 3, "doc_id long, text string")
        model, _ = masked_lm.train(docs)
        assert not np.array_equal(model.network.flat(), masked_lm.Network.fresh(model.network.bias).flat())
        assert not np.array_equal(model.network.inputs, masked_lm.Network.fresh(model.network.bias).inputs)


def test_language_model_counts_words_inside_a_class(spark, monkeypatch):
    frequent = " ".join(f"w{k:03d}" for k in range(masked_lm.FREQUENT))
    rows = [(k, frequent) for k in range(30)] + [(100 + k, "w000 cating w001") for k in range(20)] + [(200, "w000 doting w001"), (200, "w000 doting w001")]
    assert len(set(masked_lm.tokens([b"cating doting"]).tail)) == 1
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    each = []
    for held in (masked_lm.HELD, 0, 1):  # with the model, by shuffle, and both
        monkeypatch.setattr(masked_lm, "HELD", held)
        got = masked_lm.score_documents(docs).collect()
        assert len(got) == len(rows)
        each.append({r["doc_id"]: r["log_likelihood"] for r in got})
        assert each[-1][100] - each[-1][200] == pytest.approx(math.log(21 / 3))
    assert each[0] == pytest.approx(each[1]) and each[0] == pytest.approx(each[2])


ITEM = "So, a train leaves Boston at 9:30 and travels 120 km to Paris in 2 hours, then Boston sleeps well again."


def test_leaks(spark):
    docs = [
        (1, ITEM), (2, "x y z. " + ITEM.replace("Boston", "New York").replace("9:30", "7:15").replace("120 km", "90 miles").replace("Paris", "Rome") + " Bye"),
        (3, ITEM.replace("Boston", "Rome", 1).replace("Boston", "Oslo").replace("2 hours", "Rome hours").replace("120", "9:30")), (4, "Something else. " * 30), (5, None), (6, ""), (None, ITEM), (1, ITEM),
    ]
    bench = spark.createDataFrame([(7, ITEM), (8, None), (9, "1 2 3"), (10, "")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r for r in D.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()}
    assert {(1, 7), (2, 7), (None, 7)} <= set(got) and not {k[0] for k in got} & {4, 5, 6}
    assert got[2, 7]["reparameterised"] and not got[1, 7]["reparameterised"]


def test_leaks_whose_windows_recur(spark):
    item = "He sold 5 apples on monday and then sold 7 apples on monday and then closed."
    other = "He sold 9 apples on monday and then sold 4 apples on monday and then closed."
    rows = [(1, item), (2, other), (3, "He sold 8 apples on monday and then sold 8 apples on monday or later. " + other), (4, other.replace("4", "9"))]
    got = D.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(7, item)], "item_id long, text string"))
    found = {r["doc_id"]: r for r in got.collect()}
    assert set(found) == {1, 2, 3}
    assert [found[k]["reparameterised"] for k in (1, 2, 3)] == [False, True, True]
    assert all(r["consistency"] == 1.0 for r in found.values())


def test_leaks_with_names_anywhere(spark):
    item = "Ann has 12 apples in one basket. Bob has 3 pears in his bag. How many more fruits does Ann hold than Bob?"
    changed = item.replace("Ann", "Mary").replace("Bob", "Tom").replace("12", "20")
    rows = [(1, changed), (2, item.lower()), (3, item.upper()), (4, "We went home early and nobody had anything in the basket.")]
    bench = spark.createDataFrame([(7, item), (8, "FIND THE SUM OF ALL EVEN NUMBERS BELOW THE GIVEN BOUND")], "item_id long, text string")
    rows += [(5, "Find the sum of all even numbers below the given bound"), (6, "(" + changed.replace("Tom", "TOM") + ")")]
    got = D.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()
    found = {(r["doc_id"], r["item_id"]): r["reparameterised"] for r in got}
    assert found == {(1, 7): True, (2, 7): False, (3, 7): False, (5, 8): False, (6, 7): True}


def test_leaks_beyond_the_plan_are_joined(spark, sf_dir, monkeypatch):
    docs, bench = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    one = sorted(map(tuple, D.contaminated(docs, bench).collect()))
    monkeypatch.setattr(D, "IN_PLAN", 5)
    assert sorted(map(tuple, D.contaminated(docs, bench).collect())) == one


def test_leaks_match_plain_containment(spark, sf_dir):
    words = lambda t: re.findall(r"\w+", t.lower())
    grams = lambda w: {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
    items = {r["item_id"]: grams(words(r["text"])) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()}
    want = set()
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        g = grams(words(r["text"]))
        want |= {(r["doc_id"], i) for i, s in items.items() if s and len(s & g) >= 0.8 * len(s)}
    got = {(r["doc_id"], r["item_id"]) for r in QUERIES["op5_decontamination"](spark, sf_dir).collect()}
    assert got == want
