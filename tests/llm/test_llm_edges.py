"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing names for every operator."""

import pytest
from pyspark.sql import functions as F

from corvane.llm.decontamination import contaminated
from corvane.llm.exact_topk import exact_topk
from corvane.llm.html_text import extract
from corvane.llm.jaccard_join import jaccard_components
from corvane.llm.language_id import identify
from corvane.llm.masked_lm import score_documents
from corvane.llm.packing import pack
from corvane.llm.queries import ORACLES, QUERIES, tokenizer_path
from corvane.llm.sharding import shard
from corvane.llm.toxicity import score_toxicity
from corvane.llm.url_filter import url_filter

NAMES = "id, text_, size, shard, slot, key, n, a, b, s, kind, word, words, score, tokens, windows, doc, item, lang_pred, tox_score, part, rule".split(", ")


@pytest.fixture(scope="module")
def docs(spark):
    """Nulls, blanks, a very long text, repeated rows and columns with clashing names."""
    rows = [
        (1, "the cat sat on the mat and slept", "en"), (2, "the cat sat on the mat and slept", None), (2, "the cat sat on the mat and slept", None), (3, None, "en"), (4, "", "fr"), (5, " \n\t ", None),
        (6, "le chat dort sur le lit et le chien aussi", "fr"), (7, "mot " * 60_000, "fr"), (8, "!!! 123", "en"), (None, "no id here but words", "en"), (9, "x", None), (10, "\u2028\U0001f389 e\u0301", "en"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    return df.select("*", *[F.lit("clash").alias(n) for n in NAMES])


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1), (6, 0), (6, 0), (4, None), (None, 1), (77, 1)], "doc_id long, toxic int")


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, "the cat sat on the mat and slept"), (2, None), (None, ""), (3, "x")], "item_id long, text string")


CASES = {
    "shard": lambda d, lab, b: shard(d, 4), "pack": lambda d, lab, b: pack(d, tokenizer_path()), "identify": lambda d, lab, b: identify(d, F.lit(True)),
    "toxicity": lambda d, lab, b: score_toxicity(d, lab, F.lit(True)), "jaccard": lambda d, lab, b: jaccard_components(d), "leaks": lambda d, lab, b: contaminated(d, b), "lm": lambda d, lab, b: score_documents(d),
}


@pytest.mark.parametrize("name", CASES)
def test_odd_rows(docs, labels, bench, name):
    rows = CASES[name](docs, labels, bench).collect()
    if name == "leaks":
        assert sorted((r["doc_id"], r["item_id"]) for r in rows if r["item_id"] == 1) == [(1, 1), (2, 1)]
    elif name == "pack":
        assert len({(r["doc_id"], r["piece"]) for r in rows if r["doc_id"] == 7}) > 20
    else:
        assert len(rows) == docs.count()
    if name == "jaccard":
        got = {r["doc_id"]: r["component_id"] for r in rows}
        assert got[2] == 1 and got[3] == 3 and got[4] == 4 and got[5] == 5 and got[None] is None
    if name == "identify":
        got = {r["doc_id"]: r["lang_pred"] for r in rows}
        assert all(got[k] == "und" for k in (3, 4, 5, 8)) and got[7] == "fr"


@pytest.mark.parametrize("name", CASES)
def test_empty_tables(docs, labels, bench, name):
    none = lambda d: d.filter("1 = 0")
    assert CASES[name](none(docs), labels, bench).count() == 0
    CASES[name](docs, none(labels), none(bench)).count()


def test_odd_pages(spark):
    rows = [(1, None, None), (1, "http://a.net/x", "<p>one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen</p>"), (None, "", ""), (3, "://", "<p>" * 9000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").select("*", *[F.lit(1).alias(n) for n in ("id", "host", "path", "key", "part", "kind", "rule", "verdict", "text", "n_chars")])
    assert extract(pages).count() == 4
    rules = spark.createDataFrame([("net", "/", "block"), (None, "/", "block"), ("", None, "block")], "host string, path string, verdict string")
    assert sorted(r["verdict"] for r in url_filter(pages, rules).collect()) == ["allow", "allow", "allow", "block"]
    assert url_filter(pages.filter("1 = 0"), rules).count() == 0 and url_filter(pages, rules.filter("1 = 0")).count() == 4
    assert extract(pages.filter("1 = 0")).count() == 0


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (20, None), (1, [nan, 1.0]), (2, [inf, 1.0]), (3, [None, 1.0]), (4, []), (5, [1.0, 2.0]), (6, [1.0, 2.0, 3.0]), (None, [1.0, 1.0])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>").select("*", F.lit(1).alias("id"), F.lit(1).alias("vector"), F.lit(1).alias("norm2"))
    got = [tuple(r) for r in exact_topk(v, 20, is_query=F.col("id") % 20 == 0).collect()]
    assert sorted(got) == [(0, 1, 5, 64 * 64 * 5), (0, 2, 6, 64 * 64 * 5), (0, 3, 4, 0)]
    assert exact_topk(v.filter("1 = 0")).count() == 0


def test_queries_with_sql_match_it(spark, sf_dir):
    import duckdb

    for name, sql in ORACLES.items():
        c = duckdb.connect()
        for t in ("documents", "embeddings", "pages"):
            c.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
        got, want = QUERIES[name](spark, sf_dir).toPandas(), c.sql(sql).df()
        columns = sorted(want.columns)
        assert sorted(got.columns) == columns
        plain = lambda d: sorted(map(repr, d[columns].astype(object).where(d[columns].notna(), None).itertuples(index=False, name=None)))  # noqa: B023, E731
        assert plain(got) == plain(want), name


def test_pipeline_against_its_operators(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = {r["doc_id"] for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns
        rows = {r["doc_id"]: r["text"] for r in out.collect()}
        gone = kept - set(rows)
        if name == "jaccard_join":
            comp = {r["doc_id"]: r["component_id"] for r in jaccard_components(docs).collect()}
            assert gone == {d for d, c in comp.items() if c != d}
        if name == "decontamination":
            assert gone == {r["doc_id"] for r in contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).collect()}
        kept = set(rows)
        docs = docs.join(out.select("doc_id"), ["doc_id"], "left_semi")
    pieces = corpus_pipeline.run(spark, sf_dir).collect()
    assert {r["doc_id"] for r in pieces} == kept


def test_jaccard_ranks_by_counts_in_all_texts(spark, monkeypatch):
    from corvane.llm import jaccard_join as J

    told, init = [], J.Ranks.__init__

    def noted(self, h, counts):
        told.append(dict(zip(h.tolist(), counts.tolist(), strict=True)))
        init(self, h, counts)

    monkeypatch.setattr(J.Ranks, "__init__", noted)
    docs = spark.range(20_400).selectExpr("id as doc_id", "concat('t', id % 40, ' of the same few words') as text")
    docs = docs.unionByName(spark.createDataFrame([(None, "t0 of the same few words")], "doc_id long, text string"))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in J.jaccard_components(docs).collect()}
    assert got == {k: (2, k % 40) for k in range(20_400)} | {None: (2, None)}
    sets = [J.shingle_sets([f"t{k} of the same few words"])[0] for k in range(40)]
    want = {}
    for s in sets:
        for h in s.tolist():
            want[h] = want.get(h, 0) + 510
    assert told == [want] and sorted(want.values())[-2:] == [510, 20_400]


@pytest.mark.parametrize("at_once", [1, 50, 1 << 20])
def test_counts_of_all_shingles(monkeypatch, at_once):
    import random

    import pandas as pd

    from corvane.llm import jaccard_join as J

    monkeypatch.setattr(J, "AT_ONCE", at_once)
    rng = random.Random(6)
    texts = [" ".join(rng.choice("ab") for _ in range(rng.randrange(0, 40))) for _ in range(700)] + [None, "", " \n"]
    tasks = [pd.DataFrame({"text": texts[:300]}), pd.DataFrame({"text": texts[300:]})]
    told = pd.concat([b for t in tasks for b in J._counted_in_task(iter([t]))]).sort_values("bucket", kind="stable")
    got = pd.concat(J._counted_in_all(iter([told.iloc[:7], told.iloc[7:]])))
    want = {}
    for s in J.shingle_sets(texts):
        for h in s.view("int64").tolist():
            want[h] = want.get(h, 0) + 1
    assert got["h"].is_unique and dict(zip(got["h"], got["count"], strict=True)) == {h: n for h, n in want.items() if n >= J.LEAST}
    assert list(J._counted_in_task(iter([pd.DataFrame({"text": [None, ""]})]))) == [] and list(J._counted_in_all(iter([]))) == []
