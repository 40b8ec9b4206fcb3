"""Goldens, properties and whole pipelines of the library's own operators."""

import json

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.functions import vectors as V
from corvane.operators import evaluate, graph, ingest, usage
from corvane.plans import engine
from corvane.sources import stores


def one(spark, column, schema="x string", row=("",)):
    return spark.createDataFrame([row], schema).select(column.alias("v")).first()["v"]


def test_answer_goldens(spark):
    norm = lambda s: one(spark, T.normalize_answer(F.lit(s)))
    assert norm("The  A.B.C.!") == "abc"
    f1 = lambda a, b: one(spark, T.token_f1(F.lit(a), F.lit(b)))
    assert f1("barack obama", "obama") == pytest.approx(2 / 3)
    assert f1("", "") == 0.0
    assert one(spark, T.exact_match(F.lit(""), F.array(F.lit("")))) == 1.0
    recall = lambda k: one(spark, T.recall_at(F.array(*map(F.lit, "AXBY")), F.array(F.lit("A"), F.lit("B")), k))
    assert [recall(k) for k in (1, 2, 3)] == [0.5, 0.5, 1.0]
    assert one(spark, T.recall_at(F.array(F.lit("A")), F.array().cast("array<string>"), 1)) == 0.0


def test_answers_out_of_model_output(spark):
    assert one(spark, T.extract_answer(F.lit('x Answer: no\nAnswer:\n\n "Rome".\nmore'))) == "Rome"
    assert one(spark, T.extract_answer(F.lit("Answer: "))) == "unknown"
    assert one(spark, T.extract_first_answer(F.lit("a Answer: b Answer: c"))) == "b Answer: c"
    assert one(spark, T.strip_reasoning(F.lit("a<|channel|>final<|message|>yes<|return|>z"))) == "yes"


def test_salvage(spark):
    assert one(spark, T.parse_entities(F.lit('{"entities": ["A", "B", "A"'))) == ["A", "B"]
    got = one(spark, T.parse_propositions(F.lit('{"propositions": [{"text": "t", "entities": ["e"]}, {"text": "half')))
    assert [(p.text, p.entities) for p in got] == [("t", ["e"])]
    for s in (None, "0", "x"):
        assert one(spark, T.strength(F.lit(s).cast("string"))) == 5.0


def test_pooling_weights(spark):
    assert one(spark, V.linspace_weights(F.lit(2))) == pytest.approx([1 / 3, 2 / 3])
    assert one(spark, V.linspace_weights(F.lit(3))) == pytest.approx([2 / 9, 1 / 3, 4 / 9])


def test_minmax_of_a_constant_is_zero(spark):
    df = spark.createDataFrame([(1, 2.0), (2, 2.0)], "id long, s double")
    assert {r["score"] for r in V.minmax(df, "s").collect()} == {0.0}


def test_allocation(spark):
    def alloc(counts, n):
        df = spark.createDataFrame([(str(k), c) for k, c in enumerate(counts)], "type string, count long")
        return [r["alloc"] for r in evaluate.allocate(df, n).orderBy("type").collect()]

    assert alloc([413, 244, 235, 108], 50) == [21, 12, 12, 5]
    assert alloc([21, 12, 12, 5], 10) == [4, 3, 2, 1]
    assert alloc([21, 12, 12, 5], 12) == [5, 3, 3, 1]
    assert alloc([3, 4], 100) == [3, 4]
    assert alloc([3, 4], 0) == [0, 0]


def test_cooccurrence_counts_occurrences(spark):
    m = spark.createDataFrame([(1, "A"), (1, "B"), (1, "A")], "prop long, entity string")
    assert [tuple(r) for r in graph.cooccurrence_edges(m).collect()] == [("A", "B", 2.0)]


def test_clamp(spark):
    assert one(spark, graph.clamp(F.lit(0.8))) == 0.8
    assert one(spark, graph.clamp(F.lit(1.0))) == 0.999999


def test_pagerank_sums_to_one_and_needs_mass(spark):
    v = spark.range(6).select("id")
    e = spark.createDataFrame([(0, 1, 1.0), (1, 2, 2.0), (3, 4, 1.0)], "src long, dst long, weight double")
    reset = spark.createDataFrame([(0, 1.0), (5, 2.0), (2, float("nan"))], "id long, p double")
    ranks = {r["id"]: r["rank"] for r in graph.pagerank(v, e, reset, 0.75, 10).collect()}
    assert sum(ranks.values()) == pytest.approx(1)
    assert ranks[3] == 0 and ranks[5] > ranks[0] > 0
    assert graph.pagerank(v, e, reset.filter("id = 2"), 0.75, 3) is None


def test_running_lines(spark):
    pages = spark.createDataFrame([(1, p, f"Head\nbody {p}\n{p}") for p in range(4)] + [(2, p, "Head\nx") for p in range(3)], "doc long, page long, text string")
    assert [tuple(r) for r in ingest.running_lines(pages).collect()] == [(1, "Head", 4)]


@given(st.lists(st.integers(0, 40), max_size=30))
def test_chunk_fold(counts):
    groups = ingest.fold(counts, 20, 6)
    assert sorted(set(sum(groups, []))) == list(range(len(counts)))
    for g in groups:
        assert len(g) == 1 or sum(counts[k] for k in g) <= 26  # the carry is not checked again
        assert g == list(range(g[0], g[-1] + 1))


def test_admission_matches_the_recursion(spark):
    at = [0.0, 1.0, 2.0, 3.0, 70.0, 71.0, 71.5, 300.0]
    want = []
    for k, t in enumerate(at):
        want.append(max(t, want[k - 2] + 60) if k >= 2 else t)
    df = spark.createDataFrame([(7, k, t) for k, t in enumerate(at)], "user_id long, event_id long, at double")
    assert [r["admitted"] for r in usage.admissions(df, 2).orderBy("event_id").collect()] == want


def test_streamed_admission(spark, tmp_path):
    from corvane.streaming.usage import streamed_admissions

    rows = [(u, k, float(k)) for u in (1, 2) for k in range(5)]
    spark.createDataFrame(rows, "user_id long, event_id long, at double").write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema("user_id long, event_id long, at double").parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    out = streamed_admissions(s, 2)
    q = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r["user_id"], r["event_id"]): r["admitted"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert [got[1, k] for k in range(5)] == [0.0, 1.0, 60.0, 61.0, 120.0]


def test_idempotent_append(spark, tmp_path):
    path = str(tmp_path / "store")
    rows = spark.createDataFrame([(0, "a"), (1, "b"), (2, "a")], "ord long, text string")
    assert stores.append_texts(rows, path, "chunk-") == 2
    assert stores.append_texts(rows, path, "chunk-") == 0
    assert spark.read.parquet(path).count() == 2


def test_questions_and_corpus(spark, tmp_path):
    path = tmp_path / "q.json"
    path.write_text(json.dumps([{"_id": "1", "type": "t", "question": "q", "answer": "a", "supporting_facts": [["A", 0], ["B", 1], ["A", 2]], "context": [["A", ["s"]], ["C", ["s"]]]}]))
    q = stores.read_questions(spark, str(path))
    r = q.first()
    assert r["gold_titles"] == ["A", "B"] and r["context_titles"] == ["A", "C"]
    texts = spark.createDataFrame([(0, "A", "x"), (1, "A", "y"), (2, "D", "z"), (3, "B", "b")], "ord long, title string, text string")
    found = stores.corpus(texts, q)
    assert sorted(tuple(x) for x in found.collect()) == [("A", "x"), ("B", "b")]
    with pytest.raises(ValueError, match="C"):
        stores.assert_covered(found, q)


def test_files(spark, tmp_path):
    (tmp_path / "a.graphml").write_text('<graphml><graph><node id="x"/><node id="y"/><edge source="x" target="y"><data key="weight">2.5</data></edge></graph></graphml>')
    v, e = stores.read_graphml(spark, str(tmp_path / "a.graphml"))
    assert sorted(r[0] for r in v.collect()) == ["x", "y"] and [tuple(r) for r in e.collect()] == [("x", "y", 2.5)]
    (tmp_path / "doc.txt").write_text("one\ftwo")
    d = stores.read_documents(spark, str(tmp_path / "doc.txt")).first()
    assert (d["title"], d["num_pages"]) == ("doc", 2)
    (tmp_path / "bad.jsonl").write_text('{"qid": "1"}\nnot json\n{"qid": "2", "error": "e"}\n')
    assert stores.read_jsonl(spark, str(tmp_path / "bad.jsonl"), "qid string, error string", strict=False).count() == 1
    assert stores.settings("A=1\nexport A=2\n#C=3\nB='x'", {"B": "y"}) == {"A": "1", "B": "y"}


DOCS = [
    "Marie Curie was born in Warsaw. Warsaw is a city in Poland.",
    "Pierre Curie was a physicist. Pierre Curie married Marie Curie.",
    "Poland lies in Europe. Europe holds many countries.",
    "Bread is baked from flour. Flour comes from Wheat.",
]


def test_engine(spark, tmp_path):
    index = engine.build(spark.createDataFrame(list(enumerate(DOCS)), "ord long, text string"))
    index.write(str(tmp_path / "index"))
    index = engine.Index.read(spark, str(tmp_path / "index"))
    q = spark.createDataFrame([("Where was Marie Curie born?",)], "text string").select("text", V.hash_embedding(F.col("text")).alias("vector"))
    found = engine.compare(index, q, k=3, rounds=5)
    assert found.filter("error is not null").count() == 0
    assert {r["system"] for r in found.collect()} >= {"dense", "paths", "local"}
    top = engine.ask(index, q, system="paths", k=2, rounds=5).collect()
    assert any("Marie Curie" in r["text"] for r in top)
    assert "Question: where" in engine.prompt(engine.ask(index, q, system="dense", k=2), "where").first()["prompt"]


def test_failures_stay_alone(spark):
    from corvane.operators.extract import extract_propositions

    def broken(text):
        if text == "bad":
            raise ValueError("no")
        return [(text, [])]

    got = extract_propositions(spark.createDataFrame([(1, "ok"), (2, "bad")], "chunk long, text string"), broken)
    assert {r["chunk"]: r["error"] for r in got.collect()} == {1: None, 2: "ValueError: no"}
