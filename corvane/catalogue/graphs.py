"""Knowledge graph, PageRank, communities, beam search."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.catalogue.registry import query, r6
from corvane.catalogue.retrieval import _KNN, _S0, NEAR, first, knn, vectors
from corvane.functions.text import content_id
from corvane.operators import graph, retrieve
from corvane.operators.beam import BeamSpec, beam_search, connections, entity_scores, path_texts
from corvane.operators.topk import scored
from corvane.session import cut, table

#: Passage ids are order keys moved beyond all entity ids.
SHIFT = 1_000_000_000

_COOC = """m AS (SELECT l_orderkey AS g, l_partkey AS e, count(*) AS n FROM lineitem GROUP BY 1, 2),
 cooc AS (SELECT a.e AS src, b.e AS dst, CAST(sum(a.n * b.n) AS DOUBLE) AS weight FROM m a JOIN m b ON a.g = b.g AND a.e < b.e GROUP BY 1, 2)"""


def mentions(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("prop"), F.col("l_partkey").alias("entity"))


def cooc(spark, sf_dir):
    return graph.cooccurrence_edges(mentions(spark, sf_dir))


def links(spark, sf_dir):
    return graph.passage_edges(mentions(spark, sf_dir), passage="prop")


@query("cooccurrence_edges", f"WITH {_COOC} SELECT * FROM cooc")
def cooccurrence_edges(spark, sf_dir):
    return cooc(spark, sf_dir)


@query("entity_passage_edges", "SELECT DISTINCT l_partkey AS entity, l_orderkey AS passage, 1e0 AS weight FROM lineitem")
def entity_passage_edges(spark, sf_dir):
    return links(spark, sf_dir)


@query(
    "graph_assemble",
    f"""WITH {_COOC}, {_KNN}, a AS (SELECT src, dst, weight, 'cooc' AS kind FROM cooc
      UNION ALL SELECT DISTINCT l_partkey, l_orderkey + {SHIFT}, 1e0, 'passage' FROM lineitem
      UNION ALL SELECT src, dst, weight, 'syn' FROM knn WHERE NOT EXISTS (SELECT 1 FROM cooc c WHERE c.src = knn.src AND c.dst = knn.dst))
    SELECT src, dst, round(weight, 6) AS weight, kind FROM a WHERE src <> dst""",
)
def graph_assemble(spark, sf_dir):
    p = links(spark, sf_dir).select(F.col("entity").alias("src"), (F.col("passage") + SHIFT).alias("dst"), "weight")
    return graph.assemble(cooc(spark, sf_dir), p, knn(spark, sf_dir)).select("src", "dst", r6("weight", "weight"), "kind")


@query(
    "one_hop_expand",
    """WITH e AS (SELECT 'r' || n_regionkey AS a, 'n' || n_nationkey AS b FROM nation UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer),
      s AS (SELECT 'n' || n_nationkey AS id FROM nation WHERE n_regionkey = 0),
      x AS (SELECT id, 0 AS hop FROM s UNION ALL SELECT b, 1 FROM e JOIN s ON e.a = s.id UNION ALL SELECT a, 1 FROM e JOIN s ON e.b = s.id)
    SELECT id, CAST(min(hop) AS INTEGER) AS hop FROM x GROUP BY id""",
)
def one_hop_expand(spark, sf_dir):
    n, c = table(spark, sf_dir, "nation"), table(spark, sf_dir, "customer")
    name = lambda k, x: F.concat(F.lit(k), F.col(x).cast("string"))
    edges = n.select(name("r", "n_regionkey").alias("src"), name("n", "n_nationkey").alias("dst")).union(c.select(name("n", "c_nationkey"), name("c", "c_custkey")))
    return graph.expand(n.filter("n_regionkey = 0").select(name("n", "n_nationkey").alias("id")), edges)


_OVER = f"""{_COOC}, s AS (SELECT p_partkey AS id FROM part WHERE p_size = 1),
 x AS (SELECT id, 0 AS hop FROM s UNION ALL SELECT dst, 1 FROM cooc JOIN s ON src = id UNION ALL SELECT src, 1 FROM cooc JOIN s ON dst = id),
 h AS (SELECT id, min(hop) AS hop FROM x GROUP BY id),
 o AS (SELECT l.l_orderkey AS passage, sum(CASE WHEN hop = 0 THEN 1e0 ELSE 0.4e0 END) AS overlap
   FROM (SELECT DISTINCT l_partkey, l_orderkey FROM lineitem) l JOIN h ON l.l_partkey = h.id GROUP BY 1)"""


def seeds(spark, sf_dir):
    return table(spark, sf_dir, "part").filter("p_size = 1").select(F.col("p_partkey").alias("id"))


@query("overlap_score", f"WITH {_OVER} SELECT passage, round(overlap, 6) AS overlap FROM o")
def overlap_score(spark, sf_dir):
    found = graph.overlap_scores(graph.expand(seeds(spark, sf_dir), cooc(spark, sf_dir)), links(spark, sf_dir))
    return found.select("passage", r6("overlap", "overlap"))


@query(
    "graph_expansion",
    f"""WITH {_OVER}, d AS (SELECT o_orderkey AS chunk, o_totalprice AS d FROM orders), b AS (SELECT d.chunk, coalesce(overlap, 0e0) AS g, d.d FROM d LEFT JOIN o ON o.passage = d.chunk),
      n AS (SELECT chunk, (g - min(g) OVER ()) / (max(g) OVER () - min(g) OVER ()) + 0.5e0 * (d - min(d) OVER ()) / (max(d) OVER () - min(d) OVER ()) AS score FROM b),
      t AS (SELECT chunk, score FROM n ORDER BY score DESC, chunk LIMIT 10)
    SELECT chunk, round(score, 6) AS score FROM t WHERE t.score > 0""",
)
def graph_expansion(spark, sf_dir):
    dense = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("chunk"), F.col("o_totalprice").alias("dense"))
    return retrieve.graph_expansion(seeds(spark, sf_dir), cooc(spark, sf_dir), links(spark, sf_dir), dense).select("chunk", r6("score", "score"))


@query(
    "ego_bfs",
    f"""WITH e AS (SELECT DISTINCT l_partkey AS a, l_orderkey + {SHIFT} AS b FROM lineitem), w AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
      d0 AS (SELECT 1::BIGINT AS id, 0 AS dist), d1 AS (SELECT DISTINCT b AS id, 1 AS dist FROM w JOIN d0 ON w.a = d0.id),
      d2 AS (SELECT DISTINCT b AS id, 2 AS dist FROM w JOIN d1 ON w.a = d1.id WHERE b NOT IN (SELECT id FROM d0 UNION SELECT id FROM d1)),
      u AS (SELECT * FROM d0 UNION ALL SELECT * FROM d1 UNION ALL SELECT * FROM d2)
    SELECT id, CAST(dist AS INTEGER) AS dist FROM u ORDER BY u.dist, id LIMIT 60""",
)
def ego_bfs(spark, sf_dir):
    edges = links(spark, sf_dir).select(F.col("entity").alias("src"), (F.col("passage") + SHIFT).alias("dst"))
    return graph.neighbourhood(edges, F.lit(1).cast("long"), 2, 60)


def ppr_sql(name: str, vertices: str, edges: str, reset: str, damping: float, rounds: int) -> str:
    """CTEs that end in ``name``(id, rank): the same power iteration in SQL. Arguments name relations."""
    n = name
    out = [
        f"{n}_p AS (SELECT v.id, coalesce(r.p, 0e0) / (SELECT sum(p) FROM {reset}) AS p FROM {vertices} v LEFT JOIN {reset} r USING (id))",
        f"{n}_b AS (SELECT src, dst, weight FROM {edges} UNION ALL SELECT dst, src, weight FROM {edges})",
        f"{n}_f AS MATERIALIZED (SELECT src, dst, weight / sum(weight) OVER (PARTITION BY src) AS share FROM {n}_b)",
        f"{n}_0 AS (SELECT id, p AS rank FROM {n}_p)",
    ]
    for k in range(1, rounds + 1):
        last = f"{n}_{k - 1}"
        out.append(
            f"{n}_{k} AS MATERIALIZED (SELECT p.id, {damping}e0 * coalesce(m.got, 0e0) + p.p * (1e0 - {damping}e0 * (SELECT coalesce(sum(rank), 0e0) FROM {last} WHERE id IN (SELECT src FROM {n}_f))) AS rank "
            f"FROM {n}_p p LEFT JOIN (SELECT dst AS id, sum(rank * share) AS got FROM {last} JOIN {n}_f ON {last}.id = src GROUP BY 1) m USING (id))"
        )
    out.append(f"{name} AS (SELECT id, rank FROM {n}_{rounds})")
    return ", ".join(out)


_V = "v AS (SELECT vec_id AS id FROM embeddings), reset AS (SELECT vec_id AS id, 1e0 AS p FROM embeddings WHERE label = 0)"


def ranked(spark, sf_dir, rounds=20):
    v = vectors(spark, sf_dir)
    return graph.pagerank(v.select("id"), knn(spark, sf_dir), v.filter("label = 0").select("id", F.lit(1.0).alias("p")), 0.75, rounds)


@query("ppr_power", f"WITH {_KNN}, {_V}, {ppr_sql('ppr', 'v', 'knn', 'reset', 0.75, 20)} SELECT id, round(rank, 6) AS rank FROM ppr")
def ppr_power(spark, sf_dir):
    return ranked(spark, sf_dir).select("id", r6("rank", "rank"))


@query(
    "induced_subgraph",
    f"""WITH {_KNN}, {_S0}, t AS (SELECT id FROM s ORDER BY score DESC, id LIMIT 100)
    SELECT src, dst, round(weight, 6) AS weight FROM knn WHERE src IN (SELECT id FROM t) AND dst IN (SELECT id FROM t)""",
)
def induced_subgraph(spark, sf_dir):
    v = vectors(spark, sf_dir)
    focus = scored(v, first(v)).orderBy(F.col("score").desc(), "id").limit(100)
    return graph.induced(knn(spark, sf_dir), focus.select("id")).select("src", "dst", r6("weight", "weight"))


@query(
    "two_stage_merge",
    f"""WITH {_KNN}, {_V}, {ppr_sql("ppr", "v", "knn", "reset", 0.75, 20)},
      focus AS MATERIALIZED (SELECT id FROM ppr ORDER BY round(rank, 12) DESC, id LIMIT 50), sub AS (SELECT * FROM knn WHERE src IN (FROM focus) AND dst IN (FROM focus)),
      again AS (SELECT id, 1e0 AS p FROM focus JOIN reset USING (id)), {ppr_sql("ppr2", "focus", "sub", "again", 0.45, 20)},
      m AS (SELECT ppr.id, coalesce(ppr2.rank, ppr.rank * (SELECT 0.5e0 * min(rank) FROM ppr2)) AS score FROM ppr LEFT JOIN ppr2 USING (id))
    SELECT id, round(score, 6) AS score FROM m""",
)
def two_stage_merge(spark, sf_dir):
    v = vectors(spark, sf_dir)
    edges = cut(knn(spark, sf_dir))
    doc1 = ranked(spark, sf_dir)
    focus = cut(doc1.orderBy(F.round("rank", 12).desc(), "id").limit(50).select("id"))
    reset = v.filter("label = 0").join(focus, ["id"], "left_semi").select("id", F.lit(1.0).alias("p"))
    doc2 = graph.pagerank(focus, graph.induced(edges, focus), reset, 0.45, 20)
    return retrieve.merge_stages(doc1, doc2).select("id", r6("score", "score"))


ROUNDS = 5


def lpa_sql() -> str:
    out = ["b AS MATERIALIZED (SELECT src, dst, weight FROM knn UNION ALL SELECT dst, src, weight FROM knn)", "l0 AS (SELECT vec_id AS id, vec_id AS community FROM embeddings)"]
    for k in range(1, ROUNDS + 1):
        out.append(
            f"l{k} AS MATERIALIZED (SELECT l.id, coalesce(n.community, l.community) AS community FROM l{k - 1} l LEFT JOIN (SELECT id, community FROM "
            f"(SELECT b.src AS id, x.community, round(sum(b.weight), 9) AS w FROM b JOIN l{k - 1} x ON b.dst = x.id GROUP BY 1, 2) "
            f"QUALIFY row_number() OVER (PARTITION BY id ORDER BY w DESC, community) = 1) n USING (id))"
        )
    return ", ".join(out)


_LPA = f"{_KNN}, {lpa_sql()}"


def communities(spark, sf_dir, edges):
    return graph.label_propagation(vectors(spark, sf_dir).select("id"), edges, ROUNDS)


@query("community_lpa", f"WITH {_LPA} SELECT community, CAST(count(*) AS BIGINT) AS size, min(id) AS first_id, max(id) AS last_id FROM l{ROUNDS} GROUP BY 1 HAVING count(*) >= 2")
def community_lpa(spark, sf_dir):
    found = graph.components_within(communities(spark, sf_dir, cut(knn(spark, sf_dir))))
    return found.select("community", "size", F.array_min("members").alias("first_id"), F.array_max("members").alias("last_id"))


@query(
    "community_intra_edges",
    f"WITH {_LPA} SELECT x.community, src, dst, round(weight, 6) AS weight FROM knn JOIN l{ROUNDS} x ON x.id = src JOIN l{ROUNDS} y ON y.id = dst WHERE x.community = y.community",
)
def community_intra_edges(spark, sf_dir):
    edges = cut(knn(spark, sf_dir))
    return graph.intra_edges(communities(spark, sf_dir, edges), edges).select("community", "src", "dst", r6("weight", "weight"))


@query(
    "community_modularity",
    f"""WITH {_LPA}, w AS (SELECT x.community AS c1, y.community AS c2, weight FROM knn JOIN l{ROUNDS} x ON x.id = src JOIN l{ROUNDS} y ON y.id = dst),
      d AS (SELECT c, sum(weight) AS d FROM (SELECT c1 AS c, weight FROM w UNION ALL SELECT c2, weight FROM w) GROUP BY 1), i AS (SELECT c1 AS c, sum(weight) AS i FROM w WHERE c1 = c2 GROUP BY 1)
    SELECT round(sum(2 * coalesce(i, 0) / (SELECT sum(d) FROM d) - pow(d / (SELECT sum(d) FROM d), 2)), 6) AS modularity FROM d LEFT JOIN i USING (c)""",
)
def community_modularity(spark, sf_dir):
    edges = cut(knn(spark, sf_dir))
    return graph.modularity(communities(spark, sf_dir, edges), edges).select(r6("modularity", "modularity"))


@query(
    "report_inputs",
    f"""WITH {_LPA}, w AS (SELECT x.community, src || '-' || dst || ' ' || printf('%.3f', weight) AS line, weight, src, dst FROM knn JOIN l{ROUNDS} x ON x.id = src JOIN l{ROUNDS} y ON y.id = dst
      WHERE x.community = y.community), m AS (SELECT community, string_agg(id::VARCHAR, ', ' ORDER BY id) AS members FROM l{ROUNDS} GROUP BY 1 HAVING count(*) >= 2)
    SELECT m.community, left(m.members, 6000) AS members, left(string_agg(w.line, chr(10) ORDER BY round(w.weight, 6) DESC, src, dst), 6000) AS relations FROM m JOIN w USING (community) GROUP BY 1, 2""",
)
def report_inputs(spark, sf_dir):
    """Text of a community report's input: members, then relations by weight, each half of the budget."""
    edges = cut(knn(spark, sf_dir))
    labels = communities(spark, sf_dir, edges)
    lines = graph.intra_edges(labels, edges).withColumn("line", F.format_string("%d-%d %.3f", "src", "dst", "weight"))
    by = F.array_sort(F.collect_list(F.struct((-F.round("weight", 6)).alias("w"), "src", "dst", "line")))
    relations = lines.groupBy("community").agg(F.substring(F.array_join(F.transform(by, lambda x: x["line"]), "\n"), 1, 6000).alias("relations"))
    members = graph.components_within(labels).select("community", F.substring(F.array_join(F.transform("members", lambda x: x.cast("string")), ", "), 1, 6000).alias("members"))
    return members.join(relations, ["community"])


# Beam search: vectors are propositions, their label is the one entity they hold, and labels are
# synonyms if the nearest-neighbour graph joins vectors of both.
_SYN = f"""{_KNN}, syn AS (SELECT least(a.label, b.label) AS src, greatest(a.label, b.label) AS dst, round(max(weight), 9) AS weight FROM knn
 JOIN embeddings a ON a.vec_id = knn.src JOIN embeddings b ON b.vec_id = knn.dst WHERE a.label <> b.label GROUP BY 1, 2 HAVING max(weight) >= 0.4e0),
 syn2 AS (SELECT src AS e1, dst AS e2, weight FROM syn UNION ALL SELECT dst, src, weight FROM syn)"""
SPEC = {n: BeamSpec(length=n, synonym_floor=0.4) for n in (2, 3)}


def beam_inputs(spark, sf_dir):
    v = vectors(spark, sf_dir)
    held = v.select(F.col("id").alias("prop"), F.lit(0).alias("ord"), F.col("label").cast("long").alias("entity"))
    edges = knn(spark, sf_dir)
    a, b = (v.select(F.col("id").alias(k), F.col("label").cast("long").alias(f"l{k}")) for k in ("src", "dst"))
    syn = edges.join(a, ["src"]).join(b, ["dst"]).filter("lsrc <> ldst").groupBy(F.least("lsrc", "ldst").alias("src"), F.greatest("lsrc", "ldst").alias("dst"))
    return v, held, cut(syn.agg(F.round(F.max("weight"), 9).alias("weight")).filter("weight >= 0.4"))


def beam_sql(length: int) -> str:
    """CTEs that end in paths(path, score, depth, rank, steps), steps holding (type, e2) of each step."""
    out = [
        _SYN, _S0, "sd AS MATERIALIZED (SELECT id, score, row_number() OVER (ORDER BY score DESC, id) AS rank FROM s ORDER BY score DESC, id LIMIT 200)",
        "jump AS (SELECT id AS y, rank AS j FROM sd WHERE rank <= 3)", "q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0)",
        "b1 AS (SELECT [id] AS path, score, rank, 1 AS depth, []::STRUCT(t VARCHAR, e2 BIGINT)[] AS steps FROM sd WHERE rank <= 4)", "k1 AS (SELECT path AS key FROM b1)",
    ]
    for d in range(2, length + 1):
        p = d - 1
        weights = {2: ("1e0 / 3", "2e0 / 3"), 3: ("2e0 / 9", "3e0 / 9", "4e0 / 9")}[d]
        emb = " ".join(f"JOIN embeddings m{i} ON m{i}.vec_id = f.path[{i}]" for i in range(1, d + 1))
        mix = " + ".join(f"m{i}.embedding[i]::DOUBLE * {w}" for i, w in enumerate(weights, 1))
        seen = " UNION ALL ".join(f"SELECT key FROM k{i}" for i in range(1, d))
        out += [
            f"x{d} AS (SELECT path[-1] AS x, min(rank) AS g FROM b{p} GROUP BY 1)",
            f"c{d} AS MATERIALIZED (SELECT x, e.vec_id AS y, CASE WHEN e.label = o.label THEN 0 ELSE 1 END AS syn, e.label::BIGINT AS e2 FROM x{d} JOIN embeddings o ON o.vec_id = x "
            f"JOIN embeddings e ON e.label = o.label OR EXISTS (SELECT 1 FROM syn2 WHERE syn2.e1 = o.label AND syn2.e2 = e.label))",
            f"h{d} AS (SELECT x, y, 0 AS k, syn, e2, 0 AS j FROM c{d} WHERE x <> y UNION ALL SELECT x, y, 1, NULL, NULL, j FROM x{d}, jump WHERE x <> y AND NOT EXISTS (SELECT 1 FROM c{d} c WHERE c.x = x{d}.x AND c.y = jump.y))",
            f"g{d} AS (SELECT list_append(path, y) AS path, list_append(steps, CASE WHEN k = 1 THEN NULL ELSE {{'t': CASE WHEN syn = 0 THEN 'exact' ELSE 'synonym' END, 'e2': e2}} END) AS steps, "
            f"list_sort(list_append(path, y)) AS key, g, rank AS r, k, syn, e2, y, j FROM b{p} JOIN x{d} ON path[-1] = x{d}.x JOIN h{d} ON h{d}.x = x{d}.x WHERE NOT list_contains(path, y))",
            f"f{d} AS MATERIALIZED (SELECT * FROM g{d} WHERE key NOT IN ({seen}) QUALIFY row_number() OVER (PARTITION BY key ORDER BY g, r, k, syn, e2, y, j) = 1)",
            f"k{d} AS (SELECT key FROM f{d})",
            f"u{d} AS (SELECT f.*, list_transform(range(1, 65), lambda i: {mix}) AS u FROM f{d} f {emb})",
            f"n{d} AS MATERIALIZED (SELECT u{d}.*, list_dot_product(u, q) / greatest(sqrt(list_dot_product(u, u)), 1e-12) AS score FROM u{d}, q)",
            f"b{d} AS MATERIALIZED (SELECT path, score, row_number() OVER (ORDER BY round(score, 12) DESC, g, r, k, syn, e2, y, j) AS rank, {d} AS depth, steps FROM n{d} "
            f"ORDER BY round(score, 12) DESC, g, r, k, syn, e2, y, j LIMIT 4)",
        ]
    every = " UNION ALL ".join(f"SELECT path, score, rank, depth, steps FROM b{d}" for d in range(1, length + 1))
    out.append(f"paths AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY round(score, 12) DESC, depth, rank) AS final_rank FROM ({every}))")
    return ", ".join(out)


def _beam(length):
    def run(spark, sf_dir):
        v, held, syn = beam_inputs(spark, sf_dir)
        paths = beam_search(first(v), v, held, syn, SPEC[length])
        kinds = F.array_join(F.transform("conns", lambda c: F.coalesce(c["type"], F.lit("jump"))), ",")
        return paths.select(
            F.array_join(F.transform("path", lambda x: x.cast("string")), "-").alias("path"), kinds.alias("steps"), F.col("depth").cast("int").alias("depth"), r6("score", "score"),
            F.col("final_rank").cast("int").alias("final_rank"),
        )

    return run


for _n in (2, 3):
    query(
        f"beam_depth{_n}",
        f"WITH {beam_sql(_n)} SELECT array_to_string(path, '-') AS path, coalesce(array_to_string(list_transform(steps, lambda c: coalesce(c.t, 'jump')), ','), '') AS steps, "
        f"CAST(depth AS INTEGER) AS depth, round(score, 6) AS score, CAST(final_rank AS INTEGER) AS final_rank FROM paths",
    )(_beam(_n))


@query(
    "path_entity_scores",
    f"""WITH {beam_sql(2)}, o AS (SELECT e.label::BIGINT AS entity, score FROM (SELECT unnest(path) AS id, score FROM paths) p JOIN embeddings e ON e.vec_id = p.id
      UNION ALL SELECT c.e2, score FROM (SELECT unnest(steps) AS c, score FROM paths) WHERE c.t = 'synonym')
    SELECT entity, round(sum(score), 6) AS total, round(max(score), 6) AS best FROM o GROUP BY 1""",
)
def path_entity_scores(spark, sf_dir):
    v, held, syn = beam_inputs(spark, sf_dir)
    found = entity_scores(beam_search(first(v), v, held, syn, SPEC[2]), held)
    return found.select("entity", r6("total", "total"), r6("best", "best"))


@query(
    "path_materialise",
    f"""WITH {beam_sql(2)}, p AS (SELECT final_rank, unnest(path) AS id, generate_subscripts(path, 1) AS pos FROM paths)
    SELECT CAST(final_rank AS INTEGER) AS final_rank, string_agg(md5(d.text), ' ' ORDER BY pos) AS texts FROM p JOIN documents d ON d.doc_id = p.id GROUP BY 1""",
)
def path_materialise(spark, sf_dir):
    v, held, syn = beam_inputs(spark, sf_dir)
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    found = path_texts(beam_search(first(v), v, held, syn, SPEC[2]), texts)
    return found.select(F.col("final_rank").cast("int").alias("final_rank"), F.array_join(F.transform("texts", F.md5), " ").alias("texts"))


_HOPS = f"""WITH {_SYN} SELECT a.vec_id AS x, b.vec_id AS y, s.e1::BIGINT AS entity1, s.e2::BIGINT AS entity2, round(s.weight, 6) AS similarity FROM embeddings a JOIN syn2 s ON s.e1 = a.label JOIN embeddings b ON b.label = s.e2"""


@query("exact_hop_pairs", "SELECT a.vec_id AS x, b.vec_id AS y, a.label::BIGINT AS entity FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id")
def exact_hop_pairs(spark, sf_dir):
    v, held, syn = beam_inputs(spark, sf_dir)
    lasts = v.select(F.col("id").alias("x"))
    found = connections(lasts, held, syn, v, 0.4).filter("usable and type = 'exact'")
    return found.select("x", "y", F.col("entity1").alias("entity"))


@query("synonym_hop_pairs", _HOPS)
def synonym_hop_pairs(spark, sf_dir):
    v, held, syn = beam_inputs(spark, sf_dir)
    lasts = v.select(F.col("id").alias("x"))
    found = connections(lasts, held, syn, v, 0.4).filter("usable and type = 'synonym'")
    return found.select("x", "y", "entity1", "entity2", r6("similarity", "similarity"))


@query("hash_resolve", "SELECT p_partkey AS id, 'entity-' || md5(trim(p_name)) AS node FROM part WHERE md5(trim(p_name)) IN (SELECT md5(p_name) FROM part)")
def hash_resolve(spark, sf_dir):
    """Phrases (part names) to entity nodes by content id."""
    p = table(spark, sf_dir, "part")
    nodes = p.select(content_id(F.col("p_name"), "entity-").alias("node")).distinct()
    return p.select(F.col("p_partkey").alias("id"), content_id(F.trim("p_name"), "entity-").alias("node")).join(nodes, ["node"]).select("id", "node")


@query(
    "entity_lookup_priority",
    """WITH t AS (SELECT p_name AS t FROM part WHERE p_partkey = 1), c AS (SELECT p_partkey AS id, p_name AS name, CAST(CASE WHEN p_name = upper(t) THEN 0 WHEN lower(p_name) = lower(t) THEN 1
      WHEN contains(lower(p_name), lower(t)) THEN 2 END AS INTEGER) AS level FROM part, t) SELECT * FROM c WHERE level IS NOT NULL ORDER BY level, id LIMIT 1""",
)
def entity_lookup_priority(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    wanted = p.filter("p_partkey = 1").select("p_name").first()[0].upper()
    return graph.lookup(p, wanted, id_col="p_partkey", name_col="p_name")


@query("entity_list", "SELECT DISTINCT p_name AS name FROM part ORDER BY name LIMIT 500")
def entity_list(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_name").alias("name")).distinct().orderBy("name").limit(500)
