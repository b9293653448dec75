"""Search by stems, expansion, records, upserts, communities, models and recall of the cell search, on small cases."""

import math
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from citelens.operators import citations, graph, models, reports, search, text, vectors
from citelens.sources import records, tables


@pytest.mark.parametrize(
    ("query", "found"),
    [('"activity module"', True), ('"activating modules"', True), ("dna methylation", True), ("methylations", True), ("activate module", True), ('"active module"', False), ('"activating module"', False), ("positive", False), ('"dna methylation"', False), ("dna, nothing", True), ("dna nothing", False)],
)
def test_search_by_words_and_phrases(spark, query, found):
    paper = [(100, "Activity module of DNA", "Activating modules by methylation activate seropositive cells")]
    df = spark.createDataFrame(paper, "id long, title string, abstract string")
    assert df.filter(search.matches(query, F.col("title"), F.col("abstract"))).count() == int(found)


def test_sampled_search_relaxes_phrases(spark):
    df = spark.createDataFrame([(i, "word of", "another kind", 2000) for i in range(400)], "id long, title string, abstract string, year int")
    edges = spark.createDataFrame([(i, 7) for i in range(1000, 1005)], "id_out long, id_in long")
    assert search.ranked(df, edges, '"another word"', 1000).count() == 0
    got = search.ranked(df, edges, '"another word"', 1000, fraction=0.5)
    assert 150 < got.count() < 250 and sorted(r.id for r in got.collect()) == sorted(r.id for r in search.ranked(df.repartition(7), edges, '"another word"', 1000, fraction=0.5).collect())
    assert [r["count"] for r in search.ranked(df, edges, "word", 3).collect()] == [5, None, None]


def test_expansion_in_steps(spark):
    """Seeds 3 and 4 of a small citation graph: references first, then neighbours, seeds kept in front."""
    pairs = [(2, 1), (3, 2), (4, 3), (5, 4), (6, 5), (7, 1), (7, 2), (7, 3), (8, 1), (8, 3), (8, 4), (9, 4), (9, 5), (10, 4), (10, 5)]
    edges = spark.createDataFrame(pairs, "id_out long, id_in long")
    counts, seeds = citations.citation_counts(edges), spark.createDataFrame([(3,), (4,)], "id long")
    step = lambda n, limit, **more: {r.id: r.step for r in citations.expand_steps(edges, seeds, counts, n, limit, **more).collect()}
    assert step(0, 10) == {3: 0, 4: 0}
    assert step(1, 10) == {3: 0, 4: 0, 2: 1}
    assert set(step(2, 20)) >= {3, 4, 2} and {i for i, s in step(2, 20).items() if s == 1} == {2}
    assert len(step(2, 4)) == 4
    similar = spark.createDataFrame([(9, 0.2), (6, 0.1), (9, 0.05)], "id long, distance double")
    assert step(1, 12, similar=similar) == {3: 0, 4: 0, 9: 0, 6: 0, 2: 1}


def test_upsert_rules(spark):
    base = spark.createDataFrame([(1, "old", "kept text"), (2, "two", "b")], "id long, title string, abstract string")
    updates = spark.createDataFrame([(1, "n" * 2000, "", 2), (1, "older", "x", 1), (3, "new", "c", 1), (3, "other", "c", 1)], "id long, title string, abstract string, v int")
    got = {r.id: (r.title, r.abstract) for r in tables.upsert(base, updates, newest="v").collect()}
    assert got == {1: ("n" * 1023, None), 2: ("two", "b"), 3: ("other", "c")}


def test_records_with_markup(spark):
    xml = """<PubmedArticle><PMID>5</PMID><ArticleTitle>[On <i>C. elegans</i>.]</ArticleTitle><Abstract><AbstractText Label="A">CO<sub>2</sub> &lt; 5µ</AbstractText>
    <AbstractText> rest </AbstractText></Abstract><MeshHeadingList><MeshHeading><DescriptorName>Cells, Cultured</DescriptorName><QualifierName>a</QualifierName><QualifierName>b</QualifierName></MeshHeading></MeshHeadingList>
    <ReferenceList><Reference><ArticleIdList><ArticleId IdType="doi">10.1/ref</ArticleId><ArticleId IdType="pubmed">77</ArticleId></ArticleIdList></Reference></ReferenceList>
    <PubmedData><ArticleIdList><ArticleId IdType="doi">10.1/own</ArticleId></ArticleIdList></PubmedData></PubmedArticle>"""
    r = records.publications_from_xml(spark.createDataFrame([(xml,)], "xml string")).first()
    assert (r.title, r.abstract, r.mesh, r.doi, r.refs) == ("On C. elegans", "CO2 < 5 rest", ["Cells Cultured a b"], "10.1/own", [77])


def test_records_are_parsed_once(spark):
    """Comments part texts, prefixes need no declaration, DOIs of references are not the article's; no path is evaluated on the text."""
    xml = """<PubmedArticle><PMID> 6 </PMID><Journal><Title>J &amp; <![CDATA[<K>]]></Title></Journal><Keyword>a<!-- c -->b <i>c</i> d, e/f</Keyword><Keyword/>
    <Abstract><AbstractText>One<m:x> two</m:x></AbstractText></Abstract><OtherAbstract><AbstractText>three</AbstractText></OtherAbstract><Affiliation> Here. </Affiliation><PubDate><Year>2001</Year></PubDate>
    <ReferenceList Kind="x"><Title>No</Title><Reference><ArticleIdList><ArticleId IdType="doi">10.1/ref</ArticleId><ArticleId IdType="pubmed">8</ArticleId></ArticleIdList></Reference></ReferenceList><ELocationID EIdType="doi"> 10.1/at </ELocationID></PubmedArticle>"""
    found = records.publications_from_xml(spark.createDataFrame([(xml,), (None,), ("",), ("<PubmedArticle/>",)], "xml string"))
    r, = found.collect()
    assert (r.id, r.year, r.title, r.abstract, r.keywords, r.refs, r.affiliations) == (6, 2001, "", "One two three", ["a", "b", "d e f"], [8], ["Here"])
    assert (r.journal, r.doi, r.language, r.type) == ("J & <K>", "10.1/at", "", "Article")
    assert "xpath" not in found._jdf.queryExecution().toString()


def test_records_over_lines(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"id": "1", "title": "one",\n "year": "1999"}\n{"id": "2", "title": "two"}\n{"id": 3,\n "ti\n}\n{"id": "4", "title": "four"}')
    assert sorted(r.id for r in records.publications_from_long_lines(spark, str(tmp_path)).collect()) == ["1", "2", "4"]


def test_communities_of_two_cliques(spark):
    """Two cliques of six with one edge between them, whose modularity is known."""
    cliques = [(a + o, b + o, 1.0) for o in (0, 10) for a in range(6) for b in range(a + 1, 6)]
    edges = spark.createDataFrame([*cliques, (0, 10, 1.0)], "src long, dst long, similarity double")
    found = graph.label_communities(edges, rounds=12)
    groups = {}
    for r in found.collect():
        groups.setdefault(r.community, set()).add(r.id)
    assert sorted(map(sorted, groups.values())) == [list(range(6)), list(range(10, 16))]
    assert graph.modularity(edges, found).first()[0] == pytest.approx(30 / 31 - 0.5)


def test_walks_go_along_edges(spark):
    edges = spark.createDataFrame([(1, 2, 100.0), (2, 3, 10.0), (1, 3, 1.0)], "src long, dst long, similarity double")
    nodes = spark.createDataFrame([(1,), (2,), (3,), (4,)], "id long")
    rows = graph.random_walks(edges, nodes, walks=5, length=12).collect()
    assert len(rows) == 20 and all(len(r.walk) == (1 if r.walk[0] == 4 else 12) for r in rows)
    assert all(a != b and {a, b} <= {1, 2, 3} for r in rows for a, b in zip(r.walk, r.walk[1:]))


def test_walks_do_not_depend_on_regions(spark):
    """Walks in one task, in regions of at most four nodes, and by the plain rule with the SQL function's draws."""
    near = {}
    for i in range(24):
        for j, w in ((i + 1, 3.0), (i + 2, 1.0), (i * 5, 2.0)):
            if i != j % 24:
                near.setdefault(i, {})[j % 24] = near.setdefault(j % 24, {})[i] = w
    edges = spark.createDataFrame([(a, b, w) for a in near for b, w in near[a].items() if a < b], "src long, dst long, similarity double")
    nodes = spark.createDataFrame([(i,) for i in range(25)], "id long")
    runs = [{r.walker: r.walk for r in graph.random_walks(edges, nodes, walks=3, length=8, **options).collect()} for options in ({}, {"most": 4})]
    assert runs[0] == runs[1] and len(runs[0]) == 75
    steps = [(w, n, k) for w, walk in runs[0].items() for k in range(1, len(walk)) for n in near[walk[k - 1]]]
    drawn = spark.createDataFrame(steps, "w long, n long, k int").select("*", F.pmod(F.xxhash64(F.lit(0), "w", "k", "n"), F.lit(1 << 40)).alias("u")).collect()
    u = {(r.w, r.k, r.n): (r.u + 1) / ((1 << 40) + 1) for r in drawn}
    for w, walk in runs[0].items():
        assert len(walk) == (1 if walk[0] == 24 else 8)
        for k in range(1, len(walk)):
            prev, node = walk[k - 2] if k > 1 else None, walk[k - 1]
            bias = {n: 1.0 if prev is None else 0.2 if n == prev else 1.0 if n in near[prev] else 0.5 for n in near[node]}
            assert walk[k] == min(near[node], key=lambda n: (-math.log(u[w, k, n]) / (near[node][n] * bias[n]), n))  # noqa: B023


def test_ranks_by_year(spark):
    edges = spark.createDataFrame([("a", "b", 1.0, 2000), ("a", "c", 1.0, 2001)], "src string, dst string, weight double, year int")
    nodes = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    got = {(r.id, r.cut): r.rank for r in graph.page_rank_by_cut(edges, nodes, [2000, 2001], rounds=40).collect()}
    assert got["a", 2000] == pytest.approx(got["b", 2000]) and got["a", 2001] > got["b", 2001] == pytest.approx(got["c", 2001])
    assert sum(v for (_, y), v in got.items() if y == 2001) == pytest.approx(1.0)


def test_default_encoder_and_one_of_your_own(spark):
    df = spark.createDataFrame([(1, "a b a"), (2, ""), (3, None), (4, "b a A")], "id long, text string")
    got = {r.id: np.array(r.embedding) for r in vectors.encode_texts(df).collect()}
    assert np.linalg.norm(got[1]) == pytest.approx(1, abs=1e-6) and not got[2].any() and not got[3].any() and np.allclose(got[1], got[4])
    own = vectors.encode_texts(df, encoder=lambda texts: np.array([[len(t), 3.0, 4.0] for t in texts]))
    assert {r.id: r.embedding for r in own.collect()}[2] == pytest.approx([0.0, 0.6, 0.8])


def test_recall_of_the_cell_search(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(2000, 16)) + 4 * rng.normal(size=(12, 16))[rng.integers(0, 12, 2000)]
    rows = spark.createDataFrame([(i, 0, v.tolist()) for i, v in enumerate(x)], "id long, chunk int, embedding array<double>")
    asked = rows.filter("id % 40 = 0").select(F.col("id").alias("query"), "embedding")
    exact = {(r.query, r.id) for r in vectors.nearest(rows, asked, 10).collect()}
    indexed, centroids = vectors.cells(rows, 16)
    found = {(r.query, r.id) for r in vectors.nearest_in_cells(indexed, centroids, asked, 10, 6).collect()}
    assert len(exact & found) / len(exact) >= 0.9


def test_clusters_by_size(spark):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(size=(20, 4)), 20 + rng.normal(size=(20, 4))])
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, embedding array<double>")
    for exact in (5000, 10):
        comp = {r.id: r.comp for r in models.clusters_or_none(rows, 2, exact=exact).collect()}
        assert len({comp[i] for i in range(20)}) == 1 and comp[0] != comp[39] and len(set(comp.values())) == 2
    assert {r.comp for r in models.clusters_or_none(rows.limit(2), 2).collect()} == {0}


def test_repeated_regression_and_classes(spark):
    rng = np.random.default_rng(5)
    rows = [(i, float(a), float(b), float(np.exp(2 * a) - 1 if a > 0 else 0.0)) for i, (a, b) in enumerate(rng.uniform(0, 1, (600, 2)))]
    df = spark.createDataFrame(rows, "id long, a double, b double, y double")
    coefficients, scores = models.repeated_regression(df.filter("id % 2 = 0"), df.filter("id % 2 = 1"), ["a", "b"], "y", runs=2)
    first = coefficients.first()
    assert first.feature == "a" and first.coefficient == pytest.approx(2 * np.std([r[1] for r in rows]), rel=0.1)
    assert scores.count() == 4 and min(r.r2 for r in scores.collect()) > 0.99
    labelled = models.above_top_share(df, "y", 0.1)
    assert labelled.filter("label = 1").count() == 59  # the least of the sixty is no top
    got = models.top_paper_classifier(labelled.filter("id % 2 = 0"), labelled.filter("id % 2 = 1"), ["a", "b"], "up", trees=20).first()
    assert got.recall > 0.8 and got.tn + got.fp + got.fn + got.tp == 300


def test_stems_in_spark_and_sql(spark):
    import duckdb

    words = ["rational", "relations", "modules", "studies", "running", "classes", "hopeful", "as", "bus", "matches", "elements"]
    mine = [r[0] for r in spark.createDataFrame([(i, w) for i, w in enumerate(words)], "i int, w string").orderBy("i").select(text.stem(F.col("w"))).collect()]
    sql = [duckdb.connect().execute(f"SELECT {text.stem_sql(repr(w))}").fetchone()[0] for w in words]
    assert mine == sql


def _written(spark):
    """Bytes of every folder of rows in the shared folder."""
    sizes = {}
    for part in Path(tables.shared_folder(spark).removeprefix("file:")).rglob("part-*"):
        sizes[part.parent] = sizes.get(part.parent, 0) + part.stat().st_size
    return sizes


def _two_cliques(spark):
    return spark.createDataFrame([(a, b, 1.0) for a in range(12) for b in range(a + 1, 12) if (a < 6) == (b < 6) or a + b == 11], "src long, dst long, similarity double")


def test_rounds_of_labels_keep_only_their_last_state(spark):
    before, found = set(_written(spark)), graph.label_communities(_two_cliques(spark), rounds=6)
    assert len(set(_written(spark)) - before) <= 2 and found.count() == 12


def test_levels_of_communities_keep_only_their_names(spark):
    before, levels = set(_written(spark)), graph.community_levels(_two_cliques(spark))
    assert len(set(_written(spark)) - before) <= 2 + len(levels) + 2
    assert levels[-1][0].count() == 12


def test_author_graph_adds_up_numbers_not_names(spark):
    """Pairs are summed by places of names in their order and get the names at the end; repeated and null rows as before."""
    papers = spark.createDataFrame([(1, "b"), (1, "a"), (1, "a"), (1, None), (2, "B"), (2, "a"), (3, "é"), (None, "b"), (None, "c")], "id long, author string")
    edges = spark.createDataFrame([(1, 2), (1, 2), (3, 1), (4, 1), (None, 1)], "id_out long, id_in long")
    found = reports.author_graph(papers, edges)
    want = {("a", "b"): 102, ("B", "a"): 102, ("B", "b"): 2, ("a", "é"): 1, ("b", "é"): 1}
    assert {(r.src, r.dst): r.weight for r in found.collect()} == want and found.columns == ["src", "dst", "weight"]
    assert {(r.src, r.dst): r.weight for r in reports.author_graph(papers).collect()} == {("a", "b"): 100, ("B", "a"): 100}
    assert "place" in found._jdf.queryExecution().optimizedPlan().toString()


def test_walkers_are_numbered_where_they_start(spark):
    """A node is written with one number, whatever the number of its walkers, which are those of the SQL function."""
    before = _written(spark)
    walks = graph.random_walks(_two_cliques(spark), spark.range(13).toDF("id"), walks=2000, length=2)
    assert sum(size for folder, size in _written(spark).items() if folder not in before) < 50_000
    want = spark.range(13).select(F.explode(F.transform(F.sequence(F.lit(1), F.lit(2000)), lambda n: F.xxhash64(F.lit(0), "id", n))).alias("walker"))
    assert walks.count() == 26_000 and walks.join(want, "walker", "left_semi").count() == 26_000
