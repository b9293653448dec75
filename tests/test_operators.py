"""Small golden cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from citelens.functions import scalars
from citelens.operators import citations, graph, impact, models, reports, search, text, vectors
from citelens.sources import records, tables
from citelens.streaming import logs

CITATIONS = [(4, 1), (3, 1), (4, 2), (3, 2), (5, 1), (5, 2), (5, 3), (5, 4)]
BY_YEAR = [(1, 1972, 2), (1, 1974, 15), (2, 1974, 1), (3, 1972, 5), (3, 1974, 13), (4, 1972, 1), (4, 1974, 8)]


@pytest.fixture
def edges(spark):
    return spark.createDataFrame(CITATIONS, "id_out int, id_in int")


@pytest.fixture
def by_year(spark):
    return spark.createDataFrame(BY_YEAR, "id int, year int, count int")


def test_cocitations_and_coupling(spark, edges):
    pubs = spark.createDataFrame([(3, 1967), (4, 1968), (5, 1975)], "id int, year int")
    got = citations.cocitation_by_year(citations.cocitations(edges, pubs)).filter("cited_1 = 1 AND cited_2 = 2")
    assert sorted((r.year, r["count"], r.total) for r in got.collect()) == [(1967, 1, 3), (1968, 1, 3), (1975, 1, 3)]
    assert sorted(map(tuple, citations.coupling(edges, 2).collect())) == [(3, 4, 2), (3, 5, 2), (4, 5, 2)]


def test_gains(by_year):
    assert {r.year: r.id for r in citations.max_gain(by_year).collect()} == {1972: 3, 1974: 1}
    assert {r.year: r.id for r in citations.max_relative_gain(by_year).collect()} == {1972: 3, 1974: 4}


def test_expressions():
    assert search.parse_expression('covid-19, "public health" policy') == [["covid-19"], ["public health", "policy"]]
    for bad in ('"open', "", '"one"'):
        with pytest.raises(ValueError):
            search.parse_expression(bad)


def test_xml_records(spark, tmp_path):
    (tmp_path / "a.xml").write_text("<Set><PubmedArticle><PMID>7</PMID><ArticleTitle>[A <i>b</i> c.]</ArticleTitle><PubDate><MedlineDate>Spring 1998-99</MedlineDate></PubDate><Abstract><AbstractText>x</AbstractText><AbstractText>y</AbstractText></Abstract><PublicationType>Review</PublicationType><Reference><ArticleIdList><ArticleId IdType='pubmed'>12</ArticleId><ArticleId IdType='pubmed'>bad</ArticleId></ArticleIdList></Reference></PubmedArticle><DeleteCitation><PMID Version='1'>9</PMID></DeleteCitation></Set>")
    row = records.publications_from_xml(records.xml_records(spark, str(tmp_path / "a.xml"))).first()
    assert (row.id, row.title, row.year, row.abstract, row.type, row.refs) == (7, "A b c", 1998, "x y", "Review", [12])
    assert records.deleted_ids(spark, str(tmp_path / "a.xml")).first().id == 9


def test_json_records(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"id":"a","title":"t","paperAbstract":"","year":"x","pmid":"12v2","entities":["p","q"]}\n{"id":"b"}\n{broken\n')
    row, = records.publications_from_json(spark, str(tmp_path / "a.json")).collect()
    assert (row.id, row.abstract, row.year, row.pmid, row.keywords) == ("a", None, None, 12, "p, q")


def test_chunks(spark):
    df = spark.createDataFrame([(1, "a b c. d e. f g h i j k."), (2, "")], "id int, abstract string")
    got = sorted((r.id, r.chunk, r.text) for r in text.chunks(df, 5, 1).collect())
    assert got == [(1, 0, "a b c. d e."), (1, 1, "f g h i j k."), (2, 0, "")]


def test_topic_words(spark):
    counts = spark.createDataFrame([(1, "frequent", 30), (2, "frequent", 30), (3, "frequent", 30), (2, "rare1", 15), (3, "rare2", 15)], "id int, token string, n int")
    comps = spark.createDataFrame([(1, 0), (2, 1), (3, 2)], "id int, comp int")
    got = {r.comp: (r.token, round(r.score, 2)) for r in reports.topic_words(counts, comps, 1).collect()}
    assert got == {0: ("frequent", 1.98), 1: ("rare1", 2.77), 2: ("rare2", 2.77)}


def test_streams_agree_with_batches(spark, tmp_path):
    rows = [("a", "2024-01-01 10:00:00", "start"), ("a", "2024-01-01 10:01:00", "result"), ("b", "2024-01-02 09:00:00", "start")]
    df = spark.createDataFrame(rows, "job string, ts string, event string").withColumn("ts", F.to_timestamp("ts"))
    df.write.parquet(str(tmp_path / "in"))
    stream = logs.daily_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")))
    stream.writeStream.format("memory").queryName("daily_counts").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    assert sorted(map(tuple, spark.table("daily_counts").collect())) == sorted(map(tuple, logs.daily(df).collect()))


def test_bundle_and_upsert(spark, tmp_path):
    base = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    merged = tables.upsert(base, spark.createDataFrame([(2, "c"), (3, "d")], "id int, v string"))
    tables.save_bundle({"t": merged}, str(tmp_path / "bundle"))
    assert sorted(map(tuple, tables.load_bundle(spark, str(tmp_path / "bundle"))["t"].collect())) == [(1, "a"), (2, "c"), (3, "d")]


def test_crc(spark):
    assert spark.range(1).select(scalars.signed_crc32(F.lit("not hex")).alias("c")).first().c == 0


def test_lowess():
    x = np.arange(20.0)
    assert np.allclose(text.lowess(x, 3 * x + 1, 0.4), 3 * x + 1)
    y = 3 * x + 1
    y[10] += 50
    assert abs(text.lowess(x, y, 0.6)[10] - 31) < 1
    assert text.lowess(np.array([5.0]), np.array([2.0])).tolist() == [2.0]


def test_smoothed_timeline_fills_years(spark):
    t = spark.createDataFrame([("a", 2000, 2), ("a", 2003, 4), ("b", 1999, 1)], "token string, year int, docs long")
    got = sorted((r.token, r.year, r.docs) for r in text.smoothed_timeline(t).collect())
    assert got == [("a", 2000, 2), ("a", 2001, 0), ("a", 2002, 0), ("a", 2003, 4), ("b", 1999, 1)]


def test_overlapping_communities(spark):
    """Two triangles that share node 1: node 1 has two personas, the others one."""
    e = spark.createDataFrame([(1, 2, 1.0), (1, 3, 1.0), (2, 3, 1.0), (1, 4, 1.0), (1, 5, 1.0), (4, 5, 1.0)], "src int, dst int, similarity double")
    egos = {(r.ego, r.node): r.comp for r in graph.ego_components(e).collect()}
    assert (egos[1, 3], egos[1, 5], egos[2, 3]) == (2, 4, 1)
    got = {r.id: len(r.communities) for r in graph.overlapping_communities(e, 3).collect()}
    assert got["1"] == 2 and all(got[str(n)] == 1 for n in (2, 3, 4, 5))


def test_ego_components_reach_the_end_of_a_chain(spark):
    chain = [(n, n + 1, 1.0) for n in range(1, 12)] + [(0, n, 1.0) for n in range(1, 13)]
    comps = graph.ego_components(spark.createDataFrame(chain, "src int, dst int, similarity double")).filter("ego = 0")
    assert {r.comp for r in comps.collect()} == {1}


def test_topic_hierarchy(spark):
    rows = [(c, [x, y]) for c, x, y in ((0, 0.0, 0.0), (1, 0.0, 1.0), (2, 9.0, 0.0), (3, 9.0, 1.5))]
    paths = {r.comp: r.path for r in models.topic_hierarchy(spark.createDataFrame(rows, "comp int, embedding array<double>")).collect()}
    assert paths[0][0] == paths[1][0] != paths[2][0] == paths[3][0] and {len(p) for p in paths.values()} == {2}


def test_document_embeddings_copy_no_vector(spark):
    """Vectors meet a document's weights, not each of its tokens; documents without a token that has a vector are left out."""
    w = spark.createDataFrame([(1, "a", 0.5), (1, "b", 2.0), (1, "q", 9.0), (2, "b", 1.0), (3, "q", 1.0)], "id long, token string, tfidf double")
    v = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [3.0, 5.0])], "token string, vector array<float>")
    df = text.document_embeddings(w, v, 2)
    assert "Join" not in df._jdf.queryExecution().toString()
    assert {r.id: r.vector for r in df.collect()} == {1: [3.25, 5.5], 2: [1.5, 2.5]}


def test_document_embeddings(spark):
    w = spark.createDataFrame([(1, "a", 0.5), (1, "b", 2.0)], "id int, token string, tfidf double")
    v = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [1.0, 3.0])], "token string, vector array<double>")
    assert np.allclose(text.document_embeddings(w, v, 2).first().vector, [1.25, 3.0])


def test_nearest_in_blocks(spark):
    rng = np.random.default_rng(0)
    rows = spark.createDataFrame([(i, 0, rng.normal(size=4).tolist()) for i in range(120)], "id int, chunk int, embedding array<double>")
    asked = rows.filter("id % 3 = 0").select(rows.id.alias("query"), "embedding")
    key = lambda df: sorted((r.query, r.rank, r.id) for r in df.collect())
    assert key(vectors.nearest(rows, asked, 4)) == key(vectors.nearest(rows, asked, 4, block=7))


def test_backfill_stream(spark, tmp_path):
    path, source = str(tmp_path / "out"), str(tmp_path / "in")
    schema = "id long, abstract string, year int"

    def arrive(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        vectors.backfill_stream(spark.readStream.schema(schema).parquet(source), path, str(tmp_path / "log")).trigger(availableNow=True).start().awaitTermination()
        return sorted((r.id, r.chunk) for r in spark.read.parquet(path).collect())

    assert arrive([(1, "a b. c", 2000), (2, "", 2001)]) == [(1, 0), (2, 0)]
    assert arrive([(1, "a b. c", 2000), (3, "d", 2002)]) == [(1, 0), (2, 0), (3, 0)]


def test_impact(spark):
    mix = spark.createDataFrame([(1, 0, 0.5), (1, 1, 0.5), (2, 0, 1.0), (2, 1, 0.0)], "id int, topic int, p double")
    got = {r.id: r.diversity for r in impact.diversity(mix).collect()}
    assert got == {1: pytest.approx(-np.log(2)), 2: 0.0}
    rows = spark.range(5000)
    sizes = [r["count"] for r in impact.resampled(rows, 3).groupBy("sample").count().collect()]
    assert len(sizes) == 3 and all(3800 < n < 4200 for n in sizes)


def test_text_edges(spark):
    """With every cell probed the edges are those of a plain search."""
    rng = np.random.default_rng(1)
    v = {i: rng.normal(size=3) for i in range(30)}
    words = {i: rng.integers(0, 2, 4) * 1.0 for i in range(30)}
    unit = lambda a: a / (np.linalg.norm(a) or 1)
    cut = lambda c: c if c > 0.1 else 0.0
    vectors_ = spark.createDataFrame([(i, x.tolist()) for i, x in v.items()], "id int, embedding array<double>")
    weights = spark.createDataFrame([(i, str(t), float(x)) for i, w in words.items() for t, x in enumerate(unit(w)) if x], "id int, token string, tfidf double")
    known = spark.createDataFrame([(0, n) for n in range(1, 30)], "src int, dst int")
    want = {}
    for i in v:
        best = sorted((j for j in v if j != i), key=lambda j: (np.linalg.norm(unit(v[i]) - unit(v[j])), j))[:4]
        for j in best:
            x = 0.8 * cut(unit(v[i]) @ unit(v[j])) + 0.2 * cut(unit(words[i]) @ unit(words[j]))
            if x > 0 and 0 not in (i, j):
                want[min(i, j), max(i, j)] = pytest.approx(x)
    assert {(r.src, r.dst): r.textsimilarity for r in vectors.text_edges(vectors_, weights, known, 4, 3, 3).collect()} == want


def test_authors_keep_their_own_initials(spark):
    xml = "<A><Author><LastName>One</LastName></Author><Author ValidYN=\"Y\"><LastName>Two &amp; Co</LastName><Initials>T</Initials></Author><Author><CollectiveName>All</CollectiveName></Author></A>"
    assert spark.createDataFrame([(xml,)], "xml string").select(records.author_names(F.col("xml")).alias("a")).first().a == ["One", "Two & Co T"]


def test_lookup_refuses_other_keys(spark):
    pubs = spark.createDataFrame([(1, "A.", "10.1/x")], "id long, title string, doi string")
    assert [search.lookup(pubs, k, v).count() for k, v in (("id", "1;"), ("title", "a"), ("doi", "http://doi.org/10.1/x/"))] == [1, 1, 1]
    with pytest.raises(ValueError):
        search.lookup(pubs, "journal", "x")


def test_id_map_must_fit_its_index(spark, tmp_path):
    with pytest.raises(ValueError):
        tables.write_id_map(spark.range(3), str(tmp_path / "ids"), 4)


def test_dumped_years_stay_as_they_are(spark, tmp_path):
    path = str(tmp_path / "dump")
    tables.write_by_year(spark.createDataFrame([(1, 1999)], "id long, year int"), path)
    tables.write_by_year(spark.createDataFrame([(2, 1999), (3, 2000)], "id long, year int"), path)
    assert {(int(r[0]), r.year) for r in spark.read.option("sep", "\t").csv(path).collect()} == {(1, 1999), (3, 2000)}


def test_impact_indices_of_many_papers(spark):
    """A key with more papers than the square root of an int's range, and random totals against a plain loop."""
    spread = lambda x: (x * x * 7919 + x * 31) % 97 % (3 + x % 11)
    rows = [("a", i, spread(i)) for i in range(400)] + [("b", i, 0) for i in range(3)] + [("c", i, 900 - 400 * i) for i in range(5)] + [("d", i, None) for i in range(2)] + [("e", 0, 50), ("e", 1, 2), ("e", 2, None)]
    df = spark.createDataFrame(rows, "key string, id long, total long").unionByName(spark.range(70_000).select(F.lit("z").alias("key"), "id", F.lit(60_000).cast("long").alias("total")))
    got = {r["key"]: (r.h_index, r.g_index, r.mean) for r in reports.impact_indices(df, "key").collect()}
    assert got.pop("z") == (60_000, 60_000, 60_000.0)
    for name, (h, g, mean) in got.items():
        totals = sorted((t for k, _, t in rows if k == name), key=lambda t: (t is None, -(t or 0)))
        known, sums = [t for t in totals if t is not None], np.cumsum([t or 0 for t in totals])
        assert h == max([i + 1 for i, t in enumerate(totals) if t is not None and t >= i + 1], default=0)
        assert g == max([i + 1 for i, s in enumerate(sums) if s >= (i + 1) ** 2], default=0)
        assert mean == (pytest.approx(sum(known) / len(known)) if known else None)


def test_coupling_meets_on_pairs_of_references(spark):
    """References that very many papers cite make no pairs of those papers unless they share another one."""
    rng = np.random.default_rng(0)
    rows = sorted({(int(p), int(r)) for p in range(300) for r in np.append(rng.choice(150, rng.integers(0, 7), False), [900] * (p % 2))})
    df = spark.createDataFrame(rows + rows[:50], "id_out long, id_in long")
    refs = {p: {r for q, r in rows if q == p} for p, _ in rows}
    for least in (1, 2, 3):
        want = {(p, q, len(refs[p] & refs[q])) for p in refs for q in refs if p < q and len(refs[p] & refs[q]) >= least}
        assert set(map(tuple, citations.coupling(df, least).collect())) == want
    joined = citations.coupling(df, 2)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Inner" in joined and "first" in joined
    turned = df.select(F.col("id_in").alias("id_out"), F.col("id_out").alias("id_in"))  # few papers with long lists: the other way
    cited = {r: {p for p, q in rows if q == r} for _, r in rows}
    assert set(map(tuple, citations.coupling(turned, 2).collect())) == {(x, y, len(cited[x] & cited[y])) for x in cited for y in cited if x < y and len(cited[x] & cited[y]) >= 2}


def test_ego_components_of_a_very_long_chain(spark):
    """Ends however long a neighbourhood's chain is, and string ids stay strings."""
    chain = [(f"{n:04}", f"{n + 1:04}", 1.0) for n in range(1, 1100)] + [("0000", f"{n:04}", 1.0) for n in range(1, 1101)]
    comps = graph.ego_components(spark.createDataFrame(chain, "src string, dst string, similarity double")).filter("ego = '0000'").collect()
    assert len(comps) == 1100 and {r.comp for r in comps} == {"0001"}


def test_transition_weights_shuffle_no_triples(spark):
    e = spark.createDataFrame([(1, 2, 1.0), (1, 3, 2.0), (2, 3, 4.0), (3, 4, 8.0)], "src int, dst int, similarity double")
    found = graph.transition_weights(e, 5.0, 2.0)
    got = {(r.prev, r.node, r.next): r.probability for r in found.collect()}
    assert len(got) == 4 + 4 + 9 + 1 and got[4, 3, 2] == pytest.approx(2 / (1.0 + 2 + 1.6)) and got[1, 3, 2] == pytest.approx(4 / (0.4 + 4 + 4))
    assert "Window" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_nearest_equals_brute_force_where_vectors_repeat(spark, monkeypatch):
    """Blocks of few rows, copies and near copies, string queries, vectors of another length or with a null; ties to the smaller id."""
    monkeypatch.setattr(vectors, "ROWS_OF_A_BLOCK", 70)
    monkeypatch.setattr(vectors, "AT_A_TIME", 8)
    rng = np.random.default_rng(1)
    x = rng.standard_normal((300, 8))
    x[100:200] = x[0]
    x[200:220] = x[1] * (1 + 1e-8 * rng.random((20, 1)))
    rows = [(i // 2, i % 2, v.tolist()) for i, v in enumerate(x)] + [(900, 0, [1.0, 2.0]), (901, 0, None), (902, 0, [None] * 8)]
    asked = [(f"q{i}", x[i].tolist()) for i in range(0, 300, 3)] + [("short", [1.0, 2.0])]
    got = vectors.nearest(spark.createDataFrame(rows, "id long, chunk int, embedding array<double>"), spark.createDataFrame(asked, "query string, embedding array<double>"), 12, block=20)
    found = {}
    for r in got.orderBy("query", "rank").collect():
        found.setdefault(r["query"], []).append((r.id, r.chunk, r.distance, r.rank))
    assert [f[:2] for f in found.pop("short")] == [(900, 0)] and len(found) == 100
    for name, near in found.items():
        away = np.sqrt(((x - x[int(name[1:])]) ** 2).sum(axis=1))
        want = sorted(range(300), key=lambda i: (round(away[i], 9), i))[:12]
        assert [(i, c) for i, c, _, _ in near] == [(i // 2, i % 2) for i in want] and [r for *_, r in near] == list(range(1, 13))
        assert np.allclose([d for _, _, d, _ in near], away[want], atol=1e-12)
    tasks = vectors.nearest(spark.createDataFrame(rows[:300], "id long, chunk int, embedding array<double>"), spark.createDataFrame(asked[:5], "query string, embedding array<double>"), 3)
    assert "FlatMapCoGroupsInArrow" in tasks._jdf.queryExecution().optimizedPlan().toString()


def test_expansion_without_a_limit_takes_its_steps(spark):
    """However many seeds there are, their references and their neighbours come too."""
    edges = spark.createDataFrame([(n, 100 + n) for n in range(40)] + [(200 + n, 100 + n) for n in range(40)], "id_out long, id_in long")
    seeds, counts = spark.range(40), citations.citation_counts(edges)
    got = {r.id: r.step for r in citations.expand_steps(edges, seeds, counts, 2, None, most=None).collect()}
    assert got == {n: 0 for n in range(40)} | {100 + n: 1 for n in range(40)} | {200 + n: 2 for n in range(40)}
    assert citations.expand_steps(edges, seeds, counts, 2, 30).count() == 40
