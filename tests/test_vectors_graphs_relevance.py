"""Skip-gram in blocks, exact greedy sparsification, multilevel communities, neighbour descent, cover density: against plain versions."""

import random
import re
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from citelens.operators import graph, models, neighbours, search, skipgram, text, vectors
from citelens.operators.text import ENDINGS
from citelens.sources import tables

# Skip-gram


def test_pairs_of_a_window(spark):
    df = spark.createDataFrame([(["a", "b", "c", "a"],), (["c"],), ([],)], "tokens array<string>")
    got = {(r.centre, r.context): r.weight for r in skipgram.pairs(df, window=2).collect()}
    assert got == {("a", "b"): 3, ("b", "a"): 3, ("b", "c"): 2, ("c", "b"): 2, ("a", "c"): 3, ("c", "a"): 3}


def test_node_vectors_of_planted_communities(spark):
    """Neighbours are of one's own community; the same on one and many partitions; nodes without edges have ones, unreached ones zeros."""
    rng = random.Random(2)
    walks = []
    for _ in range(900):
        g = rng.randrange(4)
        walk = []
        for _ in range(20):
            g = rng.randrange(4) if rng.random() < 0.1 else g
            walk.append(100 * g + rng.randrange(20))
        walks.append((walk,))
    df = spark.createDataFrame(walks, "walk array<long>")
    ids = sorted({i for (w,) in walks for i in w})
    nodes = spark.createDataFrame([(i,) for i in [*ids, 900, 901]], "id long")
    degrees = spark.createDataFrame([(i, 2) for i in [*ids, 901]], "node long, degree int")
    runs = [{r.id: r.vector for r in models.node_vectors(part, nodes, degrees, dim=16).collect()} for part in (df.coalesce(1), df.repartition(5))]
    assert runs[0] == runs[1] and runs[0][900] == [1.0] * 16 and runs[0][901] == [0.0] * 16
    x = np.array([runs[0][i] for i in ids])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T
    np.fill_diagonal(near, -9)
    top = np.argsort(-near, axis=1)[:, :5]
    assert np.mean([[ids[j] // 100 == ids[i] // 100 for j in top[i]] for i in range(len(ids))]) > 0.8


def test_skipgram_of_nothing(spark):
    assert skipgram.vectors(spark.createDataFrame([], "tokens array<string>")).count() == 0
    assert [len(r.vector) for r in skipgram.vectors(spark.createDataFrame([(["x"],)], "tokens array<string>"), dim=8).collect()] == [8]


def test_skipgram_reads_sequences_once(spark):
    """Counts of tokens and pairs come from one pass, in chunks that are sorted (many tokens) or tallied (few)."""
    seen = spark.sparkContext.accumulator(0)

    def counted(x):
        seen.add(1)
        return x

    rng = random.Random(3)
    rows = [([f"t{rng.randrange(most)}" for _ in range(12)],) for most in (5, 10_000) for _ in range(40)]
    read = spark.createDataFrame(rows, "tokens array<string>").select(F.udf(counted, "array<string>")("tokens").alias("tokens"))
    got = skipgram.vectors(read, dim=4, passes=1).collect()
    assert {r.token for r in got} == {w for (r,) in rows for w in r} and seen.value == len(rows)


def test_skipgram_of_known_tokens(spark):
    """Others drop out before windows, and then sequences that are too short."""
    rng = random.Random(4)
    rows = [[rng.choice("abcdefxyz") for _ in range(rng.randrange(1, 12))] for _ in range(60)] + [["x"], []]
    kept = [r for r in ([w for w in r if w in "abcdef"] for r in rows) if len(r) >= 5]
    frame = lambda r: spark.createDataFrame([(x,) for x in r], "tokens array<string>")
    got = {r.token: r.vector for r in skipgram.vectors(frame(rows), dim=8, known=list("fedcbaq"), least=5).collect()}
    assert got == {r.token: r.vector for r in skipgram.vectors(frame(kept), dim=8).collect()} and set(got) == set("abcdef")


def test_summed_runs():
    rows, first = np.arange(120, dtype=np.float32).reshape(40, 3), np.array([0, 1, 4, 12, 21])
    assert np.array_equal(skipgram._summed_runs(rows, first), np.add.reduceat(rows, first, axis=0))


# Greedy sparsification


def plain_greedy(edges, k):
    near, kept = {}, {}

    def keep(a, b):
        kept.setdefault(a, {})[b] = kept.setdefault(b, {})[a] = near[a][b]

    for a, b, w in edges:
        near.setdefault(a, {})[b] = near.setdefault(b, {})[a] = w
    by_weight = {n: sorted(near[n], key=lambda x: (near[n][x], x), reverse=True) for n in near}
    for n in sorted(near, key=lambda x: (len(near[x]), x), reverse=True):
        for x in by_weight[n][:k]:
            if x not in kept.get(n, {}) and len(kept.get(x, {})) < k:
                keep(n, x)
    for n in near:
        if n not in kept:
            keep(n, by_weight[n][0])
    return {(a, b, w) for a in kept for b, w in kept[a].items() if a < b}


@pytest.mark.parametrize("seed", range(8))
def test_greedy_sparsification_is_the_sequence(spark, seed):
    """Random graphs with ties, a complete one and a star whose hub all want."""
    rng = random.Random(seed)
    if seed == 0:
        edges, k = [(i, j, float(i + j)) for i in range(10) for j in range(i + 1, 10)], 3
    elif seed == 1:
        edges, k = [(0, j, 5.0) for j in range(1, 200)] + [(j, j + 1, 1.0) for j in range(1, 199)], 2
    else:
        n = rng.randint(20, 90)
        found = {tuple(sorted(rng.sample(range(n), 2))) for _ in range(rng.randint(n, n * n // 3))}
        edges, k = [(a, b, float(rng.choice((1, 2, rng.randrange(50))))) for a, b in found], rng.randint(1, 6)
    got = {tuple(r) for r in graph.greedy_sparsify(spark.createDataFrame(edges, "src long, dst long, similarity double"), k).collect()}
    assert got == plain_greedy(edges, k) and (seed or len(got) == 12)


# Communities


def test_levels_of_planted_communities(spark):
    """Modularity never falls, is that of the labels, and reaches the planted groups'; resolution moves the number of groups."""
    rng = random.Random(4)
    groups, size = 8, 20
    edges = [(i, j, 1.0) for i in range(groups * size) for j in range(i + 1, groups * size) if rng.random() < (0.4 if i // size == j // size else 0.01)]
    df = spark.createDataFrame(edges, "src long, dst long, similarity double")
    levels = graph.community_levels(df)
    qualities = [q for _, q in levels]
    assert qualities == sorted(qualities)
    assert graph.modularity(df, levels[-1][0]).first()[0] == pytest.approx(qualities[-1])
    planted = spark.createDataFrame([(i, i // size) for i in range(groups * size)], "id long, community long")
    assert qualities[-1] >= graph.modularity(df, planted).first()[0] - 1e-9
    labels = {r.id: r.community for r in levels[-1][0].collect()}
    most = [Counter(labels[i] for i in range(g * size, (g + 1) * size)).most_common(1)[0] for g in range(groups)]
    assert len(labels) == groups * size and len({c for c, _ in most}) == groups and all(n >= 18 for _, n in most)  # the best may differ in a node
    assert graph.communities(df, resolution=0.2).select("community").distinct().count() < groups


# Neighbour descent


@pytest.mark.parametrize("clustered", [False, True])
def test_descent_finds_the_neighbours(spark, clustered):
    rng = np.random.default_rng(1)
    n = 3000
    x = rng.standard_normal((30, 24))[rng.integers(0, 30, n)] + 0.5 * rng.standard_normal((n, 24)) if clustered else rng.standard_normal((n, 24))
    found = neighbours.descent(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, embedding array<double>"), 100, width=500).toPandas()
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    away = -unit @ unit.T
    np.fill_diagonal(away, 9)
    true = np.argsort(away, axis=1)[:, :100]
    lists = found.groupby("node").other.apply(set)
    assert len(found) == 100 * n and np.mean([len(lists[i] & set(true[i])) for i in range(n)]) >= 95


def test_descent_of_few_and_equal_rows(spark):
    none = spark.createDataFrame([], "id long, embedding array<double>")
    assert neighbours.descent(none).count() == 0
    same = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(40)], "id long, embedding array<double>")
    got = neighbours.descent(same, 5).collect()
    assert len(got) == 200 and max(r.distance for r in got) < 1e-3 and all(r.node != r.other for r in got)


# Encoder


def test_hashed_words_are_the_plain_ones(spark):
    texts = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for r in vectors.encode_texts(texts, text="text").select("text", "embedding").collect():
        v = np.zeros(64)
        for w in filter(None, re.split(r"[ \t\n\x0b\f\r]+", (r.text or "").lower())):
            h = zlib.crc32(w.encode())
            v[h % 64] += 1 if h >= 1 << 31 else -1
        assert np.allclose(v / (np.linalg.norm(v) or 1), r.embedding, atol=1e-6)


# Cover density


def plain_stem(word):
    return next((word[: len(word) - len(e)] + o for e, o in ENDINGS if word.endswith(e) and len(word) >= len(e) + 3), word)


def plain_relevance(title, abstract, alternatives):
    """By trying every stretch of words."""
    words = [(w, 1.0) for w in re.findall("[a-z]+", title.lower())] + [(w, 0.4) for w in re.findall("[a-z]+", abstract.lower())]
    terms = {plain_stem(w) for a in alternatives for w in a}
    stems = [plain_stem(w) for w, _ in words]
    holds = lambda p, q: any({plain_stem(w) for w in a} <= set(stems[p : q + 1]) for a in alternatives)
    least = [(p, q) for p in range(len(words)) for q in range(p, len(words)) if holds(p, q) and not (q > p and (holds(p + 1, q) or holds(p, q - 1)))]
    total, middles = 0.0, [(p + q) / 2 for p, q in least]
    for p, q in least:
        hits = [words[i][1] for i in range(p, q + 1) if stems[i] in terms]
        total += len(hits) / sum(1 / w for w in hits) / (1 + q - p + 1 - len(hits))
    gaps = [1 / (b - a) for a, b in zip(middles, middles[1:])]
    return total / len(words) / (len(least) / sum(gaps) if gaps else 1.0) if least else None


@pytest.mark.parametrize(("query", "alternatives"), [("gene", [["gene"]]), ("gene therapy", [["gene", "therapy"]]), ('"gene therapy" trial, placebo', [["gene", "therapy", "trial"], ["placebo"]]), ("cell cells", [["cell"]])])
def test_relevance_by_covers(spark, query, alternatives):
    rng = random.Random(7)
    pool = ["gene", "genes", "therapy", "trial", "trials", "placebo", "cell", "cells", "other", "words", "between", "and"]
    texts = [(i, " ".join(rng.choices(pool, k=rng.randint(0, 6))), " ".join(rng.choices(pool, k=rng.randint(0, 25)))) for i in range(60)]
    got = {r.id: r.relevance for r in search.relevance(spark.createDataFrame(texts, "id long, title string, abstract string"), query).collect()}
    expected = {i: plain_relevance(t, a, alternatives) for i, t, a in texts}
    assert got == pytest.approx({i: v for i, v in expected.items() if v is not None}, abs=2e-9) and len(got) > 10


def test_relevance_prefers_near_words_and_titles(spark):
    texts = [(1, "gene therapy", "some words of a text here"), (2, "some words", "gene therapy of a text here"), (3, "some words", "gene of a text here therapy"), (4, "", ""), (5, None, "therapy")]
    df = spark.createDataFrame(texts, "id long, title string, abstract string")
    assert [r.id for r in search.relevance(df, "gene therapy").orderBy(F.desc("relevance")).collect()] == [1, 2, 3]


def test_edges_by_descent_are_those_of_the_exact_search(spark):
    """Also where many vectors are equal, so that ties decide."""
    rng = np.random.default_rng(3)
    x = rng.standard_normal((200, 16))[rng.integers(0, 200, 1500)] + np.where(rng.random(1500) < 0.5, 0.0, 0.3)[:, None] * rng.standard_normal((1500, 16))
    rows = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "id long, embedding array<double>")
    weights = spark.createDataFrame([(i, "t", 1.0) for i in range(3)], "id long, token string, tfidf double")
    none = spark.createDataFrame([], "src long, dst long")
    exact, found = ({(r.src, r.dst) for r in vectors.text_edges(rows, weights, none, 10, by_descent=d).collect()} for d in (False, True))
    assert found == exact


def test_topics_read_documents_once(spark):
    """What the documents are made from is not made again in every iteration."""
    made = F.udf(lambda i: [f"w{i % 3}", "all"], "array<string>")
    documents = spark.range(30).select("id", made("id").alias("tokens"))
    mixed, _ = models.topics(documents, k=2)
    assert "PythonUDF" not in mixed._jdf.queryExecution().toString() and mixed.count() == 30


def test_hybrid_similarity_moves_papers_not_tokens_of_pairs(spark, monkeypatch):
    """In many blocks, against the plain rule; papers without a vector, with null or NaN in it, of another width or with two of them."""
    monkeypatch.setattr(vectors, "PAPERS_OF_A_BLOCK", 7)
    monkeypatch.setattr(vectors, "TOKENS_AT_ONCE", 5)
    rng = np.random.default_rng(5)
    v = {i: [float(x) for x in rng.normal(size=3)] for i in range(40)} | {1: [1.0, None, 2.0], 2: [1.0, float("nan"), 2.0], 3: [1.0, 2.0], 4: [0.0, 0.0, 0.0], 5: None, 6: []}
    words = {i: {str(t): float(rng.random()) for t in range(8) if rng.random() < 0.5} for i in range(3, 40)} | {50: {"0": 1.0}, 51: {"0": 1.0}}
    twice = [(7, [1.0, 0.0, 0.0]), (7, [0.0, 1.0, 0.0])]
    rows = spark.createDataFrame([(i, x) for i, x in v.items() if i != 7] + twice, "id long, embedding array<double>")
    weights = spark.createDataFrame([(i, t, x) for i, w in words.items() for t, x in w.items()] + [(8, None, 1.0)], "id long, token string, tfidf double")
    pairs = [(i, j) for i in (*range(40), 50, 51, 60) for j in (*range(40), 50, 51, 60) if i <= j and (i + j) % 3 != 1]
    asked = spark.createDataFrame([*pairs, *pairs[:9], (None, 3)], "src long, dst long")
    unit = lambda a: [x / n for x in a] if (n := np.sqrt(sum(x * x for x in a))) else None
    share = lambda x: 0.0 if x <= 0.1 else x
    all_vectors = lambda i: [x for k, x in twice if k == 7] if i == 7 else [v.get(i)]
    want = [(None, 3, 0.0)]
    for i, j in pairs:
        t = sum(x * words[j][token] for token, x in words.get(i, {}).items() if token in words.get(j, {}))
        for a in all_vectors(i):
            for b in all_vectors(j):
                sound = a and b and len(a) == len(b) and None not in (*a, *b) and (x := unit(a)) and (y := unit(b))
                want.append((i, j, 0.8 * share(sum(p * q for p, q in zip(x, y)) if sound else 0.0) + 0.2 * share(t)))
    found = vectors.hybrid_similarity(asked, rows, weights)
    got = sorted(((r.src, r.dst, round(r.textsimilarity, 9)) for r in found.collect()), key=str)
    assert [str(r) for r in got] == [str(r) for r in sorted(((i, j, round(float(x), 9)) for i, j, x in want), key=str)]
    assert "FlatMapCoGroupsInArrow" in found._jdf.queryExecution().toString()


def test_written_states_leave_no_shuffle_and_can_go(spark):
    folders = list(spark._jsc.sc().env().blockManager().diskBlockManager().localDirsString())
    shuffles = lambda: {f for top in folders for f in Path(top).rglob("shuffle_*.data")}
    before, rows = shuffles(), spark.range(1000).repartition(7, "id").groupBy((F.col("id") % 10).alias("k")).count()
    state = tables.stored(rows)
    assert not shuffles() - before and tables.cut(rows).count() == state.count() == 10
    tables.unstored(state)
    with pytest.raises(Exception, match="FILE_NOT_EXIST|does not exist"):
        state.collect()


def test_token_weights_of_some_documents_count_all(spark):
    rows = spark.createDataFrame([(1, "a", 2), (1, "b", 1), (2, "a", 1), (3, "c", 4)], "id long, token string, n long")
    some = {(r.id, r.token): r.tfidf for r in text.tfidf(rows, 3, of=rows.filter("id < 3")).collect()}
    assert some == {(r.id, r.token): r.tfidf for r in text.tfidf(rows, 3).collect() if r.id < 3} and len(some) == 3


def test_edges_keep_their_number_where_ends_have_no_text(spark):
    """Repeated edges and columns stay, edges without an end do not; ids may be narrower than those of the vectors."""
    edges = spark.createDataFrame([(1, 2, "x", 9.0), (1, 2, "y", 9.0), (2, 8, "z", 9.0), (None, 2, "n", 9.0)], "src int, dst int, kind string, textsimilarity double")
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 1.0])], "id long, embedding array<double>")
    found = vectors.refreshed(edges, rows, spark.createDataFrame([], "id long, token string, tfidf double"))
    assert found.columns == ["src", "dst", "kind", "textsimilarity"]
    assert sorted((r.src, r.dst, r.kind, round(r.textsimilarity, 9)) for r in found.collect()) == [(1, 2, "x", round(0.8 / 2**0.5, 9)), (1, 2, "y", round(0.8 / 2**0.5, 9)), (2, 8, "z", 0.0)]
