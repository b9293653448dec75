"""The ten operators: against plain versions, and on null, empty, repeated and hostile rows."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from citelens.llm import anisotropic_ann, language_id, license_scan, line_dedup, lsh_forest, mixing, mpeg_audio, packing, queries, sharding, toxicity

SF = "/root/testdata/sf0.001"
CLASHES = ("start", "id", "taken", "shard", "slot", "n_lines", "severity", "row", "key", "h", "hash", "size", "spans", "row_hash", "mix_row", "page_key", "sequence_id", "label", "pos", "tree", "node", "vec")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} long" for c in CLASHES)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeats and clashing column names."""
    long = " ".join(f"w{i % 977}" for i in range(30_000))
    rows = [(1, None, None, None), (2, "", "en", "a"), (3, long, "en", "a"), (4, long, "en", None), (4, long, "en", None), (None, "x y z", "de", "b"), (6, " \n\t ", None, "b"), (7, "\u0085 \U0001f600", "en", "b")]
    return spark.createDataFrame([(i, t, l, s, None, *range(len(CLASHES))) for i, t, l, s in rows], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def every(df):
    return (lambda d: line_dedup.drop_boilerplate_lines(d, host="source"), lambda d: mixing.mix_plan(d)[0], mixing.mixed_documents, lambda d: toxicity.score_toxicity(d, toxicity.train_toxicity(d, d.select("doc_id", F.when(F.col("doc_id") > 3, 1).otherwise(0).alias("toxic")))),
            lsh_forest.near_duplicates, lambda d: sharding.shuffle_to_shards(d, ["doc_id", "text"], 3), packing.pack_documents,
            lambda d: language_id.predict_language(d, language_id.reference_texts(d, "doc_id", "text", "lang", 1000)), lambda d: license_scan.license_spans(d, ["doc_id", "text"]), lambda d: d.select(mpeg_audio.encode_audio(F.col("text").cast("binary"))))


@pytest.mark.parametrize("n", range(10))
def test_odd_and_empty_rows(odd, empty, n):
    operator = every(odd)[n]
    operator(odd).toPandas()
    assert len(operator(empty).toPandas()) == 0


def by_id(df):
    out = defaultdict(list)
    for r in df.collect():
        out[r.doc_id].append(r)
    return out


def test_odd_rows_have_their_defined_results(odd):
    """Null text, empty text, a long text, repeats and a null id, each as the operators' docstrings say."""
    rows = odd.count()
    lines = by_id(line_dedup.drop_boilerplate_lines(odd, host="source"))
    assert sum(map(len, lines.values())) == rows and lines[1][0].text is None and lines[1][0].n_lines == 0 and lines[2][0].text == ""
    plan = by_id(mixing.mix_plan(odd)[0].withColumnRenamed("id", "doc_id"))
    assert sum(map(len, plan.values())) == rows and [r["size"] for r in plan[1]] == [0] and len(plan[4]) == 2 and plan[None][0]["size"] == 3
    groups = by_id(lsh_forest.near_duplicates(odd))
    assert all(groups[i][0].n_shingles == 0 and groups[i][0].kept and groups[i][0].component_id == i for i in (1, 2, 6))
    assert {r.component_id for r in groups[3] + groups[4]} == {3} and len(groups[4]) == 2 and groups[None][0].component_id is None and groups[None][0].kept
    shards = sharding.shuffle_to_shards(odd, ["doc_id", "text"], 3).collect()
    assert len(shards) == rows and max(Counter(r.shard for r in shards).values()) == 3
    packed = by_id(packing.pack_documents(odd))
    assert packed[1][0].length == packed[2][0].length == 1 and len(packed[4]) % 2 == 0 and sum(r.length for r in packed[4]) == 2 * sum(r.length for r in packed[3])
    languages = by_id(language_id.predict_language(odd, {"en": "some words", "de": "einige"}))
    assert all((languages[i][0].lang_pred, languages[i][0].score) == ("und", 0.0) for i in (1, 2, 6, 7)) and languages[4][0] == languages[4][1]
    assert by_id(language_id.predict_language(odd, {}))[3][0].lang_pred == "und"
    assert license_scan.license_spans(odd, ["doc_id", "text"]).count() == 0
    media = odd.select("doc_id", mpeg_audio.decode_audio(mpeg_audio.encode_audio(F.col("text").cast("binary"))).alias("a"))
    assert bytes(by_id(media)[1][0].a.payload) == b"" and by_id(media)[1][0].a.n_frames == 0 and len(by_id(media)[3][0].a.payload) == len(by_id(odd)[3][0].text)


def test_mix_keeps_rows_without_an_id(spark):
    """Every source is taken as it is (targets meet sizes), so no row may go, with or without an id."""
    rows = [(None, f"null {i} word", "a") for i in range(40)] + [(i, f"some {i} word", "a") for i in range(40)]
    mixed = mixing.mixed_documents(spark.createDataFrame(rows, "doc_id long, text string, source string"), n_shards=1)
    assert sorted(r.text for r in mixed.collect()) == sorted(r[1] for r in rows)


def test_toxicity_of_one_grade_and_of_none(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    for labels, expected in (([(1, 1), (2, 1)], 1.0), ([(1, None)], 0.0), ([], 0.0)):
        model = toxicity.train_toxicity(df, spark.createDataFrame(labels, "doc_id long, toxic int"))
        assert [r.expected_severity for r in toxicity.score_toxicity(df, model).collect()] == [expected] * 2


def test_several_labels_of_an_id_count_as_the_highest(spark):
    df = spark.createDataFrame([(i, "vile " * (i % 2) + f"w{i % 7} plain words") for i in range(60)], "doc_id long, text string")
    once = [(i, i % 2) for i in range(60)]
    models = [toxicity.train_toxicity(df, spark.createDataFrame(labels, "doc_id long, toxic int")) for labels in (once, once + [(i, 0) for i in range(60)])]
    assert models[0].weights.tolist() == models[1].weights.tolist() and models[0].thresholds.tolist() == models[1].thresholds.tolist()
    got = {r.doc_id: r.expected_severity for r in toxicity.score_toxicity(df, models[1]).collect()}
    assert min(got[i] for i in range(1, 60, 2)) > 0.5 > max(got[i] for i in range(0, 60, 2))


def test_scores_are_those_of_a_plain_model(spark, docs):
    """Expected severity recomputed word by word with the fitted weights, and the fit against a plain gradient of the likelihood."""
    rng = np.random.default_rng(1)
    texts = [" ".join(f"g{g}x{rng.integers(0, 6)}" if rng.random() < 0.4 else f"n{rng.integers(0, 40)}" for _ in range(12)) for g in rng.integers(0, 3, 400)]
    grades = [max(int(w[1]) for w in t.split() if w[0] == "g") if "g" in t else 0 for t in texts]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model = toxicity.train_toxicity(df, spark.createDataFrame(list(enumerate(grades)), "doc_id long, toxic int"))
    known = dict(zip(model.columns.tolist(), model.weights.tolist()))
    for r in toxicity.score_toxicity(df, model).collect():
        x = sum(known.get(c, 0.0) * min(n, toxicity.MOST) for c, n in toxicity.feature_counts(texts[r.doc_id]).items())
        below = [1 / (1 + np.exp(x - t)) for t in model.thresholds]
        p = np.diff([0.0, *below, 1.0])
        assert abs(r.expected_severity - sum(g * q for g, q in zip(model.grades, p))) < 1e-9 and r.grade == model.grades[int(np.argmax(p))]

    # Thresholds are not penalised, so at the optimum each one's gradient of the weighted likelihood is near zero.
    counts = Counter(grades)
    weight = np.array([counts[g] ** 0.5 / counts[g] for g in grades])
    weight /= weight.sum()
    score = np.array([sum(known.get(c, 0.0) * min(n, toxicity.MOST) for c, n in toxicity.feature_counts(t).items()) for t in texts])

    def loss(thresholds):
        edges = np.concatenate([[-60.0], thresholds, [60.0]])
        s = lambda v: 1 / (1 + np.exp(-v))
        y = np.array([model.grades.index(g) for g in grades])
        return -(weight * np.log(np.maximum(s(edges[y + 1] - score) - s(edges[y] - score), 1e-12))).sum()

    for k in range(len(model.thresholds)):
        step = np.eye(len(model.thresholds))[k] * 1e-4
        assert abs(loss(model.thresholds + step) - loss(model.thresholds - step)) / 2e-4 < 0.02


def test_search_without_usable_rows(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<double>")
    assert anisotropic_ann.search(none, none).count() == 0
    two = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0]), (50, [0.0, 0.0])], "vec_id long, embedding array<double>")
    got = anisotropic_ann.search(two, two.filter("vec_id % 50 = 0")).collect()
    assert [(r.query_id, r["rank"], r.vec_id) for r in got] == [(0, 1, 1)] and abs(got[0].score - 0.5**0.5) < 1e-12


def test_line_dedup_rule(spark):
    pages = spark.createDataFrame([(i, f"line {i}\n menu \n", "h") for i in range(10)] + [(99, "menu", "other"), (100, "a\nb", "two"), (101, "b\nc", "two")], "doc_id long, text string, source string")
    got = {r.doc_id: (r.text, r.n_dropped) for r in line_dedup.drop_boilerplate_lines(pages, host="source").collect()}
    assert got[3] == ("line 3\n", 1) and got[99] == ("menu", 0)
    assert got[100] == ("a", 1) and got[101] == ("c", 1)  # a host of two pages: the repeated line goes, lines of one page stay


def test_pipeline_leaves_one_of_a_large_group_of_copies(spark):
    """Copies that fill a third of a source, through the four stages before packing, without a toxic document among them."""
    import corpus_pipeline

    copy = " ".join(f"c{i}" for i in range(40)) + "\n" + " ".join(f"d{i}" for i in range(40))
    texts = [copy] * 30 + [" ".join(f"t{n}w{i}" for i in range(80)) + "\nmenu" for n in range(60)]
    docs = spark.createDataFrame([(i, t, "en", "a") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string")
    for name, stage in corpus_pipeline.STAGES[1:-1]:
        docs = stage(spark, docs, SF).cache()
    left = {r.doc_id: r.text for r in docs.collect()}
    assert left[0] == copy and not set(left) & set(range(1, 30)) and "menu" not in left[40]
    assert {r.doc_id for r in corpus_pipeline.pack(spark, docs, SF).collect()} >= {0}


def plain_quotients(weights, seats):
    won = Counter()
    for _ in range(seats):
        won[max(sorted(weights), key=lambda k: weights[k] / (2 * won[k] + 1))] += 1
    return dict(won)


def test_sainte_lague_is_the_highest_quotients(spark):
    rng = random.Random(4)
    for seats in (1, 7, 100):
        weights = {f"s{i:02}": rng.choice((1.0, 2.0, 3.0, rng.random() * 10 ** rng.randint(0, 2))) for i in range(12)}
        got = mixing.sainte_lague(spark.createDataFrame(list(weights.items()), "source string, target double"), seats)
        assert {r.source: r.seats for r in got.collect() if r.seats} == plain_quotients(weights, seats)


def test_capped_seats_go_to_the_next_quotients(spark):
    weights, caps, seats = {"a": 50.0, "b": 30.0, "c": 15.0, "d": 5.0}, {"a": 9, "b": 40, "c": 7, "d": 60}, 60
    won = Counter()
    for _ in range(seats):
        won[max((k for k in sorted(weights) if won[k] < caps[k]), key=lambda k: weights[k] / (2 * won[k] + 1))] += 1
    got = mixing.sainte_lague(spark.createDataFrame([(k, w, caps[k]) for k, w in weights.items()], "source string, target double, most long"), seats, cap="most")
    assert {r.source: r.seats for r in got.collect()} == dict(won)


def plain_mix(rows, n_shards, block_words=32):
    """Words of each document that each mix shard takes, block by block: rows are (start, size, source), plan the quotas."""
    stream = defaultdict(dict)
    for i, (source, start, size, first, blocks, quota) in rows.items():
        for w in range(start, start + size):
            stream[source][w] = i
    taken = defaultdict(Counter)
    plans = {r[0]: r[3:] for r in rows.values()}
    for source, (first, blocks, quota) in plans.items():
        place = first
        for shard, n in enumerate(quota):
            for _ in range(n):
                for w in range(place * block_words, (place + 1) * block_words):
                    if w in stream[source]:
                        taken[stream[source][w]][shard] += 1
                place = (place + 1) % blocks
    return taken


def test_mix_against_a_plain_one(spark, docs):
    """The query on 300 documents: sizes, targets, quotas, and every block dealt one by one around its source's ring."""
    import re
    few = docs.orderBy("doc_id").limit(300).unionByName(docs.orderBy("doc_id").limit(3)).cache()
    plan, quotas = mixing.mix_plan(few)
    rows, quota = plan.collect(), defaultdict(lambda: [0] * 16)
    for r in quotas.collect():
        quota[r.source][r.shard] = r.quota
    texts = Counter((r.doc_id, len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")), r.source) for r in few.collect())
    assert Counter((r.id, r["size"], r.source) for r in rows) == texts
    sizes = Counter()
    for r in rows:
        sizes[r.source] += r["size"]
    assert all(r.source_size == sizes[r.source] for r in rows)
    targets = {r.source: r.target for r in rows}
    seats = -(-sum(sizes.values()) // 32)
    for k in range(1, 17):  # the first k shards together are an allocation by highest quotients
        won = Counter()
        for _ in range(seats * k // 16):
            won[max((s for s in sorted(targets) if won[s] < 3 * -(-sizes[s] // 32)), key=lambda s: targets[s] / (2 * won[s] + 1))] += 1
        assert {s: sum(quota[s][:k]) for s in targets} == {s: won[s] for s in targets}
    expected = plain_mix({(r.id, r.start): (r.source, r.start, r["size"], r.first_block, r.blocks, quota[r.source]) for r in rows}, 16)
    for r in rows:
        assert {p.shard: p.words for p in r.shard_taken} == dict(expected[r.id, r.start]) and r.taken == sum(expected[r.id, r.start].values())


def test_mix_keeps_documents_whole_where_no_shard_is_kept(spark):
    """61 documents of one source, each due once: whole without the shard, in parts that add up with it."""
    texts = {i: " ".join(f"d{i}w{k}" for k in range(20 + i)) for i in range(61)}
    docs = spark.createDataFrame([(i, t, "a") for i, t in texts.items()], "doc_id long, text string, source string")
    assert sorted((r.doc_id, r.text) for r in mixing.mixed_documents(docs).collect()) == sorted(texts.items())
    parts = defaultdict(list)
    for r in mixing.mixed_documents(docs, shard_col="shard").collect():
        parts[r.doc_id] += r.text.split()
    assert {i: sorted(w) for i, w in parts.items()} == {i: sorted(t.split()) for i, t in texts.items()}


def test_mix_is_near_its_targets_and_repeats(spark, docs):
    plan, quotas = mixing.mix_plan(docs)
    rows = plan.toPandas()
    again = mixing.mix_plan(docs.repartition(5))[0].toPandas()
    assert sorted(zip(rows.id, rows.taken)) == sorted(zip(again.id, again.taken))
    assert (rows.taken <= 3 * rows["size"]).all()
    sums = rows.groupby("source").agg(target=("target", "first"), taken=("taken", "sum"))
    assert ((sums.taken - sums.target).abs() <= 128).all()
    assert abs(sums.target.sum() - rows["size"].sum()) < 1e-6
    assert quotas.filter("quota < 0").count() == 0
    mixed = mixing.mixed_documents(docs, shard_col="mix").select("doc_id", "mix", F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).alias("n")).toPandas()
    assert mixed.groupby("doc_id").n.sum().to_dict() == {i: t for i, t in zip(rows.id, rows.taken) if t}
    due = Counter()
    for i, parts in zip(rows.id, rows.shard_taken):
        due.update({(i, p["shard"]): p["words"] for p in parts})
    assert mixed.groupby(["doc_id", "mix"]).n.sum().to_dict() == dict(due)
    held = mixed.merge(rows[["id", "source"]], left_on="doc_id", right_on="id").groupby(["source", "mix"]).n.sum()
    for r in quotas.collect():  # a block may be short only at the stream's end
        assert 32 * r.quota - 32 * 3 <= held.get((r.source, r.shard), 0) <= 32 * r.quota


def test_targets_are_capped_and_reshared(spark):
    got = {r.source: r.target for r in mixing.source_targets(spark.createDataFrame([("a", 100), ("b", 10), ("c", 10)], "source string, source_size long")).collect()}
    assert got == pytest.approx({"a": 60.0, "b": 30.0, "c": 30.0})


def test_ordinal_grades():
    rng = np.random.default_rng(0)
    rows, grades = [], []
    for _ in range(900):
        g = int(rng.integers(0, 4))
        rows.append({1: g + 1} | {int(c): 1 for c in rng.integers(10, 200, 20)})
        grades.append(g)
    model = toxicity.fit_ordinal([np.array(list(r)) for r in rows[:600]], [np.array(list(r.values())) for r in rows[:600]], np.array(grades[:600]), np.ones(600), [0, 1, 2, 3])
    known = dict(zip(model.columns.tolist(), model.weights.tolist()))
    p = model.probabilities(np.array([sum(known.get(c, 0) * n for c, n in r.items()) for r in rows[600:]]))
    assert (np.diff(model.thresholds) > 0).all() and np.allclose(p.sum(axis=1), 1)
    assert np.mean(p.argmax(axis=1) == np.array(grades[600:])) > 0.8


def test_near_duplicates_against_all_pairs(spark):
    rng = random.Random(1)
    texts = []
    for _ in range(40):
        base = [f"w{rng.randint(0, 5000)}" for _ in range(rng.randint(1, 120))]
        for _ in range(rng.randint(1, 8)):
            copy = list(base)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(len(copy))] = f"e{rng.randint(0, 10**6)}"
            texts.append(" ".join(copy))
    for width, block in ((4, 4_000_000), (5, 300)):
        sets = [set(lsh_forest.shingle_set(t, width).tolist()) for t in texts]
        root = list(range(len(texts)))
        for _ in range(len(texts)):
            changed = False
            for i in range(len(texts)):
                for j in range(i):
                    if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]) and root[i] != root[j]:
                        root[i] = root[j] = min(root[i], root[j])
                        changed = True
            if not changed:
                break
        df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        got = {r.doc_id: r.component_id for r in lsh_forest.near_duplicates(df, width=width, block=block).collect()}
        assert got == dict(enumerate(root))


def test_near_duplicates_in_a_crowd(spark):
    """Crowds that share a passage without being similar, each with one linked pair.  A reach of 1 stands for crowds eight times the size."""
    texts, crowd, own = [], 2500, 48
    for c in range(3):
        passage = " ".join(f"c{c}p{i}" for i in range(64))
        for n in (6, *[own] * crowd, 6):
            texts.append(f"{passage} " + " ".join(f"o{len(texts)}x{i}" for i in range(n)))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)
    got = {r.doc_id: r.component_id for r in lsh_forest.near_duplicates(df, reach=1).collect()}
    sizes = np.array([len(lsh_forest.shingle_set(t, 5)) for t in texts])
    expected = np.arange(len(texts))
    for c in range(0, len(texts), crowd + 2):  # any two of a crowd share the passage's 60 shingles and no others
        n = sizes[c : c + crowd + 2]
        i, j = np.nonzero(100 * 60 >= 80 * (n[:, None] + n[None, :] - 60))
        np.minimum.at(expected, c + i, c + j)
    assert (expected != np.arange(len(texts))).sum() == 3 and got == dict(enumerate(expected.tolist()))


def test_a_large_group_of_near_copies_is_one_component(spark):
    """5000 near copies of one text over many blocks, a second group that is too far, and texts that stand alone."""
    rng = random.Random(8)
    base = [f"b{i}" for i in range(120)]
    far = [f"f{i}" if i % 3 == 0 else w for i, w in enumerate(base)]
    texts = []
    for n in range(5000):
        words = list(base if n % 50 else far)
        words[rng.randrange(len(words))] = f"e{n}"
        texts.append(" ".join(words))
    texts += [" ".join(f"s{n}x{i}" for i in range(60)) for n in range(200)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)
    got = {r.doc_id: r.component_id for r in lsh_forest.near_duplicates(df, block=20_000).collect()}
    # One changed word costs at most five shingles of 116, so any two copies of one base share 106 of at most 126: linked.
    expected = {i: (i if i >= 5000 else 0 if i % 50 == 0 else 1) for i in range(len(texts))}
    assert got == expected


def test_near_duplicates_of_one_id_with_two_texts(spark):
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    df = spark.createDataFrame([(5, a), (5, b), (3, a + " more"), (7, b), (7, b), (8, a)], "doc_id long, text string")
    got = Counter((r.doc_id, r.component_id, r.kept, r.first) for r in lsh_forest.near_duplicates(df).collect())
    assert got == {(5, 3, False, False): 1, (5, 5, True, True): 1, (3, 3, True, True): 1, (7, 5, False, False): 2, (8, 3, False, False): 1}


def test_shards_query(spark):
    """Every document once, sizes and checksums of its text, counts at most one apart, gapless slots, no shard tied to a partition of the file."""
    got = queries.op5_sharding(spark, SF).toPandas()
    texts = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").toPandas()
    raw = texts.text.map(lambda t: (t or "").encode())
    expected = sorted(zip(texts.doc_id, raw.map(len) + 16, raw.map(zlib.crc32)))
    assert sorted(zip(got.doc_id, got["size"], got.text_crc32)) == expected and set(got.law) == {"rows"} and got.grown_shard.isna().all()
    sizes = got.groupby("shard").size()
    assert len(sizes) == 40 and sizes.max() - sizes.min() <= 1 and all(sorted(g.slot) == list(range(len(g))) for _, g in got.groupby("shard"))


def test_a_row_repeated_often_is_shared_out(spark):
    rows = spark.createDataFrame([(1, "same")] * 5000 + [(2, "other")] * 11, "doc_id long, text string")
    got = sharding.shuffle_to_shards(rows, ["doc_id", "text"], 10, rows_per_partition=100).toPandas()
    assert len(got) == 5011 and got.groupby("shard").size().between(501, 502).all() and got.groupby("shard").slot.max().between(500, 501).all()
    assert len(got[got.doc_id == 2].shard.unique()) > 3


def test_shards_are_exact(spark, docs):
    got = sharding.shuffle_to_shards(docs.select("doc_id", "text"), ["doc_id", "text"], 7, rows_per_partition=20).toPandas()
    sizes = got.groupby("shard").size()
    assert sorted(got.doc_id) == sorted(r.doc_id for r in docs.select("doc_id").collect()) and sizes.max() - sizes.min() <= 1
    assert all(sorted(g.slot) == list(range(len(g))) for _, g in got.groupby("shard"))
    matrix = sharding.communication_matrix([5, 0, 9], 4, 1)
    assert matrix.sum(axis=1).tolist() == [5, 0, 9] and sorted(matrix.sum(axis=0)) == [3, 3, 4, 4]


def test_packing_is_a_round_trip(spark, docs, odd):
    public = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    hostile = spark.createDataFrame([(1, "a <|endoftext|> b"), (2, "<|endoftext|>" * 3), (3, "<|endoftext|"), (4, "ab" * 500_000), (5, None)], "doc_id long, text string")
    for df in (docs, odd.filter("doc_id <> 4"), hostile):
        got = packing.pack_documents(df).toPandas()
        assert got.columns.tolist() == ["doc_id", "start", "length", "ids", "doc_tokens", "bucket", "batch", "place", "sequence_id", "offset"]
        assert got.sequence_id.is_unique and all(n & (n - 1) == 0 and n <= 2048 for n in got.length)
        assert (2**got.bucket == got.length).all() and (got.groupby("batch").bucket.nunique() == 1).all()
        assert all(sorted(g.place) == list(range(len(g))) and g.length.sum() <= 65_536 for _, g in got.groupby("batch"))
        for r in df.select("doc_id", "text").collect():
            mine = got[got.doc_id == r.doc_id].sort_values("start")
            assert np.frombuffer(b"".join(mine.ids), "<u4").tolist() == [*public.encode(r.text or "", add_special_tokens=False).ids, 1]


def plain_phrases(text, reference):
    n, at = 0, 0
    while at < len(text):
        size = 1
        while at + size < len(text) and text[at : at + size + 1] in reference:
            size += 1
        n, at = n + 1, at + size
    return n


def test_phrases_against_substring_search():
    """Exact counts, for texts of one piece and for texts that leave the others behind, with characters that no reference has."""
    rng = random.Random(2)
    texts = ["".join(rng.choice("abcd ") for _ in range(300)) for _ in range(2)]
    asked = ["".join(rng.choice("abcdxy ") for _ in range(rng.choice((1, 20, 400, 1500)))) for _ in range(60)] + ["", "zzz"]
    got = language_id.CrossParser({"x": texts[0], "y": texts[1]}).phrases(asked, group=40)
    assert got.tolist() == [[plain_phrases(t, reference) for reference in texts] for t in asked]


def test_phrases_of_large_alphabets():
    """More characters than the table has columns."""
    rng = random.Random(6)
    letters = [chr(0x4E00 + i) for i in range(600)]
    words = ["".join(rng.choices(letters, k=3)) for _ in range(200)]
    reference = "".join(rng.choice(words) for _ in range(700))
    asked = ["".join(rng.choice(words) for _ in range(rng.randint(1, 60))) + chr(0x3042) for _ in range(50)]
    got = language_id.CrossParser({"x": reference, "y": "abc"}).phrases(asked)
    assert got[:, 0].tolist() == [plain_phrases(t, reference) for t in asked] and got[:, 1].tolist() == [len(t) for t in asked]


def test_languages_of_several_scripts(spark):
    rng = random.Random(3)
    scripts = {"el": [chr(c) for c in range(0x3B1, 0x3CA)], "ru": [chr(c) for c in range(0x430, 0x450)], "uk": [chr(c) for c in range(0x430, 0x450)], "zh": [chr(0x4E00 + i) for i in range(900)], "ja": [chr(0x4E00 + i) for i in range(300)] + [chr(0x3041 + i) for i in range(80)]}
    words = {k: ["".join(rng.choices(v, k=rng.randint(2, 6))) for _ in range(150)] for k, v in scripts.items()}
    text = lambda k, n: " ".join(rng.choices(words[k], k=n))
    references = {k: text(k, 1500) for k in scripts}
    rows = [(i, k, text(k, 25)) for i, k in enumerate(list(scripts) * 20)]
    got = {r.doc_id: r.lang_pred for r in language_id.predict_language(spark.createDataFrame(rows, "doc_id long, lang string, text string"), references).collect()}
    assert all(got[i] == k for i, k, _ in rows)


def test_references_are_whole_texts(spark):
    rows = [(i, "en", f"text {i} " + "w" * 60) for i in range(200)] + [(900, "en", "x" * 5000), (901, "de", "y" * 700), (902, "fr", "z" * 5000), (903, None, "q"), (904, "it", None)]
    got = language_id.reference_texts(spark.createDataFrame(rows, "doc_id long, lang string, text string"), "doc_id", "text", "lang", 1000)
    assert set(got) == {"en", "de"} and got["de"] == "y" * 700 and len(got["en"]) <= 1000 and set(got["en"].split("\n")) <= {r[2] for r in rows}


def test_languages_held_out(spark):
    got = queries.op7_language_id(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id").filter("held_out").toPandas()
    assert (got.lang == got.lang_pred).mean() >= 0.97


def test_license_spans(spark):
    notice = license_scan.TEMPLATES["apache"][2]
    broken = notice.replace("may not", "may certainly not").replace("writing", "paper")
    rows = [(1, f"words before {notice} words after"), (2, f"x {broken}"), (3, "the mit license is short"), (4, "Released under the MIT License."), (5, " ".join(notice.split()[:40]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = defaultdict(set)
    for r in license_scan.license_spans(df, ["doc_id"]).collect():
        got[r.doc_id].add((r.label, r.template, r.first_word, round(r.similarity, 3)))
    whole = [n for label, n, words in license_scan.template_table(None, 5) if words == license_scan.plain_words(notice)][0]
    size = len(license_scan.plain_words(notice))
    assert ("apache", whole, 2, 1.0) in got[1] and ("apache", whole, 1, round((size - 1) / (size + 1), 3)) in got[2] and 3 not in got
    assert {(x, s) for x, _, _, s in got[4]} == {("mit", 1.0)} and whole not in {n for _, n, _, _ in got[5]}


def test_altered_notices_keep_their_label(spark):
    """Every template of 20 words and more with one word changed, added or missing, with the query's own parameters."""
    rng, rows = random.Random(9), []
    for label, texts in license_scan.TEMPLATES.items():
        for words in (t.split() for t in texts if len(t.split()) >= 20):
            i = rng.randrange(6, len(words) - 6)
            rows += [(label, " ".join(x)) for x in ([*words[:i], "other", *words[i + 1 :]], [*words[:i], "more", *words[i:]], [*words[:i], *words[i + 1 :]])]
    df = spark.createDataFrame([(i, text) for i, (_, text) in enumerate(rows)], "doc_id long, text string")
    got = {r.doc_id: r for r in license_scan.license_report(df, ["doc_id"]).collect()}
    assert all(label in got[i].labels.split(",") and got[i].score >= 0.9 for i, (label, _) in enumerate(rows))


def plain_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        row = plain_row(x, b, row)
    return row[-1]


def plain_row(x, b, before):
    now = [0]
    for j, y in enumerate(b):
        now.append(before[j] + 1 if x == y else max(before[j + 1], now[j]))
    return now


def plain_report(text, k=5, drift=3):
    """Labels and score of a text, hit by hit."""
    words = license_scan.plain_words(text or "")
    labels, score = set(), 0.0
    for label, _, want in license_scan.template_table(None, k):
        hits = {(i, j) for i in range(len(words) - k + 1) for j in range(len(want) - k + 1) if words[i : i + k] == want[j : j + k]}
        groups = []
        for d in sorted({i - j for i, j in hits}):
            if groups and d - groups[-1][-1] <= drift:
                groups[-1].append(d)
            else:
                groups.append([d])
        for g in groups:
            places = [i for i, j in hits if i - j in g]
            window = words[max(0, min(g[0], min(places))) : max(g[-1] + len(want), max(places) + k)]
            s = plain_common(want, window) / max(len(want), len(window))
            if 100 * s >= 80:
                labels.add(label)
                score = max(score, s)
    return labels, score


def test_license_query_against_plain_search(spark):
    got = queries.op8_license_scan(spark, SF).toPandas().set_index("doc_id")
    for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect():
        if "icen" not in r.text:  # no template's words can stand in it
            assert got.score[r.doc_id] == 0 and got.labels[r.doc_id] == ""
            continue
        labels, score = plain_report(r.text)
        base = set(filter(None, got.base_labels[r.doc_id].split(",")))
        assert got.labels[r.doc_id] == ",".join(sorted(labels | base)) and got.score[r.doc_id] == pytest.approx(score)


def test_license_base_places(spark):
    got = queries.op8_license_scan(spark, SF).toPandas().set_index("doc_id")
    import re
    for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect():
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), r.text or ""))
        places = [i for p in license_scan.BASE_PHRASES.values() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
        assert (got.n_words[r.doc_id], got.n_base[r.doc_id]) == (len(words), len(places))
        if places:
            assert (got.first_word[r.doc_id], got.last_word[r.doc_id]) == (min(places), max(places))


def test_vector_recall(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(1500, 24)) + 3 * rng.normal(size=(8, 24))[rng.integers(0, 8, 1500)]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(5000, None), (5001, [0.0] * 24), (5002, [float("nan")] * 24), (5050, [None] + [1.0] * 23)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = anisotropic_ann.search(df, df.filter("vec_id % 50 = 0")).toPandas()
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    hits = 0
    for q in range(0, 1500, 50):
        s = unit @ unit[q]
        s[q] = -2
        hits += len(set(np.argsort(-s)[:5]) & set(got[got.query_id == q].vec_id))
    assert len(got) == 150 and hits / 150 >= 0.9


def test_search_among_equal_and_near_vectors(spark):
    """More rows than the shortlist that tie in the estimates: the smallest ids of the equal ones, the true nearest of the near ones."""
    rng = np.random.default_rng(3)
    one, other = rng.normal(size=(2, 8))
    x = np.concatenate([rng.normal(size=(12000, 8)), np.tile(one, (3000, 1)), other + 1e-5 * rng.normal(size=(400, 8))])
    ids = rng.permutation(len(x))
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<double>")
    asked = [*ids[12000:12004], *ids[15000:15004]]
    got = anisotropic_ann.search(df, df.filter(F.col("vec_id").isin([int(i) for i in asked]))).toPandas().sort_values(["query_id", "rank"])
    unit, hits = x / np.linalg.norm(x, axis=1, keepdims=True), 0
    for q in asked[:4]:
        assert got[got.query_id == q].vec_id.tolist() == [i for i in sorted(ids[12000:15000]) if i != q][:5]
    for q in asked[4:]:
        far = ((unit - unit[ids == q]) ** 2).sum(axis=1)
        far[ids == q] = 9
        hits += len(set(ids[np.argsort(far)[:5]]) & set(got[got.query_id == q].vec_id))
    assert hits == 20


def test_search_with_repeated_ids(spark):
    """An id of two vectors is listed once with the better one; as a query its lesser vector stands for it, and neither is its own neighbour."""
    rows = [(0, [1.0, 0.0]), (7, [0.0, 1.0]), (7, [1.0, 0.1]), (9, [1.0, 1.0]), (None, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = anisotropic_ann.search(df, df).collect()
    found = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in got}
    assert found[0, 1] == (7, pytest.approx(1 / 1.01**0.5)) and found[0, 2] == (9, pytest.approx(0.5**0.5)) and (0, 3) not in found
    assert found[7, 1] == (9, pytest.approx(0.5**0.5)) and found[7, 2] == (0, pytest.approx(0.0)) and len(found) == 6


def test_search_query_recall(spark):
    """The registered query against brute force over the whole table of sf0.1: ids, ranks and scores."""
    sf = "/root/testdata/sf0.1"
    got = queries.op9_anisotropic_ann(spark, sf).toPandas()
    table = spark.read.parquet(f"{sf}/embeddings.parquet").toPandas()
    x, ids = np.array(table.embedding.tolist(), float), table.vec_id.to_numpy()
    unit, hits, asked = x / np.linalg.norm(x, axis=1, keepdims=True), 0, ids[ids % 50 == 0]
    for q in asked:
        score = unit @ unit[ids == q][0]
        score[ids == q] = -2
        mine = got[got.query_id == q].sort_values("rank")
        assert mine["rank"].tolist() == [1, 2, 3, 4, 5] and np.allclose(mine.score, [score[ids == i][0] for i in mine.vec_id])
        hits += len(set(ids[np.argsort(-score)[:5]]) & set(mine.vec_id))
    assert hits >= 0.97 * 5 * len(asked)


def test_audio_round_trip_and_resync(spark):
    for payload in (b"", b"a", bytes(range(256)) * 40):
        media = mpeg_audio.write_stream(payload)
        s = mpeg_audio.parse_stream(media)
        assert mpeg_audio.read_payload(media, s) == payload and s.checked == s.sound == len(s.offsets) and s.skipped == 0
        assert s.vbr_frames == len(s.audio) and s.offsets[0] == s.table_at
        noisy = mpeg_audio.parse_stream(b"\xff\xfbjunk" + media[media.index(b"\xff\xfa") :])
        assert len(noisy.offsets) == len(s.offsets) and noisy.skipped > 0
    bad = bytearray(mpeg_audio.write_stream(b"x" * 100))
    bad[mpeg_audio.parse_stream(bytes(bad)).offsets[1] + 8] ^= 1
    assert mpeg_audio.parse_stream(bytes(bad)).sound == 1


def test_audio_of_damaged_and_foreign_streams(spark):
    payload = bytes(range(256)) * 40
    media = mpeg_audio.write_stream(payload)
    s = mpeg_audio.parse_stream(media)
    whole = len(s.offsets)
    broken = mpeg_audio.parse_stream(media[: s.offsets[4]] + b"\0" * 50 + media[s.offsets[5] :])  # one frame lost, the one before it kept
    assert len(broken.offsets) == whole - 1 and broken.offsets[3] == s.offsets[3] and broken.skipped == 50 and broken.sound == broken.checked
    cut = mpeg_audio.parse_stream(media[: s.offsets[5] + 30])
    assert len(cut.offsets) == 5 and cut.skipped == 30
    frames = media[s.offsets[0] :]
    text = b"\0payload_bytes\0" + str(len(payload)).encode()
    v22 = b"TXX" + len(text).to_bytes(3, "big") + text
    v24 = b"TXXX" + bytes((0, 0, 0, len(text))) + b"\0\0" + text
    for tag in (b"ID3\x02\0\0" + bytes((0, 0, 0, len(v22))) + v22, b"ID3\x04\0\x40" + bytes((0, 0, 0, len(v24) + 6)) + b"\0\0\0\6\1\0" + v24, b"ID3\x04\0\x10" + bytes((0, 0, 0, len(v24))) + v24 + b"3DI\x04\0\x10" + bytes((0, 0, 0, len(v24)))):
        again = mpeg_audio.parse_stream(tag + frames)
        assert again.skipped == 0 and len(again.offsets) == whole and mpeg_audio.read_payload(tag + frames, again) == payload
    raw = b"\0n\0\xff\0\xe0"  # \xff\xe0 once its unsynchronisation is undone
    tag = b"TXXX" + (len(raw) - 1).to_bytes(4, "big") + b"\0\0" + raw
    assert mpeg_audio.parse_stream(b"ID3\x03\0\x80" + bytes((0, 0, 0, len(tag))) + tag + frames).tags == {"TXXX:n": "\xff\xe0"}
    odd = media.replace(b"payload_bytes\0" + str(len(payload)).encode(), b"payload_bytes\0" + b"x" * len(str(len(payload))))
    assert mpeg_audio.read_payload(odd, mpeg_audio.parse_stream(odd)) == b""
    table = bytearray(mpeg_audio._frame(9, b"", 576))
    table[36:54] = b"VBRI" + b"\0\1\0\0\0\0" + (9999).to_bytes(4, "big") + (77).to_bytes(4, "big")
    vbri = mpeg_audio.parse_stream(bytes(table) + media[s.offsets[1] :])
    assert (vbri.vbr_bytes, vbri.vbr_frames, len(vbri.audio)) == (9999, 77, whole - 1)
    for head, size, samples in ((b"\xff\xff\x94\x00", 288 * 4 * 12 // 48, 384), (b"\xff\xfd\x94\x00", 144 * 160 // 48, 1152)):  # layers I and II at 48 kHz
        stream = mpeg_audio.parse_stream(head.ljust(size, b"\0") * 3)
        assert len(stream.offsets) == 3 and {h.samples for h in stream.headers} == {samples} and stream.checked == 0
    rng = random.Random(5)
    for _ in range(300):
        noise = bytearray(media[: rng.randint(0, len(media))])
        for _ in range(rng.randint(1, 30)):
            if noise:
                noise[rng.randrange(min(len(noise), 400))] = rng.choice((0, 255, rng.randrange(256)))
        mpeg_audio.read_payload(bytes(noise), mpeg_audio.parse_stream(bytes(noise)))
    got = spark.createDataFrame([(1, None), (2, b"no stream"), (3, odd)], "payload long, media binary").select("payload", mpeg_audio.decode_audio(F.col("media")).alias("a")).collect()
    assert [(r.payload, r.a.n_frames) for r in got[:2]] == [(1, 0), (2, 0)] and got[2].a.n_frames == whole - 1


def test_audio_query(spark):
    got = queries.op10_mpeg_audio(spark, SF).toPandas().set_index("doc_id")
    import hashlib
    for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect():
        raw = r.text.encode()
        padded = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        row = got.loc[r.doc_id]
        assert (row.n_bytes, row.payload_bytes, row.payload_sha256, row.tail_crc32) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
