"""Order MinHash, Merkle manifest and periodic runs: queries against plain versions, and odd rows."""

import hashlib
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

from citelens.llm import merkle, order_minhash, periodic_runs, queries

SF = "/root/testdata/sf0.001"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def crc(doc_id):
    return zlib.crc32(str(doc_id).encode())


@pytest.fixture(scope="module")
def rows(spark):
    return [r.asDict() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, ties, repeats, other scripts and clashing column names."""
    long = " ".join(f"w{i % 977}" for i in range(30_000))
    clashes = ("text_", "node", "n", "at", "runs", "n_words", "signature", "id", "r1", "carried", "group_key", "order", "path", "root", "found_runs")
    texts = [(1, None), (2, ""), (3, long), (4, long), (4, long), (None, "x Y z"), (None, "x Y z"), (6, " \n\t "), (7, "\u0085 \U0001f600 漢字他的 A"), (8, "one"), (9, "a" * 40_000), (4, "Other")]
    data = [(i, t, None if (i or 0) % 2 else "en", "s", None, *range(len(clashes))) for i, t in texts]
    return spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} long" for c in clashes))


@pytest.fixture
def written(odd, tmp_path):
    odd.write.parquet(f"{tmp_path}/odd/documents.parquet")
    odd.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    odd.filter("doc_id = 8").write.parquet(f"{tmp_path}/one/documents.parquet")
    return tmp_path


def same(frame, expected):
    assert sorted(map(tuple, frame.collect()), key=str) == sorted(expected, key=str)


# Order MinHash


def plain_signature(text, k=3, picks=2, functions=64):
    text = re.sub(f"[{order_minhash.LONE}]", r" \g<0> ", text)
    spans = [m.span() for m in WORDS.finditer(text)]
    grams = [text[spans[i][0] : spans[i + k - 1][1]] for i in range(len(spans) - k + 1)]
    if spans and not grams:
        grams = [text.strip(" \t\n\x0b\x0c\r")]
    seen, items, out = Counter(), [], ""
    for place, gram in enumerate(grams):
        seen[gram] += 1
        h = xxhash.xxh64_intdigest(gram.encode(), 42)
        items.append((xxhash.xxh64_intdigest(struct.pack("<i", seen[gram]), xxhash.xxh64_intdigest(struct.pack("<Q", h), 42)), place, h))
    for j in range(functions if items else 0):
        least = sorted(items, key=lambda x: ((x[0] - (j << 64) // functions) % (1 << 64), x[1]))[:picks]
        h = 42
        for x in sorted(least, key=lambda x: x[1]):
            h = xxhash.xxh64_intdigest(struct.pack("<Q", x[2]), h)
        out += f"{h >> 32:08x}"
    return out


def plain_likeness(a, b):
    return sum(a[i : i + 8] == b[i : i + 8] for i in range(0, len(a), 8)) / (len(a) // 8) if a and b else float(a == b)


def plain_fingerprints(docs):
    """docs: (doc_id, text), by descending id; ids differ."""
    docs, out = sorted(docs, key=lambda r: -r[0]), []
    for i, (doc_id, text) in enumerate(docs):
        text, after = text or "", docs[(i + 1) % len(docs)][1] or ""
        third = len(text) // 3
        edited = text[: len(text) - third] + after[:third]
        own, other, next_ = map(plain_signature, (text, edited, after))
        out.append((doc_id, len(text), sha(edited), own, other, plain_likeness(own, other), plain_likeness(own, next_)))
    return out


def test_fingerprints_are_the_plain_ones(spark, rows):
    same(queries.op11_order_minhash(spark, SF), plain_fingerprints([(r["doc_id"], r["text"]) for r in rows]))


def test_fingerprints_follow_edits(spark):
    """Nearer for fewer edits; a text in another order is far though its words are the same; several ranges of rows."""
    rng = random.Random(3)
    words = [f"w{rng.randrange(500)}" for _ in range(600)]
    shuffled = [w for k in rng.sample(range(100), 100) for w in words[6 * k : 6 * k + 6]]
    edits = {0: words, 1: words[:300] + ["x"] + words[300:], 2: [w if i % 20 else "y" for i, w in enumerate(words)], 3: words[200:] + words[:200], 4: shuffled}
    own = {i: plain_signature(" ".join(w)) for i, w in edits.items()}
    near = [plain_likeness(own[0], own[i]) for i in range(5)]
    assert near[0] == 1 and near[1] > 0.9 > near[2] and near[1] > near[3] > near[4]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in edits.items()], "doc_id long, text string")
    found = order_minhash.edited_fingerprints(docs, rows_per_range=2).select("doc_id", order_minhash.as_text(F.col("signature")))
    assert dict(map(tuple, found.collect())) == own


def test_fingerprints_of_odd_rows(spark, odd, written):
    found = defaultdict(list)
    for r in queries.op11_order_minhash(spark, f"{written}/odd").collect():
        found[r.doc_id].append(r)
    texts = Counter((r.doc_id, r.text or "") for r in odd.collect())
    assert {i: len(v) for i, v in found.items()} == Counter(i for i, _ in texts.elements())
    expected = {t: plain_signature(t) for _, t in texts}
    assert {(i, r.fingerprint) for i, v in found.items() for r in v} == {(i, expected[t]) for i, t in texts}
    assert found[1][0].fingerprint == found[2][0].fingerprint == "" and found[2][0].near_next == 1.0 and found[3][0].near_next == 0.0
    assert queries.op11_order_minhash(spark, f"{written}/none").count() == 0
    alone = queries.op11_order_minhash(spark, f"{written}/one").first()
    assert alone.edited_sha256 == sha("on" + "o") and alone.near_next == 1.0


# Merkle manifest


def fields(*values):
    return "".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values)


def plain_tree(nodes, arity):
    """(root, the path of each leaf as pairs of digests left and right)."""
    paths, below = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        for i, leaves in enumerate(below):
            first = i - i % arity
            for leaf in leaves:
                paths[leaf].append(("".join(nodes[first:i]), "".join(nodes[i + 1 : first + arity])))
        nodes, below = [sha("".join(nodes[i : i + arity])) for i in range(0, len(nodes), arity)], [sum(below[i : i + arity], []) for i in range(0, len(below), arity)]
    return nodes[0], paths


def plain_manifest(rows):
    groups, out = defaultdict(list), []
    for r in rows:
        groups[r["lang"]].append(r)
    keys = sorted(groups, key=lambda k: (k is not None, (k or "").encode()))
    leaf = lambda r, text: sha(fields(r["doc_id"], r["source"], r["lang"], r["n_chars"], text))
    for k in keys:
        groups[k].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r, r["text"])))
    trees = [plain_tree([leaf(r, r["text"]) for r in groups[k]], 8) for k in keys]
    root, upper = plain_tree([t[0] for t in trees], 8)
    for k, (subroot, paths), on in zip(keys, trees, upper):
        for r, path in zip(groups[k], paths):
            path = path + on
            tampers = r["doc_id"] is not None and crc(r["doc_id"]) % 3 == 0 and r["text"]
            node = leaf(r, r["text"].translate(LOWER) if tampers else r["text"])
            for left, right in path:
                node = sha(left + node + right)
            out.append((r["doc_id"], leaf(r, r["text"]), subroot, root, sha("".join(a + b for a, b in path)), node, node == root))
    return out


def test_manifest_is_the_plain_one(spark, rows):
    found = queries.op12_merkle_manifest(spark, SF)
    same(found, plain_manifest(rows))
    assert {True, False} == {r.verified for r in found.collect()}


def test_manifest_of_odd_rows(spark, odd, written):
    """Ties of an id are told apart by nothing that is promised, so the tree is compared where ids differ; the others by their sums."""
    found = queries.op12_merkle_manifest(spark, f"{written}/odd")
    assert found.count() == odd.count() and found.select("root").distinct().count() == 1
    unique = odd.dropDuplicates(["doc_id"])
    unique.write.parquet(f"{written}/unique/documents.parquet")
    kept = spark.read.parquet(f"{written}/unique/documents.parquet").collect()
    same(queries.op12_merkle_manifest(spark, f"{written}/unique"), plain_manifest([r.asDict() for r in kept]))
    assert queries.op12_merkle_manifest(spark, f"{written}/none").count() == 0
    alone = queries.op12_merkle_manifest(spark, f"{written}/one").first()
    assert alone.leaf == alone.subroot == alone.root and alone.proof_sha256 == sha("") and alone.verified


@pytest.mark.parametrize("arity", [2, 3, 8])
def test_trees_of_any_arity_and_size(spark, arity):
    """Groups of 1 to 70 rows, a last run of one, many ranges of rows and a group with most rows."""
    sizes = {f"g{n}": n for n in (1, 2, arity, arity + 1, arity**2, arity**2 + 1, 70)}
    nodes = {g: [sha(f"{g}/{i}") for i in range(n)] for g, n in sizes.items()}
    leaves = spark.createDataFrame([(g, i, node) for g, every in nodes.items() for i, node in enumerate(every)], "group_key string, order int, node string")
    found = merkle.manifest(leaves.withColumn("extra", F.col("order")), arity)
    keys = sorted(nodes)
    trees = [plain_tree(nodes[k], arity) for k in keys]
    root, upper = plain_tree([t[0] for t in trees], arity)
    expected = [(node, t[0], root, [tuple(x) for x in p + on]) for k, t, on in zip(keys, trees, upper) for node, p in zip(nodes[k], t[1])]
    got = [(r.node, r.subroot, r.root, [(x["left"], x["right"]) for x in r.path]) for r in found.collect()]
    assert sorted(got, key=str) == sorted(expected, key=str)
    assert found.filter(merkle.folded(F.col("node"), F.col("path")) != F.col("root")).count() == 0


def test_places_by_ranges(spark):
    leaves = spark.range(1000).select(F.lit("=a").alias("group_key"), (F.col("id") / 3).cast("int").alias("order"), F.sha2(F.col("id").cast("string"), 256).alias("node"))
    placed = merkle.numbered(leaves.repartition(7).withColumn("o", F.col("order")), rows_per_range=90).orderBy("at").collect()
    assert [r["at"] for r in placed] == list(range(1000)) and [r.o for r in placed] == [i // 3 for i in range(1000)] and {r.n for r in placed} == {1000}


# Periodic runs


def plain_runs(words, least=12):
    found, n = [], len(words)
    for q in range(1, n // 2 + 1):
        i = q
        while i < n:
            start = i - q
            while i < n and words[i] == words[i - q]:
                i += 1
            if i - start >= max(least, 2 * q) and not any(all(words[k] == words[k - d] for k in range(start + d, i)) for d in range(1, q)):
                found.append((start, i - start, q))
            i += 1
    return sorted(found, key=lambda r: (r[0], r[2]))


def plain_collapse(words, runs):
    gone = {k for start, length, period in runs for k in range(start + period, start + length)}
    return [w for k, w in enumerate(words) if k not in gone]


def test_runs_and_collapse_of_random_words():
    rng, seen = random.Random(5), 0
    for _ in range(3000):
        n = rng.randint(0, 80)
        words = [rng.randrange(rng.choice((1, 2, 3, 9))) for _ in range(n)]
        for _ in range(rng.randint(0, 3) if n else 0):
            period, at = rng.randint(1, 14), rng.randrange(n)
            for i in range(at + period, min(n, at + rng.randint(1, 60))):
                words[i] = words[i - period]
        least = rng.choice((12, 12, 2, 5))
        runs = periodic_runs.find_runs(words, least)
        assert runs == plain_runs(words, least) and periodic_runs.collapse(words, runs) == plain_collapse(words, runs)
        seen += len(runs)
    assert seen > 2000


def test_runs_of_long_texts():
    assert periodic_runs.find_runs(["a"] * 200_000) == [(0, 200_000, 1)]
    assert periodic_runs.find_runs([f"w{i % 977}" for i in range(100_000)]) == [(0, 100_000, 977)]
    blocks = (["a"] * 50 + ["b"]) * 60
    assert periodic_runs.find_runs(blocks) == plain_runs(blocks)


def plain_periods(doc_id, text):
    words = WORDS.findall(text or "")
    h, n = crc(doc_id), len(words)
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = plain_runs(words) if len(words) < 3000 else periodic_runs.find_runs(words)
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2])) if runs else (None, None, None)
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha(lines), sha(" ".join(plain_collapse(words, runs))))


def test_periods_are_the_plain_ones(spark, rows):
    found = queries.op13_periodic_runs(spark, SF)
    same(found, [plain_periods(r["doc_id"], r["text"]) for r in rows])
    assert found.filter("n_runs > 0").count() >= 10


def test_periods_of_odd_rows(spark, odd, written):
    same(queries.op13_periodic_runs(spark, f"{written}/odd"), [plain_periods(r.doc_id, r.text) if r.doc_id is not None else (None, 0, None, None, None, None, sha(""), sha(r.text)) for r in odd.collect()])
    assert queries.op13_periodic_runs(spark, f"{written}/none").count() == 0
    kept = periodic_runs.periodic_runs(odd).filter("doc_id = 6").first()
    assert kept.collapsed == " \n\t " and kept.n_words == 0 and kept.signature == 6
