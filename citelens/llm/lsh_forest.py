"""Near-duplicate documents by an LSH forest over MinHash signatures.

1. Sketch (one Arrow map): the distinct word shingles of the whole text, a 128-bit key of that set and ``hashes`` minima.
   Equal sets are one node from here on, however many copies there are.
2. Forest: ``trees`` sorted orders of the nodes, each by its own rotation of the signature.  Range partitioning and a sort
   inside the tasks put longest common prefixes side by side.  A region's depth adapts to its crowd: a run that shares
   ``depth`` minima is compared whole if it has at most ``reach`` + 1 nodes, and a longer one at whatever depth its parts
   have so few, which are the neighbours within ``reach`` places.  A pair survives if its signature estimate is within
   about four standard deviations of the threshold.
3. Crowds: a node whose run was too long, or cut by a partition's edge, and holds nodes of other components so far, in at
   least ``CROWDED`` trees, may have partners that no tree compared.  Their pairs come from a prefix-filter join: of a set of n shingles the n - ceil(threshold * n) + 1
   rarest are posted, of which a linked pair must share one whatever the order; a bounded sample of the crowd says which are
   common, which decides the work, not the result.  Posting lists meet in one shuffle; a list of one component can link
   nothing new, and of others one pair for any two components is enough.
4. Candidates only say who may belong together: their connected components are candidate clusters, whose links are measured
   on full shingle sets.  Clusters are cut into blocks of at most ``block`` shingles.  First every block is solved alone,
   with the cluster's first nodes as guests in all of them, so that blocks of near copies of one text grow together in
   linear work; then only nodes outside a cluster's largest component meet the blocks of the others.

A hot group of copies is one node; of near copies, one cluster in bounded blocks.  No step emits the pairs of a group.
Nothing but loop counters and the common shingles of the sample (at most ``COMMON``) reaches the driver.

A linked pair at the threshold shares ``depth`` minima of a tree with chance 0.8**3, of twenty trees none with chance 6e-7
and fewer than CROWDED with chance 1.3e-5; the estimate's floor loses 3e-5.  Both fall fast with similarity.

Defined results: null or empty text has an empty set, is linked with nothing and is kept; rows that repeat an id with equal
text are equal rows; rows that share an id but not the text are documents each, and kept is true for all whose component's
smallest id is theirs, first for one of them; a null id has a null component, links nothing and is kept; results have their own columns, so
clashing names do no harm; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citelens.llm.shared import cut, join_counted, stored

PRIME_A, PRIME_B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)

#: At most so many common shingles order a crowd's postings, counted in a sample of about SAMPLE of its texts.
COMMON, SAMPLE = 200_000, 1_000
#: Posting lists up to this length are compared many at a time, longer ones one by one.
SHORT = 16
#: A node is of a crowd if its run was not compared whole in so many trees.
CROWDED = 2
#: The first nodes of a cluster of several blocks that every block is measured against.
GUESTS = 16
#: Rows of a small table that one task of a round takes.
ROWS = 100_000
#: Rounds after which connected() raises; each halves the longest path at least.
ROUNDS = 100


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * PRIME_B
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of ``width`` words; a shorter text is one shingle, no words none."""
    words = (text or "").encode().lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    n = max(1, len(words) - width + 1)
    out = np.full(n, min(len(words), width), np.uint64)
    for j in range(min(width, len(words))):
        out = _mix(out * PRIME_A + h[j : j + n])
    return np.unique(out)


def minima(shingles: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """One 32-bit minimum for each factor; long sets in slices, so that memory stays bounded."""
    best = np.full(len(factors), 0xFFFFFFFF, np.uint64)
    for at in range(0, len(shingles), 4096):
        part = shingles[at : at + 4096]
        for k, f in enumerate(factors):
            best[k] = min(best[k], (part * f).min() >> np.uint64(32))
    return best.astype(np.uint32)


def _factors(hashes: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 2**63, hashes, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def sketch(docs: DataFrame, id_col: str, text: str, width: int, hashes: int, seed: int) -> DataFrame:
    """(id, text_key, n_shingles, set_key binary or null, signature binary of big-endian 32-bit minima)."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        factors = _factors(hashes, seed)
        for batch in batches:
            n, keys, signatures = [], [], []
            for t in batch["text"]:
                s = shingle_set(t, width)
                n.append(len(s))
                keys.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                signatures.append(minima(s, factors).astype(">u4").tobytes() if len(s) else None)
            yield pd.DataFrame({"id": batch["id"], "text_key": batch["text_key"], "n_shingles": n, "set_key": keys, "signature": signatures})

    return _texts(docs, id_col, text).mapInPandas(run, f"id {id_type}, text_key long, n_shingles long, set_key binary, signature binary")


def _texts(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("text_key"), F.col(text).alias("text"))


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest member of each of n nodes' component under the links a-b."""
    root = np.arange(n)
    while len(a):
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        open_ = low != high
        if not open_.any():
            break
        np.minimum.at(root, high[open_], low[open_])
        root = root[root]
        while (root != root[root]).any():
            root = root[root]
    return root


def _low(signatures: pd.Series) -> list[bytes]:
    """The last four bits of each minimum, two to a byte: what estimates compare."""
    out = []
    for s in signatures:
        last = np.frombuffer(s, ">u4").astype(np.uint8) & 15
        out.append((last[0::2] | last[1::2] << 4).tobytes())
    return out


class Estimates:
    """Signature estimates of many nodes, a row of 64-bit words each."""

    def __init__(self, lows: pd.Series | list[bytes], hashes: int):
        size = -(-hashes // 16) * 8
        self.words = np.frombuffer(b"".join(x.ljust(size, b"\0") for x in lows), np.uint64).reshape(len(lows), size // 8)
        self.hashes = hashes

    def at_least(self, a: np.ndarray, b: np.ndarray | int, least: float) -> np.ndarray:
        """Which pairs of places agree so often that their similarity may be ``least``: four bits agree by chance in 1 of 16."""
        x = self.words[a] ^ self.words[b]
        x |= x >> np.uint64(1)
        x |= x >> np.uint64(2)
        differ = np.bitwise_count(x & np.uint64(0x1111111111111111)).sum(axis=1, dtype=np.int64)
        return self.hashes - differ >= (least + (1 - least) / 16) * self.hashes


def forest_links(nodes: DataFrame, hashes: int, trees: int, depth: int, reach: int, least: float, key_minima: int = 8) -> DataFrame:
    """(a, b, run): links of prefix neighbours whose estimate is at least ``least``, thinned to a spanning forest in each task.

    A node whose run was not compared whole is linked with itself and names the run; other links have none.
    """
    step = 4 * (hashes // trees)

    def rotated(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 500):
                part = batch.iloc[at : at + 500]
                low = _low(part["signature"])
                keys = [(s + s)[t * step : t * step + 4 * key_minima] for t in range(trees) for s in part["signature"]]
                yield pd.DataFrame({"tree": np.repeat(np.arange(trees, dtype=np.int32), len(part)), "key": keys, "node": np.tile(part["node"].to_numpy(), trees), "low": low * trees})

    def neighbours(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last: pd.DataFrame | None = None
        for batch in batches:
            if not len(batch):
                continue
            first = last is None
            if not first:
                batch = pd.concat([last, batch], ignore_index=True)
            last = batch.iloc[-(reach + 1) :]
            n = len(batch)
            tree = batch["tree"].to_numpy()
            keys = np.frombuffer(b"".join(batch["key"]), np.uint32).reshape(n, key_minima)
            estimates = Estimates(batch["low"], hashes)
            ids = batch["node"].to_numpy()
            runs = tree.astype(np.uint64)
            for d in range(depth):
                runs = _mix(runs * PRIME_A + keys[:, d])
            runs = runs.view(np.int64)
            found: list[tuple[np.ndarray, np.ndarray]] = []
            crowd = np.zeros(n + 1, int)  # a run beyond reach, as steps up at its first and down after its last row
            for d in range(1, reach + 2):
                i = np.flatnonzero((tree[d:] == tree[:-d]) & (keys[d:, :depth] == keys[:-d, :depth]).all(axis=1)) if n > d else np.zeros(0, int)
                if d > reach:
                    np.add.at(crowd, i, 1)
                    np.add.at(crowd, i + d + 1, -1)
                    break
                for at in range(0, len(i), 50_000):
                    j = i[at : at + 50_000]
                    j = j[estimates.at_least(j, j + d, least)]
                    found.append((j, j + d))
            crowded = crowd.cumsum()[:n] > 0
            if first:
                crowded |= (tree == tree[0]) & (keys[:, :depth] == keys[0, :depth]).all(axis=1)
            yield pd.DataFrame({"a": ids[crowded], "b": ids[crowded], "run": runs[crowded]})
            ends = (tree == tree[-1]) & (keys[:, :depth] == keys[-1, :depth]).all(axis=1)
            cut_off = pd.DataFrame({"a": ids[ends], "b": ids[ends], "run": runs[ends]})
            if found:
                a, b = (np.concatenate(x) for x in zip(*found, strict=True))
                root = _roots(n, a, b)
                child = np.flatnonzero(root != np.arange(n))
                yield pd.DataFrame({"a": ids[child], "b": ids[root[child]], "run": pd.array([None] * len(child), "Int64")})
        if last is not None:
            yield cut_off

    sorted_ = nodes.select("node", "signature").mapInPandas(rotated, "tree int, key binary, node long, low binary")
    spread = sorted_.repartitionByRange("tree", "key", "node").sortWithinPartitions("tree", "key", "node")
    pairs = spread.mapInPandas(neighbours, "a long, b long, run long")
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "run").distinct()


def crowded_nodes(flags: DataFrame, parts: DataFrame) -> DataFrame:
    """(node): those with CROWDED runs (node, run) and more that hold nodes of several components (node, root)."""
    placed = cut(flags.join(parts, "node", "left").select("node", "run", F.coalesce("root", "node").alias("part")))
    runs = placed.groupBy("run").agg(F.min("part").alias("low"), F.max("part").alias("high"), F.count("*").alias("n"))
    mixed = join_counted(placed.select("node", "run"), runs.filter("low < high").select("run", "n"), "run", "n", placed.count())
    return mixed.groupBy("node").agg(F.count("*").alias("n")).filter(F.col("n") >= CROWDED).select("node")


def part_links(parts: np.ndarray, sizes: np.ndarray, estimates: Estimates, rows: np.ndarray, percent: int, least: float) -> list[tuple[int, int]]:
    """Pairs of places in ``rows`` that join their parts, at most one fewer than the parts: every pair of different parts that
    sizes allow is compared by estimate, but those whose parts have been joined already."""
    names, part = np.unique(parts[rows], return_inverse=True)
    order = np.argsort(-np.bincount(part), kind="stable")
    out, label = [], np.arange(len(names))
    for k in order[1:]:  # all pairs but those inside the largest part have an end in another
        for p in np.flatnonzero(part == k):
            other = np.flatnonzero(label[part] != label[k])
            if not len(other):
                return out
            near = 100 * np.minimum(sizes[rows[other]], sizes[rows[p]]) >= percent * np.maximum(sizes[rows[other]], sizes[rows[p]])
            other = other[near]
            hit = other[estimates.at_least(rows[other], rows[p], least)]
            for j in np.unique(label[part[hit]], return_index=True)[1]:
                out.append((int(rows[p]), int(rows[hit[j]])))
                label[label == label[part[hit[j]]]] = label[k]
    return out


def crowd_links(texts: DataFrame, crowd: DataFrame, width: int, percent: int, hashes: int, least: float) -> DataFrame:
    """(a, b): links between the parts of a crowd (node, part, n_shingles, signature) with texts (node, text), by a prefix-filter join."""

    def shingles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for t in batch["text"]:
                yield pd.DataFrame({"shingle": shingle_set(t, width).view(np.int64)})

    chosen = F.pmod(F.xxhash64(F.lit(5), "node"), F.lit(1_000_000)) < int(1_000_000 * min(1.0, SAMPLE / max(crowd.count(), 1)))
    sample = texts.filter(chosen).join(crowd.select("node"), "node", "left_semi")
    counted = sample.select("text").mapInPandas(shingles, "shingle long").groupBy("shingle").count().filter("count > 1")
    common = counted.orderBy(F.desc("count"), "shingle").limit(COMMON).toPandas().sort_values("shingle")
    known, often = common["shingle"].to_numpy(np.int64), common["count"].to_numpy(np.int64)

    def postings(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 200):
                part = batch.iloc[at : at + 200]
                rarest = []
                for t in part["text"]:
                    s = shingle_set(t, width).view(np.int64)
                    i = np.minimum(np.searchsorted(known, s), max(len(known) - 1, 0))
                    rank = np.where(known[i] == s, often[i], 0) if len(known) else np.zeros(len(s), np.int64)
                    rarest.append(s[np.lexsort((s, rank))[: len(s) + percent * -len(s) // 100 + 1]])
                each = [len(r) for r in rarest]
                low = np.repeat(np.array(_low(part["signature"]), object), each)
                yield pd.DataFrame({"shingle": np.concatenate(rarest), **{c: np.repeat(part[c].to_numpy(), each) for c in ("node", "part", "n")}, "low": low})

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come sorted by shingle; a list that a batch may have cut waits for the next."""
        held: list[pd.DataFrame] = []

        def done() -> Iterator[pd.DataFrame]:
            rows = pd.concat(held, ignore_index=True)
            shingle, part = rows["shingle"].to_numpy(), rows["part"].to_numpy()
            starts = np.flatnonzero(np.concatenate([[True], shingle[1:] != shingle[:-1]]))
            lengths = np.diff(np.append(starts, len(rows)))
            mixed = np.minimum.reduceat(part, starts) != np.maximum.reduceat(part, starts)
            keep = np.flatnonzero(np.repeat(mixed, lengths))
            if not len(keep):
                return
            lengths = lengths[mixed]
            starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
            nodes, sizes, part, shingle = rows["node"].to_numpy()[keep], rows["n"].to_numpy()[keep], part[keep], shingle[keep]
            estimates = Estimates(rows["low"].to_numpy()[keep], hashes)
            short = np.repeat(lengths <= SHORT, lengths)
            for d in range(1, min(SHORT, len(keep))):
                i = np.flatnonzero(short[d:] & (shingle[d:] == shingle[:-d]) & (part[d:] != part[:-d]))
                i = i[100 * np.minimum(sizes[i], sizes[i + d]) >= percent * np.maximum(sizes[i], sizes[i + d])]
                i = i[estimates.at_least(i, i + d, least)]
                yield pd.DataFrame({"a": nodes[i], "b": nodes[i + d]})
            for s, n in zip(starts[lengths > SHORT], lengths[lengths > SHORT], strict=True):
                links = np.array(part_links(part, sizes, estimates, np.arange(s, s + n), percent, least), int).reshape(-1, 2)
                yield pd.DataFrame({"a": nodes[links[:, 0]], "b": nodes[links[:, 1]]})

        for batch in batches:
            if not len(batch):
                continue
            shingle = batch["shingle"].to_numpy()
            if held and held[-1]["shingle"].iloc[-1] != shingle[0]:
                yield from done()
                held = []
            tail = int(np.flatnonzero(shingle == shingle[-1])[0])
            if tail:
                held.append(batch.iloc[:tail])
                yield from done()
                held = []
            held.append(batch.iloc[tail:])
        if held:
            yield from done()

    posted = texts.join(crowd.select("node", "part", F.col("n_shingles").alias("n"), "signature"), "node").mapInPandas(postings, "shingle long, node long, part long, n long, low binary")
    lists = posted.repartition("shingle").sortWithinPartitions("shingle", "node")
    pairs = lists.mapInPandas(compare, "a long, b long")
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def connected(links: DataFrame) -> DataFrame:
    """(node, root): smallest reachable node for every node of links (a, b), by alternating large-star and small-star steps.

    Each step is one grouped minimum (summed in the map tasks) and one join on the node, which a node of very many links does
    not send into one task.  Steps go on until nothing changes; their number grows with the logarithm of a path's length.
    """
    edges = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    before = None
    for _ in range(ROUNDS):
        state = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == before or state[0] == 0:
            return edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))
        before = state
        # Links never grow in number, so tables that have become small are read and written by few tasks.
        tasks = max(1, -(-state[0] // ROWS))
        edges = edges.coalesce(tasks)
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        met = join_counted(both, least, "u", "n", 2 * state[0]).filter("v > u")
        large = cut(met.select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct().coalesce(tasks))
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = join_counted(large, least, "u", "n", state[0]).select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = cut(small.unionByName(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct().coalesce(tasks))
    raise RuntimeError(f"components not settled after {ROUNDS} rounds")


class Sets:
    """Shingle sets of many nodes in one code space, and which of a choice are similar enough to one of them."""

    def __init__(self, sets: list[np.ndarray], lows: list[bytes], hashes: int, percent: int, least: float):
        self.sizes = np.array([len(s) for s in sets])
        _, codes = np.unique(np.concatenate(sets), return_inverse=True)
        self.pieces = np.split(codes, np.cumsum(self.sizes)[:-1])
        self.mark = np.zeros(int(codes.max()) + 1, bool)
        self.estimates, self.percent, self.least = Estimates(lows, hashes), percent, least

    def linked(self, p: int, others: np.ndarray) -> np.ndarray:
        """Those of others with 100 * intersection >= percent * union: of comparable size, then by estimate, then by full sets."""
        n = self.sizes
        near = others[100 * np.minimum(n[others], n[p]) >= self.percent * np.maximum(n[others], n[p])]
        near = near[self.estimates.at_least(near, p, self.least)]
        if not len(near):
            return near
        self.mark[self.pieces[p]] = True
        ends = np.cumsum(n[near])
        common = np.add.reduceat(self.mark[np.concatenate([self.pieces[x] for x in near])], ends - n[near], dtype=np.int64)
        self.mark[self.pieces[p]] = False
        return near[100 * common >= self.percent * (n[near] + n[p] - common)]


def exact_links(sets: Sets) -> list[tuple[int, int]]:
    """A spanning forest, as places, of all links: breadth first over nodes not yet linked."""
    left, out = np.arange(len(sets.sizes)), []
    while len(left):
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            p = queue.pop()
            hit = sets.linked(p, left)
            out += [(p, x) for x in hit.tolist()]
            queue += hit.tolist()
            left = np.setdiff1d(left, hit, assume_unique=True)
    return out


def cross_links(sets: Sets, part: np.ndarray, asked: np.ndarray) -> list[tuple[int, int]]:
    """Links, as places, that join the parts of the places ``asked`` with those of all others."""
    label, out = np.unique(part, return_inverse=True)[1], []
    for p in asked.tolist():
        for x in sets.linked(p, np.flatnonzero(label != label[p])).tolist():
            if label[x] != label[p]:
                out.append((p, x))
                label[label == label[x]] = label[p]
    return out


def _solved(rows: DataFrame, width: int, percent: int, hashes: int, least: float) -> DataFrame:
    """(a, b): links of the rows (task, node, part, asked, signature, text) of one task; of those asked only, where any is."""

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come sorted by task, so one task's sets are all that is held."""
        key, held = None, {}

        def done() -> pd.DataFrame:
            names = np.array(list(held))
            sets = Sets([h[0] for h in held.values()], [h[1] for h in held.values()], hashes, percent, least)
            asked = np.flatnonzero([h[3] for h in held.values()])
            links = cross_links(sets, np.array([h[2] for h in held.values()]), asked) if len(asked) else exact_links(sets)
            places = np.array(links, int).reshape(-1, 2)
            return pd.DataFrame({"a": names[places[:, 0]], "b": names[places[:, 1]]})

        for batch in batches:
            for task, node, part, asked, signature, t in zip(*(batch[c] for c in ("task", "node", "part", "asked", "signature", "text")), strict=True):
                if task != key:
                    if len(held) > 1:
                        yield done()
                    key, held = task, {}
                held[node] = shingle_set(t, width), _low([signature])[0], part, asked or (node in held and held[node][3])
        if len(held) > 1:
            yield done()

    dealt = rows.repartition("task").sortWithinPartitions("task")
    return dealt.select("task", "node", "part", "asked", "signature", "text").mapInPandas(solve, "a long, b long")


def confirmed_links(texts: DataFrame, members: DataFrame, width: int, percent: int, hashes: int, least: float, block: int) -> DataFrame:
    """(node, root): components of the exact links inside candidate clusters (node, root, n_shingles, signature) with texts (node, text)."""
    load = members.groupBy("root").agg(F.sum("n_shingles").alias("load"), F.count("*").alias("n"))
    load = load.select("root", "n", F.col("n").alias("size"), F.greatest(F.ceil(F.col("load") / block), F.lit(1)).cast("int").alias("blocks"))
    placed = cut(join_counted(members, load, "root", "n", members.count()).withColumn("mine", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")))
    guest = (F.col("blocks") > 1) & (F.pmod(F.xxhash64(F.lit(GUESTS), "node"), F.col("size")) < GUESTS)
    where = F.when(guest, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("mine"))
    alone = texts.join(placed, "node").withColumn("block", F.explode(where))
    alone = alone.withColumn("task", F.xxhash64("root", "block")).withColumn("part", F.lit(0).cast("long")).withColumn("asked", F.lit(False))
    links = cut(_solved(alone, width, percent, hashes, least))
    roots = cut(connected(links))
    parts = roots.withColumnRenamed("root", "part")
    large = placed.filter("blocks > 1").drop("mine").join(parts, "node", "left").withColumn("part", F.coalesce("part", "node"))
    sizes = large.groupBy("root", "part").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("load"))
    best = F.max(F.struct("n", "part", "load"))
    open_ = sizes.groupBy("root").agg(F.sum("n").alias("n"), best.alias("best"), F.sum("load").alias("load"), F.count("*").alias("parts")).filter("parts > 1")
    open_ = cut(open_.select("root", "n", F.col("best.part").alias("main"), F.greatest(F.ceil((F.col("load") - F.col("best.load")) / block), F.lit(1)).cast("int").alias("others")))
    if not open_.head(1):
        return roots
    # Nodes outside a cluster's largest part meet all of its blocks; nodes of that part have no link to find among themselves.
    left = join_counted(cut(large), open_, "root", "n", placed.count()).withColumn("asked", F.col("part") != F.col("main"))
    x, y = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"), F.pmod(F.xxhash64(F.lit(1), "node"), F.col("others")).cast("int")
    left = cut(left.withColumn("x", x).withColumn("y", y))
    met = left.withColumn("asked", F.lit(False)).withColumn("y", F.explode(F.sequence(F.lit(0), F.col("others") - 1)))
    met = met.unionByName(left.filter("asked").withColumn("x", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))))
    tasks = met.select("node", "part", "asked", "signature", F.xxhash64("root", "x", "y").alias("task"))
    more = _solved(texts.join(tasks, "node"), width, percent, hashes, least)
    return connected(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80, hashes: int = 80, trees: int = 20, depth: int = 3, reach: int = 8, block: int = 100_000, seed: int = 7) -> DataFrame:
    """(id, text_key, n_shingles, component_id, kept, first) for every row of docs.

    component_id is the smallest id of a component, kept whether it is the row's own; first holds for one id and text of each
    component, and for all rows that are in none.  text_key is xxhash64 of the text, which tells rows of one id apart.
    depth minima must agree, which a pair at the threshold does in a tree with chance 0.8**3; reach says how much the forest
    compares itself, and what lies further apart is a crowd's.  The estimate's floor lies four standard deviations below the
    threshold.  hashes must be even.
    """
    rows = cut(sketch(docs, id_col, text, width, hashes, seed))
    full = rows.filter(F.col("set_key").isNotNull() & F.col("id").isNotNull())
    classes = full.groupBy("set_key").agg(F.min(F.struct("id", "text_key")).alias("rep"), F.count("*").alias("n_rows"))
    classes = classes.select("set_key", "n_rows", "rep.id", "rep.text_key")
    nodes = full.join(classes, ["set_key", "id", "text_key"]).dropDuplicates(["set_key", "id", "text_key"])
    nodes = cut(nodes.select(F.monotonically_increasing_id().alias("node"), "set_key", "n_rows", "id", "text_key", "n_shingles", "signature"))
    agree = percent / 100 + (1 - percent / 100) / 16  # of four bits
    least = percent / 100 - 4 * (agree * (1 - agree) / hashes) ** 0.5 * 16 / 15
    links = cut(forest_links(nodes, hashes, trees, depth, reach, least))
    parts = cut(connected(links.filter("a <> b").select("a", "b")))
    crowd = crowded_nodes(links.filter("run IS NOT NULL").select(F.col("a").alias("node"), "run"), parts)
    crowd = cut(nodes.join(crowd, "node").join(parts, "node", "left").withColumn("part", F.coalesce("root", "node")).select("node", "part", "n_shingles", "signature"))
    # All texts meet the nodes once; what comes after works on those that may have a partner.
    wanted = parts.select("node").union(parts.select("root")).union(crowd.select("node")).distinct()
    places = nodes.select("node", "id", "text_key").join(wanted, "node")
    texts = stored(_texts(docs, id_col, text).join(places, ["id", "text_key"]).select("node", "text"))
    more = crowd_links(texts, crowd, width, percent, hashes, least)
    clusters = cut(connected(parts.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more)))
    members = clusters.unionByName(clusters.select(F.col("root").alias("node"), "root").distinct())
    members = cut(members.join(nodes.select("node", "n_shingles", "signature"), "node"))
    roots = confirmed_links(texts, members, width, percent, hashes, least, block)
    placed = cut(nodes.select("node", "set_key", "n_rows", "id", "text_key").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")))
    named = placed.groupBy("root").agg(F.min(F.struct("id", "text_key")).alias("head"), F.count("*").alias("n"))
    classes = cut(join_counted(placed.select("root", "set_key", "n_rows"), named, "root", "n", placed.count()).drop("root"))
    linked = join_counted(full.select("id", "text_key", "n_shingles", "set_key"), classes, "set_key", "n_rows", full.count())
    linked = linked.withColumn("component_id", F.col("head.id")).withColumn("first", F.struct("id", "text_key") == F.col("head"))
    alone = rows.filter(F.col("set_key").isNull() | F.col("id").isNull()).withColumn("component_id", F.col("id")).withColumn("first", F.lit(True))
    columns = ["id", "text_key", "n_shingles", "component_id", "first"]
    out = linked.select(columns).unionByName(alone.select(columns))
    kept = F.coalesce(F.col("id") == F.col("component_id"), F.lit(True))
    return out.select(F.col("id").alias(id_col), "text_key", "n_shingles", "component_id", kept.alias("kept"), "first")
