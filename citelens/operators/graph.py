"""Similarity graphs: edges (src < dst) with one column a kind of evidence."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citelens.sources.tables import cut, stored, unstored

KINDS = ("cocitation", "bibcoupling", "citation", "textsimilarity")


def build(citations: DataFrame, cocited: DataFrame, coupled: DataFrame) -> DataFrame:
    """Union of the three kinds of edge, merged per pair."""
    def pairs(df: DataFrame, a: str, b: str, kind: str, value: Column) -> DataFrame:
        return df.filter(F.col(a) != F.col(b)).select(F.least(a, b).alias("src"), F.greatest(a, b).alias("dst"), value.cast("double").alias(kind))

    e = pairs(cocited, "cited_1", "cited_2", "cocitation", F.col("total")).unionByName(pairs(coupled, "citing_1", "citing_2", "bibcoupling", F.col("total")), True).unionByName(pairs(citations, "id_out", "id_in", "citation", F.lit(1)), True)
    return e.groupBy("src", "dst").agg(*(F.max(k).alias(k) for k in KINDS[:3]))


def similarity(edges: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    w = weights or {"bibcoupling": 3, "cocitation": 10, "citation": 1, "textsimilarity": 20}
    out = F.lit(0.0)
    for kind, weight in w.items():
        if kind in edges.columns:
            out = out + weight * F.coalesce(kind, F.lit(0.0))
    return edges.withColumn("similarity", out)


def both_ways(edges: DataFrame, weight: str = "similarity") -> DataFrame:
    """(node, other, weight): each edge from both its ends, in one pass over the edges."""
    ends = F.array(F.struct(F.col("src").alias("node"), F.col("dst").alias("other")), F.struct(F.col("dst").alias("node"), F.col("src").alias("other")))
    return edges.select(F.inline(ends), F.col(weight).alias("weight"))


def degrees(edges: DataFrame, weight: str = "similarity") -> DataFrame:
    """(node, degree, size): size is the degree over the largest, rescaled to 0.3 to 1.3."""
    d = both_ways(edges, weight).groupBy("node").agg(F.count("*").alias("degree"))
    ends = d.agg(F.min("degree").alias("low"), F.max("degree").alias("high"))
    share = (F.col("degree") - F.col("low")) / F.nullif(F.col("high") - F.col("low"), F.lit(0))
    return d.crossJoin(F.broadcast(ends)).select("node", "degree", (F.coalesce(share, F.lit(0.0)) + 0.3).alias("size"))


def similar(edges: DataFrame, paper: int, n: int = 200) -> DataFrame:
    return both_ways(edges).filter(F.col("node") == paper).orderBy(F.desc("weight"), "other").limit(n).select(F.col("other").alias("id"), F.col("weight").alias("similarity"))


def topic_subgraph(edges: DataFrame, topics: DataFrame, comp: int) -> DataFrame:
    mine = topics.filter(F.col("comp") == comp).select("id")
    e = edges.join(mine.withColumnRenamed("id", "src"), "src", "left_semi")
    return e.join(mine.withColumnRenamed("id", "dst"), "dst", "left_semi").select(edges.columns)


def sparsify(edges: DataFrame, k: int, weight: str = "similarity") -> DataFrame:
    """An edge stays if it is among the k strongest of both its ends, or the strongest of one.

    The order-dependent greedy rule (nodes by degree, each taking edges to nodes that still have room) is replaced by its
    order-free form: rank edges at both ends, keep those of rank <= k at both, and every node's strongest edge.
    """
    w = Window.partitionBy("node").orderBy(F.desc("weight"), F.desc("other"))
    ranked = both_ways(edges, weight).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
    ends = ranked.groupBy(F.least("node", "other").alias("src"), F.greatest("node", "other").alias("dst")).agg(F.count("*").alias("ends"), F.min("rank").alias("best"), F.max("weight").alias(weight))
    return ends.filter((F.col("ends") == 2) | (F.col("best") == 1)).select("src", "dst", weight)


def greedy_sparsify(edges: DataFrame, k: int, weight: str = "similarity") -> DataFrame:
    """The sequential rule, exactly: nodes by (degree, id) from the greatest on each propose their k strongest edges (ties to the
    greater neighbour), and one is taken unless it is there already or its other end has k edges by then; a node left without
    an edge gets its strongest.

    What happens in the sequence follows from a few facts, so it needs no sequence:
    - Before its own turn a node only receives, so of the proposals that reach it earlier than its turn the first k are taken.
    - Its edges after its turn are those, and its own proposals that were taken; with k of them it takes no later one.
    - Otherwise the first of the later proposals are taken, as many as it has room for, and its room depends only on its own
      proposals to nodes before it.
    Those last are settled in rounds: a proposal is taken once its place among the later ones is within the room that is certain,
    refused once it is beyond the room that is possible.  Every round settles at least all proposals to the first node that has
    unsettled ones, so it ends with nothing left; chains are short, for most nodes are full or have no proposal of that kind.
    """
    both = both_ways(cut(edges.filter("src <> dst").select("src", "dst", weight)), weight)
    degree = both.groupBy("node").agg(F.count("*").alias("degree"))
    strongest = Window.partitionBy("node").orderBy(F.desc("weight"), F.desc("other"))
    mine = both.withColumn("place", F.row_number().over(strongest)).filter(F.col("place") <= k)
    asks = mine.join(degree, "node").join(degree.select(F.col("node").alias("other"), F.col("degree").alias("other_degree")), "other")
    asks = cut(asks.select("node", "other", "weight", "place", "degree", (F.struct("degree", "node") > F.struct("other_degree", "other")).alias("first")))
    turn = Window.partitionBy("other").orderBy(F.desc("degree"), F.desc("node"))
    taken = cut(asks.filter("first").withColumn("nth", F.row_number().over(turn)).filter(F.col("nth") <= k).select("node", "other", "weight"))
    ends = taken.select(F.explode(F.array("node", "other")).alias("other")).groupBy("other").agg(F.count("*").alias("held"))
    there = taken.select(F.col("node").alias("other"), F.col("other").alias("node"))
    late = asks.filter("not first").join(there, ["node", "other"], "left_anti").join(ends, "other", "left").withColumn("room", k - F.coalesce("held", F.lit(0)))
    late = late.filter("room > 0").withColumn("nth", F.row_number().over(turn))
    late = cut(late.select("node", "other", "weight", "room", "nth", F.lit(None).cast("boolean").alias("taken")))
    while late.filter("taken is null").head(1):
        own = late.groupBy(F.col("node").alias("other")).agg(F.count_if("taken").alias("sure"), F.count_if(F.coalesce("taken", F.lit(True))).alias("most"))
        settled = late.join(own, "other", "left").na.fill(0, ["sure", "most"])
        verdict = F.when(F.col("nth") <= F.col("room") - F.col("most"), True).when(F.col("nth") > F.col("room") - F.col("sure"), False)
        late = stored(settled.select("node", "other", "weight", "room", "nth", F.coalesce("taken", verdict).alias("taken")))
    kept = taken.unionByName(late.filter("taken").select("node", "other", "weight"))
    reached = kept.select(F.explode(F.array("node", "other")).alias("node")).distinct()
    alone = asks.filter("place = 1").join(reached, "node", "left_anti").select("node", "other", "weight")
    return kept.unionByName(alone).select(F.least("node", "other").alias("src"), F.greatest("node", "other").alias("dst"), F.col("weight").alias(weight))


def transition_weights(edges: DataFrame, p: float = 5.0, q: float = 2.0, weight: str = "similarity") -> DataFrame:
    """(prev, node, next, probability): second-order walk weights, 1/p back, 1/q away from prev's neighbours, else 1."""
    met = _met_lists(cut(edges.select("src", "dst", F.col(weight).alias("similarity"))))
    both = F.array_intersect(F.transform("near", lambda x: x["other"]), "known")
    met = met.select("prev", "node", "near", both.alias("both"))
    w = F.transform("near", lambda x: F.struct(x["other"].alias("next"), (x["weight"] * F.when(x["other"] == F.col("prev"), 1 / p).when(~F.array_contains("both", x["other"]), 1 / q).otherwise(1.0)).alias("w")))
    met = met.select("prev", "node", w.alias("moves")).withColumn("whole", F.aggregate("moves", F.lit(0.0), lambda t, x: t + x["w"]))
    return met.select("prev", "node", "whole", F.inline("moves").alias("next", "w")).select("prev", "node", "next", (F.col("w") / F.col("whole")).alias("probability"))


def _met_lists(edges: DataFrame) -> DataFrame:
    """(prev, node, near, known): each edge both ways with node's neighbours (other, weight) and the ids of prev's.

    Both are joined as lists, so a path of two edges is shuffled once, without its ends; partitioned by prev.
    """
    e = both_ways(edges)
    lists = e.groupBy("node").agg(F.collect_list(F.struct("other", "weight")).alias("near"))
    met = e.select(F.col("node").alias("prev"), F.col("other").alias("node")).join(lists, "node")
    return met.join(lists.select(F.col("node").alias("prev"), F.transform("near", lambda x: x["other"]).alias("known")), "prev")


def _regions(links: DataFrame, most: int, rounds: int = 4, levels: int = 6) -> DataFrame:
    """(node, region, n, open): connected nodes under the least id that reached them, n of them; open where a link leaves it.

    In each of a few rounds a region takes the least label of its neighbours, and then what that region itself took; regions with
    one label are contracted, and the links left between them are the next level's, until none is left.  No region joins a
    label of more than ``most`` nodes.
    """
    regions, ties = links.select("node", F.col("node").alias("region")).distinct(), links.select(F.col("node").alias("a"), F.col("other").alias("b"))
    for level in range(levels):
        sizes = regions.groupBy("region").agg(F.count("*").alias("n"))
        labels = stored((sizes if level == 0 else sizes.join(ties.select(F.col("a").alias("region")).distinct(), "region", "left_semi")).select("region", "n", F.col("region").alias("label")))
        for _ in range(rounds):
            near = ties.join(labels.select(F.col("region").alias("b"), "label"), "b").groupBy(F.col("a").alias("region")).agg(F.min("label").alias("near"))
            found = labels.join(near, "region").select("region", "n", F.col("label").alias("held"), F.least("label", "near").alias("label"))
            ahead = labels.select(F.col("region").alias("label"), F.col("label").alias("ahead"))
            found = found.join(ahead, "label").select("region", "n", "held", F.least("label", "ahead").alias("label"))
            full = found.groupBy("label").agg(F.sum("n").alias("whole")).filter(F.col("whole") > most).select("label", F.lit(True).alias("full"))
            labels = stored(found.join(full, "label", "left").select("region", "n", F.when(F.col("full"), F.col("held")).otherwise(F.col("label")).alias("label")))
        regions = stored(regions.join(labels.select("region", "label"), "region", "left").select("node", F.coalesce("label", "region").alias("region")))
        ends = links.join(regions, "node").join(regions.select(F.col("node").alias("other"), F.col("region").alias("b")), "other")
        ties = stored(ends.filter("region <> b").select(F.col("region").alias("a"), "b").distinct())
        if not ties.head(1):
            break
    sizes = regions.groupBy("region").agg(F.count("*").alias("n")).join(ties.select(F.col("a").alias("region"), F.lit(True).alias("open")).distinct(), "region", "left")
    return regions.join(sizes.na.fill(False, ["open"]), "region").select("node", "region", "n", "open")


def random_walks(edges: DataFrame, nodes: DataFrame, walks: int = 50, length: int = 30, p: float = 5.0, q: float = 2.0, seed: int = 0, weight: str = "similarity", most: int = 100_000) -> DataFrame:
    """(walker, walk array): biased walks of at most ``length`` nodes; a node without edges walks alone.

    Nodes lie in blocks by region of connected ones, and a task takes walkers of a block on until they end or leave it: small
    regions share a block, and the walkers of a large one are dealt over up to 20 tasks, each with the region's lists.  Only a
    component of more than ``most`` nodes has several regions; walkers that leave one meet that of their next node in the next
    round, with the neighbours of the node they come from.  So a step costs no shuffle.  The draw is the least -log(u) / w with
    u hashed from (seed, walker, step, neighbour), and walks depend on neither blocks nor partitions.  Meant for sparsified
    graphs, whose lists are short.
    """
    links = cut(both_ways(edges, weight))
    kind = dict(links.dtypes)["node"]
    regions = cut(_regions(links, most))
    blocks = F.lit(max(1, -(-regions.count() // 500)))
    large = F.col("n") > 1000
    block = F.when(large, F.xxhash64("region")).otherwise(F.pmod(F.xxhash64("region"), blocks))
    parts = F.when(large, F.ceil(F.col("n") / F.greatest(F.lit(1000.0), F.col("n") / 20))).otherwise(1).cast("int")
    placed = cut(regions.select("node", "open", large.alias("large"), block.alias("block"), parts.alias("parts")))
    key = lambda c: F.col(c) if kind == "bigint" else F.xxhash64(c)
    lists = links.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("other", "weight", key("other").alias("key")))).alias("near")).join(placed, "node")
    starts = nodes.select("id", F.xxhash64(F.lit(seed), "id").alias("start"))  # a walker's number is this hash taken on
    lists = lists.select("*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    mine = starts.join(placed.withColumnRenamed("node", "id"), "id").select(F.col("id").alias("node"), F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"), "start")
    task = ["open", "large", "block", "part"]
    homes = cut(lists.join(mine, ["node", "part"], "left").select(*task, "node", "near", "start"))
    alone = starts.join(placed.select(F.col("node").alias("id")), "id", "left_anti").select(F.array("id").alias("walk"), F.explode(F.transform(F.sequence(F.lit(1), F.lit(walks)), lambda n: F.xxhash64(F.lit(seed), "id", n))).alias("walker"))
    schema = f"walker long, walk array<{kind}>, before array<{kind}>"

    def begun(homes: pa.Table) -> pa.Table:
        start = homes.column("start").combine_chunks()
        at = np.repeat(np.flatnonzero(start.is_valid().to_numpy(zero_copy_only=False)), walks)
        walk = pa.ListArray.from_arrays(np.arange(len(at) + 1, dtype=np.int32), homes.column("node").combine_chunks().take(pa.array(at)))
        with np.errstate(over="ignore"):
            walker = _hashed(start.fill_null(0).to_numpy()[at].view(_U), np.resize(np.arange(1, walks + 1, dtype=_U), len(at)), 4)
        return _walked(length, p, q, seed, homes, pa.array(walker.view(np.int64)), walk, None)

    def resumed(homes: pa.Table, left: pa.Table) -> pa.Table:
        if not len(left):
            return left.select(["walker", "walk", "before"])
        return _walked(length, p, q, seed, homes, *(left.column(c).combine_chunks() for c in ("walker", "walk", "before")))

    done = [homes.filter("not open").groupBy(*task).applyInArrow(begun, schema), alone.select("walker", "walk").withColumn("before", F.lit(None).cast(f"array<{kind}>"))]
    if homes.filter("open").head(1):
        state = stored(homes.filter("open").groupBy(*task).applyInArrow(begun, schema))
        while state.filter("before is not null").head(1):
            done.append(state.filter("before is null"))
            left = state.filter("before is not null").join(placed.withColumnRenamed("node", "last"), F.element_at("walk", -1) == F.col("last"))
            left = left.select("*", F.pmod(F.xxhash64("walker"), F.col("parts")).cast("int").alias("part")).select(*task, "walker", "walk", "before")
            state = stored(homes.filter("open").drop("start").groupBy(*task).cogroup(left.groupBy(*task)).applyInArrow(resumed, schema))
        done.append(state)
    return reduce(DataFrame.unionByName, done).select("walker", "walk")


_U = np.uint64
_P1, _P2, _P3, _P4, _P5 = map(_U, (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _turned(x: np.ndarray, n: int) -> np.ndarray:
    return (x << _U(n)) | (x >> _U(64 - n))


def _hashed(before: np.ndarray, word: np.ndarray, size: int) -> np.ndarray:
    """xxhash64 going on from ``before`` with whole numbers of 4 or 8 bytes, as the SQL function of the name has it."""
    h = before + _P5 + _U(size)
    if size == 8:
        h = _turned(h ^ (_turned(word * _P2, 31) * _P1), 27) * _P1 + _P4
    else:
        h = _turned(h ^ (word * _P1), 23) * _P2 + _P3
    h = (h ^ (h >> _U(33))) * _P2
    h = (h ^ (h >> _U(29))) * _P3
    return h ^ (h >> _U(32))


def _walked(length: int, p: float, q: float, seed: int, homes: pa.Table, walker: pa.Array, walk: pa.ListArray, before: pa.ListArray | None) -> pa.Table:
    """Walkers taken on within a block (node, near (other, weight, key)): before is null where a walk ended, else the neighbours
    of the last node but one."""
    near = homes.column("near").combine_chunks()
    node, other = homes.column("node").combine_chunks(), near.flatten().field("other")
    known = [node, other, walk.flatten()] + ([before.flatten()] if before is not None else [])
    coded = pa.chunked_array(known).combine_chunks().dictionary_encode()
    names, code = coded.dictionary, np.split(coded.indices.to_numpy().astype(np.int64), np.cumsum([len(k) for k in known])[:-1])
    m, own, far = len(names), code[0], code[1]
    size, first = np.zeros(m, np.int64), np.zeros(m, np.int64)
    size[own] = near.value_lengths().to_numpy()
    first[own] = np.cumsum(size[own]) - size[own]
    weight = near.flatten().field("weight").to_numpy().astype(np.float64)
    word = near.flatten().field("key").to_numpy().astype(np.int64).view(_U)
    links = np.sort(np.repeat(own, size[own]) * m + far)
    n, at = len(walker), walk.value_lengths().to_numpy().astype(np.int64)
    row = np.repeat(np.arange(n), at)
    path = np.full((n, length), -1, np.int32)
    path[row, np.arange(len(row)) - np.repeat(np.cumsum(at) - at, at)] = code[2]
    brought = np.sort(np.repeat(np.arange(n), before.value_lengths().to_numpy()) * m + code[3]) if before is not None else links[:0]
    start = _hashed(_hashed(np.full(1, 42, _U), np.array([seed & 0xFFFFFFFF], _U), 4), walker.to_numpy().view(_U), 8)
    step = max(1, min(8192, 2_000_000 // max(int(size.max(initial=0)), 1)))
    with np.errstate(over="ignore", divide="ignore"):
        for low in range(0, n, step):
            i = np.arange(low, min(low + step, n))
            i = i[at[i] < length]
            while len(i):
                cur = path[i, at[i] - 1].astype(np.int64)
                prev = np.where(at[i] > 1, path[i, np.maximum(at[i] - 2, 0)], -1).astype(np.int64)
                many = size[cur]
                begin = np.cumsum(many) - many
                who = np.repeat(np.arange(len(i)), many)
                flat = np.arange(len(who)) + np.repeat(first[cur] - begin, many)
                x, came = far[flat], prev[who]
                met = _among(links, came * m + x)
                strange = (came >= 0) & (size[came] == 0)
                if strange.any():
                    met[strange] = _among(brought, i[who[strange]] * m + x[strange])
                bias = np.where(met, 1.0, 1 / q)
                bias[x == came] = 1 / p
                bias[came < 0] = 1.0
                h = _hashed(_hashed(start[i], at[i].astype(_U), 4)[who], word[flat], 8)
                score = -np.log(((h & _U((1 << 40) - 1)).astype(np.float64) + 1) / float((1 << 40) + 1)) / (weight[flat] * bias)
                best = np.flatnonzero(score == np.repeat(np.minimum.reduceat(score, begin), many))
                best = best[np.diff(who[best], prepend=-1) > 0]
                path[i, at[i]] = x[best]
                at[i] += 1
                i = i[(at[i] < length) & (size[x[best]] > 0)]
    last = path[np.arange(n), at - 1]
    leaving = (at < length) & (size[last] == 0)
    prev = path[np.arange(n), at - 2].astype(np.int64)[leaving]
    many = size[prev]
    held = np.arange(many.sum()) + np.repeat(first[prev] - (np.cumsum(many) - many), many)
    ends = np.zeros(n + 1, np.int32)
    ends[1:][leaving] = many
    lists = pa.ListArray.from_arrays(pa.array(np.cumsum(ends, dtype=np.int32), mask=np.append(~leaving, False)), other.take(pa.array(held)))
    taken = names.take(pa.array(path[np.arange(length) < at[:, None]]))
    walk = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(at)]).astype(np.int32), taken)
    return pa.table({"walker": walker, "walk": walk, "before": lists})


def _among(ordered: np.ndarray, x: np.ndarray) -> np.ndarray:
    if not len(ordered):
        return np.zeros(len(x), bool)
    return ordered[np.minimum(np.searchsorted(ordered, x), len(ordered) - 1)] == x


def page_rank(edges: DataFrame, nodes: DataFrame, damping: float = 0.85, rounds: int = 10, weight: str = "weight") -> DataFrame:
    """(id, rank) on undirected weighted edges (src, dst); dangling mass is spread evenly.  A fixed number of rounds."""
    e = both_ways(edges, weight)
    out = cut(e.withColumn("share", F.col("weight") / F.sum("weight").over(Window.partitionBy("node"))).select("node", "other", "share"))
    n = nodes.count()
    ranks = nodes.select("id", F.lit(1.0 / max(n, 1)).alias("rank"))
    for turn in range(rounds):
        given = ranks.join(out, F.col("id") == F.col("node")).groupBy("other").agg(F.sum(F.col("rank") * F.col("share")).alias("got"))
        got = nodes.select("id").join(given, F.col("id") == F.col("other"), "left").select("id", F.coalesce("got", F.lit(0.0)).alias("got"))
        lost = got.agg((1.0 - F.sum("got")).alias("lost"))
        ranks = got.crossJoin(F.broadcast(lost)).select("id", ((1 - damping) / n + damping * (F.col("got") + F.col("lost") / n)).alias("rank"))
        ranks = cut(ranks) if turn % 5 == 4 else ranks
    return ranks


def page_rank_by_cut(edges: DataFrame, nodes: DataFrame, cuts: list[int], **options) -> DataFrame:
    """(id, cut, rank): page_rank of the edges (src, dst, weight, year) up to each of a few cut-off years."""
    def upto(year: int) -> DataFrame:
        e = edges.filter(F.col("year") <= year).groupBy("src", "dst").agg(F.sum("weight").alias("weight"))
        return page_rank(e, nodes, **options).select("id", F.lit(year).alias("cut"), "rank")

    return reduce(DataFrame.unionByName, map(upto, cuts))


def ego_components(edges: DataFrame) -> DataFrame:
    """(ego, node, comp): components of each node's neighbourhood without the node, by smallest label.

    Meant for sparsified graphs, whose neighbourhoods are small: one is a row, and its components are found there at once, so no
    state is written and read in rounds.
    """
    met = _met_lists(cut(edges.select("src", "dst", "similarity")))
    ties = F.array_intersect(F.transform("near", lambda x: x["other"]), "known")
    egos = met.select(F.col("prev").alias("ego"), "node", ties.alias("ties")).groupBy("ego").agg(F.collect_list(F.struct("node", "ties")).alias("members"))
    kind = dict(egos.dtypes)["ego"]
    return egos.mapInArrow(_components, f"ego {kind}, node {kind}, comp {kind}")


def _components(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (ego, members (node, ties)) as (ego, node, comp), by union of the ties of each row."""
    for batch in batches:
        members = batch.column("members")
        flat, sizes = members.flatten(), members.value_lengths().to_numpy(zero_copy_only=False)
        node, begin = flat.field("node"), 0
        ids, ties, comp = node.to_pylist(), flat.field("ties").to_pylist(), node.to_pylist()
        for size in sizes:
            end = begin + size
            if any(ties[begin:end]):
                root = {i: i for i in ids[begin:end]}
                for i in range(begin, end):
                    for other in ties[i]:
                        pair = []
                        for x in (ids[i], other):
                            while root[x] != x:
                                root[x] = x = root[root[x]]
                            pair.append(x)
                        root[max(pair)] = min(pair)
                for i in range(begin, end):
                    x = ids[i]
                    while root[x] != x:
                        x = root[x]
                    comp[i] = x
            begin = end
        ego = batch.column("ego").take(pa.array(np.repeat(np.arange(len(sizes)), sizes)))
        yield pa.RecordBatch.from_arrays([ego, node, pa.array(comp, node.type)], ["ego", "node", "comp"])


def personas(edges: DataFrame, weight: str = "similarity") -> DataFrame:
    """(src, dst, weight): every node split into one persona "node:comp" a component of its neighbourhood."""
    edges = cut(edges.select("src", "dst", weight))
    egos = cut(ego_components(edges.withColumnRenamed(weight, "similarity")))
    mine = egos.select(F.col("ego").alias("src"), F.col("node").alias("dst"), F.concat_ws(":", F.col("ego").cast("string"), F.col("comp").cast("string")).alias("a"))
    theirs = egos.select(F.col("ego").alias("dst"), F.col("node").alias("src"), F.concat_ws(":", F.col("ego").cast("string"), F.col("comp").cast("string")).alias("b"))
    return edges.join(mine, ["src", "dst"]).join(theirs, ["src", "dst"]).select(F.col("a").alias("src"), F.col("b").alias("dst"), weight)


def overlapping_communities(edges: DataFrame, rounds: int = 5, weight: str = "similarity", levels: bool = False) -> DataFrame:
    """(id, communities array): communities of the persona graph, folded back to the nodes; ids as strings.

    levels contracts communities until modularity gains no more, instead of one level of label moves."""
    split = personas(edges, weight)
    found = communities(cut(split), weight) if levels else label_communities(split, rounds, weight)
    return found.groupBy(F.substring_index("id", ":", 1).alias("id")).agg(F.array_sort(F.collect_set("community")).alias("communities"))


def _quality(nodes: DataFrame, within: float, whole: float, resolution: float) -> float:
    """Modularity of nodes (id, community, k, loop) whose links inside communities weigh ``within``, both ways."""
    sums = nodes.groupBy("community").agg(F.sum("k").alias("k"), F.sum("loop").alias("loop")).agg(F.sum(F.col("k") * F.col("k")), F.sum("loop")).first()
    return (within + sums[1]) / whole - resolution * sums[0] / whole**2


def _moved(links: DataFrame, nodes: DataFrame, whole: float, resolution: float, turn: int) -> DataFrame:
    """nodes after some of them (half, by a hash of the turn) went to the neighbouring community where modularity gains most, and
    ``within``, the weight of each node's links inside its community before.  Ties go to the smaller community, and a node
    stays where no other gains more.

    Of two single nodes that would change places only the greater may go to the smaller.
    """
    sizes = nodes.groupBy(F.col("community").alias("to")).agg(F.sum("k").alias("size"), F.count("*").alias("members"))
    mine = nodes.select(F.col("id").alias("node"), F.col("community").alias("own"), "k", "loop")
    there = nodes.select(F.col("id").alias("other"), F.col("community").alias("to"))
    votes = links.join(there, "other").groupBy("node", "to").agg(F.sum("w").alias("votes"))
    votes = votes.unionByName(mine.select("node", F.col("own").alias("to"), F.lit(0.0).alias("votes"))).groupBy("node", "to").agg(F.sum("votes").alias("votes"))
    own_size = sizes.select(F.col("to").alias("own"), F.col("members").alias("own_members"))
    scored = votes.join(mine, "node").join(sizes, "to").join(own_size, "own")
    stays = F.col("to") == F.col("own")
    gain = F.round(F.col("votes") - resolution * F.col("k") * (F.col("size") - F.when(stays, F.col("k")).otherwise(0.0)) / whole, 9)
    allowed = stays | ~((F.col("own_members") == 1) & (F.col("members") == 1) & (F.col("to") > F.col("own")))
    best = scored.filter(allowed).groupBy("node", "own", "k", "loop").agg(F.min(F.struct((-gain).alias("loss"), (~stays).alias("leaves"), "to")).alias("best"), F.max(F.when(stays, F.col("votes"))).alias("within"))
    may = F.pmod(F.xxhash64("node", F.lit(turn)), F.lit(2)) == 0
    return best.select(F.col("node").alias("id"), F.when(may, F.col("best.to")).otherwise(F.col("own")).alias("community"), "k", "loop", "within")


def community_levels(edges: DataFrame, weight: str = "similarity", resolution: float = 1.0, patience: int = 2, least: float = 1e-4) -> list[tuple[DataFrame, float]]:
    """[((id, community), modularity)]: from the first level to the last, of all nodes that edges (src, dst) name.

    In a level nodes move between communities in rounds, of which the best state is kept, until ``patience`` rounds in a row bring
    no more than ``least``; then each community becomes one node, the weights between two of them one link and those inside a loop, and
    the next level goes on from there.  It ends with the level that gains no more than ``least``, so modularity never falls and no number of rounds
    is set.  Contracted graphs are never larger, and shrink with the communities.
    """
    both = both_ways(edges, weight).select("node", "other", F.col("weight").cast("double").alias("w"))
    loops = both.filter("node = other").groupBy("node").agg(F.sum("w").alias("loop"))
    links = cut(both.filter("node <> other").groupBy("node", "other").agg(F.sum("w").alias("w")))
    strength = both.groupBy("node").agg(F.sum("w").alias("k"))
    nodes = cut(strength.join(loops, "node", "left").select(F.col("node").alias("id"), F.col("node").alias("community"), "k", F.coalesce("loop", F.lit(0.0)).alias("loop")))
    whole = nodes.agg(F.sum("k")).first()[0]
    if not whole:
        return [(nodes.select("id", "community"), 0.0)]
    names, levels, turn = nodes.select("id", F.col("id").alias("at")), [], 0
    best, quality = nodes, None
    while True:
        start, idle = quality, -1
        while idle < patience:
            after = stored(_moved(links, nodes, whole, resolution, turn))  # and the quality of nodes comes with it
            now, turn = _quality(nodes, after.agg(F.sum("within")).first()[0], whole, resolution), turn + 1
            start = now if start is None else start
            idle = 0 if quality is None or now > quality + least else idle + 1
            passed = nodes
            if quality is None or now > quality:
                passed, best, quality = best, nodes, now
            if passed is not best:
                unstored(passed)
            nodes = after.drop("within")
        unstored(nodes)  # the last state, which was no better
        names = stored(names.join(best.select(F.col("id").alias("at"), "community"), "at").select("id", F.col("community").alias("at")))
        levels.append((names.select("id", F.col("at").alias("community")), quality))
        if quality <= start + least:
            return levels
        mine = lambda end: best.select(F.col("id").alias(end), F.col("community").alias(f"c_{end}"))  # noqa: B023, E731
        joined = stored(links.join(mine("node"), "node").join(mine("other"), "other").groupBy(F.col("c_node").alias("node"), F.col("c_other").alias("other")).agg(F.sum("w").alias("w")))
        inside = joined.filter("node = other").select(F.col("node").alias("community"), F.col("w").alias("inside"))
        sums = best.groupBy("community").agg(F.sum("k").alias("k"), F.sum("loop").alias("loop"))
        nodes = stored(sums.join(inside, "community", "left").select(F.col("community").alias("id"), "community", "k", (F.col("loop") + F.coalesce("inside", F.lit(0.0))).alias("loop")))
        unstored(links, best)
        links, best = joined.filter("node <> other"), nodes


def communities(edges: DataFrame, weight: str = "similarity", resolution: float = 1.0) -> DataFrame:
    """(id, community): the last level's; a community is named by one of its nodes."""
    return community_levels(edges, weight, resolution)[-1][0]


def label_communities(edges: DataFrame, rounds: int = 10, weight: str = "similarity", resolution: float = 1.0) -> DataFrame:
    """(id, community): labels that move to where modularity gains most, ties to the smaller label.

    A node's gain in a community is the weight of its edges into it, less resolution * its own weight * the community's
    weight over that of all edges.  Every other node (by hash and round) moves at a time, so that two do not swap for ever; a
    node stays where no other community gains more.
    """
    parts = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    e = cut(both_ways(edges, weight).repartition(parts, "other"))  # lies by other in all rounds
    degree = e.groupBy(F.col("node").alias("id")).agg(F.sum("weight").alias("k"))
    labels = stored(degree.select("id", F.col("id").alias("community"), "k"))
    whole = labels.agg(F.sum("k")).first()[0]
    order = -F.col("community") if dict(labels.dtypes)["community"] != "string" else F.lit(0)
    for turn in range(rounds):
        sizes = labels.groupBy("community").agg(F.sum("k").alias("size"))
        mine = stored(labels.join(sizes, "community").select("id", "community", "k", "size"))  # one row a node, so no edge meets the sizes
        votes = e.join(mine.select(F.col("id").alias("other"), "community", "size"), "other").select("node", "community", "size", F.col("weight").alias("votes"))
        votes = votes.unionByName(mine.select(F.col("id").alias("node"), "community", "size", F.lit(0.0).alias("votes"))).repartition(parts, "node")
        votes = votes.groupBy("node", "community").agg(F.sum("votes").alias("votes"), F.first("size").alias("size"))
        scored = votes.join(mine.select(F.col("id").alias("node"), F.col("community").alias("own"), "k"), "node")
        others = F.col("size") - F.when(F.col("community") == F.col("own"), F.col("k")).otherwise(0.0)
        gain = F.round(F.col("votes") - resolution * F.col("k") * others / F.lit(whole), 9)
        best = scored.groupBy("node", "k", "own").agg(F.max(F.struct(gain.alias("gain"), (F.col("community") == F.col("own")).alias("stay"), order.alias("order"), "community")).alias("best"))
        turn_of = F.pmod(F.xxhash64("node"), F.lit(2)) == turn % 2
        last, labels = labels, stored(best.select(F.col("node").alias("id"), F.when(turn_of, F.col("best.community")).otherwise(F.col("own")).alias("community"), "k"))
        unstored(last, mine)
    return labels.select("id", "community")


def modularity(edges: DataFrame, communities: DataFrame, weight: str = "similarity", resolution: float = 1.0) -> DataFrame:
    """(modularity): one row, of communities (id, community) on the edges."""
    named = lambda end: communities.select(F.col("id").alias(end), F.col("community").alias(f"{end}_community"))
    inside = edges.join(named("src"), "src").join(named("dst"), "dst").agg(F.sum(weight).alias("whole"), F.sum(F.when(F.col("src_community") == F.col("dst_community"), F.col(weight)).otherwise(0.0)).alias("inside"))
    degree = both_ways(edges, weight).join(communities.withColumnRenamed("id", "node"), "node").groupBy("community").agg(F.sum("weight").alias("k"))
    expected = degree.agg(F.sum(F.col("k") * F.col("k")).alias("squares"))
    return inside.crossJoin(expected).select((F.col("inside") / F.col("whole") - resolution * F.col("squares") / (4 * F.col("whole") * F.col("whole"))).alias("modularity"))
