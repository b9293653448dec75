"""Ward's merge tree against the plain loop, its cut, and the tree of the clusters."""

import numpy as np
import pytest

from citelens.operators import linkage, models


def plain_ward(x):
    groups, merges = {i: (1.0, v) for i, v in enumerate(x)}, []
    while len(groups) > 1:
        keys = list(groups)
        n, m = np.array([groups[k][0] for k in keys]), np.stack([groups[k][1] for k in keys])
        cost = n[:, None] * n[None] / (n[:, None] + n[None]) * ((m[:, None] - m[None]) ** 2).sum(axis=2)
        np.fill_diagonal(cost, np.inf)
        i, j = np.unravel_index(cost.argmin(), cost.shape)
        a, b = sorted((keys[i], keys[j]))
        merges.append((a, b, len(x) + len(merges), np.sqrt(2 * cost[i, j]), n[i] + n[j]))
        groups[merges[-1][2]] = (n[i] + n[j], (n[i] * m[i] + n[j] * m[j]) / (n[i] + n[j]))
        del groups[a], groups[b]
    return merges


def plain_cut(n, merges, k):
    """Sets of leaves of the k clusters."""
    sets = {i: {i} for i in range(n)}
    for a, b, new, *_ in merges[: n - k]:
        sets[new] = sets.pop(a) | sets.pop(b)
    return sorted(map(sorted, sets.values()))


def table(spark, x):
    return spark.createDataFrame([(i, v if v is None else [float(c) for c in v]) for i, v in enumerate(x)], "id int, embedding array<double>")


@pytest.fixture(scope="module")
def ward(spark):
    x = np.random.default_rng(1).normal(size=(300, 5))
    return x, *linkage.merge_tree(table(spark, x), width=120)


def test_tree_is_that_of_the_plain_loop(ward):
    x, _, tree = ward
    got, told = [tuple(r) for r in tree.orderBy("node").collect()], plain_ward(x)
    assert [r[:3] for r in got] == [r[:3] for r in told] and np.allclose([r[3:] for r in got], [r[3:] for r in told])


def test_one_task_gives_the_same_tree(spark, ward):
    x, _, tree = ward
    _, alone = linkage.merge_tree(table(spark, x))
    assert [r[:3] for r in alone.orderBy("node").collect()] == [r[:3] for r in tree.orderBy("node").collect()]


@pytest.mark.parametrize("k", [1, 6])
def test_cut_and_contraction(ward, k):
    x, leaves, tree = ward
    merges = plain_ward(x)
    parts = linkage.cut_tree(leaves, tree, k)
    comps = {}
    for r in parts.collect():
        comps.setdefault(r.comp, []).append(r.leaf)
    assert sorted(map(sorted, comps.values())) == plain_cut(len(x), merges, k)
    sizes = [len(comps[c]) for c in range(k)]
    assert sizes == sorted(sizes, reverse=True)
    upper = linkage.contracted(parts, tree)
    root = {r.root: r.comp for r in parts.collect()}
    assert sorted(tuple(r)[:3] for r in upper.collect()) == sorted((root.get(a, a), root.get(b, b), n) for a, b, n, *_ in merges[len(x) - k :])
    paths = {r.comp: (r.path, r.place) for r in linkage.topic_paths(upper, parts).collect()}
    assert sorted(p[1] for p in paths.values()) == list(range(k))
    for comp, (path, _) in paths.items():
        at, told = comp, [comp]
        for r in sorted(upper.collect(), key=lambda r: r.node):
            at = r.node if at in (r.left, r.right) else at
            told.append(at)
        assert path == told
    for node in {n for p, _ in paths.values() for n in p}:  # no branch crosses another
        places = sorted(place for p, place in paths.values() if node in p)
        assert places == list(range(places[0], places[-1] + 1))
    assert paths[0][1] == 0


def test_equal_rows_ties_and_rows_without_vectors(spark):
    """A third of equal rows and a grid of equal distances end in few rounds and in clusters that are right; odd rows take no part."""
    x = [[0.0, 0.0]] * 40 + [[50.0 + i, 0.0] for i in range(40)] + [[0.0, 900.0 + i] for i in range(40)] + [None, [], [float("nan"), 1.0], [float("inf"), 1.0]]
    rows = table(spark, x)
    leaves, tree = linkage.merge_tree(rows, width=30)
    assert leaves.count() == 120 and tree.count() == 119 and tree.filter("height = 0").count() == 39
    heights = [r.height for r in tree.orderBy("node").collect()]
    assert heights == sorted(heights)
    comps = {r.id: r.comp for r in linkage.cut_tree(leaves, tree, 3).collect()}
    assert [sorted({comps[i] for i in part}) for part in (range(40), range(40, 80), range(80, 120))] == [[0], [1], [2]]
    clustered = {r.id: r.comp for r in models.tree_clusters(rows, 3).collect()}
    assert len(clustered) == 124 and [clustered[i] for i in range(120, 124)] == [None] * 4


def test_few_rows(spark):
    for x in ([], [[1.0]], [[1.0], [2.0]]):
        leaves, tree = linkage.merge_tree(table(spark, x))
        assert leaves.count() == len(x) and tree.count() == max(len(x) - 1, 0)
        assert linkage.cut_tree(leaves, tree, 5).count() == len(x)
    with pytest.raises(ValueError, match="components"):
        linkage.merge_tree(table(spark, [[1.0], [1.0, 2.0]]))


def test_a_search_sends_groups_to_few_blocks(spark):
    """Of 300 groups in tiles of 10 each goes to eight blocks, not to thirty."""
    x = np.random.default_rng(2).normal(size=(300, 3))
    groups = spark.createDataFrame([(i, 1.0, 0.0, [float(c) for c in v]) for i, v in enumerate(x)], linkage.GROUP)
    found = linkage._searched(groups, 300, groups, 300, 10).collect()
    away = ((x[:, None] - x[None]) ** 2).sum(axis=2) + np.diag([np.inf] * 300)
    assert len(found) <= 2 * 8 * 300
    assert {i: min((r.cost, r.other) for r in found if r.node == i)[1] for i in range(300)} == dict(enumerate(away.argmin(axis=1)))
