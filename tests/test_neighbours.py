import numpy as np
import pytest

from locigrid.operators import neighbours


def points(spark, seed=3, n=160, copies=60, d=4):
    """Clumps, scattered rows, and one vector that a third of all rows share."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(scale=5, size=(4, d))
    x = centres[rng.integers(0, 4, n)] + rng.normal(scale=0.4, size=(n, d))
    x = np.vstack([x, np.tile(x[7], (copies, 1))])
    order = rng.permutation(len(x))
    x = x[order]
    frame = spark.createDataFrame(
        [(i, [float(v) for v in row]) for i, row in enumerate(x)], "id long, features array<double>"
    )
    return frame, x


def distances(x, p=2.0):
    return (np.abs(x[:, None] - x[None]) ** p).sum(axis=2) ** (1 / p)


@pytest.fixture(params=[2048, 16])
def block(request, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", request.param)


@pytest.mark.parametrize("p", [2.0, 3.0])
def test_graph_is_exact(spark, block, p):
    frame, x = points(spark)
    d = distances(x, p)
    found = {}
    for r in neighbours.knn_graph(frame, 5, p).collect():
        found.setdefault(r["id"], []).append((r["rank"], r["neighbour"], r["distance"]))
    assert len(found) == len(x)
    for i, got in found.items():
        others = [j for j in range(len(x)) if j != i]
        wanted = sorted(others, key=lambda j: (round(d[i, j], 9), j))[:5]
        got.sort()
        assert [g[0] for g in got] == [1, 2, 3, 4, 5]
        assert [g[2] for g in got] == pytest.approx([d[i, j] for j in wanted])
        if len({round(d[i, j], 9) for j in others if d[i, j] <= d[i, wanted[-1]] + 1e-9}) > 4:
            assert [g[1] for g in got] == wanted


def test_votes_and_ties(spark, rows):
    train = spark.createDataFrame(
        [(1, [0.0, 0.0], "b"), (2, [0.0, 1.0], "a"), (3, [1.0, 0.0], "a"), (4, [9.0, 9.0], "c")],
        "id long, features array<double>, label string",
    )
    asked = spark.createDataFrame([(10, [0.0, 0.1]), (11, [9.0, 9.0])], "id long, features array<double>")
    best = neighbours.best_class(neighbours.knn_classify(train, asked, 3))
    assert rows(best.filter("id = 10"), "pred") == [("a",)]
    exact = neighbours.best_class(neighbours.knn_classify(train, asked, 3, weighted=True))
    assert rows(exact.filter("id = 11"), "pred", "prob") == [("c", 1.0)]
    few = neighbours.nearest(train.limit(2), asked, 5)
    assert few.groupBy("id").count().select("count").distinct().collect()[0][0] == 2


def reference_dbscan(x, eps, minimum, w):
    d = distances(x)
    near = d <= eps
    core = near @ w >= minimum - 1e-9
    label = np.full(len(x), -1)
    for i in range(len(x)):
        if not core[i] or label[i] >= 0:
            continue
        stack, label[i] = [i], i
        while stack:
            j = stack.pop()
            for k in np.flatnonzero(near[j] & core):
                if label[k] < 0:
                    label[k] = i
                    stack.append(k)
    for i in np.flatnonzero(~core):
        options = np.flatnonzero(near[i] & core)
        if len(options):
            label[i] = label[min(options, key=lambda k: (round(d[i, k], 12), k))]
    return label, core


def partition(labels):
    groups = {}
    for i, c in labels.items():
        groups.setdefault(c, set()).add(i)
    noise = groups.pop(-1, set())
    return {frozenset(g) for g in groups.values()}, noise


@pytest.mark.parametrize("eps, minimum", [(0.6, 4.0), (1.5, 20.0)])
def test_density_clusters_match_a_plain_search(spark, block, eps, minimum):
    frame, x = points(spark)
    w = 1.0 + np.arange(len(x)) % 3
    weighted = frame.selectExpr("*", "1.0D + id % 3 AS w")
    got = {r["id"]: r["cluster"] for r in neighbours.dbscan(weighted, eps, minimum, "w").collect()}
    label, _ = reference_dbscan(x, eps, minimum, w)
    assert partition(got) == partition(dict(enumerate(label)))


def test_density_labels_find_the_clumps(spark):
    frame, x = points(spark, copies=0)
    got = {r["id"]: r["cluster"] for r in neighbours.density_labels(frame, 3, 2).collect()}
    groups, noise = partition(got)
    assert len(noise) <= len(x) // 10
    assert len(groups) == 4


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 50)] + [(5, 5)]
    frame = spark.createDataFrame(edges, "src long, dst long")
    got = {r["node"]: r["component"] for r in neighbours.connected_components(frame).collect()}
    assert all(got[i] == 0 for i in range(201))
    assert all(got[1000 + i] == 1000 for i in range(50))


@pytest.mark.parametrize("p", [2.0, 3.0])
def test_codes_find_most_neighbours_and_compare_few(spark, monkeypatch, p):
    from locigrid.operators import inverted

    monkeypatch.setattr(inverted, "BLOCK", 100)
    rng = np.random.default_rng(5)
    # one tight group holds a third of the rows, the rest has no structure
    x = np.concatenate([rng.normal(size=(1_000, 16)), rng.normal(scale=0.05, size=(500, 16)) + 3])
    x[7] = x[8]
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, features array<double>")
    asked = df.filter("id % 10 = 0")
    got = inverted.nearest_by_codes(df, asked, 10, p, shortlist=60)
    exact = [(i, np.argsort((np.abs(x - x[i]) ** p).sum(1), kind="stable")[:10]) for i in range(0, 1_500, 10)]
    pairs = {(r["id"], r["neighbour"]): (r["rank"], r["distance"]) for r in got.collect()}
    assert len(pairs) == 1_500
    assert np.mean([(i, j) in pairs for i, near in exact for j in near.tolist()]) >= 0.9
    for (i, j), (_, distance) in list(pairs.items())[:200]:
        assert distance == pytest.approx((np.abs(x[i] - x[j]) ** p).sum() ** (1 / p), abs=1e-9)
    assert all(pairs[i, i][0] == 1 for i in range(10, 1_500, 10))
    assert inverted.nearest_by_codes(df.limit(0), asked, 3).count() == 0
    assert inverted.nearest_by_codes(df.limit(2), asked.limit(1), 3).count() == 2


def test_short_lists_are_those_nearest_by_code_in_probed_lists(spark):
    from locigrid.operators import inverted

    rng = np.random.default_rng(6)
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(rng.normal(size=(900, 8)))], "id long, features array<double>")
    codes = inverted.Codes.fit(df, 5)
    assert len(codes.centres) == 30 and codes.probes > 2
    x = np.array([r["features"] for r in df.orderBy("id").collect()])
    home, code = codes.encode(x)
    guess = np.abs(x[:, None, :] - codes.decode(home, code)[None, :, :]) ** 2
    near = np.argsort(inverted._powers(x, codes.centres, 2.0), axis=1, kind="stable")[:, : codes.probes]
    looks = np.zeros((900, 30), bool)
    np.put_along_axis(looks, near, True, axis=1)
    place, _ = inverted.tiles.closest(x, codes.decode(home, code), 20, 2.0, probed=(looks, home))
    guess = np.where(looks[:, home], guess.sum(axis=2), np.inf)
    assert (np.sort(place, axis=1) == np.sort(np.argsort(guess, axis=1, kind="stable")[:, :20], axis=1)).mean() > 0.999
    got = {(r["id"], r["neighbour"]) for r in inverted.nearest_by_codes(df, df, 5, 2.0, 20, codes).collect()}
    exact = np.where(place < 900, np.linalg.norm(x[:, None] - x[place], axis=2), np.inf)
    best = np.take_along_axis(place, np.lexsort((place, exact), axis=1)[:, :5], 1)
    assert got == {(i, j) for i, row in enumerate(best.tolist()) for j in row}
