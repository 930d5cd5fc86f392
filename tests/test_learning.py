import inspect
import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from locigrid.operators import classify, clustering, features, linkage, neighbours
from locigrid.plans import learning


def blobs(spark, n=180, d=5, classes=3, gap=8.0, seed=4):
    rng = np.random.default_rng(seed)
    centres = rng.normal(scale=gap, size=(classes, d))
    y = np.arange(n) % classes
    x = centres[y] + rng.normal(size=(n, d))
    rows = [(i, [float(v) for v in row], f"bin{c}") for i, (row, c) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "id long, features array<double>, label string"), x, y


def agreement(frame, labels):
    """Share of row pairs that both groupings treat alike."""
    rows = frame.select("id", "label").join(labels, "id").collect()
    a = np.array([r["label"] for r in rows])
    b = np.array([r["cluster"] for r in rows])
    return np.mean((a[:, None] == a[None]) == (b[:, None] == b[None]))


CLUSTERINGS = {
    "kmeans": lambda df: clustering.kmeans_labels(df, 3),
    "gmm": lambda df: clustering.gmm_labels(df, 3),
    "agg": lambda df: clustering.ward_labels(df, 3),
    "agg in two stages": lambda df: clustering.ward_labels(df, 3, tail=20),
    "dscan": lambda df: neighbours.density_labels(df, 3, 2),
    "spectral": lambda df: clustering.spectral_labels(df, 3),
}


@pytest.mark.parametrize("name", CLUSTERINGS)
def test_clusterings_agree_on_clear_groups(spark, name):
    frame, _, _ = blobs(spark)
    labels = CLUSTERINGS[name](frame)
    assert labels.count() == 180
    assert agreement(frame, labels) > (0.75 if name == "spectral" else 0.97)


def naive_merges(x, k, average=False):
    groups = [[i] for i in range(len(x))]
    while len(groups) > k:
        def cost(pair):
            a, b = (x[groups[p]] for p in pair)
            if average:
                return np.mean([((p - q) ** 2).sum() for p in a for q in b])
            return len(a) * len(b) / (len(a) + len(b)) * ((a.mean(axis=0) - b.mean(axis=0)) ** 2).sum()
        i, j = min(itertools.combinations(range(len(groups)), 2), key=cost)
        groups[i] += groups.pop(j)
    return {frozenset(g) for g in groups}


@pytest.mark.parametrize("tail", [256, 20])
def test_ward_agrees_with_merging_one_by_one(spark, tail):
    x = np.random.default_rng(8).normal(size=(40, 3))
    x[3] = x[9]
    x[39] += 50
    frame = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, features array<double>")
    groups = {}
    for r in clustering.ward_labels(frame, 4, tail).collect():
        groups.setdefault(r["cluster"], set()).add(r["id"])
    assert {frozenset(g) for g in groups.values()} == naive_merges(x, 4)
    assert all(c == min(g) for c, g in groups.items())


@pytest.mark.parametrize("tail", [256, 16])
def test_every_cluster_of_the_tree_stands_together(spark, tail):
    x = np.random.default_rng(3).normal(size=(24, 2))
    x[5] = x[17]
    rows = [("g", f"r{i:02}", r.tolist()) for i, r in enumerate(x)] + [("h", "only", [1.0, 1.0]), (None, "b", [2.0, 0.0]), (None, "a", [2.0, 0.0])]
    df = spark.createDataFrame(rows, "g string, row string, features array<double>")
    out = features.leaf_order(df, ["g"], "row", tail).orderBy("g", "leaf", "row").collect()
    assert len(out) == 27 and [r["leaf"] for r in out if r["g"] != "g"] == [0, 0, 0]
    order = [int(r["row"][1:]) for r in out if r["g"] == "g"]
    assert sorted(order) == list(range(24)) and abs(order.index(5) - order.index(17)) == 1
    for k in range(1, 24):
        for group in naive_merges(x, k, average=True):
            places = sorted(order.index(i) for i in group)
            assert places[-1] - places[0] == len(group) - 1


def test_clusters_in_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(linkage, "BLOCK", 7)
    x = np.random.default_rng(4).normal(size=(50, 2))
    leaves = spark.createDataFrame([(0, i, r.tolist(), 1) for i, r in enumerate(x)], "g long, id long, c array<double>, w long")
    key = lambda r: (round(r["height"], 9), r["into"], r["gone"])
    cut, whole = (sorted(map(key, linkage.merge_tree(leaves, linkage.ward_cost, t).collect())) for t in (30, 100))
    assert cut == whole and len(cut) == 49


def test_one_search_decides_many_merges(spark, monkeypatch):
    rounds, one = [], linkage._round
    monkeypatch.setattr(linkage, "_round", lambda *a: rounds.append(1) or one(*a))
    x = np.random.default_rng(5).normal(size=(200, 2)) + 20 * np.arange(200)[:, None] // 50 * [1, 0]
    leaves = spark.createDataFrame([(0, i, r.tolist(), 1) for i, r in enumerate(x)], "g long, id long, c array<double>, w long")
    key = lambda r: (round(r["height"], 9), r["into"], r["gone"])
    cut, whole = (sorted(map(key, linkage.merge_tree(leaves, linkage.ward_cost, t).collect())) for t in (40, 200))
    assert cut == whole and len(cut) == 199
    # merging only pairs that are each other's nearest takes five rounds
    assert len(rounds) <= 1


def test_linear_discriminant_formula(spark):
    frame, x, y = blobs(spark, gap=1.0)
    model = classify.LinearDiscriminant.fit(frame)
    means = np.array([x[y == c].mean(axis=0) for c in range(3)])
    rest = x - means[y]
    inverse = np.linalg.inv(rest.T @ rest / (len(x) - 3))
    scores = x @ inverse @ means.T - 0.5 * np.einsum("ij,jk,ik->i", means, inverse, means) + np.log(np.bincount(y) / len(y))
    wanted = np.exp(scores - scores.max(axis=1, keepdims=True))
    wanted /= wanted.sum(axis=1, keepdims=True)
    got = {(r["id"], r["class"]): r["prob"] for r in model.probabilities(frame).collect()}
    for i, c in itertools.product(range(len(x)), range(3)):
        assert got[i, f"bin{c}"] == pytest.approx(wanted[i, c], abs=1e-6)


CLASSIFIERS = {
    "lda": lambda t, q: classify.LinearDiscriminant.fit(t).probabilities(q),
    "knn": lambda t, q: neighbours.knn_classify(t, q, 3),
    "rf": lambda t, q: classify.random_forest(t, q, trees=20, depth=5),
    "svm": lambda t, q: classify.rbf_machine(t, q, size=200, rounds=10),
}


@pytest.mark.parametrize("name", CLASSIFIERS)
def test_classifiers_on_clear_groups(spark, name):
    frame, _, _ = blobs(spark)
    train, asked = frame.filter("id % 4 > 0"), frame.filter("id % 4 = 0")
    probabilities = CLASSIFIERS[name](train, asked)
    totals = probabilities.groupBy("id").agg(F.sum("prob").alias("p"))
    assert totals.count() == 45 and totals.filter("abs(p - 1) > 1e-9").count() == 0
    votes = classify.predict(probabilities, name)
    hits = votes.join(frame, F.col("contig") == F.col("id")).filter("assigned_bin = label").count()
    assert hits >= 44


def test_searches(spark):
    frame, _, _ = blobs(spark)
    knn = classify.search_knn(frame, {"k": [1, 3], "weights": ["uniform", "distance"]}, n=3, folds=3)
    assert knn.count() == 3 and knn.agg(F.min("accuracy")).first()[0] > 0.95
    forest = classify.search_forest(frame, {"trees": [5, 10], "depth": [3]}, n=2, folds=2)
    assert forest.count() == 2 and forest.agg(F.min("accuracy")).first()[0] > 0.9


def test_scaling_and_components(spark):
    frame, x, _ = blobs(spark)
    flat = frame.withColumn("features", F.concat("features", F.array(F.lit(2.0))))
    scaler = features.Standardiser.fit(flat)
    z = np.array([r["features"] for r in scaler.apply(flat).orderBy("id").collect()])
    assert np.allclose(z[:, :5], (x - x.mean(axis=0)) / x.std(axis=0)) and np.allclose(z[:, 5], 0)
    scaled = scaler.apply(flat)
    components = features.Components.fit(scaled, 0.9)
    share = np.sort(np.linalg.eigvalsh(np.cov(z.T)))[::-1]
    cumulative = np.cumsum(share) / share.sum()
    assert components.k == int(np.argmax(cumulative > 0.9)) + 1
    p = np.array([r["features"] for r in components.apply(scaled).collect()])
    assert p.shape[1] == components.k
    assert np.allclose(np.sort(p.var(axis=0, ddof=1))[::-1], share[: components.k])
    with pytest.raises(ValueError):
        features.Standardiser.fit(flat.filter("id < 0"))


def test_imputation(spark):
    df = spark.createDataFrame(
        [("c1", "a", "m1", 1.0), ("c2", "a", "m1", 3.0), ("c2", "a", "m3", 5.0), ("c3", "b", "m2", 7.0)],
        "contig string, bin string, motif string, x double",
    )
    index = features.feature_index(df, "motif")
    got = {r["contig"]: r["features"] for r in features.impute_within(df, "motif", "x", index).collect()}
    assert got == {"c1": [1.0, 0.0, 5.0], "c2": [3.0, 0.0, 5.0], "c3": [0.0, 7.0, 0.0]}
    got = {r["contig"]: r["features"] for r in features.impute_unbinned(df, "motif", "x", index).collect()}
    assert got["c1"] == [1.0, 0.0, 0.0]
    raw = {r["contig"]: r["features"] for r in features.feature_vectors(df, ["contig"], "motif", "x", index).collect()}
    assert raw == {"c1": [1.0, None, None], "c2": [3.0, None, 5.0], "c3": [None, 7.0, None]}


def test_registered_classifiers_use_the_numbers_of_the_method(spark, monkeypatch):
    calls = []
    for name in ("random_forest", "rbf_machine", "search_forest"):

        def record(*args, name=name, signature=inspect.signature(getattr(classify, name)), **kwargs):
            bound = signature.bind(*args, **kwargs)
            bound.apply_defaults()
            calls.append((name, bound.arguments))

        monkeypatch.setattr(classify, name, record)
    monkeypatch.setattr(classify, "predict", lambda probabilities, method: None)
    monkeypatch.setattr(neighbours, "knn_classify", lambda *args: None)
    monkeypatch.setattr(learning.shape, "union_strict", lambda *votes: None)
    monkeypatch.setattr(learning.scoring, "confidence_tiers", lambda votes: votes)
    monkeypatch.setattr(learning, "cut_lineage", lambda df: df)
    for query in (learning.forest_classes, learning.rbf_classes, learning.forest_search, learning.inclusion_ensemble):
        query(spark, "/root/testdata/sf0.001")
    assert sorted(n for n, _ in calls) == ["random_forest"] * 2 + ["rbf_machine"] * 2 + ["search_forest"]
    for name, a in calls:
        if name == "random_forest":
            assert (a["trees"], a["depth"]) == (100, None)
        elif name == "rbf_machine":
            assert (a["size"], a["rounds"]) == (256, 30)
        else:
            assert (a["n"], a["folds"]) == (5, 5) and a["grid"] == learning.FOREST_GRID


def plain_kmeans(ids, x, k, rounds=30):
    """Lloyd's rounds from the vectors whose ids hash least."""
    import hashlib

    digest = [hashlib.md5(f"42|{i}".encode()).hexdigest() for i in ids]
    firsts, seen = [], set()
    for j in sorted(range(len(ids)), key=lambda j: digest[j]):
        if tuple(x[j]) not in seen and len(firsts) < k:
            seen.add(tuple(x[j]))
            firsts.append(x[j])
    centres = np.array(firsts)
    for _ in range(rounds):
        at = ((x[:, None] - centres[None]) ** 2).sum(-1).argmin(1)
        centres = np.array([x[at == c].mean(0) if (at == c).any() else centres[c] for c in range(len(centres))])
    return ((x[:, None] - centres[None]) ** 2).sum(-1).argmin(1)


@pytest.mark.parametrize("room", [4_000_000, 10])
def test_keys_are_clustered_as_if_alone(spark, monkeypatch, room):
    monkeypatch.setattr(clustering, "CENTRES", room)
    rng = np.random.default_rng(6)
    rows, wanted = [], {}
    for key, n in (("a", 40), ("b", 25), ("c", 2)):
        x = rng.normal(size=(n, 3)).round(3)
        x[n // 2] = x[0]
        ids = [f"{key}{i}" for i in range(n)]
        rows += [(key, i, v.tolist()) for i, v in zip(ids, x)]
        wanted |= dict(zip(ids, plain_kmeans(ids, x, 4).tolist()))
    got = clustering.kmeans_by_key(spark.createDataFrame(rows, "key string, id string, features array<double>"), 4)
    assert {r["id"]: r["cluster"] for r in got.collect()} == wanted


def test_a_sweep_equals_a_run_per_limit(spark):
    from locigrid.operators import scoring

    rng = np.random.default_rng(1)
    rows = [(float(limit), f"b{c % 5}", f"c{c}", f"m{m}", float(rng.normal())) for limit in (1, 2) for c in range(30) for m in range(6) if rng.random() < 0.9 / limit]
    rows.append((1.0, "alone", "c99", "m1", 0.5))
    swept = spark.createDataFrame(rows, "limit double, bin string, contig string, motif string, x double")
    key = lambda df: sorted(map(tuple, df.collect()))
    both = key(features.clustered_per_limit(swept, "motif", "x", 4))
    single = [key(features.clustered_per_limit(swept.filter(F.col("limit") == limit), "motif", "x", 4)) for limit in (1, 2)]
    assert both == sorted(single[0] + single[1]) and "alone" not in {r[1] for r in both}
    shares = scoring.home_shares(features.clustered_per_limit(swept, "motif", "x", 4)).collect()
    for r in shares:
        mine = [c for limit, b, _, c in both if (limit, b) == (r["limit"], r["bin"])]
        home = min(set(mine), key=lambda c: (-mine.count(c), c))
        assert (r["home"], r["home_share"]) == (home, pytest.approx(mine.count(home) / len(mine)))
