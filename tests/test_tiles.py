import numpy as np
import pytest

from locigrid.operators import linkage, neighbours, tiles


@pytest.fixture(autouse=True)
def small_tiles(monkeypatch):
    monkeypatch.setattr(tiles, "TILE", 37)
    monkeypatch.setattr(tiles, "BASE_TILE", 53)


def rows(d, offset, seed=0):
    """Rows of both sides; some of the base are copies of each other and of queries."""
    rng = np.random.default_rng(seed)
    q = rng.normal(size=(200, d)) + offset
    return q, np.vstack([rng.normal(size=(300, d)) + offset, q[:50], q[:50]])


@pytest.mark.parametrize("d, offset", [(3, 0.0), (16, 0.0), (4, 1e6)])
@pytest.mark.parametrize("p", [0.5, 1.0, 1.5, 2.0, 3.0])
def test_closest_and_near_rows_equal_those_of_all_pairs(d, offset, p):
    q, b = rows(d, offset)
    every = tiles._distances(q, b, p)
    order = np.argsort(every, axis=1, kind="stable")[:, :7]
    place, distance = tiles.closest(q, b, 7, p)
    assert (place == order).all()
    assert (distance == np.take_along_axis(every, order, 1)).all()
    capped, _ = tiles.closest(q, b, 7, p, distance[:, 3])
    assert (capped[:, :4] == order[:, :4]).all()
    eps, w = np.quantile(every, 0.02), np.arange(len(b)) % 5
    assert tiles.weight_within(q, b, w.astype(float), eps, p) == pytest.approx((every <= eps) @ w)
    ids, other = tiles.linked(q, b, np.arange(200), 1000 + np.arange(400), eps, p)
    near = every <= eps
    assert set(ids) == set(np.flatnonzero(near.any(1))) | set(1000 + np.flatnonzero(near.any(0)))
    # both sides of a near pair name the same row
    of = dict(zip(ids.tolist(), other.tolist()))
    assert all(of[i] == of[1000 + j] for i, j in zip(*(v.tolist() for v in np.nonzero(near))))


@pytest.mark.parametrize("scale", [1.0, 1e-30, 1e100])
def test_short_numbers_lose_no_pair(scale):
    q, b = (v * scale for v in rows(64, 0.0))
    squares = tiles._distances(q, b, 2.0) ** 2
    limit = np.sort(squares, axis=1)[:, 9]
    product, every = tiles.Products(q, b), np.arange(len(q))
    assert product.fits(every, limit)
    hits, found, off = product.below(every, np.arange(len(b)), limit)
    assert set(np.flatnonzero(squares <= limit[:, None])) <= set(hits)
    assert (np.abs(found - squares.ravel()[hits]) <= off[hits // len(b)]).all()
    assert len(hits) < 11 * len(q)
    # far from the middle they are not used
    far = np.vstack([b, np.full((1, 64), 1e6 * scale)])
    assert not tiles.Products(q, far).fits(every, limit)


def test_rows_that_are_no_numbers_come_last():
    q, b = rows(3, 0.0)
    b[3], b[4, 1] = np.nan, np.inf
    with np.errstate(invalid="ignore"):
        every = tiles._distances(q, b, 2.0)
        place, _ = tiles.closest(q, b, len(b), 2.0)
    assert (place == np.argsort(every, axis=1, kind="stable")).all()


@pytest.mark.parametrize("cost", [linkage.ward_cost, linkage.average_cost])
@pytest.mark.parametrize("d", [2, 20])
def test_cheapest_mate_equals_that_of_all_pairs(cost, d):
    x, y = rows(d, 0.0)
    rng = np.random.default_rng(1)
    a, b = np.r_[500 + np.arange(150), np.arange(50)], np.r_[1000 + np.arange(300), np.arange(100)][rng.permutation(400)]
    wa, wb = rng.integers(1, 9, 200).astype(float), rng.integers(1, 9, 400).astype(float)
    sa, sb = rng.random(200), rng.random(400)
    every = cost(linkage._gaps(x, y), wa[:, None], wb[None, :], sa[:, None], sb[None, :])
    every[a[:, None] == b[None, :]] = np.inf
    mate, least = tiles.cheapest((x, wa, sa), (y, wb, sb), a, b, cost)
    assert (least == every.min(1)).all()
    assert all(m == min(b[every[i] == every[i].min()]) for i, m in enumerate(mate))


@pytest.mark.parametrize("cost", [linkage.ward_cost, linkage.average_cost])
@pytest.mark.parametrize("grid", [False, True])
def test_merges_beyond_doubt_are_those_of_the_whole_tree(cost, grid):
    import pandas as pd

    rng = np.random.default_rng(6)
    x = rng.integers(0, 9, (400, 3)).astype(float) if grid else rng.normal(size=(400, 3))
    w, zero, ids = rng.integers(1, 4, 400).astype(float), np.zeros(400), 1 + 3 * rng.permutation(400)
    side = (x, w, zero)
    place, least, bound = tiles.cheapest_few(side, side, ids, ids, cost, 8)
    every = cost(linkage._gaps(x, x), w[:, None], w[None, :], 0, 0)
    np.fill_diagonal(every, np.inf)
    assert np.allclose(np.sort(least, axis=1), np.sort(every, axis=1)[:, :8])
    np.put_along_axis(every, place, np.inf, axis=1)
    assert (bound <= every.min(axis=1) * (1 + 1e-9)).all()
    rows = pd.DataFrame({"g": 0, "id": ids, "c": list(x), "w": w, "s": 0.0, "h": 0.0, "mates": [ids[p] for p in place], "costs": list(least), "bound": bound})
    whole = {(a, b): h for a, b, h in linkage.finish(rows.copy(), cost)[["into", "gone", "height"]].itertuples(index=False)}
    for part in (rows, rows.iloc[::2]):
        both = linkage.merge_near(part, cost)
        made = both[both["into"].notna()]
        assert both["id"].notna().sum() + len(made) == len(part)
        if not grid:
            # on a grid equal costs leave the names of later merges open
            assert len(made) and all(whole[a, b] == pytest.approx(h) for a, b, h in made[["into", "gone", "height"]].itertuples(index=False))


@pytest.mark.parametrize("limit", [np.inf, 1.2])
def test_lightest_edge_equals_that_of_all_pairs(limit):
    x, y = rows(2, 0.0)
    rng = np.random.default_rng(2)
    a, b, ka, kb = np.arange(200), 1000 + np.arange(400), rng.integers(0, 3, 200), rng.integers(0, 3, 400)
    ca, cb = rng.random(200), rng.random(400)
    every = np.maximum(tiles._distances(x, y, 2.0), np.maximum(ca[:, None], cb[None, :]))
    every[ka[:, None] == kb[None, :]] = np.inf
    other, height = tiles.lightest((a, x, ca, ka), (b, y, cb, kb), np.full(200, limit))
    for i in range(200):
        low = every[i].min()
        assert height[i] == (low if low <= limit else np.inf)
        if low <= limit:
            assert other[i] == b[every[i] == low].min()


def test_a_query_that_reaches_every_cell_is_sent_once_per_block(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 100)
    rng = np.random.default_rng(3)
    frame = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(rng.normal(size=(400, 64)))], "rep long, features array<double>")
    cells = neighbours.Cells.choose(frame, 2.0)
    placed = cells.assign(frame).localCheckpoint()
    cells.measure(placed, 3)
    assert cells.n_blocks <= 8
    wanted = cells.candidates(frame, k=3)
    # the 20 cells cannot be told apart in 64 dimensions
    assert wanted.selectExpr("max(size(reached))").first()[0] <= 8
    left, right = cells.blocks(placed.drop("radius"), wanted, "rep", "rep")
    sizes = left.cogroup(right).applyInPandas(lambda b, q: b.assign(rep=len(b), n=len(q))[["rep", "n"]].head(1), "rep long, n long").collect()
    assert sum(r["rep"] for r in sizes) >= 400
    assert max(r["rep"] for r in sizes) <= 100


def test_last_merges_are_always_the_cheapest_pair():
    import pandas as pd

    rng = np.random.default_rng(4)
    x = rng.integers(0, 6, (60, 2)).astype(float) + rng.integers(0, 2, (60, 1)) * 0.5
    frame = pd.DataFrame({"g": 0, "id": np.arange(60), "c": list(x), "w": 1.0, "s": 0.0, "h": 0.0})
    got = linkage.finish(frame, linkage.ward_cost)
    # plain version: the whole matrix is searched for every merge
    centre, w, alive = x.copy(), np.ones(60), np.ones(60, bool)
    for _, r in got.iterrows():
        every = linkage.ward_cost(linkage._gaps(centre, centre), w[:, None], w[None, :], 0, 0)
        every[~alive] = np.inf
        every[:, ~alive] = np.inf
        np.fill_diagonal(every, np.inf)
        assert every[int(r["into"]), int(r["gone"])] == pytest.approx(every.min(), abs=1e-9)
        i, j = int(r["into"]), int(r["gone"])
        centre[i] = (w[i] * centre[i] + w[j] * centre[j]) / (w[i] + w[j])
        w[i], alive[j] = w[i] + w[j], False


@pytest.mark.parametrize("p", [1.5, 2.0, 3.0])
@pytest.mark.parametrize("far", [False, True])
def test_closest_looks_at_probed_groups_only(p, far):
    q, b = rows(5, 0.0)
    if far:
        # without finite products all pairs are measured
        b[0] = np.inf
    rng = np.random.default_rng(2)
    group, looks = rng.integers(0, 9, len(b)), rng.random((len(q), 10)) < 0.4
    looks[0], looks[1], looks[:, 9], group[0] = False, np.arange(10) == 4, False, 9
    every = np.where(looks[:, group], tiles._distances(q, b, p), np.inf)
    order = np.argsort(every, axis=1, kind="stable")[:, :60]
    place, distance = tiles.closest(q, b, 60, p, probed=(looks, group))
    found = np.take_along_axis(every, order, 1) < np.inf
    assert not found[0].any() and not found[1].all()
    assert (place[found] == order[found]).all() and (place[~found] == len(b)).all()
    assert (distance[found] == np.take_along_axis(every, order, 1)[found]).all()


@pytest.mark.parametrize("scale, offset", [(1.0, 0.0), (1e-30, 0.0), (1e60, 0.0), (1.0, 1e4)])
def test_cubes_by_products_lose_no_pair_and_let_few_others_pass(scale, offset):
    q, b = (v * scale for v in rows(64, offset))
    every = tiles._distances(q, b, 3.0)
    limit = np.sort(every, axis=1)[:, 9]
    cubes = tiles.Cubes(q, b, float(np.median(limit)))
    hits = cubes.below(np.arange(len(q)), np.arange(len(b)), limit)
    assert set(np.flatnonzero(every <= limit[:, None])) <= set(hits)
    by_squares, _, _ = tiles.Products(q, b).below(np.arange(len(q)), np.arange(len(b)), limit**2 * tiles._most(3.0, 64))
    assert len(hits) < len(by_squares) / 2
    same = tiles.Cubes(q[:1], q[:1], 1.0)
    assert len(same.below(np.arange(1), np.arange(1), np.zeros(1))) == 1
