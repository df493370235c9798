import numpy as np
import pytest

from cadenza.llm import learned_partitions as p

KIND = "vec_id long, embedding array<float>, label int, score double, task long"


def frame(spark, ids, x):
    return spark.createDataFrame([(i, None if v is None else [float(c) for c in v], 0, 1.0, 2)
                                  for i, v in zip(ids, x)], KIND)


def brute(ids, x, k, every):
    x = np.asarray(x, np.float32).astype(float)
    n = np.sqrt((x * x).sum(1))
    out = {}
    for i, v in zip(ids, range(len(ids))):
        if i % every == 0:
            s = (x * x[v]).sum(1) / (n * n[v])
            s[v] = -np.inf
            top = np.lexsort((ids, -s))[:k]
            out[i] = [(int(ids[t]), s[t]) for t in top]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
    return out


@pytest.mark.parametrize("kind", ["random", "clusters"])
def test_recall(spark, monkeypatch, kind):
    monkeypatch.setattr(p, "INDEX_BLOCK", 100)
    monkeypatch.setattr(p, "QUERY_BLOCK", 7)
    rng = np.random.default_rng(1)
    x = rng.standard_normal((3000, 16))
    if kind == "clusters":
        x = x * 0.3 + rng.standard_normal((30, 16))[rng.integers(0, 30, 3000)]
    ids = rng.permutation(10_000)[:3000]
    df = frame(spark, ids.tolist(), x).repartition(3)
    router = p.fit(df)
    got = found(p.search(df, router, 5, 50))
    want = brute(ids, x, 5, 50)
    assert set(got) == set(want)
    hits = sum(len({v for v, _ in got[q]} & {v for v, _ in want[q]}) for q in want)
    assert hits >= 0.9 * 5 * len(want)
    if kind == "clusters":  # and most partitions are left alone
        probed = router.before(router.probabilities(p._unit(x))) <= router.share
        assert probed.mean() < 0.5
    scores = {(q, v): s for q in want for v, s in want[q]}
    assert all(s == pytest.approx(scores.get((q, v), s), abs=1e-12) for q in got for v, s in got[q])


def test_partitions_are_balanced():
    u = p._unit(np.random.default_rng(2).standard_normal((800, 8)))
    part = p.balanced_partitions(p.neighbour_graph(u, 10), 8)
    assert np.bincount(part, minlength=8).max() <= 1.05 * 100 + 1
    graph = p.neighbour_graph(u, 10)
    cut = (part[graph] != part[:, None]).mean()
    assert cut < 0.8 * 7 / 8  # fewer edges than a random partition cuts


def test_ties_copies_and_bad_vectors(spark):
    same = [1.0, 2.0, 3.0]
    ids = [0, 7, 5, 9, 3, 50, 100, 1, 2, 4, 6, None, 0]
    x = [same, same, [2.0, 4.0, 6.0], same, same, None, [0.0, 0.0, 0.0], [np.nan, 1, 1], [np.inf, 1, 1],
         [1.0, 2.0], [-1.0, -2.0, -3.0], same, same]
    df = frame(spark, ids, x)
    got = found(p.search(df, p.fit(df), 5, 50))
    assert [v for v, _ in got[0]] == [3, 5, 7, 9, 6]
    assert got[0][-1][1] == pytest.approx(-1) and got[0][0][1] == pytest.approx(1)
    assert set(got) == {0}
    holes = spark.createDataFrame([(0, [1.0, None]), (1, [1.0, 2.0]), (50, [2.0, 1.0])], "vec_id long, embedding array<double>")
    assert {q: [v for v, _ in r] for q, r in found(p.search(holes, p.fit(holes))).items()} == {50: [1]}
    none = frame(spark, [], [])
    assert p.search(none, p.fit(none)).count() == 0


def test_copies_of_one_vector_in_a_third_of_all(spark, monkeypatch):
    monkeypatch.setattr(p, "INDEX_BLOCK", 50)
    rng = np.random.default_rng(3)
    x = rng.standard_normal((900, 8))
    x[::3] = x[0]
    ids = np.arange(900)
    got = found(p.search(frame(spark, ids.tolist(), x), p.fit(frame(spark, ids.tolist(), x)), 5, 50))
    want = brute(ids, x, 5, 50)
    for q in (0, 150, 300, 450):
        assert [v for v, _ in got[q]] == [v for v, _ in want[q]]


def sides():
    """Two partitions by the sign of the first component; the likelier one
    holds nearly all probability away from zero."""
    return p.Router([np.array([[1.0, -1.0], [0.0, 0.0]]), np.zeros(2), np.eye(2) * 10, np.zeros(2)], 1.0, 2)


@pytest.mark.parametrize("few", [100_000, 0])
def test_two_vectors_under_one_id_are_the_smallest(spark, monkeypatch, few):
    monkeypatch.setattr(p, "BROADCAST_IDS", few, raising=False)
    ids = [1, 1, 2, 3, 4, 5, 6, 50, 50, 1]
    x = [[1, 0.1], [-1, 0.1], [1, 0.5], [1, 0.4], [-1, 0.5], [-1, 0.9], [1, 0.9], [0.5, 1], [-0.5, 1], [-9]]
    got = found(p.search(frame(spark, ids, x), sides(), 5, 50))
    own = dict(zip(ids, x)) | {1: [-1, 0.1], 50: [-0.5, 1]}
    keys = np.array(sorted(own))
    want = brute(keys, [own[i] for i in keys], 5, 50)
    assert [v for v, _ in got[50]] == [v for v, _ in want[50]] and len({v for v, _ in got[50]}) == 5
    assert [s for _, s in got[50]] == pytest.approx([s for _, s in want[50]])


def test_a_query_goes_on_until_its_list_is_full(spark):
    """Its likeliest partition passes the share but holds two vectors."""
    router = sides()
    router.share = 0.5
    rng = np.random.default_rng(4)
    ids = list(range(48, 68))
    x = [[1.0 if i in (49, 50) else -1.0, y] for i, y in zip(ids, rng.standard_normal(20))]
    got = found(p.search(frame(spark, ids, x), router, 5, 50))
    assert got[50] == [(v, pytest.approx(c, abs=1e-12)) for v, c in brute(np.array(ids), x, 5, 50)[50]]
    few = found(p.search(frame(spark, ids[:4], x[:4]), router, 5, 50))
    assert {v for v, _ in few[50]} == {48, 49, 51}


def test_vectors_of_every_length_are_searched(spark):
    """Lengths do not meet; each is searched exactly as alone."""
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=6 if i % 3 else 4).tolist()) for i in range(300)] + [(900, []), (901, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = p.search_each_length(df, k=3, every=5, parts=2).collect()
    size = {i: len(v) for i, v in rows if v}
    assert {r.query_id for r in got} == {i for i in size if i % 5 == 0}
    assert all(size[r.query_id] == size[r.vec_id] for r in got)
    best = {r.query_id: r.vec_id for r in got if r.rank == 1}
    x = {i: np.array(v) / np.linalg.norm(v) for i, v in rows if v}
    right = sum(max((i for i in x if i != q and size[i] == size[q]), key=lambda i: x[q] @ x[i]) == v for q, v in best.items())
    assert right >= 0.9 * len(best)
    none = p.search_each_length(spark.createDataFrame([], "vec_id long, embedding array<double>"))
    assert none.count() == 0 and none.columns == ["query_id", "rank", "vec_id", "score"]


def clustered(n, seed=5):
    rng = np.random.default_rng(seed)
    return rng.standard_normal((n // 40, 16))[rng.integers(0, n // 40, n)] + 0.3 * rng.standard_normal((n, 16))


def test_partitions_grow_with_the_vectors(spark, monkeypatch):
    """More vectors, more leaves: the share of all vectors that a query
    meets falls, and recall stays."""
    monkeypatch.setattr(p, "LEAF_ROWS", 150)
    monkeypatch.setattr(p, "LEAF_ROOT", 1)
    share = []
    for n in (5_000, 20_000):
        x = clustered(n)
        df = p._valid(frame(spark, range(n), x).repartition(4), "vec_id", "embedding")
        router = p.grow(df, p.fit_router(x[:2000]))
        held, _ = p._counted(df, router, 100)
        assert held.sum() == n and len(held) == len(router.leaves())
        row, leaf = router.asked(p._unit(x[::100]))
        share.append(held[leaf].sum() / (n * len(x[::100])))
        got, want = found(p._found(df, router, 5, 100)), brute(np.arange(n), x, 5, 100)
        assert set(got) == set(want)
        assert sum(len({v for v, _ in got[q]} & {v for v, _ in want[q]}) for q in want) >= 0.9 * 5 * len(want)
        assert len(held) > 32 and router.children
    assert share[1] < 0.7 * share[0], share


def test_a_tree_by_plain_python():
    """Leaf numbers, chances and the share needed, leaf by leaf."""
    rng = np.random.default_rng(7)
    root = p.fit_router(rng.standard_normal((400, 6)), 4)
    root.children = {1: p.fit_router(rng.standard_normal((300, 6)), 3), 3: p.fit_router(rng.standard_normal((300, 6)), 2)}
    root.children[1].children = {2: p.fit_router(rng.standard_normal((300, 6)), 2)}
    u = p._unit(rng.standard_normal((50, 6)))
    places = root.leaves()
    assert len(places) == 8 and places[1] == (root.children[1], 0)
    assert root.chances(u).sum(1) == pytest.approx(1.0)
    home = root.home(u)
    for i, v in enumerate(u):
        node, path = root, []
        while True:
            best = int(node.probabilities(v[None])[0].argmax())
            path.append((node, best))
            if best not in node.children:
                break
            node = node.children[best]
        assert places[home[i]] == path[-1]
        q = u[(i + 1) % 50][None]
        need = max(node.before(node.probabilities(q))[0, best] for node, best in path)
        assert root.needed(q, v[None])[0] == pytest.approx(need)
        root.share = need + 1e-9
        assert home[i] in root.asked(q)[1]
        root.share = need - 1e-9
        assert home[i] not in root.asked(q)[1]
    root.share = -1.0  # nothing by the share: on by chance until three are held
    held = np.array([0, 1, 5, 0, 2, 1, 0, 1])
    row, leaf = root.asked(u, held, 3)
    for i in range(50):
        order, want, n = np.argsort(-root.chances(u[i:i + 1])[0], kind="stable"), set(), 0
        for j in order:
            if n < 3 and held[j]:
                want.add(j)
                n += held[j]
        assert set(leaf[row == i]) == want


def test_copies_of_one_vector_are_not_cut(spark, monkeypatch):
    monkeypatch.setattr(p, "LEAF_ROWS", 50)
    monkeypatch.setattr(p, "LEAF_ROOT", 1)
    x = np.tile([[1.0, 2.0, 3.0]], (600, 1))
    got = found(p.search_each_length(frame(spark, range(600), x), 5, 50))
    assert [v for v, _ in got[0]] == [1, 2, 3, 4, 5] and [v for v, _ in got[50]] == [0, 1, 2, 3, 4]
    assert len(got) == 12
