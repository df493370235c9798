from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from cadenza.operators import features as FE
from cadenza.operators import similarity as SIM


def _brute(vecs, cats=None):
    V = np.array(vecs, dtype=float)
    if cats is not None:
        S = V @ V.T + (np.array(cats)[:, None] == np.array(cats)[None, :])
        n = np.sqrt((V * V).sum(1) + 1)
    else:
        S = V @ V.T
        n = np.sqrt((V * V).sum(1))
    den = n[:, None] * n[None, :]
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(den == 0, 0.0, S / den)


def _topk_ref(S, ids, k):
    out = {}
    for i, q in enumerate(ids):
        cand = [(round(S[i, j], 9), ids[j]) for j in range(len(ids)) if j != i]
        cand.sort(key=lambda x: (-x[0], x[1]))
        out[q] = [c[1] for c in cand[:k]]
    return out


def test_top_k_matches_brute_force_with_ties_and_zero(spark):
    rng = np.random.default_rng(1)
    vecs = rng.normal(size=(60, 5)).round(1).tolist()
    vecs[3] = [0.0] * 5           # zero vector: similarity 0 to all
    vecs[10] = list(vecs[11])     # exact duplicate: a tie broken by id
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vecs)], "id long, v array<double>")
    got = SIM.top_k_neighbours(df, "id", "v", 4, block_rows=16)
    g = {}
    for r in got.orderBy("qid", "rank").collect():
        g.setdefault(r["qid"], []).append(r["rid"])
    ref = _topk_ref(_brute(vecs), list(range(60)), 4)
    assert g == ref
    assert all(q not in v for q, v in g.items())  # never holds itself


def test_top_k_with_category(spark):
    rng = np.random.default_rng(2)
    vecs = rng.normal(size=(40, 2)).tolist()
    cats = [f"c{i % 3}" for i in range(40)]
    df = spark.createDataFrame([(i, v, c) for i, (v, c) in enumerate(zip(vecs, cats))], "id long, v array<double>, c string")
    got = SIM.top_k_neighbours(df, "id", "v", 3, category_col="c", block_rows=8)
    g = {}
    for r in got.orderBy("qid", "rank").collect():
        g.setdefault(r["qid"], []).append(r["rid"])
    assert g == _topk_ref(_brute(vecs, cats), list(range(40)), 3)


def test_mean_similarity_linear_equals_pairwise(spark):
    rng = np.random.default_rng(3)
    vecs = rng.normal(size=(30, 3)).tolist()
    cats = [f"c{i % 4}" for i in range(30)]
    df = spark.createDataFrame([(i, v, c) for i, (v, c) in enumerate(zip(vecs, cats))], "id long, v array<double>, c string")
    for cat in (None, "c"):
        ms = {r["id"]: r["mean_similarity"] for r in SIM.mean_similarity(df, "id", "v", category_col=cat).collect()}
        S = _brute(vecs, cats if cat else None)
        for i in range(30):
            assert abs(ms[i] - S[i].mean()) < 1e-12


def test_cosine_column_and_zero(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<double>, b array<double>")
    got = [r[0] for r in df.select(SIM.cosine("a", "b")).collect()]
    assert abs(got[0] - 0.7071067811865475) < 1e-15 and got[1] == 0.0


def test_minmax_constant_column_is_zero(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0), (None, 5.0)], "x double, c double")
    got = FE.minmax(df, ["x", "c"]).collect()
    assert [(r["x"], r["c"]) for r in got] == [(1 / 3, 0.0), (1.0, 0.0), (0.0, 0.0)]


def test_standardize_population_std(spark):
    df = spark.createDataFrame([(1.0,), (3.0,)], "x double")
    assert [r["x"] for r in FE.standardize(df, ["x"]).collect()] == [-1.0, 1.0]


def test_vectors_of_different_lengths_are_an_error(spark):
    import pytest
    df = spark.createDataFrame([([0.0, 10.0],), ([2.0],)], "v array<double>")
    with pytest.raises(ValueError, match="1 to 2"):
        FE.array_dim(df, "v")


def test_minmax_array(spark):
    df = spark.createDataFrame([([0.0, 10.0],), ([2.0, 10.0],)], "v array<double>")
    got = [r["v"] for r in FE.minmax_array(df, "v").collect()]
    assert got == [[0.0, 0.0], [1.0, 0.0]]


def test_top_n_tie_break(spark):
    df = spark.createDataFrame([(1, 0.5), (2, 0.5), (3, 0.9)], "id long, s double")
    assert [r["id"] for r in SIM.top_n(df, "s", "id", 2).collect()] == [3, 1]
    assert df.select(F.lit(1)).count() == 3


def test_top_k_every_query_answered_many_blocks(spark):
    # enough rows for several blocks per side: every query must get k rows
    rng = np.random.default_rng(9)
    vecs = rng.normal(size=(900, 8)).tolist()
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vecs)], "id long, v array<double>")
    got = SIM.top_k_neighbours(df, "id", "v", 3, block_rows=128)
    assert got.count() == 900 * 3
    g = {}
    for r in got.orderBy("qid", "rank").collect():
        g.setdefault(r["qid"], []).append(r["rid"])
    assert g == _topk_ref(_brute(vecs), list(range(900)), 3)


def test_top_k_with_a_third_of_rows_identical(spark):
    rng = np.random.default_rng(11)
    vecs = rng.normal(size=(150, 6)).tolist()
    copy = vecs[0]
    for i in range(0, 150, 3):  # a third of all rows are the same vector
        vecs[i] = list(copy)
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vecs)], "id long, v array<double>")
    got = SIM.top_k_neighbours(df, "id", "v", 4, block_rows=32)
    g = {}
    for r in got.orderBy("qid", "rank").collect():
        g.setdefault(r["qid"], []).append(r["rid"])
    assert g == _topk_ref(_brute(vecs), list(range(150)), 4)
    assert got.count() == 150 * 4  # bounded output: k rows per item, no pair explosion


def test_mean_and_top_k_agree_on_items_without_a_category(spark):
    import numpy as np
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.standard_normal(3)], c) for i, c in enumerate(["a", None, "b", None, "a", None])]
    df = spark.createDataFrame(rows, "id long, v array<double>, c string")
    pairs = {(r.qid, r.rid): r.score for r in SIM.top_k_neighbours(df, "id", "v", 5, category_col="c").collect()}
    for r in SIM.mean_similarity(df, "id", "v", category_col="c").collect():
        others = [s for (q, _), s in pairs.items() if q == r.id]
        assert abs(r.mean_similarity - (1 + sum(others)) / 6) < 1e-9


def _found(df):
    g = {}
    for r in df.orderBy("qid", "rank").collect():
        g.setdefault(r["qid"], []).append(r["rid"])
    return g


def test_pruned_top_k_over_cells(spark):
    """Clusters, copies, zero vectors and a category over many cells."""
    rng = np.random.default_rng(21)
    centres = rng.normal(size=(12, 6)) * 4
    vecs = (centres[rng.integers(0, 12, 500)] + rng.normal(size=(500, 6)) * 0.3).round(2)
    vecs[::9] = vecs[0]
    vecs[5] = vecs[77] = 0.0
    ids = rng.permutation(5000)[:500].tolist()
    order = np.argsort(ids)
    cats = [f"c{i % 3}" if i % 7 else None for i in range(500)]
    df = spark.createDataFrame([(int(i), v.tolist(), c) for i, v, c in zip(ids, vecs, cats)], "id long, v array<double>, c string")
    for cat in (None, "c"):
        got = _found(SIM.top_k_neighbours(df, "id", "v", 4, category_col=cat, block_rows=16, cell_rows=40))
        want = _topk_ref(_brute(vecs[order], np.array(cats, dtype=object)[order] if cat else None),
                         [ids[i] for i in order], 4)
        assert got == want


def test_clustered_vectors_are_sent_to_few_cells(spark, monkeypatch):
    """Rows sent a vector do not grow with the vectors."""
    seen = []
    others = SIM._others
    monkeypatch.setattr(SIM, "_others", lambda sent, *a: seen.append(sent.count()) or others(sent, *a))
    for n in (400, 1600):
        rng = np.random.default_rng(n)
        centres = rng.normal(size=(n // 20, 8))
        vecs = centres[rng.integers(0, n // 20, n)] + rng.normal(size=(n, 8)) * 0.02
        df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vecs)], "id long, v array<double>")
        assert SIM.top_k_neighbours(df, "id", "v", 3, block_rows=64, cell_rows=20).count() == 3 * n
    assert seen[0] / 400 < 4 and seen[1] / 1600 < 1.5 * max(1, seen[0] / 400)


def test_long_request_list_by_blocks_equals_the_sent_list(spark, monkeypatch):
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(300, 4)))], "id long, v array<double>")
    ask = df.filter("id % 3 = 0")
    want = _found(SIM.top_k_neighbours(df, "id", "v", 3, queries=ask))
    monkeypatch.setattr(SIM, "SENT_NUMBERS", 10)
    assert _found(SIM.top_k_neighbours(df, "id", "v", 3, queries=ask, block_rows=32)) == want


def test_noise_is_sent_once_a_share(spark, monkeypatch):
    """Vectors without nearness meet all cells, but rows sent a vector do not
    grow with the vectors, on either side."""
    sent, refs = [], []
    others = SIM._others

    def counted(asked, placed, block):
        tasks = asked.groupBy("share", "qblk").count().collect()
        sent.append(sum(r["count"] for r in tasks))
        refs.append(max(Counter(r["share"] for r in tasks).values()))
        return others(asked, placed, block)

    monkeypatch.setattr(SIM, "_others", counted)
    for n in (200, 800):
        vecs = np.random.default_rng(n).normal(size=(n, 16))
        df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vecs)], "id long, v array<double>")
        got = _found(SIM.top_k_neighbours(df, "id", "v", 3, block_rows=16, cell_rows=10))
        assert got == _topk_ref(_brute(vecs), list(range(n)), 3)
        shares = int(np.ceil(np.sqrt(8 * spark.sparkContext.defaultParallelism))) + 1
        assert max(sent) <= n * shares and max(refs) <= shares


def test_a_task_holds_one_block_of_scores():
    """A task of many rows holds the scores of one block, not of all its rows."""
    import tracemalloc

    import pyarrow as pa
    rng = np.random.default_rng(3)
    v = [r.tolist() for r in rng.normal(size=(3000, 4))]
    q = pa.table({"qid": list(range(3000)), "qv": v, "qc": pa.array([None] * 3000, pa.string())})
    r = pa.table({"rid": list(range(3000)), "rv": v, "rc": pa.array([None] * 3000, pa.string())})
    tracemalloc.start()
    got = SIM._topk_block(2, True, False, 256)(q, r)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 3000 * 3000 * 8 / 4  # a quarter of one matrix of all scores
    S = _brute(v)
    np.fill_diagonal(S, -2)
    nearest = dict(zip(got["qid"].to_pylist()[::2], got["rid"].to_pylist()[::2]))
    assert nearest == dict(enumerate(S.argmax(1).tolist()))


def test_shares_of_cells():
    first, parts = SIM._shares(np.array([5, 0, 4, 12, 45, 3, 3]), 10)
    assert first.tolist() == [0, 0, 0, 1, 2, 6, 6] and parts.tolist() == [1, 1, 1, 1, 4, 1, 1]


def test_a_vector_with_a_missing_number_takes_a_place_of_its_block(spark):
    rng = np.random.default_rng(6)
    vecs = [r.tolist() for r in rng.normal(size=(40, 3))]
    vecs[7] = [None, 1.0, 1.0]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vecs)], "id long, v array<double>")
    blocks = df.select("id", F.pmod(F.xxhash64("id"), F.lit(3)).alias("b")).collect()  # of local[4], 40 rows
    of = {r["id"]: r["b"] for r in blocks}
    known = [i for i in range(40) if i != 7]
    S = _brute([vecs[i] for i in known])
    want = {}
    for i, q in enumerate(known):
        left = []
        for b in range(3):
            rank = sorted((-round(S[i, j], 9), r) for j, r in enumerate(known) if of[r] == b)
            left += rank[:4 - (of[7] == b)]  # the row itself is one of k + 1
        want[q] = [r for _, r in sorted(left) if r != q][:3]
    assert _found(SIM.top_k_neighbours(df, "id", "v", 3)) == want
