from fractions import Fraction

import duckdb
import numpy as np
import pytest

from weekloom.llm import vector_blocks
from weekloom.llm.ann import nearest_neighbours
from weekloom.llm.mixing import MIX_SQL, mix_sources
from weekloom.llm.topk import threshold_search, topk_inner_product

VEC = "vec_id long, embedding array<float>, score int, v string"


def vectors(n=400, dim=8, seed=1):
    x = np.random.default_rng(seed).normal(size=(n, dim)).astype(np.float32)
    x[7] = x[11]  # a tie
    return x


def frame(spark, x):
    bad = [(900, None, 0, "x"), (1000, [1.0, float("nan")] + [0.0] * 6, 0, "x"), (1100, [None] * 8, 0, "x"), (1200, [], 0, "x"), (901, [float("inf")] * 8, 0, "x")]
    return spark.createDataFrame([(i, [float(v) for v in r], 0, "x") for i, r in enumerate(x)] + [(5, [float(v) for v in x[5]], 0, "x")] + bad, VEC)


def test_topk_matches_brute_force(spark):
    x = vectors()
    z = np.floor(1024 * x.astype(np.float64))
    got = [tuple(r) for r in topk_inner_product(frame(spark, x)).orderBy("query_id", "rank").collect()]
    want = []
    for q in range(0, 400, 100):
        s = z @ z[q]
        best = sorted((i for i in range(400) if i != q), key=lambda i: (-s[i], i))[:10]
        want += [(q, k + 1, i, int(s[i])) for k, i in enumerate(best)]
    assert got == want


def test_threshold_stops_early_and_fewer_rows_than_k():
    x = np.zeros((5000, 2))
    x[:, 0] = np.arange(5000)
    q, ids, s = threshold_search(np.array([-1]), np.array([[1.0, 0.0]]), [float("nan")], np.arange(5000), x, 3)
    assert ids.tolist() == [4999, 4998, 4997]
    q, ids, s = threshold_search(np.array([0]), np.array([[0.0, 0.0]]), [float("nan")], np.arange(3), np.ones((3, 2)), 10)
    assert ids.tolist() == [1, 2] and s.tolist() == [0, 0]


def test_topk_of_any_size_over_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(vector_blocks, "ROWS", 64)
    rng = np.random.default_rng(3)
    rows = [(i, [float(v) for v in rng.normal(size=6) * (1.0, 1e5, 1e12, 1e300)[i % 4 if i < 40 else 0]]) for i in range(300)]
    rows += [(300 + i, [float(v) for v in rng.normal(size=3)]) for i in range(120)] + [(None, [1.0] * 6), (200, [1e308] * 6), (500, [20000.0, 0.0, 0.0])]
    df = spark.createDataFrame([(i, v, 0, "x") for i, v in rows], "vec_id long, embedding array<double>, score int, v string")
    got = {}
    for r in topk_inner_product(df).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    whole = [(i, [Fraction(x) * 1024 // 1 for x in v]) for i, v in rows if i is not None]
    want = {}
    for q, a in whole:
        if q % 100 == 0:
            want.setdefault(q, []).extend((max(-(2**63), min(2**63 - 1, sum(int(x) * int(y) for x, y in zip(a, v, strict=True)))), i) for i, v in whole if i != q and len(v) == len(a))
    assert got == {q: [(i, x) for x, i in sorted(s, key=lambda t: (-t[0], t[1]))[:10]] for q, s in want.items()}


@pytest.mark.parametrize("dim", [16, 64])
def test_ann_scores_are_exact_and_recall_is_high(spark, dim):
    x = vectors(1500, dim).astype(np.float64)
    rows = spark.createDataFrame([(i, [float(v) for v in r], 0, "x") for i, r in enumerate(x)] + [(9900, [0.0] * dim, 0, "x"), (None, [1.0] * dim, 0, "x"), (9800, [1.0] * 3, 0, "x")], VEC)
    got = nearest_neighbours(rows).orderBy("query_id", "rank").collect()
    x = np.array([[float(np.float32(v)) for v in r] for r in x])
    hits = 0
    for q in range(0, 1500, 100):
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        want = sorted((i for i in range(1500) if i != q), key=lambda i: (d[i], i))[:10]
        mine = [r for r in got if r.query_id == q]
        assert [r["rank"] for r in mine] == list(range(1, 11))
        assert all(abs(r.score - d[r.vec_id]) < 1e-9 for r in mine)
        hits += len({r.vec_id for r in mine} & set(want))
    assert hits / 150 >= 0.9


@pytest.mark.parametrize("kind", ["centred", "offset 10", "offset 100", "heavy tails", "clusters", "one point"])
def test_ann_finds_all_however_the_codes_fit(spark, monkeypatch, kind):
    monkeypatch.setattr(vector_blocks, "ROWS", 300)
    rng = np.random.default_rng(8)
    x = rng.normal(size=(900, 12))
    x = {"centred": x, "offset 10": x + 10, "offset 100": x + 100, "heavy tails": rng.standard_cauchy(size=x.shape), "clusters": x * 0.01 + 50 * rng.integers(-2, 3, size=(900, 1)), "one point": np.ones_like(x)}[kind]
    x[5] = x[400] = x[401]
    rows = [(i, r) for i, r in enumerate(x)] + [(5, x[7]), (17, x[200] + 1e-3), (300, x[3]), (300, x[3])]
    df = spark.createDataFrame([(i, [float(v) for v in r], 0, "x") for i, r in rows], "vec_id long, embedding array<double>, score int, v string")
    got = {}
    for r in nearest_neighbours(df).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.score, r.vec_id))
    want = {}
    for q, a in rows:
        if q % 100 == 0:
            want.setdefault(q, []).extend((float(np.sqrt(((a - v) ** 2).sum())), i) for i, v in rows if i != q)
    assert got.keys() == want.keys()
    for q, found in got.items():
        best = sorted(want[q])[:10]
        assert np.allclose([s for s, _ in found], [s for s, _ in best], rtol=1e-9, atol=1e-12)
        if kind != "one point":
            assert sorted(i for _, i in found) == sorted(i for _, i in best)
        else:
            assert [i for _, i in found] == [i for _, i in best]


@pytest.mark.parametrize("operator", [topk_inner_product, nearest_neighbours])
def test_empty_vectors(spark, operator):
    assert operator(spark.createDataFrame([], VEC)).count() == 0


def documents():
    rows = [(i, " ".join(["w"] * (i % 37 + 1)), f"s{i % 4}") for i in range(300)]
    return rows + [(301, None, "s0"), (302, "", "s1"), (303, " \t\n", None), (304, "a b c", None), (None, "x y", "s2"), (7, rows[7][1], "s3")]


def test_mix_equals_sql_and_stays_near_targets(spark):
    df = spark.createDataFrame(documents(), "doc_id long, text string, source string").selectExpr("*", "1 as size", "2 as target", "3 as name")
    key = lambda r: tuple((x is None, x) for x in r)
    got = sorted((tuple(r) for r in mix_sources(df).collect()), key=key)
    con = duckdb.connect()
    con.execute("create table d(doc_id bigint, text varchar, source varchar)")
    con.executemany("insert into d values (?, ?, ?)", documents())
    want = sorted(con.sql(MIX_SQL.format(docs="d")).fetchall(), key=key)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert all(r[4] <= 2 * r[1] for r in got)
    by = {}
    for r in got:
        t = by.setdefault((r[2], r[3]), [0, 0])
        t[0] += r[4]
    for (size, target), (taken, _) in by.items():
        assert abs(taken - target) <= 80 and target <= 2 * size
    assert abs(sum(r[3] for r in {(r[2], r[3]): r for r in got}.values()) - 1.5 * sum(r[1] for r in got)) < 1


def test_mix_of_nothing(spark):
    assert mix_sources(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0
    assert [r.taken for r in mix_sources(spark.createDataFrame([(1, None, None)], "doc_id long, text string, source string")).collect()] == [0]
