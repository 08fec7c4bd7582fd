import numpy as np
import pytest

from veritab.llm import projected_search as ps

SCHEMA = "vec_id long, embedding array<float>, label int, block int, group int, v string"


def vectors(n=400, d=16):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((12, d))
    x = centres[rng.integers(0, 12, n)] + 0.3 * rng.standard_normal((n, d))
    out = [(i, [float(np.float32(v)) for v in row], 1, 1, 1, "z") for i, row in enumerate(x)]
    same = out[7][1]
    out += [(1000 + i, same, 1, 1, 1, "z") for i in range(60)]
    out += [(2000, None, 1, 1, 1, "z"), (2020, [0.0] * d, 1, 1, 1, "z"), (2040, [float("nan")] * d, 1, 1, 1, "z"), (2060, [None] + [1.0] * (d - 1), 1, 1, 1, "z"), (2080, [float("inf")] * d, 1, 1, 1, "z"), (2100, [1.0] * 3, 1, 1, 1, "z"), (None, same, 1, 1, 1, "z"), (2120, [], 1, 1, 1, "z")]
    return out


def brute(rows, k):
    good = [(i, np.array(v, float)) for i, v, *_ in rows if i is not None and v is not None and len(v) == 16 and None not in v and np.isfinite(np.array(v, float)).all() and np.any(v)]
    for q, x in good:
        if q % 20 == 0:
            yield q, sorted(((-float(np.einsum("i,i->", y, x)), i) for i, y in good if i != q))[:k]


@pytest.mark.parametrize("blocks", [{}, {"block_rows": 100, "query_rows": 5, "leaf": 8}])
def test_recall_order_and_ties(spark, blocks):
    rows = vectors()
    got = {}
    for r in ps.nearest(spark.createDataFrame(rows, SCHEMA), **blocks).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    want = dict(brute(rows, 20))
    assert got.keys() == want.keys()
    hit = 0
    for q, found in got.items():
        found.sort()
        assert [f[0] for f in found] == list(range(1, len(want[q]) + 1))
        assert [(-f[2], f[1]) for f in found] == sorted((-f[2], f[1]) for f in found)
        hit += len({f[1] for f in found} & {i for _, i in want[q]})
    assert hit / sum(map(len, want.values())) >= 0.95


def test_copies_that_no_cell_can_split(spark):
    """A third of the rows are one vector: its cell is dealt to blocks, and every copy is a candidate."""
    rng = np.random.default_rng(8)
    x = rng.standard_normal((200, 16))
    rows = [(i, r.tolist()) for i, r in enumerate(x)] + [(500 + i, x[20].tolist()) for i in range(100)]
    got = {}
    found = ps.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), block_rows=25, leaf=8, first_cells=2)
    for r in found.collect():
        got.setdefault(r.query_id, []).append((-r.score, r.vec_id))
    want = dict(brute(rows, 20))
    assert got.keys() == want.keys() and sorted(i for _, i in got[20]) == list(range(500, 520))
    assert sum(len({i for _, i in got[q]} & {i for _, i in want[q]}) for q in got) >= 0.9 * sum(map(len, want.values()))


def test_cells():
    rng = np.random.default_rng(2)
    x = rng.standard_normal((1000, 3))
    c = ps.Cells(x, 7)
    n = np.bincount(c.assign(x))
    assert c.count == len(n) == 7 and n.min() >= 100 and n.max() <= 200
    assert ps.Cells(np.ones((50, 3)), 7).count == ps.Cells(np.zeros((0, 3)), 7).count == 1


def test_few_and_none(spark):
    few = spark.createDataFrame([(0, [1.0, 2.0]), (1, [2.0, 1.0]), (20, [1.0, 1.0])], "vec_id long, embedding array<float>")
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in ps.nearest(few).collect()) == [(0, 1, 1, 4.0), (0, 2, 20, 3.0), (20, 1, 0, 3.0), (20, 2, 1, 3.0)]
    assert ps.nearest(few.where("false")).count() == 0


def test_chi_square():
    assert ps.chi_square_cdf(np.array([2.0]), 2)[0] == pytest.approx(1 - np.exp(-1))
    assert ps.chi_square_cdf(ps.chi_square_point(0.8, 8), 8) == pytest.approx(0.8)


def test_boxes():
    """Cells by descent against all boxes measured, over levels of any size and queries of any reach."""
    rng = np.random.default_rng(5)
    for n in (1, 15, 16, 17, 300, 5000):
        low = np.sort(rng.standard_normal((n, 4)), 0)
        high = low + rng.random((n, 4))
        queries = rng.standard_normal((30, 4)) * 2
        every = ps.box_distances(low, high, queries)
        reach = rng.choice([0.0, 0.5, 3.0, np.inf], 30)
        row, cell = ps.BoxTree(low, high).within(queries, reach)
        assert sorted(zip(row.tolist(), cell.tolist())) == sorted(zip(*(x.tolist() for x in np.nonzero(every <= reach[:, None] * (1 + 1e-12)))))
        row, cell = ps.BoxTree(low, high).nearest(queries, 3, beam=10**6)
        got = every[row, cell].reshape(30, -1)
        assert np.allclose(got, np.sort(every, 1)[:, :3])
