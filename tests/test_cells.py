"""Nearest vectors from stored cells against the plain distances, and how many cells are read."""

import numpy as np
import pytest

from lectern.operators import vector_cells as C

V = "vec_id long, embedding array<double>, cell string, n int"


def table(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [float(x) for x in v], "x", 1) for i, v in rows], V).repartition(3)


def plain(rows, queries, k, keep_self):
    out = set()
    for i, q in queries:
        near = sorted((round(float(np.sqrt(((np.array(v) - q) ** 2).sum())), 6), j) for j, v in rows if keep_self or i != j)
        out |= {(i, j, d, r + 1) for r, (d, j) in enumerate(near[:k])}
    return out


@pytest.mark.parametrize(("cells", "keep_self"), [(1, False), (12, True), (40, False)])
def test_same_as_plain(spark, tmp_path, cells, keep_self):
    r = np.random.default_rng(1)
    middle = r.normal(0, 20, (8, 4)) + 50  # one-sided: signs tell nothing
    rows = [(i, (middle[i % 8] + r.normal(0, 1, 4)).round(3)) for i in range(400)] + [(900 + i, middle[0]) for i in range(30)]
    C.write_cells(table(spark, [*rows, (1000, None), (1001, [1.0]), (1002, [np.nan] * 4), (None, middle[0])]), str(tmp_path), cells)
    queries = [*rows[::57], (5000, np.zeros(4)), (5001, middle[3])]
    got = C.nearest_in_cells(spark, str(tmp_path), table(spark, [*queries, (7, None)]), 5, 6, keep_self).collect()
    assert {(g.query_id, g.vec_id, g.distance, g.rank) for g in got} == plain(rows, queries, 5, keep_self)
    if cells == 40:
        assert np.mean([g.cells_read for g in got]) < 15


def test_few_and_none(spark, tmp_path):
    C.write_cells(table(spark, [(1, [0.0, 1.0]), (2, [1.0, 0.0]), (2, [1.0, 0.0])]), f"{tmp_path}/a", 8)
    got = C.nearest_in_cells(spark, f"{tmp_path}/a", table(spark, [(1, [0.0, 1.0])]), 9).collect()
    assert [g.vec_id for g in got] == [2, 2]
    assert C.nearest_in_cells(spark, f"{tmp_path}/a", table(spark, []), 9).count() == 0
    C.write_cells(table(spark, []), f"{tmp_path}/b")
    assert C.nearest_in_cells(spark, f"{tmp_path}/b", table(spark, [(1, [0.0, 1.0])]), 9).count() == 0
