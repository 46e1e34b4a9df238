"""The number of visited cells does not hang on links among the probe rows."""

import numpy as np

from vernissage.llm import vectors


def test_visits_reach_the_recall_where_no_probe_has_a_link(spark):
    rng = np.random.default_rng(5)
    rows = rng.normal(size=(3000, 64))
    groups = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(rows)], "rep long, v array<float>, m long")
    settings = vectors.Settings(per_cell=1, probe_rows=256, probe_blocks=2)
    grid = vectors.fit_grid(groups, 64, len(rows), settings)
    visits = vectors.visits_for_recall(groups, grid, 64, settings)
    units = vectors.unit(rows[-1000:])
    away = rng.normal(size=units.shape)
    away = vectors.unit(away - (away * units).sum(1, keepdims=True) * units)
    cells = grid.own_cells(0.9 * units + 0.19**0.5 * away)
    ranks = np.array([grid.ranks(u, c[None])[0] for u, c in zip(units, cells)])
    assert (ranks < 8).mean() < 0.9 < 0.97 < (ranks < visits).mean()
    assert visits < len(grid.first) * len(grid.second)
