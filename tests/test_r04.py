"""Findings of round 4: a layout of all rows, and qualities of clusters over all rows."""

import numpy as np
import pytest

from mosaiq.operators import cluster, projection, stats
from tests.test_cells import _clustered, _table


def test_all_rows_are_laid_out(spark, monkeypatch):
    x = _clustered(1200, 6, 8)
    x[100:110] = x[0]  # equal rows count as one
    df = _table(spark, x)
    laid_out, layout = [], projection._layout
    monkeypatch.setattr(projection, "_layout", lambda start, *rest: laid_out.append(len(start)) or layout(start, *rest))
    monkeypatch.setattr(projection, "EPOCHS", 5)
    places = lambda: {r["vec_id"]: tuple(r["place"]) for r in projection.project(df, 6, 5, landmarks=50).collect()}
    here = places()
    assert laid_out == [1190]
    assert len(here) == 1200 and len(set(here.values())) == 1190 and {here[i] for i in range(100, 110)} == {here[0]}
    monkeypatch.setattr(projection, "FEW_EDGES", 0)
    assert places() == here  # by jobs as on the driver


def test_tiles_hold_every_edge_from_both_ends(spark, monkeypatch):
    for name, value in (("BLOCK", 8), ("TAILS", 16), ("EDGES", 7), ("PUSHES", 0)):
        monkeypatch.setattr(projection, name, value)
    r = np.random.default_rng(3)
    n, y = 45, np.random.default_rng(4).normal(size=(3, 45))
    pairs = sorted({(min(p), max(p)) for p in r.integers(0, n, (300, 2)).tolist() if p[0] != p[1]})
    tiles = projection._tiles(spark.createDataFrame([(*p, 1.0) for p in pairs], "a long, b long, weight double")).toPandas()
    assert tiles["n"].sum() == 2 * len(pairs) and len(tiles) > 12
    a, b = projection._curve(0.1)
    want, got = np.zeros_like(y), np.zeros_like(y)
    for h, t in [*pairs, *((t, h) for h, t in pairs)]:
        gap = y[:, h] - y[:, t]
        q = gap @ gap
        want[:, h] += np.clip(-2 * a * b * q ** (b - 1) / (1 + a * q**b) * gap, -4, 4)
    for tile in tiles.itertuples(index=False):
        got[:, tile.block * 8 : tile.block * 8 + 8] += projection._moves(tile, y, (a, b), (1, 2))
    assert got == pytest.approx(want)


def _silhouette(x, at):
    away = np.linalg.norm(x[:, None] - x[None], axis=2)
    found = []
    for i in range(len(x)):
        means = {c: away[i, at == c].sum() / max(1, (at == c).sum() - (c == at[i])) for c in set(at)}
        inner, outer = means.pop(at[i]), min(means.values(), default=0.0)
        found.append((outer - inner) / max(outer, inner) if means and (at == at[i]).sum() > 1 else 0.0)
    return np.mean(found)


def test_silhouettes_of_reductions_are_over_all_rows(spark):
    r = np.random.default_rng(9)
    at = r.integers(0, 3, 2300)
    x = np.eye(4)[at] + r.normal(scale=0.15, size=(2300, 4))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    found = cluster.compare_reductions(df, "v", 4, "id", (), 3, 3)
    assert found[0]["silhouette"] == pytest.approx(_silhouette(x / np.linalg.norm(x, axis=1, keepdims=True), at), abs=1e-9)


def test_halves_are_of_all_rows(monkeypatch):
    class Rows:
        def count(self):
            return 500_003

    class Drawn(Exception):
        pass

    def draw(df, n, *rest):
        raise Drawn(n)

    monkeypatch.setattr(cluster, "exact_sample", draw)
    with pytest.raises(Drawn, match="^250001$"):
        cluster.bootstrap_ari(Rows(), "v", "id")


def test_silhouette_by_slabs(spark, monkeypatch):
    r = np.random.default_rng(10)
    x, at = r.normal(size=(700, 3)), np.array([*r.choice(["a", "b", "c"], 699), "alone"])
    rows = [(i // 2, str(c), v.tolist()) for i, (c, v) in enumerate(zip(at, x))]  # ids may be shared
    df = spark.createDataFrame([*rows, (1, None, [0.0] * 3), (2, "a", None)], "id long, c string, v array<double>")
    want = _silhouette(x, at)
    for slab, pairs in ((4_000_000, 1 << 27), (500, 10_000)):
        monkeypatch.setattr(stats, "SLAB_COMPONENTS", slab)
        monkeypatch.setattr(stats, "PAIRS", pairs)
        assert stats.silhouette(df, "id", "c", "v").first()[0] == pytest.approx(want)
    assert stats.silhouette(df.where("c = 'a'"), "id", "c", "v").first()[0] == 0.0
    assert stats.silhouette(df.where("false"), "id", "c", "v").first()[0] is None
