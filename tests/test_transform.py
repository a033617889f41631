"""Distances to places without a voxel against a plain search."""

import heapq

import numpy as np
import pytest

from dendrovox.operators import graphs
from dendrovox.operators.neighbours import offsets


def searched(image, connectivity):
    far = np.where(image, np.inf, 0.0)
    heap = [(0.0, *map(int, p)) for p in np.argwhere(~image)]
    while heap:
        d, *p = heapq.heappop(heap)
        for s in offsets(connectivity):
            q = tuple(a + b for a, b in zip(p, s))
            if all(0 <= a < n for a, n in zip(q, image.shape)) and d + sum(map(abs, s)) ** 0.5 < far[q]:
                far[q] = d + sum(map(abs, s)) ** 0.5
                heapq.heappush(heap, (far[q], *q))
    return {tuple(map(int, p)): float(far[tuple(p)]) for p in np.argwhere(image)}


def rows(spark, image):
    return spark.createDataFrame([(*map(int, p), 7) for p in np.argwhere(image)], "z long, y long, x long, v long").repartition(3)


@pytest.mark.parametrize("connectivity", [6, 18, 26])
def test_distances_are_those_of_a_search_over_borders_of_chunks(spark, connectivity):
    rng = np.random.default_rng(connectivity)
    image = np.ones((90, 5, 70), bool)
    image[:60] = rng.random((60, 5, 70)) < 0.9
    image[60:, :, 40:] = rng.random((30, 5, 30)) < 0.97
    got = {(r["z"], r["y"], r["x"]): r["distance"] for r in graphs.distance_transform(rows(spark, image), image.shape, connectivity).collect()}
    want = searched(image, connectivity)
    assert got == pytest.approx(want) and max(want.values()) > 3 * graphs.HALO


def test_short_distances_need_no_links(spark, monkeypatch):
    def never(*_):
        raise AssertionError("links of neighbours")

    monkeypatch.setattr(graphs, "neighbour_links", never)
    image = np.random.default_rng(4).random((70, 6, 6)) < 0.6
    got = {(r["z"], r["y"], r["x"]): r["distance"] for r in graphs.distance_transform(rows(spark, image), image.shape).collect()}
    assert got == pytest.approx(searched(image, 26))


def test_a_full_volume_has_no_distance(spark):
    got = graphs.distance_transform(rows(spark, np.ones((40, 2, 2), bool)), (40, 2, 2)).collect()
    assert len(got) == 160 and all(r["distance"] is None for r in got)
