"""Points that no split by distance parts."""

import numpy as np
import pytest

from arterial.llm import cover_tree

from . import brute

KIND = "vec_id long, embedding array<float>, label int"


def links(spark, rows, **how):
    return {r.vec_id: (r.n_links, r.component_id) for r in cover_tree.near_duplicates(spark.createDataFrame(rows, KIND), **how).collect()}


def test_multiples_of_one_direction_link(spark):
    rows = [(i, [float(i)], 1) for i in range(1, 2601)] + [(3000, [-1.0], 1), (3001, [5.0], 1), (3002, [5.0], 2)]
    got = links(spark, rows)
    assert got == {i: (2600, 1) for i in [*range(1, 2601), 3001]} | {3000: (0, 3000), 3002: (0, 3002)}


def test_multiples_and_their_neighbours_match_brute_force(spark):
    rows = [(100 - i, [float(2**i), 0.0], 1) for i in range(12)] + [(200 + i, [1.0, 0.02 * i], 1) for i in range(30)]
    rows += [(300 + i, [0.0, 3.0 * 2**i], 2) for i in range(12)]
    assert links(spark, rows, cell=4) == brute.cosine_links(rows)


@pytest.mark.parametrize("levels", [0, 2])
def test_cells_left_after_the_last_level_keep_their_links(spark, monkeypatch, levels):
    monkeypatch.setattr(cover_tree, "LEVELS", levels)
    rng = np.random.default_rng(4)
    rows = [(i, [float(np.float32(x)) for x in np.array([1.0, 0, 0, 0]) + rng.normal(size=4) * (0.02 + 0.3 * (i % 3))], 1) for i in range(300)]
    assert links(spark, rows, cell=20) == brute.cosine_links(rows)


def test_small_parts_and_odd_labels_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(cover_tree, "PART_POINTS", 50)
    monkeypatch.setattr(cover_tree, "PART_CELLS", 3)
    rng = np.random.default_rng(8)
    labels = ["a/3.5", "a/3", "", "1.5/64.2"]
    rows = []
    for i in range(500):
        v = np.array([1.0, 0, 0, 0, 0]) * (i % 5) + rng.normal(size=5) * 0.4
        rows.append((i, [float(np.float32(x)) for x in v], labels[i % 7 % 4]))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label string")
    got = {r.vec_id: (r.n_links, r.component_id) for r in cover_tree.near_duplicates(df, cell=20).collect()}
    assert got == brute.cosine_links(rows)
