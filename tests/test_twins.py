"""Python twins and small operations that no query goes through."""

import math
import re

import numpy as np
import pytest

from meridion.functions.text import UUID, new_uuid
from meridion.operators.kernels.rings import Ring, canonicalise, validate_stored
from meridion.operators.ordered import same_rows
from meridion.operators.scene import frame_bounds
from meridion.sources.store import Project


def test_identifiers():
    made = {new_uuid() for _ in range(100)}
    assert len(made) == 100 and all(re.match(UUID, x) and x[14] == "4" and x[19] in "89ab" for x in made)


def test_bounds_move_by_the_smoothstep():
    globe, flat = {"min_x": -1.0, "max_x": 1.0, "min_y": -1.0, "max_y": 1.0}, {"min_x": -3.0, "max_x": 3.0, "min_y": -1.5, "max_y": 1.5}
    assert frame_bounds(globe, flat, 0.0) == globe and frame_bounds(globe, flat, 1.0) == flat
    assert frame_bounds(globe, flat, 0.5)["max_x"] == pytest.approx(2.0) and frame_bounds(globe, flat, 0.25)["max_x"] == pytest.approx(1 + 2 * 0.103515625)


def test_equal_tables_whatever_their_order(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (2, "y")], "k int, v string")
    assert same_rows(a, a.orderBy("k", ascending=False)) and not same_rows(a, a.distinct()) and not same_rows(a.distinct(), a)


def test_stored_rings():
    good, _ = canonicalise([0.1, 0.3, 0.2], [0.0, 0.1, 0.3], "left")
    around = Ring(np.array([0.0, 2.0, 4.0]), np.array([1.0, 1.0, 1.0]), 2 * math.pi, 1, "left")
    assert validate_stored(good) == validate_stored(around) == "none"
    for ring, word in (
        (Ring(good.lon[:2], good.lat[:2], 0.1, 0), "too_few_vertices"), (Ring(good.lon + 7, good.lat, good.closing_lon + 7, 0), "longitude_not_canonical"), (Ring(good.lon, good.lat + 2, good.closing_lon, 0), "latitude_out_of_range"),
        (Ring(np.array([0.0, math.nan, 1.0]), good.lat, 0.0, 0), "non_finite_coordinate"), (Ring(np.array([0.0, 3.5, 1.0]), good.lat, 0.0, 0), "longitude_step_too_long"),
        (Ring(around.lon, around.lat, around.closing_lon, 0, "left"), "winding_mismatch"), (Ring(around.lon, around.lat, around.closing_lon, 1), "missing_interior_side"),
    ):
        assert validate_stored(ring) == word


def test_layers_are_updated_as_a_whole(spark, tmp_path):
    project, _ = Project.create(spark, tmp_path / "p")
    layer = {"layer_id": "a", "role_id": "r", "name": "A", "visible": True}
    assert project.update_layer(layer).status == "record_not_found" and project.append_layer(layer).revision == 2
    assert not project.update_layer(layer).changed and project.update_layer(layer | {"name": "B", "visible": False}).revision == 3
    assert project.update_layer(layer | {"sources": [{"slot_id": "s", "source_id": "none"}]}).status == "source_not_found" and project.state()["layers"][0]["name"] == "B"
