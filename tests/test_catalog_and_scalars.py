import json
import random

import pytest

from weftgraph.functions import scalars as S
from weftgraph.operators import sample
from weftgraph.plans import catalog
from weftgraph.sources import corpus


def test_list_lengths_and_duplicates():
    assert [len(x) for x in (catalog.CURATED, catalog.EXTENDED, catalog.EXTENDED_FULL, catalog.REGRESSION_TASKS)] == [72, 99, 179, 277]
    full = catalog.task_list("full")
    assert len(full) == 528 and len(set(full)) == 524
    assert catalog.task_list("unknown") == full


@pytest.mark.parametrize(("mode", "runs"), [("light", 72), ("scaled", 10368), ("large", 24624), ("full", 76032)])
def test_expected_runs(mode, runs):
    assert catalog.expected_runs(catalog.task_list(mode), mode) == runs


def test_grids_have_twelve_by_twelve():
    for grid in (catalog.classification_grid(), catalog.regression_grid()):
        assert len(grid) == 12 and all(len(v) == 12 for v in grid.values())
    assert catalog.classification_grid()["MLP"][2] == {"hidden_layer_sizes": (50, 50), "max_iter": 500, "random_state": 42}
    assert catalog.regression_grid()["SVR"][3] == {"C": 1.0, "kernel": "linear"}


def test_hash_of_strings_is_of_their_json():
    assert S.sha256_of("ds_3") == S.sha256_of(json.dumps("ds_3").encode())


def test_dataset_info_draws_in_order():
    rng = random.Random(3)
    name = rng.choice(catalog.DATASET_NAMES["classification"]).format(3)
    info = S.dataset_info(3, "classification")
    assert (info["dataset_name"], info["n_samples"], info["n_features"], info["n_classes"]) == (name, rng.randint(500, 50000), rng.randint(10, 500), rng.randint(2, 10))
    assert S.dataset_info(3, "regression")["n_classes"] is None


def test_exact_score_equals_python(spark):
    rows = [(0.85, 3, 1, 0), (0.75, 6, 11, 4)]
    got = [r[0] for r in spark.createDataFrame(rows, "b double, t long, c int, f int").select(S.exact_score("b", "t", "c", "f")).collect()]
    want = []
    for b, t, c, f in rows:
        random.seed(t * 1000 + c * 10 + f)
        want.append(max(0.0, min(1.0, b + random.gauss(0, 0.05))))
    assert got == want


def test_python_rounding(spark):
    got = spark.createDataFrame([(2.675,), (0.1234565,)], "x double").select(S.python_round(2)("x")).collect()
    assert [r[0] for r in got] == [2.67, 0.12]


def test_retries_wait_twice_as_long_each_time():
    waits, calls = [], []

    def fail():
        calls.append(1)
        raise ConnectionError

    with pytest.raises(ConnectionError):
        corpus.with_retries(fail, 3, 5.0, sleep=waits.append)
    assert waits == [5.0, 10.0] and len(calls) == 3

    def unsupported():
        raise NotImplementedError("kind")

    with pytest.raises(ValueError, match="kind"):
        corpus.with_retries(unsupported, 3, 5.0, sleep=waits.append)


def test_sampled_paths_are_pythons():
    paths = [f"p{i}" for i in range(50)]
    assert sample.sample_paths(paths, 5, 42) == random.Random(42).sample(paths, 5)
    assert sample.sample_paths(paths, 50) == paths


def test_small_helpers():
    assert S.tex_escape("a_b%c&d") == r"a\_b\%c\&d"
    assert S.split_names(" schema, ,shacl") == ("schema", "shacl")
