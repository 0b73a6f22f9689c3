"""Selection queries over every seed, against DuckDB."""

from __future__ import annotations

import pytest
from compare import SMALL, connect, difference

from emberfield.plans.catalogue import ORACLES, QUERIES
from emberfield.plans.fusion_queries import PER_SEED
from emberfield.sources import bindings


@pytest.fixture(scope="module")
def duck():
    return connect(SMALL)


@pytest.mark.parametrize("name", PER_SEED)
def test_every_seed_has_a_result(spark, duck, name):
    got, want = QUERIES[name](spark, SMALL).toPandas(), duck.execute(ORACLES[name]).df()
    assert difference(got, want) is None
    assert set(got["seed"]) == set(bindings.SEEDS)
