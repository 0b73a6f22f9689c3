"""Settings under which fitted queries run."""

from __future__ import annotations

import inspect

from emberfield.operators import models as md
from emberfield.plans import model_queries as mq


def test_i5_draws_the_default_unlabelled_rows(monkeypatch):
    """Ten unlabelled rows for each positive, as in the operator and the reference."""
    plain, seen = inspect.signature(md.pu_gbt_score), {}

    def record(*args, **given):
        bound = plain.bind(*args, **given)
        bound.apply_defaults()
        seen.update(bound.arguments)
        return lambda train, test: None

    monkeypatch.setattr(mq, "split", lambda spark, folder: (None, None))
    monkeypatch.setattr(md, "pu_gbt_score", record)
    mq.i5.__wrapped__(None, None) if hasattr(mq.i5, "__wrapped__") else mq.i5(None, None)
    assert seen["ratio"] == plain.parameters["ratio"].default == 10 and seen["bags"] == 3


def test_tree_queries_fit_the_default_rounds(monkeypatch):
    """No query sets a smaller round count than the operators' own."""
    seen = {}
    for name in ("gbt_score", "pu_gbt_score", "seed_ensemble"):
        plain = inspect.signature(getattr(md, name))

        def record(*args, name=name, plain=plain, **given):
            bound = plain.bind(*args, **given)
            bound.apply_defaults()
            seen[name] = bound.arguments["rounds"]
            return lambda train, test: None

        monkeypatch.setattr(md, name, record)
    monkeypatch.setattr(mq, "split", lambda spark, folder: (None, None))
    for made in (mq.i4, mq.i5, mq.i6):
        made(None, None)
    assert seen == {"gbt_score": 20, "pu_gbt_score": 20, "seed_ensemble": 20}
