"""Registered model queries fit forests of the reference's size."""

import pytest

from pulsegrid.catalog import jobs
from pulsegrid.plans import forests

SF = "/root/testdata/sf0.001"


class Fitted(Exception):
    pass


@pytest.mark.parametrize("name", ["evidence_model", "sensitivity_sweep", "config_sweep", "external_validation", "full_run"])
def test_whole_forests(spark, monkeypatch, name):
    def seen(fit, keys, trees=700, depth=None, min_leaf=2, **settings):
        raise Fitted(trees if isinstance(trees, int) else {r[0] for r in fit.select(trees).distinct().collect()}, depth, min_leaf)

    monkeypatch.setattr(forests, "grow", seen)
    with pytest.raises(Fitted) as e:
        getattr(jobs, name)(spark, SF)
    assert e.value.args == ({700, 500} if name == "external_validation" else 700, None, 2)
