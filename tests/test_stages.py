"""Stored stages end with their run."""

import glob
import os
import uuid

import pytest

from firmwatt.checks import tables as T
from firmwatt.plans import solar_plant, wind_plant
from firmwatt.sources import sinks

SF = "/root/testdata/sf0.001"


@pytest.fixture
def shared(monkeypatch, tmp_path):
    folder = tmp_path / "shared"
    folder.mkdir()
    monkeypatch.setattr(sinks, "shared_folder", lambda spark: f"{folder}/{uuid.uuid4().hex}")
    return str(folder)


@pytest.mark.parametrize("plan, build", [(wind_plant, T.wind_inputs), (solar_plant, T.solar_inputs)])
def test_a_run_leaves_its_results_only(spark, shared, tmp_path, plan, build):
    inputs = build(spark, SF)
    with sinks.temporary_stages(spark):
        hourly = plan.hourly_energy(inputs)
        assert glob.glob(f"{shared}/*")
        written = sinks.write_results(hourly, str(tmp_path / "results"), lambda h: plan.results(h, inputs.plants))
    assert glob.glob(f"{shared}/*") == []
    assert all(df.count() for df in written.values())


def test_an_error_leaves_no_stage(spark, shared):
    with pytest.raises(ValueError, match="stop"), sinks.temporary_stages(spark):
        sinks.stage(spark.range(3))
        assert len(os.listdir(shared)) == 1
        raise ValueError("stop")
    assert os.listdir(shared) == []


def test_inner_runs_end_alone(spark, shared):
    with sinks.temporary_stages(spark):
        outer = sinks.stage(spark.range(3))
        with sinks.temporary_stages(spark):
            sinks.stage(spark.range(4))
        assert outer.count() == 3 and len(os.listdir(shared)) == 1
    assert os.listdir(shared) == []
