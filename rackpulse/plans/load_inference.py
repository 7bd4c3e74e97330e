"""From raw series to a trained load model: curate, encode, balance, fit, evaluate."""

from __future__ import annotations

from pyspark.sql import DataFrame

from rackpulse.models.experiment import Task, by_hardware_group, medians
from rackpulse.operators.features import EncodeOptions, encode_samples
from rackpulse.operators.inventory import hardware_members, members_with_samples, only
from rackpulse.operators.series import SECOND, curate_samples


def encoded_from_raw(
    samples: DataFrame, subset: DataFrame | None = None, options: EncodeOptions = EncodeOptions(),
    wtype: str | None = None, workloads: list[str] | None = None, drift_seconds: float = 0.0,
) -> DataFrame:
    """Encoded data set of raw samples as one lazy plan."""
    chosen = samples
    if subset is not None:
        chosen = only(chosen, subset.withColumnRenamed("hostname", "host"), "host")
    if wtype:
        chosen = chosen.where(chosen.wtype == wtype)
    if workloads:
        chosen = chosen.where(chosen.workload.isin(*workloads))
    curated = curate_samples(chosen, SECOND, int(drift_seconds * SECOND))
    return encode_samples(curated, options)


def train_per_group(
    encoded: DataFrame, machines: DataFrame, task: Task, n_experiments: int = 1, selection: str = "random"
) -> tuple[DataFrame, DataFrame]:
    """Results and their medians for every hardware group that has samples."""
    members = hardware_members(machines).join(machines.select("hostname", "position"), "hostname")
    with_data = members_with_samples(members, encoded)
    results = by_hardware_group(encoded, with_data, task, n_experiments, selection)
    return results, medians(results)
