"""Reconcile an inventory and report the run."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame

from lakekit.operators.reconcile import reconcile
from lakekit.operators.rollup import count_by, result_document, roll_up_requested


class Run(NamedTuple):
    """What to do per key, how often each action occurs, the outcome counts and the documents."""

    actions: DataFrame
    action_counts: DataFrame
    summary: DataFrame
    documents: DataFrame


def reconcile_and_report(
    desired: DataFrame, actual: DataFrame, outcomes: DataFrame, on: list[str], header: list[str]
) -> Run:
    """Desired against actual keys, and the outcomes of acting on the desired ones.

    ``desired`` carries the header columns of its run; ``outcomes`` carries them too, next to the
    key, folder, name, success and error.
    """
    actions = reconcile(desired, actual, on)
    return Run(
        actions,
        count_by(actions, "action"),
        roll_up_requested(desired, outcomes, on, header),
        result_document(outcomes, header),
    )
