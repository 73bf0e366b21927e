"""The right sides of a nesting left join."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any


@dataclass
class RightSpec:
    """one: a nullable record for each match (a left row is repeated for several). Else an array of records; of several
    right datasets, also <field>_index with the number of each record's dataset."""

    datasets: list[Any]
    key: Callable
    one: bool

    @property
    def indexed(self) -> bool:
        return len(self.datasets) > 1


def join_multi_by(datasets: list[Any], key: Callable) -> RightSpec:
    """One array field of the matches in several datasets of the same schema."""
    return RightSpec(list(datasets), key, False)
