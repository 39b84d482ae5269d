"""Checks of settings."""

from __future__ import annotations


def share(name: str, value: float | None) -> None:
    """A share lies between 0 and 1; None is no setting at all."""
    if value is not None and not 0 <= value <= 1:
        raise ValueError(f"{name} is a share, so it lies between 0 and 1")


def least(name: str, value: float, floor: float) -> None:
    if value < floor:
        raise ValueError(f"{name} is {value}; it has to be {floor} or more")
