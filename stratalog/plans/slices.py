"""Slices of positions: an int, a pair, a pair with suffix, or a list of those, as explicit index lists."""

from __future__ import annotations

from typing import Any

Index = int | str


def slice_indexes(slices: Any) -> list[Index]:
    """The indexes that a slice specification names, in order and with repeats; the argument is not changed.

    >>> slice_indexes(3), slice_indexes((5, 7)), slice_indexes((5, 7, "x")), slice_indexes([(1, 3), 8]), slice_indexes(())
    ([0, 1, 2], [5, 6], ['5x', '6x'], [1, 2, 8], [])
    """
    if isinstance(slices, bool):
        raise ValueError("slices are an int, a tuple or a list of those")
    if isinstance(slices, int):
        return list(range(slices))
    if isinstance(slices, tuple):
        return _expand(slices)
    if isinstance(slices, list):
        return [i for part in slices for i in _expand((part, part + 1) if isinstance(part, int) else part)]
    raise ValueError("slices are an int, a tuple or a list of those")


def _expand(part: Any) -> list[Index]:
    if not isinstance(part, tuple) or len(part) not in (0, 2, 3):
        raise ValueError(f"a slice has 0, 2 or 3 parts: {part!r}")
    if not part:
        return []
    numbers = range(part[0], part[1])
    return list(numbers) if len(part) == 2 or part[2] is None else [f"{i}{part[2]}" for i in numbers]


def resolve_slices(slices: Any) -> dict[str, list[Index]] | list[Index] | None:
    """A slices setting: a dict goes key by key, a list becomes one index list, and any other value means none."""
    if isinstance(slices, dict):
        return {key: slice_indexes(value) for key, value in slices.items()}
    if isinstance(slices, list):
        return slice_indexes(slices)
    return None


def pick(items: list[Any], indexes: list[Index]) -> list[Any]:
    """Items at the indexes, order and repeats kept, negatives from the end; no indexes at all mean no slicing."""
    if not indexes:
        return list(items)
    for i in indexes:
        if isinstance(i, str):
            raise TypeError(f"{i!r} cannot index a catalogue")
        if not -len(items) <= i < len(items):
            raise IndexError(f"index {i} is out of range for {len(items)} items")
    return [items[i] for i in indexes]
