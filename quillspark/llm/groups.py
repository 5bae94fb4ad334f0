"""Runs of equal keys."""

from collections.abc import Iterator

import numpy as np


def runs(keys: np.ndarray) -> Iterator[tuple[int, int]]:
    """Start and end of each run of equal keys."""
    cut = np.flatnonzero(keys[1:] != keys[:-1]) + 1 if len(keys) else np.zeros(0, int)
    ends = [*cut.tolist(), len(keys)] if len(keys) else []
    return zip([0, *cut.tolist()], ends)
