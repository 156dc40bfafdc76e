"""Connected sets within one task, on numpy index arrays."""

from __future__ import annotations

import numpy as np


def merge(labels: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Labels after linking positions i and j; a label is the smallest position of its set."""
    a, b = labels[i], labels[j]
    while True:
        low = np.minimum(a, b)
        if not (todo := a != b).any():
            return labels
        np.minimum.at(labels, a[todo], low[todo])
        np.minimum.at(labels, b[todo], low[todo])
        while (labels != (up := labels[labels])).any():
            labels = up
        a, b = labels[i], labels[j]
