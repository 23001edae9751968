"""Sets that grow by links, and the components of a mask, in numpy steps."""

from __future__ import annotations

import numpy as np


def merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the sets of a[i] and b[i]; label holds each position's smallest member, before and after."""
    while len(a):
        x, y = label[a], label[b]
        low = np.minimum(x, y)
        np.minimum.at(label, x, low)
        np.minimum.at(label, y, low)
        while True:
            short = label[label]
            if (short == label).all():
                break
            label[:] = short
        apart = label[a] != label[b]
        a, b = a[apart], b[apart]


def spread(starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(i, j) for every i and every j from starts[i] up to but without stops[i]."""
    n = np.maximum(stops - starts, 0)
    i = np.repeat(np.arange(len(n)), n)
    return i, np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n) + starts[i]


def mask_runs(on: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first column, one past the last column) of each horizontal run of a mask, in reading order."""
    flat = np.pad(on.astype(np.int8), ((0, 0), (1, 1)))
    step = np.diff(flat, axis=1)
    row, start = np.nonzero(step > 0)
    return row, start, np.nonzero(step < 0)[1]


def mask_components(on: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray, np.ndarray], np.ndarray]:
    """The mask's runs, and for each the first run of its 8-neighbour component."""
    row, start, stop = runs = mask_runs(on)
    width = on.shape[1] + 2
    # Places in reading order with a gap between rows: a run touches those of the row above that
    # end after its start and start before its end, one pixel further for corners.
    first, last = row * width + start, row * width + stop
    i, j = spread(np.searchsorted(last, first - width, "left"), np.searchsorted(first, last - width, "right"))
    label = np.arange(len(row))
    merge(label, i, j)
    return runs, label
