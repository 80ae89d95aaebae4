"""How many tiles, and of what shape: decided on the driver from shapes alone."""

from __future__ import annotations

import math
from collections.abc import Sequence

#: Stores of fewer cells than this stay whole.
THRESHOLD = 1 << 14
#: Cells of one tile, which one task holds: a larger store has more tiles, however few tasks run at a time.
CELLS = 1 << 20


def launch_shape(shape: Sequence[int], pieces: int, threshold: int = THRESHOLD) -> tuple[int, ...]:
    """A grid of at least `pieces` tiles (where there are cells enough), none of more than CELLS cells: tiles are halved along their
    longest side, of equal ones the first."""
    out = [1] * len(shape)
    if not shape or math.prod(shape) < threshold:
        return tuple(out)
    while True:
        tile = [-(-n // c) for n, c in zip(shape, out)]
        if max(tile) <= 1 or math.prod(out) >= pieces and math.prod(tile) <= CELLS:
            return tuple(out)
        k = tile.index(max(tile))
        out[k] = min(2 * out[k], shape[k])


def tile_shape(shape: Sequence[int], launch: Sequence[int], least: Sequence[int] | None = None) -> tuple[int, ...]:
    """ceil(extent / launch), not below `least`; what `least` leaves no room for is one tile."""
    if least is not None and len(least) != len(shape):
        raise ValueError("min_extents needs an extent for each dimension")
    return tuple(max(1, -(-n // c), 0 if least is None else min(m, max(1, n))) for n, c, m in zip(shape, launch, least or [0] * len(shape)))
