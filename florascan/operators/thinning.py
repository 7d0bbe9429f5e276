"""Skeletons of masks: thinning in two alternating subrounds (Zhang and Suen, 1984) on blocks of pixels.

A pass over the blocks does several rounds, its halo being as wide as what these can reach; its result is written, and passes go
on until one takes nothing away.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from florascan.operators.blocks import PLACE, mask_stencil, shifted
from florascan.sources.storage import stored

#: The eight neighbours in turn, from the one above, clockwise.
AROUND = ((-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1))


def thinned(mask: np.ndarray, rounds: int) -> np.ndarray:
    """The mask plane after so many rounds."""
    for _ in range(rounds):
        before = mask
        for first in (True, False):
            near = [shifted(mask, dy, dx) for dy, dx in AROUND]
            number = sum(n.astype(np.int8) for n in near)
            begins = sum((~near[k] & near[(k + 1) % 8]).astype(np.int8) for k in range(8))
            up, right, down, left = near[0], near[2], near[4], near[6]
            open_ = ~(right & down & (up | left)) if first else ~(up & left & (right | down))
            mask = mask & ~((number >= 2) & (number <= 6) & (begins == 1) & open_)
        if (mask == before).all():
            break
    return mask


def skeleton(mask: DataFrame, rounds: int = 16) -> DataFrame:
    """(image_id, y, x) of the mask's skeleton: lines of one pixel's width that keep its connections.

    ``rounds`` are done in a pass; the result does not depend on them. Outside of the mask counts as empty.
    """
    out = stored(mask.select(*PLACE), "thinned")
    n = out.count()
    while True:
        out = stored(mask_stencil(out, out.filter(F.lit(False)), 2 * rounds, lambda m, _: thinned(m, rounds)), "thinned")
        now = out.count()
        if now == n:
            return out
        n = now
