from __future__ import annotations

import re
from math import comb

import numpy as np

from sievelake.llm import minhash as m


def miss_rate(similarity: float) -> float:
    """That the sketches of two documents differ too much, or no band agrees: each differing sample flips a bit in both sketches."""
    k = np.arange(m.SKETCH_BITS + 1)
    odd = (k == 0).astype(float)
    beyond = [0.0]
    for _ in range(m.SAMPLES):
        for _ in range(2):
            up, down = odd * (m.SKETCH_BITS - k) / m.SKETCH_BITS, odd * k / m.SKETCH_BITS
            odd = np.append(0, up[:-1]) + np.append(down[1:], 0)
        beyond.append(odd[m.MOST_DIFFERING + 1 :].sum())
    cut = sum(comb(m.SAMPLES, d) * (1 - similarity) ** d * similarity ** (m.SAMPLES - d) * beyond[d] for d in range(m.SAMPLES + 1))
    return cut + (1 - similarity**m.ROWS) ** m.BANDS


def test_stated_rate_holds():
    times, power = re.search(r"similarity of 0\.8 less than (\w+)(?: times)? in 10\*\*(\d+)", m.__doc__).groups()
    assert miss_rate(0.8) < (1 if times == "once" else int(times)) / 10 ** int(power)
    assert miss_rate(0.85) < 1e-9
