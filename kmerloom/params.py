"""Parameters of the analysis, with thresholds as whole numbers.

Thresholds follow single-precision arithmetic and are computed once on the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Params:
    k: int = 13
    min_freq: float = 0.85
    constant: int | None = None
    length_middle: int = 35
    mask: int = 5
    recode: str = "sr6"

    def checked(self) -> Params:
        """Bounds of the public interface; single operators take any values."""
        if not 1 <= self.k <= 21:
            raise ValueError("k must lie in 1..21")
        if not 0.6 <= self.min_freq <= 1.0:
            raise ValueError("min_freq must lie in 0.6..1.0")
        if self.tail > self.k:
            raise ValueError("constant must not exceed k")
        return self

    @property
    def tail(self) -> int:
        return min(3, self.k) if self.constant is None else self.constant

    @property
    def overlap_k(self) -> int:
        return overlap_k(self.k)

    def min_needed(self, n: int) -> int:
        return int(np.ceil(np.float32(self.min_freq) * np.float32(n)))

    def max_missing(self, n: int) -> int:
        allowed = np.float32(1) - np.float32(self.min_freq)
        near = int(allowed * n)  # rounding moves the last number allowed by one or two
        return max((m for m in range(max(near - 2, 0), min(near + 2, n) + 1) if np.float32(m) / np.float32(max(n, 1)) <= allowed), default=0)


def overlap_k(k: int) -> int:
    """Length of the k-mers by which groups may not overlap."""
    return 2 * k + 1 if k < 10 else 21
