"""Golden-section search over the number of blocks, as plain state machines."""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from typing import Any, NamedTuple

GOLDEN = 0.618


class Point(NamedTuple):
    """A fitted model: its number of blocks, its description length and whatever stands for it."""

    blocks: int
    mdl: float
    model: Any = None


class Step(NamedTuple):
    """What to fit next: start from ``start`` and come to ``target`` blocks; or done, with ``start`` as the result."""

    start: Point
    target: int
    done: bool


@dataclass
class MergeSearch:
    """Halve the number of blocks until the best model is bracketed, then take golden sections.

    ``points`` hold the best model with more blocks, the best, and the best
    with fewer.
    """

    rate: float = 0.5
    points: list[Point | None] = field(default_factory=lambda: [None, None, None])
    tried: set[int] = field(default_factory=set)

    @property
    def bracketed(self) -> bool:
        return self.points[2] is not None

    def update(self, new: Point) -> None:
        more, best, _ = self.points
        if best is None:
            self.points[1] = new
        elif new.mdl <= best.mdl:
            self.points[2 if best.blocks < new.blocks else 0] = best
            self.points[1] = new
        else:
            self.points[2 if new.blocks < best.blocks else 0] = new

    def next(self, new: Point) -> Step:
        self.update(new)
        more, best, fewer = self.points
        if not self.bracketed:
            target = best.blocks - math.floor(best.blocks * self.rate)
            return self._towards(best, target, target == best.blocks)
        upper = more.blocks - best.blocks if more else 0
        lower = best.blocks - fewer.blocks
        if (more and more.blocks - fewer.blocks <= 2) or (not more and lower <= 1):
            return Step(best, best.blocks, True)
        high, low = (more, best) if upper >= lower else (best, fewer)
        target = low.blocks + int((high.blocks - low.blocks) * GOLDEN)
        if target in (high.blocks, low.blocks):
            if high.blocks - low.blocks <= 1:
                return Step(best, best.blocks, True)
            target = low.blocks + 1
        return self._towards(high, target)

    def _towards(self, start: Point, target: int, done: bool = False) -> Step:
        """Each target is tried once, so that a search whose steps miss their targets ends too."""
        best = self.points[1]
        if done or target in self.tried:
            return Step(best, best.blocks, True)
        self.tried.add(target)
        return Step(start, target, False)


@dataclass
class SplitSearch:
    """Raise the number of blocks by half until the best model is bracketed, then take golden sections.

    ``points`` hold the best model with fewer blocks, the best, and the best
    with more.
    """

    vertices: int
    growth: float = 1.5
    points: list[Point | None] = field(default_factory=lambda: [None, None, None])
    tried: set[int] = field(default_factory=set)

    @property
    def bracketed(self) -> bool:
        return self.points[2] is not None

    def update(self, new: Point) -> None:
        best = self.points[1]
        if best is None:
            self.points[1] = new
        elif new.mdl <= best.mdl:
            self.points[0 if best.blocks < new.blocks else 2] = best
            self.points[1] = new
        else:
            self.points[0 if new.blocks < best.blocks else 2] = new

    def next(self, new: Point) -> Step:
        self.update(new)
        fewer, best, more = self.points
        if not self.bracketed:
            target = math.ceil(best.blocks * self.growth) if best.blocks > 1 else 2
            return self._towards(best, target, target >= self.vertices or target == best.blocks)
        upper, lower = more.blocks - best.blocks, best.blocks - fewer.blocks if fewer else 0
        if (fewer and more.blocks - fewer.blocks <= 2) or (not fewer and upper <= 1):
            return Step(best, best.blocks, True)
        low, high = (best, more) if upper >= lower else (fewer, best)
        target = low.blocks + max(1, int((high.blocks - low.blocks) * (1 - GOLDEN)))
        return self._towards(low, target, target >= high.blocks)

    _towards = MergeSearch._towards
