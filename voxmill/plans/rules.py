"""Rewrites of transform lists, before Catalyst sees any of them."""

from __future__ import annotations

import numpy as np


def optimise(transforms: list) -> list:
    """Leaves out no-ops and fuses neighbouring re-indexings of the same keys."""
    out: list = []
    for t in transforms:
        if type(t).__name__ in ("DoNothing", "ToDevice"):
            continue
        if out and _fixed(out[-1]) and _fixed(t) and out[-1].keys == t.keys:
            out[-1] = FusedGather([*_parts(out[-1]), *_parts(t)])
        else:
            out.append(t)
    return out


def _fixed(t) -> bool:
    """Whether t is a gather whose map is known when the plan is built."""
    return getattr(t, "index_map", None) is not None and t.deterministic()


def _parts(t) -> list:
    return t.parts if isinstance(t, FusedGather) else [t]


class FusedGather:
    """Several gathers as one map."""

    def __init__(self, parts: list):
        self.parts, self.keys, self.name = parts, parts[0].keys, "+".join(p.name for p in parts)

    def deterministic(self) -> bool:
        return True

    def index_map(self, spec) -> np.ndarray:
        from ..functions.spec import TensorSpec

        index = self.parts[0].index_map(spec)
        for p in self.parts[1:]:
            index = index.ravel()[p.index_map(TensorSpec(index.shape))]
        return index

    def __call__(self, s):
        return self.apply(s)

    def apply(self, s):
        from ..operators.base import gather

        s.need(self.keys)
        for p in self.parts:
            s, _ = s.op(p.name)
        for key in self.keys:
            s = gather(s, key, self.index_map(s.spec(key)))
        return s
