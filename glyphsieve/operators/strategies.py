"""Strategies of rewriting as data: what specifications say, and a search over measured candidates.

Nothing is rewritten here. A search asks its caller for the axes of strategies that were measured elsewhere and decides which to ask
for next; frontiers and ranks are in ``evaluation``.
"""

from __future__ import annotations

from collections.abc import Callable

Step = tuple[str, float]

# Tactics.
TACTICS = ("paraphrase", "backtranslate", "structural", "humanize", "chunk", "mlm")
POLISH = "humanize"


def _parts(spec: str, what: str) -> list[str]:
    found = [x.strip() for x in spec.split(",") if x.strip()]
    if not found:
        raise ValueError(f"empty {what}")
    return found


def _number(text: str, what: str) -> float:
    try:
        return float(text)
    except ValueError:
        raise ValueError(f"bad {what}: {text!r}") from None


def variants(spec: str) -> list[tuple[str, int]]:
    """``tactic:candidates,...``"""
    out = []
    for part in _parts(spec, "variants"):
        tactic, found, n = part.partition(":")
        if not found or not n.isdecimal() or int(n) < 1:
            raise ValueError(f"bad variant {part!r}: tactic:candidates is expected")
        out.append((tactic, int(n)))
    return out


def intensities(spec: str) -> list[float]:
    """Numbers above 0, up to 1."""
    out = [_number(x, "intensity") for x in _parts(spec, "grid")]
    if any(not 0 < x <= 1 for x in out):
        raise ValueError("an intensity is above 0 and 1 at most")
    return out


def strategy(spec: str) -> list[Step]:
    """``tactic@intensity,...`` in order; polish alone is no strategy."""
    out = []
    for part in _parts(spec, "strategy"):
        tactic, found, level = part.rpartition("@")
        tactic = tactic.strip()
        if not found or tactic not in TACTICS:
            raise ValueError(f"bad step {part!r}")
        out += [(tactic, x) for x in intensities(level)]
    if not removes(out):
        raise ValueError("polish alone removes nothing")
    return out


def weights(spec: str) -> list[tuple[float, float, float]]:
    """``a/b/c,...``, each adding up to 1."""
    out = []
    for part in _parts(spec, "weights"):
        w = [_number(x, "weight") for x in part.split("/")]
        if len(w) != 3 or min(w) < 0 or abs(sum(w) - 1) > 1e-6:
            raise ValueError(f"bad weights {part!r}: three that add up to 1 are expected")
        out.append((w[0], w[1], w[2]))
    return out


def canonical(steps: list[Step]) -> tuple[Step, ...]:
    """Polish comes last, once, at its least intensity."""
    polish = [x for t, x in steps if t == POLISH]
    return (*((t, x) for t, x in steps if t != POLISH), *([(POLISH, min(polish))] if polish else []))


def slug(steps) -> str:
    return "+".join(f"{t}@{x:g}" for t, x in steps)


def removes(steps) -> bool:
    return any(t != POLISH for t, _ in steps)


def escalated(steps, by: float, most: float = 1.0) -> list[Step]:
    return [(t, min(most, round(x + by, 4))) for t, x in steps]


def score(axes: dict, w: tuple[float, float, float]) -> float | None:
    """Weighted sum of coverage, nearness and likeness; null if any is missing."""
    a, b, c = axes.get("robust_clear_rate"), axes.get("sem_div"), axes.get("human_like")
    return None if None in (a, b, c) else w[0] * a + w[1] * (1 - b) + w[2] * c


def search(measure: Callable[[list[tuple[Step, ...]]], dict[tuple[Step, ...], dict]], tactics, grid: list[float], ws, depth: int = 3, beam: int = 3, levels: int = 3) -> dict[tuple[Step, ...], dict]:
    """The axes of all strategies that a search measures, each once.

    First each tactic alone at each intensity. Then, for each weighting, strategies grow by a tactic that they lack, at the ``levels``
    intensities at which it did best alone; the ``beam`` best of a length grow on. ``measure`` gets all strategies of a step
    at once, so that they can be measured by one job.
    """
    known: dict[tuple[Step, ...], dict] = {}

    def ask(wanted) -> None:
        new = [s for s in dict.fromkeys(map(canonical, wanted)) if s not in known]
        if new:
            known.update(measure(new))

    ask([[(t, x)] for t in tactics for x in grid])
    for w in ws:
        best = {}
        for t in tactics:
            ranked = [(s, x) for x in grid if (s := score(known.get(((t, x),), {}), w)) is not None]
            best[t] = [x for _, x in sorted(ranked, key=lambda r: -r[0])[:levels]]
        beams = [[(t, x)] for t in tactics for x in best[t]]
        for _ in range(1, depth):
            longer = [[*s, (t, x)] for s in beams for t in tactics if t not in {a for a, _ in s} for x in best[t]]
            ask(longer)
            ranked = [(v, s) for s in longer if (v := score(known.get(canonical(s), {}), w)) is not None]
            if not ranked:
                break
            beams = [s for _, s in sorted(ranked, key=lambda r: -r[0])[:beam]]
    return known


def recommended(frontier: list[tuple[tuple[Step, ...], dict]], w: tuple[float, float, float], floor: float, polished: Callable[[tuple[Step, ...]], dict]) -> tuple[Step, ...] | None:
    """Of the frontier in order of score the first that keeps ``floor`` coverage, measured anew with a polish at its end if it has none."""
    ranked = sorted(((score(a, w), s, a) for s, a in frontier if score(a, w) is not None and removes(s)), key=lambda r: -r[0])
    for _, steps, axes in ranked:
        after = axes if steps[-1][0] == POLISH else polished(steps)
        if (after.get("robust_clear_rate") or 0.0) >= floor - 1e-9:
            return steps
    return None
