"""Expectation-maximisation label model over counts of vote patterns.

Each labelling function votes +1, -1 or 0 (abstains).  Votes are independent
given the hidden label (naive Bayes), parameters are maximum-a-posteriori
estimates.  The model sees only how often each pattern of votes occurs: a table
of at most 3^m rows for m functions, whatever the number of records.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

Pattern = tuple[int, ...]


@dataclass(frozen=True)
class Fitted:
    prior: float
    yes: tuple[dict[int, float], ...]  # per function: P(vote | defect)
    no: tuple[dict[int, float], ...]

    def posterior(self, votes: Pattern) -> float:
        if not any(v > 0 for v in votes):
            return 0.0  # no evidence for the defect
        a, b = math.log(self.prior), math.log(1 - self.prior)
        for v, y, n in zip(votes, self.yes, self.no, strict=True):
            a += math.log(y[v])
            b += math.log(n[v])
        m = max(a, b)
        return math.exp(a - m) / (math.exp(a - m) + math.exp(b - m))


def fit(counts: dict[Pattern, int], labelled: list[tuple[Pattern, bool, float]] = (), rounds: int = 50, weight: float = 20.0) -> Fitted:
    """EM from the majority vote.

    Labelled patterns ``(votes, has the defect, weight)`` count as observed in every round, so that functions which never
    fire together, or a small table, cannot lead astray.  Without any of either kind
    ``weight`` pseudo-records stand in, which say that functions rarely fire on sound records.
    """
    m = len(next(iter(counts)))
    q = {p: 1.0 if sum(p) > 0 else 0.5 if any(v > 0 for v in p) else 0.0 for p in counts}
    total = sum(counts.values())
    known = any(y for _, y, _ in labelled) and not all(y for _, y, _ in labelled)
    first_yes = {-1: 0.5, 0: 0.5, 1: 0.5} if known else {-1: 0.05 * weight, 0: 0.45 * weight, 1: 0.5 * weight}
    first_no = {-1: 0.5, 0: 0.5, 1: 0.05} if known else {-1: 0.3 * weight, 0: 0.69 * weight, 1: 0.01 * weight}
    out = None
    for _ in range(rounds):
        mass = sum(q[p] * n for p, n in counts.items())
        prior = min(0.5, (mass + 0.5) / (total + 1.0))
        yes, no = [], []
        for k in range(m):
            y, z = dict(first_yes), dict(first_no)
            for p, told, w in labelled if known else ():
                (y if told else z)[p[k]] += w
            for p, n in counts.items():
                y[p[k]] += q[p] * n
                z[p[k]] += (1 - q[p]) * n
            yes.append({v: x / sum(y.values()) for v, x in y.items()})
            no.append({v: x / sum(z.values()) for v, x in z.items()})
        new = Fitted(prior, tuple(yes), tuple(no))
        moved = max(abs(new.posterior(p) - q[p]) for p in counts)
        q = {p: new.posterior(p) for p in counts}
        out = new
        if moved < 1e-9:
            break
    return out


def cutoff(model: Fitted, labelled: list[tuple], grid: tuple[float, ...] = (0.5, 0.6, 0.7, 0.8, 0.9)) -> float:
    """The cutoff of best F1 on held-out labelled patterns ``(votes, has the defect)``, with their number if more than one, the lowest of equal ones; without any that has the defect the lowest."""
    told = [(model.posterior(p), y, *(n or (1,))) for p, y, *n in labelled]
    true = sum(n for _, y, n in told if y)

    def f1(c: float) -> float:
        both, said = sum(n for v, y, n in told if y and v >= c), sum(n for v, _, n in told if v >= c)
        return 2 * both / (said + true) if said + true else 0.0

    return max(grid, key=lambda c: (f1(c), -c)) if true else grid[0]
