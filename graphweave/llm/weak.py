"""Weak supervision: labelers vote 1, -1 or abstain (0); expectation-maximisation finds how far to trust each.

The fit needs only the number of rows for each pattern of votes, which Spark counts over all rows;
there are at most 3 to the power of the labelers of those, whatever the size of the corpus.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

VOTES = (-1, 0, 1)


@dataclass(frozen=True)
class Model:
    """prior: share of positive rows. good, bad: for each labeler how often it votes -1, 0, 1 on either class."""

    prior: float
    good: tuple[tuple[float, float, float], ...]
    bad: tuple[tuple[float, float, float], ...]

    def weight(self, labeler: int, vote: int) -> float:
        return math.log(self.good[labeler][vote + 1] / self.bad[labeler][vote + 1])

    def posterior(self, votes: Sequence[int]) -> float:
        odds = math.log(self.prior / (1 - self.prior)) + sum(self.weight(j, v) for j, v in enumerate(votes))
        return 1 / (1 + math.exp(-odds))

    def posterior_column(self, votes: Sequence[Column]) -> Column:
        """The same, for columns of votes."""
        odds = F.lit(math.log(self.prior / (1 - self.prior)))
        for j, vote in enumerate(votes):
            odds = odds + F.when(vote < 0, self.weight(j, -1)).when(vote > 0, self.weight(j, 1)).otherwise(self.weight(j, 0))
        return 1 / (1 + F.exp(-odds))


def fit(patterns: Sequence[tuple[Sequence[int], int]], labelers: int, prior: float = 0.8, prior_range: tuple[float, float] = (0.5, 0.95), rounds: int = 60, earlier: float = 20.0) -> Model:
    """Expectation-maximisation over (votes, rows) pairs.

    Starts from labelers that are mostly right, which also counts as `earlier` rows of each class, so
    that few rows change little. A labeler is never turned around: a vote of 1 can't become evidence
    against a row, nor -1 evidence for it. The share of positives stays within prior_range. No
    patterns: the start.
    """
    start_good, start_bad = (0.05, 0.45, 0.5), (0.4, 0.45, 0.15)
    model = Model(prior, (start_good,) * labelers, (start_bad,) * labelers)
    patterns = sorted((tuple(v), n) for v, n in patterns)
    total = sum(n for _, n in patterns)
    for _ in range(rounds if total else 0):
        good = [[earlier * x for x in start_good] for _ in range(labelers)]
        bad = [[earlier * x for x in start_bad] for _ in range(labelers)]
        positive = 0.0
        for votes, n in patterns:
            p = model.posterior(votes)
            positive += n * p
            for j, v in enumerate(votes):
                good[j][v + 1] += n * p
                bad[j][v + 1] += n * (1 - p)
        shares = [[[x / sum(row) for x in row] for row in side] for side in (good, bad)]
        for g, b in zip(*shares):
            for k, right in ((0, b), (2, g)):
                wrong = g if right is b else b
                if right[k] < wrong[k]:
                    right[k] = wrong[k] = (right[k] + wrong[k]) / 2
        low, high = prior_range
        model = Model(min(high, max(low, positive / total)), *(tuple(map(tuple, side)) for side in shares))
    return model
