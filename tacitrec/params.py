"""Parameters of a recommendation run."""

from __future__ import annotations

from dataclasses import dataclass

# The smallest popularity share used in the confidence weight, the
# smallest denominator of a factor update and the spread of the starting factors.
POPULARITY_FLOOR = 1e-12
DENOMINATOR_FLOOR = 1e-10
INIT_STDDEV = 0.01

# What a training task may hold, where the parameters do not say: bytes of the sums [A | b] of its
# entities and of the vectors of one range, and entities.
SUM_BYTES, VECTOR_BYTES = 1 << 26, 1 << 26
LEAST_BLOCK, MOST_BLOCK = 4_096, 1 << 17
LEAST_RANGE, MOST_RANGE = 1 << 16, 1 << 20


@dataclass(frozen=True)
class Params:
    """Model, data and evaluation parameters, with the layout limits of the Spark jobs."""

    min_interactions: int = 10
    sample_fraction: float = 1.0
    seed: int = 42

    factors: int = 64
    reg: float = 0.01
    w_obs: float = 1.0
    c0: float = 64.0
    alpha: float = 0.5
    epochs: int = 20

    top_k: int = 100
    max_eval_users: int | None = None

    # An entity with more distinct partners than this is split over several blocks.
    hot_degree: int = 100_000
    # Number of training blocks; None takes one per core of the cluster. There are more where a block
    # would have more than `block_entities` entities, so that no task grows with the data. Every vector is
    # copied to at most so many blocks in a half-step. A task holds the vectors of `range_entities` partners
    # at a time and carries the equations of its entities where there are more partners than that. None takes
    # as many of either as the number of factors leaves room for in a task.
    blocks: int | None = None
    block_entities: int | None = None
    range_entities: int | None = None

    def __post_init__(self) -> None:
        if self.factors < 1:
            raise ValueError("factors must be at least 1")
        if self.hot_degree < 1:
            raise ValueError("hot_degree must be positive")
        if any(limit is not None and limit < 1 for limit in (self.block_entities, self.range_entities)):
            raise ValueError("block_entities and range_entities must be positive")

    def entities_of_block(self, models: int = 1) -> int:
        """How many entities a block may have, when so many models train together."""
        fitting = SUM_BYTES // (8 * self.factors * (self.factors + 1) * models)
        return self.block_entities or min(max(fitting, LEAST_BLOCK), MOST_BLOCK)

    def entities_of_range(self, models: int = 1) -> int:
        """How many partners' vectors a task may hold, when so many models train together."""
        fitting = VECTOR_BYTES // (8 * (self.factors + 1) * models)
        return self.range_entities or min(max(fitting, LEAST_RANGE), MOST_RANGE)
