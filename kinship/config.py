"""The engine's settings. Defaults are those under which the published figures of this kind of pipeline were obtained."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Config:
    # candidates: how many each pass keeps for a record and source (reverse: for a candidate)
    k_all: int = 20
    k_name: int = 10
    k_addr: int = 15
    k_reverse: int = 3
    k_emb: int = 20
    min_block_score: float = 0.05
    min_emb_score: float = 0.0
    max_key_pairs: int = 2_000_000
    block_within_country: bool = True
    # look-alikes
    small_shift: tuple[int, int] = (1, 50)
    twin_name: float = 0.85
    twin_addr: float = 0.80
    support_name: float = 0.80
    min_word_pairs: int = 30
    word_smoothing: float = 20.0
    # training
    holdout: float = 0.10
    folds: int = 3
    train_s1: int = 600_000
    max_train_rows: int = 12_000_000
    hard_negative_name: float = 0.80
    tree_depth: int = 5
    tree_rounds: int = 40
    learning_rate: float = 0.1
    seeds: tuple[int, ...] = (42,)
    # records that say when to stop boosting (0: none do), and the least gain of a round
    early_share: float = 0.1
    early_tolerance: float = 0.001
    # second opinion on pairs
    top_pairs: int = 10
    min_pair_p: float = 0.005
    # decision
    beta: float = 0.5
    one_to_one: bool = True
    threshold_grid: tuple[float, ...] = field(default_factory=lambda: tuple(round(0.2 + 0.025 * i, 4) for i in range(31)))
    bias_grid: tuple[float, ...] = (-1.5, -1.0, -0.5, 0.0, 0.5, 1.0, 1.5)
    min_expected_p: float = 0.02
    # rows of the reports on errors
    max_errors: int = 5000
    max_misses: int = 3000
    # learned transliteration
    translit_count: int = 3
    translit_share: float = 0.5
    translit_latin: int = 3
