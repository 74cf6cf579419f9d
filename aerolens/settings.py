"""Run parameters.

One frozen dataclass handed to every operator that needs a knob. Defaults are
the workload sizes of the original application; the extra fields are ours and
say how the Spark plans bound what they broadcast or collect.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace


@dataclass(frozen=True)
class Settings:
    # Fixed values that must equal the original application's defaults.
    top_k: int = 40
    score_min: float | None = None  # declared as 0.32 upstream but never applied: off by default
    sweep_target_max: int = 3000
    sweep_probes: int = 40
    sweep_probe_k: int = 200
    vector_dim: int = 1536
    seed: int = 42
    elevated_threshold: float = 4.0
    min_support: float = 0.02
    min_uplift: float = 1.2
    min_rule_n: int = 30
    rules_reported: int = 6
    watchlist_size: int = 5
    critical_n: int = 5
    vocab_size: int = 5000
    kmeans_restarts: int = 10
    contamination: float = 0.02
    iforest_trees: int = 100
    iforest_sample: int = 256

    # Ours: scale guards.
    rank_digits: int = 12  # matches are ranked at 1e-12 resolution (noise of summation order), ties by id
    score_digits: int = 6  # scores are shown with this many digits
    question_block: int = 1024  # question vectors that meet a block of the corpus at once
    input_partitions: int = 0  # above 0: text and feature inputs are dealt to so many partitions first
    analysis_date: str | None = None  # None = current_date() in UTC
    source_name: str = "incidents"
    summary_model: str = "none"
    embed_model: str = "hashed-tfidf"
    drivers: tuple[str, ...] = field(
        default=("flight_phase", "light", "atc_advisory", "cause_category")
    )

    def with_(self, **kw) -> "Settings":
        return replace(self, **kw)


DEFAULT = Settings()
