"""Parameters of retrieval, ranking and evaluation, with their usual values."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Settings:
    window_days: float = 14.0
    top_k: int = 5
    # Semantic retrieval
    semantic_weight: float = 0.7
    file_weight: float = 0.3
    relevant_above: float = 0.5
    semantic_fan_out: int = 3
    # Hybrid retrieval
    keyword_weight: float = 0.3
    retrieval_factor: int = 5
    hybrid_fan_out: int = 2
    boost_fan_out: int = 3
    boost_weight: float = 0.3
    # Several query texts
    count_boost: float = 0.1
    merged_weight: float = 0.6
    merged_file_weight: float = 0.4
    path_files: int = 5
    path_part_above: int = 3
    path_tokens: int = 20
    # Candidate pools
    ann_k: int = 50
    ann_days: float = 90.0
    pool_k: int = 20
    pool_days: float = 30.0
    # Training
    most_negatives: int = 20
    hard_share: float = 0.6
    test_share: float = 0.3
    seed: int = 42
    # Blend of model and retrieval
    model_weight: float = 0.5
    refine_weight: float = 0.5
    # Reranking
    head: int = 10
    title_chars: int = 300
    text_chars: int = 1500
    files_listed: int = 25
    # Evaluation
    ks: tuple[int, ...] = (1, 2, 4, 6, 8, 10)
    windows: tuple[int, ...] = (2, 7, 14, 30)
    environment: dict = field(default_factory=dict)

    @classmethod
    def from_environment(cls, env: dict[str, str]) -> Settings:
        """Settings with WEFTLINE_<NAME> of an environment in place of the usual values; texts that aren't numbers are refused."""
        out = {}
        for name, usual in cls().__dict__.items():
            value = env.get(f"WEFTLINE_{name.upper()}")
            if value is not None and isinstance(usual, int | float):
                out[name] = type(usual)(float(value))
        return cls(**out)


USUAL = Settings()
