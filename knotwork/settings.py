"""Settings of rounds and of training, with their defaults."""

from __future__ import annotations

from dataclasses import dataclass, fields

# What a setting may be.
CHOICES = {
    "distribution_strategy": ("full_broadcast", "relevance_based"),
    "simulation_mode": ("topic_skew", "iid", "dirichlet"),
    "adv_estimator": ("gae", "grpo", "reinforce_plus_plus", "remax", "rloo"),
    "kl_penalty": ("kl", "abs", "mse", "low_var_kl"),
    "kl_loss_type": ("kl", "abs", "mse", "low_var_kl"),
    "kl_ctrl": ("fixed", "adaptive"),
}


@dataclass(frozen=True)
class Settings:
    """Rounds and clients, data split, uplink, and the numbers of training. A value that isn't among its choices, or out of
    its range, raises ``ValueError``."""

    num_clients: int = 3
    num_rounds: int = 40
    client_frac: float = 1.0
    num_epochs: int = 1
    lora_rank: int = 16
    lora_alpha: int = 32
    lora_modules: tuple[str, ...] = ("q_proj", "k_proj", "v_proj", "o_proj")
    lr: float = 5e-7
    train_batch_size: int = 42
    kl_loss_coef: float = 0.001
    kl_loss_type: str = "low_var_kl"
    fedprox_mu: float = 0.0
    distribution_strategy: str = "full_broadcast"
    dataset: str = "2WikiMultiHopQA"
    simulation_mode: str = "topic_skew"
    dirichlet_alpha: float = 0.5
    lora_top_k_ratio: float | None = None
    seed: int = 42
    max_prompt_length: int = 512
    max_response_length: int = 512
    ppo_mini_batch_size: int = 256
    ppo_epochs: int = 1
    clip_ratio: float = 0.2
    cliprange_value: float = 0.5
    entropy_coeff: float = 0.001
    gamma: float = 1.0
    lam: float = 1.0
    adv_estimator: str = "gae"
    kl_penalty: str = "kl"
    kl_ctrl: str = "fixed"
    kl_coef: float = 0.001
    max_turns: int = 10

    def __post_init__(self) -> None:
        for name, allowed in CHOICES.items():
            if getattr(self, name) not in allowed:
                raise ValueError(f"{name} is one of {allowed}, not {getattr(self, name)!r}")
        if not 0 < self.client_frac <= 1:
            raise ValueError("client_frac is above 0 and at most 1")

    @classmethod
    def of(cls, values: dict[str, object]) -> Settings:
        """Settings from a dictionary; a name that is none raises ``ValueError``."""
        unknown = set(values) - {f.name for f in fields(cls)}
        if unknown:
            raise ValueError(f"no settings {sorted(unknown)}")
        return cls(**{k: tuple(v) if isinstance(v, list) else v for k, v in values.items()})
