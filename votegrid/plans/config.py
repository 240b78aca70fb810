"""Configuration: normalisation, search presets and training settings."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, field

DIM = 14
#: Lanes that cluster scans require to be equal (flags: online, card present, unknown merchant).
FLAG_LANES = (9, 10, 11)
#: Lanes -1 marks when there is no previous transaction.
OPTIONAL_LANES = (5, 6)
TOP_K = 5

# Risk by merchant category; other categories count as DEFAULT_RISK.
CATEGORY_RISK = {
    "5411": 0.15, "5812": 0.30, "5912": 0.20, "5944": 0.45, "7801": 0.80,
    "7802": 0.75, "7995": 0.85, "4511": 0.35, "5311": 0.25, "5999": 0.50,
}
DEFAULT_RISK = 0.5


@dataclass(frozen=True)
class Normalization:
    """Fixed values that scale request features to [0, 1], and the lane scale."""

    max_amount: float = 10_000.0
    max_installments: float = 12.0
    amount_vs_avg_ratio: float = 10.0
    max_minutes: float = 1_440.0
    max_km: float = 1_000.0
    max_tx_count_24h: float = 20.0
    max_merchant_avg_amount: float = 10_000.0
    scale: int = 10_000


@dataclass(frozen=True)
class SearchConfig:
    """Index search settings; out-of-range values are clamped, not refused.

    ``shortlist`` is the number of candidates that product-quantised search ranks
    again; it is in force from 6 on.  A unanimous vote means 0 or 5 votes.
    """

    nprobe: int = 8
    initial_nprobe: int | None = None
    adaptive_min_votes: int = 2
    adaptive_max_votes: int = 3
    shortlist: int | None = None
    use_boxes: bool = False
    expand_unanimous: bool = False
    use_boxes_on_expansion: bool = False

    def __post_init__(self) -> None:
        nprobe = max(1, self.nprobe)
        initial = nprobe if self.initial_nprobe is None else self.initial_nprobe
        object.__setattr__(self, "nprobe", nprobe)
        object.__setattr__(self, "initial_nprobe", min(max(1, initial), nprobe))
        if self.shortlist is not None:
            object.__setattr__(self, "shortlist", max(1, self.shortlist))

    @property
    def adaptive(self) -> bool:
        return self.initial_nprobe < self.nprobe and self.adaptive_min_votes <= self.adaptive_max_votes

    @property
    def quantised(self) -> bool:
        return self.shortlist is not None and self.shortlist > 5

    @property
    def boxes_when_expanded(self) -> bool:
        return self.use_boxes or self.use_boxes_on_expansion

    def expands_after(self, votes: int) -> bool:
        return self.adaptive and (
            self.adaptive_min_votes <= votes <= self.adaptive_max_votes
            or (self.expand_unanimous and votes in (0, 5))
        )

    @classmethod
    def preset(cls, name: str) -> SearchConfig:
        """``library``, ``server`` or ``deployed`` defaults."""
        return {
            "library": cls(),
            "server": cls(nprobe=4),
            "deployed": cls(
                nprobe=12, initial_nprobe=2, adaptive_min_votes=1, adaptive_max_votes=4,
                expand_unanimous=True, use_boxes_on_expansion=True,
            ),
        }[name]

    @classmethod
    def from_env(cls, env: Mapping[str, str] | None = None) -> SearchConfig:
        """From the environment; a value that is no integer counts as unset."""
        env = os.environ if env is None else env

        def number(name: str, default: int | None) -> int | None:
            try:
                return int(env[name])
            except (KeyError, ValueError):
                return default

        return cls(
            nprobe=number("IVF_NPROBE", 4), initial_nprobe=number("IVF_INITIAL_NPROBE", None),
            adaptive_min_votes=number("IVF_ADAPTIVE_MIN_VOTES", 2), adaptive_max_votes=number("IVF_ADAPTIVE_MAX_VOTES", 3),
            shortlist=number("IVFPQ_RERANK_CANDIDATES", None), use_boxes=env.get("IVF_USE_BBOX") == "1",
            expand_unanimous=env.get("IVF_ADAPTIVE_EXPAND_UNANIMOUS") == "1",
            use_boxes_on_expansion=env.get("IVF_ADAPTIVE_EXPANDED_USE_BBOX") == "1",
        )


@dataclass(frozen=True)
class IVFTraining:
    clusters: int = 1_024
    sample_count: int = 262_144
    iterations: int = 8
    full_refine_iterations: int = 0
    restarts: int = 1
    seed: int = 42
    plus_plus: bool = True


@dataclass(frozen=True)
class PQTraining:
    sample_count: int = 131_072
    iterations: int = 8
    subvectors: int = 4
    codes: int = 256
    seed: int = 42


@dataclass(frozen=True)
class ServiceConfig:
    """Where tables lie, and how to search."""

    references: str = "references"
    category_risk: str | None = None
    ivf: str | None = None
    pq: str | None = None
    search: SearchConfig = field(default_factory=SearchConfig)

    @classmethod
    def from_env(cls, env: Mapping[str, str] | None = None) -> ServiceConfig:
        env = os.environ if env is None else env
        refs = env.get("REFERENCES_BIN", "references")
        return cls(
            refs, env.get("MCC_RISK_JSON"), env.get("IVF_BIN", companion(refs, "ivf")), env.get("IVFPQ_BIN", companion(refs, "pq")),
            SearchConfig.from_env(env),
        )


def companion(path: str, extension: str) -> str:
    """The index path beside a reference path: its extension replaced."""
    head, _, name = path.rpartition("/")
    stem = name.rpartition(".")[0] or name
    return f"{head}/{stem}.{extension}" if head else f"{stem}.{extension}"
