"""Settings of the index pipeline, and the errors it raises."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass, field, replace

SCHEMES = ("sample", "value", "unit", "upb", "college", "nonwhite")


class IndexError_(Exception):
    """Base of the package's errors."""


class ConfigError(IndexError_):
    """Settings that contradict each other."""


class DataError(IndexError_):
    """Input that fails a strict check."""


@dataclass(frozen=True)
class Settings:
    """All thresholds are inclusive."""

    max_cagr: float = 0.30
    min_ratio: float = 0.25
    max_ratio: float = 10.0
    min_days: int = 0
    min_half_pairs: int = 40
    min_obs: int = 10
    ridge: float = 1e-8
    first_year: int = 1975
    start_year: int = 1989
    end_year: int = 2021
    base_year: int = 1989
    base_value: float = 100.0
    unit: str = "km"
    window: str = "all"
    schemes: tuple[str, ...] = field(default=SCHEMES)

    def __post_init__(self) -> None:
        if not self.first_year <= self.start_year <= self.base_year <= self.end_year:
            raise ConfigError("years must be ordered: first, start, base, end")
        if unknown := set(self.schemes) - set(SCHEMES):
            raise ConfigError(f"unknown weight schemes: {sorted(unknown)}")
        if not 0 < self.min_ratio < self.max_ratio or self.max_cagr <= 0 or self.min_half_pairs < 1 or self.min_obs < 1 or self.min_days < 0:
            raise ConfigError("thresholds out of range")
        if self.unit not in ("km", "mi") or self.window not in ("all", "pair"):
            raise ConfigError("unit is km or mi, window is all or pair")

    def with_(self, **changes) -> Settings:
        return replace(self, **changes)

    def key(self) -> str:
        """A short hash that names stage outputs made with these settings."""
        return hashlib.sha256(json.dumps(asdict(self), sort_keys=True).encode()).hexdigest()[:16]

    def save(self, path: str) -> None:
        with open(path, "w") as f:
            json.dump(asdict(self), f, indent=1)

    @classmethod
    def load(cls, path: str) -> Settings:
        with open(path) as f:
            got = json.load(f)
        return cls(**got | {"schemes": tuple(got.get("schemes", SCHEMES))})


#: For the driver's tables: orders span 1995 to 2001 and are sparse.
DRIVER = Settings(first_year=1995, start_year=1995, base_year=1996, end_year=2001, min_half_pairs=5, min_obs=3)
