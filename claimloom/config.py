"""Settings of the engine (S18): one object, overridden from the environment or the session."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Settings:
    """Passages per lane and claim in the standard and the deep mode, the constant of rank fusion, floors of review."""

    standard: int = 5
    deep: int = 15
    fusion_k: int = 60
    review_confidence: float = 0.60
    review_harm: float = 0.65

    @staticmethod
    def read(spark=None) -> Settings:
        """Values from CLAIMLOOM_<NAME> in the environment, then spark.claimloom.<name> in the session."""
        got = {}
        for f in fields(Settings):
            raw = os.environ.get(f"CLAIMLOOM_{f.name.upper()}")
            if spark is not None:
                raw = spark.conf.get(f"spark.claimloom.{f.name}", raw)
            if raw is not None:
                got[f.name] = type(f.default)(raw)
        return Settings(**got)
