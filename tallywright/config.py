"""Where things are: arguments first, then environment variables, then defaults."""

from __future__ import annotations

import os
from dataclasses import dataclass


@dataclass(frozen=True)
class Roots:
    benchmark: str = "benchmarking_data"
    inference: str = "inference_outputs"
    evaluation: str = "eval_outputs"
    videos: str | None = None

    @classmethod
    def from_environment(cls, **given: str | None) -> Roots:
        """TALLY_BENCHMARK, TALLY_INFERENCE, TALLY_EVALUATION, TALLY_VIDEOS; ``given`` wins."""
        found = {f: given.get(f) or os.environ.get(f"TALLY_{f.upper()}") for f in cls.__dataclass_fields__}
        return cls(**{f: v for f, v in found.items() if v})
