"""Settings with defaults, overridden by a JSON file and by ``spark.draftmill.*`` entries of the session."""

from __future__ import annotations

import json
from dataclasses import dataclass, fields, replace

from pyspark.sql import SparkSession

PREFIX = "spark.draftmill."


@dataclass(frozen=True)
class Settings:
    top_k: int = 3
    structure_weight: float = 0.8
    trust_threshold: float = 60.0
    grid_columns: int = 20
    grid_rows: int = 50
    bins: int = 9
    max_shift: int = 2
    input_height: int = 512
    input_width: int = 192
    heat_contrast: float = 0.2
    tile: int = 1024
    overlap: float = 0.2
    cabinet_margin: int = 48

    def overridden(self, values: dict) -> Settings:
        """Known names replace defaults, as numbers of the default's kind; unknown names raise."""
        kinds = {f.name: type(getattr(self, f.name)) for f in fields(self)}
        if unknown := sorted(set(values) - set(kinds)):
            raise ValueError(f"unknown settings: {', '.join(unknown)}")
        return replace(self, **{k: kinds[k](v) for k, v in values.items()})


def load(spark: SparkSession | None = None, path: str | None = None) -> Settings:
    """Defaults, then the JSON object at ``path`` (read by Spark, so any store will do), then the session's entries."""
    out = Settings()
    if path and spark is not None:
        out = out.overridden(json.loads(spark.read.text(path, wholetext=True).first()[0]))
    if spark is not None:
        out = out.overridden({f.name: v for f in fields(out) if (v := spark.conf.get(PREFIX + f.name, None)) is not None})
    return out
