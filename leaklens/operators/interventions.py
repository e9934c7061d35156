"""The plug-in surface: interventions by name or by file, as DataFrame transformers."""

from __future__ import annotations

import importlib.util
from abc import ABC, abstractmethod
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Intervention(ABC):
    """Fits on a DataFrame if it has to, then maps DataFrame to DataFrame."""

    name: str

    def fit(self, df: DataFrame) -> Intervention:
        return self

    @abstractmethod
    def transform(self, df: DataFrame) -> DataFrame: ...

    def summary(self) -> dict:
        return {"name": self.name}


REGISTRY: dict[str, type[Intervention]] = {}
#: Names of methods that act inside a language model while it decodes or trains, and what they would need.
NEEDS_MODEL = {"noise": "logits", "eco": "token embeddings", "star": "decoding steps", "leace": "hidden states", "cha": "logits and gradients", "o3": "adapters", "mlp_probe": "hidden states", "rlace": "hidden states"}


def register(kind: type[Intervention]) -> type[Intervention]:
    REGISTRY[kind.name] = kind
    return kind


@register
class NoIntervention(Intervention):
    name = "none"

    def transform(self, df: DataFrame) -> DataFrame:
        return df


@register
class MeanDirection(Intervention):
    """Takes the difference of the two sides' means out of every vector."""

    name = "repe"

    def fit(self, df: DataFrame) -> Intervention:
        from leaklens.operators.search import mean_direction

        self.direction = mean_direction(df)
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        from leaklens.operators.search import project_out

        return project_out(df, self.direction)


@register
class SpreadDirections(Intervention):
    """Takes out of every vector the directions in which the spread of labels under 5 and that of the others differ most."""

    name = "rlace_vectors"

    def __init__(self, k: int = 2) -> None:
        self.k = k

    def fit(self, df: DataFrame) -> Intervention:
        from leaklens.operators.moments import spread_directions, take_out

        self.eraser = take_out(spread_directions(df, F.col("label") < 5, self.k))
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        return self.eraser.transform(df)


@register
class ConceptErasure(Intervention):
    """Makes the mean vectors of labels under 5 and of the others equal, moving vectors as little as can be."""

    name = "leace_vectors"

    def fit(self, df: DataFrame) -> Intervention:
        from leaklens.operators.moments import concept_eraser, moments

        self.eraser = concept_eraser(moments(df.withColumn("_side", F.col("label") < 5), "_side"))
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        return self.eraser.transform(df)


def load(spec: str) -> type[Intervention]:
    """A registered name, or `file.py` or `file.py::Class`; a file without a class name must define exactly one."""
    if spec in REGISTRY:
        return REGISTRY[spec]
    if spec in NEEDS_MODEL:
        raise NotImplementedError(f"{spec} needs a language model's {NEEDS_MODEL[spec]}; give its stored vectors to a plug-in instead")
    path, _, name = spec.partition("::")
    if not path.endswith(".py") or not Path(path).exists():
        raise ValueError(f"no intervention named {spec!r}; known: {', '.join(sorted(REGISTRY))}")
    module_spec = importlib.util.spec_from_file_location(Path(path).stem, path)
    module = importlib.util.module_from_spec(module_spec)
    module_spec.loader.exec_module(module)
    kinds = {k.__name__: k for k in vars(module).values() if isinstance(k, type) and issubclass(k, Intervention) and k.__module__ == module.__name__}
    if name:
        if name not in kinds:
            raise ValueError(f"{path} has no intervention {name!r}")
        return kinds[name]
    if len(kinds) != 1:
        raise ValueError(f"{path} must define exactly one intervention, found {len(kinds)}")
    return next(iter(kinds.values()))
