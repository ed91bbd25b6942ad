"""Knobs of the model and of its rendering."""

from __future__ import annotations

import json
from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, StructField, StructType

# Scene sizes by label.
SCENE_SIZES = {"tight": 8, "standard": 14, "wide": 22}


@dataclass(frozen=True)
class Options:
    # these change the model
    neighbours: int = 3
    spine_cap: int = 8
    budget: int = 20
    adjacent_m: float = 25.0
    near_m: float = 150.0
    short_walk_m: float = 500.0
    # these change its rendering alone
    bidirectional: bool = False
    inline_name: bool = False
    preamble: bool = True
    minor_features: bool = False
    chunking: bool = False
    scene_size: int = 14
    min_terrain_m2: float = 5000.0
    #: The word before a whole map's title.
    title_word: str = "MAP"


def scene_size(label: str | None) -> int:
    return SCENE_SIZES.get(label or "", SCENE_SIZES["standard"])


def parse(text: str | None) -> Options:
    """Options from JSON with up to six keys, whose case does not matter; nothing or blank gives the defaults."""
    if not text or not text.strip():
        return Options()
    given = {k.lower(): v for k, v in (json.loads(text) or {}).items()}
    names = {"bidirectional": "bidirectional", "inlineneighborname": "inline_name", "directivepreamble": "preamble", "chunking": "chunking", "minorfeatures": "minor_features"}
    found = {ours: given[k] for k, ours in names.items() if isinstance(given.get(k), bool)}
    if isinstance(given.get("scenesize"), str):
        found["scene_size"] = scene_size(given["scenesize"])
    return replace(Options(), **found)


_PARSED = {"bidirectional": BooleanType(), "inline_name": BooleanType(), "preamble": BooleanType(), "chunking": BooleanType(), "minor_features": BooleanType(), "scene_size": IntegerType()}


@F.pandas_udf(StructType([StructField(*x) for x in _PARSED.items()]))
def parsed(texts: pd.Series) -> pd.DataFrame:
    """The options of many texts, as columns."""
    found = [parse(t) for t in texts]
    return pd.DataFrame({n: [getattr(o, n) for o in found] for n in _PARSED})
