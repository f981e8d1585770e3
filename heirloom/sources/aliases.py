"""Maps of place names from a file, for countries whose short forms are not built in."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import SparkSession

from heirloom.functions.places import ENDINGS, STATES

# The names that the file's two maps go by.
WHOLE, ENDING = "componentAliases", "suffixAliases"


class AliasError(ValueError):
    """A file of aliases can't be read or is not what it should be."""


@dataclass(frozen=True)
class Aliases:
    """What a whole part of a place stands for, and what an ending of a part stands for, whatever the case."""

    whole: dict[str, str] = field(default_factory=lambda: dict(STATES))
    ending: dict[str, str] = field(default_factory=lambda: dict(ENDINGS))


def read_aliases(spark: SparkSession, path: str) -> Aliases:
    """Both maps of a JSON file, in place of the built-in ones; each must be there, from texts to texts that are not empty."""
    try:
        found = json.loads("".join(r[0] for r in spark.read.text(path, wholetext=True).collect()))
    except Exception as e:
        raise AliasError(f"{path}: no aliases could be read: {e}") from e
    maps = {}
    for name in (WHOLE, ENDING):
        given = found.get(name) if isinstance(found, dict) else None
        if not isinstance(given, dict) or not all(isinstance(v, str) and v and k for k, v in given.items()):
            raise AliasError(f"{path}: {name} maps texts to texts")
        maps[name] = given
    return Aliases(maps[WHOLE], maps[ENDING])
