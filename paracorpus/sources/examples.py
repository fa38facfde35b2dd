"""The union of the enabled sources."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paracorpus.functions import text as T
from paracorpus.operators.pairing import to_examples


def recordings_to_examples(recordings: DataFrame, cache: str | None = None) -> DataFrame:
    """Recordings in the example columns; `cache` is the folder the audio paths are under."""
    audio = T.join_path(F.lit(cache), "audio_path") if cache else F.col("audio_path")
    return to_examples(
        recordings,
        {
            "id": "id", "audio": audio, "transcript": "transcript",
            "english_translation": "english_translation", "dialect": "dialect",
            "participant_id": "participant_id",
        },
    )


# Which splits a kind of source has; None stands for all of them.
SPLITS = {"catalog": None, "recordings": {"train"}, "tree": None}


def load_examples(split: str, **sources: Callable[[str], DataFrame]) -> DataFrame:
    """All rows of the sources that serve `split`, duplicates kept, absent columns null.

    Each keyword is a kind of source and builds it for a split; a source that does not serve the
    split is never opened.
    """
    unknown = sources.keys() - SPLITS.keys()
    if unknown:
        raise ValueError(f"unknown kinds of sources: {sorted(unknown)}")
    serving = [make for kind, make in sources.items() if make and (SPLITS[kind] is None or split in SPLITS[kind])]
    if not serving:
        raise ValueError(f"none of the given sources has a split named {split!r}")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [make(split) for make in serving])
