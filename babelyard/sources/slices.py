"""Whole texts in Python workers, a few at a time."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd

#: Characters of contents that are parsed before their rows are handed back, unless one content alone is longer.
MOST = 1 << 18


def few(frames: Iterator[pd.DataFrame], column: str = "content", most: int | None = None) -> Iterator[pd.DataFrame]:
    """Slices of the frames, in order, with few characters of the column each; a longer text is a slice of its own. What is parsed of
    a text takes many times its room, and Spark's frames are bounded by rows: without this a worker's memory follows what a task has read."""
    most = MOST if most is None else most
    for frame in frames:
        begin, held = 0, 0
        for k, text in enumerate(frame[column]):
            size = len(text) if isinstance(text, str) else 0
            if k > begin and held + size > most:
                yield frame.iloc[begin:k]
                begin, held = k, 0
            held += size
        if begin < len(frame):
            yield frame.iloc[begin:]
