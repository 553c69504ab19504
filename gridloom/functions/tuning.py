"""The tuning keywords that every operator takes: validated, and mapped to Spark where that has a meaning.

`max_tasks` bounds buckets or partitions, `min_elems` is the least rows of a bucket. `block_size`,
`items_per_thread`, `temp*`, `prefer_threads`, `backend` and `switch_below` have no meaning for a Spark plan;
they are checked and ignored. Unknown keywords are a TypeError, since every operator names its own.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any


@dataclass(frozen=True)
class Tuning:
    max_tasks: int | None = None
    min_elems: int | None = None
    block_size: int | None = None
    items_per_thread: int | None = None
    switch_below: int = 0
    prefer_threads: bool = True
    backend: Any = None
    temp: Any = None

    def checked(self, least_elems: int = 1, most_block: int | None = None) -> Tuning:
        if self.max_tasks is not None and self.max_tasks <= 0:
            raise ValueError("max_tasks must be positive")
        if self.min_elems is not None and self.min_elems < least_elems:
            raise ValueError(f"min_elems must be at least {least_elems}")
        if self.block_size is not None:
            n = self.block_size
            if n < 1 or n & (n - 1) or (most_block is not None and n > most_block):
                raise ValueError("block_size must be a power of two in range")
        if self.items_per_thread is not None and self.items_per_thread < 1:
            raise ValueError("items_per_thread must be positive")
        if self.switch_below < 0:
            raise ValueError("switch_below must not be negative")
        return self

    def bucket(self, n: int, default: int) -> int:
        """Rows of a bucket for n rows."""
        size = max(default, self.min_elems or 1)
        return max(size, -(-n // self.max_tasks)) if self.max_tasks else size


NONE = Tuning()
