"""Small independent jobs side by side: their cost is planning, not data, so waiting for one another is all loss."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

AT_ONCE = 4


def at_once(*jobs: Callable[[], object]) -> list:
    """The results of the jobs, in their order; the first error is raised."""
    with ThreadPoolExecutor(AT_ONCE) as pool:
        return [f.result() for f in [pool.submit(j) for j in jobs]]
