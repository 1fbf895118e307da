"""Spark jobs that do not depend on each other."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor


def side_by_side(jobs: list[Callable[[], object]], at_once: int | None = None) -> list[object]:
    """Run the jobs from threads of their own, all or `at_once` of them at a time; the first error is raised once
    all have ended."""
    with ThreadPoolExecutor(max_workers=at_once or len(jobs)) as pool:
        return [job.result() for job in [pool.submit(job) for job in jobs]]
