"""Running independent jobs at the same time.

A plan that writes several tables which do not need each other leaves a cluster idle between its small jobs;
submitted from threads, they share it.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import SparkSession
from pyspark.util import inheritable_thread_target

WIDTH = 8


def together(spark: SparkSession, steps: Sequence[Callable[[], object]], width: int = WIDTH) -> list:
    """The results of ``steps``, in order; the first failure is raised after all have ended."""
    with ThreadPoolExecutor(max(1, min(width, len(steps)))) as pool:
        running = [pool.submit(inheritable_thread_target(spark)(step)) for step in steps]
    return [r.result() for r in running]
