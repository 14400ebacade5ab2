"""Named steps over files: run, skip what is done, and stop at the first failure."""

from __future__ import annotations

import logging
import re
import time
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from pyspark.sql import SparkSession

log = logging.getLogger(__name__)


@dataclass(frozen=True)
class Step:
    name: str
    run: Callable[[], object]
    expects: tuple[str, ...] = field(default=())


class StepFailed(RuntimeError):
    pass


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def discover(names: Iterable[str]) -> list[str]:
    """Data set names from file names: .zst or .jsonl, without _submissions or _posts; distinct, sorted."""
    found = (re.fullmatch(r"(.+?)(?:_submissions|_posts)?\.(?:zst|jsonl)", n.rsplit("/", 1)[-1]) for n in names)
    return sorted({m[1] for m in found if m})


def chosen(steps: Iterable[Step], only: str = "", skip: str = "") -> list[Step]:
    """Steps whose name contains `only` and not `skip`, without regard to case; blank means no limit."""
    return [s for s in steps if (not only or only.lower() in s.name.lower()) and not (skip and skip.lower() in s.name.lower())]


def run_steps(spark: SparkSession, steps: Iterable[Step], force: bool = False) -> dict[str, float]:
    """Seconds by step that ran; steps whose outputs all exist are skipped unless forced."""
    took = {}
    for s in steps:
        if not force and s.expects and all(exists(spark, p) for p in s.expects):
            log.info("skipped %s", s.name)
            continue
        began = time.time()
        try:
            s.run()
        except Exception as e:
            raise StepFailed(f"{s.name}: {e}") from e
        missing = [p for p in s.expects if not exists(spark, p)]
        if missing:
            raise StepFailed(f"{s.name}: no {', '.join(missing)}")
        took[s.name] = time.time() - began
    return took
