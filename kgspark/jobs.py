"""Named jobs from a file: listing, validation and running."""

from __future__ import annotations

import os
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame

from .config import ConfigError, read
from .operators import lifecycle


@dataclass(frozen=True)
class Job:
    name: str
    action: str
    args: dict[str, Any]
    output: str | None = None


def _hours(text: str) -> float:
    if not str(text).endswith("h"):
        raise ConfigError(f"{text!r} is not a number of hours such as 24h")
    return float(str(text)[:-1])


#: Actions by name: (table of runs, arguments) to a DataFrame.
ACTIONS: dict[str, Callable[[DataFrame, dict[str, Any]], DataFrame]] = {
    "report.changed_since": lambda runs, args: lifecycle.changed_since(runs, _hours(args.get("since", "24h")), args.get("now")),
}


def parse(raw: Any) -> list[Job]:
    """Jobs from a mapping of names or a list; a repeated name or unknown action is an error."""
    entries = (raw or {}).get("jobs") or []
    rows = [{"name": k, **(v or {})} for k, v in entries.items()] if isinstance(entries, dict) else list(entries)
    jobs: dict[str, Job] = {}
    for row in rows:
        name, action = row.get("name"), row.get("action") or {}
        if not name or name in jobs:
            raise ConfigError(f"job name {name!r} is missing or repeated")
        if action.get("type") not in ACTIONS:
            raise ConfigError(f"job {name!r} has the unknown action {action.get('type')!r}")
        jobs[name] = Job(name, action["type"], action.get("args") or {}, (row.get("output") or {}).get("path"))
    return list(jobs.values())


def load(path: str) -> list[Job]:
    return parse(read(path))


def output_path(job: Job, folder: str) -> str:
    """Where a job's report goes: below ``folder``, which its own path may not leave."""
    top = os.path.realpath(folder)
    path = os.path.realpath(os.path.join(top, job.output or f"reports/{job.name}.md"))
    if os.path.commonpath([top, path]) != top:
        raise ConfigError(f"the output of job {job.name!r} leaves {folder}")
    return path


def run(job: Job, runs: DataFrame) -> DataFrame:
    """The runs that a job reports."""
    return ACTIONS[job.action](runs, job.args)


def report(job: Job, runs: DataFrame, folder: str, redact: Callable[[str], str] = str) -> dict[str, Any]:
    """The job's runs as a report in markdown below ``folder``; its path and how many runs it names.

    A report has a line for each run, so it is written by the driver, line by line.
    """
    found = run(job, runs).select("run_id").distinct().orderBy("run_id")
    path = output_path(job, folder)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    count = 0
    with open(path, "w", encoding="utf-8") as out:
        out.write(redact(f"# Changes since {job.args.get('since', '24h')}") + "\n\n")
        for row in found.toLocalIterator():
            out.write(redact(f"- {row['run_id']}") + "\n")
            count += 1
    return {"job": job.name, "output": path, "runs": count}
