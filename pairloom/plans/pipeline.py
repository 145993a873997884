"""Stages of a run: slices, completeness, skipping, early stop and status. Driver side only."""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pairloom.sources.sinks import status


@dataclass
class Stage:
    name: str
    run: Callable[[], None]
    complete: Callable[[], bool] | None = None  # nothing to check if None
    enough: Callable[[], bool] = lambda: True  # checked before the stage; false stops the run


@dataclass
class Plan:
    stages: list[Stage]
    status_path: str | None = None
    log: list[dict] = field(default_factory=list)

    def slice(self, first: str | None = None, last: str | None = None) -> list[Stage]:
        names = [s.name for s in self.stages]
        if len(set(names)) < len(names):
            raise ValueError("stages must have different names")
        a = names.index(first) if first else 0
        b = names.index(last) if last else len(names) - 1
        if a > b:
            raise ValueError(f"{first} comes after {last}")
        return self.stages[a : b + 1]

    def execute(self, first: str | None = None, last: str | None = None, force: bool = False, dry: bool = False) -> list[dict]:
        """Run a slice. Complete stages are skipped unless forced; a stage that isn't complete after its run is an
        error where completeness is defined; a failed `enough` stops the run."""
        for stage in self.slice(first, last):
            if not stage.enough():
                self._note(stage, "stopped")
                break
            if stage.complete and stage.complete() and not force:
                self._note(stage, "skipped")
            elif dry:
                self._note(stage, "planned")
            else:
                stage.run()
                if stage.complete and not stage.complete():
                    self._note(stage, "incomplete")
                    raise RuntimeError(f"stage {stage.name} left its output incomplete")
                self._note(stage, "done")
        return self.log

    def _note(self, stage: Stage, state: str) -> None:
        self.log.append({"stage": stage.name, "state": state, "at": datetime.now(timezone.utc).isoformat()})
        if self.status_path:
            status(self.status_path, {"stages": self.log})


def merged(base: dict, *overlays: dict) -> dict:
    """Deep merge; later values win, lists are replaced."""
    out = dict(base)
    for o in overlays:
        for k, v in o.items():
            out[k] = merged(out[k], v) if isinstance(out.get(k), dict) and isinstance(v, dict) else v
    return out


def expanded(template: str, **values: str) -> str:
    """A path with {names} and environment variables filled in; a missing one is an error."""
    out = os.path.expandvars(template.format(**values))
    if re.search(r"\$\{?\w+", out):
        raise KeyError(f"unset variable in {template!r}")
    return out


def masked(text: str, key: str) -> str:
    return text.replace(key, "***") if key else text


@contextmanager
def exclusive(path: str) -> Iterator[None]:
    """Holds a lock file; a second run that asks for it fails at once."""
    try:
        handle = os.open(path, os.O_CREAT | os.O_EXCL | os.O_WRONLY)
    except FileExistsError:
        raise RuntimeError(f"another run holds {path}") from None
    try:
        os.write(handle, str(os.getpid()).encode())
        os.close(handle)
        yield
    finally:
        os.remove(path)


def run_all(tasks: dict[str, Callable[[], None]], workers: int = 4) -> dict[str, Exception]:
    """Runs tasks side by side, all of them; returns what failed."""
    failed: dict[str, Exception] = {}

    def one(name: str) -> None:
        try:
            tasks[name]()
        except Exception as e:  # noqa: BLE001  collected, not hidden
            failed[name] = e

    with ThreadPoolExecutor(workers) as pool:
        list(pool.map(one, tasks))
    return failed


def piloted(run: Callable[[int], None], good: Callable[[], bool], pilot: int = 20, full: int = 100) -> bool:
    """A small run first; the full one only if its result is good."""
    run(pilot)
    if not good():
        return False
    run(full)
    return True


def expect_rows(counts: dict[str, int], expected: dict[str, int]) -> None:
    """Fails with all tables whose number of rows isn't the one expected."""
    wrong = {k: (counts.get(k), n) for k, n in expected.items() if counts.get(k) != n}
    if wrong:
        raise ValueError(f"rows (found, expected): {wrong}")
