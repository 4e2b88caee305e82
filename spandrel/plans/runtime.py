"""Launch modes, progress and the state that events fold into."""

from __future__ import annotations

import sys
import threading
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field, replace
from enum import Enum
from typing import TextIO

from spandrel.sources.config import RuntimeOptions


class LaunchMode(Enum):
    TUI = "tui"
    TEXT = "text"
    JSON = "json"

    @property
    def output_format(self) -> str | None:
        return None if self is LaunchMode.TUI else self.value


@dataclass(frozen=True)
class Terminal:
    stdin: bool
    stdout: bool

    @classmethod
    def current(cls) -> Terminal:
        return cls(sys.stdin.isatty(), sys.stdout.isatty())

    @property
    def interactive(self) -> bool:
        return self.stdin and self.stdout


def launch_mode(options: RuntimeOptions, terminal: Terminal) -> LaunchMode:
    """How to run: what is asked for, else a dashboard where there is a terminal, else text."""
    if options.cli and options.tui:
        raise ValueError("--cli and --tui cannot be used together")
    if options.tui:
        if not terminal.interactive:
            raise ValueError("The TUI requires an interactive terminal")
        return LaunchMode.TUI
    if options.output:
        return LaunchMode(options.output)
    return LaunchMode.TUI if terminal.interactive and not options.cli else LaunchMode.TEXT


class Stage(Enum):
    IDLE = "Idle"
    STARTING = "Starting"
    CRAWLING = "Crawling"
    CHECKING = "Checking links"
    ANALYZING = "Analyzing"
    REPORTING = "Generating report"
    FINISHED = "Finished"


@dataclass(frozen=True)
class Progress:
    stage: Stage
    message: str = ""
    pages_crawled: int = 0
    links_discovered: int = 0
    links_checked: int = 0
    total_links: int = 0
    errors: int = 0
    warnings: int = 0
    infos: int = 0

    @property
    def checked_of(self) -> str:
        return f"{self.links_checked}/{max(self.total_links, self.links_discovered)}"


@dataclass(frozen=True)
class State:
    """What a dashboard shows; ``fold`` gives the next state for an event (kind, value)."""

    progress: Progress = field(default_factory=lambda: Progress(Stage.IDLE))
    report: object = None
    error: str | None = None
    notice: str | None = None
    scanning: bool = False

    def fold(self, kind: str, value: object) -> State:
        if kind == "started":
            return replace(self, progress=Progress(Stage.STARTING, str(value)), report=None, error=None, scanning=True)
        if kind == "progress":
            return replace(self, progress=value)
        if kind == "finished":
            return replace(self, progress=replace(self.progress, stage=Stage.FINISHED), report=value, scanning=False)
        if kind == "failed":
            return replace(self, error=str(value), scanning=False)
        if kind == "update":
            return replace(self, notice=str(value))
        raise ValueError(f"unknown event {kind!r}")


Listener = Callable[[str, object], None]


class Bar:
    """Draws the progress of a run as one line that is written over, or where nobody looks, as nothing."""

    WIDTH = 24

    def __init__(self, out: TextIO, most_pages: int | None = None, live: bool | None = None) -> None:
        self.out, self.most, self.live, self.size = out, most_pages, out.isatty() if live is None else live, 0

    def line(self, p: Progress) -> str:
        done, of, what = (p.links_checked, max(p.total_links, p.links_discovered), "links") if p.stage is Stage.CHECKING else (p.pages_crawled, self.most, "pages")
        full = round(self.WIDTH * min(done / of, 1)) if of else 0
        return f"[{'#' * full}{'-' * (self.WIDTH - full)}] {done}/{of if of is not None else '?'} {what}  {p.stage.value}: {p.message}"

    def __call__(self, kind: str, value: object) -> None:
        if not self.live or kind != "progress":
            return
        text = "" if value.stage in (Stage.REPORTING, Stage.FINISHED) else self.line(value)
        self.out.write("\r" + text.ljust(self.size) + ("\r" + " " * self.size + "\r" if not text else ""))
        self.out.flush()
        self.size = len(text)


@contextmanager
def watched(value: Callable[[], int], tell: Callable[[int], None], every: float = 0.5) -> Iterator[None]:
    """Tells what ``value`` gives whenever it has changed, while the body runs."""
    over = threading.Event()

    def look() -> None:
        last = 0
        while not over.wait(every):
            if (now := value()) != last:
                tell(now)
                last = now

    thread = threading.Thread(target=look, daemon=True)
    thread.start()
    try:
        yield
    finally:
        over.set()
        thread.join()
