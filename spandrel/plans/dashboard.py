"""A line-based dashboard: asks for an address, shows the scan while it runs, then filters, searches, sorts and pages
through its pages, with the details of one."""

from __future__ import annotations

import queue
import threading
from collections.abc import Callable
from dataclasses import dataclass, replace
from typing import TextIO

from pyspark.sql import DataFrame

from spandrel.functions.urls import is_scan_url
from spandrel.operators import views
from spandrel.operators.rules import issues_of
from spandrel.plans.runtime import Listener, State
from spandrel.sinks import report

SIZE = 10
HELP = "f filter  s sort  /text search  n next  p previous  g first  <number> details  u <address> scan  q quit"


@dataclass(frozen=True)
class View:
    severity: str = "All"
    sort: str = "Severity"
    query: str = ""
    offset: int = 0


def step(view: View, command: str, total: int) -> View:
    """The view after a command; moving stays within the rows, a new filter, order or search starts at the first."""
    if command == "f":
        return replace(view, severity=views.next_filter(view.severity), offset=0)
    if command == "s":
        return replace(view, sort=views.next_sort(view.sort), offset=0)
    if command.startswith("/"):
        return replace(view, query=command[1:].strip(), offset=0)
    if command in ("n", "p", "g"):
        by = {"n": SIZE, "p": -SIZE, "g": -view.offset}[command]
        return replace(view, offset=views.cursor(view.offset, by, total))
    return view


def shown(pages: DataFrame, issues: DataFrame, view: View) -> tuple[int, list]:
    """The number of matching pages, and the rows of the screen in their order."""
    rows = views.view(pages, issues, view.severity, view.query, view.sort)
    screen = [r.page_key for r in views.paged(rows.select("page_key"), view.offset, SIZE).collect()]
    table = {r.page_key: r for r in report.table_rows(pages.where(pages.page_key.isin(screen)), issues).collect()} if screen else {}
    return views.matching(pages, issues, view.severity, view.query).count(), [table[k] for k in screen]


def live(url: str | None, scan: Callable[[str, Listener], DataFrame], source: TextIO, out: TextIO) -> DataFrame | None:
    """Scans ``url``, or what is asked for, and shows the results; then what is asked for next. The last scan's pages.

    ``scan`` runs beside the dashboard and is shown as it goes on: what it tells is folded into the state. An address that
    can't be scanned, and a scan that fails, say so and ask again.
    """
    pages = None
    while True:
        if not url:
            print("Address to scan (q quits): ", end="", file=out, flush=True)
            url = source.readline().strip()
            if url in ("", "q"):
                return pages
        if not is_scan_url(url):
            print("URL must start with http:// or https://", file=out)
            url = None
            continue
        pages, failed = _shown_scan(url, scan, out)
        url = None
        if not failed and (asked := run(pages, source, out)) is None:
            return pages
        elif not failed:
            url = asked


def _shown_scan(url: str, scan: Callable[[str, Listener], DataFrame], out: TextIO) -> tuple[DataFrame | None, bool]:
    events: queue.Queue = queue.Queue()

    def work() -> None:
        try:
            events.put(("finished", scan(url, lambda kind, value: events.put((kind, value)))))
        except Exception as e:  # noqa: BLE001
            events.put(("failed", e))

    threading.Thread(target=work, daemon=True).start()
    state = State().fold("started", url)
    while state.scanning:
        state = state.fold(*events.get())
        p = state.progress
        print(f"{url}  {p.stage.value}  {p.message}" if state.error is None else f"Scan failed: {state.error}", file=out, flush=True)
    return state.report, state.error is not None


def run(pages: DataFrame, source: TextIO, out: TextIO) -> str | None:
    """Commands from ``source``, one a line, until ``q`` or its end, or the address that is to be scanned next. ``pages``
    are a finished run's, nested."""
    issues, view = issues_of(pages), View()
    while True:
        total, rows = shown(pages, issues, view)
        print(f"\n{total} pages | {view.severity} | by {view.sort}" + (f" | /{view.query}" if view.query else ""), file=out)
        for i, r in enumerate(rows):
            print(f"{i}  {r.depth:>3} {r.status:>4}  {r.issues:<16} {r.title:<24} {r.address}", file=out)
        print(HELP, file=out)
        command = source.readline()
        if not command or command.strip() == "q":
            return None
        command = command.strip()
        if command.startswith("u ") or command == "u":
            return command[1:].strip()
        if command.isdigit() and int(command) < len(rows):
            for r in report.detail(issues, rows[int(command)].page_key).collect():
                print(f"   [{report.MARKS[r.severity]}] {r.message}", file=out)
        view = step(view, command, total)
