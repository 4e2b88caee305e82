"""The command line: ``python -m spandrel.cli https://site.example``."""

from __future__ import annotations

import argparse
import logging
import os
import sys
import threading
from collections.abc import Callable
from dataclasses import replace
from typing import TYPE_CHECKING

from spandrel.functions.urls import is_scan_url
from spandrel.plans.runtime import Bar, LaunchMode, Listener, Terminal, launch_mode
from spandrel.sources.config import Config, RuntimeOptions, resolve

if TYPE_CHECKING:
    from pyspark.sql import DataFrame


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="spandrel", description="Crawl a website with Spark and audit its pages.")
    p.add_argument("url", nargs="?")
    p.add_argument("-d", "--depth", type=int)
    p.add_argument("-m", "--max-pages", type=int)
    how = p.add_mutually_exclusive_group()
    how.add_argument("--cli", action="store_true")
    how.add_argument("--tui", action="store_true")
    p.add_argument("-o", "--output", choices=("text", "json"))
    p.add_argument("-s", "--save")
    p.add_argument("-e", "--external", action="store_true")
    p.add_argument("-v", "--verbose", action="store_true")
    p.add_argument("--ignore-redirects", action="store_true")
    p.add_argument("--keep-fragments", action="store_true")
    p.add_argument("-r", "--rate-limit", type=float)
    p.add_argument("-c", "--concurrency", type=int)
    p.add_argument("--respect-robots-txt", type=lambda x: {"true": True, "false": False}[x.lower()])
    p.add_argument("--config")
    return p


def options_of(argv: list[str]) -> RuntimeOptions:
    p = parser()
    said = vars(p.parse_args(argv))
    if said["tui"] and said["output"]:
        p.error("argument --output: not allowed with argument --tui")
    found = (Config.read(said["config"]), said["config"]) if said["config"] else Config.discover()
    out = resolve(said, found[0] if found else None)
    out.loaded_from = str(found[1]) if found else None
    return out


def init_logging() -> None:
    """To stderr, at the level the application's variable names, else the general one, else not at all."""
    level = os.environ.get("SPANDREL_LOG") or os.environ.get("LOG_LEVEL")
    logging.basicConfig(stream=sys.stderr, level=getattr(logging, level.upper(), logging.INFO) if level else logging.CRITICAL + 1)


def checked_url(options: RuntimeOptions, mode: str) -> str:
    if not options.url:
        raise ValueError(f"A URL is required in {mode} mode")
    if not is_scan_url(options.url):
        raise ValueError("URL must start with http:// or https://")
    return options.url


def main(argv: list[str] | None = None) -> int:
    init_logging()
    try:
        options = options_of(sys.argv[1:] if argv is None else argv)
        mode = launch_mode(options, Terminal.current())
        if mode is not LaunchMode.TUI or options.url:  # the dashboard asks for what is missing
            checked_url(options, mode.value.upper())
        run(options, mode)
    except ValueError as e:
        print(f"Error: {e}", file=sys.stderr)
        return 1
    return 0


def run(options: RuntimeOptions, mode: LaunchMode) -> None:
    from pyspark.sql import SparkSession

    from spandrel.plans.audit import audit_site
    from spandrel.sinks import report
    from spandrel.sources.http import HttpFetcher, HttpProber

    say = lambda text: print(text, file=sys.stderr if mode is LaunchMode.JSON else sys.stdout)
    if options.verbose:
        for line in introduction(options):
            say(line)
    # Fetch tasks must not run twice at once.
    spark = SparkSession.builder.appName("spandrel").config("spark.speculation", "false").getOrCreate()
    notice = newer_release()
    bar = Bar(sys.stderr, options.max_pages)

    def scan(url: str, listen: Listener) -> DataFrame:
        tasks = None if options.rate_limit is None else 1
        fetcher = HttpFetcher(tasks, threads=options.concurrency, rate=options.rate_limit)
        return audit_site(spark, replace(options, url=url), fetcher, HttpProber(threads=max(1, options.concurrency)), listen).pages

    if mode is LaunchMode.TUI:
        from spandrel.plans import dashboard

        pages = dashboard.live(options.url, scan, sys.stdin, sys.stdout)
    else:
        pages = scan(options.url, (lambda kind, value: say(f"{kind}: {value}")) if options.verbose else bar)
    if text := notice():
        print(text, file=sys.stderr)
    if pages is None:
        return
    if mode is LaunchMode.JSON:
        print(report.pretty(pages, options.url))
    elif mode is LaunchMode.TEXT:
        report.print_text(pages, options.url)
    if options.save:
        report.save(pages, options.save, options.url)
        say(f"Report saved to {options.save}")


def introduction(options: RuntimeOptions) -> list[str]:
    """Where the settings come from, and what a run is about to do."""
    return [
        f"Configuration: {options.loaded_from or 'defaults and command line'}",
        f"Scanning {options.url or 'what is asked for'} to depth {options.depth}, at most {options.max_pages} pages, {options.concurrency} requests at once" + (f", {options.rate_limit} a second" if options.rate_limit else ""),
        f"External links {'followed' if options.external else 'not followed'}, fragments {'kept' if options.keep_fragments else 'dropped'}, robots.txt {'respected' if options.respect_robots_txt else 'ignored'}, redirects {'ignored' if options.ignore_redirects else 'reported'}",
    ]


def newer_release(wait: float = 0.5) -> Callable[[], str | None]:
    """Asks for a newer release while the run goes on; the result waits for the answer no longer than ``wait`` seconds."""
    endpoint, found = os.environ.get("SPANDREL_RELEASES"), []
    if not endpoint:
        return lambda: None
    from spandrel import __version__
    from spandrel.sources import releases

    def ask() -> None:
        if notice := releases.check(__version__, endpoint, timeout=5):
            found.append(releases.message(notice))

    thread = threading.Thread(target=ask, daemon=True)
    thread.start()

    def answer() -> str | None:
        thread.join(wait)
        return found[0] if found else None

    return answer


if __name__ == "__main__":
    sys.exit(main())
