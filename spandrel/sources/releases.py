"""The release feed: is there a newer version?"""

from __future__ import annotations

import re
from dataclasses import dataclass
from urllib.parse import urlsplit

TIMEOUT = 5


@dataclass(frozen=True)
class UpdateNotice:
    current: str
    latest: str
    url: str


def parse_version(text: str) -> tuple[int, int, int] | None:
    """Three numbers, after leading v's; None for anything else."""
    parts = text.strip().lstrip("v").split(".")
    if len(parts) != 3 or not all(re.fullmatch(r"\+?[0-9]+", x) for x in parts):
        return None
    return tuple(int(x) for x in parts)


def is_newer(current: str, latest: str) -> bool:
    a, b = parse_version(current), parse_version(latest)
    return a is not None and b is not None and b > a


def feed_url(repository: str) -> str | None:
    """The address of a GitHub repository's latest release; None for other hosts."""
    url = urlsplit(repository)
    parts = [x for x in url.path.split("/") if x]
    if url.hostname != "github.com" or len(parts) < 2:
        return None
    return f"https://api.github.com/repos/{parts[0]}/{parts[1].removesuffix('.git')}/releases/latest"


def check(current: str, endpoint: str, timeout: float = TIMEOUT) -> UpdateNotice | None:
    """The notice of a newer release at ``endpoint``; None whatever goes wrong."""
    from spandrel.sources.http import session

    try:
        with session("application/vnd.github+json").get(endpoint, timeout=timeout) as r:
            r.raise_for_status()
            said = r.json()
        latest, url = said["tag_name"], said["html_url"]
        return UpdateNotice(current, latest.strip().lstrip("v"), url) if is_newer(current, latest) else None
    except Exception:  # noqa: BLE001
        return None


def message(notice: UpdateNotice) -> str:
    return f"Update available: {notice.current} -> {notice.latest} ({notice.url})"
