"""Checks of what callers pass in, and the errors they raise."""

from __future__ import annotations

import re
from urllib.parse import urlsplit

from webmill.operators.queue import STATES

JOB_STATES = ("pending", "running", "paused", "completed", "failed", "cancelled")
METHODS = ("GET", "POST", "PUT", "DELETE", "PATCH", "HEAD", "OPTIONS")


class WebmillError(Exception):
    """Any error of this library that a caller may want to catch."""


class InvalidInput(WebmillError, ValueError):
    """A value out of its bounds; the message names all that is wrong."""


class NotFound(WebmillError, KeyError):
    """No such job, crawl or session."""


class AlreadyRunning(WebmillError):
    """A crawl of the same host runs."""


class RequestFailed(WebmillError):
    """A request that could not be carried out: url, and why."""

    def __init__(self, url: str, why: str, status: int | None = None):
        super().__init__(f"{url}: {why}" + ("" if status is None else f" ({status})"))
        self.url, self.why, self.status = url, why, status


class OutOfRetries(RequestFailed):
    """A request that failed as often as it may."""


class Disallowed(RequestFailed):
    """A request that its host's robots file rules out."""


class TimedOut(RequestFailed):
    """A request that took longer than it may."""


def failures(requests: list) -> list[RequestFailed]:
    """Errors of requests that ended badly, for whoever wants to raise or show them; rows as a crawl's `failed` hook has them."""
    kinds = {"failed": (OutOfRetries, "out of retries"), "blocked": (Disallowed, "disallowed by the robots file")}
    return [kinds[r.state][0](r.url, kinds[r.state][1]) for r in requests if r.state in kinds]


def message_of(error: object) -> str:
    return str(error) if isinstance(error, BaseException) else "Unknown error" if error is None else str(error)


def request(url: str, method: str = "GET", max_retries: int = 3, state: str = "pending") -> None:
    wrong = []
    if not re.match(r"(?i)https?://[^/\s]+", url or "") or not urlsplit(url).hostname:
        wrong.append(f"url: not a URL: {url!r}")
    if method not in METHODS:
        wrong.append(f"method: none of {', '.join(METHODS)}")
    if max_retries < 0:
        wrong.append("max_retries: below 0")
    if state not in STATES:
        wrong.append(f"state: none of {', '.join(STATES)}")
    if wrong:
        raise InvalidInput("; ".join(wrong))


def job_filter(status: str | None = None, page: int = 1, size: int = 20) -> None:
    wrong = []
    if status is not None and status not in JOB_STATES:
        wrong.append(f"status: none of {', '.join(JOB_STATES)}")
    if page < 1:
        wrong.append("page: below 1")
    if not 1 <= size <= 100:
        wrong.append("size: not 1 to 100")
    if wrong:
        raise InvalidInput("; ".join(wrong))


def start_crawl(url: str, max_pages: int | None = 100, max_depth: int | None = 5, agents: int = 5, page_delay_ms: int = 100, title: str | None = None) -> None:
    """What a crawl is started with; all that is wrong is told at once."""
    wrong = []
    if not re.match(r"(?i)https?://[^/\s]+", url or "") or not urlsplit(url).hostname:
        wrong.append(f"url: not a URL: {url!r}")
    if max_pages is not None and max_pages < 1:
        wrong.append("max_pages: below 1")
    if max_depth is not None and max_depth < 0:
        wrong.append("max_depth: below 0")
    if not 1 <= agents <= 20:
        wrong.append("agents: not 1 to 20")
    if page_delay_ms < 0:
        wrong.append("page_delay_ms: below 0")
    if title is not None and not title.strip():
        wrong.append("title: blank")
    if wrong:
        raise InvalidInput("; ".join(wrong))


def job_update(status: str | None = None, title: str | None = None) -> None:
    wrong = []
    if status is None and title is None:
        wrong.append("nothing to change")
    if status is not None and status not in JOB_STATES:
        wrong.append(f"status: none of {', '.join(JOB_STATES)}")
    if title is not None and not title.strip():
        wrong.append("title: blank")
    if wrong:
        raise InvalidInput("; ".join(wrong))
