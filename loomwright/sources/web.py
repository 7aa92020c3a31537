"""A client that fetches pages of shops: its agent changes, it waits for a bounded time and follows redirects."""

from __future__ import annotations

import http.client
import random
import ssl
import urllib.error
import urllib.request
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from urllib.parse import urlsplit

#: Browsers that the client may pass for; a caller gives its own.
AGENTS = ("Mozilla/5.0 (X11; Linux x86_64; rv:128.0) Gecko/20100101 Firefox/128.0", "Mozilla/5.0 (Windows NT 10.0; Win64; x64; rv:128.0) Gecko/20100101 Firefox/128.0")


@dataclass(frozen=True)
class Page:
    """A page and the address that it came from in the end."""

    url: str
    html: str


@dataclass(frozen=True)
class WebClient:
    """Fetches one page a call; goes to tasks as it is.

    cookies: for a part of an address the cookies that pages there are asked with. suffix: what is added to each address.
    A page that does not answer with 200 is null. If it was redirected, the address it led to is asked once more, with the
    suffix. Time-outs and broken connections are OSErrors, so fetch_pages tries again. The agent is drawn by the address
    and the try, so a task that runs again asks in the same way.
    """

    agents: Sequence[str] = AGENTS
    timeout: float = 10.0
    suffix: str = ""
    cookies: Mapping[str, Mapping[str, str]] = field(default_factory=dict)
    verify: bool = True

    def __call__(self, url: str, nth: int = 1) -> Page | None:
        if urlsplit(url).scheme not in ("http", "https"):
            return None
        headers = {"Referer": url, "User-Agent": random.Random(f"{url} {nth}").choice(list(self.agents))}
        own = {k: v for part, values in self.cookies.items() if part in url for k, v in values.items()}
        if own:
            headers["Cookie"] = "; ".join(f"{k}={v}" for k, v in own.items())
        got, at = self._get(url + self.suffix, headers)
        if got is None and at not in (None, url + self.suffix):
            got, _ = self._get(at + self.suffix, headers)
        return got

    def _get(self, url: str, headers: dict[str, str]) -> tuple[Page | None, str | None]:
        """The page, or null and the address that the request ended at."""
        safe = ssl.create_default_context()
        if not self.verify:
            safe.check_hostname, safe.verify_mode = False, ssl.CERT_NONE
        opener = urllib.request.build_opener(urllib.request.HTTPSHandler(context=safe))
        try:
            with opener.open(urllib.request.Request(url, headers=headers), timeout=self.timeout) as answer:
                body = answer.read()
                if answer.status != 200:
                    return None, answer.url
                return Page(answer.url, body.decode(self._charset(answer), "replace")), answer.url
        except urllib.error.HTTPError as e:
            return None, e.url
        except http.client.HTTPException as e:
            raise ConnectionError(str(e)) from e

    @staticmethod
    def _charset(answer: http.client.HTTPResponse) -> str:
        name = answer.headers.get_content_charset() or "utf-8"
        try:
            "".encode(name)
        except LookupError:
            return "utf-8"
        return name
