"""Fetching archives over HTTP with resume; driver-side, with an injected client."""

from __future__ import annotations

import os
import re
import time
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from tidemark.sources.archives import parse_checksum

_RANGE = re.compile(r"bytes (\d+)-\d+/(\d+)")
_TOTAL = re.compile(r"bytes \*/(\d+)")


class TransferError(RuntimeError):
    """The resource cannot be fetched; ``retry`` tells whether another attempt may help."""

    def __init__(self, message: str, retry: bool = False):
        super().__init__(message)
        self.retry = retry


@dataclass
class Transfer:
    """``client.get(url, headers=..., stream=True, timeout=...)`` gives status_code, headers and iter_content."""

    client: Any
    retries: int = 3
    first_wait: float = 1.0
    longest_wait: float = 30.0
    timeout: float = 60.0
    sleep: Callable[[float], None] = time.sleep

    def wait_after(self, attempts: int) -> float:
        return min(self.first_wait * 2 ** (attempts - 1), self.longest_wait)

    def _attempts(self, work: Callable[[], Any]) -> Any:
        for attempt in range(1, self.retries + 2):
            try:
                return work()
            except TransferError as e:
                if not e.retry or attempt > self.retries:
                    raise
                self.sleep(self.wait_after(attempt))

    @staticmethod
    def _refuse(status: int, url: str) -> None:
        if status in (403, 404):
            raise TransferError(f"{url}: status {status}")
        raise TransferError(f"{url}: status {status}", retry=status == 429 or status >= 500)

    def archive(self, url: str, partial: str) -> int:
        """Fetch into ``partial``, going on where it ends; returns its size."""

        def once() -> int:
            have = os.path.getsize(partial) if os.path.exists(partial) else 0
            r = self.client.get(url, headers={"Range": f"bytes={have}-"} if have else {}, stream=True, timeout=self.timeout)
            if r.status_code == 416 and have:
                m = _TOTAL.fullmatch(r.headers.get("Content-Range", ""))
                if m and int(m[1]) == have:
                    return have
                raise TransferError(f"{url}: the partial file does not fit")
            if r.status_code == 206:
                m = _RANGE.fullmatch(r.headers.get("Content-Range", ""))
                if not m or int(m[1]) != have:
                    raise TransferError(f"{url}: the answer starts elsewhere")
            elif r.status_code != 200:
                self._refuse(r.status_code, url)
            with open(partial, "ab" if r.status_code == 206 else "wb") as f:
                for chunk in r.iter_content(1 << 20):
                    f.write(chunk)
            return os.path.getsize(partial)

        return self._attempts(once)

    def checksum(self, url: str, target: str, archive: str) -> str:
        """Fetch a checksum file, check that it belongs to ``archive``, then put it in place."""

        def once() -> str:
            r = self.client.get(url, headers={}, stream=True, timeout=self.timeout)
            if r.status_code != 200:
                self._refuse(r.status_code, url)
            data = b"".join(r.iter_content(1 << 16))
            digest = parse_checksum(data.decode("utf-8"), archive)
            with open(f"{target}.part", "wb") as f:
                f.write(data)
            os.replace(f"{target}.part", target)
            return digest

        return self._attempts(once)
