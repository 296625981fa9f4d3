"""Pinned files from a URL or a local folder: streamed, size and hash checked, retried, renamed at the end."""

from __future__ import annotations

import hashlib
import shutil
import time
import urllib.error
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass
from pathlib import Path
from typing import BinaryIO
from urllib.parse import urlparse

from vitrine.sources.artifacts import file_digest

CHUNK, ATTEMPTS, FIRST_WAIT, MOST_WAIT, REDIRECTS = 1 << 20, 4, 0.5, 8.0, 5


@dataclass(frozen=True)
class PinnedFile:
    name: str
    url: str
    size: int
    sha256: str


class AcquireError(OSError):
    """A file could not be had in its pinned form."""


class _Redirects(urllib.request.HTTPRedirectHandler):
    max_redirections = REDIRECTS

    def redirect_request(self, req, fp, code, msg, headers, newurl):
        if urlparse(req.full_url).scheme == "https" and urlparse(newurl).scheme != "https":
            raise AcquireError(f"refused to leave https for {newurl}")
        return super().redirect_request(req, fp, code, msg, headers, newurl)


def open_url(url: str) -> BinaryIO:
    scheme = urlparse(url).scheme
    if scheme == "file":
        return open(urlparse(url).path, "rb")
    if scheme not in ("http", "https"):
        raise AcquireError(f"no source for {url}")
    return urllib.request.build_opener(_Redirects).open(url, timeout=60)


def acquire(files: list[PinnedFile], root: Path, transport: Callable[[str], BinaryIO] = open_url, sleep: Callable[[float], None] = time.sleep) -> dict[str, str]:
    """Name -> 'reused' or 'downloaded'. A file that is there with the right size and hash is reused."""
    root.mkdir(parents=True, exist_ok=True)
    done = {}
    for f in files:
        target = root / f.name
        if target.exists() and target.stat().st_size == f.size and file_digest(target) == f.sha256:
            done[f.name] = "reused"
            continue
        for attempt in range(ATTEMPTS):
            try:
                _fetch(f, target, transport)
                break
            except (urllib.error.URLError, TimeoutError, ConnectionError) as error:
                if attempt == ATTEMPTS - 1:
                    raise AcquireError(f"{f.url}: {error}") from error
                sleep(min(MOST_WAIT, FIRST_WAIT * 2**attempt))
        done[f.name] = "downloaded"
    return done


def _fetch(f: PinnedFile, target: Path, transport: Callable[[str], BinaryIO]) -> None:
    part, digest, size = target.with_name(target.name + ".part"), hashlib.sha256(), 0
    try:
        with transport(f.url) as source, part.open("wb") as out:
            while block := source.read(CHUNK):
                size += len(block)
                if size > f.size:
                    raise AcquireError(f"{f.name}: more than {f.size} bytes")
                digest.update(block)
                out.write(block)
        if size != f.size or digest.hexdigest() != f.sha256:
            raise AcquireError(f"{f.name}: size or hash differs from its pin")
        shutil.move(part, target)
    finally:
        part.unlink(missing_ok=True)
