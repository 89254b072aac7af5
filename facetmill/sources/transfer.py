"""Downloads that go on where they stopped."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from pathlib import Path

#: What a server is asked: method, url, headers. It tells status, headers and blocks of bytes.
Fetch = Callable[[str, str, dict], tuple[int, dict, Iterator[bytes]]]


def fetch_url(method: str, url: str, headers: dict, block: int = 1 << 20, timeout: float = 60.0) -> tuple[int, dict, Iterator[bytes]]:
    import urllib.request

    answer = urllib.request.urlopen(urllib.request.Request(url, headers=headers, method=method), timeout=timeout)

    def blocks() -> Iterator[bytes]:
        with answer:
            while part := answer.read(block):
                yield part

    return answer.status, {k.lower(): v for k, v in answer.headers.items()}, blocks()


def download(url: str, target: str, fetch: Fetch = fetch_url) -> Path:
    """Brings ``target`` to the length the server tells. A complete file is left alone; a part is continued,
    or begun anew where the server sends the whole instead of the rest."""
    path = Path(target)
    path.parent.mkdir(parents=True, exist_ok=True)
    _, told, _ = fetch("HEAD", url, {})
    length = int({k.lower(): v for k, v in told.items()}.get("content-length", 0))
    have = path.stat().st_size if path.exists() else 0
    if length and have >= length:
        return path
    status, _, blocks = fetch("GET", url, {"Range": f"bytes={have}-"} if have else {})
    if status >= 400:
        raise OSError(f"{url}: status {status}")
    with path.open("ab" if have and status == 206 else "wb") as out:
        for part in blocks:
            out.write(part)
    return path
