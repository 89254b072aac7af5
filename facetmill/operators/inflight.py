"""Calls to slow servers, a bounded number in flight in each task."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import FIRST_COMPLETED, ThreadPoolExecutor, wait
from typing import TypeVar

T, R = TypeVar("T"), TypeVar("R")
#: Items read ahead for each call in flight, so that no caller waits for the next row.
AHEAD = 4


def in_window(items: Iterable[T], call: Callable[[T], R], workers: int) -> Iterator[tuple[T, R | None, Exception | None]]:
    """Each item with its result or exception, as calls finish. ``workers`` calls run at a time; not more
    than ``AHEAD`` times as many items are taken before their results are given out."""
    source, waiting = iter(items), {}
    with ThreadPoolExecutor(max_workers=workers) as pool:
        open_ = True
        while open_ or waiting:
            while open_ and len(waiting) < AHEAD * workers:
                try:
                    item = next(source)
                except StopIteration:
                    open_ = False
                else:
                    waiting[pool.submit(call, item)] = item
            for done in wait(waiting, return_when=FIRST_COMPLETED).done if waiting else ():
                item, error = waiting.pop(done), done.exception()
                if error is not None and not isinstance(error, Exception):
                    raise error
                yield item, None if error else done.result(), error
