"""Where models plug in. Nothing here calls a network: endpoints and keys belong to the client that a user hands over."""

from __future__ import annotations

import time
import zlib
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from typing import Protocol

from quire.functions.replies import KINDS, MARKER


class ModelClient(Protocol):
    def describe(self, images: list[str], context: str) -> str: ...

    def outline(self, image: bytes, examples: list[bytes]) -> str: ...

    def choose(self, title: str, candidates: list[str]) -> str: ...

    def place(self, title: str, lines: list[str]) -> str: ...

    def relate(self, title: str, context: str) -> str: ...


class OcrProvider(Protocol):
    def text(self, image: bytes) -> str: ...


class PageRenderer(Protocol):
    def render(self, pdf: bytes, page: int, scale: float) -> bytes: ...


class PageCutter(Protocol):
    def cut(self, pdf: bytes, pages: list[int]) -> bytes: ...


class TooManyRequests(Exception):
    """A client's word that it was asked too often; `wait` is in seconds."""

    def __init__(self, wait: float = 60.0):
        super().__init__(f"asked too often, wait {wait} s")
        self.wait = wait


class TooLarge(Exception):
    """A client's word that an image was too large."""


def shrunk(image: bytes, encode: Callable[[bytes, int], bytes], most: int, quality: int = 95, step: int = 5, least: int = 5) -> bytes:
    """image as it is if it has at most `most` bytes, else encoded anew at falling quality until it has, or at the least quality."""
    out = image
    while len(out) > most and quality >= least:
        out = encode(image, quality)
        quality -= step
    return out


class OfflineClient:
    """Answers that depend on the request alone, without any model: for tests, and for runs that only need the structure."""

    def describe(self, images: list[str], context: str) -> str:
        kind = KINDS[zlib.crc32("|".join(images).encode()) % len(KINDS)]
        return f"{kind} {len(images)} images, {len(context)} characters of context"

    def outline(self, image: bytes, examples: list[bytes]) -> str:
        """An image that is text is its own outline."""
        return f"{MARKER}\n{image.decode(errors='ignore')}"

    def relate(self, title: str, context: str) -> str:
        held = title in context
        return f'{{"relevant":{str(held).lower()}}}' if context else "no context"

    def text(self, image: bytes) -> str:
        return image.decode(errors="ignore")

    def render(self, pdf: bytes, page: int, scale: float) -> bytes:
        return f"{len(pdf)}:{page}:{scale:g}".encode()

    def cut(self, pdf: bytes, pages: list[int]) -> bytes:
        return pdf + f" without {pages}".encode()

    def choose(self, title: str, candidates: list[str]) -> str:
        return f"选择：{candidates[0]}" if candidates else ""

    def place(self, title: str, lines: list[str]) -> str:
        return "位置：1"


class Fallback:
    """The first client's answer, or the second's where the first fails or says nothing."""

    def __init__(self, first: ModelClient, second: ModelClient):
        self.first, self.second = first, second

    def __getattr__(self, name: str) -> Callable:
        if name.startswith("_") or name in ("first", "second", "client"):  # what pickling asks for
            raise AttributeError(name)

        def call(*args):
            try:
                return getattr(self.first, name)(*args) or getattr(self.second, name)(*args)
            except Exception:  # noqa: BLE001  whatever a client raises, the other is asked
                return getattr(self.second, name)(*args)

        return call


class Retrying:
    """Calls again after a failure, waiting twice as long each time, and as long as it is told where it asked too often.

    A call that takes over `timeout` seconds counts as failed (its thread is left to end by itself). An image that is too large is
    encoded anew with `encode`, to half its size each time; that isn't a failure.
    """

    def __init__(self, client: ModelClient, attempts: int = 3, wait: float = 4.0, most: float = 10.0, timeout: float | None = None, encode: Callable[[bytes, int], bytes] | None = None):
        self.client, self.attempts, self.wait, self.most, self.timeout, self.encode = client, attempts, wait, most, timeout, encode

    def __getattr__(self, name: str) -> Callable:
        if name.startswith("_") or name in ("first", "second", "client"):  # what pickling asks for
            raise AttributeError(name)
        call = getattr(self.client, name)

        def timed(*args):
            if self.timeout is None:
                return call(*args)
            pool = ThreadPoolExecutor(1)
            try:
                return pool.submit(call, *args).result(self.timeout)
            finally:
                pool.shutdown(wait=False)

        def again(*args):
            failures, args = 0, list(args)
            while True:
                try:
                    return timed(*args)
                except TooLarge:
                    if not self.encode or not args or not isinstance(args[0], bytes):
                        raise
                    smaller = shrunk(args[0], self.encode, len(args[0]) // 2)
                    if len(smaller) >= len(args[0]):
                        raise
                    args[0] = smaller
                except Exception as error:  # noqa: BLE001
                    failures += 1
                    if failures == self.attempts:
                        raise
                    time.sleep(error.wait if isinstance(error, TooManyRequests) else min(self.most, self.wait * 2 ** (failures - 1)))

        return again
