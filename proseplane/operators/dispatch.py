"""Calls to a provider as a worker makes them: paced, tried again by kind of error, split where a prompt is too long."""

from __future__ import annotations

import fcntl
import hashlib
import math
import os
import re
import struct
import tempfile
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from proseplane.functions.batches import of_texts
from proseplane.operators.polish import ContextLimitError, Provider, ProviderTimeout, RateLimitError


@dataclass(frozen=True)
class Limits:
    #: Calls a second that the workers of one executor make together, and how many at once after a rest; 0: no limit.
    per_second: float = 0.0
    burst: int = 1
    #: Calls of one prompt at most, and the first wait in seconds, by kind of error; a kind that is not here ends at once.
    retries: dict[type[Exception], tuple[int, float]] = field(default_factory=lambda: {RateLimitError: (6, 1.0), ProviderTimeout: (3, 0.5)})
    longest_wait: float = 60.0
    #: Characters of a prompt at most; 0: only what the provider itself refuses is split, in two.
    context: int = 0


@dataclass(frozen=True)
class Outcome:
    answer: str | None
    error: str | None
    calls: int
    parts: int


class Bucket:
    """A token bucket that the processes of one machine share through a small file, under a lock."""

    def __init__(self, name: str, per_second: float, burst: int, folder: str | None = None, now: Callable[[], float] = time.time, sleep: Callable[[float], None] = time.sleep) -> None:
        self.path = os.path.join(folder or tempfile.gettempdir(), f"proseplane-{hashlib.sha256(name.encode()).hexdigest()[:24]}.bucket")
        self.rate, self.burst, self.now, self.sleep = per_second, max(burst, 1), now, sleep

    def take(self) -> float:
        """Waits for a token; the seconds waited."""
        if self.rate <= 0:
            return 0.0
        with open(self.path, "a+b") as f:
            fcntl.flock(f, fcntl.LOCK_EX)
            f.seek(0)
            kept, now = f.read(16), self.now()
            tokens, at = struct.unpack("<dd", kept) if len(kept) == 16 else (float(self.burst), now)
            tokens = min(float(self.burst), tokens + max(now - at, 0) * self.rate) - 1  # below 0: a debt that others queue behind
            f.seek(0)
            f.truncate()
            f.write(struct.pack("<dd", tokens, now))
        wait = max(-tokens / self.rate, 0.0)
        if wait:
            self.sleep(wait)
        return wait


_FRAME = re.compile(r"\A(.*?## Article\n)(.*)(\n\nReturn[^\n]*\n?)\Z", re.DOTALL)
_BREAKS = ("\n\n", "\n", ". ", " ")


def pieces(text: str, most: int) -> list[str]:
    """text in parts of at most `most` characters, cut behind paragraphs, lines, sentences or words where it can be.

    Parts are of like size; joined they are the text.
    """
    out = []
    while len(text) > most:
        size = math.ceil(len(text) / math.ceil(len(text) / most))
        least = size * 3 // 4
        ends = (text.rfind(b, least, size) + len(b) for b in _BREAKS)
        cut = next((e for e in ends if least < e <= size), size)
        out.append(text[:cut])
        text = text[cut:]
    return [*out, text]


def prompts_of(prompt: str, most: int) -> list[str]:
    """A prompt as shorter ones: the article is cut, what stands before and behind it is in each."""
    m = _FRAME.match(prompt)
    head, article, tail = m.groups() if m else ("", prompt, "")
    room = most - len(head) - len(tail)
    if room < 1:
        return [prompt]
    return [head + p + tail for p in pieces(article, room)]


class Dispatcher:
    """Asks one provider within its limits."""

    def __init__(self, provider: Provider, limits: Limits = Limits(), bucket: Bucket | None = None, sleep: Callable[[float], None] = time.sleep) -> None:
        self.provider, self.limits, self.sleep = provider, limits, sleep
        self.bucket = bucket or Bucket(provider.identity, limits.per_second, limits.burst)

    def _wait(self, prompt: str, kind: tuple[int, float], call: int, error: Exception) -> float:
        """Twice as long each time, as long as the error asks for at least, and not in step with other prompts."""
        spread = int(hashlib.sha256(f"{call}:{prompt}".encode("utf-8", "surrogatepass")).hexdigest()[:8], 16) / 2**32
        wait = kind[1] * 2 ** (call - 1) * (0.5 + spread / 2)
        return min(max(wait, float(getattr(error, "retry_after", 0) or 0)), self.limits.longest_wait)

    def _one(self, prompt: str) -> tuple[str | None, Exception | None, int]:
        calls = 0
        while True:
            self.bucket.take()
            calls += 1
            try:
                return self.provider.call(prompt), None, calls
            except Exception as e:  # noqa: BLE001
                kind = next((v for k, v in self.limits.retries.items() if isinstance(e, k)), None)
                if kind is None or calls >= kind[0]:
                    return None, e, calls
                self.sleep(self._wait(prompt, kind, calls, e))

    def __call__(self, prompt: str) -> Outcome:
        """A part that fails makes the whole fail, so that no answer lacks a piece; its error is told."""
        context = self.limits.context
        todo = prompts_of(prompt, context) if context and len(prompt) > context else [prompt]
        answers, calls, parts = [], 0, 0
        while todo:
            part = todo.pop(0)
            answer, error, n = self._one(part)
            calls += n
            if isinstance(error, ContextLimitError):
                shorter = prompts_of(part, max(len(part) * 3 // 4, 1))
                if len(shorter) > 1 and max(map(len, shorter)) < len(part):
                    todo = shorter + todo
                    continue
            if error is not None:
                return Outcome(None, f"{type(error).__name__}: {error}", calls, parts + 1)
            answers.append(answer or "")
            parts += 1
        return Outcome("".join(answers), None, calls, parts)


def dispatched(provider: Provider, prompt: Column, limits: Limits = Limits()) -> Column:
    """struct<answer, error, calls, parts> of a column of prompts; null prompts are empty ones. No row fails another."""

    @F.arrow_udf("answer string, error string, calls int, parts int")
    def ask(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        asked = Dispatcher(provider, limits)
        for batch in batches:
            for part in of_texts(batch):
                rows = [asked(p or "") for p in part.to_pylist()]
                kinds = {"answer": pa.string(), "error": pa.string(), "calls": pa.int32(), "parts": pa.int32()}
                yield pa.StructArray.from_arrays([pa.array([getattr(r, c) for r in rows], kind) for c, kind in kinds.items()], list(kinds))

    return ask(prompt)
