"""Recognisers as plugins: one instance per partition, run over page images in Arrow batches."""

from __future__ import annotations

import base64
import hashlib
import json
import shlex
import shutil
import subprocess
import urllib.request
from abc import ABC, abstractmethod
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame

SCHEMA = "page_id long, text string, error string"


class Unavailable(RuntimeError):
    """The engine's library or service is not there."""


class Engine(ABC):
    @abstractmethod
    def recognise(self, image: bytes, width: int, height: int) -> str:
        """The engine's raw answer for a page."""

    def fingerprint(self) -> dict[str, str]:
        """What the answers depend on, without secrets."""
        return {"engine": type(self).__name__}

    def close(self) -> None:
        return None


_ENGINES: dict[str, Callable[[], Engine]] = {}


def register(name: str, make: Callable[[], Engine]) -> None:
    _ENGINES[name] = make


def available() -> list[str]:
    return list(_ENGINES)


def engine(name: str | None, default: str = "unlimited") -> Engine:
    key = (name or default).strip().lower()
    if key not in _ENGINES:
        raise ValueError(f"no engine {key!r}; there are {', '.join(_ENGINES)}")
    return _ENGINES[key]()


class ChatEngine(Engine):
    """A recogniser behind a chat-completions address: the page as a PNG in the message, temperature 0, no second try."""

    def __init__(self, base_url: str = "", model: str = "", api_key: str = "", prompt: str = "", max_tokens: int = 32767, timeout: float = 300.0):
        self.base_url, self.model, self.api_key, self.prompt, self.max_tokens, self.timeout = base_url.rstrip("/"), model, api_key, prompt, min(int(max_tokens), 32767), timeout

    def fingerprint(self) -> dict[str, str]:
        key = hashlib.sha256(self.api_key.encode()).hexdigest() if self.api_key else ""
        return {"engine": type(self).__name__, "base_url": self.base_url, "model": self.model, "prompt": self.prompt, "max_tokens": str(self.max_tokens), "key_sha256": key}

    def recognise(self, image: bytes, width: int, height: int) -> str:
        if not self.base_url:
            raise Unavailable("no address is set")
        picture = {"type": "image_url", "image_url": {"url": "data:image/png;base64," + base64.b64encode(image).decode()}}
        body = {"model": self.model, "temperature": 0, "max_tokens": self.max_tokens, "messages": [{"role": "user", "content": [picture, {"type": "text", "text": self.prompt}]}]}
        ask = urllib.request.Request(f"{self.base_url}/chat/completions", json.dumps(body).encode(), {"Content-Type": "application/json", "Authorization": f"Bearer {self.api_key}"})
        with urllib.request.urlopen(ask, timeout=self.timeout) as answer:
            raw = json.load(answer)
        try:
            return raw["choices"][0]["message"]["content"] or ""
        except (KeyError, IndexError, TypeError):
            return ""


class CommandEngine(Engine):
    """A recogniser that is a program on the executor: gives its table of words as text."""

    def __init__(self, lang: str = "eng", psm: str = "", oem: str = "", config: str = "", command: str = "tesseract"):
        self.lang, self.psm, self.oem, self.config, self.command = lang, str(psm), str(oem), config, command

    def fingerprint(self) -> dict[str, str]:
        return {"engine": type(self).__name__, "lang": self.lang, "flags": " ".join(self.flags())}

    def flags(self) -> list[str]:
        """The extra flags, and --psm and --oem where they do not hold them already."""
        given = shlex.split(self.config)
        return given + [x for name, v in (("--psm", self.psm), ("--oem", self.oem)) if v and name not in given for x in (name, v)]

    def recognise(self, image: bytes, width: int, height: int) -> str:
        if shutil.which(self.command) is None:
            raise Unavailable(f"{self.command} is not installed")
        done = subprocess.run([self.command, "stdin", "stdout", "-l", self.lang, *self.flags(), "tsv"], input=image, capture_output=True, timeout=300)
        if done.returncode:
            raise Unavailable(done.stderr.decode("utf-8", "replace").strip()[:500])
        return done.stdout.decode("utf-8", "replace")


# The names recognisers go by (fixed values).
register("unlimited", ChatEngine)
register("tesseract", CommandEngine)
register("generic_openai", ChatEngine)


def configured(name: str | None, overrides: dict[str, str]) -> Engine:
    """An engine with overrides; where it does not take them, one with its defaults."""
    key = (name or "unlimited").strip().lower()
    engine(key)
    try:
        return _ENGINES[key](**overrides)
    except TypeError:
        return _ENGINES[key]()


def recognise(images: DataFrame, make: Callable[[], Engine]) -> DataFrame:
    """``page_id``, ``text``, ``error`` of every row of (``page_id``, ``image``, ``width``, ``height``); a page's failure is its row's, not the job's."""

    def work(batches: Iterator):
        import pandas as pd

        e = make()
        try:
            for pdf in batches:
                rows = []
                for r in pdf.itertuples():
                    try:
                        rows.append((r.page_id, e.recognise(r.image, r.width, r.height), None))
                    except Exception as x:  # an engine may raise anything
                        rows.append((r.page_id, None, f"{type(x).__name__}: {x}"))
                yield pd.DataFrame(rows, columns=["page_id", "text", "error"])
        finally:
            e.close()

    return images.select("page_id", "image", "width", "height").mapInPandas(work, SCHEMA)
