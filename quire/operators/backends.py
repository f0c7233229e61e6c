"""Engines and models outside Spark: chat-completions servers, generate servers, and commands.

Only the standard library is used. Errors say whether another try may help (``permanent``) and what
would (``remedy``); unknown counts and durations stay None.
"""

from __future__ import annotations

import base64
import json
import socket
import subprocess
import time
from collections.abc import Callable
from dataclasses import dataclass
from urllib import error, request

from quire.operators.cascade import Engine

NANOSECONDS = 1_000_000_000


class ServiceError(Exception):
    """A call of a model server that failed."""

    permanent = False

    def __init__(self, message: str, remedy: str | None = None):
        super().__init__(message)
        self.remedy = remedy


class Unreachable(ServiceError):
    """Nothing answers at the address."""


class TimedOut(ServiceError):
    """The answer took too long."""


class ModelMissing(ServiceError):
    """The server doesn't have the model."""

    permanent = True


class Refused(ServiceError):
    """The server answered, but not with a result; another try won't change it."""

    permanent = True


class Busy(ServiceError):
    """The server failed on its side."""


def _call(url: str, payload: dict | None, timeout: float, key: str | None = None) -> dict:
    """The JSON answer of a POST of ``payload``, or of a GET without one."""
    head = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {key}"} if key else {})
    ask = request.Request(url, None if payload is None else json.dumps(payload).encode(), head)
    try:
        with request.urlopen(ask, timeout=timeout) as answer:
            body = answer.read()
    except error.HTTPError as e:
        said = e.read()[:200].decode("utf-8", "replace")
        if e.code in (401, 403):
            raise Refused(f"{url} rejected the key", "check the key") from e
        if e.code == 404:
            raise ModelMissing(f"{url} has no such model or path", "load the model, or correct its name") from e
        raise (Busy if e.code >= 500 else Refused)(f"{url} returned HTTP {e.code}", said or None) from e
    except (TimeoutError, socket.timeout) as e:
        raise TimedOut(f"{url} did not answer within {timeout:.0f} seconds", "allow more time, or send smaller pages") from e
    except (error.URLError, OSError) as e:
        if isinstance(getattr(e, "reason", None), (TimeoutError, socket.timeout)):
            raise TimedOut(f"{url} did not answer within {timeout:.0f} seconds", "allow more time, or send smaller pages") from e
        raise Unreachable(f"nothing answers at {url}", "start the server and check its address") from e
    try:
        return json.loads(body)
    except ValueError as e:
        raise Refused(f"{url} returned something that is not JSON") from e


@dataclass(frozen=True)
class PageServer:
    """A chat-completions server that reads page images; calls run on the executors."""

    endpoint: str
    model: str
    prompt: str = "Transcribe this page."
    key: str | None = None
    max_tokens: int = 3072
    temperature: float = 0.0
    timeout: float = 300.0

    def read(self, page: dict) -> dict:
        image = base64.b64encode(bytes(page["image"])).decode()
        content = [{"type": "image_url", "image_url": {"url": f"data:image/png;base64,{image}"}}, {"type": "text", "text": self.prompt}]
        asked = {"model": self.model, "messages": [{"role": "user", "content": content}], "max_tokens": self.max_tokens, "temperature": self.temperature, "stream": False}
        found = _call(f"{self.endpoint}/chat/completions", asked, self.timeout, self.key)
        try:
            choice = found["choices"][0]
            text = choice["message"]["content"] or ""
        except (KeyError, IndexError, TypeError) as e:
            raise Refused("the server's answer has another shape", "point the endpoint at a chat-completions API") from e
        usage = found.get("usage") or {}
        return {"text": text, "done_reason": choice.get("finish_reason"), "input_tokens": usage.get("prompt_tokens"), "output_tokens": usage.get("completion_tokens")}

    def health(self) -> tuple[bool, str, str | None]:
        """(available, message, remedy), from the list of models that the server says it serves."""
        try:
            served = [m.get("id", "") for m in _call(f"{self.endpoint}/models", None, 10.0, self.key).get("data", [])]
        except ServiceError as e:
            return False, str(e), e.remedy
        if served and self.model not in served:
            return False, f"the server does not serve {self.model}", f"use one of: {', '.join(served[:5])}"
        return True, f"ready at {self.endpoint}", None

    def engine(self, engine_id: str, name: str, location: str, retries: int = 1) -> Engine:
        return Engine(engine_id, name, self.read, model=self.model, location=location, retries=retries, options={"prompt": self.prompt, "max_tokens": self.max_tokens, "temperature": self.temperature}, health=self.health)


@dataclass(frozen=True)
class Completion:
    text: str
    model: str
    prompt_tokens: int | None = None
    completion_tokens: int | None = None
    total_seconds: float | None = None
    load_seconds: float | None = None
    inference_seconds: float | None = None
    done_reason: str | None = None

    @property
    def truncated(self) -> bool:
        return self.done_reason == "length"

    @property
    def tokens_per_second(self) -> float | None:
        return self.completion_tokens / self.inference_seconds if self.completion_tokens and self.inference_seconds else None


def seconds_of(nanoseconds: object) -> float | None:
    """Nanoseconds as seconds; what is missing, no number or not positive is unknown."""
    ok = isinstance(nanoseconds, int | float) and not isinstance(nanoseconds, bool) and nanoseconds > 0
    return nanoseconds / NANOSECONDS if ok else None


@dataclass(frozen=True)
class ModelServer:
    """A generate server: prompts (and images) to completions."""

    host: str = "http://localhost:11434"
    timeout: float = 300.0

    def models(self) -> list[str]:
        return [m["name"] for m in _call(f"{self.host}/api/tags", None, 10.0).get("models") or [] if m.get("name")]

    def has_model(self, model: str) -> bool:
        """Whether the server has ``model``; a name without a tag means its latest."""
        return bool({model, model if ":" in model else f"{model}:latest"} & set(self.models()))

    def generate(self, model: str, prompt: str, *, system: str | None = None, images: list[bytes] = (), temperature: float = 0.0, top_p: float | None = None, max_tokens: int | None = None) -> Completion:
        options = {"temperature": temperature, "top_p": top_p, "num_predict": max_tokens}
        asked = {"model": model, "prompt": prompt, "stream": False, "options": {k: v for k, v in options.items() if v is not None}}
        asked |= {"system": system} if system else {}
        asked |= {"images": [base64.b64encode(x).decode() for x in images]} if images else {}
        got = _call(f"{self.host}/api/generate", asked, self.timeout)
        return Completion(
            got.get("response") or "", got.get("model", model), got.get("prompt_eval_count"), got.get("eval_count"), seconds_of(got.get("total_duration")), seconds_of(got.get("load_duration")), seconds_of(got.get("eval_duration")), got.get("done_reason")
        )

    def health(self, model: str) -> tuple[bool, str, str | None]:
        try:
            if self.has_model(model):
                return True, f"{model} is ready at {self.host}", None
        except ServiceError as e:
            return False, str(e), e.remedy
        return False, f"{self.host} does not have {model}", f"pull {model}"

    def reader(self, model: str, prompt: str, max_tokens: int | None = None) -> Callable[[dict], dict]:
        """``read`` of an engine that shows page images to ``model``."""

        def read(page: dict) -> dict:
            got = self.generate(model, prompt, images=[bytes(page["image"])], max_tokens=max_tokens)
            return {"text": got.text, "done_reason": got.done_reason, "seconds": got.total_seconds, "input_tokens": got.prompt_tokens, "output_tokens": got.completion_tokens}

        return read

    def engine(self, engine_id: str, name: str, model: str, prompt: str = "Transcribe this page.", max_tokens: int | None = 3072, location: str = "local", retries: int = 1) -> Engine:
        return Engine(engine_id, name, self.reader(model, prompt, max_tokens), model=model, location=location, retries=retries, options={"prompt": prompt, "max_tokens": max_tokens}, health=lambda: self.health(model))


@dataclass(frozen=True)
class CommandReader:
    """A program on the executors that gets a page's image on its standard input and prints its text."""

    command: tuple[str, ...]
    timeout: float = 300.0

    def read(self, page: dict) -> dict:
        began = time.perf_counter()
        try:
            done = subprocess.run(self.command, input=bytes(page["image"]), capture_output=True, timeout=self.timeout, check=False)
        except FileNotFoundError as e:
            raise Refused(f"{self.command[0]} is not installed", f"install {self.command[0]} on every executor") from e
        except subprocess.TimeoutExpired as e:
            raise TimedOut(f"{self.command[0]} took longer than {self.timeout:.0f} seconds", "allow more time") from e
        if done.returncode:
            raise ServiceError(f"{self.command[0]} ended with {done.returncode}: {done.stderr[-200:].decode('utf-8', 'replace').strip()}")
        return {"text": done.stdout.decode("utf-8", "replace"), "done_reason": "stop", "seconds": time.perf_counter() - began}

    def health(self) -> tuple[bool, str, str | None]:
        """Whether the program is there, asked where this is called."""
        import shutil

        found = shutil.which(self.command[0])
        return (True, f"{found} is ready", None) if found else (False, f"{self.command[0]} is not installed", f"install {self.command[0]} on every executor")

    def engine(self, engine_id: str, name: str, retries: int = 0) -> Engine:
        return Engine(engine_id, name, self.read, location="local", retries=retries, options={"command": list(self.command)}, health=self.health)
