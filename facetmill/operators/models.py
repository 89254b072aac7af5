"""Model servers behind one function from a text to the model's answer.

Two wire formats are known, a native chat interface and the common completions interface; both take the
answer's JSON schema along. The transport is injected, so nothing here needs a network, and the whole
caller can be pickled to executors.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from facetmill.functions.aspects import MAX_ASPECTS, POLARITIES

#: The schema of an answer.
ANSWER_SCHEMA = {
    "type": "object",
    "properties": {
        "aspects": {
            "type": "array",
            "maxItems": MAX_ASPECTS,
            "items": {
                "type": "object",
                "properties": {"facet": {"type": "string"}, "polarity": {"type": "string", "enum": list(POLARITIES)}, "evidence": {"type": "string"}},
                "required": ["facet", "polarity", "evidence"],
                "additionalProperties": False,
            },
        }
    },
    "required": ["aspects"],
    "additionalProperties": False,
}
NATIVE, COMPLETIONS = "native", "completions"
#: Fields of a request that it can do without, should a server refuse them.
OPTIONAL = ("chat_template_kwargs", "reasoning_effort", "temperature", "think")


class ModelError(RuntimeError):
    """A server's refusal, with its status."""


@dataclass(frozen=True)
class Settings:
    """Where the model is and what it is called; ``served_as`` is its name there, if another."""

    backend: str = NATIVE
    endpoint: str = "http://localhost:11434"
    model: str = ""
    served_as: str = ""
    template_options: dict = field(default_factory=dict)

    @classmethod
    def from_env(cls, prefix: str = "FACETMILL_", env: dict | None = None) -> Settings:
        """Settings from variables named like the fields; template options are a JSON object."""
        env = os.environ if env is None else env
        found = {name: env[prefix + name.upper()] for name in cls.__dataclass_fields__ if env.get(prefix + name.upper())}
        if "template_options" in found:
            found["template_options"] = json.loads(found["template_options"])
        if found.get("backend", NATIVE) not in (NATIVE, COMPLETIONS):
            raise ValueError(f"backend {found['backend']!r} is neither {NATIVE!r} nor {COMPLETIONS!r}")
        return cls(**found)


def unwanted(body: dict, refusal: str) -> set[str]:
    """The optional fields of a request that a refusal names, in full or by their first word."""
    said = set(re.findall(r"[a-z]+(?:_[a-z]+)*", refusal.lower()))
    return {f for f in OPTIONAL if f in body and {f, f.partition("_")[0]} & said}


def post_json(url: str, body: dict, timeout: float = 120.0) -> tuple[int, str]:
    """Status and text of a POST; refusals are returned, not raised."""
    import urllib.error
    import urllib.request

    request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json"})
    try:
        with urllib.request.urlopen(request, timeout=timeout) as answer:
            return answer.status, answer.read().decode()
    except urllib.error.HTTPError as e:
        return e.code, e.read().decode("utf-8", "replace")


@dataclass(frozen=True)
class ChatModel:
    """Callable with a text; ``shots`` are pairs of a user's text and the answer given."""

    settings: Settings
    system: str
    shots: tuple[tuple[str, str], ...] = ()
    post: Callable[[str, dict], tuple[int, str]] = post_json

    def messages(self, text: str) -> list[dict]:
        said = [("system", self.system)]
        for user, answer in self.shots:
            said += [("user", user), ("assistant", answer)]
        return [{"role": role, "content": content} for role, content in [*said, ("user", text)]]

    def request(self, text: str) -> tuple[str, dict]:
        at, name = self.settings.endpoint.rstrip("/"), self.settings.served_as or self.settings.model
        if self.settings.backend == NATIVE:
            body = {"model": self.settings.model, "messages": self.messages(text), "format": ANSWER_SCHEMA, "stream": False, "think": False, "options": {"temperature": 0}}
            return f"{at}/api/chat", body
        form = {"type": "json_schema", "json_schema": {"name": "found_aspects", "strict": True, "schema": ANSWER_SCHEMA}}
        body = {"model": name, "messages": self.messages(text), "temperature": 0, "reasoning_effort": "none", "response_format": form}
        return f"{at}/chat/completions", body | ({"chat_template_kwargs": self.settings.template_options} if self.settings.template_options else {})

    def __call__(self, text: str) -> str:
        url, body = self.request(text)
        status, said = self.post(url, body)
        # A refused request is sent anew without the fields it was refused for; each round drops one at least.
        while 400 <= status < 500 and (drop := unwanted(body, said)):
            body = {k: v for k, v in body.items() if k not in drop}
            status, said = self.post(url, body)
        if not 200 <= status < 300:
            raise ModelError(f"status {status}: {said}")
        answer = json.loads(said)
        return answer["message"]["content"] if self.settings.backend == NATIVE else answer["choices"][0]["message"]["content"]


def each_failure(judged: DataFrame, on_error: Callable[[str, int, str], None]) -> int:
    """Calls ``on_error`` with key and error of every failed row of an extraction's outcomes; how many.
    Rows come to the driver one partition at a time."""
    failed = judged.where(F.col("outcome").isin("failed", "failed_dupes")).select("asin", "review_no", "error")
    number = 0
    for r in failed.toLocalIterator():
        on_error(r["asin"], r["review_no"], r["error"])
        number += 1
    return number
