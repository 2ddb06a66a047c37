"""Embedding providers, and embedding items in batches on the executors."""

from __future__ import annotations

import hashlib
import json
import math
import urllib.error
import urllib.request
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from typing import Any, Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.vector import Identity
from tessera.sources.schema import EMBEDDING


class ProviderError(RuntimeError):
    pass


class Provider(Protocol):
    identity: Identity
    batch_size: int

    def embed(self, texts: Sequence[str]) -> list[list[float]]: ...


Post = Callable[[str, dict[str, str], dict[str, Any], float], Any]


def http_post(url: str, headers: dict[str, str], body: dict[str, Any], timeout: float) -> Any:
    request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json", **headers})
    try:
        with urllib.request.urlopen(request, timeout=timeout) as answer:
            return json.loads(answer.read())
    except (urllib.error.URLError, TimeoutError, ValueError) as x:
        raise ProviderError(f"embedding request failed: {type(x).__name__}") from x


def authorization(key: str) -> str:
    """The header's value; a key that names its scheme stays as it is."""
    key = key.strip()
    return key if " " in key else f"Bearer {key}"


@dataclass
class HashProvider:
    """Deterministic vectors from hashed words; needs no network."""

    identity: Identity = Identity("hash", "words", 32)
    batch_size: int = 64

    def embed(self, texts: Sequence[str]) -> list[list[float]]:
        out = []
        for text in texts:
            v = [0.0] * self.identity.dimension
            for word in text.lower().split():
                h = hashlib.blake2b(word.encode(), digest_size=8).digest()
                v[int.from_bytes(h[:4], "little") % len(v)] += 1 if h[4] & 1 else -1
            norm = math.sqrt(sum(x * x for x in v)) or 1.0
            out.append([x / norm for x in v])
        return out


@dataclass
class BatchProvider:
    """One request for each batch; answers come with their index."""

    identity: Identity
    base_url: str
    api_key: str = field(repr=False)
    batch_size: int = 10
    timeout: float = 60.0
    post: Post = http_post

    def embed(self, texts: Sequence[str]) -> list[list[float]]:
        body = {"model": self.identity.model, "input": list(texts), "dimensions": self.identity.dimension}
        answer = self.post(f"{self.base_url.rstrip('/')}/embeddings", {"Authorization": authorization(self.api_key)}, body, self.timeout)
        try:
            rows = sorted(answer["data"], key=lambda r: int(r["index"]))
            return _checked([[float(x) for x in r["embedding"]] for r in rows], len(texts), self.identity)
        except (KeyError, TypeError) as x:
            raise ProviderError("embedding answer has another shape") from x


@dataclass
class SingleProvider:
    """One request for each text; the vector is searched in the answer."""

    identity: Identity
    base_url: str
    api_key: str = field(repr=False)
    batch_size: int = 1
    timeout: float = 60.0
    post: Post = http_post

    def embed(self, texts: Sequence[str]) -> list[list[float]]:
        out = []
        for text in texts:
            body = {"model": self.identity.model, "messages": [{"role": "user", "content": text}]}
            vector = find_vector(self.post(f"{self.base_url.rstrip('/')}/infer", {"Authorization": authorization(self.api_key)}, body, self.timeout))
            if vector is None:
                raise ProviderError("embedding answer has another shape")
            out.append(vector)
        return _checked(out, len(texts), self.identity)


def _checked(vectors: list[list[float]], count: int, identity: Identity) -> list[list[float]]:
    if len(vectors) != count:
        raise ProviderError(f"{len(vectors)} vectors for {count} texts")
    for v in vectors:
        if len(v) != identity.dimension:
            raise ProviderError(f"vector of {len(v)} from {identity.provider}/{identity.model} of {identity.dimension}")
    return vectors


#: fixed value: where an answer may hold its vector, in this order
PLACES = (("embedding",), ("vector",), ("embeddings",), ("vectors",), ("choices", 0, "message", "content"), ("data",), ("output",), ("result",))


def find_vector(answer: Any) -> list[float] | None:
    """The first list of numbers at the known places, also within JSON strings and lists of one."""
    if isinstance(answer, str):
        try:
            return find_vector(json.loads(answer)) if answer.strip() else None
        except ValueError:
            return None
    if isinstance(answer, list):
        if answer and all(isinstance(x, (int, float)) for x in answer):
            return [float(x) for x in answer]
        return find_vector(answer[0]) if len(answer) == 1 else None
    if isinstance(answer, dict):
        for place in PLACES:
            at = answer
            for step in place:
                at = at.get(step) if isinstance(at, dict) else at[0] if isinstance(at, list) and at and step == 0 else None
            if at is not None and (found := find_vector(at)) is not None:
                return found
    return None


def embedded(items: DataFrame, provider: Provider) -> DataFrame:
    """EMBEDDING rows of the items: title, summary and content, by lines, in requests of batch_size."""
    if provider.batch_size <= 0:
        raise ValueError("batch_size must be positive")
    who, size = provider.identity, provider.batch_size

    def run(batches):
        for pdf in batches:
            for lo in range(0, len(pdf), size):
                part = pdf.iloc[lo : lo + size]
                vectors = _checked(provider.embed(part["text"].tolist()), len(part), who)
                yield pd.DataFrame({"repo": part["repo"], "item_id": part["id"], "provider": who.provider, "model": who.model, "dimension": who.dimension, "embedding": vectors})

    text = F.concat_ws("\n", *[F.coalesce(c, F.lit("")) for c in ("title", "summary", "content")])
    return items.select("repo", "id", text.alias("text")).mapInPandas(run, EMBEDDING)
