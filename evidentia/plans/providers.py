"""Interfaces of model calls and deterministic stubs.  A real model is a subclass with the same batch methods."""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


class Embedder(Protocol):
    def embed(self, texts: Sequence[str]) -> list[list[float]]: ...


class Judge(Protocol):
    name: str

    def chat(self, prompts: Sequence[str]) -> list[str]: ...


class HashEmbedder:
    """Unit vectors from a digest of the text."""

    def __init__(self, size: int = 64) -> None:
        self.size = size

    def embed(self, texts: Sequence[str]) -> list[list[float]]:
        out = []
        for text in texts:
            row = np.frombuffer(hashlib.shake_128((text or "").encode()).digest(self.size), np.uint8) / 127.5 - 1
            out.append((row / (np.sqrt((row * row).sum()) or 1.0)).tolist())
        return out


class HashJudge:
    """Scores of the five judged metrics from a digest of judge and prompt."""

    def __init__(self, name: str) -> None:
        self.name = name

    def chat(self, prompts: Sequence[str]) -> list[str]:
        out = []
        for prompt in prompts:
            raw = hashlib.sha256(f"{self.name}|{prompt}".encode()).digest()
            body = {m: {"score": raw[i] / 255, "confidence": raw[i + 8] / 255} for i, m in enumerate(("ESS", "ECS", "CMS", "LCS", "HLS"))}
            out.append(f"<json>{json.dumps(body)}</json>")
        return out


def retry(call: Callable, tries: int = 3, wait: Callable[[int], float] = lambda a: 0.5 * a):
    """Call again after an exception, up to ``tries`` times, waiting between; the last exception is raised."""
    for attempt in range(1, tries + 1):
        try:
            return call()
        except Exception:
            if attempt == tries:
                raise
            time.sleep(wait(attempt))


def replies(model: Judge, prompts: Sequence[str], batch: int = 16) -> list[str | None]:
    """A reply to each prompt.  Prompts go in small batches; where a batch fails, each of its prompts goes by itself, and
    only the one that fails has no reply."""
    out: list[str | None] = []
    for at in range(0, len(prompts), batch):
        part = list(prompts[at : at + batch])
        try:
            out += retry(lambda: model.chat(part))  # noqa: B023
        except Exception:
            for one in part:
                try:
                    out += retry(lambda: model.chat([one])) if len(part) > 1 else [None]  # noqa: B023
                except Exception:  # this call is lost, others are not
                    out.append(None)
    return out


def with_embeddings(df: DataFrame, column: str, embedder: Embedder, batch: int = 32, threads: int = 8, name: str = "embedding") -> DataFrame:
    """Adds vectors: batches of texts, several in flight per task, each retried."""
    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + f", {name} array<float>"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(threads) as pool:
            for frame in frames:
                texts = frame[column].fillna("").tolist()
                parts = [texts[i : i + batch] for i in range(0, len(texts), batch)]
                vectors = [v for got in pool.map(lambda p: retry(lambda: embedder.embed(p)), parts) for v in got]
                yield frame.assign(**{name: vectors})

    return df.mapInPandas(run, shape)


def vectors(embedder: Embedder, texts: Sequence[str], wait: Callable[[int], float] = lambda a: 0.5 * a) -> list[tuple[list[float] | None, str | None]]:
    """A vector or an error for each text.  A batch that fails, after retries, goes again text by text."""
    try:
        return [(v, None) for v in retry(lambda: embedder.embed(texts), wait=wait)]
    except Exception as e:
        if len(texts) == 1:
            return [(None, f"{type(e).__name__}: {e}"[:500])]
    return [vectors(embedder, [t], wait)[0] for t in texts]


def tried_embeddings(df: DataFrame, column: str, embedder: Embedder, batch: int = 32, threads: int = 8, name: str = "embedding", wait: Callable[[int], float] = lambda a: 0.5 * a) -> DataFrame:
    """Adds vectors and ``error``: a text whose call fails three times has an error, and costs no other text its vector."""
    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + f", {name} array<float>, error string"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(threads) as pool:
            for frame in frames:
                texts = frame[column].fillna("").tolist()
                parts = [texts[i : i + batch] for i in range(0, len(texts), batch)]
                got = [x for found in pool.map(lambda p: vectors(embedder, p, wait), parts) for x in found]
                yield frame.assign(**{name: [v for v, _ in got], "error": [e for _, e in got]})

    return df.mapInPandas(run, shape)


def with_replies(df: DataFrame, prompt: str, judges: Sequence[Judge], threads: int = 8) -> DataFrame:
    """One row per row and judge, with its reply; a call that fails after retries gives a null reply, which the ensemble
    counts as a failed judge."""
    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + ", judge string, reply string"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(threads) as pool:
            for frame in frames:
                prompts = frame[prompt].fillna("").tolist()
                for judge, got in zip(judges, pool.map(lambda j: replies(j, prompts), judges), strict=True):
                    yield frame.assign(judge=judge.name, reply=got)

    return df.mapInPandas(run, shape)
