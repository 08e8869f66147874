"""Extension points: extractors, text providers, recognisers and SQL functions."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from importlib import import_module
from typing import Any, Protocol

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Transform = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Plugin:
    """A transform by module and entry point, made when it is asked for."""

    name: str
    module: str
    entrypoint: str
    config: dict[str, Any] = field(default_factory=dict)

    def transform(self) -> Transform:
        return getattr(import_module(self.module), self.entrypoint)(**self.config)


def registry(raw: list[dict[str, Any]]) -> dict[str, Plugin]:
    return {p["name"]: Plugin(p["name"], p["module"], p["entrypoint"], p.get("config") or {}) for p in raw}


class Provider(Protocol):
    """Completes prompts; the null provider gives nothing."""

    def complete(self, prompts: list[str]) -> list[str | None]: ...


class NullProvider:
    def complete(self, prompts: list[str]) -> list[str | None]:
        return [None] * len(prompts)


def completed(df: DataFrame, prompt: str, provider: Provider | None = None) -> DataFrame:
    """``df`` with ``completion``, a batch of prompts at a time."""
    own = provider or NullProvider()

    @F.pandas_udf("string")
    def complete(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for prompts in batches:
            yield pd.Series(own.complete(prompts.tolist()), index=prompts.index, dtype=object)

    return df.withColumn("completion", complete(F.col(prompt)))


def register_functions(spark: SparkSession, key: bytes) -> None:
    """SQL functions kg_nfc and kg_redact, and the table function kg_markdown(text)."""
    from .functions.text import _nfc_function
    from .operators.markdown import tokenise
    from .operators.redaction import redactor

    spark.udf.register("kg_nfc", _nfc_function())
    spark.udf.register("kg_redact", redactor(key))

    class Markdown:
        def eval(self, text: str):
            for k, (kind, level, content, target, line) in enumerate(tokenise(text or "")):
                yield k, kind, level, content, target, line

    spark.udtf.register("kg_markdown", F.udtf(Markdown, returnType="position int, kind string, level int, text string, target string, line int"))
