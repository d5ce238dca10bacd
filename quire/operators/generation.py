"""Prompts and answers: breadcrumbs, chat messages, the request, and its JSON."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass
from os import environ
from urllib import request

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.functions.lexicon import SYSTEM_PROMPT


def breadcrumb(path: Column, title: Column, section: Column, subsection: Column) -> Column:
    def named(parts):
        return F.filter(parts, lambda x: x.isNotNull() & (x != ""))

    parts = F.when(F.size(F.coalesce(path, F.array().cast("array<string>"))) > 0, named(path)).otherwise(named(F.array(title, section, subsection)))
    line = F.array_join(parts, " > ")
    return F.when(line == "", "[Dokumen]").otherwise(F.concat(F.lit("["), line, F.lit("]")))


def context_block(crumb: Column, chunk_type: Column, content: Column) -> Column:
    table = F.coalesce(chunk_type == "table", F.lit(False))
    return F.concat(crumb, F.lit("\n"), F.when(table, "Tabel Referensi:\n").otherwise(""), F.coalesce(content, F.lit("")))


def joined_context(df: DataFrame, key: str, position: str, block: Column) -> DataFrame:
    """(key, context): blocks of each key in order, a blank line between."""
    got = df.groupBy(key).agg(F.sort_array(F.collect_list(F.struct(F.col(position), block.alias("b")))).alias("s"))
    return got.select(key, F.array_join(F.transform("s", lambda x: x["b"]), "\n\n").alias("context"))


def messages(question, context, prompt: str = SYSTEM_PROMPT) -> Column:
    system = F.concat(F.lit(prompt + "\n\nKonteks Resmi:\n"), F.coalesce(F.col(context), F.lit("")))
    return F.array(
        F.struct(F.lit("system").alias("role"), system.alias("content")), F.struct(F.lit("user").alias("role"), F.col(question).alias("content"))
    )


@dataclass(frozen=True)
class ChatClient:
    """An endpoint for chat completions; ``by_prefix`` chooses the base URL from the key's prefix."""

    api_key: str
    base_url: str
    model: str
    timeout: int = 60

    @classmethod
    def from_env(cls, by_prefix: dict[str, str], default_url: str, model: str) -> ChatClient:
        key = environ.get("CHAT_API_KEY")
        if not key:
            raise RuntimeError("CHAT_API_KEY is required")
        url = environ.get("CHAT_BASE_URL") or next((u for p, u in by_prefix.items() if key.startswith(p)), default_url)
        return cls(key, url, environ.get("CHAT_MODEL", model))

    def payload(self, chat: list[dict]) -> dict:
        return {"model": self.model, "messages": chat, "temperature": 0.0, "max_tokens": 800, "response_format": {"type": "json_object"}}

    def post(self, chat: list[dict]) -> str:
        """Content of the reply; the default transport."""
        req = request.Request(
            f"{self.base_url.rstrip('/')}/chat/completions",
            json.dumps(self.payload(chat)).encode(),
            {"api-key": self.api_key, "Content-Type": "application/json"},
        )
        try:
            with request.urlopen(req, timeout=self.timeout) as reply:
                return json.loads(reply.read())["choices"][0]["message"]["content"]
        except request.HTTPError as e:
            if e.code == 401:
                raise RuntimeError(f"401 Unauthorized: check the key and that it belongs to {self.base_url}") from e
            raise


def parse_answer(raw: str | None) -> tuple[str, str | None]:
    """(exact_quote, final_answer) of a strict JSON object; anything else is the answer itself."""
    try:
        got = json.loads(raw or "")
    except ValueError:
        return "", raw
    if not isinstance(got, dict):
        return "", raw
    return got.get("exact_quote", ""), got.get("final_answer", raw)


@F.pandas_udf(T.StructType([T.StructField("exact_quote", T.StringType()), T.StructField("final_answer", T.StringType())]))
def answer_json(raw: pd.Series) -> pd.DataFrame:
    rows = [parse_answer(x) for x in raw]
    return pd.DataFrame([(str(q) if q is not None else None, str(a) if a is not None else None) for q, a in rows], columns=["exact_quote", "final_answer"])


def generate_answers(df: DataFrame, key: str, chat: str, transport: Callable[[list[dict]], str]) -> DataFrame:
    """(key, raw, exact_quote, final_answer): one request a row, through ``transport``."""

    def run(it):
        for pdf in it:
            raw = [transport([{"role": m["role"], "content": m["content"]} for m in c]) for c in pdf[chat]]
            parsed = [parse_answer(x) for x in raw]
            yield pd.DataFrame({key: pdf[key], "raw": raw, "exact_quote": [p[0] for p in parsed], "final_answer": [p[1] for p in parsed]})

    return df.select(key, chat).mapInPandas(run, f"`{key}` {dict(df.dtypes)[key]}, raw string, exact_quote string, final_answer string")
