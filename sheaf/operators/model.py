"""Model calls as an operator with a pluggable function.

The function takes a prompt and gives a text. The default is deterministic and
reads the prompt only, so results repeat; a network model is the caller's to
pass in. Each partition makes its own client; failures become rows.
"""

from __future__ import annotations

import json
import re
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheaf.session import small

ModelFn = Callable[[str], str]

# Aspects with the characters of text each prompt takes at most.
ASPECTS = {"features": 80_000, "summary": 80_000, "benefits": 60_000, "use_cases": 60_000, "competitive": 60_000, "audience": 60_000, "technical": 50_000, "pricing": 40_000, "name": 2_000}


def stub(prompt: str) -> str:
    """A deterministic answer: the first sentences of the prompt's text as JSON items, titled by their first words."""
    aspect, _, text = prompt.partition("\n")
    found = [s.strip() for s in re.split(r"(?<=[.!?])\s+|\n+", text) if len(s.split()) >= 4]
    items = [{"name": " ".join(s.split()[:4]), "description": s} for s in found[:5]]
    return json.dumps({aspect.strip() or "items": items}, ensure_ascii=False)


def prompts(texts: DataFrame, aspects: list[str] | None = None) -> DataFrame:
    """One prompt per text and aspect: key, aspect, prompt. Texts are cut to the aspect's size before they reach Python; unknown aspects raise."""
    chosen = list(ASPECTS) if aspects is None else aspects
    if unknown := [a for a in chosen if a not in ASPECTS]:
        raise ValueError(f"unknown aspects: {', '.join(unknown)}")
    pairs = F.array(*[F.struct(F.lit(a).alias("aspect"), F.lit(ASPECTS[a]).alias("most")) for a in chosen])
    rows = texts.where("text IS NOT NULL").select("key", "text", F.explode(pairs).alias("x"))
    return rows.select("key", "x.aspect", F.concat(F.col("x.aspect"), F.lit("\n"), F.substring("text", F.lit(1), F.col("x.most"))).alias("prompt"))


def called(rows: DataFrame, make: Callable[[], ModelFn] = lambda: stub, retries: int = 0, wait: float = 0.0) -> DataFrame:
    """Answers of prompts: key, aspect, answer, error, attempts, input_tokens, output_tokens. `make` builds a partition's model function."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ask = make()
        for b in batches:
            out = []
            for k, a, p in zip(b["key"], b["aspect"], b["prompt"]):
                answer, error, n = None, None, 0
                while answer is None and n <= retries:
                    if n and wait:
                        time.sleep(wait * 2 ** (n - 1))
                    n += 1
                    try:
                        answer, error = ask(p), None
                    except Exception as e:  # noqa: BLE001 - a failed call is a row
                        error = f"{type(e).__name__}: {e}"
                out.append((k, a, answer, error, n, len(p) // 4, len(answer or "") // 4))
            yield pd.DataFrame(out, columns=["key", "aspect", "answer", "error", "attempts", "input_tokens", "output_tokens"])

    return rows.select("key", "aspect", "prompt").mapInPandas(run, f"key {rows.schema['key'].dataType.simpleString()}, aspect string, answer string, error string, attempts int, input_tokens int, output_tokens int")


def run_totals(answers: DataFrame) -> DataFrame:
    """Tokens and confidence (share of answered aspects) per key, and whether any aspect was answered."""
    ok = F.count_if(F.col("error").isNull())
    return answers.groupBy("key").agg(F.sum(F.col("input_tokens") + F.col("output_tokens")).alias("tokens"), F.round(ok / F.count(F.lit(1)), 4).alias("confidence"), ok.alias("aspects_ok"))


#: What a product is called if no name can be found, and the characters a name is looked for in.
NAMELESS, NAME_CHARS = "Unknown Product", ASPECTS["name"]


def detected_names(texts: DataFrame, make: Callable[[], ModelFn]) -> DataFrame:
    """Product names found in texts (key, text): key, name. Quotes around an answer are taken off; a failed call gives NAMELESS."""
    asked = called(prompts(texts, ["name"]), make)
    bare = F.regexp_replace(F.regexp_replace(F.trim("answer"), '^"+|"+$', ""), "^'+|'+$", "")
    return asked.select("key", F.coalesce(bare, F.lit(NAMELESS)).alias("name"))


def settled(calls: DataFrame, models: DataFrame, tasks: DataFrame, usual: str) -> DataFrame:
    """Calls (key, task, tokens) with their model: key, model, fits (within its window).

    tasks (task, model) and models (model, window) are the caller's, small; a task
    without a model takes the usual one, a model without a window has none to exceed.
    """
    named = calls.join(small(tasks.select("task", F.col("model").alias("_m"))), "task", "left").withColumn("model", F.coalesce("_m", F.lit(usual)))
    sized = named.join(small(models.select("model", "window")), "model", "left")
    return sized.select("key", "model", F.coalesce(F.col("tokens") <= F.col("window"), F.lit(True)).alias("fits"))
