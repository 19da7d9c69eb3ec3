"""Places where a caller's own function runs: models, embeddings, file parsers.

The functions run in tasks over Arrow batches. They are arguments, so jobs stay testable
with pure functions; ``make`` arguments build one client per partition.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from reportloom.schemas import CONTENT_LIST_DDL


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def apply_text_model(
    requests: DataFrame,
    make: Callable[[], Callable[..., str]],
    prompt_col: str = "prompt",
    out_col: str = "answer",
    system_prompt: str | None = None,
    **options,
) -> DataFrame:
    """Add the model's answer to each prompt; NULL prompts are not sent."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for pdf in batches:
            answers = [
                None if p is None else model(p, system_prompt=system_prompt, history_messages=[], **options)
                for p in pdf[prompt_col]
            ]
            yield pdf.assign(**{out_col: pd.Series(answers, index=pdf.index, dtype=object)})

    return requests.mapInPandas(run, f"{_ddl(requests)}, `{out_col}` string")


def apply_vision_model(
    requests: DataFrame,
    make_vision: Callable[[], Callable[..., str]] | None,
    make_text: Callable[[], Callable[..., str]],
    prompt_col: str = "prompt",
    image_col: str = "image_base64",
    out_col: str = "answer",
    system_prompt: str | None = None,
) -> DataFrame:
    """As ``apply_text_model`` with an image; without a vision model or image, text only."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        vision = make_vision() if make_vision else None
        text = make_text()
        for pdf in batches:
            answers = []
            for prompt, image in zip(pdf[prompt_col], pdf[image_col]):
                if prompt is None:
                    answers.append(None)
                elif vision is not None and image:
                    answers.append(vision(prompt, system_prompt=system_prompt, image_data=image))
                else:
                    answers.append(text(prompt, system_prompt=system_prompt, history_messages=[]))
            yield pdf.assign(**{out_col: pd.Series(answers, index=pdf.index, dtype=object)})

    return requests.mapInPandas(run, f"{_ddl(requests)}, `{out_col}` string")


def embed_texts(
    rows: DataFrame,
    make: Callable[[], Callable[[list[str]], Iterable]],
    dim: int,
    text_col: str = "text",
    out_col: str = "embedding",
    batch_size: int = 32,
) -> DataFrame:
    """Add a vector of ``dim`` floats per text; the function gets ``batch_size`` texts a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        embed = make()
        for pdf in batches:
            texts = pdf[text_col].tolist()
            vectors = []
            for start in range(0, len(texts), batch_size):
                part = [list(map(float, v)) for v in embed(texts[start : start + batch_size])]
                wrong = [len(v) for v in part if len(v) != dim]
                if wrong or len(part) != len(texts[start : start + batch_size]):
                    raise ValueError(f"embedding function gave {len(part)} vectors, sizes {wrong[:3]}, want {dim}")
                vectors.extend(part)
            yield pdf.assign(**{out_col: pd.Series(vectors, index=pdf.index, dtype=object)})

    return rows.mapInPandas(run, f"{_ddl(rows)}, `{out_col}` array<float>")


def parse_files(
    files: DataFrame,
    make: Callable[[], Callable[[str, bytes], list[dict]]],
    path_col: str = "path",
    content_col: str = "content",
    retries: int = 1,
    wait_seconds: float = 0.5,
) -> DataFrame:
    """(path, ok, error, attempts, duration_sec, n_blocks, items) of a parser run per file.

    A failure is a row, not the end of the job; a file is tried ``retries`` more times.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parse = make()
        for pdf in batches:
            rows = []
            for path, content in zip(pdf[path_col], pdf[content_col]):
                items, error, begun = None, None, time.monotonic()
                for attempt in range(1, retries + 2):
                    try:
                        items, error = parse(path, content), None
                        break
                    except Exception as exc:
                        error = str(exc) or type(exc).__name__
                        if attempt <= retries:
                            time.sleep(wait_seconds)
                rows.append(
                    (path, items is not None, error, attempt, time.monotonic() - begun, len(items or []), items)
                )
            yield pd.DataFrame(
                rows, columns=["path", "ok", "error", "attempts", "duration_sec", "n_blocks", "items"]
            )

    schema = (
        "path string, ok boolean, error string, attempts int, duration_sec double, n_blocks int, "
        f"items {CONTENT_LIST_DDL}"
    )
    return files.select(path_col, content_col).mapInPandas(run, schema)


def with_call_key(requests: DataFrame, model_col: str = "model", prompt_col: str = "prompt") -> DataFrame:
    """Add call_key: the hash of model and prompt that answers are stored under."""
    return requests.withColumn("call_key", F.sha2(F.concat_ws("\x1f", model_col, prompt_col), 256))


def answer_misses(
    requests: DataFrame, cache: DataFrame, make: Callable[[], Callable[..., str]], model_col: str = "model", prompt_col: str = "prompt"
) -> DataFrame:
    """(call_key, answer) for calls not in the cache, each distinct call made once.

    Write the result before using it twice: every use of the plan would call the model again.
    """
    keyed = with_call_key(requests, model_col, prompt_col).select("call_key", prompt_col)
    # Repeated prompts fold before the shuffle, then known ones drop out.
    distinct = keyed.groupBy("call_key").agg(F.first(prompt_col).alias(prompt_col))
    misses = distinct.join(cache.select("call_key"), "call_key", "left_anti")
    return apply_text_model(misses, make, prompt_col).select("call_key", "answer")


def cached_model_calls(
    requests: DataFrame, cache: DataFrame, make: Callable[[], Callable[..., str]], model_col: str = "model", prompt_col: str = "prompt"
) -> DataFrame:
    """Requests with their answer and ``from_cache``; the model sees only unknown calls."""
    fresh = answer_misses(requests, cache, make, model_col, prompt_col)
    answers = cache.select("call_key", "answer", F.lit(True).alias("from_cache")).unionByName(
        fresh.withColumn("from_cache", F.lit(False))
    )
    return with_call_key(requests, model_col, prompt_col).join(answers, "call_key", "left")
