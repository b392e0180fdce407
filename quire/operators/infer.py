"""Batch model stage: prompts, extractors over chunks, staged providers, and model text to records."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import is_blank
from ..session import cut

KEY_VALUE = r"([A-Za-z一-鿿][A-Za-z一-鿿 ]{0,15})\s*[:：]\s*([^\n,，;；]{1,60})"
NUMBER_UNIT = r"(\d+(?:\.\d+)?)\s*(%|km|kg|USD|元|万元|亿元|人|例)"


def prompt(text: Column, fields: list[str], instruction: str = "", mode: str = "single_record", groups: list[tuple[str, str]] = ()) -> Column:
    """The profile's constant part and the whole text. mode: single_record, table_records, or multi_table, which names the
    groups (filter field, value) that must be covered."""
    one = "Answer with one object." if mode == "single_record" else "Answer with a list of records, one object for each row."
    named = "; ".join(f"{k} = {v}" for k, v in groups if k.strip() and v.strip()) if mode == "multi_table" else ""
    return F.concat(F.lit("\n".join([f"Extract the fields {', '.join(fields)}. {one}", instruction, *([f"Cover all groups: {named}."] if named else []), "Text:", ""])), F.coalesce(text, F.lit("")))


def prompts(chunks: DataFrame, fields: list[str], instruction: str = "", **how) -> DataFrame:
    """Adds prompt to chunks that cover their texts."""
    return chunks.withColumn("prompt", prompt(F.col("text"), fields, instruction, **how))


def rule_records(chunks: DataFrame) -> DataFrame:
    """keys of the chunk, pos, field, value: the deterministic extractor. key: value lines, then numbers with units."""
    keys = F.arrays_zip(F.regexp_extract_all("text", F.lit(KEY_VALUE), F.lit(1)).alias("k"), F.regexp_extract_all("text", F.lit(KEY_VALUE), F.lit(2)).alias("v"))
    pairs = F.transform(keys, lambda x: F.struct(F.trim(x["k"]).alias("field"), F.trim(x["v"]).alias("value")))
    nums = F.arrays_zip(F.regexp_extract_all("text", F.lit(NUMBER_UNIT), F.lit(2)).alias("k"), F.regexp_extract_all("text", F.lit(NUMBER_UNIT), F.lit(1)).alias("v"))
    more = F.transform(nums, lambda x: F.struct(x["k"].alias("field"), x["v"].alias("value")))
    rest = [c for c in chunks.columns if c not in ("text", "type")]
    return chunks.select(*rest, F.posexplode(F.concat(pairs, more)).alias("pos", "x")).select(*rest, "pos", "x.field", "x.value")


def _single(call, prompt: str) -> tuple[str | None, str | None]:
    try:
        return next(iter(call([prompt]))), None
    except Exception as e:  # a provider's failure is data here
        return None, str(e)[:200]


def apply_model(chunks: DataFrame, call: Callable[[Iterable[str]], Iterable[str]], prompt: str = "prompt", keys: tuple[str, ...] = ("doc_id", "chunk_idx")) -> DataFrame:
    """keys, response, error for every chunk. `call` answers a batch of prompts; what it raises becomes a row's error, so
    that a failing call never fails the job. Parallel by partitions; answers are for the caller to key by content."""

    def run(frames):
        for f in frames:
            out, asked = f[list(keys)].copy(), f[prompt].tolist()
            try:
                rows = [(r, None) for r in call(asked)]
                if len(rows) != len(asked):
                    raise ValueError(f"{len(rows)} answers to {len(asked)} prompts")
            except Exception as e:  # a provider's failure is data here; one bad prompt must not fail its batch
                rows = [_single(call, p) for p in asked] if len(asked) > 1 else [(None, str(e)[:200])]
            out["response"], out["error"] = [r for r, _ in rows], [e for _, e in rows]
            yield out.astype({"response": "object", "error": "object"})

    kinds = dict(chunks.dtypes)
    return chunks.select(*keys, prompt).mapInPandas(run, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", response string, error string")


def with_fallback(chunks: DataFrame, calls: list[tuple[str, Callable]], keys: tuple[str, ...] = ("doc_id", "chunk_idx")) -> DataFrame:
    """Every provider in turn gets what all before it failed on, and each prompt once: its answers are written to the
    checkpoint folder before they are used; adds provider."""
    done, todo = None, chunks
    for name, call in calls:
        got = cut(apply_model(todo, call, keys=keys)).withColumn("provider", F.lit(name))
        good = got.where("error IS NULL")
        done = good if done is None else done.unionByName(good)
        todo = todo.join(good.select(*keys), list(keys), "left_anti")
    return done


def second_pass(records: DataFrame, field: str, source: Column, call: Callable, key: str = "record_idx") -> DataFrame:
    """records; where the required field is blank it is asked for again, from `source`, and a failed call leaves it blank."""
    todo = records.where(is_blank(field)).select(key, prompt(source, [field]).alias("prompt"))
    again = apply_model(todo, call, keys=(key,)).select(key, F.col("response").alias("_answer"))
    return records.join(again, key, "left").withColumn(field, F.coalesce("_answer", field)).drop("_answer")


def embed(texts: DataFrame, size: int = 64) -> DataFrame:
    """key, embedding: the hashing embedder, for tests and for vectors without a model."""

    def run(frames):
        import re
        import zlib

        import numpy as np

        for f in frames:
            rows = np.zeros((len(f), size), np.float32)
            for i, t in enumerate(f["text"]):
                for w in re.findall(r"[a-z0-9]+", (t or "").lower()):
                    h = zlib.crc32(w.encode())
                    rows[i, h % size] += 1 if h >> 31 else -1
            rows /= np.maximum(np.linalg.norm(rows, axis=1), 1e-9)[:, None]
            yield pd.DataFrame({"key": f["key"], "embedding": list(rows)})

    return texts.select("key", "text").mapInPandas(run, "key string, embedding array<float>")


def only_new(new: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """What earlier results don't hold: the input of an incremental refresh."""
    return new.join(done.select(key), key, "left_anti")
