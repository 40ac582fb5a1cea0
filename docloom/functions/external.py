"""External models behind one function: structured completions for the rows of a table, with a retry and a trace."""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: (action, system, prompt) -> JSON text. It runs in the tasks, so it must be picklable.
Provider = Callable[[str, str, str], str]


def stub(action: str, system: str, prompt: str) -> str:
    """Answers without a model: the action and the prompt's size."""
    return json.dumps({"action": action, "size": len(prompt)})


def plain_keys(value):
    """Keys of objects at every depth without accents, lower case, spaces and hyphens as underscores."""
    if isinstance(value, dict):
        return {re.sub(r"[\s-]+", "_", "".join(c for c in unicodedata.normalize("NFD", k.strip().lower()) if unicodedata.category(c) != "Mn")): plain_keys(v) for k, v in value.items()}
    return [plain_keys(v) for v in value] if isinstance(value, list) else value


def complete(rows: DataFrame, key: str, prompt: str, action: str, schema: str, system: str = "", provider: Provider = stub) -> DataFrame:
    """(key, answer struct of ``schema``, attempts, error): one call for each row, repeated once if the answer isn't JSON
    of an object. Keys of the answer are normalised; missing ones are null; an error leaves the answer null."""

    def ask(text: str) -> tuple[str | None, int, str | None]:
        error = None
        for attempt in (1, 2):
            try:
                found = json.loads(provider(action, system, text))
                if not isinstance(found, dict):
                    raise ValueError("the answer is no object")
                return json.dumps(plain_keys(found)), attempt, None
            except Exception as e:  # whatever a provider raises is the row's error, not the job's
                error = f"{type(e).__name__}: {e}"
        return None, 2, error

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            out = [ask(x or "") for x in b.column("_prompt").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(key), *(pa.array([x[i] for x in out], t) for i, t in enumerate((pa.string(), pa.int32(), pa.string())))], names=[key, "_json", "attempts", "error"])

    told = rows.select(key, F.col(prompt).cast("string").alias("_prompt")).mapInArrow(batches, f"{key} {rows.schema[key].dataType.simpleString()}, _json string, attempts int, error string")
    return told.select(key, F.from_json("_json", schema).alias("answer"), "attempts", "error")
