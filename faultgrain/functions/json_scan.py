"""The one JSON document in a free-form answer.

Spark's JSON functions accept text after the document and cannot search for one, so a
small Arrow function does the extraction. It returns canonical JSON, which the contracts
then check with built-in variant functions.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_OPENING = re.compile(r"[{\[]")


def _embedded(text: str) -> Iterator[dict | list]:
    """Arrays and objects found left to right; a value is not searched inside."""
    decode = json.JSONDecoder().raw_decode
    at = 0
    while found := _OPENING.search(text, at):
        try:
            value, at = decode(text, found.start())
            yield value
        except json.JSONDecodeError:
            at = found.start() + 1


def _single(text: str | None) -> tuple[str | None, str | None]:
    """(canonical JSON, None) or (None, error)."""
    if text is None:
        return None, "there is no answer"
    text = text.strip()
    try:
        value = json.loads(text)
    except json.JSONDecodeError as problem:
        try:
            found = list(islice(_embedded(text), 2))
        except (ValueError, RecursionError) as worse:
            return None, f"unreadable JSON: {worse}"
        if not found:
            return None, f"not valid JSON: {problem}"
        if len(found) > 1:
            return None, "several JSON values"
        value = found[0]
    except (ValueError, RecursionError) as problem:
        return None, f"unreadable JSON: {problem}"
    if not isinstance(value, (dict, list)):
        return None, "neither a JSON object nor an array"
    return json.dumps(value, separators=(",", ":")), None


def single_json(text: Column) -> Column:
    """``struct(json, error)``: the only object or array in ``text``, else why there is none."""

    @F.pandas_udf("struct<json:string,error:string>")
    def extract(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [_single(text) for text in batch]
            yield pd.DataFrame(found, columns=["json", "error"], dtype=object)

    return extract(text)
