"""Functions that Spark SQL has no equal of, as Arrow-batched Python."""

from __future__ import annotations

import json
import re
import textwrap

import pandas as pd
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType


@pandas_udf(StringType())
def shorten(text: pd.Series, width: pd.Series) -> pd.Series:
    """White space collapsed and cut at a word boundary, `...` included in the width; null stays null."""
    return pd.Series([None if t is None else textwrap.shorten(t, int(w), placeholder="...") for t, w in zip(text, width)])


def salvage(raw: str | None) -> str | None:
    """The first JSON object or array of an answer, fenced, wrapped in prose or with trailing commas; null without one."""
    if not raw:
        return None
    body = re.sub(r"^\s*```\w*\s*|\s*```\s*$", "", raw)
    spans = [body] + [body[body.find(a) : body.rfind(b) + 1] for a, b in sorted(("{}", "[]"), key=lambda p: body.find(p[0]) % (len(body) + 1)) if a in body]
    for span in spans:
        for text in (span, re.sub(r",(\s*[}\]])", r"\1", span)):
            try:
                value = json.loads(text)
            except ValueError:
                continue
            if isinstance(value, (dict, list)):
                return json.dumps(value, ensure_ascii=False)
    return None


@pandas_udf(StringType())
def tolerant_json(raw: pd.Series) -> pd.Series:
    return pd.Series([salvage(r) for r in raw], dtype=object)


@pandas_udf(StringType())
def object_list(raw: pd.Series) -> pd.Series:
    """The objects of an answer's list, or its one object, as a JSON list; other items are dropped, and an answer without JSON is an empty list."""

    def objects(answer: str | None) -> str:
        value = json.loads(salvage(answer) or "[]")
        return json.dumps([x for x in (value if isinstance(value, list) else [value]) if isinstance(x, dict)], ensure_ascii=False)

    return pd.Series([objects(r) for r in raw], dtype=object)
