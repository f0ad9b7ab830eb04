"""Judges: functions from a prompt to an answer. None of these needs a network.

A prompt is an instruction, which tells its kind, and sections that begin with `## NAME` lines.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Judge = Callable[[str], str]

#: Instructions by kind of prompt.
PATTERNS = "Describe cause and fix under the tags VULN_CAUSE VULN_CTRLFLOW VULN_DATAFLOW POSITIVE_TESTS FIX_DESC FIX_CTRLFLOW FIX_DATAFLOW NEGATIVE_TESTS, each in square brackets."
SELECT = 'Choose the important blocks. Answer as {"important_ids": ["..."]}'
DECIDE = "Is the vulnerability present? First line YES or NO, second line the confidence from 0 to 1, then the reason."
EXPAND = 'Which further lines of the tree belong to this side of the change? Answer as [{"file_path": "...", "start_line": 1, "end_line": 2, "brief_reason": "..."}]'
SUGGEST = 'Which further functions of the target may hold the vulnerability? Answer as [{"file_path": "...", "function": "..."}]'

#: Fewest characters of a line that tells anything.
TELLING = 10
_CONTROL = re.compile(r"(?:if|else|elif|for|while|switch|case|try|except|catch|return|raise|throw|break|continue)\b")
_CALL = re.compile(r"\w\s*\(")


def prompt(instruction: str, **parts: Column) -> Column:
    """The prompt as a column; null sections are empty. Lines of a section that look like its head are moved in by a blank."""
    body = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), "(?m)^## ", " ## ")
    return F.concat_ws("\n", F.lit(instruction), *[F.concat(F.lit(f"## {name}\n"), body(c)) for name, c in parts.items()])


def sections(text: str) -> dict[str, str]:
    """The sections of a prompt by name, and the instruction under the empty name."""
    parts = re.split(r"^## ([A-Z]+)\n", text, flags=re.M)
    return {"": parts[0].strip()} | {k: v.removesuffix("\n") for k, v in zip(parts[1::2], parts[2::2])}


def sides(diff: str) -> tuple[list[str], list[str]]:
    """The telling lines of the vulnerable side of a diff, kept and removed ones, and the added ones that it lacks; distinct, in order."""
    rows = [(x[:1], x[1:].strip()) for x in diff.replace("\r\n", "\n").split("\n") if not x.startswith(("---", "+++"))]
    old = list(dict.fromkeys(t for s, t in rows if s in (" ", "-") and len(t) >= TELLING))
    return old, list(dict.fromkeys(t for s, t in rows if s == "+" and len(t) >= TELLING and t not in set(old)))


def compare(old: list[str], new: list[str], code: str) -> str:
    """YES if at least half of the vulnerable side stands in the code, and less than half of what the fix adds."""
    lines = {x.strip() for x in code.split("\n")}
    seen, mended = sum(x in lines for x in old), sum(x in lines for x in new)
    if not old:
        return "NO\n0.50\nnothing to compare"
    yes = 2 * seen >= len(old) and (not new or 2 * mended < len(new))
    share = seen / len(old)
    return f"{'YES' if yes else 'NO'}\n{share if yes else max(1 - share, mended / len(new) if new else 0.0):.2f}\n{seen} of {len(old)} vulnerable and {mended} of {len(new)} added lines found"


def _patterns(parts: dict[str, str]) -> str:
    old, new = sides(parts.get("PATCH", ""))
    count = lambda pattern, lines: sum(bool(pattern.search(x)) for x in lines)
    out = []
    for side, lines, names in (("vulnerable", old, ("VULN_CAUSE", "VULN_CTRLFLOW", "VULN_DATAFLOW", "POSITIVE_TESTS")), ("added", new, ("FIX_DESC", "FIX_CTRLFLOW", "FIX_DATAFLOW", "NEGATIVE_TESTS"))):
        control = sum(bool(_CONTROL.match(x)) for x in lines)
        out += [f"[{names[0]}]\n{len(lines)} {side} lines", f"[{names[1]}]\n{control} {side} control statements", f"[{names[2]}]\n{count(_CALL, lines)} {side} calls", f"[{names[3]}]", *[f"- {x}" for x in lines]]
    return "\n".join(out)


def _expand(parts: dict[str, str]) -> str:
    """The files of the tree that a hunk's file imports or shares its folder with are asked for by their first 20 lines."""
    named = {p.rsplit("/", 1)[0] for p in re.findall(r"^(?:---|\+\+\+) [ab]/(\S+)", parts.get("PATCH", ""), re.M) if "/" in p}
    files = [x.strip() for x in parts.get("FILES", "").split("\n")]
    return json.dumps([{"file_path": f, "start_line": 1, "end_line": 20, "brief_reason": "same folder"} for f in files if f.rsplit("/", 1)[0] in named])


def _suggest(parts: dict[str, str]) -> str:
    """Functions called in the changed lines, in the files of the patch's names."""
    old, new = sides(parts.get("PATCH", ""))
    called = sorted({m for x in (*old, *new) for m in re.findall(r"\b([A-Za-z_]\w{3,})\s*\(", x)})
    bases = sorted({p.rsplit("/", 1)[-1] for p in re.findall(r"^(?:---|\+\+\+) [ab]/(\S+)", parts.get("PATCH", ""), re.M)})
    return json.dumps([{"file_path": b, "function": f} for b in bases for f in called])


def rule_judge(text: str) -> str:
    """Deterministic answers by rule, one for each kind of prompt; an empty answer to any other text."""
    parts = sections(text)
    kind = parts[""]
    if kind == PATTERNS:
        return _patterns(parts)
    if kind == SELECT:
        files = set(parts.get("FILES", "").split("\n"))
        listed = re.findall(r"^ID=(-?\d+) \| \[([^\]\n]*):\d*-\d*\] :: ", parts.get("LISTING", ""), re.M)
        return json.dumps({"important_ids": [i for i, base in listed if base in files]})
    if kind == DECIDE:
        if "PATTERNS" in parts:
            try:
                known = json.loads(parts["PATTERNS"] or "{}")
            except ValueError:
                known = {}
            pick = lambda side, key: (known.get(side) or {}).get(key) or []
            return compare(pick("vuln_pattern", "positive_tests"), pick("safe_pattern", "negative_tests"), parts.get("CODE", ""))
        return compare(*sides(parts.get("PATCH", "")), parts.get("CODE", ""))
    if kind == EXPAND:
        return _expand(parts)
    return _suggest(parts) if kind == SUGGEST else ""


def replay_judge(answers: dict[str, str]) -> Judge:
    """Recorded answers by the SHA-256 of the prompt; an empty answer for others."""
    return lambda prompt: answers.get(hashlib.sha256(prompt.encode()).hexdigest(), "")


def ask(prompts: DataFrame, judge: Judge) -> DataFrame:
    """The prompts with `raw`, the judge's answers, asked batch by batch where the rows are."""
    rest = [c for c in prompts.columns if c != "prompt"]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            answers = pa.array([judge(p or "") for p in batch.column(len(rest)).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(rest)], answers], names=[*rest, "raw"])

    kinds = ", ".join(f"`{c}` {prompts.schema[c].dataType.simpleString()}" for c in rest)
    return prompts.select(*rest, "prompt").mapInArrow(rows, f"{kinds}, raw string")
