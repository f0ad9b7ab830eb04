"""Texts cut off by field limits or in transfer.

A backward character n-gram model learns from all lines of all texts, per language and kind of line, at which share of the
places with a context a line stops. The context of a place is what stands before it: the last five characters, the last three,
and the last three signs of a reduced alphabet in which runs of lower case, upper case, digits and other letters are one sign each;
longer contexts are smoothed by shorter ones. A complete text ends where lines stop, a cut one ends anywhere, so the log-odds
of a text are those of its final context among all places against that context among all stops. Above a threshold the
text is cut. The thresholds are fitted per language, on the column at hand: every line that is followed by another tells how
a complete end scores, and how the same line scores when it is cut at one of its places.

Contexts are hashed into a table of fixed size, which bounds the model whatever the corpus. Length statistics of each source
tell at which length, in characters or bytes, it cuts, and whether it marks its cuts; a marked cut is judged by the text before the mark.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import cache
from hashlib import blake2b
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.items import mix
from ..sources.tables import materialize

#: The symbols of the reduced alphabet. a: lower case, A: upper case, 0: digits, Z: letters without case, ^: line start, ~: other.
SYMBOLS = "^aA0Z .,;:!?\"'`()[]{}<>/-_#|*=+~R"
_CODE = {c: k for k, c in enumerate(SYMBOLS)}
N = len(SYMBOLS)
KINDS = ("prose", "list", "quote", "heading", "table", "signature", "field", "address", "code", "fence")
LANGUAGES = ("en", "de", "es", "fr", "zh", "other")
#: The table of contexts has 2**CELL_BITS cells of two counts: this bounds what is broadcast (16 MB).
CELL_BITS = 22
SLICE_BITS = 16
#: Places of a context that weigh as much as what shorter contexts say.
SMOOTHING = 10.0
#: How many missed cuts a false alarm weighs when a threshold is fitted, and between which log-odds it may lie.
FALSE_ALARM = 5.0
LEAST_THRESHOLD, MOST_THRESHOLD = 0.0, 2.0
#: Complete ends that a language needs for a threshold of its own; others have that of all languages together.
LEAST_ENDS = 200
#: Most characters of a title, which is no sentence and ends as it likes.
TITLE = 120
#: Log-odds are counted in bins of this width.
BIN = 0.05
#: Added to the log-odds of a text as long as its source's limit.
AT_LIMIT = 0.5
MARKS = ("...", "…", "[...]", "[…]", "(...)")

_SENTENCE_END = {"。": ".", "！": "!", "？": "?", "，": ",", "；": ";", "：": ":", "…": ".", "”": '"', "“": '"', "「": '"', "」": '"', "（": "(", "）": ")", "、": ",", "«": '"', "»": '"', "‘": "'", "’": "'", "�": "R"}


class _Shape(dict):
    """Symbol of each code point, filled as needed."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        if c in _SENTENCE_END:
            s = _SENTENCE_END[c]
        elif c.isdigit():
            s = "0"
        elif c.isalpha():
            s = "a" if c.islower() else "A" if c.isupper() else "Z"
        elif c.isspace():
            s = " "
        else:
            s = c if c in _CODE and c not in "^~aAZR0" else "~"
        self[code] = s
        return s


_HAN = re.compile("[㐀-鿿]")
_FIELD = re.compile(r"[A-Z][\w\-]*(?: [\w\-]+)?: \S")
_FENCE = re.compile(r"```+|^\s*~~~+")
_ADDRESS_END = re.compile(r"[a-z][a-z0-9+.\-]*://\S*$", re.I)


def language(lang: str | None, text: str) -> str:
    """The language of a line: the column where it names a known one, but Chinese by script alone."""
    name = (lang or "").strip().lower()[:2]
    if not text.isascii() and len(_HAN.findall(text)) * 5 > len(text):
        return "zh"
    return name if name in LANGUAGES and name != "zh" else "other"


def open_fence(text: str) -> bool:
    """Whether a text stops inside fenced code; marks count wherever they stand in a line."""
    return ("```" in text or "~~~" in text) and sum(len(_FENCE.findall(line)) for line in text.split("\n")) % 2 == 1


def lines_of(text: str) -> list[tuple[str, str]]:
    """(kind, line) of the lines with ink."""
    return [line[:2] for line in spaced_lines(text)]


def spaced_lines(text: str) -> list[tuple[str, str, bool]]:
    """(kind, line, whether a blank line stands before it) of the lines with ink."""
    out: list[tuple[str, str, bool]] = []
    gap = False
    code, before = False, ""
    lines = text.split("\n")
    for k, line in enumerate(lines):
        line = line.rstrip()
        bare = line.lstrip()
        if not bare:
            before, gap = before if code else "", True
            continue
        marks = _FENCE.findall(line) if "```" in line or "~~~" in line else ()
        was, code = code, code != (len(marks) % 2 == 1)
        if marks and bare.startswith(("```", "~~~")):
            kind = "code" if code else "fence"
        elif was:
            kind = "code" if code else "fence"
            kind = "code"
        elif before == "--":
            kind = "signature"
        elif bare[0] == "|":
            kind = "table"
        elif bare[0] == "#":
            kind = "heading"
        elif bare[0] == ">":
            kind = "quote"
        elif bare[:2] in ("- ", "* ", "+ ", "• ") or re.match(r"\d+[.)] ", bare):
            kind = "list"
        elif "://" in line and _ADDRESS_END.search(line.rsplit(None, 1)[-1]):
            kind = "address"
        elif _FIELD.match(bare) and len(bare) < 100:
            kind = "field"
        else:
            kind = "prose"
        out.append((kind, line, gap))
        before, gap = bare, False
    return out


@cache
def _alphabet() -> tuple[np.ndarray, np.ndarray]:
    """By code point below 2**16: the sign of the reduced alphabet; the folded character, digits as 0. Made once in each process."""
    shape = _Shape()
    signs = np.array([_CODE[shape[c]] for c in range(1 << 16)], np.uint8)
    lower = [chr(c).lower() for c in range(1 << 16)]
    return signs, np.array([48 if signs[c] == _CODE["0"] else ord(x) if len(x) == 1 else c for c, x in enumerate(lower)], np.uint32)


def _seed(*parts: object) -> np.uint64:
    return np.uint64(int.from_bytes(blake2b(repr(parts).encode(), digest_size=8).digest(), "little"))


_RUNS = np.zeros(256, np.bool_)
_RUNS[[_CODE[c] for c in "aA0Z "]] = True
_M = np.uint64(0x9E3779B97F4A7C15)
_LEVELS = 6


def _cells(contexts: np.ndarray, *name: object) -> np.ndarray:
    """The cells of contexts of one level of one language and kind."""
    with np.errstate(over="ignore"):
        return (mix(contexts.astype(np.uint64) + _seed(*name)) >> np.uint64(64 - CELL_BITS)).astype(np.int64)


class Places:
    """All characters of lines without their line ends. stops: whether a line stops behind the place; at: the offsets of the lines."""

    def __init__(self, lines: list[str]):
        signs, folded = _alphabet()
        codes = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32)
        low = np.minimum(codes, 0xFFFF)
        sign, self.char = signs[low], folded[low]
        far = np.flatnonzero(codes > 0xFFFF)
        if len(far):
            sign[far] = np.where((codes[far] >= 0x20000) & (codes[far] < 0x33480), _CODE["Z"], _CODE["~"])
            self.char[far] = codes[far]
        size = np.fromiter(map(len, lines), np.int64, len(lines))
        self.at = np.concatenate(([0], np.cumsum(size)))
        self.place = np.arange(self.at[-1], dtype=np.int32) - np.repeat(self.at[:-1].astype(np.int32), size)
        self.stops = np.zeros(self.at[-1], np.bool_)
        self.stops[self.at[1:][size > 0] - 1] = True
        # runs of one sign count once
        new = ~_RUNS[sign] | (self.place == 0)
        new[1:] |= sign[1:] != sign[:-1]
        first = np.flatnonzero(new)
        own, opens = sign[first].astype(np.int32), self.place[first] == 0
        before, second = np.zeros_like(own), np.zeros_like(own)
        before[1:] = np.where(opens[1:], 0, own[:-1])
        second[1:] = np.where(opens[1:], 0, before[:-1])
        self.two = np.repeat(before * N + own, np.diff(np.append(first, len(sign))))
        self.three = np.repeat((second * N + before) * N + own, np.diff(np.append(first, len(sign))))

    def last(self, k: int, where: np.ndarray) -> np.ndarray:
        """Hashes of the last k characters at some places; a line's beginning is a character of its own."""
        h = self.char[where].astype(np.uint64)
        with np.errstate(over="ignore"):
            for j in range(1, k):
                h = h * _M + np.where(self.place[where] >= j, self.char[where - np.minimum(j, where)], 2) + np.uint64(1)
        return h

    def cells(self, lang: str, kind: str, where: np.ndarray) -> np.ndarray:
        """Cells by level and place: the language alone, then contexts from the shortest; the first two of these are of all languages."""
        two, three = self.two[where], self.three[where]
        return np.stack([np.broadcast_to(_cells(np.zeros(1), lang), where.shape), _cells(two, "*", kind, 2), _cells(three, "*", kind, 3), _cells(three, lang, kind, 3), _cells(self.last(3, where), lang, kind, "ccc"), _cells(self.last(5, where), lang, kind, "ccccc")])


def parts_of(lines: list, size: int = 1 << 18) -> Iterator[list]:
    """Runs of lines of about so many characters together; lines are (text, ...)."""
    begin = total = 0
    for k, line in enumerate(lines):
        if total and total + len(line[0]) > size:
            yield lines[begin:k]
            begin, total = k, 0
        total += len(line[0])
    if begin < len(lines):
        yield lines[begin:]


def marked_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[tuple[str, str], list[tuple[str, bool]]]]:
    """Lines by (language, kind), each with whether another line follows; a title and lines that may be wrapped are no ends."""
    for batch in batches:
        out: dict[tuple[str, str], list[tuple[str, bool]]] = defaultdict(list)
        for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            lines = spaced_lines(text)
            after = [(kind, gap) for kind, _, gap in lines[1:]] + [("", True)]
            for k, (kind, line, _) in enumerate(lines):
                # a line of running text right before another of its kind may be wrapped: it is no stop
                wrapped = kind in ("prose", "quote") and after[k] == (kind, False)
                if k or len(lines) == 1 or len(line) > TITLE:
                    out[language(lang, line), kind].append((line + " " * wrapped, k + 1 < len(lines) and not wrapped))
        yield out


def count_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Places and stops of the cells over one partition, as sparse slices."""
    places, stops = np.zeros(1 << CELL_BITS, np.int64), np.zeros(1 << CELL_BITS, np.int64)
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0
    signs: dict[tuple[str, str], np.ndarray] = defaultdict(lambda: np.zeros((2, N**3), np.int64))

    def flush() -> None:
        nonlocal size
        if held:
            np.add(places, np.bincount(np.concatenate([c for c, _ in held]), minlength=1 << CELL_BITS), out=places)
            np.add(stops, np.bincount(np.concatenate([c[s] for c, s in held]), minlength=1 << CELL_BITS), out=stops)
        held.clear()
        size = 0

    for groups in marked_lines(batches):
        for (lang, kind), lines in groups.items():
            for part in parts_of(lines):
                p = Places([line for line, _ in part])
                everywhere = np.arange(len(p.char))
                signs[lang, kind][0] += np.bincount(p.three, minlength=N**3)
                signs[lang, kind][1] += np.bincount(p.three[p.stops], minlength=N**3)
                held += [(_cells(p.last(k, everywhere), lang, kind, "c" * k), p.stops) for k in (3, 5)]
                size += 2 * len(p.char)
                if size > 1 << 22:
                    flush()
    flush()
    for (lang, kind), counts in signs.items():
        three = np.flatnonzero(counts[0])
        for cells in (_cells(np.zeros(len(three)), lang), _cells(three % (N * N), "*", kind, 2), _cells(three, "*", kind, 3), _cells(three, lang, kind, 3)):
            np.add.at(places, cells, counts[0, three])
            np.add.at(stops, cells, counts[1, three])
    cells = np.flatnonzero(places)
    slices = cells >> SLICE_BITS
    cuts = np.flatnonzero(np.diff(slices, prepend=-1))
    bounds = list(zip(cuts, [*cuts[1:], len(cells)]))
    pack = lambda x: pa.array([x[i:j].tobytes() for i, j in bounds], pa.binary())
    yield pa.RecordBatch.from_arrays([pa.array(slices[cuts].astype(np.int32)), pack((cells & ((1 << SLICE_BITS) - 1)).astype(np.uint16)), pack(places[cells]), pack(stops[cells])], names=["slice", "cells", "places", "stops"])


def packed(counts: np.ndarray) -> np.ndarray:
    """Counts as two bytes: a thousand times their binary logarithm."""
    return np.rint(np.log2(counts + 1.0) * 1000).astype(np.uint16)


def slice_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The whole slices of the table from the parts of this partition, which come ordered by slice."""
    at, total = -1, None

    def done() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([zlib.compress(packed(total).tobytes(), 1)], pa.binary())], names=["slice", "counts"])

    for batch in batches:
        for s, cells, places, stops in zip(*(c.to_pylist() for c in batch.columns)):
            if s != at:
                if total is not None:
                    yield done()
                at, total = s, np.zeros((2, 1 << SLICE_BITS), np.int64)
            own = np.frombuffer(cells, np.uint16)
            total[0, own] += np.frombuffer(places, np.int64)
            total[1, own] += np.frombuffer(stops, np.int64)
    if total is not None:
        yield done()


class Model:
    """The table of contexts, and the thresholds by language."""

    def __init__(self, slices: list[tuple[int, bytes]], thresholds: dict[str, float] | None = None):
        self.slices, self.thresholds = slices, thresholds or {}
        self.table: np.ndarray | None = None

    def __getstate__(self) -> tuple:
        return self.slices, self.thresholds

    def __setstate__(self, state: tuple) -> None:
        (self.slices, self.thresholds), self.table = state, None

    def log_odds(self, cells: np.ndarray, own_stops: np.ndarray | int) -> np.ndarray:
        """Of places by their cells, level by level: how much rarer their contexts are among stops than among all places.

        The place itself was counted, as a stop where own_stops is 1; it is taken out, lest a text vouch for itself.
        """
        if self.table is None:
            self.table = np.zeros((2, 1 << CELL_BITS), np.uint16)
            for s, counts in self.slices:
                self.table[:, s << SLICE_BITS : s + 1 << SLICE_BITS] = np.frombuffer(zlib.decompress(counts), np.uint16).reshape(2, -1)
        places, stops = np.exp2(self.table[:, cells] / 1000.0) - 1
        places, stops = np.maximum(places - 1, 0), np.maximum(stops - own_stops, 0)
        base = (stops[0] + 0.5) / (places[0] + 1)
        p = base
        for k in range(1, _LEVELS):
            p = (stops[k] + SMOOTHING * p) / (places[k] + SMOOTHING)
        return np.log(base) - np.log(p)

    def of_ends(self, ends: list[tuple[str, str, bool]]) -> np.ndarray:
        """The log-odds of texts (language, text, whether it is whole) by their last lines; -inf without a line."""
        out = np.full(len(ends), -math.inf)
        groups: dict[tuple[str, str], list[tuple[str, int, bool]]] = defaultdict(list)
        for k, (own, text, whole) in enumerate(ends):
            if lines := lines_of(text):
                groups[own, lines[-1][0]].append((lines[-1][1], k, whole))
        for key, lines in groups.items():
            for part in parts_of(lines):
                p = Places([line for line, _, _ in part])
                out[[k for _, k, _ in part]] = self.log_odds(p.cells(*key, np.flatnonzero(p.stops)), np.array([whole for _, _, whole in part], np.int64))
        return out

    def threshold(self, own: str) -> float:
        return self.thresholds.get(own, self.thresholds.get("*", 1.0))


def score_rows(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    """(language, cut, bin, n): how complete ends, and the same lines cut at one of their places, score."""
    model, counts = shared.value, Counter()
    for groups in marked_lines(batches):
        for (lang, kind), lines in groups.items():
            for part in parts_of([line for line in lines if line[1] and len(line[0]) >= 2]):
                whole = [line for line, _ in part]
                p = Places(whole)
                inside = [crc32(x.encode("utf-8", "surrogatepass")) % (len(x) - 1) for x in whole]
                # a cut text ends where its last ink is
                cut = p.at[:-1][[not x[k].isspace() for x, k in zip(whole, inside)]] + [k for x, k in zip(whole, inside) if not x[k].isspace()]
                for is_cut, places in ((False, np.flatnonzero(p.stops)), (True, cut.astype(np.int64))):
                    bins, n = np.unique(np.floor(model.log_odds(p.cells(lang, kind, places), int(not is_cut)) / BIN).astype(np.int64), return_counts=True)
                    for own in (lang, "*"):
                        counts.update({(own, is_cut, b): k for b, k in zip(bins.tolist(), n.tolist())})
    yield pa.RecordBatch.from_arrays([pa.array([c[0] for c in counts], pa.string()), pa.array([c[1] for c in counts], pa.bool_()), pa.array([c[2] for c in counts], pa.int32()), pa.array(list(counts.values()), pa.int64())], names=["language", "cut", "bin", "n"])


def fitted(rows: list[tuple[str, bool, int, int]]) -> dict[str, float]:
    """The threshold of each language with the least weighted share of false alarms and misses."""
    out = {}
    for own in {r[0] for r in rows}:
        ends = np.array([(b, n) for lang, cut, b, n in rows if lang == own and not cut], np.int64).reshape(-1, 2)
        cuts = np.array([(b, n) for lang, cut, b, n in rows if lang == own and cut], np.int64).reshape(-1, 2)
        if ends[:, 1].sum() < LEAST_ENDS or not len(cuts):
            continue
        tried = np.arange(round(LEAST_THRESHOLD / BIN), round(MOST_THRESHOLD / BIN) + 1)
        false = np.array([ends[ends[:, 0] >= t, 1].sum() for t in tried]) / ends[:, 1].sum()
        missed = np.array([cuts[cuts[:, 0] < t, 1].sum() for t in tried]) / cuts[:, 1].sum()
        out[own] = float(tried[np.argmin(FALSE_ALARM * false + missed)] * BIN)
    return out


def judge(texts: list[tuple[str, str | None, tuple[int, int]]], model: Model) -> list[bool]:
    """Which texts (text with ink, language, limits of its source in characters and bytes, 0 for none) were cut off."""
    out, asked = [False] * len(texts), []
    for k, (text, lang, (chars, size)) in enumerate(texts):
        at_limit = chars and len(text) == chars or size and size - 3 <= len(text.encode("utf-8", "surrogatepass")) <= size + 2
        body = text.rstrip()
        own = language(lang, body[body.rfind("\n") + 1 :])
        if body.endswith("�") or open_fence(body):
            out[k] = True
            continue
        mark = next((m for m in MARKS if body.endswith(m)), "") if at_limit else ""
        body = body[: len(body) - len(mark)]
        if body:
            asked.append((k, own, body, not mark, AT_LIMIT if at_limit else 0.0))
    scores = model.of_ends([row[1:4] for row in asked])
    for (k, own, _, _, more), score in zip(asked, scores.tolist()):
        out[k] = score + more > model.threshold(own)
    return out


def judge_rows(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    model = shared.value
    for batch in batches:
        rows = [(doc, text, lang, (a or 0, b or 0)) for doc, text, lang, a, b in zip(*(c.to_pylist() for c in batch.columns)) if text.strip()]
        out = [row[0] for row, cut in zip(rows, judge([row[1:] for row in rows], model)) if cut]
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.int64())], names=["doc_id"])


def limits(documents: DataFrame) -> DataFrame:
    """(source, limit_chars, limit_bytes): the length at which each source cuts; null for none.

    The greatest length of a source is a limit if several of its texts have it, or if it is a round number.
    """
    both = documents.select("source", F.explode(F.array(F.struct(F.lit("c").alias("unit"), F.length("text").alias("n")), F.struct(F.lit("b").alias("unit"), F.octet_length("text").alias("n")))).alias("x")).select("source", "x.*")
    sizes = both.groupBy("source", "unit", "n").agg(F.count("*").alias("k"))
    top = sizes.groupBy("source", "unit").agg(F.max_by(F.struct("n", "k"), F.when(F.col("k") >= 2, F.col("n")).otherwise(F.when((F.col("n") % 100 == 0) | (F.col("n") % 256 == 0), F.col("n")).otherwise(0))).alias("limit"), F.max("n").alias("most"))
    # bytes of characters cut in the middle may pass the limit by two
    known = top.where((F.col("limit.n") >= F.col("most") - F.when(F.col("unit") == "b", 2).otherwise(0)) & (F.col("limit.n") >= 50) & ((F.col("limit.k") >= 2) | (F.col("limit.n") % 100 == 0) | (F.col("limit.n") % 256 == 0)))
    one = lambda unit: F.max(F.when(F.col("unit") == unit, F.col("limit.n")))
    return known.groupBy("source").agg(one("c").alias("limit_chars"), one("b").alias("limit_bytes"))


def cut_off(documents: DataFrame) -> DataFrame:
    """(doc_id): documents whose text was cut off. Distinct. Null, empty and blank texts are no cases; a null source has no limit."""
    spark = documents.sparkSession
    docs = documents.select(F.col("doc_id").cast("long"), "text", "lang", "source").where(F.col("doc_id").isNotNull() & F.col("text").rlike(r"(?U)\S"))
    # a text counts once, under its least id: copies would vouch for each other's ends
    digests = materialize(docs.select("doc_id", F.sha1("text").alias("digest")), "digests")
    several = digests.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    others = materialize(digests.join(several, "digest").where("doc_id <> first").select("doc_id").distinct(), "copies")
    lines = docs.join(others, "doc_id", "left_anti").select("text", "lang")
    parts = lines.mapInArrow(count_rows, "slice int, cells binary, places binary, stops binary")
    summed = parts.repartition("slice").sortWithinPartitions("slice").mapInArrow(slice_sums, "slice int, counts binary")
    # at most 2**(CELL_BITS - SLICE_BITS) slices of 2**(SLICE_BITS + 2) bytes
    model = Model([(r.slice, bytes(r.counts)) for r in summed.collect()])
    shared = spark.sparkContext.broadcast(model)
    scores = lines.mapInArrow(lambda b: score_rows(b, shared), "language string, cut boolean, bin int, n long").groupBy("language", "cut", "bin").agg(F.sum("n").alias("n"))
    model = spark.sparkContext.broadcast(Model(model.slices, fitted([tuple(r) for r in scores.collect()])))
    known = docs.join(limits(docs.where(F.col("source").isNotNull())), "source", "left")
    return known.select("doc_id", "text", "lang", "limit_chars", "limit_bytes").mapInArrow(lambda b: judge_rows(b, model), "doc_id long").distinct()


def rates(documents: DataFrame) -> DataFrame:
    """(source, n_docs, n_cut, rate) over the documents with ink of each source; a null source is one of its own."""
    docs = documents.where(F.col("text").rlike(r"(?U)\S")).select(F.col("doc_id").cast("long").alias("doc_id"), "source").distinct()
    cut = cut_off(documents).withColumn("cut", F.lit(1))
    joined = docs.join(cut, "doc_id", "left").groupBy("source").agg(F.count("*").alias("n_docs"), F.count("cut").alias("n_cut"))
    return joined.withColumn("rate", F.round(F.col("n_cut") / F.col("n_docs"), 6))
