"""Credentials embedded in source code: where they begin, and the text with them redacted.

Candidates are quoted strings, values of configuration lines and of connection strings, and long tokens. Each gets the Shannon
entropy of its alphabet (hexadecimal, alphanumeric, base 64, any); it is a credential if that exceeds a threshold that falls
with its length and is lower beside a name that calls it one. Digests, identifiers, references, plain words and placeholders
are excluded. Passwords of addresses, authorization headers and tokens of fixed format are found by their form; they too must
pass the tests of placeholders and entropy. Of a private key block the opener counts only with key material behind it.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

REDACTED = "REDACTED"

#: Words that end, or stand before "key" in, a name that calls its value a credential.
_SECRET_WORDS = {"password", "passwd", "passwort", "pwd", "pass", "passphrase", "passcode", "secret", "token", "apikey", "secretkey", "accesskey", "authkey", "jwt", "bearer", "pat", "credential", "credentials", "authtoken"}
_KEY_KINDS = {"api", "service", "storage", "hmac", "aws", "access", "secret", "enc", "encryption", "private", "signing", "shared", "auth", "account", "master", "client", "admin", "license", "deploy", "ssh", "session", "webhook", "crypt", "cipher"}
#: Words of names whose values are no credentials.
_PUBLIC_WORDS = {"public", "pub", "digest", "hash", "checksum", "checksums", "uuid", "guid", "commit", "etag", "fingerprint", "sha", "sha1", "sha256", "md5", "integrity", "revision", "build", "request", "trace", "length", "len", "count", "name", "file", "path", "type", "url", "uri", "env", "limit", "expiry", "ttl", "field", "header", "prefix", "hint"}
_CORE = re.compile(r"(?i)pass|pwd|secret|token|key|jwt|bearer|pat(?![a-z])|credential")
_NAME_CHARS = re.compile(r"[\w.\-]*")
_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")
_CONFIG = {"env", "properties", "yaml", "yml", "ini", "cfg", "conf", "toml"}

_OPENER = re.compile(r"-----BEGIN ((?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?)-----")
_PUBLIC_BLOCK = re.compile(r"-----BEGIN (?![A-Z0-9 ]*PRIVATE)([A-Z0-9 ]+)-----(?:[A-Za-z0-9+/=\s\"',:+*#\\-]|//)*?-----END \1-----")
#: What may stand between the lines of a key: line ends, also written as escapes, comment marks, quotes, string joins.
_KEY_GAP = re.compile(r"(?:\\[nrt]|\\?\r?\n|[ \t\"'+,;.|>)(]|(?<=[\s\"'])(?://+|\*|#+|--|/\*)(?=[ \t]|$))*", re.M)
_KEY_LINE = re.compile(r"(?:Proc-Type|DEK-Info|Version|Comment|Hash|Charset)(?::| :)[^\n\\\"']*|(?:[A-Za-z0-9+/]|\\/)+={0,2}|=[A-Za-z0-9+/]{4}")
#: Fewest characters of a line that is key material without an END line behind it.
KEY_LINE = 24
_ADDRESS = re.compile(r"[A-Za-z][A-Za-z0-9+.\-]{1,20}://[^\s/:@\"'<>]*:([^\s@\"'<>/]+)@(?=[A-Za-z0-9\[])")
_FORMATS = re.compile(
    r"(?<![A-Za-z0-9])(?:(?:AKIA|ASIA)[0-9A-Z]{16}(?![0-9A-Za-z])|gh[pousr]_[A-Za-z0-9]{20,}|github_pat_\w{22,}|glpat-[\w\-]{16,}|xox[abeprs]-[A-Za-z0-9\-]{10,}|npm_[A-Za-z0-9]{20,}"
    r"|[a-z]{2,4}_(?:live|test|prod)_[A-Za-z0-9]{16,}|AIza[\w\-]{30,}|SG\.[\w\-]{16,}\.[\w\-]{16,}|eyJ[\w\-]{8,}\.eyJ[\w\-]{4,}\.[\w\-]{16,})"
)
_HEADER = re.compile(r"(?i)\b(?:authorization)\b[\"']?\s*[:=,]\s*[\"']?\s*(?:bearer|basic|token|apikey|digest)\s+([^\s\"',;}{]+)")
_LOGIN = re.compile(r"(?i)\b(?:login|logon|user(?:name)?|account|creds?|credentials)[ \t]*[:=]?[ \t]+[\w.@\-]+[ \t]*[/|][ \t]*([^\s\"'<>,;]{6,})")
_JOINED = re.compile(r"([\"'])([^\"'\\\n]{2,})\1(?:\s*(?:\+|\.(?=\s*[\"'])|\\?\r?\n)?\s*\1[^\"'\\\n]+\1)+")
_PIECE = re.compile(r"([\"'])([^\"'\\\n]+)\1")
_LONG = re.compile(r"(?<![A-Za-z0-9+/=_\-])[A-Za-z0-9+/_\-]{20,}={0,2}(?![A-Za-z0-9+/=_\-])")
_OPERATOR = re.compile(r"[\"']?\s*\]?\s*(?:\[\s*\d*\s*\])?\s*(?::=|=>|==|[=:,]|\bis\b|\s>|>)\s*\(?\s*")
_QUOTED = re.compile(r"[bBrRuU]?(\"\"\"|'''|\"|')((?:\\.|(?!\1)[^\n\\])*)\1")
_BARE = re.compile(r"[^\s\"'<>,;#]+")
_XML_VALUE = re.compile(r"[\"']\s+value\s*=\s*\"([^\"\n]*)\"")
_XML_TEXT = re.compile(r">([^<\s][^<\n]*)</")
_COMMENT_NAME = re.compile(r"(?://|/\*|#|--)\s*([A-Za-z_][\w.\-]*)\s*(?:\*/)?\s*$")

_BASE64 = re.compile(r"[A-Za-z0-9+/_\-]+={0,2}\Z")
_HEX = re.compile(r"(?:0x)?[0-9a-fA-F]+\Z")
_QUERY = re.compile(r"=([^\s\"'&;,<>()]+)")
#: Values of free quoted strings: no white space, brackets or escapes, which formats, patterns and paths have.
_FREE_QUOTED = re.compile(r"[^\s\"'\\(){}\[\]<>|`\x00-\x1f]{12,}\Z")
#: Lengths of hexadecimal digests and identifiers.
_DIGEST_SIZES = (32, 40, 56, 64, 96, 128)
#: Words by which a text of several words is a sentence, not a pass phrase.
_SENTENCE = re.compile(r"(?i)\b(?:must|should|be|is|are|the|your|you|an?|at|of|for|to|not|enter|invalid|incorrect|wrong|please|required|has|have|in|on|with|from|or)\b|[.!?:]\s*\Z|%|\{")
_UUID = re.compile(r"\{?[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}\}?\Z")
_DIGEST = re.compile(r"(?i)(?:sha-?\d+|md5|blake2?[bs]?|crc32)[:\-=]")
_PLACEHOLDER = re.compile(r"(?i)<[^>]*>?|.*\$[\{\(]|.*\{\{|.*%\(\w+\)s|%s\Z|\{\w*\}|(.)\1*\Z|x{4,}|\*{3,}|.*(?:your|change.?me|example|placeholder|dummy|sample|redacted|replace|insert|todo|fixme|test.?only)[\W_]|(?:changeme|placeholder|dummy|example|redacted|secret|password|passwd|token|none|null|nil|true|false|undefined|n/?a|tbd|todo)\Z|\.\.\.")
_REFERENCE = re.compile(r"(?:os\.|process\.env|System\.|getenv|env[.:\[]|ENV\[|vault:|file:|ssm:|secretsmanager:|@\w+@|!(?:ref|secret|env|vault|include|sub)\b|\./|[A-Za-z_][A-Za-z_.]*\([^()]*\)\Z|self\.|this\.|\$[A-Z_][A-Z0-9_]*\Z|\$[a-z_]+\Z|\$\()")
_FILE = re.compile(r"~?/[\w./\-]+\Z")


def entropy(text: str) -> float:
    """Bits a character, by the text's own frequencies."""
    n = len(text)
    return -sum(k / n * math.log2(k / n) for k in Counter(text).values()) if n else 0.0


def threshold(text: str, named: bool) -> float:
    """Least entropy of a credential of this length in its alphabet; a text of n characters has at most log2(n)."""
    n = len(text)
    if _HEX.match(text):
        bits, share = 4.0, 0.72
    elif text.isalnum():
        bits, share = 5.95, 0.78
    elif _BASE64.match(text):
        bits, share = 6.0, 0.74
    else:
        bits, share = 6.3, 0.74
    return min(bits, math.log2(n)) * share * (0.9 if named else 1.0) if n > 1 else 99.0


def words_of_name(name: str) -> list[str]:
    return [w.lower() for w in _PARTS.findall(name)]


def calls_secret(name: str) -> bool:
    """Whether a name says that its value is a credential."""
    words = words_of_name(name)
    while words and (words[-1].isdigit() or words[-1] in ("id", "value", "default", "str", "string", "b64", "base64")):
        if words[-1] == "id" and (len(words) < 2 or words[-2] != "key"):
            return False
        words.pop()
    if not words or any(w in ("public", "pub") for w in words) or words[-1] in _PUBLIC_WORDS:
        return False
    last, before = words[-1], words[-2] if len(words) > 1 else ""
    return last in _SECRET_WORDS or last == "key" and before in _KEY_KINDS or last == "phrase" and before == "pass" or last == "word" and before == "pass"


def excluded(value: str) -> bool:
    """Placeholders, references, empty values."""
    return not value.strip() or bool(_PLACEHOLDER.match(value)) or bool(_REFERENCE.match(value)) or bool(_FILE.match(value)) and not mixed(value)


def mixed(value: str) -> bool:
    """Whether upper case, lower case and digits change as often as in random characters."""
    switches = sum((a.isdigit(), a.isupper()) != (b.isdigit(), b.isupper()) for a, b in zip(value, value[1:]))
    return switches >= len(value) // 3


def phrase(value: str) -> bool:
    """Whether a text of several words is a pass phrase: four words or more, with a digit or a sign among them, and no sentence."""
    words = value.split()
    return len(words) >= 4 and any(not w.isalpha() for w in words) and all(w.isalnum() for w in words) and not _SENTENCE.search(value) and entropy(value) >= 3.0


def named_secret(value: str, several: bool = False) -> bool:
    """Whether a value beside a credential's name is one: literal, not plain words, and of enough entropy for its length.

    several: whether it may have several words, as pass phrases have.
    """
    if several and " " in value.strip():
        return phrase(value.strip())
    if len(value) < 6 or " " in value.strip() or excluded(value) or _UUID.match(value) or _DIGEST.match(value):
        return False
    digits, letters = sum(c.isdigit() for c in value), sum(c.isalpha() for c in value)
    other = len(value) - digits - letters
    if not letters or letters == len(value) and (value.islower() or value.istitle() or value.isupper() or len(words_of_name(value)) <= 3 and len(value) < 16):
        return False
    if not digits and other == sum(value.count(c) for c in "-_.:/") and value.lower() == value:
        return False
    if re.fullmatch(r"[A-Za-z_][A-Za-z_]*\d{0,3}", value) and "_" in value and value.lower() == value:
        return False
    return entropy(value) >= threshold(value, True)


def free_secret(value: str) -> bool:
    """Whether a long token is a credential by itself."""
    if len(value) < 20 or _HEX.match(value) or _UUID.match(value) or _DIGEST.match(value) or excluded(value):
        return False
    body = value.rstrip("=")
    upper, lower, digits = (sum(map(f, body)) for f in (str.isupper, str.islower, str.isdigit))
    if digits < 2 or upper < 2 or lower < 2 or max(map(len, re.findall(r"[a-z]+", body))) > 9:
        return False
    if sum(body.count(c) for c in "/_-") > len(body) // 6:
        return False
    return mixed(body) and entropy(value) >= threshold(value, False)


def formed_secret(value: str) -> bool:
    """Whether a value of a credential's form is one: no placeholder, and random enough behind the form's prefix."""
    body = re.sub(r"^(?:AKIA|ASIA|AIza|SG\.|gh[pousr]_|github_pat_|glpat-|npm_|xox[a-z]-|[a-z]{2,4}_(?:live|test|prod)_)", "", value)
    upper = value.upper()
    if "EXAMPLE" in upper or "PLACEHOLDER" in upper or re.search(r"(.)\1{5}", body) or re.search(r"(?i)x{4,}|your[_-]|1234567890|abcdefghij", body):
        return False
    return entropy(body) >= 0.85 * threshold(body, True)


def quoted_secret(value: str) -> bool:
    """Whether a quoted string without a name is a credential: all kinds of characters, mixed as at random, and signs among them."""
    if not _FREE_QUOTED.match(value) or excluded(value) or _UUID.match(value) or _DIGEST.match(value):
        return False
    if _HEX.match(value):
        body = value.removeprefix("0x")
        return len(body) >= 24 and len(body) not in _DIGEST_SIZES and not body.isdigit() and (body.islower() or body.isupper()) and entropy(body) >= threshold(body, False)
    upper, lower, digits = (sum(map(f, value)) for f in (str.isupper, str.islower, str.isdigit))
    signs = len(value) - upper - lower - digits
    if min(upper, lower, digits) < 2 or signs < 2 or "://" in value or re.search(r"%[-+0-9.]*[sdifxXuclr]\b|[=&?]\w+=|^[\w.]+@|\.\w{2,4}\Z", value):
        return False
    words = re.findall(r"[A-Za-z]+", value)
    return max(map(len, words)) <= 6 and mixed(value) and entropy(value) >= threshold(value, False)


Span = tuple[int, int]


def private_key(text: str, begin: int, end: int, label: str) -> tuple[list[Span], int] | None:
    """The spans of the key material behind an opener at begin..end, and where the block ends; None for an opener alone.

    The block goes on as long as lines of key material follow, whatever marks and quotes stand between them. Without its END
    line it must hold a line of KEY_LINE characters or more.
    """
    closing = f"-----END {label}-----"
    spans: list[Span] = []
    at = end
    while True:
        gap = _KEY_GAP.match(text, at).end()
        if text.startswith(closing, gap):
            return (spans, gap + len(closing)) if spans else None
        m = _KEY_LINE.match(text, gap)
        if not m or m.end() == gap:
            break
        body = m.group(0)
        lone = ":" not in body and len(body) < KEY_LINE and body.isalpha() and gap == at
        if lone:
            break
        if ":" not in body and body != REDACTED:
            spans.append(m.span())
        at = m.end()
    # without an END line only whole lines count: what follows may be code
    sure = [k for k, (a, b) in enumerate(spans) if b - a >= KEY_LINE and mixed(text[a:b])]
    last = sure[-1] if sure else -1
    while 0 <= last < len(spans) - 1 and mixed(body := text[slice(*spans[last + 1])]) and len(body) >= 8:
        last += 1
    return (spans[: last + 1], spans[last][1]) if sure else None


def _values_after(text: str, end: int, stop: int, config: bool) -> Iterator[Span]:
    """Spans of the literal value that follows a name ending at `end`, on the same line."""
    if m := _XML_VALUE.match(text, end, stop):
        yield m.span(1)
        return
    if text[end : end + 1] == ">" and (m := _XML_TEXT.match(text, end, stop)):
        yield m.span(1)
        return
    op = _OPERATOR.match(text, end, stop)
    if not op:
        return
    if "," in op.group(0) and text[end : end + 1] not in "\"'":
        return
    at = op.end()
    if m := _QUOTED.match(text, at, stop):
        yield m.span(2)
        # adjacent or added literals continue it
        while (j := re.compile(r"\s*\+?\s*").match(text, m.end(), stop)) and (n := _QUOTED.match(text, j.end(), stop)):
            m = n
            yield m.span(2)
        return
    if text[at : at + 1] in "\"'":
        return
    bare = config or "is" in op.group(0) or _in_comment(text, end)
    if bare and (m := re.compile(r"[^\s\"'<>]+").match(text, at, stop)):
        rest = text[m.end() : stop].strip()
        if config and rest and not rest.startswith("#"):
            return
        yield m.span()


def _in_comment(text: str, at: int) -> bool:
    head = text[text.rfind("\n", 0, at) + 1 : at]
    return bool(re.search(r"(?:^|\s)(?:#|//|\*|<!--|--)", head)) or "/*" in head


def find(text: str, extension: str = "") -> list[list[Span]]:
    """The credentials of a text, each as the spans of its literal parts, in order; spans do not overlap."""
    found: list[list[Span]] = []
    taken: list[Span] = []

    def add(parts: list[Span]) -> None:
        if parts and not any(a < e and s < b for a, b in parts for s, e in taken):
            taken.extend(parts)
            found.append(parts)

    if "-----BEGIN" in text:
        for m in _OPENER.finditer(text):
            if key := private_key(text, m.start(), m.end(), m.group(1)):
                found.append([(m.start(), m.start()), *key[0]])
                taken.append((m.start(), key[1]))
        # the material of public keys and certificates is none
        taken += [m.span() for m in _PUBLIC_BLOCK.finditer(text)]
    if "://" in text:
        for m in _ADDRESS.finditer(text):
            if not excluded(m.group(1)):
                add([m.span(1)])
    for m in _FORMATS.finditer(text):
        if formed_secret(m.group(0)):
            add([m.span()])
    if re.search("(?i)authorization", text):
        for m in _HEADER.finditer(text):
            if not excluded(m.group(1)) and len(m.group(1)) >= 6 and entropy(m.group(1)) >= 2.0 and (any(c.isdigit() for c in m.group(1)) or named_secret(m.group(1))):
                add([m.span(1)])
    for m in _LOGIN.finditer(text):
        if _in_comment(text, m.start()) and named_secret(m.group(1)):
            add([m.span(1)])
    config = extension in _CONFIG
    seen = -1
    for core in _CORE.finditer(text):
        if core.start() < seen:
            continue
        begin = core.start()
        while begin and (text[begin - 1].isalnum() or text[begin - 1] in "_.-"):
            begin -= 1
        end = _NAME_CHARS.match(text, core.end()).end()
        seen = end
        name = text[begin:end].rstrip(".-")
        if not calls_secret(name):
            continue
        stop = text.find("\n", end)
        stop = len(text) if stop < 0 else stop
        if stop and text[stop - 1 : stop] == "\r":
            stop -= 1
        own = config or text[text.rfind("\n", 0, begin) + 1 : begin].strip() == "export"
        parts = list(_values_after(text, begin + len(name), stop, own))
        if not parts:
            # a name in a comment behind the literal
            line = text.rfind("\n", 0, begin) + 1
            tail = _COMMENT_NAME.search(text, line, stop)
            if tail and tail.start(1) <= begin < tail.end(1):
                quoted = list(_QUOTED.finditer(text, line, tail.start()))
                if quoted:
                    parts = [quoted[-1].span(2)]
                    for q in reversed(quoted[:-1]):
                        if re.fullmatch(r"\s*\+?\s*", text[q.end() : quoted[-1].start()]):
                            parts.insert(0, q.span(2))
                            quoted = quoted[: quoted.index(q) + 1]
        value = "".join(text[a:b] for a, b in parts)
        if not parts and (m := _QUERY.match(text, begin + len(name), stop)) and begin and text[begin - 1] in ";\"'&?":
            # a connection string or the query of an address
            parts, value = [m.span(1)], m.group(1)
        if parts and named_secret(value, name.lower().endswith(("pass", "word", "phrase", "passwd", "pwd"))):
            add(parts)
    for m in _JOINED.finditer(text):
        parts = [(p.start(2), p.end(2)) for p in _PIECE.finditer(m.group(0))]
        value = "".join(m.group(0)[a:b] for a, b in parts)
        if _FORMATS.fullmatch(value) and formed_secret(value) or free_secret(value) or (u := _ADDRESS.match(value)) and not excluded(u.group(1)):
            add([(m.start() + a, m.start() + b) for a, b in parts])
    for m in _QUOTED.finditer(text):
        if m.end(2) - m.start(2) >= 12 and quoted_secret(m.group(2)):
            add([m.span(2)])
    for m in _LONG.finditer(text):
        if free_secret(m.group(0)):
            add([m.span()])
    return sorted(found)


def redact(text: str, secrets: list[list[Span]]) -> str:
    """The text with each literal part replaced; quotes, line ends, the marks of key blocks and everything else stay."""
    out, at = [], 0
    for a, b in sorted(s for parts in secrets for s in parts if s[0] < s[1]):
        out += [text[at:a], REDACTED]
        at = b
    return "".join(out) + text[at:]


def _scan(batches: Iterator[pa.RecordBatch]):
    for batch in batches:
        yield [(key, text, find(text, (path or "").rsplit(".", 1)[-1].lower())) for key, path, text in zip(*(batch.column(k).to_pylist() for k in range(3)))]


def found_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in _scan(batches):
        out = sorted({(key, text.count("\n", 0, parts[0][0]) + 1) for key, text, secrets in rows for parts in secrets})
        yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.int32())], names=["block_key", "line_no"])


def redacted_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in _scan(batches):
        out = [(key, len(secrets), redact(text, secrets)) for key, text, secrets in rows if secrets]
        yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate((pa.int64(), pa.int32(), pa.string()))], names=["block_key", "n_secrets", "content"])


def _input(blocks: DataFrame) -> DataFrame:
    return blocks.where(F.col("block_key").isNotNull() & (F.length("content") > 0)).select(F.col("block_key").cast("long").alias("block_key"), "file_path", "content")


def secret_lines(blocks: DataFrame) -> DataFrame:
    """(block_key, line_no): lines, from 1, on which a credential begins. Distinct, so a redelivered block counts once.

    Null and empty contents have none.
    """
    return _input(blocks).mapInArrow(found_rows, "block_key long, line_no int").distinct()


def redacted(blocks: DataFrame) -> DataFrame:
    """(block_key, n_secrets, content) of the blocks with credentials, these replaced. Distinct."""
    return _input(blocks).mapInArrow(redacted_rows, "block_key long, n_secrets int, content string").distinct()
