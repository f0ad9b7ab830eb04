"""Scalar functions over columns, all inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The file name extensions of a project listing.
DEFAULT_EXTENSIONS = (".c", ".cc", ".cpp", ".cxx", ".h", ".hh", ".hpp", ".hxx", ".py", ".java", ".js", ".ts", ".go", ".toml", ".xml", ".yml", ".yaml", ".ini", ".properties", ".txt")
#: Fixed value: the extensions searched when the reference blocks name none.
FALLBACK_EXTENSIONS = (".py", ".java", ".c", ".cpp")


def tokens(text: Column) -> Column:
    """Runs of ASCII letters, digits and underscores; an empty array for null."""
    return F.coalesce(F.regexp_extract_all(text, F.lit("[A-Za-z0-9_]+"), F.lit(0)), F.array().cast("array<string>"))


def with_bigrams(words: Column) -> Column:
    """The words and, behind them, `a::b` of each adjacent pair. No element access by index, so the words are computed once."""
    n = F.size(words)
    left, right = F.slice(words, F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice(words, F.lit(2), F.greatest(n - 1, F.lit(0)))
    return F.concat(words, F.when(n > 1, F.zip_with(left, right, lambda a, b: F.concat(a, F.lit("::"), b))).otherwise(F.array().cast("array<string>")))


def grams(text: Column) -> Column:
    """The distinct tokens and token pairs of a text."""
    return F.array_distinct(with_bigrams(tokens(text)))


def least_sha1(items: Column) -> Column:
    """The least SHA-1 of the items, as lower-case hexadecimal; null for none."""
    return F.array_min(F.transform(items, lambda x: F.sha1(x.cast("binary"))))


def jaccard(a: Column, b: Column) -> Column:
    """|a and b| / |a or b| of two arrays of distinct items; 0 for two empty ones."""
    common = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - common
    return F.when(union == 0, F.lit(0.0)).otherwise(common / union)


def agreement(a: Column, b: Column) -> Column:
    """The share of places at which two signatures agree."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x) / F.size(a)


def norm_path(path: Column) -> Column:
    """Forward slashes, no empty and `.` parts, no leading slash; the case stays."""
    parts = F.filter(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), lambda p: ~p.isin("", "."))
    return F.array_join(parts, "/")


def basename(path: Column) -> Column:
    return F.substring_index(F.replace(path, F.lit("\\"), F.lit("/")), "/", -1)


def extension(path: Column) -> Column:
    """The extension with its dot, of the basename; empty for none."""
    return F.regexp_extract(basename(path), r"[^.](\.[^.]*)$", 1)


def has_extension(path: Column, extensions: tuple[str, ...] = DEFAULT_EXTENSIONS) -> Column:
    """Whether a path ends in one of the extensions; the case counts."""
    out = F.lit(False)
    for e in extensions:
        out = out | path.endswith(e)
    return out


def strip_diff_prefix(path: Column) -> Column:
    """A diff's `a/` or `b/` taken off, else leading `./`."""
    return F.when(path.rlike("^[ab]/"), F.substr(path, F.lit(3))).otherwise(F.regexp_replace(path, r"^(\./)+", ""))


def module_name(path: Column) -> Column:
    """The dotted module of a Python file: `/__init__` dropped, `module` for the root."""
    dotted = F.replace(F.regexp_replace(F.regexp_replace(norm_path(path), r"\.py$", ""), r"(^|/)__init__$", ""), F.lit("/"), F.lit("."))
    return F.when(dotted == "", "module").otherwise(dotted)


def cache_key(*parts: Column) -> Column:
    """`anon:` and 16 hexadecimal digits of the SHA-256 of the parts together; nulls count as empty."""
    whole = F.concat(*[F.coalesce(p, F.lit("")) for p in parts])
    return F.concat(F.lit("anon:"), F.substring(F.sha2(whole, 256), 1, 16))


def lines(text: Column) -> Column:
    """Lines of a text, ended by LF or CRLF."""
    return F.split(F.replace(text, F.lit("\r\n"), F.lit("\n")), "\n", -1)


def line_slice(text: Column, first: Column, last: Column) -> Column:
    """Lines first..last of a text, from 1 and both included, cut to what there is; empty if first > last."""
    all_lines = lines(text)
    begin = F.greatest(first, F.lit(1))
    return F.array_join(F.slice(all_lines, begin, F.greatest(F.least(last, F.size(all_lines)) - begin + 1, F.lit(0))), "\n")


def bullets(text: Column) -> Column:
    """The lines of a section, without their bullet signs and surrounding blanks; empty ones dropped."""
    plain = F.transform(lines(text), lambda x: F.trim(F.ltrim(F.trim(x), F.lit("-• \t"))))
    return F.coalesce(F.filter(plain, lambda x: x != ""), F.array().cast("array<string>"))


def tagged(text: Column, tag: str, default: str = "N/A") -> Column:
    """The section behind `[TAG]` up to the next tag; the default where there is none."""
    body = F.regexp_replace(F.regexp_extract(text, rf"(?s)\[{tag}\](.*?)(?=\[[A-Z_]+\]|\z)", 1), r"^\s+|\s+$", "")
    return F.when(text.contains(f"[{tag}]") & (body != ""), body).otherwise(F.lit(default))


def verdict(raw: Column) -> Column:
    """struct(has_vuln, confidence, reason) of a judge's answer.

    YES if the first line with ink begins with Y. The confidence is the first number 0..1 of the second such line, as
    written (`85%` and `.85` hold none and give 0.5). The reason is what follows, or all lines if there are no more than two.
    An empty or null answer is false with confidence 0.
    """
    ink = F.filter(lines(F.coalesce(raw, F.lit(""))), lambda x: F.trim(x) != "")
    n = F.size(ink)
    number = F.regexp_extract(F.coalesce(F.try_element_at(ink, F.lit(2)), F.lit("")), r"(?<![\d.])([01](?:\.\d+)?)(?![\d%])", 1)
    confidence = F.when(n == 0, 0.0).when(number == "", 0.5).otherwise(F.least(F.greatest(F.try_to_number(number, F.lit("9.999999999")).cast("double"), F.lit(0.0)), F.lit(1.0)))
    reason = F.when(n > 2, F.array_join(F.slice(ink, 3, F.greatest(n, F.lit(1))), "\n")).otherwise(F.array_join(ink, "\n"))
    yes = F.coalesce(F.upper(F.trim(F.try_element_at(ink, F.lit(1)))).startswith("Y"), F.lit(False))
    return F.struct(yes.alias("has_vuln"), confidence.alias("confidence"), reason.alias("reason"))


def important_ids(raw: Column) -> Column:
    """The ids of a selection answer, also fenced or wrapped in prose; null where there is no such object."""
    json = F.regexp_extract(F.regexp_replace(raw, r",(\s*[}\]])", "$1"), r"(?s)(\{.*\})", 1)
    return F.from_json(json, "important_ids array<string>")["important_ids"]


def symbol_name(text: Column) -> Column:
    """The first word behind def, function, public, private or static in the first five lines; `unknown` without one."""
    head = F.array_join(F.slice(lines(F.coalesce(text, F.lit(""))), 1, 5), "\n")
    name = F.regexp_extract(head, r"\b(def|function|public|private|static)\s+([A-Za-z0-9_]+)", 2)
    return F.when(name == "", "unknown").otherwise(name)


def symbolic_summary(path: Column, start: Column, end: Column, text: Column, width: int = 120) -> Column:
    """`path:start-end :: symbol :: snippet`: the symbol of the first five lines, and the first three lines shortened."""
    from .python import shorten

    head = F.array_join(F.slice(lines(F.coalesce(text, F.lit(""))), 1, 3), " ")
    return F.concat(F.coalesce(path, F.lit("")), F.lit(":"), F.coalesce(start.cast("string"), F.lit("?")), F.lit("-"), F.coalesce(end.cast("string"), F.lit("?")), F.lit(" :: "), symbol_name(text), F.lit(" :: "), shorten(head, F.lit(width)))


def xor_seeds(hashes: Column, num_perm: int = 64) -> Column:
    """A signature as shipped: the least SHA-1 (hexadecimal) of a set with its last byte exclusive-or each seed below num_perm.

    All its places have the least hash of the set under them, so two signatures agree everywhere or nowhere.
    """
    last = F.conv(F.right(hashes, F.lit(2)), 16, 10).cast("int")
    return F.transform(F.sequence(F.lit(0), F.lit(num_perm - 1)), lambda s: F.concat(F.left(hashes, F.length(hashes) - 2), F.lower(F.lpad(F.hex(last.bitwiseXOR(s).cast("long")), 2, "0"))))


def without_interior(name: Column) -> Column:
    """A qualified name cut at its first `<...>` segment; null where nothing is left."""
    cut = F.regexp_replace(name, r"(^|\.)<[^.]*>.*$", "")
    return F.when(cut != "", cut)


def without_scopes(name: Column) -> Column:
    """A qualified name without its control-flow segments."""
    return F.array_join(F.filter(F.split(name, r"\."), lambda s: ~s.rlike("<(if|els|while|list|dict)")), ".")


def common_suffix(a: Column, b: Column) -> Column:
    """How many characters two texts share at their ends, the case aside."""
    x, y = F.reverse(F.lower(a)), F.reverse(F.lower(b))
    n = F.least(F.length(x), F.length(y))
    differs = F.filter(F.sequence(F.lit(1), n), lambda k: F.substr(x, k, F.lit(1)) != F.substr(y, k, F.lit(1)))
    return F.when(n == 0, 0).otherwise(F.coalesce(F.try_element_at(differs, F.lit(1)) - 1, n))


def fq_name(package: Column, owner: Column, method: Column) -> Column:
    """`package.Class#method`; a null or empty package leaves no dot."""
    return F.concat(F.when(F.coalesce(package, F.lit("")) != "", F.concat(package, F.lit("."))).otherwise(""), owner, F.lit("#"), method)


def version_range(requirement: Column) -> Column:
    """struct(product, constraint) of a requirement line; comments, options and markers dropped, `*` for no constraint."""
    line = F.trim(F.regexp_replace(F.regexp_replace(requirement, r"(^|\s)#.*$", ""), r"\s*;.*$", ""))
    product = F.lower(F.regexp_replace(F.regexp_extract(line, r"^([A-Za-z0-9][\w.\-]*)", 1), "[_.]+", "-"))
    constraint = F.regexp_replace(F.regexp_extract(line, r"^[\w.\-]+\s*(?:\[[^\]]*\])?\s*\(?((?:[<>=!~]=?|===)[^)]*)\)?$", 1), r"\s+", "")
    return F.struct(product.alias("product"), F.when(constraint == "", "*").otherwise(constraint).alias("constraint"))
