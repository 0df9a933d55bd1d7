"""Scalar functions over columns: times kept as text, hashing, text shaping, JSON fallbacks, costs."""

from __future__ import annotations

from collections.abc import Callable

import json
import os
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def timestamp(text: Column) -> Column:
    """Timestamp of ``YYYY-MM-DD hh:mm:ss`` or RFC 3339 text; null if it is neither."""
    return F.try_to_timestamp(text)


def epoch_seconds(text: Column) -> Column:
    return F.unix_timestamp(timestamp(text))


def day(text: Column) -> Column:
    """UTC date of a text time, whatever its offset."""
    return F.to_date(timestamp(text))


def seconds_between(start: Column, end: Column) -> Column:
    """Whole seconds; sub-seconds of either side are ignored. Null if either is missing."""
    return epoch_seconds(end) - epoch_seconds(start)


def since_text(created_at: Column, since: str) -> Column:
    """Range filter as text compares: with an RFC 3339 bound, rows written as
    ``YYYY-MM-DD hh:mm:ss`` on the day of the bound are excluded, a space sorting before ``T``."""
    return created_at >= F.lit(since)


def sha256_text(*parts: Column) -> Column:
    """Lowercase hex of the parts joined without a separator (null: empty)."""
    return F.sha2(F.concat(*[F.coalesce(p.cast("string"), F.lit("")) for p in parts]).cast("binary"), 256)


def chunk_id(path: Column, kind: Column, name: Column, line_start: Column) -> Column:
    return sha256_text(path, kind, name, line_start)


def truncate_bytes(text: Column, n: int, ellipsis: str = "") -> Column:
    """At most ``n`` bytes of UTF-8, then ``ellipsis`` if something was cut; a character cut in two goes."""

    heads = [F.substring(text.cast("binary"), 1, n - k).cast("string") for k in range(min(n, 3) + 1)]  # a character has four bytes at most
    cut = F.coalesce(*[F.when(F.is_valid_utf8(h), h) for h in heads], F.lit(""))
    return F.when(F.octet_length(text) > n, F.concat(cut, F.lit(ellipsis))).otherwise(text)


def slug(title: Column, most: int = 50) -> Column:
    """Lowercase letters and digits with single hyphens, cut at the last hyphen within ``most``."""
    s = F.trim(F.regexp_replace(F.lower(title), "[^a-z0-9]+", "-"), F.lit("-"))
    head = F.substring(s, 1, most)
    at_hyphen = F.regexp_replace(head, "-[^-]*$", "")
    return F.when(F.length(s) <= most, s).otherwise(F.rtrim(F.when(F.contains(head, F.lit("-")), at_hyphen).otherwise(head), F.lit("-")))


def title_of(yaml_text: Column, fallback: Column) -> Column:
    """The first ``title:`` line with a value, unquoted; else ``fallback``."""
    lines = F.transform(F.filter(F.split(F.coalesce(yaml_text, F.lit("")), "\n"), lambda x: F.ltrim(x).startswith("title:")), lambda x: F.trim(F.regexp_replace(F.trim(F.regexp_replace(x, r"^\s*title:", "")), "^[\"']|[\"']$", "")))
    return F.coalesce(F.get(F.filter(lines, lambda x: x != ""), F.lit(0)), fallback)


def strip_code_fence(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(text), r"^```[^\n]*\n?", ""), r"\n?```$", ""))


def outermost(text: Column, opens: str = "{", closes: str = "}") -> Column:
    """From the first ``opens`` to the last ``closes``; null if there is no such span."""
    start = F.instr(text, opens)
    end = F.length(text) - F.instr(F.reverse(text), closes) + 1
    return F.when((start > 0) & (F.instr(text, closes) > 0) & (end > start), F.substring(text, start, end - start + 1))


def json_or_text(text: Column) -> Column:
    """Compact JSON, or the text as it is where it is not JSON."""
    return F.coalesce(F.to_json(F.try_parse_json(text)), text)


def list_or_single(text: Column) -> Column:
    """A JSON list of strings, or the text as the only element; null for empty text."""
    whole = F.from_json(text, "array<string>")
    return F.when(F.coalesce(F.trim(text), F.lit("")) == "", F.lit(None).cast("array<string>")).otherwise(F.when(F.ltrim(text).startswith("["), F.coalesce(whole, F.array(text))).otherwise(F.array(text)))


def merge_json(payload: Column, workflow_id: Column, task_id: Column, session_id: Column) -> Column:
    """An event's payload with its ids: those of workflow and task overwrite, the session's only fills in."""

    @F.pandas_udf("string")
    def merge(p: pd.Series, w: pd.Series, t: pd.Series, s: pd.Series) -> pd.Series:
        def one(raw, workflow, task, session):
            try:
                held = json.loads(raw) if raw else {}
            except ValueError:
                return raw
            if not isinstance(held, dict):
                return raw
            held |= {k: v for k, v in (("workflow_id", workflow), ("task_id", task)) if v}
            if session:
                held.setdefault("session_id", session)
            return json.dumps(held, sort_keys=True, separators=(",", ":"))

        return pd.Series([one(*x) for x in zip(p, w, t, s)])

    return merge(payload, workflow_id, task_id, session_id)


#: Keys of a tool's input that sum it up, the first present one counting (fixed values).
SUMMARY_KEYS = ("file_path", "command", "pattern", "query", "url")


def tool_summary(tool_input: Column, most: int = 80) -> Column:
    """The first of ``SUMMARY_KEYS`` in a JSON object, cut to ``most`` bytes."""
    return truncate_bytes(F.coalesce(*[F.get_json_object(tool_input, f"$.{k}") for k in SUMMARY_KEYS], F.lit("")), most, "...")


def delta(a: Column, b: Column) -> Column:
    return a - b


def percent(part: Column, total: Column) -> Column:
    """Integer per cent, truncated; 0 where the total is 0."""
    return F.when(total == 0, F.lit(0).cast("long")).otherwise(F.floor(part * 100 / total).cast("long"))


def share(part: Column, total: Column) -> Column:
    """Ratio; 0 where the total is 0."""
    return F.when(total == 0, F.lit(0.0)).otherwise(part / total)


def cost_usd(tokens_in: Column, tokens_out: Column, per_million_in: Column, per_million_out: Column) -> Column:
    return (tokens_in * per_million_in + tokens_out * per_million_out) / F.lit(1e6)


def effective_input(tokens: Column, cache_read: Column, cache_creation: Column) -> Column:
    zero = F.lit(0).cast("long")
    return F.coalesce(tokens, zero) + F.coalesce(cache_read, zero) + F.coalesce(cache_creation, zero)


#: Results of a criterion (fixed values).
RESULTS = ("met", "unmet", "unassessable")


def result_kind(raw: Column) -> Column:
    """``met``, ``unmet`` or ``unassessable``, which stands for anything else too."""
    kind = F.lower(F.trim(raw))
    return F.when(kind.isin(*RESULTS), kind).otherwise(F.lit("unassessable"))


def criterion_key(id_: Column, description: Column) -> Column:
    """By id if there is one, else by description; case and outer space don't count."""
    named = F.nullif(F.trim(id_), F.lit(""))
    return F.coalesce(F.concat(F.lit("id:"), F.lower(named)), F.concat(F.lit("description:"), F.lower(F.trim(F.coalesce(description, F.lit(""))))))


def test_base(path: Column) -> Column:
    """The Go source that a path stands for, its test counterpart included; empty for other files."""
    return F.when(path.endswith("_test.go"), F.regexp_replace(path, r"_test\.go$", ".go")).when(path.endswith(".go"), path).otherwise(F.lit(""))


def diff_path(header: Column) -> Column:
    """The text after the first `` b/`` of a diff's header line."""
    return F.regexp_extract(header, r"^.*? b/(.*)$", 1)


def path_suffixes(directory: Column) -> Column:
    """``a/b/c`` gives ``a/b/c``, ``b/c`` and ``c``."""
    parts = F.split(F.trim(directory, F.lit("/")), "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))


def symbol_id(language: Column, package: Column, kind: Column, name: Column) -> Column:
    return F.concat_ws(":", *[F.coalesce(x, F.lit("")) for x in (language, package, kind, name)])


#: Languages by file extension (fixed values).
LANGUAGES = {".go": "go", ".md": "markdown", ".ts": "typescript", ".tsx": "tsx", ".py": "python"}


def language_of(path: Column) -> Column:
    """By extension, whose case counts; empty for others."""
    ext = F.regexp_extract(path, r"(\.[^./]*)$", 1)
    out = F.lit("")
    for suffix, name in LANGUAGES.items():
        out = F.when(ext == suffix, name).otherwise(out)
    return out


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with the value worked out once however often ``use`` names it."""
    return F.transform(F.array(value), use)[0]


def clean_path(path: Column) -> Column:
    """The shortest path of the same place: empty and ``.`` segments go, ``..`` takes the segment before it along; ``.`` if nothing is left."""

    def add(held: Column, part: Column) -> Column:
        up = (part == "..") & (F.size(held) > 0) & (F.coalesce(F.element_at(held, F.greatest(F.size(held), F.lit(1))), F.lit("")) != "..")
        return F.when(part.isin("", "."), held).when(up, F.slice(held, F.lit(1), F.size(held) - 1)).otherwise(F.concat(held, F.array(part)))

    rooted = path.startswith("/")
    parts = F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), add)
    parts = F.when(rooted, F.filter(parts, lambda p: p != "..")).otherwise(parts)
    joined = F.array_join(parts, "/")
    return once(joined, lambda j: F.when(rooted, F.concat(F.lit("/"), j)).when(j == "", ".").otherwise(j))


def file_set(paths: Column) -> Column:
    """Trimmed, cleaned, sorted paths in one text; empty for fewer than two. A path named twice counts twice."""
    named = F.filter(F.transform(paths, lambda p: F.trim(p)), lambda p: p != "")
    clean = F.array_sort(F.transform(named, clean_path))
    return once(clean, lambda c: F.when(F.size(c) < 2, F.lit("")).otherwise(F.array_join(c, "|")))


def human_duration(seconds: Column) -> Column:
    """``42s``, ``3m 5s`` or ``2h 7m``; a second part of zero is left out (``3m``, ``2h``)."""
    s = seconds.cast("long")
    m, h = F.floor(s / 60), F.floor(s / 3600)

    def two(big: Column, a: str, small: Column, b: str) -> Column:
        return F.when(small > 0, F.format_string(f"%d{a} %d{b}", big, small)).otherwise(F.format_string(f"%d{a}", big))

    return F.when(s.isNull(), F.lit("-")).when(s < 60, F.format_string("%ds", s)).when(m < 60, two(m, "m", s % 60, "s")).otherwise(two(h, "h", m % 60, "m"))


def chart_duration(seconds: Column) -> Column:
    """``3m 0s``, or ``42s`` under a minute; seconds are rounded half up, minutes are not."""
    m, s = F.floor(seconds / 60), F.floor(seconds % 60 + 0.5)
    return F.when(m > 0, F.format_string("%dm %ds", m, s)).otherwise(F.format_string("%ds", s))


def chart_money(usd: Column) -> Column:
    return F.format_string("$%.2f", usd)


def chart_percent(part: Column) -> Column:
    return F.format_string("%.1f%%", part * 100)


def money(usd: Column) -> Column:
    return F.format_string("$%.4f", usd)


def thousands(n: Column) -> Column:
    return F.format_number(n, 0)


def like_prefix(column: Column, prefix: str) -> Column:
    """Prefix match in which ``_`` and ``%`` of the prefix stay wildcards; ASCII case doesn't count."""
    return column.ilike(prefix + "%")


def glob_pattern(glob: str) -> str:
    """Regular expression of a path glob.

    ``dir/`` takes all below a directory of that name, at any depth. ``*`` and ``?`` stay within a segment,
    ``[a-z]`` and ``[^a-z]`` are classes, a backslash takes the next character as it is. A leading ``**/``
    stands for any directories or none; elsewhere two stars are as one. A pattern that is malformed takes nothing.
    """
    if glob.endswith("/"):
        return f"(^|/){re.escape(glob[:-1].removeprefix('**/'))}/"
    lead, rest, out = ("(?:.*/)?", glob[3:], "") if glob.startswith("**/") else ("", glob, "")
    while rest:
        c = rest[0]
        if c == "[":
            m = re.match(r"\[(\^?)((?:\\.|[^\]\\])+)\]", rest)
            if not m:
                return "(?!)"
            body = re.sub(r"([\[&~^])", r"\\\1", m[2])
            out, rest = out + f"[{m[1]}{body}]", rest[m.end() :]
            continue
        if c == "\\":
            if len(rest) == 1:
                return "(?!)"
            out, rest = out + re.escape(rest[1]), rest[2:]
            continue
        out, rest = out + {"*": "[^/]*", "?": "[^/]"}.get(c, re.escape(c)), rest[1:]
    return f"^{lead}{out}$"


def matches_glob(path: Column, globs: list[str]) -> Column:
    hit = F.lit(False)
    for g in globs:
        hit = hit | path.rlike(glob_pattern(g))
    return hit


def expand_env(value: str) -> str:
    """``${NAME}`` of a setting replaced by the environment's value, missing ones by nothing."""
    return re.sub(r"\$\{(\w+)\}", lambda m: os.environ.get(m[1], ""), value)
