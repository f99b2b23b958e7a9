"""Glob patterns as Java regular expressions.

Dialect: `*`, `?`, `[ab]`, `[!ab]`, `[a-z]`, `{a,b}`, backslash escapes, and `**/`, `/**/`,
`/**` for any number of directories. A pattern covers the whole path, with case. `*` and
`?` cross slashes unless `keep_slash` is set (as ignore files need it).
"""

import re
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Longest forms first. `open` and `sep` belong to a run of directories.
_GLOB_PART = re.compile(
    r"""(?P<lead>^(?:\*\*/)+)
      | (?P<tail>(?:/\*\*)+$)
      | (?P<mid>(?:/\*\*)+/)
      | (?P<all>^\*\*$)
      | (?P<stars>\*+)
      | (?P<one>\?)
      | (?P<cls>\[(?P<not>[!^])?(?P<members>\]?(?:[^\]])*)\])
      | (?P<open>\{) | (?P<close>\}) | (?P<comma>,)
      | \\(?P<escaped>.)
      | (?P<bad>[\[\\])
      | (?P<text>.)""",
    re.VERBOSE | re.DOTALL,
)


def _literal(text: str) -> str:
    return "".join(c if c.isalnum() or c in "_/" or ord(c) > 127 else "\\" + c for c in text)


def _char_class(pattern: str, match: re.Match) -> str:
    members = match["members"]
    if not members:
        raise ValueError(f"Invalid glob pattern '{pattern}': empty character class")
    out = []
    for low, high in re.findall(r"(.)(?:-(.))?", members, re.DOTALL):
        if high and high < low:
            raise ValueError(f"Invalid glob pattern '{pattern}': range {low}-{high} is reversed")
        out.append(_literal(low) + ("-" + _literal(high) if high else ""))
    return f"[{'^' if match['not'] else ''}{''.join(out)}]"


def glob_to_regex(pattern: str, keep_slash: bool = False) -> str:
    """Regex for one pattern. ValueError names a pattern that is not valid."""
    step = "[^/]" if keep_slash else "."
    fixed = {
        "lead": "(?:/?|.*/)",
        "mid": "(?:/|/.*/)",
        "tail": "/.*",
        "all": ".*",
        "stars": step + "*",
        "one": step,
    }
    out, depth = [], 0
    for match in _GLOB_PART.finditer(pattern):
        kind = match.lastgroup
        if match["cls"] is not None:
            out.append(("(?!/)" if keep_slash else "") + _char_class(pattern, match))
        elif kind in fixed:
            out.append(fixed[kind])
        elif kind == "open":
            depth += 1
            out.append("(?:")
        elif kind == "close":
            depth -= 1
            if depth < 0:
                raise ValueError(f"Invalid glob pattern '{pattern}': '}}' without '{{'")
            out.append(")")
        elif kind == "comma":
            out.append("|" if depth else ",")
        elif kind == "bad":
            raise ValueError(f"Invalid glob pattern '{pattern}': unfinished '{match['bad']}'")
        else:
            out.append(_literal(match[kind]))
    if depth:
        raise ValueError(f"Invalid glob pattern '{pattern}': '{{' without '}}'")
    return "".join(out)


def globs_to_regex(patterns: Iterable[str]) -> str | None:
    """One anchored alternation for a list, or None for the empty list, which matches nothing."""
    parts = [glob_to_regex(p) for p in patterns]
    return rf"(?s)\A(?:{'|'.join(parts)})\z" if parts else None


@F.arrow_udf(T.BooleanType())
def is_glob(patterns: pa.Array) -> pa.Array:
    """Whether a pattern is a glob at all; of a null, null."""

    def judged(pattern):
        try:
            glob_to_regex(pattern)
        except ValueError:
            return False
        return True

    return pa.array([None if p is None else judged(p) for p in patterns.to_pylist()], pa.bool_())
