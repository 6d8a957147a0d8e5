"""URL patterns: globs and regular expressions, as native predicates."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def glob_regex(glob: str) -> str:
    """The regular expression of a glob: `*` and `?` stay within a path segment, `**` spans segments, `{a,b}` are
    alternatives (an empty one is allowed), `[...]` a class; letter case doesn't count. ValueError if it's empty."""
    glob = glob.strip()
    if not glob:
        raise ValueError("a glob must not be empty")
    out, i, depth = [], 0, 0
    while i < len(glob):
        c = glob[i]
        if c == "*":
            if glob[i : i + 2] == "**":
                i += 1
                at_start = i == 1 or glob[i - 2] == "/"
                if at_start and glob[i + 1 : i + 2] == "/":
                    out.append("(?:.*/)?")
                    i += 1
                else:
                    out.append(".*")
            else:
                out.append("[^/]*")
        elif c == "?":
            out.append("[^/]")
        elif c == "{":
            depth += 1
            out.append("(?:")
        elif c == "}" and depth:
            depth -= 1
            out.append(")")
        elif c == "," and depth:
            out.append("|")
        elif c == "[" and "]" in glob[i + 2 :]:
            end = glob.index("]", i + 2)
            body = glob[i + 1 : end].replace("\\", "\\\\")
            out.append(f"[{'^' + body[1:] if body[0] in '!^' else body}]")
            i = end
        elif c == "\\" and i + 1 < len(glob):
            i += 1
            out.append(re.escape(glob[i]))
        else:
            out.append(re.escape(c))
        i += 1
    if depth:
        raise ValueError(f"an alternative isn't closed in {glob!r}")
    return f"(?is)^{''.join(out)}$"


def check_regex(pattern: str) -> str:
    """The pattern, if it's one that needs no looking around and no back-references; else ValueError."""
    if re.search(r"\(\?(?:[=!]|<[=!])|\\[1-9]|\(\?P=|\\k<", pattern):
        raise ValueError("look-around and back-references aren't supported")
    re.compile(pattern)
    return pattern


def url_matches(url: Column, globs: Sequence[str] = (), regexes: Sequence[str] = ()) -> Column:
    """Whether a URL matches any glob (as a whole) or any regular expression (anywhere)."""
    tests = [url.rlike(glob_regex(g)) for g in globs] + [url.rlike(check_regex(r)) for r in regexes]
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def passes(url: Column, include: Sequence[str] = (), exclude: Sequence[str] = (), include_regex: Sequence[str] = (), exclude_regex: Sequence[str] = ()) -> Column:
    """Excluded by any pattern: no; else, where there are includes, one has to match."""
    out = ~url_matches(url, exclude, exclude_regex)
    return out & url_matches(url, include, include_regex) if include or include_regex else out
