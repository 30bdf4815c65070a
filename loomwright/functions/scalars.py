"""Scalar column functions of change-impact analysis."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names too common to identify a function, and file names too common to identify a file.
STOP_NAMES = ["new", "default", "from", "into", "clone", "build", "run", "get", "set", "len", "is_empty", "iter", "map", "unwrap", "expect", "to_string", "as_ref", "fmt", "eq", "hash"]
COMMON_FILES = ["mod.rs", "lib.rs", "main.rs", "README.md", "AGENTS.md", "Cargo.toml", "index.html"]


def overlaps(a: Column, b: Column, start: Column, end: Column) -> Column:
    """Inclusive ranges [a, b] and [start, end] have a common point."""
    return (a <= end) & (start <= b)


def item_key(owner: Column, name: Column) -> Column:
    """``Owner::name``, or the name without an owner."""
    return F.concat_ws("::", owner, name)


def keyable(name: Column) -> Column:
    """A name with three characters or more that is not a stop name."""
    return (F.length(name) >= 3) & ~name.isin(STOP_NAMES)


def distinctive(basename: Column) -> Column:
    """A file name of five bytes or more with a dot inside."""
    return (F.octet_length(basename) >= 5) & basename.rlike("^.+[.][^.]+$") & ~basename.isin(COMMON_FILES)


def clean_item(path: Column) -> Column:
    """Last ``::`` segment of a path, without ``!``, ``r#`` and generics."""
    last = F.trim(F.element_at(F.split(F.substring_index(path, "<", 1), "::"), -1))
    return F.regexp_replace(F.regexp_replace(last, "!$", ""), "^r#", "")


def view_score(names: Column, body: Column, bonus: Column) -> Column:
    """The better view plus bonus, 1 at most; null if no view answered (least() alone would say 1)."""
    return F.when(names.isNotNull() | body.isNotNull(), F.least(F.greatest(names, body) + bonus, F.lit(1.0)))


def module_path(file: Column) -> Column:
    """Module segments, joined by ``::``, of a source file's place in its package."""
    parts = F.split(file, "/")
    n = F.size(parts)
    rest = (
        F.when((F.get(parts, F.lit(0)) == "src") & (F.get(parts, F.lit(1)) == "bin") & (n >= 3), F.when(n == 3, F.array().cast("array<string>")).otherwise(F.slice(parts, 4, F.greatest(n - 3, F.lit(0)))))
        .when((F.get(parts, F.lit(0)) == "tests") & (n >= 2), F.when(n == 2, F.array().cast("array<string>")).otherwise(F.slice(parts, 3, F.greatest(n - 2, F.lit(0)))))
        .when(F.get(parts, F.lit(0)) == "src", F.slice(parts, 2, F.greatest(n - 1, F.lit(0))))
        .otherwise(F.array().cast("array<string>"))
    )
    named = F.transform(rest, lambda s: F.regexp_replace(s, r"\.rs$", ""))
    last = F.get(named, F.size(named) - 1)
    dropped = F.slice(named, 1, F.greatest(F.size(named) - 1, F.lit(0)))
    return F.array_join(F.when((last == "mod") | (last.isin("lib", "main") & (F.size(named) == 1)), dropped).otherwise(named), "::")


def shell_quote(text: Column) -> Column:
    """Text as one shell word."""
    plain = text.rlike("^[A-Za-z0-9_./:=@%+,-]+$")
    return F.when(plain, text).otherwise(F.concat(F.lit("'"), F.replace(text, F.lit("'"), F.lit("'\\''")), F.lit("'")))


def chained_sha(*parts: Column) -> Column:
    """SHA-256 over parts that are each ended by a zero byte, in lower-case hex."""
    zero = F.encode(F.lit("\0"), "UTF-8")
    return F.sha2(F.concat(*(x for p in parts for x in (F.encode(p, "UTF-8"), zero))), 256)


def path_components(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda s: ~s.isin("", ".", ".."))


def names_term(package: Column, names: Column) -> Column:
    """A filter term for test names (sorted, distinct) of a package."""
    return F.format_string("package(=%s) & test(/(^|::)(%s)($|::)/)", package, F.array_join(F.array_sort(F.array_distinct(names)), "|"))


def snippet(text: Column, start: Column, end: Column) -> Column:
    """Lines start to end (from 1, inclusive) of a text, each trimmed, joined by spaces."""
    lines = F.transform(F.split(line_slice(text, start, end), "\n"), lambda s: F.regexp_replace(s, r"^\s+|\s+$", ""))
    return F.array_join(lines, " ")


def filter_packages(expression: Column) -> Column:
    """Package names that a filter expression mentions."""
    return F.filter(F.regexp_extract_all(expression, F.lit(r"package\(\s*=*\s*([^)]*?)\s*(?:\)|$)"), F.lit(1)), lambda p: p != "")


def and_more(items: Column, most: int) -> Column:
    """The first ``most`` items joined, and how many are left out."""
    more = F.when(F.size(items) > most, F.concat(F.lit(" and "), (F.size(items) - most).cast("string"), F.lit(" more"))).otherwise("")
    return F.concat(F.array_join(F.slice(items, 1, most), ", "), more)


def glob_regex(pattern: str, strict: bool) -> str:
    """A glob as an anchored regex. ``strict``: ``*`` and ``?`` stop at ``/``; only ``**`` as a whole component crosses it.
    A backslash takes the next character as it is; braces may stand in braces."""
    return f"(?s)^{_glob_body(pattern, strict)}$"


def _glob_body(pattern: str, strict: bool) -> str:
    out, i, depth = "", 0, 0
    step = "[^/]" if strict else "."
    while i < len(pattern):
        c, first = pattern[i], i == 0 or pattern[i - 1] in "/{,"
        if first and pattern.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif pattern.startswith("**", i):
            run = len(pattern) - i - len(pattern[i:].lstrip("*"))
            whole = first and run == 2 and (i + 2 == len(pattern) or pattern[i + 2] in ",}")
            out, i = out + ("." if whole else step) + "*", i + run
        elif c == "*":
            out, i = out + step + "*", i + 1
        elif c == "?":
            out, i = out + step, i + 1
        elif c == "[" and (end := pattern.find("]", i + 2)) > 0:
            inside = pattern[i + 1 : end]
            out, i = out + "[" + ("^" + inside[1:] if inside[0] in "!^" else inside).replace("\\", "\\\\") + "]", end + 1
        elif c == "{":
            out, i, depth = out + "(?:", i + 1, depth + 1
        elif c == "}" and depth:
            out, i, depth = out + ")", i + 1, depth - 1
        elif c == "," and depth:
            out, i = out + "|", i + 1
        elif c == "\\" and i + 1 < len(pattern):
            out, i = out + re.escape(pattern[i + 1]), i + 2
        else:
            out, i = out + re.escape(c), i + 1
    return out


def matches_any(path: Column, patterns: list[str], strict: bool) -> Column:
    """A path matches one of the globs; the loose dialect also takes everything under a pattern."""
    every = patterns if strict else [x for p in patterns for x in (p, f"{p.rstrip('/')}/**")]
    out = F.lit(False)
    for p in every:
        out = out | path.rlike(glob_regex(p, strict))
    return out


def qualified(*parts: Column) -> Column:
    """Path segments joined by ``::``, without empty ones."""
    return F.array_join(F.filter(F.array_compact(F.array(*parts)), lambda s: s != ""), "::")


def test_key(binary: Column, name: Column) -> Column:
    """A name for a test that a file may have, different for different tests: letters, digits and _ stay, other bytes
    become ~ and their hex; a long one is cut and ends in a hash."""
    raw = F.concat(binary, F.lit("$"), name)
    octets = F.transform(F.sequence(F.lit(1), F.octet_length(raw)), lambda i: F.lower(F.hex(F.substring(F.encode(raw, "UTF-8"), i, F.lit(1)))))
    plain = F.array_join(F.transform(octets, lambda h: F.when(F.decode(F.unhex(h), "ISO-8859-1").rlike("^[A-Za-z0-9_]$"), F.decode(F.unhex(h), "ISO-8859-1")).otherwise(F.concat(F.lit("~"), h))), "")
    return F.when(F.length(plain) > 180, F.concat(F.substring(plain, 1, 100), F.lit("~"), F.substring(F.sha2(raw, 256), 1, 20))).otherwise(plain)


def rfc3339(at: Column) -> Column:
    """A time in UTC to the second."""
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def parse_rfc3339(text: Column) -> Column:
    """The time of such a text; null for any other."""
    return F.try_to_timestamp(text, F.lit("yyyy-MM-dd'T'HH:mm:ss'Z'"))


def counted(n: Column, word: str) -> Column:
    """``1 word`` or ``n words``."""
    return F.concat_ws(" ", n.cast("string"), F.when(n == 1, word).otherwise(f"{word}s"))


def line_slice(text: Column, start: Column, end: Column) -> Column:
    """Lines start to end (from 1, inclusive) of a text."""
    return F.array_join(F.slice(F.split(text, "\n"), F.greatest(start, F.lit(1)), F.greatest(end - F.greatest(start, F.lit(1)) + 1, F.lit(0))), "\n")


def captures(text: Column) -> Column:
    """Names in braces of a format string; doubled braces are text."""
    return F.regexp_extract_all(F.regexp_replace(text, r"\{\{", " "), F.lit(r"\{([A-Za-z_][A-Za-z0-9_]*)[}:]"), F.lit(1))


def truncated(text: Column, most: int) -> Column:
    """The first characters of a text."""
    return F.substring(text, 1, most)


def either_side(new: Column, old: Column) -> Column:
    """The distinct paths of a change, the new one first."""
    return F.array_distinct(F.array_compact(F.array(new, old)))


def _once(value: Column, use) -> Column:  # noqa: ANN001
    return F.get(F.transform(F.array(value), use), F.lit(0))


def path_segments(symbol: Column) -> Column:
    """The segments of a path between ``::`` outside of angle brackets; the ``>`` of an arrow closes none. One fold over the
    characters holds the depth, the segment so far and the character before."""
    start = F.struct(F.lit(0).alias("depth"), F.lit("").alias("before"), F.lit("").alias("now"), F.array().cast("array<string>").alias("done"))

    def step(s: Column, c: Column) -> Column:
        depth = s["depth"] + F.when(c == "<", 1).when((c == ">") & (s["before"] != "-"), -1).otherwise(0)
        ends = (s["depth"] == 0) & (c == ":") & (s["before"] == ":")
        whole = F.substring(s["now"], 1, F.length(s["now"]) - 1)  # without the first of the two colons
        return F.struct(depth.alias("depth"), F.when(ends, "").otherwise(c).alias("before"), F.when(ends, "").otherwise(F.concat(s["now"], c)).alias("now"), F.when(ends, F.array_append(s["done"], whole)).otherwise(s["done"]).alias("done"))

    return F.aggregate(F.filter(F.split(symbol, ""), lambda c: c != ""), start, step, lambda s: F.array_append(s["done"], s["now"]))


def _owner(segment: Column) -> Column:
    """The type's name in ``<type>`` or ``<type as trait>``."""
    inner = F.substring_index(F.substring(segment, 2, F.length(segment) - 2), " as ", 1)
    return F.substring_index(F.substring_index(F.regexp_replace(inner, "^&*(?:mut )*(?:dyn )*", ""), "<", 1), "::", -1)


def symbol_item(symbol: Column) -> Column:
    """The item ``Type::method`` or ``name`` of a readable symbol: what a closure stands in, without generic arguments.
    A ``file;`` in front is dropped; a symbol without any name stays as it is."""
    readable = F.substring_index(symbol, ";", -1)
    bracketed = lambda s: s.startswith("<") & s.endswith(">") & (F.length(s) >= 2)

    def of(z: Column) -> Column:
        first, path = F.get(z["segments"], F.lit(0)), F.filter(z["segments"], lambda s: ~bracketed(s))
        owner = F.when(bracketed(first), _owner(first))

        def named(p: Column) -> Column:
            name, above = F.get(p, F.size(p) - 1), F.get(p, F.size(p) - 2)
            typed = F.when(owner.isNotNull() & (F.size(p) == 1), owner).when((F.size(p) >= 2) & above.rlike("^[A-Z]"), above)
            return F.when(F.size(p) == 0, z["readable"]).otherwise(F.concat_ws("::", typed, name))

        return _once(path, named)

    def outer(segments: Column) -> Column:
        closure = F.array_position(F.transform(segments, lambda s: s.startswith("{")), True)
        return F.when(closure > 0, F.slice(segments, 1, (closure - 1).cast("int"))).otherwise(segments)

    return _once(path_segments(readable), lambda g: _once(F.struct(outer(g).alias("segments"), readable.alias("readable")), of))


def clean_owner(path: Column) -> Column:
    """The name of a type as an owner: its last ``::`` segment, without references, generics and ``r#``."""
    bare = F.regexp_replace(F.trim(path), r"^(?:&\s*(?:'\w+\s+)?|mut\s+|dyn\s+)*", "")
    return F.regexp_replace(F.trim(F.substring_index(F.substring_index(bare, "<", 1), "::", -1)), "^r#", "")
