"""Column functions over qualified names (`module::scope.name`), paths, globs and signatures."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

SIGNATURE_CHARS = 160


def short(q: Column) -> Column:
    """The text after the last dot, then after the last `::`."""
    return F.substring_index(F.substring_index(q, ".", -1), "::", -1)


def module(q: Column) -> Column:
    return F.substring_index(q, "::", 1)


def join(module_: Column, name: Column, scope: Column | None = None) -> Column:
    """scope.name under a scope, else module::name."""
    plain = F.concat_ws("::", module_, name)
    return plain if scope is None else F.when(scope.isNotNull(), F.concat_ws(".", scope, name)).otherwise(plain)


def member(target: Column, name: Column) -> Column:
    """Appends a member: with a dot once the target is inside a module."""
    return F.when(target.contains("::"), F.concat_ws(".", target, name)).otherwise(F.concat_ws("::", target, name))


def cap_signature(s: Column) -> Column:
    s = F.coalesce(s, F.lit(""))
    return F.when(F.char_length(s) > SIGNATURE_CHARS, F.concat(F.substring(s, 1, SIGNATURE_CHARS), F.lit("…"))).otherwise(s)


def glob_regex(pattern: str) -> str:
    """A glob with *, ? and [sets] as an anchored regular expression."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[" and (end := pattern.find("]", i + 2)) > 0:
            body = pattern[i + 1 : end].replace("\\", "\\\\")
            out.append("[" + ("^" + body[1:] if body[0] == "!" else body) + "]")
            i = end
        else:
            out.append(re.escape(c))
        i += 1
    return f"^(?s:{''.join(out)})$"


def glob_match(c: Column, patterns: list[str]) -> Column:
    """Whether any pattern matches; none matches nothing."""
    return c.rlike("|".join(glob_regex(p) for p in patterns)) if patterns else F.lit(False)


def posix(path: Column) -> Column:
    """Backslashes as slashes, without a leading ./"""
    return F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), r"^\./", "")


def join_route(prefix: Column, path: Column) -> Column:
    """A class prefix and a method path with one slash between; an empty method path is the prefix."""
    left, right = F.rtrim(prefix, F.lit("/")), F.ltrim(path, F.lit("/"))
    return F.when(right == "", F.when(left == "", F.lit("/")).otherwise(left)).otherwise(F.concat(left, F.lit("/"), right))


def json_list(c: Column) -> Column:
    """A JSON list of strings; null, malformed and other JSON give an empty list."""
    return F.coalesce(F.from_json(c, "array<string>", {"mode": "PERMISSIVE"}), F.array().cast("array<string>"))


def _plain_letters() -> tuple[str, str]:
    """Lower-case Latin letters with one mark, and the letters without it, by their decomposition."""
    pairs = [(chr(c), unicodedata.normalize("NFD", chr(c))) for c in range(0xE0, 0x250)]
    pairs = [(c, d[0]) for c, d in pairs if len(d) > 1 and "a" <= d[0] <= "z" and c == c.lower()]
    return "".join(c for c, _ in pairs), "".join(d for _, d in pairs)


def fold(text: Column) -> Column:
    """Lower case, Latin letters without their marks."""
    return F.translate(F.regexp_replace(F.lower(text), r"\p{M}", ""), *_plain_letters())


def normal_tokens(text: Column) -> Column:
    """Folded alphanumeric runs."""
    return F.filter(F.split(fold(text), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def register_functions(spark) -> None:
    """SQL functions qname_short, qname_module and glob_match, as SQL expressions without Python."""
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION qname_short(q STRING) RETURNS STRING RETURN substring_index(substring_index(q, '.', -1), '::', -1)")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION qname_module(q STRING) RETURNS STRING RETURN substring_index(q, '::', 1)")
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION glob_match(s STRING, g STRING) RETURNS BOOLEAN RETURN "
        "s RLIKE concat('^(?s:', replace(replace(regexp_replace(g, '([.+^$(){}|\\\\\\\\])', '\\\\\\\\$1'), '*', '.*'), '?', '.'), ')$')"
    )
