"""Text and number functions with the string rules the log model needs."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters a Unicode strip removes.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# The same set inside a Java regular expression compiled with (?U).
WS = r"[\s\x1c-\x1f]"
NON_WS = r"[^\s\x1c-\x1f]"

# HTML escapes, ampersand first.
HTML_ESCAPES = (
    ("&", "&amp;"),
    ("<", "&lt;"),
    (">", "&gt;"),
    ('"', "&quot;"),
    ("'", "&#x27;"),
)


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITESPACE))


def strip_line(line: Column) -> Column:
    """The same, quick for the usual line that begins and ends with a visible ASCII character."""
    last_byte = F.substring(line.cast("binary"), -1, 1)
    tidy = line.between("!", "~") & last_byte.between(F.lit(b"!"), F.lit(b"~"))
    return F.when(tidy, line).otherwise(strip(line))


def first_of(value: Column, then) -> Column:
    """Evaluate ``value`` once and use it many times inside one expression.

    ``then`` maps the bound value to a column.  Catalyst inlines aliases, so
    without the binding an expensive parse would run once per mention.
    """
    return F.transform(F.array(value), then)[0]


def java_regex(pattern: str, ignore_case: bool = True, flags: int = 0) -> str:
    """A Python ``re`` pattern for Java's engine, Unicode-aware and ``\\n``-only dots.

    ``flags`` takes ``re.IGNORECASE``, ``re.MULTILINE``, ``re.DOTALL``,
    ``re.VERBOSE`` and ``re.ASCII``.  The pattern is compiled here first, so a
    faulty one raises on the driver; so does one with parts that Java would read
    differently.
    """
    compiled = re.compile(pattern, flags)
    # verbose patterns lose their spaces and comments here, so Java need not know
    switches = ("d" if compiled.flags & re.ASCII else "Ud") + "".join(
        letter for letter, flag in (("m", re.MULTILINE), ("s", re.DOTALL)) if compiled.flags & flag
    )
    if ignore_case or compiled.flags & re.IGNORECASE:
        switches = "i" + switches
    return f"(?{switches})" + _translated(pattern, list(compiled.groupindex), compiled.flags)


_LEADING_FLAGS = re.compile(r"\(\?[aiLmsux]+\)")
# What \s stands for in ASCII patterns, and beyond what Java's stands for in others.
_ASCII_SPACE = r" \t\n\x0b\f\r"
_MORE_SPACE = r"\x1c-\x1f"


def _translated(pattern: str, names: list[str], flags: int) -> str:
    """The pattern with everything respelled that Java spells otherwise.

    Groups lose their names for ones that Java takes; ``[`` and ``&&`` inside a
    class are escaped; ``{,n}`` becomes ``{0,n}``, a brace that is no quantifier is
    escaped; ``^`` of several lines also stands behind a last line break; ``\\s``
    takes the separators \\x1c to \\x1f, too; spaces and comments of verbose patterns
    go.  Flags for a part of the pattern are not supported.
    """
    verbose, ascii_only = bool(flags & re.VERBOSE), bool(flags & re.ASCII)
    space = _ASCII_SPACE if ascii_only else r"\s" + _MORE_SPACE
    own = {name: f"n{i}x" for i, name in enumerate(names)}
    if leading := _LEADING_FLAGS.match(pattern):
        pattern = pattern[leading.end() :]  # told by the switches already
    out: list[str] = []
    at, in_class, class_start, negated = 0, False, 0, False
    while at < len(pattern):
        rest = pattern[at:]
        char = pattern[at]
        if char == "\\":
            escape = pattern[at : at + 2]
            if escape == "\\Z" and not in_class:
                escape = "\\z"
            elif escape in ("\\N", "\\p", "\\P"):
                raise ValueError(f"pattern part {escape} is not supported: {pattern!r}")
            elif m := re.match(r"\\u[0-9a-fA-F]{4}|\\U[0-9a-fA-F]{8}|\\x[0-9a-fA-F]{2}", rest):
                at += len(m[0]) - 2
                escape = f"\\x{{{int(m[0][2:], 16):x}}}"
            elif m := re.match(r"\\0[0-7]{0,2}|\\[0-3][0-7]{2}", rest):
                at += len(m[0]) - 2
                escape = f"\\x{{{int(m[0][1:], 8):x}}}"
            elif in_class and escape == "\\b":
                escape = "\\x08"
            elif escape == "\\v":
                escape = "\\x0b"
            elif escape == "\\s":
                escape = space if in_class else f"[{space}]"
            elif escape == "\\S":
                if negated and in_class:
                    raise ValueError(f"\\S in a negated class is not supported: {pattern!r}")
                escape = f"[^{space}]"
            out.append(escape)
            at += 2
            continue
        if in_class:
            first = at == class_start
            if char == "]" and not first:
                in_class = False
                out.append("]")
            elif char in "[]" or char == "&":
                out.append("\\" + char)
            else:
                out.append(char)
            at += 1
            continue
        if verbose and char in " \t\n\r\f\v":
            at += 1
            if out and re.fullmatch(r"\\\d", out[-1]) and pattern[at : at + 1].isdigit():
                out.append("(?:)")  # or the digit would belong to the number of the group
            continue
        if verbose and char == "#":
            end = pattern.find("\n", at)
            at = len(pattern) if end < 0 else end
            continue
        if char == "[":
            in_class = True
            negated = pattern.startswith("[^", at)
            out.append("[^" if negated else "[")
            at += 2 if negated else 1
            class_start = at
            continue
        if char == "(":
            if m := re.match(r"\(\?P<(\w+)>", rest):
                out.append(f"(?<{own[m[1]]}>")
                at += len(m[0])
                continue
            if m := re.match(r"\(\?P=(\w+)\)", rest):
                out.append(f"\\k<{own[m[1]]}>")
                at += len(m[0])
                continue
            if m := re.match(r"\(\?#[^)]*\)", rest):
                at += len(m[0])
                continue
            if re.match(r"\(\?[aiLmsux]*-?[imsx]*[:)]", rest) and not rest.startswith("(?:"):
                raise ValueError(f"flags for a part of the pattern are not supported: {pattern!r}")
            if rest.startswith("(?("):
                raise ValueError(f"conditional groups are not supported: {pattern!r}")
        if char == "{":
            m = re.match(r"\{(\d*)(,?)(\d*)\}", rest)
            if m and out and (m[1] or (m[2] and m[3])):
                out.append(f"{{{m[1] or 0}{m[2]}{m[3]}}}")
                at += len(m[0])
            else:
                out.append("\\{")
                at += 1
            continue
        if char == "^" and flags & re.MULTILINE:
            out.append(r"(?:\A|(?<=\n))")
            at += 1
            continue
        if char == "}":
            out.append("\\}")
            at += 1
            continue
        out.append(char)
        at += 1
    return "".join(out)


def pinned(value: Column) -> Column:
    """The same value, computed where it stands and nowhere else.

    A filter or projection above an ordinary column is merged with it, and an
    expensive expression then runs once per mention.  Spark does not merge an
    expression that depends on where the row is, so the value is tied to such a
    one that is always true.
    """
    return F.when(F.spark_partition_id() >= 0, value)


def to_number(text: Column) -> Column:
    """Double for plain decimal text; NULL for anything else, non-finite included."""
    number = strip(text).try_cast("double")
    # The cast also reads suffixes (5d, 5f) and hexadecimal; so does nobody else.
    return F.when((F.abs(number) < F.lit(float("inf"))) & ~text.rlike("[dDfFxX]"), number)


def finite(number: Column) -> Column:
    """NULL in place of NaN and infinities (Spark orders NaN above every number)."""
    return F.when(F.abs(number) < F.lit(float("inf")), number)


def escape_html(text: Column) -> Column:
    for char, escape in HTML_ESCAPES:
        text = F.replace(text, F.lit(char), F.lit(escape))
    return text


def digest_prefix(text: Column, length: int = 32) -> Column:
    return F.left(F.sha2(text, 256), F.lit(length))
