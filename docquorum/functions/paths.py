"""Path columns and glob predicates."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Extensions that always mean binary content.
BINARY_EXTENSIONS = (
    ".png", ".jpg", ".jpeg", ".gif", ".bmp", ".ico", ".webp", ".tiff", ".svg",
    ".mp3", ".mp4", ".wav", ".avi", ".mov", ".mkv", ".flac", ".ogg",
    ".zip", ".gz", ".tar", ".bz2", ".xz", ".7z", ".rar",
    ".pdf", ".doc", ".docx", ".xls", ".xlsx", ".ppt", ".pptx",
    ".exe", ".dll", ".so", ".dylib", ".o", ".a", ".lib",
    ".pyc", ".pyo", ".class", ".jar", ".war",
    ".woff", ".woff2", ".ttf", ".eot", ".otf",
    ".sqlite", ".db", ".sqlite3",
    ".bin", ".dat", ".pkl", ".pickle", ".npy", ".npz",
    ".DS_Store",
)
# Fixed value: how many leading bytes are sniffed for a NUL.
SNIFF_BYTES = 8192


def norm_path(path: Column, separator: str = "/") -> Column:
    """Forward slashes only, without a leading ``./``."""
    if separator != "/":
        path = F.replace(path, F.lit(separator), F.lit("/"))
    return F.regexp_replace(path, r"\A\./", "")


def extension(path: Column) -> Column:
    """Lower-cased last suffix with its dot; dotfiles have none."""
    return F.lower(F.regexp_extract(path, r"[^./][^/]*(\.[^./]*)\z", 1))


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def top_level(path: Column) -> Column:
    """First path segment."""
    return F.substring_index(path, "/", 1)


def _char_class(body: str, negated: bool, slash: bool) -> str:
    inner = re.sub(r"([\\\[\]&^~])", r"\\\1", body)
    guard = "" if slash else "(?!/)"
    return f"{guard}[{'^' if negated else ''}{inner}]"


def _next_token(pattern: str, at: int) -> tuple[str, str, int]:
    """(kind, text, next position) of the glob token at a position."""
    char = pattern[at]
    if char in "*?":
        return char, char, at + 1
    if char == "[":
        first = at + 2 if pattern[at + 1:at + 2] == "!" else at + 1
        close = pattern.find("]", first + 1)
        if close > 0:
            return "[!" if first == at + 2 else "[", pattern[first:close], close + 1
    return "literal", char, at + 1


def _quote(char: str) -> str:
    return char if char.isalnum() or char in "_/ " else "\\" + char


def glob_body(pattern: str, cross_slash: bool = True) -> str:
    """Java regex for a shell glob, unanchored. ``*`` may or may not cross a slash."""
    any_char = "." if cross_slash else "[^/]"
    pieces, at = [], 0
    while at < len(pattern):
        kind, text, at = _next_token(pattern, at)
        if kind == "*":
            pieces.append(any_char + "*")
        elif kind == "?":
            pieces.append(any_char)
        elif kind == "literal":
            pieces.append(_quote(text))
        else:
            pieces.append(_char_class(text, kind == "[!", cross_slash))
    return "".join(pieces)


def any_of(bodies: Iterable[str]) -> str:
    return "(?:" + "|".join(bodies) + ")"


def glob_match(col: Column, *patterns: str) -> Column:
    """Whole-value, case-sensitive glob match against any pattern; ``*`` crosses slashes."""
    if not patterns:
        return F.lit(False)
    return col.rlike(rf"(?s)\A{any_of(glob_body(p) for p in patterns)}\z")


def name_or_path_match(path: Column, *patterns: str) -> Column:
    """Glob match on the file name or on the full path."""
    return glob_match(basename(path), *patterns) | glob_match(path, *patterns)


def under_directory(path: Column, *dir_globs: str) -> Column:
    """True when any directory on the way to the file matches one of the name globs.

    One regex scan of the path; a file of that name does not count. Globs are held against single
    names, so one with a slash in it matches nothing.
    """
    dir_globs = [g for g in dir_globs if "/" not in g]
    if not dir_globs:
        return F.lit(False)
    names = any_of(glob_body(g, cross_slash=False) for g in dir_globs)
    return path.rlike(rf"(?s)(?:\A|/){names}/")


def is_binary_name(path: Column) -> Column:
    return extension(path).isin(*BINARY_EXTENSIONS)


def has_nul(content: Column) -> Column:
    """NUL within the sniffed head; unreadable (null) content counts as binary."""
    head = F.substring(content, 1, SNIFF_BYTES)
    return F.coalesce(F.contains(head, F.lit(bytearray(b"\x00"))), F.lit(True))


def decode_text(content: Column) -> Column:
    """Bytes to text: invalid sequences replaced, line ends unified to LF."""
    text = F.make_valid_utf8(content.cast("string"))
    return F.regexp_replace(text, "\r\n?", "\n")
