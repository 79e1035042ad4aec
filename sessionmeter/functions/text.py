"""Text clean-up, redaction and pattern search as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalars import short_hash

BLANKS = " \t\n\r\f\u000b\u00a0\ufeff\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(
    chr(c) for c in range(0x2000, 0x200B))
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"

# Terminal escape sequences, in the order they are removed.
ESCAPES = (
    r"\u001B\][^\u0007]*(?:\u0007|\u001B\\)",
    r"[\u001B\u009B][\[\]()#;?]*(?:[0-9]{1,4}(?:;[0-9]{0,4})*)?[0-9A-ORZcf-nq-uy=><]",
    r"\u001B[@-Z\\\-_]",
)

# What is replaced in stored log text, in this order.
REDACTIONS = (
    (r"/Users/[^/\s]+", "/Users/[redacted]"),
    (r"/home/[^/\s]+", "/home/[redacted]"),
    (r"[A-Za-z]:\\Users\\[^\\\s]+", r"C:\\Users\\[redacted]"),
    (r"[A-Za-z]:/Users/[^/\s]+", "C:/Users/[redacted]"),
    (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "[redacted]"),
)

# Which desktop log records may be stored.
SENSITIVE = (r"^\s*user:", r"^\s*assistant:", r"system prompt", r"\bprompt\b")
SAFE_COMPONENTS = ("sparkle", "git", "git-repo-watcher", "desktop-notifications",
                   "electron-message-handler", "app-server", "main", "worker", "ipc", "router")
SAFE_MESSAGES = (r"codex_app_", r"launching app", r"sparkle", r"git\b", r"worktree", r"automation",
                 r"desktop notification", r"app server", r"skills?/")
ALERT_LEVELS = ("warn", "warning", "error")


def strip(text: Column) -> Column:
    """Remove all kinds of white space from both ends."""
    return F.btrim(text, F.lit(BLANKS))


def is_blank(text: Column) -> Column:
    return strip(text) == ""


def extract(text: Column, pattern: str, group: int = 1) -> Column:
    """First match of a group, null (not '') when the pattern does not occur."""
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, group))


def strip_escapes(text: Column) -> Column:
    plain = text
    for pattern in ESCAPES:
        plain = F.regexp_replace(plain, pattern, "")
    # Every sequence begins with one of two characters; replacing also mends broken UTF-8.
    whole = ~text.contains("\u001b") & ~text.contains("\u009b") & F.is_valid_utf8(text)
    return F.when(whole, text).otherwise(plain)


def redact(text: Column, home: str | None = None) -> Column:
    """Hide home directories, user directories and e-mail addresses."""
    if home:
        text = F.replace(text, F.lit(home), F.lit("~"))
    for pattern, shown in REDACTIONS:
        text = F.regexp_replace(text, pattern, shown)
    return text


def may_store(level: Column, component: Column, message: Column) -> Column:
    """Keep a record unless it may quote a conversation; then only known-harmless kinds."""
    lowered = F.lower(message)
    secret = lowered.rlike("|".join(SENSITIVE))
    safe = (F.coalesce(F.lower(component).isin(*SAFE_COMPONENTS), F.lit(False))
            | lowered.rlike("|".join(SAFE_MESSAGES))
            | F.coalesce(level.isin(*ALERT_LEVELS), F.lit(False)))
    return ~secret & safe


def signature(tool: Column, command: Column, length: int | None = 200) -> Column:
    """Tool and command with blanks collapsed; of the command ``length`` characters, all if None.

    200 is what signatures in existing logs have; commands that begin alike that far share one.
    """
    short = strip(F.regexp_replace(F.coalesce(command, F.lit("")), r"\s+", " "))
    if length is not None:
        short = F.substring(short, 1, length)
    return F.when(tool.isNull(), short).when(short == "", tool).otherwise(F.concat(tool, F.lit("|"), short))


def mask_email(email: Column) -> Column:
    """Struct of the domain and a hash of the local part; no '@' means all is hashed."""
    at = F.instr(email, "@")
    local = F.when(at > 0, F.substring_index(email, "@", 1)).otherwise(email)
    domain = F.when(at > 0, F.lower(F.substr(email, at + 1)))
    return F.struct(F.when(domain != "", domain).alias("email_domain"),
                    F.when((at == 0) | (local != ""), short_hash(local, 12)).alias("email_hash"))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def matches(text: Column, term: str) -> Column:
    """Substring search ignoring ASCII case, in which % and _ act as wildcards."""
    pattern = term.translate(str.maketrans(UPPER, LOWER)).replace("\\", "\\\\")
    return ascii_lower(text).like(f"%{pattern}%")


def any_matches(term: str | None, *columns: str) -> Column:
    """True where any column matches; with no term, everywhere."""
    if not term:
        return F.lit(True)
    test = F.lit(False)
    for name in columns:
        test = test | F.coalesce(matches(F.col(name), term), F.lit(False))
    return test


def contains_ignoring_case(term: str | None, *columns: str) -> Column:
    """Plain substring search without wildcards."""
    needle = (term or "").strip().lower()
    if not needle:
        return F.lit(True)
    test = F.lit(False)
    for name in columns:
        test = test | F.coalesce(F.lower(F.col(name)).contains(needle), F.lit(False))
    return test

