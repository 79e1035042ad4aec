"""Remote URLs and project names as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import extract, strip

_HTTP = r"^https?://[^/?#]+"


def normalize_git_url(url: Column) -> Column:
    """One spelling per repository: lower case, https, no trailing '/' and no '.git'."""
    plain = F.regexp_replace(F.lower(strip(url)), "/+$", "")
    plain = F.regexp_replace(plain, r"\.git$", "")
    plain = F.regexp_replace(plain, r"^git@([^:]*):", "git@$1/")
    plain = F.regexp_replace(plain, "^git@", "https://")
    plain = F.regexp_replace(plain, "^ssh://git@", "https://")
    return F.when(plain != "", plain)


def _path(url: Column) -> Column:
    """Path of an absolute URL, null if the text is no URL.

    A web address needs a host. After a scheme without '//' all is path, as in host:team/repo.
    """
    web = F.regexp_extract(url, r"^(?i:https?|ftp|wss?)://[^/?#\s]+([^?#]*)", 1)
    other = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*:(?://[^/?#]*)?([^?#]*)", 1)
    return (F.when(url.rlike(r"^(?i:https?|ftp|wss?)://"), F.when(url.rlike(r"^(?i:https?|ftp|wss?)://[^/?#\s]"), web))
            .when(url.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), other))


def repo_name(url: Column, strict: bool = False) -> Column:
    """Last path segment of a remote.

    The strict form wants an http(s) remote with an owner; the other takes any URL.
    """
    plain = normalize_git_url(url)
    path = _inner_path(plain)
    if strict:
        parts = F.filter(F.split(path, "/"), lambda p: p != "")
        return F.when(plain.rlike(_HTTP) & (F.size(parts) >= 2), F.element_at(parts, -1))
    return _last_part(path)


def _inner_path(plain: Column) -> Column:
    return F.regexp_replace(_path(plain), "^/+|/+$", "")


def _last_part(path: Column) -> Column:
    last = F.substring_index(path, "/", -1)
    return F.when(last != "", last)


def remote_label(url: Column) -> Column:
    """Short label of a remote, such as owner/repo."""
    path = F.regexp_replace(F.regexp_replace(_path(strip(url)), "^/+", ""), r"(?i)\.git$", "")
    return F.when(path != "", path)


def workspace_folder(cwd: Column) -> Column:
    """Project folder of a workspace checkout laid out as .../conductor/workspaces/<project>/..."""
    return extract(F.translate(cwd, "\\", "/"), r"/conductor/(?:workspaces|archived-contexts)/([^/]+)/")


def base_name(path: Column) -> Column:
    trimmed = strip(path)
    return F.when(trimmed != "", F.substring_index(F.regexp_replace(trimmed, "/+$", ""), "/", -1))


def project_name(cwd: Column, remote: Column, metadata: Column | None = None) -> Column:
    """Metadata, else the remote's repository, else the workspace folder, else the last folder."""
    given = F.lit(None).cast("string") if metadata is None else F.when(strip(metadata) != "", strip(metadata))
    return F.coalesce(given, repo_name(remote, strict=True), workspace_folder(cwd), base_name(cwd),
                      F.lit("unknown"))


def merge_key(name: Column, remote: Column) -> Column:
    """Rows of one repository share this key."""
    named = F.lower(strip(F.coalesce(name, F.lit(""))))
    return F.coalesce(normalize_git_url(remote), F.when(named != "", named), F.lit("unknown"))


def canonical_name(name: Column, remote: Column) -> Column:
    """Name under which repositories and plain folders are brought together."""
    return _name_or_unknown(repo_name(remote), F.lower(strip(F.coalesce(name, F.lit("")))))


def _name_or_unknown(repo: Column, named: Column) -> Column:
    return F.coalesce(repo, F.when(named != "", named), F.lit("unknown"))


def with_canonical_name(df: DataFrame, out: str) -> DataFrame:
    """Add :func:`canonical_name` of ``name`` and ``git_remote``.

    As one expression it holds the normalised remote dozens of times; here every step is a column of its own.
    """
    named = df.withColumns({"_plain": normalize_git_url(F.col("git_remote")),
                            "_named": F.lower(strip(F.coalesce("name", F.lit(""))))})
    named = named.withColumn("_path", _inner_path(F.col("_plain")))
    return named.withColumn(out, _name_or_unknown(_last_part(F.col("_path")), F.col("_named"))).drop("_plain", "_named", "_path")
