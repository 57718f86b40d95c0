"""Command lines, package specs and names, as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# They decide which launch lines count.
MODEL_RUNNERS = ("npx", "npx.cmd", "pnpm", "yarn", "bunx", "uvx", "uvx.exe", "pipx", "pipx.exe")
RULE_RUNNERS = ("npx", "npx.cmd", "pnpm", "pnpm.cmd", "yarn", "bunx", "uvx", "uvx.exe", "pipx")
CONTAINER_RUNNERS = ("docker", "docker.exe", "podman")
PLACEHOLDERS = ("${", "$(", "<", "your_", "changeme", "xxx", "redacted", "placeholder", "env:")
SECRET_NOUNS = ("api[-_]?key", "token", "secret", "password", "passwd", "credential", "private[-_]?key", "access[-_]?key")

#: A concrete revision within a package spec. Dist-tags are none.
PINNED = "|".join([r"@[0-9][\w.+-]*", r"(?:==|~=|>=|<=|!=)[^\s,]+", r"@sha256:[0-9a-fA-F]+", r"\.git#[0-9a-fA-F]{7,40}"])
#: ``.``, ``..``, what starts like a path, a drive letter, or any backslash.
PATH = r"^\.{1,2}$|^/|^\.{1,2}/|^~|^[A-Za-z]:|\\"
SECRET_NAME = f"(?i)(?:{'|'.join(SECRET_NOUNS)})"
#: Command, then the flags that agree without asking.
AGREE_FLAGS = ("-y", "--yes")


def base_name(command: Column) -> Column:
    return F.regexp_extract(F.coalesce(command, F.lit("")), r"[^/\\]*$", 0)


def is_path(arg: Column) -> Column:
    return arg.rlike(PATH)


def package_spec(args: Column) -> Column:
    """The first argument that is neither a flag nor a path; URLs count. Null without one."""
    web = lambda a: a.startswith("http://") | a.startswith("https://")
    return F.get(F.filter(args, lambda a: ~a.startswith("-") & (web(a) | ~is_path(a))), 0)


def floating_package(command: Column, args: Column, runners: tuple[str, ...] = MODEL_RUNNERS) -> Column:
    """The package that resolves to whatever is latest, or null."""
    spec = package_spec(args)
    return F.when(base_name(command).isin(*runners) & ~spec.rlike(PINNED), spec)


def is_pinned(command: Column, args: Column, url: Column) -> Column:
    return F.coalesce(url != "", F.lit(False)) | floating_package(command, args).isNull()


def is_placeholder(value: Column) -> Column:
    lowered = F.lower(value)
    found = F.lit(False)
    for marker in PLACEHOLDERS:
        found = found | F.contains(lowered, F.lit(marker))
    return found


def name_key(name: Column) -> Column:
    """The name in lower case without anything but letters and digits."""
    return F.regexp_replace(F.lower(name), "[^a-z0-9]", "")
