"""What git says about a working copy, on the driver; and parsers of its output."""

from __future__ import annotations

import re
import subprocess
from dataclasses import dataclass
from pathlib import Path

from lodegraph.functions.text import fnv1a
from lodegraph.schemas import InvalidArgument

# fixed values: what the first letter of a name-status line means
STATUS = {"A": "added", "C": "copied", "D": "deleted", "M": "modified", "R": "renamed", "T": "modified"}


def is_remote(source: str) -> bool:
    """Whether a source names a remote: an address, scp form, or a .git that is no folder here."""
    return "://" in source or bool(re.match(r"git@[^:]+:", source)) or (source.endswith(".git") and not Path(source).exists())


def without_credentials(url: str) -> str:
    return re.sub(r"^([a-z+]+://)[^/@]*@", r"\1", url)


def repository_id(origin: str | None, root: str, prefix: str = "") -> str:
    """A stable id: the hash of the origin (with the folder inside it), else of the path."""
    name = without_credentials(origin) + (f"#{prefix}" if prefix else "") if origin else str(Path(root).resolve())
    return f"{fnv1a(name.encode()):016x}"


def git(root: str, *arguments: str) -> str:
    return subprocess.run(["git", "-C", root, *arguments], capture_output=True, text=True, check=True, timeout=600).stdout


def resolve_commit(root: str, revision: str) -> str:
    if not revision or revision.startswith("-") or "\0" in revision:
        raise InvalidArgument(f"not a revision: {revision!r}")
    try:
        return git(root, "rev-parse", "--verify", "--end-of-options", f"{revision}^{{commit}}").strip()
    except subprocess.CalledProcessError as e:
        raise InvalidArgument(f"unknown revision: {revision}") from e


@dataclass(frozen=True)
class FileChange:
    status: str
    path: str
    old_path: str | None = None


@dataclass(frozen=True)
class Hunk:
    path: str
    old_start: int
    old_lines: int
    new_start: int
    new_lines: int


def parse_name_status(out: str) -> list[FileChange]:
    """Of ``--name-status -z`` output: status, path and, for copies and renames, the old path first."""
    parts = [p for p in out.split("\0") if p]
    changes, i = [], 0
    while i < len(parts):
        letter = parts[i][0]
        if letter in "RC":
            changes.append(FileChange(STATUS[letter], parts[i + 2], parts[i + 1]))
            i += 3
        else:
            if letter in STATUS:
                changes.append(FileChange(STATUS[letter], parts[i + 1]))
            i += 2
    return changes


def unquoted(path: str) -> str:
    """A path of a diff header: octal and letter escapes in quotes are undone."""
    if not (path.startswith('"') and path.endswith('"')):
        return path
    letters = {"n": b"\n", "t": b"\t", "r": b"\r", '"': b'"', "\\": b"\\", "a": b"\a", "b": b"\b", "f": b"\f", "v": b"\v"}
    out = b""
    for m in re.finditer(r"\\([0-7]{3})|\\(.)|([^\\]+)", path[1:-1]):
        out += bytes([int(m[1], 8)]) if m[1] else letters.get(m[2], m[2].encode()) if m[2] else m[3].encode()
    return out.decode("utf-8", "replace")


_HUNK = re.compile(r"@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@")


def parse_hunks(out: str) -> list[Hunk]:
    """Of a zero-context diff; a deleted file keeps its old path."""
    hunks, old, path = [], None, None
    for line in out.split("\n"):
        if line.startswith("--- "):
            old = unquoted(line[4:].rstrip("\t")).removeprefix("a/")
        elif line.startswith("+++ "):
            new = unquoted(line[4:].rstrip("\t"))
            path = old if new == "/dev/null" else new.removeprefix("b/")
        elif m := _HUNK.match(line):
            a, n, b, k = (int(x) if x is not None else 1 for x in m.groups())
            hunks.append(Hunk(path, a, n, b, k))
    return hunks


def changed_files(root: str, base: str, head: str | None = None) -> list[FileChange]:
    return parse_name_status(git(root, "diff", "--name-status", "-z", "--find-renames", base, *([head] if head else []), "--"))


def hunks(root: str, base: str, head: str | None = None, pattern: str = "*.rs") -> list[Hunk]:
    return parse_hunks(git(root, "diff", "--unified=0", "--no-color", "--find-renames", base, *([head] if head else []), "--", pattern))


def untracked_files(root: str) -> list[FileChange]:
    return [FileChange("added", p) for p in git(root, "ls-files", "--others", "--exclude-standard", "-z").split("\0") if p]


def recent_commits(root: str, limit: int = 50) -> list[tuple[str, str, str]]:
    """(commit, time, subject), newest first."""
    out = git(root, "log", f"-{max(1, limit)}", "--format=%H%x00%cI%x00%s")
    return [tuple(line.split("\0", 2)) for line in out.split("\n") if line]


def refs(root: str, limit: int = 200) -> list[tuple[str, str]]:
    out = git(root, "for-each-ref", f"--count={max(1, limit)}", "--sort=-committerdate", "--format=%(refname:short)%00%(objectname)", "refs/heads", "refs/tags")
    return [tuple(line.split("\0", 1)) for line in out.split("\n") if line]


def export(root: str, commit: str, folder: str) -> None:
    """The tree of a commit as files below a folder."""
    archive = subprocess.run(["git", "-C", root, "archive", "--format=tar", commit], capture_output=True, check=True, timeout=600).stdout
    Path(folder).mkdir(parents=True, exist_ok=True)
    subprocess.run(["tar", "-xf", "-", "-C", folder], input=archive, check=True, timeout=600)
