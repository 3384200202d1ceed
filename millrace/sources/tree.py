"""Source trees as a Spark data source: every file under one or several roots, whatever its name.

Spark's own file sources pass over names that begin with ``_`` or ``.`` and files without bytes; a source tree needs both
(``__init__.py``, ``.github/workflows``).  Here the driver lists only the upper folders and deals subtrees out to tasks, which walk them and read the files.
With ``ignore=git`` a tree inside of a git work tree holds what git would show: files in the index, and others that no ignore pattern matches.
"""

from __future__ import annotations

import hashlib
import json
import os
import posixpath
import re
import struct
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringStartsWith

SCHEMA = "root string, path string, bytes long, sha256 string, text string, tracked boolean"
#: Tasks a core that walk subtrees, files a task that the driver itself listed, and levels that the driver lists.
TASKS_A_CORE, FILES_A_TASK, LEVELS = 3, 2000, 3
#: Bytes at the beginning that tell text from binary (a zero byte), and bytes hashed at a time.
SNIFF, CHUNK = 8192, 1 << 20
#: Fixed values of git's index: modes that are files, the flag of two more bytes of flags.
FILE_MODES, EXTENDED = (0o100644, 0o100755), 0x4000


@lru_cache(maxsize=1 << 14)
def glob_regex(pattern: str) -> str:
    """Regular expression of a shell pattern over paths: ``*`` and ``?`` stop at slashes, ``**`` as a whole part does not."""
    out, k = "", 0
    while k < len(pattern):
        c = pattern[k]
        if pattern.startswith("**/", k) and (k == 0 or pattern[k - 1] == "/"):
            out += "(?:[^/]+/)*"
            k += 3
            continue
        if pattern[k:] == "**" and (k == 0 or pattern[k - 1] == "/"):
            return out + ".+"
        if c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "\\" and k + 1 < len(pattern):
            k += 1
            out += re.escape(pattern[k])
        elif c == "[" and (end := pattern.find("]", k + 2 if pattern[k + 1 : k + 2] in ("!", "^", "]") else k + 1)) > 0:
            body = pattern[k + 1 : end].replace("\\", "\\\\")
            out += f"(?!/)[{'^' + body[1:] if body[0] in '!^' else body}]"
            k = end
        else:
            out += re.escape(c)
        k += 1
    return out


@dataclass(frozen=True)
class IgnoreRule:
    """One line of an ignore file; ``base`` is the folder of that file (with its slash, empty at the top)."""

    base: str
    regex: str
    again: bool
    folders_only: bool


def ignore_rules(text: str, base: str) -> list[IgnoreRule]:
    """Rules of an ignore file.  A pattern with a slash before its end is anchored at the file's folder, any other matches at every depth."""
    rules, base = [], _by_bytes(base)
    for line in _by_bytes(text).split("\n"):
        line = line.removesuffix("\r")
        line = re.sub(r"(?<!\\)[ \t]+$", "", line)
        if not line or line.startswith("#"):
            continue
        again = line.startswith("!")
        line = line[1:] if again else line
        folders_only = line.endswith("/")
        line = line.rstrip("/") if folders_only else line
        anchored = "/" in line
        body = glob_regex(line.lstrip("/"))
        if line.strip("/"):
            rules.append(IgnoreRule(base, body if anchored else f"(?:.*/)?{body}", again, folders_only))
    return rules


@lru_cache(maxsize=1 << 14)
def _compiled(regex: str) -> re.Pattern:
    return re.compile(regex, re.DOTALL)


def _by_bytes(text: str) -> str:
    """One character a byte: patterns see bytes, so that ``?`` is one of them."""
    return text.encode("utf-8", "surrogateescape").decode("latin-1")


def ignored(rules: Iterable[IgnoreRule], path: str, folder: bool) -> bool:
    """Whether the last rule that matches says so."""
    out, path = False, _by_bytes(path)
    for r in rules:
        if path.startswith(r.base) and (folder or not r.folders_only) and _compiled(r.regex).fullmatch(path[len(r.base) :]):
            out = not r.again
    return out


def index_paths(data: bytes) -> list[str]:
    """Paths of the files of a git index (versions 2 to 4), sorted; links and submodules are no files."""
    mark, version, count = struct.unpack(">4sII", data[:12])
    if mark != b"DIRC" or version not in (2, 3, 4):
        raise ValueError("no git index that can be read")
    found, at, name = [], 12, b""
    for _ in range(count):
        start = at
        (mode,) = struct.unpack(">I", data[at + 24 : at + 28])
        (flags,) = struct.unpack(">H", data[at + 60 : at + 62])
        at += 64 if version > 2 and flags & EXTENDED else 62
        if version == 4:
            # how many bytes of the name before to take away, in groups of seven bits
            byte = data[at]
            at += 1
            drop = byte & 127
            while byte & 128:
                byte = data[at]
                at += 1
                drop = ((drop + 1) << 7) | (byte & 127)
            end = data.index(b"\0", at)
            name = name[: len(name) - drop] + data[at:end]
            at = end + 1
        else:
            end = data.index(b"\0", at)
            name = data[at:end]
            at = start + (end - start) // 8 * 8 + 8
        if mode in FILE_MODES:
            found.append(name.decode("utf-8", "surrogateescape"))
    return sorted(set(found))


class Store:
    """Listing and reading of folders by url: plain paths and ``file:`` with the system's calls, others through Arrow's file systems."""

    def __init__(self, root: str) -> None:
        self.remote = None
        scheme, sep, rest = root.partition("://")
        if sep and scheme != "file":
            from pyarrow import fs

            self.remote, self.base = fs.FileSystem.from_uri(root)
        else:
            self.base = os.path.abspath((rest if sep else root.removeprefix("file:")) or "/")

    def _at(self, path: str) -> str:
        return posixpath.join(self.base, path) if path else self.base

    def entries(self, path: str) -> list[tuple[str, bool]]:
        """Names in a folder in order, and whether each is a folder.  Links are neither followed nor listed."""
        where = self._at(path)
        if self.remote is not None:
            from pyarrow import fs

            return sorted((x.base_name, x.type == fs.FileType.Directory) for x in self.remote.get_file_info(fs.FileSelector(where)))
        try:
            with os.scandir(where) as it:
                return sorted((x.name, x.is_dir(follow_symlinks=False)) for x in it if not x.is_symlink() and (x.is_dir() or x.is_file()))
        except (PermissionError, FileNotFoundError, NotADirectoryError):
            return []

    def is_folder(self, path: str) -> bool:
        where = self._at(path)
        if self.remote is not None:
            from pyarrow import fs

            return self.remote.get_file_info(where).type == fs.FileType.Directory
        return os.path.isdir(where)

    def is_file(self, path: str) -> bool:
        where = self._at(path)
        if self.remote is not None:
            from pyarrow import fs

            return self.remote.get_file_info(where).type == fs.FileType.File
        return os.path.isfile(where) and not os.path.islink(where)

    def open(self, path: str):
        where = self._at(path)
        return self.remote.open_input_stream(where) if self.remote is not None else open(where, "rb")

    def write(self, path: str, data: bytes) -> None:
        where = self._at(path)
        if self.remote is not None:
            self.remote.create_dir(posixpath.dirname(where))
            with self.remote.open_output_stream(where) as f:
                f.write(data)
            return
        os.makedirs(posixpath.dirname(where), exist_ok=True)
        with open(where, "wb") as f:
            f.write(data)

    def text(self, path: str) -> str:
        """A small file's text, empty if there is none."""
        if not self.is_file(path):
            return ""
        with self.open(path) as f:
            return f.read().decode("utf-8", "surrogateescape")

    def up(self) -> Store | None:
        """The folder above, none at the top."""
        above = posixpath.dirname(self.base.rstrip("/"))
        if not above or above == self.base.rstrip("/"):
            return None
        out = Store.__new__(Store)
        out.remote, out.base = self.remote, above
        return out


@dataclass
class Choice:
    """What of a tree is wanted: folders left out and taken in again (names or shell patterns, as a part or a path), whether git decides too."""

    exclude: list[str] = field(default_factory=list)
    include: list[str] = field(default_factory=list)
    git: bool = True
    prefixes: list[str] = field(default_factory=list)

    @staticmethod
    def _hits(patterns: list[str], path: str) -> bool:
        """Whether a pattern is a part of the path, or several parts in a row."""
        return any(_compiled(f"(?:.*/)?{glob_regex(p.strip('/'))}(?:/.*)?").fullmatch(path) for p in patterns if p.strip("/"))

    def forced(self, path: str) -> bool:
        return self._hits(self.include, path)

    def left_out(self, path: str) -> bool:
        return self._hits(self.exclude, path)

    def reaches(self, path: str, folder: bool) -> bool:
        """Whether a pushed filter lets the path, or something below it, through."""
        return not self.prefixes or any(path.startswith(p) or folder and p.startswith(f"{path}/") for p in self.prefixes)


@dataclass
class Subtree(InputPartition):
    """Work of a task: folders to walk and files that are settled, with the ignore rules from above and the files of the index below.

    ``prefix``: where the root lies in its git work tree (with a slash; None outside of any).
    """

    root: str
    prefix: str | None = None
    folders: list[tuple[str, list[IgnoreRule], bool]] = field(default_factory=list)
    files: list[tuple[str, bool]] = field(default_factory=list)
    tracked: list[str] = field(default_factory=list)


class Walk:
    """One tree: which entries of a folder are wanted."""

    def __init__(self, root: str, choice: Choice, tracked: list[str], prefix: str | None) -> None:
        self.store, self.choice, self.tracked = Store(root), choice, tracked
        self.in_git, self.prefix = prefix is not None, prefix or ""

    def _below(self, path: str) -> tuple[int, int]:
        return bisect_left(self.tracked, f"{path}/"), bisect_left(self.tracked, f"{path}0")  # "0" follows "/"

    def below(self, path: str) -> list[str]:
        a, b = self._below(path)
        return self.tracked[a:b]

    def is_tracked(self, path: str) -> bool:
        k = bisect_left(self.tracked, path)
        return k < len(self.tracked) and self.tracked[k] == path

    def step(self, folder: str, rules: list[IgnoreRule], dropped: bool) -> tuple[list[tuple[str, list[IgnoreRule], bool]], list[tuple[str, bool]]]:
        """Folders to go on with and files of ``folder``.  ``dropped``: an ignore rule took the folder, so only the index, or force, brings its files back."""
        base = f"{folder}/" if folder else ""
        entries = self.store.entries(folder)
        if self.in_git and any(name == ".gitignore" and not d for name, d in entries):
            rules = rules + ignore_rules(self.store.text(f"{base}.gitignore"), self.prefix + base)
        folders, files = [], []
        for name, is_folder in entries:
            path = base + name
            if name == ".git" or not self.choice.reaches(path, is_folder):
                continue
            gone = self.in_git and (dropped or ignored(rules, self.prefix + path, is_folder))
            if is_folder:
                a, b = self._below(path)
                nested = self.in_git and (self.store.is_folder(f"{path}/.git") or self.store.is_file(f"{path}/.git"))
                open_ = not self.choice.left_out(path) and (not (gone or nested) or a < b)
                if open_ or self.choice.include:
                    folders.append((path, rules, gone or nested))
            else:
                tracked = self.in_git and self.is_tracked(path)
                if self.choice.forced(path) or not self.choice.left_out(path) and (tracked or not gone):
                    files.append((path, tracked))
        return folders, files


class TreeReader(DataSourceReader):
    """Plans subtrees on the driver, walks and reads them in tasks.  Filters ``path = ...``, ``in`` and prefix tests prune folders."""

    def __init__(self, options: dict) -> None:
        self.roots = json.loads(options["roots"])
        self.choice = Choice(json.loads(options.get("exclude", "[]")), json.loads(options.get("include", "[]")), options.get("ignore", "git") == "git")
        self.tasks = int(options.get("tasks", "64"))

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        for f in filters:
            if isinstance(f, (EqualTo, StringStartsWith, In)) and f.attribute == ("path",) and not self.choice.prefixes:
                self.choice.prefixes = [str(v) for v in (f.value if isinstance(f, In) else [f.value]) if v is not None]
            yield f  # the filter stays: here it only prunes

    def _open(self, root: str) -> tuple[Walk, list[IgnoreRule], bool]:
        """The walk of a root, the ignore rules of the work tree's folders above it, and whether they take the root itself."""
        inside = Store(root).base.rstrip("/")
        top: Store | None = Store(root) if self.choice.git else None
        while top is not None and not top.is_folder(".git"):
            top = top.up()
        if top is None:
            return Walk(root, self.choice, [], None), [], False
        within = inside[len(top.base.rstrip("/")) :].strip("/")
        prefix = f"{within}/" if within else ""
        rules = ignore_rules(top.text(".git/info/exclude"), "")
        parts = within.split("/") if within else []
        dropped = False
        for k in range(len(parts)):
            base = "".join(f"{x}/" for x in parts[:k])
            rules += ignore_rules(top.text(f"{base}.gitignore"), base)
            dropped = dropped or ignored(rules, base + parts[k], True)
        tracked: list[str] = []
        if top.is_file(".git/index"):
            with top.open(".git/index") as f:
                tracked = [x[len(prefix) :] for x in index_paths(f.read()) if x.startswith(prefix)]
        return Walk(root, self.choice, tracked, prefix), rules, dropped

    def partitions(self) -> list[Subtree]:
        out: list[Subtree] = []
        for root in self.roots:
            store = Store(root)
            if store.is_file(""):
                out.append(Subtree(root, files=[("", False)]))
                continue
            walk, rules, dropped = self._open(root)
            prefix = walk.prefix if walk.in_git else None
            level, files = [("", rules, dropped)], []
            for _ in range(LEVELS):
                if len(level) >= self.tasks:
                    break
                steps = [walk.step(*x) for x in level]
                files += [f for _, found in steps for f in found]
                level = [x for found, _ in steps for x in found]
            out += [Subtree(root, prefix, files=files[k : k + FILES_A_TASK]) for k in range(0, len(files), FILES_A_TASK)]
            for k in range(min(self.tasks, len(level))):
                mine = level[k :: self.tasks]
                out.append(Subtree(root, prefix, folders=mine, tracked=sorted(p for path, *_ in mine for p in walk.below(path))))
        return out or [Subtree("")]

    def read(self, partition: Subtree) -> Iterator[tuple]:
        if not partition.root:
            return
        walk = Walk(partition.root, self.choice, partition.tracked, partition.prefix)
        for path, tracked in partition.files:
            yield from self._row(walk.store, partition.root, path, tracked)
        todo = list(partition.folders)[::-1]
        while todo:
            folders, files = walk.step(*todo.pop())
            for path, tracked in files:
                yield from self._row(walk.store, partition.root, path, tracked)
            todo += folders[::-1]

    def _row(self, store: Store, root: str, path: str, tracked: bool) -> Iterator[tuple]:
        digest, parts, size, binary = hashlib.sha256(), [], 0, False
        try:
            with store.open(path) as f:
                while block := f.read(CHUNK):
                    binary |= not size and b"\0" in block[:SNIFF]
                    digest.update(block)
                    size += len(block)
                    if not binary:
                        parts.append(block)
        except (PermissionError, FileNotFoundError):
            return  # gone, or not ours to read, since it was listed
        text = None if binary else b"".join(parts).decode("utf-8", "replace")
        yield root, path or posixpath.basename(store.base), size, digest.hexdigest(), text, tracked


class SourceTree(DataSource):
    """``spark.read.format("sourcetree")`` with options ``roots, exclude, include`` (JSON lists) and ``ignore`` (``git`` or ``none``)."""

    @classmethod
    def name(cls) -> str:
        return "sourcetree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> TreeReader:
        return TreeReader(self.options)


def read_tree(spark: SparkSession, roots: str | list[str], exclude: Iterable[str] = (), include: Iterable[str] = (), ignore: str = "git") -> DataFrame:
    """All files under the roots: ``root, path, bytes, sha256, text, tracked``.

    Paths are relative to their root.  A name or shell pattern in ``exclude`` leaves out what has it as a part; ``include`` brings such
    files back, whatever else leaves them out.  With ``ignore="git"`` ignore files and the index of the work tree around a root
    count (a file in the index is never ignored); outside of a work tree nothing is ignored.  Links are not followed, work trees within one are other
    trees.  ``text`` is null for files with a zero byte near their beginning; of others every byte is read, those that are no UTF-8 replaced.
    An empty folder, a missing root and one that may not be read have no rows; a root that is a file is one row.
    """
    spark.dataSource.register(SourceTree)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    roots = [roots] if isinstance(roots, str) else list(roots)
    options = dict(roots=json.dumps(roots), exclude=json.dumps(list(exclude)), include=json.dumps(list(include)), ignore=ignore, tasks=str(TASKS_A_CORE * spark.sparkContext.defaultParallelism))
    return spark.read.format("sourcetree").options(**options).load()


def write_tree(files: DataFrame, root: str) -> int:
    """Write rows ``path, text`` as files under ``root``, from the tasks that hold them; returns how many.

    A task that runs again writes the same files again.  A path that leads out of the root stops the job; null texts are written as empty files.
    """

    def write(batches: Iterator) -> Iterator:
        import pandas as pd

        store = Store(root)
        for batch in batches:
            for path, text in zip(batch["path"], batch["text"]):
                if path.startswith("/") or ".." in path.split("/"):
                    raise ValueError(f"{path!r} is not below the root")
                store.write(path, (text or "").encode("utf-8", "surrogatepass"))
            yield pd.DataFrame({"n": [len(batch)]})

    return sum(r["n"] for r in files.select("path", "text").mapInPandas(write, "n long").groupBy().sum("n").withColumnRenamed("sum(n)", "n").collect() if r["n"])
