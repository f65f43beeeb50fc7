"""A Python data source that reads a directory tree: every regular file, hidden and empty ones too, symlinks not followed.

spark.dataSource.register(TreeSource); spark.read.format("quern_tree").option("include_ignored", "true").load(root)
gives path, entry, bytes, header (first 512 bytes) and content (up to max_bytes, else null). The root must be on a file
system that all executors mount. Planning names folders of the upper levels only, about `splits` of them; the tasks walk
what is below, apply ignore rules, ask git for tracked files of their folders, and read. With `links`, symlinks and what
can't be read are rows too (entry: symlink, unreadable). Tests on path (equal, in, prefix, suffix) are applied before a
file is opened, and a prefix before its folder is listed, with `push_filters`, which needs spark.sql.python.filterPushdown.enabled.
"""

from __future__ import annotations

import os
import re
import subprocess
from collections.abc import Iterable, Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringEndsWith, StringStartsWith
from pyspark.sql.types import StructType

# Directories that are never entered, and those that only a catalog scan leaves out.
EXCLUDED = {".git", ".worktrees", ".worktree", ".build", ".swiftpm", ".quern", "target", "build", "DerivedData", ".github", ".codex", ".claude", ".agents", ".idea", ".vscode"}
DEPENDENCIES = {"Pods", "Carthage", "node_modules"}
HEADER, MAX_BYTES, SPLITS = 512, 64 << 20, 256


class Ignore:
    """The rules of one ignore file, relative to its folder; the last match decides."""

    def __init__(self, lines: list[str]):
        self.rules: list[tuple[re.Pattern, bool, bool]] = []
        for line in lines:
            line = line.rstrip("\n")
            line = line if line.endswith("\\ ") else line.rstrip()
            if not line or line.startswith("#"):
                continue
            negated = line.startswith("!")
            line = line[1:] if negated else line
            folder = line.endswith("/")
            line = line.rstrip("/")
            anchored = "/" in line
            self.rules.append((re.compile(self._regex(line.lstrip("/"), anchored)), negated, folder))

    @staticmethod
    def _regex(glob: str, anchored: bool) -> str:
        out, i = "" if anchored else "(?:.*/)?", 0
        while i < len(glob):
            if glob.startswith("**/", i):
                out, i = out + "(?:.*/)?", i + 3
            elif glob.startswith("**", i):
                out, i = out + ".*", i + 2
            elif glob[i] == "*":
                out, i = out + "[^/]*", i + 1
            elif glob[i] == "?":
                out, i = out + "[^/]", i + 1
            elif glob[i] == "[" and "]" in glob[i + 1 :]:
                end = glob.index("]", i + 1)
                out, i = out + glob[i : end + 1].replace("[!", "[^"), end + 1
            else:
                out, i = out + re.escape(glob[i]), i + 1
        return out + r"\Z"

    def verdict(self, relative: str, is_dir: bool) -> bool | None:
        out = None
        for pattern, negated, folder in self.rules:
            if (is_dir or not folder) and pattern.match(relative):
                out = not negated
        return out


def _git(root: str, *args: str) -> str | None:
    """What a git command prints, or None without git or outside a work tree."""
    try:
        done = subprocess.run(["git", "-c", "core.fsmonitor=false", "-C", root, *args], capture_output=True, timeout=60, env=os.environ | {"GIT_OPTIONAL_LOCKS": "0"})
    except (OSError, subprocess.TimeoutExpired):
        return None
    return done.stdout.decode(errors="surrogateescape") if done.returncode == 0 else None


def tracked(root: str, below: str = "") -> set[str]:
    """Files that git tracks in a folder, those of submodules too, which count even when ignored; none below a folder that is never entered."""
    prefix = _git(root, "rev-parse", "--show-prefix")
    listed = _git(root, "ls-files", "--cached", "--recurse-submodules", "--full-name", "-z", "--", f":(literal){below}" if below else ".") if prefix is not None else None
    prefix = (prefix or "").rstrip("\r\n")
    names = [n[len(prefix) :] for n in (listed or "").split("\0") if n and n.startswith(prefix)]
    return {n for n in names if not EXCLUDED & set(n.split("/")[:-1]) and not {"", ".", ".."} & set(n.split("/"))}


def _read_rules(path: str) -> list[Ignore]:
    if not os.path.isfile(path):
        return []
    with open(path, encoding="utf-8", errors="replace") as f:
        return [Ignore(f.readlines())]


def global_rules(root: str) -> list[Ignore]:
    """The user's own ignore file: git's core.excludesFile, else git/ignore in the configuration folder."""
    named = (_git(root, "config", "--path", "--get", "core.excludesFile") or "").strip()
    home = os.environ.get("XDG_CONFIG_HOME") or os.path.expanduser("~/.config")
    return _read_rules(named or os.path.join(home, "git", "ignore"))


def parent_rules(root: str) -> list[tuple[str, Ignore]]:
    """Rules of the folders above the root, the farthest first, each with its path from there to the root."""
    root = os.path.abspath(root)
    out, inside, folder = [], os.path.basename(root), os.path.dirname(root)
    while inside:
        out += [(inside, rule) for rule in _read_rules(os.path.join(folder, ".gitignore"))]
        if os.path.isdir(os.path.join(folder, ".git")) or folder == os.path.dirname(folder):
            break
        inside, folder = f"{os.path.basename(folder)}/{inside}", os.path.dirname(folder)
    return out[::-1]


class Tree:
    """What is in a tree, folder by folder."""

    def __init__(self, root: str, include_ignored: bool = False):
        self.root, self.include = root, include_ignored
        self.outer = [] if include_ignored else parent_rules(root)
        self.first = [] if include_ignored else [("", r) for r in global_rules(root) + _read_rules(os.path.join(root, ".git", "info", "exclude"))]

    def _rules(self, folder: str) -> list[tuple[str, Ignore]]:
        """Rules of a folder and those above it, the nearest last."""
        chain = [""] + ["/".join(folder.split("/")[: n + 1]) for n in range(folder.count("/") + 1)] * bool(folder)
        return [] if self.include else [(f, r) for f in chain for r in _read_rules(os.path.join(self.root, f, ".gitignore"))]

    def _ignored(self, path: str, is_dir: bool, rules: list[tuple[str, Ignore]]) -> bool:
        said = [ignore.verdict(path, is_dir) for _, ignore in self.first]
        said += [ignore.verdict(f"{inside}/{path}", is_dir) for inside, ignore in self.outer]
        said += [ignore.verdict(path[len(base) + 1 :] if base else path, is_dir) for base, ignore in rules]
        return next((v for v in reversed(said) if v is not None), False)

    def _entered(self, folder: str, known: set[str]) -> bool:
        """Whether a walk from the root comes to this folder: none on the way is left out, unless git tracks something below."""
        parts = folder.split("/") if folder else []
        for n in range(1, len(parts) + 1):
            here = "/".join(parts[:n])
            if parts[n - 1] in EXCLUDED or os.path.islink(os.path.join(self.root, here)):
                return False
            if not self.include and self._ignored(here, True, self._rules("/".join(parts[: n - 1]))) and not any(k.startswith(here + "/") for k in known):
                return False
        return True

    def entries(self, folder: str, deep: bool) -> Iterator[tuple[str, str]]:
        """(path, kind) of a folder's own entries, and with deep of all below it. Nothing if a walk from the root would not come here."""
        known = set() if self.include else tracked(self.root, folder)
        if not self._entered(folder, known):
            return
        above = {"/".join(k.split("/")[:n]) for k in known for n in range(1, k.count("/") + 1)}
        stack = [(folder, self._rules(folder))]
        while stack:
            here, rules = stack.pop()
            try:
                found = sorted(os.scandir(os.path.join(self.root, here)), key=lambda e: e.name)
            except OSError:
                yield here, "unreadable"
                continue
            for entry in found:
                path = f"{here}/{entry.name}" if here else entry.name
                if entry.is_symlink():
                    yield path, "symlink"
                elif entry.is_dir(follow_symlinks=False):
                    if deep and entry.name not in EXCLUDED and (self.include or not self._ignored(path, True, rules) or path in above):
                        own = [] if self.include else [(path, r) for r in _read_rules(os.path.join(self.root, path, ".gitignore"))]
                        stack.append((path, rules + own))
                elif entry.is_file() and (self.include or path in known or not self._ignored(path, False, rules)):
                    yield path, "file"

    def units(self, splits: int) -> list[tuple[str, bool]]:
        """(folder, deep) that make up the tree: levels are opened until there are `splits` folders, or four levels."""
        done, level = [], [""]
        for _ in range(4):
            if len(done) + len(level) >= splits or not level:
                break
            below = []
            for folder in level:
                done.append((folder, False))
                try:
                    below += [f"{folder}/{e.name}" if folder else e.name for e in os.scandir(os.path.join(self.root, folder)) if e.is_dir(follow_symlinks=False) and e.name not in EXCLUDED]
                except OSError:
                    pass  # its task says so
            level = below
        return done + [(folder, True) for folder in level]


def walk(root: str, include_ignored: bool = False) -> list[str]:
    """Relative paths of a small tree's files, in order of their parts, on this machine."""
    return sorted((p for p, kind in Tree(root, include_ignored).entries("", True) if kind == "file"), key=lambda p: p.split("/"))


class _Units(InputPartition):
    def __init__(self, units: list[tuple[str, bool]]):
        self.units = units


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        said = lambda name: str(options.get(name, "false")).lower() == "true"
        self.root, self.include, self.links = options["path"], said("include_ignored"), said("links")
        self.most = int(options.get("max_bytes", MAX_BYTES))
        self.splits = int(options.get("splits", SPLITS))
        self.tests: list[tuple[str, object]] = []

    def _wanted(self, path: str) -> bool:
        says = {"EqualTo": lambda v: path == v, "In": lambda v: path in v, "StringStartsWith": path.startswith, "StringEndsWith": path.endswith}
        return all(says[name](value) for name, value in self.tests)

    def _reaches(self, folder: str, deep: bool) -> bool:
        """Whether a folder can hold a path with every prefix asked for."""
        inside = f"{folder}/" if folder else ""
        heads = [v for name, v in self.tests if name in ("StringStartsWith", "EqualTo")]
        return all(inside.startswith(v) or v.startswith(inside) for v in heads)

    def partitions(self) -> list[_Units]:
        units = [u for u in Tree(self.root, True).units(self.splits) if self._reaches(*u)]
        count = min(len(units), self.splits) or 1
        return [_Units(units[i::count]) for i in range(count)]

    def read(self, partition: _Units) -> Iterator[tuple]:
        tree = Tree(self.root, self.include)
        for folder, deep in partition.units:
            for name, kind in tree.entries(folder, deep):
                if not self._wanted(name) or kind != "file" and not self.links:
                    continue
                yield self._row(name) if kind == "file" else (name, kind, None, None, None)

    def _row(self, name: str) -> tuple:
        try:
            fd = os.open(os.path.join(self.root, name), os.O_RDONLY | os.O_NOFOLLOW)
        except OSError:
            return name, "unreadable", None, None, None
        with open(fd, "rb") as f:
            size = os.fstat(fd).st_size
            content = f.read() if size <= self.most else None
            header = content[:HEADER] if content is not None else f.read(HEADER)
        return name, "file", size, header, content


class _FilteringReader(_Reader):
    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if getattr(f, "attribute", None) == ("path",) and isinstance(f, (EqualTo, In, StringStartsWith, StringEndsWith)):
                self.tests.append((type(f).__name__, f.value))
            else:
                yield f


class TreeSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "quern_tree"

    def schema(self) -> str:
        return "path string, entry string, bytes bigint, header binary, content binary"

    def reader(self, schema: StructType) -> DataSourceReader:
        options = dict(self.options)
        return (_FilteringReader if str(options.get("push_filters", "false")).lower() == "true" else _Reader)(options)
