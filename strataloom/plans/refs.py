"""Branches, tags and HEAD: small files that the driver keeps."""

from __future__ import annotations

import re
from dataclasses import dataclass

from ..model import DEFAULT_BRANCH, ZERO_HASH, BranchExists, BranchNameEmpty, BranchNameReserved, BranchNotFound, BranchPathConflict, ConcurrentUpdate, CorruptedData, InvalidBranchName, InvalidHeadFormat
from ..sources.files import Files

HASH = re.compile(r"[0-9a-f]{64}")
# As one pattern for bulk checks: what makes a name invalid.
INVALID = r"^$|^HEAD$|^[-.]|\.lock$|\.\.|//|[ ~^:?*\[\\]|^/|/$|/\.|[\x00-\x1f\x7f]"


def check_name(name: str) -> str:
    """name, if it may name a branch; what would alias another name or hide from listings may not."""
    if not name:
        raise BranchNameEmpty("a branch name is one character or more")
    if name == "HEAD":
        raise BranchNameReserved(name)
    if re.search(INVALID, name):
        raise InvalidBranchName(name)
    return name


@dataclass(frozen=True)
class Head:
    branch: str
    is_detached: bool
    commit_hash: str


class Refs:
    """Refs below a store's folder, in `refs/heads` or another folder."""

    def __init__(self, files: Files, folder: str = "refs/heads"):
        self.files, self.folder = files, folder

    def file(self, name: str) -> str:
        return f"{self.folder}/{check_name(name)}"

    def exists(self, name: str) -> bool:
        return self.files.is_file(self.file(name))

    def get(self, name: str) -> str:
        raw = self.files.read(self.file(name))
        if raw is None:
            raise BranchNotFound(name)
        text = raw.decode().strip()
        if not HASH.fullmatch(text):
            raise CorruptedData(f"{name} holds no hash")
        return text

    def create(self, name: str, commit: str) -> None:
        file = self.file(name)
        if self.files.is_file(file):
            raise BranchExists(name)
        if self.files.is_folder(file):
            raise BranchPathConflict(f"{name} is a folder of other branches")
        parts = name.split("/")
        for n in range(1, len(parts)):
            if self.files.is_file(f"{self.folder}/{'/'.join(parts[:n])}"):
                raise BranchPathConflict(f"{'/'.join(parts[:n])} is a branch")
        self.files.write(file, f"{commit}\n".encode())

    def update(self, name: str, commit: str, expected: str | None = None) -> None:
        """Move a branch; with expected, only from there."""
        now = self.get(name)
        if expected is not None and now != expected:
            raise ConcurrentUpdate(f"{name} moved from {expected[:12]} to {now[:12]}")
        self.files.write(self.file(name), f"{commit}\n".encode())

    def delete(self, name: str) -> None:
        self.get(name)
        self.files.delete(self.file(name))
        parts = name.split("/")[:-1]
        while parts and not self.files.walk(f"{self.folder}/{'/'.join(parts)}"):
            self.files.delete(f"{self.folder}/{'/'.join(parts)}")
            parts.pop()

    def list(self) -> list[tuple[str, str]]:
        names = [f.removeprefix(f"{self.folder}/") for f in self.files.walk(self.folder)]
        return [(n, self.get(n)) for n in names]


class HeadFile:
    """HEAD: attached to a branch, or detached at a commit."""

    def __init__(self, files: Files, refs: Refs):
        self.files, self.refs = files, refs

    def get(self) -> Head:
        raw = self.files.read("HEAD")
        if raw is None:
            return Head(DEFAULT_BRANCH, False, self.refs.get(DEFAULT_BRANCH) if self.refs.exists(DEFAULT_BRANCH) else ZERO_HASH)
        text = raw.decode("utf-8", "replace").strip()
        prefix = "ref: refs/heads/"
        if text.startswith(prefix) and len(text) > len(prefix):
            name = text.removeprefix(prefix)
            return Head(name, False, self.refs.get(name) if self.refs.exists(name) else ZERO_HASH)
        if HASH.fullmatch(text):
            return Head("", True, text)
        raise InvalidHeadFormat(text[:80])

    def attach(self, name: str) -> None:
        self.refs.get(name)
        self.files.write("HEAD", f"ref: refs/heads/{name}\n".encode())

    def detach(self, commit: str) -> None:
        if not HASH.fullmatch(commit):
            raise InvalidHeadFormat(commit)
        self.files.write("HEAD", f"{commit}\n".encode())

    def initialise(self) -> None:
        if self.files.read("HEAD") is None:
            self.files.write("HEAD", f"ref: refs/heads/{DEFAULT_BRANCH}\n".encode())
