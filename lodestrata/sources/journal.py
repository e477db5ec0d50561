"""Durable installation of files in a folder: an exclusive lock, a write-ahead journal, and recovery by whoever comes next.

A transaction stages files in a folder of its own below the target. Its journal is a file of lines that is only added to and synced: the entries, then
`prepared`, `committed`. Between these two, each file that stands in the way is moved to the backups and the staged one takes its
place. Whatever comes after a crash holds the lock, finds the journal and, if it is not committed, puts every old file back and takes every
new one away; if it is, it only clears up. So after recovery all files are old or all are new. A staging folder without a
journal has installed nothing; it may be a live writer's and is left alone until `clear` is told to remove it.
"""

from __future__ import annotations

import fcntl
import json
import os
import shutil
import stat
import time
import uuid
from collections.abc import Iterable

LOCK, STAGING, JOURNAL, BACKUPS = ".lodestrata-lock", ".staging-", "journal", "backups"


class FolderLock:
    """An exclusive lock on a folder, held by this process until it is released or ends. A second holder is refused."""

    def __init__(self, root: str):
        path = os.path.join(root, LOCK)
        self._file = os.open(path, os.O_RDWR | os.O_CREAT | os.O_NOFOLLOW | os.O_CLOEXEC, 0o644)
        try:
            if not stat.S_ISREG(os.fstat(self._file).st_mode):
                raise OSError(f"{path} is no regular file")
            fcntl.flock(self._file, fcntl.LOCK_EX | fcntl.LOCK_NB)
        except BlockingIOError:
            os.close(self._file)
            raise BlockingIOError(f"another writer holds {root}") from None
        except OSError:
            os.close(self._file)
            raise

    def release(self) -> None:
        os.close(self._file)

    def __enter__(self) -> FolderLock:
        return self

    def __exit__(self, *_) -> None:
        self.release()


def _sync(folder: str) -> None:
    handle = os.open(folder, os.O_RDONLY)
    try:
        os.fsync(handle)
    finally:
        os.close(handle)


def safe_name(name: str) -> str:
    if not name or name in (".", "..") or os.path.basename(name) != name or "\0" in name or name.startswith(STAGING) or name == LOCK:
        raise ValueError(f"{name!r} is no file name")
    return name


class Transaction:
    """One installation below `root`; `stage` is where files are staged. The caller holds the lock while it commits."""

    def __init__(self, root: str, stage: str | None = None):
        self.root = root
        self.stage = stage or os.path.join(root, f"{STAGING}{uuid.uuid4().hex}")
        os.makedirs(self.stage, exist_ok=True)

    def _write(self, *lines: dict) -> None:
        with open(os.path.join(self.stage, JOURNAL), "a") as f:
            for line in lines:
                f.write(json.dumps(line) + "\n")
            f.flush()
            os.fsync(f.fileno())

    def commit(self, files: Iterable[tuple[str, str]], overwrite: bool = False) -> int:
        """Installs (name, staged name) pairs; all or, after an error, none. Returns how many."""
        entries, seen = [], set()
        for name, staged in files:
            target = os.path.join(self.root, safe_name(name))
            if name in seen:
                raise ValueError(f"two files have the name {name!r}")
            seen.add(name)
            try:
                found = os.lstat(target)
            except FileNotFoundError:
                found = None
            if found is not None and (not overwrite or not stat.S_ISREG(found.st_mode)):
                raise FileExistsError(f"{target} is there already")
            entries.append({"name": name, "staged": safe_name(staged), "replaces": found is not None})
        os.makedirs(os.path.join(self.stage, BACKUPS), exist_ok=True)
        self._write(*entries)
        self._write({"phase": "prepared"})
        _sync(self.stage)
        try:
            for e in entries:
                target = os.path.join(self.root, e["name"])
                if e["replaces"]:
                    os.replace(target, os.path.join(self.stage, BACKUPS, e["name"]))
                os.replace(os.path.join(self.stage, e["staged"]), target)
            _sync(os.path.join(self.stage, BACKUPS)), _sync(self.root)
            self._write({"phase": "committed"})
        except OSError:
            _roll_back(self.root, self.stage, entries)
            raise
        shutil.rmtree(self.stage, ignore_errors=True)
        return len(entries)

    def abort(self) -> None:
        """Takes the staged files away, unless a journal says that they may be installed."""
        if not os.path.exists(os.path.join(self.stage, JOURNAL)):
            shutil.rmtree(self.stage, ignore_errors=True)


def _read(stage: str) -> tuple[list[dict], str | None]:
    """(entries, last phase); a line that was cut off counts for nothing."""
    entries, phase = [], None
    with open(os.path.join(stage, JOURNAL)) as f:
        for line in f:
            try:
                found = json.loads(line)
            except ValueError:
                break
            if "phase" in found:
                phase = found["phase"]
            else:
                entries.append(found)
    for e in entries:
        safe_name(e["name"]), safe_name(e["staged"])
    return entries, phase


def _roll_back(root: str, stage: str, entries: list[dict]) -> None:
    """Every old file back, every new one away. May be done again after it was cut off."""
    for e in reversed(entries):
        target, backup = os.path.join(root, e["name"]), os.path.join(stage, BACKUPS, e["name"])
        if e["replaces"]:
            if os.path.lexists(backup):
                os.replace(backup, target)
        elif not os.path.lexists(os.path.join(stage, e["staged"])) and os.path.lexists(target):
            os.remove(target)
    _sync(root)
    shutil.rmtree(stage)


def recover(root: str) -> list[tuple[str, str]]:
    """(staging folder, `rolled back` or `cleared`) of each transaction that was cut off. The caller holds the lock."""
    done = []
    for name in sorted(os.listdir(root)):
        stage = os.path.join(root, name)
        if not name.startswith(STAGING) or os.path.islink(stage) or not os.path.exists(os.path.join(stage, JOURNAL)):
            continue
        entries, phase = _read(stage)
        if phase == "prepared":
            _roll_back(root, stage, entries)
        else:  # nothing was moved, or all was
            shutil.rmtree(stage)
        done.append((name, "rolled back" if phase == "prepared" else "cleared"))
    return done


def clear(root: str, older_than: float) -> list[str]:
    """Removes staging folders without a journal in which nothing has changed for so many seconds. The caller holds the lock."""
    gone = []
    for name in sorted(os.listdir(root)):
        stage = os.path.join(root, name)
        if name.startswith(STAGING) and not os.path.exists(os.path.join(stage, JOURNAL)):
            last = max([os.lstat(stage).st_mtime, *(os.lstat(os.path.join(stage, n)).st_mtime for n in os.listdir(stage))])
            if time.time() - last >= older_than:
                shutil.rmtree(stage)
                gone.append(name)
    return gone
