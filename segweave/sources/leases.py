"""One writer per namespace: leases beside the segment files, with locks that are retried, on the driver's file system.

A lock is a file that only one process can create, and its content is the lease of the holder. Tables in a shared store
need none of this: a write there becomes visible as a whole.
"""

from __future__ import annotations

import json
import os
import socket
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, suppress
from dataclasses import asdict, dataclass
from datetime import datetime, timezone

# How often a lock is tried, for how long each time, and the first pause (it doubles), in seconds.
TRIES, PATIENCE, PAUSE = 3, 10.0, 0.5
#: ``strict`` forces every append to the disk, ``batched`` leaves that to the end of a batch.
DURABILITY = ("strict", "batched")


class Busy(RuntimeError):
    """A live process holds the namespace."""

    def __init__(self, namespace: str, holder: Lease | None) -> None:
        where = "" if holder is None else f" by process {holder.pid} of {holder.hostname} since {holder.started_at}"
        super().__init__(f"namespace {namespace} is held{where}")
        self.holder = holder


@dataclass(frozen=True)
class Lease:
    pid: int
    hostname: str
    started_at: str
    lease_id: str
    operation: str | None = None

    @staticmethod
    def mine(operation: str | None = None) -> Lease:
        return Lease(os.getpid(), socket.gethostname(), datetime.now(timezone.utc).isoformat(), uuid.uuid4().hex, operation)


def write(path: str, lease: Lease) -> None:
    """Replaces a lease as a whole: a reader sees the old one or the new one."""
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    draft = f"{path}.{lease.lease_id}"
    with open(draft, "w", encoding="utf-8") as f:
        json.dump(asdict(lease), f)
        f.flush()
        os.fsync(f.fileno())
    os.replace(draft, path)


def read(path: str) -> Lease | None:
    """The lease of a file; None where there is none, or nothing that is one."""
    try:
        with open(path, encoding="utf-8") as f:
            found = json.load(f)
        return Lease(int(found["pid"]), str(found["hostname"]), str(found["started_at"]), str(found["lease_id"]), found.get("operation"))
    except (OSError, ValueError, KeyError, TypeError):
        return None


def clear(path: str) -> None:
    with suppress(OSError):
        os.remove(path)


def alive(pid: int) -> bool:
    """Whether a process of this machine runs; one that may not be signalled does."""
    if pid <= 0:
        return False
    try:
        os.kill(pid, 0)
    except PermissionError:
        return True
    except OSError:
        return False
    return True


def reclaimable(lease: Lease | None) -> bool:
    """A lock may be taken over where its lease is missing, or where its holder was a process of this machine that has ended."""
    return lease is None or (lease.hostname == socket.gethostname() and not alive(lease.pid))


def _claimed(path: str, lease: Lease) -> bool:
    """Whether the lock file could be created, with the lease in it from the first moment on."""
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    draft = f"{path}.{lease.lease_id}"
    write(draft, lease)
    try:
        os.link(draft, path)
    except FileExistsError:
        return False
    finally:
        clear(draft)
    return True


@contextmanager
def session(folder: str, namespace: str, operation: str | None = None) -> Iterator[Lease]:
    """Holds a namespace for one run. A lock whose holder is dead is taken over, a live one is ``Busy`` at once."""
    path, lease = os.path.join(folder, f"{namespace}.session"), Lease.mine(operation)
    if not _claimed(path, lease):
        holder = read(path)
        if not reclaimable(holder):
            raise Busy(namespace, holder)
        clear(path)
        if not _claimed(path, lease):
            raise Busy(namespace, read(path))
    try:
        yield lease
    finally:
        if (now := read(path)) is not None and now.lease_id == lease.lease_id:
            clear(path)


@contextmanager
def locked(folder: str, namespace: str, tries: int = TRIES, patience: float = PATIENCE, pause: float = PAUSE) -> Iterator[Lease]:
    """Holds a namespace's file for one write; waits for others, with growing pauses between the tries."""
    path, lease = os.path.join(folder, f"{namespace}.lock"), Lease.mine("write")
    for k in range(tries):
        end = time.monotonic() + patience
        while not (got := _claimed(path, lease)) and time.monotonic() < end:
            if reclaimable(read(path)) and os.path.exists(path):
                clear(path)
            time.sleep(min(0.05, patience))
        if got:
            break
        time.sleep(pause * 2**k)
    else:
        raise Busy(namespace, read(path))
    try:
        yield lease
    finally:
        clear(path)


def append_lines(path: str, lines: list[str], durability: str = "strict", last: bool = True) -> int:
    """Adds lines to a changelog and gives the milliseconds it took; ``batched`` forces the disk at the last of a batch only."""
    if durability not in DURABILITY:
        raise ValueError(f"durability is one of {', '.join(DURABILITY)}")
    began = time.perf_counter()
    with open(path, "a", encoding="utf-8") as f:
        f.writelines(f"{line}\n" for line in lines)
        f.flush()
        if durability == "strict" or last:
            os.fsync(f.fileno())
    return int((time.perf_counter() - began) * 1000)
