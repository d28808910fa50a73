"""Index jobs: folders of uploaded files, one of which is indexed at a time."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from pathlib import Path


class JobConflictError(RuntimeError):
    """Another job is writing."""


@dataclass
class Job:
    id: str
    folder: Path
    status: str = "created"
    error: str | None = None
    counts: dict[str, int] = field(default_factory=dict)
    events: list[dict] = field(default_factory=list)
    changed: threading.Condition = field(default_factory=threading.Condition)

    def tell(self, **event) -> None:
        with self.changed:
            self.events.append(event)
            self.changed.notify_all()


class Jobs:
    """Jobs by id.  ``write`` indexes a folder for a job and returns counts; as
    the archive has one writer, a second start is refused while one runs."""

    def __init__(self, root: str | Path, write: Callable[[str, str], dict[str, int]]):
        self.root, self.write = Path(root), write
        self.by_id: dict[str, Job] = {}
        self.lock = threading.Lock()
        self.running: str | None = None

    def create(self) -> Job:
        job = Job(uuid.uuid4().hex, Path())
        job.folder = self.root / job.id
        job.folder.mkdir(parents=True)
        self.by_id[job.id] = job
        return job

    def add(self, job: Job, name: str, content: bytes) -> str:
        """Puts a file into the job's folder; of a path its last part counts."""
        plain = Path(name.replace("\\", "/")).name
        if plain in ("", ".", ".."):
            raise ValueError(f"{name!r} is not a file name")
        (job.folder / plain).write_bytes(content)
        return plain

    def start(self, job: Job) -> threading.Thread:
        with self.lock:
            if self.running is not None:
                raise JobConflictError(f"job {self.running} is running")
            self.running = job.id
        job.status = "running"
        job.tell(status="running")

        def work() -> None:
            try:
                job.counts = self.write(str(job.folder), job.id)
                job.status = "done"
            except Exception as e:  # noqa: BLE001  the job reports it
                job.status, job.error = "failed", f"{type(e).__name__}: {e}"
            finally:
                with self.lock:
                    self.running = None
                job.tell(status=job.status, error=job.error, **job.counts)

        thread = threading.Thread(target=work, daemon=True)
        thread.start()
        return thread

    def follow(self, job: Job, wait: float = 600) -> Iterator[dict]:
        """Events of a job from its first until it ends."""
        at = 0
        while True:
            with job.changed:
                if at == len(job.events) and job.status in ("created", "running"):
                    job.changed.wait(wait)
                fresh = job.events[at:]
            yield from (e for e in fresh if e is not None)
            at += len(fresh)
            if not fresh or fresh[-1].get("status") in ("done", "failed"):
                return
