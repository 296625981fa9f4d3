"""Immutable artifacts: a staged folder, a manifest with file hashes and parents, and one atomic rename."""

from __future__ import annotations

import hashlib
import shutil
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from pathlib import Path

from vitrine.sources.sinks import canonical_json, json_digest, strict_json

MANIFEST, DONE = "manifest.json", "_SUCCESS"


class ArtifactError(ValueError):
    """An artifact is missing, damaged or contradicts its parents."""


@dataclass(frozen=True)
class Artifact:
    path: Path
    kind: str
    config_sha256: str
    files: dict[str, str]
    parents: dict[str, str]

    @property
    def digest(self) -> str:
        return json_digest({"kind": self.kind, "config": self.config_sha256, "files": self.files, "parents": self.parents})


def file_digest(path: Path, chunk: int = 1 << 20) -> str:
    h = hashlib.sha256()
    with path.open("rb") as f:
        while block := f.read(chunk):
            h.update(block)
    return h.hexdigest()


class ArtifactStore:
    """Artifacts below ``root``, by kind and digest of their configuration."""

    def __init__(self, root: Path) -> None:
        self.root = Path(root)

    def place(self, kind: str, config: object) -> Path:
        return self.root / kind / json_digest(config)

    @contextmanager
    def stage(self, kind: str, config: object, parents: dict[str, Artifact] | None = None) -> Iterator[Path]:
        """A folder to write into. It becomes the artifact when the block ends well, else it is removed."""
        final = self.place(kind, config)
        if (final / DONE).exists():
            raise ArtifactError(f"{final} exists; artifacts never change")
        draft = self.root / ".staging" / uuid.uuid4().hex
        draft.mkdir(parents=True)
        try:
            yield draft
            files = {str(p.relative_to(draft)): file_digest(p) for p in sorted(draft.rglob("*")) if p.is_file() and not p.name.endswith(".crc")}
            note = {"kind": kind, "config": config, "config_sha256": json_digest(config), "files": files, "parents": {n: {"path": str(a.path), "digest": a.digest} for n, a in (parents or {}).items()}}
            (draft / MANIFEST).write_text(canonical_json(note), encoding="utf-8")
            (draft / DONE).touch()
            final.parent.mkdir(parents=True, exist_ok=True)
            draft.rename(final)
        finally:
            shutil.rmtree(draft, ignore_errors=True)

    def load(self, path: Path, _seen: tuple[Path, ...] = ()) -> Artifact:
        """The verified artifact at ``path``; its parents are verified too, and a cycle is an error."""
        path = Path(path)
        if path in _seen:
            raise ArtifactError(f"cycle of parents at {path}")
        if not (path / DONE).exists():
            raise ArtifactError(f"{path} is not complete")
        note = strict_json((path / MANIFEST).read_text(encoding="utf-8"))
        here = {str(p.relative_to(path)) for p in path.rglob("*") if p.is_file() and not p.name.endswith(".crc")} - {MANIFEST, DONE}
        if here != set(note["files"]):
            raise ArtifactError(f"{path}: files differ from the manifest")
        for name, digest in note["files"].items():
            if file_digest(path / name) != digest:
                raise ArtifactError(f"{path / name} was changed")
        parents = {}
        for name, p in note["parents"].items():
            parents[name] = self.load(Path(p["path"]), (*_seen, path)).digest
            if parents[name] != p["digest"]:
                raise ArtifactError(f"{path}: parent {name} was replaced")
        return Artifact(path, note["kind"], note["config_sha256"], note["files"], parents)

    def find(self, kind: str, config: object) -> Artifact | None:
        """The artifact of this configuration if it exists, so that nothing is built twice."""
        path = self.place(kind, config)
        return self.load(path) if (path / DONE).exists() else None


