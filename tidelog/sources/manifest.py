"""The list of runs, as numbered JSON files; the highest number is the table."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, replace

from tidelog.sources.store import Store


@dataclass(frozen=True)
class Run:
    """One immutable, sorted Parquet folder.  low and high: smallest and largest key in hex."""

    name: str
    level: int
    rows: int
    deletions: int
    low: str
    high: str
    min_seq: int
    max_seq: int


@dataclass(frozen=True)
class Manifest:
    flush_threshold: int
    fanout: int
    bloom_fpp: float
    version: int = 0
    next_seq: int = 1
    next_run: int = 0
    #: States after batches below this number are gone: compaction has dropped versions up to it.
    horizon: int = 0
    #: The last batch that each stream has put, by the stream's id.
    streams: dict[str, int] = field(default_factory=dict)
    runs: tuple[Run, ...] = field(default_factory=tuple)

    def counts(self) -> list[int]:
        top = max((r.level for r in self.runs), default=0)
        return [sum(r.level == i for r in self.runs) for i in range(top + 1)]

    def commit(self, store: Store, **changes) -> Manifest:
        new = replace(self, version=self.version + 1, **changes)
        store.write_new(f"_manifest/{new.version:012d}.json", json.dumps(asdict(new)))
        return new

    @staticmethod
    def load(store: Store, version: int | None = None) -> Manifest:
        """That version, or the last one."""
        names = [x for x in store.names("_manifest") if x.endswith(".json")]
        if not names:
            raise FileNotFoundError(f"{store.root}: no table here")
        d = json.loads(store.read(f"_manifest/{names[-1] if version is None else f'{version:012d}.json'}"))
        return Manifest(**d | {"runs": tuple(Run(**r) for r in d["runs"])})
