"""Settings of a store, from JSON; unknown fields and values out of range are refused."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, fields


@dataclass(frozen=True)
class Config:
    #: Rows of the log after which it is flushed to a table of layer 0, bytes of a new file, writes of a log segment before the next begins.
    flush_rows: int = 100_000
    file_bytes: int = 64 << 20
    segment_writes: int = 1000
    #: Compaction: leveled (files of layer 0, bytes of layer 1, factor of each next layer) or size-tiered (tables of a layer); number of layers.
    compaction: str = "leveled"
    first_tables: int = 4
    layer_bytes: int = 256 << 20
    layer_factor: int = 10
    tier_tables: int = 4
    layers: int = 7
    #: Expiries are told by a stream that looks this often.
    expiry_events: bool = False
    expiry_refresh_ms: int = 1000
    debug: bool = False
    #: Calls per interval; 0 calls turn the limit off.
    bucket_tokens: int = 0
    bucket_interval_ms: int = 1000
    bloom_rate: float = 0.01
    cms_accuracy: float = 0.01
    cms_confidence: float = 0.99
    hll_precision: int = 14

    def __post_init__(self):
        if self.compaction not in ("leveled", "size-tiered"):
            raise ValueError(f"compaction {self.compaction!r} is neither leveled nor size-tiered")
        for name in ("flush_rows", "file_bytes", "segment_writes", "first_tables", "layer_bytes", "layer_factor", "tier_tables", "layers", "expiry_refresh_ms", "bucket_interval_ms"):
            if getattr(self, name) <= 0:
                raise ValueError(f"{name} must be above 0")
        if self.bucket_tokens < 0 or not 4 <= self.hll_precision <= 18 or not 0 < self.bloom_rate < 1:
            raise ValueError("bucket_tokens, hll_precision or bloom_rate is out of range")

    @classmethod
    def load(cls, path: str, **changes) -> Config:
        """The file's settings with some changed, as by command-line flags (None leaves one alone)."""
        with open(path) as f:
            found = json.load(f)
        if unknown := set(found) - {f.name for f in fields(cls)}:
            raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
        return cls(**(found | {k: v for k, v in changes.items() if v is not None}))

    def text(self) -> str:
        return json.dumps(asdict(self), indent=1)
