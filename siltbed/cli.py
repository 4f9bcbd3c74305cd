"""python -m siltbed.cli FOLDER [--config FILE]: a line-based shell over a store.

Each line is a verb and its arguments, separated by blanks; help lists the verbs.
"""

from __future__ import annotations

import argparse
import sys
from collections.abc import Callable, Iterator

from siltbed.config import Config
from siltbed.engine import Engine, Missing, RateLimited
from siltbed.functions.ttl import UNITS
from siltbed.operators.folds import BLOOM, CMS, HLL


def ttl_ms(text: str) -> int:
    for unit, ms in UNITS.items():
        number = text[: len(text) - len(unit)]
        if text.endswith(unit) and number.isascii() and number.isdigit():
            return int(number) * ms
    raise ValueError(f"{text} is no time to live")


def show(value: bytes | None) -> str:
    return "not found" if value is None else value.decode(errors="backslashreplace")


class Shell:
    def __init__(self, engine: Engine, lines: Iterator[str], out: Callable[[str], None] = print):
        self.engine, self.lines, self.out = engine, lines, out
        self.verbs: dict[str, tuple[int, Callable]] = {
            "put": (2, self.put), "get": (1, lambda k: show(engine.get(k))), "del": (1, lambda k: engine.delete(k)), "del-range": (2, lambda a, b: engine.range_delete(a, b)),
            "clear-all": (0, lambda: engine.clear_all()), "expire": (2, lambda *a: engine.expire(a[:-1], ttl_ms(a[-1]))), "ttl": (1, self.ttl),
            "batch-write": (2, lambda *a: engine.batch_write(list(zip(a[::2], a[1::2], strict=True)))), "batch-delete": (1, lambda *a: engine.batch_delete(a)),
            "range-scan": (3, lambda a, b, n: self.pages(engine.paged_range_scan(a, b, int(n)))), "prefix-scan": (2, lambda p, n: self.pages(engine.paged_prefix_scan(p, int(n)))),
            "range-iterate": (2, lambda a, b: self.iterate(engine.range_iterate(a, b))), "prefix-iterate": (1, lambda p: self.iterate(engine.prefix_iterate(p))),
            "snapshot": (1, lambda k: engine.snapshot(k)), "get-versions": (1, self.versions), "get-version": (2, lambda k, n: show(engine.get_version(k, int(n)))),
            "list-sstables": (0, self.tables), "validate-sstable": (0, self.validate), "compact": (0, lambda: engine.compact()),
            "flush": (0, lambda: "flushed" if engine.flush() else "nothing to flush"), "maintain": (0, lambda: "\n".join(engine.maintain()) or "nothing to do"),
            "list-backups": (0, lambda: "\n".join(f"{b['id']} {b['type']} {b['ts']}" for b in engine.backups())), "create-backup": (0, lambda kind="full": engine.create_backup(kind)),
            "restore-backup": (1, self.restore), "rebuild-backup": (1, lambda b: engine.rebuild_backup(b)["id"]), "delete-backup": (1, lambda b: " ".join(engine.delete_backup(b))),
            "cascade-delete-backup": (1, lambda b: " ".join(engine.delete_backup(b, cascade=True))), "delete-all-backups": (0, lambda: engine.delete_all_backups()),
            "bf-create": (2, lambda name, n, p="0.01": engine.bf_create(name, int(n), float(p))), "bf-add": (2, lambda n, x: engine.bf_add(n, x)),
            "bf-contains": (2, lambda n, x: "maybe" if engine.bf_contains(n, x) else "no"), "bf-delete": (1, lambda n: engine.bf_delete(n)),
            "cms-create": (1, lambda n: engine.cms_create(n)), "cms-add": (2, lambda n, x: engine.cms_add(n, x)), "cms-freq": (2, lambda n, x: str(engine.cms_freq(n, x))), "cms-delete": (1, lambda n: engine.cms_delete(n)),
            "hll-create": (1, lambda n: engine.hll_create(n)), "hll-add": (2, lambda n, x: engine.hll_add(n, x)), "hll-count": (1, lambda n: str(engine.hll_count(n))), "hll-delete": (1, lambda n: engine.hll_delete(n)),
            "sh-store": (2, lambda n, *w: engine.sh_store(n, " ".join(w))), "sh-dist": (2, lambda a, b: str(engine.sh_distance(a, b))), "sh-delete": (1, lambda n: engine.sh_delete(n)), "sh-set": (2, lambda n, x: engine.sh_set(n, x)), "sh-get": (1, lambda n: engine.sh_get(n)),
            "bf-clear": (1, lambda n: engine.sketch_clear(BLOOM, n)), "cms-clear": (1, lambda n: engine.sketch_clear(CMS, n)), "hll-clear": (1, lambda n: engine.sketch_clear(HLL, n)),
            "bf-merge": (2, lambda n, o: engine.sketch_merge(BLOOM, n, o)), "cms-merge": (2, lambda n, o: engine.sketch_merge(CMS, n, o)), "hll-merge": (2, lambda n, o: engine.sketch_merge(HLL, n, o)),
            "dataraw": (0, lambda: self.rows(20)), "print-wal": (0, lambda: self.rows(20)), "help": (0, lambda: " ".join(sorted(self.verbs))), "help-probabilistic": (0, lambda: " ".join(v for v in sorted(self.verbs) if v[:3] in ("bf-", "cms", "hll", "sh-"))),
        }

    def put(self, key: str, value: str, ttl: str | None = None) -> None:
        if ttl is None:
            self.engine.put(key, value)
        else:
            self.engine.put_with_ttl(key, value, ttl_ms(ttl))

    def ttl(self, key: str) -> str:
        left = self.engine.get_ttl(key)
        return "not found" if left is None else "no expiry" if left == 0 else f"{left} ms"

    def versions(self, key: str, most: str = "0") -> str:
        return "\n".join(f"{seq} {show(value)}" for seq, value in self.engine.get_versions(key, int(most)))

    def tables(self) -> str:
        return "\n".join(f"{t['path']} layer {t['layer']} rows {t['rows']} bytes {t['bytes']} seq {t['min_seq']}-{t['max_seq']}" for t in self.engine.tables())

    def validate(self) -> str:
        return "\n".join(f"{path} {'valid' if valid else f'invalid, {bad} records differ, the first is {first}'}" for path, valid, bad, first in self.engine.validate())

    def restore(self, backup_id: str) -> str:
        safe = self.engine.restore_backup(backup_id)
        return "restored" if safe is None else f"restored; the state before is checkpoint {safe}"

    def rows(self, n: int) -> str:
        rows = self.engine.log().orderBy("seq_id").limit(n).collect()
        return "\n".join(f"{r.seq_id} {r.op_type} {show(bytes(r.key))}" for r in rows)

    def _page(self, page) -> None:
        self.out(f"page {page.number}")
        for key, value in page.rows:
            self.out(f"{show(key)} {show(value)}")

    def pages(self, cursor) -> None:
        """n or next, p or prev, anything else stops."""
        self._page(cursor.current_page())
        for line in self.lines:
            word = line.strip()
            if word in ("n", "next"):
                page = cursor.next_page()
                self.out("no more pages") if page is None else self._page(page)
            elif word in ("p", "prev"):
                self._page(cursor.prev_page())
            else:
                return

    def iterate(self, rows) -> None:
        """n or next for one row more, anything else stops."""
        for line in self.lines:
            if line.strip() not in ("n", "next"):
                return
            row = next(rows, None)
            if row is None:
                self.out("end")
                return
            self.out(f"{show(row[0])} {show(row[1])}")

    def run(self) -> None:
        for line in self.lines:
            verb, *args = line.split() or [""]
            if verb in ("exit", "quit", "q"):
                return
            if not verb:
                continue
            try:
                least, act = self.verbs[verb]
            except KeyError:
                self.out(f"{verb} is no verb; help lists them")
                continue
            if len(args) < least:
                self.out(f"{verb} takes {least} arguments at least")
                continue
            try:
                said = act(*args)
                if said is not None:
                    self.out(said)
            except (ValueError, TypeError, Missing, RateLimited) as e:
                self.out(f"error: {e}")


#: Flags of the store and the setting of each.
SETTINGS = {
    "--memtable-max-size": ("flush_rows", int), "--memtable-max-size-b": ("file_bytes", int), "--lsm-compaction": ("compaction", str), "--ttl-refresh-rate": ("expiry_refresh_ms", int),
    "--token-bucket-max-tokens": ("bucket_tokens", int), "--token-bucket-reset-ms": ("bucket_interval_ms", int), "--wal-seg-max-blocks": ("segment_writes", int),
}
#: Flags about the inside of one process, which Parquet and Spark's memory replace: taken, and said to have no effect.
PHYSICAL = ["--memtable-type", "--instances", "--sst-format", "--block-cache-max-blocks"]


def parse(argv: list[str] | None) -> tuple[argparse.Namespace, Config, list[str]]:
    """Arguments, the settings they make, and the flags without effect."""
    parser = argparse.ArgumentParser(prog="siltbed", description=__doc__)
    parser.add_argument("folder")
    parser.add_argument("-c", "--config", help="file of settings")
    parser.add_argument("-d", "--debug", action="store_true", default=None)
    parser.add_argument("--create-default-config", action="store_true", help="write the default settings to the file of --config, or config.json, and end")
    parser.add_argument("--ttl-in-memory", action=argparse.BooleanOptionalAction, default=None, dest="expiry_events", help="tell expiries")
    for flag, (field, kind) in SETTINGS.items():
        parser.add_argument(flag, dest=field, type=kind)
    for flag in PHYSICAL:
        parser.add_argument(flag)
    args = parser.parse_args(argv)
    changes = {field: getattr(args, field) for field, _ in SETTINGS.values()} | {"debug": args.debug, "expiry_events": args.expiry_events}
    config = Config.load(args.config, **changes) if args.config and not args.create_default_config else Config(**{k: v for k, v in changes.items() if v is not None})
    return args, config, [f for f in PHYSICAL if getattr(args, f[2:].replace("-", "_")) is not None]


def main(argv: list[str] | None = None) -> None:
    from pyspark.sql import SparkSession

    args, config, idle = parse(argv)
    if args.create_default_config:
        with open(args.config or "config.json", "w") as f:
            f.write(Config().text())
        return
    for flag in idle:
        print(f"{flag} has no effect here", file=sys.stderr)
    spark = SparkSession.builder.appName("siltbed").getOrCreate()
    spark.sparkContext.setLogLevel("INFO" if config.debug else "WARN")
    engine = Engine(spark, args.folder, config)
    query = engine.tell_expiries(print) if config.expiry_events else None
    Shell(engine, iter(sys.stdin)).run()
    if query is not None:
        query.stop()


if __name__ == "__main__":
    main()
