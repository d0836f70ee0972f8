"""Settings and lists that a stream reads anew at each micro-batch.

Settings are offered as versions, each a small file of JSON below a folder that all executors share. A batch works with the
newest version that holds; one that cannot be read or contradicts itself changes nothing. What a batch works with is
written down before it does, so a batch that is run again works with the same, whatever has been offered since.

A list is the union of the built-in entries, those a provider has fetched and the settings' own, less what they exclude.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from .. import config, features
from ..config import DetectorConfig

#: The lists that settings may name, and the category of fetched entries that belongs to each.
LISTS = {"sensitive_paths": "path", "bot_agents": "ua", "known_clients": None, "browser_agents": None, "patterns": None, "skip_paths": None}

#: Gives the version of the fetched entries and the entries (category, value, ord).
Provider = Callable[[SparkSession], tuple[int | None, DataFrame]]


class Settings:
    def __init__(self, spark: SparkSession, path: str, provider: Provider | None = None):
        self.spark, self.path, self.provider = spark, path.rstrip("/"), provider
        self.fetched: tuple[int | None, dict[str, list[str]]] = (None, {})
        self.refused: dict[int, str] = {}

    def _rows(self, place: str, schema: str) -> list:
        try:
            return self.spark.read.schema(schema).option("recursiveFileLookup", True).json(f"{self.path}/{place}").collect()
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return []

    def _write(self, place: str, row: tuple, schema: str) -> None:
        self.spark.createDataFrame([row], schema).coalesce(1).write.mode("overwrite").json(f"{self.path}/{place}")

    def offer(self, settings: dict | str) -> int:
        """Put down a new version, good or not; it holds from the next batch on."""
        version = max((r["version"] for r in self._rows("offered", "version long")), default=0) + 1
        text = settings if isinstance(settings, str) else json.dumps(settings)
        self._write(f"offered/version_{version}", (version, text), "version long, settings string")
        return version

    def current(self) -> DetectorConfig:
        """The newest version that holds, over the defaults; `refused` says why later ones do not."""
        self._fetch()
        self.refused = {}
        offered = self._rows("offered", "version long, settings string")
        for row in sorted(offered, key=lambda r: -r["version"]):
            try:
                return self._merged(json.loads(row["settings"]))
            except (ValueError, TypeError, AttributeError) as e:
                self.refused[row["version"]] = str(e)
        return self._merged({})

    def _fetch(self) -> None:
        """The provider's entries if their version is another; each category is cut to its cap, so they are few."""
        if self.provider is None:
            return
        version, rows = self.provider(self.spark)
        if features.is_newer(version, self.fetched[0]):
            most = max(features.OTHER_CAP, *features.FETCHED_CAPS.values())
            lists = features.capped(features.by_category(rows, most=most)).collect()
            self.fetched = (version, {r["category"]: list(r["items"]) for r in lists})

    def _merged(self, settings: dict) -> DetectorConfig:
        base = DetectorConfig()
        own = {n: config.feature_list(settings.get(n)) for n in LISTS}
        plain = {n: v for n, v in settings.items() if n not in LISTS}
        out = config.merge(base, plain)
        config.validate(out)
        return config.merge(out, self._lists({n: (x, list(getattr(base, n)), self.fetched[1].get(LISTS[n], [])) for n, x in own.items()}))

    def _lists(self, layers: dict) -> dict[str, list[str]]:
        """U1, U2 for lists of a few hundred entries: the enabled layers in the order built-in, fetched, own."""
        out = {}
        for name, (x, builtin, fetched) in layers.items():
            added = fetched * bool(x["cloud"]) + list(x["items"])
            if not all(isinstance(e, str) for e in [*added, *x["excludes"]]):
                raise TypeError(f"{name} holds entries that are no strings")
            # Blanks count in danger patterns and in built-in entries, which stay as they are.
            clean = (lambda e: e) if name == "patterns" else str.strip
            gone = {e.strip() for e in x["excludes"]}
            every = dict.fromkeys([*builtin * bool(x["builtin"]), *map(clean, added)])
            out[name] = [e for e in every if e.strip() and e.strip() not in gone]
        return out

    def of(self, batch: int) -> DetectorConfig:
        """The configuration of a micro-batch: the current one, or what it had when it ran before."""
        kept = self._rows(f"used/batch_{batch}", "settings string")
        if kept:
            return config.loads(kept[0]["settings"])
        cfg = self.current()
        self._write(f"used/batch_{batch}", (config.dumps(cfg),), "settings string")
        return cfg

    def each(self, work: Callable[[DataFrame, DetectorConfig, int], None]) -> Callable[[DataFrame, int], None]:
        """For foreachBatch: `work` gets every micro-batch with its configuration and number."""
        return lambda batch, k: work(batch, self.of(k), k)
