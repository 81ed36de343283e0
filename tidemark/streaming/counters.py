"""Live counters of running streams, from what their micro-batches observe."""

from __future__ import annotations

from threading import Lock

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from tidemark.operators.validate import has_errors

CHECKED, KEPT, FOUND = "checked", "kept", "found"  # names of the observations
COUNTERS = "query string, batch long, events_ingested long, events_valid long, events_invalid long, events_deduped long, anomalies_detected long"


def observe_checked(validated: DataFrame) -> DataFrame:
    return validated.observe(CHECKED, F.count(F.lit(1)).alias("ingested"), F.count_if(has_errors()).alias("invalid"))


def observe_kept(kept: DataFrame) -> DataFrame:
    """kept: first deliveries, invalid ones included."""
    return kept.observe(KEPT, F.count(F.lit(1)).alias("all"), F.count_if(~has_errors()).alias("sound"))


def observe_found(anomalies: DataFrame) -> DataFrame:
    return anomalies.observe(FOUND, F.count(F.lit(1)).alias("anomalies"))


class LiveCounters(StreamingQueryListener):
    """Listens to the streams of a session, and holds the counters of every micro-batch.

    A micro-batch is known by its query, which keeps its id over restarts, and its number, so one that is repeated after
    a failure counts once. The counts are aggregates that Spark takes along while the micro-batch runs: nothing is read
    twice. With drop_invalid=False invalid events count as valid, and their repeats as duplicates, as in a batch.
    """

    def __init__(self, drop_invalid: bool = True):
        self.drop_invalid = drop_invalid
        self._seen: dict[tuple[str, int], dict[str, dict]] = {}
        self._lock = Lock()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        found = {name: row.asDict() for name, row in p.observedMetrics.items() if name in (CHECKED, KEPT, FOUND)}
        if found:
            with self._lock:
                self._seen[str(p.id), p.batchId] = found

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def batches(self) -> list[tuple]:
        """COUNTERS rows, one for each micro-batch that observed something."""
        with self._lock:
            seen = sorted(self._seen.items())
        out = []
        for (query, batch), found in seen:
            checked = found.get(CHECKED, {"ingested": 0, "invalid": 0})
            kept = found.get(KEPT, {"all": 0, "sound": 0})
            valid = kept["sound"] if self.drop_invalid else kept["all"]
            candidates = checked["ingested"] - checked["invalid"] if self.drop_invalid else checked["ingested"]
            anomalies = found.get(FOUND, {"anomalies": 0})["anomalies"]
            out.append((query, batch, checked["ingested"], valid, checked["invalid"], candidates - valid, anomalies))
        return out

    def totals(self) -> dict[str, int]:
        names = [c.split()[0] for c in COUNTERS.split(", ")][2:]
        return dict(zip(names, map(sum, zip(*(r[2:] for r in self.batches()), strict=True)), strict=True)) if self._seen else dict.fromkeys(names, 0)

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.batches(), COUNTERS)


def settle(spark: SparkSession, seconds: int = 60) -> None:
    """Waits until what ended micro-batches reported has reached the listeners."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(seconds * 1000)
