"""Throughput of streaming queries as metric rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQueryListener


def observed(df: DataFrame, name: str = "rates") -> DataFrame:
    """Count rows and messages that are no JSON object while they pass."""
    broken = F.from_json("value", "map<string,string>").isNull()
    return df.observe(name, F.count(F.lit(1)).alias("rows"), F.count_if(broken).alias("parse_errors"))


class ThroughputListener(StreamingQueryListener):
    """Keeps one row per progress and metric until `table` takes them: time, query, metric, value."""

    def __init__(self) -> None:
        self.rows: list[tuple] = []

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        late = sum(s.numRowsDroppedByWatermark for s in p.stateOperators)
        found = {"rows": float(p.numInputRows), "producer_eps": float(p.processedRowsPerSecond or 0.0), "late_rows": float(late)}
        for name, row in (p.observedMetrics or {}).items():
            found.update({f"{name}.{k}": float(v) for k, v in row.asDict().items()})
        self.rows += [(p.timestamp, p.name or str(p.id), k, v) for k, v in found.items()]

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        pass

    def table(self, spark: SparkSession) -> DataFrame:
        """The rows since the last call; a long-running job appends them to a table."""
        taken, self.rows = self.rows, []
        rows = spark.createDataFrame(taken or [("1970-01-01T00:00:00Z", "", "", 0.0)], "ts string, query string, metric string, value double")
        return rows.where("metric <> ''").withColumn("ts", F.to_timestamp("ts"))
