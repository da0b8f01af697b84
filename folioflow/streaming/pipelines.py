"""The same operators over streams: usage events, documents, late results and approvals."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from ..functions.text import fingerprint, size_bucket, utf16_length, word_count
from ..operators.scan import scan
from ..operators.usage import admit

#: Typing pauses after which a text counts as settled, and the length from which it counts at all.
SETTLE_MS, SETTLE_LENGTH = 1200, 10


def json_stream(spark: SparkSession, path: str, schema: StructType | str, files_per_trigger: int = 100) -> DataFrame:
    """Events from JSON files as they arrive; the schema is given, never inferred."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).json(path)


def usage_counts(requests: DataFrame, time_col: str = "ts", late: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """Admitted events by window and dimension; rows later than ``late`` are dropped with their state."""
    ok = admit(requests.withWatermark(time_col, late)).filter("status = 204")
    dims = [F.coalesce(c, F.lit("none")).alias(c) for c in ("feature", "variant", "size_bucket", "outcome", "button")]
    return ok.groupBy(F.window(time_col, window), "event", *dims).agg(F.count("*").alias("n"))


def once_per_session(events: DataFrame, time_col: str = "ts", late: str = "10 minutes") -> DataFrame:
    """Each event of a session once within the watermark."""
    return events.withWatermark(time_col, late).dropDuplicatesWithinWatermark(["session", "event"])


def settled_edits(edits: DataFrame, time_col: str = "ts", late: str = "10 minutes") -> DataFrame:
    """The last text of each burst of edits of a document: a burst ends with a pause of SETTLE_MS; short texts don't count."""
    e = edits.filter(F.length("text") > SETTLE_LENGTH).withWatermark(time_col, late)
    return e.groupBy(F.session_window(time_col, f"{SETTLE_MS} milliseconds"), "doc_id").agg(F.max_by("text", time_col).alias("text"))


def document_statistics(docs: DataFrame) -> DataFrame:
    """What is derived from each revision of a document, without state."""
    t = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", utf16_length(t).alias("n_chars"), word_count(t).alias("n_words"), size_bucket(utf16_length(t)).alias("size_bucket"), fingerprint(t).alias("doc_fingerprint"))


def document_findings(docs: DataFrame) -> DataFrame:
    return scan(docs, "doc_id", "text")


def current_results(results: DataFrame, current: DataFrame) -> DataFrame:
    """Results (doc_id, doc_fingerprint, ...) that belong to the present text of their document; older ones are dropped."""
    return results.join(current.select("doc_id", "doc_fingerprint"), ["doc_id", "doc_fingerprint"], "left_semi")


APPROVAL = "doc_id long, approved boolean, snapshot string"


def approvals(changes: DataFrame) -> DataFrame:
    """The approval of each document after each batch of changes (doc_id, seq, kind 'edit' or 'approve', snapshot).

    An approval holds for the snapshot it was given for; any other snapshot takes it back.
    """
    import pandas as pd

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        snapshot, approved = state.get if state.exists else ("", "")
        for row in pd.concat(list(batches)).sort_values("seq").itertuples():
            if row.kind == "approve":
                approved = row.snapshot
            else:
                snapshot = row.snapshot
        state.update((snapshot, approved))
        yield pd.DataFrame({"doc_id": [key[0]], "approved": [bool(snapshot) and snapshot == approved], "snapshot": [snapshot]})

    return changes.groupBy("doc_id").applyInPandasWithState(step, APPROVAL, "snapshot string, approved string", "update", GroupStateTimeout.NoTimeout)


class Progress(StreamingQueryListener):
    """Keeps, for each query, the rows read so far and whether it has ended; ``told`` is called after each batch."""

    def __init__(self, told=None):
        self.rows: dict[str, int] = {}
        self.ended: set[str] = set()
        self.told = told

    def onQueryStarted(self, event):
        self.rows.setdefault(str(event.id), 0)

    def onQueryProgress(self, event):
        key = str(event.progress.id)
        self.rows[key] = self.rows.get(key, 0) + event.progress.numInputRows
        if self.told:
            self.told(key, self.rows[key])

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        self.ended.add(str(event.id))
