"""The semantic answer cache as a stream with state: lookups and stores as questions arrive."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from marginalia.operators.cache import THRESHOLD, question_key

#: Needed by the state store of streams with several state variables.
PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
OUTPUT = "level string, corpus_key string, tokens string, seq long, hit long, similarity double, evicted int"


class SemanticCache(StatefulProcessor):
    """The entries of one (level, corpus, question tokens): a vector, when it was stored and when it was last used.

    A question that finds an unexpired entry of at least the threshold's cosine uses the most similar one (of equal ones the
    latest) and renews it; another one is stored, and beyond most entries the least recently used goes. A timer drops
    expired entries even where nobody asks any more. With store_hits every question is stored.
    """

    def __init__(self, threshold: float = THRESHOLD, ttl_ms: int = 86_400_000, most: int = 256, store_hits: bool = False) -> None:
        self.threshold, self.ttl, self.most, self.store_hits = threshold, ttl_ms, most, store_hits

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entries = handle.getMapState("entries", "seq long", "vector array<double>, stored long, used long")

    def _live(self, now: int) -> dict[int, tuple]:
        """Unexpired entries; the others are removed."""
        live = {}
        for (seq,), (vector, stored, used) in list(self.entries.iterator()):
            if now - stored > self.ttl:
                self.entries.removeKey((seq,))
            else:
                live[seq] = (np.asarray(vector, float), stored, used)
        return live

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        asked = pd.concat(list(rows)).sort_values("seq")
        out = []
        for seq, vector, at in zip(asked["seq"], asked["vector"], asked["at"]):
            v, at = np.asarray(vector, float), int(at)
            live, best, evicted = self._live(at), None, 0
            for other, (w, stored, used) in live.items():
                size = np.linalg.norm(v) * np.linalg.norm(w)
                score = round(float(v @ w / size), 9) if len(v) == len(w) and size > 0 else 0.0
                if score >= self.threshold and (best is None or (score, other) > best):
                    best = (score, other)
            if best:
                w, stored, _ = live[best[1]]
                self.entries.updateValue((best[1],), (w.tolist(), stored, at))
            if best is None or self.store_hits:
                self.entries.updateValue((int(seq),), (v.tolist(), at, at))
                if len(live) + 1 > self.most:
                    # least recently used, of equals the oldest; the entry that was just found has been used now
                    oldest = min(live, key=lambda s: (at if best and s == best[1] else live[s][2], s))
                    self.entries.removeKey((oldest,))
                    evicted = 1
                self.handle.registerTimer(at + self.ttl + 1)
            out.append((*key, int(seq), best[1] if best else None, best[0] if best else None, evicted))
        frame = pd.DataFrame(out, columns=["level", "corpus_key", "tokens", "seq", "hit", "similarity", "evicted"])
        yield frame.astype({"hit": "Int64", "similarity": "Float64"})

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        self._live(timerValues.getCurrentWatermarkInMs())
        yield from ()

    def close(self) -> None:
        pass


def cache_stream(questions: DataFrame, threshold: float = THRESHOLD, ttl_ms: int = 86_400_000, most: int = 256, store_hits: bool = False, late: str = "1 hour") -> DataFrame:
    """A stream of questions (seq, level, corpus_key, question, vector, at: milliseconds) -> OUTPUT, hit null for a miss.

    Rows of a batch are taken in the order of seq, and seqs are unique; rows later than late behind the newest are left out.
    Entries expire by the questions' own time, so a rerun gives the same rows. The session needs PROVIDER as its state store.
    """
    rows = questions.select("level", "corpus_key", question_key(F.col("question")).alias("tokens"), "seq", F.col("vector").cast("array<double>").alias("vector"), "at", F.timestamp_millis("at").alias("time"))
    rows = rows.where("tokens IS NOT NULL AND vector IS NOT NULL").withWatermark("time", late)
    return rows.groupBy("level", "corpus_key", "tokens").transformWithStateInPandas(SemanticCache(threshold, ttl_ms, most, store_hits), OUTPUT, "Append", "EventTime")
