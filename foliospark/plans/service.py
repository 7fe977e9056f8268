"""The four read-only tools over a collection, as plain functions that give plain values."""

from pyspark.sql import DataFrame, SparkSession

from ..operators import listing
from . import search


class Service:
    """Health, statistics, listing and search. chunks: a function that gives the current chunk records."""

    def __init__(self, spark: SparkSession, chunks, alpha: float = 0.6):
        self.spark, self.chunks, self.alpha = spark, chunks, alpha

    def _rows(self, make) -> dict:
        """An error of the store becomes a warning."""
        try:
            return {"rows": [r.asDict(True) for r in make().collect()], "warnings": []}
        except Exception as e:  # noqa: BLE001
            return {"rows": [], "warnings": [str(e)[:500]]}

    def health_check(self) -> dict:
        """R12."""
        try:
            return search.health(self.chunks())
        except Exception as e:  # noqa: BLE001
            return {"status": "error", "chunks": None, "warnings": [str(e)[:500]]}

    def collection_stats(self) -> dict:
        """A4."""
        return self._rows(lambda: listing.stats(self.chunks()))

    def list_indexed_documents(self, course: str | None = None, week: str | None = None) -> dict:
        """R13."""
        return self._rows(lambda: listing.documents(self.chunks(), course, week))

    def search_notes(self, query: str, course: str | None = None, week: str | None = None, top_k: int = 8, use_hybrid: bool = True, use_reranker: bool = True) -> dict:
        """R11 for one query. An empty query or collection is a warning; a reranker that fails leaves the results as they were."""
        if not query or not query.strip():
            return {"rows": [], "warnings": ["The query is empty."]}
        asked = self.spark.createDataFrame([("q", query)], "query_id string, query string")

        def rows(again: bool) -> DataFrame:
            return search.search(asked, self.chunks(), course, week, top_k, None, use_hybrid, again, self.alpha).orderBy("rank")

        out = self._rows(lambda: rows(use_reranker))
        if out["warnings"] and use_reranker:
            plain = self._rows(lambda: rows(False))
            out = {"rows": plain["rows"], "warnings": out["warnings"] + plain["warnings"]}
        if not out["rows"] and not out["warnings"]:
            out["warnings"] = ["Nothing was found."]
        return out
