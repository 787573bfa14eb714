"""Named questions with checked arguments, for callers that are not trusted with expressions of their own."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import fields

from pyspark.sql import functions as F

from shoebox.operators import aggregate
from shoebox.plans.filters import SearchFilters
from shoebox.plans.search import Engine, SearchRequest

MOST_ROWS = 50


class Tools:
    """Runs tools by name. Faults come back as data; every id that was returned is remembered for grounding."""

    def __init__(self, engine: Engine):
        self.engine, self.returned = engine, set()
        self.known: dict[str, tuple[set[str], Callable]] = {
            "count_by": ({"dimension", "filters", "top_n"}, self._count_by), "first_last": ({"filters"}, self._first_last), "newest": ({"filters", "limit"}, self._newest), "search": ({"words", "filters", "limit"}, self._search),
        }

    def run(self, name: str, args: dict) -> dict:
        if name not in self.known:
            return {"error": f"no such tool: {name}"}
        allowed, tool = self.known[name]
        if unknown := set(args) - allowed:
            return {"error": f"unknown arguments: {sorted(unknown)}"}
        given = args.get("filters", {})
        if unknown := set(given) - {f.name for f in fields(SearchFilters)}:
            return {"error": f"unknown filters: {sorted(unknown)}"}
        try:
            return tool(SearchRequest(words=args.get("words", ""), filters=SearchFilters(**given), k=min(int(args.get("limit", 10)), MOST_ROWS)), args)
        except (TypeError, ValueError, KeyError) as e:
            return {"error": str(e)}

    def _count_by(self, request: SearchRequest, args: dict) -> dict:
        rows = self.engine.candidates(request, frames=False)
        counted = aggregate.group_counts(rows, aggregate.dimension(args["dimension"]), min(int(args.get("top_n", 10)), MOST_ROWS), None)
        return {"groups": [(r["value"], r["n"]) for r in counted.collect()], "total": rows.count()}

    def _first_last(self, request: SearchRequest, args: dict) -> dict:
        row = aggregate.first_last(self.engine.candidates(request, frames=False).withColumn("all", F.lit(1)), "all", "taken_at", "id").first()
        return self._seen([row.first_id, row.last_id]) | {"total": row.n, "first_at": row.first_at, "last_at": row.last_at} if row else {"ids": [], "total": 0}

    def _newest(self, request: SearchRequest, args: dict) -> dict:
        page = aggregate.page(self.engine.candidates(request, frames=False).select("id", "taken_at"), [F.desc_nulls_last("taken_at"), F.col("id")], 0, request.k)
        return self._seen([r.id for r in page.collect()])

    def _search(self, request: SearchRequest, args: dict) -> dict:
        return self._seen([r.id for r in self.engine.search(request).hits.collect()])

    def _seen(self, ids: list) -> dict:
        ids = [i for i in ids if i is not None]
        self.returned.update(ids)
        return {"ids": ids}

    def grounded(self, cited: list[str]) -> list[str]:
        """Of the cited ids those that some tool has returned, each once."""
        return [i for i in dict.fromkeys(cited) if i in self.returned]
