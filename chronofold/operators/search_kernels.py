"""The array kernel of many searches: entries in order go past the searches for them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def first_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(query_id, id, slug, start_year, row_limit): of each share of a text and bucket, the first entries of each search, up to its limit.

    Rows of a share come together: its searches (kind 0), their categories joined by commas, then its entries (kind 1) in
    order of start year and slug.
    """
    now, asked, searches = None, [], None
    for batch in batches:
        no, bucket, share, kind = keys = [batch.column(c).to_numpy() for c in ("no", "bucket", "share", "kind")]
        ends = [*(np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1).tolist(), len(no)] if len(no) else []
        lo = 0
        for hi in ends:
            if now != (no[lo], bucket[lo], share[lo]):
                now, asked, searches = (no[lo], bucket[lo], share[lo]), [], None
            if kind[lo] == 0:
                asked.append(batch.slice(lo, hi - lo))
            elif asked:
                searches = _Searches(pa.Table.from_batches(asked)) if searches is None else searches
                yield from searches.of(batch.slice(lo, hi - lo), now[1])
            lo = hi


class _Searches:
    """The searches for a share, and how many rows each still takes."""

    def __init__(self, searches: pa.Table) -> None:
        column = lambda c: searches.column(c).to_numpy()
        self.ids, self.limits = (searches.column(c).combine_chunks() for c in ("query_id", "row_limit"))
        self.first, self.last, self.bucket, self.left = column("year_min"), column("year_max"), column("query_bucket"), column("row_limit").copy()
        self.categories = searches.column("categories").to_pylist()

    def of(self, entries: pa.RecordBatch, bucket: int) -> Iterator[pa.RecordBatch]:
        start, end, begun = (entries.column(c).to_numpy() for c in ("start_year", "end_year", "from_bucket"))
        among: dict[str, np.ndarray] = {}
        rows, which = [], []
        for i in np.flatnonzero(self.left > 0).tolist():
            names = self.categories[i]
            if names not in among:
                among[names] = pc.is_in(entries.column("category"), value_set=pa.array(names.split(","), pa.string())).to_numpy(zero_copy_only=False)
            # A pair counts in the first bucket the two share.
            at = np.flatnonzero(among[names] & (start <= self.last[i]) & (end >= self.first[i]) & (np.maximum(begun, self.bucket[i]) == bucket))[:self.left[i]]
            if len(at):
                self.left[i] -= len(at)
                rows.append(at)
                which.append(np.full(len(at), i))
        if rows:
            at, of = pa.array(np.concatenate(rows)), pa.array(np.concatenate(which))
            names = ["id", "slug", "start_year"]
            yield pa.RecordBatch.from_arrays([self.ids.take(of), *[entries.column(c).take(at) for c in names], self.limits.take(of)], ["query_id", *names, "row_limit"])
