"""Repeated byte strings by prefix-free parsing."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from creditloom.llm.repeats import STRETCH, Group, Rule, earliest_answers, repeats, stretch_answers


def _windows_at(data: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """The n bytes from each place on, without an index for each byte."""
    return np.lib.stride_tricks.sliding_window_view(data, n)[at] if len(at) else np.zeros((0, n), np.uint8)


def _rows_of(group: Group, at: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The n bytes of each dictionary suffix, and a bucket from its first bytes."""
    n = group.rule.n
    cells = _windows_at(group.data, at, n)
    keys = group.one.windows(n)[at]
    return np.ascontiguousarray(cells), ((keys >> np.uint64(11)) % np.uint64(buckets)).astype(np.int64)


def _settle(n: int):
    width = (n + 7) // 8

    def suffix_array(data: np.ndarray, place: np.ndarray):
        """Suffixes of the dictionary's phrases in corpus order, to n bytes; starts of the runs that agree on them."""
        padded = np.zeros((len(place), width * 8), np.uint8)
        padded[:, :n] = _windows_at(data, place, n)
        keys = padded.view(">u8")
        order = np.lexsort(tuple(keys[:, j] for j in range(width - 1, -1, -1)))
        keys, new = keys[order], np.ones(len(order), bool)
        new[1:] = (keys[1:] != keys[:-1]).any(axis=1)
        return order, np.flatnonzero(new)

    def single(table: pa.Table, hi, lo, row):
        data = np.frombuffer(b"".join(table.column("content").to_pylist()), dtype=np.uint8)
        return suffix_array(data, np.arange(len(hi)) * n)

    def settle(table: pa.Table) -> pa.Table:
        """The parse comes in through the first and last document of each phrase."""
        stretch = pc.equal(table.column("round"), STRETCH)
        return pa.concat_tables(
            [stretch_answers(table.filter(stretch), n, suffix_array), earliest_answers(table.filter(pc.invert(stretch)), 3, single)]
        )

    return settle


_OUT = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, spans array<struct<first:bigint,last:bigint>>, kept binary"
_ARROW = pa.schema(
    [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64())]
    + [("spans", pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))), ("kept", pa.binary())]
)


def _finish(group: Group, start: np.ndarray, end: np.ndarray) -> pa.Table:
    runs: dict[int, list[tuple[int, int]]] = {}
    for d, a, e in zip((group.doc[start] if len(start) else start).tolist(), start.tolist(), end.tolist()):
        runs.setdefault(d, []).append((a, e))
    raw, rows = group.data.tobytes(), {c: [] for c in _ARROW.names}
    for d, (a, e) in enumerate(zip(group.offsets[:-1].tolist(), group.offsets[1:].tolist())):
        mine, kept, at = runs.get(d, []), [], a
        for x, y in mine:
            kept.append(raw[at:x])
            at = y
        kept.append(raw[at:e])
        left = b"".join(kept)
        rows["doc_id"].append(int(group.ids[d]) if group.known[d] else None)
        rows["n_bytes"].append(e - a)
        rows["n_removed"].append(e - a - len(left))
        rows["n_spans"].append(len(mine))
        rows["spans"].append([{"first": x - a, "last": y - 1 - a} for x, y in mine])
        rows["kept"].append(left)
    return pa.table(rows, schema=_ARROW)


def drop_repeated_bytes(docs: DataFrame, n: int = 50) -> DataFrame:
    """Remove each byte covered by an ``n``-byte string that also starts in a document with a smaller ``doc_id``.

    Rolling-hash triggers cut each text into phrases, lengthened by n - 1 bytes so that they overlap: every
    n-byte string lies whole in a phrase, and equal contexts give equal phrases.  The parse (which documents hold
    a phrase) settles all strings inside phrases of earlier documents.  The dictionary, where each distinct phrase
    is read once, from its first document, is searched by a suffix array: suffixes that can repeat are sorted to
    n bytes, and runs of equal neighbours take the smallest document of their phrases.  Suffixes in a row travel as one
    phrase, cut where the trigger that they share ends; where a trigger is hot, suffixes travel one by one.

    Texts are UTF-8 bytes (null: none); strings do not cross documents and are judged on the input.  Rows with a
    null ``doc_id`` are returned whole and compared with nothing; rows that share a ``doc_id`` do not remove each
    other.  Other columns are ignored.  Returns one row per input row:
    ``doc_id, n_bytes, n_removed, n_spans, spans`` (byte positions), ``kept`` (binary: cuts may split a character).
    """
    if n < 4:
        raise ValueError("n must be at least 4")
    rule = Rule(words=False, n=n, k=max(2, n * 14 // 25), period=128, stretches=True)
    return repeats(docs, rule, _rows_of, _settle(n), _finish, _OUT)
