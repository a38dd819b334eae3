"""Repeated word sequences by suffix trees over dealt suffixes."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from creditloom.llm.repeats import Group, Rule, earliest_answers, repeats, unpack

#: Suffixes of one subtree that are sorted together.
SUBTREE = 200_000


def _suffixes(group: Group, at: np.ndarray, buckets: int) -> tuple[list[bytes], np.ndarray]:
    """Each suffix cut to n words, and the bucket of all its words: however many suffixes share a prefix, they spread."""
    raw, n = group.data.tobytes(), group.rule.n
    texts, bucket = [], np.zeros(len(at), np.int64)
    for j, i in enumerate(at):
        text = b" ".join([raw[a:e] for a, e in zip(group.start[i : i + n], group.end[i : i + n])])
        texts.append(text)
        bucket[j] = zlib.crc32(text) % buckets
    return texts, bucket


def _split(suffixes: list[list[bytes]], some: list[int], depth: int, n: int):
    """Parts of ``some`` that fit one subtree, made by lengthening the common prefix."""
    if len(some) <= SUBTREE or depth == n:
        yield some
        return
    parts: dict[bytes, list[int]] = {}
    for i in some:
        parts.setdefault(suffixes[i][depth], []).append(i)
    for part in parts.values():
        yield from _split(suffixes, part, depth + 1, n)


def _subtrees(n: int):
    def settle(table: pa.Table, hi, lo, row):
        """Leaves of all subtrees in order, and the starts of the runs below nodes at word depth n."""
        cells, counts = table.column("content").to_pylist(), np.bincount(row, minlength=table.num_rows)
        suffixes = [x.split(b" ") for cell, count in zip(cells, counts) for x in unpack(cell, int(count))]
        order: list[int] = []
        new: list[int] = []
        for part in _split(suffixes, list(range(len(suffixes))), 0, n):
            part = sorted(part, key=suffixes.__getitem__)
            # Neighbours in leaf order that agree on n words hang below one node of depth n.
            new += [len(order) + j for j, i in enumerate(part) if not j or suffixes[i] != suffixes[part[j - 1]]]
            order += part
        return np.array(order, np.int64), np.array(new, np.int64)

    return settle


_OUT = "doc_id bigint, n_words bigint, n_removed bigint, spans array<struct<first:bigint,last:bigint>>, kept_text string"
_ARROW = pa.schema(
    [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64())]
    + [("spans", pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))), ("kept_text", pa.string())]
)


def _finish(group: Group, start: np.ndarray, end: np.ndarray) -> pa.Table:
    doc = group.doc[start] if len(start) else start
    begin = group.ends - group.lens
    runs: dict[int, list[tuple[int, int]]] = {}
    for d, a, e in zip(doc.tolist(), (start - begin[doc]).tolist(), (end - begin[doc]).tolist()):
        runs.setdefault(d, []).append((a, e))
    raw, rows = group.data.tobytes(), {c: [] for c in _ARROW.names}
    for d, (a, e) in enumerate(zip(group.offsets[:-1].tolist(), group.offsets[1:].tolist())):
        words, mine, kept, at = raw[a:e].split(), runs.get(d, []), [], 0
        for x, y in mine:
            kept += words[at:x]
            at = y
        kept += words[at:]
        rows["doc_id"].append(int(group.ids[d]) if group.known[d] else None)
        rows["n_words"].append(len(words))
        rows["n_removed"].append(len(words) - len(kept))
        rows["spans"].append([{"first": x, "last": y - 1} for x, y in mine])
        rows["kept_text"].append(b" ".join(kept).decode("utf-8", "replace"))
    return pa.table(rows, schema=_ARROW)


def drop_repeated_words(docs: DataFrame, n: int = 13) -> DataFrame:
    """Remove each word covered by ``n`` words in a row that also start in a document with a smaller ``doc_id``.

    Words are runs of anything but ASCII white space, compared byte by byte; repeats are judged on the input.
    Suffixes are cut to n words and dealt by all of them, so that equal ones meet and a common prefix is no one
    task's; a bucket lengthens prefixes until a subtree fits ``SUBTREE`` leaves, and nodes n words deep hold the repeats.  A removed span is a
    maximal union of repeats.  Only suffixes that ``repeats`` could not settle by hashes reach the trees.

    ``docs`` needs ``doc_id`` and ``text``; other columns are ignored.  A null text has no words.  Rows with a null
    ``doc_id`` are returned whole and compared with nothing; rows that share a ``doc_id`` do not remove each other.
    Returns one row per input row: ``doc_id, n_words, n_removed, spans`` (word positions), ``kept_text``.
    """
    if n < 2:
        raise ValueError("n must be at least 2")
    rule = Rule(words=True, n=n, k=max(1, (n + 1) // 2 - 1), period=32)
    subtrees = _subtrees(n)
    return repeats(docs, rule, _suffixes, lambda t: earliest_answers(t, 3, subtrees), _finish, _OUT)
