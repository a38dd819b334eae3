"""Which windows of n symbols also start in a document with a smaller id.

Documents are dealt into groups of a few MB by a hash of their id.  Four passes
read the same dealt texts (Spark reuses the exchange), with small messages
between them, so texts move once, compressed, and no key meets more than one row per group.
Groups grow with the table, as each sends a message to each bucket, and are read
in pieces:

1. content-defined segments: a segment seen in an earlier document makes all
   windows that start in it repeats; its first document owns it;
2. owned segments: the least k-symbol hash of each window.  Equal windows have
   equal least hashes, so a window whose least hash occurs once is unique;
3. the windows left over meet with their contents (suffix subtrees or suffix
   arrays, see the callers), which settles them exactly;
4. every document is marked from the answers of 1 and 3.

Segments are compared by 128-bit hashes, anchors by their bucket and 32 bits.  Rows
without an id are compared with nothing.  Memory: the work on one piece and the
messages of its group, or one bucket of messages.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditloom.llm.hashing import BYTE_VALUES, MULTIPLIERS, U64, Rolling, sliding_min, word_hashes, word_spans

#: Text bytes of a group of documents and of what one bucket of messages stands for.
GROUP_BYTES, BUCKET_BYTES = 2 << 20, 8 << 20
#: From so many groups on they grow with the table, up to so many bytes.
GROUPS, LARGEST_GROUP = 512, 16 << 20
#: Text bytes of a group that are worked on at a time; what is made of them mostly stays in a core's cache.
PIECE_BYTES = 1 << 19
#: Windows whose contents are sorted together.
WINDOWS_AT_ONCE = 1 << 20
#: An anchor found more often than this is hot: its windows travel one by one, by their own hashes, which takes some
#: twenty times the bytes.  Stretches of colder ones fit their bucket: about 100 bytes for each place.
HOT_ANCHOR = 1 << 14
#: Numbers of the kinds of messages besides rounds 1 to 3.
HOT, STRETCH = 4, 5
MESSAGE = "g bigint, round int, hi binary, lo binary, first binary, last binary, content binary, b bigint"
MESSAGE_ARROW = pa.schema(
    [("g", pa.int64()), ("round", pa.int32())]
    + [(c, pa.binary()) for c in ("hi", "lo", "first", "last", "content")]
    + [("b", pa.int64())]
)
#: Bytes of a value in the columns of messages that are compressed; hashes do not get smaller.
SQUEEZED = {"first": 8, "last": 8, "content": 1}
#: Bytes that are hashed at a time where contents are settled.
HASHED_AT_ONCE = 1 << 20


@dataclass(frozen=True)
class Rule:
    """Windows of ``n`` words or bytes; ``k`` symbols make an anchor; segments are cut at every ``period``-th place or so, a power of two.

    ``stretches``: in the third round, windows under one anchor travel together.
    """

    words: bool
    n: int
    k: int
    period: int
    stretches: bool = False


class Group:
    """The symbols of a group's documents, one document after another."""

    def __init__(self, table: pa.Table, rule: Rule):
        self.rule = rule
        self.g = _g(table)
        ids = table.column("doc_id").combine_chunks()
        texts = pc.fill_null(table.column("text"), b"").combine_chunks()
        if isinstance(texts, pa.ChunkedArray):
            texts = pa.concat_arrays(texts.chunks) if texts.num_chunks else pa.array([], pa.binary())
        if isinstance(ids, pa.ChunkedArray):
            ids = pa.concat_arrays(ids.chunks) if ids.num_chunks else pa.array([], pa.int64())
        self.known = np.asarray(pc.is_valid(ids))
        self.ids = np.asarray(pc.fill_null(ids, 0), dtype=np.int64)
        offsets = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
        raw = texts.buffers()[2] if len(texts) else None
        data = np.frombuffer(raw, dtype=np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
        self.data = data[offsets[0] : offsets[-1]]
        self.offsets = offsets - offsets[0]
        if rule.words:
            self.start, self.end, self.doc = word_spans(self.data, self.offsets)
            self.lens = np.bincount(self.doc, minlength=len(self.ids)) if len(self.ids) else np.zeros(0, np.int64)
            symbols = word_hashes(self.data, self.start, self.end)
        else:
            self.lens = np.diff(self.offsets)
            self.doc = np.repeat(np.arange(len(self.ids), dtype=np.int32), self.lens)
            symbols = BYTE_VALUES[self.data]
        self.ends = np.cumsum(self.lens)
        #: Windows of each document, and the places where they start.
        self.windows = np.maximum(0, self.lens - rule.n + 1) * self.known
        fits = np.repeat(np.tile([True, False], len(self.lens)), np.stack([self.windows, self.lens - self.windows], axis=1).ravel())
        self.places = np.flatnonzero(fits)
        self.one = Rolling(symbols)
        self.two = Rolling(symbols, MULTIPLIERS[1])

    def segments(self):
        """Hashes, documents and numbers of places of the segments."""
        s, n = self.places, self.rule.n
        if not len(s):
            none = np.zeros(0, U64)
            return none, none, np.zeros(0, np.int64), np.zeros(0, np.int64)
        width = max(1, min(n, self.rule.k // 2))
        cut = (self.one.windows(width) & U64(self.rule.period - 1) == 0)[s]
        begin = np.cumsum(self.windows) - self.windows
        cut[begin[self.windows > 0]] = True
        first = np.flatnonzero(cut)
        count = np.diff(np.append(first, len(s)))
        a = s[first]
        e = a + count - 1 + n
        return self.one.spans(a, e), self.two.spans(a, e), self.doc[a], count

    def marked(self, known: tuple) -> np.ndarray:
        """For each place, whether its segment starts in an earlier document too; else its document owns the segment."""
        hi, lo, doc, count = self.segments()
        return np.repeat(_lookup(known, hi, lo) < self.ids[doc], count)

    def anchors(self, places: np.ndarray) -> np.ndarray:
        """Least k-symbol hash in the window at each place."""
        if not len(places):
            return np.zeros(0, U64)
        return sliding_min(self.one.windows(self.rule.k), self.rule.n - self.rule.k + 1)[places]


def _cuts(sizes: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Ranges of entries in a row that begin within the same ``most``."""
    part = (np.cumsum(sizes) - sizes) // most
    starts = np.flatnonzero(np.append(True, part[1:] != part[:-1])).tolist()
    return list(zip(starts, [*starts[1:], len(sizes)]))


def squeeze(cell: bytes, width: int = 1) -> bytes:
    """Compressed, behind its length; of values of ``width`` bytes all first bytes come first, then all second ones."""
    if not cell:
        return b""
    if width > 1:
        cell = np.frombuffer(cell, np.uint8).reshape(-1, width).T.tobytes()
    return len(cell).to_bytes(8, "little") + pa.compress(cell, codec="zstd", asbytes=True)


def unsqueeze(cell: bytes, width: int = 1) -> bytes:
    if not cell:
        return b""
    out = pa.decompress(cell[8:], _length(cell), codec="zstd", asbytes=True)
    return np.frombuffer(out, np.uint8).reshape(width, -1).T.tobytes() if width > 1 else out


def _length(cell: bytes | None) -> int:
    return int.from_bytes((cell or b"")[:8], "little")


def squeezed_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [squeeze(x.as_py() or b"") for x in batch.column("text")]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.binary()), batch.column("g")], names=["doc_id", "text", "g"])


def opened(table: pa.Table) -> pa.Table:
    """Messages with plain values in all columns."""
    for c, width in SQUEEZED.items():
        cells = pa.array([unsqueeze(x, width) for x in table.column(c).to_pylist()], pa.binary())
        table = table.set_column(table.schema.get_field_index(c), c, cells)
    return table


def pieces(table: pa.Table, rule: Rule) -> Iterator[Group]:
    """The documents of a group, some ``PIECE_BYTES`` at a time."""
    texts, g = table.column("text").to_pylist(), _g(table)
    for a, e in _cuts(np.array([_length(x) for x in texts], np.int64), PIECE_BYTES):
        text = pa.array([unsqueeze(x or b"") for x in texts[a:e]], pa.binary())
        yield Group(pa.table({"doc_id": table.column("doc_id").slice(a, e - a), "text": text, "g": pa.array([g] * (e - a), pa.int64())}), rule)


_NONE = np.iinfo(np.int64).max


def _members(known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes to look for: a table of their low bits, and all of them in order."""
    bits = max(16, min(22, int(len(known)).bit_length() + 4))
    table = np.zeros(1 << bits, bool)
    table[known & U64((1 << bits) - 1)] = True
    return table, np.sort(known)


def _is_in(x: np.ndarray, members: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Which of many hashes are among the known ones."""
    table, known = members
    out = np.zeros(len(x), bool)
    if len(known) and len(x):
        maybe = np.flatnonzero(table[x & U64(len(table) - 1)])
        at = np.minimum(np.searchsorted(known, x[maybe]), len(known) - 1)
        out[maybe] = known[at] == x[maybe]
    return out


LOW = U64((1 << 32) - 1)


def _anchor_buckets(keys: np.ndarray, buckets: int) -> np.ndarray:
    return ((keys >> U64(40)) % U64(buckets)).astype(np.int64)


def _anchor_names(keys: np.ndarray, buckets: int) -> np.ndarray:
    """What is told of anchors: bucket and low bits.  Where two share them, more windows are compared by content."""
    return _anchor_buckets(keys, buckets).astype(U64) << U64(32) | keys & LOW


def _anchors_told(answers: pa.Table, rnd: int) -> np.ndarray:
    rows = answers.filter(pc.equal(answers.column("round"), rnd))
    cells = [np.frombuffer(x, "<u4").astype(U64) | U64(b) << U64(32) for x, b in zip(rows.column("hi").to_pylist(), rows.column("b").to_pylist())]
    return np.concatenate(cells) if cells else np.zeros(0, U64)


def _joined(answers: pa.Table, rnd: int, column: str, kind) -> np.ndarray:
    rows = answers.filter(pc.equal(answers.column("round"), rnd)).column(column).to_pylist()
    return np.frombuffer(b"".join(rows), dtype=kind)


def _find(their: np.ndarray, other: np.ndarray, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
    """Position of each key (hi, lo) among the known ones, which are in order; -1 where it is not."""
    out = np.full(len(hi), -1)
    if not len(their) or not len(hi):
        return out
    at = np.searchsorted(their, hi)
    while True:  # keys that share their first half follow each other
        live = np.flatnonzero((at < len(their)) & (out < 0))
        live = live[their[at[live]] == hi[live]]
        if not len(live):
            return out
        good = other[at[live]] == lo[live]
        out[live[good]] = at[live[good]]
        at[live] += 1


def _known(answers: pa.Table, rnd: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The keys that a round tells of, in order, and the smallest document of each."""
    their, other, docs = (_joined(answers, rnd, c, t) for c, t in (("hi", U64), ("lo", U64), ("first", np.int64)))
    order = np.lexsort((other, their))
    return their[order], other[order], docs[order]


def _lookup(known: tuple, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
    """Smallest known document of each key; the largest integer where nothing is known."""
    their, other, docs = known
    at = _find(their, other, hi, lo)
    return np.where(at < 0, _NONE, docs[at]) if len(docs) else np.full(len(hi), _NONE)


def _distinct(hi, lo, ids):
    """Order and run starts of equal keys, ids ascending in a run."""
    order = np.lexsort((ids, lo, hi))
    h, x = hi[order], lo[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (x[1:] != x[:-1])
    return order, np.flatnonzero(new)


def messages(g: int, rnd: int, bucket: np.ndarray, **columns) -> pa.Table:
    """One row per bucket with the packed values that go there; ``last`` is told as a distance from ``first``."""
    order = np.argsort(bucket, kind="stable")
    sorted_bucket = bucket[order]
    starts = np.flatnonzero(np.concatenate(([True], sorted_bucket[1:] != sorted_bucket[:-1]))) if len(order) else []
    ends = [*starts[1:], len(order)]
    out = {"g": pa.array([g] * len(starts), pa.int64()), "round": pa.array([rnd] * len(starts), pa.int32())}
    for c in ("hi", "lo", "first", "last", "content"):
        values = columns.get(c)
        if c == "last" and values is not None:
            values = values - columns["first"]
        if values is None:
            cells = [b""] * len(starts)
        elif isinstance(values, list):
            cells = [pack([values[i] for i in order[a:e]]) for a, e in zip(starts, ends)]
        else:
            values = values[order]
            cells = [values[a:e].tobytes() for a, e in zip(starts, ends)]
        out[c] = pa.array([squeeze(x, SQUEEZED[c]) for x in cells] if c in SQUEEZED else cells, pa.binary())
    out["b"] = pa.array([int(sorted_bucket[a]) for a in starts], pa.int64())
    return pa.table(out, schema=MESSAGE_ARROW)


def pack(items: list[bytes]) -> bytes:
    return np.array([len(x) for x in items], dtype=np.uint32).tobytes() + b"".join(items)


def unpack(cell: bytes, count: int) -> list[bytes]:
    ends = np.cumsum(np.frombuffer(cell, dtype=np.uint32, count=count), dtype=np.int64) + 4 * count
    return [cell[a:e] for a, e in zip([4 * count, *ends[:-1]], ends)]


def _buckets(hi: np.ndarray, buckets: int) -> np.ndarray:
    return ((hi >> U64(11)) % U64(buckets)).astype(np.int64)


def segment_messages(table: pa.Table, rule: Rule, buckets: int) -> pa.Table:
    parts = []
    for group in pieces(table, rule):
        hi, lo, doc, _ = group.segments()
        parts.append((hi, lo, group.ids[doc]))
    hi, lo, ids = (np.concatenate(x) for x in zip(*parts))
    order, new = _distinct(hi, lo, ids)
    last = np.concatenate((new[1:], [len(order)])).astype(np.int64) - 1 if len(new) else new
    first_at, last_at = order[new], order[last]
    keys = hi[first_at]
    return messages(_g(table), 1, _buckets(keys, buckets), hi=keys, lo=lo[first_at], first=ids[first_at], last=ids[last_at])


def _g(table: pa.Table) -> int:
    return table.column("g")[0].as_py() if table.num_rows else -1


def anchor_messages(table: pa.Table, answers: pa.Table, rule: Rule, buckets: int) -> pa.Table:
    """Distinct anchors of owned windows; with how often they are found where two documents of the group have them, else 1."""
    known, parts = _known(answers, 1), []
    for group in pieces(table, rule):
        own = group.places[~group.marked(known)]
        least, doc = group.anchors(own), group.doc[own]
        if len(own):  # neighbours mostly share their anchor
            turn = np.append(True, (least[1:] != least[:-1]) | (doc[1:] != doc[:-1]))
            least, doc = least[turn], doc[turn]
        parts.append((least, group.ids[doc]))
    least, ids = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(least)
    key, doc = least[order], ids[order]
    new = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    times = np.ones(len(new), np.int64)
    if len(new):
        several = np.minimum.reduceat(doc, new) < np.maximum.reduceat(doc, new)
        times[several] = np.diff(np.append(new, len(key)))[several]
    keys = key[new]
    return messages(_g(table), 2, _anchor_buckets(keys, buckets), hi=(keys & LOW).astype("<u4"), first=times)


def shared_answers(table: pa.Table) -> pa.Table:
    """Anchors found twice or more, to each group that sent them; apart those found over ``HOT_ANCHOR`` times."""
    cells = [np.frombuffer(x, "<u4") for x in table.column("hi").to_pylist()]
    if not cells:
        return MESSAGE_ARROW.empty_table()
    keys, found = np.concatenate(cells), np.frombuffer(b"".join(table.column("first").to_pylist()), np.int64)
    order = np.argsort(keys)
    first = np.flatnonzero(np.append(True, keys[order[1:]] != keys[order[:-1]]))
    times = np.empty(len(keys), np.int64)
    times[order] = np.repeat(np.add.reduceat(found[order], first), np.diff(np.append(first, len(keys))))
    ends = np.cumsum([len(x) for x in cells])
    out = []
    for rnd, some in ((2, (times > 1) & (times <= HOT_ANCHOR)), (HOT, times > HOT_ANCHOR)):
        found = [np.unique(x[some[e - len(x) : e]]) for x, e in zip(cells, ends)]
        out.append(_answers(table, rnd, [i for i, x in enumerate(found) if len(x)], hi=found))
    return pa.concat_tables(out)


def _answers(table: pa.Table, rnd: int, rows: list[int], **cells) -> pa.Table:
    g, b = table.column("g").to_pylist(), table.column("b").to_pylist()
    out = {"g": pa.array([g[i] for i in rows], pa.int64()), "round": pa.array([rnd] * len(rows), pa.int32())}
    for c in ("hi", "lo", "first", "last", "content"):
        plain = [cells[c][i].tobytes() if c in cells else b"" for i in rows]
        out[c] = pa.array([squeeze(x, SQUEEZED[c]) for x in plain] if c in SQUEEZED else plain, pa.binary())
    out["b"] = pa.array([b[i] for i in rows], pa.int64())
    return pa.table(out, schema=MESSAGE_ARROW)


def earliest_answers(table: pa.Table, rnd: int, group_of: Callable) -> pa.Table:
    """To each group, its keys that start in an earlier document, with the smallest id.

    ``group_of(table, hi, lo, row)`` gives an order of all entries and the starts of
    the runs of equal contents in it.
    """
    cells = {c: [np.frombuffer(x, dtype=t) for x in table.column(c).to_pylist()] for c, t in (("hi", U64), ("lo", U64), ("first", np.int64), ("last", np.int64))}
    row = np.repeat(np.arange(table.num_rows), [len(x) for x in cells["hi"]])
    hi, lo, first, last = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in cells.values())
    last = first + last
    order, new = group_of(table, hi, lo, row)
    if not len(order):
        return MESSAGE_ARROW.empty_table()
    smallest = np.minimum.reduceat(first[order], new)
    run = np.zeros(len(order), np.int64)
    run[new[1:]] = 1
    least = np.empty(len(order), np.int64)
    least[order] = smallest[np.cumsum(run)]
    told = least < last
    rows = np.unique(row[told]).tolist()
    hi, lo, least = (_per_row(x, told, row, rows) for x in (hi, lo, least))
    return _answers(table, rnd, rows, hi=hi, lo=lo, first=least)


def by_hash(table: pa.Table, hi, lo, row):
    return _distinct(hi, lo, np.zeros(len(hi), np.int64))


def window_messages(table: pa.Table, answers: pa.Table, rule: Rule, buckets: int, contents: Callable) -> pa.Table:
    """Distinct windows with a shared anchor, with their contents; under stretches those of hot anchors only."""
    known, (shared, hot) = _known(answers, 1), (_members(_anchors_told(answers, r)) for r in (2, HOT))
    stretched, single = [], []
    for group in pieces(table, rule):
        own = group.places[~group.marked(known)]
        stretches = _stretches(group, own)
        name, count = _anchor_names(stretches[0], buckets), stretches[2]
        cold = _is_in(name, shared)
        alone = _is_in(name, hot) if rule.stretches else cold | _is_in(name, hot)
        if rule.stretches:
            stretched.append(stretch_entries(group, stretches, cold, buckets))
        single.append(_single_entries(group, own[np.repeat(alone, count)], buckets, contents))
    return pa.concat_tables([_entry_messages(_g(table), STRETCH, stretched, False), _entry_messages(_g(table), 3, single, True)])


def _entry_messages(g: int, rnd: int, parts: list, keyed: bool) -> pa.Table:
    """Entries of all pieces, each content once; without hashes where its bucket takes them from the content."""
    parts = [x for x in parts if x is not None]
    if not parts:
        return MESSAGE_ARROW.empty_table()
    *arrays, content = zip(*parts)
    hi, lo, first, last, bucket = (np.concatenate(x) for x in arrays)
    order, new = _distinct(hi, lo, first)
    at, last = order[new], np.maximum.reduceat(last[order], new)
    if isinstance(content[0], np.ndarray):
        content = np.concatenate(content)[at]
    else:
        every = [x for part in content for x in part]
        content = [every[i] for i in at.tolist()]
    hashes = {"hi": hi[at], "lo": lo[at]} if keyed else {}
    return messages(g, rnd, bucket[at], first=first[at], last=last, content=content, **hashes)


def _single_entries(group: Group, own: np.ndarray, buckets: int, contents: Callable) -> tuple | None:
    rule = group.rule
    if not len(own):
        return None
    hi, lo = group.one.windows(rule.n)[own], group.two.windows(rule.n)[own]
    ids = group.ids[group.doc[own]]
    order, new = _distinct(hi, lo, ids)
    last = np.concatenate((new[1:], [len(order)])) - 1
    at, end = order[new], order[last]
    content, bucket = contents(group, own[at], buckets)
    return hi[at], lo[at], ids[at], ids[end], bucket, content


def _stretches(group: Group, own: np.ndarray):
    """Places in a row (so of one document) under one anchor: anchor, first (in ``own``), count, start and end of the bytes."""
    least = group.anchors(own)
    new = np.ones(len(own), bool)
    new[1:] = (own[1:] != own[:-1] + 1) | (least[1:] != least[:-1])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(own)))
    a, e = own[first], own[first] + count - 1 + group.rule.n
    return least[first], first, count, a, e


def stretch_entries(group: Group, stretches: tuple, wanted: np.ndarray, buckets: int) -> tuple | None:
    """Distinct wanted stretches: equal windows have equal anchors, so they meet in the anchor's bucket."""
    least, _, _, a, e = stretches
    some = np.flatnonzero(wanted)
    if not len(some):
        return None
    least, a, e = least[some], a[some], e[some]
    hi, lo = group.one.spans(a, e), group.two.spans(a, e)
    ids = group.ids[group.doc[a]]
    order, new = _distinct(hi, lo, ids)
    at, end = order[new], order[np.append(new[1:], len(order)) - 1]
    raw = group.data.tobytes()
    content = [raw[x:y] for x, y in zip(a[at].tolist(), e[at].tolist())]
    return hi[at], lo[at], ids[at], ids[end], _buckets(least[at], buckets), content


def stretch_answers(table: pa.Table, n: int, equal_runs: Callable) -> pa.Table:
    """For each stretch with a window that starts in an earlier document, the smallest document of each of its windows."""
    if not table.num_rows:
        return MESSAGE_ARROW.empty_table()
    first, last = (np.frombuffer(b"".join(table.column(c).to_pylist()), np.int64) for c in ("first", "last"))
    last = first + last
    counts = [len(x) // 8 for x in table.column("first").to_pylist()]
    cells = table.column("content").to_pylist()
    lens = np.concatenate([np.frombuffer(x, np.uint32, c) for x, c in zip(cells, counts)]).astype(np.int64)
    data = np.frombuffer(b"".join(x[4 * c :] for x, c in zip(cells, counts)), np.uint8)
    row = np.repeat(np.arange(len(counts)), counts)
    windows = lens - n + 1
    starts = np.cumsum(windows) - windows
    of = np.repeat(np.arange(len(lens)), windows)
    end = np.cumsum(lens)
    begin = end - lens
    place = np.repeat(begin, windows) + np.arange(len(of)) - starts[of]
    hi, lo, key = np.empty(len(lens), U64), np.empty(len(lens), U64), np.empty(len(of), U64)
    for i, j in _cuts(lens, HASHED_AT_ONCE):  # as the groups have hashed them: the place of bytes makes no difference
        a, some = begin[i], slice(starts[i], starts[j - 1] + windows[j - 1])
        symbols = BYTE_VALUES[data[a : end[j - 1]]]
        one = Rolling(symbols)
        hi[i:j] = one.spans(begin[i:j] - a, end[i:j] - a)
        lo[i:j] = Rolling(symbols, MULTIPLIERS[1]).spans(begin[i:j] - a, end[i:j] - a)
        key[some] = one.windows(n)[place[some] - a]
    least = np.empty(len(of), np.int64)
    parts = len(of) // WINDOWS_AT_ONCE + 1
    for part in range(parts):
        some = np.flatnonzero(key % U64(parts) == part) if parts > 1 else np.arange(len(of))
        order, new = equal_runs(data, place[some])
        if len(order):
            smallest = np.minimum.reduceat(first[of[some[order]]], new)
            least[some[order]] = np.repeat(smallest, np.diff(np.append(new, len(order))))
    told = np.logical_or.reduceat(least < last[of], starts)
    inside = told[of]
    rows = np.unique(row[told]).tolist()
    entry = [_per_row(x, told, row, rows) for x in (hi, lo, windows)]
    return _answers(table, STRETCH, rows, hi=entry[0], lo=entry[1], last=entry[2], first=_per_row(least, inside, row[of], rows))


def _per_row(values: np.ndarray, wanted: np.ndarray, row: np.ndarray, rows: list[int]) -> dict[int, np.ndarray]:
    """Wanted values of each row; entries of a row stand together."""
    values, row = values[wanted], row[wanted]
    return {i: values[np.searchsorted(row, i) : np.searchsorted(row, i, side="right")] for i in rows}


def _known_stretches(answers: pa.Table) -> tuple:
    """Keys of the stretches that are told of, in order, where the documents of each one's windows begin, these, and the keys' first halves to look for."""
    their, other, size, docs = (_joined(answers, STRETCH, c, t) for c, t in (("hi", U64), ("lo", U64), ("last", np.int64), ("first", np.int64)))
    order = np.lexsort((other, their))
    return their[order], other[order], (np.cumsum(size) - size)[order], docs, _members(their)


def _stretch_marks(group: Group, own: np.ndarray, told: tuple, repeat: np.ndarray) -> None:
    """Set ``repeat`` at the owned places (``own``: numbers of places) that stretches tell of."""
    their, other, begin, docs, members = told
    if not len(their) or not len(own):
        return
    _, first, count, a, e = _stretches(group, group.places[own])
    hi = group.one.spans(a, e)
    near = np.flatnonzero(_is_in(hi, members))
    at = _find(their, other, hi[near], group.two.spans(a[near], e[near]))
    near, at = near[at >= 0], at[at >= 0]
    inside = np.arange(count[near].sum()) - np.repeat(np.cumsum(count[near]) - count[near], count[near])
    least = docs[np.repeat(begin[at], count[near]) + inside]
    place = own[np.repeat(first[near], count[near]) + inside]
    repeat[place] |= least < group.ids[group.doc[group.places[place]]]


def finished(table: pa.Table, answers: pa.Table, rule: Rule, finish: Callable) -> pa.Table:
    known, told, single = _known(answers, 1), _known_stretches(answers), _known(answers, 3)
    members = _members(single[0])
    return pa.concat_tables([finish(*removed_runs(group, known, told, single, members)) for group in pieces(table, rule)])


def removed_runs(group: Group, known: tuple, told: tuple, single: tuple, members: tuple) -> tuple[Group, np.ndarray, np.ndarray]:
    """The group, and starts and ends of the maximal runs of removed symbols."""
    rule = group.rule
    repeat = group.marked(known)
    own = np.flatnonzero(~repeat)
    at = group.places[own]
    _stretch_marks(group, own, told, repeat)
    if len(at) and len(single[0]):
        hi = group.one.windows(rule.n)[at]
        near = _is_in(hi, members)
        hit, at = own[near], at[near]
        lo = group.two.windows(rule.n)[at]
        repeat[hit] |= _lookup(single, hi[near], lo) < group.ids[group.doc[at]]
    place = group.places[repeat]
    begun = np.zeros(len(group.doc), np.int32)
    begun[place] = 1
    begun = np.cumsum(begun, dtype=np.int32)
    gone = begun > 0
    gone[rule.n :] = begun[rule.n :] > begun[: -rule.n]
    before = np.concatenate(([False], gone[:-1]))
    after = np.concatenate((gone[1:], [False]))
    if len(gone):
        new_doc = np.concatenate(([True], group.doc[1:] != group.doc[:-1]))
        before &= ~new_doc
        after &= ~np.concatenate((new_doc[1:], [True]))
    return group, np.flatnonzero(gone & ~before), np.flatnonzero(gone & ~after) + 1


def groups_of(total: int) -> int:
    """Number of groups for so many bytes of text."""
    return total // max(GROUP_BYTES, min(total // GROUPS, LARGEST_GROUP)) + 1


def repeats(docs: DataFrame, rule: Rule, contents: Callable, settle: Callable[[pa.Table], pa.Table], finish: Callable, schema: str) -> DataFrame:
    """Run the four passes; ``contents`` and ``settle`` are the exact third round, ``finish`` makes the output rows."""
    base = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    total = base.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups, buckets = groups_of(int(total)), int(total // BUCKET_BYTES) + 1
    named = base.withColumn("g", F.pmod(F.xxhash64(F.coalesce("doc_id", F.xxhash64("text"))), F.lit(groups)))
    dealt = named.mapInArrow(squeezed_texts, "doc_id bigint, text binary, g bigint").repartition("g")

    def per_bucket(frame: DataFrame, fn) -> DataFrame:
        return frame.groupBy("b").applyInArrow(lambda t: fn(opened(t)), MESSAGE)

    def per_group(answers: DataFrame, fn, out: str) -> DataFrame:
        return dealt.groupBy("g").cogroup(answers.groupBy("g")).applyInArrow(lambda t, a: fn(t, opened(a)), out)

    first = per_bucket(
        dealt.groupBy("g").applyInArrow(lambda t: segment_messages(t, rule, buckets), MESSAGE),
        lambda t: earliest_answers(t, 1, by_hash),
    )
    second = per_bucket(per_group(first, lambda t, a: anchor_messages(t, a, rule, buckets), MESSAGE), shared_answers)
    third = per_bucket(
        per_group(first.unionByName(second), lambda t, a: window_messages(t, a, rule, buckets, contents), MESSAGE),
        settle,
    )
    return per_group(first.unionByName(third), lambda t, a: finished(t, a, rule, finish), schema)
