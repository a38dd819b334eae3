"""Benchmark decontamination by template windows and slot consistency."""

from __future__ import annotations

import re
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from creditloom.llm.hashing import U64, Rolling, mix
from creditloom.session import cut

#: Template windows of a benchmark that may be sent to every task; a larger benchmark is joined by Spark.
BROADCAST_WINDOWS = 2_000_000
#: Low bits of a hash that the first look-up leaves out.
SHIFT = U64(44)
NUMBER, NAME, UNIT = "<number>", "<name>", "<unit>"
_NUMBER = re.compile(r"[+-]?\$?\d[\d.,:/]*%?$|\d+(?:st|nd|rd|th)$")
_GLUED = re.compile(r"([+-]?\$?\d[\d.,]*)([a-z%°]+)$", re.IGNORECASE)
NUMBER_WORDS = frozenset(
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen "
    "eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion".split()
)
UNITS = frozenset(
    "mm cm m km in ft yd mi mg g kg t oz lb lbs ml cl l s sec min h hr hrs ms hz khz mhz ghz w kw mw v kv j kj n pa "
    "meter meters metre metres kilometer kilometers kilometre kilometres inch inches foot feet yard yards mile miles gram "
    "grams kilogram kilograms ounce ounces pound pounds liter liters litre litres second seconds minute minutes hour hours "
    "day days week weeks month months year years dollar dollars cent cents euro euros percent degree degrees % ° $ €".split()
)
#: Units that are mostly other words; they count as units right after a number alone.
DOUBTFUL = frozenset("in s t m g l h w v j n pa pound pounds second seconds foot feet yard yards".split())
#: Words that are no names although a sentence may start with them.
COMMON = frozenset(
    "the this that these those there here they we he she it its you his her their our my your who whom whose what which when where "
    "why how if in on at of for from by with without to and or but not no yes so as an is are was were be do does did has have had "
    "can could will would should may might must let each every all any some many much more most if while after before then than "
    "because since until under over into between during about given suppose find calculate compute solve explain describe write "
    "choose select name list which answer question consider determine evaluate estimate assume note".split()
)
#: Plain words from which on a window may match with other values in its slots.
PLAIN_WORDS = 4
_TRIM = " .,;:!?\"'()[]{}|*&#$-_"
_GAP = {NUMBER, NAME, UNIT}


def _written(raw: str) -> tuple[list[tuple[str, str, str]], bool, bool]:
    """Kind, lower-case form and place in the sentence of the parts of one written word.

    Kinds: a placeholder, "unit?" (a unit after a number alone), "name?" (a name unless it starts a sentence), "start?"
    (the same, but too common for a name), or empty.  Then: a sentence ends here; the word is punctuation alone.
    """
    whole = raw.strip(_TRIM)
    digits = not whole.isalpha()  # letters alone are neither a number in digits nor glued to one
    glued = _GLUED.match(whole) if digits else None
    parts = glued.groups() if glued and glued[2].lower() in UNITS else (raw,)
    out = []
    for token in parts:
        bare = token.strip(_TRIM) if digits else whole
        low = bare.lower()
        if (digits and _NUMBER.match(token.strip(".,;:!?\"'()[]"))) or low in NUMBER_WORDS:
            kind = NUMBER
        elif low in UNITS and len(bare):
            kind = "unit?" if low in DOUBTFUL and len(parts) == 1 else UNIT
        elif len(bare) > 1 and bare[0].isupper() and bare[1:].islower():
            kind = "start?" if low in COMMON else "name?"
        else:
            kind = ""
        if low or kind == NUMBER:
            out.append((kind, low))
    return out, raw[-1] in ".!?:|", not whole


def _words(text: str) -> list[str]:
    """Written words; a line break is a bare mark that ends a sentence and has no token."""
    return text.replace("\n", " | ").split()


#: Readings of a text: capitals at sentence starts make no names; all capitals do, but for common words; words as written.
SENTENCES, CAPITALS, EXACT = range(3)


def template(text: str, reading: int = SENTENCES) -> tuple[list[str], list[str]]:
    """Canonical tokens and slot values.  ``5kg`` is a number and a unit; bare punctuation disappears."""
    return _template(_words(text), reading, True, False)


def _template(raws: list[str], reading: int, first: bool, number: bool) -> tuple[list[str], list[str]]:
    """The same for a stretch of words that starts a sentence (``first``), or follows a number, or neither."""
    tokens, values, last = [], [], NUMBER if number else ""
    for raw in raws:
        parts, ends, bare = _written(raw)
        for kind, low in parts:
            if kind == "unit?":
                token = UNIT if last == NUMBER else low
            elif kind == "name?":
                token = low if reading == SENTENCES and first else NAME
            elif kind == "start?":
                token = low if reading == CAPITALS or first else NAME
            else:
                token = kind or low
            last = kind
            slot = token in _GAP and reading != EXACT
            tokens.append(token if slot else low)
            values.append(low if slot else "")
        first = ends or (first and bare)
    return tokens, values


#: Kinds of tokens by number; 0 stands for all others.
_KINDS = {NUMBER: 1, "unit?": 2, UNIT: 3, "name?": 4, "start?": 5}
_NUMBER_HASH, _UNIT_HASH, _NAME_HASH = mix(np.array([xxhash.xxh64_intdigest(t) for t in (NUMBER, UNIT, NAME)], dtype=U64))
#: By kind: its placeholder's hash, and whether it stands with all capitals, inside a sentence, at its start.
_SLOT_HASH = np.array([0, _NUMBER_HASH, _UNIT_HASH, _UNIT_HASH, _NAME_HASH, _NAME_HASH], dtype=U64)
_IN_CAPITALS = np.array([0, 1, 0, 1, 1, 0], bool)
_INSIDE = np.array([0, 1, 0, 1, 1, 1], bool)
_AT_START = np.array([0, 1, 0, 1, 0, 0], bool)


class Reading:
    """Token hashes of one text in all readings, and the words that they come from."""

    def __init__(self, raws, hashes, first, start, word, kind):
        self.raws, self.hashes, self.first, self.start, self.word, self.kind = raws, hashes, first, start, word, kind

    def template(self, reading: int, a: int, e: int) -> tuple[list[str], list[str]]:
        """Template tokens and slot values from token ``a`` to before ``e``; only their words are read again."""
        at, end = int(self.word[a]), int(self.word[e - 1]) + 1
        lead = int(self.start[at])
        tokens, values = _template(self.raws[at:end], reading, bool(self.first[at]), lead > 0 and self.kind[lead - 1] == 1)
        return tokens[a - lead : e - lead], values[a - lead : e - lead]

    def windows(self, sizes: tuple[int, ...]):
        """Reading, window size and window hashes for each reading and size that fits the text."""
        for reading, values in enumerate(self.hashes):
            rolling = Rolling(values)
            for size in sizes:
                if len(values) >= size:
                    yield reading, size, rolling.windows(size) ^ U64(size)


class Codes:
    """Hashes of the template tokens of texts in all readings; written words come from a table of bounded size."""

    def __init__(self, most: int = 800_000):
        self.most = most
        self._clear()

    def _clear(self):
        self.known: dict[str, int] = {}
        #: By written word: its first token's row; 4 times its tokens, plus 2 if it ends a sentence, plus 1 if it is punctuation alone.
        self.rows, self.marks = np.zeros(1 << 12, np.int32), np.zeros(1 << 12, np.int8)
        #: By token: its hash as written, and its kind.
        self.hashes, self.kinds, self.tokens = np.zeros(1 << 12, U64), np.zeros(1 << 12, np.int8), 0

    def _add(self, raws: list[str]) -> None:
        """Rows of words that were not met before; the tables double when they are full."""
        known, rows, marks, hashes, kinds, at = self.known, [], [], [], [], len(self.known)
        for raw in raws:
            if raw in known:
                continue
            known[raw] = len(known)
            rows.append(self.tokens + len(hashes))
            whole = raw.strip(_TRIM)
            if whole.isalpha() and whole.islower() and whole not in UNITS and whole not in NUMBER_WORDS:
                marks.append(6 if raw[-1] in ".!?:|" else 4)
                hashes.append(xxhash.xxh64_intdigest(whole))
                kinds.append(0)
                continue
            parts, ends, bare = _written(raw)
            marks.append(4 * len(parts) + 2 * ends + bare)
            for kind, low in parts:
                hashes.append(xxhash.xxh64_intdigest(low))
                kinds.append(_KINDS.get(kind, 0))
        while at + len(rows) > len(self.rows):
            self.rows, self.marks = np.concatenate((self.rows, np.zeros_like(self.rows))), np.concatenate((self.marks, np.zeros_like(self.marks)))
        while self.tokens + len(kinds) > len(self.kinds):
            self.hashes, self.kinds = np.concatenate((self.hashes, np.zeros_like(self.hashes))), np.concatenate((self.kinds, np.zeros_like(self.kinds)))
        self.rows[at : at + len(rows)] = rows
        if rows:
            self.marks[at : at + len(rows)] = marks
        if kinds:
            to = self.tokens + len(kinds)
            self.hashes[self.tokens : to] = mix(np.array(hashes, dtype=U64))
            self.kinds[self.tokens : to] = kinds
            self.tokens = to

    def read(self, raws: list[str]) -> Reading:
        if not raws:
            return Reading([], [np.zeros(0, U64)] * 3, *[np.zeros(0, np.int64)] * 4)
        if len(self.known) > self.most:
            self._clear()
        at = np.fromiter(map(self.known.get, raws, repeat(-1)), np.int64, len(raws))
        new = np.flatnonzero(at < 0)
        if len(new):
            unmet = [raws[i] for i in new.tolist()]
            self._add(unmet)
            at[new] = [self.known[r] for r in unmet]
        marks = self.marks[at]
        count, ends, bare = marks >> 2, (marks & 2) > 0, (marks & 1) > 0
        # A word starts a sentence if the last one before it that is no mere mark ends one, or any mark since.
        settled = ends | ~bare
        last = np.maximum.accumulate(np.where(settled, np.arange(len(at)), -1))
        before = np.concatenate(([-1], last[:-1])).astype(np.int64)
        first = (before < 0) | ends[before]
        start = np.cumsum(count, dtype=np.int64) - count
        total = int(start[-1] + count[-1]) if len(at) else 0
        word = np.repeat(np.arange(len(at)), count)
        token = self.rows[at][word] + np.arange(total) - start[word]
        exact, kind = self.hashes[token], self.kinds[token]
        sentences, capitals = exact.copy(), exact.copy()
        odd = np.flatnonzero(kind)
        k = kind[odd]
        slot = odd[_IN_CAPITALS[k]]
        capitals[slot] = _SLOT_HASH[kind[slot]]
        slot = odd[np.where(first[word[odd]], _AT_START[k], _INSIDE[k])]
        sentences[slot] = _SLOT_HASH[kind[slot]]
        unit = odd[(k == 2) & (odd > 0)]
        unit = unit[kind[unit - 1] == 1]
        capitals[unit] = sentences[unit] = _UNIT_HASH
        return Reading(raws, [sentences, capitals, exact], first, start, word, kind)

    def __call__(self, text: str) -> list[np.ndarray]:
        """Hashes of the tokens in the readings ``SENTENCES, CAPITALS, EXACT``."""
        return self.read(_words(text)).hashes


def template_windows(text: str, sizes: tuple[int, ...], codes: Codes):
    """Windows of a text in all readings."""
    return codes.read(_words(text)).windows(sizes)


_WINDOW = "item_id bigint, hash bigint, size int, slots array<string>, words string, parts int"


def benchmark_windows(benchmark: DataFrame, window: int) -> DataFrame:
    """Windows of each item in all readings; an item shorter than ``window`` is one window of its own size.

    Windows with more slots than words, or with fewer than ``PLAIN_WORDS`` words outside slots, are given as written alone.
    """

    def run(batches):
        codes = Codes()
        for batch in batches:
            rows = {c: [] for c in ("item_id", "hash", "size", "slots", "words", "parts")}
            for item, text in zip(batch.column("item_id").to_pylist(), batch.column("text").to_pylist()):
                read = [template(text or "", reading) for reading in range(3)]
                n = len(read[0][0])
                seen = set()
                for reading, size, hashes in template_windows(text or "", (min(window, n),) if n else (), codes):
                    tokens, values = read[reading]
                    for i, h in enumerate(hashes.view(np.int64).tolist()):
                        slots = sum(v != "" for v in values[i : i + size])
                        if (i, h) in seen or (reading != EXACT and (slots * 2 > size or size - slots < PLAIN_WORDS)):
                            continue
                        seen.add((i, h))
                        rows["item_id"].append(item)
                        rows["hash"].append(h)
                        rows["size"].append(size)
                        rows["slots"].append(values[i : i + size])
                        rows["words"].append(" ".join(tokens[i : i + size]))
                        rows["parts"].append(len(hashes))
            yield pa.RecordBatch.from_pydict(rows, schema=pa.schema([("item_id", pa.int64()), ("hash", pa.int64()), ("size", pa.int32()), ("slots", pa.list_(pa.string())), ("words", pa.string()), ("parts", pa.int32())]))

    rows = benchmark.where(F.col("item_id").isNotNull()).select(F.col("item_id").cast("bigint").alias("item_id"), "text")
    return rows.mapInArrow(run, _WINDOW)


_HIT = "doc_id bigint, place bigint, hash bigint, slots array<string>, words string"
_HIT_ARROW = pa.schema([("doc_id", pa.int64()), ("place", pa.int64()), ("hash", pa.int64()), ("slots", pa.list_(pa.string())), ("words", pa.string())])


def document_windows(docs: DataFrame, sizes: tuple[int, ...], wanted) -> DataFrame:
    """Template windows of whole documents; with ``wanted`` (broadcast: sorted hashes, and a table of their leading bits) only those in it."""

    def run(batches):
        codes = Codes()
        for batch in batches:
            rows = {c: [] for c in _HIT_ARROW.names}
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                read, plain = codes.read(_words(text or "")), {}
                for reading, size, hashes in read.windows(sizes):
                    # A window without slots is the same in several readings and is sent once.
                    if wanted is None:
                        at = np.arange(len(hashes))
                    else:
                        keys, table = wanted.value
                        at = np.flatnonzero(table[hashes >> SHIFT])
                        near = hashes[at]
                        at = at[keys[np.minimum(np.searchsorted(keys, near), len(keys) - 1)] == near]
                    for other in plain.setdefault(size, []):
                        at = at[other[at] != hashes[at]]
                    plain[size].append(hashes)
                    if not len(at):
                        continue
                    signed = hashes[at].view(np.int64).tolist()
                    for run in np.split(np.arange(len(at)), np.flatnonzero(np.diff(at) >= size) + 1):
                        a = int(at[run[0]])
                        tokens, values = read.template(reading, a, int(at[run[-1]]) + size)
                        for j in run.tolist():
                            i = int(at[j])
                            rows["doc_id"].append(doc)
                            rows["place"].append(i)
                            rows["hash"].append(signed[j])
                            rows["slots"].append(values[i - a : i - a + size])
                            rows["words"].append(" ".join(tokens[i - a : i - a + size]))
            yield pa.RecordBatch.from_pydict(rows, schema=_HIT_ARROW)

    rows = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return rows.mapInArrow(run, _HIT)


def contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 13) -> DataFrame:
    """Documents that hold a template window of a benchmark item with consistent slots.

    Numbers (also as words), capitalised names, and units become typed placeholders; other words are compared in lower
    case, without outer punctuation.  Texts are read three ways: capitals that start a sentence or line make no name;
    capitals anywhere make one, unless the word is common; words as written, without placeholders.  Windows of
    ``window`` template tokens are hash-joined and their templates compared.  A window's slots are consistent if equal
    values of the item stand for equal values of the document and the other way round.  Windows with more slots than
    words, or fewer than ``PLAIN_WORDS`` words, match as written alone; so do items of one to three words.

    A benchmark of up to ``BROADCAST_WINDOWS`` template windows is sent to the tasks as hashes; a larger one meets
    all document windows in a shuffled join.  Whole texts are read; null texts have no windows; rows without id are
    left out; repeated rows count once.

    Returns ``doc_id, item_id, windows`` (matched positions), ``exact`` (of them with equal slots).
    """
    items = cut(benchmark_windows(benchmark, window))
    sizes = tuple(r[0] for r in items.select("size").distinct().collect())  # at most ``window`` numbers
    keys = items.select("hash").distinct()
    wanted = None
    if keys.count() <= BROADCAST_WINDOWS:
        hashes = np.array([r[0] for r in keys.collect()], dtype=np.int64).view(U64)
        table = np.zeros(1 << (64 - int(SHIFT)), bool)
        table[hashes >> SHIFT] = True
        wanted = docs.sparkSession.sparkContext.broadcast((np.sort(hashes), table)) if len(hashes) else None
        sizes = sizes if len(hashes) else ()
    hits = document_windows(docs, sizes, wanted)
    theirs = items.select("item_id", "hash", F.col("slots").alias("item_slots"), F.col("words").alias("item_words"))
    met = hits.join(theirs, "hash").where(F.col("words") == F.col("item_words"))
    pairs = F.filter(F.arrays_zip("item_slots", "slots"), lambda p: p["item_slots"] != "")
    one = lambda side: F.size(F.array_distinct(F.transform("p", lambda p: p[side]))) == F.size("p")
    met = met.select("doc_id", "item_id", "place", "hash", F.array_distinct(pairs).alias("p"), (F.col("slots") == F.col("item_slots")).alias("same"))
    met = met.where(one("item_slots") & one("slots"))
    return (
        met.groupBy("doc_id", "item_id")
        .agg(F.countDistinct("place").alias("windows"), F.countDistinct(F.when(F.col("same"), F.col("place"))).alias("exact"))
    )


def keep_clean(docs: DataFrame, benchmark: DataFrame, **settings) -> DataFrame:
    """Rows of ``docs`` that hold no benchmark item.

    Rows are told apart by id and text together, so rows without id are judged too, and of rows that share an id only
    those that hold an item go.
    """
    key = F.xxhash64(F.col("doc_id").cast("bigint"), "text")
    bad = contaminated(docs.select(key.alias("doc_id"), "text"), benchmark, **settings).select(F.col("doc_id").alias("_bad")).distinct()
    return docs.join(bad, key == F.col("_bad"), "left_anti")
