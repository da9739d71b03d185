"""Benchmark decontamination by template windows with consistent slots.

A text becomes token sequences of three forms:

1. template: literal words in lower case without outer punctuation, and typed
   placeholders for numbers, units after numbers (also attached ones) and names (words
   with a capital inside a sentence; several in a row are one name).
2. the same with every capital word a name, also where a sentence starts, but for those
   of ``COMMON``, which are literal wherever they stand.
3. exact: all words in lower case, numbers with their values, signs of arithmetic, and
   single characters of scripts that are written without spaces. It has no slots, so
   no item of four such tokens is without windows, and case and place do not matter.

Windows of eight tokens are hashed. A document window that some benchmark window of
its form equals is a hit and carries the values of its slots. Hits of a document and an
item are put in line by their distance. In a line every slot value of the item goes
with the document's value that it meets most often, one to one; windows with another
pair of unequal values are dropped. So a question whose numbers and names were changed
throughout is found, and one changed occurrence costs the windows over it only. A
document is contaminated by an item if in one form the windows left are at least half
of the item's, or if those of one line cover ``RUN`` consecutive tokens (twice as many
in items mostly of single characters), however long the item is.

The benchmark's window hashes and their tokens go to the executors as sorted arrays
while the windows are at most ``BLOCK`` many, else in as many blocks as they need, one
pass each; documents are never shuffled. A document's windows are hashed only where all
their tokens occur in the benchmark. An item with fewer tokens than a window is one
window of its own length. An item of fewer than four exact tokens is found where it is a
whole text; template windows with fewer literal words than placeholders are left to the
exact form. Texts of any length are read whole, some half a million characters at a time.

Defined results: null or empty texts on either side match nothing; rows without a
doc_id are not reported; different texts of one id are judged apart and the best
matched one is reported; an empty table gives no rows. Other columns of the input are
ignored. The counts reported are those of the form with the largest share of windows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelloom.llm.common import staged
from labelloom.llm.memories import remembered
from labelloom.llm.shingles import window_hashes, windows

WIDTH = 8
LEAST_TOKENS = 4
LEAST_COVERAGE = 0.5
RUN = 15
BLOCK = 4_000_000
_MAX_CHUNKS = 600_000
_MAX_CHARS = 16_000_000
_CHARS_AT_ONCE = 1 << 19

# Units that may follow a number.
UNITS = frozenset("""
% ° $ € £ mm cm m km in ft yd mi mile miles inch inches foot feet yard yards meter meters metre metres
mg g kg t lb lbs oz gram grams kilogram kilograms ton tons pound pounds ounce ounces ml cl l liter liters
litre litres gallon gallons s sec second seconds min minute minutes h hr hour hours day days week weeks
month months year years hz khz mhz ghz w kw mw v kv a ma j kj mj cal kcal k c f percent dollar dollars
euro euros cent cents mph kmh km/h m/s kb mb gb tb
""".split())

# Words that are no names where they have a capital.
COMMON = frozenset("""
a an the this that these those i you he she it we they his her its our their my your who what which when
where why how and or but if then so as at by for from in into of on to with without after before while
during since until is are was were do does did has have had can could will would should may might must
there here not no all each every both some many one two if given find let suppose calculate compute
""".split())

_NUMBER = re.compile(r"([^\w%]*)([+-]?\d[\d.,:/]*)(.*)", re.S)
_EDGES = re.compile(r"^[^\w%°$€£]+|[^\w%°$€£]+$")
_UNSPACED = ("\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff"
             "\U00020000-\U0003ffff")
_FIRST_UNSPACED = "\u0e00"
_EXACT = re.compile(rf"([{_UNSPACED}])|\d+(?:[.,:/]\d+)*|(?:(?![{_UNSPACED}])[^\W\d_])+"
                    r"|(?<![^\W\d_])-|[+*/=<>^%\u00d7\u00f7\u221a\u2264\u2265\u2260\u00b1\u2212]")
_LITERAL, _NUM, _UNIT, _NAME = 0, 1, 2, 3
_EXACT_FORM = 2


def _hash(word: str) -> int:
    return xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))


_SLOT_HASH = np.array([0, _hash("\0number"), _hash("\0unit"), _hash("\0name")], np.uint64)


def _plain_word(chunk: str) -> str:
    """A chunk of letters alone, or with one sign after it; nothing for all others, which need a closer look."""
    if chunk.isalpha():
        return chunk
    return chunk[:-1] if chunk[-1] in ".,;:!?" and chunk[:-1].isalpha() else ""


def _pieces(chunk: str) -> tuple[list[tuple[int, int, bool, bool, bool]], bool]:
    """Tokens (hash, kind, capital, unit word, common) of a chunk, and whether it ends a sentence."""
    word = _plain_word(chunk)
    if word:
        low = word.lower()
        return ([(_hash(low), _LITERAL, word[0].isupper(), low in UNITS, low in COMMON)],
                chunk[-1] in (".", "!", "?", ":"))
    ends = chunk.rstrip("\"')]}»”’")[-1:] in (".", "!", "?", ":")
    core = _EDGES.sub("", chunk)
    if not core:
        return [], ends
    number = _NUMBER.match(core)
    if number:
        out = [(_hash(number[2].rstrip(".,:/")), _NUM, False, False, False)]
        tail = _EDGES.sub("", number[3])
        if tail:
            low = tail.lower()
            out.append((_hash(low), _UNIT if low in UNITS else _LITERAL, False, low in UNITS, low in COMMON))
        if number[1].strip() in UNITS:
            out.append((_hash(number[1].strip()), _UNIT, False, True, False))
        return out, ends
    low = core.lower()
    return [(_hash(low), _LITERAL, core[0].isupper(), low in UNITS, low in COMMON)], ends


class _WordHashes(dict):
    def __missing__(self, word: str) -> int:
        value = self[word] = _hash(word)
        return value


def _exact_pieces(chunk: str, hashes: dict[str, int]) -> list[tuple[int, bool]]:
    """Exact tokens of a chunk: hash, and whether it is one character of an unspaced script."""
    low = (_plain_word(chunk) or chunk.strip(".,;:!?\"'()[]")).lower()
    if low.isalpha() and (low.isascii() or max(low) < _FIRST_UNSPACED):
        return [(hashes[low], False)]
    return [(hashes[m[0]], m[1] is not None) for m in _EXACT.finditer(chunk.lower())]


class _Chunks(dict):
    """Number of a chunk; what new chunks mean waits in lists.

    ``vocabulary`` holds the benchmark's token hashes. A plain word in lower case that is
    none of them takes part in no window, so all such words share two numbers: one
    for those that end a sentence and one for the others.
    """

    def __init__(self, vocabulary: frozenset[int] | None):
        super().__init__({"a stranger": 0, "a stranger.": 1})  # with a space, so no chunk
        self.chars = 0
        self.new: list[str] = []
        self._vocabulary = vocabulary
        self._used = 2

    def __missing__(self, chunk: str) -> int:
        self.chars += len(chunk)
        word = _plain_word(chunk)
        if (self._vocabulary is not None and word and word.islower() and (word.isascii() or max(word) < _FIRST_UNSPACED)
                and word not in UNITS and _hash(word) not in self._vocabulary):
            place = self[chunk] = int(chunk[-1] in ".!?:")
            return place
        place = self[chunk] = self._used
        self._used += 1
        self.new.append(chunk)
        return place


@dataclass
class Form:
    """Tokens of several texts behind each other, in one form."""
    hash: np.ndarray
    kind: np.ndarray
    slot: np.ndarray
    owner: np.ndarray
    """Which text a token is of."""
    known: np.ndarray
    """Whether any benchmark window of this form holds the token."""

    def of_text(self, i: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        begin, end = np.searchsorted(self.owner, (i, i + 1))
        return self.hash[begin:end], self.kind[begin:end], self.slot[begin:end]

    def windows(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts and hashes of the windows that lie in one text and hold known tokens only.

        Fewer than ``LEAST_TOKENS`` tokens are a window only where they are the whole text.
        """
        count = len(self.hash) - width + 1
        if count <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        strange = np.concatenate([[0], np.cumsum(~self.known)])
        usable = (strange[width:] == strange[:count]) & (self.owner[width - 1:] == self.owner[:count])
        if width < LEAST_TOKENS:
            turns = np.concatenate([[True], self.owner[1:] != self.owner[:-1], [True]])
            usable &= turns[:count] & turns[width:]
        starts = np.flatnonzero(usable)
        return starts, window_hashes(self.hash, starts, width)


class TemplateReader:
    """Tokens of texts; what chunks of text mean is remembered up to a bound.

    ``vocabulary`` has the sorted token hashes of the benchmark by form; without it all
    tokens count as known.
    """

    def __init__(self, vocabulary: dict[int, np.ndarray] | None = None):
        self._vocabulary = vocabulary
        self._words_known = None if vocabulary is None else frozenset(
            np.concatenate([np.zeros(0, np.uint64), *vocabulary.values()]).tolist())
        self._slot_known = {f: self._is_known(_SLOT_HASH, f) for f in (0, 1)}
        self._reset()

    def _is_known(self, hashes: np.ndarray, form: int) -> np.ndarray:
        if self._vocabulary is None:
            return np.ones(len(hashes), bool)
        return np.isin(hashes, self._vocabulary.get(form, np.zeros(0, np.uint64)))

    def _reset(self) -> None:
        self._chunks = _Chunks(self._words_known)
        self._words = _WordHashes()
        # the first two chunks are one unknown word each
        self._hash = np.zeros(2, np.uint64)
        self._known = [np.zeros(2, bool)] * 2
        self._flags = np.zeros((2, 4), np.uint8)
        self._starts = np.arange(3)
        self._ends = np.array([False, True])
        self._exact_hash = np.zeros(2, np.uint64)
        self._exact_known = np.zeros(2, bool)
        self._exact_single = np.zeros(2, np.uint64)
        self._exact_starts = np.arange(3)

    def _catch_up(self) -> None:
        chunks, self._chunks.new = self._chunks.new, []
        if chunks:
            new = [_pieces(c) for c in chunks]
            tokens = [t for pieces, _ in new for t in pieces]
            hashes = np.array([t[0] for t in tokens], np.uint64)
            self._hash = np.concatenate([self._hash, hashes])
            self._known = [np.concatenate([self._known[f], self._is_known(hashes, f)]) for f in (0, 1)]
            self._flags = np.concatenate([self._flags, np.array([t[1:] for t in tokens], np.uint8).reshape(-1, 4)])
            self._starts = np.concatenate([self._starts, self._starts[-1] + np.cumsum([len(p) for p, _ in new])])
            self._ends = np.concatenate([self._ends, np.array([e for _, e in new], bool)])
            exact = [_exact_pieces(c, self._words) for c in chunks]
            hashes = np.array([t[0] for e in exact for t in e], np.uint64)
            self._exact_hash = np.concatenate([self._exact_hash, hashes])
            self._exact_known = np.concatenate([self._exact_known, self._is_known(hashes, _EXACT_FORM)])
            self._exact_single = np.concatenate([self._exact_single, np.array([t[1] for e in exact for t in e], np.uint64)])
            self._exact_starts = np.concatenate(
                [self._exact_starts, self._exact_starts[-1] + np.cumsum([len(e) for e in exact])])

    def read(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Per text: template hashes, kinds and slot values of its tokens."""
        form = self.forms(texts)[0]
        return [form.of_text(i) for i in range(len(texts))]

    def forms(self, texts: list[str]) -> list[Form]:
        """The tokens of all texts in each of the three forms."""
        if len(self._chunks) > _MAX_CHUNKS or self._chunks.chars > _MAX_CHARS or len(self._words) > _MAX_CHUNKS:
            self._reset()
        pieces = [text.split() for text in texts]
        sizes = list(map(len, pieces))
        places = np.fromiter(map(self._chunks.__getitem__, chain.from_iterable(pieces)), np.int64, sum(sizes))
        owner = np.repeat(np.arange(len(texts)), sizes)
        self._catch_up()
        return [*self._templates(places, owner), self._exact(places, owner)]

    def _exact(self, places: np.ndarray, owner: np.ndarray) -> Form:
        at, size = _token_places(self._exact_starts, places)
        # no slots; the third part tells characters of unspaced scripts
        return Form(self._exact_hash[at], np.zeros(len(at), np.uint8), self._exact_single[at],
                    np.repeat(owner, size), self._exact_known[at])

    def _templates(self, places: np.ndarray, owner: np.ndarray) -> list[Form]:
        at, size = _token_places(self._starts, places)
        value, flags = self._hash[at], self._flags[at]
        kind = flags[:, 0].copy()
        # a sentence starts with the text and after a chunk that ends one
        opens = np.ones(len(places), bool)
        opens[1:] = self._ends[places[:-1]] | (owner[1:] != owner[:-1])
        first, owner = np.repeat(opens, size), np.repeat(owner, size)
        after_number = np.zeros(len(at), bool)
        after_number[1:] = (kind[:-1] == _NUM) & (owner[1:] == owner[:-1])
        kind[(kind == _LITERAL) & (flags[:, 2] == 1) & after_number] = _UNIT
        capital = (kind == _LITERAL) & (flags[:, 1] == 1)
        mixed = value * np.uint64(0x9E3779B97F4A7C15)
        return [self._named(kind, value, mixed, capital & name, first, owner, self._known[form][at], form)
                for form, name in enumerate((~first, flags[:, 3] == 0))]

    def _named(self, kind, value, mixed, name, first, owner, known, form) -> Form:
        kind = np.where(name, np.uint8(_NAME), kind)
        # names in a row are one name, unless a sentence ends between them
        again = np.zeros(len(kind), bool)
        again[1:] = name[1:] & name[:-1] & ~first[1:]
        heads = np.flatnonzero(~again)
        slot = np.add.reduceat(mixed, heads) if len(heads) else value
        kind, literal = kind[heads], kind[heads] == _LITERAL
        return Form(np.where(literal, value[heads], _SLOT_HASH[kind]), kind, slot, owner[heads],
                    np.where(literal, known[heads], self._slot_known[form][kind]))


def _token_places(starts: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the tokens of chunks lie, and how many each chunk has."""
    begin = starts[places]
    size = starts[places + 1] - begin
    stop = np.cumsum(size)
    return np.arange(int(stop[-1]) if len(stop) else 0) + np.repeat(begin - (stop - size), size), size


def text_windows(tokens, width: int, form: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the windows of an item, and which have enough literal words."""
    template, kind, _ = tokens
    size = min(width, len(template))
    if size < (1 if form == _EXACT_FORM else LEAST_TOKENS):
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    literal = np.concatenate([[0], np.cumsum(kind == _LITERAL)])
    return windows(template, width), 2 * (literal[size:] - literal[:-size]) >= size


def _slots(tokens, start: int, size: int) -> list[int]:
    kind, value = tokens[1][start:start + size], tokens[2][start:start + size]
    return value[kind != _LITERAL].view(np.int64).tolist()


_WINDOW = ("item_id long, item_key long, form int, hash long, position int, width int, slots array<long>, "
           "windows long, run int, tokens array<long>")
_HIT = "doc_id long, doc_key long, form int, hash long, position long, slots array<long>"
_LINE = ("doc_id long, doc_key long, item_id long, item_key long, form int, windows long, run int, at array<int>, "
         "longest int, same_values boolean")


def _columns(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(schema)
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(),
             "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32())}
    return pa.schema([(name, kinds[kind]) for name, kind in (x.split() for x in ddl.split(", "))])


def _item_windows(width: int):
    schema = _arrow(_WINDOW)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = remembered("templates", TemplateReader)
        for batch in batches:
            rows = []
            read = reader.forms([t or "" for t in batch.column("text").to_pylist()])
            for row, (item, key) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("item_id", "item_key")))):
                for form, tokens in enumerate(f.of_text(row) for f in read):
                    hashes, usable = text_windows(tokens, width, form)
                    size, count = min(width, len(tokens[0])), int(usable.sum())
                    singles = form == _EXACT_FORM and 2 * int(tokens[2].sum()) > len(tokens[2])
                    for i in np.flatnonzero(usable).tolist():
                        rows.append((item, key, form, int(hashes[i].view(np.int64)), i, size,
                                     _slots(tokens, i, size), count, RUN * (1 + singles),
                                     tokens[0][i:i + size].view(np.int64).tolist()))
            yield _columns(rows, schema)
    return cut


class _Known:
    """Benchmark windows of one form: a sorted array behind a table of their leading bits."""

    def __init__(self, hashes: np.ndarray):
        self._hashes = hashes
        bits = min(24, max(16, len(hashes).bit_length() + 4))
        self._shift = np.uint64(64 - bits)
        self._table = np.zeros(1 << bits, bool)
        self._table[hashes >> self._shift] = True

    def places(self, found: np.ndarray) -> list[int]:
        maybe = np.flatnonzero(self._table[found >> self._shift])
        at = np.searchsorted(self._hashes, found[maybe])
        at[at == len(self._hashes)] = 0
        return maybe[self._hashes[at] == found[maybe]].tolist()


def _hits(wanted, widths: list[tuple[int, int]]):
    """Document windows that are among the broadcast benchmark windows.

    A window that holds a token of no benchmark window equals none, so only the others are hashed.
    """
    schema = _arrow(_HIT)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = remembered(("templates", wanted.value["key"]), lambda: TemplateReader(wanted.value["tokens"]))
        known = {form: _Known(hashes) for form, hashes in wanted.value["windows"].items()}
        for batch in batches:
            row = 0
            while row < batch.num_rows:  # some texts at a time, so that memory stays bounded
                texts, size = [], 0
                while row + len(texts) < batch.num_rows and size < _CHARS_AT_ONCE:
                    texts.append(batch.column("text")[row + len(texts)].as_py() or "")
                    size += len(texts[-1])
                ids, keys = (batch.column(c).slice(row, len(texts)).to_pylist() for c in ("doc_id", "doc_key"))
                forms, rows = reader.forms(texts), []
                for form, width in widths:
                    tokens = forms[form]
                    starts, found = tokens.windows(width)
                    for place in known[form].places(found):
                        i = int(starts[place])
                        text = int(tokens.owner[i])
                        begin = int(np.searchsorted(tokens.owner, text))
                        slots = _slots((tokens.hash, tokens.kind, tokens.slot), i, width)
                        rows.append((ids[text], keys[text], form, int(found[place].view(np.int64)), i - begin, slots))
                yield _columns(rows, schema)
                row += len(texts)
    return find


def _majority(pairs: list[tuple[int, int]]) -> set[tuple[int, int]]:
    """The pairs met most often, each value in one of them."""
    met = Counter(pairs)
    chosen, left, right = set(), set(), set()
    for a, b in sorted(met, key=lambda p: (-met[p], p[0] != p[1], p)):
        if a not in left and b not in right:
            chosen.add((a, b))
            left.add(a)
            right.add(b)
    return chosen


def _judged_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines with the windows that agree with the majority, and the longest run they cover."""
    schema = _arrow(_LINE)
    for batch in batches:
        rows = []
        for r in batch.to_pylist():
            met = [(w["at"], w["width"], [(x["a"], x["b"]) for x in w["pairs"]]) for w in r["met"]]
            chosen = _majority([x for _, _, pairs in met for x in pairs])
            kept = sorted(m for m in met if all(a == b or (a, b) in chosen for a, b in m[2]))
            if not kept:
                continue
            longest, start, end = 0, kept[0][0], kept[0][0]
            for at, width, _ in kept:
                if at > end:
                    start = at
                end = max(end, at + width)
                longest = max(longest, end - start)
            rows.append((r["doc_id"], r["doc_key"], r["item_id"], r["item_key"], r["form"], r["windows"], r["run"],
                         sorted({m[0] for m in kept}), longest, all(a == b for _, _, pairs in kept for a, b in pairs)))
        yield _columns(rows, schema)


def _by_form(hashes: DataFrame, forms: list[int]) -> dict[int, np.ndarray]:
    """Sorted distinct hashes of every form."""
    table = hashes.distinct().toArrow()
    form, values = (table.column(c).to_numpy() for c in ("form", "hash"))
    return {f: np.unique(values[form == f].astype(np.int64).view(np.uint64)) for f in forms}


def contaminated(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH,
                 least_coverage: float = LEAST_COVERAGE, block: int = BLOCK) -> DataFrame:
    """(doc_id, item_id, matched, windows, same_values) per contaminated document and item."""
    texts = contaminated_texts(docs, benchmark, width, least_coverage, block)
    best = F.max(F.struct((F.col("matched") / F.col("windows")).alias("share"), "order",
                          "matched", "windows", "same_values"))
    return texts.groupBy("doc_id", "item_id").agg(best.alias("best")).select(
        "doc_id", "item_id", "best.matched", "best.windows", "best.same_values")


def contaminated_texts(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH,
                       least_coverage: float = LEAST_COVERAGE, block: int = BLOCK) -> DataFrame:
    """(doc_id, doc_key, item_id, matched, windows, same_values, order) per form of a contaminated text.

    ``doc_key`` is ``xxhash64(text)`` and tells the texts of a repeated id apart.
    """
    spark = docs.sparkSession
    items = staged(benchmark.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select(
        F.col("item_id").cast("long").alias("item_id"), F.xxhash64("text").alias("item_key"), "text").mapInArrow(
        _item_windows(width), _WINDOW), "templates")
    texts = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("doc_key"), "text")
    blocks = max(1, -(-items.count() // block))
    hits = None
    for part in range(blocks):
        mine = items.where(F.pmod("hash", F.lit(blocks)) == part)
        widths = sorted((r.form, r.width) for r in mine.select("form", "width").distinct().collect())  # at most `width` a form
        forms = sorted({f for f, _ in widths})
        wanted = {"windows": _by_form(mine.select("form", "hash"), forms),
                  "tokens": _by_form(mine.select("form", F.explode("tokens").alias("hash")), forms)}
        if forms:
            wanted["key"] = xxhash.xxh3_64_intdigest(b"".join(wanted["windows"][f].tobytes() for f in forms))
            found = texts.mapInArrow(_hits(spark.sparkContext.broadcast(wanted), widths), _HIT)
            hits = found if hits is None else hits.unionByName(found)
    if hits is None:
        return spark.createDataFrame([], "doc_id long, doc_key long, item_id long, matched long, windows long, "
                                         "same_values boolean, order int")
    pairs = F.transform(F.arrays_zip(F.col("i.slots").alias("a"), F.col("h.slots").alias("b")), lambda x: x)
    met = staged(hits, "template-hits").alias("h").join(items.alias("i"), ["form", "hash"]).select(
        "doc_id", "doc_key", "item_id", "item_key", "form", (F.col("h.position") - F.col("i.position")).alias("line"),
        "windows", "run", F.struct(F.col("i.position").alias("at"), "width", pairs.alias("pairs")).alias("met"))
    one = ["doc_id", "doc_key", "item_id", "item_key", "form"]
    lines = met.groupBy(*one, "line").agg(
        F.max("windows").alias("windows"), F.max("run").alias("run"), F.collect_set("met").alias("met"))
    joined = lines.mapInArrow(_judged_lines, _LINE).groupBy(*one).agg(
        F.max("windows").alias("windows"), F.max("run").alias("run"), F.max("longest").alias("longest"),
        F.size(F.array_distinct(F.flatten(F.collect_list("at")))).cast("long").alias("matched"),
        F.bool_and("same_values").alias("same_values"))
    return joined.where((F.col("matched") >= least_coverage * F.col("windows")) | (F.col("longest") >= F.col("run"))).select(
        "doc_id", "doc_key", "item_id", "matched", "windows", "same_values", (-F.col("form")).alias("order"))
