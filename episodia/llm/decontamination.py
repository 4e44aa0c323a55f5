"""Benchmark decontamination by template windows with slot checks.

Numbers, units and names become typed placeholders, so a question whose figures
or names were exchanged keeps its template.  Windows of eight template tokens are
hash-joined with those of the benchmark; along one alignment of a document and an
item the exchanged values must be consistent: each value of the item always turns
into the same value of the document.  Where one does not, the unchanged windows
still count.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from episodia.llm.words import U64, WordTable, mixed, text_parts, word_codes
from episodia.session import durable

WIDTH = 8
#: a window with fewer literal words is compared by its values; a document needs this part of an item's windows
LITERALS, COVERAGE = 4, 0.5
#: or a passage of so many tokens, met window by window
PASSAGE = 50
#: bits of the filter that tasks get: 16 for each benchmark window, within these bounds
FILTER_BITS = (1 << 16, 1 << 27)
#: benchmark windows up to this number are sent to all executors; more are shuffled
BROADCAST_WINDOWS = 500_000

NUM, UNIT, NAME = U64(11), U64(12), U64(13)
LITERAL_, NUMBER_, UNIT_, NOTHING_ = 0, 1, 2, 3
CAPITAL, STOP = 4, 8

# fixed values: units and number words that count as slots
UNITS = frozenset(
    b"mm cm m km in inch inches ft foot feet yd yard yards mi mile miles mg g kg gram grams kilogram kilograms lb lbs pound pounds oz ounce ounces "
    b"ml l liter liters litre litres gallon gallons s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years "
    b"km/h mph m/s hz khz mhz ghz w kw j kj v a k c f percent % dollar dollars euro euros cent cents usd eur".split())
NUMBER_WORDS = frozenset(
    b"zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty "
    b"thirty forty fifty sixty seventy eighty ninety hundred thousand million billion".split())

NUMBER = re.compile(rb"^[+-]?[$]?(?:\d[\d.,:/]*)([a-z%]*)$")
EDGES = b".,;:!?\"'`()[]{}<>*#|&$_~=-"
LINE = b"\x1e"


def word_kinds(words: list[bytes]) -> np.ndarray:
    """Value code and flags of each distinct word: shape (n, 2)."""
    out = np.empty((len(words), 2), np.int64)
    stems, flags = [], []
    for w in words:
        stem = w.strip(EDGES)
        flag = STOP if w == LINE or w[-1:] in (b".", b"!", b"?", b":") else 0
        low = stem.lower()
        if not stem:
            kind = NOTHING_
        elif low in UNITS:
            kind = UNIT_
        elif low in NUMBER_WORDS or (m := NUMBER.match(low)) and (not m[1] or m[1] in UNITS):
            kind = NUMBER_
        else:
            kind = LITERAL_
            if not w.islower():
                text = stem.decode("utf-8", "replace")
                low = text.lower().encode()
                if text[:1].isupper() and text[1:].islower():
                    flag |= CAPITAL
        stems.append(low)
        flags.append(kind | flag)
    out[:, 0] = word_codes(stems).view(np.int64)
    out[:, 1] = flags
    return out


class Templates:
    """Template tokens of several texts at once, in one of three forms.

    In form 0 capitalised words are literal (for texts in changed case); in form
    1 a run of them inside a sentence is one name slot; in form 2 also one that
    opens a sentence.
    """

    def __init__(self, texts: list[bytes | None], table: WordTable):
        rows = [table.rows(t.replace(b"\n", b" \x1e ").split()) if t else np.empty(0, np.int64) for t in texts]
        values = table.filled()
        self.doc = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        flat = values[np.concatenate(rows)] if len(self.doc) else np.empty((0, 2), np.int64)
        self.value, flag = np.ascontiguousarray(flat[:, 0]).view(U64), flat[:, 1]
        self.kind = flag & 3
        first = np.concatenate([[True], self.doc[1:] != self.doc[:-1]])[:len(self.doc)]
        opens = first | np.concatenate([[True], (flag[:-1] & STOP) > 0])[:len(self.doc)]
        self.capital = ((flag & CAPITAL) > 0) & (self.kind == LITERAL_)
        self.opens = opens
        table.trim()

    def windows(self, form: int, short: list[int] | None = None):
        """(document, window number in it, hash, by value, token, width) of each window.

        Windows are ``WIDTH`` tokens wide.  A shorter text is one window; with
        ``short``, windows of these widths are taken from every text instead.
        """
        use = self.kind != NOTHING_
        doc, value, kind, opens = self.doc[use], self.value[use], self.kind[use], self.opens[use]
        name = np.zeros(len(doc), bool) if form == 0 else self.capital[use] & (~opens | (form == 2))
        if name.any():
            go_on = np.concatenate([[False], name[1:] & name[:-1] & ~opens[1:] & (doc[1:] == doc[:-1])])[:len(doc)]
            start = np.flatnonzero(~go_on)
            with np.errstate(over="ignore"):
                value = np.add.reduceat(mixed(value), start) if len(start) else value
            doc, kind, name = doc[start], kind[start], name[start]
        token = mixed(value)
        by_value = token.copy()
        token[kind == NUMBER_], token[kind == UNIT_], token[name] = NUM, UNIT, NAME
        slot = (kind != LITERAL_) | name
        n = np.bincount(doc, minlength=int(doc[-1]) + 1 if len(doc) else 0)
        begin = np.concatenate([[0], np.cumsum(n)])[:-1]
        place = np.arange(len(doc)) - begin[doc] if len(doc) else np.empty(0, np.int64)
        left = n[doc] - place if len(doc) else np.empty(0, np.int64)
        if short is None:
            width = np.minimum(n, WIDTH)[doc] if len(doc) else np.empty(0, np.int64)
            at = np.flatnonzero(width <= left)
            width = width[at]
        else:
            some = [np.flatnonzero(left >= w) for w in (*short, WIDTH)]
            at, width = np.concatenate(some), np.repeat([*short, WIDTH], [len(x) for x in some])
        filled = np.concatenate([[0], np.cumsum(~slot)])
        low = filled[at + width] - filled[at] < np.minimum(LITERALS, width)
        h = np.empty(len(at), U64)
        for some, tokens, salt in ((~low, token, (0xE7037ED1A0B428DB, 0xA0761D6478BD642F, 0x8EBC6AF09C88C6E3)[form]), (low, by_value, (0x589965CC75374CC3, 0x1D8E4E27C47D124F, 0xEB44ACCAB455D165)[form])):
            where, wide = at[some], width[some]
            with np.errstate(over="ignore"):
                x = np.full(len(where), U64(salt), U64) * (wide.astype(U64) + U64(1))
                for i in range(WIDTH):
                    on = i < wide
                    j = np.minimum(where + i, max(len(doc) - 1, 0))
                    x = np.where(on, x * U64(0xD1342543DE82EF95) + mixed(tokens[j] + U64(i)), x)
            h[some] = mixed(x)
        self._values, self._slot = value, slot
        return doc[at], place[at], h, low, at, width

    def slots(self, at: int, width: int) -> list[int]:
        """Values in the slots of the window of ``width`` tokens from token ``at``."""
        part = slice(at, at + width)
        return self._values[part][self._slot[part]].view(np.int64).tolist()


FORMS = (0, 1, 2)
OUT = pa.schema([("row", pa.int64()), ("form", pa.int32()), ("p", pa.int64()), ("h", pa.int64()), ("low", pa.bool_()), ("width", pa.int32()), ("slots", pa.list_(pa.int64()))])


def _window_rows(bits: np.ndarray | None, short: dict[int, list[int]] | None = None):
    """Windows of each text, all of them or those that may be in the filter.

    ``short`` has the widths below ``WIDTH`` of each form to look for.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = WordTable(word_kinds)
        size = None if bits is None else U64(len(bits) * 64 - 1)
        for whole in batches:
            for batch in text_parts(whole):
                ids = np.asarray(batch.column("row"))
                templates = Templates(batch.column("text").to_pylist(), table)
                for form in FORMS:
                    doc, place, h, low, at, width = templates.windows(form, None if short is None else short.get(form, []))
                    if bits is not None:
                        keep = np.ones(len(h), bool)
                        for probe in (h & size, (h >> U64(32)) & size):
                            keep &= (bits[(probe >> U64(6)).astype(np.int64)] >> (probe & U64(63))) & U64(1) > 0
                        doc, place, h, low, at, width = doc[keep], place[keep], h[keep], low[keep], at[keep], width[keep]
                    # windows compared by value have no slots to compare
                    slots = [[] if v else templates.slots(int(i), int(w)) for v, i, w in zip(low, at, width)]
                    yield pa.RecordBatch.from_arrays([
                        pa.array(ids[doc], pa.int64()), pa.array(np.full(len(h), form), pa.int32()), pa.array(place, pa.int64()), pa.array(h.view(np.int64)),
                        pa.array(low), pa.array(width, pa.int32()), pa.array(slots, pa.list_(pa.int64()))], schema=OUT)

    return run


SCHEMA = "row long, form int, p long, h long, low boolean, width int, slots array<long>"


def window_filter(windows: DataFrame, count: int) -> np.ndarray:
    """A bit array that holds two bits of every benchmark window, at most 16 MB."""
    size = FILTER_BITS[0]
    while size < 16 * count and size < FILTER_BITS[1]:
        size *= 2
    probe = F.explode(F.array(F.col("h").bitwiseAND(F.lit(size - 1).cast("long")), F.shiftrightunsigned("h", 32).bitwiseAND(F.lit(size - 1).cast("long"))))
    words = windows.select(probe.alias("x")).groupBy(F.shiftright("x", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(x & 63 as int))")).alias("bits"))
    out = np.zeros(size // 64, np.int64)
    for r in words.toLocalIterator():
        out[r["word"]] = r["bits"]
    return out.view(U64)


def text_key(doc_id: str) -> Column:
    return F.xxhash64(doc_id, "text")


def _text_leaks(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", coverage: float = COVERAGE) -> DataFrame:
    """The rows of :func:`leaks` for each text of an id, with ``_key``, a hash of both."""
    spark = docs.sparkSession
    id_type, item_type = docs.schema[doc_id].dataType.simpleString(), benchmark.schema[item_id].dataType.simpleString()
    items = benchmark.filter(F.col("text").isNotNull()).groupBy("text").agg(F.min(item_id).alias("item"))
    items = durable(items.select("item", F.col("text").cast("binary").alias("text"), F.monotonically_increasing_id().alias("row")))
    theirs = durable(items.select("row", "text").mapInArrow(_window_rows(None), SCHEMA))
    count = theirs.count()
    bits = spark.sparkContext.broadcast(window_filter(theirs, count))
    short: dict[int, list[int]] = {}
    for r in theirs.filter(F.col("width") < WIDTH).select("form", "width").distinct().collect():  # at most seven widths in each form
        short.setdefault(r["form"], []).append(r["width"])
    rows = docs.select(F.col(doc_id).alias("doc"), text_key(doc_id).alias("key"), F.col("text").cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def numbered():
            for batch in batches:
                ids.append((batch.column("doc"), batch.column("key")))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(batch.num_rows)), batch.column("text")], ["row", "text"])

        ids: list = []
        for out in _window_rows(bits.value, short)(numbered()):
            yield pa.RecordBatch.from_arrays([*[x.take(out.column("row")) for x in ids[-1]], *out.columns[1:]], ["doc", "key", *OUT.names[1:]])
            del ids[:-1]

    ours = rows.mapInArrow(run, SCHEMA.replace("row long", f"doc {id_type}, key long")).drop("low", "width")
    totals = theirs.groupBy("row", "form").agg(F.count_if(~F.col("low")).alias("templates"), F.count(F.lit(1)).alias("total"))
    theirs = theirs.select("row", "form", "h", "low", F.col("p").alias("q"), F.col("slots").alias("values"))
    if count <= BROADCAST_WINDOWS:
        theirs = F.broadcast(theirs)
    met = ours.join(theirs, ["form", "h"])
    pairs = F.array_distinct(F.flatten(F.collect_list(F.arrays_zip(F.col("values").alias("v"), F.col("slots").alias("s")))))
    kept = F.col("values") == F.col("slots")
    # one group: the windows of one item along one alignment
    lines = met.groupBy("doc", "key", "row", "form", (F.col("p") - F.col("q")).alias("shift")).agg(F.collect_set(F.struct("q", "low", kept.alias("kept"))).alias("met"), pairs.alias("pairs"))
    # each value of the item turns into one value of the document; two may turn into the same
    fits = F.size(F.array_distinct(F.col("pairs.v"))) == F.size("pairs")
    same = F.forall("pairs", lambda x: x["v"] == x["s"])
    lines = lines.select("doc", "key", "row", "form", "met", F.size("pairs").alias("n"), same.alias("same"), fits.alias("fits"))
    # where a value turns into several, only unchanged windows are met
    lines = lines.withColumn("met", F.sort_array(F.filter("met", lambda x: F.col("fits") | x["kept"])))
    none = F.struct(F.lit(-2).cast("long").alias("q"), F.lit(0).alias("run"), F.lit(0).alias("most"))

    def grown(so_far, x):
        run = F.when(x["q"] == so_far["q"] + 1, so_far["run"] + 1).otherwise(1)
        return F.struct(x["q"].alias("q"), run.alias("run"), F.greatest(so_far["most"], run).alias("most"))

    lines = lines.withColumn("run", F.aggregate("met", none, grown)["most"])
    each = lines.select("*", F.posexplode("met").alias("at", "window")).withColumns({"q": F.col("window.q"), "low": F.col("window.low")})
    # an item's window counts once, however often and along whatever alignment it is met
    one = F.when(F.col("at") == 0, F.col("n"))
    each = each.groupBy("doc", "key", "row", "form", "q", "low").agg(
        F.max("fits").alias("fits"), F.sum(F.when(F.col("fits"), one)).alias("n"), F.sum(one).alias("n_all"), F.min(F.when(F.col("fits"), F.col("same"))).alias("same"), F.max("run").alias("run"))
    template = ~F.col("low")
    counts = each.groupBy("doc", "key", "row", "form").agg(
        F.count_if("fits").alias("w_all"), F.count_if(F.col("fits") & template).alias("w_templates"), F.count("q").alias("c_all"), F.count_if(template).alias("c_templates"),
        F.sum("n").alias("n"), F.sum("n_all").alias("n_all"), F.min("same").alias("same"), F.max("run").alias("run")).join(totals, ["row", "form"])

    def share(what: str) -> Column:
        # of the template windows or of all, whichever is larger
        return F.greatest(F.try_divide(what + "_templates", "templates"), F.try_divide(what + "_all", "total"))

    best = counts.withColumns({"whole": share("w"), "coverage": share("c")})
    whole = F.col("whole") >= coverage
    best = best.filter(whole | (F.col("coverage") > coverage) | (F.col("run") > PASSAGE - WIDTH))
    best = best.withColumns({"slots": F.coalesce(F.when(whole, F.col("n")).otherwise(F.col("n_all")), F.lit(0)), "verbatim": whole & F.col("same")})
    best = best.groupBy("doc", "key", "row").agg(F.max("coverage").alias("coverage"), F.max("slots").cast("long").alias("slots"), F.max("verbatim").alias("verbatim"))
    named = best.join(items.select("row", "item"), "row")
    return named.select(F.col("doc").cast(id_type).alias("doc_id"), F.col("key").alias("_key"), F.col("item").cast(item_type).alias("item_id"), "coverage", "slots", "verbatim")


def leaks(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", coverage: float = COVERAGE) -> DataFrame:
    """Documents that hold an item of the benchmark, verbatim or re-parameterised.

    One row for each ``doc_id`` and ``item_id`` with ``coverage`` (part of the
    item's windows met along consistent alignments, at least the given part; more
    than that part where unchanged windows of other alignments are needed),
    ``slots`` (slot values compared) and ``verbatim`` (all of them equal).  A
    passage of ``PASSAGE`` tokens met in one piece suffices, whatever its part.
    Windows with fewer than four literal words are met by equal values only.  An
    item of fewer than eight tokens is one window of its own width.  Null
    and empty texts match nothing; equal items are reported once, under the
    smallest id; repeated documents report the same row; empty tables give none.
    """
    found = _text_leaks(docs, benchmark, doc_id, item_id, coverage).groupBy("doc_id", "item_id")
    return found.agg(F.max("coverage").alias("coverage"), F.max("slots").alias("slots"), F.max("verbatim").alias("verbatim"))


def drop_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the documents in which an item of the benchmark is found.

    Rows that share an id with such a document but not its text stay.
    """
    found = _text_leaks(docs, benchmark).select("_key").distinct()
    return docs.join(found, F.xxhash64(docs["doc_id"], docs["text"]) == found["_key"], "left_anti")


def op2_template_windows(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
