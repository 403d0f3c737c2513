"""Benchmark decontamination by templates.

Texts become sequences of tokens in which numbers, names and units are typed placeholders, of whatever length. Windows of
``width`` tokens are hashed; a hash join finds the windows that a document shares with a benchmark item. Windows of one
document and item on one diagonal are aligned, and their slots (what the placeholders stand for) must be consistent: a slot
value of the item always stands for the same value in the document, and different ones don't fall together. So a question is
caught with its numbers and names changed, but not a text that merely has numbers in the same places.

The item's windows are broadcast while they are no more than ``broadcast_windows``; beyond it the windows of documents and
items meet in a shuffled join. Alignment and slots are checked by aggregates over (document, item, diagonal).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sitelens.llm.common import settled, stored, unused
from sitelens.llm.wordhash import mix, span_hashes, text_parts, word_spans

INSIDE = np.array([48 <= c < 58 or 65 <= c < 91 or 97 <= c < 123 or c >= 128 for c in range(256)])
DIGIT = np.array([48 <= c < 58 for c in range(256)])
UPPER = np.array([65 <= c < 91 for c in range(256)])
LOWER = np.array([c + 32 if 65 <= c < 91 else c for c in range(256)], np.uint8)
#: After these a capital letter begins a sentence and says little of a name. Fixed values.
STOPS = np.array([c in b".!?:;\n\"'()[]{}*#-|>" for c in range(256)])
#: Fixed values.
UNITS = ["mm", "cm", "m", "km", "inch", "inches", "foot", "feet", "yard", "yards", "mile", "miles", "mg", "g", "kg", "gram", "grams", "kilogram", "kilograms", "ounce", "ounces", "pound", "pounds", "ton", "tons", "ml", "l", "liter", "liters", "litre", "litres", "gallon", "gallons", "second", "seconds", "minute", "minutes", "hour", "hours", "day", "days", "week", "weeks", "month", "months", "year", "years", "cent", "cents", "dollar", "dollars", "euro", "euros", "usd", "eur", "gbp", "percent", "degree", "degrees", "meter", "meters", "metre", "metres", "centimeter", "centimeters", "kilometer", "kilometers", "mph", "kmh", "celsius", "fahrenheit", "watt", "watts", "volt", "volts", "joule", "joules", "newton", "newtons"]
NUMBERS = ["zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve", "thirteen", "fourteen", "fifteen", "sixteen", "seventeen", "eighteen", "nineteen", "twenty", "thirty", "forty", "fifty", "sixty", "seventy", "eighty", "ninety", "hundred", "thousand", "million"]
#: Words that open sentences and are no names. Fixed values.
OPENERS = ["a", "after", "all", "an", "and", "are", "as", "at", "before", "but", "by", "calculate", "can", "could", "did", "do", "does", "each", "every", "find", "for", "from", "given", "he", "her", "his", "how", "i", "if", "in", "is", "it", "its", "let", "no", "not", "of", "on", "or", "she", "so", "some", "suppose", "that", "the", "their", "then", "there", "these", "they", "this", "those", "to", "was", "we", "were", "what", "when", "where", "which", "who", "whose", "why", "will", "with", "would", "you"]
WORD, NUMBER, NAME, UNIT = 0, 1, 2, 3
PLACEHOLDER = np.array([0, 0x9AE16A3B2F90404F, 0xC949D7C7509E6557, 0xB492B66FBE98F273], np.uint64)
#: Bytes between the parts of one number, of one number in words, of one name.
IN_NUMBER, IN_WORDS, IN_NAME = (np.array([c in signs for c in range(256)]) for signs in (b".,:/'", b" -", b" -'"))
#: Items of fewer tokens match nothing.
LEAST_TOKENS = 3


def _hashes(words: list[str]) -> np.ndarray:
    data = [w.encode() for w in words]
    ends = np.cumsum([len(w) for w in data])
    return np.sort(span_hashes(np.frombuffer(b"".join(data), np.uint8), np.r_[0, ends[:-1]], ends))


UNIT_HASHES, NUMBER_HASHES, OPENER_HASHES = _hashes(UNITS), _hashes(NUMBERS), _hashes(OPENERS)


def _among(h: np.ndarray, known: np.ndarray) -> np.ndarray:
    return known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h if len(known) else np.zeros(len(h), bool)


def canonical(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(kind, hash of the token's own lower-case text, whether it may be a name that opens a sentence) of each token, and the first token of each row.

    A number is a word with a digit or a number word; a name is a word with a capital that begins no sentence, line or
    row and isn't all capitals next to other such words, or one that begins it right before such a name; a unit is a word
    of the list. The parts of a number ("1,200", "3.5", "twenty-five") and of a name ("John Smith") are one token.
    """
    starts, ends, first = word_spans(data, bounds, INSIDE)
    n = len(starts)
    kind = np.zeros(n, np.int8)
    if not n:
        return kind, np.empty(0, np.uint64), np.zeros(0, bool), first
    lower = LOWER[data]
    own = span_hashes(lower, starts, ends)
    digits = np.concatenate([[0], np.cumsum(DIGIT[data])])
    digit = digits[ends] > digits[starts]
    stops = np.concatenate([[0], np.cumsum(STOPS[data])])
    before = np.concatenate([[0], ends[:-1]])
    leads = np.zeros(n, bool)
    leads[first[:-1][first[:-1] < n]] = True
    opens = (stops[starts] > stops[np.minimum(before, starts)]) | leads
    upper = np.concatenate([[0], np.cumsum(UPPER[data])])
    capital = UPPER[data[starts]] & ~((upper[ends] - upper[starts] > 1) | (ends - starts < 2))
    kind[capital & ~opens] = NAME
    kind[_among(own, UNIT_HASHES)] = UNIT
    kind[digit | _among(own, NUMBER_HASHES)] = NUMBER
    # one byte before a token, where that is all that parts it from the last token of its row
    near = (starts - before == 1) & ~leads
    gap = data[np.maximum(starts - 1, 0)]
    named = np.zeros(n, bool)
    named[:-1] = near[1:] & IN_NAME[gap[1:]] & (kind[1:] == NAME)
    opener = capital & opens & (kind == WORD) & ~_among(own, OPENER_HASHES)
    kind[opener & named] = NAME
    opener &= kind == WORD
    last = np.concatenate([[-1], kind[:-1]])
    digit_before = np.concatenate([[False], digit[:-1]])
    number = (kind == NUMBER) & (last == NUMBER) & ((digit & digit_before & IN_NUMBER[gap]) | (~digit & ~digit_before & IN_WORDS[gap]))
    joined = near & (number | ((kind == NAME) & (last == NAME) & IN_NAME[gap]))
    if joined.any():
        place = np.nonzero(~joined)[0]
        ends = ends[np.r_[place[1:] - 1, n - 1]]
        first = np.concatenate([[0], np.cumsum(~joined)])[first]
        kind, opener = kind[place], opener[place]
        own = span_hashes(lower, starts[place], ends)
    return kind, own, opener, first


def windows(token: np.ndarray, first: np.ndarray, width: int) -> np.ndarray:
    """Hashes of the windows from each token on; those that leave their row mean nothing."""
    n = len(token) - width + 1
    h = np.full(max(n, 0), width, np.uint64)
    for i in range(width if n > 0 else 0):
        h = h * np.uint64(0x100000001B3) + token[i : i + n]
    return mix(h)


def _found(data: np.ndarray, bounds: np.ndarray, widths: list[int], least_words: int, fit, known: np.ndarray | None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]]:
    """(token, first tokens of the rows, hash, slots, width) of windows. ``fit``: which tokens may begin one of a width, by (tokens of the row, place in it).

    Windows of ``least_words`` plain words have placeholders, once with words that open sentences as they are and once as
    names; others are taken as they are written.
    """
    kind, own, opener, first = canonical(data, bounds)
    if not len(kind):
        return
    row_end = np.repeat(first[1:], np.diff(first))
    row_start = np.repeat(first[:-1], np.diff(first))
    plain_kind, open_kind = kind == WORD, (kind == WORD) & ~opener
    tokens = [np.where(plain_kind, own, PLACEHOLDER[kind]), np.where(opener, PLACEHOLDER[NAME], np.where(plain_kind, own, PLACEHOLDER[kind])), own]
    slots = [np.where(plain_kind, np.uint64(0), own), np.where(open_kind, np.uint64(0), own), np.zeros(len(own), np.uint64)]
    count = lambda mask: np.concatenate([[0], np.cumsum(mask)])
    plain, open_plain, openers = count(plain_kind), count(open_kind), count(opener)
    for width in widths:
        n = len(kind) - width + 1
        if n <= 0:
            continue
        at = np.arange(n)
        inside = (at + width <= row_end[:n]) & fit(width, row_end[:n] - row_start[:n], at - row_start[:n])
        least = min(least_words, width - 1)
        enough = plain[width:] - plain[:n] >= least
        choice = [enough, (openers[width:] > openers[:n]) & (open_plain[width:] - open_plain[:n] >= least), ~enough]
        for token, slot, chosen in zip(tokens, slots, choice, strict=True):
            place = np.nonzero(inside & chosen)[0]
            if not len(place):
                continue
            h = windows(token, first, width)[place]
            if known is not None:
                hit = _among(h, known)
                place, h = place[hit], h[hit]
            if len(place):
                yield place, first, h, slot[place[:, None] + np.arange(width)], width


def _rows_of(widths: list[int], least_words: int, fit, only):
    """Windows of each row with their slots; with ``only`` (sorted hashes) just those."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = only() if only else None
        for batch in batches:
            ids, ks = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
            for at, data, bounds in text_parts(batch.column(2)):
                for place, first, h, slots, width in _found(data, bounds, widths, least_words, fit, known):
                    row = np.searchsorted(first, place, "right") - 1
                    offsets = pa.array(np.arange(0, (len(place) + 1) * width, width, dtype=np.int32))
                    yield pa.RecordBatch.from_arrays([pa.array(ids[at + row], pa.int64()), pa.array(ks[at + row], pa.int64()), pa.array((place - first[row]).astype(np.int32)), pa.array(h.view(np.int64)), pa.ListArray.from_arrays(offsets, pa.array(slots.ravel().view(np.int64)))], ["id", "k", "place", "h", "slots"])

    return run


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at, data, bounds in text_parts(batch.column(2)):
            n = np.diff(canonical(data, bounds)[3])
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(n)), batch.column(1).slice(at, len(n)), pa.array(n.astype(np.int32))], ["id", "k", "n_tokens"])


#: So large a part of a diagonal's slots must be consistent.
CONSISTENT = 0.8
WINDOW = "id long, k long, place int, h long, slots array<long>"


def _rows(table: DataFrame, key: str) -> DataFrame:
    text = F.col("text").cast("string")
    return table.where(F.col(key).isNotNull() & text.isNotNull()).select(F.col(key).cast("long").alias("id"), F.xxhash64(text).alias("k"), text.alias("text"))


def _aligned(pairs: DataFrame) -> DataFrame:
    """Diagonals with consistent slots: ``matched`` tokens, first and last places in document and item, slots.

    On a diagonal (a document, an item, the distance of their places) each place of the item is looked at once, so a
    diagonal has no more rows than the item has tokens. A slot's value is consistent if it and the value that it stands
    for are one another's commonest.
    """
    diagonal = ["doc_id", "k", "item_id", "item_k", "shift"]
    tokens = pairs.select(*diagonal, "item_place", F.posexplode(F.arrays_zip("item_slots", "slots")).alias("i", "s"))
    tokens = tokens.select(*diagonal, (F.col("item_place") + F.col("i")).alias("at"), F.col("s.item_slots").alias("a"), F.col("s.slots").alias("b"))
    # a word that may be a name is a slot where any window took it so
    tokens = tokens.groupBy(*diagonal, "at").agg(F.max(F.struct(F.col("a") != 0, "a", "b")).alias("t")).select(*diagonal, "at", "t.a", "t.b")
    by = lambda *c: Window.partitionBy(*diagonal, *c)
    counted = tokens.withColumn("n", F.count(F.lit(1)).over(by("a", "b")))
    counted = counted.withColumns({"to": F.max(F.struct("n", "b")).over(by("a"))["b"], "of": F.max(F.struct("n", "a")).over(by("b"))["a"]})
    slot = F.col("a") != 0
    good = (F.col("to") == F.col("b")) & (F.col("of") == F.col("a"))
    held = counted.groupBy(*diagonal).agg(
        F.count_if(~slot | good).cast("int").alias("matched"), F.count_if(slot).alias("slots"), F.count_if(slot & good).alias("consistent"),
        F.min(F.when(~slot | good, F.col("at"))).alias("item_first"), (F.max(F.when(~slot | good, F.col("at"))) + 1).alias("item_last"),
        F.count_distinct(F.when(slot & good, F.col("a"))).cast("int").alias("n_slots"), F.count_distinct(F.when(slot & good & (F.col("a") != F.col("b")), F.col("a"))).cast("int").alias("n_changed"),
    )
    held = held.where(F.col("consistent") >= F.lit(CONSISTENT) * F.col("slots"))
    return held.withColumns({"first": F.col("item_first") + F.col("shift"), "last": F.col("item_last") + F.col("shift")})


def _leaks(docs: DataFrame, benchmark: DataFrame, width: int, least_words: int, share: float, broadcast_windows: int) -> DataFrame:
    spark = docs.sparkSession
    items = _rows(benchmark, "item_id").distinct()
    words, _ = stored(items.mapInArrow(_sizes, "id long, k long, n_tokens int"), "item-sizes")
    short = [r.n_tokens for r in words.where((F.col("n_tokens") >= LEAST_TOKENS) & (F.col("n_tokens") < width)).select("n_tokens").distinct().collect()]
    widths = [width, *sorted(short)]
    # an item of fewer tokens than the width is one window
    whole = lambda w, size, place: (size >= width) if w == width else (size == w)
    anywhere = lambda w, size, place: np.ones(len(size), bool)
    theirs, _ = stored(items.mapInArrow(_rows_of(widths, least_words, whole, None), WINDOW), "item-windows")
    n = theirs.count()
    only = None
    if n <= broadcast_windows:
        hashes = np.unique(np.array([r.h for r in theirs.select("h").distinct().collect()], np.int64).view(np.uint64))
        shared = spark.sparkContext.broadcast(hashes)
        only = lambda: shared.value
    ours = _rows(docs, "doc_id").mapInArrow(_rows_of(widths, least_words, anywhere, only), WINDOW)
    if only is not None:
        ours, _ = stored(ours, "document-windows")
    i = theirs.select(F.col("id").alias("item_id"), F.col("k").alias("item_k"), F.col("place").alias("item_place"), "h", F.col("slots").alias("item_slots"))
    pairs = ours.join(F.broadcast(i) if only is not None else i, "h").select(F.col("id").alias("doc_id"), "k", "item_id", "item_k", "item_place", (F.col("place") - F.col("item_place")).alias("shift"), "slots", "item_slots")
    diagonals = _aligned(pairs)
    # diagonals that follow one another in document and item, no further apart than the item is long, are one match
    sizes = words.select(F.col("id").alias("item_id"), F.col("k").alias("item_k"), "n_tokens")
    diagonals = diagonals.join(F.broadcast(sizes) if only is not None else sizes, ["item_id", "item_k"])
    match = ["doc_id", "k", "item_id", "item_k"]
    order = Window.partitionBy(*match).orderBy("first", "shift")
    follows = (F.col("item_first") >= F.lag("item_last").over(order)) & (F.col("first") >= F.lag("last").over(order)) & (F.col("first") - F.lag("last").over(order) <= F.col("n_tokens"))
    runs = diagonals.withColumn("opens", F.when(F.coalesce(follows, F.lit(False)), 0).otherwise(1)).withColumn("run", F.sum("opens").over(order))
    found = runs.groupBy(*match, "run").agg(F.first("n_tokens").alias("n_tokens"), F.sum("matched").cast("int").alias("matched_words"), F.min("first").alias("first_word"), F.max("last").alias("last_word"), F.sum("n_slots").cast("int").alias("n_slots"), F.sum("n_changed").cast("int").alias("n_changed"))
    return found.where(F.col("matched_words") >= F.greatest(F.least(F.lit(width), F.col("n_tokens")), F.ceil(F.col("n_tokens") * share)))


def leaks(docs: DataFrame, benchmark: DataFrame, width: int = 8, least_words: int = 4, share: float = 0.5, broadcast_windows: int = 1_000_000) -> DataFrame:
    """Pairs of a document and a benchmark item whose template it holds: at least ``share`` of the item's tokens, aligned and consistent.

    One row a pair, that of the best match: ``doc_id``, ``item_id``, ``matched_words`` (tokens of the item), ``first_word``,
    ``last_word`` (tokens of the document), ``n_slots``, ``n_changed`` (slot values that differ). Items of fewer than
    ``width`` tokens match as a whole, those of fewer than ``LEAST_TOKENS``, null texts and null ids match nothing; rows that
    repeat an id with another text are looked at by themselves; other columns are ignored; empty tables give an empty result.
    """
    best = F.max(F.struct("matched_words", (-F.col("first_word")).alias("minus"), "first_word", "last_word", "n_slots", "n_changed")).alias("m")
    found = _leaks(docs, benchmark, width, least_words, share, broadcast_windows).groupBy("doc_id", "item_id").agg(best)
    return found.select("doc_id", "item_id", *(f"m.{c}" for c in ("matched_words", "first_word", "last_word", "n_slots", "n_changed")))


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = 8, least_words: int = 4, share: float = 0.5, broadcast_windows: int = 1_000_000) -> DataFrame:
    """``docs`` without those that hold a benchmark item; rows without a doc_id stay, as do rows of the same id with a clean text."""
    doc, key = unused(docs, "_doc", "_key")
    bad = settled(lambda: _leaks(docs, benchmark, width, least_words, share, broadcast_windows).select(F.col("doc_id").alias(doc), F.col("k").alias(key)).distinct(), "leaks")
    same = (F.col("doc_id").cast("long") == F.col(doc)) & (F.xxhash64(F.col("text").cast("string")) == F.col(key))
    return docs.join(bad, same, "left_anti").select(*docs.columns)
