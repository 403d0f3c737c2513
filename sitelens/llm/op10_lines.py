"""Fuzzy line de-duplication by MinHash, in DataFrame operations only.

Two lines are similar if the Jaccard similarity of their sets of character shingles, the ``SHORT`` characters at every
position, is ``similarity`` or more. Of each component of similar lines, found by distributed union-find, the first line by
(doc_id, text, position) stays.

Candidates come from signatures: the ``SKETCH`` least hashes of a line's windows in order, of which each two neighbours are a
band. Two lines whose windows have a Jaccard of J share a band with a chance of J² at each place of their common order:
97% at the least J that similar lines of edits far apart have (0.58), 99% and more where edits fall together. Windows are of
``LONG`` characters and begin at words, and at every character of runs longer than a word and of scripts that put no spaces
between words, so they follow the content past insertions; brief lines take the shingles themselves, and lines of lengths
within ``BRIEF`` both.

Lines that share a band are compared if they share four of ten signature values, as similar lines do (93% at that least J,
99% at usual ones). First each line meets the commonest line of its bands, which joins the variants of one line, however
many; after that only lines of different components meet. In bands of many lines, as of families on one template or around
one passage, lines first meet at the first line of their rarest windows and in small hands; of those still apart, every similar
pair is found (``_crowded``), by comparisons that grow with the square of the lines of a band that are still apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitelens.llm.common import remove, settled, stored, unused
from sitelens.llm.components import connected_components

LONG, SHORT, SKETCH = 12, 5, 10
#: Lines of no more characters than the second have a signature of shingles, those of no fewer than the first one of windows.
BRIEF = (45, 60)
#: Runs of more characters are longer than a word.
WORD = 12
#: From Thai on, without general punctuation and symbols: Chinese, Japanese, Korean, Khmer and so on.
UNSPACED = r"[\x{0E00}-\x{1FFF}\x{2E80}-\x{10FFFF}]"
#: Of larger bands not all lines meet one another.
SMALL_BAND = 32
#: So few candidate lines (of 24 bytes each) are broadcast to fetch their texts; more are joined by a shuffle.
BROADCAST_LINES = 1_000_000


def lines_of(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``k`` (a hash of the text: rows of one id with other texts are other documents), ``pos``, ``line``, ``h1``, ``h2`` of each line that isn't blank."""
    text = F.col("text").cast("string")
    own = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("k"), text.alias("text"))
    rows = own.select("doc_id", "k", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line")).where(F.col("line").rlike(r"\S"))
    return rows.withColumns({"h1": F.xxhash64("line"), "h2": F.xxhash64("line", F.lit(1))})


def windows(line: Column) -> Column:
    step = r"%s|\S{1,%d}+(?!\S)|\S" % (UNSPACED, WORD)
    return F.regexp_extract_all(line, F.lit(r"(?s)(?=(\S.{0,%d}))(?:%s)" % (LONG - 1, step)), F.lit(1))


def shingles(line: Column, hashed=F.xxhash64) -> Column:
    """Hashes of the characters from every position; a line of fewer is one shingle."""
    every = F.regexp_extract_all(line, F.lit(r"(?s)(?=(.{%d}))." % SHORT), F.lit(1))
    return F.array_distinct(F.transform(F.when(F.length(line) < SHORT, F.array(line)).otherwise(every), lambda w: hashed(w)))


def _least(hashes: Column) -> Column:
    # windows that repeat within a line are few: what is cut before they are told apart is enough
    return F.slice(F.array_distinct(F.slice(F.sort_array(hashes), 1, SKETCH + 6)), 1, SKETCH)


def signature(line: Column) -> dict[str, Column]:
    """``sw``, the least hashes of a line's windows (none where it is brief), and ``ss``, those of a brief line's shingles."""
    none = F.array().cast("array<long>")
    return {
        "sw": F.when(F.length(line) >= BRIEF[0], _least(F.transform(windows(line), lambda w: F.xxhash64(w)))).otherwise(none),
        "ss": F.when(F.length(line) <= BRIEF[1], _least(shingles(line))).otherwise(none),
    }


def _chain(v: Column, kind: int) -> Column:
    """Keys of each two neighbours of a signature; of one value, that one."""
    two = F.zip_with(F.slice(v, F.lit(1), F.greatest(F.size(v) - 1, F.lit(0))), F.slice(v, F.lit(2), F.greatest(F.size(v), F.lit(1))), lambda x, y: F.xxhash64(x, y, F.lit(kind)))
    return F.when(F.size(v) < 2, F.transform(v, lambda x: F.xxhash64(x, F.lit(kind)))).otherwise(two)


def _bands(distinct: DataFrame) -> DataFrame:
    """``band``, ``id``, ``size`` of the bands of several lines."""
    every = distinct.select("id", F.explode(F.concat(_chain(F.col("sw"), 0), _chain(F.col("ss"), 1))).alias("band")).repartition("band")
    common = every.groupBy("band").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.count(F.lit(1)).alias("size")).where("lo < hi").select("band", "size")
    return every.join(common.hint("shuffle_hash"), "band")


def _alike() -> Column:
    """Whether the lines ``a`` and ``b`` share enough of their signatures."""
    enough = lambda x, y, tenths: F.size(F.array_intersect(x, y)) * 10 >= F.least(F.size(x), F.size(y)) * tenths
    of_windows = (F.size("swa") > 0) & (F.size("swb") > 0)
    return F.when(of_windows, enough("swa", "swb", 4)).otherwise(enough("ssa", "ssb", 5))


def _pairs(small: DataFrame) -> DataFrame:
    """``a``, ``b`` of the lines of different components that share a band of few lines and enough of their signatures."""
    a, b = (small.select("band", *(F.col(c).alias(c + x) for c in ("id", "root", "sw", "ss"))) for x in "ab")
    return a.join(b, "band").where("ida < idb and roota != rootb").where(_alike()).select(F.col("ida").alias("a"), F.col("idb").alias("b"))


def _near(bands: DataFrame, ids: DataFrame) -> DataFrame:
    """``a``, ``b``: each line and the commonest line of its bands, if their signatures are alike."""
    best = bands.join(ids.select("id", "n"), "id").groupBy("band").agg(F.min(F.struct((-F.col("n")).alias("minus"), "id")).alias("first"))
    pairs = bands.join(best, "band").groupBy("id").agg(F.min("first").alias("first")).where("id != first.id").select(F.col("id").alias("b"), F.col("first.id").alias("a"))
    a, b = (ids.select(F.col("id").alias(x), F.col("sw").alias("sw" + x), F.col("ss").alias("ss" + x)) for x in "ab")
    return pairs.join(b, "b").join(a, "a").where(_alike()).select("a", "b")


def _similar(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Those of the pairs ``a``, ``b`` whose ``sets`` (``id``, ``s``) have that Jaccard similarity."""
    a, b = (sets.select(F.col("id").alias(x), F.col("s").alias("s" + x)) for x in "ab")
    na, nb, n = F.size("sa"), F.size("sb"), F.size(F.array_intersect("sa", "sb"))
    least = F.lit(similarity)
    both = pairs.join(a, "a").join(b, "b").where(F.least(na, nb) >= F.greatest(na, nb) * least - F.lit(1e-9))
    return both.withColumn("n", n).where(F.col("n") >= (na + nb - F.col("n")) * least - F.lit(1e-9)).select("a", "b")


def _verified(pairs: DataFrame, texts: tuple[DataFrame, str], similarity: float) -> DataFrame:
    """Those of the pairs ``a``, ``b`` that are similar; ``texts``, a table and its path, has ``id``, ``line`` and ``w``, the hashes of its windows. It is removed."""
    texts, path = texts

    def of(table: DataFrame, side: str) -> DataFrame:
        return table.select(*(F.col(c).alias(side if c == "id" else c + side) for c in table.columns))

    brief = texts.select("id", "w", (F.length("line") <= BRIEF[1]).alias("brief"))
    both = pairs.join(of(brief, "a"), "a").join(of(brief, "b"), "b")
    # similar lines share 0.43 of their windows at least: an edit in 45 characters takes three of the seven windows or so that begin there
    common = F.size(F.array_intersect("wa", "wb"))
    likely = F.col("briefa") | F.col("briefb") | (common * 3.5 >= F.size("wa") + F.size("wb"))
    likely, _ = stored((both.where(likely) if similarity >= 0.8 else both).select("a", "b"), "line-likely")
    # a line's shingles are made once, however many lines it is compared with
    sets = texts.join(likely.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "id").select("id", shingles(F.col("line"), F.hash).alias("s"))
    sets, _ = stored(sets, "line-sets")
    remove(sets.sparkSession, path)
    return _similar(likely, sets, similarity)


def _rooted(lines: DataFrame, edges: DataFrame) -> DataFrame:
    """``lines`` with ``root``, the component's least id (its own without links)."""
    roots = connected_components(edges).withColumnRenamed("node", "id")
    return lines.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))


def _mixed(placed: DataFrame, key: str) -> DataFrame:
    """The rows whose ``key`` has lines of different roots."""
    apart = placed.groupBy(key).agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select(key)
    return placed.join(apart, key)


#: Of windows that many lines of large bands share, so many of the rarest lead a line to another one.
LEADS = 3
#: Shingles are counted in so many buckets, to tell rare ones from frequent ones.
BUCKETS = 1 << 16
#: Lines of bands of no more lines all meet by their marks; those of larger ones by rare shingles. Lines meet in blocks of so many, and first in hands of so many.
WHOLE, BLOCK, HAND = 1 << 15, 1 << 11, 16


def _leads(texts: DataFrame) -> DataFrame:
    """``a``, ``b``: the lines of large bands (``id``, ``w``), each with the first line of its rarest windows. They join most of a large family; ``_crowded`` compares what they leave."""
    tokens, _ = stored(texts.select("id", F.explode("w").alias("token")), "line-windows")
    counts = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("often"), F.min("id").alias("first")).where("often > 1")
    place = F.row_number().over(Window.partitionBy("id").orderBy("often", "token"))
    leads = tokens.join(counts, "token").withColumn("place", place).where((F.col("place") <= LEADS) & (F.col("id") != F.col("first")))
    return leads.select(F.col("first").alias("a"), F.col("id").alias("b")).distinct()


def _ordered(lines: DataFrame, similarity: float) -> DataFrame:
    """``id`` and ``p`` of lines: of the shingles ``s``, the rarest first, those that a similar line can't all lack."""
    bucket = lambda x: F.pmod(x, F.lit(BUCKETS))
    often = lines.select(F.explode("s").alias("x")).groupBy(bucket(F.col("x")).cast("long").alias("id")).agg(F.count(F.lit(1)).alias("often"))
    level = F.least(F.lit(127.0), F.log2(F.coalesce("often", F.lit(1))) * 6).cast("tinyint").alias("level")
    levels = lines.sparkSession.range(BUCKETS).join(often, "id", "left").agg(F.transform(F.array_sort(F.collect_list(F.struct("id", level))), lambda x: x["level"]).alias("levels"))
    key = lambda x: F.shiftleft(F.get("levels", bucket(x)).cast("long"), 32).bitwiseOR(x.cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))
    n = F.size("s")
    keys = F.slice(F.sort_array(F.transform("s", key)), F.lit(1), (n - F.ceil(n * similarity - F.lit(1e-9)) + 1).cast("int"))
    return lines.crossJoin(F.broadcast(levels)).select("id", keys.alias("p"))


def _marks(sets: DataFrame) -> DataFrame:
    """``id``, ``n`` and ``m0`` to ``m7`` of sets of shingles (``id``, ``s``): their size, and for each of 512 buckets whether an odd number of them is in it.

    Marks of two sets differ in no more buckets than the sets in shingles.
    """
    rows = sets.select("id", F.explode("s").alias("x"))
    bit = F.expr("shiftleft(1L, x & 63)")
    return rows.groupBy("id").agg(F.count(F.lit(1)).cast("int").alias("n"), *(F.bit_xor(F.when(F.expr(f"(shiftrightunsigned(x, 6) & 7) = {k}"), bit).otherwise(F.lit(0).cast("long"))).alias(f"m{k}") for k in range(8)))


def _meet(rows: DataFrame, marks: DataFrame, similarity: float) -> DataFrame:
    """``a``, ``b``: lines of different ``root`` of the same ``key`` (of ``size`` lines) that can be similar by their sizes and marks.

    A key's lines are dealt into blocks, and each two blocks meet in a place of their own. The join makes no row of lines that these tell apart.
    """
    own = rows.join(marks, "id").withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int")).withColumn("block", F.pmod(F.xxhash64("id"), "blocks").cast("int"))
    held = ["key", "i", "j", "id", "root", "n", *(f"m{k}" for k in range(8))]
    x = own.withColumn("i", F.col("block")).withColumn("j", F.explode(F.sequence("block", F.col("blocks") - 1)))
    y = own.withColumn("j", F.col("block")).withColumn("i", F.explode(F.sequence(F.lit(0), "block")))
    x, y = (v.select(*(F.col(c).alias(c if c in ("key", "i", "j") else c + side) for c in held)) for v, side in ((x, "x"), (y, "y")))
    both = F.col("nx") + F.col("ny")
    differ = sum((F.bit_count(F.col(f"m{k}x").bitwiseXOR(F.col(f"m{k}y"))) for k in range(1, 8)), F.bit_count(F.col("m0x").bitwiseXOR(F.col("m0y"))))
    # sizes first: they are the cheaper ones to compare
    sizes = F.least("nx", "ny") >= F.greatest("nx", "ny") * similarity - F.lit(1e-9)
    near = differ <= both * ((1 - similarity) / (1 + similarity)) + F.lit(1e-9)
    met = x.hint("merge").join(y, ["key", "i", "j"]).where((F.col("rootx") != F.col("rooty")) & sizes & ((F.col("i") < F.col("j")) | (F.col("idx") < F.col("idy"))) & near)
    return met.select(F.least("idx", "idy").alias("a"), F.greatest("idx", "idy").alias("b"))


def _sets(texts: DataFrame) -> DataFrame:
    return texts.select("id", shingles(F.col("line"), F.hash).alias("s"))


def _dealt(bands: DataFrame) -> DataFrame:
    """``bands`` twice dealt at random into bands of ``HAND`` lines or so. What is similar there joins most of a family before all its lines meet."""
    sized = bands.join(bands.groupBy("band").agg(F.ceil(F.count(F.lit(1)) / HAND).alias("hands")), "band")
    hand = lambda deal: F.xxhash64("band", deal, F.pmod(F.xxhash64("id", "band", deal), "hands"))
    return sized.withColumn("deal", F.explode(F.expr("array(0, 1)"))).select(hand(F.col("deal")).alias("band"), "id", "root")


def _crowded(bands: DataFrame, texts: DataFrame, similarity: float, marks: DataFrame | None = None) -> DataFrame:
    """``a``, ``b``: the similar lines of different components (``root``) in the large ``bands`` (``band``, ``id``, ``root``), all of them.

    Lines of a band meet one another by their marks, which lose no pair. In bands of more than ``WHOLE`` lines, those meet that
    share one of the rarest shingles of each (a prefix filter, which loses no pair either). There is no limit to either.
    Candidates are then compared by the sets of shingles of ``texts`` (``id``, ``line``).
    """
    sized, _ = stored(bands.join(bands.groupBy("band").agg(F.count(F.lit(1)).alias("size")), "band"), "line-sized")
    if marks is None:
        marks, _ = stored(_marks(_sets(bands.select("id").distinct().join(texts, "id"))), "line-marks")
    wide = sized.where(F.col("size") > WHOLE)
    pairs = _meet(sized.where(F.col("size") <= WHOLE).select(F.col("band").alias("key"), "id", "root", "size"), marks, similarity)
    if not wide.isEmpty():
        pairs = pairs.union(_meet(_rare(wide.select("band", "id", "root"), _sets(texts), similarity), marks, similarity))
    pairs, _ = stored(pairs.distinct(), "line-pairs")
    found = texts.join(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "id")
    return _similar(pairs, stored(_sets(found), "line-sets")[0], similarity)


def _rare(bands: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """``key``, ``id``, ``root``, ``size``: the lines of ``bands`` (``band``, ``id``, ``root``) by band and each of their rarest shingles, where lines of different roots have it."""
    lines, _ = stored(sets.join(bands.select("id").distinct(), "id"), "line-sets")
    ordered = _ordered(lines, similarity)
    rows = ordered.select("id", F.explode("p").alias("token")).join(bands, "id").select(F.xxhash64("band", "token").alias("key"), "id", "root").distinct()
    rows, _ = stored(rows, "line-rare")
    apart = rows.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("key", "size")
    return rows.join(apart, "key")


def _texts(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``id``, ``line``, ``w`` of ``ids`` (``id``, ``at``), taken from the first place of each."""
    places = ids.groupBy(F.col("at.doc_id").alias("_id"), F.col("at.k").alias("_k")).agg(F.collect_list(F.struct("at.pos", "id")).alias("_places"))
    own = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    small = ids.count() <= BROADCAST_LINES
    held = own.join(F.broadcast(places) if small else places, (F.col("doc_id") == F.col("_id")) & (F.xxhash64("text") == F.col("_k")))
    # equal rows hold a place more than once
    lines = held.select("_places", F.split("text", "\n", -1).alias("_lines")).select(F.explode(F.transform("_places", lambda p: F.struct(p["id"].alias("id"), F.get("_lines", p["pos"]).alias("line")))).alias("x"))
    made = F.array_distinct(F.transform(windows(F.col("line")), lambda w: F.hash(w)))
    return lines.select("x.*").dropDuplicates(["id"]).withColumn("w", made)


def fuzzy_links(docs: DataFrame, shared: DataFrame, ids: DataFrame, similarity: float = 0.8) -> DataFrame:
    """Links ``a``, ``b`` that join the similar ones of the lines ``ids`` (``id``, ``n``, ``at``, ``sw``, ``ss``) of the bands ``shared``."""
    near, _ = stored(_near(shared.select("band", "id"), ids), "line-near")
    of = lambda pairs: ids.join(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "id")
    links = settled(lambda: _verified(near, stored(_texts(docs, of(near)), "line-texts"), similarity), "line-links")

    # what is left: bands with lines of different components
    left, _ = stored(_mixed(_rooted(shared, links), "band").join(ids.select("id", "sw", "ss"), "id"), "line-left")
    small = left.where(F.col("size") <= SMALL_BAND)
    pairs, _ = stored(_pairs(small).distinct(), "line-pairs")
    crowd, _ = stored(left.where(F.col("size") > SMALL_BAND).select("id", "root", "sw", "ss").dropDuplicates(["id"]), "line-crowd")
    texts, path = stored(_texts(docs, ids.join(pairs.select(F.explode(F.array("a", "b")).alias("id")).union(crowd.select("id")).distinct(), "id")), "line-texts")
    a, b = (crowd.select(*(F.col(c).alias(c + x if c != "id" else x) for c in ("id", "root", "sw", "ss"))) for x in "ab")
    leads = _leads(texts.join(crowd.select("id"), "id")).join(a, "a").join(b, "b").where("roota != rootb").where(_alike()).select("a", "b")
    of_crowd, _ = stored(texts.join(crowd.select("id"), "id").select("id", "line"), "line-crowd-texts")
    links = links.union(settled(lambda: _verified(pairs.union(leads).distinct(), (texts, path), similarity), "line-links"))

    # large bands that still have lines of different components: every pair of these that is similar
    large = left.where(F.col("size") > SMALL_BAND).select("band", "id")
    apart = lambda: stored(_mixed(_rooted(large, links), "band"), "line-open")[0]
    bands = apart()
    marks, _ = stored(_marks(_sets(bands.select("id").distinct().join(of_crowd, "id"))), "line-marks")
    links = links.union(settled(lambda: _crowded(_dealt(bands), of_crowd, similarity, marks), "line-links"))
    return links.union(settled(lambda: _crowded(apart(), of_crowd, similarity, marks), "line-links"))


def line_groups(docs: DataFrame, similarity: float = 0.8) -> DataFrame:
    """``h1``, ``h2``, ``first``: the first line (``doc_id``, ``k``, ``pos``) of the group of each line that occurs more than once or is similar to another one."""
    made = signature(F.col("line"))
    signed = lines_of(docs).select("h1", "h2", F.struct("doc_id", "k", "pos").alias("at"), *(c.alias(n) for n, c in made.items()))
    distinct = signed.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("at"), *(F.first(n).alias(n) for n in made))
    distinct, path = stored(distinct.withColumn("id", F.monotonically_increasing_id()), "lines")
    shared, _ = stored(_bands(distinct), "bands")
    ids, _ = stored(shared.select("id").distinct().join(distinct, "id"), "line-candidates")
    # lines that only repeat, whose first place is known; of the others nothing is read again
    alone, _ = stored(distinct.where("n > 1").join(ids, "id", "left_anti").select("h1", "h2", F.col("at").alias("first")), "line-repeated")
    remove(docs.sparkSession, path)
    links = settled(lambda: fuzzy_links(docs, shared, ids.select("id", "n", "at", "sw", "ss"), similarity).distinct(), "line-edges")
    roots, _ = stored(connected_components(links).withColumnRenamed("node", "id"), "line-roots")
    repeated = alone.union(ids.where("n > 1").join(roots, "id", "left_anti").select("h1", "h2", F.col("at").alias("first")))
    members = ids.select("id", "h1", "h2", "at").join(roots, "id")
    first = members.groupBy("root").agg(F.min("at").alias("first"))
    return repeated.unionByName(members.join(stored(first, "line-first")[0], "root").select("h1", "h2", "first"))


def removed_lines(docs: DataFrame, similarity: float = 0.8) -> DataFrame:
    """``doc_id``, ``k`` and ``pos`` of every line but the first of its group."""
    groups = settled(lambda: line_groups(docs, similarity), "line-groups")
    found = lines_of(docs).drop("line").join(groups, ["h1", "h2"])
    return found.where(F.struct("doc_id", "k", "pos") != F.col("first")).select("doc_id", "k", "pos")


def line_report(docs: DataFrame, similarity: float = 0.8) -> DataFrame:
    """One row for each document: ``doc_id``, ``n_lines`` (not blank), ``n_removed``, ``removed`` (their positions, from 0).

    Blank lines are in no group and always stay. Null and empty texts have no lines; rows without an id give a row without
    removals; rows that repeat an id and text are one document, whose rows have their removals in common, and rows that
    repeat an id with another text are other documents; other columns are ignored; an empty table gives an empty one.
    """
    groups = settled(lambda: line_groups(docs, similarity), "line-groups")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("k"), F.posexplode(F.split(text, "\n", -1)).alias("pos", "line"))
    full = F.col("line").rlike(r"\S")
    rows = rows.withColumns({"full": full, "h1": F.when(full & F.col("doc_id").isNotNull(), F.xxhash64("line")), "h2": F.xxhash64("line", F.lit(1))}).drop("line")
    gone = F.struct("doc_id", "k", "pos") != F.col("first")
    # a document's lines are in one task, so that these sums leave it as one row
    found = rows.join(groups, ["h1", "h2"], "left").groupBy("doc_id", "k").agg(F.count_if("full").alias("n"), F.count_if(F.col("pos") == 0).alias("copies"), F.sort_array(F.collect_set(F.when(gone, F.col("pos")))).alias("gone"))
    out = found.select("doc_id", F.expr("n div copies").alias("n_lines"), F.size("gone").cast("long").alias("n_removed"), F.array_join(F.transform("gone", lambda x: x.cast("string")), " ").alias("removed"), F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int"))))
    return out.drop("col")


def dedup_lines(docs: DataFrame, similarity: float = 0.8, drop_empty: bool = True) -> DataFrame:
    """``docs`` with the removed lines cut from ``text``; nulls, repeats and so on as in ``line_report``.

    With ``drop_empty``, documents of which no line is left go: all they held is held elsewhere. Others keep their row.
    """
    doc, key, places = unused(docs, "_doc", "_key", "_gone")
    gone = settled(lambda: removed_lines(docs, similarity).groupBy(F.col("doc_id").alias(doc), F.col("k").alias(key)).agg(F.collect_set("pos").alias(places)), "line-gone")
    same = (F.col("doc_id").cast("long") == F.col(doc)) & (F.xxhash64(F.col("text").cast("string")) == F.col(key))
    kept = F.array_join(F.filter(F.split(F.col("text").cast("string"), "\n", -1), lambda x, i: ~F.array_contains(places, i)), "\n")
    out = docs.join(gone, same, "left").withColumn("text", F.when(F.col(places).isNull(), F.col("text")).otherwise(kept))
    if drop_empty:
        out = out.where(F.col(places).isNull() | F.col("text").rlike(r"\S"))
    return out.select(*docs.columns)
