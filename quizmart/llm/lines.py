"""Operator 3, line deduplication by a segment-partition edit join. DataFrame functions only.

Equal lines of any length are duplicates. Two lines are near duplicates if at most TAU edits turn one
into the other, and of shorter lines fewer: as many as the shorter has shares of MIN_CHARS / TAU code
points. A line is cut into
TAU + 1 segments; a line within TAU edits must contain one of them unchanged, at a place that the
lengths of both narrow down. Segments are indexed by (length, segment number, content); every line
probes the index with the substrings that its length allows. A first pass over hashes only finds the
lines that share a segment with another line; the rest works on these. They carry a sketch, the
parities of the counts of their pairs of neighbouring characters in 2 * 64 classes: an edit turns four at most,
so lines whose sketches differ in more places never become a pair. What meets is verified by a banded
edit distance.

Segments that many lines share would make all pairs of them meet. Lines with such a segment meet
there only if they also have the same characters in four of 2 TAU + 4 classes of characters, which
lines within TAU edits always have.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint_root

TAU = 2
#: Length (in code points, without white space at the ends) from which TAU edits are allowed: 1 edit from
#: 16 on, 2 from 32 on; shorter lines are compared for equality.
MIN_CHARS = 32
#: Lines that share a segment with more lines than this meet by their characters, too.
COMMON = 32
#: Words of 64 classes in a sketch.
SKETCH = 2
#: Groups of characters that are counted before two lines are compared in full.
GROUPS = ("e", "a", "n", "o", "t", "i", "r", "sdl", "hcu", "mgpb", " .,;")


def lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 1) -> DataFrame:
    """(doc, t, place, line, n, h): the lines of at least ``min_chars`` code points, without white space at their ends, their
    lengths and an even 64-bit hash of each; t is a hash of the whole text. A null text has no lines."""
    cut = docs.select(F.col(id_col).alias("doc"), F.xxhash64(F.col(text_col).cast("string")).alias("t"), F.posexplode(F.split(F.col(text_col).cast("string"), "\n")).alias("place", "raw"))
    cut = cut.select("doc", "t", "place", F.btrim("raw", F.lit(" \t\r\v\f")).alias("line"))
    cut = cut.withColumn("n", F.length("line")).where(F.col("n") >= min_chars)
    return cut.withColumn("h", F.xxhash64("line").bitwiseAND(F.lit(-2).cast("long")))


def _probes(tau: int, delta: int) -> list[tuple[int, int]]:
    """(segment, shift) of the substrings of a line that can be segments of one ``delta`` shorter."""
    return [(i, s) for i in range(tau + 1) for s in range(max(-i, delta - (tau - i)), min(i, delta + (tau - i)) + 1)]


def _meets(texts: DataFrame, spans: list[tuple[int, int, int | None]], *carried: str) -> DataFrame:
    """(key, id, carried columns) for every probe of the lines (h, line, n): id is h, its lowest bit set if the
    probe is a segment of the line itself, an index entry. ``spans``: (edits, first, last length) that
    the lines are compared by; one without last length is open.

    A line of n characters has edits + 1 segments of n // (edits + 1) characters, the last n % (edits + 1)
    of them one longer; it is probed against lines that are 0 to ``edits`` characters shorter.
    """
    def table(tau: int) -> Column:
        return F.array(*[F.struct(F.lit(tau + 1).alias("parts"), F.lit(d).alias("delta"), F.lit(i).alias("i"), F.lit(s).alias("shift")) for d in range(tau + 1) for i, s in _probes(tau, d)])

    within_span = [(F.col("n") >= first) & (F.lit(True) if last is None else F.col("n") <= last) for _, first, last in spans]
    tables = [F.when(inside, table(tau)).otherwise(F.slice(table(tau), 1, 0)) for inside, (tau, _, _) in zip(within_span, spans, strict=True)]
    out = texts.withColumn("p", F.explode(F.concat(*tables))).select("h", "line", "n", "p.*", *carried)
    rest = F.col("target") % F.col("parts")
    out = out.withColumn("target", F.col("n") - F.col("delta")).withColumn("over", F.col("parts") - rest)
    out = out.withColumn("size", ((F.col("target") - rest) / F.col("parts")).cast("int"))
    out = out.withColumn("at", 1 + F.col("i") * F.col("size") + F.greatest(F.lit(0), F.col("i") - F.col("over")) + F.col("shift"))
    out = out.withColumn("size", F.col("size") + (F.col("i") >= F.col("over")).cast("int"))
    out = out.where("target >= 1 AND at >= 1 AND at + size - 1 <= n")
    key = F.xxhash64("parts", "target", "i", F.substr("line", F.col("at"), F.col("size")))
    return out.select(key.alias("key"), (F.col("h") + ((F.col("delta") == 0) & (F.col("shift") == 0)).cast("long")).alias("id"), *carried)


def _sketch(line: str) -> Column:
    """Parities of the numbers of pairs of neighbouring characters (the last one's is the end) in each of
    64 * ``SKETCH`` classes, as bits of w0, w1..."""
    def turned(s: Column, pair: Column) -> Column:
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), pair.bitwiseAND(F.lit(63)).cast("int"))
        word = F.pmod(F.shiftright(pair, 6), F.lit(SKETCH))
        return F.struct(*[F.when(word == w, s[f"w{w}"].bitwiseXOR(bit)).otherwise(s[f"w{w}"]).alias(f"w{w}") for w in range(SKETCH)])

    pairs = bound(F.split(F.col(line), ""), lambda c: F.zip_with(c, F.slice(c, 2, F.size(c)), lambda x, y: F.xxhash64(x, y)))
    return F.aggregate(pairs, F.struct(*[F.lit(0).cast("long").alias(f"w{w}") for w in range(SKETCH)]), turned)


def _alike(a: Column, b: Column, tau: int) -> Column:
    """Whether two sketches differ in no more places than ``tau`` edits can turn: an edit takes away two
    pairs at most and brings in two."""
    return sum((F.bit_count(a[f"w{w}"].bitwiseXOR(b[f"w{w}"])) for w in range(SKETCH)), F.lit(0)) <= 4 * tau


def within(a: Column, b: Column, tau: int) -> Column:
    """Whether at most ``tau`` edits turn string ``a`` into ``b``: Spark's edit distance of a band of ``tau`` diagonals
    to either side (-1 beyond)."""
    return F.levenshtein(a, b, tau) >= 0


def _unlike(a: str, b: str) -> Column:
    """A lower bound of twice the edits between two strings, by counting the characters of ``GROUPS``: an
    edit changes the counts of at most two groups, each by one."""
    def count(x: str, group: str) -> Column:
        return F.length(x) - F.length(F.translate(F.col(x), group, ""))

    return sum((F.abs(count(a, g) - count(b, g)) for g in GROUPS), F.lit(0))


def bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once: a transform of one element binds it."""
    return F.transform(F.array(value), use)[0]


def _suspects(texts: DataFrame, spans: list[tuple[int, int, int | None]]) -> DataFrame:
    """(h, line, n, sketch) of the lines (h, line, n) that share a segment at a fitting place with another line."""
    w = Window.partitionBy("key")
    met = _meets(texts, spans).withColumns({"low": F.min("id").over(w), "high": F.max("id").over(w), "owned": F.bit_or("id").over(w)})
    met = met.where((F.col("owned").bitwiseAND(F.lit(1)) == 1) & (F.shiftright("low", 1) != F.shiftright("high", 1)))
    met = met.select(F.col("id").bitwiseAND(F.lit(-2).cast("long")).alias("h")).distinct()
    return texts.join(met.hint("shuffle_hash"), "h").withColumn("sketch", _sketch("line")).checkpoint()


def _met(entries: DataFrame, common: int) -> DataFrame:
    """Entries (key, id, sketch; the lowest bit of id tells index entries) with ``owners``: the index entries'
    lines of their key and their sketches, or its first ``common`` + 1 if it has more."""
    ranked = Window.partitionBy("key").orderBy(F.col("id").bitwiseAND(F.lit(1)).desc(), "id")
    whole = ranked.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    own = F.col("id").bitwiseAND(F.lit(1)) == 1
    met = entries.withColumn("rank", F.row_number().over(ranked))
    met = met.withColumn("owners", F.collect_list(F.when(own & (F.col("rank") <= common + 1), F.struct((F.col("id") - 1).alias("x"), "sketch"))).over(whole))
    return met.select(F.col("id").bitwiseAND(F.lit(-2).cast("long")).alias("h"), "sketch", "owners").where(F.size("owners") > 0)


def _pairs(met: DataFrame, tau: int) -> DataFrame:
    """Pairs (a, b), a < b, of an entry and the index entries of its key whose sketches are alike."""
    alike = F.filter("owners", lambda o: (o["x"] != F.col("h")) & _alike(o["sketch"], F.col("sketch"), tau))
    met = met.select("h", F.explode(alike).alias("o")).select("h", F.col("o.x").alias("x"))
    return met.select(F.least("x", "h").alias("a"), F.greatest("x", "h").alias("b"))


def candidates(texts: DataFrame, tau: int = TAU, common: int = COMMON) -> DataFrame:
    """Pairs (a, b), a < b, of hashes of lines (h, line, n, sketch) that share a segment at fitting places and have
    sketches that ``tau`` edits can make equal."""
    met = _met(_meets(texts, [(tau, 0, None)], "sketch"), common)
    near = _pairs(met.where(F.size("owners") <= common), tau)
    many = met.where(F.size("owners") > common).select("h").distinct()
    hot = _class_keys(texts.join(many.hint("shuffle_hash"), "h"), tau)
    far = hot.select("key", "c", F.col("h").alias("x"), F.col("sums").alias("s"), F.col("sketch").alias("u")).join(
        hot.select("key", F.col("h").alias("y"), F.col("sums").alias("t"), F.col("sketch").alias("v")), "key")
    # a pair that agrees in more than four classes shares several keys; it meets in the first four
    same = F.filter(F.sequence(F.lit(0), F.lit(2 * tau + 3)), lambda k: F.get("s", k) == F.get("t", k))
    far = far.where((F.col("x") < F.col("y")) & _alike(F.col("u"), F.col("v"), tau) & (F.slice(same, 1, 4) == F.array(*[F.col(f"c.c{k}") for k in range(4)])))
    return near.unionByName(far.select(F.col("x").alias("a"), F.col("y").alias("b"))).distinct()


def _class_keys(texts: DataFrame, tau: int) -> DataFrame:
    """(h, sketch, sums, c, key) of lines with common segments. Characters fall into 2 tau + 4 classes by hash. An edit
    changes the characters of at most two classes, so lines within tau edits have the same
    characters, counted, in four classes at least: a key for every four."""
    n = 2 * tau + 4
    # a hash of the sorted characters of each class
    sums = bound(F.split("line", ""), lambda chars: F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda g: F.xxhash64(F.array_join(F.array_sort(F.filter(chars, lambda c: F.pmod(F.xxhash64(c), F.lit(n)) == g)), ""))))
    fours = F.array(*[F.struct(*[F.lit(x).alias(f"c{k}") for k, x in enumerate(c)]) for c in combinations(range(n), 4)])
    rows = texts.select("h", "sketch", sums.alias("sums")).select("h", "sketch", "sums", F.explode(fours).alias("c"))
    return rows.select("h", "sketch", "sums", "c", F.xxhash64("c", *[F.get("sums", F.col(f"c.c{k}")) for k in range(4)]).alias("key"))


def _distinct(found: DataFrame) -> DataFrame:
    """(h, line, n) of the different lines."""
    texts = found.groupBy("h").agg(F.first("line").alias("line"))
    return texts.withColumn("n", F.length("line"))  # after the exchange, which all uses then share


def _linked(texts: DataFrame, tau: int, common: int) -> DataFrame:
    """Pairs (a, b), a < b, of hashes of lines (h, line, n, sketch) within ``tau`` edits, with their lengths. The
    pairs are far fewer than the lines: they are hashed, the lines need no sort."""
    met = candidates(texts, tau, common).hint("shuffle_hash")
    met = met.join(texts.select(F.col("h").alias("a"), F.col("line").alias("x"), F.col("n").alias("nx")), "a").hint("shuffle_hash").join(texts.select(F.col("h").alias("b"), F.col("line").alias("y"), F.col("n").alias("ny")), "b")
    return met.where(F.abs(F.col("nx") - F.col("ny")) <= tau).where(_unlike("x", "y") <= 2 * tau).where(within(F.col("x"), F.col("y"), tau)).select("a", "b", "nx", "ny")


def links(found: DataFrame, tau: int = TAU, common: int = COMMON) -> DataFrame:
    """Pairs (a, b), a < b, of hashes of different lines (column line, h) within ``tau`` edits."""
    checkpoint_root(found.sparkSession)
    return _linked(_suspects(_distinct(found), [(tau, 0, None)]), tau, common).select("a", "b")


def near_links(found: DataFrame, tau: int = TAU, min_chars: int = MIN_CHARS, common: int = COMMON) -> DataFrame:
    """Pairs (a, b), a < b, of hashes of different lines within the edits that the shorter one allows:
    e from min_chars * e / tau code points on, ``tau`` at most."""
    checkpoint_root(found.sparkSession)
    spans: list[tuple[int, int, int | None]] = [(tau, min_chars, None)]
    for edits in range(1, tau):
        first, end = (max(edits + 1, -(-min_chars * e // tau)) for e in (edits, edits + 1))
        if first < min(end, min_chars):
            spans.append((edits, first, end - 1 + edits))
    texts = _suspects(_distinct(found.where(F.col("n") >= min(first for _, first, _ in spans))), spans)
    out = None
    for edits, first, last in spans:
        # of two lines of a span the shorter one decides: longer ones belong to the next span
        met = _linked(texts.where(F.col("n") >= first if last is None else F.col("n").between(first, last)), edits, common)
        met = met.where(F.least("nx", "ny") <= last - edits if last is not None else F.lit(True)).select("a", "b")
        out = met if out is None else out.unionByName(met)
    return out


def line_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tau: int = TAU, min_chars: int = MIN_CHARS, common: int = COMMON) -> DataFrame:
    """One row per distinct line: h, doc and place of its first occurrence (by document id, then
    line number), n_lines (occurrences), n_links (other lines within the edits allowed) and
    removed: an earlier line is within them."""
    checkpoint_root(docs.sparkSession)
    found = lines(docs, id_col, text_col)
    classes = found.groupBy("h").agg(F.min(F.struct("doc", "place")).alias("first"), F.count("*").alias("n_lines")).checkpoint()
    linked = near_links(found, tau, min_chars, common)
    linked = linked.unionByName(linked.select(F.col("b").alias("a"), F.col("a").alias("b"))).checkpoint()
    other = classes.select(F.col("h").alias("b"), F.col("first").alias("other"))
    earlier = linked.join(other, "b").groupBy(F.col("a").alias("h")).agg(F.count("*").alias("n_links"), F.min("other").alias("other"))
    return classes.join(earlier, "h", "left").select("h", "first", "n_lines", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce(F.col("other") < F.col("first"), F.lit(False)).alias("removed"))


def duplicate_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tau: int = TAU, min_chars: int = MIN_CHARS, common: int = COMMON) -> DataFrame:
    """One row per line of the documents that is not blank: ``id_col``, line (number from 0), class_doc and
    class_line (first occurrence of the same line), n_links (other lines within the edits that the
    shorter allows: ``tau`` from ``min_chars`` code points on, fewer below) and removed (the same or a linked line occurs earlier).

    Null and empty texts have no lines; blank lines part paragraphs and have no row; a null id sorts first. Rows that share an id share its places: a line at the same place of
    several of them is one occurrence. Other columns are ignored.
    """
    return _occurrences(docs, id_col, text_col, tau, min_chars, common).withColumnsRenamed({"doc": id_col, "place": "line"}).drop("t")


def _occurrences(docs: DataFrame, id_col: str, text_col: str, tau: int, min_chars: int, common: int) -> DataFrame:
    classes = line_classes(docs, id_col, text_col, tau, min_chars, common)
    found = lines(docs, id_col, text_col).select("doc", "t", "place", "h").join(classes, "h")
    here = F.struct("doc", "place")
    return found.select("doc", "t", "place", F.col("first.doc").alias("class_doc"), F.col("first.place").alias("class_line"), "n_links", (F.col("removed") | (here != F.col("first"))).alias("removed"))


def drop_duplicate_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tau: int = TAU, min_chars: int = MIN_CHARS, common: int = COMMON) -> DataFrame:
    """``docs`` with the removed lines cut out of the texts; all rows and columns stay. A text that
    keeps no line is empty."""
    gone = _occurrences(docs, id_col, text_col, tau, min_chars, common).where("removed")
    gone = gone.groupBy(F.col("doc").alias("__id"), F.col("t").alias("__t")).agg(F.collect_set("place").alias("__gone"))
    text = F.split(F.col(text_col), "\n")
    kept = F.array_join(F.filter(text, lambda x, i: ~F.array_contains(F.col("__gone"), i)), "\n")
    same = docs[id_col].eqNullSafe(gone["__id"]) & (F.xxhash64(docs[text_col].cast("string")) == gone["__t"])
    joined = docs.join(gone, same, "left")
    return joined.withColumn(text_col, F.when(F.col("__gone").isNull(), F.col(text_col)).otherwise(kept)).select(*docs.columns)
