"""Near-duplicate lines by an exact set-similarity join, in DataFrame functions alone.

A line's set is its distinct lower-cased words.  A line is removed if an earlier
line (by ``doc_id``, then line number, as the input has them) has a set of
Jaccard similarity ``SIMILAR`` percent or more; an exact repeat of a set at any
length is one.  Lines without words stay.

Each line's words are hashed once, into a table of sorted word hashes that all
later steps read.  Words are ordered by rarity: by the number of lines of their
hash bucket, then by hash.  The bucket counts are a table of at most ``BUCKETS``
numbers, which makes the order global without a join.  Two similar sets share
a word within their first ``n - ceil(t n) + 1``.  Lines of one set are first reduced
to the earliest; sets of under ``LEAST`` words are similar to none but themselves,
and the prefixes of the others are joined:

1. words with over ``FEW`` lines: their lines are taken in parts of bounded size, in
   the order of the input, and compared with the part's earliest and with the
   ``NEAR`` lines before them, which settles most of a large group of near copies;
2. all words: lines are compared with each other, but for those of which both are
   already removed, by a join of the table with itself whose skewed words Spark
   may split.

Only pairs that pass length, positional and parity filters are verified, by
their full word hashes.  Joins are equi-joins on a rare word, which Spark may
split; aggregates combine before they shuffle.

Cases: a null or empty text has no lines to lose; rows of null ``doc_id`` neither
remove nor lose lines; rows of one ``doc_id`` don't remove each other's line of
the same number; repeated rows therefore lose nothing to each other; an empty
table gives no rows; other columns pass through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import among, cut, dense

SIMILAR = 90
#: The least words of a set that can be similar to another one.
LEAST = 100 // (100 - SIMILAR) - 1
BUCKETS, FEW, NEAR = 1 << 20, 64, 6


_SEPARATORS = "\t\x0b\x0c\r"


def _one_kind(low: Column) -> Column:
    """The separators other than line ends as spaces; most texts have none and aren't rewritten."""
    some = F.contains(low, F.lit("\t")) | F.contains(low, F.lit("\r")) | F.contains(low, F.lit("\x0b")) | F.contains(low, F.lit("\x0c"))
    return F.when(some, F.translate(low, _SEPARATORS, " " * len(_SEPARATORS))).otherwise(low)


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def _word_hashes(line: Column) -> Column:
    """The distinct words of a lower-case line with spaces alone, as hashes, ascending."""
    return F.sort_array(F.array_distinct(F.transform(F.array_remove(F.split(line, " "), ""), lambda w: F.xxhash64(w))))


def _hashes(line: Column) -> Column:
    """The distinct words of a line as hashes, ascending."""
    return _word_hashes(_one_kind(F.lower(line)))


def _parity(words: Column) -> Column:
    """A long whose bits say of each of 64 hash classes whether an odd number of words is in it."""
    return F.aggregate(words, F.lit(0).cast("long"), lambda a, k: a.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), k.bitwiseAND(F.lit(63)).cast("int"))))


def _rarity(lines: DataFrame) -> tuple[Column, int]:
    """For each hash bucket the class of its count over all lines, four classes for each doubling; and the number of buckets."""
    total = lines.agg(F.sum("n")).first()[0] or 0
    buckets = min(BUCKETS, max(1 << 12, 1 << (total // 64).bit_length()))
    words = lines.select(F.explode("words").alias("w"))
    counts = words.groupBy(F.col("w").bitwiseAND(F.lit(buckets - 1)).alias("slot")).agg(F.count("*").alias("n"))
    return dense(cut(counts.select("slot", F.least(F.floor(F.log2("n") * 4), F.lit(250)).cast("long").alias("value")), "rarity"), buckets), buckets


def _ordered(words: Column, rarity: Column, buckets: int) -> Column:
    """Word hashes as longs in global order: the bucket's class, then the hash but for its last bits."""
    return F.sort_array(F.transform(words, lambda h: F.call_function("shiftleft", F.element_at(rarity, (h.bitwiseAND(F.lit(buckets - 1)) + 1).cast("int")), F.lit(55)).bitwiseOR(F.shiftrightunsigned(h, 9))))


def _prefix(n: Column) -> Column:
    return F.greatest(n - F.ceil(n * SIMILAR / F.lit(100.0)).cast("int") + 1, F.lit(1))


def _needed(n: Column, m: Column) -> Column:
    """The least intersection of sets of n and m elements that are similar."""
    return F.ceil((n + m) * SIMILAR / F.lit(100.0 + SIMILAR))


def _able(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Whether the sets of two lines that share a word of their prefixes may be similar.

    By length; by place, as no shared word precedes a first one; and by parity, as
    each word that only one of them has changes one bit at most.
    """
    n, m = a["n"], b["n"]
    need = _needed(n, m)
    close = 100 * F.least(n, m) >= SIMILAR * F.greatest(n, m)
    placed = F.least(n - a["at"], m - b["at"]) >= need
    return close & placed & (F.bit_count(a["sig"].bitwiseXOR(b["sig"])) <= n + m - 2 * need)


_PLACE, _SET = ("doc", "line"), ("set", "sig")
_ENTRY = (*_SET, "n", "at")
_PAIR = [f"{s}_{c}" for s in "ab" for c in _SET]


def _before(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """An order of sets, so that each pair comes once."""
    return (a["set"] < b["set"]) | ((a["set"] == b["set"]) & (a["sig"] < b["sig"]))


def _neighbours(entries: DataFrame) -> DataFrame:
    """Pairs of each line with its word's earliest and with the lines shortly before it; a word of many lines is taken in parts of about 2 ** 14."""
    part = Window.partitionBy("word", "salt")
    order = part.orderBy(*_PLACE, "set")
    me = F.struct(*_ENTRY)
    placed = entries.withColumn("salt", F.pmod(F.xxhash64("set"), F.shiftright("lines", 14) + 1)).withColumn("with0", F.first(me).over(order))
    placed = placed.withColumns({f"with{k}": F.lag(me, k).over(order) for k in range(1, NEAR + 1)})
    x = {c: F.col(c) for c in _ENTRY}
    others = [{c: F.col(f"with{k}.{c}") for c in _ENTRY} for k in range(NEAR + 1)]
    good = [F.coalesce(_able(x, y) & (_before(x, y) | _before(y, x)), F.lit(False)) for y in others]
    pairs = placed.select(F.struct(*_SET).alias("x"), F.explode(F.array_compact(F.array(*(F.when(g, F.struct(*(y[c].alias(c) for c in _SET))) for g, y in zip(good, others, strict=True))))).alias("y"))
    x, y = ({c: F.col(f"{s}.{c}") for c in _SET} for s in "xy")
    low = lambda c: F.when(_before(x, y), x[c]).otherwise(y[c])
    high = lambda c: F.when(_before(x, y), y[c]).otherwise(x[c])
    return pairs.select(*(low(c).alias(f"a_{c}") for c in _SET), *(high(c).alias(f"b_{c}") for c in _SET)).distinct()


def _sharing(firsts: DataFrame) -> DataFrame:
    """Pairs that share a prefix word, not both ``gone``."""
    numbers = lambda at: F.call_function("shiftleft", F.col("n").cast("long"), F.lit(32)).bitwiseOR(F.call_function("shiftleft", at.cast("long"), F.lit(1))).bitwiseOR(F.col("gone").cast("long"))
    entries = firsts.select(*_SET, "n", "gone", F.posexplode("prefix").alias("at", "word")).select("word", *_SET, numbers(F.col("at")).alias("numbers"))
    sides, cols = [], []
    for s in "ab":
        sides.append(entries.select(F.col("word").alias(f"{s}_word"), *(F.col(c).alias(f"{s}_{c}") for c in (*_SET, "numbers"))))
        packed = F.col(f"{s}_numbers")
        cols.append({c: F.col(f"{s}_{c}") for c in _SET} | {"n": F.shiftright(packed, 32).cast("int"), "at": F.shiftright(packed.bitwiseAND(F.lit((1 << 32) - 1)), 1).cast("int"), "gone": packed.bitwiseAND(F.lit(1))})
    a, b = cols
    both = sides[0].join(sides[1], F.col("a_word") == F.col("b_word")).where(_before(a, b) & (a["gone"] + b["gone"] < 2) & _able(a, b))
    return both.select(*_PAIR).distinct()


def _verified(pairs: DataFrame, lines: DataFrame) -> DataFrame:
    """(doc, line, set, sig) of the later set's earliest line, for those ``pairs`` whose sets are similar."""
    wanted = cut(pairs.select(F.col("a_set").alias("set")).union(pairs.select("b_set")).distinct(), "wanted")
    sets = cut(lines.where(among(wanted, F.col("set"))).groupBy(*_SET).agg(F.first("words").alias("words"), F.min(F.struct(*_PLACE)).alias("place")), "sets")
    both = pairs
    for s in "ab":
        both = both.join(sets.select(*(F.col(c).alias(f"{s}_{c}") for c in (*_SET, "words", "place"))), [f"{s}_{c}" for c in _SET])
    shared, n, m = F.size(F.array_intersect("a_words", "b_words")), F.size("a_words"), F.size("b_words")
    both = both.where((100 * shared >= SIMILAR * (n + m - shared)) & (F.col("a_place") != F.col("b_place")))
    later = lambda c: F.when(F.col("a_place") < F.col("b_place"), F.col(f"b_{c}")).otherwise(F.col(f"a_{c}")).alias(c)
    return both.select(later("place"), *(later(c) for c in _SET)).select("place.*", *_SET).distinct()


def removed_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, set): the lines to remove from ``docs`` (doc_id, text), by place and by the set's hash."""
    # texts are lower-cased as a whole, once: within the functions over arrays each mention would be worked out anew for each line
    low = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc"), F.lower(F.col("text").cast("string")).alias("low"))
    rows = low.select("doc", _one_kind(F.col("low")).alias("low")).select("doc", F.posexplode(_lines(F.col("low"))).alias("line", "x"))
    lines = rows.select("doc", "line", _word_hashes(F.col("x")).alias("words")).where(F.size("words") > 0)
    lines = cut(lines.select("doc", "line", F.xxhash64("words").alias("set"), _parity(F.col("words")).alias("sig"), F.size("words").alias("n"), "words"), "lines")

    # lines of one set: the earliest stands for all; the array joins each row only as an operand, so the two projections become one
    rarity, buckets = _rarity(lines)
    prefix = F.when(F.col("n") >= LEAST, F.slice(_ordered(F.col("words"), F.col("rarity"), buckets), 1, _prefix(F.col("n"))))
    firsts = lines.withColumn("rarity", rarity).select(*_SET, "n", "doc", "line", prefix.alias("prefix")).groupBy(*_SET, "n").agg(F.count("*").alias("copies"), F.min(F.struct(*_PLACE)).alias("p"), F.first("prefix").alias("prefix"))
    firsts = cut(firsts.select(*_SET, "n", "copies", "p.*", "prefix"), "firsts")
    several = cut(firsts.where("copies > 1").select(*_SET, *(F.col(c).alias(f"f_{c}") for c in _PLACE)), "several")
    repeats = lines.where(among(several, F.col("set"))).select(*_PLACE, *_SET).join(several, list(_SET))
    repeats = repeats.where((F.col("f_doc") < F.col("doc")) | ((F.col("f_doc") == F.col("doc")) & (F.col("f_line") < F.col("line")))).select(*_PLACE, *_SET)

    firsts = firsts.where(F.col("n") >= LEAST)
    entries = firsts.select(*_PLACE, *_SET, "n", F.posexplode("prefix").alias("at", "word"))
    many = cut(entries.groupBy("word").agg(F.count("*").alias("lines")).where(F.col("lines") > FEW), "many")
    tried = cut(_neighbours(entries.where(among(many, F.col("word"))).join(many, "word")), "pairs")
    near = cut(_verified(tried, lines), "near")
    gone = near.select(*_SET).distinct().withColumn("gone", F.lit(True))
    maybe = among(near.select("set"), F.col("set"))
    marked = firsts.where(maybe).join(gone, list(_SET), "left").withColumn("gone", F.coalesce("gone", F.lit(False)))
    marked = marked.unionByName(firsts.where(~maybe).withColumn("gone", F.lit(False)))
    more = _verified(cut(_sharing(marked).join(tried, _PAIR, "left_anti"), "pairs"), lines)
    # a set's later copies are gone already as repeats
    return repeats.unionByName(near).unionByName(more).select(F.col("doc").alias("doc_id"), F.col("line").alias("line_no"), "set").distinct()


def drop_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with the removed lines cut out of ``text``; other columns as they were.

    A document that loses all its lines with words goes as a whole.
    """
    lost = cut(removed_lines(docs).groupBy("doc_id").agg(F.collect_set(F.struct("line_no", "set")).alias("__lost")).withColumnRenamed("doc_id", "__id"), "lost")
    names = docs.columns
    place, text = names.index("doc_id"), names.index("text")
    rows = docs.toDF(*(f"c{i}" for i in range(len(names))))
    doc_id, body = F.col(f"c{place}").cast("long"), F.col(f"c{text}").cast("string")
    hit = among(lost, doc_id)
    touched = rows.where(hit).join(lost, doc_id == F.col("__id"), "left")
    # rows of one doc_id may differ in text, so a line goes by its number and its set
    stays = F.filter(F.transform(_lines(body), lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda s: ~F.array_contains("__lost", F.struct(s["i"].alias("line_no"), F.xxhash64(_hashes(s["x"])).alias("set"))))
    kept = F.array_join(F.transform(stays, lambda s: s["x"]), "\n")
    touched = touched.withColumn("__kept", F.when(F.col("__lost").isNull(), body).otherwise(kept)).where(F.col("__lost").isNull() | F.col("__kept").rlike("[^\\x20\\x09-\\x0D]"))
    touched = touched.select(*(F.col("__kept").alias(f"c{i}") if i == text else F.col(f"c{i}") for i in range(len(names))))
    return touched.unionByName(rows.where(~hit)).toDF(*names)
