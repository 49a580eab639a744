"""Line dedup by a deletion-neighbourhood join, in DataFrame operations alone.

Lines are sequences of words (white space parts them). Two lines are near if one word substituted, inserted or
deleted makes them equal. A line's variants are itself with one word wiped out, and itself with a gap at any place:
equal keys of two wiped lines are a substitution, of a wiped line and a gapped one an insertion. Equal lines are
joined by hash first, and only lines that share their first or last half with another line get variants at all;
any two near lines do share one, so this loses nothing.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearken.llm.common import release, text_of, written

#: Shorter lines are only compared exactly: one word would be over a fifth of them.
MIN_WORDS = 5


def _spaced(text: Column) -> Column:
    """text with a space for each other white space but the end of a line; most texts have none and are left as they are."""
    others = ("\t", "\x0b", "\x0c", "\r")
    out = text
    for c in others:
        out = F.replace(out, F.lit(c), F.lit(" "))
    return F.when(reduce(or_, (text.contains(c) for c in others)), out).otherwise(text)


def _raw_lines(docs: DataFrame) -> DataFrame:
    """doc_id, doc_hash, line_no, line (white space as spaces) of every line."""
    text = text_of("text")
    # hashed before its lines are parted: their rows carry neither the text nor the work of hashing it
    hashed = docs.select("doc_id", F.xxhash64(text).alias("doc_hash"), _spaced(text).alias("text"))
    return hashed.select("doc_id", "doc_hash", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))


def _joined_words() -> Column:
    """The words of line with one space between."""
    line = F.trim("line")
    return F.when(line.contains("  "), F.regexp_replace(line, " +", " ")).otherwise(line)


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of value, which is worked out once however often f names it, within f's lambdas too."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _place(doc_id: str = "doc_id", line_no: str = "line_no") -> Column:
    """Orders lines by document and place; documents without an id come last."""
    return F.struct(F.col(doc_id).isNull().alias("no_id"), F.col(doc_id).alias("doc_id"), F.col(line_no).alias("line_no"), F.col("doc_hash").alias("doc_hash"))


def _halves(min_words: int) -> Column:
    """Hashes of the first and last c of n words, c about half of them, for both c that a near line may use."""
    n = F.col("n")
    c = lambda m: F.floor((m - 1) / 2).cast("int")
    part = lambda k: F.call_function("substring_index", "words", F.lit(" "), k)
    ends = lambda k: [F.xxhash64(F.lit("first"), k, part(k)), F.xxhash64(F.lit("last"), k, part(-k))]
    some = F.when(n % 2 == 1, F.array(*ends(c(n)))).otherwise(F.array(*ends(c(n)), *ends(c(n + 1))))  # for odd n both are one
    return F.when(n < min_words, F.array().cast("array<bigint>")).otherwise(some)


def _with_lists(docs: DataFrame, lists: DataFrame) -> DataFrame:
    """docs beside the list of their (id, hash of the text); both are shuffled and merged, so neither need fit in memory."""
    keyed = docs.withColumn("__key", F.xxhash64(text_of("text")))
    return keyed.join(lists.hint("merge"), F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__key") == F.col("__hash")), "left")


def _near_lines(docs: DataFrame, firsts: DataFrame) -> DataFrame:
    """h1, h2 of the distinct lines that have an earlier line within one word."""
    halves = firsts.where(F.size("halves") > 0).select("h1", "h2", F.explode("halves").alias("half"))
    shared = halves.groupBy("half").agg(F.count("*").alias("k")).where("k > 1").select("half")
    wanted = halves.join(shared, "half", "left_semi").select("h1", "h2").distinct()
    places = firsts.join(wanted, ["h1", "h2"]).select("h1", "h2", "first.*")
    # the places of a document meet its text once; only the lines at them are parted from it
    by = places.groupBy("doc_id", "doc_hash").agg(F.collect_list(F.struct("line_no", "h1", "h2")).alias("at")).withColumnsRenamed({"doc_id": "__id", "doc_hash": "__hash"})
    met = _with_lists(docs.select("doc_id", "text"), by).where("at is not null")
    text = _let(F.split(_spaced(text_of("text")), "\n", -1), lambda p: F.transform("at", lambda a: F.struct(a["line_no"], a["h1"], a["h2"], F.get(p, a["line_no"]).alias("line"))))
    found = met.select("doc_id", F.col("__key").alias("doc_hash"), F.explode(text).alias("a")).select("doc_id", "doc_hash", "a.*")
    found = found.select("h1", "h2", F.split(_joined_words(), " ").alias("words"), _place().alias("place")).dropDuplicates(["h1", "h2"])
    # ids that grow in the order of places: partitions of a sort are in order, and so are the ids in each
    lines = written(found.orderBy("place").select("h1", "h2", "words", F.monotonically_increasing_id().alias("id")), "near-lines")
    release(docs.sparkSession)  # of the texts' shuffle

    n = F.size("words")
    word = lines.select("id", n.alias("n"), F.posexplode("words").alias("pos", "word"))
    word = word.select("id", "n", "pos", F.xxhash64("word", "pos").alias("f"), F.xxhash64("word", F.col("n") - 1 - F.col("pos")).alias("g"))
    line = Window.partitionBy("id")
    so_far = line.orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    word = word.withColumn("fs", F.bit_xor("f").over(so_far)).withColumn("gs", F.bit_xor("g").over(so_far)).withColumn("total", F.bit_xor("g").over(line))
    before = F.col("fs").bitwiseXOR(F.col("f"))
    after = F.col("total").bitwiseXOR(F.col("gs"))
    at = lambda p, left, right, size, wiped: F.struct(p.alias("pos"), F.lit(wiped).alias("wiped"), F.xxhash64(p, size, left, right).alias("key"))
    wiped = at(F.col("pos"), before, after, F.col("n") - 1, 1)
    gap = at(F.col("pos"), before, after.bitwiseXOR(F.col("g")), F.col("n"), 0)
    last = at(F.col("n"), F.col("fs"), F.lit(0).cast("long"), F.col("n"), 0)
    # read twice, by the groups and by the pairs
    variants = written(word.select("id", F.explode(F.when(F.col("pos") == F.col("n") - 1, F.array(wiped, gap, last)).otherwise(F.array(wiped, gap))).alias("x")).select("id", "x.*"), "variants")
    earliest = lambda kind: F.min(F.when(F.col("wiped") == kind, F.col("id"))).alias(f"e{kind}")
    groups = variants.groupBy("key").agg(F.count("*").alias("k"), earliest(1), earliest(0)).where("k > 1 and e1 is not null")
    other = F.when(F.col("wiped") == 0, F.col("e1")).otherwise(F.least("e1", "e0"))
    pairs = variants.join(groups, "key").withColumn("e", other).where("e < id")
    o_wiped = F.when((F.col("wiped") == 1) & F.col("e").eqNullSafe(F.col("e0")), 0).otherwise(1)
    pairs = pairs.select("id", "pos", "wiped", "e", o_wiped.alias("o_wiped"))
    theirs = lines.select(F.col("id").alias("e"), F.col("words").alias("o_words"))
    tail = lambda c, wiped: F.slice(c, F.col("pos") + 1 + F.col(wiped), F.greatest(F.size(c), F.lit(1)))
    equal = (F.slice("words", F.lit(1), F.col("pos")) == F.slice("o_words", F.lit(1), F.col("pos"))) & (tail("words", "wiped") == tail("o_words", "o_wiped"))
    near = written(pairs.join(lines, "id").join(theirs, "e").where(equal).select("h1", "h2").distinct(), "near")
    release(docs.sparkSession, variants, lines)
    return near


def dedup_lines(docs: DataFrame, counts: bool = False, min_words: int = MIN_WORDS) -> DataFrame:
    """docs without the lines that repeat an earlier line; with counts, also n_lines and n_dropped (of lines with words).

    A line goes if an equal one stands before it (by doc_id, then place) or, with min_words words or more, one that
    a single edit of a word makes equal, be that one kept or not; the earliest of equal lines stays otherwise.
    Kept lines and blank ones keep their order and spelling; a text that loses nothing is unchanged, null included;
    a text that loses all its lines is empty. Rows without doc_id come last; copies of a row (equal id and text) are
    one document, treated alike; other columns pass through, but for n_lines and n_dropped, which counts replace, and
    those named __id, __hash, __gone or __key, which are an error; no documents give no rows.
    """
    if clash := {"__id", "__hash", "__gone", "__key"} & set(docs.columns):
        raise ValueError(f"columns {sorted(clash)} are used within")
    h = [F.xxhash64("words").alias("h1"), F.xxhash64(F.lit(1), "n", "words").alias("h2")]
    worded = _raw_lines(docs).where(F.trim("line") != "").select("doc_id", "doc_hash", "line_no", _joined_words().alias("words"))
    worded = worded.withColumn("n", F.octet_length("words") - F.octet_length(F.replace("words", F.lit(" "), F.lit(""))) + 1)
    lines = written(worded.select("doc_id", "doc_hash", "line_no", *h, _halves(min_words).alias("halves")), "lines")
    firsts = lines.groupBy("h1", "h2").agg(F.min(_place()).alias("first"), F.count("*").alias("k"), F.min("halves").alias("halves"))
    near = _near_lines(docs, firsts).withColumn("near", F.lit(True))
    flagged = firsts.select("h1", "h2", "first", "k").join(near, ["h1", "h2"], "left").where("k > 1 or near")
    drop = F.coalesce(F.col("near"), F.lit(False)) | ~_place().eqNullSafe(F.col("first"))
    gone = lines.select("doc_id", "doc_hash", "line_no", "h1", "h2").join(flagged, ["h1", "h2"]).where(drop)
    lists = gone.groupBy("doc_id", "doc_hash").agg(F.collect_set("line_no").alias("__gone")).withColumnsRenamed({"doc_id": "__id", "doc_hash": "__hash"})
    text, joined = text_of("text"), _with_lists(docs, lists)
    left = lambda parts: F.transform(F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col("__gone")), lambda i: F.get(parts, i))
    kept = _let(F.split("text", "\n", -1), lambda parts: F.array_join(left(parts), "\n"))
    n_lines = F.size(F.filter(F.split(_spaced(text), "\n", -1), lambda line: F.trim(line) != "")).cast("long")
    n_dropped = F.when(F.col("__gone").isNull(), 0).otherwise(F.size("__gone")).cast("long")
    others = [F.col(f"`{c}`") for c in docs.columns if c != "text" and not (counts and c in ("n_lines", "n_dropped"))]
    return joined.select(*others, F.when(F.col("__gone").isNull(), F.col("text")).otherwise(kept).alias("text"), *([n_lines.alias("n_lines"), n_dropped.alias("n_dropped")] if counts else []))


def without_repeated_lines(docs: DataFrame) -> DataFrame:
    """docs, all columns, with dedup_lines applied to text and n_chars (if there) set anew where lines went.

    A document that loses all its lines repeats earlier ones throughout and goes; one that had no words stays.
    """
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__row"), "doc_id", "text")
    out = dedup_lines(rows, counts=True).where("n_dropped = 0 or n_dropped < n_lines")
    new = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        new["n_chars"] = F.when(F.col("n_dropped") > 0, F.length("text").cast(kind)).otherwise(F.col("__row.n_chars"))
    return out.select(*(new.get(c, F.col(f"__row.`{c}`")).alias(c) for c in docs.columns))
