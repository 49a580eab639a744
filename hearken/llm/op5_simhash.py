"""SimHash near-duplicates through deletion variants of segments.

A fingerprint is cut into so few segments that two fingerprints within the bound have one that differs by at most
one bit: three for a word of 64 bits and 4 bits. Every variant of a segment with one bit wiped out is a key; equal
keys give candidates, whose fingerprints are compared. Equal fingerprints count once, so copies cost nothing here.

Only which texts hang together is asked for. First each member of a bucket is compared with the bucket's least
fingerprint, so a large group of near copies becomes one component in linear work; then only pairs from different
components are compared, each at the first key they share.

A similarity of shingle sets can't be told from fingerprints so near: for it (similar_documents) candidates come from
prefixes of the sets, and their shingles are compared. Both kinds of links can be asked for at once (max_bits).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearken.llm.common import components, release, small_batches, text_of, written

SEED = 42
#: First bit and length of the segments of a 64-bit word.
SEGMENTS = ((0, 21), (21, 21), (42, 22))
_CHUNK = 16_384  # shingles whose bits are counted at a time


def fingerprints_of(text: str, shingle: int = 4, words: int = 1) -> list[int]:
    """`words` 64-bit words as signed integers; word w takes XXH64 with seed 42 + w of the shingles' UTF-8 bytes.

    A bit is 1 if over half of the shingles, repeats included, have it; fewer words than `shingle` are one shingle,
    no words give zeros. Only A-Z are lower-cased, and only ASCII white space parts words.
    """
    parts = text.encode("utf-8").lower().split()
    if not parts:
        return [0] * words
    if len(parts) <= shingle:
        spans = [b" ".join(parts)]
    else:
        joined = memoryview(b" ".join(parts))
        ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1)
        starts = np.concatenate([[0], ends[:-1]])[: len(parts) - shingle + 1].tolist()
        spans = [joined[a:b] for a, b in zip(starts, (ends[shingle - 1 :] - 1).tolist(), strict=True)]
    out = []
    for w in range(words):
        count = np.zeros(64, np.int64)
        for k in range(0, len(spans), _CHUNK):
            h = np.fromiter((xxhash.xxh64_intdigest(s, SEED + w) for s in spans[k : k + _CHUNK]), np.uint64)
            count += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        out.append(int(np.packbits(count * 2 > len(spans), bitorder="little").view("<i8")[0]))
    return out


def fingerprint(docs: DataFrame, shingle: int = 4, words: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id and f0, f1, ... of every row; null texts are empty. No shuffle."""
    small_batches(docs.sparkSession)
    names = [f"f{w}" for w in range(words)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [fingerprints_of(t, shingle, words) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[w] for r in rows], pa.int64()) for w in range(words))], [id_col, *names])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_of(text_col).alias("t")).mapInArrow(run, f"`{id_col}` {kind}, " + ", ".join(f"{n} long" for n in names))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _masks(words: int) -> list[tuple[int, int, int]]:
    """(word, first bit, mask) of each segment."""
    return [(w, at, ((1 << n) - 1) << at) for w in range(words) for at, n in SEGMENTS]


def _variants(words: int) -> Column:
    """The keys of a fingerprint: for each bit, its segment without it and which bit that is."""
    keys = []
    for w, at, mask in _masks(words):
        for bit in range(at, at + mask.bit_count()):
            rest = F.shiftrightunsigned(F.col(f"f{w}").bitwiseAND(F.lit(_signed(mask & ~(1 << bit)))), at)
            keys.append(rest.bitwiseOR(F.lit((w * 64 + bit) << 32)))
    return F.array(*keys)


def _distance(words: int) -> Column:
    return sum((F.bit_count(F.col(f"a.f{w}").bitwiseXOR(F.col(f"b.f{w}"))) for w in range(words)), F.lit(0))


def _first_meeting(words: int) -> Column:
    """Whether a.key is the first of the keys that fingerprints a and b share."""
    bit = F.shiftrightunsigned(F.col("a.key"), 32)
    here, before = F.lit(False), F.lit(True)
    for w, at, mask in _masks(words):
        part = F.col(f"a.f{w}").bitwiseXOR(F.col(f"b.f{w}")).bitwiseAND(F.lit(_signed(mask)))
        here = here | (before & bit.between(w * 64 + at, w * 64 + at + mask.bit_count() - 1) & ((part != 0) | (bit == w * 64 + at)))
        before = before & (F.bit_count(part) >= 2)
    return here


def _in_company(keyed: DataFrame, of: Column, least: str) -> DataFrame:
    """The rows of keys under which `of` has more than one value, with the least of them. By an aggregate, which is partly
    done before the shuffle, and a join to one row a key, which can be split where a key is hot. Merged by hint: the planner
    takes the rows of keys for as few as the fingerprints that they are made from, and would send them all to the driver."""
    groups = keyed.groupBy("key").agg(F.min(of).alias(least), F.max(of).alias("__most")).where(F.col(least) != F.col("__most")).drop("__most")
    return keyed.join(groups.hint("merge"), "key")


def linked_components(prints: DataFrame, words: int, max_bits: int) -> DataFrame:
    """(n, component) of the distinct fingerprints of `prints` (n, f0, ...) that link with another one."""
    names = [f"f{w}" for w in range(words)]
    keyed = prints.withColumn("key", F.explode(_variants(words)))
    led = _in_company(keyed, F.struct("n", *names), "b").where("n <> b.n")
    near = sum((F.bit_count(F.col(f).bitwiseXOR(F.col(f"b.{f}"))) for f in names), F.lit(0)) <= max_bits
    star = written(led.where(near).select(F.col("n").alias("v"), F.col("b.n").alias("u")).distinct(), "stars")
    group = written(prints.join(components(star).withColumnRenamed("node", "n").hint("merge"), "n", "left").withColumn("g", F.coalesce("component", "n")).drop("component"), "groups")
    keyed = group.withColumn("key", F.explode(_variants(words)))
    mixed = _in_company(keyed, F.col("g"), "lo").select("key", "n", "g", *names)
    a, b = mixed.alias("a"), mixed.alias("b")
    pairs = a.join(b, F.col("a.key") == F.col("b.key")).where("a.g < b.g").where(_distance(words) <= max_bits).where(_first_meeting(words))
    edges = pairs.select(F.col("a.g").alias("u"), F.col("b.g").alias("v")).distinct()
    return components(edges.unionByName(group.where("g <> n").select(F.col("g").alias("u"), F.col("n").alias("v")))).withColumnRenamed("node", "n")


def near_duplicates(docs: DataFrame, shingle: int = 4, words: int = 1, max_bits: int = 4) -> DataFrame:
    """doc_id, f0, ... and component_id (the smallest doc_id reachable) of every row of docs.

    With one word and at most 4 bits every link is found; with more words a link is found if some segment differs
    by at most one bit. Null and empty texts have fingerprint 0 and link like others; rows without doc_id take
    part, and a component without any doc_id has a null component_id; repeated rows are kept; other columns are
    ignored; no documents give no rows.
    """
    names = [f"f{w}" for w in range(words)]
    own = written(fingerprint(docs, shingle, words), "fingerprints")
    key = F.col("f0") if words == 1 else F.xxhash64(*names)
    least = written(own.groupBy(*names).agg(F.min("doc_id").alias("least")).withColumn("n", key), "distinct-fingerprints")
    of = linked_components(least.select("n", *names), words, max_bits)
    groups = least.join(of.hint("merge"), "n", "left").withColumn("group", F.coalesce("component", "n"))
    roots = groups.groupBy("group").agg(F.min("least").alias("component_id"))
    found = groups.select(*names, "group").join(roots, "group").select(*names, "component_id")
    return own.join(found.hint("merge"), names)  # a table's size on disk doesn't tell how many rows it has


def shingle_set(text: str, shingle: int) -> np.ndarray:
    """The distinct shingles of a text as sorted 64-bit hashes; words and short texts as for fingerprints."""
    parts = text.encode("utf-8").lower().split()
    k = min(len(parts), shingle)
    w = np.fromiter((xxhash.xxh64_intdigest(p, SEED) for p in parts), np.uint64, len(parts))
    h = np.full(len(parts) - k + 1 if k else 0, k, np.uint64)
    for i in range(k):
        h = h * np.uint64(0x9E3779B97F4A7C15) + w[i : i + len(h)]
        h ^= h >> np.uint64(29)
    return np.unique(h)


def _ranked(found: np.ndarray, common: np.ndarray) -> np.ndarray:
    """Sorted hashes with the common ones last, so that prefixes seldom hold what many texts share."""
    known = np.isin(found, common, assume_unique=True)
    return np.concatenate([found[~known], found[known]])


def _common(docs: DataFrame, shingle: int) -> np.ndarray:
    """Hashes of shingles in many texts, from a sixteenth of them. They only decide an order, not what is found."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(shingle_set(t, shingle).view(np.int64))], ["h"])

    some = docs.select(text_of().alias("t")).where(F.pmod(F.xxhash64("t"), F.lit(16)) == 0)
    counts = some.mapInArrow(run, "h long").groupBy("h").agg(F.count("*").alias("k")).where("k >= 4")
    return np.array(sorted(r.h for r in counts.orderBy(F.desc("k"), "h").limit(50_000).collect()), np.int64).view(np.uint64)


def _shared(docs: DataFrame, shingle: int, similarity: float, prints: bool) -> DataFrame:
    """doc_id, hash (of the text), s (128 bits of the shingle set's hash), n (its size), prefix and f0 (with prints, the
    fingerprint, else null) of every row of docs.

    Any two sets of this similarity share a shingle of their prefixes, the first n - ceil(similarity * n) + 1 in an
    order that is the same for all.
    """
    common = docs.sparkSession.sparkContext.broadcast(_common(docs, shingle))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).to_pylist()
            sets = [shingle_set(t, shingle) for t in texts]
            f0 = [fingerprints_of(t)[0] if prints else None for t in texts]
            own = [xxhash.xxh3_128_digest(x.tobytes(), SEED) for x in sets]
            first = [_ranked(x, common.value)[: len(x) - math.ceil(similarity * len(x) - 1e-9) + 1] for x in sets]
            ends = np.cumsum([0, *map(len, first)]).astype(np.int32)
            prefix = pa.ListArray.from_arrays(ends, np.concatenate([np.empty(0, np.uint64), *first]).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(own, pa.binary()), pa.array([len(x) for x in sets], pa.int32()), prefix, pa.array(f0, pa.int64())], ["doc_id", "hash", "s", "n", "prefix", "f0"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.xxhash64(text_of()).alias("hash"), text_of().alias("t")).mapInArrow(run, f"doc_id {kind}, hash long, s binary, n int, prefix array<long>, f0 long")


def _verified(pairs: DataFrame, docs: DataFrame, reps: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """u, v of the pairs (u, v) of sets whose Jaccard similarity is at least this; texts are read for these sets only."""
    pairs = written(pairs, "pairs")
    needed = pairs.select(F.explode(F.array("u", "v")).alias("s")).distinct()
    of = written(reps.join(needed.hint("merge"), "s").select("s", F.col("rep.doc_id").alias("__id"), F.col("rep.hash").alias("__hash")), "compared")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t, shingle).view(np.int64) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], ["s", "x"])

    rows = docs.select("doc_id", text_of().alias("t"), F.xxhash64(text_of()).alias("h")).join(of.hint("merge"), F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("h") == F.col("__hash")))
    read = written(rows.select("s", "t").mapInArrow(run, "s long, x array<long>"), "sets")
    sets = read.dropDuplicates(["s"])
    both = F.size(F.array_intersect("a", "b"))
    side = lambda s, x: sets.select(F.col("s").alias(s), F.col("x").alias(x)).hint("merge")
    compared = pairs.join(side("u", "a"), "u").join(side("v", "b"), "v")
    found = written(compared.where(both / (F.size("a") + F.size("b") - both) >= similarity).select("u", "v"), "similar")
    release(docs.sparkSession, pairs, of, read)
    return found


def _alike(own: DataFrame, sets: DataFrame, max_bits: int) -> DataFrame:
    """u, v: edges between the numbers of sets of texts whose fingerprints hang together within max_bits."""
    prints = written(own.select(F.col("s").alias("name"), "f0").distinct().join(sets.select("name", "s").hint("merge"), "name").select("s", "f0"), "set-fingerprints")
    of = linked_components(prints.select(F.col("f0").alias("n"), "f0").distinct(), 1, max_bits).withColumnRenamed("n", "f0")
    classes = prints.join(of.hint("merge"), "f0", "left").select("s", F.coalesce("component", "f0").alias("c"))
    first = classes.groupBy("c").agg(F.min("s").alias("u"), F.max("s").alias("__most")).where("u <> __most").select("c", "u")
    edges = written(classes.join(first.hint("merge"), "c").where("s <> u").select("u", F.col("s").alias("v")).distinct(), "alike")
    release(own.sparkSession, prints)
    return edges


def similar_documents(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, max_bits: int | None = None) -> DataFrame:
    """doc_id, hash (XXH64 of the text by Spark), component_id and component_hash of every row of docs.

    The last two are of the row reachable that has the smallest doc_id, then hash.

    Two texts are linked if the Jaccard similarity of their shingle sets is at least `similarity`: every such pair is
    found by its prefixes, and none is linked without its shingles having been compared. As in linked_components,
    members of a bucket first meet its least one; then those of different components meet. Texts without words are
    alike. A component without any doc_id has a null component_id. With max_bits, texts whose fingerprints, those of
    near_duplicates, differ by at most so many bits are linked as well, whatever their similarity; with up to 4 bits
    every such link is found.
    """
    small_batches(docs.sparkSession)
    own = written(_shared(docs, shingle, similarity, max_bits is not None), "shingle-sets")
    rep = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "hash")).alias("rep")
    sets = own.groupBy("s").agg(rep, F.first("n").alias("n"), F.first("prefix").alias("prefix"))
    sets = written(sets.withColumnRenamed("s", "name").withColumn("s", F.monotonically_increasing_id()), "distinct-sets")  # short numbers from here on
    reps = sets.select("s", "rep")
    alike = [] if max_bits is None else [_alike(own, sets, max_bits)]
    sized = F.least("n", "m") >= F.greatest("n", "m") * similarity - 1e-9
    # what two prefixes share is all that the sets share up to the end of one of them; the rest of that set is the most to come
    rest = F.greatest(*(F.ceil(F.col(c) * similarity - 1e-9) for c in ("n", "m"))) - 1
    enough = F.col("k") + rest >= (F.col("n") + F.col("m")) * (similarity / (1 + similarity)) - 1e-6
    counted = lambda met: met.where(sized).groupBy("u", "v").agg(F.count("*").alias("k"), F.first("n").alias("n"), F.first("m").alias("m")).where(enough).select("u", "v")
    keyed = written(_in_company(sets.select("s", "n", F.explode("prefix").alias("key")), F.struct("s", F.col("n").alias("m")), "b"), "buckets")
    star = _verified(counted(keyed.select("n", "b.m", F.col("b.s").alias("u"), F.col("s").alias("v")).where("v <> u")), docs, reps, shingle, similarity)
    for more in alike:
        star = star.unionByName(more)
    grouped = keyed.join(components(star).select(F.col("node").alias("s"), "component"), "s", "left").withColumn("g", F.coalesce("component", "s"))
    mixed = _in_company(grouped.select("key", "s", "n", "g"), F.col("g"), "lo").select("key", "s", "n", "g")
    other = mixed.select("key", F.col("s").alias("v"), F.col("n").alias("m"), F.col("g").alias("o"))
    pairs = mixed.join(other, "key").where("s < v and g <> o").withColumnRenamed("s", "u")
    edges = star.unionByName(_verified(counted(pairs), docs, reps, shingle, similarity))
    groups = written(sets.select("s", "name", "rep").join(components(edges).withColumnRenamed("node", "s"), "s", "left").select("name", "rep", F.coalesce("component", "s").alias("group")), "groups")
    roots = groups.groupBy("group").agg(F.min("rep").alias("root"))
    return own.select("doc_id", "hash", F.col("s").alias("name")).join(groups.join(roots, "group").select("name", F.col("root.doc_id").alias("component_id"), F.col("root.hash").alias("component_hash")), "name").drop("name")


def one_of_each(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, max_bits: int | None = None) -> DataFrame:
    """docs, all columns, with one row of each group of near duplicates (of similar_documents): that of the smallest doc_id.

    Rows without doc_id stay. A document is an id with a text: its copies are one, and different texts under one id
    go only for their own components (of those in one component that of the smallest hash stays).
    """
    found = similar_documents(docs.select("doc_id", "text"), shingle, similarity, max_bits).where("doc_id is not null")
    stays = (F.col("doc_id") == F.col("component_id")) & (F.col("hash") == F.col("component_hash"))
    ids = found.groupBy("doc_id", "hash").agg(F.count("*").alias("k"), F.bool_or(stays).alias("stays"))
    ids = written(ids.where("k > 1 or not stays").select(F.col("doc_id").alias("__id"), F.col("hash").alias("__hash"), F.col("stays").alias("__stays")), "dropped")
    keyed = docs.withColumn("__key", F.xxhash64(text_of()))
    same = (F.col("doc_id") == F.col("__id")) & (F.col("__key") == F.col("__hash"))
    once = keyed.join(ids, same, "left_anti")
    repeated = keyed.join(ids.where("__stays"), same, "left_semi").dropDuplicates(["doc_id", "__key"])
    return once.unionByName(repeated).drop("__key")
