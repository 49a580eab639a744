"""Dictionary matching: the surfaces of all layers meet the tokens of messages in one join; folds over what was found.

A surface is met by its first token, then checked by its pattern unless it is that token. Lexicons are bits of a mask;
terms, explicit signals and dampeners are structs. A `seam` is the end of a sender's earlier messages and the start of
the present one: surfaces of several words that lie across it count for the sender alone.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hearken.config import WEAK
from hearken.functions.text import token_array
from hearken.sources import packs as P

#: Tables of more surfaces than this (some 200 bytes each) are joined by shuffle, smaller ones are broadcast.
BROADCAST_SURFACES = 100_000
TERM, LEXICON, SIGNAL, DAMPENER = range(4)
ENTRY = "layer:int,pack_idx:int,entry_idx:int,canonical_id:string,out_id:string,surface:string,scoped:string,category:string,weight:double,ambiguous:boolean,seam:boolean"
_ROW = f"token string, whole boolean, pattern string, layer int, mask long, e struct<{ENTRY}>"
#: Stands before the tokens of a seam, and alone for a message as such.
_SEAM, _SELF = "\x01", ""


def surface_rows(d: P.Dictionaries, key: Callable[[str], str] = P.fold_key) -> list[tuple]:
    """(surface, layer, mask, entry): terms, lexicons, signals and dampeners; `key` makes surfaces like texts (dampeners are only folded)."""
    rows = [(s, TERM, 0, (TERM, k, n, c, o, s, f"{p}:{cat}", cat, w, amb)) for k, n, p, o, c, s, cat, w, amb in P.entries(d.packs, key)]
    masks: dict[str, int] = {}
    for i, (_, surfaces) in enumerate(d.patterns.lexicons):
        for s in filter(None, map(key, surfaces)):
            masks[s] = masks.get(s, 0) | 1 << i
    rows += [(s, LEXICON, m, None) for s, m in masks.items()]
    for i, x in enumerate(d.patterns.signals):
        rows += [(s, SIGNAL, 0, (SIGNAL, 0, i, x.id, x.id, s, None, x.category, x.weight, False)) for s in dict.fromkeys(filter(None, map(key, x.surfaces)))]
    for i, x in enumerate(d.dampeners):
        rows += [(s, DAMPENER, 0, (DAMPENER, 0, i, x.id, x.id, s, None, None, x.factor, False)) for s in dict.fromkeys(filter(None, map(P.fold_key, (x.term, *x.variants))))]
    return rows


def longest(rows: list[tuple]) -> int:
    """Words of the longest term."""
    return max((len(r[0].split()) for r in rows if r[1] == TERM), default=1)


def _table(spark: SparkSession, rows: list[tuple], exact: bool) -> DataFrame:
    out = [(_SELF, True, None, LEXICON, 0, None)]
    for s, layer, mask, e in rows:
        first = re.search(r"[^\W_]+", s)
        if not first:
            continue
        token, whole, pattern = first[0], exact and first[0] == s, P.surface_pattern(s)
        out.append((token, whole, pattern, layer, mask, None if e is None else (*e, False)))
        if layer == TERM and len(s.split()) > 1:
            out.append((_SEAM + token, False, pattern, layer, mask, (*e, True)))
    return spark.createDataFrame(out, _ROW)


def _odd(rows: list[tuple], low: Column, folded: Column) -> tuple[Column, Column] | None:
    """(mask, entries) of the surfaces without letters and digits, such as emoji: one pattern each, in the projection."""
    odd = [r for r in rows if not re.search(r"[^\W_]", r[0])]
    if not odd:
        return None
    hit = lambda r: (low if r[1] == TERM else folded).rlike(P.surface_pattern(r[0]))
    kind = f"struct<{ENTRY}>"
    entries = [F.when(hit(r), F.struct(*map(F.lit, (*r[3], False))).cast(kind)) for r in odd if r[3]]
    mask = sum((F.when(hit(r), F.lit(r[2])).otherwise(0) for r in odd if not r[3]), F.lit(0)).cast("long")
    return mask, F.array_compact(F.array(*entries)) if entries else F.array().cast(f"array<{kind}>")


def matched(messages: DataFrame, rows: list[tuple], keep: list[str], folds: tuple[str, str] = ("", ""), strategy: str | None = None) -> DataFrame:
    """messages(*keep, text, and seam if surfaces may lie across messages): keep, mask, e of each surface found, and one
    row without e per message. (conv_id, msg_idx) are a key and among keep. `folds` (characters, plain characters) is what
    lexicons, signals and dampeners see otherwise than terms do. strategy: broadcast, shuffle or nested_loop."""
    spark = messages.sparkSession
    strategy = strategy or ("broadcast" if len(rows) <= BROADCAST_SURFACES else "shuffle")
    low = F.lower("text")
    seam = F.lower("seam") if "seam" in messages.columns else F.lit("")
    own = messages.select(*keep, low.alias("low"), (F.translate(low, *folds) if folds[0] else low).alias("folded"), seam.alias("across"))
    table = _table(spark, rows, not folds[0])
    whole = "" if strategy == "nested_loop" else "whole or "
    fits = F.expr(f"{whole}case when coalesce(e.seam, false) then across rlike pattern when layer = {TERM} then low rlike pattern else folded rlike pattern end")
    tokens = [F.array(F.lit(_SELF)), token_array(F.col("low"))]
    if folds[0]:
        tokens.append(token_array(F.col("folded")))
    if "seam" in messages.columns:
        tokens.append(F.transform(token_array(F.col("across")), lambda t: F.concat(F.lit(_SEAM), t)))
    tokens = F.array_distinct(F.concat(*tokens))
    if strategy == "nested_loop":  # the yardstick: every pattern on every message
        found = own.join(F.broadcast(table), F.when(F.col("token") == _SELF, True).otherwise(fits))
    elif strategy == "broadcast":
        found = own.withColumn("token", F.explode(tokens)).join(F.broadcast(table), "token").where(fits)
    else:  # only ids and tokens are shuffled to the surfaces, and what they met comes back to the texts
        met = own.select("conv_id", "msg_idx", F.explode(tokens).alias("token")).join(table.where(F.col("token") != _SELF), "token")
        met = met.groupBy("conv_id", "msg_idx").agg(F.collect_list(F.struct("whole", "pattern", "layer", "mask", "e")).alias("met"))
        alone = F.from_json(F.lit('{"whole":true,"layer":1,"mask":0}'), f"struct<whole:boolean,pattern:string,layer:int,mask:bigint,e:struct<{ENTRY}>>")
        both = own.join(met, ["conv_id", "msg_idx"], "left").withColumn("one", F.explode(F.concat(F.array(alone), F.coalesce("met", F.array().cast(met.schema["met"].dataType)))))
        found = both.select(*keep, "low", "folded", "across", "one.*").where(fits)
    odd = _odd(rows, F.col("low"), F.col("folded"))
    got = found.select(*keep, "mask", "e")
    if odd is None:
        return got
    more = own.select(*keep, odd[0].alias("mask"), F.explode_outer(odd[1]).alias("e"))
    return got.unionByName(more.where("mask <> 0 or e is not null"))


def match_surfaces(messages: DataFrame, packs: tuple[P.Pack, ...], strategy: str | None = None, key: Callable[[str], str] = P.fold_key) -> DataFrame:
    """messages(conv_id, msg_idx, text, ts_ms) x the terms' surfaces that occur in them as words."""
    rows = surface_rows(P.Dictionaries(packs), key)
    return matched(messages, rows, ["conv_id", "msg_idx", "ts_ms"], strategy=strategy).where("e is not null").select("conv_id", "msg_idx", "ts_ms", "e.*").drop("layer", "seam")


def first_of_each(candidates: Column, *same: Callable[[Column, Column], Column]) -> Column:
    """An ordered array without the elements that an earlier one kept is the same as, by any of `same`."""
    alike = lambda a, c: _any([f(a, c) for f in same])
    none = F.filter(candidates, lambda _: F.lit(False))
    return F.aggregate(candidates, none, lambda kept, c: F.when(F.exists(kept, lambda a: alike(a, c)), kept).otherwise(F.concat(kept, F.array(c))))


def _any(xs: list[Column]) -> Column:
    out = xs[0]
    for x in xs[1:]:
        out = out | x
    return out


def claimed(candidates: Column) -> Column:
    """Matches in order (message, pack, entry): a term counts once, and a surface with one category for its first term only."""
    return first_of_each(candidates, lambda a, c: a["canonical_id"] == c["canonical_id"], lambda a, c: (a["surface"] == c["surface"]) & (a["category"] == c["category"]))


def corroborated(kept: Column) -> Column:
    """Without ambiguous terms, unless a solid one that isn't weak backs them."""
    solid = F.exists(kept, lambda t: ~t["ambiguous"] & (t["category"] != WEAK))
    return F.when(solid, kept).otherwise(F.filter(kept, lambda t: ~t["ambiguous"]))


_ORDER = ("msg_idx", "pack_idx", "entry_idx", "canonical_id", "out_id", "surface", "scoped", "category", "weight", "ambiguous", "ts_ms")


def terms_of(matches: DataFrame, keep: Callable[[Column], Column] = claimed, *by: str) -> DataFrame:
    """One row per term that `keep` leaves of a conversation's matches. Repeats of a surface beyond its first message go
    before anything is collected, so a conversation's array is no longer than the dictionary."""
    by = by or ("conv_id",)
    row = F.struct(*_ORDER)
    firsts = matches.groupBy(*by, "pack_idx", "entry_idx").agg(F.min(row).alias("x"))
    kept = firsts.groupBy(*by).agg(F.array_sort(F.collect_list("x")).alias("xs")).select(*by, F.explode(keep(F.col("xs"))).alias("x"))
    return kept.select(*by, "x.*")


def with_seams(messages: DataFrame, words: int) -> DataFrame:
    """messages with `seam`: the last words - 1 words that the sender said before, and the first ones of this message."""
    if words < 2:
        return messages
    # messages without words lie in a window of their own, so that `words - 1` earlier rows hold that many words
    mute = ~F.col("text").rlike(r"\S")
    before = F.collect_list("text").over(Window.partitionBy("conv_id", "sender", "mute").orderBy("msg_idx").rowsBetween(-(words - 1), -1))
    parts = lambda t: F.filter(F.split(t, r"\s+"), lambda w: w != "")
    earlier = parts(F.array_join("before", " "))
    late = F.slice(earlier, F.greatest(F.size(earlier) - words + 2, F.lit(1)), words - 1)
    seam = F.array_join(F.concat(late, F.slice(parts(F.col("text")), 1, words - 1)), " ")
    out = messages.withColumn("mute", mute).withColumn("before", before)
    return out.withColumn("seam", F.when((F.col("sender") != "") & (F.size("before") > 0) & ~F.col("mute"), seam).otherwise("")).drop("mute", "before")
