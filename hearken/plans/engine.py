"""The whole analysis: messages to one explained verdict per conversation.

Messages are shuffled once, by conv_id, where they are capped. Everything after it is a projection, a broadcast of the
dictionary, or an aggregate within conversations, which that partitioning serves; decisions are expressions over a
conversation's row. What a conversation's row may hold is bounded by the cap (2,000 messages of 4,000 characters).
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearken.config import AGE_BANDS, CONFIG, RISKS, STAGE_OF, STAGES, WEAK, EngineConfig
from hearken.functions import text as T
from hearken.operators import matching as M
from hearken.sources import packs as P
from hearken.sources.synthetic import DICTIONARIES

DAY = 86_400_000
REASONS = ("none_low_risk", "confident_local_proof", "uncertain_needs_llm")
_STRINGS = "array<string>"


def _none(kind: str = _STRINGS) -> Column:
    return F.array().cast(kind)


def _listed(pairs: Iterable[tuple[Column, str]]) -> Column:
    """The names whose conditions hold, in order."""
    out = [F.when(c, F.lit(n)) for c, n in pairs]
    return F.array_compact(F.array(*out)) if out else _none()


def _total(pairs: Iterable[tuple[Column, float]]) -> Column:
    return sum((F.when(c, float(v)).otherwise(0.0) for c, v in pairs), F.lit(0.0))


def _has(mask: Column, i: int) -> Column:
    return mask.bitwiseAND(1 << i) != 0


def _bits(flags: Iterable[Column]) -> Column:
    return sum((F.when(c, F.lit(1 << i)).otherwise(0) for i, c in enumerate(flags)), F.lit(0)).cast("long")


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of value, which is worked out once however often f names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _sealed(d: DataFrame) -> DataFrame:
    """d, as something that isn't a function of its row alone, as far as the optimizer knows: filters and joins on what comes
    after aren't rewritten in terms of all that came before, whose constraints grow without bound."""
    rest = [c for c in d.columns if c != "conv_id"]
    return d.select("conv_id", F.when(F.monotonically_increasing_id() >= 0, F.struct(*rest)).alias("v")).select("conv_id", "v.*")


def messages_of(conversations: DataFrame, base_ms: int = 1_750_000_000_000) -> DataFrame:
    """conversations(conv_id, turn, role, text) as messages; a turn is a minute, the sender is the role."""
    return conversations.select(
        "conv_id",
        F.col("turn").cast("int").alias("msg_idx"),
        F.coalesce("text", F.lit("")).alias("text"),
        (F.lit(base_ms) + F.col("turn") * 60_000).alias("ts_ms"),
        F.col("role").alias("sender"),
        F.lit(None).cast("string").alias("source"),
    )


def cap(messages: DataFrame, config: EngineConfig = CONFIG) -> DataFrame:
    """Of more than max_messages the first head_messages and the last rest stay, texts are cut (in UTF-16 units)."""
    most = config.max_chars
    cut = F.when(F.col("text").rlike(r"[\x{10000}-\x{10FFFF}]"), F.decode(F.substring(F.encode("text", "UTF-16BE"), 1, 2 * most), "UTF-16BE")).otherwise(F.substring("text", 1, most))
    own = Window.partitionBy("conv_id")
    order = [c for c in ("msg_idx", "ts_ms", "text") if c in messages.columns]
    at = messages.withColumn("text", F.when(F.length("text") * 2 > most, cut).otherwise(F.col("text")))
    at = at.withColumn("rn", F.row_number().over(own.orderBy(*order))).withColumn("n", F.count("*").over(own))
    stays = (F.col("n") <= config.max_messages) | (F.col("rn") <= config.head_messages) | (F.col("rn") > F.col("n") - (config.max_messages - config.head_messages))
    return at.where(stays).drop("rn", "n")


# --- rules over sets ----------------------------------------------------------------------------------------------
def feature_flags(features: tuple[P.Feature, ...], lexicons: list[str], mask: Column) -> list[Column]:
    """Whether each feature holds in a message, from the bits of the lexicons that occur in it."""
    bits = lambda f: sum(1 << lexicons.index(x) for x in f.lexicons)
    out: dict[str, Column] = {}
    for f in sorted(features, key=lambda f: f.logic == "NEGATED"):
        seen = mask.bitwiseAND(bits(f))
        if f.logic == "NEGATED":
            out[f.name] = seen == 0
            if f.gate:
                out[f.name] = out[f.name] & M._any([out[g] for g in f.gate if g in out] or [F.lit(False)])
        else:
            out[f.name] = (seen == bits(f)) & F.lit(bool(f.lexicons)) if f.logic == "ALL" else seen != 0
    return [out[f.name] for f in features]


def combinations_fired(combinations: tuple[P.Combination, ...], features: tuple[P.Feature, ...], mask: Column) -> list[tuple[Column, P.Combination]]:
    """Each combination with whether all its features hold, from the bits of a conversation's features."""
    names = [f.name for f in features]
    need = lambda c: sum(1 << names.index(x) for x in set(c.features))
    return [(mask.bitwiseAND(need(c)) == need(c), c) for c in combinations]


def rules_fired(categories: Column, n_messages: Column, packs: tuple[P.Pack, ...]) -> Column:
    """Ids of the multi-category rules that hold; a rule with both clauses may be listed twice. categories: an array
    of 'pack:category'."""
    out = []
    plain = F.array_distinct(F.transform(categories, lambda c: F.substring_index(c, ":", -1)))
    for p in packs:
        for r in p.rules:
            name = P.out_id(p, r.id)
            if r.categories_required:
                need = F.lit(True)
                for q, c in r.categories_required:
                    need = need & (F.array_contains(categories, f"{q}:{c}") if q else F.array_contains(plain, c))
                out.append((need & (n_messages >= r.min_messages), name))
            if r.min_categories is not None:
                out.append(((F.size(plain) >= r.min_categories) & (n_messages >= r.min_messages), name))
    return _listed(out)


def n0_mask(text: Column, n: P.Normalizer) -> Column:
    """The bits of the layer-0 features of a text: substrings, not words."""
    has = {k: M._any([text.contains(s.lower()) for s in entries] or [F.lit(False)]) for k, entries in n.lexicons}
    return _bits([(lambda hit: ~hit if f.logic == "NEGATED" else hit)(M._any([has[x] for x in f.lexicons] or [F.lit(False)])) for f in n.features])


def intent_mask(text: Column, patterns: P.Patterns) -> Column:
    """The bits of the intents of a text in lower case."""
    return _bits([M._any([T.may_match(text, r) & text.rlike(T.js_pattern(r)) for r in regexes] or [F.lit(False)]) for _, regexes in patterns.intents])


# --- time ---------------------------------------------------------------------------------------------------------
def progress(stages: Column, config: EngineConfig = CONFIG) -> Column:
    """struct(stages, ordered, span_days, rules, timeline) of an array of struct(first, ord, k, last, days), one per stage seen."""
    line = F.array_sort(F.transform(stages, lambda s: F.struct(s["first"].alias("first"), s["ord"].alias("ord"), s["k"].alias("k"))))
    ks = F.transform(line, lambda s: s["k"])
    n = F.size(stages)
    ordered = (n >= 2) & (F.to_json(ks) == F.to_json(F.array_sort(ks)))
    span = F.array_max(F.transform(stages, lambda s: s["last"])) - F.array_min(F.transform(stages, lambda s: s["first"]))
    slow = (n >= 3) & ordered & (F.array_contains(ks, 2) | F.array_contains(ks, 3)) & (span >= config.chain_hours * 3_600_000)
    alone = F.exists(stages, lambda s: (s["k"] == 2) & (s["days"] >= 2)) & (n >= 2) & (span >= config.isolation_days * DAY)
    name = lambda k: F.get(F.array(*map(F.lit, STAGES)), k)
    return F.struct(
        F.transform(ks, name).alias("stages"),
        ordered.alias("ordered"),
        F.coalesce(F.round(span / DAY, 2), F.lit(0.0)).alias("span_days"),
        _listed([(slow, "TCR-001"), (alone, "TCR-002")]).alias("rules"),
        F.transform(line, lambda s: F.struct(name(s["k"]).alias("stage"), s["first"].alias("first_seen_at"))).alias("timeline"),
    )


def burst(n: Column, lo: Column, hi: Column, config: EngineConfig = CONFIG) -> tuple[Column, Column]:
    """(seconds between the first and the last hit, whether they are a burst); 0 and false for few hits."""
    window = F.when(n >= config.velocity_hits, F.round((hi - lo) / 1000).cast("long")).otherwise(0)
    return window, F.coalesce((n >= config.velocity_hits) & (window <= config.velocity_seconds), F.lit(False))


def stage_index(category: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in STAGE_OF.items() for x in kv])
    return F.when(category.isin(*STAGE_OF), F.element_at(table, category))


def timeline(hits: DataFrame, config: EngineConfig = CONFIG) -> DataFrame:
    """hits(conv_id, category, ts_ms, ord): stages by first time, order, span and the slow-burn rules."""
    staged = hits.withColumn("k", stage_index(F.col("category"))).where("k is not null")
    days = F.count_distinct(F.floor(F.col("ts_ms") / DAY))
    first = staged.groupBy("conv_id", "k").agg(F.min("ts_ms").alias("first"), F.min("ord").alias("ord"), F.max("ts_ms").alias("last"), days.alias("days"))
    line = first.groupBy("conv_id").agg(F.collect_list(F.struct("first", "ord", "k", "last", "days")).alias("s"))
    return line.select("conv_id", progress(F.col("s"), config).alias("p")).select("conv_id", "p.stages", "p.ordered", "p.span_days", F.col("p.rules").alias("temporal_rules"), "p.timeline")


def velocity(hits: DataFrame, config: EngineConfig = CONFIG) -> DataFrame:
    """hits(conv_id, ts_ms): the span of all hits in seconds, and whether it is a burst."""
    agg = hits.groupBy("conv_id").agg(F.count("*").alias("n_hits"), F.min("ts_ms").alias("lo"), F.max("ts_ms").alias("hi"))
    window, fast = burst(F.col("n_hits"), F.col("lo"), F.col("hi"), config)
    return agg.select("conv_id", "n_hits", window.alias("window_s"), fast.alias("velocity"))


# --- actors -------------------------------------------------------------------------------------------------------
_PROFILE = "sender:string,categories:array<string>,directed:int,score:double"


def actor_of(messages: Column, config: EngineConfig = CONFIG) -> Column:
    """array of profiles, in order of first appearance, from struct(sender, es) in order of messages; senders are not blank."""
    senders = F.array_distinct(F.transform(F.filter(messages, lambda m: m["sender"] != ""), lambda m: m["sender"]))

    def profile(s: Column) -> Column:
        own = F.flatten(F.transform(F.filter(messages, lambda m: m["sender"] == s), lambda m: F.filter(m["es"], lambda e: e["layer"] == M.TERM)))
        order = F.array_sort(F.transform(own, lambda e: F.struct(*(e[c].alias(c) for c in ("pack_idx", "entry_idx", "canonical_id", "surface", "category", "weight", "ambiguous")))))
        kept = M.corroborated(M.claimed(F.array_distinct(order)))
        return F.struct(s.alias("sender"), kept.alias("kept"))

    def summary(p: Column) -> Column:
        cats = F.array_distinct(F.transform(p["kept"], lambda t: t["category"]))
        directed = F.size(F.filter(cats, lambda c: c.isin(*config.directed)))
        return F.struct(p["sender"].alias("sender"), cats.alias("categories"), directed.alias("directed"), F.aggregate(p["kept"], F.lit(0.0), lambda a, t: a + t["weight"]).alias("score"))

    return F.transform(F.transform(senders, profile), summary)


def asymmetry(profiles: Column, config: EngineConfig = CONFIG) -> dict[str, Column]:
    """analyzed (two senders or more), aggressor or null, concentration (rounded), actor_rules of an array of profiles."""
    counts = F.transform(profiles, lambda p: p["directed"])
    total = F.aggregate(counts, F.lit(0), lambda a, x: a + x)
    top, analyzed = F.array_max(counts), F.size(profiles) >= 2
    share = F.when(analyzed & (total > 0), top / total).otherwise(0.0)
    fires = F.coalesce(analyzed & (top >= config.min_directed) & (share >= config.concentration), F.lit(False))
    who = F.get(profiles, F.array_position(counts, top).cast("int") - 1)["sender"]
    return {"analyzed": analyzed, "aggressor": F.when(fires, who), "concentration": F.round(share, 2), "actor_rules": _listed([(fires, "ACR-001")])}


def actors(messages: DataFrame, packs: tuple[P.Pack, ...], config: EngineConfig = CONFIG, key: Callable[[str], str] = P.fold_key) -> DataFrame:
    """Per conversation of messages (conv_id, msg_idx, sender, text): whether senders could be compared, aggressor, concentration."""
    rows = M.surface_rows(P.Dictionaries(packs), key)
    seen = M.matched(M.with_seams(messages, M.longest(rows)), rows, ["conv_id", "msg_idx", "sender"])
    per = seen.groupBy("conv_id", "msg_idx", "sender").agg(F.collect_set("e").alias("es"))
    conv = per.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("msg_idx", "sender", "es"))).alias("m"))
    got = conv.withColumn("profiles", actor_of(F.col("m"), config))
    got = got.withColumn("profiles", F.when(F.size("profiles") >= 2, F.col("profiles")).otherwise(F.array().cast(f"array<struct<{_PROFILE}>>")))
    return got.withColumns(asymmetry(F.col("profiles"), config)).select("conv_id", "analyzed", "aggressor", "concentration")


# --- fusion -------------------------------------------------------------------------------------------------------
def weigh(terms: Column, matched: Column, explicit: Column, band: Column, dampeners: tuple[P.Dampener, ...], config: EngineConfig = CONFIG) -> Column:
    """terms with points (weight by age and the strongest dampener, rounded) and the ids of the dampeners that apply."""
    ages = {f"{b}:{c}": f for b, by in config.age_factor.items() for c, f in by.items()}
    table = F.create_map(*[F.lit(x) for kv in ages.items() for x in kv])
    rows = [F.struct(F.lit(d.id).alias("id"), F.array(*map(F.lit, d.categories)).alias("cats"), F.lit(d.factor).alias("factor")) for d in dampeners]

    def one(t: Column) -> Column:
        at = F.concat(band, F.lit(":"), t["category"])
        age = F.when(at.isin(*ages), F.element_at(table, at)).otherwise(1.0) if ages else F.lit(1.0)
        if not rows:
            return F.struct(t.alias("t"), F.round(t["weight"] * age).alias("points"), _none().alias("dampened_by"))
        gate = ~explicit & (t["category"] != config.never_dampened)
        on = F.filter(F.array(*rows), lambda d: gate & F.array_contains(matched, d["id"]) & F.array_contains(d["cats"], t["category"]))
        least = F.coalesce(F.array_min(F.transform(on, lambda d: d["factor"])), F.lit(1.0))
        return F.struct(t.alias("t"), F.round(t["weight"] * age * least).alias("points"), F.transform(on, lambda d: d["id"]).alias("dampened_by"))

    return F.transform(terms, one)


@dataclass(frozen=True)
class _Facts:
    """What the decisions look at, as columns of a conversation's row."""

    score: Column
    rules: Column
    velocity: Column
    backed: Column
    dampened: Column


def resolve_risk(x: _Facts, threshold: float, config: EngineConfig = CONFIG) -> Column:
    """0 to 3: the level by score and rules (which count for nothing under a dampener), MEDIUM at most without backing."""
    n = F.when(x.dampened, 0).otherwise(x.rules)
    base = F.when((x.score >= config.critical) | (n >= config.rules_critical), 3).when((x.score >= config.high) | (x.velocity & (n > 0)), 2).when(x.score >= threshold, 1).otherwise(0)
    return _let(base, lambda b: F.when((b >= 2) & ~x.backed, 1).otherwise(b))


def decide(d: DataFrame, threshold: float, hard_dampeners: list[str], config: EngineConfig = CONFIG) -> DataFrame:
    """d with risk, escalate and reason. Needs score, n_rules, active_rule, explicit, velocity, dampened, categories,
    dampeners, temporal_rules, stages, analyzed, aggressor, concentration. In order: risk, temporal floor, ceiling of
    entertainment, actor floor, reciprocity, escalation by uncertainty."""
    inside = lambda names: F.exists("categories", lambda c: c.isin(*names))
    chain, one = F.size("temporal_rules") > 0, F.col("aggressor").isNotNull()
    backed = (F.size(F.filter("categories", lambda c: c != WEAK)) >= 2) | F.col("active_rule") | F.col("explicit")
    full = F.array_contains("temporal_rules", "TCR-001") & (F.size("stages") >= 4)
    hard = F.exists("dampeners", lambda x: x.isin(*hard_dampeners)) if hard_dampeners else F.lit(False)
    mutual = F.col("analyzed") & ~one & (F.col("concentration") <= config.reciprocity) & ~F.col("active_rule") & ~inside(config.coercive) & ~chain
    r = resolve_risk(_Facts(F.col("score"), F.col("n_rules"), F.col("velocity"), backed, F.col("dampened")), threshold, config)
    r = F.greatest(r, F.when(full, 2).when(chain, 1).otherwise(0))
    r = _let(r, lambda x: F.when(hard & ~inside(config.action) & ~chain & (x >= 2), 1).otherwise(x))
    r = F.greatest(r, F.when(one, 1).otherwise(0))
    r = _let(r, lambda x: F.when(mutual & (x == 1), 0).otherwise(x))
    d = _sealed(d.withColumn("r", r).withColumn("proof", F.col("active_rule") | F.col("explicit") | one | chain))
    sure = (F.col("r") >= 2) & F.col("proof")
    reason = F.when(F.col("r") == 0, REASONS[0]).when(sure, REASONS[1]).otherwise(REASONS[2])
    return d.withColumns({"escalate": (F.col("r") > 0) & ~sure, "reason": reason, "risk": F.get(F.array(*map(F.lit, RISKS)), F.col("r"))}).drop("r", "proof")


def intervene(d: DataFrame, config: EngineConfig = CONFIG) -> DataFrame:
    """d with `verdict`: what the recruiter sees, what protects the minor, and what the user interface shows."""
    low, grave = F.col("risk") == "LOW", F.col("risk").isin("HIGH", "CRITICAL")
    full = F.array_contains("temporal_rules", "TCR-001") & (F.size("stages") >= 4)
    imminent = ((F.col("risk") == "CRITICAL") & F.array_contains("categories", config.imminent)) | full
    acts = lambda *x: F.array(*map(F.lit, x))
    case = lambda none, now, quiet, soft: F.when(low, none).when(imminent, now).when(grave, quiet).otherwise(soft)
    action = case("ALLOW", "HARD_BLOCK", "SILENT_OBSERVE", "SOFT_WARN")
    watch = F.when(F.col("aggressor").isNotNull(), acts("SHADOW_FLAG", "WARN_MINOR", "RESTRICT_CONTACT")).otherwise(acts("SHADOW_FLAG", "WARN_MINOR"))
    protect = case(_none(), acts("PRESERVE_EVIDENCE", "NOTIFY_GUARDIAN", "RESTRICT_CONTACT", "WARN_MINOR"), watch, acts("SHADOW_FLAG"))
    null = F.lit(None).cast("string")
    why = case("no risk", "imminent danger: contact is cut and evidence kept", "high risk: watched in silence, the minor is told", "grey zone: soft friction")
    return d.withColumn(
        "verdict",
        F.struct(
            action.alias("recruiter_action"),
            protect.alias("protective_actions"),
            case(null, F.lit(config.urgent_message), F.lit(config.calm_message), null).alias("minor_message"),
            why.alias("rationale"),
            F.when(low, "NINGUNA").otherwise("CAPTACION").alias("stage"),
            F.when(low, "NONE").when(action == "HARD_BLOCK", "HARD_BLOCK").otherwise("WARNING_OVERLAY").alias("ux_recommendation"),
            F.when(low, config.quiet_summary).otherwise(config.alert_summary).alias("summary"),
            F.lit(1.0).alias("confidence"),
            F.lit(False).alias("false_positive"),
        ),
    )


def zero(n: P.Normalizer, config: EngineConfig = CONFIG) -> dict[str, Column]:
    """Score, features and rules of layer 0, from the bits `n0` and `marks` of a conversation's row."""
    n0, n_marks = F.col("n0"), F.bit_count("marks")
    fired, held = combinations_fired(n.combinations, n.features, n0), [(_has(n0, i), f) for i, f in enumerate(n.features)]
    return {
        "n0_score": _total([*((c, f.weight) for c, f in held), *((c, x.bonus) for c, x in fired)]) + F.least(config.evasion_points * n_marks, F.lit(config.evasion_most)),
        "n0_features": _listed((c, f.id) for c, f in held),
        "n0_rules": _listed([*((c, x.id) for c, x in fired), (n_marks > 0, "N0-EVASION")]),
    }


def _by_conversation(messages: DataFrame, config: EngineConfig) -> DataFrame:
    """The messages that stay. One shuffle; its number of partitions is kept, for the work per row is far more than its bytes."""
    return cap(messages.repartition(int(messages.sparkSession.conf.get("spark.sql.shuffle.partitions")), "conv_id"), config)


def layer_zero(messages: DataFrame, n: P.Normalizer = DICTIONARIES.normalizer, config: EngineConfig = CONFIG) -> DataFrame:
    """conv_id and what layer 0 says of it, as in analyze, which needs no dictionary of surfaces."""
    own = messages.select("conv_id", "msg_idx", F.coalesce("text", F.lit("")).alias("text"), F.col("ts_ms").cast("long").alias("ts_ms"), "source")
    norm = T.normalized(_by_conversation(own, config), n, source="source")
    per = norm.select("conv_id", n0_mask(F.col("norm"), n).alias("n0"), _bits([F.col(x) for x in T.MARKERS]).alias("marks"))
    return per.groupBy("conv_id").agg(F.bit_or("n0").alias("n0"), F.bit_or("marks").alias("marks")).select("conv_id", *(c.alias(k) for k, c in zero(n, config).items()))


# --- the whole ----------------------------------------------------------------------------------------------------
def _accented(n: P.Normalizer) -> tuple[str, str]:
    """Accented characters that replacements bring in after accents went, and their plain forms."""
    chars = sorted({c for pairs in (n.misspellings, n.abbreviations, n.phonetic) for _, put in pairs for c in put.lower() if len(P.fold_key(c)) == 1 != (P.fold_key(c) == c)})
    return "".join(chars), "".join(map(P.fold_key, chars))


def analyze(
    messages: DataFrame,
    dictionaries: P.Dictionaries = DICTIONARIES,
    config: EngineConfig = CONFIG,
    full_normalize: bool = True,
    now_ms: int | None = None,
    raw_features: Callable[[Column], dict[str, Column]] | None = None,
    normalize: tuple[Callable[[DataFrame], DataFrame], Callable[[str], str]] | None = None,
    strategy: str | None = None,
) -> DataFrame:
    """One row per conversation of messages (conv_id, msg_idx, text, ts_ms, sender, source), silent ones included (LOW).

    An age_band column applies the weights of that band; unknown bands count as none. Messages without a time, and hits
    of layer 0, have now_ms (if not given, the conversation's latest time). Null texts are empty, null senders nobody;
    messages of one msg_idx are ordered by time and text. raw_features gives sums per message of its raw text, kept as
    `raw`. normalize replaces the normalizer: it adds norm, unicode, spacing, leet and labels to text and source; its like
    makes keys of surfaces. Other columns are ignored; no messages give no rows.
    """
    P.validate_all(dictionaries)
    n, pat, damp = dictionaries.normalizer if full_normalize and not normalize else P.Normalizer(), dictionaries.patterns, dictionaries.dampeners
    if normalize:
        steps, key = normalize
    elif full_normalize:
        steps, key = (lambda df: T.normalized(df, n, source="source", labels=True)), (lambda s: T.normalize_surface(s, n).strip())
    else:
        steps, key = (lambda df: df.withColumns({"norm": T.fold(F.col("text")), **{x: F.lit(False) for x in T.MARKERS}, "labels": _none()})), P.fold_key
    rows = M.surface_rows(dictionaries, key)
    band = F.when(F.col("age_band").isin(*AGE_BANDS), F.col("age_band")) if "age_band" in messages.columns else F.lit(None).cast("string")
    own = messages.select("conv_id", "msg_idx", F.coalesce("text", F.lit("")).alias("text"), F.col("ts_ms").cast("long").alias("ts_ms"), F.coalesce("sender", F.lit("")).alias("sender"), "source", band.alias("age_band"))
    own = _by_conversation(own, config).withColumn("msg_idx", F.row_number().over(Window.partitionBy("conv_id").orderBy("msg_idx", "ts_ms", "text")))
    raw = raw_features(F.col("text")) if raw_features else {}
    norm = own.withColumn("raw", F.struct(*(c.cast("double").alias(k) for k, c in raw.items())) if raw else F.lit(None).cast("struct<none:double>"))
    norm = steps(norm).select("conv_id", "msg_idx", "ts_ms", "sender", "age_band", "raw", "labels", F.col("norm").alias("text"), _bits([F.col(x) for x in T.MARKERS]).alias("marks"))
    folds = _accented(n)
    plain = F.translate(F.lower("text"), *folds) if folds[0] else F.lower("text")
    norm = norm.withColumns({"n0": n0_mask(F.col("text"), n), "intents": intent_mask(plain, pat)})
    seen = M.matched(M.with_seams(norm, M.longest(rows)), rows, keep := ["conv_id", "msg_idx", "ts_ms", "sender", "age_band", "raw", "labels", "marks", "n0", "intents"], folds, strategy)
    per = seen.groupBy(*keep).agg(F.bit_or("mask").alias("mask"), F.collect_set("e").alias("es"))
    per = per.withColumn("v4", _bits(feature_flags(pat.features, [k for k, _ in pat.lexicons], F.col("mask"))))
    both = F.bit_or
    conv = per.groupBy("conv_id").agg(
        F.count("*").alias("n_messages"),
        F.max("ts_ms").alias("last_ms"),
        F.max("age_band").alias("age_band"),
        *(both(c).alias(c) for c in ("marks", "n0", "v4", "intents")),
        F.array_distinct(F.flatten(F.collect_list("labels"))).alias("labels"),
        F.struct(*(F.sum(f"raw.{k}").alias(k) for k in raw)).alias("raw") if raw else F.lit(None).cast("struct<none:double>").alias("raw"),
        F.array_sort(F.collect_list(F.struct("msg_idx", "sender", "ts_ms", "es"))).alias("m"),
    )
    now = F.coalesce(F.lit(now_ms).cast("long"), F.col("last_ms"), F.lit(0))
    conv = conv.withColumn("now", now).withColumn("late", F.coalesce("last_ms", "now"))

    def candidates(layer: int) -> Column:
        some = lambda x: F.transform(F.filter(x["es"], lambda e: (e["layer"] == layer) & ~e["seam"]), lambda e: F.struct(x["msg_idx"].alias("msg_idx"), *(e[c].alias(c) for c in M._ORDER[1:-1]), F.coalesce(x["ts_ms"], F.col("now")).alias("ts_ms")))
        return F.array_sort(F.flatten(F.transform("m", some)))

    ids = lambda c: F.transform(c, lambda x: x["out_id"])
    once = lambda c: M.first_of_each(c, lambda a, b: a["canonical_id"] == b["canonical_id"])
    d = conv.withColumns({"terms_found": candidates(M.TERM), "signals_found": candidates(M.SIGNAL), "dampeners_found": candidates(M.DAMPENER), "profiles": actor_of(F.col("m"), config)}).drop("m")
    d = d.withColumns({"kept": M.corroborated(M.claimed(F.col("terms_found"))), "said": once(F.col("signals_found")), "damp": once(F.col("dampeners_found"))}).drop("terms_found", "signals_found", "dampeners_found")
    d = d.withColumn("profiles", F.when(F.size("profiles") >= 2, F.col("profiles")).otherwise(F.array().cast(f"array<struct<{_PROFILE}>>")))
    d = d.withColumns({"signals": ids(F.col("said")), "dampeners": ids(F.col("damp")), "explicit": F.size("said") > 0, **asymmetry(F.col("profiles"), config)})
    d = d.withColumn("weighed", weigh(F.col("kept"), F.col("dampeners"), F.col("explicit"), F.col("age_band"), damp, config))

    marks, v4 = F.col("marks"), F.col("v4")
    n_marks = F.bit_count(marks)
    n_intents = F.bit_count("intents")
    fired4 = combinations_fired(pat.combinations, pat.features, v4)
    grooming = n_intents >= config.intents_needed
    held4 = [(_has(v4, i), f) for i, f in enumerate(pat.features)]
    points = lambda held, fired: _total([*((c, f.weight) for c, f in held), *((c, x.bonus) for c, x in fired)])
    d = d.withColumns(
        {
            **zero(n, config),
            "transformations": F.array_distinct(F.concat(_listed((_has(marks, i), T.LABELS[x]) for i, x in enumerate(T.MARKERS)), "labels")),
            "v3_original": F.aggregate("kept", F.lit(0.0), lambda a, t: a + t["weight"]),
            "v3_score": F.aggregate("weighed", F.lit(0.0), lambda a, t: a + t["points"]),
            "v3_terms": F.array_distinct(ids(F.col("kept"))),
            "v3_categories": F.array_distinct(F.transform("kept", lambda t: t["category"])),
            "dampeners_applied": F.array_distinct(F.flatten(F.transform("weighed", lambda t: t["dampened_by"]))),
            "mcr": rules_fired(F.array_distinct(F.transform("kept", lambda t: t["scoped"])), F.col("n_messages"), dictionaries.packs),
            "v4_score": points(held4, fired4) + F.aggregate("said", F.lit(0.0), lambda a, s: a + s["weight"]) + _total([(grooming, config.intents_bonus)]),
            "v4_features": _listed((c, f.name) for c, f in held4),
            "cr": _listed([*((c, x.id) for c, x in fired4), (grooming, config.intents_rule)]),
        }
    )
    # hits in the order of the layers: what belongs to no single message counts at the latest one
    n_late = F.size("v4_features") + grooming.cast("int")
    n_zero = F.size("n0_features") + (n_marks > 0).cast("int")
    timed = F.concat(*(F.transform(c, lambda t: F.struct(t["category"].alias("category"), t["ts_ms"].alias("ts_ms"))) for c in ("kept", "said")), F.when(grooming, F.array(F.struct(F.lit(config.intents_category).alias("category"), F.col("late").alias("ts_ms")))).otherwise(F.array().cast("array<struct<category:string,ts_ms:bigint>>")))
    d = d.withColumn("hits", timed).withColumn("n_hits", F.size("kept") + F.size("said") + n_late + n_zero)
    times = F.concat(F.transform("hits", lambda h: h["ts_ms"]), F.when(n_late > 0, F.array("late")).otherwise(_none("array<bigint>")), F.when(n_zero > 0, F.array("now")).otherwise(_none("array<bigint>")))
    d = d.withColumn("times", times)
    window, fast = burst(F.col("n_hits"), F.array_min("times"), F.array_max("times"), config)
    placed = F.transform("hits", lambda h, i: F.struct(stage_index(h["category"]).alias("k"), h["ts_ms"].alias("ts"), i.alias("ord")))
    d = d.withColumns({"window_s": window, "velocity": fast, "placed": F.filter(placed, lambda p: p["k"].isNotNull())})


    def stage(k: Column) -> Column:
        own = F.filter("placed", lambda p: p["k"] == k)
        return F.struct(F.array_min(F.transform(own, lambda p: p["ts"])).alias("first"), F.array_min(F.transform(own, lambda p: p["ord"])).alias("ord"), k.alias("k"), F.array_max(F.transform(own, lambda p: p["ts"])).alias("last"), F.size(F.array_distinct(F.transform(own, lambda p: F.floor(p["ts"] / DAY)))).alias("days"))

    seen_stages = F.filter(F.transform(F.array(*map(F.lit, range(len(STAGES)))), stage), lambda s: s["first"].isNotNull())
    d = _sealed(d.withColumn("line", seen_stages).drop("placed")).withColumn("p", progress(F.col("line"), config))
    d = d.withColumns({"stages": F.col("p.stages"), "ordered": F.col("p.ordered"), "span_days": F.col("p.span_days"), "temporal_rules": F.col("p.rules"), "timeline": F.col("p.timeline")})
    said_categories = F.transform("said", lambda s: s["category"])
    n_rules = F.size("mcr") + F.size("cr")
    d = d.withColumns({"categories": F.array_union("v3_categories", said_categories), "n_rules": n_rules, "active_rule": (n_rules > 0) | (F.size("n0_rules") > 0), "dampened": F.size("dampeners_applied") > 0})
    total = F.col("n0_score") + F.col("v3_score") + F.col("v4_score")
    d = d.withColumn("score", F.when(F.col("velocity") & F.col("active_rule"), F.round(total * config.velocity_bonus)).otherwise(total))
    d = _sealed(d.drop("m", "kept", "said", "damp", "weighed", "hits", "times", "p", "line"))
    d = intervene(_sealed(decide(d, dictionaries.packs[0].threshold, [x.id for x in damp if x.hard_context], config)), config)
    versions = F.create_map(*[F.lit(x) for p in dictionaries.packs for x in (p.id, p.version)])
    d = d.withColumns({"pack_versions": versions, "hot_version": F.lit(dictionaries.hot_version).cast("int")})
    return _sealed(d.select(*RESULT, *(["raw"] if raw else [])))


RESULT = (
    "conv_id n_messages score risk escalate reason verdict categories n0_score n0_features n0_rules transformations v3_score v3_original v3_terms v3_categories "
    "mcr dampeners dampeners_applied v4_score v4_features cr signals stages ordered span_days temporal_rules timeline velocity window_s n_hits "
    "analyzed aggressor concentration actor_rules profiles age_band pack_versions hot_version"
).split()


def flat(result: DataFrame) -> DataFrame:
    """analyze's rows with arrays joined by commas and the verdict's action, stage and user interface as columns."""
    joined = [c for c, kind in result.dtypes if kind == _STRINGS]
    rest = [c for c in result.columns if c not in (*joined, "verdict", "timeline", "profiles", "pack_versions", "raw")]
    acts = ("recruiter_action", "stage", "ux_recommendation")
    versions = F.array_join(F.transform(F.map_entries("pack_versions"), lambda e: F.concat_ws("=", e["key"], e["value"])), ",")
    return result.select(*rest, *(F.array_join(c, ",").alias(c) for c in joined), *(F.col(f"verdict.{a}").alias(a) for a in acts), F.array_join("verdict.protective_actions", ",").alias("protective_actions"), versions.alias("versions"))
