"""Queries over the tables of a folder, one per operator family, and the SQL that gives the same rows in DuckDB."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hearken import sql as Q
from hearken.config import AGE_BANDS, CONFIG, STAGE_OF
from hearken.functions import text as T
from hearken.operators import evaluate as V
from hearken.operators import features as X
from hearken.operators import matching as M
from hearken.plans import engine as E
from hearken.sources import packs as P
from hearken.sources import synthetic as Y
from hearken.streaming import sessions as S

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
#: What kind of hit an event stands for.
EVENT_CATEGORY = {"click": "reclutamiento", "view": "señal_debil", "purchase": "logistica_fisica", "signup": "aislamiento", "logout": "oferta_economica", "login": "manipulacion_social", "search": "redes_sociales_vector"}
PACKS = (Y.MX, Y.EU)
N, PAT, DAMP = Y.NORMALIZER, Y.PATTERNS, Y.DAMPENERS


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _messages(spark: SparkSession, d: str) -> DataFrame:
    return E.messages_of(_t(spark, d, "conversations"))


def _folded(spark: SparkSession, d: str) -> DataFrame:
    return _messages(spark, d).withColumn("text", T.fold(F.col("text")))


def _joined(c: str | Column) -> Column:
    return F.array_join(F.array_sort(c), ",")


# --- text ---------------------------------------------------------------------------------------------------------
@query("accent_fold", "SELECT conv_id, turn, strip_accents(text) AS text FROM conversations")
def accent_fold(spark, d):
    return _t(spark, d, "conversations").select("conv_id", "turn", T.remove_accents(F.col("text")).alias("text"))


@query("collapse_repeated", f"SELECT doc_id, {Q.squeezed('text', 3, 'two')} AS text FROM documents")
def collapse_repeated(spark, d):
    return _t(spark, d, "documents").select("doc_id", T.collapse_repeated(F.col("text")).alias("text"))


_FILLERS = ("(?:m{2,}|em+|eh+)", "este", "pues", "o\\s+sea")
_SPEECH = f"regexp_replace(lower({Q.trimmed('text')}), '[-!,.:;?¡¿–—…]+', ' ', 'g')"
for _f in _FILLERS:
    _SPEECH = f"regexp_replace({_SPEECH}, '(^|[^\\p{{L}}\\p{{N}}])(?:{_f})($|[^\\p{{L}}\\p{{N}}])', '\\1 \\2', 'g')"


@query("voice_preprocess", f"SELECT conv_id, turn, trim(regexp_replace({_SPEECH}, '\\s+', ' ', 'g')) AS text FROM conversations")
def voice_preprocess(spark, d):
    return _t(spark, d, "conversations").select("conv_id", "turn", T.preprocess_voice(F.col("text")).alias("text"))


@query("abbrev_expand", f"SELECT conv_id, turn, {Q.unshortened('text', N.abbreviations)} AS text FROM conversations")
def abbrev_expand(spark, d):
    return _t(spark, d, "conversations").select("conv_id", "turn", T.expand_abbreviations(F.col("text"), N.abbreviations).alias("text"))


@query("symbol_expand", f"SELECT doc_id, {Q.replaced('text', N.symbols, ' ')} AS text FROM documents")
def symbol_expand(spark, d):
    return _t(spark, d, "documents").select("doc_id", T.expand_symbols(F.col("text"), N.symbols).alias("text"))


@query("misspellings", f"SELECT doc_id, {Q.respelt('text', N.misspellings)} AS text FROM documents")
def misspellings(spark, d):
    return _t(spark, d, "documents").select("doc_id", T.fix_misspellings(F.col("text"), N.misspellings).alias("text"))


@query("phonetic", f"SELECT conv_id, turn, {Q.squeezed(Q.replaced('lower(text)', N.phonetic[:2]), 2, 'one')} AS text FROM conversations")
def phonetic(spark, d):
    return _t(spark, d, "conversations").select("conv_id", "turn", T.phonetic(F.lower("text"), N.phonetic).alias("text"))


@query("normalize", Q.with_(Q.RAW, *Q.normalized(N, "raw0")) + " SELECT conv_id, msg_idx AS turn, text, false AS unicode, false AS spacing, false AS leet FROM norm")
def normalize(spark, d):
    got = T.normalized(_t(spark, d, "conversations"), N)
    return got.select("conv_id", F.col("turn").cast("int").alias("turn"), F.col("norm").alias("text"), *T.MARKERS)


def _ranges() -> str:
    """A character class of what sanitizing changes: compatibility forms, invisible and confusable characters."""
    odd = [c for c in range(0x80, 0x30000) if not 0xD800 <= c < 0xE000 and T._sanitize(chr(c)) != chr(c)]
    out, k = [], 0
    while k < len(odd):
        j = k
        while j + 1 < len(odd) and odd[j + 1] == odd[j] + 1:
            j += 1
        out.append(f"\\x{{{odd[k]:x}}}-\\x{{{odd[j]:x}}}")
        k = j + 1
    marks = [c for c in range(0x300, 0x370) if unicodedata.combining(chr(c))]
    return f"[{''.join(out)}\\x{{{marks[0]:x}}}-\\x{{{marks[-1]:x}}}]"


_TOKEN = r"[\p{L}\p{N}$@€!|]"
_CLEAN = f"c AS (SELECT doc_id, text, lower({Q.trimmed('text')}) AS low FROM documents)"
_SPACED = r"(?:^|\s)[\p{L}\p{N}](?:\s+[\p{L}\p{N}]){3,}(?:\s|$|[.,!?])"
_MIXED = rf"\p{{L}}{_TOKEN}*[0134579$@€!|]|[0134579$@€!|]{_TOKEN}*\p{{L}}"
_MARKS = f"regexp_matches(text, {Q.q(_ranges())})::INT + regexp_matches(low, {Q.q(_SPACED)})::INT + regexp_matches(low, {Q.q(_MIXED)})::INT"


@query("evasion_markers", f"WITH {_CLEAN} SELECT doc_id, {_MARKS} AS markers, least(({_MARKS}) * 2, 6) AS bonus FROM c")
def evasion_markers(spark, d):
    s = T.evasion_bits(_t(spark, d, "documents").select("doc_id", "text"))
    n = F.bit_count("marks")
    return s.select("doc_id", n.alias("markers"), F.least(n * 2, F.lit(6)).alias("bonus"))


_TOKENS = rf"regexp_extract_all(lower(text), '{_TOKEN}+|[^\p{{L}}\p{{N}}$@€!|]+')"
_UNLEET = rf"CASE WHEN regexp_matches(t, '\p{{L}}') AND regexp_matches(t, '[0-9$@€!|]') THEN translate(t, {Q.q(T.LEET[0])}, {Q.q(T.LEET[1])}) ELSE t END"


@query("deleet", f"SELECT doc_id, array_to_string(list_transform({_TOKENS}, lambda t: {_UNLEET}), '') AS text FROM documents")
def deleet(spark, d):
    return _t(spark, d, "documents").select("doc_id", T.de_leet(F.lower("text")).alias("text"))


def _re2(p: str) -> str:
    return p.replace(T._EDGE, r"\b").replace("(?iu)", "(?i)")


_LENGTH = "(length(raw) + length(regexp_replace(raw, '[^\\x{10000}-\\x{10FFFF}]', '', 'g')))"
_PREDICATES = {"imperative": f"regexp_matches(raw, {Q.q(_re2(X.IMPERATIVE))})", "second_person": f"regexp_matches(raw, {Q.q(_re2(X.SECOND_PERSON))})", "question": "contains(raw, '?')", "money": f"regexp_matches(raw, {Q.q(_re2(X.MONEY))})", "meet": f"regexp_matches(raw, {Q.q(_re2(X.MEET))})", "length": _LENGTH}


@query("text_predicates", f"WITH {Q.NORM} SELECT conv_id, msg_idx, " + ", ".join(f"({v})::INT AS {k}" for k, v in _PREDICATES.items()) + " FROM norm")
def text_predicates(spark, d):
    return _messages(spark, d).select("conv_id", "msg_idx", *(c.alias(k) for k, c in X.text_predicates(F.col("text")).items()))


@query("cap_messages", "SELECT user_id, event_id, text FROM (SELECT user_id, event_id, substr(event_type, 1, 4) AS text, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k, count(*) OVER (PARTITION BY user_id) AS n FROM events) WHERE n <= 40 OR k <= 10 OR k > n - 30")
def cap_messages(spark, d):
    ev = _t(spark, d, "events").select(F.col("user_id").alias("conv_id"), F.col("event_id").alias("msg_idx"), F.col("event_type").alias("text"))
    return E.cap(ev, replace(CONFIG, max_messages=40, head_messages=10, max_chars=4)).select(F.col("conv_id").alias("user_id"), F.col("msg_idx").alias("event_id"), "text")


# --- matching and rules -------------------------------------------------------------------------------------------
_MX = Q.with_(Q.NORM, *Q.kept((Y.MX,)))
_TWO = Q.with_(Q.NORM, *Q.kept(PACKS))


@query("v3_match", f"{_MX} SELECT conv_id, msg_idx, out_id, surface FROM m")
def v3_match(spark, d):
    return M.match_surfaces(_folded(spark, d), (Y.MX,)).select("conv_id", "msg_idx", "out_id", "surface")


@query("v3_match_nested_loop", f"{_MX} SELECT conv_id, msg_idx, out_id, surface FROM m")
def v3_match_nested_loop(spark, d):
    return M.match_surfaces(_folded(spark, d), (Y.MX,), "nested_loop").select("conv_id", "msg_idx", "out_id", "surface")


@query("v3_match_shuffled", f"{_TWO} SELECT conv_id, msg_idx, out_id, surface FROM m")
def v3_match_shuffled(spark, d):
    """The way of dictionaries too large to broadcast."""
    return M.match_surfaces(_folded(spark, d), PACKS, "shuffle").select("conv_id", "msg_idx", "out_id", "surface")


@query("v3_first_match", f"{_MX} SELECT conv_id, out_id, surface, msg_idx, ts_ms FROM f")
def v3_first_match(spark, d):
    return M.terms_of(M.match_surfaces(_folded(spark, d), (Y.MX,))).select("conv_id", "out_id", "surface", "msg_idx", "ts_ms")


@query("v3_corroborated_score", f"{_MX} SELECT conv_id, sum(weight) AS score, count(*)::BIGINT AS n_terms, string_agg(DISTINCT category, ',' ORDER BY category) AS categories FROM k GROUP BY conv_id")
def v3_corroborated_score(spark, d):
    k = M.terms_of(M.match_surfaces(_folded(spark, d), (Y.MX,)), lambda xs: M.corroborated(M.claimed(xs)))
    return k.groupBy("conv_id").agg(F.sum("weight").alias("score"), F.count("*").alias("n_terms"), _joined(F.collect_set("category")).alias("categories"))


@query("pack_claim", f"{_TWO} SELECT conv_id, canonical_id, surface, category, msg_idx FROM f")
def pack_claim(spark, d):
    return M.terms_of(M.match_surfaces(_folded(spark, d), PACKS)).select("conv_id", "canonical_id", "surface", "category", "msg_idx")


HOT = [("MX", P.Term("HOT-1", "erhe", "slang_operativo", 30)), (None, P.Term("HOT-2", "thth", "slang_operativo", 9, ("from", "onhe", "ed")))]


@query("hot_terms_overlay", f"WITH {Q.NORM}, {Q.matches(P.add_hot_terms((Y.MX,), HOT))} SELECT out_id, surface, count(*)::BIGINT AS n FROM m GROUP BY out_id, surface")
def hot_terms_overlay(spark, d):
    return M.match_surfaces(_folded(spark, d), P.add_hot_terms((Y.MX,), HOT)).groupBy("out_id", "surface").agg(F.count("*").alias("n"))


@query("mcr_rules", f"{_TWO}, c AS (SELECT conv_id, list(DISTINCT category) AS cs, list(DISTINCT scoped) AS sc, (SELECT count(*) FROM norm n WHERE n.conv_id = k.conv_id) AS n_messages FROM k GROUP BY conv_id) SELECT conv_id, array_to_string({Q.mcr(PACKS)}, ',') AS rules FROM c")
def mcr_rules(spark, d):
    m = _folded(spark, d)
    k = M.terms_of(M.match_surfaces(m, PACKS), lambda xs: M.corroborated(M.claimed(xs))).groupBy("conv_id").agg(F.collect_set("scoped").alias("cs"))
    return k.join(m.groupBy("conv_id").agg(F.count("*").alias("n")), "conv_id").select("conv_id", F.array_join(E.rules_fired(F.col("cs"), F.col("n"), PACKS), ",").alias("rules"))


def _analysis(spark, d, dictionaries=Y.BOTH, **more) -> DataFrame:
    return E.analyze(_messages(spark, d), dictionaries, full_normalize=False, **more)


_FLAGS = Q.with_(Q.NORM, *Q.flags(Y.BOTH))


def _lexicon_sql() -> str:
    return ", ".join(f"bool_or({Q.found('text', v)}) AS {k}" for k, v in ((k, [P.fold_key(s) for s in v]) for k, v in PAT.lexicons))


@query("v4_lexicons", f"WITH {Q.NORM} SELECT conv_id, {_lexicon_sql()} FROM norm GROUP BY conv_id")
def v4_lexicons(spark, d):
    rows = M.surface_rows(Y.BOTH)
    seen = M.matched(_folded(spark, d), rows, ["conv_id", "msg_idx"]).groupBy("conv_id").agg(F.bit_or("mask").alias("mask"))
    return seen.select("conv_id", *(E._has(F.col("mask"), i).alias(k) for i, (k, _) in enumerate(PAT.lexicons)))


@query("intent_accumulation", f"{_FLAGS}, s AS (SELECT conv_id, ({' + '.join(f'\"{i}\"::INT' for i, _ in PAT.intents)})::INT AS n FROM conv) SELECT conv_id, n AS n_intents, CASE WHEN n >= 3 THEN 15.0 ELSE 0.0 END::DOUBLE AS bonus FROM s")
def intent_accumulation(spark, d):
    n = F.bit_count(F.bit_or("mask"))
    got = _folded(spark, d).select("conv_id", E.intent_mask(F.col("text"), PAT).alias("mask")).groupBy("conv_id").agg(n.alias("n_intents"))
    return got.select("conv_id", "n_intents", F.when(F.col("n_intents") >= CONFIG.intents_needed, CONFIG.intents_bonus).otherwise(0.0).alias("bonus"))


def _named(pairs) -> str:
    return f"array_to_string({Q.listing(pairs)}, ',')"


@query("v4_features", f"{_FLAGS} SELECT conv_id, {_named([(f'\"{f.name}\"', f.name) for f in PAT.features])} AS features FROM conv")
def v4_features(spark, d):
    return _analysis(spark, d).select("conv_id", F.array_join("v4_features", ",").alias("features"))


@query("v4_combination", f"{_FLAGS} SELECT conv_id, array_to_string({Q.v4_rules(PAT)}, ',') AS rules, {Q.v4_score(PAT)} AS score FROM conv")
def v4_combination(spark, d):
    return _analysis(spark, d).select("conv_id", F.array_join("cr", ",").alias("rules"), F.col("v4_score").alias("score"))


_SAID = " UNION ALL ".join(f'SELECT conv_id, {Q.q(s.id)} AS id, {Q.q(s.category)} AS category, "at_{s.id}" AS msg_idx FROM conv WHERE "{s.id}"' for s in PAT.signals)


@query("explicit_signals", f"{_FLAGS} {_SAID}")
def explicit_signals(spark, d):
    seen = M.matched(_folded(spark, d), M.surface_rows(Y.BOTH), ["conv_id", "msg_idx"]).where(F.col("e.layer") == M.SIGNAL)
    return seen.groupBy("conv_id", F.col("e.out_id").alias("id"), F.col("e.category").alias("category")).agg(F.min("msg_idx").alias("msg_idx"))


@query("dampener_match", f"{_FLAGS} SELECT conv_id, {_named([(f'\"{x.id}\"', x.id) for x in DAMP])} AS dampeners FROM conv")
def dampener_match(spark, d):
    return _analysis(spark, d).select("conv_id", _joined("dampeners").alias("dampeners"))


_ZERO = Q.with_(Q.RAW, *Q.normalized(N, "raw0"), *Q.flags(Y.BOTH, n0=True))
_ZERO_RULES = Q.listing([(Q.all_of(c.features), c.id) for c in N.combinations])
_ZERO_SCORE = Q.total([*((f'"{f.id}"', f.weight) for f in N.features), *((Q.all_of(c.features), c.bonus) for c in N.combinations)])


@query("n0_layer", f"{_ZERO} SELECT conv_id, {_named([(f'\"{f.id}\"', f.id) for f in N.features])} AS features, array_to_string({_ZERO_RULES}, ',') AS rules, {_ZERO_SCORE} AS score FROM conv")
def n0_layer(spark, d):
    return E.layer_zero(_messages(spark, d)).select("conv_id", F.array_join("n0_features", ",").alias("features"), F.array_join("n0_rules", ",").alias("rules"), F.col("n0_score").alias("score"))


# --- time and actors ----------------------------------------------------------------------------------------------
def _event_hits(spark, d):
    kinds = F.create_map(*[F.lit(x) for kv in EVENT_CATEGORY.items() for x in kv])
    ms = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000).cast("long")
    return _t(spark, d, "events").select(F.col("user_id").alias("conv_id"), kinds[F.col("event_type")].alias("category"), ms.alias("ts_ms"), F.col("event_id").alias("ord"))


_EVENTS = "e AS (SELECT user_id AS conv_id, CASE event_type " + " ".join(f"WHEN '{k}' THEN {Q.q(v)}" for k, v in EVENT_CATEGORY.items()) + " END AS category, epoch_us(ts) // 1000 AS ts_ms, event_id AS ord FROM events)"
_BURST = "count(*) >= 3 AND round((max(ts_ms) - min(ts_ms)) / 1000) <= 300"


@query("velocity", f"WITH {_EVENTS} SELECT conv_id AS user_id, count(*) AS n_hits, CASE WHEN count(*) >= 3 THEN round((max(ts_ms) - min(ts_ms)) / 1000) ELSE 0 END::BIGINT AS window_s, {_BURST} AS velocity FROM e GROUP BY conv_id")
def velocity(spark, d):
    return E.velocity(_event_hits(spark, d)).withColumnRenamed("conv_id", "user_id")


_LINE = Q.with_(_EVENTS, *Q.progress("e"))


@query("stage_timeline", f"{_LINE} SELECT conv_id AS user_id, stages, ordered, span_days FROM line")
def stage_timeline(spark, d):
    return E.timeline(_event_hits(spark, d)).select(F.col("conv_id").alias("user_id"), F.array_join("stages", ",").alias("stages"), "ordered", "span_days")


@query("temporal_rules", f"{_LINE} SELECT conv_id AS user_id, array_to_string(tcr, ',') AS rules FROM line")
def temporal_rules(spark, d):
    return E.timeline(_event_hits(spark, d)).select(F.col("conv_id").alias("user_id"), F.array_join("temporal_rules", ",").alias("rules"))


@query("actor_concentration", Q.with_(Q.NORM, *Q.actor(PACKS)) + " SELECT conv_id, analyzed, aggressor, concentration FROM actor")
def actor_concentration(spark, d):
    return E.actors(_folded(spark, d), PACKS)


# --- fusion, decision, evaluation ---------------------------------------------------------------------------------
_FOLDED = Q.with_(*Q.engine(Y.BOTH, [Q.NORM]))
_KEY = lambda s: T.normalize_surface(s, N).strip()
_WHOLE = Q.with_(*Q.engine(Y.DICTIONARIES, [Q.RAW, *Q.normalized(N, "raw0")], _KEY, n0=True))


def _verdicts(result: DataFrame) -> DataFrame:
    got = E.flat(result.withColumns({c: F.array_sort(c) for c in Q.LISTS}))
    return got.select(*Q.PLAIN, "n_messages", "n_hits", "temporal_rules", *Q.LISTS)


@query("risk_decision", f"{_FOLDED} SELECT {Q.verdict_columns()} FROM verdict")
def risk_decision(spark, d):
    return _verdicts(_analysis(spark, d))


@query("analyze_full", f"{_WHOLE} SELECT {Q.verdict_columns()} FROM verdict")
def analyze_full(spark, d):
    return _verdicts(E.analyze(_messages(spark, d)))


@query("risk_counts", f"{_WHOLE} SELECT risk, reason, recruiter_action, count(*) AS n FROM verdict GROUP BY ALL")
def risk_counts(spark, d):
    return analyze_full(spark, d).groupBy("risk", "reason", "recruiter_action").agg(F.count("*").alias("n"))


@query("escalation_policy", f"{_FOLDED} SELECT reason, escalate, count(*) AS n, count(*) FILTER (proof) AS with_proof FROM verdict GROUP BY ALL")
def escalation_policy(spark, d):
    r = _analysis(spark, d)
    proof = (F.size("mcr") + F.size("cr") + F.size("n0_rules") + F.size("signals") + F.size("temporal_rules") > 0) | F.col("aggressor").isNotNull()
    return r.groupBy("reason", "escalate").agg(F.count("*").alias("n"), F.count_if(proof).alias("with_proof"))


@query("dampened_score", f"{_FOLDED} SELECT conv_id, v3_score AS score FROM verdict")
def dampened_score(spark, d):
    return _analysis(spark, d).select("conv_id", F.col("v3_score").alias("score"))


_BAND = "(['" + "', '".join(AGE_BANDS) + "', 'none'])[conv_id % 5 + 1]"


@query("age_adjusted_score", f"{_MX} SELECT conv_id, sum(round(weight * {Q.age(_BAND)}::DOUBLE)) AS score FROM k GROUP BY conv_id")
def age_adjusted_score(spark, d):
    m = _messages(spark, d).withColumn("age_band", F.get(F.array(*map(F.lit, (*AGE_BANDS, "none"))), (F.col("conv_id") % 5).cast("int")))
    got = E.analyze(m, P.Dictionaries((Y.MX,)), full_normalize=False)
    return got.where("size(v3_terms) > 0").select("conv_id", F.col("v3_score").alias("score"))


def _raw_sql() -> str:
    return "raws AS (SELECT conv_id, " + ", ".join(f"sum(({v})::INT) AS {k}" for k, v in _PREDICATES.items()) + " FROM norm GROUP BY conv_id)"


def _vector_sql() -> str:
    sat = lambda x, m: f"greatest(0.0, least(1.0, ({x}) / {float(m)}))"
    of = {"evasions": "0"} | {c: f"len({c})" for c in ("categories", "v3_terms", "mcr", "cr", "signals")}
    graded = [sat(of.get(c, c), m) for _, c, m in X._GRADED]
    flag = [f"({c})::INT" for c in ("velocity", "len(tcr) > 0", "aggressor IS NOT NULL", "len(dampeners_applied) > 0")]
    cats = [f"list_contains(categories, {Q.q(c)})::INT" for c in X._CATEGORIES]
    text = ["imperative / n_messages", "(second_person > 0)::INT", "question / n_messages", "(money > 0)::INT", "(meet > 0)::INT", sat('"length" / n_messages', 200)]
    return ", ".join(f"round(({x})::DOUBLE, 9) AS {n}" for n, x in zip(X.NAMES, [*graded, *flag, *cats, *text], strict=True))


_FEATURED = f"{_FOLDED}, {_raw_sql()}, feats AS (SELECT conv_id, {_vector_sql()} FROM verdict JOIN raws USING (conv_id))"
MODEL = X.LinearModel(tuple(round(((k * 37) % 23 - 11) / 10, 2) for k in range(len(X.NAMES))), -0.4)


def _features(spark, d):
    return X.featurize(_analysis(spark, d, raw_features=X.text_predicates))


@query("featurize", f"{_FEATURED} SELECT * FROM feats")
def featurize(spark, d):
    return _features(spark, d).select("conv_id", *(F.round(F.col("features")[i], 9).alias(n) for i, n in enumerate(X.NAMES)))


_DOT = " + ".join(f"({w}) * {n}" for n, w in zip(X.NAMES, MODEL.coefficients, strict=True))


@query("shadow_score", f"{_FEATURED} SELECT conv_id, round(1 / (1 + exp(-({MODEL.bias} + {_DOT}))), 6)::DOUBLE AS probability FROM feats")
def shadow_score(spark, d):
    return X.shadow_score(_features(spark, d), MODEL).select("conv_id", F.round("probability", 6).alias("probability"))


_ACTUAL = "conv_id % 3 = 0"
_SHADOWED = f"{_FEATURED}, seen AS (SELECT conv_id, risk <> 'LOW' AS lexical, 1 / (1 + exp(-({MODEL.bias} + {_DOT}))) >= 0.5 AS shadow, {_ACTUAL} AS actual FROM feats JOIN verdict USING (conv_id))"


@query("shadow_comparison", f"{_SHADOWED} SELECT CASE WHEN lexical = actual AND shadow = actual THEN 'both_correct' WHEN lexical = actual THEN 'lexical_only' WHEN shadow = actual THEN 'shadow_only' ELSE 'both_wrong' END AS class, count(*) AS n FROM seen GROUP BY 1")
def shadow_comparison(spark, d):
    at_nine = lambda x: X.logistic(F.transform(x, lambda v: F.round(v, 9)), MODEL.coefficients, MODEL.bias)
    r = X.observe(_analysis(spark, d, raw_features=X.text_predicates), at_nine)
    kind = X.comparison(F.col("lexical_risk") != "LOW", F.col("shadow_probability") >= MODEL.threshold, F.expr(_ACTUAL))
    return r.groupBy(kind.alias("class")).agg(F.count("*").alias("n"))


def _judged(spark, d):
    return _t(spark, d, "documents").join(_t(spark, d, "labels"), "doc_id").withColumns({"p": F.col("n_chars") > 2000, "a": F.col("toxic") == 1})


_CONF = "count(*) FILTER (p AND a) AS tp, count(*) FILTER (p AND NOT a) AS fp, count(*) FILTER (NOT p AND a) AS fn, count(*) FILTER (NOT p AND NOT a) AS tn"
_JUDGED = "j AS (SELECT *, n_chars > 2000 AS p, toxic = 1 AS a FROM documents JOIN labels USING (doc_id))"
_RATIOS = "round(coalesce(tp / nullif(tp + fp, 0), 0), 9)::DOUBLE AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 9)::DOUBLE AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 9)::DOUBLE AS f1, round(coalesce(fp / nullif(fp + tn, 0), 0), 9)::DOUBLE AS fpr, round((tp + tn) / (tp + fp + fn + tn), 9)::DOUBLE AS accuracy"
_METRICS = ("precision", "recall", "f1", "fpr", "accuracy")


@query("eval_confusion", f"WITH {_JUDGED}, c AS (SELECT {_CONF} FROM j) SELECT tp, fp, fn, tn, {_RATIOS} FROM c")
def eval_confusion(spark, d):
    return V.confusion(_judged(spark, d), "p", "a").select("tp", "fp", "fn", "tn", *(F.round(x, 9).alias(x) for x in _METRICS))


@query("eval_by_group", f"WITH {_JUDGED}, c AS (SELECT lang, {_CONF} FROM j GROUP BY lang) SELECT lang, tp, fp, fn, tn, {_RATIOS} FROM c")
def eval_by_group(spark, d):
    return V.confusion(_judged(spark, d), "p", "a", "lang").select("lang", "tp", "fp", "fn", "tn", *(F.round(x, 9).alias(x) for x in _METRICS))


_ACTED = f"{_FOLDED}, j AS (SELECT *, {_ACTUAL} AS a FROM verdict)"
_RATE = "round(coalesce(count(*) FILTER ({0} AND {1}) / nullif(count(*) FILTER ({1}), 0), 0), 9)::DOUBLE AS {2}"


@query("eval_action_model", f"{_ACTED} SELECT count(*) FILTER (risk IN ('HIGH', 'CRITICAL') AND NOT a) AS false_blocks, {_RATE.format(chr(114) + ' >= 2', 'NOT a', 'false_block_rate')}, {_RATE.format('r = 1', 'NOT a', 'benign_review_rate')}, count(*) FILTER (r = 0 AND a) AS missed_risks, {_RATE.format('r = 0', 'a', 'miss_rate')}, {_RATE.format('r > 0', 'a', 'risk_reach_rate')} FROM j")
def eval_action_model(spark, d):
    got = V.action_metrics(_analysis(spark, d).withColumn("a", F.expr(_ACTUAL)), "risk", "a")
    return got.select(*(F.round(c, 9).alias(c) if c.endswith("rate") else c for c in got.columns))


@query("eval_escalation", f"{_ACTED} SELECT {_RATE.format('escalate', 'NOT a', 'benign_escalation_rate')}, {_RATE.format('r > 0', 'a', 'risk_coverage')} FROM j")
def eval_escalation(spark, d):
    got = V.escalation_metrics(_analysis(spark, d).withColumn("a", F.expr(_ACTUAL)), "risk", "escalate", "a")
    return got.select(*(F.round(c, 9).alias(c) for c in got.columns))


@query("roc_auc", f"WITH {_JUDGED}, s AS (SELECT n_chars AS s, a::INT AS a FROM j), p AS (SELECT s, a, rank() OVER (ORDER BY s) AS lo, count(*) OVER (PARTITION BY s) AS k FROM s) SELECT round((sum(lo + (k - 1) / 2) FILTER (a = 1) - sum(a) * (sum(a) + 1) / 2) / (sum(a) * sum(1 - a)), 9)::DOUBLE AS roc_auc FROM p")
def roc_auc(spark, d):
    return X.roc_auc(_judged(spark, d).select(F.col("n_chars").alias("s"), "a"), "s", "a").select(F.round("roc_auc", 9).alias("roc_auc"))


@query("latency_percentiles", "SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, round(avg(value), 6)::DOUBLE AS mean, max(value) AS max, count(value)::BIGINT AS n FROM events GROUP BY event_type")
def latency_percentiles(spark, d):
    return V.percentiles(_t(spark, d, "events"), "value", "event_type").withColumn("mean", F.round("mean", 6))


_SIGNS = "".join(map(chr, range(0x21, 0x7F)))
_WIDE = "".join(chr(c + 0xFEE0) for c in range(0x21, 0x7F))
_UP = V._LATIN[0] + V._LATIN[0].upper()


@query("adversarial_variants", f"SELECT conv_id, turn, translate(text, {Q.q(_UP)}, {Q.q(V._LATIN[1] * 2)}) AS homoglyphs, translate(text, {Q.q(_SIGNS)}, {Q.q(_WIDE)}) AS fullwidth, regexp_replace(regexp_replace(text, '(\\p{{L}})(\\p{{L}})', '\\1' || chr(8203) || '\\2', 'g'), '(\\p{{L}})(\\p{{L}})', '\\1' || chr(8203) || '\\2', 'g') AS invisibles, array_to_string(list_transform(regexp_extract_all(text, '\\p{{L}}+|[^\\p{{L}}]+'), lambda w: CASE WHEN regexp_matches(w, '^\\p{{L}}{{4,}}$') THEN array_to_string(string_split(w, ''), ' ') ELSE w END), '') AS intra_word_spaces, substr(text, 1, (length(text) // 2)::INT) AS first_half FROM conversations")
def adversarial_variants(spark, d):
    c = _t(spark, d, "conversations").select("conv_id", "turn", "text")
    made = c.select("conv_id", "turn", *(V.ADVERSARIAL[k](F.col("text")).alias(k) for k in ("homoglyphs", "fullwidth", "invisibles", "intra_word_spaces")))
    half = V.split_messages(c.withColumn("msg_idx", F.col("turn"))).where("msg_idx % 2 = 0").select("conv_id", "turn", F.col("text").alias("first_half"))
    return made.join(half, ["conv_id", "turn"])


@query("adversarial_survival")
def adversarial_survival(spark, d):
    """Per variant: conversations that are not LOW as they are, and those of them that still aren't."""
    return V.survival(_messages(spark, d), E.analyze)


# --- sessions -----------------------------------------------------------------------------------------------------
@query("session_trim", "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k, count(*) OVER (PARTITION BY user_id) AS n FROM events) WHERE n <= 30 OR k <= 5 OR k > n - 25")
def session_trim(spark, d):
    return S.trim(_t(spark, d, "events"), "user_id", 5, 25, ("ts", "event_id")).select("user_id", "event_id")


@query("session_retention", "SELECT event_id, user_id FROM events WHERE epoch_us(ts) // 1000 >= (SELECT max(epoch_us(ts) // 1000) FROM events) - 7 * 86400000::BIGINT")
def session_retention(spark, d):
    ev = _event_hits(spark, d).select(F.col("ord").alias("event_id"), F.col("conv_id").alias("user_id"), "ts_ms")
    now = ev.agg(F.max("ts_ms").alias("now"))
    return S.retained(ev, now.scalar(), 7).select("event_id", "user_id")


@query("escalations", f"{_FOLDED} SELECT conv_id, risk, reason FROM verdict WHERE escalate AND (conv_id % 2 = 0 OR r > 1)")
def escalations(spark, d):
    """With an answer at MEDIUM for every odd conversation in the cache."""
    cache = _t(spark, d, "conversations").select("conv_id").distinct().where("conv_id % 2 = 1").withColumn("cached_risk", F.lit(1))
    return S.escalations(_analysis(spark, d), cache).select("conv_id", "risk", "reason")


@query("network_reports", f"{_FOLDED} SELECT v.conv_id, aggressor AS sender, risk, count(*)::INT AS n_texts, array_to_string(list_sort(any_value(categories)), ',') AS categories FROM verdict v JOIN conversations c ON c.conv_id = v.conv_id AND c.role = v.aggressor WHERE NOT escalate AND r > 0 GROUP BY v.conv_id, aggressor, risk")
def network_reports(spark, d):
    m = _messages(spark, d)
    return S.network_reports(_analysis(spark, d), m).select("conv_id", "sender", "risk", F.size("texts").alias("n_texts"), _joined("categories").alias("categories"))


assert set(EVENT_CATEGORY.values()) <= set(STAGE_OF)
