"""The engine: every query against its SQL, and the rules of matching, time, actors and decisions on small tables."""

import json
import os
import re
import time
from dataclasses import replace

import duckdb
import pytest
from pyspark.sql import functions as F

from hearken import config as C
from hearken import queries as Q
from hearken.config import CONFIG
from hearken.functions import text as T
from hearken.operators import evaluate as V
from hearken.operators import features as X
from hearken.operators import matching as M
from hearken.plans import engine as E
from hearken.sources import loaders as L
from hearken.sources import packs as P
from hearken.sources import synthetic as Y
from hearken.streaming import sessions as S

DATA = "/root/testdata/sf0.01"
T0 = 1_750_000_000_000
DAY = 86_400_000
MSG = "conv_id long, msg_idx int, text string, ts_ms long, sender string, source string"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", sorted(Q.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    db = duckdb.connect()
    for t in ("documents", "labels", "conversations", "events"):
        db.sql(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    got = Q.QUERIES[name](spark, DATA)
    columns = sorted(got.columns)
    ours = sorted(str([r[c] for c in columns]) for r in got.collect())
    said = db.sql(Q.ORACLE_SQL[name])
    at = [said.columns.index(c) for c in columns]
    assert ours == sorted(str([r[i] for i in at]) for r in said.fetchall())


def messages(spark, *texts, senders=None, gap=60_000, source=None, conv=1):
    return spark.createDataFrame([(conv, i, t, T0 + i * gap, senders[i] if senders else None, source) for i, t in enumerate(texts)], MSG)


def hot(*terms, **more):
    pack = P.Pack("MX", "1", tuple(P.Term(f"T-{i}", s, c, w) for i, (s, c, w) in enumerate(terms)), legacy_ids=True)
    return P.Dictionaries((pack,), **more)


def one(spark, *texts, d=Y.DICTIONARIES, config=CONFIG, **kw):
    return E.analyze(messages(spark, *texts, **kw), d, config).first()


def test_single_category_is_capped_at_medium(spark):
    r = one(spark, "zorbal", d=hot(("zorbal", "reclutamiento", 24)))
    assert (r.risk, r.score, r.escalate, r.reason) == ("MEDIUM", 24, True, "uncertain_needs_llm")
    r = one(spark, "zorbal mirtal", d=hot(("zorbal", "reclutamiento", 13), ("mirtal", "aislamiento", 13)))
    assert r.risk == "CRITICAL" and r.score == 26 and r.escalate and r.reason == "uncertain_needs_llm"


def test_silent_conversations_are_low(spark):
    r = one(spark, "xyz", "", d=P.Dictionaries((Y.MX,)))
    assert (r.risk, r.verdict.recruiter_action, r.escalate, r.score, r.reason) == ("LOW", "ALLOW", False, 0, "none_low_risk")
    assert r.verdict.ux_recommendation == "NONE" and r.verdict.stage == "NINGUNA" and r.verdict.protective_actions == []
    assert E.analyze(spark.createDataFrame([], MSG)).count() == 0
    odd = spark.createDataFrame([(1, 0, None, None, None, None), (1, 0, "zorbal", None, "", None), (2, 3, "zorbal", T0, "x", "fax")], MSG).withColumn("risk", F.lit("clash"))
    got = {r.conv_id: r for r in E.analyze(odd, hot(("zorbal", "reclutamiento", 12))).collect()}
    assert {k: (r.risk, r.n_messages) for k, r in got.items()} == {1: ("MEDIUM", 2), 2: ("MEDIUM", 1)}


def test_ambiguous_terms_need_others(spark):
    d = P.Dictionaries((P.Pack("MX", "1", (P.Term("A", "amb", "aislamiento", 9, (), True), P.Term("B", "sol", "reclutamiento", 3), P.Term("W", "wek", "señal_debil", 1))),))
    assert one(spark, "amb wek", d=d).score == 1
    assert one(spark, "amb sol", d=d).score == 12


def test_dampeners(spark):
    damp = (P.Dampener("D", "fan", ("reclutamiento",), 0.4), P.Dampener("H", "film", ("slang_operativo",), 0.1, (), True))
    d = hot(("zorbal", "reclutamiento", 20), ("mirtal", "slang_operativo", 26), dampeners=damp)
    r = one(spark, "zorbal fan", d=d)
    assert (r.score, r.risk, r.dampeners_applied, r.v3_original) == (8, "LOW", ["D"], 20)
    assert one(spark, "zorbal", d=d).score == 20
    assert one(spark, "mirtal zorbal", d=d).risk == "CRITICAL"
    assert one(spark, "mirtal zorbal film", d=d).score == 23 and one(spark, "zorbal film " * 3, d=d).dampeners_applied == []


def test_claims_go_on_to_the_next_surface(spark):
    a = P.Pack("MX", "1", (P.Term("A", "zor", "reclutamiento", 5, ("alt",)),), legacy_ids=True)
    b = P.Pack("EU", "1", (P.Term("B", "zor", "reclutamiento", 7, ("bal",)),), rules=(P.Rule("R", 1, (("EU", "reclutamiento"),)),))
    d = P.Dictionaries((a, b))
    assert one(spark, "zor", d=d).v3_terms == ["A"]
    r = one(spark, "zor", "bal", d=d)
    assert r.v3_terms == ["A", "EU-B"] and r.score == 12 and r.mcr == ["EU-R"]
    assert one(spark, "alt", "zor", d=d).v3_terms == ["A", "EU-B"]  # A was met by another surface, so zor is free


def test_strategies_and_odd_surfaces_agree(spark):
    m = messages(spark, "of  the with", "desde la casa, that", "ERHE onhe x.onhe", "🍕 c++ und")
    packs = (*Y.BOTH.packs, P.Pack("ZZ", "1", (P.Term("P", "🍕", "señal_emoji", 1), P.Term("C", "c++", "slang_operativo", 1))))
    rows = lambda s: sorted(map(str, M.match_surfaces(m, packs, s).select("msg_idx", "canonical_id", "surface").collect()))
    assert rows("broadcast") == rows("nested_loop") == rows("shuffle")
    assert {"🍕", "c++", "of the", "onhe"} <= {r.surface for r in M.match_surfaces(m, packs).collect()}


def test_slow_chain_escalates(spark):
    d = hot(("lunaro", "señal_debil", 3), ("bosque", "manipulacion_social", 3), ("cedral", "aislamiento", 3), ("dulmar", "logistica_fisica", 1))
    r = one(spark, "lunaro", "bosque", "cedral", d=d, gap=3 * DAY)
    assert r.temporal_rules == ["TCR-001"] and r.risk == "MEDIUM" and r.escalate and r.span_days == 6
    assert r.stages == ["CONTACTO", "ENGANCHE", "AISLAMIENTO"] and r.timeline[0].first_seen_at == T0
    assert one(spark, "lunaro", "bosque", "cedral", d=d, gap=300_000).temporal_rules == []
    assert one(spark, "cedral", "bosque", "lunaro", d=d, gap=3 * DAY).temporal_rules == []
    r = one(spark, "lunaro", "bosque", "cedral", "dulmar", d=d, gap=3 * DAY)
    assert r.risk == "HIGH" and not r.escalate and r.verdict.recruiter_action == "HARD_BLOCK"
    r = one(spark, "dulmar", "cedral", "bosque", "lunaro", d=replace(d, packs=(replace(d.packs[0], terms=tuple(replace(t, weight=4) for t in d.packs[0].terms)),)), gap=1000)
    assert r.risk == "MEDIUM" and r.verdict.recruiter_action == "SOFT_WARN"  # four stages alone don't block


def test_isolation_on_two_days(spark):
    hits = spark.createDataFrame([(1, "aislamiento", T0, 0), (1, "aislamiento", T0 + 7 * DAY, 1), (1, "reclutamiento", T0 - DAY, 2), (2, "aislamiento", T0, 0)], "conv_id long, category string, ts_ms long, ord long")
    got = {r.conv_id: r for r in E.timeline(hits).collect()}
    assert got[1].temporal_rules == ["TCR-002"] and got[1].ordered and got[2].temporal_rules == [] and not got[2].ordered


def test_actor(spark):
    d = hot(("lunaro", "reclutamiento", 1), ("cedral", "aislamiento", 1), ("ven ya solo", "logistica_fisica", 1))
    r = one(spark, "lunaro cedral", "ok", d=d, senders=["x", "y"])
    assert r.aggressor == "x" and r.actor_rules == ["ACR-001"] and r.concentration == 1 and r.risk == "MEDIUM"
    assert [(p.sender, p.directed) for p in r.profiles] == [("x", 2), ("y", 0)]
    assert one(spark, "lunaro cedral", "lunaro cedral", d=d, senders=["x", "y"]).aggressor is None
    r = one(spark, "lunaro cedral", "ok", d=d)
    assert r.concentration == 0 and not r.analyzed and r.profiles == []
    r = one(spark, "lunaro ven", "no", "  ", "ya", "solo", d=d, senders=["x", "y", "x", "x", "x"])
    assert r.aggressor == "x" and r.profiles[0].directed == 2 and "T-2" not in r.v3_terms  # words across a sender's messages


def test_interventions(spark):
    rows = [(1, "HIGH", [], [], [], None), (2, "CRITICAL", ["logistica_fisica"], [], [], None), (3, "MEDIUM", [], ["TCR-001"], ["a", "b", "c", "d"], None), (4, "HIGH", [], [], [], "x"), (5, "MEDIUM", [], [], ["a", "b", "c", "d"], None)]
    df = spark.createDataFrame(rows, "conv_id int, risk string, categories array<string>, temporal_rules array<string>, stages array<string>, aggressor string")
    got = {r.conv_id: r.verdict for r in E.intervene(df).collect()}
    assert [got[k].recruiter_action for k in range(1, 6)] == ["SILENT_OBSERVE", "HARD_BLOCK", "HARD_BLOCK", "SILENT_OBSERVE", "SOFT_WARN"]
    assert got[1].protective_actions == ["SHADOW_FLAG", "WARN_MINOR"] and "RESTRICT_CONTACT" in got[4].protective_actions
    assert {"PRESERVE_EVIDENCE", "NOTIFY_GUARDIAN"} <= set(got[2].protective_actions) and re.search("088|Te Protejo", got[1].minor_message)
    assert got[5].minor_message is None and got[2].ux_recommendation == "HARD_BLOCK" and got[4].ux_recommendation == "WARNING_OVERLAY"


def test_ages(spark):
    d = hot(("lunaro", "solicitud_informacion", 10), ("bosque", "oferta_economica", 10))
    m = messages(spark, "lunaro bosque")
    score = lambda band: E.analyze(m.withColumn("age_band", F.lit(band)), d).first().score
    assert [score(b) for b in ("under13", "13-15", "16-17", "adult", "child", None)] == [26, 24, 22, 11, 20, 20]
    assert C.age_band("adult") == "adult" and C.age_band("child") is None and C.age_band(7) is None


def test_velocity_needs_three_hits(spark):
    hits = spark.createDataFrame([(1, T0), (1, T0 + 1000), (2, T0), (2, T0 + 1), (2, T0 + 300_400), (3, T0), (3, T0), (3, T0 + 301_000)], "conv_id long, ts_ms long")
    assert {r.conv_id: r.velocity for r in E.velocity(hits).collect()} == {1: False, 2: True, 3: False}


def test_hits_of_the_whole_conversation_count(spark):
    d = hot(("zorbal", "reclutamiento", 3), ("mirtal", "aislamiento", 3), patterns=Y.PATTERNS)
    offer, secret = (dict(Y.PATTERNS.lexicons)[k][0] for k in ("vague", "secret"))
    r = one(spark, "zorbal", f"{offer}, {secret} onin", d=d)  # one term, two features
    assert r.velocity and r.window_s == 60 and r.cr == ["CR-004"]
    r = one(spark, "zorbal", "mirtal", "z\u200bor", d=d)  # two terms and the evasion
    assert r.velocity and r.window_s == 120 and r.n0_rules == ["N0-EVASION"] and r.n0_score == 2
    assert not one(spark, "zorbal", "mirtal", "zor", d=d).velocity
    alone = hot(("mirtal", "aislamiento", 3), ("dulmar", "aislamiento", 3), patterns=Y.PATTERNS)
    r = one(spark, "mirtal reea", "onha", "dulmar herhe", d=alone, gap=4 * DAY)  # CR-013 adds a stage
    assert r.cr == ["CR-013"] and r.v4_score == 15 and "manipulacion_social" not in r.categories and r.temporal_rules == ["TCR-002"]
    assert one(spark, "mirtal reea", "onha", "dulmar", d=alone, gap=4 * DAY).temporal_rules == []
    late = E.analyze(messages(spark, "zorbal", "mirtal", "z\u200bor"), d, now_ms=T0 + DAY).first()
    assert not late.velocity and late.window_s == DAY // 1000  # layer 0 at the time of the analysis


def test_evasion_markers_read_whole_texts(spark, tmp_path):
    far = "river stone " * 400
    spark.createDataFrame([(1, far + "z\u200bor"), (2, far)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.markers, r.bonus) for r in Q.QUERIES["evasion_markers"](spark, str(tmp_path)).collect()}
    assert got == {1: (1, 2), 2: (0, 0)}


def test_evasion_markers_leave_texts_where_they_are(spark, tmp_path):
    """Python is sent few bytes of texts at a time, and sends back numbers; they are those of normalized."""
    odd = ["ｚｏｒ", "f а с t", "z o r b al", "h0la", "zor bal", "", None]
    spark.createDataFrame(list(enumerate(odd)), "doc_id int, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = Q.QUERIES["evasion_markers"](spark, str(tmp_path))
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) == T.BATCH_BYTES
    assert [f.dataType.typeName() for f in T.evasion_bits(spark.read.parquet(f"{tmp_path}/documents.parquet")).schema] == ["integer", "string", "byte"]
    want = T.normalized(spark.read.parquet(f"{tmp_path}/documents.parquet"), Y.NORMALIZER)
    assert {r.doc_id: r.markers for r in got.collect()} == {r.doc_id: r.unicode + r.spacing + r.leet for r in want.collect()}


def test_evasion_and_voice(spark):
    def f(t, s=None):
        row = T.normalized(spark.createDataFrame([(t, s)], "text string, source string"), Y.NORMALIZER, source="source", labels=True).first()
        return row.norm, row.unicode, row.spacing, row.leet, row.labels

    assert f("ｚｏｒ")[:2] == ("zor", True) and f("z\u200bor")[0] == "zor" and f("z0r")[:4] == ("zor", False, False, True)
    assert f("f а с t")[:3] == ("fact", True, True) and f("fасt")[:2] == ("fact", True)
    assert f("z o r b al")[:3] == ("zorb al", False, True) and f("z o r bal")[0] == "z o r bal" and f("z o r b.")[:3] == ("zorb.", False, True)
    assert f("5000 pesos")[3] is False and f("9ol!")[0] == "goli" and f("zor bal")[:4] == ("zor bal", False, False, False)
    v = f("Este, ¿zor... mmm pues o  sea bal", "voice_transcript")
    assert v[:4] == ("zor bal", False, False, False) and "voice-filler:o-sea" in v[4]
    assert f("hola!")[3] and f(None)[:4] == (None, False, False, False)
    assert f("q thsh ***  aaaa")[0] == "que this stars a" and {"q→que", "thsh→this", "***→stars", "phonetic:$1"} <= set(f("q thsh ***  aaaa")[4])
    assert T.normalize_surface("Qk aaaa ***", Y.NORMALIZER) == f("Qk aaaa ***")[0]
    same = lambda t: spark.createDataFrame([(t,)], "t string").select(T.collapse_repeated(F.col("t"))).first()[0]
    assert same("aaa\n\n\n😀😀😀b") == "aa\n\n\n😀😀😀b"


def test_patterns_are_tried_where_they_may_match(spark):
    """Texts are searched for what a pattern matches before it is tried; what it may match is never missed."""
    assert T.words_of(r"\bonh[ae]\b") == ["onha", "onhe"] and T.words_of(r"\bist? (der|x)\b") == ["ist der", "ist x", "is der", "is x"]
    assert not any(map(T.words_of, ("a|b", "a*", "(ab)?", "a??", "[^a]", "a.", r"\bx?\b", "(a|)?")))
    texts = ["xonha onhe.", "\u0131st der", "\u0130s der", "i\u0307s der", "er\u017fhe", "ershe", "is  der", "K", "", None]
    low = spark.createDataFrame([(t,) for t in texts], "t string").select(F.lower("t").alias("t"))
    for r in (r"\bonh[ae]\b", r"\bist? der\b", r"\bershe?\b", "k", "a|onh"):
        hit = F.col("t").rlike(T.js_pattern(r))
        assert low.where(hit & ~T.may_match(F.col("t"), r)).count() == 0
    assert low.where(T.may_match(F.col("t"), r"\bonh[ae]\b")).count() == 1


def test_abbreviations_one_by_one_or_in_chains(spark):
    texts = ["q! th, x-q qq q", " Q q\u00a0(q)\t\u00e9q ", "t-h q's n.d q", "regarding", "", None]
    for pairs in (Y.NORMALIZER.abbreviations, (("q", "th q"), ("th", "q"), ("n.d", "x"), ("no", "")), (("q", "$1\\x"),), ()):
        table = {k: v for k, v in pairs if v}
        want = [t if t is None else " ".join(table.get(re.sub("[^a-z0-9']", "", w), w) for w in re.split(f"{T.BLANK}+", t)) for t in texts]
        got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", T.expand_abbreviations(F.col("t"), pairs).alias("x"))
        assert [r.x for r in got.orderBy("i").collect()] == want


def test_layer_zero_is_that_of_the_analysis(spark):
    m = messages(spark, "z\u200bor", "oieaux the", "ingst", "h0la", conv=1).unionByName(messages(spark, "le", "", conv=2))
    cols = ("conv_id", "n0_features", "n0_rules", "n0_score")
    rows = lambda x: sorted(map(str, x.select(*cols).collect()))
    alone = E.layer_zero(m)
    assert rows(alone) == rows(E.analyze(m)) and len(rows(alone)) == 2
    assert "Join" not in alone._jdf.queryExecution().optimizedPlan().toString()


def test_pack_validation():
    P.validate(Y.BOTH.packs)
    P.validate_all(Y.BOTH)
    P.validate((P.Pack("MX-NORTE", "1", ()),))
    for bad in ((), (Y.MX, Y.MX), (P.Pack("mx", "1", ()),), (P.Pack("A_B", "1", ()),), (P.Pack("A", "1", (), threshold=9), Y.MX), (P.Pack("A", "1", (P.Term("x", " ", "aislamiento", 1),)),), (P.Pack("A", "1", (), (P.Rule("r", 1, (("ZZ", "aislamiento"),)),)),), (P.Pack("A", "1", (), (P.Rule("r", 1, ()),)),)):
        with pytest.raises(ValueError):
            P.validate(bad)
    with pytest.raises(ValueError):
        P.add_hot_terms((Y.MX,), [("ZZ", P.Term("x", "y", "aislamiento", 1))])
    with pytest.raises(ValueError):
        P.validate_all(replace(Y.BOTH, dampeners=(P.Dampener("d", "x", (), 2.0),)))
    (p,) = P.add_hot_terms((Y.MX,), [(None, P.Term("H", "ERHE", "aislamiento", 1, ("nuevo",)))])
    assert P.index_of(p)["erhe"].id == "REC-001" and P.index_of(p)["nuevo"].id == "H"


def test_loaders(spark, tmp_path):
    files = {
        "old": {"metadata": {"version": "3", "tier1_session_threshold": 12, "sources": [], "multi_category_escalation_rules": {"rules": [{"id": "R", "categories_required": ["aislamiento"], "min_messages": 1}]}}, "terms": [{"id": "A", "term": "zor", "category": "aislamiento", "weight": 5, "variants": ["bal"]}]},
        "new": {"schemaVersion": 1, "id": "EU", "version": "1", "displayName": "x", "metadata": {"sessionThreshold": 12, "sources": []}, "terms": [], "rules": [{"id": "R", "categories_required": [{"packId": "MX", "category": "aislamiento"}], "min_messages": 1}]},
        "norm": {"normalization_rules": {"unicode_and_symbols": [{"raw": "***", "canonical": "x"}], "chat_abbreviations": {"entries": [{"abbr": "Q", "canonical": "que"}]}, "phonetic_rules": {"rules": [{"find": "(.)\\1", "replace": "\\1"}]}}, "lexicons": {"note": "text", "l": {"entries": ["zo"]}}, "N0_features": {"features": [{"id": "N0-F001", "derived_from": ["l"], "weight": 2}]}, "N0_combination_rules": {"rules": [{"id": "N0-CR-001", "features_required": ["N0-F001"], "bonus_score": 3}]}},
        "pat": {"lexicons": {"a": ["uno"], "b": ["dos"]}, "features": [{"id": "F1", "name": "ambiguous_opportunity", "weight": 1, "derived_from": ["a"]}, {"id": "F3", "name": "low_specificity", "derived_from": ["b"], "logic": "NEGATED — x"}], "combination_rules": [{"id": "CR-013", "features_required": [], "bonus_score": 15}], "explicit_signals": [{"id": "S", "label": "s", "patterns": ["tres"], "weight": 9, "category": "aislamiento"}], "intent_signals": [{"id": "I", "patterns": ["q.e"]}]},
        "damp": {"dampeners": [{"id": "D", "term": "cine", "dampen_categories": ["reclutamiento"], "factor": 0.3, "hard_context": True}]},
        "hot": {"data": [{"id": "H", "term": "nuevo", "category": "aislamiento", "weight": 9, "variants": []}], "dataset_version": 7},
    }
    for k, v in files.items():
        (tmp_path / f"{k}.json").write_text(json.dumps(v))
    at = lambda k: f"{tmp_path}/{k}.json"
    d = L.load(spark, [at("old"), at("new")], at("norm"), at("pat"), at("damp"))
    r = one(spark, "Zoor q", "uno", d=d)
    assert (r.v3_terms, r.mcr, r.n0_features, r.n0_rules, r.v4_features) == (["A"], ["R", "EU-R"], ["N0-F001"], ["N0-CR-001"], ["ambiguous_opportunity", "low_specificity"])
    assert (r.n0_score, r.v3_score, r.v4_score) == (5, 5, 2) and r.risk == "CRITICAL" and r.pack_versions == {"MX": "3", "EU": "1"}
    assert L.load_hot_terms(spark, at("hot"))[1] == 7 and L.load_hot_terms(spark, at("none")) == ([], None)


def test_order_of_rows_does_not_matter(spark):
    m = E.messages_of(spark.read.parquet(f"{DATA}/conversations.parquet")).where("conv_id < 20")
    rows = lambda x: sorted(map(str, E.analyze(x).collect()))
    assert rows(m) == rows(m.orderBy(F.rand(1)).repartition(5))


def test_features_and_shadow_model(spark, tmp_path):
    assert len(X.NAMES) == 28 == len(set(X.NAMES))
    d = hot(("zorbal", "reclutamiento", 30))
    m = messages(spark, "zorbal, ¿manda dinero?", "nos vemos, tú", "te 😀")
    got = X.observe(E.analyze(m, d, raw_features=X.text_predicates), Q.MODEL).first()
    f = dict(zip(X.NAMES, got.features, strict=True))
    assert f["score_total"] == 0.75 and f["cat_reclutamiento"] == 1 and f["txt_imperative_ratio"] == pytest.approx(1 / 3) and f["txt_question_ratio"] == pytest.approx(1 / 3)
    assert (f["txt_second_person"], f["txt_money_mention"], f["txt_meet_mention"]) == (1, 1, 1) and f["txt_avg_len"] == pytest.approx((22 + 13 + 5) / 3 / 200)
    assert all(0 <= x <= 1 for x in got.features) and got.risk == E.analyze(m, d).first().risk and 0 < got.shadow_probability < 1
    broken = X.observe(E.analyze(m, d, raw_features=X.text_predicates), lambda x: X.logistic(F.slice(x, 1, 3), Q.MODEL.coefficients, 0.0)).first()
    assert broken.shadow_probability is None and broken.risk == got.risk
    X.save_model(spark, Q.MODEL, f"{tmp_path}/model.json")
    assert X.load_model(spark, f"{tmp_path}/model.json") == Q.MODEL
    for bad in ({"featureNames": tuple(reversed(X.NAMES))}, {"bias": float("nan")}, {"coefficients": (1.0,)}, {"schemaVersion": 2}):
        with pytest.raises(ValueError):
            replace(Q.MODEL, **bad)


def test_terms_that_cancel_are_a_half(spark):
    """The terms of this row add up to 0; as doubles they leave -1.4e-16."""
    row = [1.0, 0.0, 1.0, 1.0, 1.0, 0.8, 0.75, 1.0, 1.0, *[0.0] * 3, 1.0, 0.0, 1.0, 0.0, 1.0, 0.0, *[1.0] * 4, *[0.0] * 5, 1.0]
    x = F.array(*map(F.lit, row))
    at = lambda bias: X.logistic(x, Q.MODEL.coefficients, bias)
    got = spark.range(1).select(at(Q.MODEL.bias).alias("half"), at(-800.0).alias("none"), at(800.0).alias("all")).first()
    assert got.half == 0.5 and 0 <= got.none < 1e-300 and got["all"] == 1


def test_training_data_and_folds(spark, tmp_path):
    cases = [(f"C{i}", f"g{i // 2 % 4}", "RISK" if i % 2 else "BENIGN", [("zorbal" if i % 2 else "hola amigo", 0.0, "x", None)] * 2) for i in range(40)]
    df = spark.createDataFrame(cases, "id string, `group` string, label string, messages array<struct<text:string,offset_s:double,sender:string,source:string>>")
    X.write_dataset(X.build_dataset(df, hot(("zorbal", "reclutamiento", 30))), f"{tmp_path}/set")
    rows = X.read_dataset(spark, f"{tmp_path}/set")
    assert rows.count() == 40 and {r.label for r in rows.collect()} == {0, 1} and all(len(r["values"]) == 28 for r in rows.collect())
    out = X.out_of_fold(rows, grouped=True, folds=2)
    assert out.select("group", "fold").distinct().count() == 4
    b = X.metric_block(out).first()
    assert b.roc_auc == 1 and b.tp + b.fn == 20
    with pytest.raises(ValueError):
        X.read_dataset(spark, str(tmp_path / "set" / "header.json"))
    x = spark.createDataFrame([(0.1, 0), (0.1, 1), (0.9, 1)], "s double, a int")
    assert X.roc_auc(x, "s", "a").first()[0] == 0.75 and X.roc_auc(x.limit(0), "s", "a").first()[0] is None
    assert "| 0.7500 |" in V.markdown(X.roc_auc(x, "s", "a"))
    V.write_report({"auc": X.roc_auc(x, "s", "a")}, f"{tmp_path}/report")
    assert spark.read.json(f"{tmp_path}/report/auc").first().roc_auc == 0.75


def test_adversarial_variants(spark):
    t = spark.createDataFrame([("Hola tela AI",)], "t string")
    got = t.select(*(f(F.col("t")).alias(k) for k, f in V.ADVERSARIAL.items())).first()
    assert got.leet_aggressive == "H0l4 t3l4 A1" and got.intra_word_spaces == "H o l a t e l a AI" and got.fullwidth == "Ｈｏｌａ ｔｅｌａ ＡＩ"
    assert got.invisibles == "H\u200bo\u200bl\u200ba t\u200be\u200bl\u200ba A\u200bI" and T._sanitize(got.homoglyphs) == "Hola tela ai"
    m = messages(spark, "abcde", senders=["x"])
    assert [(r.msg_idx, r.text, r.sender) for r in V.split_messages(m).collect()] == [(0, "ab", None), (1, "cde", None)]
    d = hot(("zorbal", "reclutamiento", 30), ("mirtal", "aislamiento", 30))
    rate = {r.variant: r.survival_rate for r in V.survival(messages(spark, "oye zorbal, hay un mirtal"), lambda x: E.analyze(x, d)).collect()}
    assert len(rate) == 6 and rate["homoglyphs"] == rate["invisibles"] == rate["fullwidth"] == 1


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_reports_are_planned_in_bounded_time(spark):
    """The join's key must not be written out in terms of the messages, which took all of the driver's memory."""
    m = E.messages_of(spark.read.parquet(f"{DATA}/conversations.parquet"))
    began = time.time()
    plan = S.network_reports(E.analyze(m, Y.BOTH, full_normalize=False), m)._jdf.queryExecution().optimizedPlan()
    assert plan is not None and time.time() - began < 30


def test_sessions(spark, tmp_path):
    good = {"id": "1", "user_id": "u", "session_id": "s", "content": "c", "timestamp": T0}
    bad = [{"id": "2"}, {**good, "id": 5}, {**good, "timestamp": 1}, {**good, "timestamp": str(T0)}, {**good, "source": "fax"}, "x", None]
    lines = [json.dumps([["s", [good, *bad]], ["t", [{**good, "id": "9", "source": "text"}]]]), "nonsense", "[1,2]", json.dumps(["u", [good]])]
    got = S.import_sessions(spark.createDataFrame([(x,) for x in lines], "value string"), T0 + DAY)
    assert sorted((r.session, r.id) for r in got.collect()) == [("s", "1"), ("t", "9"), ("u", "1")]
    S.export_sessions(got.drop("session_id").withColumnRenamed("session", "session_id"), f"{tmp_path}/out")
    assert S.import_sessions(spark.read.text(f"{tmp_path}/out"), T0 + DAY).count() == 3
    m = messages(spark, *(["zor bal"] * 20))
    assert [r.msg_idx for r in S.trim(m, head=2, tail=3).orderBy("msg_idx").collect()] == [0, 1, 17, 18, 19]
    S.record_feedback(spark.createDataFrame([("s", "v", "confirmed", None)], "session_id string, verdict string, feedback string, comment string"), f"{tmp_path}/feedback")
    assert spark.read.json(f"{tmp_path}/feedback").count() == 1


def test_stream(spark, tmp_path):
    d = hot(("zorbal", "reclutamiento", 14))
    (tmp_path / "hot.json").write_text(json.dumps({"data": [], "dataset_version": 1}))
    told = []

    def sync(batch, number):
        told.append(number)
        raise OSError("down")

    def step(*texts, conv=1, at=0):
        m = spark.createDataFrame([(conv, at + i, t, T0 + (at + i) * 1000, "x", None) for i, t in enumerate(texts)], MSG)
        m.write.mode("append").parquet(f"{tmp_path}/in")
        with pytest.warns(UserWarning):
            q = S.run(spark.readStream.schema(m.schema).parquet(f"{tmp_path}/in"), f"{tmp_path}/store", f"{tmp_path}/check", d, hot_terms=f"{tmp_path}/hot.json", sync=sync, respond=lambda e: e.select("conv_id", F.lit("ok").alias("response")), buckets=4)
            q.awaitTermination(120)
        assert q.exception() is None
        n = len(told) - 1
        read = lambda name: spark.read.parquet(f"{tmp_path}/store/{name}/batch={n}")
        return read("verdicts").collect(), read("escalations").collect(), read("rejected").collect()

    v, e, bad = step("zorbal", "")
    assert [(r.conv_id, r.risk, r.hot_version, r.n_messages) for r in v] == [(1, "MEDIUM", 1, 1)] and len(e) == 1 and len(bad) == 1
    (tmp_path / "hot.json").write_text(json.dumps({"data": [{"id": "H", "term": "nuevo", "category": "aislamiento", "weight": 2, "variants": []}], "dataset_version": 2}))
    v, e, _ = step("nuevo", at=5)
    assert [(r.risk, r.score, r.hot_version, r.n_messages) for r in v] == [("MEDIUM", 16, 2, 2)] and e == []  # answered before at this level
    v, e, _ = step("otra", conv=2, at=9)
    assert [r.conv_id for r in v] == [2] and told == [0, 1, 2]


def test_config_sets_are_known():
    assert {*CONFIG.action, *CONFIG.coercive, *CONFIG.directed} <= set(C.STAGE_OF) and len(C.STAGE_OF) == 15
