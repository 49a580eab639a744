"""Dictionaries, hot terms, labelled cases and models from JSON files, read through Spark so that any of its file systems will do."""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import SparkSession

from hearken.sources.packs import Combination, Dampener, Dictionaries, Feature, Normalizer, Pack, Patterns, Rule, Signal, Term, validate_all

#: The one feature that needs another in its message, and the one that needs all its lexicons there.
GATES = {"low_specificity": ("ambiguous_opportunity", "call_to_action")}
ALL_OF = ("logistics_transfer",)


def read_json(spark: SparkSession, path: str) -> object:
    """The JSON value of one file."""
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


def _term(x: dict) -> Term:
    return Term(x["id"], x["term"], x["category"], float(x["weight"]), tuple(x.get("variants") or ()), x.get("requires_corroboration") is True)


def _rule(x: dict) -> Rule:
    need = x.get("categories_required")
    return Rule(x["id"], x.get("min_messages"), None if need is None else tuple((None, c) if isinstance(c, str) else (c["packId"], c["category"]) for c in need), x.get("min_categories"))


def pack(x: dict, default_id: str = "MX") -> Pack:
    """A region pack. Its older form, with no id and the rules in the metadata, is the pack `default_id` with legacy ids."""
    meta = x["metadata"]
    terms = tuple(map(_term, x["terms"]))
    if "id" not in x:
        rules = meta["multi_category_escalation_rules"]["rules"]
        return Pack(default_id, meta["version"], terms, tuple(map(_rule, rules)), default_id == "MX", float(meta["tier1_session_threshold"]), sources=tuple(meta.get("sources") or ()))
    return Pack(x["id"], x["version"], terms, tuple(map(_rule, x["rules"])), x.get("legacyOutputIds") is True, float(meta["sessionThreshold"]), x["schemaVersion"], x.get("displayName", ""), tuple(meta.get("sources") or ()))


def _features(xs: Iterable[dict], by_name: bool) -> tuple[Feature, ...]:
    out = []
    for x in xs:
        name = x["name"] if by_name else x["id"]
        logic = "NEGATED" if str(x.get("logic", "")).startswith("NEGATED") else "ALL" if name in ALL_OF else "ANY"
        out.append(Feature(x["id"], name, float(x.get("weight", 1)), tuple(x.get("derived_from") or ()), logic, GATES.get(name, ()), x.get("category")))
    return tuple(out)


def _combinations(xs: Iterable[dict]) -> tuple[Combination, ...]:
    """All but the rule that counts intents, which has no features."""
    return tuple(Combination(x["id"], tuple(x["features_required"]), float(x["bonus_score"])) for x in xs if x["features_required"])


def normalizer(x: dict) -> Normalizer:
    r = x["normalization_rules"]
    pairs = lambda xs, k="raw": tuple((e[k], e["canonical"]) for e in xs or ())
    return Normalizer(
        symbols=pairs(r["unicode_and_symbols"]),
        abbreviations=tuple((k.lower(), v) for k, v in pairs(r["chat_abbreviations"]["entries"], "abbr")),
        misspellings=tuple((k.lower(), v) for k, v in pairs(r.get("common_misspellings"))),
        phonetic=tuple((e["find"], str(e["replace"])) for e in (r.get("phonetic_rules") or {}).get("rules") or ()),
        lexicons=tuple((k, tuple(v["entries"])) for k, v in (x.get("lexicons") or {}).items() if not isinstance(v, str)),
        features=_features((x.get("N0_features") or {}).get("features") or (), False),
        combinations=_combinations((x.get("N0_combination_rules") or {}).get("rules") or ()),
    )


def patterns(x: dict) -> Patterns:
    return Patterns(
        lexicons=tuple((k, tuple(v)) for k, v in (x.get("lexicons") or {}).items()),
        features=_features(x.get("features") or (), True),
        combinations=_combinations(x.get("combination_rules") or ()),
        signals=tuple(Signal(s["id"], s["label"], tuple(s.get("patterns") or ()), float(s["weight"]), s["category"]) for s in x.get("explicit_signals") or ()),
        intents=tuple((i["id"], tuple(i.get("patterns") or ())) for i in x.get("intent_signals") or ()),
    )


def dampeners(x: dict) -> tuple[Dampener, ...]:
    return tuple(Dampener(d["id"], d["term"], tuple(d["dampen_categories"]), float(d["factor"]), tuple(d.get("variants") or ()), d.get("hard_context") is True) for d in x.get("dampeners") or ())


def load(spark: SparkSession, packs: Iterable[str], normalizer_path: str | None = None, patterns_path: str | None = None, dampeners_path: str | None = None) -> Dictionaries:
    """Dictionaries from JSON files, validated. Packs come in order of precedence; what has no path is empty."""
    found = Dictionaries(
        tuple(pack(read_json(spark, p)) for p in packs),
        normalizer(read_json(spark, normalizer_path)) if normalizer_path else Normalizer(),
        patterns(read_json(spark, patterns_path)) if patterns_path else Patterns(),
        dampeners(read_json(spark, dampeners_path)) if dampeners_path else (),
    )
    validate_all(found)
    return found


def load_hot_terms(spark: SparkSession, path: str) -> tuple[list[tuple[str | None, Term]], int | None]:
    """Hot terms and the version of a file {data: [...], dataset_version}; none if it can't be read."""
    from pyspark.errors import PySparkException

    try:
        x = read_json(spark, path)
        return [(t.get("packId"), _term(t)) for t in x.get("data") or ()], x["dataset_version"] if isinstance(x.get("dataset_version"), int) else None
    except (PySparkException, ValueError, KeyError, TypeError, AttributeError):
        return [], None
