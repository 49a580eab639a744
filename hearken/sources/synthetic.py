"""Synthetic dictionaries: words and syllables of invented prose under the rule structure of the engine."""

from __future__ import annotations

from hearken.sources.packs import Combination, Dampener, Dictionaries, Feature, Normalizer, Pack, Patterns, Rule, Signal, Term

MX = Pack(
    "MX",
    "1.0.0",
    legacy_ids=True,
    display_name="synthetic, with legacy ids",
    terms=(
        Term("REC-001", "erhe", "reclutamiento", 12, ("queda",)),
        Term("LF-001", "onhe", "logistica_fisica", 10, ("desde la",)),
        Term("AI-001", "onou", "aislamiento", 8, ("of the",)),
        Term("CC-001", "anly", "cambio_canal", 6, ("para",)),
        Term("SI-001", "retion", "solicitud_informacion", 5, ("por",), True),
        Term("OE-001", "enen", "oferta_economica", 7, ("los",)),
        Term("MS-001", "rees", "manipulacion_social", 4, ("una",)),
        Term("SD-001", "is", "señal_debil", 2, ("es",)),
    ),
    rules=(
        Rule("MCR-001", 2, ((None, "reclutamiento"), (None, "logistica_fisica"))),
        Rule("MCR-002", 3, ((None, "aislamiento"), ("MX", "cambio_canal"))),
        Rule("MCR-003", 2, min_categories=4),
    ),
)
EU = Pack(
    "EU",
    "0.2.0",
    (
        Term("REC-001", "reth", "reclutamiento", 9),
        Term("X-002", "erhe", "slang_operativo", 3),
        Term("X-003", "anti", "presion_de_grupo", 5, ("des",)),
        Term("X-004", "onhe", "logistica_fisica", 9, ("für",)),
    ),
    rules=(Rule("MCR-101", 1, (("EU", "reclutamiento"), ("EU", "presion_de_grupo"))),),
)

PATTERNS = Patterns(
    lexicons=(
        ("vague", ("onnd", "sich")),
        ("chance", ("erst", "sont")),
        ("call", ("erre", "dem")),
        ("places", ("onin", "eine")),
        ("acts", ("ering", "on the")),
        ("money", ("anon", "ción")),
        ("secret", ("onon", "nicht")),
        ("peers", ("eren", "mit")),
        ("easy", ("thes", "lich")),
        ("goods", ("anan", "auf")),
        ("carry", ("antion", "das")),
        ("gang", ("onble", "ench")),
        ("harm", ("blely", "tind")),
        ("threat", ("ones", "als")),
    ),
    features=(
        Feature("F001", "ambiguous_opportunity", 1.0, ("vague", "chance")),
        Feature("F002", "call_to_action", 1.0, ("call",)),
        Feature("F003", "low_specificity", 1.0, ("places", "acts"), "NEGATED", ("ambiguous_opportunity", "call_to_action")),
        Feature("F004", "money_mention", 2.0, ("money",)),
        Feature("F005", "secrecy_pressure", 3.0, ("secret",)),
        Feature("F006", "social_pressure", 2.0, ("peers",)),
        Feature("F007", "risk_minimization", 2.0, ("easy",)),
        Feature("F008", "logistics_transfer", 4.0, ("goods", "carry"), "ALL"),
        Feature("F009", "cartel_mention", 5.0, ("gang",)),
        Feature("F010", "violence_mention", 20.0, ("harm",)),
        Feature("F011", "coercion_threat", 3.0, ("threat",)),
    ),
    combinations=(
        Combination("CR-001", ("ambiguous_opportunity", "call_to_action"), 5.0),
        Combination("CR-002", ("ambiguous_opportunity", "call_to_action", "low_specificity"), 8.0),
        Combination("CR-003", ("call_to_action", "money_mention"), 6.0),
        Combination("CR-004", ("ambiguous_opportunity", "secrecy_pressure"), 10.0),
        Combination("CR-005", ("call_to_action", "social_pressure"), 8.0),
        Combination("CR-006", ("ambiguous_opportunity", "money_mention", "risk_minimization"), 10.0),
        Combination("CR-007", ("secrecy_pressure", "social_pressure"), 12.0),
        Combination("CR-008", ("logistics_transfer",), 10.0),
        Combination("CR-009", ("cartel_mention",), 15.0),
        Combination("CR-010", ("call_to_action", "violence_mention"), 10.0),
        Combination("CR-011", ("coercion_threat", "violence_mention"), 12.0),
        Combination("CR-012", ("cartel_mention", "violence_mention"), 15.0),
    ),
    signals=(
        Signal("EX-001", "ride", ("eror", "at the"), 9.0, "logistica_fisica"),
        Signal("EX-002", "secret", ("ver", "to the", "de la"), 10.0, "aislamiento"),
        Signal("EX-003", "recruit", ("anen", "en the", "und die"), 8.0, "reclutamiento"),
        Signal("EX-004", "goods", ("enein", "es the"), 9.0, "logistica_fisica"),
        Signal("EX-005", "police", ("hati", "con el"), 9.0, "contenido_normalizado"),
    ),
    intents=(
        ("INT-001", (r"\bonh[ae]\b", r"\bun [aeo]n\b")),
        ("INT-002", (r"\breea\b", r"\by la\b")),
        ("INT-003", (r"\bherh?e\b", r"\ben el\b")),
        ("INT-004", (r"\bon(or|ed)\b", r"\bist? der\b")),
        ("INT-005", (r"\bershe?\b",)),
    ),
)
DAMPENERS = (
    Dampener("DMP-01", "annd", ("reclutamiento", "oferta_economica"), 0.4, ("ti",), True),
    Dampener("DMP-02", "onwh", ("manipulacion_social", "aislamiento"), 0.5, ("son",)),
    Dampener("DMP-03", "thly", ("logistica_fisica",), 0.7),
    Dampener("DMP-04", "erly", ("logistica_fisica", "reclutamiento"), 0.3),
    Dampener("DMP-05", "onat", ("solicitud_informacion", "cambio_canal"), 0.4),
    Dampener("DMP-06", "erble", ("contenido_normalizado", "slang_operativo"), 0.1, ("pf",), True),
    Dampener("DMP-07", "eres", ("contenido_normalizado",), 0.2),
    Dampener("DMP-08", "al la", ("formalidad_deceptiva",), 0.4),
)
NORMALIZER = Normalizer(
    symbols=(("***", "stars"), ("###", "hashes"), ("%%%", "percent"), ("📦", "parcel")),
    abbreviations=(("th", "that"), ("nd", "and"), ("q", "que"), ("re", "regarding"), ("st", "street")),
    misspellings=(("thsh", "this"), ("edst", "best")),
    phonetic=((r"k", "qu"), (r"ph", "f"), (r"(.)\1", r"\1")),
    lexicons=(("sounds", ("oieaux", "enqu")), ("ends", ("ingst", "heitk")), ("plain", ("the", "der", "le", "el"))),
    features=(Feature("N0-F001", "N0-F001", 2.0, ("sounds",)), Feature("N0-F002", "N0-F002", 1.0, ("ends",)), Feature("N0-F003", "N0-F003", 1.0, ("plain",), "NEGATED")),
    combinations=(Combination("N0-CR-001", ("N0-F001", "N0-F003"), 3.0), Combination("N0-CR-002", ("N0-F001", "N0-F002"), 2.0)),
)
DICTIONARIES = Dictionaries((MX,), NORMALIZER, PATTERNS, DAMPENERS)
BOTH = Dictionaries((MX, EU), NORMALIZER, PATTERNS, DAMPENERS)
