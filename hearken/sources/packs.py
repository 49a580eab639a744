"""The dictionaries of the engine as data: region packs, normalizer, patterns, dampeners; validation and hot terms."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field, replace

from hearken.config import STAGE_OF

_PACK_ID = re.compile(r"[A-Z0-9]+(?:-[A-Z0-9]+)*")


@dataclass(frozen=True)
class Term:
    id: str
    term: str
    category: str
    weight: float
    variants: tuple[str, ...] = ()
    requires_corroboration: bool = False


@dataclass(frozen=True)
class Rule:
    id: str
    min_messages: int
    categories_required: tuple[tuple[str | None, str], ...] | None = None
    min_categories: int | None = None


@dataclass(frozen=True)
class Pack:
    id: str
    version: str
    terms: tuple[Term, ...]
    rules: tuple[Rule, ...] = ()
    legacy_ids: bool = False
    threshold: float = 12.0
    schema_version: int = 1
    display_name: str = ""
    sources: tuple[str, ...] = ()
    #: Surfaces that came as hot terms: (term, surfaces that it adds).
    hot: tuple[tuple[Term, tuple[str, ...]], ...] = ()


@dataclass(frozen=True)
class Feature:
    """A weighted feature of lexicons. ANY and ALL look at one message; NEGATED holds in a message that none occurs in,
    with a gate only if one of the gate's features holds in that message."""

    id: str
    name: str
    weight: float
    lexicons: tuple[str, ...]
    logic: str = "ANY"
    gate: tuple[str, ...] = ()
    category: str | None = None


@dataclass(frozen=True)
class Combination:
    id: str
    features: tuple[str, ...]
    bonus: float


@dataclass(frozen=True)
class Signal:
    id: str
    label: str
    surfaces: tuple[str, ...]
    weight: float
    category: str


@dataclass(frozen=True)
class Normalizer:
    """Replacements of layer 0, each in order, and its own substring lexicons, features and combinations."""

    symbols: tuple[tuple[str, str], ...] = ()
    abbreviations: tuple[tuple[str, str], ...] = ()
    misspellings: tuple[tuple[str, str], ...] = ()
    phonetic: tuple[tuple[str, str], ...] = ()
    lexicons: tuple[tuple[str, tuple[str, ...]], ...] = ()
    features: tuple[Feature, ...] = ()
    combinations: tuple[Combination, ...] = ()


@dataclass(frozen=True)
class Patterns:
    """The second layer: lexicons of surfaces, features and combinations on them, explicit signals, intents (regexes)."""

    lexicons: tuple[tuple[str, tuple[str, ...]], ...] = ()
    features: tuple[Feature, ...] = ()
    combinations: tuple[Combination, ...] = ()
    signals: tuple[Signal, ...] = ()
    intents: tuple[tuple[str, tuple[str, ...]], ...] = ()


@dataclass(frozen=True)
class Dampener:
    id: str
    term: str
    categories: tuple[str, ...]
    factor: float
    variants: tuple[str, ...] = ()
    hard_context: bool = False


@dataclass(frozen=True)
class Dictionaries:
    packs: tuple[Pack, ...]
    normalizer: Normalizer = field(default_factory=Normalizer)
    patterns: Patterns = field(default_factory=Patterns)
    dampeners: tuple[Dampener, ...] = ()
    hot_version: int | None = None


def validate(packs: tuple[Pack, ...]) -> None:
    """Raises ValueError on a schema, id, threshold, legacy, uniqueness or reference error; no packs are one too."""
    ids = [p.id for p in packs]
    errors = [] if packs else ["at least one pack is needed"]
    if len(set(ids)) != len(ids):
        errors.append("pack ids repeat")
    if len({p.threshold for p in packs}) > 1:
        errors.append("thresholds differ")
    if [p.id for p in packs if p.legacy_ids] not in ([], ["MX"]):
        errors.append("only MX may keep legacy ids")
    for p in packs:
        if p.schema_version != 1 or not _PACK_ID.fullmatch(p.id):
            errors.append(f"{p.id}: schema version or id")
        for what, names in (("term", [t.id for t in p.terms]), ("rule", [r.id for r in p.rules])):
            if len(set(names)) != len(names):
                errors.append(f"{p.id}: {what} ids repeat")
        for t in p.terms:
            if not t.term.strip() or any(not v.strip() for v in t.variants) or not 0 <= t.weight <= 30:
                errors.append(f"{p.id}/{t.id}: blank surface or weight")
        for r in p.rules:
            if r.min_messages is None or (r.categories_required is not None and not r.categories_required):
                errors.append(f"{p.id}/{r.id}: no condition")
            errors += [f"{p.id}/{r.id}: {q} isn't loaded" for q, _ in r.categories_required or () if q and q not in ids]
            errors += [f"{p.id}/{r.id}: unknown category {c}" for _, c in r.categories_required or () if c not in STAGE_OF]
    if errors:
        raise ValueError("; ".join(errors))


def validate_all(d: Dictionaries) -> None:
    """validate, and the invariants of the other dictionaries: known lexicons and features, bits of a mask, factors, regexes."""
    validate(d.packs)
    errors = []
    for what, x in (("normalizer", d.normalizer), ("patterns", d.patterns)):
        lexicons, names = {k for k, _ in x.lexicons}, {f.name for f in x.features}
        ids = [*(f.id for f in x.features), *(c.id for c in x.combinations)]
        if len(set(ids)) != len(ids):
            errors.append(f"{what}: ids repeat")
        if max(len(lexicons), len(names)) > 62:
            errors.append(f"{what}: more than 62 lexicons or features")
        errors += [f"{what}/{f.id}: unknown lexicon" for f in x.features if not set(f.lexicons) <= lexicons or f.logic not in ("ANY", "ALL", "NEGATED")]
        errors += [f"{what}/{c.id}: unknown feature" for c in x.combinations if not set(c.features) <= names]
    errors += [f"{s.id}: unknown category" for s in d.patterns.signals if s.category not in STAGE_OF]
    errors += [f"{x.id}: factor" for x in d.dampeners if not 0 <= x.factor <= 1]
    for _, regexes in d.patterns.intents:
        for r in regexes:
            re.compile(r)
    if errors:
        raise ValueError("; ".join(errors))


def add_hot_terms(packs: tuple[Pack, ...], hot: Iterable[tuple[str | None, Term]]) -> tuple[Pack, ...]:
    """Packs with hot terms: surfaces that no entry has are added (see index_of); an unknown pack is an error."""
    by = {p.id: p for p in packs}
    for pack_id, term in hot:
        pack_id = pack_id or "MX"
        if pack_id not in by:
            raise ValueError(f"unknown pack {pack_id}")
        by[pack_id] = replace(by[pack_id], hot=(*by[pack_id].hot, (term, (term.term, *term.variants))))
    return tuple(by.values())


def fold_key(surface: str) -> str:
    """What a surface is put through without a normalizer: trimmed, lower case, no accents."""
    import unicodedata

    return re.sub("[̀-ͯ]", "", unicodedata.normalize("NFD", surface.strip().lower()))


def index_of(pack: Pack, key: Callable[[str], str] = fold_key) -> dict[str, Term]:
    """Surface key to term. A later equal surface of the pack replaces the term and keeps the place; a hot one only adds."""
    index: dict[str, Term] = {}
    for t in pack.terms:
        for s in (t.term, *t.variants):
            if k := key(s):
                index[k] = t
    for t, surfaces in pack.hot:
        for s in surfaces:
            if k := key(s):
                index.setdefault(k, t)
    return index


def out_id(pack: Pack, local: str) -> str:
    return local if pack.legacy_ids else f"{pack.id}-{local}"


def entries(packs: tuple[Pack, ...], key: Callable[[str], str] = fold_key) -> list[tuple]:
    """(pack_idx, entry_idx, pack_id, out_id, canonical_id, surface, category, weight, ambiguous): one per surface."""
    return [
        (k, n, p.id, out_id(p, t.id), f"{p.id}-{t.id}", s, t.category, float(t.weight), t.requires_corroboration)
        for k, p in enumerate(packs)
        for n, (s, t) in enumerate(index_of(p, key).items())
    ]


def surface_pattern(surface: str) -> str:
    """Word-bounded, blank-tolerant pattern that Java and RE2 both take."""
    body = r"\s+".join(re.sub(r"([.*+?^${}()|\[\]\\])", r"\\\1", w) for w in surface.split())
    return rf"(?:^|[^\p{{L}}\p{{N}}]){body}(?:[^\p{{L}}\p{{N}}]|$)"


def any_pattern(surfaces: Iterable[str]) -> str:
    return "|".join(surface_pattern(s) for s in surfaces)
