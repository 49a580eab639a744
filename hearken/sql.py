"""The engine's semantics as DuckDB SQL, made from the same dictionaries: the yardstick of the queries.

Every fragment is a list of common table expressions `name AS (...)`. Patterns are literals, since DuckDB compiles those once.
"""

from __future__ import annotations

from collections.abc import Callable

from hearken.config import AGE_FACTOR, CONFIG, RISKS, STAGE_OF, STAGES, WEAK
from hearken.functions import text as T
from hearken.sources import packs as P

BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def in_(names) -> str:
    return "(" + ", ".join(map(q, names)) + ")"


def found(text: str, surfaces) -> str:
    return f"regexp_matches({text}, {q(P.any_pattern(surfaces))})" if surfaces else "false"


def trimmed(x: str) -> str:
    return f"trim({x}, {BLANKS})"


FOLD = f"lower(strip_accents({trimmed(chr(123) + chr(125))}))"


def fold(x: str) -> str:
    return FOLD.replace("{}", x)


#: conversations as folded messages.
NORM = f"norm AS (SELECT conv_id, turn::INT AS msg_idx, {fold(chr(99) + 'oalesce(text, ' + chr(39) * 2 + ')')} AS text, coalesce(text, '') AS raw, 1750000000000 + turn * 60000 AS ts_ms, role AS sender FROM conversations)"


#: Characters that runs are shortened of, one pattern each (RE2 has no back-references).
RUNS = [*map(chr, range(0x20, 0x7F)), *"\t¡¿«»·ºªáàâäãåæçéèêëíìîïñóòôöõøœúùûüýßß–—‘’“”…•€"]


def squeezed(x: str, least: int, most: str) -> str:
    """x with `least` of a character (a RE2 quantifier) replaced by it or, for most = 'two', by two of it."""
    for c in RUNS:
        one = chr(92) + c if not c.isalnum() and c.isascii() and c not in " \t" else c
        put = (chr(92) * 2 if c == chr(92) else c) * (2 if most == "two" else 1)
        x = f"regexp_replace({x}, {q(f'{one}{{{least}}}' if most == 'one' else f'{one}{{{least},}}')}, {q(put)}, 'g')"
    return x


def replaced(x: str, pairs, pad: str = "") -> str:
    for raw, put in pairs:
        x = f"replace({x}, {q(raw)}, {q(pad + put + pad)})"
    return x


def respelt(x: str, pairs) -> str:
    for raw, put in pairs:
        x = f"regexp_replace({x}, {q(f'(?i){chr(92)}b{raw}{chr(92)}b')}, {q(put)}, 'g')"
    return x


def unshortened(x: str, pairs) -> str:
    cases = " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in pairs)
    return f"array_to_string(list_transform(string_split_regex({x}, '\\s+'), lambda w: CASE regexp_replace(w, '[^a-z0-9'']', '', 'g') {cases} ELSE w END), ' ')"


def normalized(n: P.Normalizer, source: str, name: str = "norm") -> list[str]:
    """source (with text) as name, text normalized. Holds where the compatibility form of a text is itself, no words are
    spelt with blanks and no sign stands for a letter; rules of sound are literal but the last, which halves doubled letters."""
    sounds = [r for r in n.phonetic if "(" not in r[0]]
    symbols = replaced(f"lower({trimmed('text')})", n.symbols, " ")
    halved = squeezed("text", 2, "one") if len(sounds) < len(n.phonetic) else "text"
    return [
        f"n1 AS (SELECT * EXCLUDE (text), strip_accents({symbols}) AS text FROM {source})",
        f"n2 AS (SELECT * EXCLUDE (text), {squeezed('text', 3, 'two')} AS text FROM n1)",
        f"n3 AS (SELECT * EXCLUDE (text), {replaced(unshortened(respelt('text', n.misspellings), n.abbreviations), sounds)} AS text FROM n2)",
        f"{name} AS (SELECT * EXCLUDE (text), {halved} AS text FROM n3)",
    ]


RAW = "raw0 AS (SELECT conv_id, turn::INT AS msg_idx, coalesce(text, '') AS text, coalesce(text, '') AS raw, 1750000000000 + turn * 60000 AS ts_ms, role AS sender FROM conversations)"


def matches(packs, norm: str = "norm", name: str = "m", key: Callable[[str], str] = P.fold_key) -> str:
    row = "SELECT n.*, {} AS pack_idx, {} AS entry_idx, {} AS scoped, {} AS out_id, {} AS canonical_id, {} AS surface, {} AS category, {}::DOUBLE AS weight, {} AS ambiguous FROM {} n WHERE {}"
    rows = [row.format(k, n, q(f"{p}:{cat}"), q(o), q(c), q(s), q(cat), w, str(amb).lower(), norm, found("text", [s])) for k, n, p, o, c, s, cat, w, amb in P.entries(packs, key)]
    return f"{name} AS (" + " UNION ALL ".join(rows) + ")"


def kept(packs, norm: str = "norm", by: str = "conv_id", at: str = "", key: Callable[[str], str] = P.fold_key) -> list[str]:
    """CTEs {at}m matches, {at}f first matches by term after claims of at most two packs, {at}k the corroborated ones."""
    first = f"QUALIFY row_number() OVER (PARTITION BY {by}, canonical_id ORDER BY msg_idx, pack_idx, entry_idx) = 1"
    same = " AND ".join(f"o.{b} = x.{b}" for b in by.split(", "))
    return [
        matches(packs, norm, f"{at}m", key),
        f"{at}o AS (SELECT * FROM {at}m WHERE pack_idx = 0 {first})",
        f"{at}f AS (SELECT * FROM {at}o UNION ALL (SELECT * FROM {at}m x WHERE pack_idx > 0 AND NOT EXISTS (SELECT 1 FROM {at}o o WHERE {same} AND o.surface = x.surface AND o.category = x.category) {first}))",
        f"{at}k AS (SELECT * FROM {at}f QUALIFY NOT ambiguous OR bool_or(NOT ambiguous AND category <> {q(WEAK)}) OVER (PARTITION BY {by}))",
    ]


def actor(packs, norm: str = "norm", key: Callable[[str], str] = P.fold_key) -> list[str]:
    """CTE actor: conv_id, analyzed, aggressor, concentration."""
    c = CONFIG
    return [
        f"own AS (SELECT conv_id, sender, string_agg(text, ' ' ORDER BY msg_idx) AS text, min(msg_idx) AS fi, 0 AS msg_idx FROM {norm} WHERE sender <> '' GROUP BY conv_id, sender)",
        *kept(packs, "own", "conv_id, sender", "a_", key),
        f"each AS (SELECT own.conv_id, own.sender, fi, (SELECT count(DISTINCT category) FROM a_k k WHERE k.conv_id = own.conv_id AND k.sender = own.sender AND category IN {in_(c.directed)}) AS c FROM own)",
        "tops AS (SELECT conv_id, count(*) AS n, sum(c) AS total, max(c) AS top, arg_max(sender, struct_pack(c := c, x := -fi)) AS who FROM each GROUP BY conv_id)",
        f"actor AS (SELECT conv_id, n >= 2 AS analyzed, CASE WHEN n >= 2 AND top >= {c.min_directed} AND top / total >= {c.concentration} THEN who END AS aggressor, CASE WHEN n >= 2 AND total > 0 THEN round(top / total, 2) ELSE 0.0 END::DOUBLE AS concentration FROM tops)",
    ]


def n0_columns(n: P.Normalizer) -> list[str]:
    lex = {k: " OR ".join(f"contains(text, {q(s.lower())})" for s in v) or "false" for k, v in n.lexicons}
    out = []
    for f in n.features:
        hit = " OR ".join(f"({lex[x]})" for x in f.lexicons) or "false"
        out.append(f'{"NOT " if f.logic == "NEGATED" else ""}({hit}) AS "{f.id}"')
    return out


def pattern_columns(p: P.Patterns, dampeners=(), key: Callable[[str], str] = P.fold_key) -> list[str]:
    """Columns per message: features by name, signals, intents and dampeners by id."""
    lex = {k: found("text", [s for x in v if (s := key(x))]) for k, v in p.lexicons}
    out, by = [], {}
    for f in sorted(p.features, key=lambda f: f.logic == "NEGATED"):
        parts = [lex[x] for x in f.lexicons]
        gate = f" AND ({' OR '.join(by[g] for g in f.gate)})" if f.gate else ""
        by[f.name] = f"({' AND '.join(parts)})" if f.logic == "ALL" else f"(NOT ({' OR '.join(parts)}){gate})" if f.logic == "NEGATED" else f"({' OR '.join(parts)})"
    out += [f'{by[f.name]} AS "{f.name}"' for f in p.features]
    out += [f'{found("text", list(map(key, s.surfaces)))} AS "{s.id}"' for s in p.signals]
    out += [f'({" OR ".join(f"regexp_matches(text, {q("(?i)" + r)})" for r in rx)}) AS "{i}"' for i, rx in p.intents]
    return out + [f'{found("text", list(map(P.fold_key, (d.term, *d.variants))))} AS "{d.id}"' for d in dampeners]


def flags(d: P.Dictionaries, norm: str = "norm", key: Callable[[str], str] = P.fold_key, n0: bool = False) -> list[str]:
    """CTEs per (per message) and conv (per conversation): all features, signals, intents and dampeners as booleans."""
    p = d.patterns
    names = [*(f.name for f in p.features), *(s.id for s in p.signals), *(i for i, _ in p.intents), *(x.id for x in d.dampeners), *((f.id for f in d.normalizer.features) if n0 else ())]
    firsts = [f'min(msg_idx) FILTER ("{s.id}") AS "at_{s.id}"' for s in p.signals]
    cols = pattern_columns(p, d.dampeners, key) + (n0_columns(d.normalizer) if n0 else [])
    return [
        f"per AS (SELECT conv_id, msg_idx, ts_ms, raw, {', '.join(cols)} FROM {norm})",
        f"conv AS (SELECT conv_id, count(*) AS n_messages, max(ts_ms) AS now, {', '.join([*(f'bool_or({chr(34)}{x}{chr(34)}) AS {chr(34)}{x}{chr(34)}' for x in names), *firsts])} FROM per GROUP BY conv_id)",
    ]


def listing(pairs) -> str:
    """A list of the names whose conditions hold."""
    return "list_filter([" + ", ".join(f"CASE WHEN {c} THEN {q(n)} END" for c, n in pairs) + "]::VARCHAR[], lambda x: x IS NOT NULL)"


def total(pairs) -> str:
    return "(0.0" + "".join(f" + CASE WHEN {c} THEN {float(v)} ELSE 0.0 END" for c, v in pairs) + ")::DOUBLE"


def all_of(names) -> str:
    return "(" + " AND ".join(f'"{x}"' for x in names) + ")"


def grooming(p: P.Patterns) -> str:
    return "(" + " + ".join(f'"{i}"::INT' for i, _ in p.intents) + f" >= {CONFIG.intents_needed})"


def v4_rules(p: P.Patterns) -> str:
    return listing([*((all_of(c.features), c.id) for c in p.combinations), (grooming(p), CONFIG.intents_rule)])


def v4_score(p: P.Patterns) -> str:
    one = lambda x: f'"{x}"'
    return total([*((one(f.name), f.weight) for f in p.features), *((one(s.id), s.weight) for s in p.signals), *((all_of(c.features), c.bonus) for c in p.combinations), (grooming(p), CONFIG.intents_bonus)])


def mcr(packs, cats: str = "cs", scoped: str = "sc", n: str = "n_messages") -> str:
    out = []
    for p in packs:
        for r in p.rules:
            if r.categories_required:
                need = " AND ".join(f"list_contains({scoped}, {q(f'{a}:{c}')})" if a else f"list_contains({cats}, {q(c)})" for a, c in r.categories_required)
                out.append((f"{need} AND {n} >= {r.min_messages}", P.out_id(p, r.id)))
            if r.min_categories is not None:
                out.append((f"len({cats}) >= {r.min_categories} AND {n} >= {r.min_messages}", P.out_id(p, r.id)))
    return listing(out)


def factor(dampeners, signals, row: str = "c") -> str:
    """The least factor of the dampeners that apply to a term's category."""
    explicit = " OR ".join(f'{row}."{s.id}"' for s in signals) or "false"
    return "least(1.0, " + ", ".join(f'CASE WHEN {row}."{d.id}" AND NOT ({explicit}) AND category IN {in_(d.categories)} AND category <> {q(CONFIG.never_dampened)} THEN {d.factor} ELSE 1.0 END' for d in dampeners) + ")"


def age(band: str) -> str:
    return "CASE " + " ".join(f"WHEN {band} = {q(b)} AND category = {q(c)} THEN {f}" for b, by in AGE_FACTOR.items() for c, f in by.items()) + " ELSE 1.0 END"


def progress(source: str, name: str = "line") -> list[str]:
    """source(conv_id, category, ts_ms, ord) to name(conv_id, stages, ordered, span_days, rules)."""
    c = CONFIG
    stage = "CASE category " + " ".join(f"WHEN {q(x)} THEN {k}" for x, k in STAGE_OF.items()) + " END"
    return [
        f"st AS (SELECT conv_id, {stage} AS k, ts_ms, ord FROM {source})",
        "s1 AS (SELECT conv_id, k, min(ts_ms) AS f, min(ord) AS o, max(ts_ms) AS last, count(DISTINCT ts_ms // 86400000) AS days FROM st WHERE k IS NOT NULL GROUP BY conv_id, k)",
        "s2 AS (SELECT *, lag(k) OVER (PARTITION BY conv_id ORDER BY f, o) AS p FROM s1)",
        f"s3 AS (SELECT conv_id, string_agg(({in_(STAGES).replace('(', '[').replace(')', ']')})[k + 1], ',' ORDER BY f, o) AS stages, count(*) AS n, bool_and(p IS NULL OR k > p) AND count(*) >= 2 AS ordered, max(last) - min(f) AS span, max(k) AS deepest, coalesce(max(days) FILTER (k = 2), 0) AS iso FROM s2 GROUP BY conv_id)",
        f"{name} AS (SELECT conv_id, stages, n AS n_stages, ordered, round(span / 86400000.0, 2)::DOUBLE AS span_days, {listing([(f'n >= 3 AND ordered AND deepest >= 2 AND span >= {c.chain_hours * 3600000}', 'TCR-001'), (f'iso >= 2 AND n >= 2 AND span >= {c.isolation_days * 86400000}', 'TCR-002')])} AS tcr FROM s3)",
    ]


def engine(d: P.Dictionaries, head: list[str], key: Callable[[str], str] = P.fold_key, n0: bool = False) -> list[str]:
    """CTE verdict: one row per conversation of `norm` (made by head), with all that is decided. No ages, no evasion."""
    p, c, n = d.patterns, CONFIG, d.normalizer
    zero = [(f'"{f.id}"', f.weight) for f in n.features] + [(all_of(x.features), x.bonus) for x in n.combinations] if n0 else []
    n0_rules = listing([(all_of(x.features), x.id) for x in n.combinations] if n0 else [])
    n0_feats = listing([(f'"{f.id}"', f.id) for f in n.features] if n0 else [])
    said = " UNION ALL ".join(f'SELECT conv_id, {q(s.category)} AS category, 2 AS l, "at_{s.id}" AS a, {i} AS b, {q(s.id)} AS id FROM conv WHERE "{s.id}"' for i, s in enumerate(p.signals))
    quoted = lambda xs: [(f'"{x}"', x) for x in xs]
    dampened_by = listing([(f'bool_or("{x.id}" AND NOT explicit AND category IN {in_(x.categories)} AND category <> {q(c.never_dampened)})', x.id) for x in d.dampeners])
    hard = " OR ".join(f'"{x.id}"' for x in d.dampeners if x.hard_context) or "false"
    inside = lambda names: f"list_has_any(categories, [{', '.join(map(q, names))}])"
    full = "(list_contains(tcr, 'TCR-001') AND n_stages >= 4)"
    one = "aggressor IS NOT NULL"
    chain = "len(tcr) > 0"
    imminent = f"((r = 3 AND list_contains(categories, {q(c.imminent)})) OR {full})"
    return [
        *head,
        *kept(d.packs, key=key),
        *flags(d, key=key, n0=n0),
        *actor(d.packs, key=key),
        f"conv2 AS (SELECT *, ({' OR '.join(chr(34) + s.id + chr(34) for s in p.signals)}) AS explicit FROM conv)",
        f"points AS (SELECT conv_id, sum(round(weight * {factor(d.dampeners, p.signals)}::DOUBLE)) AS v3_score, list_sort(list(DISTINCT category)) AS cs, list(DISTINCT scoped) AS sc, list_sort(list(DISTINCT out_id)) AS v3_terms, count(*) AS n_terms, {dampened_by} AS dampeners_applied FROM k JOIN conv2 c USING (conv_id) GROUP BY conv_id)",
        f"said AS (SELECT s.*, n.ts_ms FROM ({said}) s JOIN norm n ON n.conv_id = s.conv_id AND n.msg_idx = s.a)",
        f"hits0 AS (SELECT conv_id, category, ts_ms, 1 AS l, msg_idx AS a, pack_idx * 10000 + entry_idx AS b FROM k UNION ALL SELECT conv_id, category, ts_ms, l, a, b FROM said UNION ALL SELECT conv_id, {q(c.intents_category)}, now, 3, 0, 0 FROM conv WHERE {grooming(p)})",
        "hits AS (SELECT conv_id, category, ts_ms, row_number() OVER (PARTITION BY conv_id ORDER BY l, a, b) AS ord FROM hits0)",
        *progress("hits"),
        "spans AS (SELECT conv_id, count(*) AS n, min(ts_ms) AS lo, max(ts_ms) AS hi FROM hits GROUP BY conv_id)",
        "signals AS (SELECT conv_id, list_sort(list(id)) AS signals, list(DISTINCT category) AS said_categories FROM said GROUP BY conv_id)",
        f"d0 AS (SELECT c.*, {total(zero)} AS n0_score, {n0_rules} AS n0_rules, {n0_feats} AS n0_features, {v4_score(p)} AS v4_score, {v4_rules(p)} AS cr, {listing(quoted(f.name for f in p.features))} AS v4_features, {listing(quoted(x.id for x in d.dampeners))} AS dampeners, {grooming(p)}::INT AS groom FROM conv2 c)",
        "d1 AS (SELECT d0.*, coalesce(v3_score, 0)::DOUBLE AS v3_score, coalesce(cs, []) AS cs, coalesce(sc, []) AS sc, coalesce(v3_terms, []) AS v3_terms, coalesce(dampeners_applied, []) AS dampeners_applied, coalesce(signals, []) AS signals, list_sort(list_distinct(list_concat(coalesce(cs, []), coalesce(said_categories, [])))) AS categories, coalesce(stages, '') AS stages, coalesce(n_stages, 0) AS n_stages, coalesce(span_days, 0.0) AS span_days, coalesce(ordered, false) AS ordered, coalesce(tcr, []) AS tcr, coalesce(analyzed, false) AS analyzed, aggressor, coalesce(concentration, 0.0) AS concentration, coalesce(s.n, 0) + len(v4_features) + len(n0_features) AS n_hits, CASE WHEN len(v4_features) + len(n0_features) > 0 THEN least(coalesce(s.lo, now), now) ELSE s.lo END AS lo, CASE WHEN len(v4_features) + len(n0_features) > 0 THEN now ELSE s.hi END AS hi FROM d0 LEFT JOIN points USING (conv_id) LEFT JOIN signals USING (conv_id) LEFT JOIN line USING (conv_id) LEFT JOIN actor USING (conv_id) LEFT JOIN spans s USING (conv_id))",
        f"d2 AS (SELECT *, {mcr(d.packs)} AS mcr, CASE WHEN n_hits >= {c.velocity_hits} THEN round((hi - lo) / 1000) ELSE 0 END::BIGINT AS window_s FROM d1)",
        f"d3 AS (SELECT *, n_hits >= {c.velocity_hits} AND window_s <= {c.velocity_seconds} AS velocity, len(mcr) + len(cr) AS n_rules, len(mcr) + len(cr) + len(n0_rules) > 0 AS active_rule FROM d2)",
        f"d4 AS (SELECT *, CASE WHEN velocity AND active_rule THEN round((n0_score + v3_score + v4_score) * {c.velocity_bonus}) ELSE n0_score + v3_score + v4_score END::DOUBLE AS score, CASE WHEN len(dampeners_applied) > 0 THEN 0 ELSE n_rules END AS nr, len(list_filter(categories, lambda x: x <> {q(WEAK)})) >= 2 OR active_rule OR explicit AS backed FROM d3)",
        f"d5 AS (SELECT *, CASE WHEN score >= {c.critical} OR nr >= {c.rules_critical} THEN 3 WHEN score >= {c.high} OR (velocity AND nr > 0) THEN 2 WHEN score >= {d.packs[0].threshold} THEN 1 ELSE 0 END AS r0 FROM d4)",
        f"d6 AS (SELECT *, greatest(CASE WHEN r0 >= 2 AND NOT backed THEN 1 ELSE r0 END, CASE WHEN {full} THEN 2 WHEN {chain} THEN 1 ELSE 0 END) AS r1 FROM d5)",
        f"d7 AS (SELECT *, greatest(CASE WHEN ({hard}) AND NOT {inside(c.action)} AND NOT {chain} AND r1 >= 2 THEN 1 ELSE r1 END, CASE WHEN {one} THEN 1 ELSE 0 END) AS r2 FROM d6)",
        f"d8 AS (SELECT *, CASE WHEN analyzed AND NOT {one} AND concentration <= {c.reciprocity} AND NOT active_rule AND NOT {inside(c.coercive)} AND NOT {chain} AND r2 = 1 THEN 0 ELSE r2 END AS r, active_rule OR explicit OR {one} OR {chain} AS proof FROM d7)",
        f"verdict AS (SELECT *, [{', '.join(map(q, RISKS))}][r + 1] AS risk, r > 0 AND NOT (r >= 2 AND proof) AS escalate, CASE WHEN r = 0 THEN 'none_low_risk' WHEN r >= 2 AND proof THEN 'confident_local_proof' ELSE 'uncertain_needs_llm' END AS reason, CASE WHEN r = 0 THEN 'ALLOW' WHEN {imminent} THEN 'HARD_BLOCK' WHEN r >= 2 THEN 'SILENT_OBSERVE' ELSE 'SOFT_WARN' END AS recruiter_action, CASE WHEN r = 0 THEN '' WHEN {imminent} THEN 'PRESERVE_EVIDENCE,NOTIFY_GUARDIAN,RESTRICT_CONTACT,WARN_MINOR' WHEN r >= 2 THEN 'SHADOW_FLAG,WARN_MINOR' || CASE WHEN {one} THEN ',RESTRICT_CONTACT' ELSE '' END ELSE 'SHADOW_FLAG' END AS protective_actions, CASE WHEN r = 0 THEN 'NINGUNA' ELSE 'CAPTACION' END AS stage, CASE WHEN r = 0 THEN 'NONE' WHEN {imminent} THEN 'HARD_BLOCK' ELSE 'WARNING_OVERLAY' END AS ux_recommendation FROM d8)",
    ]


#: The columns of a verdict that queries return: as they are, and lists joined in order.
PLAIN = "conv_id score risk escalate reason recruiter_action protective_actions stage ux_recommendation n0_score v3_score v4_score stages span_days velocity window_s analyzed aggressor concentration".split()
LISTS = "categories n0_rules n0_features v3_terms mcr cr v4_features signals dampeners dampeners_applied".split()


def verdict_columns() -> str:
    cols = [*PLAIN, "n_messages::BIGINT AS n_messages", "n_hits::INT AS n_hits", "array_to_string(tcr, ',') AS temporal_rules", *(f"array_to_string(list_sort({x}), ',') AS {x}" for x in LISTS)]
    return ", ".join(cols)


def with_(*ctes: str) -> str:
    return "WITH " + ", ".join(ctes)
