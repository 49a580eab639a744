"""Text operators as Column functions.

What Spark's own functions can do runs in them. Unicode forms, spaced-out words and leet need Python: it is given the
texts that show a sign of these, and null for the others, so a clean ASCII text costs it nothing.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from functools import cache, reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, ByteType, StringType, StructField, StructType

from hearken.sources.packs import Normalizer

#: Letters of other scripts that look Latin; only lower case is folded, before texts are lower-cased.
CONFUSABLE = ("аеорсухіѕјԁոмткѵαονρτκ", "aeopcyxisjdnmtkvaovptk")
INVISIBLE = "[\u00ad\u061c\u180e\u200b-\u200f\u202a-\u202e\u2060-\u2069\ufeff]"
LEET = ("0134579@$€!|", "oieastgasei" + "i")
#: White space, and the word boundary, of the regular expressions that dictionaries are written for.
BLANK = "[\t-\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"
_BLANKS = "\t\n\x0b\x0c\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
#: The same in Java, whose \w is ASCII and quick.
_EDGE = r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))"
_EDGE_HERE = _EDGE.replace(r"\w", "[A-Za-z0-9_]")
_PAUSE = "[-!,.:;?\u00a1\u00bf\u2013\u2014\u2026]+"
FILLERS = (("hesitation", "(?:m{2,}|em+|eh+)"), ("este", "este"), ("pues", "pues"), ("o-sea", f"o{BLANK}+sea"))
#: Bytes of an Arrow batch of texts.
BATCH_BYTES = 4 << 20
MARKERS = ("unicode", "spacing", "leet")
#: The label of each marker, and of what the voice branch does, among the transformations.
LABELS = {"unicode": "unicode-sanitize", "spacing": "collapse-spacing", "leet": "de-leet"}
_NOT_ASCII = r"[^\x00-\x7f]"
_SPACED_ASCII = r"(?:^|\s)[A-Za-z0-9](?:\s+[A-Za-z0-9]){3,}(?:\s|$|[.,!?])"
#: A letter and a sign in one run of letters, digits and signs: between the nearest two stand digits that spell nothing.
_LEET_SIGN = "[013457$9@!|]"
_LEET_ASCII = rf"[A-Za-z][268]*{_LEET_SIGN}|{_LEET_SIGN}[268]*[A-Za-z]"

_INVISIBLE = re.compile(INVISIBLE)
_MARKS = re.compile("[\u0300-\u036f]")
_SPACED = re.compile(rf"(?:(?<={BLANK})|\A)(?:[^\W_]{BLANK}+){{3,}}[^\W_](?={BLANK}|\Z|[.,!?])")
_SINGLES = re.compile(rf"(?:{BLANK}|\A)[^\W_]{BLANK}+[^\W_]{BLANK}")
_RUN, _REST = re.compile("[0-9$@€!|]+"), re.compile(r"(?:[^\W_]|[$@€!|])*")
_LEET, _FOLD = str.maketrans(*LEET), str.maketrans(*CONFUSABLE)


def _sanitize(t: str) -> str:
    return t if t.isascii() else _INVISIBLE.sub("", unicodedata.normalize("NFKC", t)).translate(_FOLD)


def _plain(t: str) -> str:
    return t if t.isascii() else _MARKS.sub("", unicodedata.normalize("NFD", t))


def _joined(t: str) -> str:
    return _SPACED.sub(lambda m: re.sub(f"{BLANK}+", "", m[0]), t) if _SINGLES.search(t) else t


def _unleet(t: str) -> str:
    """Tokens that mix letters with digits or signs, spelt with letters; only surroundings of such signs are looked at."""
    out, done = [], 0
    for run in _RUN.finditer(t):
        if run.start() < done:
            continue
        a = run.start()
        while a > done and t[a - 1].isalnum():
            a -= 1
        b = _REST.match(t, run.end()).end()
        token = t[a:b]
        out += [t[done:a], token.translate(_LEET) if any(map(str.isalpha, token)) else token]
        done = b
    return "".join([*out, t[done:]]) if out else t


def _voice(t: str) -> str:
    t = re.sub(_PAUSE, " ", _sanitize(t).lower().strip(_BLANKS))
    for _, filler in FILLERS:
        t = re.sub(rf"(?<![^\W_]){filler}(?![^\W_])", " ", t)
    return re.sub(f"{BLANK}+", " ", t).strip(_BLANKS)


def _prepared(t: str, voice: bool, symbols: tuple[tuple[str, str], ...]) -> tuple[str, bool, bool, bool]:
    """A text up to its accents, and which repairs changed it (none are looked for in speech)."""
    if voice:
        text, seen = _voice(t), (False, False, False)
    else:
        clean = _sanitize(t)
        low = clean.lower().strip(_BLANKS)
        near = _joined(low)
        text = _unleet(near)
        seen = (clean != t, near != low, text != near)
    for raw, canonical in symbols:
        if raw in text:
            text = text.replace(raw, f" {canonical} ")
    return _plain(text), *seen


_KIND = StructType([StructField("text", StringType()), *(StructField(x, BooleanType()) for x in MARKERS)])


def _mapped(f: Callable[[str], str]):
    @F.pandas_udf(StringType())
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else f(t))

    return run


def small_batches(spark: SparkSession) -> None:
    """Bounds what a Python worker holds at a time: Spark's 10,000 texts may be a GB."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


@cache
def _udf(f: Callable[[str], str]):
    return _mapped(f)


def _where(needed: Column, f: Callable[[str], str], t: Column) -> Column:
    if (spark := SparkSession.getActiveSession()) is not None:
        small_batches(spark)
    return F.when(needed, _udf(f)(F.when(needed, t))).otherwise(t)


def remove_accents(t: Column) -> Column:
    return _where(t.rlike(_NOT_ASCII), _plain, t)


def collapse_repeated(t: Column) -> Column:
    """Three and more of one character become two; line breaks and characters beyond the basic plane stay."""
    return F.regexp_replace(t, "([^\\n\\r\u2028\u2029\\x{10000}-\\x{10FFFF}])\\1{2,}", "$1$1")


def sanitize_unicode(t: Column) -> Column:
    return _where(t.rlike(_NOT_ASCII), _sanitize, t)


def collapse_spacing(t: Column) -> Column:
    return _where(t.rlike(_NOT_ASCII) | t.rlike(_SPACED_ASCII), _joined, t)


def de_leet(t: Column) -> Column:
    return _where(t.rlike(r"[0-9$@€!|]"), _unleet, t)


def expand_symbols(t: Column, pairs: tuple[tuple[str, str], ...]) -> Column:
    for raw, canonical in pairs:
        t = F.replace(t, F.lit(raw), F.lit(f" {canonical} "))
    return t


def js_pattern(pattern: str) -> str:
    """A pattern of a dictionary for Java: case counts for nothing, and \\b knows ASCII words only."""
    edge = lambda m: m[1] + (f"(?={m[2]})" if m[2] else "") + _EDGE
    return "(?iu)" + re.sub(r"((?:\\\\)*)\\b(?:(?=([A-Za-z0-9])(?![?*{]))|)", edge, pattern)


_PLAIN_PATTERN = re.compile(r"(?:\\b|[A-Za-z0-9 ]|\[[A-Za-z0-9]+\]|\((?:\?:)?[A-Za-z0-9 |]+\)|\?)+")
_PART = re.compile(r"\\b|([A-Za-z0-9 ]|\[[A-Za-z0-9]+\]|\((?:\?:)?[A-Za-z0-9 |]+\))(\?)?")


def words_of(pattern: str, most: int = 16) -> list[str]:
    """All that a pattern of letters, digits, blanks, edges, choices and ? can match, in lower case; [] for other patterns."""
    out = [""]
    if not _PLAIN_PATTERN.fullmatch(pattern) or re.search(r"(?:^|\?|\\b)\?", pattern):
        return []
    for part, maybe in _PART.findall(pattern):
        choices = list(part[1:-1]) if part.startswith("[") else part[1:-1].removeprefix("?:").split("|") if part.startswith("(") else [part]
        out = list(dict.fromkeys(a + b for a in out for b in [*choices, *([""] if maybe else [])]))
        if len(out) > most:
            return []
    return [] if "" in out else [x.lower() for x in out]


def may_match(low: Column, pattern: str) -> Column:
    """False where a pattern of a dictionary can't match a text, by a search for what it matches in that text's lower case.
    Java's patterns take a long s, a dotless i and a capital i with a dot for letters of ASCII."""
    words = words_of(pattern)
    if not words:
        return F.lit(True)
    odd = [c for c, like in (("\u017f", "s"), ("\u0131", "i"), ("\u0307", "i")) if any(like in w for w in words)]
    hits = [low.contains(x) for x in [*words, *odd]]
    return reduce(lambda a, b: a | b, hits)


def _literal(s: str) -> str:
    return re.sub(r"([\\$])", r"\\\1", s)


def fix_misspellings(t: Column, pairs: tuple[tuple[str, str], ...]) -> Column:
    if not pairs:
        return t
    out = t
    for raw, canonical in pairs:
        out = F.regexp_replace(out, js_pattern(rf"\b{raw}\b"), _literal(canonical))
    may = reduce(lambda a, b: a | b, (may_match(F.lower(t), raw) for raw, _ in pairs))
    return F.when(may & t.rlike(js_pattern("|".join(rf"\b{raw}\b" for raw, _ in pairs))), out).otherwise(t)


def expand_abbreviations(t: Column, pairs: tuple[tuple[str, str], ...]) -> Column:
    """Blanks squeezed, and words spelt out that are an abbreviation but for signs."""
    return _spelt_out(squeezed_blanks(t), pairs)


def squeezed_blanks(t: Column) -> Column:
    return F.when(t.rlike(_NOT_ASCII), F.regexp_replace(t, f"{BLANK}+", " ")).otherwise(F.regexp_replace(t, r"\s+", " "))


_SIGNS = r"[^\p{Lower}\p{Digit}' ]*+"


def _bare(w: str) -> str:
    return re.sub("[^a-z0-9']", "", w)


def _word(spelt: str) -> str:
    return f"(?:(?<= )|^){_SIGNS}(?:{spelt}){_SIGNS}(?![^ ])"


def _spelt_out(t: Column, pairs: tuple[tuple[str, str], ...]) -> Column:
    """expand_abbreviations of a text whose blanks are squeezed; only texts with such words are gone through."""
    table = {k: v for k, v in pairs if k and v}
    spelt = {k: _SIGNS.join(k) for k in table if _bare(k) == k}
    if not spelt:
        return t
    if any(_bare(w) in table for v in table.values() for w in re.split(f"{BLANK}+", v)):  # what one makes is no word for the next
        known = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])

        def word(w: Column) -> Column:
            bare = F.regexp_replace(w, "[^a-z0-9']", "")
            return F.when(bare.isin(*table), F.element_at(known, bare)).otherwise(w)

        expanded = F.array_join(F.transform(F.split(t, " ", -1), word), " ")
    else:
        expanded = t
        for k, x in spelt.items():
            expanded = F.regexp_replace(expanded, _word(x), _literal(table[k]))
    return F.when(t.rlike(_word("|".join(spelt.values()))), expanded).otherwise(t)


def phonetic(t: Column, rules: tuple[tuple[str, str], ...]) -> Column:
    for find, put in rules:
        t = F.regexp_replace(t, js_pattern(find), re.sub(r"\\(\d)", r"$\1", put))
    return t


def preprocess_voice(t: Column) -> Column:
    """Speech: sanitized, lower case, without pauses and four fillers, blanks squeezed."""
    needed = t.rlike(_NOT_ASCII)
    return F.when(needed, _udf(_voice)(F.when(needed, t))).otherwise(_spoken(F.lower(_trimmed(t))))


def _spoken(low: Column) -> Column:
    t = F.regexp_replace(low, "[-!,.:;?]+", " ")
    for _, filler in FILLERS:
        t = F.regexp_replace(t, rf"(?<![A-Za-z0-9]){filler}(?![A-Za-z0-9])", " ")
    return _trimmed(F.regexp_replace(t, r"\s+", " "))


def _trimmed(t: Column) -> Column:
    return F.btrim(t, F.lit("\t\n\x0b\x0c\r "))


def fold(t: Column) -> Column:
    """Lower case, trimmed, without accents: what dictionaries and texts are both put through at least."""
    return remove_accents(F.lower(_trimmed(t)))


def token_array(t: Column) -> Column:
    return F.when(t.rlike(_NOT_ASCII), F.regexp_extract_all(t, F.lit(r"[\p{L}\p{N}]+"), F.lit(0))).otherwise(F.regexp_extract_all(t, F.lit(r"\p{Alnum}+"), F.lit(0)))


@cache
def _prepare(symbols: tuple[tuple[str, str], ...]):
    @F.pandas_udf(_KIND)
    def run(texts: pd.Series, voice: pd.Series) -> pd.DataFrame:
        rows = [(None, None, None, None) if t is None else _prepared(t, v, symbols) for t, v in zip(texts, voice, strict=True)]
        return pd.DataFrame(rows, columns=["text", *MARKERS])

    return run


@F.arrow_udf(ByteType())
def _marked(texts: pa.Array) -> pa.Array:
    """The bits of the repairs that change each text; one text at a time is held as Python's."""
    out = []
    for x in texts:
        t = x.as_py()
        out.append(0 if t is None else sum(1 << i for i, seen in enumerate(_prepared(t, False, ())[1:]) if seen))
    return pa.array(out, pa.int8())


def _hard(t: Column) -> Column:
    """Texts in ASCII that may be spelt to evade, and all others: those that Python has to see."""
    return t.rlike(_NOT_ASCII) | t.rlike(_SPACED_ASCII) | (t.rlike(_LEET_SIGN) & t.rlike(_LEET_ASCII))


def evasion_bits(df: DataFrame, text: str = "text", into: str = "marks") -> DataFrame:
    """df with the bits of MARKERS, as normalized finds them, without what the texts become."""
    small_batches(df.sparkSession)
    t = F.col(text)
    d = df.withColumn("__hard", F.coalesce(_hard(t), F.lit(False)))
    return d.withColumn(into, F.coalesce(_marked(F.when(F.col("__hard"), t)), F.lit(0).cast("tinyint"))).drop("__hard")


def normalized(df: DataFrame, n: Normalizer, text: str = "text", source: str | None = None, labels: bool = False) -> DataFrame:
    """df with norm (the normalized text), unicode, spacing, leet (which evasion repairs changed it) and, if asked for,
    labels (what else changed it: symbols, spellings, abbreviations, sounds, speech). One projection a step, so that
    no step is worked out twice."""
    small_batches(df.sparkSession)
    t = F.col(text)
    voice = F.lit(False) if source is None else F.coalesce(F.col(source) == "voice_transcript", F.lit(False))
    d = df.withColumn("__voice", voice)
    d = d.withColumn("__hard", F.coalesce(t.rlike(_NOT_ASCII) | (~F.col("__voice") & (t.rlike(_SPACED_ASCII) | (t.rlike(_LEET_SIGN) & t.rlike(_LEET_ASCII)))), F.lit(False)))
    d = d.withColumn("__done", _prepare(n.symbols)(F.when(F.col("__hard"), t), F.col("__voice")))
    said = F.lower(_trimmed(t))
    if source is not None:
        said = F.when(F.col("__voice"), _spoken(said)).otherwise(said)
    d = d.withColumn("__base", F.when(F.col("__hard"), F.col("__done.text")).otherwise(expand_symbols(said, tuple((raw, _plain(put)) for raw, put in n.symbols if raw.isascii()))))
    d = d.withColumn("__two", collapse_repeated(F.col("__base"))).withColumn("__spelt", fix_misspellings(F.col("__two"), n.misspellings))
    d = d.withColumn("__flat", squeezed_blanks(F.col("__spelt"))).withColumn("__sound0", _spelt_out(F.col("__flat"), n.abbreviations))
    for k, rule in enumerate(n.phonetic):
        d = d.withColumn(f"__sound{k + 1}", phonetic(F.col(f"__sound{k}"), (rule,)))
    marks = {x: F.coalesce(F.col(f"__done.{x}"), F.lit(False)) for x in MARKERS}
    out = d.withColumns({"norm": F.col(f"__sound{len(n.phonetic)}"), **marks, **({"labels": _labels(t, n, source)} if labels else {})})
    return out.drop(*(c for c in out.columns if c.startswith("__")))


def _labels(t: Column, n: Normalizer, source: str | None) -> Column:
    """What normalized changed, from the columns of its steps."""
    arrow = lambda a, b: F.lit(f"{a}→{b}")
    low, voice = F.lower(t), F.col("__voice")
    out = [F.when(low.contains(raw), arrow(raw, put)) for raw, put in n.symbols]
    if source is not None:
        out.append(F.when(voice & t.rlike(f"{INVISIBLE}|[\uff01-\uff5e]"), "voice-unicode-sanitize"))
        out.append(F.when(voice & t.rlike(_PAUSE), "voice-pause-cleanup"))
        out += [F.when(voice & t.rlike(rf"(?iu)(?<![\p{{L}}\p{{N}}]){f}(?![\p{{L}}\p{{N}}])"), f"voice-filler:{name}") for name, f in FILLERS]
    out += [F.when(may_match(F.lower("__two"), raw) & F.col("__two").rlike(js_pattern(rf"\b{raw}\b")), arrow(raw, put)) for raw, put in n.misspellings]
    table = {k: v for k, v in n.abbreviations if k and v and _bare(k) == k}
    short = F.array().cast("array<string>")
    if table:
        known = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
        met = F.regexp_extract_all("__flat", F.lit(_word("|".join(map(_SIGNS.join, table)))), F.lit(0))
        bare = F.transform(met, lambda w: F.regexp_replace(w, "[^a-z0-9']", ""))
        short = F.transform(F.array_distinct(bare), lambda w: F.concat(w, F.lit("→"), F.element_at(known, w)))
    sounds = [F.when(F.col(f"__sound{k}") != F.col(f"__sound{k + 1}"), "phonetic:" + re.sub(r"\\(\d)", r"$\1", put)) for k, (_, put) in enumerate(n.phonetic)]
    listed = lambda xs: F.array_compact(F.array(*xs)) if xs else F.array().cast("array<string>")
    return F.array_distinct(F.concat(listed(out), short, listed(sounds)))


def normalize_surface(t: str, n: Normalizer) -> str:
    """What normalized makes of a dictionary surface, on the driver."""
    t = re.sub(r"([^\n\r\u2028\u2029\U00010000-\U0010ffff])\1{2,}", r"\1\1", _prepared(t, False, n.symbols)[0])
    edge = lambda p: re.compile(re.sub(r"\\b", lambda _: _EDGE_HERE, p), re.I)
    for raw, canonical in n.misspellings:
        t = edge(rf"\b{raw}\b").sub(lambda _, c=canonical: c, t)
    table = dict(n.abbreviations)
    t = " ".join(table.get(re.sub("[^a-z0-9']", "", w)) or w for w in re.split(f"{BLANK}+", t))
    for find, put in n.phonetic:
        t = edge(find).sub(put, t)
    return t
