"""Evaluation: confusion, actions, groups, percentiles, reports, and adversarial variants of conversations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_LATIN = ("aeopcyxisjdnmtkv", "аеорсухіѕјԁոмткѵ")


def _ratio(x: Column, y: Column) -> Column:
    return F.when(y > 0, x / y).otherwise(0.0)


def confusion(df: DataFrame, predicted: str, actual: str, *by: str) -> DataFrame:
    """tp, fp, fn, tn, precision, recall, f1, fpr, accuracy of boolean columns, by groups; a ratio of nothing is 0."""
    p, a = F.col(predicted), F.col(actual)
    got = df.groupBy(*by).agg(F.count_if(p & a).alias("tp"), F.count_if(p & ~a).alias("fp"), F.count_if(~p & a).alias("fn"), F.count_if(~p & ~a).alias("tn"))
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    return got.withColumns({"precision": _ratio(tp, tp + fp), "recall": _ratio(tp, tp + fn), "f1": _ratio(2 * tp, 2 * tp + fp + fn), "fpr": _ratio(fp, fp + tn), "accuracy": _ratio(tp + tn, tp + fp + fn + tn)})


def action_metrics(df: DataFrame, risk: str, actual: str) -> DataFrame:
    """False blocks, benign reviews, missed and reached risks of a column of risk levels and a boolean of true risk."""
    r, a = F.col(risk), F.col(actual)
    block, benign, risky = r.isin("HIGH", "CRITICAL"), F.count_if(~a), F.count_if(a)
    share = lambda c, of: _ratio(F.count_if(c).cast("double"), of)
    return df.agg(
        F.count_if(block & ~a).alias("false_blocks"),
        share(block & ~a, benign).alias("false_block_rate"),
        share((r == "MEDIUM") & ~a, benign).alias("benign_review_rate"),
        F.count_if((r == "LOW") & a).alias("missed_risks"),
        share((r == "LOW") & a, risky).alias("miss_rate"),
        share((r != "LOW") & a, risky).alias("risk_reach_rate"),
    )


def escalation_metrics(df: DataFrame, risk: str, escalate: str, actual: str) -> DataFrame:
    """The share of benign rows that escalate, and of risky ones that are flagged or escalate."""
    a, e = F.col(actual), F.col(escalate)
    return df.agg(_ratio(F.count_if(e & ~a).cast("double"), F.count_if(~a)).alias("benign_escalation_rate"), _ratio(F.count_if(((F.col(risk) != "LOW") | e) & a).cast("double"), F.count_if(a)).alias("risk_coverage"))


def percentiles(df: DataFrame, value: str, *by: str) -> DataFrame:
    """Nearest-rank p50 and p95, mean and maximum."""
    pct = lambda q: F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY {value})")
    return df.groupBy(*by).agg(pct(0.5).alias("p50"), pct(0.95).alias("p95"), F.avg(value).alias("mean"), F.max(value).alias("max"), F.count(value).alias("n"))


def write_report(tables: dict[str, DataFrame], path: str) -> None:
    """Each table as JSON lines in a folder of its name."""
    for name, df in tables.items():
        df.write.mode("overwrite").json(f"{path}/{name}")


def markdown(df: DataFrame, most: int = 200) -> str:
    """A table of the first `most` rows for people to read; the report is cut there, the data isn't."""
    rows = df.limit(most).collect()
    line = lambda xs: "| " + " | ".join("" if x is None else f"{x:.4f}" if isinstance(x, float) else str(x) for x in xs) + " |"
    return "\n".join([line(df.columns), "|" + "---|" * len(df.columns), *map(line, rows)])


# --- adversarial variants -----------------------------------------------------------------------------------------
def _leet(t: Column) -> Column:
    """Every other character that leet can spell is so spelt, beginning with the first."""
    of, to = "aeiostlAEIOSTL", "4310$714310$71"
    runs = F.split(F.regexp_replace(t, f"(?=[{of}])", "\x00"), "\x00", -1)  # each but the first begins with such a character
    spelt = F.transform(runs, lambda r, i: F.when((i > 0) & (i % 2 == 1), F.concat(F.translate(F.substring(r, 1, 1), of, to), F.substr(r, F.lit(2)))).otherwise(r))
    return F.array_join(spelt, "")


ADVERSARIAL: dict[str, Callable[[Column], Column]] = {
    "homoglyphs": lambda t: F.translate(t, _LATIN[0] + _LATIN[0].upper(), _LATIN[1] * 2),
    "invisibles": lambda t: F.regexp_replace(t, r"(\p{L})(?=\p{L})", "$1​"),
    "fullwidth": lambda t: F.translate(t, "".join(map(chr, range(0x21, 0x7F))), "".join(chr(c + 0xFEE0) for c in range(0x21, 0x7F))),
    "leet_aggressive": _leet,
    "intra_word_spaces": lambda t: _spread(t),
}


def _spread(t: Column) -> Column:
    """Blanks between the letters of words of four letters and more."""
    parts = F.split(F.regexp_replace(t, r"(\p{L}{4,})", "\x00\x01$1\x00"), "\x00", -1)
    return F.array_join(F.transform(parts, lambda p: F.when(p.startswith("\x01"), F.regexp_replace(F.substr(p, F.lit(2)), r"(?<=\p{L})(?=\p{L})", " ")).otherwise(p)), "")


def split_messages(messages: DataFrame) -> DataFrame:
    """Every message as two halves, in order; halves are nobody's and of no source."""
    half = F.floor(F.length("text") / 2).cast("int")
    parts = F.array(F.substr("text", F.lit(1), half), F.substr("text", half + 1))
    out = messages.select(*(c for c in messages.columns if c not in ("text", "msg_idx")), (F.col("msg_idx") * 2).alias("__i"), F.posexplode(parts).alias("__k", "text")).withColumn("msg_idx", F.col("__i") + F.col("__k")).drop("__i", "__k")
    none = F.lit(None).cast("string")
    return out.withColumns({c: none for c in ("sender", "source") if c in out.columns})


def variants(messages: DataFrame) -> DataFrame:
    """messages as they are (variant '') and as each of the six variants, in one pass: variant beside the other columns.
    Numbers of messages are doubled for the halves; like the texts as they are, variants are nobody's and of no source."""
    t, none = F.col("text"), F.lit(None).cast("string")
    half = F.floor(F.length(t) / 2).cast("int")
    one = lambda name, text, k=0: F.struct(F.lit(name).alias("variant"), F.lit(k).alias("k"), text.alias("text"))
    made = [one("", t), *(one(k, f(t)) for k, f in ADVERSARIAL.items()), one("message_splitting", F.substr(t, F.lit(1), half)), one("message_splitting", F.substr(t, half + 1), 1)]
    rows = messages.select("conv_id", "msg_idx", "ts_ms", F.explode(F.array(*made)).alias("x"))
    return rows.select("conv_id", "x.variant", (F.col("msg_idx") * 2 + F.col("x.k")).alias("msg_idx"), "x.text", "ts_ms", none.alias("sender"), none.alias("source"))


def survival(messages: DataFrame, analyze: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """variant, baseline, survived, survival_rate: of the conversations that are not LOW as they are, how many are not LOW
    as each variant. All variants are analysed in one job, as conversations of their own."""
    rows = variants(messages).withColumn("conv_id", F.struct("variant", F.col("conv_id").alias("id"))).drop("variant")
    found = analyze(rows).where("risk <> 'LOW'").select("conv_id.variant", "conv_id.id")
    by = found.groupBy("id").agg(F.collect_set("variant").alias("seen")).where(F.array_contains("seen", ""))
    names = [*ADVERSARIAL, "message_splitting"]
    total = by.agg(F.count("*").alias("baseline"), *(F.count_if(F.array_contains("seen", n)).alias(n) for n in names))
    long = total.select("baseline", F.explode(F.array(*(F.struct(F.lit(n).alias("variant"), F.col(n).alias("survived")) for n in names))).alias("x")).select("x.variant", "baseline", "x.survived")
    return long.withColumn("survival_rate", F.round(F.when(F.col("baseline") > 0, F.col("survived") / F.col("baseline")).otherwise(0.0), 3))
