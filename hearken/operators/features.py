"""The 28-feature vector of a conversation, the linear shadow model, its files, training and folds."""

from __future__ import annotations

import json
import math
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hearken.config import CONFIG, EngineConfig
from hearken.functions.text import LABELS, js_pattern
from hearken.operators.evaluate import confusion
from hearken.plans.engine import analyze
from hearken.sources import packs as P
from hearken.sources.synthetic import DICTIONARIES

SCHEMA_VERSION = 1
_CATEGORIES = "reclutamiento oferta_economica logistica_fisica solicitud_informacion aislamiento cambio_canal slang_operativo contenido_normalizado".split()
#: What saturates: name, column of the analysis (a number, or an array that is counted), and where it is full.
_GRADED = (
    ("score_total", "score", 40), ("score_normalizer", "n0_score", 30), ("score_v3", "v3_score", 40), ("score_v4", "v4_score", 40),
    ("n_categories", "categories", 8), ("n_v3_terms", "v3_terms", 10), ("n_v3_rules", "mcr", 4), ("n_v4_explicit", "signals", 4), ("n_v4_rules", "cr", 4),
    ("n_evasion_transforms", "evasions", 3),
)
_FLAGS = ("velocity", "temporal_chain", "actor_aggressor", "dampeners")
_TEXT = ("imperative_ratio", "second_person", "question_ratio", "money_mention", "meet_mention", "avg_len")
NAMES = [*(g[0] for g in _GRADED), *(f"flag_{f}" for f in _FLAGS), *(f"cat_{c}" for c in _CATEGORIES), *(f"txt_{t}" for t in _TEXT)]


def _words(listed: str) -> str:
    return js_pattern(rf"\b({'|'.join(w.replace('_', ' ') for w in listed.split())})\b")


IMPERATIVE = _words("acude agrégame borra dame dime entrega escríbeme manda mándame pásame recoge trae tráeme ven vente")
SECOND_PERSON = _words("contigo puedes quieres te tienes tuya tuyo t[úu]")
MONEY = _words("billete cash dinero efectivo feria lana mil paga pagar pago pesos quincenal varo")
MEET = _words("central d[oó]nde_vives direcci[oó]n encuentro esquina hotel lugar nos_vemos paso_por_ti rancho ubicaci[oó]n")


def utf16_length(t: Column) -> Column:
    return F.length(t) + F.when(t.rlike(r"[\x{10000}-\x{10FFFF}]"), F.length(F.regexp_replace(t, r"[^\x{10000}-\x{10FFFF}]", ""))).otherwise(0)


def text_predicates(t: Column) -> dict[str, Column]:
    """Five predicates of a raw text and its length in UTF-16 units, each a number per message."""
    one = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    return {"imperative": one(t.rlike(IMPERATIVE)), "second_person": one(t.rlike(SECOND_PERSON)), "question": one(t.contains("?")), "money": one(t.rlike(MONEY)), "meet": one(t.rlike(MEET)), "length": F.coalesce(utf16_length(t), F.lit(0))}


def saturate(x: Column, most: float) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x.cast("double") / most))


def featurize(result: DataFrame) -> DataFrame:
    """result of analyze(..., raw_features=text_predicates) with `features`, the 28 values in the order of NAMES."""
    arrays = {c for c, kind in result.dtypes if kind.startswith("array")}
    marks = F.filter("transformations", lambda x: x.isin(*LABELS.values()))
    graded = [saturate(F.size(marks) if c == "evasions" else F.size(c) if c in arrays else F.col(c), most) for _, c, most in _GRADED]
    one = lambda c: c.cast("double")
    flags = [one(F.col("velocity")), one(F.size("temporal_rules") > 0), one(F.col("aggressor").isNotNull()), one(F.size("dampeners_applied") > 0)]
    cats = [one(F.array_contains("categories", c)) for c in _CATEGORIES]
    n = F.greatest(F.col("n_messages"), F.lit(1))
    any_of = lambda c: one(F.col(f"raw.{c}") > 0)
    text = [F.col("raw.imperative") / n, any_of("second_person"), F.col("raw.question") / n, any_of("money"), any_of("meet"), saturate(F.col("raw.length") / n, 200)]
    return result.withColumn("features", F.array(*graded, *flags, *cats, *text))


@dataclass(frozen=True)
class LinearModel:
    coefficients: tuple[float, ...]
    bias: float
    threshold: float = 0.5
    featureNames: tuple[str, ...] = field(default_factory=lambda: tuple(NAMES))
    schemaVersion: int = SCHEMA_VERSION
    kind: str = "logistic_regression"
    trainedRows: int = 0
    trainingNote: str = ""

    def __post_init__(self):
        """Raises ValueError on another kind, schema, order or number of features, and on numbers that aren't finite."""
        if self.kind != "logistic_regression" or self.schemaVersion != SCHEMA_VERSION:
            raise ValueError("the model has another kind or schema version")
        if list(self.featureNames) != NAMES:
            raise ValueError("the model has another feature order")
        if len(self.coefficients) != len(NAMES) or not all(map(math.isfinite, (*self.coefficients, self.bias))):
            raise ValueError("the model needs a finite coefficient per feature and a finite bias")


def _write_text(spark: SparkSession, text: str, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at, True)
    out.write(bytearray(text.encode("utf-8")))
    out.close()


def save_model(spark: SparkSession, model: LinearModel, path: str) -> None:
    _write_text(spark, json.dumps(asdict(model), ensure_ascii=False, indent=2), path)


def load_model(spark: SparkSession, path: str) -> LinearModel:
    x = json.loads(spark.read.text(path, wholetext=True).first()[0])
    return LinearModel(tuple(map(float, x["coefficients"])), float(x["bias"]), float(x["threshold"]), tuple(x["featureNames"]), x["schemaVersion"], x["kind"], int(x.get("trainedRows", 0)), x.get("trainingNote", ""))


def logistic(features: Column, coefficients: tuple[float, ...], bias: float) -> Column:
    """The logistic function of bias and dot product; null if the row has another number of features or one isn't finite.
    One form for both signs, so that where terms cancel a rounding error below 0 gives a half as one above 0 does."""
    z = F.aggregate(F.zip_with(features, F.array(*map(F.lit, coefficients)), lambda x, w: x * w), F.lit(float(bias)), lambda a, x: a + x)
    fine = (F.size(features) == len(coefficients)) & F.forall(features, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.when(fine, F.when(z > -700, 1 / (1 + F.exp(-z))).otherwise(F.exp(z)))


def shadow_score(df: DataFrame, model: LinearModel) -> DataFrame:
    return df.withColumn("probability", logistic(F.col("features"), model.coefficients, model.bias))


def observe(result: DataFrame, classifier: LinearModel | Callable[[Column], Column]) -> DataFrame:
    """featurize, and what a classifier in the shadow says beside the verdict, which it can't change: shadow_probability
    (null where it fails), lexical_risk, lexical_escalate. A classifier is a model or a function of the features."""
    score = (lambda x: logistic(x, classifier.coefficients, classifier.bias)) if isinstance(classifier, LinearModel) else classifier
    full = featurize(result)
    return full.withColumns({"shadow_probability": score(F.col("features")), "lexical_risk": F.col("risk"), "lexical_escalate": F.col("escalate")})


def comparison(lexical: Column, shadow: Column, actual: Column) -> Column:
    """both_correct, shadow_only, lexical_only or both_wrong of two predictions and the truth (booleans)."""
    a, b = lexical == actual, shadow == actual
    return F.when(a & b, "both_correct").when(a, "lexical_only").when(b, "shadow_only").otherwise("both_wrong")


def case_messages(cases: DataFrame, base_ms: int = 1_750_000_000_000) -> DataFrame:
    """cases(id, messages: array of text, offset_s and, if there, sender and source) as messages of conversation id."""
    has = {f.name for f in cases.schema["messages"].dataType.elementType.fields}
    opt = lambda c: F.col(f"m.{c}") if c in has else F.lit(None).cast("string")
    rows = cases.select("id", F.posexplode("messages").alias("msg_idx", "m"))
    return rows.select(F.col("id").alias("conv_id"), "msg_idx", F.col("m.text").alias("text"), (F.lit(base_ms) + F.col("m.offset_s") * 1000).cast("long").alias("ts_ms"), opt("sender").alias("sender"), opt("source").alias("source"))


def build_dataset(cases: DataFrame, dictionaries: P.Dictionaries = DICTIONARIES, config: EngineConfig = CONFIG) -> DataFrame:
    """id, group, label (1 for RISK) and the 28 values of labelled cases (id, group, label, messages)."""
    got = featurize(analyze(case_messages(cases), dictionaries, config, raw_features=text_predicates))
    return cases.select("id", "group", (F.col("label") == "RISK").cast("int").alias("label")).join(got.select(F.col("conv_id").alias("id"), F.col("features").alias("values")), "id")


def write_dataset(rows: DataFrame, path: str) -> None:
    """JSON lines: a header with schema version and names in a file of its own that sorts first, then a row a case."""
    rows.select("id", "group", "label", "values").write.mode("overwrite").json(path)
    _write_text(rows.sparkSession, json.dumps({"schemaVersion": SCHEMA_VERSION, "names": NAMES}) + "\n", f"{path}/header.json")


def read_dataset(spark: SparkSession, path: str) -> DataFrame:
    """id, group, label, values of such a file or folder. No rows, or a row of another width than the header's, is an error."""
    lines = spark.read.text(path).where("trim(value) <> ''")
    kind = "schemaVersion int, names array<string>, id string, `group` string, label int, values array<double>"
    x = lines.select(F.from_json("value", kind).alias("x")).select("x.*")
    head = x.where("names is not null").select(F.size("names").alias("width")).first()
    rows = x.where("names is null").select("id", "group", "label", "values")
    if head is None or rows.isEmpty():
        raise ValueError(f"{path} has no header or no rows")
    wrong = F.concat(F.lit("row "), F.coalesce("id", F.lit("?")), F.lit(" has another width than the header"))
    return rows.withColumn("values", F.when(F.size("values") == head["width"], F.col("values")).otherwise(F.raise_error(wrong)))


def train(rows: DataFrame, features: str = "values", label: str = "label", c: float = 1.0) -> tuple[list[float], float]:
    """(coefficients, intercept) of a class-balanced logistic regression by pyspark.ml; c is the inverse penalty."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    n, ones = rows.agg(F.count("*"), F.sum(F.col(label).cast("double"))).first()
    share = min(max((ones or 0.0) / max(n, 1), 1e-9), 1 - 1e-9)
    w = F.when(F.col(label) == 1, 0.5 / share).otherwise(0.5 / (1 - share))
    data = rows.select(array_to_vector(features).alias("features"), F.col(label).cast("double").alias("label"), w.alias("w"))
    model = LogisticRegression(weightCol="w", regParam=1 / (c * max(n, 1)), standardization=False, maxIter=200).fit(data)
    return list(map(float, model.coefficients)), float(model.intercept)


def fold_of(*by: Column, folds: int = 5, seed: int = 42) -> Column:
    """A fold by hash: of the group, so that a group's rows share one, or of the row's id."""
    return F.pmod(F.xxhash64(F.lit(seed), *by), F.lit(folds)).cast("int")


def out_of_fold(rows: DataFrame, grouped: bool, folds: int = 5) -> DataFrame:
    """rows (id, group, label, values) with fold and probability, each by a model that saw no row of its fold."""
    rows = rows.withColumn("fold", fold_of(F.col("group") if grouped else F.col("id"), folds=folds))
    out = None
    for k in range(folds):
        seen = rows.where(F.col("fold") != k)
        w, b = train(seen)
        part = rows.where(F.col("fold") == k).withColumn("probability", logistic(F.col("values"), tuple(w), b))
        out = part if out is None else out.unionByName(part)
    return out


def roc_auc(df: DataFrame, score: str, actual: str) -> DataFrame:
    """One row, roc_auc: the share of pairs in order, ties half. By counts of equal scores, so one sort of distinct scores; null if a class is absent."""
    from pyspark.sql import Window

    a = F.col(actual).cast("int")
    at = df.groupBy(score).agg(F.sum(a).alias("p"), F.sum(1 - a).alias("n"))
    below = F.coalesce(F.sum("n").over(Window.orderBy(score).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    won = at.select("p", "n", (F.col("p") * (below + F.col("n") / 2)).alias("w"))
    return won.agg(F.try_divide(F.sum("w"), F.sum("p") * F.sum("n")).alias("roc_auc"))


def metric_block(df: DataFrame, score: str = "probability", actual: str = "label", threshold: float = 0.5) -> DataFrame:
    """confusion at a threshold, and roc_auc, in one row."""
    x = df.select(F.col(score).alias("s"), (F.col(actual) == 1).alias("a")).withColumn("p", F.col("s") >= threshold)
    return confusion(x, "p", "a").crossJoin(roc_auc(x, "s", "a"))  # one row by one row
