"""Sessions: a stream of messages re-scored by session, with bounds on size and age; export, import and outputs."""

from __future__ import annotations

import json
import warnings
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from hearken.config import CONFIG, RISKS, EngineConfig
from hearken.plans.engine import analyze
from hearken.sources import loaders
from hearken.sources import packs as P
from hearken.sources.synthetic import DICTIONARIES

HEAD, TAIL, RETENTION_DAYS = 50, 950, 30
DAY = 86_400_000
_MESSAGE = "conv_id msg_idx text ts_ms sender source".split()


def trim(messages: DataFrame, key: str = "conv_id", head: int = HEAD, tail: int = TAIL, order: tuple[str, ...] = ("ts_ms", "msg_idx")) -> DataFrame:
    """The first head and last tail messages of a session; the order is (ts_ms, arrival)."""
    w = Window.partitionBy(key)
    at = messages.withColumn("__n", F.count("*").over(w)).withColumn("__k", F.row_number().over(w.orderBy(*order)))
    return at.where((F.col("__n") <= head + tail) | (F.col("__k") <= head) | (F.col("__k") > F.col("__n") - tail)).drop("__n", "__k")


def retained(messages: DataFrame, now_ms: Column | int, days: int = RETENTION_DAYS, ts: str = "ts_ms") -> DataFrame:
    """Messages not older than `days` at now_ms."""
    return messages.where(F.col(ts) >= (now_ms if isinstance(now_ms, Column) else F.lit(now_ms)) - days * DAY)


def export_sessions(messages: DataFrame, path: str) -> None:
    """stored messages (session_id, id, user_id, content, timestamp, source) as lines [session, [message, ...]]."""
    m = F.struct("timestamp", "id", "user_id", "session_id", "content", "source")
    rows = messages.groupBy("session_id").agg(F.array_sort(F.collect_list(m)).alias("m"))
    name = F.regexp_extract(F.to_json(F.array("session_id")), r"(?s)^\[(.*)\]$", 1)
    rows.select(F.concat(F.lit("["), name, F.lit(","), F.to_json("m"), F.lit("]")).alias("value")).write.mode("overwrite").text(path)


def import_sessions(lines: DataFrame, now_ms: int, days: int = RETENTION_DAYS) -> DataFrame:
    """session, id, user_id, session_id, content, timestamp, source of the messages in a text column `value`.

    A line is [session, [message, ...]] or an array of such entries. A message stays if its ids and content are strings,
    its timestamp is a number within `days`, and its source is absent or known; what can't be parsed gives nothing.
    """
    value = F.trim("value")
    many = F.when(value.rlike(r"^\[\s*\["), value).otherwise(F.concat(F.lit("["), value, F.lit("]")))
    entry = lines.select(F.explode(F.from_json(many, "array<array<string>>")).alias("e")).where("size(e) = 2")
    raw = entry.select(F.col("e")[0].alias("session"), F.explode(F.from_json(F.col("e")[1], "array<string>")).alias("m"))
    v = raw.select("session", F.try_parse_json("m").alias("v")).where("v is not null and session is not null")
    kind = lambda c: F.expr(f"schema_of_variant(try_variant_get(v, '$.{c}', 'variant'))")
    get = lambda c, t: F.try_variant_get("v", f"$.{c}", t)
    strings = F.lit(True)
    for c in ("id", "user_id", "session_id", "content"):
        strings = strings & F.coalesce(kind(c) == "STRING", F.lit(False))
    number = F.coalesce(kind("timestamp").rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), F.lit(False))
    known = F.coalesce(get("source", "string").isin("text", "voice_transcript"), F.expr("try_variant_get(v, '$.source', 'variant') is null"))
    rows = v.where(strings & number & known)
    out = rows.select("session", *(get(c, "string").alias(c) for c in ("id", "user_id", "session_id", "content")), get("timestamp", "double").cast("long").alias("timestamp"), get("source", "string").alias("source"))
    return retained(out, now_ms, days, "timestamp")


def rank(risk: str | Column = "risk") -> Column:
    return F.array_position(F.array(*map(F.lit, RISKS)), F.col(risk) if isinstance(risk, str) else risk) - 1


def escalations(verdicts: DataFrame, cache: DataFrame | None = None) -> DataFrame:
    """Verdicts to send on; with a cache (conv_id, cached_risk as 0 to 3) only those above what was answered before."""
    todo = verdicts.where("escalate")
    if cache is None:
        return todo
    return todo.join(cache.select("conv_id", "cached_risk"), "conv_id", "left").where(F.col("cached_risk").isNull() | (F.col("cached_risk") < rank())).drop("cached_risk")


def network_reports(verdicts: DataFrame, messages: DataFrame) -> DataFrame:
    """conv_id, sender, risk, categories and the aggressor's texts of each conversation judged on the spot that has one."""
    # made by a generator, the key of the join is no expression that the optimizer would trace and write out down to the messages
    who = verdicts.where("aggressor is not null and not escalate and risk <> 'LOW'").select("conv_id", F.explode(F.array("aggressor")).alias("sender"), "risk", "categories")
    texts = F.transform(F.array_sort(F.collect_list(F.struct("msg_idx", "text"))), lambda x: x["text"])
    return messages.join(who, ["conv_id", "sender"]).groupBy("conv_id", "sender").agg(F.first("risk").alias("risk"), F.first("categories").alias("categories"), texts.alias("texts"))


def record_feedback(feedback: DataFrame, path: str) -> None:
    """Appends rows (session_id, verdict, feedback, comment); a feedback of another kind is an error and nothing is written."""
    kinds = ("false_positive", "false_negative", "confirmed")
    wrong = F.concat(F.lit("unknown feedback "), F.coalesce("feedback", F.lit("null")))
    checked = feedback.select("session_id", "verdict", F.when(F.col("feedback").isin(*kinds), F.col("feedback")).otherwise(F.raise_error(wrong)).alias("feedback"), "comment", F.lit("engine").alias("reported_by"))
    checked.write.mode("append").json(path)


@dataclass(frozen=True)
class Store:
    """Versioned state by session bucket in a folder of any Hadoop file system. A batch reads and rewrites the buckets that
    it touches; a manifest per batch names each bucket's version, so a batch that is tried again starts from the one before."""

    spark: SparkSession
    folder: str
    buckets: int = 64

    def _fs(self, path: str):
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), at

    def _names(self, path: str) -> list[str]:
        fs, at = self._fs(path)
        return [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []

    def manifest(self, before: int) -> dict[int, int]:
        """Bucket to the batch that wrote its latest version, as of the last batch before this one."""
        done = [n for x in self._names(f"{self.folder}/manifest") if x.removesuffix(".json").isdigit() and (n := int(x.removesuffix(".json"))) < before]
        if not done:
            return {}
        text = self.spark.read.text(f"{self.folder}/manifest/{max(done)}.json", wholetext=True).first()[0]
        return {int(k): v for k, v in json.loads(text).items()}

    def commit(self, number: int, manifest: dict[int, int]) -> None:
        fs, at = self._fs(f"{self.folder}/manifest/{number}.json")
        out = fs.create(at, True)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        live = {*manifest.values(), *self.manifest(number).values(), number}
        for name in ("state", "answers"):
            for x in self._names(f"{self.folder}/{name}"):
                if int(x.removeprefix("batch=")) not in live:
                    fs, at = self._fs(f"{self.folder}/{name}/{x}")
                    fs.delete(at, True)

    def read(self, name: str, manifest: dict[int, int], touched: list[int], schema) -> DataFrame:
        paths = [p for b in touched if b in manifest and self._fs(p := f"{self.folder}/{name}/batch={manifest[b]}/bucket={b}")[0].exists(self._fs(p)[1])]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def write(self, df: DataFrame, name: str, number: int) -> DataFrame:
        """df, bucketed by conversation, as the version of this batch; read back from there."""
        path = f"{self.folder}/{name}/batch={number}"
        bucketed = df.withColumn("bucket", self.bucket())
        bucketed.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(F.col("conv_id").cast("string")), F.lit(self.buckets)).cast("int")


def run(
    stream: DataFrame,
    folder: str,
    checkpoint: str,
    dictionaries: P.Dictionaries = DICTIONARIES,
    config: EngineConfig = CONFIG,
    hot_terms: str | None = None,
    sync: Callable[[DataFrame, int], None] | None = None,
    respond: Callable[[DataFrame], DataFrame] | None = None,
    days: int = RETENTION_DAYS,
    buckets: int = 64,
) -> StreamingQuery:
    """Scores anew the sessions that each micro-batch of messages touches.

    In `folder`, by batch: rejected (rows without conversation, sender or text), state (trimmed and retained sessions),
    verdicts, escalations (those above what was answered), answers (what `respond` said: conv_id, response), reports.
    hot_terms is read anew for each batch; sync gets each batch, and its failure is a warning. A batch that is tried
    again replaces what it wrote. Retention counts from the batch's latest message.
    """

    def score(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        store = Store(spark, folder, buckets)
        now = dictionaries
        if hot_terms:
            terms, version = loaders.load_hot_terms(spark, hot_terms)
            now = replace(dictionaries, packs=P.add_hot_terms(dictionaries.packs, [t for t in terms if (t[0] or "MX") in {p.id for p in dictionaries.packs}]), hot_version=version)
        fine = (F.coalesce("text", F.lit("")) != "") & (F.coalesce("sender", F.lit("")) != "") & F.col("conv_id").isNotNull()
        batch.where(~fine).write.mode("overwrite").parquet(f"{folder}/rejected/batch={number}")
        new = batch.where(fine).select(*_MESSAGE)
        if sync:
            try:
                sync(new, number)
            except Exception as e:
                warnings.warn(f"batch {number} wasn't synchronized: {e}", stacklevel=2)
        seen = new.agg(F.max("ts_ms"), F.collect_set(store.bucket())).first()  # at most `buckets` numbers
        before, touched = store.manifest(number), sorted(seen[1])
        both = store.read("state", before, touched, new.schema).unionByName(new)
        state = store.write(trim(retained(both, seen[0] or 0, days)), "state", number)
        active = state.join(new.select("conv_id").distinct(), "conv_id", "left_semi")
        analyze(active, now, config).write.mode("overwrite").parquet(f"{folder}/verdicts/batch={number}")
        verdicts = spark.read.parquet(f"{folder}/verdicts/batch={number}")
        cache = store.read("answers", before, touched, f"conv_id {new.schema['conv_id'].dataType.simpleString()}, cached_risk int, response string")
        escalations(verdicts, cache).write.mode("overwrite").parquet(f"{folder}/escalations/batch={number}")
        asked = spark.read.parquet(f"{folder}/escalations/batch={number}")
        said = respond(asked).select("conv_id", "response") if respond else asked.select("conv_id", F.lit(None).cast("string").alias("response"))
        fresh = asked.select("conv_id", rank().cast("int").alias("cached_risk")).join(said, "conv_id", "left")
        store.write(cache.join(fresh, "conv_id", "left_anti").unionByName(fresh), "answers", number)
        network_reports(verdicts, active).write.mode("overwrite").parquet(f"{folder}/reports/batch={number}")
        store.commit(number, {**before, **dict.fromkeys(touched, number)})

    return stream.writeStream.foreachBatch(score).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
