"""The knowledge base: what probes tell and how questions find them."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .rules import ACTIONS, RULES

#: Fixed values beside the code: keywords, functions, event types and combine_with in ../knowledge/*.json, which scores depend on.
LAYERS = ("tcp", "memory", "fs", "process", "sched")
KB = "version string, layer string, description string, probes array<struct<function:string,attachment:string,event_type:string,layer:string,answers:array<string>,keywords:array<string>,combine_with:array<string>,fields:array<struct<name:string,meaning:string,important:boolean>>,use_when:string>>"


def load(spark: SparkSession, path: str | None = None) -> DataFrame:
    """A row for each probe, in order of layers and of probes in their layer. Malformed files fail.

    Without a path, the library's own files are used: read here and made a table, as executors can't see the driver's disk.
    """
    if path is None:
        text = [((Path(__file__).parent.parent / "knowledge" / f"{x}.json").read_text(),) for x in LAYERS]  # five fixed files
        layers = spark.createDataFrame(text, "value string").select(F.from_json("value", T._parse_datatype_string(KB), {"mode": "FAILFAST"}).alias("x")).select("x.*")
    else:
        layers = spark.read.schema(KB).option("multiLine", True).option("mode", "FAILFAST").json(path)
    order = F.array_position(F.array(*map(F.lit, LAYERS)), F.col("layer")) * 1000
    return layers.select(F.posexplode("probes").alias("i", "p"), order.alias("layer_at")).select("p.*", (F.col("layer_at") + F.col("i")).cast("int").alias("position"))


def interpretations(spark: SparkSession) -> DataFrame:
    """(rule_id, event_type, severity, conclusion, position): a fixed table."""
    return spark.createDataFrame([(r.id, r.event_type, r.severity, r.conclusion, i) for i, r in enumerate(RULES)], "rule_id string, event_type string, severity string, conclusion string, position int")


def scores(questions: DataFrame, kb: DataFrame) -> DataFrame:
    """(question_id, question) against each probe: 10 for an answer that holds the question or is held by it, 5 for a
    keyword and 20 for the function's name in it; only scores over 0. The base is a fixed, small table and is broadcast."""
    q = F.lower("question")
    answers = F.size(F.filter("answers", lambda a: F.contains(q, F.lower(a)) | F.contains(F.lower(a), q)))
    keywords = F.size(F.filter("keywords", lambda k: F.contains(q, F.lower(k))))
    score = answers * 10 + keywords * 5 + F.when(F.contains(q, F.col("function")), 20).otherwise(0)
    return questions.join(F.broadcast(kb), how="cross").withColumn("score", score).where("score > 0")


def find(questions: DataFrame, kb: DataFrame, k: int = 5) -> DataFrame:
    """The best k probes for each question, ties in order of the base."""
    best = Window.partitionBy("question_id").orderBy(F.desc("score"), "position")
    return scores(questions, kb).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def with_reasons(found: DataFrame) -> DataFrame:
    """Q1: what find gives, with why a probe helps, its important fields and what they mean, and the probes it goes together with."""
    important = F.transform(F.filter("fields", lambda x: x["important"]), lambda x: F.concat_ws(": ", x["name"], x["meaning"]))
    return found.select("question_id", "rank", "score", "function", "attachment", "event_type", F.col("use_when").alias("why"), important.alias("important_fields"), "combine_with")


def matching(event_type: Column, ret: Column, state: Column) -> Column:
    """The places of all single-event rules that an event meets, in their order; no join, one pass."""
    hits = [F.when((event_type == r.event_type) & F.expr(r.predicate), i) for i, r in enumerate(RULES) if r.shape == "filter"]
    return F.array_compact(F.array(*hits))


def explain(events: DataFrame) -> DataFrame:
    """Events with the first rule that they meet: rule_id, rule_severity, conclusion; null if none."""
    at = F.get(matching(F.col("event_type"), F.col("ret"), F.col("tcp_state")), 0)
    pick = lambda name: F.get(F.array(*[F.lit(getattr(r, name)) for r in RULES]), at)
    return events.withColumns({"rule_id": pick("id"), "rule_severity": pick("severity"), "conclusion": pick("conclusion")})


def explain_all(events: DataFrame) -> DataFrame:
    """A row for each rule that an event meets, ``place`` 1 for the first."""
    rows = events.select("*", F.posexplode(matching(F.col("event_type"), F.col("ret"), F.col("tcp_state"))).alias("place", "at"))
    pick = lambda name: F.get(F.array(*[F.lit(getattr(r, name)) for r in RULES]), F.col("at"))
    return rows.withColumns({"place": F.col("place") + 1, "rule_id": pick("id"), "rule_severity": pick("severity"), "conclusion": pick("conclusion")}).drop("at")


def action(rule_id: Column) -> Column:
    """What to do about what a rule says."""
    return F.coalesce(*[F.when(rule_id == k, v) for k, v in ACTIONS.items()])


def explain_value(kb: DataFrame, asked: DataFrame) -> DataFrame:
    """Q2: asked (function, ret, tcp_state) with the first rule that the function's event would meet; without one the probe's
    own description, and of a function that the base doesn't have an error."""
    rows = asked.join(kb.select("function", "event_type", "attachment", "answers"), "function", "left")
    out = explain(rows)
    info = F.concat(F.col("attachment"), F.lit(" of "), F.col("event_type"), F.lit(": "), F.array_join("answers", "; "))
    return out.select("function", "ret", "tcp_state", "rule_id", "rule_severity", action(F.col("rule_id")).alias("action"),
                      F.when(F.col("event_type").isNull(), "unknown function").when(F.col("rule_id").isNull(), info).otherwise(F.col("conclusion")).alias("answer"))


NO_PROBE, NO_EVENT, NO_RULE = "no probe answers this", "no event tells", "no event has an interpretation"


def ask(questions: DataFrame, kb: DataFrame, events: DataFrame, since_ns: int | None = None, max_events: int = 100, k: int = 3) -> DataFrame:
    """Q5: a row for each question: what the newest event tells that has an interpretation, of the newest ``max_events`` events of
    the best k probes since a time; with its severity, what to do, the events looked at and the probes used.

    kb_only says that no event was there, so that all that is known is which probes would tell. Without a match, an event or an
    interpretation the answer says so; nothing fails. Events are reduced to the newest max_events of each type before they
    meet the questions.
    """
    rows = events if since_ns is None else events.where(F.col("observed_at_ns") >= since_ns)
    newest = [F.desc("observed_at_ns"), F.desc("event_id")]
    by_type = explain(rows).withColumn("rn", F.row_number().over(Window.partitionBy("event_type").orderBy(*newest))).where(F.col("rn") <= max_events)
    few = by_type.select("event_type", "observed_at_ns", "event_id", "rule_id", "rule_severity", "conclusion")
    found = find(questions, kb, k).select("question_id", "function", "event_type", F.col("rank").alias("probe_rank"))
    probes = found.groupBy("question_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("probe_rank", "function"))), lambda x: x["function"]), ",").alias("probes_used"))
    ranked = found.join(few, "event_type").withColumn("rn", F.row_number().over(Window.partitionBy("question_id").orderBy(*newest))).where(F.col("rn") <= max_events)
    told = F.struct("rn", "event_id", "rule_id", "rule_severity", "conclusion")
    seen = ranked.groupBy("question_id").agg(F.min(F.when(F.col("rule_id").isNotNull(), told)).alias("b"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", "event_id"))), lambda x: x["event_id"]), ",").alias("events"))
    out = questions.join(probes, "question_id", "left").join(seen, "question_id", "left")
    answer = F.when(F.col("probes_used").isNull(), NO_PROBE).when(F.col("events").isNull(), NO_EVENT).when(F.col("b.rule_id").isNull(), NO_RULE).otherwise(F.col("b.conclusion"))
    return out.select("question_id", answer.alias("answer"), F.col("b.rule_severity").alias("severity"), action(F.col("b.rule_id")).alias("action"), F.col("b.event_id").alias("event_id"),
                      F.coalesce("events", F.lit("")).alias("events"), F.coalesce("probes_used", F.lit("")).alias("probes_used"), F.col("events").isNull().alias("kb_only"))


def listed(kb: DataFrame, layer: str | None = None) -> DataFrame:
    """Q6: the base's probes, of one layer or all, in their order."""
    rows = kb if layer is None else kb.where(F.col("layer") == layer)
    return rows.select("position", "layer", "function", "attachment", "event_type", F.array_join("answers", "; ").alias("answers"))


def repeated(kb: DataFrame) -> DataFrame:
    """Functions and event types that the base has more than once."""
    names = kb.select(F.explode(F.array(F.struct(F.lit("function").alias("what"), F.col("function").alias("name")), F.struct(F.lit("event type").alias("what"), F.col("event_type").alias("name")))).alias("x"))
    return names.groupBy("x.what", "x.name").agg(F.count("*").alias("n")).where("n > 1")


def dangling(kb: DataFrame) -> DataFrame:
    """Functions that combine_with names but the base doesn't have."""
    named = kb.select("function", F.explode("combine_with").alias("other"))
    return named.join(kb.select(F.col("function").alias("other")), "other", "left_anti")


def violations(kb: DataFrame) -> DataFrame:
    """(layer, function, problem) of a base of any size, a row for each rule that a probe breaks.

    Answers, keywords, fields and use_when are required, keywords are in lower case, probes attach in a known way, severities of interpretations
    (if the base has them) are known, combine_with names probes of the base, and functions and event types are there once.
    """
    blank = lambda c: F.when(F.coalesce(F.trim(c), F.lit("")) == "", f"no {c}")
    none = lambda c: F.when(F.coalesce(F.size(c), F.lit(0)) <= 0, f"no {c}")
    rules = [blank(c) for c in ("function", "event_type", "use_when")] + [none(c) for c in ("answers", "keywords", "fields")]
    rules.append(F.when(F.exists("keywords", lambda k: k != F.lower(k)), "a keyword is not in lower case"))
    rules.append(F.when(~F.coalesce(F.col("attachment").isin("fentry", "fexit"), F.lit(False)), "attaches in no known way"))
    if "severities" in kb.columns:
        rules.append(F.when(F.exists("severities", lambda x: ~x.isin("info", "warning", "error", "critical")), "a severity is unknown"))
    own = kb.select("layer", "function", F.explode(F.array_compact(F.array(*rules))).alias("problem"))
    others = dangling(kb).join(kb.select("function", "layer"), "function").select("layer", "function", F.concat(F.lit("goes together with nothing: "), "other").alias("problem"))
    twice = repeated(kb)
    names = lambda what, c: kb.join(twice.where(F.col("what") == what).select(F.col("name").alias(c)), c, "left_semi").select("layer", "function", F.lit(f"its {what} is there more than once").alias("problem"))
    return own.unionByName(others).unionByName(names("function", "function")).unionByName(names("event type", "event_type"))


def statistics(kb: DataFrame) -> DataFrame:
    """Probes by layer, distinct functions, and how many break a rule of the base."""
    broken = violations(kb).groupBy("layer").agg(F.countDistinct("function").alias("n_broken"), F.count("*").alias("n_violations"))
    return kb.groupBy("layer").agg(F.count("*").alias("n_probes"), F.countDistinct("function").alias("n_functions")).join(broken, "layer", "left").fillna(0, ["n_broken", "n_violations"])
