"""Report, prompt and notification text over tables, and parsing of model answers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.functions.dates import iso
from fleetlens.plans.ordered import last_n, running


def _lines(df: DataFrame, keys, order: Sequence[str], text: Column, n: int, show: int, name: str) -> DataFrame:
    """The newest n rows of each key counted, the newest `show` of them as one text."""
    top = last_n(df, keys, [F.desc(c) for c in order], n)
    # At most n rows a key reach the list.
    rows = F.sort_array(F.collect_list(F.struct(*order, text.alias("_line"))), asc=False)
    out = top.groupBy(*keys).agg(rows.alias("_r"), F.count("*").alias(f"{name}_total"))
    shown = F.array_join(F.transform(F.slice("_r", 1, show), lambda r: r["_line"]), "\n")
    return out.select(*keys, f"{name}_total", shown.alias(f"{name}_text"))


def context_pack(inc: DataFrame, act: DataFrame, n: int = 10, show: int = 5, as_of: str | None = None, incident_id: int | None = None) -> DataFrame:
    """Per service the newest incidents and actions as text, and the requested incident in full."""
    i_text = F.concat(F.lit("ID"), F.col("id").cast("string"), F.lit(": "), F.concat_ws(" ", "type", "severity", "status"), F.lit(" at "), iso("timestamp"))
    a_text = F.concat(F.concat_ws(" ", "action_type", "target"), F.when(F.col("success"), F.lit(" ✓")).otherwise(F.lit(" ✗")), F.lit(" at "), iso("timestamp"))
    i = _lines(inc.withColumnRenamed("affected_service", "service"), ["service"], ["timestamp", "id"], i_text, n, show, "incidents")
    a_order = ["timestamp", "id", "incident_id", "action_type", "success"]
    a = _lines(act.withColumn("service", F.col("target")), ["service"], a_order, a_text, n, show, "remediations")
    both = i.join(a, "service", "full_outer").withColumns(
        {f"{x}_{y}": F.coalesce(f"{x}_{y}", F.lit(z)) for x in ("incidents", "remediations") for y, z in (("total", 0), ("text", ""))}
    )
    head = F.format_string(
        "RECENT INCIDENTS (%d most recent, total %d):\n%s\n\nRECENT REMEDIATIONS (%d most recent, total %d):\n%s\n",
        F.lit(show), F.col("incidents_total"), F.col("incidents_text"), F.lit(show), F.col("remediations_total"), F.col("remediations_text"),
    )
    if as_of is not None:
        head = F.concat(F.lit(f"CURRENT TIME: {as_of}Z\n\n"), head)
    out = both.withColumn("context", head)
    if incident_id is None:
        return out
    one = inc.filter(F.col("id") == incident_id)
    resolved = iso("resolved_at") if "resolved_at" in inc.columns else F.lit(None).cast("string")
    detail = F.concat(
        F.format_string("\nSPECIFIC INCIDENT DETAILS (ID %d):\n", F.col("id")),
        F.format_string("- Type: %s\n- Severity: %s\n- Status: %s\n", "type", "severity", "status"),
        F.concat(F.lit("- Detected: "), iso("timestamp"), F.lit("\n- Resolved: "), F.coalesce(resolved, F.lit("Not yet resolved")), F.lit("\n")),
    )
    asked = one.select(F.col("affected_service").alias("service"), detail.alias("_d"))
    return out.join(asked, "service", "left").withColumn("context", F.concat("context", F.coalesce("_d", F.lit("")))).drop("_d")


def incident_prompts(inc: DataFrame, details: Sequence[str] | None = None) -> DataFrame:
    """A prompt per incident with its type, severity and details as JSON."""
    body = F.to_json(F.struct(*details)) if details else F.coalesce(F.col("details"), F.lit("{}"))
    text = F.concat(
        F.lit("Analyze this incident and answer in JSON.\n\nINCIDENT TYPE: "), F.coalesce("type", F.lit("unknown")),
        F.lit("\nSEVERITY: "), F.coalesce("severity", F.lit("UNKNOWN")), F.lit("\nDETAILS: "), body,
    )
    return inc.withColumn("prompt", text)


# What a response that cannot be read turns into.
NO_JSON = ("Unable to parse structured response", "Review raw LLM output")
BAD_JSON = ("Response parsing failed", "Check LLM output format")


def parse_responses(df: DataFrame, col: str = "response") -> DataFrame:
    """The JSON object between the first `{` and the last `}` of each response, or a fallback."""
    text = F.col(col)
    start = F.locate("{", text)
    last = F.length(text) - F.locate("}", F.reverse(text)) + 1
    has = (start > 0) & (F.locate("}", text) > 0) & (last > start)
    body = F.when(has, text.substr(start, last - start + 1))
    good = has & F.try_parse_json(body).isNotNull()

    def field(name, no_json, bad_json):
        return F.when(good, F.get_json_object(body, f"$.{name}")).when(has, bad_json).otherwise(no_json)

    first = F.substring(text, 1, 500)
    tips = F.when(good, F.from_json(F.get_json_object(body, "$.suggestions"), "array<string>"))
    return df.withColumns(
        {
            "json": F.when(good, body),
            "root_cause": field("root_cause", F.lit(NO_JSON[0]), F.lit(BAD_JSON[0])),
            "explanation": field("explanation", first, first),
            "confidence": field("confidence", F.lit("low"), F.lit("low")),
            "suggestions": F.when(good, tips).when(has, F.array(F.lit(BAD_JSON[1]))).otherwise(F.array(F.lit(NO_JSON[1]))),
        }
    )


def top_suggestions(df: DataFrame, k: int = 5, json: str = "json") -> DataFrame:
    """Immediate, preventive and monitoring suggestions in that order, the first k."""
    def part(name):
        got = F.from_json(F.get_json_object(F.col(json), f"$.{name}"), "array<string>")
        return F.coalesce(got, F.array().cast("array<string>"))

    every = F.concat(part("immediate_actions"), part("preventive_measures"), part("monitoring_adjustments"))
    return df.withColumn("top_suggestions", F.slice(every, 1, k))


def report_lines(act: DataFrame, **how) -> DataFrame:
    """Numbered action lines of each incident, one row per line: an incident may have very many."""
    ties = ["timestamp", "action_type", "target", "success", "id", "execution_time_ms"]
    numbered = running(act, ["incident_id"], [c for c in ties if c in act.columns], sums={"line_no": F.lit(1)}, **how)
    done = F.when(F.col("success"), "Success").otherwise("Failed")
    line = F.concat(F.col("line_no").cast("string"), F.lit(". "), F.coalesce("action_type", F.lit("Unknown")), F.lit(" - "), done)
    return numbered.select("incident_id", "line_no", line.alias("line"))


def fallback_reports(inc: DataFrame, act: DataFrame, **how) -> DataFrame:
    """Reports without a model: the head of each incident as line 0, then its action lines, as rows."""
    what = F.coalesce(F.col("details"), F.lit("{}")) if "details" in inc.columns else F.lit("{}")
    head = F.concat(
        F.lit("Incident Report\n\nType: "), F.coalesce("type", F.lit("Unknown")), F.lit("\nSeverity: "), F.coalesce("severity", F.lit("Unknown")),
        F.lit("\nTime: "), F.coalesce(iso("timestamp"), F.lit("Unknown")), F.lit("\n\nDescription:\n"), what, F.lit("\n\nRemediation Actions Taken:"),
    )
    heads = inc.select(F.col("id").alias("incident_id"), F.lit(0).cast("long").alias("line_no"), head.alias("line"))
    lines = report_lines(act, **how).join(inc.select(F.col("id").alias("incident_id")), "incident_id", "left_semi")
    return heads.unionByName(lines.select("incident_id", F.col("line_no").cast("long").alias("line_no"), "line"))


# Marks before a message and the format of each message kind.
MARKS = {"CRITICAL": ":red_circle:", "WARNING": ":warning:", "INFO": ":information_source:", "SUCCESS": ":white_check_mark:"}
MESSAGES = {
    "detected": "Incident detected on `%s`: **%s** (%s)",
    "started": "Starting remediation: `%s` on `%s` - Reason: %s",
    "succeeded": "✅ Remediation successful: `%s` on `%s` (completed in %sms)",
    "failed": "❌ Remediation failed: `%s` on `%s` - Error: %s",
    "breaker_opened": "🚫 Circuit breaker OPENED for `%s` - %s",
    "escalation": "🚨 ESCALATION REQUIRED for `%s` - Auto-remediation exhausted. Manual intervention needed. Reason: %s",
}


def notification_text(df: DataFrame) -> DataFrame:
    """Message, severity and marked text of each event row.

    Columns used by kind: detected (service, type, severity), started (action_type, target, reason),
    succeeded (action_type, target, execution_time_ms), failed (action_type, target, error),
    breaker_opened and escalation (service, reason)."""
    def have(name, default="unknown"):
        return F.coalesce(F.col(name).cast("string"), F.lit(default)) if name in df.columns else F.lit(default)

    severity_in, act = have("severity", "INFO"), (have("action_type"), have("target"))
    service, reason = have("service"), have("reason")
    # Per kind: what fills its format, and its severity.
    kinds = {
        "detected": ((service, have("type"), severity_in), severity_in),
        "started": ((*act, reason), F.lit("INFO")),
        "succeeded": ((*act, have("execution_time_ms")), F.lit("SUCCESS")),
        "failed": ((*act, have("error")), F.lit("CRITICAL")),
        "breaker_opened": ((service, reason), F.lit("WARNING")),
        "escalation": ((service, reason), F.lit("CRITICAL")),
    }
    kind = F.col("kind")
    message = F.coalesce(*[F.when(kind == k, F.format_string(MESSAGES[k], *fills)) for k, (fills, _) in kinds.items()])
    severity = F.coalesce(*[F.when(kind == k, level) for k, (_, level) in kinds.items()])
    out = df.withColumns({"message": message, "message_severity": severity})
    mark = F.coalesce(F.create_map(*[F.lit(x) for kv in MARKS.items() for x in kv])[F.col("message_severity")], F.lit(":bell:"))
    return out.withColumn("text", F.concat(mark, F.lit(" *"), F.col("message_severity"), F.lit("* - "), F.col("message")))
