"""Agent hook payloads (JSON) to messages. A prompt is the user's, a stop carries the assistant's last text, tool use is formatted by tool."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

COMMAND, OUTPUT, LINES = 300, 500, 50


def _get(path: str, default: str = "") -> Column:
    return F.coalesce(F.get_json_object("raw", path), F.lit(default))


def _edit() -> Column:
    patches = F.from_json(F.get_json_object("raw", "$.tool_response.structuredPatch"), "array<struct<lines:array<string>>>")
    lines = F.flatten(F.transform(F.coalesce(patches, F.array().cast("array<struct<lines:array<string>>>")), lambda p: F.coalesce(p["lines"], F.array().cast("array<string>"))))
    return F.concat(F.lit("Edit: "), _get("$.tool_input.file_path", "unknown"), F.lit("\n"), F.array_join(F.slice(lines, 1, LINES), "\n"))


def content() -> Column:
    event, tool = _get("$.hook_event_name"), _get("$.tool_name")
    command, said = F.left(_get("$.tool_input.command"), F.lit(COMMAND)), F.left(_get("$.tool_response.stdout"), F.lit(OUTPUT))
    note, file = _get("$.tool_input.description"), _get("$.tool_input.file_path", "unknown")
    bash = F.when(note != "", F.concat(F.lit("Bash: "), note, F.lit("\n$ "), command, F.lit("\n"), said)).otherwise(F.concat(F.lit("Bash: "), command, F.lit("\n"), said))
    shown = F.left(F.coalesce(F.get_json_object("raw", "$.tool_response.content"), F.get_json_object("raw", "$.tool_response.file.content"), F.lit("")), F.lit(OUTPUT))
    used = (
        F.when(tool == "Edit", _edit())
        .when(tool == "Bash", bash)
        .when(tool == "Read", F.concat(F.lit("Read: "), file, F.lit("\n"), shown))
        .when(tool == "Write", F.concat(F.lit("Write: "), file, F.lit("\n"), F.left(_get("$.tool_input.content"), F.lit(OUTPUT))))
        .when(tool.isin("Grep", "Glob"), F.concat(tool, F.lit(": "), _get("$.tool_input.pattern"), F.lit("\n"), F.left(_get("$.tool_response"), F.lit(OUTPUT))))
        .otherwise(F.concat(F.lit("Tool: "), tool, F.lit("\nInput: "), F.left(_get("$.tool_input", "null"), F.lit(OUTPUT)), F.lit("\nResult: "), F.left(_get("$.tool_response", "{}"), F.lit(OUTPUT))))
    )
    return F.when(event == "UserPromptSubmit", _get("$.prompt")).when(event == "Stop", F.col("last_text")).when(event == "PostToolUse", used)


def last_texts(transcripts: DataFrame) -> DataFrame:
    """transcripts (path, line_no, line): path, last_text: all texts of the last assistant line, on one line."""
    said = transcripts.filter(F.get_json_object("line", "$.type") == "assistant")
    parts = F.from_json(F.get_json_object("line", "$.message.content"), "array<struct<type:string,text:string>>")
    texts = F.transform(F.filter(F.coalesce(parts, F.array().cast("array<struct<type:string,text:string>>")), lambda p: p["type"] == "text"), lambda p: p["text"])
    rows = said.withColumn("text", F.replace(F.array_join(texts, "\n"), F.lit("\n"), F.lit(" ")))
    return rows.groupBy("path").agg(F.max_by("text", "line_no").alias("last_text"))


def messages(hooks: DataFrame, transcripts: DataFrame | None = None, agent_id: str = "default") -> DataFrame:
    """hooks (raw): session_id, agent_id, role, content; other events and empty contents are dropped."""
    if transcripts is not None:
        hooks = hooks.withColumn("_path", F.get_json_object("raw", "$.transcript_path"))
        hooks = hooks.join(last_texts(transcripts), F.col("_path") == F.col("path"), "left").drop("_path", "path")
    else:
        hooks = hooks.withColumn("last_text", F.lit(None).cast("string"))
    event = _get("$.hook_event_name")
    role = F.when(event == "UserPromptSubmit", "user").when(event == "Stop", "assistant").when(event == "PostToolUse", "tool")
    rows = hooks.select(_get("$.session_id", "unknown").alias("session_id"), F.lit(agent_id).alias("agent_id"), role.alias("role"), content().alias("content"))
    return rows.filter("role IS NOT NULL AND content <> ''")
