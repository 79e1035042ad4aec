"""Tool-call events from a plain-text log.

A record starts at a line with a time and one of three marks. Its arguments may go on over
the following lines, up to 21 of them, until they are complete JSON or the next timed line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.staging import staged
from ..functions.text import extract, signature, strip, strip_escapes
from ..functions.variants import (first_present, is_json, is_number, is_text, members, number_in, text_in, unwrapped_json,
                                  whole_json, wrapped_json)
from ..runtime import checkpointed
from .ordered import carry_forward

# The marks and forms of the log.
TOOL_MARK = r"\bToolCall:\s*([A-Za-z0-9_.:-]+)"
FUNCTION_MARK = r"\bFunctionCall:\s*([A-Za-z0-9_.:-]+)"
BACKGROUND_MARK = r"\bBackgroundEvent:"
TIMED_LINE = r"^\s*\d{4}-\d{2}-\d{2}[ T]"
ISO_TIME = r"(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d{1,3})?(?:Z|[+-]\d{2}:?\d{2})?)"
PLAIN_TIME = r"(\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}:\d{2}(?:\.\d{1,3})?)"
KEY_VALUE = r"""(\w+)=(("(?:[^"\\]|\\.)*")|('(?:[^'\\]|\\.)*')|[^\s]+)"""
MAX_LINES = 21

# Argument names, and words which tell the state of a call.
EXIT_CODE = ("exit_code", "exitCode", "code")
DURATION = ("duration_ms", "durationMs", "duration")
STDOUT = ("stdout_bytes", "stdoutBytes", "stdout")
STDERR = ("stderr_bytes", "stderrBytes", "stderr")
ERROR = ("error", "err", "message")
STATUS = ("status", "state", "event", "phase")
COMMAND = ("cmd", "command")
STATUS_WORDS = {
    "start": ("start", "started", "starting", "running", "pending"),
    "exit": ("ok", "success", "succeeded", "complete", "completed", "done", "finished", "exit"),
    "failure": ("fail", "failed", "failure", "error", "errored"),
}
LINE_WORDS = {"failure": ("failed", "error"), "exit": ("completed", "finished", "success"),
              "start": ("started", "running", "pending")}


def _named(text: Column, pattern: str) -> Column:
    """First match of a group that is never empty."""
    return F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))


def log_instant(iso: Column, plain: Column, tz: str = "UTC") -> Column:
    """Milliseconds of the first time in a line: ISO, else date and time in the zone of the log. Both are plain columns."""
    def local(stamp):
        wall = stamp.try_cast("timestamp_ntz")
        utc = wall if tz == "UTC" else F.convert_timezone(F.lit(tz), F.lit("UTC"), wall)
        return F.timestamp_diff("MILLISECOND", F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"), utc)

    zoned = F.regexp_replace(iso, r"([+-]\d{2})(\d{2})$", "$1:$2")
    is_zoned = iso.rlike(r"(Z|[+-]\d{2}:?\d{2})$") & iso.contains("T") & iso.rlike(r":\d{2}(\.\d+)?(Z|[+-])")
    return F.coalesce(F.when(is_zoned, F.unix_millis(zoned.try_cast("timestamp"))).otherwise(local(iso)), local(plain))


def _after(text: Column, mark: str) -> Column:
    return F.regexp_extract(text, mark.replace("([", "[").replace("+)", "+") + "(.*)$", 1)


def _clean_prefix(rest: Column) -> Column:
    plain = F.regexp_replace(strip(rest), r"^[:\-\s]+", "")
    return strip(F.regexp_replace(plain, r"(?i)^args?=\s*", ""))


def _without_parentheses(text: Column) -> Column:
    return F.when(text.startswith("(") & text.endswith(")"), strip(F.substring(text, F.lit(2), F.length(text) - 2))).otherwise(text)


def _opens_json(text: Column) -> Column:
    return text.startswith("{") | text.startswith("[")


def _has_word(text: Column, words: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for word in words:
        found = found | text.contains(word)
    return found


def tool_log_records(lines: DataFrame, tz: str = "UTC", max_lines: int = MAX_LINES) -> DataFrame:
    """Records ``file, line, ts, mark, text, tool_name, args`` from ``file, line, value``.

    Arguments that go on below their record are read over ``max_lines`` lines at most (a timed
    line ends them earlier); logs with longer ones need a larger number.
    """
    clean = staged(lines.select("file", "line", "value"), text=strip_escapes(F.col("value"))).drop("value")
    text = F.col("text")
    # The plain search spares most lines the pattern.
    mark = (F.when(text.contains("ToolCall:") & text.rlike(TOOL_MARK), "tool")
            .when(text.contains("FunctionCall:") & text.rlike(FUNCTION_MARK), "function")
            .when(text.contains("BackgroundEvent:") & text.rlike(BACKGROUND_MARK)
                  & _has_word(F.lower(text), LINE_WORDS["failure"]), "background"))
    starts = clean.filter(mark.isNotNull()).withColumn("mark", mark)
    named = F.when(F.col("mark") == "tool", _named(text, TOOL_MARK)).when(
        F.col("mark") == "function", _named(text, FUNCTION_MARK))
    rest = F.when(F.col("mark") == "tool", _after(text, TOOL_MARK)).when(
        F.col("mark") == "function", _after(text, FUNCTION_MARK))
    # Plain projections are compiled; a column that the next one names more than once is not copied into it.
    starts = starts.withColumns({"iso": _named(text, ISO_TIME), "plain": _named(text, PLAIN_TIME), "tool_name": named,
                                 "rest": _clean_prefix(rest)})
    starts = starts.withColumns({"ts": log_instant(F.col("iso"), F.col("plain"), tz),
                                 "given": _without_parentheses(F.col("rest"))}).drop("iso", "plain")
    starts = starts.withColumn("open_ended", F.coalesce(
        (F.col("rest") == "") | (_opens_json(F.col("given")) & ~is_json(F.col("given"))), F.lit(False)))

    # Records are few among the lines, those that go on fewer; both are used more than once. A filter before would
    # be computed apart from the column it names.
    starts = checkpointed(starts).filter(F.col("ts").isNotNull())
    longer = checkpointed(_continued(starts.filter("open_ended"), clean.filter(~text.rlike(TIMED_LINE)), max_lines))
    starts = starts.join(longer.select("file", "line", "long_args", "consumed"), ["file", "line"], "left")
    starts = starts.join(_consumed_lines(longer.filter("consumed > 0").select("file", "line", "consumed")),
                         ["file", "line"], "left_anti")
    args = F.when(F.col("open_ended"), F.col("long_args")).otherwise(F.col("given"))
    return starts.select("file", "line", "ts", "mark", "text", "tool_name", F.nullif(args, F.lit("")).alias("args"))


def _continued(starts: DataFrame, more: DataFrame, max_lines: int) -> DataFrame:
    """Arguments of records that go on: the shortest run of lines that completes the JSON.

    Lines meet as blocks of ``max_lines``, of which a record reaches into two at most.
    """
    block = lambda line: F.floor(line / F.lit(max_lines))
    blocks = more.filter(F.col("text").isNotNull()).groupBy("file", block(F.col("line")).alias("at")).agg(
        F.collect_list(F.struct("line", F.col("text").alias("next_text"))).alias("lines"))
    reach = F.sequence(block(F.col("line") + 1), block(F.col("line") + max_lines))
    below = F.transform("lines", lambda x: F.struct((x["line"] - F.col("line")).cast("int").alias("i"), x["next_text"].alias("next_text")))
    found = (starts.select("file", "line", "rest", "given", F.explode(reach).alias("at"))
             .join(blocks, ["file", "at"], "left")
             .groupBy("file", "line").agg(
                 F.first("rest").alias("rest"), F.first("given").alias("given"),
                 F.sort_array(F.flatten(F.collect_list(F.filter(below, lambda x: x["i"].between(1, max_lines))))).alias("near")))
    # Lines in an unbroken row after the record; a timed line ends it.
    run = F.transform(F.filter("near", lambda x, j: x["i"] == j + 1), lambda x: x["next_text"])
    found = staged(found, run=run)
    next_line = strip(F.coalesce(F.get("run", F.lit(0)), F.lit("")))
    found = staged(found, moved=(F.col("rest") == "") & _opens_json(next_line), next_line=next_line)
    used = F.col("moved").cast("int")
    found = staged(found, base=F.when(F.col("moved"), _without_parentheses(F.col("next_line"))).otherwise(F.col("given")),
                   tail=F.slice("run", used + 1, F.lit(max_lines)), used=used)
    most = F.least(F.size("tail"), F.lit(max_lines) - F.col("used"))
    joined = lambda k: F.concat_ws("\n", F.array("base"), F.slice("tail", F.lit(1), k))
    enough = F.get(F.filter(F.sequence(F.lit(0), most), lambda k: is_json(joined(k))), F.lit(0))
    found = staged(found, k=F.when(_opens_json(F.col("base")), F.coalesce(enough, most)).otherwise(F.lit(0)))
    return found.select("file", "line", F.when(F.col("base") != "", joined(F.col("k"))).alias("long_args"),
                        (F.col("used") + F.col("k")).alias("consumed"))


def _consumed_lines(eaters: DataFrame) -> DataFrame:
    """Lines taken up by records as arguments; such a line starts no record itself.

    A record lying in another's arguments takes up nothing. Where records overlap in a row,
    they are settled from the first onward.
    """
    reach = lambda df: df.select("file", F.explode(F.sequence(F.col("line") + 1, F.col("line") + F.col("consumed"))).alias("line"))
    covered = reach(eaters).distinct().withColumn("inner", F.lit(True))
    marked = eaters.join(covered, ["file", "line"], "left").withColumn("opens", F.when(F.col("inner").isNull(), F.col("line")))
    chains = carry_forward(marked, ["file"], "line", "opens", "chain", include_current=True)
    state = F.struct(F.lit(0).cast("bigint").alias("end"),
                     F.array().cast("array<struct<line: bigint, consumed: int>>").alias("kept"))

    def step(acc, x):
        return F.when(x["line"] > acc["end"], F.struct(
            (x["line"] + x["consumed"]).alias("end"),
            F.concat(acc["kept"], F.array(x)).alias("kept"))).otherwise(acc)

    lone = chains.groupBy("file", "chain").agg(F.sort_array(F.collect_list(F.struct(
        F.col("line"), F.col("consumed").cast("int").alias("consumed")))).alias("eaters"))
    real = lone.select("file", F.inline(F.aggregate("eaters", state, step)["kept"]))
    return reach(real).distinct()


def _number(value: Column) -> Column:
    """A number, or a non-blank string holding one."""
    return F.when(is_number(value), F.try_variant_get(value, "$", "double")).when(
        is_text(value), _text_as_number(F.try_variant_get(value, "$", "string")))


def _text_as_number(text: Column) -> Column:
    return F.when(strip(text) != "", number_in(text))


def _filled(text: Column) -> Column:
    return F.when(strip(text) != "", text)


def _unquoted(text: Column) -> Column:
    quoted = lambda q: text.startswith(q) & text.endswith(q)
    return F.when(quoted('"') | quoted("'"), F.substring(text, F.lit(2), F.greatest(F.length(text) - 2, F.lit(0)))).otherwise(text)


def _with_arguments(records: DataFrame) -> DataFrame:
    """Add the named arguments, from JSON if the text is JSON, else from key=value pairs."""
    text = F.col("_text")
    boxed = (text.startswith("{") & text.endswith("}")) | (text.startswith("[") & text.endswith("]"))
    df = records.withColumn("_text", strip(F.col("args"))).withColumn("_boxed", F.when(boxed, wrapped_json(text)))
    df = df.withColumn("_doc", F.when(whole_json(F.col("_boxed")), unwrapped_json(F.col("_boxed"))))
    # A repeated key counts with its last value.
    pairs = F.map_from_arrays(F.regexp_extract_all(text, F.lit(KEY_VALUE), F.lit(1)),
                              F.regexp_extract_all(text, F.lit(KEY_VALUE), F.lit(2)))
    keys = dict(exit_code=EXIT_CODE, duration_ms=DURATION, stdout_bytes=STDOUT, stderr_bytes=STDERR, error=ERROR, status=STATUS)
    wanted = [k for names in (*keys.values(), COMMAND) for k in names]
    df = df.withColumns({"_object": members(F.col("_doc"), *wanted),
                         "_pairs": F.when(F.col("_doc").isNull() & text.contains("="), pairs)})
    member = lambda key: F.col("_object")[key]
    pair = lambda key: _unquoted(F.col("_pairs")[key])
    # Values are picked first and converted in the next step.
    picked = {f"_{n}": first_present(*map(member, names)) for n, names in keys.items()}
    paired = {f"_{n}_pair": F.coalesce(*map(pair, names)) for n, names in keys.items()}
    commands = {f"_{k}": text_in(member(k)) for k in COMMAND}
    df = df.withColumns({**picked, **paired, **commands, **{f"_{k}_pair": pair(k) for k in COMMAND}})
    number = lambda n: F.coalesce(_number(F.col(f"_{n}")), _text_as_number(F.col(f"_{n}_pair"))).cast("bigint")
    text_of = lambda n: F.coalesce(_filled(text_in(F.col(f"_{n}"))), _filled(F.col(f"_{n}_pair")))
    command = F.coalesce(*[_filled(F.col(f"_{k}")) for k in COMMAND], *[_filled(F.col(f"_{k}_pair")) for k in COMMAND])
    df = df.withColumns({"command": command, **{n: text_of(n) if n in ("error", "status") else number(n) for n in keys}})
    return df.select(*[c for c in df.columns if not c.startswith("_")])


def event_type(status: Column, lowered: Column, exit_code: Column, error: Column, duration: Column) -> Column:
    """Start, exit or failure: by the status word, words of the line in small letters, exit code, error, duration."""
    chain = F.when(F.lower(status).isin(*STATUS_WORDS["start"]), "start")
    for name in ("exit", "failure"):
        chain = chain.when(F.lower(status).isin(*STATUS_WORDS[name]), name)
    for name in ("failure", "exit", "start"):
        chain = chain.when(_has_word(lowered, LINE_WORDS[name]), name)
    return (chain.when(exit_code == 0, "exit").when(exit_code.isNotNull(), "failure").when(error.isNotNull(), "failure")
            .when(duration.isNotNull(), "exit").otherwise("start"))


def tool_log_events(records: DataFrame) -> DataFrame:
    """Start and end events in one stream.

    ``rank`` settles equal times: function calls, then tool events, then background events.
    """
    nothing = {n: F.lit(None).cast("bigint") for n in ("exit_code", "duration_ms", "stdout_bytes", "stderr_bytes")}
    argued = _with_arguments(records.filter(F.col("mark") != "background"))
    is_call = F.col("mark") == "function"
    argued = argued.withColumns({"_lowered": F.when(~is_call, F.lower("text")), "_said": F.coalesce("command", "args")})
    calls = argued.withColumns({
        "rank": F.when(is_call, 0).otherwise(1),
        "event_type": F.when(is_call, "start").otherwise(event_type(
            F.col("status"), F.col("_lowered"), F.col("exit_code"), F.col("error"), F.col("duration_ms"))),
        "signature": signature(F.col("tool_name"), F.col("_said"))})
    text = F.col("text")
    code = F.coalesce(extract(text, r"(?i)exit\s*code\s*=?\s*(-?\d+)"), extract(text, r"(?i)code\s*=?\s*(-?\d+)"))
    failed = records.filter(F.col("mark") == "background").withColumns({
        "tool_name": extract(text, r"(?i)tool\s*=?\s*([A-Za-z0-9_.:-]+)"),
        "_command": strip(extract(text, r"""(?i)command\s*=?\s*("[^"]+"|'[^']+'|[^,]+)$""")),
        "error": F.nullif(strip(extract(text, r"(?i)(Execution failed:|Error:|Failed:)(.*)$", 2)), F.lit("")),
        **{**nothing, "exit_code": code.try_cast("bigint")}})
    failed = failed.withColumn("command", _unquoted(F.col("_command"))).withColumn("_said", F.coalesce("command", "text"))
    failed = failed.withColumns({"rank": F.lit(2), "event_type": F.lit("failure"),
                                 "signature": signature(F.col("tool_name"), F.col("_said"))})
    names = ["file", "line", "ts", "rank", "event_type", "tool_name", "command", "signature", *nothing, "error"]
    # A start carries nothing about how the call went.
    ended = F.col("event_type") != "start"
    both = calls.select(*names).unionByName(failed.select(*names))
    return both.select(*[F.when(ended, F.col(n)).alias(n) if n in nothing or n == "error" else F.col(n) for n in names])
