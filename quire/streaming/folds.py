"""Streams: folding fragments of model answers, incremental ingest, windows with late data.

A fragment is a row (stream_id, seq, payload), payload a JSON event of one of
two dialects. The fold is an aggregate over the fragments of a stream in order
of seq; on unbounded streams the same aggregate runs on each trigger's state.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

CHOICES = "choices array<struct<delta:struct<content:string,tool_calls:array<struct<index:int,id:string,function:struct<name:string,arguments:string>>>>>>"
BLOCKS = "type string, index int, content_block struct<type:string,id:string,name:string>, delta struct<type:string,text:string,partial_json:string>"


def sse_payloads(lines: DataFrame, value: str = "value") -> DataFrame:
    """Events of a server-sent stream: `data:` lines, up to the end mark, which is dropped."""
    data = F.trim(F.regexp_replace(value, r"^data:", ""))
    return lines.where(F.startswith(F.col(value), F.lit("data:"))).withColumn("payload", data).where("payload != '[DONE]'").drop(value)


def _in_order(value: Column, order: Column) -> Column:
    """Concatenation of a group's values by order; nulls left out."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), value.alias("v")))), lambda x: x["v"]), "")


def _calls(parts: DataFrame, stream: str) -> DataFrame:
    """(stream, calls) of call fragments (stream, index, o, id, name, arguments)."""
    one = parts.groupBy(stream, "index").agg(*[_in_order(F.col(c), F.col("o")).alias(c) for c in ("id", "name", "arguments")]).where("name != ''")
    call = F.struct("index", F.coalesce(F.nullif("id", F.lit("")), F.concat(F.lit("call_"), F.col("index").cast("string"))).alias("id"), "name", F.coalesce(F.nullif("arguments", F.lit("")), F.lit("{}")).alias("arguments"))
    return one.groupBy(stream).agg(F.transform(F.array_sort(F.collect_list(call)), lambda c: F.struct(c["id"], c["name"], c["arguments"])).alias("calls"))


NO_CALLS = "cast(array() as array<struct<id:string,name:string,arguments:string>>)"


def fold_choices(fragments: DataFrame, stream: str = "stream_id", seq: str = "seq") -> DataFrame:
    """(stream, text, calls) of the dialect with choices and deltas: texts joined, call fragments joined by index."""
    rows = fragments.withColumn("_e", F.get(F.from_json("payload", CHOICES)["choices"], F.lit(0))["delta"])
    text = rows.groupBy(stream).agg(_in_order(F.col("_e.content"), F.col(seq)).alias("text"))
    parts = rows.select(stream, F.col(seq).alias("_s"), F.posexplode("_e.tool_calls").alias("_p", "c")).select(stream, F.coalesce("c.index", F.lit(0)).alias("index"), F.struct("_s", "_p").alias("o"), "c.id", "c.function.name", "c.function.arguments")
    return text.join(_calls(parts, stream), stream, "left").withColumn("calls", F.coalesce("calls", F.expr(NO_CALLS)))


def fold_blocks(fragments: DataFrame, stream: str = "stream_id", seq: str = "seq") -> DataFrame:
    """(stream, text, calls, is_done) of the dialect with content blocks."""
    rows = fragments.withColumn("_e", F.from_json("payload", BLOCKS)).select(stream, F.col(seq).alias("o"), "_e.*")
    is_text = (F.col("type") == "content_block_delta") & (F.col("delta.type") == "text_delta")
    text = rows.groupBy(stream).agg(_in_order(F.when(is_text, F.col("delta.text")), F.col("o")).alias("text"), F.coalesce(F.bool_or(F.col("type") == "message_stop"), F.lit(False)).alias("is_done"))
    opened = (F.col("type") == "content_block_start") & (F.col("content_block.type") == "tool_use")
    part = (F.col("type") == "content_block_delta") & (F.col("delta.type") == "input_json_delta")
    calls = rows.where(opened | part).select(stream, "index", "o", F.when(opened, F.col("content_block.id")).alias("id"), F.when(opened, F.col("content_block.name")).alias("name"), F.when(part, F.col("delta.partial_json")).alias("arguments"))
    return text.join(_calls(calls, stream), stream, "left").withColumn("calls", F.coalesce("calls", F.expr(NO_CALLS)))


CALLS = "array<struct<id:string,name:string,arguments:string>>"


def _messages(messages: DataFrame) -> DataFrame:
    """Messages with the columns tool_calls and tool_call_id, empty where they lack them."""
    absent = {"tool_calls": F.lit(None).cast(CALLS), "tool_call_id": F.lit(None).cast("string")}
    return messages.withColumns({c: v for c, v in absent.items() if c not in messages.columns})


def _json(text: Column, otherwise: str) -> Column:
    """JSON text as a value; something else where it isn't JSON."""
    return F.coalesce(F.try_parse_json(text), F.parse_json(F.lit(otherwise)))


def _as_value(c: Column) -> Column:
    """An array or struct as a value of any shape, its nulls left out."""
    return F.parse_json(F.to_json(c))


def _tools(tools: Sequence[dict], shape: Callable[[dict], dict]) -> Column:
    """The tools (name, description, parameters) as a dialect writes them; null where there are none."""
    return F.parse_json(F.lit(json.dumps([shape(t) for t in tools]))) if tools else F.lit(None).cast("variant")


def _ordered(message: Column, turn: str) -> Column:
    return F.transform(F.array_sort(F.collect_list(F.struct(F.col(turn).alias("t"), F.to_json(message).alias("m")))), lambda x: F.parse_json(x["m"]))


def chat_payload(messages: DataFrame, model: str, conversation: str = "conv_id", turn: str = "turn", tools: Sequence[dict] = ()) -> DataFrame:
    """(conversation, payload): request bodies with all messages in order, the calls that an assistant made and the call that a result answers.

    messages: (conversation, turn, role, text[, tool_calls, tool_call_id]), tool_calls as CALLS.
    """
    rows = _messages(messages)
    call = lambda c: F.struct(c["id"].alias("id"), F.lit("function").alias("type"), F.struct(c["name"].alias("name"), c["arguments"].alias("arguments")).alias("function"))
    calls = F.when(F.size("tool_calls") > 0, F.transform("tool_calls", call))
    message = F.struct("role", F.coalesce("text", F.lit("")).alias("content"), calls.alias("tool_calls"), "tool_call_id")
    listed = _tools(tools, lambda t: {"type": "function", "function": {"name": t["name"], "description": t["description"], "parameters": t["parameters"]}})
    body = rows.groupBy(conversation).agg(_ordered(message, turn).alias("messages"))
    return body.select(conversation, F.to_json(F.struct(F.lit(model).alias("model"), F.lit(True).alias("stream"), "messages", listed.alias("tools"))).alias("payload"))


def block_payload(messages: DataFrame, model: str, conversation: str = "conv_id", turn: str = "turn", max_tokens: int = 4096, tools: Sequence[dict] = ()) -> DataFrame:
    """(conversation, payload) of the other dialect: the first system message apart, an assistant's text and calls as blocks, tool results as user messages.

    Arguments that aren't JSON become an empty object.
    """
    rows, text = _messages(messages), F.coalesce("text", F.lit(""))
    none = F.lit(None).cast("string")
    block = lambda type_, text=none, id_=none, name=none, input_=None, answers=none, content=none: F.struct(F.lit(type_).alias("type"), text.alias("text"), id_.alias("id"), name.alias("name"), (F.lit(None).cast("variant") if input_ is None else input_).alias("input"), answers.alias("tool_use_id"), content.alias("content"))
    said = F.filter(F.array(block("text", text)), lambda _: text != "")
    called = F.transform(F.coalesce("tool_calls", F.expr(f"cast(array() as {CALLS})")), lambda c: block("tool_use", id_=c["id"], name=c["name"], input_=_json(c["arguments"], "{}")))
    result = F.array(block("tool_result", answers=F.coalesce("tool_call_id", F.lit("")), content=text))
    content = F.when(F.col("role") == "tool", _as_value(result)).when(F.col("role") == "assistant", _as_value(F.concat(said, called))).otherwise(text.cast("variant"))
    message = F.struct(F.when(F.col("role") == "tool", "user").otherwise(F.col("role")).alias("role"), content.alias("content"))
    is_system = F.col("role") == "system"
    system = F.min_by(F.when(is_system, F.col("text")), F.when(is_system, F.col(turn)))
    rows = rows.select(conversation, turn, "role", "text", message.alias("message"))
    spoken = F.transform(F.array_sort(F.collect_list(F.when(~is_system, F.struct(F.col(turn).alias("t"), F.to_json("message").alias("m"))))), lambda x: F.parse_json(x["m"]))
    listed = _tools(tools, lambda t: {"name": t["name"], "description": t["description"], "input_schema": t["parameters"]})
    body = rows.groupBy(conversation).agg(system.alias("system"), spoken.alias("messages"))
    return body.select(conversation, F.to_json(F.struct(F.lit(model).alias("model"), F.lit(max_tokens).alias("max_tokens"), F.lit(True).alias("stream"), "messages", "system", listed.alias("tools"))).alias("payload"))


def call_summary(arguments: Column) -> Column:
    """What a tool call asks for: its query, else its highlight, else its page."""
    at = lambda k: F.get_json_object(arguments, f"$.{k}")
    return F.coalesce(at("query"), at("highlight"), F.concat(F.lit("page "), at("page")), F.lit(""))


def windowed_counts(events: DataFrame, time: str = "ts", width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(start, event_type, n, total) by tumbling windows; rows later than the watermark are dropped. For streams and tables."""
    rows = events.withColumn("_t", F.col(time).cast("timestamp"))
    if rows.isStreaming:
        rows = rows.withWatermark("_t", late)
    return rows.groupBy(F.window("_t", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def first_seen(events: DataFrame, keys: list[str], time: str = "ts", late: str = "2 hours") -> DataFrame:
    """Rows whose keys haven't come before; state is kept as long as the watermark allows."""
    if not events.isStreaming:
        return events.dropDuplicates(keys)
    return events.withColumn("_t", F.col(time).cast("timestamp")).withWatermark("_t", late).dropDuplicatesWithinWatermark(keys).drop("_t")


def run_to_end(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Feeds all that is there to sink, a batch at a time, each once after a restart; returns when done."""
    stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


#: Parts of a sink's table, by a hash of the keys.
PARTS = 64


def idempotent_append(path: str, keys: list[str]) -> Callable[[DataFrame, int], None]:
    """A sink that appends the rows whose keys the table lacks; repeating a batch changes nothing.

    The table is partitioned by a hash of the keys, `_part`; a batch reads the
    keys of the parts that it falls into. read_appended() gives the rows.
    """

    def sink(batch: DataFrame, _: int) -> None:
        from pyspark.errors import AnalysisException

        spark = batch.sparkSession
        rows = batch.dropDuplicates(keys).withColumn("_part", F.pmod(F.xxhash64(*keys), F.lit(PARTS)).cast("int"))
        try:
            known = spark.read.parquet(path).select(*keys, "_part")
        except AnalysisException as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
        else:
            parts = [r[0] for r in rows.select("_part").distinct().collect()]  # PARTS at most
            rows = rows.join(known.where(F.col("_part").isin(parts)).drop("_part"), keys, "left_anti")
        rows.repartition("_part").write.mode("append").partitionBy("_part").parquet(path)

    return sink


def read_appended(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("_part")


STATE = "text string, calls string, is_done boolean"
#: How long a stream's state is kept after its last fragment.
PATIENCE_MS = 3_600_000


def fold_stream(fragments: DataFrame, stream: str = "stream_id", seq: str = "seq", patience_ms: int | None = PATIENCE_MS) -> DataFrame:
    """(stream, text, calls, is_done) after each trigger, for unbounded streams of fragments in either dialect.

    The state of a stream is its fragments by seq, so one that comes late takes
    its place and one that comes twice counts once. It goes with its stream's
    last fragment, or when none has come for patience_ms. Waiting means that
    triggers go on without data; a query that is to end with its input takes
    None, and keeps its state. calls is JSON by index.
    """
    kind = fragments.schema[stream].dataType.simpleString()
    rows = fragments.select(stream, seq, "payload").groupBy(stream)
    return rows.applyInPandasWithState(_folder(stream, seq, patience_ms), f"{stream} {kind}, {STATE}", "payloads string", "update", "NoTimeout" if patience_ms is None else "ProcessingTimeTimeout")


def _folder(stream: str, seq: str, patience_ms: int | None):
    import pandas as pd

    def fold(key, frames, state):
        if state.hasTimedOut:
            state.remove()
            return
        payloads = json.loads(state.get[0]) if state.exists else {}
        for frame in frames:
            payloads |= {str(n): p for n, p in zip(frame[seq].tolist(), frame["payload"].tolist(), strict=True)}
        text, calls, done = "", {}, False
        for n in sorted(payloads, key=int):
            added, done = fold_event(payloads[n], calls, done)
            text += added
        if done and state.exists:
            state.remove()
        elif not done:
            state.update((json.dumps(payloads),))
            if patience_ms is not None:
                state.setTimeoutDuration(patience_ms)
        yield pd.DataFrame({stream: [key[0]], "text": [text], "calls": [json.dumps(calls)], "is_done": [done]})

    return fold


def fold_event(payload: str, calls: dict[str, dict], done: bool) -> tuple[str, bool]:
    """The text that an event adds, and whether the stream has ended; pieces of calls are added to calls."""
    try:
        event = json.loads(payload)
    except ValueError:
        return "", done
    if not isinstance(event, dict):
        return "", done
    add = lambda index, **parts: [calls.setdefault(str(index), {"id": "", "name": "", "arguments": ""}).update({k: calls[str(index)][k] + (v or "")}) for k, v in parts.items()]
    if event.get("choices"):
        delta = event["choices"][0].get("delta") or {}
        for c in delta.get("tool_calls") or ():
            own = c.get("function") or {}
            add(c.get("index") or 0, id=c.get("id"), name=own.get("name"), arguments=own.get("arguments"))
        return delta.get("content") or "", done
    delta, block = event.get("delta") or {}, event.get("content_block") or {}
    if block.get("type") == "tool_use":
        add(event.get("index"), id=block.get("id"), name=block.get("name"))
    elif delta.get("type") == "input_json_delta":
        add(event.get("index"), arguments=delta.get("partial_json"))
    return delta.get("text") or "" if delta.get("type") == "text_delta" else "", done or event.get("type") == "message_stop"
