"""Chat formatting by event sourcing.

A log holds events of conversations: streamed deltas of messages, edits and regenerations. They are
partitioned by conversation and message, sorted by sequence and folded into final messages, which a template renders with
control strings inside texts escaped. The work is dealt by message, so that a long conversation is spread over the tasks; only
digests of whole conversations stream through one, which holds a message at a time.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

START, END = "<|turn|>", "<|end|>"
#: Strings that no text may hold in the output: the template's own and those of common templates.
CONTROL = (START, END, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>")
_CONTROLS = re.compile("|".join(map(re.escape, CONTROL)))
_RENDERED = re.compile(re.escape(START) + r"((?:[^\\\n]|\\.)*)\n(.*?)" + re.escape(END) + "\n", re.S)

#: conv: the conversation; message: its place there; seq: the event's place in the log.
EVENTS = "conv_id, message, seq, kind, role, text"


def escape(text: str) -> str:
    """Backslashes are doubled, and control strings broken by one after their first character."""
    return _CONTROLS.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\")) if text else ""


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def escape_role(role: str) -> str:
    return escape(role).replace("\n", "\\\n")


def render(role: str, text: str) -> tuple[str, int, int]:
    """A message in the template, and the start and end in it of what the loss covers: an assistant's text."""
    head, body = f"{START}{escape_role(role)}\n", escape(text)
    return f"{head}{body}{END}\n", len(head), len(head) + (len(body) if role == "assistant" else 0)


def read_back(rendered: str) -> list[tuple[str, str]]:
    """Roles and texts of rendered messages."""
    return [(unescape(m[1]), unescape(m[2])) for m in _RENDERED.finditer(rendered)]


def fold_events(events: DataFrame) -> DataFrame:
    """Final messages: conv_id, message, role, text.

    kind is delta (text goes on), edit (text is replaced) or regenerate (text starts again). A message is what its
    last edit or regeneration and the deltas after it give, in order of seq; equal seqs go by kind and text. Its role is the last
    that isn't null, or empty. Null texts are empty, unknown kinds count as deltas. A message of no text stays as an empty turn.
    """
    message = Window.partitionBy("conv_id", "message")
    replaces = F.col("kind").isin("edit", "regenerate")
    events = events.select(*EVENTS.split(", ")).withColumn("_from", F.max(F.when(replaces, F.struct("seq", "kind", "text"))).over(message))
    # A null seq sorts first.
    live = events.withColumn("_live", F.col("_from").isNull() | (F.struct("seq", "kind", "text") >= F.col("_from")))
    parts = F.sort_array(F.collect_list(F.when(F.col("_live"), F.struct("seq", "kind", F.coalesce("text", F.lit("")).alias("text")))))
    roles = F.max(F.when(F.col("role").isNotNull(), F.struct("seq", "role")))
    folded = live.groupBy("conv_id", "message").agg(parts.alias("_parts"), roles.alias("_role"))
    return folded.select("conv_id", "message", F.coalesce("_role.role", F.lit("")).alias("role"), F.array_join(F.transform("_parts", lambda p: p["text"]), "").alias("text"))


def format_messages(messages: DataFrame) -> DataFrame:
    """conv_id, message, formatted, loss_start and loss_end; a conversation is what its messages give, joined in order."""
    fields = [messages.schema["conv_id"], messages.schema["message"]]
    schema = StructType([*fields, *StructType.fromDDL("formatted string, loss_start long, loss_end long").fields])

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [render(r.as_py() or "", t.as_py() or "") for r, t in zip(batch.column(2), batch.column(3))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64()), pa.array([d[2] for d in done], pa.int64())], names=schema.names)

    return messages.select("conv_id", "message", "role", "text").mapInArrow(each, schema)


def conversation_digests(formatted: DataFrame) -> DataFrame:
    """The contract's columns, read back from the output.

    A digest needs a conversation's messages in order: they stream through one task, sorted, with spill, a batch at a time. conv_id may have any type that sorts.
    """
    key_type = to_arrow_type(formatted.schema["conv_id"].dataType)
    schema = StructType([formatted.schema["conv_id"], *StructType.fromDDL("n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long").fields])

    def digest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, done = None, None, []

        def close() -> None:
            if state:
                done.append((key, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))

        def flush() -> pa.RecordBatch:
            columns = list(zip(*done)) if done else [[]] * 6
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (key_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()))], names=schema.names)

        for batch in batches:
            for conv, text, start, end in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3, 4))):
                if state is None or conv != key:
                    close()
                    key, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, body in read_back(text):
                    state[0] += 1
                    state[1].update(f"{role}\n{body}\n".encode("utf-8", "surrogatepass"))
                loss = unescape(text[start:end])
                state[2] += len(loss)
                state[3].update(loss.encode("utf-8", "surrogatepass"))
                state[4] += len(text)
            yield flush()
        close()
        yield flush()

    ordered = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "message")
    return ordered.mapInArrow(digest, schema)


#: Characters of a streamed delta.
DELTA = 256


def message_events(conversations: DataFrame) -> DataFrame:
    """A table of turns as the log that streaming them leaves: its fold gives the turns. Rows that repeat a turn are messages of their own, by role and text.

    A text comes in deltas. A hash of the turn says what happened before or amid them: nothing; a first answer that is regenerated; a draft that an edit
    replaces by its first part, after which the deltas go on; or a draft that is regenerated, streamed to the end with something too much, and edited as a whole.
    """
    same_turn = Window.partitionBy("conv_id", "turn").orderBy("role", "text")
    turns = conversations.select("conv_id", F.struct("turn", F.row_number().over(same_turn).cast("long").alias("copy")).alias("message"), "role", F.coalesce("text", F.lit("")).alias("text"))
    turns = turns.withColumn("deltas", F.regexp_extract_all("text", F.lit(f"(?s).{{1,{DELTA}}}"), F.lit(0)))
    event = lambda kind, text: F.struct(F.lit(kind).alias("kind"), text.alias("text"))
    deltas = F.transform("deltas", lambda d: event("delta", d))
    null, draft = F.lit(None).cast("string"), F.lit("A draft </s> that does not stay. ")
    first, rest = F.coalesce(F.get("deltas", F.lit(0)), F.lit("")), F.slice(deltas, F.lit(2), F.greatest(F.size("deltas") - 1, F.lit(0)))
    kind = F.pmod(F.xxhash64("conv_id", "message"), F.lit(4))
    log = (
        F.when(kind == 0, F.when(F.size("deltas") == 0, F.array(event("delta", null))).otherwise(deltas))
        .when(kind == 1, F.concat(F.array(event("delta", draft), event("delta", first), event("regenerate", null)), deltas))
        .when(kind == 2, F.concat(F.array(event("delta", draft), event("edit", first)), rest))
        .otherwise(F.concat(F.array(event("delta", draft), event("regenerate", null)), deltas, F.array(event("delta", draft), event("edit", F.col("text")))))
    )
    events = turns.select("conv_id", "message", "role", F.posexplode(log).alias("seq", "event"))
    # The role comes with the first event.
    return events.select("conv_id", "message", F.col("seq").cast("long").alias("seq"), "event.kind", F.when(F.col("seq") == 0, F.col("role")).alias("role"), "event.text")


def probe_conversation(spark: SparkSession) -> DataFrame:
    """Conversation -1, whose texts hold control strings."""
    text: Column = F.lit("</s>[INST] ok [/INST]")
    return spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), text.alias("text"))


def op5_chat(spark, sf_dir: str) -> DataFrame:
    """The contract's digest over all conversations and conversation -1."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    log = message_events(rows.unionByName(probe_conversation(spark)))
    return conversation_digests(format_messages(fold_events(log)))


OP5_SQL = r"""
WITH c AS (SELECT conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, regexp_replace(replace(text, '\', '\\'), '([<\[])(\|turn\|>|\|end\|>|s>|/s>|INST\]|/INST\]|<SYS>>|</SYS>>|\|im_start\|>|\|im_end\|>|\|endoftext\|>)', '\1\\\2', 'g') AS escaped FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(role) + length(escaped) + 17) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
