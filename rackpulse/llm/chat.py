"""Chat logs to training text: event-sourced reconstruction, then a reversible template with a loss mask.

A log holds events. ``message`` starts a message, ``delta`` appends to it, ``edit`` and ``regenerate`` replace
what it has so far. Events are partitioned by conversation, put in sequence and folded: a message is what its last
replacing event says, with all deltas after it. Messages stand in the order of their first event.

The template is, for each message, ``### <role>``, a line end, the text and ``</turn>`` with a line end. Inside
roles and texts ``~``, ``#`` and ``<`` become ``~0``, ``~1`` and ``~2`` (line ends of roles ``~3``), so a mark never
occurs inside a text, whatever the text says, and reading back gives the exact messages.

Defined results: a null text or role is empty; a null sequence number comes first; events with equal sequence
numbers stand by message, action, role and text, and repeated rows all count; an event without an action is a
``message``; an event without a message id is a message of its own; rows without a conversation id form one
conversation of that (null) id; an empty log gives no rows; further columns are not read.

The training text of a conversation is one value, so its turns end up in one row; nothing else is gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rackpulse.llm.tables import table, text_of

OPEN, CLOSE = "### ", "</turn>\n"
TRAINED_ROLE = "assistant"
#: A conversation whose texts hold the template's own marks; the query adds it to the table.
PROBE = (-7, r"\### Assistant: </turn> ok")


def escaped(text: Column) -> Column:
    """Texts without any mark of the template; ``unescaped`` is the exact inverse."""
    for plain, code in (("~", "~0"), ("#", "~1"), ("<", "~2")):
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescaped(text: Column) -> Column:
    for plain, code in (("<", "~2"), ("#", "~1"), ("~", "~0")):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def messages(events: DataFrame) -> DataFrame:
    """Final messages (``conv_id``, ``position``, ``role``, ``text``) of a log.

    The log has ``conv_id``, ``seq``, ``role``, ``text`` and may have ``action`` and ``message_id``.
    """
    have = set(events.columns)
    action = F.coalesce(F.col("action"), F.lit("message")) if "action" in have else F.lit("message")
    message = F.col("message_id").cast("string") if "message_id" in have else F.lit(None).cast("string")
    log = events.select(
        "conv_id", "seq", action.alias("action"), message.alias("message"), text_of("role").alias("role"), text_of().alias("text")
    )
    order = [F.col(c).asc_nulls_first() for c in ("seq", "message", "action", "role", "text")]
    log = log.withColumn("place", F.row_number().over(Window.partitionBy("conv_id").orderBy(*order)))
    # An event without an id is a message of its own, named by its place.
    log = log.withColumn("message", F.coalesce(F.concat(F.lit("id "), "message"), F.concat(F.lit("at "), F.col("place").cast("string"))))
    own = Window.partitionBy("conv_id", "message").orderBy("place")
    log = log.withColumn("version", F.count_if(F.col("action") != "delta").over(own))
    last = Window.partitionBy("conv_id", "message")
    log = log.withColumn("last", F.max("version").over(last)).withColumn("position", F.min("place").over(last))
    return (
        log.filter(F.col("version") == F.col("last")).groupBy("conv_id", "position")
        .agg(F.sort_array(F.collect_list(F.struct("place", "role", "text"))).alias("parts"))
        .select(
            "conv_id", "position", F.col("parts")[0]["role"].alias("role"),
            F.array_join(F.transform("parts", lambda p: p["text"]), "").alias("text"),
        )
    )


def formatted(final: DataFrame, trained_role: str = TRAINED_ROLE) -> DataFrame:
    """Training text of every conversation (``conv_id``, ``formatted``, ``loss_spans``).

    ``loss_spans`` holds turn (from 0), start and end, in code points of ``formatted``, of the texts to train on.
    """
    role = F.replace(escaped(F.col("role")), F.lit("\n"), F.lit("~3"))
    head = F.concat(F.lit(OPEN), role, F.lit("\n"))
    rank = F.row_number().over(Window.partitionBy("conv_id").orderBy("position"))  # folded messages leave gaps
    turns = final.select(
        "conv_id", rank.alias("position"), "role", head.alias("head"), escaped(F.col("text")).alias("body"),
    ).withColumn("chars", (F.length("head") + F.length("body") + len(CLOSE)).cast("long"))
    until = F.sum("chars").over(Window.partitionBy("conv_id").orderBy("position").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    begin = until - F.col("chars") + F.length("head")
    turns = turns.select(
        "conv_id", "position", F.concat("head", "body", F.lit(CLOSE)).alias("piece"),
        F.when(F.col("role") == trained_role, F.struct((F.col("position") - 1).cast("int").alias("turn"), begin.alias("start"), (begin + F.length("body")).alias("end"))).alias("span"),
    )
    gathered = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("position", "piece", "span"))).alias("t"))
    return gathered.select(
        "conv_id", F.array_join(F.transform("t", lambda x: x["piece"]), "").alias("formatted"),
        F.filter(F.transform("t", lambda x: x["span"]), lambda x: x.isNotNull()).alias("loss_spans"),
    )


def read_back(texts: DataFrame) -> DataFrame:
    """The messages in training texts: ``conv_id``, ``turn``, ``role``, ``text`` and ``loss``.

    ``loss`` is what the loss mask covers of the message, null where it covers nothing. Everything comes from
    ``formatted`` and ``loss_spans`` alone.
    """
    pieces = texts.select("conv_id", F.posexplode(F.split("formatted", CLOSE, -1)).alias("turn", "piece")).filter(F.col("piece") != "")
    chars = (F.length("piece") + len(CLOSE)).cast("long")
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    pieces = pieces.withColumn("begin", F.sum(chars).over(before) - chars)
    spans = texts.select(F.col("conv_id").alias("span_conv"), F.inline("loss_spans"))
    spans = spans.select("span_conv", F.col("turn").alias("span_turn"), "start", "end")
    both = pieces.join(spans, F.col("conv_id").eqNullSafe(F.col("span_conv")) & (F.col("turn") == F.col("span_turn")), "left")
    end = F.instr("piece", "\n")
    covered = F.substr("piece", (F.col("start") - F.col("begin") + 1).cast("int"), (F.col("end") - F.col("start")).cast("int"))
    role = F.substr("piece", F.lit(len(OPEN) + 1), end - len(OPEN) - 1)
    return both.select(
        "conv_id", "turn", unescaped(F.replace(role, F.lit("~3"), F.lit("\n"))).alias("role"),
        unescaped(F.substr("piece", end + 1)).alias("text"), unescaped(covered).alias("loss"),
    )


def query(spark: SparkSession, folder: str) -> DataFrame:
    """Digest of every formatted conversation, read back from the training text.

    Each turn is an event that starts a message of its own; the log is folded like any other.
    """
    log = table(spark, folder, "conversations").select("conv_id", F.col("turn").alias("seq"), "role", "text")
    number, said = PROBE
    probe = spark.range(2).select(
        F.lit(number).cast("long").alias("conv_id"), F.col("id").alias("seq"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"),
    )
    out = formatted(messages(log.unionByName(probe).withColumn("action", F.lit("message"))))
    spoken = F.concat("role", F.lit("\n"), "text", F.lit("\n"))
    back = read_back(out).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", spoken.alias("spoken"), "loss"))).alias("t"))
    back = back.select(
        F.col("conv_id").alias("back_conv"), F.size("t").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("t", lambda x: x["spoken"]), ""), 256).alias("turns_sha256"),
        F.array_join(F.transform("t", lambda x: x["loss"]), "").alias("loss"),
    )
    return out.join(back, F.col("conv_id").eqNullSafe(F.col("back_conv"))).select(
        "conv_id", "n_turns", "turns_sha256", F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss"), 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


SQL = r"""
WITH log AS (
       SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
       UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
       UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
     turns AS (
       SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS n,
              5 + length(role) + length(regexp_replace(role, '[^~#<' || chr(10) || ']', '', 'g'))
              + length(text) + length(regexp_replace(text, '[^~#<]', '', 'g')) + 8 AS chars
       FROM log)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(chars)::BIGINT AS formatted_chars
FROM turns GROUP BY conv_id
"""

QUERIES = {"op1_chat_formatting": (query, SQL)}
