"""Chat formatting by event sourcing: fold a log of message events, then render a template.

DataFrame functions only. The log is partitioned by conversation and sorted by sequence once;
the windows and aggregates that follow reuse that partitioning, so there is one shuffle.
A rendered conversation is one string, so a conversation's turns meet in one task at the last
step; what precedes it streams through sorted windows, which spill.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values of the template.
START, END = "<|im_start|>", "<|im_end|>"
#: Kinds of event: message opens one, delta appends to it, edit and regenerate replace what it had.
OPENING, REPLACING = ("message", "edit", "regenerate"), ("edit", "regenerate")


def escaped(text: Column) -> Column:
    r"""Reversible: a backslash before each backslash and inside each '<|', so no control string is left."""
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def escaped_role(role: Column) -> Column:
    return F.replace(escaped(role), F.lit("\n"), F.lit("\\\n"))


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def fold_events(events: DataFrame) -> DataFrame:
    """Final messages of an event log.

    events: conv_id, seq, message_id, kind, role, text; more columns are ignored. Events apply in
    order of (seq, kind, text), nulls first; ties are repeated rows, whose order can't matter.
    A message stands where its first event stands. Its text is that of its last opening event
    (message, edit, regenerate) and the deltas after it; its role is the last one given. A null
    text is empty, a null role is ''. A kind other than delta, edit, regenerate counts as message.
    A message deleted by its last opening event of kind 'delete' is left out. A null conv_id is a
    conversation of its own. Returns conv_id, place, role, text; no rows give no rows.
    """
    log = events.select(
        "conv_id",
        "seq",
        "message_id",
        F.coalesce("kind", F.lit("message")).alias("kind"),
        "role",
        F.coalesce("text", F.lit("")).alias("text"),
    ).repartition("conv_id")
    whole = Window.partitionBy("conv_id").orderBy("seq", "kind", "text")
    log = log.withColumn("place", F.row_number().over(whole))
    one = Window.partitionBy("conv_id", "message_id")
    opens = F.col("kind") != "delta"
    log = log.withColumn("opened", F.max(F.when(opens, F.col("place"))).over(one))
    live = F.col("opened").isNull() | (F.col("place") >= F.col("opened"))
    part = F.struct("place", "text")
    folded = log.groupBy("conv_id", "message_id").agg(
        F.min("place").alias("place"),
        F.max(F.when(F.col("role").isNotNull(), F.struct("place", "role"))).alias("last_role"),
        F.max_by("kind", F.when(opens, F.col("place"))).alias("state"),
        F.array_sort(F.collect_list(F.when(live, part))).alias("parts"),
    )
    return folded.where(F.coalesce("state", F.lit("message")) != "delete").select(
        "conv_id",
        "place",
        F.coalesce(F.col("last_role.role"), F.lit("")).alias("role"),
        F.array_join(F.transform("parts", lambda p: p["text"]), "").alias("text"),
    )


def render(messages: DataFrame, trained_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One formatted string for each conversation, and where its turns' texts stand.

    messages: conv_id, place, role, text, as fold_events returns them. Returns conv_id, formatted,
    turns: array of struct(start, length, loss) in order, in code points of formatted; loss is true
    where the role is one of trained_roles.
    """
    head = F.concat(F.lit(START), escaped_role(F.col("role")), F.lit("\n"))
    body = escaped(F.col("text"))
    turns = messages.select(
        "conv_id",
        "place",
        F.concat(head, body, F.lit(END + "\n")).alias("piece"),
        F.length(head).cast("long").alias("head"),
        F.length(body).cast("long").alias("length"),
        F.col("role").isin(*trained_roles).alias("loss"),
    )
    before = Window.partitionBy("conv_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    at = F.coalesce(F.sum(F.length("piece")).over(before), F.lit(0)) + F.col("head")
    turns = turns.withColumn("start", at)
    kept = F.array_sort(F.collect_list(F.struct("place", "piece", "start", "length", "loss")))
    return (
        turns.groupBy("conv_id")
        .agg(kept.alias("all"))
        .select(
            "conv_id",
            F.array_join(F.transform("all", lambda t: t["piece"]), "").alias("formatted"),
            F.transform("all", lambda t: F.struct(t["start"], t["length"], t["loss"])).alias("turns"),
        )
    )


def parse(formatted: Column) -> Column:
    """array of struct(role, text, raw), read back from a formatted string."""
    pieces = F.split(formatted, r"<\|im_end\|>\n")
    pieces = F.slice(pieces, 1, F.size(pieces) - 1)
    header = r"(?s)^<\|im_start\|>((?:[^\\\n]++|\\.)*+)\n"

    def turn(piece: Column) -> Column:
        role = F.regexp_extract(piece, header, 1)
        raw = piece.substr(F.length(role) + F.lit(len(START) + 2), F.length(piece))
        return F.struct(unescaped(role).alias("role"), unescaped(raw).alias("text"))

    return F.transform(pieces, turn)


def format_chats(events: DataFrame, trained_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """fold_events, then render."""
    return render(fold_events(events), trained_roles)


def chat_digest(formatted: DataFrame) -> DataFrame:
    """Digests of what is read back from formatted strings: all turns, and what the loss mask covers."""
    back = formatted.select("conv_id", "formatted", "turns", parse(F.col("formatted")).alias("back"))
    # What the mask covers is cut from the string at the spans, so a wrong span shows.
    cut = lambda t: unescaped(F.substring(F.col("formatted"), (t["start"] + 1).cast("int"), t["length"].cast("int")))
    masked = F.array_join(F.transform(F.filter("turns", lambda t: t["loss"]), cut), "")
    whole = F.array_join(F.transform("back", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("back").cast("long").alias("n_turns"),
        F.sha2(whole, 256).alias("turns_sha256"),
        F.length(masked).cast("long").alias("loss_chars"),
        F.sha2(masked, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def events_of(conversations: DataFrame) -> DataFrame:
    """The event log of a table of finished turns: each row opens one message, rows by turn.

    Rows with the same turn come in order of (role, text); equal rows are messages of their own.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    place = F.row_number().over(order)
    return (
        conversations.select("conv_id", "turn", "role", "text")
        .repartition("conv_id")
        .select("conv_id", place.alias("seq"), place.alias("message_id"), F.lit("message").alias("kind"), "role", "text")
    )
