"""Arrays of turns: struct(from, value, type, duration, offset)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TURN = "struct<from:string,value:string,type:string,duration:double,offset:double>"
TURNS = f"array<{TURN}>"


def turn(role: Column, value: Column, kind: Column, duration: Column | None = None, offset: Column | None = None) -> Column:
    null = F.lit(None).cast("double")
    fields = {"from": role, "value": value, "type": kind, "duration": null if duration is None else duration, "offset": null if offset is None else offset}
    return F.struct(*[c.alias(n) for n, c in fields.items()]).cast(TURN)


def first_audio(turns: Column) -> Column:
    return F.get(F.filter(turns, lambda t: t["type"] == "audio"), F.lit(0))


def first_text(turns: Column) -> Column:
    """The first text turn after the first audio turn."""
    at = F.array_position(F.transform(turns, lambda t: t["type"]), "audio").cast("int")
    after = F.slice(turns, at + 1, F.greatest(F.size(turns), F.lit(1)))
    return F.when(at > 0, F.get(F.filter(after, lambda t: t["type"] == "text"), F.lit(0)))


def context(turns: Column) -> Column:
    """The first text turn that stands before any audio turn."""
    return F.when(F.get(turns, F.lit(0))["type"] == "text", F.get(turns, F.lit(0)))


def audio_duration(turns: Column) -> Column:
    return F.aggregate(F.filter(turns, lambda t: t["type"] == "audio"), F.lit(0.0), lambda a, t: a + F.coalesce(t["duration"], F.lit(0.0)))


def set_context(turns: Column, ctx: Column, force: bool = False) -> Column:
    """With `ctx` first if the first turn is audio; with `force`, it replaces a first turn that is text."""
    new = F.concat(F.array(ctx), turns)
    other = F.concat(F.array(ctx), F.slice(turns, 2, F.greatest(F.size(turns), F.lit(1)))) if force else turns
    return F.when(F.get(turns, F.lit(0))["type"] == "audio", new).otherwise(other)


def swap_first_two(turns: Column) -> Column:
    """Text then audio becomes audio then text."""
    a, b = F.get(turns, F.lit(0)), F.get(turns, F.lit(1))
    swapped = F.concat(F.array(b, a), F.slice(turns, 3, F.greatest(F.size(turns), F.lit(1))))
    return F.when((a["type"] == "text") & (b["type"] == "audio"), swapped).otherwise(turns)


def with_system(turns: Column, prompt: str) -> Column:
    first = F.get(turns, F.lit(0))["from"]
    return F.when(~first.eqNullSafe("system"), F.concat(F.array(turn(F.lit("system"), F.lit(prompt), F.lit("text"))), turns)).otherwise(turns)


def rewrite_prefix(turns: Column, old: str, new: str) -> tuple[Column, Column]:
    """Audio paths that begin with `old` begin with `new`; and how many do."""
    hit = lambda t: (t["type"] == "audio") & F.startswith(t["value"], F.lit(old))
    moved = F.transform(turns, lambda t: F.when(hit(t), t.withField("value", F.concat(F.lit(new), F.substr(t["value"], F.lit(len(old) + 1))))).otherwise(t))
    return moved, F.size(F.filter(turns, hit))


def from_flat(audio: Column, duration: Column, offset: Column, text: Column) -> Column:
    """A flat row as two turns: the user's audio and the assistant's text."""
    return F.array(turn(F.lit("User"), audio, F.lit("audio"), duration, F.coalesce(offset, F.lit(0.0))), turn(F.lit("Assistant"), text, F.lit("text")))


def to_json(turns: Column) -> Column:
    """The turns as JSON; fields that are null are left out."""
    return F.to_json(turns)


def shuffle_user_runs(rows: DataFrame, conv: str, order: str, role: str, kind: str, seed: int = 0) -> DataFrame:
    """Runs of two or more user turns are reversed for half of the runs, by a hash: chunk by chunk of equal kinds, or turn by turn if there is one chunk.

    Adds new_order. Rows of a conversation are the unit of work.
    """
    w = Window.partitionBy(conv).orderBy(order)
    df = rows.withColumn("__run", F.sum((~F.col(role).eqNullSafe(F.lag(role).over(w))).cast("int")).over(w).cast("int"))
    change = (~F.col(role).eqNullSafe(F.lag(role).over(w))) | (~F.col(kind).eqNullSafe(F.lag(kind).over(w)))
    df = df.withColumn("__chunk", F.sum(change.cast("int")).over(w).cast("int")).withColumn("__at", F.row_number().over(w))
    run = Window.partitionBy(conv, "__run")
    df = df.withColumns({"__n": F.count(F.lit(1)).over(run), "__first": F.min("__chunk").over(run), "__last": F.max("__chunk").over(run)})
    flip = (F.col(role) == "user") & (F.col("__n") > 1) & (F.pmod(F.xxhash64(F.col(conv), F.col("__run"), F.lit(seed)), F.lit(2)) == 0)
    key = (
        F.when(flip & (F.col("__first") == F.col("__last")), F.struct(F.lit(0).alias("c"), (-F.col("__at")).alias("a")))
        .when(flip, F.struct((-F.col("__chunk")).alias("c"), F.col("__at").alias("a")))
        .otherwise(F.struct(F.col("__chunk").alias("c"), F.col("__at").alias("a")))
    )
    ranked = df.withColumn("new_order", F.row_number().over(Window.partitionBy(conv).orderBy("__run", key)))
    return ranked.drop("__run", "__chunk", "__at", "__n", "__first", "__last")
