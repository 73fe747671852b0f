"""Chat formatting in budgeted windows, with DataFrame functions only.

Prefix sums of turn tokens cut a conversation into turn-aligned spans of target turns.
A window holds the system turn, a limited stretch of the turns before its span
(repeated, under no loss) and the span. Loss lies on the assistant texts of the span.

Template. A turn of an assistant is ``<s>text</s>``, any other turn is
``<s>[INST] <<role >> text [/INST]``. Inside roles and texts a backslash is doubled
and a control string gets a backslash after its first character, so none is left and
the text can be read back exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

BUDGET = 2048
HISTORY = 512
#: Tokens that a turn's marks count for.
TURN_MARKS = 4
#: Turn numbers per block: prefix sums run inside blocks and then over block totals.
BLOCK = 128
ASSISTANT, SYSTEM = "assistant", "system"

_OPEN, _ASK, _ROLE_END, _ANSWERED, _CLOSE = "<s>", "[INST] <<", " >> ", " [/INST]", "</s>"
#: The first character of a control string: <s>, </s>, <<, >>, [INST] or [/INST].
_CONTROL = r"(<(?=<|/?s>)|>(?=>)|\[(?=/?INST\]))"


def escape(text: Column) -> Column:
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(doubled, _CONTROL, r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(\\?)", "$1")


def token_count(text: Column) -> Column:
    """Tokens of a text by a rule that needs no vocabulary: stretches of letters or digits, and other signs."""
    return F.regexp_count(text, F.lit(r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]")).cast("bigint")


def _turns(conversations: DataFrame) -> DataFrame:
    """Turns with their tokens before and after (``a``, ``b``), and what the conversation's first turn is."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    place = F.coalesce("turn", F.lit(2**63 - 1))
    turns = conversations.select(
        "conv_id", place.alias("place"), role.alias("role"), text.alias("text"), (token_count(text) + TURN_MARKS).alias("tokens"), F.floor(place / BLOCK).alias("block")
    )
    inside = Window.partitionBy("conv_id", "block").orderBy("place", "role", "text").rowsBetween(Window.unboundedPreceding, 0)
    placed = turns.withColumn("upto", F.sum("tokens").over(inside))
    head = F.min_by(F.struct("role", "text", "tokens"), F.struct("place", "role", "text"))
    totals = turns.groupBy("conv_id", "block").agg(F.sum("tokens").alias("total"), head.alias("head"))
    over = Window.partitionBy("conv_id").orderBy("block")
    before = F.coalesce(F.sum("total").over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = totals.select(F.col("conv_id").alias("c"), F.col("block").alias("k"), before.alias("before"), F.first("head").over(over).alias("first"))
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("block") == F.col("k"))
    b = F.col("before") + F.col("upto")
    return placed.join(starts, same).select("conv_id", "role", "text", (b - F.col("tokens")).alias("a"), b.alias("b"), "first")


def windows(conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """One row per window: conv_id, window, formatted, n_repeated, n_targets, tokens, loss.

    ``loss`` is an array of (start, length) in code points of ``formatted``; the first
    ``n_repeated`` turns of a window are its system turn and history. ``window``
    rises with the conversation.

    A system turn is the conversation's first turn if its role is ``system``. The span
    of a window holds at most half of what system turn and history leave (at least a
    quarter of the budget) before its last turn starts, and at most as much again with
    it, so a window keeps to the budget unless one turn alone, or the system turn,
    breaks it. Such a long turn is a span of its own and is never cut or dropped.

    Null or empty texts are empty turns, a null role is the empty role, turns without a
    number come last, ties are ordered by role and text, repeated rows are turns each.
    Rows without conv_id are one conversation. Only conv_id, turn, role and text are read.
    """
    turns = _turns(conversations)
    system = F.col("first.role") == SYSTEM
    kept = F.when(system, F.col("first.tokens")).otherwise(0)
    room = F.greatest(F.lit(budget - history) - kept, F.lit(budget // 4))
    half = F.floor(room / 2)
    bins = turns.withColumns({"half": half, "bin": F.floor(F.col("a") / half), "is_first": F.col("a") == 0, "has_system": system})
    # A turn of more than half the room comes last in its bin, as the next turn starts in a later bin.
    long = (F.col("b") - F.col("a") > F.col("half")).cast("bigint")
    bins = bins.withColumn("own", F.col("bin") * 2 + long)
    # A turn can be history of the windows that start within ``history`` tokens of its start.
    last = F.floor((F.col("a") + history) / F.col("half"))
    later = F.flatten(F.transform(F.sequence("bin", last), lambda x: F.array(x * 2, x * 2 + 1)))
    reached = F.filter(later, lambda x: x > F.col("own"))
    is_system = F.col("is_first") & F.col("has_system")
    places = F.when(is_system | (F.col("b") - F.col("a") > history), F.array("own")).otherwise(F.concat(F.array("own"), reached))
    dealt = bins.withColumn("window", F.explode(places)).withColumn("target", F.col("window") == F.col("own"))
    grouped = dealt.groupBy("conv_id", "window").agg(
        F.min(F.when(F.col("target"), F.col("a"))).alias("start"),
        F.max(F.struct("has_system", "first"))["has_system"].alias("has_system"),
        F.max("first").alias("first"),
        F.array_sort(F.collect_list(F.struct("a", "b", "target", "role", "text"))).alias("turns"),
    )
    spans = grouped.filter(F.col("start").isNotNull())
    chosen = F.filter("turns", lambda t: t["target"] | (t["a"] >= F.col("start") - history))
    head = F.struct(
        F.lit(0).cast("bigint").alias("a"), F.col("first.tokens").alias("b"), F.lit(False).alias("target"), F.col("first.role").alias("role"), F.col("first.text").alias("text")
    )
    whole = F.when(F.col("has_system") & (F.col("start") > 0), F.concat(F.array(head), chosen)).otherwise(chosen)
    shaped = spans.select("conv_id", "window", whole.alias("turns"))

    parts = F.transform(
        "turns",
        lambda t: F.struct(
            t["target"].alias("target"),
            (t["role"] == ASSISTANT).alias("answer"),
            (t["b"] - t["a"]).alias("tokens"),
            F.when(t["role"] == ASSISTANT, F.concat(F.lit(_OPEN), escape(t["text"]), F.lit(_CLOSE)))
            .otherwise(F.concat(F.lit(_OPEN + _ASK), escape(t["role"]), F.lit(_ROLE_END), escape(t["text"]), F.lit(_ANSWERED)))
            .alias("text"),
        ),
    )
    written = shaped.select("conv_id", "window", parts.alias("parts"))
    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("loss"))
    marks = len(_OPEN) + len(_CLOSE)

    def step(sofar: Column, p: Column) -> Column:
        size = F.length(p["text"])
        span = F.struct((sofar["at"] + len(_OPEN)).alias("start"), (size - marks).alias("length"))
        loss = F.when(p["target"] & p["answer"], F.concat(sofar["loss"], F.array(span))).otherwise(sofar["loss"])
        return F.struct((sofar["at"] + size).alias("at"), loss.alias("loss"))

    return written.select(
        "conv_id",
        "window",
        F.array_join("parts.text", "").alias("formatted"),
        F.size(F.filter("parts", lambda p: ~p["target"])).alias("n_repeated"),
        F.size(F.filter("parts", lambda p: p["target"])).alias("n_targets"),
        F.aggregate("parts", F.lit(0).cast("bigint"), lambda s, p: s + p["tokens"]).alias("tokens"),
        F.aggregate("parts", empty, step)["loss"].alias("loss"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """Per window, from its formatted text and mask alone: the new turns (role, text), the text under loss, characters."""
    pieces = F.slice(F.split("formatted", _OPEN), F.col("n_repeated") + 2, F.greatest(F.col("n_targets"), F.lit(1)))
    ask, end = len(_ASK), len(_ANSWERED)

    def parse(piece: Column) -> Column:
        cut = F.locate(_ROLE_END, piece)
        role = F.substr(piece, F.lit(ask + 1), cut - 1 - ask)
        at = cut + len(_ROLE_END)
        asked = F.substr(piece, at, F.length(piece) - end - at + 1)
        answer = F.substr(piece, F.lit(1), F.length(piece) - len(_CLOSE))
        is_asked = F.startswith(piece, F.lit(_ASK)) & F.endswith(piece, F.lit(_ANSWERED))
        return F.when(is_asked, F.struct(unescape(role).alias("role"), unescape(asked).alias("text"))).otherwise(
            F.struct(F.lit(ASSISTANT).alias("role"), unescape(answer).alias("text"))
        )

    under = F.transform("loss", lambda s: unescape(F.substr(F.col("formatted"), s["start"] + 1, s["length"])))
    return formatted.select(
        "conv_id", "window", F.transform(pieces, parse).alias("turns"), F.array_join(under, "").alias("loss_text"), F.length("formatted").cast("bigint").alias("chars")
    )


def digest(formatted: DataFrame) -> DataFrame:
    """Per conversation what its windows hold: number and digest of turns and loss text, characters.

    A digest is over a whole conversation, so its text has to come together once.
    """
    parsed = read_back(formatted)
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    parts = parsed.select("conv_id", "chars", F.size("turns").alias("n"), F.struct("window", turns.alias("turns"), F.col("loss_text").alias("loss")).alias("part"))
    whole = parts.groupBy("conv_id").agg(F.sum("chars").alias("formatted_chars"), F.sum("n").cast("bigint").alias("n_turns"), F.array_sort(F.collect_list("part")).alias("parts"))
    loss = F.array_join("parts.loss", "")
    return whole.select(
        "conv_id",
        "n_turns",
        F.sha2(F.array_join("parts.turns", "").cast("binary"), 256).alias("turns_sha256"),
        F.length(loss).cast("bigint").alias("loss_chars"),
        F.sha2(loss.cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
    )
