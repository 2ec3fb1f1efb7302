"""Evidence tags of meeting pages: which line, state or picture a citation leads to, and why it leads nowhere."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import groupby

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.ordered import in_order

WINDOW_S, REACH_S = 300, 10
#: Bytes of text that one look-up of quotes holds.
SLICE_BYTES = 4_000_000
WORD_RUN = re.compile(r"\w+")


def window_of(second: Column | str, window_s: int = WINDOW_S) -> Column:
    """The window, from 1, that holds a second."""
    at = F.col(second) if isinstance(second, str) else second
    return F.floor(at / window_s) + 1


def around(rows: DataFrame, reach: int) -> DataFrame:
    """Rows once for their own stretch of time and each beside it, so that "within reach" is an equality join and a test."""
    return rows.withColumn("__near", F.explode(F.array(*[F.floor(F.col("second") / reach) + k for k in (-1, 0, 1)])))


def held_around(asked: DataFrame, texts: DataFrame, place: list[str], reach: int) -> DataFrame:
    """place, quote, __here (held at the second itself, in an own text; or null), __best (away and at of the nearest other second that holds it).

    asked: place, quote, distinct; texts: place, text, own.  place ends in second.  Each text goes once to its moment, and each quote once to
    every moment within reach; moments with many texts are dealt in slices.
    """
    *group, _ = place
    at = [*group, "__at"]
    every = texts.where("text is not null").withColumnRenamed("second", "__at").where(F.col("__at").isNotNull())
    slices = every.groupBy(*at).agg((F.floor(F.sum(F.octet_length("text")) / SLICE_BYTES) + 1).alias("__slices"))
    near = around(asked, reach).join(slices.withColumn("__near", F.floor(F.col("__at") / reach)), [*group, "__near"]).drop("__near")
    near = near.withColumn("__away", F.abs(F.col("__at") - F.col("second"))).where(F.col("__away") <= reach)
    probes = near.select(*at, "quote", "__slices").distinct().select(*at, "quote", F.explode(F.sequence(F.lit(1).cast("bigint"), "__slices")).alias("__slice"))
    many = F.broadcast(slices.where("__slices > 1"))  # a row for some megabytes of text at most
    part = F.coalesce(F.pmod(F.xxhash64("text"), F.col("__slices")) + 1, F.lit(1).cast("bigint"))
    dealt = every.join(many, at, "left").select(*at, "text", "own", part.alias("__slice"))
    rows = probes.select(*at, "__slice", F.lit(0).alias("__kind"), "quote").unionByName(dealt.select(*at, "__slice", F.when(F.col("own"), 1).otherwise(2).alias("__kind"), F.col("text").alias("quote")))
    hits = in_order(rows, [*at, "__slice"], ["__kind"], holding, {"quote": "string", "__own": "boolean"})
    held = hits.groupBy(*at, "quote").agg(F.bool_or("__own").alias("__own"))
    found = near.drop("__slices").join(held, [*at, "quote"])
    best = F.min(F.when(F.col("__away") > 0, F.struct(F.col("__away").alias("away"), F.col("__at").alias("at")))).alias("__best")
    return found.groupBy(*place, "quote").agg(F.max(F.when((F.col("__away") == 0) & F.col("__own"), True)).alias("__here"), best)


def holding(rows: Iterator[tuple]) -> Iterator[tuple]:
    """The quotes (kind 0) of each moment that one of its texts holds, and whether an own one (kind 1) does.

    A quote of letters, digits and underscores alone lies inside a word, so it is looked for in the moment's distinct words; others
    are looked for in the texts themselves, if their longest word is among these.
    """
    for key, moment in groupby(rows, lambda r: r[:-2]):
        quotes, texts = [], ([], [])
        for *_, kind, text in moment:
            (quotes if kind == 0 else texts[kind - 1]).append(text)
        if not quotes:
            continue
        words = ["\n".join({w for t in some for w in WORD_RUN.findall(t)}) for some in texts]
        for quote in quotes:
            pieces = [p for p in (x.strip(" ") for x in re.split(r"\.\.\.|…", quote)) if p]
            longest = max((w for p in pieces for w in WORD_RUN.findall(p)), key=len, default="")
            simple = len(pieces) == 1 and longest == pieces[0]
            for k, some in enumerate(texts):
                if some and longest in words[k] and (simple or any(stands(pieces, t) for t in some)):
                    yield (*key, quote, k == 0)
                    break


def stands(pieces: list[str], text: str) -> bool:
    """Whether pieces stand in a text one after another, as functions.columns.quote_held has it."""
    at = 0
    for p in pieces:
        found = text.find(p, at)
        if found < 0:
            return False
        at = found + len(p)
    return True


def citation_chain(
    cites: DataFrame, recordings: DataFrame, windows: DataFrame, lines: DataFrame, transcript: DataFrame, reach: int = REACH_S, window_s: int = WINDOW_S
) -> DataFrame:
    """id, outcome, via, hint of each citation; the first look-up that answers has it, and a miss says which one failed.

    cites: id (unique), page, recording (null: the tag names none and the first is meant), second, channel (heard, seen), quote (or null).
    recordings: page, recording.  windows: page, recording, window of the units that can be read.
    lines: page, recording, window, second, channel, text.  transcript: page, second, text, heard in no recording's window.

    The chain: the recording is there (only a heard tag without a number may go on without it); a line of the channel stands at the second in its
    window, or in the transcript for what was heard; one of them holds the quote.  outcome: resolved, no-recording, no-window (its unit can't be
    read), no-line, no-words (a quote without a letter or digit), quote-elsewhere, quote-absent.  via: window or transcript, where a line was
    found.  hint: the nearest other second within reach at which the quote is, the earlier of two, for no-line and quote-elsewhere.
    """
    n = F.coalesce("recording", F.lit(1)).cast("bigint")
    tags = cites.select("id", "page", F.col("recording").isNull().alias("__bare"), n.alias("recording"), "second", "channel", "quote", window_of("second", window_s).alias("window"))
    has = recordings.select("page", F.col("recording").cast("bigint").alias("recording")).distinct().withColumn("__has", F.lit(True))
    open_ = windows.select("page", F.col("recording").cast("bigint").alias("recording"), F.col("window").cast("bigint").alias("window")).distinct().withColumn("__open", F.lit(True))
    tags = tags.join(has, ["page", "recording"], "left").join(open_, ["page", "recording", "window"], "left")
    tags = tags.withColumn("__blocked", F.col("__has").isNull() & ~(F.col("__bare") & (F.col("channel") == "heard")))

    whole = lambda c: F.col(c).cast("bigint").alias(c)
    said = lines.select("page", whole("recording"), "channel", "second", "text", F.coalesce(F.col("window") == window_of("second", window_s), F.lit(False)).alias("own"))
    heard = transcript.select("page", F.lit("heard").alias("channel"), "second", "text", F.lit(True).alias("own"))
    asked = tags.where("not __blocked").select("page", "recording", "channel", "second", "quote")
    spot = ["page", "recording", "channel", "second"]
    rows = tags
    for name, texts, place in (("window", said, spot), ("transcript", heard, ["page", "channel", "second"])):
        lined = texts.where("own").select(*place).distinct().withColumn(f"__line_{name}", F.lit(True))
        answers = held_around(asked.select(*place, "quote").where("quote is not null").distinct(), texts, place, reach)
        rows = rows.join(lined, place, "left").join(answers.withColumnsRenamed({"__here": f"__quote_{name}", "__best": f"__best_{name}"}), [*place, "quote"], "left")
    rows = rows.withColumn("__hint", F.least("__best_window", "__best_transcript")["at"])

    words, quoted = F.col("quote").rlike(r"[\p{L}\p{N}]"), F.col("quote").isNotNull()
    lined = F.col("__line_window").isNotNull() | F.col("__line_transcript").isNotNull()
    held = F.col("__quote_window").isNotNull() | F.col("__quote_transcript").isNotNull()
    outcome = (
        F.when(F.col("__blocked"), "no-recording").when(~lined & F.col("__open").isNull(), "no-window").when(~lined, "no-line").when(~quoted, "resolved")
        .when(~words, "no-words").when(held, "resolved").when(F.col("__hint").isNotNull(), "quote-elsewhere").otherwise("quote-absent")
    )
    by_quote = F.when(F.col("__quote_window").isNotNull(), "window").when(held, "transcript")
    via = F.when(F.col("__blocked") | ~lined, None).otherwise(F.coalesce(by_quote, F.when(F.col("__line_window").isNotNull(), "window").otherwise("transcript")))
    out = rows.select("id", outcome.alias("outcome"), via.alias("via"), F.when(words, F.col("__hint")).alias("hint"))
    return out.withColumn("hint", F.when(F.col("outcome").isin("no-line", "quote-elsewhere"), F.col("hint")))


def frame_chain(cites: DataFrame, windows: DataFrame, states: DataFrame, keyframes: DataFrame, opened: DataFrame, window_s: int = WINDOW_S) -> DataFrame:
    """id, outcome, state, frame of citations of a picture: the state that holds the second, then its last keyframe up to it, then whether it was opened.

    cites: id (unique), page, recording, second.  windows: page, recording, window that can be read.  states: page, recording, window, state, start_s,
    end_s, both ends within; at a boundary the later state has it.  keyframes: page, recording, state, second, frame, of any window of the state.
    opened: page, frame.  outcome: ok, no-window, no-state, no-frame, not-opened.
    """
    spot = ["page", "recording", "window"]
    tags = cites.select("id", "page", "recording", "second", window_of("second", window_s).alias("window"))
    tags = tags.join(windows.select(*spot).distinct().withColumn("__open", F.lit(True)), spot, "left")
    inside = (F.col("start_s") <= F.col("second")) & (F.col("second") <= F.col("end_s"))
    lit = tags.where("__open").join(states.select(*spot, "state", "start_s", "end_s"), spot).where(inside)
    state = lit.groupBy("id", "page", "recording", "second").agg(F.max(F.struct("start_s", "state"))["state"].alias("state"))
    shown = state.join(keyframes.select("page", "recording", "state", F.col("second").alias("__at"), "frame"), ["page", "recording", "state"]).where("__at <= second")
    frame = shown.groupBy("id").agg(F.max(F.struct("__at", "frame"))["frame"].alias("frame"))
    rows = tags.select("id", "page", "__open").join(state.select("id", "state"), "id", "left").join(frame, "id", "left")
    rows = rows.join(opened.select("page", "frame").distinct().withColumn("__seen", F.lit(True)), ["page", "frame"], "left")
    outcome = F.when(F.col("__open").isNull(), "no-window").when(F.col("state").isNull(), "no-state").when(F.col("frame").isNull(), "no-frame").when(F.col("__seen").isNull(), "not-opened").otherwise("ok")
    return rows.select("id", outcome.alias("outcome"), "state", "frame")
