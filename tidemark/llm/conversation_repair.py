"""Repair of the turn structure of conversations by a rank-compressed dynamic program.

A repaired conversation has the role initials ``(s?(ua)+)?``.  Each row may be kept, given another role or deleted, and turns
without text may be put in anywhere; the cheapest edits win, and of equally cheap ones those whose letters (D, I, K, R) are
least in ASCII.  A layer of the program is one row.  Its moves are macro edits, a run of insertions and what becomes of the
row, written as D, ID, IID, IIK, IIR, IK, IR, K or R: no code begins another, so two paths of equally many rows compare as
their code sequences do.  Hence no audit string is carried: a state of a layer (start, system, user, assistant) holds its
cost, the rank of its path among those of the layer, and a pointer (state before, code).  A layer's ranks follow from the
last layer's rank and the code; letters, roles and texts are put together afterwards, backwards along the pointers.

Rows are sorted by conversation and turn over all tasks and cut into blocks of at most BLOCK_ROWS rows and some
BLOCK_BYTES of text, so a long conversation is dealt to many tasks.  Layers run over all blocks of a batch at once.  A
block of a conversation that goes on elsewhere is run from each of the four states; what that gives (16 costs and ranks a
block) is chained in order of the blocks, and the block is run again from the state in which the chain enters it.  One task
holds a block of rows, or the 16 numbers of each block of one conversation; the SHA-256 of a conversation's text, which
can't be had in parts, is taken by a task that streams its blocks.

Shuffled: the rows once to collapse equal ones, narrow rows to find where a text stands first, the rows once to sort them, and of
conversations in several blocks what they chain and hash.  Equal rows (conversation, turn, role, text) are one with a count until they
are sorted, and texts are told apart by the SHA-256 of role and text.

Defined results: nulls are one space in the hash that picks the damage and as role and text, so a null text is blank; a null conv_id is
one conversation; a null turn stands first and is in no gap; rows of one turn stand in order of role, then of their digest, copies side by
side; an empty table gives no rows; extra columns are ignored.  Very long texts are held whole, one block at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.runtime import materialize, small_batches

BLOCK_ROWS, BLOCK_BYTES = 1 << 15, 1 << 20
#: Rows that a task sorts.
TASK_ROWS = 1 << 20
#: Blocks that are met at once.
BATCH = 64
BLANKS = " \t\n\x0b\x0c\r"

START, SYSTEM, USER, ASSISTANT = range(4)
#: Costs of edits.
REROLE, DELETE, INSERT, CUT = 2, 3, 2, 1
#: Macro edits in the order of their letters.
MACROS = ("D", "ID", "IID", "IIK", "IIR", "IK", "IR", "K", "R")
#: The next state of each state when a user's or assistant's turn follows, as the pattern has it.
NEXT = (USER, USER, ASSISTANT, USER)
#: Insertions that end the pattern from each state.
CLOSING = (0, 2, 1, 0)
NAMES = {USER: "user", ASSISTANT: "assistant"}
#: Faults in a row's code, beside four times its role's place in INITIALS (3: another).
SOUND, BLANK, DUPLICATE, TRUNCATED = range(4)
INITIALS = "sua"
FAR = 1 << 40


def moves() -> tuple[np.ndarray, np.ndarray]:
    """target[code, state, macro] and cost[code, state, macro] of a row's macro edits; cost FAR where there is none."""
    target, cost = np.zeros((16, 4, len(MACROS)), np.int64), np.full((16, 4, len(MACROS)), FAR)
    for code in range(16):
        initial, fault = divmod(code, 4)
        for state in range(4):
            for m, letters in enumerate(MACROS):
                at = state
                for _ in letters[:-1]:
                    at = NEXT[at]
                spent, edit = INSERT * (len(letters) - 1), letters[-1]
                if edit == "D":
                    target[code, state, m], cost[code, state, m] = at, spent + DELETE
                    continue
                if fault in (BLANK, DUPLICATE):
                    continue
                spent += CUT * (fault == TRUNCATED)
                if edit == "R":
                    target[code, state, m], cost[code, state, m] = NEXT[at], spent + REROLE
                elif (initial == 0 and at == START) or (initial < 3 and initial + 1 == NEXT[at]):
                    target[code, state, m], cost[code, state, m] = (SYSTEM if initial == 0 else NEXT[at]), spent
    return target, cost


TARGET, COST = moves()


def run_layers(codes: list[np.ndarray], entries: list[int], pointers: bool = True) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], np.ndarray]:
    """Lanes of row codes, each begun in a state: cost and rank of its four last states, the pointers of each layer, and the lanes' order.

    Longer lanes come first, so those of a layer are the first ones.
    """
    size = np.array([len(c) for c in codes])
    order = np.argsort(-size, kind="stable")
    cost, rank = np.full((len(codes), 4), FAR), np.zeros((len(codes), 4), np.int64)
    cost[np.arange(len(codes)), np.array(entries)[order]] = 0
    rows = np.zeros((len(codes), max(size, default=0)), np.uint8)
    for k, lane in enumerate(order):
        rows[k, : size[lane]] = codes[lane]
    layers, index = [], np.arange(4 * len(MACROS))
    for t in range(rows.shape[1]):
        n = int(np.searchsorted(-size[order], -t, "left"))
        code = rows[:n, t]
        key = ((cost[:n, :, None] + COST[code]) << 6) | (rank[:n, :, None] << 4) | np.arange(len(MACROS))
        key, target = key.reshape(n, -1), TARGET[code].reshape(n, -1)
        best, back = np.empty((n, 4), np.int64), np.empty((n, 4), np.uint8)
        for state in range(4):
            here = np.where(target == state, key, FAR << 6)
            at = here.argmin(1)
            best[:, state] = here[np.arange(n), at]
            back[:, state] = index[at] // len(MACROS) * 16 + index[at] % len(MACROS)
        cost[:n] = np.minimum(best >> 6, FAR)
        path = np.where(cost[:n] < FAR, best & 63, 64)
        rank[:n] = (path[:, None, :] < path[:, :, None]).sum(2)
        rank[:n][cost[:n] >= FAR] = 0
        if pointers:
            layers.append(back)
    return cost, rank, layers, order


def ending(cost: np.ndarray, rank: np.ndarray) -> tuple[int, int]:
    """The state in which the cheapest path ends, least in letters, and its cost with the closing turns."""
    whole = cost + INSERT * np.array(CLOSING)
    state = min(range(4), key=lambda s: (whole[s], rank[s]))
    return state, int(whole[state])


def reconstruct(layers: list[np.ndarray], lane: int, size: int, state: int) -> list[tuple[int, str]]:
    """(state before, macro edit) of each row of a lane that ends in a state."""
    out = []
    for t in range(size - 1, -1, -1):
        state, m = divmod(int(layers[t][lane, state]), 16)
        out.append((state, MACROS[m]))
    return out[::-1]


def edited(path: list[tuple[int, str]], roles: list[str], texts: list[str], close: int | None) -> tuple[str, list[tuple[str, str, str]]]:
    """The letters, and (letter, role, text) of the turns that stay; close: the state whose closing turns follow."""
    letters, turns = [], []
    for (state, macro), role, text in zip(path, roles, texts, strict=True):
        letters.append(macro)
        for _ in macro[:-1]:
            state = NEXT[state]
            turns.append(("I", NAMES[state], ""))
        if macro[-1] == "K":
            turns.append(("K", role, text))
        elif macro[-1] == "R":
            turns.append(("R", NAMES[NEXT[state]], text))
    for _ in range(0 if close is None else CLOSING[close]):
        close = NEXT[close]
        letters.append("I")
        turns.append(("I", NAMES[close], ""))
    return "".join(letters), turns


def as_text(turns: list[tuple[str, str, str]]) -> str:
    return "\n".join(f"{role}:{text}" for _, role, text in turns)


def conv_key() -> Column:
    return F.coalesce(F.col("conv_id").cast("string"), F.lit(" "))


def damaged(conversations: DataFrame) -> DataFrame:
    """conv, turn, role, text of the rows after the damage that their ids pick."""
    text_of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    pick = F.crc32(F.concat_ws(":", conv_key(), text_of("turn")).cast("binary")) % 20
    rows = conversations.select(conv_key().alias("conv"), F.col("turn").cast("long").alias("turn"), text_of("role").alias("role"), text_of("text").alias("text"), pick.alias("pick")).where("pick <> 0")
    text = F.when(F.col("pick") == 1, "").when(F.col("pick") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = rows.select("conv", "turn", F.when(F.col("pick") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.when(F.col("pick") == 3, 2).otherwise(1).alias("n"))
    return rows.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("n")))).drop("n", "__copy")


def coded(rows: DataFrame) -> DataFrame:
    """conv, turn, role, text, copy and the code of each row: four times its role's place, and its first fault."""
    digest = F.sha2(F.concat_ws("\n", F.base64(F.col("role").cast("binary")), "text").cast("binary"), 256)
    once = materialize(rows.withColumn("d", digest).groupBy("conv", "turn", "role", "d").agg(F.min("text").alias("text"), F.count("*").alias("n")), "turns")
    place = F.struct(F.col("turn").isNotNull().alias("told"), F.col("turn").alias("turn"))  # nulls first
    first = once.groupBy("conv", "d").agg(F.min(place).alias("first"))
    each = once.join(first, ["conv", "d"]).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    said = F.rtrim(F.col("text"), F.lit(BLANKS))
    fault = (
        F.when(said == "", BLANK).when((F.col("copy") > 1) | (place > F.col("first")), DUPLICATE).when(~F.substring(said, -1, 1).isin(".", "!", "?"), TRUNCATED).otherwise(SOUND)
    )
    initial = F.position(F.substring("role", 1, 1), F.lit(INITIALS))  # an empty role is found at once, so it is asked for
    initial = F.when((F.col("role") == "") | (initial == 0), 3).otherwise(initial - 1)
    return each.select("conv", "turn", "role", "d", "copy", "text", (4 * initial + fault).cast("int").alias("code"))


BLOCK = "conv string, block long, edge boolean, codes binary, roles array<string>, texts array<string>, blank long, duplicate long, truncated long, illegal long"


def illegal_pairs(codes: np.ndarray) -> int:
    """Neighbours whose initials are not su, ua or au."""
    a, b = codes[:-1] >> 2, codes[1:] >> 2
    return int(len(a) - (((a == 0) & (b == 1)) | ((a == 1) & (b == 2)) | ((a == 2) & (b == 1))).sum())


def blocks(rows: DataFrame) -> DataFrame:
    """The rows sorted and cut: consecutive rows of one conversation in each block, in order of ``block``; edge: others may follow or precede it."""
    spark = rows.sparkSession
    rows = materialize(rows, "coded")
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // TASK_ROWS))
    keys = ["conv", F.col("turn").asc_nulls_first(), "role", "d", "copy"]
    inner = rows.repartitionByRange(n, *keys).sortWithinPartitions(*keys).select("conv", "role", "text", "code", F.spark_partition_id().cast("long").alias("task"))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[list] = [[], [], []]
        conv, made, size = None, 0, 0
        first, parts = True, False  # of the conversation at hand: it may have begun in the task before; a block of it is out

        def block(edge: bool) -> pd.DataFrame:
            codes = np.array(held[0], np.uint8)
            faults = np.bincount(codes % 4, minlength=4).tolist()
            row = (conv, (task << 32) + made, edge, codes.tobytes(), held[1], held[2], faults[BLANK], faults[DUPLICATE], faults[TRUNCATED], illegal_pairs(codes))
            return pd.DataFrame([row], columns=[c.split()[0] for c in BLOCK.split(", ")])

        for batch in batches:
            out = []
            for name, role, text, code, task in batch.itertuples(index=False, name=None):
                goes_on = name == conv
                if held[0] and (not goes_on or len(held[0]) == BLOCK_ROWS or size >= BLOCK_BYTES):
                    out.append(block(goes_on or first or parts))
                    held, size, made = [[], [], []], 0, made + 1
                    first, parts = first and goes_on, goes_on
                conv = name
                for column, value in zip(held, (code, role, text), strict=True):
                    column.append(value)
                size += len(text)
            if out:
                yield pd.concat(out, ignore_index=True)
        if held[0]:
            yield block(True)

    return materialize(small_batches(inner).mapInPandas(cut, BLOCK), "blocks")


def chained(cut: DataFrame) -> DataFrame:
    """conv, block, entry, leave, closes, cost and illegal of the blocks of conversations that may go on elsewhere."""

    def summed_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            codes = [np.frombuffer(c, np.uint8) for c in batch["codes"]]
            cost, rank, _, order = run_layers([c for c in codes for _ in range(4)], list(range(4)) * len(codes), pointers=False)
            back = np.argsort(order)
            yield pd.DataFrame(
                {"conv": batch["conv"], "block": batch["block"], "first": [int(c[0]) for c in codes], "last": [int(c[-1]) for c in codes],
                 "cost": list(cost[back].reshape(-1, 16)), "rank": list(rank[back].reshape(-1, 16))}
            )

    def chain(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("block", ignore_index=True)
        cost, rank, steps, odd = np.array([0, FAR, FAR, FAR]), np.zeros(4, np.int64), [], [0] * len(rows)
        for k in range(len(rows)):
            there, order = np.array(rows["cost"][k]).reshape(4, 4), np.array(rows["rank"][k]).reshape(4, 4)
            whole = np.minimum(cost[:, None] + there, FAR)
            back = ((whole << 2) | rank[:, None]).argmin(0)
            path = np.where(whole[back, range(4)] < FAR, rank[back] * 4 + order[back, range(4)], 16)
            cost, rank = whole[back, range(4)], (path[None, :] < path[:, None]).sum(1)
            rank[cost >= FAR] = 0
            steps.append(back)
            if k:
                odd[k] = illegal_pairs(np.array([rows["last"][k - 1], rows["first"][k]]))
        leave, total = ending(cost, rank)
        out = []
        for k in range(len(rows) - 1, -1, -1):
            entry = int(steps[k][leave])
            out.append((rows["conv"][k], int(rows["block"][k]), entry, leave, k == len(rows) - 1, total if k == 0 else 0, odd[k]))
            leave = entry
        return pd.DataFrame(out, columns=["conv", "block", "entry", "leave", "closes", "cost", "odd"])

    parts = small_batches(cut.where("edge").select("conv", "block", "codes"), BATCH).mapInPandas(summed_up, "conv string, block long, first int, last int, cost array<long>, rank array<long>")
    return materialize(parts.groupBy("conv").applyInPandas(chain, "conv string, block long, entry int, leave int, closes boolean, cost long, odd long"), "chained")


def repaired(cut: DataFrame) -> DataFrame:
    """The blocks with audit (their letters), turns (letter, role, text of what stays), cost and the faults; the whole cost is with a conversation's first block."""
    told = chained(cut)

    def rerun(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            codes, known = [np.frombuffer(c, np.uint8) for c in batch["codes"]], batch["entry"].notna()
            cost, rank, layers, order = run_layers(codes, batch["entry"].fillna(START).astype(int).to_list())
            audits, turns, costs = [], [], []
            for k, lane in enumerate(np.argsort(order)):
                leave, total = (int(batch["leave"][k]), int(batch["cost"][k])) if known[k] else ending(cost[lane], rank[lane])
                path = reconstruct(layers, lane, len(codes[k]), leave)
                audit, stay = edited(path, batch["roles"][k], batch["texts"][k], leave if not known[k] or batch["closes"][k] else None)
                audits.append(audit)
                turns.append([{"edit": e, "role": r, "text": t} for e, r, t in stay])
                costs.append(total)
            yield batch[["conv", "block", "edge", "blank", "duplicate", "truncated"]].assign(illegal=batch["illegal"] + batch["odd"].fillna(0).astype("int64"), cost=costs, audit=audits, turns=turns)

    both = cut.join(told, ["conv", "block"], "left")
    schema = "conv string, block long, edge boolean, blank long, duplicate long, truncated long, illegal long, cost long, audit string, turns array<struct<edit string, role string, text string>>"
    return materialize(small_batches(both, BATCH).mapInPandas(rerun, schema), "repaired")


def repair(rows: DataFrame) -> DataFrame:
    """rows: conv, turn, role, text.  A row for each turn that stays: conv, place (ascending within a conversation, not dense), edit, role, text."""
    out = repaired(blocks(coded(rows))).select("conv", "block", F.posexplode("turns").alias("at", "turn"))
    return out.select("conv", F.struct("block", "at").alias("place"), "turn.edit", "turn.role", "turn.text")


def digest(conversations: DataFrame) -> DataFrame:
    """The contract's columns for each conversation of the table, after its damage."""
    conversations = small_batches(conversations, tidy=True)
    rows = materialize(damaged(conversations), "damaged")
    done = repaired(blocks(coded(rows)))
    line = F.concat_ws("\n", F.transform("turns", lambda t: F.concat(t["role"], F.lit(":"), t["text"])))
    whole = done.where("not edge").select("conv", "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.sha2(line.cast("binary"), 256).alias("repaired_sha256"))
    parts = done.where("edge").select("conv", "block", "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.size("turns").alias("lines"), line.alias("text"))

    def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["blank", "duplicate", "truncated", "illegal", "cost"]
        conv, sums, letters, sha, lines = None, [0] * 5, [], hashlib.sha256(), 0
        row = lambda: pd.DataFrame([(conv, *sums, "".join(letters), sha.hexdigest())], columns=["conv", *names, "audit", "repaired_sha256"])
        for batch in batches:
            for name, _, *counts, audit, n, text in batch.itertuples(index=False, name=None):
                if name != conv:
                    if conv is not None:
                        yield row()
                    conv, sums, letters, sha, lines = name, [0] * 5, [], hashlib.sha256(), 0
                sums = [int(a + b) for a, b in zip(sums, counts, strict=True)]
                letters.append(audit)
                if n:
                    sha.update((b"\n" if lines else b"") + text.encode("utf-8", "surrogatepass"))
                    lines += n
        if conv is not None:
            yield row()

    ordered = small_batches(parts.repartition("conv").sortWithinPartitions("conv", "block"), BATCH)
    streamed = ordered.mapInPandas(stream, "conv string, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string")
    turns = rows.groupBy("conv", "turn").agg(F.lit(1).alias("one")).groupBy("conv").agg((F.max("turn") - F.min("turn") + 1 - F.count("turn")).alias("gaps"))
    found = turns.join(whole.unionByName(streamed), "conv")
    names = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), conv_key().alias("conv")).distinct()
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).cast("long").alias(c)
    return names.join(found, "conv", "left").select(
        "conv_id", *[zero(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")], F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"),
    )
