"""Repair of conversation structure: the cheapest edits that bring the roles of a conversation into order.

Conversations are dealt out whole, sorted by turn, and streamed. A dynamic program over the states of the wanted pattern
`(s?(ua)+)?` takes each row once; its state (the cheapest audit of each pattern state, four at most) is carried
from one Arrow batch to the next. Of each row it keeps four bytes, one back pointer a state. A conversation is traced
back at its end while it is held. One that is longer than what a task holds is passed on in parts instead, rows and back
pointers together; these are written by Spark, read again from the last part to the first to be traced, and each part's
edits are applied where its rows are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termloom.tables import cut, small

SPACE = " \t\n\x0b\x0c\r"
ENDS = ".!?"
#: What a task holds of one conversation: rows, and characters of text.
HELD_ROWS, HELD_CHARS = 10_000, 16_000_000

#: States of the pattern: nothing yet, after the system turn, after a user's, after an assistant's turn.
START, SYSTEM, ASKED, ANSWERED = range(4)
#: The state after a turn that is inserted or given a new role, and the role it gets.
NEXT = {START: (ASKED, "user"), SYSTEM: (ASKED, "user"), ASKED: (ANSWERED, "assistant"), ANSWERED: (ASKED, "user")}
#: Inserts that end the pattern.
TO_END = {START: 0, SYSTEM: 2, ASKED: 1, ANSWERED: 0}
LETTERS = "DKR"


@dataclass(frozen=True)
class EditCosts:
    rerole: int = 1
    delete: int = 2
    insert: int = 5
    truncated: int = 5


def kept_state(state: int, initial: str) -> int | None:
    """The state after a row that keeps its role, where the pattern allows it."""
    if initial == "s":
        return SYSTEM if state == START else None
    after, role = NEXT[state]
    return after if role[0] == initial else None


class Chain:
    """The dynamic program of one conversation, row by row.

    `alive` holds (state, cost) of the cheapest audit that ends in each state, in ASCII order of these audits. All of
    them end in the edit of a row and tell of equally many rows, so none begins another, and their order settles that of
    whatever is appended. Steps depend on little (costs relative to the least, the row's kind), so they are remembered.
    """

    known: dict[tuple, tuple] = {}

    def __init__(self, costs: EditCosts) -> None:
        self.costs, self.alive, self.base, self.pointers = costs, ((START, 0),), 0, bytearray()

    def row(self, initial: str, must_go: bool, truncated: bool) -> None:
        key = (self.costs, self.alive, initial if initial in ("s", "u", "a") else "", must_go, truncated)
        if key not in Chain.known:
            if len(Chain.known) > 100_000:
                Chain.known.clear()
            Chain.known[key] = self._step(*key)
        self.alive, added, pointers = Chain.known[key]
        self.base += added
        self.pointers += pointers

    @staticmethod
    def _step(costs: EditCosts, alive: tuple, initial: str, must_go: bool, truncated: bool) -> tuple:
        best: dict[int, tuple] = {}
        for rank, (state, cost) in enumerate(alive):
            for inserts in range(3):
                if inserts:
                    state, cost = NEXT[state][0], cost + costs.insert
                options = [(state, costs.delete, "D")]
                if not must_go:
                    stays = costs.truncated * truncated
                    options.append((NEXT[state][0], costs.rerole + stays, "R"))
                    if (kept := kept_state(state, initial)) is not None:
                        options.append((kept, stays, "K"))
                for after, more, letter in options:
                    made = (cost + more, rank, "I" * inserts + letter)
                    best[after] = min(best.get(after, made), made)
        order = sorted(best, key=lambda s: best[s][1:])
        least = min(x[0] for x in best.values())
        pointers = bytes(best[s][1] | (len(best[s][2]) - 1) << 2 | LETTERS.index(best[s][2][-1]) << 4 for s in order)
        return tuple((s, best[s][0] - least) for s in order), least, pointers.ljust(4, b"\xff")

    def end(self) -> tuple[int, int, int]:
        """Cost, the audit's place among those alive, and inserts after the last row."""
        total, rank, inserts = min((cost + self.costs.insert * TO_END[state], rank, TO_END[state]) for rank, (state, cost) in enumerate(self.alive))
        return self.base + total, rank, inserts


def trace(pointers: bytes, rank: int) -> tuple[list[str], int]:
    """The letters of each row (inserts before it, then its own edit) that end at a place, and the place before the first row."""
    letters = []
    for at in range(len(pointers) - 4, -1, -4):
        x = pointers[at + rank]
        letters.append("I" * (x >> 2 & 3) + LETTERS[x >> 4 & 3])
        rank = x & 3
    return letters[::-1], rank


def apply(letters: list[str], roles: list[str], texts: list[str], state: int) -> tuple[list[str], list[str]]:
    """Roles and texts after the edits; letters may end with inserts after the last row."""
    out_roles, out_texts = [], []
    for i, edits in enumerate(letters):
        for edit in edits:
            if edit == "D":
                continue
            if edit == "K":
                role, state = roles[i], kept_state(state, roles[i][:1])
            else:
                state, role = NEXT[state]
            out_roles.append(role)
            out_texts.append("" if edit == "I" else texts[i])
    return out_roles, out_texts


COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
_PART = "conv string, part int, last boolean, " + ", ".join(f"{c} long" for c in COUNTS) + ", audit string, roles array<string>, texts array<string>, pointers binary, starts binary, rank int, inserts int"


class _Conversation:
    """What the stream carries of the conversation that it is in."""

    def __init__(self, conv: str | None, costs: EditCosts) -> None:
        self.conv, self.chain, self.part, self.chars = conv, Chain(costs), 0, 0
        self.counts = dict.fromkeys(COUNTS, 0)
        self.seen, self.roles, self.texts = set(), [], []
        self.before, self.turn, self.least, self.turns = None, None, None, 0
        self.starts = bytes([START])

    def row(self, turn: str | None, role: str, text: str, again: bool | None) -> None:
        counts, same = self.counts, (role, text)
        if turn is not None and turn != self.turn:
            self.least, self.turn, self.turns = int(turn) if self.least is None else self.least, turn, self.turns + 1
        bare = text.strip(SPACE)
        blank, repeated = not bare, (same in self.seen if again is None else again or self.before == same)
        cut_off = not blank and not repeated and bare[-1] not in ENDS
        counts["blank"] += blank
        counts["duplicate"] += repeated and not blank
        counts["truncated"] += cut_off
        if self.before is not None:
            counts["illegal"] += self.before[0][:1] + role[:1] not in ("su", "ua", "au")
        self.chain.row(role[:1], blank or repeated, cut_off)
        self.before = same
        if again is None:
            self.seen.add(same)
        self.roles.append(role)
        self.texts.append(text)
        self.chars += len(text)

    def spill(self) -> tuple:
        """A part of a conversation that goes on: its rows with their back pointers."""
        made = (self.conv, self.part, False, *[0] * len(COUNTS), None, self.roles, self.texts, bytes(self.chain.pointers), self.starts, None, None)
        self.part, self.chars, self.roles, self.texts = self.part + 1, 0, [], []
        self.chain.pointers, self.starts = bytearray(), bytes(s for s, _ in self.chain.alive)
        return made

    def end(self) -> tuple:
        cost, rank, inserts = self.chain.end()
        self.counts |= {"cost": cost, "gaps": int(self.turn) - self.least + 1 - self.turns if self.turns else 0}
        counts = [self.counts[c] for c in COUNTS]
        if self.part:
            return (self.conv, self.part, True, *counts, None, self.roles, self.texts, bytes(self.chain.pointers), self.starts, rank, inserts)
        letters, _ = trace(self.chain.pointers, rank)
        letters.append("I" * inserts)
        return (self.conv, 0, True, *counts, "".join(letters), *apply(letters, self.roles, self.texts, START), None, None, None, None)


@dataclass(frozen=True)
class Repaired:
    #: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, roles, texts (after the repair): a row each of the conversations that a task holds
    whole: DataFrame
    #: conv_id, gaps, ..., audit of the longer ones; None if there are none
    long: DataFrame | None
    #: conv_id, part, roles, texts (after the repair) of the longer ones, their parts numbered in order
    parts: DataFrame | None

    def report(self) -> DataFrame:
        """One row a conversation: what was wrong, and the edits."""
        found = self.whole.drop("roles", "texts")
        return found.unionByName(self.long) if self.long is not None else found

    def turns(self) -> DataFrame:
        """The repaired rows (conv_id, part, position, role, text); position counts inside a part."""
        held = self.whole.select("conv_id", F.lit(0).alias("part"), "roles", "texts")
        held = held.unionByName(self.parts) if self.parts is not None else held
        return held.select("conv_id", "part", F.posexplode(F.arrays_zip("roles", "texts")).alias("position", "x")).select("conv_id", "part", "position", F.col("x.roles").alias("role"), F.col("x.texts").alias("text"))

    def digests(self) -> DataFrame:
        """report() and repaired_sha256 of `role:text` of the repaired rows, joined by newlines; of nothing, that of an empty string."""
        line = F.zip_with("roles", "texts", lambda r, t: F.concat(r, F.lit(":"), t))
        found = self.whole.withColumn("repaired_sha256", F.sha2(F.array_join(line, "\n").cast("binary"), 256)).drop("roles", "texts")
        if self.long is None:
            return found
        kind = self.parts.schema["conv_id"].dataType
        ordered = self.parts.withColumn("conv_id", F.col("conv_id").cast("string")).repartition("conv_id").sortWithinPartitions("conv_id", "part")
        hashed = ordered.mapInPandas(_hashes, "conv_id string, repaired_sha256 string").withColumn("conv_id", F.col("conv_id").cast(kind))
        joined = self.long.join(hashed.withColumnRenamed("conv_id", "_id"), F.col("conv_id").eqNullSafe(F.col("_id"))).drop("_id")
        return found.unionByName(joined)


def _hashes(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One digest a conversation, whose parts come one after the other."""
    of, made, first = None, None, True
    for frame in frames:
        for conv, roles, texts in zip(frame["conv_id"], frame["roles"], frame["texts"]):
            if made is None or conv != of:
                if made is not None:
                    yield pd.DataFrame({"conv_id": [of], "repaired_sha256": [made.hexdigest()]})
                of, made, first = conv, hashlib.sha256(), True
            for role, text in zip(roles, texts):
                made.update((("" if first else "\n") + f"{role}:{text}").encode())
                first = False
    if made is not None:
        yield pd.DataFrame({"conv_id": [of], "repaired_sha256": [made.hexdigest()]})


def repair_conversations(rows: DataFrame, costs: EditCosts = EditCosts(), gone: Column | None = None, held_rows: int = HELD_ROWS, held_chars: int = HELD_CHARS) -> Repaired:
    """Faults of each conversation of rows (conv_id, turn, role, text; other columns are ignored) and its cheapest repair.

    A row's first fault counts: blank (no character but white space), duplicate (role and text as of an earlier row),
    truncated (its last character that is no white space is none of `.!?`). Edits in the audit: K keeps, R gives the
    role user or assistant, D deletes (as blank and duplicate rows must be), I inserts a turn without text. The audit is
    the cheapest that leaves the initials of the roles as `(s?(ua)+)?`; of several, the least in ASCII.

    Rows are taken by turn, nulls first; rows of one turn by role and text, so equal rows are neighbours. Null roles and
    texts count as one space. A role of another initial, or of none, is never kept. Rows where `gone` is true take no part, but
    their conversation comes. Rows of a null conv_id are one conversation. gaps counts the turns missing between the
    least and the greatest. An empty table gives an empty result.

    Conversations of over held_rows rows or held_chars characters go in parts; whether a row of theirs is a duplicate is
    told by joining each repeated (role, text) with its first turn, so that no task holds what a long one has seen.
    """
    kind = rows.schema["conv_id"].dataType
    some = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    base = rows.select(F.col("conv_id").cast("string").alias("conv"), F.col("turn").cast("long").alias("turn"), some("role"), some("text"), F.coalesce(gone, F.lit(False)).alias("gone") if gone is not None else F.lit(False).alias("gone"))
    sizes = base.groupBy("conv").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))
    giants = cut(sizes.filter((F.col("n") > held_rows) | (F.col("chars") > held_chars)).select(F.col("conv").alias("giant"), F.lit(True).alias("is_giant")), "repair-long")
    several = giants.limit(1).count() > 0
    stream = base.withColumn("again", F.lit(None).cast("boolean"))
    if several:
        met = base.join(small(giants), F.col("conv").eqNullSafe(F.col("giant")), "left")
        few, many = met.filter("is_giant IS NULL"), met.filter("is_giant").withColumn("digest", F.sha2(F.col("text").cast("binary"), 256))
        firsts = many.filter("NOT gone").groupBy("conv", "role", "digest").agg(F.count(F.lit(1)).alias("n"), F.max(F.col("turn").isNull()).alias("from_null"), F.min("turn").alias("from")).filter("n > 1")
        firsts = firsts.select(*[F.col(c).alias(f"f_{c}") for c in firsts.columns])
        at = F.col("conv").eqNullSafe(F.col("f_conv")) & (F.col("role") == F.col("f_role")) & (F.col("digest") == F.col("f_digest"))
        later = F.coalesce(F.when(F.col("f_from_null"), F.col("turn").isNotNull()).otherwise(F.col("turn") > F.col("f_from")), F.lit(False))
        columns = ["conv", "turn", "role", "text", "gone", "again"]
        stream = few.withColumn("again", F.lit(None).cast("boolean")).select(*columns).unionByName(many.join(firsts, at, "left").withColumn("again", later).select(*columns))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, names = None, [x.split()[0] for x in _PART.split(", ")]
        for frame in frames:
            made = []
            for conv, turn, role, text, away, again in zip(*(frame[c] for c in ("conv", "turn", "role", "text", "gone", "again"))):
                if now is None or now.conv != conv:
                    if now is not None:
                        made.append(now.end())
                    now = _Conversation(conv, costs)
                if away:
                    continue
                if again is not None and now.texts and (len(now.texts) >= held_rows or now.chars >= held_chars):
                    made.append(now.spill())
                now.row(turn, role, text, again)
            if made:
                yield pd.DataFrame(made, columns=names)
        if now is not None:
            yield pd.DataFrame([now.end()], columns=names)

    ordered = stream.repartition("conv").sortWithinPartitions("conv", "turn", "role", "text")
    parts = ordered.withColumn("turn", F.col("turn").cast("string")).mapInPandas(run, _PART)
    conv_id = F.col("conv").cast(kind).alias("conv_id")
    if several:
        parts = cut(parts, "repair-parts")
    whole = parts.filter("audit IS NOT NULL").select(conv_id, *COUNTS, "audit", "roles", "texts")
    if not several:
        return Repaired(whole, None, None)

    def back(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """From a conversation's last part to its first: letters of each row, and the state before the part."""
        of, rank, within = None, 0, False
        for frame in frames:
            made = []
            for conv, part, pointers, starts, end, inserts, last in zip(*(frame[c] for c in ("conv", "part", "pointers", "starts", "rank", "inserts", "last"))):
                if last:
                    of, rank, within = conv, int(end), True
                assert within and of == conv, "parts of a conversation come together"
                letters, rank = trace(pointers, rank)
                if last and inserts:
                    letters.append("I" * int(inserts))
                made.append((conv, part, letters, starts[rank]))
            yield pd.DataFrame(made, columns=["conv", "part", "letters", "state"])

    def mend(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for conv, part, roles, texts, letters, state in zip(*(frame[c] for c in ("conv", "part", "roles", "texts", "letters", "state"))):
                fixed = apply(list(letters), list(roles), list(texts), int(state))
                yield pd.DataFrame([(conv, part, *fixed)], columns=["conv", "part", "roles", "texts"])

    spilled = parts.filter("audit IS NULL")
    light = spilled.select("conv", "part", "pointers", "starts", "rank", "inserts", "last").repartition("conv").sortWithinPartitions("conv", F.col("part").desc())
    traced = cut(light.mapInPandas(back, "conv string, part int, letters array<string>, state int"), "repair-edits")
    raw = spilled.select(F.col("conv").alias("r_conv"), F.col("part").alias("r_part"), "roles", "texts")
    mended = raw.join(traced, F.col("conv").eqNullSafe(F.col("r_conv")) & (F.col("part") == F.col("r_part"))).select("conv", "part", "roles", "texts", "letters", "state").mapInPandas(mend, "conv string, part int, roles array<string>, texts array<string>")
    audits = traced.groupBy(F.col("conv").alias("a_conv")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("part", F.array_join("letters", "").alias("x")))), lambda s: s["x"]), "").alias("audit"))
    long = spilled.filter("last").drop("audit").join(audits, F.col("conv").eqNullSafe(F.col("a_conv"))).select(conv_id, *COUNTS, "audit")
    return Repaired(whole, long, mended.select(conv_id, "part", "roles", "texts"))


def damage(rows: DataFrame) -> DataFrame:
    """rows (conv_id, turn, role, text) with faults by crc32(`conv_id:turn`) modulo 20; `gone` marks dropped rows. Nulls of role, text and in that key count as one space."""
    some = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.pmod(F.crc32(F.concat(some("conv_id"), F.lit(":"), some("turn")).cast("binary")), F.lit(20))
    text = F.when(fault <= 1, F.lit("")).when(fault == 2, F.translate(some("text"), ENDS, "")).otherwise(some("text"))
    role = F.when(fault == 4, F.lit("user")).otherwise(some("role"))
    made = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (fault == 0).alias("gone"), F.explode(F.when(fault == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"))
    return made.drop("copy")
