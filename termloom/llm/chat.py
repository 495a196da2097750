"""Chat formatting with DataFrame functions alone: conversations become one marked-up string each, with a loss mask.

The turns of a conversation are collected as structs and sorted; adjacent turns of a role are merged into one block
by array functions; blocks are concatenated between the template's marks. Texts and roles are escaped so that no
mark or other control string is left in them, and can be read back.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termloom.llm.common import free_names
from termloom.tables import cut, small

#: A conversation of over so many rows or bytes is sorted and merged in chunks first.
WHOLE_ROWS, WHOLE_BYTES = 2_000, 8_000_000


@dataclass(frozen=True)
class ChatTemplate:
    """`start` role `sep` text (`turn` text)* `end` for each block; `others` are further control strings that no text may hold.

    A backslash in a text is doubled, and a backslash and a colon come after the first character of each control string.
    """

    start: str = "<|im_start|>"
    sep: str = "<|im_sep|>"
    turn: str = "<|im_turn|>"
    end: str = "<|im_end|>"
    others: tuple[str, ...] = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|endoftext|>")
    #: The role whose texts the loss is taken on.
    learned: str = "assistant"

    def __post_init__(self) -> None:
        marks, control = {self.start, self.sep, self.turn, self.end}, self.control
        if len(marks) < 4 or any(len(c) < 2 or "\\" in c or "\n" in c or c[1] == ":" for c in control):
            raise ValueError("marks must differ; control strings have two characters or more, no backslash, no newline and no colon as the second")
        for c in control:
            for i in range(1, len(c)):
                if any(m != c and (m.startswith(c[i:]) or m.endswith(c[:i]) or c[i:].startswith(m)) for m in marks):
                    raise ValueError(f"a text beside a mark could form {c}")

    @property
    def control(self) -> list[str]:
        return [self.start, self.sep, self.turn, self.end, *self.others]

    def escape(self, text: Column) -> Column:
        by_first: dict[str, list[str]] = {}
        for c in self.control:
            by_first.setdefault(c[0], []).append(re.escape(c[1:]))
        after = "|".join(f"(?<={re.escape(first)})(?={'|'.join(rest)})" for first, rest in by_first.items())
        firsts = "".join(re.escape(first) for first in by_first)
        return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), f"[{firsts}](?:{after})", r"$0\\:")

    def unescape(self, text: Column) -> Column:
        return F.regexp_replace(text, r"\\(?:(\\)|:)", "$1")


def _merged(blocks: Column) -> tuple[Column, Column]:
    """Where blocks (role, texts) of another role than the one before begin, and a function of that column that merges the blocks from one such place to the next."""
    begin = F.filter(F.sequence(F.lit(0), F.size(blocks) - 1), lambda i: (i == 0) | (F.get(blocks, i)["role"] != F.get(blocks, i - 1)["role"]))

    def merge(begins: Column) -> Column:
        upto = lambda j: F.coalesce(F.get(begins, j + 1), F.size(blocks))
        texts = lambda i, j: F.flatten(F.transform(F.slice(blocks, i + 1, upto(j) - i), lambda b: b["texts"]))
        return F.transform(begins, lambda i, j: F.struct(F.get(blocks, i)["role"].alias("role"), texts(i, j).alias("texts")))

    return begin, merge


def _merge(df: DataFrame, column: str) -> DataFrame:
    begin, merge = _merged(F.col(column))
    return df.withColumn("begins", begin).withColumn(column, merge(F.col("begins"))).drop("begins")


def format_chats(rows: DataFrame, template: ChatTemplate = ChatTemplate(), whole_rows: int = WHOLE_ROWS, whole_bytes: int = WHOLE_BYTES) -> DataFrame:
    """(conv_id, segments, formatted) of rows (conv_id, turn, role, text; other columns are ignored), one row a conversation.

    formatted is the concatenation of segments (text, loss); `loss` marks those that the loss is taken on, the texts
    of the learned role. Rows are taken by turn, nulls first; rows of one turn by role and text, repeated rows as
    often as they come. A null role or text is an empty one; a null conv_id is a conversation of its own. An empty table gives an
    empty result. A formatted conversation must fit into one string (2 GB).

    Long conversations, of over whole_rows rows or whole_bytes bytes, are dealt out by ranges of their order; each chunk is
    sorted, escaped and merged on its own, and one row takes their blocks together.
    """
    some = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    base = rows.select("conv_id", "turn", some("role"), some("text"))
    long = base.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("bytes")).filter((F.col("n") > whole_rows) | (F.col("bytes") > whole_bytes))
    long = cut(long.select(F.col("conv_id").alias("long_id"), F.lit(True).alias("is_long")), "chat-long")
    collected = F.sort_array(F.collect_list(F.struct("turn", "role", "text")))
    single = lambda turns: F.transform(turns, lambda t: F.struct(t["role"].alias("role"), F.array(template.escape(t["text"])).alias("texts")))
    if long.limit(1).count() == 0:
        blocks = _merge(base.groupBy("conv_id").agg(collected.alias("turns")).select("conv_id", single(F.col("turns")).alias("blocks")), "blocks")
    else:
        met = base.join(small(long), F.col("conv_id").eqNullSafe(F.col("long_id")), "left")
        blocks = _merge(met.filter("is_long IS NULL").groupBy("conv_id").agg(collected.alias("turns")).select("conv_id", single(F.col("turns")).alias("blocks")), "blocks")
        parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        dealt = met.filter("is_long").select("conv_id", "turn", "role", "text").repartitionByRange(parts, "conv_id", "turn", "role", F.substring("text", 1, 64))
        chunks = dealt.withColumn("chunk", F.spark_partition_id()).groupBy("conv_id", "chunk").agg(collected.alias("turns")).select("conv_id", "chunk", single(F.col("turns")).alias("blocks"))
        chunks = _merge(chunks, "blocks").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("chunk", "blocks"))).alias("chunks"))
        blocks = blocks.unionByName(_merge(chunks.select("conv_id", F.flatten(F.transform("chunks", lambda c: c["blocks"])).alias("blocks")), "blocks"))

    piece = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    no = F.lit(False)

    def segments(b: Column) -> Column:
        head = F.concat(F.lit(template.start), template.escape(b["role"]), F.lit(template.sep))
        texts = F.transform(b["texts"], lambda t, i: F.array(piece(F.when(i == 0, head).otherwise(F.lit(template.turn)), no), piece(t, b["role"] == template.learned)))
        return F.concat(F.flatten(texts), F.array(piece(F.lit(template.end), no)))

    made = blocks.select("conv_id", F.flatten(F.transform("blocks", segments)).alias("segments"))
    return made.withColumn("formatted", F.array_join(F.col("segments.text"), ""))


def read_chats(chats: DataFrame, template: ChatTemplate = ChatTemplate()) -> DataFrame:
    """chats with `turns` (role, text) read back from `formatted`, and `learned`, the texts under the loss mask without anything between them. Other columns stay, but for those of these two names."""
    quoted = lambda x: re.sub(r"([^\w\s])", r"\\\1", x)
    (parsed,) = free_names(chats, "parsed")
    block = lambda b: F.struct(
        template.unescape(F.substring_index(b, template.sep, 1)).alias("role"),
        F.split(F.get(F.split(F.get(F.split(b, quoted(template.sep)), F.lit(1)), quoted(template.end)), F.lit(0)), quoted(template.turn)).alias("texts"),
    )
    # what stands before the first mark is empty
    found = chats.withColumn(parsed, F.transform(F.filter(F.split("formatted", quoted(template.start)), lambda b, i: i > 0), block))
    turns = F.flatten(F.transform(F.col(parsed), lambda b: F.transform(b["texts"], lambda t: F.struct(b["role"].alias("role"), template.unescape(t).alias("text")))))
    learned = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: template.unescape(s["text"])), "")
    return found.withColumns({"turns": turns, "learned": learned}).drop(parsed)
