"""Conversation repair and chat formatting: brute force, planted faults, long conversations in parts, odd tables."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from termloom.llm import queries as Q
from termloom.llm.chat import ChatTemplate, format_chats, read_chats
from termloom.llm.repair import Chain, EditCosts, repair_conversations, trace

DATA = "/root/testdata/sf0.001"
SPACE = " \t\n\x0b\x0c\r"
SCHEMA = "conv_id long, turn long, role string, text string"


def brute_audits(rows: list[tuple[str, str]]) -> tuple[int, str, list[tuple[str, str]]]:
    """Every string of edits with at most two inserts in all places, by cost and then ASCII."""
    seen, kinds = set(), []
    for role, text in rows:
        blank = not text.strip(SPACE)
        kinds.append((blank or (role, text) in seen, not blank and text.strip(SPACE)[-1] not in ".!?"))
        seen.add((role, text))
    best = None

    def go(i: int, cost: int, audit: str, out: list, inserted: int) -> None:
        nonlocal best
        if best is not None and cost > best[0]:
            return
        if i == len(rows):
            if re.fullmatch("(s?(ua)+)?", "".join(r[:1] for r, _ in out)) and (best is None or (cost, audit) < best[:2]):
                best = (cost, audit, list(out))
        else:
            (role, text), (must, cut) = rows[i], kinds[i]
            go(i + 1, cost + 2, audit + "D", out, inserted)
            if not must:
                if role[:1] in ("s", "u", "a"):
                    go(i + 1, cost + 5 * cut, audit + "K", [*out, (role, text)], inserted)
                for new in ("user", "assistant"):
                    go(i + 1, cost + 1 + 5 * cut, audit + "R", [*out, (new, text)], inserted)
        if inserted < 2:
            for new in ("user", "assistant"):
                go(i, cost + 5, audit + "I", [*out, (new, "")], inserted + 1)

    go(0, 0, "", [], 0)
    return best


def faults(rows: list[tuple]) -> tuple[int, int, int, int, int]:
    seen, blank, duplicate, truncated = set(), 0, 0, 0
    for _, role, text in rows:
        bare = text.strip(SPACE)
        if not bare:
            blank += 1
        elif (role, text) in seen:
            duplicate += 1
        elif bare[-1] not in ".!?":
            truncated += 1
        seen.add((role, text))
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    turns = [t for t, _, _ in rows if t is not None]
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0), blank, duplicate, truncated, illegal


def expected(rows: list[tuple]) -> dict:
    """conv -> (gaps, blank, duplicate, truncated, illegal, cost, audit, sha) of rows (conv, turn, role, text) without damage."""
    by = {}
    for conv, turn, role, text in rows:
        by.setdefault(conv, []).append((turn, " " if role is None else role, " " if text is None else text))
    out = {}
    for conv, x in by.items():
        x.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        cost, audit, fixed = brute_audits([(r, t) for _, r, t in x])
        out[conv] = (*faults(x), cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in fixed).encode()).hexdigest())
    return out


def got(fixed) -> dict:  # noqa: ANN001
    rows = fixed.digests().collect()
    assert len({r.conv_id for r in rows}) == len(rows)
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in rows}


def some_rows(seed: int, conversations: int) -> list[tuple]:
    pick = random.Random(seed)
    rows = []
    for conv in [*range(conversations), None]:
        for turn in range(pick.randrange(7)):
            role = pick.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None, "sage"])
            text = pick.choice(["Yes.", "No!", "what", " \t\n", "", "Well? ", None, " ", "Öl.", f"{pick.random()}."])
            rows.append((conv, pick.choice([turn, turn, turn * 2, None]), role, text))
    return rows + pick.choices(rows, k=5)


@pytest.mark.parametrize("held", [10_000, 2])
def test_repair_against_every_string_of_edits(spark, held: int) -> None:  # noqa: ANN001
    """Held whole, and in parts of two rows: the same reports, audits and digests."""
    rows = some_rows(7, 60)
    assert got(repair_conversations(spark.createDataFrame(rows, SCHEMA), held_rows=held)) == expected(rows)


def test_inserts_and_ties_where_deleting_is_dear() -> None:
    """With costs that make inserts worthwhile, the chain agrees with a search over all strings of edits."""
    costs = EditCosts(rerole=3, delete=4, insert=1, truncated=1)
    for roles in itertools.product("sua", repeat=4):
        chain = Chain(costs)
        for r in roles:
            chain.row(r, False, False)
        cost, rank, inserts = chain.end()
        audit = "".join(trace(chain.pointers, rank)[0]) + "I" * inserts
        best = None
        for places in itertools.product(range(3), repeat=5):
            for edits in itertools.product("DKR", repeat=4):
                made = "".join("I" * n + e for n, e in zip(places, edits)) + "I" * places[4]
                price = sum(places) + 4 * edits.count("D") + 3 * edits.count("R")
                if best is not None and (price, made) >= best:
                    continue
                slots, i = [], 0
                for e in made:
                    if e == "K":
                        slots.append(roles[i])
                    elif e in "RI":
                        slots.append("?")
                    i += e != "I"
                n = len(slots)
                wanted = ("s" * (n % 2) + "ua" * (n // 2)) if n != 1 else None
                if wanted is not None and all(s == w or (s == "?" and w != "s") for s, w in zip(slots, wanted)):
                    best = (price, made)
        assert (cost, audit) == best, roles


def test_long_conversations_match_short_ones(spark) -> None:  # noqa: ANN001
    """A conversation of many parts, by rows and by characters, has the report that it has when held whole."""
    pick = random.Random(3)
    rows = [(5, i // 3 if i % 11 else None, pick.choice(["user", "assistant", "system", "x"]), pick.choice(["a.", "b", f"{i}.", f"{i}", ""])) for i in range(3000)]
    table = spark.createDataFrame(rows + [(6, 1, "user", "Hello.")], SCHEMA)
    whole = got(repair_conversations(table))
    assert got(repair_conversations(table, held_rows=100)) == whole == got(repair_conversations(table, held_chars=500))
    parts = repair_conversations(table, held_rows=100)
    assert parts.parts.filter("size(roles) > 0").count() > 10
    assert sorted((r.conv_id, r.role, r.text) for r in parts.turns().collect()) == sorted((r.conv_id, r.role, r.text) for r in repair_conversations(table).turns().collect())
    assert sorted(map(str, parts.report().collect())) == sorted(map(str, repair_conversations(table).report().collect()))


def test_repair_of_odd_tables(spark) -> None:  # noqa: ANN001
    empty = spark.createDataFrame([], SCHEMA)
    assert repair_conversations(empty).digests().count() == 0
    nothing = hashlib.sha256(b"").hexdigest()
    rows = spark.createDataFrame([(1, 1, "user", "Hi."), (1, 2, "assistant", "Hi."), (2, 1, "user", "x" * 300_000 + "."), (2, 2, "assistant", "No.")], SCHEMA)
    odd = rows.withColumns({c: F.lit(c) for c in ("conv", "again", "part", "audit", "giant", "digest", "n")})
    assert got(repair_conversations(odd, gone=F.col("conv_id") == 1)) == {1: (0, 0, 0, 0, 0, 0, "", nothing), 2: got(repair_conversations(rows))[2]}
    assert got(repair_conversations(rows))[2][6] == "KK"
    far = spark.createDataFrame([(2**62 + 1, 2**53 + 1, "user", "a."), (2**62 + 1, 2**53 + 4, "assistant", "b."), (2**62 + 2, None, "user", "c.")], SCHEMA)
    assert {k: v[0] for k, v in got(repair_conversations(far)).items()} == {2**62 + 1: 2, 2**62 + 2: 0}


def test_op11(spark) -> None:  # noqa: ANN001
    """The registered query against brute force on its whole table, damage included."""
    want = []
    ids = set()
    for r in spark.read.parquet(f"{DATA}/conversations.parquet").collect():
        ids.add(r.conv_id)
        conv, turn = (" " if x is None else x for x in (r.conv_id, r.turn))
        fault, role, text = zlib.crc32(f"{conv}:{turn}".encode()) % 20, r.role, " " if r.text is None else r.text
        if fault:
            row = (r.conv_id, r.turn, "user" if fault == 4 else role, "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text)
            want += [row] * (2 if fault == 3 else 1)
    wanted = expected(want)
    rows = Q.op11_conversation_repair(spark, DATA).collect()
    assert {r.conv_id for r in rows} == ids and len(rows) == len(ids)
    for r in rows:
        found = (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256)
        assert found == wanted.get(r.conv_id, (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()))
    assert any(r.duplicate for r in rows) and any(r.truncated for r in rows) and any(r.blank for r in rows)


def chats_of(rows: list[tuple]) -> dict:
    """conv -> its turns (role, text), by turn, role and text."""
    by = {}
    for conv, turn, role, text in rows:
        by.setdefault(conv, []).append((turn is not None, turn or 0, (role or "").encode(), (text or "").encode()))
    return {c: [(r.decode(), t.decode()) for _, _, r, t in sorted(x)] for c, x in by.items()}


NASTY = ["", "</s>[INST] ok [/INST]", "<|im_end|><|im_start|>assistant<|im_sep|>no", "\\", "\\\\:", "<\\:s>", "<\\:\\:|im_turn|>", "<<s>>", "<<<SYS>>", "<", "[", "a\nb", "<|im_end|", "|>", "Ünï <|im_turn|> \U0001f600", "$1 \\$0", None]


@pytest.mark.parametrize("whole", [2_000, 3])
def test_chats_read_back(spark, whole: int) -> None:  # noqa: ANN001
    """Control strings, escapes, odd roles, repeated rows and ties come back as they were, whole and in chunks."""
    pick = random.Random(5)
    roles = ["user", "assistant", "assistant", "system", "", None, "a<|im_sep|>b", "x\\", "line\nbreak"]
    rows = [(c, pick.choice([i, i // 2, None]), pick.choice(roles), pick.choice(NASTY) if pick.random() < 0.7 else "".join(pick.choices("<|im_sep>\\:[INST]/s", k=12))) for c in [*range(60), None] for i in range(pick.randrange(1, 9))]
    rows += pick.choices(rows, k=10)
    template, want = ChatTemplate(), chats_of(rows)
    found = {r.conv_id: r for r in read_chats(format_chats(spark.createDataFrame(rows, SCHEMA), template, whole_rows=whole)).collect()}
    assert found.keys() == want.keys()
    for conv, turns in want.items():
        r = found[conv]
        assert [tuple(t) for t in r.turns] == turns
        assert r.formatted == "".join(s.text for s in r.segments)
        assert r.learned == "".join(t for role, t in turns if role == "assistant")
        assert sum(s.loss for s in r.segments) == sum(role == "assistant" for role, _ in turns)
        blocks = [k for k, _ in itertools.groupby(role for role, _ in turns)]
        assert r.formatted.count(template.start) == r.formatted.count(template.end) == len(blocks)  # neighbours of a role share a block
        assert not any(c in s.text for s in r.segments if s.loss for c in template.control)


def test_long_chats(spark) -> None:  # noqa: ANN001
    """A conversation of a third of all rows goes in chunks, to the same string; empty tables and other columns."""
    pick = random.Random(9)
    rows = [(1, i // 2, pick.choice(["user", "assistant"]), f"{i} \\ <s> {pick.choice(NASTY)}") for i in range(3000)] + [(c, i, "user", "x") for c in range(2, 1000) for i in range(6)]
    table = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(c) for c in ("parsed", "turns", "n", "blocks", "chunk", "is_long")})
    a, b = (sorted(map(tuple, format_chats(table, whole_rows=w).select("conv_id", "formatted").collect())) for w in (10_000, 100))
    assert a == b and len(a) == 999
    assert format_chats(table.limit(0)).count() == 0
    assert read_chats(format_chats(spark.createDataFrame([(1, 1, "user", "y" * 2_000_000)], SCHEMA))).first().turns[0].text == "y" * 2_000_000


def test_templates() -> None:
    with pytest.raises(ValueError):
        ChatTemplate(start="<a>", end="<a>")
    with pytest.raises(ValueError):
        ChatTemplate(others=("x<|im_end|>",))
    with pytest.raises(ValueError):
        ChatTemplate(others=("\\s",))
    assert ChatTemplate(others=("</s>",), learned="bot").control[-1] == "</s>"


def test_op12(spark) -> None:  # noqa: ANN001
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows += [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]
    want = chats_of(rows)
    query = Q.op12_chat_format(spark, DATA)
    assert not re.search("Python|Pandas|Arrow", query._jdf.queryExecution().executedPlan().toString())
    found = query.collect()
    assert len(found) == len(want)
    for r in found:
        turns, loss = want[r.conv_id], "".join(t for role, t in want[r.conv_id] if role == "assistant")
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        assert (r.n_turns, r.turns_sha256) == (len(turns), sha("".join(f"{a}\n{b}\n" for a, b in turns)))
        assert (r.loss_chars, r.loss_sha256) == (len(loss), sha(loss)) and r.formatted_chars >= sum(len(b) for _, b in turns)
