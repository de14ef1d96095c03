import hashlib
import heapq
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from statementspark.llm import queries
from statementspark.llm import turn_repair as R

from ..conftest import SF

SCHEMA = "conv_id long, turn long, role string, text string"
GOOD = re.compile(r"(s?(ua)+)?\Z")


def cheapest(letters):
    """All edits, cheapest first and by audit: (cost, audit) of the first well-formed one."""
    heap, seen = [(0, "", 0, "")], set()
    while heap:
        cost, audit, i, roles = heapq.heappop(heap)
        if (i, roles[-2:], cost, audit) in seen:
            continue
        seen.add((i, roles[-2:], cost, audit))
        if i == len(letters) and GOOD.match(roles):
            return cost, audit
        options = []
        if i < len(letters):
            x = letters[i]
            options.append((3, "D", 1, ""))
            if x != "x":
                more = x.isupper()
                options += [(2 + more, "R", 1, "u"), (2 + more, "R", 1, "a"), (0 + more, "K", 1, x.lower())]
        options += [(2, "I", 0, "u"), (2, "I", 0, "a")]
        for c, e, step, role in options:
            new = roles + role
            if re.match(r"s?(ua)*u?\Z", new) and cost + c <= 3 * len(letters) + 4:
                heapq.heappush(heap, (cost + c, audit + e, i + step, new))
    raise AssertionError


@pytest.mark.parametrize("n", range(6))
def test_cost_and_audit_against_all_edits(n):
    rng = np.random.default_rng(n)
    for _ in range(60):
        letters = "".join(rng.choice(list(R.LETTERS), n))
        assert R.repair(letters) == cheapest(letters), letters


@pytest.mark.parametrize("segment", [1, 2, 7, 100])
def test_segments_change_nothing(segment):
    rng = np.random.default_rng(segment)
    for n in (0, 1, 2, 13, 50, 300):
        letters = "".join(rng.choice(list(R.LETTERS), n))
        assert R.repair(letters, segment) == R.repair(letters, 10_000)


def test_long_conversations_take_little():
    rng = np.random.default_rng(0)
    letters = "".join(rng.choice(list(R.LETTERS), 200_000))
    cost, audit = R.repair(letters)
    assert len(audit.replace("I", "")) == len(letters) and cost > 0
    assert R.repair("ua" * 100_000) == (0, "K" * 200_000)


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def expected(rows):
    """The contract by hand."""
    out = {}
    space = " \t\n\x0b\x0c\r"
    convs = {}
    for c, t, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        fault = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        mine = convs.setdefault(c, [])
        if fault == 0:
            continue
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        role = "user" if fault == 4 else role
        mine += [(t is not None, t or 0, role, text)] * (2 if fault == 3 else 1)
    for c, mine in convs.items():
        mine.sort()
        faults, seen, letters = [], set(), ""
        for _, _, role, text in mine:
            fault = "blank" if not text.strip(space) else "duplicate" if (role, text) in seen else "truncated" if text.rstrip(space)[-1] not in ".!?" else ""
            seen.add((role, text))
            faults.append(fault)
            letter = role[:1] if role[:1] in ("s", "u", "a") else "o"
            letters += "x" if fault in ("blank", "duplicate") else letter.upper() if fault else letter
        turns = [t for has, t, _, _ in mine if has]
        initials = [r[:1] for _, _, r, _ in mine]
        cost, audit = cheapest(letters)
        kept, k = [], 0
        for edit in audit:
            led = bool(kept) and kept[0][0][:1] == "s" and kept[0][2] == "K"
            role = "user" if (len(kept) - led) % 2 == 0 else "assistant"
            if edit == "I":
                kept.append((role, "", edit))
                continue
            if edit != "D":
                kept.append((mine[k][2] if edit == "K" else role, mine[k][3], edit))
            k += 1
        out[c] = (
            max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"),
            sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False)), cost, audit, sha("\n".join(f"{r}:{t}" for r, t, _ in kept)),
        )
    return out


def result(frame):
    names = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
    return {r.conv_id: tuple(r[n] for n in names) for r in frame.collect()}


def test_nulls_ties_repeats_and_odd_roles(spark):
    rng = np.random.default_rng(3)
    texts = ["Yes.", "no", "", " \n", None, "what?\n ", "é!", "a.b", "x" * 3000 + "."]
    roles = ["user", "assistant", "system", "tool", None, "", "assistant", "user"]
    rows = [(c, None if rng.random() < 0.1 else int(rng.integers(0, 9)), roles[rng.integers(0, 8)], texts[rng.integers(0, 9)]) for c in [*range(60), None] for _ in range(int(rng.integers(1, 6)))]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"pos": F.lit("clash"), "letter": F.lit(1), "audit": F.lit(2), "fault": F.lit(3)})
    assert result(R.repair_conversations(R.damage(df))) == expected(rows)
    assert R.repair_conversations(R.damage(df.where("false"))).count() == 0


def test_one_hot_conversation(spark):
    df = spark.range(20_000).selectExpr("CAST(1 AS LONG) AS conv_id", "id AS turn", "CASE WHEN id % 2 = 0 THEN 'user' ELSE 'assistant' END AS role", "concat('t', id, '.') AS text")
    row = R.repair_conversations(R.damage(df)).first()
    assert row.duplicate > 900 and row.gaps > 900 and len(row.audit.replace("I", "")) > 19_000


def test_query_against_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert result(queries.op12_dial_repair(spark, SF)) == expected(rows)
