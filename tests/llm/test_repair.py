import hashlib
import itertools
import random
import zlib

import pytest

from curveboard.llm import repair

SCHEMA = "conv_id long, turn long, role string, text string, cost string, edits string, present string"
SPACE = " \t\n\x0b\x0c\r"


def rows_after_damage(rows):
    """The damage, row by row; conversations that lose all rows stay as empty lists."""
    out = {}
    for conv, turn, role, text in rows:
        own = out.setdefault(conv, [])
        shown = [" " if v is None else str(v) for v in (conv, turn)]
        kind = zlib.crc32(":".join(shown).encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 0:
            continue
        if kind == 1:
            text = ""
        if kind == 2:
            text = "".join(c for c in text if c not in ".!?")
        if kind == 4:
            role = "user"
        own += [(turn, role, text)] * (2 if kind == 3 else 1)
    for own in out.values():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    return out


def brute_force(rows):
    """Report of one conversation by trying every sequence of edits, at most two inserts between rows."""
    faults, seen = [], set()
    for _, role, text in rows:
        left = text.rstrip(SPACE)
        if not left:
            faults.append("blank")
        elif (role, text) in seen:
            faults.append("duplicate")
        elif left[-1] not in ".!?":
            faults.append("truncated")
        else:
            faults.append("")
        seen.add((role, text))
    best = None
    choices = [["D"] if f in ("blank", "duplicate") else ["D", "K", "Ru", "Ra"] for f in faults]
    gaps = [["", "u", "a", "ua", "au"]] * (len(rows) + 1)
    for edits in itertools.product(*choices):
        base = 0
        for e, f in zip(edits, faults):
            base += {"D": 4, "K": 0}.get(e, 3) + (3 if e != "D" and f == "truncated" else 0)
        if best and base > best[0]:
            continue
        for inserts in itertools.product(*gaps):
            cost = base + 3 * sum(map(len, inserts))
            if best and cost > best[0]:
                continue
            initials, audit, texts = "", "", []
            for i in range(len(rows) + 1):
                for x in inserts[i]:
                    initials, audit = initials + x, audit + "I"
                    texts.append({"u": "user:", "a": "assistant:"}[x])
                if i < len(rows) and edits[i] == "D":
                    audit += "D"
                elif i < len(rows):
                    role = rows[i][1] if edits[i] == "K" else {"u": "user", "a": "assistant"}[edits[i][1]]
                    initials, audit = initials + (role[:1] or "?"), audit + edits[i][0]
                    texts.append(f"{role}:{rows[i][2]}")
            body = initials[1:] if initials[:1] == "s" else initials
            if initials and (not body or body != "ua" * (len(body) // 2)):
                continue
            if best is None or (cost, audit) < best[:2]:
                best = (cost, audit, texts)
    turns = {r[0] for r in rows if r[0] is not None}
    pairs = [a[1][:1] + b[1][:1] for a, b in itertools.pairwise(rows)]
    return (
        max(turns) - min(turns) + 1 - len(turns) if turns else 0,
        *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
        sum(p not in ("su", "ua", "au") for p in pairs),
        best[0],
        best[1],
        hashlib.sha256("\n".join(best[2]).encode()).hexdigest(),
    )


def reports(spark, rows):
    wide = [(*r, "x", "x", "x") for r in rows]
    return {r[0]: tuple(r)[1:] for r in repair.repair_reports(repair.damaged(spark.createDataFrame(wide, SCHEMA))).collect()}


def made_up(seed, conversations):
    rng = random.Random(seed)
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None]
    texts = ["Yes.", "No!", "and then", "Why?  ", "", " \t", None, "a \n", "naïve?", " "]
    rows = []
    for conv in range(conversations):
        for turn in range(rng.randint(1, 4)):
            where = rng.choice([turn, turn, turn, turn + 3, None])
            rows.append((conv if conv else None, where, rng.choice(roles), rng.choice(texts)))
    return rows


def test_reports_equal_brute_force(spark):
    rows = made_up(5, 220)
    found = reports(spark, rows)
    expected = {c: brute_force(own) for c, own in rows_after_damage(rows).items()}
    assert {c: (v, expected[c]) for c, v in found.items() if v != expected[c]} == {}
    assert {len(v) for v in rows_after_damage(rows).values()} >= {0, 1, 2, 3, 4}


def test_edits_cross_batches_and_chunks(spark, monkeypatch):
    """A conversation of many turns gives the same report whatever the chunks and batches."""
    rng = random.Random(2)
    rows = [(1, t // 2, rng.choice(["user", "assistant", "system"]), rng.choice(["Yes.", f"No {t}", f"Why {t}?"])) for t in range(3000)]
    plain = reports(spark, rows)
    monkeypatch.setattr(repair, "CHUNK_ROWS", 7)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "11")
    try:
        assert reports(spark, rows) == plain
        plans = repair.edit_plans(repair.damaged(spark.createDataFrame([(*r, "", "", "") for r in rows], SCHEMA)))
        assert plans.count() > 100
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    own = rows_after_damage(rows)[1]
    gaps, blank, duplicate, truncated, illegal, cost, audit, _ = plain[1]
    assert sum(c != "I" for c in audit) == len(own) and blank + duplicate + truncated > 0 and cost > 0


def test_repaired_turns_follow_the_pattern(spark):
    rows = made_up(9, 150)
    df = repair.damaged(spark.createDataFrame([(*r, "", "", "") for r in rows], SCHEMA))
    out, edits = {}, {}
    for r in sorted(repair.repaired_turns(df).collect(), key=lambda r: (str(r.conv_id), r.place)):
        edits[r.conv_id] = edits.get(r.conv_id, "") + r.edit
        if r.edit != "D":
            out.setdefault(r.conv_id, []).append((r.role, r.text))
    report = {r.conv_id: r for r in repair.repair_reports(df).collect()}
    for conv, r in report.items():
        own = out.get(conv, [])
        initials = "".join(role[0] for role, _ in own)
        body = initials.removeprefix("s")
        assert not initials or (body and body == "ua" * (len(body) // 2))
        assert edits.get(conv, "") == r.audit
        assert hashlib.sha256("\n".join(f"{a}:{b}" for a, b in own).encode()).hexdigest() == r.repaired_sha256


@pytest.mark.parametrize("repeat", [2])
def test_repeated_rows_and_long_texts(spark, repeat):
    rows = [(7, 0, "user", "w " * 200_000 + "."), (7, 1, "assistant", "Yes.")] * repeat + [(8, None, "user", None)]
    expected = {c: brute_force(own) for c, own in rows_after_damage(rows).items()}
    assert reports(spark, rows) == expected


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert repair.repair_reports(repair.damaged(empty)).count() == 0
    assert repair.repaired_turns(repair.damaged(empty)).count() == 0
