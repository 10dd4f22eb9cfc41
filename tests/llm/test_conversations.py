import hashlib
import itertools
import random
import re
import zlib

import pytest

from trustmill.llm import conversations

SCHEMA = "conv_id long, turn long, role string, text string, cost string, pos int"
BLANK = "[\x20\x09-\x0d]"


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        plain = lambda v: " " if v is None else str(v)
        fate = zlib.crc32(f"{plain(conv)}:{plain(turn)}".encode()) % 20
        role, text = plain(role), plain(text)
        if fate:
            text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
            out += [(conv, turn, "user" if fate == 4 else role, text)] * (2 if fate == 3 else 1)
    return out


def faults(rows):
    """(rows in order, fault of each) of one conversation."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), hashlib.sha256(r[3].encode()).hexdigest()))
    seen, out = set(), []
    for _, _, role, text in rows:
        body = re.sub(f"{BLANK}+\\Z", "", text)
        out.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    return rows, out


def by_hand(rows):
    """gaps, blank, duplicate, truncated, illegal of one conversation, and its rows and faults."""
    rows, marks = faults(rows)
    turns = [r[1] for r in rows if r[1] is not None]
    illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    return [max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *[marks.count(k) for k in ("blank", "duplicate", "truncated")], illegal], rows, marks


def cheapest(rows, marks):
    """(cost, audit, lines) by a plain table over rows and last roles."""
    state = {"": (0, "", ())}

    def put(new, key, entry):
        if key not in new or entry < new[key]:
            new[key] = entry

    def inserted(state):
        state = dict(state)
        for _ in range(3):
            for last, (cost, audit, lines) in list(state.items()):
                role = "a" if last == "u" else "u"
                put(state, role, (cost + 5, audit + "I", (*lines, "user:" if role == "u" else "assistant:")))
        return state

    for (_, _, role, text), mark in zip(rows, marks, strict=True):
        new = {}
        for last, (cost, audit, lines) in inserted(state).items():
            put(new, last, (cost + 2, audit + "D", lines))
            if mark in ("blank", "duplicate"):
                continue
            own = 5 * (mark == "truncated")
            fits = {"s": last == "", "u": last != "u", "a": last == "u"}
            if fits.get(role[:1]):
                put(new, role[:1], (cost + own, audit + "K", (*lines, f"{role}:{text}")))
            for to in ("user", "assistant"):
                if fits[to[0]]:
                    put(new, to[0], (cost + own + 1, audit + "R", (*lines, f"{to}:{text}")))
        state = new
    return min(v for k, v in inserted(state).items() if k in ("", "a"))


def every_way(rows, marks):
    """(cost, audit, lines) by trying all edits of a few rows, up to two inserted turns at each place."""
    puts = [(), ("u",), ("a",), ("u", "a"), ("a", "u")]
    options = []
    for (_, _, role, text), mark in zip(rows, marks, strict=True):
        own = 5 * (mark == "truncated")
        some = [("D", 2, None)]
        if mark in ("", "truncated"):
            some += [("K", own, (role[:1], f"{role}:{text}"))] + [("R", own + 1, (to[0], f"{to}:{text}")) for to in ("user", "assistant")]
        options.append([(pre, *x) for pre in puts for x in some])
    best = None
    for choice in itertools.product(*options):
        for post in puts:
            audit, cost, turns = "", 0, []
            for pre, letter, price, turn in choice:
                audit += "I" * len(pre) + letter
                cost += 5 * len(pre) + price
                turns += [(r, "user:" if r == "u" else "assistant:") for r in pre] + ([turn] if turn else [])
            turns += [(r, "user:" if r == "u" else "assistant:") for r in post]
            if re.fullmatch("(s?(ua)+)?", "".join(r or "-" for r, _ in turns)):
                entry = (cost + 5 * len(post), audit + "I" * len(post), tuple(t for _, t in turns))
                best = min(best or entry, entry)
    return best


def some_rows(conv, n, rng):
    texts = ["Yes.", "No?", "open", "", " \n", "Well, so.\n", "Yes."]
    return [(conv, rng.choice([None, *range(6)]) if n < 9 else i // 2, rng.choice(["system", "user", "user", "assistant", "assistant", "tool", "", "s"]), rng.choice(texts) + (str(rng.randrange(40)) + "." if n > 9 else "")) for i in range(n)]


def outcome(spark, rows, **sizes):
    """conv_id -> all columns, from rows that aren't damaged any more."""
    report, turns = conversations.repaired(spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA), **sizes)
    shas = {r["conv_id"]: r["repaired_sha256"] for r in conversations.sha256_by_conversation(turns).collect()}
    names = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")
    return {r["conv_id"]: [r[c] for c in names] + [shas.get(r["conv_id"], hashlib.sha256(b"").hexdigest())] for r in report.collect()}


def wanted(rows, search=cheapest):
    out = {}
    for conv in {r[0] for r in rows}:
        counts, own, marks = by_hand([r for r in rows if r[0] == conv])
        cost, audit, lines = search(own, marks)
        out[conv] = [*counts, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()]
    return out


def test_all_edits_of_short_conversations(spark):
    rng = random.Random(1)
    rows = [r for conv in range(60) for r in some_rows(conv, rng.randrange(1, 4), rng)]
    want = wanted(rows, every_way)
    assert want == wanted(rows) and outcome(spark, rows) == want


@pytest.mark.parametrize("sizes", [{}, {"block": 7, "fan": 3}, {"block": 1, "fan": 30}])
def test_long_conversations_in_blocks(spark, sizes):
    """One conversation with most rows, folded in many blocks; repeated rows, null ids and turns."""
    rng = random.Random(2)
    rows = [*some_rows(1, 500, rng), *some_rows(2, 30, rng), *some_rows(None, 12, rng), *some_rows(3, 2, rng)]
    rows += [(4, t, "user", "Same.") for t in range(40)] + [(5, 1, "user", "Yes.")] * 9 + [(6, 0, "user", "x" * 100_000), (6, 1, "assistant", "y" * 100_000 + ".")]
    assert outcome(spark, rows, **sizes) == wanted(rows)


def test_damage_and_query(spark, duck, tmp_path):
    rng = random.Random(3)
    rows = [r for conv in [None, *range(80)] for r in some_rows(conv, rng.randrange(1, 9), rng)] + [(90, t, None, None) for t in (None, 1, 7)]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA)
    got = sorted(map(tuple, conversations.damaged(df).collect()), key=repr)
    assert got == sorted(damaged(rows), key=repr) and conversations.damaged(df.limit(0)).count() == 0
    df.write.parquet(f"{tmp_path}/conversations.parquet")
    out = {r["conv_id"]: list(r)[1:] for r in conversations.op11_conversation_repair(spark, str(tmp_path)).collect()}
    want = {c: [0] * 6 + ["", hashlib.sha256(b"").hexdigest()] for c in {r[0] for r in rows}} | wanted(damaged(rows))
    assert out == want
    duck.sql(f"CREATE OR REPLACE TEMP VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    by_sql = {r[0]: list(r)[1:] for r in duck.sql(conversations.ORACLE).fetchall()}
    duck.sql("DROP VIEW temp.conversations")
    assert by_sql == want
    df.limit(0).write.parquet(f"{tmp_path}/none/conversations.parquet")
    assert conversations.op11_conversation_repair(spark, f"{tmp_path}/none").count() == 0
