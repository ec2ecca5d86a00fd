import hashlib
import random
import re
import zlib
from collections import defaultdict
from itertools import product

import duckdb
import pytest

from loomspan.llm import conversation_repair as m

GRAMMAR = re.compile(r"(s?(ua)+)?")
COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        body = text.rstrip(" \t\n\x0b\x0c\r")
        out.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def every_repair(rows, most_inserts=3):
    """The least (cost, audit, lines) over all edits, with up to ``most_inserts`` inserted turns at any place."""
    kinds = faults(rows)
    choices = []
    for (role, text), fault in zip(rows, kinds):
        more = 3 if fault == "truncated" else 0
        own = [(4, "D", None)]
        if fault in ("", "truncated"):
            own += [(more, "K", (role, text))] + [(3 + more, "R", (r, text)) for r in ("user", "assistant")]
        choices.append(own)
    best = None
    gaps = [[()] + [tuple((3, "I", (r, "")) for r in c) for n in range(1, most_inserts) for c in product(("user", "assistant"), repeat=n)]] * (len(rows) + 1)
    for picked in product(*choices):
        for put in product(*gaps):
            edits = [e for k in range(len(rows)) for e in (*put[k], picked[k])] + list(put[len(rows)])
            cost = sum(e[0] for e in edits)
            if best is not None and cost > best[0]:
                continue
            lines = [e[2] for e in edits if e[2]]
            if GRAMMAR.fullmatch("".join(r[:1] for r, _ in lines)):
                new = (cost, "".join(e[1] for e in edits), [f"{r}:{t}" for r, t in lines])
                best = new if best is None or new[:2] < best[:2] else best
    return best


def by_search(rows):
    """The same by Dijkstra's order over (turns read, state), for longer conversations."""
    kinds, best = faults(rows), {(0, 0): (0, "", ())}
    forced, step = (2, 2, 3, 2), {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
    done = set()
    while True:
        at = min((k for k in best if k not in done), key=lambda k: best[k][:2], default=None)
        if at is None:
            return min((best[len(rows), s] for s in (0, 3) if (len(rows), s) in best), key=lambda b: b[:2])
        done.add(at)
        (i, state), (cost, audit, lines) = at, best[at]
        role = "user" if forced[state] == 2 else "assistant"
        moves = [((i, forced[state]), cost + 3, audit + "I", (*lines, role + ":"))]
        if i < len(rows):
            moves.append(((i + 1, state), cost + 4, audit + "D", lines))
            if kinds[i] in ("", "truncated"):
                more = cost + (3 if kinds[i] else 0)
                if (state, rows[i][0][:1]) in step:
                    moves.append(((i + 1, step[state, rows[i][0][:1]]), more, audit + "K", (*lines, f"{rows[i][0]}:{rows[i][1]}")))
                moves.append(((i + 1, forced[state]), more + 3, audit + "R", (*lines, f"{role}:{rows[i][1]}")))
        for key, *new in moves:
            if key not in best or tuple(new[:2]) < best[key][:2]:
                best[key] = tuple(new)
                done.discard(key)


def report(rows, damage=True, solve=by_search):
    groups, ids = defaultdict(list), {r[0] for r in rows}
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20 if damage else 9
        if fault == 0:
            continue
        role = "user" if fault == 4 else role
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        groups[conv] += [(turn, role, text)] * (2 if fault == 3 else 1)
    out = []
    for conv in ids:
        own = sorted(groups[conv], key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
        said = [(r, t) for _, r, t in own]
        kinds = faults(said)
        turns = [t for t, *_ in own if t is not None]
        cost, audit, lines = solve(said)
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(said, said[1:]))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out.append((conv, gaps, *(kinds.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(map(str, out))


SCHEMA = "conv_id long, turn long, role string, text string"


def talk(rng, conv, n):
    roles = ["user", "assistant", "system", "tool", None, "user", "assistant"]
    return [(conv, rng.choice([t, t, t, t + 1, None]), rng.choice(roles), rng.choice(["Yes.", "No!", "so what", "", " ", None, f"own {t}?", f"cut {t}", "tail.\n"])) for t in range(n)]


def test_every_edit_of_small_conversations():
    rng = random.Random(1)
    for _ in range(40):
        rows = [(r or " ", x or "") for _, _, r, x in talk(rng, 0, rng.randint(0, 3))]
        want = every_repair(rows)
        assert by_search(rows)[:2] == want[:2] and list(by_search(rows)[2]) == want[2]


@pytest.fixture(scope="module")
def talks(spark):
    rng = random.Random(2)
    rows = [r for conv in range(120) for r in talk(rng, conv, rng.randint(1, 9))]
    rows += talk(rng, None, 12) + talk(rng, 500, 700) + [(501, 3, "user", "Same.")] * 40 + [(502, None, None, None)] * 2 + [(503, 1, "user", "x " * 200_000 + ".")]
    rng.shuffle(rows)
    return rows


def test_report_matches_search(spark, talks):
    turns = spark.createDataFrame(talks, SCHEMA).repartition(5)
    assert sorted(map(str, map(tuple, m.op12_conversation_repair(turns).select(COLUMNS).collect()))) == report(talks)


def test_pieces_compose(spark, talks, monkeypatch):
    turns = spark.createDataFrame(talks, SCHEMA)
    want = report(talks, damage=False)
    for piece, ranges in ((1, 3), (7, 40), (2_048, 1)):
        monkeypatch.setattr(m, "range_count", lambda _, n=ranges: n)
        got = m.repair_report(turns, turns, piece).select(COLUMNS).collect()
        assert sorted(map(str, map(tuple, got))) == want


def test_repaired_turns_follow_the_grammar(spark, talks):
    turns = spark.createDataFrame(talks, SCHEMA)
    solved = m.folded(m.pieces(m.marks(turns)))
    roles = defaultdict(str)
    for r in m.repaired_turns(turns, solved).collect():
        roles[r["conv"]] += r["role"][:1]
    assert roles and all(GRAMMAR.fullmatch(x) for x in roles.values())


def test_empty_table_and_clashing_columns(spark):
    assert m.op12_conversation_repair(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = [(1, 1, "user", "Hi.", "x", 4, "k"), (1, 2, "assistant", "Yes.", "y", 5, None), (None, None, None, None, None, None, None)]
    turns = spark.createDataFrame(rows, SCHEMA + ", conv string, cost int, digest string")
    assert sorted(map(str, map(tuple, m.op12_conversation_repair(turns).select(COLUMNS).collect()))) == report([r[:4] for r in rows])


def test_sql_agrees(spark, talks):
    turns = spark.createDataFrame([r for r in talks if r[0] != 503], SCHEMA)
    con = duckdb.connect()
    own = turns.toPandas()
    con.register("conversations", own.astype(object).where(own.notna(), None).astype({"conv_id": "Int64", "turn": "Int64"}))
    want = con.sql(f"SELECT {', '.join(COLUMNS)} FROM ({m.oracle_sql()})").fetchall()
    assert sorted(map(str, want)) == sorted(map(str, map(tuple, m.op12_conversation_repair(turns).select(COLUMNS).collect())))
