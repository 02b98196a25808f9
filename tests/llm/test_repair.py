import hashlib
import heapq
import random
import zlib

import pytest

from leafmark.llm import repair

SCHEMA = "conv_id long, turn long, role string, text string, symbol string, copies string"
WHITE = " \t\n\x0b\x0c\r"


def cheapest(rows):
    """Least cost, then least audit: a shortest-path search over (rows done, roles so far)."""
    queue, done = [(0, "", 0, "", ())], set()
    while queue:
        cost, audit, i, last, out = heapq.heappop(queue)
        if i == len(rows) and last in ("", "a"):
            return cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest()
        if (i, last) in done:
            continue
        done.add((i, last))
        legal = {"": "su", "s": "u", "u": "a", "a": "u"}[last]
        push = lambda c, label, step, now, line: heapq.heappush(queue, (cost + c, audit + label, i + step, now, (*out, *line)))
        for role in ("user", "assistant"):
            if role[0] in legal:
                push(3, "I", 0, role[0], [f"{role}:"])
        if i < len(rows):
            role, text, fault = rows[i]
            push(4, "D", 1, last, [])
            if fault not in ("blank", "duplicate"):
                more = 3 if fault == "truncated" else 0
                if role[:1] and role[:1] in legal:
                    push(more, "K", 1, role[:1], [f"{role}:{text}"])
                for new in ("user", "assistant"):
                    if new[0] in legal:
                        push(3 + more, "R", 1, new[0], [f"{new}:{text}"])


def brute(table):
    """conv_id -> all columns, from the rules as they are written."""
    found = {}
    for conv in {r[0] for r in table}:
        rows = []
        for _, turn, role, text in (r for r in table if r[0] == conv):
            role, text = " " if role is None else role, " " if text is None else text
            kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
            text = "" if kind == 1 else "".join(c for c in text if c not in ".!?") if kind == 2 else text
            role = "user" if kind == 4 else role
            rows += [(turn is not None, turn or 0, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
        rows.sort()
        seen, marked = set(), []
        for *_, role, text in rows:
            tail = text.rstrip(WHITE)
            marked.append((role, text, "blank" if not tail else "duplicate" if (role, text) in seen else "truncated" if tail[-1] not in ".!?" else ""))
            seen.add((role, text))
        turns = {t for known, t, *_ in rows if known}
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
        count = lambda f: sum(m[2] == f for m in marked)
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        found[conv] = (gaps, count("blank"), count("duplicate"), count("truncated"), illegal, *cheapest(marked))
    return found


def make(seed, conversations=60):
    rng = random.Random(seed)
    table = []
    for conv in [*range(conversations), None]:
        turn = rng.choice([0, 5, -3])
        for _ in range(rng.randint(0, 12)):
            turn += rng.choice([1, 1, 1, 0, 2])
            text = rng.choice(["Yes.", "No!", "why?", "cut", "", " \n", None, "é漢. ", "a.b", "end.　", f"n{rng.random()}."])
            table.append((conv, rng.choice([turn, turn, turn, None]), rng.choice(["user", "assistant", "system", "user", "assistant", "tool", "", None, "us"]), text))
    return table


@pytest.mark.parametrize("seed", range(3))
def test_against_search(spark, seed):
    table = make(seed)
    frame = spark.createDataFrame([(*r, "x", "y") for r in table], SCHEMA).repartition(3)
    found = {r.conv_id: tuple(r)[1:] for r in repair.repair(repair.damaged(frame)).collect()}
    assert found == brute(table)


def test_repeated_rows_and_empty_table(spark):
    table = [(1, 3, "user", "A.")] * 5 + [(1, 4, "assistant", "B.")] * 2
    frame = spark.createDataFrame(table, "conv_id long, turn long, role string, text string")
    assert {r.conv_id: tuple(r)[1:] for r in repair.repair(repair.damaged(frame)).collect()} == brute(table)
    assert repair.repair(repair.damaged(frame.limit(0))).count() == 0


def test_long_conversation_and_texts(spark):
    rng = random.Random(5)
    table = [(7, t, rng.choice(["user", "assistant", "system"]), rng.choice(["Ja.", f"n{t}!", f"c{t}", "x" * 20_000 + "."])) for t in range(9000)]
    frame = spark.createDataFrame(table, "conv_id long, turn long, role string, text string").repartition(4)
    found = repair.repair(repair.damaged(frame)).collect()
    assert tuple(found[0])[1:-1] == brute_cost(table)


def brute_cost(table):
    """As `brute`, with a table of (cost, audit) by row and state instead of a search."""
    rows = []
    for conv, turn, role, text in table:
        kind = zlib.crc32(f"{conv}:{turn}".encode()) % 20
        text = "" if kind == 1 else text.translate(str.maketrans("", "", ".!?")) if kind == 2 else text
        rows += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    best, seen, count = {"": (0, "")}, set(), {"blank": 0, "duplicate": 0, "truncated": 0}

    def inserted(b):
        for _ in range(3):
            for q, (c, a) in list(b.items()):
                for p in {"": "u", "s": "u", "u": "a", "a": "u"}[q]:
                    b[p] = min(b.get(p, (1 << 60, "")), (c + 3, a + "I"))
        return b

    best = inserted(best)
    for _, role, text in rows:
        tail = text.rstrip(WHITE)
        fault = "blank" if not tail else "duplicate" if (role, text) in seen else "truncated" if tail[-1] not in ".!?" else ""
        seen.add((role, text))
        if fault:
            count[fault] += 1
        new = {}
        for q, (c, a) in best.items():
            ways = [(q, 4, "D")]
            if fault not in ("blank", "duplicate"):
                more = 3 if fault == "truncated" else 0
                legal = {"": "su", "s": "u", "u": "a", "a": "u"}[q]
                ways += [(role[0], more, "K")] if role[0] in legal else []
                ways += [(p, 3 + more, "R") for p in "ua" if p in legal]
            for p, w, label in ways:
                new[p] = min(new.get(p, (1 << 60, "")), (c + w, a + label))
        best = inserted(new)
    turns = {r[0] for r in rows}
    illegal = sum(a[1][0] + b[1][0] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    return (max(turns) - min(turns) + 1 - len(turns), *count.values(), illegal, *min(best[q] for q in ("", "a") if q in best))


def test_certain_places_keep_little(monkeypatch):
    """Written bit by bit, the result is that of the whole; texts do not pile up."""
    rng = random.Random(9)
    rows = [(rng.randrange(repair.SYMBOLS), rng.choice(["user", "assistant", "system"]), str(i)) for i in range(5000)]
    whole = repair.Conversation(repair.Automaton())
    whole.seek = 1 << 60
    monkeypatch.setattr(repair, "_ROWS", 16)
    bits, most = repair.Conversation(repair.Automaton()), 0
    for row in rows:
        whole.add(*row)
        bits.add(*row)
        most = max(most, len(bits.rows))
    assert bits.result() == whole.result()
    assert most < 200
    assert len(whole.a.vectors) < 400


def test_copies_bring_no_text():
    c = repair.Conversation(repair.Automaton())
    for _ in range(20_000):
        c.add(0, "user", "x" * 1000)
    assert not any(c.rows)
    assert c.result()[:2] == (80_000, "D" * 20_000)
