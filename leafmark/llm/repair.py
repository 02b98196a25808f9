"""Cheapest repair of damaged conversations, by lazy weighted determinisation.

A repaired conversation's role initials read `(s?(ua)+)?`.  The automaton of that has four
states; edits are its weighted arcs.  What a row can do depends only on its symbol: whether
it must go, its role's initial, and whether its text is cut off.

The cost of reaching each state makes a vector.  Vectors less their smallest entry become
the states of a deterministic automaton, made when first met and kept in a transition
table, so that costs are found by one table look-up a row.  From the end, arcs that are
tight (whose cost is the difference of the vectors' entries) mark the states on cheapest
paths; the marks depend on little and are kept in a table too.  Reading forward over marked
states by the least label then gives the audit.

A conversation's rows stream in order through one task, as a hash of its whole text needs
them in order.  Faults are found before, by windows that spill.  The task holds the audit
(one letter an edit) and the texts since the last place that every cheapest repair passes
through, whatever comes next; rows that must go bring no text.

Null roles and texts, and nulls in what decides the damage, are one space.  A null conv_id
is a conversation of its own.  Rows with equal turns are ordered by role and text; repeated
rows are duplicates.  Roles are known by their first letter; an empty role is like an
unknown one.  Conversations of any length and texts of any length are taken whole.  Columns
other than conv_id, turn, role and text are ignored, whatever their names.  Empty tables
give no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmark.llm.common import prepare

#: White space as fixed by the contract of texts: space, tab and the ASCII line breaks.
BLANKS = " \t\n\x0b\x0c\r"
DELETE, INSERT, REROLE, CUT_OFF = 4, 3, 3, 3
#: Symbols: 0 must go; the others are 1 + 2 * (place of the initial in INITIALS, or 3) + cut off.
INITIALS, SYMBOLS = "sua", 9
#: States: nothing yet, after s, after u, after a.  A repaired conversation ends in the first or last.
STATES, ENDS = 4, (0, 3)
NEVER = 1 << 60
#: A state that costs more than the cheapest by this is on no cheapest repair: from any state, two inserts
#: and a deletion at most lead to where another state's way on can be gone.  So vectors are few.
APART = 2 * INSERT + DELETE
#: Where a row of each initial leads.
_STEP = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
ROLES = {2: "user", 3: "assistant"}
#: Rows after which a place is sought up to which the repair is certain.
_ROWS = 4096
_RESULT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _arcs(symbol: int) -> list[tuple[str, int, int, int]]:
    """(label, from, to, cost) of a row's edits, by label."""
    arcs = [("D", q, q, DELETE) for q in range(STATES)]
    if symbol:
        kind, extra = (symbol - 1) // 2, CUT_OFF * ((symbol - 1) % 2)
        if kind < len(INITIALS):
            arcs += [("K", q, p, extra) for q, p in _STEP[INITIALS[kind]].items()]
        arcs += [("R", q, p, REROLE + extra) for role in "ua" for q, p in _STEP[role].items()]
    return arcs


ARCS = [_arcs(x) for x in range(SYMBOLS)]
INSERTS = [(q, p) for role in "ua" for q, p in _STEP[role].items()]


class Automaton:
    """The determinised automaton as far as it has been needed."""

    def __init__(self):
        self.ids: dict[tuple[int, ...], int] = {}
        self.vectors: list[tuple[int, ...]] = []
        self.table: dict[tuple[int, int], tuple[int, int]] = {}
        self.marks: dict[tuple[int, int, int], int] = {}
        self.reads: dict[tuple[int, int, int, int], tuple[tuple[tuple[str, int], ...], int]] = {}
        self.start = self._state([0, NEVER, NEVER, NEVER])[0]

    def _state(self, costs: list[int]) -> tuple[int, int]:
        """The state of a vector after any inserts, and what was taken off."""
        for _ in range(STATES):
            for q, p in INSERTS:
                costs[p] = min(costs[p], costs[q] + INSERT)
        least = min(costs)
        key = tuple(c - least if c - least <= APART else NEVER for c in costs)
        if key not in self.ids:
            self.ids[key] = len(self.vectors)
            self.vectors.append(key)
        return self.ids[key], least

    def step(self, state: int, symbol: int) -> tuple[int, int]:
        """The next state and its cost over this one."""
        found = self.table.get((state, symbol))
        if found is None:
            costs = [NEVER] * STATES
            for _, q, p, w in ARCS[symbol]:
                costs[p] = min(costs[p], self.vectors[state][q] + w)
            found = self.table[state, symbol] = self._state(costs)
        return found

    def ending(self, state: int) -> tuple[int, int]:
        """What it costs to end here, and the marks of the states that do."""
        v = self.vectors[state]
        least = min(v[q] for q in ENDS)
        return least, self._inserted(state, sum(1 << q for q in ENDS if v[q] == least))

    def everywhere(self, state: int) -> int:
        return sum(1 << q for q, c in enumerate(self.vectors[state]) if c < NEVER)

    def _inserted(self, state: int, marked: int) -> int:
        """The marks, and those states that a tight insert leads from to them."""
        v = self.vectors[state]
        for _ in range(STATES):
            for q, p in INSERTS:
                if marked >> p & 1 and v[q] < NEVER and v[q] + INSERT == v[p]:
                    marked |= 1 << q
        return marked

    def _tight(self, state: int, symbol: int) -> list[tuple[str, int, int]]:
        after, offset = self.step(state, symbol)
        v, w = self.vectors[state], self.vectors[after]
        return [(label, q, p) for label, q, p, cost in ARCS[symbol] if v[q] < NEVER and v[q] + cost == w[p] + offset]

    def back(self, state: int, symbol: int, marked: int) -> int:
        """The marks before a row whose marks after it are `marked`."""
        key = (state, symbol, marked)
        if key not in self.marks:
            self.marks[key] = self._inserted(state, sum({1 << q for _, q, p in self._tight(state, symbol) if marked >> p & 1}))
        return self.marks[key]

    def read(self, state: int, symbol: int, marked: int, at: int) -> tuple[tuple[tuple[str, int], ...], int]:
        """The least edits (label, state after) from `at` up to and with this row, and where they lead."""
        key = (state, symbol, marked, at)
        if key not in self.reads:
            before, edits, q = self.back(state, symbol, marked), [], at
            arcs = [a for a in self._tight(state, symbol) if marked >> a[2] & 1]
            while not edits or edits[-1][0] == "I":
                label, p = min([(label, p) for label, s, p in arcs if s == q] + self._insert(state, before, q))
                edits.append((label, p))
                q = p
            self.reads[key] = tuple(edits), q
        return self.reads[key]

    def _insert(self, state: int, marked: int, q: int) -> list[tuple[str, int]]:
        v = self.vectors[state]
        return [("I", p) for s, p in INSERTS if s == q and marked >> p & 1 and v[q] + INSERT == v[p]]

    def last(self, state: int, at: int) -> list[tuple[str, int]]:
        """The inserts behind the last row."""
        least, marked = self.ending(state)
        edits, q = [], at
        while not (q in ENDS and self.vectors[state][q] == least):
            label, q = self._insert(state, marked, q)[0]
            edits.append((label, q))
        return edits


class Conversation:
    """The repair of one conversation, row by row."""

    def __init__(self, automaton: Automaton):
        self.a = automaton
        self.cost, self.state, self.at = 0, automaton.start, 0
        self.symbols: list[int] = []
        self.states: list[int] = []  # before each row
        self.rows: list[tuple[str, str] | None] = []
        self.audit: list[str] = []
        self.hash, self.lines = hashlib.sha256(), 0
        self.seek = _ROWS

    def add(self, symbol: int, role: str, text: str) -> None:
        self.symbols.append(symbol)
        self.states.append(self.state)
        self.rows.append((role, text) if symbol else None)
        self.state, more = self.a.step(self.state, symbol)
        self.cost += more
        if len(self.symbols) >= self.seek:
            self._settle_certain()

    def _marks(self, marked: int) -> list[int]:
        """Marks before each row held, and after the last."""
        marks = [marked]
        for state, symbol in zip(reversed(self.states), reversed(self.symbols), strict=True):
            marks.append(marked := self.a.back(state, symbol, marked))
        return marks[::-1]

    def _settle_certain(self) -> None:
        """Write down the repair up to the last place that all paths pass, wherever they end."""
        marks = self._marks(self.a.everywhere(self.state))
        n = next((i for i in range(len(marks) - 1, 0, -1) if marks[i].bit_count() == 1), 0)
        self._write(marks, n)
        for held in (self.symbols, self.states, self.rows):
            del held[:n]
        self.seek = max(_ROWS, 2 * len(self.symbols))

    def _write(self, marks: list[int], n: int) -> None:
        for i in range(n):
            edits, self.at = self.a.read(self.states[i], self.symbols[i], marks[i + 1], self.at)
            self._edit(edits, self.rows[i])

    def _edit(self, edits, row: tuple[str, str] | None) -> None:
        for label, to in edits:
            self.audit.append(label)
            if label != "D":
                role, text = (ROLES[to], "") if label == "I" else row if label == "K" else (ROLES[to], row[1])
                self.hash.update(f"{chr(10) if self.lines else ''}{role}:{text}".encode())
                self.lines += 1

    def result(self) -> tuple[int, str, str]:
        """(cost, audit, hash of the repaired conversation)"""
        least, marked = self.a.ending(self.state)
        self._write(self._marks(marked), len(self.symbols))
        self._edit(self.a.last(self.state, self.at), None)
        return self.cost + least, "".join(self.audit), self.hash.hexdigest()


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies) after damage drawn from the row's key; rows that
    it drops stay with no copies, so that their conversation is known."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    role, text = space("role"), space("text")
    return conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.when(kind == 4, "user").otherwise(role).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"),
    )


def faults(rows: DataFrame) -> DataFrame:
    """The rows of (conv_id, turn, role, text, copies), each conversation's together and in
    order, with `fault`: 1 blank, 2 seen earlier, 3 cut off, 0 none.  Further copies of a
    row are seen earlier.  One shuffle, by conversation."""
    said: Column = F.rtrim("text", F.lit(BLANKS))
    seen = Window.partitionBy("conv_id", F.col("copies") > 0, "role", "text").orderBy(F.asc_nulls_first("turn"))
    fault = F.when(said == "", 1).when(F.row_number().over(seen) > 1, 2).when(~F.right(said, F.lit(1)).isin(".", "!", "?"), 3).otherwise(0)
    marked = rows.repartition("conv_id").withColumn("fault", fault)
    return marked.sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "text")


def repair(rows: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of
    each conversation among rows (conv_id, turn, role, text, copies)."""
    prepare(rows.sparkSession)
    names = [f.split()[0] for f in _RESULT.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, now, c, out = Automaton(), None, None, []

        def told() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) or [[]] * len(names)
            kinds = [pa.int64()] * 7 + [pa.string()] * 2
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], names=names)

        def end() -> tuple:
            gaps = min(high - low + 1 - turns, (1 << 63) - 1) if turns else 0
            return (now, gaps, *counts[1:], illegal, *c.result())

        for batch in batches:
            for conv_id, turn, role, text, copies, fault in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if c is None or conv_id != now:
                    if c is not None:
                        out.append(end())
                    now, c = conv_id, Conversation(automaton)
                    low = high = before = None
                    counts, turns, illegal = [0, 0, 0, 0], 0, 0
                if copies and turn is not None:
                    turns += turn != high
                    low, high = turn if low is None else low, turn
                for k in range(copies):
                    kind = 2 if k and fault != 1 else fault
                    counts[kind] += 1
                    initial = role[:1]
                    illegal += before is not None and before + initial not in ("su", "ua", "au")
                    before = initial
                    where = INITIALS.find(initial) if initial else -1
                    c.add(0 if kind in (1, 2) else 1 + 2 * (where if where >= 0 else 3) + (kind == 3), role, text)
            if len(out) >= 1000 or sum(len(r[7]) for r in out) > 1 << 20:
                yield told()
                out.clear()
        if c is not None:
            out.append(end())
        yield told()

    return faults(rows).mapInArrow(run, _RESULT)


def oracle_sql(table: str = "conversations") -> str:
    """Damage, faults and the cheapest edits (as a recursion over rows), in DuckDB."""
    arcs = ", ".join(f"({x}, {q}, {p}, '{label}', {cost})" for x in range(SYMBOLS) for label, q, p, cost in ARCS[x])
    return f"""WITH RECURSIVE keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    flatten(list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda ch: list_transform(range(8), lambda i: (ascii(ch)::BIGINT >> i) & 1))) AS bits FROM {table}),
drawn AS (SELECT *, xor(list_reduce(list_concat([4294967295::BIGINT], bits), lambda c, b: xor(c >> 1, CASE WHEN xor(c, b) & 1 = 1 THEN 3988292384 ELSE 0 END)), 4294967295) % 20 AS kind FROM keyed),
damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN kind = 3 THEN [1, 2] ELSE [1] END) AS copy
  FROM drawn WHERE kind <> 0),
ordered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS seen,
    lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS before FROM damaged),
faulty AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 1 WHEN seen > 1 THEN 2 WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') THEN 3 ELSE 0 END AS fault FROM ordered),
coded AS (SELECT *, CASE WHEN fault IN (1, 2) THEN 0 ELSE 1 + 2 * CASE left(role, 1) WHEN 's' THEN 0 WHEN 'u' THEN 1 WHEN 'a' THEN 2 ELSE 3 END + CASE WHEN fault = 3 THEN 1 ELSE 0 END END AS symbol FROM faulty),
arcs(symbol, q, p, label, w) AS (VALUES {arcs}),
inserts(p, q, label, w, said) AS (VALUES (0, 0, '', 0, ''), (1, 1, '', 0, ''), (2, 2, '', 0, ''), (3, 3, '', 0, ''), (0, 2, 'I', 3, chr(10) || 'user:'), (1, 2, 'I', 3, chr(10) || 'user:'), (2, 3, 'I', 3, chr(10) || 'assistant:'),
  (3, 2, 'I', 3, chr(10) || 'user:'), (0, 3, 'II', 6, chr(10) || 'user:' || chr(10) || 'assistant:'), (1, 3, 'II', 6, chr(10) || 'user:' || chr(10) || 'assistant:')),
ids AS (SELECT DISTINCT conv_id FROM {table}),
best(conv_id, i, q, b) AS (
  SELECT conv_id, 0::BIGINT, x.q, {{'cost': x.w, 'audit': x.label, 'said': x.said}} FROM ids, inserts x WHERE x.p = 0
  UNION ALL
  SELECT b.conv_id, b.i + 1, x.q, min({{'cost': b.b.cost + a.w + x.w, 'audit': b.b.audit || a.label || x.label,
    'said': b.b.said || CASE a.label WHEN 'D' THEN '' WHEN 'K' THEN chr(10) || c.role || ':' || c.text ELSE chr(10) || CASE a.p WHEN 2 THEN 'user' ELSE 'assistant' END || ':' || c.text END || x.said}})
  FROM best b JOIN coded c ON c.conv_id IS NOT DISTINCT FROM b.conv_id AND c.i = b.i + 1 JOIN arcs a ON a.symbol = c.symbol AND a.q = b.q JOIN inserts x ON x.p = a.p GROUP BY 1, 2, 3),
counted AS (
  SELECT conv_id, count(*) AS rows, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated,
    count(*) FILTER (before IS NOT NULL AND left(before, 1) || left(role, 1) NOT IN ('su', 'ua', 'au')) AS illegal FROM coded GROUP BY 1),
ended AS (SELECT b.conv_id, b.i, min(b.b) AS b FROM best b WHERE b.q IN (0, 3) GROUP BY 1, 2)
SELECT d.conv_id, coalesce(n.gaps, 0) AS gaps, coalesce(n.blank, 0) AS blank, coalesce(n.duplicate, 0) AS duplicate, coalesce(n.truncated, 0) AS truncated, coalesce(n.illegal, 0) AS illegal,
  CAST(e.b.cost AS BIGINT) AS cost, e.b.audit AS audit, sha256(substr(e.b.said, 2)) AS repaired_sha256
FROM ids d LEFT JOIN counted n ON n.conv_id IS NOT DISTINCT FROM d.conv_id JOIN ended e ON e.conv_id IS NOT DISTINCT FROM d.conv_id AND e.i = coalesce(n.rows, 0)"""
