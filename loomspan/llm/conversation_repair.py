"""Repair of conversation structure: a forward Viterbi pass over four grammar states.

A conversation is right if the initials of its roles read ``(s?(ua)+)?``. States: nothing yet, after *s*, after *u*, after *a*; the first and
the last are ends. Each turn is a layer: it is kept, given another role, or deleted; each layer is closed by at most two inserted
turns (a third would only come back). A state carries the least ``(cost, audit)``, where ``audit`` has one letter an edit, so the best audit
also names the repaired turns.

A conversation may be of any length: turns are range-partitioned in order and cut into *pieces*. A piece whose start state is not
known is folded from each of the four; such maps compose, so pieces fold apart and one row a piece meets in the
last fold. What is folded are marks (initial, fault, order), never texts. Texts move once: they stream, in order, beside the chosen audits, and
one row at a time is held. Only that stream, whose digest is a chain by its nature, passes a whole conversation through one task.

Defined cases: null ids, turns, roles and texts: a null id is a conversation of its own, null turns come first, a null role or text is one space; turns
of equal number go by role, then by the SHA-256 of the text; rows repeated whole are adjacent, all but the first are duplicates; very
long texts are read whole; other columns do not matter, whatever their names; an empty table gives an empty result.
An audit is one string, so a conversation may have about two billion turns.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspan.llm.common import join_hot
from loomspan.operators.ranges import range_count
from loomspan.storage import materialize

KEEP, REROLE, DELETE, INSERT = 0, 3, 4, 3
TRUNCATED = 3
#: Turns of a piece, at most.
PIECE = 2_048
#: Space and the control characters that count as blank.
BLANK = " \t\n\x0b\x0c\r"

_EMPTY, _SYSTEM, _USER, _ASSISTANT = range(4)
#: From a state by an initial.
_NEXT = {(_EMPTY, "s"): _SYSTEM, (_EMPTY, "u"): _USER, (_SYSTEM, "u"): _USER, (_ASSISTANT, "u"): _USER, (_USER, "a"): _ASSISTANT}
#: The state that an inserted turn, or one of another role, leads to.
_FORCED = (_USER, _USER, _ASSISTANT, _USER)
_LEGAL = {"su", "ua", "au"}

Layer = list[tuple[int, str] | None]


def closed(layer: Layer) -> Layer:
    """The layer after up to two inserted turns."""
    for _ in range(2):
        grown = list(layer)
        for state, best in enumerate(layer):
            if best is not None:
                _better(grown, _FORCED[state], best[0] + INSERT, best[1] + "I")
        layer = grown
    return layer


def _better(layer: Layer, state: int, cost: int, audit: str) -> None:
    now = layer[state]
    if now is None or (cost, audit) < now:
        layer[state] = (cost, audit)


def advanced(layer: Layer, initial: str, fault: str, copies: int) -> Layer:
    """The layer after one turn and ``copies - 1`` repeats of it, closed."""
    out: Layer = [None] * 4
    for state, best in enumerate(layer):
        if best is None:
            continue
        cost, audit = best
        _better(out, state, cost + DELETE, audit + "D")
        if fault in ("blank", "duplicate"):
            continue
        cost += TRUNCATED if fault == "truncated" else 0
        if (state, initial) in _NEXT:
            _better(out, _NEXT[state, initial], cost + KEEP, audit + "K")
        _better(out, _FORCED[state], cost + REROLE, audit + "R")
    if copies > 1:  # repeats go, and before any inserted turn: D sorts before I
        out = [best and (best[0] + DELETE * (copies - 1), best[1] + "D" * (copies - 1)) for best in out]
    return closed(out)


def damaged(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` with faults put in by a checksum of conversation and turn."""
    one = F.lit(" ")
    conv, turn = F.col("conv_id"), F.col("turn")
    said = conversations.select(
        conv, turn, F.coalesce("role", one).alias("role"), F.coalesce("text", one).alias("text"),
        (F.crc32(F.concat(F.coalesce(conv.cast("string"), one), F.lit(":"), F.coalesce(turn.cast("string"), one))) % 20).alias("fault"),
    )
    role = F.when(F.col("fault") == 4, "user").otherwise(F.col("role"))
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    times = F.sequence(F.lit(1), F.when(F.col("fault") == 3, 2).otherwise(1))
    return said.where("fault <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(times).alias("_time")).drop("_time")


def _named(turns: DataFrame) -> DataFrame:
    """``conv`` (never null), ``turn, role, text, digest``."""
    text = F.coalesce("text", F.lit(" "))
    return turns.select(conversation_key().alias("conv"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), text.alias("text"), F.unhex(F.sha2(text, 256)).alias("digest"))


def conversation_key() -> Column:
    return F.coalesce(F.concat(F.lit("+"), F.col("conv_id").cast("string")), F.lit("-"))


ORDER = ["conv", "turn", "role", "digest"]


def marks(turns: DataFrame) -> DataFrame:
    """One row per distinct turn of each conversation: ``conv, turn, role, digest, copies, fault``; ``fault`` is the first copy's."""
    body = F.rtrim("text", F.lit(BLANK))
    last = F.right(body, F.lit(1))
    fault = F.when(body == "", "blank").when(~last.isin(".", "!", "?"), "truncated").otherwise("")
    own = materialize(_named(turns).withColumn("fault", fault).groupBy(*ORDER).agg(F.count("*").alias("copies"), F.first("fault").alias("fault")))
    first = own.groupBy("conv", "role", "digest").agg(F.min(F.struct("turn")).alias("first"), F.count("*").alias("times"))
    repeated = join_hot(own, materialize(first.where("times > 1")), ["conv", "role", "digest"], "times").where(~F.col("turn").eqNullSafe(F.col("first.turn")))
    later = repeated.select(*ORDER, "copies", F.when(F.col("fault") == "blank", "blank").otherwise("duplicate").alias("fault"))
    return own.unionByName(later).groupBy(*ORDER).agg(F.max("copies").alias("copies"), F.min(F.when(F.col("fault").isin("blank", "duplicate"), F.col("fault"))).alias("_gone"), F.max("fault").alias("_any")).select(*ORDER, "copies", F.coalesce("_gone", "_any").alias("fault"))


PIECES = "conv string, part int, no int, turn long, role string, digest binary, starts array<int>, costs array<long>, audits array<string>, first_initial string, last_initial string, least long, most long, distinct long, blank long, duplicate long, truncated long, illegal long"


def pieces(marked: DataFrame, piece: int = PIECE) -> DataFrame:
    """One row per piece: where it stands and begins, its map (``starts`` of -1: from the conversation's start; for each start four costs and
    audits, null where a state is not reached), and its counts."""
    dealt = marked.repartitionByRange(range_count(marked), *ORDER).sortWithinPartitions(*ORDER)
    rows = dealt.select(*ORDER, F.left("role", F.lit(1)).alias("initial"), "copies", "fault", F.spark_partition_id().alias("part"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, head, layers, n, no, seen = None, None, {}, 0, 0, False
        out: list[dict] = []

        def flush() -> None:
            head["costs"] = [best and best[0] for s in head["starts"] for best in layers[s]]
            head["audits"] = [best and best[1] for s in head["starts"] for best in layers[s]]
            out.append(head)

        for batch in batches:
            for row in batch.to_pylist():
                fresh = row["conv"] != conv
                if fresh or n == piece:
                    if head is not None:
                        flush()
                    # only the first conversation of a partition may have begun before it
                    known = fresh and seen
                    conv, n, no, seen = row["conv"], 0, 0 if fresh else no + 1, True
                    layers = {-1: closed([(0, ""), None, None, None])} if known else {s: [(0, "") if s == k else None for k in range(4)] for s in range(4)}
                    head = {"conv": conv, "part": row["part"], "no": no, "turn": row["turn"], "role": row["role"], "digest": row["digest"], "starts": list(layers), "first_initial": row["initial"], "last_initial": None, "least": row["turn"], "most": None, "distinct": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0}
                copies, fault, turn = row["copies"], row["fault"], row["turn"]
                layers = {s: advanced(layer, row["initial"], fault, copies) for s, layer in layers.items()}
                if turn is not None:
                    head["least"] = turn if head["least"] is None else head["least"]
                    head["distinct"] += turn != head["most"]
                    head["most"] = turn
                if fault == "blank":
                    head["blank"] += copies
                else:
                    head["duplicate"] += copies - (fault != "duplicate")
                    head["truncated"] += fault == "truncated"
                head["illegal"] += copies - 1
                if n:
                    head["illegal"] += head["last_initial"] + row["initial"] not in _LEGAL
                head["last_initial"] = row["initial"]
                n += 1
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)
                out = []
        if head is not None:
            flush()
            yield pa.RecordBatch.from_pylist(out, schema)

    schema = _arrow(PIECES)
    return rows.mapInArrow(run, PIECES)


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "array<int>": pa.list_(pa.int32()), "array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string())}
    return pa.schema([(f.split(" ")[0], kinds[f.split(" ")[1]]) for f in ddl.split(", ")])


FOLDED = "conv string, turn long, role string, digest binary, audit string, whole string, cost long, gaps long, blank long, duplicate long, truncated long, illegal long"


def folded(cut: DataFrame) -> DataFrame:
    """One row per piece of ``pieces`` with the ``audit`` that is chosen for it; the first row of a conversation also has its counts, its
    ``cost`` and its ``whole`` audit."""
    dealt = cut.repartition("conv").sortWithinPartitions("conv", "part", "no")
    schema = _arrow(FOLDED)

    def solved(parts: list[dict]) -> list[dict]:
        layer, back = closed([(0, ""), None, None, None]), []
        for p in parts:
            own = list(zip(p["costs"], p["audits"]))
            if p["starts"] == [-1]:
                layer = [None if c is None else (c, a) for c, a in own]
                back.append([(None, a) for _, a in own])
                continue
            grown: Layer = [None] * 4
            came: list = [None] * 4
            for start, before in enumerate(layer):
                for end, (cost, audit) in enumerate(own[4 * start : 4 * start + 4]):
                    if before is not None and cost is not None:
                        new = (before[0] + cost, before[1] + audit)
                        if grown[end] is None or new < grown[end]:
                            grown[end], came[end] = new, (start, audit if back else before[1] + audit)
            layer = grown
            back.append(came)
        state = min((s for s in (_EMPTY, _ASSISTANT) if layer[s] is not None), key=lambda s: layer[s])
        cost, whole = layer[state]
        rows: list[dict] = []
        for p, came in zip(reversed(parts), reversed(back)):
            state, audit = came[state]
            rows.append({k: p[k] for k in ORDER} | {"audit": audit})
        rows.reverse()
        counts = {k: sum(p[k] for p in parts) for k in ("blank", "duplicate", "truncated", "illegal")}
        counts["illegal"] += sum(x["last_initial"] + y["first_initial"] not in _LEGAL for x, y in zip(parts, parts[1:]))
        known = [p for p in parts if p["least"] is not None]
        distinct = sum(p["distinct"] for p in known) - sum(x["most"] == y["least"] for x, y in zip(known, known[1:]))
        gaps = known[-1]["most"] - known[0]["least"] + 1 - distinct if known else 0
        rows[0] |= {"whole": whole, "cost": cost, "gaps": gaps, **counts}
        return rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, parts = None, []
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row["conv"] != conv and parts:
                    out += solved(parts)
                    parts = []
                conv = row["conv"]
                parts.append(row)
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)
        if parts:
            yield pa.RecordBatch.from_pylist(solved(parts), schema)

    return dealt.mapInArrow(run, FOLDED)


REPAIRED = "conv string, role string, text string, edit string"


def repaired_turns(turns: DataFrame, solved: DataFrame) -> DataFrame:
    """``conv, role, text, edit`` of what stays and what is inserted, in order within each conversation, which is whole in one partition.

    ``solved``: rows of ``folded``. The audits, the turns and nothing else are dealt by conversation and streamed in order.
    """
    said = _named(turns).withColumns({"tag": F.lit(1), "audit": F.lit(None).cast("string")})
    heads = solved.select(*ORDER, F.lit(None).cast("string").alias("text"), F.lit(0).alias("tag"), "audit")
    both = said.select(*ORDER, "text", "tag", "audit").unionByName(heads)
    dealt = both.repartition("conv").sortWithinPartitions(*ORDER, "tag")
    schema = _arrow(REPAIRED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, audit, at = None, _EMPTY, "", 0
        out: list[dict] = []

        def add(role: str, text: str, edit: str) -> None:
            out.append({"conv": now, "role": role, "text": text, "edit": edit})

        def inserts() -> None:
            nonlocal state, at
            while at < len(audit) and audit[at] == "I":
                state, at = _FORCED[state], at + 1
                add("user" if state == _USER else "assistant", "", "I")

        for batch in batches:
            for row in batch.to_pylist():
                if row["tag"] == 0:
                    inserts()
                    if row["conv"] != now:
                        now, state = row["conv"], _EMPTY
                    audit, at = row["audit"], 0
                    continue
                inserts()
                edit, at = audit[at], at + 1
                if edit == "K":
                    state = _NEXT[state, row["role"][:1]]
                    add(row["role"], row["text"], edit)
                elif edit == "R":
                    state = _FORCED[state]
                    add("user" if state == _USER else "assistant", row["text"], edit)
                if len(out) >= 512:
                    yield pa.RecordBatch.from_pylist(out, schema)
                    out = []
        inserts()
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)

    return dealt.mapInArrow(run, REPAIRED)


def _digests(repaired: DataFrame) -> DataFrame:
    """``conv, repaired_sha256`` of ``role:text`` joined by line feeds, of rows as ``repaired_turns`` gives them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, running = None, None
        names = ["conv", "repaired_sha256"]
        for batch in batches:
            done = []
            for own, role, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                line = f"{role}:{text}".encode()
                if own == conv:
                    running.update(b"\n" + line)
                    continue
                if running is not None:
                    done.append((conv, running.hexdigest()))
                conv, running = own, hashlib.sha256(line)
            if done:
                yield pa.record_batch([pa.array(x) for x in zip(*done)], names)
        if running is not None:
            yield pa.record_batch([pa.array([conv]), pa.array([running.hexdigest()])], names)

    return repaired.mapInArrow(run, "conv string, repaired_sha256 string")


def repair_report(turns: DataFrame, ids: DataFrame, piece: int = PIECE) -> DataFrame:
    """For each ``conv_id`` of ``ids``: ``gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256`` of its ``turns``
    (``conv_id, turn, role, text``); one without turns has zeros, an empty audit and the digest of nothing."""
    solved = materialize(folded(pieces(marks(turns), piece)))
    digests = _digests(repaired_turns(turns, solved))
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    known = solved.where("cost is not null").select("conv", *names, F.col("whole").alias("audit"))
    all_ids = ids.select("conv_id").distinct().withColumn("conv", conversation_key())
    met = all_ids.join(known, "conv", "left").join(digests, "conv", "left")
    nothing = hashlib.sha256(b"").hexdigest()
    return met.select("conv_id", *[F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in names], F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256"))


def op12_conversation_repair(conversations: DataFrame) -> DataFrame:
    """The report of every conversation after damage."""
    return repair_report(damaged(conversations), conversations)


def _add(x: str, cost: str, letter: str) -> str:
    return f"CASE WHEN {x} IS NOT NULL THEN lpad((left({x}, 9)::BIGINT + {cost})::VARCHAR, 9, '0') || substr({x}, 10) || '{letter}' END"


def oracle_sql() -> str:
    """A state is one string, the cost in nine digits and the audit: the least string is the least cost, then audit."""
    blank = r"[\x20\x09-\x0D]"
    any_of = "least(e, s, a)"
    return rf"""WITH RECURSIVE said AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name FROM conversations),
summed AS (SELECT *, xor(list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(name, ''), lambda c: [unicode(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))), lambda x, y: CASE WHEN y >= 0 THEN xor(x, y) ELSE xor(x // 2, 3988292384 * (x % 2)) END), 4294967295) % 20 AS fault FROM said),
hurt AS (SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role, CASE fault WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(CASE WHEN fault = 3 THEN [1, 2] ELSE [1] END) AS time FROM summed WHERE fault <> 0),
placed AS (SELECT *, coalesce('+' || conv_id::VARCHAR, '-') AS conv, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), time) AS i, left(role, 1) AS initial FROM hurt),
seen AS (SELECT *, row_number() OVER (PARTITION BY conv, role, text ORDER BY i) > 1 AS again, initial || lead(initial) OVER (PARTITION BY conv ORDER BY i) AS pair, regexp_extract(text, '([^ 	-]){blank}*\z', 1) AS last FROM placed),
judged AS (SELECT *, CASE WHEN last = '' THEN 'blank' WHEN again THEN 'duplicate' WHEN last NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault, fault IN ('blank', 'duplicate') AS gone, CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END AS more FROM seen),
walk(conv, i, e, s, u, a) AS (SELECT DISTINCT conv, 0::BIGINT, '000000000', NULL::VARCHAR, '000000003I', '000000006II' FROM judged
UNION ALL SELECT conv, i, e, s, least(u2, {_add('least(e, s, a2)', '3', 'I')}), least(a2, {_add('u2', '3', 'I')}) FROM (SELECT *, least(u, {_add(any_of, '3', 'I')}) AS u2, least(a, {_add('u', '3', 'I')}) AS a2 FROM (
SELECT j.conv, j.i, {_add('e', '4', 'D')} AS e, least({_add('s', '4', 'D')}, CASE WHEN initial = 's' AND NOT gone THEN {_add('e', 'more', 'K')} END) AS s,
least({_add('u', '4', 'D')}, CASE WHEN initial = 'u' AND NOT gone THEN {_add(any_of, 'more', 'K')} END, CASE WHEN NOT gone THEN {_add(any_of, '3 + more', 'R')} END) AS u,
least({_add('a', '4', 'D')}, CASE WHEN initial = 'a' AND NOT gone THEN {_add('u', 'more', 'K')} END, CASE WHEN NOT gone THEN {_add('u', '3 + more', 'R')} END) AS a FROM walk JOIN judged j ON j.conv = walk.conv AND j.i = walk.i + 1))),
best AS (SELECT conv, left(v, 9)::BIGINT AS cost, substr(v, 10) AS audit FROM (SELECT conv, least(max_by(e, i), max_by(a, i)) AS v FROM walk GROUP BY conv)),
letters AS (SELECT conv, p, audit[p] AS l, sum(CASE WHEN audit[p] <> 'I' THEN 1 ELSE 0 END) OVER w AS i, sum(CASE WHEN audit[p] <> 'D' THEN 1 ELSE 0 END) OVER w AS k FROM (SELECT conv, audit, unnest(range(1, length(audit) + 1)) AS p FROM best) WINDOW w AS (PARTITION BY conv ORDER BY p)),
kept AS (SELECT letters.conv, p, l, k, role, text, coalesce(bool_or(k = 1 AND l = 'K' AND initial = 's') OVER (PARTITION BY letters.conv), false) AS s FROM letters LEFT JOIN judged ON judged.conv = letters.conv AND judged.i = letters.i AND l <> 'I' WHERE l <> 'D'),
texts AS (SELECT conv, sha256(string_agg(CASE WHEN l = 'K' THEN role WHEN (k - s::INTEGER) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || coalesce(text, ''), chr(10) ORDER BY p)) AS h FROM kept GROUP BY conv),
counts AS (SELECT conv, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair IS NOT NULL AND pair NOT IN ('su', 'ua', 'au')) AS illegal FROM judged GROUP BY conv)
SELECT conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit, coalesce(h, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, coalesce('+' || conv_id::VARCHAR, '-') AS conv FROM conversations) LEFT JOIN counts USING (conv) LEFT JOIN best USING (conv) LEFT JOIN texts USING (conv)"""
