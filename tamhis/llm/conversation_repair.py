"""Repair of the structure of conversations: cheapest edits by lookups of whole blocks of rows."""

import hashlib
from functools import cache
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tamhis.llm.common import col
from tamhis.workspace import release, written

#: Cost of the edits, and what a truncated row costs that stays.
DELETE, REROLE, INSERT, TRUNCATED = 2, 1, 5, 5
#: Rows of a block, and binary digits of the row numbers of a segment.
BLOCK, SEGMENT_BITS = 4, 16
#: White space of a text.
SPACE = " \t\n\x0b\x0c\r"

#: States of ``(s?(ua)+)?``: nothing yet, after s, after u, after a. The role that leads on, and the state it leads to.
LEADS = (("u", 2), ("u", 2), ("a", 3), ("u", 2))
KEEPS = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
#: Cost of ending in each state: nothing, insert user and assistant, insert assistant, nothing.
END = (0, 2 * INSERT, INSERT, 0)
#: Symbols of rows: initial s, u, a or another (0-3), the same of truncated rows (4-7), a row that must go, no row.
INITIALS, GONE, NO_ROW = "sua?", 8, 9
SYMBOLS = 10


def options(symbol: int, state: int) -> list[tuple[str, int, int]]:
    """(letter, cost, next state) of the edits that consume a row."""
    found, penalty = [("D", DELETE, state)], TRUNCATED if 4 <= symbol < GONE else 0
    if symbol != GONE:
        to = KEEPS[state].get(INITIALS[symbol % 4])
        if to is not None:
            found.append(("K", penalty, to))
        found.append(("R", REROLE + penalty, LEADS[state][1]))
    return found


def before(symbol: int, after) -> tuple:
    """The costs to go in the four states in front of a row, from those behind it."""
    if symbol == NO_ROW:
        return tuple(after)
    cost = [min(c + after[to] for _, c, to in options(symbol, state)) for state in range(4)]
    cost[2], cost[3] = min(cost[2], INSERT + cost[3]), min(cost[3], INSERT + cost[2])
    return min(cost[0], INSERT + cost[2]), min(cost[1], INSERT + cost[2]), cost[2], cost[3]


class Tables:
    """Normalised cost vectors (least entry 0) and, for every block of symbols, which vector it turns each into and what
    it adds. Vectors are numbered in the order they are reached from the end of a conversation, which is 0."""

    def __init__(self, size: int = BLOCK):
        self.size, self.vectors, number, step, add = size, [END], {END: 0}, [], []
        while len(step) < len(self.vectors):
            to, plus = [], []
            for symbol in range(SYMBOLS):
                raw = before(symbol, self.vectors[len(step)])
                least = min(raw)
                vector = tuple(c - least for c in raw)
                if vector not in number:
                    number[vector] = len(self.vectors)
                    self.vectors.append(vector)
                to.append(number[vector])
                plus.append(least)
            step.append(to)
            add.append(plus)
        one, more = np.array(step).T, np.array(add).T  # (symbol, vector)
        self.to, self.add = np.arange(len(step))[None, :], np.zeros((1, len(step)), np.int64)
        for _ in range(size):  # a symbol in front of every block so far
            self.add = (self.add[None] + more[:, self.to]).reshape(-1, len(step))
            self.to = one[:, self.to].reshape(-1, len(step))
        self.symbols = list(product(range(SYMBOLS), repeat=size))
        self.trace = cache(self._trace)

    def blocks(self, symbols: np.ndarray) -> np.ndarray:
        """Block numbers of a sequence of symbols, filled up at its end."""
        padded = np.full(-(-len(symbols) // self.size) * self.size, NO_ROW)
        padded[:len(symbols)] = symbols
        return padded.reshape(-1, self.size) @ SYMBOLS ** np.arange(self.size - 1, -1, -1)

    def transition(self, blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Vector in front and cost added, for every vector behind the blocks."""
        at, cost = np.arange(len(self.vectors)), np.zeros(len(self.vectors), np.int64)
        for block in blocks[::-1]:
            cost += self.add[block, at]
            at = self.to[block, at]
        return at, cost

    def _trace(self, block: int, behind: int, state: int) -> tuple[tuple, int]:
        """The edits of each row of a block and the state behind it, given the vector behind and the state in front.

        The block is expanded from its end, then walked from its front: of the cheapest edits the first letter
        of D, I, K, R is taken each time, which gives the least sequence because none is the beginning of another of equal cost.
        """
        symbols = self.symbols[block]
        costs = [self.vectors[behind]]
        for symbol in reversed(symbols):
            costs.append(before(symbol, costs[-1]))
        costs.reverse()
        rows = []
        for i, symbol in enumerate(symbols):
            if symbol == NO_ROW:
                continue
            edits = ""
            while True:
                left = costs[i][state]
                role, to = LEADS[state]
                able = {letter: n for letter, cost, n in options(symbol, state) if cost + costs[i + 1][n] == left}
                if "D" not in able and INSERT + costs[i][to] == left:
                    edits += role
                    state = to
                    continue
                letter = min(able)
                edits += {"D": "D", "K": "K", "R": role.upper()}[letter]
                state = able[letter]
                break
            rows.append(edits)
        return tuple(rows), state

    def edits(self, blocks: np.ndarray, behind: int, state: int) -> tuple[list, int]:
        """The edits of every row of a sequence of blocks, and the state behind it."""
        ends = [behind]
        for block in blocks[::-1]:
            ends.append(int(self.to[block, ends[-1]]))
        rows = []
        for block, after in zip(blocks.tolist(), ends[-2::-1]):
            found, state = self.trace(block, after, state)
            rows += found
        return rows, state


@cache
def tables() -> Tables:
    return Tables()


#: Edits that remain behind the last row, by state.
TAIL = ("", "ua", "a", "")
#: Letters of edits, beside D and K: inserted user and assistant, rows made user and assistant; and those of the audit.
EDITS, AUDIT = "uaUA", "IIRR"


def numbered(rows: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """(conv, turn, role, text, digest, blank, cut, seq): rows in the order of conversations and turns, ``seq`` rising with it."""
    role_of, text_of = (F.coalesce(col(c).cast("string"), F.lit(" ")) for c in (role, text))
    source = rows.select(col(conv).alias("conv"), col(turn).alias("turn"), role_of.alias("role"), text_of.alias("text"))
    trimmed = F.rtrim("text", F.lit(SPACE))
    source = source.withColumns({
        "digest": F.unhex(F.md5(F.concat_ws(":", F.length("role").cast("string"), "role", "text"))),
        "blank": trimmed == "", "cut": ~F.substring(trimmed, -1, 1).isin(".", "!", "?")})
    ordered = source.orderBy(F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_first(), "digest")
    return ordered.withColumn("seq", F.monotonically_increasing_id())


def _judged(rows: DataFrame) -> DataFrame:
    """(conv, turn, seq, fault, code) without texts: the first fault of a row ('' if none), and its initial and symbol."""
    first = rows.groupBy("conv", "digest").agg(F.min("seq").alias("seq")).select("seq", F.lit(True).alias("first"))
    short = rows.select("conv", "turn", "seq", "blank", "cut", F.substring("role", 1, 1).alias("initial")).join(first, "seq", "left")
    fault = F.when(F.col("blank"), "blank").when(F.col("first").isNull(), "duplicate").when(F.col("cut"), "truncated").otherwise("")
    initial = F.when(F.col("initial") == "s", 0).when(F.col("initial") == "u", 1).when(F.col("initial") == "a", 2).otherwise(3)
    symbol = F.when(F.col("fault").isin("blank", "duplicate"), GONE).when(F.col("fault") == "truncated", initial + 4).otherwise(initial)
    return short.withColumn("fault", fault).select("conv", "turn", "seq", "fault", (initial * 16 + symbol).alias("code"))


def _segments(judged: DataFrame) -> DataFrame:
    """(conv, seg, seqs, codes): at most 65,536 rows that follow each other; ``seg`` is the first one's ``seq``."""
    grouped = judged.groupBy("conv", F.shiftright("seq", SEGMENT_BITS).alias("part")).agg(
        F.sort_array(F.collect_list(F.struct("seq", "code"))).alias("rows"))
    return grouped.select("conv", F.col("rows")[0]["seq"].alias("seg"), F.col("rows.seq").alias("seqs"), F.col("rows.code").alias("codes"))


def _walk(table: DataFrame, order, schema, step):
    """Rows of a conversation one after the other through ``step(state, row) -> (state, result)``; the state starts as None.

    Conversations are dealt to tasks and sorted there, so what is held is a batch of rows, however long a conversation.
    """
    names = [f.name for f in schema]

    def run(batches):
        state, at = None, object()
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row["conv"] != at:
                    state, at = None, row["conv"]
                state, result = step(state, row)
                out.append(result)
            yield pa.RecordBatch.from_arrays([
                pa.array([r[i] for r in out], batch.schema.field(n).type if n in batch.schema.names else None)
                for i, n in enumerate(names)], names)

    return table.repartition("conv").sortWithinPartitions(F.col("conv").asc_nulls_first(), *order).mapInArrow(run, schema)


def _measured(segments: DataFrame) -> DataFrame:
    """(conv, seg, to, add, first, last, illegal): a segment's transition, its outer initials and its illegal pairs."""
    schema = T.StructType([segments.schema["conv"], T.StructField("seg", T.LongType()), T.StructField("to", T.ArrayType(T.LongType())), T.StructField(
        "add", T.ArrayType(T.LongType())), *[T.StructField(n, T.LongType()) for n in ("first", "last", "illegal")]])

    def run(batches):
        table = tables()
        for batch in batches:
            out = []
            for codes in batch.column("codes"):
                code = codes.values.to_numpy()
                to, add = table.transition(table.blocks(code % 16))
                initial = code // 16
                out.append((to, add, int(initial[0]), int(initial[-1]), int((~legal(initial[:-1], initial[1:])).sum())))
            kinds = (pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv"), batch.column("seg"), *[pa.array(list(c), k) for c, k in zip(zip(*out), kinds)]] if out else
                [batch.column("conv"), batch.column("seg"), *[pa.array([], k) for k in kinds]], schema.names)

    return segments.select("conv", "seg", "codes").mapInArrow(run, schema)


def legal(a, b):
    """su, ua or au."""
    return (a == 0) & (b == 1) | (a == 1) & (b == 2) | (a == 2) & (b == 1)


def _costed(measured: DataFrame) -> DataFrame:
    """(conv, seg, behind, cost, illegal): from the last segment to the first, the vector behind each, the cost from
    it on and the illegal pairs from it on."""
    schema = T.StructType([measured.schema["conv"], *[T.StructField(n, T.LongType()) for n in ("seg", "behind", "cost", "illegal")]])
    vectors = tables().vectors

    def step(state, row):
        behind, cost, illegal, initial = state or (0, 0, 0, None)
        to, cost = row["to"][behind], cost + row["add"][behind]
        illegal += row["illegal"] + (initial is not None and not legal(row["last"], initial))
        return (to, cost, illegal, row["first"]), (row["conv"], row["seg"], behind, cost + vectors[to][0], illegal)

    return _walk(measured, [F.desc("seg")], schema, step)


def _traced(segments: DataFrame, costed: DataFrame) -> DataFrame:
    """(conv, seg, seqs, edits): the edits of every row, those behind the last one added to it.

    A segment is traced for each state that it can start in, as the one it does start in depends on the segments before.
    """
    firsts = costed.groupBy("conv").agg(F.min("seg").alias("seg"), F.max("seg").alias("last"))
    known = costed.select("seg", "behind").join(firsts.select("seg", F.lit(True).alias("opens")), "seg", "left")
    known = known.join(firsts.select(F.col("last").alias("seg"), F.lit(True).alias("closes")), "seg", "left")
    kind = T.ArrayType(T.ArrayType(T.StringType()))
    schema = T.StructType([*segments.schema.fields[:3], T.StructField("edits", kind), T.StructField("ends", T.ArrayType(T.LongType())), T.StructField("closes", T.BooleanType())])

    def run(batches):
        table = tables()
        for batch in batches:
            edits, ends = [], []
            for codes, behind, opens in zip(batch.column("codes"), batch.column("behind").to_pylist(), batch.column("opens").to_pylist()):
                blocks = table.blocks(codes.values.to_numpy() % 16)
                found = [table.edits(blocks, behind, state) for state in range(1 if opens else 4)]
                edits.append([e for e, _ in found])
                ends.append([s for _, s in found])
            yield pa.RecordBatch.from_arrays([
                *[batch.column(n) for n in ("conv", "seg", "seqs")], pa.array(edits, pa.list_(pa.list_(pa.string()))), pa.array(ends, pa.list_(pa.int64())),
                batch.column("closes")], schema.names)

    traced = written(segments.join(known, "seg").select("conv", "seg", "seqs", "codes", "behind", "opens", "closes").mapInArrow(run, schema), "repair-traces")

    def step(state, row):
        state = state or 0
        return row["ends"][state], (row["conv"], row["seg"], state, row["ends"][state])

    states = _walk(traced.select("conv", "seg", "ends"), ["seg"], T.StructType([
        traced.schema["conv"], *[T.StructField(n, T.LongType()) for n in ("seg", "state", "end")]]), step).drop("conv")
    tail = F.when(F.col("closes"), F.element_at(F.array(*map(F.lit, TAIL)), F.col("end").cast("int") + 1)).otherwise("")
    own = F.element_at("edits", F.col("state").cast("int") + 1)
    closed = F.concat(F.slice(own, 1, F.size(own) - 1), F.array(F.concat(F.element_at(own, -1), tail)))
    result = written(traced.join(states, "seg").select("conv", "seg", "seqs", closed.alias("edits")), "repair-edits")
    release(traced)
    return result


class Repair:
    """The outcome of ``repair``: ``conversations``, one row each, and ``messages``, the repaired rows."""

    def __init__(self, conversations: DataFrame, messages: DataFrame, held: list):
        self.conversations, self.messages, self.held = conversations, messages, held

    def release(self) -> None:
        """Delete the tables that both are read from."""
        for table in self.held:
            release(table)


def repair(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> Repair:
    """The cheapest edits that give every conversation roles of the form ``(s?(ua)+)?``, by the initials of its roles.

    Keeping a row costs 0, making it user or assistant 1, deleting it 2 and inserting an empty user or assistant row 5; a
    truncated row that stays costs 5 more; blank rows and duplicates must be deleted. A row's first fault counts: blank (no
    character but white space), duplicate (role and text seen before in the conversation) or truncated (last character
    that is not white space none of ``.!?``). Of the cheapest sequences of edits the least by the initials D, I, K, R is taken.

    ``conversations``: conv, gaps, blank, duplicate, truncated, illegal (adjacent initials other than su, ua, au), cost
    (longs), audit. ``messages``: conv, seq, part (order), turn (null for an inserted row), role, text, edit (insert, keep
    or rerole).

    Rows go by turn, nulls first; rows of one turn in the order of a digest of role and text (equal ones are repetitions). A null
    role or text is one space; a null conversation id is one like others; extra columns are ignored; an empty table gives no rows.

    Rows are sorted and numbered once and then travel without texts, in segments of at most 65,536 rows. A segment
    is worked through by blocks of four rows: a table gives for every block and every normalised vector of costs to go behind
    it the vector in front and the cost added. A segment's transition holds for all vectors, so segments of a
    long conversation are worked at the same time and joined afterwards, one small row each; then blocks are
    expanded backwards where the edits are traced, for all four states a segment can start in.
    """
    numbers = written(numbered(rows, conv, turn, role, text), "repair-rows")
    judged = written(_judged(numbers), "repair-judged")
    segments = written(_segments(judged), "repair-segments")
    costed = written(_costed(_measured(segments)), "repair-costs")
    traced = _traced(segments, costed)
    release(segments)
    counts = judged.groupBy("conv").agg(
        (F.max("turn").cast("long") - F.min("turn").cast("long") + 1).alias("span"),
        *[F.count(F.when(F.col("fault") == f, 1)).alias(f) for f in ("blank", "duplicate", "truncated")])
    turns = judged.select("conv", "turn").distinct().groupBy("conv").agg(F.count("turn").alias("turns"))
    totals = costed.groupBy("conv").agg(F.min_by("cost", "seg").alias("cost"), F.min_by("illegal", "seg").alias("illegal"))
    letters = F.translate(F.array_join("edits", ""), EDITS, AUDIT)
    audits = traced.select("conv", F.struct("seg", letters.alias("a")).alias("p")).groupBy("conv").agg(
        F.array_join(F.sort_array(F.collect_list("p"))["a"], "").alias("audit"))
    found = counts
    for more in (turns, totals, audits):
        own = more.withColumnRenamed("conv", "conv_")
        found = found.join(own, found["conv"].eqNullSafe(own["conv_"])).drop("conv_")
    conversations = found.select(
        F.col("conv").alias(conv), F.coalesce(F.col("span") - F.col("turns"), F.lit(0)).cast("long").alias("gaps"), "blank", "duplicate", "truncated",
        "illegal", "cost", "audit")
    single = traced.select(F.explode(F.arrays_zip("seqs", "edits")).alias("z")).select(F.col("z.seqs").alias("seq"), F.col("z.edits").alias("edits"))
    parts = single.join(numbers.select("conv", "seq", "turn", "role", "text"), "seq").select(
        "conv", "seq", "turn", "role", "text", F.posexplode(F.split("edits", "")).alias("part", "e")).filter("e not in ('D', '')")
    inserted = F.col("e").isin("u", "a")
    messages = parts.select(
        F.col("conv").alias(conv), "seq", "part", F.when(~inserted, F.col("turn")).alias("turn"),
        F.when(F.col("e") == "K", F.col("role")).when(F.lower("e") == "u", "user").otherwise("assistant").alias("role"),
        F.when(inserted, "").otherwise(F.col("text")).alias("text"),
        F.when(inserted, "insert").when(F.col("e") == "K", "keep").otherwise("rerole").alias("edit"))
    return Repair(conversations, messages, [numbers, judged, costed, traced])


def transcripts(messages: DataFrame, conv: str = "conv_id") -> DataFrame:
    """(conv, sha256): the SHA-256 of a conversation's messages, ``role:text`` joined by line breaks, in their order.

    The digest of one text is sequential work; a task reads sorted messages one after the other and holds only a batch.
    """
    lines = messages.select(col(conv).alias("conv"), "seq", "part", F.concat("role", F.lit(":"), "text").cast("binary").alias("line"))
    schema = T.StructType([lines.schema["conv"], T.StructField("sha256", T.StringType())])

    def run(batches):
        state, at, done, kind = None, None, [], None
        for batch in batches:
            kind = batch.schema.field(0).type
            for own, line in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if state is None or own != at:
                    if state is not None:
                        done.append((at, state.hexdigest()))
                    state, at = hashlib.sha256(line), own
                else:
                    state.update(b"\n")
                    state.update(line)
            if len(done) > 1000:
                yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], kind), pa.array([d[1] for d in done])], schema.names)
                done = []
        if state is not None:
            done.append((at, state.hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], kind), pa.array([d[1] for d in done])], schema.names)

    ordered = lines.repartition("conv").sortWithinPartitions(F.col("conv").asc_nulls_first(), "seq", "part").select("conv", "line")
    return ordered.mapInArrow(run, schema).withColumnRenamed("conv", conv)
