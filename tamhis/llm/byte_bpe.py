"""Byte-level BPE: texts to token ids and back, by DuckDB queries over the different words of a partition."""

import base64
from itertools import chain

import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tamhis.llm.common import Lists, bounded, byte_lengths, col, fresh, kept

#: Largest rank file that is sent to the executors.
FILE_BYTES = 64 << 20
#: Different words (or runs of ids) and ids of theirs that a Python worker keeps.
WORDS, WORD_IDS = 500_000, 6_000_000
#: Words of more bytes contract all occurrences of their best pair at once.
SHORT_BYTES = 256
#: Rows and bytes (or ids) that go to the database at a time; one longer text goes alone.
ROWS, VOLUME = 2048, 3 << 20
#: A run of ids that is decoded as one has at most so many.
RUN_IDS = 64

#: Every word is a list of token ids. Its positions join the merge table, and the pair of the lowest rank, the leftmost
#: of equals, becomes one token; a word without a pair in the table has reached its fixpoint and is left as it is.
ENCODE = """
WITH RECURSIVE state(word, ids) USING KEY (word) AS (
    SELECT word, ids FROM words
    UNION ALL
    SELECT word, ids[:best % 4294967296 - 1] || [(best // 4294967296)::INTEGER] || ids[best % 4294967296 + 2:]
    FROM (SELECT word, min(rank * 4294967296 + place) AS best
          FROM (SELECT word, unnest(ids[:-2]) AS a, unnest(ids[2:]) AS b, unnest(range(1, len(ids))) AS place FROM state)
          JOIN merges USING (a, b) GROUP BY word)
    JOIN state USING (word))
SELECT word, ids FROM state ORDER BY word"""

#: The same with one row per token, for long words of an orderly vocabulary: of every stretch of adjacent pairs of
#: the lowest rank, the first, third, fifth .. are contracted at once. A token that was swallowed has a null id.
ENCODE_LONG = """
WITH RECURSIVE token(word, place, id) USING KEY (word, place) AS (
    SELECT word, unnest(range(len(ids))), unnest(ids) FROM words
    UNION ALL
    SELECT word, place, CASE WHEN swallowed THEN NULL WHEN contracted THEN rank ELSE id END
    FROM (SELECT *, coalesce(lag(contracted) OVER (PARTITION BY word ORDER BY place), false) AS swallowed
          FROM (SELECT *, hit AND (nth - max(CASE WHEN hit THEN 0 ELSE nth END) OVER (PARTITION BY word ORDER BY place)) % 2 = 1 AS contracted
                FROM (SELECT *, coalesce(rank = min(rank) OVER (PARTITION BY word), false) AS hit,
                             min(rank) OVER (PARTITION BY word) AS best,
                             row_number() OVER (PARTITION BY word ORDER BY place) AS nth
                      FROM (SELECT word, place, id, lead(id) OVER (PARTITION BY word ORDER BY place) AS next_id
                            FROM token WHERE id IS NOT NULL)
                      LEFT JOIN merges ON a = id AND b = next_id)))
    WHERE best IS NOT NULL)
SELECT word, list(id ORDER BY place) AS ids FROM token WHERE id IS NOT NULL GROUP BY word ORDER BY word"""

DECODE = """
SELECT run, string_agg(piece, '' ORDER BY place) AS piece
FROM (SELECT run, unnest(ids) AS id, unnest(range(len(ids))) AS place FROM runs) JOIN vocabulary USING (id)
GROUP BY run ORDER BY run"""


def read_ranks(path: str) -> bytes:
    """The content of a rank file: base64 of a token's bytes and its id per line, every single byte among them."""
    with open(path, "rb") as file:
        content = file.read(FILE_BYTES + 1)
    if len(content) > FILE_BYTES:
        raise ValueError(f"{path} is larger than {FILE_BYTES} bytes")
    return content


def parse(content: bytes) -> dict[bytes, int]:
    ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in content.splitlines() if line.strip())}
    if any(bytes([b]) not in ranks for b in range(256)):
        raise ValueError("a byte has no token of its own")
    return ranks


def merge_table(ranks: dict[bytes, int]) -> np.ndarray:
    """(left id, right id, id of both together) for every pair of tokens that is a token."""
    found = [(ranks[t[:i]], ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
    return np.array(found, np.int32).reshape(-1, 3)


def orderly(ranks: dict[bytes, int]) -> bool:
    """True if every token is reached from its bytes by merges of ascending rank, its own the last.

    Ranks learnt from counts are so. Then a contraction never makes a pair of lower rank, so that all
    occurrences of a word's lowest pair may be contracted at once.
    """
    for token, rank in ranks.items():
        parts, last = [token[i:i + 1] for i in range(len(token))], -1
        while len(parts) > 1:
            found = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
            best, i = min(found, default=(-1, 0))
            if best <= last and not (best == last >= 0):
                return False
            parts[i:i + 2], last = [parts[i] + parts[i + 1]], best
        if len(token) > 1 and last != rank:
            return False
    return True


def _connect() -> duckdb.DuckDBPyConnection:
    con = duckdb.connect(config={"threads": 1, "temp_directory": ""})
    con.execute("SET preserve_insertion_order = false")
    return con


def _store(con, name: str, rows: dict) -> None:
    con.register("found", pa.table(rows))
    con.execute(f"CREATE TABLE {name} AS SELECT * FROM found")
    con.unregister("found")


def _query(con, name: str, rows: dict, sql: str) -> pa.Table:
    con.register(name, pa.table(rows))
    found = con.sql(sql).to_arrow_table().combine_chunks()
    con.unregister(name)
    return found


def _lists(flat, sizes) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), pa.array(flat))


class Decoder:
    """Bytes of lists of ids, each list decoded by an aggregation in the order of its places."""

    def __init__(self, ranks: dict[bytes, int]):
        self.con = _connect()
        _store(self.con, "vocabulary", {"id": np.array(list(ranks.values()), np.int32), "piece": [t.decode("latin-1") for t in ranks]})

    def pieces(self, flat: np.ndarray, sizes) -> list[bytes]:
        found = _query(self.con, "runs", {"run": np.arange(len(sizes), dtype=np.int32), "ids": _lists(flat, sizes)}, DECODE)
        return [p.encode("latin-1") for p in found.column("piece").to_pylist()]


class Encoder:
    """Token ids of texts, and the bytes these stand for. Those of a (bounded) number of different words are kept."""

    def __init__(self, content: bytes, pattern: str, at_once: bool, with_bytes: bool = False):
        self.ranks, self.findall, self.at_once = parse(content), regex.compile(pattern).findall, at_once
        self.single = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        self.con, table = _connect(), merge_table(self.ranks)
        _store(self.con, "merges", {"a": table[:, 0], "b": table[:, 1], "rank": table[:, 2].astype(np.int64)})
        self.decoder = Decoder(self.ranks) if with_bytes else None
        self.number, self.ids, self.bytes = {}, Lists(np.int32), Lists(np.uint8)

    def _learn(self, words: list[str]) -> None:
        whole, short, long = [], [], []
        for w in words:
            b = w.encode()
            rank = self.ranks.get(b)
            if rank is not None:
                whole.append((w, rank))
            else:
                (long if self.at_once and len(b) > SHORT_BYTES else short).append((w, b))
        if whole:
            self._keep([w for w, _ in whole], np.array([r for _, r in whole], np.int32), np.ones(len(whole), np.int64))
        for part, sql in ((short, ENCODE), (long, ENCODE_LONG)):
            if part:
                start = self.single[np.frombuffer(b"".join(b for _, b in part), np.uint8)]
                ids = _lists(start, [len(b) for _, b in part])
                found = _query(self.con, "words", {"word": np.arange(len(part), dtype=np.int32), "ids": ids}, sql)
                lists = found.column("ids").chunk(0)
                self._keep([w for w, _ in part], lists.flatten().to_numpy(), np.diff(lists.offsets.to_numpy()))

    def _keep(self, words, flat, sizes) -> None:
        first = len(self.number)
        self.number.update(zip(words, range(first, first + len(words))))
        self.ids.extend(flat, sizes)
        if self.decoder:
            pieces = self.decoder.pieces(flat, sizes)
            self.bytes.extend(np.frombuffer(b"".join(pieces), np.uint8), [len(p) for p in pieces])

    def encode(self, texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The ids of all texts one after the other and how many each has; likewise the bytes they stand for."""
        if len(self.number) >= WORDS or self.ids.flat.n >= WORD_IDS:
            for table in (self.number, self.ids, self.bytes):
                table.clear()
        split = [self.findall(t.decode("utf-8", "replace")) if t else [] for t in texts]
        new = set().union(*split).difference(self.number)
        if new:
            self._learn(list(new))
        words = np.fromiter(map(self.number.__getitem__, chain.from_iterable(split)), np.int64, sum(map(len, split)))
        last = np.append(0, np.cumsum([len(s) for s in split]))
        out = []
        for lists in (self.ids, self.bytes) if self.decoder else (self.ids,):
            flat, sizes = lists.gather(words)
            out += [flat, np.diff(np.append(0, np.cumsum(sizes))[last])]
        return tuple(out)


class RunDecoder(Decoder):
    """Bytes of long lists of ids, which are cut into runs before tokens that begin with white space, after 64 at the
    latest. The bytes of a (bounded) number of different runs are kept."""

    def __init__(self, content: bytes):
        ranks = parse(content)
        super().__init__(ranks)
        self.number, self.bytes = {}, Lists(np.uint8)
        self.known = np.zeros(max(ranks.values()) + 1, bool)
        self.begins = self.known.copy()
        for token, rank in ranks.items():
            self.known[rank], self.begins[rank] = True, token[:1].isspace()

    def _learn(self, runs: list[bytes]) -> None:
        first = len(self.number)
        pieces = self.pieces(np.frombuffer(b"".join(runs), np.int32), [len(r) // 4 for r in runs])
        self.number.update(zip(runs, range(first, first + len(runs))))
        self.bytes.extend(np.frombuffer(b"".join(pieces), np.uint8), [len(p) for p in pieces])

    def decode(self, ids: np.ndarray, sizes: np.ndarray) -> list:
        """The bytes of each list of ids; None for one with an id that is not in the vocabulary."""
        if len(self.number) >= WORDS or self.bytes.flat.n >= WORD_IDS:
            self.number.clear()
            self.bytes.clear()
        ends = np.append(0, np.cumsum(sizes))
        good = (ids >= 0) & (ids < len(self.known))
        good[good] = self.known[ids[good]]
        wrong = np.diff(np.append(0, np.cumsum(~good))[ends]) > 0
        ids = np.where(good, ids, np.argmax(self.known)).astype(np.int32)
        place = np.arange(len(ids)) - np.repeat(ends[:-1], sizes)
        cuts = np.flatnonzero((place % RUN_IDS == 0) | self.begins[ids])
        raw, edge = ids.tobytes(), np.append(cuts, len(ids)) * 4
        runs = [raw[a:b] for a, b in zip(edge[:-1].tolist(), edge[1:].tolist())]
        new = set(runs).difference(self.number)
        if new:
            self._learn(list(new))
        flat, lengths = self.bytes.gather(np.fromiter(map(self.number.__getitem__, runs), np.int64, len(runs)))
        bounds = np.append(0, np.cumsum(lengths))[np.searchsorted(cuts, ends)].tolist()
        whole = flat.tobytes()
        return [None if w else whole[a:b] for w, a, b in zip(wrong.tolist(), bounds[:-1], bounds[1:])]


def encode(docs: DataFrame, ranks: bytes, pattern: str, text: str = "text", keep=None, out: str = "ids", decoded: str | None = None) -> DataFrame:
    """The columns ``keep`` (all) of every row and ``out``, the array of the token ids of its whole text.

    ``ranks`` is the content of a rank file (``read_ranks``), ``pattern`` cuts a text into words, each encoded by
    itself: a word that is a token is that token, any other is contracted pair by pair, lowest rank first and leftmost of equals.
    ``decoded`` names a column for the bytes that the ids stand for; it costs less here than by ``decode``, as the ids of a
    word are decoded once.

    A null or empty text has no ids (an empty array), bytes that are no UTF-8 count as U+FFFD, strings of special tokens are
    ordinary text. Rows are neither moved nor joined, so repeated rows and null keys stay as they are; a column named like
    a new one is replaced; an empty table gives no rows. A task holds a slice of texts, the words it has met (bounded) and
    some fifty bytes for each byte of the longest word.
    """
    shared = docs.sparkSession.sparkContext.broadcast((ranks, pattern, orderly(parse(ranks)), decoded is not None))
    made = [T.StructField(out, T.ArrayType(T.IntegerType(), False), False)]
    made += [T.StructField(decoded, T.BinaryType(), False)] if decoded is not None else []
    names = [f.name.lower() for f in made]
    keep = [c for c in (docs.columns if keep is None else keep) if c.lower() not in names]
    narrow = docs.select(*[col(c) for c in keep], col(text).cast("string").cast("binary").alias(fresh("text_bytes", [*docs.columns, *names])))
    schema = T.StructType([*narrow.schema.fields[:-1], *made])

    def run(batches):
        encoder = kept("bpe", hash(shared.value), lambda: Encoder(*shared.value))
        for batch in batches:
            for part in bounded(batch, byte_lengths(batch.column(len(keep))), ROWS, VOLUME):
                ids, sizes, *more = encoder.encode(part.column(len(keep)).to_pylist())
                columns = [*part.columns[:-1], _lists(ids, sizes)]
                if more:
                    ends = np.append(0, np.cumsum(more[1])).astype(np.int32)
                    columns.append(pa.Array.from_buffers(pa.binary(), part.num_rows, [None, pa.py_buffer(ends), pa.py_buffer(more[0])]))
                yield pa.RecordBatch.from_arrays(columns, schema.names)

    return narrow.mapInArrow(run, schema)


def decode(rows: DataFrame, ranks: bytes, ids: str = "ids", keep=None, out: str = "decoded") -> DataFrame:
    """The columns ``keep`` (all) of every row and ``out``, the bytes that its array of token ids stands for.

    No ids are no bytes; null, and an array that holds null or an id that is not in the vocabulary, decode to null. Rows
    are neither moved nor joined; a column named like ``out`` is replaced; an empty table gives no rows.
    """
    shared = rows.sparkSession.sparkContext.broadcast(ranks)
    keep = [c for c in (rows.columns if keep is None else keep) if c.lower() != out.lower()]
    tmp = fresh("ids_array", [*rows.columns, out])
    narrow = rows.select(*[col(c) for c in keep], col(ids).cast("array<int>").alias(tmp))
    schema = T.StructType([*narrow.schema.fields[:-1], T.StructField(out, T.BinaryType())])

    def run(batches):
        decoder = kept("bpe-decoder", hash(shared.value), lambda: RunDecoder(shared.value))
        for batch in batches:
            sizes = np.diff(batch.column(len(keep)).offsets.to_numpy())
            for part in bounded(batch, sizes, ROWS, VOLUME // 4):
                lists = part.column(len(keep))
                flat = lists.flatten().fill_null(-1).to_numpy()
                found = decoder.decode(flat, np.asarray(lists.value_lengths().fill_null(0)))
                null = lists.is_null().to_pylist()
                made = pa.array([None if n else x for n, x in zip(null, found)], pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], made], schema.names)

    return narrow.mapInArrow(run, schema)


def digest(rows: DataFrame, key: str = "doc_id", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """(key, n_tokens, ids_sha256, decoded_sha256) of encoded and decoded rows."""
    return rows.select(
        col(key), F.size(ids).cast("long").alias("n_tokens"), F.sha2(F.concat_ws(" ", F.col(ids).cast("array<string>")).cast("binary"), 256).alias("ids_sha256"),
        F.sha2(col(decoded), 256).alias("decoded_sha256"))
