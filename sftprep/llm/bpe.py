"""Byte-level BPE by recursive DuckDB queries inside each partition.

Every match of the pre-token pattern is encoded by itself. The ones a worker has not met yet
become rows (word, position, token), one row a byte, of an in-process DuckDB table. A recursive
query joins neighbouring rows with the merge table and contracts, in each word, the pair of
the lowest rank, from the left, until no word has a pair left. In long words the equal pairs
of that rank are contracted in one step. A contraction can make a pair of a lower rank with a
neighbour, as a token may rank before its parts; a word's step then ends with the first that
does, so the ids are those of one contraction at a time, whatever the ranks. Decoding is an
ordered aggregation over the token rows.
"""

from __future__ import annotations

import base64
import hashlib
import tempfile
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sftprep.llm.common import worker_memory

#: Words a worker remembers, words of one DuckDB call, bytes of one call (a longer word is
#: a call by itself), and steps of the recursion in one call; what is not finished then goes
#: on in the next call, so that the rows of all steps never add up beyond that.
REMEMBERED = 800_000
CALL_WORDS = 40_000
CALL_BYTES = 400_000
CALL_STEPS = 24
#: A word of more bytes contracts all pairs of its lowest rank in one step.
LONG = 200

#: One row a word, its tokens as a list; each step unnests them to token-position rows, joins
#: these with the merge table and contracts the leftmost pair of the lowest rank.
STEPS = f"""
WITH RECURSIVE step(depth, word, toks, live) AS (
    SELECT 0, word, toks, TRUE FROM fed
    UNION ALL
    SELECT depth + 1, s.word,
        CASE WHEN b.place IS NULL THEN toks
             ELSE toks[:b.place - 1] || [b.made] || toks[b.place + 2:] END,
        b.place IS NOT NULL
    FROM step s LEFT JOIN (
        SELECT word, min_by(place, rank * 1048576 + place) AS place,
            min_by(made, rank * 1048576 + place) AS made
        FROM (
            SELECT word, unnest(toks[:-2]) AS lft, unnest(toks[2:]) AS rgt,
                unnest(range(1, len(toks))) AS place
            FROM step WHERE live
        ) JOIN merges USING (lft, rgt)
        GROUP BY word
    ) b ON s.word = b.word
    WHERE s.live AND depth < {CALL_STEPS}
)
SELECT word, toks, live FROM step WHERE NOT live OR depth = {CALL_STEPS}
"""

#: The same for long words, one row a token: all pairs of the lowest rank in one step, of a
#: run of overlapping ones the first, third, and so on, up to the first that makes a pair of a
#: lower rank (``early`` holds the pairs whose token ranks before one of its parts).
LONG_STEPS = f"""
WITH RECURSIVE step(depth, word, pos, tok, live) AS (
    SELECT 0, word, generate_subscripts(toks, 1), unnest(toks), TRUE FROM fed
    UNION ALL
    SELECT depth + 1, word, pos, CASE WHEN take THEN made ELSE tok END, lowest IS NOT NULL
    FROM (
        SELECT *, coalesce(lag(take) OVER (PARTITION BY word ORDER BY pos), FALSE) AS taken
        FROM (
            SELECT depth, word, pos, tok, made, lowest, take AND pos <= coalesce(
                min(pos) FILTER (due) OVER (PARTITION BY word), pos) AS take
            FROM (
                SELECT t.*, coalesce(least(a.rank, b.rank) < lowest, FALSE) AS due
                FROM (
                    SELECT *, CASE WHEN lag(take, 2) OVER (PARTITION BY word ORDER BY pos)
                        THEN made ELSE lag(tok) OVER (PARTITION BY word ORDER BY pos) END AS before,
                        lead(tok, 2) OVER (PARTITION BY word ORDER BY pos) AS after
                    FROM (
                        SELECT *, hit AND (row_number() OVER (PARTITION BY word, hit, island
                                                              ORDER BY pos)) % 2 = 1 AS take
                        FROM (
                            SELECT *, nth - row_number() OVER (PARTITION BY word, hit ORDER BY pos) AS island
                            FROM (
                                SELECT *, coalesce(rank = lowest, FALSE) AS hit
                                FROM (
                                    SELECT p.*, m.rank, m.made, min(m.rank) OVER (PARTITION BY word) AS lowest
                                    FROM (
                                        SELECT depth, word, pos, tok,
                                            lead(tok) OVER (PARTITION BY word ORDER BY pos) AS nxt,
                                            row_number() OVER (PARTITION BY word ORDER BY pos) AS nth
                                        FROM step WHERE live AND depth < {CALL_STEPS}
                                    ) p LEFT JOIN merges m ON p.tok = m.lft AND p.nxt = m.rgt
                                )
                            )
                        )
                    )
                ) t
                LEFT JOIN early a ON t.take AND a.lft = t.before AND a.rgt = t.made
                LEFT JOIN early b ON t.take AND b.lft = t.made AND b.rgt = t.after
            )
        )
    )
    WHERE NOT taken
)
SELECT word, list(tok ORDER BY pos) AS toks, bool_or(live) AS live
FROM step WHERE NOT live OR depth = {CALL_STEPS} GROUP BY word
"""

#: Ids in decimal, and the bytes they stand for: an aggregation in the order of positions.
GATHER = """
SELECT word, string_agg(tok::VARCHAR, ' ' ORDER BY pos), string_agg(hexed, '' ORDER BY pos)
FROM (SELECT word, unnest(toks) AS tok, generate_subscripts(toks, 1) AS pos FROM encoded)
JOIN tokens USING (tok) GROUP BY word
"""


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and their ranks, from a file of lines ``base64 rank``."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}


def token_table(ranks: dict[bytes, int]) -> pa.Table:
    return pa.table(
        {
            "tok": pa.array(list(ranks.values()), pa.int32()),
            "hexed": pa.array([t.hex() for t in ranks]),
        }
    )


def database_settings() -> dict:
    """One thread, bounded memory, and spilling to the temporary folder of the worker."""
    return {"threads": 1, "memory_limit": "400MB", "temp_directory": tempfile.gettempdir()}


class RankEncoder:
    """Encodes and decodes words with a merge table that an in-process DuckDB holds."""

    def __init__(self, ranks: dict[bytes, int]):
        import duckdb

        self.single = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        self.db = duckdb.connect(":memory:", config=database_settings())
        pairs = [
            (left, right, made, made)
            for token, made in ranks.items()
            for cut in range(1, len(token))
            if (left := ranks.get(token[:cut])) is not None
            and (right := ranks.get(token[cut:])) is not None
        ]
        columns = zip(*pairs) if pairs else ([], [], [], [])
        merges = dict(zip(("lft", "rgt", "rank", "made"), map(np.array, columns)))
        for name in ("lft", "rgt", "made"):
            merges[name] = merges[name].astype(np.int32)
        merges["rank"] = merges["rank"].astype(np.int64)
        self._table("merges", pa.table(merges))
        self._table("tokens", token_table(ranks))
        self.db.execute("CREATE TABLE early AS FROM merges WHERE rank < greatest(lft, rgt)")

    def _table(self, name: str, rows: pa.Table) -> None:
        self.db.register("given", rows)
        self.db.execute(f"CREATE TABLE {name} AS SELECT * FROM given")
        self.db.unregister("given")

    def _finish(self, words: list[bytes], steps: str) -> Iterator[tuple[int, str, str]]:
        ends = np.cumsum([0] + [len(w) for w in words], dtype=np.int32)
        flat = self.single[np.frombuffer(b"".join(words), dtype=np.uint8)]
        fed = pa.table(
            {
                "word": pa.array(np.arange(len(words), dtype=np.int32)),
                "toks": pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)),
            }
        )
        while len(fed):
            self.db.register("fed", fed)
            rows = self.db.sql(steps).to_arrow_table()
            self.db.unregister("fed")
            self.db.register("encoded", rows.filter(pc.invert(rows["live"])))
            found = self.db.sql(GATHER).to_arrow_table()
            yield from zip(*[found.column(k).to_pylist() for k in range(3)])
            self.db.unregister("encoded")
            fed = rows.filter(rows["live"]).select(["word", "toks"])

    def unmerged(self, ranks: dict[bytes, int]) -> list[bytes]:
        """The tokens that merging does not give back from their bytes: a library that looks
        whole words up before it merges gives other ids for these words. None in a file of
        tokens that merging has found."""
        out, tokens = [], list(ranks)
        for lo in range(0, len(tokens), CALL_WORDS):
            part = tokens[lo : lo + CALL_WORDS]
            for k, ids, _ in self._finish(part, STEPS):
                if ids != str(ranks[part[k]]):
                    out.append(part[k])
        return out

    def encode(self, words: list[str]) -> dict[str, tuple[str, bytes]]:
        """Of each word, none empty: the ids in decimal, parted by spaces, and their bytes."""
        out = {}
        plain = [w.encode("utf-8") for w in words]
        for steps, is_long in ((STEPS, False), (LONG_STEPS, True)):
            own = [k for k, w in enumerate(plain) if (len(w) > LONG) == is_long]
            lo = 0
            while lo < len(own):
                hi, size = lo, 0
                while hi < len(own) and hi - lo < CALL_WORDS:
                    size += len(plain[own[hi]])
                    if size > CALL_BYTES and hi > lo:
                        break
                    hi += 1
                part = own[lo:hi]
                for k, ids, decoded in self._finish([plain[x] for x in part], steps):
                    out[words[part[k]]] = (ids, bytes.fromhex(decoded))
                lo = hi
        return out


def encode_batches(ranks_path: str, pattern: str):
    """A function for a struct-valued pandas UDF: texts -> counts, ids and decoded bytes."""
    import regex

    pre_token = regex.compile(pattern)
    encoder = RankEncoder(read_ranks(ranks_path))
    memory = worker_memory(("bpe", ranks_path), REMEMBERED)

    def run(texts: list[str]) -> list[tuple[int, str, bytes]]:
        out = []
        split = [pre_token.findall(x) for x in texts]
        for coded in memory.look_up(split, encoder.encode):
            ids = " ".join([c[0] for c in coded])
            n = ids.count(" ") + 1 if ids else 0
            out.append((n, ids, b"".join([c[1] for c in coded])))
        return out

    return run


#: Characters of the texts that one step of a task encodes together.
STEP_CHARS = 8_000_000


def _steps(batch: pd.Series) -> Iterator[list[str]]:
    held, size = [], 0
    for text in batch:
        held.append(text or "")
        size += len(held[-1])
        if size > STEP_CHARS:
            yield held
            held, size = [], 0
    if held:
        yield held


def encode(docs: DataFrame, text: Column, ranks_path: str, pattern: str) -> DataFrame:
    """Add ``ids``, an array of token ids, to each row.

    Null text counts as empty and gives an empty array; texts are taken whole, however long.
    Rows are neither merged nor dropped; a column ``ids`` is replaced.
    """

    @F.pandas_udf("array<int>")
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        run = encode_batches(ranks_path, pattern)
        for batch in batches:
            yield pd.Series(
                [[int(i) for i in x[1].split()] for texts in _steps(batch) for x in run(texts)],
                dtype=object,
            )

    return docs.withColumn("ids", ids(F.coalesce(text, F.lit(""))))


def decode(docs: DataFrame, ids: Column, ranks_path: str) -> DataFrame:
    """Add ``decoded``, the bytes that an array of token ids stands for.

    A null or empty array gives no bytes; an id the file lacks raises.
    """

    @F.pandas_udf("binary")
    def decoded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import duckdb

        ranks = read_ranks(ranks_path)
        db = duckdb.connect(":memory:", config=database_settings())
        db.register("tokens", token_table(ranks))
        known = set(ranks.values())
        for batch in batches:
            lists = [[] if x is None else [int(i) for i in x] for x in batch]
            if any(i not in known for x in lists for i in x):
                raise ValueError("an id is not in the vocabulary")
            rows = {"word": list(range(len(lists))), "toks": lists}
            kinds = pa.schema([("word", pa.int32()), ("toks", pa.list_(pa.int32()))])
            db.register("encoded", pa.table(rows, schema=kinds))
            found = {w: bytes.fromhex(d) for w, _, d in db.execute(GATHER).fetchall()}
            db.unregister("encoded")
            yield pd.Series([found.get(k, b"") for k in range(len(lists))], dtype=object)

    return docs.withColumn("decoded", decoded(F.coalesce(ids, F.array().cast("array<int>"))))


def with_digests(docs: DataFrame, text: Column, ranks_path: str, pattern: str) -> DataFrame:
    """Add ``n_tokens`` and SHA-256 digests: of the decimal ids joined by one space
    (``ids_sha256``), and of the bytes the ids decode to (``decoded_sha256``).

    Ids are encoded and decoded as by ``encode`` and ``decode``, in one pass that never holds
    more than a few megabytes of text. Null text counts as empty. Columns of those three
    names are replaced.
    """

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def digests(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        run = encode_batches(ranks_path, pattern)
        for batch in batches:
            rows = [
                (n, hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(raw).hexdigest())
                for texts in _steps(batch)
                for n, ids, raw in run(texts)
            ]
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    names = ["n_tokens", "ids_sha256", "decoded_sha256"]
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in names]
    coded = docs.select(*kept, digests(F.coalesce(text, F.lit(""))).alias("__digests"))
    return coded.select(
        *[F.col(f"`{c}`") for c in coded.columns if c != "__digests"],
        *[F.col(f"__digests.{n}").alias(n) for n in names],
    )
