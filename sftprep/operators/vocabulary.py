"""Vocabulary tables ``(token, id, freq)`` and lookups against them."""

from __future__ import annotations

import functools
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sftprep.functions.text import HANGUL, contains_script
from sftprep.operators.order import index_rows
from sftprep.storage import small_batches, stored

GROUP = 128
VOCAB_SCHEMA = "token string, id int, freq bigint"
#: An item is heavy with more than this share of the elements looked up.
HEAVY = 1000
MAX_SHIPPED_TOKENS = 1 << 20
MAX_SHIPPED_BYTES = 64 << 20
#: Bits of the map that tells which items the tail of a table may hold; sent to the tasks.
BITS = 1 << 27
#: Rows that a worker looks up at once when rows are stored: as all their tokens are in memory,
#: here and in the JVM, more would take much of it; each batch indexes the shipped table anew.
ROWS = 2048


def count_tokens(df: DataFrame, tokens: str = "tokens") -> DataFrame:
    """``(token, freq)``; frequent tokens shrink to one row per task before the shuffle."""
    return (
        df.select(F.explode(tokens).alias("token")).groupBy("token").agg(F.count("*").alias("freq"))
    )


def build_vocab(df: DataFrame, tokens: str = "tokens", reserved: Sequence[str] = ()) -> DataFrame:
    """The vocabulary of the token arrays in column ``tokens`` (see ``number_tokens``)."""
    return number_tokens(count_tokens(df, tokens), reserved)


def number_tokens(counts: DataFrame, reserved: Sequence[str] = ()) -> DataFrame:
    """Number counted tokens by falling frequency, behind the reserved ones.

    Reserved tokens get the ids 0, 1, ... and their own count (0 if the corpus lacks
    them). The counts are written to the shared folder once, as numbering reads them
    several times.
    """
    counts = stored(counts, "token-counts")
    is_reserved = F.col("token").isin(list(reserved))
    known = {row.token: row.freq for row in counts.filter(is_reserved).collect()}
    fixed = counts.sparkSession.createDataFrame(
        [(token, i, known.get(token, 0)) for i, token in enumerate(reserved)], VOCAB_SCHEMA
    )
    numbered = index_rows(counts.filter(~is_reserved), [-F.col("freq"), F.col("token")], "at").frame
    return fixed.unionByName(
        numbered.select("token", (F.col("at") + len(reserved)).cast("int").alias("id"), "freq")
    )


def vocab_size(vocab: DataFrame) -> int:
    """One more than the largest id."""
    last = vocab.agg(F.max("id")).first()[0]
    return 0 if last is None else last + 1


def extend_vocab(
    base: DataFrame,
    candidates: DataFrame,
    char_class: str = HANGUL,
    group: int = GROUP,
) -> DataFrame:
    """Append the candidates of one script that ``base`` lacks.

    They come in order of falling frequency, and their number is cut to a multiple of
    ``group``. Tokens are unique on both sides, so the anti join cannot skew.
    """
    new = candidates.filter(contains_script(F.col("token"), char_class)).join(
        base.select("token"), "token", "left_anti"
    )
    new = stored(new.select("token", "freq"), "new-tokens")
    indexed = index_rows(new, [-F.col("freq"), F.col("token")], "at")
    kept = indexed.rows // group * group
    size = vocab_size(base)
    return base.select("token", "id", "freq").unionByName(
        indexed.frame.filter(F.col("at") < kept).select(
            "token", (F.col("at") + size).cast("int").alias("id"), "freq"
        )
    )


def append_special(vocab: DataFrame, tokens: Sequence[str]) -> DataFrame:
    """Append the given tokens, in order, unless present. One pass finds size and presence."""
    wanted = list(dict.fromkeys(tokens))
    seen = F.collect_set(F.when(F.col("token").isin(wanted), F.col("token")))
    row = vocab.agg(F.max("id").alias("last"), seen.alias("seen")).first()
    size = 0 if row.last is None else row.last + 1
    new = [t for t in wanted if t not in set(row.seen)]
    added = vocab.sparkSession.createDataFrame(
        [(token, size + i, 0) for i, token in enumerate(new)], VOCAB_SCHEMA
    )
    return vocab.select("token", "id", "freq").unionByName(added)


def token_ids(vocab: DataFrame, tokens: Sequence[str]) -> dict[str, int]:
    """Ids of a handful of tokens such as markers; a pushed-down filter on a stored table."""
    wanted = list(dict.fromkeys(tokens))
    rows = vocab.filter(F.col("token").isin(wanted)).select("token", "id").collect()
    return {row.token: row.id for row in rows}


def _arrow_lookup(shipped, source: str, target: str, ddl: str):
    """Arrow column function: every array element becomes its partner, or null if none."""

    @F.arrow_udf(ddl)
    def look_up(arrays: pa.Array) -> pa.Array:
        pa.set_memory_pool(pa.system_memory_pool())  # gives memory back between batches
        table = shipped.value
        found = pc.take(table[target], pc.index_in(arrays.flatten(), value_set=table[source]))
        lengths = pc.fill_null(pc.list_value_length(arrays), 0)
        ends = pc.cumulative_sum(lengths.cast(pa.int32()))
        offsets = pa.concat_arrays([pa.array([0], pa.int32()), ends])
        return pa.ListArray.from_arrays(offsets, found, mask=arrays.is_null())

    return look_up


def _may_hold(shipped):
    """Arrow column function: for arrays of hashes, whether the shipped bitmap has their bits."""

    @F.arrow_udf("array<boolean>")
    def may_hold(arrays: pa.Array) -> pa.Array:
        pa.set_memory_pool(pa.system_memory_pool())
        bits = np.frombuffer(shipped.value, dtype=np.uint8)
        at = arrays.flatten().to_numpy(zero_copy_only=False)
        hit = (bits[at >> 3] >> (at & 7)) & 1
        lengths = pc.fill_null(pc.list_value_length(arrays), 0).to_numpy(zero_copy_only=False)
        offsets = np.concatenate([[0], np.cumsum(lengths)])
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(hit.astype(bool)))

    return may_hold


def _bit(item: Column) -> Column:
    return F.pmod(F.xxhash64(item), F.lit(BITS))


def _bitmap(items: DataFrame) -> bytes:
    """A bit for the hash of every ``__item``: ``BITS`` of them, whatever the number of items."""
    bit = _bit(F.col("__item")) + F.lit(1)  # buckets and bits count from 1
    parts = items.groupBy(F.bitmap_bucket_number(bit).alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bits")
    )
    whole = np.zeros(BITS // 8, dtype=np.uint8)
    for bucket, bits in zip(*(parts.toArrow()[c].to_pylist() for c in ("bucket", "bits"))):
        at = (bucket - 1) * len(bits)
        whole[at : at + len(bits)] = np.frombuffer(bits, dtype=np.uint8)
    return whole.tobytes()


def _tail_items(rest: DataFrame, items: DataFrame) -> DataFrame:
    """``(__item, n, __found)`` of the distinct items of ``items (__item)``; null if unknown.

    Items are counted first, added up in the tasks, and each is looked up once: the table
    shuffles once, whatever the number of partitions.
    """
    counts = items.groupBy("__item").agg(F.count("*").alias("n"))
    return stored(counts.join(rest, "__item", "left"), "tail-items")


def _answered(known: DataFrame, elements: DataFrame) -> DataFrame:
    """``elements`` with the ``__found`` of their items, unknown ones gone.

    The answers for items that are more than a thousandth of all elements, of which there are
    less than a thousand, known or not, are sent to the elements; so no task of the join for
    the others gets a hot item.
    """
    total = known.agg(F.sum("n")).first()[0] or 0
    is_heavy = F.col("n") * HEAVY > total
    heavy = F.broadcast(known.filter(is_heavy).select("__item", "__found"))
    light = known.filter(~is_heavy & F.col("__found").isNotNull()).select("__item", "__found")
    hot = elements.join(heavy, "__item").filter(F.col("__found").isNotNull())
    cold = elements.join(heavy, "__item", "left_anti").join(light, "__item")
    return hot.unionByName(cold)


def _found_in(rest: DataFrame, elements: DataFrame) -> DataFrame:
    """``elements (__key, __at, __item)`` with the ``__found`` of their items, unknown ones gone."""
    return _answered(_tail_items(rest, elements.select("__item")), elements)


class Vocabulary:
    """A vocabulary table with both lookup directions.

    Its head, the lowest ids up to ``max_tokens`` tokens and ``max_bytes`` of text, is
    shipped to the executors, and each Arrow batch is looked up there in place: no
    exploded rows and no shuffle of the corpus. A table that fits is all head. Of a
    larger one only the elements outside the head are joined with the rest of the table,
    and put back by row. As ids follow falling frequency, the tokens that make up most of a
    corpus never reach that join. Nor do most of the unknown ones: a bitmap of the hashes of
    the tail's tokens, of ``BITS`` bits, is shipped as well, and elements whose bit it lacks
    are left out before any shuffle. The rows are stored once for these passes, with the items
    outside the head beside them.
    """

    def __init__(
        self,
        table: DataFrame,
        unk: str,
        max_tokens: int = MAX_SHIPPED_TOKENS,
        max_bytes: int = MAX_SHIPPED_BYTES,
    ) -> None:
        self.table = table.select("token", F.col("id").cast("int").alias("id"))
        self.unk = unk
        self.max_tokens = max_tokens
        self.max_bytes = max_bytes

    @functools.cached_property
    def _head(self) -> tuple[int, bool]:
        """First id outside the head, and whether the head is the whole table.

        One pass sums tokens and bytes by powers of two of the id; the head ends at the
        largest power that keeps both bounds.
        """
        power = F.length(F.bin(F.col("id"))).alias("power")
        sizes = self.table.groupBy(power).agg(
            F.count("*").alias("tokens"), F.sum(F.octet_length("token")).alias("bytes")
        )
        tokens = size = 0
        limit = 0
        for row in sorted(sizes.collect()):
            tokens, size = tokens + row.tokens, size + row.bytes
            if tokens > self.max_tokens or size > self.max_bytes:
                return limit, False
            limit = 1 << row.power
        return limit, True

    @functools.cached_property
    def _shipped(self):
        head = self.table.filter(F.col("id") < self._head[0]).toArrow()
        arrays = {name: head[name].combine_chunks() for name in ("token", "id")}
        return self.table.sparkSession.sparkContext.broadcast(arrays)

    @functools.cached_property
    def _tail_bits(self):
        tail = self.table.filter(F.col("id") >= self._head[0]).select(F.col("token").alias("__item"))
        return self.table.sparkSession.sparkContext.broadcast(_bitmap(tail))

    @functools.cached_property
    def unk_id(self) -> int:
        return self.ids([self.unk])[0]

    def ids(self, tokens: Sequence[str]) -> list[int]:
        """Ids of a handful of tokens such as markers; all of them must be in the table."""
        known = token_ids(self.table, tokens)
        missing = [t for t in tokens if t not in known]
        if missing:
            raise ValueError(f"the vocabulary lacks {missing}")
        return [known[t] for t in tokens]

    def encode(
        self, df: DataFrame, key: str, tokens: str, out: str, keep: bool = True
    ) -> DataFrame:
        """Add the id array ``out`` of the token array ``tokens``; truncate it before.

        Without ``keep`` the column ``tokens`` is left out, which saves storing it.
        """
        limit, complete = self._head
        unk = F.lit(self.unk_id)
        df = df.withColumn(out, self._in_head(F.col(tokens), "token", "id"))
        if complete:
            found = df
        else:
            open_items = _places(F.col(tokens), lambda x, i: F.get(F.col(out), i).isNull())
            df = df.withColumn("__open", open_items)
            hashes = F.transform("__open", lambda e: _bit(e["item"]))
            df = df.withColumn("__may", _may_hold(self._tail_bits)(hashes))
            maybe = F.filter("__open", lambda e, k: F.get("__may", k))
            df = df.withColumn("__open", maybe).drop("__may")
            with small_batches(df.sparkSession, ROWS):
                df = _numbered(df if keep else df.drop(tokens), "looked-up")
            patches = self._patches(df.select("__row", "__open"), "token", "id")
            found = _patched(df.drop("__open").join(patches, "__row", "left"), out).drop("__row")
        found = found if keep else found.drop(tokens)
        return found.withColumn(out, F.transform(out, lambda i: F.coalesce(i, unk)))

    def decode(
        self, df: DataFrame, key: str, ids: str, out: str, skip: Sequence[int] = ()
    ) -> DataFrame:
        """Add the text ``out`` of the id array ``ids`` without the special ids in ``skip``."""
        limit, complete = self._head

        def kept() -> Column:
            return F.filter(ids, lambda i: ~i.isin(list(skip))) if skip else F.col(ids)

        if not complete:
            # ids are joined with the patches, as they are smaller than the tokens
            df = _numbered(df, "ids")
            open_ids = _places(kept(), lambda x, i: x >= F.lit(limit)).alias("__open")
            df = df.join(self._patches(df.select("__row", open_ids), "id", "token"), "__row", "left")
        df = df.withColumn("__kept", kept())
        found = df.withColumn(out, self._in_head(F.col("__kept"), "id", "token")).drop("__kept")
        found = found if complete else _patched(found, out).drop("__row")
        return found.withColumn(out, F.array_join(out, ""))

    def _in_head(self, items: Column, source: str, target: str) -> Column:
        ddl = f"array<{self.table.schema[target].dataType.simpleString()}>"
        return _arrow_lookup(self._shipped, source, target, ddl)(items)

    def _patches(self, rows: DataFrame, source: str, target: str) -> DataFrame:
        """``(__row, __patch)``: the tail's answers by place, of rows with ``__open`` items."""
        rest = self.table.filter(F.col("id") >= self._head[0]).select(
            F.col(source).alias("__item"), F.col(target).alias("__found")
        )
        known = _tail_items(rest, rows.select(F.explode("__open.item").alias("__item")))
        elements = stored(
            rows.select("__row", F.explode("__open").alias("e")).select(
                "__row", F.col("e.at").alias("__at"), F.col("e.item").alias("__item")
            ),
            "open-items",
        )
        return (
            _answered(known, elements)
            .groupBy("__row")
            .agg(F.map_from_entries(F.collect_list(F.struct("__at", "__found"))).alias("__patch"))
        )


def _places(items: Column, is_open) -> Column:
    """Structs ``(at, item)`` of the elements for which ``is_open(item, at)``."""
    placed = F.transform(items, lambda x, i: F.struct(i.alias("at"), x.alias("item")))
    return F.filter(placed, lambda e: is_open(e["item"], e["at"]))


def _numbered(df: DataFrame, label: str) -> DataFrame:
    """``df`` stored, with a ``__row`` that tells rows apart whatever their keys."""
    return stored(df.withColumn("__row", F.monotonically_increasing_id()), label)


def _patched(df: DataFrame, out: str) -> DataFrame:
    """Put the answers of ``__patch`` into the gaps of ``out``."""
    patched = F.transform(out, lambda x, i: F.coalesce(x, F.try_element_at("__patch", i)))
    return df.withColumn(out, F.when(F.col("__patch").isNull(), F.col(out)).otherwise(patched)).drop("__patch")
