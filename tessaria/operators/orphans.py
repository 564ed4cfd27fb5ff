"""References to records that do not exist, by bitmap algebra.

Every distinct key is given an integer: keys are hashed to ranges of about RANGE_KEYS keys, and inside a range a key's
code is its place in the range's dictionary. A range's references, parents and removed keys are then compressed bitmaps
over these codes, one per reference and period. The orphans of a period are `reference AND NOT parent`, split by `AND
removed`; late ones are `early AND parent`. The algebra runs on containers as they are (64-bit words of a dense one,
sorted 16-bit positions of a sparse one), and only the bits that survive are decoded, by the same dictionary.

Scale: rows are reduced to one per (key, reference, period) inside the map tasks, ADVANCE rows at a time, so of a key
that holds a third of all rows few leave a task. One exchange by range follows; dictionary, bitmaps, algebra and
decoding all use it. A range's size does not grow with the data, their number does.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RANGE_KEYS, ADVANCE = 1 << 16, 200_000
STATES = ("deleted", "missing", "late")
PARENT, REMOVED = -1, -2
NEVER = np.iinfo(np.int64).max


@dataclass(frozen=True)
class Reference:
    """A column of a child table that names keys of a parent table; at is when a row was stored."""

    child: str
    column: str
    parent: str
    rows: DataFrame
    key: Column
    at: str = "loaded_at"


@dataclass(frozen=True)
class Parent:
    name: str
    rows: DataFrame
    key: Column
    at: str = "loaded_at"


def pack(key: Column) -> Column:
    """A key as short bytes: 32 hexadecimal digits as 16 bytes behind 01, other text as itself behind 00."""
    return F.when(key.rlike("^[0-9a-f]{32}$"), F.concat(F.lit(b"\x01"), F.unhex(key))).otherwise(F.concat(F.lit(b"\x00"), F.encode(key, "utf-8")))


def unpack(packed: Column) -> Column:
    body = F.substring(packed, 2, 2**31 - 2)
    return F.when(F.substring(F.hex(packed), 1, 2) == "01", F.lower(F.hex(body))).otherwise(F.decode(body, "utf-8"))


class Bitmap:
    """Distinct codes in containers of 65536: sorted 16-bit positions where few, 64-bit words where many."""

    SPARSE = 4096

    def __init__(self, containers: dict[int, np.ndarray]) -> None:
        self.containers = {h: c for h, c in containers.items() if len(c)}

    @classmethod
    def of(cls, codes: np.ndarray) -> Bitmap:
        codes = np.unique(codes)
        high, low = codes >> 16, (codes & 0xFFFF).astype(np.uint16)
        return cls({int(h): cls._packed(low[high == h]) for h in np.unique(high)})

    @classmethod
    def _packed(cls, low: np.ndarray) -> np.ndarray:
        if len(low) <= cls.SPARSE:
            return low
        bits = np.zeros(1 << 16, np.uint8)
        bits[low] = 1
        return np.packbits(bits, bitorder="little").view(np.uint64)

    @classmethod
    def _shrunk(cls, words: np.ndarray) -> np.ndarray:
        return words if int(np.bitwise_count(words).sum()) > cls.SPARSE else cls._low(words)

    @staticmethod
    def _low(c: np.ndarray) -> np.ndarray:
        return c if c.dtype == np.uint16 else np.flatnonzero(np.unpackbits(c.view(np.uint8), bitorder="little")).astype(np.uint16)

    @staticmethod
    def _has(c: np.ndarray, low: np.ndarray) -> np.ndarray:
        """Which of the positions a container holds."""
        if c.dtype == np.uint16:
            return np.isin(low, c, assume_unique=True)
        return (c[low >> 6] >> (low & 63).astype(np.uint64)) & np.uint64(1) != 0

    def _with(self, other: Bitmap, h: int, keep: bool) -> np.ndarray:
        a, b = self.containers[h], other.containers[h]
        if a.dtype == np.uint16:
            return a[self._has(b, a) == keep]
        if b.dtype == np.uint16:
            low = self._low(a)
            return self._packed(low[self._has(b, low) == keep])
        return self._shrunk(a & b if keep else a & ~b)

    def __and__(self, other: Bitmap) -> Bitmap:
        return Bitmap({h: self._with(other, h, True) for h in self.containers.keys() & other.containers.keys()})

    def and_not(self, other: Bitmap) -> Bitmap:
        return Bitmap({h: self._with(other, h, False) if h in other.containers else c for h, c in self.containers.items()})

    def __or__(self, other: Bitmap) -> Bitmap:
        out = dict(self.containers)
        for h, c in other.containers.items():
            mine = out.get(h)
            out[h] = c if mine is None else mine | c if mine.dtype == c.dtype == np.uint64 else self._packed(np.union1d(self._low(mine), self._low(c)))
        return Bitmap(out)

    def __len__(self) -> int:
        return sum(len(c) if c.dtype == np.uint16 else int(np.bitwise_count(c).sum()) for c in self.containers.values())

    def codes(self) -> np.ndarray:
        """The codes, decoded in order."""
        return np.concatenate([self._low(self.containers[h]).astype(np.int64) + (h << 16) for h in sorted(self.containers)] or [np.empty(0, np.int64)])


def _squeeze(codes: np.ndarray) -> bytes:
    """A bitmap as bytes: per container its kind ('a' positions, 'b' bits), number, size and body."""
    out = []
    for h, c in sorted(Bitmap.of(codes).containers.items()):
        body = c.astype("<u2" if c.dtype == np.uint16 else "<u8").tobytes()
        out.append((b"a" if c.dtype == np.uint16 else b"b") + h.to_bytes(4, "little") + len(body).to_bytes(4, "little") + body)
    return b"".join(out)


def _codes(packed: bytes) -> np.ndarray:
    containers, i = {}, 0
    while i < len(packed):
        h, size = int.from_bytes(packed[i + 1 : i + 5], "little"), int.from_bytes(packed[i + 5 : i + 9], "little")
        containers[h] = np.frombuffer(packed[i + 9 : i + 9 + size], "<u2" if packed[i : i + 1] == b"a" else "<u8")
        i += 9 + size
    return Bitmap(containers).codes()


def _reduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per (range, k, role, period) of ADVANCE rows each, with the earliest time."""
    waiting: list[pa.RecordBatch] = []

    def least() -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(waiting).group_by(["range", "k", "role", "period"], use_threads=False).aggregate([("at", "min")])
        yield from t.rename_columns(["range", "k", "role", "period", "at"]).to_batches()
        waiting.clear()

    for b in batches:
        waiting.append(b)
        if sum(x.num_rows for x in waiting) >= ADVANCE:
            yield from least()
    if waiting:
        yield from least()


def _keyed(refs: list[Reference], parents: list[Parent], removed: DataFrame, n_ranges: int) -> DataFrame:
    """(range, k, role, period, at): every reference (role its number), parent and removed key, reduced inside tasks.

    k is the parent's number in one byte and the packed key; period is year * 100 + month, 0 without a time.
    """
    parent_no = {p.name: i for i, p in enumerate(parents)}
    unknown = [r.parent for r in refs if r.parent not in parent_no]
    if unknown:
        raise ValueError(f"no parent table for {unknown}")

    def part(rows: DataFrame, parent: str, role: int, key: Column, period: Column, at: Column) -> DataFrame:
        k = F.concat(F.lit(bytes([parent_no[parent]])), pack(key))
        return rows.where(key.isNotNull()).select(k.alias("k"), F.lit(role).alias("role"), period.alias("period"), at.alias("at"))

    none, never = F.lit(0), F.lit(None).cast("long")
    month = lambda c: F.coalesce(F.year(c) * 100 + F.month(c), none)
    parts = [part(r.rows, r.parent, i, r.key, month(r.at), F.unix_micros(r.at)) for i, r in enumerate(refs)]
    parts += [part(p.rows, p.name, PARENT, p.key, none, F.unix_micros(p.at)) for p in parents]
    parts += [part(removed.where(F.col("table_name") == p.name), p.name, REMOVED, F.col("k"), none, never) for p in parents]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    rows = rows.select(F.pmod(F.xxhash64("k"), F.lit(n_ranges)).cast("int").alias("range"), "*")
    return rows.mapInArrow(_reduced, rows.schema)


def ranges_for(refs: list[Reference], parents: list[Parent]) -> int:
    rows = None
    for x in [*refs, *parents]:
        one = x.rows.select(F.lit(1))
        rows = one if rows is None else rows.unionAll(one)
    return max(1, math.ceil(rows.count() / RANGE_KEYS))


def _algebra(table: pa.Table) -> tuple[pa.Array, list[tuple[int, int, dict[str, Bitmap]]]]:
    """A range's dictionary, and per reference and period its bitmaps by state."""
    encoded = table["k"].combine_chunks().dictionary_encode()
    code, role, period = encoded.indices.to_numpy(), table["role"].to_numpy(), table["period"].to_numpy()
    at = table["at"].fill_null(NEVER).to_numpy()
    born = np.full(len(encoded.dictionary), NEVER)
    is_parent = role == PARENT
    np.minimum.at(born, code[is_parent], at[is_parent])
    early = (at < born[code]) & (born[code] != NEVER)
    parent, removed = Bitmap.of(code[is_parent]), Bitmap.of(code[role == REMOVED])
    out = []
    for r, p in sorted(set(zip(role[role >= 0].tolist(), period[role >= 0].tolist()))):
        here = (role == r) & (period == p)
        gone = Bitmap.of(code[here]).and_not(parent)
        out.append((r, p, {"deleted": gone & removed, "missing": gone.and_not(removed), "late": Bitmap.of(code[here & early]) & parent}))
    return encoded.dictionary, out


_KEYS = pa.schema([("role", pa.int32()), ("state", pa.string()), ("k", pa.binary())])
_COUNTS = pa.schema([("role", pa.int32()), ("period", pa.int32()), ("state", pa.string()), ("n", pa.int64())])


def _decoded(table: pa.Table) -> pa.Table:
    """The keys of the bits that survive in any period."""
    words, found = _algebra(table)
    whole: dict[tuple[int, str], Bitmap] = {}
    for r, _, states in found:
        for s, b in states.items():
            whole[r, s] = whole[r, s] | b if (r, s) in whole else b
    parts = [pa.table([pa.array([r] * len(b), pa.int32()), pa.array([s] * len(b), pa.string()), words.take(pa.array(b.codes()))], schema=_KEYS) for (r, s), b in whole.items()]
    return pa.concat_tables(parts) if parts else _KEYS.empty_table()


def _counted(table: pa.Table) -> pa.Table:
    rows = [(r, p, s, len(b)) for r, p, states in _algebra(table)[1] for s, b in states.items() if len(b)]
    return pa.table([pa.array(c, t) for c, t in zip(zip(*rows), _COUNTS.types)], schema=_COUNTS) if rows else _COUNTS.empty_table()


def _by_range(refs: list[Reference], parents: list[Parent], removed: DataFrame, n_ranges: int | None, of_range: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    return _keyed(refs, parents, removed, n_ranges or ranges_for(refs, parents)).groupBy("range").applyInArrow(of_range, schema)


def _names(df: DataFrame, refs: list[Reference]) -> DataFrame:
    child = F.array(*[F.lit(r.child) for r in refs])
    column = F.array(*[F.lit(r.column) for r in refs])
    return df.withColumn("child_table", F.element_at(child, F.col("role") + 1)).withColumn("ref_column", F.element_at(column, F.col("role") + 1))


def orphan_keys(refs: list[Reference], parents: list[Parent], removed: DataFrame, n_ranges: int | None = None) -> DataFrame:
    """(child_table, ref_column, ref_value, state), distinct.

    deleted: the parent lacks the key and `removed` (table_name, k) lists it; missing: it lacks it otherwise; late: it
    has the key, but a child row was stored before the parent's first row. Null and blank references (a null key) are
    no cases, a child row without a time is never late, repeated rows count once, empty tables give no rows, and
    columns besides those named are ignored.
    """
    found = _by_range(refs, parents, removed, n_ranges, _decoded, "role int, state string, k binary")
    return _names(found.withColumn("ref_value", unpack(F.substring("k", 2, 2**31 - 2))), refs).select("child_table", "ref_column", "ref_value", "state")


def orphan_counts(refs: list[Reference], parents: list[Parent], removed: DataFrame, n_ranges: int | None = None) -> DataFrame:
    """(child_table, ref_column, period, state, n_keys): distinct keys per month in which a child row was stored; the
    period of rows without a time is null."""
    found = _by_range(refs, parents, removed, n_ranges, _counted, "role int, period int, state string, n long")
    found = found.groupBy("role", "period", "state").agg(F.sum("n").alias("n_keys"))
    month = F.when(F.col("period") > 0, F.format_string("%04d-%02d", F.floor(F.col("period") / 100).cast("int"), F.col("period") % 100))
    return _names(found, refs).select("child_table", "ref_column", month.alias("period"), "state", "n_keys")
