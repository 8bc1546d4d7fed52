"""Parsing of delimited text records into typed rows and reasoned rejects.

The bytes of all records of an Arrow batch are looked at at once. A mask of the quote bytes and the
parity of its prefix sum tell which bytes lie inside quotes; delimiters are the commas at even
parity. Quote placement, field counts and field types are then checked as array operations over
field positions, and text fields are gathered from the bytes, less the first quote of each doubled
one, in one step a field.

``file_records`` finds the records of whole files by the same index of quotes: see its text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

QUOTE, COMMA, SPACE, MINUS, HASH = 34, 44, 32, 45, 35
BIGINT_MAX = 9223372036854775807
TYPES = {"int": "bigint", "signed": "bigint", "number": "double", "date": "date"}


@dataclass(frozen=True)
class Field:
    """One field of a record: its kind is 'text', 'int', 'signed', 'number', 'date' or 'code'.

    int: ASCII digits, within ``least`` and bigint, not below the field named ``not_below``.
    signed: ASCII digits with an optional leading minus.
    number: a decimal number with an optional sign, fraction and exponent, as a double.
    date: yyyy-mm-dd of a day that exists.
    Of these, the texts in ``missing`` give null.
    code: one of ``codes``.
    """

    name: str
    kind: str = "text"
    least: int = 0
    not_below: str | None = None
    missing: tuple[str, ...] = ()
    codes: tuple[str, ...] = ()


def _whole_numbers(data: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(is ASCII digits and below 2^64, value as uint64) of the byte ranges [lo, hi)."""
    digit = (data >= 48) & (data <= 57)
    bad = np.concatenate(([0], np.cumsum(~digit)))
    ok = (hi > lo) & (bad[hi] == bad[lo])
    # skip leading zeros: the first byte that isn't '0' at or after lo
    other = np.where(data != 48, np.arange(len(data)), len(data))
    nxt = np.append(np.minimum.accumulate(other[::-1])[::-1], len(data)) if len(data) else np.zeros(1, dtype=np.int64)
    first = np.minimum(nxt[lo], hi)
    size = hi - first
    ok &= size <= 19
    value = np.zeros(len(lo), dtype=np.uint64)
    for i in range(int(size[ok].max(initial=0))):
        more = ok & (size > i)
        at = np.where(more, first + i, 0)
        d = data[at].astype(np.uint64) - np.uint64(48) if len(data) else value
        value = np.where(more, value * np.uint64(10) + d, value)
    return ok, value


def _is_text(data: np.ndarray, lo: np.ndarray, hi: np.ndarray, text: str) -> np.ndarray:
    want = text.encode()
    same = hi - lo == len(want)
    for i, b in enumerate(want):
        same &= data[np.where(same, lo + i, 0)] == b if len(data) else False
    return same


def _gather(data: np.ndarray, lo: np.ndarray, hi: np.ndarray, keep: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(int64 offsets, bytes) of the byte ranges [lo, hi) laid end to end, without the bytes not in ``keep``."""
    size = hi - lo
    offsets = np.concatenate(([0], np.cumsum(size)))
    at = np.arange(offsets[-1]) + np.repeat(lo - offsets[:-1], size)
    if keep is None:
        return offsets, data[at]
    kept = keep[at]
    return np.concatenate(([0], np.cumsum(kept)))[offsets], data[at[kept]]


def _strings(data: np.ndarray, lo: np.ndarray, hi: np.ndarray, n: int, rows: np.ndarray, keep: np.ndarray | None = None) -> pa.Array:
    """A string array of ``n`` values: the byte ranges at ``rows``, which rise, and nulls elsewhere."""
    offsets, flat = _gather(data, lo, hi, keep)
    size = np.zeros(n, dtype=np.int64)
    size[rows] = np.diff(offsets)
    known = np.zeros(n, dtype=bool)
    known[rows] = True
    all_offsets = np.concatenate(([0], np.cumsum(size)))
    out = pa.LargeStringArray.from_buffers(n, pa.py_buffer(all_offsets), pa.py_buffer(np.ascontiguousarray(flat)), pa.py_buffer(np.packbits(known, bitorder="little")))
    return out.cast(pa.string())


def _by_text(kind: str, text: pa.Array) -> pa.Array:
    """Values of a 'number' or 'date' field, null where invalid."""
    if kind == "number":
        ok = pc.match_substring_regex(text, r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$")
        return pc.if_else(ok, text, None).cast(pa.float64())
    ok = pc.match_substring_regex(text, "^[0-9]{4}-[0-9]{2}-[0-9]{2}$")
    month, day = (pc.cast(pc.if_else(ok, pc.utf8_slice_codeunits(text, a, b), "0"), pa.int32()) for a, b in ((5, 7), (8, 10)))
    year = pc.cast(pc.if_else(ok, pc.utf8_slice_codeunits(text, 0, 4), "0"), pa.int32()).to_numpy(zero_copy_only=False)
    m, d = month.to_numpy(zero_copy_only=False), day.to_numpy(zero_copy_only=False)
    leap = (year % 4 == 0) & ((year % 100 != 0) | (year % 400 == 0))
    longest = np.where(m == 2, 28 + leap, 31 - np.isin(m, (4, 6, 9, 11)))
    fine = pa.array(ok.to_numpy(zero_copy_only=False) & (year >= 1) & (m >= 1) & (m <= 12) & (d >= 1) & (d <= longest))
    return pc.if_else(fine, text, None).cast(pa.date32())


def parse_batch(raw: pa.Array, fields: list[Field], comment: bool = True) -> dict[str, object]:
    """Columns of one batch: ``keep`` (not a comment), ``reason`` (object array, None where valid) and,
    for each field, an Arrow array that is null in rejected rows."""
    n = len(raw)
    raw = raw.cast(pa.large_string())
    null = np.asarray(raw.is_null().to_numpy(zero_copy_only=False), dtype=bool)
    offs = np.frombuffer(raw.buffers()[1], dtype=np.int64)[raw.offset : raw.offset + n + 1]
    whole = raw.buffers()[2]
    data = np.frombuffer(whole, dtype=np.uint8)[offs[0] : offs[-1]] if whole is not None and n else np.zeros(0, np.uint8)
    start, end = offs[:-1] - offs[0], offs[1:] - offs[0]
    size = len(data)
    row_of = np.repeat(np.arange(n), end - start)
    is_comment = np.zeros(n, dtype=bool)
    if comment and size:
        is_comment = (end > start) & (data[np.minimum(start, size - 1)] == HASH)

    # --- structure: quote mask, prefix parity within the record
    quote = data == QUOTE
    count = np.concatenate(([0], np.cumsum(quote)))
    inside = ((count[:-1] - count[start][row_of]) & 1).astype(bool) if size else quote  # parity before the byte
    comma = (data == COMMA) & ~inside
    at = np.flatnonzero(quote)
    opening = at[~inside[at]]
    closing = at[inside[at]]
    first = start[row_of[opening]] == opening
    before = data[np.maximum(opening - 1, 0)]
    open_ok = first | (before == COMMA) | (before == QUOTE)
    # a comma before an opening quote is outside quotes by parity; a quote before it closed: a doubled quote
    last = end[row_of[closing]] == closing + 1
    after = data[np.minimum(closing + 1, max(size - 1, 0))]
    close_ok = last | (after == COMMA) | (after == QUOTE)
    broken = (count[end] - count[start]) % 2 == 1
    broken[row_of[opening[~open_ok]]] = True
    broken[row_of[closing[~close_ok]]] = True

    commas = np.flatnonzero(comma)
    per_row = np.bincount(row_of[commas], minlength=n) if size else np.zeros(n, dtype=np.int64)
    wrong = null | (per_row + 1 != len(fields)) | ((end == start) & (len(fields) > 1)) | (end == start)

    reason = np.where(broken & ~null, 2, wrong.astype(np.int64))  # 1 column_count, 2 quoting, then by field
    good = np.flatnonzero(~wrong & ~broken & ~is_comment)

    # --- field borders of the records with the right structure
    k = len(fields)
    first_comma = np.concatenate(([0], np.cumsum(per_row)))[:-1]
    inner = commas[first_comma[good][:, None] + np.arange(k - 1)[None, :]] if k > 1 and len(good) else np.zeros((len(good), k - 1), dtype=np.int64)
    lo = np.concatenate([start[good][:, None], inner + 1], axis=1)
    hi = np.concatenate([inner, end[good][:, None]], axis=1)
    some = hi > lo
    quoted = some & (data[np.where(some, lo, 0)] == QUOTE) if size else some
    lo, hi = lo + quoted, hi - quoted
    # trimmed borders: the next and the previous byte that isn't a space
    idx = np.arange(size)
    solid = data != SPACE
    nxt = np.append(np.minimum.accumulate(np.where(solid, idx, size)[::-1])[::-1], size) if size else np.zeros(1, np.int64)
    prv = np.concatenate(([-1], np.maximum.accumulate(np.where(solid, idx, -1)))) if size else np.full(1, -1)
    tlo = np.minimum(nxt[lo], hi)
    thi = np.maximum(prv[hi] + 1, tlo)

    bad: dict[str, np.ndarray] = {}
    values: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    texts: dict[str, pa.Array] = {}
    every = np.arange(len(good))
    for j, f in enumerate(fields):
        a, b = tlo[:, j], thi[:, j]
        if f.kind == "int":
            ok, v = _whole_numbers(data, a, b)
            ok &= (v <= np.uint64(BIGINT_MAX)) & (v >= np.uint64(f.least))
            if f.not_below:
                floor_ok, floor = values[f.not_below]
                ok &= ~floor_ok | (v >= floor.astype(np.uint64))
            values[f.name] = ok, v.astype(np.int64)
            bad[f.name] = ~ok
        elif f.kind == "signed":
            minus = (b > a) & (data[np.where(b > a, a, 0)] == MINUS) if size else np.zeros(len(good), bool)
            ok, v = _whole_numbers(data, a + minus, b)
            ok &= v <= np.uint64(BIGINT_MAX) + minus.astype(np.uint64)
            signed = np.where(minus, (~v + np.uint64(1)), v).astype(np.uint64).view(np.int64)
            values[f.name] = ok, signed
            bad[f.name] = ~ok
        elif f.kind in ("number", "date"):
            texts[f.name] = _by_text(f.kind, _strings(data, a, b, len(good), every))
            bad[f.name] = np.asarray(texts[f.name].is_null())
        elif f.kind == "code":
            ok = np.zeros(len(good), dtype=bool)
            for text in f.codes:
                ok |= _is_text(data, a, b, text)
            bad[f.name] = ~ok
        if f.name in bad and f.kind != "code":
            for text in f.missing:
                bad[f.name] &= ~_is_text(data, a, b, text)
    names = [None, "column_count", "quoting", *(f"bad_{f.name}" for f in fields)]
    for j, f in reversed(list(enumerate(fields))):
        if f.name in bad:
            reason[good[bad[f.name]]] = 3 + j

    valid = reason[good] == 0
    rows = good[valid]
    columns: dict[str, pa.Array] = {}
    single = ~(quote & inside)  # all but the first quote of a doubled one
    for j, f in enumerate(fields):
        if f.kind in ("int", "signed"):
            ok, v = values[f.name]
            out = np.zeros(n, dtype=np.int64)
            out[rows] = v[valid]
            mask = np.ones(n, dtype=bool)
            mask[rows] = ~ok[valid]
            columns[f.name] = pa.array(out, pa.int64(), mask=mask)
        elif f.kind in ("number", "date"):
            at_row = np.full(n, -1)
            at_row[rows] = every[valid]
            columns[f.name] = texts[f.name].take(pa.array(at_row, mask=at_row < 0))
        else:
            a, b = (tlo, thi) if f.kind == "code" else (lo, hi)
            columns[f.name] = _strings(data, a[valid, j], b[valid, j], n, rows, single if quoted[:, j].any() else None)
    return {"keep": ~is_comment, "reason": np.array(names, dtype=object)[reason], "columns": columns}


def load_records(df: DataFrame, raw: str, fields: list[Field], keep: list[str] | None = None, comment: bool = True) -> DataFrame:
    """Parse the records in column ``raw``; one row per record that is no comment.

    Result: the columns ``keep`` of the input (by default all but ``raw`` that clash with no field
    name nor ``reason``), one typed column per field, and ``reason``: null for a valid row, else why the record is
    rejected, with all fields null. Reasons in order: ``quoting``, ``column_count`` (null and empty
    records too), then ``bad_<field>`` in field order.

    A quote may open a field only as its first byte, ends before a comma or the record's end, and is
    doubled inside; a backslash has no meaning; line breaks may stand inside quotes. Records that
    start with ``#`` are comments and left out. Spaces (U+0020) around numbers and codes don't
    matter; text fields keep theirs. Repeated records stay; an empty input gives no rows. The parse
    is a narrow transformation: no shuffle, and a record is only ever held with its Arrow batch.
    """
    names = {f.name for f in fields} | {"reason"}
    keep = [c for c in df.columns if c != raw and c not in names] if keep is None else keep
    types = dict(df.dtypes)
    ddl = ", ".join([*(f"`{c}` {types[c]}" for c in keep), *(f"`{f.name}` {TYPES.get(f.kind, 'string')}" for f in fields), "reason string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            got = parse_batch(batch.column(batch.num_columns - 1), fields, comment)
            arrays = [*(batch.column(i) for i in range(len(keep))), *got["columns"].values(), pa.array(got["reason"], pa.string())]
            out = pa.RecordBatch.from_arrays(arrays, names=[*keep, *got["columns"], "reason"])
            yield out.filter(pa.array(got["keep"]))

    return df.select(*keep, F.col(raw).alias("__raw")).mapInArrow(run, ddl)


# --- records of whole files

SWAP, OPEN, CLOSE = 0, 1, 2


def _events(lines: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(line, kind) of the quote runs that change the state: OPEN, CLOSE, or SWAP where both are possible.

    A run of quotes counts if it is odd and has a comma or a border of its line on one side: in front
    of it, it opens, behind it, it closes. Even runs leave the state as it is; odd ones inside a field
    are misplaced and open nothing.
    """
    lines = lines.cast(pa.large_string())
    n = len(lines)
    offs = np.frombuffer(lines.buffers()[1], dtype=np.int64)[lines.offset : lines.offset + n + 1]
    whole = lines.buffers()[2]
    data = np.frombuffer(whole, dtype=np.uint8)[offs[0] : offs[-1]] if whole is not None and n else np.zeros(0, np.uint8)
    offs = offs - offs[0]
    at = np.flatnonzero(data == QUOTE)
    if not len(at):
        return at, at
    line = np.searchsorted(offs, at, "right") - 1
    new = np.append(True, (np.diff(at) > 1) | (np.diff(line) > 0))
    first = at[new]
    size = np.diff(np.append(np.flatnonzero(new), len(at)))
    line = line[new]
    after = first + size
    end = offs[line + 1]
    byte = np.append(data, 0)
    opens = (first == offs[line]) | (byte[first - 1] == COMMA)
    closes = (after == end) | (byte[after] == COMMA) | ((byte[after] == 13) & (after + 1 == end))
    counts = (size % 2 == 1) & (opens | closes)
    return line[counts], np.where(opens & closes, SWAP, np.where(opens, OPEN, CLOSE))[counts]


def _effective(kinds: np.ndarray, following: int) -> np.ndarray:
    """Which events count: an OPEN that is followed by another, or by nothing (-1), is never closed."""
    after = np.append(kinds[1:], following)
    return (kinds != OPEN) | ((after != OPEN) & (after != -1))


def _states(kinds: np.ndarray, state: int) -> np.ndarray:
    """The state (1: inside quotes) after each event."""
    fixed = np.maximum.accumulate(np.where(kinds != SWAP, np.arange(len(kinds)), -1))
    swaps = np.cumsum(kinds == SWAP)
    since = swaps - np.where(fixed >= 0, swaps[fixed], 0)
    return np.where(fixed >= 0, kinds[fixed] == OPEN, state) ^ (since & 1)


def _last_state(kinds: np.ndarray, state: int, following: int) -> int:
    kinds = kinds[_effective(kinds, following)]
    return int(_states(kinds, state)[-1]) if len(kinds) else state


def _by_split(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """((path, start, ...), rows) of consecutive rows of one split; a split may come in several."""
    for batch in batches:
        if not batch.num_rows:
            continue
        start = batch.column(2).to_numpy()
        path = batch.column(1).dictionary_encode().indices.to_numpy()
        cut = np.flatnonzero((np.diff(start) != 0) | (np.diff(path) != 0)) + 1
        for a, b in zip([0, *cut], [*cut, batch.num_rows]):
            part = batch.slice(a, b - a)
            yield tuple(part.column(i)[0].as_py() for i in range(1, part.num_columns)), part


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
    """Per split: its first event and, for each state in front of it and what follows it, the state behind it."""
    held: dict[tuple, list[np.ndarray]] = {}
    for key, part in _by_split(batches):
        held.setdefault(key, []).append(_events(part.column(0))[1])
    rows = []
    for (path, start), parts in held.items():
        k = np.concatenate(parts)
        outs = [_last_state(k, s, f) for f in (CLOSE, OPEN) for s in (0, 1)]
        rows.append((path, start, int(k[0]) if len(k) else None, *outs))
    yield pa.RecordBatch.from_pandas(pd.DataFrame(rows, columns=["path", "start", "first", "c0", "c1", "o0", "o1"]).astype({"start": "int64", "first": "Int32", "c0": "int32", "c1": "int32", "o0": "int32", "o1": "int32"}), preserve_index=False)


def _entries(splits: pd.DataFrame) -> pd.DataFrame:
    """The state in front of each split of one file, and the event that follows it (-1: none)."""
    splits = splits.sort_values("start").reset_index(drop=True)
    following, ahead = [-1] * len(splits), -1
    for i in reversed(range(len(splits))):
        following[i] = ahead
        ahead = ahead if pd.isna(splits["first"][i]) else int(splits["first"][i])
    state, states = 0, []
    for i, r in enumerate(splits.itertuples()):
        states.append(state)
        state = ((r.o0, r.o1) if following[i] in (OPEN, -1) else (r.c0, r.c1))[state]
    return pd.DataFrame({"path": splits["path"], "start": splits["start"], "state": states, "following": following})


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records of each split; ``part``: 0 whole, 1 an end, 2 a beginning, 3 a middle of one."""
    key, held, state, began, seq = None, [], 0, False, 0
    out: list[tuple] = []

    def advance(following: int, last: bool) -> None:
        """Turn the held lines into records, but for those that what follows may still change."""
        nonlocal held, state, began, seq
        line, kinds = _events(pa.array(held, pa.string()))
        fine = _effective(kinds, following)
        safe = len(held)
        if not last and len(kinds) and kinds[-1] == OPEN:
            safe, fine = int(line[-1]), fine & (line < line[-1])
        line, kinds = line[fine], kinds[fine]
        behind = np.zeros(safe + 1, dtype=np.int64)  # the state after each line
        if len(kinds):
            at = np.searchsorted(line, np.arange(safe), "right")
            behind[:safe] = np.where(at > 0, _states(kinds, state)[np.maximum(at - 1, 0)], state)
        else:
            behind[:safe] = state
        ends = np.flatnonzero(behind[:safe] == 0)
        a = 0
        for b in ends.tolist():
            out.append((key[0], key[1], seq, 1 if began else 0, "\n".join(held[a : b + 1])))
            began, a, seq = False, b + 1, seq + 1
        held = held[a:]
        if last and held:
            out.append((key[0], key[1], seq, 3 if began else 2, "\n".join(held)))
            held = []
        # lines that stay held are read again with the next ones, from the state in front of them: outside
        # quotes, unless they go on with a record of an earlier split
        state = 0 if a else state

    def flush() -> pa.RecordBatch:
        cols = list(zip(*out)) or [[]] * 5
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.string()))], names=["path", "start", "seq", "part", "raw"])

    for now, part in _by_split(batches):
        if now != key:
            if key is not None:
                advance(key[3], True)
            key, held, state, began, seq = now, [], now[2], now[2] == 1, 0
        held += part.column(0).to_pylist()
        advance(-1, False)
        if out:
            yield flush()
    if key is not None:
        advance(key[3], True)
        yield flush()


def file_records(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Records of delimited text files, as (file_name, raw), with line breaks inside quoted fields.

    A line feed ends a record where it lies outside quotes (a carriage return in front of it is
    dropped). Files are read in splits: a first pass tells what each split does to the state 'inside
    quotes', for either state in front of it, and what its first event is; the states in front of all
    splits follow from that, file by file; a second pass cuts each split into records, and only the
    records that cross splits, at most two pieces a split, are put together over tasks. One row of
    about 100 bytes a split is broadcast: 80 MB for 100 TB in splits of 128 MB.

    A quote that nothing closes doesn't swallow the file: an opening quote counts only if the next
    one that could change the state isn't again an opening one, so such a record ends with its line,
    and ``load_records`` rejects it. (Where a later quote can be read as closing it, it is so read: the
    text is a valid field then.) A task holds the lines from an undecided opening quote to the
    next quote of a field's border. Empty files give no rows; empty lines are empty records.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"))
    seen = lines.mapInArrow(_summaries, "path string, start bigint, first int, c0 int, c1 int, o0 int, o1 int")
    info = seen.groupBy("path").applyInPandas(_entries, "path string, start bigint, state int, following int")
    met = lines.join(F.broadcast(info.toDF("__path", "__start", "state", "following")), (F.col("path") == F.col("__path")) & (F.col("start") == F.col("__start"))).select("value", "path", "start", "state", "following")
    pieces = met.mapInArrow(_pieces, "path string, start bigint, seq bigint, part int, raw string")
    order = Window.partitionBy("path").orderBy("start", "seq")
    cut = pieces.where("part > 0").withColumn("record", F.sum(F.when(F.col("part") == 2, 1).otherwise(0)).over(order))
    joined = cut.groupBy("path", "record").agg(F.array_sort(F.collect_list(F.struct("start", "seq", "raw"))).alias("p")).select("path", F.array_join(F.col("p.raw"), "\n").alias("raw"))
    whole = pieces.where("part = 0").select("path", "raw").unionByName(joined)
    return whole.select(F.col("path").alias("file_name"), F.regexp_replace("raw", "\r$", "").alias("raw"))


def load_files(spark: SparkSession, path: str | list[str], fields: list[Field], comment: bool = True) -> DataFrame:
    """Typed rows and reasoned rejects of whole files: ``load_records`` over ``file_records``.

    Rejects keep their text in ``raw``; valid rows have null there.
    """
    rows = file_records(spark, path).withColumn("text", F.col("raw"))
    out = load_records(rows.withColumnRenamed("raw", "__record"), "__record", fields, keep=["file_name", "text"], comment=comment)
    return out.withColumn("raw", F.when(F.col("reason").isNotNull(), F.col("text"))).drop("text")


CALL_FIELDS = [
    Field("id"),
    Field("chrom"),
    Field("pos", "int", least=1),
    Field("end", "int", least=1, not_below="pos"),
    Field("len", "signed", missing=("", ".", "NA")),
    Field("tp", "code", codes=("P", "S", "I", "i")),
    Field("sample"),
    Field("note"),
]
